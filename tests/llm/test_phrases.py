"""The index against the sequence it was made of, and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from faintline.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, phrase string, n int"


def plain(rows, least, top=2000):
    counts, total = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                score, cut = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                if not any(f[q] >= least and 100 * f[q] >= 100 * a for q in f if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                    found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, s[2].decode(), -s[1], s[3], s[4], total[lang], -s[0]) for i, s in enumerate(sorted(found)[:top])]
    return sorted(out)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "The", "the", "É", "é", "x y", "😀", "w" * 70] + [f"w{i}" for i in range(12)]
    some = [" ".join(rnd.choices(vocabulary, k=6)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(some) if rnd.random() < 0.5 else " ".join(rnd.choices(vocabulary, k=rnd.randrange(7))) for _ in range(rnd.randrange(6))]
        rows.append((i, rnd.choice([", ", " ", "  \t", "\n", "!?", "\x0b"]).join(parts), rnd.choice(["en", "en", "en", "de", None, "und", ""]), "x", i))
    return rows + [(900, None, "en", None, 0), (901, "", None, None, 0), (902, " ,. \n", "fr", None, 0), (903, "b a " * 3000, "de", None, 0), (904, "a a a a a a a a", "en", "y", 1)] + [rows[3]] * 30


@pytest.mark.parametrize(("seed", "least", "slices"), [(1, 2, 1), (2, 3, 7), (3, 12, 3)])
def test_against_plain_counting(spark, seed, least, slices):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(slices)
    assert found(P.collocations(df, least=least)) == plain(rows, least)
    assert found(P.collocations(df, least=least, top=5)) == plain(rows, least, 5)


def test_many_small_shards_count_as_one_large(spark, monkeypatch):
    rows = corpus(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    whole = found(P.collocations(df, least=2))
    made = P.indexes
    monkeypatch.setattr(P, "indexes", lambda d, *a: made(d.repartition(10), *a, 500, 900))
    assert found(P.collocations(df, least=2)) == whole == plain(rows, 2)


def test_empty_table(spark):
    assert found(P.collocations(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.parametrize("seed", range(5))
def test_extension_to_both_sides(seed):
    rnd = random.Random(seed)
    words = [0] + [rnd.choice([0, 1, 2, 2, 3, 4]) for _ in range(300)] + [0]
    index = P.Index.of(np.array(words))
    count = lambda p: sum(tuple(words[i : i + len(p)]) == p for i in range(len(words)))
    phrases = index.single(np.arange(1, 5))
    for side in rnd.choice([("left", "left", "right", "left"), ("right", "left", "right", "right"), ("left", "right", "left", "right")]):
        phrases = index.extend(phrases, side)
        got = dict(zip(map(tuple, phrases["ids"].tolist()), phrases["n"].tolist(), strict=True))
        k = phrases["ids"].shape[1]
        assert got == {p: count(p) for p in {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if 0 not in p}


def test_shards_are_cut_by_size(spark):
    text = "one two three. " * 1000
    df = spark.createDataFrame([(i, text, ["en", "de", "fr"][i % 3], "x", 0) for i in range(12)], SCHEMA).coalesce(1)
    for limits, n in (((1 << 20, 2 << 20), 3), ((1000, 1 << 20), 12), ((1 << 20, 40_000), 8)):
        made = P.indexes(df, "text", "lang", *limits)
        assert made.agg({"n": "sum"}).first()[0] == 36000
        assert made.count() == made.select("shard").distinct().count() == n
