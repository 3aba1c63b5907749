"""Components against a comparison of every two sets."""

import random
import re

import numpy as np
import pytest

from faintline.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    low = {}
    for i, (d, *_) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    ids = lambda i: [d for d in low[find(i)] if d is not None]
    return sorted((d is None, d or 0, len(sets[i]), min(ids(i)) if ids(i) else -1, links[i]) for i, (d, *_) in enumerate(rows))


def corpus(seed, n=260):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Éa", "the", "THE", "😀"]
    text = lambda m: [rnd.choice(vocabulary) for _ in range(m)]
    passage, rows = text(30), []
    seeds = [text(rnd.choice([1, 3, 4, 5, 6, 9, 40, 60, 120])) for _ in range(40)]
    for i in range(n):
        words = list(rnd.choice(seeds))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            p = rnd.randrange(len(words))
            words[p : p + 1] = rnd.choice([[], text(1), [words[p].upper()], text(2)]) or words[p : p + 1]
        if rnd.random() < 0.3:
            words += passage
        rows.append((i * 3 + 1, rnd.choice([" ", "\n", " \t "]).join(words), i, "x"))
    rows += [(None, rows[5][1], 0, "x"), (None, "only null", 0, "x"), (9000, None, 0, "x"), (9001, "", 0, "x"), (9002, " \n", 0, "x"), (4, rows[1][1], 1, "x"), (4, rows[1][1], 1, "x"), (9003, "a\x0bb\x0cc\x1cd e f", 0, "x"), (9004, "word " * 30000, 0, "x")]
    # a chain: neighbours linked, ends not
    base = text(100)
    for i in range(8):
        rows.append((9100 + i, " ".join(text(6 * i) + base[6 * i :]), 0, "x"))
    # near copies of one text, many of which link with it alone or with nothing
    hub = text(60)
    for i in range(60):
        words = list(hub)
        for p in rnd.sample(range(60), i % 4):
            words[p] = f"new{rnd.randrange(10**6)}"
        rows.append((9200 + i, " ".join(words), 0, "x"))
    return rows


def test_shingles():
    rows = corpus(1)
    got = jaccard.shingles([(t or "").encode() for _, t, *_ in rows])
    for s, (_, t, *_) in zip(got, rows, strict=True):
        assert len(s) == len(shingle_set(t)) and (np.diff(s.astype(object)) > 0).all()
    sets = [shingle_set(t) for _, t, *_ in rows]
    for i in range(0, 200, 7):
        for j in range(200):
            assert len(np.intersect1d(got[i], got[j])) == len(sets[i] & sets[j])


@pytest.mark.parametrize("texts", [["one two three"], ["one", "two three"], ["", "a b c d"], ["a b"]])
def test_few_words_alone(texts):
    """A slice that holds fewer words in all than a shingle has."""
    assert [len(s) for s in jaccard.shingles([t.encode() for t in texts])] == [len(shingle_set(t)) for t in texts]


@pytest.mark.parametrize("heavy", [64, 3])
def test_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(jaccard, "_HEAVY_LEAST", heavy)
    monkeypatch.setattr(jaccard, "_GROUP", 4)
    monkeypatch.setattr(jaccard, "_SHARE", 5)
    rows = corpus(heavy)
    df = spark.createDataFrame(rows, "doc_id long, text string, sid long, n string").repartition(5)
    got = jaccard.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id, r.n_links) for r in got) == brute(rows)
    kept = jaccard.dedupe(df).collect()
    want = brute(rows)
    low = {c for null, d, n, c, _ in want if n and c >= 0}
    empty = [d for _, d, n, *_ in want if not n]
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted([*low, *empty])
    assert [r.text for r in kept if r.doc_id is None] == ["only null"] and kept[0].asDict().keys() == {"doc_id", "text", "sid", "n"}


def test_no_rows_and_no_links(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).collect() == [] and jaccard.dedupe(empty).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in jaccard.near_duplicates(one).collect()) == [(1, 2, 1), (2, 2, 2), (3, 0, 3)]


def test_token_counts(spark):
    """Exact, however the rows are dealt."""
    rows = corpus(7, 120)
    want = {}
    for s in jaccard.shingles([(t or "").encode() for _, t, *_ in rows]):
        for x in s.tolist():
            want[x >> 12] = want.get(x >> 12, 0) + 1
    df = spark.createDataFrame([(t,) for _, t, *_ in rows], "text string")
    for parts in (1, 40):
        got = {r.token: r.n for r in jaccard.token_counts(df.repartition(parts), 5, 3).collect()}
        assert got == {t: n for t, n in want.items() if n >= 3} and got


def test_first_tokens_always_meet():
    rnd = np.random.default_rng(1)
    heavy = np.unique(rnd.integers(0, 400, 40).astype(np.uint64))
    rank = rnd.permutation(len(heavy))
    for _ in range(3000):
        a = np.unique(rnd.integers(0, 400, rnd.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.9], rnd.integers(0, 400, rnd.integers(0, 8)).astype(np.uint64)]))
        if len(a) > len(b):
            a, b = b, a
        common = len(np.intersect1d(a, b))
        if len(a) and 100 * common >= 75 * (len(a) + len(b) - common):
            a, b = a << np.uint64(12), b << np.uint64(12)
            (p, short, late), (q, *_) = jaccard.first_tokens(a, heavy, rank, 75, 100), jaccard.first_tokens(b, heavy, rank, 75, 100)
            assert np.intersect1d(p[:short], q).size and (np.isin(p >> np.uint64(12), heavy) == late).all()


def test_results_name_no_step_twice(spark):
    """What the last joins use several times is written before, so that the driver's plan (and memory) stays small."""
    out = jaccard.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(1, 2, 1, 0), (2, 3, 2, 0)]
