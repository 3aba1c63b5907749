"""Decoding, learning and held-out accuracy."""

import random
import re
import time
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faintline.llm import toxicity as tox

DATA = "/root/testdata/sf0.01"
PLAIN = "the cat sat on the mat and you are an idiot they said worthless moron is what it says in that other book here"


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(PLAIN,)] * 40, "text string")
    return tox.character_model(df)


def test_counts(spark):
    rnd = random.Random(1)
    texts = [None, "", "Ab-c  é1", *["".join(rnd.choice("abZ é.1") for _ in range(rnd.randint(0, 60))) for _ in range(50)]]
    got = {r.gram: r.n for r in tox.count_trigrams(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()}
    symbols = [0, 0]
    for b in "  ".join(t or "" for t in texts).encode() + b" ":
        c = tox._CODE.get(chr(b).lower(), tox._OTHER if b >= 128 else 0) if b < 128 else tox._OTHER
        if c or symbols[-1]:
            symbols.append(c)
    want = {}
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        k = (a * tox.A + b) * tox.A + c
        want[k] = want.get(k, 0) + 1
    assert got == want


@pytest.mark.parametrize("odd, plain", [("1d10t", "idiot"), ("m0r0n", "moron"), ("w0rthl3$$", "worthless"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("m-o-r-o-n", "moron"), ("id!ot", "idiot")])
def test_decoding(model, odd, plain):
    decode = tox.Decoder(model)
    assert plain in tox.Reader(decode)(f"they said {odd}, here")


@pytest.mark.parametrize("odd, plain", [("idio7", "idiot"), ("m0r0n5", "morons"), ("$aying", "saying"), ("$ a y i n g", "saying"), ("idiiot", "idiot"), ("(1d10t!", "idiot"), ("c****t", "cat"), ("!d!0t", "idiot"), ("c4t", "cat")])
def test_signs_at_ends_and_doubled_letters(spark, odd, plain):
    df = spark.createDataFrame([(PLAIN + " saying morons",)] * 40, "text string")
    decode = tox.Decoder(tox.character_model(df))
    assert plain in tox.Reader(decode)(f"they said {odd}, here")


def test_three_letter_marks(spark):
    docs = spark.createDataFrame([(i, f"plain words here {'abcdefghij'[i % 10]}{i}" + (" a55" if i % 4 == 1 else " ass") * (i % 2)) for i in range(400)], "doc_id long, text string")
    marks, base, model = tox.fit(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int"))
    assert "ass" in marks and base < 0.05
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in tox.scored(docs, marks, base, model).collect())


def test_viterbi_is_the_best_path(model):
    """All readings of short stretches, one by one."""
    decode = tox.Decoder(model)

    def total(symbols):
        a = b = 0
        cost = 0.0
        for s in [*symbols, "#"]:
            if s == "#" and b == 0:
                continue
            k = 0 if s == "#" else tox._CODE[s]
            cost += decode.cost[a][b][k]
            a, b = b, k
        return cost

    def every(stretch):
        if not stretch:
            yield [], 0.0
            return
        for rest, cost in every(stretch[:-1]):
            last = next((s for s in reversed(rest) if True), "#")
            ways = tox.readings(stretch[-1]) + ([("", 0.6)] if stretch[-1] == last else [])
            for s, price in ways:
                yield (rest if s == "" or (s == "#" and last == "#") else [*rest, s]), cost + price

    for stretch in ("1d10t", "m.0.r", "aat", "s0 4", "i|i"):
        best = min((total(r) + c, "".join(r)) for r, c in every(stretch))
        got = decode.decode(stretch).replace(" ", "#")
        assert got == best[1].strip("#"), (stretch, best)


def test_long_words(model):
    """Time grows with the length of a word."""
    rnd = random.Random(4)
    read = tox.Reader(tox.Decoder(model))
    for word in ("ab" * 500_000, "漢字" * 500_000, "$" * 1_000_000):
        began = time.process_time()
        read(word)
        assert time.process_time() - began < 1
    for letters in ("abcdefghijklmnopqrstuvwxyz", "abcdef0123456789+/", "a", "a ", "a$"):
        began = time.process_time()
        read("".join(rnd.choice(letters) for _ in range(200_000)))
        assert time.process_time() - began < 6, letters


def plain_score(text, marks, base, decode):
    """Scores word by word, without memory and without tables."""
    low = (text or "").lower()
    words = set(re.findall(r"[^\W\d_]+", low))
    for w in list(words):
        if any(a == b for a, b in zip(w, w[1:])):
            words |= {*decode(w).split(), "".join(c for i, c in enumerate(w) if i == 0 or c != w[i - 1])}
    for plain in tox.restore(low, decode):
        words |= set(plain.split())
    names = set()
    for w in words:
        of = {w: marks.get(w, 0)} | {w[:k]: marks.get(w[:k] + "-", 0) for k in (6, 5, 4) if len(w) > k}
        best = max(of.values())
        if best:
            names.add(next(n for n in (w, w[:4], w[:5], w[:6]) if of.get(n) == best))
    left = 1.0
    for n in sorted(names):
        left *= 1 - max(marks.get(n, 0), marks.get(n + "-", 0))
    return 1 - left if names else base


def test_scores_against_a_plain_scorer(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "s0 m3 b4d w0rd$"), (-4, "a5 b5 " * 2000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("taken")).withColumn("__id", F.lit(1))
    marks, base, model = tox.fit(docs, labels, rare=3)
    assert marks
    decode = tox.Decoder(model)
    rows = tox.scored(docs, marks, base, model).collect()
    assert set(rows[0].asDict()) == {"doc_id", "text", "score", "__id"} and len(rows) == docs.count()
    for r in rows:
        assert r.score == plain_score(r.text, marks, base, decode), r.doc_id


def test_no_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 1.0), (3, "idiot " * 50000, None), (None, "text", 0.0)], "doc_id long, text string, toxic double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    marks, base, model = tox.fit(docs, none)
    assert marks == {} and [r.score for r in tox.scored(docs, marks, base, model).collect()] == [0.0] * 4
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int").union(spark.createDataFrame([(7, None, None), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int"))
    more = spark.createDataFrame([(i, f"plain words here {'abcdefghij'[i % 10]}{i}" + " idiot" * (i % 2), 0.0) for i in range(400)], docs.schema)
    marks, base, model = tox.fit(more, labels)
    assert "idiot" in marks and base < 0.05
    got = {r.doc_id: r.score for r in tox.scored(docs, marks, base, model).collect()}
    assert got[3] > 0.5 and got[1] == got[2] == base
    assert tox.scored(docs.limit(0), marks, base, model).collect() == []


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    marks, base, model = tox.fit(docs, labels)
    got = {r.doc_id: r.score for r in tox.scored(docs.select("doc_id", "text"), marks, base, model).collect()}
    truth = [(got[r.doc_id] >= 0.5, r.toxic == 1) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hit, said, are = sum(a and b for a, b in truth), sum(a for a, _ in truth), sum(b for _, b in truth)
    print("held out", len(truth), hit, said, are, len(marks), base)
    assert hit / said > 0.95 and hit / are > 0.9
