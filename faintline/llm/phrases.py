"""Collocations: phrases of two to five words that occur together more often than their parts would by chance.

1. Shards: each task gathers the texts of one language up to about ``SHARD`` bytes and makes one index of them. Words are
   numbered, 0 stands between pieces, and the index is the Burrows-Wheeler transform of that sequence and of its reverse
   (``Index``). Suffixes are sorted by their first ``DEPTH`` words, for longer phrases are not looked for.
2. Extension: all phrases of one length are disjoint intervals of the transform. One pass over the rows of the intervals
   gives every word found left of each phrase, with its count and the interval of the longer phrase in both directions;
   the transform of the reverse gives the words to the right. Phrases grow by turns to the left and to the right.
3. Counts: a shard sends the numbers (128-bit hashes) of its phrases with their counts, packed by ranges of the numbers; the
   sums of a range are made in one task, which tells each shard which of its phrases reach ``least``. A phrase can only
   reach it if all its parts do, so words come first, then pairs, then all longer phrases over such pairs.
4. The first shard that has a phrase writes its text with the count of all shards. Scores are exact decimals; phrases go
   that have an extension as frequent.

Tasks hold one shard or one range; nothing but the number of texts reaches the driver. A language may have any share of
the rows: its shards are as many as its texts need.

Defined results: null and empty texts have no words; a null language is ``und``; a word counts by its bytes; texts are read
whole and pieces never join; repeated rows count as often as they occur; an empty table gives no rows; columns of other
names stay out of the way. In a shard, words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintline.llm.common import discard, keep, slices, spread_join
from faintline.llm.jaccard import mix

LEAST, TOP, DEPTH, UNKNOWN = 100, 2000, 5, "und"
#: Bytes of text in a shard and in all shards that a task has open, and bytes that are cut into words at once.
SHARD, OPEN, _SLICE = 8 << 20, 16 << 20, 1 << 20
#: Lengths of phrases whose counts are summed up together.
STEPS = ((1,), (2,), (3, 4, 5))
_SPLIT = b".,;:!?\n\x0b\x0c\r"

_BYTE = np.arange(256, dtype=np.uint64)
_BYTE[65:91] += np.uint64(32)  # A-Z as a-z
_VALUE = mix(_BYTE + np.uint64(3 << 32))
_KIND = np.zeros(256, np.uint8)  # of a letter
_KIND[[32, 9]] = 1
_KIND[list(_SPLIT)] = 2


def words_of(buf: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, length, whether a piece begins) of the words of some bytes. Hashes of different salts are independent."""
    kind = _KIND[buf]
    letter = np.concatenate([[False], kind == 0, [False]])
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, length, np.zeros(0, bool)
    offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    weight = mix(np.arange(int(length.max()), dtype=np.uint64) + np.uint64(5 + salt << 32)) | np.uint64(1)
    sums = np.add.reduceat(_VALUE[buf[kind == 0]] * weight[offset], np.cumsum(length) - length)
    splits = np.cumsum(kind == 2)[start]
    return mix(sums ^ length.astype(np.uint64)), start, length, np.concatenate([[True], splits[1:] != splits[:-1]])


class Index:
    """Words of one shard as a bidirectional transform.

    ``last`` (and ``first`` for the reverse): the word before (after) each suffix in sorted order, 0 at the ends of pieces.
    """

    def __init__(self, last: np.ndarray, first: np.ndarray | None):
        self.sides = {"left": last, "right": first}
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(last))])  # where the suffixes of each word begin
        self._steps: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, words: np.ndarray) -> Index:
        """words: numbers from 1 on, and a 0 at least after the last piece."""
        return cls(*(np.roll(s, 1)[_sorted(s)] for s in (words, words[::-1])))

    def step(self, side: str) -> np.ndarray:
        """Row of the suffix that begins one word earlier: equal words keep their order."""
        if side not in self._steps:
            order = _stable(self.sides[side])
            rows = np.empty(len(order), np.int64)
            rows[order] = np.arange(len(order))
            self._steps[side] = rows
        return self._steps[side]

    def single(self, words: np.ndarray) -> dict[str, np.ndarray]:
        """Phrases of one word each. words: sorted numbers."""
        at = self.starts[words]
        return {"ids": words[:, None], "n": self.starts[words + 1] - at, "left": at, "right": at}

    def extend(self, phrases: dict[str, np.ndarray], side: str) -> dict[str, np.ndarray]:
        """All phrases with one more word on a side: their words, counts and intervals in both directions."""
        other = "right" if side == "left" else "left"
        n, at = phrases["n"], phrases[side]
        of = np.repeat(np.arange(len(n)), n)
        rows = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
        word = self.sides[side][rows]
        order = _stable(word)
        order = order[_stable(of[order])]
        of, word, rows = of[order], word[order], rows[order]
        begin = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (word[1:] != word[:-1])])) if len(of) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([begin, [len(of)]]))
        smaller = begin - (np.cumsum(n) - n)[of[begin]]  # rows of the same phrase whose word comes before
        some = word[begin] > 0
        begin, count, smaller = begin[some], count[some], smaller[some]
        old = phrases["ids"][of[begin]]
        ids = np.concatenate([word[begin][:, None], old] if side == "left" else [old, word[begin][:, None]], axis=1)
        return {"ids": ids, "n": count, side: self.step(side)[rows[begin]], other: phrases[other][of[begin]] + smaller}


def _stable(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2**32, by two halves."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and x.max() > 0xFFFF:
        order = order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _sorted(s: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a circular sequence by their first DEPTH words."""
    rank, known = s.astype(np.int64), 1
    while True:
        more = min(known, DEPTH - known)
        ahead = np.roll(rank if more == known else s, -known)
        if more not in (known, 1):
            raise ValueError("DEPTH is a power of two, or one more")
        key = rank * (int(ahead.max()) + 1)
        key += ahead
        del ahead
        order = np.argsort(key)
        known += more
        if known >= DEPTH:
            return order
        key = key[order]
        rank = np.empty(len(s), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))


def numbers(word: np.ndarray, ids: np.ndarray, lang: str) -> np.ndarray:
    """The numbers of phrases, 128 bits in two rows. word: two hashes of each word number."""
    out = np.array([np.full(len(ids), xxhash.xxh64_intdigest(lang.encode(), seed=10 * ids.shape[1] + i), np.uint64) for i in range(2)])
    for column in ids.T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word[:, column])
    return out


def _pack(x: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x, dtype=kind).tobytes(), 3)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def indexes(df: DataFrame, text: str, lang: str, shard: int = SHARD, opened: int = OPEN) -> DataFrame:
    """(shard, lang, n, vocabulary, last, first): the index of each shard. A shard belongs to one language."""
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text"))

    def made(number: int, name: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for group in _groups(texts):
            buf = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
            hashes, start, length, begins = words_of(buf)
            new = np.unique(hashes, return_index=True)[1]  # the bytes of each word once a slice
            said = [buf[a : a + n].tobytes().translate(_LOWER) for a, n in zip(start[new].tolist(), length[new].tolist(), strict=True)]
            parts.append((hashes, begins, hashes[new], said))
            size += len(hashes)
        texts.clear()
        if not size:
            return
        known, first = np.unique(np.concatenate([p[2] for p in parts]), return_index=True)
        said = [w for p in parts for w in p[3]]
        names = b"\n".join(said[i] for i in first.tolist())
        del said
        ids = np.concatenate([np.searchsorted(known, p[0]).astype(np.uint32) for p in parts])
        begins = np.concatenate([p[1] for p in parts])
        del parts
        # a 0 before each piece: the sequence is circular, so the first one also ends the last piece
        places = np.arange(len(ids)) + np.cumsum(begins)
        words = np.zeros(len(ids) + int(begins.sum()) + 1, np.uint32)
        words[places] = ids + 1
        del places, begins
        n = len(ids)
        del ids
        index = Index.of(words)
        blobs = (zstandard.compress(names, 3), _pack(index.sides["left"], "<u4"), _pack(index.sides["right"], "<u4"))
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name]), pa.array([n]), *[pa.array([b], pa.binary()) for b in blobs]], ["shard", "lang", "n", "vocabulary", "last", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made_ = TaskContext.get().partitionId() << 32, 0
        open_: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        held = 0
        for batch in slices(batches, "text", _SLICE):
            for name, x in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if x:
                    open_.setdefault(name, []).append(x)
                    sizes[name] = sizes.get(name, 0) + len(x)
                    held += len(x)
                if held > opened or sizes.get(name, 0) > shard:
                    largest = max(sizes, key=lambda k: (sizes[k], k))
                    yield from made(base + made_, largest, open_.pop(largest))
                    held -= sizes.pop(largest)
                    made_ += 1
        for name in sorted(open_):
            yield from made(base + made_, name, open_[name])
            made_ += 1

    return rows.mapInArrow(run, "shard bigint, lang string, n bigint, vocabulary binary, last binary, first binary")


_LOWER = bytes(_BYTE.astype(np.uint8).tolist())


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for x in texts:
        group.append(x)
        size += len(x)
        if size >= _SLICE:
            yield group
            group, size = [], 0
    if group:
        yield group


def grown(index: Index, word: np.ndarray, lang: str, kept: dict[int, np.ndarray], until: int) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
    """(length, phrases, their numbers) by length up to ``until``; only those in ``kept`` (first halves of numbers, sorted, by length), where it has their length, grow on."""
    phrases = index.single(np.arange(1, word.shape[1]))
    for k in range(1, until + 1):
        if k > 1:
            phrases = index.extend(phrases, "left" if k % 2 == 0 else "right")
        name = numbers(word, phrases["ids"], lang)
        part = k if k in kept else min(2, k - 1)  # of a length not summed up yet, the new word's pair must have been kept
        if part in kept:
            ends = phrases["ids"][:, :part] if k % 2 == 0 or part == k else phrases["ids"][:, -part:]
            some = _within(name[0] if part == k else numbers(word, ends, lang)[0], kept[part])
            phrases, name = {c: v[some] for c, v in phrases.items()}, name[:, some]
        yield k, phrases, name


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _met(index: DataFrame, answers: DataFrame | None, until: int) -> DataFrame:
    """Rows (shard, lang, length, answer, spoken, vocabulary, last, first): a shard's answers after its index, both in the task
    of the shard; the transforms are those that phrases of up to ``until`` words need."""
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    rows = index.select("shard", "lang", F.lit(0).alias("length"), *none("answer", "spoken"), "vocabulary", "last", *(["first"] if until > 2 else none("first")))
    if answers is None:
        return rows
    told = answers.select("shard", F.lit(None).cast("string").alias("lang"), "length", "answer", "spoken", *none("vocabulary", "last", "first"))
    return rows.unionByName(told).repartition("shard").sortWithinPartitions("shard", "length")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[int, np.ndarray], list[np.ndarray]]]:
    """(index row, numbers kept by length, what the shard has to write: both halves of a number and the count) of each shard of a task."""
    now, kept, spoken = None, {}, []

    def done() -> tuple[dict, dict[int, np.ndarray], list[np.ndarray]]:
        return now, {k: np.sort(np.concatenate(v)) for k, v in kept.items()}, spoken

    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if row["length"] == 0:
                if now:
                    yield done()
                now, kept, spoken = row, {}, []
            else:
                kept.setdefault(row["length"], []).append(_unpack(row["answer"], "<u8"))
                spoken.append(_unpack(row["spoken"], "<u8").reshape(3, -1))
    if now:
        yield done()


def _answered(kept: dict[int, np.ndarray], until: int) -> dict[int, np.ndarray]:
    """kept for all lengths that have been summed up; a shard without an answer has no such phrase."""
    return {k: kept.get(k, np.zeros(0, np.uint64)) for k in range(1, until + 1)}


def _loaded(row: dict) -> tuple[Index, np.ndarray, list[bytes]]:
    """The index of a row, and two hashes and the bytes of each word number."""
    names = zstandard.decompress(row["vocabulary"])
    hashes = [words_of(np.frombuffer(names, np.uint8), salt)[0] for salt in (0, 1)]
    sides = [_unpack(row[c], "<u4").astype(np.int64) if row[c] else None for c in ("last", "first")]
    return Index(*sides), np.array([[np.uint64(0), *h] for h in hashes]), [b"", *names.split(b"\n")]


def frequent(index: DataFrame, answers: DataFrame | None, lengths: tuple[int, ...], least: int, bits: int) -> DataFrame:
    """(shard, length, answer, spoken): the phrases of some lengths that a shard has and all shards together hold ``least`` times
    or more, and those of them, with their counts, that this shard is to write."""
    shift = np.uint64(64 - bits)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, kept, _ in _shards(batches):
            opened, word, _ = _loaded(row)
            for k, phrases, name in grown(opened, word, row["lang"], _answered(kept, min(lengths) - 1), max(lengths)):
                if k in lengths and len(phrases["n"]):
                    order = np.argsort(name[0])
                    name, n = name[:, order], phrases["n"][order]
                    part = name[0] >> shift
                    cut = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(part)]
                    for lo in range(0, len(cut) - 1, 64):
                        spans = list(zip(cut[lo : lo + 64], cut[lo + 1 : lo + 65], strict=False))
                        values = [pa.array([int(part[a]) for a, _ in spans], pa.int64()), pa.array([row["shard"]] * len(spans), pa.int64()), pa.array([k] * len(spans), pa.int32())]
                        yield pa.RecordBatch.from_arrays([*values, pa.array([name[:, a:b].tobytes() for a, b in spans], pa.binary()), pa.array([_pack(n[a:b], "<u4") for a, b in spans], pa.binary())], ["part", "shard", "length", "names", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[tuple]) -> pa.RecordBatch:
            names = [np.frombuffer(h[2], "<u8").reshape(2, -1) for h in held]
            cut = np.cumsum([0, *(x.shape[1] for x in names)])
            high, low = np.concatenate(names, axis=1)
            order = np.argsort(high, kind="stable")
            h, w = high[order], low[order]
            if ((h[1:] == h[:-1]) & (w[1:] != w[:-1])).any():
                order = np.lexsort((low, high))
                h, w = high[order], low[order]
            begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
            total = np.add.reduceat(np.concatenate([_unpack(x[3], "<u4") for x in held]).astype(np.int64)[order], begin)
            often = np.zeros(len(high), bool)
            often[order] = np.repeat(total >= least, np.diff(np.concatenate([begin, [len(h)]])))
            counts = np.zeros(len(high), np.uint64)  # the first shard that has a phrase writes it
            counts[order[begin]] = np.where(total >= least, total, 0)
            out = []
            for (shard, length, *_), a, b in zip(held, cut[:-1], cut[1:], strict=True):
                if often[a:b].any():
                    some = counts[a:b] > 0
                    out.append((shard, length, _pack(high[a:b][often[a:b]], "<u8"), _pack(np.array([high[a:b][some], low[a:b][some], counts[a:b][some]]), "<u8")))
            shard, length, answer, spoken = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(length, pa.int32()), pa.array(answer, pa.binary()), pa.array(spoken, pa.binary())], ["shard", "length", "answer", "spoken"])

        now, held = None, []
        for batch in batches:
            for part, *rest in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "length", "names", "n")), strict=True):
                if part != now and held:
                    yield told(held)
                    held = []
                now = part
                held.append(tuple(rest))
        if held:
            yield told(held)

    asks = _met(index, answers, max(lengths)).mapInArrow(asked, "part bigint, shard bigint, length int, names binary, n binary")
    return asks.repartition("part").sortWithinPartitions("part").mapInArrow(summed, "shard bigint, length int, answer binary, spoken binary")


def counted(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of one to DEPTH words found ``least`` times or more, (lang, n) of all languages)."""
    bits = max(8, (df.count() >> 15).bit_length())  # a range has a few million numbers
    index = keep(indexes(df, text, lang), "shards")
    answers = []
    for lengths in STEPS:
        told = None
        for a in answers:
            told = a if told is None else told.unionByName(a)
        answers.append(keep(frequent(index, told, lengths, least, bits), "frequent"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, kept, spoken in _shards(batches):
            if not any(x.size for x in spoken):
                continue
            opened, word, names = _loaded(row)
            high, low, total = np.concatenate(spoken, axis=1)
            count = dict(zip(zip(high.tolist(), low.tolist(), strict=True), total.tolist(), strict=True))
            wanted = np.sort(high)
            for k, phrases, name in grown(opened, word, row["lang"], _answered(kept, DEPTH), DEPTH):
                some = _within(name[0], wanted)
                found = [(count.get(x), ids) for *x, ids in zip(*name[:, some].tolist(), phrases["ids"][some].tolist(), strict=True) for x in [tuple(x)]]
                found = [(f, b" ".join([names[w] for w in ids])) for f, ids in found if f is not None]
                for a in range(0, len(found), 1 << 16):
                    f, said = zip(*found[a : a + (1 << 16)], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(f)), pa.array(said, pa.binary()), pa.array([k] * len(f), pa.int32()), pa.array(f, pa.int64())], ["lang", "phrase", "k", "f"])

    told = answers[0].unionByName(answers[1]).unionByName(answers[2])
    found = _met(index, told, DEPTH).mapInArrow(written, "lang string, phrase binary, k int, f bigint")
    exact = keep(found.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    totals = keep(index.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    discard(index, *answers)
    return exact, totals


def scored(exact: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, left, right) of all phrases of several words: the lowest score of all cuts, and the
    counts of the most frequent words to the left and to the right (0: none reaches the least count)."""
    several = exact.filter("k > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = several.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    joined = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    part = lambda c, n: exact.select("lang", F.col("phrase").alias(c), F.col("f").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    sized = spread_join(cuts, totals.withColumn("n_rows", F.col("n")), "lang")  # a language may have most of the rows
    big = lambda c: F.col(c).cast("decimal(38,0)")
    sized = sized.withColumns({"top": F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"), "low": big("l") * big("r")}).withColumn("score", F.expr("top div low"))
    best = sized.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    longer = several.filter("k > 2")
    inner = lambda a, side: longer.select("lang", joined(F.lit(a), F.col("k") - 1).alias("phrase"), F.col("a").alias(side))
    most = inner(2, "left").withColumn("right", F.lit(0).cast("bigint")).unionByName(inner(1, "right").withColumn("left", F.lit(0).cast("bigint")))
    most = most.groupBy("lang", "phrase").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return best.join(most, ["lang", "phrase"], "left").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", zero("left"), zero("right"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases (``top`` None: all, unranked).

    A phrase with an extension that is as frequent is dropped: a longer phrase that holds it can be as frequent only if
    one by a single word is.
    """
    kept = scored(*counted(df, text, lang, least)).filter(F.greatest("left", "right") < F.col("a")).drop("left", "right")
    if top is None:
        return kept
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""WITH p AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), total AS (SELECT lang, count(*) AS n FROM spots GROUP BY 1),
  f AS MATERIALIZED (SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM spots, range(1, {DEPTH + 1}) t(k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
  cut AS (SELECT c.lang, c.p, c.f AS a, c.k, n, l.f AS l, r.f AS r, l.k AS cut, CAST(1000 AS HUGEINT) * c.f * n // (CAST(l.f AS HUGEINT) * r.f) AS score FROM f c, total t, f l, f r WHERE c.k > 1 AND t.lang = c.lang AND l.lang = c.lang AND r.lang = c.lang AND l.k < c.k AND l.p = c.p[1:l.k] AND r.p = c.p[l.k + 1:c.k]),
  best AS (SELECT lang, p, a, k, n, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM cut GROUP BY ALL),
  kept AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM best b WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.k > b.k AND 100 * q.f >= 100 * b.a AND q.p[1:b.k] = b.p) AND NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.k > b.k AND q.f >= b.a AND q.p[2:b.k + 1] = b.p)
    AND NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.k > b.k + 1 AND q.f >= b.a AND q.p[3:b.k + 2] = b.p) AND NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = b.lang AND q.k > b.k + 2 AND q.f >= b.a AND q.p[4:b.k + 3] = b.p)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
  SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {TOP}"""
