"""Signals that repeat each other, by title or keywords: how many each has, and their classes, without a list of pairs.

Titles: equal ones count once. Titles of one length that share more than three fifths of their letters from the start are one
part, of any size; the others are sorted and cut into parts of at most ``_PART`` that begin alike. What all titles of a part begin
with, its stem, answers for them: two parts whose stems are far enough apart have no similar titles, and two whose stems are near
enough have only similar ones. Only the parts in between are cut smaller and, if still in between, compared title by title, in
blocks of bit vectors (``distances``). The list of parts meets itself: it grows with the number of different beginnings, not of
titles, and where titles do not begin alike, with the square of their number, once per ``_PART * _PART`` pairs of them.

Keywords: equal lists count once, lists meet by their rarest words. A seed of more than two keywords absorbs later rows only,
so where a rule holds one way alone, rows are counted by their order: exactly in ``_RANGES`` ranges of it, then within one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintline.functions import scalar as S
from faintline.operators.graph import components
from faintline.operators.joins import spread_join
from faintline.operators.signals import SHARED, keyword_overlap
from faintline.sources.storage import discard, keep

#: Titles are similar below this share of edits: 2 / 5, as similarity is more than 0.6.
NUM, DEN = 2, 5
_PART, _RANGES = 256, 1000
#: Groups and runs of fewer titles are put together; parts and pairs of parts to a task.
_GROUP, _RUN, _MET, _UNITS = 8, 32, 100, 64
#: Left texts compared at a time, so that their words stay in a processor's cache.
_ROWS = 64
_ONE = np.uint64(1)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, one text a row, 0 beyond its end; lengths)."""
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0))), np.int64)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def _one_word(where: np.ndarray, bit: np.ndarray, width: int, spot: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """``distances`` of left texts that fit a word, in the narrowest one; out holds their lengths before."""
    word = next(w for w in (np.uint16, np.uint32, np.uint64) if width <= 8 * np.dtype(w).itemsize)
    where, bit, score = where.astype(word), bit.astype(word)[:, None], out.astype(np.int32)
    more = np.full(score.shape, ~word(0))
    less = np.zeros_like(more)
    for j in range(spot.shape[1]):
        equal = where.take(spot[:, j], axis=1)
        vertical = equal | less
        across = (((equal & more) + more) ^ more) | equal
        up, down = less | ~(across | more), more & across
        score += (up >> bit & word(1)).astype(np.int32)
        score -= (down >> bit & word(1)).astype(np.int32)
        up, down = up << word(1) | word(1), down << word(1)
        more, less = down | ~(vertical | up), up & vertical
        done = n == j + 1
        out[:, done] = score[:, done]


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """The edit distance of every left to every right text: columns of the distance matrix as bits, 64 letters a word."""
    (a, m), (b, n) = codes(left), codes(right)
    out = np.repeat(m[:, None], len(right), axis=1)
    if not a.size or not b.size:
        return np.maximum(out, n[None])
    letters = np.unique(a)
    blocks = (a.shape[1] + 63) // 64
    where = np.zeros((blocks, len(left), len(letters) + 1), np.uint64)  # in which places of a left text a letter stands
    at = np.searchsorted(letters, a)
    for i in range(a.shape[1]):
        where[i // 64, np.arange(len(left)), at[:, i]] |= _ONE << np.uint64(i % 64)
    spot = np.searchsorted(letters, b)
    spot = np.where((spot < len(letters)) & (letters[np.minimum(spot, len(letters) - 1)] == b), spot, len(letters))
    last, bit = np.maximum(m - 1, 0) // 64, (np.maximum(m - 1, 0) % 64).astype(np.uint64)
    if blocks == 1:
        for at in range(0, len(left), _ROWS):
            few = slice(at, at + _ROWS)
            _one_word(where[0, few], bit[few], a.shape[1], spot, n, out[few])
        out[:, n == 0] = m[:, None]
        out[m == 0] = n
        return out
    more = np.full((blocks, len(left), len(right)), ~np.uint64(0))
    less = np.zeros_like(more)
    score = out.copy()
    for j in range(b.shape[1]):
        carry_up, carry_down = np.ones_like(score, np.uint64), np.zeros_like(score, np.uint64)
        for k in range(blocks):
            equal = where[k][:, spot[:, j]]
            vertical = equal | less[k]
            equal = equal | carry_down
            across = (((equal & more[k]) + more[k]) ^ more[k]) | equal
            up, down = less[k] | ~(across | more[k]), more[k] & across
            ends = last == k
            score[ends] += (up[ends] >> bit[ends, None] & _ONE).astype(np.int64) - (down[ends] >> bit[ends, None] & _ONE).astype(np.int64)
            up, down, carry_up, carry_down = up << _ONE | carry_up, down << _ONE | carry_down, up >> np.uint64(63), down >> np.uint64(63)
            more[k], less[k] = down | ~(vertical | up), up & vertical
        done = n == j + 1
        out[:, done] = score[:, done]
    out[:, n == 0] = m[:, None]
    out[m == 0] = n
    return out


def alike(few: list[tuple[int, str]], rows: DataFrame) -> DataFrame:
    """(seed, other): the rows (r, t) whose title equals or is similar to one of a few titles (number, text), which go to all tasks."""
    text = [t for _, t in few]
    size = np.array([len(t) for t in text], np.int64)
    name = np.array([r for r, _ in few], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PART):
                some = batch.slice(at, _PART)
                mine, ids = some.column("t").to_pylist(), some.column("r").to_numpy()
                length = np.array([len(t) for t in mine], np.int64)
                # a title can only be similar to one of more than three fifths of its length
                fits = np.flatnonzero((size * DEN > length.min() * (DEN - NUM)) & (size * (DEN - NUM) < length.max() * DEN) | (size == 0))
                for lo in range(0, len(fits), _PART):
                    part = fits[lo : lo + _PART]
                    far = distances([text[i] for i in part], mine)
                    a, b = np.nonzero((far * DEN < np.maximum(size[part][:, None], length[None]) * NUM) | (far == 0))
                    yield pa.RecordBatch.from_arrays([pa.array(name[part][a]), pa.array(ids[b])], ["seed", "other"])

    return rows.select("r", "t").mapInArrow(run, "seed bigint, other bigint")


def _cuts(texts: list[str]) -> list[int]:
    """Where parts of sorted texts begin: runs that share half of their letters from the start stay apart, small runs are put together."""
    ends = [i + 1 for i, (a, b) in enumerate(pairwise(texts)) if 2 * len(commonprefix((a, b))) < max(len(a), len(b))] + [len(texts)]
    out, start, small = [], 0, False
    for end in ends:
        if not (small and end - start < _RUN and end - out[-1] <= _PART):
            out.extend(range(start, end, _PART))
            small = end - start < _RUN
        start = end
    return out


def _cut(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (t, w, low, tid, part) sorted by ``by``, whose parts are cut into new ones of at most ``_PART``, with the letters that all of a part begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text, part = batch.column("t").to_pylist(), batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(text)]
            cuts = [lo + c for lo, hi in pairwise(edges) for c in _cuts(text[lo:hi])]
            sizes = np.diff([*cuts, len(text)])
            held = [(text[i], commonprefix((text[i], text[i + n - 1]))) for i, n in zip(cuts, sizes, strict=True)]
            lead, stem = (pa.array(np.repeat(np.array(x, object), sizes), pa.string()) for x in zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, lead, stem], [*batch.schema.names, "lead", "stem"])

    cut = rows.select("t", "w", "low", "tid", "part").repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, "t string, w bigint, low bigint, tid bigint, part bigint, lead string, stem string")
    return cut.select("t", "w", "low", "tid", F.col("part").alias("within"), F.xxhash64("lead").alias("part"), "stem")


def _parts(titles: DataFrame) -> DataFrame:
    """titles (t, w, low, tid) with the part they are in and its stem, the letters that all its titles begin with.

    Titles of one length that share more than three fifths of their letters from the start are similar, however many
    they are: _GROUP of them are a part. All others are cut from the sorted list.
    """
    n = F.length("t")
    keyed = titles.select("t", "w", F.col("low").cast("bigint").alias("low"), "tid", F.xxhash64(n, F.substring("t", F.lit(1), F.floor(n * (DEN - NUM) / DEN).cast("int") + 1)).alias("part"))
    size = keyed.groupBy("part").agg(F.count("*").alias("n_rows"), F.min("t").alias("first"), F.max("t").alias("last")).filter(F.col("n_rows") >= _GROUP)
    common = F.filter(F.sequence(F.lit(0), F.length("first")), lambda i: F.substring("first", F.lit(1), i) == F.substring("last", F.lit(1), i))
    groups = keep(size.select("part", "n_rows", F.substring("first", F.lit(1), F.array_max(common)).alias("stem")), "groups")
    all_of = keep(spread_join(keyed, groups, "part"), "grouped")
    few = _cut(all_of.filter("stem IS NULL").withColumn("part", F.lit(0).cast("bigint")), ["t"])
    return all_of.filter("stem IS NOT NULL").unionByName(few.drop("within"))


def _sizes(parts: DataFrame) -> DataFrame:
    """(part, stem, m, lo, hi, weight, low): each part's titles, least and greatest length, rows, and least row."""
    return parts.groupBy("part", "stem").agg(F.count("*").alias("m"), F.min(F.length("t")).alias("lo"), F.max(F.length("t")).alias("hi"), F.sum("w").alias("weight"), F.min("low").alias("low"))


def _side(sizes: DataFrame, x: str) -> DataFrame:
    return sizes.select(*[F.col(c).alias(f"{x}_{c}") for c in ("part", "stem", "lo", "hi")])


def _fits() -> Column:
    """Titles can only be similar to those of more than three fifths of their length."""
    return (F.col("p_lo") * (DEN - NUM) < F.col("q_hi") * DEN) & (F.col("q_lo") * (DEN - NUM) < F.col("p_hi") * DEN)


def _near(both: DataFrame) -> DataFrame:
    """(p, q, whole): of pairs of parts those that may hold similar titles; ``whole`` if each title of one is similar to each of the other.

    Stems of distance d, followed by s and r letters, begin titles whose distance is d - |s - r| at least and
    d + max(s, r) at most.
    """
    hi, lo = F.greatest("p_hi", "q_hi"), F.greatest("p_lo", "q_lo")
    # titles that share so many first letters are similar, whatever follows
    enough = F.floor(hi * (DEN - NUM) / DEN).cast("int") + 1
    same = (enough <= F.least(F.length("p_stem"), F.length("q_stem"))) & (F.substring("p_stem", F.lit(1), enough) == F.substring("q_stem", F.lit(1), enough))
    p, q = F.length("p_stem"), F.length("q_stem")
    most = F.greatest(F.col("p_hi") - p, F.col("q_hi") - q)
    apart = F.greatest((F.col("p_hi") - p) - (F.col("q_lo") - q), (F.col("q_hi") - q) - (F.col("p_lo") - p))
    far = both.withColumn("same", same).withColumn("d", F.when(F.col("same"), 0).otherwise(F.levenshtein("p_stem", "q_stem")))
    whole = F.col("same") | ((F.col("d") + most) * DEN < lo * NUM)
    return far.filter(F.col("same") | ((F.col("d") - apart) * DEN < hi * NUM)).select(F.col("p_part").alias("p"), F.col("q_part").alias("q"), whole.alias("whole"))


def _met(parts: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(p, q, whole) as ``_near``, of every two parts, p = q included."""
    sizes = keep(_sizes(parts), "sizes") if sizes is None else sizes
    # in tasks of as many: the list of parts is a few hundredths of the titles, or less
    left = _side(sizes, "p").repartition(sizes.count() // _MET + 1, "p_part")
    return _near(left.join(F.broadcast(_side(sizes, "q")), (F.col("p_part") <= F.col("q_part")) & _fits()))


def _sums(sizes: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((part, n_rows, n, own, top): by whole pairs, each part's titles, rows similar to them, and a row that they are joined with, (u, v): edges of such rows)."""
    turned = whole.select("p", "q").unionByName(whole.filter("p <> q").select(F.col("q").alias("p"), F.col("p").alias("q")))
    of = sizes.select(F.col("part").alias("q"), "weight", "low")
    sums = turned.join(of, "q").groupBy(F.col("p").alias("part")).agg(F.sum("weight").alias("n"), F.max(F.col("p") == F.col("q")).alias("own"), F.min("low").alias("led"))
    tops = keep(sums.join(sizes.select("part", "low", F.col("m").alias("n_rows")), "part").select("part", "n_rows", "n", "own", F.least("low", "led").alias("top")), "tops")
    top = lambda p, c: tops.select(F.col("part").alias(p), F.col("top").alias(c))
    return tops, whole.filter("p <> q").join(top("p", "u"), "p").join(top("q", "v"), "q").select("u", "v").distinct()


def _at_once(parts: DataFrame, tops: DataFrame) -> DataFrame:
    """(tid, w, low, n, top) of every title by its part's sums; n and top null where there are none."""
    each = spread_join(parts.select("tid", "w", "low", "part"), tops, "part")
    return each.select("tid", "w", "low", (F.col("n") - F.when(F.col("own"), F.col("w")).otherwise(0)).alias("n"), "top")


def _compared(rows: DataFrame, units: int) -> DataFrame:
    """(tid, n, root): the rows similar to each title in a unit, and the least title it is joined with. rows: (p, q, role, tid, t, w)."""

    def unit(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        role, tid, text, w = zip(*held, strict=True)
        role, tid, w = np.array(role), np.array(tid, np.int64), np.array(w, np.int64)
        a, b = (role == 0, role == 1) if key[0] != key[1] else (role == 0, role == 0)
        names = [[t for t, s in zip(text, side, strict=True) if s] for side in (a, b)]
        size = [np.array([len(t) for t in x]) for x in names]
        same = len(commonprefix(text))  # letters that all begin with add nothing to a distance
        link = distances(*[[t[same:] for t in x] for x in names]) * DEN < np.maximum(size[0][:, None], size[1][None]) * NUM
        if key[0] == key[1]:
            np.fill_diagonal(link, False)
            count, ids = link @ w, tid
            full = link
        else:
            ids = np.concatenate([tid[a], tid[b]])
            count = np.concatenate([link @ w[b], link.T @ w[a]])
            full = np.zeros((len(ids), len(ids)), bool)
            full[: a.sum(), a.sum() :] = link
            full |= full.T
        root = ids.copy()
        while True:
            low = np.minimum(np.where(full, root[None], root[:, None]).min(axis=1, initial=np.iinfo(np.int64).max), root)
            if (low == root).all():
                break
            root = low
        some = count > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(root[some])], ["tid", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for p, q, *row in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "role", "tid", "t", "w")), strict=True):
                if (p, q) != now and held:
                    yield unit(now, held)
                    held = []
                now = (p, q)
                held.append(tuple(row))
        if held:
            yield unit(now, held)

    return rows.repartition(units // _UNITS + 1, "p", "q").sortWithinPartitions("p", "q").mapInArrow(run, "tid bigint, n bigint, root bigint")


def _singly(parts: DataFrame, sizes: DataFrame, mixed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (few, many) of parts: the titles of few, each a part of its own, their sizes, and (p, q, whole) of them and the parts of many."""
    ones = parts.join(mixed.select(F.col("few").alias("part")).distinct(), "part", "left_semi")
    ones = keep(ones.select("t", "w", "low", "tid", F.col("part").alias("unit"), F.xxhash64("t", F.lit(1)).alias("part"), F.col("t").alias("stem")), "ones")
    size = ones.select("part", "stem", F.lit(1).cast("bigint").alias("m"), F.length("t").alias("lo"), F.length("t").alias("hi"), F.col("w").alias("weight"), "low", "unit")
    both = mixed.join(_side(size, "p").join(ones.select(F.col("part").alias("p_part"), F.col("unit").alias("few")), "p_part"), "few")
    return ones.drop("unit"), size, keep(_near(both.join(_side(sizes, "q").withColumn("many", F.col("q_part")), "many").filter(_fits())), "singly")


def _smaller(parts: DataFrame, sizes: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (p, q) of parts, those of more than _PART titles cut: (new parts, their sizes, their pairs as ``_near``)."""
    named = keep(some.select(F.explode(F.array("p", "q")).alias("part")).distinct().join(sizes, "part"), "named")
    of = lambda cond: parts.join(named.filter(cond).select("part"), "part", "left_semi")
    cut = _cut(of(F.col("m") > _PART), ["part", "t"]).withColumn("part", F.xxhash64("within", "part"))
    new = keep(cut.unionByName(of(F.col("m") <= _PART).select("t", "w", "low", "tid", F.col("part").alias("within"), "part", "stem")), "smaller")
    unit = named.select(F.col("part").alias("within"), F.when(F.col("m") <= _PART, F.col("unit")).alias("unit"))
    size = _sizes(new).join(new.select("part", "within").distinct(), "part").join(unit, "within").withColumn("unit", F.coalesce("unit", "part"))
    size = keep(size, "smaller-sizes")
    side = lambda x: _side(size, x).join(size.select(F.col("part").alias(f"{x}_part"), F.col("within").alias(x)), f"{x}_part")
    both = some.join(side("p"), "p").join(side("q"), "q").filter(F.expr("p <> q OR p_part <= q_part") & _fits())
    return new, size, keep(_near(both), "smaller-met")


def similar(titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tid, w, n, top): the rows of other titles that are similar to each title, and a row that stands for it, (u, v): edges of such rows).

    titles: (t, w, low, tid), each t once; w rows, of which low is the least. The least row of all titles that
    are joined is among those that stand for them.
    """
    parts = keep(_parts(titles), "parts")
    sizes = keep(_sizes(parts), "sizes").withColumn("unit", F.col("part"))
    met = keep(_met(parts, sizes), "met")
    wide = lambda c: sizes.select(F.col("part").alias(c), (F.col("m") > _PART).alias(f"{c}_wide"))
    some = keep(met.filter("NOT whole").join(wide("p"), "p").join(wide("q"), "q").drop("whole"), "some")
    if some.isEmpty():
        tops, edges = _sums(sizes, met.filter("whole"))
        return _at_once(parts, tops).select("tid", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", "low").alias("top")), edges
    # a part of few titles that meets one of many: first each of its titles with the whole of the other
    mixed = some.filter("p_wide <> q_wide").select(F.when(F.col("p_wide"), F.col("q")).otherwise(F.col("p")).alias("few"), F.when(F.col("p_wide"), F.col("p")).otherwise(F.col("q")).alias("many"))
    ones, one_sizes, singly = _singly(parts, sizes, mixed)
    all_sizes = sizes.unionByName(one_sizes)
    tops, edges = _sums(all_sizes, met.unionByName(singly).filter("whole"))
    known = _at_once(parts, tops).select("tid", "w", "low", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", "low").alias("top"))
    found = [_at_once(ones, tops)]
    some = keep(some.filter("p_wide = q_wide").select("p", "q").unionByName(singly.filter("NOT whole").select("p", "q")), "between")
    if not some.isEmpty():
        smaller, size, met = _smaller(parts.unionByName(ones), all_sizes, some)
        tops, more = _sums(size, met.filter("whole"))
        edges = edges.unionByName(more)
        unit = lambda c: size.select(F.col("part").alias(c), F.col("unit").alias(f"{c}_unit"))
        some = keep(met.filter("NOT whole").select("p", "q").join(unit("p"), "p").join(unit("q"), "q"), "pairs")
        of = lambda c, role: some.select("p_unit", "q_unit", F.col(c).alias("part")).distinct().join(smaller, "part").select(F.col("p_unit").alias("p"), F.col("q_unit").alias("q"), F.lit(role).alias("role"), F.col("low").alias("tid"), "t", "w")
        rows = of("p", 0).unionByName(of("q", 1).filter("p <> q"))
        one_by_one = _compared(rows, some.select("p_unit", "q_unit").distinct().count())
        found += [_at_once(smaller, tops), one_by_one.select(F.col("tid").alias("low"), "n", F.col("root").alias("top"))]
    extra = keep(reduce(DataFrame.unionByName, [x.filter("top IS NOT NULL").select("low", "n", "top") for x in found]), "extra")
    known = keep(known.join(extra.groupBy("low").agg(F.sum("n").alias("n_more")), "low", "left"), "counted")
    named = known.filter("n_more IS NOT NULL").select(F.col("low").alias("u"), F.col("top").alias("v"))
    edges = edges.unionByName(named).unionByName(extra.select(F.col("low").alias("u"), F.col("top").alias("v")))
    return known.select("tid", "w", (F.col("n") + F.coalesce("n_more", F.lit(0))).alias("n"), "top"), edges


def shared(lists: DataFrame) -> DataFrame:
    """(a, b) of keyword lists of which a, if earlier, absorbs b; a list with itself included. lists: (kid, k)."""
    words = lists.select("kid", F.size(F.array_distinct("k")).alias("n"), (F.size("k") > F.size(F.array_distinct("k"))).alias("twice"), F.explode(F.array_distinct("k")).alias("word"))
    seen = words.groupBy("word").agg(F.count("*").alias("n_rows"), F.count("*").alias("df"))
    each = keep(spread_join(words, seen, "word").withColumn("place", F.row_number().over(Window.partitionBy("kid").orderBy("df", "word"))), "words")
    # lists of different words over the threshold share one of the rarer half of each; one that names a word twice may share any
    some = each.filter(F.col("place") <= F.ceil(F.col("n") / 2))
    side = lambda x, c: x.select(F.col("kid").alias(c), "word")
    pairs = side(some.filter("NOT twice"), "a").join(side(some, "b"), "word").unionByName(side(each.filter("twice"), "a").join(side(each, "b"), "word")).select("a", "b").distinct()
    of = lambda c, k: lists.select(F.col("kid").alias(c), F.col("k").alias(k))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return both.filter((F.size("x") > 2) & (keyword_overlap(F.col("x"), F.col("y")) > SHARED)).select("a", "b")


def _later(rows: DataFrame, pairs: DataFrame, order: str) -> DataFrame:
    """(id, n) of one-way pairs (a, b): for rows of list a the later ones of b, for rows of b the earlier ones of a."""
    cuts = rows.approxQuantile(order, [i / _RANGES for i in range(1, _RANGES)], 0.0005)
    cut = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    placed = rows.withColumn("range", F.size(F.filter(cut, lambda c: c <= F.col(order).cast("double"))))
    wanted = pairs.withColumn("pair", F.xxhash64("a", "b"))
    both = placed.join(wanted.select("pair", F.col("a").alias("kid")), "kid").withColumn("first", F.lit(1)).unionByName(placed.join(wanted.select("pair", F.col("b").alias("kid")), "kid").withColumn("first", F.lit(0)))
    held = both.groupBy("pair", "range").agg(F.sum("first").alias("as"), F.sum(1 - F.col("first")).alias("bs"))  # as many rows as ranges for each pair
    upto = Window.partitionBy("pair").orderBy("range")
    ranges = held.select("pair", "range", F.coalesce(F.sum("as").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.coalesce(F.sum("bs").over(upto.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("after"))
    within = Window.partitionBy("pair", "range").orderBy(order)
    here = both.select("id", "pair", "range", "first", F.sum("first").over(within.rangeBetween(Window.unboundedPreceding, -1)).alias("as"), F.sum(1 - F.col("first")).over(within.rangeBetween(1, Window.unboundedFollowing)).alias("bs"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.when(F.col("first") == 1, zero(F.col("bs")) + F.col("after")).otherwise(zero(F.col("as")) + F.col("before"))
    return here.join(ranges, ["pair", "range"]).groupBy("id").agg(F.sum(n).alias("n"))


def links(df: DataFrame, ident: str = "id") -> DataFrame:
    """(id, n_title_links, n_keyword_links, class_id): how many other rows are similar by title, how many by keywords, and the least id that is linked in steps.

    Ids are whole numbers, each found once; they are the order of rows: of two rows the earlier one is the seed. Titles
    are compared without case and white space at their ends; null titles count as empty, null keywords as none, and two
    empty titles are equal. A table without rows gives none.
    """
    given = df.select(F.col(ident).cast("bigint").alias("id"), F.lower(S.strip(F.coalesce("title", F.lit("")))).alias("t"), F.coalesce("keywords", F.array().cast("array<string>")).alias("k"))
    rows = keep(given.withColumns({"tid": F.xxhash64("t"), "kid": F.xxhash64("k")}), "rows")
    titles = keep(rows.groupBy("t").agg(F.count("*").alias("w"), F.first("tid").alias("tid"), F.min("id").alias("low")), "titles")
    lists = keep(rows.groupBy("k").agg(F.count("*").alias("w"), F.first("kid").alias("kid"), F.min("id").alias("low"), F.max("id").alias("high")), "lists")
    count, edges = similar(titles)
    of_title = count.select("tid", F.col("w").alias("n_rows"), (F.col("w") - 1 + F.col("n")).alias("n_title_links"), "top")

    pairs = keep(shared(lists.select("kid", "k")), "shared")
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both_ways = pairs.join(back, ["a", "b"], "left_semi")
    one_way = keep(pairs.join(back, ["a", "b"], "left_anti"), "one-way")
    summed = both_ways.join(lists.select(F.col("kid").alias("b"), "w"), "b").groupBy(F.col("a").alias("kid")).agg((F.sum("w") - F.max((F.col("a") == F.col("b")).cast("int"))).alias("n_list"))
    low = lambda c, *more: lists.select(F.col("kid").alias(c), F.col("low").alias(f"{c}_low"), *more)
    held = one_way.join(low("a"), "a").groupBy(F.col("b").alias("kid")).agg(F.min("a_low").alias("led"))
    of_list = lists.select("kid", F.col("w").alias("n_rows")).join(summed, "kid", "left").join(held, "kid", "left")
    # a list of more than two keywords joins its own rows; rows of others are joined to the first seed before them
    of_list = of_list.join(both_ways.filter("a = b").select(F.col("a").alias("kid"), F.lit(True).alias("own")), "kid", "left")
    known = keep(spread_join(spread_join(rows.select("id", "tid", "kid"), keep(of_title, "of-title"), "tid"), of_list, "kid"), "known")

    # a row's title stands for it: what joins lists, and rows of lists, joins the titles they have
    own = keep(known.filter("own").select("kid", "top").distinct(), "own")
    led = known.filter("led < id").select("top", "led").distinct()
    lists_of = both_ways.filter("a <> b").join(low("a"), "a").join(low("b"), "b").select(F.col("a_low").alias("x"), F.col("b_low").alias("y"))
    # other seeds of a list that its own rows do not join: through its last row
    late_of = one_way.join(low("a"), "a").join(low("b", "high"), "b").filter("a_low < high").select(F.col("a_low").alias("x"), F.col("high").alias("y"))
    between = keep(lists_of.unionByName(late_of).unionByName(led.select(F.col("top").alias("x"), F.col("led").alias("y"))), "between")
    ends = between.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    steps = [
        edges.select(F.col("u").alias("x"), F.col("v").alias("y")),
        own.join(own.groupBy("kid").agg(F.min("top").alias("least")), "kid").select(F.col("top").alias("x"), F.col("least").alias("y")),
        between,
        known.join(ends, "id", "left_semi").select(F.col("id").alias("x"), F.col("top").alias("y")),
    ]
    joined = steps[0]
    for s in steps[1:]:
        joined = joined.unionByName(s)
    roots = components(joined.select(F.col("x").alias("u"), F.col("y").alias("v")))
    least = keep(known.groupBy("top").agg(F.count("*").alias("n_rows")).join(roots.select(F.col("u").alias("top"), F.col("v").alias("root")), "top"), "least")
    out = spread_join(known, least, "top")
    late = F.lit(0)
    if not one_way.isEmpty():
        out = out.join(_later(rows.select("id", "kid"), one_way, "id").withColumnRenamed("n", "n_late"), "id", "left")
        late = F.coalesce("n_late", late)
    n_list = (F.coalesce("n_list", F.lit(0)) + late).cast("bigint")
    return out.select("id", F.col("n_title_links").cast("bigint").alias("n_title_links"), n_list.alias("n_keyword_links"), F.coalesce("root", "top").alias("class_id"))
