"""Variable-capacity best-fit packing.

Sequences go into bins of several permitted lengths. Texts longer than the largest length are cut into pieces of
that length and a rest. The pieces are dealt to shards by a hash (equal rows by their number as well), so that no task holds
much more than its share; each shard is packed on its own, and the cheaper of two packings is taken:

* jointly: the longest piece left opens a bin. Every length that holds it is filled on trial from the pieces left,
  longest first, and downsized to the smallest length that holds the fill; the trial of least cost per token becomes
  the bin;
* best fit: longest first, each piece goes to the open bin with the least room that still holds it, else to a new
  bin of the smallest length that holds it; at the end each bin is downsized.

A bin of length n costs n + attention * n * n / largest, so short bins are cheaper per token, and long ones pay where
they take several pieces. Shards follow from the number of pieces (about ``per_shard`` each), never from the
cluster, so the result is the same on any; only which of several equal rows goes to which shard follows from the files.

Defined results: null and empty texts have length ``end_tokens`` (the end mark alone); rows with equal ids stay
rows of their own; an empty table gives no rows; every token of every text lies in exactly one bin.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintline.llm.common import keep, spread_join

LENGTHS = (2048, 4096, 8192, 16384)
_OUT = "doc_id bigint, piece int, piece_start bigint, n_tokens bigint, shard bigint, bin bigint, bin_capacity bigint, bin_offset bigint"


def byte_tokens(text: Column, end_tokens: int = 1) -> Column:
    """Length under a byte-level vocabulary, with the end mark."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + end_tokens).cast("bigint")


def cost(length: int, largest: int, attention: float) -> float:
    return length + attention * length * length / largest


def pack_jointly(sizes: np.ndarray, lengths: tuple[int, ...], attention: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, capacity, offset) of each piece; sizes in descending order, none over the largest length."""
    lengths = tuple(sorted(lengths))
    price = {n: cost(n, lengths[-1], attention) for n in lengths}
    found, first, counts = np.unique(-sizes, return_index=True, return_counts=True)
    values = (-found)[::-1].tolist()  # distinct sizes, ascending
    place, left = first[::-1].tolist(), counts[::-1].tolist()  # of each its next piece, and how many are left
    lower = list(range(len(values)))  # of each the next smaller one that may still have pieces

    def last(j: int) -> int:
        """The largest size up to the j-th that has pieces left; -1 if none."""
        seen = []
        while j >= 0 and not left[j]:
            seen.append(j)
            j = lower[j] if lower[j] != j else j - 1
        for x in seen:
            lower[x] = j
        return j

    def trial(n: int) -> tuple[int, list[tuple[int, int]]]:
        room, picks, j = n, [], last(bisect.bisect_right(values, n) - 1)
        while j >= 0:
            k = min(left[j], room // values[j])
            picks.append((j, k))
            room -= k * values[j]
            j = last(min(j, bisect.bisect_right(values, room)) - 1)
        return n - room, picks

    bins, capacity, offsets = (np.empty(len(sizes), np.int64) for _ in range(3))
    b = 0
    while (top := last(len(values) - 1)) >= 0:
        best = None
        for n in reversed(lengths[bisect.bisect_left(lengths, values[top]) :]):
            fill, picks = trial(n)
            small = lengths[bisect.bisect_left(lengths, fill)]
            if best is None or price[small] / fill < best[0]:
                best = price[small] / fill, small, picks
        at = 0
        for j, k in best[2]:
            rows = slice(place[j], place[j] + k)
            bins[rows], capacity[rows], offsets[rows] = b, best[1], at + values[j] * np.arange(k)
            at, place[j], left[j] = at + k * values[j], place[j] + k, left[j] - k
        b += 1
    return bins, capacity, offsets


def total_cost(bins: np.ndarray, capacity: np.ndarray, largest: int, attention: float) -> float:
    _, first = np.unique(bins, return_index=True)
    return float(sum(cost(n, largest, attention) for n in capacity[first].tolist()))


def pack_best(sizes: np.ndarray, lengths: tuple[int, ...], attention: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cheaper of both packings; of equals the joint one."""
    return min((f(sizes, lengths, attention) for f in (pack_jointly, pack_shard)), key=lambda x: total_cost(x[0], x[1], max(lengths), attention))


def pack_shard(sizes: np.ndarray, lengths: tuple[int, ...], attention: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, capacity, offset) of each piece; sizes in descending order, none over the largest length."""
    lengths = tuple(sorted(lengths))
    total = np.cumsum(sizes[::-1])[::-1]  # tokens still to be placed, from each piece on
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    used: list[int] = []
    capacity: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = bisect.bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            # by the most a bin could hold, which always opens the smallest that fits
            fit = [n for n in lengths if n >= size]
            n = min(fit, key=lambda n: (cost(n, lengths[-1], attention) / min(n, int(total[i])), n))
            b, room = len(used), n
            used.append(0)
            capacity.append(n)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room > size:
            bisect.insort(rooms, (room - size, b))
    final = np.array([lengths[bisect.bisect_left(lengths, u)] for u in used], np.int64)
    return bins, final[bins] if len(sizes) else bins, offsets


def pack(df: DataFrame, size: Column | None = None, ident: str = "doc_id", lengths: tuple[int, ...] = LENGTHS, attention: float = 0.25, per_shard: int = 20_000) -> DataFrame:
    """One row per piece: where in its text it starts, and its bin, the bin's final length and its place in it."""
    size = byte_tokens(F.col("text")) if size is None else size
    largest = max(lengths)
    sized = keep(df.select(F.col(ident).cast("bigint").alias("doc_id"), size.alias("n")), "sizes")
    whole = F.floor((F.col("n") - 1) / largest) + 1
    n_shards = max(1, -(-(sized.filter("n > 0").agg(F.sum(whole)).first()[0] or 0) // per_shard))
    # rows of one id and length are told apart by their number in the written table; they are alike in all that is packed
    numbered = sized.filter("n > 0").withColumns({"row": F.monotonically_increasing_id(), "like": F.xxhash64("doc_id", "n")})
    likes = numbered.groupBy("like").agg(F.count("*").alias("n_rows"), F.count("*").alias("copies")).filter("n_rows > 1")
    apart = spread_join(numbered, likes, "like").withColumn("row", F.when(F.col("copies").isNotNull(), F.col("row")))
    cut = apart.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece"))
    start = (F.col("piece") * F.lit(largest)).cast("bigint")
    rows = cut.select("doc_id", "piece", "row", start.alias("piece_start"), F.least(F.lit(largest), F.col("n") - start).cast("bigint").alias("n_tokens"))
    # pieces of one text are dealt apart too: a very long text is no burden to one shard
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "row"), F.lit(n_shards))).drop("row")

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], na_position="last", kind="stable")
        bins, capacity, offsets = pack_best(part["n_tokens"].to_numpy(), lengths, attention)
        return part.assign(bin=bins, bin_capacity=capacity, bin_offset=offsets)

    return rows.groupBy("shard").applyInPandas(packed, _OUT)


def bins(packed: DataFrame) -> DataFrame:
    """One row per bin: its final length, contents and cost."""
    return packed.groupBy("shard", "bin", "bin_capacity").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))

