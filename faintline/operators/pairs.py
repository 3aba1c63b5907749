"""Edit distances of every two rows of a group, in units of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintline.operators.joins import spread_join
from faintline.operators.titles import distances

#: Rows of a part of a group, texts compared at once, pairs to a task.
_SHARE, _BLOCK, _PAIRS = 1024, 256, 4_000_000


def _far(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), len(texts)), np.int64)
    for i in range(0, len(texts), _BLOCK):
        for j in range(i, len(texts), _BLOCK):
            some = distances(texts[i : i + _BLOCK], texts[j : j + _BLOCK])
            out[i : i + _BLOCK, j : j + _BLOCK] = some
            out[j : j + _BLOCK, i : i + _BLOCK] = some.T
    return out


def _unit(p: int, q: int, rows: list[tuple]) -> pa.RecordBatch:
    """All pairs of part p with part q: distances of different texts are computed once."""
    part, ids, text = zip(*rows, strict=True)
    part, ids = np.array(part), np.array(ids, np.int64)
    known = sorted({t for t in text if t is not None})
    number = {t: i for i, t in enumerate(known)} | {None: -1}
    name = np.array([number[t] for t in text])
    x, y = np.triu_indices(len(ids), 1) if p == q else (i.ravel() for i in np.meshgrid(np.flatnonzero(part == p), np.flatnonzero(part == q), indexing="ij"))
    x, y = (i[ids[x] != ids[y]] for i in (x, y))
    missing = (name[x] < 0) | (name[y] < 0)
    far, size = _far(known) if known else np.zeros((1, 1), np.int64), np.array([len(t) for t in known] or [0], np.int64)
    columns = [pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])), pa.array(far[name[x], name[y]], mask=missing), pa.array(np.maximum(size[name[x]], size[name[y]]), mask=missing)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "distance", "longest"])


def edit_distances(rows: DataFrame, key: list[str], ident: str, text: Column) -> DataFrame:
    """(a, b, distance, longest) of every two rows that agree in ``key``, a < b: edit distance and the greater length, null where a text is.

    Groups are cut into parts of about ``_SHARE`` rows and every two parts meet in a unit of their own, so neither a group's
    size nor the number of its pairs reaches one task. Rows without a key or an id have no pairs.
    """
    each = rows.dropna(subset=[*key, ident]).select(F.struct(*key).alias("group"), F.col(ident).cast("bigint").alias("id"), text.alias("text"))
    size = each.groupBy("group").agg(F.count("*").alias("n_rows"), F.ceil(F.count("*") / _SHARE).cast("int").alias("parts"))
    pairs = size.agg(F.sum(F.col("n_rows") * F.col("n_rows") / 2)).first()[0] or 0
    placed = spread_join(each, size, "group").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = met.select("group", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for group, p, q, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, p, q) != now and held:
                    yield _unit(*now[1:], held)
                    held = []
                now = (group, p, q)
                held.append(tuple(row))
        if held:
            yield _unit(*now[1:], held)

    return units.repartition(int(pairs // _PAIRS) + rows.sparkSession.sparkContext.defaultParallelism, "group", "p", "q").sortWithinPartitions("group", "p", "q").mapInArrow(run, "a bigint, b bigint, distance bigint, longest bigint")
