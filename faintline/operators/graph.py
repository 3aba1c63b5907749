"""Connected components by alternating large-star and small-star steps, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintline.operators.joins import spread_join
from faintline.sources.storage import discard, keep


def _state(edges: DataFrame) -> tuple:
    """What stays equal when nothing changes any more."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour (large: the greater ones; else the smaller ones and the node) to the least of the neighbourhood."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    seen = both if large else both.filter("v < u")
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n_rows"))
    joined = spread_join(seen, least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that has an edge and isn't the least of its component, with that least node.

    edges: (u, v), two numbers. Each step of a round is written to the shared folder, for its plan names its input several
    times; the number of rounds grows with the logarithm of the component's diameter, and nothing but a checksum reaches the driver.
    """
    now = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before, last = state, now
        half = keep(_star(last, True), "stars")
        now = keep(_star(half, False), "edges")
        discard(last, half)
    return now
