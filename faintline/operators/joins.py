"""A join on a key that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HOT = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left, with right's columns where its unique ``key`` matches; right has the number of left's rows as ``n_rows``.

    The _HOT most frequent keys (that many rows at most) are broadcast; all others, none of which can hold
    more than one row in _HOT, are joined by a shuffle, and the rows already served are spread evenly in it.
    """
    wide = [c for c in right.columns if c not in (key, "n_rows")]
    hot = right.orderBy(F.desc("n_rows"), key).limit(_HOT).select(F.col(key).alias("__hot"), F.struct(*wide).alias("__served"))
    served = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    apart = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(1 << 40)) + 1
    keyed = served.withColumn("__apart", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(apart))
    rest = right.select(key, F.struct(*wide).alias("__rest"), F.lit(0).cast("bigint").alias("__apart"))
    return keyed.join(rest, [key, "__apart"], "left").select(*[left[c] for c in left.columns], *[F.coalesce(f"__served.{c}", f"__rest.{c}").alias(c) for c in wide])


def salted_join(left: DataFrame, right: DataFrame, key: str, share: int = 10_000) -> DataFrame:
    """The inner join of two tables on a key that neither has once: a key's pairs are dealt to about one task per ``share`` rows of each side.

    Each side is cut into pieces by a hash of its rows, and every piece of one meets every piece of the other in a task
    of its own. Keys that one side lacks are left out first.
    """
    size = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = size(left, "__l").join(size(right, "__r"), key).select(key, "__l", "__r", F.ceil(F.col("__l") / share).cast("int").alias("__a"), F.ceil(F.col("__r") / share).cast("int").alias("__b"))
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cut = lambda df, n: spread_join(df, both.withColumn("n_rows", F.col(n)), key).filter("__a IS NOT NULL")
    a = cut(left, "__l").withColumn("__x", part(left, "__a")).withColumn("__y", each("__b")).select(*left.columns, "__x", "__y")
    b = cut(right, "__r").withColumn("__y", part(right, "__b")).withColumn("__x", each("__a")).select(*right.columns, "__x", "__y")
    return a.join(b, [key, "__x", "__y"]).drop("__x", "__y")
