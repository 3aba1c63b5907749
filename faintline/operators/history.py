"""Trend histories: one point a day, lifecycle, velocity, and changes of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintline.functions import scalar as S


def last(history: DataFrame, n: int) -> DataFrame:
    """The latest n points of each trend."""
    order = Window.partitionBy("trend_slug").orderBy(F.desc("recorded_at"))
    return history.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def daily(history: DataFrame, tie: str) -> DataFrame:
    """The latest point of each trend and day."""
    values = [c for c in history.columns if c != "trend_slug"]
    latest = F.max_by(F.struct(*values), F.struct("recorded_at", -F.col(tie)))
    return history.groupBy("trend_slug", F.to_date("recorded_at").alias("day")).agg(latest.alias("v")).select("trend_slug", "day", *[f"v.{c}" for c in values])


def lifecycle(points: DataFrame) -> DataFrame:
    """(trend_slug, lifecycle) from the last three daily points."""
    latest = points.withColumn("place", F.row_number().over(Window.partitionBy("trend_slug").orderBy(F.desc("day")))).filter("place <= 3")
    recent = latest.groupBy("trend_slug").agg(F.count("*").alias("n"), F.reverse(F.array_sort(F.collect_list(F.struct("day", "score")))).alias("p"))
    s3, s2, s1 = (F.get("p", i)["score"] for i in range(3))
    rules = [(F.col("n") < 3, "emerging"), ((s3 - s1) / 2 > 3, "rising"), ((s3 - s1) / 2 < -3, "declining"), ((F.abs(s3 - s2) <= 3) & (s3 >= 50), "peaking")]
    return recent.select("trend_slug", S.first_rule(rules, F.lit("emerging")).alias("lifecycle"))


def velocity(points: DataFrame) -> DataFrame:
    """Rise per day over the last five daily points, to two places."""
    five = last(points, 5)
    ends = five.groupBy("trend_slug").agg(F.count("*").alias("n"), (F.max_by("score", "day") - F.min_by("score", "day")).alias("rise"), (F.unix_micros(F.max("recorded_at").cast("timestamp")) - F.unix_micros(F.min("recorded_at").cast("timestamp"))).alias("span"))
    rate = F.floor(F.col("rise") / F.greatest(F.lit(1.0), F.col("span") / 86_400e6) * 100 + 0.5) / 100
    return ends.select("trend_slug", F.when(F.col("n") < 2, 0.0).otherwise(rate).alias("velocity"))


def changes(now: DataFrame, events: DataFrame, order: str) -> DataFrame:
    """Trends whose lifecycle differs from that of their latest event."""
    latest = events.groupBy("trend_slug").agg(F.max_by("lifecycle", order).alias("previous"))
    return now.join(latest, "trend_slug", "left").filter(~F.col("lifecycle").eqNullSafe(F.col("previous"))).select("trend_slug", "previous", "lifecycle")


def transitions(states: DataFrame, state: str, order: str) -> DataFrame:
    """Points at which a trend's state differs from the one before."""
    before = F.lag(state).over(Window.partitionBy("trend_slug").orderBy(order))
    return states.withColumn("previous", before).filter(F.col("previous") != F.col(state))
