"""Operators known by their specification alone: propagation, convergence, hypotheses, failed trends, launch matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintline.functions import scalar as S
from faintline.operators.joins import salted_join, spread_join


def propagation(mentions: DataFrame, signals: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Concepts that reached two sources or more within the last days; the kind follows from their number."""
    recent = mentions.join(signals, "signal_id").filter(F.col("collected_at") >= S.days_before(as_of, days))
    spread = recent.groupBy("concept_id").agg(F.countDistinct("source").alias("sources"), F.min("collected_at").alias("first_seen")).filter("sources >= 2")
    return spread.withColumn("kind", S.first_rule([(F.col("sources") == 2, "dual_source"), (F.col("sources") == 3, "cross_platform")], F.lit("multi_source")))


def convergence(diversity, velocity, propagated, edges):
    """0 to 100, each part taken as a share of 100: 0.30, 0.25, 0.25 and 0.20; in decimals, so that halves round up."""
    part = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c)).cast("decimal(20,6)")
    hundredths = 30 * part(diversity) + 25 * part(velocity) + 25 * part(propagated) + 20 * part(edges)
    return F.floor((hundredths + 50) * F.lit("0.01").cast("decimal(3,2)")).cast("bigint")


def hypotheses(members: DataFrame) -> DataFrame:
    """Per group of members (group, velocity, kind, size): confidence, window and size of the market."""
    each = members.groupBy("group").agg(F.avg("velocity").alias("v"), F.countDistinct("kind").alias("k"), F.sum("size").alias("market_size"))
    return each.select("group", S.js_round(F.least(F.lit(100.0), F.col("v") + F.col("k"))).alias("confidence"), S.window_estimate(F.col("v")).alias("window"), "market_size")


def failed_trends(history: DataFrame, as_of: str, least_peak: int = 40, idle: int = 30) -> DataFrame:
    """Trends with a worthy peak that have been idle, or whose last point lies under half of the one before."""
    order = Window.partitionBy("trend_slug").orderBy(F.desc("recorded_at"))
    ranked = history.withColumn("r", F.row_number().over(order))
    each = ranked.groupBy("trend_slug").agg(
        F.max("score").alias("peak_score"), F.max_by("recorded_at", F.struct("score", -F.unix_micros(F.col("recorded_at").cast("timestamp")))).alias("peak_at"), F.max("recorded_at").alias("last_at"),
        F.max(F.when(F.col("r") == 1, F.col("score"))).alias("last"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("before"),
    )
    fell = F.coalesce(F.col("last") / F.nullif(F.col("before"), F.lit(0)) - 1 < -0.5, F.lit(False))
    idle_ = F.col("last_at") < S.days_before(as_of, idle)
    return each.filter((F.col("peak_score") >= least_peak) & (fell | idle_)).select("trend_slug", "peak_score", "peak_at", F.when(idle_, "inactive").otherwise("velocity").alias("reason"))


def launches(concepts: DataFrame, products: DataFrame, least: float = 0.5, share: int = 10_000) -> DataFrame:
    """Products whose title shares enough words with a concept seen before, and the days between.

    A product that has ``least`` of a concept's m words has one of any m - ceil(least * m) + 1 of them; they meet by the
    ones fewest products have, and the pairs of a word that many have are dealt to many tasks.
    """
    words = lambda c: F.array_distinct(S.concept_tokens(c))
    c = concepts.select("concept_id", "first_seen", words(F.col("concept")).alias("ws"))
    p = products.select("product_id", "launched", words(F.col("title")).alias("ps"))
    by_word = p.select(F.col("product_id"), F.explode("ps").alias("w"))
    each = c.select("concept_id", F.size("ws").alias("m"), F.explode("ws").alias("w"))
    held = by_word.groupBy("w").agg(F.count("*").alias("held"))
    ranked = spread_join(each, each.groupBy("w").agg(F.count("*").alias("n_rows")).join(held, "w", "left"), "w")
    place = F.row_number().over(Window.partitionBy("concept_id").orderBy(F.coalesce("held", F.lit(0)), "w"))
    some = ranked.withColumn("place", place).filter(F.col("place") <= F.col("m") - F.ceil(F.col("m") * least) + 1)
    met = salted_join(some.select("concept_id", "w"), by_word, "w", share).select("concept_id", "product_id").distinct()
    hits = met.join(c, "concept_id").join(p, "product_id").filter(F.size(F.array_intersect("ws", "ps")) / F.size("ws") >= least)
    days = F.floor((F.unix_micros(F.col("launched").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 86_400e6)
    return hits.select("concept_id", "product_id", days.alias("lead_time_days"))
