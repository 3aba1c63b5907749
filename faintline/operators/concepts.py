"""Concepts, their graph, and the scores and velocities that come from mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintline.functions import scalar as S
from faintline.sources.storage import keep, tasks


def nodes_of(mentions: DataFrame, signals: DataFrame) -> DataFrame:
    """Per concept: mentions, first and last sight, and a map of mentions by source."""
    each = mentions.join(signals, "signal_id").groupBy("concept_id", "source").agg(F.count("*").alias("n"), F.min("collected_at").alias("first_seen"), F.max("collected_at").alias("last_seen"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n"))))
    return each.groupBy("concept_id").agg(F.sum("n").alias("mention_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), entries.alias("source_distribution"))


def merge_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added up."""
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def pairs(mentions: DataFrame) -> DataFrame:
    """(signal_id, concept_a, concept_b): concepts of one signal, the smaller first."""
    a = mentions.select("signal_id", F.col("concept_id").alias("concept_a"))
    b = mentions.select("signal_id", F.col("concept_id").alias("concept_b"))
    return a.join(b, "signal_id").filter("concept_a < concept_b")


def tasks_of_pairs(mentions: DataFrame) -> int:
    """The number of partitions for the pairs of mentions, from an exact count of those."""
    n = mentions.groupBy("signal_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    return tasks(mentions.sparkSession, int(n or 0))


def weights(pair_list: DataFrame, parts: int) -> DataFrame:
    """(concept_a, concept_b, weight): how often each pair is listed."""
    return pair_list.select("concept_a", "concept_b").repartition(parts, "concept_a", "concept_b").groupBy("concept_a", "concept_b").agg(F.count("*").alias("weight"))


def edges(snapshots: DataFrame, signals: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Per pair: weight, first and last sight, distinct signals, and weights by source (null sources left out).

    snapshots have their signal's source; where they lack it, ``signals`` gives it. With ``parts`` (``tasks_of_pairs``)
    snapshots are dealt by pair to so many tasks before any are counted: hardly a pair comes twice within a task of
    another order, where counting would hold them all.
    """
    low, high = F.least("concept_a", "concept_b").alias("concept_a"), F.greatest("concept_a", "concept_b").alias("concept_b")
    if signals is not None:
        snapshots = snapshots.join(signals.select("signal_id", "source"), "signal_id", "left")
    dealt = snapshots.select(low, high, "signal_id", "source", "created_at")
    dealt = dealt.repartition(parts, "concept_a", "concept_b") if parts else dealt
    # a signal holds a pair once or a few times: counted by signal first, distinct signals are mere rows
    once = dealt.groupBy("concept_a", "concept_b", "signal_id", "source").agg(F.count("*").alias("n"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    each = once.groupBy("concept_a", "concept_b", "source").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("s"))
    by_source = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n")))))
    # a signal has one source, so distinct signals add up over sources
    return each.groupBy("concept_a", "concept_b").agg(F.sum("n").alias("total_weight"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"), F.sum("s").alias("signal_count"), by_source.alias("source_distribution"))


def merge_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored concepts with new ones merged in: counts add up, first and last sight widen."""
    return _merged(stored, new, ["concept_id"], ["mention_count"])


def merge_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored edges with new ones merged in."""
    return _merged(stored, new, ["concept_a", "concept_b"], ["total_weight", "signal_count"])


def _merged(stored: DataFrame, new: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    values = [*counts, "first_seen", "last_seen", "source_distribution"]
    both = stored.select(*key, F.struct(*values).alias("a")).join(new.select(*key, F.struct(*values).alias("b")), key, "full_outer")
    zero = F.lit(0).cast("bigint")
    added = [(F.coalesce(f"a.{c}", zero) + F.coalesce(f"b.{c}", zero)).alias(c) for c in counts]
    ends = [F.least("a.first_seen", "b.first_seen").alias("first_seen"), F.greatest("a.last_seen", "b.last_seen").alias("last_seen")]
    maps = [F.coalesce(f"{x}.source_distribution", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))) for x in "ab"]
    return both.select(*key, *added, *ends, merge_counts(*maps).alias("source_distribution"))


def graph(edge_weights: DataFrame, least: int = 2, parts: int | None = None) -> DataFrame:
    """(u, v, w) in both directions; weights are summed first (in ``parts`` tasks), then light edges go."""
    ends = edge_weights.select(F.least("concept_a", "concept_b").alias("u"), F.greatest("concept_a", "concept_b").alias("v"), "weight")
    summed = (ends.repartition(parts, "u", "v") if parts else ends).groupBy("u", "v").agg(F.sum("weight").alias("w")).filter(F.col("w") >= least)
    return summed.unionByName(summed.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def degrees(edge_list: DataFrame, parts: int | None = None) -> DataFrame:
    """Per concept its different neighbours; with ``parts``, ends are dealt to so many tasks."""
    ends = edge_list.select(F.explode(F.array(F.struct(F.col("concept_a").alias("n"), F.col("concept_b").alias("m")), F.struct(F.col("concept_b").alias("n"), F.col("concept_a").alias("m")))).alias("e"))
    each = ends.select(F.col("e.n").alias("concept_id"), F.col("e.m").alias("m"))
    return (each.repartition(parts, "concept_id", "m") if parts else each).distinct().groupBy("concept_id").agg(F.count("m").alias("degree"))


def windows(mentions: DataFrame, signals: DataFrame, as_of: str) -> DataFrame:
    """Per concept, all window counts in one pass: at midnights for the trend, at moments for the score."""
    ts, day = F.col("collected_at"), F.date_trunc("day", S.moment(as_of))
    back = lambda d: day - F.expr(f"INTERVAL '{d}' DAY")
    count = lambda c: F.count_if(c)
    return (
        mentions.join(signals.select("signal_id", "collected_at"), "signal_id")
        .groupBy("concept_id")
        .agg(
            count(ts >= day).alias("daily"),
            count(ts >= back(7)).alias("last_7"),
            count(ts >= back(30)).alias("last_30"),
            count((ts >= back(14)) & (ts < back(7))).alias("before_7"),
            count((ts >= back(60)) & (ts < back(30))).alias("before_30"),
            count(ts >= S.days_before(as_of, 7)).alias("recent"),
            count((ts >= S.days_before(as_of, 21)) & (ts < S.days_before(as_of, 7))).alias("previous"),
        )
    )


def velocity(counts: DataFrame, earlier: DataFrame) -> DataFrame:
    """Velocities and acceleration of a day; ``earlier`` has velocity_7d of the same concepts a week before."""
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.nullif(F.col(b), F.lit(0)) - 1)
    known = counts.filter("last_30 > 0").join(earlier.select("concept_id", F.col("velocity_7d").alias("week_ago")), "concept_id", "left")
    # a concept that is new in the week has no previous week to compare with: null, and 0 where it wasn't seen either
    gain = F.when(F.col("last_7") == 0, F.when(F.col("before_7") == 0, 0.0).otherwise(-1.0)).otherwise(F.col("last_7") / F.nullif(F.col("before_7"), F.lit(0)) - 1)
    return known.select("concept_id", "daily", "last_7", "last_30", ratio("last_7", "before_7").alias("velocity_7d"), ratio("last_30", "before_30").alias("velocity_30d"), (gain - F.coalesce("week_ago", F.lit(0.0))).alias("acceleration")).withColumn("is_accelerating", F.coalesce(F.col("acceleration") > 0.5, F.lit(False)))


def scores(nodes: DataFrame, counts: DataFrame, degree: DataFrame, as_of: str) -> DataFrame:
    """The five parts of the weak-signal score, and the score."""
    joined = nodes.join(counts, "concept_id", "left").join(degree, "concept_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = joined.select(
        "concept_id",
        S.frequency_score(F.col("mention_count")).alias("frequency"),
        S.velocity_score(zero("recent"), zero("previous")).alias("velocity"),
        S.diversity_score(F.col("source_distribution")).alias("diversity"),
        S.recency_score(S.age_days(F.col("last_seen"), as_of)).alias("recency"),
        S.cooccurrence_score(zero("degree")).alias("cooccurrence"),
    )
    names = ("frequency", "velocity", "diversity", "recency", "cooccurrence")
    return parts.withColumn("weak_signal_score", S.weak_signal_score(*map(F.col, names)))


def maintained_edges(stored: DataFrame, added: DataFrame, removed: DataFrame, left: DataFrame, parts: int | None = None) -> DataFrame:
    """The edge table after snapshots were added and others removed, without counting what did not change.

    Counts and maps add up and are taken off by pair; a pair without weight goes. First and last sight can't be taken off:
    only for pairs that lose a snapshot at one of their ends they are read again, from ``left``, the snapshots after the change.
    A signal's snapshots of a pair come and go together; removing what was never added is the caller's fault.
    """
    key = ["concept_a", "concept_b"]
    more = merge_edges(stored, edges(added, parts=parts))
    less = edges(removed, parts=parts).select(*key, F.struct("total_weight", "signal_count", "first_seen", "last_seen", "source_distribution").alias("gone"))
    both = more.join(less, key, "left")
    took = lambda c: (F.col(c) - F.coalesce(f"gone.{c}", F.lit(0).cast("bigint"))).alias(c)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    taken = F.map_zip_with("source_distribution", F.coalesce("gone.source_distribution", none), lambda k, x, y: x - F.coalesce(y, F.lit(0).cast("bigint")))
    shown = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(taken, lambda k, n: n > 0)))).alias("source_distribution")
    ends = ((F.col("gone.first_seen") <= F.col("first_seen")) | (F.col("gone.last_seen") >= F.col("last_seen"))).alias("ends")
    now = keep(both.select(*key, took("total_weight"), took("signal_count"), "first_seen", "last_seen", shown, ends).filter("total_weight > 0"), "maintained")
    low, high = F.least("concept_a", "concept_b").alias("concept_a"), F.greatest("concept_a", "concept_b").alias("concept_b")
    every = left.select(low, high, "created_at")
    seen = (every.repartition(parts, *key) if parts else every).join(now.filter("ends").select(*key), key, "left_semi")
    again = seen.groupBy(*key).agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    mended = [F.coalesce("lo", "first_seen").alias("first_seen"), F.coalesce("hi", "last_seen").alias("last_seen")]
    return now.join(again, key, "left").select(*key, "total_weight", "signal_count", *mended, "source_distribution")
