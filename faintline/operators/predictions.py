"""Opportunities and the life of predictions: draft, pending, confirmed, partially confirmed or failed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintline.functions import scalar as S
from faintline.operators import signals
from faintline.operators.joins import spread_join
from faintline.sources.storage import keep

OUTCOMES = ("confirmed", "partially_confirmed", "failed")
SIMILAR = 0.55


def unpredicted(opportunities: DataFrame, predictions: DataFrame) -> DataFrame:
    return opportunities.join(predictions.select(F.col("opportunity_id").alias("id")), "id", "left_anti")


def enriched(predictions: DataFrame, opportunities: DataFrame) -> DataFrame:
    """predictions with their opportunity as a struct, null where it is gone."""
    of = opportunities.select(F.col("id").alias("opportunity_id"), F.struct(*opportunities.columns).alias("opportunity"))
    return predictions.join(of, "opportunity_id", "left")


def where(predictions: DataFrame, published: bool | None = None, status: str | None = None) -> DataFrame:
    """Those that meet every condition given."""
    tests = [F.col("is_published") == published] * (published is not None) + [F.col("status") == status] * (status is not None)
    return predictions.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def draft(opportunities: DataFrame, predictions: DataFrame, as_of: str, least: int = 70, signals_least: int = 5) -> DataFrame:
    """New drafts for strong opportunities that have no prediction yet."""
    fit = opportunities.filter((F.col("confidence") >= least) & (F.col("n_signals") >= signals_least))
    return unpredicted(fit, predictions).select(F.col("id").alias("opportunity_id"), F.lit("draft").alias("status"), F.lit(False).alias("is_published"), F.col("confidence").alias("draft_score"), F.col("n_signals").alias("draft_signal_count"), S.moment(as_of).alias("drafted_at"))


def _with_opportunity(predictions: DataFrame, opportunities: DataFrame) -> DataFrame:
    of = opportunities.select(F.col("id").alias("opportunity_id"), F.col("confidence").alias("__score"), F.col("n_signals").alias("__n"))
    return predictions.join(of, "opportunity_id", "left")


def promote(predictions: DataFrame, opportunities: DataFrame, as_of: str) -> DataFrame:
    """Drafts of more than 72 hours whose opportunity still stands become pending and published."""
    due = (F.col("status") == "draft") & ~F.col("is_published") & (F.col("drafted_at") < S.days_before(as_of, 3)) & (F.col("__score") >= 60) & (F.col("__n") >= F.col("draft_signal_count"))
    now = F.coalesce(due, F.lit(False))
    return _with_opportunity(predictions, opportunities).withColumns({"status": F.when(now, "pending").otherwise(F.col("status")), "is_published": F.col("is_published") | now}).select(*predictions.columns)


def promote_or_expire(predictions: DataFrame, opportunities: DataFrame, as_of: str) -> DataFrame:
    """After 72 hours: pending where the opportunity stands, failed where its score fell below 60, else unchanged."""
    due = F.col("drafted_at") < S.days_before(as_of, 3)
    stands = due & (F.col("__score") >= 60) & (F.col("__n") >= F.col("draft_signal_count"))
    status = F.when(stands, "pending").when(due & (F.col("__score") < 60), "failed").otherwise(F.col("status"))
    return _with_opportunity(predictions, opportunities).withColumn("status", status).select(*predictions.columns)


def verify(predictions: DataFrame, which: Column, outcome: str) -> DataFrame:
    if outcome not in OUTCOMES:
        raise ValueError(f"{outcome} is no outcome")
    return predictions.withColumn("status", F.when(which & F.col("is_published"), outcome).otherwise(F.col("status")))


def publish(predictions: DataFrame, which: Column, as_of: str) -> DataFrame:
    """Drafts that are chosen become pending and published, from ``as_of`` on."""
    now = which & (F.col("status") == "draft")
    return predictions.withColumns({"is_published": F.col("is_published") | F.coalesce(now, F.lit(False)), "drafted_at": F.when(now, S.moment(as_of)).otherwise(F.col("drafted_at")), "status": F.when(now, "pending").otherwise(F.col("status"))})


def discard(predictions: DataFrame, which: Column) -> DataFrame:
    """Chosen predictions go, but only while they are drafts."""
    return predictions.filter(~F.coalesce(which & (F.col("status") == "draft"), F.lit(False)))


def delete(predictions: DataFrame, which: Column) -> DataFrame:
    """Chosen predictions go, whatever their status."""
    return predictions.filter(~F.coalesce(which, F.lit(False)))


def page(df: DataFrame, order: list, cap: int | None, number: int, size: int = 10) -> DataFrame:
    """One page of the first ``cap`` rows, with each row's place, the total and the number of pages."""
    top = df.orderBy(*order).limit(cap) if cap is not None else df
    total = top.agg(F.count("*").alias("total"))
    # a page needs the rows up to its end alone: they, not all rows, are numbered
    head = top.orderBy(*order).limit(number * size).withColumn("n", F.row_number().over(Window.orderBy(*order)))
    counted = head.join(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))
    return counted.filter(F.col("n") > (number - 1) * size)


def word_classes(df: DataFrame, text: Column, ident: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by their word sets: ((id, sid), (sid, cid, weight), (cid, core, u, weight, mutual)).

    Equal sets are one. A word that one set alone has is never shared, so only the number u of such words counts: sets with
    the same core of other words and the same u are one class, whose sets resemble all others alike, and each other if
    ``mutual``. Rows without words have no set.
    """
    words = df.select(F.col(ident).alias("id"), F.sort_array(S.dedupe_tokens(text)).alias("w")).filter(F.size("w") > 0).withColumn("sid", F.xxhash64("w"))
    sets = keep(words.groupBy("sid").agg(F.first("w").alias("w"), F.count("*").alias("weight")), "word-sets")
    each = sets.select("sid", F.explode("w").alias("k"))
    held = spread_join(each, each.groupBy("k").agg(F.count("*").alias("n_rows"), F.count("*").alias("df")), "k").filter("df > 1")
    core = held.groupBy("sid").agg(F.sort_array(F.collect_list("k")).alias("core"))  # no longer than one text's words
    cored = sets.join(core, "sid", "left").withColumn("core", F.coalesce("core", F.array().cast("array<string>")))
    of = keep(cored.withColumn("u", F.size("w") - F.size("core")).select("sid", F.xxhash64("core", "u").alias("cid"), "weight", "core", "u"), "word-cores")
    mutual = F.size("core") / (F.size("core") + 2 * F.col("u")) >= SIMILAR
    classes = of.groupBy("cid").agg(F.first("core").alias("core"), F.first("u").alias("u"), F.sum("weight").alias("weight")).withColumn("mutual", mutual)
    return words.select("id", "sid"), of.select("sid", "cid", "weight"), classes


def similar(classes: DataFrame) -> DataFrame:
    """(a, b, jaccard): pairs of different classes, both ways round, that reach the threshold, found by the words they share."""
    # a pair at the threshold shares a word among the first of each, in one order of words: the rarest first, those of one set before all
    each = classes.select("cid", "u", (F.size("core") + F.col("u")).alias("n"), F.explode("core").alias("k"))
    rare = each.groupBy("k").agg(F.count("*").alias("n_rows"), F.count("*").alias("df"))
    ranked = spread_join(each, rare, "k").withColumn("place", F.col("u") + F.row_number().over(Window.partitionBy("cid").orderBy("df", "k")))
    first = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * SIMILAR) + 1)
    a, b = first.select("k", F.col("cid").alias("a"), F.col("n").alias("m")), first.select("k", F.col("cid").alias("b"), "n")
    found = a.join(b, "k").filter((F.col("a") < F.col("b")) & (F.least("m", "n") >= SIMILAR * F.greatest("m", "n"))).select("a", "b").distinct()
    side = lambda c, x: classes.select(F.col("cid").alias(c), F.col("core").alias(x), F.col("u").alias(f"{x}u"))
    both = found.join(side("a", "x"), "a").join(side("b", "y"), "b")
    jaccard = F.size(F.array_intersect("x", "y")) / (F.size(F.array_union("x", "y")) + F.col("xu") + F.col("yu"))
    half = keep(both.withColumn("j", jaccard).filter(F.col("j") >= SIMILAR).select("a", "b", F.round("j", 6).alias("jaccard")), "alike")
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))


def similar_counts(df: DataFrame, text: Column, ident: str = "id") -> DataFrame:
    """(id, n_links): how many other rows have word sets that reach the threshold; rows without any are left out. No pair of rows is made."""
    rows, of, classes = word_classes(df, text, ident)
    near = similar(classes).join(classes.select(F.col("cid").alias("b"), "weight"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("weight").alias("near"))
    total = classes.join(near, "cid", "left").select("cid", F.col("weight").alias("n_rows"), F.col("weight").alias("all"), "mutual", F.coalesce("near", F.lit(0)).alias("near"))
    links = F.col("near") + F.when(F.col("mutual"), F.col("all")).otherwise(F.col("weight")) - 1
    counted = spread_join(of, total, "cid").select("sid", F.col("weight").alias("n_rows"), links.cast("bigint").alias("n_links"))
    return spread_join(rows, counted, "sid").select("id", "n_links").filter("n_links > 0")


def dedupe(df: DataFrame, text: Column, order: str, ident: str = "id") -> DataFrame:
    """In order, a row is dropped if it resembles one that was kept.

    Of rows that resemble all others alike and each other (equal sets, mutual classes) only the first can be kept, and is
    what the others are compared by. Rows without words resemble none.
    """
    rows, of, classes = word_classes(df, text, ident)
    node = of.join(classes.select("cid", "mutual"), "cid").select("sid", "cid", F.when(F.col("mutual"), F.col("cid")).otherwise(F.col("sid")).alias("node"), F.col("weight").alias("n_rows"))
    placed = spread_join(rows.join(df.select(F.col(ident).alias("id"), F.col(order).alias("o")), "id"), node, "sid")
    firsts = keep(placed.groupBy("node").agg(F.min(F.struct("o", "id")).alias("first"), F.first("cid").alias("cid")).select("node", "cid", F.col("first.o").alias("o"), F.col("first.id").alias("id")), "firsts")
    end = lambda c, n: firsts.select(F.col("cid").alias(c), F.col("id").alias(n))
    pairs = similar(classes).join(end("a", "seed"), "a").join(end("b", "other"), "b").select("seed", "other")
    led = signals.leaders(firsts, pairs, "o").filter("id = leader").select(F.col("id").alias(ident))
    wordless = df.select(F.col(ident).alias("id")).join(rows.select("id"), "id", "left_anti").select(F.col("id").alias(ident))
    return df.join(led.unionByName(wordless), ident, "left_semi")
