"""What leaves the pipeline: appended history, reports, digests and a log line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from faintline.functions import scalar as S


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def report_rows(opportunities: DataFrame) -> DataFrame:
    """An HTML row per opportunity, in order of place."""
    e = S.html_escape
    cell = lambda c: F.concat(F.lit("<td>"), e(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    return opportunities.select("place", F.concat(F.lit("<tr>"), cell("title"), cell("category"), cell("confidence"), F.lit("</tr>")).alias("html"))


def report(opportunities: DataFrame, chosen: list[int]) -> DataFrame:
    """One HTML table of 1 to 20 chosen places."""
    if not 1 <= len(chosen) <= 20:
        raise ValueError("a report holds 1 to 20 opportunities")
    rows = report_rows(opportunities.filter(F.col("place").isin(chosen)))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "html"))), lambda r: r["html"]), "")
    return rows.agg(F.concat(F.lit("<table>"), listed, F.lit("</table>")).alias("html"))


def digest(opportunities: DataFrame, changes: DataFrame, subscribers: DataFrame, as_of: str, days: int = 7, top: int = 5) -> DataFrame:
    """(email, subject, body): one text for all confirmed subscribers of everything, with the best opportunities and every change of the last days that nobody was told of, newest first.

    opportunities: id, title, description, score, lifecycle. changes: trend_slug, previous, lifecycle, changed_at, notified.
    subscribers: email, trend_slug, confirmed. A mail holds its whole text, so the changes of a week are gathered in one row.
    """
    best = opportunities.orderBy(F.desc("score"), "id").limit(top)
    told = F.concat(F.lit(". "), "title", F.lit("\n"), "description", F.lit("\nScore: "), F.col("score").cast("string"), F.lit(" | Lifecycle: "), F.coalesce("lifecycle", F.lit("Unknown")))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", told.alias("told"))))
    first = best.agg(F.array_join(F.transform(listed, lambda e, i: F.concat((i + 1).cast("string"), e["told"])), "\n\n").alias("first"))
    moved = F.concat("trend_slug", F.lit(": "), F.coalesce("previous", F.lit("New")), F.lit(" to "), "lifecycle")
    newest = F.sort_array(F.collect_list(F.struct((-F.unix_micros(F.col("changed_at").cast("timestamp"))).alias("t"), "trend_slug", moved.alias("told"))))
    then = unseen(changes, as_of, days).agg(F.array_join(F.transform(newest, lambda e: e["told"]), "\n").alias("then"))
    part = lambda c, empty: F.when(F.col(c) == "", empty).otherwise(F.col(c))
    body = F.concat(F.lit("Top opportunities\n\n"), part("first", "No new opportunities this week."), F.lit("\n\nLifecycle changes\n\n"), part("then", "No lifecycle changes this week."))
    mail = first.join(F.broadcast(then)).select(F.lit("Your week in trends").alias("subject"), body.alias("body"))
    return subscribers.filter("confirmed AND trend_slug IS NULL").select("email").join(F.broadcast(mail))


def unseen(changes: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return changes.filter((F.col("changed_at") >= S.days_before(as_of, days)) & ~F.col("notified"))


def due(changes: DataFrame, subscriptions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per subscription (email, trend_slug; null slug: all trends) the changes of the last days that it wasn't told of.

    changes: trend_slug, lifecycle, changed_at, notified. Subscribers of all trends meet the recent changes, which are
    few, by a broadcast; all others by the slug.
    """
    recent = unseen(changes, as_of, days)
    one = subscriptions.filter("trend_slug IS NOT NULL").join(recent, "trend_slug")
    every = subscriptions.filter("trend_slug IS NULL").drop("trend_slug").join(recent)
    return one.unionByName(every)


def notified(changes: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """changes, with those that ``due`` has mailed marked."""
    return changes.withColumn("notified", F.col("notified") | (F.col("changed_at") >= S.days_before(as_of, days)))


#: The labels of opportunities.
LABELS = ("Emerging", "High", "Noise", "Watch")


def logged(scored: DataFrame, path: str) -> str:
    """Append scored rows (score, label) to a table and give the run's log line: how many, their score range, and how many bear each label.

    The figures are observed on the write itself, so no row is read or computed twice for them.
    """
    seen = Observation("signals")
    each = [F.count_if(F.col("label") == x).alias(x) for x in LABELS]
    append(scored.observe(seen, F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), *each), path)
    found = seen.get
    labels = {x: found[x] for x in LABELS if found[x]}
    return json.dumps({"signals_in": found["n"], "score_range": [found["lo"], found["hi"]], "labels": labels}, separators=(",", ":"))
