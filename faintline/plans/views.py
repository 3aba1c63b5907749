"""The domain's relations over the test tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintline.sources.storage import table, tasks

AS_OF = "2024-01-31 00:00:00"  # for relations over events
AS_OF_ORDERS = "2001-06-01 00:00:00"

TITLES = (
    "Ask HN: Is there a SaaS for small team billing?",
    "Show HN: I built this because nothing existed for API monitoring",
    "Tired of slow dashboards and expensive analytics tools",
    "Looking for a tool to automate compliance reports, any tool works",
    "Why is deploying Kubernetes so hard | a rant about devops",
    "We are paying Stripe $49/mo and it still fails",
    "Hiring senior data engineer for remote team",
    "Launch HN: Open source workflow automation platform",
    "So I built my script to sync customer data",
    "Does anyone know how to reduce cloud cost and latency",
    "Docker container security audit: permission and access control",
    "Someone should build a mobile app for async collaboration",
    "Machine learning model for search and query index",
    "AI agents keep failing in production, need debug logs",
    "Vendor lock-in made us switching from the old CRM",
    "Prompt caching for LLM inference on edge serverless runtime",
    "A short one",
    "Frustrating onboarding wizard and signup flow",
    "Storage upload to CDN: file limits too complex",
    "Email alert inbox zero for founders",
    "The quick brown fox jumps over the lazy dog",
    "Best tool for scheduling tasks and calendar sync.",
    "GraphQL webhook gateway with OAuth token vault",
    "Startup growth marketing ideas for B2B revenue",
    "Simple no-code product analytics with real-time insight",
    "Would love a privacy first password manager",
    "How to learn SQL: beginner course and tutorial",
    "Sandbox for testing AI prompts - safehouse edition",
    "Nobody solves invoice matching for finance ops teams",
    "Observability pipeline with distributed tracing & metrics",
)
SOURCES = ("reddit", "hackernews", "producthunt", "github")


def _pick(values, c):
    return F.get(F.array(*map(F.lit, values)), c.cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def titles(spark: SparkSession, d: str) -> DataFrame:
    """id, title, source, engagement, score, created_at, keywords: signals made from events."""
    e = table(spark, d, "events")
    n = len(TITLES)
    k = F.col("event_id")
    words = F.array(F.lower(F.get(F.split("title", " "), 1)), F.lower(F.get(F.split("title", " "), 0)), F.col("source"))
    return e.select(
        k.alias("id"),
        F.concat(_pick(TITLES, k % n), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), k.cast("string")))).alias("title"),
        _pick(SOURCES, k % 4).alias("source"),
        F.floor(F.abs("value") * 3).cast("double").alias("engagement"),
        F.floor(F.abs("value")).cast("double").alias("score"),
        F.col("ts").alias("created_at"),
    ).withColumn("keywords", words)


TITLES_SQL = f"""titles AS (
  SELECT *, [lower(string_split(title, ' ')[2]), lower(string_split(title, ' ')[1]), source] AS keywords FROM (
    SELECT event_id AS id, {sql_list(TITLES)}[1 + CAST(event_id % {len(TITLES)} AS INT)] || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || event_id END AS title,
           {sql_list(SOURCES)}[1 + CAST(event_id % 4 AS INT)] AS source, CAST(floor(abs(value) * 3) AS DOUBLE) AS engagement,
           CAST(floor(abs(value)) AS DOUBLE) AS score, ts AS created_at FROM events))"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Dealt by signal, so that a task holds no more of them when the table grows."""
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_orderkey").alias("signal_id"), F.col("l_partkey").alias("concept_id")).repartition(tasks(spark, lines.count()), "signal_id").distinct()


MENTIONS_SQL = "mentions AS (SELECT DISTINCT l_orderkey AS signal_id, l_partkey AS concept_id FROM lineitem)"


def signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("signal_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("collected_at"), F.col("o_totalprice").alias("score"))


SIGNALS_SQL = "signals AS (SELECT o_orderkey AS signal_id, o_orderpriority AS source, o_orderdate AS collected_at, o_totalprice AS score FROM orders)"


def event_mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("signal_id"), F.col("user_id").alias("concept_id"))


def event_signals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("signal_id"), F.col("event_type").alias("source"), F.col("ts").alias("collected_at"), F.col("value").alias("score"))


EVENTS_SQL = "ev AS (SELECT event_id AS signal_id, user_id AS concept_id, event_type AS source, ts AS collected_at, value AS score FROM events)"


def history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    slug = F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % 20).cast("string"))
    return e.groupBy(slug.alias("trend_slug"), F.to_date("ts").alias("day")).agg(F.floor(F.avg("value") + 0.5).cast("bigint").alias("score"), F.count("*").alias("signal_count"), F.max("ts").alias("recorded_at"))


HISTORY_SQL = """history AS (SELECT event_type || '-' || (user_id % 20) AS trend_slug, CAST(ts AS DATE) AS day, CAST(floor(avg(value) + 0.5) AS BIGINT) AS score,
  count(*) AS signal_count, max(ts) AS recorded_at FROM events GROUP BY 1, 2)"""


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Trend "), F.col("c_mktsegment"), F.lit(" "), F.col("c_custkey").cast("string")).alias("title"), F.pmod(F.floor(F.col("c_acctbal")), F.lit(101)).cast("bigint").alias("confidence"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("cluster_id"))


OPPORTUNITIES_SQL = "opportunities AS (SELECT c_custkey AS id, 'Trend ' || c_mktsegment || ' ' || c_custkey AS title, CAST(((floor(c_acctbal) % 101) + 101) % 101 AS BIGINT) AS confidence, c_mktsegment AS category, c_nationkey AS cluster_id FROM customer)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    # every third opportunity has no prediction of its own: its neighbour has those
    predicted = F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "pending").otherwise("draft")
    return o.select(F.col("o_orderkey").alias("id"), predicted.alias("opportunity_id"), status.alias("status"), (F.col("o_orderstatus") != "P").alias("is_published"), F.col("o_orderdate").alias("drafted_at"), F.pmod(F.col("o_orderkey"), F.lit(9)).cast("bigint").alias("draft_signal_count"))


PREDICTIONS_SQL = """predictions AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS opportunity_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'pending' ELSE 'draft' END AS status,
  o_orderstatus <> 'P' AS is_published, o_orderdate AS drafted_at, o_orderkey % 9 AS draft_signal_count FROM orders)"""
