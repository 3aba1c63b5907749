"""Queries for sources, sinks, limits and the operators known by specification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faintline.functions import scalar as S
from faintline.operators import derived
from faintline.plans import views as V
from faintline.plans.registry import query
from faintline.plans.text import _OPP, opportunity_scores
from faintline.plans.views import AS_OF, EVENTS_SQL, HISTORY_SQL, OPPORTUNITIES_SQL, TITLES_SQL
from faintline.sources import feeds, sinks
from faintline.sources.storage import new_path, table
from faintline.streaming import limits

W = f"WITH {TITLES_SQL} "
NOW = f"TIMESTAMP '{AS_OF}'"
E = "CAST(floor(epoch(created_at)) AS BIGINT)"
_epoch = lambda: F.unix_seconds(F.col("created_at").cast("timestamp"))


def _landed(t, item, wrap, per: int = 50):
    """Responses of up to ``per`` items each."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id", item.alias("i")))), lambda x: x["i"])
    return t.groupBy(F.floor(F.col("id") / per).alias("page")).agg(F.to_json(wrap(listed)).alias("payload"))


def _reddit(s, d):
    item = F.struct(F.struct(F.col("id").cast("string").alias("id"), "title", F.lit("saas").alias("subreddit"), F.col("score").cast("bigint").alias("score"), F.col("engagement").cast("bigint").alias("num_comments"), _epoch().cast("double").alias("created_utc"), F.lit("u").alias("url")).alias("data"))
    return feeds.reddit(_landed(V.titles(s, d), item, lambda x: F.struct(F.struct(x.alias("children")).alias("data"))))


_AGE = f"(epoch_us({NOW}) - epoch_us(created_at) // 1000000 * 1000000) / 86400e6"
query(
    "src_reddit",
    f"{W}, p AS (SELECT CAST(id AS VARCHAR) AS id, title, CAST(score AS BIGINT) AS score, CAST(engagement AS BIGINT) AS num_comments, CAST(floor(least(100.0, (CAST(score AS BIGINT) / 100 * 0.6 + CAST(engagement AS BIGINT) / 50 * 0.4) * (1 + 0.3 * greatest(0.0, 1 - {_AGE} / 7))) + 0.5) AS BIGINT) AS score_ranking FROM titles WHERE score > 5) SELECT * FROM p ORDER BY score_ranking DESC, id LIMIT 30",
)(lambda s, d: feeds.reddit_top(_reddit(s, d), AS_OF).select("id", "title", "score", "num_comments", "score_ranking"))


def _hackernews(s, d):
    t = V.titles(s, d)
    items = t.select(F.to_json(F.struct("id", F.when(F.col("id") % 7 > 0, F.col("title")).alias("title"), F.col("score").cast("bigint").alias("score"), F.when(F.col("id") % 2 == 0, F.col("engagement").cast("bigint")).alias("descendants"), _epoch().alias("time"))).alias("payload"))
    return feeds.hackernews(t.select("id", (F.col("id") % 100).alias("place")), items)


query(
    "src_hackernews",
    f"{W}, h AS (SELECT id, title, CAST(score AS BIGINT) AS score, CASE WHEN id % 2 = 0 THEN CAST(engagement AS BIGINT) ELSE 0 END AS descendants, row_number() OVER (ORDER BY id % 100, id) - 1 AS i, created_at FROM titles WHERE id % 7 > 0 AND id % 100 < 50), r AS (SELECT id, title, score, descendants, CAST(floor(least(100.0, (score / 500 * 0.6 + descendants / 200 * 0.4 + (1 - i / 30) * 0.5) * (1 + 0.2 * greatest(0.0, 1 - {_AGE}))) + 0.5) AS BIGINT) AS score_ranking FROM h WHERE i < 30) SELECT * FROM r ORDER BY score_ranking DESC, id LIMIT 15",
)(lambda s, d: feeds.hackernews_top(_hackernews(s, d), AS_OF).select("id", "title", "score", "descendants", "score_ranking"))


def _producthunt(s, d):
    item = F.struct("id", F.col("title").alias("name"), F.col("source").alias("tagline"), F.col("score").cast("bigint").alias("votes_count"), F.lit("u").alias("url"))
    return feeds.producthunt(_landed(V.titles(s, d), item, lambda x: F.struct(x.alias("posts"))))


query("src_producthunt_api", f"{W} SELECT id, title AS name, source AS tagline, CAST(score AS BIGINT) AS votes_count FROM titles")(lambda s, d: _producthunt(s, d).select("id", "name", "tagline", "votes_count"))


def _github(s, d):
    item = F.struct("id", F.col("title").alias("full_name"), F.when(F.col("id") % 2 == 0, F.col("title")).otherwise("short").alias("description"), (F.col("score") * 20).cast("bigint").alias("stargazers_count"), F.lit("u").alias("html_url"))
    return feeds.github(_landed(V.titles(s, d), item, lambda x: F.struct(x.alias("items"))))


query("src_github", f"{W}, g AS (SELECT id, CAST(score * 20 AS BIGINT) AS n FROM titles WHERE id % 2 = 0 AND length(title) > 20) SELECT id, CASE WHEN n >= 10000 THEN 95 WHEN n >= 5000 THEN 85 WHEN n >= 1000 THEN 70 WHEN n >= 500 THEN 55 WHEN n >= 100 THEN 40 ELSE 25 END AS score_ranking FROM g")(lambda s, d: _github(s, d).select("id", "score_ranking"))


def _stackoverflow(s, d):
    item = F.struct(F.col("id").alias("question_id"), "title", F.col("score").cast("bigint").alias("score"), (F.col("id") % 3).alias("answer_count"))
    return feeds.stackoverflow(_landed(V.titles(s, d), item, lambda x: F.struct(x.alias("items"))))


query("src_stackoverflow", f"{W} SELECT id AS question_id, title, id % 3 AS answer_count FROM titles")(lambda s, d: _stackoverflow(s, d).select("question_id", "title", "answer_count"))


def _rss(s, d, atom=False):
    """Pages of forty items as RSS or Atom, with CDATA, entities and markup; one in five has no link, and every seventh page breaks off after its items."""
    item, body, head, foot = ("entry", "summary", '<feed xmlns="http://www.w3.org/2005/Atom"><title>a feed</title>', "</feed>") if atom else ("item", "description", '<?xml version="1.0"?><rss version="2.0"><channel><title>a feed</title>', "</channel></rss>")
    address = F.concat(F.lit("http://x/"), F.col("id").cast("string"))
    link = F.concat(F.lit('<link rel="alternate" href="'), address, F.lit('"/>')) if atom else F.concat(F.lit("<link>"), address, F.lit("</link>"))
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("<![CDATA["), "title", F.lit("]]>"))).otherwise(F.replace("title", F.lit("&"), F.lit("&amp;")))
    one = F.concat(F.lit(f"<{item}><title>"), text, F.lit(f"</title><{body}>about <b>"), F.col("source"), F.lit(f"</b></{body}>"), F.when(F.col("id") % 5 == 0, "").otherwise(link), F.lit(f"</{item}>"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", one.alias("i")))), lambda x: x["i"]), "\n")
    pages = V.titles(s, d).groupBy(F.floor(F.col("id") / 40).alias("page")).agg(listed.alias("items"))
    raw = pages.select("page", F.concat(F.lit(head), "items", F.when(F.col("page") % 7 == 3, "<").otherwise(foot)).alias("payload"))
    return feeds.rss(raw, ["page"])


_LINKED = "id % 5 > 0"
_RSS = f"{W} SELECT title, 'about ' || source AS tagline, 'http://x/' || id AS url FROM titles WHERE {_LINKED}"
query("src_producthunt_rss", _RSS)(lambda s, d: _rss(s, d).select("title", "tagline", "url"))
query("src_arxiv", _RSS)(lambda s, d: _rss(s, d, atom=True).select("title", "tagline", "url"))
query("src_rss_titles", f"{W} SELECT DISTINCT title FROM titles WHERE {_LINKED}")(lambda s, d: _rss(s, d).select("title").distinct())
_asked = lambda t: t.filter("title LIKE '%?'").select("title").distinct().orderBy("title").limit(10).withColumn("place", F.row_number().over(Window.orderBy("title")) - 1)
_best = lambda t: t.filter("source = 'github'").orderBy(F.desc("score"), "id").limit(10).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).select("title", "place")
query("src_weekly_top10", f"{W}, a AS (SELECT title, 0 AS feed, row_number() OVER (ORDER BY title) - 1 AS place FROM (SELECT DISTINCT title FROM titles WHERE title LIKE '%?')), b AS (SELECT title, 1 AS feed, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM titles WHERE source = 'github') SELECT title, feed FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE place < 10 ORDER BY feed, place LIMIT 10")(
    lambda s, d: feeds.gap_filled(_asked(V.titles(s, d)), _best(V.titles(s, d))).select("title", "feed")
)
query("src_pg_tables", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))

_PLACED = f"WITH {OPPORTUNITIES_SQL}, p AS (SELECT *, id - (SELECT min(id) FROM opportunities) AS place FROM opportunities)"


def _placed(s, d):
    o = V.opportunities(s, d)
    return o.join(F.broadcast(o.agg(F.min("id").alias("low")))).withColumn("place", F.col("id") - F.col("low"))


query("sink_report_html", f"{_PLACED} SELECT '<table>' || string_agg('<tr><td>' || title || '</td><td>' || category || '</td><td>' || confidence || '</td></tr>', '' ORDER BY place) || '</table>' AS html FROM p WHERE place IN (1, 4, 9)")(lambda s, d: sinks.report(_placed(s, d), [1, 4, 9]))
_MOVED = f"{HISTORY_SQL}, l AS (SELECT trend_slug, recorded_at, CASE WHEN score >= 50 THEN 'rising' ELSE 'emerging' END AS lifecycle FROM history), moved AS (SELECT trend_slug, lag(lifecycle) OVER (PARTITION BY trend_slug ORDER BY recorded_at) AS previous, lifecycle, recorded_at AS changed_at FROM l)"


def _moved(s, d):
    """Changes of lifecycle; those of slugs that end in 7 have been told of."""
    states = V.history(s, d).select("trend_slug", "recorded_at", F.when(F.col("score") >= 50, "rising").otherwise("emerging").alias("lifecycle"))
    before = states.withColumn("previous", F.lag("lifecycle").over(Window.partitionBy("trend_slug").orderBy("recorded_at")))
    return before.filter(~F.col("previous").eqNullSafe(F.col("lifecycle"))).select("trend_slug", "previous", "lifecycle", F.col("recorded_at").alias("changed_at"), F.col("trend_slug").endswith("7").alias("notified"))


query(
    "sink_email_digest",
    f"""WITH {OPPORTUNITIES_SQL}, {_MOVED}, best AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS n FROM opportunities ORDER BY n LIMIT 5), a AS (SELECT coalesce(string_agg(n || '. ' || title || chr(10) || category || chr(10) || 'Score: ' || confidence || ' | Lifecycle: ' || CASE WHEN id % 2 = 0 THEN 'rising' ELSE 'Unknown' END, chr(10) || chr(10) ORDER BY n), 'No new opportunities this week.') AS t FROM best),
    b AS (SELECT coalesce(string_agg(trend_slug || ': ' || coalesce(previous, 'New') || ' to ' || lifecycle, chr(10) ORDER BY changed_at DESC, trend_slug), 'No lifecycle changes this week.') AS t FROM moved WHERE previous IS DISTINCT FROM lifecycle AND trend_slug NOT LIKE '%7' AND changed_at >= {NOW} - INTERVAL 7 DAY)
    SELECT c_name AS email, 'Your week in trends' AS subject, 'Top opportunities' || chr(10) || chr(10) || a.t || chr(10) || chr(10) || 'Lifecycle changes' || chr(10) || chr(10) || b.t AS body FROM customer, a, b WHERE c_custkey % 3 > 0 AND c_custkey % 5 = 0""",
)(
    lambda s, d: sinks.digest(
        V.opportunities(s, d).select("id", "title", F.col("category").alias("description"), F.col("confidence").alias("score"), F.when(F.col("id") % 2 == 0, "rising").alias("lifecycle")),
        _moved(s, d),
        table(s, d, "customer").select(F.col("c_name").alias("email"), F.when(F.col("c_custkey") % 5 > 0, "some-trend").alias("trend_slug"), (F.col("c_custkey") % 3 > 0).alias("confirmed")),
        AS_OF,
    )
)
_LABEL = "CASE WHEN final_score >= 80 THEN 'High' WHEN final_score >= 60 THEN 'Watch' WHEN final_score >= 40 THEN 'Emerging' ELSE 'Noise' END"
query("sink_pipeline_log", f"{_OPP}, l AS (SELECT {_LABEL} AS label, count(*) AS n FROM scored GROUP BY 1) SELECT '{{\"signals_in\":' || (SELECT count(*) FROM scored) || ',\"score_range\":[' || (SELECT min(final_score) FROM scored) || ',' || (SELECT max(final_score) FROM scored) || '],\"labels\":{{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY label) || '}}}}' AS line FROM l")(
    lambda s, d: s.createDataFrame([(sinks.logged(opportunity_scores(s, d).select(S.opportunity_label(F.col("final_score")).alias("label"), F.col("final_score").alias("score")), new_path(s, "scored")),)], "line string")
)


def _requests(s, d):
    return table(s, d, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


query(
    "rate_limit_fixed_window",
    """WITH RECURSIVE q AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    w AS (SELECT key, "at", i, "at" AS start, 1 AS n FROM q WHERE i = 1 UNION ALL SELECT q.key, q."at", q.i, CASE WHEN w.start + 3600000000 < q."at" THEN q."at" ELSE w.start END, CASE WHEN w.start + 3600000000 < q."at" THEN 1 ELSE w.n + 1 END FROM w JOIN q ON q.key = w.key AND q.i = w.i + 1)
    SELECT key, "at", CAST(n AS BIGINT) AS n, n <= 5 AS allowed FROM w""",
)(lambda s, d: limits.limited(_requests(s, d), "billing"))
query(
    "rate_limit_expiry",
    f"""WITH RECURSIVE q AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
    w AS (SELECT key, "at", i, "at" AS start, 1 AS n FROM q WHERE i = 1 UNION ALL SELECT q.key, q."at", q.i, CASE WHEN w.start + 3600000000 < q."at" THEN q."at" ELSE w.start END, CASE WHEN w.start + 3600000000 < q."at" THEN 1 ELSE w.n + 1 END FROM w JOIN q ON q.key = w.key AND q.i = w.i + 1),
    l AS (SELECT key, max(start) AS start, CAST(arg_max(n, i) AS BIGINT) AS n FROM w GROUP BY 1) SELECT key, start, n FROM l WHERE start + 3600000000 >= (SELECT max(epoch_us(ts)) FROM events)""",
)(lambda s, d: limits.alive(limits.limited(_requests(s, d), "billing"), "billing"))
query("propagation_events", f"WITH {EVENTS_SQL}, p AS (SELECT concept_id, count(DISTINCT source) AS sources, min(collected_at) AS first_seen FROM ev WHERE collected_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1) SELECT *, CASE sources WHEN 2 THEN 'dual_source' WHEN 3 THEN 'cross_platform' ELSE 'multi_source' END AS kind FROM p WHERE sources >= 2")(
    lambda s, d: derived.propagation(V.event_mentions(s, d), V.event_signals(s, d), AS_OF)
)
query("convergence_score", "SELECT p_partkey, CAST(floor(0.30 * least(100, p_size * 3) + 0.25 * (p_partkey % 101) + 0.25 * (p_partkey % 90) + 0.20 * (p_partkey % 55) + 0.5) AS BIGINT) AS score FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", derived.convergence(F.col("p_size") * 3, F.col("p_partkey") % 101, F.col("p_partkey") % 90, F.col("p_partkey") % 55).alias("score"))
)
query("market_hypotheses", "SELECT p_brand, CAST(floor(least(100, avg(p_size) + count(DISTINCT p_type)) + 0.5) AS BIGINT) AS confidence, CASE WHEN avg(p_size) > 20 THEN '3-6 months' WHEN avg(p_size) > 10 THEN '6-12 months' WHEN avg(p_size) > 5 THEN '12-18 months' ELSE '18-24 months' END AS w, CAST(sum(p_size) AS BIGINT) AS market_size FROM part GROUP BY 1")(
    lambda s, d: derived.hypotheses(table(s, d, "part").select(F.col("p_brand").alias("group"), F.col("p_size").alias("velocity"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))).select(F.col("group").alias("p_brand"), "confidence", F.col("window").alias("w"), "market_size")
)
query("failed_trends", f"WITH {HISTORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY trend_slug ORDER BY recorded_at DESC) AS r FROM history), e AS (SELECT trend_slug, max(score) AS peak_score, max(recorded_at) AS last_at, max(CASE WHEN r = 1 THEN score END) AS a, max(CASE WHEN r = 2 THEN score END) AS b FROM r GROUP BY 1) SELECT trend_slug, peak_score, CASE WHEN last_at < {NOW} - INTERVAL 30 DAY THEN 'inactive' ELSE 'velocity' END AS reason FROM e WHERE peak_score >= 40 AND (last_at < {NOW} - INTERVAL 30 DAY OR coalesce(a / nullif(b, 0) - 1 < -0.5, false))")(
    lambda s, d: derived.failed_trends(V.history(s, d), AS_OF).select("trend_slug", "peak_score", "reason")
)
query("ph_match", f"{W}, c AS (SELECT id AS concept_id, created_at AS first_seen, unnest(list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(keywords[2] || ' ' || keywords[1]), '[^a-z0-9\\s-]', ' ', 'g'), '-+', ' ', 'g'), '\\s+'), lambda t: length(t) >= 3))) AS w FROM titles), m AS (SELECT concept_id, count(*) AS m FROM c GROUP BY 1), p AS (SELECT p_partkey AS product_id, unnest(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: length(t) >= 3))) AS w FROM part UNION SELECT 999, 'looking') SELECT concept_id, product_id, CAST(floor((epoch_us({NOW}) - epoch_us(any_value(first_seen))) / 86400e6) AS BIGINT) AS lead_time_days FROM c JOIN p USING (w) JOIN m USING (concept_id) GROUP BY 1, 2 HAVING count(*) / any_value(m) >= 0.5")(
    lambda s, d: derived.launches(V.titles(s, d).select(F.col("id").alias("concept_id"), F.col("created_at").alias("first_seen"), F.concat_ws(" ", F.get("keywords", 1), F.get("keywords", 0)).alias("concept")), table(s, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title")).unionByName(s.createDataFrame([(999, "looking")], "product_id bigint, title string")).withColumn("launched", S.moment(AS_OF)))
)
query("text_templates", f"WITH {OPPORTUNITIES_SQL} SELECT id, 'An emerging opportunity in the ' || title || ' space. This trend is showing strong signals with a confidence of ' || confidence || '.' AS description FROM opportunities")(
    lambda s, d: V.opportunities(s, d).select("id", F.concat(F.lit("An emerging opportunity in the "), "title", F.lit(" space. This trend is showing strong signals with a confidence of "), F.col("confidence").cast("string"), F.lit(".")).alias("description"))
)
query("json_serialise", f"WITH {OPPORTUNITIES_SQL} SELECT id, '{{\"id\":' || id || ',\"confidence\":' || confidence || '}}' AS notes FROM opportunities")(lambda s, d: V.opportunities(s, d).select("id", F.to_json(F.struct("id", "confidence")).alias("notes")))
