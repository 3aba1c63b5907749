"""Queries for joins, aggregates, windows, top-k, sets, graphs and state changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from faintline.functions import rules as R
from faintline.functions import scalar as S
from faintline.operators import clusters, concepts, history, predictions, signals, titles
from faintline.operators.graph import components
from faintline.plans import views as V
from faintline.plans.registry import query
from faintline.plans.text import opportunity_scores, _OPP
from faintline.plans.views import AS_OF, AS_OF_ORDERS, EVENTS_SQL, HISTORY_SQL, MENTIONS_SQL, OPPORTUNITIES_SQL, PREDICTIONS_SQL, SIGNALS_SQL, TITLES_SQL
from faintline.sources import sinks
from faintline.sources.storage import new_path, table

MS = f"WITH {MENTIONS_SQL}, {SIGNALS_SQL} "
OP = f"WITH {OPPORTUNITIES_SQL}, {PREDICTIONS_SQL} "
NOW = f"TIMESTAMP '{AS_OF}'"
DAY = f"date_trunc('day', {NOW})"

# ---------------------------------------------------------------- windows of mentions, velocities, scores

_COUNTS = f"""counts AS (SELECT concept_id, count(*) FILTER (WHERE collected_at >= {DAY}) AS daily, count(*) FILTER (WHERE collected_at >= {DAY} - INTERVAL 7 DAY) AS last_7,
  count(*) FILTER (WHERE collected_at >= {DAY} - INTERVAL 30 DAY) AS last_30, count(*) FILTER (WHERE collected_at >= {DAY} - INTERVAL 14 DAY AND collected_at < {DAY} - INTERVAL 7 DAY) AS before_7,
  count(*) FILTER (WHERE collected_at >= {DAY} - INTERVAL 60 DAY AND collected_at < {DAY} - INTERVAL 30 DAY) AS before_30, count(*) FILTER (WHERE collected_at >= {NOW} - INTERVAL 7 DAY) AS recent,
  count(*) FILTER (WHERE collected_at >= {NOW} - INTERVAL 21 DAY AND collected_at < {NOW} - INTERVAL 7 DAY) AS previous FROM ev GROUP BY 1)"""
EV = f"WITH {EVENTS_SQL}, {_COUNTS} "


def _counts(s, d):
    return concepts.windows(V.event_mentions(s, d), V.event_signals(s, d), AS_OF)


query("rolling_mentions", f"{EV} SELECT * FROM counts")(_counts)
query("agg_velocity", f"{EV} SELECT concept_id, daily, last_7, last_30, before_7, before_30 FROM counts WHERE last_30 > 0")(lambda s, d: _counts(s, d).filter("last_30 > 0").select("concept_id", "daily", "last_7", "last_30", "before_7", "before_30"))
_EARLIER = "earlier AS (SELECT c_custkey AS concept_id, (c_custkey % 7) / 4 AS velocity_7d FROM customer WHERE c_custkey % 3 = 0)"
_VEL = f"""{EV}, {_EARLIER}, v AS (SELECT c.concept_id, daily, last_7, last_30, CASE WHEN before_7 = 0 THEN 0 ELSE last_7 / before_7 - 1 END AS velocity_7d, CASE WHEN before_30 = 0 THEN 0 ELSE last_30 / before_30 - 1 END AS velocity_30d,
  CASE WHEN last_7 = 0 AND before_7 = 0 THEN 0 WHEN before_7 = 0 THEN NULL ELSE last_7 / before_7 - 1 END - coalesce(e.velocity_7d, 0) AS acceleration FROM counts c LEFT JOIN earlier e USING (concept_id) WHERE last_30 > 0),
  vel AS (SELECT concept_id, daily, last_7, last_30, round(velocity_7d, 6) AS velocity_7d, round(velocity_30d, 6) AS velocity_30d, round(acceleration, 6) AS acceleration, coalesce(acceleration > 0.5, false) AS is_accelerating FROM v) """


def _velocity(s, d):
    earlier = table(s, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("concept_id"), ((F.col("c_custkey") % 7) / 4).alias("velocity_7d"))
    v = concepts.velocity(_counts(s, d), earlier)
    return v.withColumns({c: F.round(c, 6) for c in ("velocity_7d", "velocity_30d", "acceleration")})


query("velocity_acceleration", f"{_VEL} SELECT * FROM vel")(_velocity)
query("join_velocity_lag", f"{_VEL} SELECT concept_id, velocity_7d, acceleration FROM vel")(lambda s, d: _velocity(s, d).select("concept_id", "velocity_7d", "acceleration"))
query("agg_velocity_stats", f"{_VEL} SELECT count(*) AS n, count(*) FILTER (WHERE is_accelerating) AS accelerating FROM vel")(lambda s, d: _velocity(s, d).agg(F.count("*").alias("n"), F.count_if("is_accelerating").alias("accelerating")))
query("top_accelerating", f"{_VEL} SELECT concept_id, acceleration, velocity_7d FROM vel WHERE is_accelerating ORDER BY acceleration DESC, velocity_7d DESC, concept_id LIMIT 10")(
    lambda s, d: _velocity(s, d).filter("is_accelerating").orderBy(F.desc("acceleration"), F.desc("velocity_7d"), "concept_id").select("concept_id", "acceleration", "velocity_7d").limit(10)
)
query("join_velocity_nodes", f"{_VEL} SELECT c_name AS concept, velocity_7d FROM vel JOIN customer ON c_custkey = concept_id ORDER BY velocity_7d DESC, concept_id LIMIT 20")(
    lambda s, d: _velocity(s, d).join(table(s, d, "customer"), F.col("c_custkey") == F.col("concept_id")).orderBy(F.desc("velocity_7d"), "concept_id").select(F.col("c_name").alias("concept"), "velocity_7d").limit(20)
)
query("velocity_score", f"{EV} SELECT concept_id, round(CASE WHEN previous = 0 THEN CASE WHEN recent > 0 THEN least(0.5 * recent, 5) ELSE 0 END ELSE greatest(-1, least(10, (recent - previous) / previous)) END, 6) AS v FROM counts")(
    lambda s, d: _counts(s, d).select("concept_id", F.round(S.velocity_score(F.col("recent"), F.col("previous")), 6).alias("v"))
)
_NODES = """byn AS (SELECT concept_id, source, count(*) AS n, min(collected_at) AS lo, max(collected_at) AS hi FROM ev GROUP BY 1, 2),
  nodes AS (SELECT concept_id, CAST(sum(n) AS BIGINT) AS mention_count, min(lo) AS first_seen, max(hi) AS last_seen, string_agg(source || '=' || n, ',' ORDER BY source) AS by_source, count(*) AS k,
    -sum(n / (SELECT sum(n) FROM byn b WHERE b.concept_id = a.concept_id) * log2(n / (SELECT sum(n) FROM byn b WHERE b.concept_id = a.concept_id))) AS h FROM byn a GROUP BY 1)"""
def _shown():
    """source=count, comma-joined, of the map source_distribution."""
    return F.array_join(F.transform(F.map_entries("source_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def _nodes(s, d):
    return concepts.nodes_of(V.event_mentions(s, d), V.event_signals(s, d))


query("agg_concept_nodes", f"WITH {EVENTS_SQL}, {_NODES} SELECT concept_id, mention_count, first_seen, last_seen, by_source FROM nodes")(lambda s, d: _nodes(s, d).withColumn("by_source", _shown()).drop("source_distribution"))
query("diversity_score", f"WITH {EVENTS_SQL}, {_NODES} SELECT concept_id, CAST(floor(k / 4 * 70 + CASE WHEN k > 1 THEN h / log2(k) * 30 ELSE 0 END + 0.5) AS BIGINT) AS s FROM nodes")(lambda s, d: _nodes(s, d).select("concept_id", S.diversity_score(F.col("source_distribution")).alias("s")))
_EVEDGES = f"{MENTIONS_SQL}, evp AS (SELECT DISTINCT a.concept_id AS x, b.concept_id AS y FROM mentions a JOIN mentions b ON a.signal_id = b.signal_id AND a.concept_id <> b.concept_id), deg AS (SELECT x AS concept_id, count(*) AS degree FROM evp GROUP BY 1)"
_PARTS = """parts AS (SELECT n.concept_id, CAST(floor(least(mention_count, 50) / 50 * 100 + 0.5) AS BIGINT) AS frequency,
  CASE WHEN previous = 0 THEN CASE WHEN recent > 0 THEN least(0.5 * recent, 5) ELSE 0 END ELSE greatest(-1, least(10, (recent - previous) / previous)) END AS velocity,
  CAST(floor(k / 4 * 70 + CASE WHEN k > 1 THEN h / log2(k) * 30 ELSE 0 END + 0.5) AS BIGINT) AS diversity,
  CAST(floor(greatest(0, least(100, 100 * exp(-0.1 * (epoch_us(NOW) - epoch_us(last_seen)) / 86400e6))) + 0.5) AS BIGINT) AS recency,
  CAST(floor(least(coalesce(degree, 0), 20) / 20 * 100 + 0.5) AS BIGINT) AS cooccurrence FROM nodes n LEFT JOIN counts USING (concept_id) LEFT JOIN deg USING (concept_id)),
  scores AS (SELECT *, CAST(floor(greatest(0.0, least(100.0, 0.25 * frequency + 0.30 * greatest(0.0, least(100.0, 50 + 10 * velocity)) + 0.20 * diversity + 0.15 * recency + 0.10 * cooccurrence)) + 0.5) AS BIGINT) AS weak_signal_score FROM parts)""".replace("NOW", NOW)
_SCORES = f"{EV}, {_NODES}, {_EVEDGES}, {_PARTS} "


def _event_edges(s, d):
    return concepts.pairs(V.mentions(s, d))


def _scores(s, d):
    return concepts.scores(_nodes(s, d), _counts(s, d), concepts.degrees(_event_edges(s, d)), AS_OF).withColumn("velocity", F.round("velocity", 6))


_ALL = "concept_id, frequency, round(velocity, 6) AS velocity, diversity, recency, cooccurrence, weak_signal_score"
query("weak_signal_score", f"{_SCORES} SELECT {_ALL} FROM scores")(_scores)
query("update_scores", f"{_SCORES} SELECT c_custkey, CASE WHEN weak_signal_score IS NULL THEN 0 ELSE weak_signal_score END AS score FROM customer LEFT JOIN scores ON concept_id = c_custkey")(
    lambda s, d: table(s, d, "customer").join(_scores(s, d), F.col("c_custkey") == F.col("concept_id"), "left").select("c_custkey", F.coalesce("weak_signal_score", F.lit(0)).alias("score"))
)
query("top_weak_signals", f"{_SCORES} SELECT concept_id, weak_signal_score FROM scores ORDER BY weak_signal_score DESC, concept_id LIMIT 20")(lambda s, d: _scores(s, d).orderBy(F.desc("weak_signal_score"), "concept_id").select("concept_id", "weak_signal_score").limit(20))
query("agg_score_distribution", f"{_SCORES} SELECT min(weak_signal_score) AS lo, max(weak_signal_score) AS hi, CAST(floor(avg(weak_signal_score) + 0.5) AS BIGINT) AS mean FROM scores")(
    lambda s, d: _scores(s, d).agg(F.min("weak_signal_score").alias("lo"), F.max("weak_signal_score").alias("hi"), S.js_round(F.avg("weak_signal_score")).alias("mean"))
)
query("eligible_concepts", f"{_SCORES} SELECT n.concept_id, weak_signal_score FROM scores JOIN nodes n USING (concept_id) WHERE weak_signal_score >= 30 AND last_seen >= {NOW} - INTERVAL 30 DAY")(
    lambda s, d: _scores(s, d).join(_nodes(s, d).select("concept_id", "last_seen"), "concept_id").filter((F.col("weak_signal_score") >= 30) & (F.col("last_seen") >= S.days_before(AS_OF, 30))).select("concept_id", "weak_signal_score")
)
query("matchable_concepts", f"{_SCORES} SELECT n.concept_id, weak_signal_score, first_seen FROM scores JOIN nodes n USING (concept_id) WHERE weak_signal_score > 40 AND first_seen IS NOT NULL ORDER BY weak_signal_score DESC, n.concept_id LIMIT 100")(
    lambda s, d: _scores(s, d).join(_nodes(s, d).select("concept_id", "first_seen"), "concept_id").filter("weak_signal_score > 40 AND first_seen IS NOT NULL").orderBy(F.desc("weak_signal_score"), "concept_id").select("concept_id", "weak_signal_score", "first_seen").limit(100)
)
query("cooccurrence_score", f"{_SCORES} SELECT concept_id, cooccurrence FROM scores")(lambda s, d: _scores(s, d).select("concept_id", "cooccurrence"))
query("agg_cooccurrence_degree", f"WITH {EVENTS_SQL}, {_EVEDGES} SELECT concept_id, degree FROM deg")(lambda s, d: concepts.degrees(_event_edges(s, d)))
query("map_increment", f"WITH {EVENTS_SQL}, u AS (SELECT concept_id, source, sum(n) AS n FROM (SELECT concept_id, source, count(*) AS n FROM ev WHERE signal_id % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT concept_id, source, count(*) FROM ev WHERE signal_id % 2 = 1 GROUP BY 1, 2) GROUP BY 1, 2) SELECT concept_id, string_agg(source || '=' || CAST(n AS BIGINT), ',' ORDER BY source) AS by_source FROM u GROUP BY 1")(
    lambda s, d: _incremented(s, d)
)


def _incremented(s, d):
    part = lambda k: concepts.nodes_of(V.event_mentions(s, d).filter(F.col("signal_id") % 2 == k), V.event_signals(s, d)).select("concept_id", F.col("source_distribution").alias(f"m{k}"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    both = part(0).join(part(1), "concept_id", "full_outer")
    merged = concepts.merge_counts(F.coalesce("m0", none), F.coalesce("m1", none))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return both.select("concept_id", shown.alias("by_source"))


# ---------------------------------------------------------------- joins and the concept graph over orders

query("join_mentions_signals", f"{MS} SELECT concept_id, count(*) AS n, max(collected_at) AS last_seen FROM mentions JOIN signals USING (signal_id) GROUP BY 1")(
    lambda s, d: V.mentions(s, d).join(V.signals(s, d), "signal_id").groupBy("concept_id").agg(F.count("*").alias("n"), F.max("collected_at").alias("last_seen"))
)
query("join_nodes_mentions_signals", f"{MS} SELECT p_brand AS concept, count(*) AS n FROM part LEFT JOIN mentions ON p_partkey = concept_id LEFT JOIN signals USING (signal_id) WHERE collected_at >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 60 DAY GROUP BY 1")(
    lambda s, d: table(s, d, "part").join(V.mentions(s, d), F.col("p_partkey") == F.col("concept_id"), "left").join(V.signals(s, d), "signal_id", "left").filter(F.col("collected_at") >= S.days_before(AS_OF_ORDERS, 60)).groupBy(F.col("p_brand").alias("concept")).agg(F.count("*").alias("n"))
)
query("cooccurrence_pairs", f"{MS} SELECT a.signal_id, a.concept_id AS concept_a, b.concept_id AS concept_b FROM mentions a JOIN mentions b ON a.signal_id = b.signal_id AND a.concept_id < b.concept_id")(lambda s, d: concepts.pairs(V.mentions(s, d)))
query("self_join_pairs", f"{MS} SELECT a.concept_id AS concept_a, b.concept_id AS concept_b, count(*) AS weight FROM mentions a JOIN mentions b ON a.signal_id = b.signal_id AND a.concept_id < b.concept_id GROUP BY 1, 2")(
    lambda s, d: concepts.weights(concepts.pairs(V.mentions(s, d)), _spread(s, d))
)
_E = f"""{MS}, snaps AS (SELECT a.signal_id, a.concept_id AS concept_a, b.concept_id AS concept_b, collected_at AS created_at, source FROM mentions a JOIN mentions b ON a.signal_id = b.signal_id AND a.concept_id < b.concept_id JOIN signals ON signals.signal_id = a.signal_id),
  edges AS (SELECT concept_a, concept_b, count(*) AS total_weight, min(created_at) AS first_seen, max(created_at) AS last_seen, count(DISTINCT signal_id) AS signal_count FROM snaps GROUP BY 1, 2),
  srcs AS (SELECT concept_a, concept_b, string_agg(source || '=' || n, ',' ORDER BY source) AS by_source FROM (SELECT concept_a, concept_b, source, count(*) AS n FROM snaps GROUP BY 1, 2, 3) GROUP BY 1, 2) """


def _snaps(s, d):
    return concepts.pairs(V.mentions(s, d)).join(V.signals(s, d).select("signal_id", F.col("collected_at").alias("created_at"), "source"), "signal_id")


def _spread(s, d):
    return concepts.tasks_of_pairs(V.mentions(s, d))


def _edges(s, d):
    return concepts.edges(_snaps(s, d), parts=_spread(s, d)).withColumn("by_source", _shown()).drop("source_distribution")


query("agg_concept_edges", f"{_E} SELECT edges.*, by_source FROM edges JOIN srcs USING (concept_a, concept_b)")(_edges)
query("jsonb_object_agg", f"{_E} SELECT * FROM srcs")(lambda s, d: _edges(s, d).select("concept_a", "concept_b", "by_source"))
query("join_edges_signals", f"{_E} SELECT source, count(*) AS n FROM snaps GROUP BY 1")(lambda s, d: _snaps(s, d).groupBy("source").agg(F.count("*").alias("n")))
query("top_edges", f"{_E} SELECT concept_a, concept_b, total_weight, last_seen FROM edges ORDER BY total_weight DESC, last_seen DESC, concept_a, concept_b LIMIT 20")(
    lambda s, d: _edges(s, d).orderBy(F.desc("total_weight"), F.desc("last_seen"), "concept_a", "concept_b").select("concept_a", "concept_b", "total_weight", "last_seen").limit(20)
)
query("top_edge_snapshots", f"{_E} SELECT concept_a, concept_b, total_weight FROM edges ORDER BY total_weight DESC, concept_a, concept_b LIMIT 200")(lambda s, d: _edges(s, d).orderBy(F.desc("total_weight"), "concept_a", "concept_b").select("concept_a", "concept_b", "total_weight").limit(200))
query("agg_edge_counts", f"{_E} SELECT count(*) AS edges, count(*) FILTER (WHERE first_seen >= TIMESTAMP '{AS_OF_ORDERS}') AS new FROM edges")(lambda s, d: _edges(s, d).agg(F.count("*").alias("edges"), F.count_if(F.col("first_seen") >= S.moment(AS_OF_ORDERS)).alias("new")))
query("edge_weight_filter", f"{_E} SELECT concept_a, concept_b, total_weight FROM edges WHERE total_weight >= 2")(lambda s, d: _edges(s, d).filter("total_weight >= 2").select("concept_a", "concept_b", "total_weight"))


def _graph(s, d):
    return concepts.graph(concepts.pairs(V.mentions(s, d)).withColumn("weight", F.lit(1)), parts=_spread(s, d))


query("concept_graph", f"{_E} SELECT concept_a AS u, concept_b AS v, total_weight AS w FROM edges WHERE total_weight >= 2 UNION ALL SELECT concept_b, concept_a, total_weight FROM edges WHERE total_weight >= 2")(_graph)
query("agg_degree", f"{_E} SELECT n AS concept_id, count(*) AS degree FROM (SELECT concept_a AS n FROM edges UNION ALL SELECT concept_b FROM edges) GROUP BY 1")(lambda s, d: concepts.degrees(_edges(s, d), 2 * _spread(s, d)))
query("top_degree_nodes", f"{_E} SELECT n AS concept_id, count(*) AS degree FROM (SELECT concept_a AS n FROM edges UNION ALL SELECT concept_b FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda s, d: concepts.degrees(_edges(s, d), 2 * _spread(s, d)).orderBy(F.desc("degree"), "concept_id").limit(10))
query("agg_max_weight", f"{_E} SELECT concept_a, concept_b, round(0.15 + total_weight / (SELECT greatest(1, max(total_weight)) FROM edges) * 0.65, 6) AS opacity FROM edges")(
    lambda s, d: (lambda e: e.join(F.broadcast(e.agg(F.greatest(F.lit(1), F.max("total_weight")).alias("most")))).select("concept_a", "concept_b", F.round(0.15 + F.col("total_weight") / F.col("most") * 0.65, 6).alias("opacity")))(_edges(s, d).select("concept_a", "concept_b", "total_weight"))
)
query("ego_network", f"{_E} SELECT CASE WHEN concept_a = 7 THEN concept_b ELSE concept_a END AS neighbour, total_weight FROM edges WHERE concept_a = 7 OR concept_b = 7")(
    lambda s, d: _edges(s, d).filter("concept_a = 7 OR concept_b = 7").select(F.when(F.col("concept_a") == 7, F.col("concept_b")).otherwise(F.col("concept_a")).alias("neighbour"), "total_weight")
)
_TOP = f"{_E}, top AS (SELECT concept_a, concept_b, total_weight FROM edges ORDER BY total_weight DESC, concept_a, concept_b LIMIT 200), ends AS (SELECT concept_a AS id FROM top UNION SELECT concept_b FROM top) "


def _ends(s, d):
    top = _edges(s, d).orderBy(F.desc("total_weight"), "concept_a", "concept_b").limit(200)
    return top.select(F.explode(F.array("concept_a", "concept_b")).alias("id")).distinct()


query("distinct_endpoints", f"{_TOP} SELECT id FROM ends")(_ends)
query("semi_labels_any", f"{_TOP} SELECT p_partkey AS id, p_name AS label FROM part WHERE p_partkey IN (SELECT id FROM ends)")(lambda s, d: table(s, d, "part").join(_ends(s, d).withColumnRenamed("id", "p_partkey"), "p_partkey", "left_semi").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")))
query("graph_view", f"{_TOP} SELECT id, p_name AS label FROM ends LEFT JOIN part ON p_partkey = id")(lambda s, d: _ends(s, d).join(table(s, d, "part"), F.col("id") == F.col("p_partkey"), "left").select("id", F.col("p_name").alias("label")))
query("graph_components", f"{_E}, g AS (SELECT concept_a AS u, concept_b AS v FROM edges WHERE total_weight >= 3 UNION ALL SELECT concept_b, concept_a FROM edges WHERE total_weight >= 3), r AS (WITH RECURSIVE walk AS (SELECT u, v FROM g UNION SELECT walk.u, g.v FROM walk JOIN g ON g.u = walk.v) SELECT u, min(v) AS m FROM walk GROUP BY 1) SELECT u, least(u, m) AS v FROM r WHERE m < u")(
    lambda s, d: components(_edges(s, d).filter("total_weight >= 3").select(F.col("concept_a").alias("u"), F.col("concept_b").alias("v")))
)
query("graph_cluster")(lambda s, d: clusters.greedy(table(s, d, "part").filter("p_size >= 10").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("score")), _graph(s, d)))


# ---------------------------------------------------------------- clusters

_CL = """members AS (SELECT p_brand AS cluster, p_partkey AS id, p_name || ' ' || p_partkey AS concept, p_size AS score FROM part) """


def _members(s, d):
    return table(s, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("concept"), F.col("p_size").alias("score"))


def _listed(m):
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "concept")))
    return m.groupBy("cluster").agg(F.count("*").alias("members"), F.transform(order, lambda e: e["concept"]).alias("concepts"), F.avg("score").alias("mean"))


query("agg_cluster_members", f"WITH {_CL} SELECT cluster, count(*) AS members, string_agg(concept, '|' ORDER BY score DESC, concept) AS concepts FROM members GROUP BY 1")(lambda s, d: _listed(_members(s, d)).select("cluster", "members", F.array_join("concepts", "|").alias("concepts")))
query("join_cluster_members", f"WITH {_CL} SELECT r_name, cluster, count(id) AS members FROM region LEFT JOIN (SELECT DISTINCT cluster FROM members) c ON ascii(substr(cluster, -1)) % 5 = r_regionkey LEFT JOIN members USING (cluster) GROUP BY 1, 2")(
    lambda s, d: table(s, d, "region").join(_members(s, d).select("cluster").distinct(), F.ascii(F.substring("cluster", -1, 1)) % 5 == F.col("r_regionkey"), "left").join(_members(s, d), "cluster", "left").groupBy("r_name", "cluster").agg(F.count("id").alias("members"))
)
query("cluster_label", f"WITH {_CL}, l AS (SELECT cluster, list(concept ORDER BY score DESC, concept) AS c FROM members GROUP BY 1) SELECT cluster, CASE len(c) WHEN 1 THEN c[1] WHEN 2 THEN c[1] || ' & ' || c[2] ELSE c[1] || ' + ' || c[2] || ', ' || c[3] END AS label FROM l")(
    lambda s, d: _listed(_members(s, d)).select("cluster", S.cluster_label(F.slice("concepts", 1, 3)).alias("label"))
)
query("agg_cluster_metadata", f"WITH {EVENTS_SQL}, m AS (SELECT concept_id % 10 AS cluster, * FROM ev) SELECT cluster, CAST(floor(avg(score) + 0.5) AS BIGINT) AS avg_score, count(*) AS mentions, count(DISTINCT source) AS diversity, min(collected_at) AS first_seen, max(collected_at) AS last_seen FROM m GROUP BY 1")(
    lambda s, d: V.event_mentions(s, d).join(V.event_signals(s, d), "signal_id").groupBy((F.col("concept_id") % 10).alias("cluster")).agg(S.js_round(F.avg("score")).alias("avg_score"), F.count("*").alias("mentions"), F.countDistinct("source").alias("diversity"), F.min("collected_at").alias("first_seen"), F.max("collected_at").alias("last_seen"))
)
query("map_keys_union", f"WITH {EVENTS_SQL} SELECT concept_id % 10 AS cluster, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM ev GROUP BY 1")(
    lambda s, d: _nodes(s, d).select("concept_id", F.explode(F.map_keys("source_distribution")).alias("source")).groupBy((F.col("concept_id") % 10).alias("cluster")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
)
query("top_clusters", f"WITH {_CL} SELECT cluster, round(avg(score), 6) AS mean FROM members GROUP BY 1 ORDER BY mean DESC, cluster LIMIT 20")(lambda s, d: _listed(_members(s, d)).select("cluster", F.round("mean", 6).alias("mean")).orderBy(F.desc("mean"), "cluster").limit(20))
query("join_cluster_concepts_recent", f"WITH {EVENTS_SQL} SELECT concept_id % 10 AS cluster, c_name, max(collected_at) AS last_seen FROM ev JOIN customer ON c_custkey = concept_id WHERE collected_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1, 2 ORDER BY last_seen DESC, c_name LIMIT 50")(
    lambda s, d: V.event_mentions(s, d).join(V.event_signals(s, d), "signal_id").join(table(s, d, "customer"), F.col("c_custkey") == F.col("concept_id")).filter(F.col("collected_at") >= S.days_before(AS_OF, 7)).groupBy((F.col("concept_id") % 10).alias("cluster"), "c_name").agg(F.max("collected_at").alias("last_seen")).orderBy(F.desc("last_seen"), "c_name").limit(50)
)
query("confidence_min", "WITH c AS (SELECT p_partkey, round(least(100.0, 100 * (0.4 * least(p_size / 100, 1.0) + 0.3 * least((p_partkey % 70) / 50, 1.0) + 0.2 * least((p_partkey % 7) / 5, 1.0) + 0.1 * least((p_partkey % 30) / 20, 1.0))), 6) AS confidence FROM part) SELECT * FROM c WHERE confidence >= 30")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.round(S.cluster_confidence(F.col("p_size"), F.col("p_partkey") % 70, F.col("p_partkey") % 7, F.col("p_partkey") % 30), 6).alias("confidence")).filter("confidence >= 30")
)

# ---------------------------------------------------------------- aggregates

query("agg_keyword_quality", f"WITH {TITLES_SQL} SELECT keywords[2] AS keyword, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, CAST(floor(avg(score % 10) + 0.5) AS BIGINT) AS quality, count(*) AS n FROM titles GROUP BY 1")(
    lambda s, d: V.titles(s, d).groupBy(F.get("keywords", 1).alias("keyword")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), S.js_round(F.avg(F.col("score") % 10)).alias("quality"), F.count("*").alias("n"))
)
_KQ = f"WITH {TITLES_SQL}, kq AS (SELECT keywords[2] AS keyword, floor(avg(score % 10) + 0.5) AS q, count(*) AS n FROM titles GROUP BY 1), o AS (SELECT id, unnest(list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '-'), lambda w: length(w) > 3))) AS keyword FROM titles)"


def _keyword_quality(s, d):
    t = V.titles(s, d)
    kq = t.groupBy(F.get("keywords", 1).alias("keyword")).agg(S.js_round(F.avg(F.col("score") % 10)).alias("q"), F.count("*").alias("n"))
    words = F.array_distinct(F.filter(F.split(S.slugify(F.col("title")), "-"), lambda w: F.length(w) > 3))
    found = t.select("id", F.explode(words).alias("keyword")).join(kq, "keyword", "left")
    return found.groupBy("id").agg(F.coalesce(S.js_round(F.sum(F.col("q") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))), F.lit(5)).alias("quality"))


query("agg_weighted_quality", f"{_KQ} SELECT id, coalesce(CAST(floor(sum(q * n) / nullif(sum(n), 0) + 0.5) AS BIGINT), 5) AS quality FROM o LEFT JOIN kq USING (keyword) GROUP BY 1")(_keyword_quality)
query("join_keyword_sources", f"{_KQ}, ks AS (SELECT DISTINCT keywords[2] AS keyword, source FROM titles) SELECT id, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM o LEFT JOIN ks USING (keyword) GROUP BY 1")(
    lambda s, d: _keyword_sources(s, d)
)


def _keyword_sources(s, d):
    t = V.titles(s, d)
    known = t.groupBy(F.get("keywords", 1).alias("keyword")).agg(F.array_sort(F.collect_set("source")).alias("sources"))  # four at most
    words = t.select("id", F.explode(F.array_distinct(F.filter(F.split(S.slugify(F.col("title")), "-"), lambda w: F.length(w) > 3))).alias("keyword"))
    found = words.join(known, "keyword", "left").select("id", F.explode_outer("sources").alias("source"))
    return found.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


query("agg_prediction_stats", f"{OP} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'draft') AS draft, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'failed') AS failed FROM predictions")(
    lambda s, d: V.predictions(s, d).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == x).alias(x) for x in ("draft", "pending", "confirmed", "failed")])
)
query("agg_avg_lead_time", "SELECT round(coalesce(avg(CASE WHEN o_orderkey % 4 > 0 THEN floor((epoch_us(TIMESTAMP '2001-06-01') - epoch_us(o_orderdate)) / 86400e6) END), 0), 6) AS days FROM orders")(
    lambda s, d: table(s, d, "orders").agg(F.round(F.coalesce(F.avg(F.when(F.col("o_orderkey") % 4 > 0, F.floor(S.age_days(F.col("o_orderdate"), "2001-06-01")))), F.lit(0.0)), 6).alias("days"))
)
query("agg_keyword_velocity", f"WITH {TITLES_SQL}, k AS (SELECT DISTINCT id, created_at, unnest(keywords) AS keyword FROM titles), c AS (SELECT keyword, count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 7 DAY) AS c7, count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 14 DAY) AS c14 FROM k GROUP BY 1) SELECT *, CASE WHEN c7 > c14 / 2 THEN 'accelerating' WHEN c7 = floor(c14 / 2 + 0.5) THEN 'peaking' ELSE 'fading' END AS status FROM c")(
    lambda s, d: V.titles(s, d).select("id", "created_at", F.explode(F.array_distinct("keywords")).alias("keyword")).groupBy("keyword").agg(F.count_if(F.col("created_at") >= S.days_before(AS_OF, 7)).alias("c7"), F.count_if(F.col("created_at") >= S.days_before(AS_OF, 14)).alias("c14")).withColumn("status", S.keyword_velocity_status(F.col("c7"), F.col("c14")))
)
_hits = ", ".join(f"{' + '.join(f'CAST(contains(lower(title), {chr(39)}{w}{chr(39)}) AS INT)' for w in ws)} AS {k}" for k, ws in R.MACRO_DRIVERS.items())
_MAC = f"WITH {TITLES_SQL}, h AS (SELECT id, source, id % 50 AS g, {_hits} FROM titles), f AS (" + " UNION ALL ".join(f"SELECT g, '{k}' AS driver, {i} AS place, id, {k} AS n FROM h" for i, k in enumerate(R.MACRO_DRIVERS)) + "), t AS (SELECT g, driver, sum(n) AS n, min(id * 10 + place) AS first FROM f WHERE n > 0 GROUP BY 1, 2), b AS (SELECT g, driver, row_number() OVER (PARTITION BY g ORDER BY n DESC, first) AS r FROM t), macro AS (SELECT g, driver FROM b WHERE r = 1) "


def _macro(s, d):
    t = V.titles(s, d)
    drivers = [F.struct(F.lit(k).alias("driver"), F.lit(i).alias("place"), S.count_contained(F.lower("title"), w).alias("n")) for i, (k, w) in enumerate(R.MACRO_DRIVERS.items())]
    hits = t.select((F.col("id") % 50).alias("g"), "id", F.explode(F.array(*drivers)).alias("e")).filter("e.n > 0")
    total = hits.groupBy("g", "e.driver").agg(F.sum("e.n").alias("n"), F.min(F.col("id") * 10 + F.col("e.place")).alias("first"))
    return total.groupBy("g").agg(F.min_by("driver", F.struct((-F.col("n")).alias("n"), "first")).alias("driver"))


query("agg_macro_driver", f"{_MAC} SELECT g, driver FROM macro")(_macro)
query("macro_driver", f"{_MAC} SELECT g, driver FROM macro")(_macro)
query("agg_macro_hist", f"{_MAC} SELECT driver, count(*) AS n FROM macro GROUP BY 1")(lambda s, d: _macro(s, d).groupBy("driver").agg(F.count("*").alias("n")))
query("agg_word_freq", f"WITH {TITLES_SQL}, w AS (SELECT unnest(string_split_regex(lower(title), '[^a-z0-9]+')) AS word FROM titles) SELECT word, count(*) AS n FROM w WHERE length(word) >= 4 AND NOT list_contains({V.sql_list(R.CONCEPT_STOPWORDS)}, word) GROUP BY 1 ORDER BY n DESC, word LIMIT 25")(
    lambda s, d: V.titles(s, d).select(F.explode(F.split(F.lower("title"), "[^a-z0-9]+")).alias("word")).filter((F.length("word") >= 4) & ~F.col("word").isin(R.CONCEPT_STOPWORDS)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)
)
query("agg_group_primary", f"{_OPP}, g AS (SELECT source AS slug, id, final_score, row_number() OVER (PARTITION BY source ORDER BY final_score DESC, id) AS r, count(*) OVER (PARTITION BY source) AS n FROM scored) SELECT slug, id, final_score, n FROM g WHERE r = 1")(
    lambda s, d: opportunity_scores(s, d).groupBy(F.col("source").alias("slug")).agg(F.min_by(F.struct("id", "final_score"), F.struct((-F.col("final_score")).alias("a"), "id")).alias("b"), F.count("*").alias("n")).select("slug", "b.id", "b.final_score", "n")
)
query("agg_usage_month", f"SELECT user_id, event_type AS action, count(*) AS used FROM events WHERE ts >= date_trunc('month', {NOW}) GROUP BY 1, 2")(
    lambda s, d: table(s, d, "events").filter(F.col("ts") >= F.date_trunc("month", S.moment(AS_OF))).groupBy("user_id", F.col("event_type").alias("action")).agg(F.count("*").alias("used"))
)
query("table_stats", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "part", "events", "customer")))(
    lambda s, d: reduce(lambda a, b: a.unionByName(b), [table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "part", "events", "customer")])
)

# ---------------------------------------------------------------- history

H = f"WITH {HISTORY_SQL} "
query("win_history_last5", f"{H} SELECT trend_slug, recorded_at, score FROM (SELECT *, row_number() OVER (PARTITION BY trend_slug ORDER BY recorded_at DESC) AS r FROM history) WHERE r <= 5")(lambda s, d: history.last(V.history(s, d), 5).select("trend_slug", "recorded_at", "score"))
query("win_dedupe_by_day", f"WITH e AS (SELECT event_type || '-' || (user_id % 20) AS trend_slug, CAST(ts AS DATE) AS day, ts AS recorded_at, CAST(floor(value) AS BIGINT) AS score, event_id, row_number() OVER (PARTITION BY event_type || '-' || (user_id % 20), CAST(ts AS DATE) ORDER BY ts DESC, event_id) AS r FROM events) SELECT trend_slug, day, event_id, score FROM e WHERE r = 1")(
    lambda s, d: history.daily(table(s, d, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string")).alias("trend_slug"), F.col("ts").alias("recorded_at"), F.floor("value").alias("score"), "event_id"), "event_id").select("trend_slug", "day", "event_id", "score")
)
_LIFE = f"""{H}, p AS (SELECT trend_slug, score, day, row_number() OVER (PARTITION BY trend_slug ORDER BY day DESC) AS r, count(*) OVER (PARTITION BY trend_slug) AS n FROM history),
  l AS (SELECT trend_slug, max(n) AS n, max(CASE WHEN r = 1 THEN score END) AS s3, max(CASE WHEN r = 2 THEN score END) AS s2, max(CASE WHEN r = 3 THEN score END) AS s1 FROM p GROUP BY 1),
  life AS (SELECT trend_slug, CASE WHEN n < 3 THEN 'emerging' WHEN (s3 - s1) / 2 > 3 THEN 'rising' WHEN (s3 - s1) / 2 < -3 THEN 'declining' WHEN abs(s3 - s2) <= 3 AND s3 >= 50 THEN 'peaking' ELSE 'emerging' END AS lifecycle FROM l) """
query("win_lifecycle", f"{_LIFE} SELECT * FROM life")(lambda s, d: history.lifecycle(V.history(s, d)))
query("agg_lifecycle_hist", f"{_LIFE} SELECT lifecycle, count(*) AS n FROM life GROUP BY 1")(lambda s, d: history.lifecycle(V.history(s, d)).groupBy("lifecycle").agg(F.count("*").alias("n")))
query("lifecycle_tab", f"{_LIFE} SELECT trend_slug FROM life WHERE lifecycle = 'rising'")(lambda s, d: history.lifecycle(V.history(s, d)).filter("lifecycle = 'rising'").select("trend_slug"))
query("win_history_velocity", f"{H}, p AS (SELECT *, row_number() OVER (PARTITION BY trend_slug ORDER BY day DESC) AS r FROM history), q AS (SELECT trend_slug, count(*) AS n, arg_max(score, day) - arg_min(score, day) AS rise, (epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 86400e6 AS days FROM p WHERE r <= 5 GROUP BY 1) SELECT trend_slug, CASE WHEN n < 2 THEN 0 ELSE floor(rise / greatest(1.0, days) * 100 + 0.5) / 100 END AS velocity FROM q")(lambda s, d: history.velocity(V.history(s, d)))
query("win_lifecycle_change", f"{_LIFE}, old AS (SELECT trend_slug, CASE WHEN length(trend_slug) % 2 = 0 THEN 'rising' END AS lifecycle FROM life) SELECT life.trend_slug, old.lifecycle AS previous, life.lifecycle FROM life LEFT JOIN old USING (trend_slug) WHERE life.lifecycle IS DISTINCT FROM old.lifecycle")(
    lambda s, d: (lambda new: history.changes(new, new.select("trend_slug", F.when(F.length("trend_slug") % 2 == 0, "rising").alias("lifecycle"), F.lit(1).alias("at")), "at"))(history.lifecycle(V.history(s, d)))
)
query("win_lifecycle_transitions", f"{H}, b AS (SELECT trend_slug, day, CASE WHEN score < 25 THEN 'emerging' WHEN score < 60 THEN 'rising' WHEN score < 85 THEN 'peaking' ELSE 'declining' END AS band FROM history), t AS (SELECT *, lag(band) OVER (PARTITION BY trend_slug ORDER BY day) AS previous FROM b) SELECT * FROM t WHERE previous <> band")(
    lambda s, d: history.transitions(V.history(s, d).select("trend_slug", "day", S.score_band(F.col("score")).alias("band")), "band", "day")
)
query("history_range", f"{H} SELECT trend_slug, recorded_at, score FROM history WHERE trend_slug = 'click-3' AND recorded_at >= {NOW} - INTERVAL 90 DAY")(lambda s, d: V.history(s, d).filter((F.col("trend_slug") == "click-3") & (F.col("recorded_at") >= S.days_before(AS_OF, 90))).select("trend_slug", "recorded_at", "score"))
query("slug_search", f"{H} SELECT DISTINCT trend_slug FROM history WHERE contains(lower(trend_slug), 'ick-1')")(lambda s, d: V.history(s, d).filter(F.lower("trend_slug").contains("ick-1")).select("trend_slug").distinct())
query("distinct_slugs", f"{H} SELECT DISTINCT trend_slug FROM history")(lambda s, d: V.history(s, d).select("trend_slug").distinct())
query("sink_history_append", f"{H} SELECT trend_slug, count(*) AS n, max(score) AS score FROM (SELECT * FROM history UNION ALL SELECT * FROM history) GROUP BY 1")(lambda s, d: _appended(s, d).groupBy("trend_slug").agg(F.count("*").alias("n"), F.max("score").alias("score")))


def _appended(s, d):
    """A day's history written, appended once more, and read back."""
    path = new_path(s, "history")
    for _ in range(2):
        sinks.append(V.history(s, d), path)
    return s.read.schema(V.history(s, d).schema).parquet(path)


query("rising_fast", f"{_LIFE}, v AS (SELECT trend_slug, max(score) AS score FROM history GROUP BY 1) SELECT trend_slug, score FROM life JOIN v USING (trend_slug) WHERE lifecycle IN ('emerging', 'rising')")(
    lambda s, d: history.lifecycle(V.history(s, d)).join(V.history(s, d).groupBy("trend_slug").agg(F.max("score").alias("score")), "trend_slug").filter(F.col("lifecycle").isin("emerging", "rising")).select("trend_slug", "score")
)

# ---------------------------------------------------------------- opportunities and predictions

query("anti_existing_predictions", f"{OP} SELECT id FROM opportunities WHERE confidence > 60 AND id NOT IN (SELECT opportunity_id FROM predictions)")(lambda s, d: predictions.unpredicted(V.opportunities(s, d).filter("confidence > 60"), V.predictions(s, d)).select("id"))
query("anti_existing_drafts", f"{OP} SELECT id FROM opportunities WHERE confidence >= 70 AND id NOT IN (SELECT opportunity_id FROM predictions WHERE status = 'draft')")(lambda s, d: predictions.unpredicted(V.opportunities(s, d).filter("confidence >= 70"), V.predictions(s, d).filter("status = 'draft'")).select("id"))
query("anti_open_prediction_by_title", f"{OP} SELECT id FROM opportunities WHERE title NOT IN (SELECT title FROM predictions JOIN opportunities o ON o.id = opportunity_id WHERE status <> 'failed')")(
    lambda s, d: V.opportunities(s, d).join(V.predictions(s, d).filter("status <> 'failed'").join(V.opportunities(s, d).select(F.col("id").alias("opportunity_id"), "title"), "opportunity_id").select("title"), "title", "left_anti").select("id")
)
query("join_prediction_opportunity_left", f"{OP} SELECT p.id, status, o.title, o.confidence FROM predictions p LEFT JOIN opportunities o ON o.id = opportunity_id")(lambda s, d: predictions.enriched(V.predictions(s, d), V.opportunities(s, d)).select("id", "status", "opportunity.title", "opportunity.confidence"))
query("join_prediction_opportunity_enrich", f"{OP} SELECT p.id, o.category FROM predictions p LEFT JOIN opportunities o ON o.id = opportunity_id")(lambda s, d: predictions.enriched(V.predictions(s, d), V.opportunities(s, d)).select("id", "opportunity.category"))
query("join_drafts_current_opp", f"{OP} SELECT p.id, confidence FROM predictions p JOIN opportunities o ON o.id = opportunity_id WHERE status = 'draft'")(lambda s, d: V.predictions(s, d).filter("status = 'draft'").join(V.opportunities(s, d).select(F.col("id").alias("opportunity_id"), "confidence"), "opportunity_id").select("id", "confidence"))
query("join_opportunity_cluster", f"{OP} SELECT id, n_name AS label, confidence FROM opportunities JOIN nation ON n_nationkey = cluster_id ORDER BY confidence DESC, id LIMIT 20")(lambda s, d: V.opportunities(s, d).join(F.broadcast(table(s, d, "nation")), F.col("n_nationkey") == F.col("cluster_id")).orderBy(F.desc("confidence"), "id").select("id", F.col("n_name").alias("label"), "confidence").limit(20))
query("top_opportunities", f"{OP} SELECT id, confidence FROM opportunities ORDER BY confidence DESC, id LIMIT 20")(lambda s, d: V.opportunities(s, d).orderBy(F.desc("confidence"), "id").select("id", "confidence").limit(20))
query("candidate_opportunities", f"{OP} SELECT id, confidence FROM opportunities WHERE confidence > 60 ORDER BY confidence DESC, id LIMIT 50")(lambda s, d: V.opportunities(s, d).filter("confidence > 60").orderBy(F.desc("confidence"), "id").select("id", "confidence").limit(50))
query("digest_top5", f"{OP} SELECT id, confidence FROM opportunities ORDER BY confidence DESC, id LIMIT 5")(lambda s, d: V.opportunities(s, d).orderBy(F.desc("confidence"), "id").select("id", "confidence").limit(5))
query("top_predictions", f"{OP} SELECT p.id, drafted_at, confidence FROM predictions p JOIN opportunities o ON o.id = opportunity_id ORDER BY drafted_at DESC, confidence DESC, p.id LIMIT 20")(
    lambda s, d: predictions.enriched(V.predictions(s, d), V.opportunities(s, d)).filter("opportunity IS NOT NULL").select("id", "drafted_at", "opportunity.confidence").orderBy(F.desc("drafted_at"), F.desc("confidence"), "id").limit(20)
)
query("predictions_filter", f"{OP} SELECT id FROM predictions WHERE is_published AND status = 'pending'")(lambda s, d: predictions.where(V.predictions(s, d), published=True, status="pending").select("id"))
query("distinct_opportunity_ids", f"{OP} SELECT DISTINCT opportunity_id FROM predictions")(lambda s, d: V.predictions(s, d).select("opportunity_id").distinct())
query("draft_predictions_v1", f"{OP} SELECT id AS opportunity_id, 'draft' AS status, confidence AS draft_score FROM opportunities WHERE confidence >= 70 AND id % 10 >= 5 AND id NOT IN (SELECT opportunity_id FROM predictions)")(
    lambda s, d: predictions.draft(V.opportunities(s, d).withColumn("n_signals", F.col("id") % 10), V.predictions(s, d), AS_OF).select("opportunity_id", "status", "draft_score")
)
query("draft_predictions_enriched", f"{OP} SELECT id AS opportunity_id, confidence AS draft_score FROM opportunities WHERE confidence > 70 AND id % 10 >= 5 AND id NOT IN (SELECT opportunity_id FROM predictions)")(
    lambda s, d: predictions.draft(V.opportunities(s, d).withColumn("n_signals", F.col("id") % 10), V.predictions(s, d), AS_OF, least=71).select("opportunity_id", "draft_score")
)
query("generate_predictions_v2", f"{OP} SELECT id AS opportunity_id, 'We predict that ' || title || ' will gain traction.' AS prediction_text FROM opportunities WHERE confidence > 60 AND id NOT IN (SELECT opportunity_id FROM predictions)")(
    lambda s, d: predictions.unpredicted(V.opportunities(s, d).filter("confidence > 60"), V.predictions(s, d)).select(F.col("id").alias("opportunity_id"), F.concat(F.lit("We predict that "), "title", F.lit(" will gain traction.")).alias("prediction_text"))
)
_CUT = f"TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 72 HOUR"
query("promote_drafts", f"{OP} SELECT p.id, CASE WHEN status = 'draft' AND NOT is_published AND drafted_at < {_CUT} AND confidence >= 60 AND o.id % 10 >= draft_signal_count THEN 'pending' ELSE status END AS status FROM predictions p LEFT JOIN opportunities o ON o.id = opportunity_id")(
    lambda s, d: predictions.promote(V.predictions(s, d), V.opportunities(s, d).withColumn("n_signals", F.col("id") % 10), AS_OF_ORDERS).select("id", "status")
)
query("promote_or_expire", f"{OP} SELECT p.id, CASE WHEN drafted_at < {_CUT} AND confidence >= 60 AND o.id % 10 >= draft_signal_count THEN 'pending' WHEN drafted_at < {_CUT} AND confidence < 60 THEN 'failed' ELSE status END AS status FROM predictions p LEFT JOIN opportunities o ON o.id = opportunity_id")(
    lambda s, d: predictions.promote_or_expire(V.predictions(s, d), V.opportunities(s, d).withColumn("n_signals", F.col("id") % 10), AS_OF_ORDERS).select("id", "status")
)
query("verify_prediction", f"{OP} SELECT id, CASE WHEN id % 7 = 0 AND is_published THEN 'confirmed' ELSE status END AS status FROM predictions")(lambda s, d: predictions.verify(V.predictions(s, d), F.col("id") % 7 == 0, "confirmed").select("id", "status"))
query("verify_status_check", f"{OP} SELECT id, status IN ('confirmed', 'partially_confirmed', 'failed') AS valid FROM predictions")(lambda s, d: V.predictions(s, d).select("id", F.col("status").isin(*predictions.OUTCOMES).alias("valid")))
_CHOSEN = "id % 4 = 0"
query("publish", f"{OP} SELECT id, CASE WHEN {_CHOSEN} AND status = 'draft' THEN 'pending' ELSE status END AS status, is_published OR ({_CHOSEN} AND status = 'draft') AS is_published, CASE WHEN {_CHOSEN} AND status = 'draft' THEN TIMESTAMP '{AS_OF_ORDERS}' ELSE drafted_at END AS drafted_at FROM predictions")(
    lambda s, d: predictions.publish(V.predictions(s, d), F.expr(_CHOSEN), AS_OF_ORDERS).select("id", "status", "is_published", "drafted_at")
)
query("discard", f"{OP} SELECT id, status FROM predictions WHERE NOT ({_CHOSEN} AND status = 'draft')")(lambda s, d: predictions.discard(V.predictions(s, d), F.expr(_CHOSEN)).select("id", "status"))
query("delete", f"{OP} SELECT id, status FROM predictions WHERE NOT ({_CHOSEN})")(lambda s, d: predictions.delete(V.predictions(s, d), F.expr(_CHOSEN)).select("id", "status"))
query("delete_old_opportunities", f"SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 30 DAY")(lambda s, d: table(s, d, "orders").filter(F.col("o_orderdate") >= S.days_before(AS_OF_ORDERS, 30)).select("o_orderkey"))
query("page_capped", f"{OP}, r AS (SELECT id, row_number() OVER (ORDER BY confidence DESC, id) AS n FROM (SELECT * FROM opportunities ORDER BY confidence DESC, id LIMIT 20)) SELECT id, n, 20 AS total, 2 AS pages FROM r WHERE n BETWEEN 11 AND 20")(
    lambda s, d: predictions.page(V.opportunities(s, d), [F.desc("confidence"), "id"], R.PLAN_CAPS["founder"], 2).select("id", "n", "total", "pages")
)
query("pick_by_index", f"{OP}, r AS (SELECT id, row_number() OVER (ORDER BY confidence DESC, id) - 1 AS i FROM (SELECT * FROM opportunities ORDER BY confidence DESC, id LIMIT 20)) SELECT id, i FROM r WHERE i IN (0, 3, 19)")(
    lambda s, d: predictions.page(V.opportunities(s, d), [F.desc("confidence"), "id"], 20, 1, 20).withColumn("i", F.col("n") - 1).filter(F.col("i").isin(0, 3, 19)).select("id", "i")
)
query("plan_gate", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'founder' WHEN 2 THEN 'pro' ELSE 'agency' END AS plan FROM customer WHERE c_custkey % 4 >= 2 AND c_acctbal > 0")(
    lambda s, d: table(s, d, "customer").select("c_custkey", "c_acctbal", F.get(F.array(*map(F.lit, R.PLAN_CAPS)), (F.col("c_custkey") % 4).cast("int")).alias("plan")).filter(F.col("plan").isin("pro", "agency") & (F.col("c_acctbal") > 0)).select("c_custkey", "plan")
)
query("distinct_trend_name", f"{OP} SELECT lower(title) AS name, min(id) AS id FROM opportunities GROUP BY 1")(lambda s, d: V.opportunities(s, d).groupBy(F.lower("title").alias("name")).agg(F.min("id").alias("id")))
query("similarity_join_jaccard", f"WITH {TITLES_SQL}, t AS (SELECT id, list_distinct(list_filter(string_split_regex(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({V.sql_list(R.OPPORTUNITY_STOPWORDS)}, w))) AS w FROM titles), x AS (SELECT id, len(w) AS n, unnest(w) AS k FROM t), c AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS s FROM x a JOIN x b ON a.k = b.k AND a.id < b.id GROUP BY 1, 2), p AS (SELECT a, b FROM c WHERE s / (m + n - s) >= 0.55) SELECT id, count(*) AS n_links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY 1")(
    lambda s, d: predictions.similar_counts(V.titles(s, d), F.col("title"))
)
query("jaccard", f"WITH {TITLES_SQL} SELECT id, round(len(list_intersect(keywords, [source, 'hn:', 'for'])) / len(list_distinct(list_concat(keywords, [source, 'hn:', 'for']))), 6) AS j FROM titles")(
    lambda s, d: V.titles(s, d).withColumn("o", F.array("source", F.lit("hn:"), F.lit("for"))).select("id", F.round(F.size(F.array_intersect("keywords", "o")) / F.size(F.array_union("keywords", "o")), 6).alias("j"))
)
query("keyword_overlap", f"WITH {TITLES_SQL} SELECT id, round(len(list_filter(keywords, lambda k: list_contains([source, 'hn:'], k))) / len(list_distinct(list_concat(keywords, [source, 'hn:']))), 6) AS overlap FROM titles")(
    lambda s, d: V.titles(s, d).select("id", F.round(signals.keyword_overlap(F.col("keywords"), F.array("source", F.lit("hn:"))), 6).alias("overlap"))
)
query("dedupe_signals")(lambda s, d: signals.dedupe(V.titles(s, d).withColumnRenamed("score", "source_score").withColumn("duplicate_count", F.lit(0)), "id").select("id", "duplicate_count"))
# every list of keywords has three words here, so the rows of a list are one class
query(
    "similarity_join_title",
    f"""WITH {TITLES_SQL}, t AS (SELECT id, lower(trim(title)) AS t, keywords AS k FROM titles), r AS MATERIALIZED (SELECT t, count(*) AS w FROM t GROUP BY 1),
    half AS MATERIALIZED (SELECT a.t AS x, b.t AS y, a.w AS v, b.w AS w FROM r a JOIN r b ON a.t < b.t AND 5 * length(a.t) > 3 * length(b.t) AND 5 * length(b.t) > 3 * length(a.t) AND 5 * levenshtein(a.t, b.t) < 2 * greatest(length(a.t), length(b.t))),
    near AS (SELECT x, sum(w) AS n FROM (SELECT x, w FROM half UNION ALL SELECT y, v FROM half) GROUP BY 1), l AS (SELECT k, min(id) AS low FROM t GROUP BY 1),
    kp AS MATERIALIZED (SELECT a.k AS x, b.k AS y FROM l a, l b WHERE len(a.k) > 2 AND len(list_filter(a.k, lambda v: list_contains(b.k, v))) / len(list_distinct(list_concat(a.k, b.k))) > 0.5),
    words AS (SELECT id, count(*) AS n FROM (SELECT unnest([a.id, b.id]) AS id FROM t a JOIN kp ON a.k = kp.x JOIN t b ON b.k = kp.y AND a.id < b.id) GROUP BY 1),
    tk AS MATERIALIZED (SELECT DISTINCT t, k FROM t), e AS MATERIALIZED (SELECT DISTINCT a.k AS x, b.k AS y FROM half JOIN tk a ON a.t = half.x JOIN tk b ON b.t = half.y UNION SELECT a.k, b.k FROM tk a JOIN tk b USING (t) UNION SELECT x, y FROM kp),
    g AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e), c AS (WITH RECURSIVE walk AS (SELECT x, y FROM g UNION SELECT walk.x, g.y FROM walk JOIN g ON g.x = walk.y) SELECT x AS k, min(low) AS class_id FROM walk JOIN l ON l.k = walk.y GROUP BY 1)
    SELECT t.id, CAST(r.w - 1 + coalesce(near.n, 0) AS BIGINT) AS n_title_links, coalesce(words.n, 0) AS n_keyword_links, class_id FROM t JOIN r USING (t) LEFT JOIN near ON near.x = t.t LEFT JOIN words USING (id) JOIN c USING (k)""",
)(lambda s, d: titles.links(V.titles(s, d)))
query("dedupe_opportunities")(lambda s, d: predictions.dedupe(V.titles(s, d).withColumn("score", F.struct((-F.col("score")).alias("s"), "id")), F.col("title"), "score").select("id", "title"))

# ---------------------------------------------------------------- sets and merges

query("union_sources", f"WITH {TITLES_SQL} SELECT id, source FROM titles WHERE source = 'reddit' UNION ALL SELECT id, source FROM titles WHERE source = 'github'")(
    lambda s, d: signals.union_feeds([V.titles(s, d).filter(F.col("source") == x) for x in ("reddit", "github")]).select("id", "source")
)
query("distinct_by_key", f"WITH {TITLES_SQL} SELECT source, keywords[1] AS k, arg_max(title, id) AS title, min(id) AS id FROM titles GROUP BY 1, 2")(
    lambda s, d: signals.distinct_by_key(V.titles(s, d).select("source", F.get("keywords", 0).alias("k"), "title", "id"), ["source", "k"], "id")
)
query("normalize_signals", f"WITH {TITLES_SQL} SELECT CAST(id AS VARCHAR) AS id, title, engagement + 2 * score AS engagement, score AS source_score FROM titles")(
    lambda s, d: signals.normalize(V.titles(s, d).withColumns({"score_ranking": F.col("score"), "descendants": F.col("score"), "score": F.col("engagement"), "inferred_pain_point": F.lit(None).cast("string"), "url": F.lit("")}), "hackernews").select("id", "title", "engagement", "source_score")
)
_UP = f"WITH {TITLES_SQL}, o AS (SELECT * FROM titles WHERE id % 3 > 0), n AS (SELECT id, 'new ' || title AS title, source, created_at + INTERVAL 1 DAY AS created_at FROM titles WHERE id % 2 = 0)"


def _upserted(s, d):
    t = V.titles(s, d).select("source", "id", "title", F.col("created_at").alias("collected_at"))
    new = t.filter("id % 2 = 0").withColumns({"title": F.concat(F.lit("new "), "title"), "collected_at": F.col("collected_at") + F.expr("INTERVAL 1 DAY")})
    return signals.upsert(t.filter("id % 3 > 0"), new, ["source", "id"], ["collected_at"])


_UPS = f"{_UP} SELECT coalesce(o.source, n.source) AS source, coalesce(o.id, n.id) AS id, coalesce(o.title, n.title) AS title, coalesce(n.created_at, o.created_at) AS collected_at FROM o FULL JOIN n ON o.id = n.id"
query("upsert_signals", _UPS)(_upserted)
query("sink_signals_upsert", f"SELECT source, count(*) AS n, max(collected_at) AS latest FROM ({_UPS}) GROUP BY 1")(lambda s, d: _upserted(s, d).groupBy("source").agg(F.count("*").alias("n"), F.max("collected_at").alias("latest")))
query("insert_mentions_ignore", f"{MS} SELECT signal_id, concept_id FROM mentions")(
    lambda s, d: signals.insert_ignore(V.mentions(s, d).filter("concept_id % 2 = 0"), V.mentions(s, d), ["signal_id", "concept_id"]).select("signal_id", "concept_id")
)
# the stored table holds each concept's mentions of even signals; those of odd signals are merged into it
query("upsert_concepts", f"WITH {EVENTS_SQL} SELECT concept_id, count(*) AS mention_count, min(collected_at) AS first_seen, max(collected_at) AS last_seen FROM ev GROUP BY 1")(
    lambda s, d: concepts.merge_nodes(*[concepts.nodes_of(V.event_mentions(s, d).filter(F.col("signal_id") % 2 == k), V.event_signals(s, d)) for k in (0, 1)]).select("concept_id", "mention_count", "first_seen", "last_seen")
)
query("upsert_edges", f"{_E} SELECT concept_a, concept_b, total_weight, first_seen, last_seen, signal_count FROM edges")(
    lambda s, d: (lambda n: concepts.merge_edges(*[concepts.edges(_snaps(s, d).filter(F.col("signal_id") % 2 == k), parts=n) for k in (0, 1)]))(_spread(s, d)).select("concept_a", "concept_b", "total_weight", "first_seen", "last_seen", "signal_count")
)
query("edge_maintenance", f"{_E}, k AS (SELECT * FROM snaps WHERE NOT (signal_id % 5 = 0 AND signal_id % 4 < 3)), s AS (SELECT concept_a, concept_b, string_agg(source || '=' || n, ',' ORDER BY source) AS by_source FROM (SELECT concept_a, concept_b, source, count(*) AS n FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT concept_a, concept_b, count(*) AS total_weight, count(DISTINCT signal_id) AS signal_count, min(created_at) AS first_seen, max(created_at) AS last_seen, any_value(by_source) AS by_source FROM k JOIN s USING (concept_a, concept_b) GROUP BY 1, 2")(
    lambda s, d: _edges_maintained(s, d)
)


def _edges_maintained(s, d):
    """Three quarters of the signals are stored; the others come, and every fifth of those stored goes with its snapshots."""
    every, parts = _snaps(s, d), _spread(s, d)
    stored, gone = F.col("signal_id") % 4 < 3, F.col("signal_id") % 5 == 0
    table_ = concepts.edges(every.filter(stored), parts=parts)
    return concepts.maintained_edges(table_, every.filter(~stored), every.filter(stored & gone), every.filter(~(stored & gone)), parts).withColumn("by_source", _shown()).drop("source_distribution")


query("upsert_velocity", f"{_VEL} SELECT concept_id, coalesce(velocity_7d, 0) AS velocity_7d FROM vel")(
    lambda s, d: (lambda v: signals.upsert(v.filter("concept_id % 2 = 0").withColumn("velocity_7d", F.lit(9.0)), v, ["concept_id"], ["velocity_7d"]))(_velocity(s, d).select("concept_id", "velocity_7d"))
)
query("upsert_metric", "SELECT 'orders' AS key, count(*) AS value FROM orders UNION ALL SELECT 'parts', 1")(
    lambda s, d: signals.upsert(s.createDataFrame([("orders", 0), ("parts", 1)], "key string, value bigint"), table(s, d, "orders").agg(F.lit("orders").alias("key"), F.count("*").alias("value")), ["key"], ["value"])
)
query("join_raw_persisted", f"WITH {TITLES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN id + 1000000 WHEN id % 3 = 1 THEN id + 2000000 END AS signal_id FROM titles")(
    lambda s, d: (
        lambda t: signals.match_persisted(
            t.select("source", F.col("id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("external_id"), F.lit("u").alias("url")).withColumn("id", F.col("id").cast("string")),
            t.filter("id % 3 = 0").select("source", F.concat(F.lit("x"), F.col("id").cast("string")).alias("external_id"), (F.col("id") + 1000000).alias("id")).unionByName(t.filter("id % 3 = 1").select("source", F.col("id").cast("string").alias("external_id"), (F.col("id") + 2000000).alias("id"))),
        ).select(F.col("id").cast("bigint").alias("id"), "signal_id")
    )(V.titles(s, d))
)
query("cascade_delete", f"{MS} SELECT concept_id, count(*) AS n FROM mentions WHERE signal_id % 5 > 0 GROUP BY 1")(
    lambda s, d: V.mentions(s, d).join(V.signals(s, d).filter("signal_id % 5 = 0").select("signal_id"), "signal_id", "left_anti").groupBy("concept_id").agg(F.count("*").alias("n"))
)
_SUBS = "subs AS (SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN ['click', 'view', 'purchase', 'signup'][1 + c_custkey % 4] || '-' || (c_custkey % 20) END AS trend_slug FROM customer)"


def _subscriptions(s, d):
    """Each customer follows one trend, every tenth all of them."""
    k = F.col("c_custkey")
    slug = F.concat_ws("-", F.get(F.array(*map(F.lit, ("click", "view", "purchase", "signup"))), (k % 4).cast("int")), (k % 20).cast("string"))
    return table(s, d, "customer").select(k, F.when(k % 10 > 0, slug).alias("trend_slug"))


query("digest_batch", f"{H}, {_SUBS}, c AS (SELECT trend_slug, max(recorded_at) AS changed_at FROM history GROUP BY 1), due AS (SELECT * FROM c WHERE changed_at >= {NOW} - INTERVAL 7 DAY AND strpos(trend_slug, '-1') = 0) SELECT c_custkey, due.trend_slug FROM due JOIN subs ON subs.trend_slug IS NULL OR subs.trend_slug = due.trend_slug")(
    lambda s, d: sinks.due(V.history(s, d).groupBy("trend_slug").agg(F.max("recorded_at").alias("changed_at")).withColumn("notified", F.col("trend_slug").contains("-1")), _subscriptions(s, d), AS_OF).select("c_custkey", "trend_slug")
)
# equal pairs of customer and trend are ignored, but a null trend equals none: such rows are inserted anew
query("subscribe_ignore", f"WITH {_SUBS} SELECT c_custkey, trend_slug FROM subs UNION ALL SELECT c_custkey, trend_slug FROM subs WHERE trend_slug IS NULL")(
    lambda s, d: signals.insert_ignore(_subscriptions(s, d), _subscriptions(s, d), ["c_custkey", "trend_slug"]).select("c_custkey", "trend_slug")
)
# deleting a conversation takes its messages first; those left are listed with the number of theirs, the newest first
query("chat_deletion", "SELECT conv_id, count(*) AS messages, row_number() OVER (ORDER BY conv_id DESC) AS place FROM conversations WHERE conv_id % 3 > 0 GROUP BY 1 ORDER BY conv_id DESC LIMIT 50")(lambda s, d: _chats_left(s, d))


def _chats_left(s, d):
    messages = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    chats = messages.select("conv_id").distinct()
    gone = chats.filter("conv_id % 3 = 0")
    left = messages.join(gone, "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("messages"))
    listed = chats.join(gone, "conv_id", "left_anti").join(left, "conv_id", "left").select("conv_id", F.coalesce("messages", F.lit(0)).alias("messages"))
    return listed.orderBy(F.desc("conv_id")).limit(50).withColumn("place", F.row_number().over(Window.orderBy(F.desc("conv_id"))))


query("chat_messages", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, role, text FROM conversations")(
    lambda s, d: table(s, d, "conversations").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")).select("conv_id", "place", "role", "text")
)
query("signal_snapshot", f"WITH {TITLES_SQL} SELECT source, CAST(floor(id / 200) AS BIGINT) AS page, string_agg(id || ':' || title, '|' ORDER BY id) AS snapshot FROM titles GROUP BY 1, 2")(
    lambda s, d: V.titles(s, d).groupBy("source", F.floor(F.col("id") / 200).alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "title"))), lambda e: F.concat_ws(":", e["id"].cast("string"), e["title"])), "|").alias("snapshot"))
)
query("jsonb_array_length", f"WITH {TITLES_SQL} SELECT id, CAST(len(string_split(title, ' ')) AS INT) AS n FROM titles")(lambda s, d: V.titles(s, d).select("id", F.size(F.split("title", " ")).alias("n")))
query("win_best_of_cluster", f"WITH {TITLES_SQL}, r AS (SELECT id, source, id % 40 AS cluster, engagement, row_number() OVER (PARTITION BY id % 40 ORDER BY engagement DESC, id) AS r FROM titles) SELECT cluster, id FROM r WHERE r = 1")(
    lambda s, d: V.titles(s, d).groupBy((F.col("id") % 40).alias("cluster")).agg(F.min_by("id", F.struct((-F.col("engagement")).alias("e"), "id")).alias("id"))
)
query("win_rank_boost", f"WITH {TITLES_SQL}, r AS (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY created_at, id) - 1 AS i FROM titles) SELECT id, round((1 - i / 30) * 0.5, 6) AS boost FROM r WHERE i < 30")(
    lambda s, d: V.titles(s, d).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("created_at", "id"))).filter("place <= 30").select("id", F.round((1 - (F.col("place") - 1) / 30) * 0.5, 6).alias("boost"))
)
query("low_engagement_filter", f"WITH {TITLES_SQL} SELECT id FROM titles WHERE score > 5")(lambda s, d: V.titles(s, d).filter("score > 5").select("id"))
query("quality_unscored_filter", f"WITH {TITLES_SQL}, q AS (SELECT id, CASE WHEN id % 4 > 0 THEN CASE WHEN id % 3 = 0 THEN 5 ELSE score % 10 END END AS quality_score FROM titles) SELECT id FROM q WHERE quality_score = 5")(
    lambda s, d: V.titles(s, d).withColumn("quality_score", F.when(F.col("id") % 4 > 0, F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("score") % 10))).filter("quality_score = 5").select("id")
)
query("json_events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")))
