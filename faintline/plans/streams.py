"""Queries that stream tables in several micro-batches, some rows of them out of order, against the SQL of the batch."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintline.plans import views as V
from faintline.plans.registry import query
from faintline.plans.views import AS_OF, EVENTS_SQL, HISTORY_SQL, TITLES_SQL
from faintline.sources.storage import new_path, table
from faintline.streaming import state
from faintline.streaming.limits import POLICIES

NOW = f"TIMESTAMP '{AS_OF}'"


def _paths(s) -> tuple[str, str, str]:
    return tuple(new_path(s, n) for n in ("landed", "changes", "progress"))


def _batches(rows: DataFrame, time: str, late: str, parts: int = 3) -> DataFrame:
    """rows with a ``batch``: equal spans of time, the next one for every seventh row; and a last row that moves the watermark past all others.

    A row that lands with the next span must not be late: ``late`` is more than a span.
    """
    ends = rows.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    micros = lambda c: F.unix_micros(c)
    span = F.greatest(F.floor((micros("hi") - micros("lo")) / parts) + 1, F.lit(1))
    place = F.floor((micros(time) - micros("lo")) / span) + F.when(F.pmod(F.xxhash64(*rows.columns), F.lit(7)) == 0, 1).otherwise(0)
    dealt = rows.join(F.broadcast(ends)).withColumn("batch", place.cast("int")).select(*rows.columns, "batch")
    # a millisecond, the watermark's unit, more than the last row
    end = F.timestamp_millis(F.unix_millis("hi") + 1) + F.expr(f"INTERVAL {late}")
    blank = {"string": F.lit("").cast("string"), "bigint": F.lit(-1).cast("bigint")}
    tick = ends.filter("hi IS NOT NULL").select(*[end.alias(c) if c == time else blank[t].alias(c) for c, t in rows.dtypes], F.lit(parts + 1).alias("batch"))
    return dealt.unionByName(tick)


# ---------------------------------------------------------------- requests against limits

_KINDS = dict(zip(("click", "error", "purchase", "signup", "view"), POLICIES, strict=True))
_LATE = "20 MINUTES"


def _requests(s, d) -> DataFrame:
    """Requests of all policies, a thousand times as close as the events."""
    policy = functools.reduce(lambda c, k: c.when(F.col("event_type") == k, _KINDS[k]), _KINDS, F.when(F.lit(False), ""))
    return table(s, d, "events").select(policy.alias("policy"), F.col("user_id").cast("string").alias("key"), F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)).alias("time")).filter("policy IS NOT NULL")


_POLICIES = ", ".join(f"('{kind}', '{name}', {POLICIES[name][0]}, CAST({POLICIES[name][1]}000000 AS BIGINT))" for kind, name in _KINDS.items())
_DECIDED = f"""WITH RECURSIVE pol(kind, policy, most, span) AS (VALUES {_POLICIES}), q AS (SELECT policy, CAST(user_id AS VARCHAR) AS key, most, span, epoch_us(ts) // 1000 AS "at", row_number() OVER (PARTITION BY policy, user_id ORDER BY ts) AS i FROM events JOIN pol ON kind = event_type),
  w AS (SELECT *, "at" AS start, 1 AS n FROM q WHERE i = 1 UNION ALL SELECT q.*, CASE WHEN w.start + q.span < q."at" THEN q."at" ELSE w.start END, CASE WHEN w.start + q.span < q."at" THEN 1 ELSE w.n + 1 END FROM w JOIN q ON q.policy = w.policy AND q.key = w.key AND q.i = w.i + 1)"""


def _decided(s, d, paths: tuple[str, str, str]) -> DataFrame:
    return state.played(_batches(_requests(s, d), "time", _LATE), lambda r: state.limited(r, _LATE), paths)


query("stream_rate_limit", f'{_DECIDED} SELECT policy, key, "at", CAST(n AS BIGINT) AS n, n <= most AS allowed FROM w')(lambda s, d: _decided(s, d, _paths(s)))


def _alive(s, d) -> DataFrame:
    """What the state still holds after the last request: windows that haven't ended. The watermark counts milliseconds, so the last of them is told apart here."""
    paths = _paths(s)
    _decided(s, d, paths)
    last = _requests(s, d).agg(F.max(F.unix_micros("time")).alias("last"))
    held = state.table_of(s, paths[2], "window").join(F.broadcast(last)).filter("value.ends >= last")
    return held.select("key.policy", "key.key", "value.start", "value.n")


query("stream_rate_limit_expiry", f"{_DECIDED}, l AS (SELECT policy, key, max(start) AS start, CAST(arg_max(n, i) AS BIGINT) AS n, any_value(span) AS span FROM w GROUP BY 1, 2) SELECT policy, key, start, n FROM l WHERE start + span >= (SELECT max(epoch_us(ts) // 1000) FROM events)")(_alive)

# ---------------------------------------------------------------- lifecycles, mentions, stored signals

_DAYS = "12 DAYS"


def _changes(s, d) -> DataFrame:
    states = V.history(s, d).select("trend_slug", F.col("recorded_at").cast("timestamp").alias("recorded_at"), F.when(F.col("score") >= 50, "rising").otherwise("emerging").alias("lifecycle"))
    return state.played(_batches(states, "recorded_at", _DAYS), lambda r: state.lifecycle_changes(r, _DAYS), _paths(s)).select("trend_slug", "previous", "lifecycle")


query("lifecycle_change_stream", f"WITH {HISTORY_SQL}, l AS (SELECT trend_slug, recorded_at, CASE WHEN score >= 50 THEN 'rising' ELSE 'emerging' END AS lifecycle FROM history), p AS (SELECT *, lag(lifecycle) OVER (PARTITION BY trend_slug ORDER BY recorded_at) AS previous FROM l) SELECT trend_slug, previous, lifecycle FROM p WHERE previous IS DISTINCT FROM lifecycle")(_changes)


def _mentions(s, d) -> DataFrame:
    """The sums at the midnight of AS_OF; the last row's day, and so the watermark, is one after it at least."""
    seen = table(s, d, "events").select(F.col("user_id").alias("concept_id"), F.col("ts").cast("timestamp").alias("collected_at"))
    batches = _batches(seen, "collected_at", _DAYS)
    day = F.to_timestamp(F.lit(AS_OF)) + F.expr(f"INTERVAL {_DAYS}") + F.expr("INTERVAL 1 DAY")
    later = F.when(F.col("concept_id") == -1, F.greatest("collected_at", day)).otherwise(F.col("collected_at"))
    sums = state.played(batches.withColumn("collected_at", later), lambda r: state.rolling_mentions(r, _DAYS), _paths(s))
    return sums.filter(F.col("day") == F.unix_date(F.to_date(F.lit(AS_OF)))).drop("day")


_SINCE = lambda lo, hi=None: f"count(*) FILTER (WHERE collected_at >= {NOW} - INTERVAL {lo} DAY" + (f" AND collected_at < {NOW} - INTERVAL {hi} DAY)" if hi else ")")
query("stream_rolling_mentions", f"WITH {EVENTS_SQL} SELECT concept_id, {_SINCE(1)} AS last_1, {_SINCE(7)} AS last_7, {_SINCE(14, 7)} AS before_7, {_SINCE(30)} AS last_30, {_SINCE(60, 30)} AS before_30, {_SINCE(21, 7)} AS previous FROM ev WHERE collected_at < {NOW} GROUP BY 1")(_mentions)


def _stored(s, d) -> DataFrame:
    """What is stored lands first, then what is new, half of it twice."""
    t = V.titles(s, d).select("source", "id", "title", F.col("created_at").cast("timestamp").alias("collected_at"))
    new = t.filter("id % 2 = 0").withColumns({"title": F.concat(F.lit("new "), "title"), "collected_at": F.col("collected_at") + F.expr("INTERVAL 1 DAY")})
    put = lambda x, n: x.withColumn("batch", F.lit(n))
    rows = put(t.filter("id % 3 > 0"), 0).unionByName(put(new, 1)).unionByName(put(new.filter("id % 4 = 0"), 2))
    paths = _paths(s)
    state.played(rows, lambda r: state.upserted(r, ["source", "id"], ["collected_at"], "collected_at", "60 DAYS"), paths)
    return state.table_of(s, paths[2], "row").select("key.source", "key.id", "value.title", F.col("value.collected_at").cast("timestamp_ntz").alias("collected_at"))


query(
    "stream_signal_upsert",
    f"WITH {TITLES_SQL}, o AS (SELECT * FROM titles WHERE id % 3 > 0), n AS (SELECT * REPLACE ('new ' || title AS title, created_at + INTERVAL 1 DAY AS created_at) FROM titles WHERE id % 2 = 0) SELECT coalesce(o.source, n.source) AS source, coalesce(o.id, n.id) AS id, coalesce(o.title, n.title) AS title, coalesce(n.created_at, o.created_at) AS collected_at FROM o FULL JOIN n ON o.id = n.id",
)(_stored)
