"""Streams whose rows come out of order, late, or twice, against the batch results."""

import datetime
import random

import pytest

from faintline.streaming import limits, state

BASE = datetime.datetime(2024, 1, 1)


def at(seconds):
    return BASE + datetime.timedelta(seconds=seconds)


def streamed(spark, tmp_path, schema, batches, made):
    out = str(tmp_path / "out")
    query = None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = made(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = state.run(stream, out, str(tmp_path / "c"))
    return [tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()], query


def test_limits_out_of_order_and_expired(spark, tmp_path):
    rnd = random.Random(1)
    rows = sorted((f"k{rnd.randrange(3)}", at(rnd.randrange(40_000))) for _ in range(120))
    rows = [(k, t + datetime.timedelta(microseconds=i)) for i, (k, t) in enumerate(rows)]
    order = sorted(rows, key=lambda r: (r[1] + datetime.timedelta(seconds=rnd.randrange(3000))))  # up to 50 minutes out of order
    batches = [[("billing", *r) for r in x] for x in (order[:40], order[40:80], order[80:], [("", at(40_000 + 3600 + 1))])]
    got, query = streamed(spark, tmp_path, "policy string, key string, time timestamp", batches, lambda s: state.limited(s, "1 hour"))
    got = [r[1:] for r in got]
    want = []
    for k in {r[0] for r in rows}:
        times = sorted(int((t - BASE).total_seconds() * 1e6 + 0.5) for key, t in rows if key == k)
        want += [(k, t, n, ok) for t, (n, ok) in zip(times, limits.decide(times, *limits.POLICIES["billing"])[0], strict=True)]
    start = min(int(a) for _, a, _, _ in got) - min(w[1] for w in want)
    assert sorted((k, a - start, n, ok) for k, a, n, ok in got) == sorted(want)
    # the last tick lets 40,000 seconds pass: only windows that reach beyond them are left
    left = {r.key.key: (r.value.start - start, r.value.n) for r in state.table_of(spark, str(tmp_path / "c"), "window").collect()}
    last = {}
    for k, t, n, _ in sorted(want):
        last[k] = (t if n == 1 else last[k][0], n)
    assert left == {k: v for k, v in last.items() if v[0] + 3600 * 10**6 >= 40_000 * 10**6}


def test_limits_call_a_state_once_for_a_slot_of_keys(spark, tmp_path):
    rows = [("billing", f"k{i % 300}", at(i)) for i in range(900)]
    # the window of "edge" ends within the millisecond that the last watermark is at
    edge = at(1) + datetime.timedelta(microseconds=700)
    batches = [[*rows, ("billing", "edge", edge)], [("", "", at(2000 + 3600))], [("", "", at(3600 + 3601) + datetime.timedelta(milliseconds=1))]]
    got, query = streamed(spark, tmp_path, "policy string, key string, time timestamp", batches, lambda s: state.limited(s, "1 hour", slots=4))
    assert len(got) == 901 and {(n, ok) for _, k, _, n, ok in got if k != "edge"} == {(1, True), (2, True), (3, True)}
    # 301 keys, but a row and a timer in either order for each of four slots; before, each key had its own
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators if "transformWithState" in o.operatorName) <= 4 * 3
    left = {r.key.key for r in state.table_of(spark, str(tmp_path / "c"), "window").collect()}
    assert left == {f"k{i}" for i in range(1, 300)} | {"edge"}


def test_lifecycle_out_of_order_and_late(spark, tmp_path):
    day = lambda n: at(86_400 * n)
    batches = [
        [("a", "emerging", day(1)), ("a", "peak", day(3)), ("b", "peak", day(2))],
        [("a", "emerging", day(2)), ("a", "rising", day(4)), ("a", "rising", day(6))],  # day 2 comes after day 3
        [("a", "peak", day(5)), ("b", None, day(7)), ("", None, day(20))],
        [("a", "lost", day(3)), ("", None, day(30))],  # far behind the watermark
    ]
    got, _ = streamed(spark, tmp_path, "trend_slug string, lifecycle string, recorded_at timestamp", batches, lambda s: state.lifecycle_changes(s, "3 days"))
    assert sorted((r[:3] for r in got if r[0]), key=repr) == sorted(
        [("a", None, "emerging"), ("a", "emerging", "peak"), ("a", "peak", "rising"), ("a", "rising", "peak"), ("a", "peak", "rising"), ("b", None, "peak"), ("b", "peak", None)], key=repr
    )


def test_rolling_mentions(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), at(rnd.randrange(86_400 * 40))) for _ in range(200)]
    order = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rnd.randrange(80_000)))
    batches = [order[:90], order[90:150], order[150:], [(99, at(86_400 * 140))], [(99, at(86_400 * 141))]]
    got, _ = streamed(spark, tmp_path, "concept_id long, collected_at timestamp", batches, lambda s: state.rolling_mentions(s, "1 day"))
    got = [r for r in got if r[0] != 99]
    zero = (BASE - datetime.datetime(1970, 1, 1)).days
    of = {(c, d - zero): rest for c, d, *rest in got}
    assert len(of) == len(got)
    days = [(c, int((t - BASE).total_seconds() // 86_400)) for c, t in rows]
    for (c, d), sums in of.items():
        count = lambda lo, hi: sum(1 for k, x in days if k == c and d - lo <= x < d - hi)
        assert sums == [count(1, 0), count(7, 0), count(14, 7), count(30, 0), count(60, 30), count(21, 7)]
    for c in range(3):  # at each midnight from the first mention until the ring is empty
        mine = [d for k, d in days if k == c]
        assert {d for k, d in of if k == c} == set(range(min(mine) + 1, max(mine) + state.RING + 1))
    assert {r.key.concept_id for r in state.table_of(spark, str(tmp_path / "c"), "next").collect()} <= {99}


@pytest.mark.parametrize("turn", [1, -1])
def test_upserts_of_one_key_in_a_batch(spark, tmp_path, turn):
    schema = "source string, id long, title string, collected_at timestamp"
    batches = [
        [("x", 1, "first", at(10)), ("x", 1, "later", at(30)), ("x", 1, "between", at(20)), ("y", 1, "other", at(5))][::turn],
        [("x", 1, "newer", at(50)), ("x", 1, "newer", at(50)), ("y", 2, "b", at(7)), ("y", 2, "a", at(7))][::turn],
        [("x", 1, "newer", at(50)), ("y", 1, "last", at(60))],
    ]
    got, _ = streamed(spark, tmp_path, schema, batches, lambda s: state.upserted(s, ["source", "id"], ["collected_at"], "collected_at"))
    table = {tuple(r.key): tuple(r.value) for r in state.table_of(spark, str(tmp_path / "c"), "row").collect()}
    assert table == {("x", 1): ("first", at(50)), ("y", 1): ("other", at(60)), ("y", 2): ("a", at(7))}
    assert ("x", 1, "first", at(30)) in got and ("x", 1, "first", at(50)) in got and len(got) == 5


def test_upserts_are_dealt_to_slots(spark, tmp_path):
    schema = "source string, id long, title string, collected_at timestamp"
    batches = [[("x", i, f"t{i}", at(i)) for i in range(100)], [("x", i, "new", at(500 + i)) for i in range(50, 150)]]
    got, _ = streamed(spark, tmp_path, schema, batches, lambda s: state.upserted(s, ["source", "id"], ["collected_at"], "collected_at", slots=3))
    table = {tuple(r.key): tuple(r.value) for r in state.table_of(spark, str(tmp_path / "c"), "row").collect()}
    assert table == {("x", i): (f"t{i}" if i < 100 else "new", at(i if i < 50 else 500 + i)) for i in range(150)}
    assert len(got) == 200
