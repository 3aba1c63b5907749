"""Titles with odd white space, clusters and duplicates against plain versions, and transitions of predictions."""

import random

import pytest
from pyspark.sql import functions as F

from faintline.functions import scalar as S
from faintline.operators import clusters, derived, graph, predictions
from faintline.sources import sinks


def test_white_space_of_any_kind_is_stripped(spark):
    rows = [("\t Billing tools for teams \n", "Billing tools for teams"), ("\u00a0Billing tools for teams\u2003", "Billing tools for teams"), ("Billing tools for teams", "Billing tools for teams")]
    df = spark.createDataFrame(rows, "raw string, want string")
    for r in df.select("want", S.title_normalize(F.col("raw")).alias("t"), S.strip(F.col("raw")).alias("s"), S.edit_similarity(F.col("raw"), F.col("want")).alias("e")).collect():
        assert r.s == r.want and r.t == r.want and r.e == 1.0


def test_convergence_rounds_halves_up(spark):
    rows = [(a, b, c, d) for a in (0, 5, 55, 101) for b in (1, 2, 50) for c in (3, 4) for d in (0, 7, 200)]
    got = spark.createDataFrame(rows, "a int, b int, c int, d int").select("*", derived.convergence(*map(F.col, "abcd")).alias("x")).collect()
    for a, b, c, d, x in got:
        a, b, c, d = (min(100, v) for v in (a, b, c, d))
        assert x == (30 * a + 25 * b + 25 * c + 20 * d + 50) // 100


def test_dedupe_opportunities(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa"]
    rows = [(i, " ".join(rnd.sample(words, rnd.randint(2, 5))), rnd.randint(0, 9)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, title string, score long")
    order = F.struct((-F.col("score")).alias("s"), "id")
    got = {r.id for r in predictions.dedupe(df.withColumn("o", order), F.col("title"), "o").collect()}
    kept = []
    for i, t, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        w = set(t.split())
        if not any(len(w & k) / len(w | k) >= predictions.SIMILAR for _, k in kept):
            kept.append((i, w))
    assert got == {i for i, _ in kept}


@pytest.mark.parametrize("most", [200_000, 0])
def test_graph_clusters(spark, most):
    rnd = random.Random(2)
    weight = {}
    for _ in range(90):
        u, v = rnd.sample(range(30), 2)
        weight[u, v] = weight[v, u] = float(rnd.randint(2, 6))
    score = {n: rnd.randint(0, 50) for n in range(0, 26)}
    nodes = spark.createDataFrame(list(score.items()), "id long, score long")
    edges = spark.createDataFrame([(u, v, w) for (u, v), w in weight.items()], "u long, v long, w double")
    got = {}
    for r in clusters.greedy(nodes, edges, most).collect():
        got.setdefault(r.cluster_id, set()).add(r.concept_id)
    free, want = set(score), {}
    for seed in sorted(score, key=lambda n: (-score[n], n)):
        if seed not in free:
            continue
        near = [(n, weight[n, seed]) for n in range(30) if (n in free or n not in score) and (n, seed) in weight]
        members = [seed]
        for n, _ in sorted(near, key=lambda c: (-c[1], c[0])):
            if len(members) < clusters.MOST_SIZE and sum(weight.get((n, m), 0) for m in members) / len(members) >= clusters.BOND * clusters.LEAST_WEIGHT:
                members.append(n)
        free -= set(members)
        if len(members) >= clusters.LEAST_SIZE:
            want[seed] = set(members)
    assert got == want


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300, n) for n in range(301, 420)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for u, v in pairs for x in (u, v) if u != v and find(x) != x}
    assert {tuple(r) for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()} == want


def test_transitions_and_digest(spark):
    rows = [(1, "draft", False), (2, "draft", False), (3, "pending", True), (4, "confirmed", True)]
    df = spark.createDataFrame(rows, "id long, status string, is_published boolean").withColumn("drafted_at", S.moment("2024-01-01 00:00:00"))
    chosen = F.col("id").isin(1, 3)
    assert {(r.id, r.status, r.is_published) for r in predictions.publish(df, chosen, "2024-02-01 00:00:00").collect()} == {(1, "pending", True), (2, "draft", False), (3, "pending", True), (4, "confirmed", True)}
    assert {r.id for r in predictions.discard(df, chosen).collect()} == {2, 3, 4} and {r.id for r in predictions.delete(df, chosen).collect()} == {2, 4}
    changes = spark.createDataFrame([("a", "rising", 1, False), ("b", "peaking", 1, True), ("c", "rising", 30, False)], "trend_slug string, lifecycle string, ago int, notified boolean")
    changes = changes.select("trend_slug", "lifecycle", (S.moment("2024-02-01 00:00:00") - F.make_interval(days="ago")).alias("changed_at"), "notified")
    people = spark.createDataFrame([("x", None), ("y", "a"), ("z", "b"), ("w", "c")], "email string, trend_slug string")
    assert {(r.email, r.trend_slug) for r in sinks.due(changes, people, "2024-02-01 00:00:00").collect()} == {("x", "a"), ("y", "a")}
    marked = sinks.notified(changes, "2024-02-01 00:00:00")
    assert sinks.due(marked, people, "2024-02-01 00:00:00").collect() == []
