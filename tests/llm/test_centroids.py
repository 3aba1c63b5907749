"""Clusters against a plain scan, the curve against its definition, and boxes that must not lose the nearest centroid."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from faintline.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, key string, row int"


def plain(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(np.float32(x)) and abs(x) * 256 < 1 << 26 for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest()
    centre = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == n]
            centre[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    of = [near(v) for _, v in kept]
    total = {n: sum(d for d, o in of if o == n) for n in range(len(centre))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted((-1 if i is None else i, n, d, total[n], sum(total.values()), sha[n]) for (i, _), (d, n) in zip(kept, of, strict=True))


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def vectors(n, centres, seed=3, width=0.02):
    rnd = random.Random(seed)
    middle = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(centres)]
    return [(i, [x + rnd.gauss(0, width) for x in rnd.choice(middle)], "a", i) for i in range(n)]


def test_against_a_scan_with_odd_rows(spark):
    rows = vectors(300, 12, width=0.3)
    rows += [(7, rows[3][1], "b", 0), (7, rows[3][1], "b", 0), (None, rows[5][1], None, 1)] + [(1000 + i, rows[9][1], "same", i) for i in range(150)]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.1] * 63, [float("nan")] + [0.1] * 63, [float("inf")] + [0.1] * 63, [-float("inf")] * 64, [3e5] * 64, [-0.001] * 64, [-0.0] * 64]
    rows += [(2000 + i, v, "odd", i) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(C.cluster(df)) == plain(rows)


@pytest.mark.parametrize("rows", [[], vectors(1, 1), vectors(5, 2) + [(9, None, "x", 1)], [(i, [1.0] * 64, "x", i) for i in range(90)]])
def test_fewer_vectors_than_centroids_ties_and_nothing(spark, rows):
    assert found(C.cluster(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_large_components_are_exact(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-2e5, 2e5) for _ in range(64)], "x", i) for i in range(120)]
    assert found(C.cluster(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_sql(spark):
    rows = vectors(200, 9, width=0.2)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    cur = con.execute(C.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    order = [names.index(c) for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    assert sorted(tuple(r[i] for i in order) for r in cur.fetchall()) == found(C.cluster(spark.createDataFrame(rows, SCHEMA)))


def test_boxes_spare_most_comparisons_where_vectors_gather(spark):
    rows = vectors(6000, 40)
    out = C.cluster(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert out.selectExpr("avg(compared)").first()[0] < 20


def test_candidates_hold_the_nearest():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        c = rnd.integers(-50, 50, (12, 6))
        x = rnd.integers(-50, 50, 6) + rnd.integers(-6, 7, (20, 6))
        some = C.candidates(x.min(axis=0), x.max(axis=0), c)
        assert set(((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()) <= set(some.tolist())


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (5, 2), (8, 1)])
def test_curve_visits_every_cell_and_steps_to_a_neighbour(n, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    key = C.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()
