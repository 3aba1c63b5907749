"""Greedy clusters of a weighted concept graph, in parallel rounds that give the sequential result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintline.operators.graph import components
from faintline.sources.storage import discard, keep

# Least edge weight, least average bond of a member, and sizes.
LEAST_WEIGHT, BOND, LEAST_SIZE, MOST_SIZE = 2, 0.6, 2, 15
_SHARE = 50_000


def grow(seed: int, candidates: list[tuple[int, float]], weight: dict[tuple[int, int], float]) -> list[int]:
    """Members of a seed's cluster: strongest neighbours first, each bound well enough to those already in."""
    members = [seed]
    for n, _ in sorted(candidates, key=lambda c: (-c[1], c[0])):
        if len(members) >= MOST_SIZE:
            break
        if sum(weight.get((n, m), 0.0) for m in members) / len(members) >= BOND * LEAST_WEIGHT:
            members.append(n)
    return members


def sequential(score: dict[int, float], weight: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """(seed, member) of one component: each unassigned node, best score first, takes from its neighbours what it can."""
    near: dict[int, list[int]] = {}
    for u, v in weight:
        near.setdefault(v, []).append(u)
    closed: set[int] = set()
    out = []
    for seed in sorted(score, key=lambda n: (-score[n], n)):
        if seed not in closed:
            members = grow(seed, [(n, weight[n, seed]) for n in near.get(seed, ()) if n not in closed], weight)
            closed.update(m for m in members if m in score)
            out += [(seed, m) for m in members]
    return out


def greedy(nodes: DataFrame, graph: DataFrame, most: int = 200_000) -> DataFrame:
    """(cluster_id, concept_id, eligible): nodes (id, score) are eligible; graph (u, v, w) in both directions.

    Clusters never leave their connected component, so each component of at most ``most`` edges is one task's work;
    nodes of larger ones are clustered by ``rounds``, with the same result.
    """
    graph = keep(graph.select("u", "v", F.col("w").cast("double").alias("w")), "graph")
    root = components(graph.select("u", "v"))
    of = graph.join(root.select("u", F.col("v").alias("__root")), "u", "left").withColumn("__root", F.coalesce("__root", "u"))
    edges = keep(of, "edges")
    # a node without edges forms no cluster of two
    known = edges.select(F.col("u").alias("id"), "__root").distinct().join(nodes.select("id", "score"), "id")
    size = edges.groupBy("__root").agg(F.count("*").alias("n"))
    large = keep(size.filter(F.col("n") > most).select("__root"), "large")
    share = edges.count() // _SHARE + 1
    rows = edges.select("__root", "u", "v", "w").unionByName(known.select("__root", F.col("id").alias("u"), F.lit(None).cast("bigint").alias("v"), F.col("score").cast("double").alias("w")))

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        node = part["v"].isna()
        score = dict(zip(part["u"][node].tolist(), part["w"][node].tolist(), strict=True))
        weight = {(u, int(v)): w for u, v, w in zip(part["u"][~node].tolist(), part["v"][~node].tolist(), part["w"][~node].tolist(), strict=True)}
        return pd.DataFrame(sequential(score, weight), columns=["cluster_id", "concept_id"]).astype("int64")

    # whole components, some _SHARE edges of them at a time: clusters of one never touch another
    dealt = rows.join(large, "__root", "left_anti").groupBy(F.pmod(F.xxhash64("__root"), F.lit(share)).alias("__share"))
    done = dealt.applyInPandas(whole, "cluster_id bigint, concept_id bigint")
    if not large.isEmpty():
        done = done.unionByName(rounds(known.join(large, "__root", "left_semi").select("id", "score"), edges.join(large, "__root", "left_semi").select("u", "v", "w")))
    done = keep(done, "clusters")
    discard(graph, edges, large)
    eligible = nodes.select("id")
    size = done.groupBy("cluster_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_SIZE)
    marked = done.join(size, "cluster_id", "left_semi").join(eligible.select(F.col("id").alias("concept_id"), F.lit(True).alias("e")), "concept_id", "left")
    return marked.select("cluster_id", "concept_id", F.coalesce("e", F.lit(False)).alias("eligible"))


def rounds(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(cluster_id, concept_id) of components of any size.

    Two seeds can only disturb each other within two steps through unassigned nodes; so in each round every node that
    is the best within two steps grows its cluster, all at once, from its own neighbourhood.
    """
    rank = F.struct((-F.col("score")).alias("s"), "id")
    open_ = keep(nodes.select("id", rank.alias("rank")), "open")
    graph = keep(graph.select("u", "v", F.col("w").cast("double").alias("w")), "graph")
    eligible = open_.select("id")
    done = None
    while not open_.isEmpty():
        live = graph.join(open_.select(F.col("id").alias("u"), F.col("rank").alias("ru")), "u").join(open_.select(F.col("id").alias("v"), F.col("rank").alias("rv")), "v")
        one = live.groupBy("u").agg(F.least(F.min("ru"), F.min("rv")).alias("best"))
        near = open_.join(one.withColumnRenamed("u", "id"), "id", "left").select("id", "rank", F.coalesce("best", "rank").alias("best"))
        two = live.select("u", "v").join(near.select(F.col("id").alias("v"), "best"), "v").groupBy(F.col("u").alias("id")).agg(F.min("best").alias("far"))
        seeds = keep(near.join(two, "id", "left").filter((F.col("rank") == F.col("best")) & (F.col("far").isNull() | (F.col("rank") == F.col("far")))).select(F.col("id").alias("seed")), "seeds")
        closed = eligible.join(open_.select("id"), "id", "left_anti")
        around = graph.join(seeds, graph.u == seeds.seed).select("seed", F.col("v").alias("n"), "w").join(closed.withColumnRenamed("id", "n"), "n", "left_anti")
        between = graph.join(around.select("seed", F.col("n").alias("u")), "u").join(around.select("seed", F.col("n").alias("v")), ["seed", "v"]).select("seed", "u", "v", "w")
        rows = around.select("seed", F.col("n").alias("u"), F.col("seed").alias("v"), "w").unionByName(between)

        def cluster(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            seed = int(key[0])
            weight = {(int(u), int(v)): w for u, v, w in zip(part.u, part.v, part.w, strict=True)}
            found = grow(seed, [(u, w) for (u, v), w in weight.items() if v == seed], weight)
            return pd.DataFrame({"cluster_id": [seed] * len(found), "concept_id": found})

        grown = rows.groupBy("seed").applyInPandas(cluster, "cluster_id bigint, concept_id bigint")
        grown = keep(grown, "grown")
        done = grown if done is None else done.unionByName(grown)
        taken = seeds.select(F.col("seed").alias("id")).unionByName(grown.select(F.col("concept_id").alias("id")))
        open_ = keep(open_.join(taken, "id", "left_anti"), "open")
    return done
