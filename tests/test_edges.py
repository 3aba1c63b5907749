"""Edges by tasks that grow in number with the pairs."""

import datetime

import pytest
from pyspark.sql import functions as F

from faintline.operators import concepts
from faintline.plans import catalog, relational
from faintline.plans import views as V
from faintline.sources import storage


def test_tasks_grow_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(storage, "_ROWS", 10)
    mentions = spark.createDataFrame([(s, (s * 7 + k * 3) % 50) for s in range(40) for k in range(5)], "signal_id long, concept_id long")
    n = concepts.tasks_of_pairs(mentions)
    assert n == 41 and concepts.tasks_of_pairs(mentions.limit(0)) == spark.sparkContext.defaultParallelism
    snaps = concepts.pairs(mentions).withColumns({"created_at": F.lit(datetime.datetime(2024, 1, 1)), "source": F.lit("x")})
    plain, dealt = concepts.edges(snaps), concepts.edges(snaps, parts=n)
    assert dealt.rdd.getNumPartitions() == n
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    assert sorted(concepts.degrees(dealt, n).collect()) == sorted(concepts.degrees(plain).collect())
    assert sorted(concepts.weights(concepts.pairs(mentions), n).collect()) == sorted(plain.select("concept_a", "concept_b", F.col("total_weight").alias("weight")).collect())


@pytest.mark.parametrize(
    "name",
    ["top_edges", "agg_max_weight", "edge_weight_filter", "graph_components", "graph_view", "distinct_endpoints", "jsonb_object_agg", "semi_labels_any", "top_edge_snapshots", "agg_edge_counts"],
)
def test_queries_deal_mentions_and_pairs(spark, monkeypatch, capsys, name):
    monkeypatch.setattr(storage, "_ROWS", 500)
    monkeypatch.setattr(relational, "components", lambda edges: edges)  # its plan would show the last round only
    d = "/root/testdata/sf0.001"
    mentions, pairs = storage.tasks(spark, storage.table(spark, d, "lineitem").count()), concepts.tasks_of_pairs(V.mentions(spark, d))
    assert 4 < mentions < pairs
    catalog.queries()[name](spark, d).explain()
    dealt = [line for line in capsys.readouterr().out.splitlines() if "REPARTITION_BY_NUM" in line]
    assert any("signal_id" in line and f" {mentions})" in line for line in dealt)
    assert any(line.count("concept_") == 2 and f" {pairs})" in line for line in dealt)
