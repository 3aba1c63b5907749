"""Joins on hot keys against plain ones."""

import datetime
import random

import pytest

from faintline.operators import derived, joins


@pytest.mark.parametrize("share", [3, 10_000])
def test_salted_join(spark, share):
    rnd = random.Random(1)
    left = [(rnd.choice(["hot", "hot", "a", "b", None]), i) for i in range(90)] + [("hot", 5)] * 3
    right = [(rnd.choice(["hot", "a", "c", None]), i) for i in range(40)]
    got = joins.salted_join(spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int"), "k", share)
    assert sorted(map(tuple, got.collect())) == sorted((k, x, y) for k, x in left for j, y in right if k == j and k is not None)


@pytest.mark.parametrize("share", [4, 10_000])
def test_launches(spark, share):
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "common"]
    text = lambda n: " ".join(["common"] * (rnd.random() < 0.8) + rnd.sample(words[:-1], n))
    seen, launched = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 11)
    concepts = [(i, seen, text(rnd.randrange(5))) for i in range(60)]
    products = [(i, launched, text(rnd.randrange(6))) for i in range(50)]
    got = derived.launches(spark.createDataFrame(concepts, "concept_id long, first_seen timestamp, concept string"), spark.createDataFrame(products, "product_id long, launched timestamp, title string"), share=share)
    want = sorted((c, p, 10) for c, _, a in concepts for p, _, b in products if a.split() and len({*a.split()} & {*b.split()}) / len({*a.split()}) >= 0.5)
    assert sorted(map(tuple, got.collect())) == want
