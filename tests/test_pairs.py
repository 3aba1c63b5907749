"""Edit distances within groups against a comparison of every two rows."""

import random

import pytest

from faintline.operators import pairs
from tests.test_signals import distance


@pytest.mark.parametrize("share", [5, 1024])
def test_every_two_rows_of_a_group(spark, monkeypatch, share):
    """Groups of one to eighty rows, cut into parts or not, with equal and null texts."""
    rnd = random.Random(3)
    monkeypatch.setattr(pairs, "_SHARE", share)
    monkeypatch.setattr(pairs, "_BLOCK", 8)
    names = [None, "", "blue anvil", "Blue anvil", "red hammer, a long one"] + ["".join(rnd.choice("abc") for _ in range(rnd.randrange(70))) for _ in range(12)]
    data = [(i, rnd.choice(["x"] * 4 + ["y", None]), rnd.choice([1, 1, 1, 2]), rnd.choice(names)) for i in range(120)] + [(200, "alone", 1, "z")]
    df = spark.createDataFrame(data, "id long, brand string, size int, name string").repartition(3)
    got = sorted(map(tuple, pairs.edit_distances(df, ["brand", "size"], "id", df["name"]).collect()))
    same = [(a, b) for a in data for b in data if a[0] < b[0] and a[1] is not None and a[1:3] == b[1:3]]
    gap = lambda x, y: (None, None) if x is None or y is None else (distance(x, y), max(len(x), len(y)))
    assert len(got) == len(same) > 1000 and got == sorted((a[0], b[0], *gap(a[3], b[3])) for a, b in same)
    assert pairs.edit_distances(df.limit(0), ["brand", "size"], "id", df["name"]).collect() == []
