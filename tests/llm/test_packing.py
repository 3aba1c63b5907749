"""Packing: nothing lost, nothing over capacity, no overlap, bins as small as their contents allow."""

import random

import numpy as np

from faintline.llm import packing


def best_fit(sizes, lengths, attention):
    """The same rules with a plain scan over all bins."""
    bins, out = [], []
    for i, s in enumerate(sizes):
        fits = [(b[0] - b[1], k) for k, b in enumerate(bins) if b[0] - b[1] >= s]
        if fits:
            k = min(fits)[1]
        else:
            left = sum(sizes[i:])
            n = min((n for n in sorted(lengths) if n >= s), key=lambda n: (packing.cost(n, max(lengths), attention) / min(n, left), n))
            k = len(bins)
            bins.append([n, 0])
        out.append((k, bins[k][1]))
        bins[k][1] += s
    return [(k, min(n for n in lengths if n >= bins[k][1]), o) for k, o in out]


def test_against_plain_scan():
    rnd = random.Random(3)
    for _ in range(60):
        sizes = sorted((min(1000, int(rnd.paretovariate(0.7) * 10)) for _ in range(rnd.randint(0, 120))), reverse=True)
        got = packing.pack_shard(np.array(sizes, np.int64), (100, 250, 1000), 0.3)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == best_fit(sizes, (100, 250, 1000), 0.3)


def test_long_bins_take_several_pieces():
    bins, capacity, _ = packing.pack_best(np.full(700, 1100), packing.LENGTHS, 0.25)
    assert set(capacity.tolist()) == {8192} and len(set(bins.tolist())) == 100
    # ten pieces: a bin of seven, and what is left is downsized from a trial of 16384 to 4096
    bins, capacity, offsets = packing.pack_best(np.full(10, 1100), packing.LENGTHS, 0.25)
    assert sorted((bins.tolist().count(b), capacity[bins == b][0]) for b in set(bins.tolist())) == [(3, 4096), (7, 8192)]
    assert sorted(offsets[bins == bins[-1]].tolist()) == [0, 1100, 2200]


def test_joint_packing():
    """Nothing lost or overlapping, bins as small as their contents allow, never dearer than best fit."""
    rnd, cheaper = random.Random(5), 0
    for _ in range(80):
        lengths = rnd.choice([(100, 250, 1000), (2048, 4096, 8192, 16384), (7,)])
        sizes = np.array(sorted((min(lengths[-1], rnd.choice([int(rnd.paretovariate(0.7) * 10), rnd.randint(1, max(1, lengths[0] * 3 // 4))])) for _ in range(rnd.randint(0, 150))), reverse=True), np.int64)
        bins, capacity, offsets = packing.pack_jointly(sizes, lengths, 0.3)
        for b in set(bins.tolist()):
            of = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist(), strict=True))
            assert all(at == sum(s for _, s in of[:i]) for i, (at, _) in enumerate(of))
            assert set(capacity[bins == b].tolist()) == {min(n for n in lengths if n >= sum(s for _, s in of))}
        costs = [packing.total_cost(x[0], x[1], lengths[-1], 0.3) for x in (f(sizes, lengths, 0.3) for f in (packing.pack_best, packing.pack_shard))]
        assert costs[0] <= costs[1]
        cheaper += costs[0] < costs[1]
    assert cheaper


def least_cost(sizes, lengths, attention):
    """The least cost of all partitions of a few pieces into bins."""
    best = [float("inf")]

    def place(i, loads):
        if i == len(sizes):
            best[0] = min(best[0], sum(packing.cost(min(n for n in lengths if n >= x), lengths[-1], attention) for x in loads))
            return
        for k in range(len(loads) + 1):
            if k == len(loads) or (loads[k] + sizes[i] <= lengths[-1] and loads[k] not in loads[:k]):
                place(i + 1, [*loads[:k], (loads[k] if k < len(loads) else 0) + sizes[i], *loads[k + 1 :]])

    place(0, [])
    return best[0]


def test_cost_against_all_partitions():
    """Of 300 sets of up to eight pieces 94 % are packed at the least cost; the dearest is 16 % above it."""
    rnd, excess = random.Random(11), []
    for _ in range(300):
        lengths = rnd.choice([(100, 250, 1000), (2048, 4096, 8192, 16384)])
        sizes = sorted((rnd.randint(1, rnd.choice(lengths)) for _ in range(rnd.randint(1, 8))), reverse=True)
        bins, capacity, _ = packing.pack_best(np.array(sizes, np.int64), lengths, 0.25)
        excess.append(packing.total_cost(bins, capacity, lengths[-1], 0.25) / least_cost(sizes, lengths, 0.25) - 1)
    assert min(excess) > -1e-9 and max(excess) < 0.16 and sum(x < 1e-9 for x in excess) > 270


def test_equal_rows_fill_many_shards(spark):
    df = spark.range(30_000).selectExpr("cast(null as bigint) doc_id", "'same' text").repartition(4)
    got = packing.pack(df, per_shard=1000).groupBy("shard").count().collect()
    assert len(got) == 30 and max(r["count"] for r in got) < 1200
    long = spark.createDataFrame([(1, "x" * 100_000)], "doc_id long, text string")
    got = packing.pack(long, lengths=(10,), per_shard=1000).groupBy("shard").count().collect()
    assert len(got) == 11 and max(r["count"] for r in got) < 1200


def test_whole_table(spark):
    rnd = random.Random(4)
    rows = [(i % 300, rnd.choice([None, "", "é" * rnd.randint(1, 40), "x" * rnd.randint(1, 90)]), "b", i) for i in range(900)] + [(1000, "y" * 5000, "b", 0), (None, "z", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin string, piece long")
    got = packing.pack(df, lengths=(32, 64, 128), per_shard=200).collect()
    want = {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len((t or "").encode()) + 1
    have, bins = {}, {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert have == want
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in rs] == [sum(x.n_tokens for x in rs[:k]) for k in range(len(rs))]
        assert rs[0].bin_capacity == min(n for n in (32, 64, 128) if n >= sum(r.n_tokens for r in rs))
    assert len({r.shard for r in got}) > 1
    assert packing.pack(df.limit(0)).collect() == []
