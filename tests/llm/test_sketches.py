"""Sketches against their promises, components against a comparison of every two sets."""

import random

import numpy as np
import pytest

from faintline.llm import sketches as M
from tests.llm.test_jaccard import WORD

SCHEMA = "doc_id long, text string, sid string, band int"


def shingle_set(text, k=4):
    import re

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        low.setdefault(find(i), []).extend([d] if d is not None else [])
    least = [min(low[find(i)], default=None) for i in range(len(rows))]
    return sorted((d is None, d or 0, len(s), -1 if m is None else m, d == m) for (d, *_), s, m in zip(rows, sets, least, strict=True))


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in df.collect())


def corpus(seed, n=260, edits=(0, 0, 1, 1, 2, 3, 5)):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Éa", "the", "THE", "😀"]
    text = lambda m: [rnd.choice(vocabulary) for _ in range(m)]
    passage, rows = text(30), []
    seeds = [text(rnd.choice([1, 3, 4, 5, 6, 9, 40, 60, 120])) for _ in range(40)]
    for i in range(n):
        words = list(rnd.choice(seeds))
        for _ in range(rnd.choice(edits)):
            p = rnd.randrange(len(words))
            words[p : p + 1] = rnd.choice([[], text(1), text(2)]) or words[p : p + 1]
        if rnd.random() < 0.3:
            words += passage
        rows.append((i * 3 + 1, rnd.choice([" ", "\n", " \t "]).join(words), "x", i))
    rows += [(None, rows[5][1], "x", 0), (None, "only null", "x", 0), (9000, None, "x", 0), (9001, "", None, 0), (9002, " \n", "x", 0), (4, rows[1][1], "x", 1), (4, rows[1][1], "x", 1), (9003, "a\x0bb\x0cc\x1cd e f", "x", 0), (9004, "word " * 30000, "x", 0)]
    chain = text(200)  # neighbours are linked, the ends aren't
    for i in range(25):
        rows.append((9100 + i, " ".join(chain), "chain", i))
        chain = chain[6:] + text(6)
    return rows


def test_against_all_pairs(spark):
    rows = corpus(1)
    assert found(M.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_a_large_group_around_the_threshold(spark):
    """More sets than a part holds, some linked and some just not, so that several components share their buckets."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rnd.choice([1, 2, 4, 5, 6, 7, 8])):
            words[rnd.randrange(150)] = f"v{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words), "x", i))
    want = brute(rows)
    assert 10 < len({w[3] for w in want}) < 400
    assert found(M.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


def test_empty_table(spark):
    assert found(M.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_lower_thresholds_are_refused(spark):
    with pytest.raises(ValueError, match="0.8"):
        M.near_duplicates(spark.createDataFrame([], SCHEMA), num=70)


def test_every_bin_is_filled_and_agreement_is_concentrated():
    rnd = np.random.default_rng(3)
    sets = [rnd.integers(1, 2**63, n, dtype=np.uint64) for n in (1, 2, 3, 10, 50, 200, 199, 5000)]
    made = M.sketch([np.unique(s) for s in sets])
    assert made.shape == (8, M.T) and (made != M._EMPTY).all()
    for n, share in ((5, 0.8), (40, 0.8), (400, 0.9), (3000, 0.5)):
        agree = []
        for _ in range(60):
            pool = np.unique(rnd.integers(1, 2**63, 2 * n, dtype=np.uint64))
            both = round(n * share)
            one = (n - both) // 2
            a, b = np.sort(pool[: both + one]), np.sort(np.concatenate([pool[:both], pool[both + one : both + 2 * one]]))
            s = M.sketch([a, b])
            agree.append((s[0] == s[1]).mean())
        true = both / (both + 2 * one)
        assert abs(np.mean(agree) - true) < 4 * (true * (1 - true) / M.T / 60) ** 0.5 + 0.002
        assert min(agree) * M.T >= M.T * true - 6.5 * (M.T * true * (1 - true)) ** 0.5


def test_sketch_does_not_depend_on_its_batch():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(1, 2**63, n, dtype=np.uint64)) for n in (1, 7, 300, 40, 1000)]
    together = M.sketch(sets)
    assert (together == np.concatenate([M.sketch([s]) for s in sets])).all()
    assert M.bands(together).shape == (5, M.BANDS) and len(np.unique(M.bands(together))) == 5 * M.BANDS


def test_small_parts_meet_in_pools(spark):
    """Forty small parts, each to be compared with every other: a set is laid out once for each pool, not once for each part."""
    member = spark.createDataFrame([(p * 100 + i, 20, p) for p in range(40) for i in range(8)], "sid long, n long, part long")
    wide = spark.createDataFrame([(5000 + i, 20, 41) for i in range(200)], "sid long, n long, part long")
    pairs = [(p, q) for p in range(40) for q in range(p)] + [(41, 3), (7, 7)]
    ask, member = spark.createDataFrame(pairs, "x long, y long"), member.unionByName(wide)
    pool = M.pools(ask, member)
    assert sorted(r.part for r in pool.collect()) == [*range(40), 41]
    rows = M.units(ask, member, pool).collect()
    assert len(rows) < 3 * 520  # 12,688 when every two parts had a unit of their own
    held = {}
    for r in rows:
        held.setdefault((r.a, r.b), {}).setdefault(r.sid // 100 if r.sid < 5000 else 41, set()).add(r.role)
    met = lambda k, u, p, q: p in u and q in u and (k[0] == k[1] or u[p] != u[q])
    assert all(any(met(k, u, p, q) for k, u in held.items()) for p, q in pairs)
