"""Links of titles and keywords against a comparison of every two rows, and distances against a plain table."""

import random

import pytest

from faintline.operators import titles
from tests.test_signals import distance, rows


def plain(data):
    data = sorted(data)
    root = {r[0]: r[0] for r in data}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_title, by_words = dict.fromkeys(root, 0), dict.fromkeys(root, 0)
    for i, a in enumerate(data):
        for b in data[i + 1 :]:
            x, y = a[1].strip(" ").lower(), b[1].strip(" ").lower()
            most = max(len(x), len(y))
            alike = x == y or (most - distance(x, y)) / most > 0.6
            words = len(a[2]) > 2 and sum(w in b[2] for w in a[2]) / len({*a[2], *b[2]}) > 0.5
            for yes, n in ((alike, by_title), (words, by_words)):
                n[a[0]] += yes
                n[b[0]] += yes
            if alike or words:
                lo, hi = sorted((find(a[0]), find(b[0])))
                root[hi] = lo
    return sorted((i, by_title[i], by_words[i], find(i)) for i in root)


def found(df):
    return sorted((r.id, r.n_title_links, r.n_keyword_links, r.class_id) for r in titles.links(df).collect())


SCHEMA = "id long, title string, keywords array<string>, engagement double"


def test_against_every_two_rows(spark):
    assert found(spark.createDataFrame(rows(), SCHEMA).repartition(3)) == plain(rows())


def test_balls_of_many_titles(spark, monkeypatch):
    """Titles of a few patterns, long and short, so that whole balls are similar, others not at all, and some in part."""
    rnd = random.Random(8)
    kinds = ["Show HN: a tool for billing number {}", "Ask {}", "{} x", "Ask HN: a tool for shipping number {}", "So {} long that more than sixty-four letters are needed for it to be written down in full {}"]
    data = [(i, rnd.choice(kinds).format(rnd.randrange(9000), rnd.randrange(99)), rnd.sample("abcdefgh", rnd.randrange(5)), 0.0) for i in range(330)]
    monkeypatch.setattr(titles, "_PART", 32)
    monkeypatch.setattr(titles, "_RANGES", 7)
    assert found(spark.createDataFrame(data, SCHEMA).repartition(3)) == plain(data)


def test_nothing_and_nulls(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    data = [(1, None, None, 0.0), (2, "", [], 0.0), (3, " ", None, 0.0), (4, "a", None, 0.0)]
    assert found(spark.createDataFrame(data, SCHEMA)) == [(1, 2, 0, 1), (2, 2, 0, 1), (3, 2, 0, 1), (4, 0, 0, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_distances(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abé😀 ") for _ in range(n))
    sizes = (0, 1, 2, 10, 63, 64, 65, 127, 128, 129, 200)
    left, right = [text(n) for n in sizes], [text(rnd.choice(sizes)) for _ in range(9)] + [""]
    right += [t[3:] + "b" for t in left]
    assert titles.distances(left, right).tolist() == [[distance(a, b) for b in right] for a in left]
    assert titles.distances([], ["a"]).shape == (0, 1) and titles.distances(["", ""], [""]).tolist() == [[0], [0]]


def test_titles_that_begin_alike_are_few_parts(spark):
    """Numbered titles: parts are full, and no two of them need a comparison title by title."""
    data = [(k.format(i), 1, 0, 1000 * n + i) for n, k in enumerate(("Show HN: a tool for billing number {}", "A short one {}", "Why is deploying so hard {}")) for i in range(700)] + [("Looking for a very different thing", 1, 0, -1)]
    parts = titles.keep(titles._parts(spark.createDataFrame(data, "t string, w bigint, low int, tid bigint").coalesce(1)), "parts")
    assert parts.count() == len(data) and parts.select("part").distinct().count() <= 3 * 3 + 1 + 2 * 4
    met = titles._met(parts).collect()
    assert sum(not r.whole for r in met) <= 4 and sum(r.whole for r in met) >= 18


def test_many_titles_that_begin_alike_are_as_few_parts(spark):
    """Ten times as many numbered titles are no more parts, and all their pairs are decided at once."""
    kinds = "Show HN: a tool for billing number {}", "A short one {}", "Why is deploying so hard {}"
    for n in (1000, 9000):
        data = [(k.format(i), 1, 0, 10000 * j + i) for j, k in enumerate(kinds) for i in range(1000, 1000 + n)]
        parts = titles.keep(titles._parts(spark.createDataFrame(data, "t string, w bigint, low int, tid bigint").coalesce(1)), "parts")
        assert parts.select("part").distinct().count() == 3
        assert [r.whole for r in titles._met(parts).collect() if r.p == r.q] == [True] * 3


def test_large_parts_in_between(spark, monkeypatch):
    """Large parts of which some titles are similar, with each other and with small parts."""
    rnd = random.Random(3)
    texts = [f"{rnd.choice(['alpha', 'omega'])} {rnd.choice('xyz')} {rnd.randrange(10**6):06d}" for _ in range(240)]
    texts += ["alpha x 1", "omega z 12345", "alpha x 12345678", "quite another", "", "alpha x 000", "a"]
    for name, value in {"_PART": 4, "_GROUP": 3, "_RUN": 3, "_RANGES": 7}.items():
        monkeypatch.setattr(titles, name, value)
    data = [(i, t, ["a", "b", "c"] if i >= 240 else [], 0.0) for i, t in enumerate(texts)]
    assert found(spark.createDataFrame(data, SCHEMA).repartition(3)) == plain(data)
