"""Matches against a plain dynamic programme over every text and item."""

import random

import pytest

from faintline.llm import decontaminate as d


def least(pattern, text, anchored=False):
    """Least edit distance of the pattern to any substring (or prefix) of the text, by the full table."""
    row = [0] * (len(text) + 1) if not anchored else list(range(len(text) + 1))
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        k = rnd.randrange(len(s))
        s[k : k + 1] = rnd.choice([[], [rnd.choice("abcde ")], [s[k], rnd.choice("abcde")]])
    return "".join(s)


def test_myers():
    rnd = random.Random(1)
    for _ in range(300):
        p = "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 90)))
        t = "".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 60)))
        assert d.Pattern(p).best(t)[0] == least(p, t)
        assert d.Pattern(p).best(t, anchored=True)[0] == least(p, t, anchored=True)


@pytest.mark.parametrize("rate", [0.0, 0.08, 0.15])
def test_no_occurrence_is_lost(rate):
    rnd = random.Random(2)
    items = [(i, " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(8, 40)))) for i in range(8)]
    items += [(90, "ok"), (91, "  "), (92, "Ok!")]
    items += [(0, "short one"), (0, "another one"), (7, "sixteen letters!")]
    m = d.Matcher(tuple(items), rate)
    for _ in range(250):
        noise = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 80)))
        text = noise()
        for _, s in rnd.sample(items[:8], rnd.randint(0, 2)):
            text += " " + edited(rnd, s, rnd.randint(0, int(rate * len(s)) + 2)).upper() + "\n" + noise()
        got = {x["item_id"]: x for x in m.find(text)}
        plain = d.normalise(text)
        for i, s in items[:8]:
            s = d.normalise(s)
            if least(s, plain) <= int(rate * len(s)):
                x = got.pop(i)
                assert least(s, plain[x["start"] : x["end"]]) == x["distance"] <= int(rate * len(s))
            else:
                assert i not in got
        assert not got
    ids = lambda text: [x["item_id"] for x in m.find(text)]
    assert ids(" OK. ") == ids("it is ok") == [90, 92] and ids("joke oks") == [] and m.find(None) == m.find("") == []
    assert ids("a short one and another one") == [0, 0] and ids("xx sixteen letters yy") == [7]
    if rate:  # the closest of several, found after others
        far, near = edited(rnd, items[0][1], 1), items[0][1]
        assert [x["distance"] for x in m.find(far + " " + near) if x["item_id"] == 0 and x["end"] - x["start"] > 20] == [0]


def test_tables(spark):
    rnd = random.Random(3)
    items = [(i, " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(25))) for i in range(7)] + [(50, None), (None, "x" * 40), (51, "")]
    docs = [(1, None, "a", 1), (2, "", "b", 2), (3, "before " + items[2][1].upper() + " after", None, 3), (4, "clean text", "d", 4), (3, "before " + items[2][1] + " after", "e", 5), (None, items[3][1] + " " + items[4][1], "f", 6), (7, "y " * 200000 + items[0][1], "g", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks string, __leaks int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id, r.distance) for r in d.leaks(df, bench, block=3).collect()))
    assert got == [(0, 3, 0), (0, 4, 0), (3, 2, 0), (3, 2, 0), (7, 0, 0)]
    clean = d.decontaminate(df, bench, block=3)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 4]
    assert d.leaks(df, bench.limit(0)).collect() == [] and d.decontaminate(df, bench.limit(0)).count() == 7
    assert d.leaks(df.limit(0), bench).collect() == []
