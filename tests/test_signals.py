"""Similar titles and leader clusters against a comparison of every two rows."""

import random

import pytest

from faintline.operators import signals


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def absorbs(a, b):
    (x, k), (y, m) = (a[1].strip(" ").lower(), a[2]), (b[1].strip(" ").lower(), b[2])
    most = max(len(x), len(y))
    if x == y or (most - distance(x, y)) / max(most, 1) > 0.6:
        return True
    return len(k) > 2 and bool(m) and sum(w in m for w in k) / len({*k, *m}) > 0.5


def rows():
    rnd = random.Random(2)
    out = [(i, f"Ask for a better tool {i % 7}", ["ask", "for", "reddit"], float(i % 11)) for i in range(0, 300, 30)]
    out += [(1, "one two three", ["a", "b", "c", "d"], 1.0), (152, "quite another", ["a", "b", "c", "e"], 2.0), (153, "nothing alike", ["a", "b", "x", "y"], 3.0)]
    for i in range(400, 560):
        title = "".join(rnd.choice("abc ") for _ in range(rnd.choice([0, 1, 2, 3, 4, 6, 9, 15])))
        out.append((i, title, [rnd.choice("uvwxyz") for _ in range(rnd.choice([0, 1, 2, 3, 4, 5]))], float(rnd.randrange(9))))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "id long, title string, keywords array<string>, engagement double").repartition(3)


def test_pairs_of_all_rows(table):
    data = sorted(rows())
    want = sorted((a[0], b[0]) for i, a in enumerate(data) for b in data[i + 1 :] if absorbs(a, b))
    got = sorted(map(tuple, signals.similar_titles(table, "id", "id").collect()))
    assert (0, 210) in got and (1, 152) in got and (1, 153) not in got
    assert got == want


def test_leaders_of_all_rows(table):
    led = {}
    data = sorted(rows())
    for i, a in enumerate(data):
        if a[0] not in led:
            led[a[0]] = a[0]
            led.update({b[0]: a[0] for b in data[i + 1 :] if b[0] not in led and absorbs(a, b)})
    assert dict(map(tuple, signals.title_leaders(table, "id", batch=60).collect())) == led
    want = {}
    for a in data:
        of = [b for b in data if led[b[0]] == led[a[0]]]
        want[min(of, key=lambda b: (-b[3], b[0]))[0]] = len(of) - 1
    got = signals.dedupe(table, "id").collect()
    assert {r.id: r.duplicate_count for r in got} == want and len(got) == len(want)


def test_no_rows(table):
    assert signals.dedupe(table.limit(0), "id").collect() == []
