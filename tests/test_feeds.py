"""Feeds with all that XML allows, digests, log lines, and edge tables under deletions against a full count."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from faintline.operators import clusters, concepts
from faintline.sources import feeds, sinks

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>feed</title><link>http://feed/</link>
<item><title><![CDATA[Tools & <i>toys</i>]]></title><link> http://x/1 </link><description>one &amp; <b>two</b> <br/>three</description><pubDate>Mon</pubDate><dc:creator>me</dc:creator></item>
<item><title>no link</title></item><item><link>http://x/3</link></item>
<item><title>plain</title><link>http://x/4</link></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="html">An &lt;b&gt;entry&lt;/b&gt;</title><link rel="alternate" href="http://y/1"/><summary>sum</summary><published>2024</published></entry></feed>'


def test_rss_atom_and_damaged_texts(spark):
    rows = [(1, RSS), (2, ATOM), (3, RSS[:300]), (4, None), (5, ""), (6, "no xml at all"), (7, "<rss><channel></channel></rss>")]
    raw = spark.createDataFrame(rows, "page int, payload string")
    got = {(r.page, r.title, r.tagline, r.url, r.published) for r in feeds.rss(raw, ["page"]).collect()}
    assert got == {(1, "Tools & toys", "one & two three", "http://x/1", "Mon"), (1, "plain", "", "http://x/4", None), (2, "An entry", "sum", "http://y/1", "2024")}
    assert {3, 6} <= {r.page for r in feeds.damaged(raw, ["page"]).collect()} <= {3, 5, 6}


def test_whole_items_of_texts_that_break_off(spark):
    """Items before the break are read; one that is cut, one with a bad entity and one inside a comment are not."""
    torn = "<rss><channel><!-- <item><title>no</title><link>http://x/0</link></item> -->" + RSS[RSS.index("<item>") : RSS.index("</channel>")] + "<item><title><![CDATA[a </item> b]]></title><link>http://x/5</link></item><item><title>a & b</title><link>http://x/6</link></item><item><title>cut</title><link>http://x/7</li"
    rows = [(1, torn), (2, ATOM[: -len("</feed>")] + "<"), (3, RSS)]
    raw = spark.createDataFrame(rows, "page int, payload string")
    got = {(r.page, r.title, r.tagline, r.url) for r in feeds.rss(raw, ["page"]).collect()}
    first = ("Tools & toys", "one & two three", "http://x/1")
    assert got == {(1, *first), (1, "plain", "", "http://x/4"), (1, "a  b", "", "http://x/5"), (2, "An entry", "sum", "http://y/1"), (3, *first), (3, "plain", "", "http://x/4")}


def test_top_of_feeds(spark):
    at = "2024-01-31 00:00:00"
    old = datetime.datetime(2023, 1, 1)
    posts = spark.createDataFrame([(str(i), i * 100, 0, old) for i in range(50)], "id string, score long, num_comments long, created_at timestamp")
    assert [r.id for r in feeds.reddit_top(posts, at, 2).collect()] == ["48", "49", "46", "47"]
    stories = spark.createDataFrame([(i, i, (i % 7) * 5000, 0, 0) for i in range(50)], "id long, place long, score long, descendants long, time long")
    got = [(r.id, r.score_ranking) for r in feeds.hackernews_top(stories, at, 4).collect()]
    assert len(got) == 4 and max(i for i, _ in got) < 8 and got == sorted(got, key=lambda r: (-r[1], r[0]))


def test_digest_lists_all_changes_newest_first(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    best = spark.createDataFrame([(i, f"t{i}", "d", i % 7, None) for i in range(20)], "id long, title string, description string, score long, lifecycle string")
    changes = spark.createDataFrame([(f"s{i:03}", None, "rising", day(25 + i % 6), i % 10 == 0) for i in range(300)] + [("old", "a", "b", day(2), False)], "trend_slug string, previous string, lifecycle string, changed_at timestamp, notified boolean")
    people = spark.createDataFrame([("a@x", None, True), ("b@x", None, False), ("c@x", "slug", True)], "email string, trend_slug string, confirmed boolean")
    (mail,) = sinks.digest(best, changes, people, "2024-01-31 00:00:00").collect()
    lines = mail.body.split("Lifecycle changes\n\n")[1].split("\n")
    assert mail.email == "a@x" and lines == [f"s{i:03}: New to rising" for i in sorted((i for i in range(300) if i % 10), key=lambda i: (-(i % 6), i))]
    assert [x for x in mail.body.split("\n") if x[:2] in ("1.", "5.", "6.")] == ["1. t6", "5. t19"]
    (mail,) = sinks.digest(best.limit(0), changes.limit(0), people, "2024-01-31 00:00:00").collect()
    assert "No new opportunities" in mail.body and "No lifecycle changes" in mail.body


def test_log_of_a_write(spark, tmp_path):
    rows = spark.createDataFrame([(90, "High"), (10, "Noise"), (12, "Noise")], "score long, label string")
    line = json.loads(sinks.logged(rows, str(tmp_path / "out")))
    assert line == {"signals_in": 3, "score_range": [10, 90], "labels": {"High": 1, "Noise": 2}}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_maintained_edges_equal_a_full_count(spark, seed):
    rnd = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    snaps = [(s, a, b, start + datetime.timedelta(hours=rnd.randrange(500)), None if s % 9 == 0 else f"src{s % 3}") for s in range(80) for a, b in {tuple(rnd.sample(range(6), 2)) for _ in range(4)}]
    df = spark.createDataFrame(snaps, "signal_id long, concept_a long, concept_b long, created_at timestamp, source string")
    old, gone = F.col("signal_id") < 50, F.col("signal_id") % 3 == 0
    key = ["concept_a", "concept_b"]
    shown = lambda d: sorted((*(r[c] for c in key), r.total_weight, r.signal_count, r.first_seen, r.last_seen, tuple(sorted(r.source_distribution.items()))) for r in d.collect())
    got = concepts.maintained_edges(concepts.edges(df.filter(old)), df.filter(~old), df.filter(old & gone), df.filter(~(old & gone)))
    assert shown(got) == shown(concepts.edges(df.filter(~(old & gone))))
    none = concepts.maintained_edges(concepts.edges(df), df.limit(0), df, df.limit(0))
    assert none.count() == 0


def test_clusters_deal_many_components_to_few_tasks(spark, monkeypatch):
    rnd = random.Random(4)
    pairs = {tuple(sorted((10 * c + rnd.randrange(6), 10 * c + rnd.randrange(6)))) for c in range(60) for _ in range(9)}
    weight = {(u, v): float(rnd.randrange(2, 6)) for u, v in pairs if u != v}
    both = weight | {(v, u): w for (u, v), w in weight.items()}
    score = {n: float(rnd.randrange(100)) for n in range(700) if n % 10 < 8}
    graph = spark.createDataFrame([(u, v, w) for (u, v), w in both.items()], "u long, v long, w double")
    nodes = spark.createDataFrame(list(score.items()), "id long, score double")
    found = {}
    for seed, member in clusters.sequential(score, both):
        found.setdefault(seed, set()).add(member)
    want = {(s, m, m in score) for s, ms in found.items() if len(ms) >= clusters.LEAST_SIZE for m in ms}
    for share in (50_000, 20):
        monkeypatch.setattr(clusters, "_SHARE", share)
        assert {tuple(r) for r in clusters.greedy(nodes, graph).collect()} == want
