"""Readers of landed feed payloads: one text per response in, one row per item out, in the feed's own order.

Live requests are no part of this: a landing job stores the responses, these parse them in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintline.functions import scalar as S

# The shape of each feed's items.
REDDIT = "data struct<children: array<struct<data: struct<id: string, title: string, subreddit: string, score: bigint, num_comments: bigint, created_utc: double, url: string>>>>"
HACKERNEWS = "id bigint, title string, score bigint, descendants bigint, url string, time bigint"
PRODUCTHUNT = "posts array<struct<id: bigint, name: string, tagline: string, category: string, votes_count: bigint, url: string, created_at: string>>"
GITHUB = "items array<struct<id: bigint, full_name: string, description: string, stargazers_count: bigint, created_at: string, html_url: string>>"
STACKOVERFLOW = "items array<struct<question_id: bigint, title: string, score: bigint, answer_count: bigint, link: string>>"
LEAST_SCORE, LEAST_DESCRIPTION, TAGLINE = 5, 20, 100


def _items(raw: DataFrame, schema: str, path: str, kept: list[str]) -> DataFrame:
    parsed = raw.select(*kept, F.from_json("payload", schema).alias("r"))
    return parsed.select(*kept, F.posexplode(F.col(f"r.{path}")).alias("place", "item"))


def reddit(raw: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Posts with more than the least score."""
    items = _items(raw, REDDIT, "data.children", kept or [])
    return items.select(*(kept or []), "place", "item.data.*").filter(F.col("score") > LEAST_SCORE).withColumn("created_at", F.timestamp_seconds("created_utc"))


def hackernews(ids: DataFrame, items: DataFrame, most: int = 50) -> DataFrame:
    """Stories of an id list (id, place), in its order; without items or titles they are left out."""
    parsed = items.select(F.from_json("payload", HACKERNEWS).alias("i")).select("i.*").filter("title IS NOT NULL")
    return ids.filter(F.col("place") < most).join(parsed, "id").withColumn("descendants", F.coalesce("descendants", F.lit(0)))


def reddit_top(posts: DataFrame, as_of: str, limit: int = 15) -> DataFrame:
    """The posts of the best rank, twice ``limit`` of them, best first; equal ranks by id."""
    ranked = posts.withColumn("score_ranking", S.score_reddit(F.col("score"), F.col("num_comments"), S.age_days(F.col("created_at"), as_of)))
    return ranked.orderBy(F.desc("score_ranking"), "id").limit(2 * limit)


def hackernews_top(stories: DataFrame, as_of: str, limit: int = 15) -> DataFrame:
    """Of the first stories of the list, twice ``limit`` of them, the ``limit`` of the best rank, best first; equal places and ranks by id."""
    first = stories.orderBy("place", "id").limit(2 * limit).withColumn("i", F.row_number().over(Window.orderBy("place", "id")) - 1)
    age = S.age_days(F.timestamp_seconds("time"), as_of)
    return first.withColumn("score_ranking", S.score_hackernews(F.col("score"), F.col("descendants"), F.col("i"), age)).orderBy(F.desc("score_ranking"), "id").limit(limit)


def producthunt(raw: DataFrame, kept: list[str] | None = None) -> DataFrame:
    return _items(raw, PRODUCTHUNT, "posts", kept or []).select(*(kept or []), "place", "item.*")


def github(raw: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Repositories with a telling description, and the score of their stars."""
    items = _items(raw, GITHUB, "items", kept or []).select(*(kept or []), "place", "item.*")
    return items.filter(F.length("description") > LEAST_DESCRIPTION).withColumn("score_ranking", S.score_github(F.col("stargazers_count")))


def stackoverflow(raw: DataFrame, kept: list[str] | None = None) -> DataFrame:
    return _items(raw, STACKOVERFLOW, "items", kept or []).select(*(kept or []), "place", "item.*")


_ENTRY = "title: string, link: struct<_VALUE: string, _href: string>, description: string, summary: string, pubDate: string, published: string"
#: Where the items of RSS 2, of RSS 1 and of Atom are.
XML = f"channel struct<item: array<struct<{_ENTRY}>>>, item array<struct<{_ENTRY}>>, entry array<struct<{_ENTRY}>>, _damaged string"


_FIELDS = ("title", "link", "description", "summary", "pubDate", "published")
_XML_OPTIONS = {"columnNameOfCorruptRecord": "_damaged", "ignoreNamespace": "true", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}
#: A comment, CDATA or a whole item or entry.
_PIECE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(item|entry)\b(?:<!\[CDATA\[.*?\]\]>|[^<]|<(?!!\[CDATA\[|/?(?:item|entry)\b))*+</\1>"


def _parsed(raw: DataFrame) -> Column:
    return F.from_xml("payload", XML, _XML_OPTIONS)


def rss(raw: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Items of RSS or entries of Atom that have a title and a link; deterministic votes in place of random ones.

    Markup inside a text goes, entities and CDATA are read, namespaces left out. A text that is no XML is among the
    ``damaged``; its items that are whole are read one by one.
    """
    kept = kept or []
    torn = F.col("x._damaged").isNotNull()
    items = F.transform(F.coalesce("x.channel.item", "x.item", "x.entry"), lambda i: F.struct(i.alias("i"), F.lit(None).cast("string").alias("piece")))
    # comments and CDATA are skipped as one, so that an end named in them ends nothing
    pieces = F.filter(F.regexp_extract_all("payload", F.lit(_PIECE), F.lit(0)), lambda p: ~p.startswith("<!"))
    none = F.lit(None).cast(f"struct<{_ENTRY}>")
    single = F.transform(pieces, lambda p: F.struct(none.alias("i"), p.alias("piece")))
    rows = raw.select(*kept, "payload", _parsed(raw).alias("x")).select(*kept, F.posexplode(F.when(torn, single).otherwise(items)).alias("place", "e")).select(*kept, "place", "e.i", F.from_xml("e.piece", f"struct<{_ENTRY}, _damaged: string>", _XML_OPTIONS).alias("p"))
    rows = rows.withColumn("i", F.coalesce("i", F.when(F.col("p._damaged").isNull(), F.struct(*[F.col(f"p.{c}").alias(c) for c in _FIELDS]))))
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", ""))
    body, link = F.coalesce("i.description", "i.summary"), F.coalesce(F.nullif(F.trim("i.link._VALUE"), F.lit("")), "i.link._href")
    out = rows.select(*kept, "place", plain(F.col("i.title")).alias("title"), F.substring(plain(body), 1, TAGLINE).alias("tagline"), F.trim(F.coalesce(link, F.lit(""))).alias("url"), F.coalesce("i.pubDate", "i.published").alias("published"))
    return out.filter("title <> '' AND url <> ''").withColumn("votes_count", 100 + F.pmod(F.xxhash64("url"), F.lit(500)))


def damaged(raw: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """The texts that are no XML."""
    return raw.select(*(kept or []), "payload", _parsed(raw).alias("x")).filter("x._damaged IS NOT NULL").drop("x")


def gap_filled(first: DataFrame, second: DataFrame, most: int = 10) -> DataFrame:
    """The first feed's rows, then as many of the second's as there is room for; both have ``place``."""
    both = first.withColumn("feed", F.lit(0)).unionByName(second.withColumn("feed", F.lit(1)))
    return both.filter(F.col("place") < most).orderBy("feed", "place").limit(most)
