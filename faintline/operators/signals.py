"""Signals: normalising, keyed distinct, leader clusters of near duplicates, ranking and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintline.functions import scalar as S
from faintline.sources.storage import keep

#: Which column of each feed is the reach, the comments, the ranking score and the title.
FEEDS = {
    "reddit": ("score", "num_comments", "score", "title"),
    "hackernews": ("score", "descendants", "score_ranking", "title"),
    "producthunt": ("votes_count", None, "score_ranking", "name"),
    "github": (None, None, None, "title"),
}
SIMILAR, SHARED = 0.6, 0.5  # of titles, of keywords
_BATCH = 4096


def normalize(raw: DataFrame, feed: str) -> DataFrame:
    """One feed's rows in the common shape."""
    reach, comments, ranking, title = (F.col(c) if c else None for c in FEEDS[feed])
    zero = F.lit(0)
    engagement = F.coalesce(reach if reach is not None else zero, zero) + 2 * F.coalesce(comments if comments is not None else zero, zero)
    return raw.select(
        F.col("id").cast("string").alias("id"),
        F.coalesce(title, F.lit("")).alias("title"),
        F.lit(feed).alias("source"),
        engagement.cast("double").alias("engagement"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        "inferred_pain_point",
        "url",
        "created_at",
        F.lit(0).alias("duplicate_count"),
        F.coalesce(ranking if ranking is not None else zero, zero).cast("double").alias("source_score"),
    )


def union_feeds(feeds: list[DataFrame], order: str = "id") -> DataFrame:
    """Feeds one after the other; ``ordinal`` sorts rows by feed, then within it."""
    marked = [f.withColumn("feed", F.lit(i)) for i, f in enumerate(feeds)]
    return reduce(DataFrame.unionByName, marked).withColumn("ordinal", F.struct("feed", order)).drop("feed")


def distinct_by_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per key its last row, at the place of its first."""
    values = [c for c in df.columns if c not in (*key, order)]
    merged = df.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("__v"), F.min(order).alias(order))
    return merged.select(*key, *[F.col(f"__v.{c}").alias(c) for c in values], order)


def _representatives(df: DataFrame, ident: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(r, o, t, k) of the earliest row of each title and keyword list, and (id, r) of every row."""
    rows = df.select(F.col(ident).alias("id"), F.col(order).alias("o"), F.lower(S.strip(F.col("title"))).alias("t"), F.coalesce("keywords", F.array().cast("array<string>")).alias("k"))
    reps = keep(rows.groupBy("t", "k").agg(F.min_by("id", "o").alias("r"), F.min("o").alias("o")), "titles")
    return reps, rows.join(reps.select("t", "k", "r"), ["t", "k"]).select("id", "r", F.col("o").alias("io"))


def _ranked(each: DataFrame) -> DataFrame:
    """(r, n, w) with ``place``: the number of w among r's tokens, the rarest first."""
    seen = each.groupBy("w").agg(F.count("*").alias("df"))
    return each.join(seen, "w").withColumn("place", F.row_number().over(Window.partitionBy("r").orderBy("df", "w")))


def _title_tokens(reps: DataFrame) -> DataFrame:
    """Rare pairs of neighbouring letters, of each as many as two titles over the similarity must share one of.

    A title of n letters has n + 1 pairs with its ends. Fewer than 0.4 * n edits of two pairs each leave more than
    0.2 * n + 1 of them.
    """
    text = F.concat(F.lit("\x02"), "t", F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length("t") + 1), lambda i: F.substring(text, i, F.lit(2)))
    each = reps.select("r", F.length("t").alias("n"), F.explode(grams).alias("g")).withColumn("w", F.concat("g", F.row_number().over(Window.partitionBy("r", "g").orderBy("g")).cast("string")))
    return _ranked(each.select("r", "n", "w")).filter(F.col("place") <= F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") / 5))).select("r", "w")


def _keyword_tokens(reps: DataFrame) -> DataFrame:
    """Each keyword of each row, with its place; ``twice`` where a list names a keyword twice."""
    each = reps.select("r", F.size(F.array_distinct("k")).alias("n"), (F.size("k") > F.size(F.array_distinct("k"))).alias("twice"), F.explode(F.array_distinct("k")).alias("w"))
    return _ranked(each)


def _pairs(reps: DataFrame, ordered: bool = True) -> DataFrame:
    """(seed, other): representatives of which the first, and where ``ordered`` earlier, absorbs the second."""
    side = lambda x, r: x.select(F.col("r").alias(r), "w")
    titles = keep(_title_tokens(reps), "grams")
    words = keep(_keyword_tokens(reps), "keywords")
    some = words.filter(F.col("place") <= F.ceil(F.col("n") / 2))
    found = [(titles, titles), (some.filter("not twice"), some), (words.filter("twice"), words)]
    met = reduce(DataFrame.unionByName, [side(x, "seed").join(side(y, "other"), "w").filter("seed <> other").select("seed", "other") for x, y in found]).distinct()
    side = lambda p, r: reps.select(F.col("r").alias(r), F.col("o").alias(f"{p}_o"), F.col("t").alias(f"{p}_t"), F.col("k").alias(f"{p}_k"))
    near = (F.least(F.length("a_t"), F.length("b_t")) > SIMILAR * F.greatest(F.length("a_t"), F.length("b_t"))) & (S.edit_similarity(F.col("a_t"), F.col("b_t")) > SIMILAR)
    shared = (F.size("a_k") > 2) & (keyword_overlap(F.col("a_k"), F.col("b_k")) > SHARED)
    pairs = met.join(side("a", "seed"), "seed").join(side("b", "other"), "other")
    return pairs.filter((F.lit(not ordered) | (F.col("a_o") < F.col("b_o"))) & ((F.col("a_t") == F.col("b_t")) | near | shared)).select("seed", "other")


def similar_titles(df: DataFrame, ident: str = "id", order: str = "ordinal") -> DataFrame:
    """(seed, other): all pairs of rows of which a seed absorbs the other, the seed being the earlier one.

    Rows of equal title and keywords are compared once. Candidates share a rare pair of letters or a rare keyword,
    chosen so that no pair is lost; a seed with more than two keywords also absorbs by shared keywords.
    """
    reps, member = _representatives(df, ident, order)
    # a later representative may have earlier rows than some of an earlier one: the order of rows makes the seed
    both = _pairs(reps, ordered=False).unionByName(reps.select(F.col("r").alias("seed"), F.col("r").alias("other")))
    side = lambda r, i, o: member.select(F.col("r").alias(r), F.col("id").alias(i), F.col("io").alias(o))
    return both.join(side("seed", "a", "ao"), "seed").join(side("other", "b", "bo"), "other").filter("ao < bo").select(F.col("a").alias("seed"), F.col("b").alias("other"))


def keyword_overlap(a: Column, b: Column) -> Column:
    both = F.size(F.filter(a, lambda k: F.array_contains(b, k)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def leaders(nodes: DataFrame, pairs: DataFrame, order: str, ident: str = "id") -> DataFrame:
    """(id, leader): in order, a row not yet absorbed leads and absorbs every later row it is paired with.

    The leaders are the lexicographically first independent set of the pairs: in each round all rows whose
    earlier partners have all been decided are decided at once, by joins.
    """
    place = nodes.select(F.col(ident).alias("id"), F.col(order).alias("o"))
    edges = keep(pairs.join(place.select(F.col("id").alias("seed"), F.col("o").alias("so")), "seed").join(place.select(F.col("id").alias("other"), F.col("o").alias("oo")), "other").filter("so < oo").select("seed", "other", "so").distinct(), "pairs")
    absorbed = None
    left = edges
    while not left.isEmpty():
        # rows that no undecided row precedes lead now, and absorb what they are paired with
        now = left.select(F.col("seed").alias("id")).distinct().join(left.select(F.col("other").alias("id")).distinct(), "id", "left_anti")
        gone = keep(left.join(now.withColumnRenamed("id", "seed"), "seed", "left_semi").select(F.col("other").alias("id")).distinct(), "taken")
        absorbed = gone if absorbed is None else absorbed.unionByName(gone)
        # an absorbed row neither leads nor waits; pairs of a leader are done
        left = left.join(gone.withColumnRenamed("id", "other"), "other", "left_anti").join(gone.withColumnRenamed("id", "seed"), "seed", "left_anti")
        left = keep(left.join(now.withColumnRenamed("id", "seed"), "seed", "left_anti"), "left")
    if absorbed is None:
        return place.select("id", F.col("id").alias("leader"))
    # of the leaders a row is paired with the earliest has it, whichever was decided first
    led = edges.join(absorbed.withColumnRenamed("id", "seed"), "seed", "left_anti").groupBy(F.col("other").alias("id")).agg(F.min_by("seed", "so").alias("leader"))
    return place.select("id").join(led, "id", "left").withColumn("leader", F.coalesce("leader", "id"))


def title_leaders(df: DataFrame, order: str, ident: str = "id", batch: int = 256) -> DataFrame:
    """(id, leader) over all rows, as ``leaders`` of ``similar_titles``, without listing all pairs. Ids are whole numbers.

    Rows of equal title and keywords share the leader of the earliest. The earliest undecided ones choose their
    leaders among themselves, then these absorb all later ones they resemble; each batch is twice the one before,
    up to _BATCH, for the leaders of a batch go to all tasks.
    """
    from faintline.operators.titles import alike  # titles builds on this module

    reps, member = _representatives(df, ident, order)
    left, led = reps, None
    while not left.isEmpty():
        head = keep(left.orderBy("o").limit(batch), "head")
        of = keep(leaders(head.withColumnRenamed("r", "id"), _pairs(head), "o").withColumnsRenamed({"id": "r"}), "leaders")
        rest = keep(left.join(head.select("r"), "r", "left_anti"), "rest")
        now = head.join(of.filter("r = leader").select("r"), "r", "left_semi")
        few = [(int(x.r), x.t) for x in now.select("r", "t").collect()]
        met = alike(few, rest).unionByName(_shared(now.unionByName(rest), now)).join(rest.select(F.col("r").alias("other")), "other", "left_semi")
        taken = keep(met.join(now.select(F.col("r").alias("seed"), "o"), "seed").groupBy("other").agg(F.min_by("seed", "o").alias("leader")).withColumnRenamed("other", "r"), "taken")
        done = of.unionByName(taken)
        led = done if led is None else led.unionByName(done)
        left = keep(rest.join(taken.select("r"), "r", "left_anti"), "left")
        batch = min(2 * batch, _BATCH)
    if led is None:
        return member.select("id", F.col("r").alias("leader"))
    return member.join(led, "r").select("id", "leader")


def _shared(reps: DataFrame, left: DataFrame) -> DataFrame:
    """(seed, other): seeds of ``left`` with more than two keywords, and the representatives that share enough of them."""
    words = keep(_keyword_tokens(reps), "keywords")
    some = words.filter(F.col("place") <= F.ceil(F.col("n") / 2))
    first = lambda x: x.join(left.select("r"), "r", "left_semi")
    side = lambda x, r: x.select(F.col("r").alias(r), "w")
    met = side(first(some.filter("not twice")), "seed").join(side(some, "other"), "w").unionByName(side(first(words.filter("twice")), "seed").join(side(words, "other"), "w"))
    lists = lambda r, k: reps.select(F.col("r").alias(r), F.col("k").alias(k))
    both = met.filter("seed <> other").select("seed", "other").distinct().join(lists("seed", "a"), "seed").join(lists("other", "b"), "other")
    return both.filter((F.size("a") > 2) & (keyword_overlap(F.col("a"), F.col("b")) > SHARED)).select("seed", "other")


def dedupe(df: DataFrame, order: str = "ordinal") -> DataFrame:
    """Per leader cluster the member with most engagement (of equals the first), with the number of the others."""
    of = df.join(title_leaders(df, order), "id")
    best = F.struct((-F.col("engagement")).alias("e"), F.col(order).alias("o"))
    each = of.groupBy("leader").agg(F.min_by("id", best).alias("id"), (F.count("*") - 1).alias("__n"))
    return df.join(each.select("id", "__n"), "id").withColumn("duplicate_count", F.col("__n")).drop("__n")


def match_persisted(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """raw with the id of its stored row, found by external id, else by id, else by address."""
    out = raw
    for i, c in enumerate(("external_id", "id", "url")):
        keyed = stored.select(F.col("source"), F.col("external_id").alias(c), F.col("id").alias(f"__m{i}")).dropDuplicates(["source", c])
        out = out.join(keyed, ["source", c], "left")
    return out.withColumn("signal_id", F.coalesce("__m0", "__m1", "__m2")).drop("__m0", "__m1", "__m2")


def upsert(old: DataFrame, new: DataFrame, key: list[str], refresh: list[str]) -> DataFrame:
    """old with new's rows added; where a key is there already only ``refresh`` takes the new value."""
    values = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*values).alias("__old"))
    b = new.select(*key, F.struct(*values).alias("__new"))
    pick = lambda c: F.when(F.col("__old").isNull() | (F.col("__new").isNotNull() & F.lit(c in refresh)), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c)
    return a.join(b, key, "full_outer").select(*key, *[pick(c) for c in values])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those of new's rows whose key it lacks; null keys never match."""
    return old.unionByName(new.join(old, key, "left_anti"))
