"""Near duplicates by fast similarity sketching, banding and exact verification.

1. Sketch: in round i every shingle of a set is thrown into one of ``T`` bins by a hash of that round, with a value of i and
   a random fraction; a bin keeps its least value. A set is done when all bins are filled; after T rounds, round T + b puts
   all shingles into bin b, so that after 2 * T rounds every bin is filled, however small the set. Two sets agree in a bin
   with the probability of their Jaccard similarity, and the share of bins in which they agree is as concentrated around it
   as that of T independent coins.
2. Banding: ``ROWS`` bins make one of ``BANDS`` keys; sets that share a key meet. Two sets at the threshold of 0.8 miss each
   other in all bands with a probability of (1 - 0.8**5)**40 = 1.3e-7, and agree in less than ``LOW`` bins with 1e-8.
3. Exact links around leaders: the least set of each bucket leads it; every set follows the leader whose sketch is nearest to
   its own, and the followers of a leader are compared with it and each other by full sets, ``_PART`` of them at a time. The
   components of these links hold most copies.
4. Exact links across components: only buckets that still hold several components go on. Their sets are cut into parts of
   about ``_PART``, by component where it is large, and compared by sketches, two parts or so at a time, those of the bucket's
   largest component only with the others. Parts of which any two
   sets of different components have near sketches are compared by full sets, small parts with common partners together.

No bucket, group or component is held in one task, and no pair of documents is ever a row. The work that remains quadratic is that of a bucket of many *different* sets that are
not linked: n * n / 2 comparisons of sketches in blocks.

Defined results: null text or one without words has the empty set, links with nothing and is its own component; a text with
fewer than ``k`` words is one shingle; texts are read whole; equal texts and repeated rows share a component, and of repeated
rows of the kept id each is kept; a component of null ids alone has a null id and is kept; an empty table gives no rows; other
columns stay out of the way. Sets are named by 64 bits of their digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintline.llm.common import discard, keep, slices, spread_join
from faintline.llm.jaccard import _name, _sets, _spread, compared, mix
from faintline.operators.graph import components

K, NUM, DEN = 4, 80, 100
ROWS, BANDS = 5, 40
T = ROWS * BANDS
#: Bins that two sets at the threshold agree in at least, six deviations below the mean.
LOW = int(T * NUM / DEN - 6 * (T * NUM / DEN * (1 - NUM / DEN)) ** 0.5)
#: Sets and shingles of a part, about; sketches that are compared with as many others at a time, about; from so many members
#: on a component has parts of its own.
_PART, _TOKENS, _BLOCK, _LARGE = 256, 1 << 19, 1024, 64
_SLICE = 1 << 18
_EMPTY = np.uint64((1 << 64) - 1)


def sketch(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t filled bins per set (of distinct 64-bit numbers, none empty): the round above 32 bits of hash."""
    m = len(sets)
    out = np.full(m * t, _EMPTY)
    tokens = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    low = np.uint64((1 << 32) - 1)
    for i in range(2 * t):
        if not len(tokens):
            break
        h = mix(tokens ^ mix(np.full(1, i + (7 << 32), np.uint64)))
        bins = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if i < t else np.uint64(i - t)
        np.minimum.at(out, owner * t + bins.astype(np.int64), (h & low) | np.uint64(i << 32))
        open_ = (out.reshape(m, t) == _EMPTY).any(axis=1)[owner]
        tokens, owner = tokens[open_], owner[open_]
    return out.reshape(m, t)


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The keys of each sketch, one per band; those of different bands never meet."""
    m, t = sketches.shape
    parts = sketches.reshape(m, t // rows, rows)
    out = np.broadcast_to(mix(np.arange(t // rows, dtype=np.uint64) + np.uint64(11 << 32)), (m, t // rows)).copy()
    for j in range(rows):
        out = mix(out ^ parts[:, :, j])
    return out.view(np.int64)


def signatures(sketches: np.ndarray) -> np.ndarray:
    """Eight bits of each bin: enough to count agreements from above."""
    return (mix(sketches) >> np.uint64(56)).astype(np.uint8)


def profiles(df: DataFrame, ident: str, text: str, k: int) -> DataFrame:
    """(doc_id, sid, n, bands, signature): each row's set by name and size, its band keys and short sketch."""
    rows = df.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            sets = _sets(batch, k)
            some = np.array([len(s) > 0 for s in sets], bool)
            made = sketch([s for s in sets if len(s)])
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands(made).reshape(-1)))
            short = iter(signatures(made))
            signature = pa.array([next(short).tobytes() if s else b"" for s in some], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), keys, signature], ["doc_id", "sid", "n", "bands", "signature"])

    return rows.mapInArrow(run, "doc_id bigint, sid bigint, n bigint, bands array<bigint>, signature binary")


def _bytes(column: pa.Array) -> np.ndarray:
    """Rows of T bytes."""
    return np.array([np.frombuffer(x, np.uint8) for x in column.to_pylist()], np.uint8).reshape(-1, T)


def leaders(met: DataFrame, short: DataFrame) -> DataFrame:
    """(sid, lead): of the leaders of a set's buckets that whose sketch is nearest, if near enough for a link. short: (sid, set)."""
    pairs = met.filter("sid <> lead").select("sid", "lead").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            agree = (_bytes(batch.column("a")) == _bytes(batch.column("b"))).sum(axis=1)
            near = pa.array(agree >= LOW)
            yield pa.RecordBatch.from_arrays([batch.column("sid").filter(near), batch.column("lead").filter(near), pa.array(agree).filter(near)], ["sid", "lead", "agree"])

    both = _spread(_spread(pairs, short, "sid", "a"), short, "lead", "b", pairs).select("sid", "lead", "a", "b")
    return both.mapInArrow(run, "sid bigint, lead bigint, agree bigint").groupBy("sid").agg(F.max(F.struct("agree", "lead")).alias("best")).select("sid", F.col("best.lead").alias("lead"))


def stars(led: DataFrame) -> DataFrame:
    """Units for ``jaccard.compared``: the followers of a leader, _PART of them at a time, each time with the leader."""
    size = led.groupBy("lead").agg(F.count("*").alias("n_rows"), F.ceil(F.count("*") / _PART).cast("int").alias("chunks"))
    dealt = spread_join(led, size, "lead").select("lead", F.pmod(F.xxhash64("sid"), "chunks").cast("int").alias("chunk"), "sid")
    heads = size.select("lead", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("lead").alias("sid"))
    return _unit(dealt.unionByName(heads), "lead", F.col("chunk"), F.col("chunk"), 0)


def _unit(rows: DataFrame, group: str, a, b, role) -> DataFrame:
    """(group, a, b, chunk, role, sid, weight) as ``jaccard.compared`` takes them: a = b compares all of a unit, else its two roles."""
    return rows.select(F.col(group).alias("group"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), F.lit(0).alias("chunk"), F.lit(role).alias("role"), "sid", F.lit(1).cast("bigint").alias("weight"))


def gathered(df: DataFrame, wanted: DataFrame, ident: str, text: str, k: int) -> DataFrame:
    """(sid, set) of the sets wanted (sid, doc_id), made anew from one text of each.

    Texts that aren't wanted are left out where they are read, by a bitmap of at most 32 MB over hashes of the ids; what it
    lets through by chance goes by name. So sets are shuffled, texts never.
    """
    bits = 1 << min(28, max(15, (16 * wanted.count()).bit_length()))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    held = wanted.select(F.floor(spot / 32768).alias("page"), (spot % 32768).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    pages = np.zeros((bits // 32768, 4096), np.uint8)
    for row in held:
        pages[row.page] = np.frombuffer(row.bits, np.uint8)
    pages = pages.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("spot").to_numpy()
            some = batch.filter(pa.array((pages[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for part in slices([some], "text", _SLICE) if some.num_rows else ():
                sets = [s for s in _sets(part, k) if len(s)]
                values = pa.array(np.concatenate(sets).view(np.int64)) if sets else pa.array([], pa.int64())
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["sid", "set"])

    rows = df.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text")).select(spot.alias("spot"), "text")
    made = rows.mapInArrow(run, "sid bigint, set array<bigint>")
    return keep(made.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "tokens")


def parts(sets: DataFrame) -> DataFrame:
    """(sid, root, part) of sets (sid, n, group, root): a group's large components have parts of their own, its small ones share some."""
    of_root = sets.withColumn("key", F.xxhash64("group", "root"))
    sized = spread_join(of_root, of_root.groupBy("key").agg(F.count("*").alias("n_rows"), F.count("*").alias("of_root")), "key")
    own = F.when(F.col("of_root") >= _LARGE, F.col("root"))
    sharing = sized.select("sid", "n", "root", F.xxhash64("group", F.coalesce(own, F.lit(0)), own.isNull()).alias("key"))
    total = sharing.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"), F.count("*").alias("n_rows"))
    number = F.pmod(F.xxhash64("sid"), F.greatest(F.ceil(F.col("members") / _PART), F.ceil(F.col("tokens") / _TOKENS)))
    return spread_join(sharing, total, "key").select("sid", "n", "root", F.xxhash64("key", number).alias("part"))


def asked(mixed: DataFrame, short: DataFrame) -> DataFrame:
    """(x, y): parts that must be compared with each other (x >= y). mixed: (band, major, n_major, n_minor, sid, root, part).

    In a bucket, the sets of its largest component (major) meet only those of the others, and these each other.
    """
    blocks = lambda n: F.ceil(F.col(n) / _BLOCK).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    large = F.col("root") == F.col("major")
    rows = mixed.withColumn("own", F.pmod("part", F.when(large, blocks("n_major")).otherwise(blocks("n_minor"))).cast("int"))
    minor, rest = rows.filter(~large), ["sid", "root", "part"]
    among = minor.withColumn("o", upto("n_minor")).select("band", F.lit(0).alias("kind"), F.greatest("own", "o").alias("a"), F.least("own", "o").alias("b"), (F.col("own") > F.col("o")).cast("int").alias("role"), *rest)
    one = minor.withColumn("o", upto("n_major")).select("band", F.lit(1).alias("kind"), F.col("o").alias("a"), F.col("own").alias("b"), F.lit(1).alias("role"), *rest)
    other = rows.filter(large).withColumn("o", upto("n_minor")).select("band", F.lit(1).alias("kind"), F.col("own").alias("a"), F.col("o").alias("b"), F.lit(0).alias("role"), *rest)
    rows = among.unionByName(one).unionByName(other)

    def unit(held: list[tuple], across: bool) -> pa.RecordBatch:
        role, root, part, raw = (np.array(x) if i < 3 else x for i, x in enumerate(zip(*held, strict=True)))
        sig = np.array([np.frombuffer(x, np.uint8) for x in raw])
        out = set()
        for i in np.flatnonzero(role == 1) if across else range(len(role)):
            other = np.flatnonzero(role == 0) if across else np.arange(i)
            other = other[root[other] != root[i]]
            other = other[(sig[other] == sig[i]).sum(axis=1) >= LOW] if len(other) else other
            out.update((max(p, int(part[i])), min(p, int(part[i]))) for p in np.unique(part[other]).tolist())
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("role", "root", "part", "set")]
            for key, row in zip(zip(*(batch.column(c).to_pylist() for c in ("band", "kind", "a", "b")), strict=True), zip(*columns, strict=True), strict=True):
                if key != now and held:
                    yield unit(held, now[1] == 1 or now[2] != now[3])
                    held = []
                now = key
                held.append(row)
        if held:
            yield unit(held, now[1] == 1 or now[2] != now[3])

    with_sketch = _spread(rows, short, "sid", "set")
    return with_sketch.repartition("band", "kind", "a", "b").sortWithinPartitions("band", "kind", "a", "b").mapInArrow(run, "x bigint, y bigint").distinct()


def pools(ask: DataFrame, member: DataFrame) -> DataFrame:
    """(part, pool): small parts that must all be compared with one part share pools of about ``_PART`` sets. member: (sid, n, part)."""
    ends = ask.select(F.inline(F.array(F.struct(F.col("x").alias("part"), F.col("y").alias("near")), F.struct(F.col("y").alias("part"), F.col("x").alias("near")))))
    head = ends.groupBy("part").agg(F.least(F.min("near"), F.col("part")).alias("head"))
    size = member.groupBy("part").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    sized = keep(head.join(size, "part"), "sized")
    small = (2 * F.col("members") < _PART) & (2 * F.col("tokens") < _TOKENS)
    total = sized.filter(small).groupBy("head").agg(F.sum("members").alias("all"), F.sum("tokens").alias("all_tokens"), F.count("*").alias("n_rows"))
    number = F.pmod(F.xxhash64("part"), F.greatest(F.ceil(F.col("all") / _PART), F.ceil(F.col("all_tokens") / _TOKENS)))
    pooled = spread_join(sized.filter(small), total, "head").select("part", F.xxhash64("head", number).alias("pool"))
    out = keep(pooled.unionByName(sized.filter(~small).select("part", F.col("part").alias("pool"))), "pools")
    discard(sized)
    return out


def units(ask: DataFrame, member: DataFrame, pool: DataFrame) -> DataFrame:
    """Units for ``jaccard.compared``: the asks between two pools (or within one) at once, each part of them laid out once."""
    of = lambda c: pool.select(F.col("part").alias(c), F.col("pool").alias(f"of_{c}"))
    met = ask.join(of("x"), "x").join(of("y"), "y")
    ends = F.inline(F.array(F.struct(F.col("x").alias("part"), F.col("of_x").alias("pool")), F.struct(F.col("y").alias("part"), F.col("of_y").alias("pool"))))
    each = met.select(F.greatest("of_x", "of_y").alias("a"), F.least("of_x", "of_y").alias("b"), ends).distinct()
    rows = each.join(member.select("part", "sid"), "part")
    return _unit(rows, "a", F.col("a"), F.col("b"), (F.col("pool") == F.col("a")).cast("int"))


def links(profile: DataFrame, df: DataFrame, ident: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(u, v): edges between the names of sets that join all linked sets."""
    once = keep(profile.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "once")
    keys = once.select("sid", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("n_rows"), F.min("sid").alias("lead")).filter("n_rows > 1")
    met = keep(spread_join(keys, shared, "band").filter("lead IS NOT NULL"), "buckets")
    # sets that share no band have no links
    sets = keep(once.drop("bands").join(met.select("sid").distinct(), "sid", "left_semi"), "sketched")
    discard(once)
    short = sets.select("sid", F.col("signature").alias("set"))
    led = keep(leaders(met, short), "leaders")
    first = keep(led.select("sid").unionByName(led.select(F.col("lead").alias("sid"))).distinct(), "followers")
    full = gathered(df, sets.join(first, "sid", "left_semi").select("sid", "doc_id"), ident, text, k)
    near = compared(_spread(stars(led), full, "sid", "set"), num, den)
    label = keep(components(near.select(F.col("sid").alias("u"), F.col("root").alias("v"))), "labels")
    rooted = met.join(label.select(F.col("u").alias("sid"), F.col("v").alias("root")), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    of_root = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    several = of_root.groupBy("band").agg(F.sum("n").alias("n_rows"), F.max(F.struct("n", "root")).alias("most")).filter("n_rows > most.n")
    several = several.select("band", "n_rows", F.col("most.root").alias("major"), F.col("most.n").alias("n_major"), (F.col("n_rows") - F.col("most.n")).alias("n_minor"))
    mixed = keep(spread_join(rooted.select("band", "sid", "root"), several, "band").filter("major IS NOT NULL"), "mixed")
    left = mixed.select("sid", "root").distinct().join(sets.select("sid", "n"), "sid").join(led, "sid", "left").withColumn("group", F.coalesce("lead", "sid")).drop("lead")
    member = keep(parts(left), "parts")
    ask = keep(asked(mixed.drop("root").join(member, "sid"), short), "asks")
    inside = keep(member.join(ask.select(F.explode(F.array("x", "y")).alias("part")).distinct(), "part", "left_semi"), "inside")
    rest = gathered(df, sets.join(inside.select("sid").join(first, "sid", "left_anti"), "sid", "left_semi").select("sid", "doc_id"), ident, text, k)
    pool = pools(ask, inside)
    unit = keep(units(ask, inside, pool), "units")
    across = compared(_spread(unit, full.unionByName(rest), "sid", "set"), num, den)
    out = keep(label.unionByName(across.select(F.col("sid").alias("u"), F.col("root").alias("v"))), "edges")
    discard(met, sets, led, first, full, label, mixed, member, ask, inside, rest, pool, unit)
    return out


def near_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text", k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept (whether the row has the component's least id).

    Bands and ``LOW`` are made for similarities of 0.8 or more: a lower threshold would lose links.
    """
    if 100 * num < NUM * den:
        raise ValueError(f"the bands are made for similarities of {NUM / DEN} or more")
    profile = keep(profiles(df, ident, text, k), "profiles")
    rows = keep(profile.select("doc_id", "sid", "n"), "rows")
    found = links(profile, df, ident, text, k, num, den)
    discard(profile)
    roots = components(found)
    full = rows.filter("n > 0")
    of_set = full.groupBy("sid").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_rows"))
    root = of_set.join(roots.select(F.col("u").alias("sid"), F.col("v").alias("root")), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    root = keep(root, "roots")
    lows = root.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n_rows"))
    named = keep(spread_join(root.withColumn("copies", F.col("n_rows")), lows, "root").select("sid", F.col("copies").alias("n_rows"), "component_id"), "named")
    discard(root)
    alone = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    all_ = spread_join(full, named, "sid").unionByName(alone)
    return all_.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
