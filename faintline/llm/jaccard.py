"""Set similarity join on word shingles by a token-group matrix, exact at its threshold.

1. Every text becomes its set of shingles, each a 64-bit number; equal sets count once.
2. Matrix: under a common order of tokens (those found in many texts last), two sets that reach the threshold
   share a token among the first few of each. The rows (token, set) of those first tokens make the matrix; tokens
   of one set only are dropped at once.
3. Grouping: sets that agree in many of a few min-hashes with the most central set of a min-hash bucket (that
   whose min-hashes are shared most) form its group; groups are cut into parts of about ``_GROUP`` sets.
4. Bound: a set must look at a part of another group only if they share enough first tokens for the part's sizes.
   Of parts of several sets that are still in question the union of all tokens is stored; a part opens for a set
   only if the overlap of the set and the union reaches what the set needs with any partner.
5. Opened parts, and the parts of one group among themselves, are compared in units of at most about two parts,
   all pairs of a unit by one product of token incidences; a unit gives back one row per set that has links
   (its number of links, and the least set it is joined with), never its pairs.

The order of tokens steers cost, not results, so a bounded list of the heaviest tokens is enough for it; they are
counted exactly, by a shuffle of packed token ranges. The rest is distributed. No list of documents, links or
tokens of all documents reaches the driver. Every two linked sets meet in exactly one unit, so counts are exact.

Work that stays quadratic: within one group every two different sets are compared, in blocks, though not emitted.

Defined results: null text or one without words has the empty set, links with nothing and is its own component;
a text with fewer than ``k`` words is one shingle; texts are read whole; equal texts, and rows repeated, share a
component and count as links of each other; of null ids the component's least id takes no notice (null, where
there is no other); an empty table gives no rows; other columns of any name stay out of the way. Sets are named by
64 bits of their digest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.llm.common import discard, fresh, keep, slices, spread_join
from faintline.operators.graph import components

K, NUM, DEN = 5, 75, 100
_SLICE = 1 << 18
_HEAVY, _HEAVY_LEAST = 100_000, 64
#: Min-hashes of a set, how many of them make buckets, and the share in which a set agrees with its group's leader.
_BINS, _BUCKETS, _ALIKE = 16, 6, 7 / 16
#: Sets and tokens of a part of a group, about; pairs that one copy of a set serves; columns of one product.
_GROUP, _TOKENS, _SHARE, _COLUMNS = 128, 1 << 19, 2000, 4096
_BUFFER = 400_000
_TAG = np.uint64(3)  # the two lowest bits of a first token: serves towards larger sets; is heavy
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixing permutation of 64-bit numbers."""
    x = (x + np.uint64(_MIX[0])).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256, dtype=np.uint64)
_BYTE[65:91] += np.uint64(32)  # A-Z as a-z
_VALUE = mix(_BYTE + np.uint64(1 << 32))
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


@functools.lru_cache(maxsize=4)
def _weights(size: int) -> np.ndarray:
    return mix(np.arange(size, dtype=np.uint64) + np.uint64(1 << 33)) | np.uint64(1)


def shingles(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit numbers."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
    white = _WHITE[buf]
    before = np.concatenate([[True], white[:-1]]) if len(buf) else white
    start = np.flatnonzero(~white & before)
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    end = np.flatnonzero(white & ~before)
    length = end - start
    letters = np.flatnonzero(~white)
    first = np.cumsum(length) - length
    offset = np.arange(len(letters)) - np.repeat(first, length)
    top = 1 << max(6, int(length.max()).bit_length())
    words = mix(np.add.reduceat(_VALUE[buf[letters]] * _weights(top)[offset], first) ^ length.astype(np.uint64))
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    counts = np.diff(bounds)
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k if len(grams) else 0):
        grams += words[j : len(words) - k + 1 + j] * np.uint64(2 * j + 1 + _MIX[j % 3] * 2 & (1 << 64) - 1)
    grams = mix(grams)
    out = []
    for a, n in zip(bounds[:-1].tolist(), counts.tolist(), strict=True):
        if n >= k:
            s = np.sort(grams[a : a + n - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            h = xxhash.xxh64(words[a : a + n].tobytes(), seed=n)
            out.append(np.array([h.intdigest()], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _name(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else 0


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return shingles([(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()], k)


def _packed(parts: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Tokens (their 52 upper bits) and counts, one row per range of tokens: 5 bytes a token, 4 a count above one."""
    token, n = np.unique(np.concatenate(parts) >> np.uint64(12), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    columns = {}
    part = (token >> np.uint64(52 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.concatenate([first, [len(part)]])
    raw = np.ascontiguousarray(token.view(np.uint8).reshape(-1, 8)[:, :5])
    several = np.flatnonzero(n > 1)
    at = np.searchsorted(several, ends)
    # where in its range a token of several texts stands, and in how many
    where = (several - ends[np.searchsorted(ends, several, side="right") - 1]) if len(several) else several
    for name, values, cuts in (("low", raw, ends * 5), ("at", where.astype(np.uint32), at * 4), ("n", n[several].astype(np.uint32), at * 4)):
        columns[name] = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), *columns.values()], ["part", *columns])


def _unpacked(low: bytes, at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.zeros((len(low) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
    count = np.ones(len(raw), np.int64)
    count[np.frombuffer(at, np.uint32)] = np.frombuffer(n, np.uint32)
    return raw.view(np.uint64).reshape(-1), count


def token_counts(rows: DataFrame, k: int, least: int) -> DataFrame:
    """(token, n): the tokens, by their 52 upper bits, that ``least`` texts or more hold, counted over all texts."""
    bits = max(12, min(40, (rows.count() >> 12).bit_length()))  # a range holds the tokens of a few thousand texts at most

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in slices(batches, "text", _SLICE):
            for s in _sets(batch, k):
                parts.append(s)
                size += len(s)
            if size > _BUFFER:
                yield _packed(parts, bits)
                parts, size = [], 0
        yield _packed(parts, bits)

    def total(held: list[tuple[bytes, bytes, bytes]], part: int) -> pa.RecordBatch:
        tokens, counts = zip(*(_unpacked(*x) for x in held), strict=True)
        token, where = np.unique(np.concatenate(tokens), return_inverse=True)
        n = np.bincount(where, np.concatenate(counts)).astype(np.int64)
        often = n >= least
        top = np.uint64(part << (52 - bits)) >> np.uint64(40) << np.uint64(40)
        return pa.RecordBatch.from_arrays([pa.array((token[often] | top).view(np.int64)), pa.array(n[often])], ["token", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "at", "n")), strict=True):
                if part != now and held:
                    yield total(held, now)
                    held = []
                now = part
                held.append(tuple(blobs))
        if held:
            yield total(held, now)

    packed = rows.select("text").mapInArrow(local, "part bigint, low binary, at binary, n binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "token bigint, n bigint")


def _heavy_tokens(rows: DataFrame, k: int) -> np.ndarray:
    """The tokens (52 upper bits) found in most texts, the most frequent last; at most _HEAVY of them."""
    top = token_counts(rows, k, _HEAVY_LEAST).orderBy(F.desc("n"), "token").limit(_HEAVY).collect()
    return np.array([r.token for r in reversed(top)], np.int64).view(np.uint64)


def first_tokens(s: np.ndarray, heavy: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(the tokens of a set that come first in the common order, how many of them serve towards larger sets, which are heavy).

    A partner of any size shares at least ceil(num / den * n) tokens, a larger one ceil(2 * num / (num + den) * n):
    among the n less that many plus one first tokens of either set there is a shared one.
    """
    n = len(s)
    many = n + num * -n // den + 1
    short = n + 2 * num * -n // (num + den) + 1
    late = 0
    if len(heavy):
        upper = s >> np.uint64(12)
        at = np.minimum(np.searchsorted(heavy, upper), len(heavy) - 1)
        is_heavy = heavy[at] == upper
        late = int(is_heavy.sum())
        if late:
            s = np.concatenate([s[~is_heavy], s[is_heavy][np.argsort(rank[at[is_heavy]], kind="stable")]])
    return s[:many], short, np.arange(many) >= n - late


def _min_hashes(s: np.ndarray) -> np.ndarray:
    """The least token of each of _BINS ranges that has one: tokens are hashes already, and the set is sorted."""
    at = np.searchsorted(s, np.arange(_BINS, dtype=np.uint64) << np.uint64(64 - _BINS.bit_length() + 1))
    at = at[at < len(s)]
    return s[np.unique(at)] if len(at) else s[:0]


def profiles(df: DataFrame, ident: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, sid, n, mins, firsts): each row's set by name, size, min-hashes and first tokens (tagged as by _TAG)."""
    rows = df.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    by_rank = _heavy_tokens(rows, k)
    rank = np.argsort(by_rank)
    heavy = by_rank[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in slices(batches, "text", _SLICE):
            names, sizes, mins, firsts = [], [], [], []
            for s in _sets(batch, k):
                names.append(_name(s))
                sizes.append(len(s))
                if len(s):
                    mins.append(_min_hashes(s).view(np.int64))
                    tokens, short, is_heavy = first_tokens(s, heavy, rank, num, den)
                    firsts.append((tokens & ~_TAG | (np.arange(len(tokens)) < short).astype(np.uint64) | is_heavy.astype(np.uint64) << np.uint64(1)).view(np.int64))
                else:
                    mins.append(none)
                    firsts.append(none)
            lists = lambda parts: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), lists(mins), lists(firsts)], ["doc_id", "sid", "n", "mins", "firsts"])

    return rows.mapInArrow(run, "doc_id bigint, sid bigint, n bigint, mins array<bigint>, firsts array<bigint>")


def named(df: DataFrame, text: str, k: int, sid: str, size: str) -> DataFrame:
    """df with the columns ``sid`` and ``size``: name and size of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, _SLICE):
            found = shingles([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_name(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64())], [*batch.schema.names, sid, size])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(sid, T.LongType()), T.StructField(size, T.LongType())]))


def _spread(pairs: DataFrame, sets: DataFrame, key: str, out: str, by: DataFrame | None = None) -> DataFrame:
    """pairs with the set of ``key`` as ``out``. A set that very many pairs ask for is laid out in several copies.

    by: rows with the same keys that are cheaper to count than pairs, where those come from a join.
    """
    asked = (pairs if by is None else by).groupBy(key).agg(F.floor(F.count("*") / _SHARE).cast("int").alias("__more"))
    copies = sets.withColumnRenamed("sid", key).join(asked, key).select(key, F.col("set").alias(out), F.explode(F.sequence(F.lit(0), "__more")).alias("__copy"), F.col("__more"))
    hot = asked.filter("__more > 0")
    spread = pairs.join(hot, key, "left").withColumn("__copy", F.pmod(F.xxhash64(*pairs.columns), F.coalesce(F.col("__more"), F.lit(0)) + 1).cast("int")).drop("__more")
    return spread.join(copies.drop("__more"), [key, "__copy"]).drop("__copy")


def matrix(once: DataFrame) -> DataFrame:
    """(token, sid, short) of the first tokens that more than one set has."""
    tokens = once.select("sid", F.explode("firsts").alias("t"))
    token = F.col("t").bitwiseAND(F.lit(~int(_TAG)))
    tokens = tokens.select("sid", token.alias("token"), F.col("t").bitwiseAND(F.lit(1)).alias("short"), (F.col("t").bitwiseAND(F.lit(2)) > 0).alias("heavy"))
    # heavy tokens are known to be shared; of all others no one is found often enough to burden a task
    same = Window.partitionBy("token")
    rare = tokens.filter("not heavy").withColumn("__lo", F.min("sid").over(same)).withColumn("__hi", F.max("sid").over(same)).filter("__lo < __hi")
    return rare.select("token", "sid", "short").unionByName(tokens.filter("heavy").select("token", "sid", "short"))


def groups(sets: DataFrame) -> DataFrame:
    """(sid, n, weight, group, members, part): sets dealt to groups of similar ones. sets: sid, n, weight, mins."""
    hashes = sets.select("sid", "mins", F.explode(F.slice("mins", 1, _BUCKETS)).alias("hash"))
    shared = hashes.groupBy("hash").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    met = keep(spread_join(hashes, shared.withColumn("held", F.col("n_rows")), "hash").filter("held is not null"), "buckets")
    central = met.groupBy("sid").agg(F.sum("held").alias("central"))
    ranked = met.join(central, "sid")
    lead = ranked.groupBy("hash").agg(F.max(F.struct("central", "sid", "mins")).alias("lead"), F.count("*").alias("n_rows"))
    near = spread_join(ranked.select("sid", "mins", "hash"), lead, "hash")
    alike = F.size(F.array_intersect("mins", "lead.mins")) >= _ALIKE * F.greatest(F.size("mins"), F.size("lead.mins"))
    best = near.filter(alike).groupBy("sid").agg(F.max(F.struct(F.col("lead.central").alias("central"), F.col("lead.sid").alias("lead"))).alias("best"))
    first = keep(sets.select("sid", "n", "weight").join(best.select("sid", F.col("best.lead").alias("lead")), "sid", "left").withColumn("lead", F.coalesce("lead", "sid")), "leaders")
    # a leader may follow another one: its group goes with it
    follow = first.groupBy("lead").agg(F.count("*").alias("n_rows")).withColumnRenamed("lead", "id")
    of_lead = first.select(F.col("sid").alias("id"), F.col("lead").alias("group"))
    second = keep(spread_join(first.withColumnRenamed("lead", "id"), of_lead.join(follow, "id"), "id").withColumn("group", F.coalesce("group", "sid")).drop("id"), "followed")
    size = second.groupBy("group").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"), F.count("*").alias("n_rows"))
    parts = F.greatest(F.ceil(F.col("members") / _GROUP), F.ceil(F.col("tokens") / _TOKENS)).cast("int")
    dealt = spread_join(second, size.withColumn("parts", parts).drop("tokens"), "group")
    out = keep(dealt.withColumn("part", F.pmod(F.xxhash64("sid"), "parts").cast("int")), "groups")
    discard(met, first, second)
    return out


def asks(shared: DataFrame, member: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, group, part, g_sets): which sets must look at which parts of other groups."""
    of = shared.join(member, "sid")
    sizes = member.groupBy("group", "part").agg(F.min("n").alias("g_least"), F.max("n").alias("g_most"), F.count("*").alias("g_sets"))
    rows_of = of.groupBy("token", "group", "part").agg(F.first("members").alias("g_members"), F.max("short").alias("g_short")).join(sizes, ["group", "part"])
    wide = rows_of.withColumnsRenamed({"group": "g_group", "part": "g_part"})
    # of two groups the smaller one asks
    asking = (F.col("members") < F.col("g_members")) | ((F.col("members") == F.col("g_members")) & (F.col("group") < F.col("g_group")))
    size = (F.col("n") * den >= F.col("g_least") * num) & (F.col("g_most") * den >= F.col("n") * num)
    serves = ((F.col("short") == 1) & (F.col("n") <= F.col("g_most"))) | ((F.col("g_short") == 1) & (F.col("n") >= F.col("g_least")))
    hits = of.join(wide, "token").filter(asking & size & (F.col("group") != F.col("g_group")))
    hits = hits.groupBy("sid", "n", "g_group", "g_part", "g_least", "g_most", "g_sets").agg(F.count("*").alias("c"), F.max(serves).alias("serves"))

    # bound: of a set's first tokens c are in the part's union; what follows them can add num / den of the larger set less
    # one at most, so c must make up the rest of the overlap that the threshold asks for, at one end of the part's sizes
    def rest(size):
        return F.col("c") * ((num + den) * den) >= num * den * (F.col("n") + size) - num * (num + den) * F.greatest(F.col("n"), size)

    low, high = F.greatest("g_least", F.ceil(F.col("n") * num / den)), F.least("g_most", F.floor(F.col("n") * den / num))
    return hits.filter(F.col("serves") & (rest(low) | rest(high))).select("sid", F.col("g_group").alias("group"), F.col("g_part").alias("part"), "g_sets")


def opened(ask: DataFrame, inside: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, group, part) of the asks that the union of the part's tokens lets through; parts of one set open at once."""
    keyed = ask.withColumn("g", F.xxhash64("group", "part"))
    several = keyed.filter("g_sets > 1")
    union = inside.join(several.select("group", "part").distinct(), ["group", "part"], "left_semi").join(sets, "sid")
    union = union.groupBy("group", "part").agg(F.array_distinct(F.flatten(F.collect_list("set"))).alias("set")).select(F.xxhash64("group", "part").alias("sid"), "set")
    both = _spread(_spread(several.select("sid", "group", "part", "g"), sets, "sid", "__a"), union, "g", "__u", several)
    reached = both.filter(F.size(F.array_intersect("__a", "__u")) * den >= F.size("__a") * num).select("sid", "group", "part")
    return reached.unionByName(keyed.filter("g_sets = 1").select("sid", "group", "part"))


_UNIT = ["group", "a", "b", "chunk"]


def units(opened_: DataFrame, inside: DataFrame) -> DataFrame:
    """(group, a, b, chunk, role, sid, weight): what is compared with what, in units of bounded size.

    b = -1: the sets of part a (role 0) with the sets of other groups that it opened for (role 1). Otherwise parts
    a >= b of one group: those of b (role 0) with those of a (role 1), or of a part among themselves.
    """
    several = inside.filter("members > 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = several.select("group", F.greatest("part", "o").alias("a"), F.least("part", "o").alias("b"), F.lit(0).alias("chunk"), (F.col("part") > F.col("o")).cast("int").alias("role"), "sid", "weight")
    chunks = opened_.groupBy("group", "part").agg(F.ceil(F.count("*") / _GROUP).cast("int").alias("chunks"))
    asked = opened_.join(chunks, ["group", "part"]).withColumn("chunk", F.pmod(F.xxhash64("sid"), "chunks").cast("int"))
    asked = asked.join(inside.select("sid", "weight"), "sid").select("group", F.col("part").alias("a"), F.lit(-1).alias("b"), "chunk", F.lit(1).alias("role"), "sid", "weight")
    held = inside.join(chunks, ["group", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select("group", F.col("part").alias("a"), F.lit(-1).alias("b"), "chunk", F.lit(0).alias("role"), "sid", "weight")
    return own.unionByName(asked).unionByName(held)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens every two sets share, by products of incidence matrices over the tokens of several sets."""
    m = len(sets)
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], np.repeat(np.arange(m), [len(s) for s in sets])[order]
    same = np.concatenate([[False], token[1:] == token[:-1]])
    several = same | np.concatenate([same[1:], [False]])
    column, owner = np.cumsum(~same[several]) - 1, owner[several]
    out = np.zeros((m, m))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + _COLUMNS))
        held = np.zeros((m, min(_COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        held[owner[a:b], column[a:b] - lo] = 1
        out += held @ held.T
    return out.astype(np.int64)


def linked_in_unit(names: np.ndarray, weights: np.ndarray, roles: np.ndarray, sets: list[np.ndarray], across: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, least set it is joined with in the unit, number of links) of the sets that have links."""
    n = np.array([len(s) for s in sets])
    link = overlaps(sets) * (num + den) >= num * (n[:, None] + n[None])
    np.fill_diagonal(link, False)
    if across:
        link &= roles[:, None] != roles[None]
    count = link @ weights
    root = names.copy()
    while True:
        low = np.where(link, root[None], root[:, None]).min(axis=1) if len(root) else root
        low = np.minimum(low, root)
        if (low == root).all():
            break
        root = low
    some = count > 0
    return names[some], root[some], count[some]


def compared(unit_rows: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, root, links): one row per set and unit in which it has links. unit_rows: those of ``units``, with set."""

    def unit(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        roles, names, weights, sets = zip(*held, strict=True)
        sid, root, links = linked_in_unit(np.array(names, np.int64), np.array(weights, np.int64), np.array(roles), list(sets), key[1] != key[2], num, den)
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(root), pa.array(links)], ["sid", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in _UNIT), strict=True)
            token, cut = batch.column("set"), None
            values, cut = token.values.to_numpy().view(np.uint64), token.offsets.to_numpy()
            for i, (key, role, sid, weight) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in ("role", "sid", "weight")), strict=True)):
                if key != now and held:
                    if len(held) > 1:
                        yield unit(now, held)
                    held = []
                now = key
                held.append((role, sid, weight, values[cut[i] : cut[i + 1]].copy()))
        if len(held) > 1:
            yield unit(now, held)

    return unit_rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(run, "sid bigint, root bigint, links bigint")


def links(profile: DataFrame, df: DataFrame, ident: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(sid, root, links): links of different sets, summed up by set and unit; edges (sid, root) join all linked sets."""
    once = keep(profile.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("weight"), F.first("mins").alias("mins"), F.first("firsts").alias("firsts")), "sets")
    shared = keep(matrix(once), "matrix")
    # a set without a shared first token has no links
    sets = keep(once.drop("firsts").join(shared.select("sid").distinct(), "sid", "left_semi"), "linkable")
    discard(once)
    member = groups(sets.select("sid", "n", "weight", "mins"))
    ask = keep(asks(shared, member, num, den), "asks")
    discard(shared)
    inside = member.filter("members > 1").unionByName(member.filter("members = 1").join(ask.select("group", "part").distinct(), ["group", "part"], "left_semi"))
    wanted = inside.select("sid").unionByName(ask.select("sid")).distinct()
    full = _fetched(df, sets.join(wanted, "sid", "left_semi"), ident, text, k)
    open_ = keep(opened(ask, inside, full, num, den), "opened")
    unit = keep(units(open_, member.join(wanted, "sid", "left_semi")), "units")
    found = keep(compared(_spread(unit, full, "sid", "set"), num, den), "links")
    discard(sets, member, ask, full, open_, unit)
    return found


def _fetched(df: DataFrame, sets: DataFrame, ident: str, text: str, k: int) -> DataFrame:
    """(sid, set) of the sets named, made anew from one text of each."""
    wanted = sets.select(F.col("doc_id").alias("__want")).distinct()
    rows = df.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chosen = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("__want")), "left_semi")
    made = _full_sets(chosen, k)
    return keep(made.join(sets.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "tokens")


def _full_sets(rows: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            found = [s for s in _sets(batch, k) if len(s)]
            values = pa.array(np.concatenate(found).view(np.int64)) if found else pa.array([], pa.int64())
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in found], pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["sid", "set"])

    return rows.select("text").mapInArrow(run, "sid bigint, set array<bigint>")


def near_duplicates(df: DataFrame, ident: str = "doc_id", text: str = "text", k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, n_links (to how many other rows) and the name of its set, sid."""
    profile = keep(profiles(df, ident, text, k, num, den), "profiles")
    rows = keep(profile.select("doc_id", "sid", "n"), "rows")
    found = links(profile, df, ident, text, k, num, den)
    discard(profile)
    roots = components(found.select(F.col("sid").alias("u"), F.col("root").alias("v")))
    full = rows.filter("n > 0")
    # names of components: the least set of each, first for the sets, then for the rows; both are named several times in what follows
    of_set = full.groupBy("sid").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_rows"))
    linked = of_set.join(found.groupBy("sid").agg(F.sum("links").alias("links")), "sid", "left")
    root = keep(linked.join(roots.select(F.col("u").alias("sid"), F.col("v").alias("root")), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "roots")
    lows = root.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n_rows"))
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    named_sets = keep(spread_join(root.withColumn("copies", F.col("n_rows")), lows, "root").select("sid", "n_rows", "component_id", n_links), "named")
    discard(root)
    answered = spread_join(full, named_sets, "sid")
    alone = rows.filter("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("bigint"))
    return answered.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "sid")


def dedupe(df: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with one row of each component: that with the least id, ties by the set's name; rows without words all stay."""
    found = near_duplicates(df, ident, text, **options).filter("n_shingles > 0")
    sid, size, want, stay, row = (fresh(df, c) for c in ("sid", "size", "want", "stay", "row"))
    # the row that stays: for a component of null ids the least set stands for the component
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("set "), F.col("sid").cast("string")))
    stays = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("s")).select(F.col("s.doc_id").alias(want), F.col("s.sid").alias(stay))
    rows = named(df, text, options.get("k", K), sid, size)
    marked = rows.join(stays, F.col(ident).cast("bigint").eqNullSafe(F.col(want)) & (F.col(sid) == F.col(stay)), "left")
    # rows equal in id and set differ in nothing that counts: one of them stays
    first = F.row_number().over(Window.partitionBy(F.coalesce(stay, F.xxhash64(*[F.col(c) for c in df.columns])), ident).orderBy(sid))
    return marked.withColumn(row, first).filter((F.col(size) == 0) | (F.col(stay).isNotNull() & (F.col(row) == 1))).select(*df.columns)
