"""Lloyd clustering in whole numbers, with vectors in Hilbert order and a zone map of their blocks.

1. A vector counts if it has exactly ``dims`` components, none null, NaN or infinite; component x becomes floor(256 * x).
2. Its key is its place on a Hilbert curve through the ``AXES`` components that vary most. Vectors are dealt to tasks by
   ranges of that key and packed into blocks of at most ``BLOCK`` vectors, cut where the curve jumps, with the least and greatest value of every
   component: a zone map. The blocks are written once and read in every round.
3. A round looks at each block's box first: a centroid whose least distance to the box exceeds the least of all greatest
   distances can be nearest to none of its vectors, nor can one that at the corner of the box best for it is farther than
   the centroid nearest to the box's middle. The vectors are compared exactly with the centroids that are left.
4. Tasks return sums and counts by cluster; only these (k * dims numbers a task) are shuffled, and k * dims reach the
   driver, which alone makes the next centroids. The number of centroids is a parameter, so their size is bounded.

Defined results: vectors that don't count have no row; so have those with a component of 2**26 or more after scaling, for
their squared distances would strain 64 bits. Repeated ids are rows of their own; a null id hashes as the text "null";
of seeds with equal hashes the one with the smaller vector is first. With fewer vectors than centroids there are as many
centroids as vectors; an empty table gives no rows. Centroids that have lost all vectors stay where they are; distance
ties go to the smaller number. Columns of other names stay out of the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintline.llm.common import discard, keep

DIMS, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
AXES, BITS, BLOCK = 8, 7, 256
_LIMIT = 1 << 26  # (2 * 2**26)**2 * 64 and four times as much, for the middle of a box, fit 64 bits
_EXACT = 1 << 22  # below it, sums of products of 64 components are exact in doubles


def whole(vector: str = "embedding", dims: int = DIMS) -> tuple[Column, Column]:
    """(components as whole numbers, whether the vector counts)."""
    scaled = F.transform(F.col(vector), lambda v: v.cast("double") * SCALE)
    fits = F.forall(scaled, lambda v: F.coalesce(F.abs(v) < _LIMIT, F.lit(False)))
    return F.transform(scaled, lambda v: F.floor(v)), F.coalesce((F.size(F.col(vector)) == dims) & fits, F.lit(False))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spread(vectors: DataFrame, dims: int) -> list[tuple[int, float, float]]:
    """(component, mean, deviation) of the components that vary most, from sums per task; dims rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dims), np.zeros(dims)
        for batch in (b for b in batches if b.num_rows):
            x = _matrix(batch.column("x")).astype(np.float64)
            n, total, square = n + len(x), total + x.sum(axis=0), square + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(total), pa.array(square)], ["dim", "n", "total", "square"])

    sums = vectors.select("x").mapInArrow(run, "dim int, n bigint, total double, square double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("square").alias("q")).collect()
    axes = [(r.dim, r.t / max(r.n, 1), max(r.q / max(r.n, 1) - (r.t / max(r.n, 1)) ** 2, 0) ** 0.5) for r in sums]
    return sorted(axes, key=lambda a: (-a[2], a[0]))[:AXES]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of whole numbers below 2**bits) on the Hilbert curve through their grid."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns and mirrors of each level, from the coarsest on
        low = (1 << b) - 1
        for i in range(n):
            mirrored = (x[i] >> b & 1).astype(bool)
            swap = np.where(mirrored, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            x[i] ^= swap
    for i in range(1, n):  # Gray code over all axes
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _cuts(x: np.ndarray) -> list[int]:
    """Where blocks of vectors in order begin, and the end: at a step of twice the usual length, and after BLOCK vectors."""
    step = (np.diff(x.astype(np.int64), axis=0) ** 2).sum(axis=1)
    jumps = np.flatnonzero(step > 4 * np.median(step)) + 1 if len(step) else []
    cuts = [0]
    for end in [*jumps, len(x)]:
        cuts += [*range(cuts[-1] + BLOCK, end, BLOCK), int(end)]
    return cuts


def blocks(vectors: DataFrame, axes: list[tuple[int, float, float]]) -> DataFrame:
    """(ids, xs, low, high): vectors in Hilbert order, in blocks with their boxes. vectors: vec_id, x."""
    dim = [a[0] for a in axes]
    mean, step = np.array([a[1] for a in axes]), np.array([max(a[2], 1e-9) * 6 / (1 << BITS) for a in axes])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            at = np.floor((_matrix(batch.column("x"))[:, dim] - mean) / step) + (1 << BITS - 1)
            key = hilbert(np.clip(at, 0, (1 << BITS) - 1), BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            x = _matrix(batch.column("x")).astype(np.int32)
            cuts = _cuts(x)
            parts = [x[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column("vec_id"))
            raw = lambda ys: pa.array([np.ascontiguousarray(y).tobytes() for y in ys], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, raw(parts), raw(p.min(axis=0) for p in parts), raw(p.max(axis=0) for p in parts)], ["ids", "xs", "low", "high"])

    places = vectors.mapInArrow(keyed, "vec_id bigint, x array<bigint>, key bigint").withColumn("row", F.monotonically_increasing_id())
    # rows of one vector, however many, are told apart by their id and number
    ordered = places.repartitionByRange("key", "vec_id", "row").sortWithinPartitions("key", "vec_id", "row")
    return ordered.select("vec_id", "x").mapInArrow(packed, "ids array<bigint>, xs binary, low binary, high binary")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The numbers of the centroids that may be nearest to a point of the box."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
    some = np.flatnonzero(least <= most.min())
    # of the rest, the one nearest to the box's middle beats those that it is nearer than at their best corner
    star = centroids[some[((low + high - 2 * centroids[some]) ** 2).sum(axis=1).argmin()]]
    corner = np.where(centroids[some] > star, high, low)
    return some[((corner - centroids[some]) ** 2).sum(axis=1) <= ((corner - star) ** 2).sum(axis=1)]


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each vector of a block, and how many centroids were compared."""
    some = candidates(low, high, centroids)
    if len(some) == 1:
        return np.full(len(x), some[0]), ((x - centroids[some[0]]) ** 2).sum(axis=1), 1
    c = centroids[some]
    if max(-low.min(), high.max(), np.abs(c).max()) < _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]
    else:
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    best = d.argmin(axis=1)
    return some[best], d[np.arange(len(x)), best].astype(np.int64), len(some)


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for i, (xs, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("xs", "low", "high")), strict=True)):
        x = np.frombuffer(xs, np.int32).reshape(-1, dims).astype(np.int64)
        yield i, x, np.frombuffer(low, np.int32).astype(np.int64), np.frombuffer(high, np.int32).astype(np.int64)


def moved(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, x, low, high in _opened(batch, dims):
                of, _, _ = nearest(x, low, high, centroids)
                n += np.bincount(of, minlength=k)
                for c in np.unique(of):
                    total[c] += x[of == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, dims)), pa.array(np.tile(np.arange(dims), len(some))), pa.array(np.repeat(n[some], dims)), pa.array(total[some].reshape(-1))], ["cluster", "dim", "n", "total"]
        )

    sums = zones.drop("ids").mapInArrow(run, "cluster bigint, dim bigint, n bigint, total bigint")
    # more than a task's 64 bits when all tasks are added up
    rows = sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    after = centroids.copy()
    for r in rows:
        after[r.cluster, r.dim] = int(r.total) // r.n
    return after


def assigned(zones: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, compared): compared is the number of centroids that the vector's block left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for i, x, low, high in _opened(batch, centroids.shape[1]):
                of, distance, compared = nearest(x, low, high, centroids)
                yield pa.RecordBatch.from_arrays([ids[i].values, pa.array(of.astype(np.int32)), pa.array(distance), pa.array(np.full(len(x), compared, np.int32))], ["vec_id", "cluster", "distance", "compared"])

    return zones.mapInArrow(run, "vec_id bigint, cluster int, distance bigint, compared int")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """One row per vector that counts: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared."""
    spark = df.sparkSession
    x, counts = whole(vector, dims)
    vectors = df.filter(counts).select(F.col(ident).cast("bigint").alias("vec_id"), x.alias("x"))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = vectors.orderBy(F.sha2(text, 256), "x").limit(k).collect()
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, compared int"
    if not first:
        return spark.createDataFrame([], out)
    centroids = np.array([r.x for r in first], np.int64)
    zones = keep(blocks(vectors, spread(vectors, dims)), "zones")
    for _ in range(rounds):
        centroids = moved(zones, centroids)
    last = keep(assigned(zones, centroids), "assigned")
    discard(zones)
    sums = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # at most k rows
    inertia = sum(int(r.d) for r in sums)
    known = [(r.cluster, int(r.d), inertia, digest(centroids[r.cluster])) for r in sums]
    of = spark.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return last.join(F.broadcast(of), "cluster").select(*[c.split()[0] for c in out.split(", ")])


def _sql() -> str:
    """The same by a plain scan of all centroids, its rounds written one after the other."""
    near = "(SELECT vec_id, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, n, x, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, {of}) GROUP BY n, vec_id, x)"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {DIMS} AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v))))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT x, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h, x LIMIT {K}))",
    ]
    for i in range(ROUNDS):
        sums = f"SELECT c, d, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS v, unnest(range({DIMS})) AS d FROM {near.format(of=f'c{i}')}) GROUP BY 1, 2"
        means = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS m FROM ({sums}) GROUP BY 1"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(a.m, c{i}.m) AS m FROM c{i} LEFT JOIN ({means}) a USING (c))")
    parts.append(f"last AS MATERIALIZED {near.format(of=f'c{ROUNDS}')}")
    total = "CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia"
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, {total}, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM last JOIN c{ROUNDS} USING (c)"


ORACLE_SQL = _sql()
