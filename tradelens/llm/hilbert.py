"""Centroid clustering over zone maps: exact Lloyd rounds on integer vectors.

Vectors are laid out once along a Hilbert curve and cut into blocks, each with the least and largest value of
every component (its box). In a round a block asks its box first: no vector of it is nearer to a centroid than
the box is, and none is further from it than the box's furthest corner. Centroids whose least distance exceeds
the smallest furthest one cannot win; the others are compared with every vector, exactly.

Copies of one vector share their place on the curve; the id's hash goes on with the order there, so range
partitioning can divide them. Rounds return sums and counts of at most one row for each task and centroid.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part,
nor do those with a component that exceeds ``MOST`` after scaling (squared distances would exceed a long);
every row is a vector of its own, so repeated rows count repeatedly, and of vectors with one id the smaller is
the earlier centroid; a row without an id becomes a centroid only after all others; fewer vectors than
centroids leave fewer centroids; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import stored

#: Largest scaled component: (2 * 2**27)**2 * 64 still fits a long.
MOST = 2**27
#: Rows of a block, and bits of the curve for each component.
BLOCK, BITS = 128, 4
#: Below this, products of 64 components are exact in double precision, in whatever order they are summed.
EXACT = 2**22
BLOCKS = "ids array<bigint>, lo array<bigint>, hi array<bigint>, vectors binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of each row of ``cells`` (components of ``bits`` bits) on the Hilbert curve through their cube.

    Skilling's transform: undo the excess work from the highest bit down, Gray-decode, and interleave the bits.
    """
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.uint32(1 << level)
        p = q - np.uint32(1)
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(up, p, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    planes = np.concatenate([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(planes.T.astype(np.uint8), axis=1)]


def integers(embeddings: DataFrame, dims: int, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v): scaled components rounded down, of the vectors that take part."""
    v = F.col(column)
    most = float(MOST) / scale
    fit = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < most))
    return embeddings.where(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


def blocks(vectors: DataFrame, dims: int, rows: int = BLOCK, bits: int = BITS) -> DataFrame:
    """Vectors in the order of the curve, ``rows`` to a block, with each block's box; stored."""
    span = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    lo, hi = (0, 0) if span[0] is None else span
    width = (hi - lo) // 2**bits + 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = hilbert_keys((_matrix(b.column("v"), dims) - lo) // width, bits)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(keys, pa.binary())], ["vec_id", "v", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b.select(["vec_id", "v"])])
            rest = t if rest is None else pa.concat_tables([rest, t])
            whole = rest.num_rows // rows * rows
            if whole:
                yield boxed(rest.slice(0, whole))
                rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield boxed(rest)

    def boxed(t: pa.Table) -> pa.RecordBatch:
        m = _matrix(t.column("v").combine_chunks(), dims)
        ids = t.column("vec_id").combine_chunks()
        at = [*range(0, len(m), rows), len(m)]
        parts = [m[a:b] for a, b in zip(at, at[1:])]
        lists = [pa.array([f(p, axis=0).tolist() for p in parts], pa.list_(pa.int64())) for f in (np.min, np.max)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids), *lists, pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary())], ["ids", "lo", "hi", "vectors"])

    placed = vectors.mapInArrow(keyed, "vec_id bigint, v array<bigint>, place binary")
    order = ["place", F.xxhash64("vec_id", "v")]
    return stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, BLOCKS), "blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Blocks x centroids: which centroids can be the nearest of some vector in the block's box."""
    out = np.empty((len(lo), len(centroids)), bool)
    for i, (a, b) in enumerate(zip(lo, hi)):
        below, above = a - centroids, centroids - b
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(below), np.abs(above))
        out[i] = (near * near).sum(1) <= (far * far).sum(1).min()
    return out


def nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the first of equals) and the squared distance, both exact."""
    if max(np.abs(m).max(), np.abs(centroids).max()) <= EXACT:
        x, c = m.astype(np.float64), centroids.astype(np.float64)
        d = ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        d = np.stack([((m - c) ** 2).sum(1) for c in centroids], axis=1)
    best = d.argmin(1)
    return best, d[np.arange(len(m)), best]


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    dims = centroids.shape[1]
    may = candidates(_matrix(batch.column("lo"), dims), _matrix(batch.column("hi"), dims), centroids)
    ids, vectors = batch.column("ids"), batch.column("vectors")
    for i in range(batch.num_rows):
        m = np.frombuffer(vectors[i].as_buffer(), "<i4").reshape(-1, dims).astype(np.int64)
        own = np.flatnonzero(may[i])
        best, distance = nearest(m, centroids[own])
        yield ids[i].values, m, own[best], distance


def sums(placed: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that has vectors: their number, and their components' sums."""
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for _, m, best, _ in _assigned(b, centroids):
                order = np.argsort(best, kind="stable")
                own, first = np.unique(best[order], return_index=True)
                total[own] += np.add.reduceat(m[order], first, axis=0)
                n += np.bincount(best, minlength=k)
        own = np.flatnonzero(n)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = placed.mapInArrow(partial, "cluster int, n bigint, total array<bigint>")
    per = parts.select("cluster", "n", F.posexplode("total").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(per.collect()):  # at most centroids x components
        found.setdefault(r.cluster, (r.n, []))[1].append(r.x)
    return found


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.v for r in vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()]


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> DataFrame:
    """Per vector: cluster, squared distance, inertia of its cluster and of all, digest of its final centroid."""
    vectors = integers(embeddings, dims, scale)
    start = first_centroids(vectors, k, seed)
    spark = embeddings.sparkSession
    shape = "vec_id bigint, cluster int, distance bigint"
    if not start:
        return spark.createDataFrame([], f"{shape}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    placed = blocks(vectors, dims)
    centroids = np.array(start, np.int64)
    for _ in range(rounds):
        for c, (n, total) in sums(placed, centroids).items():
            centroids[c] = [x // n for x in total]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, _, best, distance in _assigned(b, centroids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    rows = stored(placed.mapInArrow(assigned, shape), "assigned")
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(inertia.values())
    told = [(c, s, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(inertia.items())]
    final = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(final), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a centroid


def oracle_sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """DuckDB SQL of ``cluster`` for tables of distinct ids."""
    sql = f"""WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v AS m FROM v QUALIFY c < {k})"""
    near = "SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{r}"
    for r in range(rounds + 1):
        sql += f",\na{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(c, d * {k} + c) AS c, CAST(min(d) AS BIGINT) AS d FROM ({near.format(r=r)}) GROUP BY vec_id)"
        if r < rounds:
            sql += f""",
s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(u.m, o.m) AS m FROM c{r} o
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{r} GROUP BY c) u ON u.c = o.c
)"""
    return sql + f"""
SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""
