"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of distinct vectors (``Settings.sample``), and every vector is indexed:
it goes down the tree to the leaf of the nearest centre at each level. A query keeps the branches it has not
taken in a priority queue and opens the nearest one next, until it has visited ``visits`` leaves. How many that
is, calibration says: for a bounded number of queries the true neighbours are found by comparing all rows, and
leaf visits widen until the wanted share of them lies in visited leaves.

Copies of one vector are one entry with its smallest ids: as many as a result can hold. Leaves are grouped
into shards of bounded size, a leaf larger than a shard is dealt over several, and queries meet shards in
blocks of bounded size, so no task holds more than one shard and one block of queries.

Defined results: vectors that are null or empty, hold null or non-finite components, or whose squared length
is 0 or not finite in double precision take no part, nor do rows without an id; only vectors of equal length
have a cosine, so each length is searched by itself (lengths that the sample lacks form one leaf, which is
always visited); of rows with one id the one with the smallest vector counts, so repeated rows count once;
equal cosines go by the smaller id; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.llm.common import stored


@dataclass(frozen=True)
class Settings:
    """The bounds of the index; all but ``sample`` and ``calibration`` only divide the work."""

    sample: int = 32_768  # distinct vectors that the tree is fitted on
    branches: int = 16
    leaf: int = 64  # sampled vectors of a leaf
    steps: int = 8  # Lloyd steps of each split
    calibration: int = 400  # queries whose true neighbours set the number of visits
    recall: float = 0.97  # share of true neighbours that calibration asks for
    shard: int = 65_536  # most entries of a shard
    queries: int = 4_096  # about as many queries in a block


class KMeansTree:
    """Centres of the nodes, the children of each, and a number for each leaf."""

    def __init__(self, points: np.ndarray, settings: Settings) -> None:
        self.centres, self.children, self.leaves = [points.mean(0)], [None], 0
        self.leaf_of: list[int] = [-1]
        rng, open_nodes = np.random.default_rng(7), [(0, points)]
        while open_nodes:
            node, own = open_nodes.pop()
            parts = split(own, settings, rng) if len(own) > settings.leaf else []
            if len(parts) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            first = len(self.centres)
            self.children[node] = range(first, first + len(parts))
            for p in parts:
                self.centres.append(p.mean(0))
                self.children.append(None)
                self.leaf_of.append(-1)
            open_nodes += list(zip(self.children[node], parts))
        self.centres = np.array(self.centres)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root down, the nearest child."""
        out = np.empty(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                out[rows] = self.leaf_of[node]
                continue
            best = distances(x[rows], self.centres[self.children[node]]).argmin(1)
            todo += [(c, rows[best == i]) for i, c in enumerate(self.children[node]) if (best == i).any()]
        return out

    def visited(self, x: np.ndarray, visits: int) -> list[list[int]]:
        """For each row the first ``visits`` leaves, best bin first."""
        out = []
        for far in distances(x, self.centres):
            queue, found = [(0.0, 0)], []
            while queue and len(found) < visits:
                _, node = heapq.heappop(queue)
                if self.children[node] is None:
                    found.append(self.leaf_of[node])
                else:
                    for c in self.children[node]:
                        heapq.heappush(queue, (far[c], c))
            out.append(found)
        return out


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the row's own square."""
    return (centres * centres).sum(1) - 2 * (x @ centres.T)


def split(points: np.ndarray, settings: Settings, rng: np.random.Generator) -> list[np.ndarray]:
    """k-means parts of the points, without empty ones."""
    k = min(settings.branches, math.ceil(len(points) / settings.leaf))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(settings.steps):
        own = distances(points, centres).argmin(1)
        filled = [c for c in range(len(centres)) if (own == c).any()]
        centres = np.array([points[own == c].mean(0) for c in filled])
    own = distances(points, centres).argmin(1)
    return [points[own == c] for c in range(len(centres)) if (own == c).any()]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def entries(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the vectors that take part, one for each id."""
    kind = embeddings.schema[column].dataType
    v = F.col(column) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col(column).cast("array<double>")
    rows = embeddings.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    known = F.coalesce((square > 0) & (square < float("inf")), F.lit(False))  # a null component makes the sum null, and NaN exceeds infinity
    return rows.where(known).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(vec, ids): each vector once, with the ``ids`` smallest ids that have it. Ranks are cut before the shuffle."""
    near = rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("_n") <= ids)
    return near.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: it, the rows that have it, and their vectors in double precision."""
    flat = np.asarray(column.flatten(), np.float64)
    size = np.diff(np.asarray(column.offsets, np.int64))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield d, rows, flat[start[rows][:, None] + np.arange(d)]


def bounded_share(df: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """All rows, or about ``most`` of ``n``, chosen by the hash of their key."""
    return df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(2**30)) < int(2**30 * most / n))


class Index:
    """Every vector in the leaf of its length's tree; leaves of all trees are numbered together."""

    def __init__(self, rows: DataFrame, ids: int, settings: Settings) -> None:
        spark, self.settings = rows.sparkSession, settings
        held = stored(distinct_vectors(rows, ids), "vectors")
        self.n = held.count()
        sampled = bounded_share(held, F.col("ids")[0], self.n, settings.sample).select("vec").toArrow().column("vec").combine_chunks()
        self.trees, self.first, next_leaf = {}, {}, 0
        for d, _, x in matrices(sampled):
            x = unit(x)
            self.trees[d] = KMeansTree(x[np.lexsort(x.T)], settings)
            self.first[d] = next_leaf
            next_leaf += self.trees[d].leaves
        trees, first = self.trees, self.first

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = np.empty(b.num_rows, np.int32)
                for d, own, x in matrices(b.column("vec")):
                    leaf[own] = trees[d].assign(unit(x)) + first[d] if d in trees else -d
                yield pa.RecordBatch.from_arrays([b.column("vec"), b.column("ids"), pa.array(leaf)], ["vec", "ids", "leaf"])

        shape = T.StructType([*held.schema.fields, T.StructField("leaf", T.IntegerType())])
        self.table = stored(held.mapInArrow(placed, shape), "indexed")
        # at most a row for each leaf, and the sample bounds the leaves
        counts = sorted((r.leaf, r["count"]) for r in self.table.groupBy("leaf").count().collect())
        room = min(settings.shard, max(2_048, self.n // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
        self.shards: dict[int, range] = {}
        shard, filled = 0, 0
        for leaf, n in counts:
            if filled and filled + n > room:
                shard, filled = shard + 1, 0
            parts = math.ceil(n / room)
            self.shards[leaf] = range(shard, shard + parts)
            shard, filled = (shard, filled + n) if parts == 1 else (shard + parts, 0)

    def calibrated(self, queries: DataFrame, k: int) -> dict[int, int]:
        """For each length the fewest leaf visits at which the wanted share of true neighbours is found.

        Comparing some hundred queries with all rows is one pass, of which each task keeps k rows a query.
        """
        n = queries.count()
        chosen = bounded_share(queries, F.col("vec_id"), n, self.settings.calibration).toArrow()
        if not chosen.num_rows:
            return {}
        asked, ids = chosen.column("vec").combine_chunks(), np.asarray(chosen.column("vec_id"))
        by_size = {d: (ids[own], x) for d, own, x in matrices(asked)}

        def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list] = {}
            for b in batches:
                leaf = np.asarray(b.column("leaf"))
                for d, own, x in matrices(b.column("vec")):
                    if d in by_size:
                        q, rows, at, score = best_of(by_size[d][0], by_size[d][1], x, b.column("ids").take(pa.array(own)), k)
                        new = (by_size[d][0][q], leaf[own][rows], at, score)
                        old = best.get(d)
                        both = new if old is None else tuple(np.concatenate(p) for p in zip(old, new))
                        keep = first_k(both[0], both[2], both[3], k)
                        best[d] = tuple(p[keep] for p in both)
            for q, leaf, at, score in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(leaf), pa.array(at), pa.array(score)], ["query_id", "leaf", "vec_id", "score"])

        near = nearest_rows(self.table.mapInArrow(truth, "query_id bigint, leaf int, vec_id bigint, score double"), k)
        wanted = {}
        for r in near.select("query_id", "leaf").collect():  # at most k rows a query of the calibration
            wanted.setdefault(r.query_id, []).append(r.leaf)
        visits = {}
        for d, (own, x) in by_size.items():
            if d in self.trees:
                order = self.trees[d].visited(unit(x), self.trees[d].leaves)
                place = sorted(o.index(leaf - self.first[d]) + 1 for q, o in zip(own.tolist(), order) for leaf in wanted.get(q, ()))
                visits[d] = place[math.ceil(self.settings.recall * len(place)) - 1] if place else self.trees[d].leaves
        return visits

    def search(self, queries: DataFrame, k: int, visits: dict[int, int]) -> DataFrame:
        """(query_id, vec_id, score): the k nearest in the visited leaves."""
        spark, trees, first, shards = queries.sparkSession, self.trees, self.first, self.shards
        blocks = max(1, math.ceil(queries.count() / self.settings.queries))

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, at, leaves = [], [], []
                for d, own, x in matrices(b.column("vec")):
                    if d in trees:
                        found = [[leaf + first[d] for leaf in o] for o in trees[d].visited(unit(x), visits.get(d, trees[d].leaves))]
                    else:
                        found = [[-d]] * len(own)
                    for row, opened in zip(own.tolist(), found):
                        by: dict[int, list[int]] = {}
                        for leaf in opened:
                            for s in shards.get(leaf, ()):
                                by.setdefault(s, []).append(leaf)
                        rows += [row] * len(by)
                        at += by
                        leaves += by.values()
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("vec").take(take), pa.array(at, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["vec_id", "vec", "shard", "leaves"])

        shape = T.StructType([*queries.select("vec_id", "vec").schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("leaves", T.ArrayType(T.IntegerType()))])
        asked = queries.select("vec_id", "vec").mapInArrow(routed, shape).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

        plan = spark.createDataFrame([(leaf, s.start, len(s)) for leaf, s in shards.items()], "leaf int, start int, parts int")
        dealt = self.table.join(F.broadcast(plan), "leaf")  # a row for each leaf: the sample bounds them
        dealt = dealt.select("vec", "ids", "leaf", (F.col("start") + F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts"))).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

        def compared(index: pa.Table, asked: pa.Table) -> pa.Table:
            found = []
            if index.num_rows and asked.num_rows:
                vectors, ids, leaf = index.column("vec").combine_chunks(), index.column("ids").combine_chunks(), np.asarray(index.column("leaf"))
                opened, query_ids = asked.column("leaves").combine_chunks(), np.asarray(asked.column("vec_id"))
                pairs = np.asarray(opened.flatten()), np.repeat(np.arange(asked.num_rows), np.diff(np.asarray(opened.offsets)))
                mine = {d: (own, x) for d, own, x in matrices(vectors)}
                for d, own, q in matrices(asked.column("vec").combine_chunks()):
                    if d in mine:
                        rows, x = mine[d]
                        place = np.full(asked.num_rows, -1)
                        place[own] = np.arange(len(own))
                        use = place[pairs[1]] >= 0
                        by = place[pairs[1][use]], pairs[0][use]
                        i, _, at, score = best_of(query_ids[own], q, x, ids.take(pa.array(rows)), k, leaf[rows], by)
                        found.append((query_ids[own][i], at, score))
            q, at, score = (np.concatenate(p) for p in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(at, pa.int64()), "score": pa.array(score, pa.float64())})

        key = ["shard", "block"]
        met = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(compared, "query_id bigint, vec_id bigint, score double")
        return nearest_rows(met, k)


#: Matrix products differ in the last bits with the place of a row; what is this near to the k-th is compared exactly.
SLACK = 1e-9
CELLS = 4_000_000


def best_of(query_ids: np.ndarray, queries: np.ndarray, x: np.ndarray, ids: pa.Array, k: int, leaf: np.ndarray | None = None, opened: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """The k best ids of each query among the rows of ``x``: (query's place, row, id, cosine).

    ``opened``: (query's place, leaf) pairs; only those leaves' rows are compared. Products of unit vectors
    choose, and the cosine of what they choose is computed from the given vectors, row by row.
    """
    uq, ux = unit(queries), unit(x)
    best = np.full((len(queries), k + 1), -np.inf)  # one entry may be the query's own
    chosen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if leaf is None:
        groups = [(np.arange(len(x)), np.arange(len(queries)))]
    else:
        rows_of = np.argsort(leaf, kind="stable")
        bounds = {int(v): (a, b) for v, a, b in zip(*_runs(leaf[rows_of]))}
        order = np.argsort(opened[1], kind="stable")
        groups = [(rows_of[bounds[int(v)][0] : bounds[int(v)][1]], opened[0][order][a:b]) for v, a, b in zip(*_runs(opened[1][order])) if int(v) in bounds]
    for rows, qs in groups:
        for a in range(0, len(qs), max(1, CELLS // len(rows))):
            q = qs[a : a + max(1, CELLS // len(rows))]
            s = uq[q] @ ux[rows].T
            i, j = np.nonzero(s >= best[q].min(1)[:, None] - SLACK)
            best[q] = np.partition(np.concatenate([best[q], s], axis=1), -(k + 1), axis=1)[:, -(k + 1) :]
            keep = s[i, j] >= best[q].min(1)[i] - SLACK
            chosen.append((q[i[keep]], rows[j[keep]], s[i, j][keep]))
    if not chosen:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0)
    q, rows, s = (np.concatenate(p) for p in zip(*chosen))
    keep = s >= best[q].min(1) - SLACK
    q, rows = q[keep], rows[keep]
    nq, nx = np.sqrt((queries * queries).sum(1)), np.sqrt((x * x).sum(1))
    step = max(1, CELLS // queries.shape[1])
    score = np.concatenate([np.empty(0), *[(queries[q[a : a + step]] * x[rows[a : a + step]]).sum(1) / (nq[q[a : a + step]] * nx[rows[a : a + step]]) for a in range(0, len(q), step)]])
    offsets, flat = np.asarray(ids.offsets, np.int64), np.asarray(ids.flatten(), np.int64)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)[rows]
    at = np.repeat(offsets[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    q, rows, score, found = np.repeat(q, size), np.repeat(rows, size), np.repeat(score, size), flat[at]
    other = np.flatnonzero(found != query_ids[q])
    keep = other[first_k(q[other], found[other], score[other], k)]
    return q[keep], rows[keep], found[keep], score[keep]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted values' distinct ones, and where each begins and ends."""
    own, start = np.unique(values, return_index=True)
    return own, start, np.append(start[1:], len(values))


def first_k(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best, by score and then id."""
    order = np.lexsort((ids, -score, q))
    sorted_q = q[order]
    start = np.searchsorted(sorted_q, sorted_q)
    return order[np.arange(len(q)) - start < k]


def nearest_rows(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """Per row for which ``is_query`` holds: its k nearest other rows by cosine, as (query_id, rank, vec_id, score)."""
    rows = stored(entries(embeddings), "entries")
    index = Index(rows, k + 1, settings)
    queries = rows.where(is_query)
    visits = index.calibrated(queries, k)
    return index.search(queries, k, visits).select("query_id", "rank", "vec_id", "score")
