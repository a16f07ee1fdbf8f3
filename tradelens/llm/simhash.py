"""SimHash near-duplicate classes by multi-index hashing.

Distinct fingerprints are cut into segments. By the pigeonhole principle two fingerprints within the
radius have a segment within ``radius // segments`` bits. The Hamming balls of half that distance
around both segments meet, so each fingerprint is filed under every value in its own small ball and
fetches whoever is filed under the same value; the complete distance is then verified.

Copies never meet here: they are one fingerprint. A crowded value (a large group of near copies) is
verified in blocks of bounded size, block pairs being dealt over the cluster, and only the edges of
a spanning forest leave a task, never all pairs. Components are found by alternating star
contractions over these edges, with checkpoints in the shared folder.

Nulls: a null text has no words and the fingerprint zero, as a blank text has, and is linked like
any other. A row without an id keeps its fingerprint and takes the least id of its component (null
if there is none). Repeated rows are returned once each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import saved, stored

#: Fingerprints that are compared all at once within a task; more are dealt out as pairs of blocks.
BLOCK = 4096


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash over word shingles (XXH64, seed 42), as a signed integer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - shingle + 1)].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist() or [len(line)]
    hashes = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp (signed long) of every row, from the whole text, and a struct of the columns in ``carry``."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.struct(F.lit(0).alias("_"), *carry).alias("row"))

    def work(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            fps = [fingerprint_of(t.as_py(), shingle) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64()), part.column(2)], ["doc_id", "fp", "row"])

    return given.mapInArrow(work, f"doc_id long, fp long, row {given.schema['row'].dataType.simpleString()}")


def ball_radius(radius: int, segments: int) -> int:
    """Half of the distance that some segment is within, rounded up."""
    return (radius // segments + 1) // 2


def filed(distinct: DataFrame, radius: int, segments: int) -> DataFrame:
    """A row (key, fp) for each value in the ball around each segment of each fingerprint."""
    reach = ball_radius(radius, segments)
    edges = [64 * i // segments for i in range(segments + 1)]

    def work(parts: Iterator) -> Iterator:
        import itertools

        import numpy as np
        import pyarrow as pa

        for part in parts:
            fps = part.column(0).to_numpy().astype(np.int64)
            for lo in range(0, len(fps), 20_000):
                some = fps[lo : lo + 20_000]
                keys = []
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    value = (some.view(np.uint64) >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
                    flips = [sum(1 << i for i in c) for n in range(reach + 1) for c in itertools.combinations(range(b - a), n)]
                    tag = np.uint64(k) << np.uint64(b - a)  # the key is at most 2 bits longer than its segment
                    keys += [(value ^ np.uint64(f)) | tag for f in flips]
                key = np.concatenate(keys).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(some, len(keys)))], ["key", "fp"])

    return distinct.mapInArrow(work, "key long, fp long")


def _forest(left, right, radius: int):
    """Edges of a spanning forest of the links between two arrays of fingerprints (or within one)."""
    import numpy as np

    whole = left if right is left else np.concatenate((left, right))
    root = np.arange(len(whole))
    out, shift = [], 0 if right is left else len(left)
    for i in range(len(left)):
        j0 = i + 1 if right is left else 0
        near = np.flatnonzero(np.bitwise_count(left[i] ^ right[j0:]) <= radius) + j0 + shift
        for j in near[root[near] != root[i]].tolist():
            if root[j] != root[i]:
                out.append((whole[i], whole[j]))
                root[root == root[j]] = root[i]
    return out


def links(distinct: DataFrame, radius: int = 4, segments: int = 2) -> DataFrame:
    """Edges (a, b) between fingerprints within ``radius`` bits that connect all that are linked.

    ``distinct`` has one column of distinct fingerprints and must be stored: it is read twice.
    """
    if segments > 4:
        raise ValueError("at most four segments")

    def meet(parts: Iterator) -> Iterator:
        """Rows come sorted by key. A crowded key's members go on as rows of kind 1, with their block."""
        import numpy as np
        import pyarrow as pa

        def sent(kind, a, b, block=None):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.zeros(n, np.int32) if block is None else np.asarray(block, np.int32))], ["kind", "a", "b", "block"])

        def solve(members):
            found = _forest(members, members, radius)
            return [sent(0, *zip(*found))] if found else []

        open_key, held, passed = None, [], 0  # passed: members of the open key that have gone on already

        def close():
            nonlocal held, passed
            out = []
            if held:
                members = np.concatenate(held)
                if passed:
                    out.append(sent(1, np.full(len(members), open_key), members, (passed + np.arange(len(members))) // BLOCK))
                elif len(members) > 1:
                    out += solve(members)
            held, passed = [], 0
            return out

        for part in parts:
            keys, fps = part.column(0).to_numpy(), part.column(1).to_numpy()
            if not len(keys):
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            sizes = np.diff(cuts)
            inner = np.flatnonzero(sizes > 1)  # keys with one member matter only at the batch's ends
            for g in sorted({0, len(sizes) - 1, *inner.tolist()}):
                a, b = cuts[g], cuts[g + 1]
                if keys[a] != open_key:
                    yield from close()
                    open_key = keys[a]
                held.append(fps[a:b])
                if sum(map(len, held)) > BLOCK:
                    members = np.concatenate(held)
                    yield sent(1, np.full(len(members), open_key), members, (passed + np.arange(len(members))) // BLOCK)
                    held, passed = [], passed + len(members)
        yield from close()

    near = filed(distinct, radius, segments).repartition("key").sortWithinPartitions("key").mapInArrow(meet, "kind int, a long, b long, block int")
    near = stored(near, "near")
    crowded = near.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")
    last = crowded.groupBy("key").agg(F.max("block").alias("last"))
    pairs = crowded.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    pairs = pairs.select("key", "fp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def blocks(key, table):
        import numpy as np
        import pyarrow as pa

        fps, block = table.column("fp").to_numpy(), table.column("block").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        left = fps[block == i]
        found = _forest(left, left if i == j else fps[block == j], radius)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(np.asarray(a, np.int64)), "b": pa.array(np.asarray(b, np.int64))})

    more = pairs.groupBy("key", "i", "j").applyInArrow(blocks, "a long, b long")
    both = near.where("kind = 0").select("a", "b").unionByName(more)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge touches; root is the least node reachable.

    Alternating large-star and small-star steps; each is one aggregation and one join, and the
    result of each round is checkpointed.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct())
    for _ in range(most_rounds):
        both = now.union(now.select("root", "node")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("node"), F.col("m").alias("root"))
        down = large.distinct()
        least = down.groupBy("node").agg(F.min("root").alias("m"))
        small = down.join(least, "node")
        small = small.select(F.explode(F.array(F.struct("node", F.col("m").alias("root")), F.struct(F.col("root").alias("node"), F.col("m").alias("root")))).alias("x"))
        new = saved(small.select("x.*").where("node <> root").distinct())
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            return new
        now = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def classes(docs: DataFrame, shingle: int = 4, radius: int = 4, segments: int = 2) -> DataFrame:
    """doc_id, fp, root (least fingerprint reachable) and component_id (least doc_id reachable) of every row."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    firsts = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(firsts.select("fp"), radius, segments))
    grouped = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stored(grouped.join(least, "root").select("fp", "root", "component_id"), "classes")
    return marked.join(known, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, segments: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable) of every row."""
    found = classes(docs, shingle, radius, segments)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
