"""Token ids in Re-Pair compressed shards, with random access.

Documents are range-partitioned by doc_id and sorted, each task cuts its ids into shards of about
``shard_tokens`` ids, and each shard is compressed by itself: pairs of neighbouring symbols are
replaced by nonterminals, the most frequent of overlapping pairs first, until none occurs
``min_count`` times. Counts are taken anew after each pass over the shard, not after each rule. Shards
are written as rows of a table in the shared folder, so Spark's commit protocol makes a lost executor
harmless.

A shard is a byte string::

    b"RPR1", u32 first nonterminal, u32 rules, u64 documents, u64 symbols,
    rules x (u32 left, u32 right, u32 expansion length),
    documents x u32 ids, documents x u32 symbols, symbols x u32

A pair never spans two documents, so a document is a run of symbols: its place is a prefix sum, and
within it the expansion lengths give the symbol that holds any id.

Nulls: a null text is an empty one and has only its end id; a null doc_id comes first. Rows with the
same doc_id stand side by side in the order of the input, and may be in several shards. A very long
text is one document of one shard. An empty table gives no shards. Further columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.llm.common import WORD_BPE, scratch

MAGIC = b"RPR1"
HEAD = "<4sIIQQ"
#: The first number that no token id has.
FIRST_NONTERMINAL = 1 << 18
#: Bytes of text that are encoded at once.
BATCH_BYTES = 3_000_000


def _numbered(pair):
    """A number for each pair, alike for equal pairs only; and the pairs of the numbers, in two arrays that follow one another."""
    import numpy as np

    bits = max(10, min(22, len(pair).bit_length()))
    table = np.zeros(2 << bits, np.int64)
    number, todo, own = None, None, pair
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):  # a cell of the table stands for the pair that holds it
        cell = own.view(np.uint64) * np.uint64(factor)
        cell >>= np.uint64(64 - bits)
        cell = cell.view(np.int64)
        holder = table[k << bits : (k + 1) << bits]
        holder[cell] = own
        others = holder[cell] != own
        if number is None:
            number, todo = cell.astype(np.int32), np.flatnonzero(others)  # those of others are set below
        else:
            number[todo] = cell + (k << bits)
            todo = todo[others]
        del cell
        own = pair[todo]
    rest, of = np.unique(own, return_inverse=True)
    number[todo] = of + len(table)
    return number, table, rest


def _often(pair, min_count: int):
    """Which pairs occur ``min_count`` times, and for these the rank of their pair: 0 for the most frequent."""
    import numpy as np

    number, table, rest = _numbered(pair)
    count = np.bincount(number, minlength=len(table) + len(rest))
    found = np.flatnonzero(count >= min_count)
    split = np.searchsorted(found, len(table))
    pair_of = np.concatenate((table[found[:split]], rest[found[split:] - len(table)]))
    del table, rest
    rank = np.full(len(count), -1, np.int32)
    rank[found[np.lexsort((pair_of, -count[found]))]] = np.arange(len(found))
    del count
    rank = rank[number]
    at = np.flatnonzero(rank >= 0)
    return at, rank[at]


def compress(ids, doc_ends, min_count: int = 16):
    """Symbols, left and right sides, expansion lengths, and the documents' lengths in symbols.

    ``doc_ends``: for each document the place after its last id.
    """
    import numpy as np

    if min_count < 2:
        raise ValueError("a pair is replaced if it occurs twice or more")
    seq = np.array(ids, np.int64)
    last = np.zeros(len(seq), bool)
    last[np.asarray(doc_ends, np.int64) - 1] = True
    left, right, length = [], [], np.ones(FIRST_NONTERMINAL, np.int64)
    made = FIRST_NONTERMINAL
    # places at which a pair begins that may be frequent: pairs of old symbols never become more
    place = np.flatnonzero(~last)
    while len(place):
        pair = seq[place]
        pair <<= 32
        pair |= seq[place + 1]
        at, rank = _often(pair, min_count)
        place, pair = place[at], pair[at]
        if not len(place):
            break
        # a run of one symbol: from its start, every other pair
        same = np.concatenate(([False], (np.diff(place) == 1) & (np.diff(pair) == 0)))
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(place))))
        free = np.flatnonzero((np.arange(len(place)) - begin) % 2 == 0)
        # of pairs that overlap, the more frequent one
        p, r = place[free], rank[free]
        over = np.diff(p) == 1
        wins = np.ones(len(p), bool)
        wins[1:] &= ~over | (r[1:] < r[:-1])
        wins[:-1] &= ~over | (r[:-1] < r[1:])
        taken, r = p[wins], r[wins]
        many = np.bincount(r, minlength=rank.max() + 1) >= 2  # the most frequent pair always is
        many[rank.min()] = True
        taken, r = taken[many[r]], r[many[r]]
        _, first, rule = np.unique(r, return_index=True, return_inverse=True)
        left.append(seq[taken[first]])
        right.append(seq[taken[first] + 1])
        length = np.concatenate((length, length[left[-1]] + length[right[-1]]))
        seq[taken] = made + rule
        made += len(first)
        last[taken] = last[taken + 1]
        gone = taken + 1
        new = taken - np.arange(len(taken))  # so many were taken, and so removed, before it
        # where a pair to count begins after the change: the old places that are left, and both sides of what is new
        if 20 * len(place) > len(seq):
            keep, fresh = np.ones(len(seq), bool), np.zeros(len(seq), bool)
            keep[gone] = False
            fresh[place] = True
            seq, last, fresh = seq[keep], last[keep], fresh[keep]
            fresh[new] = True
            fresh[np.maximum(new - 1, 0)] = True
            place = np.flatnonzero(fresh & ~last)
        else:
            seq, last = np.delete(seq, gone), np.delete(last, gone)
            old = np.setdiff1d(place, gone, assume_unique=True)
            place = np.unique(np.concatenate((old - np.searchsorted(gone, old), new, np.maximum(new - 1, 0))))
            place = place[~last[place]]
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    symbols = np.diff(np.concatenate(([-1], np.flatnonzero(last))))
    return seq, join(left), join(right), length[FIRST_NONTERMINAL:], symbols


def to_bytes(ids, doc_ends, **parameters) -> bytes:
    import numpy as np

    seq, left, right, length, symbols = compress(ids, doc_ends, **parameters)
    rules = np.stack((left, right, length), axis=1).astype("<u4").tobytes()
    n_ids = np.diff(np.concatenate(([0], doc_ends))).astype("<u4").tobytes()
    return struct.pack(HEAD, MAGIC, FIRST_NONTERMINAL, len(left), len(doc_ends), len(seq)) + rules + n_ids + symbols.astype("<u4").tobytes() + seq.astype("<u4").tobytes()


class Shard:
    """A shard read back."""

    def __init__(self, blob: bytes):
        import numpy as np

        magic, self.first, rules, docs, symbols = struct.unpack_from(HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize(HEAD)
        self.rules = np.frombuffer(blob, "<u4", 3 * rules, at).reshape(-1, 3).astype(np.int64)
        at += 12 * rules
        self.n_ids = np.frombuffer(blob, "<u4", docs, at).astype(np.int64)
        self.n_symbols = np.frombuffer(blob, "<u4", docs, at + 4 * docs).astype(np.int64)
        self.seq = np.frombuffer(blob, "<u4", symbols, at + 8 * docs)

    def _unrolled(self, symbols):
        """Replace nonterminals by their two sides until none is left."""
        import numpy as np

        seq = np.asarray(symbols, np.int64)
        while len(seq):
            rule = seq >= self.first
            if not rule.any():
                break
            at = np.cumsum(np.where(rule, 2, 1))
            out = np.empty(at[-1], np.int64)
            out[at[~rule] - 1] = seq[~rule]
            used = self.rules[seq[rule] - self.first]
            out[at[rule] - 2], out[at[rule] - 1] = used[:, 0], used[:, 1]
            seq = out
        return seq

    def expand(self, symbols):
        """The ids that symbols stand for; each rule among them is unrolled once."""
        import numpy as np

        seq = np.asarray(symbols, np.int64)
        is_rule = seq >= self.first
        used, of = np.unique(seq[is_rule], return_inverse=True)
        length = self.rules[used - self.first, 2]
        source = np.concatenate((self._unrolled(used), seq))
        size, start = np.ones(len(seq), np.int64), np.arange(len(seq)) + length.sum()
        size[is_rule], start[is_rule] = length[of], (np.cumsum(length) - length)[of]
        stop = np.cumsum(size)
        return source[np.repeat(start - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]

    def document(self, k: int, start: int = 0, stop: int | None = None):
        """Ids of document k, or of a part of it: only the symbols that hold the part are expanded."""
        import numpy as np

        a = int(self.n_symbols[:k].sum())
        seq = self.seq[a : a + int(self.n_symbols[k])].astype(np.int64)
        size = np.ones(len(seq), np.int64)
        rule = seq >= self.first
        size[rule] = self.rules[seq[rule] - self.first, 2]
        ends = np.cumsum(size)
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        i, j = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[i] - size[i]) if i < len(ends) else 0
        return self.expand(seq[i:j])[start - before : stop - before]


SHARDS = "shard long, docs array<bigint>, n_tokens long, body binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = 1, shard_tokens: int = 2_000_000, **parameters) -> None:
    """Write the shards of all documents, in ascending order of doc_id."""

    def work(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tradelens.llm.tokens import batches, encoder

        words = encoder(tokenizer, "word")
        number = TaskContext.get().partitionId() << 32
        names, held, sizes, total = [], [], [], 0

        def close():
            ids, size = np.concatenate(held), np.concatenate(sizes)
            docs = pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.concat_arrays(names))
            names.clear(), held.clear(), sizes.clear()
            row = [pa.array([number]), docs, pa.array([len(ids)]), pa.array([to_bytes(ids, np.cumsum(size), **parameters)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["shard", "docs", "n_tokens", "body"])

        for part in parts:
            own, texts = part.column(0), part.column(1)
            for lo, hi in batches(texts, BATCH_BYTES):
                ids, ends = words.encode(texts.slice(lo, hi - lo), end_id)
                size, done, at = np.diff(ends, prepend=0), 0, 0
                while done < len(size):  # whole documents, until the shard is full
                    stop = min(len(size), done + 1 + int(np.searchsorted(ends[done:], at + shard_tokens - total, side="left")))
                    names.append(own.slice(lo + done, stop - done))
                    held.append(ids[at : ends[stop - 1]])
                    sizes.append(size[done:stop])
                    total += int(ends[stop - 1]) - at
                    done, at = stop, int(ends[stop - 1])
                    if total >= shard_tokens:
                        yield close()
                        number, total = number + 1, 0
        if held:
            yield close()

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("_n"))
    # rows with one id (as all without an id) may fill many ranges
    ordered = given.repartitionByRange("doc_id", "_n").sortWithinPartitions("doc_id", "_n")
    ordered.select("doc_id", "text").mapInArrow(work, SHARDS).write.option("compression", "zstd").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """shard and start: the number of ids before it. A sum per writing task, then one inside each."""
    sizes = shards.select("shard", "n_tokens", F.shiftright("shard", 32).alias("_task"))
    tasks = sizes.groupBy("_task").agg(F.sum("n_tokens").alias("_n"))  # one row for each task that wrote shards
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(tasks, "_task").select("shard", (F.col("_before") + F.col("_in")).alias("shard_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from its shard.

    Shards are decoded where they are read; only the documents' figures meet the shards' starts.
    """
    shards = spark.read.schema(SHARDS).parquet(path)

    def work(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in parts:
            for number, docs, body in zip(*(part.column(c) for c in ("shard", "docs", "body"))):
                shard = Shard(body.as_py())
                ids = shard.expand(shard.seq).astype("<u4")
                ends = np.cumsum(shard.n_ids)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), shard.n_ids.tolist())]
                rows = [pa.array(np.full(len(ends), number.as_py(), np.int64)), docs.values.cast(pa.int64()), pa.array(ends - shard.n_ids), pa.array(shard.n_ids), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = shards.select("shard", "docs", "body").mapInArrow(work, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long")
    start = F.col("shard_start") + F.col("start")
    return found.join(shard_starts(shards), "shard").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, **parameters) -> DataFrame:
    """Write all documents' shards to the shared folder and read them back."""
    path = scratch(docs.sparkSession, "token-shards")
    write_shards(docs, path, **parameters)
    return read_documents(docs.sparkSession, path)
