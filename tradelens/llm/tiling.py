"""Benchmark decontamination by greedy string tiling.

Shared seeds (``min_tile`` consecutive words) join documents with test items; within each pair the
longest common runs of unmarked words are marked first, so that a passage whose sentences come in
another order is still covered. A document is contaminated if the tiles cover ``threshold`` of an
item's words.

Karp-Rabin values say where seeds may be; the words of each are then compared, as numbers that a
dictionary of the items' words gives them, so no collision of values makes a match.

The test items are the fixed side: they are sent to the executors in blocks of at most
``block_chars`` characters. Each document passes through the blocks one after the other and keeps its
best item; after ``BLOCKS_AT_ONCE`` blocks the rows are stored, so that any number of items is handled
in bounded memory. Documents are never shuffled; a test item that a third of all documents hold costs
each of them the same.

Words are lower-cased runs of letters and digits. Nulls: a null text has no words and is clean; an
item with no words matches nothing; a null item_id is kept as it is. An item shorter than a seed must
be met whole. Ties go to the least item_id. Repeated rows are judged alike, and an empty table on
either side gives no contaminated rows. Seeds of a very long text are joined into runs
``SEEDS_AT_ONCE`` at a time, so that one repeated phrase takes no more memory than its runs. A carried
column that is called like a column of the result comes back as ``carried_`` and its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import stored

WORD = re.compile(r"\w+")
#: Pairs of places (in an item, in a document) that are held before they are joined into runs.
SEEDS_AT_ONCE = 2_000_000
#: Blocks of items that one stage holds, each in a Python worker of its own.
BLOCKS_AT_ONCE = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rolled(numbers, k: int):
    """Karp-Rabin values of each k consecutive numbers, modulo 2**64."""
    import numpy as np

    n = max(0, len(numbers) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[i : i + n].view(np.uint64)
    return out


def runs_of(owner, i, j, n=None):
    """Seeds, or runs of ``n`` seeds, joined where one follows the other on a diagonal: (owner, i, j, n), sorted by owner."""
    import numpy as np

    n = np.ones(len(i), np.int64) if n is None else n
    order = np.lexsort((i, j - i, owner))
    owner, i, j, n = owner[order], i[order], j[order], n[order]
    if not len(i):
        return owner, i, j, n
    new = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(j - i) != 0) | (i[1:] != i[:-1] + n[:-1])))
    first = np.flatnonzero(new)
    return owner[first], i[first], j[first], np.add.reduceat(n, first)


def tiles(item, doc, runs, k: int) -> list[tuple[int, int, int]]:
    """(length, place in the item, place in the document), longest first, no word used twice.

    ``runs``: places at which the two agree (in the item, in the document) and for how many seeds of k words.
    """
    import heapq

    import numpy as np

    heap = [(-(n + k - 1), a, b) for a, b, n in zip(*(x.tolist() for x in runs))]
    heapq.heapify(heap)
    used_item, used_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = ~(used_item[a : a - n] | used_doc[b : b - n])
        if free.all():
            used_item[a : a - n] = used_doc[b : b - n] = True
            out.append((-n, a, b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x >= k:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return out


class Items:
    """The test items of one block: their words as numbers from 1 on, and an index of their seeds."""

    def __init__(self, rows: list[tuple], min_tile: int):
        import numpy as np

        self.number: dict[str, int] = {}
        self.ids, self.words, self.by_k = [], [], {}
        for item_id, text in rows:
            words = words_of(text)
            if words:
                self.by_k.setdefault(min(min_tile, len(words)), []).append(len(self.ids))
                self.ids.append(item_id)
                self.words.append(np.fromiter((self.number.setdefault(w, len(self.number) + 1) for w in words), np.int64, len(words)))
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        self.start = np.cumsum([0, *map(len, self.words)])
        self.index = []
        for k, members in self.by_k.items():
            values = [rolled(self.words[m], k) for m in members]
            value = np.concatenate(values)
            owner = np.repeat(members, [len(v) for v in values])
            place = np.concatenate([np.arange(len(v)) for v in values])
            order = np.argsort(value, kind="stable")
            self.index.append((k, value[order], owner[order], place[order]))

    def numbered(self, words: list[str]):
        """The words' numbers, 0 for a word that no item has."""
        import numpy as np

        return np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))

    def agree(self, item, place, doc, at, k: int):
        """Which of the seeds (place in an item, place in the document) have the same words?"""
        import numpy as np

        first, same = self.start[item] + place, np.ones(len(at), bool)
        for d in range(k):
            same &= self.flat[first + d] == doc[at + d]
        return same

    def best(self, text: str | None, threshold: float, before: tuple | None = None):
        """(coverage, item_id, number of tiles) of the most covered item, or ``before`` if none reaches the threshold and that."""
        import numpy as np

        rank = lambda covered, item_id: (covered, item_id is not None, -(item_id or 0))
        doc = self.numbered(words_of(text))
        best = before and (rank(*before[:2]), before)
        for k, value, owner, place in self.index:
            seen = rolled(doc, k)
            lo = np.searchsorted(value, seen)
            at = np.flatnonzero(value[np.minimum(lo, len(value) - 1)] == seen)
            if not len(at):
                continue
            lo = lo[at]
            n = np.searchsorted(value, seen[at], side="right") - lo
            found, start, total = [], 0, np.cumsum(n)
            while start < len(at):  # so many places of the document that their seeds fit
                before = total[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(total, before + SEEDS_AT_ONCE, side="right")))
                m, first = n[start:stop], lo[start:stop]
                entry = np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())
                item, i, j = owner[entry], place[entry], np.repeat(at[start:stop], m)
                same = self.agree(item, i, doc, j, k)
                found.append(runs_of(item[same], i[same], j[same]))
                start = stop
            own, i, j, size = runs_of(*map(np.concatenate, zip(*found))) if len(found) > 1 else found[0]
            if not len(own):
                continue
            cuts = np.flatnonzero(np.diff(own)) + 1
            for m, a, b in zip(own[np.concatenate(([0], cuts))].tolist(), np.concatenate(([0], cuts)).tolist(), [*cuts.tolist(), len(own)]):
                item = self.words[m]
                edge = np.zeros(len(item) + 1, np.int64)
                np.add.at(edge, i[a:b], 1)
                np.add.at(edge, i[a:b] + size[a:b] + k - 1, -1)
                if (np.cumsum(edge)[:-1] > 0).sum() < threshold * len(item):  # the seeds together cover too little
                    continue
                met = tiles(item, doc, (i[a:b], j[a:b], size[a:b]), k)
                covered = sum(t[0] for t in met) / len(item)
                if covered >= threshold:
                    key = rank(covered, self.ids[m])
                    if best is None or key > best[0]:
                        best = key, (covered, self.ids[m], len(met))
        return best and best[1]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items, in lists of at most ``block_chars`` characters (or one item)."""
    own = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= block_chars:
        yield [tuple(r) for r in own.collect()]
        return
    n = -(-2 * total // block_chars)
    for b in range(n):
        yield [tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = 4, threshold: float = 0.5, block_chars: int = 32_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, contaminated, item_id, coverage and n_tiles of every row, and the columns in ``carry``."""
    spark = docs.sparkSession
    verdict = {"contaminated": F.lit(False), "item_id": F.lit(None).cast("long"), "coverage": F.lit(0.0), "n_tiles": F.lit(0).cast("long")}
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("row")).select("*", *[v.alias(c) for c, v in verdict.items()])
    names = ["doc_id", "text", "row", *verdict]
    for n, rows in enumerate(_blocks(benchmark, block_chars), 1):
        sent = spark.sparkContext.broadcast(rows)

        def work(parts: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            items = Items(sent.value, min_tile)
            for part in parts:
                found = []
                for text, *before in zip(*(part.column(c) for c in ("text", "contaminated", "coverage", "item_id", "n_tiles"))):
                    known, *before = (x.as_py() for x in before)
                    found.append(items.best(text.as_py(), threshold, tuple(before) if known else None) or (0.0, None, 0))
                own = [pa.array([f[2] > 0 for f in found]), pa.array([f[1] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *own], names)

        judged = judged.mapInArrow(work, judged.schema)
        if n % BLOCKS_AT_ONCE == 0:
            judged = stored(judged, "tiled")
    own = ["doc_id", *verdict]
    return judged.select(*own, *[F.col(f"row.`{c}`").alias(f"carried_{c}" if c.lower() in own else c) for c in carry])
