"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Piece lengths are integers from 1 to the capacity, so the whole instance is a histogram of at most
``capacity`` rows, whatever the corpus holds. Only that histogram reaches the driver. The plan made
from it (a few thousand runs of equal sequences) is sent to the executors, which look up the place
of each piece from its rank among pieces of the same length. Ranks are counted in salted groups, so
that a length that a third of all pieces share is spread over many tasks.

Nulls: a null text is an empty one, which still has its end token. An empty table gives no rows.
Repeated rows are packed once each; pieces of equal length are placed in the order of doc_id and
piece. A very long text is cut into as many pieces as it takes. Further columns are left out.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import BYTE_BPE, stored

#: Pieces in a salted rank group: about this number of rows, and never fewer groups than MIN_SALTS.
RANK_ROWS, MIN_SALTS = 20_000, 64
#: Bytes of text encoded at once: what a worker holds beside its words is some twenty times as much.
BATCH_BYTES = 3_000_000


def token_pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary).

    A document's ids end with ``end_id``. Longer ones are cut so that every piece but the first is full.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def cut(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tradelens.llm.tokens import batches, encoder

        words = encoder(tokenizer, "byte")
        for part in parts:
            names, texts = part.column(0), part.column(1)
            for lo, hi in batches(texts, BATCH_BYTES):
                ids, ends = words.encode(texts.slice(lo, hi - lo), end_id)
                total = np.diff(ends, prepend=0)
                n = (total - 1) // capacity + 1
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = (total - 1) % capacity + 1
                start = np.where(piece, first[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece, capacity, first[doc])
                at, raw = (ends - total)[doc] + start, memoryview(ids.astype("<u4").tobytes())
                bodies = [raw[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), length.tolist())]
                rows = [names.slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in bodies], pa.int64())]
                if with_ids:
                    rows.append(pa.array([bytes(x) for x in bodies], pa.binary()))
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(rows)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


class Shelf:
    """A multiset of lengths with counts, in ascending order of length."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.remove(size)

    def largest_within(self, room: int, without: dict[int, int]) -> int | None:
        """The largest length of at most ``room`` that is there after ``without`` is set aside."""
        i = bisect.bisect_right(self.sizes, room)
        while i:
            i -= 1
            if self.count[self.sizes[i]] > without.get(self.sizes[i], 0):
                return self.sizes[i]
        return None

    def smallest_sum(self, k: int, without: int) -> float:
        """The sum of the ``k`` smallest lengths besides one of ``without``; infinite if there are fewer."""
        total, need = 0, k
        for s in self.sizes:
            got = min(need, self.count[s] - (s == without))
            total, need = total + s * got, need - got
            if not need:
                return total
        return float("inf")


def dominant(shelf: Shelf, item: int, capacity: int) -> list[int] | None:
    """A set with ``item`` that dominates every feasible set with it, if one of up to three members does.

    * nothing fits beside the item: it stays alone;
    * the best single partner fills the sequence, or no two others fit: that partner;
    * no three others fit: the largest partner and the largest that still fits beside it, provided
      that no pair of others has a larger smaller member; or the partner alone, if it is as large as
      any pair together.
    """
    room = capacity - item
    partner = shelf.largest_within(room, {item: 1})
    if partner is None:
        return [item]
    if partner == room or shelf.smallest_sum(2, item) > room:
        return [item, partner]
    if shelf.smallest_sum(3, item) <= room:
        return None
    held = {item: 1}
    held[partner] = held.get(partner, 0) + 1
    second = shelf.largest_within(room - partner, held)
    best_pair, best_lower = 0, 0
    for s in shelf.sizes:
        if 2 * s > room:
            break
        if shelf.count[s] <= (s == item):
            continue
        own = {item: 1}
        own[s] = own.get(s, 0) + 1
        mate = shelf.largest_within(room - s, own)
        if mate is not None and mate >= s:
            best_pair, best_lower = max(best_pair, s + mate), max(best_lower, s)
    if partner >= best_pair:
        return [item, partner]
    if second is not None and second >= best_lower:
        return [item, partner, second]
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Fix dominating sets, largest item first, until none is left. Returns (set, times) and the remainder."""
    shelf, fixed = Shelf(counts), []
    found = True
    while found:
        found = False
        for item in reversed(list(shelf.sizes)):
            while item in shelf.count:
                chosen = dominant(shelf, item, capacity)
                if chosen is None:
                    break
                need = {s: chosen.count(s) for s in set(chosen)}
                times = min(shelf.count[s] // n for s, n in need.items())
                for s, n in need.items():
                    shelf.take(s, n * times)
                fixed.append((chosen, times))
                found = True
    return fixed, shelf.count


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over runs of equal lengths: (lengths in a sequence, number of such sequences)."""
    open_runs: dict[int, list[tuple[list[int], int]]] = {capacity: []}
    rooms: list[int] = []

    def put(room: int, members: list[int], n: int) -> None:
        if n:
            if room not in open_runs or not open_runs[room]:
                open_runs[room] = []
                bisect.insort(rooms, room)
            open_runs[room].append((members, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                members, n = open_runs[room].pop()
                if not open_runs[room]:
                    rooms.pop(i)
            else:
                room, members, n = capacity, [], left
            each = room // size
            full, rest = divmod(left, each)
            used = min(full, n)
            put(room - each * size, members + [size] * each, used)
            left -= used * each
            if used < n and left and room < capacity:
                put(room - left * size, members + [size] * left, 1)
                left, used = 0, used + 1
            elif room == capacity and left:
                put(room - rest * size, members + [size] * rest, 1)
                left = 0
            if room < capacity:
                put(room, members, n - used)
    return [run for runs in open_runs.values() for run in runs]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Runs of equal sequences: the fixed sets, then best fit over what they leave."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces.

    ``pieces`` must give the same rows each time it is read (a stored table): it is counted, then placed.
    """
    counts = {int(r[length]): int(r["n"]) for r in pieces.groupBy(length).agg(F.count("*").alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    keys, first_sequence, offsets, at, sequences = [], [], [], dict.fromkeys(counts, 0), 0
    for members, n in plan(counts, capacity):
        place = 0
        for size in members:
            keys.append((size << 44) | at[size])
            first_sequence.append(sequences)
            offsets.append(place)
            at[size], place = at[size] + n, place + size
        sequences += n
    places = pieces.sparkSession.sparkContext.broadcast((keys, first_sequence, offsets))
    total = sum(counts.values())
    salts = max(MIN_SALTS, total // RANK_ROWS)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(length, "_salt").agg(F.count("*").alias("_n")).select(length, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(length, "_salt").orderBy(*[c for c in pieces.columns if c not in (length, "ids")])
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1).join(starts, [length, "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_in")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def place_all(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        run_keys, run_sequences, run_offsets = (np.asarray(x, np.int64) for x in places.value)
        order_of = np.argsort(run_keys, kind="stable")
        run_keys, run_sequences, run_offsets = run_keys[order_of], run_sequences[order_of], run_offsets[order_of]
        for part in parts:
            if not part.num_rows:
                continue
            key = (part.column(length).to_numpy(zero_copy_only=False).astype(np.int64) << 44) | part.column("_rank").to_numpy(zero_copy_only=False)
            run = np.searchsorted(run_keys, key, side="right") - 1
            kept = [part.column(c) for c in part.schema.names if c != "_rank"]
            names = [c for c in part.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(run_sequences[run] + key - run_keys[run]), pa.array(run_offsets[run])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place_all, schema)


def pack_documents(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(stored(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)
