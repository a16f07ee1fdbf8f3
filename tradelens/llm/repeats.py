"""Removal of repeated passages by sharded phrase automata.

Documents are dealt into parts of about ``part_bytes`` of text and stored bucketed by part, so that
each of the following steps reads a part with all its documents and shuffles no text.

1. Anchors. Every window of ``window`` words has an anchor: the least hash among its short shingles.
   Equal windows have equal anchors, so only windows whose anchor is met in two documents can recur.
2. Confirmation. Those windows are hashed, and the first document of each hash is found.
3. Passages. The part of a first document cuts the recurring windows out of its text, as passages of
   words, and each passage goes to the parts that have one of its windows.
4. Automata. Each part compiles its passages, in shards, into Aho-Corasick automata and streams its
   documents through them. Where a block of a passage is found, the words around it are compared, and
   the windows that are equal are removed if the document comes after the passage's own.
5. A window with the hash of an earlier document's but not its words is a collision of hashes. Such
   windows (commonly none) are settled by their words alone.

A passage that a third of all documents share makes no hot task: anchors and windows count once per
part and are pre-aggregated, what is joined back to a hot one is a row for each part, and a part gets
a passage once.

Nulls: a null or blank text has no words. A row without an id comes before every other. Rows with the
same id are one document for the order, so a passage in both is not removed. A very long text is a
part of its own size, held whole by one task. An empty table gives no rows. Further columns of the
input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import bucketed, forget, release, stored

#: Words in a shingle from which anchors are drawn.
ANCHOR_WORDS = 6
#: Windows in a passage at most; longer ones go on in the next.
PASSAGE_WINDOWS = 52
#: Windows in an automaton at most: what bounds its memory. A part with more has more automata.
SHARD_WINDOWS = 150_000
#: The digits in which the automaton reads words, how many make a word, and a word that no passage has.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SPELLING, UNKNOWN = 3, "-"
#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: The place of a row without an id.
BEFORE_ALL = -(1 << 63)
_FACTOR, _MIX = 0x9FB21C651E98DF25, 0x9E3779B97F4A7C15


def _powers(factor: int, n: int):
    """1, factor, factor squared, ... modulo 2**64."""
    import numpy as np

    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.concatenate((out[:1], np.full(n - 1, factor, np.uint64))), out=out)
    return out


def word_hashes(texts: list[bytes]):
    """A 64-bit number for each word of all texts, and the number of words in each text.

    A word's number is a polynomial of its bytes, from prefix sums over the text.
    """
    import numpy as np

    raw = b"\n".join(texts) + b"\n"
    edges = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    space = np.zeros(256, bool)
    space[list(b" \t\n\x0b\x0c\r")] = True
    up = down = np.ones(1, np.uint64)
    found, places, at = [], [], 0
    while at < len(raw):
        stop = min(at + CHUNK, len(raw))
        while stop < len(raw) and raw[stop - 1] not in b" \t\n\x0b\x0c\r":
            stop += 1
        part = np.frombuffer(raw, np.uint8, stop - at, at)
        if len(up) < len(part) + 1:
            up, down = _powers(_FACTOR, len(part) + 1), _powers(pow(_FACTOR, -1, 1 << 64), len(part) + 1)
        inside = ~space[part]
        change = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        begin, end = change[::2], change[1::2]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        h = (total[end] - total[begin]) * down[begin]
        h ^= h >> np.uint64(32)
        found.append(h * np.uint64(_MIX))
        places.append(begin + at)
        at = stop
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.diff(np.searchsorted(place, edges), prepend=0)


def _rolled(hashes, k: int, bits: int = 64):
    """One value for each k consecutive words."""
    import numpy as np

    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * np.uint64(_MIX)
        out ^= out >> np.uint64(32)
    return out >> np.uint64(64 - bits)


def anchors_of(hashes, window: int):
    """The anchor of each window."""
    import numpy as np

    short = min(ANCHOR_WORDS, window)
    least = _rolled(hashes, short)
    reach = window - short + 1
    step = 1
    while step < reach and len(least):  # doubling: the minimum over 2, 4, ... values
        jump = min(step, reach - step)
        least = np.minimum(least[: max(0, len(least) - jump)], least[jump:])
        step += jump
    return least


def _whole_windows(sizes, window: int):
    """For each window over the joined words of texts with ``sizes`` words: its text, and is it within the text?"""
    import numpy as np

    of = np.repeat(np.arange(len(sizes)), sizes)
    n = max(0, len(of) - window + 1)
    return of[:n], of[:n] == of[window - 1 :] if n else np.zeros(0, bool)


def removed_words(n: int, starts, window: int):
    """Boolean mask of the words under the windows that start at ``starts``."""
    import numpy as np

    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts, np.int64) + window, -1)
    return np.cumsum(edge)[:n] > 0


def _first_and_last(values, docs):
    """The distinct values with the least and the greatest document of each."""
    import numpy as np

    order = np.lexsort((docs, values))
    values, docs = values[order], docs[order]
    first = np.flatnonzero(np.diff(values, prepend=values[:1] - 1) != 0) if len(values) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(values)) - 1 if len(values) else first
    return values[first], docs[first], docs[last]


def _within(sorted_values, values):
    """The place of each value in ``sorted_values``, and is it there?"""
    import numpy as np

    if not len(sorted_values):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return at, sorted_values[at] == values


def _bytes_of(column) -> list[bytes]:
    return [t.encode() for t in column.to_pylist()]


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """part, anchor and the first and last document, once for the documents of a part that a batch holds."""

    def work(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            part, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                hashes, sizes = word_hashes(_bytes_of(batch.column(2).slice(lo, hi - lo)))
                anchors = anchors_of(hashes, window)
                of, whole = _whole_windows(sizes, window)
                keep = whole & np.concatenate(([True], (anchors[1:] != anchors[:-1]) | ~whole[:-1]))[: len(whole)]
                a, first, last = _first_and_last(anchors[keep].view(np.int64), doc[lo:hi][of[keep]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), part[lo], np.int32)), pa.array(a), pa.array(first), pa.array(last)], ["part", "anchor", "lo", "hi"])

    return docs.select("part", "doc", "text").mapInArrow(work, "part int, anchor long, lo long, hi long")


def _window_rows(window: int, bits: int):
    """From a part and its recurring anchors: part, window and the first and last document there."""

    def work(left, right):
        import numpy as np
        import pyarrow as pa

        w, lo, hi = (np.zeros(0, np.int64),) * 3
        anchors = np.sort(right.column("anchor").to_numpy())
        if len(anchors) and len(left):
            hashes, sizes = word_hashes(_bytes_of(left.column("text")))
            of, whole = _whole_windows(sizes, window)
            hit = np.flatnonzero(_within(anchors, anchors_of(hashes, window).view(np.int64))[1] & whole)
            w, lo, hi = _first_and_last(_rolled(hashes, window, bits)[hit].view(np.int64), left.column("doc").to_numpy()[of[hit]])
        part = np.full(len(w), left.column("part")[0].as_py() if len(left) else 0, np.int32)
        return pa.table({"part": part, "window": w, "lo": lo, "hi": hi})

    return work


def _passages(window: int, bits: int):
    """From a part and the recurring windows that its documents are the first to have: passages and their windows."""

    def work(left, right):
        import numpy as np
        import pyarrow as pa

        first, wins = right.column("first").to_numpy(), right.column("window").to_numpy()
        order = np.argsort(wins, kind="stable")  # a window has one first document
        first, wins = first[order], wins[order]
        firsts, texts, of_window = [], [], []
        wanted = np.isin(left.column("doc").to_numpy(), first) if len(left) else ()
        for k in np.flatnonzero(wanted).tolist():
            doc, text = left.column("doc")[k].as_py(), left.column("text")[k].as_py().encode()
            hashes, _ = word_hashes([text])
            rolled = _rolled(hashes, window, bits).view(np.int64)
            at, hit = _within(wins, rolled)
            hits = np.flatnonzero(hit & (first[at] == doc))
            hits = hits[np.sort(np.unique(rolled[hits], return_index=True)[1])]
            words = text.split() if len(hits) else ()
            for run in np.split(hits, np.flatnonzero(np.diff(hits) != 1) + 1):
                for i in range(0, len(run), PASSAGE_WINDOWS):
                    piece = run[i : i + PASSAGE_WINDOWS]
                    firsts.append(doc)
                    of_window.append(rolled[piece])
                    texts.append(b" ".join(words[int(piece[0]) : int(piece[-1]) + window]).decode())
        part = left.column("part")[0].as_py() if len(left) else 0
        numbers = (part << 32) + np.arange(len(texts), dtype=np.int64)
        return pa.table({"passage": pa.array(numbers), "first": pa.array(firsts, pa.int64()), "words": pa.array(texts, pa.string()), "windows": pa.array(of_window, pa.list_(pa.int64()))})

    return work


class Phrases:
    """An automaton over passages, and what it takes to compare words at the places that it finds.

    Its patterns are blocks of half a window, cut from the passages one after another: every window of
    a passage holds one whole. Words are numbered by their hashes and spelt in ``DIGITS``, so no node of
    the automaton has many branches; what it finds is compared word by word.
    """

    def __init__(self, passages: list[tuple[int, bytes]], window: int):
        import ahocorasick
        import numpy as np

        self.window, self.block = window, (window + 1) // 2
        once: dict[bytes, int] = {}
        for doc, text in passages:
            once[text] = min(doc, once.get(text, doc))
        self.texts, self.first = list(once), np.array(list(once.values()), np.int64)
        hashes, self.size = word_hashes(self.texts)
        self.start = np.cumsum(self.size) - self.size
        self.known = np.unique(hashes)
        self.ids = self.numbers(hashes)
        spelt, step = self._spelt(self.ids), SPELLING * self.block
        blocks: dict[str, list[tuple[int, int]]] = {}
        for p, (start, size) in enumerate(zip(self.start.tolist(), self.size.tolist())):
            for at in range(0, size - self.block + 1, self.block):
                place = SPELLING * (start + at)
                blocks.setdefault(spelt[place : place + step], []).append((p, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, pattern in enumerate(blocks):
            self.automaton.add_word(pattern, k)
        self.automaton.make_automaton()
        self.held = np.array([x for held in blocks.values() for x in held], np.int64).reshape(-1, 2)
        self.n_held = np.array([len(held) for held in blocks.values()], np.int64)
        self.first_held = np.cumsum(self.n_held) - self.n_held

    def numbers(self, hashes):
        """Of the words that passages have, from 1; 0 for others."""
        import numpy as np

        at, hit = _within(self.known, hashes)
        return np.where(hit, at + 1, 0)

    @staticmethod
    def _spelt(numbers) -> str:
        import numpy as np

        digits = np.frombuffer(DIGITS.encode(), np.uint8)
        out = digits[np.stack([numbers >> 6 * k & 63 for k in range(SPELLING)], axis=1)]
        out[numbers == 0] = ord(UNKNOWN)
        return out.tobytes().decode()

    def starts(self, texts: list[bytes], docs, likely=None, hashes=None, sizes=None):
        """Where windows start whose first document comes before their own, as places among the words of all texts.

        ``docs``: the texts' documents; ``likely``: starts beside which nothing else need be looked at;
        ``hashes`` and ``sizes``: what ``word_hashes`` gives for the texts.
        """
        import numpy as np

        if hashes is None:
            hashes, sizes = word_hashes(texts)
        own, of, begins = self.numbers(hashes), np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
        found = np.array(list(self.automaton.iter(self._spelt(own))), np.int64).reshape(-1, 2)
        found = found[(found[:, 0] + 1) % SPELLING == 0]
        at = (found[:, 0] + 1) // SPELLING - self.block
        near = of[at] == of[at + self.block - 1]
        if likely is not None:  # does a likely window hold the block?
            up_to = np.zeros(len(own) + 2, np.int64)
            up_to[np.asarray(likely) + 1] = 1
            up_to = np.cumsum(up_to)
            near &= up_to[at + 1] > up_to[np.maximum(at - (self.window - self.block), 0)]
        at, found = at[near], found[near]
        n = self.n_held[found[:, 1]]
        entry = np.repeat(self.first_held[found[:, 1]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        p, at = self.held[entry, 0], np.repeat(at, n)
        shift = at - self.held[entry, 1]
        early = self.first[p] < np.asarray(docs)[of[at]]
        # a passage, where it would begin, and the text that this is about
        pair = np.unique(np.stack((p[early], shift[early], of[at[early]])), axis=1) if early.any() else np.zeros((3, 0), np.int64)
        sure, words, theirs = np.zeros(len(own), bool), {}, {}
        for lo in range(0, pair.shape[1], 8192):
            p, shift, text = pair[:, lo : lo + 8192]
            size = self.size[p]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            place = np.repeat(shift, size) + inner
            inside = (place >= 0) & (place < len(own))
            place = np.where(inside, place, 0)
            equal = inside & (of[place] == np.repeat(text, size)) & (own[place] == self.ids[np.repeat(self.start[p], size) + inner])
            total = np.concatenate(([0], np.cumsum(equal)))
            begin = np.flatnonzero(np.repeat(size, size) - inner >= self.window)
            begin = begin[total[begin + self.window] - total[begin] == self.window]
            begin = begin[~sure[place[begin]]]
            which = np.repeat(np.arange(len(p)), size)[begin]
            edges = np.concatenate(([0], np.flatnonzero((np.diff(begin) != 1) | (np.diff(which) != 0)) + 1, [len(begin)])) if len(begin) else [0]
            for x, y in zip(edges, edges[1:]):
                # numbers are those of hashes: now the words themselves
                k, passage = int(text[which[x]]), int(p[which[x]])
                if k not in words:
                    words[k] = texts[k].split()
                if passage not in theirs:
                    theirs[passage] = self.texts[passage].split()
                at, b, m = int(place[begin[x]]), int(inner[begin[x]]), int(y - x)
                a = at - int(begins[k])
                if words[k][a : a + m - 1 + self.window] == theirs[passage][b : b + m - 1 + self.window]:
                    sure[at : at + m] = True
                else:
                    for i in range(m):
                        sure[at + i] |= words[k][a + i : a + i + self.window] == theirs[passage][b + i : b + i + self.window]
        return np.flatnonzero(sure)


def _shards(passages: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    """Passages in lists of at most ``SHARD_WINDOWS`` windows (or one passage), those of one document together."""
    held, size = [], 0
    for doc, text in sorted(passages):
        n = text.count(b" ") + 1
        if held and size + n > SHARD_WINDOWS:
            yield held
            held, size = [], 0
        held.append((doc, text))
        size += n
    if held:
        yield held


def _stream_part(window: int, bits: int):
    """Compile the automata of one part and stream its documents through them."""

    def work(left, right):
        import numpy as np
        import pyarrow as pa

        docs, raw = left.column("doc").to_numpy(), _bytes_of(left.column("text"))
        hashes, sizes = word_hashes(raw)
        rolled = _rolled(hashes, window, bits).view(np.int64)
        of, whole = _whole_windows(sizes, window)
        begins = np.cumsum(sizes) - sizes
        sure, likely_at = np.zeros(len(rolled) + window, bool), np.zeros(len(rolled), bool)
        for passages in _shards(list(zip(right.column("first").to_pylist(), _bytes_of(right.column("words"))))):
            phrases = Phrases(passages, window)
            own, n = word_hashes([t for _, t in passages])
            of_passage, inner = _whole_windows(n, window)
            known, first, _ = _first_and_last(_rolled(own, window, bits).view(np.int64)[inner], np.array([d for d, _ in passages], np.int64)[of_passage[inner]])
            at, hit = _within(known, rolled)
            likely = np.flatnonzero(hit & whole & (first[at] < docs[of] if len(known) else False))  # what the automaton is to confirm
            if len(likely):
                likely_at[likely] = True
                sure[phrases.starts(raw, docs, likely, hashes, sizes)] = True
        texts, removed, unsure = list(left.column("text")), np.zeros(len(docs), np.int64), [[] for _ in docs]
        for k in np.unique(of[likely_at]).tolist():
            lo, hi = int(begins[k]), int(begins[k] + sizes[k])
            words, found = raw[k].split(), np.flatnonzero(sure[lo:hi])
            gone = removed_words(len(words), found, window)
            if gone.any():
                texts[k] = b" ".join(compress(words, ~gone)).decode()
            removed[k] = gone.sum()
            left_open = np.flatnonzero(likely_at[lo : min(hi, len(rolled))] & ~sure[lo : min(hi, len(rolled))])
            unsure[k] = [b" ".join(words[s : s + window]).decode() for s in left_open.tolist()]
        kept = [left.column(c) for c in ("part", "doc", "doc_id", "row")]
        texts = [t if isinstance(t, str) else t.as_py() for t in texts]
        found = [pa.array(sizes, pa.int64()), pa.array(removed), pa.array(texts, pa.string()), pa.array(unsure, pa.list_(pa.string()))]
        return pa.table([*kept, *found], ["part", "doc", "doc_id", "row", "n_words", "n_removed", "text", "unsure"])

    return work


def _occurrences(window: int, bits: int):
    """From a part and some window values: the words of all windows with these values, and their first document there."""

    def work(left, right):
        import numpy as np
        import pyarrow as pa

        wins, first = np.unique(right.column("window").to_numpy()), {}
        for doc, text in zip(left.column("doc").to_pylist(), _bytes_of(left.column("text"))) if len(wins) else ():
            hashes, _ = word_hashes([text])
            hits = np.flatnonzero(_within(wins, _rolled(hashes, window, bits).view(np.int64))[1]).tolist()
            words = text.split() if hits else ()
            for s in hits:
                phrase = b" ".join(words[s : s + window]).decode()
                first[phrase] = min(doc, first.get(phrase, doc))
        return pa.table({"phrase": pa.array(list(first), pa.string()), "first": pa.array(list(first.values()), pa.int64())})

    return work


def _settled(unsure: DataFrame, given: DataFrame, spread: DataFrame, window: int, bits: int) -> DataFrame:
    """part, first and words of the unsure windows (part, doc, phrase) whose words an earlier document has."""

    def hashed(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            found = [_rolled(word_hashes([t])[0], window, bits).view(np.int64)[0] for t in _bytes_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["window"])

    values = unsure.select("phrase").distinct().mapInArrow(hashed, "window long").distinct()
    places = spread.select("part", "window").union(spread.select("home", "window")).join(values, "window", "left_semi").distinct()
    occur = given.select("part", "doc", "text").groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_occurrences(window, bits), "phrase string, first long")
    first = occur.groupBy("phrase").agg(F.min("first").alias("first"))
    return unsure.join(first, "phrase").where("first < doc").select("part", "first", F.col("phrase").alias("words")).distinct()


def remove_repeats(docs: DataFrame, window: int = 13, part_bytes: int = 4_000_000, carry: tuple[str, ...] = (), bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and text of every row, and the columns named in ``carry``.

    The text is the words that stay, joined by one space; one that loses nothing stands as it is.
    ``bits``: length of the windows' hashes. It decides the cost, not the result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = int(-(-total // part_bytes)) or 1
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(parts)).cast("int").alias("part")
    given = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(BEFORE_ALL)).alias("doc"), text.alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("row"), part)
    given = bucketed(given, "part", -(-parts // 8), "parts")
    release(spark)
    by_part = given.select("part", "doc", "text").groupBy("part")

    # rows of one anchor or window: one for each part that has it
    of_anchor, of_window = Window.partitionBy("anchor"), Window.partitionBy("window")
    anchors = _anchor_rows(given, window).withColumns({"_first": F.min("lo").over(of_anchor), "_last": F.max("hi").over(of_anchor)})
    anchors = anchors.where("_first < _last").select("part", "anchor")
    anchors = bucketed(anchors, "part", -(-parts // 8), "anchors")  # so that their shuffle is gone before that of windows
    release(spark)
    windows = by_part.cogroup(anchors.groupBy("part")).applyInArrow(_window_rows(window, bits), "part int, window long, lo long, hi long")
    windows = windows.withColumn("_first", F.min(F.struct("lo", "part")).over(of_window)).select("part", "window", "hi", F.col("_first.lo").alias("first"), F.col("_first.part").alias("home"))
    spread = stored(windows.where("hi > first").drop("hi"), "spread")
    forget(spark, anchors)
    release(spark)

    firsts = spread.select(F.col("home").alias("part"), "first", "window").distinct()
    passages = by_part.cogroup(firsts.groupBy("part")).applyInArrow(_passages(window, bits), "passage long, first long, words string, windows array<long>")
    passages = stored(passages, "passages")
    release(spark)
    wanted = spread.select("part", "window").join(passages.select("passage", F.explode("windows").alias("window")), "window").select("part", "passage").distinct()
    sent = wanted.join(passages.select("passage", "first", "words"), "passage").select("part", "first", "words")
    sent = bucketed(sent, "part", -(-parts // 8), "sent")
    forget(spark, passages)
    release(spark)

    row = given.schema["row"].dataType.simpleString()
    schema = f"part int, doc long, doc_id long, row {row}, n_words long, n_removed long, text string, unsure array<string>"

    def stream(right: DataFrame) -> DataFrame:
        return stored(given.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(_stream_part(window, bits), schema), "streamed")

    streamed = stream(sent)
    unsure = streamed.where(F.size("unsure") > 0).select("part", "doc", F.explode("unsure").alias("phrase"))
    if not unsure.isEmpty():
        settled = stored(_settled(unsure, given, spread, window, bits), "settled")
        forget(spark, streamed)
        streamed = stream(sent.unionByName(settled))
    forget(spark, given, spread, sent)
    return streamed.select("doc_id", "n_words", "n_removed", "text", *[F.col(f"row.{c}").alias(c) for c in carry])


def digest(result: DataFrame) -> DataFrame:
    """The text's words joined by one space, as sha256."""
    joined = F.btrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    return result.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))
