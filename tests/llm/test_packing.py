import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tradelens.llm import packing
from tradelens.llm.common import BYTE_BPE, read, tokenizer_file

DOCS = "doc_id long, text string, length long, piece int"


def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(BYTE_BPE))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, capacity):
    """Every piece is right, and every sequence is gapless and within the capacity."""
    want = {}
    for doc_id, text in docs:
        ids = plain_ids(text)
        first = (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.setdefault((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert got == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table(spark, small):
    docs = read(spark, small, "documents")
    rows = packing.pack_documents(docs).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 2


def test_edges(spark):
    texts = [None, "", " ", "a  b\n\n c \n d", "  x   y ", "word " * 3000, "café  　x <|endoftext|> y", "same", "same"]
    docs = [(i if i < 7 else 7, t, 5, 1) for i, t in enumerate(texts)] + [(None, "no id", 5, 1)]
    rows = packing.pack_documents(spark.createDataFrame(docs, DOCS), capacity=64).collect()
    check(rows, [(d[0], d[1]) for d in docs], 64)
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_uses_each_piece_once(counts):
    used, total = {}, 0
    for members, n in packing.plan(counts, 40):
        assert sum(members) <= 40 and n > 0
        total += n
        for s in members:
            used[s] = used.get(s, 0) + n
    assert used == counts
    assert total >= -(-sum(s * n for s, n in counts.items()) // 40)


def fewest(items, capacity):
    """By trying everything."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i]:
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_reduction_loses_no_optimum(items):
    counts = {s: items.count(s) for s in items}
    fixed, rest = packing.reduce_instance(counts, 20)
    left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(sorted(items, reverse=True), 20)


def test_encoded_batches_are_small():
    """What a worker holds of a batch is many times its text: three texts of 2 MB were encoded at once before."""
    import pyarrow as pa

    from tradelens.llm import packing, tokens

    assert list(tokens.batches(pa.array(["x" * 2_000_000] * 3), packing.BATCH_BYTES)) == [(0, 2), (2, 3)]
