import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tradelens.llm import repair
from tradelens.llm.common import WORD_BPE, read, tokenizer_file
from tradelens.llm.tokens import Encoder

DOCS = "doc_id long, text string, shard string, body string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=60), min_size=1, max_size=8))
def test_round_trip(docs):
    ids = np.array([i for d in docs for i in d])
    ends = np.cumsum([len(d) for d in docs])
    shard = repair.Shard(repair.to_bytes(ids, ends, min_count=2))
    assert shard.expand(shard.seq).tolist() == ids.tolist()
    seq, left, right, _, symbols = repair.compress(ids, ends, min_count=2)
    inner = np.ones(len(seq), bool)
    inner[np.cumsum(symbols) - 1] = False
    met = [tuple(seq[i : i + 2]) for i in np.flatnonzero(inner)]
    assert all(met.count(p) < 4 for p in met if p[0] == p[1]) and all(met.count(p) < 2 for p in met if p[0] != p[1])  # none is left
    for k, d in enumerate(docs):
        assert shard.document(k).tolist() == d
        for a in range(0, len(d), 7):
            for b in range(a, len(d) + 1, 5):
                assert shard.document(k, a, b).tolist() == d[a:b]


def test_repeated_ids_shrink():
    ids = np.tile(np.arange(50), 400)
    shard = repair.Shard(repair.to_bytes(ids, [len(ids)]))
    assert len(shard.seq) + 2 * len(shard.rules) < len(ids) / 10
    assert shard.expand(shard.seq).tolist() == ids.tolist()


def test_a_shard_is_compressed_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 1_000_000), 49_000).astype(np.uint32)
    tracemalloc.start()
    try:
        blob = repair.to_bytes(ids, np.arange(500, len(ids) + 1, 500))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 28 * 4 * len(ids)  # all arrays at once, in copies of the given ids
    shard = repair.Shard(blob)
    assert (shard.expand(shard.seq) == ids).all()


def plain(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    out, start = [], 0
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df, **kw):
    return sorted(map(tuple, repair.encode_documents(df, **kw).collect()), key=lambda r: r[1])


def test_whole_table(spark, small):
    df = read(spark, small, "documents")
    want = plain([(r.doc_id, r.text) for r in df.collect()])
    assert got(df) == want
    assert got(df, shard_tokens=5000) == want


def test_edges(spark):
    docs = [(3, None), (1, ""), (None, "first"), (2, "Mixed CASE\tand  tabs\n\nÉcole ΣΑΣ İ x́!"), (9, "word " * 3000), (8, " "), (7, "<|endoftext|>")]
    df = spark.createDataFrame([(*d, "", "") for d in docs], DOCS)
    assert got(df) == plain(docs)
    assert got(df.limit(0)) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\u3000", "\u00a0", "a", "b.", "É", "é,", "(x)", "'s", "!", "1", "İ", "İ.", "\u0301", "<|endoftext|>", "<|startoftext|>", "<|ENDofText|>", "<|"]), max_size=14).map("".join) | st.none(), max_size=6))
def test_word_by_word_equals_whole(texts):
    import pyarrow as pa

    for name, kind in ((WORD_BPE, "word"), ("byte_bpe_50k.json", "byte")):
        e = test_word_by_word_equals_whole.__dict__.setdefault(kind, Encoder(name, kind))
        ids, ends = e.encode(pa.array(texts, pa.string()), 7)
        for k, text in enumerate(texts):
            own = ids[ends[k - 1] if k else 0 : ends[k]].tolist()
            assert own == [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 7]


def test_a_full_table_forgets_and_long_texts_are_cut(monkeypatch):
    import pyarrow as pa

    from tradelens.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 30)
    monkeypatch.setattr(tokens, "PIECE", 50)
    rng = np.random.default_rng(1)
    for name, kind in ((WORD_BPE, "word"), ("byte_bpe_50k.json", "byte")):
        e = Encoder(name, kind)
        for _ in range(12):
            texts = ["".join(rng.choice(["ab", "c,", " ", " ", "de.", "\n \n", "<|endoftext|>", "xy"]) for _ in range(rng.integers(0, 90))) for _ in range(5)]
            ids, ends = e.encode(pa.array(texts))
            want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            assert ids.tolist() == [i for w in want for i in w]
            assert np.diff(ends, prepend=0).tolist() == [len(w) for w in want]
    assert list(tokens.batches(pa.array(["aaa", None, "", "b" * 9, "c"]), 4)) == [(0, 4), (4, 5)]
