import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tradelens.llm import repeats
from tradelens.llm.common import read

DOCS = "doc_id long, text string, anchors string, part string"


def words(t):
    return (t or "").encode().split()


def brute(docs, window=13):
    first = {}
    place = lambda d: repeats.BEFORE_ALL if d is None else d
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, place(d)), place(d))
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < place(d):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(d), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, **kw):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in repeats.digest(repeats.remove_repeats(df, **kw)).collect())


def test_whole_table(spark, small):
    df = read(spark, small, "documents")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got(df) == want
    assert got(df, part_bytes=20_000) == want


def test_edges(spark):
    p = [f"w{i}" for i in range(40)]
    long = " ".join(f"u{i}" for i in range(3000))
    docs = [
        (5, " ".join(p)), (2, "x " + " ".join(p[3:20]) + "\ty"), (7, " ".join(p[:13])), (7, " ".join(p[:13])), (8, " ".join(p[:12])), (9, None), (10, ""), (None, " ".join(p[10:30])),
        (11, "a " * 300), (12, "a " * 40), (13, "b " + "a " * 20 + "c"), (20, " ".join(p[:20] + p[8:28])), (21, " \n".join(p)), (30, long), (31, long), (32, "z " + long + " z"), (33, "É" + " ".join(p[1:30])),
    ]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOCS)
    assert got(df) == brute(docs)
    assert got(df, part_bytes=300) == brute(docs)
    assert got(df.limit(0)) == []
    kept = {r.doc_id: r.text for r in repeats.remove_repeats(df).where("doc_id in (8, 10)").collect()}
    assert kept == {8: " ".join(p[:12]), 10: ""}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=0, max_size=60), min_size=1, max_size=8))
def test_few_words(spark, texts):
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(*d, "", "") for d in docs], DOCS)
    assert got(df, window=5) == brute(docs, 5)


def test_colliding_hashes(spark, small):
    """Window hashes of a few bits collide all the time; the words decide."""
    df = read(spark, small, "documents").where("doc_id < 60")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    for bits in (4, 12):
        assert got(df, bits=bits, part_bytes=40_000) == want
    docs = [(i, " ".join("ab"[i * k % 3 % 2] for k in range(40))) for i in range(12)] + [(3, "b " * 30), (None, "a " * 30), (None, "b a " * 9)]
    df = spark.createDataFrame([(*d, "", "") for d in docs], DOCS)
    assert got(df, window=5, bits=2, part_bytes=100) == brute(docs, 5)


def test_automata_in_shards(monkeypatch):
    rng = np.random.default_rng(4)
    passages = [(int(d), b" ".join(rng.choice([b"x", b"y", b"z"], 9))) for d in rng.integers(0, 9, 30)]
    monkeypatch.setattr(repeats, "SHARD_WINDOWS", 20)
    shards = list(repeats._shards(passages))
    assert len(shards) > 10 and sorted(x for s in shards for x in s) == sorted(passages)
    words = list(rng.choice([b"x", b"y", b"z"], 400))
    text = b" ".join(words)
    found = {int(i) for s in shards for i in repeats.Phrases(s, 5).starts([text], [5])}
    for window in (1, 2, 5, 6):
        phrases = repeats.Phrases(passages, window)
        earlier = {tuple(t.split()[i : i + window]) for d, t in passages if d < 5 for i in range(10 - window)}
        assert phrases.starts([text], [5]).tolist() == [i for i in range(401 - window) if tuple(words[i : i + window]) in earlier]
    earlier = {tuple(t.split()[i : i + 5]) for d, t in passages if d < 5 for i in range(5)}
    assert found == {i for i in range(396) if tuple(words[i : i + 5]) in earlier}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=30), max_size=6), st.integers(1, 9))
def test_equal_words_have_equal_hashes(texts, chunk):
    texts, old = [t.encode() for t in texts], repeats.CHUNK
    repeats.CHUNK = chunk
    hashes, sizes = repeats.word_hashes(texts)
    repeats.CHUNK = old
    assert sizes.tolist() == [len(t.split()) for t in texts]
    every = [w for t in texts for w in t.split()]
    assert len(hashes) == len(every)
    assert len(set(zip(every, hashes.tolist()))) == len(set(every)) == len(set(hashes.tolist()))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 200).astype(np.uint64)
    a = repeats.anchors_of(h, 13)
    assert len(a) == 188
    assert all(repeats.anchors_of(h[i : i + 13], 13)[0] == a[i] for i in range(188))
