import numpy as np
from xxhash import xxh64_intdigest

from tradelens.llm import simhash
from tradelens.llm.common import read

DOCS = "doc_id long, text string, fp string, node int"


def plain(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(docs, radius=4):
    fps = [plain(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), f"{fps[i]:016x}", str(least.get(find(i)))) for i, (d, _) in enumerate(docs))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_whole_table(spark, small):
    docs = read(spark, small, "documents")
    assert got(simhash.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(300))
    docs = [(9, None), (3, ""), (5, " \n\t"), (7, "One two"), (8, "one TWO"), (1, base), (1, base), (2, base.replace("w7 ", "v7 ")), (None, base + " end"), (4, "École  x y z a")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS)
    assert got(simhash.near_duplicates(df)) == brute(docs)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_crowded_values_and_chains(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40)
    fps = {int(s) for s in seeds}
    for s in seeds[:10]:
        at = int(s)
        for _ in range(60):  # a chain that drifts away from its start
            at ^= 1 << int(rng.integers(0, 63))
            at ^= 1 << int(rng.integers(0, 63))
            fps.add(at)
    fps |= {int(v) for v in rng.integers(0, 2**31, 300)}  # one half in common
    monkeypatch.setattr(simhash, "BLOCK", 16)
    df = simhash.stored(spark.createDataFrame([(f,) for f in fps], "fp long"), "test")
    for radius, segments in ((4, 2), (3, 2), (4, 3), (8, 3)):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, radius, segments)).collect()}
        order = np.array(sorted(fps), np.int64)
        label = order.copy()
        while True:
            new = np.array([label[np.bitwise_count(order ^ f) <= radius].min() for f in order])
            if (new == label).all():
                break
            label = new
        assert {int(f): roots.get(int(f), int(f)) for f in order} == dict(zip(order.tolist(), label.tolist()))
