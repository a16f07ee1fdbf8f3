import numpy as np

from tradelens.llm import tiling

DOCS = "doc_id long, text string, item_id string, coverage string"


def greedy(item, doc, k):
    """Longest common run of unmarked words, again and again."""
    used_i, used_d, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not used_i[i + n] and not used_d[j + n]:
                    n += 1
                best = max(best, (n, i, j), key=lambda x: x[0])
        n, i, j = best
        if n < k:
            return out
        used_i[i : i + n] = used_d[j : j + n] = [True] * n
        out.append(n)


def test_tiles_are_greedy():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, doc = rng.integers(0, 4, rng.integers(3, 25)), rng.integers(0, 4, rng.integers(3, 40))
        k = 3
        pairs = [(i, j) for i in range(len(item) - k + 1) for j in range(len(doc) - k + 1) if (item[i : i + k] == doc[j : j + k]).all()]
        if pairs:
            i, j = np.array(pairs).T
            found = tiling.tiles(item, doc, tiling.runs_of(np.zeros(len(i), np.int64), i, j)[1:], k)
            assert [n for n, _, _ in found] == greedy(item.tolist(), doc.tolist(), k)
            for n, a, b in found:
                assert (item[a : a + n] == doc[b : b + n]).all() and n >= k
            assert len({x for n, a, _ in found for x in range(a, a + n)}) == sum(n for n, _, _ in found)


def verdicts(spark, docs, items, **kw):
    df = spark.createDataFrame([(*d, "", "") for d in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: (r.contaminated, r.item_id) for r in tiling.contaminated(df, bench, **kw).collect()}


def test_verdicts(spark):
    item = " ".join(f"q{i}" for i in range(24))
    w = item.split()
    filler = " ".join(f"f{i}" for i in range(500))
    docs = [
        (1, f"{filler} {item} {filler}"), (2, " ".join(w[12:] + ["x"] + w[:12])), (3, " ".join(w[18:] + w[6:12] + w[12:18] + w[:6])), (4, filler), (5, None), (6, ""),
        (7, " ".join(x for p in zip(w, w[::-1]) for x in p)), (8, item.upper().replace(" ", ",  ")), (9, " ".join(w[:10])), (10, " ".join(w[:12])), (11, "tiny item"), (None, item),
    ]
    items = [(3, item), (1, item), (2, None), (4, ""), (5, "tiny item"), (None, "!!!"), (6, " ".join(f"z{i}" for i in range(30)))]
    want = {1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, None), 8: (True, 1), 9: (False, None), 10: (True, 1), 11: (True, 5), None: (True, 1)}
    assert verdicts(spark, docs, items) == want
    assert verdicts(spark, docs, items, block_chars=120) == want  # more blocks than one stage holds
    assert set(verdicts(spark, docs, items[:0] or [(1, None)]).values()) == {(False, None)}


def test_repeated_seeds_and_clashing_columns(spark, monkeypatch):
    rows = [(1, "spam " * 60), (2, "clean " * 5)]
    want = tiling.Items(rows, 4).best("x " + "spam " * 3000 + "y", 0.5)
    monkeypatch.setattr(tiling, "SEEDS_AT_ONCE", 100)
    assert tiling.Items(rows, 4).best("x " + "spam " * 3000 + "y", 0.5) == want == (1.0, 1, 1)
    df = spark.createDataFrame([(1, "spam " * 60, "a", "b")], DOCS)
    got = tiling.contaminated(df, spark.createDataFrame(rows, "item_id long, text string"), carry=("item_id", "coverage", "text")).collect()
    assert [r.asDict() for r in got] == [{"doc_id": 1, "contaminated": True, "item_id": 1, "coverage": 1.0, "n_tiles": 1, "carried_item_id": "a", "carried_coverage": "b", "text": "spam " * 60}]


def test_whole_table(spark):
    from tradelens.llm.common import read

    docs, bench = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "benchmark")
    got = {r.doc_id for r in tiling.contaminated(docs, bench).where("contaminated").collect()}
    items = [b.text for b in bench.collect()]
    leaked = {r.doc_id for r in docs.collect() if any(i in r.text for i in items)}
    assert leaked and leaked == got


def reordered(words, rng):
    """Passages of four to nine words of a text in another order."""
    parts, at = [], 0
    while at < len(words):
        n = int(rng.integers(4, 10))
        parts.append(words[at : at + n])
        at += n
    return [w for p in rng.permutation(len(parts)) for w in parts[p]]


def test_reordered_passages_over_a_whole_table(spark, small):
    from tradelens.llm.common import read

    rng = np.random.default_rng(11)
    docs = read(spark, small, "documents")
    texts = {r.doc_id: tiling.words_of(r.text) for r in docs.collect()}
    sources = [d for d, w in texts.items() if len(w) > 60][::7]
    items = [(n, " ".join(reordered(texts[d][10:58], rng))) for n, d in enumerate(sources)] + [(10_000, " ".join(rng.permutation(texts[sources[0]][:48])))]
    got = {r.doc_id: r for r in tiling.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = {n: tiling.words_of(t) for n, t in items}
    seeds = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    of_item = {n: seeds(w) for n, w in split.items()}
    for d, words in texts.items():
        own, best = seeds(words), (0.0, 0, None, 0)
        for n, w in split.items():
            met = own & of_item[n]
            if 8 * len(met) >= len(w):  # each seed covers four words at most
                found = greedy(w, words, 4)
                best = max(best, (sum(found) / len(w), -n, n, len(found)))
        want = (True, best[2], best[0], best[3]) if best[0] >= 0.5 else (False, None, 0.0, 0)
        assert (got[d].contaminated, got[d].item_id, got[d].coverage, got[d].n_tiles) == want
    assert all(got[d].contaminated for d in sources)


def test_words_decide_where_values_collide(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 60)) for _ in range(12)]
    rows = [(n, t) for n, t in enumerate(texts)]
    tested = [" ".join(t.split()[30:] + t.split()[:30]) for t in texts] + [" ".join(f"w{x}" for x in rng.integers(0, 40, 200))]
    want = [tiling.Items(rows, 4).best(t, 0.5) for t in tested]
    plain = tiling.rolled
    monkeypatch.setattr(tiling, "rolled", lambda numbers, k: plain(numbers, k) & np.uint64(3))
    assert [tiling.Items(rows, 4).best(t, 0.5) for t in tested] == want
    assert [w and w[1] for w in want] == [*range(12), None]
