import numpy as np

import test_near
import test_packing
import test_quality
import test_repeats
from tradelens.llm import pipeline, quality, repeats, tiling
from tradelens.llm.common import read, stored


def cut(rows, window=13):
    """Brute force: the texts without the words under windows that start in a document with a smaller id."""
    first = {}
    place = lambda d: repeats.BEFORE_ALL if d is None else d
    for d, t in rows:
        w = test_repeats.words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, place(d)), place(d))
    out = {}
    for d, t in rows:
        w = test_repeats.words(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < place(d):
                gone[i : i + window] = True
        out[d] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if gone.any() else t
    return out


def test_each_stage_by_brute_force(spark, small):
    docs = read(spark, small, "documents")
    given = {r.doc_id: r.text for r in docs.collect()}
    kept = stored(pipeline.quality_rules(spark, docs, small), "a")
    assert kept.columns == pipeline.COLUMNS
    rows = {r.doc_id: r for r in kept.collect()}
    verdict = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert set(rows) == {d for d in given if verdict[d].kept}
    assert not any(test_quality.plain(given[d])[-1] for d in rows) and all(rows[d].text == given[d] for d in rows)

    single = stored(pipeline.near_duplicates(spark, kept, small), "b")
    left = {r.doc_id: r.text for r in single.collect()}
    assert sorted(left, key=str) == test_near.brute([(d, r.text) for d, r in rows.items()])

    shorter = stored(pipeline.repeated_passages(spark, single, small), "c")
    got = {r.doc_id: (r.text, r.n_chars) for r in shorter.collect()}
    want = cut(list(left.items()))
    assert got == {d: (t, len(t)) for d, t in want.items()}

    clean = stored(pipeline.benchmark_passages(spark, shorter, small), "d")
    items = [tiling.words_of(r.text) for r in read(spark, small, "benchmark").collect()]
    inside = lambda words, item: any(words[i : i + len(item)] == item for i in range(len(words) - len(item) + 1))
    stay = {r.doc_id for r in clean.collect()}
    judged = {d: [i for i in items if i and inside(tiling.words_of(t), i)] for d, (t, _) in got.items()}
    assert stay <= set(got) and not any(judged[d] for d in stay)
    for d in set(got) - stay:  # what goes has half of an item's words
        words = set(tiling.words_of(got[d][0]))
        assert any(2 * sum(w in words for w in i) >= len(i) for i in items)

    test_packing.check(pipeline.packed(spark, clean, small).collect(), [(d, got[d][0]) for d in stay], 2048)


def test_edges(spark, small):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (2, text, "en", "a", 1), (3, None, None, None, None), (None, " ".join(f"v{i}" for i in range(60)), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, small), "edge")
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stored(stage(spark, empty, small), "edge")
    assert empty.count() == 0
