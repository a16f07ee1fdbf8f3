import numpy as np
import pytest

from tradelens.llm import near, pipeline
from tradelens.llm.common import read

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """The least id of each class under Jaccard >= 0.8."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min((v for v in (least.get(x), d) if v is not None), default=None)
    return sorted(least.values(), key=str)


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    return sorted((r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()), key=str)


def test_edited_copies_against_brute_force(spark):
    """Copies with words replaced at random: similarities on both sides of 0.8, most beyond four bits of a fingerprint."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(25):
        base = [f"w{g}x{i}" for i in range(int(rng.integers(3, 400)))]
        for _ in range(4):
            own = list(base)
            for at in rng.integers(0, len(own), int(len(own) * rng.choice([0.01, 0.02, 0.03]))):
                own[at] = f"v{int(rng.integers(1 << 30))}"
            rows.append((int(rng.integers(1 << 40)), " ".join(own)))
    assert kept(spark, rows) == brute(rows)


def test_threshold_and_edges(spark):
    word = [f"w{i}" for i in range(13)]  # nine shingles
    rows = [(1, " ".join(word)), (2, " ".join(word + ["a"])), (3, " ".join(["b", "c", "d"] + word)), (9, None), (8, ""), (7, " \n"), (6, "One two"), (5, "one  TWO"), (5, "one  TWO"), (None, "one two"), (None, "x"), (None, " x")]
    assert kept(spark, rows) == brute(rows)


@pytest.mark.parametrize("frequent", [1, 4, 10**9])
def test_crowded_group_and_common_passage(spark, monkeypatch, frequent):
    monkeypatch.setattr(near, "FREQUENT", frequent)
    monkeypatch.setattr(near, "ROUNDS", 1)
    rng = np.random.default_rng(8)
    base, common = [f"b{i}" for i in range(90)], [f"c{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = list(base)
        for at in rng.integers(0, 90, 2):
            own[at] = f"v{i}x{at}"
        rows.append((1000 + i, " ".join(own)))
        rows.append((2000 + i, " ".join([f"u{i}x{j}" for j in range(40)] + common)))
    assert kept(spark, rows) == brute(rows)


def test_long_texts_that_share_a_passage_are_ruled_out_by_parities(spark):
    """Sets far larger than the coarse parities have bits: of pairs that are unlike, none is compared in whole, and none of the alike is lost."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(2600)]
    texts = [" ".join([f"u{g}x{i}" for i in range(1300)] + base[:1300]) for g in range(8)]  # similarity of a third
    for share in (0.01, 0.02, 0.022, 0.024, 0.03):  # on both sides of 0.8
        own = list(base)
        for at in rng.permutation(len(own))[: int(len(own) * share)]:
            own[at] = f"v{int(rng.integers(1 << 30))}"
        texts.append(" ".join(own))
    texts += [" ".join(base), " ".join(base[:2080]), " ".join(base[:2050])]  # of these, some have half as many parities
    sets = [near.shingle_set(t, 5) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))]
    alike = {(a, b) for a, b in pairs if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    given, marked = spark.createDataFrame(list(enumerate(texts)), "k long, text string"), spark.createDataFrame(pairs, "a long, b long")
    marks = near._marks(given, 5)
    assert len({len(r.fine) for r in marks.collect()}) > 1
    likely = {(r.a, r.b) for r in near._likely(marked, marks).collect()}
    assert alike and alike <= likely and not any(a < 8 for a, b in likely) and len(likely) < len(alike) + 6
    rows = list(enumerate(texts))
    assert kept(spark, rows) == brute(rows)


def test_whole_table(spark, small):
    docs = read(spark, small, "documents")
    assert sorted((r.doc_id for r in near.first_of_each(docs).collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
