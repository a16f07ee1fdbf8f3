import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tradelens.llm import quality
from tradelens.llm.common import read, stored

DOCS = "doc_id long, text string, lang string, source string, n_words string, distance string"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def plain(t):
    w, t = words(t), t or ""
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    mark = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            mark[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, sum(mark), len(w) < 10 or 100 * sum(mark) > 20 * len(w)


def test_counts_on_whole_table_and_edges(spark, small):
    texts = [r.text for r in read(spark, small, "documents").collect()]
    texts += [None, "", " \n\n ", "a b c d e " * 3, "x\n x\nx\nx\x0b", "a\n\n\na", "é|é # <b>&", "a b c d e a b c d", "w " * 5000, "a b c d e f a b c d e f", "no\xa0break　here"]
    df = spark.createDataFrame([(i, t, None if i % 3 else "en", "s", "clash", "clash") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), repr(t)[:80]
        assert not (r.base_failed and r.kept)
    assert quality.judge(df.limit(0)).count() == 0


FLOORS = np.array(quality.FLOORS)


def middle(cells, share):
    return np.sort(cells)[int(np.ceil(share * len(cells))) - 1]


def brute(rows, support=0.75):
    """The estimate of one group in numpy: its centre, mean and covariance, and the determinants of all starts."""
    n, chars, sym, dup, rep = (np.array([r[k] for r in rows], float) for k in range(5))
    raw = [np.log(chars / n), np.sqrt(sym / (n + 20)), np.sqrt(10 * dup / (n + 50)), np.sqrt(rep / (n + 20))]
    cells = [np.floor(x / quality.STAT_CELL) for x in raw]
    med = np.array([(middle(c, 0.5) + 0.5) * quality.STAT_CELL for c in cells])
    wide = np.array([(middle(c, 0.75) - middle(c, 0.25)) * quality.STAT_CELL / 1.349 for c in cells])
    x = points(rows, med[0])
    at = np.array([0.0, *med[1:]])
    moments = lambda y, scale: (y.mean(axis=0), np.cov(y.T, bias=True) * scale + np.diag(FLOORS**2))
    now = [(at, np.diag((3 * FLOORS) ** 2)), (at, np.diag(np.maximum(wide, FLOORS) ** 2)), moments(x, 1.0)]
    det = lambda found: np.array([np.linalg.slogdet(c)[1] for _, c in found])
    for k in range(12):
        new = []
        for m, c in now:
            cell = np.floor(np.log(distance(x, m, c) + 1e-9) / quality.DISTANCE_CELL)
            new.append(moments(x[cell <= middle(cell, support)], quality.consistency(support)))
        done = not (det(new) < det(now) - quality.SETTLED).any()
        now = new
        if k and done:
            break
    best = int(np.argmin(det(now)))
    return len(rows), med[0], *now[best], det(now)


def points(rows, centre):
    n, chars, sym, dup, rep = (np.array([r[k] for r in rows], float) for k in range(5))
    return np.stack([(np.log(chars / n) - centre) * np.sqrt(np.minimum(n, 400)) / 10, np.sqrt(sym / (n + 20)), np.sqrt(10 * dup / (n + 50)), np.sqrt(rep / (n + 20))], axis=1)


def distance(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_estimates_match_numpy(spark):
    """One language and source: all three levels are the same, and so is what they are drawn to."""
    df = read(spark, "/root/testdata/sf0.01", "documents").where("lang = 'en'").withColumn("source", F.lit("one"))
    rows = [r for r in quality.judge(df).collect() if not r.base_failed]
    counts = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]
    _, centre, mean, cov, dets = brute(counts)
    assert len(rows) > 200 and len(dets) == 3
    d = distance(points(counts, centre), mean, cov)
    assert np.allclose([r.distance for r in rows], d, rtol=1e-5)
    assert [r.kept for r in rows] == (d <= 32).tolist()


def test_small_groups_are_drawn_to_larger_ones(spark):
    df = read(spark, "/root/testdata/sf0.01", "documents").where("lang in ('en', 'fr')")
    source = F.when(F.col("doc_id") % 40 == 0, "rare").when(F.col("lang") == "en", "wide").otherwise(F.col("source"))
    df = df.withColumn("source", source)
    key = {r.doc_id: (r.lang, r.source) for r in df.collect()}
    rows = [r for r in quality.judge(df).collect() if not r.base_failed]
    counts = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]
    pick = lambda test: brute([c for c, r in zip(counts, rows) if test(key[r.doc_id])])
    every = pick(lambda k: True)
    for group in {key[r.doc_id] for r in rows}:
        own, lang = pick(lambda k: k == group), pick(lambda k: k[0] == group[0])
        mix = lambda a, b, n: n / (n + 50) * a + (1 - n / (n + 50)) * b
        centre, mean, cov = (mix(own[i], mix(lang[i], every[i], lang[0]), own[0]) for i in (1, 2, 3))
        at = [i for i, r in enumerate(rows) if key[r.doc_id] == group]
        d = distance(points([counts[i] for i in at], centre), mean, cov)
        assert np.allclose([rows[i].distance for i in at], d, rtol=1e-5), group


def test_other_groups_change_no_estimate(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").withColumn("source", F.when(F.col("doc_id") % 40 == 0, "rare").otherwise("wide"))
    found = lambda df: {(r._level, r._lang, r._source): tuple(r) for r in quality.estimates(stored(quality.base_counts(df), "counts")).collect()}
    every, alone = found(docs), found(docs.where("lang = 'en' AND source = 'wide'"))
    assert np.allclose(every[0, "en", "wide"][3:], alone[0, "en", "wide"][3:], rtol=1e-9, atol=1e-12)


def test_clean_stay_and_junk_goes(spark):
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    clean = [" ".join(rng.choice(vocab, rng.integers(12, 3000))) for _ in range(150)]
    junk = [" ".join(f"{w}$$$" for w in rng.choice(vocab, 200)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", "", "") for i, t in enumerate(clean + junk)], DOCS)
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 170))
