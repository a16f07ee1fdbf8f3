import zlib

import numpy as np
from pyspark.sql import functions as F

from tradelens.llm import langid
from tradelens.llm.common import read


def test_held_out_accuracy(spark):
    df = read(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    lang = {r.doc_id: r.lang for r in df.collect()}
    assert len(got) == len(lang)
    out = [d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out == (d in set(out)) for d in lang)
    assert np.mean([got[d].lang_pred == lang[d] for d in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = [(i, t, lang, "x", 1) for i, (t, lang) in enumerate([("the cat and the dog " * 9, "en"), ("le chat et le chien " * 9, "fr")] * 30 + [(None, "en"), ("", None), ("123 $$$ ", "fr"), ("ÀÉ", None), ("the cat and the dog", None), ("le chien " * 20000, None), ("½ ² ① 5 _", "en")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, _use int")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (60, 61, 62, 66)] == ["und"] * 4 and got[60].score == 0.0
    assert got[63].lang_pred in ("en", "fr") and got[64].lang_pred == "en" and got[65].lang_pred == "fr"
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(none).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_gradient_by_differences(monkeypatch):
    """One step of plain descent, taken apart again, is the gradient that small differences give."""
    rng = np.random.default_rng(4)
    rows, labels = rng.integers(97, 101, (6, 16)).astype(np.uint8), rng.integers(0, 2, 6)
    net = langid.Network(["a", "b"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        return -net.log_probabilities(rows, net.tables())[np.arange(6), labels].mean()

    start = {k: v.copy() for k, v in net.w.items()}
    # from zero moments, the first step of Adam goes by the rate against the sign of the gradient
    net.train(rows, labels, epochs=1, batch=6, rate=1e-6)
    signs = {k: np.sign(start[k] - net.w[k]) for k in start}
    net.w = {k: v.copy() for k, v in start.items()}
    checked = 0
    for k, w in net.w.items():
        for at in rng.permutation(w.size)[:40]:
            place = np.unravel_index(at, w.shape)
            w[place] += 1e-5
            up = loss()
            w[place] -= 2e-5
            slope = (up - loss()) / 2e-5
            w[place] += 1e-5
            if abs(slope) > 1e-6:
                assert np.sign(slope) == signs[k][place], (k, place)
                checked += 1
    assert checked > 60


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    rows, labels = rng.integers(97, 101, (6, 16)).astype(np.uint8), rng.integers(0, 2, 6)
    net = langid.Network(["a", "b"])
    before = -net.log_probabilities(rows, net.tables())[np.arange(6), labels].mean()
    net.train(rows, labels, epochs=30, batch=6)
    after = -net.log_probabilities(rows, net.tables())[np.arange(6), labels].mean()
    assert after < before / 2


def test_every_label_trains_and_copies_count_once(spark, monkeypatch):
    rows = [(f"text of label {i}", f"l{i:03}") for i in range(230)]
    rows += [("one text in many copies", "hot")] * 400 + [(f"wide {i}", "wide") for i in range(400)] + [("", "blank")]
    df = spark.createDataFrame(rows, "text string, lang string")
    seen = []
    monkeypatch.setattr(langid.Network, "train", lambda net, windows, labels, **_: seen.append([net.labels[i] for i in labels]))
    net = langid.fit(df, F.lit(True), docs_per_label=3)
    assert net.labels == sorted({lang for _, lang in rows} - {"blank"})
    assert [seen[0].count(x) for x in ("l000", "hot", "wide")] == [1, 1, 3]
    langid.fit(df, F.lit(True), docs_per_label=3, most_docs=2)
    assert seen[1].count("wide") == 1 and len(set(seen[1])) == 232
