"""Language identification by a byte convolutional network.

Windows of ``WINDOW`` bytes of lower-cased UTF-8 go through an embedding, filters of several widths,
a rectifier, the maximum over the window and a softmax layer. The network is trained in numpy on the
driver, on a bounded sample of labelled windows, and applied to all windows of every whole text. For
prediction the embedding is folded into the filters: a filter's value is a sum of table look-ups, one
for each byte it covers.

Training rows: those with a text and a label that ``usable`` admits. Every label trains, with its
first ``docs_per_label`` distinct texts by a hash of the text, and at most ``windows_per_doc`` windows
of each, spread over the text. Where the labels are so many that this makes over ``most_docs`` texts,
each has an equal share of these, one text at least. Prediction covers all data.

Nulls and texts without a letter get ``und`` with score 0. Rows with null labels are predicted like
any other. Ties go to the label that sorts first. Without any training row every text is ``und``.
Repeated rows get equal predictions; further columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import stored

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 20
EMBEDDING = 12
WORD_CHARACTER = re.compile(r"[^\W\d_]")


def windows_of(text: str):
    """(windows, WINDOW) bytes and the number of bytes in each; the last is filled with spaces."""
    import numpy as np

    raw = text.lower().encode()
    n = -(-len(raw) // WINDOW)
    rows = np.frombuffer(raw.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW)
    size = np.full(n, WINDOW, np.float32)
    if n:
        size[-1] = len(raw) - (n - 1) * WINDOW
    return rows, size


def has_letter(text: str) -> bool:
    """Is there a letter? Fractions, raised digits and numbers in circles are none."""
    return any(m[0].isalpha() for m in WORD_CHARACTER.finditer(text))


class Network:
    """Parameters as a dict of arrays; ``labels`` in sorted order."""

    def __init__(self, labels: list[str], weights: dict | None = None, seed: int = 17):
        import numpy as np

        self.labels = labels
        rng = np.random.default_rng(seed)
        self.w = weights or {
            "emb": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            **{f"k{w}": rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS},
            **{f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS},
            "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32),
            "bias": np.zeros(len(labels), np.float32),
        }

    def tables(self):
        """For each width, one (256, FILTERS) table per byte covered."""
        return {w: [self.w["emb"] @ self.w[f"k{w}"][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)] for w in WIDTHS}

    def pooled(self, rows, tables, where: bool = False):
        """Rectified maxima over each window, and for training where they are."""
        import numpy as np

        peaks, places = [], []
        for w in WIDTHS:
            n = rows.shape[1] - w + 1
            value = tables[w][0][rows[:, :n]]
            for k in range(1, w):
                value += tables[w][k][rows[:, k : k + n]]
            if where:
                at = value.argmax(axis=1)
                places.append(at)
                peaks.append(np.take_along_axis(value, at[:, None, :], 1)[:, 0, :] + self.w[f"b{w}"])
            else:
                peaks.append(value.max(axis=1) + self.w[f"b{w}"])
        return np.maximum(np.concatenate(peaks, axis=1), 0), places

    def log_probabilities(self, rows, tables):
        import numpy as np

        z = self.pooled(rows, tables)[0] @ self.w["out"] + self.w["bias"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, rows, labels, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 23) -> None:
        """Adam on the cross-entropy; the gradient of a maximum goes to the bytes under it."""
        import numpy as np

        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                x, y = rows[order[lo : lo + batch]], labels[order[lo : lo + batch]]
                hidden, places = self.pooled(x, self.tables(), where=True)
                z = hidden @ self.w["out"] + self.w["bias"]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                grad = {"out": hidden.T @ p, "bias": p.sum(axis=0), "emb": np.zeros_like(self.w["emb"])}
                back = (p @ self.w["out"].T) * (hidden > 0)
                for s, w in enumerate(WIDTHS):
                    d = back[:, s * FILTERS : (s + 1) * FILTERS]
                    grad[f"b{w}"] = d.sum(axis=0)
                    g = np.zeros_like(self.w[f"k{w}"])
                    for k in range(w):
                        byte = np.take_along_axis(x, places[s] + k, 1)
                        part = slice(k * EMBEDDING, (k + 1) * EMBEDDING)
                        g[part] = np.einsum("bfe,bf->ef", self.w["emb"][byte], d)
                        np.add.at(grad["emb"], byte, d[:, :, None] * self.w[f"k{w}"][part].T[None])
                    grad[f"k{w}"] = g
                step += 1
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, usable: Column, docs_per_label: int = 1000, windows_per_doc: int = 4, most_docs: int = 200_000) -> Network | None:
    """Train on labelled rows; the sample holds at most ``docs_per_label`` x ``windows_per_doc`` windows of each label."""
    import numpy as np

    labelled = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), usable.alias("_use")).where("_use and text <> '' and lang is not null")
    labelled = labelled.withColumn("_h", F.xxhash64("text"))
    known = stored(labelled.select("lang", "_h").distinct(), "label-texts")
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("_n")), "labels")
    n_labels = sizes.count()
    if not n_labels:
        return None
    most = min(docs_per_label, max(1, most_docs // n_labels))
    # a share that surely holds ``most`` of each label, so that no label's rank needs all its rows
    span = 1 << 30
    near = known.join(sizes, "lang").where(F.pmod("_h", F.lit(span)) <= F.lit(span) * (2.0 * most + 100) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    picked = near.withColumn("_rank", rank).where(F.col("_rank") <= most).select("lang", "_h")
    chosen = labelled.join(picked, ["lang", "_h"], "left_semi").groupBy("lang", "_h").agg(F.min("text").alias("text"))

    def cut(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            found, of = [], []
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows, _ = windows_of(text)
                for k in np.unique(np.linspace(0, len(rows) - 1, windows_per_doc).astype(int)) if len(rows) else []:
                    found.append(rows[k].tobytes())
                    of.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(of, pa.string())], ["bytes", "lang"])

    sample = sorted((r["lang"], bytes(r["bytes"])) for r in chosen.select("text", "lang").mapInArrow(cut, "bytes binary, lang string").collect())
    if not sample:
        return None
    labels = sorted({lang for lang, _ in sample})
    number = {lang: i for i, lang in enumerate(labels)}
    net = Network(labels)
    epochs = max(6, 100 // -(-len(sample) // 64))  # of a small sample as many as make a hundred steps
    net.train(np.frombuffer(b"".join(b for _, b in sample), np.uint8).reshape(-1, WINDOW), np.array([number[lang] for lang, _ in sample]), epochs=epochs)
    return net


def predict(docs: DataFrame, net: Network | None, keys: list[Column]) -> DataFrame:
    """``keys`` (named columns), lang_pred and score of every row, from all windows of its text."""
    given = docs.select(*keys, F.col("text").cast("string").alias("_text"))
    names = given.columns[:-1]
    sent = docs.sparkSession.sparkContext.broadcast(net and (net.labels, net.w))

    def work(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        net = sent.value and Network(*sent.value)
        tables = net and net.tables()
        for part in parts:
            texts = part.column("_text")
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            held, size, of = [], [], []

            def judge():
                if not held:
                    return
                rows, weight, owner = np.concatenate(held), np.concatenate(size), np.concatenate(of)
                logp = np.concatenate([net.log_probabilities(rows[i : i + 64], tables) for i in range(0, len(rows), 64)])
                first = np.flatnonzero(np.concatenate(([True], np.diff(owner) != 0)))
                mean = np.add.reduceat(logp * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
                prob = np.exp(mean - mean.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                for o, b, s in zip(owner[first].tolist(), prob.argmax(axis=1).tolist(), prob.max(axis=1).tolist()):
                    pred[o], score[o] = net.labels[b], min(1.0, max(0.0, float(s)))
                held.clear(), size.clear(), of.clear()

            waiting = 0
            for i in range(len(texts) if net else 0):
                text = texts[i].as_py()
                if text and has_letter(text):
                    rows, weight = windows_of(text)
                    held.append(rows), size.append(weight), of.append(np.full(len(rows), i))
                    waiting += len(rows)
                    if waiting >= 8192:
                        judge()
                        waiting = 0
            judge()
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(work, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred and score. Held out from training: crc32 of the doc_id as text, modulo 4, is 2."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    net = fit(docs, ~held_out, **parameters)
    return predict(docs, net, [F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out")])
