"""Near-duplicate classes by the Jaccard similarity of word shingles, found exactly.

Two sets whose similarity is 0.8 or more have a shingle in common among the first
``n - ceil(0.8 n) + 1`` of each, whatever order the shingles are put in, so long as it is the same for
all (prefix filtering). Shingles that a sample of the texts has often come last in that order, the
others stand by their hash; the sample decides the cost alone, not the result.

1. SimHash fingerprints of the distinct texts are linked by multi-index hashing (``simhash.links``). It
   finds close copies at little cost, but of pairs at 0.8 most differ in more bits than any radius that
   this can be done for, so the rest is found by prefixes: each text is filed under the shingles of its
   prefix.
2. Of each shingle, two of the texts filed there stand for all, other two in each of a few rounds. Every
   text is compared with the one of these that it meets under most shingles: one comparison for each
   text and round, which joins most of a large group of near copies.
3. Texts of different components that meet under a shingle are then compared with each other, unless
   their sizes, their places in the prefixes or the parities of their sets rule out 0.8. Parities for
   the pairs that are left, and for those of the rounds, are as many as a set is large: few of another
   similarity than 0.8 or more are then compared in whole.

Compared are the whole sets, by the 64-bit hashes of their shingles. Words and letter case are those
of ``simhash.fingerprint_of``; a text with fewer words than a shingle has one shingle, and null and
blank texts share the empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import forget, release, stored
from tradelens.llm import simhash
from tradelens.llm.simhash import components

#: Texts in the sample that finds frequent shingles, and in how many of them such a shingle is.
SAMPLE = 10_000
FREQUENT = 4
#: How often each text is compared with one that stands for others, before all that are left are compared.
ROUNDS = 3
#: Longs that hold the parities of a set: bit i tells whether an odd number of its hashes is i modulo 64 x MARKS.
MARKS = 8
#: Overlap / union is 4 / 5 or more just if 9 x overlap is 4 x (sum of the sizes) or more.
_ENOUGH, _SIZES = 9, 4


def shingle_set(text: str | None, shingle: int):
    """The distinct 64-bit hashes (XXH64, seed 42) of a text's word shingles, ascending, as signed integers."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - shingle + 1)].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist() or [len(line)]
    return np.unique(np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8").view("<i8"))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """k and the whole set of each row of (k, text)."""

    def work(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            found = [shingle_set(t.as_py(), shingle) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["k", "all"])

    return texts.select("k", "text").mapInArrow(work, "k long, all array<long>")


def frequent_shingles(texts: DataFrame, shingle: int) -> list[int]:
    """Shingles of ``FREQUENT`` texts or more of a sample of about ``SAMPLE``."""
    span = 1 << 30
    share = min(span, span * SAMPLE // max(1, texts.count()) + 1)
    some = texts.where(F.pmod(F.xxhash64("k", F.lit(1)), F.lit(span)) < share)
    found = _sets(some, shingle).select(F.explode("all").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT)
    return [r.s for r in found.collect()]


def prefixes(texts: DataFrame, shingle: int) -> DataFrame:
    """k, s, place and n: each text under the shingles of its prefix, with their places and the size of its set."""
    import numpy as np

    sent = texts.sparkSession.sparkContext.broadcast(np.sort(np.array(frequent_shingles(texts, shingle), np.int64)))

    def work(parts: Iterator) -> Iterator:
        import pyarrow as pa

        last = sent.value
        for part in parts:
            firsts, sizes = [], []
            for t in part.column(1):
                own = shingle_set(t.as_py(), shingle)
                if len(last):
                    at = np.searchsorted(last, own)
                    own = own[np.argsort(last[np.minimum(at, len(last) - 1)] == own, kind="stable")]
                sizes.append(len(own))
                firsts.append(own[: len(own) - (4 * len(own) + 4) // 5 + 1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(firsts, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], ["k", "first", "n"])

    return texts.select("k", "text").mapInArrow(work, "k long, first array<long>, n int").select("k", "n", F.posexplode("first").alias("place", "s"))


def _marks(texts: DataFrame, shingle: int) -> DataFrame:
    """k, the size n, the parities m0, m1, ... of each text's set, and ``fine``: parities by twice to four times as many bits as the set has hashes."""

    def work(parts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in parts:
            longs, sizes, fine = np.zeros((len(part.column(1)), MARKS), "<i8"), [], []
            for i, t in enumerate(part.column(1)):
                own = shingle_set(t.as_py(), shingle)
                bits = max(64 * MARKS, 1 << (2 * len(own) - 1).bit_length())
                odd = np.bincount((own.view("<u8") & np.uint64(bits - 1)).view("<i8"), minlength=bits) & 1
                sizes.append(len(own))
                fine.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
                longs[i] = np.bitwise_xor.reduce(fine[-1].reshape(-1, MARKS), axis=0)
            columns = [part.column(0), pa.array(sizes, pa.int32()), *[pa.array(longs[:, i]) for i in range(MARKS)], pa.array(fine, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "n", *[f"m{i}" for i in range(MARKS)], "fine"])

    return texts.select("k", "text").mapInArrow(work, "k long, n int, " + ", ".join(f"m{i} long" for i in range(MARKS)) + ", fine array<long>")


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets have a similarity of 0.8 or more."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    sets = stored(_sets(texts.join(named, "k", "left_semi"), shingle), "shingle-sets")
    both = pairs.join(sets.toDF("b", "of_b"), "b").join(sets.toDF("a", "of_a"), "a")
    enough = _ENOUGH * F.size(F.array_intersect("of_a", "of_b")) >= _SIZES * (F.size("of_a") + F.size("of_b"))
    found = stored(both.where(enough).select("a", "b"), "links")
    forget(pairs.sparkSession, sets)
    release(pairs.sparkSession)
    return found


def _unlike(x: str, y: str):
    """In how many shingles two sets differ at least, by their parities."""
    return sum((F.bit_count(F.col(f"{x}.m{i}").bitwiseXOR(F.col(f"{y}.m{i}"))) for i in range(MARKS)), F.lit(0))


def _folded(fine):
    """Parities by half as many bits: bit i stands for i and i + half."""
    half = (F.size(fine) / 2).cast("int")
    return F.zip_with(F.slice(fine, 1, half), F.slice(fine, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def _unlike_finely(x: str, y: str):
    """Like ``_unlike``, by the fine parities; sets of sizes that ``_sized`` lets pass have as many, or one has twice those of the other."""
    p, q = F.col(f"{x}.fine"), F.col(f"{y}.fine")
    p, q = F.when(F.size(p) > F.size(q), _folded(p)).otherwise(p), F.when(F.size(q) > F.size(p), _folded(q)).otherwise(q)
    return F.aggregate(F.zip_with(p, q, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda total, v: total + v)


def _likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b), of sizes that ``_sized`` lets pass, without those that the parities rule out."""
    marks = marks.select("k", "n", "fine")
    x, y = marks.alias("x"), marks.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.k")).join(y, F.col("b") == F.col("y.k"))
    return both.where(_ENOUGH * _unlike_finely("x", "y") <= F.col("x.n") + F.col("y.n")).select("a", "b")


def _sized(n, m):
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _apart(known: DataFrame) -> DataFrame:
    """The rows of shingles under which texts of different components meet."""
    ends = known.groupBy("s").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("s")
    return known.join(ends, "s", "left_semi")


def _instead(old: DataFrame, new: DataFrame) -> DataFrame:
    """Store what was made of a stored table, and delete that."""
    kept = stored(new, "met")
    forget(new.sparkSession, old)
    release(new.sparkSession)
    return kept


def _by_fingerprint(texts: DataFrame, shingle: int) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints are equal or linked by SimHash; of equal ones, with one of them."""
    marked = stored(simhash.fingerprints(texts.withColumnRenamed("k", "doc_id"), shingle), "fingerprints").select(F.col("doc_id").alias("k"), "fp")
    one = stored(marked.groupBy("fp").agg(F.min("k").alias("one")), "distinct-fingerprints")
    met = simhash.links(one.select("fp"))
    met = met.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = marked.join(one, "fp").where("k <> one").select(F.col("one").alias("a"), F.col("k").alias("b"))
    return met.union(equal).distinct()


def links(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """Edges (a, b) that connect all of the distinct ``texts`` (k, text) that are linked at 0.8 or more."""
    tried = stored(_by_fingerprint(texts, shingle), "fingerprint-pairs")
    near = _alike(tried, texts, shingle)
    filed = stored(prefixes(texts, shingle), "prefixes")
    shared = filed.groupBy("s").agg(F.count("*").alias("_n")).where("_n > 1").select("s")  # most shingles are met once
    shared = stored(shared, "met-shingles")
    release(texts.sparkSession)
    met = stored(filed.join(shared, "s", "left_semi"), "met")
    forget(texts.sparkSession, filed, shared)
    release(texts.sparkSession)
    known = met.join(components(near).toDF("k", "c"), "k", "left").withColumn("c", F.coalesce("c", "k"))
    marks = stored(_marks(texts.join(met.select("k").distinct(), "k", "left_semi"), shingle), "marks")
    for turn in range(ROUNDS):
        known = _instead(met, _apart(known))
        met = known
        mark = F.struct(F.xxhash64("k", F.lit(turn)).alias("o"), "k", "n", "c")
        ends = known.groupBy("s").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"))
        pairs = known.join(ends, "s").select("k", "n", "c", F.explode(F.array("lo", "hi")).alias("end"))
        pairs = pairs.where((F.col("c") != F.col("end.c")) & _sized(F.col("n"), F.col("end.n"))).groupBy("k", F.col("end.k").alias("e")).agg(F.count("*").alias("m"))
        pairs = pairs.groupBy("k").agg(F.max_by("e", F.struct("m", "e")).alias("e")).select(F.least("k", "e").alias("a"), F.greatest("k", "e").alias("b")).distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "stars")
        found = _alike(stored(_likely(pairs, marks), "likely"), texts, shingle)
        near, tried = near.union(found), tried.union(pairs)
        roots = components(near)
        known = known.drop("c").join(roots.toDF("k", "c"), "k", "left").withColumn("c", F.coalesce("c", "k"))
    known = _instead(met, _apart(known))
    known = known.join(marks.drop("n", "fine"), "k")
    x, y = known.alias("x"), known.alias("y")
    most = F.least("x.place", "y.place") + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    fits = _sized(F.col("x.n"), F.col("y.n")) & (_ENOUGH * most >= _SIZES * (F.col("x.n") + F.col("y.n")))
    fits &= _ENOUGH * _unlike("x", "y") <= F.col("x.n") + F.col("y.n")  # the sets differ in as many shingles at least
    rest = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.k") < F.col("y.k")) & (F.col("x.c") != F.col("y.c")) & fits)
    rest = rest.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    last = _alike(stored(_likely(rest, marks), "rest"), texts, shingle)
    return near.union(last)


def first_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each class one with the least doc_id.

    Rows without an id stay only where their whole class has none. Equal rows of one key count once.
    """
    place, k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    given = docs.withColumn("_place", place).withColumn("_k", k)
    firsts = stored(given.groupBy("_k").agg(F.min("doc_id").alias("first"), F.min("_place").alias("_place")), "distinct-texts")
    one = given.join(firsts.select("_k", "_place"), ["_k", "_place"], "left_semi").dropDuplicates(["_k", "_place"])  # a text has one place here
    texts = stored(one.select(F.col("_k").alias("k"), F.col("text").cast("string").alias("text")), "texts")
    roots = components(links(texts, shingle))
    grouped = firsts.join(roots.toDF("_k", "root"), "_k", "left").withColumn("root", F.coalesce("root", "_k"))
    # the least id of the class; nulls only where there is no other
    stay = grouped.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "_k")).alias("m"))
    stay = stay.select(F.coalesce("m.first", F.lit(-(1 << 63))).alias("_place"), F.col("m._k").alias("_k"))
    return given.join(stay, ["_place", "_k"], "left_semi").dropDuplicates(["_place", "_k"]).select(*docs.columns)
