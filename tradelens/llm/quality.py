"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base counts are taken from the whole text of every document. Those that pass the base rules get a
vector of transformed statistics. Per language and source, the minimum-covariance-determinant estimate
is found from several starts by concentration steps (keep the share of rows nearest to the present
estimate, estimate again) until no determinant falls any more; of the starts, the estimate with the
lowest determinant holds. A document is rejected if its Mahalanobis distance is beyond the cutoff.

The same is done per language and over all rows, and a group's estimate is drawn towards that of its
language, and that one's towards that of all rows, the more the fewer rows it has: by n / (n + prior).

Everything per group is a sum over rows or a count of histogram cells, pre-aggregated before each
shuffle, so a source with a third of all rows is spread over all tasks; a window over a group sees its
cells, of which there are some thousands at most. Quantiles come from cells of fixed width, not from
samples or sketches. Statistics are scaled so that the number of words does not by itself make a
document odd.

Nulls: a null text has no words and fails the base rules. Null lang and source form groups of their
own. Ties do not matter: equal distances share a cell. Repeated rows are judged alike, very long texts
read whole; an empty table gives no rows. Further columns are carried if asked for.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import native_words, stored

GROUP = ["_lang", "_source"]
#: A group on its level: 0 for a language and source, 1 for a language, 2 for all rows.
KEY = ["_level", *GROUP]
#: Stands for all languages or sources.
ALL = "\1"
#: The transformed statistics, in order.
STATS = ["word_length", "symbols", "dup_lines", "repeats"]
#: Cells of the histograms: of a statistic, and of the logarithm of a squared distance.
STAT_CELL, DISTANCE_CELL = 1 / 128, 1 / 32


def base_counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("_source"),
        F.struct(F.lit(0).alias("_"), *carry).alias("_row"),
        text.alias("_text"),
        native_words(F.col("text").cast("string")).alias("_words"),
    )
    words, n = F.col("_words"), F.size("_words")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    row = row.select(
        "doc_id",
        *GROUP,
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_windows"),
    )
    # only a text with a repeated window is sorted: (hash, place) pairs, so that equal hashes are neighbours
    pairs = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    row = row.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("_pairs", pairs).drop("_lines", "_windows")
    twice = F.filter("_pairs", lambda x, k: (x.h == F.get("_pairs", k - 1).h) | (x.h == F.get("_pairs", k + 1).h))
    row = row.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x.i))).drop("_pairs")
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct((a.n + F.least(F.lit(5), i - a.last)).alias("n"), i.alias("last")), lambda a: a.n)
    row = row.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return row.withColumn("base_failed", failed)


def statistics(n_words="n_words") -> dict[str, Column]:
    """Before centring. The mean word length is centred by group and grows steadier with the words it averages."""
    n = F.col(n_words)
    return {
        "word_length": F.log(F.try_divide(F.col("word_chars"), n)),
        "symbols": F.sqrt(F.col("n_symbols") / (n + 20)),
        "dup_lines": F.sqrt(10 * F.col("n_dup_lines") / (n + 50)),
        "repeats": F.sqrt(F.col("n_repeat_words") / (n + 20)),
    }


def _quantile(table: DataFrame, key: list[str], cell: str, shares: dict[str, float]) -> DataFrame:
    """Per key, for each share the least cell with so many rows at or below it. table: (key, cell, n)."""
    up = Window.partitionBy(*key).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*key)
    held = table.withColumn("_up", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(every))
    return held.groupBy(*key).agg(*[F.min(F.when(F.col("_up") >= share * F.col("_all"), F.col(cell))).alias(name) for name, share in shares.items()], F.max("_all").alias("_all"))


def _cholesky(cov) -> dict[tuple[int, int], Column]:
    """Lower factor of a symmetric matrix of columns."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(len(STATS)):
        for j in range(i + 1):
            rest = cov(i, j) - reduce(lambda a, k: a + low[i, k] * low[j, k], range(j), F.lit(0.0))
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / low[j, j]
    return low


def _distance(point: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution, with columns m0.., l00.. beside the point's."""
    solved: list[Column] = []
    for i, x in enumerate(point):
        rest = x - F.col(f"m{i}")
        for k, y in enumerate(solved):
            rest = rest - F.col(f"l{i}{k}") * y
        solved.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, y: a + y * y, solved, F.lit(0.0))


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def consistency(support: float, dof: int = len(STATS)) -> float:
    """By how much the covariance of the nearest ``support`` of normal rows is too small."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < support else (lo, mid)
    return support / chi2_cdf(lo, dof + 2)


def _points(df: DataFrame) -> DataFrame:
    """Add the statistics x0, x1, ...; the word length less its group's centre ``c0``."""
    values = statistics()
    values["word_length"] = (values["word_length"] - F.col("c0")) * F.sqrt(F.least(F.col("n_words"), F.lit(400))) / 10
    return df.withColumns({f"x{i}": c for i, c in enumerate(values.values())})


NUMBERS = range(len(STATS))
PAIRS = [(i, j) for i in NUMBERS for j in range(i + 1)]
#: Least standard deviations of the statistics: most documents have no symbols at all, and one repeated line is no fault.
FLOORS = (0.06, 0.06, 0.12, 0.12)
#: Concentration ends when no determinant falls by more than this share.
SETTLED = 0.01


def _moments(rows: DataFrame, key: list[str], scale: float, floors: tuple[float, ...]) -> DataFrame:
    """Means m0.., covariances v00.. and the logarithm of the determinant per key."""
    sums = rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in NUMBERS], *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS])
    cov = [((F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale + F.lit(floors[i] ** 2 if i == j else 0.0)).alias(f"v{i}{j}") for i, j in PAIRS]
    return _with_determinant(sums.select(*key, *[f"m{i}" for i in NUMBERS], *cov))


def _factor() -> dict[tuple[int, int], Column]:
    return _cholesky(lambda i, j: F.col(f"v{i}{j}"))


def _with_determinant(df: DataFrame) -> DataFrame:
    low = _factor()
    return df.withColumn("logdet", reduce(lambda a, i: a + 2 * F.log(low[i, i]), NUMBERS, F.lit(0.0)))


def _factored(df: DataFrame) -> DataFrame:
    return df.withColumns({f"l{i}{j}": c for (i, j), c in _factor().items()})


def _of_groups(df: DataFrame, label: str) -> DataFrame:
    """Store a table of a few rows for each group in fewer files than partitions: its size then says that it is small."""
    return stored(df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)), label)


def estimates(counted: DataFrame, support: float = 0.75, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Per key: n_group, c0, the means, covariances and log determinant of the best start. ``counted`` must be stored.

    Starts: the medians with a small scale, which outliers cannot move; the medians with the spread of
    the middle half; the mean and covariance of all rows. A group takes further steps while one of its
    starts falls below its lowest determinant so far; determinants have a floor, so that ends. What other
    groups do has no part in it, and a group that has settled takes no part in later steps.
    """
    raw = statistics()
    levels = [F.struct(F.lit(0).alias("_level"), *GROUP), F.struct(F.lit(1).alias("_level"), F.col("_lang"), F.lit(ALL).alias("_source")), F.struct(F.lit(2).alias("_level"), F.lit(ALL).alias("_lang"), F.lit(ALL).alias("_source"))]
    passing = counted.where(~F.col("base_failed")).withColumn("_key", F.explode(F.array(*levels))).select("_key.*", *COUNTS)
    cells = passing.select(*KEY, F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.floor(c / STAT_CELL).cast("long").alias("cell")) for i, c in enumerate(raw.values())])).alias("x"))
    cells = cells.select(*KEY, "x.*").groupBy(*KEY, "s", "cell").agg(F.count("*").alias("n"))
    marks = _quantile(cells, [*KEY, "s"], "cell", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    of = lambda i, c: F.max(F.when(F.col("s") == i, c))
    centres = marks.groupBy(*KEY).agg(F.max("_all").alias("n_group"), *[of(i, (F.col("q2") + 0.5) * STAT_CELL).alias(f"c{i}") for i in NUMBERS], *[of(i, (F.col("q3") - F.col("q1")) * STAT_CELL / 1.349).alias(f"w{i}") for i in NUMBERS])
    centres = _of_groups(centres, "centres")

    vectors = stored(_points(passing.join(centres.select(*KEY, "c0"), KEY)).select(*KEY, *[f"x{i}" for i in NUMBERS]), "vectors")
    medians = [F.lit(0.0).alias("m0"), *[F.col(f"c{i}").alias(f"m{i}") for i in NUMBERS[1:]]]
    at = lambda start, spread: centres.select(*KEY, F.lit(start).alias("_start"), *medians, *[(spread(i) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in PAIRS])
    narrow = at(0, lambda i: F.lit((3 * floors[i]) ** 2))
    middle = at(1, lambda i: F.pow(F.greatest(F.col(f"w{i}"), F.lit(floors[i])), 2))
    whole = _moments(vectors, KEY, 1.0, floors).withColumn("_start", F.lit(2))
    now = _of_groups(_with_determinant(narrow.unionByName(middle)).unionByName(whole.select(*KEY, "_start", *[f"m{i}" for i in NUMBERS], *[f"v{i}{j}" for i, j in PAIRS], "logdet")), "estimate")

    scale, each = consistency(support, len(raw)), [*KEY, "_start"]
    now, settled, first = now.withColumn("_low", F.col("logdet")), [], True
    while True:
        placed = vectors.join(_factored(now).select(*each, *[f"m{i}" for i in NUMBERS], *[f"l{i}{j}" for i, j in PAIRS]), KEY)
        placed = placed.withColumn("cell", F.floor(F.log(_distance([F.col(f"x{i}") for i in NUMBERS]) + 1e-9) / DISTANCE_CELL).cast("long")).select(*each, "cell", *[f"x{i}" for i in NUMBERS])
        bound = _of_groups(_quantile(placed.groupBy(*each, "cell").agg(F.count("*").alias("n")), each, "cell", {"bound": support}).drop("_all"), "bound")
        new = _moments(placed.join(bound, each).where("cell <= bound"), each, scale, floors).join(now.select(*each, "_low"), each)
        falls = F.max(F.col("logdet") < F.col("_low") - SETTLED).over(Window.partitionBy(*KEY))  # three rows each
        new = _of_groups(new.withColumn("_on", falls | F.lit(first)).withColumn("_low", F.least("_low", "logdet")), "estimate")
        settled.append(new.where(~F.col("_on")).drop("_on", "_low"))
        now, first = new.where("_on").drop("_on"), False
        if now.isEmpty():
            break
    now = reduce(DataFrame.unionByName, settled)
    best = now.groupBy(*KEY).agg(F.min_by(F.struct(*[c for c in now.columns if c not in KEY]), F.struct("logdet", "_start")).alias("b"))
    return centres.select(*KEY, "n_group", "c0").join(best, KEY).select(*KEY, "n_group", "c0", "b.*").drop("_start")


def drawn_together(found: DataFrame, prior: int) -> DataFrame:
    """Per language and source: c0, means and Cholesky factor, drawn towards the language's, and that towards all rows'."""
    numbers = ["c0", *[f"m{i}" for i in NUMBERS], *[f"v{i}{j}" for i, j in PAIRS]]
    weight = lambda n: F.col(n) / (F.col(n) + prior)

    def level(k: int, name: str) -> DataFrame:
        return found.where(F.col("_level") == k).select(*GROUP[: 2 - k], F.col("n_group").alias(f"n_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in numbers])

    every = level(2, "all").withColumn("_one", F.lit(1))
    of_lang = level(1, "lang").withColumn("_one", F.lit(1)).join(every, "_one").drop("_one")  # one row on the right
    rows = level(0, "own").join(of_lang, "_lang")
    mixed = {c: weight("n_own") * F.col(f"{c}_own") + (1 - weight("n_own")) * (weight("n_lang") * F.col(f"{c}_lang") + (1 - weight("n_lang")) * F.col(f"{c}_all")) for c in numbers}
    return _factored(rows.select(*GROUP, *[x.alias(c) for c, x in mixed.items()])).select(*GROUP, "c0", *[f"m{i}" for i in NUMBERS], *[f"l{i}{j}" for i, j in PAIRS])


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, carry: tuple[str, ...] = (), cutoff: float = 32.0, prior: int = 50, **parameters) -> DataFrame:
    """Base counts, base_failed, the squared distance and the verdict of every row, and the columns in ``carry``.

    ``cutoff`` is the largest squared distance that stays: with four statistics one normal row in half
    a million is beyond 32. The counts are stored: what follows reads them several times, and the
    optimizer must not push a filter on the verdict into the counting.
    """
    counted = stored(base_counts(docs, carry), "counts")
    shapes = _of_groups(drawn_together(estimates(counted, **parameters), prior), "shapes")
    rows = _points(counted.join(shapes, GROUP, "left"))
    rows = rows.withColumn("distance", F.when(~F.col("base_failed"), _distance([F.col(f"x{i}") for i in NUMBERS])))
    rows = rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    return rows.select("doc_id", *COUNTS, "base_failed", "distance", "kept", *[F.col(f"_row.{c}").alias(c) for c in carry])


def passing(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that stay. The verdicts are found without the texts and meet them by a hash of all that they depend on."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("text", "lang", "source")]
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", *parts))
    stay = judge(keyed, carry=("_key",), **parameters).where("kept").select("_key").distinct()
    return keyed.join(stay, "_key", "left_semi").drop("_key")
