"""Exact quantiles of groups of any size, by distributed selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.plans.shared import stored

#: Cells of a histogram, and the rows of a cell from which on it is divided again.
CELLS, SMALL = 1024, 100_000


def _same(left: DataFrame, right: DataFrame, keys: list[str], extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's key columns go."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + ([] if extra is None else [extra])
    return left.join(other, reduce(Column.__and__, on), how).drop(*[f"_r_{k}" for k in keys])


def exact(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], cells: int = CELLS, small: int = SMALL) -> DataFrame:
    """Per group the quantiles named in ``shares``, interpolated linearly between neighbours in rank.

    A quantile lies between two ranks. The range that holds a rank is cut into ``cells`` cells, whose counts
    (partial sums before the shuffle) say which cell has it; that cell's least and largest value are the next
    range, until it holds no more than ``small`` rows or one value. Only the rows of such cells are sorted, each
    cell by itself, so no task and no state ever holds a large group. Nulls take no part; a group without
    values has null quantiles; NaN is larger than any number and is left out of the cells with infinities.
    """
    rows = stored(df.select(*keys, F.col(value).cast("double").alias("_v")), "values")
    finite = (F.abs("_v") < float("inf")) & ~F.isnan("_v")
    groups = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.count_if(F.col("_v") == float("-inf")).alias("_low"), F.count_if(finite).alias("_mid"), F.min(F.when(finite, F.col("_v"))).alias("_lo"), F.max(F.when(finite, F.col("_v"))).alias("_hi"), F.count_if(F.col("_v") == float("inf")).alias("_inf"))
    groups = stored(groups, "groups")
    at = {name: (F.col("_n") - 1) * F.lit(q) for name, q in shares.items()}
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at.values()])))
    ranks = groups.where("_n > 0").select(*keys, F.explode(wanted).alias("_rank"), "_low", "_mid", "_lo", "_hi", "_inf")
    odd = F.when(F.col("_rank") < F.col("_low"), float("-inf")).when(F.col("_rank") >= F.col("_low") + F.col("_mid") + F.col("_inf"), float("nan")).when(F.col("_rank") >= F.col("_low") + F.col("_mid"), float("inf"))
    # _below: rows of the group below the range _lo to _hi; _in: rows in it
    open_ranks = ranks.select(*keys, "_rank", F.col("_low").alias("_below"), F.col("_mid").alias("_in"), "_lo", "_hi", odd.alias("_value"))
    open_ranks, done = stored(open_ranks, "ranks"), []
    rows = rows.where(finite)
    while True:
        settled = F.col("_value").isNotNull() | (F.col("_in") <= small) | (F.col("_lo") == F.col("_hi"))
        done.append(open_ranks.where(settled))
        now = open_ranks.where(~settled)
        if now.isEmpty():
            break
        ranges = now.select(*keys, "_lo", "_hi", "_below").distinct()
        inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        # halves first: the whole width may overflow
        place = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * cells), F.lit(cells - 1))
        counted = _same(rows, ranges, keys, inside).groupBy(*keys, "_lo", "_hi", "_below", place.alias("_cell")).agg(F.count("*").alias("_in"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        up = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("_end", F.col("_below") + F.sum("_in").over(up)).select(*keys, F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), "_in", "_least", "_most", "_end")
        hit = (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h")) & (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_in"))
        narrowed = _same(now.select(*keys, "_rank", "_lo", "_hi"), counted, keys, hit)
        open_ranks = stored(narrowed.select(*keys, "_rank", (F.col("_end") - F.col("_in")).alias("_below"), "_in", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.lit(None).cast("double").alias("_value")), "ranks")
    found = reduce(DataFrame.unionByName, done)
    known = found.withColumn("_value", F.when(F.col("_value").isNull() & (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise(F.col("_value")))
    left = known.where("_value IS NULL")
    ranges = left.select(*keys, "_lo", "_hi", "_below").distinct()
    order = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_v")
    sorted_rows = _same(rows, ranges, keys, (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).withColumn("_at", F.row_number().over(order) - 1 + F.col("_below")).select(*keys, F.col("_lo").alias("_l"), F.col("_at"), F.col("_v").alias("_value"))
    picked = _same(left.drop("_value"), sorted_rows, keys, (F.col("_lo") == F.col("_l")) & (F.col("_rank") == F.col("_at")))
    values = known.where("_value IS NOT NULL").select(*keys, "_rank", "_value").unionByName(picked.select(*keys, "_rank", "_value"))
    held = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_values"))
    out = _same(groups, held, keys, how="left")

    def between(p: Column) -> Column:
        lo, hi = F.get(F.map_values(F.map_filter("_values", lambda k, _: k == F.floor(p))), F.lit(0)), F.get(F.map_values(F.map_filter("_values", lambda k, _: k == F.ceil(p))), F.lit(0))
        return F.when(F.floor(p) == F.ceil(p), lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return out.select(*keys, *[between(p).alias(name) for name, p in at.items()])

