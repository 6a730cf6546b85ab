"""Exact percentiles by distributed selection, and mergeable sketches.

Spark's exact ``percentile`` keeps one value -> count map per group, which ends
in one task and grows with the group's distinct values. Here the values are
counted per (group, value) by a hash aggregation, and the wanted ranks are
searched in them: ``BUCKETS`` equal ranges of the group's values are counted,
the range that holds a rank is cut into ``BUCKETS`` ranges again, and only the
values of that last range are put in order. No map grows with the values, and
no window holds more than ``BUCKETS`` rows or the values of one such range.

The definition is the one of ``percentile``: linear interpolation between the
two nearest ranks. Nulls and NaN take no part; a group without values has no row.

For streams and stored aggregates there is the mergeable form: a KLL sketch per
group and time bucket, merged over buckets. Its size depends on ``k`` alone, its
rank error is at most 0.55 % at k = 500 with 99 % confidence (:func:`rank_error`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
SHARES = (0.5, 0.95, 0.99)
#: Size of a sketch.
KLL_K = 500


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's copies are dropped."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], how).drop(*[f"_k_{k}" for k in keys])


def _place(v, low, high):
    """Which of the ranges from ``low`` to ``high`` holds the value; never falls as the value grows."""
    return F.when(F.col(high) > F.col(low), F.least(F.lit(BUCKETS - 1), F.floor((v / 2 - F.col(low) / 2) / (F.col(high) / 2 - F.col(low) / 2) * BUCKETS)))\
        .otherwise(F.lit(0)).cast("long")


def _narrow(counts: DataFrame, wanted: DataFrame, keys: list[str], bucket: str) -> tuple[DataFrame, DataFrame]:
    """One step: values with their range ``bucket``, and the wanted ranks with the range that holds each.

    ``counts``: keys, v, c, _low, _high. ``wanted``: keys, rank, left (the rank within the keys' values)."""
    cut = counts.withColumn(bucket, _place(F.col("v"), "_low", "_high")).drop("_low", "_high")
    totals = cut.groupBy(*keys, bucket).agg(F.sum("c").alias("_c"), F.min("v").alias("_low"), F.max("v").alias("_high"))
    upto = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    found = _joined(wanted, totals, keys).where((F.col("left") >= F.col("_before")) & (F.col("left") < F.col("_before") + F.col("_c")))
    found = found.withColumn("left", F.col("left") - F.col("_before")).drop("_before", "_c")
    return cut, found


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = SHARES, into: str = "percentiles") -> DataFrame:
    """(keys, n, ``into``): the number of values and the array of exact percentiles, a row per group. One group or more keys."""
    if not keys:
        one = rows.withColumn("_all", F.lit(0))
        return percentiles(one, ["_all"], value, shares, into).drop("_all")
    counts = (rows.select(*keys, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
              .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")))
    groups = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("_low"), F.max("v").alias("_high"))
    at = [(F.col("n") - 1) * F.lit(p) for p in shares]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    wanted = groups.select(*keys, F.explode(ranks).alias("rank")).withColumn("left", F.col("rank"))
    first, found = _narrow(_joined(counts, groups.drop("n"), keys), wanted, keys, "_b1")
    ranges = found.select(*keys, "_b1", "_low", "_high").distinct()
    inner = [*keys, "_b1"]
    second, found = _narrow(_joined(first, ranges, inner), found.drop("_low", "_high"), inner, "_b2")
    last = [*inner, "_b2"]
    few = _joined(second, found.select(*last).distinct(), last)
    upto = Window.partitionBy(*last).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    few = few.withColumn("_before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    hit = _joined(found.select(*last, "rank", "left"), few, last).where((F.col("left") >= F.col("_before")) & (F.col("left") < F.col("_before") + F.col("c")))
    # at most two ranks a share
    by_rank = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_v"))
    out = _joined(groups.select(*keys, "n"), by_rank, keys)

    def value_at(x):
        low, high = F.col("_v")[F.floor(x).cast("long")], F.col("_v")[F.ceil(x).cast("long")]
        return F.when(F.floor(x) == F.ceil(x), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)
    return out.select(*keys, "n", F.array(*[value_at(x) for x in at]).alias(into))


def sketches(rows: DataFrame, keys: list, value: str, k: int = KLL_K, into: str = "sketch") -> DataFrame:
    """(keys, ``into``): a KLL sketch (binary) per group; a streaming DataFrame works as well."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias(into))


def merged_sketches(stored: DataFrame, keys: list, k: int = KLL_K, sketch: str = "sketch") -> DataFrame:
    return stored.groupBy(*keys).agg(F.kll_merge_agg_double(sketch, F.lit(k)).alias(sketch))


def from_sketches(stored: DataFrame, shares: tuple[float, ...] = SHARES, sketch: str = "sketch", into: str = "percentiles") -> DataFrame:
    """Adds the estimated percentiles of each sketch."""
    return stored.withColumn(into, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(p) for p in shares])))


def rank_error(k: int = KLL_K) -> float:
    """Bound of a KLL sketch's rank error (99 % confidence, a single rank), by its authors' fit."""
    return 2.296 / math.pow(k, 0.9723)
