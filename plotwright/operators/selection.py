"""Exact medians and percentiles of groups of any size, in bounded memory.

A rank is looked for in an interval of values. The interval is cut into bins, the bins are counted, and the bin that
holds the rank, from its least to its greatest value, is the next interval: counts alone are shuffled, a row a bin.
Once an interval holds few values, these are sorted, and its ranks are read off. All groups and ranks are narrowed
together, a pass over the values a round; a round divides an interval by the number of bins at least.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwright.tables import written

#: Bins of an interval, and values of one that are sorted in one row.
BINS, FEW = 4096, 10_000
#: Intervals up to which they are sent to every task; more are joined by a shuffle.
SENT = 100_000


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str], bins: int = BINS, few: int = FEW) -> DataFrame:
    """by, and a column a share (0 to 1): the value at that share of the ranks of its group, between two ranks by linear interpolation.

    Nulls do not count, and a group without values has no row; values are finite. rows is read once a round: a table, or cheap.
    """
    by = list(by)
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    whole = written(own.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")), "ranges")
    if not whole.where((F.col("n") > few) & (F.col("a") < F.col("b"))).limit(1).count():  # then a buffer of one group's values is small
        return own.groupBy(by).agg(*[F.percentile("v", F.lit(float(s))).alias(name) for s, name in zip(shares, names)])
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(s)) * (F.col("n") - 1)).alias("at")) for k, s in enumerate(shares)]))
    rank = F.explode(F.array_distinct(F.array(F.floor("p.at"), F.ceil("p.at"))))
    wanted = written(whole.withColumn("p", at).withColumn("rank", rank).select(*by, "p.k", "p.at", "rank"), "wanted")
    open_ = wanted.select(*by, "rank").distinct().join(whole, by).select(*by, "rank", "a", "b", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    open_, done = written(open_, "intervals"), None
    span = [*by, "a", "b"]

    def met(intervals: DataFrame, n: int) -> DataFrame:
        each = intervals.select(span).distinct()
        return own.join(F.broadcast(each) if n <= SENT else each, by).where(F.col("v").between(F.col("a"), F.col("b")))

    while True:
        settled = (F.col("a") == F.col("b")) | (F.col("inside") <= few)
        part = open_.where(settled)
        done = part if done is None else done.unionByName(part)
        live = open_.where(~settled)
        n = live.count()
        if not n:
            break
        place = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
        counted = met(live, n).groupBy(*span, place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = Window.partitionBy(span).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        summed = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        found = live.join(summed, span).withColumn("left", F.col("rank") - F.col("below") - F.col("before")).where("left >= 0 and left < n")
        open_ = written(found.select(*by, "rank", F.col("lo").alias("a"), F.col("hi").alias("b"), (F.col("below") + F.col("before")).alias("below"), F.col("n").alias("inside")), "intervals")
    done = written(done, "intervals")
    several = done.where("a < b")
    n = several.count()
    single = done.where("a = b").select(*by, "rank", F.col("a").alias("value"))
    if n:
        sorted_ = met(several, n).groupBy(span).agg(F.array_sort(F.collect_list("v")).alias("vs"))
        single = single.unionByName(several.join(sorted_, span).select(*by, "rank", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value")))
    ends = wanted.join(single, [*by, "rank"]).groupBy(*by, "k", "at").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.min_by("value", "rank").alias("u"), F.max_by("value", "rank").alias("w"))
    between = F.when(F.col("low") == F.col("high"), F.col("u")).otherwise((F.col("high") - F.col("at")) * F.col("u") + (F.col("at") - F.col("low")) * F.col("w"))
    return ends.groupBy(by).agg(*[F.max(F.when(F.col("k") == k, between)).alias(name) for k, name in enumerate(names)])


def with_percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], others: DataFrame) -> DataFrame:
    """others, a row a group, with a column for each share; null for groups without values."""
    return others.join(percentiles(rows, by, value, list(shares.values()), list(shares)), list(by), "left")
