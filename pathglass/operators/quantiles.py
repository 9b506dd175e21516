"""Exact nearest-rank percentiles of large groups (AGG14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _coarse(value: Column) -> Column:
    """A bucket number that rises with the value: its length in bits and the six bits behind the first."""
    v = F.greatest(value, F.lit(0).cast("long"))
    bits = F.length(F.ltrim(F.bin(v), F.lit("0")))
    head = F.conv(F.rpad(F.substring(F.ltrim(F.bin(v), F.lit("0")), 1, 7), 7, "0"), 2, 10).cast("int")
    return F.when(v == 0, F.lit(0)).otherwise(bits * 128 + head)


def nearest_ranks(rows: DataFrame, key: str, percents: tuple[int, ...]) -> DataFrame:
    """(key, p50, ...) of ``value``, a non-negative long: the value at rank ceil(p * n / 100).

    Two counting rounds instead of a list for each group: a histogram of at most a few
    thousand buckets tells which bucket holds a rank and how many values lie below
    it, then the distinct values of these buckets are counted. Both combine before
    the shuffle, so a hot group costs its distinct values and not its rows. Nulls are
    ignored; a group without values has no row.
    """
    values = rows.filter("value is not null").select(F.col(key), "value", _coarse(F.col("value")).alias("bucket"))
    counts = values.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(key).orderBy("bucket")
    buckets = counts.withColumn("last", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    ranked = buckets.withColumn("p", F.explode(F.array(*(F.lit(p) for p in percents)))).withColumn("rank", F.expr("(p * total + 99) div 100"))
    chosen = ranked.filter((F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("n")))
    chosen = chosen.select(key, "bucket", "p", (F.col("rank") - F.col("last") + F.col("n")).alias("rank"))
    fine = values.join(chosen.select(key, "bucket").distinct(), [key, "bucket"], "left_semi").groupBy(key, "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    fine = fine.withColumn("last", F.sum("n").over(Window.partitionBy(key, "bucket").orderBy("value")))
    hit = fine.join(chosen, [key, "bucket"]).filter((F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("n")))
    return hit.groupBy(key).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in percents))
