"""Ordered work over keys of any size, in two levels.

A key's rows are cut into chunks (a day, say). Windows run inside a chunk, and
one row per chunk carries the state on to the next. A key that holds most of
the input is thus spread over its chunks."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lag_in_chunks(df: DataFrame, keys: list, chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Previous value in (keys) order."""
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    last = df.groupBy(*keys, chunk).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carry = last.select(*keys, chunk, F.lag("_last").over(W.partitionBy(*keys).orderBy(chunk)).alias("_carry"))
    own = F.lag(F.struct(F.col(value).alias("v"))).over(inside)
    return (df.withColumn("_own", own).join(carry, [*keys, chunk])
            .withColumn(out, F.coalesce("_own", "_carry")["v"]).drop("_own", "_carry"))


def running_sum_in_chunks(df: DataFrame, keys: list, chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of the values strictly before each row in (keys) order."""
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_t"))
    offsets = totals.select(*keys, chunk, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return df.withColumn("_own", own).join(offsets, [*keys, chunk]).withColumn(out, F.col("_own") + F.col("_offset")).drop("_own", "_offset")
