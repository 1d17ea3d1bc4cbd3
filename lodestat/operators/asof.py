"""As-of joins and split restatement.

The as-of join is a union and a last-value window, in two levels: a window
within (key, time bucket), and one over the last value of each bucket. A hot
key is spread over its buckets, and the outer window sees one row per bucket of
the calendar, so no task has to hold a whole key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRICE_MAX_AGE_DAYS = 45
SHARES_MAX_AGE_DAYS = 450


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
              payload: tuple, bucket: str = "year") -> DataFrame:
    """Left rows with the payload of the last right row at or before their time.
    The right side holds one row per (key, time)."""
    value = F.struct(F.col(right_time).alias("_at"), *payload)
    r = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
                     value.alias("_v"), F.lit(None).cast(_row_type(left)).alias("_row"))
    l = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
                    F.lit(None).cast(r.schema["_v"].dataType).alias("_v"),
                    F.struct(*left.columns).alias("_row"))
    rows = r.unionByName(l).withColumn("_b", F.trunc("_t", bucket))
    last = rows.groupBy(key, "_b").agg(F.max("_v").alias("_last"))
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(key, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    within = W.partitionBy(key, "_b").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    hit = rows.withColumn("_hit", F.last("_v", ignorenulls=True).over(within)).where("_side = 1")
    found = F.coalesce("_hit", "_carry")
    return hit.join(carry, [key, "_b"]).select(
        "_row.*", *[found[c].alias(c) for c in payload], found["_at"].alias(f"{right_time}_at"))


def _row_type(df: DataFrame):
    return df.schema


def split_table(splits: DataFrame) -> DataFrame:
    """Events per symbol as one sorted array (a company has few of them)."""
    return splits.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("day", "ratio"))).alias("events"))


def split_factor(events: Column, after: Column, until: Column | None = None) -> Column:
    """Product of the ratios strictly after a day (and not after ``until``)."""
    def counts(e):
        ok = (e["day"] > after) & (e["ratio"] > 0)
        return ok if until is None else ok & (e["day"] <= until)
    return F.coalesce(
        F.aggregate(F.filter(events, counts), F.lit(1.0), lambda acc, e: acc * e["ratio"]),
        F.lit(1.0))


def restate(observations: DataFrame, splits: DataFrame, value: str = "value",
            day: str = "end_day", key: str = "entity", until=None) -> DataFrame:
    """Observations in the share terms of the day ``until``: value times every later split
    that was known by then. Without a day, in the terms of the last split there is."""
    events = split_table(splits).withColumnRenamed("symbol", key)
    return (observations.join(events, key, "left")
            .withColumn(value, F.col(value) * split_factor(F.col("events"), F.col(day), None if until is None else F.lit(until).cast("date")))
            .drop("events"))


def market_cap(rows: DataFrame, splits: DataFrame, as_of, basis: Column) -> DataFrame:
    """Count times close in one share terms: raw prices take the splits between
    the observation and the date, today's-terms prices take all; a today's-terms
    price with no split history is flagged unverifiable."""
    day = F.lit(as_of).cast("date")
    r = rows.join(split_table(splits).withColumnRenamed("symbol", "entity"), "entity", "left")
    raw = basis == "raw"
    factor = F.when(raw, split_factor(F.col("events"), F.col("shares_day"), day)).otherwise(
        split_factor(F.col("events"), F.col("shares_day")))
    return r.select(*rows.columns, (F.col("shares") * factor * F.col("price")).alias("market_cap"),
                    (~raw & F.col("events").isNull() & F.col("shares").isNotNull()
                     & F.col("price").isNotNull()).alias("split_unverified"))


def latest_at(rows: DataFrame, key, day: str, as_of, payload: tuple) -> DataFrame:
    """Last row per key at or before one date: a plain aggregate, no window."""
    keys = [key] if isinstance(key, str) else list(key)
    return (rows.where(F.col(day) <= F.lit(as_of).cast("date"))
            .groupBy(*keys).agg(F.max_by(F.struct(F.col(day), *payload), F.col(day)).alias("w"))
            .select(*keys, F.col(f"w.{day}"), *[F.col(f"w.{c}") for c in payload]))
