"""Ticks, forward returns, ranked cohorts, turnover and equal-weight results.

Cohorts of a tick grow with the universe, so full rankings are distributed
(``ranks``), top-n rankings use a row number with a limit (cut before the
shuffle), and "the rest" is the total less the top."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat.operators import asof, ranks, series


def forward_returns(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, tick, next_tick, fwd, alive, close) where a price exists at the tick."""
    t = series.following(ticks)
    life = bars.groupBy("symbol").agg(F.max("day").alias("_last"))
    calendar = t.agg(F.array_sort(F.collect_list(F.struct("tick", "next_tick")))).scalar()   # one row per quarter
    per = life.withColumn("_ticks", calendar).select("symbol", "_last", F.explode("_ticks").alias("t")).select(
        "symbol", F.col("t.tick").alias("tick"), F.col("t.next_tick").alias("next_tick"), (F.col("_last") >= F.col("t.tick")).alias("alive"))
    at = asof.asof_join(per, bars, "symbol", "tick", "day", ("adj_close", "close"))
    w = W.partitionBy("symbol").orderBy("tick")
    nxt = F.lead("adj_close").over(w)
    fwd = F.when(F.col("adj_close") > 0, nxt / F.col("adj_close") - 1.0)
    return at.select("symbol", "tick", "next_tick", "alive", "close", fwd.alias("fwd"))


def rank_order(rows: DataFrame, groups: list, value: str, tie: str, out: str = "rank") -> DataFrame:
    """Exact 1-based order by value descending, then tie ascending, in groups of any
    size: ranks of the values, then ranks of the tie key inside equal values."""
    v = ranks.value_ranks(rows, groups, value).select(*groups, value, "n_lt", (F.col("n") - F.col("n_le")).alias("_above"), (F.col("n_le") - F.col("n_lt")).alias("_equal"))
    j = rows.join(v.drop("n_lt"), [*groups, value])
    single = j.where("_equal = 1").withColumn("_before", F.lit(0).cast("long"))       # nearly all rows
    ties = j.where("_equal > 1")
    t = ranks.text_ranks(ties, [*groups, value], tie).select(*groups, value, tie, F.col("n_lt").alias("_before"))
    tied = ties.join(t, [*groups, value, tie]).select(*single.columns)
    return (single.unionByName(tied)
            .withColumn(out, F.col("_above") + F.col("_before") + 1).drop("_above", "_before", "_equal"))


def top_per_group(rows: DataFrame, groups: list, order: list, k: int, out: str = "rank") -> DataFrame:
    """Top k per group; Spark cuts each group to k rows before the shuffle."""
    w = W.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def bucket_returns(ranked_top: DataFrame, totals: DataFrame, edges: tuple) -> DataFrame:
    """(tick, bucket, mean) for rank buckets with an open last bucket. The top
    buckets come from the ranked rows, the open one from totals less the top."""
    label = F.lit(None).cast("string")
    for name, lo, hi in edges[:-1]:
        label = F.when(F.col("rank").between(lo, hi), name).otherwise(label)
    top = (ranked_top.where("fwd IS NOT NULL").groupBy("tick", label.alias("bucket"))
           .agg(F.sum("fwd").alias("s"), F.count("fwd").alias("n")))
    used = top.groupBy("tick").agg(F.sum("s").alias("us"), F.sum("n").alias("un"))
    rest = totals.join(used, "tick", "left").select(
        "tick", F.lit(edges[-1][0]).alias("bucket"), (F.col("s") - F.coalesce("us", F.lit(0.0))).alias("s"),
        (F.col("n") - F.coalesce("un", F.lit(0))).alias("n")).where("n > 0")
    return top.unionByName(rest).select("tick", "bucket", (F.col("s") / F.col("n")).alias("mean"))


def weight_changes(holdings: DataFrame, ticks: DataFrame) -> DataFrame:
    """Turnover per tick: the sum of absolute weight changes against the drifted
    previous weights. holdings: (tick, symbol, weight, fwd). (tick, turnover)"""
    t = series.following(ticks)
    growth = holdings.groupBy("tick").agg((1.0 + F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0)))).alias("factor"))
    drifted = (holdings.join(growth, "tick").join(t, "tick").where("factor > 0 AND next_tick IS NOT NULL")
               .select(F.col("next_tick").alias("tick"), "symbol",
                       (F.col("weight") * (1.0 + F.coalesce("fwd", F.lit(0.0))) / F.col("factor")).alias("old")))
    both = holdings.select("tick", "symbol", F.col("weight").alias("new")).join(drifted, ["tick", "symbol"], "full_outer")
    return both.groupBy("tick").agg(F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("turnover"))


# fixed values: tiers in reading order, and the tier whose top grade is always listed
TIERS = ("Core", "Adjacent", "Outside")
STAR_TIER, STAR_GRADE = "Outside", "A"


def tier_shortlist(graded: DataFrame, per_tier: int) -> DataFrame:
    """(entity, tier, grade, composite, star): the best of each tier by composite, then entity, and every name of the top grade in
    the outside tier past that cut (a star). Names without a letter grade and composite are left out."""
    eligible = graded.where(F.col("grade").isin("A", "B", "C", "D", "F") & F.col("composite").isNotNull()).select("entity", "tier", "grade", "composite")
    top = top_per_group(eligible, ["tier"], [F.desc("composite"), "entity"], per_tier).drop("rank").withColumn("star", F.lit(False))
    stars = eligible.where((F.col("tier") == STAR_TIER) & (F.col("grade") == STAR_GRADE)).withColumn("star", F.lit(True))
    return top.unionByName(stars).groupBy("entity", "tier", "grade", "composite").agg(F.bool_and("star").alias("star"))
