"""Site tables of two runs of the grading: one row per name with its ranks and what the second run gained, and the coverage of every
metric before and after by tier, by sector and over all names.

A run holds one row per entity: entity, sector, tier, grade, composite and a column per metric (NULL where it could not be measured)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators import ranks


def measured(metrics) -> Column:
    """Names of the metrics that a row holds, in order."""
    return F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in metrics]))


def with_ranks(run: DataFrame) -> DataFrame:
    """Rows with their place by composite over all names and in the sector (1 is best, equal composites share a place); a name
    without a composite has none. Values are ranked in chunks, so one sector may hold most names."""
    rows = run.withColumn("_all", F.lit(0))
    out = rows
    for name, groups in (("rank", ["_all"]), ("sector_rank", ["sector"])):
        place = ranks.value_ranks(rows, groups, "composite").select(*groups, "composite", (F.col("n") - F.col("n_le") + 1).alias(name))
        out = out.join(place, [*groups, "composite"], "left")
    return out.drop("_all")


def name_rows(before: DataFrame, after: DataFrame, metrics) -> DataFrame:
    """One row per name of either run: grade, composite and ranks now, grade and rank before, the places won since, and the metrics
    gained and lost. ``state`` tells names that joined or left."""
    now = with_ranks(after).select("entity", "sector", "tier", "grade", "composite", "rank", "sector_rank", measured(metrics).alias("measured"))
    old = with_ranks(before).select("entity", F.col("sector").alias("_sector"), F.col("tier").alias("_tier"), F.col("grade").alias("grade_before"),
                                    F.col("rank").alias("rank_before"), measured(metrics).alias("_measured"))
    j = now.join(old, "entity", "full_outer")
    none = F.array().cast("array<string>")
    new, prior = F.coalesce("measured", none), F.coalesce("_measured", none)
    state = F.when(F.col("_measured").isNull(), "joined").when(F.col("measured").isNull(), "left").otherwise("kept")
    return j.select("entity", F.coalesce("sector", "_sector").alias("sector"), F.coalesce("tier", "_tier").alias("tier"), state.alias("state"), "grade", "composite", "rank",
                    "sector_rank", "grade_before", "rank_before", (F.col("rank_before") - F.col("rank")).alias("places_won"), F.size(new).alias("metrics"),
                    F.size(prior).alias("metrics_before"), F.array_except(new, prior).alias("gained"), F.array_except(prior, new).alias("lost"))


COUNTS = ("eligible_before", "eligible", "measured_before", "measured", "gained", "lost")


def coverage(before: DataFrame, after: DataFrame, metrics) -> DataFrame:
    """(level, part, metric, eligible and measured before and after, gained, lost, gain in percentage points) of every metric and of
    all together (metric NULL), by tier, by sector and over all names (part NULL). The tier and sector are those of the later run.

    Names are counted once, per (tier, sector), with a column per metric and count; the grouping sets add up that small table."""
    def side(run, mark):
        flags = [F.col(m).isNotNull().alias(f"{mark}{m}") for m in metrics]
        return run.select("entity", F.col("sector").alias(f"{mark}sector"), F.col("tier").alias(f"{mark}tier"), F.lit(True).alias(f"{mark}here"), *flags)

    j = side(before, "o_").join(side(after, "n_"), "entity", "full_outer").withColumns({
        "tier": F.coalesce("n_tier", "o_tier", F.lit("")), "sector": F.coalesce("n_sector", "o_sector", F.lit(""))})

    def yes(c):
        return F.coalesce(F.col(c), F.lit(False))

    def cells(m):
        o, n = yes(f"o_{m}"), yes(f"n_{m}")
        tests = {"eligible_before": yes("o_here"), "eligible": yes("n_here"), "measured_before": o, "measured": n, "gained": n & ~o, "lost": o & ~n}
        return F.struct(*[F.count_if(tests[c]).alias(c) for c in COUNTS]).alias(m)

    small = j.groupBy("tier", "sector").agg(*[cells(m) for m in metrics])
    rows = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}.{c}").alias(c) for c in COUNTS]) for m in metrics]
    long = small.select("tier", "sector", F.explode(F.array(*rows)).alias("c")).select("tier", "sector", "c.*")
    t, s, m = (F.col(c) for c in ("tier", "sector", "metric"))
    sets = long.groupingSets([[t, m], [s, m], [m], [t], [s], []], t, s, m).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.grouping(t).alias("_t"), F.grouping(s).alias("_s"))
    level = F.when(F.col("_t") == 0, "tier").when(F.col("_s") == 0, "sector").otherwise("all")
    now, old = (F.when(F.col(e) > 0, 100.0 * F.col(c) / F.col(e)).otherwise(0.0) for c, e in (("measured", "eligible"), ("measured_before", "eligible_before")))
    return sets.select(level.alias("level"), F.coalesce("tier", "sector").alias("part"), "metric", *COUNTS, (now - old).alias("gain_points"))
