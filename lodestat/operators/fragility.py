"""Fragility probes: each returns one row per name with measured, severity and
value. Thresholds are inclusive and kept as data."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat.operators import series

# fixed values: probe lines
PRICE_DRAWDOWN = dict(severe=-0.6, caution=-0.4, min_bars=52)
ASYMMETRY = dict(skew=-0.5, tail=0.9, min_bars=52, min_side=20)
CASH_ENGINE = dict(severe=-0.6, caution=-0.35, min_periods=3, window=10, floor=-1.0)
STRESS = dict(severe=-0.6, caution=-0.35, start_month=6)
PREDICTABILITY = dict(growth_severe=0.2, growth_caution=0.1, margin_severe=0.1, margin_caution=0.05, min_periods=5)
FINANCING = dict(wall_severe=1.0, wall_caution=0.5, dilution_severe=0.1, dilution_caution=0.03, min_drawdown=-0.3, max_change=1.0)
COUNTING = ("price_drawdown", "return_asymmetry", "cash_engine", "stress", "predictability", "financing")
REQUIRED = ("price_drawdown", "cash_engine")
MIN_MEASURED = 4


def graded(measured: Column, severe: Column, caution: Column) -> Column:
    return F.when(~measured, "none").when(severe, "severe").when(caution, "caution").otherwise("none")


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def falls(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Deepest fall of each name's level (see ``series.drawdown``): one row per name, which probes share."""
    return series.drawdown(series.levels(bars, key=key), "level", key=key)


def price_drawdown(dd: DataFrame, key: str = "symbol") -> DataFrame:
    """The probe over ``falls``."""
    t = PRICE_DRAWDOWN
    measured = F.col("bars") - 1 >= t["min_bars"]
    deep, back = F.col("drawdown") <= t["severe"], F.col("recovered")
    return dd.select(key, measured.alias("measured"),
                     graded(measured, deep & ~back, deep | ((F.col("drawdown") <= t["caution"]) & ~back)).alias("severity"),
                     F.when(measured, F.col("drawdown")).alias("value"))


def return_asymmetry(bars: DataFrame, key: str = "symbol") -> DataFrame:
    t = ASYMMETRY
    m = series.moments(series.returns(bars, key=key), key=key, min_side=t["min_side"])
    measured = F.col("bars") >= t["min_bars"]
    skewed, thin = yes(F.col("skew") < t["skew"]), yes(F.col("tail_ratio") < t["tail"])
    return m.select(key, measured.alias("measured"), graded(measured, skewed & thin, skewed | thin).alias("severity"),
                    F.when(measured, F.col("skew")).alias("value"))


def cash_engine(annual: DataFrame, key: str = "entity") -> DataFrame:
    """Owner earnings' deepest fall over the last ten years, capped at -100 %;
    severe when not regained and negative or past the line. Never positive is severe."""
    t = CASH_ENGINE
    pts = annual.where("owner_fcf IS NOT NULL").select(key, "period_end", "owner_fcf")
    last = pts.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc("period_end")))).where(F.col("_rn") <= t["window"])
    dd = series.drawdown(last, "owner_fcf", key=key, day="period_end", slack=0.0)
    measured, ran = F.col("bars") >= t["min_periods"], F.col("positive_peaks")
    depth = F.when(ran, F.greatest("drawdown", F.lit(t["floor"]))).otherwise(t["floor"])
    back = F.col("recovered")
    severe = ~ran | (~back & ((F.col("trough") < 0) | (depth <= t["severe"])))
    return dd.select(key, measured.alias("measured"), graded(measured, severe, (depth <= t["severe"]) | (~back & (depth <= t["caution"]))).alias("severity"),
                     F.when(measured, depth).alias("value"))


def stress(annual: DataFrame, years: list, key: str = "entity") -> DataFrame:
    """Owner earnings of each stress year against the highest of any earlier year."""
    t = STRESS
    pts = annual.where("owner_fcf IS NOT NULL").select(key, "period_end", "owner_fcf")
    w = W.partitionBy(key).orderBy("period_end")
    x = pts.withColumns({"peak": F.max("owner_fcf").over(w.rowsBetween(W.unboundedPreceding, -1)),
                         "later": F.max("owner_fcf").over(w.rowsBetween(1, W.unboundedFollowing))})
    from lodestat.operators.statements import stress_periods
    hit = stress_periods(x, years, t["start_month"]).groupBy(key, "year").agg(
        F.max_by(F.struct("owner_fcf", "peak", "later"), "period_end").alias("p")).where("p.peak > 0")
    short, back = (F.col("p.owner_fcf") - F.col("p.peak")) / F.col("p.peak"), yes(F.col("p.later") >= F.col("p.peak"))
    g = hit.select(key, short.alias("s"), ((short <= t["severe"]) & ~back).alias("a"),
                   ((short <= t["severe"]) | ((short <= t["caution"]) & ~back)).alias("b")).groupBy(key).agg(
        F.bool_or("a").alias("a"), F.bool_or("b").alias("b"), F.min("s").alias("value"))
    every = annual.select(key).distinct().join(g, key, "left")
    measured = F.col("value").isNotNull()
    return every.select(key, measured.alias("measured"), graded(measured, F.col("a"), F.col("b")).alias("severity"), "value")


def predictability(annual: DataFrame, key: str = "entity") -> DataFrame:
    """Mean absolute deviation of yearly growth and of the operating margin."""
    t = PREDICTABILITY
    from lodestat.operators.statements import mad
    w = W.partitionBy(key).orderBy("period_end")
    rev = annual.where("revenue > 0").select(key, "period_end", "revenue", F.count("*").over(W.partitionBy(key)).alias("n"))
    growth = rev.where(F.col("n") >= t["min_periods"]).withColumn("g", F.col("revenue") / F.lag("revenue").over(w) - 1.0).where("g IS NOT NULL")
    margin = annual.where("revenue > 0 AND ebit IS NOT NULL").select(key, (F.col("ebit") / F.col("revenue")).alias("m"))
    g = mad(growth, "g", key).select(key, F.col("mad").alias("gm"))
    m = mad(margin, "m", key, min_n=t["min_periods"]).select(key, F.col("mad").alias("mm"))
    j = annual.select(key).distinct().join(g, key, "left").join(m, key, "left")
    measured = F.col("gm").isNotNull() | F.col("mm").isNotNull()
    severe = yes(F.col("gm") >= t["growth_severe"]) | yes(F.col("mm") >= t["margin_severe"])
    caution = yes(F.col("gm") >= t["growth_caution"]) | yes(F.col("mm") >= t["margin_caution"])
    rank = lambda c, lo, hi: F.when(c.isNull(), 0).when(c >= hi, 2).when(c >= lo, 1).otherwise(0)
    by_growth = F.struct(rank(F.col("gm"), t["growth_caution"], t["growth_severe"]), F.col("gm").isNotNull()) >= F.struct(
        rank(F.col("mm"), t["margin_caution"], t["margin_severe"]), F.col("mm").isNotNull())
    return j.select(key, measured.alias("measured"), graded(measured, severe, caution).alias("severity"), F.when(by_growth, F.col("gm")).otherwise(F.col("mm")).alias("value"))


def financing(names: DataFrame, key: str = "entity") -> DataFrame:
    """Refinancing wall and dilution at the bottom. names: (entity, due, cash,
    earnings, drawdown, at_peak, at_trough, has_splits, share_class)."""
    t = FINANCING
    c = F.col
    cushion = c("cash") + F.greatest(F.coalesce("earnings", F.lit(0.0)), F.lit(0.0))
    wall = F.when(c("due").isNotNull() & c("cash").isNotNull(), F.when(cushion > 0, c("due") / cushion).when(c("due") > 0, float("inf")).otherwise(0.0))
    change = c("at_trough") / c("at_peak") - 1.0
    usable = ~c("share_class") & (c("drawdown") <= t["min_drawdown"]) & c("has_splits") & (c("at_peak") > 0) & (F.abs(change) <= t["max_change"])
    x = names.withColumns({"wall": wall, "dilution": F.when(usable, change)})
    ws = F.when(c("wall") >= t["wall_severe"], 2).when(c("wall") >= t["wall_caution"], 1).otherwise(0)
    ds = F.when(c("dilution") >= t["dilution_severe"], 2).when(c("dilution") >= t["dilution_caution"], 1).otherwise(0)
    measured = c("wall").isNotNull() | c("dilution").isNotNull()
    worst = F.greatest(ws, ds)
    return x.select(key, measured.alias("measured"), graded(measured, worst == 2, worst == 1).alias("severity"),
                    F.when((ws >= ds) & c("wall").isNotNull(), F.when(c("wall") != float("inf"), c("wall"))).otherwise(c("dilution")).alias("value"))


def verdicts(findings: DataFrame, key: str = "entity") -> DataFrame:
    """Verdict per name over its counting probes. findings: (key, probe, measured,
    severity, value). Thin evidence collapses a safe verdict to Unknown."""
    s, c, n = F.count_if(F.col("severity") == "severe"), F.count_if(F.col("severity") == "caution"), F.count_if("measured")
    lacks = lambda p: ~F.coalesce(F.bool_or((F.col("probe") == p) & F.col("measured")), F.lit(False))
    missing = lacks(REQUIRED[0]) | lacks(REQUIRED[1])
    g = findings.groupBy(key).agg(s.alias("severe"), c.alias("caution"), n.alias("measured"), missing.alias("required_missing"))
    thin = F.col("required_missing") | (F.col("measured") < MIN_MEASURED)
    counted = F.when(F.col("severe") >= 3, "Ruinous").when((F.col("severe") >= 2) | (F.col("caution") >= 4), "Fragile").when(
        (F.col("severe") > 0) | (F.col("caution") > 0), "Ordinary").otherwise("Robust")
    return g.select(key, "severe", "caution", "measured", thin.alias("thin"), F.when(
        thin & (F.col("severe") == 0) & counted.isin("Robust", "Ordinary"), "Unknown").otherwise(counted).alias("verdict"))


def failure_modes(findings: DataFrame, key: str = "entity") -> DataFrame:
    """Findings of a name as one array: severe first, then caution, in probe order."""
    order = F.lit(len(COUNTING))
    for i, p in reversed(list(enumerate(COUNTING))):
        order = F.when(F.col("probe") == p, i).otherwise(order)
    sev = F.when(F.col("severity") == "severe", 0).otherwise(1)
    item = F.struct(sev.alias("s"), order.alias("o"), F.concat_ws(":", "severity", "probe").alias("text"))
    g = findings.where("severity <> 'none'").groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("m"))
    return g.select(key, F.transform("m", lambda x: x["text"]).alias("modes"))
