"""Fragility of every name: all probes over prices, cash flows and financing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators import asof
from lodestat.operators import fragility as X
from lodestat.operators import statements as S
from lodestat.session import stage


def financing_inputs(evaluated: DataFrame, falls: DataFrame, shares: DataFrame, splits: DataFrame) -> DataFrame:
    fall = falls.select(F.col("symbol").alias("entity"), "drawdown", "peak_day", "trough_day")
    p = asof.asof_join(fall, shares.withColumnRenamed("value", "at_peak"), "entity", "peak_day", "end_day", ("at_peak",)).drop("end_day_at")
    t = asof.asof_join(p, shares.withColumnRenamed("value", "at_trough"), "entity", "trough_day", "end_day", ("at_trough",)).drop("end_day_at")
    has = splits.select(F.col("symbol").alias("entity"), F.lit(True).alias("_h")).distinct()
    e = evaluated.select("entity", F.abs("current_debt").alias("due"), "cash", F.col("owner_fcf").alias("earnings"), "share_class")
    return e.join(t, "entity", "left").join(has, "entity", "left").withColumn("has_splits", F.coalesce("_h", F.lit(False))).drop("_h")


def findings(statements: DataFrame, evaluated: DataFrame, bars: DataFrame, shares: DataFrame, splits: DataFrame, stress_years: list) -> DataFrame:
    """(entity, probe, measured, severity, value), one row per counting probe. The falls, which five branches read, are worked
    out once."""
    a = S.annual(statements)
    falls = stage(X.falls(bars), "falls")
    parts = {
        "price_drawdown": X.price_drawdown(falls).withColumnRenamed("symbol", "entity"),
        "return_asymmetry": X.return_asymmetry(bars).withColumnRenamed("symbol", "entity"),
        "cash_engine": X.cash_engine(a), "stress": X.stress(a, stress_years), "predictability": X.predictability(a),
        "financing": X.financing(financing_inputs(evaluated, falls, shares, splits))}
    out = None
    for probe, df in parts.items():
        rows = df.select("entity", F.lit(probe).alias("probe"), "measured", "severity", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
