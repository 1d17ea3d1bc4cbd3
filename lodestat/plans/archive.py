"""The first-generation grader over quarterly statements: no cash-flow-quality
veto, no hard dilution veto, mean gross margin over all periods, uncapped ROIC."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat.functions import valuation as V
from lodestat.operators import series
from lodestat.operators import statements as S
from lodestat.plans import grading

LEGS = {"v_yield": True, "roic": True, "gm_level": True, "gm_cv": False, "ofcf_margin": True, "growth": True, "nd2e": False, "sbc_pct": False, "yoy_pct": False, "accrual": False}


def metrics(statements: DataFrame, shares: DataFrame, market: DataFrame, meta: DataFrame) -> DataFrame:
    q = S.derived(statements.where("scope = 'quarterly'")).withColumn("_rn", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("period_end"))))
    full = lambda c: F.when(F.count(c) == 4, F.sum(c))
    last4 = q.where("_rn <= 4").groupBy("entity").agg(
        full("owner_fcf").alias("owner_fcf"), F.sum(F.coalesce("revenue", F.lit(0.0))).alias("rev0"), full("ebitda").alias("ebitda"), full("revenue").alias("revenue"), full("net_income").alias("ni"),
        full("ocf").alias("ocf"), F.sum(F.coalesce("sbc", F.lit(0.0))).alias("sbc"))
    base = F.col("working_capital") + (F.col("total_assets") - F.col("current_assets") - F.col("cash"))
    new = q.where("_rn = 1").withColumn("working_capital", F.col("current_assets") - F.col("current_liabilities")).select(
        "entity", "debt", "cash", F.when(base > 0, 100.0 * F.col("ebit") / base).alias("roic"))
    gm = F.when(F.col("revenue") != 0, F.col("gross_profit") / F.col("revenue"))
    rev = F.when(F.col("revenue") > 0, F.col("revenue"))
    day = F.when(rev.isNotNull(), F.col("period_end"))
    all_ = q.groupBy("entity").agg(
        (100.0 * F.avg(gm)).alias("gm_level"), F.when((F.count(gm) > 1) & (F.avg(gm) != 0), F.stddev_pop(gm) / F.avg(gm)).otherwise(0.0).alias("gm_cv"),
        F.when(F.count(rev) >= 2, V.cagr_pct(F.min(day), F.min_by(rev, day), F.max(day), F.max_by(rev, day))).alias("growth"),
        F.coalesce(F.bool_and(F.col("owner_fcf") < 0), F.lit(False)).alias("all_negative"))
    yoy = series.share_trend(shares).select("entity", "yoy_pct")
    c = F.col
    j = last4.join(new, "entity").join(all_, "entity").join(yoy, "entity", "left").join(market.select("entity", "market_cap"), "entity", "left").join(meta, "entity", "left")
    ev, nd = c("market_cap") + c("debt") - c("cash"), c("debt") - c("cash")
    return j.withColumns({"v_yield": V.ratio("owner_fcf", ev), "ofcf_margin": F.when(c("rev0") > 0, 100.0 * c("owner_fcf") / c("rev0")).otherwise(F.when(c("owner_fcf").isNotNull(), 0.0)),
                          "net_debt": nd, "nd2e": F.when(c("ebitda") != 0, nd / c("ebitda")), "sbc_pct": V.ratio("sbc", "revenue", 100.0), "accrual": F.when(c("revenue") > 0, 100.0 * (c("ni") - c("ocf")) / c("revenue"))})


REQUIRED = ("v_yield", "roic", "gm_level", "ofcf_margin", "nd2e", "sbc_pct", "accrual")


def grade(rows: DataFrame) -> DataFrame:
    c = F.col
    thin = F.array_contains(F.array(*[c(k).isNull() for k in REQUIRED]), True)
    spared = (c("roic") > 15.0) & F.coalesce(c("growth") > 10.0, F.lit(False))
    rule = (F.when(thin, "INSUFFICIENT").when((c("nd2e") > 4.0) | ((c("ebitda") <= 0) & (c("net_debt") > 0)), "VETOED").when(c("all_negative") & ~spared, "VETOED"))
    penalty = F.when(~c("all_negative") & (c("yoy_pct") > 5.0), -15).otherwise(0)
    m = rows.withColumns({"rule": rule, "penalty": penalty})
    p = grading.leg_percentiles(m.where("rule IS NULL"), LEGS)
    j = m.join(p, "entity", "left")
    factor = V.roic_floor(c("roic"))
    j = j.withColumns({"v": c("p_v_yield"), "q": V.mean_present(F.bround(c("p_roic") * factor, 6), c("p_gm_level") * (c("p_gm_cv") / 100.0), "p_ofcf_margin"), "g": F.coalesce(F.bround(c("p_growth") * factor, 6), F.lit(50.0)),
                       "d": V.mean_present("p_nd2e", F.when(c("owner_fcf") > 0, 100.0).otherwise(0.0), "p_sbc_pct"), "m": V.mean_present("p_accrual", "p_yoy_pct")})
    comp = F.when(c("rule").isNull(), V.composite("v", "q", "g", "d", "m", "penalty"))
    return j.withColumns({"composite": comp, "grade": F.coalesce("rule", V.grade_letter(comp))})
