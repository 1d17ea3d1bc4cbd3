"""Sector grades: vetoed names out, names with a missing required metric
suspended, the survivors ranked inside their sector on eleven legs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import names
from lodestat.functions import valuation as V
from lodestat.operators import ranks

# leg -> higher is better
LEGS = {"v_yield": True, "roic": True, "gm_level": True, "gm_cv": False, "ofcf_margin": True, "rev_growth": True, "ps_growth": True,
        "nd2e": False, "sbc_pct": False, "m_shares": False, "accrual": False}


def leg_percentiles(rows: DataFrame, legs: dict, group: str = "sector", key: str = "entity") -> DataFrame:
    """(key, p_<leg>...): cohort percentiles of all legs in one pass. Legs become
    rows, so a single distributed ranking serves every (group, leg)."""
    long = rows.unpivot([key, group], list(legs), "leg", "x")
    ranked = ranks.with_percentile(long.where("x IS NOT NULL"), [group, "leg"], "x", "p")
    lower = [k for k, high in legs.items() if not high]
    p = F.when(F.col("leg").isin(*lower) & (F.col("p_n") > 1), 100.0 - F.col("p")).otherwise(F.col("p"))
    return ranked.withColumn("p", p).groupBy(key).agg(
        *[F.max(F.when(F.col("leg") == k, F.col("p"))).alias(f"p_{k}") for k in legs])


def score(evaluated: DataFrame) -> DataFrame:
    """Every evaluated row with its pillars, composite, grade and note."""
    c = F.col
    alive = evaluated.where(~c("veto.vetoed") & c("required_gap").isNull())
    p = leg_percentiles(alive, LEGS)
    out = [c("veto.vetoed"), c("required_gap").isNotNull()]
    j = evaluated.join(p, "entity", "left")
    live = ~out[0] & ~out[1]
    factor = V.roic_floor(c("roic"))
    shares = F.when(c("share_class"), 50.0).otherwise(c("p_m_shares"))
    j = j.withColumns({
        "v": F.bround("p_v_yield", 6),
        "q": V.mean_present(F.bround(c("p_roic") * factor, 6), F.bround(c("p_gm_level") * c("p_gm_cv") / 100.0, 6), F.bround("p_ofcf_margin", 6)),
        "g": F.when(live, F.coalesce(V.mean_present(F.bround(c("p_rev_growth") * factor, 6), F.bround(c("p_ps_growth") * factor, 6)), F.lit(50.0))),
        "d": V.mean_present(F.bround("p_nd2e", 6), F.when(live, F.when(c("owner_fcf") > 0, 100.0).otherwise(0.0)), F.bround("p_sbc_pct", 6)),
        "m": V.mean_present(F.when(live, F.bround(shares, 6)), F.bround("p_accrual", 6))})
    comp = F.when(live, V.composite("v", "q", "g", "d", "m", "veto.penalty"))
    return j.withColumns({
        "composite": comp, "quality_score": F.when(live, V.quality_score("q", "g", "d", "m")),
        "grade": F.when(out[0], "VETOED").when(out[1], "INSUFFICIENT").otherwise(V.grade_letter(comp)),
        "note": F.when(out[1] & ~out[0], F.concat(F.lit("insufficient data: "), c("required_gap"))).otherwise(c("veto.reason")),
        "tier": names.industry_tier(c("industry")),
        "flags": F.when(live & c("veto.reinvestor"), F.concat("flags", F.array(F.lit("REINVESTOR")))).otherwise(c("flags"))})
