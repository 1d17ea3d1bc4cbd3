"""One metric row per entity: statements, balance, share series and market data
brought together by entity, then a single select."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions import valuation as V
from lodestat.operators import series
from lodestat.operators import statements as S

REQUIRED = (("v_yield", "owner-FCF yield (EV <= 0 or not computable)"), ("roic", "ROIC"), ("gm_level", "gross-margin level"),
            ("ofcf_margin", "owner-FCF margin"), ("nd2e", "net debt/EBITDA"), ("sbc_pct", "SBC/revenue"), ("accrual", "accrual divergence"))


def evaluate(statements: DataFrame, shares: DataFrame, market: DataFrame, meta: DataFrame) -> DataFrame:
    """statements: wide rows; shares: (entity, end_day, value) in today's terms;
    market: (entity, market_cap, price, vendor_ev); meta: (entity, sector, industry)."""
    newest = shares.groupBy("entity").agg(F.max_by("value", "end_day").alias("latest_shares"))
    trend = series.share_trend(shares).select("entity", F.col("trend_pct").alias("share_trend"))
    j = (S.ttm(statements).join(S.latest_balance(statements), "entity", "left")
         .join(S.annual_facts(statements), "entity", "left").join(S.per_share_growth(statements, shares), "entity", "left")
         .join(newest, "entity", "left").join(trend, "entity", "left")
         .join(market, "entity", "left").join(meta, "entity", "left"))
    c = F.col
    own_ev = c("market_cap") + c("debt") - c("cash")
    derived_ev = F.when(c("price") > 0, c("price") * c("latest_shares") + c("debt") - c("cash"))
    j = j.withColumns({"own_ev": own_ev, "ref_ev": F.coalesce("vendor_ev", derived_ev), "net_debt": c("debt") - c("cash"),
                       "ev_source": F.when(c("vendor_ev").isNotNull(), "field").when(derived_ev.isNotNull(), "derived")})
    roic, capped = V.roic(c("ebit"), c("working_capital"), c("total_assets"), c("current_assets"), c("cash"))
    gap = F.when(c("own_ev") > 0, 100.0 * (c("own_ev") - c("ref_ev")) / c("own_ev"))
    nci = F.when(c("equity") + c("nci") > 0, 100.0 * c("nci") / (c("equity") + c("nci")))
    j = j.withColumns({
        "gap_pct": gap, "nci_pct": nci, "roic": roic, "roic_capped": capped,
        "v_yield": V.ratio("owner_fcf", "own_ev"), "p_ofcf": V.ratio("market_cap", "owner_fcf"),
        "gm_level": V.ratio("gross_profit", "revenue", 100.0), "ofcf_margin": V.ratio("owner_fcf", "revenue", 100.0),
        "nd2e": F.when(c("ebitda") != 0, c("net_debt") / c("ebitda")), "sbc_pct": V.ratio("sbc", "revenue", 100.0),
        "accrual": F.when(c("revenue") > 0, 100.0 * (c("net_income") - c("ocf")) / c("revenue")),
        "deferred_pct": V.ratio("deferred", "revenue", 100.0)})
    j = j.withColumn("share_class", F.coalesce((c("nci_pct") > V.SHARE_CLASS_NCI_PCT) & (F.abs("gap_pct") > V.EV_GAP_PCT), F.lit(False)))
    missing = F.coalesce(*[F.when(c(k).isNull(), F.lit(label)) for k, label in REQUIRED])
    flags = F.array_compact(F.array(
        F.when(F.abs("gap_pct") > V.EV_GAP_PCT, F.lit("EV_GAP")), F.when(c("share_class"), F.lit("SHARE_CLASS")),
        F.when(c("deferred_pct") > V.FLOAT_DEFERRED_PCT, F.lit("FLOAT_ROIC")), F.when(c("low_base"), F.lit("LOW_BASE")),
        F.when(c("roic_capped"), F.lit("ROIC_CAPPED"))))
    return j.withColumns({
        "m_shares": F.when(~c("share_class"), c("share_trend")), "required_gap": missing, "flags": flags,
        "veto": V.veto(c("nd2e"), c("ebitda"), c("net_debt"), c("credit_loss"), c("ocf"), c("share_trend"), c("share_class"),
                       c("all_negative"), c("owner_fcf"), c("roic"), c("rev_growth"))})
