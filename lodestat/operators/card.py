"""The absolute card: anchored points per metric, blocks, bands, lenses; and the
composite checks shown beside it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat.functions import valuation as V
from lodestat.operators import statements as S

# fixed values: metric -> (block, floor, target, points)
ANCHORS = {
    "roic": ("quality", 5.0, 25.0, 12), "gross_margin": ("quality", 20.0, 60.0, 6), "gross_margin_cv": ("quality", 0.35, 0.05, 5),
    "owner_fcf_margin": ("quality", 0.0, 20.0, 7), "revenue_growth": ("quality", 0.0, 15.0, 5),
    "owner_fcf_yield": ("price", 0.02, 0.08, 15), "margin_of_safety": ("price", -0.25, 0.5, 10),
    "net_debt_ebitda": ("safety", 4.0, 0.0, 10), "self_funding": ("safety", 0.5, 1.0, 8), "sbc": ("safety", 10.0, 2.0, 4), "current_ratio": ("safety", 1.0, 2.0, 3),
    "share_count_trend": ("stewardship", 5.0, -2.0, 7), "accruals": ("stewardship", 10.0, 0.0, 5), "capital_returned": ("stewardship", 0.0, 0.5, 3)}
BLOCKS = {"quality": 35, "price": 25, "safety": 25, "stewardship": 15}
FULL_MAX = 100
BANDS = (("Exceptional", 80), ("Strong", 65), ("Mixed", 50), ("Weak", 35), ("Pass", 0))
TIERS = (("full", 0.85), ("partial", 0.6), ("thin", 0.0))
CONSENSUS_PCT, CONSENSUS_BUFFETT = 60.0, 9


def margin_of_safety(evaluated: DataFrame, statements: DataFrame) -> DataFrame:
    """Rows with base_fcf, growth, discount, quality, intrinsic value and mos_pct."""
    a = S.annual(statements).where("owner_fcf IS NOT NULL").withColumn("_rn", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("period_end"))))
    pos = F.when(F.col("owner_fcf") > 0, F.col("owner_fcf"))
    vol = F.when(F.count("*") < 3, 0.5).when((F.count(pos) < 2) | (F.avg(pos) <= 0), 0.8).otherwise(F.least(F.stddev_samp(pos) / F.avg(pos), F.lit(1.0)))
    h = a.groupBy("entity").agg(F.avg(F.when(F.col("_rn") <= 3, F.col("owner_fcf"))).alias("_avg3"), vol.alias("_vol"))
    e = evaluated.join(h, "entity", "left")
    c = F.col
    base = F.greatest(c("owner_fcf"), 0.85 * c("_avg3"))
    cap = F.when(c("market_cap") > 2e11, 0.1).otherwise(0.25)
    ok = (c("market_cap") > 0) & (base > 0)
    nd = F.greatest(F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0)), F.lit(0.0))
    e = e.withColumns({"base_fcf": F.when(ok, base), "growth": F.when(c("rev_growth").isNotNull() & (c("rev_growth") != 0), F.least(c("rev_growth") / 100.0, cap)).otherwise(0.05),
                       "discount": V.levered_cost_of_equity(c("market_cap"), nd), "dcf_quality": F.greatest(F.lit(0.7), 1.0 - 0.5 * F.coalesce("_vol", F.lit(0.5))),
                       "wacc": V.wacc(c("market_cap"), c("debt"), c("cash"), F.when(c("interest") != 0, c("ebit") / F.abs("interest")))})
    e = e.withColumn("intrinsic", V.dcf(c("base_fcf"), c("growth"), c("discount")) * c("dcf_quality"))
    return e.withColumn("mos_pct", (c("intrinsic") - c("market_cap")) / c("market_cap")).drop("_avg3", "_vol")


def _avg(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))


def _pick(years: Column, fn) -> Column:
    """Values of the years (newest first) that are not NULL."""
    return F.filter(F.transform(years, fn), lambda x: x.isNotNull())


def buffett(annual_rows: DataFrame) -> DataFrame:
    """Checklist over the last eight years, at most 13 points."""
    y = F.slice("years", 1, 8)
    new = y[0]
    roe = lambda r: F.when(r["equity"] > 0, r["net_income"] / r["equity"])
    om = lambda r: F.when(r["revenue"] > 0, r["ebit"] / r["revenue"])
    ni = _pick(y, lambda r: r["net_income"])
    n = F.size(ni)
    steady = (n >= 2) & F.forall(F.zip_with(F.slice(ni, 1, F.greatest(n - 1, F.lit(0))), F.slice(ni, 2, F.greatest(n - 1, F.lit(0))), lambda b, a: b >= a), lambda t: t)
    roes, oms = _pick(y, roe), _pick(y, om)
    frac = F.size(F.filter(roes, lambda x: x > 0.15)) / F.size(roes)
    older = F.slice(oms, F.greatest(F.size(oms) - 2, F.lit(1)), 3)
    pts = {
        "roe": F.when(roe(new) > 0.15, 2), "debt_equity": F.when((new["equity"] > 0) & (new["debt"] / new["equity"] < 0.5), 2), "margin": F.when(om(new) > 0.15, 2),
        "current": F.when((new["current_liabilities"] > 0) & (new["current_assets"] / new["current_liabilities"] > 1.5), 1), "earnings": F.when(steady, 3),
        "moat_roe": F.when(F.size(roes) >= 2, F.when(frac >= 0.8, 2).when(frac >= 0.6, 1)),
        "pricing": F.when((_avg(oms) > 0.2) & (_avg(F.slice(oms, 1, 3)) >= _avg(older)), 1)}
    rows = annual_rows.select("entity", *[F.coalesce(p, F.lit(0)).alias(f"b_{k}") for k, p in pts.items()])
    return rows.withColumn("buffett", sum(F.col(f"b_{k}") for k in pts))


def piotroski(annual_rows: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Nine nullable tests: how many hold, how many could be measured."""
    e = evaluated.select("entity", F.col("net_income").alias("ni"), F.col("ocf").alias("o"), "share_trend").join(annual_rows, "entity", "left")
    a, b = F.get("years", F.lit(0)), F.get("years", F.lit(1))

    def better(fn, up=True):
        x, z = fn(a), fn(b)
        return x > z if up else x < z
    div = F.try_divide
    tests = (F.col("ni") > 0, F.col("o") > 0, F.col("o") > F.col("ni"),
             better(lambda r: div(r["net_income"], r["total_assets"])), better(lambda r: div(r["debt"], r["total_assets"]), False),
             better(lambda r: div(r["current_assets"], r["current_liabilities"])), better(lambda r: div(r["gross_profit"], r["revenue"])),
             better(lambda r: div(r["revenue"], r["total_assets"])), F.col("share_trend") <= 0)
    arr = F.array(*tests)
    return e.select("entity", F.size(F.filter(arr, lambda t: t)).alias("score"), F.size(F.filter(arr, lambda t: t.isNotNull())).alias("measured"))


def altman(evaluated: DataFrame) -> DataFrame:
    c = F.col
    z = 1.2 * c("working_capital") / c("total_assets") + 1.4 * c("retained") / c("total_assets") + 3.3 * c("ebit") / c("total_assets") + 0.6 * c("market_cap") / c("liabilities") + c("revenue") / c("total_assets")
    z = F.when((c("total_assets") > 0) & (c("liabilities") > 0), z)
    return evaluated.select("entity", F.bround(z, 2).alias("z"), F.when(z < 1.81, "distress").when(z < 2.99, "grey").when(z.isNotNull(), "safe").alias("zone"))


def incremental_roic(annual_rows: DataFrame) -> DataFrame:
    """Three-year change of after-tax operating income over that of invested capital,
    only where the capital is material and grew materially."""
    new, old = F.get("years", F.lit(0)), F.get("years", F.lit(3))
    ic = lambda r: r["equity"] + r["debt"] - r["cash"]
    d_ic, avg_ic = ic(new) - ic(old), (ic(new) + ic(old)) / 2.0
    ok = (avg_ic > 0.1 * new["total_assets"]) & (d_ic > 0.05 * avg_ic)
    return annual_rows.select("entity", F.when(ok, 100.0 * (new["ebit"] - old["ebit"]) * 0.75 / d_ic).alias("incremental_roic"))


def registry_extras(evaluated: DataFrame) -> DataFrame:
    """Cash and accrual ratios of the metric registry."""
    c = F.col
    return evaluated.select(
        "entity", V.ratio("ebit", "revenue", 100.0).alias("op_margin"), F.try_divide("owner_fcf", "latest_shares").alias("fcf_per_share"), V.ratio("owner_fcf", "net_income", 100.0).alias("fcf_conversion"),
        V.ratio("ocf", "ebitda", 100.0).alias("cash_conversion"), V.ratio("capex", "revenue", 100.0).alias("capex_intensity"), F.when(c("interest") != 0, c("ebit") / F.abs("interest")).alias("interest_coverage"),
        F.try_divide("current_assets", "current_liabilities").alias("current_ratio"), V.ratio("goodwill", "total_assets", 100.0).alias("goodwill_pct"), V.ratio("research", "revenue", 100.0).alias("rd_intensity"),
        F.when(c("pretax") > 0, 100.0 * (c("tax_expense") - c("taxes_paid")) / c("pretax")).alias("tax_gap"), V.ratio(F.abs("dividends"), "ocf", 100.0).alias("dividends_pct_ocf"),
        V.ratio(F.abs("buybacks"), "ocf", 100.0).alias("buybacks_pct_ocf"))


def anchored(valued: DataFrame, annual_rows: DataFrame) -> DataFrame:
    """The fourteen anchored values per name (NULL where unmeasured)."""
    new = F.get("years", F.lit(0))
    paid = F.when(new["dividends"].isNotNull() | new["buybacks"].isNotNull(), F.abs(F.coalesce(new["dividends"], F.lit(0.0))) + F.abs(F.coalesce(new["buybacks"], F.lit(0.0))))
    j = valued.join(annual_rows, "entity", "left")
    c = F.col
    x = {
        "x_roic": c("roic"), "x_gross_margin": c("gm_level"), "x_gross_margin_cv": F.when(c("gm_periods") >= 2, c("gm_cv")), "x_owner_fcf_margin": c("ofcf_margin"), "x_revenue_growth": c("rev_growth"),
        "x_owner_fcf_yield": c("v_yield"), "x_margin_of_safety": c("mos_pct"), "x_net_debt_ebitda": c("nd2e"), "x_self_funding": F.when(c("fcf_periods") > 0, c("fcf_positive") / c("fcf_periods")),
        "x_sbc": c("sbc_pct"), "x_current_ratio": V.ratio("current_assets", "current_liabilities"), "x_share_count_trend": F.when(~c("share_class"), c("share_trend")), "x_accruals": c("accrual"),
        "x_capital_returned": F.when(new["owner_fcf"] > 0, paid / new["owner_fcf"])}
    return j.select("entity", "veto", "mos_pct", *[v.alias(k) for k, v in x.items()])


def points(metric: str) -> Column:
    _, floor, target, pts = ANCHORS[metric]
    return F.bround(V.ramp(F.col(f"x_{metric}"), floor, target, float(pts)), 1)


def scorecard(values: DataFrame) -> DataFrame:
    """Points, blocks out of the measured maximum, percent, band and evidence."""
    c, zero = F.col, F.lit(0.0)
    s = values.withColumns({f"pt_{m}": points(m) for m in ANCHORS})
    block = {b: [m for m, a in ANCHORS.items() if a[0] == b] for b in BLOCKS}
    s = s.withColumns({f"{b}_pts": F.bround(sum((F.coalesce(f"pt_{m}", zero) for m in ms), zero), 1) for b, ms in block.items()} |
                      {f"{b}_max": sum((F.when(c(f"pt_{m}").isNotNull(), ANCHORS[m][3]).otherwise(0) for m in ms), F.lit(0)) for b, ms in block.items()})
    s = s.withColumns({"score": F.bround(sum((c(f"{b}_pts") for b in BLOCKS), zero), 1), "available_max": sum((c(f"{b}_max") for b in BLOCKS), F.lit(0))})
    pct = F.when(c("available_max") > 0, F.bround(100.0 * c("score") / c("available_max")))
    s = s.withColumn("raw_pct", pct)
    band = F.lit("Pass")
    for name, floor in reversed(BANDS[:-1]):
        band = F.when(c("raw_pct") >= floor, name).otherwise(band)
    band = F.when(c("veto.vetoed"), "VETOED").when(c("price_max") == 0, "NO PRICE").otherwise(band)
    share = c("available_max") / float(FULL_MAX)
    s = s.withColumns({"band": band, "pct": F.when(~c("veto.vetoed"), c("raw_pct")), "evidence": F.when(share >= 0.85, "full").when(share >= 0.6, "partial").otherwise("thin")})
    items = F.array(*[F.struct((c(f"pt_{m}") / a[3]).alias("share"), F.lit(a[3]).alias("w"), F.lit(-i).alias("o"), F.lit(m).alias("m")) for i, (m, a) in enumerate(ANCHORS.items())])
    known = F.filter(items, lambda x: x["share"].isNotNull())
    low = F.array_min(F.transform(known, lambda x: F.struct(x["share"].alias("a"), (-x["w"]).alias("b"), (-x["o"]).alias("c"), x["m"].alias("m"))))
    return s.withColumns({"strongest": F.array_max(known)["m"], "weakest": low["m"]})


def survival(verdict: Column, severe: Column, flagged: Column) -> Column:
    """Survival lens: safe verdicts are green unless a flag or a severe finding
    stands, then unknown; Unknown is unknown; the rest is red."""
    safe = verdict.isin("Robust", "Ordinary")
    return F.when(safe & (flagged | (severe > 0)), F.lit(None).cast("boolean")).when(safe, True).when(verdict.isin("Fragile", "Ruinous"), False)


def consensus(cards: DataFrame) -> DataFrame:
    """Green and unknown lenses of four: card, margin of safety, checklist, survival."""
    c = F.col
    card = F.when(c("band") == "VETOED", False).when((c("band") != "NO PRICE") & c("pct").isNotNull(), c("pct") >= CONSENSUS_PCT)
    arr = F.array(card, c("mos_pct") > 0, c("buffett") >= CONSENSUS_BUFFETT, survival(c("verdict"), F.coalesce("severe", F.lit(0)), F.coalesce("flagged", F.lit(False))))
    green, unknown = F.size(F.filter(arr, lambda x: x)), F.size(F.filter(arr, lambda x: x.isNull()))
    label = F.when(green == 4, "4 of 4, all lenses agree").otherwise(F.concat(green.cast("string"), F.lit(" of 4"), F.when(unknown > 0, F.concat(F.lit(" ("), unknown.cast("string"), F.lit(" unknown)"))).otherwise("")))
    return cards.withColumns({"green": green, "unknown_lenses": unknown, "consensus": label})


def rank_tier(evidence: Column) -> Column:
    return F.when(evidence == "full", 0).when(evidence == "partial", 1).otherwise(2)
