"""The low-cap lane: value table, survival probes and four three-valued lenses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat.functions import valuation as V
from lodestat.operators import asof
from lodestat.operators import statements as S

# fixed values: band, forge and lens lines
MIN_CAP, MAX_CAP, MIN_PRICE = 5e7, 2e9, 1.0
NSI_SEVERE, NSI_CAUTION, NSI_REPEAT = 10.0, 5.0, 2
RUNWAY_MONTHS, TLMTA, VOL, EQUITY_FLOOR = 12.0, 0.5, 0.6, 2.5e6
OVERHANG, ACCRUAL = 10.0, 10.0
REVERSE_DAYS = 730      # 24 months of 30.44 days
LENSES = ("graham", "garp", "downside", "compounder")


def eligible(mcap: Column, price: Column) -> Column:
    """struct(ok, reason): the band needs its figures; NULL is not eligible."""
    def out(ok, reason):
        return F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))
    return (F.when(mcap.isNull(), out(False, "market cap unmeasured")).when(mcap < MIN_CAP, out(False, "below the band")).when(mcap >= MAX_CAP, out(False, "above the band"))
            .when(price.isNull(), out(False, "price unmeasured")).when(price < MIN_PRICE, out(False, "price under the survival line")).otherwise(out(True, "inside the band")))


def eps_growth(statements: DataFrame, shares: DataFrame) -> DataFrame:
    """Yearly growth of per-share earnings between the first and last positive of
    at least three positive years."""
    pts = S.annual(statements).where("net_income IS NOT NULL").select("entity", "period_end", "net_income")
    at = asof.asof_join(pts, shares, "entity", "period_end", "end_day", ("value",)).where("value > 0 AND net_income > 0")
    p = at.withColumn("eps", F.col("net_income") / F.col("value"))
    g = p.groupBy("entity").agg(F.count("*").alias("n"), F.min("period_end").alias("d0"), F.max("period_end").alias("d1"),
                                F.min_by("eps", "period_end").alias("a"), F.max_by("eps", "period_end").alias("b"))
    return g.select("entity", F.when(F.col("n") >= 3, V.cagr_pct(F.col("d0"), F.col("a"), F.col("d1"), F.col("b"))).alias("eps_cagr"))


def repeat_issuance(yearly: DataFrame) -> DataFrame:
    """(entity, repeat_years): of the last three yearly steps (entity, end_day, issuance_pct), those above the caution line."""
    newest = W.partitionBy("entity").orderBy(F.desc("end_day"))
    last = yearly.withColumn("_rn", F.row_number().over(newest)).where("_rn <= 3")
    return last.groupBy("entity").agg(F.count_if(F.col("issuance_pct") > NSI_CAUTION).cast("int").alias("repeat_years"))


def reverse_splits(splits: DataFrame, last_day: DataFrame) -> DataFrame:
    """(entity, reverse_split): whether a reverse split lies within two years before the last day (entity, last)."""
    days = F.datediff("last", "day")
    recent = (F.col("ratio") > 0) & (F.col("ratio") < 1) & (days >= 0) & (days <= REVERSE_DAYS)
    j = last_day.join(splits.withColumnRenamed("symbol", "entity"), "entity", "left")
    return j.groupBy("entity").agg(F.coalesce(F.bool_or(recent), F.lit(False)).alias("reverse_split"))


def margin_trend(statements: DataFrame) -> DataFrame:
    """Deviation of the last five operating margins, and whether the last one is at
    or above their mean."""
    m = S.annual(statements).where("revenue > 0 AND ebit IS NOT NULL").select("entity", "period_end", (100.0 * F.col("ebit") / F.col("revenue")).alias("m"))
    last = m.withColumn("_rn", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("period_end")))).where("_rn <= 5")
    w = last.withColumn("_avg", F.avg("m").over(W.partitionBy("entity")))
    ok = F.count("*") >= 3
    return w.groupBy("entity").agg(F.when(ok, F.avg(F.abs(F.col("m") - F.col("_avg")))).alias("margin_mad"),
                                   F.when(ok, F.max_by("m", "period_end") >= F.max("_avg")).alias("margin_improving"))


def normal_fcf(statements: DataFrame) -> DataFrame:
    p = S.annual(statements).where("owner_fcf IS NOT NULL").withColumn("_rn", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("period_end")))).where("_rn <= 5")
    return p.groupBy("entity").agg(F.when(F.count("*") >= 3, F.avg("owner_fcf")).alias("norm_fcf"))


def value_table(evaluated: DataFrame, statements: DataFrame, shares: DataFrame) -> DataFrame:
    e = (evaluated.join(eps_growth(statements, shares), "entity", "left").join(margin_trend(statements), "entity", "left").join(normal_fcf(statements), "entity", "left"))
    c = F.col
    liab = c("total_assets") - c("equity") - F.coalesce("nci", F.lit(0.0))
    e = e.withColumns({"net_cash": c("cash") - c("debt"), "total_liab": liab, "ncav": c("current_assets") - liab,
                       "eps_ttm": F.try_divide("net_income", "latest_shares"), "bvps": F.try_divide("equity", "latest_shares"), "pe": V.ratio("market_cap", "net_income")})
    e = e.withColumns({
        "de_ratio": V.ratio("debt", "equity"), "liab_to_assets": F.try_divide("total_liab", "total_assets"), "current_ratio": F.try_divide("current_assets", "current_liabilities"),
        "mcap_to_ncav": V.ratio("market_cap", "ncav"), "graham_number": F.when((c("eps_ttm") > 0) & (c("bvps") > 0), F.sqrt(22.5 * c("eps_ttm") * c("bvps"))),
        "peg": V.ratio("pe", "eps_cagr"), "ocf_to_ni": V.ratio("ocf", "net_income"), "ev_ebit": F.when((c("ebit") > 0) & (c("own_ev") > 0), c("own_ev") / c("ebit")),
        "norm_fcf_yield": V.ratio("norm_fcf", "market_cap", 100.0)})
    return e.withColumn("price_to_graham", c("price") / c("graham_number"))


def _lens(speaks: Column, refuses: Column, rank: Column) -> Column:
    v = F.when(refuses, "refuses").when(speaks, "speaks").otherwise("silent")
    return F.struct(v.alias("verdict"), F.when(v == "speaks", rank).alias("rank"))


def yes(c) -> Column:
    return F.coalesce(c, F.lit(False))


def lenses(v: DataFrame) -> DataFrame:
    """Each lens speaks, is silent, or refuses to judge on missing inputs."""
    c = F.col
    nn_known = c("ncav").isNotNull() & c("market_cap").isNotNull() & c("net_income").isNotNull()
    gn_known = c("eps_ttm").isNotNull() & c("bvps").isNotNull() & c("price").isNotNull() & c("current_ratio").isNotNull() & c("liab_to_assets").isNotNull()
    net_net = nn_known & yes(c("mcap_to_ncav") < 2.0 / 3.0) & (c("net_income") > 0)
    defensive = gn_known & yes(c("price_to_graham") < 1.0) & (c("current_ratio") >= 2.0) & (c("liab_to_assets") < 0.5)
    graham = _lens(net_net | defensive, ~nn_known & ~gn_known, F.when(net_net, c("mcap_to_ncav")).otherwise(1.0 + c("price_to_graham")))
    gearing = F.when(c("net_cash") >= 0, True).otherwise(c("de_ratio") < 0.5)
    garp_tests = (c("peg") <= 1.0, c("eps_cagr").between(15.0, 30.0), c("ocf_to_ni") >= 1.0, gearing)
    garp_missing = c("peg").isNull() | c("eps_cagr").isNull() | c("ocf_to_ni").isNull() | gearing.isNull()
    garp = _lens(yes(garp_tests[0] & garp_tests[1] & garp_tests[2] & garp_tests[3]), garp_missing, c("peg"))
    floor = yes(c("net_cash") > 0) | yes((c("current_ratio") >= 2.0) & (c("de_ratio") < 0.3))
    unfloored = c("net_cash").isNull() & (c("current_ratio").isNull() | c("de_ratio").isNull())
    by_yield, by_ebit = yes(c("norm_fcf_yield") >= 8.0), yes(c("ev_ebit") <= 6.0)
    downside = _lens(floor & (by_yield | by_ebit), unfloored | (c("norm_fcf_yield").isNull() & c("ev_ebit").isNull()),
                     F.when(by_yield, -c("norm_fcf_yield")).otherwise(-100.0 / c("ev_ebit")))
    stable = F.when(c("margin_mad").isNotNull(), (c("margin_mad") <= 3.0) | yes(c("margin_improving")))
    comp_missing = c("net_income").isNull() | c("ocf").isNull() | c("share_trend").isNull() | c("roic").isNull() | c("rev_growth").isNull() | stable.isNull()
    comp = yes((c("net_income") > 0) & (c("ocf") > 0) & (c("share_trend") <= 2.0) & (c("roic") >= 15.0) & (c("rev_growth") >= 10.0) & stable)
    compounder = _lens(comp, comp_missing, -c("rev_growth"))
    return v.withColumns({"graham": graham, "garp": garp, "downside": downside, "compounder": compounder})


def forge(v: DataFrame) -> DataFrame:
    """Six survival probes and their verdict. v also carries vol, repeat_years,
    sub_dollar, reverse_split, basic_shares and diluted_shares (nullable)."""
    c = F.col

    def probe(measured, severe, caution):
        return F.when(~yes(measured), "unmeasured").when(yes(severe), "severe").when(yes(caution), "caution").otherwise("none")

    trend = c("share_trend")
    diluter = probe(~c("share_class") & (trend.isNotNull() | c("repeat_years").isNotNull()), (trend > NSI_SEVERE) | yes(c("repeat_years") >= NSI_REPEAT), trend > NSI_CAUTION)
    runway = c("cash") / (-c("ocf") / 12.0)
    cash = probe(c("ocf").isNotNull() & ((c("ocf") >= 0) | c("cash").isNotNull()), (c("ocf") < 0) & (runway < RUNWAY_MONTHS), F.lit(False))
    tl = F.when(c("total_liab") + c("market_cap") > 0, c("total_liab") / (c("total_liab") + c("market_cap")))
    fired = sum(F.when(x, 1).otherwise(0) for x in (c("net_income") < 0, tl > TLMTA, c("vol") > VOL))
    distress = probe(c("net_income").isNotNull() & tl.isNotNull() & c("vol").isNotNull(), fired == 3, fired == 2)
    delist = probe(c("sub_dollar").isNotNull() | c("equity").isNotNull() | c("reverse_split").isNotNull(),
                   yes(c("sub_dollar")) | yes(c("equity") < EQUITY_FLOOR) | yes(c("reverse_split")), F.lit(False))
    gap = 100.0 * (c("diluted_shares") - c("basic_shares")) / c("basic_shares")
    overhang = probe((c("basic_shares") > 0) & c("diluted_shares").isNotNull(), F.lit(False), gap > OVERHANG)
    accr = 100.0 * (c("net_income") - c("ocf")) / c("total_assets")
    mirage = probe(c("net_income").isNotNull() & c("ocf").isNotNull() & (c("total_assets") > 0), F.lit(False), accr > ACCRUAL)
    p = v.withColumns({"serial_diluter": diluter, "cash_runway": cash, "distress": distress, "delisting": delist, "overhang": overhang, "accrual_mirage": mirage})
    names = ("serial_diluter", "cash_runway", "distress", "delisting", "overhang", "accrual_mirage")
    tally = lambda s: sum(F.when(c(n) == s, 1).otherwise(0) for n in names)
    thin = (c("serial_diluter") == "unmeasured") | (c("cash_runway") == "unmeasured") | (6 - tally("unmeasured") < 3)
    verdict = F.when(tally("severe") > 0, "Forged-out").when(tally("caution") >= 2, "Watch").when(thin, "Unknown").otherwise("Survivor")
    return p.withColumns({"forge_severe": tally("severe"), "forge_caution": tally("caution"), "forge_verdict": verdict})


def lens_shortlists(rows: DataFrame, per_lens: int = 3) -> DataFrame:
    """Best names per lens among the eligible survivors; lists are never merged."""
    live = rows.where(F.col("eligible") & (F.col("forge_verdict") != "Forged-out") & F.coalesce(~F.col("verdict").isin("Fragile", "Ruinous"), F.lit(True)) & (F.coalesce("severe", F.lit(0)) <= 0))
    long = live.select("entity", F.explode(F.array(*[F.struct(F.lit(n).alias("lens"), F.col(f"{n}.verdict").alias("v"), F.col(f"{n}.rank").alias("r")) for n in LENSES])).alias("x"))
    speaks = long.where("x.v = 'speaks' AND x.r IS NOT NULL").select("entity", "x.lens", F.col("x.r").alias("score"))
    w = W.partitionBy("lens").orderBy("score", "entity")
    return speaks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_lens)
