"""Statements per entity: trailing twelve months, newest balance, annual points.

Input rows are wide (entity, scope, period_end, labels). An entity holds one row
per period of the calendar, so its rows may be windowed or gathered in one array."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat.functions import valuation as V
from lodestat.operators import asof, series

STRICT = ("revenue", "ebit", "ebitda", "gross_profit", "net_income", "interest", "ocf", "owner_fcf", "research",
          "tax_expense", "pretax", "taxes_paid")
ZERO_DEFAULT = ("dividends", "buybacks")
INCOME = ("revenue", "ebit", "gross_profit", "net_income", "interest", "research", "tax_expense", "pretax")
CASH = ("ocf", "capex", "sbc", "taxes_paid", "dividends", "buybacks")
MIN_ANNUAL_GAP_DAYS = 300


def derived(s: DataFrame) -> DataFrame:
    """Rows with EBITDA and owner free cash flow."""
    return s.withColumns({"ebitda": F.col("ebit") + F.col("da"), "owner_fcf": V.owner_fcf()})


def _sums():
    out = [F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c) for c in STRICT]
    out.append(F.abs(F.when(F.count("capex") == F.count(F.lit(1)), F.sum("capex"))).alias("capex"))
    out += [F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("sbc", "credit_loss")]
    out += [F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c) for c in ZERO_DEFAULT]
    return out


def ttm(s: DataFrame) -> DataFrame:
    """Of the periods that both the income and the cash-flow statement cover: newest four quarters if all hold revenue, operating cash and capex, else the
    newest year; a sum is NULL if any period lacks the row."""
    d = derived(s)
    newest = W.partitionBy("entity").orderBy(F.desc("period_end"))
    flows = d.where(F.coalesce(*[F.col(c) for c in INCOME]).isNotNull() & F.coalesce(*[F.col(c) for c in CASH]).isNotNull())   # periods of both statements
    q = (flows.where("scope = 'quarterly'").withColumn("_rn", F.row_number().over(newest)).where("_rn <= 4")
         .groupBy("entity").agg(F.max("period_end").alias("through"), F.count(F.lit(1)).alias("_n"), *_sums(),
                                F.count("revenue").alias("_r"), F.count("ocf").alias("_o"), F.count("capex").alias("_c"))
         .where("_n = 4 AND _r = 4 AND _o = 4 AND _c = 4").drop("_n", "_r", "_o", "_c")
         .withColumns({"basis": F.lit("quarterly"), "quarters": F.lit(4)}))
    a = (flows.where("scope = 'annual'").withColumn("_rn", F.row_number().over(newest)).where("_rn = 1")
         .join(q.select("entity"), "entity", "left_anti")
         .groupBy("entity").agg(F.max("period_end").alias("through"), *_sums())
         .withColumns({"basis": F.lit("annual"), "quarters": F.lit(1)}))
    return q.unionByName(a)


BALANCE = ("cash", "debt", "current_debt", "total_assets", "current_assets", "current_liabilities", "equity", "nci", "deferred", "retained",
           "liabilities", "goodwill")


def latest_balance(s: DataFrame) -> DataFrame:
    """Newest balance row, quarterly before annual."""
    has = F.coalesce(*[F.col(c) for c in BALANCE]).isNotNull()
    row = F.struct(F.col("period_end").alias("balance_end"), *BALANCE)
    return (s.where(has).groupBy("entity").agg(F.max_by(row, F.struct(F.col("scope") == "quarterly", F.col("period_end"))).alias("b"))
            .select("entity", "b.*").withColumn("working_capital", F.col("current_assets") - F.col("current_liabilities")))


def annual(s: DataFrame) -> DataFrame:
    return derived(s).where("scope = 'annual'")


def annual_facts(s: DataFrame) -> DataFrame:
    """Aggregates over the annual rows: growth, margin stability, owner-FCF signs."""
    a = annual(s)
    gm = F.when(F.col("revenue") != 0, F.col("gross_profit") / F.col("revenue"))
    rev = F.when(F.col("revenue") > 0, F.col("revenue"))
    day = F.when(rev.isNotNull(), F.col("period_end"))
    n, mean = F.count(gm), F.avg(gm)
    d0, d1, v0, v1 = F.min(day), F.max(day), F.min_by(rev, day), F.max_by(rev, day)
    return a.groupBy("entity").agg(
        n.alias("gm_periods"), F.when((n < 2) | (mean == 0), 0.0).otherwise(F.stddev_pop(gm) / mean).alias("gm_cv"),
        F.when(F.count(rev) >= 2, V.cagr_pct(d0, v0, d1, v1)).alias("rev_growth"),
        F.coalesce(F.bool_and(F.col("owner_fcf") < 0), F.lit(False)).alias("all_negative"),
        F.count("owner_fcf").alias("fcf_periods"), F.count_if(F.col("owner_fcf") > 0).alias("fcf_positive"))


def per_share_growth(s: DataFrame, shares: DataFrame) -> DataFrame:
    """Per-share owner-FCF growth between the first and last usable year; dropped
    when the base year earned under 2 % of its revenue."""
    pts = annual(s).where("owner_fcf IS NOT NULL").select("entity", "period_end", "owner_fcf", "revenue")
    at = asof.asof_join(pts, shares, "entity", "period_end", "end_day", ("value",)).where("value > 0")
    p = at.withColumn("ps", F.col("owner_fcf") / F.col("value"))
    g = p.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("period_end", "ps", "owner_fcf", "revenue"), "period_end").alias("b"),
        F.max_by(F.struct("period_end", "ps"), "period_end").alias("e"))
    usable = (F.col("n") >= 2) & (F.col("b.ps") > 0) & (F.col("e.ps") > 0)
    low = F.coalesce(usable & (F.col("b.revenue") > 0) & (F.col("b.owner_fcf") < V.LOW_BASE_FRACTION * F.col("b.revenue")), F.lit(False))
    growth = V.cagr_pct(F.col("b.period_end"), F.col("b.ps"), F.col("e.period_end"), F.col("e.ps"))
    return g.select("entity", F.when(usable & ~low, growth).alias("ps_growth"), low.alias("low_base"))


def annual_rows(s: DataFrame) -> DataFrame:
    """Annual rows of an entity as one array, newest first (one struct per year)."""
    a = annual(s)
    fields = [c for c in a.columns if c not in ("entity", "scope", "period_end")]
    return a.groupBy("entity").agg(F.reverse(F.array_sort(F.collect_list(F.struct("period_end", *fields)))).alias("years"))


def cadence(points, day: str = "period_end"):
    """Points (ascending array of structs) kept only when 300 days after the last kept."""
    def keep(acc, p):
        last = F.element_at(acc, -1)[day]
        return F.when((F.size(acc) == 0) | (F.datediff(p[day], last) >= MIN_ANNUAL_GAP_DAYS), F.concat(acc, F.array(p))).otherwise(acc)
    return F.aggregate(points, F.slice(points, 1, 0), keep)


def mad(rows: DataFrame, value: str, key: str = "entity", min_n: int = 2, below=None) -> DataFrame:
    """Mean absolute deviation from the mean per key; ``below`` where too few."""
    mean = rows.where(F.col(value).isNotNull()).withColumn("_m", F.avg(value).over(W.partitionBy(key)))
    return mean.groupBy(key).agg(F.when(F.count(value) >= min_n, F.avg(F.abs(F.col(value) - F.col("_m")))).otherwise(
        F.lit(below).cast("double")).alias("mad"), F.count(value).alias("n"))


def value_drawdown(points: DataFrame, value: str, key: str = "entity", day: str = "period_end") -> DataFrame:
    return series.drawdown(points, value, key=key, day=day)


def yoy(points: DataFrame, value: str = "revenue") -> DataFrame:
    """Percent change against the same month and day of the previous year."""
    prior = points.select("entity", F.add_months("period_end", 12).alias("period_end"), F.col(value).alias("_p")).where("_p <> 0")
    return (points.where(F.col(value) != 0).join(prior, ["entity", "period_end"])
            .select("entity", "period_end", (100.0 * (F.col(value) - F.col("_p")) / F.col("_p")).alias("yoy_pct")))


def carry_forward_gaps(rows: DataFrame, value: str, pays: DataFrame, max_age: int = 400) -> DataFrame:
    """Balance gaps on dates that hold assets and cash: the earlier value when 400
    days old or less, else left open if the entity pays interest, else 0."""
    run = W.partitionBy("entity").orderBy("period_end").rowsBetween(W.unboundedPreceding, -1)
    prior = F.last(F.when(F.col(value).isNotNull(), F.struct("period_end", value)), ignorenulls=True).over(run)
    j = rows.withColumn("_p", prior).join(pays, "entity", "left")
    near = F.datediff("period_end", F.col("_p.period_end")) <= max_age
    dated = F.col("total_assets").isNotNull() & F.col("cash").isNotNull()
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(
        dated, F.when(near, F.col(f"_p.{value}")).when(~F.coalesce("pays", F.lit(False)), 0.0))
    source = F.when(F.col(value).isNotNull(), "observed").when(dated & near, "carried").when(
        dated & ~F.coalesce("pays", F.lit(False)), "unlevered")
    return j.select("entity", "period_end", filled.alias(value), source.alias("source")).where(F.col(value).isNotNull())


def stress_periods(points: DataFrame, years: list, start_month: int = 6) -> DataFrame:
    """The annual period covering each stress year: ending in [Y-06-01, Y+1-05-31].
    The covering year is computed from the period, so nothing is range-joined."""
    covering = F.year("period_end") - F.when(F.month("period_end") < start_month, 1).otherwise(0)
    return points.withColumn("year", covering).where(F.col("year").isin(*years))


def yearly_issuance(shares: DataFrame) -> DataFrame:
    """Share steps on an annual cadence: a count within 300 days of the last kept one
    replaces it. (entity, end_day, issuance_pct)"""
    pts = shares.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("end_day", "value"))).alias("pts"))

    def fold(acc, p):
        last = F.element_at(acc, -1)
        far = (F.size(acc) == 0) | (F.datediff(p["end_day"], last["end_day"]) >= MIN_ANNUAL_GAP_DAYS)
        return F.when(far, F.concat(acc, F.array(p))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(p)))

    kept = pts.select("entity", F.aggregate("pts", F.slice("pts", 1, 0), fold).alias("k"))
    pairs = kept.select("entity", F.explode(F.zip_with(F.slice("k", 2, F.size("k")), F.slice("k", 1, F.greatest(F.size("k") - 1, F.lit(0))), lambda b, a: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    return pairs.where((a["value"] > 0) & (b["value"] > 0)).select("entity", b["end_day"].alias("end_day"), V.cagr_pct(a["end_day"], a["value"], b["end_day"], b["value"]).alias("issuance_pct"))
