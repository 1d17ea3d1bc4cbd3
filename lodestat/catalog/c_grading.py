"""Trailing metrics, vetoes, percentiles and grades."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog import reported, sqlx
from lodestat.catalog.registry import query, rnd, txt
from lodestat.functions import concepts, names
from lodestat.functions import valuation as V
from lodestat.operators import asof, cohorts, pit, ranks, rules
from lodestat.operators import statements as S
from lodestat.plans import chain
from lodestat.plans import evaluate as E
from lodestat.plans import grading as G
from lodestat.session import dealt, stage, staged

EV, SC = f"WITH {sqlx.SQL_EVAL}", f"WITH {sqlx.SQL_SCORE}"
ST = f"WITH {R.SQL_STATEMENTS}"
TTM = f"{ST}, {sqlx.SQL_TTM}"


def last_counts(filed):
    return dealt(filed, "entity", "end_day").groupBy("entity", "end_day").agg((F.max_by("value", F.struct("filed", "seq", "value")) / 10).alias("value"))


def counts(spark, d):
    return staged(spark, d, "counts", lambda: last_counts(R.share_counts(spark, d)))


def share_series(spark, d):
    return asof.restate(counts(spark, d), R.splits(spark, d))


def market(spark, d):
    bars = staged(spark, d, "bars", lambda: R.bars(spark, d))
    px = bars.groupBy(F.col("symbol").alias("entity")).agg(F.max_by("close", "day").alias("price"))
    n = counts(spark, d).groupBy("entity").agg(F.max_by("value", "end_day").alias("n"))
    cap = F.col("price") * F.col("n")
    return px.join(n, "entity").select("entity", cap.alias("market_cap"), "price", F.when(F.col("entity") % 4 == 0, cap * 0.7).alias("vendor_ev"))


def prepared(spark, d):
    """(evaluated, statements, shares), each computed once and staged."""
    st = staged(spark, d, "statements", lambda: R.statements(spark, d))
    sh = staged(spark, d, "shares", lambda: share_series(spark, d))
    meta = R.universe(spark, d).select(F.col("symbol").alias("entity"), "sector", "industry")
    return staged(spark, d, "evaluated", lambda: E.evaluate(st, sh, market(spark, d), meta)), st, sh


def evaluated(spark, d):
    return prepared(spark, d)[0]


def scored(spark, d):
    return staged(spark, d, "graded", lambda: G.score(evaluated(spark, d)))


# every statement column as a filed fact: flows over their span, the balance of a quarter at its day
AS_OF, ALL_FILED = "2000-06-30", "2100-01-01"
POINTS = S.BALANCE
FLOWS = tuple(c for c in R.LABELS if c not in POINTS)


def filed_statements(spark, d):
    """(entity, tag, start_day, end_day, filed, form, value, seq), filed 30 days after the end."""
    s = staged(spark, d, "statements", lambda: R.statements(spark, d))
    x = s.unpivot(["entity", "scope", "period_end"], list(R.LABELS), "tag", "value").where("value IS NOT NULL")
    point = F.col("tag").isin(*POINTS)
    start = F.when(~point, F.date_sub("period_end", F.when(F.col("scope") == "annual", 364).otherwise(89)))
    return x.where(~point | (F.col("scope") == "quarterly")).select("entity", "tag", start.alias("start_day"), F.col("period_end").alias("end_day"), F.date_add("period_end", 30).alias("filed"),
                                                                    F.lit("10-Q").alias("form"), "value", F.lit(0).cast("bigint").alias("seq"))


def market_at(spark, d, as_of):
    px = asof.latest_at(R.bars(spark, d), "symbol", "day", as_of, ("close",))
    px = px.where(F.datediff(F.lit(as_of).cast("date"), "day") <= asof.PRICE_MAX_AGE_DAYS).select(F.col("symbol").alias("entity"), F.col("close").alias("price"))
    known = last_counts(pit.visible(R.share_counts(spark, d), as_of))
    n = known.groupBy("entity").agg(F.max_by("value", "end_day").alias("n"))
    cap = F.col("price") * F.col("n")
    return px.join(n, "entity").select("entity", cap.alias("market_cap"), "price", F.when(F.col("entity") % 4 == 0, cap * 0.7).alias("vendor_ev"))


def known_only(sql: str, statements: str = R.SQL_STATEMENTS) -> str:
    """The same SQL over what was known at AS_OF, on the given statements."""
    sql = sql.replace(R.SQL_STATEMENTS, statements)
    for part, name, rule in ((statements, "stm", "period_end + 30 <="), (R.SQL_BARS, "bars", "day <="), (R.SQL_SHARES, "share_counts", "filed <="), (R.SQL_SPLITS, "splits", "day <=")):
        cut = f"{part.replace(f'{name} AS (', f'{name}_all AS (')}, {name} AS (SELECT * FROM {name}_all WHERE {rule} DATE '{AS_OF}')"
        sql = sql.replace(part, cut)
    return sql


def tagged_statements(spark, d, as_of):
    """Statements known at the date, from facts under the tags that companies use."""
    facts = reported.filed(staged(spark, d, "statements", lambda: R.statements(spark, d)))
    return stage(chain.statements_at(facts, as_of, reported.FLOWS, reported.POINTS, concepts.SPANS), "tagged")


GRADED_AT = f"WITH {known_only(sqlx.SQL_SCORE, reported.SQL_REPORTED)}"


def graded_at(spark, d):
    """Filed facts to sector grades at AS_OF."""
    meta = R.universe(spark, d).select(F.col("symbol").alias("entity"), "sector", "industry")
    counts = R.share_counts(spark, d)
    shares = stage(chain.shares_at(counts, R.splits(spark, d), AS_OF).withColumn("value", F.col("value") / 10), "shares")
    ev = stage(E.evaluate(tagged_statements(spark, d, AS_OF), shares, market_at(spark, d, AS_OF), meta), "evaluated")
    return G.score(ev)


@query("facts_to_grades", f"{GRADED_AT} SELECT entity, sector, grade, round(composite, 3) AS composite, basis FROM scored", digits=3)
def facts_to_grades(spark, d):
    """Filed facts to sector grades at a date."""
    return graded_at(spark, d).select("entity", "sector", "grade", "composite", "basis")


@query("ttm_all_or_null", f"{TTM} SELECT entity, basis, quarters, {txt('through')}, {', '.join(rnd(c, digits=4) for c in ('revenue', 'ebitda', 'ocf', 'capex', 'sbc', 'owner_fcf', 'interest', 'credit_loss'))} FROM ttm", digits=4)
def ttm_all_or_null(spark, d):
    return S.ttm(R.statements(spark, d)).select("entity", "basis", "quarters", "through", "revenue", "ebitda", "ocf", "capex", "sbc", "owner_fcf", "interest", "credit_loss")


@query("window_intersection", f"{TTM} SELECT entity, basis, {txt('through')} FROM ttm")
def window_intersection(spark, d):
    return S.ttm(R.statements(spark, d)).select("entity", "basis", "through")


@query("latest_balance", f"{ST}, {sqlx.SQL_BALANCE} SELECT entity, {txt('balance_end')}, {rnd('cash', digits=2)}, {rnd('debt', digits=2)}, {rnd('working_capital', digits=2)} FROM bal", digits=2)
def latest_balance(spark, d):
    return S.latest_balance(R.statements(spark, d)).select("entity", "balance_end", "cash", "debt", "working_capital")


METRICS = ("v_yield", "p_ofcf", "roic", "gm_level", "gm_cv", "ofcf_margin", "rev_growth", "ps_growth", "nd2e", "sbc_pct", "share_trend", "accrual", "gap_pct")


@query("evaluate", f"{reported.reported_sql(EV)} SELECT entity, sector, basis, {', '.join(rnd(m, digits=4) for m in METRICS)}, share_class, all_negative, required_gap, array_to_string(flags, ',') AS flags FROM ev", digits=4)
def evaluate(spark, d):
    """Metrics of every entity from facts under the tags that companies use."""
    meta = R.universe(spark, d).select(F.col("symbol").alias("entity"), "sector", "industry")
    ev = E.evaluate(tagged_statements(spark, d, ALL_FILED), staged(spark, d, "shares", lambda: share_series(spark, d)), market(spark, d), meta)
    return ev.select("entity", "sector", "basis", *METRICS, "share_class", "all_negative", "required_gap", F.array_join("flags", ",").alias("flags"))


@query("veto_ladder", f"{EV} SELECT entity, veto_rule IN (1, 2, 3, 4, 6) AS vetoed, CASE WHEN veto_rule = 7 THEN -15 ELSE 0 END AS penalty, {sqlx.REASON} AS reason FROM ev")
def veto_ladder(spark, d):
    return evaluated(spark, d).select("entity", "veto.vetoed", "veto.penalty", "veto.reason")


@query("first_missing_required", f"{EV} SELECT entity, required_gap FROM ev")
def first_missing_required(spark, d):
    return evaluated(spark, d).select("entity", "required_gap")


@query("flags", f"{EV} SELECT entity, array_to_string(CASE WHEN veto_rule = 5 AND required_gap IS NULL THEN list_append(flags, 'REINVESTOR') ELSE flags END, ',') AS flags FROM ev")
def flags(spark, d):
    e = evaluated(spark, d)
    spared = F.col("veto.reinvestor") & F.col("required_gap").isNull()
    return e.select("entity", F.array_join(F.when(spared, F.concat("flags", F.array(F.lit("REINVESTOR")))).otherwise(F.col("flags")), ",").alias("flags"))


@query("unfilled_metrics", f"{EV} SELECT entity, array_to_string(list_filter([{', '.join(f'''CASE WHEN {m} IS NULL THEN '{m}' END''' for m in METRICS)}], lambda x: x IS NOT NULL), ',') AS gaps FROM ev")
def unfilled_metrics(spark, d):
    gaps = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in METRICS]))
    return evaluated(spark, d).select("entity", F.array_join(gaps, ",").alias("gaps"))


@query("sector_percentile", f"""{ST}, x AS (SELECT entity, revenue, sector FROM (SELECT * FROM stm WHERE scope = 'quarterly') s JOIN (SELECT s_suppkey, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) u ON u.s_suppkey = s.entity)
  SELECT entity, sector, revenue, round(50.0 * ((rank() OVER (PARTITION BY sector ORDER BY revenue) - 1) + count(*) OVER (PARTITION BY sector ORDER BY revenue RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / count(*) OVER (PARTITION BY sector), 6) AS pct,
   count(*) OVER (PARTITION BY sector) AS pct_n FROM x""")
def sector_percentile(spark, d):
    s = R.statements(spark, d).where("scope = 'quarterly'").select("entity", "revenue")
    meta = R.universe(spark, d).select(F.col("symbol").alias("entity"), "sector")
    return ranks.with_percentile(stage(s.join(meta, "entity"), "revenue"), ["sector"], "revenue", "pct")


@query("score_universe", f"""{SC} SELECT entity, sector, grade, {', '.join(f'round({p}, 4) AS {p}' for p in 'vqgdm')}, round(composite, 3) AS composite, round(quality_score, 3) AS quality_score, note FROM scored""", digits=4)
def score_universe(spark, d):
    return scored(spark, d).select("entity", "sector", "grade", *"vqgdm", F.round("composite", 3).alias("composite"), F.round("quality_score", 3).alias("quality_score"), "note")


@query("pillar_mean", "SELECT s_suppkey AS entity, round(" + sqlx.mean("CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END", "CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey * 1.0 END", "CASE WHEN s_suppkey % 5 = 0 THEN 10.0 END") + ", 6) AS mean FROM supplier")
def pillar_mean(spark, d):
    k = F.col("s_suppkey")
    legs = (F.when(k % 2 == 0, F.col("s_acctbal")), F.when(k % 3 == 0, F.col("s_nationkey") * 1.0), F.when(k % 5 == 0, 10.0))
    return R.table(spark, d, "supplier").select(k.alias("entity"), V.mean_present(*legs).alias("mean"))


@query("roic_floor", f"{EV} SELECT entity, round(greatest(0.0, least(1.0, roic / 15.0)), 6) AS factor FROM ev WHERE roic IS NOT NULL")
def roic_floor(spark, d):
    return evaluated(spark, d).where("roic IS NOT NULL").select("entity", V.roic_floor(F.col("roic")).alias("factor"))


@query("composite_grade", f"{SC} SELECT entity, round(composite, 3) AS composite, grade FROM scored WHERE composite IS NOT NULL", digits=3)
def composite_grade(spark, d):
    return scored(spark, d).where("composite IS NOT NULL").select("entity", "composite", "grade")


@query("roic", f"{EV} SELECT entity, {rnd('roic', digits=4)}, roic_capped FROM ev", digits=4)
def roic(spark, d):
    return evaluated(spark, d).select("entity", "roic", "roic_capped")


@query("owner_fcf", f"{ST} SELECT entity, scope, {txt('period_end')}, round({sqlx.OWNER}, 6) AS owner_fcf FROM stm")
def owner_fcf(spark, d):
    return R.statements(spark, d).select("entity", "scope", "period_end", V.owner_fcf().alias("owner_fcf"))


_ADDED = " + ".join(f'coalesce("{row}", 0)' for row in concepts.CREDIT_LOSS_ROWS if row in reported.ROWS)


@query("credit_loss", f"""WITH {reported.SQL_ROWS}, x AS (SELECT entity, period_end, {_ADDED} AS add_backs, "Operating Cash Flow" AS ocf FROM vendor WHERE scope = 'annual')
  SELECT entity, {txt('period_end')}, round(add_backs, 6) AS add_backs, round(CASE WHEN ocf > 0 THEN add_backs / ocf END, 6) AS share_of_ocf FROM x""")
def credit_loss(spark, d):
    """Add-back rows of a year, summed where present, and their share of operating cash."""
    by = ("entity", "period_end")
    years = R.statements(spark, d).where("scope = 'annual'")
    table = {**concepts.CREDIT_LOSS, "ocf": concepts.ROWS["ocf"]}
    w = rules.wide(rules.resolve(reported.rows(years), table, "row", by), table, by)
    loss = F.coalesce("credit_loss", F.lit(0.0))
    return years.select(*by).join(w, list(by), "left").select(*by, loss.alias("add_backs"), F.when(F.col("ocf") > 0, loss / F.col("ocf")).alias("share_of_ocf"))


def _row_chain_sql() -> str:
    """Long rows of every label: the value and the row that it came from, by a CASE along the chain."""
    arms = []
    for label, rule in {**concepts.ROWS, "deferred": None}.items():
        if label == "deferred":
            cur, non = '"Current Deferred Revenue"', '"Non Current Deferred Revenue"'
            value = f'CASE WHEN {cur} IS NOT NULL THEN {cur} + coalesce({non}, 0) ELSE "Deferred Revenue" END'
            source = f"CASE WHEN {cur} IS NULL THEN 'Deferred Revenue' WHEN {non} IS NULL THEN 'Current Deferred Revenue' ELSE 'Current Deferred Revenue + Non Current Deferred Revenue' END"
        else:
            have = [row for row in rule if row in reported.ROWS]
            if not have:
                continue
            value = "coalesce(" + ", ".join(f'"{row}"' for row in have) + ")"
            source = "CASE " + " ".join(f"""WHEN "{row}" IS NOT NULL THEN '{row}'""" for row in have) + " END"
        arms.append(f"SELECT entity, scope, period_end, '{label}' AS label, {value} AS value, {source} AS source FROM vendor")
    return " UNION ALL ".join(arms)


@query("row_chain", f"WITH {reported.SQL_ROWS}, x AS ({_row_chain_sql()}) SELECT entity, scope, {txt('period_end')}, label, round(value, 4) AS value, source FROM x WHERE value IS NOT NULL", digits=4)
def row_chain(spark, d):
    """Every label of a vendor's statement by its chain or sum of rows, with the rows that it came from."""
    by = ("entity", "scope", "period_end")
    out = rules.resolve(reported.rows(R.statements(spark, d)), {**concepts.ROWS, **concepts.DEFERRED}, "row", by)
    return out.select(*by, "label", "value", F.array_join("names", " + ").alias("source"))


@query("cagr", f"{ST}, {sqlx.SQL_TTM}, {R.SQL_SHARES}, {R.SQL_SPLITS}, ser0 AS (SELECT entity, end_day, arg_max(value, (filed, seq, value)) / 10 AS value FROM share_counts GROUP BY ALL), shr AS (SELECT * FROM ser0), {sqlx.SQL_ANNUAL} SELECT entity, {rnd('rev_growth', digits=4)} FROM af", digits=4)
def cagr(spark, d):
    return S.annual_facts(R.statements(spark, d)).select("entity", "rev_growth")


@query("margin_cv", f"{EV} SELECT entity, gm_periods, {rnd('gm_cv')} FROM ev")
def margin_cv(spark, d):
    return evaluated(spark, d).select("entity", "gm_periods", "gm_cv")


@query("all_negative", f"{EV} SELECT entity, all_negative, fcf_periods FROM ev")
def all_negative(spark, d):
    return evaluated(spark, d).select("entity", "all_negative", "fcf_periods")


@query("per_share_growth", f"{EV} SELECT entity, {rnd('ps_growth', digits=4)}, low_base FROM ev", digits=4)
def per_share_growth(spark, d):
    return evaluated(spark, d).select("entity", "ps_growth", "low_base")


@query("screen_quality_value", f"""{EV}, u AS (SELECT symbol FROM universe WHERE cap_bucket IS NOT NULL)
  SELECT entity, round(own_ev / ebitda, 4) AS ev_ebitda FROM ev WHERE roic > 15 AND equity > 0 AND debt / equity < 1 AND ebitda > 0 AND own_ev IS NOT NULL AND entity IN (SELECT symbol FROM u) ORDER BY own_ev / ebitda, entity LIMIT 20""", digits=4)
def screen_quality_value(spark, d):
    """ROIC over 15 %, debt below equity, in the universe, cheapest 20 by EV/EBITDA."""
    u = R.universe(spark, d).where("cap_bucket IS NOT NULL").select(F.col("symbol").alias("entity"))
    e = evaluated(spark, d).where("roic > 15 AND equity > 0 AND debt < equity AND ebitda > 0 AND own_ev IS NOT NULL").join(u, "entity", "left_semi")
    return e.select("entity", (F.col("own_ev") / F.col("ebitda")).alias("ev_ebitda")).orderBy("ev_ebitda", "entity").limit(20)


@query("veto_breakdown", f"""{SC}, b AS (SELECT split_part(note, ':', 1) AS family, trim(regexp_replace(split_part(note, ':', 2), '[0-9]+([.,][0-9]+)?%? > |[+]?[0-9]+[.][0-9]%/yr |leans [0-9]+%', '…', 'g')) AS detail FROM scored WHERE grade = 'VETOED')
  SELECT family, CASE WHEN GROUPING(detail) = 1 THEN NULL ELSE detail END AS detail, count(*) AS n FROM b GROUP BY ROLLUP (family, detail)""")
def veto_breakdown(spark, d):
    """Vetoes by family and sub-reason with subtotals."""
    v = scored(spark, d).where("grade = 'VETOED'").select(F.split(F.col("note"), ":").alias("p"))
    masked = F.trim(F.regexp_replace(F.col("p")[1], r"[0-9]+([.,][0-9]+)?%? > |[+]?[0-9]+[.][0-9]%/yr |leans [0-9]+%", "…"))
    return v.select(F.col("p")[0].alias("family"), masked.alias("detail")).rollup("family", "detail").agg(F.count("*").alias("n"))


GRADES = ("A", "B", "C", "D", "F", "VETOED", "INSUFFICIENT")


@query("distribution", f"""{SC}, g(grade) AS (VALUES {', '.join(f"('{x}')" for x in GRADES)}) SELECT g.grade, count(entity) AS n, CAST(round_even(100.0 * count(entity) / (SELECT count(*) FROM scored), 0) AS BIGINT) AS pct FROM g LEFT JOIN scored ON scored.grade = g.grade GROUP BY g.grade""")
def distribution(spark, d):
    """Counts and whole percent by grade, all grades shown."""
    counts = scored(spark, d).groupBy("grade").agg(F.count("*").alias("n"))
    cats = spark.createDataFrame([(g,) for g in GRADES], "grade string")
    total = F.sum("n").over(W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return cats.join(counts, "grade", "left").fillna(0, ["n"]).select("grade", "n", F.bround(100.0 * F.col("n") / total).cast("bigint").alias("pct"))


@query("gate_coverage", f"{SC} SELECT count(*) FILTER (grade IN ('A', 'B', 'C', 'D', 'F')) AS judged, count(*) FILTER (grade = 'INSUFFICIENT') AS unjudged, count(*) FILTER (grade = 'VETOED') AS blocked FROM scored")
def gate_coverage(spark, d):
    g = F.col("grade")
    return scored(spark, d).agg(F.count_if(g.isin("A", "B", "C", "D", "F")).alias("judged"), F.count_if(g == "INSUFFICIENT").alias("unjudged"), F.count_if(g == "VETOED").alias("blocked"))


# industries by company, so that every tier holds names
INDUSTRY = "CASE entity % 5 WHEN 0 THEN 'Software' WHEN 1 THEN 'IT Services' WHEN 2 THEN 'Capital Markets' WHEN 3 THEN 'Shipping' END"
TIER_SQL = "CASE WHEN entity % 5 = 0 THEN 'Core' WHEN entity % 5 IN (1, 2) THEN 'Adjacent' ELSE 'Outside' END"


@query("shortlist_per_tier", f"""{SC}, t AS (SELECT entity, {TIER_SQL} AS tier, grade, composite FROM scored WHERE composite IS NOT NULL AND grade IN ('A', 'B', 'C', 'D', 'F')), k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY composite DESC, entity) AS rn FROM t)
  SELECT entity, tier, grade, round(composite, 3) AS composite, rn > 3 AS star FROM k WHERE rn <= 3 OR (tier = 'Outside' AND grade = 'A')""", digits=3)
def shortlist_per_tier(spark, d):
    """Top three of each tier of industries, and every A of the outside tier."""
    return cohorts.tier_shortlist(scored(spark, d).withColumn("tier", names.industry_tier(F.expr(INDUSTRY))), 3)


@query("portfolio_clamp", f"""{SC}, t AS (SELECT entity, composite FROM scored WHERE composite > 0 ORDER BY composite DESC, entity LIMIT 15), w AS (SELECT entity, composite / sum(composite) OVER () AS weight FROM t),
  c AS (SELECT entity, least(weight, 0.1) AS clamped, weight FROM w)
  SELECT entity, round(clamped / greatest(1.0, sum(clamped) OVER ()), 6) AS weight, weight > 0.1 AS limited FROM c""")
def portfolio_clamp(spark, d):
    """Conviction weights of the top 15, each clamped to 10 %, the whole to 100 %."""
    top = scored(spark, d).where("composite > 0").orderBy(F.desc("composite"), "entity").limit(15).select("entity", "composite")
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)      # 15 rows
    w = top.withColumn("raw", F.col("composite") / F.sum("composite").over(every))
    c = w.withColumn("clamped", F.least("raw", F.lit(0.1)))
    return c.select("entity", (F.col("clamped") / F.greatest(F.lit(1.0), F.sum("clamped").over(every))).alias("weight"), (F.col("raw") > 0.1).alias("limited"))
