"""Statement series, fragility probes and verdicts."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog import reported, sqlx
from lodestat.catalog.c_grading import prepared, share_series
from lodestat.catalog.c_series import LEV, MOM, RET, dd_sql
from lodestat.catalog.registry import query, rnd, txt
from lodestat.functions import concepts
from lodestat.operators import fragility as X
from lodestat.operators import pit, rules, series
from lodestat.operators import statements as S
from lodestat.plans import fragile
from lodestat.session import stage, staged

ST = f"WITH {R.SQL_STATEMENTS}, dv AS (SELECT *, ebit + da AS ebitda, {sqlx.OWNER} AS owner_fcf FROM stm), an AS (SELECT * FROM dv WHERE scope = 'annual')"
EV = f"WITH {sqlx.SQL_EVAL}"
STRESS_YEARS = [1998, 2000]


def annual(spark, d):
    return S.annual(R.statements(spark, d))


@query("gross_profit", f"{ST} SELECT entity, {txt('period_end')}, round(coalesce(gross_profit, revenue - cost), 6) AS gross_profit FROM an")
def gross_profit(spark, d):
    return annual(spark, d).select("entity", "period_end", F.coalesce("gross_profit", F.col("revenue") - F.col("cost")).alias("gross_profit"))


COMPOSED = ("debt", "nci", "working_capital")


@query("debt_composition", f"""WITH {reported.SQL_REPORTED}, x AS (SELECT entity, period_end, debt, nci, current_assets - current_liabilities AS working_capital FROM stm WHERE scope = 'quarterly')
  SELECT entity, {txt('period_end')}, round(debt, 6) AS debt, round(nci, 6) AS nci, round(working_capital, 6) AS working_capital FROM x WHERE coalesce(debt, nci, working_capital) IS NOT NULL""")
def debt_composition(spark, d):
    """Composed balances of each date: debt as the long-term chain, else noncurrent, current and short pieces (a missing one is 0
    only beside a long-term piece); minority interest and working capital as differences of which both sides must be there."""
    known = pit.latest_filed(reported.filed(R.statements(spark, d).where("scope = 'quarterly'")).where("start_day IS NULL"), instant=True)
    composed = {c: concepts.POINTS[c] for c in COMPOSED}
    return rules.wide(rules.resolve(known, composed), composed).select("entity", F.col("end_day").alias("period_end"), *COMPOSED)


SECTION = ("cash", "debt", "equity", "nci", "goodwill")


@query("section_pivot", f"{ST} SELECT entity, {txt('period_end')}, array_to_string(list_filter([{', '.join(f'''CASE WHEN {c} IS NOT NULL THEN '{c}' END''' for c in sorted(SECTION))}], lambda x: x IS NOT NULL), ',') AS labels, round({' + '.join(f'coalesce({c}, 0)' for c in SECTION)}, 4) AS total FROM dv WHERE scope = 'quarterly' AND coalesce({', '.join(SECTION)}) IS NOT NULL", digits=4)
def section_pivot(spark, d):
    """Long (label, period, value) rows as one label -> value map per period."""
    s = R.statements(spark, d).where("scope = 'quarterly'").unpivot(["entity", "period_end"], list(SECTION), "label", "value").where("value IS NOT NULL")
    m = s.groupBy("entity", "period_end").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("m"))
    total = sum(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) for c in SECTION)
    return m.select("entity", "period_end", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("labels"), total.alias("total"))


@query("value_drawdown", f"{ST}, {dd_sql('(SELECT * FROM an WHERE owner_fcf IS NOT NULL)', 'owner_fcf', 'entity', 'period_end')} SELECT k AS entity, round(drawdown, 6) AS drawdown, round(peak, 4) AS peak, {txt('peak_day')}, {txt('trough_day')}, positive_peaks FROM dd")
def value_drawdown(spark, d):
    dd = S.value_drawdown(annual(spark, d).where("owner_fcf IS NOT NULL"), "owner_fcf")
    return dd.select("entity", "drawdown", F.round("peak", 4).alias("peak"), "peak_day", "trough_day", "positive_peaks")


OM = "om AS (SELECT entity, period_end, ebit / revenue AS m FROM an WHERE revenue > 0 AND ebit IS NOT NULL)"


@query("mean_abs_dev", f"{ST}, {OM}, a AS (SELECT *, avg(m) OVER (PARTITION BY entity) AS mu FROM om) SELECT entity, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(avg(abs(m - mu)), 6) END AS mad FROM a GROUP BY entity")
def mean_abs_dev(spark, d):
    m = annual(spark, d).where("revenue > 0 AND ebit IS NOT NULL").select("entity", (F.col("ebit") / F.col("revenue")).alias("m"))
    return S.mad(m, "m").select("entity", "n", "mad")


@query("yoy_same_day", f"{ST}, q AS (SELECT entity, period_end, revenue FROM dv WHERE scope = 'quarterly' AND revenue <> 0) SELECT a.entity, {txt('a.period_end', 'period_end')}, round(100.0 * (a.revenue - b.revenue) / b.revenue, 4) AS yoy_pct FROM q a JOIN q b ON a.entity = b.entity AND month(a.period_end) = month(b.period_end) AND year(a.period_end) = year(b.period_end) + 1", digits=4)
def yoy_same_day(spark, d):
    return S.yoy(R.statements(spark, d).where("scope = 'quarterly'").select("entity", "period_end", "revenue"))


@query("fragility_series", f"{ST} SELECT entity, {txt('period_end')}, round((debt - cash) / ebitda, 4) AS nd2e FROM dv WHERE scope = 'quarterly' AND debt IS NOT NULL AND cash IS NOT NULL AND ebitda <> 0", digits=4)
def fragility_series(spark, d):
    s = S.derived(R.statements(spark, d)).where("scope = 'quarterly' AND debt IS NOT NULL AND cash IS NOT NULL AND ebitda <> 0")
    return s.select("entity", "period_end", ((F.col("debt") - F.col("cash")) / F.col("ebitda")).alias("nd2e"))


@query("carry_forward", f"""{ST}, q AS (SELECT entity, period_end, debt, total_assets, cash FROM dv WHERE scope = 'quarterly'), pay AS (SELECT entity, max(interest) > 15000 AS pays FROM dv WHERE scope = 'quarterly' GROUP BY entity),
  o AS (SELECT entity, period_end AS pe, debt AS pd FROM q WHERE debt IS NOT NULL), p AS (SELECT q.*, pe, pd FROM q ASOF LEFT JOIN o ON o.entity = q.entity AND q.period_end > o.pe),
  f AS (SELECT p.entity, period_end, CASE WHEN debt IS NOT NULL THEN debt WHEN cash IS NOT NULL THEN CASE WHEN period_end - pe <= 100 THEN pd WHEN NOT coalesce(pays, false) THEN 0 END END AS v,
    CASE WHEN debt IS NOT NULL THEN 'observed' WHEN cash IS NOT NULL AND period_end - pe <= 100 THEN 'carried' WHEN cash IS NOT NULL AND NOT coalesce(pays, false) THEN 'unlevered' END AS source FROM p LEFT JOIN pay ON pay.entity = p.entity)
  SELECT entity, {txt('period_end')}, round(v, 6) AS debt, source FROM f WHERE v IS NOT NULL""")
def carry_forward(spark, d):
    s = R.statements(spark, d).where("scope = 'quarterly'")
    pays = s.groupBy("entity").agg((F.max("interest") > 15000).alias("pays"))
    return S.carry_forward_gaps(s.select("entity", "period_end", "debt", "total_assets", "cash"), "debt", pays, max_age=100)


@query("statement_freshness", f"""{ST}, g AS (SELECT entity, max(CASE WHEN entity % 4 = 0 THEN period_end - 200 ELSE period_end END) AS newest FROM dv WHERE scope = 'quarterly' GROUP BY entity)
  SELECT entity, {txt('newest')}, CASE WHEN newest + 20 + CAST(entity % 60 AS INTEGER) <= DATE '2002-02-10' AND DATE '2002-02-10' - (newest + 20 + CAST(entity % 60 AS INTEGER)) > 14 THEN 'STALE' WHEN DATE '2002-02-10' - newest > 135 THEN 'STALE' ELSE 'FRESH' END AS state FROM g""")
def statement_freshness(spark, d):
    """Stale 14 days past the expected date of the next statement, or at 135 days."""
    at = F.lit("2002-02-10").cast("date")
    g = R.statements(spark, d).where("scope = 'quarterly'").groupBy("entity").agg(F.max(F.expr("if(entity % 4 = 0, date_sub(period_end, 200), period_end)")).alias("newest"))
    due = F.date_add("newest", (20 + F.col("entity") % 60).cast("int"))
    late = (due > F.col("newest")) & (due <= at) & (F.datediff(at, due) > 14)
    return g.select("entity", "newest", F.when(late | (F.datediff(at, "newest") > 135), "STALE").otherwise("FRESH").alias("state"))


@query("stress_window", f"{ST} SELECT entity, y AS year, {txt('max(period_end)', 'period_end')}, round(arg_max(owner_fcf, period_end), 4) AS owner_fcf FROM an, (VALUES (1998), (2000)) t(y) WHERE owner_fcf IS NOT NULL AND period_end BETWEEN make_date(y, 6, 1) AND make_date(y + 1, 5, 31) GROUP BY entity, y", digits=4)
def stress_window(spark, d):
    p = S.stress_periods(annual(spark, d).where("owner_fcf IS NOT NULL").select("entity", "period_end", "owner_fcf"), STRESS_YEARS)
    return p.groupBy("entity", "year").agg(F.max("period_end").alias("period_end"), F.max_by("owner_fcf", "period_end").alias("owner_fcf"))


@query("annual_cadence", f"""{ST.replace('WITH', 'WITH RECURSIVE', 1)}, p AS (SELECT entity, period_end, owner_fcf, row_number() OVER (PARTITION BY entity ORDER BY period_end, owner_fcf) AS rn FROM dv WHERE owner_fcf IS NOT NULL AND scope = 'quarterly'),
  k AS (SELECT entity, rn, period_end AS last, true AS kept, owner_fcf FROM p WHERE rn = 1
    UNION ALL SELECT p.entity, p.rn, CASE WHEN p.period_end - k.last >= 300 THEN p.period_end ELSE k.last END, p.period_end - k.last >= 300, p.owner_fcf FROM k JOIN p ON p.entity = k.entity AND p.rn = k.rn + 1)
  SELECT entity, {txt('last', 'period_end')}, round(owner_fcf, 4) AS owner_fcf FROM k WHERE kept""", digits=4)
def annual_cadence(spark, d):
    """Points of every scope thinned to 300 days apart."""
    p = S.derived(R.statements(spark, d)).where("owner_fcf IS NOT NULL AND scope = 'quarterly'").groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("period_end", F.col("owner_fcf").alias("v")))).alias("pts"))
    kept = p.select("entity", F.explode(S.cadence(F.col("pts"))).alias("k"))
    return kept.select("entity", "k.period_end", F.col("k.v").alias("owner_fcf"))


@query("yearly_issuance", f"""WITH {sqlx.SQL_MARKET}, y AS (SELECT entity, max(end_day) AS end_day, arg_max(value, end_day) AS value FROM shr GROUP BY entity, year(end_day)),
  g AS (SELECT *, lag(end_day) OVER w AS prev FROM y WINDOW w AS (PARTITION BY entity ORDER BY end_day)), n AS (SELECT *, sum(CASE WHEN prev IS NULL OR end_day - prev >= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY end_day) AS step FROM g),
  k AS (SELECT entity, step, max(end_day) AS d1, arg_max(value, end_day) AS v1 FROM n GROUP BY entity, step), z AS (SELECT *, lag(d1) OVER w AS d0, lag(v1) OVER w AS v0 FROM k WINDOW w AS (PARTITION BY entity ORDER BY step))
  SELECT entity, {txt('d1', 'end_day')}, round({sqlx.cagr('d0', 'v0', 'd1', 'v1')}, 6) AS issuance_pct FROM z WHERE v0 > 0 AND v1 > 0""")
def yearly_issuance(spark, d):
    """Share steps on an annual cadence (the newest count of a year wins), annualised."""
    yearly = share_series(spark, d).groupBy("entity", F.year("end_day").alias("y")).agg(F.max_by("value", "end_day").alias("value"), F.max("end_day").alias("end_day"))
    return S.yearly_issuance(yearly.drop("y"))


CE = f"""{dd_sql('(SELECT * FROM an WHERE owner_fcf IS NOT NULL)', 'owner_fcf', 'entity', 'period_end').replace('(1 - 1e-9)', '1.0')},
  ce0 AS (SELECT k AS entity, bars >= 3 AS measured, positive_peaks AS ran, CASE WHEN positive_peaks THEN greatest(drawdown, -1.0) ELSE -1.0 END AS depth, recovered AS back, trough FROM dd),
  ce AS (SELECT entity, measured, CASE WHEN NOT measured THEN 'none' WHEN NOT ran OR (NOT back AND (trough < 0 OR depth <= -0.6)) THEN 'severe' WHEN depth <= -0.6 OR (NOT back AND depth <= -0.35) THEN 'caution' ELSE 'none' END AS severity, CASE WHEN measured THEN depth END AS value FROM ce0)"""


@query("probe_cash_engine", f"{ST}, {CE} SELECT entity, measured, severity, {rnd('value')} FROM ce")
def probe_cash_engine(spark, d):
    return X.cash_engine(annual(spark, d))


SS = """sp AS (SELECT entity, period_end, owner_fcf, max(owner_fcf) OVER (PARTITION BY entity ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk, max(owner_fcf) OVER (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lt FROM an WHERE owner_fcf IS NOT NULL),
  st2 AS (SELECT entity, (owner_fcf - pk) / pk AS s, coalesce(lt >= pk, false) AS bk FROM sp WHERE year(period_end) IN (1998, 2000) AND pk > 0),
  sg AS (SELECT entity, bool_or(s <= -0.6 AND NOT bk) AS a, bool_or(s <= -0.6 OR (s <= -0.35 AND NOT bk)) AS b, min(s) AS value FROM st2 GROUP BY entity),
  ss AS (SELECT e.entity, value IS NOT NULL AS measured, CASE WHEN value IS NULL THEN 'none' WHEN a THEN 'severe' WHEN b THEN 'caution' ELSE 'none' END AS severity, value FROM (SELECT DISTINCT entity FROM an) e LEFT JOIN sg ON sg.entity = e.entity)"""


@query("probe_stress", f"{ST}, {SS} SELECT entity, measured, severity, {rnd('value')} FROM ss")
def probe_stress(spark, d):
    return X.stress(annual(spark, d), STRESS_YEARS)


PR = f"""{OM}, rv AS (SELECT entity, period_end, revenue, count(*) OVER (PARTITION BY entity) AS n FROM an WHERE revenue > 0),
  gr AS (SELECT entity, revenue / lag(revenue) OVER (PARTITION BY entity ORDER BY period_end) - 1 AS g FROM rv WHERE n >= 5 QUALIFY g IS NOT NULL),
  ga AS (SELECT entity, CASE WHEN count(*) >= 2 THEN avg(abs(g - mu)) END AS gm FROM (SELECT *, avg(g) OVER (PARTITION BY entity) AS mu FROM gr) GROUP BY entity),
  ma AS (SELECT entity, CASE WHEN count(*) >= 5 THEN avg(abs(m - mu)) END AS mm FROM (SELECT *, avg(m) OVER (PARTITION BY entity) AS mu FROM om) GROUP BY entity),
  pj AS (SELECT e.entity, gm, mm, CASE WHEN gm >= 0.2 THEN 2 WHEN gm >= 0.1 THEN 1 ELSE 0 END AS gs, CASE WHEN mm >= 0.1 THEN 2 WHEN mm >= 0.05 THEN 1 ELSE 0 END AS ms FROM (SELECT DISTINCT entity FROM an) e LEFT JOIN ga ON ga.entity = e.entity LEFT JOIN ma ON ma.entity = e.entity),
  pr AS (SELECT entity, gm IS NOT NULL OR mm IS NOT NULL AS measured, CASE greatest(gs, ms) WHEN 2 THEN 'severe' WHEN 1 THEN 'caution' ELSE 'none' END AS severity,
    CASE WHEN gs > ms OR (gs = ms AND (gm IS NOT NULL OR mm IS NULL)) THEN gm ELSE mm END AS value FROM pj)"""


@query("probe_predictability", f"{ST}, {PR} SELECT entity, measured, severity, {rnd('value')} FROM pr")
def probe_predictability(spark, d):
    return X.predictability(annual(spark, d))


FI = """pdd AS (SELECT k, drawdown, peak_day, trough_day FROM dd), pk1 AS (SELECT p.*, s.value AS at_peak FROM pdd p ASOF LEFT JOIN shr s ON s.entity = p.k AND p.peak_day >= s.end_day),
  pk2 AS (SELECT p.*, s.value AS at_trough FROM pk1 p ASOF LEFT JOIN shr s ON s.entity = p.k AND p.trough_day >= s.end_day),
  fw AS (SELECT ev.entity, CASE WHEN current_debt IS NOT NULL AND cash IS NOT NULL THEN CASE WHEN cash + greatest(coalesce(owner_fcf, 0), 0) > 0 THEN current_debt / (cash + greatest(coalesce(owner_fcf, 0), 0)) END END AS wall,
    CASE WHEN NOT share_class AND drawdown <= -0.3 AND ev.entity IN (SELECT symbol FROM splits) AND at_peak > 0 AND abs(at_trough / at_peak - 1) <= 1 THEN at_trough / at_peak - 1 END AS dil FROM ev LEFT JOIN pk2 ON pk2.k = ev.entity),
  fs AS (SELECT *, CASE WHEN wall >= 1 THEN 2 WHEN wall >= 0.5 THEN 1 ELSE 0 END AS ws, CASE WHEN dil >= 0.1 THEN 2 WHEN dil >= 0.03 THEN 1 ELSE 0 END AS ds FROM fw),
  fi AS (SELECT entity, wall IS NOT NULL OR dil IS NOT NULL AS measured, CASE greatest(ws, ds) WHEN 2 THEN 'severe' WHEN 1 THEN 'caution' ELSE 'none' END AS severity, CASE WHEN ws >= ds AND wall IS NOT NULL THEN wall ELSE dil END AS value FROM fs)"""
PDD = f"{LEV}, {dd_sql('lev', 'level', 'symbol', 'day')}"


@query("probe_financing", f"{EV}, {PDD}, {FI} SELECT entity, measured, severity, {rnd('value', digits=5)} FROM fi", digits=5)
def probe_financing(spark, d):
    e, _, sh = prepared(spark, d)
    return X.financing(fragile.financing_inputs(e, stage(X.falls(R.bars(spark, d)), "falls"), sh, R.splits(spark, d)))


def _as(name, sub):
    """The drawdown CTE chain under its own prefix, so two may sit side by side."""
    return sub.replace("ddp", f"{name}p").replace("ddf", f"{name}f").replace("ddw", f"{name}w").replace("dd AS", f"{name} AS").replace("FROM dd)", f"FROM {name})")


FINDINGS = f"""{EV}, {PDD}, {FI}, {RET}, {MOM}, {_as('cdd', CE)}, {SS}, {PR},
  fd AS (SELECT k AS entity, 'price_drawdown' AS probe, bars - 1 >= 52 AS measured, CASE WHEN bars - 1 < 52 THEN 'none' WHEN drawdown <= -0.6 AND NOT recovered THEN 'severe' WHEN drawdown <= -0.6 OR (drawdown <= -0.4 AND NOT recovered) THEN 'caution' ELSE 'none' END AS severity FROM dd
   UNION ALL SELECT symbol, 'return_asymmetry', bars >= 52, CASE WHEN bars < 52 THEN 'none' WHEN skew < -0.5 AND coalesce(tail_ratio < 0.9, false) THEN 'severe' WHEN skew < -0.5 OR coalesce(tail_ratio < 0.9, false) THEN 'caution' ELSE 'none' END FROM mo
   UNION ALL SELECT entity, 'cash_engine', measured, severity FROM ce UNION ALL SELECT entity, 'stress', measured, severity FROM ss UNION ALL SELECT entity, 'predictability', measured, severity FROM pr UNION ALL SELECT entity, 'financing', measured, severity FROM fi),
  vg AS (SELECT entity, count(*) FILTER (severity = 'severe') AS severe, count(*) FILTER (severity = 'caution') AS caution, count(*) FILTER (measured) AS measured, NOT bool_or(probe = 'price_drawdown' AND measured) OR NOT bool_or(probe = 'cash_engine' AND measured) OR count(*) FILTER (measured) < 4 AS thin FROM fd GROUP BY entity),
  vd AS (SELECT *, CASE WHEN thin AND severe = 0 AND caution < 4 THEN 'Unknown' WHEN severe >= 3 THEN 'Ruinous' WHEN severe >= 2 OR caution >= 4 THEN 'Fragile' WHEN severe > 0 OR caution > 0 THEN 'Ordinary' ELSE 'Robust' END AS verdict FROM vg)"""


def findings(spark, d):
    e, st, sh = prepared(spark, d)
    bars = staged(spark, d, "bars", lambda: R.bars(spark, d))
    return staged(spark, d, "findings", lambda: fragile.findings(st, e, bars, sh, R.splits(spark, d), STRESS_YEARS))


@query("verdict_ladder", f"{FINDINGS} SELECT entity, severe, caution, measured, thin, verdict FROM vd")
def verdict_ladder(spark, d):
    return X.verdicts(findings(spark, d))


@query("failure_mode_order", f"{FINDINGS} SELECT entity, string_agg(severity || ':' || probe, ';' ORDER BY severity = 'caution', list_position(['price_drawdown', 'return_asymmetry', 'cash_engine', 'stress', 'predictability', 'financing'], probe)) AS modes FROM fd WHERE severity <> 'none' GROUP BY entity")
def failure_mode_order(spark, d):
    return X.failure_modes(findings(spark, d)).select("entity", F.array_join("modes", ";").alias("modes"))


@query("probe_registry", f"{FINDINGS}, th(probe, severe_line, caution_line) AS (VALUES ('price_drawdown', -0.6, -0.4), ('cash_engine', -0.6, -0.35), ('stress', -0.6, -0.35)) SELECT th.probe, severe_line::DOUBLE AS severe_line, caution_line::DOUBLE AS caution_line, count(*) FILTER (severity = 'severe') AS severe, count(*) FILTER (severity = 'caution') AS caution, count(*) FILTER (measured) AS measured FROM fd JOIN th ON th.probe = fd.probe GROUP BY ALL")
def probe_registry(spark, d):
    """Declared probes with their thresholds as data, joined to what they found."""
    rows = [("price_drawdown", X.PRICE_DRAWDOWN), ("cash_engine", X.CASH_ENGINE), ("stress", X.STRESS)]
    th = spark.createDataFrame([(p, t["severe"], t["caution"]) for p, t in rows], "probe string, severe_line double, caution_line double")
    return findings(spark, d).join(th, "probe").groupBy("probe", "severe_line", "caution_line").agg(
        F.count_if(F.col("severity") == "severe").alias("severe"), F.count_if(F.col("severity") == "caution").alias("caution"), F.count_if("measured").alias("measured"))


@query("concentration_scale", """WITH x AS (SELECT l_suppkey AS entity, arg_max_null(CASE WHEN l_linenumber < 3 THEN l_discount * 10 WHEN l_linenumber < 6 THEN l_discount * 1000 END, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS v FROM lineitem GROUP BY l_suppkey),
  y AS (SELECT entity, CASE WHEN abs(v) <= 1.5 THEN v * 100 ELSE v END AS pct FROM x)
  SELECT entity, CASE WHEN pct < 100 THEN round(pct, 6) END AS percent, coalesce(pct < 100, false) AS measured, coalesce(pct >= 20 AND pct < 100, false) AS flagged FROM y""")
def concentration_scale(spark, d):
    """A value of at most 1.5 is a ratio; 100 % is a total row and refused; 20 % flags."""
    n = F.col("l_linenumber")
    v = F.when(n < 3, F.col("l_discount") * 10).when(n < 6, F.col("l_discount") * 1000)
    x = R.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.max_by(v, F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("v"))
    p = x.withColumn("p", F.when(F.abs("v") <= 1.5, F.col("v") * 100).otherwise(F.col("v")))
    ok = F.coalesce(F.col("p") < 100, F.lit(False))
    return p.select("entity", F.when(ok, F.col("p")).alias("percent"), ok.alias("measured"), (ok & F.coalesce(F.col("p") >= 20, F.lit(False))).alias("flagged"))
