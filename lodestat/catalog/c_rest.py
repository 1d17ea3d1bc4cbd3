"""Supplements, texts, bundles, ticks, archive grades and site tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog import sqlcard, sqlx
from lodestat.catalog.c_card import cards
from lodestat.catalog.c_fragile import EV
from lodestat.catalog.c_grading import FLOWS as FLOW_LABELS
from lodestat.catalog.c_grading import GRADED_AT, INDUSTRY, METRICS, POINTS, evaluated, filed_statements, graded_at, market, prepared, scored, share_series, TIER_SQL
from lodestat.catalog.c_pit import CHAIN_SQL, CHAINS, FLOWS, LATEST
from lodestat.catalog.c_series import quarter_ticks
from lodestat.catalog.registry import query, rnd, txt
from lodestat.functions import labels, names, valuation as V
from lodestat.operators import cohorts, lineage, pit, ranks
from lodestat.operators import statements as S
from lodestat.plans import archive, bundle, site, ticks
from lodestat.session import stage, staged, stage_alone

ST = f"WITH {R.SQL_STATEMENTS}"


def quarters(spark, d):
    return R.statements(spark, d).where("scope = 'quarterly'")


@query("supplement_fill", f"""{ST}, q AS (SELECT * FROM stm WHERE scope = 'quarterly'), b AS (SELECT entity, period_end, 'cash' AS label, cash AS value FROM q WHERE cash IS NOT NULL UNION ALL SELECT entity, period_end, 'debt', debt FROM q WHERE debt IS NOT NULL AND entity % 3 <> 0),
  x AS (SELECT entity, period_end, 'debt' AS label, current_debt AS value FROM q WHERE current_debt IS NOT NULL AND entity % 7 <> 0 UNION ALL SELECT entity, period_end, 'goodwill', goodwill FROM q WHERE goodwill IS NOT NULL)
  SELECT entity, {txt('period_end')}, label, {rnd('value')}, 'supplement' AS source FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.entity = x.entity AND b.label = x.label) AND EXISTS (SELECT 1 FROM b WHERE b.entity = x.entity AND b.period_end = x.period_end)
  UNION ALL SELECT entity, {txt('period_end')}, label, {rnd('value')}, 'base' FROM b""")
def supplement_fill(spark, d):
    """Labels absent from the whole section are filled on periods the base has;
    values that disagree on their filing day are refused first."""
    q = stage(quarters(spark, d).select("entity", "period_end", "cash", "debt", "current_debt", "goodwill"), "quarters")
    row = lambda c, n: q.where(f"{c} IS NOT NULL").select("entity", "period_end", F.lit(n).alias("label"), F.col(c).alias("value"))
    base = row("cash", "cash").unionByName(row("debt", "debt").where("entity % 3 <> 0"))
    due = row("current_debt", "debt")
    clash = due.where("entity % 7 = 0").withColumn("value", F.col("value") + 1)
    extra = pit.agreeing(due.unionByName(clash).unionByName(row("goodwill", "goodwill")).withColumn("filed", F.col("period_end")), ("entity", "period_end", "label"))
    held, periods = base.select("entity", "label").distinct(), base.select("entity", "period_end").distinct()
    add = extra.join(held, ["entity", "label"], "left_anti").join(periods, ["entity", "period_end"], "left_semi")
    return base.withColumn("source", F.lit("base")).unionByName(add.withColumn("source", F.lit("supplement")))


@query("period_setops", f"""{ST}, a AS (SELECT entity, period_end FROM stm WHERE scope = 'quarterly' AND debt IS NOT NULL), b AS (SELECT entity, period_end FROM stm WHERE scope = 'quarterly' AND capex IS NOT NULL)
  SELECT 'both' AS kind, entity, {txt('period_end')} FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first only', entity, {txt('period_end')} FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', entity, {txt('period_end')} FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def period_setops(spark, d):
    q = stage(quarters(spark, d).select("entity", "period_end", "debt", "capex"), "quarters")
    a, b = (q.where(f"{c} IS NOT NULL").select("entity", "period_end") for c in ("debt", "capex"))
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "entity", "period_end")
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "first only")).unionByName(tag(a.union(b).distinct(), "either"))


@query("market_data_join", f"{EV}, x AS (SELECT mkt.entity, market_cap, debt, cash, CASE mkt.entity % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END AS pc, CASE WHEN mkt.entity % 5 = 0 THEN 'USD' ELSE CASE mkt.entity % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'GBP' END END AS sc FROM mkt LEFT JOIN bal ON bal.entity = mkt.entity) SELECT entity, round(market_cap, 4) AS market_cap, {rnd('debt', digits=6)}, {rnd('cash', digits=6)} FROM x WHERE pc = sc")
def market_data_join(spark, d):
    """Market value with debt and cash; a price in another currency than the statements is left out."""
    bal = S.latest_balance(R.statements(spark, d)).select("entity", "debt", "cash")
    cur = F.element_at(F.array(F.lit("EUR"), F.lit("USD"), F.lit("GBP")), (F.col("entity") % 3 + 1).cast("int"))
    j = market(spark, d).join(bal, "entity", "left").withColumns({"pc": cur, "sc": F.when(F.col("entity") % 5 == 0, "USD").otherwise(cur)})
    return j.where("pc = sc").select("entity", F.round("market_cap", 4).alias("market_cap"), "debt", "cash")


@query("release_gates", f"""{EV}, g AS (SELECT (SELECT count(*) FROM supplier) AS eligible, (SELECT count(*) FROM (SELECT symbol, max(day) AS d FROM bars GROUP BY symbol) WHERE DATE '2001-12-01' - d BETWEEN 0 AND 45) AS fresh, (SELECT count(*) FROM ev WHERE v_yield IS NOT NULL) AS yields)
  SELECT eligible, fresh, yields, fresh / eligible >= 0.95 AS price_coverage, fresh = eligible AS terminal_explicit, yields >= 25 AS enough_yields, fresh / eligible >= 0.95 AND fresh = eligible AND yields >= 25 AS passed FROM g""")
def release_gates(spark, d):
    """Named checks and their conjunction."""
    last = R.bars(spark, d).groupBy("symbol").agg(F.max("day").alias("d"))
    fresh = last.where(F.datediff(F.lit("2001-12-01").cast("date"), "d").between(0, 45)).agg(F.count("*"))
    e = stage(evaluated(spark, d).select("v_yield"), "yields")
    g = R.table(spark, d, "supplier").agg(F.count("*").alias("eligible")).withColumns({"fresh": fresh.scalar(), "yields": e.where("v_yield IS NOT NULL").agg(F.count("*")).scalar()})
    g = g.withColumns({"price_coverage": F.col("fresh") / F.col("eligible") >= 0.95, "terminal_explicit": F.col("fresh") == F.col("eligible"), "enough_yields": F.col("yields") >= 25})
    return g.withColumn("passed", F.col("price_coverage") & F.col("terminal_explicit") & F.col("enough_yields"))


@query("band_streak", f"""WITH {R.SQL_STATEMENTS}, {R.SQL_TICKS}, tn AS (SELECT tick, row_number() OVER (ORDER BY tick) AS t FROM tickq), k AS (SELECT s.tick, symbol, t FROM (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY composite DESC, symbol) AS rk FROM tick_scores) s JOIN tn ON tn.tick = s.tick WHERE rk <= 40 AND composite >= 50),
  i AS (SELECT *, t - row_number() OVER (PARTITION BY symbol ORDER BY t) AS isle FROM k)
  SELECT {txt('tick')}, symbol, row_number() OVER (PARTITION BY symbol, isle ORDER BY t) AS streak FROM i""")
def band_streak(spark, d):
    """Consecutive quarters inside the candidate band: best 40 at 50 or more."""
    s = stage(R.tick_scores(spark, d), "ticks")
    n = s.select("tick").distinct().select("tick", F.row_number().over(W.orderBy("tick")).alias("t"))       # one row per quarter
    band = cohorts.top_per_group(s.select("tick", "symbol", "composite"), ["tick"], [F.desc("composite"), "symbol"], 40).where("composite >= 50").join(n, "tick")
    isle = band.withColumn("isle", F.col("t") - F.row_number().over(W.partitionBy("symbol").orderBy("t")))
    return isle.select("tick", "symbol", F.row_number().over(W.partitionBy("symbol", "isle").orderBy("t")).alias("streak"))


@query("provenance", f"{EV}, p AS (SELECT entity, CASE WHEN entity % 3 <> 0 THEN gm_level END AS pre, CASE WHEN entity % 4 = 0 THEN gm_level * 1.1 ELSE gm_level END AS post FROM ev) SELECT entity, CASE WHEN post IS NULL THEN NULL WHEN pre IS NULL THEN 'filings' WHEN pre = post THEN 'export' ELSE 'refined' END AS source FROM p")
def provenance(spark, d):
    """Source of a metric from its values before and after enrichment."""
    e = evaluated(spark, d)
    pre, post = F.when(F.col("entity") % 3 != 0, F.col("gm_level")), F.when(F.col("entity") % 4 == 0, F.col("gm_level") * 1.1).otherwise(F.col("gm_level"))
    return e.select("entity", F.when(post.isNull(), None).when(pre.isNull(), "filings").when(pre == post, "export").otherwise("refined").alias("source"))


@query("vendor_fill", f"{EV} SELECT entity, round(coalesce(nd2e, CASE WHEN ebitda IS NULL AND debt IS NOT NULL AND cash IS NOT NULL THEN (debt - cash) / 500000.0 END), 4) AS value, CASE WHEN nd2e IS NOT NULL THEN 'filed' WHEN ebitda IS NULL AND debt IS NOT NULL AND cash IS NOT NULL THEN 'vendor' END AS source FROM ev", digits=4)
def vendor_fill(spark, d):
    """Display value of a third source, only where the metric is NULL, and labelled."""
    v = F.when(F.col("ebitda").isNull(), (F.col("debt") - F.col("cash")) / 500000.0)
    x = F.when(F.col("nd2e").isNotNull(), F.struct(F.col("nd2e").alias("v"), F.lit("filed").alias("s"))).when(v.isNotNull(), F.struct(v.alias("v"), F.lit("vendor").alias("s")))
    return evaluated(spark, d).withColumn("x", x).select("entity", F.col("x.v").alias("value"), F.col("x.s").alias("source"))


@query("canonical_reason", f"""{EV} SELECT entity, CASE veto_rule WHEN 1 THEN 'leverage veto: net debt/EBITDA … > 4.0' WHEN 2 THEN 'leverage veto: EBITDA <= 0 while carrying net debt' WHEN 3 THEN 'cash-flow quality: OCF leans …% on credit-loss/write-off add-backs'
   WHEN 4 THEN 'dilution veto: shares …%/yr (>20%/yr)' WHEN 5 THEN 'flagged — owner-FCF negative every period, spared as a reinvestor (ROIC …% > 15%, revenue growth …%/yr > 10%)'
   WHEN 6 THEN 'cash-destruction veto: owner-FCF negative every annual period and TTM <= 0' WHEN 7 THEN 'dilution penalty: shares …%/yr' ELSE '' END AS reason FROM ev""")
def canonical_reason(spark, d):
    e = stage(evaluated(spark, d).select("entity", "veto.reason", "veto.reinvestor"), "vetoes")
    return e.select("entity", labels.canonical_reason(F.col("reason")).alias("reason"))


PRETAX = ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",
          "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments")
TAGS = ("Revenues", "OperatingIncomeLoss", "Unknown", "x", "Assets", *PRETAX)


@query("canonical_labels", """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Total Revenue' WHEN 1 THEN 'EBIT|Operating Income' WHEN 2 THEN 'Total Revenue' WHEN 4 THEN 'Total Assets' WHEN 5 THEN 'Pretax Income' WHEN 6 THEN 'Pretax Income' END AS labels FROM part""")
def canonical_labels(spark, d):
    k = (F.col("p_partkey") % 7 + 1).cast("int")
    tag = F.element_at(F.array(*[F.lit(t) for t in TAGS]), k)
    caption = F.when(F.col("p_partkey") % 7 == 2, "Net  Sales:").otherwise(F.col("p_name"))
    return R.table(spark, d, "part").select("p_partkey", F.array_join(labels.canonical_labels(tag, caption), "|").alias("labels"))


@query("first_sentence")
def first_sentence(spark, d):
    return R.table(spark, d, "documents").select("doc_id", labels.first_sentence(F.col("text")).alias("lead"))


SIG = f"""{EV}, y AS (SELECT entity, 100 * v_yield AS yp FROM ev WHERE v_yield IS NOT NULL), p AS (SELECT *, 100.0 * ((SELECT count(*) FROM y b WHERE b.yp < y.yp) + (SELECT count(*) FROM y b WHERE b.yp = y.yp) / 2.0) / (SELECT count(*) FROM y) AS pct FROM y)"""


@query("valuation_signal", f"{SIG} SELECT entity, CASE WHEN yp >= 15 THEN 'priced as if this cash flow will not last' WHEN pct >= 80 THEN 'appears inexpensive' WHEN pct >= 60 THEN 'somewhat inexpensive' WHEN pct >= 40 THEN 'near the middle' WHEN pct >= 20 THEN 'somewhat demanding' ELSE 'appears demanding' END AS signal FROM p")
def valuation_signal(spark, d):
    e = stage(evaluated(spark, d).where("v_yield IS NOT NULL").select("entity", (100.0 * F.col("v_yield")).alias("yp"), F.lit(0).alias("g")), "yields")
    r = ranks.value_ranks(e, ["g"], "yp").select("yp", (100.0 * (F.col("n_lt") + (F.col("n_le") - F.col("n_lt")) / 2.0) / F.col("n")).alias("pct"))
    return e.join(r, "yp").select("entity", labels.valuation_signal(F.col("pct"), F.col("yp")).alias("signal"))


@query("yield_multiple", f"{EV} SELECT entity, round(100.0 / (100 * v_yield), 4) AS multiple, 100 * v_yield >= 15 AS distress FROM ev WHERE v_yield > 0", digits=4)
def yield_multiple(spark, d):
    y = 100.0 * F.col("v_yield")
    return evaluated(spark, d).where("v_yield > 0").select("entity", (100.0 / y).alias("multiple"), (y >= labels.DISTRESS_YIELD_PCT).alias("distress"))


ADJ = "WITH x AS (SELECT o_orderkey AS item, CASE WHEN o_totalprice >= 400000 THEN 'A' WHEN o_totalprice >= 300000 THEN 'B' WHEN o_totalprice >= 200000 THEN 'C' WHEN o_totalprice >= 100000 THEN 'D' ELSE 'F' END AS grade, o_orderkey % 100 AS worst, o_orderkey % 7 = 0 AS red, o_orderkey % 3 = 0 AS clear FROM orders)"


@query("grade_adjust", f"{ADJ} SELECT item, CASE WHEN red THEN CASE grade WHEN 'A' THEN 'B' WHEN 'B' THEN 'C' WHEN 'C' THEN 'D' ELSE 'F' END WHEN clear AND worst >= 50 THEN CASE grade WHEN 'F' THEN 'D' WHEN 'D' THEN 'C' WHEN 'C' THEN 'B' ELSE 'A' END ELSE grade END AS final FROM x")
def grade_adjust(spark, d):
    """One band down on a red flag; one up only with all axes clear and no pillar under 50."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    order = F.array(*[F.lit(x) for x in ("F", "D", "C", "B", "A")])
    at = F.when(p >= 400000, 5).when(p >= 300000, 4).when(p >= 200000, 3).when(p >= 100000, 2).otherwise(1)
    step = F.when(k % 7 == 0, -1).when((k % 3 == 0) & (k % 100 >= 50), 1).otherwise(0)
    return R.table(spark, d, "orders").select(k.alias("item"), F.element_at(order, F.greatest(F.lit(1), F.least(F.lit(5), at + step))).alias("final"))


REASONS = "CASE WHEN price IS NULL THEN 'MISSING_PRICE' WHEN entity % 9 = 0 THEN 'STALE_PRICE' WHEN entity % 11 = 0 THEN 'STALE_SHARES' WHEN latest_shares IS NULL THEN 'MISSING_SHARES' WHEN owner_fcf IS NULL THEN 'MISSING_OWNER_FCF' ELSE 'MISSING_EV_INPUT' END"


def reason():
    c = F.col
    return (F.when(c("price").isNull(), "MISSING_PRICE").when(c("entity") % 9 == 0, "STALE_PRICE").when(c("entity") % 11 == 0, "STALE_SHARES")
            .when(c("latest_shares").isNull(), "MISSING_SHARES").when(c("owner_fcf").isNull(), "MISSING_OWNER_FCF").otherwise("MISSING_EV_INPUT"))


@query("missing_reason", f"{EV} SELECT entity, {REASONS} AS reason, CASE WHEN {REASONS} LIKE 'STALE%' THEN 'STALE' ELSE 'MISSING' END AS status FROM ev WHERE v_yield IS NULL")
def missing_reason(spark, d):
    r = evaluated(spark, d).where("v_yield IS NULL").withColumn("reason", reason())
    return r.select("entity", "reason", F.when(F.col("reason").startswith("STALE"), "STALE").otherwise("MISSING").alias("status"))


YIELD_INPUTS = {"raw_close": "price", "owner_fcf_ttm": "owner_fcf", "market_cap": "market_cap", "total_debt": "debt", "cash": "cash"}


@query("store_yield", f"""{EV}, s AS (SELECT *, sha256(concat_ws('|', 'source', entity, source_key, CAST(round(value * {lineage.UNITS}) AS BIGINT))) AS input_id FROM (
    SELECT entity, unnest([{', '.join(f"'{k}'" for k in YIELD_INPUTS)}]) AS source_key, unnest([{', '.join(YIELD_INPUTS.values())}]) AS value FROM ev WHERE v_yield IS NOT NULL) WHERE value IS NOT NULL),
  m AS (SELECT entity, sha256(concat_ws('|', 'metric', 'owner_fcf_yield_pct:1', entity, array_to_string(list_sort(list(input_id)), ','))) AS metric_id FROM s GROUP BY entity)
  SELECT ev.entity, CASE WHEN v_yield IS NULL THEN 'MISSING' ELSE 'FRESH' END AS status, metric_id, source_key, input_id, round(value, 4) AS value FROM ev LEFT JOIN s ON s.entity = ev.entity LEFT JOIN m ON m.entity = ev.entity""", digits=4)
def store_yield(spark, d):
    """The metric's status and id, with one lineage edge per input it was computed from."""
    e = evaluated(spark, d).select("entity", "v_yield", *YIELD_INPUTS.values())
    cells = F.array(*[F.struct(F.lit(k).alias("source_key"), F.col(c).alias("value")) for k, c in YIELD_INPUTS.items()])
    cells = e.where("v_yield IS NOT NULL").select("entity", F.explode(cells).alias("i")).select("entity", "i.*")
    src = lineage.sources(cells, ["entity"], "source_key")
    met = lineage.metrics(src, "owner_fcf_yield_pct", ["entity"])
    rows = cells.join(src.select("entity", F.col("key").alias("source_key"), F.col("id").alias("input_id")), ["entity", "source_key"])
    out = e.select("entity", F.when(F.col("v_yield").isNull(), "MISSING").otherwise("FRESH").alias("status"))
    return out.join(met.select("entity", F.col("id").alias("metric_id")), "entity", "left").join(rows, "entity", "left").select("entity", "status", "metric_id", "source_key", "input_id", "value")


@query("dossier", f"""{EV}, r4 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS r FROM stm WHERE scope = 'quarterly'), oe AS (SELECT entity, CASE WHEN count(ocf) = 4 AND count(capex) = 4 THEN sum(ocf - abs(capex)) END AS fcf, sum(coalesce(sbc, 0)) AS sbc, count(*) AS n FROM r4 WHERE r <= 4 GROUP BY entity)
  SELECT oe.entity, round(fcf, 4) AS fcf_ttm, round(fcf - oe.sbc, 4) AS owner_fcf_ttm, round(CASE WHEN fcf - oe.sbc > 0 THEN ev.price / ((fcf - oe.sbc) / ev.latest_shares) END, 4) AS multiple FROM oe JOIN ev ON ev.entity = oe.entity WHERE fcf IS NOT NULL""", digits=4)
def dossier(spark, d):
    """Conservative owner earnings (all capex is cost) and the multiple of their price."""
    w = W.partitionBy("entity").orderBy(F.desc("period_end"))
    q = quarters(spark, d).select("entity", "period_end", "ocf", "capex", "sbc").withColumn("_rn", F.row_number().over(w)).where("_rn <= 4")
    oe = q.groupBy("entity").agg(F.when((F.count("ocf") == 4) & (F.count("capex") == 4), F.sum(F.col("ocf") - F.abs("capex"))).alias("fcf_ttm"), F.sum(F.coalesce("sbc", F.lit(0.0))).alias("sbc")).where("fcf_ttm IS NOT NULL")
    sh = share_series(spark, d).groupBy("entity").agg(F.max_by("value", "end_day").alias("n"))
    j = oe.join(sh, "entity").join(market(spark, d).select("entity", "price"), "entity").withColumn("owner_fcf_ttm", F.col("fcf_ttm") - F.col("sbc"))
    return j.select("entity", "fcf_ttm", "owner_fcf_ttm", F.when(F.col("owner_fcf_ttm") > 0, F.col("price") / (F.col("owner_fcf_ttm") / F.col("n"))).alias("multiple"))


AS_OF = "1999-06-30"


# every third entity files its share counts 900 days late, so that stale counts occur
BUNDLE_SHARES = f"""{R.SQL_SHARES}, cnt AS (SELECT entity, CASE WHEN entity % 3 = 0 THEN end_day - 900 ELSE end_day END AS end_day, CASE WHEN entity % 3 = 0 THEN filed - 900 ELSE filed END AS filed, value, seq FROM share_counts),
  cv AS (SELECT * FROM cnt WHERE filed <= DATE '{AS_OF}' AND NOT (entity % 3 = 0 AND end_day > DATE '{AS_OF}' - 800)),
  pf AS (SELECT entity, filed, min(end_day) AS lo, max(end_day) AS hi, sum(value) AS total, arg_max(end_day, (value, -seq)) AS te, arg_max(value, (value, -seq)) AS tv FROM cv GROUP BY ALL),
  ser AS (SELECT entity, lo AS end_day, arg_max(total, filed) AS value FROM pf WHERE entity NOT IN (SELECT entity FROM pf WHERE lo <> hi) GROUP BY ALL),
  sr AS (SELECT entity, count(*) AS series_points, DATE '{AS_OF}' - max(end_day) AS series_age FROM ser GROUP BY entity),
  pt AS (SELECT entity, max(end_day) AS d, arg_max(value, end_day) AS v, 'series' AS b FROM ser WHERE end_day <= DATE '{AS_OF}' GROUP BY entity),
  fb AS (SELECT entity, CASE WHEN hi - lo <= 45 THEN hi ELSE te END AS d, CASE WHEN hi - lo <= 45 THEN total ELSE tv END AS v, CASE WHEN hi - lo <= 45 THEN 'fallback-sum' ELSE 'fallback-largest' END AS b
    FROM pf QUALIFY row_number() OVER (PARTITION BY entity ORDER BY filed DESC) = 1),
  sp AS (SELECT * FROM pt UNION ALL SELECT * FROM fb WHERE entity NOT IN (SELECT entity FROM pt)),
  wa AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) * 1000 AS v FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 6 = 0 AND l_shipdate <= DATE '{AS_OF}' GROUP BY l_suppkey, CAST(l_shipdate AS DATE)
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE) DESC) = 1),
  ag AS (SELECT sp.*, DATE '{AS_OF}' - sp.d AS age, wa.d AS wd, wa.v AS wv, coalesce(DATE '{AS_OF}' - wa.d <= 450 AND wa.v > 0, false) AS fresh FROM sp LEFT JOIN wa ON wa.entity = sp.entity),
  sh AS (SELECT entity, CASE WHEN age <= 450 THEN v WHEN fresh THEN wv END AS shares, CASE WHEN age <= 450 THEN d WHEN fresh THEN wd END AS shares_day, CASE WHEN age > 450 AND fresh THEN DATE '{AS_OF}' - wd ELSE age END AS shares_age,
    CASE WHEN age <= 450 THEN b WHEN fresh THEN 'weighted-average' ELSE 'stale-refused' END AS shares_basis,
    CASE WHEN age > 450 AND fresh THEN 'share count is ' || age || 'd old; using the weighted average of ' || wd WHEN age > 450 THEN 'no share count newer than ' || age || 'd; market value refused' END AS shares_note FROM ag)"""


@query("as_of_bundle", f"""WITH {R.SQL_CUMULATIVE}, vis AS (SELECT * FROM cfacts WHERE filed <= DATE '{AS_OF}'), {LATEST}, {FLOWS}, {CHAIN_SQL}, fl AS (SELECT *, 'annual' AS scope FROM ann UNION ALL SELECT *, 'quarterly' AS scope FROM qtr),
  ch AS (SELECT entity, label, scope, end_day, arg_min(value, priority) AS value FROM fl JOIN concepts USING (tag) GROUP BY ALL), st AS (SELECT entity, count(*) AS cells, sum(value) AS total FROM ch GROUP BY entity HAVING bool_or(scope = 'annual')),
  {R.SQL_FACTS}, np AS (SELECT entity, tag, end_day, arg_max(value, (filed, seq)) AS value FROM facts WHERE filed <= DATE '{AS_OF}' GROUP BY ALL), bl AS (SELECT entity, label, end_day, arg_min(value, priority) AS value FROM np JOIN concepts USING (tag) GROUP BY ALL),
  bs AS (SELECT entity, count(*) AS balance_cells, sum(value) AS balance_total FROM bl GROUP BY entity),
  {R.SQL_BARS}, b2 AS (SELECT symbol, close, CASE WHEN symbol % 5 = 0 THEN day - 1000 ELSE day END AS day FROM bars), px AS (SELECT symbol, max(day) AS d, arg_max(close, day) AS price FROM b2 WHERE day <= DATE '{AS_OF}' GROUP BY symbol), {BUNDLE_SHARES}, {R.SQL_SPLITS},
  j AS (SELECT st.entity, cells, total, balance_cells, balance_total, DATE '{AS_OF}' - px.d AS price_age, CASE WHEN DATE '{AS_OF}' - px.d <= 45 THEN price END AS price, sh.* EXCLUDE (entity), series_points, series_age FROM st LEFT JOIN bs USING (entity) LEFT JOIN px ON px.symbol = st.entity LEFT JOIN sh ON sh.entity = st.entity LEFT JOIN sr ON sr.entity = st.entity)
  SELECT entity, cells, round(total, 2) AS total, balance_cells, round(balance_total, 2) AS balance_total, CASE WHEN price_age > 45 THEN 'newest bar is ' || price_age || 'd old' END AS price_note, round(price, 6) AS price, price_age, shares, {txt('shares_day')}, shares_age, shares_basis, shares_note, series_points, series_age,
    coalesce(series_age > 450, false) AS series_stale, round(shares * price * (SELECT coalesce(product(ratio), 1) FROM splits WHERE symbol = j.entity AND day > j.shares_day AND (j.entity % 2 = 1 OR day <= DATE '{AS_OF}')), 2) AS market_cap,
    entity % 2 = 1 AND shares IS NOT NULL AND price IS NOT NULL AND NOT EXISTS (SELECT 1 FROM splits WHERE symbol = j.entity) AS split_unverified, (SELECT count(*) FROM splits WHERE symbol = j.entity AND day <= DATE '{AS_OF}') AS known_splits FROM j""", digits=6)
def as_of_bundle(spark, d):
    bars = R.bars(spark, d).withColumn("day", F.expr("if(symbol % 5 = 0, date_sub(day, 1000), day)"))
    late = F.col("entity") % 3 == 0
    counts = R.share_counts(spark, d).withColumns({c: F.when(late, F.date_sub(c, 900)).otherwise(F.col(c)) for c in ("end_day", "filed")})
    counts = counts.where(~(late & (F.col("end_day") > F.date_sub(F.lit(AS_OF).cast("date"), 800))))     # and has filed none lately
    weighted = (R.table(spark, d, "lineitem").where(f"l_returnflag = 'A' AND l_suppkey % 6 = 0 AND l_shipdate <= TIMESTAMP_NTZ'{AS_OF} 00:00:00'")
                .groupBy(F.col("l_suppkey").alias("entity"), F.col("l_shipdate").cast("date").alias("end_day")).agg((F.sum("l_quantity") * 1000).alias("value")))
    b = bundle.as_of_bundle(R.cumulative_facts(spark, d), pit.concept_table(spark, CHAINS), bars, counts, AS_OF, points=R.facts(spark, d), splits=R.splits(spark, d), weighted=weighted,
                            basis=F.when(F.col("entity") % 2 == 0, "raw").otherwise("split_adjusted_today"))
    add = lambda m: F.round(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x), 2)
    return b.select("entity", F.size("statements").cast("bigint").alias("cells"), add("statements").alias("total"), F.when(F.col("balance").isNotNull(), F.size("balance")).cast("bigint").alias("balance_cells"),
                    add("balance").alias("balance_total"), "price_note", "price", "price_age", "shares", "shares_day", "shares_age", "shares_basis", "shares_note", F.when(F.col("series").isNotNull(), F.size("series")).cast("bigint").alias("series_points"),
                    "series_age", "series_stale", F.round("market_cap", 2).alias("market_cap"), "split_unverified", F.when(F.col("splits").isNotNull(), F.size("splits")).otherwise(0).alias("known_splits"))


# every statement filed 30 days after its end; a third of the companies restate it 100 days later
RESTATED = 1.05


def restated_facts(spark, d):
    f = filed_statements(spark, d)
    again = f.where("entity % 3 = 0").withColumns({"filed": F.date_add("filed", 100), "value": F.col("value") * RESTATED, "seq": F.lit(1).cast("bigint")})
    return f.unionByName(again)


def at_every_tick(sql: str) -> str:
    """The same SQL over what was known at each tick: entities and sectors are numbered by tick."""
    known = f"CASE WHEN entity % 3 = 0 AND period_end + 130 <= tick THEN {{c}} * {RESTATED} ELSE {{c}} END AS {{c}}"
    late = "SELECT no AS fno, entity AS fentity FROM share_counts_all, tk WHERE filed <= tick GROUP BY no, tick, entity HAVING max(end_day) >= tick - 450"
    rules = ((R.SQL_STATEMENTS, "stm", f"SELECT no * 10000000 + entity AS entity, scope, period_end, {', '.join(known.format(c=c) for c in R.LABELS)} FROM stm_all, tk WHERE period_end + 30 <= tick"),
             (R.SQL_BARS, "bars", "SELECT no * 10000000 + symbol AS symbol, day, close, adj_close FROM bars_all, tk WHERE day <= tick AND day >= tick - 45"),
             (R.SQL_SHARES, "share_counts", f"SELECT no * 10000000 + entity AS entity, end_day, filed, value, seq FROM share_counts_all, tk JOIN ({late}) ON fno = no AND fentity = entity WHERE filed <= tick"),
             (R.SQL_SPLITS, "splits", "SELECT no * 10000000 + symbol AS symbol, day, ratio FROM splits_all, tk WHERE day <= tick"),
             (R.SQL_UNIVERSE, "universe", "SELECT no * 10000000 + symbol AS symbol, sector || '|' || no AS sector, industry FROM universe_all, tk"))
    for part, name, rule in rules:
        sql = sql.replace(part, f"{part.replace(f'{name} AS (', f'{name}_all AS (')}, {name} AS ({rule})")
    return f"{R.SQL_INDEX}, tk AS (SELECT max(day) AS tick, row_number() OVER (ORDER BY max(day)) AS no FROM idx GROUP BY date_trunc('quarter', day)), {sql}"


@query("score_ticks", f"""WITH {at_every_tick(sqlx.SQL_SCORE)}
  SELECT CAST(tick AS VARCHAR) AS tick, entity % 10000000 AS entity, split_part(sector, '|', 1) AS sector, grade, round(composite, 3) AS composite, note, basis FROM scored JOIN tk ON no = entity // 10000000""", digits=3)
def score_ticks(spark, d):
    """Veto, composite and grade of every (quarter tick, entity), by sector."""
    at = stage(quarter_ticks(spark, d), "ticks")
    counts = R.share_counts(spark, d).withColumn("value", F.col("value") / 10)
    shares = stage_alone(ticks.shares_at_ticks(counts, R.splits(spark, d), at), "shares")
    market = ticks.market_at_ticks(ticks.prices_at_ticks(R.bars(spark, d), at), shares)
    market = market.withColumn("vendor_ev", F.when(F.col("entity.name") % 4 == 0, F.col("market_cap") * 0.7))
    meta = R.universe(spark, d).select(F.col("symbol").alias("entity"), "sector", "industry")
    chains = ({c: (c,) for c in FLOW_LABELS}, {c: (c,) for c in POINTS})
    out = ticks.grades_at_ticks(restated_facts(spark, d), shares.select("entity", "end_day", "value"), market, meta, at, *chains)
    return out.select("tick", "entity", "sector", "grade", "composite", "note", "basis")


GA = f"""WITH {R.SQL_STATEMENTS}, {R.SQL_UNIVERSE}, {sqlx.SQL_MARKET}, q AS (SELECT *, ebit + da AS ebitda, {sqlx.OWNER} AS owner_fcf, row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS rn FROM stm WHERE scope = 'quarterly'),
  l4 AS (SELECT entity, {', '.join(f'CASE WHEN count({c}) = 4 THEN sum({c}) END AS {n}' for c, n in (('owner_fcf', 'owner_fcf'), ('ebitda', 'ebitda'), ('revenue', 'revenue'), ('net_income', 'ni'), ('ocf', 'ocf')))}, sum(coalesce(revenue, 0)) AS rev0, sum(coalesce(sbc, 0)) AS sbc FROM q WHERE rn <= 4 GROUP BY entity),
  nw AS (SELECT entity, debt, cash, current_assets - current_liabilities + (total_assets - current_assets - cash) AS base, ebit FROM q WHERE rn = 1),
  al AS (SELECT entity, 100.0 * avg(gm) AS gm_level, CASE WHEN count(gm) > 1 AND avg(gm) <> 0 THEN stddev_pop(gm) / avg(gm) ELSE 0.0 END AS gm_cv, CASE WHEN count(rev) >= 2 THEN {sqlx.cagr('min(rd)', 'arg_min(rev, rd)', 'max(rd)', 'arg_max(rev, rd)')} END AS growth, coalesce(bool_and(owner_fcf < 0), false) AS all_negative
    FROM (SELECT entity, owner_fcf, CASE WHEN revenue <> 0 THEN gross_profit / revenue END AS gm, CASE WHEN revenue > 0 THEN revenue END AS rev, CASE WHEN revenue > 0 THEN period_end END AS rd FROM q) GROUP BY entity),
  tg AS (SELECT entity, max(end_day) AS d1, arg_max(value, end_day) AS v1 FROM shr GROUP BY entity), yo AS (SELECT tg.entity, 100.0 * (any_value(v1) - arg_max(s.value, s.end_day)) / arg_max(s.value, s.end_day) AS yoy_pct FROM tg JOIN shr s ON s.entity = tg.entity AND s.end_day <= tg.d1 - 365 GROUP BY tg.entity),
  m0 AS (SELECT l4.*, debt, cash, gm_level, gm_cv, growth, all_negative, yoy_pct, sector, debt - cash AS net_debt, CASE WHEN base > 0 THEN 100.0 * ebit / base END AS roic, CASE WHEN market_cap + debt - cash > 0 THEN owner_fcf / (market_cap + debt - cash) END AS v_yield,
    CASE WHEN rev0 > 0 THEN 100.0 * owner_fcf / rev0 WHEN owner_fcf IS NOT NULL THEN 0 END AS ofcf_margin, CASE WHEN ebitda <> 0 THEN (debt - cash) / ebitda END AS nd2e, CASE WHEN revenue > 0 THEN 100.0 * sbc / revenue END AS sbc_pct, CASE WHEN revenue > 0 THEN 100.0 * (ni - ocf) / revenue END AS accrual
    FROM l4 JOIN nw USING (entity) JOIN al USING (entity) LEFT JOIN yo USING (entity) LEFT JOIN mkt USING (entity) LEFT JOIN meta USING (entity)),
  m1 AS (SELECT *, CASE WHEN {' OR '.join(f'{k} IS NULL' for k in archive.REQUIRED)} THEN 'INSUFFICIENT' WHEN nd2e > 4 OR (ebitda <= 0 AND net_debt > 0) THEN 'VETOED' WHEN all_negative AND NOT (roic > 15 AND coalesce(growth > 10, false)) THEN 'VETOED' END AS rule, CASE WHEN NOT all_negative AND yoy_pct > 5 THEN -15 ELSE 0 END AS penalty FROM m0),
  sv AS (SELECT *, {', '.join(sqlx._pct(k, h) for k, h in archive.LEGS.items())} FROM m1 WHERE rule IS NULL),
  co AS (SELECT entity, greatest(0.0, least(100.0, round_even(0.25 * p_v_yield + 0.25 * ((round_even(p_roic * {sqlx.FACTOR}, 6) + p_gm_level * (p_gm_cv / 100.0) + p_ofcf_margin) / 3) + 0.2 * coalesce(round_even(p_growth * {sqlx.FACTOR}, 6), 50.0) + 0.15 * ((p_nd2e + CASE WHEN owner_fcf > 0 THEN 100.0 ELSE 0.0 END + p_sbc_pct) / 3) + 0.15 * {sqlx.mean('p_accrual', 'p_yoy_pct')} + penalty, 4))) AS composite FROM sv)"""


@query("grade_archive", f"{GA} SELECT m1.entity, coalesce(rule, CASE WHEN composite >= 80 THEN 'A' WHEN composite >= 65 THEN 'B' WHEN composite >= 50 THEN 'C' WHEN composite >= 35 THEN 'D' ELSE 'F' END) AS grade, round(composite, 3) AS composite FROM m1 LEFT JOIN co ON co.entity = m1.entity", digits=3)
def grade_archive(spark, d):
    meta = R.universe(spark, d).select(F.col("symbol").alias("entity"), "sector")
    m = stage(archive.metrics(*prepared(spark, d)[1:], market(spark, d), meta), "archive")
    return archive.grade(m).select("entity", "grade", "composite")


@query("site_sectors", f"""WITH {sqlx.SQL_SCORE}, {sqlcard.MOS}, {sqlcard.YEARS}, {sqlcard.BUFFETT}, {sqlcard.CARD} SELECT s.sector, count(*) AS names, count(s.composite) AS graded, count(*) FILTER (s.grade = 'VETOED') AS vetoed, round(avg(s.composite), 3) AS mean_composite, round(avg(c.pct), 3) AS mean_card_pct, count(*) FILTER (c.evidence = 'full') AS full_evidence
  FROM scored s LEFT JOIN card c ON c.entity = s.entity GROUP BY s.sector""", digits=3)
def site_sectors(spark, d):
    """Sector table of grades and cards."""
    s = scored(spark, d).select("entity", "sector", "composite", "grade")
    c = cards(spark, d).select("entity", "pct", "evidence")
    return s.join(c, "entity", "left").groupBy("sector").agg(
        F.count("*").alias("names"), F.count("composite").alias("graded"), F.count_if(F.col("grade") == "VETOED").alias("vetoed"), F.avg("composite").alias("mean_composite"),
        F.avg("pct").alias("mean_card_pct"), F.count_if(F.col("evidence") == "full").alias("full_evidence"))


SITE_COLUMNS = f"entity, sector, {TIER_SQL} AS tier, grade, composite, {', '.join(METRICS)}"
# the earlier run does not know every seventh company, the later one does not know every eleventh
SQL_SITE = f"""WITH o AS (SELECT * FROM ({GRADED_AT} SELECT {SITE_COLUMNS} FROM scored) WHERE entity % 7 <> 0), n AS (SELECT * FROM (WITH {sqlx.SQL_SCORE} SELECT {SITE_COLUMNS} FROM scored) WHERE entity % 11 <> 0)"""


def site_runs(spark, d):
    """(before, after): the grades at a past date and those of all facts."""
    columns = ("entity", "sector", names.industry_tier(F.expr(INDUSTRY)).alias("tier"), "grade", "composite", *METRICS)
    old = staged(spark, d, "site_before", lambda: graded_at(spark, d).select(*columns))
    return old.where("entity % 7 <> 0"), scored(spark, d).select(*columns).where("entity % 11 <> 0")


def _present(side: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {side}.{m} IS NOT NULL THEN '{m}' END" for m in METRICS) + "], lambda x: x IS NOT NULL)"


@query("site_model", f"""{SQL_SITE}, rk AS (SELECT entity, rank() OVER (ORDER BY composite DESC) AS rank, rank() OVER (PARTITION BY sector ORDER BY composite DESC) AS sector_rank FROM n WHERE composite IS NOT NULL),
  ro AS (SELECT entity, rank() OVER (ORDER BY composite DESC) AS rank FROM o WHERE composite IS NOT NULL),
  j AS (SELECT coalesce(n.entity, o.entity) AS entity, coalesce(n.sector, o.sector) AS sector, coalesce(n.tier, o.tier) AS tier, CASE WHEN o.entity IS NULL THEN 'joined' WHEN n.entity IS NULL THEN 'left' ELSE 'kept' END AS state,
    n.grade, n.composite, o.grade AS grade_before, {_present('n')} AS now, {_present('o')} AS old FROM n FULL JOIN o ON o.entity = n.entity)
  SELECT j.entity, sector, tier, state, grade, round(composite, 3) AS composite, rk.rank, sector_rank, grade_before, ro.rank AS rank_before, ro.rank - rk.rank AS places_won, len(now) AS metrics, len(old) AS metrics_before,
   array_to_string(list_filter(now, lambda x: NOT list_contains(old, x)), ',') AS gained, array_to_string(list_filter(old, lambda x: NOT list_contains(now, x)), ',') AS lost
  FROM j LEFT JOIN rk ON rk.entity = j.entity LEFT JOIN ro ON ro.entity = j.entity""", digits=3)
def site_model(spark, d):
    """One row per name: grade and ranks now and before, metrics gained and lost between two runs."""
    rows = site.name_rows(*site_runs(spark, d), METRICS)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("gained", "lost")}).withColumns({c: F.col(c).cast("bigint") for c in ("metrics", "metrics_before")})


_CELLS = " UNION ALL ".join(f"SELECT tier, sector, '{m}' AS metric, o_here, n_here, coalesce(o_{m}, false) AS o, coalesce(n_{m}, false) AS n FROM b" for m in METRICS)


@query("site_coverage", f"""{SQL_SITE}, b AS (SELECT coalesce(n.tier, o.tier) AS tier, coalesce(n.sector, o.sector) AS sector, o.entity IS NOT NULL AS o_here, n.entity IS NOT NULL AS n_here,
    {', '.join(f'o.{m} IS NOT NULL AS o_{m}, n.{m} IS NOT NULL AS n_{m}' for m in METRICS)} FROM n FULL JOIN o ON o.entity = n.entity), c AS ({_CELLS}),
  g AS (SELECT CASE WHEN GROUPING(tier) = 0 THEN 'tier' WHEN GROUPING(sector) = 0 THEN 'sector' ELSE 'all' END AS level, coalesce(tier, sector) AS part, metric, count(*) FILTER (o_here) AS eligible_before, count(*) FILTER (n_here) AS eligible,
    count(*) FILTER (o) AS measured_before, count(*) FILTER (n) AS measured, count(*) FILTER (n AND NOT o) AS gained, count(*) FILTER (o AND NOT n) AS lost FROM c
    GROUP BY GROUPING SETS ((tier, metric), (sector, metric), (metric), (tier), (sector), ()))
  SELECT *, round(CASE WHEN eligible > 0 THEN 100.0 * measured / eligible ELSE 0 END - CASE WHEN eligible_before > 0 THEN 100.0 * measured_before / eligible_before ELSE 0 END, 4) AS gain_points FROM g""", digits=4)
def site_coverage(spark, d):
    """Coverage of every metric before and after, by tier, by sector and over all."""
    return site.coverage(*site_runs(spark, d), METRICS)
