"""Facts and point-in-time joins and aggregates."""

from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog.registry import query, rnd, txt
from lodestat.operators import asof, pit

AS_OF = "1999-06-30"
CHAINS = {"Total Revenue": ("1-URGENT", "2-HIGH"), "EBIT": ("3-MEDIUM",),
          "Operating Cash Flow": ("5-LOW", "4-NOT SPECIFIED")}
CHAIN_SQL = "concepts(label, tag, priority) AS (VALUES " + ", ".join(
    f"('{l}', '{t}', {i})" for l, ts in CHAINS.items() for i, t in enumerate(ts)) + ")"
VIS = f"WITH {R.SQL_FACTS}, vis AS (SELECT * FROM facts WHERE filed <= DATE '{AS_OF}')"
LATEST = """lf AS (SELECT entity, tag, start_day, end_day, value, filed FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, tag, start_day, end_day ORDER BY filed DESC, seq DESC) AS rn
  FROM vis) WHERE rn = 1)"""
CVIS = f"WITH {R.SQL_CUMULATIVE}, vis AS (SELECT * FROM cfacts WHERE filed <= DATE '{AS_OF}'), {LATEST}"
FLOWS = """ann AS (SELECT entity, tag, end_day, arg_max(value, start_day) AS value FROM lf
  WHERE end_day - start_day BETWEEN 330 AND 400 GROUP BY ALL),
short AS (SELECT entity, tag, end_day, arg_max(value, start_day) AS value FROM lf
  WHERE end_day - start_day <= 100 GROUP BY ALL),
der AS (SELECT entity, tag, end_day, value FROM (
  SELECT a.entity, a.tag, a.end_day, a.value - b.value AS value,
    row_number() OVER (PARTITION BY a.entity, a.tag, a.end_day
      ORDER BY a.start_day, abs(b.start_day - a.start_day), b.end_day DESC) AS rn
  FROM lf a JOIN lf b ON a.entity = b.entity AND a.tag = b.tag
  WHERE a.end_day - a.start_day > 100
    AND NOT EXISTS (SELECT 1 FROM short s WHERE s.entity = a.entity AND s.tag = a.tag AND s.end_day = a.end_day)
    AND a.end_day - b.end_day BETWEEN 1 AND 100
    AND (abs(b.start_day - a.start_day) <= 7
         OR (b.end_day - b.start_day > 100 AND abs(b.start_day - a.start_day) <= 365))) WHERE rn = 1),
qtr AS (SELECT * FROM short UNION ALL SELECT * FROM der)"""


@query("pit_filter", f"{VIS} SELECT entity, tag, {txt('end_day')}, {txt('filed')}, value, seq FROM vis")
def pit_filter(spark, d):
    return pit.visible(R.facts(spark, d), AS_OF).select("entity", "tag", "end_day", "filed", "value", "seq")


@query("latest_filed", f"{VIS}, {LATEST} SELECT entity, tag, {txt('end_day')}, {txt('filed')}, value FROM lf")
def latest_filed(spark, d):
    return pit.latest_filed(pit.visible(R.facts(spark, d), AS_OF), instant=False).select(
        "entity", "tag", "end_day", "filed", "value")


NAMED = "CASE WHEN seq % 5 = 0 THEN 'dei' ELSE 'us-gaap' END"
UNIT = "CASE WHEN seq % 3 = 0 THEN 'pure' ELSE 'USD' END"


def named_facts(spark, d):
    return R.facts(spark, d).withColumns({"namespace": F.expr(NAMED), "unit": F.expr(UNIT)})


@query("newest_point", f"""{VIS} SELECT entity, value, {txt('end_day')}, {txt('filed')}, form, tag, unit FROM (
  SELECT *, {UNIT} AS unit, row_number() OVER (PARTITION BY entity ORDER BY end_day DESC, filed DESC, seq DESC) AS rn FROM vis WHERE {NAMED} = 'us-gaap')
  WHERE rn = 1""")
def newest_point(spark, d):
    """Newest point of the standard namespace, whatever its unit."""
    return pit.newest_point(pit.visible(named_facts(spark, d), AS_OF).where("namespace = 'us-gaap'")).drop("namespace")


@query("disclosures", f"""{VIS}, {CHAIN_SQL} SELECT entity, label, value, {txt('end_day')}, {txt('filed')}, form, tag, unit FROM (
  SELECT v.*, label, {UNIT} AS unit, row_number() OVER (PARTITION BY entity, label ORDER BY end_day DESC, filed DESC, priority, {UNIT}, seq DESC) AS rn FROM vis v JOIN concepts USING (tag) WHERE {NAMED} = 'us-gaap')
  WHERE rn = 1""")
def disclosures(spark, d):
    """Newest dated point of each label's tags, with its unit."""
    return pit.disclosures(pit.visible(named_facts(spark, d), AS_OF).where("namespace = 'us-gaap'"), pit.concept_table(spark, CHAINS))


# a quarter of the companies file in two units, a quarter in euros until they change to dollars after the date; some tags also exist
# in another namespace
IN_UNITS = (("entity % 4 <> 1", "value", "filed", "us-gaap", "USD"), ("entity % 4 < 2", "value * 0.5", "filed", "us-gaap", "EUR"),
            ("entity % 4 = 1", "value", "filed + 4000", "us-gaap", "USD"), ("entity % 3 = 0", "value + 1", "filed", "dei", "USD"))
SQL_UNITS = f"""WITH {R.SQL_CUMULATIVE}, mf AS ({' UNION ALL '.join(f"SELECT entity, tag, start_day, end_day, {f} AS filed, {v} AS value, seq, '{n}' AS namespace, '{u}' AS unit FROM cfacts WHERE {c}" for c, v, f, n, u in IN_UNITS)}),
  known AS (SELECT * FROM mf WHERE filed <= DATE '{AS_OF}'), pick AS (SELECT entity, namespace, tag, arg_min(unit, (CASE unit WHEN 'USD' THEN 0 WHEN 'shares' THEN 1 ELSE 2 END, unit)) AS unit FROM known GROUP BY ALL),
  vis AS (SELECT entity, namespace || '|' || tag || '|' || unit AS tag, start_day, end_day, filed, value, seq FROM known JOIN pick USING (entity, namespace, tag, unit)), {LATEST}, {FLOWS}"""


@query("unit_flows", f"""{SQL_UNITS} SELECT entity, split_part(tag, '|', 1) AS namespace, split_part(tag, '|', 2) AS tag, split_part(tag, '|', 3) AS unit, scope, {txt('end_day')}, {rnd('value', digits=4)}
  FROM (SELECT *, 'annual' AS scope FROM ann UNION ALL SELECT *, 'quarterly' FROM qtr)""", digits=4)
def unit_flows(spark, d):
    """Annual and quarterly flows of tags filed in several units and namespaces, in the unit preferred at the date."""
    f = R.cumulative_facts(spark, d)
    filed = {"filed": F.col("filed"), "filed + 4000": F.date_add("filed", 4000)}
    parts = [f.where(c).withColumns({"value": F.expr(v), "filed": filed[at], "namespace": F.lit(n), "unit": F.lit(u)}) for c, v, at, n, u in IN_UNITS]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    keys = ("entity", "namespace", "tag", "unit")
    known = pit.one_unit(pit.visible(every, AS_OF), namespace=None)
    return pit.tag_flows(pit.latest_filed(known, instant=False, keys=keys), keys).select(*keys, "scope", "end_day", "value")


@query("annual_flows", f"{CVIS}, {FLOWS} SELECT entity, tag, {txt('end_day')}, {rnd('value', digits=2)} FROM ann", digits=2)
def annual_flows(spark, d):
    return pit.annual_flows(pit.latest_filed(pit.visible(R.cumulative_facts(spark, d), AS_OF), instant=False))


@query("ytd_subtrahend", f"{CVIS}, {FLOWS} SELECT entity, tag, {txt('end_day')}, {rnd('value', digits=2)} FROM qtr", digits=2)
def ytd_subtrahend(spark, d):
    return pit.quarterly_flows(pit.latest_filed(pit.visible(R.cumulative_facts(spark, d), AS_OF), instant=False))


@query("chain_first_present", f"""{VIS}, {CHAIN_SQL}, inst AS (
  SELECT entity, tag, end_day, arg_max(value, (filed, seq)) AS value FROM vis GROUP BY ALL)
  SELECT entity, label, {txt('end_day')}, arg_min(value, priority) AS value
  FROM inst JOIN concepts USING (tag) GROUP BY entity, label, inst.end_day""")
def chain_first_present(spark, d):
    inst = pit.latest_filed(pit.visible(R.facts(spark, d), AS_OF), instant=True)
    return pit.first_present(inst, pit.concept_table(spark, CHAINS))


@query("per_tag_chain", f"""{CVIS}, {FLOWS}, {CHAIN_SQL},
  fl AS (SELECT *, 'annual' AS scope FROM ann UNION ALL SELECT *, 'quarterly' AS scope FROM qtr)
  SELECT entity, label, scope, {txt('end_day')}, round(arg_min(value, priority), 2) AS value
  FROM fl JOIN concepts USING (tag) GROUP BY entity, label, scope, fl.end_day""", digits=2)
def per_tag_chain(spark, d):
    return pit.chain_flows(pit.visible(R.cumulative_facts(spark, d), AS_OF), pit.concept_table(spark, CHAINS))


@query("exact_span_compose", f"""{CVIS} SELECT entity, {txt('start_day')}, {txt('end_day')}, round(SUM(value), 2) AS value
  FROM lf WHERE tag IN ('4-NOT SPECIFIED', '5-LOW') GROUP BY entity, lf.start_day, lf.end_day HAVING COUNT(*) = 2""", digits=2)
def exact_span_compose(spark, d):
    periods = pit.latest_filed(pit.visible(R.cumulative_facts(spark, d), AS_OF), instant=False)
    return pit.compose_spans(periods, ("4-NOT SPECIFIED", "5-LOW"), "DepreciationAndAmortization").drop("tag")


FOLD = VIS.replace("o_orderpriority AS tag", "o_orderpriority || o_orderstatus AS tag").replace(AS_OF, "1996-03-31")


@query("tag_gap_fold", f"""{FOLD}, idx AS (
  SELECT entity, tag, end_day, arg_max(value, seq) AS value FROM facts WHERE filed > DATE '1996-03-31' GROUP BY ALL)
  , pts AS (SELECT entity, tag, max(end_day) AS end_day, arg_max(value, end_day) AS value FROM idx GROUP BY ALL)
  SELECT entity, tag, {txt('end_day')}, value, 'index' AS source FROM pts
  WHERE NOT EXISTS (SELECT 1 FROM vis v WHERE v.entity = pts.entity AND v.tag = pts.tag)
    AND EXISTS (SELECT 1 FROM vis v WHERE v.entity = pts.entity)
  UNION ALL SELECT entity, tag, {txt('end_day')}, value, 'series' AS source FROM vis""")
def tag_gap_fold(spark, d):
    """One latest point per (entity, tag) fills tags the series lacks, for known entities."""
    facts = R.facts(spark, d).withColumn("tag", F.concat("tag", "form"))
    series = pit.visible(facts, "1996-03-31").select("entity", "tag", "end_day", "value")
    index = (facts.where(F.col("filed") > F.lit("1996-03-31").cast("date")).groupBy("entity", "tag")
             .agg(F.max_by(F.struct("end_day", "value"), F.struct("end_day", "seq")).alias("p"))
             .select("entity", "tag", "p.end_day", "p.value"))
    held = series.select("entity", "tag").distinct()
    add = (index.join(held, ["entity", "tag"], "left_anti")
           .join(held.select("entity").distinct(), "entity", "left_semi"))
    return series.withColumn("source", F.lit("series")).unionByName(add.withColumn("source", F.lit("index")))


@query("tier_merge", f"""{VIS}, b AS (SELECT entity, tag, end_day, value, seq FROM vis WHERE form = 'F'),
  x AS (SELECT entity, tag, end_day, value, seq FROM vis WHERE form = 'O')
  SELECT entity, tag, {txt('end_day')}, value, seq, 'base' AS source FROM b UNION ALL
  SELECT entity, tag, {txt('end_day')}, value, seq, 'second' AS source FROM x
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.entity = x.entity AND b.tag = x.tag)""")
def tier_merge(spark, d):
    v = pit.visible(R.facts(spark, d), AS_OF).select("entity", "tag", "end_day", "value", "seq", "form")
    return pit.fill_absent(v.where("form = 'F'").drop("form"), v.where("form = 'O'").drop("form"),
                           ("entity", "tag"), "second")


@query("additive_union", f"""{VIS}, b AS (SELECT entity, seq, value FROM vis WHERE tag = '1-URGENT'),
  x AS (SELECT entity, seq, value FROM vis WHERE tag = '2-HIGH' AND form = 'P')
  SELECT entity, seq, value, 'base' AS source FROM b UNION ALL SELECT entity, seq, value, 'bootstrap' AS source FROM x
  WHERE entity NOT IN (SELECT entity FROM b)""")
def additive_union(spark, d):
    v = pit.visible(R.facts(spark, d), AS_OF)
    cols = ("entity", "seq", "value")
    return pit.fill_absent(v.where("tag = '1-URGENT'").select(*cols),
                           v.where("tag = '2-HIGH' AND form = 'P'").select(*cols), ("entity",), "bootstrap")


@query("conflict_refusal", f"""{VIS}, g AS (SELECT entity, tag, end_day, filed, min(round(value / 250000)) AS lo,
  max(round(value / 250000)) AS hi FROM vis GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY entity, tag, end_day ORDER BY filed DESC) AS rn FROM g)
  SELECT entity, tag, {txt('end_day')}, lo AS value FROM t WHERE rn = 1 AND lo = hi""")
def conflict_refusal(spark, d):
    v = pit.visible(R.facts(spark, d), AS_OF).withColumn("value", F.round(F.col("value") / 250000))
    return pit.agreeing(v, ("entity", "tag", "end_day"))


@query("pays_interest", f"""{VIS}, {LATEST}, fl AS (SELECT entity, max(abs(value)) AS peak FROM lf WHERE tag = '4-NOT SPECIFIED' GROUP BY ALL),
  a AS (SELECT entity, tag, end_day, arg_max(value, (filed, seq)) AS value FROM vis WHERE tag = '1-URGENT' GROUP BY ALL),
  b AS (SELECT entity, max(value) AS assets FROM a GROUP BY ALL)
  SELECT fl.entity, peak > greatest(1e5, coalesce(assets, 0) * 1e-4) AS pays FROM fl LEFT JOIN b ON b.entity = fl.entity""")
def pays_interest(spark, d):
    return pit.pays_interest(pit.visible(R.facts(spark, d), AS_OF), ("4-NOT SPECIFIED",), ("1-URGENT",))


SH = f"WITH {R.SQL_SHARES}, vis AS (SELECT * FROM share_counts WHERE filed <= DATE '{AS_OF}')"
SERIES = """pf AS (SELECT entity, filed, min(end_day) AS end_day, max(end_day) AS last, SUM(value) AS value FROM vis GROUP BY ALL),
  ser AS (SELECT entity, end_day, arg_max(value, filed) AS value FROM pf
    WHERE entity NOT IN (SELECT entity FROM pf WHERE end_day <> last) GROUP BY ALL)"""


@query("class_share_sum", f"{SH}, {SERIES} SELECT entity, {txt('end_day')}, value FROM ser")
def class_share_sum(spark, d):
    return pit.class_share_series(pit.visible(R.share_counts(spark, d), AS_OF))


@query("share_fallback", f"""{SH}, pf AS (SELECT entity, filed, min(end_day) AS lo, max(end_day) AS hi, SUM(value) AS total,
    arg_max(end_day, (value, -seq)) AS te, arg_max(value, (value, -seq)) AS tv FROM vis GROUP BY ALL),
  l AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY filed DESC) AS rn FROM pf)
  SELECT entity, {txt('CASE WHEN hi - lo <= 45 THEN hi ELSE te END', 'end_day')},
    CASE WHEN hi - lo <= 45 THEN total ELSE tv END AS value,
    CASE WHEN hi - lo <= 45 THEN 'fallback-sum' ELSE 'fallback-largest' END AS basis FROM l WHERE rn = 1""")
def share_fallback(spark, d):
    return pit.share_fallback(pit.visible(R.share_counts(spark, d), AS_OF))


@query("split_restatement", f"""{SH}, {SERIES}, {R.SQL_SPLITS}
  SELECT ser.entity, {txt('ser.end_day', 'end_day')},
    round(any_value(value) * coalesce(product(ratio), 1), 4) AS value
  FROM ser LEFT JOIN splits ON splits.symbol = ser.entity AND splits.day > ser.end_day AND splits.day <= DATE '{AS_OF}'
  GROUP BY ser.entity, ser.end_day""", digits=4)
def split_restatement(spark, d):
    series = pit.class_share_series(pit.visible(R.share_counts(spark, d), AS_OF))
    return asof.restate(series, R.splits(spark, d), until=AS_OF)


@query("tag_selection", f"""WITH {R.SQL_FACTS}, {CHAIN_SQL} SELECT entity, tag, {txt('end_day')}, value, seq FROM facts
  WHERE tag IN (SELECT tag FROM concepts)""")
def tag_selection(spark, d):
    concepts = pit.concept_table(spark, CHAINS)
    return R.facts(spark, d).join(concepts, "tag", "left_semi").select("entity", "tag", "end_day", "value", "seq")


@query("history_horizon", f"""WITH {R.SQL_CUMULATIVE}, {R.SQL_FACTS}, h AS (SELECT * FROM cfacts UNION ALL
    SELECT entity, CASE WHEN tag = '5-LOW' THEN '{pit.SHARES_TAG}' ELSE tag END, NULL, end_day, filed, CASE form WHEN 'F' THEN '10-K/A' ELSE '10-Q' END, value, seq FROM facts),
  w AS (SELECT *, row_number() OVER k AS rn, bool_or(form = '10-K/A') OVER (PARTITION BY entity, tag, start_day, end_day) AS annual FROM h
    WHERE tag <> '{pit.SHARES_TAG}' WINDOW k AS (PARTITION BY entity, tag, start_day, end_day ORDER BY filed DESC, seq DESC))
  SELECT entity, tag, {txt('start_day')}, {txt('end_day')}, {rnd('value', digits=2)}, seq FROM w
  WHERE rn = 1 AND (CASE WHEN start_day IS NULL THEN annual ELSE end_day - start_day >= 330 END OR end_day >= DATE '1996-01-01')
  UNION ALL SELECT entity, tag, NULL, {txt('end_day')}, {rnd('value', digits=2)}, seq FROM h WHERE tag = '{pit.SHARES_TAG}'""", digits=2)
def history_horizon(spark, d):
    """Year-to-date spans, and every order as a point in time; one priority stands in for the share tag."""
    points = R.facts(spark, d).withColumns({"start_day": F.lit(None).cast("date"), "form": F.when(F.col("form") == "F", "10-K/A").otherwise("10-Q"),
                                            "tag": F.when(F.col("tag") == "5-LOW", pit.SHARES_TAG).otherwise(F.col("tag"))})
    rows = R.cumulative_facts(spark, d)
    return pit.prune_history(rows.unionByName(points.select(rows.columns)), "2001-12-31").select("entity", "tag", "start_day", "end_day", "value", "seq")


@query("last_per_date", f"""WITH {R.SQL_SHARES} SELECT entity, {txt('end_day')}, arg_max(value, (filed, seq, value)) AS value
  FROM share_counts GROUP BY entity, share_counts.end_day""")
def last_per_date(spark, d):
    return R.share_counts(spark, d).groupBy("entity", "end_day").agg(
        F.max_by("value", F.struct("filed", "seq", "value")).alias("value"))


@query("asof_price", f"""WITH {R.SQL_BARS}, {R.SQL_POSITIONS}
  SELECT p.symbol, {txt('p.as_of', 'as_of')}, {rnd('b.close', 'close', 9)}, {txt('b.day', 'day_at')}
  FROM positions p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.as_of >= b.day""", digits=9)
def asof_price(spark, d):
    ticks = R.positions(spark, d).select("symbol", "as_of")
    return asof.asof_join(ticks, R.bars(spark, d), "symbol", "as_of", "day", ("close",))


@query("asof_shares", f"""WITH {R.SQL_SHARES}, ob AS (SELECT entity, end_day, arg_max(value, (filed, seq, value)) AS value
    FROM share_counts GROUP BY ALL), {R.SQL_STATEMENTS}
  SELECT s.entity, {txt('s.period_end', 'period_end')}, ob.value, {txt('ob.end_day', 'end_day_at')}
  FROM (SELECT * FROM stm WHERE scope = 'annual') s ASOF LEFT JOIN ob ON s.entity = ob.entity AND s.period_end >= ob.end_day""")
def asof_shares(spark, d):
    annual = R.statements(spark, d).where("scope = 'annual'").select("entity", "period_end")
    return asof.asof_join(annual, last_per_date(spark, d), "entity", "period_end", "end_day", ("value",))


BOUND = "2000-12-31"
CAPROWS = f"""px AS (SELECT symbol, max(day) AS price_day, arg_max(close, day) AS price FROM bars WHERE day <= DATE '{BOUND}' GROUP BY ALL),
  sc AS (SELECT entity, end_day, arg_max(value, (filed, seq, value)) AS value FROM share_counts WHERE filed <= DATE '{BOUND}' GROUP BY ALL),
  sh AS (SELECT entity, max(end_day) AS shares_day, arg_max(value, end_day) AS shares FROM sc WHERE end_day <= DATE '{BOUND}' GROUP BY ALL),
  cap AS (SELECT sh.entity, shares_day, shares, price_day, price FROM sh LEFT JOIN px ON px.symbol = sh.entity)"""


def cap_rows(spark, d):
    px = asof.latest_at(R.bars(spark, d), "symbol", "day", BOUND, ("close",)).select(
        F.col("symbol").alias("entity"), F.col("day").alias("price_day"), F.col("close").alias("price"))
    counts = (pit.visible(R.share_counts(spark, d), BOUND).groupBy("entity", "end_day")
              .agg(F.max_by("value", F.struct("filed", "seq", "value")).alias("value")))
    sh = asof.latest_at(counts, "entity", "end_day", BOUND, ("value",)).select(
        "entity", F.col("end_day").alias("shares_day"), F.col("value").alias("shares"))
    return sh.join(px, "entity", "left")


@query("asof_bounded", f"""WITH {R.SQL_BARS}, {R.SQL_SHARES}, {CAPROWS}, w AS (
    SELECT entity, max(period_end) AS wa_day, arg_max(basic, period_end) AS wa FROM (
      SELECT l_suppkey AS entity, {R._q_end('l_shipdate')} AS period_end, SUM(l_quantity) AS basic FROM lineitem
      WHERE l_shipdate <= DATE '{BOUND}' GROUP BY ALL) GROUP BY ALL)
  SELECT cap.entity,
    {rnd(f"CASE WHEN DATE '{BOUND}' - price_day <= 45 THEN price END", 'price')},
    CASE WHEN price IS NULL THEN 'none' WHEN DATE '{BOUND}' - price_day > 45 THEN 'refused: '
      || (DATE '{BOUND}' - price_day) || 'd old' ELSE 'ok' END AS price_note,
    CASE WHEN DATE '{BOUND}' - shares_day <= 450 THEN shares WHEN wa IS NOT NULL AND DATE '{BOUND}' - wa_day <= 450 THEN wa END AS shares,
    CASE WHEN DATE '{BOUND}' - shares_day <= 450 THEN 'series' WHEN wa IS NOT NULL AND DATE '{BOUND}' - wa_day <= 450
      THEN 'weighted-average' ELSE 'stale-refused' END AS shares_basis
  FROM cap LEFT JOIN w ON w.entity = cap.entity""")
def asof_bounded(spark, d):
    """Price older than 45 days refused; a count older than 450 days replaced by
    the weighted average, else refused."""
    at = F.lit(BOUND).cast("date")
    day = F.col("l_shipdate").cast("date")
    wa = (R.table(spark, d, "lineitem").where(day <= at)
          .groupBy(F.col("l_suppkey").alias("entity"), R._quarter_end(day).alias("wa_day"))
          .agg(F.sum("l_quantity").alias("wa")).groupBy("entity")
          .agg(F.max("wa_day").alias("wa_day"), F.max_by("wa", "wa_day").alias("wa")))
    price_age, share_age = F.datediff(at, "price_day"), F.datediff(at, "shares_day")
    fresh = share_age <= asof.SHARES_MAX_AGE_DAYS
    wa_ok = F.col("wa").isNotNull() & (F.datediff(at, "wa_day") <= asof.SHARES_MAX_AGE_DAYS)
    return cap_rows(spark, d).join(wa, "entity", "left").select(
        "entity",
        F.when(price_age <= asof.PRICE_MAX_AGE_DAYS, F.col("price")).alias("price"),
        F.when(F.col("price").isNull(), "none").when(
            price_age > asof.PRICE_MAX_AGE_DAYS, F.format_string("refused: %dd old", price_age))
        .otherwise("ok").alias("price_note"),
        F.when(fresh, F.col("shares")).when(wa_ok, F.col("wa")).alias("shares"),
        F.when(fresh, "series").when(wa_ok, "weighted-average").otherwise("stale-refused").alias("shares_basis"))


@query("market_cap_basis", f"""WITH {R.SQL_BARS}, {R.SQL_SHARES}, {R.SQL_SPLITS}, {CAPROWS}
  SELECT cap.entity, CASE WHEN cap.entity % 2 = 0 THEN 'raw' ELSE 'split_adjusted_today' END AS basis,
    round(any_value(shares) * coalesce(product(ratio) FILTER (cap.entity % 2 = 1 OR splits.day <= DATE '{BOUND}'), 1) * any_value(price), 2) AS market_cap,
    cap.entity % 2 = 1 AND NOT EXISTS (SELECT 1 FROM splits s2 WHERE s2.symbol = cap.entity) AND any_value(price) IS NOT NULL AS split_unverified
  FROM cap LEFT JOIN splits ON splits.symbol = cap.entity AND splits.day > cap.shares_day GROUP BY cap.entity""", digits=2)
def market_cap_basis(spark, d):
    rows = cap_rows(spark, d).withColumn(
        "basis", F.when(F.col("entity") % 2 == 0, "raw").otherwise("split_adjusted_today"))
    return asof.market_cap(rows, R.splits(spark, d), BOUND, F.col("basis")).select(
        "entity", "basis", "market_cap", "split_unverified")


TREND = """g AS (SELECT entity, max(end_day) AS d1, arg_max(value, end_day) AS v1, min(end_day) AS d00, arg_min(value, end_day) AS v00, count(*) AS n FROM ob GROUP BY ALL),
  p AS (SELECT ob.entity, max(ob.end_day) AS dp, arg_max(ob.value, ob.end_day) AS vp FROM ob JOIN g ON g.entity = ob.entity
        WHERE ob.end_day <= g.d1 - 365 GROUP BY ALL),
  t AS (SELECT g.entity, d1, v1, n, coalesce(dp, d00) AS d0, coalesce(vp, v00) AS v0, dp, vp FROM g LEFT JOIN p ON p.entity = g.entity)"""


@query("asof_year_prior", f"""WITH {R.SQL_SHARES}, ob AS (SELECT entity, end_day, arg_max(value, (filed, seq, value)) AS value
    FROM share_counts GROUP BY ALL), {TREND}
  SELECT entity, round(CASE WHEN n >= 2 AND (d1 - d0) / 365.25 >= 0.25 THEN 100.0 * (pow(v1 / v0, 1.0 / ((d1 - d0) / 365.25)) - 1) END, 4) AS trend_pct,
    round(100.0 * (v1 - vp) / vp, 4) AS yoy_pct, CASE WHEN vp IS NULL THEN 'STALE' ELSE 'FRESH' END AS yoy_state FROM t""", digits=4)
def asof_year_prior(spark, d):
    from lodestat.operators import series
    return series.share_trend(last_per_date(spark, d))
