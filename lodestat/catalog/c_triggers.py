"""Trigger documents and their tests."""

from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog.registry import query, rnd, txt
from lodestat.operators import monitor
from lodestat.operators import portfolio as P
from lodestat.operators import triggers as T
from lodestat.session import stage, staged

# (id, kind, metric, op, threshold, needed, action) as SQL over s_suppkey
SPECS = (("'T1'", "'metric'", "'gross_margin'", "'<'", "40.0 + s_suppkey % 20", "2", "'break'"),
         ("'T2'", "'metric'", "'ocf_margin'", "CASE WHEN s_suppkey % 9 = 0 THEN '!' ELSE '<=' END", "CASE WHEN s_suppkey % 11 = 0 THEN 0.0 ELSE 20.0 END", "1", "'review'"),
         ("CASE WHEN s_suppkey % 7 = 0 THEN 'T2' ELSE 'T3' END", "'event'", "NULL", "NULL", "NULL", "1", "'break'"),
         ("'T4'", "'narrative'", "NULL", "NULL", "NULL", "1", "CASE WHEN s_suppkey % 8 = 0 THEN 'break' ELSE 'review' END"))
FIELDS = ("id", "kind", "metric", "op", "threshold", "needed", "action")
MOAT = "CASE WHEN s_suppkey % 13 = 0 THEN 'vibes' ELSE 'brand_trust' END"
DOC_STATUS = "CASE WHEN s_suppkey % 17 = 0 THEN 'broken' ELSE 'committed' END"
SQL_TRIG = "trig AS (" + " UNION ALL ".join(
    "SELECT s_suppkey AS entity, " + DOC_STATUS + " AS doc_status, " + ", ".join(f"{('CAST(NULL AS DOUBLE)' if v == 'NULL' and f == 'threshold' else 'CAST(NULL AS VARCHAR)' if v == 'NULL' else v)} AS {f}" for f, v in zip(FIELDS, sp))
    + f", {i} AS pos FROM supplier" + (" WHERE s_suppkey % 5 <> 0" if i >= 2 else "") for i, sp in enumerate(SPECS)) + ")"
SQL_VALUES = f"""{R.SQL_STATEMENTS}, vals AS (SELECT entity, period_end, 'gross_margin' AS metric, 100.0 * gross_profit / revenue AS value FROM stm WHERE scope = 'quarterly' UNION ALL
  SELECT entity, period_end, 'ocf_margin', 100.0 * ocf / revenue FROM stm WHERE scope = 'quarterly')"""
TR = f"WITH {SQL_TRIG}, {SQL_VALUES}"
LATEST = "lv AS (SELECT entity, metric, arg_max(value, period_end) AS value FROM vals WHERE value IS NOT NULL GROUP BY entity, metric)"
HIT = "coalesce(CASE op WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold END, false)"


def docs(spark, d):
    """One document per supplier with a nested array of triggers."""
    types = dict(zip(FIELDS, ("string", "string", "string", "string", "double", "int", "string")))
    one = [F.expr("named_struct(" + ", ".join(f"'{f}', CAST({v} AS {types[f]})" for f, v in zip(FIELDS, sp)) + ")") for sp in SPECS]
    arr = F.when(F.col("s_suppkey") % 5 != 0, F.array(*one)).otherwise(F.array(*one[:2]))
    return R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.expr(DOC_STATUS).alias("status"), F.expr(MOAT).alias("moat"), arr.alias("triggers"))


def metric_values(spark, d):
    s = R.statements(spark, d).where("scope = 'quarterly'")
    pair = F.array(F.struct(F.lit("gross_margin").alias("metric"), (100.0 * F.col("gross_profit") / F.col("revenue")).alias("value")),
                   F.struct(F.lit("ocf_margin").alias("metric"), (100.0 * F.col("ocf") / F.col("revenue")).alias("value")))
    return s.select("entity", "period_end", F.explode(pair).alias("m")).select("entity", "period_end", "m.metric", "m.value")


def latest_values(spark, d):
    return metric_values(spark, d).where("value IS NOT NULL").groupBy("entity", "metric").agg(F.max_by("value", "period_end").alias("value"))


@query("open_questions", f"WITH {SQL_TRIG} SELECT entity, id, kind FROM trig WHERE kind IN ('event', 'narrative')")
def open_questions(spark, d):
    return T.rows(docs(spark, d)).where("kind IN ('event', 'narrative')").select("entity", "id", "kind")


@query("udtf_trigger_explode", f"WITH {SQL_TRIG} SELECT entity, id, kind, metric, op, threshold, needed, action FROM trig")
def udtf_trigger_explode(spark, d):
    return T.rows(docs(spark, d)).select("entity", *FIELDS)


@query("rule_violations", f"""WITH {SQL_TRIG}, g AS (SELECT entity, count(*) AS n, count(DISTINCT id) AS k, bool_or(kind = 'metric' AND op = '!') AS badop, bool_or(kind = 'narrative' AND action <> 'review') AS nar, entity % 13 = 0 AS moat FROM trig GROUP BY entity)
  SELECT entity, array_to_string(list_filter([CASE WHEN moat THEN 'moat kind unknown' END, CASE WHEN n < 3 THEN 'only ' || n || ' triggers, need 3' END, CASE WHEN k < n THEN 'duplicate trigger id' END, CASE WHEN badop THEN 'metric trigger incomplete' END,
    CASE WHEN nar THEN 'narrative trigger must review' END], lambda x: x IS NOT NULL), '; ') AS problems FROM g""")
def rule_violations(spark, d):
    return T.violations(docs(spark, d)).select("entity", F.array_join("problems", "; ").alias("problems"))


@query("trigger_eval", f"""{TR}, {LATEST} SELECT t.entity, id, round(value, 4) AS value, {HIT} AS hit, round(CASE WHEN threshold = 0 THEN CASE WHEN op LIKE '<%' THEN value - threshold ELSE threshold - value END
   ELSE 100.0 * (CASE WHEN op LIKE '<%' THEN value - threshold ELSE threshold - value END) / abs(threshold) END, 4) AS margin FROM trig t LEFT JOIN lv ON lv.entity = t.entity AND lv.metric = t.metric WHERE kind = 'metric'""", digits=4)
def trigger_eval(spark, d):
    rows = T.rows(docs(spark, d)).where("kind = 'metric'")
    return T.evaluate(rows, latest_values(spark, d)).select("entity", "id", "value", "hit", "margin")


STREAK = f"""ck AS (SELECT t.entity, t.id, t.needed, t.action, v.period_end AS day, {HIT} AS hit FROM trig t JOIN vals v ON v.entity = t.entity AND v.metric = t.metric WHERE kind = 'metric' AND value IS NOT NULL),
  isl AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY entity, id ORDER BY day) AS isle FROM ck),
  sk AS (SELECT *, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY entity, id, isle ORDER BY day) AS BIGINT) AS streak FROM isl)"""


def streak_rows(spark, d, keys=None):
    """Streaks of all theses, or of the given ones."""
    only = lambda df: df if keys is None else df.join(keys, "entity", "left_semi")
    rows = T.rows(only(docs(spark, d))).where("kind = 'metric'")
    v = only(metric_values(spark, d)).where("value IS NOT NULL").withColumnRenamed("period_end", "day")
    hit = F.coalesce(T.hit(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False))
    checks = rows.join(v, ["entity", "metric"]).select("entity", "id", "day", F.lit(0).alias("seq"), hit.alias("hit"))
    return T.streaks(checks)


@query("streak", f"{TR}, {STREAK} SELECT entity, id, {txt('day')}, hit, streak FROM sk")
def streak(spark, d):
    return streak_rows(spark, d)


@query("persistence_breach", f"""{TR}, b AS (SELECT entity, period_end, CASE WHEN entity % 6 = 0 AND period_end <= DATE '2001-10-01' THEN NULL WHEN entity % 10 = 1 AND period_end >= DATE '2001-03-01' THEN NULL ELSE value END AS value FROM vals WHERE metric = 'gross_margin'), s AS (SELECT * FROM b WHERE value IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS rn FROM s), g AS (SELECT entity, count(*) AS n, max(period_end) AS last, arg_max(value, period_end) AS observed, bool_and(value < 60) AS h FROM k WHERE rn <= 2 GROUP BY entity),
  r AS (SELECT *, CASE WHEN DATE '2002-01-15' - last > 135 THEN 'STALE' WHEN n < 2 THEN 'BOOTSTRAPPING' WHEN h THEN 'FIRE' ELSE 'PASS' END AS result FROM g)
  SELECT entity, result, round(CASE WHEN result IN ('FIRE', 'PASS') THEN observed END, 4) AS observed, round(CASE WHEN result IN ('FIRE', 'PASS') THEN observed - 60 END, 4) AS headroom,
   CASE WHEN result = 'BOOTSTRAPPING' THEN CAST(last + 91 * (2 - CAST(n AS INTEGER)) AS VARCHAR) END AS evaluable_from FROM r""", digits=4)
def persistence_breach(spark, d):
    blank = "entity % 6 = 0 AND period_end <= DATE'2001-10-01' OR entity % 10 = 1 AND period_end >= DATE'2001-03-01'"
    s = metric_values(spark, d).where("metric = 'gross_margin'").withColumn("value", F.when(~F.expr(blank), F.col("value"))).where("value IS NOT NULL")
    rules = docs(spark, d).select("entity", F.lit("<").alias("op"), F.lit(60.0).alias("threshold"), F.lit(2).alias("need"))
    return T.persistence(s.drop("metric"), rules, "2002-01-15")


VERDICTS = "vd AS (SELECT l_suppkey AS entity, arg_max(l_returnflag = 'R', (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS tripped, arg_max(CASE WHEN l_quantity < 25 THEN 'high' ELSE 'low' END, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS confidence FROM lineitem WHERE l_suppkey % 4 <> 3 GROUP BY l_suppkey)"


def verdicts(spark, d):
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return (R.table(spark, d, "lineitem").where("l_suppkey % 4 <> 3").groupBy(F.col("l_suppkey").alias("entity")).agg(
        F.max_by(F.col("l_returnflag") == "R", order).alias("v_tripped"), F.max_by(F.when(F.col("l_quantity") < 25, "high").otherwise("low"), order).alias("confidence")))


ROLL = f"""{TR}, {STREAK}, {VERDICTS}, ls AS (SELECT entity, id, arg_max(streak, day) AS streak FROM sk GROUP BY entity, id),
  rs AS (SELECT t.*, CASE WHEN kind = 'metric' THEN ls.streak IS NOT NULL ELSE vd.tripped IS NOT NULL END AS checked, CASE WHEN kind = 'metric' THEN coalesce(ls.streak >= needed, false) ELSE coalesce(vd.tripped, false) END AS tripped, CASE WHEN kind <> 'metric' THEN vd.confidence END AS confidence
    FROM trig t LEFT JOIN ls ON ls.entity = t.entity AND ls.id = t.id AND t.kind = 'metric' LEFT JOIN vd ON vd.entity = t.entity),
  rf AS (SELECT *, checked AND tripped AND action = 'break' AND NOT coalesce(kind = 'event' AND confidence <> 'high', false) AS br FROM rs),
  rg AS (SELECT entity, doc_status, coalesce(string_agg(id, ',' ORDER BY id) FILTER (br), '') AS broken_by, coalesce(string_agg(id, ',' ORDER BY id) FILTER (checked AND tripped AND NOT br), '') AS review_by, coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT checked), '') AS unchecked FROM rf GROUP BY entity, doc_status),
  roll AS (SELECT entity, CASE WHEN doc_status = 'broken' OR broken_by <> '' THEN 'broken' WHEN review_by <> '' THEN 'under_review' ELSE 'intact' END AS status, broken_by, review_by, unchecked FROM rg)"""


def results(spark, d, keys=None, answers=None):
    only = lambda df: df if keys is None else df.join(keys, "entity", "left_semi")
    last = streak_rows(spark, d, keys).groupBy("entity", "id").agg(F.max_by("streak", "day").alias("streak")).withColumn("kind", F.lit("metric"))
    j = T.rows(only(docs(spark, d))).join(last, ["entity", "id", "kind"], "left").join(verdicts(spark, d) if answers is None else answers, "entity", "left")
    metric = F.col("kind") == "metric"
    return j.withColumns({
        "checked": F.when(metric, F.col("streak").isNotNull()).otherwise(F.col("v_tripped").isNotNull()),
        "tripped": F.when(metric, F.coalesce(F.col("streak") >= F.col("needed"), F.lit(False))).otherwise(F.coalesce("v_tripped", F.lit(False))),
        "confidence": F.when(~metric, F.col("confidence"))})


@query("thesis_rollup", f"{ROLL} SELECT * FROM roll")
def thesis_rollup(spark, d):
    return T.rollup(results(spark, d))


REPORT_SQL = """rm AS (SELECT *, CASE WHEN NOT checked THEN 'unchecked' WHEN br THEN 'broke' WHEN tripped THEN 'review' ELSE 'ok' END AS mark,
    CASE WHEN kind = 'metric' AND checked THEN streak || ' of ' || needed || ' checks' WHEN kind = 'metric' THEN 'no value' WHEN NOT checked THEN 'no verdict'
      ELSE CASE WHEN tripped THEN 'tripped' ELSE 'not tripped' END || ' (' || confidence || ' confidence)' || CASE WHEN tripped AND kind = 'event' AND action = 'break' AND confidence <> 'high' THEN ', asks for review' ELSE '' END END AS reason
    FROM (SELECT rf.*, ls.streak FROM rf LEFT JOIN ls ON ls.entity = rf.entity AND ls.id = rf.id)),
  rep AS (SELECT entity, string_agg(id || '|' || kind || '|' || action || '|' || mark || '|' || reason, '; ' ORDER BY pos) AS triggers, string_agg(id, ',' ORDER BY pos) FILTER (mark = 'broke') AS broken_by,
    string_agg(id, ',' ORDER BY pos) FILTER (mark = 'review') AS review_by, string_agg(id, ',' ORDER BY pos) FILTER (mark = 'unchecked') AS unchecked FROM rm GROUP BY entity)"""


@query("monitor_run", f"""{ROLL}, {REPORT_SQL} SELECT rep.entity, roll.status, coalesce(rep.broken_by, '') AS broken_by, coalesce(rep.review_by, '') AS review_by, coalesce(rep.unchecked, '') AS unchecked, triggers,
   rep.entity % 3 = 0 AND vd.entity IS NOT NULL AS retested FROM rep JOIN roll ON roll.entity = rep.entity LEFT JOIN vd ON vd.entity = rep.entity""")
def monitor_run(spark, d):
    """The second of two runs: verdicts on every third thesis arrived in between, so that only these are tested again."""
    theses = docs(spark, d).select("entity", "status")
    answers = staged(spark, d, "verdicts", lambda: verdicts(spark, d))
    inputs = (T.rows(docs(spark, d)), metric_values(spark, d))
    early = answers.where("entity % 3 <> 0")
    first = stage(monitor.run(theses, monitor.fingerprints(*inputs, early), lambda keys: results(spark, d, keys, early)), "monitor")
    out = monitor.run(theses, monitor.fingerprints(*inputs, answers), lambda keys: results(spark, d, keys, answers), first)
    line = F.transform("triggers", lambda t: F.concat_ws("|", t["id"], t["kind"], t["action"], t["mark"], t["reason"]))
    return out.select("entity", "status", *[F.array_join(c, ",").alias(c) for c in ("broken_by", "review_by", "unchecked")], F.array_join(line, "; ").alias("triggers"), "retested")


@query("monitor_counts", f"{ROLL} SELECT status, count(*) AS theses, count(*) FILTER (unchecked <> '') AS with_gaps FROM roll GROUP BY status")
def monitor_counts(spark, d):
    """Theses per status, and those with a trigger that could not be checked."""
    return T.rollup(results(spark, d)).groupBy("status").agg(F.count("*").alias("theses"), F.count_if(F.col("unchecked") != "").alias("with_gaps"))


@query("trigger_counts", f"{ROLL} SELECT CASE WHEN NOT checked THEN 'UNVERIFIABLE' WHEN tripped THEN 'FIRE' ELSE 'PASS' END AS result, count(*) AS n FROM rs GROUP BY 1")
def trigger_counts(spark, d):
    r = F.when(~F.col("checked"), "UNVERIFIABLE").when(F.col("tripped"), "FIRE").otherwise("PASS")
    return results(spark, d).groupBy(r.alias("result")).agg(F.count("*").alias("n"))


NEWT = "newt AS (SELECT entity, id, kind, CASE WHEN entity % 10 = 1 AND id = 'T1' THEN 'ocf_margin' ELSE metric END AS metric, op, CASE WHEN entity % 10 = 2 THEN threshold - 5 ELSE threshold END AS threshold, CASE WHEN entity % 10 = 3 THEN needed + 1 ELSE needed END AS needed, action FROM trig WHERE NOT (entity % 10 = 4 AND id = 'T2'))"


def revised(rows):
    k = F.col("entity") % 10
    return rows.where(~((k == 4) & (F.col("id") == "T2"))).withColumns({
        "metric": F.when((k == 1) & (F.col("id") == "T1"), "ocf_margin").otherwise(F.col("metric")),
        "threshold": F.when(k == 2, F.col("threshold") - 5).otherwise(F.col("threshold")), "needed": F.when(k == 3, F.col("needed") + 1).otherwise(F.col("needed"))})


@query("goalpost_diff", f"""WITH {SQL_TRIG}, {NEWT} SELECT o.entity, o.id, CASE WHEN n.kind IS NULL THEN 'removed' WHEN n.metric IS DISTINCT FROM o.metric THEN 'metric changed'
   WHEN CASE WHEN o.op LIKE '<%' THEN n.threshold < o.threshold ELSE n.threshold > o.threshold END THEN 'easier threshold' WHEN n.needed > o.needed THEN 'slower' END AS moved
  FROM trig o LEFT JOIN newt n ON n.entity = o.entity AND n.id = o.id WHERE moved IS NOT NULL""")
def goalpost_diff(spark, d):
    rows = T.rows(docs(spark, d))
    return T.goalposts(rows, revised(rows).drop("doc_status"))


@query("carried_state", f"""{TR}, {STREAK}, {NEWT}, ls AS (SELECT entity, id, arg_max(streak, day) AS streak FROM sk GROUP BY entity, id), same AS (SELECT entity, id, kind, metric, op, threshold, needed, action FROM trig INTERSECT SELECT entity, id, kind, metric, op, threshold, needed, action FROM newt)
  SELECT same.entity, same.id, CASE WHEN kind = 'metric' THEN streak END AS streak FROM same JOIN ls ON ls.entity = same.entity AND ls.id = same.id WHERE kind = 'metric'""")
def carried_state(spark, d):
    """Streaks survive a revision only for triggers it left unchanged."""
    rows = T.rows(docs(spark, d)).select("entity", *FIELDS)
    same = rows.intersect(revised(rows)).where("kind = 'metric'")
    last = streak_rows(spark, d).groupBy("entity", "id").agg(F.max_by("streak", "day").alias("streak"))
    return same.join(last, ["entity", "id"]).select("entity", "id", "streak")


@query("alert_ranking", f"""{ROLL}, {R.SQL_POSITIONS}, w AS (SELECT symbol, mv / (SUM(CAST(round(mv * 100) AS BIGINT)) OVER () / 100.0) AS weight FROM positions WHERE as_of = (SELECT max(as_of) FROM positions))
  SELECT rs.entity, rs.id, round(100 * coalesce(weight, 0), 4) AS weight_pct FROM rs LEFT JOIN w ON w.symbol = rs.entity WHERE checked AND tripped""", digits=4)
def alert_ranking(spark, d):
    """Fired triggers ranked by the weight of their holding."""
    from lodestat.catalog.c_portfolio import latest
    w = P.with_weights(latest(spark, d)).select(F.col("symbol").alias("entity"), "weight")
    fired = results(spark, d).where("checked AND tripped").join(w, "entity", "left")
    return fired.select("entity", "id", (100.0 * F.coalesce("weight", F.lit(0.0))).alias("weight_pct")).orderBy(F.desc("weight_pct"), "entity", "id")


@query("baseline_triggers", f"""{TR}, b AS (SELECT entity, avg(value) FILTER (metric = 'gross_margin') AS gm, stddev_pop(value) FILTER (metric = 'gross_margin') AS sd, avg(value) FILTER (metric = 'ocf_margin') AS om FROM vals GROUP BY entity)
  SELECT entity, 'margin_erosion' AS type, round(gm - 2 * sd, 4) AS threshold FROM b WHERE gm IS NOT NULL UNION ALL SELECT entity, 'growth_floor', round(om / 2, 4) FROM b WHERE om > 0""", digits=4)
def baseline_triggers(spark, d):
    """Thresholds derived from each entity's own baseline."""
    gm, om = F.when(F.col("metric") == "gross_margin", F.col("value")), F.when(F.col("metric") == "ocf_margin", F.col("value"))
    b = metric_values(spark, d).groupBy("entity").agg(F.avg(gm).alias("gm"), F.stddev_pop(gm).alias("sd"), F.avg(om).alias("om"))
    rules = F.array_compact(F.array(
        F.when(F.col("gm").isNotNull(), F.struct(F.lit("margin_erosion").alias("type"), (F.col("gm") - 2 * F.col("sd")).alias("threshold"))),
        F.when(F.col("om") > 0, F.struct(F.lit("growth_floor").alias("type"), (F.col("om") / 2).alias("threshold")))))
    return b.select("entity", F.explode(rules).alias("r")).select("entity", "r.type", "r.threshold")
