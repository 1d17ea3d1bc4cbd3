"""Evidence ledger, runs, coverage, journal and worklists."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog.registry import query, rnd, txt
from lodestat.operators import chunks, ledger  # noqa: F401

L = f"WITH {R.SQL_LEDGER}"
AS_OF = "2024-01-30"


def led(spark, d):
    return R.ledger(spark, d)


@query("view_v_price", f"{L} SELECT ticker, {txt('ledger.day', 'day')}, arg_max(value, (ts, seq)) AS value, max(seq) AS seq FROM ledger GROUP BY ticker, ledger.day")
def view_v_price(spark, d):
    return ledger.latest(led(spark, d).select("ticker", "day", "ts", "value", "seq"), ["ticker", "day"], ["ts", "seq"]).drop("ts")


@query("view_fetch_latest", f"{L} SELECT ticker, arg_max(outcome, (ts, seq)) AS outcome, max(seq) AS seq FROM ledger GROUP BY ticker")
def view_fetch_latest(spark, d):
    return ledger.latest(led(spark, d).select("ticker", "ts", "outcome", "seq"), ["ticker"], ["ts", "seq"]).drop("ts")


@query("view_verdict_latest", f"{L} SELECT ticker, kind, arg_max(value, (ts, seq)) AS value FROM ledger GROUP BY ticker, kind")
def view_verdict_latest(spark, d):
    return ledger.latest(led(spark, d).select("ticker", "kind", "ts", "seq", "value"), ["ticker", "kind"], ["ts", "seq"]).drop("ts", "seq")


KINDS = tuple(R.OUTCOMES)
DEFS = [(i * 2 + v, k, f"v{v + 1}", "REQUIRED" if i < 2 else "OPTIONAL", None if v else "2024-01-20") for i, k in enumerate(KINDS) for v in (0, 1)]
POLICIES = [(0, "PRIMARY", 0, None, None), (1, "FALLBACK", 1, "2024-01-05", None), (2, "FALLBACK", 0, None, None), (3, "PRIMARY", 0, "2024-01-01", "2024-01-25")]


def lit(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


METRIC = f"""{L}, def(definition_id, metric_key, formula_version, requirement, active_until) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in DEFS)}),
  pol(policy_id, source_role, certified, p_from, p_until) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in POLICIES)}),
  obs AS (SELECT ticker, CASE kind {' '.join(f"WHEN '{k}' THEN {i * 2}" for i, k in enumerate(KINDS))} END + seq % 2 AS definition_id, CASE WHEN seq % 5 < 4 THEN seq % 5 END AS policy_id,
    day AS as_of, ts AS calculated_at, seq AS observation_id, value, CASE WHEN value < 20 THEN 'FRESH' WHEN value < 40 THEN 'STALE' WHEN value < 60 THEN 'MISSING' WHEN value < 80 THEN 'CONFLICT' ELSE 'UNVERIFIABLE' END AS status,
    round(value / 500, 4) AS confidence FROM ledger),
  cur AS (SELECT * FROM (SELECT o.*, metric_key, requirement, coalesce(source_role, 'PRIMARY') AS source_role,
      row_number() OVER (PARTITION BY ticker, metric_key ORDER BY as_of DESC, calculated_at DESC, observation_id DESC) AS rn
    FROM obs o JOIN def USING (definition_id) LEFT JOIN pol ON pol.policy_id = o.policy_id
    WHERE (active_until IS NULL OR CAST(active_until AS DATE) >= as_of) AND (pol.policy_id IS NULL OR source_role = 'PRIMARY' OR certified = 1)
      AND (p_from IS NULL OR CAST(p_from AS DATE) <= as_of) AND (p_until IS NULL OR CAST(p_until AS DATE) >= as_of)) WHERE rn = 1)"""


def current(spark, d, until=None):
    v = F.col("value")
    base = F.lit(0)
    for i, k in enumerate(KINDS):
        base = F.when(F.col("kind") == k, i * 2).otherwise(base)
    status = F.when(v < 20, "FRESH").when(v < 40, "STALE").when(v < 60, "MISSING").when(v < 80, "CONFLICT").otherwise("UNVERIFIABLE")
    rows = led(spark, d)
    if until:
        rows = rows.where(F.col("day") <= F.lit(until).cast("date"))
    obs = rows.select("ticker", (base + F.col("seq") % 2).alias("definition_id"), F.when(F.col("seq") % 5 < 4, F.col("seq") % 5).alias("policy_id"),
                      F.col("day").alias("as_of"), F.col("ts").alias("calculated_at"), F.col("seq").alias("observation_id"), "value", status.alias("status"),
                      F.round(v / 500, 4).alias("confidence"))
    defs = spark.createDataFrame(DEFS, "definition_id long, metric_key string, formula_version string, requirement string, active_until string")
    pol = spark.createDataFrame(POLICIES, "policy_id long, source_role string, certified int, active_from string, active_until string")
    day = lambda df, *cs: df.withColumns({c: F.col(c).cast("date") for c in cs})
    return ledger.current_metric(obs, day(defs, "active_until"), day(pol, "active_from", "active_until"))


@query("view_current_metric", f"{METRIC} SELECT ticker, metric_key, source_role, {txt('as_of')}, observation_id, value, status FROM cur")
def view_current_metric(spark, d):
    return current(spark, d).select("ticker", "metric_key", "source_role", "as_of", "observation_id", "value", "status")


@query("stock_health", f"""{METRIC} SELECT ticker, count(*) FILTER (requirement = 'REQUIRED' AND status <> 'FRESH') AS required_unusable, count(*) FILTER (requirement = 'OPTIONAL' AND status <> 'FRESH') AS optional_unusable,
  count(*) FILTER (status = 'CONFLICT') AS conflicts, min(confidence) AS minimum_confidence, CASE WHEN count(*) FILTER (requirement = 'REQUIRED' AND status <> 'FRESH') = 0 THEN 1 ELSE 0 END AS decision_ready FROM cur GROUP BY ticker""")
def stock_health(spark, d):
    return ledger.stock_health(current(spark, d))


@query("coverage_counts", f"{METRIC} SELECT metric_key, count(*) AS observed_stocks, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}_stocks" for s in ledger.STATES) + " FROM cur GROUP BY metric_key")
def coverage_counts(spark, d):
    return ledger.coverage(current(spark, d))


@query("coverage_compare", f"""{METRIC.replace("FROM events)", "FROM events WHERE ts < TIMESTAMP '2024-01-16')", 1)}, oldm AS (SELECT metric_key, ticker FROM cur WHERE status = 'FRESH')
  SELECT metric_key, old, new, new - old AS delta, gained, lost FROM ({METRIC}, newm AS (SELECT metric_key, ticker FROM cur WHERE status = 'FRESH')
   SELECT coalesce(o.metric_key, n.metric_key) AS metric_key, count(o.ticker) AS old, count(n.ticker) AS new, count(*) FILTER (o.ticker IS NULL) AS gained, count(*) FILTER (n.ticker IS NULL) AS lost
   FROM oldm o FULL JOIN newm n ON n.metric_key = o.metric_key AND n.ticker = o.ticker GROUP BY 1)""")
def coverage_compare(spark, d):
    fresh = lambda df: df.where("status = 'FRESH'").select("metric_key", "ticker")
    return ledger.coverage_change(fresh(current(spark, d, "2024-01-15")), fresh(current(spark, d)))


RUNS = "runs AS (SELECT day, count(*) FILTER (kind = 'purchase') AS good, count(*) AS n FROM ledger GROUP BY day), prun AS (SELECT day FROM runs WHERE good * 5 < n ORDER BY day DESC LIMIT 1)"


def promoted_run(spark, d):
    """The newest run that succeeded and was promoted: here a day on which fewer than a fifth of the rows were purchases."""
    runs = led(spark, d).groupBy("day").agg(F.count_if(F.col("kind") == "purchase").alias("good"), F.count("*").alias("n"))
    return runs.where("good * 5 < n").agg(F.max("day").alias("day"))


@query("view_current_price", f"{L}, {RUNS} SELECT ticker, kind, arg_max(value, (ts, seq)) AS value, max(seq) AS seq FROM ledger JOIN prun ON prun.day = ledger.day GROUP BY ticker, kind")
def view_current_price(spark, d):
    rows = led(spark, d).join(promoted_run(spark, d), "day", "left_semi").select("ticker", "kind", "ts", "seq", "value")
    return ledger.latest(rows, ["ticker", "kind"], ["ts", "seq"]).drop("ts")


@query("view_current_security", f"{L}, {RUNS} SELECT ticker, seq, outcome FROM ledger JOIN prun ON prun.day = ledger.day")
def view_current_security(spark, d):
    return led(spark, d).join(promoted_run(spark, d), "day", "left_semi").select("ticker", "seq", "outcome")


@query("effective_dated", f"{L} SELECT ticker, {txt('max(day)', 'valid_from')}, arg_max(value, (day, seq)) AS value FROM ledger WHERE day <= DATE '2024-01-10' GROUP BY ticker")
def effective_dated(spark, d):
    rows = led(spark, d).select("ticker", F.col("day").alias("valid_from"), "seq", "value")
    return ledger.effective(rows, ["ticker"], "2024-01-10", order=["seq"]).drop("seq")


@query("latest_outcome", f"{L} SELECT {txt('ledger.day', 'run')}, ticker, kind, arg_max(outcome, (value, seq)) AS outcome, count(*) AS attempts FROM ledger GROUP BY ledger.day, ticker, kind")
def latest_outcome(spark, d):
    """Last attempt per key in each run (attempt number: value, then id)."""
    return led(spark, d).groupBy(F.col("day").alias("run"), "ticker", "kind").agg(
        F.max_by("outcome", F.struct("value", "seq")).alias("outcome"), F.count("*").alias("attempts"))


FAILS = """okl AS (SELECT ticker, max((ts, seq)) AS k FROM ledger WHERE outcome = 'ok' GROUP BY ticker),
  fl AS (SELECT l.ticker, count(*) FILTER (outcome IN ('failed', 'no_data') AND (okl.k IS NULL OR (l.ts, l.seq) > okl.k)) AS failures FROM ledger l LEFT JOIN okl ON okl.ticker = l.ticker
    WHERE outcome IN ('ok', 'failed', 'no_data') GROUP BY l.ticker)"""


@query("failures_since_ok", f"{L}, {FAILS} SELECT ticker, failures FROM fl")
def failures_since_ok(spark, d):
    return ledger.failures_since_ok(led(spark, d))


@query("market_day", f"""{L}, g AS (SELECT day, ticker % 7 AS shard, count(*) AS n, count(*) FILTER (outcome = 'failed') AS f, count(*) FILTER (outcome = 'no_new_bar') AS i FROM ledger GROUP BY ALL)
  SELECT {txt('day')}, CASE WHEN f = n THEN 'outage' WHEN f / n > 0.5 THEN 'degraded' WHEN i = n THEN 'holiday' ELSE 'open' END AS class, shard FROM g""")
def market_day(spark, d):
    """Day classes per source shard: a shard-day stands for one run."""
    rows = led(spark, d).withColumn("day", F.struct("day", (F.col("ticker") % 7).alias("shard")))
    return ledger.market_day(rows).select(F.col("day.day").alias("day"), "class", F.col("day.shard").alias("shard"))


@query("bar_outcome", f"""{L}, g AS (SELECT ticker, max(day) FILTER (day < DATE '2024-01-30') AS before, max(day) AS after, bool_or(kind = 'error' AND day = DATE '2024-01-30') AS f FROM ledger WHERE kind IN ('view', 'error') GROUP BY ticker)
  SELECT ticker, CASE WHEN f THEN 'failed' WHEN before IS NULL OR after > before THEN 'ok' ELSE 'no_new_bar' END AS outcome FROM g""")
def bar_outcome(spark, d):
    rows = led(spark, d).where("kind IN ('view', 'error')")
    failed = rows.where("kind = 'error' AND day = DATE'2024-01-30'").select("ticker")
    return ledger.bar_outcomes(rows, "2024-01-30", failed)


@query("missing_runs", f"""{L}, due AS (SELECT kind, CAST(g AS DATE) AS day FROM (SELECT DISTINCT kind FROM ledger), generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(g))
  SELECT kind, {txt('due.day', 'day')} FROM due WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.kind = due.kind AND l.day = due.day AND hour(l.ts) < 1)""")
def missing_runs(spark, d):
    rows = led(spark, d)
    return ledger.missing_runs(rows.where(F.hour("ts") < 1), rows.select("kind").distinct(), "2024-01-01", "2024-01-30")


STATUS = {"view": "intact", "click": "under_review", "error": "broken", "purchase": "retired", "signup": "draft"}


@query("status_transitions", f"""{L}, s AS (SELECT ticker, seq, ts, CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())} END AS status FROM ledger),
  p AS (SELECT *, lag(status) OVER (PARTITION BY ticker ORDER BY ts, seq) AS previous FROM s)
  SELECT ticker, seq, previous, status FROM p WHERE previous IS NOT NULL AND previous || '>' || status NOT IN ({', '.join(f"'{a}>{b}'" for a, b in ledger.ALLOWED)})""")
def status_transitions(spark, d):
    status = F.lit(None).cast("string")
    for k, v in STATUS.items():
        status = F.when(F.col("kind") == k, v).otherwise(status)
    log = led(spark, d).select("ticker", "day", "ts", "seq", status.alias("status"))
    return ledger.illegal_transitions(log, "ticker", "day", ["ts", "seq"]).select("ticker", "seq", "previous", "status")


@query("refresh_summary", f"""{L}, x AS (SELECT day, ticker, arg_max(outcome, (ts, seq)) AS o FROM ledger GROUP BY ALL)
  SELECT {txt('day', 'run')}, count(*) FILTER (o = 'ok') AS ok, count(*) FILTER (o = 'no_data') AS terminal, count(*) FILTER (o IN ('failed', 'rate_limited')) AS failed,
    count(*) FILTER (o NOT IN ('ok', 'no_data')) AS remaining, count(*) AS selected FROM x GROUP BY day""")
def refresh_summary(spark, d):
    last = ledger.latest(led(spark, d).select("day", "ticker", "ts", "seq", "outcome"), ["day", "ticker"], ["ts", "seq"])
    o = F.col("outcome")
    return last.groupBy(F.col("day").alias("run")).agg(
        F.count_if(o == "ok").alias("ok"), F.count_if(o == "no_data").alias("terminal"), F.count_if(o.isin("failed", "rate_limited")).alias("failed"),
        F.count_if(~o.isin("ok", "no_data")).alias("remaining"), F.count("*").alias("selected"))


def journal(spark, d):
    o = R.table(spark, d, "orders")
    entries = o.select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").cast("date").alias("ts"),
                       F.when(F.col("o_orderstatus") == "F", "followed").when(F.col("o_orderstatus") == "O", "deviated").alias("process"),
                       F.when(F.col("o_orderpriority") == "1-URGENT", "overridden").when(F.col("o_orderpriority") == "5-LOW", "no_action").otherwise("followed").alias("owner_action"),
                       F.date_add(F.col("o_orderdate").cast("date"), 180).alias("review_horizon"))
    q = F.col("l_quantity")
    grades = R.table(spark, d, "lineitem").where("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("entry_id"), F.col("l_shipdate").cast("date").alias("graded_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("grade_id"),
        F.when(q < 13, "good").when(q < 25, "neutral").when(q < 38, "bad").otherwise("too_early").alias("grade"))
    return entries, grades


JOURNAL = """WITH en AS (SELECT o_orderkey AS entry_id, CAST(o_orderdate AS DATE) AS ts, CASE o_orderstatus WHEN 'F' THEN 'followed' WHEN 'O' THEN 'deviated' END AS process,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'overridden' WHEN '5-LOW' THEN 'no_action' ELSE 'followed' END AS owner_action, CAST(o_orderdate AS DATE) + 180 AS review_horizon FROM orders),
  gr AS (SELECT l_orderkey AS entry_id, arg_max(CASE WHEN l_quantity < 13 THEN 'good' WHEN l_quantity < 25 THEN 'neutral' WHEN l_quantity < 38 THEN 'bad' ELSE 'too_early' END,
    (CAST(l_shipdate AS DATE), l_linenumber, l_partkey, l_suppkey)) AS grade FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)"""


@query("due_reviews", f"""{JOURNAL} SELECT en.entry_id, {txt('review_horizon')}, grade FROM en LEFT JOIN gr ON gr.entry_id = en.entry_id WHERE review_horizon <= DATE '2001-06-30'
  AND (grade IS NULL OR (grade = 'too_early' AND review_horizon + 365 <= DATE '2001-06-30'))""")
def due_reviews(spark, d):
    e, g = journal(spark, d)
    return ledger.due_reviews(e, g, "2001-06-30").select("entry_id", "review_horizon", "grade")


@query("review_matrix", f"""{JOURNAL} SELECT process, grade, count(*) AS n, count(*) FILTER (process = 'deviated' AND grade = 'good') AS dangerous_wins
  FROM en JOIN gr ON gr.entry_id = en.entry_id WHERE process IS NOT NULL GROUP BY CUBE (process, grade)""")
def review_matrix(spark, d):
    return ledger.review_matrix(*journal(spark, d))


def pause_events(spark, d):
    planned = F.when(F.col("seq") % 2 == 0, F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("value") / 20).cast("int")))
    return led(spark, d).where("kind IN ('signup', 'purchase')").select(
        "ticker", "day", "ts", "seq", F.when(F.col("kind") == "signup", "on").otherwise("off").alias("kind"), planned.alias("planned"))


# every event in turn: what is open, until when it is planned, and the window that the event closes
PAUSES = f"""{L.replace('WITH', 'WITH RECURSIVE', 1)}, ev AS (SELECT ticker, ts, CASE kind WHEN 'signup' THEN 'on' ELSE 'off' END AS kind, CASE WHEN seq % 2 = 0 THEN ts + to_hours(CAST(trunc(value / 20) AS INTEGER)) END AS planned,
    row_number() OVER (PARTITION BY ticker ORDER BY ts, seq) AS rn FROM ledger WHERE kind IN ('signup', 'purchase')),
  f AS (SELECT ticker, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS held, CAST(NULL AS TIMESTAMP) AS due, CAST(NULL AS TIMESTAMP) AS s, CAST(NULL AS TIMESTAMP) AS e FROM (SELECT DISTINCT ticker FROM ev)
    UNION ALL SELECT v.ticker, v.rn, CASE WHEN v.kind = 'off' THEN NULL WHEN held IS NOT NULL AND (due IS NULL OR due > v.ts) THEN held ELSE v.ts END,
      CASE WHEN v.kind = 'off' THEN NULL WHEN held IS NOT NULL AND (due IS NULL OR due > v.ts) THEN due ELSE v.planned END,
      CASE WHEN v.kind = 'on' AND held IS NOT NULL AND due <= v.ts THEN held WHEN v.kind = 'off' AND least(v.ts, coalesce(due, v.ts)) > held THEN held END,
      CASE WHEN v.kind = 'on' AND held IS NOT NULL AND due <= v.ts THEN due WHEN v.kind = 'off' AND least(v.ts, coalesce(due, v.ts)) > held THEN least(v.ts, coalesce(due, v.ts)) END
    FROM f JOIN ev v ON v.ticker = f.ticker AND v.rn = f.rn + 1),
  pw AS (SELECT ticker, s, e FROM f WHERE s IS NOT NULL UNION ALL SELECT ticker, held, due FROM f WHERE held IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY rn DESC) = 1 AND rn = (SELECT max(rn) FROM ev x WHERE x.ticker = f.ticker))"""


@query("pause_windows", f"{PAUSES} SELECT ticker, {txt('s', 'start')}, {txt('e', '\"end\"')} FROM pw")
def pause_windows(spark, d):
    return ledger.pause_windows(pause_events(spark, d))


@query("pause_overlap", f"""{PAUSES}, w AS (SELECT ticker, s, coalesce(e, TIMESTAMP '2024-01-20') AS e FROM pw)
  SELECT ticker, CAST(sum(CASE WHEN least(e, TIMESTAMP '2024-01-20') > greatest(s, TIMESTAMP '2024-01-10') THEN epoch(date_trunc('second', least(e, TIMESTAMP '2024-01-20'))) - epoch(date_trunc('second', greatest(s, TIMESTAMP '2024-01-10'))) ELSE 0 END) AS BIGINT) AS paused
  FROM w GROUP BY ticker""")
def pause_overlap(spark, d):
    """Seconds of pause inside [10 January, 20 January)."""
    w = ledger.pause_windows(pause_events(spark, d))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return ledger.paused_seconds(w, at("2024-01-10"), at("2024-01-20"))


STAGES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'raw' WHEN '2-HIGH' THEN 'gate_approved_waiting' WHEN '3-MEDIUM' THEN 'buy_ready_waiting' ELSE 'rejected' END"


@query("unexecuted_expiry", f"""WITH i AS (SELECT o_orderkey AS item_id, o_custkey AS ticker, {STAGES} AS stage, DATE '2001-08-01' - CAST(o_orderdate AS DATE) AS age FROM orders),
  o AS (SELECT *, CASE WHEN stage = 'raw' AND age >= 90 THEN 'expired' WHEN stage IN ('gate_approved_waiting', 'buy_ready_waiting') AND age >= 365 THEN 'lapsed' WHEN stage = 'buy_ready_waiting' AND age >= 30 THEN 'ask' END AS outcome FROM i)
  SELECT item_id, ticker, stage, outcome FROM o WHERE outcome IS NOT NULL AND NOT (outcome = 'ask' AND ticker IN (SELECT s_suppkey FROM supplier))""")
def unexecuted_expiry(spark, d):
    p = F.col("o_orderpriority")
    items = R.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("since"),
        F.when(p == "1-URGENT", "raw").when(p == "2-HIGH", "gate_approved_waiting").when(p == "3-MEDIUM", "buy_ready_waiting").otherwise("rejected").alias("stage"))
    held = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"))
    return ledger.expiries(items, "2001-08-01", held)


@query("worklist", f"""{L}, {FAILS}, la AS (SELECT ticker, max(ts) AS last_attempt, count(*) FILTER (outcome = 'ok') AS oks, max(day) FILTER (outcome = 'ok') AS last_ok FROM ledger GROUP BY ticker),
  j AS (SELECT c_custkey AS ticker, (c_custkey * 7919) % 100003 AS rank, la.*, coalesce(failures, 0) AS failures FROM customer LEFT JOIN la ON la.ticker = c_custkey LEFT JOIN fl ON fl.ticker = c_custkey),
  k AS (SELECT ticker, rank, last_attempt, last_attempt IS NOT NULL AND coalesce(oks, 0) >= 4 AS refresh, last_ok FROM j WHERE NOT (failures >= 3 AND DATE '2024-02-15' - CAST(last_attempt AS DATE) <= 90))
  SELECT ticker, CASE WHEN refresh THEN 'refresh' ELSE 'never' END AS why FROM k WHERE NOT refresh OR DATE '2024-02-15' - last_ok >= 2
  ORDER BY refresh, CASE WHEN NOT refresh THEN rank END, CASE WHEN refresh THEN last_attempt END, ticker LIMIT 1400""")
def worklist(spark, d):
    ranked = R.table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), ((F.col("c_custkey") * 7919) % 100003).alias("rank"))
    return ledger.worklist(ranked, led(spark, d), "2024-02-15", 1400)


@query("staleness_plan", f"""{L}, nw AS (SELECT ticker AS symbol, max(day) AS newest FROM ledger WHERE kind = 'view' GROUP BY ticker), ms AS (SELECT ticker AS symbol, max(day) AS miss FROM ledger WHERE kind = 'error' GROUP BY ticker),
  u AS (SELECT DISTINCT c_custkey AS symbol FROM customer), h AS (SELECT DISTINCT ticker AS symbol FROM ledger WHERE kind = 'purchase' AND day = DATE '2024-01-30'),
  j AS (SELECT u.symbol, h.symbol IS NOT NULL AS head, CASE WHEN newest IS NULL AND DATE '2024-01-30' - miss <= 30 THEN -1 ELSE coalesce(DATE '2024-01-30' - newest, 1000000) END AS age
    FROM u LEFT JOIN nw ON nw.symbol = u.symbol LEFT JOIN ms ON ms.symbol = u.symbol LEFT JOIN h ON h.symbol = u.symbol)
  SELECT symbol, head, age FROM j WHERE head OR age > 0 ORDER BY head DESC, age DESC, symbol LIMIT 1450""")
def staleness_plan(spark, d):
    rows = led(spark, d).withColumnRenamed("ticker", "symbol")
    newest = rows.where("kind = 'view'").groupBy("symbol").agg(F.max("day").alias("newest"))
    uni = R.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"))
    pri = rows.where("kind = 'purchase' AND day = DATE'2024-01-30'").select("symbol")
    return ledger.refresh_plan(uni, newest, rows.where("kind = 'error'"), pri, AS_OF, 1450, max_age=0)


@query("open_loops", f"""{L}, a AS (SELECT seq, ticker, 0 AS grp, 'ALERT IGNORED' AS label, DATE '2024-01-30' - day AS age FROM ledger WHERE kind = 'error' AND value > 60
   UNION ALL SELECT seq, ticker, 1, CASE kind WHEN 'error' THEN 'alert decision open' WHEN 'signup' THEN 'prompted question waiting' ELSE 'reconciliation waiting' END, DATE '2024-01-30' - day FROM ledger WHERE kind IN ('error', 'signup', 'click') AND value > 40)
  SELECT seq, ticker, grp, label, age FROM a""")
def open_loops(spark, d):
    """Ignored alerts first, then every open question, oldest first."""
    e = led(spark, d)
    age = F.datediff(F.lit(AS_OF).cast("date"), "day").alias("age")
    head = e.where("kind = 'error' AND value > 60").select("seq", "ticker", F.lit(0).alias("grp"), F.lit("ALERT IGNORED").alias("label"), age)
    label = F.when(F.col("kind") == "error", "alert decision open").when(F.col("kind") == "signup", "prompted question waiting").otherwise("reconciliation waiting")
    rest = e.where("kind IN ('error', 'signup', 'click') AND value > 40").select("seq", "ticker", F.lit(1).alias("grp"), label.alias("label"), age)
    return head.unionByName(rest).orderBy("grp", F.desc("age"), "seq")


@query("echo_window", """SELECT o_orderkey AS version, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1998-03-31' - 28 THEN 'loosened' ELSE 'anniversary' END AS echo FROM orders
  WHERE CAST(o_orderdate AS DATE) <= DATE '1998-03-31' AND ((o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) >= DATE '1998-03-31' - 28) OR (o_orderstatus <> 'P' AND DATE '1998-03-31' - CAST(o_orderdate AS DATE) >= 365))""")
def echo_window(spark, d):
    """Versions loosened in the last 28 days, and versions a year or more in force."""
    at, day = F.lit("1998-03-31").cast("date"), F.col("o_orderdate").cast("date")
    loose = (F.col("o_orderstatus") == "P") & (day >= F.date_sub(at, 28))
    old = (F.col("o_orderstatus") != "P") & (F.datediff(at, day) >= 365)
    return R.table(spark, d, "orders").where((day <= at) & (loose | old)).select(
        F.col("o_orderkey").alias("version"), F.when(day >= F.date_sub(at, 28), "loosened").otherwise("anniversary").alias("echo"))


@query("content_hash", f"""{L} SELECT seq, sha256('{{"kind":"' || kind || '","seq":' || seq || ',"ticker":' || ticker || '}}') AS hash FROM ledger""")
def content_hash(spark, d):
    return led(spark, d).select("seq", ledger.content_hash("ticker", "kind", "seq").alias("hash"))


@query("expected_within", f"""{L}, x AS (SELECT ticker, arg_max(CAST(day + CAST(floor(value) AS INTEGER) AS DATE), (ts, seq)) AS expected FROM ledger GROUP BY ticker)
  SELECT ticker, {txt('expected')} FROM x WHERE expected - DATE '2024-01-30' BETWEEN 0 AND 21""")
def expected_within(spark, d):
    """Expected dates in the next 21 days, from the newest calendar row per name."""
    e = ledger.latest(led(spark, d).select("ticker", "ts", "seq", F.date_add("day", F.floor("value").cast("int")).alias("expected")), ["ticker"], ["ts", "seq"])
    return e.where(F.datediff("expected", F.lit(AS_OF).cast("date")).between(0, 21)).select("ticker", "expected")


@query("parity", f"""{L}, p AS (SELECT seq, CASE WHEN seq % 11 <> 0 THEN value END AS a, CASE WHEN seq % 13 <> 0 AND seq % 11 <> 0 THEN value * (1 + (seq % 5) * 0.001) END AS b, CASE WHEN seq % 7 = 0 THEN 'STALE' ELSE 'FRESH' END AS s, CASE WHEN seq % 21 = 0 THEN 'FRESH' WHEN seq % 7 = 0 THEN 'STALE' ELSE 'FRESH' END AS t FROM ledger),
  r AS (SELECT *, CASE WHEN (a IS NULL) <> (b IS NULL) THEN 'missingness mismatch' WHEN s <> t THEN 'state mismatch' WHEN a IS NULL THEN 'both missing with matching state'
    WHEN round(abs(a - b), 12) <= greatest(0.01, 0.0025 * greatest(abs(a), abs(b))) THEN 'within tolerance' ELSE 'numeric mismatch' END AS reason FROM p)
  SELECT seq, reason, CASE WHEN reason IN ('within tolerance', 'both missing with matching state') THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""")
def parity(spark, d):
    k, v = F.col("seq"), F.col("value")
    rows = led(spark, d).select(
        "seq", F.when(k % 11 != 0, v).alias("legacy_value"), F.when((k % 13 != 0) & (k % 11 != 0), v * (1 + (k % 5) * 0.001)).alias("ledger_value"),
        F.when(k % 7 == 0, "STALE").otherwise("FRESH").alias("legacy_status"), F.when(k % 21 == 0, "FRESH").when(k % 7 == 0, "STALE").otherwise("FRESH").alias("ledger_status"))
    return ledger.parity(rows, 0.01, 0.0025).select("seq", "reason", "verdict")


@query("evaluation_decision", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN sha256(CASE WHEN doc_id % 3 = 0 THEN text || '.' ELSE text END) END AS prev, sha256(text) AS cur, doc_id % 7 = 0 AS stale FROM documents)
  SELECT doc_id, CASE WHEN prev IS NULL THEN 'CREATED' WHEN stale OR prev <> cur THEN 'REFRESHED' ELSE 'REUSED' END AS decision,
   CASE WHEN prev IS NULL THEN 'NEW_TOP_MEMBER' WHEN stale THEN 'RESEARCH_STALE' WHEN prev <> cur THEN 'INPUTS_CHANGED' ELSE 'INPUTS_UNCHANGED' END AS reason FROM x""")
def evaluation_decision(spark, d):
    k = F.col("doc_id")
    prev = F.when(k % 5 != 0, F.sha2(F.when(k % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256))
    x = R.table(spark, d, "documents").select("doc_id", prev.alias("prev"), F.sha2("text", 256).alias("cur"), (k % 7 == 0).alias("stale"))
    new, changed = F.col("prev").isNull(), F.col("prev") != F.col("cur")
    return x.select("doc_id", F.when(new, "CREATED").when(F.col("stale") | changed, "REFRESHED").otherwise("REUSED").alias("decision"),
                    F.when(new, "NEW_TOP_MEMBER").when(F.col("stale"), "RESEARCH_STALE").when(changed, "INPUTS_CHANGED").otherwise("INPUTS_UNCHANGED").alias("reason"))


@query("latest_statement_period", """SELECT l_suppkey AS entity, CAST(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS period_end,
   sha256(l_orderkey || ':' || l_linenumber) AS fingerprint FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, date_trunc('quarter', l_shipdate) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1""")
def latest_statement_period(spark, d):
    """Newest fingerprint per entity and period."""
    li = R.table(spark, d, "lineitem")
    best = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("b")
    return (li.groupBy(F.col("l_suppkey").alias("entity"), R._quarter_end(F.col("l_shipdate").cast("date")).alias("period_end")).agg(best)
            .select("entity", "period_end", F.sha2(F.concat_ws(":", "b.l_orderkey", "b.l_linenumber"), 256).alias("fingerprint")))
