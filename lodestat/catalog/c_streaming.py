"""Streaming jobs over the events table, compared with the same result in SQL."""

from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog.registry import query, rnd, txt
from lodestat.streaming import jobs, keyed

L = f"WITH {R.SQL_LEDGER}"
CUT, BEAT = "2024-01-16", "2024-03-30"


def events(spark, d):
    return R.ledger(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.col("day").cast("string"))


def slices(spark, d):
    return jobs.arrivals(events(spark, d), CUT, BEAT)


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("st_append_ledger", f"{L} SELECT DISTINCT ticker, {txt('day')}, kind FROM ledger")
def st_append_ledger(spark, d):
    out = jobs.run(slices(spark, d), lambda s: jobs.deduplicated(s, ["ticker", "day", "kind"], "1 day"))
    return out.where("ticker >= 0").select("ticker", "day", "kind")


def arriving(rows):
    """Rows that arrive when they happen, in two parts and a heartbeat."""
    return keyed.by_arrival(rows.withColumn("arrived", F.col("ts")), [CUT], BEAT)


@query("st_current_view", f"{L} SELECT ticker, {txt('ledger.day', 'day')}, arg_max(value, (ts, seq)) AS value FROM ledger GROUP BY ticker, ledger.day")
def st_current_view(spark, d):
    """Every micro-batch puts out the keys that changed; a day's state goes two days after it."""
    rows = events(spark, d).select("ticker", "day", "ts", "seq", "value")
    out = keyed.run(arriving(rows), ["ticker", "day"], lambda: keyed.Latest(2, at_end=False), "ticker long, day string, at long, seq long, value double, late boolean")
    return out.where("ticker >= 0 AND NOT late").groupBy("ticker", "day").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))


FP = "CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR)"


@query("st_fingerprint_change", f"{L}, f AS (SELECT ticker, seq, {FP} AS current, lag({FP}) OVER (PARTITION BY ticker ORDER BY ts, seq) AS previous FROM ledger) SELECT ticker, seq, previous, current FROM f WHERE previous IS NOT NULL AND previous <> current")
def st_fingerprint_change(spark, d):
    rows = events(spark, d).select("ticker", "ts", "seq", F.floor(F.col("value") / 25).cast("string").alias("fingerprint"))
    return changed(rows)


@query("st_officer_diff", f"{L}, f AS (SELECT ticker, seq, kind AS current, lag(kind) OVER (PARTITION BY ticker ORDER BY ts, seq) AS previous FROM ledger) SELECT ticker, seq, previous, current FROM f WHERE previous IS NOT NULL AND previous <> current")
def st_officer_diff(spark, d):
    return changed(events(spark, d).select("ticker", "ts", "seq", F.col("kind").alias("fingerprint")))


def changed(rows):
    out = keyed.run(arriving(rows), ["ticker"], lambda: keyed.Changes(90), "ticker long, seq long, previous string, current string")
    return out.where("ticker >= 0")


@query("st_trigger_streak", f"""{L}, o AS (SELECT ticker, day, arg_max(value > 30, seq) AS hit FROM ledger GROUP BY ticker, day), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY day) AS isle FROM o),
  s AS (SELECT ticker, day, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, isle ORDER BY day) AS BIGINT) AS streak FROM i)
  SELECT ticker, {txt('day')}, streak, CASE WHEN max(streak) OVER (PARTITION BY ticker ORDER BY s.day) >= 4 THEN 'broken' ELSE 'intact' END AS status FROM s""")
def st_trigger_streak(spark, d):
    rows = events(spark, d).select("ticker", "ts", "seq", "day", (F.col("value") > 30).alias("hit"))
    out = keyed.run(arriving(rows), ["ticker"], lambda: keyed.Streaks(90, 4), "ticker long, day string, streak int, status string")
    return out.where("ticker >= 0")


def silent(asks, answers, hours):
    return f"{L} SELECT ticker, seq FROM ledger a WHERE kind = '{asks}' AND NOT EXISTS (SELECT 1 FROM ledger b WHERE b.kind = '{answers}' AND b.ticker = a.ticker AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {hours} HOUR)"


@query("st_deadline", silent("signup", "purchase", 48))
def st_deadline(spark, d):
    """Questions unanswered 48 hours on; the consequence fires once."""
    out = jobs.run(slices(spark, d), lambda s: jobs.unanswered(s, "signup", "purchase", "48 HOURS", "1 hour"))
    return out.where("ticker >= 0 AND answered IS NULL").select("ticker", "seq")


@query("st_lag_retry", silent("error", "view", 168))
def st_lag_retry(spark, d):
    """Events with no refreshed statement within seven days."""
    out = jobs.run(slices(spark, d), lambda s: jobs.unanswered(s, "error", "view", "7 DAYS", "1 hour"))
    return out.where("ticker >= 0 AND answered IS NULL").select("ticker", "seq")


@query("st_outcome_window", f"""{L}, g AS (SELECT day, count(*) AS n, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'no_new_bar') AS idle FROM ledger GROUP BY day)
  SELECT {txt('day')}, n, failed, CASE WHEN failed = n THEN 'outage' WHEN failed / n > 0.5 THEN 'degraded' WHEN idle = n THEN 'holiday' ELSE 'open' END AS class FROM g""")
def st_outcome_window(spark, d):
    aggs = [F.max("ticker").alias("last"), F.count("*").alias("n"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "no_new_bar").alias("idle")]
    out = jobs.run(slices(spark, d), lambda s: jobs.windowed(s, [], "1 day", "1 hour", aggs))
    cls = F.when(F.col("failed") == F.col("n"), "outage").when(F.col("failed") / F.col("n") > 0.5, "degraded").when(F.col("idle") == F.col("n"), "holiday").otherwise("open")
    return out.where("last >= 0").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "failed", cls.alias("class"))


@query("st_sliding_events", f"{L} SELECT ticker, CAST(w AS VARCHAR) AS start, count(*) AS n FROM (SELECT ticker, unnest([day - 6, day - 5, day - 4, day - 3, day - 2, day - 1, day]) AS w FROM ledger) GROUP BY ticker, w")
def st_sliding_events(spark, d):
    out = jobs.run(slices(spark, d), lambda s: jobs.windowed(s, ["ticker"], "7 days", "1 hour", [F.count("*").alias("n")], slide="1 day"))
    return out.where("ticker >= 0").select("ticker", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("st_session_pause", f"""{L}, o AS (SELECT ticker, kind, ts, lag(ts) OVER (PARTITION BY ticker, kind ORDER BY ts) AS pv FROM ledger), s AS (SELECT *, sum(CASE WHEN pv IS NULL OR ts >= pv + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, kind ORDER BY ts) AS sid FROM o)
  SELECT ticker, kind, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY ticker, kind, sid""")
def st_session_pause(spark, d):
    out = jobs.run(slices(spark, d), lambda s: jobs.sessions(s, ["ticker", "kind"], "6 hours", "1 hour"))
    return out.where("ticker >= 0").select("ticker", "kind", stamp("start").alias("start"), "n")


@query("st_storm", f"{L} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, 'storm:' || strftime(date_trunc('hour', ts), '%Y-%m-%d') AS storm_key, count(*) FILTER (kind = 'error') AS fires FROM ledger GROUP BY date_trunc('hour', ts) HAVING count(*) FILTER (kind = 'error') > 1")
def st_storm(spark, d):
    """More than one fire in a run (an hour) shares a storm key."""
    aggs = [F.count_if(F.col("kind") == "error").alias("fires")]
    out = jobs.run(slices(spark, d), lambda s: jobs.windowed(s, [], "1 hour", "1 hour", aggs))
    return out.where("fires > 1").select(stamp("start").alias("start"), F.concat(F.lit("storm:"), F.date_format("start", "yyyy-MM-dd")).alias("storm_key"), "fires")


CLOSED_AFTER, LATE_CUTS = 300, ("1994-07-01", "1996-07-01", "1998-07-01")
# one filing in twenty reaches us 500 days after it was made
ARRIVED = "CAST(filed AS TIMESTAMP) + CASE WHEN seq % 20 = 0 THEN INTERVAL 500 DAY ELSE INTERVAL 0 DAY END"
LATE = f"""{R.SQL_FACTS}, ar AS (SELECT entity, tag, end_day, filed, seq, value, {ARRIVED} AS arrived FROM facts),
  pt AS (SELECT *, {' + '.join(f"CAST(arrived >= TIMESTAMP '{c}' AS INTEGER)" for c in LATE_CUTS)} AS part FROM ar),
  wm AS (SELECT part, max(max(arrived)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM pt GROUP BY part),
  lt AS (SELECT pt.*, coalesce(CAST(end_day AS TIMESTAMP) + INTERVAL {CLOSED_AFTER + 1} DAY <= clock, false) AS late FROM pt JOIN wm USING (part))"""


def restatements(spark, d, progress=None):
    """(entity, tag, end_day, at, seq, value, late): the value of every period when it closed, and the filings that came too late for it."""
    f = R.facts(spark, d).select("entity", "tag", F.col("end_day").cast("string").alias("end_day"), F.col("filed").cast("timestamp").alias("ts"), "seq", "value")
    f = f.withColumn("arrived", F.col("ts") + F.when(F.col("seq") % 20 == 0, F.expr("INTERVAL 500 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS")))
    schema = "entity long, tag string, end_day string, at long, seq long, value double, late boolean"
    return keyed.run(keyed.by_arrival(f, list(LATE_CUTS), "2005-01-01"), ["entity", "tag", "end_day"], lambda: keyed.Latest(CLOSED_AFTER, at_end=True), schema, progress=progress).where("entity >= 0")


@query("st_late_restatement", f"WITH {LATE} SELECT entity, tag, {txt('lt.end_day', 'end_day')}, arg_max(value, (filed, seq)) AS value FROM lt WHERE NOT late GROUP BY entity, tag, lt.end_day", digits=2)
def st_late_restatement(spark, d):
    """A later filing replaces the value of its period until the period closes; the closed value is put out once."""
    return restatements(spark, d).where("NOT late").select("entity", "tag", "end_day", "value")


@query("st_late_rows", f"WITH {LATE} SELECT entity, tag, {txt('end_day')}, seq, value FROM lt WHERE late", digits=2)
def st_late_rows(spark, d):
    """The side output: filings that came after their period had closed."""
    return restatements(spark, d).where("late").select("entity", "tag", "end_day", "seq", "value")
