"""Append-only evidence: latest-wins views, effective dates, runs, coverage,
worklists. "Latest" is a ``max_by`` aggregate, combined on the map side, not a
row number over the whole key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators import chunks


def latest(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The last row per key by the order columns."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("w")).select(*keys, "w.*")


def effective(rows: DataFrame, keys: list, as_of, valid_from: str = "valid_from", order: list = ()) -> DataFrame:
    """Row per key in force at a date."""
    return latest(rows.where(F.col(valid_from) <= F.lit(as_of).cast("date")), keys, [valid_from, *order])


def current_metric(obs: DataFrame, definitions: DataFrame, policies: DataFrame) -> DataFrame:
    """Newest observation per (ticker, metric): the definition still active and
    the source primary or certified, both at the observation's date."""
    policy = policies.withColumnsRenamed({"active_from": "p_from", "active_until": "p_until"})
    j = obs.join(definitions, "definition_id").join(policy, "policy_id", "left")
    at = F.col("as_of")
    ok = ((F.col("active_until").isNull() | (F.col("active_until") >= at))
          & (F.col("source_role").isNull() | (F.col("source_role") == "PRIMARY") | (F.col("certified") == 1))
          & (F.col("p_from").isNull() | (F.col("p_from") <= at)) & (F.col("p_until").isNull() | (F.col("p_until") >= at)))
    picked = j.where(ok).select("ticker", "metric_key", "requirement", F.coalesce("source_role", F.lit("PRIMARY")).alias("source_role"),
                                "as_of", "calculated_at", "observation_id", "value", "status", "confidence")
    return latest(picked, ["ticker", "metric_key"], ["as_of", "calculated_at", "observation_id"])


def stock_health(current: DataFrame) -> DataFrame:
    unusable = F.col("status") != "FRESH"
    req = F.count_if((F.col("requirement") == "REQUIRED") & unusable)
    return current.groupBy("ticker").agg(
        req.alias("required_unusable"), F.count_if((F.col("requirement") == "OPTIONAL") & unusable).alias("optional_unusable"),
        F.count_if(F.col("status") == "CONFLICT").alias("conflicts"), F.min("confidence").alias("minimum_confidence"),
        F.when(req == 0, 1).otherwise(0).alias("decision_ready"))


STATES = ("FRESH", "STALE", "MISSING", "CONFLICT", "UNVERIFIABLE")


def coverage(current: DataFrame) -> DataFrame:
    return current.groupBy("metric_key").agg(
        F.count("*").alias("observed_stocks"), *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_stocks") for s in STATES])


def coverage_change(before: DataFrame, after: DataFrame, key: str = "metric_key", entity: str = "ticker") -> DataFrame:
    """Per metric: old, new, delta, names gained and lost between two snapshots."""
    j = before.select(key, entity, F.lit(1).alias("o")).join(after.select(key, entity, F.lit(1).alias("n")), [key, entity], "full_outer")
    return j.groupBy(key).agg(
        F.count("o").alias("old"), F.count("n").alias("new"), (F.count("n") - F.count("o")).alias("delta"),
        F.count_if(F.col("o").isNull()).alias("gained"), F.count_if(F.col("n").isNull()).alias("lost"))


def market_day(outcomes: DataFrame) -> DataFrame:
    """Class of each day from its fetch outcomes."""
    failed, n = F.count_if(F.col("outcome") == "failed"), F.count("*")
    idle = F.count_if(F.col("outcome") == "no_new_bar")
    return outcomes.groupBy("day").agg(
        F.when(failed == n, "outage").when(failed / n > 0.5, "degraded").when(idle == n, "holiday").otherwise("open").alias("class"))


def failures_since_ok(log: DataFrame, failures=("failed", "no_data")) -> DataFrame:
    """Failures after the last ok per ticker; rate limits do not count."""
    ok = log.where("outcome = 'ok'").groupBy("ticker").agg(F.max(F.struct("ts", "seq")).alias("_ok"))
    bad = log.where(F.col("outcome").isin(*failures)).select("ticker", F.struct("ts", "seq").alias("_at"))
    after = bad.join(ok, "ticker", "left").where(F.col("_ok").isNull() | (F.col("_at") > F.col("_ok")))
    counts = after.groupBy("ticker").agg(F.count("*").alias("n"))
    seen = ok.select("ticker").unionByName(bad.select("ticker")).distinct()
    return seen.join(counts, "ticker", "left").select("ticker", F.coalesce("n", F.lit(0)).alias("failures"))


def missing_runs(finished: DataFrame, kinds: DataFrame, first, last) -> DataFrame:
    """Due (kind, day) pairs with no on-time run."""
    due = kinds.select("kind", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return due.join(finished.select("kind", "day").distinct(), ["kind", "day"], "left_anti")


def bar_outcomes(bars: DataFrame, refresh_day, failed: DataFrame) -> DataFrame:
    """Newest bar before against after a refresh: ok, no_new_bar or failed."""
    day = F.lit(refresh_day).cast("date")
    g = bars.groupBy("ticker").agg(F.max(F.when(F.col("day") < day, F.col("day"))).alias("before"), F.max("day").alias("after"))
    return (g.join(failed.select("ticker", F.lit(True).alias("f")).distinct(), "ticker", "full_outer").select(
        "ticker", F.when(F.col("f"), "failed").when(F.col("before").isNull() | (F.col("after") > F.col("before")), "ok")
        .otherwise("no_new_bar").alias("outcome")))


# fixed values: allowed status changes; broken only retires
ALLOWED = (("draft", "intact"), ("draft", "retired"), ("intact", "under_review"), ("intact", "retired"), ("under_review", "intact"),
           ("under_review", "broken"), ("under_review", "retired"), ("broken", "retired"))


def illegal_transitions(log: DataFrame, key: str, chunk: str, order: list) -> DataFrame:
    """Status rows that do not follow from the previous status of their key."""
    seq = chunks.lag_in_chunks(log, [key], chunk, order, "status", "previous")
    pair = F.concat_ws(">", "previous", "status")
    return seq.where(F.col("previous").isNotNull() & ~pair.isin(*[f"{a}>{b}" for a, b in ALLOWED]))


def pause_windows(events: DataFrame, key: str = "ticker", chunk: str = "day") -> DataFrame:
    """on/off events with an optional planned end, as windows (key, start, end).

    Every "off" closes whatever is open, so the events between two offs form an
    independent segment: segments are numbered by a running count of offs, and
    only one segment is ever folded at a time."""
    numbered = chunks.running_sum_in_chunks(
        events.withColumn("_off", (F.col("kind") == "off").cast("bigint")), [key], chunk, ["ts", "seq"], "_off", "segment")
    ev = F.struct("ts", "seq", "kind", "planned")
    segments = numbered.groupBy(key, "segment").agg(F.array_sort(F.collect_list(ev)).alias("evs"))
    start = F.struct(F.lit(None).cast("timestamp_ntz").alias("open"), F.lit(None).cast("timestamp_ntz").alias("planned"),
                     F.array().cast("array<struct<s:timestamp_ntz,e:timestamp_ntz>>").alias("done"))

    def window(s, e):
        return F.array(F.struct(s.alias("s"), e.alias("e")))

    def state(open_, planned, done):
        return F.struct(open_.alias("open"), planned.alias("planned"), done.alias("done"))

    def step(acc, e):
        held, due = acc["open"], acc["planned"]
        none = F.lit(None).cast("timestamp_ntz")
        lapsed = held.isNotNull() & due.isNotNull() & (due <= e["ts"])
        on = (F.when(held.isNotNull() & ~lapsed, acc)
              .when(lapsed, state(e["ts"], e["planned"], F.concat(acc["done"], window(held, due))))
              .otherwise(state(e["ts"], e["planned"], acc["done"])))
        end = F.least(e["ts"], F.coalesce(due, e["ts"]))
        off = F.when(held.isNull(), acc).otherwise(
            state(none, none, F.when(end > held, F.concat(acc["done"], window(held, end))).otherwise(acc["done"])))
        return F.when(e["kind"] == "on", on).otherwise(off)

    folded = segments.withColumn("f", F.aggregate("evs", start, step))
    closed = F.col("f.done")
    all_ = F.when(F.col("f.open").isNotNull(), F.concat(closed, window(F.col("f.open"), F.col("f.planned")))).otherwise(closed)
    return folded.select(key, F.explode(all_).alias("w")).select(key, F.col("w.s").alias("start"), F.col("w.e").alias("end"))


def paused_seconds(windows: DataFrame, lo: Column, hi: Column, key: str = "ticker") -> DataFrame:
    """Seconds of pause inside [lo, hi] per key; an open window runs to hi."""
    s, e = F.greatest("start", lo), F.least(F.coalesce("end", hi), hi)
    secs = (F.unix_seconds(e.cast("timestamp")) - F.unix_seconds(s.cast("timestamp")))
    return windows.groupBy(key).agg(F.sum(F.when(e > s, secs).otherwise(0)).alias("paused"))


RAW_EXPIRY_DAYS, APPROVAL_EXPIRY_DAYS, NONEXECUTION_DAYS = 90, 365, 30


def expiries(items: DataFrame, as_of, held: DataFrame) -> DataFrame:
    """Aged watchlist items and what becomes of them."""
    age = F.datediff(F.lit(as_of).cast("date"), "since")
    stage = F.col("stage")
    moved = items.select("item_id", "ticker", "stage", F.when((stage == "raw") & (age >= RAW_EXPIRY_DAYS), "expired").when(
        stage.isin("gate_approved_waiting", "buy_ready_waiting") & (age >= APPROVAL_EXPIRY_DAYS), "lapsed").when(
        (stage == "buy_ready_waiting") & (age >= NONEXECUTION_DAYS), "ask").alias("outcome")).where("outcome IS NOT NULL")
    owned = held.select("ticker", F.lit(True).alias("_held")).distinct()
    return (moved.join(owned, "ticker", "left").where(~((F.col("outcome") == "ask") & F.coalesce("_held", F.lit(False)))).drop("_held"))


def worklist(ranked: DataFrame, attempts: DataFrame, as_of, budget: int, dead_after: int = 3, retry_days: int = 90) -> DataFrame:
    """Next names to fetch: never tried or not yet covered in rank order, then
    stale ones oldest first; names dead for less than the retry age are left out.
    ranked: (ticker, rank); attempts: ledger rows."""
    fails = failures_since_ok(attempts)
    last = attempts.groupBy("ticker").agg(
        F.max("ts").alias("last_attempt"), F.count_if(F.col("outcome") == "ok").alias("oks"),
        F.max(F.when(F.col("outcome") == "ok", F.col("day"))).alias("last_ok"))
    at = F.lit(as_of).cast("date")
    j = ranked.join(last, "ticker", "left").join(fails, "ticker", "left")
    dead = (F.coalesce("failures", F.lit(0)) >= dead_after) & (
        F.col("last_attempt").isNull() | (F.datediff(at, F.col("last_attempt").cast("date")) <= retry_days))
    covered = F.coalesce("oks", F.lit(0)) >= 4
    stale = F.datediff(at, "last_ok") >= 2
    j = j.where(~dead).withColumn("refresh", F.col("last_attempt").isNotNull() & covered)
    j = j.where(~F.col("refresh") | stale)
    order = [F.col("refresh"), F.when(~F.col("refresh"), F.col("rank")), F.when(F.col("refresh"), F.col("last_attempt")), F.col("ticker")]
    return j.orderBy(*order).limit(budget).select("ticker", F.when(F.col("refresh"), "refresh").otherwise("never").alias("why"))


def refresh_plan(universe: DataFrame, newest: DataFrame, misses: DataFrame, priority: DataFrame, as_of, budget: int, max_age: int = 7,
                 retry_days: int = 30) -> DataFrame:
    """Priority names first whatever their age, then the stalest above the age,
    within a budget; names that recently failed and hold no bars are parked."""
    at = F.lit(as_of).cast("date")
    names = universe.select("symbol").unionByName(priority.select("symbol")).distinct()
    j = (names.join(newest, "symbol", "left").join(misses.groupBy("symbol").agg(F.max("day").alias("miss")), "symbol", "left")
         .join(priority.select("symbol", F.lit(True).alias("head")).distinct(), "symbol", "left"))
    parked = F.col("newest").isNull() & (F.datediff(at, "miss") <= retry_days)
    age = F.when(parked, -1).otherwise(F.coalesce(F.datediff(at, "newest"), F.lit(10 ** 6)))
    head = F.coalesce("head", F.lit(False))
    return (j.select("symbol", head.alias("head"), age.alias("age")).where(F.col("head") | (F.col("age") > max_age))
            .orderBy(F.desc("head"), F.desc("age"), "symbol").limit(budget))


def parity(rows: DataFrame, tol_abs: float, tol_rel: float) -> DataFrame:
    """Missingness, then state, then tolerance."""
    a, b = F.col("legacy_value"), F.col("ledger_value")
    diff = F.bround(F.abs(a - b), 12)
    allowed = F.greatest(F.lit(tol_abs), tol_rel * F.greatest(F.abs(a), F.abs(b)))
    same = F.col("legacy_status") == F.col("ledger_status")
    reason = (F.when(a.isNull() != b.isNull(), "missingness mismatch").when(~same, "state mismatch")
              .when(a.isNull(), "both missing with matching state")
              .when(F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")) | (F.abs(b) == float("inf")), "non-finite value")
              .when(diff <= allowed, "within tolerance").otherwise("numeric mismatch"))
    return rows.withColumn("reason", reason).withColumn(
        "verdict", F.when(F.col("reason").isin("within tolerance", "both missing with matching state"), "PASS").otherwise("FAIL")).withColumn(
        "difference", F.when(F.col("reason").isin("within tolerance", "numeric mismatch"), diff))


def due_reviews(entries: DataFrame, grades: DataFrame, as_of) -> DataFrame:
    """Past their horizon and ungraded, or last graded too early a year ago."""
    at = F.lit(as_of).cast("date")
    last = latest(grades, ["entry_id"], ["graded_at", "grade_id"]).select("entry_id", "grade")
    j = entries.where(F.col("review_horizon") <= at).join(last, "entry_id", "left")
    again = (F.col("grade") == "too_early") & (F.date_add("review_horizon", 365) <= at)
    return j.where(F.col("grade").isNull() | again)


def review_matrix(entries: DataFrame, grades: DataFrame) -> DataFrame:
    """Counts by process and last grade, with both margins (a cube), and the
    dangerous wins among them: deviated from process, yet good."""
    last = latest(grades, ["entry_id"], ["graded_at", "grade_id"]).select("entry_id", "grade")
    return (entries.join(last, "entry_id").where("process IS NOT NULL").cube("process", "grade").agg(
        F.count("*").alias("n"), F.count_if((F.col("process") == "deviated") & (F.col("grade") == "good")).alias("dangerous_wins")))


def content_hash(*cols) -> Column:
    """SHA-256 of the row as canonical JSON: keys sorted, no blanks."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)
