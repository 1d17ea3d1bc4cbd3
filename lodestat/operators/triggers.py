"""Pre-committed rules: nested trigger documents, tests, streaks, roll-ups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS, OPS, ACTIONS, MOATS = ("metric", "event", "narrative"), ("<", "<=", ">", ">="), ("break", "review"), (
    "network_effects", "switching_costs", "cost_advantage", "brand_trust", "regulatory", "none")
MIN_TRIGGERS = 3
WINDOW_PERIODS = {"single_observation": 1, "2_consecutive_quarters": 2, "ttm": 1}
TRIGGER = "struct<id:string,kind:string,metric:string,op:string,threshold:double,needed:int,action:string>"


def hit(value: Column, op: Column, threshold: Column) -> Column:
    return (F.when(op == "<", value < threshold).when(op == "<=", value <= threshold)
            .when(op == ">", value > threshold).when(op == ">=", value >= threshold))


def margin(value: Column, op: Column, threshold: Column) -> Column:
    """Signed safety margin: percent of the threshold, points when it is 0."""
    gap = F.when(op.startswith("<"), value - threshold).otherwise(threshold - value)
    return F.when(threshold == 0, gap).otherwise(100.0 * gap / F.abs(threshold))


def rows(docs: DataFrame) -> DataFrame:
    """One row per trigger of each document, with its place."""
    return docs.select("entity", "status", F.posexplode("triggers").alias("pos", "t")).select("entity", F.col("status").alias("doc_status"), "pos", "t.*")


def violations(docs: DataFrame) -> DataFrame:
    """Problems of each document: shape, enums, counts, duplicate ids."""
    t = F.col("triggers")
    bad = F.array_compact(F.array(
        F.when(~F.col("moat").isin(*MOATS), F.lit("moat kind unknown")),
        F.when(F.size(t) < MIN_TRIGGERS, F.format_string("only %d triggers, need 3", F.size(t))),
        F.when(~F.exists(t, lambda x: x["kind"] == "metric"), F.lit("no metric trigger")),
        F.when(F.size(F.array_distinct(F.transform(t, lambda x: x["id"]))) < F.size(t), F.lit("duplicate trigger id")),
        F.when(F.exists(t, lambda x: ~x["kind"].isin(*KINDS)), F.lit("trigger kind unknown")),
        F.when(F.exists(t, lambda x: (x["kind"] == "metric") & (x["threshold"].isNull() | ~F.coalesce(x["op"], F.lit("")).isin(*OPS))), F.lit("metric trigger incomplete")),
        F.when(F.exists(t, lambda x: (x["kind"] == "narrative") & (x["action"] != "review")), F.lit("narrative trigger must review"))))
    return docs.select("entity", bad.alias("problems"))


def streaks(checks: DataFrame) -> DataFrame:
    """Consecutive hits per (entity, id) up to each date. A date counts once (the
    last check of the date wins), a miss resets. checks: (entity, id, day, seq, hit)."""
    once = checks.groupBy("entity", "id", "day").agg(F.max_by("hit", "seq").alias("hit"))
    run = W.partitionBy("entity", "id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    island = once.withColumn("isle", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(run))
    inside = W.partitionBy("entity", "id", "isle").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(F.when(F.col("hit"), 1).otherwise(0)).over(inside)).drop("isle")


def evaluate(trigger_rows: DataFrame, values: DataFrame) -> DataFrame:
    """Trigger rows with the latest value of their metric: (hit, margin, checked)."""
    j = trigger_rows.join(values, ["entity", "metric"], "left")
    return j.withColumns({"hit": F.coalesce(hit(F.col("value"), F.col("op"), F.col("threshold")), F.lit(False)),
                          "margin": margin(F.col("value"), F.col("op"), F.col("threshold")), "checked": F.col("value").isNotNull()})


def rollup(results: DataFrame) -> DataFrame:
    """Status per document: broken (sticky) over under_review over intact, with the
    ids behind it. A break by an event below high confidence only asks for review."""
    tripped = F.col("checked") & F.col("tripped")
    breaks = tripped & (F.col("action") == "break") & ~F.coalesce((F.col("kind") == "event") & (F.col("confidence") != "high"), F.lit(False))
    ids = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("id")))), ",")
    g = results.groupBy("entity", "doc_status").agg(ids(breaks).alias("broken_by"), ids(tripped & ~breaks).alias("review_by"), ids(~F.col("checked")).alias("unchecked"))
    status = F.when((F.col("doc_status") == "broken") | (F.col("broken_by") != ""), "broken").when(F.col("review_by") != "", "under_review").otherwise("intact")
    return g.select("entity", status.alias("status"), "broken_by", "review_by", "unchecked")


def persistence(series: DataFrame, rules: DataFrame, as_of, max_age: int = 135) -> DataFrame:
    """FIRE if all of the last k periods breach, PASS if not, BOOTSTRAPPING with the
    date it becomes testable if the series is too short, STALE if it is old.
    series: (entity, period_end, value); rules: (entity, op, threshold, need)."""
    newest = W.partitionBy("entity").orderBy(F.desc("period_end"))
    j = series.withColumn("rn", F.row_number().over(newest)).join(rules, "entity").where("rn <= need")
    g = j.groupBy("entity", "op", "threshold", "need").agg(
        F.count("*").alias("n"), F.max("period_end").alias("last"), F.max_by("value", "period_end").alias("observed"),
        F.bool_and(hit(F.col("value"), F.col("op"), F.col("threshold"))).alias("all_hit"))
    stale = F.datediff(F.lit(as_of).cast("date"), "last") > max_age
    result = F.when(stale, "STALE").when(F.col("n") < F.col("need"), "BOOTSTRAPPING").when(F.col("all_hit"), "FIRE").otherwise("PASS")
    done = result.isin("FIRE", "PASS")
    return g.select("entity", result.alias("result"), F.when(done, F.col("observed")).alias("observed"),
                    F.when(done, F.when(F.col("op") == "<", F.col("observed") - F.col("threshold")).otherwise(F.col("threshold") - F.col("observed"))).alias("headroom"),
                    F.when(result == "BOOTSTRAPPING", F.date_add("last", (F.lit(91) * (F.col("need") - F.col("n"))).cast("int"))).alias("evaluable_from"))


def goalposts(old: DataFrame, new: DataFrame) -> DataFrame:
    """How each old trigger was moved: removed, another metric, an easier threshold,
    or more checks needed."""
    o = old.select("entity", "id", *[F.col(c).alias(f"o_{c}") for c in ("metric", "op", "threshold", "needed")])
    j = o.join(new, ["entity", "id"], "left")
    easier = F.when(F.col("o_op").startswith("<"), F.col("threshold") < F.col("o_threshold")).otherwise(F.col("threshold") > F.col("o_threshold"))
    move = (F.when(F.col("kind").isNull(), "removed").when(~F.col("metric").eqNullSafe(F.col("o_metric")), "metric changed")
            .when(easier, "easier threshold").when(F.coalesce("needed", F.lit(1)) > F.coalesce("o_needed", F.lit(1)), "slower"))
    return j.select("entity", "id", move.alias("moved")).where("moved IS NOT NULL")
