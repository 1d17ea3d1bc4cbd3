"""Re-tests of committed theses, driven by change.

A run keeps one report per thesis with the fingerprint of the inputs that it was made from. The next run tests only theses whose
fingerprint differs; the others keep their report. Fingerprints are sums and exclusive ors of row hashes, so they are combined on
the map side, whatever the number of rows behind a thesis, and do not depend on the order of rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = ("entity", "status", "broken_by", "review_by", "unchecked", "triggers")
WHOLE = "(whole thesis)"


def fingerprints(*inputs: DataFrame, key: str = "entity") -> DataFrame:
    """(entity, fingerprint) over all rows of the inputs; the input's place and each row's repeats count."""
    hashed = None
    for i, df in enumerate(inputs):
        cells = [F.to_json(F.struct(F.col(c))) for c in sorted(df.columns) if c != key]
        one = df.select(key, F.xxhash64(F.lit(i), *cells).alias("h"))
        hashed = one if hashed is None else hashed.unionByName(one)
    mixed = hashed.groupBy(key).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"), F.count(F.lit(1)).alias("n"))
    return mixed.select(key, F.concat_ws(":", F.col("n"), F.col("s"), F.hex("x")).alias("fingerprint"))


def _reason(metric: Column, demoted: Column) -> Column:
    answer = F.concat(F.when(F.col("tripped"), "tripped").otherwise("not tripped"), F.lit(" ("), F.coalesce("confidence", F.lit("no")), F.lit(" confidence)"))
    return (F.when(metric & F.col("checked"), F.concat(F.col("streak").cast("string"), F.lit(" of "), F.col("needed").cast("string"), F.lit(" checks")))
            .when(metric, "no value").when(~F.col("checked"), "no verdict").when(demoted, F.concat(answer, F.lit(", asks for review"))).otherwise(answer))


def reports(theses: DataFrame, results: DataFrame) -> DataFrame:
    """One nested row per thesis (REPORT). theses: (entity, status); results: one row per trigger (entity, pos, id, kind, action,
    checked, tripped, streak, needed, confidence). A break by an event below high confidence only asks for review; broken stays
    broken. A thesis without a readable trigger is an error, not an all-clear."""
    metric = F.col("kind") == "metric"
    demoted = F.coalesce((F.col("kind") == "event") & (F.col("action") == "break") & ~F.coalesce(F.col("confidence") == "high", F.lit(False)), F.lit(False)) & F.col("tripped")
    breaks = F.col("checked") & F.col("tripped") & (F.col("action") == "break") & ~demoted
    mark = F.when(~F.col("checked"), "unchecked").when(breaks, "broke").when(F.col("tripped"), "review").otherwise("ok")
    row = F.struct("pos", "id", "kind", "action", mark.alias("mark"), _reason(metric, demoted).alias("reason"))
    g = results.groupBy("entity").agg(F.sort_array(F.collect_list(row)).alias("triggers"))          # one document's triggers

    def ids(m):
        return F.transform(F.filter("triggers", lambda t: t["mark"] == m), lambda t: t["id"])

    j = theses.join(g, "entity", "left")
    bad = F.col("triggers").isNull()
    status = F.when(F.col("status") == "broken", "broken").when(bad, "error").when(F.size(ids("broke")) > 0, "broken").when(F.size(ids("review")) > 0, "under_review").otherwise("intact")
    none = F.array().cast("array<string>")
    return j.select("entity", status.alias("status"), F.coalesce(ids("broke"), none).alias("broken_by"), F.coalesce(ids("review"), none).alias("review_by"),
                    F.when(bad, F.array(F.lit(WHOLE))).otherwise(ids("unchecked")).alias("unchecked"), "triggers")


def run(theses: DataFrame, prints: DataFrame, evaluate: Callable[[DataFrame], DataFrame], previous: DataFrame | None = None) -> DataFrame:
    """Reports of all theses (REPORT, fingerprint, retested). ``evaluate`` takes the keys to test (entity) and returns their trigger
    results; ``previous`` is the last run's output. Theses no longer committed leave the report. Broken is sticky over runs."""
    now = theses.join(prints, "entity", "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))
    if previous is None:
        tested = reports(theses, evaluate(theses.select("entity")))
        return tested.join(now.select("entity", "fingerprint"), "entity").withColumn("retested", F.lit(True))
    last = previous.select("entity", F.col("fingerprint").alias("_print"), F.col("status").alias("_status"))
    due = now.join(last, "entity", "left").withColumn("_due", ~F.col("fingerprint").eqNullSafe(F.col("_print")))
    changed = due.where("_due").select("entity", F.when(F.col("_status") == "broken", "broken").otherwise(F.col("status")).alias("status"), "fingerprint")
    fresh = reports(changed.select("entity", "status"), evaluate(changed.select("entity"))).join(changed.select("entity", "fingerprint"), "entity")
    kept = previous.join(due.where("NOT _due").select("entity"), "entity", "left_semi").select(*REPORT, "fingerprint")
    return fresh.select(*REPORT, "fingerprint").withColumn("retested", F.lit(True)).unionByName(kept.withColumn("retested", F.lit(False)))
