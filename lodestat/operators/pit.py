"""Point-in-time facts: what was filed, and known, at a date.

Facts are long rows (entity, tag, start_day, end_day, filed, form, value, seq).
Reductions are ``max_by``/``min_by`` aggregates, so a hot key is combined on the
map side and never gathered; after ``latest_filed`` a key holds at most one row
per calendar span, which bounds every later window and join."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARTER_MAX_DAYS = 100
ANNUAL_DAYS = (330, 400)
SAME_START_DAYS = 7
YTD_START_DAYS = 365
CARRY_FORWARD_DAYS = 400
MULTICLASS_SPREAD_DAYS = 45
# fixed values: forms of annual filings (amendments count) and the share tag whose rows are kept as filed
ANNUAL_FORMS = ("10-K", "20-F", "40-F")
SHARES_TAG = "EntityCommonStockSharesOutstanding"

SPAN = ("start_day", "end_day")
PREFERRED_UNITS = ("USD", "shares")


def span_days() -> Column:
    return F.datediff("end_day", "start_day")


def visible(facts: DataFrame, as_of) -> DataFrame:
    """Rows knowable at ``as_of``."""
    return facts.where((F.col("filed") <= F.lit(as_of).cast("date"))
                       & F.col("value").isNotNull() & F.col("end_day").isNotNull())


def latest_filed(facts: DataFrame, *, instant: bool, keys=("entity", "tag")) -> DataFrame:
    """Latest-filed value per span (flows) or per end (instants)."""
    rows = facts if instant else facts.where(F.col("start_day").isNotNull())
    by = [*keys, "end_day"] if instant else [*keys, *SPAN]
    return rows.groupBy(*by).agg(
        F.max_by(F.struct("value", "filed"), F.struct("filed", "seq")).alias("w")
    ).select(*by, "w.value", "w.filed")


def newest_point(facts: DataFrame, keys=("entity",)) -> DataFrame:
    """Newest observation over all tags, and over all units where facts have them, with its provenance."""
    more = [c for c in ("namespace", "unit") if c in facts.columns and c not in keys]
    best = F.max(F.struct("end_day", "filed", "seq", "value", "form", "tag", *more)).alias("p")
    return facts.groupBy(*keys).agg(best).select(
        *keys, "p.value", "p.end_day", "p.filed", "p.form", "p.tag", *[f"p.{c}" for c in more])


def disclosures(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(entity, label, value, end_day, filed, form, tag, unit): the newest point of each label's tags in any unit; of one day the
    latest filed, then the tag that comes first in the chain, then the first unit by name."""
    order = F.struct("end_day", "filed", (-F.col("priority")).alias("p"))
    best = facts.join(concepts, "tag").groupBy("entity", "label", "unit").agg(F.max_by(F.struct("value", "end_day", "filed", "form", "tag", "priority"), F.struct(order, "seq")).alias("w"))
    best = best.select("entity", "label", "unit", "w.*")
    first = F.min_by(F.struct("value", "end_day", "filed", "form", "tag", "unit"), F.struct(-F.unix_date("end_day"), -F.unix_date("filed"), "priority", "unit"))
    return best.groupBy("entity", "label").agg(first.alias("w")).select("entity", "label", "w.*")


def prefer_unit(facts: DataFrame, keys=("entity", "tag")) -> DataFrame:
    """Only the preferred unit of each tag: USD, then shares, else first by name."""
    rank = F.lit(len(PREFERRED_UNITS))
    for i, u in reversed(list(enumerate(PREFERRED_UNITS))):
        rank = F.when(F.col("unit") == u, i).otherwise(rank)
    pick = facts.groupBy(*keys).agg(F.min_by("unit", F.struct(rank, F.col("unit"))).alias("unit"))
    return facts.join(pick, [*keys, "unit"], "left_semi")


def annual_flows(periods: DataFrame, keys=("entity", "tag")) -> DataFrame:
    """Year-long spans; the later start wins where two share an end."""
    return (periods.where(span_days().between(*ANNUAL_DAYS))
            .groupBy(*keys, "end_day").agg(F.max_by("value", "start_day").alias("value")))


def quarterly_flows(periods: DataFrame, keys=("entity", "tag")) -> DataFrame:
    """Discrete quarters: short spans as filed, and longer cumulative spans less
    their best prior cumulative (same start within 7 days, or itself longer than
    a quarter with a start within a year; end 1 to 100 days earlier; least start
    drift, then latest end; the earliest start wins per end).

    The prior is found by an equality join on (keys, 100-day bucket of the end),
    so a span meets only its neighbours."""
    short = (periods.where(span_days() <= QUARTER_MAX_DAYS)
             .groupBy(*keys, "end_day").agg(F.max_by("value", "start_day").alias("value")))
    longer = (periods.where(span_days() > QUARTER_MAX_DAYS)
              .join(short, [*keys, "end_day"], "left_anti")
              .withColumn("bucket", F.floor(F.unix_date("end_day") / QUARTER_MAX_DAYS)))
    own = F.floor(F.unix_date("end_day") / QUARTER_MAX_DAYS)
    prior = periods.select(
        *keys, F.col("start_day").alias("start2"), F.col("end_day").alias("end2"),
        F.col("value").alias("value2"), F.explode(F.array(own, own + 1)).alias("bucket"))
    drift = F.abs(F.datediff("start2", "start_day"))
    gap = F.datediff("end_day", "end2")
    cumulative = (drift <= SAME_START_DAYS) | (
        (F.datediff("end2", "start2") > QUARTER_MAX_DAYS) & (drift <= YTD_START_DAYS))
    derived = (
        longer.join(prior, [*keys, "bucket"])
        .where((gap > 0) & (gap <= QUARTER_MAX_DAYS) & cumulative)
        .groupBy(*keys, "end_day")
        .agg(F.min_by(F.col("value") - F.col("value2"),
                      F.struct("start_day", drift, -F.unix_date("end2"))).alias("value"))
    )
    return short.unionByName(derived)


def concept_table(spark, chains: dict) -> DataFrame:
    """label -> tags chain as rows (label, tag, priority). A fixed, small table."""
    rows = [(label, tag, i) for label, tags in chains.items() for i, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "label string, tag string, priority int")


def first_present(values: DataFrame, concepts: DataFrame, by=("entity", "end_day")) -> DataFrame:
    """Per label and period, the value of the first tag of the chain that has one."""
    return (values.join(concepts, "tag")
            .groupBy(by[0], "label", *by[1:])
            .agg(F.min_by("value", "priority").alias("value")))


def tag_flows(periods: DataFrame, keys=("entity", "tag")) -> DataFrame:
    """(*keys, scope, end_day, value): annual and quarterly flows of each key's latest-filed spans."""
    return (annual_flows(periods, keys).withColumn("scope", F.lit("annual"))
            .unionByName(quarterly_flows(periods, keys).withColumn("scope", F.lit("quarterly"))))


def one_unit(known: DataFrame, namespace: str | None = "us-gaap") -> DataFrame:
    """Facts of a namespace in the preferred unit of each (entity, namespace, tag), as the given facts have it: pass what was visible
    at a date, and a unit first used later has no say. Facts without these columns are returned as they are."""
    if namespace is not None and "namespace" in known.columns:
        known = known.where(F.col("namespace") == namespace)
    if "unit" not in known.columns:
        return known
    return prefer_unit(known, [c for c in ("entity", "namespace", "tag") if c in known.columns])


def chain_flows(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(entity, label, scope, end_day, value): annual and quarterly flows derived
    per tag first, then merged along the chain (merging first would subtract one
    tag's cumulative from another's)."""
    periods = latest_filed(facts.join(concepts, "tag", "left_semi"), instant=False)
    return first_present(tag_flows(periods), concepts, by=("entity", "scope", "end_day"))


def compose_spans(periods: DataFrame, parts: tuple, label: str) -> DataFrame:
    """Sum of two tags where both cover exactly the same span."""
    return (periods.where(F.col("tag").isin(*parts))
            .groupBy("entity", *SPAN)
            .agg(F.sum("value").alias("value"), F.count("value").alias("n"))
            .where(F.col("n") == len(parts))
            .select("entity", F.lit(label).alias("tag"), *SPAN, "value"))


def fill_absent(base: DataFrame, extra: DataFrame, keys, source: str) -> DataFrame:
    """Base rows, and extra rows for keys the base has none of, stamped by source."""
    add = extra.join(base.select(*keys).distinct(), list(keys), "left_anti")
    return (base.withColumn("source", F.lit("base"))
            .unionByName(add.withColumn("source", F.lit(source))))


def agreeing(values: DataFrame, keys) -> DataFrame:
    """Groups whose latest-filed values agree; conflicting same-day values are refused."""
    top = (values.groupBy(*keys, "filed").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
           .groupBy(*keys).agg(F.max_by(F.struct("lo", "hi"), "filed").alias("t")))
    return top.where(F.col("t.lo") == F.col("t.hi")).select(*keys, F.col("t.lo").alias("value"))


def pays_interest(facts: DataFrame, interest_tags, asset_tags) -> DataFrame:
    """Entity pays interest: any flow above max(1e5, 1 basis point of peak assets)."""
    flow = latest_filed(facts.where(F.col("tag").isin(*interest_tags)), instant=False)
    base = (latest_filed(facts.where(F.col("tag").isin(*asset_tags)), instant=True)
            .groupBy("entity").agg(F.max("value").alias("assets")))
    peak = flow.groupBy("entity").agg(F.max(F.abs("value")).alias("peak"))
    return peak.join(base, "entity", "left").select(
        "entity", (F.col("peak") > F.greatest(F.lit(1e5), F.coalesce("assets", F.lit(0.0)) * 1e-4))
        .alias("pays"))


def class_share_series(counts: DataFrame) -> DataFrame:
    """Share series: class counts summed per filing; the latest filing wins per
    date; one filing that measures on two dates voids the entity's series."""
    per_filing = counts.groupBy("entity", "filed").agg(
        F.min("end_day").alias("end_day"), F.max("end_day").alias("last"), F.sum("value").alias("value"))
    void = (per_filing.where(F.col("end_day") != F.col("last")).select("entity").distinct())
    return (per_filing.join(void, "entity", "left_anti")
            .groupBy("entity", "end_day").agg(F.max_by("value", "filed").alias("value")))


def share_fallback(counts: DataFrame) -> DataFrame:
    """Newest filing only: the sum of classes measured within 45 days, else the
    largest class (first filed among equals)."""
    per_filing = counts.groupBy("entity", "filed").agg(
        F.min("end_day").alias("lo"), F.max("end_day").alias("hi"), F.sum("value").alias("total"),
        F.max_by(F.struct("end_day", "value"), F.struct(F.col("value"), -F.col("seq"))).alias("top"))
    last = per_filing.groupBy("entity").agg(
        F.max_by(F.struct("lo", "hi", "total", "top"), "filed").alias("f"))
    near = F.datediff("f.hi", "f.lo") <= MULTICLASS_SPREAD_DAYS
    return last.select(
        "entity",
        F.when(near, F.col("f.hi")).otherwise(F.col("f.top.end_day")).alias("end_day"),
        F.when(near, F.col("f.total")).otherwise(F.col("f.top.value")).alias("value"),
        F.when(near, "fallback-sum").otherwise("fallback-largest").alias("basis"))


def prune_history(facts: DataFrame, as_of, years: int = 5, annual_forms: tuple = ANNUAL_FORMS, exempt: tuple = (SHARES_TAG,)) -> DataFrame:
    """Latest-filed rows worth keeping: spans of a year or more always, instants that an
    annual form has filed always, everything else from the start of the year ``years``
    years back. Rows of exempt tags are all kept, as filed."""
    with_seq = ("seq",) if "seq" in facts.columns else ()
    order = F.struct("filed", *with_seq)
    annual = F.bool_or(F.lit(False))
    for form in annual_forms:
        annual = annual | F.bool_or(F.col("form").startswith(form))
    rest = facts.where(~F.col("tag").isin(*exempt)).groupBy("entity", "tag", *SPAN).agg(
        F.max_by(F.struct("value", "filed", "form", *with_seq), order).alias("w"), annual.alias("_annual"))
    horizon = F.make_date(F.year(F.lit(as_of).cast("date")) - years, F.lit(1), F.lit(1))
    long_enough = F.when(F.col("start_day").isNull(), F.col("_annual")).otherwise(span_days() >= ANNUAL_DAYS[0])
    columns = ["entity", "tag", *SPAN, "filed", "form", "value", *with_seq]
    kept = rest.where(F.coalesce(long_enough, F.lit(False)) | (F.col("end_day") >= horizon)).select("entity", "tag", *SPAN, "w.*").select(*columns)
    return kept.unionByName(facts.where(F.col("tag").isin(*exempt)).select(*columns))
