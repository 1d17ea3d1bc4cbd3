"""From filed facts to grades at a date: flows and points become wide statements, known shares and prices join them, and the
evaluation and the sector grades follow. Nothing filed, split or traded after the date is read."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators import asof, pit, rules
from lodestat.plans import evaluate as E
from lodestat.plans import grading
from lodestat.session import dealt, stage


def _latest(facts: DataFrame, instant: bool) -> DataFrame:
    """``pit.latest_filed`` of rows that are dealt out first: a company's tag has few rows, and Spark can only sort for the latest."""
    return pit.latest_filed(dealt(facts, "entity", "tag"), instant=instant)


def statements_at(facts: DataFrame, as_of, flows: dict, points: dict, spans: dict | None = None) -> DataFrame:
    """Wide rows (entity, scope, period_end, a column per label) as they were known: ``flows`` and ``points`` map a label to its
    rule (``operators.rules``; a bare chain of tags will do). ``spans`` names tags that are the sum of others over exactly the same
    span, summed before quarters are derived. Facts with a namespace and a unit count in the standard one and, tag by tag, in the unit
    preferred at the date. A day that only has points is a quarterly row of its own."""
    known, spans = pit.one_unit(pit.visible(facts, as_of)), spans or {}
    tags = {*rules.names(flows), *(t for parts in spans.values() for t in parts)}
    periods = _latest(known.where(F.col("tag").isin(*sorted(tags))), instant=False).select("entity", "tag", *pit.SPAN, "value")
    for label, parts in spans.items():
        periods = periods.unionByName(pit.compose_spans(periods, tuple(parts), label))
    periods, by = stage(periods, "periods"), ("entity", "scope", "end_day")      # annual, short, longer and prior spans read it
    f = rules.wide(rules.resolve(pit.tag_flows(periods), flows, by=by), flows, by).withColumnRenamed("end_day", "period_end")
    p = _latest(known.where(F.col("start_day").isNull() & F.col("tag").isin(*rules.names(points))), instant=True)
    p = rules.wide(rules.resolve(p, points), points).withColumnRenamed("end_day", "period_end")
    quarterly = f.where("scope = 'quarterly'").drop("scope").join(p, ["entity", "period_end"], "full_outer").withColumn("scope", F.lit("quarterly"))
    annual = f.where("scope = 'annual'").join(p, ["entity", "period_end"], "left")
    return quarterly.unionByName(annual).select("entity", "scope", "period_end", *flows, *points)


def shares_at(counts: DataFrame, splits: DataFrame, as_of) -> DataFrame:
    """(entity, end_day, value) of the counts known at the date, in its share terms; a series that has ended too long before is refused."""
    last = pit.visible(counts, as_of).groupBy("entity", "end_day").agg(F.max_by("value", F.struct("filed", "seq", "value")).alias("value"))
    fresh = last.groupBy("entity").agg(F.max("end_day").alias("_d")).where(F.datediff(F.lit(as_of).cast("date"), "_d") <= asof.SHARES_MAX_AGE_DAYS)
    return asof.restate(last.join(fresh.select("entity"), "entity", "left_semi"), splits, until=as_of)


def grades_at(facts: DataFrame, shares: DataFrame, market: DataFrame, meta: DataFrame, as_of, flows: dict, points: dict) -> DataFrame:
    """Scored rows of every entity at the date."""
    return grading.score(E.evaluate(statements_at(facts, as_of, flows, points), shares, market, meta))
