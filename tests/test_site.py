"""Site tables of two runs: coverage before and after, ranks with ties, names that join and leave."""

from lodestat.plans import site

METRICS = ("alpha", "beta")
SCHEMA = "entity string, sector string, tier string, grade string, composite double, alpha double, beta double"


def run(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_gains_by_metric_and_in_all(spark):
    old = run(spark, ("A", "S", "Core", "B", 60.0, 1.0, None), ("B", "S", "Core", "C", 50.0, 1.0, None))
    new = run(spark, ("A", "S", "Core", "B", 60.0, 1.0, None), ("B", "S", "Core", "C", 50.0, 1.0, 2.0))
    got = {(r.level, r.part, r.metric): r for r in site.coverage(old, new, METRICS).collect()}
    every = got["all", None, None]
    assert (every.eligible, every.measured_before, every.measured, every.gain_points) == (4, 2, 3, 25.0)
    beta = got["all", None, "beta"]
    assert (beta.measured_before, beta.measured, beta.gained, beta.lost) == (0, 1, 1, 0)
    assert got["tier", "Core", "beta"].gained == got["sector", "S", "beta"].gained == 1
    assert len(got) == 3 * (len(METRICS) + 1)


def test_names_that_join_leave_and_swap(spark):
    old = run(spark, ("A", "S", "Core", "B", 60.0, 1.0, 3.0), ("B", "S", None, "C", 50.0, None, None), ("C", "T", "Core", "D", 40.0, 1.0, 1.0))
    new = run(spark, ("B", "S", "Core", "A", 90.0, 1.0, None), ("C", "T", "Core", "A", 90.0, None, 1.0), ("D", None, None, "VETOED", None, None, None), ("E", "S", "Core", "F", 10.0, 1.0, 1.0))
    got = {r.entity: r for r in site.name_rows(old, new, METRICS).collect()}
    assert {e: r.state for e, r in got.items()} == {"A": "left", "B": "kept", "C": "kept", "D": "joined", "E": "joined"}
    assert {e: (r.rank, r.sector_rank, r.rank_before, r.places_won) for e, r in got.items()} == {
        "A": (None, None, 1, None), "B": (1, 1, 2, 1), "C": (1, 1, 3, 2), "D": (None, None, None, None), "E": (3, 2, None, None)}
    assert (got["C"].gained, got["C"].lost, got["A"].lost) == ([], ["alpha"], ["alpha", "beta"])
    cover = {(r.level, r.part, r.metric): r for r in site.coverage(old, new, METRICS).collect()}
    assert (cover["all", None, "alpha"].eligible_before, cover["all", None, "alpha"].eligible, cover["all", None, "alpha"].lost) == (3, 4, 2)
    assert cover["tier", "", "beta"].eligible == 1          # no tier


def test_empty_runs(spark):
    none = run(spark, ("A", "S", "Core", "B", 60.0, 1.0, None)).where("false")
    assert site.name_rows(none, none, METRICS).count() == 0
    assert site.coverage(none, none, METRICS).where("metric IS NOT NULL").count() == 0
