"""Shortlist by tier: cuts, ties, stars past the cut, names without a grade."""

from lodestat.operators import cohorts


def test_tiers_and_stars(spark):
    rows = [("a", "Core", "B", 70.0), ("b", "Core", "B", 70.0), ("c", "Core", "A", 69.0), ("d", "Outside", "A", 95.0), ("e", "Outside", "A", 90.0), ("f", "Outside", "A", 85.0),
            ("g", "Outside", "B", 84.0), ("h", "Adjacent", "VETOED", None), ("i", "Adjacent", "INSUFFICIENT", None), ("j", "Core", "VETOED", 99.0)]
    got = {r.entity: r.star for r in cohorts.tier_shortlist(spark.createDataFrame(rows, "entity string, tier string, grade string, composite double"), 2).collect()}
    assert got == {"a": False, "b": False, "d": False, "e": False, "f": True}
