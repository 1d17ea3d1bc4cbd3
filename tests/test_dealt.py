"""Rows are dealt out by key before Spark sorts for the best of them; results are those of a plain walk."""

import datetime as dt
import random


from lodestat import relations as R
from lodestat import session
from lodestat.catalog import c_grading
from lodestat.functions import concepts
from lodestat.operators import series
from lodestat.plans import chain, fragile, ticks

LINE = "l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string"


def lines(spark, tmp_path, n=400):
    rng = random.Random(9)
    rows = [(rng.randint(1, 60), rng.randint(1, 4), rng.choice([1, 2, 3, None]), dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 60)) if rng.random() > 0.05 else None,
             float(rng.randint(1, 50)), float(rng.randint(1, 9)), rng.choice([0.0, 0.1]), rng.choice("RA")) for _ in range(n)]
    rows += rows[:20]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    return rows


def first_steps(df):
    """The lines of the plan from the deepest exchange to the scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.rindex("Exchange "):]


def test_bars_are_the_last_line_of_each_week(spark, tmp_path):
    rows = lines(spark, tmp_path)
    bars = R.bars(spark, str(tmp_path))
    assert "Aggregate" not in first_steps(bars)
    want = {}
    for o, n, s, day, price, q, disc, _ in rows:
        week = None if day is None else day.date() - dt.timedelta(days=day.weekday())
        line = (day or dt.datetime.min, o, n, price, q, disc)
        want[s, week] = max(want.get((s, week), line), line)
    got = {(r.symbol, r.day): (r.close, r.adj_close) for r in bars.collect()}
    assert got == {k: (v[3] / v[4], v[3] / v[4] * (1 - v[5])) for k, v in want.items()}


def test_counts_are_dealt_too(spark, tmp_path):
    rows = lines(spark, tmp_path)
    counts = c_grading.last_counts(R.share_counts(spark, str(tmp_path)))
    assert "Aggregate" not in first_steps(counts)
    assert counts.count() == len({(s, None if d is None else (d.year, (d.month - 1) // 3)) for _, _, s, d, *_, flag in rows if flag == "R"})


def test_versions_cross_the_network_once(spark):
    day = dt.date(2020, 1, 1)
    rows = [(1, "a", day, day + dt.timedelta(days=30 * i), i, float(i)) for i in (0, 1, 1, 5)] + [(2, "a", day, day, 0, 7.0)]
    facts = spark.createDataFrame(rows, "entity long, tag string, end_day date, filed date, seq long, value double")
    at = spark.createDataFrame([(day + dt.timedelta(days=45 * i),) for i in range(4)], "tick date")
    out = ticks.versions(facts, at, ["entity", "tag", "end_day"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(entity") == 1
    got = sorted((r.entity, r.tick, r.value, r.until) for r in out.collect())
    t = [day + dt.timedelta(days=45 * i) for i in range(4)]
    assert got == [(1, t[0], 0.0, t[1]), (1, t[1], 1.0, None), (2, t[0], 7.0, None)]


def test_statement_lines_are_dealt_before_they_are_summed(spark, tmp_path):
    """31 sums per company and quarter are wider than a line: they are not made split by split, and lines are exchanged once."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 800)) if rng.random() > 0.05 else None, rng.randint(100, 9999) / 100, rng.choice("RA"),
             rng.choice("FO"), rng.randint(0, 8) / 100, rng.randint(0, 10) / 100, float(rng.randint(1, 50))) for _ in range(300)]
    columns = "l_suppkey long, l_shipdate date, l_extendedprice double, l_returnflag string, l_linestatus string, l_tax double, l_discount double, l_quantity double"
    spark.createDataFrame(rows + rows[:9], columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    st = R.statements(spark, str(tmp_path))
    plan = st._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in first_steps(st)
    want = {}
    for s, day, price, *_ in rows + rows[:9]:
        q = None if day is None else dt.date(day.year + day.month // 10, (day.month - 1) // 3 * 3 % 9 + 4 if day.month < 10 else 1, 1) - dt.timedelta(days=1)
        for key in ((s, "quarterly", q), (s, "annual", q and dt.date(day.year, 12, 31))):
            want[key] = want.get(key, 0) + round(price * 100)
    assert {(r.entity, r.scope, r.period_end): r.revenue for r in st.collect()} == {k: v * 1000 / 100000.0 for k, v in want.items()}


def test_falls_are_worked_out_once(spark, monkeypatch):
    day, made = dt.date(2018, 1, 1), []
    levels = series.levels
    monkeypatch.setattr(series, "levels", lambda *a, **k: made.append(1) or levels(*a, **k))
    labels = ", ".join(f"{c} double" for c in (*R.LABELS,))
    st = spark.createDataFrame([(1, "annual", dt.date(2018, 12, 31), *[1.0] * len(R.LABELS))], f"entity long, scope string, period_end date, {labels}")
    ev = spark.createDataFrame([(1, 1.0, 2.0, 3.0, False)], "entity long, current_debt double, cash double, owner_fcf double, share_class boolean")
    bars = spark.createDataFrame([(1, day + dt.timedelta(days=7 * i), p, p) for i, p in enumerate([10.0, 20.0, 5.0, *[6.0] * 60])], "symbol long, day date, close double, adj_close double")
    shares = spark.createDataFrame([(1, day, 100.0)], "entity long, end_day date, value double")
    splits = spark.createDataFrame([], "symbol long, day date, ratio double")
    found = fragile.findings(st, ev, bars, shares, splits, [2018])
    assert len(made) == 1
    assert [(r.severity, r.value) for r in found.where("probe = 'price_drawdown'").collect()] == [("severe", -0.75)] and found.count() == 6


def test_facts_are_read_once_for_flows_and_once_for_points(spark):
    rows = [(1, "Revenues", dt.date(2001, 1, 1), dt.date(2001, 3, 31), dt.date(2001, 5, 1), "10-Q", 4.0, 0), (1, concepts.CASH[0], None, dt.date(2001, 3, 31), dt.date(2001, 5, 1), "10-Q", 7.0, 0)]
    facts = spark.createDataFrame(rows, "entity long, tag string, start_day date, end_day date, filed date, form string, value double, seq long")
    st = chain.statements_at(facts, "2001-12-31", {"revenue": concepts.REVENUE}, {"cash": concepts.CASH})
    assert st._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2       # beside quarters and beside years
    assert [(r.scope, r.revenue, r.cash) for r in st.collect()] == [("quarterly", 4.0, 7.0)]


def test_rows_of_unknown_size_are_not_dealt_into_thousands(spark):
    rows = spark.createDataFrame([(1, 2)], "a long, b long")
    assert session.input_bytes(rows) == 0 and session.dealt(rows, "a").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
