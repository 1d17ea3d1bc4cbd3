"""Operators without SQL, and hot keys, against brute force on small tables."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from lodestat.functions import labels, names
from lodestat.operators import asof, chunks, cohorts, ledger, pit, ranks, series
from lodestat.operators import statements as S

D = dt.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_ranks_in_a_hot_group_with_ties(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"g{i % 7}", rng.choice([0.0, rng.randint(0, 50), rng.random()]), i) for i in range(3000)]
    df = spark.createDataFrame([(g, float(x), i) for g, x, i in data], "g string, x double, i long")
    got = {(g, x): (n, lt, le) for g, x, n, lt, le in rows(ranks.value_ranks(df, ["g"], "x", chunks=8).select("g", "x", "n", "n_lt", "n_le"))}
    for g, x, _ in data:
        group = [v for h, v, _ in data if h == g]
        assert got[(g, float(x))] == (len(group), sum(v < x for v in group), sum(v <= x for v in group))


def test_rank_order_breaks_ties_by_key(spark):
    data = [("a", float(i % 4), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, x double, i long")
    got = {i: r for i, r in rows(cohorts.rank_order(df, ["g"], "x", "i").select("i", "rank"))}
    want = {i: n + 1 for n, (_, x, i) in enumerate(sorted(data, key=lambda r: (-r[1], r[2])))}
    assert got == want


def test_single_member_cohort_reads_fifty(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 2.0)], "g string, x double")
    got = {(g, x): p for g, x, p in rows(ranks.with_percentile(df, ["g"], "x", "p").select("g", "x", "p"))}
    assert got == {("a", 3.0): 50.0, ("b", 1.0): 25.0, ("b", 2.0): 75.0}


def test_asof_join_hot_key(spark):
    rng = random.Random(2)
    base = D(2000, 1, 1)
    right = sorted({(1, base + dt.timedelta(days=rng.randint(0, 3000))) for _ in range(200)})
    left = [(rng.choice([1, 2]), base + dt.timedelta(days=rng.randint(-10, 3100)), i) for i in range(400)]
    r = spark.createDataFrame([(k, d, float(n)) for n, (k, d) in enumerate(right)], "k long, day date, v double")
    lf = spark.createDataFrame(left, "k long, at date, i long")
    got = {i: v for i, v in rows(asof.asof_join(lf, r, "k", "at", "day", ("v",)).select("i", "v"))}
    for k, at, i in left:
        prior = [float(n) for n, (rk, d) in enumerate(right) if rk == k and d <= at]
        assert got[i] == (prior[-1] if prior else None)


def test_lag_and_running_sum_across_chunks(spark):
    rng = random.Random(3)
    data = [("k" if i % 3 else "j", i // 10, i, rng.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(data, "key string, chunk long, i long, x long")
    got = {i: (p, s) for i, p, s in rows(chunks.running_sum_in_chunks(chunks.lag_in_chunks(df, ["key"], "chunk", ["i"], "x", "prev"), ["key"], "chunk", ["i"], "x", "before").select("i", "prev", "before"))}
    for key in ("k", "j"):
        prev, total = None, 0
        for k, _, i, x in data:
            if k == key:
                assert got[i] == (prev, total)
                prev, total = x, total + x


def test_pause_windows_follow_the_fold(spark):
    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(4)
    data = []
    for key in (1, 2):
        t = t0
        for i in range(60):
            t += dt.timedelta(hours=rng.randint(1, 40))
            kind = rng.choice(["on", "off"])
            planned = t + dt.timedelta(hours=rng.randint(5, 50)) if kind == "on" and rng.random() < 0.5 else None
            data.append((key, str(t.date()), t, i, kind, planned))
    df = spark.createDataFrame(data, "ticker long, day string, ts timestamp_ntz, seq long, kind string, planned timestamp_ntz")
    want = set()
    for key in (1, 2):
        start = plan = None
        for k, _, t, _, kind, planned in data:
            if k != key:
                continue
            if kind == "on":
                if start is not None:
                    if plan is not None and plan <= t:
                        want.add((key, start, plan))
                    else:
                        continue
                start, plan = t, planned
            elif start is not None:
                end = t if plan is None else min(t, plan)
                if end > start:
                    want.add((key, start, end))
                start = plan = None
        if start is not None:
            want.add((key, start, plan))
    assert set(rows(ledger.pause_windows(df))) == want


def test_annual_cadence_keeps_points_300_days_apart(spark):
    rng = random.Random(5)
    days = sorted({D(2000, 1, 1) + dt.timedelta(days=rng.randint(0, 3000)) for _ in range(40)})
    df = spark.createDataFrame([(1, d, 1.0) for d in days], "entity long, period_end date, v double").groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("period_end", "v"))).alias("p"))
    got = [r[0] for r in df.select(F.explode(S.cadence(F.col("p"))).alias("k")).select("k.period_end").collect()]
    want = []
    for d in days:
        if not want or (d - want[-1]).days >= 300:
            want.append(d)
    assert got == want


def test_yearly_issuance(spark):
    pts = [(1, D(2000, 1, 1), 100.0), (1, D(2000, 3, 1), 110.0), (1, D(2001, 3, 5), 121.0), (1, D(2002, 6, 1), 60.5)]
    got = rows(S.yearly_issuance(spark.createDataFrame(pts, "entity long, end_day date, value double")).orderBy("end_day"))
    assert [r[1] for r in got] == [D(2001, 3, 5), D(2002, 6, 1)]
    years = (D(2001, 3, 5) - D(2000, 3, 1)).days / 365.25
    assert abs(got[0][2] - 100 * ((121 / 110) ** (1 / years) - 1)) < 1e-9 and got[1][2] < 0


def test_quarters_from_cumulative_spans(spark):
    f = [(1, "t", D(2020, 1, 1), D(2020, 3, 31), 10.0), (1, "t", D(2020, 1, 1), D(2020, 6, 30), 25.0), (1, "t", D(2020, 1, 1), D(2020, 12, 31), 70.0),
         (1, "t", D(2020, 7, 1), D(2020, 9, 30), 18.0), (1, "t", D(2020, 1, 1), D(2020, 9, 30), 43.0)]
    p = spark.createDataFrame(f, "entity long, tag string, start_day date, end_day date, value double")
    got = dict((r[0], r[1]) for r in rows(pit.quarterly_flows(p).select("end_day", "value")))
    assert got == {D(2020, 3, 31): 10.0, D(2020, 6, 30): 15.0, D(2020, 9, 30): 18.0, D(2020, 12, 31): 27.0}
    assert rows(pit.annual_flows(p).select("value")) == [(70.0,)]


def test_later_filing_never_changes_the_past(spark):
    f = [(1, "t", D(2020, 1, 1), D(2020, 3, 31), D(2020, 4, 20), 10.0, 1), (1, "t", D(2020, 1, 1), D(2020, 3, 31), D(2021, 4, 20), 99.0, 2)]
    df = spark.createDataFrame(f, "entity long, tag string, start_day date, end_day date, filed date, value double, seq long")
    at = lambda day: rows(pit.latest_filed(pit.visible(df, day), instant=False).select("value"))
    assert at("2020-12-31") == [(10.0,)] and at("2021-12-31") == [(99.0,)]


def test_market_cap_does_not_move_with_a_split(spark):
    sp = spark.createDataFrame([(1, D(2020, 6, 1), 2.0)], "symbol long, day date, ratio double")
    r = spark.createDataFrame([(1, D(2020, 1, 1), 100.0, 10.0), (1, D(2020, 7, 1), 200.0, 5.0)], "entity long, shares_day date, shares double, price double")
    before = asof.market_cap(r.where("price = 10"), sp, "2020-05-01", F.lit("raw"))
    after = asof.market_cap(r.where("price = 10").withColumn("price", F.lit(5.0)), sp, "2020-08-01", F.lit("raw"))
    assert rows(before.select("market_cap")) == rows(after.select("market_cap")) == [(1000.0,)]


def test_linkage_joins_close_assets(spark):
    rho = [(1, "1", "2", 0.95), (1, "1", "3", 0.1), (1, "2", "3", 0.05)]
    df = spark.createDataFrame([(p, int(a), int(b), r) for p, a, b, r in rho], "portfolio long, a long, b long, rho double")
    assert sorted(rows(series.linkage_clusters(df, 0.7))) == [(1, 1, 1), (1, 2, 1), (1, 3, 3)]


def test_first_sentence(spark):
    texts = ["Acme Inc. sells tools. It grows.", "No end here", "By J. Smith Corp. and others! Next one.", "Up 3.5 percent. Then down.", "lower. case follows. But Caps end."]
    end = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")

    def want(text):
        start = 0
        while True:
            m = end.search(text, start)
            if m is None:
                return text
            head = text[:m.start()]
            tail = head[:-1].rsplit(" ", 1)[-1].rstrip(".") if head.endswith(".") else ""
            if tail in labels.ABBREVIATIONS or (len(tail) == 1 and tail.isupper()):
                start = m.end()
                continue
            return head
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows(df.select(labels.first_sentence(F.col("t"))))] == [want(t) for t in texts]


def test_name_key_and_derivatives(spark):
    df = spark.createDataFrame([("Foo Holdings Inc. - ADR",), ("The",), ("Bar (Class A) Corp B",), ("Baz Common Units",), ("Baz Units",)], "n string")
    got = rows(df.select(names.name_key(F.col("n")), names.is_derivative_line(F.col("n"))))
    assert got == [("foo", False), ("the", False), ("bar", False), ("baz common units", False), ("baz units", True)]


def test_drawdown_and_recovery(spark):
    pts = [("a", D(2020, 1, i), v) for i, v in ((1, 100.0), (2, 40.0), (3, 100.0), (4, 90.0))] + [("b", D(2020, 1, i), v) for i, v in ((1, 10.0), (2, 5.0), (3, 9.0))]
    df = spark.createDataFrame(pts, "symbol string, day date, level double")
    got = {r[0]: r[1:] for r in rows(series.drawdown(df, "level").select("symbol", "drawdown", "peak_day", "trough_day", "recovered"))}
    assert got["a"] == (-0.6, D(2020, 1, 1), D(2020, 1, 2), True) and got["b"] == (-0.5, D(2020, 1, 1), D(2020, 1, 2), False)
