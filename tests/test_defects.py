"""Facts that must not be lost, leaked or merged, on tiny tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestat.functions import labels
from lodestat.operators import asof, cohorts, pit, portfolio, ranks
from lodestat.operators import statements as S
from lodestat.plans import bundle
from lodestat.sources import files

D = dt.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_facts_before_the_first_tick_and_in_quarters_without_one(spark):
    facts = spark.createDataFrame([(1, D(1990, 12, 31), D(1991, 1, 5), 7.0, 1), (2, D(1995, 6, 30), D(1995, 8, 1), 8.0, 2), (3, D(1999, 1, 1), D(1999, 1, 2), 9.0, 3)],
                                  "entity int, end_day date, filed date, value double, seq int")
    ticks = spark.createDataFrame([(D(1995, 3, 31),), (D(1995, 12, 29),)], "tick date")
    want = []
    for t in (D(1995, 3, 31), D(1995, 12, 29)):
        want += [(t, e, d, v) for e, d, f, v, _ in rows(facts) if f <= t]
    assert sorted(rows(bundle.newest_at_ticks(facts, ticks))) == sorted(want)


def filing(spark, values, tag="SalesA", plabel="x", pre_rows=None):
    sub = spark.createDataFrame([("a", "7", "20010101", "10-K", "20001231"), ("b", "8", "20010101", "10-K", "20001231")], "adsh string, cik string, filed string, form string, period string")
    pre = spark.createDataFrame(pre_rows or [("a", "1", "1", tag, "v", "IS", plabel)], "adsh string, report string, line string, tag string, version string, stmt string, plabel string")
    num = spark.createDataFrame([("a", tag, "v", "20001231", "4", "USD", None, None, v) for v in values],
                                "adsh string, tag string, version string, ddate string, qtrs string, uom string, segments string, coreg string, value string")
    known = spark.createDataFrame([("SalesA", ["Total Revenue"])], "tag string, labels array<string>")
    captions = spark.createDataFrame([("net sales", ["Total Revenue"])], "caption string, labels array<string>")
    ciks = spark.createDataFrame([("0000000007",)], "cik string")
    return files.filing_statements(sub, pre, num, known, ciks, "s", captions)


def test_values_below_a_cent_and_very_large_ones_stay(spark):
    got = filing(spark, ["0.123", "0.121", "0.121", "123456789012345678"])
    assert sorted(r["value"] for r in got.collect()) == [0.121, 0.123, 123456789012345678.0]
    assert {(r["cik"], r["report_period"]) for r in got.collect()} == {("0000000007", D(2000, 12, 31))}


def test_custom_tags_are_known_by_their_caption(spark):
    assert [r["label"] for r in filing(spark, ["5"], "OwnTag", "Net  Sales:").collect()] == ["Total Revenue"]
    assert filing(spark, ["5"], "OwnTag", "something").count() == 0


def test_the_last_presentation_row_wins(spark):
    pre = [("a", "2", "9", "SalesA", "v", "IS", ""), ("a", "10", "1", "SalesA", "v", "BS", "")]
    assert [r["stmt"] for r in filing(spark, ["5"], pre_rows=pre).collect()] == ["BS"]


def test_history_keeps_points_of_annual_forms_long_spans_and_share_counts(spark):
    old = D(1990, 12, 31)
    data = [("e", "t", None, old, D(1991, 2, 1), "10-K405", 1.0), ("e", "u", None, old, D(1991, 2, 1), "10-Q", 2.0), ("e", "v", D(1988, 1, 1), old, D(1991, 2, 1), "10-Q", 3.0),
            ("e", "w", D(1990, 10, 1), old, D(1991, 2, 1), "10-Q", 4.0), ("e", pit.SHARES_TAG, None, old, D(1991, 2, 1), "10-Q", 5.0), ("e", pit.SHARES_TAG, None, old, D(1992, 2, 1), "10-Q", 6.0),
            ("e", "t", None, old, D(1992, 2, 1), "8-K", 7.0), ("e", "u", None, D(1996, 1, 1), D(1996, 2, 1), "10-Q", 8.0)]
    df = spark.createDataFrame(data, "entity string, tag string, start_day date, end_day date, filed date, form string, value double")
    assert sorted(r["value"] for r in pit.prune_history(df, "2001-12-31").collect()) == [3.0, 5.0, 6.0, 7.0, 8.0]


def test_splits_after_the_day_are_unknown(spark):
    obs = spark.createDataFrame([(1, D(2000, 1, 1), 100.0)], "entity int, end_day date, value double")
    splits = spark.createDataFrame([(1, D(2000, 6, 1), 3.0), (1, D(2005, 1, 1), 2.0)], "symbol int, day date, ratio double")
    assert [r["value"] for r in asof.restate(obs, splits, until="2001-01-01").collect()] == [300.0]
    assert [r["value"] for r in asof.restate(obs, splits).collect()] == [600.0]


def test_pretax_and_caption_labels(spark):
    tag = "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest"
    df = spark.createDataFrame([(tag, ""), ("OperatingIncomeLoss", ""), ("Own", "Net sales"), ("Own", "none")], "tag string, caption string")
    assert [r[0] for r in df.select(labels.canonical_labels(F.col("tag"), F.col("caption"))).collect()] == [["Pretax Income"], ["EBIT", "Operating Income"], ["Total Revenue"], None]


def test_a_quarter_with_a_balance_alone_is_no_trailing_quarter(spark):
    from lodestat import relations as R
    columns = [f for f in R.statements(spark, "/root/testdata/sf0.001").schema.fields]
    flows = {*S.INCOME, *S.CASH}

    def row(day, filled):
        out = {}
        for f in columns:
            out[f.name] = 10.0 if f.dataType.simpleString() == "double" and (filled or f.name not in flows | {"da", "credit_loss"}) else None
        return {**out, "entity": 1, "scope": "quarterly", "period_end": day}
    days = [D(2000, 3, 31), D(2000, 6, 30), D(2000, 9, 30), D(2000, 12, 31)]
    from pyspark.sql.types import StructType
    df = spark.createDataFrame([row(d, True) for d in days] + [row(D(2001, 3, 31), False)], StructType(columns))
    got = S.ttm(df).collect()
    assert [(r["basis"], r["through"], r["revenue"]) for r in got] == [("quarterly", D(2000, 12, 31), 40.0)]


@pytest.mark.parametrize("text", [True, False])
def test_ties_by_text_keys(spark, text):
    rng = random.Random(4)
    keys = [("".join(rng.choice("abé中") for _ in range(rng.randint(0, 9))) + str(i)) if text else i for i in range(400)]
    data = [("hot" if i % 5 else "cold", float(i % 3) if i % 7 else float(i), k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, f"g string, x double, k {'string' if text else 'long'}")
    got = {k: r for k, r in rows(cohorts.rank_order(df, ["g"], "x", "k").select("k", "rank"))}
    for g in ("hot", "cold"):
        order = sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2].encode() if text else d[2]))
        assert all(got[k] == n + 1 for n, (_, _, k) in enumerate(order))
    if text:
        one = rows(ranks.text_ranks(df.withColumn("h", F.lit(1)), ["h"], "k").select("k", "n_lt"))
        assert sorted(one, key=lambda r: r[1]) == [(k, n) for n, k in enumerate(sorted(keys, key=str.encode))]


def test_rates_of_the_day(spark):
    pos = spark.createDataFrame([("USD", D(2000, 1, 3), 10.0)] * 3 + [("EUR", D(2000, 1, 3), 5.0), ("GBP", D(1999, 1, 1), 5.0), ("USD", D(2000, 2, 3), 1.0)], "currency string, as_of date, mv double")
    rates = spark.createDataFrame([("USD", D(2000, 1, 1), 2.0), ("USD", D(2000, 2, 1), 0.0), ("GBP", D(2000, 1, 1), 3.0)], "currency string, day date, close double")
    got = sorted((r["currency"], r["eur"], r["fx_state"]) for r in portfolio.to_eur(pos, rates).collect() if r["eur"] is not None)
    assert got == [("EUR", 5.0, "ok")] + [("USD", 20.0, "ok")] * 3
    assert portfolio.to_eur(pos, rates).where("fx_state = 'refused'").count() == 2


def test_no_local_folder_on_a_cluster():
    from lodestat import session

    class Undefined:
        @staticmethod
        def isDefined():
            return False

    class Scala:
        @staticmethod
        def getCheckpointDir():
            return Undefined

    class Java:
        @staticmethod
        def sc():
            return Scala

    class Context:
        master, applicationId, _jsc = "spark://host:7077", "x", Java

    class Session:
        class conf:
            @staticmethod
            def get(*_):
                return None
        sparkContext = Context
    with pytest.raises(RuntimeError):
        session.shared_dir(Session, "x")
