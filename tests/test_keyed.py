"""Keyed streaming state: late rows on the side, state that goes, several batches equal to one pass."""

import datetime as dt
import random

import pytest

from lodestat.streaming import keyed

T0 = dt.datetime(2020, 1, 1)
OUT = "entity long, day string, at long, seq long, value double, late boolean"
BEAT = "2022-01-01"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "entity long, day string, ts timestamp, seq long, value double, arrived timestamp")


def filing(entity, day, after, seq, value, delay=0):
    ts = T0 + dt.timedelta(days=day + after)
    return entity, str((T0 + dt.timedelta(days=day)).date()), ts, seq, value, ts + dt.timedelta(days=delay)


def test_late_rows_go_to_the_side_and_state_goes(spark):
    rng = random.Random(3)
    rows = [filing(e, 10 * p, rng.choice([1, 5, 20]), 100 * e + p, rng.random()) for e in range(5) for p in range(30)]
    late = filing(1, 0, 3, 9001, 77.0, delay=200)          # newest of its period by nothing, and 200 days on its way
    again = filing(2, 150, 25, 9002, 88.0)                 # a restatement in time
    counts = []
    cuts = ["2020-03-01", "2020-05-01", "2020-07-01"]
    out = keyed.run(keyed.by_arrival(rows_of(spark, [*rows, late, again]), cuts, BEAT), ["entity", "day"], lambda: keyed.Latest(30, at_end=True), OUT, progress=counts)
    got = [r for r in out.collect() if r["entity"] >= 0]
    assert [(r["entity"], r["value"]) for r in got if r["late"]] == [(1, 77.0)]
    want = {}
    for e, day, ts, seq, value, _ in [*rows, again]:
        want[e, day] = max(want.get((e, day), (T0, -1, 0.0)), (ts, seq, value))
    closed = {(r["entity"], r["day"]): r["value"] for r in got if not r["late"]}
    assert closed == {k: v[2] for k, v in want.items()} and len(got) == len(closed) + 1
    # periods close 31 days after they end: no more than about two months of them are held, though ten months go by
    assert max(counts) <= 5 * 8 and counts[-1] <= 1


def test_updates_before_the_end(spark):
    rows = [filing(1, 0, 1, 1, 1.0), filing(1, 0, 70, 2, 2.0), filing(1, 0, 2, 3, 3.0, delay=75)]
    out = keyed.run(keyed.by_arrival(rows_of(spark, rows), ["2020-02-01", "2020-03-15"], BEAT), ["entity", "day"], lambda: keyed.Latest(300, at_end=False), OUT)
    assert sorted(r["value"] for r in out.collect() if r["entity"] >= 0) == [1.0, 2.0]      # the third is older than what is known


@pytest.mark.parametrize("cuts", [[], ["2020-01-05"], ["2020-01-03", "2020-01-05", "2020-01-09"]])
def test_batches_do_not_change_results(spark, cuts):
    rng = random.Random(5)
    rows = [(k, T0 + dt.timedelta(hours=6 * i), 10 * i + k, rng.choice(["a", "b"]), str((T0 + dt.timedelta(hours=6 * i)).date()), rng.random() < 0.7) for i in range(50) for k in (1, 2)]
    df = spark.createDataFrame([(*r, r[1]) for r in rows], "ticker long, ts timestamp, seq long, fingerprint string, day string, hit boolean, arrived timestamp")
    slices = keyed.by_arrival(df, cuts, BEAT)
    got = keyed.run(slices, ["ticker"], lambda: keyed.Changes(90), "ticker long, seq long, previous string, current string")
    want = []
    for k in (1, 2):
        own = [r for r in rows if r[0] == k]
        want += [(k, b[2], a[3], b[3]) for a, b in zip(own[:-1], own[1:], strict=True) if a[3] != b[3]]
    assert sorted(tuple(r) for r in got.collect() if r["ticker"] >= 0) == sorted(want)


def test_idle_keys_are_forgotten(spark):
    at = lambda day: T0 + dt.timedelta(days=day)
    rows = [(1, at(0), 1, "a"), (1, at(1), 2, "b"), (2, at(60), 3, "x"), (1, at(200), 4, "c"), (1, at(201), 5, "d")]
    df = spark.createDataFrame([(*r, r[1]) for r in rows], "ticker long, ts timestamp, seq long, fingerprint string, arrived timestamp")
    counts = []
    out = keyed.run(keyed.by_arrival(df, ["2020-02-01", "2020-05-01"], BEAT), ["ticker"], lambda: keyed.Changes(30), "ticker long, seq long, previous string, current string", progress=counts)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, "a", "b"), (1, 5, "c", "d")]      # "c" is a baseline again
    assert counts[1] == 1


def test_state_is_held_by_bucket(spark):
    """Keys share a few state values, each read and written once a batch; results are those of single keys."""
    rows = [filing(e, 10 * p, 1 + p, 100 * e + p, float(e + p)) for e in range(60) for p in range(3)] + [(None, "2020-01-01", T0, 7, 0.5, T0)]
    counts = []
    out = keyed.run(keyed.by_arrival(rows_of(spark, rows), ["2020-01-11"], BEAT), ["entity", "day"], lambda: keyed.Latest(30, at_end=True), OUT, progress=counts, buckets=3)
    got = {(r["entity"], r["day"]): (r["value"], r["late"]) for r in out.collect()}
    assert got == {(e, day): (value, False) for e, day, _, _, value, _ in rows} and max(counts) <= 3


def test_setting_comes_back(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    with keyed.state_store(spark):
        assert spark.conf.get(keyed.PROVIDER) == keyed.ROCKSDB
    assert spark.conf.get(keyed.PROVIDER, None) == before
