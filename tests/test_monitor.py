"""Re-tests driven by change: only theses with other inputs are tested, and the reports equal those of a full run."""

from pyspark.sql import functions as F

from lodestat.operators import monitor

RESULT = "entity long, pos int, id string, kind string, action string, value double, checked boolean, tripped boolean, streak long, needed int, confidence string"


def trigger(entity, pos, value, kind="metric", action="break", confidence=None, needed=1):
    checked = value is not None
    return (entity, pos, f"T{pos}", kind, action, value, checked, bool(checked and value > 10), 1 if checked else None, needed, confidence)


FIRST = [trigger(1, 1, 5.0), trigger(1, 2, 20.0, action="review"), trigger(2, 1, 1.0), trigger(3, 1, 30.0), trigger(4, 1, 2.0), trigger(4, 2, 50.0, kind="event", confidence="low"),
         trigger(5, 1, None)]


def world(spark, rows, entities=(1, 2, 3, 4, 5, 6)):
    results = spark.createDataFrame(rows, RESULT)
    theses = spark.createDataFrame([(e, "committed") for e in entities], "entity long, status string")
    tested = []

    def evaluate(keys):
        tested.extend(r.entity for r in keys.collect())
        return results.join(keys, "entity", "left_semi")

    return theses, monitor.fingerprints(results.drop("checked", "tripped", "streak")), evaluate, tested


def table(df):
    return sorted((repr(r) for r in df.select(*monitor.REPORT).collect()))


def test_reports(spark):
    theses, prints, evaluate, _ = world(spark, FIRST)
    got = {r.entity: r for r in monitor.run(theses, prints, evaluate).collect()}
    assert {e: r.status for e, r in got.items()} == {1: "under_review", 2: "intact", 3: "broken", 4: "under_review", 5: "intact", 6: "error"}
    assert (got[4].review_by, got[5].unchecked, got[6].unchecked) == (["T2"], ["T1"], [monitor.WHOLE])
    assert [t.id for t in got[1].triggers] == ["T1", "T2"] and [t.mark for t in got[1].triggers] == ["ok", "review"]
    assert got[4].triggers[1].reason == "tripped (low confidence), asks for review" and got[5].triggers[0].reason == "no value"


def test_only_changed_theses_are_tested(spark):
    theses, prints, evaluate, _ = world(spark, FIRST)
    first = monitor.run(theses, prints, evaluate).cache()
    second = [trigger(2, 1, 90.0) if r[0] == 2 else r for r in FIRST]
    theses, prints, evaluate, tested = world(spark, second)
    out = monitor.run(theses, prints, evaluate, first)
    assert {r.entity for r in out.where("retested").collect()} == {2} and tested == [2]
    full = monitor.run(*world(spark, second)[:3])
    assert table(out) == table(full)


def test_broken_stays_broken_and_theses_come_and_go(spark):
    theses, prints, evaluate, _ = world(spark, FIRST)
    first = monitor.run(theses, prints, evaluate).cache()
    second = [trigger(3, 1, 0.0) if r[0] == 3 else r for r in FIRST if r[0] != 2] + [trigger(7, 1, 3.0)]
    theses, prints, evaluate, tested = world(spark, second, entities=(1, 3, 4, 5, 6, 7))
    got = {r.entity: r for r in monitor.run(theses, prints, evaluate, first).collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7} and sorted(tested) == [3, 7]
    assert got[3].status == "broken" and got[3].broken_by == [] and got[7].status == "intact"


def test_fingerprints_see_rows_not_their_order(spark):
    def prints(rows, *more):
        return {r.entity: r.fingerprint for r in monitor.fingerprints(*[spark.createDataFrame(x, "entity long, a string, b string") for x in (rows, *more)]).collect()}
    a = prints([(1, "x", None), (1, "y", "z"), (2, "x", None)])
    assert a == prints([(2, "x", None), (1, "y", "z"), (1, "x", None)])
    assert a[2] != prints([(2, None, "x")])[2] and a[2] != prints([(2, "x", None), (2, "x", None)])[2]
    assert prints([(2, "x", None)], [(2, "p", "q")]) != prints([(2, "p", "q")], [(2, "x", None)])


def test_no_theses(spark):
    theses, prints, evaluate, _ = world(spark, FIRST, entities=(9,))
    assert monitor.run(theses.where(F.lit(False)), prints, evaluate).count() == 0
