"""Ids made of content, and ancestors by doubling against a walk."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestat.catalog.c_lineage import metric_ancestors
from lodestat.operators import lineage as L

D = dt.date

CELLS = [(1, "ocf", 5.0), (1, "capex", 2.0), (1, "sbc", None), (2, "ocf", 5.0), (3, "ocf", 1.5), (3, "capex", 1.0)]


def built(spark, cells, version=1):
    src = L.sources(spark.createDataFrame(cells, "entity long, key string, value double"), ["entity"])
    low = L.metrics(src, "owner", ["entity"], version, needed=("ocf", "capex"))
    return {r.entity: r for r in low.collect()}, {r.entity: r.id for r in L.metrics(low.drop("inputs"), "yield", ["entity"]).collect()}


def test_ids_follow_content_alone(spark):
    low, top = built(spark, CELLS)
    assert set(low) == {1, 3} and len(low[1].inputs) == 2          # 2 lacks a needed input; NULL is none
    again = built(spark, CELLS[::-1] + [CELLS[0]])
    assert {e: r.id for e, r in again[0].items()} == {e: r.id for e, r in low.items()} and again[1] == top
    changed = built(spark, [(1, "ocf", 5.00001), *CELLS[1:]])
    assert changed[1][1] != top[1] and changed[1][3] == top[3]     # a far input changes the id, others keep theirs
    assert built(spark, CELLS, version=2)[1][1] != top[1]


def test_ancestors_equal_a_walk(spark):
    rng = random.Random(5)
    links = {(str(i), str(j)) for i in range(1, 60) for j in rng.sample(range(i), min(i, rng.randint(0, 2)))}
    links |= {(f"c{i}", f"c{i + 1}") for i in range(20)} | {("c20", "0")}
    up = {}
    for a, b in links:
        up.setdefault(a, set()).add(b)

    def walk(x):
        seen, todo = set(), [x]
        while todo:
            for y in up.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    got = {(r.id, r.ancestor) for r in L.ancestors(spark.createDataFrame(sorted(links), "id string, input_id string")).collect()}
    assert got == {(a, b) for a in up for b in walk(a)}


def test_no_links_and_cycles(spark):
    schema = "id string, input_id string"
    assert L.ancestors(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        L.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], schema)).select(F.count("*")).collect()


def test_every_path_is_written_once(spark, monkeypatch):
    written, stage = [], L.stage

    def counted(df, purpose):
        out = stage(df, purpose)
        written.append(out.count())
        return out

    monkeypatch.setattr(L, "stage", counted)
    chain = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(20)], "id string, input_id string")
    assert L.ancestors(chain).count() == 210 == sum(written)


def test_ancestors_within_groups_equal_rounds(spark):
    rng = random.Random(6)
    nodes = [(e, f"{e or 0}.{i}", [f"{e or 0}.{j}" for j in rng.sample(range(i), min(i, rng.randint(0, 3)))]) for e in (1, 2, None) for i in range(30)]
    nodes = [n for n in nodes if n[2]] + [(2, "2.40", ["2.29", "2.29", "x"])]
    df = spark.createDataFrame(nodes, "entity long, id string, inputs array<string>").withColumn("key", F.lit("mine"))
    rounds = {}
    for r in L.ancestors(L.edges(df)).collect():
        rounds.setdefault(r.id, set()).add(r.ancestor)
    got = L.ancestors(df, within=("entity",))
    assert got.columns == ["entity", "id", "key", "ancestors", "sources"]
    rows = got.collect()
    assert {r.id: set(r.ancestors) for r in rows} == rounds and len(rows) == len(nodes) and all(len(set(r.ancestors)) == len(r.ancestors) for r in rows)
    assert all(r.sources == len(rounds[r.id] - rounds.keys()) for r in rows)
    assert L.ancestors(df.where("false"), within=("entity",)).count() == 0
    for loop in ([(1, "a", ["b"]), (1, "b", ["c"]), (1, "c", ["a"])], [(1, "a", ["a"])]):
        with pytest.raises(Exception, match="cycle"):
            L.ancestors(spark.createDataFrame(loop, "entity long, id string, inputs array<string>"), within=("entity",)).collect()


def test_ids_are_exchanged_once(spark, tmp_path):
    """Cells are dealt out as numbers and nodes once, by entity; no path and no other id is exchanged."""
    lines = [(1, i % 3, 1, D(1995, 1 + i % 12, 9), 100.0 + i, "R" if i % 2 else "A", "F", 0.01 * (i % 9), 0.05, 5.0) for i in range(200)]
    kind = "l_orderkey long, l_suppkey long, l_linenumber int, l_shipdate date, l_extendedprice double, l_returnflag string, l_linestatus string, l_tax double, l_discount double, l_quantity double"
    spark.createDataFrame(lines, kind).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = metric_ancestors(spark, str(tmp_path))
    assert found.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.search(r"Exchange hashpartitioning\((id|ancestor|_in|input_id)", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(entity#\w+, period_end#\w+, \d+\)", plan)) <= 1


def test_numbers_stand_for_ids(spark):
    ids = spark.createDataFrame([("0a" * 32,), ("ff" * 32,), ("0a" * 32,)], "id string")
    rows = L.numbered(ids).collect()
    assert {bytes(r.id).hex() for r in rows} == {"0a" * 32, "ff" * 32} and len({r.no for r in rows}) == 2
