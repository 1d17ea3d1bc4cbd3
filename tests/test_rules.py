"""Labels from rules: roles, order, gaps, and the same answer as a loop over dictionaries."""

import datetime as dt
import random

import pytest

from lodestat.functions import concepts as C
from lodestat.operators import rules
from lodestat.operators.rules import piece
from lodestat.plans import chain

D = dt.date
SCHEMA = "entity long, tag string, end_day date, value double"
DAY = D(2001, 3, 31)


def loop(cell: dict, rule) -> float | None:
    """Reference answer for one key's {name: value}."""
    for alt in rules.alternatives(rule):
        found = [(p, next((cell[n] for n in p.names if cell.get(n) is not None), None)) for p in alt]
        present = [(p, v) for p, v in found if v is not None]
        if not present or any(v is None for p, v in found if p.role == "all"):
            continue
        if any(p.role == "any" for p in alt) and not any(p.role == "any" for p, _ in present):
            continue
        return sum(p.sign * v for p, v in present)
    return None


def got(spark, cells, table):
    rows = [(e, n, DAY, v) for e, cell in cells.items() for n, v in cell.items()]
    return {(r.entity, r.label): r for r in rules.resolve(spark.createDataFrame(rows, SCHEMA), table).collect()}


def test_debt_needs_a_long_term_piece(spark):
    cells = {1: {"LongTermDebt": 10.0, "DebtCurrent": 3.0}, 2: {"LongTermDebtNoncurrent": 5.0, "ShortTermBorrowings": 2.0}, 3: {"DebtCurrent": 4.0},
             4: {"ShortTermBorrowings": 9.0}, 5: {"LongTermDebt": None, "LongTermDebtCurrent": 1.0}, 6: {"LongTermDebt": 0.0, "DebtCurrent": 3.0}}
    out = got(spark, cells, {"debt": C.POINTS["debt"]})
    assert {e: r.value for (e, _), r in out.items()} == {1: 10.0, 2: 7.0, 3: 4.0, 5: 1.0, 6: 0.0}
    assert (out[2, "debt"].alt, out[2, "debt"].names) == (1, ["LongTermDebtNoncurrent", "ShortTermBorrowings"])


def test_signs_and_required_pieces(spark):
    incl, equity = C.EQUITY_INCL_NCI[0], C.EQUITY[0]
    out = got(spark, {1: {incl: 12.0, equity: 10.0}, 2: {incl: 12.0}, 3: {equity: 10.0}}, {"nci": C.POINTS["nci"]})
    assert {e: r.value for (e, _), r in out.items()} == {1: 2.0}


def test_added_rows_and_extras(spark):
    a, b = C.CREDIT_LOSS_ROWS[0], C.CREDIT_LOSS_ROWS[3]
    cells = {1: {a: 1.0, b: 2.0}, 2: {b: 2.0}, 3: {"Deferred Revenue": 5.0, "Non Current Deferred Revenue": 1.0}, 4: {"Current Deferred Revenue": 2.0, "Non Current Deferred Revenue": 1.0}, 5: {}}
    out = got(spark, cells, {**C.CREDIT_LOSS, **C.DEFERRED})
    assert {k: r.value for k, r in out.items()} == {(1, "credit_loss"): 3.0, (2, "credit_loss"): 2.0, (3, "deferred"): 5.0, (4, "deferred"): 3.0}


def test_random_cells_equal_the_loop(spark):
    rng = random.Random(3)
    table = {**C.ROWS, **C.CREDIT_LOSS, **C.DEFERRED, **C.POINTS}
    cells = {e: {n: rng.choice([None, float(rng.randint(-50, 50))]) for n in rules.names(table) if rng.random() < 0.5} for e in range(60)}
    out = {k: r.value for k, r in got(spark, cells, table).items()}
    want = {(e, label): loop(cell, rule) for e, cell in cells.items() for label, rule in table.items()}
    assert out == {k: v for k, v in want.items() if v is not None}


def test_values_are_exchanged_once(spark):
    plan = rules.resolve(spark.createDataFrame([(1, "Assets", DAY, 1.0)], SCHEMA), C.POINTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_labels_need_no_sort(spark):
    """A key's values are gathered by one hash aggregate; sorts per piece, alternative and label held several buffers in a task."""
    plan = rules.resolve(spark.createDataFrame([(1, "Assets", DAY, 1.0)], SCHEMA), C.POINTS)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "ObjectHashAggregate" not in plan and "Join" not in plan


def test_no_rows(spark):
    assert rules.resolve(spark.createDataFrame([], SCHEMA), C.POINTS).count() == 0


def test_piece_refuses_an_unknown_role():
    with pytest.raises(ValueError):
        piece("Assets", role="some")


def test_parts_count_only_over_the_same_span(spark):
    """Depreciation and amortization meet span by span, before quarters are derived from cumulative spans."""
    def span(tag, start, end, value):
        return (1, tag, start, end, D(2001, 12, 31), "10-Q", value, 0)
    dep, amort = C.DEPRECIATION_PARTS
    q1, h1, year = (D(2001, 1, 1), D(2001, 3, 31)), (D(2001, 1, 1), D(2001, 6, 30)), (D(2000, 1, 1), D(2000, 12, 31))
    rows = [span(dep, *q1, 4.0), span(amort, *q1, 1.0), span(dep, *h1, 9.0), span(amort, *h1, 3.0), span(dep, *year, 20.0),
            span(amort, D(2000, 1, 5), year[1], 5.0)]
    facts = spark.createDataFrame(rows, "entity long, tag string, start_day date, end_day date, filed date, form string, value double, seq long")
    st = chain.statements_at(facts, "2001-12-31", {"da": C.FLOWS["da"]}, {"cash": C.CASH}, C.SPANS)
    assert {(r.scope, r.period_end, r.da) for r in st.collect()} == {("quarterly", q1[1], 5.0), ("quarterly", h1[1], 7.0)}


def test_units_are_never_mixed(spark):
    """A tag in two units counts in dollars; one whose dollars come later counts in what it had at the date; other namespaces do not count."""
    q1, h1 = (D(2001, 1, 1), D(2001, 3, 31)), (D(2001, 1, 1), D(2001, 6, 30))
    early, late = D(2001, 8, 1), D(2002, 8, 1)
    rows = [(1, "us-gaap", "Revenues", unit, *span, early, "10-Q", v * rate, 0) for unit, rate in (("USD", 1.0), ("EUR", 0.9)) for span, v in ((q1, 10.0), (h1, 30.0))]
    rows += [(2, "us-gaap", "Revenues", "EUR", *q1, early, "10-Q", 7.0, 0), (2, "us-gaap", "Revenues", "USD", *q1, late, "10-Q", 8.0, 0), (1, "dei", "Revenues", "USD", *q1, late, "10-Q", 99.0, 1)]
    facts = spark.createDataFrame(rows, "entity long, namespace string, tag string, unit string, start_day date, end_day date, filed date, form string, value double, seq long")

    def at(day):
        return {(r.entity, r.period_end): r.revenue for r in chain.statements_at(facts, day, {"revenue": C.REVENUE}, {"cash": C.CASH}).collect()}

    assert at("2001-12-31") == {(1, q1[1]): 10.0, (1, h1[1]): 20.0, (2, q1[1]): 7.0}
    assert at("2002-12-31") == {(1, q1[1]): 10.0, (1, h1[1]): 20.0, (2, q1[1]): 8.0}
