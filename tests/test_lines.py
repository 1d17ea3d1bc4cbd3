"""Line numbers of files read in several splits, and the refused rows of a broker export."""

import pytest

from lodestat.sources import files, lines

HEADER = "symbol,instrument_type,quantity,avg_open_price,native_currency,market_value_native,market_value_eur,leverage"


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_numbers_over_splits(spark, small_splits, tmp_path):
    want = {}
    for name, n in (("a.csv", 700), ("b.csv", 3), ("c.csv", 1), ("d.csv", 0)):
        text = [f"{name} row {i}" + "x" * (i * 7 % 90) for i in range(n)]
        (tmp_path / name).write_text("".join(t + ("\n\n" if i % 5 == 0 else "\n") for i, t in enumerate(text)))
        want |= {(name, i): (t, text[0]) for i, t in enumerate(text)}
    assert spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 20
    got = {(r.file.rsplit("/", 1)[1], r.line): (r.value, r.first) for r in lines.numbered(spark, str(tmp_path)).collect()}
    assert got == want


def test_refused_rows_tell_file_line_and_reason(spark, small_splits, tmp_path):
    good = [f"S{i},stock,{i}.5,1.0,USD,10.0,10.0," for i in range(1, 60)]
    rows = list(good)
    rows[4] = "S5,stock,many,1.0,USD,10.0,10.0,1"
    rows[20] = "S21,stock,1,1.0,USD,10.0"
    rows[30] = "S31,stock,1,?,USD,10.0,10.0,1"
    rows[40] = "S41,stock,1,,USD,10.0,NaN,1"
    rows[50] = 'CASH,cash,,,EUR,,25.0,'
    rows[55] = '"S, 56",stock,1,,USD,10.0,10.0,x'
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *rows]) + "\n")
    (tmp_path / "b.csv").write_text(HEADER.replace("quantity", "units") + "\nS1,stock,1,1,USD,1,1,1\n")
    positions, refused = files.broker_export(spark, str(tmp_path))
    got = {(r.file.rsplit("/", 1)[1], r.line): (r.symbol, r.reason) for r in refused.collect()}
    assert got == {("a.csv", 5): ("S5", "malformed number in quantity"), ("a.csv", 21): ("S21", "column count"), ("a.csv", 31): ("S31", "malformed number in avg_open_price"),
                   ("a.csv", 41): ("S41", "malformed number in market_value_eur"), ("a.csv", 56): ("S, 56", "malformed number in leverage"), ("b.csv", 1): ("S1", "other header")}
    kept = positions.collect()
    assert len(kept) == 59 - 6 and abs(sum(r.weight for r in kept) - 1) < 1e-9 and all(r.leverage == 1.0 for r in kept)


def test_a_missing_column_refuses_every_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,instrument_type,quantity\nS1,stock,1\nS2,stock,2\n")
    positions, refused = files.broker_export(spark, str(tmp_path))
    assert positions.count() == 0 and [(r.line, r.reason) for r in refused.orderBy("line").collect()] == [(1, "no column market_value_eur"), (2, "no column market_value_eur")]


def test_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    positions, refused = files.broker_export(spark, str(tmp_path))
    assert positions.count() == 0 and refused.count() == 0
