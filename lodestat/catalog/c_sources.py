"""Scans, sources and sinks. File formats are written from whole tables into the
shared folder first, then read back by the library's readers."""

from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog.registry import query, rnd, txt
from lodestat.session import shared_dir
from lodestat.sources import files


def _csv(spark, df, name, **opts):
    path = shared_dir(spark, name)
    df.write.options(header=True, **opts).csv(path)
    return path


def _fact_file(spark, d):
    f = R.facts(spark, d)
    return _csv(spark, f.select(
        F.col("entity").cast("string").alias("symbol"), F.when(F.col("seq") % 2 == 0, "dei").alias("namespace"),
        F.when(F.col("seq") % 37 != 0, F.col("tag")).alias("tag"), F.lit("note, with comma").alias("label"),
        F.when(F.col("seq") % 7 == 0, "EUR").alias("unit"), F.when(F.col("seq") % 3 != 0, F.col("start_day")).alias("start"),
        F.col("end_day").alias("end"), "filed", "form",
        F.when(F.col("seq") % 50 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.col("seq").alias("fy")), "facts")


FACT_FILE = f"""WITH {R.SQL_FACTS}, ff AS (SELECT CAST(entity AS VARCHAR) AS symbol,
  CASE WHEN seq % 2 = 0 THEN 'dei' ELSE 'us-gaap' END AS namespace, tag, CASE WHEN seq % 7 = 0 THEN 'EUR' ELSE 'USD' END AS unit,
  CASE WHEN seq % 3 <> 0 THEN start_day END AS start_day, end_day, filed, form, value, seq
  FROM facts WHERE seq % 37 <> 0 AND seq % 50 <> 0)"""


@query("scan_fact_csv", f"""{FACT_FILE} SELECT symbol, namespace, tag, unit, {txt('start_day')}, {txt('end_day')},
  {txt('filed')}, form, value FROM ff""")
def scan_fact_csv(spark, d):
    return files.fact_csv(spark, _fact_file(spark, d))


@query("distinct_symbols", f"WITH {R.SQL_FACTS} SELECT CAST(entity AS VARCHAR) AS symbol, min(seq) AS first_row FROM facts GROUP BY entity")
def distinct_symbols(spark, d):
    """Distinct symbols in file order: only two columns of the file are read."""
    raw = files.read_table(spark, _fact_file(spark, d), ("symbol", "fy"))
    return raw.groupBy("symbol").agg(F.min(F.col("fy").cast("bigint")).alias("first_row")).orderBy("first_row")


@query("scan_price_csv_alias", f"""WITH {R.SQL_BARS} SELECT CAST(symbol AS VARCHAR) AS symbol, {txt('day')}, round(close, 9) AS close,
  CASE WHEN symbol % 9 <> 0 THEN round(adj_close, 9) END AS adj_close FROM bars WHERE symbol % 13 <> 0""", digits=9)
def scan_price_csv_alias(spark, d):
    b = R.bars(spark, d)
    path = _csv(spark, b.select(
        F.col("symbol").alias("Ticker"), F.when(F.col("symbol") % 13 == 0, "someday").when(
            F.col("symbol") % 2 == 0, F.date_format("day", "MM/dd/yyyy")).otherwise(F.col("day").cast("string")).alias("Week Ending"),
        F.col("close").alias("Raw Close"), F.when(F.col("symbol") % 9 == 0, "-").otherwise(
            F.col("adj_close").cast("string")).alias("Adj. Close"), F.lit(1).alias("Volume")), "prices")
    return files.price_csv(spark, path)


@query("parse_iso_day", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day
  FROM lineitem WHERE l_linenumber NOT IN (4, 5)""")
def parse_iso_day(spark, d):
    day = F.col("l_shipdate").cast("date")
    text = (F.when(F.col("l_linenumber") == 1, F.concat(day.cast("string"), F.lit("T00:00:00Z")))
            .when(F.col("l_linenumber") == 2, F.date_format(day, "MM/dd/yyyy"))
            .when(F.col("l_linenumber") == 3, F.date_format(day, "d MMM yyyy"))
            .when(F.col("l_linenumber") == 4, F.lit("")).when(F.col("l_linenumber") == 5, F.lit("not a day"))
            .otherwise(F.date_format(day, "yyyyMMdd")))
    return (R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", files.iso_day(text).alias("day"))
            .where("day IS NOT NULL"))


@query("scan_price_json", f"""WITH {R.SQL_BARS} SELECT CAST(symbol AS VARCHAR) AS symbol,
    CASE WHEN symbol % 3 = 0 THEN 'split_adjusted_today' ELSE 'raw' END AS price_basis, {txt('day')}, round(close, 9) AS close,
    CASE WHEN symbol % 3 <> 2 THEN round(adj_close, 9) END AS adj_close FROM bars WHERE symbol % 10 <> 9""", digits=9)
def scan_price_json(spark, d):
    """Three payload shapes, one text line per symbol and year, and corrupt lines."""
    b = R.bars(spark, d)
    g = b.groupBy("symbol", F.year("day").alias("y")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), F.struct("close", "adj_close")))).alias("bars"),
        F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), F.col("close")))).alias("plain"))
    sym = F.concat(F.lit('{"symbol": "'), F.col("symbol").cast("string"), F.lit('", '))
    inner = lambda c: F.substring(F.to_json(c), F.lit(2), F.lit(10**9))
    text = (F.when(F.col("symbol") % 10 == 9, F.lit("{broken"))
            .when(F.col("symbol") % 3 == 0, F.concat(sym, F.lit('"price_basis": "split_adjusted_today", "splits": {}, "bars": '),
                                                     F.to_json("bars"), F.lit("}")))
            .when(F.col("symbol") % 3 == 1, F.concat(sym, inner("bars"))).otherwise(F.concat(sym, inner("plain"))))
    path = shared_dir(spark, "price-json")
    g.select(text.alias("value")).write.text(path)
    return files.price_json(spark.read.text(path))


@query("price_basis_check", f"""WITH u AS (SELECT s_suppkey AS symbol, CASE s_suppkey % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'split_adjusted_today'
    WHEN 2 THEN 'adjusted' END AS b FROM supplier)
  SELECT symbol, CASE WHEN coalesce(b, 'raw') IN ('raw', 'split_adjusted_today') THEN coalesce(b, 'raw') END AS price_basis,
    CASE WHEN b = 'adjusted' THEN 'unknown price basis adjusted' END AS refused FROM u""")
def price_basis_check(spark, d):
    k = F.col("s_suppkey") % 4
    raw = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.when(k == 0, "raw").when(
        k == 1, "split_adjusted_today").when(k == 2, "adjusted").alias("price_basis"))
    return files.checked_basis(raw)


@query("flatten_companyfacts", f"""WITH {R.SQL_FACTS}, f2 AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'shares' END AS unit FROM facts),
  pr AS (SELECT entity, tag, min(CASE unit WHEN 'USD' THEN '0USD' WHEN 'shares' THEN '1shares' ELSE '2' || unit END) AS p FROM f2 GROUP BY ALL)
  SELECT f2.entity, 'us-gaap' AS namespace, f2.tag, unit, {txt('start_day')}, {txt('end_day')}, {txt('filed')}, form, value
  FROM f2 JOIN pr ON pr.entity = f2.entity AND pr.tag = f2.tag AND substr(p, 2) = unit""")
def flatten_companyfacts(spark, d):
    f = R.facts(spark, d)
    k = F.col("seq") % 3
    one = f.withColumn("unit", F.when(k == 0, "USD").when(k == 1, "EUR").otherwise("shares"))
    entries = one.groupBy("entity", "tag", "unit", "start_day").agg(F.collect_list(F.struct(
        F.col("start_day").alias("start"), F.col("end_day").alias("end"), "filed", "form", F.col("value").alias("val"))).alias("e"))
    doc = F.struct("entity", F.create_map(F.lit("us-gaap"), F.create_map(F.col("tag"), F.struct(
        F.create_map(F.col("unit"), F.col("e")).alias("units")))).alias("facts"))
    path = shared_dir(spark, "payloads")
    entries.select(F.to_json(doc).alias("value")).write.text(path)
    from lodestat.operators import pit
    return pit.prefer_unit(files.filer_payload(spark.read.text(path)))


@query("scan_universe", f"""WITH {R.SQL_UNIVERSE} SELECT ticker AS symbol, name, sector, CASE WHEN symbol % 6 <> 0 THEN industry END AS industry, country,
    cap_bucket AS market_cap, exchange, nullif(trim(currency), '') AS currency FROM universe""")
def scan_universe(spark, d):
    u = R.universe(spark, d)
    path = _csv(spark, u.select(F.col("ticker").alias("symbol"), "name", "sector", F.when(F.col("symbol") % 6 == 0, "NaN").otherwise(
        F.col("industry")).alias("industry"), "country", F.col("cap_bucket").alias("market_cap"), "exchange", "currency"),
        "universe", compression="bzip2")
    return files.universe_csv(spark, path)


LABELS_BY_TAG = {"SalesA": ("Total Revenue",), "SalesN": ("EBIT", "Operating Income"), "SalesR": ("Capital Expenditure",)}
FORMS = ("10-K", "10-Q", "8-K")


def _filing_files(spark, d):
    li, od = R.table(spark, d, "lineitem"), R.table(spark, d, "orders")
    sub = od.select(F.col("o_orderkey").cast("string").alias("adsh"), F.col("o_custkey").cast("string").alias("cik"),
                    F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("form"),
                    F.date_format("o_orderdate", "yyyyMMdd").alias("filed"), F.date_format(F.last_day("o_orderdate"), "yyyyMMdd").alias("period"))
    # lines of high quantity have a tag of their own filer, known by its caption alone
    custom = F.col("l_quantity") > 40
    tag = F.when(custom, F.concat(F.lit("Own"), F.col("l_returnflag"))).otherwise(F.concat(F.lit("Sales"), F.col("l_returnflag")))
    num = li.select(F.col("l_orderkey").cast("string").alias("adsh"), tag.alias("tag"), F.lit("v1").alias("version"),
                    F.date_format("l_shipdate", "yyyyMMdd").alias("ddate"), (F.col("l_linenumber") - 1).cast("string").alias("qtrs"),
                    F.lit("USD").alias("uom"), F.when(F.col("l_tax") == 0, "Axis=x").alias("segments"),
                    F.when(F.col("l_tax") == 0.08, "co").alias("coreg"), F.when(F.col("l_tax") == 0, "0x1").otherwise("0x00000000").alias("dimh"),
                    F.when(F.col("l_discount") == 0, "x").otherwise(F.round(F.col("l_extendedprice") / 1000, 5).cast("string")).alias("value"))
    pre = li.select(F.col("l_orderkey").cast("string").alias("adsh"), F.lit("1").alias("report"), tag.alias("tag"), F.lit("v1").alias("version"),
                    F.when(F.col("l_returnflag") == "A", "IS").when(F.col("l_returnflag") == "N", "UN").otherwise("CF").alias("stmt"),
                    F.when(custom, "Net  Sales:").otherwise("-").alias("plabel"), F.lit("1").alias("line")).distinct()
    ren = od.select(F.col("o_orderkey").cast("string").alias("adsh"), F.lit("1").alias("report"),
                    F.when(F.col("o_orderstatus") == "F", "N").when(F.col("o_orderstatus") == "O", "D").otherwise("C").alias("menucat"),
                    F.concat(F.lit("note "), F.col("o_orderpriority")).alias("shortname"))
    tags = li.select(tag.alias("tag"), F.lit("v1").alias("version"), F.lit("0").alias("abstract"),
                     F.when(F.col("l_returnflag") == "R", "perShare").otherwise("monetaryItemType").alias("datatype")).distinct()
    read = lambda df, n: spark.read.option("header", True).option("sep", "\t").csv(_csv(spark, df, n, sep="\t"))
    labels = spark.createDataFrame([(k, list(v)) for k, v in LABELS_BY_TAG.items()], "tag string, labels array<string>")
    ciks = (R.table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("cik")))
    captions = spark.createDataFrame([("net sales", ["Total Revenue"])], "caption string, labels array<string>")
    return dict(captions=captions, sub=read(sub, "sub"), num=read(num, "num"), pre=read(pre, "pre"), ren=read(ren, "ren"), tags=read(tags, "tag"),
                labels=labels, ciks=ciks)


LABEL_ROWS = "labels(name, label) AS (VALUES " + ", ".join(f"('{t}', '{l}')" for t, ls in [*LABELS_BY_TAG.items(), *((f"Own{f}", ("Total Revenue",)) for f in "ANR")] for l in ls) + ")"
NUMS = f"""{LABEL_ROWS}, ln AS (SELECT *, CASE WHEN l_quantity > 40 THEN 'Own' ELSE 'Sales' END || l_returnflag AS tag, round(l_extendedprice / 1000, 5) AS v FROM lineitem),
  n AS (SELECT l_orderkey, tag, l_returnflag, label, CAST(l_shipdate AS DATE) AS period_end,
    l_linenumber - 1 AS quarters, CASE WHEN label = 'Capital Expenditure' THEN -abs(v) ELSE v END AS value
  FROM ln JOIN labels ON name = tag WHERE l_linenumber - 1 IN (0, 1, 4) AND l_tax <> 0 AND l_tax <> 0.08 AND l_discount <> 0),
  s AS (SELECT o_orderkey, o_custkey AS cik, CASE o_orderkey % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS form,
    CAST(o_orderdate AS DATE) AS filed_at, last_day(o_orderdate) AS report_period, o_orderstatus, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'MACHINERY')"""


@query("import_filing_statements", f"""WITH {NUMS} SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS adsh, lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, {txt('filed_at')}, {txt('report_period')}, form,
    CASE l_returnflag WHEN 'A' THEN 'IS' ELSE 'CF' END AS stmt, tag, label, {txt('period_end')}, quarters, 'USD' AS uom, value
  FROM n JOIN s ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N'""", digits=5)
def import_filing_statements(spark, d):
    f = _filing_files(spark, d)
    return files.filing_statements(f["sub"], f["pre"], f["num"], f["labels"], f["ciks"], "set1", f["captions"]).drop("source_hash")


@query("import_filing_notes", f"""WITH {NUMS} SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS adsh, lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, {txt('filed_at')}, {txt('report_period')}, form,
    CASE o_orderstatus WHEN 'F' THEN 'N' ELSE 'D' END AS menucat, 'note ' || o_orderpriority AS shortname, tag, label, {txt('period_end')},
    quarters, 'USD' AS uom, value
  FROM n JOIN s ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' AND form <> '8-K' AND o_orderstatus <> 'P'""", digits=5)
def import_filing_notes(spark, d):
    f = _filing_files(spark, d)
    return files.filing_notes(f["sub"], f["ren"], f["tags"], f["pre"], f["num"], f["labels"], f["ciks"], "set2", f["captions"]).drop("source_hash")


@query("idempotent_import", """SELECT DISTINCT source AS name, sha256(text) AS content_hash FROM documents d WHERE NOT EXISTS (
    SELECT 1 FROM documents r WHERE r.lang = 'en' AND r.doc_id % 4 <> 0 AND r.source = d.source AND sha256(r.text) = sha256(d.text))""")
def idempotent_import(spark, d):
    docs = R.table(spark, d, "documents").select(F.col("source").alias("name"), F.sha2("text", 256).alias("content_hash"), "lang", "doc_id")
    log = docs.where("lang = 'en'").withColumn("status", F.when(F.col("doc_id") % 4 == 0, "FAILED").otherwise("SUCCEEDED"))
    return files.pending_imports(docs.select("name", "content_hash"), log)


BROKER = f"""WITH {R.SQL_POSITIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY symbol) AS line, CASE WHEN symbol % 23 = 5 THEN 'market_value_eur' WHEN instrument_type = 'copyportfolio' THEN NULL
    WHEN symbol % 17 = 0 THEN 'quantity' WHEN symbol % 29 = 3 THEN 'leverage' END AS wrong FROM positions)"""


def broker_files(spark, d):
    """One export per snapshot, its rows by symbol; some numbers are no numbers, copied portfolios are booked as cash."""
    p, k = R.positions(spark, d), F.col("symbol")
    path, text = shared_dir(spark, "broker"), lambda c: F.col(c).cast("string")
    p.repartition("as_of").sortWithinPartitions("as_of", "symbol").select(
        F.col("as_of").alias("snapshot"), "as_of", k.cast("string").alias("symbol"), F.when(F.col("instrument_type") == "copyportfolio", "cash").otherwise(F.col("instrument_type")).alias("instrument_type"),
        F.when(k % 17 == 0, "?").otherwise(text("quantity")).alias("quantity"), F.when(k % 23 == 5, "n/a").otherwise(F.col("mv").cast("decimal(18,2)").cast("string")).alias("market_value_eur"),
        text("mv").alias("market_value_native"), F.when(k % 29 == 3, "x2").otherwise(text("leverage")).alias("leverage")).write.partitionBy("snapshot").option("header", True).csv(path)
    return path


@query("scan_broker_csv", f"""{BROKER}, t AS (SELECT as_of, SUM(CAST(round(mv * 100) AS BIGINT)) / 100.0 AS total FROM b WHERE wrong IS NULL AND instrument_type <> 'copyportfolio' GROUP BY ALL)
  SELECT {txt('b.as_of', 'as_of')}, CAST(symbol AS VARCHAR) AS symbol, instrument_type, quantity, mv, round(mv / total, 6) AS weight, leverage
  FROM b JOIN t ON t.as_of = b.as_of WHERE wrong IS NULL AND instrument_type <> 'copyportfolio'""")
def scan_broker_csv(spark, d):
    return files.broker_export(spark, broker_files(spark, d))[0]


@query("broker_refused", f"""{BROKER} SELECT {txt('as_of')}, 'snapshot=' || as_of AS folder, line, CAST(symbol AS VARCHAR) AS symbol, 'malformed number in ' || wrong AS reason FROM b WHERE wrong IS NOT NULL""")
def broker_refused(spark, d):
    """Refused rows of the exports with their file, line and reason."""
    refused = files.broker_export(spark, broker_files(spark, d))[1]
    return refused.select("as_of", F.regexp_extract("file", r"(snapshot=[^/]+)/[^/]+$", 1).alias("folder"), "line", "symbol", "reason")


@query("scan_manual_lines", f"""WITH {R.SQL_POSITIONS} SELECT CASE WHEN symbol % 19 = 0 THEN 'cash' WHEN symbol % 11 = 0 THEN 'refused' ELSE 'position' END AS kind,
    CASE WHEN symbol % 19 <> 0 THEN 'S' || symbol END AS symbol, CASE WHEN symbol % 19 <> 0 AND symbol % 11 <> 0 THEN quantity END AS quantity,
    CASE WHEN symbol % 19 = 0 OR symbol % 11 <> 0 THEN mv END AS mv,
    CASE WHEN symbol % 19 <> 0 AND symbol % 11 <> 0 THEN CASE WHEN currency = 'GBP' THEN 'EUR' ELSE currency END END AS currency FROM positions""", digits=2)
def scan_manual_lines(spark, d):
    p, sym = R.positions(spark, d), F.concat(F.lit("S"), F.col("symbol").cast("string"))
    mv = F.col("mv").cast("decimal(18,2)").cast("string")
    line = (F.when(F.col("symbol") % 19 == 0, F.concat(F.lit("Cash: "), mv))
            .when(F.col("symbol") % 11 == 0, F.concat(sym, F.lit("  "), F.col("quantity").cast("string")))
            .otherwise(F.concat_ws("  ", sym, F.col("quantity").cast("string"), mv, F.when(F.col("currency") != "GBP", F.col("currency")))))
    path = shared_dir(spark, "manual")
    p.select(line.alias("value")).write.text(path)
    return files.manual_lines(spark.read.text(path))


def _vendor(spark, d):
    k = F.col("symbol") % 11
    raw = R.bars(spark, d).select(
        "symbol", "day", F.when(k == 1, F.lit(None)).when((k == 2) & (F.dayofmonth("day") == 1), -F.col("close")).otherwise(F.col("close")).alias("close"),
        "adj_close", F.when(F.dayofmonth("day") == 2, F.when(k == 3, -0.5).otherwise(0.5)).alias("dividend"), F.lit(0.0).alias("split"))
    cur = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.when(F.col("s_suppkey") % 11 == 0, " ").otherwise("usd").alias("currency"))
    return raw, cur


@query("normalize_vendor_bars", f"""WITH {R.SQL_BARS}, r AS (SELECT symbol, day, CASE WHEN symbol % 11 = 1 THEN NULL WHEN symbol % 11 = 2 AND day(day) = 1 THEN -close ELSE close END AS close,
    adj_close, CASE WHEN day(day) = 2 THEN CASE WHEN symbol % 11 = 3 THEN -0.5 ELSE 0.5 END END AS dividend FROM bars)
  SELECT symbol, CASE WHEN symbol % 11 <> 0 THEN 'USD' END AS currency, CASE WHEN symbol % 11 = 0 THEN 'MISSING_CURRENCY' WHEN count(close) = 0 THEN 'NO_DATA'
    WHEN bool_or(close <= 0) THEN 'NON_POSITIVE_CLOSE' WHEN bool_or(coalesce(dividend, 0) < 0) THEN 'INVALID_ACTION' ELSE 'OK' END AS outcome,
    CASE WHEN symbol % 11 <> 0 AND count(close) > 0 AND NOT bool_or(close <= 0) AND NOT bool_or(coalesce(dividend, 0) < 0) THEN count(close) ELSE 0 END AS bars
  FROM r GROUP BY symbol""")
def normalize_vendor_bars(spark, d):
    raw, cur = _vendor(spark, d)
    kept = files.vendor_bars(raw, cur).groupBy("symbol").agg(F.count("*").alias("bars"))
    return files.vendor_outcomes(raw, cur).join(kept, "symbol", "left").fillna(0, ["bars"])


@query("history_rows_to_bars", f"""WITH {R.SQL_BARS}, u AS (SELECT symbol, day, CASE WHEN symbol % 8 = 0 THEN NULL ELSE close END AS close,
    CASE WHEN symbol % 4 = 0 THEN NULL ELSE adj_close END AS adj_close FROM bars WHERE day >= DATE '1998-01-01')
  SELECT symbol, {txt('day')}, round(close, 9) AS close, round(adj_close, 9) AS adj_close, 'OK' AS outcome FROM u WHERE close IS NOT NULL OR adj_close IS NOT NULL
  UNION ALL SELECT DISTINCT symbol, NULL, NULL::DOUBLE, NULL::DOUBLE, 'NO_USABLE_BARS' FROM bars WHERE symbol % 8 = 0""", digits=9)
def history_rows_to_bars(spark, d):
    k = F.col("symbol")
    rows = R.bars(spark, d).groupBy("symbol").agg(F.reverse(F.array_sort(F.collect_list(F.struct(
        F.col("day").cast("string").alias("t"), F.when(k % 8 == 0, "-1").otherwise(F.col("close").cast("string")).alias("c"),
        F.when(k % 4 == 0, "x").otherwise(F.col("adj_close").cast("string")).alias("a"))))).alias("data"))
    return files.history_bars(rows, "1998-01-01")


@query("weekly_grid_align", f"""WITH {R.SQL_BARS} SELECT symbol, {txt('day')}, CASE WHEN symbol % 5 <> 0 AND day(day) <= 20 THEN round(close, 9) END AS close, round(adj_close, 9) AS adj_close,
    CASE WHEN symbol % 5 = 0 THEN 'split_adjusted_today' ELSE 'raw' END AS price_basis FROM bars""", digits=9)
def weekly_grid_align(spark, d):
    b = R.bars(spark, d)
    held = b.where((F.col("symbol") % 5 != 0) & (F.dayofmonth("day") <= 20))
    raw = held.select("symbol", "day", "close", F.lit(2).alias("seq")).unionByName(
        held.select("symbol", "day", (F.col("close") + 1).alias("close"), F.lit(1).alias("seq")))
    return files.weekly_grid(b.select("symbol", "day", "adj_close"), raw)


@query("split_events", """SELECT l_suppkey AS symbol, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, l_quantity / 25 AS ratio
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <> 25 AND l_tax <> 0.08""")
def split_events(spark, d):
    li = R.table(spark, d, "lineitem")
    q = F.col("l_quantity")
    cell = F.when(F.col("l_tax") == 0.08, F.lit("none")).when(F.col("l_returnflag") == "R", (q / 25).cast("string")).otherwise("0")
    return files.split_events(li.select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("day"), cell.alias("ratio")))


UNPIVOT = ["revenue", "ebit", "ocf", "capex", "cash", "debt"]


@query("unpivot_statements", f"""WITH {R.SQL_STATEMENTS} SELECT entity, {txt('period_end')}, label, value FROM (
  SELECT entity, period_end, {', '.join(f"CASE WHEN {c} > 1e8 THEN NULL ELSE {c} END AS {c}" for c in UNPIVOT)} FROM stm WHERE scope = 'quarterly')
  UNPIVOT INCLUDE NULLS (value FOR label IN ({', '.join(UNPIVOT)}))""")
def unpivot_statements(spark, d):
    s = R.statements(spark, d).where("scope = 'quarterly'")
    return files.statement_long(s.select("entity", "period_end", *UNPIVOT), UNPIVOT)


SANE = [*UNPIVOT, "gross_profit", "net_income", "total_assets"]


@query("statement_sanity", f"""WITH {R.SQL_STATEMENTS}, l AS (UNPIVOT (SELECT entity, CASE WHEN entity % 4 = 0 THEN period_end - 800 ELSE period_end END AS period_end, {', '.join(SANE)} FROM stm WHERE scope = 'quarterly')
    ON {', '.join(SANE)} INTO NAME label VALUE value), k AS (SELECT * FROM l WHERE NOT (entity % 5 = 0 AND label = 'capex') AND NOT (entity % 7 = 0 AND label <> 'ocf'))
  SELECT entity, CASE WHEN count(DISTINCT label) < 8 THEN 'implausible row count ' || count(DISTINCT label) WHEN NOT bool_or(label = 'capex') THEN 'pinned rows absent: capex'
    WHEN DATE '2002-06-30' - max(period_end) > 400 THEN 'newest period not recent: ' || max(period_end) ELSE 'ok' END AS verdict FROM k GROUP BY entity""")
def statement_sanity(spark, d):
    s = R.statements(spark, d).where("scope = 'quarterly'").withColumn("period_end", F.expr("if(entity % 4 = 0, date_sub(period_end, 800), period_end)"))
    long = files.statement_long(s.select("entity", "period_end", *SANE), SANE).where("value IS NOT NULL").where(
        "NOT (entity % 5 = 0 AND label = 'capex') AND NOT (entity % 7 = 0 AND label <> 'ocf')")
    return files.statement_sanity(long, files.PINNED["cashflow"], "2002-06-30")


PROMOTED = "SELECT user_id AS symbol, CAST(ts AS DATE) AS day, round(value * 2, 2) AS close FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) = 1"


@query("merge_bar_into_history", f"""WITH h AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS day, arg_max(value, event_id) AS close FROM events GROUP BY ALL),
    p AS ({PROMOTED})
  SELECT symbol, {txt('day')}, close FROM p UNION ALL SELECT symbol, {txt('day')}, close FROM h WHERE NOT EXISTS (
    SELECT 1 FROM p WHERE p.symbol = h.symbol AND p.day = h.day)""", digits=2)
def merge_bar_into_history(spark, d):
    e = R.ledger(spark, d).withColumnRenamed("ticker", "symbol")
    hist = e.groupBy("symbol", "day").agg(F.max_by("value", "seq").alias("close"))
    new = e.where("kind = 'purchase'").groupBy("symbol", "day").agg((F.max_by("value", "seq") * 2).alias("close"))
    return files.merge_into_history(hist, new)


@query("sink_jsonl", f"WITH {R.SQL_POSITIONS} SELECT {txt('as_of')}, symbol, quantity, mv FROM positions", digits=2)
def sink_jsonl(spark, d):
    path = shared_dir(spark, "bundles")
    p = R.positions(spark, d).select("as_of", "symbol", "quantity", "mv")
    p.write.json(path)
    return spark.read.schema(p.schema).json(path)


@query("sink_run_report", f"""WITH {R.SQL_POSITIONS} SELECT instrument_type, count(*) AS lines, '2001-12-31' AS run_date FROM positions GROUP BY instrument_type
  UNION ALL SELECT instrument_type, count(*), '2001-09-30' FROM positions WHERE as_of <= DATE '2001-09-30' GROUP BY instrument_type""")
def sink_run_report(spark, d):
    path = shared_dir(spark, "report")
    p = R.positions(spark, d)
    for run_date in ("2001-09-30", "2001-12-31", "2001-12-31"):
        rows = p.where(F.col("as_of") <= F.lit(run_date).cast("date")).groupBy("instrument_type").agg(F.count("*").alias("lines"))
        files.write_report(rows, path, run_date)
    return spark.read.parquet(path)


@query("price_grid_from_ledger", f"""WITH {R.SQL_LEDGER}, run AS (SELECT day FROM ledger WHERE kind = 'purchase' GROUP BY day HAVING count(*) >= 10 ORDER BY day DESC LIMIT 1)
  SELECT ticker, {txt('ledger.day', 'day')}, arg_max(value, seq) AS close, max(seq) AS observation_id FROM ledger JOIN run ON run.day = ledger.day GROUP BY ticker, ledger.day""", digits=2)
def price_grid_from_ledger(spark, d):
    """Bars of the newest promoted run (here: the newest day with ten or more purchases)."""
    led = R.ledger(spark, d)
    run = (led.where("kind = 'purchase'").groupBy("day").agg(F.count("*").alias("n")).where("n >= 10")
           .agg(F.max("day").alias("day")))
    return led.join(run, "day", "left_semi").groupBy("ticker", "day").agg(
        F.max_by("value", "seq").alias("close"), F.max("seq").alias("observation_id"))
