"""Readers and writers: fact and price CSV, price and filer JSON, filing data
sets, broker exports, run outputs. Columns are found by name and pruned before
parsing; bad cells become NULL and bad rows are dropped or reported, never
guessed."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestat.sources.lines import csv_rows

# fixed values: column names and aliases of the file formats
FACT_COLUMNS = ("symbol", "namespace", "tag", "unit", "start", "end", "filed", "form", "value")
DEFAULT_NAMESPACE = "us-gaap"
DEFAULT_UNIT = "USD"
SYMBOL_ALIASES = ("symbol", "ticker", "sym")
DATE_ALIASES = ("date", "day", "week", "weekend", "weekending", "weekended", "periodend", "period",
                "timestamp", "datetime", "bardate", "asof")
CLOSE_ALIASES = ("close", "rawclose", "closeraw", "closeprice", "priceclose", "unadjustedclose",
                 "closeunadjusted")
ADJ_ALIASES = ("adjclose", "adjustedclose", "adjclosingprice", "adjustedclosingprice", "closeadj",
               "closeadjusted", "adjustedprice", "adjustedcloseprice")
PRICE_BASES = ("raw", "split_adjusted_today")
UNIVERSE_COLUMNS = ("symbol", "name", "sector", "industry", "country", "market_cap", "exchange", "currency")
DAY_FORMATS = ("MM/dd/yyyy", "d MMM yyyy", "yyyy/MM/dd", "yyyyMMdd")


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def number(c) -> Column:
    """Finite number or NULL."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def iso_day(c) -> Column:
    """A day from free text: an ISO prefix as is, else one of the known formats."""
    text = F.trim(c)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))
    for fmt in DAY_FORMATS:
        day = F.coalesce(day, F.try_to_date(text, fmt))
    return day


def read_table(spark: SparkSession, path: str, columns: tuple, sep: str = ",") -> DataFrame:
    """Text columns by name; a missing one is named in the error."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}; found {raw.columns}")
    return raw.select(*columns)


def fact_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = read_table(spark, path, FACT_COLUMNS)
    return raw.select(
        "symbol",
        F.coalesce(blank_to_null(F.col("namespace")), F.lit(DEFAULT_NAMESPACE)).alias("namespace"),
        blank_to_null(F.col("tag")).alias("tag"),
        F.coalesce(blank_to_null(F.col("unit")), F.lit(DEFAULT_UNIT)).alias("unit"),
        blank_to_null(F.col("start")).try_cast("date").alias("start_day"),
        blank_to_null(F.col("end")).try_cast("date").alias("end_day"),
        blank_to_null(F.col("filed")).try_cast("date").alias("filed"),
        "form", number("value").alias("value"),
    ).where("tag IS NOT NULL AND end_day IS NOT NULL AND filed IS NOT NULL AND value IS NOT NULL")


def find_column(found: list, aliases: tuple):
    """First column whose name, stripped to letters and digits, is an alias."""
    plain = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in reversed(found)}
    return next((plain[a] for a in aliases if a in plain), None)


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    names = {k: find_column(raw.columns, a) for k, a in (
        ("symbol", SYMBOL_ALIASES), ("day", DATE_ALIASES), ("close", CLOSE_ALIASES), ("adj_close", ADJ_ALIASES))}
    if names["symbol"] is None or names["day"] is None or not (names["close"] or names["adj_close"]):
        raise ValueError(f"{path}: not a price grid; columns found: {raw.columns}")

    def field(k):
        return number(F.col(f"`{names[k]}`")) if names[k] else F.lit(None).cast("double")

    return raw.select(
        blank_to_null(F.col(f"`{names['symbol']}`")).alias("symbol"),
        iso_day(F.col(f"`{names['day']}`")).alias("day"), field("close").alias("close"),
        field("adj_close").alias("adj_close"),
    ).where("symbol IS NOT NULL AND day IS NOT NULL AND (close IS NOT NULL OR adj_close IS NOT NULL)")


def price_json(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Bars of per-symbol JSON payloads: the envelope {symbol, bars, splits,
    price_basis}, the same without "bars", and plain day -> number. A payload
    that is not an object yields one row with its reason."""
    top = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    p = payloads.select(top.alias("m"), text)
    body = F.when(F.map_contains_key("m", F.lit("bars")),
                  F.from_json(F.element_at("m", F.lit("bars")), T.MapType(T.StringType(), T.StringType()))
                  ).otherwise(F.map_filter("m", lambda k, v: ~k.isin("symbol", "splits", "price_basis")))
    rows = p.where("m IS NOT NULL").select(
        F.element_at("m", F.lit("symbol")).alias("symbol"),
        F.coalesce(F.element_at("m", F.lit("price_basis")), F.lit("raw")).alias("price_basis"),
        F.explode(body).alias("day", "cell"))
    bar = F.from_json("cell", "close double, adj_close double")
    return rows.select("symbol", "price_basis", F.col("day").try_cast("date").alias("day"),
                       F.coalesce(F.col("cell").try_cast("double"), bar["close"]).alias("close"),
                       bar["adj_close"].alias("adj_close"))


def checked_basis(rows: DataFrame, basis: str = "price_basis") -> DataFrame:
    """Absent reads raw; a value outside the known bases is quarantined."""
    value = F.coalesce(F.col(basis), F.lit("raw"))
    known = value.isin(*PRICE_BASES)
    return rows.withColumns({
        basis: F.when(known, value),
        "refused": F.when(~known, F.concat(F.lit("unknown price basis "), value))})


ENTRY = T.ArrayType(T.StructType([
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("filed", T.StringType()), T.StructField("form", T.StringType()),
    T.StructField("val", T.DoubleType())]))
PAYLOAD = T.StructType([
    T.StructField("entity", T.LongType()),
    T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
        T.StructField("units", T.MapType(T.StringType(), ENTRY))]))))])


def filer_payload(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Nested facts[namespace][tag].units[unit][] as long rows, all units."""
    p = payloads.select(F.from_json(text, PAYLOAD).alias("p")).select("p.entity", F.explode("p.facts").alias("namespace", "tags"))
    p = p.select("entity", "namespace", F.explode("tags").alias("tag", "body"))
    p = p.select("entity", "namespace", "tag", F.explode("body.units").alias("unit", "entries"))
    p = p.select("entity", "namespace", "tag", "unit", F.explode("entries").alias("e"))
    return p.select("entity", "namespace", "tag", "unit", F.col("e.start").try_cast("date").alias("start_day"),
                    F.col("e.end").try_cast("date").alias("end_day"), F.col("e.filed").try_cast("date").alias("filed"),
                    "e.form", F.col("e.val").alias("value"))


def universe_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = read_table(spark, path, UNIVERSE_COLUMNS)
    clean = [F.when(F.lower(F.trim(c)) != "nan", blank_to_null(F.col(c))).alias(c) for c in UNIVERSE_COLUMNS]
    return raw.select(*clean)


# fixed values: statement types, forms, report categories and labels of the filing sets
STATEMENT_TYPES = ("BS", "IS", "CF", "EQ", "CI", "CP")
NOTE_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "20-F/A", "40-F", "40-F/A")
NOTE_CATEGORIES = ("N", "D", "T")
QUARTER_SPANS = (0, 1, 4)


def _compact_day(c: str) -> Column:
    return F.try_to_date(F.col(c), "yyyyMMdd")


def _number_rows(num: DataFrame, concepts: DataFrame, archive: str, extra: tuple) -> DataFrame:
    value, qtrs = number("value"), F.col("qtrs").try_cast("int")
    rows = (num.withColumn("value", value).withColumn("quarters", qtrs)
            .where(F.col("value").isNotNull() & F.col("quarters").isin(*QUARTER_SPANS)
                   & F.coalesce(blank_to_null(F.col("coreg")), F.lit("")).eqNullSafe(""))
            .join(concepts, ["adsh", "tag", "version"])
            .withColumn("label", F.explode("labels")))
    signed = F.when(F.col("label") == "Capital Expenditure", -F.abs("value")).otherwise(F.col("value"))
    rows = rows.withColumn("value", signed)
    # the number itself, not its cents: per-share values differ below a cent, and some values exceed any decimal
    key = F.sha2(F.concat_ws("|", F.lit(archive), "adsh", *extra, "tag", "version", "label", "ddate",
                             F.col("quarters").cast("string"), "uom", F.col("value").cast("string")), 256)
    return rows.withColumn("source_hash", key).dropDuplicates(["source_hash"])


def _eligible(sub: DataFrame, ciks: DataFrame) -> DataFrame:
    """Submissions of eligible filers; the filer's number has ten digits on either side."""
    wanted = ciks.select(F.lpad("cik", 10, "0").alias("cik")).distinct()
    period = _compact_day("period") if "period" in sub.columns else F.lit(None).cast("date")
    return (sub.withColumn("cik", F.lpad("cik", 10, "0")).join(wanted, "cik", "left_semi")
            .select("adsh", "cik", _compact_day("filed").alias("filed_at"), "form", period.alias("report_period")))


def _labelled(pre: DataFrame, labels: DataFrame, captions: DataFrame | None) -> DataFrame:
    """Presentation rows with the labels of their tag, else of their caption (custom tags)."""
    from lodestat.functions.labels import caption_key
    if captions is None or "plabel" not in pre.columns:
        return pre.join(labels, "tag")
    c = captions.select(F.col("caption").alias("_caption"), F.col("labels").alias("_labels"))
    both = pre.withColumn("_caption", caption_key(F.coalesce("plabel", F.lit("")))).join(labels, "tag", "left").join(c, "_caption", "left")
    return both.withColumn("labels", F.coalesce("labels", "_labels")).where("labels IS NOT NULL").drop("_caption", "_labels")


def _last_row(pre: DataFrame, *columns: str) -> Column:
    """The values of the last row of the file, by report and line as far as it has them."""
    order = [F.col(c).try_cast("int") for c in ("report", "line") if c in pre.columns]
    return F.max_by(F.struct(*columns), F.struct(*order, *[c for c in columns if c != "labels"]))


def filing_statements(sub: DataFrame, pre: DataFrame, num: DataFrame, labels: DataFrame,
                      ciks: DataFrame, archive: str, captions: DataFrame | None = None) -> DataFrame:
    """Submissions of eligible filers, joined with presentation rows of the six
    statements whose tag (or, for custom tags, caption) has canonical labels, joined
    with undimensioned numbers. Filers that are not wanted leave before any large join."""
    subs = _eligible(sub, ciks)
    shown = _labelled(pre.where(F.col("stmt").isin(*STATEMENT_TYPES)).join(subs, "adsh", "left_semi"), labels, captions)
    shown = (shown.groupBy("adsh", "tag", "version").agg(_last_row(shown, "stmt", "labels").alias("w"))
             .select("adsh", "tag", "version", "w.stmt", "w.labels"))
    plain = num.where(F.coalesce(blank_to_null(F.col("segments")), F.lit("")).eqNullSafe("")).join(subs, "adsh", "left_semi")
    return _number_rows(plain, shown, archive, ()).join(subs, "adsh").select(
        "adsh", "cik", "filed_at", "form", "report_period", "stmt", "tag", "label", _compact_day("ddate").alias("period_end"),
        "quarters", "uom", "value", "source_hash")


def filing_notes(sub: DataFrame, ren: DataFrame, tags: DataFrame, pre: DataFrame, num: DataFrame,
                 labels: DataFrame, ciks: DataFrame, archive: str, captions: DataFrame | None = None) -> DataFrame:
    """Five-way join: periodic forms, note categories, monetary non-abstract tags,
    undimensioned numbers."""
    subs = _eligible(sub.where(F.upper("form").isin(*NOTE_FORMS)), ciks)
    reports = ren.where(F.col("menucat").isin(*NOTE_CATEGORIES)).select("adsh", "report", "menucat", "shortname")
    money = tags.where((F.col("abstract") == "0") & F.lower("datatype").contains("monetary")).select("tag", "version")
    concepts = (_labelled(pre.join(subs, "adsh", "left_semi").join(money, ["tag", "version"], "left_semi").join(reports, ["adsh", "report"]), labels, captions)
                .groupBy("adsh", "tag", "version")
                .agg(F.max(F.struct("menucat", "shortname")).alias("rep"), F.first("labels").alias("labels")))
    plain = num.where(F.col("dimh") == "0x00000000").join(subs, "adsh", "left_semi")
    keyed = _number_rows(plain, concepts.select("adsh", "tag", "version", "labels", "rep.menucat", "rep.shortname"),
                         archive, ("menucat",))
    return keyed.join(subs, "adsh").select(
        "adsh", "cik", "filed_at", "form", "report_period", "menucat", "shortname", "tag", "label",
        _compact_day("ddate").alias("period_end"), "quarters", "uom", "value", "source_hash")


def pending_imports(candidates: DataFrame, run_log: DataFrame) -> DataFrame:
    """Candidates (name, content_hash) with no succeeded run; each once."""
    done = run_log.where("status = 'SUCCEEDED'").select("name", "content_hash")
    return candidates.join(done, ["name", "content_hash"], "left_anti").dropDuplicates(["name", "content_hash"])


BROKER_COLUMNS = ("symbol", "instrument_type", "quantity", "market_value_eur", "market_value_native")


def broker_positions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, refused) of a broker export read as text columns. Cash rows are
    left out of the positions; a row with a ``fault`` or a number that does not
    parse is refused with its reason (and its file and line, if the rows have
    them); the weight is the share of the snapshot's priced value. A blank opening
    price or leverage is no fault: none, and 1."""
    have = set(rows.columns)
    blank = lambda c: blank_to_null(F.col(c)) if c in have else F.lit(None).cast("string")
    is_cash = (F.trim("instrument_type") == "cash") | (F.upper(F.trim("symbol")) == "CASH")
    wrong = lambda c: F.format_string("malformed number in %s", F.lit(c))
    rest = F.when(number("quantity").isNull(), wrong("quantity"))
    rest = rest.when(blank("avg_open_price").isNotNull() & number(blank("avg_open_price")).isNull(), wrong("avg_open_price"))
    rest = rest.when(number("market_value_native").isNull(), wrong("market_value_native"))
    rest = rest.when(blank("leverage").isNotNull() & number(blank("leverage")).isNull(), wrong("leverage"))
    reason = F.coalesce(F.col("fault") if "fault" in have else F.lit(None).cast("string"),
                        F.when(number("market_value_eur").isNull(), wrong("market_value_eur")).when(~F.coalesce(is_cash, F.lit(False)), rest))
    r = rows.withColumns({"_cash": F.coalesce(is_cash, F.lit(False)), "_reason": reason, "_mv": number("market_value_eur")})
    good = r.where("_reason IS NULL AND NOT _cash")
    total = good.groupBy("as_of").agg(F.sum("_mv").alias("total"))
    at = [c for c in ("file", "line") if c in have]
    return (good.join(total, "as_of").select(
        "as_of", F.trim("symbol").alias("symbol"), F.trim("instrument_type").alias("instrument_type"),
        number("quantity").alias("quantity"), F.col("_mv").alias("mv"),
        (F.col("_mv") / F.col("total")).alias("weight"),
        F.coalesce(number(blank("leverage")), F.lit(1.0)).alias("leverage")),
        r.where("_reason IS NOT NULL").select(*at, "as_of", "symbol", F.col("_reason").alias("reason")))


def broker_export(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(positions, refused) of broker CSV files; refused rows tell file and line (rows counted from 1). Without one of the needed
    columns every row is refused. A file without ``as_of`` is one snapshot, named by its path."""
    rows, columns = csv_rows(spark, path)
    missing = [c for c in BROKER_COLUMNS if c not in columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in missing})
    if missing:
        rows = rows.withColumn("fault", F.coalesce("fault", F.lit(f"no column {missing[0]}")))
    if "as_of" not in columns:
        rows = rows.withColumn("as_of", F.col("file"))
    return broker_positions(rows)


def manual_lines(lines: DataFrame) -> DataFrame:
    """Text lines "SYMBOL QTY MV [CCY]" and "cash: N"; fewer than three tokens is
    refused. (kind, symbol, quantity, mv, currency)"""
    text = F.trim("value")
    parts = F.split(text, r"\s+")
    cash = F.lower(text).startswith("cash:")
    ok = F.size(parts) >= 3
    return lines.where(text != "").select(
        F.when(cash, "cash").when(ok, "position").otherwise("refused").alias("kind"),
        F.when(~cash, parts[0]).alias("symbol"),
        F.when(~cash & ok, F.try_element_at(parts, F.lit(2)).try_cast("double")).alias("quantity"),
        F.when(cash, F.try_element_at(F.split(text, ":"), F.lit(2)).try_cast("double"))
        .when(ok, F.try_element_at(parts, F.lit(3)).try_cast("double")).alias("mv"),
        F.when(~cash & ok, F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("EUR"))).alias("currency"))


def vendor_outcomes(raw: DataFrame, currencies: DataFrame) -> DataFrame:
    """One outcome per symbol of a vendor batch, in the order the checks apply."""
    both = F.col("close").isNotNull() & F.col("adj_close").isNotNull()
    g = raw.groupBy("symbol").agg(
        F.count(F.when(both, 1)).alias("usable"),
        F.bool_or(both & ((F.col("close") <= 0) | (F.col("adj_close") <= 0))).alias("non_positive"),
        F.bool_or(both & ((F.coalesce("dividend", F.lit(0.0)) < 0) | (F.coalesce("split", F.lit(0.0)) < 0))).alias("bad_action"))
    return g.join(currencies, "symbol", "left").select(
        "symbol", blank_to_null(F.upper("currency")).alias("currency"),
        F.when(blank_to_null(F.col("currency")).isNull(), "MISSING_CURRENCY")
        .when(F.col("usable") == 0, "NO_DATA").when(F.col("non_positive"), "NON_POSITIVE_CLOSE")
        .when(F.col("bad_action"), "INVALID_ACTION").otherwise("OK").alias("outcome"))


def vendor_bars(raw: DataFrame, currencies: DataFrame) -> DataFrame:
    ok = vendor_outcomes(raw, currencies).where("outcome = 'OK'").drop("outcome")
    return (raw.where("close IS NOT NULL AND adj_close IS NOT NULL").join(ok, "symbol")
            .select("symbol", "day", "close", "adj_close", F.coalesce("dividend", F.lit(0.0)).alias("dividend"),
                    F.coalesce("split", F.lit(0.0)).alias("split"), "currency"))


def history_bars(payloads: DataFrame, start) -> DataFrame:
    """Vendor rows {t, c, a} per symbol as bars at or after ``start``; a row with one
    usable price keeps that field only; a symbol with none reports its failure."""
    def price(c):
        x = number(c)
        return F.when(x > 0, x)
    rows = payloads.select("symbol", F.explode_outer("data").alias("r")).select(
        "symbol", iso_day(F.col("r.t")).alias("day"), price(F.col("r.c")).alias("close"), price(F.col("r.a")).alias("adj_close"))
    usable = rows.where((F.col("day") >= F.lit(start).cast("date"))
                        & (F.col("close").isNotNull() | F.col("adj_close").isNotNull()))
    failed = payloads.select("symbol").distinct().join(usable.select("symbol").distinct(), "symbol", "left_anti")
    return usable.withColumn("outcome", F.lit("OK")).unionByName(
        failed.select("symbol", F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("close"),
                      F.lit(None).cast("double").alias("adj_close"), F.lit("NO_USABLE_BARS").alias("outcome")))


def weekly_grid(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """Adjusted bars left-aligned with raw closes (the last per day); a symbol with
    no raw close at all is declared split-adjusted."""
    last = raw.groupBy("symbol", "day").agg(F.max_by("close", "seq").alias("close"))
    grid = adjusted.join(last, ["symbol", "day"], "left")
    basis = grid.groupBy("symbol").agg(
        F.when(F.count("close") == 0, "split_adjusted_today").otherwise("raw").alias("price_basis"))
    return grid.join(basis, "symbol").select("symbol", "day", "close", "adj_close", "price_basis")


def split_events(rows: DataFrame) -> DataFrame:
    """Split cells that are positive numbers other than one."""
    return rows.withColumn("ratio", number("ratio")).where("ratio > 0 AND ratio <> 1")


def statement_long(wide: DataFrame, labels: list) -> DataFrame:
    """(entity, period_end, label, value); non-finite cells become NULL."""
    long = wide.unpivot(["entity", "period_end"], labels, "label", "value")
    return long.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value")))


PINNED = {"income": ("revenue", "ebit"), "balance": ("debt", "cash"), "cashflow": ("ocf", "capex")}
MIN_STATEMENT_ROWS = 8
RECENT_PERIOD_DAYS = 400


def statement_sanity(long: DataFrame, pinned: tuple, as_of, min_rows: int = MIN_STATEMENT_ROWS) -> DataFrame:
    """Gate per entity: rows present, enough labels, pinned labels, a recent period."""
    g = long.groupBy("entity").agg(
        F.countDistinct("label").alias("rows"), F.max("period_end").alias("newest"),
        *[F.bool_or(F.col("label") == p).alias(f"has_{p}") for p in pinned])
    absent = F.filter(F.array(*[F.when(~F.col(f"has_{p}"), p) for p in pinned]), lambda x: x.isNotNull())
    return g.select(
        "entity", F.when(F.col("rows") < min_rows, F.format_string("implausible row count %d", "rows"))
        .when(F.size(absent) > 0, F.concat(F.lit("pinned rows absent: "), F.array_join(absent, ",")))
        .when(F.datediff(F.lit(as_of).cast("date"), "newest") > RECENT_PERIOD_DAYS,
              F.concat(F.lit("newest period not recent: "), F.col("newest").cast("string")))
        .otherwise("ok").alias("verdict"))


def merge_into_history(history: DataFrame, promoted: DataFrame) -> DataFrame:
    """History extended by the promoted bars; a promoted bar wins on its own day."""
    return history.join(promoted, ["symbol", "day"], "left_anti").unionByName(promoted)


def write_report(df: DataFrame, path: str, run_date: str) -> None:
    """Run outputs, one folder per run date; a re-run replaces only its own date."""
    (df.withColumn("run_date", F.lit(run_date)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path))
