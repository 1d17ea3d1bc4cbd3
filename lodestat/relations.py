"""Input relations: the driver's tables read as facts, bars, listings,
statements, positions and ledger rows. Every relation keeps its scale with
the table it comes from, and every money sum is exact (integer cents)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.session import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(col: str) -> Column:
    return F.col(col).cast("date")


def _quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def _year_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "year"), 11))


def cents(col: str) -> Column:
    return F.rint(F.col(col) * 100).cast("bigint")


# --- facts ------------------------------------------------------------------

def facts(spark, sf_dir) -> DataFrame:
    """Filed facts: (entity, tag, start_day, end_day, filed, form, value, seq)."""
    day = _day("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.expr("o_custkey div 8").alias("entity"),
        F.col("o_orderpriority").alias("tag"),
        F.trunc(day, "quarter").alias("start_day"),
        _quarter_end(day).alias("end_day"),
        day.alias("filed"),
        F.col("o_orderstatus").alias("form"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("seq"),
    )


def cumulative_facts(spark, sf_dir) -> DataFrame:
    """Year-to-date facts: running total by quarter, every span starting on
    1 January, filed 30 days after its end. One row per quarter and key, so
    the running window holds at most four rows."""
    from pyspark.sql import Window as W

    day = _day("o_orderdate")
    quarters = (
        table(spark, sf_dir, "orders")
        .select(
            F.expr("o_custkey div 8").alias("entity"),
            F.col("o_orderpriority").alias("tag"),
            F.trunc(day, "year").alias("start_day"),
            _quarter_end(day).alias("end_day"),
            cents("o_totalprice").alias("c"),
            F.col("o_orderkey").alias("k"),
        )
        .groupBy("entity", "tag", "start_day", "end_day")
        .agg(F.sum("c").alias("c"), F.max("k").alias("seq"))
    )
    ytd = W.partitionBy("entity", "tag", "start_day").orderBy("end_day")
    return quarters.select(
        "entity", "tag", "start_day", "end_day",
        F.date_add("end_day", 30).alias("filed"),
        F.lit("10-Q").alias("form"),
        (F.sum("c").over(ytd) / 100.0).alias("value"),
        "seq",
    )


# --- prices -----------------------------------------------------------------

def bars(spark, sf_dir) -> DataFrame:
    """Weekly bars (symbol, day, close, adj_close): the last line of each week."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
                     "l_discount")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.trunc(_day("l_shipdate"), "week").alias("day"), order.alias("line"))
    last = dealt(lines.select("symbol", "day", "line.*"), "symbol", "day").groupBy("symbol", "day").agg(
        F.max_by(F.struct(price.alias("close"),
                          (price * (1 - F.col("l_discount"))).alias("adj_close")), order)
        .alias("bar"))
    return last.select("symbol", "day", "bar.close", "bar.adj_close")


def splits(spark, sf_dir) -> DataFrame:
    """Split events (symbol, day, ratio); one row per symbol and day."""
    return (
        table(spark, sf_dir, "lineitem")
        .where((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.10)
               & (F.col("l_returnflag") == "R"))
        .select(F.col("l_suppkey").alias("symbol"), _day("l_shipdate").alias("day"),
                F.lit(2.0).alias("ratio"))
        .distinct()
    )


def share_counts(spark, sf_dir) -> DataFrame:
    """Filed share counts (entity, end_day, filed, value, seq): one count per
    line of return flag R, measured at quarter end, filed at ship date."""
    day = _day("l_shipdate")
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select(F.col("l_suppkey").alias("entity"), _quarter_end(day).alias("end_day"),
                day.alias("filed"),
                (F.col("l_quantity") * 1000 + F.col("l_linenumber")).alias("value"),
                F.col("l_orderkey").alias("seq"))
    )


# --- listings ---------------------------------------------------------------

def universe(spark, sf_dir) -> DataFrame:
    """Listings (symbol, ticker, name, sector, industry, country, cap_bucket,
    exchange, currency, cik). Three listings share one company name."""
    key = F.col("s_suppkey")
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]),
                          (key % len(SUFFIXES) + 1).cast("int"))
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    bal = F.col("s_acctbal")
    return (
        table(spark, sf_dir, "supplier")
        .join(n, F.col("s_nationkey") == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            key.alias("symbol"),
            F.concat(F.lit("T"), F.expr("s_suppkey div 3").cast("string"),
                     F.element_at(F.array(F.lit(""), F.lit("W"), F.lit("-B")),
                                  (key % 3 + 1).cast("int"))).alias("ticker"),
            F.concat(F.lit("Company "), F.expr("s_suppkey div 3").cast("string"),
                     suffix).alias("name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]),
                         (F.col("n_regionkey") + 1).cast("int")).alias("country"),
            F.when(bal >= 8000, "Mega Cap").when(bal >= 5000, "Large Cap")
            .when(bal >= 2000, "Mid Cap").when(bal >= 0, "Small Cap").alias("cap_bucket"),
            F.element_at(F.array(*[F.lit(c) for c in EXCHANGES]),
                         (key % len(EXCHANGES) + 1).cast("int")).alias("exchange"),
            F.when(key % 4 == 0, F.lit("usd ")).when(key % 4 == 1, F.lit("")).alias("currency"),
            F.when(key % 5 != 0, F.expr("s_suppkey div 3")).alias("cik"),
        )
    )


SUFFIXES = (" Inc.", " Holdings plc", " (The) Corp - ADR", " Warrants", " Common Units",
            " Units", " Senior Notes", " Royalty Trust", " Preferred Stock", " Growth Fund", "")
COUNTRIES = ("United States", "Netherlands", "United Kingdom", "Germany", "France")
EXCHANGES = ("NYSE", "AMS", "LSE", "GER", "PAR", "NASDAQ", "NYQ")

# --- statements -------------------------------------------------------------

# label -> (weight in thousandths, condition on a line item); a label is NULL in a
# period that has no line of its slice. Some labels add two slices.
STATEMENT_SLICES = {
    "revenue": ((1000, "true"),),
    "gross_profit": ((1000, "l_linestatus = 'F'"),),
    "cost": ((1000, "l_linestatus = 'O'"),),
    "ebit": ((900, "l_returnflag = 'R'"), (-500, "l_returnflag = 'A'")),
    "net_income": ((700, "l_returnflag = 'R'"), (-400, "l_returnflag = 'A'")),
    "ocf": ((600, "l_linestatus = 'F'"), (-300, "l_returnflag = 'A'")),
    "capex": ((-1000, "l_tax = 0.02"),),
    "da": ((1000, "l_tax = 0.01"),),
    "sbc": ((200, "l_discount = 0.05"),),
    "interest": ((100, "l_tax = 0.03"),),
    "credit_loss": ((300, "l_discount = 0.07"),),
    "dividends": ((-100, "l_tax = 0.04"),),
    "buybacks": ((-100, "l_tax = 0.05"),),
    "research": ((300, "l_discount = 0.06"),),
    "tax_expense": ((200, "l_discount = 0.02"),),
    "taxes_paid": ((150, "l_discount = 0.02"),),
    "pretax": ((800, "l_returnflag = 'R'"), (-400, "l_returnflag = 'A'")),
    "basic_shares": ((1000, "l_quantity <= 40"),),
    "diluted_shares": ((1050, "l_quantity <= 42"),),
    "cash": ((1000, "l_tax = 0.06"),),
    "debt": ((1500, "l_tax = 0.07"),),
    "current_debt": ((500, "l_tax = 0.07"),),
    "total_assets": ((3000, "true"),),
    "current_assets": ((1000, "l_quantity <= 25"),),
    "current_liabilities": ((1000, "l_quantity > 35"),),
    "equity": ((2000, "l_discount < 0.05"),),
    "nci": ((500, "l_tax = 0.08"),),
    "deferred": ((1000, "l_discount = 0.09"),),
    "retained": ((1000, "l_discount <= 0.02"),),
    "liabilities": ((1500, "l_discount >= 0.05"),),
    "goodwill": ((500, "l_discount = 0.01"),),
}
LABELS = tuple(STATEMENT_SLICES)


def _slice_sum(parts) -> Column:
    cell = F.when(F.expr(parts[0][1]), F.lit(parts[0][0]))
    for weight, cond in parts[1:]:
        cell = cell.when(F.expr(cond), F.lit(weight))
    return F.sum(F.col("c") * cell)


def _statement_units(spark, sf_dir) -> DataFrame:
    """Sums of every label per (entity, year_end, period_end). Lines are dealt out by entity and year and summed where they lie: a split of a
    large table holds few lines of a company's quarter, so sums made before the exchange would be nearly as many rows as lines,
    each several times as wide."""
    day = _day("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"), _year_end(day).alias("year_end"), _quarter_end(day).alias("period_end"),
        cents("l_extendedprice").alias("c"), "l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_quantity")
    return (dealt(lines, "entity", "year_end").groupBy("entity", "year_end", "period_end")
            .agg(*[_slice_sum(parts).alias(label) for label, parts in STATEMENT_SLICES.items()]))


def statements(spark, sf_dir) -> DataFrame:
    """Wide statements (entity, scope, period_end, one column per label); the
    annual scope re-adds the quarterly integers beside them, so the lines are
    scanned, exchanged and summed once. A company and year holds at most five rows."""
    from pyspark.sql import Window as W

    year = W.partitionBy("entity", "year_end")
    q = _statement_units(spark, sf_dir).select(
        "entity", "year_end", "period_end", *LABELS, F.row_number().over(year.orderBy("period_end")).alias("nth"),
        *[F.sum(c).over(year).alias(f"year_{c}") for c in LABELS])
    own = F.struct(F.lit("quarterly").alias("scope"), "period_end", *LABELS)
    total = F.struct(F.lit("annual").alias("scope"), F.col("year_end").alias("period_end"), *[F.col(f"year_{c}").alias(c) for c in LABELS])
    return (q.select("entity", F.explode(F.array_compact(F.array(own, F.when(F.col("nth") == 1, total)))).alias("s"))
            .select("entity", "s.scope", "s.period_end", *[(F.col(f"s.{c}") / 100000.0).alias(c) for c in LABELS]))


# --- portfolio --------------------------------------------------------------

def positions(spark, sf_dir) -> DataFrame:
    """Position lines per quarterly snapshot (as_of, symbol, instrument_type,
    currency, quantity, mv, avg_open_price, leverage)."""
    key = F.col("symbol")
    qty = F.col("quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(_quarter_end(_day("l_shipdate")).alias("as_of"), F.col("l_suppkey").alias("symbol"))
        .agg((F.sum(F.col("l_quantity").cast("bigint"))).alias("q"),
             F.sum(cents("l_extendedprice")).alias("m"))
        .select("as_of", "symbol",
                F.element_at(F.array(*[F.lit(t) for t in INSTRUMENT_TYPES]),
                             (key % len(INSTRUMENT_TYPES) + 1).cast("int")).alias("instrument_type"),
                F.element_at(F.array(F.lit("EUR"), F.lit("USD"), F.lit("GBP")),
                             (key % 3 + 1).cast("int")).alias("currency"),
                F.col("q").cast("double").alias("quantity"),
                (F.col("m") / 100.0).alias("mv"),
                (F.col("m") / 100.0 / F.col("q")).alias("avg_open_price"),
                F.when(F.col("q") % 20 == 0, 2.0).otherwise(1.0).alias("leverage"))
    )


INSTRUMENT_TYPES = ("stock", "stock", "stock", "etf", "crypto", "stock", "copyportfolio")


def snapshot_cash(spark, sf_dir) -> DataFrame:
    """Cash and net external flow per snapshot (as_of, cash, flow)."""
    c = cents("o_totalprice")
    low = F.col("o_orderpriority") == "5-LOW"
    first = F.col("o_orderpriority") == "1-URGENT"
    sign = F.when(F.col("o_orderstatus") == "O", -1).otherwise(1)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(_quarter_end(_day("o_orderdate")).alias("as_of"))
        .agg(F.coalesce(F.sum(F.when(low, c)), F.lit(0)).alias("cash"),
             F.coalesce(F.sum(F.when(first, c * sign)), F.lit(0)).alias("flow"))
        .select("as_of", (F.col("cash") / 100.0).alias("cash"), (F.col("flow") / 100.0).alias("flow"))
    )


# --- ledger -----------------------------------------------------------------

OUTCOMES = {"view": "ok", "click": "no_new_bar", "error": "failed",
            "purchase": "rate_limited", "signup": "no_data"}


def ledger(spark, sf_dir) -> DataFrame:
    """Append-only rows (ticker, day, ts, outcome, kind, value, seq)."""
    outcome = F.lit(None).cast("string")
    for kind, name in OUTCOMES.items():
        outcome = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(outcome)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ticker"), _day("ts").alias("day"), F.col("ts"),
        outcome.alias("outcome"), F.col("event_type").alias("kind"), "value",
        F.col("event_id").alias("seq"))


# --- the same relations in ANSI SQL, for the correctness check ----------------

def _pick(values, expr) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def _q_end(col) -> str:
    return f"CAST(date_trunc('quarter', {col}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"


def _slice_sql(parts) -> str:
    arms = " ".join(f"WHEN {cond} THEN {w}" for w, cond in parts)
    return f"SUM(c * CASE {arms} END)"


SQL_FACTS = f"""facts AS (
  SELECT o_custkey // 8 AS entity, o_orderpriority AS tag,
         CAST(date_trunc('quarter', o_orderdate) AS DATE) AS start_day,
         {_q_end('o_orderdate')} AS end_day, CAST(o_orderdate AS DATE) AS filed,
         o_orderstatus AS form, o_totalprice AS value, o_orderkey AS seq
  FROM orders)"""

SQL_CUMULATIVE = f"""qf AS (
  SELECT o_custkey // 8 AS entity, o_orderpriority AS tag,
         CAST(date_trunc('year', o_orderdate) AS DATE) AS start_day, {_q_end('o_orderdate')} AS end_day,
         SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS c, MAX(o_orderkey) AS seq
  FROM orders GROUP BY ALL),
cfacts AS (
  SELECT entity, tag, start_day, end_day, end_day + 30 AS filed, '10-Q' AS form,
         CAST(SUM(c) OVER (PARTITION BY entity, tag, start_day ORDER BY end_day) AS DOUBLE) / 100.0 AS value, seq
  FROM qf)"""

SQL_BARS = """bars AS (
  SELECT symbol, day, close, adj_close FROM (
    SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS day,
           l_extendedprice / l_quantity AS close,
           l_extendedprice / l_quantity * (1 - l_discount) AS adj_close,
           row_number() OVER (PARTITION BY l_suppkey, date_trunc('week', l_shipdate)
             ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC,
                      l_quantity DESC, l_discount DESC) AS rn
    FROM lineitem) WHERE rn = 1)"""

SQL_SPLITS = """splits AS (
  SELECT DISTINCT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, 2.0::DOUBLE AS ratio
  FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.10 AND l_returnflag = 'R')"""

SQL_SHARES = f"""share_counts AS (
  SELECT l_suppkey AS entity, {_q_end('l_shipdate')} AS end_day, CAST(l_shipdate AS DATE) AS filed,
         l_quantity * 1000 + l_linenumber AS value, l_orderkey AS seq
  FROM lineitem WHERE l_returnflag = 'R')"""

SQL_UNIVERSE = f"""universe AS (
  SELECT s_suppkey AS symbol,
         'T' || (s_suppkey // 3) || {_pick(('', 'W', '-B'), 's_suppkey % 3')} AS ticker,
         'Company ' || (s_suppkey // 3) || {_pick(SUFFIXES, f's_suppkey % {len(SUFFIXES)}')} AS name,
         r_name AS sector, n_name AS industry, {_pick(COUNTRIES, 'n_regionkey')} AS country,
         CASE WHEN s_acctbal >= 8000 THEN 'Mega Cap' WHEN s_acctbal >= 5000 THEN 'Large Cap'
              WHEN s_acctbal >= 2000 THEN 'Mid Cap' WHEN s_acctbal >= 0 THEN 'Small Cap' END AS cap_bucket,
         {_pick(EXCHANGES, f's_suppkey % {len(EXCHANGES)}')} AS exchange,
         CASE WHEN s_suppkey % 4 = 0 THEN 'usd ' WHEN s_suppkey % 4 = 1 THEN '' END AS currency,
         CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey // 3 END AS cik
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SQL_STATEMENTS = f"""su AS (
  SELECT l_suppkey AS entity, {_q_end('l_shipdate')} AS period_end,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_returnflag, l_linestatus, l_tax,
         l_discount, l_quantity FROM lineitem),
sq AS (SELECT entity, period_end, {', '.join(f'{_slice_sql(p)} AS {c}' for c, p in STATEMENT_SLICES.items())}
       FROM su GROUP BY ALL),
sa AS (SELECT entity, CAST(date_trunc('year', period_end) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
       {', '.join(f'SUM({c}) AS {c}' for c in LABELS)} FROM sq GROUP BY ALL),
stm AS (
  SELECT entity, 'quarterly' AS scope, period_end, {', '.join(f'CAST({c} AS DOUBLE) / 100000.0 AS {c}' for c in LABELS)} FROM sq
  UNION ALL
  SELECT entity, 'annual' AS scope, period_end, {', '.join(f'CAST({c} AS DOUBLE) / 100000.0 AS {c}' for c in LABELS)} FROM sa)"""

SQL_POSITIONS = f"""pos0 AS (
  SELECT {_q_end('l_shipdate')} AS as_of, l_suppkey AS symbol, SUM(CAST(l_quantity AS BIGINT)) AS q,
         SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS m
  FROM lineitem GROUP BY ALL),
positions AS (
  SELECT as_of, symbol, {_pick(INSTRUMENT_TYPES, f'symbol % {len(INSTRUMENT_TYPES)}')} AS instrument_type,
         {_pick(('EUR', 'USD', 'GBP'), 'symbol % 3')} AS currency, CAST(q AS DOUBLE) AS quantity,
         CAST(m AS DOUBLE) / 100.0 AS mv, CAST(m AS DOUBLE) / 100.0 / CAST(q AS DOUBLE) AS avg_open_price,
         CASE WHEN q % 20 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS leverage FROM pos0)"""

SQL_CASH = f"""cash0 AS (
  SELECT {_q_end('o_orderdate')} AS as_of,
    COALESCE(SUM(CASE WHEN o_orderpriority = '5-LOW' THEN CAST(round(o_totalprice * 100) AS BIGINT) END), 0) AS c,
    COALESCE(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(round(o_totalprice * 100) AS BIGINT)
             * CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END END), 0) AS f
  FROM orders GROUP BY ALL),
snapshot_cash AS (SELECT as_of, CAST(c AS DOUBLE) / 100.0 AS cash, CAST(f AS DOUBLE) / 100.0 AS flow FROM cash0)"""

SQL_LEDGER = f"""ledger AS (
  SELECT user_id AS ticker, CAST(ts AS DATE) AS day, ts,
         CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOMES.items())} END AS outcome,
         event_type AS kind, value, event_id AS seq FROM events)"""


# --- market indices and tick scores -------------------------------------------

def market_index(spark, sf_dir) -> DataFrame:
    """Benchmark (day, close): value per unit sold in each week, over all lines."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.trunc(_day("l_shipdate"), "week").alias("day"))
        .agg(F.sum(cents("l_extendedprice")).alias("c"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
        .select("day", (F.col("c") / 100.0 / F.col("q")).alias("close"))
    )


def sector_index(spark, sf_dir) -> DataFrame:
    """One weekly index per nation (asset, portfolio, day, close): 25 assets in 5
    portfolios, a fixed dimension whatever the scale."""
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey"), F.col("n_nationkey").cast("bigint").alias("asset"), F.col("n_regionkey").alias("portfolio"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        table(spark, sf_dir, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", F.trunc(_day("l_shipdate"), "week").alias("day"))
        .agg(F.sum(cents("l_extendedprice")).alias("c"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("asset", "portfolio", "day", (F.col("c") / 100.0 / F.col("q")).alias("close"))
    )


def tick_scores(spark, sf_dir) -> DataFrame:
    """Quarterly scores (tick, symbol, composite, grade): gross margin in percent
    at the quarter's last index day."""
    ticks = (market_index(spark, sf_dir).groupBy(F.trunc("day", "quarter").alias("q"))
             .agg(F.max("day").alias("tick")))
    s = statements(spark, sf_dir).where("scope = 'quarterly'")
    comp = F.round(100.0 * F.coalesce("gross_profit", F.lit(0.0)) / F.col("revenue"), 2)
    return (s.select("entity", F.trunc("period_end", "quarter").alias("q"), comp.alias("composite")).join(ticks, "q")
            .select("tick", F.col("entity").alias("symbol"), "composite",
                    F.when(F.col("composite") < 10, "VETOED").when(F.col("composite") >= 80, "A").when(F.col("composite") >= 65, "B")
                    .when(F.col("composite") >= 50, "C").when(F.col("composite") >= 35, "D").otherwise("F").alias("grade")))


SQL_INDEX = """idx AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS day,
  CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close
  FROM lineitem GROUP BY ALL)"""

SQL_SECTOR_INDEX = """sidx AS (SELECT CAST(s_nationkey AS BIGINT) AS asset, any_value(n_regionkey) AS portfolio, CAST(date_trunc('week', l_shipdate) AS DATE) AS day,
  CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey, CAST(date_trunc('week', l_shipdate) AS DATE))"""

SQL_TICKS = f"""{SQL_INDEX}, tickq AS (SELECT date_trunc('quarter', day) AS q, max(day) AS tick FROM idx GROUP BY ALL),
tick_scores AS (SELECT tick, entity AS symbol, round(100.0 * coalesce(gross_profit, 0) / revenue, 2) AS composite,
  CASE WHEN round(100.0 * coalesce(gross_profit, 0) / revenue, 2) < 10 THEN 'VETOED' WHEN round(100.0 * coalesce(gross_profit, 0) / revenue, 2) >= 80 THEN 'A'
    WHEN round(100.0 * coalesce(gross_profit, 0) / revenue, 2) >= 65 THEN 'B' WHEN round(100.0 * coalesce(gross_profit, 0) / revenue, 2) >= 50 THEN 'C'
    WHEN round(100.0 * coalesce(gross_profit, 0) / revenue, 2) >= 35 THEN 'D' ELSE 'F' END AS grade
  FROM stm JOIN tickq ON tickq.q = date_trunc('quarter', period_end) WHERE scope = 'quarterly')"""
