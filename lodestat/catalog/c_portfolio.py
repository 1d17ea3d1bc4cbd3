"""Portfolio snapshots, conversions, returns and holdings."""

from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog.registry import query, rnd, txt
from lodestat.operators import portfolio as P
from lodestat.session import stage

PO = f"WITH {R.SQL_POSITIONS}, {R.SQL_CASH}"
LAST = "(SELECT max(as_of) FROM positions)"


def positions(spark, d):
    return R.positions(spark, d)


def latest(spark, d):
    p = positions(spark, d)
    return p.where(F.col("as_of") == p.agg(F.max("as_of")).scalar())


def weighted(spark, d):
    return P.with_weights(positions(spark, d))


WGT = "wp AS (SELECT p.*, mv / (SUM(CAST(round(mv * 100) AS BIGINT)) OVER (PARTITION BY as_of) / 100.0) AS weight FROM positions p)"


@query("advice_view", f"{PO}, {WGT} SELECT {txt('as_of')}, symbol, instrument_type, quantity, currency, mv, round(weight, 8) AS weight, leverage FROM wp", digits=8)
def advice_view(spark, d):
    return P.advice(weighted(spark, d))


@query("public_projection", f"{PO} SELECT symbol, instrument_type, quantity FROM positions WHERE as_of = {LAST}")
def public_projection(spark, d):
    return P.assert_public(latest(spark, d).select("symbol", "instrument_type", "quantity"))


DESIG = "ds AS (SELECT l_suppkey AS symbol, arg_max(CASE WHEN l_linenumber % 2 = 0 THEN 'framework' ELSE 'outside_framework' END, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS s FROM lineitem WHERE l_tax = 0.08 AND l_discount = 0.0 GROUP BY l_suppkey)"
STATUS = "coalesce(s, CASE WHEN instrument_type IN ('crypto', 'copyportfolio', 'etf') THEN 'outside_framework' ELSE 'backfill_pending' END)"


def designations(spark, d):
    return R.table(spark, d, "lineitem").where("l_tax = 0.08 AND l_discount = 0.0").select(
        F.col("l_suppkey").alias("symbol"), F.when(F.col("l_linenumber") % 2 == 0, "framework").otherwise("outside_framework").alias("status"),
        F.col("l_shipdate").alias("valid_from"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))


@query("framework_status", f"{PO}, {DESIG} SELECT p.symbol, {STATUS} AS status FROM positions p LEFT JOIN ds ON ds.symbol = p.symbol WHERE as_of = {LAST}")
def framework_status(spark, d):
    return P.framework_status(latest(spark, d), designations(spark, d)).select("symbol", "status")


@query("instrument_type_map", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 5 THEN 'stock' WHEN 6 THEN 'etf' ELSE 'stock' END AS instrument_type FROM lineitem")
def instrument_type_map(spark, d):
    return R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.instrument_type(F.col("l_linenumber").cast("string")).alias("instrument_type"))


@query("snapshot_diff", f"""{PO}, st AS (SELECT as_of, lag(as_of) OVER (ORDER BY as_of) AS prev FROM (SELECT DISTINCT as_of FROM positions)),
  nw AS (SELECT p.* FROM positions p JOIN st ON st.as_of = p.as_of WHERE prev IS NOT NULL), od AS (SELECT st.as_of, symbol, quantity FROM positions p JOIN st ON st.prev = p.as_of),
  mv AS (SELECT coalesce(n.as_of, o.as_of) AS as_of, coalesce(n.symbol, o.symbol) AS symbol, CASE WHEN o.quantity IS NULL THEN 'appeared' WHEN n.quantity IS NULL THEN 'disappeared' WHEN o.quantity <> n.quantity THEN 'quantity_change' END AS kind,
    o.quantity AS old_value, n.quantity AS new_value FROM nw n FULL JOIN od o ON o.as_of = n.as_of AND o.symbol = n.symbol),
  ca AS (SELECT as_of, cash, lag(cash) OVER (ORDER BY as_of) AS old FROM snapshot_cash)
  SELECT {txt('as_of')}, symbol, kind, old_value, new_value FROM mv WHERE kind IS NOT NULL
  UNION ALL SELECT {txt('as_of')}, symbol, 'leverage_violation', 1.0, leverage FROM positions WHERE leverage > 1
  UNION ALL SELECT {txt('as_of')}, NULL, 'unexplained_cash', old, round(cash - old, 2) FROM ca WHERE abs(cash - old) > 1 AND as_of NOT IN (SELECT as_of FROM mv WHERE kind IN ('disappeared', 'quantity_change'))""", digits=2)
def snapshot_diff(spark, d):
    held = stage(positions(spark, d), "positions")
    return P.snapshot_diff(held, R.snapshot_cash(spark, d))


RATES = "rates AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'USD' ELSE 'GBP' END AS currency, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, CASE WHEN month(any_value(l_shipdate)) = 6 THEN 0 ELSE max(l_extendedprice) / 100000 END AS close FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL)"


def rates(spark, d):
    day = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return (R.table(spark, d, "lineitem").where("l_returnflag IN ('A', 'N')")
            .groupBy(F.when(F.col("l_returnflag") == "A", "USD").otherwise("GBP").alias("currency"), day.alias("day"))
            .agg((F.max("l_extendedprice") / 100000).alias("close"))
            .withColumn("close", F.when(F.month("day") == 6, 0.0).otherwise(F.col("close"))))      # a feed that is down each June


@query("fx_convert", f"""{PO}, {RATES} SELECT {txt('p.as_of', 'as_of')}, symbol, p.currency, round(mv * CASE WHEN p.currency = 'EUR' THEN 1.0 WHEN r.close > 0 THEN r.close END, 4) AS eur, CASE WHEN p.currency <> 'EUR' AND coalesce(r.close, 0) <= 0 THEN 'refused' ELSE 'ok' END AS fx_state
  FROM positions p ASOF LEFT JOIN rates r ON r.currency = p.currency AND p.as_of >= r.day""", digits=4)
def fx_convert(spark, d):
    p = positions(spark, d).select("as_of", "symbol", "currency", "mv")
    return P.to_eur(p, rates(spark, d)).select("as_of", "symbol", "currency", "eur", "fx_state")


THESES = "th AS (SELECT l_suppkey AS symbol, arg_max(CASE WHEN l_quantity < 10 THEN 'broken' WHEN l_quantity < 20 THEN 'under_review' ELSE 'intact' END, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS status, count(*) AS version FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY l_suppkey)"


def theses(spark, d):
    q = F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return (R.table(spark, d, "lineitem").where("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("symbol"))
            .agg(F.max_by(F.when(q < 10, "broken").when(q < 20, "under_review").otherwise("intact"), order).alias("status"), F.count("*").alias("version")))


@query("anti_thesisless", f"{PO}, {THESES} SELECT symbol, instrument_type, mv FROM positions WHERE as_of = {LAST} AND symbol NOT IN (SELECT symbol FROM th)", digits=2)
def anti_thesisless(spark, d):
    return latest(spark, d).join(theses(spark, d), "symbol", "left_anti").select("symbol", "instrument_type", "mv")


@query("broken_but_held", f"{PO}, {THESES} SELECT p.symbol FROM positions p JOIN th ON th.symbol = p.symbol WHERE as_of = {LAST} AND status = 'broken'")
def broken_but_held(spark, d):
    return latest(spark, d).join(theses(spark, d).where("status = 'broken'"), "symbol").select("symbol")


@query("revalidation_join", f"""{PO}, {THESES}, {DESIG}, sc AS (SELECT l_suppkey AS symbol, string_agg('T' || l_linenumber || ':' || n, ', ' ORDER BY l_linenumber) AS score FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 5 <> 0 GROUP BY ALL) GROUP BY l_suppkey)
  SELECT p.symbol, CASE WHEN th.status IS NOT NULL THEN th.status || ' (v' || th.version || ') · ' || coalesce(score, 'no armed triggers') WHEN {STATUS} = 'outside_framework' THEN 'outside framework (no thesis by design)' ELSE 'awaiting thesis ratification' END AS line
  FROM positions p LEFT JOIN th ON th.symbol = p.symbol LEFT JOIN sc ON sc.symbol = p.symbol LEFT JOIN ds ON ds.symbol = p.symbol WHERE as_of = {LAST}""")
def revalidation_join(spark, d):
    """Holding with status, version and trigger scorecard; a holding without a thesis is shown."""
    checks = (R.table(spark, d, "lineitem").where("l_returnflag = 'A' AND l_suppkey % 5 <> 0").groupBy(F.col("l_suppkey").alias("symbol"), "l_linenumber").agg(F.count("*").alias("n")))
    item = F.concat(F.lit("T"), F.col("l_linenumber").cast("string"), F.lit(":"), F.col("n").cast("string"))
    score = checks.groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("x")))), lambda s: s["x"]), ", ").alias("score"))
    j = P.framework_status(latest(spark, d), designations(spark, d)).withColumnRenamed("status", "fs").join(theses(spark, d), "symbol", "left").join(score, "symbol", "left")
    line = F.when(F.col("status").isNotNull(), F.concat("status", F.lit(" (v"), F.col("version").cast("string"), F.lit(") · "), F.coalesce("score", F.lit("no armed triggers")))).when(
        F.col("fs") == "outside_framework", "outside framework (no thesis by design)").otherwise("awaiting thesis ratification")
    return j.select("symbol", line.alias("line"))


@query("opportunity_lines", f"""{PO}, {THESES}, {R.SQL_STATEMENTS}, dn AS (SELECT entity, arg_max(ocf / nullif(basic_shares, 0), period_end) AS denom, max(period_end) AS pe FROM stm WHERE scope = 'annual' GROUP BY entity), {R.SQL_BARS},
  px AS (SELECT symbol, max(day) AS day, arg_max(close, day) AS price FROM bars GROUP BY symbol), x AS (SELECT p.symbol, p.mv, price / nullif(denom * 1000, 0) AS multiple, denom, day FROM positions p JOIN th ON th.symbol = p.symbol AND th.status = 'intact' LEFT JOIN dn ON dn.entity = p.symbol LEFT JOIN px ON px.symbol = p.symbol WHERE as_of = {LAST})
  SELECT symbol, round(CASE WHEN denom > 0 AND day >= DATE '2001-10-29' THEN multiple END, 6) AS multiple, CASE WHEN denom IS NULL OR denom <= 0 THEN 'denominator suspended' WHEN day < DATE '2001-10-29' THEN 'price stale' END AS suspended
  FROM x WHERE denom IS NULL OR denom <= 0 OR day < DATE '2001-10-29' OR multiple <= 0.8 * (5 + symbol % 20)""")
def opportunity_lines(spark, d):
    """Intact holdings at (1 - d) of their fair mid multiple or below; a stale or
    non-positive input gives a suspended line."""
    s = R.statements(spark, d).where("scope = 'annual'")
    dn = s.groupBy(F.col("entity").alias("symbol")).agg(F.max_by(F.try_divide("ocf", "basic_shares"), "period_end").alias("denom"))
    px = R.bars(spark, d).groupBy("symbol").agg(F.max("day").alias("day"), F.max_by("close", "day").alias("price"))
    j = latest(spark, d).join(theses(spark, d).where("status = 'intact'"), "symbol").join(dn, "symbol", "left").join(px, "symbol", "left")
    bad, old = F.col("denom").isNull() | (F.col("denom") <= 0), F.col("day") < F.lit("2001-10-29").cast("date")
    mult = F.try_divide("price", F.col("denom") * 1000)
    hit = mult <= 0.8 * (5 + F.col("symbol") % 20)
    return j.where(bad | old | hit).select("symbol", F.when(~bad & ~old, mult).alias("multiple"), F.when(bad, "denominator suspended").when(old, "price stale").alias("suspended"))


@query("aggregate_lots", """SELECT l_suppkey AS symbol, SUM(l_quantity) AS quantity, round(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0, 2) AS invested, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS opened_at, max(l_linenumber) AS leverage, count(*) AS lot_count,
  CASE WHEN arg_min(l_returnflag <> 'R', (l_orderkey, l_linenumber, l_partkey, l_shipdate)) THEN 'buy' ELSE 'sell' END AS direction, round(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 / SUM(l_quantity), 2) AS avg_open_price FROM lineitem GROUP BY l_suppkey""", digits=2)
def aggregate_lots(spark, d):
    lots = R.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_quantity").alias("units"), R.cents("l_extendedprice").alias("c"), F.col("l_shipdate").cast("date").alias("opened_at"),
        F.col("l_linenumber").alias("leverage"), (F.col("l_returnflag") != "R").alias("is_buy"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias("seq"))
    p = P.lots_to_positions(lots.withColumnRenamed("c", "amount"), ["symbol"])
    return p.withColumns({"invested": F.col("invested") / 100.0, "avg_open_price": F.col("avg_open_price") / 100.0})


@query("balance_report", f"""{PO}, {WGT}, {DESIG}, x AS (SELECT w.*, {STATUS} AS status FROM wp w LEFT JOIN ds ON ds.symbol = w.symbol),
  g AS (SELECT x.as_of, SUM(mv) AS invested, count(*) FILTER (status = 'framework') AS n_framework, count(*) FILTER (status = 'backfill_pending') AS n_backfill, count(*) FILTER (status = 'outside_framework') AS n_outside,
    count(*) FILTER (weight * 100 > 10) AS soft_breaches, count(*) FILTER (weight * 100 > 15) AS hard_breaches, coalesce(SUM(weight * 100) FILTER (status = 'outside_framework'), 0) AS outside_pct, coalesce(SUM(mv) FILTER (instrument_type IN ('crypto', 'copyportfolio')), 0) AS u,
    count(*) FILTER (leverage > 1) AS leverage_violations FROM x GROUP BY x.as_of), c AS (SELECT g.*, 100.0 * coalesce(cash, 0) / (invested + coalesce(cash, 0)) AS cash_pct FROM g LEFT JOIN snapshot_cash s ON s.as_of = g.as_of)
  SELECT {txt('as_of')}, round(cash_pct, 5) AS cash_pct, cash_pct BETWEEN 5 AND 20 AS cash_in_band, n_framework, n_backfill, n_outside, n_framework BETWEEN 10 AND 25 AS count_in_band, soft_breaches, hard_breaches, round(outside_pct, 5) AS outside_pct, outside_pct <= 25 AS outside_ok,
    round(100.0 * u / invested, 5) AS unpriced_pct, leverage_violations FROM c""", digits=5)
def balance_report(spark, d):
    return P.balance(P.framework_status(weighted(spark, d), designations(spark, d)), R.snapshot_cash(spark, d))


@query("modified_dietz", f"""{PO}, v AS (SELECT p.as_of, SUM(CAST(round(mv * 100) AS BIGINT)) / 100.0 + any_value(coalesce(cash, 0)) AS value, any_value(coalesce(flow, 0)) AS flow FROM positions p LEFT JOIN snapshot_cash s ON s.as_of = p.as_of GROUP BY p.as_of),
  s AS (SELECT *, lag(value) OVER (ORDER BY as_of) AS v0 FROM v), r AS (SELECT *, CASE WHEN v0 + 0.5 * flow <> 0 THEN (value - v0 - flow) / (v0 + 0.5 * flow) ELSE 0 END AS ret FROM s WHERE v0 IS NOT NULL)
  SELECT {txt('as_of')}, round(ret, 6) AS ret, round(product(1 + ret) OVER (ORDER BY r.as_of) - 1, 6) AS linked, abs(flow) / v0 * 100 > 5 AS large_flow FROM r""")
def modified_dietz(spark, d):
    mv = positions(spark, d).groupBy("as_of").agg((F.sum(F.rint(F.col("mv") * 100).cast("bigint")) / 100.0).alias("mv"))
    v = mv.join(R.snapshot_cash(spark, d), "as_of", "left").select("as_of", (F.col("mv") + F.coalesce("cash", F.lit(0.0))).alias("value"), F.coalesce("flow", F.lit(0.0)).alias("flow"))
    return P.dietz(v)


@query("dividend_receipts", f"""{PO}, {RATES}, dv AS (SELECT l_suppkey AS symbol, SUM(CAST(round(l_tax * 100) AS BIGINT)) / 100.0 AS per_share FROM lineitem WHERE l_shipdate > DATE '2001-06-30' AND l_tax > 0 GROUP BY l_suppkey),
  fx AS (SELECT currency, arg_max(close, day) AS rate FROM rates WHERE close > 0 GROUP BY currency)
  SELECT p.symbol, round(quantity * per_share * coalesce(CASE WHEN p.currency = 'EUR' THEN 1.0 ELSE rate END, 1.0), 4) AS received FROM positions p JOIN dv ON dv.symbol = p.symbol LEFT JOIN fx ON fx.currency = p.currency WHERE as_of = DATE '2001-06-30'""", digits=4)
def dividend_receipts(spark, d):
    """Quantity times dividends since the snapshot, in EUR."""
    dv = (R.table(spark, d, "lineitem").where("l_shipdate > TIMESTAMP_NTZ'2001-06-30 00:00:00' AND l_tax > 0").groupBy(F.col("l_suppkey").alias("symbol"))
          .agg((F.sum(F.rint(F.col("l_tax") * 100).cast("bigint")) / 100.0).alias("per_share")))
    fx = rates(spark, d).where("close > 0").groupBy("currency").agg(F.max_by("close", "day").alias("rate"))
    p = positions(spark, d).where("as_of = DATE'2001-06-30'").join(dv, "symbol").join(fx, "currency", "left")
    rate = F.when(F.col("currency") == "EUR", 1.0).otherwise(F.coalesce("rate", F.lit(1.0)))
    return p.select("symbol", (F.col("quantity") * F.col("per_share") * rate).alias("received"))


@query("excluded_weight", f"{PO}, {WGT} SELECT {txt('as_of')}, round(100 * SUM(CASE WHEN instrument_type IN ('crypto', 'copyportfolio') THEN weight ELSE 0 END), 5) AS excluded_pct FROM wp GROUP BY wp.as_of", digits=5)
def excluded_weight(spark, d):
    out = F.when(F.col("instrument_type").isin(*P.UNPRICED_TYPES), F.col("weight")).otherwise(0.0)
    return weighted(spark, d).groupBy("as_of").agg((100.0 * F.sum(out)).alias("excluded_pct"))


@query("records_appendix", f"{PO} SELECT symbol, round(coalesce(avg_open_price, 0) * quantity, 2) AS cost_basis, currency || ' (trade-date FX not recorded)' AS note FROM positions WHERE as_of = {LAST}", digits=2)
def records_appendix(spark, d):
    return latest(spark, d).select("symbol", (F.coalesce("avg_open_price", F.lit(0.0)) * F.col("quantity")).alias("cost_basis"), F.concat("currency", F.lit(" (trade-date FX not recorded)")).alias("note"))


@query("ffill_portfolio", f"""WITH {R.SQL_BARS}, {R.SQL_POSITIONS}, h AS (SELECT symbol, quantity, CASE currency WHEN 'USD' THEN 0.9 WHEN 'GBP' THEN 1.2 ELSE 1.0 END AS rate FROM positions WHERE as_of = {LAST}),
  days AS (SELECT DISTINCT day FROM bars JOIN h USING (symbol)), g AS (SELECT days.day, h.symbol, quantity, rate FROM days, h),
  f AS (SELECT g.*, b.close FROM g ASOF LEFT JOIN bars b ON b.symbol = g.symbol AND g.day >= b.day)
  SELECT {txt('day')}, round(SUM(CAST(round(close * quantity * rate * 100) AS BIGINT)) / 100.0 + 1000, 2) AS value FROM f GROUP BY f.day""", digits=2)
def ffill_portfolio(spark, d):
    rate = F.when(F.col("currency") == "USD", 0.9).when(F.col("currency") == "GBP", 1.2).otherwise(1.0)
    h = latest(spark, d).select("symbol", "quantity", rate.alias("rate"))
    return P.portfolio_series(h, R.bars(spark, d), F.lit(1000.0))


@query("backfill_queue", f"{PO}, {WGT}, {DESIG} SELECT w.symbol, round(weight, 6) AS weight FROM wp w LEFT JOIN ds ON ds.symbol = w.symbol WHERE as_of = {LAST} AND {STATUS} = 'backfill_pending'")
def backfill_queue(spark, d):
    w = P.with_weights(latest(spark, d))
    return P.framework_status(w, designations(spark, d)).where("status = 'backfill_pending'").orderBy(F.desc("weight"), F.desc("mv")).select("symbol", "weight")


@query("ordered_distinct", f"""{PO}, a AS (SELECT 'S' || symbol AS ticker, 0 AS grp FROM positions WHERE as_of = {LAST} UNION ALL SELECT DISTINCT 'S' || o_custkey, 1 FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT DISTINCT currency || 'EUR=X', 2 FROM positions WHERE currency <> 'EUR')
  SELECT ticker, min(grp) AS grp FROM a GROUP BY ticker""")
def ordered_distinct(spark, d):
    """Held, watched and currency tickers, each once in that order."""
    s = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    held = latest(spark, d).select(s("symbol").alias("ticker"), F.lit(0).alias("grp"))
    watch = R.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(s("o_custkey").alias("ticker"), F.lit(1).alias("grp"))
    fx = positions(spark, d).where("currency <> 'EUR'").select(F.concat("currency", F.lit("EUR=X")).alias("ticker"), F.lit(2).alias("grp"))
    return held.unionByName(watch).unionByName(fx).groupBy("ticker").agg(F.min("grp").alias("grp")).orderBy("grp", "ticker")


@query("entry_verdict", """WITH x AS (SELECT o_orderkey AS item, o_orderstatus = 'P' AS vetoed, o_totalprice / 20000 AS multiple, 8.0 AS lo, 16.0 AS hi, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END AS conviction FROM orders),
  v AS (SELECT *, CASE WHEN vetoed THEN 'PASS' WHEN multiple <= 0.8 * (lo + hi) / 2 AND conviction <> 'low' THEN 'BUY_READY' ELSE 'WATCH' END AS verdict FROM x)
  SELECT item, verdict, CASE WHEN verdict = 'BUY_READY' THEN CASE conviction WHEN 'high' THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END END AS size_pct FROM v""")
def entry_verdict(spark, d):
    p = F.col("o_orderpriority")
    x = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_orderstatus") == "P").alias("vetoed"), (F.col("o_totalprice") / 20000).alias("multiple"),
                                           F.lit(8.0).alias("band_low"), F.lit(16.0).alias("band_high"), F.when(p == "1-URGENT", "high").when(p == "2-HIGH", "medium").otherwise("low").alias("conviction"))
    return P.entry_verdict(x).select("item", "verdict", "size_pct")
