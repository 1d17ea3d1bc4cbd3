"""Price series, ticks, cohorts and market-data checks."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog.registry import query, rnd, txt
from lodestat.operators import asof, cohorts, pit, series  # noqa: F401
from lodestat.session import stage, staged

B = f"WITH {R.SQL_BARS}"
RET = "rets AS (SELECT symbol, day, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM bars WHERE adj_close > 0 QUALIFY ret IS NOT NULL)"
LEV = "lev AS (SELECT symbol, day, adj_close / first_value(adj_close) OVER (PARTITION BY symbol ORDER BY day) AS level FROM bars WHERE adj_close > 0)"


def dd_sql(src, value, key, day):
    """Deepest fall in plain SQL over (key, day, value)."""
    return f"""ddp AS (SELECT {key} AS k, {day} AS d, {value} AS v, max({value}) OVER (PARTITION BY {key} ORDER BY {day}) AS peak,
    max({value}) OVER (PARTITION BY {key} ORDER BY {day} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM {src}),
  ddf AS (SELECT *, CASE WHEN peak > 0 THEN (v - peak) / peak END AS fall,
    (SELECT min(x.d) FROM ddp x WHERE x.k = ddp.k AND x.v = ddp.peak AND x.d <= ddp.d) AS peak_day FROM ddp),
  ddw AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fall NULLS LAST, d) AS rn, count(*) OVER (PARTITION BY k) AS bars,
    bool_or(peak > 0) OVER (PARTITION BY k) AS positive_peaks FROM ddf),
  dd AS (SELECT k, fall AS drawdown, peak, peak_day, v AS trough, d AS trough_day, coalesce(later >= peak * (1 - 1e-9), false) AS recovered, positive_peaks, bars FROM ddw WHERE rn = 1)"""


@query("period_returns", f"{B}, {RET} SELECT symbol, {txt('day')}, {rnd('ret')} FROM rets")
def period_returns(spark, d):
    return series.returns(R.bars(spark, d))


@query("cumulative_level", f"{B}, {LEV} SELECT symbol, {txt('day')}, {rnd('level')} FROM lev")
def cumulative_level(spark, d):
    return series.levels(R.bars(spark, d))


@query("max_drawdown", f"""{B}, {LEV}, {dd_sql('lev', 'level', 'symbol', 'day')}
  SELECT k AS symbol, {rnd('drawdown')}, {txt('peak_day')}, {txt('trough_day')}, recovered, bars FROM dd""")
def max_drawdown(spark, d):
    return series.drawdown(series.levels(R.bars(spark, d)), "level").select(
        "symbol", "drawdown", "peak_day", "trough_day", "recovered", "bars")


MOM = f"""mom AS (SELECT symbol, count(*) AS bars, skewness(ret) AS skew, kurtosis(ret) AS excess_kurtosis, count(*) FILTER (ret > 0) AS gains, count(*) FILTER (ret < 0) AS losses,
   quantile_cont(ret, 0.95) FILTER (ret > 0) AS r, quantile_cont(ret, 0.05) FILTER (ret < 0) AS l FROM rets GROUP BY symbol),
  mo AS (SELECT *, CASE WHEN gains >= 20 AND losses >= 20 AND l < 0 THEN r / abs(l) END AS tail_ratio FROM mom)"""


@query("skew_kurtosis", f"{B}, {RET}, {MOM} SELECT symbol, bars, {rnd('skew', digits=4)}, {rnd('excess_kurtosis', digits=4)} FROM mo", digits=4)
def skew_kurtosis(spark, d):
    return series.moments(series.returns(R.bars(spark, d))).select("symbol", "bars", "skew", "excess_kurtosis")


@query("tail_ratio", f"{B}, {RET}, {MOM} SELECT symbol, gains, losses, {rnd('tail_ratio')} FROM mo")
def tail_ratio(spark, d):
    return series.moments(series.returns(R.bars(spark, d))).select("symbol", "gains", "losses", "tail_ratio")


@query("annual_vol", f"{B}, {RET} SELECT symbol, round(CASE WHEN count(*) >= 51 THEN stddev_pop(ret) * sqrt(52) END, 5) AS vol FROM rets GROUP BY symbol", digits=5)
def annual_vol(spark, d):
    """Yearly volatility of weekly returns; at least 52 bars."""
    return series.returns(R.bars(spark, d)).groupBy("symbol").agg(
        F.when(F.count("ret") >= 51, F.stddev_pop("ret") * F.sqrt(F.lit(52.0))).alias("vol"))


@query("probe_price_drawdown", f"""{B}, {LEV}, {dd_sql('lev', 'level', 'symbol', 'day')}
  SELECT k AS symbol, bars - 1 >= 52 AS measured, CASE WHEN bars - 1 < 52 THEN 'none' WHEN drawdown <= -0.6 AND NOT recovered THEN 'severe'
    WHEN drawdown <= -0.6 OR (drawdown <= -0.4 AND NOT recovered) THEN 'caution' ELSE 'none' END AS severity,
    CASE WHEN bars - 1 >= 52 THEN round(drawdown, 6) END AS value FROM dd""")
def probe_price_drawdown(spark, d):
    from lodestat.operators import fragility
    return fragility.price_drawdown(fragility.falls(R.bars(spark, d)))


@query("probe_asymmetry", f"""{B}, {RET}, {MOM} SELECT symbol, bars >= 52 AS measured, CASE WHEN bars < 52 THEN 'none' WHEN skew < -0.5 AND coalesce(tail_ratio < 0.9, false) THEN 'severe'
    WHEN skew < -0.5 OR coalesce(tail_ratio < 0.9, false) THEN 'caution' ELSE 'none' END AS severity, CASE WHEN bars >= 52 THEN round(skew, 4) END AS value FROM mo""", digits=4)
def probe_asymmetry(spark, d):
    from lodestat.operators import fragility
    return fragility.return_asymmetry(R.bars(spark, d))


TICK = f"WITH {R.SQL_INDEX}, ticks AS (SELECT max(day) AS tick FROM idx GROUP BY date_trunc('quarter', day))"


@query("quarter_ticks", f"{TICK} SELECT {txt('tick')} FROM ticks")
def quarter_ticks(spark, d):
    return series.quarter_ticks(R.market_index(spark, d))


def ticks(spark, d):
    return staged(spark, d, "ticks", lambda: quarter_ticks(spark, d))


FWD = f"""{R.SQL_BARS}, ft AS (SELECT tick, lead(tick) OVER (ORDER BY tick) AS next_tick FROM ticks),
  life AS (SELECT symbol, max(day) AS last FROM bars GROUP BY symbol),
  per AS (SELECT symbol, tick, next_tick, last >= tick AS alive FROM life, ft),
  apx AS (SELECT p.*, b.adj_close, b.close FROM per p ASOF LEFT JOIN bars b ON b.symbol = p.symbol AND p.tick >= b.day),
  fwd AS (SELECT symbol, tick, next_tick, alive, close, CASE WHEN adj_close > 0 THEN lead(adj_close) OVER (PARTITION BY symbol ORDER BY tick) / adj_close - 1 END AS fwd FROM apx)"""


@query("forward_return", f"{TICK}, {FWD} SELECT symbol, {txt('tick')}, {txt('next_tick')}, {rnd('fwd')} FROM fwd")
def forward_return(spark, d):
    f = cohorts.forward_returns(ticks(spark, d), staged(spark, d, "bars", lambda: R.bars(spark, d)))
    return f.select("symbol", "tick", "next_tick", "fwd")


@query("alive_at", f"{TICK}, {R.SQL_BARS}, b2 AS (SELECT symbol, CASE WHEN symbol % 4 = 0 THEN day - 600 ELSE day END AS day FROM bars), life AS (SELECT symbol, max(day) AS last FROM b2 GROUP BY symbol) SELECT {txt('tick')}, count(*) FILTER (last >= tick) AS alive, count(*) FILTER (last < tick) AS dead FROM life, ticks GROUP BY ticks.tick")
def alive_at(spark, d):
    """Series still running at each tick: counts by last day, summed from the end."""
    bars = R.bars(spark, d).withColumn("day", F.expr("if(symbol % 4 = 0, date_sub(day, 600), day)"))
    life = bars.groupBy("symbol").agg(F.max("day").alias("last"))
    ends = life.groupBy("last").agg(F.count("*").alias("n"))            # one row per day
    marks = ends.select(F.col("last").alias("at"), "n", F.lit(None).cast("date").alias("tick")).unionByName(
        quarter_ticks(spark, d).select(F.col("tick").alias("at"), F.lit(0).cast("bigint").alias("n"), "tick"))
    order = W.orderBy("at", F.col("tick").isNull()).rowsBetween(W.unboundedPreceding, 0)
    dead = F.sum("n").over(order)
    total = ends.agg(F.sum("n")).scalar()
    return marks.select("tick", (total - dead).alias("alive"), dead.alias("dead")).where("tick IS NOT NULL")


@query("benchmark_track", f"{TICK}, t2 AS (SELECT tick, close FROM ticks JOIN idx ON day = tick) SELECT {txt('tick')}, round(close / first_value(close) OVER (ORDER BY tick), 6) AS track FROM t2")
def benchmark_track(spark, d):
    idx = R.market_index(spark, d)
    at = idx.join(series.quarter_ticks(idx), F.col("day") == F.col("tick"))
    return at.select("tick", (F.col("close") / F.first("close").over(W.orderBy("tick").rowsBetween(W.unboundedPreceding, 0))).alias("track"))


SCORED = f"WITH {R.SQL_STATEMENTS}, {R.SQL_TICKS}, ticks AS (SELECT tick FROM tickq), {FWD}, sf AS (SELECT s.*, f.fwd, f.alive, f.close, f.next_tick FROM tick_scores s JOIN fwd f ON f.symbol = s.symbol AND f.tick = s.tick)"


def scored_forward(spark, d):
    def build():
        f = cohorts.forward_returns(ticks(spark, d), staged(spark, d, "bars", lambda: R.bars(spark, d)))
        return R.tick_scores(spark, d).join(f, ["tick", "symbol"])
    return staged(spark, d, "tick-scores", build)


@query("candidates_at", f"""{SCORED} SELECT {txt('tick')}, symbol, composite, row_number() OVER (PARTITION BY sf.tick ORDER BY composite DESC, symbol) AS rank
  FROM sf WHERE grade <> 'VETOED' AND alive AND close IS NOT NULL""", digits=2)
def candidates_at(spark, d):
    ok = scored_forward(spark, d).where("grade <> 'VETOED' AND alive AND close IS NOT NULL").select("tick", "symbol", "composite")
    return cohorts.rank_order(ok, ["tick"], "composite", "symbol")


@query("band_cohorts", f"""{SCORED}, bands(grade) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('F'), ('VETOED'))
  SELECT bands.grade, count(fwd) AS name_quarters, round(100 * avg(fwd), 4) AS mean_quarter_return_pct FROM bands LEFT JOIN sf ON sf.grade = bands.grade AND alive GROUP BY bands.grade""", digits=4)
def band_cohorts(spark, d):
    bands = spark.createDataFrame([(b,) for b in ("A", "B", "C", "D", "F", "VETOED")], "grade string")
    g = scored_forward(spark, d).where("alive").groupBy("grade").agg(
        F.count("fwd").alias("name_quarters"), (100.0 * F.avg("fwd")).alias("mean_quarter_return_pct"))
    return bands.join(g, "grade", "left").fillna(0, ["name_quarters"])


EDGES = (("1-15", 1, 15), ("16-50", 16, 50), ("51-100", 51, 100), ("101+", 101, None))
HALF = "1998-06-30"


@query("rank_cohorts", f"""{SCORED}, rk AS (SELECT *, row_number() OVER (PARTITION BY tick ORDER BY composite DESC, symbol) AS rank FROM sf WHERE alive AND close IS NOT NULL),
  bk AS (SELECT tick, CASE WHEN rank <= 15 THEN '1-15' WHEN rank <= 50 THEN '16-50' WHEN rank <= 100 THEN '51-100' ELSE '101+' END AS bucket, avg(fwd) AS mean FROM rk WHERE fwd IS NOT NULL GROUP BY ALL),
  sc AS (SELECT *, 'whole' AS scope FROM bk UNION ALL SELECT *, CASE WHEN tick <= DATE '{HALF}' THEN 'A' ELSE 'B' END FROM bk)
  SELECT bucket, scope, count(*) AS periods, round(ln(product(1 + mean)), 4) AS log_growth FROM sc GROUP BY bucket, scope""", digits=4)
def rank_cohorts(spark, d):
    """Rank buckets, equal weight, compounded per half and whole; growth as a log."""
    ok = scored_forward(spark, d).where("alive AND close IS NOT NULL")
    totals = ok.groupBy("tick").agg(F.sum("fwd").alias("s"), F.count("fwd").alias("n"))
    top = cohorts.top_per_group(ok.select("tick", "symbol", "composite", "fwd"), ["tick"], [F.desc("composite"), "symbol"], 100)
    means = cohorts.bucket_returns(top, totals, EDGES)
    half = F.when(F.col("tick") <= F.lit(HALF).cast("date"), "A").otherwise("B")
    scoped = means.withColumn("scope", F.explode(F.array(F.lit("whole"), half)))
    return scoped.groupBy("bucket", "scope").agg(F.count("*").alias("periods"), F.sum(F.log1p("mean")).alias("log_growth"))


TOPN = 20
HOLD = f"""hold AS (SELECT tick, symbol, 1.0 / count(*) OVER (PARTITION BY tick) AS weight, coalesce(fwd, 0) AS fwd, next_tick FROM (
   SELECT *, row_number() OVER (PARTITION BY tick ORDER BY composite DESC, symbol) AS rk FROM sf WHERE grade <> 'VETOED' AND alive AND close IS NOT NULL) WHERE rk <= {TOPN}),
  gr AS (SELECT tick, 1 + sum(weight * fwd) AS factor FROM hold GROUP BY tick),
  dr AS (SELECT next_tick AS tick, symbol, weight * (1 + fwd) / factor AS old FROM hold JOIN gr USING (tick) WHERE factor > 0 AND next_tick IS NOT NULL),
  ch AS (SELECT coalesce(h.tick, o.tick) AS tick, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) AS turnover FROM hold h FULL JOIN dr o ON o.tick = h.tick AND o.symbol = h.symbol GROUP BY 1)"""


def holdings(spark, d):
    ok = scored_forward(spark, d).where("grade <> 'VETOED' AND alive AND close IS NOT NULL").select("tick", "symbol", "composite", "fwd")
    top = cohorts.top_per_group(ok, ["tick"], [F.desc("composite"), "symbol"], TOPN)
    return stage(top.withColumn("weight", F.lit(1.0) / F.count("*").over(W.partitionBy("tick"))), "holdings")


@query("turnover", f"{SCORED}, {HOLD} SELECT {txt('tick')}, {rnd('turnover')} FROM ch")
def turnover(spark, d):
    return cohorts.weight_changes(holdings(spark, d), ticks(spark, d))


@query("equal_weight_nav", f"""{SCORED}, {HOLD}, st AS (SELECT ch.tick, turnover, factor, (1 - 0.001 * turnover) * factor AS step FROM ch JOIN gr ON gr.tick = ch.tick WHERE ch.tick < (SELECT max(tick) FROM ticks))
  SELECT {txt('tick')}, round(sum(ln(step)) OVER (ORDER BY tick), 5) AS log_nav FROM st""", digits=5)
def equal_weight_nav(spark, d):
    """Equal-weight top holdings with 10 bp cost on turnover, compounded (as a log)."""
    h = holdings(spark, d)
    t = ticks(spark, d)
    growth = h.groupBy("tick").agg((1.0 + F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0)))).alias("factor"))
    steps = (cohorts.weight_changes(h, t).join(growth, "tick").join(series.following(t), "tick").where("next_tick IS NOT NULL")
             .select("tick", F.log((1.0 - 0.001 * F.col("turnover")) * F.col("factor")).alias("step")))
    return steps.select("tick", F.sum("step").over(W.orderBy("tick").rowsBetween(W.unboundedPreceding, 0)).alias("log_nav"))


@query("last_k_all", f"{B} SELECT symbol, CASE WHEN count(*) >= 6 THEN bool_and(close < 2500) END AS holds FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM bars) WHERE rn <= 6 GROUP BY symbol")
def last_k_all(spark, d):
    return series.last_k_all(R.bars(spark, d), "symbol", "day", 6, F.col("close") < 2500)


@query("row_window_move", f"{B}, w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM bars) SELECT symbol, CASE WHEN count(*) >= 2 THEN round(100 * (arg_max(close, day) / arg_min(close, day) - 1), 4) END AS move_pct FROM w WHERE rn <= 22 GROUP BY symbol", digits=4)
def row_window_move(spark, d):
    """Percent move across the last 22 rows."""
    last = cohorts.top_per_group(R.bars(spark, d), ["symbol"], [F.desc("day")], 22)
    return last.groupBy("symbol").agg(F.when(F.count("*") >= 2, 100.0 * (F.max_by("close", "day") / F.min_by("close", "day") - 1.0)).alias("move_pct"))


@query("returns_frame", f"{B}, {RET} SELECT symbol, {txt('day')}, {rnd('ret')} FROM rets QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rets.day DESC) <= 252")
def returns_frame(spark, d):
    return cohorts.top_per_group(series.returns(R.bars(spark, d)), ["symbol"], [F.desc("day")], 252).drop("rank")


@query("weekdays_behind", f"""{B}, l AS (SELECT symbol, max(day) AS day FROM bars GROUP BY symbol), x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, DATE '1998-07-01' AS b FROM orders)
  SELECT o_orderkey, (SELECT count(*) FROM range(CASE WHEN a + 1 < b THEN b - a - 1 ELSE 0 END) t(i) WHERE isodow(a + 1 + CAST(i AS INTEGER)) < 6) AS behind FROM x""")
def weekdays_behind(spark, d):
    """Weekdays strictly between each order day and a date, in closed form."""
    return R.table(spark, d, "orders").select("o_orderkey", series.weekdays_between(
        F.col("o_orderdate").cast("date"), F.lit("1998-07-01").cast("date")).cast("bigint").alias("behind"))


@query("freshness", "SELECT o_orderkey, CASE WHEN DATE '2001-06-30' - CAST(o_orderdate AS DATE) BETWEEN 0 AND 45 THEN 'FRESH' ELSE 'STALE' END AS state FROM orders")
def freshness(spark, d):
    return R.table(spark, d, "orders").select("o_orderkey", series.freshness(F.col("o_orderdate").cast("date"), F.lit("2001-06-30").cast("date")).alias("state"))


@query("calendar", """SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, CAST(CAST(o_orderdate AS DATE) + CAST((6 - dayofweek(o_orderdate) + 7) % 7 AS INTEGER) AS VARCHAR) AS saturday,
  isodow(o_orderdate) < 6 AS weekday, CASE WHEN (DATE '2002-01-01' - CAST(o_orderdate AS DATE)) / 365.25 < 5 THEN '5Y' ELSE '10Y' END AS span FROM orders""")
def calendar(spark, d):
    """Quarter key, the Saturday on or after, weekday flag, smallest span covering a start."""
    day = F.col("o_orderdate").cast("date")
    return R.table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")).alias("quarter"),
        F.next_day(F.date_sub(day, 1), "Sat").alias("saturday"), (F.weekday(day) < 5).alias("weekday"),
        F.when(F.datediff(F.lit("2002-01-01").cast("date"), day) / 365.25 < 5, "5Y").otherwise("10Y").alias("span"))


@query("grid_degraded", f"{B} SELECT symbol, bool_or(adj_close > 0.95 * close AND day > DATE '2001-10-01') AS degraded FROM bars GROUP BY symbol")
def grid_degraded(spark, d):
    """Symbols with any bar lacking a raw close (closes of late small-discount weeks are blanked)."""
    blank = F.when(~((F.col("adj_close") > 0.95 * F.col("close")) & (F.col("day") > F.lit("2001-10-01").cast("date"))), F.col("close"))
    return R.bars(spark, d).withColumn("close", blank).groupBy("symbol").agg(F.bool_or(F.col("close").isNull()).alias("degraded"))


@query("split_unadjusted", f"WITH {R.SQL_SPLITS} SELECT s_suppkey AS symbol FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey NOT IN (SELECT symbol FROM splits)")
def split_unadjusted(spark, d):
    basis = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol")).where("symbol % 3 <> 0")
    return basis.join(R.splits(spark, d), "symbol", "left_anti")


@query("date_intersection", """WITH a AS (SELECT date_trunc('day', l_shipdate) AS day, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
  b AS (SELECT o_orderdate AS day, max(o_totalprice) AS fx FROM orders GROUP BY ALL)
  SELECT CAST(CAST(a.day AS DATE) AS VARCHAR) AS day, v AS usd, fx AS rate, round(v * fx / 1000000, 4) AS eur FROM a JOIN b ON a.day = b.day""", digits=4)
def date_intersection(spark, d):
    """Index series times currency series on their common days."""
    a = (R.table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_shipdate").cast("date").alias("day"))
         .agg((F.sum(R.cents("l_extendedprice")) / 100.0).alias("usd")))
    b = R.table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.max("o_totalprice").alias("rate"))
    return a.join(b, "day").select("day", "usd", "rate", (F.col("usd") * F.col("rate") / 1000000).alias("eur"))


SRET = "sret AS (SELECT asset, portfolio, day, close / lag(close) OVER (PARTITION BY asset ORDER BY day) - 1 AS ret FROM sidx QUALIFY ret IS NOT NULL)"


def asset_returns(spark, d):
    idx = R.sector_index(spark, d)
    w = W.partitionBy("asset").orderBy("day")
    return idx.select("asset", F.col("portfolio").cast("bigint").alias("portfolio"), "day", (F.col("close") / F.lag("close").over(w) - 1.0).alias("ret")).where("ret IS NOT NULL")


@query("correlation_matrix", f"""WITH {R.SQL_SECTOR_INDEX}, {SRET}, ok AS (SELECT portfolio, asset FROM sret GROUP BY ALL HAVING count(*) >= 120),
  r AS (SELECT sret.* FROM sret SEMI JOIN ok ON ok.asset = sret.asset), okn AS (SELECT portfolio, count(*) AS k FROM ok GROUP BY ALL), rd AS (SELECT portfolio, day, count(*) AS k FROM r GROUP BY ALL),
  full_days AS (SELECT rd.portfolio, rd.day FROM rd JOIN okn ON okn.portfolio = rd.portfolio AND okn.k = rd.k),
  c AS (SELECT r.* FROM r SEMI JOIN full_days f ON f.portfolio = r.portfolio AND f.day = r.day)
  SELECT CAST(x.portfolio AS BIGINT) AS portfolio, x.asset AS a, y.asset AS b, round(corr(x.ret, y.ret), 5) AS rho
  FROM c x JOIN c y ON x.day = y.day AND x.portfolio = y.portfolio AND x.asset < y.asset GROUP BY ALL""", digits=5)
def correlation_matrix(spark, d):
    return series.correlations(asset_returns(spark, d))


@query("udaf_linkage")
def udaf_linkage(spark, d):
    return series.linkage_clusters(series.correlations(asset_returns(spark, d)), threshold=0.05)


@query("cluster_weights")
def cluster_weights(spark, d):
    """Cluster weights and effective bets of each portfolio (weights: value sold)."""
    members = udaf_linkage(spark, d)
    weights = R.sector_index(spark, d).groupBy(F.col("portfolio").cast("bigint").alias("portfolio"), "asset").agg(F.sum("close").alias("v"))
    w = members.join(weights, ["portfolio", "asset"]).groupBy("portfolio", "cluster").agg(F.sum("v").alias("v"), F.count("*").alias("assets"))
    share = w.withColumn("weight", F.col("v") / F.sum("v").over(W.partitionBy("portfolio")))
    return share.withColumn("n_eff", 1.0 / F.sum(F.pow("weight", 2)).over(W.partitionBy("portfolio"))).drop("v")


@query("return_stats", f"""WITH {R.SQL_SECTOR_INDEX}, {SRET}, {R.SQL_INDEX}, br AS (SELECT day, close / lag(close) OVER (ORDER BY day) - 1 AS ret FROM idx),
  b AS (SELECT exp(sum(ln(1 + ret))) - 1 AS bench FROM br), cu AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY asset ORDER BY day)) AS curve FROM sret),
  dd AS (SELECT *, curve / max(curve) OVER (PARTITION BY asset ORDER BY day) - 1 AS fall FROM cu)
  SELECT asset, round(exp(sum(ln(1 + ret))) - 1, 5) AS period_return, round(exp(sum(ln(1 + ret))) - 1 - any_value(bench), 5) AS vs_benchmark_simple,
    round(min(fall), 5) AS max_drawdown, round(stddev_samp(ret) * sqrt(252), 5) AS volatility FROM dd, b GROUP BY asset""", digits=5)
def return_stats(spark, d):
    """Cumulative return, against the benchmark, deepest fall, yearly volatility."""
    r = asset_returns(spark, d)
    bench = series.returns(R.market_index(spark, d).withColumn("k", F.lit(0)), "close", "k").agg(F.exp(F.sum(F.log1p("ret"))) - 1.0).scalar()
    run = W.partitionBy("asset").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    curve = r.withColumn("curve", F.exp(F.sum(F.log1p("ret")).over(run)))
    fall = curve.withColumn("fall", F.col("curve") / F.max("curve").over(run) - 1.0)
    total = F.exp(F.sum(F.log1p("ret"))) - 1.0
    return fall.groupBy("asset").agg(total.alias("period_return"), F.min("fall").alias("max_drawdown"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility")).withColumn(
        "vs_benchmark_simple", F.col("period_return") - bench)


@query("trailing_returns", f"""WITH {R.SQL_SECTOR_INDEX}, m AS (SELECT max(day) AS as_of FROM sidx), x AS (SELECT sidx.*, as_of FROM sidx, m)
  SELECT asset, round(100 * (arg_max(close, day) / arg_min(close, day) - 1), 4) AS inception_pct,
    round(100 * (arg_max(close, day) FILTER (day >= as_of - 365) / arg_min(close, day) FILTER (day >= as_of - 365) - 1), 4) AS ttm_pct,
    round(100 * (arg_max(close, day) FILTER (day >= date_trunc('quarter', as_of)) / arg_min(close, day) FILTER (day >= date_trunc('quarter', as_of)) - 1), 4) AS quarter_pct
  FROM x GROUP BY asset""", digits=4)
def trailing_returns(spark, d):
    """Percent since inception, in 12 months, and in the quarter."""
    idx = R.sector_index(spark, d)
    as_of = idx.agg(F.max("day")).scalar()
    rows = idx.withColumn("as_of", as_of)

    def move(cond):
        c, k = F.when(cond, F.col("close")), F.when(cond, F.col("day"))
        return 100.0 * (F.max_by(c, k) / F.min_by(c, k) - 1.0)
    return rows.groupBy("asset").agg(
        move(F.lit(True)).alias("inception_pct"), move(F.col("day") >= F.date_sub("as_of", 365)).alias("ttm_pct"),
        move(F.col("day") >= F.trunc("as_of", "quarter")).alias("quarter_pct"))


@query("drawdown_share_change", f"""WITH {R.SQL_BARS}, {LEV}, {dd_sql('lev', 'level', 'symbol', 'day')}, {R.SQL_SHARES},
  ob AS (SELECT entity, end_day, arg_max(value, (filed, seq, value)) AS value FROM share_counts GROUP BY ALL),
  p AS (SELECT dd.k, dd.peak_day, dd.trough_day, ob.value AS at_peak FROM dd ASOF LEFT JOIN ob ON ob.entity = dd.k AND dd.peak_day >= ob.end_day)
  SELECT p.k AS symbol, {txt('peak_day')}, {txt('trough_day')}, at_peak, ob.value AS at_trough, round(ob.value / at_peak - 1, 6) AS change
  FROM p ASOF LEFT JOIN ob ON ob.entity = p.k AND p.trough_day >= ob.end_day""")
def drawdown_share_change(spark, d):
    """Share count at the peak and at the trough of the deepest fall."""
    fall = series.drawdown(series.levels(R.bars(spark, d)), "level").select(F.col("symbol").alias("entity"), "peak_day", "trough_day")
    counts = R.share_counts(spark, d).groupBy("entity", "end_day").agg(F.max_by("value", F.struct("filed", "seq", "value")).alias("value"))
    p = asof.asof_join(fall, counts.withColumnRenamed("value", "at_peak"), "entity", "peak_day", "end_day", ("at_peak",)).drop("end_day_at")
    t = asof.asof_join(p, counts.withColumnRenamed("value", "at_trough"), "entity", "trough_day", "end_day", ("at_trough",)).drop("end_day_at")
    return t.select(F.col("entity").alias("symbol"), "peak_day", "trough_day", "at_peak", "at_trough", (F.col("at_trough") / F.col("at_peak") - 1.0).alias("change"))
