"""Valuation, the absolute card, the low-cap lane and shortlists."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestat import relations as R
from lodestat.catalog import sqlcard, sqlx
from lodestat.catalog.c_fragile import EV, annual, findings
from lodestat.catalog.c_grading import evaluated, prepared, share_series
from lodestat.catalog.registry import query, rnd, txt
from lodestat.functions import valuation as V
from lodestat.operators import card as C
from lodestat.operators import cohorts, ranks, series
from lodestat.operators import fragility as X
from lodestat.operators import statements as S
from lodestat.plans import lowcap as LC
from lodestat.session import stage, staged

MOS = f"{EV}, {sqlcard.MOS}"
YRS = f"{EV}, {sqlcard.YEARS}"


def inputs(spark, d):
    """(evaluated, statements) staged once."""
    return prepared(spark, d)[:2]


def valued(spark, d):
    e, st = inputs(spark, d)
    return C.margin_of_safety(e, st), st


def cards(spark, d):
    return staged(spark, d, "cards", lambda: card_of(*inputs(spark, d)))


CARD_COLUMNS = ("entity", "veto", "mos_pct", "score", "available_max", "pct", "band", "evidence", "strongest", "weakest",
                *[c for b in C.BLOCKS for c in (f"{b}_pts", f"{b}_max")])


def card_of(e, st):
    """Card per name. Anchored values and the card are staged in turn, so that each
    step is one short projection instead of one very deep one."""
    rows = stage(S.annual_rows(st), "years")
    values = stage(C.anchored(C.margin_of_safety(e, st), rows), "anchored")
    card = C.scorecard(values).select(*CARD_COLUMNS)
    return card.join(C.buffett(rows).select("entity", "buffett"), "entity", "left")


def picks(spark, d):
    def build():
        v = X.verdicts(findings(spark, d)).select("entity", "verdict", "severe", "caution")
        return C.consensus(cards(spark, d).join(v, "entity", "left").withColumn("flagged", F.lit(False)))
    return staged(spark, d, "picks", build)


@query("dcf", f"WITH x AS (SELECT o_orderkey, o_totalprice AS b, (o_orderkey % 61 - 20) / 100.0 AS g, 0.06 + (o_orderkey % 15) / 100.0 AS r FROM orders) SELECT o_orderkey, round({sqlcard.dcf('b', 'g', 'r')} / 1000, 4) AS value FROM (SELECT o_orderkey, b, CAST(g AS DOUBLE) AS g, CAST(r AS DOUBLE) AS r FROM x)", digits=4)
def dcf(spark, d):
    k = F.col("o_orderkey")
    return R.table(spark, d, "orders").select("o_orderkey", (V.dcf(F.col("o_totalprice"), (k % 61 - 20) / 100.0, 0.06 + (k % 15) / 100.0) / 1000).alias("value"))


@query("discount_rates", f"{MOS} SELECT entity, {rnd('discount')}, round(least(greatest(CASE WHEN coalesce(market_cap, 0) + greatest(coalesce(debt, 0) - coalesce(cash, 0), 0) > 0 THEN market_cap / (coalesce(market_cap, 0) + greatest(coalesce(debt, 0) - coalesce(cash, 0), 0)) * 0.105 + greatest(coalesce(debt, 0) - coalesce(cash, 0), 0) / (coalesce(market_cap, 0) + greatest(coalesce(debt, 0) - coalesce(cash, 0), 0)) * (CASE WHEN coverage > 0 THEN greatest(0.055, 0.045 + 10.0 / coverage) ELSE 0.095 END) * 0.75 ELSE 0.105 END, 0.06), 0.2), 6) AS wacc FROM mos")
def discount_rates(spark, d):
    return valued(spark, d)[0].select("entity", "discount", "wacc")


@query("margin_of_safety", f"{MOS} SELECT entity, {rnd('base_fcf', digits=3)}, {rnd('growth')}, {rnd('dcf_quality')}, {rnd('mos_pct')} FROM mos")
def margin_of_safety(spark, d):
    return valued(spark, d)[0].select("entity", F.round("base_fcf", 3).alias("base_fcf"), "growth", "dcf_quality", "mos_pct")


@query("implied_growth_grid", f"""WITH RECURSIVE {MOS[5:]}, b0 AS (SELECT entity, base_fcf AS b, discount AS r, dcf_quality AS q, market_cap AS mc FROM mos WHERE base_fcf IS NOT NULL),
  it(entity, b, r, q, mc, lo, hi, i) AS (SELECT entity, b, r, q, mc, CAST(-0.4 AS DOUBLE), CAST(0.6 AS DOUBLE), 0 FROM b0 UNION ALL
    SELECT entity, b, r, q, mc, CASE WHEN {sqlcard.dcf('b', '((lo + hi) / 2.0)', 'r')} * q < mc THEN (lo + hi) / 2.0 ELSE lo END, CASE WHEN {sqlcard.dcf('b', '((lo + hi) / 2.0)', 'r')} * q < mc THEN hi ELSE (lo + hi) / 2.0 END, i + 1 FROM it WHERE i < 40)
  SELECT entity, round(CASE WHEN {sqlcard.dcf('b', '(-0.4)', 'r')} * q > mc THEN -40.0 WHEN {sqlcard.dcf('b', '(0.6)', 'r')} * q < mc THEN 60.0 ELSE (lo + hi) / 2.0 * 100 END, 4) AS implied_growth_pct,
    CASE WHEN {sqlcard.dcf('b', '(-0.4)', 'r')} * q > mc THEN 'below' WHEN {sqlcard.dcf('b', '(0.6)', 'r')} * q < mc THEN 'above' END AS beyond FROM it WHERE i = 40""", digits=4)
def implied_growth_grid(spark, d):
    v = stage(valued(spark, d)[0].where("base_fcf IS NOT NULL").select("entity", "base_fcf", "discount", "dcf_quality", "market_cap"), "valued")
    pct, beyond = V.implied_growth(F.col("base_fcf"), F.col("discount"), F.col("dcf_quality"), F.col("market_cap"), steps=40)
    return v.select("entity", pct.alias("implied_growth_pct"), beyond.alias("beyond"))


@query("buffett_checklist", f"{YRS}, {sqlcard.BUFFETT} SELECT entity, buffett, b_roe, b_debt_equity, b_margin, b_current, b_earnings, b_moat_roe, b_pricing FROM bu")
def buffett_checklist(spark, d):
    return C.buffett(S.annual_rows(R.statements(spark, d))).select("entity", "buffett", "b_roe", "b_debt_equity", "b_margin", "b_current", "b_earnings", "b_moat_roe", "b_pricing")


PIO = f"""{YRS}, pt AS (SELECT ev.entity, [ev.net_income > 0, ev.ocf > 0, ev.ocf > ev.net_income, y0.net_income / nullif(y0.total_assets, 0) > y1.net_income / nullif(y1.total_assets, 0), y0.debt / nullif(y0.total_assets, 0) < y1.debt / nullif(y1.total_assets, 0),
   y0.current_assets / nullif(y0.current_liabilities, 0) > y1.current_assets / nullif(y1.current_liabilities, 0), y0.gross_profit / nullif(y0.revenue, 0) > y1.gross_profit / nullif(y1.revenue, 0), y0.revenue / nullif(y0.total_assets, 0) > y1.revenue / nullif(y1.total_assets, 0), share_trend <= 0] AS t
  FROM ev LEFT JOIN y0 ON y0.entity = ev.entity LEFT JOIN y1 ON y1.entity = ev.entity)"""


@query("piotroski", f"{PIO} SELECT entity, len(list_filter(t, lambda x: x)) AS score, len(list_filter(t, lambda x: x IS NOT NULL)) AS measured FROM pt")
def piotroski(spark, d):
    e, st = inputs(spark, d)
    return C.piotroski(S.annual_rows(st), e)


@query("altman_z", f"{EV}, z AS (SELECT entity, CASE WHEN total_assets > 0 AND liabilities > 0 THEN 1.2 * working_capital / total_assets + 1.4 * retained / total_assets + 3.3 * ebit / total_assets + 0.6 * market_cap / liabilities + revenue / total_assets END AS z FROM ev) SELECT entity, round_even(z, 2) AS z, CASE WHEN z < 1.81 THEN 'distress' WHEN z < 2.99 THEN 'grey' WHEN z IS NOT NULL THEN 'safe' END AS zone FROM z")
def altman_z(spark, d):
    return C.altman(evaluated(spark, d))


@query("incremental_roic", f"{YRS}, ic AS (SELECT y0.entity, y0.ebit - y3.ebit AS de, (y0.equity + y0.debt - y0.cash) AS a, (y3.equity + y3.debt - y3.cash) AS b, y0.total_assets AS ta FROM y0 LEFT JOIN y3 ON y3.entity = y0.entity) SELECT entity, round(CASE WHEN (a + b) / 2 > 0.1 * ta AND a - b > 0.05 * (a + b) / 2 THEN 100.0 * de * 0.75 / (a - b) END, 4) AS incremental_roic FROM ic", digits=4)
def incremental_roic(spark, d):
    return C.incremental_roic(S.annual_rows(R.statements(spark, d)))


EXTRAS = ("op_margin", "fcf_per_share", "fcf_conversion", "cash_conversion", "capex_intensity", "interest_coverage", "current_ratio", "goodwill_pct", "rd_intensity", "tax_gap", "dividends_pct_ocf", "buybacks_pct_ocf")
EXTRA_SQL = f"""rx AS (SELECT entity, CASE WHEN revenue > 0 THEN 100.0 * ebit / revenue END AS op_margin, owner_fcf / nullif(latest_shares, 0) AS fcf_per_share, CASE WHEN net_income > 0 THEN 100.0 * owner_fcf / net_income END AS fcf_conversion, CASE WHEN ebitda > 0 THEN 100.0 * ocf / ebitda END AS cash_conversion,
  CASE WHEN revenue > 0 THEN 100.0 * capex / revenue END AS capex_intensity, CASE WHEN interest <> 0 THEN ebit / abs(interest) END AS interest_coverage, current_assets / nullif(current_liabilities, 0) AS current_ratio, CASE WHEN total_assets > 0 THEN 100.0 * goodwill / total_assets END AS goodwill_pct,
  CASE WHEN revenue > 0 THEN 100.0 * research / revenue END AS rd_intensity, CASE WHEN pretax > 0 THEN 100.0 * (tax_expense - taxes_paid) / pretax END AS tax_gap, CASE WHEN ocf > 0 THEN 100.0 * abs(dividends) / ocf END AS dividends_pct_ocf, CASE WHEN ocf > 0 THEN 100.0 * abs(buybacks) / ocf END AS buybacks_pct_ocf FROM ev)"""


@query("cash_accrual_metrics", f"{EV}, {EXTRA_SQL} SELECT entity, {', '.join(rnd(x, digits=4) for x in EXTRAS)} FROM rx", digits=4)
def cash_accrual_metrics(spark, d):
    return C.registry_extras(evaluated(spark, d))


# registry: name -> (column, scale)
REGISTRY = {"owner_fcf_margin_pct": ("ofcf_margin", 1), "revenue_growth_pct": ("rev_growth", 1), "roic_pct": ("roic", 1), "gross_margin_pct": ("gm_level", 1), "owner_fcf_yield_pct": ("v_yield", 100), "net_debt_to_ebitda": ("nd2e", 1), "sbc_pct_of_revenue": ("sbc_pct", 1), "accrual_divergence_pct": ("accrual", 1)}


@query("metric_registry", f"{EV} " + " UNION ALL ".join(f"SELECT entity, '{n}' AS metric, round({c} * {k}, 4) AS value FROM ev" for n, (c, k) in REGISTRY.items()), digits=4)
def metric_registry(spark, d):
    """Named metrics as rows: the only ones a trigger may test."""
    e = evaluated(spark, d)
    cols = F.array(*[F.struct(F.lit(n).alias("metric"), (F.col(c) * k).alias("value")) for n, (c, k) in REGISTRY.items()])
    return e.select("entity", F.explode(cols).alias("x")).select("entity", "x.metric", "x.value")


@query("ramp", "SELECT o_orderkey, round_even(greatest(0.0, least(1.0, (o_totalprice / 10007 - 5) / 20.0)) * 12, 6) AS up, round_even(greatest(0.0, least(1.0, (o_totalprice / 100003 - 4) / (0.0 - 4))) * 10, 6) AS down FROM orders")
def ramp(spark, d):
    p = F.col("o_totalprice")
    return R.table(spark, d, "orders").select("o_orderkey", V.ramp(p / 10007, 5.0, 25.0, 12.0).alias("up"), V.ramp(p / 100003, 4.0, 0.0, 10.0).alias("down"))


CARD = f"{EV}, {sqlcard.MOS}, {sqlcard.YEARS}, {sqlcard.BUFFETT}, {sqlcard.CARD}"


@query("anchored_values", f"{CARD} SELECT entity, {', '.join(rnd(f'x_{m}', digits=4) for m in C.ANCHORS)} FROM card", digits=4)
def anchored_values(spark, d):
    v, st = valued(spark, d)
    return C.anchored(v, S.annual_rows(st)).select("entity", *[f"x_{m}" for m in C.ANCHORS])


@query("scorecard_blocks", f"{CARD} SELECT entity, {', '.join(f'{b}_pts, {b}_max' for b in C.BLOCKS)} FROM card", digits=1)
def scorecard_blocks(spark, d):
    return cards(spark, d).select("entity", *[c for b in C.BLOCKS for c in (f"{b}_pts", f"{b}_max")])


@query("scorecard", f"{CARD} SELECT entity, score, available_max, pct, band, evidence FROM card", digits=1)
def scorecard(spark, d):
    return cards(spark, d).select("entity", "score", "available_max", "pct", "band", "evidence")


@query("strongest_weakest", f"{CARD}, {sqlcard.LONG_PTS} SELECT entity, arg_max(m, (share, w, -o)) AS strongest, arg_min(m, (share, -w, o)) AS weakest FROM lp GROUP BY entity")
def strongest_weakest(spark, d):
    return cards(spark, d).select("entity", "strongest", "weakest")


PK = sqlcard.PICKS


@query("picks_rows", f"{PK} SELECT entity, band, pct, evidence, verdict, severe, caution, buffett, green FROM picks", digits=1)
def picks_rows(spark, d):
    return picks(spark, d).select("entity", "band", "pct", "evidence", "verdict", "severe", "caution", "buffett", "green")


@query("consensus", f"{PK} SELECT entity, green, unknown_lenses FROM picks")
def consensus(spark, d):
    return picks(spark, d).select("entity", "green", "unknown_lenses")


TOPB = "('Exceptional', 'Strong')"
SOUND = "severe <= 0 AND verdict NOT IN ('Fragile', 'Ruinous')"


@query("picks_shortlist", f"{PK} SELECT entity, band, pct FROM picks WHERE band IN {TOPB} AND {SOUND}", digits=1)
def picks_shortlist(spark, d):
    """Top bands without a severe finding or a fragile verdict, by evidence, then percent."""
    p = picks(spark, d).where(f"band IN {TOPB} AND {SOUND}")
    return p.orderBy(C.rank_tier(F.col("evidence")), F.desc("pct"), "entity").select("entity", "band", "pct")


@query("strong_but_fragile", f"{PK} SELECT entity, band, severe FROM picks WHERE band IN {TOPB} AND NOT ({SOUND})")
def strong_but_fragile(spark, d):
    p = picks(spark, d).where(f"band IN {TOPB} AND NOT ({SOUND})")
    return p.orderBy(F.desc("severe"), "entity").select("entity", "band", "severe")


@query("inversion_gate", f"{PK} SELECT entity, coalesce(verdict NOT IN ('Fragile', 'Ruinous'), true) AND coalesce(severe <= 0, true) AS passes FROM picks")
def inversion_gate(spark, d):
    p = picks(spark, d)
    ok = F.coalesce(~F.col("verdict").isin("Fragile", "Ruinous"), F.lit(True)) & F.coalesce(F.col("severe") <= 0, F.lit(True))
    return p.select("entity", ok.alias("passes"))


# gates that NULL never fails: no fragile verdict or severe finding, and the desk's floor of size (market value in hundreds) and price
GATES = "coalesce(verdict NOT IN ('Fragile', 'Ruinous'), true) AND coalesce(severe <= 0, true) AND coalesce(market_cap * 100 >= 3e8, true) AND coalesce(price >= 5, true)"


@query("top_fraction", f"{PK}, ok AS (SELECT card.entity, card.pct, CASE card.evidence WHEN 'full' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END AS tier FROM card LEFT JOIN (SELECT entity, verdict, severe FROM picks) p ON p.entity = card.entity JOIN (SELECT entity AS e2, market_cap AS mc, price AS px FROM ev) v ON v.e2 = card.entity WHERE card.pct IS NOT NULL AND card.band NOT IN ('VETOED', 'NO PRICE') AND {GATES.replace('market_cap', 'mc').replace('price', 'px')}) SELECT entity, pct FROM ok ORDER BY tier, pct DESC, entity LIMIT (SELECT CAST(greatest(1, ceil(count(*) * 0.01)) AS BIGINT) FROM card)", digits=1)
def top_fraction(spark, d):
    """Best 1 % of the universe by evidence tier, then percent, of the names that pass both gates. Cells of
    (tier, percent) are counted first, so only the cell at the cut is ordered by name."""
    c = cards(spark, d).select("entity", "pct", "evidence", "band")
    size = c.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * 0.01))).scalar()
    gates = picks(spark, d).select("entity", "verdict", "severe")
    v = evaluated(spark, d).select("entity", "market_cap", "price")
    ok = c.where("pct IS NOT NULL AND band NOT IN ('VETOED', 'NO PRICE')").join(gates, "entity", "left").join(v, "entity").where(GATES)
    ok = ok.select("entity", "pct", (F.col("pct") - C.rank_tier(F.col("evidence")) * 1000).alias("neg"), F.lit(0).alias("g"))
    ordered = cohorts.rank_order(ok, ["g"], "neg", "entity")
    return ordered.where(F.col("rank") <= size).select("entity", "pct")


VT = ("net_cash", "ncav", "eps_ttm", "graham_number", "price_to_graham", "pe", "peg", "ocf_to_ni", "ev_ebit", "norm_fcf_yield", "eps_cagr", "margin_mad")
VAL = f"{EV}, {sqlcard.VALUE}"


def lane_table(spark, d):
    e, st, sh = prepared(spark, d)
    return staged(spark, d, "values", lambda: LC.value_table(e, st, sh)), st


@query("value_table", f"{VAL} SELECT entity, {', '.join(rnd(x, digits=4) for x in VT)} FROM vt", digits=4)
def value_table(spark, d):
    return lane_table(spark, d)[0].select("entity", *VT)


@query("eps_growth", f"{VAL} SELECT entity, {rnd('eps_cagr', digits=4)} FROM eg", digits=4)
def eps_growth(spark, d):
    return LC.eps_growth(R.statements(spark, d), share_series(spark, d))


@query("margin_trend", f"{VAL} SELECT entity, {rnd('margin_mad', digits=4)}, margin_improving FROM mt", digits=4)
def margin_trend(spark, d):
    return LC.margin_trend(R.statements(spark, d))


@query("lenses", f"{VAL}, {sqlcard.LENSES} SELECT entity, graham, garp, downside, compounder, round(CASE WHEN downside = 'speaks' THEN downside_rank END, 4) AS downside_rank FROM ln", digits=4)
def lenses(spark, d):
    t = LC.lenses(lane_table(spark, d)[0])
    return t.select("entity", *[F.col(f"{n}.verdict").alias(n) for n in LC.LENSES], F.col("downside.rank").alias("downside_rank"))


def forged(spark, d):
    v, st = lane_table(spark, d)
    bars = staged(spark, d, "bars", lambda: R.bars(spark, d))
    vol = series.returns(bars).groupBy(F.col("symbol").alias("entity")).agg(F.when(F.count("ret") >= 51, F.stddev_pop("ret") * F.sqrt(F.lit(52.0))).alias("vol"))
    sub = series.last_k_all(bars, "symbol", "day", 6, F.col("close") < 1500).select(F.col("symbol").alias("entity"), F.col("holds").alias("sub_dollar"))
    sh = S.annual(st).groupBy("entity").agg(F.max_by("basic_shares", "period_end").alias("basic_shares"), F.max_by("diluted_shares", "period_end").alias("diluted_shares"))
    j = v.join(vol, "entity", "left").join(sub, "entity", "left").join(sh, "entity", "left")
    shares = prepared(spark, d)[2]
    yearly = shares.groupBy("entity", F.year("end_day").alias("y")).agg(F.max_by("value", "end_day").alias("value"), F.max("end_day").alias("end_day")).drop("y")
    splits = R.splits(spark, d).withColumn("ratio", F.col("ratio") * F.when(F.col("symbol") % 5 == 0, 0.25).otherwise(1.0))      # every fifth name's are reverse ones
    last = bars.groupBy(F.col("symbol").alias("entity")).agg(F.max("day").alias("last"))
    j = j.join(LC.repeat_issuance(S.yearly_issuance(yearly)), "entity", "left").join(LC.reverse_splits(splits, last), "entity", "left")
    return LC.forge(j.withColumn("equity", F.col("equity") * 10))


@query("forge", f"{EV}, {sqlcard.VALUE}, rets AS (SELECT symbol, day, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM bars WHERE adj_close > 0 QUALIFY ret IS NOT NULL), {sqlcard.FORGE} SELECT entity, serial_diluter, cash_runway, distress, delisting, overhang, accrual_mirage, fsev AS forge_severe, fcau AS forge_caution, forge_verdict FROM fo")
def forge(spark, d):
    """Survival probes (equity in tenths of the statement unit)."""
    return forged(spark, d).select("entity", "serial_diluter", "cash_runway", "distress", "delisting", "overhang", "accrual_mirage", "forge_severe", "forge_caution", "forge_verdict")


ELIG = "CASE WHEN market_cap IS NULL THEN 'market cap unmeasured' WHEN market_cap * 100 < 5e7 THEN 'below the band' WHEN market_cap * 100 >= 2e9 THEN 'above the band' WHEN price IS NULL THEN 'price unmeasured' WHEN price < 1 THEN 'price under the survival line' ELSE 'inside the band' END"


@query("lowcap_eligible", f"{EV} SELECT entity, {ELIG} = 'inside the band' AS ok, {ELIG} AS reason FROM ev")
def lowcap_eligible(spark, d):
    """Band check that needs its figures (market value in hundreds)."""
    return evaluated(spark, d).withColumn("e", LC.eligible(F.col("market_cap") * 100, F.col("price"))).select("entity", "e.ok", "e.reason")


@query("desk_floor", "SELECT s_suppkey AS entity, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal * 1e5 END >= 3e8, true) AND coalesce(CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey * 1.0 END >= 5, true) AS clears FROM supplier")
def desk_floor(spark, d):
    """Size and price floor that NULL never fails."""
    k = F.col("s_suppkey")
    cap, px = F.when(k % 3 != 0, F.col("s_acctbal") * 1e5), F.when(k % 4 != 0, F.col("s_nationkey") * 1.0)
    return R.table(spark, d, "supplier").select(k.alias("entity"), (F.coalesce(cap >= 3e8, F.lit(True)) & F.coalesce(px >= 5, F.lit(True))).alias("clears"))


# findings of three companies in four are noted as none: an input in which some names pass every gate
NOTED = "CASE WHEN entity % 4 = 0 THEN severity ELSE 'none' END"
LANE_NOTED = sqlcard.LANE.replace("fd AS (", "fd_all AS (").replace("vg AS (SELECT", f"fd AS (SELECT * REPLACE ({NOTED} AS severity) FROM fd_all), vg AS (SELECT")


@query("lens_shortlists", f"""{LANE_NOTED}, lk AS (SELECT ln.*, fo.forge_verdict, vd.verdict, vd.severe, {ELIG.replace('market_cap', 'ln.market_cap').replace('price ', 'ln.price ')} = 'inside the band' AS ok FROM ln JOIN fo ON fo.entity = ln.entity LEFT JOIN vd ON vd.entity = ln.entity),
  ll AS ({' UNION ALL '.join(f"SELECT entity, '{n}' AS lens, {n}_rank AS score FROM lk WHERE ok AND forge_verdict <> 'Forged-out' AND coalesce(verdict NOT IN ('Fragile', 'Ruinous'), true) AND coalesce(severe, 0) <= 0 AND {n} = 'speaks'" for n in LC.LENSES)})
  SELECT entity, lens, rank FROM (SELECT *, row_number() OVER (PARTITION BY lens ORDER BY score, entity) AS rank FROM ll WHERE score IS NOT NULL) WHERE rank <= 3""")
def lens_shortlists(spark, d):
    """Best three per lens of the eligible names that are neither forged out, fragile nor severely marked."""
    v = X.verdicts(findings(spark, d).withColumn("severity", F.expr(NOTED))).select("entity", "severe", "verdict")
    rows = LC.lenses(forged(spark, d).withColumn("equity", F.col("equity") / 10)).drop("severe", "verdict").join(v, "entity", "left").withColumn(
        "eligible", LC.eligible(F.col("market_cap") * 100, F.col("price"))["ok"])
    return LC.lens_shortlists(rows).select("entity", "lens", "rank")


@query("midrank_percentile", """SELECT s_suppkey AS entity, CAST(round_even(100.0 * ((SELECT count(*) FROM supplier x WHERE x.s_nationkey < s.s_nationkey) + (SELECT count(*) FROM supplier x WHERE x.s_nationkey = s.s_nationkey) / 2.0) / (SELECT count(*) FROM supplier), 0) AS BIGINT) AS pct FROM supplier s""")
def midrank_percentile(spark, d):
    s = R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("x"), F.lit(0).alias("g"))
    r = ranks.value_ranks(s, ["g"], "x").select("x", F.bround(100.0 * (F.col("n_lt") + (F.col("n_le") - F.col("n_lt")) / 2.0) / F.col("n")).cast("bigint").alias("pct"))
    return s.join(r, "x").select("entity", "pct")


@query("cohort_fallback", f"""{EV}, c AS (SELECT entity, sector, v_yield, count(v_yield) OVER (PARTITION BY sector) AS n FROM ev WHERE v_yield IS NOT NULL), k AS (SELECT *, CASE WHEN n >= 20 THEN sector ELSE 'universe' END AS cohort FROM c)
  SELECT entity, cohort, round(100.0 * CASE WHEN cohort = 'universe' THEN ((SELECT count(*) FROM c x WHERE x.v_yield < k.v_yield) + (SELECT count(*) FROM c x WHERE x.v_yield = k.v_yield) / 2.0) / (SELECT count(*) FROM c)
    ELSE ((SELECT count(*) FROM c x WHERE x.sector = k.sector AND x.v_yield < k.v_yield) + (SELECT count(*) FROM c x WHERE x.sector = k.sector AND x.v_yield = k.v_yield) / 2.0) / n END, 4) AS pct FROM k""", digits=4)
def cohort_fallback(spark, d):
    """Sector cohort where it measures 20 names, else the whole universe."""
    e = stage(evaluated(spark, d).where("v_yield IS NOT NULL").select("entity", "sector", "v_yield"), "yields")
    every = F.explode(F.array(F.col("sector"), F.lit("universe")))
    r = ranks.value_ranks(e.withColumn("cohort", every), ["cohort"], "v_yield")
    n = e.groupBy("sector").agg(F.count("*").alias("sn"))
    j = e.join(n, "sector").withColumn("cohort", F.when(F.col("sn") >= 20, F.col("sector")).otherwise("universe")).join(r, ["cohort", "v_yield"])
    return j.select("entity", "cohort", (100.0 * (F.col("n_lt") + (F.col("n_le") - F.col("n_lt")) / 2.0) / F.col("n")).alias("pct"))
