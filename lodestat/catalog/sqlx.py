"""SQL counterparts shared by the metric and grading checks."""

from lodestat import relations as R
from lodestat.functions import valuation as V
from lodestat.operators import statements as S
from lodestat.plans import evaluate as E
from lodestat.plans import grading as G

BOUND = "2000-12-31"

# market data: price and share count known at the bound; shares in tenths
SQL_MARKET = f"""{R.SQL_BARS}, {R.SQL_SHARES}, {R.SQL_SPLITS},
  ser0 AS (SELECT entity, end_day, arg_max(value, (filed, seq, value)) / 10 AS value FROM share_counts GROUP BY ALL),
  shr AS (SELECT s.entity, s.end_day, any_value(s.value) * coalesce(product(ratio), 1) AS value FROM ser0 s LEFT JOIN splits ON splits.symbol = s.entity AND splits.day > s.end_day GROUP BY s.entity, s.end_day),
  px AS (SELECT symbol AS entity, arg_max(close, day) AS price FROM bars GROUP BY symbol),
  cnt AS (SELECT entity, arg_max(value, end_day) AS n FROM ser0 GROUP BY entity),
  mkt AS (SELECT px.entity, price * n AS market_cap, price, CASE WHEN px.entity % 4 = 0 THEN price * n * 0.7 END AS vendor_ev FROM px JOIN cnt USING (entity)),
  meta AS (SELECT symbol AS entity, sector, industry FROM universe)"""

OWNER = "CASE WHEN ocf IS NOT NULL AND capex IS NOT NULL THEN ocf - least(abs(capex), coalesce(da, abs(capex))) - coalesce(sbc, 0) END"


def _strict(c):
    return f"CASE WHEN count({c}) = count(*) THEN sum({c}) END AS {c}"


SUMS = ", ".join([_strict(c) for c in S.STRICT] + ["abs(CASE WHEN count(capex) = count(*) THEN sum(capex) END) AS capex", "sum(coalesce(sbc, 0)) AS sbc",
                 "sum(coalesce(credit_loss, 0)) AS credit_loss"] + [_strict(c) for c in S.ZERO_DEFAULT])

SQL_TTM = f"""dv AS (SELECT *, ebit + da AS ebitda, {OWNER} AS owner_fcf FROM stm),
  rq AS (SELECT *, row_number() OVER (PARTITION BY entity, scope ORDER BY period_end DESC) AS rn FROM dv),
  tq AS (SELECT entity, max(period_end) AS through, {SUMS}, 'quarterly' AS basis, 4 AS quarters FROM rq WHERE scope = 'quarterly' AND rn <= 4 GROUP BY entity
    HAVING count(*) = 4 AND count(revenue) = 4 AND count(rq.ocf) = 4 AND count(rq.capex) = 4),
  ta AS (SELECT entity, max(period_end) AS through, {SUMS}, 'annual' AS basis, 1 AS quarters FROM rq WHERE scope = 'annual' AND rn = 1 AND entity NOT IN (SELECT entity FROM tq) GROUP BY entity),
  ttm AS (SELECT * FROM tq UNION ALL BY NAME SELECT * FROM ta)"""

BAL_COLS = ", ".join(S.BALANCE)
SQL_BALANCE = f"""bal AS (SELECT entity, period_end AS balance_end, {BAL_COLS}, current_assets - current_liabilities AS working_capital FROM stm
    WHERE coalesce({BAL_COLS}) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY (scope = 'quarterly') DESC, period_end DESC) = 1)"""


def cagr(d0, v0, d1, v1):
    return f"100.0 * (pow({v1} / {v0}, 1.0 / greatest(({d1} - {d0}) / 365.25, 1e-9)) - 1)"


SQL_ANNUAL = f"""an AS (SELECT * FROM dv WHERE scope = 'annual'),
  gmx AS (SELECT entity, CASE WHEN revenue <> 0 THEN gross_profit / revenue END AS gm, CASE WHEN revenue > 0 THEN revenue END AS rev, CASE WHEN revenue > 0 THEN period_end END AS rd, owner_fcf FROM an),
  af AS (SELECT entity, count(gm) AS gm_periods, CASE WHEN count(gm) < 2 OR avg(gm) = 0 THEN 0.0 ELSE stddev_pop(gm) / avg(gm) END AS gm_cv,
    CASE WHEN count(rev) >= 2 THEN {cagr('min(rd)', 'arg_min(rev, rd)', 'max(rd)', 'arg_max(rev, rd)')} END AS rev_growth, coalesce(bool_and(owner_fcf < 0), false) AS all_negative,
    count(owner_fcf) AS fcf_periods, count(*) FILTER (owner_fcf > 0) AS fcf_positive FROM gmx GROUP BY entity),
  pp AS (SELECT a.entity, a.period_end, a.owner_fcf, a.revenue, s.value FROM (SELECT * FROM an WHERE owner_fcf IS NOT NULL) a ASOF LEFT JOIN shr s ON s.entity = a.entity AND a.period_end >= s.end_day),
  p2 AS (SELECT *, owner_fcf / value AS ps FROM pp WHERE value > 0),
  pg AS (SELECT entity, count(*) AS n, min(period_end) AS d0, max(period_end) AS d1, arg_min(ps, period_end) AS b, arg_max(ps, period_end) AS e, arg_min(owner_fcf, period_end) AS bo,
    arg_min(coalesce(revenue, -1), period_end) AS br FROM p2 GROUP BY entity),
  psg AS (SELECT entity, n >= 2 AND b > 0 AND e > 0 AND br > 0 AND bo < 0.02 * br AS low_base, CASE WHEN n >= 2 AND b > 0 AND e > 0 AND NOT (br > 0 AND bo < 0.02 * br)
    THEN {cagr('d0', 'b', 'd1', 'e')} END AS ps_growth FROM pg)"""

SQL_TREND = f"""tg AS (SELECT entity, max(end_day) AS d1, arg_max(value, end_day) AS v1, min(end_day) AS d00, arg_min(value, end_day) AS v00, count(*) AS n FROM shr GROUP BY entity),
  tp AS (SELECT shr.entity, max(end_day) AS dp, arg_max(value, end_day) AS vp FROM shr JOIN tg ON tg.entity = shr.entity WHERE shr.end_day <= tg.d1 - 365 GROUP BY shr.entity),
  trd AS (SELECT tg.entity, v1 AS latest_shares, CASE WHEN n >= 2 AND (d1 - coalesce(dp, d00)) / 365.25 >= 0.25 THEN {cagr('coalesce(dp, d00)', 'coalesce(vp, v00)', 'd1', 'v1')} END AS share_trend
    FROM tg LEFT JOIN tp ON tp.entity = tg.entity)"""

VETO_ARMS = """CASE WHEN nd2e > 4.0 THEN 1 WHEN ebitda <= 0 AND net_debt > 0 THEN 2 WHEN ocf > 0 AND credit_loss / ocf >= 0.25 THEN 3
  WHEN NOT share_class AND share_trend > 20 THEN 4 WHEN all_negative AND owner_fcf <= 0 AND roic > 15 AND rev_growth > 10 THEN 5 WHEN all_negative AND owner_fcf <= 0 THEN 6
  WHEN NOT share_class AND share_trend > 5 THEN 7 ELSE 0 END"""
REASON = """CASE veto_rule WHEN 1 THEN printf('leverage veto: net debt/EBITDA %.1f > 4.0', nd2e) WHEN 2 THEN 'leverage veto: EBITDA <= 0 while carrying net debt'
  WHEN 3 THEN printf('cash-flow quality: OCF leans %.0f%% on credit-loss/write-off add-backs', 100.0 * credit_loss / ocf) WHEN 4 THEN printf('dilution veto: shares +%.1f%%/yr (>20%%/yr)', share_trend)
  WHEN 5 THEN printf('flagged — owner-FCF negative every period, spared as a reinvestor (ROIC %.0f%% > 15%%, revenue growth %.0f%%/yr > 10%%)', roic, rev_growth)
  WHEN 6 THEN 'cash-destruction veto: owner-FCF negative every annual period and TTM <= 0' WHEN 7 THEN printf('dilution penalty: shares +%.1f%%/yr', share_trend) ELSE '' END"""
GAP_ARMS = "CASE " + " ".join(f"WHEN {k} IS NULL THEN '{label}'" for k, label in E.REQUIRED) + " END"

SQL_EVAL = f"""{R.SQL_STATEMENTS}, {R.SQL_UNIVERSE}, {SQL_MARKET}, {SQL_TTM}, {SQL_BALANCE}, {SQL_ANNUAL}, {SQL_TREND},
  e0 AS (SELECT ttm.*, bal.* EXCLUDE (entity), af.* EXCLUDE (entity), coalesce(low_base, false) AS low_base, ps_growth, latest_shares, share_trend, market_cap, price, vendor_ev, sector, industry
    FROM ttm LEFT JOIN bal ON bal.entity = ttm.entity LEFT JOIN af ON af.entity = ttm.entity LEFT JOIN psg ON psg.entity = ttm.entity LEFT JOIN trd ON trd.entity = ttm.entity
    LEFT JOIN mkt ON mkt.entity = ttm.entity LEFT JOIN meta ON meta.entity = ttm.entity),
  e1 AS (SELECT *, market_cap + debt - cash AS own_ev, coalesce(vendor_ev, CASE WHEN price > 0 THEN price * latest_shares + debt - cash END) AS ref_ev, debt - cash AS net_debt,
    working_capital + (total_assets - current_assets - cash) AS cap_base FROM e0),
  e2 AS (SELECT *, CASE WHEN own_ev > 0 THEN 100.0 * (own_ev - ref_ev) / own_ev END AS gap_pct, CASE WHEN equity + nci > 0 THEN 100.0 * nci / (equity + nci) END AS nci_pct,
    CASE WHEN cap_base <= 0 AND ebit > 0 THEN 1000.0 WHEN cap_base > 0 THEN CASE WHEN ebit IS NOT NULL THEN least(1000.0, 100.0 * ebit / cap_base) END END AS roic, coalesce(cap_base <= 0 AND ebit > 0, false) AS roic_capped,
    CASE WHEN own_ev > 0 THEN owner_fcf / own_ev END AS v_yield, CASE WHEN owner_fcf > 0 THEN market_cap / owner_fcf END AS p_ofcf, CASE WHEN revenue > 0 THEN 100.0 * gross_profit / revenue END AS gm_level,
    CASE WHEN revenue > 0 THEN 100.0 * owner_fcf / revenue END AS ofcf_margin, CASE WHEN ebitda <> 0 THEN net_debt / ebitda END AS nd2e, CASE WHEN revenue > 0 THEN 100.0 * sbc / revenue END AS sbc_pct,
    CASE WHEN revenue > 0 THEN 100.0 * (net_income - ocf) / revenue END AS accrual, CASE WHEN revenue > 0 THEN 100.0 * deferred / revenue END AS deferred_pct FROM e1),
  e3 AS (SELECT *, coalesce(nci_pct > 10 AND abs(gap_pct) > 15, false) AS share_class FROM e2),
  ev AS (SELECT *, CASE WHEN NOT share_class THEN share_trend END AS m_shares, {GAP_ARMS} AS required_gap, {VETO_ARMS} AS veto_rule,
    list_filter([CASE WHEN abs(gap_pct) > 15 THEN 'EV_GAP' END, CASE WHEN share_class THEN 'SHARE_CLASS' END, CASE WHEN deferred_pct > 30 THEN 'FLOAT_ROIC' END,
      CASE WHEN low_base THEN 'LOW_BASE' END, CASE WHEN roic_capped THEN 'ROIC_CAPPED' END], lambda x: x IS NOT NULL) AS flags FROM e3)"""


def _pct(leg, high):
    n = f"count({leg}) OVER (PARTITION BY sector)"
    p = f"50.0 * ((rank() OVER (PARTITION BY sector ORDER BY {leg} NULLS LAST) - 1) + count({leg}) OVER (PARTITION BY sector ORDER BY {leg} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / {n}"
    p = p if high else f"100.0 - {p}"
    return f"CASE WHEN {leg} IS NULL THEN NULL WHEN {n} <= 1 THEN 50.0 ELSE {p} END AS p_{leg}"


def mean(*xs):
    n = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END)" for x in xs)
    return f"(CASE WHEN {n} > 0 THEN ({' + '.join(f'coalesce({x}, 0)' for x in xs)}) / ({n}) END)"


W, QW = V.PILLAR_WEIGHTS, V.QUALITY_WEIGHTS
FACTOR = "greatest(0.0, least(1.0, roic / 15.0))"
SQL_SCORE = f"""{SQL_EVAL},
  sv AS (SELECT *, {', '.join(_pct(k, h) for k, h in G.LEGS.items())} FROM ev WHERE veto_rule IN (0, 5, 7) AND required_gap IS NULL),
  pl AS (SELECT entity, round_even(p_v_yield, 6) AS v, {mean(f'round_even(p_roic * {FACTOR}, 6)', 'round_even(p_gm_level * p_gm_cv / 100.0, 6)', 'round_even(p_ofcf_margin, 6)')} AS q,
    coalesce({mean(f'round_even(p_rev_growth * {FACTOR}, 6)', f'round_even(p_ps_growth * {FACTOR}, 6)')}, 50.0) AS g,
    {mean('round_even(p_nd2e, 6)', 'CASE WHEN owner_fcf > 0 THEN 100.0 ELSE 0.0 END', 'round_even(p_sbc_pct, 6)')} AS d,
    {mean('round_even(CASE WHEN share_class THEN 50.0 ELSE p_m_shares END, 6)', 'round_even(p_accrual, 6)')} AS m, CASE WHEN veto_rule = 7 THEN -15 ELSE 0 END AS penalty FROM sv),
  co AS (SELECT *, greatest(0.0, least(100.0, round_even({W['v']} * v + {W['q']} * q + {W['g']} * g + {W['d']} * d + {W['m']} * m + penalty, 4))) AS composite,
    round_even({QW['q']} * q + {QW['g']} * g + {QW['d']} * d + {QW['m']} * m, 4) AS quality_score FROM pl),
  scored AS (SELECT ev.*, v, q, g, d, m, composite, quality_score, CASE WHEN veto_rule IN (1, 2, 3, 4, 6) THEN 'VETOED' WHEN required_gap IS NOT NULL THEN 'INSUFFICIENT'
    WHEN composite >= 80 THEN 'A' WHEN composite >= 65 THEN 'B' WHEN composite >= 50 THEN 'C' WHEN composite >= 35 THEN 'D' ELSE 'F' END AS grade,
    CASE WHEN veto_rule NOT IN (1, 2, 3, 4, 6) AND required_gap IS NOT NULL THEN 'insufficient data: ' || required_gap ELSE {REASON} END AS note
    FROM ev LEFT JOIN co ON co.entity = ev.entity)"""
