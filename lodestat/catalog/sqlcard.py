"""SQL counterparts of the card, its inputs and the low-cap lane."""

from lodestat.catalog.c_fragile import FINDINGS
from lodestat.catalog.sqlx import cagr
from lodestat.operators import card as C


def dcf(b, g, r):
    t, term = f"(({g} + 0.03) / 2.0)", f"least(0.03, {g} * 0.6)"
    yrs = " + ".join(f"{b} * pow(1 + {g}, {y}.0) / pow(1 + {r}, {y}.0)" for y in (1, 2, 3))
    fade = " + ".join(f"{b} * pow(1 + {g}, 3.0) * pow(1 + {t} * {8 - y} / 4.0, {y - 3}.0) / pow(1 + {r}, {y}.0)" for y in (4, 5, 6, 7))
    term = f"(CASE WHEN {r} <= {term} THEN {r} * 0.8 ELSE {term} END)"
    return f"({yrs} + {fade} + {b} * pow(1 + {g}, 3.0) * pow(1 + {t}, 4.0) * (1 + {term}) / ({r} - {term}) / pow(1 + {r}, 7.0))"


MOS = f"""hr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS rn2 FROM an WHERE owner_fcf IS NOT NULL),
  hh AS (SELECT entity, avg(owner_fcf) FILTER (rn2 <= 3) AS avg3, CASE WHEN count(*) < 3 THEN 0.5 WHEN count(*) FILTER (owner_fcf > 0) < 2 THEN 0.8 ELSE least(stddev_samp(owner_fcf) FILTER (owner_fcf > 0) / avg(owner_fcf) FILTER (owner_fcf > 0), 1.0) END AS vol FROM hr GROUP BY entity),
  m0 AS (SELECT ev.*, CASE WHEN market_cap > 0 AND greatest(owner_fcf, 0.85 * avg3) > 0 THEN greatest(owner_fcf, 0.85 * avg3) END AS base_fcf, CASE WHEN rev_growth IS NOT NULL AND rev_growth <> 0 THEN least(rev_growth / 100.0, CASE WHEN market_cap > 2e11 THEN 0.1 ELSE 0.25 END) ELSE 0.05 END AS growth,
    CASE WHEN market_cap > 0 THEN least(greatest(0.045 + (1.0 + 0.75 * (greatest(coalesce(debt, 0) - coalesce(cash, 0), 0) / market_cap)) * 0.06, 0.105), 0.2) ELSE 0.105 END AS discount, greatest(0.7, 1.0 - 0.5 * coalesce(vol, 0.5)) AS dcf_quality,
    CASE WHEN interest <> 0 THEN ebit / abs(interest) END AS coverage FROM ev LEFT JOIN hh ON hh.entity = ev.entity),
  mos AS (SELECT *, {dcf('base_fcf', 'growth', 'discount')} * dcf_quality AS intrinsic, ({dcf('base_fcf', 'growth', 'discount')} * dcf_quality - market_cap) / market_cap AS mos_pct FROM m0)"""

YEARS = """yr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS yn FROM an),
  y0 AS (SELECT * FROM yr WHERE yn = 1), y1 AS (SELECT * FROM yr WHERE yn = 2), y3 AS (SELECT * FROM yr WHERE yn = 4)"""

BUFFETT = """bm AS (SELECT entity, period_end, net_income, CASE WHEN equity > 0 THEN net_income / equity END AS roe, CASE WHEN revenue > 0 THEN ebit / revenue END AS om FROM yr WHERE yn <= 8),
  bn AS (SELECT entity, count(*) >= 2 AND coalesce(bool_and(net_income >= pv), true) AS steady FROM (SELECT entity, net_income, lag(net_income) OVER (PARTITION BY entity ORDER BY period_end) AS pv FROM bm WHERE net_income IS NOT NULL) GROUP BY entity),
  bo AS (SELECT entity, avg(om) AS a, avg(om) FILTER (r1 <= 3) AS recent, avg(om) FILTER (r2 <= 3) AS older FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) AS r1, row_number() OVER (PARTITION BY entity ORDER BY period_end) AS r2 FROM bm WHERE om IS NOT NULL) GROUP BY entity),
  br AS (SELECT entity, count(roe) AS n, count(*) FILTER (roe > 0.15) / nullif(count(roe), 0) AS frac FROM bm GROUP BY entity),
  bf AS (SELECT y0.entity, CASE WHEN equity > 0 AND net_income / equity > 0.15 THEN 2 ELSE 0 END AS b_roe, CASE WHEN equity > 0 AND debt / equity < 0.5 THEN 2 ELSE 0 END AS b_debt_equity, CASE WHEN revenue > 0 AND ebit / revenue > 0.15 THEN 2 ELSE 0 END AS b_margin,
    CASE WHEN current_liabilities > 0 AND current_assets / current_liabilities > 1.5 THEN 1 ELSE 0 END AS b_current, CASE WHEN steady THEN 3 ELSE 0 END AS b_earnings, CASE WHEN br.n >= 2 AND frac >= 0.8 THEN 2 WHEN br.n >= 2 AND frac >= 0.6 THEN 1 ELSE 0 END AS b_moat_roe,
    CASE WHEN bo.a > 0.2 AND recent >= older THEN 1 ELSE 0 END AS b_pricing FROM y0 LEFT JOIN bn ON bn.entity = y0.entity LEFT JOIN bo ON bo.entity = y0.entity LEFT JOIN br ON br.entity = y0.entity),
  bu AS (SELECT *, b_roe + b_debt_equity + b_margin + b_current + b_earnings + b_moat_roe + b_pricing AS buffett FROM bf)"""

ANCH = """ax AS (SELECT mos.*, mos.roic AS x_roic, gm_level AS x_gross_margin, CASE WHEN gm_periods >= 2 THEN gm_cv END AS x_gross_margin_cv, ofcf_margin AS x_owner_fcf_margin, rev_growth AS x_revenue_growth, v_yield AS x_owner_fcf_yield, mos_pct AS x_margin_of_safety,
    nd2e AS x_net_debt_ebitda, CASE WHEN fcf_periods > 0 THEN fcf_positive / fcf_periods END AS x_self_funding, sbc_pct AS x_sbc, CASE WHEN mos.current_liabilities > 0 THEN mos.current_assets / mos.current_liabilities END AS x_current_ratio,
    CASE WHEN NOT share_class THEN share_trend END AS x_share_count_trend, accrual AS x_accruals, CASE WHEN y0.owner_fcf > 0 AND (y0.dividends IS NOT NULL OR y0.buybacks IS NOT NULL) THEN (abs(coalesce(y0.dividends, 0)) + abs(coalesce(y0.buybacks, 0))) / y0.owner_fcf END AS x_capital_returned
  FROM mos LEFT JOIN y0 ON y0.entity = mos.entity)"""


def _pt(m):
    _, f, t, p = C.ANCHORS[m]
    return f"round_even(round_even(greatest(0.0, least(1.0, (x_{m} - ({f})) / ({t} - ({f})))) * {p}.0, 6), 1)"


_blocks = {b: [m for m, a in C.ANCHORS.items() if a[0] == b] for b in C.BLOCKS}
CARD = f"""{ANCH}, c1 AS (SELECT *, {', '.join(f'CASE WHEN x_{m} IS NOT NULL THEN {_pt(m)} END AS pt_{m}' for m in C.ANCHORS)} FROM ax),
  c2 AS (SELECT *, {', '.join(f"round_even({' + '.join(f'coalesce(pt_{m}, 0)' for m in ms)}, 1) AS {b}_pts, {' + '.join(f'(CASE WHEN pt_{m} IS NOT NULL THEN {C.ANCHORS[m][3]} ELSE 0 END)' for m in ms)} AS {b}_max" for b, ms in _blocks.items())} FROM c1),
  c3 AS (SELECT *, round_even({' + '.join(f'{b}_pts' for b in _blocks)}, 1) AS score, {' + '.join(f'{b}_max' for b in _blocks)} AS available_max FROM c2),
  c4 AS (SELECT *, CASE WHEN available_max > 0 THEN round_even(100.0 * score / available_max, 0) END AS raw_pct, veto_rule IN (1, 2, 3, 4, 6) AS vetoed FROM c3),
  card AS (SELECT *, CASE WHEN vetoed THEN 'VETOED' WHEN price_max = 0 THEN 'NO PRICE' WHEN raw_pct >= 80 THEN 'Exceptional' WHEN raw_pct >= 65 THEN 'Strong' WHEN raw_pct >= 50 THEN 'Mixed' WHEN raw_pct >= 35 THEN 'Weak' ELSE 'Pass' END AS band,
    CASE WHEN NOT vetoed THEN raw_pct END AS pct, CASE WHEN available_max >= 85 THEN 'full' WHEN available_max >= 60 THEN 'partial' ELSE 'thin' END AS evidence FROM c4)"""

LONG_PTS = "lp AS (" + " UNION ALL ".join(f"SELECT entity, '{m}' AS m, pt_{m} / {a[3]} AS share, {a[3]} AS w, {i} AS o FROM card WHERE pt_{m} IS NOT NULL" for i, (m, a) in enumerate(C.ANCHORS.items())) + ")"

BASE = f"{FINDINGS}, {MOS}, {YEARS}, {BUFFETT}, {CARD}"
PICKS = f"""{BASE}, pk AS (SELECT card.*, bu.buffett, vd.verdict, vd.severe, vd.caution,
    (CASE WHEN band = 'VETOED' THEN false WHEN band <> 'NO PRICE' AND pct IS NOT NULL THEN pct >= 60 END) AS l1, mos_pct > 0 AS l2, buffett >= 9 AS l3,
    (CASE WHEN verdict IN ('Robust', 'Ordinary') AND vd.severe > 0 THEN NULL WHEN verdict IN ('Robust', 'Ordinary') THEN true WHEN verdict IN ('Fragile', 'Ruinous') THEN false END) AS l4
  FROM card LEFT JOIN bu ON bu.entity = card.entity LEFT JOIN vd ON vd.entity = card.entity),
  picks AS (SELECT *, coalesce(CAST(l1 AS INT), 0) + coalesce(CAST(l2 AS INT), 0) + coalesce(CAST(l3 AS INT), 0) + coalesce(CAST(l4 AS INT), 0) AS green,
    CAST(l1 IS NULL AS INT) + CAST(l2 IS NULL AS INT) + CAST(l3 IS NULL AS INT) + CAST(l4 IS NULL AS INT) AS unknown_lenses FROM pk)"""

VALUE = f"""ep AS (SELECT a.entity, a.period_end, a.net_income / s.value AS eps FROM (SELECT * FROM an WHERE net_income IS NOT NULL) a ASOF LEFT JOIN shr s ON s.entity = a.entity AND a.period_end >= s.end_day WHERE s.value > 0 AND a.net_income > 0),
  eg AS (SELECT entity, CASE WHEN count(*) >= 3 THEN {cagr('min(period_end)', 'arg_min(eps, period_end)', 'max(period_end)', 'arg_max(eps, period_end)')} END AS eps_cagr FROM ep GROUP BY entity),
  mt AS (SELECT entity, CASE WHEN count(*) >= 3 THEN avg(abs(m - mu)) END AS margin_mad, CASE WHEN count(*) >= 3 THEN arg_max(m, period_end) >= max(mu) END AS margin_improving FROM (SELECT *, avg(m) OVER (PARTITION BY entity) AS mu FROM (SELECT entity, period_end, 100.0 * ebit / revenue AS m FROM an WHERE revenue > 0 AND ebit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) <= 5)) GROUP BY entity),
  nf AS (SELECT entity, CASE WHEN count(*) >= 3 THEN avg(owner_fcf) END AS norm_fcf FROM (SELECT entity, owner_fcf FROM an WHERE owner_fcf IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) <= 5) GROUP BY entity),
  v0 AS (SELECT ev.*, eps_cagr, margin_mad, margin_improving, norm_fcf, cash - debt AS net_cash, total_assets - equity - coalesce(nci, 0) AS total_liab, current_assets - (total_assets - equity - coalesce(nci, 0)) AS ncav, net_income / nullif(latest_shares, 0) AS eps_ttm, equity / nullif(latest_shares, 0) AS bvps, CASE WHEN net_income > 0 THEN market_cap / net_income END AS pe
    FROM ev LEFT JOIN eg ON eg.entity = ev.entity LEFT JOIN mt ON mt.entity = ev.entity LEFT JOIN nf ON nf.entity = ev.entity),
  v1 AS (SELECT *, CASE WHEN equity > 0 THEN debt / equity END AS de_ratio, total_liab / nullif(total_assets, 0) AS liab_to_assets, current_assets / nullif(current_liabilities, 0) AS current_ratio, CASE WHEN ncav > 0 THEN market_cap / ncav END AS mcap_to_ncav, CASE WHEN eps_ttm > 0 AND bvps > 0 THEN sqrt(22.5 * eps_ttm * bvps) END AS graham_number,
    CASE WHEN eps_cagr > 0 THEN pe / eps_cagr END AS peg, CASE WHEN net_income > 0 THEN ocf / net_income END AS ocf_to_ni, CASE WHEN ebit > 0 AND own_ev > 0 THEN own_ev / ebit END AS ev_ebit, CASE WHEN market_cap > 0 THEN 100.0 * norm_fcf / market_cap END AS norm_fcf_yield FROM v0),
  vt AS (SELECT *, price / graham_number AS price_to_graham FROM v1)"""

LENSES = """ln0 AS (SELECT *, ncav IS NOT NULL AND market_cap IS NOT NULL AND net_income IS NOT NULL AS nnk, eps_ttm IS NOT NULL AND bvps IS NOT NULL AND price IS NOT NULL AND current_ratio IS NOT NULL AND liab_to_assets IS NOT NULL AS gnk,
    CASE WHEN net_cash >= 0 THEN true ELSE de_ratio < 0.5 END AS gear, coalesce(net_cash > 0, false) OR coalesce(current_ratio >= 2 AND de_ratio < 0.3, false) AS flr, coalesce(norm_fcf_yield >= 8, false) AS byy, coalesce(ev_ebit <= 6, false) AS bye, CASE WHEN margin_mad IS NOT NULL THEN margin_mad <= 3 OR coalesce(margin_improving, false) END AS stb FROM vt),
  ln1 AS (SELECT *, nnk AND coalesce(mcap_to_ncav < 2.0 / 3.0, false) AND net_income > 0 AS nn, gnk AND coalesce(price_to_graham < 1, false) AND current_ratio >= 2 AND liab_to_assets < 0.5 AS gn FROM ln0),
  ln AS (SELECT *, CASE WHEN NOT nnk AND NOT gnk THEN 'refuses' WHEN nn OR gn THEN 'speaks' ELSE 'silent' END AS graham, CASE WHEN nn THEN mcap_to_ncav ELSE 1 + price_to_graham END AS graham_rank,
    CASE WHEN peg IS NULL OR eps_cagr IS NULL OR ocf_to_ni IS NULL OR gear IS NULL THEN 'refuses' WHEN peg <= 1 AND eps_cagr BETWEEN 15 AND 30 AND ocf_to_ni >= 1 AND gear THEN 'speaks' ELSE 'silent' END AS garp, peg AS garp_rank,
    CASE WHEN (net_cash IS NULL AND (current_ratio IS NULL OR de_ratio IS NULL)) OR (norm_fcf_yield IS NULL AND ev_ebit IS NULL) THEN 'refuses' WHEN flr AND (byy OR bye) THEN 'speaks' ELSE 'silent' END AS downside, CASE WHEN byy THEN -norm_fcf_yield ELSE -100.0 / ev_ebit END AS downside_rank,
    CASE WHEN net_income IS NULL OR ocf IS NULL OR share_trend IS NULL OR roic IS NULL OR rev_growth IS NULL OR stb IS NULL THEN 'refuses' WHEN net_income > 0 AND ocf > 0 AND share_trend <= 2 AND roic >= 15 AND rev_growth >= 10 AND stb THEN 'speaks' ELSE 'silent' END AS compounder, -rev_growth AS compounder_rank FROM ln1)"""

FORGE = """vl AS (SELECT symbol AS entity, CASE WHEN count(*) >= 51 THEN stddev_pop(ret) * sqrt(52) END AS vol FROM rets GROUP BY symbol),
  sbd AS (SELECT symbol AS entity, CASE WHEN count(*) >= 6 THEN bool_and(close < 1500) END AS sub_dollar FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM bars) WHERE rn <= 6 GROUP BY symbol),
  bs AS (SELECT entity, arg_max_null(basic_shares, period_end) AS basic_shares, arg_max_null(diluted_shares, period_end) AS diluted_shares FROM an GROUP BY entity),
  fy0 AS (SELECT entity, max(end_day) AS end_day, arg_max(value, end_day) AS value FROM shr GROUP BY entity, year(end_day)), fy1 AS (SELECT *, lag(end_day) OVER (PARTITION BY entity ORDER BY end_day) AS prev FROM fy0),
  fy2 AS (SELECT *, sum(CASE WHEN prev IS NULL OR end_day - prev >= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY end_day) AS step FROM fy1), fy3 AS (SELECT entity, step, max(end_day) AS d1, arg_max(value, end_day) AS v1 FROM fy2 GROUP BY entity, step),
  fy4 AS (SELECT *, lag(d1) OVER (PARTITION BY entity ORDER BY step) AS d0, lag(v1) OVER (PARTITION BY entity ORDER BY step) AS v0 FROM fy3),
  fy5 AS (SELECT entity, 100.0 * (pow(v1 / v0, 1.0 / greatest((d1 - d0) / 365.25, 1e-9)) - 1) AS pct FROM fy4 WHERE v0 > 0 AND v1 > 0 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY d1 DESC) <= 3),
  rpt AS (SELECT entity, count(*) FILTER (pct > 5) AS repeat_years FROM fy5 GROUP BY entity),
  rvs AS (SELECT l.symbol AS entity, coalesce(bool_or(sp.ratio * CASE WHEN sp.symbol % 5 = 0 THEN 0.25 ELSE 1 END < 1 AND sp.day <= l.last AND l.last - sp.day <= 730), false) AS reverse_split FROM (SELECT symbol, max(day) AS last FROM bars GROUP BY symbol) l LEFT JOIN splits sp ON sp.symbol = l.symbol GROUP BY l.symbol),
  f0 AS (SELECT vt.*, vol, sub_dollar, basic_shares, diluted_shares, repeat_years, reverse_split, total_liab / nullif(total_liab + market_cap, 0) AS tl FROM vt LEFT JOIN vl ON vl.entity = vt.entity LEFT JOIN sbd ON sbd.entity = vt.entity LEFT JOIN bs ON bs.entity = vt.entity LEFT JOIN rpt ON rpt.entity = vt.entity LEFT JOIN rvs ON rvs.entity = vt.entity),
  f1 AS (SELECT *, CASE WHEN share_class OR (share_trend IS NULL AND repeat_years IS NULL) THEN 'unmeasured' WHEN coalesce(share_trend > 10, false) OR coalesce(repeat_years >= 2, false) THEN 'severe' WHEN share_trend > 5 THEN 'caution' ELSE 'none' END AS serial_diluter,
    CASE WHEN ocf IS NULL OR (ocf < 0 AND cash IS NULL) THEN 'unmeasured' WHEN ocf < 0 AND cash / (-ocf / 12.0) < 12 THEN 'severe' ELSE 'none' END AS cash_runway,
    CASE WHEN net_income IS NULL OR tl IS NULL OR vol IS NULL THEN 'unmeasured' WHEN CAST(net_income < 0 AS INT) + CAST(tl > 0.5 AS INT) + CAST(vol > 0.6 AS INT) = 3 THEN 'severe' WHEN CAST(net_income < 0 AS INT) + CAST(tl > 0.5 AS INT) + CAST(vol > 0.6 AS INT) = 2 THEN 'caution' ELSE 'none' END AS distress,
    CASE WHEN sub_dollar IS NULL AND equity IS NULL AND reverse_split IS NULL THEN 'unmeasured' WHEN coalesce(sub_dollar, false) OR coalesce(equity * 10 < 2.5e6, false) OR coalesce(reverse_split, false) THEN 'severe' ELSE 'none' END AS delisting,
    CASE WHEN NOT coalesce(basic_shares > 0, false) OR diluted_shares IS NULL THEN 'unmeasured' WHEN 100.0 * (diluted_shares - basic_shares) / basic_shares > 10 THEN 'caution' ELSE 'none' END AS overhang,
    CASE WHEN net_income IS NULL OR ocf IS NULL OR NOT coalesce(total_assets > 0, false) THEN 'unmeasured' WHEN 100.0 * (net_income - ocf) / total_assets > 10 THEN 'caution' ELSE 'none' END AS accrual_mirage FROM f0),
  f2 AS (SELECT *, len(list_filter([serial_diluter, cash_runway, distress, delisting, overhang, accrual_mirage], lambda x: x = 'severe')) AS fsev, len(list_filter([serial_diluter, cash_runway, distress, delisting, overhang, accrual_mirage], lambda x: x = 'caution')) AS fcau,
    len(list_filter([serial_diluter, cash_runway, distress, delisting, overhang, accrual_mirage], lambda x: x <> 'unmeasured')) AS fm FROM f1),
  fo AS (SELECT *, CASE WHEN fsev > 0 THEN 'Forged-out' WHEN fcau >= 2 THEN 'Watch' WHEN serial_diluter = 'unmeasured' OR cash_runway = 'unmeasured' OR fm < 3 THEN 'Unknown' ELSE 'Survivor' END AS forge_verdict FROM f2)"""
LANE = f"{FINDINGS}, {VALUE}, {LENSES}, {FORGE}"
