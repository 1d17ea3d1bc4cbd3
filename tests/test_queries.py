"""Registered queries against their SQL in DuckDB on the smallest tables. A spread
over every module runs by default; LODESTAT_ALL=1 runs all of them."""

import os

import pytest

from tools import check
import __spark_entry__ as entry

SF = os.environ.get("LODESTAT_SF_DIR", "/root/testdata/sf0.001")
SPREAD = """pit_filter latest_filed ytd_subtrahend per_tag_chain class_share_sum split_restatement asof_price asof_year_prior scan_fact_csv parse_iso_day
universe_filter name_key dedupe_listing identity_join max_drawdown skew_kurtosis forward_return turnover weekdays_behind correlation_matrix view_v_price
view_current_metric failures_since_ok status_transitions review_matrix parity balance_report modified_dietz snapshot_diff ffill_portfolio trigger_eval streak thesis_rollup
carry_forward probe_cash_engine probe_stress probe_predictability score_universe buffett_checklist midrank_percentile period_setops canonical_labels
st_current_view st_fingerprint_change row_chain credit_loss debt_composition monitor_run broker_refused metric_ancestors disclosures unit_flows shortlist_per_tier""".split()
SLUGS = sorted(entry.queries()) if os.environ.get("LODESTAT_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("slug", SLUGS)
def test_matches_sql(spark, duck, slug):
    state, note, _ = check.compare(spark, duck, slug, SF)
    assert state in ("OK", "ROWS"), f"{slug}: {state} {note}"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
