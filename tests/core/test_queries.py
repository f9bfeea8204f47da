"""Registered queries and their SQL twins give the same rows on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
NAMES = ["w1_sma_set", "w5_macd", "r1_yearline_filter", "z8_resonance_score", "k10_candlesticks", "v2_wave_structure", "a1_resample_month", "s9_bar_upsert", "n2_stream_bars"]
NAMES += ["k8_gaps", "a11_sector_census", "a17_bars_checksum", "q11_changed_symbols", "p7_as_of", "a2_sector_weeks", "u7_outside_turnover", "s7_watchlist_export", "s16_flat_report", "a21_coverage_report"]
NAMES += ["w22_poc", "w23_platform_breakout", "k11_newest_hits", "k10_combo_details", "k13_candle_result", "r4_main_wave_signal", "r8_technical_detail", "r14_breakout_quality"]
NAMES += ["v3_rules_and_verdict", "v4_ten_steps", "t8_furthest_steps", "t8_closest_pairs", "v11_wave_scan", "v10_attached_waves", "z10_combined_score"]
NAMES += ["v9_portfolio_evaluation", "n3_macd_alerts", "v6_correlations", "p7_replayed_evaluation", "z16_relaxed_gates", "r6_platform_rule", "r7_checklist", "r14_adaptive_breakout", "r15_accumulation", "z12_structure_summary"]
NAMES += ["n5_scan_flush", "n7_late_bars", "n1_appended_bars", "p18_scan_table", "p11_signal_filter", "s6_watchlist_import", "x1_sector_analysis"]
NAMES += ["s1_stored_bars", "s2_market_increment", "f4_day_files", "f4_day_stream", "a4_audit_report", "a4_audit_samples", "r22_market_verdict", "x6_sector_table"]
NAMES += ["z9_three_resonance", "p14_flat_result", "z16_row_gates", "x7_true_resonance", "n4_annotated_alerts", "a12_gate_funnel", "k6_main_pattern"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}" if os.path.isfile(f"{SF}/{t}") else f"{SF}/{t}/*.parquet"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(c[0] for c in found.description)
    place = [[c[0] for c in found.description].index(c) for c in order]
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert key(got.select(*order).collect()) == key(tuple(r[i] for i in place) for r in found.fetchall())


def test_entry_and_catalog(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
