"""A cross-section of the registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
NAMES = ["flagship_by_division", "e1_rolling_form", "e9_rating_replay", "e12_point_in_time_totals", "e14_expanding_folds", "b4_log_pool", "b19_value_bets", "c3_settle_interval", "c6_as_of_before", "c10_token_containment", "c11_unique_or_refuse", "c12_first_candidate", "c14_fuzzy_dedup", "h4_ascii_fold", "d11_betting_record", "d16_gap_distribution", "h8_letter_values", "i4_project_grid", "a1_dirty_csv", "a5_scoreboard_json", "k6_stream_supersede"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(TABLES):
        db.sql(f"create view {file.removesuffix('.parquet')} as select * from '{TABLES}/{file}'")
    want = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, TABLES)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
