"""Queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Queries whose result no SQL can give; tests of their own hold them.
WITHOUT = {"ev_03", "ev_04", "ev_10", "ev_17_intervals", "ev_20", "ev_20_model", "ev_23_intervals", "ev_23_final_intervals", "ev_23_round1_intervals", "sort_05_features"}
CHOSEN = """src_01 src_02_load src_03 src_05_missing flt_02 flt_06 flt_08 scl_01 scl_04 scl_12 agg_01 agg_05_all agg_07 agg_09
    agg_10 jn_04 jn_05 ds_01 ds_02 ds_09 jn_07 jn_08 jn_11 jn_12 win_09 ev_01 ev_03_blocks ev_07 ev_08_leads ev_09 ev_12
    ev_14_days ev_14_weather ev_15 ev_17_seeds ev_19_leads ev_22 ev_23_final sort_01_written sort_03 ds_03
    ds_03_clean_train ds_05_valid ds_06_baseline ds_08_months st_01 st_02 agg_04 agg_06 agg_08 jn_03 ds_04 ds_07 ds_08 sort_02 src_02
    ev_17 src_05 ds_09_total jn_08_seg jn_09 jn_13 ev_13 ds_05
    ds_06_samples ds_08_variants ds_08_variants_past ml_02 ev_23_round1""".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return f"{float(value):.5f}".replace("-0.00000", "0.00000")
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_every_query_is_named_for_sql_or_known_to_have_none():
    without = {n for n in entry.queries() if n not in entry.oracle_sql()}
    assert {n for n in without if not n.startswith(("op", "ml_", "pipeline"))} == WITHOUT
