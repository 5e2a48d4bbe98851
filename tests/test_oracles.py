"""Registered queries against their SQL on the smallest tables (skipped where these are absent)."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tallyframe.plans import connectors, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["FLAGSHIP_game_states", "JON07_AGG05_AGG06_AGG07_AGG08_val_summary", "GAT12_failures_by_gate", "WIN05_JON13_AGG18_form_to_date", "WIN06_PRE03_rest_days", "JON21_FLT10_FLT11_last_tick", "EVT01_WIN10_WIN11_action_log", "EVT06_possession_boundaries", "EVT08_AGG24_points_by_team", "AGG31_breakdown", "MLR06_gram", "PRJ05_clock_lenient", "PRJ18_free_throw", "PRJ22_name_folding", "PRJ41_candidate_slugs", "HSH03_table_digest", "EVT07_WIN12_and_one", "GAT08_WIN02_WIN03_monotone", "GAT09_AGG11_split_leakage", "GAT01_JON10_relationships", "AGG32_material", "JON22_subgroup_lift", "MLR04_MLR05_penalties", "BAY10_decayed_gram", *connectors.QUERIES]


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    out = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(names)
    want = Counter(tuple(normal(r[names.index(c)]) for c in df.columns) for r in out.fetchall())
    assert Counter(tuple(normal(v) for v in r) for r in df.collect()) == want


def test_entry_and_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) >= len(registry.QUERIES)
    if os.path.isdir(SF):
        assert len(__spark_entry__.entry(spark).columns) == 33
