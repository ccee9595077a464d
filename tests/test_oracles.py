"""Every domain query against its SQL at the smallest scale, and its key."""

import glob
import os

import duckdb
import pytest

from portfolia.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
KEYS = {"v2_project_overview": ["project_id"], "v3_project_items": ["project_item_id"], "v4_financial_monthly": ["analytical_fact_key"], "v7_data_quality": ["finding_id"], "v8_plan_versions": ["analytical_version_key"], "g1_portfolio_list": ["project_id"], "g12_findings": ["finding_id"]}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    assert glob.glob(f"{SF}/*.parquet")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    found = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert got == sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in names) for r in found.fetchall())
    if name in KEYS:
        assert frame.select(*KEYS[name]).distinct().count() == len(got)
