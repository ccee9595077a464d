"""Queries over whole tables leave no row out."""

import json

import pytest

from portfolia.plans import registry
from portfolia.sources.bindings import Tables
from tests.test_oracles import SF


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def test_all_codes_and_posted_items_are_compared(spark, tables):
    codes = {r.name: r.difference for r in registry.queries()["r9_parts_difference"](spark, SF).collect()}
    many = tables.items.groupBy("item_code").count().where("count > 1").collect()
    assert many and all(codes[r.item_code] == "duplicate" for r in many)
    posted = registry.queries()["r9_posted_difference"](spark, SF)
    assert posted.where("difference = 'missing'").count() == tables.items.count() - tables.actuals.where("status = 'posted'").count() > 0


def test_every_project_has_months_and_every_line_a_verdict(spark, tables):
    months = registry.queries()["g5_all_editor_months"](spark, SF)
    assert months.select("project_id").distinct().count() == tables.lines.select("project_id").distinct().count()
    assert months.groupBy().sum("line_count").first()[0] == tables.lines.count()
    assert registry.queries()["x7_all_plan_writes"](spark, SF).count() == tables.lines.count()


def test_every_project_has_a_snapshot_of_all_its_rows(spark, tables):
    rows = registry.queries()["s8_all_nested_snapshots"](spark, SF).collect()
    assert sorted(r.project_id for r in rows) == sorted(r.id for r in tables.projects.select("id").collect())
    for name, table in (("items_json", tables.items), ("scopes_json", tables.scopes.where("plan_version_id = 3")), ("cells_json", tables.cells), ("lines_json", tables.lines.where("plan_version_id = 3"))):
        assert sum(len(json.loads(r[name])) for r in rows) == table.count() > 0
