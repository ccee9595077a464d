"""The constraint registry: one row for each broken constraint, nulls hold, and what can't be checked is listed."""

from decimal import Decimal

from pyspark.sql import functions as F

from portfolia.operators import constraints
from portfolia.sources.bindings import Tables

CELLS = "project_item_id long, competence_month date, declaration_state string, source_numeric_text string, canonical_amount decimal(20,2), financial_plan_line_id long"


def broken(spark, table, rows, schema):
    return sorted((r.constraint_name, r.row_key) for r in constraints.check(table, spark.createDataFrame(rows, schema)).collect())


def test_each_broken_constraint_is_a_row(spark):
    rows = [(1, " P", "", Decimal(-1), "active", "BRL"), (2, "P", "x", Decimal(0), "gone", "brl"), (3, None, None, None, None, None), (4, "P 4", "x", Decimal(1), "draft", "USD")]
    got = broken(spark, "projects", rows, "id long, project_code string, project_name string, contract_value decimal(20,2), status string, base_currency string")
    assert got == [("ck_currencies_code", "2"), ("ck_projects_code_normalized", "1"), ("ck_projects_contract_value", "1"), ("ck_projects_name_not_blank", "1"), ("project_status", "2")]


def test_dates_approvals_and_locators(spark):
    dates = [(1, "2026-01-02", "2026-01-01"), (2, "2026-01-01", "2026-01-01"), (3, None, "2026-01-01"), (4, "2026-01-01", None)]
    assert broken(spark, "projects", dates, "id long, start_date string, end_date string") == [("ck_projects_dates", "1")]
    versions = [(1, "draft", 5, None), (2, "draft", None, None), (3, "approved", 5, "d"), (4, "locked", None, "d"), (5, "archived", None, None), (6, "pending_approval", None, "d")]
    assert broken(spark, "versions", versions, "id long, status string, approved_by_user_id long, approved_at string") == [("ck_plan_versions_approval", k) for k in "146"]
    locators = ["Sheet!A1", "C:\\Users\\x", "see /home/me", "postgresql://h", "HTTPS://h", "token=1", "my token = 1", "mytoken=1", "x" * 1024, "x" * 1025, " ", "a/home/b", "C:x"]
    rows = [("project", str(k), 1, "source", text, "a" * 64) for k, text in enumerate(locators)]
    got = broken(spark, "source_references", rows, "observed string, observation_id string, reference_ordinal int, kind string, locator string, fingerprint string")
    assert sorted(int(key.split("|")[1]) for _, key in got) == [1, 2, 3, 4, 5, 6, 9, 10]


def test_states_of_cells(spark):
    d = "2026-01-01"
    good = [(1, d, "blank", None, None, None), (2, d, "explicit_zero", "0.00", Decimal(0), 7), (3, d, "value", "1.005", Decimal("1.01"), 8)]
    bad = [(4, d, "blank", "0", None, None), (5, d, "explicit_zero", "0.001", Decimal(0), 7), (6, d, "value", "0", Decimal(0), 8), (7, d, "value", "1.005", Decimal("1.00"), 8), (8, "2026-01-02", "blank", None, None, None), (9, d, "value", "01", Decimal(1), 8), (10, d, "empty", None, None, None), (11, d, "value", "1", Decimal(1), None)]
    rows = spark.createDataFrame(good + bad, CELLS.replace("date,", "string,")).withColumn("competence_month", F.col("competence_month").cast("date"))
    assert sorted(int(r.row_key.split("|")[0]) for r in constraints.check("cells", rows).collect()) == list(range(4, 12))


def test_what_a_table_lacks_is_listed(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = {r.constraint_name: (r.applies, r.violations) for r in constraints.summary(t, {name: getattr(t, name) for name in {c.table for c in constraints.CONSTRAINTS}}).where("table_name in ('projects', 'versions')").collect()}
    assert rows["ck_projects_budget_cost"] == rows["ck_plan_versions_approval"] == (False, None)
    assert rows["ck_projects_code_normalized"] == rows["ck_plan_versions_name_not_blank"] == (True, 0)
    names = [(c.table, c.name) for c in constraints.CONSTRAINTS]
    assert len(set(names)) == len(names)
