"""Golden fixtures and properties of the domain's functions."""

import datetime as dt
import json
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portfolia.functions import text
from portfolia.functions.money import balance, canonical_money, derived_total, distribute, scaled_decimal
from portfolia.operators import integrity, planning, portfolio, quality, views
from portfolia.sources.bindings import Tables


def d(day):
    return dt.date.fromisoformat(day)


@pytest.fixture(scope="module")
def golden(spark):
    """Projects A and B in BRL, one in USD and a hidden one; a baseline, a revision, and three events."""
    make = spark.createDataFrame
    item = "id long, project_id long, source_line_key string, line_number int, item_code string, description string, quantity decimal(20,4), unit_code string, unit_price decimal(20,4), currency_code string, total_amount decimal(20,2), active boolean, deleted boolean"
    line = lambda k, v, p, m, a, c: (k, v, p, None, "billing_planned", "project", d(m), Decimal(a), c)
    one = lambda k, p, n, code, a, c: (k, p, f"k{k}", n, code, "x", Decimal(1), "UN", Decimal(a), c, Decimal(a), True, False)
    lines = [line(1, 1, 1, "2026-07-01", "1000000", "BRL"), line(2, 1, 1, "2026-08-01", "1000000", "BRL"), line(3, 1, 1, "2026-09-01", "0", "BRL"), line(4, 1, 2, "2026-07-01", "400000", "BRL"), line(5, 1, 2, "2026-08-01", "400460.18", "BRL"), line(6, 1, 3, "2026-07-01", "100", "USD"), line(7, 2, 1, "2026-07-01", "10", "BRL")]
    projects = [(1, "A", "A", 1, "active", "BRL", Decimal("2000000"), False), (2, "B", "B", 1, "active", "BRL", Decimal("900000"), False), (3, "U", "U", 1, "active", "USD", Decimal("100"), False), (4, "H", "H", 1, "draft", "BRL", Decimal("50"), False)]
    table = make(lines, "id long, plan_version_id long, project_id long, project_item_id long, metric_type string, planning_level string, competence_month date, amount decimal(20,2), currency_code string")
    return Tables(
        spark,
        clients=make([(1, "C", "s", True)], "id long, display_name string, segment string, active boolean"),
        projects=make([(*p[:7], d("2026-07-01"), dt.datetime(2026, 7, 1), p[7]) for p in projects], "id long, project_code string, project_name string, client_id long, status string, base_currency string, contract_value decimal(20,2), data_reference_date date, updated_at timestamp_ntz, deleted boolean"),
        items=make([one(1, 1, 1, "REPEATED", "1000000", "BRL"), one(2, 1, 2, "REPEATED", "1000000", "BRL"), one(3, 2, 1, "i", "800460.18", "BRL"), one(4, 3, 1, "i", "100", "USD"), one(5, 4, 1, "i", "50", "BRL")], item),
        versions=make([(1, "Baseline", "draft", True, None), (2, "Revision", "draft", False, 1)], "id long, name string, status string, is_baseline boolean, source_version_id long"),
        lines=table,
        scopes=table.select("plan_version_id", "project_id", "metric_type", "planning_level", "currency_code").distinct(),
        actuals=make([(1, 1, None, "billing_actual", "draft", d("2026-07-15"), Decimal(50), "BRL"), (2, 1, None, "billing_actual", "posted", d("2026-07-20"), Decimal(25), "BRL"), (3, 3, None, "billing_actual", "posted", d("2026-07-10"), Decimal(10), "USD")], "id long, project_id long, project_item_id long, metric_type string, status string, competence_date date, amount decimal(20,2), currency_code string"),
    )


def test_golden_curves(golden):
    rows = views.v5_s_curve_portfolio(golden).collect()
    brl = sorted((r.competence_month, r.monthly_amount, r.cumulative_amount) for r in rows if r.plan_version_id == 1 and r.currency_code == "BRL")
    assert [(str(a), str(b)) for _, a, b in brl] == [("1400000.00", "1400000.00"), ("1400460.18", "2800460.18"), ("0.00", "2800460.18")]
    assert {(r.actual_status, str(r.cumulative_amount)) for r in rows if r.series_kind == "actual" and r.currency_code == "BRL"} == {("draft", "50.00"), ("posted", "25.00")}
    assert [str(r.cumulative_amount) for r in rows if r.plan_version_id == 2] == ["10.00"]


def test_golden_overviews(golden):
    rows = {r.project_code: r for r in views.v2_project_overview(golden).collect()}
    assert (rows["A"].project_reconciliation_status, rows["A"].contract_item_delta, rows["A"].actual_event_count) == ("PASS", Decimal("0.00"), 2)
    assert (rows["B"].project_reconciliation_status, rows["B"].contract_item_delta, rows["B"].actual_event_count) == ("ERROR", Decimal("-99539.82"), 0)
    total = {r.currency_code: r.contract_item_delta_total for r in views.v1_portfolio_overview(golden).collect()}
    assert total == {"BRL": Decimal("99539.82"), "USD": Decimal("0.00")}
    codes = [r.finding_code for r in views.v7_data_quality(golden).collect()]
    assert codes.count("ACTUAL_STATUS_UNRESOLVED") == 2 and codes.count("PROJECT_VALUE_MISMATCH") == 1


def test_golden_visibility_and_findings(golden):
    seen = portfolio.visible(golden, "viewer")
    assert {r.project_code for r in seen.projects.collect()} == {"A", "B", "U"} and seen.lines.count() == 0
    assert portfolio.visible(golden, "editor").lines.count() == 7 and portfolio.visible(golden, "admin").projects.count() == 4
    late = {r.rule_code for r in quality.findings(golden, "2026-07-31 00:00:00").collect()}
    assert "PROJECT_DATA_STALE" not in late  # exactly 30 days
    assert [r.rule_code for r in quality.findings(golden, "2026-07-31 00:00:01").collect()].count("PROJECT_DATA_STALE") == 4
    assert {r.unscheduled_balance_status for r in portfolio.portfolio(golden).collect()} == {"no_official_plan"}


def test_visibility_of_each_table(golden, spark):
    make = spark.createDataFrame
    audit = make([(1, dt.datetime(2026, 7, 1), 1, "UPDATE")], "id long, changed_at timestamp_ntz, entity_id long, operation string")
    snapshots = make([(1, 1, 1, "success"), (2, 1, 2, "failed"), (3, 4, 1, "success")], "id long, project_id long, authority_revision long, status string")
    cells = make([(1, 1, None, d("2026-07-01"), "value", Decimal(1)), (2, 2, None, d("2026-07-01"), "value", Decimal(1))], "plan_version_id long, financial_plan_line_id long, project_item_id long, competence_month date, declaration_state string, canonical_amount decimal(20,2)")
    given = {n: getattr(golden, n) for n in ("clients", "projects", "items", "lines", "scopes", "actuals")}
    count = lambda t, role: [getattr(portfolio.visible(t, role), n).count() for n in portfolio.TABLE_NAMES]
    t = Tables(spark, versions=golden.versions, audit=audit, snapshots=snapshots, cells=cells, **given)
    rows = {role: count(t, role) for role in (None, "viewer", "editor", "approver", "admin")}
    assert rows == {None: [0] * 10, "viewer": [1, 3, 4, 0, 0, 0, 3, 0, 1, 0], "editor": [1, 3, 4, 2, 7, 4, 3, 2, 1, 0], "approver": [1, 3, 4, 2, 7, 4, 3, 2, 1, 0], "admin": [1, 4, 5, 2, 7, 4, 3, 2, 3, 1]}
    for status, seen in (("approved", 1), ("locked", 1), ("archived", 1), ("pending_approval", 0)):  # by the cell's own version, of which one cell's is published
        versions = golden.versions.withColumn("status", F.when(F.col("id") == 2, status).otherwise(F.col("status")))
        others = Tables(spark, versions=versions, audit=audit, snapshots=snapshots, cells=cells, **given)
        assert [portfolio.visible(others, role).cells.count() for role in ("viewer", "editor", "approver")] == [seen, 2, 2]
    with pytest.raises(ValueError):
        portfolio.visible(t, "nobody")


def test_month_spine(spark):
    bounds = spark.createDataFrame([(1, d("2000-01-01"), d("2019-12-01")), (2, None, None)], "k long, first_month date, last_month date")
    assert planning.month_spine(bounds, "k").count() == 240
    far = spark.createDataFrame([(7, d("2000-01-01"), d("2020-01-01"))], bounds.schema)
    with pytest.raises(Exception, match="more than 240 months: 7"):
        planning.month_spine(far, "k").collect()


def test_canonical_numbers_and_keys():
    numbers = {1e-7: "1e-7", 0.00001: "0.00001", 1e-6: "0.000001", 1.5e-7: "1.5e-7", 1e21: "1e+21", 123e18: "123000000000000000000", -0.0: "0", -2.50: "-2.5", 0.1: "0.1", 12345678901234567890: "12345678901234567000", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 100: "100"}
    assert {k: text.canonical_json(k) for k in numbers} == numbers
    assert text.canonical_json({"\ue000": 1, "\U0001f600": True, "a": False}) == '{"a":false,"\U0001f600":true,"\ue000":1}'
    with pytest.raises(ValueError):
        text.canonical_json(float("nan"))
    texts = ['{"b":1,"a":[-0,0.0,-0.0,1e3,{"z":null,"A":true}]}', '{"n":123456789012345678}', '{"n":-12}', '{"\\u00e9":"\\u001f\\n\\"","a":"é\\ud83d\\ude00"}', '"x"', "[]", "1.50", '{"a":"/\\/ \x7f"}', '{"a":1e400}', "NaN"]
    for json_text in texts[:-2]:
        assert text.canonical_text(json_text) == text.canonical_json(json.loads(json_text))
    for json_text in texts[-2:]:
        with pytest.raises(ValueError):
            text.canonical_text(json_text)


def test_order_of_rows_does_not_matter(golden, spark):
    shuffled = Tables(spark, **{n: getattr(golden, n).orderBy(F.rand(3)).repartition(5) for n in ("clients", "projects", "items", "versions", "lines", "scopes", "actuals")})
    for view in (views.v1_portfolio_overview, views.v6_s_curve_project, views.v7_data_quality, planning.summaries):
        assert sorted(map(str, view(golden).collect())) == sorted(map(str, view(shuffled).collect()))


def test_balance(spark):
    row = spark.createDataFrame([(Decimal(1000), Decimal(200), Decimal(300)), (Decimal(1000), Decimal(200), Decimal(900))], "c decimal(20,2), a decimal(20,2), p decimal(20,2)")
    got = [tuple(map(str, r)) for r in row.select(*balance(F.col("c"), F.col("a"), F.col("p")).values()).collect()]
    assert got == [("500.00", "500.00", "False"), ("-100.00", "0.00", "True")]


def test_distribution(spark):
    rows = [("a", "100", 1, "33.3333"), ("a", "100", 2, "33.3333"), ("a", "100", 3, "33.3334"), ("b", "0.01", 1, "50"), ("b", "0.01", 2, "50"), ("c", "5", 1, "99.99"), ("d", "5", 1, "50"), ("d", "5", 1, "50"), ("e", "10", 1, "50"), ("e", "10", 2, "30"), ("e", "10", 3, "20")]
    table = spark.createDataFrame([(g, Decimal(a), s, Decimal(w)) for g, a, s, w in rows], "g string, amount decimal(20,2), slot int, weight decimal(7,4)")
    got = sorted((r.g, r.slot, None if r.allocated is None else str(r.allocated)) for r in distribute(table, ["g"], ["slot"]).collect())
    assert got == [("a", 1, "33.34"), ("a", 2, "33.33"), ("a", 3, "33.33"), ("b", 1, "0.01"), ("b", 2, "0.00"), ("c", 1, None), ("d", 1, None), ("d", 1, None), ("e", 1, "5.00"), ("e", 2, "3.00"), ("e", 3, "2.00")]


MONEY = {"0": "0.00", "-0": "0.00", "0.005": "0.01", "0.00499999999999": "0.00", "999.99999999999999": "1000.00", "866.59999999999991": "866.60", "-0.01": None, "+1": None, "1e2": None, "1,00": None, "01.00": None, "1.123456789012345": None, "1" * 19: None, "１": None, "1​": None, "": None, "9" * 18 + ".995": None, "9" * 18 + ".99": "9" * 18 + ".99"}


def test_money_text(spark):
    rows = spark.createDataFrame([(k,) for k in MONEY], "t string").select("t", canonical_money(F.col("t")).alias("m")).collect()
    assert {r.t: None if r.m is None else str(r.m) for r in rows} == MONEY
    codes = spark.createDataFrame([("1.2350",), ("0",), ("1.23456",)], "t string").select(scaled_decimal(F.col("t"), 4, False)).collect()
    assert [r[0] for r in codes] == [Decimal("1.2350"), None, None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.decimals(0, 10**9, places=4), st.decimals(0, 10**9, places=4)), min_size=30, max_size=60))
def test_totals_are_rounded_once(spark, pairs):
    pairs = [*pairs, (Decimal("0.0001"), Decimal("49.9996")), (Decimal(1), Decimal("1.2350"))]
    got = spark.createDataFrame(pairs, "q decimal(20,4), p decimal(20,4)").select("q", "p", derived_total(F.col("q"), F.col("p")).alias("t")).collect()
    assert all(r.t == (r.q * r.p).quantize(Decimal("0.01"), ROUND_HALF_UP) for r in got)


def test_text_functions(spark):
    rows = spark.createDataFrame([("  Ação   Ltda ",), ("Ação ltda",), (None,), ("   ",), ("a​b",)], "t string")
    got = rows.select(text.canonical_name("t"), text.name_family("t"), text.item_text("t")).collect()
    assert [r[0] for r in got] == ["Ação Ltda", "Ação ltda", None, None, "a​b"] and [r[1] for r in got][:2] == ["acao", "acao"]
    assert got[4][2] is None and got[1][2] == "Ação ltda"
    assert text.canonical_json({"b": [1.0, None], "a": {"z": "é", "y": True}}) == '{"a":{"y":true,"z":"é"},"b":[1,null]}'
    same = spark.createDataFrame([('{"b":1,"a":2.0}',), ('{ "a": 2, "b": 1.0 }',)], "t string").select(text.canonical_hash(F.col("t"))).distinct()
    assert same.count() == 1
    codes = spark.createDataFrame([(" 2024-01-00012 x",), ("x",)], "t string").select(text.project_code(F.col("t"))).collect()
    assert [r[0] for r in codes] == ["2024-01-00012", None]


def test_search_and_pages(golden, spark):
    names = spark.createDataFrame([("50%_off",), ("50 off",), ("A\\b",)], "n string")
    assert [names.where(portfolio.contains(x, "n")).count() for x in ("%_", "OFF", "\\", "zz")] == [1, 2, 1, 0]
    with pytest.raises(ValueError):
        portfolio.page(portfolio.portfolio(golden), "id; drop")
    assert [r.project_id for r in portfolio.page(portfolio.portfolio(golden), "contract_value", True, 1, 2).collect()] == [1, 2]


def test_audit_and_merge(spark):
    before = spark.createDataFrame([(1, "a", False), (2, None, False), (3, "c", True), (4, "d", False)], "id long, x string, deleted boolean")
    after = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", False), (5, "e", False)], before.schema)
    got = {r.id: (r.operation, r.changed_columns) for r in integrity.audit_changes(before, after, "id", ["x"]).collect()}
    assert got == {2: ("UPDATE", "x"), 3: ("RESTORE", ""), 4: ("DELETE", None), 5: ("INSERT", None)}
    merged = planning.upsert(spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, amount int"), spark.createDataFrame([(2, 6), (3, None), (4, 9)], "k int, amount int"), ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, 5, "kept"), (2, 6, "unchanged"), (3, None, "updated"), (4, 9, "inserted")]
