"""Certified sources, plans of imports and the rules of writing, on small cases."""

import hashlib
import json
from decimal import Decimal

from pyspark.sql import functions as F

from portfolia.functions.text import unit_code
from portfolia.operators import imports, rules
from portfolia.sources import profile, workbook
from tests.test_sources import make_workbook


def test_profile_of_a_workbook(spark, tmp_path):
    make_workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no package")
    cells = workbook.workbook_cells(spark, str(tmp_path))
    good = profile.Profile(["Plan"], [("Plan", "A1", "Código")], [("Plan", "C2")], [("Plan", "A2", 1, 2, 2)])
    assert [r.code for r in profile.diagnostics(cells, good).collect()] == ["WORKBOOK_UNREADABLE"]
    bad = profile.Profile(["Curve"], [("Plan", "A1", "Code"), ("Plan", "Z9", "x")], [("Plan", "A2")], [("Plan", "C2", 1, 2, 2)])
    found = [(r.code, r.severity, r.address) for r in profile.diagnostics(cells, bad, strict=True).collect() if r.path.endswith("a.xlsx")]
    assert found == [("FORMULA_EXPECTED", "error", "A2"), ("HEADER_MISMATCH", "error", "A1"), ("HEADER_MISMATCH", "error", "Z9"), ("SHEET_MISSING", "error", None), ("SHEET_UNEXPECTED", "error", None), ("TOTAL_MISMATCH", "error", "C2")]
    assert profile.diagnostics(cells.limit(0), good).count() == 0


def test_certified_files(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    listed = {"a": hashlib.sha256(b"a").hexdigest().upper(), "b": "0", "d": "0"}
    got = {r.name: r.problem for r in profile.certified_files(spark, str(tmp_path), listed).collect()}
    assert got == {"a": None, "b": "hash_mismatch", "c": "unlisted", "d": "missing"}


def test_snapshot_file(spark, tmp_path):
    rows = [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}, {"id": 2, "name": "c"}, {"id": 3, "name": "d", "more": 1}, {"id": 4}, {"id": None, "name": "e"}]
    (tmp_path / "s.jsonl").write_text("\n".join([*map(json.dumps, rows), "no json"]))
    got = sorted((r.id or 0, r.problem or "") for r in profile.read_snapshot(spark, str(tmp_path), "id long, name string", ["id"]).collect())
    assert got == [(0, "null_key"), (0, "unreadable"), (1, ""), (2, "duplicate_key"), (2, "duplicate_key"), (3, "unknown_field"), (4, "missing_field")]


def test_order_of_a_plan(spark):
    keys = [(r, f"{p}{k:03d}") for r in (1, 2) for p in ("2015-01-", "2016-02-", "x") for k in range(20)]
    got = imports.ordered(spark.createDataFrame(keys, "r int, k string").repartition(5), "r", "k").collect()
    assert [(r.r, r.k) for r in sorted(got, key=lambda r: r.plan_order)] == sorted(keys) and sorted(r.plan_order for r in got) == list(range(1, len(keys) + 1))
    assert imports.ordered(spark.createDataFrame([], "r int, k string"), "r", "k").count() == 0


def test_resolutions(spark):
    candidates = spark.createDataFrame([(c, "conflict", "h") for c in "abcd"], "candidate_id string, action string, state_hash string")
    reviewed = spark.createDataFrame([("a", "insert", "h"), ("b", "insert", "old"), ("c", "insert", "h"), ("c", "no_op", "h"), ("z", "insert", "h")], "candidate_id string, decision string, state_hash string")
    got = {r.candidate_id: (r.action, r.resolution) for r in imports.resolve(candidates, reviewed, ["state_hash"]).collect()}
    assert got == {"a": ("insert", "applied"), "b": ("conflict", "stale"), "c": ("conflict", "ambiguous"), "d": ("conflict", "undecided")}


def test_plan_hash_ignores_the_order_of_rows(spark):
    row = lambda i, a: (i, 1, f"k{i}", i, "c", None, Decimal(1), "UN", "BRL", Decimal(1), Decimal(1), None, a)
    schema = "id long, project_id long, source_line_key string, line_number int, item_code string, description string, quantity decimal(12,4), unit_code string, currency_code string, unit_price decimal(12,4), total_amount decimal(20,2), target_id long, action string"
    items = spark.createDataFrame([row(i, "insert" if i % 2 else "no_op") for i in range(40)] + [row(99, "rejected")], schema)
    one, two = (imports.plan_hashes(x).collect() for x in (items, items.orderBy(F.rand(2)).repartition(7)))
    assert one == two and (one[0].inserts, one[0].no_ops) == (20, 20)
    assert imports.plan_hashes(items.where("id <> 3")).first().plan_hash != one[0].plan_hash


def test_units(spark):
    rows = spark.createDataFrame([(" Unidade ",), ("SERVIÇO",), ("unidade e serviço",), ("kg",), ("",), (None,)], "u string").select(unit_code(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["UN", "SERV", "US", None, None, None]


def test_row_versions(spark):
    current = spark.createDataFrame([(1, 1, "a"), (2, 1, None), (3, 4, "c"), (4, 1, "d"), (5, 1, "e")], "id long, row_version long, x string")
    writes = spark.createDataFrame([(1, 1, "b"), (2, 1, None), (3, 3, "z"), (4, 1, "p"), (4, 1, "q"), (9, 1, "n")], current.schema)
    got = {r.id: (r.row_version, r.x, r.outcome) for r in rules.versioned(current, writes, "id", ["x"]).collect()}
    assert got == {1: (2, "b", "updated"), 2: (1, None, "unchanged"), 3: (4, "c", "stale"), 4: (1, "d", "ambiguous"), 5: (1, "e", "kept"), 9: (None, None, "missing")}


def test_approvals(spark):
    schema = "request_id long, status string, actor_id long, created_by long, updated_by long, exceptional boolean, justification string"
    users = spark.createDataFrame([(1, "admin", True), (2, "approver", False), (3, "editor", True)], "id long, role string, active boolean")
    pending = "pending_approval"
    requests = spark.createDataFrame([(1, pending, 1, 3, None, None, None), (2, pending, 1, 1, None, True, " "), (3, pending, 1, 3, 1, True, "only one"), (4, pending, 2, 3, None, None, None), (5, pending, 3, 1, None, None, None), (6, "draft", 1, 3, None, None, None)], schema)
    verdicts = lambda u: {r.request_id: r.verdict for r in rules.approvals(requests, u).collect()}
    assert verdicts(users) == {1: "approved", 2: "exception_not_justified", 3: "approved", 4: "forbidden", 5: "forbidden", 6: "invalid_transition"}
    more = verdicts(users.withColumn("active", F.lit(True)))
    assert (more[3], more[4]) == ("other_approver_exists", "approved")


def test_differences_of_sets(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {r.name: r.difference for r in rules.set_difference(names("a", "b", "c"), names("b", "c", "c", "d"), "name").collect()}
    assert got == {"a": "missing", "c": "duplicate", "d": "unexpected"}
