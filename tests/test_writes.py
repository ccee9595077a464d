"""Batches of writes and the audit reader: every outcome, refusals, order of requests, cursors."""

import datetime as dt
from decimal import Decimal

import pytest

from portfolia.operators import writes
from portfolia.operators.audit import AuditQuery, access_event, read_audit

ASKED = "request_id long, project_id long, source_key string, metric_type string, status string, amount decimal(20,2), currency_code string, actor_role string, actor_id long, created_by_user_id long"
PROJECTS = "id long, base_currency string, status string, deleted boolean"
GOOD = (1, "k", "billing_actual", "draft", Decimal(5), "BRL", "editor", 7, 7)


def projects(spark):
    return spark.createDataFrame([(1, "BRL", "active", False), (2, "USD", "draft", False), (3, "BRL", "active", True)], PROJECTS)


def changed(**values):
    names = ASKED.replace("decimal(20,2)", "decimal").split(", ")[1:]
    return tuple(values.get(name.split(" ")[0], old) for name, old in zip(names, GOOD, strict=True))


def events(spark, requests, existing=()):
    made = spark.createDataFrame([(k, *r) for k, r in enumerate(requests, 1)], ASKED)
    held = spark.createDataFrame(list(existing), "id long, project_id long, source_key string, metric_type string, status string")
    rows = writes.event_writes(made.repartition(3), held, projects(spark)).orderBy("request_id").collect()
    return [(r.outcome, r.reason, r.existing_event_id, r.existing_status, r.can_open) for r in rows]


def test_events_are_appended_or_say_why_not(spark):
    bad = {
        writes.NOT_ALLOWED: [{"actor_role": "viewer"}, {"actor_role": "approver"}, {"actor_role": None}, {"created_by_user_id": 8}, {"created_by_user_id": None}],
        writes.NO_REFERENCE: [{"project_id": 9}, {"project_id": None}, {"project_id": 3}, {"currency_code": "USD"}, {"currency_code": None}],
        writes.BROKEN: [{"source_key": " k"}, {"source_key": ""}, {"source_key": None}, {"metric_type": "cost"}, {"status": "open"}, {"amount": Decimal(-1)}, {"amount": None}],
    }
    for reason, rows in bad.items():
        assert events(spark, [changed(**row) for row in rows]) == [("refused", reason, None, None, None)] * len(rows)
    assert events(spark, [GOOD, changed(source_key="other", actor_role="admin", amount=Decimal(0)), changed(project_id=2, currency_code="USD")]) == [("accepted", None, None, None, None)] * 3
    assert events(spark, []) == []


def test_duplicate_source_keys_are_conflicts_with_the_first(spark):
    batch = [changed(actor_role="viewer"), changed(status="posted"), GOOD, GOOD, changed(source_key="r", metric_type="receipt_actual"), changed(source_key="r")]
    taken = ("conflict", writes.DUPLICATE)
    assert events(spark, batch) == [("refused", writes.NOT_ALLOWED, None, None, None), ("accepted", None, None, None, None), (*taken, 2, "posted", True), (*taken, 2, "posted", True), ("accepted", None, None, None, None), (*taken, None, None, False)]
    held = [(90, 1, "k", "billing_actual", "cancelled"), (91, 1, "r", "receipt_actual", "posted"), (92, 2, "k", "billing_actual", "draft")]
    assert events(spark, [GOOD, changed(source_key="r")], held) == [(*taken, 90, "cancelled", True), (*taken, None, None, False)]


def test_items_are_switched(spark):
    items = spark.createDataFrame([(1, 1, True, False, 3), (2, 1, False, False, 1), (3, 2, True, False, 1), (4, 1, True, True, 1), (5, 3, True, False, 1), (6, 1, True, False, 2)], "id long, project_id long, active boolean, deleted boolean, row_version long")
    asked = [
        (1, 1, 1, False, 3, "editor"), (2, 2, 1, True, 1, "admin"), (3, 1, 1, True, 3, "editor"), (4, 2, 1, False, 1, "editor"), (5, 3, 2, False, 1, "editor"), (6, 3, 2, False, 1, "admin"), (7, 4, 1, False, 1, "admin"), (8, 5, 3, False, 1, "admin"),
        (9, 1, 2, False, 3, "admin"), (10, 6, 1, False, 1, "editor"), (11, 6, 1, False, 2, "viewer"), (12, 6, 1, False, None, "admin"),
    ]
    make = lambda rows: spark.createDataFrame(rows, "request_id long, item_id long, project_id long, active boolean, expected_version long, actor_role string")
    got = {r.request_id: (r.outcome, r.reason, r.active, r.row_version) for r in writes.activations(items, projects(spark), make(asked)).collect()}
    assert got == {
        1: ("done", None, False, 4), 2: ("done", None, True, 2), 3: ("conflict", "P028_ITEM_ALREADY_ACTIVE", True, 3), 4: ("conflict", "P027_ITEM_ALREADY_INACTIVE", False, 1),
        5: ("conflict", "P027_PROJECT_STATUS_NOT_EDITABLE", True, 1), 6: ("done", None, False, 2), 7: ("refused", "P027_ITEM_NOT_FOUND", None, None), 8: ("refused", "P027_PROJECT_NOT_FOUND", True, 1),
        9: ("refused", "P027_ITEM_NOT_FOUND", None, None), 10: ("conflict", "P027_ITEM_VERSION_CONFLICT", True, 2), 11: ("refused", writes.NOT_ALLOWED, True, 2), 12: ("conflict", "P027_ITEM_VERSION_CONFLICT", True, 2),
    }
    twice = writes.activations(items, projects(spark), make([(1, 6, 1, False, 2, "editor"), (2, 6, 1, False, 2, "admin"), (3, 6, 1, False, 1, "admin")])).collect()
    assert {(r.outcome, r.reason, r.row_version) for r in twice} == {("conflict", "P027_ITEM_VERSION_CONFLICT", 2)}


def test_baseline_rows_need_a_draft_baseline(spark):
    versions = spark.createDataFrame([(1, "draft", True), (2, "draft", False), (3, "locked", True)], "id long, status string, is_baseline boolean")
    rows = [(1, 1, "editor", 5, 5), (2, 1, "approver", 5, 5), (3, 1, "admin", 5, 6), (4, 2, "admin", 5, 5), (5, 3, "editor", 5, 5), (6, 9, "admin", 5, 5), (7, 1, "admin", 5, 5), (8, 1, "editor", None, None)]
    made = spark.createDataFrame(rows, "request_id long, plan_version_id long, actor_role string, actor_id long, created_by_user_id long")
    assert sorted(r.request_id for r in writes.baseline_writes(made, versions).collect() if r.allowed) == [1, 7]


DAY = [dt.datetime(2026, 1, k) for k in range(1, 6)]
BAD = [
    {"limit": 0}, {"limit": 201}, {"limit": None}, {"after_id": 3}, {"after_changed_at": DAY[0]}, {"date_from": DAY[1], "date_to": DAY[0]}, {"entity": "projects"}, {"entity": "ltc_m.Projects"},
    {"entity": "ltc_m.projects;"}, {"entity": "ltc_m.projects\n"}, {"request_id": "r" * 201},
]


@pytest.mark.parametrize("values", BAD)
def test_audit_arguments_are_refused(values):
    with pytest.raises(ValueError):
        AuditQuery(**values).checked()


def test_audit_reader(spark):
    rows = [(k, f"ltc_m.{'clients' if k % 2 else 'projects'}", str(k), "UPDATE" if k % 3 else "INSERT", {"id": "1", "tax_id": "t", "notes": "n"}, None, k % 4, f"r{k % 5}", DAY[k // 3]) for k in range(12)]
    log = spark.createDataFrame(rows, "id long, table_name string, record_id string, operation string, old_data map<string,string>, new_data map<string,string>, changed_by_user_id long, request_id string, changed_at timestamp_ntz")

    def read(**values):
        return [r.id for r in read_audit(log, AuditQuery(**values), "admin").collect()]

    assert read() == list(range(11, -1, -1)) and read(limit=2) == [11, 10] and read(entity=" ltc_m.clients ") == [11, 9, 7, 5, 3, 1] and read(entity=" ", request_id="") == read()
    assert read(after_changed_at=DAY[2], after_id=7) == [6, 5, 4, 3, 2, 1, 0] and read(after_changed_at=DAY[2], after_id=7, limit=3) == [6, 5, 4]
    assert read(date_from=DAY[1], date_to=DAY[2]) == [8, 7, 6, 5, 4, 3] and read(operation="INSERT") == [9, 6, 3, 0] and read(actor=1, request_id="r0") == [5]
    assert read(actor=0, operation="UPDATE", entity="ltc_m.projects", date_to=DAY[2]) == [8, 4] and read(actor=99) == []
    first = {r.id: (sorted(r.old_data), r.new_data) for r in read_audit(log, AuditQuery(limit=2), "admin").collect()}
    assert first == {11: (["id", "notes"], None), 10: (["id", "tax_id"], None)}
    for role in ("viewer", "editor", "approver", None):
        with pytest.raises(PermissionError):
            read_audit(log, AuditQuery(), role)
    event = access_event(AuditQuery(limit=5, entity=" ltc_m.projects", request_id="x"), 7)
    told = event["metadata"]
    assert (event["operation"], event["record_id"], told["limit"], told["entity"], told["request_id_filter"], told["actor"]) == ("AUDIT_READ", "7", "5", "ltc_m.projects", "x", None)
