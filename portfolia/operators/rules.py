"""Rules of writing as data: row versions, immutability, approvals, capabilities, what an audit may show, provenance.

A batch of requested writes is judged against the state that it was made on;
each function returns the verdicts, so that a caller can apply what is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfolia.operators.integrity import TRANSITIONS, violations
from portfolia.operators.portfolio import OFFICIAL, latest_snapshots
from portfolia.plans.registry import query
from portfolia.sources.bindings import Tables, count_of, money

#: Roles, what each may do, and the action of a plan version that a capability stands for.
READ = ["data:read", "financial:read"]
CAPABILITIES = {
    "viewer": READ,
    "editor": [*READ, "record:create", "record:edit_draft", "forecast:create", "forecast:edit_draft", "workflow:submit"],
    "approver": [*READ, "workflow:approve", "workflow:return_to_draft"],
    "admin": [*READ, "audit:read", "record:create", "record:edit_draft", "forecast:create", "forecast:edit_draft", "forecast:override_balance", "workflow:submit", "workflow:approve", "workflow:return_to_draft", "workflow:lock", "workflow:reopen", "workflow:archive", "soft_delete:execute", "soft_delete:restore", "catalog:manage", "users:manage", "roles:manage"],
}
WORKFLOW = {"submit": "workflow:submit", "return": "workflow:return_to_draft", "approve": "workflow:approve", "lock": "workflow:lock", "archive": "workflow:archive", "reopen": "workflow:reopen"}
#: Fields of a table that an audit never shows; other tables lose their notes.
HIDDEN = {"app_users": ["auth_subject", "email"], "clients": ["tax_id"], "financial_actual_events": ["document_number", "installment_key", "notes"], "import_batches": ["source_hash"], "import_row_errors": ["raw_payload", "natural_key"]}


@query("SELECT * FROM (VALUES {}) v(role, capability)".format(", ".join(f"('{r}', '{c}')" for r, cs in CAPABILITIES.items() for c in cs)))
def x12_capabilities(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(r, c) for r, cs in CAPABILITIES.items() for c in cs], "role string, capability string")


def workflow_actions(versions: DataFrame) -> DataFrame:
    """What each role may do next with each version: its transitions of which the role has the capability."""
    spark = versions.sparkSession
    moves = spark.createDataFrame([(s, a, WORKFLOW[a]) for s, a, _, _ in TRANSITIONS], "status string, action string, capability string")
    able = spark.createDataFrame([(r, c) for r, cs in CAPABILITIES.items() for c in cs], "role string, capability string")
    return versions.join(moves, "status").join(able, "capability").select("id", "status", "role", "action")


@query("""
, m(status, action, capability) AS (VALUES ('draft', 'submit', 'workflow:submit'), ('pending_approval', 'return', 'workflow:return_to_draft'), ('pending_approval', 'approve', 'workflow:approve'), ('approved', 'lock', 'workflow:lock'), ('approved', 'archive', 'workflow:archive'), ('locked', 'archive', 'workflow:archive'), ('approved', 'reopen', 'workflow:reopen'), ('locked', 'reopen', 'workflow:reopen')),
a(role, capability) AS (VALUES ('editor', 'workflow:submit'), ('approver', 'workflow:approve'), ('approver', 'workflow:return_to_draft'), ('admin', 'workflow:submit'), ('admin', 'workflow:approve'), ('admin', 'workflow:return_to_draft'), ('admin', 'workflow:lock'), ('admin', 'workflow:archive'), ('admin', 'workflow:reopen'))
SELECT id AS plan_version_id, status, role, action FROM versions JOIN m USING (status) JOIN a USING (capability)""")
def r4_workflow_actions(t: Tables) -> DataFrame:
    return workflow_actions(t.versions).withColumnRenamed("id", "plan_version_id")


def versioned(current: DataFrame, writes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Optimistic writes: ``writes`` states the row_version it was made on and new values of ``columns``.

    A write on another version than the present one is ``stale``, one that
    changes nothing is ``unchanged`` and keeps the version; else the version
    goes up by one.  Rows without a write are ``kept``, writes without a row are
    ``missing`` and of several writes on a row none is applied (``ambiguous``).
    """
    asked = writes.groupBy(key).agg(count_of("*").alias("_n"), F.min("row_version").alias("_seen"), F.min(F.struct(*columns)).alias("_new"))
    old = current.select(key, "row_version", F.struct(*columns).alias("_old"))
    joined = old.join(asked, key, "full")
    outcome = (
        F.when(F.col("_n").isNull(), "kept").when(F.col("_n") > 1, "ambiguous").when(F.col("_old").isNull(), "missing").when(F.col("_seen") != F.col("row_version"), "stale").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    )
    judged = joined.withColumn("outcome", outcome)
    done = F.col("outcome") == "updated"
    return judged.select(key, F.when(done, F.col("row_version") + 1).otherwise(F.col("row_version")).alias("row_version"), *[F.when(done, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns], "outcome")


@query("""
, cur AS (SELECT id, id % 4 + 1 AS row_version, status, contract_value FROM projects WHERE id % 6 <> 5),
w0 AS (SELECT id, CASE WHEN id % 9 = 4 THEN 9 ELSE id % 4 + 1 END AS seen, CASE WHEN id % 2 = 0 THEN status ELSE 'on_hold' END AS status, contract_value FROM projects WHERE id % 3 <> 0),
w AS (SELECT * FROM w0 UNION ALL SELECT * FROM w0 WHERE id % 14 = 1), a AS (SELECT id, count(*) AS n, min(seen) AS seen, min(status) AS status, min(contract_value) AS contract_value FROM w GROUP BY 1),
j AS (SELECT coalesce(cur.id, a.id) AS id, row_version, cur.status AS os, cur.contract_value AS oc, a.status AS ns, a.contract_value AS nc, CASE WHEN n IS NULL THEN 'kept' WHEN n > 1 THEN 'ambiguous' WHEN cur.id IS NULL THEN 'missing' WHEN seen <> row_version THEN 'stale' WHEN cur.status = a.status AND cur.contract_value = a.contract_value THEN 'unchanged' ELSE 'updated' END AS outcome FROM cur FULL JOIN a ON a.id = cur.id)
SELECT id, CASE WHEN outcome = 'updated' THEN row_version + 1 ELSE row_version END AS row_version, CASE WHEN outcome = 'updated' THEN ns ELSE os END AS status, CASE WHEN outcome = 'updated' THEN nc ELSE oc END AS contract_value, outcome FROM j""")
def x4_row_versions(t: Tables) -> DataFrame:
    """Optimistic updates of projects: stale, repeated, empty and effective ones."""
    n, seen = F.col("id"), F.col("id") % 4 + 1
    current = t.projects.where("id % 6 <> 5").withColumn("row_version", seen)
    once = t.projects.where("id % 3 <> 0").select("id", F.when(n % 9 == 4, F.lit(9).cast("long")).otherwise(seen).alias("row_version"), F.when(n % 2 == 0, F.col("status")).otherwise("on_hold").alias("status"), "contract_value")
    return versioned(current, once.unionByName(once.where("id % 14 = 1")), "id", ["status", "contract_value"])


def append_only(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``before`` that ``after`` lacks (deleted) or has with other values (changed)."""
    sides = [rows.select(key, F.struct(*columns).alias(name)) for rows, name in ((before, "_old"), (after, "_new"))]
    joined = sides[0].join(sides[1], key, "left").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return joined.select(key, F.when(F.col("_new").isNull(), "deleted").otherwise("changed").alias("violation"))


@query("SELECT id, CASE WHEN id % 50 = 0 THEN 'deleted' ELSE 'changed' END AS violation FROM audit WHERE id % 50 = 0 OR id % 77 = 3")
def x5_append_only(t: Tables) -> DataFrame:
    """An audit log of which rows were deleted and changed, against what it was."""
    after = t.audit.where("id % 50 <> 0").withColumn("operation", F.when(F.col("id") % 77 == 3, "tampered").otherwise(F.col("operation")))
    return append_only(t.audit, after, "id", ["changed_at", "entity_id", "operation"])


def plan_writes(lines: DataFrame, versions: DataFrame) -> DataFrame:
    """The verdict on a write of each line: allowed if its version is a draft."""
    states = versions.select(F.col("id").alias("plan_version_id"), "status")
    writes = lines.select(F.col("id").alias("line_id"), "plan_version_id").join(states, "plan_version_id", "left")
    return writes.select("line_id", "plan_version_id", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce(F.col("status") == "draft", F.lit(False)).alias("allowed"))


@query("""SELECT l.id AS line_id, l.plan_version_id, coalesce(v.status, 'missing') AS status, coalesce(v.status = 'draft', false) AS allowed FROM lines l LEFT JOIN versions v ON v.id = l.plan_version_id""")
def x7_plan_writes(t: Tables) -> DataFrame:
    """Requested writes of plan lines: only those of a draft are allowed."""
    return plan_writes(t.lines, t.versions)


@query("SELECT l.id AS line_id, l.plan_version_id, coalesce(v.status, 'missing') AS status, coalesce(v.status = 'draft', false) AS allowed FROM lines l LEFT JOIN versions v ON v.id = l.plan_version_id")
def x7_all_plan_writes(t: Tables) -> DataFrame:
    """The same of every plan line."""
    return plan_writes(t.lines, t.versions)


def approvals(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Judge approvals of pending versions.

    ``requests``: request_id, status, actor_id, created_by, updated_by,
    exceptional, justification; ``users``: id, role, active.  Who wrote a version
    does not approve it, but for an admin who is the only one that could, says
    so and gives a reason.
    """
    eligible = users.where("active and role in ('approver', 'admin')")
    others = eligible.agg(count_of("*").alias("eligible"))
    actor = users.where("active").select(F.col("id").alias("actor_id"), "role")
    rows = requests.join(actor, "actor_id", "left").join(F.broadcast(others))  # one row
    own = (F.col("actor_id") == F.col("created_by")) | F.coalesce(F.col("actor_id") == F.col("updated_by"), F.lit(False))
    reason = F.length(F.trim(F.coalesce("justification", F.lit("")))) > 0
    verdict = (
        F.when(~F.coalesce(F.col("role").isin("approver", "admin"), F.lit(False)), "forbidden")
        .when(F.col("status") != "pending_approval", "invalid_transition")
        .when(own & (F.col("role") == "approver"), "self_approval")
        .when(own & (F.col("eligible") > 1), "other_approver_exists")
        .when(own & ~(F.coalesce("exceptional", F.lit(False)) & reason), "exception_not_justified")
        .otherwise("approved")
    )
    return rows.select("request_id", "actor_id", verdict.alias("verdict"))


_APPROVAL_SQL = """
, us AS (SELECT id, ['viewer', 'editor', 'approver', 'admin'][(id % 4 + 1)::INT] AS role, id % 7 <> 0 AS active FROM clients),
rq AS (SELECT id AS request_id, CASE WHEN id % 3 = 0 THEN 'draft' ELSE 'pending_approval' END AS status, client_id AS actor_id, CASE WHEN id % 2 = 0 THEN client_id ELSE client_id + 1 END AS created_by FROM projects)
SELECT request_id, actor_id, CASE WHEN coalesce(role NOT IN ('approver', 'admin'), true) THEN 'forbidden' WHEN status <> 'pending_approval' THEN 'invalid_transition' WHEN actor_id = created_by AND role = 'approver' THEN 'self_approval'
  WHEN actor_id = created_by THEN 'other_approver_exists' ELSE 'approved' END AS verdict FROM rq LEFT JOIN (SELECT * FROM us WHERE active) u ON u.id = actor_id"""


@query(_APPROVAL_SQL)
def x8_approvals(t: Tables) -> DataFrame:
    """Approvals asked for by many users, many of them of their own versions."""
    users = t.clients.select("id", F.element_at(F.array(*map(F.lit, CAPABILITIES)), (F.col("id") % 4 + 1).cast("int")).alias("role"), (F.col("id") % 7 != 0).alias("active"))
    actor = F.col("client_id")
    requests = t.projects.select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 == 0, "draft").otherwise("pending_approval").alias("status"), actor.alias("actor_id"), F.when(F.col("id") % 2 == 0, actor).otherwise(actor + 1).alias("created_by"), F.lit(None).cast("long").alias("updated_by"), F.lit(True).alias("exceptional"), F.lit("x").alias("justification"))
    return approvals(requests, users)


def sanitized(table: Column, payload: Column) -> Column:
    """A map of field to text without the fields that the audit of its table hides; null stays null."""
    hidden = reduce(lambda c, item: c.when(table == item[0], F.array(*map(F.lit, item[1]))), HIDDEN.items(), F.when(F.lit(False), F.array().cast("array<string>"))).otherwise(F.array(F.lit("notes")))
    return F.map_filter(payload, lambda k, v: ~F.array_contains(hidden, k))


@query("""
, k AS (SELECT id, ['app_users', 'clients', 'financial_actual_events', 'import_batches', 'projects'][(id % 5 + 1)::INT] AS table_name FROM audit)
SELECT id, table_name, CASE table_name WHEN 'app_users' THEN 'id,notes,tax_id' WHEN 'clients' THEN 'email,id,notes' WHEN 'financial_actual_events' THEN 'email,id,tax_id' WHEN 'import_batches' THEN 'email,id,notes,tax_id' ELSE 'email,id,tax_id' END AS fields FROM k""")
def x10_sanitized_audit(t: Tables) -> DataFrame:
    """Which fields of an audit payload are left, by table."""
    table = F.element_at(F.array(*map(F.lit, ["app_users", "clients", "financial_actual_events", "import_batches", "projects"])), (F.col("id") % 5 + 1).cast("int"))
    fields = {"id": F.col("id").cast("string"), "email": F.lit("e"), "tax_id": F.lit("t"), "notes": F.col("operation")}
    payload = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return t.audit.select("id", table.alias("table_name"), F.array_join(F.array_sort(F.map_keys(sanitized(table, payload))), ",").alias("fields"))


def legacy_dates(projects: DataFrame, batches: DataFrame) -> DataFrame:
    """Projects with neither a reference date nor a batch, with both, and with a batch that is missing or rejected.

    ``projects``: id, data_reference_date, batch_id; ``batches``: id, status.
    """
    known = batches.select(F.col("id").alias("batch_id"), F.col("status").alias("batch_status"))
    date, batch = F.col("data_reference_date").isNotNull(), F.col("batch_id").isNotNull()
    return violations(projects.join(known, "batch_id", "left"), "id", {"date_or_batch": date | batch, "date_and_batch": ~(date & batch), "batch_known": ~batch | F.col("batch_status").isNotNull(), "batch_rejected": F.col("batch_status") != "rejected"})


@query("""
, ba AS (SELECT id AS batch_id, CASE WHEN id % 6 = 0 THEN 'rejected' ELSE 'accepted' END AS batch_status FROM clients WHERE id % 10 <> 0),
pr AS (SELECT id, CASE WHEN id % 4 <> 1 THEN data_reference_date END AS d, CASE WHEN id % 4 = 1 AND id % 12 <> 1 OR id % 20 = 2 THEN client_id END AS batch_id FROM projects), j AS (SELECT * FROM pr LEFT JOIN ba USING (batch_id))
SELECT 'date_or_batch' AS rule, id::VARCHAR AS row_key FROM j WHERE d IS NULL AND batch_id IS NULL UNION ALL SELECT 'date_and_batch', id::VARCHAR FROM j WHERE d IS NOT NULL AND batch_id IS NOT NULL
UNION ALL SELECT 'batch_known', id::VARCHAR FROM j WHERE batch_id IS NOT NULL AND batch_status IS NULL UNION ALL SELECT 'batch_rejected', id::VARCHAR FROM j WHERE batch_status = 'rejected'""")
def x13_legacy_dates(t: Tables) -> DataFrame:
    n = F.col("id")
    batches = t.clients.where("id % 10 <> 0").select("id", F.when(n % 6 == 0, "rejected").otherwise("accepted").alias("status"))
    projects = t.projects.select("id", F.when(n % 4 != 1, F.col("data_reference_date")).alias("data_reference_date"), F.when((n % 4 == 1) & (n % 12 != 1) | (n % 20 == 2), F.col("client_id")).alias("batch_id"))
    return legacy_dates(projects, batches)


def provenance(snapshots: DataFrame, batches: DataFrame, observations: DataFrame, references: DataFrame) -> DataFrame:
    """Snapshots whose source hash is not their batch's, and observations without a reference of their project.

    ``snapshots``: id, batch_id, source_hash; ``batches``: id, source_hash;
    ``observations``: id, project_id; ``references``: observation_id, project_id.
    """
    named = batches.select(F.col("id").alias("batch_id"), "source_hash")
    odd = snapshots.join(named, ["batch_id", "source_hash"], "left_anti").select(F.lit("source_hash").alias("rule"), F.col("id").cast("string").alias("row_key"))
    bare = observations.join(references.select(F.col("observation_id").alias("id"), "project_id"), ["id", "project_id"], "left_anti").select(F.lit("reference_missing").alias("rule"), F.col("id").cast("string").alias("row_key"))
    return odd.unionByName(bare)


@query("""SELECT 'source_hash' AS rule, id::VARCHAR AS row_key FROM snapshots WHERE id % 11 = 3 OR id % 40 = 0 UNION ALL SELECT 'reference_missing', id::VARCHAR FROM snapshots WHERE status = 'success' AND (id % 13 = 0 OR id % 17 = 0)""")
def x14_provenance(t: Tables) -> DataFrame:
    """Snapshots and their observations: some hashes differ, some batches and references are missing or another project's."""
    n = F.col("id")
    snapshots = t.snapshots.select("id", n.alias("batch_id"), F.when(n % 11 == 3, "x").otherwise(F.sha2(n.cast("string"), 256)).alias("source_hash"))
    batches = t.snapshots.where("id % 40 <> 0").select("id", F.sha2(n.cast("string"), 256).alias("source_hash"))
    seen = t.snapshots.where("status = 'success'").select("id", "project_id")
    references = seen.where("id % 13 <> 0").select(n.alias("observation_id"), F.when(n % 17 == 0, F.col("project_id") + 1).otherwise(F.col("project_id")).alias("project_id"))
    return provenance(snapshots, batches, seen, references.unionByName(references.where("observation_id % 3 = 0")))


@query("""
, w AS (SELECT id AS line_id, project_item_id, competence_month, CASE WHEN id % 3 = 0 THEN amount ELSE amount + 5 END::DECIMAL(20,2) AS wanted, amount FROM lines WHERE plan_version_id = 0 AND planning_level = 'item')
SELECT project_item_id, competence_month, wanted AS amount, amount AS replaced FROM w WHERE wanted <> amount""")
def r3_changed_entries(t: Tables) -> DataFrame:
    """Of an editor's cells, those that differ from the draft: what a save has to send."""
    key = ["project_item_id", "competence_month"]
    draft = t.lines.where("plan_version_id = 0 and planning_level = 'item'")
    cells = draft.select(*key, money(F.when(F.col("id") % 3 == 0, F.col("amount")).otherwise(F.col("amount") + 5)).alias("amount"))
    return cells.join(draft.select(*key, F.col("amount").alias("replaced")), key, "left").where(~F.col("amount").eqNullSafe(F.col("replaced"))).select(*key, "amount", "replaced")


def current_version(versions: DataFrame, order: list[str]) -> DataFrame:
    """The official version that comes last in ``order`` (its columns, nulls first); no row if there is none."""
    return versions.where(F.col("status").isin(OFFICIAL)).orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(1)


@query("SELECT id AS plan_version_id, name, status, is_baseline FROM versions WHERE status IN ('approved', 'locked') ORDER BY id DESC LIMIT 1")
def v10_current_version(t: Tables) -> DataFrame:
    return current_version(t.versions, ["id"]).select(F.col("id").alias("plan_version_id"), "name", "status", "is_baseline")


@query("""
, cv AS (SELECT id FROM versions WHERE status IN ('approved', 'locked') ORDER BY id DESC LIMIT 1),
it AS (SELECT project_id, sum(total_amount) AS x FROM items WHERE active AND NOT deleted GROUP BY 1), pl AS (SELECT project_id, sum(amount) AS x FROM lines WHERE plan_version_id IN (SELECT id FROM cv) AND metric_type = 'billing_planned' GROUP BY 1),
ac AS (SELECT project_id, sum(amount) FILTER (metric_type = 'billing_actual') AS b, sum(amount) FILTER (metric_type = 'receipt_actual') AS r FROM actuals WHERE status = 'posted' GROUP BY 1)
SELECT p.id AS project_id, project_code, display_name AS client_name, status, base_currency, contract_value, coalesce(it.x, 0)::DECIMAL(20,2) AS active_item_value, coalesce(pl.x, 0)::DECIMAL(20,2) AS billing_planned, coalesce(b, 0)::DECIMAL(20,2) AS billing_actual, coalesce(r, 0)::DECIMAL(20,2) AS receipt_actual,
  greatest(contract_value - coalesce(b, 0), 0)::DECIMAL(20,2) AS to_bill, greatest(contract_value - coalesce(b, 0) - coalesce(pl.x, 0), 0)::DECIMAL(20,2) AS unallocated_billing, CASE WHEN contract_value > 0 THEN coalesce(b, 0) / contract_value ELSE 0 END::DECIMAL(20,6) AS contract_financial_progress
FROM projects p JOIN clients c ON c.id = client_id LEFT JOIN it ON it.project_id = p.id LEFT JOIN pl ON pl.project_id = p.id LEFT JOIN ac ON ac.project_id = p.id WHERE NOT deleted""")
def v11_project_kpis(t: Tables) -> DataFrame:
    """Per live project: what is to bill, what no plan holds, and financial progress (0 without a contract value)."""
    current = current_version(t.versions, ["id"]).select(F.col("id").alias("plan_version_id"))
    items = t.items.where("active and not deleted").groupBy("project_id").agg(F.sum("total_amount").alias("items"))
    planned = t.lines.where("metric_type = 'billing_planned'").join(current, "plan_version_id", "left_semi").groupBy("project_id").agg(F.sum("amount").alias("planned"))
    of = lambda m: F.sum(F.when(F.col("metric_type") == m, F.col("amount")))
    actual = t.actuals.where("status = 'posted'").groupBy("project_id").agg(of("billing_actual").alias("billed"), of("receipt_actual").alias("received"))
    rows = t.projects.where("not deleted").withColumnRenamed("id", "project_id").join(t.clients.select(F.col("id").alias("client_id"), F.col("display_name").alias("client_name")), "client_id")
    for side in (items, planned, actual):
        rows = rows.join(side, "project_id", "left")
    amount = {n: money(F.coalesce(c, F.lit(0))) for n, c in (("active_item_value", "items"), ("billing_planned", "planned"), ("billing_actual", "billed"), ("receipt_actual", "received"))}
    zero, contract = money(F.lit(0)), F.col("contract_value")
    progress = F.when(contract > 0, amount["billing_actual"] / contract).otherwise(0)
    return rows.select(
        "project_id", "project_code", "client_name", "status", "base_currency", "contract_value", *[c.alias(n) for n, c in amount.items()], money(F.greatest(contract - amount["billing_actual"], zero)).alias("to_bill"),
        money(F.greatest(contract - amount["billing_actual"] - amount["billing_planned"], zero)).alias("unallocated_billing"), progress.cast("decimal(20,6)").alias("contract_financial_progress"),
    )


@query("SELECT count(*) AS live_projects, count(s.project_id) AS covered, count(*) = count(s.project_id) AS complete FROM projects p LEFT JOIN (SELECT DISTINCT project_id FROM snapshots WHERE status = 'success') s ON s.project_id = p.id WHERE NOT deleted")
def g11_snapshot_coverage(t: Tables) -> DataFrame:
    """How many live projects have a successful snapshot; the findings centre needs all."""
    live = t.projects.where("not deleted").select(F.col("id").alias("project_id"))
    marked = live.join(latest_snapshots(t).select("project_id", F.lit(True).alias("seen")), "project_id", "left")
    return marked.agg(count_of("*").alias("live_projects"), count_of("seen").alias("covered")).withColumn("complete", F.col("live_projects") == F.col("covered"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ("clients", "projects", "items", "versions", "lines", "scopes", "actuals", "cells", "snapshots", "audit")))
def g15_table_counts(t: Tables) -> DataFrame:
    names = ("clients", "projects", "items", "versions", "lines", "scopes", "actuals", "cells", "snapshots", "audit")
    return reduce(DataFrame.unionByName, [getattr(t, n).agg(count_of("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names])


def set_difference(expected: DataFrame, observed: DataFrame, name: str) -> DataFrame:
    """Names that are ``missing``, ``unexpected`` or listed more than once on either side (``duplicate``)."""
    sides = [rows.groupBy(name).agg(count_of("*").alias(n)) for rows, n in ((expected, "_want"), (observed, "_have"))]
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.greatest("_want", "_have") > 1, "duplicate")
    return sides[0].join(sides[1], name, "full").select(name, state.alias("difference")).where("difference is not null")


@query("""
, a AS (SELECT item_code AS name FROM items GROUP BY 1), b AS (SELECT item_code AS name, count(*) AS n FROM items WHERE NOT deleted GROUP BY 1)
SELECT name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'unexpected' ELSE 'duplicate' END AS difference FROM a FULL JOIN b USING (name) WHERE b.name IS NULL OR a.name IS NULL OR n > 1""")
def r9_set_difference(t: Tables) -> DataFrame:
    """All item codes against those of items that are not deleted."""
    code = F.col("item_code").alias("name")
    return set_difference(t.items.select(code).distinct(), t.items.where("not deleted").select(code), "name")


@query("""
, a AS (SELECT item_code AS name, count(*) AS n FROM items GROUP BY 1), b AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1)
SELECT name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'unexpected' ELSE 'duplicate' END AS difference FROM a FULL JOIN b USING (name) WHERE b.name IS NULL OR a.name IS NULL OR a.n > 1 OR b.n > 1""")
def r9_parts_difference(t: Tables) -> DataFrame:
    """Item codes of all items against those of all parts."""
    return set_difference(t.items.select(F.col("item_code").alias("name")), t.raw("part").select(F.col("p_brand").alias("name")), "name")


@query("""
, b AS (SELECT id AS name, count(*) AS n FROM actuals WHERE status = 'posted' GROUP BY 1)
SELECT name, CASE WHEN n IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unexpected' ELSE 'duplicate' END AS difference FROM (SELECT id, id AS name FROM items) a FULL JOIN b USING (name) WHERE n IS NULL OR a.id IS NULL OR n > 1""")
def r9_posted_difference(t: Tables) -> DataFrame:
    """All items against all that posted events are for, by id."""
    return set_difference(t.items.select(F.col("id").alias("name")), t.actuals.where("status = 'posted'").select(F.col("id").alias("name")), "name")
