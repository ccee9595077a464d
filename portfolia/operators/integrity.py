"""Integrity as data: checks, unique keys, references, state changes, audit rows and import actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfolia.functions.money import canonical_money, derived_total
from portfolia.plans.registry import query
from portfolia.sources.bindings import PLAN_STATUSES, PROJECT_STATUSES, Tables, count_of

#: How a plan version may change, and who may change it so.
TRANSITIONS = [("draft", "submit", "pending_approval", "editor"), ("pending_approval", "return", "draft", "approver"), ("pending_approval", "approve", "approved", "approver"), ("approved", "lock", "locked", "admin"), ("approved", "archive", "archived", "admin"), ("locked", "archive", "archived", "admin"), ("approved", "reopen", "draft", "admin"), ("locked", "reopen", "draft", "admin")]


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """rule and key of each row that breaks a check; as in SQL, a check that is null holds."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks.items()]))
    return rows.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("row_key"))


def checks(t: Tables) -> DataFrame:
    projects = violations(t.projects, "id", {"project_status": F.col("status").isin(PROJECT_STATUSES), "project_contract_value": F.col("contract_value") >= 0, "project_code": F.col("project_code").rlike("^PRJ-[0-9]{9}$")})
    items = violations(t.items, "id", {"item_quantity": F.col("quantity") > 0, "item_description": F.col("description").isNotNull(), "item_total": F.col("total_amount") == derived_total(F.col("quantity"), F.col("unit_price"))})
    lines = violations(t.lines, "id", {"line_month": F.dayofmonth("competence_month") == 1, "line_amount": F.col("amount") >= 0, "line_grain": (F.col("planning_level") == "item") == F.col("project_item_id").isNotNull()})
    versions = violations(t.versions, "id", {"version_status": F.col("status").isin(PLAN_STATUSES)})
    return reduce(DataFrame.unionByName, [projects, items, lines, versions])


@query("""SELECT 'item_description' AS rule, id::VARCHAR AS row_key FROM items WHERE description IS NULL
UNION ALL SELECT 'item_quantity', id::VARCHAR FROM items WHERE NOT quantity > 0 UNION ALL SELECT 'project_contract_value', id::VARCHAR FROM projects WHERE contract_value < 0 UNION ALL SELECT 'line_amount', id::VARCHAR FROM lines WHERE amount < 0""")
def x1_check_violations(t: Tables) -> DataFrame:
    return checks(t)


@query("""SELECT 'live_project_code' AS rule, upper(project_code) AS row_key, count(*) AS occurrences FROM projects WHERE NOT deleted GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'item_source_line', project_id || '|' || source_line_key, count(*) FROM items WHERE NOT deleted GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'item_line_number', project_id || '|' || line_number, count(*) FROM items WHERE NOT deleted GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'one_baseline', 'baseline', count(*) FROM versions WHERE is_baseline HAVING count(*) > 1""")
def x2_unique_violations(t: Tables) -> DataFrame:
    """Keys that are unique among some of the rows and are not."""
    text = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
    live = t.items.where("not deleted")
    keys = {"live_project_code": (t.projects.where("not deleted"), F.upper("project_code")), "item_source_line": (live, text("project_id", "source_line_key")), "item_line_number": (live, text("project_id", "line_number")), "one_baseline": (t.versions.where("is_baseline"), F.lit("baseline"))}
    return reduce(DataFrame.unionByName, [rows.groupBy(key.alias("row_key")).agg(count_of("*").alias("occurrences")).where("occurrences > 1").withColumn("rule", F.lit(rule)) for rule, (rows, key) in keys.items()])


@query("""SELECT 'item_currency' AS rule, i.id::VARCHAR AS row_key FROM items i WHERE NOT EXISTS (SELECT 1 FROM projects p WHERE p.id = i.project_id AND p.base_currency = i.currency_code)
UNION ALL SELECT 'event_item', a.id::VARCHAR FROM actuals a WHERE project_item_id IS NOT NULL AND project_item_id NOT IN (SELECT id FROM items)
UNION ALL SELECT 'snapshot_project', s.id::VARCHAR FROM snapshots s WHERE project_id NOT IN (SELECT id FROM projects WHERE NOT deleted)
UNION ALL SELECT 'project_client', p.id::VARCHAR FROM projects p WHERE client_id NOT IN (SELECT id FROM clients)""")
def x3_reference_violations(t: Tables) -> DataFrame:
    """Rows whose reference is missing; an item's is its project together with its currency."""
    own = t.projects.select(F.col("id").alias("project_id"), F.col("base_currency").alias("currency_code"))
    live = t.projects.where("not deleted").select(F.col("id").alias("project_id"))
    broken = {
        "item_currency": t.items.join(own, ["project_id", "currency_code"], "left_anti"),
        "event_item": t.actuals.where("project_item_id is not null").join(t.items.select(F.col("id").alias("project_item_id")), "project_item_id", "left_anti"),
        "snapshot_project": t.snapshots.join(live, "project_id", "left_anti"),
        "project_client": t.projects.join(t.clients.select(F.col("id").alias("client_id")), "client_id", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("row_key")) for rule, rows in broken.items()])


def attempts(t: Tables, rows: DataFrame) -> DataFrame:
    """Judge requested changes (status, action, role) of plan versions by the table of transitions; admins may do all."""
    table = t.spark.createDataFrame(TRANSITIONS, "status string, action string, next_status string, needs string")
    allowed = (F.col("role") == "admin") | (F.col("role") == F.col("needs"))
    verdict = F.when(F.col("next_status").isNull(), "invalid_transition").when(~allowed, "forbidden").otherwise("done")
    return rows.join(table, ["status", "action"], "left").select("plan_version_id", "status", "action", "role", verdict.alias("verdict"), F.when(verdict == "done", F.col("next_status")).alias("next_status"))


@query("""
, tr(status, action, next_status, needs) AS (VALUES ('draft', 'submit', 'pending_approval', 'editor'), ('pending_approval', 'return', 'draft', 'approver'), ('pending_approval', 'approve', 'approved', 'approver'), ('approved', 'lock', 'locked', 'admin'), ('approved', 'archive', 'archived', 'admin'), ('locked', 'archive', 'archived', 'admin'), ('approved', 'reopen', 'draft', 'admin'), ('locked', 'reopen', 'draft', 'admin')),
asked AS (SELECT v.id AS plan_version_id, v.status, a.action, r.role FROM versions v, (SELECT DISTINCT action FROM tr) a, (VALUES ('editor'), ('approver'), ('admin')) r(role)),
j AS (SELECT asked.*, next_status, CASE WHEN next_status IS NULL THEN 'invalid_transition' WHEN role <> 'admin' AND role <> needs THEN 'forbidden' ELSE 'done' END AS verdict FROM asked LEFT JOIN tr USING (status, action))
SELECT plan_version_id, status, action, role, verdict, CASE WHEN verdict = 'done' THEN next_status END AS next_status FROM j""")
def x6_transitions(t: Tables) -> DataFrame:
    """Every action by every role on every version (a few rows of each)."""
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    asked = t.versions.select(F.col("id").alias("plan_version_id"), "status").withColumn("action", each(sorted({a for _, a, _, _ in TRANSITIONS}))).withColumn("role", each(["editor", "approver", "admin"]))
    return attempts(t, asked)


def audit_changes(before: DataFrame, after: DataFrame, key: str, columns: list[str], deleted: str = "deleted") -> DataFrame:
    """What happened to each row between two states: operation and the columns that changed; equal rows give nothing."""
    old, new = (rows.select(F.col(key), F.struct(*columns, deleted).alias(name)) for rows, name in ((before, "o"), (after, "n")))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns]))
    gone, back = ~F.col(f"o.{deleted}") & F.col(f"n.{deleted}"), F.col(f"o.{deleted}") & ~F.col(f"n.{deleted}")
    joined = old.join(new, key, "full")
    operation = F.when(F.col("o").isNull(), "INSERT").when(F.col("n").isNull(), "DELETE").when(gone, "SOFT_DELETE").when(back, "RESTORE").when(F.size(changed) > 0, "UPDATE")
    return joined.select(key, operation.alias("operation"), F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), F.array_join(changed, ",")).alias("changed_columns")).where("operation is not null")


@query("""
, o AS (SELECT id, status, contract_value, deleted FROM projects WHERE id % 10 <> 1),
n AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'cancelled' ELSE status END AS status, CASE WHEN id % 4 = 0 THEN contract_value + 1 ELSE contract_value END::DECIMAL(20,2) AS contract_value, CASE WHEN id % 9 = 0 THEN NOT deleted ELSE deleted END AS deleted FROM projects WHERE id % 10 <> 2),
j AS (SELECT coalesce(o.id, n.id) AS id, o.id AS oid, n.id AS nid, o.deleted AS od, n.deleted AS nd, array_to_string(list_filter([CASE WHEN o.status <> n.status THEN 'status' END, CASE WHEN o.contract_value <> n.contract_value THEN 'contract_value' END], lambda x: x IS NOT NULL), ',') AS ch FROM o FULL JOIN n ON o.id = n.id),
k AS (SELECT id, CASE WHEN oid IS NULL THEN 'INSERT' WHEN nid IS NULL THEN 'DELETE' WHEN NOT od AND nd THEN 'SOFT_DELETE' WHEN od AND NOT nd THEN 'RESTORE' WHEN ch <> '' THEN 'UPDATE' END AS operation, CASE WHEN oid IS NOT NULL AND nid IS NOT NULL THEN ch END AS changed_columns FROM j)
SELECT * FROM k WHERE operation IS NOT NULL""")
def x9_audit_changes(t: Tables) -> DataFrame:
    """Audit rows between two states of the projects."""
    before = t.projects.where("id % 10 <> 1")
    after = t.projects.where("id % 10 <> 2").withColumns({
        "status": F.when(F.col("id") % 6 == 0, "cancelled").otherwise(F.col("status")), "contract_value": F.when(F.col("id") % 4 == 0, F.col("contract_value") + 1).otherwise(F.col("contract_value")).cast("decimal(20,2)"),
        "deleted": F.when(F.col("id") % 9 == 0, ~F.col("deleted")).otherwise(F.col("deleted")),
    })
    return audit_changes(before, after, "id", ["status", "contract_value"])


@query("""
, cand AS (SELECT project_code, base_currency, contract_value FROM projects WHERE id % 8 <> 0 UNION ALL SELECT project_code, 'EUR', contract_value FROM projects WHERE id % 40 = 1),
have AS (SELECT project_code, base_currency, CASE WHEN id % 16 = 3 THEN contract_value + 1 ELSE contract_value END AS contract_value FROM projects WHERE id % 3 <> 0),
c AS (SELECT project_code, count(*) AS n, min(base_currency) AS base_currency, min(contract_value) AS contract_value FROM cand GROUP BY 1)
SELECT project_code, n AS candidates, CASE WHEN n > 1 THEN 'pending_decision' WHEN c.base_currency = 'EUR' THEN 'rejected' WHEN h.project_code IS NULL THEN 'insert' WHEN h.contract_value = c.contract_value AND h.base_currency = c.base_currency THEN 'no_op' ELSE 'conflict' END AS action
FROM c LEFT JOIN have h USING (project_code)""")
def e11_import_actions(t: Tables) -> DataFrame:
    """What an import would do with each candidate: several candidates wait for a decision, differing ones conflict."""
    candidates = t.projects.where("id % 8 <> 0").select("project_code", "base_currency", "contract_value").unionByName(t.projects.where("id % 40 = 1").select("project_code", F.lit("EUR").alias("base_currency"), "contract_value"))
    value = F.when(F.col("id") % 16 == 3, F.col("contract_value") + 1).otherwise(F.col("contract_value"))
    existing = t.projects.where("id % 3 <> 0").select("project_code", F.struct("base_currency", value.cast("decimal(20,2)").alias("contract_value")).alias("have"))
    one = candidates.groupBy("project_code").agg(count_of("*").alias("candidates"), F.struct(F.min("base_currency").alias("base_currency"), F.min("contract_value").alias("contract_value")).alias("want"))
    action = F.when(F.col("candidates") > 1, "pending_decision").when(F.col("want.base_currency") == "EUR", "rejected").when(F.col("have").isNull(), "insert").when(F.col("have") == F.col("want"), "no_op").otherwise("conflict")
    return one.join(existing, "project_code", "left").select("project_code", "candidates", action.alias("action"))


@query("""
, raw AS (SELECT id, CASE id % 6 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE '' END || amount::VARCHAR || CASE id % 4 WHEN 0 THEN '5' WHEN 1 THEN '49999' WHEN 2 THEN 'e1' ELSE '' END AS txt FROM lines)
SELECT id, txt AS amount_text, CASE WHEN regexp_full_match(txt, '(0|[1-9][0-9]*)(\\.[0-9]{1,14})?') THEN round(txt::DECIMAL(32,14), 2)::DECIMAL(20,2) END AS amount FROM raw""")
def m2_money_text(t: Tables) -> DataFrame:
    """Decimal text with signs, exponents and extra places: rounded half up to cents or refused (null)."""
    n = F.col("id")
    text = F.concat(F.when(n % 6 == 0, "-").when(n % 6 == 1, "+").otherwise(""), F.col("amount").cast("string"), F.when(n % 4 == 0, "5").when(n % 4 == 1, "49999").when(n % 4 == 2, "e1").otherwise(""))
    return t.lines.select("id", text.alias("amount_text"), canonical_money(text).alias("amount"))
