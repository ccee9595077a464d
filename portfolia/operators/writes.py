"""Batches of writes judged by one plan: what is appended or changed, what conflicts, what is refused and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfolia.plans.registry import query
from portfolia.sources.bindings import Tables

#: Codes of refusals and conflicts, and roles that write.
NOT_ALLOWED, NO_REFERENCE, BROKEN, DUPLICATE = "P032_NOT_AUTHORIZED", "P032_REFERENCE_UNAVAILABLE", "P032_CONSTRAINT_INVALID", "P033_SOURCE_KEY_CONFLICT"
WRITING_ROLES = ["editor", "admin"]
METRICS, STATUSES = ["billing_actual", "receipt_actual"], ["draft", "posted", "cancelled"]


def may_write() -> Column:
    """WITH CHECK of a row that an actor adds: an editor or admin, in the actor's own name (actor_role, actor_id, created_by_user_id)."""
    return F.coalesce(F.col("actor_role").isin(WRITING_ROLES) & (F.col("actor_id") == F.col("created_by_user_id")), F.lit(False))


def event_writes(requests: DataFrame, existing: DataFrame, projects: DataFrame) -> DataFrame:
    """Realized events to append: ``accepted``, ``conflict`` or ``refused`` with the reason, and what a conflict is with.

    ``requests``: request_id (unique, in the order in which they were made), project_id,
    source_key, metric_type, status, amount, currency_code and what ``may_write`` asks
    for; ``existing``: id, project_id, source_key, metric_type, status; ``projects``:
    id, base_currency, deleted.  Of several good requests for one source key of a project
    the first is accepted and the others conflict with it.  A conflict can be opened
    if it is with billing.  Nulls in a required column break a constraint.
    """
    there = projects.where("not deleted").select(F.col("id").alias("project_id"), "base_currency")
    good = (
        (F.col("source_key") == F.trim("source_key")) & (F.col("source_key") != "") & F.col("metric_type").isin(METRICS) & F.col("status").isin(STATUSES) & (F.col("amount") >= 0)
    )
    facts = requests.join(there, "project_id", "left")
    reason = (
        F.when(~may_write(), NOT_ALLOWED)
        .when(F.col("base_currency").isNull() | ~F.coalesce(F.col("currency_code") == F.col("base_currency"), F.lit(False)), NO_REFERENCE)
        .when(~F.coalesce(good, F.lit(False)), BROKEN)
    )
    judged = facts.withColumn("reason", reason)
    keys = ["project_id", "source_key"]
    held = existing.groupBy(*keys).agg(F.min(F.struct("id", "metric_type", "status")).alias("held"))
    first = judged.where("reason is null").groupBy(*keys).agg(F.min(F.struct(F.col("request_id").alias("id"), "metric_type", "status")).alias("first"))
    joined = judged.join(held, keys, "left").join(first, keys, "left")
    later = F.when(F.col("held").isNotNull(), F.col("held")).when(F.col("first.id") != F.col("request_id"), F.col("first"))
    conflict = F.when(F.col("reason").isNull(), later)
    outcome = F.when(F.col("reason").isNotNull(), "refused").when(F.col("with.id").isNotNull(), "conflict").otherwise("accepted")
    opens = F.coalesce(F.col("with.metric_type") == "billing_actual", F.lit(False))
    shown = lambda c: F.when(opens, F.col(f"with.{c}"))
    return joined.withColumn("with", conflict).select(
        "request_id", *keys, outcome.alias("outcome"), F.coalesce("reason", F.when(F.col("with.id").isNotNull(), DUPLICATE)).alias("reason"),
        shown("id").alias("existing_event_id"), shown("status").alias("existing_status"), F.when(F.col("with.id").isNotNull(), opens).alias("can_open"),
    )


def activations(items: DataFrame, projects: DataFrame, requests: DataFrame) -> DataFrame:
    """Items switched on and off: the outcome of each request, and the item's state and version after the batch.

    ``items``: id, project_id, active, deleted, row_version; ``projects``: id, status,
    deleted; ``requests``: request_id, item_id, project_id, active (what is asked for),
    expected_version, actor_role.  Editors write in active projects only.  Requests on
    one item that are each possible conflict with each other: none of them is done.
    """
    owner = projects.where("not deleted").select(F.col("id").alias("project_id"), F.col("status").alias("project_status"))
    state = items.where("not deleted").select(F.col("id").alias("item_id"), "project_id", F.col("active").alias("now"), "row_version", F.lit(True).alias("found"))
    facts = requests.join(owner, "project_id", "left").join(state, ["item_id", "project_id"], "left")
    already = F.when(F.col("active"), "P028_ITEM_ALREADY_ACTIVE").otherwise("P027_ITEM_ALREADY_INACTIVE")
    reason = (
        F.when(~F.col("actor_role").isin(WRITING_ROLES), NOT_ALLOWED)
        .when(F.col("project_status").isNull(), "P027_PROJECT_NOT_FOUND")
        .when((F.col("actor_role") == "editor") & (F.col("project_status") != "active"), "P027_PROJECT_STATUS_NOT_EDITABLE")
        .when(F.col("found").isNull(), "P027_ITEM_NOT_FOUND")
        .when(F.col("now") == F.col("active"), already)
        .when(~F.coalesce(F.col("expected_version") == F.col("row_version"), F.lit(False)), "P027_ITEM_VERSION_CONFLICT")
    )
    judged = facts.withColumn("reason", reason)
    several = judged.where("reason is null").groupBy("item_id").agg(F.count("*").alias("times")).where("times > 1")
    clash = judged.join(several, "item_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("times").isNotNull(), "P027_ITEM_VERSION_CONFLICT")))
    done = F.col("reason").isNull()
    return clash.select(
        "request_id", "item_id", F.when(done, "done").when(F.col("reason").endswith("NOT_FOUND") | (F.col("reason") == NOT_ALLOWED), "refused").otherwise("conflict").alias("outcome"), "reason",
        F.when(done, F.col("active")).otherwise(F.col("now")).alias("active"), F.when(done, F.col("row_version") + 1).otherwise(F.col("row_version")).alias("row_version"),
    )


def baseline_writes(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """WITH CHECK of rows of a baseline: ``may_write``, and a version that is a draft and a baseline."""
    state = versions.select(F.col("id").alias("plan_version_id"), (F.col("is_baseline") & (F.col("status") == "draft")).alias("open"))
    return requests.join(state, "plan_version_id", "left").select("request_id", (may_write() & F.coalesce("open", F.lit(False))).alias("allowed"))


def _actor(n: Column) -> dict[str, Column]:
    role = F.when(n % 17 == 0, "viewer").when(n % 19 == 0, "approver").when(n % 5 == 0, "admin").otherwise("editor")
    return {"actor_role": role, "actor_id": n % 50, "created_by_user_id": F.when(n % 23 == 0, n % 50 + 1).otherwise(n % 50)}


_ACTOR_SQL = "CASE WHEN {n} % 17 = 0 THEN 'viewer' WHEN {n} % 19 = 0 THEN 'approver' WHEN {n} % 5 = 0 THEN 'admin' ELSE 'editor' END"


@query(f"""
, ask AS (
  SELECT id AS request_id, CASE WHEN id % 97 = 0 THEN -1 ELSE project_id END AS project_id, CASE WHEN id % 83 = 17 THEN ' k' ELSE 'L' || id // 2 END AS source_key, metric_type, status,
    CASE WHEN id % 71 = 14 THEN -amount ELSE amount END AS amount, currency_code, {_ACTOR_SQL.format(n="id")} AS role, id % 23 = 0 AS other FROM actuals),
ju AS (
  SELECT ask.*, CASE WHEN role NOT IN ('editor', 'admin') OR other THEN 'P032_NOT_AUTHORIZED' WHEN p.id IS NULL OR p.base_currency <> ask.currency_code THEN 'P032_REFERENCE_UNAVAILABLE'
    WHEN source_key <> trim(source_key) OR amount < 0 THEN 'P032_CONSTRAINT_INVALID' END AS reason FROM ask LEFT JOIN projects p ON p.id = ask.project_id AND NOT deleted),
ex AS (SELECT id + 10000000000000 AS id, project_id, 'L' || id // 2 AS source_key, metric_type, status FROM actuals WHERE id % 3 = 0),
fi AS (SELECT DISTINCT ON (project_id, source_key) project_id, source_key, request_id AS id, metric_type, status FROM ju WHERE reason IS NULL ORDER BY project_id, source_key, request_id),
wi AS (
  SELECT ju.request_id, ju.project_id, ju.source_key, reason, CASE WHEN reason IS NULL THEN coalesce(ex.id, CASE WHEN fi.id <> request_id THEN fi.id END) END AS wid,
    CASE WHEN ex.id IS NOT NULL THEN ex.metric_type ELSE fi.metric_type END AS wm, CASE WHEN ex.id IS NOT NULL THEN ex.status ELSE fi.status END AS ws
  FROM ju LEFT JOIN ex ON ex.project_id = ju.project_id AND ex.source_key = ju.source_key LEFT JOIN fi ON fi.project_id = ju.project_id AND fi.source_key = ju.source_key)
SELECT request_id, project_id, source_key, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN wid IS NOT NULL THEN 'conflict' ELSE 'accepted' END AS outcome,
  CASE WHEN reason IS NOT NULL THEN reason WHEN wid IS NOT NULL THEN 'P033_SOURCE_KEY_CONFLICT' END AS reason, CASE WHEN wm = 'billing_actual' THEN wid END AS existing_event_id,
  CASE WHEN wid IS NOT NULL AND wm = 'billing_actual' THEN ws END AS existing_status, CASE WHEN wid IS NOT NULL THEN wm = 'billing_actual' END AS can_open FROM wi""")
def k3_event_writes(t: Tables) -> DataFrame:
    """Realized events that are asked to be appended to those there are, duplicates within the batch included."""
    n = F.col("id")
    key = F.concat(F.lit("L"), F.floor(n / 2).cast("string"))
    requests = t.actuals.withColumns(
        {
            "project_id": F.when(n % 97 == 0, -1).otherwise(F.col("project_id")), "source_key": F.when(n % 83 == 17, " k").otherwise(key),
            "amount": F.when(n % 71 == 14, -F.col("amount")).otherwise(F.col("amount")), **_actor(n),
        }
    ).withColumnRenamed("id", "request_id")
    existing = t.actuals.where("id % 3 = 0").select((n + 10**13).alias("id"), "project_id", key.alias("source_key"), "metric_type", "status")
    return event_writes(requests, existing, t.projects)


@query(f"""
, it AS (SELECT id, project_id, active, id % 4 + 1 AS row_version FROM items WHERE NOT deleted),
on1 AS (SELECT id AS request_id, id AS item_id, project_id, id % 2 = 1 AS want, CASE WHEN id % 7 = 0 THEN 99 ELSE id % 4 + 1 END AS seen, {_ACTOR_SQL.format(n="id")} AS role FROM items WHERE id % 3 <> 0),
ask AS (SELECT * FROM on1 UNION ALL SELECT * REPLACE (request_id + 10000000000000 AS request_id, CASE WHEN item_id % 62 = 1 THEN item_id + 1000000000000 ELSE item_id END AS item_id) FROM on1 WHERE item_id % 31 = 1),
ju AS (
  SELECT ask.*, it.active AS now, row_version, CASE WHEN role NOT IN ('editor', 'admin') THEN 'P032_NOT_AUTHORIZED' WHEN p.id IS NULL THEN 'P027_PROJECT_NOT_FOUND'
    WHEN role = 'editor' AND p.status <> 'active' THEN 'P027_PROJECT_STATUS_NOT_EDITABLE' WHEN it.id IS NULL THEN 'P027_ITEM_NOT_FOUND' WHEN it.active AND want THEN 'P028_ITEM_ALREADY_ACTIVE'
    WHEN NOT it.active AND NOT want THEN 'P027_ITEM_ALREADY_INACTIVE' WHEN seen <> row_version THEN 'P027_ITEM_VERSION_CONFLICT' END AS r
  FROM ask LEFT JOIN projects p ON p.id = ask.project_id AND NOT p.deleted LEFT JOIN it ON it.id = item_id AND it.project_id = ask.project_id),
al AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN count(*) FILTER (r IS NULL) OVER (PARTITION BY item_id) > 1 THEN 'P027_ITEM_VERSION_CONFLICT' END AS reason FROM ju)
SELECT request_id, item_id, CASE WHEN reason IS NULL THEN 'done' WHEN reason IN ('P032_NOT_AUTHORIZED', 'P027_PROJECT_NOT_FOUND', 'P027_ITEM_NOT_FOUND') THEN 'refused' ELSE 'conflict' END AS outcome, reason,
  CASE WHEN reason IS NULL THEN want ELSE now END AS active, CASE WHEN reason IS NULL THEN row_version + 1 ELSE row_version END AS row_version FROM al""")
def k6_item_activations(t: Tables) -> DataFrame:
    """Items of the portfolio that are asked to be switched on or off."""
    n = F.col("id")
    items = t.items.withColumn("row_version", n % 4 + 1)
    once = t.items.where("id % 3 <> 0").select(n.alias("request_id"), n.alias("item_id"), "project_id", (n % 2 == 1).alias("active"), F.when(n % 7 == 0, 99).otherwise(n % 4 + 1).alias("expected_version"), *[c.alias(k) for k, c in _actor(n).items()])
    again = once.where("item_id % 31 = 1").withColumns({"request_id": F.col("request_id") + 10**13, "item_id": F.when(F.col("item_id") % 62 == 1, F.col("item_id") + 10**12).otherwise(F.col("item_id"))})
    return activations(items, t.projects, once.unionByName(again))


@query(f"""
, ask AS (SELECT id AS request_id, id % 6 AS version, {_ACTOR_SQL.format(n="id")} AS role, id % 23 = 0 AS other FROM items),
ve AS (SELECT id, is_baseline OR id = 0 AS base, CASE WHEN id = 4 THEN 'draft' ELSE status END AS status FROM versions)
SELECT request_id, role IN ('editor', 'admin') AND NOT other AND coalesce(base AND status = 'draft', false) AS allowed FROM ask LEFT JOIN ve ON ve.id = version""")
def r7_baseline_writes(t: Tables) -> DataFrame:
    """Rows of a baseline that actors ask to add, one for each item, to versions of all kinds."""
    n = F.col("id")
    versions = t.versions.withColumns({"is_baseline": F.col("is_baseline") | (n == 0), "status": F.when(n == 4, "draft").otherwise(F.col("status"))})
    requests = t.items.select(n.alias("request_id"), (n % 6).alias("plan_version_id"), *[c.alias(k) for k, c in _actor(n).items()])
    return baseline_writes(requests, versions)
