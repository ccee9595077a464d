"""Queries of the portfolio: lists with balance, search and pages, items, events, summaries, audit reading."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfolia.operators.views import QUALITY_SQL, data_quality
from portfolia.plans.registry import query
from portfolia.sources.bindings import OFFICIAL, Tables, count_of, money

#: What a list may be sorted by.
SORTABLE = ["project_code", "client_name", "project_status", "contract_value", "unscheduled_balance", "updated_on", "alert_count"]


def contains(text: str, *columns: str) -> Column:
    """Case-insensitive search in any of the columns; wildcards in ``text`` stand for themselves."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{escaped}%") for c in columns])


def page(rows: DataFrame, sort: str, descending: bool = False, number: int = 1, size: int = 25, tie: str = "project_id") -> DataFrame:
    """One page in a total order, nulls last; ``size`` is at most 100."""
    if sort not in SORTABLE or not 1 <= size <= 100 or number < 1:
        raise ValueError("unknown sort column or page out of range")
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(key, F.col(tie).asc()).offset((number - 1) * size).limit(size)


def official_versions(t: Tables) -> DataFrame:
    """project_id and plan_version_id of approved or locked item plans of billing."""
    good = t.versions.where(F.col("status").isin(OFFICIAL)).select(F.col("id").alias("plan_version_id"))
    return t.scopes.where("metric_type = 'billing_planned' and planning_level = 'item'").join(good, "plan_version_id", "left_semi").select("project_id", "plan_version_id", "currency_code")


def posted_billing(t: Tables) -> DataFrame:
    return t.actuals.where("metric_type = 'billing_actual' and status = 'posted'")


def portfolio(t: Tables) -> DataFrame:
    """One row per live project with the balance that neither posted billing nor the one official plan covers."""
    official = official_versions(t).drop("currency_code").distinct()
    counts = official.groupBy("project_id").agg(count_of("*").alias("plans"))
    single = official.join(counts.where("plans = 1"), "project_id")
    planned = t.lines.where("metric_type = 'billing_planned' and planning_level = 'item'").join(single, ["project_id", "plan_version_id"], "left_semi").groupBy("project_id").agg(money(F.sum("amount")).alias("planned"))
    own = t.projects.select(F.col("id").alias("project_id"), "base_currency")
    posted = posted_billing(t).join(own, "project_id").groupBy("project_id").agg(money(F.sum("amount")).alias("posted"), F.bool_or(F.col("currency_code") != F.col("base_currency")).alias("foreign"))
    alerts = data_quality(t).groupBy("project_id").agg(count_of("*").alias("alerts"), F.array_join(F.array_sort(F.collect_set("finding_code")), ", ").alias("alerts_summary"))
    joined = t.projects.where("not deleted").withColumnRenamed("id", "project_id").join(t.clients.select(F.col("id").alias("client_id"), F.col("display_name").alias("client_name")), "client_id")
    for side in (counts, planned, posted, alerts):
        joined = joined.join(side, "project_id", "left")
    status = F.when(F.col("contract_value").isNull(), "missing_contract").when(F.col("foreign"), "data_quality_issue").when(F.col("plans").isNull(), "no_official_plan").when(F.col("plans") != 1, "ambiguous_official_plan").otherwise("available")
    zero = money(F.lit(0))
    left = F.greatest(F.col("contract_value") - F.coalesce("posted", zero) - F.coalesce("planned", zero), zero)
    return joined.select(
        "project_id", "project_code", "client_name", F.col("status").alias("project_status"), F.col("base_currency").alias("currency_code"), "contract_value", money(F.when(status == "available", left)).alias("unscheduled_balance"),
        status.alias("unscheduled_balance_status"), F.col("updated_at").cast("date").alias("updated_on"), F.coalesce("alerts", F.lit(0)).cast("long").alias("alert_count"), "alerts_summary",
    )


PORTFOLIO_SQL = f"""
, official AS (SELECT DISTINCT project_id, plan_version_id FROM scopes WHERE planning_level = 'item' AND plan_version_id IN (SELECT id FROM versions WHERE status IN ('approved', 'locked'))),
n AS (SELECT project_id, count(*) AS plans FROM official GROUP BY 1),
pl AS (SELECT l.project_id, sum(amount) AS planned FROM lines l JOIN official o ON o.project_id = l.project_id AND o.plan_version_id = l.plan_version_id JOIN n ON n.project_id = l.project_id AND plans = 1 WHERE planning_level = 'item' GROUP BY 1),
po AS (SELECT project_id, sum(amount) AS posted, bool_or(currency_code <> base_currency) AS odd FROM actuals a JOIN projects p ON p.id = project_id WHERE metric_type = 'billing_actual' AND a.status = 'posted' GROUP BY 1),
q AS ({QUALITY_SQL}),
al AS (SELECT project_id, count(*) AS alerts, string_agg(DISTINCT finding_code, ', ' ORDER BY finding_code) AS alerts_summary FROM q GROUP BY 1),
judged AS (
  SELECT p.*, display_name, planned, posted, alerts, alerts_summary, CASE WHEN odd THEN 'data_quality_issue' WHEN plans IS NULL THEN 'no_official_plan' WHEN plans <> 1 THEN 'ambiguous_official_plan' ELSE 'available' END AS verdict
  FROM projects p JOIN clients c ON c.id = client_id LEFT JOIN n ON n.project_id = p.id LEFT JOIN pl ON pl.project_id = p.id LEFT JOIN po ON po.project_id = p.id LEFT JOIN al ON al.project_id = p.id WHERE NOT deleted),
listed AS (
  SELECT id AS project_id, project_code, display_name AS client_name, status AS project_status, base_currency AS currency_code, contract_value,
    CASE WHEN verdict = 'available' THEN greatest(contract_value - coalesce(posted, 0) - coalesce(planned, 0), 0) END::DECIMAL(20,2) AS unscheduled_balance, verdict AS unscheduled_balance_status,
    updated_at::DATE AS updated_on, coalesce(alerts, 0) AS alert_count, alerts_summary FROM judged)
"""


@query(PORTFOLIO_SQL + "SELECT * FROM listed")
def g1_portfolio_list(t: Tables) -> DataFrame:
    return portfolio(t)


@query(PORTFOLIO_SQL + "SELECT * FROM listed WHERE project_status = 'active' AND (project_code ILIKE '%01%' OR client_name ILIKE '%01%') ORDER BY unscheduled_balance DESC NULLS LAST, project_id LIMIT 25 OFFSET 25")
def g1_portfolio_page(t: Tables) -> DataFrame:
    """The second page of active projects found by a search, highest balance first."""
    return page(portfolio(t).where("project_status = 'active'").where(contains("01", "project_code", "client_name")), "unscheduled_balance", True, 2)


@query(PORTFOLIO_SQL + """, counts AS (SELECT currency_code, unscheduled_balance_status, count(*) AS projects, sum(unscheduled_balance)::DECIMAL(20,2) AS balance FROM listed GROUP BY ALL)
SELECT * FROM counts""")
def g1_balance_by_status(t: Tables) -> DataFrame:
    return portfolio(t).groupBy("currency_code", "unscheduled_balance_status").agg(count_of("*").alias("projects"), money(F.sum("unscheduled_balance")).alias("balance"))


@query("""SELECT unit_code, currency_code, count(*) AS items, count(*) FILTER (active AND NOT deleted) AS active_items, sum(CASE WHEN active AND NOT deleted THEN total_amount END)::DECIMAL(20,2) AS active_total,
  (max(line_number) + 1)::BIGINT AS next_line_number FROM items GROUP BY ALL""")
def g3_units_in_use(t: Tables) -> DataFrame:
    """Units with the items that use them, deleted ones included, as the next line number counts them."""
    live = F.col("active") & ~F.col("deleted")
    return t.items.groupBy("unit_code", "currency_code").agg(count_of("*").alias("items"), count_of(F.when(live, 1)).alias("active_items"), money(F.sum(F.when(live, F.col("total_amount")))).alias("active_total"), (F.max("line_number") + 1).cast("long").alias("next_line_number"))


@query("""SELECT a.id AS event_id, a.project_id, a.project_item_id, source_line_key, a.competence_date, a.status, a.currency_code, a.amount FROM actuals a LEFT JOIN items i ON i.id = a.project_item_id AND i.project_id = a.project_id
WHERE metric_type = 'billing_actual'""")
def g8_realized_events(t: Tables) -> DataFrame:
    item = t.items.select(F.col("id").alias("project_item_id"), "project_id", "source_line_key")
    billed = t.actuals.where("metric_type = 'billing_actual'").join(item, ["project_item_id", "project_id"], "left")
    return billed.select(F.col("id").alias("event_id"), "project_id", "project_item_id", "source_line_key", "competence_date", "status", "currency_code", "amount")


@query("SELECT c.id AS client_id, display_name, segment, active, count(p.id) AS live_projects FROM clients c LEFT JOIN projects p ON p.client_id = c.id AND NOT p.deleted WHERE active AND display_name ILIKE '%1%' GROUP BY ALL")
def g9_clients(t: Tables) -> DataFrame:
    """Active clients found by a search, with their live projects."""
    own = t.projects.where("not deleted").groupBy("client_id").agg(count_of("*").alias("live_projects"))
    found = t.clients.where("active").where(contains("1", "display_name")).withColumnRenamed("id", "client_id")
    return found.join(own, "client_id", "left").withColumn("live_projects", F.coalesce("live_projects", F.lit(0)).cast("long"))


@query("""SELECT id, entity_id, operation FROM audit WHERE (changed_at, id) < (SELECT (changed_at, id) FROM audit WHERE id = (SELECT max(id) // 2 FROM audit)) ORDER BY changed_at DESC, id DESC LIMIT 200""")
def g10_audit_page(t: Tables) -> DataFrame:
    """The 200 audit rows before a cursor, newest first (keyset paging)."""
    middle = t.audit.agg((F.max("id") / 2).cast("long").alias("id"))
    cursor = t.audit.join(middle, "id").agg(F.max(F.struct("changed_at", "id")))
    return t.audit.where(F.struct("changed_at", "id") < cursor.scalar()).orderBy(F.desc("changed_at"), F.desc("id")).limit(200).select("id", "entity_id", "operation")


def latest_snapshots(t: Tables) -> DataFrame:
    return t.snapshots.where("status = 'success'").groupBy("project_id").agg(F.max("authority_revision").alias("authority_revision"), F.max_by("id", "authority_revision").alias("snapshot_id"))


@query("SELECT DISTINCT ON (project_id) project_id, authority_revision, id AS snapshot_id FROM snapshots WHERE status = 'success' ORDER BY project_id, authority_revision DESC")
def a11_latest_snapshots(t: Tables) -> DataFrame:
    """The successful snapshot of each project with the highest revision."""
    return latest_snapshots(t)


#: Roles and the plan states that those below an editor see.
WRITERS, PUBLISHED = ["editor", "approver", "admin"], ["approved", "locked", "archived"]
TABLE_NAMES = ("clients", "projects", "items", "versions", "lines", "scopes", "actuals", "cells", "snapshots", "audit")


class Visible(Tables):
    """The ten tables as a role sees them, each cut when it is first asked for.

    An admin sees all and no role nothing.  Others see active clients, live
    active projects of these, live items of these projects, and their successful
    snapshots.  Versions, and by them lines and scopes, are seen by writers;
    viewers see published ones; so it is with the cells of a baseline, by the
    version that each cell belongs to.  Events are for every role, the audit log
    for admins only.
    """

    def __init__(self, t: Tables, role: str | None):
        super().__init__(t.spark, t.sf_dir)
        self._all, self._role = t, role

    def _cut(self, name: str, seen: Callable[[DataFrame], DataFrame]) -> DataFrame:
        rows = getattr(self._all, name)
        if self._role == "admin":
            return rows
        return rows.where(F.lit(False)) if self._role is None else seen(rows)

    def _ids(self, name: str, key: str) -> DataFrame:
        return getattr(self, name).select(F.col("id").alias(key))

    @cached_property
    def clients(self) -> DataFrame:
        return self._cut("clients", lambda rows: rows.where("active"))

    @cached_property
    def projects(self) -> DataFrame:
        return self._cut("projects", lambda rows: rows.where("not deleted and status = 'active'").join(self._ids("clients", "client_id"), "client_id", "left_semi"))

    @cached_property
    def items(self) -> DataFrame:
        return self._cut("items", lambda rows: rows.where("active and not deleted").join(self._ids("projects", "project_id"), "project_id", "left_semi"))

    @cached_property
    def versions(self) -> DataFrame:
        return self._cut("versions", lambda rows: rows if self._role in WRITERS else rows.where(F.col("status").isin(PUBLISHED)))

    @cached_property
    def lines(self) -> DataFrame:
        return self._cut("lines", lambda rows: rows.join(self._ids("versions", "plan_version_id"), "plan_version_id", "left_semi"))

    @cached_property
    def scopes(self) -> DataFrame:
        return self._cut("scopes", lambda rows: rows.join(self._ids("versions", "plan_version_id"), "plan_version_id", "left_semi"))

    @cached_property
    def actuals(self) -> DataFrame:
        return self._cut("actuals", lambda rows: rows)

    @cached_property
    def cells(self) -> DataFrame:
        published = self._all.versions.where(F.col("status").isin(PUBLISHED)).select(F.col("id").alias("plan_version_id"))
        return self._cut("cells", lambda rows: rows if self._role in WRITERS else rows.join(published, "plan_version_id", "left_semi"))

    @cached_property
    def snapshots(self) -> DataFrame:
        return self._cut("snapshots", lambda rows: rows.where("status = 'success'").join(self._ids("projects", "project_id"), "project_id", "left_semi"))

    @cached_property
    def audit(self) -> DataFrame:
        return self._cut("audit", lambda rows: rows.where(F.lit(False)))


def visible(t: Tables, role: str | None) -> Tables:
    """The tables as a role sees them; an unknown role is refused."""
    if role not in (None, "viewer", *WRITERS):
        raise ValueError(f"unknown role: {role}")
    return Visible(t, role)


@query("""
, seen AS (SELECT p.* FROM projects p JOIN clients c ON c.id = client_id AND c.active WHERE NOT deleted AND status = 'active'),
li AS (SELECT plan_version_id, project_id FROM lines)
SELECT role, kind, n FROM (
  SELECT 'viewer' AS role, 'projects' AS kind, (SELECT count(*) FROM seen) AS n UNION ALL SELECT 'editor', 'projects', (SELECT count(*) FROM seen) UNION ALL SELECT 'admin', 'projects', (SELECT count(*) FROM projects)
  UNION ALL SELECT 'viewer', 'items', (SELECT count(*) FROM items WHERE active AND NOT deleted AND project_id IN (SELECT id FROM seen)) UNION ALL SELECT 'editor', 'items', (SELECT count(*) FROM items WHERE active AND NOT deleted AND project_id IN (SELECT id FROM seen))
  UNION ALL SELECT 'admin', 'items', (SELECT count(*) FROM items) UNION ALL SELECT 'viewer', 'lines', (SELECT count(*) FROM li WHERE plan_version_id IN (2, 3, 4)) UNION ALL SELECT 'editor', 'lines', (SELECT count(*) FROM li)
  UNION ALL SELECT 'admin', 'lines', (SELECT count(*) FROM li))""")
def x11_visible_rows(t: Tables) -> DataFrame:
    """How many projects, items and plan lines each role sees; plan lines go by their version, not by their project."""
    counts = [getattr(visible(t, role), kind).agg(count_of("*").alias("n")).select(F.lit(role).alias("role"), F.lit(kind).alias("kind"), "n") for role in ("viewer", "editor", "admin") for kind in ("projects", "items", "lines")]
    return reduce(DataFrame.unionByName, counts)


OTHERS = ("clients", "versions", "scopes", "actuals", "cells", "snapshots", "audit")


@query("""
, seen AS (SELECT p.* FROM projects p JOIN clients c ON c.id = client_id AND c.active WHERE NOT deleted AND status = 'active'),
n AS (SELECT (SELECT count(*) FROM clients WHERE active) AS clients, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM versions WHERE status IN ('approved', 'locked', 'archived')) AS published,
  (SELECT count(*) FROM scopes) AS scopes, (SELECT count(*) FROM scopes WHERE plan_version_id IN (SELECT id FROM versions WHERE status IN ('approved', 'locked', 'archived'))) AS published_scopes,
  (SELECT count(*) FROM actuals) AS actuals, (SELECT count(*) FROM cells) AS cells,
  (SELECT count(*) FROM cells c WHERE EXISTS (SELECT 1 FROM versions v WHERE v.id = c.plan_version_id AND v.status IN ('approved', 'locked', 'archived'))) AS published_cells, (SELECT count(*) FROM snapshots WHERE status = 'success' AND project_id IN (SELECT id FROM seen)) AS snapshots)
SELECT role, kind, CASE kind WHEN 'clients' THEN clients WHEN 'versions' THEN CASE role WHEN 'viewer' THEN published ELSE versions END WHEN 'scopes' THEN CASE role WHEN 'viewer' THEN published_scopes ELSE scopes END
  WHEN 'actuals' THEN actuals WHEN 'cells' THEN CASE WHEN role IN ('editor', 'approver', 'admin') THEN cells ELSE published_cells END WHEN 'snapshots' THEN snapshots ELSE 0 END AS n
FROM (SELECT unnest(['viewer', 'editor', 'approver']) AS role) r, (SELECT unnest(['clients', 'versions', 'scopes', 'actuals', 'cells', 'snapshots', 'audit']) AS kind) k, n""")
def x11_visible_others(t: Tables) -> DataFrame:
    """How many rows of the other seven tables each role below an admin sees."""
    counts = []
    for role in ("viewer", "editor", "approver"):
        mine = visible(t, role)
        counts += [getattr(mine, kind).agg(count_of("*").alias("n")).select(F.lit(role).alias("role"), F.lit(kind).alias("kind"), "n") for kind in OTHERS]
    return reduce(DataFrame.unionByName, counts)
