"""Analytical views: portfolio and project overviews, monthly facts, cumulative curves, versions, provenance.

Independent facts are aggregated to their key before they are joined, so no
join multiplies amounts.  Amounts of different currencies are never added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portfolia.plans.registry import query
from portfolia.sources.bindings import Tables, count_of, money

#: What is said of figures that have no agreed meaning yet.
UNRESOLVED, UNSUPPORTED = "ACTUAL_STATUS_UNRESOLVED", "UNSUPPORTED_COMPARISON"
RUNNING = (Window.unboundedPreceding, 0)


def live_items(t: Tables) -> DataFrame:
    return t.items.where("active and not deleted")


def item_totals(t: Tables) -> DataFrame:
    """Per project and currency: number and total of live items."""
    return live_items(t).groupBy("project_id", "currency_code").agg(count_of("*").alias("active_item_count"), money(F.sum("total_amount")).alias("active_item_total"))


def sum_where(status: str) -> Column:
    return money(F.sum(F.when(F.col("status") == status, F.col("amount")))).alias(f"billing_actual_{status}_amount")


def actual_totals(t: Tables) -> DataFrame:
    """Per project and currency: billing events by status."""
    months = F.countDistinct(F.trunc("competence_date", "MM")).cast("long").alias("actual_competence_count")
    return t.actuals.where("metric_type = 'billing_actual'").groupBy("project_id", "currency_code").agg(count_of("*").alias("actual_event_count"), months, *map(sum_where, ("draft", "posted", "cancelled")))


def with_totals(t: Tables) -> DataFrame:
    """Live projects with the totals in their own currency."""
    own = t.projects.where("not deleted").withColumnsRenamed({"id": "project_id", "base_currency": "currency_code"})
    key = ["project_id", "currency_code"]
    return own.join(item_totals(t), key, "left").join(actual_totals(t), key, "left")


_TOTALS_SQL = """,
it AS (SELECT project_id, currency_code, count(*) AS n, sum(total_amount) AS total FROM items WHERE active AND NOT deleted GROUP BY ALL),
act AS (
  SELECT project_id, currency_code, count(*) AS n, count(DISTINCT date_trunc('month', competence_date)) AS months, sum(amount) FILTER (status = 'draft') AS d,
    sum(amount) FILTER (status = 'posted') AS p, sum(amount) FILTER (status = 'cancelled') AS c FROM actuals WHERE metric_type = 'billing_actual' GROUP BY ALL),
own AS (
  SELECT p.*, it.n AS items_n, it.total, act.n AS actual_n, act.months, act.d, act.p, act.c FROM projects p
  LEFT JOIN it ON it.project_id = p.id AND it.currency_code = p.base_currency LEFT JOIN act ON act.project_id = p.id AND act.currency_code = p.base_currency WHERE NOT deleted)
"""


@query(_TOTALS_SQL + """
SELECT base_currency AS currency_code, count(*) AS project_count, count(*) FILTER (status = 'active') AS active_project_count, sum(contract_value)::DECIMAL(20,2) AS contract_value_total,
  sum(total)::DECIMAL(20,2) AS active_item_total, count(*) FILTER (items_n IS NULL) AS projects_without_items_count, sum(contract_value - total)::DECIMAL(20,2) AS contract_item_delta_total,
  coalesce(sum(actual_n), 0)::BIGINT AS actual_event_count, sum(d)::DECIMAL(20,2) AS billing_actual_draft_amount, sum(p)::DECIMAL(20,2) AS billing_actual_posted_amount,
  sum(c)::DECIMAL(20,2) AS billing_actual_cancelled_amount, NULL::DECIMAL(20,2) AS billing_actual_canonical_amount, 'ACTUAL_STATUS_UNRESOLVED' AS billing_actual_canonical_status,
  NULL::DECIMAL(20,2) AS billing_remaining_amount, 'UNSUPPORTED_COMPARISON' AS billing_remaining_status FROM own GROUP BY base_currency""")
def v1_portfolio_overview(t: Tables) -> DataFrame:
    """One row per currency; the delta is contract less items."""
    nothing = F.lit(None).cast("decimal(20,2)")
    sums = {c: money(F.sum(c)).alias(c) for c in ("billing_actual_draft_amount", "billing_actual_posted_amount", "billing_actual_cancelled_amount")}
    return with_totals(t).groupBy("currency_code").agg(
        count_of("*").alias("project_count"), count_of(F.when(F.col("status") == "active", 1)).alias("active_project_count"), money(F.sum("contract_value")).alias("contract_value_total"),
        money(F.sum("active_item_total")).alias("active_item_total"), count_of(F.when(F.col("active_item_count").isNull(), 1)).alias("projects_without_items_count"),
        money(F.sum(F.col("contract_value") - F.col("active_item_total"))).alias("contract_item_delta_total"), F.coalesce(F.sum("actual_event_count"), F.lit(0)).cast("long").alias("actual_event_count"), *sums.values(),
    ).withColumns({"billing_actual_canonical_amount": nothing, "billing_actual_canonical_status": F.lit(UNRESOLVED), "billing_remaining_amount": nothing, "billing_remaining_status": F.lit(UNSUPPORTED)})


@query(_TOTALS_SQL + """
SELECT own.id AS project_id, project_code, project_name, client_id, display_name AS client_display_name, status AS project_status, base_currency AS currency_code, contract_value, data_reference_date,
  items_n AS active_item_count, total::DECIMAL(20,2) AS active_item_total, (total - contract_value)::DECIMAL(20,2) AS contract_item_delta,
  CASE WHEN total = contract_value THEN 'PASS' ELSE 'ERROR' END AS project_reconciliation_status, coalesce(actual_n, 0) AS actual_event_count, coalesce(months, 0) AS actual_competence_count,
  coalesce(actual_n, 0) > 0 AS project_month_actual_available, d::DECIMAL(20,2) AS billing_actual_draft_amount, p::DECIMAL(20,2) AS billing_actual_posted_amount, c::DECIMAL(20,2) AS billing_actual_cancelled_amount
FROM own JOIN clients ON clients.id = client_id""")
def v2_project_overview(t: Tables) -> DataFrame:
    """One row per live project; the delta is items less contract, the opposite of the portfolio's."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return with_totals(t).join(t.clients.select(F.col("id").alias("client_id"), F.col("display_name").alias("client_display_name")), "client_id").select(
        "project_id", "project_code", "project_name", "client_id", "client_display_name", F.col("status").alias("project_status"), "currency_code", "contract_value", "data_reference_date", "active_item_count", "active_item_total",
        money(F.col("active_item_total") - F.col("contract_value")).alias("contract_item_delta"), F.when(F.col("active_item_total") == F.col("contract_value"), "PASS").otherwise("ERROR").alias("project_reconciliation_status"),
        zero("actual_event_count"), zero("actual_competence_count"), (F.coalesce("actual_event_count", F.lit(0)) > 0).alias("project_month_actual_available"), "billing_actual_draft_amount", "billing_actual_posted_amount", "billing_actual_cancelled_amount",
    )


@query("""SELECT i.id AS project_item_id, project_id, project_code, client_id, source_line_key, line_number::INT AS line_number, item_code, description, quantity, unit_code, currency_code, unit_price, total_amount, active,
  'project_items:' || i.id AS database_reference FROM items i JOIN projects p ON p.id = project_id WHERE NOT p.deleted AND NOT i.deleted""")
def v3_project_items(t: Tables) -> DataFrame:
    """One row per item that is not deleted, active or not; item_code is no key."""
    owner = t.projects.where("not deleted").select(F.col("id").alias("project_id"), "project_code", "client_id")
    return t.items.where("not deleted").join(owner, "project_id").select(
        F.col("id").alias("project_item_id"), "project_id", "project_code", "client_id", "source_line_key", "line_number", "item_code", "description", "quantity", "unit_code", "currency_code", "unit_price", "total_amount", "active",
        F.concat(F.lit("project_items:"), F.col("id").cast("string")).alias("database_reference"),
    )


def planned_facts(t: Tables) -> DataFrame:
    version = t.versions.select(F.col("id").alias("plan_version_id"), F.col("name").alias("plan_version_name"), F.col("status").alias("plan_status"), "is_baseline")
    live = t.projects.where("not deleted").select(F.col("id").alias("project_id"), "project_code")
    return t.lines.join(version, "plan_version_id").join(live, "project_id")


def actual_facts(t: Tables) -> DataFrame:
    live = t.projects.where("not deleted").select(F.col("id").alias("project_id"), "project_code")
    return t.actuals.join(live, "project_id").withColumn("competence_month", F.trunc("competence_date", "MM")).withColumnRenamed("status", "actual_status")


@query("""
SELECT 'planned' AS fact_kind, 'planned:' || l.id AS analytical_fact_key, l.project_id, project_code, l.project_item_id, source_line_key, l.plan_version_id, v.name AS plan_version_name, v.status AS plan_status, is_baseline,
  l.competence_month, l.competence_month AS competence_date, metric_type, planning_level AS financial_grain, NULL AS actual_status, l.currency_code, amount, declaration_state
FROM lines l JOIN versions v ON v.id = plan_version_id JOIN projects p ON p.id = l.project_id LEFT JOIN items i ON i.id = l.project_item_id AND i.project_id = l.project_id
LEFT JOIN cells c ON c.financial_plan_line_id = l.id WHERE NOT p.deleted
UNION ALL
SELECT 'actual', 'actual:' || a.id, a.project_id, project_code, a.project_item_id, source_line_key, NULL, NULL, NULL, NULL, date_trunc('month', competence_date)::DATE, competence_date, metric_type,
  CASE WHEN a.project_item_id IS NULL THEN 'project' ELSE 'item' END, a.status, a.currency_code, amount, NULL
FROM actuals a JOIN projects p ON p.id = a.project_id LEFT JOIN items i ON i.id = a.project_item_id AND i.project_id = a.project_id WHERE NOT p.deleted""")
def v4_financial_monthly(t: Tables) -> DataFrame:
    """Planned lines and realized events as rows of one shape, told apart by fact_kind."""
    keys = t.items.select(F.col("id").alias("project_item_id"), "project_id", "source_line_key")
    marks = t.cells.where("financial_plan_line_id is not null").select(F.col("financial_plan_line_id").alias("id"), "declaration_state")
    planned = planned_facts(t).join(marks, "id", "left").withColumns({"fact_kind": F.lit("planned"), "competence_date": F.col("competence_month"), "financial_grain": F.col("planning_level")})
    actual = actual_facts(t).withColumns({"fact_kind": F.lit("actual"), "financial_grain": F.when(F.col("project_item_id").isNull(), "project").otherwise("item")})
    both = planned.unionByName(actual, allowMissingColumns=True).join(keys, ["project_item_id", "project_id"], "left")
    return both.select(
        "fact_kind", F.concat_ws(":", "fact_kind", F.col("id").cast("string")).alias("analytical_fact_key"), "project_id", "project_code", "project_item_id", "source_line_key", "plan_version_id", "plan_version_name",
        "plan_status", "is_baseline", "competence_month", "competence_date", "metric_type", "financial_grain", "actual_status", "currency_code", "amount", "declaration_state",
    )


def curve(facts: DataFrame, series: list[str], kind: str, availability: str) -> DataFrame:
    """Monthly sums and their running total within each series, metric and currency."""
    by = [*series, "metric_type", "currency_code"]
    monthly = facts.groupBy(*by, "competence_month").agg(money(F.sum("amount")).alias("monthly_amount"))
    running = money(F.sum("monthly_amount").over(Window.partitionBy(*by).orderBy("competence_month").rowsBetween(*RUNNING)))
    return monthly.select(F.lit(kind).alias("series_kind"), *by, "competence_month", "monthly_amount", running.alias("cumulative_amount"), F.lit(availability).alias("availability_status"))


def curves(t: Tables, extra: list[str]) -> DataFrame:
    planned = curve(planned_facts(t), [*extra, "plan_version_id", "plan_version_name", "plan_status", "is_baseline"], "planned", "AVAILABLE")
    actual = curve(actual_facts(t), [*extra, "actual_status"], "actual", "AVAILABLE_FROM_PERSISTED_EVENTS_ONLY")
    return planned.unionByName(actual, allowMissingColumns=True)


def _curve_sql(extra: str) -> str:
    return f"""
SELECT 'planned' AS series_kind, {extra} plan_version_id, plan_version_name, plan_status, is_baseline, NULL AS actual_status, metric_type, currency_code, competence_month, m::DECIMAL(20,2) AS monthly_amount,
  (sum(m) OVER (PARTITION BY {extra} plan_version_id, metric_type, currency_code ORDER BY competence_month ROWS UNBOUNDED PRECEDING))::DECIMAL(20,2) AS cumulative_amount, 'AVAILABLE' AS availability_status
FROM (SELECT {extra} plan_version_id, v.name AS plan_version_name, v.status AS plan_status, is_baseline, metric_type, currency_code, competence_month, sum(amount) AS m
  FROM lines JOIN versions v ON v.id = plan_version_id JOIN projects p ON p.id = project_id WHERE NOT deleted GROUP BY ALL)
UNION ALL
SELECT 'actual', {extra} NULL, NULL, NULL, NULL, status, metric_type, currency_code, competence_month, m::DECIMAL(20,2),
  (sum(m) OVER (PARTITION BY {extra} status, metric_type, currency_code ORDER BY competence_month ROWS UNBOUNDED PRECEDING))::DECIMAL(20,2), 'AVAILABLE_FROM_PERSISTED_EVENTS_ONLY'
FROM (SELECT {extra} a.status, metric_type, currency_code, date_trunc('month', competence_date)::DATE AS competence_month, sum(amount) AS m
  FROM actuals a JOIN projects p ON p.id = project_id WHERE NOT deleted GROUP BY ALL)"""


@query(_curve_sql(""))
def v5_s_curve_portfolio(t: Tables) -> DataFrame:
    """Cumulative curves of the portfolio by version and by event status; planned and actual never share a row."""
    return curves(t, [])


@query(_curve_sql("project_id, project_code,"))
def v6_s_curve_project(t: Tables) -> DataFrame:
    return curves(t, ["project_id", "project_code"])


def data_quality(t: Tables) -> DataFrame:
    live = t.projects.where("not deleted")
    totals = item_totals(t).select(F.col("project_id").alias("id"), F.col("currency_code").alias("base_currency"), F.col("active_item_total").alias("observed_value"))
    base = ["id", "project_code", "base_currency"]
    differs = live.join(totals, ["id", "base_currency"], "left").where(~F.col("observed_value").eqNullSafe(F.col("contract_value")))
    value = differs.select(*base, F.col("contract_value").alias("expected_value"), "observed_value", money(F.col("observed_value") - F.col("contract_value")).alias("delta"), F.lit("PROJECT_VALUE_MISMATCH").alias("finding_code"), F.lit("ERROR").alias("severity"), F.lit("project_contract").alias("domain"), F.lit("REVIEW_SOURCE_OR_DATABASE").alias("remediation_class"))
    with_events = live.join(t.actuals.select(F.col("project_id").alias("id")), "id", "left_semi")  # events of any metric
    unresolved = with_events.select(*base, F.lit(UNRESOLVED).alias("finding_code"), F.lit("BLOCKING").alias("severity"), F.lit("billing_actual").alias("domain"), F.lit("BUSINESS_DECISION_REQUIRED").alias("remediation_class"))
    return value.unionByName(unresolved, allowMissingColumns=True).select(F.concat_ws(":", "finding_code", F.col("id").cast("string")).alias("finding_id"), "finding_code", "severity", "domain", F.col("id").alias("project_id"), "project_code", F.col("base_currency").alias("currency_code"), "expected_value", "observed_value", "delta", "remediation_class")


QUALITY_SQL = """
SELECT 'PROJECT_VALUE_MISMATCH:' || p.id AS finding_id, 'PROJECT_VALUE_MISMATCH' AS finding_code, 'ERROR' AS severity, 'project_contract' AS domain, p.id AS project_id, project_code, base_currency AS currency_code,
  contract_value AS expected_value, total::DECIMAL(20,2) AS observed_value, (total - contract_value)::DECIMAL(20,2) AS delta, 'REVIEW_SOURCE_OR_DATABASE' AS remediation_class
FROM projects p LEFT JOIN (SELECT project_id, currency_code, sum(total_amount) AS total FROM items WHERE active AND NOT deleted GROUP BY ALL) i ON i.project_id = p.id AND i.currency_code = base_currency
WHERE NOT deleted AND total IS DISTINCT FROM contract_value
UNION ALL
SELECT 'ACTUAL_STATUS_UNRESOLVED:' || id, 'ACTUAL_STATUS_UNRESOLVED', 'BLOCKING', 'billing_actual', id, project_code, base_currency, NULL, NULL, NULL, 'BUSINESS_DECISION_REQUIRED'
FROM projects WHERE NOT deleted AND id IN (SELECT project_id FROM actuals)"""


@query(QUALITY_SQL)
def v7_data_quality(t: Tables) -> DataFrame:
    """Findings that the tables show by themselves; a project without items differs too."""
    return data_quality(t)


@query("""SELECT v.id || ':' || coalesce(s.project_id::VARCHAR, 'NO_SCOPE') || ':' || coalesce(planning_level, '') AS analytical_version_key, v.id AS plan_version_id, v.name AS plan_version_name, v.status AS plan_status, is_baseline,
  source_version_id, s.project_id, project_code, metric_type, planning_level, currency_code, false AS current_version_supported, 'CURRENT_VERSION_RULE_UNDEFINED' AS current_version_status
FROM versions v LEFT JOIN scopes s ON s.plan_version_id = v.id LEFT JOIN projects p ON p.id = s.project_id""")
def v8_plan_versions(t: Tables) -> DataFrame:
    """Versions with their scopes, deleted projects included."""
    named = t.scopes.join(t.projects.select(F.col("id").alias("project_id"), "project_code"), "project_id", "left")
    rows = t.versions.withColumnsRenamed({"id": "plan_version_id", "name": "plan_version_name", "status": "plan_status"}).join(named, "plan_version_id", "left")
    key = F.concat_ws(":", F.col("plan_version_id").cast("string"), F.coalesce(F.col("project_id").cast("string"), F.lit("NO_SCOPE")), F.coalesce("planning_level", F.lit("")))
    return rows.withColumns({"analytical_version_key": key, "current_version_supported": F.lit(False), "current_version_status": F.lit("CURRENT_VERSION_RULE_UNDEFINED")})


@query("""SELECT i.project_id, project_code, c.project_item_id, source_line_key, c.competence_month, declaration_state, canonical_amount, financial_plan_line_id, l.amount AS line_amount
FROM cells c JOIN items i ON i.id = c.project_item_id JOIN projects p ON p.id = i.project_id LEFT JOIN lines l ON l.id = c.financial_plan_line_id""")
def v9_source_provenance(t: Tables) -> DataFrame:
    """One row per source cell: blank cells have neither amount nor line, explicit zeros have both."""
    item = t.items.select(F.col("id").alias("project_item_id"), "project_id", "source_line_key")
    line = t.lines.select(F.col("id").alias("financial_plan_line_id"), F.col("amount").alias("line_amount"))
    return t.cells.drop("plan_version_id").join(item, "project_item_id").join(t.projects.select(F.col("id").alias("project_id"), "project_code"), "project_id").join(line, "financial_plan_line_id", "left")


def _variance_sql(k: str) -> str:
    return f"""
, planned AS (SELECT {k}currency_code, competence_month, sum(amount) AS x FROM lines JOIN projects p ON p.id = project_id WHERE NOT deleted AND plan_version_id = 3 GROUP BY ALL),
realized AS (SELECT {k}currency_code, date_trunc('month', competence_date)::DATE AS competence_month, sum(amount) AS y FROM actuals JOIN projects p ON p.id = project_id WHERE NOT deleted AND actuals.status = 'posted' AND metric_type = 'billing_actual' GROUP BY ALL),
spine AS (SELECT {k}currency_code, competence_month FROM planned UNION SELECT {k}currency_code, competence_month FROM realized),
both_ AS (SELECT {k}currency_code, competence_month, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM spine LEFT JOIN planned USING ({k}currency_code, competence_month) LEFT JOIN realized USING ({k}currency_code, competence_month)),
run AS (SELECT *, sum(x) OVER w AS cx, sum(y) OVER w AS cy, sum(x) OVER (PARTITION BY {k}currency_code) AS tx FROM both_ WINDOW w AS (PARTITION BY {k}currency_code ORDER BY competence_month))
SELECT {k}currency_code, competence_month, x::DECIMAL(20,2) AS planned_amount, y::DECIMAL(20,2) AS actual_amount, cx::DECIMAL(20,2) AS planned_cumulative, cy::DECIMAL(20,2) AS actual_cumulative, (cy - cx)::DECIMAL(20,2) AS variance,
  CASE WHEN tx > 0 THEN round(cx::DOUBLE / tx::DOUBLE, 6) ELSE 0 END AS planned_share, CASE WHEN cx > 0 THEN round(cy::DOUBLE / cx::DOUBLE, 6) END AS adherence FROM run"""


def variance(t: Tables, extra: list[str]) -> DataFrame:
    """Baseline against posted billing on a common spine of months; shares are 0, adherence is null without a base."""
    by = [*extra, "currency_code", "competence_month"]
    planned = planned_facts(t).where("plan_version_id = 3").groupBy(*by).agg(F.sum("amount").alias("x"))
    realized = actual_facts(t).where("actual_status = 'posted' and metric_type = 'billing_actual'").groupBy(*by).agg(F.sum("amount").alias("y"))
    joined = planned.join(realized, by, "full").select(*by, money(F.coalesce("x", F.lit(0))).alias("planned_amount"), money(F.coalesce("y", F.lit(0))).alias("actual_amount"))
    whole = Window.partitionBy(*extra, "currency_code")
    w = whole.orderBy("competence_month").rangeBetween(Window.unboundedPreceding, 0)
    ratio = lambda a, b: F.round(F.col(a).cast("double") / F.col(b).cast("double"), 6)
    run = joined.withColumns({"planned_cumulative": money(F.sum("planned_amount").over(w)), "actual_cumulative": money(F.sum("actual_amount").over(w)), "total": money(F.sum("planned_amount").over(whole))})
    return run.withColumns({"variance": money(F.col("actual_cumulative") - F.col("planned_cumulative")), "planned_share": F.when(F.col("total") > 0, ratio("planned_cumulative", "total")).otherwise(0.0), "adherence": F.when(F.col("planned_cumulative") > 0, ratio("actual_cumulative", "planned_cumulative"))}).drop("total")


@query(_variance_sql(""))
def v12_s_curve_variance(t: Tables) -> DataFrame:
    return variance(t, [])


@query(_variance_sql("project_id, "))
def v13_s_curve_project_variance(t: Tables) -> DataFrame:
    return variance(t, ["project_id"])


@query(_TOTALS_SQL + """
SELECT id AS project_id, project_code, abs(coalesce(total, 0) - contract_value) > 0.01 AS has_value_difference, coalesce(bad, 0) AS incomplete_item_count
FROM own LEFT JOIN (SELECT project_id, count(*) AS bad FROM items WHERE active AND NOT deleted AND description IS NULL GROUP BY project_id) b ON b.project_id = own.id""")
def v14_quality_flags(t: Tables) -> DataFrame:
    """Per project: whether items and contract differ by more than a cent, and items without a description."""
    bad = live_items(t).where("description is null").groupBy("project_id").agg(count_of("*").alias("bad"))
    off = F.abs(F.coalesce("active_item_total", money(F.lit(0))) - F.col("contract_value")) > F.lit("0.01").cast("decimal(20,2)")
    return with_totals(t).join(bad, "project_id", "left").select("project_id", "project_code", off.alias("has_value_difference"), F.coalesce("bad", F.lit(0)).cast("long").alias("incomplete_item_count"))
