"""A registry of the constraints that the domain declares, checked in one pass over each table.

A constraint has a table, a name, and an expression over the table's columns;
as in SQL it holds where it is null.  ``check`` compiles the constraints of a
table into one projection: each row is read once, whatever their number, and
only what is broken comes out.  A constraint whose columns a table lacks is
listed as not applicable, so that nothing is passed over in silence.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.plans.registry import query
from portfolia.sources.bindings import Tables, count_of


@dataclass(frozen=True)
class Constraint:
    """``holds`` is a Spark SQL expression over ``columns``."""

    table: str
    name: str
    columns: tuple[str, ...]
    holds: str


def not_blank(table: str, name: str, column: str) -> Constraint:
    return Constraint(table, name, (column,), f"trim({column}) <> ''")


def trimmed(table: str, name: str, column: str) -> Constraint:
    return Constraint(table, name, (column,), f"{column} = trim({column}) and {column} <> ''")


def matching(table: str, name: str, column: str, pattern: str) -> Constraint:
    return Constraint(table, name, (column,), f"{column} rlike '{pattern}'")


def one_of(table: str, name: str, column: str, *values: str) -> Constraint:
    return Constraint(table, name, (column,), f"{column} in ({', '.join(repr(v) for v in values)})")


def at_least(table: str, name: str, column: str, least: int) -> Constraint:
    return Constraint(table, name, (column,), f"{column} >= {least}")


#: Names, states, patterns and limits that the domain declares.
_CODE, _HASH, _CURRENCY = "^[A-Z0-9][A-Z0-9._/-]{0,63}$", "^[0-9a-f]{64}$", "^[A-Z]{3}$"
_SENSITIVE = r"(?i)(?:[A-Z]:\\\\|(?:^|\\s)/(?:home|Users)/|postgres(?:ql)?://|https?://|(^|[^a-z0-9_])(?:password|token|private_key|client_secret)\\s*=)"
#: Of the contract of cells what the columns of the domain's table allow.
_CELL = (
    "competence_month = trunc(competence_month, 'MM') and (source_numeric_text is null or source_numeric_text rlike '^(0|[1-9][0-9]*)(\\\\.[0-9]{1,14})?$') and ("
    "(declaration_state = 'blank' and source_numeric_text is null and canonical_amount is null and financial_plan_line_id is null)"
    " or (declaration_state = 'explicit_zero' and source_numeric_text is not null and try_cast(source_numeric_text as decimal(38,14)) = 0 and canonical_amount = 0 and financial_plan_line_id is not null)"
    " or (declaration_state = 'value' and source_numeric_text is not null and try_cast(source_numeric_text as decimal(38,14)) > 0"
    " and canonical_amount = round(try_cast(source_numeric_text as decimal(38,14)), 2) and financial_plan_line_id is not null))"
)
CONSTRAINTS = [
    not_blank("clients", "ck_clients_display_name_not_blank", "display_name"), not_blank("clients", "ck_clients_legal_name_not_blank", "legal_name"), not_blank("clients", "ck_clients_tax_id_not_blank", "tax_id"),
    trimmed("projects", "ck_projects_code_normalized", "project_code"), not_blank("projects", "ck_projects_name_not_blank", "project_name"), not_blank("projects", "ck_projects_reporting_group_not_blank", "reporting_group"),
    at_least("projects", "ck_projects_contract_value", "contract_value", 0), at_least("projects", "ck_projects_opening_balance", "opening_balance", 0), at_least("projects", "ck_projects_budget_cost", "budget_cost", 0),
    Constraint("projects", "ck_projects_dates", ("start_date", "end_date"), "end_date >= start_date"), at_least("projects", "ck_projects_version", "version", 1),
    one_of("projects", "project_status", "status", "draft", "active", "on_hold", "completed", "cancelled"), matching("projects", "ck_currencies_code", "base_currency", _CURRENCY),
    trimmed("items", "ck_project_items_source_key", "source_line_key"), at_least("items", "ck_project_items_line_number", "line_number", 1), trimmed("items", "ck_project_items_item_code", "item_code"),
    not_blank("items", "ck_project_items_description", "description"), Constraint("items", "ck_project_items_quantity", ("quantity",), "quantity > 0"), at_least("items", "ck_project_items_unit_price", "unit_price", 0),
    Constraint("items", "total_amount_generated", ("quantity", "unit_price", "total_amount"), "total_amount = cast(round(cast(quantity as decimal(18,4)) * cast(unit_price as decimal(18,4)), 2) as decimal(20,2))"),
    Constraint("items", "ck_units_code", ("unit_code",), "unit_code = upper(trim(unit_code)) and unit_code <> ''"), matching("items", "ck_currencies_code", "currency_code", _CURRENCY),
    not_blank("versions", "ck_plan_versions_name_not_blank", "name"), one_of("versions", "plan_status", "status", "draft", "pending_approval", "approved", "locked", "archived"),
    Constraint("versions", "ck_plan_versions_approval", ("status", "approved_by_user_id", "approved_at"),
               "(status in ('draft', 'pending_approval') and approved_by_user_id is null and approved_at is null) or (status in ('approved', 'locked') and approved_by_user_id is not null and approved_at is not null) or status = 'archived'"),
    at_least("versions", "ck_plan_versions_row_version", "row_version", 1), at_least("versions", "ck_plan_versions_content_revision", "content_revision", 1),
    one_of("scopes", "planned_financial_metric", "metric_type", "billing_planned", "receipt_forecast"), one_of("scopes", "planning_level", "planning_level", "project", "item"), matching("scopes", "ck_currencies_code", "currency_code", _CURRENCY),
    Constraint("lines", "ck_financial_plan_lines_grain", ("planning_level", "project_item_id"), "(planning_level = 'project' and project_item_id is null) or (planning_level = 'item' and project_item_id is not null)"),
    Constraint("lines", "ck_financial_plan_lines_month_start", ("competence_month",), "competence_month = trunc(competence_month, 'MM')"), at_least("lines", "ck_financial_plan_lines_amount", "amount", 0),
    one_of("lines", "planned_financial_metric", "metric_type", "billing_planned", "receipt_forecast"), matching("lines", "ck_currencies_code", "currency_code", _CURRENCY),
    trimmed("actuals", "ck_financial_actual_source_key", "source_key"), not_blank("actuals", "ck_financial_actual_document_number", "document_number"), not_blank("actuals", "ck_financial_actual_installment_key", "installment_key"),
    at_least("actuals", "ck_financial_actual_amount", "amount", 0), one_of("actuals", "actual_financial_metric", "metric_type", "billing_actual", "receipt_actual"), one_of("actuals", "actual_status", "status", "draft", "posted", "cancelled"),
    matching("actuals", "ck_currencies_code", "currency_code", _CURRENCY),
    Constraint("cells", "ck_monthly_plan_cells_contract_p013", ("competence_month", "declaration_state", "source_numeric_text", "canonical_amount", "financial_plan_line_id"), _CELL),
    one_of("snapshots", "ck_p034_snapshot_status", "status", "success"), at_least("snapshots", "ck_p034_snapshot_revision", "authority_revision", 1),
    matching("project_observations", "ck_p034_project_observation_code", "project_code", _CODE), at_least("project_observations", "ck_p034_project_observation_ordinal", "occurrence_ordinal", 1),
    matching("item_observations", "ck_p034_item_observation_code", "project_code", _CODE), matching("item_observations", "ck_p034_item_observation_line", "source_line_key", "^p012-line-v1:[0-9a-f]{64}$"),
    trimmed("item_observations", "ck_p034_item_observation_id", "item_id"), at_least("item_observations", "ck_p034_item_observation_ordinal", "occurrence_ordinal", 1),
    one_of("source_references", "ck_p034_source_reference_kind", "kind", "source", "database"), matching("source_references", "ck_p034_source_reference_fingerprint", "fingerprint", _HASH),
    Constraint("source_references", "ck_p034_source_reference_locator", ("locator",), f"trim(locator) <> '' and char_length(locator) <= 1024 and not (locator rlike '{_SENSITIVE}')"),
    at_least("source_references", "ck_p034_source_reference_ordinal", "reference_ordinal", 1), not_blank("audit", "ck_audit_log_record_id", "entity_id"), not_blank("audit", "ck_audit_log_request_id", "request_id"),
]
#: What names a row of a table.
KEYS = {
    "scopes": ["plan_version_id", "project_id", "metric_type", "planning_level", "currency_code"], "cells": ["project_item_id", "competence_month", "declaration_state", "financial_plan_line_id"],
    "source_references": ["observed", "observation_id", "reference_ordinal"],
}


def applicable(table: str, columns: list[str], constraints: list[Constraint] = CONSTRAINTS) -> tuple[list[Constraint], list[Constraint]]:
    """The constraints of a table whose columns are there, and those whose are not."""
    own = [c for c in constraints if c.table == table]
    return [c for c in own if set(c.columns) <= set(columns)], [c for c in own if not set(c.columns) <= set(columns)]


def check(table: str, rows: DataFrame, constraints: list[Constraint] = CONSTRAINTS) -> DataFrame:
    """table_name, constraint_name and row_key of each row that breaks a constraint, in one pass over ``rows``."""
    there, _ = applicable(table, rows.columns, constraints)
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEYS.get(table, ["id"])])
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(f"({c.holds})"), F.lit(True)), F.lit(c.name)) for c in there])) if there else F.array().cast("array<string>")
    return rows.select(F.lit(table).alias("table_name"), F.explode(broken).alias("constraint_name"), key.alias("row_key"))


def check_all(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [check(name, rows) for name, rows in tables.items()])


def summary(t: Tables, tables: dict[str, DataFrame]) -> DataFrame:
    """Every declared constraint: whether it applies, and how many rows break it."""
    state = [(c.table, c.name, set(c.columns) <= set(tables[c.table].columns)) for c in CONSTRAINTS]
    known = t.spark.createDataFrame(state, "table_name string, constraint_name string, applies boolean")
    counted = check_all(tables).groupBy("table_name", "constraint_name").agg(count_of("*").alias("n"))
    return known.join(counted, ["table_name", "constraint_name"], "left").select("table_name", "constraint_name", "applies", F.when(F.col("applies"), F.coalesce("n", F.lit(0))).cast("long").alias("violations"))


def requested(t: Tables) -> dict[str, DataFrame]:
    """The domain tables as writes that ask for rows of all kinds, some of which break a rule."""
    n, event = F.col("id"), F.col("id")
    every = lambda k, r, bad, c: F.when(n % k == r, bad).otherwise(F.col(c))
    text = lambda c: F.col(c).cast("string")
    again = F.when(F.col("snapshot_id") % 31 == 3, 0).otherwise(F.col("occurrence_ordinal"))
    seen = F.split_part("observation_id", F.lit(":"), F.lit(1)).cast("long")
    return {
        "clients": t.clients.withColumns({"display_name": every(97, 5, "  ", "display_name"), "legal_name": every(89, 4, " ", "display_name"), "tax_id": F.when(n % 83 == 3, "").when(n % 2 == 0, text("id"))}),
        "projects": t.projects.withColumns({
            "project_code": F.when(n % 101 == 1, F.concat(F.lit(" "), "project_code")).when(n % 103 == 2, "").otherwise(F.col("project_code")), "project_name": every(107, 3, " ", "project_name"), "contract_value": F.when(n % 109 == 4, -F.col("contract_value")).otherwise(F.col("contract_value")),
            "status": every(113, 5, "closed", "status"), "base_currency": every(127, 6, "brl", "base_currency"), "start_date": F.col("data_reference_date"), "end_date": F.when(n % 3 > 0, F.date_add("data_reference_date", (n % 61 - 1).cast("int"))),
        }),
        "items": t.items.withColumns({
            "source_line_key": F.when(n % 131 == 1, F.concat("source_line_key", F.lit(" "))).otherwise(F.col("source_line_key")), "line_number": every(137, 2, 0, "line_number"), "description": every(139, 3, " ", "description"), "quantity": F.when(n % 149 == 4, -F.col("quantity")).otherwise(F.col("quantity")),
            "unit_price": F.when(n % 151 == 5, -F.col("unit_price")).otherwise(F.col("unit_price")), "unit_code": every(157, 6, "un", "unit_code"), "total_amount": F.when(n % 163 == 7, F.col("total_amount") + 1).otherwise(F.col("total_amount")).cast("decimal(20,2)"), "item_code": every(167, 8, " x", "item_code"),
            "currency_code": every(173, 9, "US", "currency_code"),
        }),
        "versions": t.versions.withColumns({"approved_by_user_id": F.when(n % 4 > 1, n), "approved_at": F.when(n % 4 > 0, F.lit("2026-01-01").cast("date")), "row_version": n, "name": every(5, 4, "", "name")}),
        "scopes": t.scopes.withColumns({"planning_level": F.when(F.col("project_id") % 41 == 7, "month").otherwise(F.col("planning_level")), "metric_type": F.when(F.col("project_id") % 43 == 8, "cost").otherwise(F.col("metric_type"))}),
        "lines": t.lines.withColumns({
            "planning_level": F.when(n % 47 == 9, "project").otherwise(F.col("planning_level")), "competence_month": F.when(n % 53 == 10, F.date_add("competence_month", 1)).otherwise(F.col("competence_month")), "amount": F.when(n % 59 == 11, -F.col("amount")).otherwise(F.col("amount")),
            "project_item_id": F.when(n % 61 != 12, F.col("project_item_id")), "currency_code": every(67, 13, "reais", "currency_code"),
        }),
        "actuals": t.actuals.withColumns({
            "amount": F.when(n % 71 == 14, -F.col("amount")).otherwise(F.col("amount")), "status": every(73, 15, "open", "status"), "metric_type": every(79, 16, "billing", "metric_type"), "source_key": F.when(n % 83 == 17, " k").otherwise(text("id")),
            "document_number": F.when(n % 89 == 18, " ").when(n % 2 == 1, text("id")), "installment_key": F.when(n % 97 == 19, "").when(n % 3 == 1, text("id")),
        }),
        "cells": t.cells.withColumns({
            "declaration_state": F.when(F.col("project_item_id") % 29 == 3, "empty").otherwise(F.col("declaration_state")), "canonical_amount": F.when(F.col("project_item_id") % 31 == 4, -F.col("canonical_amount")).otherwise(F.col("canonical_amount")),
            "competence_month": F.when(F.col("project_item_id") % 37 == 5, F.date_add("competence_month", 1)).otherwise(F.col("competence_month")),
            "source_numeric_text": F.when(F.col("project_item_id") % 41 == 6, F.lit("1e2")).when(F.col("project_item_id") % 43 == 7, F.lit("0.001")).otherwise(F.concat(text("canonical_amount"), F.lit("4"))),
        }),
        "snapshots": t.snapshots.withColumn("authority_revision", F.when(event % 23 == 3, 0).otherwise(F.col("authority_revision"))),
        "project_observations": t.project_observations.withColumns({"project_code": F.when(F.col("snapshot_id") % 17 == 3, F.lower("project_code")).otherwise(F.col("project_code")), "occurrence_ordinal": again}),
        "item_observations": t.item_observations.withColumns({
            "source_line_key": F.when(F.col("snapshot_id") % 13 > 0, F.concat(F.lit("p012-line-v1:"), F.sha2("source_line_key", 256))).otherwise(F.col("source_line_key")), "item_id": F.when(F.col("snapshot_id") % 11 == 3, F.concat(F.lit(" "), "item_id")).otherwise(F.col("item_id")),
            "occurrence_ordinal": again,
        }),
        "source_references": t.source_references.withColumns({
            "kind": F.when(seen % 19 == 3, "sheet").otherwise(F.col("kind")), "fingerprint": F.when(seen % 23 == 4, F.upper("fingerprint")).otherwise(F.col("fingerprint")),
            "locator": F.when(seen % 29 == 5, F.concat(F.lit("C:\\"), "locator")).when(seen % 31 == 6, F.concat(F.lit("see /home/"), "locator")).when(seen % 37 == 7, F.lit(" ")).when(seen % 41 == 8, F.rpad("locator", 1025, "x")).when(seen % 43 == 9, F.lit("TOKEN = x")).when(seen % 47 == 10, F.lit("mytoken=x")).otherwise(F.col("locator")),
        }),
        "audit": t.audit.withColumns({"entity_id": F.when(n % 59 == 3, "").otherwise(text("entity_id")), "request_id": F.when(n % 61 == 4, " ").when(n % 2 == 0, text("id"))}),
    }


def _broken(table: str, key: str, rules: dict[str, str]) -> str:
    """SQL of the rows of ``table`` (under the name w_TABLE) that break rules."""
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, {key} AS row_key FROM w_{table} WHERE NOT ({holds})" for name, holds in rules.items())


_MONEY_TEXT, _ID = "'^(0|[1-9][0-9]*)(\\.[0-9]{1,14})?$'", "id::VARCHAR"
_OBSERVED = "CASE WHEN snapshot_id % 31 = 3 THEN 0 ELSE occurrence_ordinal END AS occurrence_ordinal"
REQUESTED_SQL = """
, w_clients AS (SELECT * REPLACE (CASE WHEN id % 97 = 5 THEN '  ' ELSE display_name END AS display_name), CASE WHEN id % 89 = 4 THEN ' ' ELSE display_name END AS legal_name,
  CASE WHEN id % 83 = 3 THEN '' WHEN id % 2 = 0 THEN id::VARCHAR END AS tax_id FROM clients),
w_projects AS (SELECT * REPLACE (CASE WHEN id % 101 = 1 THEN ' ' || project_code WHEN id % 103 = 2 THEN '' ELSE project_code END AS project_code,
    CASE WHEN id % 107 = 3 THEN ' ' ELSE project_name END AS project_name, CASE WHEN id % 109 = 4 THEN -contract_value ELSE contract_value END AS contract_value,
    CASE WHEN id % 113 = 5 THEN 'closed' ELSE status END AS status, CASE WHEN id % 127 = 6 THEN 'brl' ELSE base_currency END AS base_currency),
  data_reference_date AS start_date, CASE WHEN id % 3 > 0 THEN data_reference_date + (id % 61 - 1)::INT END AS end_date FROM projects),
w_items AS (SELECT * REPLACE (CASE WHEN id % 131 = 1 THEN source_line_key || ' ' ELSE source_line_key END AS source_line_key, CASE WHEN id % 137 = 2 THEN 0 ELSE line_number END AS line_number,
    CASE WHEN id % 139 = 3 THEN ' ' ELSE description END AS description, CASE WHEN id % 149 = 4 THEN -quantity ELSE quantity END AS quantity, CASE WHEN id % 151 = 5 THEN -unit_price ELSE unit_price END AS unit_price,
    CASE WHEN id % 157 = 6 THEN 'un' ELSE unit_code END AS unit_code, CASE WHEN id % 163 = 7 THEN total_amount + 1 ELSE total_amount END AS total_amount,
    CASE WHEN id % 167 = 8 THEN ' x' ELSE item_code END AS item_code, CASE WHEN id % 173 = 9 THEN 'US' ELSE currency_code END AS currency_code) FROM items),
w_versions AS (SELECT * REPLACE (CASE WHEN id % 5 = 4 THEN '' ELSE name END AS name), CASE WHEN id % 4 > 1 THEN id END AS approver, CASE WHEN id % 4 > 0 THEN DATE '2026-01-01' END AS approved_at, id AS row_version FROM versions),
w_scopes AS (SELECT * REPLACE (CASE WHEN project_id % 41 = 7 THEN 'month' ELSE planning_level END AS planning_level, CASE WHEN project_id % 43 = 8 THEN 'cost' ELSE metric_type END AS metric_type) FROM scopes),
w_lines AS (SELECT * REPLACE (CASE WHEN id % 47 = 9 THEN 'project' ELSE planning_level END AS planning_level, CASE WHEN id % 53 = 10 THEN competence_month + 1 ELSE competence_month END AS competence_month,
    CASE WHEN id % 59 = 11 THEN -amount ELSE amount END AS amount, CASE WHEN id % 61 <> 12 THEN project_item_id END AS project_item_id, CASE WHEN id % 67 = 13 THEN 'reais' ELSE currency_code END AS currency_code) FROM lines),
w_actuals AS (SELECT * REPLACE (CASE WHEN id % 71 = 14 THEN -amount ELSE amount END AS amount, CASE WHEN id % 73 = 15 THEN 'open' ELSE status END AS status, CASE WHEN id % 79 = 16 THEN 'billing' ELSE metric_type END AS metric_type),
  CASE WHEN id % 83 = 17 THEN ' k' ELSE id::VARCHAR END AS source_key, CASE WHEN id % 89 = 18 THEN ' ' WHEN id % 2 = 1 THEN id::VARCHAR END AS document_number,
  CASE WHEN id % 97 = 19 THEN '' WHEN id % 3 = 1 THEN id::VARCHAR END AS installment_key FROM actuals),
w_cells AS (SELECT * REPLACE (CASE WHEN project_item_id % 29 = 3 THEN 'empty' ELSE declaration_state END AS declaration_state, CASE WHEN project_item_id % 31 = 4 THEN -canonical_amount ELSE canonical_amount END AS canonical_amount,
    CASE WHEN project_item_id % 37 = 5 THEN competence_month + 1 ELSE competence_month END AS competence_month),
  CASE WHEN project_item_id % 41 = 6 THEN '1e2' WHEN project_item_id % 43 = 7 THEN '0.001' ELSE (CASE WHEN project_item_id % 31 = 4 THEN -canonical_amount ELSE canonical_amount END)::VARCHAR || '4' END AS txt FROM cells),
w_snapshots AS (SELECT * REPLACE (CASE WHEN id % 23 = 3 THEN 0 ELSE authority_revision END AS authority_revision) FROM snapshots),
w_project_observations AS (SELECT * REPLACE (CASE WHEN snapshot_id % 17 = 3 THEN lower(project_code) ELSE project_code END AS project_code, {observed}) FROM project_observations),
w_item_observations AS (SELECT * REPLACE (CASE WHEN snapshot_id % 13 > 0 THEN 'p012-line-v1:' || sha256(source_line_key) ELSE source_line_key END AS source_line_key,
    CASE WHEN snapshot_id % 11 = 3 THEN ' ' || item_id ELSE item_id END AS item_id, {observed}) FROM item_observations),
w_source_references AS (SELECT * REPLACE (CASE WHEN seen % 19 = 3 THEN 'sheet' ELSE kind END AS kind, CASE WHEN seen % 23 = 4 THEN upper(fingerprint) ELSE fingerprint END AS fingerprint,
    CASE WHEN seen % 29 = 5 THEN 'C:' || chr(92) || locator WHEN seen % 31 = 6 THEN 'see /home/' || locator WHEN seen % 37 = 7 THEN ' ' WHEN seen % 41 = 8 THEN rpad(locator, 1025, 'x')
      WHEN seen % 43 = 9 THEN 'TOKEN = x' WHEN seen % 47 = 10 THEN 'mytoken=x' ELSE locator END AS locator) FROM (SELECT *, split_part(observation_id, ':', 1)::BIGINT AS seen FROM source_references)),
w_audit AS (SELECT * REPLACE (CASE WHEN id % 59 = 3 THEN '' ELSE entity_id::VARCHAR END AS entity_id), CASE WHEN id % 61 = 4 THEN ' ' WHEN id % 2 = 0 THEN id::VARCHAR END AS request_id FROM audit)
""".replace("{observed}", _OBSERVED)
_CURRENCY_SQL = "regexp_full_match({}, '[A-Z]{{3}}')"
_BROKEN = {
    ("clients", _ID): {"ck_clients_display_name_not_blank": "trim(display_name) <> ''", "ck_clients_legal_name_not_blank": "trim(legal_name) <> ''", "ck_clients_tax_id_not_blank": "tax_id IS NULL OR trim(tax_id) <> ''"},
    ("projects", _ID): {
        "ck_projects_code_normalized": "project_code = trim(project_code) AND project_code <> ''", "ck_projects_name_not_blank": "trim(project_name) <> ''", "ck_projects_contract_value": "contract_value >= 0",
        "ck_projects_dates": "end_date IS NULL OR start_date IS NULL OR end_date >= start_date", "project_status": "status IN ('draft', 'active', 'on_hold', 'completed', 'cancelled')", "ck_currencies_code": _CURRENCY_SQL.format("base_currency"),
    },
    ("items", _ID): {
        "ck_project_items_source_key": "source_line_key = trim(source_line_key) AND source_line_key <> ''", "ck_project_items_line_number": "line_number > 0", "ck_project_items_item_code": "item_code IS NULL OR (item_code = trim(item_code) AND item_code <> '')",
        "ck_project_items_description": "description IS NULL OR trim(description) <> ''", "ck_project_items_quantity": "quantity > 0", "ck_project_items_unit_price": "unit_price >= 0",
        "total_amount_generated": "total_amount = round(quantity * unit_price, 2)", "ck_units_code": "unit_code = upper(trim(unit_code)) AND unit_code <> ''", "ck_currencies_code": _CURRENCY_SQL.format("currency_code"),
    },
    ("versions", _ID): {
        "ck_plan_versions_name_not_blank": "trim(name) <> ''", "plan_status": "status IN ('draft', 'pending_approval', 'approved', 'locked', 'archived')", "ck_plan_versions_row_version": "row_version > 0",
        "ck_plan_versions_approval": "CASE WHEN status IN ('draft', 'pending_approval') THEN approver IS NULL AND approved_at IS NULL WHEN status IN ('approved', 'locked') THEN approver IS NOT NULL AND approved_at IS NOT NULL ELSE status = 'archived' END",
    },
    ("scopes", "plan_version_id || '|' || project_id || '|' || metric_type || '|' || planning_level || '|' || currency_code"): {
        "planned_financial_metric": "metric_type IN ('billing_planned', 'receipt_forecast')", "planning_level": "planning_level IN ('project', 'item')", "ck_currencies_code": _CURRENCY_SQL.format("currency_code"),
    },
    ("lines", _ID): {
        "ck_financial_plan_lines_grain": "CASE planning_level WHEN 'project' THEN project_item_id IS NULL WHEN 'item' THEN project_item_id IS NOT NULL ELSE false END",
        "ck_financial_plan_lines_month_start": "day(competence_month) = 1", "ck_financial_plan_lines_amount": "amount >= 0", "planned_financial_metric": "metric_type IN ('billing_planned', 'receipt_forecast')", "ck_currencies_code": _CURRENCY_SQL.format("currency_code"),
    },
    ("actuals", _ID): {
        "ck_financial_actual_source_key": "source_key = trim(source_key) AND source_key <> ''", "ck_financial_actual_document_number": "document_number IS NULL OR trim(document_number) <> ''",
        "ck_financial_actual_installment_key": "installment_key IS NULL OR trim(installment_key) <> ''", "ck_financial_actual_amount": "amount >= 0", "actual_financial_metric": "metric_type IN ('billing_actual', 'receipt_actual')",
        "actual_status": "status IN ('draft', 'posted', 'cancelled')", "ck_currencies_code": _CURRENCY_SQL.format("currency_code"),
    },
    ("cells", "project_item_id || '|' || competence_month || '|' || declaration_state || '|' || coalesce(financial_plan_line_id::VARCHAR, '')"): {
        "ck_monthly_plan_cells_contract_p013": f"day(competence_month) = 1 AND (txt IS NULL OR regexp_matches(txt, {_MONEY_TEXT})) AND CASE declaration_state WHEN 'blank' THEN txt IS NULL AND canonical_amount IS NULL AND financial_plan_line_id IS NULL"
        " WHEN 'explicit_zero' THEN coalesce(try_cast(txt AS DECIMAL(38,14)) = 0, false) AND canonical_amount = 0 AND financial_plan_line_id IS NOT NULL"
        " WHEN 'value' THEN coalesce(try_cast(txt AS DECIMAL(38,14)) > 0 AND canonical_amount = round(try_cast(txt AS DECIMAL(38,14)), 2), false) AND financial_plan_line_id IS NOT NULL ELSE false END",
    },
    ("snapshots", _ID): {"ck_p034_snapshot_status": "status = 'success'", "ck_p034_snapshot_revision": "authority_revision > 0"},
    ("project_observations", "id"): {"ck_p034_project_observation_code": "regexp_full_match(project_code, '[A-Z0-9][A-Z0-9._/-]{0,63}')", "ck_p034_project_observation_ordinal": "occurrence_ordinal > 0"},
    ("item_observations", "id"): {
        "ck_p034_item_observation_code": "regexp_full_match(project_code, '[A-Z0-9][A-Z0-9._/-]{0,63}')", "ck_p034_item_observation_line": "regexp_full_match(source_line_key, 'p012-line-v1:[0-9a-f]{64}')",
        "ck_p034_item_observation_id": "item_id IS NULL OR (trim(item_id) <> '' AND item_id = trim(item_id))", "ck_p034_item_observation_ordinal": "occurrence_ordinal > 0",
    },
    ("source_references", "observed || '|' || observation_id || '|' || reference_ordinal"): {
        "ck_p034_source_reference_kind": "kind IN ('source', 'database')", "ck_p034_source_reference_fingerprint": "regexp_full_match(fingerprint, '[0-9a-f]{64}')", "ck_p034_source_reference_ordinal": "reference_ordinal > 0",
        "ck_p034_source_reference_locator": "trim(locator) <> '' AND length(locator) <= 1024 AND NOT regexp_matches(lower(locator), '[a-z]:\\\\|(^|\\s)/(home|users)/|postgres(ql)?://|https?://|(^|[^a-z0-9_])(password|token|private_key|client_secret)\\s*=')",
    },
    ("audit", _ID): {"ck_audit_log_record_id": "trim(entity_id) <> ''", "ck_audit_log_request_id": "request_id IS NULL OR trim(request_id) <> ''"},
}
BROKEN_SQL = REQUESTED_SQL + ", br AS (" + " UNION ALL ".join(_broken(table, key, rules) for (table, key), rules in _BROKEN.items()) + ")"
_KNOWN = ", ".join(f"('{c.table}', '{c.name}', {'true' if (c.name in next(r for (t, _), r in _BROKEN.items() if t == c.table)) else 'false'})" for c in CONSTRAINTS)


@query(BROKEN_SQL + "SELECT * FROM br")
def x1_constraint_violations(t: Tables) -> DataFrame:
    """Rows of all thirteen tables, as writes ask for them, that break a declared constraint."""
    return check_all(requested(t))


@query(BROKEN_SQL + f""", kn(table_name, constraint_name, applies) AS (VALUES {_KNOWN})
SELECT table_name, constraint_name, applies, CASE WHEN applies THEN coalesce(n, 0) END AS violations
FROM kn LEFT JOIN (SELECT table_name, constraint_name, count(*) AS n FROM br GROUP BY 1, 2) USING (table_name, constraint_name)""")
def x1_constraint_summary(t: Tables) -> DataFrame:
    return summary(t, requested(t))
