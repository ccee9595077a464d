"""Data quality: the findings centre, duplicates, severity counts and the roll-up by project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.operators.portfolio import official_versions, posted_billing
from portfolia.operators.views import QUALITY_SQL, data_quality, live_items
from portfolia.plans.registry import query
from portfolia.sources.bindings import Tables, count_of, money

#: Severities from the gravest, with the status that each gives a project.
SEVERITIES = {"BLOCKING": "BLOCKED", "ERROR": "ERROR", "WARNING": "WARNING", "INFO": "PASS"}
#: The moment at which staleness is judged; injected, never the clock.
EVALUATED_AT = "1998-06-01 00:00:00"
FIELDS = ["description", "quantity", "unit_code", "currency_code"]


def findings(t: Tables, evaluated_at: str = EVALUATED_AT) -> DataFrame:
    """One row per finding: id, project, rule, severity, currency, origin and observed value."""
    return reduce(DataFrame.unionByName, rules(t, evaluated_at))


def rules(t: Tables, evaluated_at: str = EVALUATED_AT) -> list[DataFrame]:
    """The findings of each rule."""
    live = t.projects.where("not deleted")
    own = live.select(F.col("id").alias("project_id"), "base_currency", "contract_value")
    shape = ["finding_id", "project_id", "rule_code", "severity", "currency_code", "origin_entity", "observed_value"]
    text = lambda *c: F.concat_ws(":", *[F.lit(x) if isinstance(x, str) and x.endswith("!") else F.col(x).cast("string") if isinstance(x, str) else x for x in c])
    none = F.lit(None).cast("string")
    mismatch = data_quality(t).where("finding_code = 'PROJECT_VALUE_MISMATCH'").select("finding_id", "project_id", F.col("finding_code").alias("rule_code"), "severity", "currency_code", F.lit("project").alias("origin_entity"), F.col("observed_value").cast("string").alias("observed_value"))
    items = live_items(t).withColumnRenamed("currency_code", "item_currency").join(own, "project_id")
    empty = lambda c: F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c if c != "item_currency" else "currency_code"))
    missing = items.select("id", "project_id", "base_currency", F.explode(F.array_compact(F.array(*[empty(c if c != "currency_code" else "item_currency") for c in FIELDS]))).alias("field"))
    missing = missing.select(text(F.lit("missing-required-field"), "id", "field").alias("finding_id"), "project_id", F.lit("MISSING_REQUIRED_FIELD").alias("rule_code"), F.lit("ERROR").alias("severity"), F.col("base_currency").alias("currency_code"), F.lit("project_item").alias("origin_entity"), none.alias("observed_value"))
    grain = items.where("item_currency <> base_currency").select(text(F.lit("grain-mismatch"), "project_id", "id").alias("finding_id"), "project_id", F.lit("GRAIN_MISMATCH").alias("rule_code"), F.lit("ERROR").alias("severity"), F.col("item_currency").alias("currency_code"), F.lit("project_item").alias("origin_entity"), none.alias("observed_value"))
    at = F.lit(evaluated_at).cast(t.projects.schema["updated_at"].dataType)
    stale = live.where(at - F.col("updated_at") > F.expr("INTERVAL 30 DAYS")).select(text(F.lit("project-data-stale"), "id").alias("finding_id"), F.col("id").alias("project_id"), F.lit("PROJECT_DATA_STALE").alias("rule_code"), F.lit("WARNING").alias("severity"), F.col("base_currency").alias("currency_code"), F.lit("project").alias("origin_entity"), F.date_format("updated_at", "yyyy-MM-dd").alias("observed_value"))
    return [x.select(*shape) for x in (mismatch, missing, grain, stale, unplanned_balance(t, own))]


def unplanned_balance(t: Tables, own: DataFrame) -> DataFrame:
    """Projects with one official plan in their currency, no posted billing in another, and something left to plan."""
    same = lambda rows: rows.join(own, "project_id").where("currency_code = base_currency")
    single = same(official_versions(t)).groupBy("project_id").agg(F.countDistinct("plan_version_id").alias("n")).where("n = 1").select("project_id")
    official = t.versions.where("status in ('approved', 'locked')").select(F.col("id").alias("plan_version_id"))
    lines = t.lines.where("metric_type = 'billing_planned' and planning_level = 'item'").join(official, "plan_version_id", "left_semi")
    planned = same(lines).groupBy("project_id").agg(F.sum("amount").alias("planned"))
    posted = posted_billing(t).join(own, "project_id")
    billed = posted.where("currency_code = base_currency").groupBy("project_id").agg(F.sum("amount").alias("billed"))
    foreign = posted.where("not (currency_code <=> base_currency)").select("project_id")
    rows = own.join(single, "project_id", "left_semi").join(foreign, "project_id", "left_anti").join(planned, "project_id", "left").join(billed, "project_id", "left")
    left = money(F.col("contract_value") - F.coalesce("billed", money(F.lit(0))) - F.coalesce("planned", money(F.lit(0))))
    return rows.withColumn("left", left).where("left > 0").select(
        F.concat_ws(":", F.lit("unplanned-balance"), F.col("project_id").cast("string")).alias("finding_id"), "project_id", F.lit("UNPLANNED_BALANCE").alias("rule_code"), F.lit("WARNING").alias("severity"),
        F.col("base_currency").alias("currency_code"), F.lit("project").alias("origin_entity"), F.col("left").cast("string").alias("observed_value"),
    )


FINDINGS_SQL = f"""
, live AS (SELECT * FROM projects WHERE NOT deleted), li AS (SELECT i.*, base_currency FROM items i JOIN live p ON p.id = project_id WHERE active AND NOT i.deleted),
q AS ({QUALITY_SQL}),
one AS (SELECT s.project_id FROM scopes s JOIN live p ON p.id = s.project_id AND s.currency_code = base_currency JOIN versions v ON v.id = plan_version_id AND v.status IN ('approved', 'locked') WHERE planning_level = 'item' GROUP BY 1 HAVING count(DISTINCT plan_version_id) = 1),
pln AS (SELECT l.project_id, sum(amount) AS x FROM lines l JOIN live p ON p.id = l.project_id AND l.currency_code = base_currency JOIN versions v ON v.id = plan_version_id AND v.status IN ('approved', 'locked') WHERE planning_level = 'item' GROUP BY 1),
pst AS (SELECT project_id, sum(CASE WHEN currency_code = base_currency THEN amount END) AS y, bool_or(currency_code <> base_currency) AS odd FROM actuals a JOIN live p ON p.id = project_id WHERE metric_type = 'billing_actual' AND a.status = 'posted' GROUP BY 1),
f AS (
  SELECT finding_id, project_id, finding_code AS rule_code, severity, currency_code, 'project' AS origin_entity, observed_value::VARCHAR AS observed_value FROM q WHERE finding_code = 'PROJECT_VALUE_MISMATCH'
  UNION ALL SELECT 'missing-required-field:' || id || ':description', project_id, 'MISSING_REQUIRED_FIELD', 'ERROR', base_currency, 'project_item', NULL FROM li WHERE description IS NULL OR trim(description) = ''
  UNION ALL SELECT 'grain-mismatch:' || project_id || ':' || id, project_id, 'GRAIN_MISMATCH', 'ERROR', currency_code, 'project_item', NULL FROM li WHERE currency_code <> base_currency
  UNION ALL SELECT 'project-data-stale:' || id, id, 'PROJECT_DATA_STALE', 'WARNING', base_currency, 'project', strftime(updated_at, '%Y-%m-%d') FROM live WHERE TIMESTAMP '{EVALUATED_AT}' - updated_at > INTERVAL 30 DAYS
  UNION ALL SELECT 'unplanned-balance:' || p.id, p.id, 'UNPLANNED_BALANCE', 'WARNING', base_currency, 'project', (contract_value - coalesce(y, 0) - coalesce(x, 0))::DECIMAL(20,2)::VARCHAR
    FROM live p JOIN one ON one.project_id = p.id LEFT JOIN pln ON pln.project_id = p.id LEFT JOIN pst ON pst.project_id = p.id WHERE NOT coalesce(odd, false) AND contract_value - coalesce(y, 0) - coalesce(x, 0) > 0)
"""


@query(FINDINGS_SQL + "SELECT * FROM f")
def g12_findings(t: Tables) -> DataFrame:
    return findings(t)


@query(FINDINGS_SQL + "SELECT s AS severity, count(f.severity) AS findings, count(DISTINCT project_id) AS projects FROM (VALUES ('BLOCKING'), ('ERROR'), ('WARNING'), ('INFO')) v(s) LEFT JOIN f ON f.severity = s GROUP BY s")
def a13_severity_counts(t: Tables) -> DataFrame:
    """Findings by severity; severities without findings count zero."""
    known = t.spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counted = findings(t).groupBy("severity").agg(count_of("*").alias("findings"), F.countDistinct("project_id").cast("long").alias("projects"))
    return known.join(counted, "severity", "left").select("severity", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("findings", "projects")])


@query(FINDINGS_SQL + """, all_ AS (SELECT project_id, severity FROM f UNION ALL SELECT project_id, severity FROM q WHERE severity = 'BLOCKING')
SELECT id AS project_id, project_code, ['PASS', 'WARNING', 'ERROR', 'BLOCKED'][(1 + coalesce(max(CASE severity WHEN 'BLOCKING' THEN 3 WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 END), 0))::INT] AS project_status FROM live LEFT JOIN all_ ON project_id = id GROUP BY id, project_code""")
def a14_project_status(t: Tables) -> DataFrame:
    """The gravest finding of each live project decides its status."""
    ranks = list(SEVERITIES.values())[::-1]
    rank = reduce(lambda c, s: c.when(F.col("severity") == s[1], s[0]), enumerate(list(SEVERITIES)[::-1]), F.when(F.lit(False), 0))
    every = findings(t).select("project_id", "severity").unionByName(data_quality(t).where("severity = 'BLOCKING'").select("project_id", "severity"))
    worst = every.groupBy("project_id").agg(F.max(rank).alias("rank"))
    return t.projects.where("not deleted").select(F.col("id").alias("project_id"), "project_code").join(worst, "project_id", "left").select("project_id", "project_code", F.element_at(F.array(*map(F.lit, ranks)), F.coalesce("rank", F.lit(0)) + 1).alias("project_status"))


@query("""SELECT project_id, source_line_key, count(*) AS occurrences, min(id) AS first_item_id, array_to_string(list_sort(list(line_number)), ',') AS line_numbers FROM items WHERE NOT deleted GROUP BY ALL HAVING count(*) > 1""")
def g13_duplicate_items(t: Tables) -> DataFrame:
    """Items that share their source line, with the lines they stand on in order."""
    return t.items.where("not deleted").groupBy("project_id", "source_line_key").agg(count_of("*").alias("occurrences"), F.min("id").alias("first_item_id"), F.array_join(F.transform(F.array_sort(F.collect_list("line_number")), lambda x: x.cast("string")), ",").alias("line_numbers")).where("occurrences > 1")


@query("""SELECT (SELECT count(*) FROM (SELECT project_code FROM projects GROUP BY 1 HAVING count(*) > 1)) AS project_codes, (SELECT count(*) FROM (SELECT 1 FROM items GROUP BY project_id, source_line_key HAVING count(*) > 1)) AS item_lines,
  (SELECT count(*) FROM (SELECT 1 FROM lines GROUP BY plan_version_id, project_id, project_item_id, metric_type, competence_month HAVING count(*) > 1)) AS plan_lines, (SELECT count(*) FROM (SELECT 1 FROM scopes GROUP BY plan_version_id, project_id, metric_type HAVING count(*) > 1)) AS plan_scopes""")
def g14_logical_duplicates(t: Tables) -> DataFrame:
    """How many keys that should be unique are not."""
    keys = {"project_codes": (t.projects, ["project_code"]), "item_lines": (t.items, ["project_id", "source_line_key"]), "plan_lines": (t.lines, ["plan_version_id", "project_id", "project_item_id", "metric_type", "competence_month"]), "plan_scopes": (t.scopes, ["plan_version_id", "project_id", "metric_type"])}
    parts = [rows.groupBy(*by).count().where("count > 1").agg(count_of("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, (rows, by) in keys.items()]
    return reduce(DataFrame.unionByName, parts).groupBy().pivot("name", list(keys)).agg(F.first("n"))
