"""Planning: editor totals over a spine of months, balances, what-if saves, merges, lineage, distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portfolia.functions.money import balance, distribute
from portfolia.functions.text import excel_date
from portfolia.operators.portfolio import posted_billing
from portfolia.plans.registry import query
from portfolia.sources.bindings import Tables, count_of, money

#: Fixed limit of a spine.
MONTHS = 240


def month_spine(bounds: DataFrame, key: str) -> DataFrame:
    """Every month from ``first_month`` to ``last_month``; bounds further apart than the limit are an error, null ones give nothing."""
    far = F.months_between("last_month", "first_month") >= MONTHS
    text = F.concat(F.lit(f"more than {MONTHS} months: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    months = F.when(far, F.raise_error(text)).otherwise(F.sequence("first_month", "last_month", F.expr("INTERVAL 1 MONTH")))
    return bounds.select(key, F.explode(months).alias("competence_month"))


def editor_months(lines: DataFrame) -> DataFrame:
    """Per project and month from its first line to its last: the planned amount and the number of lines."""
    bounds = lines.groupBy("project_id").agg(F.min("competence_month").alias("first_month"), F.max("competence_month").alias("last_month"))
    monthly = lines.groupBy("project_id", "competence_month").agg(money(F.sum("amount")).alias("planned_amount"), count_of("*").alias("line_count"))
    return month_spine(bounds, "project_id").join(monthly, ["project_id", "competence_month"], "left").select("project_id", "competence_month", F.coalesce("planned_amount", money(F.lit(0))).alias("planned_amount"), F.coalesce("line_count", F.lit(0)).cast("long").alias("line_count"))


@query("""
, b AS (SELECT project_id, min(competence_month) AS a, max(competence_month) AS z FROM lines GROUP BY 1),
spine AS (SELECT project_id, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS competence_month FROM b),
m AS (SELECT project_id, competence_month, sum(amount) AS x, count(*) AS n FROM lines GROUP BY ALL)
SELECT project_id, competence_month, coalesce(x, 0)::DECIMAL(20,2) AS planned_amount, coalesce(n, 0) AS line_count FROM spine LEFT JOIN m USING (project_id, competence_month)""")
def g5_editor_months(t: Tables) -> DataFrame:
    """Monthly totals of the editor for each project, empty months as zero."""
    return editor_months(t.lines)


@query("""
, b AS (SELECT project_id, min(competence_month) AS a, max(competence_month) AS z FROM lines GROUP BY 1),
spine AS (SELECT project_id, unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS competence_month FROM b),
m AS (SELECT project_id, competence_month, sum(amount) AS x, count(*) AS n FROM lines GROUP BY ALL)
SELECT project_id, competence_month, coalesce(x, 0)::DECIMAL(20,2) AS planned_amount, coalesce(n, 0) AS line_count FROM spine LEFT JOIN m USING (project_id, competence_month)""")
def g5_all_editor_months(t: Tables) -> DataFrame:
    """The same for every project."""
    return editor_months(t.lines)


def summaries(t: Tables) -> DataFrame:
    """Per project and version: contract, posted billing, draft plan and what is left; a foreign currency is an error."""
    own = t.projects.where("not deleted").select(F.col("id").alias("project_id"), "contract_value", "base_currency")
    versions = t.versions.select(F.col("id").alias("plan_version_id"), "status")
    planned = t.lines.groupBy("project_id", "plan_version_id").agg(money(F.sum("amount")).alias("lines_total"), F.collect_set("currency_code").alias("plan_currencies"))
    posted = posted_billing(t).groupBy("project_id").agg(money(F.sum("amount")).alias("posted_total"), F.collect_set("currency_code").alias("posted_currencies"))
    rows = planned.join(own, "project_id").join(versions, "plan_version_id").join(posted, "project_id", "left")
    zero = money(F.lit(0))
    draft = F.when(F.col("status") == "draft", F.col("lines_total")).otherwise(zero)
    odd = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != F.col("base_currency"))
    rows = rows.withColumns({"posted_actual": F.coalesce("posted_total", zero), "planned_draft": draft, "currency_error": odd("plan_currencies") | odd("posted_currencies")})
    return rows.select("project_id", "plan_version_id", "contract_value", "posted_actual", "planned_draft", "currency_error", *[c.alias(n) for n, c in balance(F.col("contract_value"), F.col("posted_actual"), F.col("planned_draft")).items()])


SUMMARY_SQL = """
, pl AS (SELECT project_id, plan_version_id, sum(amount) AS x, list_distinct(list(currency_code)) AS cur FROM lines GROUP BY ALL),
po AS (SELECT project_id, sum(amount) AS y, list_distinct(list(currency_code)) AS cur FROM actuals WHERE metric_type = 'billing_actual' AND status = 'posted' GROUP BY 1),
s AS (
  SELECT pl.project_id, plan_version_id, contract_value, coalesce(y, 0)::DECIMAL(20,2) AS posted_actual, CASE WHEN v.status = 'draft' THEN x ELSE 0 END::DECIMAL(20,2) AS planned_draft,
    len(list_filter(list_concat(pl.cur, coalesce(po.cur, [])), lambda c: c <> base_currency)) > 0 AS currency_error
  FROM pl JOIN projects p ON p.id = pl.project_id JOIN versions v ON v.id = plan_version_id LEFT JOIN po ON po.project_id = pl.project_id WHERE NOT deleted),
bal AS (SELECT *, (contract_value - posted_actual - planned_draft)::DECIMAL(20,2) AS raw_balance FROM s)
"""


@query(SUMMARY_SQL + "SELECT *, greatest(raw_balance, 0)::DECIMAL(20,2) AS distributable, raw_balance < 0 AS has_excess FROM bal")
def g6_financial_summary(t: Tables) -> DataFrame:
    return summaries(t)


@query(SUMMARY_SQL + """
, ch AS (SELECT id, plan_version_id, project_id, amount AS old, round(amount * 1.5, 2)::DECIMAL(20,2) AS new FROM lines WHERE plan_version_id = 0 AND id % 3 = 0),
w AS (SELECT project_id, sum(new - old) AS d, count(*) AS changed FROM ch GROUP BY 1)
SELECT b.project_id, changed AS changed_lines, (planned_draft + d)::DECIMAL(20,2) AS final_planned, (raw_balance - d)::DECIMAL(20,2) AS final_balance, raw_balance - d < 0 AS blocked FROM bal b JOIN w ON w.project_id = b.project_id WHERE plan_version_id = 0""")
def g7_save_what_if(t: Tables) -> DataFrame:
    """The balance after raising every third draft line by half; overdrawn projects are blocked unless overridden."""
    raised = F.round(F.col("amount") * F.lit("1.5").cast("decimal(2,1)"), 2)
    changes = t.lines.where("plan_version_id = 0 and id % 3 = 0").groupBy("project_id").agg(money(F.sum(money(raised) - F.col("amount"))).alias("change"), count_of("*").alias("changed_lines"))
    left = F.col("raw_balance") - F.col("change")
    return summaries(t).where("plan_version_id = 0").join(changes, "project_id").select("project_id", "changed_lines", money(F.col("planned_draft") + F.col("change")).alias("final_planned"), money(left).alias("final_balance"), (left < 0).alias("blocked"))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], value: str = "amount") -> DataFrame:
    """``current`` with the rows of ``incoming`` put in place by key; both have the same columns and unique keys."""
    new = incoming.select(*key, F.col(value).alias("_new"), F.lit(True).alias("_in"))
    joined = current.select(*key, value, F.lit(True).alias("_had")).join(new, key, "full")
    action = F.when(F.col("_in").isNull(), "kept").when(F.col("_had").isNull(), "inserted").when(F.col(value).eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return joined.select(*key, F.when(F.col("_in").isNull(), F.col(value)).otherwise(F.col("_new")).alias(value), action.alias("action"))


@query("""
, cur AS (SELECT project_id, competence_month, sum(amount) AS amount FROM lines WHERE plan_version_id = 3 GROUP BY ALL),
inc AS (SELECT project_id, (competence_month + INTERVAL 1 MONTH)::DATE AS competence_month, sum(amount) AS amount FROM lines WHERE plan_version_id = 3 AND project_id % 2 = 0 GROUP BY ALL)
SELECT project_id, competence_month, CASE WHEN i.amount IS NULL THEN c.amount ELSE i.amount END::DECIMAL(20,2) AS amount,
  CASE WHEN i.amount IS NULL THEN 'kept' WHEN c.amount IS NULL THEN 'inserted' WHEN c.amount = i.amount THEN 'unchanged' ELSE 'updated' END AS action
FROM cur c FULL JOIN inc i USING (project_id, competence_month)""")
def k4_upsert_months(t: Tables) -> DataFrame:
    """Baseline months of even projects written a month later: a merge by key with what it did to each row."""
    key = ["project_id", "competence_month"]
    current = t.lines.where("plan_version_id = 3").groupBy(*key).agg(money(F.sum("amount")).alias("amount"))
    return upsert(current, current.where("project_id % 2 = 0").withColumn("competence_month", F.add_months("competence_month", 1)), key)


@query("""SELECT (id * 100 + 7)::BIGINT AS id, 7::BIGINT AS plan_version_id, project_id, project_item_id, metric_type, planning_level, competence_month, amount, currency_code FROM lines WHERE plan_version_id = 3""")
def k7_reopen_copy(t: Tables) -> DataFrame:
    """The lines that a reopened version starts with: those of its source under new ids."""
    return t.lines.where("plan_version_id = 3").withColumns({"id": F.col("id") * 100 + 7, "plan_version_id": F.lit(7).cast("long")})


@query("""
, up AS (SELECT id, id AS ancestor, 0 AS depth FROM versions UNION ALL SELECT up.id, source_version_id, depth + 1 FROM up JOIN versions v ON v.id = ancestor WHERE source_version_id IS NOT NULL)
SELECT id AS plan_version_id, ancestor AS ancestor_id, depth FROM up""")
def j13_version_lineage(t: Tables) -> DataFrame:
    """Every version with its sources up to the first, by a recursive query."""
    return t.spark.sql(
        """
        WITH RECURSIVE up(id, ancestor, depth) AS (
          SELECT id, id, 0 FROM {versions} UNION ALL
          SELECT up.id, v.source_version_id, depth + 1 FROM up JOIN {versions} v ON v.id = up.ancestor WHERE v.source_version_id IS NOT NULL)
        SELECT id AS plan_version_id, ancestor AS ancestor_id, depth FROM up""",
        versions=t.versions,
    )


@query("""
, d AS (SELECT project_id, plan_version_id, distributable FROM (SELECT *, greatest(raw_balance, 0)::DECIMAL(20,2) AS distributable FROM bal) WHERE plan_version_id = 0),
w AS (SELECT project_id, distributable, unnest([1, 2, 3]) AS slot FROM d),
c AS (SELECT *, CASE slot WHEN 3 THEN 333334 ELSE 333333 END AS weight, (distributable * 100)::BIGINT AS cents FROM w),
f AS (SELECT *, cents * weight // 1000000 AS part FROM c)
SELECT project_id, slot::INT AS slot, ((part + CASE WHEN slot <= cents - sum(part) OVER (PARTITION BY project_id) THEN 1 ELSE 0 END)::DECIMAL(20,0) * 0.01)::DECIMAL(20,2) AS allocated FROM f""".replace(", d AS", SUMMARY_SQL + ", d AS", 1))
def m7_distribute_balance(t: Tables) -> DataFrame:
    """What is left of each draft plan over three slots of 33.3333, 33.3333 and 33.3334 percent, to the cent."""
    left = summaries(t).where("plan_version_id = 0").select("project_id", F.col("distributable").alias("amount"))
    weights = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(w).cast("decimal(7,4)").alias("weight")) for k, w in ((1, "33.3333"), (2, "33.3333"), (3, "33.3334"))]))
    return distribute(left.select("project_id", "amount", weights.alias("w")).select("project_id", "amount", "w.*"), ["project_id"], ["slot"]).select("project_id", "slot", "allocated")


@query("""
, wide AS (SELECT project_item_id, max(CASE WHEN month(competence_month) = 1 THEN canonical_amount END) AS m1, max(CASE WHEN month(competence_month) = 2 THEN canonical_amount END) AS m2, max(CASE WHEN month(competence_month) = 3 THEN canonical_amount END) AS m3 FROM cells GROUP BY 1)
SELECT project_item_id, k::INT AS month_number, a AS amount, CASE WHEN a IS NULL THEN 'blank' WHEN a = 0 THEN 'explicit_zero' ELSE 'value' END AS declaration_state
FROM (SELECT project_item_id, unnest([1, 2, 3]) AS k, unnest([m1, m2, m3]) AS a FROM wide)""")
def e5_unpivot_months(t: Tables) -> DataFrame:
    """A sheet with a column per month back to cells; blank, explicit zero and value stay apart."""
    wide = t.cells.withColumn("k", F.month("competence_month")).groupBy("project_item_id").pivot("k", [1, 2, 3]).agg(F.max("canonical_amount"))
    long = wide.unpivot("project_item_id", ["1", "2", "3"], "month_number", "amount")
    state = F.when(F.col("amount").isNull(), "blank").when(F.col("amount") == 0, "explicit_zero").otherwise("value")
    return long.withColumns({"month_number": F.col("month_number").cast("int"), "declaration_state": state})


@query("""SELECT n AS serial, CASE WHEN n < 60 THEN (DATE '1899-12-31' + n::INT) WHEN n > 60 THEN (DATE '1899-12-30' + n::INT) END AS in_1900, (DATE '1904-01-01' + n::INT) AS in_1904, count(*) AS parts FROM (SELECT p_partkey * 7 AS n FROM part) GROUP BY n""")
def d4_spreadsheet_dates(t: Tables) -> DataFrame:
    """Spreadsheet serials in both date systems."""
    n = (F.col("p_partkey") * 7).alias("serial")
    return t.raw("part").select(n).groupBy("serial").agg(count_of("*").alias("parts")).withColumns({"in_1900": excel_date(F.col("serial")), "in_1904": excel_date(F.col("serial"), True)})
