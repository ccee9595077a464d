"""The domain tables, as DataFrames over the test tables, and the same mappings as SQL.

Nothing in the test data is a contract portfolio, so orders stand for projects,
line items for project items, plan lines and realized events, regions for plan
versions, and events for snapshots and the audit log.  Doubles become decimals
here and nowhere else.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portfolia.sources.scratch import written

#: Fixed values of the domain.
PROJECT_STATUSES = ["draft", "active", "on_hold", "completed", "cancelled"]
PLAN_STATUSES = ["draft", "pending_approval", "approved", "locked", "archived"]
OFFICIAL = ["approved", "locked"]


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,2)")


def count_of(c: Column | str) -> Column:
    return F.count(c).cast("long")


def pick(n: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values)).cast("int") + 1)


def with_references(rows: DataFrame) -> DataFrame:
    """Rows of observations (observation_id), one for each of the three references that the test tables give them."""
    places = F.array(*[F.struct(F.lit(k).alias("reference_ordinal"), F.lit(kind).alias("kind"), F.lit(sheet).alias("sheet")) for k, kind, sheet in ((1, "source", "Sheet!B"), (2, "source", "Sheet!A"), (3, "database", "ltc_m:"))])
    locator = F.concat("p.sheet", "observation_id")
    return rows.select("*", F.explode(places).alias("p")).select(*rows.columns, "p.reference_ordinal", "p.kind", locator.alias("locator"), F.sha2(locator, 256).alias("fingerprint"))


class Tables:
    """Domain tables by name; any can be replaced by a DataFrame with the same columns."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, **given: DataFrame):
        self.spark, self.sf_dir = spark, sf_dir
        self.__dict__.update(given)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def clients(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") >= 0).alias("active"))

    @cached_property
    def projects(self) -> DataFrame:
        key = F.col("o_orderkey")
        joined = self.raw("orders").join(self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            key.alias("id"), F.concat(F.lit("PRJ-"), F.lpad(key.cast("string"), 9, "0")).alias("project_code"), F.concat(F.lit("Project "), key.cast("string")).alias("project_name"),
            F.col("o_custkey").alias("client_id"), pick(key, PROJECT_STATUSES).alias("status"), F.when(F.col("n_regionkey") == 0, "USD").otherwise("BRL").alias("base_currency"),
            money("o_totalprice").alias("contract_value"), F.col("o_orderdate").cast("date").alias("data_reference_date"), F.col("o_orderdate").alias("updated_at"), (key % 97 == 0).alias("deleted"),
        )

    @cached_property
    def _billed(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
        numbered = self.raw("lineitem").withColumn("line_number", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
        owner = self.projects.select(F.col("id").alias("project_id"), "base_currency")
        return numbered.withColumn("id", F.col("l_orderkey") * 1000 + F.col("line_number")).join(owner, F.col("l_orderkey") == F.col("project_id"))

    @cached_property
    def items(self) -> DataFrame:
        part = self.raw("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
        quantity, price = F.col("l_quantity").cast("decimal(12,4)"), F.col("p_retailprice").cast("decimal(12,4)")
        return self._billed.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            "id", "project_id", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("source_line_key"), "line_number", F.col("p_brand").alias("item_code"),
            F.when(F.col("l_partkey") % 41 != 0, F.col("p_name")).alias("description"), quantity.alias("quantity"), pick(F.col("p_size"), ["UN", "SERV", "US"]).alias("unit_code"), price.alias("unit_price"),
            F.when(F.col("l_suppkey") % 59 == 0, F.when(F.col("base_currency") == "BRL", "USD").otherwise("BRL")).otherwise(F.col("base_currency")).alias("currency_code"),
            money(F.round(quantity * price, 2)).alias("total_amount"), (F.col("l_partkey") % 17 != 0).alias("active"), (F.col("l_partkey") % 89 == 0).alias("deleted"),
        )

    @cached_property
    def units(self) -> DataFrame:
        code = pick(F.col("p_size"), ["UN", "SERV", "US"])
        rows = self.raw("part").groupBy(code.alias("code")).agg(F.max("p_size").alias("greatest"))
        category = F.when(F.col("code") == "SERV", "service")
        return rows.select("code", F.concat(F.lit("Unit "), "code").alias("name"), category.alias("category"), (F.col("code") != "US").alias("active"))

    @cached_property
    def currencies(self) -> DataFrame:
        code = F.col("base_currency").alias("code")
        rows = self.projects.select(code).distinct()
        return rows.select("code", F.concat(F.lit("Currency "), "code").alias("name"), F.lit(2).alias("decimal_places"), (F.col("code") != "USD").alias("active"))

    @cached_property
    def versions(self) -> DataFrame:
        key = F.col("r_regionkey").cast("long")
        return self.raw("region").select(key.alias("id"), F.col("r_name").alias("name"), pick(key, PLAN_STATUSES).alias("status"), (key == 3).alias("is_baseline"), F.when(key > 0, key - 1).alias("source_version_id"))

    @cached_property
    def lines(self) -> DataFrame:
        by_project, version = F.col("l_orderkey") % 11 == 0, F.col("l_orderkey") % 5
        once, again = (F.struct(F.lit(more).cast("long").alias("more"), v.cast("long").alias("version")) for more, v in ((0, version), (10**12, F.lit(3))))
        copies = F.explode(F.when((version == 2) & (F.col("project_id") % 7 == 0), F.array(once, again)).otherwise(F.array(once))).alias("copy")
        return self._billed.select("*", copies).select(
            (F.col("id") + F.col("copy.more")).alias("id"), F.col("copy.version").alias("plan_version_id"), "project_id", F.when(~by_project, F.col("id")).alias("project_item_id"), F.lit("billing_planned").alias("metric_type"),
            F.when(by_project, "project").otherwise("item").alias("planning_level"), F.trunc("l_shipdate", "MM").alias("competence_month"), money("l_extendedprice").alias("amount"), F.col("base_currency").alias("currency_code"),
        )

    @cached_property
    def scopes(self) -> DataFrame:
        return self.lines.select("plan_version_id", "project_id", "metric_type", "planning_level", "currency_code").distinct()

    @cached_property
    def actuals(self) -> DataFrame:
        status = F.when(F.col("l_returnflag") == "R", "cancelled").when(F.col("l_returnflag") == "A", "posted").otherwise("draft")
        return self._billed.select(
            "id", "project_id", F.when(F.col("l_suppkey") % 5 != 0, F.col("id")).alias("project_item_id"), F.when(F.col("l_partkey") % 13 == 0, "receipt_actual").otherwise("billing_actual").alias("metric_type"),
            status.alias("status"), F.col("l_shipdate").cast("date").alias("competence_date"), money("l_extendedprice").alias("amount"), F.when(F.col("l_suppkey") % 53 == 0, "EUR").otherwise(F.col("base_currency")).alias("currency_code"),
        )

    @cached_property
    def cells(self) -> DataFrame:
        planned = self.lines.where("plan_version_id = 3 and project_item_id is not null")
        zero = F.col("id") % 10 == 0
        filled = planned.select("plan_version_id", F.col("id").alias("financial_plan_line_id"), "project_item_id", "competence_month", F.when(zero, "explicit_zero").otherwise("value").alias("declaration_state"), F.when(zero, money(F.lit(0))).otherwise(F.col("amount")).alias("canonical_amount"))
        blank = planned.where("id % 4 = 0").select("plan_version_id", F.lit(None).cast("long").alias("financial_plan_line_id"), "project_item_id", F.add_months("competence_month", 1).alias("competence_month"), F.lit("blank").alias("declaration_state"), F.lit(None).cast("decimal(20,2)").alias("canonical_amount"))
        return filled.unionByName(blank)

    @cached_property
    def snapshots(self) -> DataFrame:
        revision = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), revision.alias("authority_revision"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("success").alias("status"))

    @cached_property
    def project_observations(self) -> DataFrame:
        """What each snapshot saw of its project; some saw it twice."""
        seen = self.snapshots.join(self.projects.select(F.col("id").alias("project_id"), "project_code"), "project_id")
        times = F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 19 == 0, 2).otherwise(1))).alias("occurrence_ordinal")
        return seen.select(F.col("id").alias("snapshot_id"), "project_id", "project_code", times).withColumn("id", F.concat_ws(":", "snapshot_id", "occurrence_ordinal"))

    @cached_property
    def item_observations(self) -> DataFrame:
        """What each snapshot saw of its project's items; some it saw twice, once without an id."""
        code = self.projects.select(F.col("id").alias("project_id"), "project_code")
        seen = self.snapshots.withColumnRenamed("id", "snapshot_id").join(self.items.select("project_id", "source_line_key", F.col("id").alias("item")), "project_id").join(code, "project_id")
        times = F.explode(F.sequence(F.lit(1), F.when((F.col("snapshot_id") + F.col("item")) % 97 == 0, 2).otherwise(1))).alias("occurrence_ordinal")
        item = F.when(F.col("occurrence_ordinal") == 1, F.col("item").cast("string")).alias("item_id")
        return seen.select("snapshot_id", "project_id", "project_code", "source_line_key", "item", times).select("*", item, F.concat_ws(":", "snapshot_id", "item", "occurrence_ordinal").alias("id")).drop("item")

    @cached_property
    def source_references(self) -> DataFrame:
        """References of both kinds of observations, three each: two to the source, not in the order of their text, and one to the database."""
        owners = [getattr(self, f"{kind}_observations").select(F.lit(kind).alias("observed"), F.col("id").alias("observation_id")) for kind in ("project", "item")]
        return with_references(owners[0].unionByName(owners[1])).select("observed", "observation_id", "reference_ordinal", "kind", "locator", "fingerprint")

    def observed(self, kind: str, snapshots: DataFrame) -> DataFrame:
        """What these snapshots (snapshot_id, project_id) saw: ``kind`` is project or item."""
        return getattr(self, f"{kind}_observations").join(snapshots.select("snapshot_id"), "snapshot_id")

    def to_source(self, kind: str, rows: DataFrame) -> DataFrame:
        """Rows of observations (observation_id), one for each reference of theirs to the source; with nulls where there is none."""
        return rows.join(self.source_references.where(F.col("observed") == kind).where("kind = 'source'").drop("observed"), "observation_id", "left")

    @cached_property
    def audit(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("ts").alias("changed_at"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("operation"))


class Dealt(Tables):
    """The test tables with projects, items and billed lines written once, dealt by project: parts of a plan that go by project need no shuffle."""

    @cached_property
    def projects(self) -> DataFrame:
        return written(super().projects, "projects", "id")

    @cached_property
    def _billed(self) -> DataFrame:
        kept = super()._billed.drop("l_orderkey", "l_discount", "l_tax", "l_linestatus")
        return written(kept, "billed", "project_id").withColumn("l_orderkey", F.col("project_id"))

    @cached_property
    def items(self) -> DataFrame:
        return written(super().items, "items", "project_id", 2)


_ORDERED = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
#: The same tables as common table expressions.
SQL = f"""
clients AS (SELECT c_custkey AS id, c_name AS display_name, c_mktsegment AS segment, c_acctbal >= 0 AS active FROM customer),
projects AS (
  SELECT o_orderkey AS id, 'PRJ-' || lpad(o_orderkey::VARCHAR, 9, '0') AS project_code, 'Project ' || o_orderkey AS project_name, o_custkey AS client_id,
    ['draft', 'active', 'on_hold', 'completed', 'cancelled'][(o_orderkey % 5 + 1)::INT] AS status, CASE WHEN n_regionkey = 0 THEN 'USD' ELSE 'BRL' END AS base_currency,
    o_totalprice::DECIMAL(20,2) AS contract_value, o_orderdate::DATE AS data_reference_date, o_orderdate AS updated_at, o_orderkey % 97 = 0 AS deleted
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
billed AS (
  SELECT l.*, l_orderkey * 1000 + line_number AS id, p.id AS project_id, base_currency
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDERED}) AS line_number FROM lineitem) l JOIN projects p ON l_orderkey = p.id),
items AS (
  SELECT b.id, project_id, l_orderkey || ':' || l_linenumber AS source_line_key, line_number, p_brand AS item_code, CASE WHEN l_partkey % 41 <> 0 THEN p_name END AS description,
    l_quantity::DECIMAL(12,4) AS quantity, ['UN', 'SERV', 'US'][(p_size % 3 + 1)::INT] AS unit_code, p_retailprice::DECIMAL(12,4) AS unit_price,
    CASE WHEN l_suppkey % 59 <> 0 THEN base_currency WHEN base_currency = 'BRL' THEN 'USD' ELSE 'BRL' END AS currency_code,
    round(l_quantity::DECIMAL(12,4) * p_retailprice::DECIMAL(12,4), 2)::DECIMAL(20,2) AS total_amount, l_partkey % 17 <> 0 AS active, l_partkey % 89 = 0 AS deleted
  FROM billed b JOIN part ON l_partkey = p_partkey),
units AS (
  SELECT code, 'Unit ' || code AS name, CASE WHEN code = 'SERV' THEN 'service' END AS category, code <> 'US' AS active
  FROM (SELECT DISTINCT ['UN', 'SERV', 'US'][(p_size % 3 + 1)::INT] AS code FROM part)),
currencies AS (SELECT base_currency AS code, 'Currency ' || base_currency AS name, 2 AS decimal_places, base_currency <> 'USD' AS active FROM (SELECT DISTINCT base_currency FROM projects)),
versions AS (
  SELECT r_regionkey::BIGINT AS id, r_name AS name, ['draft', 'pending_approval', 'approved', 'locked', 'archived'][(r_regionkey % 5 + 1)::INT] AS status, r_regionkey = 3 AS is_baseline,
    CASE WHEN r_regionkey > 0 THEN r_regionkey::BIGINT - 1 END AS source_version_id FROM region),
once AS (
  SELECT id, l_orderkey % 5 AS plan_version_id, project_id, CASE WHEN l_orderkey % 11 <> 0 THEN id END AS project_item_id, 'billing_planned' AS metric_type,
    CASE WHEN l_orderkey % 11 = 0 THEN 'project' ELSE 'item' END AS planning_level, date_trunc('month', l_shipdate)::DATE AS competence_month, l_extendedprice::DECIMAL(20,2) AS amount, base_currency AS currency_code FROM billed),
lines AS (SELECT * FROM once UNION ALL SELECT * REPLACE (id + 1000000000000 AS id, 3 AS plan_version_id) FROM once WHERE plan_version_id = 2 AND project_id % 7 = 0),
scopes AS (SELECT DISTINCT plan_version_id, project_id, metric_type, planning_level, currency_code FROM lines),
actuals AS (
  SELECT id, project_id, CASE WHEN l_suppkey % 5 <> 0 THEN id END AS project_item_id, CASE WHEN l_partkey % 13 = 0 THEN 'receipt_actual' ELSE 'billing_actual' END AS metric_type,
    CASE l_returnflag WHEN 'R' THEN 'cancelled' WHEN 'A' THEN 'posted' ELSE 'draft' END AS status, l_shipdate::DATE AS competence_date, l_extendedprice::DECIMAL(20,2) AS amount,
    CASE WHEN l_suppkey % 53 = 0 THEN 'EUR' ELSE base_currency END AS currency_code FROM billed),
cells AS (
  SELECT plan_version_id, id AS financial_plan_line_id, project_item_id, competence_month, CASE WHEN id % 10 = 0 THEN 'explicit_zero' ELSE 'value' END AS declaration_state,
    CASE WHEN id % 10 = 0 THEN 0::DECIMAL(20,2) ELSE amount END AS canonical_amount FROM lines WHERE plan_version_id = 3 AND project_item_id IS NOT NULL
  UNION ALL SELECT plan_version_id, NULL, project_item_id, (competence_month + INTERVAL 1 MONTH)::DATE, 'blank', NULL FROM lines WHERE plan_version_id = 3 AND project_item_id IS NOT NULL AND id % 4 = 0),
snapshots AS (SELECT event_id AS id, user_id AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS authority_revision, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status FROM events),
project_observations AS (
  SELECT s.id AS snapshot_id, project_id, project_code, k AS occurrence_ordinal, s.id || ':' || k AS id FROM snapshots s JOIN projects p ON p.id = project_id, (VALUES (1), (2)) v(k) WHERE k = 1 OR s.id % 19 = 0),
item_observations AS (
  SELECT s.id AS snapshot_id, s.project_id, project_code, source_line_key, k AS occurrence_ordinal, CASE WHEN k = 1 THEN i.id::VARCHAR END AS item_id, s.id || ':' || i.id || ':' || k AS id
  FROM snapshots s JOIN items i ON i.project_id = s.project_id JOIN projects p ON p.id = s.project_id, (VALUES (1), (2)) v(k) WHERE k = 1 OR (s.id + i.id) % 97 = 0),
source_references AS (
  SELECT observed, observation_id, k AS reference_ordinal, kind, sheet || observation_id AS locator, sha256(sheet || observation_id) AS fingerprint
  FROM (SELECT 'project' AS observed, id AS observation_id FROM project_observations UNION ALL SELECT 'item', id FROM item_observations), (VALUES (1, 'source', 'Sheet!B'), (2, 'source', 'Sheet!A'), (3, 'database', 'ltc_m:')) v(k, kind, sheet)),
audit AS (SELECT event_id AS id, ts AS changed_at, user_id AS entity_id, event_type AS operation FROM events)
"""
