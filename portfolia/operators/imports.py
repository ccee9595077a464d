"""Imports: candidates from source rows, ambiguous clients, what to do with each, ordered plans and their hashes.

Each step is a function of DataFrames, so that it serves any source; the queries
bind them to rows made from the domain tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portfolia.functions.money import derived_total
from portfolia.functions.text import canonical_name, name_family, project_code, unit_code
from portfolia.plans.registry import query
from portfolia.sources.bindings import Tables, count_of, money

#: Actions of an import, and what each diagnostic of a project means for it.
ACTIONS = ["insert", "no_op", "conflict", "rejected", "pending_decision"]
DIAGNOSTIC_KINDS = {
    "PROJECT_CODE_INVALID": "rejection",
    "PROJECT_DUPLICATE_CONFLICT": "conflict",
    "PROJECT_CLIENT_UNRESOLVED": "rejection",
    "PROJECT_CURRENCY_UNRESOLVED": "rejection",
    "PROJECT_VALUE_CONFLICT": "rejection",
    "PROJECT_CLASSIFICATION_CONFLICT": "rejection",
    "PROJECT_DATA_REFERENCE_DATE_MISSING": "pending",
    "PROTECTED_RECORD_CONFLICT": "conflict",
    "RECEIPT_FORECAST_PRESENT_IN_MONTHLY_SOURCE": "informational",
}
#: Fixed format: what a client cell may end in.
CLASSIFICATION = r"(?i)\s+\((demanda|saldo|contrato)\)\s*$"
#: Leading characters of a natural key that are ranked together; the number of such prefixes bounds the table of offsets.
PREFIX = 7


def flags(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, in order of their names."""
    return F.array_compact(F.array(*[F.when(F.coalesce(tests[name], F.lit(False)), F.lit(name)) for name in sorted(tests)]))


def has_kind(kind: str) -> Column:
    codes = [code for code, k in DIAGNOSTIC_KINDS.items() if k == kind]
    return F.exists("diagnostics", lambda d: d.isin(codes))


def _once(t: Tables) -> DataFrame:
    n, c = F.col("id"), F.col("client_id") % 40
    label = F.concat(F.lit("  "), (n % 10 + 2015).cast("string"), F.lit("-"), F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((n % 100000).cast("string"), 5, "0"), F.lit(" Project"))
    tail = F.when(n % 5 == 0, " (Demanda)").when(n % 5 == 1, "  (saldo) ").when(n % 5 == 2, " (contrato)").otherwise("")
    client = F.concat(F.lit("C"), c.cast("string"), F.when((c % 4 == 0) & (F.col("client_id") % 3 == 0), "  Ltda").otherwise("  SA"), tail)
    return t.projects.select(
        n.alias("row_id"), F.when(n % 23 == 0, "sem código").otherwise(label).alias("code_cell"), client.alias("client_cell"), F.col("base_currency").alias("currency_cell"), F.col("contract_value").alias("value_cell"),
        F.when(n % 8 != 3, F.col("data_reference_date")).alias("reference_date"),
    )


def source_rows(t: Tables) -> DataFrame:
    """Rows as a sheet has them: code, client with its class, currency, value and date; some projects stand on two rows."""
    first, n = _once(t), F.col("row_id")
    again = first.where("row_id % 15 = 2").withColumns({"currency_cell": F.when(n % 45 == 2, "EUR").otherwise(F.col("currency_cell")), "value_cell": money(F.when(n % 30 == 2, F.col("value_cell") + 1).otherwise(F.col("value_cell")))})
    return first.unionByName(again)


ROWS_SQL = """
, first_rows AS (
  SELECT id AS row_id, CASE WHEN id % 23 <> 0 THEN (id % 10 + 2015) || '-' || lpad((id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((id % 100000)::VARCHAR, 5, '0') END AS code, 'C' || (client_id % 40) || CASE WHEN client_id % 40 % 4 = 0 AND client_id % 3 = 0 THEN ' Ltda' ELSE ' SA' END AS client_name,
    CASE id % 5 WHEN 0 THEN 'demanda' WHEN 1 THEN 'saldo' WHEN 2 THEN 'contrato' END AS class, base_currency AS currency, contract_value AS value, CASE WHEN id % 8 <> 3 THEN data_reference_date END AS reference_date FROM projects),
src AS (SELECT * FROM first_rows UNION ALL SELECT * REPLACE (CASE WHEN row_id % 45 = 2 THEN 'EUR' ELSE currency END AS currency, (value + CASE WHEN row_id % 30 = 2 THEN 1 ELSE 0 END)::DECIMAL(20,2) AS value) FROM first_rows WHERE row_id % 15 = 2),
clients_c AS (SELECT lower(client_name) AS match_key, count(*) AS source_rows FROM src GROUP BY 1),
fam AS (SELECT split_part(match_key, ' ', 1) AS family, count(*) AS n FROM clients_c GROUP BY 1),
client_plan AS (SELECT match_key, family, source_rows, n - 1 AS possible_matches, CASE WHEN n > 1 THEN 'conflict' WHEN family = 'c' || (substr(family, 2)::INT // 5 * 5 + 1) THEN 'no_op' ELSE 'insert' END AS action FROM clients_c JOIN fam ON family = split_part(match_key, ' ', 1)),
have AS (SELECT code, count(*) AS n, min(currency) AS currency, min(value) AS value FROM (SELECT code, currency, CASE WHEN row_id % 16 = 5 THEN value + 1 ELSE value END::DECIMAL(20,2) AS value FROM first_rows WHERE row_id % 3 <> 0 AND code IS NOT NULL UNION ALL SELECT code, currency, value FROM first_rows WHERE row_id % 29 = 1 AND code IS NOT NULL) GROUP BY 1),
cand AS (SELECT code, count(*) AS source_rows, count(DISTINCT lower(client_name)) AS nc, count(DISTINCT currency) AS ncur, count(DISTINCT value) AS nv, count(DISTINCT class) AS ncl, bool_or(reference_date IS NULL) AS undated, min(lower(client_name)) AS match_key, min(currency) AS currency, min(value) AS value, min(class) AS class FROM src WHERE code IS NOT NULL GROUP BY 1),
judged AS (
  SELECT cand.*, list_filter([CASE WHEN ncl > 1 THEN 'PROJECT_CLASSIFICATION_CONFLICT' END, CASE WHEN nc <> 1 THEN 'PROJECT_CLIENT_UNRESOLVED' END, CASE WHEN ncur <> 1 THEN 'PROJECT_CURRENCY_UNRESOLVED' END, CASE WHEN undated THEN 'PROJECT_DATA_REFERENCE_DATE_MISSING' END,
    CASE WHEN h.n > 1 THEN 'PROJECT_DUPLICATE_CONFLICT' END, CASE WHEN nv <> 1 THEN 'PROJECT_VALUE_CONFLICT' END, CASE WHEN h.n = 1 AND nc = 1 AND ncur = 1 AND nv = 1 AND ncl <= 1 AND (h.currency <> cand.currency OR h.value <> cand.value) THEN 'PROTECTED_RECORD_CONFLICT' END], lambda x: x IS NOT NULL) AS diagnostics, h.n AS existing
  FROM cand LEFT JOIN have h USING (code)),
project_plan AS (
  SELECT code AS project_code, source_rows, CASE WHEN nc = 1 THEN match_key END AS match_key, CASE WHEN ncl = 0 THEN 'full_contract' WHEN ncl > 1 THEN NULL WHEN class = 'demanda' THEN 'demand' WHEN class = 'saldo' THEN 'opening_balance' ELSE 'full_contract' END AS classification, array_to_string(diagnostics, ',') AS diagnostic_codes,
    CASE WHEN list_has_any(diagnostics, ['PROJECT_DUPLICATE_CONFLICT', 'PROTECTED_RECORD_CONFLICT']) THEN 'conflict' WHEN nc <> 1 OR ncur <> 1 OR nv <> 1 OR ncl > 1 THEN 'rejected' WHEN undated THEN 'pending_decision' WHEN existing = 1 THEN 'no_op' ELSE 'insert' END AS action FROM judged)
"""


def parsed(rows: DataFrame) -> DataFrame:
    """Source rows with code (null if malformed), canonical client name and match key, and class."""
    name = canonical_name(F.regexp_replace("client_cell", CLASSIFICATION, ""))
    kind = F.lower(F.regexp_extract("client_cell", CLASSIFICATION, 1))
    return rows.select("row_id", project_code(F.col("code_cell")).alias("project_code"), F.lower(name).alias("match_key"), F.when(kind != "", kind).alias("class"), F.col("currency_cell").alias("currency"), F.col("value_cell").alias("value"), "reference_date")


def client_candidates(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per match key; names that share their first word with others are in conflict and never merged.

    ``existing`` has the match_key of each client there is.
    """
    keys = rows.where("match_key is not null").groupBy("match_key").agg(count_of("*").alias("source_rows")).withColumn("family", F.coalesce(name_family("match_key"), "match_key"))
    families = keys.groupBy("family").agg((count_of("*") - 1).alias("possible_matches"))
    known = existing.select("match_key").distinct().withColumn("known", F.lit(True))
    action = F.when(F.col("possible_matches") > 0, "conflict").when(F.col("known"), "no_op").otherwise("insert")
    return keys.join(families, "family").join(known, "match_key", "left").select("match_key", "family", "source_rows", "possible_matches", action.alias("action"))


def project_candidates(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per project code with its diagnostics and action; rows without a code are ``invalid_rows``.

    ``existing`` has project_code, currency and value of live projects.
    Conflicts come before rejections, those before open decisions.
    """
    one = lambda c: F.countDistinct(c)
    facts = rows.where("project_code is not null").groupBy("project_code").agg(
        count_of("*").alias("source_rows"), one("match_key").alias("clients"), one("currency").alias("currencies"), one("value").alias("values"), one("class").alias("classes"), F.bool_or(F.col("reference_date").isNull()).alias("undated"),
        F.min("match_key").alias("match_key"), F.min("currency").alias("currency"), F.min("value").alias("value"), F.min("class").alias("class"),
    )
    there = existing.groupBy("project_code").agg(count_of("*").alias("existing"), F.struct(F.min("currency").alias("currency"), F.min("value").alias("value")).alias("have"))
    mapped = (F.col("clients") == 1) & (F.col("currencies") == 1) & (F.col("values") == 1) & (F.col("classes") <= 1)
    tests = {
        "PROJECT_CLIENT_UNRESOLVED": F.col("clients") != 1, "PROJECT_CURRENCY_UNRESOLVED": F.col("currencies") != 1, "PROJECT_VALUE_CONFLICT": F.col("values") != 1, "PROJECT_CLASSIFICATION_CONFLICT": F.col("classes") > 1,
        "PROJECT_DATA_REFERENCE_DATE_MISSING": F.col("undated"), "PROJECT_DUPLICATE_CONFLICT": F.col("existing") > 1,
        "PROTECTED_RECORD_CONFLICT": (F.col("existing") == 1) & mapped & (F.col("have") != F.struct("currency", "value")),
    }
    judged = facts.join(there, "project_code", "left").withColumn("diagnostics", flags(tests))
    action = F.when(has_kind("conflict"), "conflict").when(has_kind("rejection"), "rejected").when(has_kind("pending"), "pending_decision").when(F.col("existing") == 1, "no_op").otherwise("insert")
    classification = F.when(F.col("classes") > 1, None).when(F.col("class") == "demanda", "demand").when(F.col("class") == "saldo", "opening_balance").otherwise("full_contract")
    return judged.select("project_code", "source_rows", F.when(F.col("clients") == 1, F.col("match_key")).alias("match_key"), classification.alias("classification"), "diagnostics", action.alias("action"))


def invalid_rows(rows: DataFrame) -> DataFrame:
    return rows.where("project_code is null").select("row_id", F.lit("PROJECT_CODE_INVALID").alias("diagnostic"))


def _clients(t: Tables) -> DataFrame:
    known = t.spark.range(0, 40, 5).select(F.concat(F.lit("c"), (F.col("id") + 1).cast("string"), F.lit(" sa")).alias("match_key"))
    return client_candidates(parsed(source_rows(t)), known)


def _projects(t: Tables) -> DataFrame:
    rows = parsed(source_rows(t)).where("project_code is not null")
    first = parsed(_once(t)).where("project_code is not null")
    value = money(F.when(F.col("row_id") % 16 == 5, F.col("value") + 1).otherwise(F.col("value")))
    existing = first.where("row_id % 3 <> 0").withColumn("value", value).unionByName(first.where("row_id % 29 = 1"))
    return project_candidates(rows, existing)


@query(ROWS_SQL + "SELECT project_code, source_rows, match_key, classification, diagnostic_codes, action FROM project_plan")
def e9_project_candidates(t: Tables) -> DataFrame:
    """Projects of the source by code, what is wrong with them, and what an import would do."""
    return _projects(t).withColumn("diagnostic_codes", F.array_join("diagnostics", ",")).drop("diagnostics")


@query(ROWS_SQL + "SELECT match_key, family, source_rows, possible_matches, action FROM client_plan")
def e10_client_candidates(t: Tables) -> DataFrame:
    return _clients(t)


@query(ROWS_SQL + """, k(code, kind) AS (VALUES {}),
d AS (SELECT unnest(diagnostics) AS code FROM judged UNION ALL SELECT 'PROJECT_CODE_INVALID' FROM src WHERE code IS NULL)
SELECT k.code AS diagnostic, k.kind, count(d.code) AS occurrences FROM k LEFT JOIN d USING (code) GROUP BY ALL""".format(", ".join(f"('{c}', '{k}')" for c, k in DIAGNOSTIC_KINDS.items())))
def e12_diagnostic_counts(t: Tables) -> DataFrame:
    """Each known diagnostic with its kind and how often the source has it, zero included."""
    found = _projects(t).select(F.explode("diagnostics").alias("diagnostic")).unionByName(invalid_rows(parsed(source_rows(t))).select("diagnostic"))
    known = t.spark.createDataFrame(list(DIAGNOSTIC_KINDS.items()), "diagnostic string, kind string")
    counted = found.groupBy("diagnostic").agg(count_of("*").alias("n"))
    return known.join(counted, "diagnostic", "left").select("diagnostic", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("occurrences"))


def ordered(operations: DataFrame, rank: str, key: str) -> DataFrame:
    """``plan_order`` from 1 in the order of rank and key, without sorting all rows in one task.

    Rows are numbered within a prefix of their key; what stands before a prefix
    is a sum over the table of prefixes.  Equal keys of a rank are not allowed.
    """
    cut = operations.withColumn("_prefix", F.substring(key, 1, PREFIX))
    sizes = cut.groupBy(rank, "_prefix").agg(count_of("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(rank, "_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(rank, "_prefix", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(rank, "_prefix").orderBy(key)) + F.col("_before")
    return cut.join(offsets, [rank, "_prefix"]).withColumn("plan_order", place.cast("long")).drop("_prefix", "_before")


def import_plan(clients: DataFrame, projects: DataFrame, batch: str) -> DataFrame:
    """Batch, then clients, then projects, each with what it depends on and whether it may run."""
    status = F.when(F.col("action").isin("insert", "no_op"), "planned").when(F.col("action").isin("conflict", "rejected") & (F.col("entity") == "project"), "blocked").otherwise("requires_review")
    row = lambda rows, rank, entity, key, needs, action: rows.select(F.lit(rank).alias("entity_rank"), F.lit(entity).alias("entity"), key.alias("natural_key"), needs.cast("string").alias("dependencies"), action.alias("action"))
    head = row(clients.sparkSession.range(1), 1, "import_batch", F.lit(batch), F.lit(""), F.lit("insert"))
    second = row(clients, 2, "client", F.col("match_key"), F.lit(""), F.col("action"))
    third = row(projects, 3, "project", F.col("project_code"), F.concat_ws(",", "match_key", F.lit(batch)), F.col("action"))
    return ordered(head.unionByName(second).unionByName(third), "entity_rank", "natural_key").drop("entity_rank").withColumn("status", status)


_PLAN_SQL = """, ops AS (
  SELECT 1 AS r, 'import_batch' AS entity, 'batch-1' AS natural_key, '' AS dependencies, 'insert' AS action UNION ALL SELECT 2, 'client', match_key, '', action FROM client_plan
  UNION ALL SELECT 3, 'project', project_code, coalesce(match_key || ',', '') || 'batch-1', action FROM project_plan)
"""


@query(ROWS_SQL + _PLAN_SQL + """SELECT entity, natural_key, dependencies, action, row_number() OVER (ORDER BY r, natural_key) AS plan_order,
  CASE WHEN action IN ('insert', 'no_op') THEN 'planned' WHEN entity = 'project' AND action IN ('conflict', 'rejected') THEN 'blocked' ELSE 'requires_review' END AS status FROM ops""")
def e15_import_plan(t: Tables) -> DataFrame:
    return import_plan(_clients(t), _projects(t), "batch-1")


@query(ROWS_SQL + _PLAN_SQL + """SELECT entity, a AS action, count(ops.action) AS operations FROM (VALUES ('import_batch'), ('client'), ('project')) e(entity), (VALUES ('insert'), ('no_op'), ('conflict'), ('rejected'), ('pending_decision')) v(a)
LEFT JOIN ops ON ops.entity = e.entity AND ops.action = a GROUP BY e.entity, a""".replace("SELECT entity, a", "SELECT e.entity, a"))
def e15_action_counts(t: Tables) -> DataFrame:
    """Operations by entity and action, with zero for those that don't occur."""
    known = t.spark.createDataFrame([(e, a) for e in ("import_batch", "client", "project") for a in ACTIONS], "entity string, action string")
    counted = import_plan(_clients(t), _projects(t), "batch-1").groupBy("entity", "action").agg(count_of("*").alias("n"))
    return known.join(counted, ["entity", "action"], "left").select("entity", "action", F.coalesce("n", F.lit(0)).cast("long").alias("operations"))


def lineage(references: DataFrame, batches: DataFrame) -> DataFrame:
    """Whether a project's batch is the one batch of its id and the one batch of its key and hash.

    ``references``: project_id, batch_id, idempotency_key, source_hash;
    ``batches``: id, idempotency_key, source_hash.
    """
    by_id = batches.groupBy(F.col("id").alias("batch_id")).agg(count_of("*").alias("of_id"))
    by_key = batches.groupBy("idempotency_key", "source_hash").agg(count_of("*").alias("of_key"), F.min("id").alias("named"))
    joined = references.join(by_id, "batch_id", "left").join(by_key, ["idempotency_key", "source_hash"], "left")
    none = F.lit(0).cast("long")
    same = (F.col("of_id") == 1) & (F.col("of_key") == 1) & (F.col("named") == F.col("batch_id"))
    return joined.select("project_id", "batch_id", F.coalesce("of_id", none).alias("batches_of_id"), F.coalesce("of_key", none).alias("batches_of_key"), F.coalesce(same, F.lit(False)).alias("equivalent"))


@query("""
, ba AS (SELECT s_suppkey AS id, 'batch-' || (CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey - 1 ELSE s_suppkey END) AS idempotency_key, sha256('batch-' || (CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey - 1 ELSE s_suppkey END)) AS source_hash FROM supplier),
re AS (SELECT id AS project_id, CASE WHEN id % 7 = 0 THEN id % 100 + 2 ELSE id % 100 + 1 END AS batch_id, 'batch-' || (id % 100 + 1) AS idempotency_key FROM projects),
i AS (SELECT id, count(*) AS n FROM ba GROUP BY 1), k AS (SELECT idempotency_key, count(*) AS n, min(id) AS named FROM ba GROUP BY idempotency_key, source_hash)
SELECT project_id, batch_id, coalesce(i.n, 0) AS batches_of_id, coalesce(k.n, 0) AS batches_of_key, coalesce(i.n = 1 AND k.n = 1 AND named = batch_id, false) AS equivalent FROM re LEFT JOIN i ON i.id = batch_id LEFT JOIN k ON k.idempotency_key = re.idempotency_key""")
def e13_lineage_match(t: Tables) -> DataFrame:
    """Projects against import batches by id and by key with hash."""
    name = lambda n: F.concat(F.lit("batch-"), n.cast("string"))
    key = F.col("s_suppkey")
    batches = t.raw("supplier").select(key.alias("id"), name(F.when(key % 10 == 0, key - 1).otherwise(key)).alias("idempotency_key"))
    n = F.col("id") % 100 + 1
    references = t.projects.select(F.col("id").alias("project_id"), F.when(F.col("id") % 7 == 0, n + 1).otherwise(n).alias("batch_id"), name(n).alias("idempotency_key"))
    hashed = lambda rows: rows.withColumn("source_hash", F.sha2("idempotency_key", 256))
    return lineage(hashed(references), hashed(batches))


#: What a candidate and an existing item must agree in.
FACTS = ["project_id", "source_line_key", "line_number", "item_code", "description", "quantity", "unit_code", "currency_code", "unit_price", "total_amount"]


def item_candidates(rows: DataFrame, existing: DataFrame, projects: DataFrame, units: list[str], currencies: list[str]) -> DataFrame:
    """Diagnostics, target and action of each item row.

    ``rows``: id, FACTS but with ``unit_cell`` and ``evidence`` for unit and total;
    ``existing``: id, FACTS, active, deleted; ``projects``: project_id, project_action.
    A row's target is the existing item of its source line, else of its line
    number; if these are two items, or several, it is in conflict.
    """
    facts = rows.withColumns({"unit_code": unit_code(F.col("unit_cell")), "total_amount": derived_total(F.col("quantity"), F.col("unit_price"))}).join(projects, "project_id", "left")
    target = lambda key, name: existing.where(F.col(key).isNotNull()).groupBy("project_id", key).agg(count_of("*").alias(f"{name}_n"), F.min("id").alias(f"{name}_id"))
    facts = facts.join(target("source_line_key", "key"), ["project_id", "source_line_key"], "left").join(target("line_number", "line"), ["project_id", "line_number"], "left")
    crossed = F.coalesce((F.col("key_n") > 1) | (F.col("line_n") > 1) | (F.col("key_id") != F.col("line_id")), F.lit(False))
    held = existing.select(F.col("id").alias("target_id"), F.struct(*FACTS).alias("have"), (F.col("active") & ~F.col("deleted")).alias("live"))
    facts = facts.withColumns({"crossed": crossed, "target_id": F.coalesce("key_id", "line_id")}).join(held, "target_id", "left")
    here, own = F.col("project_action").isin("insert", "no_op"), F.col("project_action")
    same = F.struct(*FACTS).eqNullSafe(F.col("have")) & F.col("live")
    open_item = here & ~F.col("crossed") & F.col("target_id").isNotNull()
    tests = {
        "DESCRIPTION_MISSING": F.col("description").isNull(), "UNIT_UNRESOLVED": F.col("unit_code").isNull(), "TOTAL_EVIDENCE_MISMATCH": F.col("evidence") != F.col("total_amount"),
        "UNIT_CATALOG_UNAVAILABLE": ~F.col("unit_code").isin(units), "CURRENCY_CATALOG_UNAVAILABLE": ~F.col("currency_code").isin(currencies), "CROSSED_TARGETS": F.col("crossed"), "PROJECT_UNRESOLVED": own.isNull(), "ITEM_CONFLICT": open_item & ~same,
    }
    judged = facts.withColumn("diagnostics", flags(tests))
    any_of = lambda *codes: F.arrays_overlap("diagnostics", F.array(*map(F.lit, codes)))
    action = (
        F.when(any_of("DESCRIPTION_MISSING", "UNIT_UNRESOLVED", "TOTAL_EVIDENCE_MISMATCH", "PROJECT_UNRESOLVED"), "rejected")
        .when(any_of("UNIT_CATALOG_UNAVAILABLE", "CURRENCY_CATALOG_UNAVAILABLE") & here, "pending_decision")
        .when(~here, own)
        .when(any_of("CROSSED_TARGETS", "ITEM_CONFLICT"), "conflict")
        .when(F.col("target_id").isNotNull(), "no_op")
        .otherwise("insert")
    )
    return judged.select("id", *FACTS, F.when(~F.col("crossed"), F.col("target_id")).alias("target_id"), F.array_join("diagnostics", ",").alias("diagnostic_codes"), action.alias("action"))


ITEMS_SQL = """
, un(cell, unit) AS (VALUES ('un', 'UN'), ('unidade', 'UN'), ('serv', 'SERV'), ('serviço', 'SERV'), ('us', 'US'), ('unidade e serviço', 'US')),
ir AS (SELECT i.* EXCLUDE (unit_code, total_amount), [' Unidade ', 'SERV', 'us', 'serviço', 'un', 'kg'][(CASE WHEN id % 13 = 0 THEN 6 ELSE id % 5 + 1 END)::INT] AS unit_cell, CASE WHEN id % 19 = 0 THEN total_amount + 1 ELSE total_amount END::DECIMAL(20,2) AS evidence, total_amount FROM items i WHERE NOT deleted),
ex AS (SELECT i.* EXCLUDE (unit_code, line_number, quantity), CASE id % 5 WHEN 0 THEN 'UN' WHEN 1 THEN 'SERV' WHEN 2 THEN 'US' WHEN 3 THEN 'SERV' ELSE 'UN' END AS unit_code, CASE WHEN id % 31 = 0 THEN line_number + 1 ELSE line_number END AS line_number, CASE WHEN id % 9 = 0 THEN quantity + 1 ELSE quantity END AS quantity FROM items i WHERE id % 4 <> 0),
pa AS (SELECT id AS project_id, CASE project_id_mod WHEN 0 THEN 'insert' WHEN 1 THEN 'conflict' WHEN 2 THEN 'rejected' WHEN 3 THEN 'pending_decision' ELSE 'no_op' END AS pact FROM (SELECT id, id % 8 AS project_id_mod FROM projects)),
kt AS (SELECT project_id, source_line_key, count(*) AS n, min(id) AS tid FROM ex GROUP BY ALL), lt AS (SELECT project_id, line_number, count(*) AS n, min(id) AS tid FROM ex GROUP BY ALL),
ic AS (
  SELECT ir.*, un.unit AS unit_code, pact, coalesce(kt.tid, lt.tid) AS tid, coalesce(kt.n > 1, false) OR coalesce(lt.n > 1, false) OR coalesce(kt.tid <> lt.tid, false) AS crossed
  FROM ir LEFT JOIN un ON cell = lower(trim(unit_cell)) LEFT JOIN pa ON pa.project_id = ir.project_id LEFT JOIN kt ON kt.project_id = ir.project_id AND kt.source_line_key = ir.source_line_key LEFT JOIN lt ON lt.project_id = ir.project_id AND lt.line_number = ir.line_number),
ie AS (
  SELECT ic.*, ic.pact IN ('insert', 'no_op') AS here, ex.id IS NOT NULL AND ex.source_line_key = ic.source_line_key AND ex.line_number = ic.line_number AND ex.item_code = ic.item_code AND ex.description IS NOT DISTINCT FROM ic.description AND ex.quantity = ic.quantity
    AND ex.unit_code IS NOT DISTINCT FROM ic.unit_code AND ex.currency_code = ic.currency_code AND ex.unit_price = ic.unit_price AND ex.total_amount = ic.total_amount AND ex.active AND NOT ex.deleted AS same FROM ic LEFT JOIN ex ON ex.id = tid),
ia AS (
  SELECT id, project_id, source_line_key, line_number, item_code, description, quantity, unit_code, currency_code, unit_price, total_amount, CASE WHEN NOT crossed THEN tid END AS target_id,
    array_to_string(list_filter([CASE WHEN crossed THEN 'CROSSED_TARGETS' END, CASE WHEN currency_code NOT IN ('BRL') THEN 'CURRENCY_CATALOG_UNAVAILABLE' END, CASE WHEN description IS NULL THEN 'DESCRIPTION_MISSING' END, CASE WHEN here AND NOT crossed AND tid IS NOT NULL AND NOT same THEN 'ITEM_CONFLICT' END,
      CASE WHEN evidence <> total_amount THEN 'TOTAL_EVIDENCE_MISMATCH' END, CASE WHEN unit_code NOT IN ('UN', 'SERV') THEN 'UNIT_CATALOG_UNAVAILABLE' END, CASE WHEN unit_code IS NULL THEN 'UNIT_UNRESOLVED' END], lambda x: x IS NOT NULL), ',') AS diagnostic_codes,
    CASE WHEN description IS NULL OR unit_code IS NULL OR evidence <> total_amount THEN 'rejected' WHEN here AND (unit_code = 'US' OR currency_code <> 'BRL') THEN 'pending_decision' WHEN NOT here THEN pact WHEN crossed OR (tid IS NOT NULL AND NOT same) THEN 'conflict' WHEN tid IS NOT NULL THEN 'no_op' ELSE 'insert' END AS action FROM ie)
"""


def _items(t: Tables) -> DataFrame:
    n = F.col("id")
    cells = F.array(*map(F.lit, [" Unidade ", "SERV", "us", "serviço", "un"]))
    rows = t.items.where("not deleted").withColumns({"unit_cell": F.when(n % 13 == 0, "kg").otherwise(F.element_at(cells, (n % 5).cast("int") + 1)), "evidence": money(F.when(n % 19 == 0, F.col("total_amount") + 1).otherwise(F.col("total_amount")))})
    units = F.array(*map(F.lit, ["UN", "SERV", "US", "SERV", "UN"]))
    existing = t.items.where("id % 4 <> 0").withColumns({
        "unit_code": F.element_at(units, (n % 5).cast("int") + 1), "line_number": F.when(n % 31 == 0, F.col("line_number") + 1).otherwise(F.col("line_number")), "quantity": F.when(n % 9 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).cast("decimal(12,4)"),
    })
    k = n % 8
    projects = t.projects.select(n.alias("project_id"), F.when(k == 0, "insert").when(k == 1, "conflict").when(k == 2, "rejected").when(k == 3, "pending_decision").otherwise("no_op").alias("project_action"))
    return item_candidates(rows, existing, projects, ["UN", "SERV"], ["BRL"])


@query(ITEMS_SQL + "SELECT id, project_id, unit_code, total_amount, target_id, diagnostic_codes, action FROM ia")
def e16_item_candidates(t: Tables) -> DataFrame:
    """Items of a source against those there are: field by field, by source line and by line number."""
    return _items(t).select("id", "project_id", "unit_code", "total_amount", "target_id", "diagnostic_codes", "action")


def plan_hashes(items: DataFrame) -> DataFrame:
    """Per project: inserts, no-ops and the hash of its plan; the order of rows has no part in it.

    The hashes of operations are hashed in groups of their first three digits
    first, so that a project with most of the items has no long list anywhere.
    """
    text = F.concat_ws("|", "action", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ["id", *FACTS, "target_id"]])
    operations = items.where("action in ('insert', 'no_op')").select("project_id", "action", F.sha2(text, 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "|"), 256)
    counts = {a: F.count_if(F.col("action") == a).cast("long").alias(f"{a}s") for a in ("insert", "no_op")}
    groups = operations.groupBy("project_id", F.substring("h", 1, 3).alias("prefix")).agg(joined("h").alias("g"), *counts.values())
    return groups.groupBy("project_id").agg(F.sum("inserts").alias("inserts"), F.sum("no_ops").alias("no_ops"), joined("g").alias("plan_hash"))


@query(ITEMS_SQL + """, o AS (SELECT project_id, action, sha256(concat_ws('|', action, id, project_id, source_line_key, line_number, item_code, coalesce(description, ''), quantity, coalesce(unit_code, ''), currency_code, unit_price, total_amount, coalesce(target_id::VARCHAR, ''))) AS h FROM ia WHERE action IN ('insert', 'no_op')),
g AS (SELECT project_id, h[1:3] AS prefix, sha256(string_agg(h, '|' ORDER BY h)) AS g, count(*) FILTER (action = 'insert') AS i, count(*) FILTER (action = 'no_op') AS n FROM o GROUP BY 1, 2)
SELECT project_id, sum(i)::BIGINT AS inserts, sum(n)::BIGINT AS no_ops, sha256(string_agg(g, '|' ORDER BY g)) AS plan_hash FROM g GROUP BY 1""")
def e18_plan_hashes(t: Tables) -> DataFrame:
    return plan_hashes(_items(t))


@query(ITEMS_SQL + """, o AS (SELECT project_id, coalesce(target_id, id) AS item_id, CASE WHEN target_id IS NULL THEN 1 ELSE 2 END AS row_version FROM ia WHERE action IN ('insert', 'no_op'))
SELECT o.project_id, project_code, count(*) AS items, '[' || string_agg('{"item_id":' || item_id || ',"row_version":' || row_version || '}', ',' ORDER BY item_id, row_version) || ']' AS items_json FROM o JOIN projects p ON p.id = o.project_id GROUP BY ALL""")
def s8_nested_snapshot(t: Tables) -> DataFrame:
    """A nested JSON snapshot of each project that an import has items for, items in order."""
    named = t.projects.select(F.col("id").alias("project_id"), "project_code")
    item = F.struct(F.coalesce("target_id", "id").alias("item_id"), F.when(F.col("target_id").isNull(), 1).otherwise(2).alias("row_version"))
    nested = _items(t).where("action in ('insert', 'no_op')").groupBy("project_id").agg(count_of("*").alias("items"), F.to_json(F.array_sort(F.collect_list(item))).alias("items_json"))
    return nested.join(named, "project_id").select("project_id", "project_code", "items", "items_json")


def nested(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Per project: its rows as one JSON list, ordered by ``columns``; nulls are kept."""
    return rows.groupBy("project_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns))), {"ignoreNullFields": "false"}).alias(name))


_SNAPSHOT_SQL = """
, si AS (SELECT project_id, '[' || string_agg('{"source_line_key":"' || source_line_key || '","id":' || id || ',"line_number":' || line_number || ',"active":' || active || ',"deleted":' || deleted || '}', ',' ORDER BY source_line_key, id) || ']' AS items_json FROM items GROUP BY 1),
ss AS (SELECT project_id, '[' || string_agg('{"metric_type":"' || metric_type || '","planning_level":"' || planning_level || '","currency_code":"' || currency_code || '"}', ',' ORDER BY metric_type, planning_level, currency_code) || ']' AS scopes_json FROM scopes WHERE plan_version_id = 3 GROUP BY 1),
sc AS (SELECT project_id, '[' || string_agg('{"project_item_id":' || project_item_id || ',"competence_month":"' || competence_month || '","declaration_state":"' || declaration_state || '","canonical_amount":' || coalesce('"' || canonical_amount || '"', 'null') || ',"financial_plan_line_id":' || coalesce(financial_plan_line_id::VARCHAR, 'null') || '}', ',' ORDER BY project_item_id, competence_month) || ']' AS cells_json FROM cells c JOIN items i ON i.id = project_item_id GROUP BY 1),
sl AS (SELECT project_id, '[' || string_agg('{"id":' || id || ',"project_item_id":' || coalesce(project_item_id::VARCHAR, 'null') || ',"competence_month":"' || competence_month || '","amount":"' || amount || '","currency_code":"' || currency_code || '"}', ',' ORDER BY id) || ']' AS lines_json FROM lines WHERE plan_version_id = 3 GROUP BY 1)
SELECT p.id AS project_id, project_code, p.status, deleted, v.id AS plan_version_id, v.status AS plan_version_status, is_baseline, coalesce(items_json, '[]') AS items_json, coalesce(scopes_json, '[]') AS scopes_json, coalesce(cells_json, '[]') AS cells_json, coalesce(lines_json, '[]') AS lines_json
FROM projects p LEFT JOIN versions v ON v.id = 3 LEFT JOIN si ON si.project_id = p.id LEFT JOIN ss ON ss.project_id = p.id LEFT JOIN sc ON sc.project_id = p.id LEFT JOIN sl ON sl.project_id = p.id"""


@query(_SNAPSHOT_SQL)
def s8_all_nested_snapshots(t: Tables) -> DataFrame:
    """A nested JSON snapshot of every project against the baseline version: items, scopes, cells and plan lines in order."""
    rows = t.projects.select(F.col("id").alias("project_id"), "project_code", "status", "deleted")
    target = t.versions.where("id = 3").select(F.col("id").alias("plan_version_id"), F.col("status").alias("plan_version_status"), "is_baseline")
    owner = t.items.select(F.col("id").alias("project_item_id"), "project_id")
    text = lambda c: F.col(c).cast("string").alias(c)
    lines = t.lines.where("plan_version_id = 3").select("project_id", "id", "project_item_id", text("competence_month"), text("amount"), "currency_code")
    cells = t.cells.join(owner, "project_item_id").select("project_id", "project_item_id", text("competence_month"), "declaration_state", text("canonical_amount"), "financial_plan_line_id")
    relations = {
        "items_json": nested(t.items, "items_json", "source_line_key", "id", "line_number", "active", "deleted"),
        "scopes_json": nested(t.scopes.where("plan_version_id = 3"), "scopes_json", "metric_type", "planning_level", "currency_code"),
        "cells_json": nested(cells, "cells_json", *cells.columns[1:]),
        "lines_json": nested(lines, "lines_json", *lines.columns[1:]),
    }
    rows = rows.join(F.broadcast(target), F.lit(True), "left")  # one row
    for side in relations.values():
        rows = rows.join(side, "project_id", "left")
    return rows.select(*[c for c in rows.columns if c not in relations], *[F.coalesce(c, F.lit("[]")).alias(c) for c in relations])


def realized_facts(actuals: DataFrame, projects: DataFrame) -> DataFrame:
    """Realized totals at the two grains a source states them in; neither can become an event, and none is allocated.

    A total by project has no month, one by month has no project.  Projects
    without posted billing are blank positions and give no fact.
    """
    total = actuals.where("metric_type = 'billing_actual' and status = 'posted'")
    by_project = projects.select(F.col("id").alias("project_id"), "project_code").join(total, "project_id").groupBy("project_code", "currency_code").agg(money(F.sum("amount")).alias("amount"))
    by_month = total.groupBy(F.trunc("competence_date", "MM").alias("competence_month"), "currency_code").agg(money(F.sum("amount")).alias("amount"))
    shape = ["authoritative_grain", "position", "currency_code", "amount", "migratability_status", "reason_code"]
    first = by_project.select(F.lit("project_aggregate").alias(shape[0]), F.col("project_code").alias("position"), "currency_code", "amount", F.lit("NON_MIGRATABLE_MISSING_COMPETENCE").alias(shape[4]), F.lit("PROJECT_AGGREGATE_HAS_NO_AUTHORITATIVE_COMPETENCE").alias(shape[5]))
    second = by_month.select(F.lit("portfolio_month").alias(shape[0]), F.col("competence_month").cast("string").alias("position"), "currency_code", "amount", F.lit("NON_MIGRATABLE_INSUFFICIENT_GRAIN").alias(shape[4]), F.lit("PORTFOLIO_MONTH_HAS_NO_AUTHORITATIVE_PROJECT").alias(shape[5]))
    state = F.when(F.col("amount") == 0, "explicit_zero").otherwise("value")
    return first.unionByName(second).withColumns({"declaration_state": state, "source_key": F.sha2(F.concat_ws("|", "authoritative_grain", "position", "currency_code"), 256)})


REALIZED_SQL = """
, po AS (SELECT * FROM actuals WHERE metric_type = 'billing_actual' AND status = 'posted'),
rf AS (
  SELECT 'project_aggregate' AS authoritative_grain, project_code AS position, currency_code, sum(amount)::DECIMAL(20,2) AS amount, 'NON_MIGRATABLE_MISSING_COMPETENCE' AS migratability_status, 'PROJECT_AGGREGATE_HAS_NO_AUTHORITATIVE_COMPETENCE' AS reason_code FROM po JOIN projects p ON p.id = project_id GROUP BY ALL
  UNION ALL SELECT 'portfolio_month', date_trunc('month', competence_date)::DATE::VARCHAR, currency_code, sum(amount)::DECIMAL(20,2), 'NON_MIGRATABLE_INSUFFICIENT_GRAIN', 'PORTFOLIO_MONTH_HAS_NO_AUTHORITATIVE_PROJECT' FROM po GROUP BY ALL)
"""


@query(REALIZED_SQL + "SELECT *, CASE WHEN amount = 0 THEN 'explicit_zero' ELSE 'value' END AS declaration_state, sha256(authoritative_grain || '|' || position || '|' || currency_code) AS source_key FROM rf")
def e8_realized_facts(t: Tables) -> DataFrame:
    return realized_facts(t.actuals, t.projects)


@query(REALIZED_SQL + """SELECT currency_code, sum(amount) FILTER (authoritative_grain = 'project_aggregate')::DECIMAL(20,2) AS project_total, sum(amount) FILTER (authoritative_grain = 'portfolio_month')::DECIMAL(20,2) AS month_total,
  count(*) FILTER (authoritative_grain = 'project_aggregate') AS project_positions, count(*) FILTER (authoritative_grain = 'portfolio_month') AS month_positions, project_total = month_total AS reconciled FROM rf GROUP BY 1""")
def e7_realized_gate(t: Tables) -> DataFrame:
    """Whether the two grains of a realized source add up to the same total, exactly, by currency."""
    facts = realized_facts(t.actuals, t.projects)
    of = lambda g: F.col("authoritative_grain") == g
    sums = {n: money(F.sum(F.when(of(g), F.col("amount")))).alias(n) for n, g in (("project_total", "project_aggregate"), ("month_total", "portfolio_month"))}
    return facts.groupBy("currency_code").agg(*sums.values(), F.count_if(of("project_aggregate")).cast("long").alias("project_positions"), F.count_if(of("portfolio_month")).cast("long").alias("month_positions")).withColumn("reconciled", F.col("project_total") == F.col("month_total"))


def raw_cells(t: Tables) -> DataFrame:
    """The baseline's cells with the long decimals that a sheet stores."""
    fraction = ((F.col("project_item_id") % 9 - 4) * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(32,14)")
    return t.cells.withColumn("raw_amount", (F.col("canonical_amount").cast("decimal(31,14)") + F.when(F.col("declaration_state") == "value", fraction).otherwise(fraction * 0)).cast("decimal(32,14)"))


def reconcile_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells by state, their sum in cents, the rounded sum of the raw decimals, and what rounding each one adds."""
    states = {"blank_count": "blank", "explicit_zero_count": "explicit_zero", "non_zero_count": "value"}
    counts = [F.count_if(F.col("declaration_state") == s).cast("long").alias(n) for n, s in states.items()]
    zero = money(F.lit(0))
    cents = F.coalesce(money(F.sum(F.round("raw_amount", 2))), zero)
    whole = F.coalesce(money(F.round(F.sum("raw_amount"), 2)), zero)
    return cells.groupBy(*by).agg(count_of("*").alias("position_count"), *counts, cents.alias("canonical_total"), whole.alias("source_raw_rounded_total")).withColumn("rounding_residual", money(F.col("canonical_total") - F.col("source_raw_rounded_total")))


CELLS_SQL = """
, rc AS (SELECT c.*, (canonical_amount::DECIMAL(31,14) + CASE WHEN declaration_state = 'value' THEN (project_item_id % 9 - 4)::DECIMAL(4,0) * 0.001::DECIMAL(4,3) ELSE 0 END)::DECIMAL(32,14) AS raw_amount FROM cells c)
"""
_CELL_SUMS = """count(*) AS position_count, count(*) FILTER (declaration_state = 'blank') AS blank_count, count(*) FILTER (declaration_state = 'explicit_zero') AS explicit_zero_count, count(*) FILTER (declaration_state = 'value') AS non_zero_count,
  coalesce(sum(round(raw_amount, 2)), 0)::DECIMAL(20,2) AS canonical_total, coalesce(round(sum(raw_amount), 2), 0)::DECIMAL(20,2) AS source_raw_rounded_total, (canonical_total - source_raw_rounded_total)::DECIMAL(20,2) AS rounding_residual"""


@query(CELLS_SQL + f"SELECT project_id, {_CELL_SUMS} FROM rc JOIN items i ON i.id = project_item_id GROUP BY 1")
def e19_baseline_projects(t: Tables) -> DataFrame:
    """The baseline's cells reconciled by project."""
    owner = t.items.select(F.col("id").alias("project_item_id"), "project_id")
    return reconcile_cells(raw_cells(t).join(owner, "project_item_id"), ["project_id"])


@query(CELLS_SQL + f"""SELECT *, CASE WHEN declared_total IS NULL THEN 'MONTH_TOTAL_CACHE' WHEN declared_total <> source_raw_rounded_total THEN 'AGGREGATE_RECONCILIATION' END AS diagnostic FROM (
SELECT competence_month, {_CELL_SUMS}, CASE month(competence_month) WHEN 2 THEN NULL WHEN 6 THEN source_raw_rounded_total + 0.01 ELSE source_raw_rounded_total END::DECIMAL(20,2) AS declared_total FROM rc GROUP BY 1)""")
def e6_monthly_gate(t: Tables) -> DataFrame:
    """Each month's cells against the total that the sheet declares (made wrong in June, missing in February)."""
    sums = reconcile_cells(raw_cells(t), ["competence_month"])
    month, total = F.month("competence_month"), F.col("source_raw_rounded_total")
    declared = F.when(month == 6, total + F.lit("0.01").cast("decimal(3,2)")).when(month != 2, total)
    problem = F.when(F.col("declared_total").isNull(), "MONTH_TOTAL_CACHE").when(F.col("declared_total") != total, "AGGREGATE_RECONCILIATION")
    return sums.withColumn("declared_total", money(declared)).withColumn("diagnostic", problem)


def baseline_status(planned: DataFrame, existing: DataFrame, by: str, key: list[str]) -> DataFrame:
    """Per group: ``ready`` without existing lines, ``no_op_candidate`` if all are equal, else ``conflict``."""
    sides = [rows.select(by, *key, F.col("amount").alias(name)) for rows, name in ((planned, "new"), (existing, "old"))]
    joined = sides[0].join(sides[1], [by, *key], "full")
    counted = joined.groupBy(by).agg(F.count("new").alias("planned_lines"), F.count("old").alias("existing_lines"), F.count_if(~F.col("new").eqNullSafe(F.col("old"))).alias("differing_lines"))
    status = F.when(F.col("existing_lines") == 0, "ready").when(F.col("differing_lines") == 0, "no_op_candidate").otherwise("conflict")
    return counted.select(by, *[F.col(c).cast("long") for c in ("planned_lines", "existing_lines", "differing_lines")], status.alias("status"))


@query("""
, ne AS (SELECT project_id, project_item_id, competence_month, amount AS new FROM lines WHERE plan_version_id = 3 AND planning_level = 'item'),
ol AS (SELECT project_id, project_item_id, competence_month, CASE WHEN project_id % 5 = 0 AND project_item_id % 2 = 0 THEN new + 1 ELSE new END::DECIMAL(20,2) AS old FROM ne WHERE project_id % 3 <> 0),
b AS (SELECT project_id, count(new) AS planned_lines, count(old) AS existing_lines, count(*) FILTER (new IS DISTINCT FROM old) AS differing_lines FROM ne FULL JOIN ol USING (project_id, project_item_id, competence_month) GROUP BY 1)
SELECT *, CASE WHEN existing_lines = 0 THEN 'ready' WHEN differing_lines = 0 THEN 'no_op_candidate' ELSE 'conflict' END AS status FROM b""")
def r6_baseline_status(t: Tables) -> DataFrame:
    """Planned baseline lines of each project against those already stored, at full grain."""
    planned = t.lines.where("plan_version_id = 3 and planning_level = 'item'")
    changed = (F.col("project_id") % 5 == 0) & (F.col("project_item_id") % 2 == 0)
    existing = planned.where("project_id % 3 <> 0").withColumn("amount", money(F.when(changed, F.col("amount") + 1).otherwise(F.col("amount"))))
    return baseline_status(planned, existing, "project_id", ["project_item_id", "competence_month"])


def resolve(candidates: DataFrame, reviewed: DataFrame, hashes: list[str]) -> DataFrame:
    """Candidates with the action that a reviewer decided, where the decision was made on the very same state.

    A decision counts if every one of ``hashes`` is equal; a stale one changes
    nothing and is reported, and several for one candidate are not applied.
    """
    decided = reviewed.groupBy("candidate_id").agg(count_of("*").alias("_n"), F.min(F.struct("decision", *hashes)).alias("_r"))
    equal = reduce(lambda a, b: a & b, [F.col(h).eqNullSafe(F.col(f"_r.{h}")) for h in hashes])
    state = F.when(F.col("_n").isNull(), "undecided").when(F.col("_n") > 1, "ambiguous").when(equal, "applied").otherwise("stale")
    joined = candidates.join(decided, "candidate_id", "left").withColumn("resolution", state)
    return joined.withColumn("action", F.when(F.col("resolution") == "applied", F.col("_r.decision")).otherwise(F.col("action"))).drop("_n", "_r")


@query(ROWS_SQL + """, c AS (SELECT project_code, action, sha256(project_code || '|' || diagnostic_codes) AS h, substr(project_code, 9)::INT AS n FROM project_plan)
SELECT project_code AS candidate_id, CASE WHEN n % 4 = 1 AND n % 20 <> 1 AND n % 12 <> 9 THEN 'insert' ELSE action END AS action, CASE WHEN n % 4 <> 1 THEN 'undecided' WHEN n % 20 = 1 THEN 'ambiguous' WHEN n % 12 = 9 THEN 'stale' ELSE 'applied' END AS resolution FROM c""")
def e14_reviewed_resolutions(t: Tables) -> DataFrame:
    """Decisions of a reviewer laid over the candidates of an import, bound to their state by a hash."""
    text = F.concat_ws("|", "project_code", F.array_join("diagnostics", ","))
    candidates = _projects(t).select(F.col("project_code").alias("candidate_id"), "action", F.sha2(text, 256).alias("state_hash"))
    n = F.substring("candidate_id", 9, 5).cast("int")
    stale = F.when(n % 12 == 9, F.lit("old")).otherwise(F.col("state_hash"))
    once = candidates.where(n % 4 == 1).select("candidate_id", F.lit("insert").alias("decision"), stale.alias("state_hash"))
    return resolve(candidates, once.unionByName(once.where(n % 20 == 1)), ["state_hash"]).drop("state_hash")
