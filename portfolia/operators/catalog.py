"""Project details and edit data, items with the names of their unit and currency, catalogs by status and search, controlled seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.functions.money import cents_text, round_evidence, signed_cents
from portfolia.functions.text import calendar_date
from portfolia.operators.portfolio import contains
from portfolia.operators.provenance import guarded
from portfolia.plans.registry import query
from portfolia.sources.bindings import Tables, count_of

#: The currencies that a project may be kept in, and a list's states.
PROJECT_CURRENCIES = ["BRL", "USD"]
STATES = ["all", "active", "inactive"]
#: Further fields of a project's edit data, taken where the table of projects has them.
FURTHER = ["reporting_group", "classification", "opening_balance", "budget_cost", "start_date", "end_date", "data_reference_date", "notes", "version"]


def project_details(t: Tables) -> DataFrame:
    """Every live project with its client's name."""
    named = t.clients.select(F.col("id").alias("client_id"), F.col("display_name").alias("client_name"))
    return t.projects.where("not deleted").join(named, "client_id").select(
        F.col("id").alias("project_id"), "project_code", "project_name", "client_name", F.col("status").alias("project_status"), F.col("base_currency").alias("currency_code"),
        "contract_value", "updated_at",
    )


def edit_data(t: Tables) -> DataFrame:
    """What a form for each live project starts with; ``client_available`` and ``currency_available`` say whether its choices may still be made."""
    clients = t.clients.select(F.col("id").alias("client_id"), F.col("display_name").alias("client_name"), F.col("active").alias("client_available"))
    usable = t.currencies.where("active").select(F.col("code").alias("base_currency"), F.lit(True).alias("currency_available"))
    further = [c for c in FURTHER if c in t.projects.columns]
    rows = t.projects.where("not deleted").join(clients, "client_id").join(usable, "base_currency", "left")
    return rows.select(
        F.col("id").alias("project_id"), "project_code", "project_name", "client_id", "client_name", "client_available", F.col("status").alias("project_status"),
        F.col("base_currency").alias("currency_code"), F.coalesce("currency_available", F.lit(False)).alias("currency_available"), "contract_value", *further,
    )


def form_options(t: Tables) -> DataFrame:
    """What a new project may choose: active currencies among those that projects may have, and active clients."""
    currencies = t.currencies.where("active").where(F.col("code").isin(PROJECT_CURRENCIES)).select(F.lit("currency").alias("kind"), F.col("code").alias("key"), "name")
    return currencies.unionByName(t.clients.where("active").select(F.lit("client").alias("kind"), F.col("id").cast("string").alias("key"), F.col("display_name").alias("name")))


def named_items(t: Tables) -> DataFrame:
    """Live items of live projects with the name and availability of their unit and currency; an item whose code is in no catalog is left out."""
    live = t.projects.where("not deleted").select(F.col("id").alias("project_id"))
    units = t.units.select(F.col("code").alias("unit_code"), F.col("name").alias("unit_name"), F.col("active").alias("unit_available"))
    currencies = t.currencies.select(F.col("code").alias("currency_code"), F.col("name").alias("currency_name"), F.col("active").alias("currency_available"))
    rows = t.items.where("not deleted").withColumnRenamed("id", "project_item_id").join(live, "project_id", "left_semi")
    return rows.join(units, "unit_code").join(currencies, "currency_code").drop("deleted")


def unit_options(t: Tables) -> DataFrame:
    """Units that items may be given: active ones, for every project (``project_id`` null), and inactive ones for the projects whose live items have them."""
    nowhere = F.lit(None).cast(t.items.schema["project_id"].dataType).alias("project_id")
    active = t.units.where("active").select(nowhere, "code", "name", "active")
    used = t.items.where("not deleted").select("project_id", F.col("unit_code").alias("code")).distinct()
    return active.unionByName(used.join(t.units.where("not active"), "code").select("project_id", "code", "name", "active"))


def options_of(t: Tables, project_id) -> DataFrame:
    """The same for one project, active units first."""
    mine = F.col("project_id").isNull() | (F.col("project_id") == F.lit(project_id))
    return unit_options(t).where(mine).select("code", "name", "active").orderBy(F.desc("active"), "code")


def catalog(rows: DataFrame, searched: list[str], state: str = "all", text: str | None = None) -> DataFrame:
    """``rows`` of one state whose ``searched`` columns hold ``text`` in any case; a state that isn't known is refused."""
    if state not in STATES:
        raise ValueError(f"state must be one of {', '.join(STATES)}")
    kept = rows if state == "all" else rows.where(F.col("active") if state == "active" else ~F.col("active"))
    return kept.where(contains(text, *searched)) if text else kept


def seeded(current: DataFrame, seed: DataFrame, key: list[str]) -> DataFrame:
    """``current`` with the rows of ``seed`` that its key lacks; ``seeded`` tells which.

    A row that is there but differs in a column of ``seed`` fails the query, and
    so does a key that is null or twice in ``seed``: nothing is seeded then.  Rows
    with other keys and columns that ``seed`` doesn't name stay as they are, new
    rows have null in these.  A second run adds nothing.
    """
    other = [c for c in seed.columns if c not in key]
    wanted = seed.groupBy(*key).agg(count_of("*").alias("_times"), *[F.first(c).alias(f"_{c}") for c in other])
    valid = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key], F.col("_times") == 1)
    there = current.select(*key, *other).join(wanted, key)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in other], F.lit(True))
    missing = seed.join(current.select(*key), key, "left_anti")
    rows = current.withColumn("seeded", F.lit(False)).unionByName(missing.withColumn("seeded", F.lit(True)), allowMissingColumns=True)
    return guarded(guarded(rows, wanted, valid, "SEED_KEY_INVALID"), there, same, "SEED_DIVERGES")


@query("""SELECT p.id AS project_id, project_code, project_name, display_name AS client_name, status AS project_status, base_currency AS currency_code, contract_value, updated_at
FROM projects p JOIN clients c ON c.id = client_id WHERE NOT deleted""")
def g2_project_details(t: Tables) -> DataFrame:
    return project_details(t)


@query("""SELECT p.id AS project_id, project_code, project_name, client_id, display_name AS client_name, c.active AS client_available, status AS project_status, base_currency AS currency_code,
  EXISTS (SELECT 1 FROM currencies k WHERE k.code = base_currency AND k.active) AS currency_available, contract_value, data_reference_date
FROM projects p JOIN clients c ON c.id = client_id WHERE NOT deleted""")
def g2_edit_data(t: Tables) -> DataFrame:
    return edit_data(t)


@query("""SELECT 'currency' AS kind, code AS key, name FROM currencies WHERE active AND code IN ('BRL', 'USD') UNION ALL SELECT 'client', id::VARCHAR, display_name FROM clients WHERE active""")
def g2_form_options(t: Tables) -> DataFrame:
    return form_options(t)


@query("""SELECT i.id AS project_item_id, project_id, source_line_key, line_number, item_code, description, quantity, unit_code, u.name AS unit_name, u.active AS unit_available,
  currency_code, c.name AS currency_name, c.active AS currency_available, unit_price, total_amount, i.active
FROM items i JOIN units u ON u.code = unit_code JOIN currencies c ON c.code = currency_code JOIN projects p ON p.id = project_id WHERE NOT i.deleted AND NOT p.deleted""")
def g3_named_items(t: Tables) -> DataFrame:
    return named_items(t)


@query("""SELECT NULL::BIGINT AS project_id, code, name, active FROM units WHERE active
UNION ALL SELECT DISTINCT project_id, code, name, u.active FROM items JOIN units u ON code = unit_code WHERE NOT deleted AND NOT u.active""")
def g3_unit_options(t: Tables) -> DataFrame:
    return unit_options(t)


@query("""SELECT 'currency' AS catalog, code, name FROM currencies WHERE code IN ('BRL', 'USD') AND NOT active AND (code ILIKE '%u%' OR name ILIKE '%u%')
UNION ALL SELECT 'unit', code, name FROM units WHERE active AND (code ILIKE '%serv%' OR name ILIKE '%serv%' OR category ILIKE '%serv%')""")
def g9_catalogs(t: Tables) -> DataFrame:
    """Inactive currencies and active units found by a search."""
    currencies = catalog(t.currencies.where(F.col("code").isin(PROJECT_CURRENCIES)), ["code", "name"], "inactive", "u")
    units = catalog(t.units, ["code", "name", "category"], "active", "serv")
    parts = [rows.select(F.lit(name).alias("catalog"), "code", "name") for name, rows in (("currency", currencies), ("unit", units))]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT p_partkey AS part_id, p_name AS name, p_type AS kind, p_size % 2 = 1 AS seeded FROM part")
def s12_seeded_parts(t: Tables) -> DataFrame:
    """A catalog of the parts of even size, seeded with all parts: those that are there agree, the others are added."""
    parts = t.raw("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), "p_size")
    return seeded(parts.where("p_size % 2 = 0").drop("p_size"), parts.drop("p_size"), ["part_id"])


@query("""
, x AS (SELECT c_custkey AS client_id, c_acctbal::DECIMAL(15,2)::VARCHAR || CASE WHEN c_custkey % 7 = 0 THEN '1' WHEN c_custkey % 11 = 0 THEN 'e0' ELSE '' END AS amount_text FROM customer),
y AS (SELECT *, CASE WHEN regexp_full_match(amount_text, '-?(0|[1-9][0-9]{0,17})([.][0-9]{1,2})?') THEN (amount_text::DECIMAL(20,2) * 100)::HUGEINT END AS n FROM x),
z AS (SELECT *, (abs(n) // 100)::VARCHAR || '.' || lpad((abs(n) % 100)::VARCHAR, 2, '0') AS digits FROM y)
SELECT client_id, amount_text, n::DECIMAL(20,0) AS cents, CASE WHEN n < 0 THEN '-' ELSE '' END || digits AS back, CASE WHEN n < 0 THEN '-' ELSE '+' END || digits AS signed FROM z""")
def m10_signed_cents(t: Tables) -> DataFrame:
    """Balances of clients as text to cents and back; text of another form gives null."""
    key = F.col("c_custkey")
    odd = F.when(key % 7 == 0, "1").when(key % 11 == 0, "e0").otherwise("")
    rows = t.raw("customer").select(key.alias("client_id"), F.concat(F.col("c_acctbal").cast("decimal(15,2)").cast("string"), odd).alias("amount_text"))
    rows = rows.withColumn("cents", signed_cents(F.col("amount_text")))
    return rows.withColumns({"back": cents_text(F.col("cents")), "signed": cents_text(F.col("cents"), plus=True)})


@query("""
, x AS (SELECT id AS project_item_id, (l_extendedprice::DECIMAL(15,2) * l_tax::DECIMAL(4,2) * l_discount::DECIMAL(4,2))::VARCHAR || CASE WHEN id % 5 = 0 THEN '005' WHEN id % 3 = 0 THEN '50' ELSE '' END AS amount_text FROM billed)
SELECT project_item_id, amount_text, CASE WHEN id_ok THEN round(amount_text::DECIMAL(30,8), 2)::DECIMAL(20,2) END AS amount
FROM (SELECT *, regexp_full_match(amount_text, '(0|[1-9][0-9]{0,17})([.][0-9]{1,8})?') AS id_ok FROM x)""")
def m6_round_evidence(t: Tables) -> DataFrame:
    """Products of six places, some written with more: rounded half up to cents, null beyond eight places."""
    price, rates = F.col("l_extendedprice").cast("decimal(15,2)"), [F.col(c).cast("decimal(4,2)") for c in ("l_tax", "l_discount")]
    more = F.when(F.col("id") % 5 == 0, "005").when(F.col("id") % 3 == 0, "50").otherwise("")
    text = F.concat((price * rates[0] * rates[1]).cast("decimal(23,6)").cast("string"), more)
    return t._billed.select(F.col("id").alias("project_item_id"), text.alias("amount_text")).withColumn("amount", round_evidence(F.col("amount_text")))


@query("""
, x AS (SELECT id AS project_id, strftime(data_reference_date, '%Y-%m-') || lpad((day(data_reference_date) + 3)::VARCHAR, 2, '0') AS day_text FROM projects)
SELECT project_id, day_text, TRY_CAST(day_text AS DATE) AS day, CASE WHEN day_text LIKE '%-01' THEN TRY_CAST(day_text AS DATE) END AS month FROM x""")
def d6_calendar_days(t: Tables) -> DataFrame:
    """Dates three days on, written by adding to the day alone: those past the end of their month are no dates."""
    day = F.col("data_reference_date")
    text = F.concat(F.date_format(day, "yyyy-MM-"), F.lpad((F.dayofmonth(day) + 3).cast("string"), 2, "0"))
    rows = t.projects.select(F.col("id").alias("project_id"), text.alias("day_text"))
    return rows.withColumns({"day": calendar_date(F.col("day_text")), "month": calendar_date(F.col("day_text"), first_of_month=True)})
