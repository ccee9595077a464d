"""Cents and evidence as text, calendar dates, catalogs, unit options and seeds, on small tables and against plain Python."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portfolia.functions.money import cents_text, round_evidence, signed_cents
from portfolia.functions.text import calendar_date
from portfolia.operators import catalog
from portfolia.sources.bindings import Tables

PLAIN = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def mapped(spark, texts, **columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", *[c.alias(n) for n, c in columns.items()])
    return [tuple(r)[1:] for r in rows.orderBy("k").collect()]


def test_cents_of_text(spark):
    texts = ["0", "-0", "-0.5", "12.3", "999999999999999999.99", "-999999999999999999.99", "1000000000000000000", "01", "+1", "1.", ".5", "1.234", "1e2", " 1", "1\n", "", "  ", None]
    got = mapped(spark, texts, cents=signed_cents(F.col("s")), filled=signed_cents(F.col("s"), blank_is_zero=True))
    want = [0, 0, -50, 1230, 99999999999999999999, -99999999999999999999] + [None] * 12
    assert [a for a, _ in got] == want
    assert [b for _, b in got] == want[:15] + [0, 0, None]


@PLAIN
@given(st.lists(st.integers(-(10**20) + 1, 10**20 - 1), min_size=1, max_size=20))
def test_cents_and_back(spark, values):
    rows = spark.createDataFrame([(k, Decimal(v)) for k, v in enumerate(values)], "k int, c decimal(20,0)")
    got = rows.select("k", cents_text(F.col("c")).alias("t"), cents_text(F.col("c"), plus=True).alias("s")).withColumn("back", signed_cents(F.col("t"))).orderBy("k").collect()
    for value, r in zip(values, got, strict=True):
        text = f"{abs(value) // 100}.{abs(value) % 100:02d}"
        assert (r.t, r.s, r.back) == (("-" if value < 0 else "") + text, ("-" if value < 0 else "+") + text, value)


@PLAIN
@given(st.lists(st.tuples(st.integers(0, 10**18 - 1), st.text("0123456789", min_size=0, max_size=9)), min_size=1, max_size=20))
def test_evidence_is_rounded_half_up(spark, parts):
    texts = [f"{a}.{b}" if b else str(a) for a, b in parts]

    def rounded(text, places):
        value = Decimal(text).quantize(Decimal("0.01"), ROUND_HALF_UP)
        return value if places <= 8 and value < 10**18 else None

    assert [x for (x,) in mapped(spark, texts, v=round_evidence(F.col("s")))] == [rounded(t, len(b)) for t, (_, b) in zip(texts, parts, strict=True)]


def test_evidence_of_other_forms_is_null(spark):
    texts = ["-1", "1.", "01", "1e1", "999999999999999999.995", "1000000000000000000", "1\n", "", None]
    assert mapped(spark, texts, v=round_evidence(F.col("s"))) == [(None,)] * len(texts)


def test_calendar_dates(spark):
    texts = ["2026-02-28", "2026-02-30", "2024-02-29", "2100-02-29", "2026-04-31", "2026-13-01", "2026-07-01", "2026-7-1", "2026-07-01T00:00", " 2026-07-01", "2026-07-01\n", "", None]

    def real(text, suffix=""):
        try:
            return dt.date.fromisoformat(text) if len(text) == 10 and text[:4].isdigit() and text.endswith(suffix) else None
        except (TypeError, ValueError):
            return None

    got = mapped(spark, texts, day=calendar_date(F.col("s")), month=calendar_date(F.col("s"), first_of_month=True))
    assert got == [(None, None) if t is None else (real(t), real(t, "-01")) for t in texts]


@pytest.fixture(scope="module")
def shop(spark):
    make = spark.createDataFrame
    items = [(1, 1, "UN", "BRL", False), (2, 1, "OLD", "BRL", False), (3, 1, "GONE", "BRL", True), (4, 2, "NONE", "BRL", False), (5, 3, "OLD", "EUR", False)]
    return Tables(
        spark,
        projects=make([(1, "A", "a", 1, "active", "BRL", Decimal(1), "n", False), (2, "B", "b", 2, "active", "USD", None, None, False), (3, "C", "c", 9, "draft", "XXX", None, None, True)], "id long, project_code string, project_name string, client_id long, status string, base_currency string, contract_value decimal(20,2), notes string, deleted boolean"),
        clients=make([(1, "Um", True), (2, "Dois", False)], "id long, display_name string, active boolean"),
        items=make(items, "id long, project_id long, unit_code string, currency_code string, deleted boolean"),
        units=make([("UN", "Unit", None, True), ("OLD", "Old 100%", "x", False), ("GONE", "Gone", None, False)], "code string, name string, category string, active boolean"),
        currencies=make([("BRL", "Real", True), ("USD", "Dollar", False), ("EUR", "Euro", True)], "code string, name string, active boolean"),
    )


def test_forms(shop):
    got = {r.project_id: (r.client_name, r.client_available, r.currency_available, r.notes) for r in catalog.edit_data(shop).collect()}
    assert got == {1: ("Um", True, True, "n"), 2: ("Dois", False, False, None)}
    assert {tuple(r) for r in catalog.form_options(shop).collect()} == {("currency", "BRL", "Real"), ("client", "1", "Um")}


def test_named_items_and_unit_options(shop):
    assert {(r.project_item_id, r.unit_name, r.unit_available, r.currency_name) for r in catalog.named_items(shop).collect()} == {(1, "Unit", True, "Real"), (2, "Old 100%", False, "Real")}
    assert [tuple(r) for r in catalog.options_of(shop, 1).collect()] == [("UN", "Unit", True), ("OLD", "Old 100%", False)]
    assert [tuple(r) for r in catalog.options_of(shop, 2).collect()] == [("UN", "Unit", True)]


def test_catalogs_by_state_and_text(shop):
    find = lambda *a: {r.code for r in catalog.catalog(shop.units, ["code", "name", "category"], *a).collect()}
    assert (find(), find("active"), find("inactive"), find("all", "0%"), find("all", "%"), find("active", "gone"), find("all", "X")) == ({"UN", "OLD", "GONE"}, {"UN"}, {"OLD", "GONE"}, {"OLD"}, {"OLD"}, set(), {"OLD"})
    with pytest.raises(ValueError, match="state"):
        catalog.catalog(shop.units, ["code"], "closed")


def test_seed_adds_once_and_stops_at_a_difference(spark):
    make = spark.createDataFrame
    seed = make([("BRL", "Real", 2), ("USD", None, 2)], "code string, name string, places int")
    current = make([("EUR", "Euro", 2, True), ("BRL", "Real", 2, False)], "code string, name string, places int, kept boolean")
    once = catalog.seeded(current, seed, ["code"])
    assert {tuple(r) for r in once.collect()} == {("EUR", "Euro", 2, True, False), ("BRL", "Real", 2, False, False), ("USD", None, 2, None, True)}
    again = catalog.seeded(once.drop("seeded"), seed, ["code"])
    assert again.where("seeded").count() == 0 and again.count() == 3
    assert catalog.seeded(current.limit(0), seed, ["code"]).where("seeded").count() == 2
    for row, error in ((("BRL", "Real", 3, True), "SEED_DIVERGES"), (("USD", "Dollar", 2, True), "SEED_DIVERGES")):
        with pytest.raises(Exception, match=error):
            catalog.seeded(make([row], current.schema), seed, ["code"]).collect()
    for rows in ([("BRL", "Real", 2), ("BRL", "Real", 2)], [(None, "Real", 2)]):
        with pytest.raises(Exception, match="SEED_KEY_INVALID"):
            catalog.seeded(current.limit(0), make(rows, seed.schema), ["code"]).collect()
