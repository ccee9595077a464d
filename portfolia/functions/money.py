"""Exact money: text to decimals, cents, derived totals and the distribution of a balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed formats: decimal text of up to 14 places; a sign only before zero.
DECIMAL_TEXT = r"^(0|[1-9][0-9]*)(\.[0-9]{1,14})?$"
SIGNED_ZERO = r"^[+-]0(\.0{1,14})?$"


def canonical_money(text: Column) -> Column:
    """Decimal text rounded half up to cents; null unless it follows the format and has 18 whole digits at most."""
    plain = F.when(text.rlike(DECIMAL_TEXT), text).when(text.rlike(SIGNED_ZERO), F.lit("0"))
    short = F.when(F.length(F.split_part(plain, F.lit("."), F.lit(1))) <= 18, plain)
    rounded = F.round(short.cast("decimal(32,14)"), 2)
    return F.when(rounded < F.lit("1000000000000000000").cast("decimal(32,2)"), rounded).cast("decimal(20,2)")


def scaled_decimal(text: Column, places: int, allow_zero: bool) -> Column:
    """Unsigned decimal text of at most ``places`` places; null if it has more, an exponent or leading zeros."""
    good = text.rlike(rf"^(0|[1-9][0-9]{{0,13}})(\.[0-9]{{1,{places}}})?$")
    value = F.when(good, text).cast(f"decimal({14 + places},{places})")
    return value if allow_zero else F.when(value > 0, value)


def round_evidence(text: Column) -> Column:
    """Unsigned decimal text of at most 18 whole digits and eight places, rounded half up to cents; null for any other text, or if rounding needs a 19th digit."""
    good = text.rlike(r"^(0|[1-9][0-9]{0,17})(\.[0-9]{1,8})?\z")
    rounded = F.round(F.when(good, text).cast("decimal(26,8)"), 2)
    return F.when(rounded < F.lit("1000000000000000000").cast("decimal(22,2)"), rounded).cast("decimal(20,2)")


def signed_cents(text: Column, blank_is_zero: bool = False) -> Column:
    """Whole cents of decimal text of at most two places, with a minus or none; null for any other text, blank text zero where asked for."""
    good = text.rlike(r"^-?(0|[1-9][0-9]{0,17})(\.[0-9]{1,2})?\z")
    cents = (F.when(good, text).cast("decimal(20,2)") * 100).cast("decimal(20,0)")
    return F.when(text.rlike(r"(?U)^\s*\z"), F.lit(0).cast("decimal(20,0)")).otherwise(cents) if blank_is_zero else cents


def cents_text(cents: Column, plus: bool = False) -> Column:
    """Whole cents as decimal text of two places; ``plus`` signs what isn't negative too."""
    sign = F.when(cents < 0, "-").otherwise("+" if plus else "")
    return F.concat(sign, (F.abs(cents).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(22,2)").cast("string"))


def derived_total(quantity: Column, price: Column) -> Column:
    """Quantity times price, rounded once: operands of 18 digits keep all 8 places of the product."""
    return F.round(quantity.cast("decimal(18,4)") * price.cast("decimal(18,4)"), 2).cast("decimal(20,2)")


def balance(contract: Column, actual: Column, planned: Column) -> dict[str, Column]:
    """What is left of a contract: as it is, what can be distributed, and whether it is overdrawn."""
    raw = (contract - actual - planned).cast("decimal(20,2)")
    return {"raw_balance": raw, "distributable": F.greatest(raw, F.lit(0).cast("decimal(20,2)")), "has_excess": raw < 0}


def distribute(targets: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Split ``amount`` of each group over its rows by ``weight`` (percent, four places) to the cent.

    Each row gets its share in whole cents, rounded down; the cents left go one
    each to the first rows in ``order``.  A group whose weights are not positive
    or don't add up to exactly 100 gets null, and so does one with repeated
    destinations.
    """
    group, ranked = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*order)
    cents = (F.col("amount") * 100).cast("decimal(20,0)")
    share = F.floor(cents.cast("decimal(20,0)") * (F.col("weight") * 10000).cast("decimal(8,0)") / F.lit(1000000)).cast("decimal(20,0)")
    marked = targets.withColumns({"_share": share, "_rank": F.row_number().over(ranked), "_times": F.count("*").over(Window.partitionBy(*by, *order))})
    good = (F.sum("weight").over(group) == 100) & (F.min("weight").over(group) > 0) & (F.max("_times").over(group) == 1)
    extra = (F.col("_rank") <= cents - F.sum("_share").over(group)).cast("int")
    return marked.withColumn("allocated", F.when(good, (F.col("_share") + extra) / 100).cast("decimal(20,2)")).drop("_share", "_rank", "_times")
