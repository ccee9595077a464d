"""Text that must compare alike: canonical names, item texts, units, and canonical JSON with its hash."""

from __future__ import annotations

import json
import math
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed format: a project code at the start of a cell.
PROJECT_CODE = r"^\d{4}-\d{2}-\d{5}"


@F.pandas_udf(StringType())
def canonical_name(names: pd.Series) -> pd.Series:
    """NFC, trimmed, inner white space as one space; null stays null, nothing left gives null."""
    return names.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFC", s).split()) or None)


@F.pandas_udf(StringType())
def name_family(names: pd.Series) -> pd.Series:
    """The first word without marks and punctuation, lower case: names that may be one client."""

    def family(name: str | None) -> str | None:
        if name is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.category(c).startswith("M"))
        return next(iter("".join(c if c.isalnum() else " " for c in bare.lower()).split()), None)

    return names.map(family)


@F.pandas_udf(StringType())
def item_text(texts: pd.Series) -> pd.Series:
    """NFC without outer spaces; null if empty or with control or format characters."""

    def clean(text: str | None) -> str | None:
        text = None if text is None else unicodedata.normalize("NFC", text).strip(" ")
        return None if not text or any(unicodedata.category(c) in ("Cc", "Cf") for c in text) else text

    return texts.map(clean)


#: Names of units in sheets.
UNITS = {"un": "UN", "unidade": "UN", "serv": "SERV", "serviço": "SERV", "us": "US", "unidade e serviço": "US"}


def unit_code(cell: Column) -> Column:
    """The unit that a cell names, in any case and with outer spaces; null if it names none."""
    names = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.try_element_at(names, F.lower(F.trim(item_text(cell))))


def project_code(cell: Column) -> Column:
    found = F.regexp_extract(F.trim(cell), PROJECT_CODE, 0)
    return F.when(found != "", found)


def _number(x: float) -> str:
    """A double as ECMAScript writes it: the shortest digits, plain from 1e-6 to below 1e21."""
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if x == 0:
        return "0"
    if 0 < point <= 21:
        plain = text.ljust(point, "0") if point >= len(text) else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        plain = "0." + "0" * -point + text
    else:
        plain = text[0] + ("." + text[1:] if text[1:] else "") + f"e{point - 1:+d}"
    return "-" * sign + plain


def canonical_json(value) -> str:
    """Compact JSON, keys sorted by their UTF-16 units, numbers as the doubles that ECMAScript writes; non-finite ones are refused."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, int | float) and not isinstance(value, bool):
        return _number(float(value))
    return json.dumps(value, ensure_ascii=False)


_sorted = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


class _Unusual(ValueError):
    """A number that JSON's own writer may write in another way."""


def _whole(digits: str) -> int:
    if len(digits) > 15:
        raise _Unusual
    return int(digits)


def _fraction(digits: str):
    raise _Unusual


def canonical_text(text: str) -> str:
    """JSON text in canonical form: by the standard writer where it can't differ, that is for ASCII text whose numbers are short integers."""
    if text.isascii() and "\\u" not in text:
        try:
            return _sorted(json.loads(text, parse_int=_whole, parse_float=_fraction, parse_constant=_fraction))
        except _Unusual:
            pass
    return canonical_json(json.loads(text))


@F.pandas_udf(StringType())
def canonical_json_text(texts: pd.Series) -> pd.Series:
    """JSON text in canonical form; null stays null."""
    return texts.map(lambda s: None if s is None else canonical_text(s))


#: Control characters that Spark writes with capital hex digits and canonical JSON with small ones.
_CAPITALS = [f"{c:04X}" for c in range(32) if f"{c:04X}" != f"{c:04x}"]


def canonical_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON of texts, booleans, nulls, whole numbers of at most 15 digits, and lists and structs of these (a struct's fields sorted by name) by plain name."""
    def small(text: Column) -> Column:
        lower = text
        for code in _CAPITALS:
            lower = F.regexp_replace(lower, rf"((?<!\\)(?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
        return F.when(text.contains("\\u00"), lower).otherwise(text)

    text = F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.element_at(F.transform(F.array(text), small), 1)


def canonical_hash(json_text: Column) -> Column:
    """SHA-256 of the canonical form of JSON text."""
    return F.sha2(canonical_json_text(json_text), 256)


def excel_date(serial: Column, since_1904: bool = False) -> Column:
    """The date of a spreadsheet serial; in the 1900 system serial 60 is no day (null) and earlier ones are one less off."""
    if since_1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), serial.cast("int"))
    day = serial.cast("int")
    return F.when(day < 60, F.date_add(F.lit("1899-12-31").cast("date"), day)).when(day > 60, F.date_add(F.lit("1899-12-30").cast("date"), day))


def calendar_date(text: Column, first_of_month: bool = False) -> Column:
    """The date of text like 2026-02-28; null for any other text, for days that the calendar lacks, and, where asked for, for days after a month's first."""
    good = text.rlike(r"^[0-9]{4}-[0-9]{2}-01\z" if first_of_month else r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return F.when(good, text).try_cast("date")
