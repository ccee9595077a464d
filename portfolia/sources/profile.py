"""Certified sources: files bound to their hash, workbooks checked against a declared profile, JSON snapshots.

A profile is data, so one check serves any workbook: sheets it must have, text
of header cells, ranges whose formulas must hold a cached result, and cells of
which one is the sum of others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portfolia.functions.money import canonical_money

_SHAPE = "path string, severity string, code string, sheet string, address string, detail string"


@dataclass(frozen=True)
class Profile:
    """``headers``: (sheet, address, text); ``formulas``: (sheet, address); ``totals``: (sheet, address of the total, its column, first row, last row)."""

    sheets: list[str]
    headers: list[tuple[str, str, str]] = field(default_factory=list)
    formulas: list[tuple[str, str]] = field(default_factory=list)
    totals: list[tuple[str, str, int, int, int]] = field(default_factory=list)


def certified_files(spark: SparkSession, path: str, sha256: dict[str, str]) -> DataFrame:
    """name, length, sha256 and ``problem`` of each file under ``path``; ``sha256`` has the hash that each name must have.

    ``unlisted`` files have no hash to compare with, ``hash_mismatch`` ones
    another, and ``missing`` ones are listed but not there.
    """
    name = F.element_at(F.split("path", "/"), -1)
    there = spark.read.format("binaryFile").load(path).select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    listed = spark.createDataFrame(list(sha256.items()), "name string, wanted string")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "unlisted").when(F.lower("wanted") != F.col("sha256"), "hash_mismatch")
    return there.join(listed, "name", "full").select("name", "length", "sha256", problem.alias("problem"))


def diagnostics(cells: DataFrame, profile: Profile, strict: bool = False) -> DataFrame:
    """What is wrong with each workbook of ``cells`` (rows of ``workbook_cells``), in a fixed order.

    A sheet that the profile does not name is a warning unless ``strict``; all
    else is an error.  A total must equal the sum of its column's rows to the
    cent, each cell in canonical form; cells that are no amounts count zero.
    """
    spark = cells.sparkSession
    books = cells.select("path").distinct()
    good = cells.where("problem is null")
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    row = lambda rows, code, severity="error", sheet="sheet", address="address", detail=None: rows.select("path", F.lit(severity).alias("severity"), F.lit(code).alias("code"), *[(F.lit(None) if c is None else F.col(c)).cast("string").alias(n) for n, c in (("sheet", sheet), ("address", address), ("detail", detail))])
    readable = books.join(cells.where("problem is not null").select("path"), "path", "left_anti")
    wanted = lambda rows, schema: readable.crossJoin(F.broadcast(make(rows, schema)))  # noqa: E731 - a profile has as many rows as one workbook's layout
    sheets = good.select("path", "sheet").distinct()
    named = make([(s,) for s in profile.sheets], "sheet string")
    parts = [
        row(cells.where("problem is not null"), "WORKBOOK_UNREADABLE", sheet=None, address=None, detail="problem"),
        row(wanted([(s,) for s in profile.sheets], "sheet string").join(sheets, ["path", "sheet"], "left_anti"), "SHEET_MISSING", address=None),
        row(sheets.join(named, "sheet", "left_anti"), "SHEET_UNEXPECTED", "error" if strict else "warning", address=None),
        row(good.where("state = 'formula' and value is null"), "FORMULA_WITHOUT_RESULT", "error" if strict else "warning", detail="formula"),
        row(good.where("data_type = 'e'"), "CELL_ERROR", detail="value"),
    ]
    held = good.select("path", "sheet", "address", "value", "state")
    if profile.headers:
        heads = wanted(profile.headers, "sheet string, address string, text string").join(held, ["path", "sheet", "address"], "left")
        parts.append(row(heads.where("not (text <=> value)"), "HEADER_MISMATCH", detail="value"))
    if profile.formulas:
        needed = wanted(profile.formulas, "sheet string, address string").join(held, ["path", "sheet", "address"], "left")
        parts.append(row(needed.where("not (state <=> 'formula') or value is null"), "FORMULA_EXPECTED", detail="value"))
    if profile.totals:
        totals = make(profile.totals, "sheet string, total_address string, total_column int, first_row int, last_row int")
        amounts = good.join(F.broadcast(totals), "sheet").where("column_number = total_column and row_number between first_row and last_row")
        sums = amounts.groupBy("path", "sheet", "total_address").agg(F.sum(F.coalesce(canonical_money(F.col("value")), F.lit(0).cast("decimal(20,2)"))).alias("sum"))
        said = wanted(profile.totals, "sheet string, address string, total_column int, first_row int, last_row int").join(held, ["path", "sheet", "address"], "left").join(sums.withColumnRenamed("total_address", "address"), ["path", "sheet", "address"], "left")
        off = ~F.coalesce("sum", F.lit(0)).eqNullSafe(canonical_money(F.col("value")))
        parts.append(row(said.where(off), "TOTAL_MISMATCH", detail="sum"))
    found = reduce(DataFrame.unionByName, parts)
    return spark.createDataFrame([], _SHAPE).unionByName(found).orderBy("path", "severity", "code", "sheet", "address")


def read_snapshot(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """Objects of a JSON-lines snapshot with ``problem``: not an object, fields outside ``schema``, or a repeated or null key."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    fields = [c.split()[0] for c in schema.split(", ")]
    names = F.json_object_keys("value")
    parsed = lines.select(F.from_json("value", schema).alias("row"), names.alias("names"))
    times = parsed.select("row.*", "names")
    counted = times.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.count("*").alias("_n"))
    extra = F.size(F.array_except("names", F.array(*map(F.lit, fields)))) > 0
    absent = F.size(F.array_except(F.array(*map(F.lit, fields)), "names")) > 0
    problem = F.when(F.col("names").isNull(), "unreadable").when(extra, "unknown_field").when(absent, "missing_field").when(F.col("_n").isNull(), "null_key").when(F.col("_n") > 1, "duplicate_key")
    return times.join(counted, key, "left").select(*fields, problem.alias("problem"))
