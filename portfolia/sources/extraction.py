"""Workbooks as whole rows with the state and lineage of every cell, a manifest of each sheet, and a written form that is checked byte by byte when read.

Cells come from ``workbook_parts``.  Sheets are independent: their rows are put
together by shuffles on workbook, sheet and row, and no row is wider than the
16,384 columns of the format.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portfolia.functions.digest import streamed_sha256
from portfolia.functions.text import canonical_json_text, excel_date
from portfolia.operators.provenance import guarded
from portfolia.sources.bindings import count_of
from portfolia.sources.workbook import MAX_CELLS

SHEET = ["path", "sheet"]
ROW = [*SHEET, "row_number"]
#: Version of a row's content, and what an issue can be.
VERSION = 1
ISSUES = ["EXTERNAL_FORMULA_REFERENCE", "FORMULA_WITHOUT_CACHED_RESULT", "RANGE_TOO_LARGE", "SHEET_EMPTY", "WORKBOOK_UNREADABLE"]
MANIFEST = "path string, sheet string, sheet_position int, visibility string, date_system string, used_range string, row_count long, blank_rows long, formula_cells long, formula_definitions long, merged_ranges long, content_hash string"


def column_letters(n: Column) -> Column:
    """A for 1, AA for 27, up to XFD for 16384."""
    letter = lambda k: F.char(F.lit(65) + k % 26)
    last = n - 1
    middle = F.floor(last / 26) - 1
    first = F.floor(middle / 26) - 1
    return F.concat(F.when(first >= 0, letter(first)).otherwise(""), F.when(middle >= 0, letter(middle)).otherwise(""), letter(last))


def _column_of(address: Column) -> Column:
    """The number of an address's column."""
    codes = F.split(F.regexp_replace(address, "[0-9]", ""), "")
    return F.aggregate(codes, F.lit(0), lambda n, letter: F.when(letter == "", n).otherwise(n * 26 + F.ascii(letter) - 64))


def _merges(parts: DataFrame) -> DataFrame:
    """Merged ranges with their bounds; a range of one cell has one address."""
    ends = F.split("value", ":")
    last = F.coalesce(F.try_element_at(ends, F.lit(2)), F.col("address"))
    bounds = [last.alias("last_address"), F.regexp_extract(last, "[0-9]+", 0).cast("int").alias("last_row"), _column_of(last).alias("last_column")]
    return parts.where("state = 'merge_range'").select(*SHEET, F.col("address").alias("master"), F.col("row_number").alias("first_row"), F.col("column_number").alias("first_column"), *bounds)


def used_ranges(parts: DataFrame) -> DataFrame:
    """Each sheet of a readable workbook with the box around its stored cells and merged ranges; null bounds if it has none.

    ``area`` counts the box's cells; boxes of more than two million are refused
    by ``issues`` and have no rows.
    """
    bad = parts.where("problem is not null").select("path")
    good = parts.join(bad, "path", "left_anti")
    cells = good.where("state not in ('sheet', 'merge_range')").select(*ROW, "column_number")
    ends = _merges(good).select(*SHEET, F.explode(F.array(F.struct(F.col("first_row").alias("r"), F.col("first_column").alias("c")), F.struct(F.col("last_row").alias("r"), F.col("last_column").alias("c")))).alias("e"))
    corners = cells.unionByName(ends.select(*SHEET, F.col("e.r").alias("row_number"), F.col("e.c").alias("column_number")))
    box = corners.groupBy(*SHEET).agg(*[f(c).alias(n) for n, f, c in (("first_row", F.min, "row_number"), ("last_row", F.max, "row_number"), ("first_column", F.min, "column_number"), ("last_column", F.max, "column_number"))])
    opened = good.where("state = 'sheet'").select(*SHEET, F.col("row_number").alias("sheet_position"), F.col("data_type").alias("visibility"), F.col("value").alias("date_system"))
    area = (F.col("last_row") - F.col("first_row") + 1).cast("long") * (F.col("last_column") - F.col("first_column") + 1)
    corner = lambda c, r: F.concat(column_letters(F.col(c)), F.col(r).cast("string"))
    named = F.when(F.col("first_row").isNotNull(), F.concat_ws(":", corner("first_column", "first_row"), corner("last_column", "last_row")))
    return opened.join(box, SHEET, "left").withColumns({"used_range": named, "area": F.coalesce(area, F.lit(0).cast("long"))})


def extracted_rows(parts: DataFrame) -> DataFrame:
    """Every row of every used range with all its cells, its content as canonical JSON (``raw_payload``) and the hash of that.

    A cell is ``merged`` if a merged range covers it that begins elsewhere
    (``merged_from``), else ``missing`` if it isn't stored, else what it is
    stored as.  A row whose cells are all missing or blank is ``blank``.  Numbers
    keep their text.  Of repeated addresses in a damaged file the greatest
    record stays.
    """
    ranges = used_ranges(parts).where(F.col("area").between(1, MAX_CELLS))
    spine = ranges.select(*SHEET, "date_system", "first_column", "last_column", F.explode(F.sequence("first_row", "last_row")).alias("row_number"))
    content = F.struct("value", "formula", "data_type", "number_format", "date_serial", "state")
    stored = parts.where("state not in ('sheet', 'merge_range')").groupBy(*ROW, "column_number").agg(F.max(content).alias("cell"))
    stored = stored.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("column_number", "cell"))).alias("stored"))
    clipped = _merges(parts).join(ranges.select(*SHEET, F.col("first_row").alias("_from"), F.col("last_row").alias("_to")), SHEET)
    by_row = clipped.withColumn("row_number", F.explode(F.sequence(F.greatest("first_row", "_from"), F.least("last_row", "_to"))))
    by_row = by_row.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("first_column", "last_column", "master"))).alias("merges"))
    rows = spine.join(stored, ROW, "left").join(by_row, ROW, "left")

    def cell(column: Column) -> Column:
        found = F.try_element_at(F.col("stored"), column)
        address = F.concat(column_letters(column), F.col("row_number").cast("string"))
        over = F.filter("merges", lambda m: column.between(m["first_column"], m["last_column"]) & (m["master"] != address))
        master = F.try_element_at(over, F.lit(1))["master"]
        serial = F.when(found["date_serial"], F.floor(found["value"].try_cast("double")))
        day = F.when(F.col("date_system") == "1904", excel_date(serial, True)).otherwise(excel_date(serial))
        return F.struct(
            column.alias("column_index"), column_letters(column).alias("column_letter"), address.alias("address"), found["value"].alias("value"), found["formula"].alias("formula"),
            found["data_type"].alias("data_type"), found["number_format"].alias("number_format"), F.when(master.isNotNull(), "merged").otherwise(F.coalesce(found["state"], F.lit("missing"))).alias("state"),
            found.isNotNull().alias("record_present"), master.alias("merged_from"), day.cast("string").alias("date_iso"),
        )

    rows = rows.withColumn("cells", F.transform(F.sequence("first_column", "last_column"), cell))
    ends = F.concat(column_letters(F.col("first_column")), F.col("row_number").cast("string"), F.lit(":"), column_letters(F.col("last_column")), F.col("row_number").cast("string"))
    kind = F.when(F.forall("cells", lambda c: c["state"].isin("missing", "blank")), "blank").otherwise("unknown")
    rows = rows.select(*ROW, ends.alias("source_range"), kind.alias("row_kind"), "cells")
    payload = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.col("path"), F.col("sheet"), F.col("row_number"), F.col("source_range"), F.col("row_kind"), F.col("cells")), {"ignoreNullFields": "false"})
    return rows.withColumn("raw_payload", canonical_json_text(payload)).withColumn("row_hash", F.sha2("raw_payload", 256))


def content_hashes(rows: DataFrame) -> DataFrame:
    """Per sheet the SHA-256 of the JSON list of its rows' contents in order, and how many there are."""
    pieces = rows.select(*SHEET, F.col("row_number").cast("long").alias("at"), F.lit(True).alias("element"), F.col("raw_payload").alias("text"))
    counts = rows.groupBy(*SHEET).agg(count_of("*").alias("row_count"))
    ends = F.explode(F.array(*[F.struct(F.lit(at).cast("long").alias("at"), F.lit(False).alias("element"), F.lit(text).alias("text")) for at, text in ((-1, "["), (1 << 40, "]"))]))
    listed = pieces.unionByName(counts.select(*SHEET, ends.alias("e")).select(*SHEET, "e.*"))
    return streamed_sha256(listed, SHEET).withColumnRenamed("sha256", "content_hash").join(counts, SHEET)


def manifest(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per sheet: its place, range, counts and content hash; a sheet without cells has no range, no rows and no hash."""
    formulas = [count_of(F.when(F.col("formula").isNotNull(), 1)).alias("formula_cells"), count_of(F.when(F.col("formula") != "", 1)).alias("formula_definitions"), count_of(F.when(F.col("state") == "merge_range", 1)).alias("merged_ranges")]
    stored = parts.where("problem is null").groupBy(*SHEET).agg(*formulas)
    blank = rows.groupBy(*SHEET).agg(count_of(F.when(F.col("row_kind") == "blank", 1)).alias("blank_rows"))
    joined = used_ranges(parts).join(stored, SHEET).join(blank, SHEET, "left").join(content_hashes(rows), SHEET, "left")
    return joined.select(*[F.coalesce(n, F.lit(0).cast("long")).alias(n) if t == "long" else F.col(n) for n, t in (c.split() for c in MANIFEST.split(", "))])


def issues(parts: DataFrame, strict: bool = False) -> DataFrame:
    """What an extraction must report: unreadable workbooks, sheets without cells or of too large a range, formulas without a cached result or that refer to other files.

    The last two are warnings unless ``strict``; all else is an error.
    """
    soft = "error" if strict else "warning"
    ranges = used_ranges(parts).withColumn("address", F.col("used_range"))
    nothing = F.lit(None).cast("string")
    found = [
        (parts.where("problem is not null"), "WORKBOOK_UNREADABLE", "error", nothing, nothing, F.col("problem")),
        (ranges.where("area = 0"), "SHEET_EMPTY", "error", F.col("sheet"), nothing, nothing),
        (ranges.where(F.col("area") > MAX_CELLS), "RANGE_TOO_LARGE", "error", F.col("sheet"), F.col("address"), F.col("area").cast("string")),
        (parts.where("state = 'formula' and value is null"), "FORMULA_WITHOUT_CACHED_RESULT", soft, F.col("sheet"), F.col("address"), F.col("formula")),
        (parts.where("state = 'formula' and contains(formula, '[')"), "EXTERNAL_FORMULA_REFERENCE", soft, F.col("sheet"), F.col("address"), F.col("formula")),
    ]
    named = [rows.select("path", F.lit(severity).alias("severity"), F.lit(code).alias("code"), sheet.alias("sheet"), at.alias("address"), detail.alias("detail")) for rows, code, severity, sheet, at, detail in found]
    return reduce(DataFrame.unionByName, named)


def write_extraction(rows: DataFrame, sheets: DataFrame, folder: str) -> None:
    """``rows`` and ``sheets`` as lines of JSON in two folders under ``folder``, each line with the hash of its content."""
    line = lambda payload, digest: F.concat(F.lit('{"raw_payload":'), payload, F.lit(',"row_hash":"'), digest, F.lit('"}')).alias("value")
    rows.select(line(F.col("raw_payload"), F.col("row_hash"))).write.text(f"{folder}/rows")
    listed = sheets.withColumn("raw_payload", canonical_json_text(F.to_json(F.struct(*sheets.columns), {"ignoreNullFields": "false"})))
    listed.select(line(F.col("raw_payload"), F.sha2("raw_payload", 256))).write.text(f"{folder}/manifest")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """raw_payload of each line and whether the line is nothing but a content and the hash of its bytes."""
    shape = r'^\{"raw_payload":(\{.*\}),"row_hash":"([0-9a-f]{64})"\}$'
    parts = spark.read.text(path).select(F.regexp_extract("value", shape, 1).alias("raw_payload"), F.regexp_extract("value", shape, 2).alias("said"))
    return parts.select("raw_payload", (F.sha2("raw_payload", 256) == F.col("said")).alias("sound"))


def read_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``write_extraction`` wrote; the query fails unless each line has its hash, and each sheet its count and content hash.

    ``EXTRACTION_LINE_INVALID``: a line is not a content with its own hash.
    ``EXTRACTION_SHEET_MISMATCH``: rows of a sheet are missing, extra or
    changed, or the manifest has the sheet twice or not at all.
    """
    cell = "column_index int, column_letter string, address string, value string, formula string, data_type string, number_format string, state string, record_present boolean, merged_from string, date_iso string"
    schema = ", ".join(f"{n}: {t}" for n, t in (c.split() for c in cell.split(", ")))
    lines, listed = _lines(spark, f"{folder}/rows"), _lines(spark, f"{folder}/manifest")
    content = F.from_json("raw_payload", f"schema_version int, path string, sheet string, row_number int, source_range string, row_kind string, cells array<struct<{schema}>>")
    rows = lines.select(content.alias("r"), "raw_payload", "sound").select(*[f"r.{c}" for c in ("path", "sheet", "row_number", "source_range", "row_kind", "cells", "schema_version")], "raw_payload", "sound")
    sheets = listed.select(F.from_json("raw_payload", MANIFEST).alias("m")).select("m.*")
    said = sheets.groupBy(*SHEET).agg(count_of("*").alias("times"), F.max("row_count").alias("said_count"), F.max("content_hash").alias("said_hash"))
    found = said.join(content_hashes(rows), SHEET, "full")
    same = (F.col("times") == 1) & (F.coalesce("row_count", F.lit(0).cast("long")) == F.col("said_count")) & F.col("content_hash").eqNullSafe(F.col("said_hash"))
    valid = F.col("sound") & (F.col("schema_version") == VERSION)
    released = rows.select(*ROW, "source_range", "row_kind", "cells", "raw_payload")
    released = guarded(released, rows.select("sound", "schema_version"), valid, "EXTRACTION_LINE_INVALID")
    released = guarded(released, listed, F.col("sound"), "EXTRACTION_LINE_INVALID")
    return guarded(released, found, same, "EXTRACTION_SHEET_MISMATCH")
