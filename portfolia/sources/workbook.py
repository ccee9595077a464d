"""Spreadsheets (OOXML) as rows of cells, parsed in Spark tasks, one file at a time.

Only the standard library reads the package.  A cell keeps its exact text as
stored, so decimals never pass through a double.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed limits and names of the format.
MAX_BYTES, MAX_CELLS, MAX_TEXT = 100 << 20, 2_000_000, 32_767
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELLS = "path string, sheet string, row_number int, column_number int, address string, data_type string, formula string, value string, state string, number_format string, date_serial boolean, problem string"
#: Fixed values of the format: the built-in number formats that are dates or times.
_DATE_FORMATS = {*range(14, 23), 45, 46, 47}


def column_number(address: str) -> int:
    """1 for A, 27 for AA; from a cell's address."""
    n = 0
    for letter in re.match(r"[A-Z]+", address)[0]:
        n = n * 26 + ord(letter) - 64
    return n


def row_number(address: str) -> int:
    """The row of a cell's address."""
    return int(re.search(r"\d+", address)[0])


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _formats(package: zipfile.ZipFile, names: set[str]) -> list[tuple[str, bool]]:
    """Number format of each cell style, and whether it shows a date: custom ones by their code, built-in ones as ``builtin:`` and their number."""
    if "xl/styles.xml" not in names:
        return []
    styles = ElementTree.fromstring(package.read("xl/styles.xml"))
    custom = {x.get("numFmtId"): x.get("formatCode") for x in styles.iter(f"{_MAIN}numFmt")}
    found, used = [], styles.find(f"{_MAIN}cellXfs")
    for style in () if used is None else used:
        n = style.get("numFmtId", "0")
        code = custom.get(n)
        shown = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code or "")
        found.append(("General" if n == "0" else code or f"builtin:{n}", bool(re.search("[dmyhs]", shown, re.I)) if code else int(n) in _DATE_FORMATS))
    return found


def read_parts(data: bytes) -> Iterator[dict]:
    """All that a package's sheets hold, in order; ``state`` says what a record is.

    ``sheet`` opens a sheet: its position from 1 in ``row_number``, 1900 or 1904
    (the date system) in ``value``, its visibility in ``data_type``.
    ``merge_range`` is a merged range, in ``value``, at its first cell.  All
    others are stored cells: blank, empty_string, formula or value.
    """
    if data[:4] != b"PK\x03\x04" or len(data) > MAX_BYTES:
        raise ValueError("not a spreadsheet package, or too large")
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        names = set(package.namelist())
        shared = [_text(x) for x in ElementTree.fromstring(package.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
        formats = _formats(package, names)
        workbook = ElementTree.fromstring(package.read("xl/workbook.xml"))
        settings = workbook.find(f"{_MAIN}workbookPr")
        system = "1904" if settings is not None and settings.get("date1904") in ("1", "true") else "1900"
        for position, sheet in enumerate(workbook.iter(f"{_MAIN}sheet"), 1):
            yield {"sheet": sheet.get("name"), "row_number": position, "value": system, "data_type": sheet.get("state", "visible"), "state": "sheet"}
            target = targets[sheet.get(_RELATION)].lstrip("/")
            count = 0
            with package.open(target if target in names else f"xl/{target}") as part:
                for _, cell in ElementTree.iterparse(part):
                    if cell.tag == f"{_MAIN}mergeCell":
                        first = cell.get("ref").split(":")[0]
                        yield {"sheet": sheet.get("name"), "row_number": row_number(first), "column_number": column_number(first), "address": first, "value": cell.get("ref"), "state": "merge_range"}
                    if cell.tag != f"{_MAIN}c":
                        continue
                    count += 1
                    if count > MAX_CELLS:
                        raise ValueError("too many cells")
                    kind, formula, stored = cell.get("t", "n"), cell.find(f"{_MAIN}f"), cell.find(f"{_MAIN}v")
                    value = None if stored is None else stored.text or ""
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = _text(cell)
                    if value is not None and len(value) > MAX_TEXT:
                        raise ValueError("cell text too long")
                    state = "formula" if formula is not None else "blank" if value is None else "empty_string" if value == "" else "value"
                    address = cell.get("r")
                    style = int(cell.get("s", "0"))
                    number_format, dated = formats[style] if style < len(formats) else ("General", False)
                    yield {
                        "sheet": sheet.get("name"), "row_number": row_number(address), "column_number": column_number(address), "address": address,
                        "data_type": kind, "formula": None if formula is None else formula.text or "", "value": value, "state": state,
                        "number_format": number_format, "date_serial": dated and kind == "n" and value is not None,
                    }
                    cell.clear()


def workbook_parts(spark: SparkSession, path: str) -> DataFrame:
    """Sheets, merged ranges and stored cells of the workbooks under ``path``; what makes a file unreadable gives one row with ``problem``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    schema = pa.schema([(n, {"int": pa.int32(), "boolean": pa.bool_()}.get(t, pa.string())) for n, t in (c.split() for c in _CELLS.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, held = batch.column("path")[k].as_py(), []
                try:
                    for cell in read_parts(batch.column("content")[k].as_py()):
                        held.append({"path": name} | cell)
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                except (ValueError, KeyError, IndexError, TypeError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    held.append({"path": name, "problem": f"{type(error).__name__}: {error}"[:200]})
                yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(parse, _CELLS)


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored cell of the workbooks under ``path``; a file that can't be read gives one row with ``problem``."""
    return workbook_parts(spark, path).where("state is null or state not in ('sheet', 'merge_range')")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """Cells gathered by row in column order, with a hash of the row's content."""
    cell = F.struct("column_number", "address", "data_type", "formula", "value", "state")
    rows = cells.where("problem is null").groupBy("path", "sheet", "row_number").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.withColumn("row_hash", F.sha2(F.to_json("cells"), 256))
