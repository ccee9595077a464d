"""Spreadsheets, hashed JSON lines, the stream of snapshots and the reconciliation."""

import datetime as dt
import json
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from portfolia.functions.text import canonical_json
from portfolia.sources import jsonl, workbook
from portfolia.streaming import snapshots

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Plan" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Código</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>866.59999999999991</v></c><c r="B2"/><c r="C2"><f>A2*2</f><v>1733.2</v></c><c r="D2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    make_workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no package")
    cells = workbook.workbook_cells(spark, str(tmp_path)).collect()
    good = {r.address: (r.row_number, r.column_number, r.state, r.value, r.formula) for r in cells if r.problem is None}
    assert good == {"A1": (1, 1, "value", "Código", None), "AB1": (1, 28, "value", "ab", None), "A2": (2, 1, "value", "866.59999999999991", None), "B2": (2, 2, "blank", None, None), "C2": (2, 3, "formula", "1733.2", "A2*2"), "D2": (2, 4, "value", "x", None)}
    assert [r.path.rpartition("/")[2] for r in cells if r.problem] == ["b.xlsx"]
    rows = workbook.sheet_rows(workbook.workbook_cells(spark, str(tmp_path))).collect()
    assert {r.row_number: [c.address for c in r.cells] for r in rows} == {1: ["A1", "AB1"], 2: ["A2", "B2", "C2", "D2"]} and len({r.row_hash for r in rows}) == 2


def test_hashed_lines(spark, tmp_path):
    import hashlib

    lines = [{"payload": {"b": 1, "a": "é"}, "row_hash": hashlib.sha256(canonical_json({"a": "é", "b": 1}).encode()).hexdigest()}, {"payload": {"b": 2, "a": "x"}, "row_hash": "0"}, {"other": 1}]
    (tmp_path / "rows.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "no json"]))
    rows = jsonl.read_hashed(spark, str(tmp_path), "a string, b int").collect()
    assert sorted((r.a or "", r.b or 0, r.problem or "") for r in rows) == [("", 0, "unreadable"), ("", 0, "unreadable"), ("x", 2, "hash_mismatch"), ("é", 1, "")]
    got = jsonl.rows_of_json(spark.createDataFrame([('[{"a":1},{"a":2}]',)], "t string"), "t", "a int").collect()
    assert [r.a for r in got] == [1, 2]


def test_stream_of_snapshots(spark, tmp_path):
    schema = "id long, project_id long, authority_revision long, status string"
    make = lambda rows, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/{name}")
    make([(1, 1, 1, "success"), (2, 1, 2, "failed"), (3, 2, 1, "success")], "a")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    for more, want in ((None, {(1, 1, 1), (2, 1, 3)}), ([(4, 1, 3, "success")], {(1, 3, 4), (2, 1, 3)})):
        if more:
            make(more, "b")
        name = f"latest_{len(want)}_{bool(more)}"
        snapshots.keep_latest(stream(), name, f"{tmp_path}/{name}").awaitTermination(120)
        assert {tuple(r) for r in spark.table(name).collect()} == want
