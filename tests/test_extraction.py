"""A workbook with every state of a cell to rows, manifest and issues; the written form refuses any changed byte."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from portfolia.sources import extraction, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PLAN = """<sheetData>
<row r="2"><c r="B2" t="inlineStr"><is><t>head</t></is></c><c r="D2" t="str"><v></v></c></row>
<row r="3"><c r="B3"/><c r="C3"><f>[1]Other!A1</f></c><c r="D3"><f t="shared" ref="D3:D4" si="0">B3+1</f><v>0.1</v></c></row>
<row r="4"><c r="C4"/></row>
<row r="5"><c r="B5" s="1"><v>45000</v></c><c r="C5" s="2"><v>45000.75</v></c><c r="D5" s="3"><v>866.59999999999991</v></c></row>
<row r="6"><c r="D6"><f t="shared" si="0"/><v>1</v></c></row>
</sheetData><mergeCells count="2"><mergeCell ref="B2:C2"/><mergeCell ref="D5:E7"/></mergeCells>"""


def book(path, sheets, system=""):
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{name}" sheetId="{k}" r:id="rId{k}"{extra}/>' for k, (name, _, extra) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {NS}><workbookPr{system}/><sheets>{listed}</sheets></workbook>")
        targets = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
        formats = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="&quot;days&quot; 0.00\\h[Red]"/></numFmts>'
        styles = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 164, 165))
        z.writestr("xl/styles.xml", f"<styleSheet {NS}>{formats}<cellXfs>{styles}</cellXfs></styleSheet>")
        for k, (_, body, _) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {NS}>{body}</worksheet>")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    book(folder / "a.xlsx", [("Plan", PLAN, ""), ("Empty", "<sheetData/>", ' state="hidden"'), ("Far", '<sheetData><row r="1"><c r="A1"><v>1</v></c></row><row r="1048576"><c r="XFD1048576"><v>1</v></c></row></sheetData>', "")])
    book(folder / "b.xlsx", [("Plan", '<sheetData><row r="1"><c r="A1" s="1"><v>0</v></c></row></sheetData>', "")], ' date1904="1"')
    (folder / "c.xlsx").write_bytes(b"PK\x03\x04 broken")
    return workbook.workbook_parts(spark, str(folder)).withColumn("path", F.element_at(F.split("path", "/"), -1)).cache()


def test_cells_of_every_state(parts):
    rows = {r.row_number: r for r in extraction.extracted_rows(parts).where("path = 'a.xlsx'").collect()}
    assert {r.sheet for r in rows.values()} == {"Plan"} and sorted(rows) == [2, 3, 4, 5, 6, 7]
    states = {n: [c.state for c in r.cells] for n, r in rows.items()}
    assert states == {
        2: ["value", "merged", "empty_string", "missing"], 3: ["blank", "formula", "formula", "missing"], 4: ["missing", "blank", "missing", "missing"],
        5: ["value", "value", "value", "merged"], 6: ["missing", "missing", "merged", "merged"], 7: ["missing", "missing", "merged", "merged"],
    }
    assert [c.address for c in rows[2].cells] == ["B2", "C2", "D2", "E2"] and rows[2].source_range == "B2:E2"
    assert (rows[2].cells[1].merged_from, rows[7].cells[3].merged_from, rows[5].cells[2].merged_from) == ("B2", "D5", None)
    assert (rows[6].cells[2].record_present, rows[7].cells[2].record_present) == (True, False)
    assert [(c.number_format, c.date_iso, c.value) for c in rows[5].cells[:3]] == [("builtin:14", "2023-03-15", "45000"), ("yyyy\\-mm", "2023-03-15", "45000.75"), ('"days" 0.00\\h[Red]', None, "866.59999999999991")]
    assert {n: r.row_kind for n, r in rows.items()} == {2: "unknown", 3: "unknown", 4: "blank", 5: "unknown", 6: "unknown", 7: "unknown"}
    assert extraction.extracted_rows(parts).where("path = 'b.xlsx'").first().cells[0].date_iso == "1904-01-01"


def test_hashes_and_manifest(parts):
    rows = extraction.extracted_rows(parts)
    got = {(r.path, r.sheet): r for r in extraction.manifest(parts, rows).collect()}
    assert set(got) == {("a.xlsx", "Plan"), ("a.xlsx", "Empty"), ("a.xlsx", "Far"), ("b.xlsx", "Plan")}
    plan, empty, far = (got["a.xlsx", s] for s in ("Plan", "Empty", "Far"))
    assert (plan.used_range, plan.row_count, plan.blank_rows, plan.formula_cells, plan.formula_definitions, plan.merged_ranges) == ("B2:E7", 6, 1, 3, 2, 2)
    assert (empty.sheet_position, empty.visibility, empty.used_range, empty.row_count, empty.content_hash) == (2, "hidden", None, 0, None)
    assert (far.used_range, far.row_count, got["b.xlsx", "Plan"].date_system) == ("A1:XFD1048576", 0, "1904")
    own = sorted((r for r in rows.where("path = 'a.xlsx'").collect()), key=lambda r: r.row_number)
    for r in own:
        assert r.raw_payload == json.dumps(json.loads(r.raw_payload), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.row_hash == hashlib.sha256(r.raw_payload.encode()).hexdigest()
    assert plan.content_hash == hashlib.sha256(("[" + ",".join(r.raw_payload for r in own) + "]").encode()).hexdigest()


def test_issues(parts):
    found = lambda strict: sorted((r.path, r.severity, r.code, r.sheet, r.address) for r in extraction.issues(parts, strict).collect())
    soft = [("a.xlsx", "warning", "EXTERNAL_FORMULA_REFERENCE", "Plan", "C3"), ("a.xlsx", "warning", "FORMULA_WITHOUT_CACHED_RESULT", "Plan", "C3")]
    hard = [("a.xlsx", "error", "RANGE_TOO_LARGE", "Far", "A1:XFD1048576"), ("a.xlsx", "error", "SHEET_EMPTY", "Empty", None), ("c.xlsx", "error", "WORKBOOK_UNREADABLE", None, None)]
    assert found(False) == sorted(hard + soft)
    assert found(True) == sorted(hard + [(a, "error", *rest) for a, _, *rest in soft])
    assert {code for _, _, code, _, _ in found(False)} == set(extraction.ISSUES)


def test_column_letters(spark):
    got = spark.range(1, 16385).select(extraction.column_letters(F.col("id")).alias("s")).collect()
    assert [workbook.column_number(r.s) for r in got] == list(range(1, 16385))


def test_written_form_refuses_changes(spark, parts, tmp_path):
    rows = extraction.extracted_rows(parts).where("path = 'b.xlsx' or row_number in (2, 5)")
    sheets = extraction.manifest(parts, rows).where("row_count > 0")
    extraction.write_extraction(rows, sheets, str(tmp_path / "good"))
    read = extraction.read_extraction(spark, str(tmp_path / "good"))
    assert sorted(r.raw_payload for r in read.collect()) == sorted(r.raw_payload for r in rows.collect())
    assert {(r.path, r.row_number, r.cells[0].state) for r in read.collect()} == {("a.xlsx", 2, "value"), ("a.xlsx", 5, "value"), ("b.xlsx", 1, "value")}
    held = {kind: [line for f in sorted((tmp_path / "good" / kind).glob("*.txt")) for line in f.read_text().splitlines()] for kind in ("rows", "manifest")}

    def refused(name, change):
        lines = {kind: list(found) for kind, found in held.items()}
        change(lines)
        for kind, found in lines.items():
            (tmp_path / name / kind).mkdir(parents=True)
            (tmp_path / name / kind / "part.txt").write_text("".join(line + "\n" for line in found))
        with pytest.raises(Exception, match="EXTRACTION_"):
            extraction.read_extraction(spark, str(tmp_path / name)).collect()

    def byte(kind, at):
        def change(lines):
            text = lines[kind][0]
            lines[kind][0] = text[:at] + ("0" if text[at] != "0" else "1") + text[at + 1 :]

        return change

    length = {kind: len(found[0]) for kind, found in held.items()}
    spots = [("rows", at) for at in (0, 16, 40, length["rows"] // 2, length["rows"] - 80, length["rows"] - 10)] + [("manifest", at) for at in (0, 40, length["manifest"] // 2, length["manifest"] - 10)]
    for kind, at in spots:
        refused(f"{kind}{at}", byte(kind, at))
    refused("lost", lambda lines: lines["rows"].pop())
    refused("twice", lambda lines: lines["rows"].append(lines["rows"][0]))
    refused("unlisted", lambda lines: lines["manifest"].pop())
    refused("listed twice", lambda lines: lines["manifest"].append(lines["manifest"][0]))
