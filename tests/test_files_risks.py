"""Workbooks with dates, formulas, padded numbers and named sheets; unsafe files of each kind."""

import gzip
import io
import zipfile
from datetime import date, datetime, time

import pytest

from weftline.sources import files, risks

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _zip(members: dict, **options) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", **options) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return raw.getvalue()


def _book(cells: str, properties: str = "") -> bytes:
    return _zip(
        {
            "xl/workbook.xml": f'<workbook {_MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{properties}<sheets><sheet name="Notes" r:id="r2"/><sheet name="Daten" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/other.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet {_MAIN}><numFmts><numFmt numFmtId="164" formatCode="00000"/><numFmt numFmtId="165" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="166" formatCode="0.0&quot; days&quot;"/></numFmts>'
            '<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f"<worksheet {_MAIN}><sheetData>{cells}</sheetData></worksheet>",
            "xl/worksheets/other.xml": f"<worksheet {_MAIN}><sheetData/></worksheet>",
        }
    )


def test_workbook(spark, tmp_path):
    text = lambda t: f"<c t='inlineStr'><is><t>{t}</t></is></c>"
    cells = f"<row>{text('Code')}{text('Day')}{text('Moment')}{text('Lasts')}</row><row><c s='1'><v>42</v></c><c s='2'><v>45292</v></c><c s='3'><v>45292.5</v></c><c s='4'><f>1+1</f><v>2</v></c></row>"
    raw = _book(cells)
    assert files.sheet_rows(raw, "Daten")[1] == ["00042", date(2024, 1, 1), datetime(2024, 1, 1, 12), 2]
    assert files.sheet_rows(raw, 2) == files.sheet_rows(raw, "Daten") and files.sheet_rows(raw, "Notes") == []
    assert files.has_formulas(raw, "Daten") and not files.has_formulas(raw, "Notes")
    for wrong in ("None", 0, 3):
        with pytest.raises(ValueError):
            files.sheet_rows(raw, wrong)
    assert files.sheet_rows(_book(cells, "<workbookPr date1904='1'/>"), "Daten")[1][1] == date(2028, 1, 2)
    assert [files.serial_date(x) for x in (1, 59, 61, 0.25)] == [date(1900, 1, 1), date(1900, 2, 28), date(1900, 3, 1), time(6)]
    (tmp_path / "a.xlsx").write_bytes(raw)
    got = {r["sheet"]: r for r in files.layouts(spark, str(tmp_path / "a.xlsx")).collect()}
    assert got["Notes"]["header_row"] is None and (got["Daten"]["header_row"], got["Daten"]["rows"], got["Daten"]["has_formulas"]) == (0, 1, True)
    row = files.read_xlsx(spark, str(tmp_path / "a.xlsx"), "Daten").first()
    assert row["fields"] == {"Code": "00042", "Day": "2024-01-01", "Moment": "2024-01-01 12:00:00", "Lasts": "2"}


def test_zip_risks():
    assert risks.zip_risks(_zip({"a/b.txt": "x"})) == set()
    for name in ("../a", "/a", "a//b", "a/./b", "c:a", "nul.txt", "a /b", "x\\..\\y"):
        assert risks.zip_risks(_zip({name: "x"})) == {"archive_path_traversal"}, name
    assert risks.zip_risks(_zip({"A.txt": "x", "a.TXT": "y"})) == {"archive_duplicate_entry"}
    assert risks.zip_risks(_zip({"a": b"\0" * (2 * risks.MIB)}, compression=zipfile.ZIP_DEFLATED)) == {"archive_high_compression_ratio"}
    link = zipfile.ZipInfo("l")
    link.external_attr = 0o120777 << 16
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr(link, "target")
    assert risks.zip_risks(raw.getvalue()) == {"archive_symlink"}
    office = _zip({"xl/vbaProject.bin": "", "xl/externalLinks/l1.xml": "", "xl/connections.xml": ""})
    assert risks.zip_risks(office) == {"office_macro", "office_external_link", "office_external_data"}
    few = risks.Policy(entries=2, member_bytes=3, unpacked_bytes=4)
    assert risks.zip_risks(_zip({str(i): "" for i in range(3)}), few) == {"archive_too_many_entries"}
    assert risks.zip_risks(_zip({"a": "12345"}), few) == {"archive_member_too_large", "archive_too_large"}
    assert risks.zip_risks(_zip({"a": "1"})[:-30]) == {"malformed_archive"}


def test_gzip_risks():
    one = gzip.compress(b"text" * 100)
    assert risks.gzip_risks(one + one + b"\0" * 9) == set()
    assert risks.gzip_risks(gzip.compress(b"\0" * (2 * risks.MIB))) == {"archive_high_compression_ratio"}
    for wrong in (one[:-3], one + b"tail", b"\x1f\x8b", one[:20] + b"\xff" * 30, b""):
        assert risks.gzip_risks(wrong) == {"malformed_archive"}
    assert risks.gzip_risks(one * 3, risks.Policy(entries=2)) == {"archive_too_many_entries"}
    assert risks.gzip_risks(one * 3, risks.Policy(entries=3)) == set()
    assert risks.gzip_risks(one, risks.Policy(gzip_bytes=5)) == {"archive_scan_budget_exceeded"}
    assert risks.gzip_risks(one, risks.Policy(member_bytes=399)) == {"archive_member_too_large"}


def test_text_risks(spark, tmp_path):
    assert risks.xml_risks(b"<a>" * 128 + b"</a>" * 128) == set()
    assert risks.xml_risks(b"<a>" * 129) == {"xml_nesting_too_deep"}
    assert risks.xml_risks(b"<a>" + b"<b/>" * 9, risks.Policy(xml_elements=9)) == {"xml_too_many_elements"}
    assert risks.xml_risks(b"<a x='1' y='2'/>", risks.Policy(xml_attributes=1)) == {"xml_too_many_attributes"}
    assert risks.json_risks("[" * 129) == {"json_nesting_too_deep"} and risks.json_risks("[" * 128 + "]" * 128) == set()
    assert risks.json_risks('{"a": "[[[\\"{{{,,,"}', risks.Policy(depth=1, json_items=1)) == set()
    assert risks.json_risks("[1,2,3]", risks.Policy(json_items=2)) == {"json_too_many_items"}
    (tmp_path / "deep.json").write_text("[" * 5000)
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    (tmp_path / "z.zip").write_bytes(_zip({"../a": "x"}))
    (tmp_path / "empty").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["risks"]) for r in risks.risks(spark, str(tmp_path)).collect()}
    assert got["deep.json"] == (None, ["json_nesting_too_deep"]) and got["ok.csv"] == ("csv", []) and got["z.zip"] == ("zip", ["archive_path_traversal"])
    got = {r["path"].rsplit("/", 1)[1]: r["risks"] for r in risks.risks(spark, str(tmp_path), risks.Policy(file_bytes=7)).collect()}
    assert got["ok.csv"] == ["file_too_large"] and "empty" not in got
