"""Workbooks: round trips, files as other programs write them, and defined odd cases."""

import datetime as dt
import zipfile

import pytest

from tidemark.operators import panel
from tidemark.sources import tables, workbook

SCHEMA = "d date, at timestamp, x double, n long, s string, b boolean, m decimal(12,2)"
ROWS = [
    (dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 13, 45, 30, 250000), 0.1, 7, "plain", True, 12.5),
    (dt.date(1999, 12, 31), None, -1e-300, -3, "  <a & b>\nline\ttab\x07 _x0041_ é漢🎉", False, None),
    (None, dt.datetime(1970, 1, 1), float("nan"), 2**53 + 1, "", None, -0.01),
    (None, None, None, None, None, None, None),
    (dt.date(2024, 3, 1), dt.datetime(2030, 7, 1, 23, 59, 59), 1e200, 0, "plain", True, 0.0),
]


def frame(spark, rows=ROWS):
    from decimal import Decimal

    return spark.createDataFrame([(*r[:6], None if r[6] is None else Decimal(str(r[6]))) for r in rows], SCHEMA)


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "all.xlsx")
    workbook.write_workbook({"All": frame(spark)}, path)
    back = workbook.read_workbook(spark, path, "All", SCHEMA).collect()
    want = frame(spark).collect()
    assert len(back) == 4  # the row without any value is left out
    for g, w in zip(back, [w for w in want if any(v is not None for v in w)]):
        assert (g.d, g.at, g.n, g.b, g.m) == (w.d, w.at, w.n, w.b, w.m)
        assert g.s == w.s
        assert g.x == w.x or (g.x is None and w.x != w.x)
    assert not [p for p in tmp_path.iterdir() if p.name != "all.xlsx"]  # no fragment is left


def test_inferred_types(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    workbook.write_workbook({"T": frame(spark)}, path)
    assert dict(workbook.read_workbook(spark, path).dtypes) == {"d": "date", "at": "timestamp", "x": "double", "n": "string", "s": "string", "b": "boolean", "m": "double"}


def test_many_partitions_keep_order_and_sheets(spark, tmp_path):
    path = str(tmp_path / "many.xlsx")
    ids = spark.range(0, 5000, 1, 7).selectExpr("id", "id * 0.5 AS half")
    workbook.write_workbook({"One": ids, "Two & <2>": ids.filter("id < 3"), "None": ids.filter("id < 0")}, path)
    assert [r.id for r in workbook.read_workbook(spark, path, "One", "id long, half double").collect()] == list(range(5000))
    assert workbook.read_workbook(spark, path, "Two & <2>", "half double, id long").collect()[2] == (1.0, 2)
    assert workbook.read_workbook(spark, path, "None", "id long, half double").count() == 0
    every = workbook.read_workbook(spark, path, "*", "id long, half double")
    assert every.count() == 5003 and every.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="already has a sheet"):
        ids.write.format("workbook").option("sheet", "one").mode("append").save(path)
    assert workbook.read_workbook(spark, path, "One", "id long").count() == 5000  # a failed write leaves the workbook whole
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_workbook(spark, path, "Three", "id long").count()


FOREIGN = {
    "xl/workbook.xml": '<workbook xmlns="{m}" xmlns:r="{r}"><workbookPr date1904="1"/><sheets><sheet name="P" sheetId="9" r:id="rId7"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="{p}"><Relationship Id="rId7" Type="x" Target="/xl/worksheets/data.xml"/></Relationships>',
    "xl/sharedStrings.xml": '<sst xmlns="{m}"><si><t>date</t></si><si><r><t>A</t></r><r><t xml:space="preserve"> B</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si><si><t>n/a</t></si></sst>',
    "xl/styles.xml": '<styleSheet xmlns="{m}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
    "xl/worksheets/data.xml": '<worksheet xmlns="{m}"><sheetData><row r="1"/><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>1</v></c></row>'
    '<row r="4"><c r="A4" s="1"><v>100</v></c><c r="B4" s="2"><v>1.5</v></c><c r="D4" t="str"><f>1+1</f><v>two</v></c></row>'
    '<row r="6"><c r="A6" s="1"><v>101</v></c><c r="B6" t="e"><v>#DIV/0!</v></c><c r="D6"><v>3</v></c></row></sheetData></worksheet>',
}


def test_file_of_another_program(spark, tmp_path):
    """Shared strings in runs, readings, the 1904 calendar, own date formats, gaps, formulas, errors, absolute targets."""
    path = str(tmp_path / "foreign.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        for name, text in FOREIGN.items():
            z.writestr(name, text.replace("{m}", workbook.MAIN[1:-1]).replace("{r}", workbook.OFFICE[1:-1]).replace("{p}", workbook.PACKAGE[1:-1]))
    got = workbook.read_workbook(spark, path)
    assert got.dtypes == [("date", "date"), ("A B", "double"), ("Unnamed: 2", "string"), ("A B.1", "string")]
    assert [tuple(r) for r in got.collect()] == [(dt.date(1904, 4, 10), 1.5, None, "two"), (dt.date(1904, 4, 11), None, None, "3")]


def test_price_workbooks(spark, tmp_path):
    """Each of the four keys has its own table; a wide one becomes the panel that its CSV gives."""
    for v in (1, 2):
        for c in ("usd", "eur"):
            wide = spark.createDataFrame([(dt.date(2024, 1, 2), 10.0 * v, "x"), (dt.date(2024, 1, 3), None, "2.5")], f"date date, {c}_a double, b string")
            workbook.write_workbook({"Sheet1": wide}, str(tmp_path / f"prices_{v}_{c}.xlsx"))
    for v in (1, 2):
        for c in ("usd", "eur"):
            got = panel.clean_wide(workbook.price_workbook(spark, str(tmp_path), v, c.upper())).collect()
            assert sorted((r.dt.day, r.asset, r.px) for r in got if r.px is not None) == [(2, f"{c}_a", 10.0 * v), (3, "b", 2.5)]
    with pytest.raises(ValueError, match="versions"):
        workbook.price_workbook(spark, str(tmp_path), 3)
    assert tables.prices(spark, str(tmp_path / "prices_1_usd.xlsx"), "workbook").columns == ["date", "usd_a", "b"]


def test_odd_cases(spark, tmp_path):
    empty = str(tmp_path / "e.xlsx")
    workbook.write_workbook({"E": spark.createDataFrame([], "a string")}, empty)
    assert workbook.read_workbook(spark, empty).dtypes == [("a", "string")]
    with pytest.raises(Exception, match="no workbook"):
        workbook.read_workbook(spark, str(tmp_path / "missing.xlsx"), schema="a string").count()
    with pytest.raises(Exception, match="at most 32767"):
        workbook.write_workbook({"L": spark.createDataFrame([("x" * 40000,)], "a string")}, str(tmp_path / "l.xlsx"))
    with pytest.raises(Exception, match="can't hold"):
        workbook.write_workbook({"N": spark.createDataFrame([([1],)], "a array<int>")}, str(tmp_path / "n.xlsx"))
    with pytest.raises(ValueError, match="shared folder"):
        workbook.local("s3://bucket/a.xlsx")
    assert not [p for p in tmp_path.iterdir() if p.name != "e.xlsx"]  # what failed leaves nothing
    assert workbook.header({0: "a", 1: "a", 3: "a.1"}) == {0: "a", 1: "a.1", 2: "Unnamed: 2", 3: "a.1.1"}
