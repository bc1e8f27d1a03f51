"""Workbooks, hashes and JSON files read block by block."""

import datetime as dt
import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.sources import files, workbooks
from tablewright.sources.errors import CorruptedFile, IngestionError, InvalidJson, Unavailable

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def cell(ref, value, shared):
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, tuple):  # style and number, or a kind and its text
        if isinstance(value[0], int):
            return f'<c r="{ref}" s="{value[0]}"><v>{value[1]}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{value[1]}</t></is></c>' if value[0] == "inlineStr" else f'<c r="{ref}" t="{value[0]}"><v>{value[1]}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'


def letters(i):
    return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def workbook(path, sheets, later=False):
    """Written part by part; styles: 1 a built-in date, 2 a custom date and time, 3 a custom number, 4 elapsed hours."""
    shared = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        book = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        out.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{"<workbookPr date1904=" + chr(34) + "1" + chr(34) + "/>" if later else ""}<sheets>{book}</sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            with out.open(f"xl/worksheets/sheet{i + 1}.xml", "w") as part:
                part.write(f"<worksheet {MAIN}><sheetData>".encode())
                for r, row in enumerate(rows):
                    part.write(f'<row r="{r + 1}">{"".join(cell(f"{letters(c)}{r + 1}", v, shared) for c, v in enumerate(row))}</row>'.encode())
                part.write(b"</sheetData></worksheet>")
        items = "".join(f"<si>{s}</si>" if s.startswith("<") else f"<si><t>{s}</t></si>" for s in shared)
        out.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{items}</sst>")
        formats = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;;[Red]0"/><numFmt numFmtId="166" formatCode="[h]:mm"/></numFmts>'
        out.writestr("xl/styles.xml", f'<styleSheet {MAIN}>{formats}<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>')


ROWS = [
    ["id", "name", "day", "at", "share", "ok", "mixed", "name", None, "gap"],
    [1, "Ann", (1, 45000), (2, 45000.75), (3, 0.5), True, 7, "x", "y", "NA"],
    [2, "<r><t>B</t></r><r><t>ob</t></r>", (1, 59), (2, 61.5), (3, 2), False, "seven", ("str", "from a formula"), None, ("e", "#DIV/0!")],
    [],
    [3, ("inlineStr", "Cy &amp; Co"), None, None, None, None, (1, 45000), "z", None, None],
]


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"first": ROWS, "second": [["k", "id"], ["p", 9]]})
    df = files.load_raw(spark, str(tmp_path / "a.xlsx"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "day": "timestamp", "at": "timestamp", "share": "double", "ok": "boolean", "mixed": "string", "name.1": "string", "Unnamed: 8": "string", "gap": "string"}
    rows = [tuple(r) for r in df.collect()]
    assert rows == [
        (1, "Ann", dt.datetime(2023, 3, 15), dt.datetime(2023, 3, 15, 18), 0.5, True, "7", "x", "y", None),
        (2, "Bob", dt.datetime(1900, 2, 28), dt.datetime(1900, 3, 1, 12), 2.0, False, "seven", "from a formula", None, None),
        (3, "Cy & Co", None, None, None, None, "2023-03-15", "z", None, None),
    ]
    assert files.list_sheets(str(tmp_path / "a.xlsx")) == ["first", "second"]
    assert files.load_raw(spark, str(tmp_path / "a.xlsx"), "second").collect() == files.load_raw(spark, str(tmp_path / "a.xlsx"), 1).collect() == [("p", 9)]
    every = files.load_raw(spark, str(tmp_path / "a.xlsx"), "*")
    assert every.rdd.getNumPartitions() == 2 and sorted(r.id for r in every.collect()) == [1, 2, 3, 9] and every.where("k = 'p'").count() == 1
    with pytest.raises(IngestionError):
        files.load_raw(spark, str(tmp_path / "a.xlsx"), "third")
    loaded, meta = files.load(spark, str(tmp_path / "a.xlsx"))
    assert meta.rows == 3 and meta.format == "xlsx" and "mixed" in loaded.columns


def test_folder_of_workbooks_and_the_later_date_system(spark, tmp_path):
    for k, later in enumerate((False, True)):
        workbook(tmp_path / f"{k}.xlsx", {"s": [["k", "day"], [k, (1, 1000)]]}, later)
    rows = workbooks.read_workbook(spark, str(tmp_path)).orderBy("k").collect()
    assert [r.day.year for r in rows] == [1902, 1906]


def test_large_workbook_needs_no_pandas(spark, tmp_path, monkeypatch):
    import pandas

    monkeypatch.setattr(pandas, "read_excel", None)
    workbook(tmp_path / "big.xlsx", {"s": [["n", "text", "x"], *([i, f"value {i % 500}", i / 4] for i in range(100_000))]})
    found = files.load_raw(spark, str(tmp_path / "big.xlsx")).agg(F.count("*"), F.sum("n"), F.countDistinct("text"), F.sum("x")).first()
    assert tuple(found) == (100_000, 4_999_950_000, 500, 1_249_987_500.0)


def test_what_is_no_workbook(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"PK no archive")
    (tmp_path / "a.xls").write_bytes(b"old")
    with pytest.raises(CorruptedFile):
        files.load_raw(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(Unavailable):
        files.load_raw(spark, str(tmp_path / "a.xls"))
    workbook(tmp_path / "none.xlsx", {"s": []})
    with pytest.raises(IngestionError):
        files.load_raw(spark, str(tmp_path / "none.xlsx"))


@pytest.mark.parametrize("code,date", [("General", False), ("0.00", False), ("yyyy-mm-dd", True), ('0 "days"', False), ("[Red]0.0", False), ("[h]:mm", True), (r"0\d", False), ("[$-409]d/m/yy;@", True), ("#,##0_);[Red](#,##0)", False)])
def test_formats_of_dates(code, date):
    assert workbooks.is_date_format(code) == date


# --- hashes and JSON


def test_hashes_are_made_in_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "one.bin").write_bytes(b"abc" * 100_000)
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(5):
        (folder / f"{k}.bin").write_bytes(bytes([k]) * k * 1000 + b"x")
    monkeypatch.setattr(files, "opened", None)  # the driver opens nothing
    for algorithm in ("sha256", "md5"):
        assert files.checksum(spark, str(tmp_path / "one.bin"), algorithm, most=1000) == hashlib.new(algorithm, b"abc" * 100_000).hexdigest()
        parts = [hashlib.new(algorithm, (folder / f"{k}.bin").read_bytes()).hexdigest() for k in range(5)]
        assert files.checksum(spark, str(folder), algorithm) == hashlib.new(algorithm, "".join(parts).encode()).hexdigest()
    monkeypatch.setattr(files, "in_tasks", lambda path: False)  # a store that only Spark reads
    assert files.checksum(spark, str(tmp_path / "one.bin")) == hashlib.sha256(b"abc" * 100_000).hexdigest()
    with pytest.raises(ValueError):
        files.checksum(spark, str(tmp_path / "one.bin"), "crc")


TEXTS = {'{"a": [1, "}"]}': None, '[{"a": "\\\\"}, {}]  \n': None, '{"a": 1} {"a": 2}': "more", '[{"a": 1}': "end", '{"a": "\\""}x': "more", '{"a": "[": 1}': None}


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_one_value_by_blocks(block):
    for text, wrong in TEXTS.items():
        state = files.OneValue()
        data = text.encode()
        for k in range(0, len(data), block):
            state.feed(data[k : k + block])
        assert (wrong == "more") == state.more and (wrong == "end") == (not state.ended)


def test_values_of_several_lines(spark, tmp_path):
    draw = random.Random(1)
    items = ",\n".join('{"a": %d, "b": "%s"}' % (k, "]}" * draw.randint(0, 3)) for k in range(500))
    (tmp_path / "good.json").write_text(f"[\n{items}\n]\n")
    (tmp_path / "two.json").write_text(f"[\n{items}\n]\n[\n{items}\n]")
    (tmp_path / "open.json").write_text(f"[\n{items}")
    assert files.load_raw(spark, str(tmp_path / "good.json")).count() == 500
    for name in ("two.json", "open.json"):
        with pytest.raises(InvalidJson):
            files.load_raw(spark, str(tmp_path / name)).count()


# --- dates


def dates(spark, values):
    from tablewright.operators.clean import parse_timestamps

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, day string")
    out = parse_timestamps(df).orderBy("id")
    return [r.day for r in out.collect()]


@pytest.mark.parametrize(
    "value,year,month,day,clock",
    [
        ("2024-03-05", 2024, 3, 5, ()), ("2024/3/5", 2024, 3, 5, ()), ("2024-03-05T06:07:08.250Z", 2024, 3, 5, (6, 7, 8, 250_000)), ("2024-03-05 06:07", 2024, 3, 5, (6, 7)), ("03/05/2024", 2024, 3, 5, ()),
        ("3-5-2024 6:07 pm", 2024, 3, 5, (18, 7)), ("05-Mar-2024", 2024, 3, 5, ()), ("5 March 2024", 2024, 3, 5, ()), ("Mar 5, 2024", 2024, 3, 5, ()), ("20240305", 2024, 3, 5, ()), ("2024-03-05 06:07:08+02:00", 2024, 3, 5, (4, 7, 8)),
    ],
)
def test_forms_of_dates(spark, value, year, month, day, clock):
    assert dates(spark, [value, None]) == [dt.datetime(year, month, day, *clock), None]


def test_mixed_dates_and_the_day_first(spark):
    mixed = ["2024-03-05", "Mar 6, 2024", "3/7/2024", "2024-03-08T01:00:00"]
    assert [d.day for d in dates(spark, mixed)] == [5, 6, 7, 8]
    assert [(d.day, d.month) for d in dates(spark, ["13/02/2024", "01/02/2024"])] == [(13, 2), (1, 2)]  # the column shows it
    assert [(d.day, d.month) for d in dates(spark, ["02/13/2024", "01/02/2024"])] == [(13, 2), (2, 1)]
    assert [(d.day, d.month) for d in dates(spark, ["02/13/2024", "13/02/2024", "01/02/2024"])] == [(13, 2), (13, 2), (2, 1)]  # each value for itself
    assert dates(spark, ["2024-02-30"] + ["2024-02-01"] * 20)[0] is None
    assert dates(spark, ["12-34-5678 x", "abc 12, 2024", "hello"]) == ["12-34-5678 x", "abc 12, 2024", "hello"]


def test_two_writers_get_two_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tablewright.sources.stores import Registry

    def write(k):
        own = Registry(spark, f"file://{tmp_path}/registry")
        return [own.register(f"sales_v{i}.csv", f"/data/{k}/{i}", 1, 1, "x") for i in range(5)]

    with ThreadPoolExecutor(4) as pool:
        ids = [i for found in pool.map(write, range(4)) for i in found]
    registry = Registry(spark, f"file://{tmp_path}/registry")
    rows = registry.versions("sales").collect()
    assert [r.version for r in rows] == list(range(1, 21)) and {r.dataset_id for r in rows} == set(ids)
    assert all(b.parent_id == a.dataset_id for a, b in zip(rows, rows[1:]))
    registry.delete(ids[0])
    assert registry.count() == 19 and registry.get(ids[0]) is None
    with pytest.raises(KeyError):
        registry.update("none", rows=2)


def test_correlations_of_wide_tables(spark):
    import numpy as np

    from tablewright.operators import gram, profile

    draw = np.random.default_rng(7)
    x = draw.normal(size=(200, 30)) * 10.0 ** draw.integers(-3, 6, 30) + 1e5
    x[:, 3] = 4.0
    x[:, 5] = x[:, 4] * -2 + 1
    held = [[None if draw.random() < 0.2 else float(v) for v in row] for row in x]
    for row in held:
        row[7] = float("nan") if row[8] is None else row[7]
        row[9] = None if row[10] is not None else row[9]
    df = spark.createDataFrame(held, ", ".join(f"`c.{i}` double" for i in range(30))).repartition(3)
    wide = {(r.left_column, r.right_column): r.r for r in profile.correlation_matrix(df).collect()}
    narrow = {}
    for some in ([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], list(range(11, 30)), [0, 5, 10, 15, 20, 25, 29]):
        narrow |= {(r.left_column, r.right_column): r.r for r in profile.correlation_matrix(df, [f"c.{i}" for i in some]).collect()}
    assert len(wide) == 435 and wide["c.9", "c.10"] is None and wide["c.4", "c.5"] == pytest.approx(-1)
    assert all(wide[k] is None if r is None else wide[k] == pytest.approx(r, abs=1e-6) for k, r in narrow.items())
    one = gram.correlations(df, df.columns)
    old, gram.MOST_BYTES, gram.BLOCK = (gram.MOST_BYTES, gram.BLOCK), 1, 7
    try:
        several = {(r.left_column, r.right_column): r.r for r in gram.correlations(df, df.columns).collect()}
    finally:
        gram.MOST_BYTES, gram.BLOCK = old
    assert all(several[r.left_column, r.right_column] == (r.r if r.r is None else pytest.approx(r.r)) for r in one.collect())
    assert all(r.r is None for r in gram.correlations(df.limit(0), df.columns).collect())


def test_a_thousand_columns_in_one_pass(spark):
    from tablewright.operators import gram

    df = spark.range(300).selectExpr(*[f"CAST(xxhash64(id, {i}) % 1000 AS DOUBLE) AS c{i}" for i in range(998)], "CAST(id AS DOUBLE) AS a", "CAST(5 - id AS DOUBLE) AS b")
    rows = gram.correlations(df, df.columns).where("abs(r) > 0.9").collect()
    assert [(r.left_column, r.right_column, round(r.r, 9)) for r in rows] == [("a", "b", -1.0)]
