import json
import shutil
import zipfile

from plumbline.sources import readers
from plumbline.streaming import counts


def test_json_lines(spark, tmp_path):
    rows = [{"form": "a", "cell_acc": 0.5, "per_col": {"x": 1.0}, "other": 1}, {"form": "b", "error": "boom"}, {"form": "c", "error": "__ERR__ timeout"}]
    (tmp_path / "r.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = readers.jsonl(spark, str(tmp_path / "r.jsonl")).orderBy("form").collect()
    assert [(r.form, r.cell_acc, r.per_col, r.error) for r in got] == [("a", 0.5, {"x": 1.0}, None), ("b", None, None, "boom"), ("c", None, None, "__ERR__ timeout")]
    assert [r.form for r in readers.jsonl_without(spark, str(tmp_path / "r.jsonl"), readers.RESULT_ROW).orderBy("form").collect()] == ["a", "b"]
    readers.append_jsonl(spark.createDataFrame([("d",)], "form string"), str(tmp_path / "out"))
    readers.append_jsonl(spark.createDataFrame([("e",)], "form string"), str(tmp_path / "out"))
    assert readers.jsonl(spark, str(tmp_path / "out"), "form string").count() == 2


def test_banks_of_both_shapes(spark, tmp_path):
    questions = [{"id": "q1", "q": "How many?", "gold": "25"}, {"id": "q2", "q": "Where?"}]
    (tmp_path / "a.json").write_text(json.dumps({"questions": questions}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(questions))
    assert sorted((r.id, r.gold) for r in readers.question_bank(spark, str(tmp_path)).collect()) == sorted([("q1", "25"), ("q2", None)] * 2, key=repr)


def test_transcripts_entries_and_listing(spark, tmp_path):
    (tmp_path / "runs/m1").mkdir(parents=True)
    (tmp_path / "runs/m1/q1.md").write_text("# q1 rep2 x m1\nQ: how?\nelapsed: 47s attempt:1\n---\nIt is 25.\n---\nmore")
    (tmp_path / "runs/README.md").write_text("no header")
    got = {r.qid: r for r in readers.transcripts(spark, str(tmp_path / "runs")).collect()}
    assert (got["q1"].model, got["q1"].rep, got["q1"].elapsed_s, got["q1"].body) == ("m1", 2, 47, "It is 25.\n---\nmore")
    assert got["README"].body == "no header" and got["README"].rep is None
    (tmp_path / "runs/b.md").write_text("# b")
    (tmp_path / "runs/a.md").write_text("# a")
    assert [r.name for r in readers.markdown_entries(spark, str(tmp_path / "runs")).collect()] == ["a.md", "b.md"]
    assert sorted((r.group, r.name) for r in readers.tree_listing(spark, str(tmp_path / "runs")).collect()) == [("(top level)", "README.md"), ("(top level)", "a.md"), ("(top level)", "b.md"), ("m1", "q1.md")]


def test_workbooks(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "f.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="survey" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Type </t></si><si><r><t>NA</t></r><r><t>ME</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>text</t></is></c><c r="B3"><v>9</v></c><c r="C3"><v>2.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "broken.xlsx").write_text("no workbook")
    cells = readers.workbook_cells(spark, str(tmp_path))
    assert sorted((r.row, r.col, r.value) for r in cells.collect()) == [(0, 0, "Type "), (0, 2, "NAME"), (2, 0, "text"), (2, 1, "9"), (2, 2, "2.5")]
    assert [(r.row, r.fields) for r in readers.form_sheet(cells, "survey").collect()] == [(2, {"name": "2.5", "type": "text"})]


def test_a_stream_takes_each_file_once_and_counts_by_window(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    half = tmp_path / "in"
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(str(half))
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    stream = lambda: counts.parquet_stream(spark, str(half), schema, 1)
    for _ in range(2):
        counts.run_available(stream().select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.where("event_id % 2 = 0").count()
    events.where("event_id % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "rest"))
    for f in (tmp_path / "rest").glob("part-*"):
        shutil.copy(f, half / f"late-{f.name}")
    counts.run_available(stream().select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    daily = counts.windowed_counts(counts.parquet_stream(spark, str(half), schema), "ts", "1 day", "40 days", "event_type")
    query = daily.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("daily").selectExpr("sum(value)").first()[0] == events.count()


def _book(path, sheets):
    """A small workbook: sheet name -> rows of cell texts, None for no cell."""
    import zipfile

    letters = "ABCDEFG"
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{letters[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')


def test_grids_keep_blank_table_rows_and_drop_blank_header_rows(spark, tmp_path):
    _book(tmp_path / "a.xlsx", {"table": [["S.No", "Name"], ["1", "Asha"], ["2", None], [None, None]], "header": [["Date", "01-02-2025"], [" ", None], ["Place"]]})
    _book(tmp_path / "b.xlsx", {"Sheet1": [["x"], [None], ["y"]], "other": [["z"]]})
    (tmp_path / "c.xlsx").write_text("no workbook")
    got = {}
    for r in readers.grids(spark, str(tmp_path)).orderBy("path", "part", "row").collect():
        got.setdefault((r.path[-6:], r.part), []).append(r["values"])
    assert got == {
        ("a.xlsx", "table"): [["S.No", "Name"], ["1", "Asha"], ["2", None], [None, None]], ("a.xlsx", "header"): [["Date", "01-02-2025"], ["Place", None]],
        ("b.xlsx", "table"): [["x"], [None], ["y"]],
    }


def test_catalogues_pages_and_whole_files(spark, tmp_path):
    for name, text in (("a/template.json", '{"form_id": "PRAB2Z", "title": "A",\n "rows": 3}'), ("b/template.json", "{broken"), ("c/template.json", '{"title": "no id"}'), ("d/other.json", '{"form_id": "x", "title": "y"}')):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    found = readers.catalogue(spark, str(tmp_path), "form_id string, title string, rows int", ["form_id", "title"], "template.json").collect()
    assert [(r.form_id, r.title, r.rows) for r in found] == [("PRAB2Z", "A", 3)]
    (tmp_path / "a" / "index.html").write_text("<p>\n</p>")
    (tmp_path / "index.html").write_text("top")
    assert sorted(r.html for r in readers.html_files(spark, str(tmp_path)).collect()) == ["<p>\n</p>", "top"]
    (tmp_path / "m.json").write_text('[{"name": "a",\n"n": 1}, {"name": "b"}]')
    assert [tuple(r) for r in readers.json_file(spark, str(tmp_path / "m.json"), "name string, n int").orderBy("name").collect()] == [("a", 1), ("b", None)]


def test_csv_files_have_crlf_and_quotes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, "line\nbreak"), (3, None)], "n int, t string").coalesce(1)
    readers.write_csv(rows, str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for part in ("header", "rows") for p in sorted((tmp_path / "out" / part).glob("part-*")))
    assert text == b'n,t\r\n1,"a ""b"", c"\r\n2,"line\nbreak"\r\n3,\r\n'
