"""Readers of the file formats that evaluation data comes in, all with explicit schemas."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import csv_line

#: One row per form and model of an evaluation run; failed rows have form, provider and error only.
RESULT_ROW = (
    "form string, provider string, cell_acc double, filled_recall double, blank_acc double, halluc_rate double, wrong_rate double, "
    "miss_rate double, header_acc double, extra_rows int, multiset_all_f1 double, per_col map<string,double>, verdict string, "
    "flags map<string,int>, latency_s double, model_calls int, error string"
)
QUESTION = "id string, bucket string, q string, gold string, note string"


def jsonl(spark: SparkSession, path: str, schema: str = RESULT_ROW) -> DataFrame:
    """Lines of JSON; keys that the schema lacks are ignored, lines that are no JSON become rows of nulls."""
    return spark.read.schema(schema).json(path)


def jsonl_without(spark: SparkSession, path: str, schema: str, marker: str = "__ERR__") -> DataFrame:
    """Lines of JSON that do not contain the marker anywhere."""
    lines = spark.read.text(path).where(~F.contains("value", F.lit(marker)))
    return lines.select(F.from_json("value", schema).alias("row")).select("row.*")


def json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of files that hold one JSON value each, an object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def catalogue(spark: SparkSession, path: str, schema: str, required: list[str], pattern: str = "*.json") -> DataFrame:
    """One row per JSON file below a folder that can be read and has all required keys; the others are skipped."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row")).select("path", "row.*")
    return rows.dropna(subset=required)


def html_files(spark: SparkSession, path: str, pattern: str = "index.html") -> DataFrame:
    """(path, html) of the pages of a tree of folders."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Lines of CSV as RFC 4180 has them: quotes where needed and doubled inside, lines ended by CR LF; the header is a file of its own."""
    lines = rows.select(csv_line(*[F.col(c) for c in rows.columns]).alias("value"))
    head = rows.sparkSession.createDataFrame([(",".join(rows.columns),)], "value string")
    head.coalesce(1).write.option("lineSep", "\r\n").mode("errorifexists").text(f"{path}/header")
    lines.write.option("lineSep", "\r\n").mode("errorifexists").text(f"{path}/rows")


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def question_bank(spark: SparkSession, path: str, schema: str = QUESTION) -> DataFrame:
    """Questions of JSON files that hold either an object with `questions` or the bare array."""
    whole = spark.read.text(path, wholetext=True)
    inside = F.from_json("value", f"struct<questions: array<struct<{schema}>>>")["questions"]
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{schema}>>"))
    return whole.select(F.explode(F.coalesce(bare, inside)).alias("q")).select("q.*")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(model, qid, rep, elapsed_s, body) of run files <model>/<qid>.md; the body is what follows the first --- line."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    head = F.split("value", "---\n", 2)
    name = F.split("path", "/")
    number = lambda pattern: F.nullif(F.regexp_extract(F.get(head, F.lit(0)), pattern, 1), F.lit("")).cast("int")
    return files.select(
        F.element_at(name, -2).alias("model"), F.regexp_replace(F.element_at(name, -1), r"\.md$", "").alias("qid"),
        number(r"rep(\d+) x").alias("rep"), number(r"elapsed: (\d+)s").alias("elapsed_s"), F.coalesce(F.get(head, F.lit(1)), F.col("value")).alias("body"),
    )


def markdown_entries(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the Markdown files of a folder in reading order, the read-me left out."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return files.where(F.lower("name") != "readme.md").orderBy("name")


def tree_listing(spark: SparkSession, path: str) -> DataFrame:
    """(group, name, bytes) of all files below a folder; group: the first folder below it, or "(top level)"."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    below = F.split(F.regexp_extract("path", f"/{re.escape(root)}/(.*)$", 1), "/")
    return files.select(F.when(F.size(below) > 1, F.get(below, F.lit(0))).otherwise("(top level)").alias("group"), F.element_at(below, -1).alias("name"), F.col("length").alias("bytes"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def _sheets(content: bytes) -> Iterator[tuple[int, str, ElementTree.Element, list[str]]]:
    """(number, name, tree, shared strings) of the sheets of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for number, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS)):
            target = targets[sheet.get(_REL)]
            yield number, sheet.get("name"), ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")), shared


def _cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of the non-empty cells of a workbook, rows and columns from 0."""
    for _, name, tree, shared in _sheets(content):
        for cell in tree.iterfind(".//m:c", _NS):
            kind, value = cell.get("t"), cell.find("m:v", _NS)
            text = "".join(t.text or "" for t in cell.iterfind(".//m:t", _NS)) if kind == "inlineStr" else value.text if value is not None else None
            if text:
                ref = cell.get("r")
                yield name, int(re.search(r"\d+", ref)[0]) - 1, _column(ref), shared[int(text)] if kind == "s" else text


def _grid(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(part, row, values) of the sheets `table` and `header`; of the first sheet as table where there is neither."""
    sizes = {}
    for number, name, tree, _ in _sheets(content):
        refs = [c.get("r") for c in tree.iterfind(".//m:c", _NS)]
        last = max([int(r.get("r")) for r in tree.iterfind(".//m:row", _NS)], default=0)
        sizes[name] = number, last, max(map(_column, refs), default=-1) + 1
    held: dict[str, dict] = {name: {} for name in sizes}
    for name, row, col, value in _cells(content):
        held[name].setdefault(row, {})[col] = value
    rows = lambda name: [(r, [held[name].get(r, {}).get(c) for c in range(sizes[name][2])]) for r in range(sizes[name][1])]
    table = rows("table") if "table" in sizes else []
    header = [(r, v) for r, v in (rows("header") if "header" in sizes else []) if any((x or "").strip() for x in v)]
    if not table and not header and sizes:
        table = rows(min(sizes, key=lambda name: sizes[name][0]))
    yield from (("table", r, v) for r, v in table)
    yield from (("header", r, v) for r, v in header)


def _workbooks(spark: SparkSession, path: str, read: Callable[[bytes], Iterator[tuple]], columns: list[str], schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = list(read(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                yield pd.DataFrame(rows, columns=columns).assign(path=file)[["path", *columns]]

    return files.mapInPandas(run, f"path string, {schema}")


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, value) of the non-empty cells of XLSX files; files that are none give no rows."""
    return _workbooks(spark, path, _cells, ["sheet", "row", "col", "value"], "sheet string, row int, col int, value string")


def grids(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, row, values) of grid workbooks: the rows of sheet `table` and of sheet `header`.

    Blank rows of the table stay, also at its end, as their number is part of the grid; blank rows of the header go. In a
    workbook that has neither, the first sheet is the table. Empty cells are nulls; files that are no workbook give no rows.
    """
    return _workbooks(spark, path, _grid, ["part", "row", "values"], "part string, row int, values array<string>")


def form_sheet(cells: DataFrame, sheet: str) -> DataFrame:
    """(path, row, fields map<string,string>) of a sheet whose first row has the names, lower-cased; nameless columns go."""
    own = cells.where(F.col("sheet") == sheet)
    names = own.where("row = 0").select("path", "col", F.lower(F.btrim("value")).alias("name")).where("name <> ''")
    named = own.where("row > 0").join(names, ["path", "col"])
    last = named.groupBy("path", "row", "name").agg(F.max_by("value", "col").alias("value"))
    return last.groupBy("path", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))

