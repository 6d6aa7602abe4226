"""XLSX files as a Spark data source: spark.read.format("workbook").option("part", "cells").load(folder)."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from plumbline.sources.readers import _cells, _grid

_SCHEMAS = {
    "cells": "path string, sheet string, row int, col int, value string",
    "grid": "path string, part string, row int, values array<string>",
}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)


def _at(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path on it, and what stands before such paths; a path without scheme is a local or mounted one."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path), ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: path.index(inner)] if inner in path else ""


@dataclass
class _Files(InputPartition):
    """The files of one task."""

    paths: list[str]


class Workbooks(DataSource):
    """Options: part (`cells`, the default, or `grid`), bytes_per_task, and filters (`true`).

    A folder is listed with all below it; files are packed into tasks by size, the largest first, none of them split. Only
    columns of the given schema are handed on: `.schema("path string, value string")` reads two of them. With `filters`, which
    needs spark.sql.python.filterPushdown.enabled, filters on path keep other files from being opened. Files that are no
    workbook give no rows, as do folders without any.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return _SCHEMAS[_part(self.options)]

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _FilteredReader if self.options.get("filters") == "true" else _Reader
        return kind(schema.fieldNames(), _part(self.options), self.options["path"], int(self.options.get("bytes_per_task", 64 << 20)))


def _part(options: dict) -> str:
    part = options.get("part", "cells")
    if part not in _SCHEMAS:
        raise ValueError(f"part is one of {sorted(_SCHEMAS)}, not {part!r}")
    return part


class _Reader(DataSourceReader):
    def __init__(self, columns: list[str], part: str, path: str, size: int) -> None:
        own = [field.split()[0] for field in _SCHEMAS[part].split(", ")]
        if unknown := [c for c in columns if c not in own]:
            raise ValueError(f"{part} has no columns {unknown}")
        self.places, self.part, self.path, self.size = [own.index(c) for c in columns], part, path, size
        self.only: set[str] | None = None

    def partitions(self) -> list[_Files]:
        system, inner, head = _at(self.path)
        info = system.get_file_info(inner)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
        files = [(f.size, head + f.path) for f in found if f.is_file and f.path.endswith(".xlsx")]
        files = [(n, p) for n, p in files if self.only is None or p in self.only]
        tasks: list[_Files] = []
        room = 0
        for n, path in sorted(files, reverse=True):
            if not tasks or n > room:
                tasks.append(_Files([]))
                room = self.size
            tasks[-1].paths.append(path)
            room -= n
        return tasks or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            system, inner, _ = _at(path)
            with system.open_input_stream(inner) as stream:
                content = stream.read()
            try:
                rows = list((_cells if self.part == "cells" else _grid)(content))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                continue
            for row in rows:
                whole = (path, *row)
                yield tuple(whole[k] for k in self.places)


class _FilteredReader(_Reader):
    """Spark refuses readers that take filters where its setting is off, so this one is asked for by option."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("path",):
                self.only = values if self.only is None else self.only & values
            else:
                yield f  # Spark applies it
