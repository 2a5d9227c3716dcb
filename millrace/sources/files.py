"""Files of a folder as batch data sources: their names, their rows by header, their first marked line.

A partition is a piece of a large file or several small files. Every piece finds the header of
its file itself, so one read of a folder is enough, a large file is read by many tasks and an
empty file is known without a scan. Files are opened by Arrow, on the driver for the listing and
in tasks for the content; ``opens`` tells whether it knows the store of a path.
"""

from __future__ import annotations

import csv
import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.session import ship_package

BLOCK_BYTES = 4 << 20
#: What opening a file costs, in bytes read.
OPEN_BYTES = 1 << 20
PIECE_BYTES = 64 << 20
BATCH_ROWS = 8192


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    local = re.match(r"file:/+(?=/|[^/])", path)
    if local or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path[local.end() :] if local else path
    return pafs.FileSystem.from_uri(path)


def opens(path: str) -> bool:
    """Whether Arrow opens the store of a path; others are left to Spark's own readers."""
    try:
        _store(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def exists(path: str) -> bool:
    store, inner = _store(path)
    found = store.get_file_info(re.split(r"/[^/]*[*?\[]", inner)[0])
    return found.type != pafs.FileType.NotFound


def list_files(path: str, names: str = "*") -> list[tuple[str, int]]:
    """Path in the store and size of every file of a folder, of a pattern, or of the one file named."""
    store, inner = _store(path)
    inner = inner.rstrip("/")
    if re.search(r"[*?\[]", inner):
        base = re.split(r"/[^/]*[*?\[]", inner)[0]
        found = store.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        found = [f for f in found if f.path.count("/") == inner.count("/") and fnmatch.fnmatchcase(f.path, inner)]
    else:
        (info,) = store.get_file_info([inner])
        found = [info]
        if info.type == pafs.FileType.Directory:
            found = store.get_file_info(pafs.FileSelector(inner))
    return sorted(
        (f.path, f.size) for f in found
        if f.is_file and not f.base_name.startswith(("_", ".")) and fnmatch.fnmatchcase(f.base_name, names)
    )


def _named(path: str, inner: str) -> str:
    """The path of a file as Spark writes it."""
    if path.startswith("file:") or "://" not in path:
        return f"file:{inner}"
    return path.split("://")[0] + "://" + inner if path.startswith(("s3", "gs", "gcs")) else inner


@dataclass
class Pieces(InputPartition):
    """Parts of files: path in the store, first byte, byte after the last."""

    parts: list[tuple[str, int, int]]


def cut_pieces(files: list[tuple[str, int]], piece_bytes: int) -> list[Pieces]:
    """Large files cut, small ones together."""
    pieces, held, filled = [], [], 0
    for path, size in files:
        for begin in range(0, max(size, 1), piece_bytes):
            end = min(size, begin + piece_bytes)
            if held and filled + end - begin + OPEN_BYTES > piece_bytes:
                pieces.append(Pieces(held))
                held, filled = [], 0
            held.append((path, begin, end))
            filled += end - begin + OPEN_BYTES
    return [*pieces, Pieces(held)] if held else pieces


def blocks_of(file, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Whole lines, many at a time, of those that begin within [begin, end), and where each block begins."""
    at = max(0, begin - 1)
    file.seek(at)
    left, skipping = b"", begin > 0
    while True:
        block = file.read(BLOCK_BYTES)
        data = left + block
        if skipping:  # the line that the piece before ends with
            cut = data.find(b"\n") + 1
            if not cut:
                if not block or at + len(data) >= end:
                    return
                at, left = at + len(data), b""
                continue
            at, data, skipping = at + cut, data[cut:], False
        if at >= end:
            return
        if not block:
            if data:
                yield at, data
            return
        last = data.find(b"\n", max(0, end - 1 - at)) + 1 if at + len(data) >= end else 0
        whole = last or data.rfind(b"\n") + 1
        if whole:
            yield at, data[:whole]
        if last:
            return
        at, left = at + whole, data[whole:]


def _header(store: pafs.FileSystem, path: str) -> str:
    """The first line that is not blank."""
    with store.open_input_file(path) as file:
        for _, block in blocks_of(file, 0, file.size()):
            for line in block.split(b"\n"):
                if line.strip():
                    return line.decode("utf-8", "replace").rstrip("\r")
    return ""


def _cells(line: str) -> list[str]:
    return next(csv.reader([line])) if '"' in line else line.split(",")


class _Files(DataSource):
    """A folder, the names that count and the bytes of a piece, from options."""

    @property
    def path(self) -> str:
        return self.options["path"]

    def files(self) -> list[tuple[str, int]]:
        return list_files(self.path, self.options.get("names", "*"))

    def pieces(self) -> list[Pieces]:
        return cut_pieces(self.files(), int(self.options.get("piece_bytes", PIECE_BYTES)))


class NamedFiles(_Files):
    """``path`` and ``name`` of every file."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, name string"

    def reader(self, schema) -> DataSourceReader:
        return _NameReader(self)


@dataclass
class _NameReader(DataSourceReader):
    source: _Files

    def partitions(self) -> list[InputPartition]:
        files = self.source.files()
        return [Pieces([(p, 0, n) for p, n in files[k : k + BATCH_ROWS]]) for k in range(0, len(files), BATCH_ROWS)] or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        paths = [_named(self.source.path, p) for p, _, _ in partition.parts]
        names = [p.rsplit("/", 1)[-1] for p in paths]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string())], names=["path", "name"])


class RowsByHeader(_Files):
    """Rows of CSV files whose headers differ: ``file_name`` and the columns of option ``fields``, taken by name.

    Lines that are blank or repeat the header are no rows. Cells are trimmed; empty and absent ones are null.
    """

    @classmethod
    def name(cls) -> str:
        return "rows_by_header"

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in ("file_name", *self.options["fields"].split(",")))

    def reader(self, schema) -> DataSourceReader:
        return _RowReader(self)


@dataclass
class _RowReader(DataSourceReader):
    source: _Files

    def partitions(self) -> list[InputPartition]:
        return self.source.pieces() or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.source.path)
        fields = self.source.options["fields"].split(",")
        for path, begin, end in partition.parts:
            if begin == end:
                continue
            header = _header(store, path)
            names = [n.strip() for n in _cells(header)]
            places = [names.index(f) if f in names else None for f in fields]
            with store.open_input_file(path) as file:
                rows = []
                for _, block in blocks_of(file, begin, end):
                    for line in block.decode("utf-8", "replace").split("\n"):
                        line = line.rstrip("\r")
                        if line.strip() and line != header:
                            rows.append(_cells(line))
                            if len(rows) >= BATCH_ROWS:
                                yield self._batch(path, fields, places, rows)
                                rows = []
                if rows:
                    yield self._batch(path, fields, places, rows)

    @staticmethod
    def _batch(path: str, fields: list[str], places: list[int | None], rows: list[list[str]]) -> pa.RecordBatch:
        columns = [[path.rsplit("/", 1)[-1]] * len(rows)]
        for at in places:
            columns.append([None] * len(rows) if at is None else [(r[at].strip() or None) if at < len(r) else None for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["file_name", *fields])


class MarkedLines(_Files):
    """``path``, ``at`` and ``line``: of every piece the first line that begins with option ``marker``, blanks aside.

    Every file has a row besides, without a line.
    """

    @classmethod
    def name(cls) -> str:
        return "marked_lines"

    def schema(self) -> str:
        return "path string, at long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _MarkReader(self)


@dataclass
class _MarkReader(DataSourceReader):
    source: _Files

    def partitions(self) -> list[InputPartition]:
        return self.source.pieces() or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.source.path)
        marker = self.source.options["marker"].encode()
        rows = []
        for path, begin, end in partition.parts:
            named = _named(self.source.path, path)
            if not begin:
                rows.append((named, None, None))
            if begin < end:
                with store.open_input_file(path) as file:
                    found = self._first(file, begin, end, marker)
                if found:
                    rows.append((named, *found))
        columns = zip(*rows) if rows else ([], [], [])
        kinds = (pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "at", "line"])

    @staticmethod
    def _first(file, begin: int, end: int, marker: bytes) -> tuple[int, str] | None:
        for at, block in blocks_of(file, begin, end):
            found = block.find(marker)
            while found >= 0:
                start = block.rfind(b"\n", 0, found) + 1
                if not block[start:found].strip():
                    stop = block.find(b"\n", found)
                    line = block[start : stop if stop >= 0 else len(block)]
                    return at + start, line.decode("utf-8", "replace")
                found = block.find(marker, found + 1)
        return None


def load(spark: SparkSession, source: type[_Files], path: str, **options: object) -> DataFrame:
    """A source of this module over a path; nothing is read yet."""
    ship_package(spark)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{"piece_bytes": PIECE_BYTES, **options}).load(path)
