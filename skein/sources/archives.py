"""Archives as a data source: entries read by ranges, pruned by the archive's own directory.

``read_entries`` (``spark.read.format("entries")``) lists the archives under a folder and reads
them in parallel, a large one in several tasks, each entry on its own. With
``spark.sql.python.filterPushdown.enabled`` a filter ``path = 'archive!/entry'``
(or on ``source_path``) leaves the others unread, as the option ``entry`` does. Whatever is damaged is a row with its
problem: an archive, an entry, or one that is too long to be a source.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from skein.plans.session import ship

ENTRY = "path string, text string, mtime long, source_path string, problem string"
ARCHIVES = re.compile(r"[.](?:jar|zip)$")
#: Bytes of small archives that one task reads, entries of a large one that it reads, bytes of the longest source.
TASK_BYTES, TASK_ENTRIES, LONGEST = 64 << 20, 2_000, 64 << 20
#: What damaged archives and entries raise.
DAMAGE = (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error, EOFError, OSError, ValueError, struct.error, LookupError, MemoryError)


def plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


@dataclass
class Part(InputPartition):
    """Archives (path, mtime) of a task; of a single one perhaps only the entries from ``start`` to ``stop``."""

    archives: list[tuple[str, int]]
    start: int = 0
    stop: int | None = None


def entries_of(store: fs.FileSystem, path: str, mtime: int, wanted: re.Pattern, only: str | None = None, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """Rows (``ENTRY``) of one archive; what is not asked for is not read."""
    try:
        archive = zipfile.ZipFile(store.open_input_file(path))
        listed = archive.infolist()[start:stop]
    except DAMAGE as fault:
        if start == 0:
            yield path, None, mtime, path, _said(fault)
        return
    with archive:
        for info in listed:
            if not wanted.search(info.filename) or (only is not None and info.filename != only):
                continue
            text, problem = None, None
            try:
                if info.file_size > LONGEST:
                    raise ValueError(f"longer than {LONGEST} bytes")
                with archive.open(info) as stream:
                    data = stream.read(LONGEST + 1)
                if len(data) > LONGEST:
                    raise ValueError(f"longer than {LONGEST} bytes")
                text = data.decode("utf-8", "replace")
            except DAMAGE as fault:
                problem = _said(fault)
            yield f"{path}!/{info.filename}", text, mtime, path, problem


def _said(fault: BaseException) -> str:
    return f"{type(fault).__name__}: {fault}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


class EntryReader(DataSourceReader):
    def __init__(self, root: str, pattern: str, entry: str | None):
        self.root, self.pattern = root, pattern
        self.archives: set[str] | None = None
        self.entry: str | None = entry

    def narrow(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",) and "!/" in str(f.value) and self.entry is None:
                archive, _, self.entry = str(f.value).partition("!/")
                self._only({archive})
            elif isinstance(f, EqualTo) and f.attribute == ("source_path",):
                self._only({str(f.value)})
            elif isinstance(f, In) and f.attribute == ("source_path",):
                self._only(set(map(str, f.value)))
            yield f  # a damaged archive's row has another path: Spark looks at what comes out

    def _only(self, archives: set[str]) -> None:
        self.archives = archives if self.archives is None else self.archives & archives

    def partitions(self) -> list[Part]:
        store, where = fs.FileSystem.from_uri(self.root)
        info = store.get_file_info(where)
        listed = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True))
        hidden = re.compile(r"/[._]")
        found = [
            (f.path, int(f.mtime.timestamp()) if f.mtime else 0, f.size) for f in sorted(listed, key=lambda f: f.path)
            if f.type == fs.FileType.File and ARCHIVES.search(f.path) and not hidden.search(f.path[len(where) :]) and (self.archives is None or f.path in self.archives)
        ]
        parts, group, held = [], [], 0
        for path, mtime, size in found:
            if size > TASK_BYTES:
                parts += self._slices(store, path, mtime)
                continue
            if held + size > TASK_BYTES and group:
                parts.append(Part(group))
                group, held = [], 0
            group.append((path, mtime))
            held += size
        return [*parts, Part(group)] if group or not parts else parts

    def _slices(self, store: fs.FileSystem, path: str, mtime: int) -> list[Part]:
        """Tasks of a large archive, by places in its directory."""
        try:
            with zipfile.ZipFile(store.open_input_file(path)) as archive:
                n = len(archive.infolist())
        except DAMAGE:
            return [Part([(path, mtime)])]
        return [Part([(path, mtime)], k, k + TASK_ENTRIES) for k in range(0, max(n, 1), TASK_ENTRIES)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.root)
        wanted = re.compile(self.pattern)
        for path, mtime in partition.archives:
            for row in entries_of(store, path, mtime, wanted, self.entry, partition.start, partition.stop):
                yield _batch([row])


class PushedReader(EntryReader):
    """Where the session hands filters to data sources (a reader that takes them may not stand elsewhere)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.narrow(filters)


class EntrySource(DataSource):
    """Options: the folder or archive (``path``), ``pattern`` of entries, ``entry`` to read alone, ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return "entries"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushedReader if self.options.get("pushdown") == "true" else EntryReader
        return kind(self.options["path"], self.options.get("pattern", ""), self.options.get("entry"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(EntrySource)


def read_entries(spark: SparkSession, root: str, pattern: str, entry: str | None = None) -> DataFrame:
    """Entries of the archives under a root whose names fit ``pattern`` (columns ``ENTRY``)."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("entries").option("pattern", pattern).option("pushdown", pushdown.lower())
    return (reader if entry is None else reader.option("entry", entry)).load(root)


def entry_text(spark: SparkSession, path: str) -> DataFrame:
    """The row of one entry by its path ``archive!/entry``: its archive's directory and that entry are read, nothing else."""
    archive, _, entry = path.partition("!/")
    return read_entries(spark, archive, f"^{re.escape(entry)}$", entry)


def entries_in(archives: DataFrame, pattern: str) -> DataFrame:
    """Entries of the archives of a table (path, mtime), which may be any number, read where they are dealt."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(pattern)
        for batch in batches:
            for path, mtime in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri(path)
                for _, text, _, _, problem, name in ((*r, r[0].removeprefix(where)) for r in entries_of(store, where, mtime, wanted)):
                    yield _batch([(f"{path}{name}", text, mtime, path, problem)])

    return archives.select("path", "mtime").mapInArrow(run, ENTRY)


def archive_bytes(entries: dict[str, str]) -> bytes:
    """An archive of the given texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in entries.items():
            archive.writestr(name, text)
    return out.getvalue()
