"""A project folder kept current: its changes as a stream, and what each of them asks for.

The stream's offsets are listings. A listing that differs from the last one is
written below a folder of its own under the digest of its content, and the
offset is that digest; a batch is the difference of two listings, dealt out in
slices. Spark's checkpoint holds the offsets, so after a restart the difference
is taken to the listing that was handled last, and each change arrives once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from skein.operators.editing import route_changes
from skein.plans.session import cut, ship
from skein.sources.code import PACKED, extract, is_source
from skein.sources.ignore import ignore_rules, kept
from skein.streaming.documents import FileTable

LISTED = "path string, mtime timestamp, length long"
CHANGE = "path string, kind string, mtime long, length long"
#: Changes that one task hands out.
TASK_CHANGES = 10_000


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length) of the files under a root that its ignore files leave; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("mtime"), "length")
    return kept(found, ignore_rules(found.select("path"), root), root)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind): files created, changed (in time or size) or deleted between two listings."""
    old, new = (x.select("path", F.struct("mtime", "length").alias(n)) for x, n in ((before, "old"), (after, "new")))
    kind = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, "path", "full_outer").select("path", kind.alias("kind")).where("kind is not null")


@dataclass
class Slice(InputPartition):
    """Changes between two listings from one place to another, in order of their paths."""

    before: str
    after: str
    start: int
    stop: int


class FolderStream(DataSourceStreamReader):
    """Offsets ``{"at": digest of a listing}``; the empty digest is the empty listing."""

    def __init__(self, root: str, state: str):
        self.root, self.state = root.rstrip("/"), state.rstrip("/")

    def _listed(self) -> dict[str, list[int]]:
        store, where = fs.FileSystem.from_uri(self.root)
        hidden = re.compile(r"/[._](?!gitignore$|ignore$)")
        found = {}
        for f in store.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File and not hidden.search(f.path[len(where) :]):
                found[f.path] = [f.mtime_ns or 0, f.size]
        return found

    def _file(self, digest: str) -> tuple[fs.FileSystem, str]:
        store, where = fs.FileSystem.from_uri(self.state)
        return store, f"{where}/{digest}.json"

    def _load(self, digest: str) -> dict[str, list[int]]:
        if not digest:
            return {}
        store, name = self._file(digest)
        with store.open_input_stream(name, compression=None) as stream:
            return json.loads(stream.read())

    def initialOffset(self) -> dict:
        return {"at": ""}

    def latestOffset(self) -> dict:
        text = json.dumps(self._listed(), sort_keys=True).encode()
        digest = hashlib.sha256(text).hexdigest() if text != b"{}" else ""
        if digest:
            store, name = self._file(digest)
            if store.get_file_info(name).type != fs.FileType.File:
                store.create_dir(name.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{name}.part", compression=None) as out:
                    out.write(text)
                store.move(f"{name}.part", name)
        return {"at": digest}

    def _changes(self, before: str, after: str) -> list[tuple[str, str, int, int]]:
        old, new = self._load(before), self._load(after)
        out = []
        for path in sorted(old.keys() | new.keys()):
            if path not in new:
                out.append((path, "deleted", *old[path]))
            elif old.get(path) != new[path]:
                out.append((path, "changed" if path in old else "created", *new[path]))
        return out

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        n = len(self._changes(start["at"], end["at"]))
        return [Slice(start["at"], end["at"], k, min(n, k + TASK_CHANGES)) for k in range(0, n, TASK_CHANGES)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows = self._changes(partition.before, partition.after)[partition.start : partition.stop]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "kind", "mtime", "length"])

    def commit(self, end: dict) -> None:
        """Listings that no offset to come needs go: all but the one handled and those written since."""
        store, where = fs.FileSystem.from_uri(self.state)
        kept_file = f"{end['at']}.json"
        infos = [f for f in store.get_file_info(fs.FileSelector(where, allow_not_found=True)) if f.path.endswith(".json")]
        handled = next((f for f in infos if f.path.endswith(f"/{kept_file}")), None)
        for f in infos:
            # One batch back is kept too: a batch that was not committed in Spark's log is played again from there.
            if handled is not None and f.path != handled.path and f.mtime_ns < handled.mtime_ns - 3_600 * 10**9:
                store.delete_file(f.path)


class FolderSource(DataSource):
    """Options: the folder (``path``) and ``state``, a shared folder for its listings."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStream(self.options["path"], self.options["state"])


def folder_changes(spark: SparkSession, root: str, state: str) -> DataFrame:
    """A stream (``CHANGE``) of the files created, changed (in time or size) or deleted under a root."""
    ship(spark)
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("folder_changes").option("state", state).load(root)


def apply_changes(spark: SparkSession, root: str, table: FileTable, met: DataFrame) -> DataFrame:
    """Bring a table of packed files up to date with changes (path, kind); returns them routed (path, kind, action).

    Changed sources are extracted again and deleted ones leave with all their relations; where settings or an ignore
    file of the project changed, every source is extracted again and what is ignored now leaves. Changes of libraries
    are the caller's (``sources.cache``). Doing it twice does no harm.
    """
    met = cut(met.select("path", "kind"), "met")
    routed = cut(met.join(route_changes(met), "path"), "changes")
    now = cut(listing(spark, root), "listing")
    sources = now.where(is_source(F.col("path")) | F.endswith("path", F.lit(".edn"))).select("path")
    wanted = routed.where("action = 'extract'").select("path")
    gone = routed.where("kind = 'deleted'").select("path")
    if not routed.where("action = 'rebuild'").isEmpty():
        wanted = sources
        gone = gone.unionByName(read(spark, table).select("path").join(sources, "path", "left_anti")).distinct()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    texts = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))
    table.replace(extract(texts.join(wanted.join(sources, "path", "left_semi"), "path", "left_semi")), gone)
    return routed


def refresh(spark: SparkSession, root: str, table: FileTable, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Compare the folder with an earlier listing once and apply what changed; returns the listing now and the routed changes.

    Without ``before`` this is the start-up of a project.
    """
    now = cut(listing(spark, root), "listing")
    before = spark.createDataFrame([], LISTED) if before is None else before
    return now, apply_changes(spark, root, table, changes(before, now))


def watch(spark: SparkSession, root: str, table: FileTable, checkpoint: str, on_libraries=None):
    """A streaming query that keeps the table current with the folder; changes of libraries go to ``on_libraries``."""

    def batch(met: DataFrame, _: int) -> None:
        routed = apply_changes(met.sparkSession, root, table, met)
        libraries = routed.where("action = 'libraries'")
        if on_libraries is not None and not libraries.isEmpty():
            on_libraries(libraries)

    stream = folder_changes(spark, root, f"{checkpoint.rstrip('/')}-listings")
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)


def read(spark: SparkSession, table: FileTable) -> DataFrame:
    """The packed files of a table that is kept current."""
    return table.read(spark.createDataFrame([], PACKED))
