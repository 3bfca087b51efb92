"""Open documents as a stream: edits with state and timers, debounced checks, replacement by file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skein.functions.edits import fold
from skein.operators.merge import remove_files, unused_name
from skein.plans.session import cut, ship

DEBOUNCE_MS = 300
EVENT = "uri string, kind string, version int, text string, edits array<struct<line:int,ch:int,to_line:int,to_ch:int,text:string>>"
DOCUMENT = "uri string, version int, text string, open boolean, settled boolean"
#: Stateful operators of this kind need Spark's RocksDB store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Documents(StatefulProcessor):
    """One open document: its text as of the last settled version, the edits since, and the timer that settles them.

    Each batch of events gives the document as it is (``settled`` false); when no event came for ``gap_ms`` a timer
    folds the edits into the text and gives it once more, settled. Closing forgets the document; so does an idle
    time of ``ttl_ms``, where one is given.
    """

    def __init__(self, gap_ms: int, ttl_ms: int | None):
        self.gap_ms, self.ttl_ms = gap_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "version int, text string, newest int, due long", self.ttl_ms)
        self.edits = handle.getListState("edits", "line int, ch int, to_line int, to_ch int, text string", self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self.base.update((int(first["version"]), first["text"] or "", int(first["version"]), -1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("version", kind="stable")
        base = self.base.get() if self.base.exists() else None
        pending, last = [], -1
        for e in events.itertuples(index=False):
            if e.kind == "close":
                base, last, pending = None, e.version, []
                self.edits.clear()
            elif e.kind == "open":
                base, pending = (e.version, e.text or "", e.version, base[3] if base else -1), []
                self.edits.clear()
            elif base is not None and e.version > base[2]:  # a stale version changes nothing
                pending += [(x["line"], x["ch"], x["to_line"], x["to_ch"], x["text"]) for x in (e.edits if e.edits is not None else [])]
                base = (base[0], base[1], e.version, base[3])
        if base is None:
            if self.base.exists():
                self._forget_timer(self.base.get()[3])
                self.base.clear()
            yield _row(key[0], last if last >= 0 else int(events["version"].max()), None, False)
            return
        if pending:
            self.edits.appendList(pending)
        self._forget_timer(base[3])
        due = timerValues.getCurrentProcessingTimeInMs() + self.gap_ms
        self.handle.registerTimer(due)
        self.base.update((base[0], base[1], base[2], due))
        yield _row(key[0], base[2], fold(base[1], self.edits.get()), False)

    def _forget_timer(self, due: int) -> None:
        if due >= 0:
            self.handle.deleteTimer(due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.base.exists():
            return
        _, text, newest, _ = self.base.get()
        text = fold(text, self.edits.get())
        self.edits.clear()
        self.base.update((newest, text, newest, -1))
        yield _row(key[0], newest, text, True)

    def close(self) -> None:
        pass


def _row(uri: str, version: int, text: str | None, settled: bool) -> pd.DataFrame:
    return pd.DataFrame([(uri, version, text, text is not None, settled)], columns=["uri", "version", "text", "open", "settled"])


def documents(events: DataFrame, gap_ms: int = DEBOUNCE_MS, ttl_ms: int | None = None, opened: DataFrame | None = None) -> DataFrame:
    """Each document (``DOCUMENT``) after each batch of its events, and once more when it has been left alone for ``gap_ms``.

    ``opened`` (uri, version, text) are documents that are open when the stream begins.
    """
    spark = events.sparkSession
    ship(spark)
    if spark.conf.get(STORE[0], "") != STORE[1]:
        raise RuntimeError(f"set {STORE[0]} to {STORE[1]}: Spark keeps this kind of state nowhere else")
    start = None if opened is None else opened.select("uri", "version", "text").groupBy("uri")
    return events.groupBy("uri").transformWithStateInPandas(
        statefulProcessor=Documents(gap_ms, ttl_ms), outputStructType=DOCUMENT, outputMode="Append", timeMode="ProcessingTime", initialState=start
    )


def debounced(changes: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(uri, version) of a stream of changes: versions that no later one followed within the gap."""
    events = changes.select("uri", F.lit("open").alias("kind"), "version", F.lit("").alias("text"), F.lit(None).cast(EVENT.partition("edits ")[2]).alias("edits"))
    return documents(events, gap_ms).where("settled").select("uri", "version")


def settled(events: DataFrame, keys: list[str], ts: str, order: str, gap: Column) -> DataFrame:
    """The same rule over recorded events: those that no later event of the key follows within the gap."""
    after = unused_name(events, "_next")
    marked = events.withColumn(after, F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, order)))
    return marked.where(F.col(after).isNull() | (F.col(after) > F.col(ts) + gap)).drop(after)


class FileTable:
    """Rows by file in a plain parquet table, partitioned by a hash of the file and replaced a batch at a time.

    A batch rewrites the partitions that its files fall in, by Spark's own dynamic overwrite, and no others. Replacing
    is idempotent, so a batch that a stream plays again does no harm whatever its number, and streams with
    checkpoints of their own may follow each other on one table.
    """

    BUCKETS = 64
    BUCKET = "file_bucket"

    def __init__(self, path: str, file: str = "file"):
        self.path, self.file = path.rstrip("/"), file

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.file), F.lit(self.BUCKETS)).cast("int")

    def _exists(self, spark: SparkSession) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, like: DataFrame) -> DataFrame:
        """The rows of the table, with the columns of ``like``."""
        spark = like.sparkSession
        if not self._exists(spark):
            return like.limit(0)
        # A partition that lost its last file holds one row without a file.
        return spark.read.schema(like.schema).parquet(self.path).where(F.col(self.file).isNotNull()).select(like.columns)

    def replace(self, rows: DataFrame, deleted: DataFrame | None = None) -> None:
        """The rows' files, and those deleted, give way to the rows."""
        spark = rows.sparkSession
        rows = cut(rows, "replaced")
        files = rows.select(self.file)
        files = cut((files if deleted is None else files.unionByName(deleted.select(self.file))).distinct().withColumn(self.BUCKET, self._bucket()), "touched")
        buckets = [r[0] for r in files.select(self.BUCKET).distinct().collect()]  # at most BUCKETS numbers
        if not buckets:
            return
        old = rows.limit(0)
        if self._exists(spark):
            held = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(self.BUCKET, T.IntegerType())])).parquet(self.path).where(F.col(self.BUCKET).isin(buckets))
            old = remove_files(held.where(F.col(self.file).isNotNull()), files, self.file).select(rows.columns)
        every = old.unionByName(rows).withColumn(self.BUCKET, self._bucket())
        marks = files.select(self.BUCKET).distinct().select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema], self.BUCKET)
        # What is written is read of the partitions that it replaces, so it is cut first.
        whole = cut(every.unionByName(marks), "whole")
        whole.repartition(len(buckets), self.BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.BUCKET).parquet(self.path)

    def sink(self, stream: DataFrame, checkpoint: str):
        """A streaming query that keeps this table current."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: self.replace(rows)).start()
