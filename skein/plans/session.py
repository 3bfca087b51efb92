"""What every plan asks of a session: tables, this package on the executors, a shared folder for written tables."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark's reader opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="skein-ship-")
    target = os.path.join(folder, f"skein_{context.applicationId.replace('-', '_')}.zip")
    Path(target).write_bytes(buffer.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    ``spark.checkpoint.dir`` decides. Where it is unset, a folder of this
    machine serves a local master, as in tests; on a cluster that would lose
    rows without a word, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), f"skein-checkpoints-{os.getpid()}")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{scratch_root(spark)}/skein-{label}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def cut(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is never broadcast: of rows that a generator or Python made, Spark only knows the size of what they were made from."""
    return df.hint("merge")


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table; a session that is gone leaves nothing to do."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Remove the written table that ``cut`` made, when no plan reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/skein-" in folder:
            discard(df.sparkSession, folder)
