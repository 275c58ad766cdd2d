"""Helpers shared by the corpus operators: table access, scratch tables and Arrow loops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch; long texts make larger batches a memory risk.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Rows of one row group of the files that tasks write themselves.
GROUP_ROWS = 1 << 16
#: Whether the shuffle files of an action go when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for tables of long texts, in this session, as plans read it when they run."""
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and Spark runs in one process, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/gridloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_mapped(source: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, label: str) -> DataFrame:
    """materialise(source.mapInArrow(work, schema), label), but in a local or mounted folder the tasks write their rows themselves.

    So the rows don't pass the JVM, whose local file system starts a chmod for each file, three times. A file has a name
    of its attempt, hidden from readers; the driver renames those of the attempts that Spark took, one row a task.
    """
    spark = source.sparkSession
    path = scratch_path(spark, label)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(conf)
    where = store.makeQualified(folder).toUri()
    if where.getScheme() != "file":
        return materialise(source.mapInArrow(work, schema), label)
    local = where.getPath()
    store.mkdirs(folder)

    def write(batches):
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.parquet"
        out, held, size = None, [], 0
        for batch in work(batches):
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= GROUP_ROWS:
                out = out or pq.ParquetWriter(f"{local}/_{name}", batch.schema)
                out.write_table(pa.Table.from_batches(held), row_group_size=size)
                held, size = [], 0
        if held:
            out = out or pq.ParquetWriter(f"{local}/_{name}", held[0].schema)
            out.write_table(pa.Table.from_batches(held), row_group_size=size)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    held = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")  # at the end of this action, not when the driver happens to collect its garbage
    try:
        done = source.mapInArrow(write, "name string").collect()
    finally:
        spark.conf.set(FREE_SHUFFLES, held)
    for row in done:
        if not store.rename(jvm.org.apache.hadoop.fs.Path(folder, f"_{row['name']}"), jvm.org.apache.hadoop.fs.Path(folder, row["name"])):
            raise OSError(f"{path}: {row['name']} can't be renamed")
    return spark.read.schema(schema).parquet(path)


def free_name(names: list[str], base: str) -> str:
    """base, with underscores added until no column has that name."""
    held = {n.lower() for n in names}
    while base.lower() in held:
        base += "_"
    return base


def binary_lists(batch: pa.RecordBatch, name: str) -> list:
    """A string column as UTF-8 bytes; nulls stay None."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a factory that each task calls once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return run


def parts_of(texts: list, size: int = 1 << 20) -> Iterator[list]:
    """Texts (None: empty) in parts of about this many bytes."""
    part, held = [], 0
    for text in texts:
        part.append(text or b"")
        held += len(part[-1])
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def string_parts(texts: pa.Array, size: int = 2 << 20) -> Iterator[pa.Array]:
    """A string column (null: empty) in parts of about this many bytes."""
    texts = pc.fill_null(texts, "")
    held = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


class Memo:
    """A bounded map in two generations: what is used stays, what is not goes, and memory has a fixed limit."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys) -> list:
        """The keys without a value; those found in the old generation move to the young one."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for key in set(keys).difference(young):
            if (value := old.get(key)) is not None:
                young[key] = value
            else:
                out.append(key)
        return out
