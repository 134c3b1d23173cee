"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from partflow.sources.scratch import shared_dir

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores behind it until it is no column's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when a task's batches are done, memory that it has freed goes back to the system.

    Spark keeps a worker for the tasks of later stages, and an allocator keeps what is freed: else each worker holds
    its largest stage's memory to the end.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return whole


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a shared table and read it back, so that nothing before it is computed twice.

    ``batch_rows`` bounds the rows that one Arrow batch hands to Python while it is written.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, name), spark.conf.get(_BATCH)
    if batch_rows:
        spark.conf.set(_BATCH, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(_BATCH, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stored``, in as many hash buckets of ``key`` as a shuffle has partitions: joins on it move the other side alone."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    entry = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).bucketBy(buckets, key).saveAsTable(entry)
    table = spark.table(entry)
    table.stored_path, table.stored_name = path, entry
    return table


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``stored`` once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        if name := getattr(table, "stored_name", None):
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished rounds: Spark deletes them once nothing on the driver refers to them."""
    gc.collect()
    spark._jvm.System.gc()
