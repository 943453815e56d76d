"""Small Spark helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a two-column table of longs that may be broadcast (about 16 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch: what a task holds of its rows outside the JVM's heap and in its Python worker.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate tables.

    A temporary one where none is named, which only a local session (as in tests) may do: on a cluster that would be
    a folder of the driver's own machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that tasks read by bytes rather than only by rows, so that long texts don't fill a
    worker's memory.

    A setting of the session; a smaller one that the user has made stays. ``maxBytesPerOutputBatch`` isn't set: a batch
    that Spark 4.1 splits by it and a smaller one after that end the task with an ArrayIndexOutOfBoundsException.
    Kernels split what they yield themselves, see :func:`in_parts`.
    """
    now = spark.conf.get(_BATCH_SETTING, None)
    if now is None or not str(now).isdigit() or int(now) > BATCH_BYTES or int(now) <= 0:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in batches of about BATCH_BYTES at most (or of one row)."""
    rows = max(1, batch.num_rows // max(1, -(-batch.nbytes // BATCH_BYTES)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting if it is known to have at most ``rows`` rows; the count is taken first."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def map_rows(df: DataFrame, kernel) -> DataFrame:
    """``df`` by a kernel for mapInArrow that yields its columns in their order, whatever their names are."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(kernel, plain.schema).toDF(*df.columns)


def fresh(columns: Iterable[str]) -> str:
    """A prefix that no column name begins with, for an operator's own columns beside its input's."""
    taken, prefix = [c.lower() for c in columns], "x_"
    while any(c.startswith(prefix) for c in taken):
        prefix = "x" + prefix
    return prefix
