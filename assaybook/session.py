"""Shared-folder staging: the one way this library cuts lineage.

Several operators need a result twice, or need row positions that must not change when a
lost executor recomputes a partition. They write that result as a Parquet table below the
folder the cluster names in ``spark.checkpoint.dir``, or else below the warehouse, and read it
back. The table survives executor loss, and its file sizes give the optimizer a true size, so a
later join broadcasts it only when it really is small.
"""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a bucket: a task sorts one bucket, or joins two.
BUCKET_ROWS = 1 << 19

_watched: set[str] = set()
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for this application's staged tables, on a file system every executor can reach."""
    app = spark.sparkContext.applicationId
    if app not in _watched:
        _watched.add(app)
        atexit.register(_release_quietly, spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/assaybook/{app}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aligned_buckets(n_rows: int) -> int:
    """How many buckets tables of so many rows are stored in, so that a bucket stays the same size."""
    return max(8, -(-n_rows // BUCKET_ROWS))


def stage_aligned(df: DataFrame, key: str, buckets: int, name: str = "table") -> DataFrame:
    """Like ``stage``, with the rows stored by the hash of ``key``.

    Two tables stored alike join on that key, and group by it, without an exchange.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = f"assaybook_{path.rsplit('-', 1)[1]}"
    by_hash = df.repartition(buckets, key).sortWithinPartitions(key)          # so a bucket is one file
    by_hash.write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def local_table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """A small driver-side table as a local relation, whose exact size the optimizer knows.

    A table made from Python rows has no known size, and a join against it can end up shuffling
    or broadcasting the large side.
    """
    arrays = [pa.array(columns[name], type_) for name, type_ in types.items()]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(types)))


def release(spark: SparkSession) -> None:
    """Delete every table this application staged; call it when their results have been used."""
    for table in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path, True)


def _release_quietly(spark: SparkSession) -> None:
    """At exit, tidy up if the session still runs."""
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            release(spark)
    except Exception:  # noqa: BLE001 - the process is ending; there is nobody to tell
        pass
