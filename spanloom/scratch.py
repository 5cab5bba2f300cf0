"""Tables written to the cluster's shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What this application has written.
_PATHS: list[str] = []
_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where a local session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote here; for when the results that read them are written elsewhere."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in map(hadoop, _PATHS):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _TABLES.clear()
    _PATHS.clear()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, column: str, buckets: int, name: str = "table") -> DataFrame:
    """Like ``materialize``, but as a table bucketed by ``column``, so that a later join on it does not shuffle this side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    _PATHS.append(f"{shared_dir(spark)}/{table}")
    _TABLES.append(table)
    df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
