"""Readers and writers of captures and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_SCHEMA = "traceId string, id string, parentId string, name string, kind string, localEndpoint struct<serviceName: string>, timestamp long, duration long, tags map<string,string>"


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans of a run directory (``spans-final.json`` if it is there, else ``spans.json``) or of a file, flattened."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not path.endswith(".json"):
        final = hadoop(f"{path}/spans-final.json")
        found = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(final)
        path = f"{path}/{'spans-final.json' if found else 'spans.json'}"
    rows = spark.read.schema(SPAN_SCHEMA).json(path, multiLine=True)
    return rows.select(F.col("traceId").alias("trace"), F.col("id").alias("span"), F.col("parentId").alias("parent"), "name", "kind", F.col("localEndpoint.serviceName").alias("service"), F.col("timestamp").alias("start_us"), F.col("duration").alias("duration_us"), "tags")


def read_events(spark: SparkSession, path: str, schema: str, folder: bool = False) -> DataFrame:
    """JSON lines, one file a role, or one folder if ``folder``; its name, without a file's ending, is the column ``role``."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("role", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$" if folder else r"([^/]+?)(?:\.[^./]*)?$", 1))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_manifest(digests: DataFrame, expected: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Files that changed, are missing or are extra against a manifest."""
    joined = digests.select(key, F.col(digest).alias("got")).join(expected.select(key, F.col(digest).alias("want")), key, "full_outer")
    change = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("got") != F.col("want"), "changed")
    return joined.select(key, change.alias("change")).where("change is not null")


def write_report(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Write a report as parquet, json or csv (with header), in folders by the given columns."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by)
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)
