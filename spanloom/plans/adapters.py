"""Model tables derived from the driver tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with service, peer, kind, path and interval from events."""
    start = micros()
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr("cast(user_id % 6 as int)").alias("service"), F.expr("cast((user_id div 6) % 6 as int)").alias("peer"),
        F.when(F.col("event_id") % 2 == 0, "CLIENT").otherwise("SERVER").alias("kind"), F.col("event_type").alias("path"),
        start.alias("start_us"), (start + F.round(F.col("value") * 100).cast("long") * 600000).alias("end_us"),
    )


OBS = """obs AS (SELECT event_id, (user_id % 6)::INT AS service, ((user_id // 6) % 6)::INT AS peer,
  CASE WHEN event_id % 2 = 0 THEN 'CLIENT' ELSE 'SERVER' END AS kind, event_type AS path, epoch_us(ts) AS start_us,
  epoch_us(ts) + round(value * 100)::BIGINT * 600000 AS end_us FROM events)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads, writes and barriers of users' fields: ctx, seq, kind, owner, field, event_id, ts_us, version (writes so far)."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ctx"), (F.row_number().over(w)).alias("seq"), "event_id", micros().alias("ts_us"), F.col("event_type").alias("op"),
        F.when(F.col("event_id") % 7 == 0, "barrier").when(F.col("event_id") % 3 == 0, "write").otherwise("read").alias("kind"),
        F.col("user_id").alias("owner"), F.expr("cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 5 as int)").alias("field"),
    )
    owner = Window.partitionBy("owner", "field").orderBy("seq")
    return rows.withColumn("version", F.sum(F.when(F.col("kind") == "write", 1).otherwise(0)).over(owner))


ELOG = """elog0 AS (SELECT user_id AS ctx, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id, epoch_us(ts) AS ts_us, event_type AS op,
  CASE WHEN event_id % 7 = 0 THEN 'barrier' WHEN event_id % 3 = 0 THEN 'write' ELSE 'read' END AS kind, user_id AS owner,
  (regexp_extract(props, '([0-9]+)', 1)::BIGINT % 5)::INT AS field FROM events),
elog AS (SELECT *, sum(CASE WHEN kind = 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY owner, field ORDER BY seq) AS version FROM elog0)"""


def turn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: a turn is a span below the turn before it."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("trace"), F.col("turn").cast("long").alias("span"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("long")).alias("parent"),
        F.col("role").alias("service"), F.when(F.col("role") == "user", "PRODUCER").otherwise("CONSUMER").alias("kind"), F.col("role").alias("path"),
        F.col("turn").cast("long").alias("start_us"), F.length("text").cast("long").alias("duration_us"),
        F.when(F.length("text") % 5 == 0, 500).when(F.length("text") % 5 == 1, 404).otherwise(200).alias("status"), F.when(F.length("text") % 7 == 0, "").alias("error"),
    )


SPANS = """spans AS (SELECT conv_id AS trace, turn::BIGINT AS span, CASE WHEN turn > 0 THEN turn::BIGINT - 1 END AS parent, role AS service,
  CASE WHEN role = 'user' THEN 'PRODUCER' ELSE 'CONSUMER' END AS kind, role AS path, turn::BIGINT AS start_us, length(text) AS duration_us,
  CASE WHEN length(text) % 5 = 0 THEN 500 WHEN length(text) % 5 = 1 THEN 404 ELSE 200 END AS status, CASE WHEN length(text) % 7 = 0 THEN '' END AS error FROM conversations)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cost samples: round, mode, metric."""
    return table(spark, sf_dir, "lineitem").withColumns({"round": F.expr("cast(l_orderkey % 5 as int)"), "mode": F.col("l_returnflag"), "metric": F.round(F.col("l_extendedprice") * 100).cast("long")})


LINES = "lines AS (SELECT *, (l_orderkey % 5)::INT AS round, l_returnflag AS mode, round(l_extendedprice * 100)::BIGINT AS metric FROM lineitem)"
