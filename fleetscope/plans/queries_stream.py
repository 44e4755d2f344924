"""Queries whose rows come out of a stream over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.plans.queries_model import BRUTE, _told
from fleetscope.plans.registry import query
from fleetscope.plans.views import V_EV, read
from fleetscope.sources.checkpoints import shared_folder
from fleetscope.streaming import streams


def _drained(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream has now, through files in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    twice = e.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    rows = _drained(spark, streams.deduplicated(twice, ["event_id"]).select("event_id", "event_type"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {V_EV}, d AS (SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM v_ev), last AS (SELECT max(ts) AS m FROM v_ev)
SELECT 'alert:auth_bruteforce:' || subject_name || ':' || day AS event_id, count(*) AS count
FROM d, last WHERE event_category = 'authentication' AND event_outcome = 'failure' AND (day + 1) * 86400 <= epoch(m - INTERVAL 10 MINUTE) GROUP BY subject_name, day HAVING count(*) >= 2""")
def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    keyed = e.select("ts", F.when(F.col("event_type") == "error", "authentication").otherwise("").alias("event_category"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("event_outcome"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject_name"))
    return _told(_drained(spark, streams.detect_stream(keyed, BRUTE))).select("event_id", "count")
