"""Raw text as tables of lines, and sections inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARKER = r"^===\s*([A-Z_]+)\s*===$"


def read_lines(spark: SparkSession, path: str, source: str, host_id: str = "") -> DataFrame:
    """``host_id, source, run_id, collected_at, line_no, line`` of text files; a file is a run, and its lines keep their order."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("run_id"), F.col("_metadata.file_modification_time").alias("collected_at"))
    return raw.select(F.lit(host_id).alias("host_id"), F.lit(source).alias("source"), "run_id", "collected_at", F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def stream_lines(spark: SparkSession, path: str, source: str, host_id: str = "") -> DataFrame:
    """The same as a stream; lines are ordered inside a batch only."""
    raw = spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("run_id"), F.col("_metadata.file_modification_time").alias("collected_at"))
    return raw.select(F.lit(host_id).alias("host_id"), F.lit(source).alias("source"), "run_id", "collected_at", F.col("value").alias("line"))


def json_records(lines: DataFrame, schema: StructType | str, keep: tuple[str, ...] = ("host_id", "run_id", "line_no")) -> DataFrame:
    """Records of JSON lines; lines that aren't objects, or are malformed, go."""
    parsed = lines.where(F.ltrim("line").startswith("{")).select(*keep, F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r IS NOT NULL").select(*keep, "r.*")


def with_sections(lines: DataFrame, marker: str = MARKER, by: tuple[str, ...] = ("host_id", "run_id")) -> DataFrame:
    """``section`` of each line: the last marker before it in its run. Marker lines go; lines before the first have a null section."""
    name = F.nullif(F.regexp_extract("line", marker, 1), F.lit(""))
    run = Window.partitionBy(*by).orderBy("line_no")
    out = lines.withColumn("_mark", name).withColumn("section", F.last("_mark", ignorenulls=True).over(run))
    return out.where(F.col("_mark").isNull()).drop("_mark")
