"""Run events: appended as JSON lines by runs, followed by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id long, pass int, type string, time timestamp, job_id string, outcome string, run_time double"


def record(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append events in one file: a run's events are bounded by its jobs."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def followed(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def outcome_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """(window, outcome, n, seconds): ended jobs by time and outcome; of a stream, events later than ``late`` are left out."""
    ended = events.where("type = 'job_done'")
    if events.isStreaming:
        ended = ended.withWatermark("time", late)
    return ended.groupBy(F.window("time", window), "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("run_time").alias("seconds"))


def slow_runtimes(events: DataFrame, least: float = 1.0) -> DataFrame:
    """(job_id, run_start_time, runtime_s) of ended jobs that took ``least`` seconds or more; works on streams as well."""
    ended = events.where((F.col("type") == "job_done") & (F.col("run_time") >= least))
    return ended.select("job_id", F.unix_seconds("time").alias("run_start_time"), F.col("run_time").alias("runtime_s"))


def core_demand(jobs: DataFrame, host: str, cores: int) -> DataFrame:
    """(host, cores): cores that jobs of the resource classes SingleCore, AllCores (all but one) and Exclusive ask for."""
    need = F.when(F.col("resources") == "AllCores", max(cores - 1, 1)).when(F.col("resources") == "Exclusive", cores).otherwise(1)
    return jobs.groupBy(host).agg(F.sum(need).alias("cores"))
