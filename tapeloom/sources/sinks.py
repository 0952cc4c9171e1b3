"""Sinks: trade log, statistics, scoped layout; and the folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, in a temporary folder of this machine if all tasks run on it (local mode,
    as in tests), else an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read back: what is used several times isn't computed again, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_trades(trades: DataFrame, path: str, kind: str = "parquet") -> None:
    """Append, one row for each closed trade; lifecycles that the log already holds are not written again. For foreachBatch: one writer
    at a time, as a stream has."""
    spark = trades.sparkSession
    rows = trades.dropDuplicates(["symbol", "life"])
    try:
        known = spark.read.format(kind).load(path).select("symbol", "life")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        rows = rows.join(known, ["symbol", "life"], "left_anti")
    rows.write.mode("append").format(kind).save(path)


def export_statistics(stats: DataFrame, path: str) -> None:
    """A small table as one JSON and one CSV file."""
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_scoped(df: DataFrame, path: str, env: str) -> None:
    """A folder for each environment and symbol; rows of one symbol are spread over files, not gathered in one task."""
    df.withColumn("env", F.lit(env)).write.mode("append").partitionBy("env", "symbol").parquet(path)
