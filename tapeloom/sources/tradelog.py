"""A trade log with commits. Data is written first, and counts only once a version that names it is put in place, which one writer alone can do for
each version. A writer that comes second reads what the first has committed, leaves those lifecycles out and tries the next version. Readers take a version and all
it names, so they see a commit whole or not at all."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

KEYS = ["symbol", "life"]
#: Digits of a version's name, so that names sort as numbers do.
DIGITS = 12


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file in place, whole, unless there is one; whether it did. Local folders take a hard link, which fails where the name is taken; other
    file systems create the file on that condition."""
    fs, where = _file_system(spark, path)
    if where.toUri().getScheme() in (None, "file") and fs.getScheme() == "file":
        target = where.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    if fs.exists(where):
        return False
    try:
        out = fs.create(where, False)
    except Exception as e:  # the gateway wraps the file system's own error
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = _file_system(spark, f"{path}/versions")
    if not fs.exists(where):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit())


def _named(spark: SparkSession, path: str, version: int) -> dict:
    (row,) = spark.read.text(f"{path}/versions/{version:0{DIGITS}}", wholetext=True).collect()
    return json.loads(row[0])


def snapshot(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """All rows of a version (the latest, if None); none, where nothing was committed."""
    known = versions(spark, path)
    version = version if version is not None else (known[-1] if known else 0)
    folders = _named(spark, path, version)["data"] if version else []
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{f}" for f in folders))


def append(trades: DataFrame, path: str, batch: str | None = None, before_commit=None) -> int:
    """Appends lifecycles that the log doesn't hold yet; the version that does so (the latest, if there was nothing to add). Any number of writers may append at once. A
    ``batch`` (a stream's name and number) that a version names already was written before, and isn't again. A version lists all folders, so the log stays
    readable with one small file; ``compact`` joins folders."""
    spark = trades.sparkSession
    rows = trades.dropDuplicates(KEYS)
    while True:
        known = versions(spark, path)
        latest = known[-1] if known else 0
        state = _named(spark, path, latest) if latest else {"data": [], "batches": {}}
        stream, _, number = (batch or "").rpartition(":")
        if batch is not None and int(number) <= state["batches"].get(stream, -1):
            return latest
        fresh = rows.join(snapshot(spark, path, trades.schema, latest).select(*KEYS).hint("merge"), KEYS, "left_anti") if latest else rows
        folder = uuid.uuid4().hex
        fresh.write.parquet(f"{path}/data/{folder}")
        if before_commit is not None:
            before_commit()
        empty = spark.read.schema(trades.schema).parquet(f"{path}/data/{folder}").isEmpty()
        if empty and batch is None:
            return latest
        made = {"data": state["data"] + [folder] * (not empty), "batches": state["batches"] | ({stream: int(number)} if batch is not None else {})}
        if put_if_absent(spark, f"{path}/versions/{latest + 1:0{DIGITS}}", json.dumps(made)):
            return latest + 1


def compact(spark: SparkSession, path: str, schema) -> int:
    """A version with the same rows in one folder. Folders of earlier versions stay, for who still reads them. A commit in between wins, and it is tried again."""
    while True:
        known = versions(spark, path)
        if not known:
            return 0
        folder = uuid.uuid4().hex
        snapshot(spark, path, schema, known[-1]).write.parquet(f"{path}/data/{folder}")
        made = _named(spark, path, known[-1]) | {"data": [folder]}
        if put_if_absent(spark, f"{path}/versions/{known[-1] + 1:0{DIGITS}}", json.dumps(made)):
            return known[-1] + 1
