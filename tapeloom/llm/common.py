"""Small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<float>": pa.list_(pa.float32()),
}
#: Rows that become Python objects at a time, so that a batch of long texts stays small.
SLICE = 128
#: Rows that go to Python at a time.
ARROW_ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", "1024"
#: A key is hot if it holds more than one row in so many.
HOT = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this machine if all
    tasks run on it (local mode, as in tests), else an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return folder or context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors and gives true sizes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _columns(outputs: list[tuple[str, str]], made: dict) -> list[pa.Array]:
    return [pa.array(made[name], type=ARROW[kind]) for name, kind in outputs]


def _small_batches(spark: SparkSession) -> None:
    """Smaller batches for Python where the session sets no size of its own, so that batches of long texts stay small."""
    if ARROW_ROWS not in spark.conf.getAll:
        spark.conf.set(ARROW_ROWS, BATCH)


def map_columns(df: DataFrame, inputs: list[str], outputs: list[tuple[str, str]], make) -> DataFrame:
    """Rows made from slices of rows. ``make()`` runs once per task and returns ``f(*lists) -> {name: list}``; the
    outputs may have any number of rows. Only ``inputs`` reach Python."""

    def run(batches):
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays(_columns(outputs, f(*(c.to_pylist() for c in part.columns))), names=[n for n, _ in outputs])

    _small_batches(df.sparkSession)
    return df.select(*inputs).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in outputs))


def add_columns(df: DataFrame, inputs: list[str], outputs: list[tuple[str, str]], make) -> DataFrame:
    """``df`` with further columns made from ``inputs``; the other columns pass through untouched. Names of ``outputs``
    replace columns of the same name (in whatever case)."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    new = {n.lower() for n, _ in outputs}
    rest = [c for c in df.columns if c.lower() not in new]
    kept = [F.col(f"`{c}`") for c in rest]
    source = df.select(*kept, *(F.col(c).alias(f"in {i}") for i, c in enumerate(inputs)))
    schema = StructType([*df.select(*kept).schema.fields, *(StructField(n, _parse_datatype_string(t)) for n, t in outputs)])

    def run(batches):
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = f(*(c.to_pylist() for c in part.columns[len(rest) :]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *_columns(outputs, made)], names=[*rest, *new_names])

    new_names = [n for n, _ in outputs]
    _small_batches(df.sparkSession)
    return source.mapInArrow(run, schema)


def packed(df: DataFrame, **columns) -> DataFrame:
    """``df``'s rows as one column ``row``, beside columns of our own: no name of ours meets one of theirs. ``row.*`` gives them back."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    return df.select(row, *(c.alias(n) for n, c in columns.items()))


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row for each ``key``), inner or left. Keys that hold over a thousandth of the rows
    (so at most a thousand keys) are broadcast; only the others are shuffled, so that a hot key isn't one task. Null keys find nothing.
    ``counts`` (key, _rows): rows by key, where that is known."""
    if counts is None:
        counts = stored(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows")))
    total = counts.agg(F.sum("_rows")).head()[0] or 0
    hot = counts.filter(F.col("_rows") > max(1_000, total // HOT)).select(key)
    if not (keys := [r[0] for r in hot.collect()]):
        whole = rows.filter(F.col(key).isNotNull()).join(table.hint("merge"), key, how)
    else:
        few = stored(table.join(F.broadcast(hot), key, "left_semi"))
        often = F.col(key).isin(keys)
        whole = rows.filter(often).join(F.broadcast(few), key, how).unionByName(rows.filter(~often).join(table.hint("merge"), key, how))
    if how == "left":
        whole = whole.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)
    return whole


def bounded_ids(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` different keys, the first by hash: the same whatever the partitions are. Of a large table, only keys whose hash is
    a multiple are looked at, some four times as many as are wanted."""
    keys = df.select(key).filter(F.col(key).isNotNull())
    step = max(1, keys.count() // (4 * bound))
    hashed = F.xxhash64(F.col(key))
    return keys.filter(F.pmod(hashed, F.lit(step)) == 0).distinct().orderBy(hashed, key).limit(bound)


def one_each(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row for each key, the one with the least hash of ``by``: rows that share a key don't widen a bounded sample. All columns stay."""
    return df.groupBy(key).agg(F.min_by(F.struct(*(c for c in df.columns if c != key)), F.xxhash64(by)).alias("_one")).select(key, "_one.*")


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves remainder 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
