"""What the searches over vectors share: taking part, rows of their own, blocks, merging of ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id, embedding (array<double>) of the rows that take part: not null, not empty, every component present and finite;
    without ``zero``, some component not zero. Rows without an id take no part."""
    x = F.col(column).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & fine)
    if not zero:
        rows = rows.filter(F.exists(x, lambda v: v != 0))
    return rows.select(F.col(key).cast("long").alias("vec_id"), x.alias("embedding"))


def blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def dealt(key: str, n: int) -> F.Column:
    """A block number by hash: blocks are even whatever the ids are."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def asked(queries: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the queries and ask, a number for each row: rows that share a vec_id are queries each on its own. Written, so that the numbers stay."""
    return stored(queries.select(*columns).withColumn("ask", F.monotonically_increasing_id()))


def each_row(rows: DataFrame, k: int, *columns: str) -> DataFrame:
    """``rows`` by ``columns``, equal ones at most ``k`` + 1 times: no more can be among a query's ``k`` best beside its own. However many copies
    there are, they are counted before they are shuffled."""
    copies = F.least(F.count(F.lit(1)), F.lit(k + 1).cast("long"))
    return rows.groupBy(*columns).agg(copies.alias("_n")).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n")


def own_row(ids: np.ndarray, rows: np.ndarray, own: int, row: np.ndarray) -> int | None:
    """Where a query's own row stands among candidates: the first that has its id and its values. Rows that share only the id are others."""
    return next((i for i in np.flatnonzero(ids == own).tolist() if (rows[i] == row).all()), None)


def merged(found: DataFrame, k: int, best_first: F.Column, by: str = "query_id") -> DataFrame:
    """The first ``k`` of each query's finds, ranked from 1; ties to the smaller vec_id."""
    w = Window.partitionBy(by).orderBy(best_first, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
