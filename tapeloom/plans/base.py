"""How a query and its SQL twin are registered: both give the same columns, doubles rounded half up by the same arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import adapters

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def query(name: str, columns: str, *views: str, sql: str | None = None, digits: int = 6):
    """Registers ``f(spark, sf_dir) -> DataFrame``. ``columns``: names as they are, then after a bar names of doubles to round to ``digits`` places. ``sql``
    goes over the adapter views named in ``views``; without it the query has no twin."""
    plain, _, doubles = columns.partition("|")
    plain, doubles, unit = plain.split(), doubles.split(), float(10**digits)

    def register(f):
        def run(spark, sf_dir) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*plain, *((F.floor(F.col(c).cast("double") * unit + 0.5) / unit).alias(c) for c in doubles))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            known = ", ".join(adapters.SQL[v] for v in views)
            body = f"result AS ({sql})"
            outs = ", ".join([*plain, *(f"floor(CAST({c} AS DOUBLE) * {unit:.0e} + 0.5) / {unit:.0e} + 0.0 AS {c}" for c in doubles)])
            TWINS[name] = f"WITH {known + ', ' if known else ''}{body} SELECT {outs} FROM result"
        return f

    return register
