"""Probability heads: training set, Spark ML fits, scoring, audits."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import is_finite
from ..functions.scalars import cooled
from . import joins

#: Coefficients from which a head counts as diverged.
SATURATED = 100.0


def training_set(features: DataFrame, names: list[str], label: str) -> DataFrame:
    """M1: rows whose label and features are all finite."""
    keep = F.col(label).isNotNull()
    for n in names:
        keep &= is_finite(F.col(n).cast("double"))
    return features.filter(keep)


def fit_head(rows: DataFrame, names: list[str], label: str, kind: str, weight: float = 1e-5) -> PipelineModel:
    """M2: scaled features into a logistic head, or a squared or Huber regression, drawn to zero by ``weight``. A batch refit; no match for
    per-row steps. Rows without the label are left out."""
    rows = rows.filter(F.col(label).isNotNull())
    stages = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    if kind == "logistic":
        head = LogisticRegression(labelCol=label, regParam=weight, maxIter=30)
    else:
        head = LinearRegression(labelCol=label, loss="huber" if kind == "huber" else "squaredError", regParam=0.0 if kind != "huber" and weight <= 1e-5 else weight, maxIter=30)
    return Pipeline(stages=[*stages, head]).fit(rows)


def score(model: PipelineModel, rows: DataFrame, reliable: bool = True, out: str = "p") -> DataFrame:
    """M3: probability of class 1 (a neutral half from a head that isn't reliable), or the prediction of a regression: the fitted numbers as a column expression, so
    that several heads score in one pass and no model goes to the tasks."""
    assembler, scaler, head = model.stages
    z = F.lit(float(head.intercept))
    for name, w, mean, std in zip(assembler.getInputCols(), head.coefficients.toArray(), scaler.mean.toArray(), scaler.std.toArray(), strict=True):
        z = z + F.lit(float(w) / float(std) if std else 0.0) * (F.col(name).cast("double") - F.lit(float(mean)))
    if hasattr(head, "numClasses"):
        z = cooled(1 / (1 + F.exp(-z)), F.lit(reliable))
    return rows.withColumn(out, z)


def trend(pred, scale):
    """Trend confidence and direction from a regression head's output and the trend scale."""
    return F.least(F.abs(pred) / scale, F.lit(1.0)), F.when(pred > 0, "LONG").when(pred < 0, "SHORT").otherwise("FLAT")


def saturation(spark: SparkSession, heads: dict[str, PipelineModel], limit: float = SATURATED) -> DataFrame:
    """M4: per head the largest absolute coefficient, and whether the head must be retrained from zero."""
    rows = [(name, float(max(map(abs, model.stages[-1].coefficients.toArray()), default=0.0))) for name, model in heads.items()]
    return spark.createDataFrame(rows, "head string, peak double").withColumn("retrain", F.col("peak") >= limit)


def retrained(rows: DataFrame, later: DataFrame, names: list[str], heads: dict[str, tuple[str, str]], made: dict[str, PipelineModel], limit: float = SATURATED) -> DataFrame:
    """M4: the audit, and what comes of it: a head past ``limit`` is fitted from zero, with the same penalty, on what came ``later`` alone; its samples
    count from there. head, peak, retrain, peak_after, samples."""
    spark, out = rows.sparkSession, []
    counts = [x.agg(*(F.count(label).alias(h) for h, (label, _) in heads.items())).head() for x in (rows, later)]
    peak = lambda m: float(max(map(abs, m.stages[-1].coefficients.toArray()), default=0.0))
    for head, model in made.items():
        before = peak(model)
        again = before >= limit
        if again:
            model = made[head] = fit_head(later, names, *heads[head])
        out.append((head, before, again, peak(model), int(counts[again][head])))
    return spark.createDataFrame(out, "head string, peak double, retrain boolean, peak_after double, samples long")


def entry_features(trades: DataFrame, ticks: DataFrame, names: list[str], stale: int) -> DataFrame:
    """M1: ``trades`` (symbol, open_t, life, ...) with the features of the latest tick at or before their opening, if it isn't over ``stale`` old: what was known at
    entry, and nothing later."""
    left = trades.withColumn("t", F.col("open_t")).withColumn("seq", F.col("life"))
    return joins.as_of(left, ticks.select("symbol", "t", *names), names, stale).drop("t", "seq").withColumnRenamed("age", "age_features")


def rolling_origin(rows: DataFrame, names: list[str], label: str, kind: str = "logistic", blocks: int = 5, start: str = "open_t", end: str = "close_t") -> DataFrame:
    """M2: ``rows`` of all blocks of opening times but the first, with block, n_train and p: each block is scored by a head that was fitted to what had closed before the
    block began. A block before which only one outcome was seen gets a neutral half. ``blocks`` fits, which run at the same time; ``rows`` are read several times for each, so
    write them first. What had closed is counted for all blocks in one pass."""
    edges = rows.approxQuantile(start, [i / blocks for i in range(blocks + 1)], 0.001)
    if not edges:
        return rows.withColumn("p", F.lit(0.5)).withColumn("block", F.lit(0)).withColumn("n_train", F.lit(0).cast("long"))  # there are no rows
    later = range(1, blocks)
    closed = {k: F.col(end) < edges[k] for k in later}
    seen = rows.groupBy(label).agg(*(F.count(F.when(closed[k], 1)).alias(f"n_{k}") for k in later)).collect()  # two rows
    counts = {k: [r[f"n_{k}"] for r in seen if r[f"n_{k}"]] for k in later}

    def fitted(k: int) -> PipelineModel | None:
        return fit_head(rows.filter(closed[k]), names, label, kind) if len(counts[k]) > 1 else None

    with ThreadPool(blocks) as pool:
        heads = dict(zip(later, pool.map(inheritable_thread_target(rows.sparkSession)(fitted), later), strict=True))
    made = None
    for k in later:
        own = F.col(start) >= edges[k]
        part = rows.filter(own if k == blocks - 1 else own & (F.col(start) < edges[k + 1]))
        scored = part.withColumn("p", F.lit(0.5)) if heads[k] is None else score(heads[k], part)
        scored = scored.withColumn("block", F.lit(k)).withColumn("n_train", F.lit(sum(counts[k])).cast("long"))
        made = scored if made is None else made.unionByName(scored)
    return made


def fixed_head(weights: dict[str, float], intercept: float = 0.0, logistic: bool = True):
    """M3: a head of known coefficients over raw features, as an expression."""
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + F.lit(w) * F.col(name)
    return 1 / (1 + F.exp(-z)) if logistic else z


def hold_probability(p_success, p_tp, trend_, risk):
    """M6: our probability that holding pays; its complement is that of an exit."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.50 * p_success + 0.30 * p_tp + 0.20 * trend_ - 0.20 * risk))


def confidence(p_tp, quality, trend_, noise, risk):
    """M6: our blend: 0.30 of the target head, the rest by quality, trend and calm; less a tenth of risk."""
    return 0.30 * p_tp + 0.25 * quality + 0.25 * trend_ + 0.20 * (1 - noise) - 0.10 * risk
