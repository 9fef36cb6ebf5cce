"""Models over feature columns: scaling, boosted trees, forests, calibration, folds, importance, promotion."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.boosting import BoostedTrees, fit_together
from tidewatch.operators.evaluate import confusion, roc_auc
from tidewatch.operators.ordered import global_rank, hash_unit
from tidewatch.session import materialise, side_by_side

# Sizes of the trained ensembles. Where a validation column is given, training stops when it no longer improves.
CONFIGS = {
    "enterprise": dict(maxIter=300, maxDepth=6, stepSize=0.07, maxBins=255, minInstancesPerNode=20),
    "source_split": dict(maxIter=300, maxDepth=4, stepSize=0.05, subsamplingRate=0.7, minInstancesPerNode=20),
    "classic": dict(maxIter=200, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=5),
    "histogram": dict(maxIter=300, maxDepth=6, stepSize=0.1, maxBins=64),
    "audit": dict(maxIter=100, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=20),
}


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weights: n / (2 * class size)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t")).withColumn("_j", F.lit(1))
    w = sizes.withColumn("_j", F.lit(1)).join(total, "_j").select(label, (F.col("_t") / (2.0 * F.col("_n"))).alias(
        "weight"))
    return df.join(F.broadcast(w), label)  # one row per class


def assembler(features: list[str]) -> list:
    """Assemble and standardise."""
    return [VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]


def boosted_trees(features: list[str], config: str = "enterprise", label: str = "label", weight: str | None = None,
                  validation: str | None = None, seed: int = 42, **override) -> Pipeline:
    gbt = BoostedTrees(labelCol=label, featuresCol="features", seed=seed, **(CONFIGS[config] | override))
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=assembler(features) + [gbt])


def forest(features: list[str], label: str = "label", trees: int = 100, depth: int = 10, seed: int = 42) -> Pipeline:
    return Pipeline(stages=assembler(features) + [RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)])


def score(model: PipelineModel, df: DataFrame, name: str = "p", threshold: float = 0.5) -> DataFrame:
    """Adds the positive probability and the 0/1 prediction."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("raw_features", "features", "rawPrediction", "probability", "prediction").withColumn(
        "pred", (F.col(name) >= threshold).cast("int"))


def platt(pipeline: Pipeline, df: DataFrame, fold: str = "fold", folds: int = 3, label: str = "label"):
    """Per fold: fit on the others, fit a logistic curve over the raw margin of the fold. Returns (model, slope,
    intercept) triples, averaged by `score_calibrated`."""
    triples = []
    for k in range(folds):
        base = pipeline.fit(df.where(F.col(fold) % folds != k))
        held = _margin(base, df.where(F.col(fold) % folds == k)).withColumn("curve_in", array_to_vector(F.array("margin")))
        curve = LogisticRegression(featuresCol="curve_in", labelCol=label).fit(held)
        triples.append((base, float(curve.coefficients[0]), float(curve.intercept)))
    return triples


def _margin(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("margin", vector_to_array("rawPrediction")[1]).drop(
        "raw_features", "features", "rawPrediction", "probability", "prediction")


def score_calibrated(triples, df: DataFrame, name: str = "p") -> DataFrame:
    """Mean of the calibrated probabilities of the fold models."""
    out, parts = df, []
    for i, (base, slope, intercept) in enumerate(triples):
        out = _margin(base, out).withColumn(f"_p{i}", 1 / (1 + F.exp(-(F.col("margin") * slope + intercept)))).drop("margin")
        parts.append(F.col(f"_p{i}"))
    return out.withColumn(name, sum(parts[1:], parts[0]) / len(parts)).drop(*[f"_p{i}" for i in range(len(parts))])


def cross_validate(pipeline: Pipeline, df: DataFrame, folds: int = 5, fold: str = "fold", label: str = "label"):
    """Mean and std of the area under the curve with user-defined folds."""
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds, foldCol=fold,
                        evaluator=BinaryClassificationEvaluator(labelCol=label), parallelism=2)
    fitted = cv.fit(df)
    return fitted.avgMetrics[0], fitted.stdMetrics[0]


def fold_metrics(pipeline: Pipeline, df: DataFrame, fold: str, values: list, label: str = "label", parallelism: int = 4) -> DataFrame:
    """Leave one value of `fold` out at a time (folds, groups or sources): one metrics row each. The fits of all values are one job
    list, so a cluster works on several at a time; `values` are the few names of folds, groups or sources."""
    fitted = fit_all([pipeline] * len(values), [df.where(F.col(fold) != v) for v in values], parallelism)
    return reduce(DataFrame.unionByName, [
        confusion(score(model, df.where(F.col(fold) == v)), label, "pred").withColumn("held_out", F.lit(str(v)))
        for model, v in zip(fitted, values)])


def fit_all(pipelines: list[Pipeline], tables: list[DataFrame], parallelism: int = 4) -> list[PipelineModel]:
    """One model per pipeline and its table: the fits are one job list. Boosted trees also share the jobs of their levels."""
    if not all(isinstance(p.getStages()[-1], BoostedTrees) for p in pipelines):
        return side_by_side(tables[0].sparkSession, lambda case: case[0].fit(case[1]), list(zip(pipelines, tables)), parallelism)

    def prepare(case):
        return Pipeline(stages=case[0].getStages()[:-1]).fit(case[1])

    ready = side_by_side(tables[0].sparkSession, prepare, list(zip(pipelines, tables)), parallelism)
    fitted = fit_together([p.getStages()[-1] for p in pipelines], [r.transform(t) for r, t in zip(ready, tables)])
    return [PipelineModel([*r.stages, f]) for r, f in zip(ready, fitted)]


#: Steps of the permutations; the first that shares no factor with the number of rows is used.
STEPS = (1_000_003, 1_000_033, 1_000_037, 1_000_039)


def importance(model: PipelineModel | Callable[[DataFrame], DataFrame], df: DataFrame, features: list[str], key: str, repeats: int = 3,
               label: str = "label") -> DataFrame:
    """Accuracy lost when one feature is shuffled: (feature, mean_drop, std_drop). `model` may be a function that adds `pred`.

    All features and repeats come from one rank table. Rows are ranked once by a digest of their key; in a repeat, row i meets the
    donor with rank (step * i + shift) mod n, a permutation. One join brings each row its donors' features; a copy per feature then
    takes that one value from the donor, and all copies are scored in one pass without another shuffle.
    """
    scorer = model if callable(model) else lambda rows: score(model, rows)
    digest = F.md5(F.col(key).cast("string"))
    unit = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    ranked = materialise(global_rank(df.select(key, label, *features).withColumn("_u", unit), [], "_u", key, total="_n").drop("_u"))
    i, n, own = F.col("rank") - 1, F.col("_n"), F.struct(*features)
    step = F.coalesce(*[F.when(n % s != 0, F.lit(s)) for s in STEPS])
    takers = ranked.select(label, own.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r"), "rank", "_n")
    takers = takers.withColumn("_donor", F.pmod(i * step + F.col("_r") * 7919 + 1, n))
    both = takers.drop("rank").join(ranked.select((F.col("rank") - 1).alias("_donor"), own.alias("_new")), "_donor")
    names = F.array(F.lit(""), *[F.lit(f) for f in features])
    copies = both.select(label, "_r", "_own", "_new", F.explode(names).alias("_shuffled")).select(
        label, "_r", "_shuffled", *[F.when(F.col("_shuffled") == f, F.col(f"_new.{f}")).otherwise(F.col(f"_own.{f}")).alias(f) for f in features])
    right = scorer(copies).groupBy("_shuffled", "_r").agg(F.avg((F.col("pred") == F.col(label)).cast("double")).alias("accuracy"))
    base = right.where("_shuffled = '' AND _r = 0").select(F.lit(1).alias("_j"), F.col("accuracy").alias("_b"))
    return (right.where("_shuffled <> ''").withColumn("_j", F.lit(1)).join(F.broadcast(base), "_j").groupBy(F.col("_shuffled").alias("feature"))
            .agg(F.avg(F.col("_b") - F.col("accuracy")).alias("mean_drop"), F.stddev_pop(F.col("_b") - F.col("accuracy")).alias("std_drop")))


def top_features(importances: DataFrame, n: int = 15) -> DataFrame:
    return importances.orderBy(F.desc("mean_drop"), "feature").limit(n)


def promote(candidate: PipelineModel, val: DataFrame, path: str, current_auc: float | None, feature_set: str,
            label: str = "label") -> tuple[bool, float]:
    """Save the model, with its feature-set name beside it, only when its area under the curve beats the current."""
    auc = roc_auc(score(candidate, val), label, "p").first()["roc_auc"]
    better = current_auc is None or auc > current_auc
    if better:
        candidate.write().overwrite().save(f"{path}/model")
        val.sparkSession.createDataFrame([(feature_set, float(auc))], "feature_set string, roc_auc double").coalesce(
            1).write.mode("overwrite").json(f"{path}/card")
    return better, auc


def embedding_classifier(df: DataFrame, vector: str = "embedding", label: str = "label", hidden: tuple[int, ...] = (
        512, 256, 128), iterations: int = 50, seed: int = 42, held_out: DataFrame | None = None):
    """Feed-forward classifier over an embedding column; returns (model, scored table): the held-out rows where they are given."""
    features = lambda rows: rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    ready = features(df)
    shape = ready.agg(F.max(F.size(vector)).alias("w"), (F.max(label) + 1).alias("k")).first()
    net = MultilayerPerceptronClassifier(layers=[shape["w"], *hidden, int(shape["k"])], labelCol=label,
                                         featuresCol="features", maxIter=iterations, seed=seed)
    model = net.fit(ready)
    return model, model.transform(ready if held_out is None else features(held_out)).drop("features", "rawPrediction")


def local_explanation(model: PipelineModel | Callable[[DataFrame], DataFrame], events: DataFrame, features: list[str], key: str,
                      samples: int = 200, top: int = 10, seed: int = 3) -> DataFrame:
    """Per event: jittered copies, model scores, distance weights, weighted least squares; the largest coefficients.

    A row's copies follow each other in its task, from their explode through the model to the sums, so no event is shuffled or
    gathered: a batch adds its part of the weighted Gram matrix and right-hand side, and an event is solved when its last copy has
    passed. `model` may be a function that adds `p`.
    """
    scorer = model if callable(model) else lambda rows: score(model, rows)
    copies = events.select(key, *features).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    origin = copies.withColumn("_o", F.array(*[F.col(f).cast("double") for f in features]))
    jitter = {f: F.when(F.col("_s") == 0, F.col(f)).otherwise(
        F.col(f) + (hash_unit(F.col(key), F.col("_s"), F.lit(f), seed=seed) - 0.5)) for f in features}
    scored = scorer(origin.withColumns(jitter)).select(
        F.col(key).alias("_key"), "_s", F.col("p").cast("double").alias("p"), "_o", F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    width, spread = len(features), 0.75 * math.sqrt(len(features))

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right, seen = np.zeros((width + 1, width + 1)), np.zeros(width + 1), 0
        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            away = x - b.column("_o").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            w = np.exp(-(away ** 2).sum(1) / spread ** 2)
            a, p = np.hstack([away, np.ones((b.num_rows, 1))]), b.column("p").to_numpy(zero_copy_only=False)
            keys, names, weights = [], [], []
            at = 0
            while at < b.num_rows:
                to = min(b.num_rows, at + samples - seen)
                part = a[at:to] * w[at:to, None]
                gram, right, seen, at = gram + part.T @ a[at:to], right + part.T @ p[at:to], seen + to - at, to
                if seen == samples:
                    coef = np.linalg.solve(gram + np.eye(width + 1) * 1e-3, right)[:-1]
                    order = np.argsort(-np.abs(coef), kind="stable")[:top]
                    keys += [at - 1] * len(order)
                    names += [features[k] for k in order]
                    weights += coef[order].tolist()
                    gram, right, seen = np.zeros_like(gram), np.zeros_like(right), 0
            if keys:
                yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(keys)), pa.array(names), pa.array(weights)],
                                                 [key, "feature", "weight"])

    key_type = events.schema[key].dataType.simpleString()
    return scored.mapInArrow(solve, f"{key} {key_type}, feature string, weight double")
