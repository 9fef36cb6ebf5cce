"""boosted trees over packed blocks against Spark's own, and what a fit may grow with."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import boosting, models

NAMES = ["a", "b", "c", "d", "e", "one"]


@pytest.fixture(scope="module")
def rows(spark):
    """Flags, one feature of seven values, one of forty, a constant; labels depend on several of them at once."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    df = spark.range(0, 4000, 1, 4).select(
        F.col("id").alias("k"), (u(1) < 0.3).cast("double").alias("a"), (u(2) < 0.6).cast("double").alias("b"),
        F.floor(u(3) * 7).cast("double").alias("c"), F.floor(u(4) * u(4) * 40).cast("double").alias("d"),
        (u(5) < 0.01).cast("double").alias("e"), F.lit(1.0).alias("one"), (u(6) < 0.2).alias("held"), u(7).alias("noise"))
    signal = F.col("a") + F.col("b") * (F.col("c") > 3).cast("int") * 2 - F.col("d") / 20 + F.col("e") + F.col("noise") * 2
    return models.with_weights(df.withColumn("label", (signal > 1.2).cast("int"))).drop("noise").cache()


def margins(model, df):
    out = model.transform(df).select("k", vector_to_array("rawPrediction")[1].alias("m"), vector_to_array("probability")[1].alias("p"), "prediction")
    return out.orderBy("k").toPandas()


@pytest.mark.parametrize("weight", [None, "weight"])
@pytest.mark.parametrize("validation", [None, "held"])
def test_same_trees_as_spark(spark, rows, weight, validation, monkeypatch):
    monkeypatch.setattr(boosting, "CUT", 3)
    case = dict(maxIter=8, maxDepth=4, stepSize=0.3, maxBins=64, minInstancesPerNode=20)
    mine = models.boosted_trees(NAMES, "histogram", weight=weight, validation=validation, **case).fit(rows)
    gbt = GBTClassifier(labelCol="label", featuresCol="features", seed=42, **case)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    ready = models.Pipeline(stages=models.assembler(NAMES)).fit(rows)
    theirs = gbt.fit(ready.transform(rows))
    assert mine.stages[-1].getNumTrees == theirs.getNumTrees and mine.stages[-1].treeWeights == theirs.treeWeights
    got, want = margins(mine, rows), margins(theirs, ready.transform(rows))
    for c in ("m", "p", "prediction"):
        assert np.abs(got[c] - want[c]).max() < 1e-6, c
    assert got.m.nunique() > 50


def test_wide_features_samples_and_nothing_to_learn(spark, rows, monkeypatch):
    """A feature of many values gets quantile bins; a sampled fit still learns; without a held row all trees are kept; constants
    leave the mean label."""
    monkeypatch.setattr(boosting, "KEPT", 500)
    wide = rows.withColumn("w", F.col("d") + F.rand(3))
    model = models.boosted_trees(["w", *NAMES[:3]], "classic", maxIter=20).fit(wide)
    exact = models.boosted_trees(NAMES, "classic", maxIter=20).fit(rows)
    hit = lambda m, df: models.score(m, df).agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("a")).first().a
    assert hit(model, wide) > 0.8 and abs(hit(model, wide) - hit(exact, rows)) < 0.03
    whole = models.boosted_trees(NAMES, "histogram", maxIter=2, validation="held").fit(rows.where("NOT held"))
    assert whole.stages[-1].getNumTrees == 2
    flat = models.boosted_trees(["one"], "histogram", maxIter=1).fit(rows)
    mean = rows.agg(F.avg(F.col("label") * 2 - 1)).first()[0]
    assert np.allclose(margins(flat, rows).m, mean)


def test_fits_share_one_job_a_level(spark, rows):
    """Fits of different sizes give what each gives alone, in the jobs of the deepest."""
    sc = spark.sparkContext
    cases = [("histogram", dict(maxIter=10, maxDepth=3)), ("classic", dict(maxIter=4, maxDepth=2)), ("audit", dict(maxIter=6, maxDepth=3))]
    pipes = [models.boosted_trees(NAMES, name, validation="held", **case) for name, case in cases]
    alone = [p.fit(rows) for p in pipes]
    sc.setJobGroup("fits", "fits")
    try:
        together = models.fit_all(pipes, [rows] * 3)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [m.stages[-1].getNumTrees > 0 for m in together] == [True] * 3
    assert np.abs(margins(alone[0], rows).m - margins(together[0], rows).m).max() < 1e-9  # the others draw their rows by block
    assert len(sc.statusTracker().getJobIdsForGroup("fits")) <= 10 * 3 + 25
