"""Model and dataset evaluation as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import exact_quantiles, running_totals, unit_chunk


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(df: DataFrame, label: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and the derived rates, zero where a denominator is zero."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    out = df.groupBy(*(keys or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"),
        F.count_if(y & ~p).alias("fn"))
    return rates(out)


def rates(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp)})


def score_counts(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Distinct scores with positive and negative counts; the only full pass over the rows."""
    return df.groupBy(*(keys or []), F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def _keyed(df: DataFrame, keys: list[str] | None) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("_one", F.lit(1)), ["_one"])


def roc_auc(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Exact area: every pair (positive, negative) counts 1 when ordered rightly and half when tied."""
    counts, by = _keyed(score_counts(df, label, score, keys), keys)
    run = running_totals(counts, by, "score", ["pos", "neg"], unit_chunk("score"))
    below = F.col("cum_neg") - F.col("neg")
    out = run.groupBy(*by).agg((F.sum(F.col("pos") * (below + F.col("neg") / 2.0)) / F.nullif(
        F.max("tot_pos").cast("double") * F.max("tot_neg"), F.lit(0.0))).alias("roc_auc"),
        F.max("tot_pos").alias("positives"), F.max("tot_neg").alias("negatives"))
    return out if keys else out.drop("_one")


def roc_curve(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(threshold, tpr, fpr) per distinct score, highest first."""
    counts, by = _keyed(score_counts(df, label, score, keys), keys)
    run = running_totals(counts, by, "score", ["pos", "neg"], unit_chunk("score"), descending=True)
    out = run.select(*by, F.col("score").alias("threshold"), _ratio(F.col("cum_pos").cast("double"), F.col(
        "tot_pos")).alias("tpr"), _ratio(F.col("cum_neg").cast("double"), F.col("tot_neg")).alias("fpr"))
    return out if keys else out.drop("_one")


def youden_threshold(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one on a tie."""
    curve, by = _keyed(roc_curve(df, label, score, keys), keys)
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    out = curve.groupBy(*by).agg(F.max(F.struct(j.alias("j"), "threshold", "tpr", "fpr")).alias("b")).select(*by, "b.*")
    return out if keys else out.drop("_one")


def brier(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Equal-width buckets over [0, 1); a score of exactly 1 falls outside, as in the original."""
    b = F.floor(F.col(score) * bins).cast("int")
    return (df.where(F.col(score) < 1.0).groupBy(b.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"),
                 F.avg(F.col(label).cast("double")).alias("actual_rate"))
            .withColumn("error", F.abs(F.col("mean_predicted") - F.col("actual_rate"))))


def calibration_summary(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean bucket error and the share of scores outside (0.05, 0.95)."""
    error = calibration(df, label, score, bins).agg(F.avg("error").alias("mean_error"))
    extreme = df.agg((F.count_if((F.col(score) < 0.05) | (F.col(score) > 0.95)) * 100.0 / F.count(F.lit(1))).alias(
        "pct_extreme"))
    return error.withColumn("_j", F.lit(1)).join(extreme.withColumn("_j", F.lit(1)), "_j").drop("_j")


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class precision, recall, F1 and support from one pair count."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = pairs.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")))).alias("r")).select("r.*")
    s = rows.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    hit = F.col("hit").cast("double")
    return s.select("class", "support", _ratio(hit, F.col("predicted")).alias("precision"),
                    _ratio(hit, F.col("support")).alias("recall"),
                    _ratio(2 * hit, F.col("support") + F.col("predicted")).alias("f1"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes: list) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual")).pivot(pred, classes).count().na.fill(0)


def per_group(df: DataFrame, group: str, label: str, pred: str, min_rows: int = 5) -> DataFrame:
    """Confusion metrics per group; small groups are left out as in the original evaluation."""
    out = confusion(df, label, pred, [group])
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.withColumn("n", n).where(F.col("n") >= min_rows)


def summary(df: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """mean, population std, min and max of metrics over folds, long form."""
    long = df.select(*(keys or []), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("e"))
    return long.groupBy(*(keys or []), F.col("e.metric").alias("metric")).agg(
        F.avg("e.v").alias("mean"), F.stddev_pop("e.v").alias("std"), F.min("e.v").alias("min"), F.max("e.v").alias(
            "max"))


def compare(*named: tuple[str, DataFrame]) -> DataFrame:
    """Metric rows of several approaches with the F1 gain over the first."""
    out = None
    for i, (name, m) in enumerate(named):
        row = m.select(F.lit(i).alias("pos"), F.lit(name).alias("approach"), "accuracy", "precision", "recall", "f1",
                       "fpr", "fnr", "tp", "fp", "tn", "fn")
        out = row if out is None else out.unionByName(row)
    base = out.where(F.col("pos") == 0).select(F.lit(1).alias("_j"), F.col("f1").alias("_b"))
    return out.withColumn("_j", F.lit(1)).join(F.broadcast(base), "_j").withColumn(
        "f1_gain", F.col("f1") - F.col("_b")).drop("_j", "_b")


def feature_separation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Per-feature class means, separation, variance, dominance (> 0.7) and zero variance (< 1e-6)."""
    aggs = []
    for f in features:
        v, y = F.col(f), F.col(label)
        aggs += [F.avg(F.when(y == 0, v)).alias(f"{f}__b"), F.avg(F.when(y == 1, v)).alias(f"{f}__m"),
                 F.var_pop(v).alias(f"{f}__v")]
    row = df.agg(*aggs)
    out = row.select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"{f}__b").alias("mean_benign"), F.col(f"{f}__m").alias("mean_malicious"),
        F.col(f"{f}__v").alias("variance")) for f in features])).alias("r")).select("r.*")
    sep = F.abs(F.col("mean_malicious") - F.col("mean_benign"))
    return out.withColumns({"separation": sep, "dominant": sep > 0.7, "zero_variance": F.col("variance") < 1e-6})


def mean_drift(df: DataFrame, features: list[str], split: str, near: float = 0.01) -> DataFrame:
    """Train and validation means per feature and whether they are nearly equal; one pass, wide, then long."""
    row = df.agg(*[a for f in features for a in (F.avg(F.when(F.col(split) == "train", F.col(f))).alias(f"{f}__t"),
                                                 F.avg(F.when(F.col(split) == "val", F.col(f))).alias(f"{f}__v"))])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__t").alias("train_mean"),
                                                  F.col(f"{f}__v").alias("val_mean")) for f in features])).alias("r"))
    out = out.select("r.*").withColumn("drift", F.abs(F.col("train_mean") - F.col("val_mean")))
    return out.withColumn("near_equal", F.col("drift") < near)


def vector_overlap(df: DataFrame, features: list[str], split: str) -> DataFrame:
    """Distinct vectors and the share of validation vectors seen in training; one shuffle of distinct vectors."""
    flags = df.groupBy(*features).agg(F.max(F.col(split) == "train").alias("t"), F.max(F.col(split) == "val").alias(
        "v"))
    return flags.agg(F.count(F.lit(1)).alias("distinct_vectors"), F.count_if("t").alias("train_vectors"),
                     F.count_if("v").alias("val_vectors"), F.count_if(F.col("t") & F.col("v")).alias("shared")
                     ).withColumn("overlap_pct", _ratio(F.col("shared") * 100.0, F.col("val_vectors")))


def case_evaluation(cases: DataFrame) -> DataFrame:
    """Cases (expected_label, predicted_label, expected, detected arrays) to case metrics and technique recall."""
    y, p = F.col("expected_label") == 1, F.col("predicted_label") == 1
    hits = F.size(F.array_intersect("expected", "detected"))
    out = cases.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"),
                    F.count_if(y & ~p).alias("fn"), F.sum(hits).alias("technique_hits"),
                    F.sum(F.size("expected")).alias("technique_total"))
    return rates(out).withColumn("technique_recall", _ratio(F.col("technique_hits").cast("double"),
                                                            F.col("technique_total")))


def robustness(df: DataFrame, scenario: str, label: str, pred: str, base: str = "base") -> DataFrame:
    """Accuracy per scenario and its drop against the base scenario."""
    acc = df.groupBy(scenario).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
                                   F.avg(F.when(F.col(label) == 1, F.col(pred).cast("double"))).alias("detection_rate"))
    ref = acc.where(F.col(scenario) == base).select(F.lit(1).alias("_j"), F.col("accuracy").alias("_b"))
    out = acc.withColumn("_j", F.lit(1)).join(F.broadcast(ref), "_j")
    drop = F.col("_b") - F.col("accuracy")
    return out.withColumns({"drop": drop, "verdict": F.when(drop < 0.02, "[OK]").when(
        drop > 0.10, "[!!] FRAGILE").otherwise("[NOTE] Minor drop")}).drop("_j", "_b")


def audit_issues(df: DataFrame) -> DataFrame:
    """Ordered issue list from leakage_detected, naive_accuracy, fold_std, adversarial_rate and brier."""
    from tidewatch.functions.text import listed

    c = F.col
    issues = listed(
        (c("leakage_detected"), "CRITICAL: Source is perfect predictor (synthetic=benign, evtx=malicious)"),
        (c("naive_accuracy") > 0.95, F.format_string("CRITICAL: Naive source-only baseline = %.1f%%",
                                                     c("naive_accuracy") * 100)),
        (c("fold_std") > 0.10, F.format_string("HIGH: GroupKFold std=%.4f — inconsistent generalization",
                                               c("fold_std"))),
        (c("adversarial_rate") > 0.90, F.format_string(
            "MEDIUM: Adversarial evasion easy — model relies on event_id not behavior (%.1f%% detected with 0 "
            "behavioral features)", c("adversarial_rate") * 100)),
        (c("brier") > 0.15, F.format_string("MEDIUM: Poor calibration (Brier=%.4f)", c("brier"))))
    return df.withColumn("issues", issues).withColumn("n_issues", F.size("issues"))


def readiness_verdict(df: DataFrame) -> DataFrame:
    """Verdict from synthetic_pct, overlap_pct, accuracy and the number of dominant features."""
    from tidewatch.functions.text import listed

    c = F.col
    levels = listed((c("synthetic_pct") > 40, "CRITICAL"), (c("overlap_pct") > 20, "HIGH"),
                    (c("accuracy") > 0.99, "HIGH"), (c("dominant_features") > 0, "MEDIUM"))
    n = lambda lv: F.size(F.filter(levels, lambda x: x == lv))
    verdict = (F.when(n("CRITICAL") > 0, "NOT PRODUCTION READY").when(n("HIGH") >= 2, "CAUTIOUS")
               .when(F.size(levels) > 0, "ACCEPTABLE").otherwise("PRODUCTION READY"))
    return df.withColumns({"issue_levels": levels, "verdict": verdict})


def quantile_threshold(df: DataFrame, score: str, q: float) -> DataFrame:
    """Exact quantile of a score as one row."""
    return exact_quantiles(df, [], score, [q]).select(F.col("q")[0].alias("threshold"), "n")
