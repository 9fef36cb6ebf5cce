"""Queries on quality, evaluation, drift, data sets and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import datasets, drift, evaluate, features, matching, models, monitor, quality, scoring
from tidewatch.operators.ordered import exact_quantiles
from tidewatch.plans.detect import (
    _KB, _V1, _V1TEXT, _V3, _BTEXT, _wide, ROUTED, among, any_word, b, events, lit, r, r6, scored, se)
from tidewatch.rules import attack as A
from tidewatch.rules import detection as D
from tidewatch.rules import labels as L
from tidewatch.schema import load
from tidewatch.session import materialise, shared_dir

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def _ev(spark, sf, *names):
    return events(spark, sf, *names)


_P = f"{se('event_key', 'event_ts', 'source_type', 'score', 'label', 'event_type')}, p AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM se)"
_CM = ("count(CASE WHEN label = 1 AND pred = 1 THEN 1 END) AS tp, count(CASE WHEN label = 0 AND pred = 1 THEN 1 END) AS fp, "
       "count(CASE WHEN label = 0 AND pred = 0 THEN 1 END) AS tn, count(CASE WHEN label = 1 AND pred = 0 THEN 1 END) AS fn")
_RATES = ", ".join(f"round(coalesce(CAST({a} AS DOUBLE) / nullif({d}, 0), 0.0), 6) AS {n}" for n, a, d in [
    ("accuracy", "(tp + tn)", "(tp + tn + fp + fn)"), ("precision", "tp", "(tp + fp)"), ("recall", "tp", "(tp + fn)"),
    ("f1", "(2 * tp)", "(2 * tp + fp + fn)"), ("fpr", "fp", "(fp + tn)"), ("fnr", "fn", "(fn + tp)")])
RATE_NAMES = ["accuracy", "precision", "recall", "f1", "fpr", "fnr"]


def predicted(spark, sf):
    ev = _ev(spark, sf, "event_key", "event_ts", "source_type", "score", "label", "event_type")
    return ev.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def _rates(df, *keep):
    return df.select(*keep, "tp", "fp", "tn", "fn", *[r(c).alias(c) for c in RATE_NAMES])


@query("confusion_metrics", f"WITH {_P}, c AS (SELECT {_CM} FROM p) SELECT tp, fp, tn, fn, {_RATES} FROM c")
def confusion_metrics(spark, sf):
    return _rates(evaluate.confusion(predicted(spark, sf), "label", "pred"))


@query("per_source_metrics", f"WITH {_P}, c AS (SELECT source_type, {_CM} FROM p GROUP BY 1) SELECT source_type, tp, fp, tn, fn, "
       f"{_RATES} FROM c WHERE tp + fp + tn + fn >= 5")
def per_source_metrics(spark, sf):
    return _rates(evaluate.per_group(predicted(spark, sf), "source_type", "label", "pred"), "source_type")


_AUC = ("rk AS (SELECT {k} label, rank() OVER ({w} ORDER BY score) + (count(*) OVER ({w2} score) - 1) / 2.0 AS rk FROM p)")


@query("roc_auc", f"WITH {_P}, " + _AUC.format(k="", w="", w2="PARTITION BY") + " SELECT round((sum(CASE WHEN label = 1 THEN rk END) - "
       "count(CASE WHEN label = 1 THEN 1 END) * (count(CASE WHEN label = 1 THEN 1 END) + 1) / 2.0) / (CAST(count(CASE WHEN label = 1 "
       "THEN 1 END) AS DOUBLE) * count(CASE WHEN label = 0 THEN 1 END)), 6) AS roc_auc FROM rk")
def roc_auc(spark, sf):
    return evaluate.roc_auc(predicted(spark, sf), "label", "score").select(r("roc_auc").alias("roc_auc"))


@query("roc_auc_by_source", f"WITH {_P}, " + _AUC.format(k="source_type,", w="PARTITION BY source_type", w2="PARTITION BY source_type,")
       + " SELECT source_type, round((sum(CASE WHEN label = 1 THEN rk END) - count(CASE WHEN label = 1 THEN 1 END) * (count(CASE WHEN "
       "label = 1 THEN 1 END) + 1) / 2.0) / (CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) * count(CASE WHEN label = 0 THEN 1 "
       "END)), 6) AS roc_auc FROM rk GROUP BY 1")
def roc_auc_by_source(spark, sf):
    return evaluate.roc_auc(predicted(spark, sf), "label", "score", ["source_type"]).select("source_type", r("roc_auc").alias(
        "roc_auc"))


_ROC = ("g AS (SELECT score AS threshold, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg "
        "FROM p GROUP BY 1), cu AS (SELECT threshold, CAST(sum(pos) OVER (ORDER BY threshold DESC) AS DOUBLE) / sum(pos) OVER () AS "
        "tpr, CAST(sum(neg) OVER (ORDER BY threshold DESC) AS DOUBLE) / sum(neg) OVER () AS fpr FROM g)")


@query("roc_curve", f"WITH {_P}, {_ROC} SELECT {r6('threshold')} AS threshold, {r6('tpr')} AS tpr, {r6('fpr')} AS fpr FROM cu")
def roc_curve(spark, sf):
    return evaluate.roc_curve(predicted(spark, sf), "label", "score").select(*[r(c).alias(c) for c in ("threshold", "tpr", "fpr")])


@query("youden_threshold", f"WITH {_P}, {_ROC} SELECT {r6('threshold')} AS threshold, {r6('tpr - fpr')} AS j FROM cu ORDER BY round(tpr "
       "- fpr, 12) DESC, threshold DESC LIMIT 1")
def youden_threshold(spark, sf):
    return evaluate.youden_threshold(predicted(spark, sf), "label", "score").select(r("threshold").alias("threshold"), r("j").alias("j"))


@query("brier_score", f"WITH {_P} SELECT source_type, {r6('avg(power(score - label, 2))')} AS brier FROM p GROUP BY 1")
def brier_score(spark, sf):
    return evaluate.brier(predicted(spark, sf), "label", "score", ["source_type"]).select("source_type", r("brier").alias("brier"))


@query("calibration_buckets", f"WITH {_P} SELECT CAST(floor(score * 10) AS INT) AS bucket, count(*) AS n, {r6('avg(score)')} AS "
       f"mean_predicted, {r6('avg(label)')} AS actual_rate, {r6('abs(avg(score) - avg(label))')} AS error FROM p WHERE score < 1.0 GROUP "
       "BY 1")
def calibration_buckets(spark, sf):
    out = evaluate.calibration(predicted(spark, sf), "label", "score")
    return out.select("bucket", "n", *[r(c).alias(c) for c in ("mean_predicted", "actual_rate", "error")])


@query("calibration_summary", f"WITH {_P}, bk AS (SELECT abs(avg(score) - avg(label)) AS e FROM p WHERE score < 1.0 GROUP BY floor(score "
       f"* 10)) SELECT (SELECT {r6('avg(e)')} FROM bk) AS mean_error, {r6('count(CASE WHEN score < 0.05 OR score > 0.95 THEN 1 END) * 100.0 / count(*)')} AS pct_extreme FROM p")
def calibration_summary(spark, sf):
    return evaluate.calibration_summary(predicted(spark, sf), "label", "score").select(*[r(c).alias(c) for c in (
        "mean_error", "pct_extreme")])


_TIER = "CASE WHEN score >= 0.8 THEN 'malicious_high' WHEN score >= 0.4 THEN 'suspicious_medium' ELSE 'benign' END"
_TRUE = "CASE WHEN label = 1 THEN 'malicious_high' WHEN event_type = 'error' THEN 'suspicious_medium' ELSE 'benign' END"


def tiered(spark, sf):
    s = F.col("score")
    return predicted(spark, sf).select(
        F.when(F.col("label") == 1, "malicious_high").when(F.col("event_type") == "error", "suspicious_medium").otherwise(
            "benign").alias("y"), F.when(s >= 0.8, "malicious_high").when(s >= 0.4, "suspicious_medium").otherwise("benign").alias("p"))


@query("class_report", f"WITH {_P}, t AS (SELECT {_TRUE} AS y, {_TIER} AS g FROM p), k AS (SELECT DISTINCT y AS class FROM t) SELECT class, "
       "count(CASE WHEN y = class THEN 1 END) AS support, round(coalesce(CAST(count(CASE WHEN y = class AND g = class THEN 1 END) AS "
       "DOUBLE) / nullif(count(CASE WHEN g = class THEN 1 END), 0), 0), 6) AS precision, round(CAST(count(CASE WHEN y = class AND g = "
       "class THEN 1 END) AS DOUBLE) / count(CASE WHEN y = class THEN 1 END), 6) AS recall, round(2.0 * count(CASE WHEN y = class AND g = "
       "class THEN 1 END) / (count(CASE WHEN y = class THEN 1 END) + count(CASE WHEN g = class THEN 1 END)), 6) AS f1 FROM k, t GROUP BY 1")
def class_report(spark, sf):
    return evaluate.class_report(tiered(spark, sf), "y", "p").select("class", "support", *[r(c).alias(c) for c in (
        "precision", "recall", "f1")])


@query("class_confusion_matrix", f"WITH {_P}, t AS (SELECT {_TRUE} AS actual, {_TIER} AS g FROM p) SELECT actual, " + ", ".join(
    f"count(CASE WHEN g = {lit(c)} THEN 1 END) AS {c}" for c in ("benign", "suspicious_medium", "malicious_high")) + " FROM t GROUP BY 1")
def class_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(tiered(spark, sf), "y", "p", ["benign", "suspicious_medium", "malicious_high"])


@query("fold_summary", f"WITH {_P}, c AS (SELECT source_type, {_CM} FROM p GROUP BY 1), v AS (SELECT 'accuracy' AS metric, CAST(tp + tn AS "
       "DOUBLE) / (tp + tn + fp + fn) AS v FROM c UNION ALL SELECT 'fpr', CAST(fp AS DOUBLE) / (fp + tn) FROM c) SELECT metric, "
       f"{r6('avg(v)')} AS mean, {r6('stddev_pop(v)')} AS std, {r6('min(v)')} AS min, {r6('max(v)')} AS max FROM v GROUP BY 1")
def fold_summary(spark, sf):
    m = evaluate.confusion(predicted(spark, sf), "label", "pred", ["source_type"])
    return evaluate.summary(m, ["accuracy", "fpr"]).select("metric", *[r(c).alias(c) for c in ("mean", "std", "min", "max")])


_FUSE = ("least(1.0, score * 0.7 + 0.3 * greatest(0.0, " + ", ".join(
    f"CASE WHEN contains({_KB}, {lit(w)}) THEN {v} ELSE 0.0 END" for w, v in D.FUSION_WEIGHTS) + "))")
_RULE = (f"CASE WHEN {any_word(_KB, D.BASELINE_CRITICAL + D.BASELINE_HIGH)} OR event_id IN {among(D.BASELINE_IDS)} THEN 1 ELSE 0 END")


@query("baseline_comparison", f"WITH {se()}, x AS (SELECT 'rules' AS approach, label, {_RULE} AS pred FROM se UNION ALL SELECT 'score', label, "
       f"CASE WHEN score >= 0.5 THEN 1 ELSE 0 END FROM se UNION ALL SELECT 'fusion', label, CASE WHEN round({_FUSE}, 9) >= 0.5 THEN 1 ELSE "
       f"0 END FROM se), c AS (SELECT approach, {_CM} FROM x GROUP BY 1), f AS (SELECT *, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f FROM c) "
       f"SELECT approach, tp, fp, tn, fn, round(f - (SELECT f FROM f WHERE approach = 'rules'), 6) AS f1_gain FROM f")
def baseline_comparison(spark, sf):
    ev = _ev(spark, sf)
    rule, _ = scoring.keyword_baseline()
    t = ev.withColumns({"r": rule, "s": (F.col("score") >= 0.5).cast("int"),
                        "f": (F.round(scoring.pattern_fusion(F.col("score")), 9) >= 0.5).cast("int")})
    m = {n: evaluate.confusion(t, "label", c) for n, c in (("rules", "r"), ("score", "s"), ("fusion", "f"))}
    return evaluate.compare(*m.items()).select("approach", "tp", "fp", "tn", "fn", r("f1_gain").alias("f1_gain"))


_ALL41 = list(features.V3_NAMES)
_V3SQL = _wide(_V3, _BTEXT)


def v3(spark, sf):
    return features.v3_41(_ev(spark, sf))


def v3_rounded(spark, sf, *keep):
    """All 41 features at the reference's precision."""
    return v3(spark, sf).select(*keep, *[r(c).alias(c) for c in _ALL41])


@query("feature_separation", f"WITH f AS ({_V3SQL}), {se('event_key', 'label')}, j AS (SELECT f.*, label FROM f JOIN se USING (event_key)) " +
       " UNION ALL ".join(
           f"SELECT {lit(c)} AS feature, {r6(f'avg(CASE WHEN label = 0 THEN {c} END)')} AS mean_benign, "
           f"{r6(f'avg(CASE WHEN label = 1 THEN {c} END)')} AS mean_malicious, {r6(f'var_pop({c})')} AS variance, var_pop({c}) < 1e-6 AS "
           "zero_variance FROM j" for c in _ALL41))
def feature_separation(spark, sf):
    out = evaluate.feature_separation(v3_rounded(spark, sf, "label"), _ALL41, "label")
    return out.select("feature", *[r(c).alias(c) for c in ("mean_benign", "mean_malicious", "variance")], "zero_variance")


def with_split(df):
    return df.withColumn("split", F.when(F.col("event_key") % 5 == 0, "val").otherwise("train"))


@query("split_mean_drift", f"WITH f AS ({_V3SQL}) " + " UNION ALL ".join(
    f"SELECT {lit(c)} AS feature, {r6(f'avg(CASE WHEN event_key % 5 <> 0 THEN {c} END)')} AS train_mean, "
    f"{r6(f'avg(CASE WHEN event_key % 5 = 0 THEN {c} END)')} AS val_mean FROM f" for c in _ALL41))
def split_mean_drift(spark, sf):
    return evaluate.mean_drift(with_split(v3_rounded(spark, sf, "event_key")), _ALL41, "split").select("feature", r("train_mean").alias("train_mean"), r(
        "val_mean").alias("val_mean"))


_ALL3 = ", ".join(f'"{c}"' for c in _V3)


@query("vector_overlap", f"WITH f AS ({_V3SQL}), g AS (SELECT {_ALL3}, bool_or(event_key % 5 <> 0) AS t, bool_or(event_key % 5 = 0) AS v FROM f "
       "GROUP BY ALL) SELECT count(*) AS distinct_vectors, count(CASE WHEN t THEN 1 END) AS train_vectors, count(CASE WHEN v THEN 1 END) AS "
       "val_vectors, count(CASE WHEN t AND v THEN 1 END) AS shared, round(100.0 * count(CASE WHEN t AND v THEN 1 END) / count(CASE WHEN v "
       "THEN 1 END), 6) AS overlap_pct FROM g")
def vector_overlap(spark, sf):
    out = evaluate.vector_overlap(with_split(v3(spark, sf)), list(_V3), "split")
    return out.select("distinct_vectors", "train_vectors", "val_vectors", "shared", r("overlap_pct").alias("overlap_pct"))


_KEY = "concat(command_line, '|', process_name)"


@query("split_key_leakage", f"WITH {se()}, k AS (SELECT {_KEY} AS k FROM se WHERE event_key % 5 <> 0 INTERSECT SELECT {_KEY} FROM se WHERE "
       "event_key % 5 = 0) SELECT count(*) AS leaked_keys FROM k WHERE k <> '|'")
def split_key_leakage(spark, sf):
    return quality.key_leakage(with_split(_ev(spark, sf)), "split", quality.event_key())


_TAGEXP = "CASE WHEN event_type = 'error' THEN ['T1003', 'T1490'] WHEN event_type = 'click' THEN ['T1059.001'] ELSE [] END"
_TAGCASE = ", ".join(f"CASE WHEN {any_word('txt', ws)}" + (f" OR event_id IN {among(ids)}" if ids else "") + f" THEN {lit(t)} END"
                     for t, ws, ids in A.SCENARIO_TAGS)


@query("scenario_evaluation", f"WITH {se()}, tt AS (SELECT *, {_KB} AS txt FROM se), d AS (SELECT hostname, label, score, {_TAGEXP} AS "
       f"expected, list_filter([{_TAGCASE}], lambda x: x IS NOT NULL) AS detected FROM tt), cs AS (SELECT hostname, max(label) AS y, max(score) AS p, "
       "list_distinct(flatten(list(expected))) AS e, list_distinct(flatten(list(detected))) AS g FROM d GROUP BY 1) SELECT count(CASE "
       "WHEN y = 1 AND p >= 0.6 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND p >= 0.6 THEN 1 END) AS fp, count(CASE WHEN y = 0 AND p < "
       "0.6 THEN 1 END) AS tn, count(CASE WHEN y = 1 AND p < 0.6 THEN 1 END) AS fn, CAST(sum(len(list_intersect(e, g))) AS BIGINT) AS "
       "technique_hits, CAST(sum(len(e)) AS BIGINT) AS technique_total, round(CAST(sum(len(list_intersect(e, g))) AS DOUBLE) / sum(len(e)), 6) AS "
       "technique_recall FROM cs")
def scenario_evaluation(spark, sf):
    """One case per host: best score, tagged and expected techniques."""
    ev = _ev(spark, sf)
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    exp = F.when(F.col("event_type") == "error", arr("T1003", "T1490")).when(F.col("event_type") == "click", arr(
        "T1059.001")).otherwise(F.array().cast("array<string>"))
    rows = ev.select("hostname", "label", "score", exp.alias("e"), matching.scenario_tags().alias("d"))
    # distinct (case, technique) pairs first, so a case gathers at most the tag vocabulary
    base = rows.groupBy("hostname").agg(F.max("label").alias("expected_label"), (F.max("score") >= 0.6).cast("int").alias(
        "predicted_label"))
    tags = rows.select("hostname", F.explode(F.concat(F.transform("e", lambda t: F.struct(F.lit("e").alias("s"), t.alias("t"))),
                                                      F.transform("d", lambda t: F.struct(F.lit("d").alias("s"), t.alias(
                                                          "t"))))).alias("x")).select("hostname", "x.*").distinct()
    sets = tags.groupBy("hostname").agg(F.collect_set(F.when(F.col("s") == "e", F.col("t"))).alias("expected"),
                                        F.collect_set(F.when(F.col("s") == "d", F.col("t"))).alias("detected"))
    none = F.array().cast("array<string>")
    cases = base.join(sets, "hostname", "left").withColumns({"expected": F.coalesce("expected", none),
                                                             "detected": F.coalesce("detected", none)})
    return evaluate.case_evaluation(cases).select("tp", "fp", "tn", "fn", "technique_hits", "technique_total", r(
        "technique_recall").alias("technique_recall"))


@query("class_balance", f"WITH {se('event_key', 'score')}, t AS (SELECT {_TIER} AS c FROM se) SELECT k.class, count(t.c) AS n, "
       "round(100.0 * count(t.c) / (SELECT count(*) FROM t), 6) AS percent FROM (VALUES " + ", ".join(f"({lit(c)})" for c in L.CLASSES) +
       ") AS k(class) LEFT JOIN t ON t.c = k.class GROUP BY 1")
def class_balance(spark, sf):
    return quality.class_balance(tiered(spark, sf), "p").select("class", "n", r("percent").alias("percent"))


_NE = lambda c: f"count(CASE WHEN \"{c}\" IS NOT NULL AND CAST(\"{c}\" AS STRING) <> '' THEN 1 END) AS with_{c}"


@query("field_completeness", f"WITH {se()} SELECT count(*) AS total, " + ", ".join(_NE(c) for c in quality.COMPLETENESS) + ", count(CASE "
       "WHEN command_line = '' AND process_name = '' AND destination_ip = '' AND source_ip = '' THEN 1 END) AS empty_events FROM se")
def field_completeness(spark, sf):
    return quality.completeness(_ev(spark, sf))


@query("label_consistency", "SELECT (SELECT count(*) FROM documents) AS n_events, (SELECT count(*) FROM labels) AS n_labels, (SELECT "
       "count(*) FROM labels WHERE quality NOT IN (1)) AS invalid_labels, (SELECT count(*) FROM documents) <> (SELECT count(*) FROM "
       "labels) AS size_mismatch")
def label_consistency(spark, sf):
    return quality.label_consistency(load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels"), "quality", [1])


@query("source_contingency", f"WITH {_P}, c AS (SELECT source_type AS source, count(CASE WHEN label = 0 THEN 1 END) AS benign, count(CASE WHEN "
       "label = 1 THEN 1 END) AS malicious FROM p GROUP BY 1) SELECT source, benign, malicious, round(100.0 * malicious / (benign + "
       "malicious), 6) AS malicious_pct, CASE WHEN malicious = 0 OR benign = 0 THEN 'PERFECT SEPARATION' WHEN 100.0 * malicious / "
       "(benign + malicious) > 95 OR 100.0 * malicious / (benign + malicious) < 5 THEN 'NEAR-PERFECT' ELSE 'Mixed' END AS risk FROM c")
def source_contingency(spark, sf):
    return quality.source_contingency(predicted(spark, sf), "source_type", "label").select(
        "source", "benign", "malicious", r("malicious_pct").alias("malicious_pct"), "risk")


@query("naive_source_baseline", f"WITH {_P}, q AS (SELECT label, CASE WHEN source_type = 'firewall' THEN 0 ELSE 1 END AS pred FROM p), c AS "
       f"(SELECT {_CM} FROM q) SELECT tp, fp, tn, fn, {_RATES} FROM c")
def naive_source_baseline(spark, sf):
    return _rates(quality.naive_source_baseline(predicted(spark, sf), "source_type", "label", "firewall"))


@query("event_id_class_mix", f"WITH {se('event_id', 'label')} SELECT event_id, count(CASE WHEN label = 0 THEN 1 END) AS benign, count(CASE WHEN "
       "label = 1 THEN 1 END) AS malicious, bool_or(label = 0) AND bool_or(label = 1) AS shared FROM se GROUP BY 1")
def event_id_class_mix(spark, sf):
    return quality.attribute_class_mix(_ev(spark, sf, "event_id", "label"), "event_id", "label")


@query("readiness", f"WITH {se()}, t AS (SELECT *, {_TIER} AS c FROM se WHERE event_key % 5 <> 0), bal AS (SELECT c, count(*) AS n FROM t "
       f"GROUP BY 1), lk AS (SELECT {_KEY} AS k FROM se WHERE event_key % 5 <> 0 INTERSECT SELECT {_KEY} FROM se WHERE event_key % 5 = 0), "
       "m AS (SELECT (SELECT max(n) * 1.0 / min(n) > 10 FROM bal) AS i1, (SELECT count(*) < 1000 FROM t) AS i2, (SELECT count(CASE WHEN "
       "command_line <> '' THEN 1 END) * 1.0 / count(*) < 0.5 FROM t) AS i3, (SELECT count(*) FROM lk WHERE k <> '|') > 0.05 * (SELECT "
       "count(*) FROM se WHERE event_key % 5 = 0) AS i5) SELECT concat_ws(', ', CASE WHEN i1 THEN 'class imbalance' END, CASE WHEN i2 THEN "
       "'too few events' END, CASE WHEN i3 THEN 'few events with command_line' END, CASE WHEN i5 THEN 'split leakage' END) AS issues, NOT "
       "(i3 OR i5) AS ready FROM m")
def readiness(spark, sf):
    s = F.col("score")
    ev = with_split(_ev(spark, sf)).withColumn("class", F.when(s >= 0.8, "malicious_high").when(
        s >= 0.4, "suspicious_medium").otherwise("benign"))
    out = quality.readiness(ev.where("split = 'train'"), ev, "class", "split", L.CLASSES)
    return out.select(F.array_join("issues", ", ").alias("issues"), "ready")


@query("class_weights", f"WITH {_P}, c AS (SELECT event_type, count(*) AS n FROM p GROUP BY 1) SELECT event_type, n, round((1.0 / n) / sum(1.0 "
       "/ n) OVER (), 6) AS weight FROM c")
def class_weights(spark, sf):
    return quality.class_weights(predicted(spark, sf), "event_type").select("event_type", "n", r("weight").alias("weight"))


@query("dataset_statistics", f"WITH {_P}, x AS (SELECT CASE WHEN event_key % 5 = 0 THEN 'val' ELSE 'train' END AS split, label, source_type FROM "
       "p) SELECT split, count(*) AS size, count(CASE WHEN label = 1 THEN 1 END) AS malicious, count(CASE WHEN source_type = 'sysmon' THEN 1 "
       "END) AS sysmon FROM x GROUP BY 1")
def dataset_statistics(spark, sf):
    out = quality.dataset_statistics(with_split(predicted(spark, sf)), "split", "source_type", "label")
    return out.select("split", "size", F.col("classes")["1"].alias("malicious"), F.col("sources")["sysmon"].alias("sysmon"))


# ---------------------------------------------------------------- operations
_MX = ("m AS (SELECT count(*) AS total_processed, count(CASE WHEN classification = 'benign' THEN 1 END) AS benign_filtered, count(CASE WHEN "
       "classification = 'malicious' THEN 1 END) AS malicious_detected, count(CASE WHEN classification = 'malicious' AND path = 'fast' THEN "
       "1 END) AS fast_path_count, count(CASE WHEN classification = 'malicious' AND path = 'deep' THEN 1 END) AS deep_path_count FROM ro)")


@query("processing_metrics", f"WITH {ROUTED}, {_MX} SELECT *, round(100.0 * benign_filtered / total_processed, 6) AS filter_rate, round(100.0 * "
       "deep_path_count / nullif(malicious_detected, 0), 6) AS deep_path_rate, round(100.0 * malicious_detected / total_processed, 6) AS "
       "detection_rate, CASE WHEN 100.0 * malicious_detected / total_processed < 5 THEN 'Excellent' WHEN 100.0 * malicious_detected / "
       "total_processed < 20 THEN 'Good' WHEN 100.0 * malicious_detected / total_processed < 50 THEN 'Warning' ELSE 'Critical' END AS health "
       "FROM m")
def processing_metrics(spark, sf):
    m = quality.operations_summary(quality.processing_metrics(scored(spark, sf)))
    rate = ["filter_rate", "deep_path_rate", "detection_rate"]
    return m.select(*[c for c in m.columns if c not in rate], *[r(c).alias(c) for c in rate])


@query("metric_exposition", f"WITH {ROUTED}, {_MX} " + " UNION ALL ".join(
    f"SELECT 'events_{c}_total' AS name, CAST({c} AS DOUBLE) AS value FROM m" for c in (
        "total_processed", "benign_filtered", "malicious_detected", "fast_path_count", "deep_path_count")))
def metric_exposition(spark, sf):
    return quality.exposition(quality.processing_metrics(scored(spark, sf)))


@query("high_connections", f"WITH {se('destination_ip')} SELECT destination_ip AS remote_ip, count(*) AS connection_count FROM se WHERE "
       "destination_ip NOT IN ('', '127.0.0.1', '::1') GROUP BY 1 HAVING count(*) > 20")
def high_connections(spark, sf):
    return quality.high_connections(_ev(spark, sf, "destination_ip"), "destination_ip")


@query("channel_counts", f"WITH {se('channel', 'event_id')} SELECT channel, event_id, count(*) AS n FROM se GROUP BY ALL")
def channel_counts(spark, sf):
    return quality.channel_counts(_ev(spark, sf, "channel", "event_id"))


# ---------------------------------------------------------------- drift
_CUT = "TIMESTAMP '2024-01-16 00:00:00'"
_QS = [i / 10 for i in range(11)]


def psi_sql(name: str, base: str, cur: str, keys: str = "") -> str:
    """Stability index of column v between two relations."""
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    qs = ", ".join(f"quantile_cont(v, {q})" for q in _QS)
    counts = lambda rel, alias: (
        f"{alias} AS (SELECT {k}count(*) AS n, " + ", ".join(
            f"count(CASE WHEN len(e) > {i} AND v >= e[{i}] AND (v < e[{i + 1}] OR (len(e) = {i + 1} AND v = e[{i + 1}])) THEN 1 END) AS b{i}"
            for i in range(1, 11)) + f", max(len(e)) AS ne FROM {rel} JOIN {name}_e {on} GROUP BY " + (keys or "()") + ")")
    eps = "0.0000000001"
    share = lambda a, i: f"greatest({a}.b{i} / ({a}.n + {eps}), {eps})"
    terms = " + ".join(f"CASE WHEN bb.ne > {i} THEN ({share('cc', i)} - {share('bb', i)}) * ln({share('cc', i)} / {share('bb', i)}) ELSE 0 END"
                       for i in range(1, 11))
    kk = f"bb.{keys}, " if keys else ""
    return (f"{name}_e AS (SELECT {k}list_sort(list_distinct([{qs}])) AS e FROM {base}" + (f" GROUP BY {keys}" if keys else "") + "), " +
            counts(base, "bb") + ", " + counts(cur, "cc") + f", {name} AS (SELECT {kk}CAST({terms} AS DOUBLE) AS psi FROM bb JOIN cc {on})")


@query("psi_by_source", f"WITH {se('event_ts', 'source_type', 'value')}, bs AS (SELECT source_type, value AS v FROM se WHERE event_ts < {_CUT}), cu AS "
       f"(SELECT source_type, value AS v FROM se WHERE event_ts >= {_CUT}), {psi_sql('ps', 'bs', 'cu', 'source_type')} SELECT source_type, "
       f"{r6('psi')} AS psi FROM ps")
def psi_by_source(spark, sf):
    ev = _ev(spark, sf, "event_ts", "source_type", "value")
    cut = F.expr(_CUT + "")
    return drift.psi(ev.where(F.col("event_ts") < cut), ev.where(F.col("event_ts") >= cut), ["source_type"], "value").select(
        "source_type", r("psi").alias("psi"))


@query("psi_prices", "WITH bs AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17 00:00:00'), cu AS (SELECT "
       "l_extendedprice * (1 - l_discount) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17 00:00:00'), " + psi_sql("ps", "bs", "cu") +
       f" SELECT {r6('psi')} AS psi FROM ps")
def psi_prices(spark, sf):
    li = load(spark, sf, "lineitem")
    cut = F.expr("TIMESTAMP '1995-06-17 00:00:00'")
    base = li.where(F.col("l_shipdate") < cut).select(F.col("l_extendedprice").alias("v"))
    cur = li.where(F.col("l_shipdate") >= cut).select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return drift.psi(base, cur, [], "v").select(r("psi").alias("psi"))


@query("exact_quantiles", "SELECT l_returnflag, count(*) AS n, " + ", ".join(
    f"round(quantile_cont(l_extendedprice, {q}), 6) AS q{int(q * 100)}" for q in (0.0, 0.25, 0.5, 0.9, 1.0)) + " FROM lineitem GROUP BY 1")
def exact_quantiles_query(spark, sf):
    out = exact_quantiles(load(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.25, 0.5, 0.9, 1.0])
    return out.select("l_returnflag", "n", *[r(F.col("q")[i]).alias(f"q{p}") for i, p in enumerate((0, 25, 50, 90, 100))])


_SLOT = ("CASE WHEN len(e) < 2 OR v < e[1] OR v > e[len(e)] THEN 0 ELSE least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) END")
_LONG = ", ".join(f'"{c}"' for c in [*_ALL41, "score"])
_SHARE = lambda m, n: f"greatest({m} / ({n} + 1e-10), 1e-10)"
DRIFT_CHECKS = (
    f"f41 AS ({_V3SQL}), {se('event_key', 'event_ts', 'source_type', 'score')}, rw AS (SELECT se.*, f41.* EXCLUDE (event_key) FROM se JOIN f41 "
    f"USING (event_key)), bs AS (SELECT * FROM rw WHERE event_ts < {_CUT} ORDER BY md5(concat(CAST(event_key AS VARCHAR), ':0')), event_key LIMIT 2000), "
    f"bu AS (UNPIVOT bs ON {_LONG} INTO NAME feature VALUE v), be AS (SELECT feature, list_sort(list_distinct([" +
    ", ".join(f"quantile_cont(v, {i / 10})" for i in range(11)) + "])) AS e, count(*) AS n FROM bu GROUP BY 1), "
    f"bc AS (SELECT feature, {_SLOT} AS bin, count(*) AS m FROM bu JOIN be USING (feature) GROUP BY 1, 2), "
    "nr AS (SELECT *, row_number() OVER (PARTITION BY source_type ORDER BY event_ts, event_key) AS n, count(*) OVER (PARTITION BY source_type) AS "
    f"total FROM rw WHERE event_ts >= {_CUT}), un AS (UNPIVOT nr ON {_LONG} INTO NAME feature VALUE v), "
    f"ub AS (SELECT source_type, (un.n - 1) // 100 + 1 AS block, total // 100 AS last, feature, {_SLOT} AS bin, count(*) AS m FROM un JOIN be USING "
    "(feature) GROUP BY ALL), uf AS (SELECT source_type, feature, bin, m, unnest(range(block, least(block + 4, last) + 1)) AS c FROM ub WHERE block <= last), "
    "uc AS (SELECT source_type, c, feature, bin, sum(m) AS m FROM uf GROUP BY ALL), us AS (SELECT source_type, c, feature, sum(m) AS size FROM uc GROUP BY ALL), "
    "slots AS (SELECT feature, n, unnest(range(1, greatest(len(e), 1))) AS bin FROM be), "
    f"dp AS (SELECT us.source_type, us.c, us.size, us.feature, coalesce(sum(({_SHARE('coalesce(uc.m, 0)', 'us.size')} - {_SHARE('coalesce(bc.m, 0)', 'slots.n')}) * "
    f"ln({_SHARE('coalesce(uc.m, 0)', 'us.size')} / {_SHARE('coalesce(bc.m, 0)', 'slots.n')})), 0.0) AS psi FROM us LEFT JOIN slots USING (feature) LEFT JOIN bc ON "
    "bc.feature = us.feature AND bc.bin = slots.bin LEFT JOIN uc ON uc.source_type = us.source_type AND uc.c = us.c AND uc.feature = us.feature AND uc.bin = "
    "slots.bin GROUP BY ALL)")
_PH_HERE = ("px AS (SELECT *, avg(score) OVER w AS m FROM nr WINDOW w AS (PARTITION BY source_type ORDER BY n ROWS UNBOUNDED PRECEDING)), py AS (SELECT *, "
            "sum(score - m - 0.005) OVER (PARTITION BY source_type ORDER BY n ROWS UNBOUNDED PRECEDING) AS s FROM px), pz AS (SELECT *, s - min(s) OVER "
            "(PARTITION BY source_type ORDER BY n ROWS UNBOUNDED PRECEDING) AS ph FROM py), pa AS (SELECT source_type, min(n) AS alarm_at FROM pz WHERE ph > 50 "
            "GROUP BY 1)")
CHECK_SQL = (
    f"WITH {DRIFT_CHECKS}, {_PH_HERE}, dc AS (SELECT source_type, c, max(size) AS size, max(CASE WHEN feature = 'score' THEN psi END) AS sp, "
    "coalesce(max(CASE WHEN feature <> 'score' AND psi > 0.1 THEN psi END), 0.0) AS mx, count(CASE WHEN feature <> 'score' AND psi > 0.25 THEN 1 END) AS hi "
    "FROM dp GROUP BY 1, 2), fc AS (SELECT source_type, min(c) AS critical_at FROM dc WHERE hi > 0 OR sp > 0.25 GROUP BY 1) SELECT source_type AS stream, "
    "CAST(c * 100 AS BIGINT) AS n_processed, CAST(size AS BIGINT) AS window_size, coalesce(alarm_at <= c * 100, false) OR coalesce(critical_at < c, false) AS "
    "ph_drift, round(sp, 4) AS psi_scores, round(mx, 4) AS max_psi, CAST(hi AS INTEGER) AS n_critical, CASE WHEN hi > 0 OR sp > 0.25 THEN 'CRITICAL' WHEN mx > "
    "0.1 OR sp > 0.1 OR coalesce(alarm_at <= c * 100, false) THEN 'WARNING' ELSE 'none' END AS drift_level FROM dc LEFT JOIN pa USING (source_type) LEFT JOIN "
    "fc USING (source_type)")
CHECK_COLUMNS = ("stream", "n_processed", "window_size", "ph_drift", "psi_scores", "max_psi", "n_critical", "drift_level")


def monitored(spark, sf):
    """(events to watch, stored baseline): the baseline of the events before the cut is written, and read back as a version."""
    named = [r(c).alias(c) for c in _ALL41]
    df = materialise(v3(spark, sf).select("event_key", "event_ts", F.col("source_type").alias("stream"), "score", *named))
    base = shared_dir(spark, "baseline")
    monitor.store_baseline(df.where(F.col("event_ts") < F.expr(_CUT)), "event_key", [*_ALL41, "score"], base)
    return df.where(F.col("event_ts") >= F.expr(_CUT)), monitor.stored_baseline(spark, base)


@query("drift_check", CHECK_SQL)
def drift_check(spark, sf):
    """Every check of each source: 500 last events against the stored baseline, all 100 events."""
    rows, baseline = monitored(spark, sf)
    return monitor.check_rows(rows, "stream", ["event_ts", "event_key"], _ALL41, baseline).select(*CHECK_COLUMNS)


@query("drift_check_features", f"WITH {DRIFT_CHECKS} SELECT source_type AS stream, CAST(c * 100 AS BIGINT) AS n_processed, feature, round(psi, 4) AS psi FROM dp")
def drift_check_features(spark, sf):
    """The stability index of all 41 features and the score at every check."""
    rows, baseline = monitored(spark, sf)
    return monitor.feature_checks(rows, "stream", ["event_ts", "event_key"], [*_ALL41, "score"], baseline).select(
        "stream", "n_processed", "feature", F.round("psi", 4).alias("psi"))


@query("drift_halves")
def drift_halves(spark, sf):
    """Feature and score indices, level and alarms between the two halves of the stream, all 41 features."""
    df = materialise(v3(spark, sf).select("event_ts", "score", *_ALL41))
    cut = F.expr(_CUT)
    return drift.check(df.where(F.col("event_ts") < cut), df.where(F.col("event_ts") >= cut), _ALL41, "score")


@query("baseline_profile", f"WITH {se('event_ts', 'score', 'value')}, t AS (SELECT score, value FROM se WHERE event_ts < {_CUT}) SELECT 'score' AS "
       f"feature, count(*) AS n, {r6('avg(score)')} AS mean, {r6('stddev_pop(score)')} AS std FROM t UNION ALL SELECT 'value', count(*), "
       f"{r6('avg(value)')}, {r6('stddev_pop(value)')} FROM t")
def baseline_profile(spark, sf):
    ev = _ev(spark, sf, "event_ts", "score", "value").where(F.col("event_ts") < F.expr(_CUT))
    return drift.baseline_profile(ev, ["score", "value"]).select("feature", "n", r("mean").alias("mean"), r("std").alias("std"))


_PH = ("x AS (SELECT *, row_number() OVER w AS n, avg(score) OVER w AS m FROM se WINDOW w AS (PARTITION BY {k} ORDER BY event_ts, event_key "
       "ROWS UNBOUNDED PRECEDING)), y AS (SELECT *, sum(score - m - 0.005) OVER (PARTITION BY {k} ORDER BY event_ts, event_key ROWS UNBOUNDED "
       "PRECEDING) AS s FROM x), z AS (SELECT *, s - min(s) OVER (PARTITION BY {k} ORDER BY event_ts, event_key ROWS UNBOUNDED PRECEDING) AS "
       "ph FROM y)")


@query("page_hinkley", f"WITH {se('event_key', 'event_ts', 'source_type', 'score')}, {_PH.format(k='source_type')} SELECT event_key, n, "
       f"CAST(CAST(m AS FLOAT) AS DOUBLE) AS mean, round(ph, 5) AS ph, ph > 50 AS alarm FROM z")
def page_hinkley(spark, sf):
    ev = _ev(spark, sf, "event_key", "event_ts", "source_type", "score")
    out = drift.page_hinkley(ev, "source_type", ["event_ts", "event_key"], "score", F.date_trunc("hour", F.col("event_ts").cast(
        "timestamp")))
    # single precision for the mean: decimal rounding ties at every n that is a power of two
    return out.select("event_key", b("n").alias("n"), F.col("mean").cast("float").cast("double").alias("mean"), r("ph", 5).alias(
        "ph"), "alarm")


@query("rolling_windows", f"WITH {se('event_key', 'event_ts', 'source_type', 'score')}, x AS (SELECT source_type, row_number() OVER w AS n, count(*) "
       "OVER w AS window_size, avg(score) OVER w AS m, stddev_pop(score) OVER w AS sd FROM se WINDOW w AS (PARTITION BY source_type ORDER BY "
       "event_ts, event_key ROWS 499 PRECEDING)) SELECT source_type, n AS n_processed, window_size, round(m, 6) AS mean_score, round(sd, 6) "
       "AS std_score FROM x WHERE n % 100 = 0")
def rolling_windows(spark, sf):
    ev = _ev(spark, sf, "event_key", "event_ts", "source_type", "score")
    out = drift.rolling_status(ev, "source_type", ["event_ts", "event_key"], "score")
    return out.select("source_type", b("n_processed").alias("n_processed"), "window_size", r("mean_score").alias("mean_score"), r(
        "std_score").alias("std_score"))


@query("recent_status", f"WITH {se('event_key', 'event_ts', 'source_type', 'score')}, x AS (SELECT * FROM se QUALIFY row_number() OVER (PARTITION BY "
       "source_type ORDER BY event_ts DESC, event_key DESC) <= 500) SELECT source_type, count(*) AS window_filled, round(avg(score), 6) AS "
       "recent_mean_score, round(stddev_pop(score), 6) AS recent_score_std FROM x GROUP BY 1")
def recent_status(spark, sf):
    ev = _ev(spark, sf, "event_key", "event_ts", "source_type", "score")
    return drift.recent_status(ev, "source_type", ["event_ts", "event_key"], "score").select(
        "source_type", "window_filled", r("recent_mean_score").alias("recent_mean_score"), r("recent_score_std").alias(
            "recent_score_std"))


# ---------------------------------------------------------------- data sets
@query("random_split")
def random_split(spark, sf):
    out = datasets.random_split(_ev(spark, sf, "event_key", "label"), "event_key")
    return out.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_split", f"WITH {_P}, c AS (SELECT source_type, label, count(*) AS n FROM p GROUP BY ALL) SELECT source_type, label, n AS total, "
       "CAST(round(n * 0.75) AS BIGINT) AS train FROM c")
def stratified_split(spark, sf):
    out = datasets.stratified_split(predicted(spark, sf), "event_key", ["source_type", "label"])
    return out.groupBy("source_type", "label").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("split") == "train").alias(
        "train"))


@query("stratified_folds", f"WITH {_P}, c AS (SELECT label, count(*) AS n FROM p GROUP BY 1), f AS (SELECT unnest(range(5)) AS fold) SELECT label, "
       "CAST(fold AS INT) AS fold, CAST(n // 5 + CASE WHEN fold BETWEEN 1 AND n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n FROM c, f")
def stratified_folds(spark, sf):
    return datasets.fold_column(predicted(spark, sf), "event_key", ["label"]).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("source_cap", f"WITH {_P} SELECT source_type, CASE WHEN source_type = 'sysmon' THEN CAST(floor(count(*) / 4.0) AS BIGINT) ELSE count(*) END AS "
       "n FROM p GROUP BY 1")
def source_cap(spark, sf):
    out = datasets.cap_source(predicted(spark, sf), "event_key", "source_type", "sysmon")
    return out.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_rebuild", f"WITH {_P}, t AS (SELECT count(CASE WHEN label = 0 AND source_type = 'sysmon' THEN 1 END) AS nb, count(CASE WHEN label = 1 "
       "AND source_type = 'windows_security' THEN 1 END) AS na, count(CASE WHEN label = 1 AND source_type IN ('sysmon', 'linux_auth') THEN 1 END) "
       "AS nu FROM p) SELECT 'train' AS split, 0 AS label, CAST(least(nb, 300) AS BIGINT) AS n FROM t UNION ALL SELECT 'val', 0, CAST(least(100, "
       "greatest(nb - 300, 0)) AS BIGINT) FROM t WHERE nb > 300 UNION ALL SELECT 'train', 1, CAST(na + nu - floor(nu * 0.3) AS BIGINT) FROM t UNION "
       "ALL SELECT 'val', 1, CAST(floor(nu * 0.3) AS BIGINT) FROM t WHERE floor(nu * 0.3) > 0")
def dataset_rebuild(spark, sf):
    """Sampled benign rows of one source, one attack source whole to train, a share of the others to val."""
    out = datasets.rebuild(predicted(spark, sf), "event_key", benign="sysmon", all_train="windows_security", synthetic="firewall",
                           n_train=300, n_val=100)
    return out.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("class_balancing", f"WITH {_P}, t AS (SELECT {_TIER} AS c FROM p), k AS (SELECT c AS class, count(*) AS n FROM t GROUP BY 1) SELECT class, n + "
       "CAST(greatest(least(floor(((SELECT max(n) FROM k) - n) / 2.0), n * 3), 0) AS BIGINT) AS n FROM k")
def class_balancing(spark, sf):
    s = F.col("score")
    ev = _ev(spark, sf).withColumn("class", F.when(s >= 0.8, "malicious_high").when(s >= 0.4, "suspicious_medium").otherwise("benign"))
    return datasets.balance_classes(ev, "event_key", "class").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("column_permutation", f"WITH {_P} SELECT count(*) AS n, {r6('sum(score)')} AS total, count(DISTINCT event_key) AS keys FROM p")
def column_permutation(spark, sf):
    out = datasets.permuted_column(predicted(spark, sf), "event_key", "score", seed=5)
    return out.agg(F.count(F.lit(1)).alias("n"), r(F.sum("score")).alias("total"), F.count_distinct("event_key").alias("keys"))


@query("minority_interpolation")
def minority_interpolation(spark, sf):
    """New rows per minority embedding class, one per row; vectors stay between their two parents."""
    emb = load(spark, sf, "embeddings").where(F.col("label") == 0)
    out = datasets.interpolate_minority(emb, "vec_id", "embedding")
    return out.select(F.col("vec_id"), "copy_no", F.size("embedding").alias("width"))


@query("robustness_scenarios")
def robustness_scenarios(spark, sf):
    """Accuracy of the 0.5 rule over noisy and erased scores."""
    ev = predicted(spark, sf).select("event_key", "score", "label")
    sc = datasets.scenarios(ev, ["score"], "event_key", erased=["score"])
    return evaluate.robustness(sc.withColumn("pred", (F.col("score") >= 0.5).cast("int")), "scenario", "label", "pred")


@query("outlier_flags", f"WITH {se('event_key', 'score', 'value')}, m AS (SELECT avg(score) AS a, stddev_pop(score) AS s, avg(value) AS b, "
       "stddev_pop(value) AS t FROM se), d AS (SELECT event_key, round(power((score - a) / s, 2) + power((value - b) / t, 2), 9) AS dist FROM se, "
       "m) SELECT event_key, dist >= (SELECT quantile_cont(dist, 0.7) FROM d) AS anomaly FROM d")
def outlier_flags(spark, sf):
    return datasets.outlier_flag(_ev(spark, sf, "event_key", "score", "value"), ["score", "value"]).select("event_key", "anomaly")


@query("audit_verdict", f"WITH {_P}, c AS (SELECT source_type, {_CM} FROM p GROUP BY 1), q AS (SELECT (SELECT avg(power(score - label, 2)) FROM p) AS br, "
       "(SELECT stddev_pop(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn)) FROM c) AS sd, (SELECT avg(CASE WHEN (source_type <> 'firewall') = "
       "(label = 1) THEN 1.0 ELSE 0.0 END) FROM p) AS na, (SELECT bool_or(tp + fn = 0 OR tn + fp = 0) FROM c) AS leak FROM c LIMIT 1) SELECT "
       "CAST(leak AS INT) + CAST(na > 0.95 AS INT) + CAST(sd > 0.1 AS INT) + CAST(br > 0.15 AS INT) AS n_issues FROM q")
def audit_verdict(spark, sf):
    p = predicted(spark, sf)
    j = lambda df: df.withColumn("_j", F.lit(1))
    leak = quality.source_contingency(p, "source_type", "label").agg(F.max(F.col("risk") != "Mixed").alias("leakage_detected"))
    naive = quality.naive_source_baseline(p, "source_type", "label", "firewall").select(F.col("accuracy").alias("naive_accuracy"))
    folds = evaluate.confusion(p, "label", "pred", ["source_type"]).agg(F.stddev_pop("accuracy").alias("fold_std"))
    row = j(leak).join(j(naive), "_j").join(j(folds), "_j").join(j(evaluate.brier(p, "label", "score")), "_j").drop("_j")
    return evaluate.audit_issues(row.withColumn("adversarial_rate", F.lit(0.5))).select("n_issues")


# ---------------------------------------------------------------- models
def learnable(spark, sf):
    """All 41 features with label, source, split and a validation mark inside the training split."""
    return materialise(with_split(v3(spark, sf)).select(
        "event_key", "label", "source_type", "split", (F.pmod(F.xxhash64("event_key"), F.lit(10)) == 0).alias("held"), *_ALL41))


@query("boosted_trees")
def boosted_trees(spark, sf):
    """Every ensemble at full size on all 41 features, stopped by its validation column, evaluated on the held-out split; beside a
    class-weighted one for comparison."""
    df = models.with_weights(learnable(spark, sf))
    train, val = df.where("split = 'train'"), df.where("split = 'val'")

    cases = [("enterprise", None), ("enterprise", "weight"), ("source_split", None), ("classic", None), ("histogram", None)]
    fitted = models.fit_all([models.boosted_trees(_ALL41, name, weight=w, validation="held") for name, w in cases], [train] * len(cases), 5)
    return reduce(DataFrame.unionByName, [evaluate.confusion(models.score(model, val), "label", "pred").withColumns({
        "model": F.lit(name), "weighted": F.lit(w is not None), "trees": F.lit(model.stages[-1].getNumTrees)})
        for (name, w), model in zip(cases, fitted)])


@query("source_transfer")
def source_transfer(spark, sf):
    """Each source left out in turn: trained on the others with all 41 features, evaluated on it. All fits are one job list."""
    df = learnable(spark, sf)
    sources = sorted(r.source_type for r in df.select("source_type").distinct().collect())
    return models.fold_metrics(models.boosted_trees(_ALL41, "audit", validation="held"), df, "source_type", sources)


@query("embedding_classes")
def embedding_classes(spark, sf):
    """Feed-forward classes of the embedding table: three layers, evaluated on the fifth of the rows held out."""
    emb = load(spark, sf, "embeddings").withColumn("held", F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0)
    _, out = models.embedding_classifier(emb.where("NOT held"), held_out=emb.where("held"))
    return evaluate.class_report(out.withColumn("pred", F.col("prediction").cast("int")), "label", "pred")


def heuristic_scorer(rows):
    """The 18-feature heuristic as a scorer of feature columns: p and pred."""
    p, label, _, _ = scoring.heuristic18({n: F.col(n) for n in features.V1_NAMES})
    return rows.withColumns({"p": p, "pred": (label == "malicious").cast("int")})


def _heuristic_sql(g):
    return (f"least(1.0, 0.2 * least({g('has_ps_bypass_flags')}, 4) + 0.15 * {g('has_base64_encoding')} + CASE WHEN {g('cmdline_length_norm')} > 0 THEN 0.2 ELSE 0 "
            f"END + 0.15 * {g('has_network_indicators')} + 0.15 * {g('has_persistence_indicators')} + 0.1 * {g('has_defense_evasion')} + CASE WHEN "
            f"{g('script_length_norm')} > 0 THEN 0.15 ELSE 0 END)")


_STEP = "CASE " + " ".join(f"WHEN n % {s} <> 0 THEN {s}" for s in models.STEPS) + " END"
IMPORTANCE_SQL = (
    f"WITH f18 AS ({_wide(_V1, _V1TEXT)}), {se('event_key', 'label')}, rk AS (SELECT f18.*, label, row_number() OVER (ORDER BY substring(md5(CAST(event_key AS "
    "VARCHAR)), 1, 13), event_key) - 1 AS i, count(*) OVER () AS n FROM f18 JOIN se USING (event_key)), "
    f"tk AS (SELECT *, r, (i * {_STEP} + r * 7919 + 1) % n AS donor FROM rk, range(3) t(r)), "
    f"sh(f) AS (VALUES (''), {', '.join(f'({lit(n)})' for n in features.V1_NAMES)}), "
    f"pd AS (SELECT sh.f, o.r, CASE WHEN CAST({_heuristic_sql(lambda n: f"CASE WHEN f = {lit(n)} THEN d.{n} ELSE o.{n} END")} AS DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS pred, o.label FROM tk o JOIN rk d ON d.i = o.donor, sh), "
    "ac AS (SELECT f, r, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS a FROM pd GROUP BY 1, 2), bb AS (SELECT a AS b FROM ac WHERE f = '' AND r = 0) "
    f"SELECT f AS feature, {r6('avg(b - a)')} AS mean_drop, {r6('stddev_pop(b - a)')} AS std_drop FROM ac, bb WHERE f <> '' GROUP BY 1")


def heuristic_importance(spark, sf):
    rows = features.v1_18(_ev(spark, sf)).select("event_key", "label", *features.V1_NAMES)
    return models.importance(heuristic_scorer, rows, features.V1_NAMES, "event_key")


@query("permutation_importance", IMPORTANCE_SQL)
def permutation_importance(spark, sf):
    """Accuracy the heuristic loses by shuffling each feature, three repeats, from one rank table."""
    return heuristic_importance(spark, sf).select("feature", r("mean_drop").alias("mean_drop"), r("std_drop").alias("std_drop"))


@query("top_features", f"SELECT feature, mean_drop FROM ({IMPORTANCE_SQL}) ORDER BY mean_drop DESC, feature LIMIT 15")
def top_features(spark, sf):
    """The 15 features whose shuffling costs most."""
    ranked = heuristic_importance(spark, sf).withColumn("mean_drop", r("mean_drop"))
    return models.top_features(ranked).select("feature", "mean_drop")


@query("local_explanations")
def local_explanations(spark, sf):
    """The three strongest local coefficients of the heuristic for every event it calls malicious; tests compare with numpy."""
    rows = materialise(heuristic_scorer(features.v1_18(_ev(spark, sf))).where("pred = 1").select("event_key", *features.V1_NAMES))
    return models.local_explanation(heuristic_scorer, rows, features.V1_NAMES, "event_key", top=3)




