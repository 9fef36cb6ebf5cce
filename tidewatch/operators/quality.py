"""Dataset quality: balance, completeness, consistency, leakage, readiness; operational counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import filled, listed, nz
from tidewatch.rules import labels as L


def class_balance(df: DataFrame, label: str, classes: list[str] | None = None) -> DataFrame:
    """Count and percent per class; classes without rows show zero."""
    classes = classes or L.CLASSES
    row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(label) == c).alias(f"c{i}")
                                                     for i, c in enumerate(classes)])
    out = row.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"c{i}").alias("n"))
                                                  for i, c in enumerate(classes)])).alias("r")).select("total", "r.*")
    return out.select("class", "n", F.coalesce(F.col("n") * 100.0 / F.nullif(F.col("total"), F.lit(0)), F.lit(
        0.0)).alias("percent"))


COMPLETENESS = ["command_line", "process_name", "user", "hostname", "timestamp", "event_id"]
USEFUL = ["command_line", "process_name", "destination_ip", "source_ip"]


def completeness(df: DataFrame) -> DataFrame:
    """One row: how many events carry each field, and how many carry nothing useful."""
    some = lambda c: ~nz(c).isin("", "0") if c == "event_id" else filled(c)
    empty = ~(some(USEFUL[0]) | some(USEFUL[1]) | some(USEFUL[2]) | some(USEFUL[3]))
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(some(c)).alias(f"with_{c}") for c in COMPLETENESS],
                  F.count_if(empty).alias("empty_events"))


def label_consistency(events: DataFrame, labels: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Event and label counts, mismatch flag, number of labels outside the vocabulary."""
    e = events.agg(F.count(F.lit(1)).alias("n_events")).withColumn("_j", F.lit(1))
    lab = labels.agg(F.count(F.lit(1)).alias("n_labels"), F.count_if(~F.col(label).isin(classes)).alias(
        "invalid_labels")).withColumn("_j", F.lit(1))
    return e.join(lab, "_j").drop("_j").withColumn("size_mismatch", F.col("n_events") != F.col("n_labels"))


def source_contingency(df: DataFrame, source: str, label: str) -> DataFrame:
    """Class counts per source, share of malicious, and the risk band of a source that predicts its class."""
    out = df.groupBy(F.col(source).alias("source")).agg(F.count_if(F.col(label) == 0).alias("benign"),
                                                        F.count_if(F.col(label) == 1).alias("malicious"))
    pct = F.col("malicious") * 100.0 / (F.col("benign") + F.col("malicious"))
    return out.withColumn("malicious_pct", pct).withColumn("risk", F.when(
        F.col("malicious_pct").isin(0.0, 100.0), "PERFECT SEPARATION").when(
        (F.col("malicious_pct") > 95) | (F.col("malicious_pct") < 5), "NEAR-PERFECT").otherwise("Mixed"))


def naive_source_baseline(df: DataFrame, source: str, label: str, benign_source: str) -> DataFrame:
    """Metrics of guessing the class from the source alone."""
    from tidewatch.operators.evaluate import confusion

    guess = F.when(F.col(source) == benign_source, 0).otherwise(1)
    return confusion(df.withColumn("_g", guess), label, "_g")


def attribute_class_mix(df: DataFrame, attribute: str, label: str) -> DataFrame:
    """Class counts per attribute value, and whether the value is seen in both classes."""
    out = df.groupBy(attribute).agg(F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias(
        "malicious"))
    return out.withColumn("shared", (F.col("benign") > 0) & (F.col("malicious") > 0))


def key_leakage(df: DataFrame, split: str, key: Column, empty: str = "|") -> DataFrame:
    """Keys present in both splits; the empty key does not count."""
    flags = df.select(key.alias("k"), split).groupBy("k").agg(F.max(F.col(split) == "train").alias("t"),
                                                               F.max(F.col(split) == "val").alias("v"))
    return flags.agg(F.count_if(F.col("t") & F.col("v") & (F.col("k") != empty)).alias("leaked_keys"))


def event_key() -> Column:
    return F.concat(nz("command_line"), F.lit("|"), nz("process_name"))


def readiness(train: DataFrame, df: DataFrame, label: str, split: str, classes: list[str]) -> DataFrame:
    """One-row verdict with the list of issues over the training rows and the split."""
    balance = class_balance(train, label, classes).agg(
        F.max("percent").alias("hi"), F.min(F.when(F.col("n") > 0, F.col("percent"))).alias("lo"))
    parts = [balance, completeness(train), key_leakage(df, split, event_key()),
             df.agg(F.count_if(F.col(split) == "val").alias("n_val"))]
    out = parts[0].withColumn("_j", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_j", F.lit(1)), "_j")
    c = F.col
    issues = listed(
        (c("hi") / c("lo") > 10, "class imbalance"), (c("total") < 1000, "too few events"),
        (c("with_command_line") / c("total") < 0.5, "few events with command_line"),
        (c("empty_events") / c("total") > 0.1, "many empty events"),
        (c("leaked_keys") > c("n_val") * 0.05, "split leakage"))
    ready = F.size(F.filter("issues", lambda i: ~i.isin("class imbalance", "too few events"))) == 0
    return out.withColumn("issues", issues).withColumn("ready", ready).drop("_j")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights that sum to one over the classes."""
    from pyspark.sql import Window

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    inv = 1.0 / F.col("n")
    return counts.withColumn("weight", inv / F.sum(inv).over(Window.partitionBy(F.lit(1))))


def dataset_statistics(df: DataFrame, split: str, source: str, label: str) -> DataFrame:
    """Per split: size, class map and source map from one pre-aggregated count."""
    counts = df.groupBy(split, source, label).agg(F.count(F.lit(1)).alias("n"))
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(c).cast("string"), "n"))))
    per = lambda c, name: counts.groupBy(split, c).agg(F.sum("n").alias("n")).groupBy(split).agg(as_map(c).alias(name))
    total = counts.groupBy(split).agg(F.sum("n").alias("size"))
    return total.join(per(label, "classes"), split).join(per(source, "sources"), split)


# ---------------------------------------------------------------- operations
def processing_metrics(routed: DataFrame) -> DataFrame:
    """Totals per outcome and the two rates, in percent, zero-safe."""
    bad = F.col("classification") == "malicious"
    out = routed.agg(F.count(F.lit(1)).alias("total_processed"), F.count_if(~bad).alias("benign_filtered"),
                     F.count_if(bad).alias("malicious_detected"),
                     F.count_if(bad & (F.col("path") == "fast")).alias("fast_path_count"),
                     F.count_if(bad & (F.col("path") == "deep")).alias("deep_path_count"))
    safe = lambda a, b: F.coalesce(F.col(a) * 100.0 / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return out.withColumns({"filter_rate": safe("benign_filtered", "total_processed"),
                            "deep_path_rate": safe("deep_path_count", "malicious_detected")})


def operations_summary(metrics: DataFrame) -> DataFrame:
    """Detection rate and health band."""
    rate = F.coalesce(F.col("malicious_detected") * 100.0 / F.nullif(F.col("total_processed"), F.lit(0)), F.lit(0.0))
    return metrics.withColumn("detection_rate", rate).withColumn("health", F.when(rate < 5, "Excellent").when(
        rate < 20, "Good").when(rate < 50, "Warning").otherwise("Critical"))


def exposition(metrics: DataFrame, prefix: str = "events") -> DataFrame:
    """(name, value) long form of the counters."""
    names = ["total_processed", "benign_filtered", "malicious_detected", "fast_path_count", "deep_path_count"]
    return metrics.select(F.explode(F.array(*[F.struct(
        F.lit(f"{prefix}_{n}_total").alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")
    ).select("r.*")


def manager_stats(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count(F.lit(1)).alias("total_incidents"), F.sum("event_count").alias(
        "total_events_correlated"), F.approx_count_distinct("host").alias("approx_hosts"),
        F.count_distinct("host").alias("active_incidents"))


def high_connections(df: DataFrame, remote: str, floor: int = 20) -> DataFrame:
    return (df.where(filled(remote) & ~F.col(remote).isin("127.0.0.1", "::1")).groupBy(F.col(remote).alias("remote_ip"))
            .agg(F.count(F.lit(1)).alias("connection_count")).where(F.col("connection_count") > floor))


def channel_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("channel", "event_id").agg(F.count(F.lit(1)).alias("n"))
