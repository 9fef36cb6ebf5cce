"""Drift: stability index, sequential test, rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import joined, listed
from tidewatch.operators.ordered import exact_quantiles, sole_key

# Thresholds of the drift monitor.
WARNING, CRITICAL = 0.10, 0.25
DELTA, LAMBDA = 0.005, 50.0
WINDOW, CHECK_EVERY, MIN_EVENTS, SAMPLES = 500, 100, 50, 2000


def unpivot(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Wide features to (keep, feature, value)."""
    return df.select(*(keep or []), F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("r")).select(
        *(keep or []), "r.*")


def psi(baseline: DataFrame, current: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """(keys, psi): bins from the baseline's exact quantiles, duplicates collapsed, last bin closed, values outside
    the bins dropped from the counts but kept in the denominator."""
    edges = exact_quantiles(baseline, keys, value, [i / bins for i in range(bins + 1)]).select(
        *keys, F.array_distinct("q").alias("edges"))
    both = baseline.select(*keys, F.col(value).cast("double").alias("v"), F.lit(0).alias("side")).unionByName(
        current.select(*keys, F.col(value).cast("double").alias("v"), F.lit(1).alias("side")))
    # distinct values first: the edge lookup and the shuffle see each value once per side
    counts = both.groupBy(*keys, "v").agg(F.count_if(F.col("side") == 0).alias("e"), F.count_if(F.col("side") == 1)
                                          .alias("a"))
    one = keys or ["_one"]
    if not keys:
        counts, edges = counts.withColumn("_one", sole_key("v")), F.broadcast(edges.withColumn("_one", sole_key("edges")))
    placed = counts.join(edges, one)
    at = F.size(F.filter("edges", lambda x: x <= F.col("v")))
    last = F.size("edges") - 1
    slot = F.when((F.col("v") < F.element_at("edges", 1)) | (F.col("v") > F.element_at("edges", -1)), -1).otherwise(
        F.least(at, last))
    per_bin = placed.withColumns({"bin": slot, "nb": last}).groupBy(*one, "nb", "bin").agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"))
    totals = per_bin.groupBy(*one, "nb").agg(
        F.sum("e").alias("ne"), F.sum("a").alias("na"),
        F.collect_list(F.when(F.col("bin") > 0, F.struct("bin", "e", "a"))).alias("filled"))
    eps = 1e-10
    share = lambda n, total: F.greatest(n / (total + eps), F.lit(eps))
    # bins never hit by either side contribute nothing, as both shares clip to the same floor
    terms = F.transform("filled", lambda b: (share(b["a"], F.col("na")) - share(b["e"], F.col("ne"))) * F.log(
        share(b["a"], F.col("na")) / share(b["e"], F.col("ne"))))
    out = totals.select(*one, F.when(F.col("nb") < 1, 0.0).otherwise(F.aggregate(
        terms, F.lit(0.0), lambda acc, x: acc + x)).alias("psi"))
    return out if keys else out.drop("_one")


def baseline_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, mean, std): one pass, population std."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[a for f in features for a in (
        F.avg(f).alias(f"{f}__m"), F.stddev_pop(f).alias(f"{f}__s"))])
    return row.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}__m").alias("mean"),
                                                        F.col(f"{f}__s").alias("std")) for f in features])).alias("r")
                      ).select("r.feature", "n", "r.mean", "r.std")


def baseline_samples(df: DataFrame, key: str, n: int = SAMPLES, seed: int = 0) -> DataFrame:
    """At most n rows, picked by a digest of the key: repeatable in any engine, and each task keeps n rows at most."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def check(baseline: DataFrame, current: DataFrame, features: list[str], score: str, ph_drift: bool = False) -> DataFrame:
    """One row: feature indices (map), score index, level and alarms, critical features first five."""
    named = features + [score]
    index = psi(unpivot(baseline, named), unpivot(current, named), ["feature"], "value")
    is_score = F.col("feature") == score
    order = F.array_position(F.array(*[F.lit(f) for f in named]), F.col("feature"))
    row = index.agg(
        F.sort_array(F.collect_list(F.when(~is_score, F.struct(order.alias("o"), "feature", "psi")))).alias("f"),
        F.max(F.when(is_score, F.col("psi"))).alias("psi_scores"))
    critical = F.filter("f", lambda x: x["psi"] > CRITICAL)
    max_psi = F.coalesce(F.array_max(F.transform(F.filter("f", lambda x: x["psi"] > WARNING), lambda x: x["psi"])),
                         F.lit(0.0))
    out = row.withColumns({"max_psi": max_psi, "_crit": F.transform(F.slice(critical, 1, 5), lambda x: F.concat(
        x["feature"], F.format_string("(PSI=%.3f)", x["psi"])))})
    n = current.agg(F.count(F.lit(1)).alias("window_size")).withColumn("_j", F.lit(1))
    out = out.withColumn("_j", F.lit(1)).join(n, "_j").drop("_j")
    feature_level = F.when(F.col("max_psi") > CRITICAL, 2).when(F.col("max_psi") > WARNING, 1).otherwise(0)
    score_level = F.when(F.col("psi_scores") > CRITICAL, 2).when(F.col("psi_scores") > WARNING, 1).otherwise(0)
    level = F.greatest(feature_level, score_level, F.lit(1 if ph_drift else 0))
    enough = F.col("window_size") >= MIN_EVENTS
    alarms = listed(
        (feature_level == 2, F.concat(F.lit("CRITICAL feature drift: "), joined(F.col("_crit")))),
        (feature_level == 1, F.format_string("Moderate feature drift detected (max PSI=%.3f)", F.col("max_psi"))),
        (score_level == 2, F.format_string("CRITICAL score distribution shift (PSI=%.3f)", F.col("psi_scores"))),
        (score_level == 1, F.format_string("Score distribution drifting (PSI=%.3f)", F.col("psi_scores"))),
        (F.lit(ph_drift), "Page-Hinkley alarm (score stream mean shifted)"))
    return out.select(
        "window_size", F.map_from_entries(F.transform("f", lambda x: F.struct(x["feature"], F.round(x["psi"], 4)))).alias(
            "psi_features"), F.round("psi_scores", 4).alias("psi_scores"), F.round("max_psi", 4).alias("max_psi"),
        F.when(enough, F.element_at(F.array(F.lit("none"), F.lit("WARNING"), F.lit("CRITICAL")), level + 1)).otherwise(
            "none").alias("drift_level"),
        F.when(enough, alarms).otherwise(F.array().cast("array<string>")).alias("alarms"))


def page_hinkley(df: DataFrame, key: str, order: list[str], value: str, chunk: Column, delta: float = DELTA,
                 lam: float = LAMBDA) -> DataFrame:
    """Rows with n, running mean, ph statistic and alarm per key.

    Three running quantities (mean, cumulative deviation, its minimum), each as chunk-local window plus chunk offset,
    so a single global stream is spread over its chunks. `chunk` must not decrease with the order.
    """
    x = F.col(value).cast("double")
    rows = df.withColumns({"_c": chunk, "_x": x})
    local = Window.partitionBy(key, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    sums = rows.groupBy(key, "_c").agg(F.count(F.lit(1)).alias("_n"), F.sum("_x").alias("_s"))
    start = sums.select(key, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                        F.coalesce(F.sum("_s").over(before), zero).alias("_s0"))
    rows = (rows.withColumns({"_ln": F.row_number().over(Window.partitionBy(key, "_c").orderBy(*order)),
                              "_ls": F.sum("_x").over(local)}).join(start, [key, "_c"]))
    rows = rows.withColumns({"n": F.col("_n0") + F.col("_ln"),
                             "mean": (F.col("_s0") + F.col("_ls")) / (F.col("_n0") + F.col("_ln"))})
    rows = rows.withColumn("_d", F.col("_x") - F.col("mean") - delta)
    rows = rows.withColumn("_ld", F.sum("_d").over(local))
    dev = rows.groupBy(key, "_c").agg(F.sum("_d").alias("_dt"), F.min("_ld").alias("_dm"))
    dev = dev.withColumn("_d0", F.coalesce(F.sum("_dt").over(before), zero))
    dev = dev.withColumn("_m0", F.min(F.col("_d0") + F.col("_dm")).over(before)).select(key, "_c", "_d0", "_m0")
    rows = rows.join(dev, [key, "_c"]).withColumn("_s", F.col("_d0") + F.col("_ld"))
    low = F.least(F.col("_m0"), F.col("_d0") + F.min("_ld").over(local))
    out = rows.withColumn("ph", F.col("_s") - low)
    return out.withColumn("alarm", F.col("ph") > lam).drop(*[c for c in out.columns if c.startswith("_")])


def rolling_status(df: DataFrame, key: str, order: list[str], value: str, window: int = WINDOW,
                   every: int = CHECK_EVERY) -> DataFrame:
    """Mean and population std of the last `window` values at every `every`-th event with enough history.

    Events are numbered per key chunk by chunk (time buckets); only the rows inside a check's window are then grouped.
    Each row feeds at most window/every checks.
    """
    numbered = numbered_stream(df.select(key, *order, F.col(value).cast("double").alias("_x")), key, order)
    n = F.col("n")
    first = F.ceil(n / every)
    checks = F.sequence(first, first + int(window / every) - 1)
    fed = numbered.select(key, "_x", "n", F.explode(checks).alias("check_no"), "total").where(
        (F.col("check_no") * every <= F.col("total")) & (n > F.col("check_no") * every - window))
    return fed.groupBy(key, "check_no").agg(
        F.count(F.lit(1)).alias("window_size"), F.avg("_x").alias("mean_score"), F.stddev_pop("_x").alias("std_score")
    ).where(F.col("window_size") >= MIN_EVENTS).withColumn("n_processed", F.col("check_no") * every)


def numbered_stream(df: DataFrame, key: str, order: list[str], bucket: str = "hour") -> DataFrame:
    """Event number n in time order and stream total, per key, without one task per key. First order column is a
    timestamp."""
    rows = df.withColumn("_c", F.date_trunc(bucket, F.col(order[0]).cast("timestamp")))
    local = Window.partitionBy(key, "_c").orderBy(*order)
    sizes = rows.groupBy(key, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                           F.sum("_n").over(Window.partitionBy(key)).alias("total"))
    out = rows.withColumn("_l", F.row_number().over(local)).join(offsets, [key, "_c"])
    return out.withColumn("n", F.col("_n0") + F.col("_l")).drop("_c", "_l", "_n0")


def recent_status(df: DataFrame, key: str, order: list[str], value: str, window: int = WINDOW) -> DataFrame:
    """Mean and std of the latest `window` values per key; tasks keep `window` rows per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    last = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= window)
    return last.groupBy(key).agg(F.count(F.lit(1)).alias("window_filled"), F.avg(value).alias("recent_mean_score"),
                                 F.stddev_pop(value).alias("recent_score_std"))


