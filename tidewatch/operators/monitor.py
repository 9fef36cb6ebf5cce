"""The drift monitor over a stream of feature vectors: a stored baseline, and a check every 100 events over the last 500.

The baseline is a histogram per feature, written as a version and read back. A check needs only the window's counts per bin, and
those of a block of 100 events merge: events are counted once per block, and a check adds up the blocks of its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import sinks
from tidewatch.functions.text import joined, listed
from tidewatch.operators.drift import (
    CHECK_EVERY, CRITICAL, MIN_EVENTS, SAMPLES, WARNING, WINDOW, baseline_samples, numbered_stream, page_hinkley, unpivot)
from tidewatch.operators.ordered import exact_quantiles

EPS = 1e-10
SCORE = "score"


def bin_of(edges: Column, value: Column) -> Column:
    """1-based bin of a value, the last one closed; 0 outside the edges or where there is no bin."""
    inside = (F.size(edges) > 1) & (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    return F.when(inside, F.least(F.size(F.filter(edges, lambda x: x <= value)), F.size(edges) - 1)).otherwise(0)


def baseline_histogram(df: DataFrame, key: str, features: list[str], samples: int = SAMPLES, bins: int = 10) -> DataFrame:
    """(feature, edges, counts, n) of at most `samples` rows picked by key: deciles as edges, equal ones once."""
    long = unpivot(baseline_samples(df, key, samples), features)
    edges = exact_quantiles(long, ["feature"], "value", [i / bins for i in range(bins + 1)]).select(
        "feature", F.array_distinct("q").alias("edges"))
    placed = long.join(F.broadcast(edges), "feature")  # one row per feature
    counted = placed.groupBy("feature", "edges", bin_of(F.col("edges"), F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    held = counted.groupBy("feature", "edges").agg(F.map_from_entries(F.collect_list(F.struct("bin", "m"))).alias("held"),
                                                   F.sum("m").alias("n"))
    counts = F.when(F.size("edges") > 1, F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.coalesce(
        F.element_at("held", i), F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>"))
    return held.select("feature", "edges", counts.alias("counts"), "n")


def store_baseline(df: DataFrame, key: str, features: list[str], base: str) -> str:
    """Write the baseline as the newest version of the table at `base`."""
    return sinks.replace_table(baseline_histogram(df, key, features), base)


def stored_baseline(spark: SparkSession, base: str) -> DataFrame:
    return sinks.current_table(spark, base)


def feature_checks(rows: DataFrame, key: str, order: list[str], features: list[str], baseline: DataFrame, window: int = WINDOW,
                   every: int = CHECK_EVERY) -> DataFrame:
    """(key, n_processed, window_size, feature, psi) at every `every`-th event of a key, over its last `window` events.

    `order` begins with a timestamp and tells rows of a key apart. A key of any size is numbered and counted in pieces.
    """
    numbered = numbered_stream(rows.select(key, *order, *features), key, order)
    blocks = numbered.withColumns({"block": F.ceil(F.col("n") / every), "last": F.floor(F.col("total") / every)}).where("block <= last")
    long = unpivot(blocks, features, [key, "block", "last"]).join(F.broadcast(baseline.select("feature", "edges")), "feature")
    counted = long.groupBy(key, "block", "last", "feature", bin_of(F.col("edges"), F.col("value")).alias("bin")).agg(
        F.count(F.lit(1)).alias("m"))
    fed = counted.withColumn("check_no", F.explode(F.sequence("block", F.least(F.col("block") + (window // every - 1), F.col("last")))))
    merged = fed.groupBy(key, "check_no", "feature", "bin").agg(F.sum("m").alias("m"))
    held = merged.groupBy(key, "check_no", "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "m"))).alias("actual"),
                                                          F.sum("m").alias("size"))
    share = lambda m, n: F.greatest(m / (n + EPS), F.lit(EPS))
    pairs = F.transform("counts", lambda e, i: F.struct(share(e, F.col("n")).alias("e"), share(F.coalesce(
        F.element_at("actual", i + 1), F.lit(0)), F.col("size")).alias("a")))
    psi = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + (x["a"] - x["e"]) * F.log(x["a"] / x["e"]))
    return held.join(F.broadcast(baseline), "feature").select(
        key, (F.col("check_no") * every).alias("n_processed"), F.col("size").alias("window_size"), "feature", psi.alias("psi"))


def check_rows(rows: DataFrame, key: str, order: list[str], features: list[str], baseline: DataFrame, score: str = SCORE,
               window: int = WINDOW, every: int = CHECK_EVERY) -> DataFrame:
    """One row per check: indices of all features and of the score, level, alarms, and whether an alarm stands.

    The alarm stands from the first alarm of the sequential test on, and after any check with a critical index.
    """
    named = [*features, score]
    per = feature_checks(rows, key, order, named, baseline, window, every)
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    own = F.col("feature") == score
    checks = per.groupBy(key, "n_processed", "window_size").agg(
        F.array_sort(F.collect_list(F.when(~own, F.struct(place.alias("place"), "feature", "psi")))).alias("f"),
        F.max(F.when(own, F.col("psi"))).alias("psi_scores"))
    high = F.filter("f", lambda x: x["psi"] > CRITICAL)
    checks = checks.where(F.col("window_size") >= MIN_EVENTS).withColumns({
        "max_psi": F.coalesce(F.array_max(F.transform(F.filter("f", lambda x: x["psi"] > WARNING), lambda x: x["psi"])), F.lit(0.0)),
        "n_critical": F.size(high), "_first": F.transform(F.slice(high, 1, 5), lambda x: F.format_string(
            "%s(PSI=%.3f)", x["feature"], x["psi"]))})
    critical = (F.col("n_critical") > 0) | (F.col("psi_scores") > CRITICAL)
    alarmed = page_hinkley(rows.select(key, *order, score), key, order, score, F.date_trunc("hour", F.col(order[0]).cast("timestamp")))
    since = alarmed.where("alarm").groupBy(key).agg(F.min("n").alias("alarm_at"))
    latched = checks.where(critical).groupBy(key).agg(F.min("n_processed").alias("critical_at"))
    out = checks.join(since, key, "left").join(latched, key, "left")
    tested = F.coalesce(F.col("alarm_at") <= F.col("n_processed"), F.lit(False))
    return _levels(out.withColumns({
        "sequential": tested, "ph_drift": tested | F.coalesce(F.col("critical_at") < F.col("n_processed"), F.lit(False))}), key)


def _levels(df: DataFrame, key: str) -> DataFrame:
    c, lit = F.col, F.lit
    level = F.when((c("n_critical") > 0) | (c("psi_scores") > CRITICAL), "CRITICAL").when(
        (c("max_psi") > WARNING) | (c("psi_scores") > WARNING) | c("sequential"), "WARNING").otherwise("none")
    alarms = listed(
        (c("n_critical") > 0, F.concat(lit("CRITICAL feature drift: "), joined(c("_first")))),
        ((c("n_critical") == 0) & (c("max_psi") > WARNING), F.format_string("Moderate feature drift detected (max PSI=%.3f)", c("max_psi"))),
        (c("psi_scores") > CRITICAL, F.format_string("CRITICAL score distribution shift (PSI=%.3f)", c("psi_scores"))),
        ((c("psi_scores") <= CRITICAL) & (c("psi_scores") > WARNING), F.format_string("Score distribution drifting (PSI=%.3f)",
                                                                                     c("psi_scores"))),
        (c("sequential"), F.concat(lit("Page-Hinkley alarm at n="), c("n_processed").cast("string"), lit(" (score stream mean shifted)"))))
    return df.select(
        key, "n_processed", "window_size", "ph_drift", F.map_from_entries(F.transform("f", lambda x: F.struct(
            x["feature"], F.round(x["psi"], 4)))).alias("psi_features"), F.round("psi_scores", 4).alias("psi_scores"),
        F.round("max_psi", 4).alias("max_psi"), "n_critical", level.alias("drift_level"), alarms.alias("alarms"))
