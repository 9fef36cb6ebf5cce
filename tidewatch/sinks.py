"""Table writes: append, upsert, link, status, indicators, log shipping, data set files, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import joined, nz


def append_events(scored: DataFrame, path: str, ts: str = "event_ts") -> None:
    """Append, partitioned by day. Rows of a day go to one directory without a shuffle; the writer sorts locally."""
    scored.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)


def newest(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """The newest row of each key, whole: the largest by the named columns (updated_at where there is one), then by all others."""
    first = by if by is not None else [c for c in ("updated_at",) if c in df.columns]
    rest = [f.name for f in df.schema if f.name not in {key, *first} and not f.dataType.typeName() in ("map", "variant")]
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*first, *rest)).alias("_r")).select("_r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Field-wise update: present (non-null) new values win, absent ones keep the old; unseen keys are added.

    One full join on the key. Of a key that occurs more than once on a side the newest row counts, whole, so a repeated write
    neither multiplies rows nor makes one that never was, and its order does not matter.
    """
    cols = list(dict.fromkeys(old.columns + new.columns))
    both = newest(old, key).alias("o").join(newest(new, key).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def pick(c: str) -> Column:
        parts = [F.col(f"n.{c}")] if c in new.columns else []
        parts += [F.col(f"o.{c}")] if c in old.columns else []
        return F.coalesce(*parts).alias(c)

    return both.select(*[pick(c) for c in cols])


def replace_table(df: DataFrame, base: str, through: int = -1) -> str:
    """Write a new version directory, then add a pointer to it. No pointer is ever changed or removed, so a reader sees the
    old table or the new one, whole, at any moment. `through`: the last stream batch that the version holds."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(f"{base}/{version}")
    pointer = spark.createDataFrame([(version, through)], "version string, through long").withColumn(
        "at", F.unix_micros(F.current_timestamp()))
    pointer.coalesce(1).write.mode("append").json(f"{base}/current")
    return f"{base}/{version}"


def current_table(spark: SparkSession, base: str) -> DataFrame:
    """The version of the newest pointer; an append in progress is not visible before its commit."""
    pointers = spark.read.schema("version string, at long").json(f"{base}/current")
    return spark.read.parquet(f"{base}/{pointers.agg(F.max_by('version', F.struct('at', 'version'))).first()[0]}")


class KeyedTable:
    """A table that a stream updates by key: one delta folder per batch, and versions that hold all deltas up to a batch.

    A batch writes only its own rows. Its folder is overwritten when it runs again, and a batch that a version already holds is
    left out, so a replay changes nothing. A read takes the newest row of a key, whole; `compact` folds the deltas into a version.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str, key: str, order: list[str]):
        self.spark, self.base, self.schema, self.key, self.order = spark, base, schema, key, order

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _version(self) -> tuple[str | None, int]:
        """The newest version and the last batch it holds: the ledger of applied batches."""
        if not self._exists(f"{self.base}/current"):
            return None, -1
        row = self.spark.read.schema("version string, through long, at long").json(f"{self.base}/current").agg(
            F.max_by(F.struct("version", "through"), F.struct("through", "at", "version")).alias("r")).first().r
        return f"{self.base}/{row.version}", row.through

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        if batch_id > self._version()[1]:
            newest(rows, self.key, self.order).write.mode("overwrite").parquet(f"{self.base}/deltas/batch_id={batch_id}")

    def _deltas(self, through: int) -> DataFrame | None:
        if not self._exists(f"{self.base}/deltas"):
            return None
        rows = self.spark.read.option("basePath", f"{self.base}/deltas").schema(self.schema + ", batch_id long").parquet(f"{self.base}/deltas")
        return rows.where(F.col("batch_id") > through)

    def read(self) -> DataFrame:
        """The newest row of every key."""
        version, through = self._version()
        parts = [d.drop("batch_id") for d in [self._deltas(through)] if d is not None]
        if version:
            parts.append(self.spark.read.schema(self.schema).parquet(version))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return newest(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), self.key, self.order)

    def compact(self) -> None:
        """Fold all deltas into a new version; the old folders stay for running readers and may be removed later."""
        deltas = self._deltas(self._version()[1])
        last = deltas.agg(F.max("batch_id")).first()[0] if deltas is not None else None
        if last is not None:
            replace_table(self.read(), self.base, last)


def link_to_incident(events: DataFrame, links: DataFrame, key: str = "event_key") -> DataFrame:
    """Set incident_id from (key, incident_id) link rows; other events keep theirs."""
    side = links.select(key, F.col("incident_id").alias("_new"))
    out = events.join(side, key, "left")
    old = F.col("incident_id") if "incident_id" in events.columns else F.lit(None).cast("string")
    return out.withColumn("incident_id", F.coalesce("_new", old)).drop("_new")


def update_status(incidents: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Apply (incident_id, status) changes and touch updated_at on the changed rows."""
    side = changes.select("incident_id", F.col("status").alias("_status"))
    out = incidents.join(side, "incident_id", "left")
    hit = F.col("_status").isNotNull()
    return out.withColumns({
        "status": F.coalesce("_status", "status"),
        "updated_at": F.when(hit, now if now is not None else F.current_timestamp()).otherwise(F.col("updated_at"))
    }).drop("_status")


def append_iocs(iocs: DataFrame, path: str) -> None:
    iocs.write.mode("append").partitionBy("type").parquet(path)


def ship_rows(df: DataFrame) -> DataFrame:
    """Log-shipping projection: message, level and flattened analysis fields."""
    score = F.coalesce(F.col("threat_score"), F.lit(0))
    where = F.concat(F.coalesce("event_type", F.lit("Unknown")), F.lit(" on "), F.coalesce("hostname", F.lit("unknown")))
    text = F.when(score > 0, F.concat(
        F.lit("🚨 THREAT DETECTED ["), score.cast("string"), F.lit("/100] "), where, F.lit(" - "),
        F.coalesce("summary", F.lit("Suspicious activity")))).otherwise(F.concat(
            where, F.lit(" - User: "), F.coalesce("user", F.lit("N/A"))))
    return df.select(
        "event_key", text.alias("message"), F.when(score >= 80, "error").when(score >= 60, "warn").otherwise("info")
        .alias("level"), "event_type", "event_id", "hostname", "user", score.alias("threat_score"),
        F.coalesce("threat_level", F.lit("unknown")).alias("threat_level"), nz("reasoning").alias("reasoning"),
        joined(F.coalesce("indicators", F.array().cast("array<string>"))).alias("indicators"), "command_line",
        "process_name")


def ship(df: DataFrame, path: str, counter=None) -> DataFrame:
    """Write the shipping rows as JSON lines; `counter` is an Observation that receives the sent count."""
    rows = ship_rows(df)
    if counter is not None:
        rows = rows.observe(counter, F.count(F.lit(1)).alias("sent"))
    rows.write.mode("append").json(path)
    return rows


def write_dataset(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(f"{path}/data")


def write_report(row: DataFrame, path: str) -> None:
    """A one-row (or few-row) report as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)
