"""Streaming forms of the row rules, sessions, counters, indicator lookups and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.functions.ioc import event_indicators_a
from tidewatch.operators.incidents import IOC_FIELDS, incident_id, timeline
from tidewatch.operators.matching import local_intel
from tidewatch.operators.scoring import route, score_events
from tidewatch.sinks import KeyedTable


def scored_stream(events: DataFrame) -> DataFrame:
    """Continuous scoring: the batch expressions, stateless."""
    return route(score_events(events))


def timed(events: DataFrame, delay: str = "10 minutes", ts: str = "event_ts") -> DataFrame:
    """Event time as a zoned timestamp under a watermark; rows later than the delay are dropped downstream."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def session_stream(events: DataFrame, host: str = "hostname", ts: str = "event_ts", gap: str = "30 minutes") -> DataFrame:
    """Closed sessions per host with counts; the id equals the batch id."""
    out = timed(events, ts=ts).groupBy(host, F.session_window(ts, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.max(ts).alias("last_ts"))
    start = F.unix_micros("w.start")
    return out.select(host, start.alias("start_us"), incident_id(F.col(host), start).alias("incident_id"), "events",
                      F.unix_micros("last_ts").alias("last_us"))


def counter_stream(routed: DataFrame, ts: str = "event_ts", width: str = "1 minute") -> DataFrame:
    """Events per minute, path and class."""
    return timed(routed, ts=ts).groupBy(F.window(ts, width).alias("w"), "path", "classification").agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), "path", "classification", "n")


def indicator_stream(events: DataFrame, ts: str = "event_ts", hours: int = 1) -> DataFrame:
    """Each indicator once per hour, with its local verdict."""
    found = events.select(F.col(ts).cast("timestamp").alias(ts), F.explode(event_indicators_a(IOC_FIELDS)).alias("i"))
    rows = found.select(ts, "i.type", "i.value").withWatermark(ts, f"{hours} hour")
    return local_intel(rows.dropDuplicatesWithinWatermark(["type", "value"]))


def chat_sessions(messages: DataFrame, ts: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """Conversation contexts that expire after an idle time."""
    return messages.withWatermark(ts, ttl).groupBy("conv_id", F.session_window(ts, ttl).alias("w")).agg(
        F.count(F.lit(1)).alias("messages")).select("conv_id", F.col("w.start").alias("start"),
                                                    F.col("w.end").alias("expires"), "messages")


def fan_out(routed: DataFrame, base: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch to the events, timeline and indicator tables.

    Every table directory is keyed by batch id and overwritten on replay, so a batch that runs twice leaves one copy.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{base}/events/batch_id={batch_id}")
        bad = batch.where(F.col("classification") == "malicious")
        tl = timeline(bad)
        tl.drop("iocs").write.mode("overwrite").parquet(f"{base}/timeline/batch_id={batch_id}")
        iocs = tl.select("event_key", "timestamp", F.explode("iocs").alias("i")).select("event_key", "timestamp", "i.*")
        iocs.write.mode("overwrite").parquet(f"{base}/iocs/batch_id={batch_id}")
        batch.unpersist()

    return routed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


INCIDENT_TABLE = ("incident_id string, hostname string, start_us bigint, last_us bigint, events bigint, status string, closed boolean")


def incident_table(spark, base: str) -> KeyedTable:
    """The stored incidents: of each the row told last (the latest event, the most events, closed after open)."""
    return KeyedTable(spark, base, INCIDENT_TABLE, "incident_id", ["last_us", "events", "closed"])


def incident_writer(live: DataFrame, base: str, checkpoint: str) -> DataStreamWriter:
    """Live incidents (see streaming.state) into the incident table, beside the event, timeline and indicator tables of
    `fan_out`. Each micro-batch merges by incident id; a batch that runs twice changes nothing."""
    rows = live.select(incident_id(F.col("hostname"), F.col("start_us")).alias("incident_id"), "hostname", "start_us", "last_us", "events",
                       "status", (F.col("status") == "closed").alias("closed"))
    table = incident_table(live.sparkSession, base)
    return rows.writeStream.outputMode("update").foreachBatch(table.apply).option("checkpointLocation", checkpoint)
