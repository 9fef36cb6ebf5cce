"""Readers on files, sinks, models and streaming against batch."""

import gzip
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewatch import sinks
from tidewatch.operators import datasets, features, incidents, models, scoring
from tidewatch.schema import security_events
from tidewatch.sources import readers as R
from tidewatch.streaming import jobs, state

SCHEMA = "event_id int, hostname string, timestamp string, command_line string"


def test_event_batches_and_default_timestamp(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"event_id": 1, "hostname": "h"}, {"event_id": 2, "timestamp": "t"}]))
    (tmp_path / "b.json").write_text(json.dumps({"event_id": 3}))
    rows = {r.event_id: r.timestamp for r in R.read_events_json(spark, str(tmp_path), SCHEMA).collect()}
    assert set(rows) == {1, 2, 3} and rows[2] == "t" and rows[1].endswith("Z")


def test_wrapped_and_line_files(spark, tmp_path):
    (tmp_path / "wrapped.json").write_text(json.dumps({"data": [{"event_id": 1}, {"event_id": 2}]}))
    (tmp_path / "events.json").write_text(json.dumps({"events": [{"event_id": 3}]}))
    (tmp_path / "array.json").write_text(json.dumps([{"event_id": 4}]))
    (tmp_path / "lines.json").write_text('{"event_id": 5}\nbroken\n{"event_id": 6}\n')
    with gzip.open(tmp_path / "z.json.gz", "wt") as fh:
        fh.write('{"event_id": 7}')
    got = sorted(r.event_id for r in R.read_wrapped_json(spark, str(tmp_path), SCHEMA).collect())
    assert got == [1, 2, 3, 4, 5, 6, 7]
    lines = R.read_log_lines(spark, str(tmp_path / "lines.json"), SCHEMA)
    assert sorted(r.event_id for r in lines.collect()) == [5, 6]


def test_parallel_arrays(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"event_id": 1}, {"event_id": 2}]))
    (tmp_path / "l.json").write_text(json.dumps(["benign", "malicious_high"]))
    got = R.read_parallel_labels(spark, str(tmp_path / "e.json"), str(tmp_path / "l.json"), SCHEMA)
    assert {r.event_id: r.label for r in got.withColumn("label", scoring.binary_label(F.col("label"))).collect()} == {1: 0, 2: 1}


def test_event_xml_file(spark, tmp_path):
    line = ('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>10</EventID><Computer>H1</Computer>'
            '</System><EventData><Data Name="SourceImage">C:\\a\\Evil.exe</Data><Data Name="TargetImage">C:\\b\\lsass.exe</Data>'
            "</EventData></Event>")
    (tmp_path / "x.log").write_text("noise\n" + line + "\n")
    row = __import__("tidewatch.sources.normalize", fromlist=["event_xml"]).event_xml(
        R.read_event_xml(spark, str(tmp_path / "x.log"))).first()
    assert (row.raw_eid, row.process_name, row.target_user, row.severity, row.label) == (10, "evil.exe", "lsass.exe", "critical", 1)


def test_flow_csv_header_variants(spark, tmp_path):
    (tmp_path / "f.csv").write_text(" Source IP; Destination Port; Label\n1.2.3.4;80.0;DDoS\n")
    row = R.read_flow_csv(spark, str(tmp_path / "f.csv"), sep=";").first()
    assert (row.source_ip, row.destination_port, row["class"]) == ("1.2.3.4", 80, "malicious_high")


def test_attack_csv(spark, tmp_path):
    head = [c.split()[0] for c in R.ATTACK_CSV_SCHEMA.split(", ")]
    (tmp_path / "a.csv").write_text(",".join(head) + "\nExecution,f,4688,Security,H,,cmd.exe,whoami,,3,bob,,443\n")
    df = R.read_attack_csv(spark, str(tmp_path / "a.csv"))
    row = df.select("*", features.tactic_severity(F.col("EVTX_Tactic")).alias("sev")).first()
    assert row.sev == 2 and row.EventID == "4688"


def test_rule_files_and_bundle(spark, tmp_path):
    (tmp_path / "r.yml").write_text(
        "title: T\nid: r1\nlevel: high\ntags: [attack.t1003, other]\ndetection:\n  sel:\n    CommandLine|contains:\n      - '*mimi*'\n"
        "      - foo\n  condition: sel\n---\ntitle: no detection\n")
    pats = R.read_rules(spark, str(tmp_path))
    assert sorted((r.level, r.field, r.pattern) for r in pats.collect()) == [
        ("high", "commandline|contains", ".*mimi.*"), ("high", "commandline|contains", "foo")]
    assert R.rule_statistics(pats).first().rules == 1
    obj = {"type": "attack-pattern", "name": "Credential Dumping", "x_mitre_platforms": ["Windows"],
           "x_mitre_detection": "Monitor processes, memory access.", "external_references": [
               {"source_name": "mitre-attack", "external_id": "T1003"}],
           "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "credential-access"}]}
    drop = [dict(obj, revoked=True), dict(obj, x_mitre_platforms=["Linux"]), dict(obj, kill_chain_phases=[])]
    (tmp_path / "b.json").write_text(json.dumps({"objects": [obj] + drop}))
    cat = R.build_catalogue(R.read_bundle(spark, str(tmp_path / "b.json")))
    row = cat.collect()
    assert len(row) == 1 and row[0].tactic == "credential_access" and row[0].severity == 90
    assert row[0].keywords == ["access", "credential", "dumping", "memory", "monitor", "processes"]
    assert R.techniques_per_tactic(cat).first().n == 1


def test_corpus_titles(spark, tmp_path):
    (tmp_path / "incident_response-guide.md").write_text("text")
    (tmp_path / "skip.bin").write_text("x")
    assert [r.title for r in R.read_corpus(spark, str(tmp_path)).collect()] == ["Incident Response Guide"]


def test_upsert_versions_links_and_appends(spark, tmp_path, sf):
    old = spark.createDataFrame([("a", "open", 1), ("b", "open", 2)], "incident_id string, status string, n int")
    new = spark.createDataFrame([("a", None, 5), ("c", "new", None)], "incident_id string, status string, n int")
    merged = sinks.upsert(old, new, "incident_id")
    sinks.replace_table(merged, str(tmp_path / "inc"))
    sinks.replace_table(merged.where("incident_id <> 'b'"), str(tmp_path / "inc"))
    got = {r.incident_id: (r.status, r.n) for r in sinks.current_table(spark, str(tmp_path / "inc")).collect()}
    assert got == {"a": ("open", 5), "c": ("new", None)}
    ev = security_events(spark, sf, "event_key", "event_ts", "hostname")
    sinks.append_events(ev, str(tmp_path / "ev"))
    sinks.append_events(ev, str(tmp_path / "ev"))
    stored = spark.read.parquet(str(tmp_path / "ev"))
    assert stored.count() == 2 * ev.count() and "dt" in stored.columns
    links = spark.createDataFrame([(1, "IR-1")], "event_key bigint, incident_id string")
    assert sinks.link_to_incident(ev, links).where("incident_id = 'IR-1'").count() == 1


def test_shipping_counts_rows(spark, tmp_path, sf):
    # an Observation makes its session unserialisable for model summaries, so it gets a session of its own
    spark = spark.newSession()
    seen = Observation("sent")
    ev = security_events(spark, sf).withColumns({
        "threat_score": F.lit(81), "summary": F.lit("s"), "threat_level": F.lit(None).cast("string"), "reasoning": F.lit(
            None).cast("string"), "indicators": F.array(F.lit("x"))})
    sinks.ship(ev, str(tmp_path / "ship"), seen)
    assert seen.get["sent"] == ev.count() and spark.read.json(str(tmp_path / "ship")).first().level == "error"
    sinks.write_report(ev.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).first().n == ev.count()


def test_dataset_files(spark, tmp_path, sf):
    ev = datasets.random_split(security_events(spark, sf, "event_key", "label"), "event_key")
    sinks.write_dataset(ev, str(tmp_path / "ds"))
    assert {r.split for r in spark.read.parquet(str(tmp_path / "ds/data")).select("split").distinct().collect()} == {"train", "val"}


# ---------------------------------------------------------------- models
def test_training_calibration_and_promotion(spark, tmp_path):
    df = spark.range(600).select(F.col("id").alias("k"), (F.rand(1) + (F.col("id") % 2) * 0.4).alias("a"), F.rand(2).alias("b"),
                                 (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("fold")).cache()
    pipe = models.boosted_trees(["a", "b"], "classic", maxIter=3, weight="weight")
    model = pipe.fit(models.with_weights(df))
    ok, auc = models.promote(model, df, str(tmp_path / "m"), None, "two")
    again, _ = models.promote(model, df, str(tmp_path / "m"), auc, "two")
    assert ok and not again and auc > 0.7
    pairs = models.platt(models.boosted_trees(["a", "b"], "classic", maxIter=2), df)
    p = models.score_calibrated(pairs, df).agg(F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    assert 0 <= p.lo < p.hi <= 1
    drop = {r.feature: r.mean_drop for r in models.importance(model, df, ["a", "b"], "k", repeats=1).collect()}
    assert drop["a"] > drop["b"]
    mean, _ = models.cross_validate(models.forest(["a", "b"], trees=5, depth=3), df, folds=3)
    assert mean > 0.7
    held = models.fold_metrics(models.forest(["a", "b"], trees=5, depth=3), df, "fold", [0, 1])
    assert held.count() == 2
    top = models.local_explanation(model, df.limit(1), ["a", "b"], "k", samples=60, top=1).collect()
    assert top[0].feature == "a"


# ---------------------------------------------------------------- streaming
@pytest.fixture(scope="module")
def source(spark, sf, tmp_path_factory):
    """The event view as a folder a stream can read."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    ev = security_events(spark, sf)
    ev.withColumn("event_ts", F.col("event_ts").cast("timestamp")).orderBy("event_ts").coalesce(1).write.parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def run(df, name, mode, path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", f"{path}-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_scored_stream_equals_batch(spark, source):
    cols = ["event_key", "ml_score", "path"]
    got = run(jobs.scored_stream(stream(spark, source)).select(*cols), "scored", "append", source)
    want = jobs.scored_stream(spark.read.parquet(source)).select(*cols)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_session_stream_equals_closed_batch_sessions(spark, source):
    got = {r.incident_id: r.events for r in run(jobs.session_stream(stream(spark, source)), "sessions", "append", source).collect()}
    batch = incidents.correlate(spark.read.parquet(source)).groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_ts").alias("last")).collect()
    last = max(r["last"] for r in batch)
    closed = {r.incident_id: r.n for r in batch if (last - r["last"]).total_seconds() > 41 * 60}
    assert closed and all(got[k] == v for k, v in closed.items())


def test_counter_stream(spark, source):
    got = run(jobs.counter_stream(jobs.scored_stream(stream(spark, source))), "counters", "complete", source)
    assert got.agg(F.sum("n").alias("n")).first().n == spark.read.parquet(source).count()


def test_indicator_stream_dedupes(spark, source):
    got = run(jobs.indicator_stream(stream(spark, source)), "indicators", "append", source)
    assert got.count() > 0 and {"type", "value", "details", "is_malicious"} <= set(got.columns)


def test_chat_sessions(spark, source):
    msgs = stream(spark, source).select(F.col("hostname").alias("conv_id"), F.col("event_ts").alias("ts"))
    got = run(jobs.chat_sessions(msgs), "chats", "append", source)
    assert got.where("expires <= start").count() == 0 and got.count() > 0


def test_fan_out_is_idempotent(spark, source, tmp_path):
    base = str(tmp_path / "out")
    for attempt in range(2):  # a second start with a new checkpoint replays batch 0 over the same directories
        q = jobs.fan_out(jobs.scored_stream(stream(spark, source)), base, str(tmp_path / f"c{attempt}")).trigger(
            availableNow=True).start()
        q.awaitTermination(120)
    assert spark.read.parquet(base + "/events").count() == spark.read.parquet(source).count()
    assert spark.read.parquet(base + "/iocs").count() > 0


def test_live_incidents_cover_all_events(spark, source):
    ev = stream(spark, source).withColumn("event_us", F.unix_micros("event_ts")).withWatermark("event_ts", "10 minutes")
    got = run(state.live_incidents(ev), "live", "update", source)
    best = got.groupBy("hostname", "start_us").agg(F.max("events").alias("n"))
    assert best.agg(F.sum("n").alias("n")).first().n == spark.read.parquet(source).count()


def test_drift_monitor_matches_batch(spark, source):
    rows = stream(spark, source).select(F.col("source_type").alias("stream"), F.unix_micros("event_ts").alias("event_us"),
                                        F.col("score").alias("value"))
    got = {r.stream: r for r in run(state.drift_monitor(rows), "drift", "update", source).collect()}
    from tidewatch.operators.drift import page_hinkley, recent_status

    batch = spark.read.parquet(source)
    ph = page_hinkley(batch, "source_type", ["event_ts", "event_key"], "score", F.date_trunc("hour", "event_ts"))
    last = {r.source_type: r for r in ph.groupBy("source_type").agg(F.max_by("ph", "n").alias("ph"), F.max("n").alias("n")).collect()}
    rec = {r.source_type: r for r in recent_status(batch, "source_type", ["event_ts", "event_key"], "score").collect()}
    for s, r in last.items():
        assert got[s].n == r.n and got[s].ph == pytest.approx(r.ph, abs=1e-6)
        assert got[s].recent_mean == pytest.approx(rec[s].recent_mean_score)
