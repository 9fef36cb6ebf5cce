"""Cases that earlier versions lost: colliding incident ids, odd files, frames out of order, repeated keys, literal braces."""

import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch import sinks
from tidewatch.operators import incidents, matching
from tidewatch.sources import readers as R
from tidewatch.streaming import state

SCHEMA = "event_id int, hostname string"


def test_sessions_of_hosts_with_equal_short_digests_stay_apart(spark):
    seen, pair = {}, None
    for i in range(20_000):
        tail = hashlib.md5(f"h{i}|0".encode()).hexdigest()[:6]
        if tail in seen:
            pair = seen[tail], f"h{i}"
            break
        seen[tail] = f"h{i}"
    rows = spark.createDataFrame([(h, 0) for h in pair], "hostname string, us long").withColumn("event_ts", F.timestamp_micros("us"))
    ids = {r.hostname: r.incident_id for r in incidents.correlate(rows).collect()}
    assert len(set(ids.values())) == 2 and len({x[:18] for x in ids.values()}) == 1


def test_one_document_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"event_id": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"event_id": 2, "hostname": "h"}, indent=2))
    (tmp_path / "c.json").write_text(json.dumps({"data": {"event_id": 3}}))
    (tmp_path / "d.json").write_text(json.dumps({"events": {"event_id": 4}}, indent=1))
    (tmp_path / "e.json").write_text(json.dumps({"data": [{"event_id": 5}]}, indent=1))
    (tmp_path / "f.json").write_text('{"event_id": 6}\n{"event_id": 7}\n')
    (tmp_path / "g.json").write_text('{"event_id": 8}')
    (tmp_path / "h.json").write_text("")
    (tmp_path / "i.json").write_text("not json")
    got = {r.event_id: r.hostname for r in R.read_wrapped_json(spark, str(tmp_path), SCHEMA).collect()}
    assert set(got) == set(range(1, 9)) and got[2] == "h"


def test_flow_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("Source IP,Destination Port,Label\n1.2.3.4,80,DDoS\n1.2.3.4,81,BENIGN\n")
    (tmp_path / "b.csv").write_text(" Destination Port, Label, Source IP\n443,DDoS,5.6.7.8\n")
    (tmp_path / "sub" / "c d.csv").write_text("Source IP;Destination Port;Label\n9.9.9.9;22;BENIGN\n")
    rows = R.read_flow_csv(spark, str(tmp_path)).collect()
    got = sorted((r.source_file.replace("%20", " "), r.source_ip, r.destination_port) for r in rows)
    assert got == [("a.csv", "1.2.3.4", 80), ("a.csv", "1.2.3.4", 81), ("b.csv", "5.6.7.8", 443), ("c d.csv", "9.9.9.9", 22)]


def test_labels_of_another_length_are_refused(spark, tmp_path):
    for part, n in (("train", 2), ("val", 3)):
        (tmp_path / f"{part}_events.json").write_text(json.dumps([{"event_id": 10 * n + i} for i in range(n)]))
        (tmp_path / f"{part}_labels.json").write_text(json.dumps([f"{part}{i}" for i in range(n)]))
    both = R.read_parallel_labels(spark, str(tmp_path / "*_events.json"), str(tmp_path / "*_labels.json"), SCHEMA)
    assert {r.event_id: r.label for r in both.collect()} == {20: "train0", 21: "train1", 30: "val0", 31: "val1", 32: "val2"}
    (tmp_path / "val_labels.json").write_text(json.dumps(["x"]))
    with pytest.raises(Exception, match="differ in number"):
        R.read_parallel_labels(spark, str(tmp_path / "*_events.json"), str(tmp_path / "*_labels.json"), SCHEMA).collect()


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Values:
    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)


class Handle:
    def listTimers(self):
        return []

    def registerTimer(self, at):
        self.at = at


def live(batches):
    job = state.LiveIncident()
    job.handle, job.state = Handle(), Value()
    out = []
    for frames in batches:
        job.state.calls = 0
        out.append([tuple(r) for p in job.handleInputRows(("h",), iter(pd.DataFrame({"event_us": f}) for f in frames), None)
                    for r in p.itertuples(index=False)])
        assert job.state.calls <= 2
    return out


MIN = 60_000_000


def test_live_incidents_do_not_depend_on_frames():
    assert live([[[60 * MIN], [0]]]) == [[("h", 0, 0, 1, "closed"), ("h", 60 * MIN, 60 * MIN, 1, "open")]]
    late = live([[[100 * MIN]], [[0, 10 * MIN]], [[75 * MIN, 120 * MIN]]])
    assert late[1] == [("h", 0, 10 * MIN, 2, "closed"), ("h", 100 * MIN, 100 * MIN, 1, "open")]
    assert late[2] == [("h", 75 * MIN, 120 * MIN, 3, "open")]
    rng = random.Random(3)
    times = [rng.randrange(0, 3000) * MIN for _ in range(20_000)] + [9000 * MIN]
    whole = live([[sorted(times)]])
    rng.shuffle(times)
    assert live([[times[i:i + 700] for i in range(0, len(times), 700)]]) == whole
    assert sum(r[3] for r in whole[0]) == len(times)


def drift(frames):
    job = state.DriftMonitor()
    job.test, job.recent = Value(), Values()
    for batch in frames:
        (row,) = job.handleInputRows(("s",), iter(pd.DataFrame(f, columns=["event_us", "value"]) for f in batch), None)
    return row.iloc[0]


def test_drift_monitor_does_not_depend_on_frames():
    rng = np.random.default_rng(2)
    rows = [(int(t), float(v)) for t, v in zip(rng.integers(0, 500, 12_000), rng.random(12_000), strict=True)]
    one = drift([[sorted(rows)]])
    rng.shuffle(rows)
    rows = [(int(t), v) for t, v in rows]
    many = drift([[rows[i:i + 900] for i in range(0, len(rows), 900)]])
    assert many["ph"] == pytest.approx(one["ph"]) and many["recent_mean"] == pytest.approx(one["recent_mean"]) and many["n"] == 12_000
    n = mean = total = 0.0
    low = float("inf")
    for _, v in sorted(rows):
        n += 1
        mean += (v - mean) / n
        total += v - mean - state.DELTA
        low = min(low, total)
    assert one["ph"] == pytest.approx(total - low)


def test_drift_monitor_resets():
    row = drift([[[(1, 0.0), (2, 100.0), (3, 500.0)]], [[(5, 0.2), (4, None)], [(6, 0.4)]]])
    assert row["n"] == 2 and not row["drift"] and row["recent_mean"] == pytest.approx((0 + 100 + 500 + 0.2 + 0.4) / 5)
    assert drift([[[(1, None)]]])["n"] == 0


def test_upsert_with_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, None), ("a", None, "x"), ("b", 2, "y")], "k string, n int, s string")
    new = spark.createDataFrame([("a", 5, None), ("a", 5, None), ("c", 3, None)], "k string, n int, s string")
    # the newest row of a key counts whole: of the two old rows of "a" the one with the larger n, which has no s
    assert {tuple(r) for r in sinks.upsert(old, new, "k").collect()} == {("a", 5, None), ("b", 2, "y"), ("c", 3, None)}
    told = spark.createDataFrame([("a", "open", 9, 1), ("a", "closed", 3, 2)], "k string, status string, n int, updated_at int")
    assert [tuple(r) for r in sinks.upsert(told.limit(0), told, "k").select("k", "status", "n").collect()] == [("a", "closed", 3)]


def test_rules_that_only_one_engine_accepts(spark):
    rules = spark.createDataFrame([("critical", "{abc}"), ("high", "ba{,3}d"), ("medium", "(?<=x*)y"), ("low", "end("), ("low", r"q\{1\}z{2}")],
                                  "level string, pattern string")
    texts = ["run {ABC} now", "baaad", "bd!", "an end( here", "q{1}zz", "nothing"]
    rows = spark.createDataFrame([(t, "", "") for t in texts], "command_line string, process_name string, parent_image string")
    got = {r.command_line: r.c for r in rows.select("command_line", matching.sigma_class(rules).alias("c")).collect()}
    assert [got[t] is not None for t in texts] == [True, True, True, True, True, False]
    assert got["run {ABC} now"] != got["baaad"] == got["bd!"]


def test_patterns_across_events(spark):
    rows = [("i", 1, "run readme"), ("i", 2, "then decrypt"), ("j", 1, "decrypt"), ("j", 2, "readme"), ("k", 1, "readme decrypt")]
    df = spark.createDataFrame(rows, "incident_id string, event_key long, command_line string").withColumns(
        {"event_ts": F.timestamp_seconds("event_key"), "process_name": F.lit("")})
    name = next(f"p_{i}_{j}" for i, t in enumerate(matching.A.INCIDENT_TYPES) for j, p in enumerate(t[2]) if p == "readme.*decrypt")
    got = {r.incident_id: r[name] for r in df.groupBy("incident_id").agg(*matching.incident_pattern_flags()).collect()}
    assert got == {"i": True, "j": False, "k": True}


def test_reports_hold_every_entry(spark):
    """An incident of 1,500 events: the text report lists them all, the JSON of the second report too."""
    n = 1500
    rows = spark.range(n).select(
        F.col("id").alias("event_key"), F.timestamp_seconds(F.col("id")).alias("event_ts"), F.lit("h").alias("hostname"),
        F.timestamp_seconds(F.col("id")).cast("string").alias("timestamp"), F.lit("u").alias("user"), F.lit(0.9).alias("ml_score"), F.lit(1).alias("event_id"),
        F.lit("a.exe").alias("process_name"), F.concat(F.lit("mimikatz 8.8."), (F.col("id") % 200).cast("string"), F.lit(".9")).alias("command_line"),
        *[F.lit("").alias(c) for c in ("action", "query_name", "image_loaded", "message", "script_block_text", "parent_image", "service_file",
                                       "parent_command_line", "source_ip", "destination_ip", "hashes", "original_filename", "target_object", "signed", "channel")],
        F.lit(2).alias("logon_type"), F.lit(0).alias("destination_port"))
    inc, tl = incidents.investigate(rows)
    text = incidents.report_text(inc, tl).first().report
    assert text.count("Credential dumping: ") >= n and "more events" not in text


@pytest.mark.parametrize("n", [40, 5000])
def test_interpolation_neighbours_do_not_depend_on_blocks(spark, n):
    """On a line, the partner of every row is one of its five nearest, whatever the blocks."""
    from tidewatch.operators import datasets

    rng = np.random.default_rng(n)
    x = np.sort(rng.exponential(1.0, n))
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "id long, v array<double>")
    made = {b: {r.id: r.v[0] for r in datasets.interpolate_minority(df, "id", "v", planes=2, block=b).collect()} for b in (50, 1000)}
    assert made[50] == pytest.approx(made[1000]) and len(made[50]) == n
    for i, v in made[50].items():
        near = np.sort(np.abs(x - x[i]))[min(5, n - 1)]
        assert abs(v - x[i]) <= near + 1e-12
