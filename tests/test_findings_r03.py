"""Tests for the findings of FINDINGS_r03.md; each failed before its finding was settled."""

import os
import re
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.functions import ioc
from tidewatch.llm import common, katz, quality
from tidewatch.operators import knowledge, vector_index
from tidewatch.plans import correlate, roundtrip
from tidewatch.rules import intel
from tidewatch.session import ensure_checkpoint_dir
from tidewatch.streaming import state


def test_quality_counts_come_from_every_trusted_document(spark):
    ids = spark.range(20_300).withColumnRenamed("id", "doc_id")
    last = ids.orderBy(F.desc(F.xxhash64("doc_id"))).limit(300).withColumn("text", F.lit("qqqqqq"))
    docs = ids.join(last, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("abcdabcd")).alias("text"))
    model, _ = quality.train(docs, ids)
    q = int(quality.symbol_table()[ord("q")])
    gram = sum(q * quality.SYMBOLS ** k for k in range(quality.ORDER))
    assert np.exp(model[gram]) > 0.5


@pytest.mark.parametrize("metric", ["inner", "distance"])
def test_rows_meet_queries_in_blocks(spark, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 32)
    monkeypatch.setattr(vector_index, "SLICE_QUERIES", 16)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 6)), np.tile(rng.normal(size=6), (60, 1))])  # many equal rows: ties by key
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"), "k", "v", metric).build(table)
    asked = table.select(F.col("k").alias("query_id"), F.col("v").alias("query_vector"))
    got = {}
    for r in index.search(asked, 4, itself=False)[0].collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.k))
    for i, q in enumerate(x):
        score = x @ q if metric == "inner" else -np.sqrt(((x - q) ** 2).sum(1))
        order = [int(j) for j in np.lexsort((np.arange(len(x)), -score.round(9))) if j != i][:4]
        assert [k for _, k in sorted(got[i])] == order


@pytest.mark.parametrize("name", ["incident_views", "ml_investigation"])
def test_no_side_that_grows_is_broadcast(spark, sf, name):
    plan = correlate.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rows_are_spread_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(schema, "TASK_ROWS", 1000)
    rows = spark.range(0, 30_000, 1, 2)
    assert schema.spread(rows).rdd.getNumPartitions() == 30
    assert schema.spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50


def test_katz_keeps_pairs_seen_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a c"), (4, "a b"), (5, "d b")], "doc_id long, text string")
    # "d b" was seen once: its probability is a discounted share of d's pairs, not the backoff
    held = spark.createDataFrame([(9, "d b")], "doc_id long, text string").unionByName(docs)
    unseen = spark.createDataFrame([(9, "d a")], "doc_id long, text string").unionByName(docs)
    rows = [{r.doc_id: r.score for r in katz.score_texts(x, F.col("doc_id") == 9).collect()} for x in (held, unseen)]
    assert rows[0][9] > rows[1][9] + 0.3


def test_chunks_leave_in_batches_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "PIECE_BYTES", 4000)
    monkeypatch.setattr(knowledge, "PIECE_ROWS", 20)
    texts = ["word. " * n for n in (0, 5, 900, 40, 3000, 1)] + [None]
    rows = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts), pa.array(["s"] * 7)], ["doc_id", "_text", "_source"])
    got = list(knowledge._chunk_pieces(512, 64)(iter([rows])))
    assert len(got) >= 5 and max(b.num_rows for b in got) <= 20
    want = []
    for n, text in enumerate(texts):
        body = (text or "").strip()
        want += [(n, i, lo, hi, body[lo:hi].strip()) for i, (lo, hi) in enumerate(knowledge.cut_points(body))]
    names = ("doc_id", "chunk_index", "char_start", "char_end", "chunk")
    assert [tuple(r[x] for x in names) for b in got for r in b.to_pylist()] == want


def test_katz_writes_no_bigrams(spark):
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3000, (100, 2000))  # 200,000 pairs, nearly all distinct
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in row)) for i, row in enumerate(words)], "doc_id long, text string")
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(base) for f in files)
    before = size()
    assert katz.score_texts(docs, F.col("doc_id") % 7 == 2).count() == 100
    assert size() - before < 1_500_000


def test_stream_slices_come_from_one_pass_in_time_order(spark, monkeypatch):
    monkeypatch.setattr(roundtrip, "BATCH_ROWS", 500)
    rows = spark.range(5000).select(F.expr("timestamp_micros((id * 7919 % 5000) * 1000000)").alias("event_ts"), "id")
    told = []
    source = roundtrip._in_time(spark, rows)
    query = source.writeStream.trigger(availableNow=True).foreachBatch(lambda b, n: told.append(b.agg(F.min("event_us"), F.max("event_us"), F.count("*")).first()))
    query.start().awaitTermination()
    assert len(told) >= 8 and sum(t[2] for t in told) == 5000
    assert all(a[1] < b[0] for a, b in zip(told, told[1:], strict=False))


def test_live_incidents_share_batches_of_states(spark):
    plan = roundtrip.state.live_incidents(roundtrip._in_time(spark, spark.range(10).select(
        F.lit("h").alias("hostname"), F.expr("timestamp_seconds(id)").alias("event_ts"))).withWatermark("event_ts", "10 minutes"))
    assert "FlatMapGroupsInPandasWithState" in plan._jdf.queryExecution().analyzed().toString()


def test_windows_share_one_count_of_bins():
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=1500).round(1), [np.nan, 9.0, -9.0, 2.0]])
    edges, counts = np.array([-2.0, -1.0, 0.0, 0.0, 0.5, 2.0]), np.array([5.0, 20.0, 0.0, 10.0, 7.0])
    highs = np.array([100, 200, 600, 1504])
    lows = np.maximum(0, highs - 500)
    got = state.stabilities((edges, counts, 42), values, lows, highs)
    for lo, hi, x in zip(lows, highs, got, strict=True):
        part = values[lo:hi]
        e = np.maximum(counts / 42, 1e-10)
        a = np.maximum(np.histogram(part[~np.isnan(part)], edges)[0] / len(part), 1e-10)
        assert abs(((a - e) * np.log(a / e)).sum() - x) < 1e-6


def test_label_files_are_few(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(roundtrip, "shared_dir", lambda spark, name: str(tmp_path / name))
    assert roundtrip.QUERIES["parallel_label_files"](spark, "/root/testdata/sf0.1").count() == 100_000
    assert len(list((tmp_path / "pairs" / "events").glob("g=*/part-*"))) <= 10


def test_quality_scores_in_small_slices_without_the_caches_of_other_stages():
    rows = pa.record_batch({"doc_id": pa.array(range(2000)), "lang": ["en"] * 2000, "text": ["abcd efgh " * 800] * 2000,
                            "fold": pa.array([i % 3 for i in range(2000)], pa.int32())})
    entries = quality.SYMBOLS ** quality.ORDER
    model, others = (SimpleNamespace(value=np.full(n, -1.0, np.float32)) for n in (entries, (quality.FOLDS, entries)))
    common.word_hashes().of([b"some", b"words"])
    quality.symbol_table()
    tracemalloc.start()
    got = [b.column("loss").to_pylist() for b in quality._score(model, others)([rows])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got, []) == [8001.0] * 2000
    assert peak < 48 << 20
    assert common.word_hashes.cache_info().currsize == 0


def test_long_runs_of_letters_are_not_searched_for_addresses(spark):
    texts = ["a" * 200_000, "mail a.b@c.org or http://x.io/y", r"C:\Temp\drop.exe HKLM\Run\x hkcu\soft", "", r"HKEY_LOCAL_MACHINE\A d:\b", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).sortWithinPartitions("i")
    began = time.time()
    got = rows.select("i", ioc.text_indicators_a(F.col("t")).alias("a"), ioc.text_indicators_b(F.col("t")).alias("b")).collect()
    assert time.time() - began < 10
    for r in got:
        for hits, patterns, flags in ((r.a, intel.IOC_PATTERNS_A, 0), (r.b, intel.IOC_PATTERNS_B, re.IGNORECASE)):
            for kind in ioc.HOLDS:
                if texts[r.i] is None or len(texts[r.i]) > 1000:
                    assert not hits
                else:
                    assert [h.value for h in hits if h.type == kind] == [m.group() for m in re.finditer(patterns[kind], texts[r.i], flags)]


def test_the_host_of_an_incident_is_not_looked_for_again(spark, sf):
    found = correlate.investigated(spark, sf)[0]
    assert not re.search(r"hostname#\d+ AS _v", found._jdf.queryExecution().optimizedPlan().toString())
    assert found.where("affected_hosts <> array(host)").count() == 0
