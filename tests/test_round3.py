"""Merged techniques, the drift monitor, keyed tables, reports as rows, importance, explanations, the vector index and the
incremental source, each against a plain version."""

from __future__ import annotations

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_verdict_fixes import Value
from tidewatch import session, sinks
from tidewatch.operators import incidents, matching, models, monitor, report_rows, vector_index
from tidewatch.plans import correlate
from tidewatch.sources import incremental
from tidewatch.streaming import state


# ---------------------------------------------------------------- techniques
def test_keyword_index_equals_every_rule_on_every_text(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcé ", k=rng.randint(3, 7))) for _ in range(60)]
    cards = [(f"T{i:03}", f"n{i}", f"t{i % 5}", rng.choices(words, k=6)) for i in range(40)]
    texts = ["".join(rng.choices("abcé ", k=rng.choice([0, 2, 5, 60, 300]))) for _ in range(80)] + ["ABCÉ " * 30, ""]
    rows = [(i, t, "", None) for i, t in enumerate(texts)] + [(1000 + i, texts[11], "", None) for i in range(200)]
    df = spark.createDataFrame(rows, "event_key long, command_line string, process_name string, script_block_text string")
    cat = spark.createDataFrame(cards, "id string, name string, tactic string, keywords array<string>")
    got = Counter((r.event_key, r.id, r.name, r.tactic, round(r.confidence, 6)) for r in matching.extended_techniques(df, cat, "event_key").collect())
    want = Counter()
    for key, text, proc, _ in rows:
        whole = " ".join([text.lower(), proc, ""])
        hits = [(min(sum(len(k) > 3 and k in whole for k in ks) / 5, 1.0), i, n, t) for i, n, t, ks in cards
                if sum(len(k) > 3 and k in whole for k in ks) >= 2]
        want.update((key, i, n, t, round(c, 6)) for c, i, n, t in sorted(hits, key=lambda h: (-h[0], h[1]))[:10])
    assert got == want and sum(got.values()) > 200
    assert matching.extended_techniques(df, cat.limit(0), "event_key").collect() == []


def test_merged_techniques_leave_out_known_ids(spark):
    pattern = "array<struct<rule_order:int,id:string,name:string,tactic:string,confidence:double,evidence:array<string>>>"
    found = [(2, "T1", "one", "a", 0.4, ["e"]), (5, "T2", "two", "b", 0.6, [])]
    more = [("T1", "one", "a", 1.0), ("T3", "three", "c", 0.8), ("T4", "four", "c", 0.4)]
    df = spark.createDataFrame([(1, found, more), (2, [], None), (3, [], more)],
                               f"k long, m {pattern}, x array<struct<id:string,name:string,tactic:string,confidence:double>>")
    got = {r.k: [(t.id, t.extended) for t in r.t] for r in df.select("k", matching.merged_techniques(F.col("m"), F.col("x")).alias("t")).collect()}
    assert got == {1: [("T3", True), ("T2", False), ("T1", False), ("T4", True)], 2: [], 3: [("T1", True), ("T3", True), ("T4", True)]}


# ---------------------------------------------------------------- drift monitor
def plain_psi(expected, actual, bins=10, eps=1e-10):
    edges = np.unique(np.percentile(expected, np.linspace(0, 100, bins + 1)))
    if len(edges) < 2:
        return 0.0
    e = np.clip(np.histogram(expected, edges)[0] / (len(expected) + eps), eps, None)
    a = np.clip(np.histogram(actual, edges)[0] / (len(actual) + eps), eps, None)
    return float(((a - e) * np.log(a / e)).sum())


def plain_checks(base, rows, names):
    out, n, mean, total, low, alarmed, latched, ring = [], 0, 0.0, 0.0, float("inf"), False, False, []
    for row in rows:
        ring = [*ring, row][-500:]
        n += 1
        x = row[-1]
        mean += (x - mean) / n
        total += x - mean - 0.005
        low = min(low, total)
        alarmed |= total - low > 50
        if n % 100 == 0:
            window = np.array(ring)
            psi = [plain_psi(base[:, k], window[:, k]) for k in range(len(names))]
            bad = sum(p > 0.25 for p in psi[:-1])
            warn = max((p for p in psi[:-1] if p > 0.1), default=0.0)
            level = "CRITICAL" if bad or psi[-1] > 0.25 else "WARNING" if warn or psi[-1] > 0.1 or alarmed else "none"
            out.append((n, len(window), alarmed or latched, round(psi[-1], 4), round(warn, 4), bad, level))
            latched |= level == "CRITICAL"
    return out


def watched(n, seed=1):
    rng = np.random.default_rng(seed)
    shift = np.linspace(0, 1.5, n)
    return np.column_stack([rng.normal(0, 1, n) + shift, rng.integers(0, 2, n), np.zeros(n), rng.random(n) + (np.arange(n) > n // 2) * 0.8])


def test_checks_equal_a_plain_loop(spark, tmp_path):
    names, base, rows = ["a", "b", "flat", "score"], watched(900, 2), watched(1730)
    columns = "event_key long, event_ts timestamp, stream string, a double, b double, flat double, score double"
    table = lambda x, s: spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(minutes=i // 7), s, *map(float, v)) for i, v in enumerate(x)], columns)
    monitor.store_baseline(table(base, "old").limit(10), "event_key", names, str(tmp_path / "b"))
    monitor.store_baseline(table(base, "old"), "event_key", names, str(tmp_path / "b"))
    baseline = monitor.stored_baseline(spark, str(tmp_path / "b"))
    assert {r.feature: r.n for r in baseline.collect()} == dict.fromkeys(names, 900)
    want = plain_checks(base, rows, names)
    got = monitor.check_rows(table(rows, "s").unionByName(table(rows[:99], "short")), "stream", ["event_ts", "event_key"], names[:-1], baseline)
    got = got.where("stream = 's'").orderBy("n_processed").collect()
    assert [(r.n_processed, r.window_size, r.ph_drift, r.psi_scores, r.max_psi, r.n_critical, r.drift_level) for r in got] == want
    assert any(a.startswith("Page-Hinkley") for a in got[-1].alarms) and got[-1].alarms[0].startswith("CRITICAL feature drift: a(PSI=")
    held = {r.feature: (np.array(r.edges, float), np.array(r.counts, float), r.n) for r in baseline.collect()}
    for size in (1730, 130, 37):  # however the stream is cut into batches
        job, told = state.DriftChecks(names[:-1], held), []
        job.state = Value()
        for at in range(0, len(rows), size):
            frame = pd.DataFrame(rows[at:at + size], columns=["a", "b", "flat", "value"]).assign(event_us=range(at, min(at + size, len(rows))), event_key=0)
            (out,) = job.handleInputRows(("s",), iter([frame.iloc[::-1]]), None)
            told += list(out.drop(columns="stream").itertuples(index=False, name=None))
        assert told == want


# ---------------------------------------------------------------- keyed tables
def test_keyed_table_replays_and_compaction(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), "k string, at int, status string", "k", ["at"])
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at int, status string")
    read = lambda: {tuple(r) for r in table.read().collect()}
    assert read() == set()
    table.compact()
    table.apply(rows(("a", 1, "open"), ("a", 2, "closed"), ("b", 1, "open")), 0)
    table.apply(rows(("b", 3, None)), 1)
    whole = {("a", 2, "closed"), ("b", 3, None)}
    assert read() == whole
    table.apply(rows(("b", 3, None)), 1)
    table.compact()
    assert read() == whole
    table.apply(rows(("a", 9, "replayed under a batch that the version holds")), 1)
    assert read() == whole
    table.apply(rows(("c", 1, "new"), ("a", 1, "late")), 2)
    table.compact()
    table.compact()
    assert read() == whole | {("c", 1, "new")}


# ---------------------------------------------------------------- reports
def test_report_rows_equal_the_text_report(spark, sf, tmp_path):
    inc, tl = correlate.investigated(spark, sf)
    inc, tl = inc.cache(), tl.cache()
    rows = report_rows.report_rows(inc, tl).collect()
    lines = {}
    for r in sorted(rows, key=lambda r: (r.incident_id, r.line_no)):
        lines.setdefault(r.incident_id, []).append(r)
    text = {r.incident_id: r.report for r in incidents.report_text(inc, tl).collect()}
    assert lines.keys() == text.keys() and len(text) > 5
    for key, found in lines.items():
        assert [r.line_no for r in found] == list(range(1, len(found) + 1))
        assert "\n".join(r.text for r in found) == text[key]
    one = next(iter(lines))
    told = spark.createDataFrame([(one, "MALICIOUS", 0.9, "Confirmed attack.\nTwo hosts.", ["lookup_ioc", "mitre_lookup"], 3, "Short.")],
                                 "incident_id string, verdict string, agent_confidence double, summary string, tools_used array<string>, steps int, "
                                 "incident_summary string")
    more = report_rows.report_rows(inc, tl, told.unionByName(spark.createDataFrame([(sorted(lines)[-1], "SUSPICIOUS")], "incident_id string, verdict string"),
                                                             allowMissingColumns=True))
    told_rows = sorted(((r.line_no, r.section, r.text) for r in more.where(F.col("incident_id") == one).collect()))
    assert [t for _, s, t in told_rows if s in ("agent", "summary")][1:] == [
        "AI AGENT INVESTIGATION", "-" * 70, "  Verdict:    MALICIOUS", "  Confidence: 90%", "  Tools used: lookup_ioc, mitre_lookup", "  ReAct steps: 3", "",
        "  Summary:", "    Confirmed attack.", "    Two hosts.", "", "-" * 70, "INCIDENT SUMMARY", "-" * 70, "  Short.", ""]
    assert [n for n, _, _ in told_rows] == list(range(1, len(told_rows) + 1))
    other = {r.text for r in more.where(F.col("incident_id") == sorted(lines)[-1]).collect()}
    assert {"  Verdict:    SUSPICIOUS", "  Confidence: 0%", "  Tools used: ", "  ReAct steps: 0"} <= other and "  Summary:" not in other
    report_rows.write_report_files(more, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == more.count()


# ---------------------------------------------------------------- importance and explanations
def scorer(rows):
    return rows.withColumn("p", F.col("a") * 0.5 + F.col("b") * 0.25).withColumn("pred", (F.col("p") > 0.4).cast("int"))


def test_importance_from_one_rank_table(spark):
    import hashlib

    rng = np.random.default_rng(3)
    x = rng.random((500, 3))
    y = (x[:, 0] * 0.5 + x[:, 1] * 0.25 > 0.4).astype(int)
    df = spark.createDataFrame([(i, int(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "k long, label int, a double, b double, c double")
    got = {r.feature: (r.mean_drop, r.std_drop) for r in models.importance(scorer, df, ["a", "b", "c"], "k").collect()}
    order = sorted(range(500), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest()[:13], i))
    for f in range(3):
        drops = []
        for r in range(3):
            z = x.copy()
            for at, i in enumerate(order):
                z[i, f] = x[order[(at * 1_000_003 + r * 7919 + 1) % 500], f]
            drops.append(1.0 - ((z[:, 0] * 0.5 + z[:, 1] * 0.25 > 0.4) == y).mean())
        assert got["abc"[f]] == pytest.approx((np.mean(drops), np.std(drops)))
    assert got["c"] == (0, 0) and got["a"][0] > got["b"][0] > 0


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_explanations_equal_numpy(spark, batch):
    names, samples = ["a", "b", "c"], 50
    df = spark.createDataFrame([(i, 0.1 * i, 0.2, float(i % 2)) for i in range(12)], "k long, a double, b double, c double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.k, r.feature): r.weight for r in models.local_explanation(scorer, df, names, "k", samples=samples, top=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    copies = df.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumns({f: F.when(F.col("_s") == 0, F.col(f)).otherwise(
        F.col(f) + (models.hash_unit(F.col("k"), F.col("_s"), F.lit(f), seed=3) - 0.5)) for f in names})
    for k, part in scorer(copies).toPandas().groupby("k"):
        x = part.sort_values("_s")[names].to_numpy()
        away = x - x[0]
        w = np.exp(-(away ** 2).sum(1) / (0.75 * np.sqrt(3)) ** 2)
        a = np.hstack([away, np.ones((samples, 1))])
        coef = np.linalg.solve(a.T @ (a * w[:, None]) + np.eye(4) * 1e-3, a.T @ (w * part.sort_values("_s")["p"].to_numpy()))
        assert [got[k, f] for f in names] == pytest.approx(coef[:3].tolist(), abs=1e-9)
    assert len(got) == 36


# ---------------------------------------------------------------- vector index
@pytest.mark.parametrize("metric", ["inner", "distance"])
def test_index_equals_brute_force(spark, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(vector_index, "PART_ROWS", 40)
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 3, (6, 8))
    x = middle[rng.integers(6, size=600)] + rng.normal(0, 0.4, (600, 8))
    x[100:250] = x[7]  # a third of a cell is one vector
    table = lambda ids: spark.createDataFrame([(int(i), x[i].tolist()) for i in ids], "vec_id long, embedding array<double>")
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"), metric=metric).build(table(range(400)).unionByName(
        spark.createDataFrame([(9999, None)], "vec_id long, embedding array<double>")), cells=12).append(table(range(400, 600)))
    asked = table(range(0, 600, 20)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    for itself in (True, False):
        found, read = index.search(asked, 7, itself=itself)
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        for q in range(0, 600, 20):
            score = x @ x[q] if metric == "inner" else -np.sqrt(((x - x[q]) ** 2).sum(1))
            best = [i for i in sorted(range(600), key=lambda i: (-round(score[i], 9), i)) if itself or i != q][:7]
            assert [i for _, i in sorted(got[q])] == best
        share = read.agg(F.sum("cells_read") / F.sum("cells")).first()[0]
        assert share < 0.6
    few = vector_index.VectorIndex(spark, str(tmp_path / "few")).build(table([1, 2]))
    assert few.search(asked.limit(1), 5)[0].count() == 2


def test_interpolation_fills_every_class(spark, tmp_path):
    rng = np.random.default_rng(6)
    label = [0] * 50 + [1] * 20 + [2] * 33 + [3]
    x = rng.normal(0, 1, (104, 4)) + np.array(label)[:, None] * 5
    df = spark.createDataFrame([(i, label[i], x[i].tolist()) for i in range(104)], "k long, label int, v array<double>")
    made = vector_index.interpolate(df, "k", "v", "label", str(tmp_path / "c")).collect()
    assert Counter(r.label for r in made) == {1: 30, 2: 17}
    assert len({(r.k, r.copy_no) for r in made}) == 47
    for r in made:
        own = np.array([x[i] for i in range(104) if label[i] == r.label and i != r.k])
        near = own[np.argsort(((own - x[r.k]) ** 2).sum(1))[:5]]
        way, new = near - x[r.k], np.array(r.v) - x[r.k]
        t = (way @ new) / (way ** 2).sum(1)
        assert (np.abs(way * t[:, None] - new).max(1) < 1e-9).any()


# ---------------------------------------------------------------- incremental source
def test_incremental_source_reads_on(spark, tmp_path):
    base, check, out = (str(tmp_path / n) for n in ("s", "c", "o"))
    rows = lambda *r: spark.createDataFrame([(c, n, f"{c}{n}") for c, lo, hi in r for n in range(lo, hi + 1)], incremental.SCHEMA)

    def run():
        incremental.record_stream(spark, base).writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(
            lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch_id={n}")).start().awaitTermination()
        return sorted((r.channel, r.record_no, r.body) for r in spark.read.schema(incremental.SCHEMA).parquet(out).collect())

    whole = lambda *r: sorted((c, n, f"{c}{n}") for c, lo, hi in r for n in range(lo, hi + 1))
    incremental.write_segments(rows(("a b/c", 1, 25), ("z", 1, 3)), base, per_segment=10)
    assert run() == whole(("a b/c", 1, 25), ("z", 1, 3))
    assert run() == whole(("a b/c", 1, 25), ("z", 1, 3))
    incremental.write_segments(rows(("a b/c", 26, 31), ("new", 1, 12)), base, per_segment=10)
    assert run() == whole(("a b/c", 1, 31), ("z", 1, 3), ("new", 1, 12))


# ---------------------------------------------------------------- working tables
def test_working_tables_go_with_their_scope(spark):
    with session.working_tables(spark) as outer:
        with session.working_tables(spark) as keep:
            gone, stays = session.materialise(spark.range(3)), keep(session.materialise(spark.range(4)))
        assert not os.path.exists(gone.table_path) and stays.count() == 4
        last = outer(session.materialise(stays))
    assert not os.path.exists(stays.table_path) and last.count() == 4
    with pytest.raises(ValueError), session.working_tables(spark):
        lost = session.materialise(spark.range(2))
        raise ValueError
    assert not os.path.exists(lost.table_path)
