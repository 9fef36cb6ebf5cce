"""Chunked running totals, ranks, quantiles, splits and windows against plain loops."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import datasets, drift, evaluate, knowledge
from tidewatch.operators.ordered import exact_quantiles, global_rank, hash_unit


@pytest.fixture(scope="module")
def values(spark):
    rnd = random.Random(5)
    # one group holds most rows and most of those share one value
    rows = [(i, "hot" if i % 10 else "cold", 1.0 if rnd.random() < 0.4 else round(rnd.random() * 9, 3)) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "id int, g string, v double").repartition(6)


def test_quantiles_match_numpy(values):
    rows, df = values
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in ("hot", "cold"):
        assert got[g] == pytest.approx(list(np.quantile([v for _, h, v in rows if h == g], probs)))


def test_global_rank_is_a_permutation(values):
    _, df = values
    out = global_rank(df.withColumn("u", hash_unit(F.col("id"))), ["g"], "u", "id").groupBy("g").agg(
        F.count_distinct("rank").alias("d"), F.max("rank").alias("m"), F.max("total").alias("t")).collect()
    assert all(r.d == r.m == r.t for r in out)


def psi_loop(e, a, bins=10):
    edges = np.unique(np.percentile(e, np.linspace(0, 100, bins + 1)))
    if len(edges) < 2:
        return 0.0
    x, y = (np.clip(np.histogram(s, bins=edges)[0] / (len(s) + 1e-10), 1e-10, None) for s in (e, a))
    return float(np.sum((y - x) * np.log(y / x)))


def test_psi_matches_histogram(spark):
    rnd = np.random.RandomState(1)
    for e, a in [(rnd.rand(500), rnd.rand(300) * 1.5), (np.ones(50), rnd.rand(40)), (np.r_[np.zeros(400), rnd.rand(100)], rnd.rand(200))]:
        b, c = (spark.createDataFrame([(float(x),) for x in s], "v double") for s in (e, a))
        assert drift.psi(b, c, [], "v").first().psi == pytest.approx(psi_loop(e, a), abs=1e-9)


def test_page_hinkley_matches_loop(spark):
    rnd = random.Random(2)
    xs = [rnd.random() * 0.2 for _ in range(300)] + [0.8 + rnd.random() * 0.1 for _ in range(300)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "k string, i int, x double")
    got = [r.ph for r in drift.page_hinkley(df, "k", ["i"], "x", F.floor(F.col("i") / 37), lam=5).orderBy("i").collect()]
    n = mean = total = 0
    low = float("inf")
    want = []
    for x in xs:
        n += 1
        mean += (x - mean) / n
        total += x - mean - drift.DELTA
        low = min(low, total)
        want.append(total - low)
    assert got == pytest.approx(want, abs=1e-8)


def test_drift_check_levels(spark):
    calm = spark.range(400).select((F.col("id") % 20 / 20.0).alias("f"), (F.col("id") % 10 / 10.0).alias("s"))
    shifted = calm.withColumn("f", F.lit(0.97))
    assert drift.check(calm, calm, ["f"], "s").first().drift_level == "none"
    row = drift.check(calm, shifted, ["f"], "s").first()
    assert row.drift_level == "CRITICAL" and "f(PSI=" in row.alarms[0]
    assert drift.check(calm, shifted.limit(10), ["f"], "s").first().drift_level == "none"


def test_auc_matches_pairs(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = statistics.mean(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    assert evaluate.roc_auc(df, "y", "p").first().roc_auc == pytest.approx(want)


def test_chunker_progress_and_overlap(spark):
    text = "Heading 12\n\n" + "x" * 1000
    spans = knowledge.cut_points(text)
    assert all(b[0] > a[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] >= len(text)
    df = spark.createDataFrame([(1, "One. " * 300, "s"), (2, "", "s")], "doc_id int, text string, source string")
    chunks = knowledge.chunk_documents(df).collect()
    assert {c.doc_id for c in chunks} == {1} and chunks[0].chunk.endswith(".") and len(chunks[0].chunk) <= 512


def test_vector_search_matches_numpy(spark):
    rnd = np.random.RandomState(4)
    m = rnd.rand(60, 8)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id int, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in range(3)], "query_id int, query_vector array<double>")
    for r in knowledge.vector_top_k(corpus, queries, k=4).collect():
        order = sorted(range(60), key=lambda j: (-float(m[j] @ m[r.query_id]), j))
        assert order[r["rank"] - 1] == r.vec_id


def test_context_packing_cuts_the_last_entry(spark):
    rows = [(1, 1, 0.9, "a", "", "x" * 300), (1, 2, 0.8, "b", "T", "y" * 400)]
    df = spark.createDataFrame(rows, "query_id int, rank int, score double, source string, title string, text string")
    text = knowledge.pack_context(df, max_chars=600).first().context
    assert text.startswith("[1] (score=0.9, source=a)") and text.endswith("...") and "Title: T" in text


def test_interpolated_vectors_lie_between_parents(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(300)], "id int, v array<double>")
    out = datasets.interpolate_minority(df, "id", "v").collect()
    assert len(out) == 300 and all(0 <= r.v[0] <= 6 and 0 <= r.v[1] <= 2 for r in out)


def test_scenarios_keep_base_and_bound_noise(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 2).cast("double").alias("f"), (F.col("id") % 2).alias("label"))
    out = datasets.scenarios(df, ["f"], "k", noise=(0.5,), erased=["f"])
    got = {r.scenario: (r.lo, r.hi) for r in out.groupBy("scenario").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).collect()}
    assert got["base"] == (0.0, 1.0) and got["erased"] == (0.0, 0.0) and 0 <= got["noise_0.50"][0] <= got["noise_0.50"][1] <= 1
