"""BPE by speculation, centroid clustering and spelling variants against plain versions, on odd rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tidewatch.llm import bpe, centroids, common, spelling

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# --- BPE

def library(texts, name="word_bpe_49k.json", plain=False):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = plain
    ids = [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return ids, [tokenizer.decode(i, skip_special_tokens=False) for i in ids]


def odd_texts():
    rng = random.Random(11)
    letters = "abcdefghij klmnop 'sre\n\t\x0b0123 éß́漢字İΣς<|>/w-_=!    😀𝒳"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(3000)]
    vocabulary = [t.replace("</w>", "") for t in Tokenizer.from_file(WORD_BPE).get_vocab() if t.isascii()]
    texts += [" ".join("".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(4)) for _ in range(3000)]
    return texts + [None, "", " ", "<|endoftext|>", "a<|endoftext|>'s b<|startoftext|><|endoftext|>.", "</w> x</w>", "<|endoftext|",
                    "a" * 3000, "ab" * 3001, "longword" * 20_000, "Hello, World!"]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_the_library(spark, plain):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.decode(bpe.encode(rows, WORD_BPE, not plain), WORD_BPE).collect()}
    ids, back = library(texts, plain=plain)
    assert [got[i][0] for i in range(len(texts))] == ids
    assert [got[i][1] for i in range(len(texts))] == back


def test_round_trip_rows(odd, nothing, plain_rows):
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode(odd, WORD_BPE).collect())
    assert got == Counter((d, tuple(i)) for (d, _), i in zip(plain_rows, library([t for _, t in plain_rows])[0], strict=True))
    assert bpe.decode(bpe.encode(nothing, WORD_BPE), WORD_BPE).collect() == []
    both = bpe.decode(bpe.encode(odd, WORD_BPE), WORD_BPE)
    assert sorted(map(repr, bpe.round_trip(odd, WORD_BPE).collect())) == sorted(map(repr, both.collect()))


def test_query_digests(spark, tmp_path, odd, plain_rows):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    ids, back = library([t for _, t in plain_rows])
    want = sorted(((d, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest())
                   for (d, _), i, b in zip(plain_rows, ids, back, strict=True)), key=repr)
    assert sorted(map(tuple, bpe.op11(spark, str(tmp_path)).collect()), key=repr) == want


def test_unknown_ids_are_skipped():
    assert bpe.token_names(WORD_BPE).decode(pa.array([[320, 10**6, -1, 320], [], None], pa.list_(pa.int32()))).to_pylist() == ["a</w> a</w>", "", ""]


def test_border_test_equals_merging_and_long_merge_equals_short():
    table = bpe.encoder(WORD_BPE).table
    rng = random.Random(2)
    inside, last = sorted(table.inside), sorted(table.at_end)
    words = [(rng.choice(inside), rng.choice(last)) for _ in range(4000)]
    a, b = (np.array(c) for c in zip(*[(table.inside[x], table.at_end[y]) for x, y in words], strict=True))
    exact = [table.merge(x + y) == [i, j] for (x, y), i, j in zip(words, a.tolist(), b.tolist(), strict=True)]
    assert table.compatible(a, b).tolist() == exact and 0 < sum(exact) < len(exact)
    for _ in range(2000):
        ids = [table.inner[c] for c in rng.choices("abeinorst", k=rng.randint(1, 60))] + [table.last["e"]]
        assert table._merge_short(list(ids)) == table._merge_long(list(ids))


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 50)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    coder, rng = bpe.SpeculativeEncoder(WORD_BPE, True), random.Random(1)
    for _ in range(20):
        texts = [prose(rng, "en", 10) for _ in range(3)]
        begins, ids = coder.encode(pa.array(texts))
        assert [ids[x:y].tolist() for x, y in zip(begins, begins[1:], strict=False)] == library(texts)[0]
        assert len(coder.chunks) <= 50 and len(coder.words) <= 50


# --- centroids

def plain_clusters(rows, k=8, rounds=10, m=64):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == m and all(v is not None and np.isfinite(v) for v in x):
            kept.append((vec_id, [int(np.floor(1024 * float(v))) for v in x]))
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in order[:k]]
    x = np.array([x for _, x in kept], object)

    def assign():
        d = np.stack([((x - np.array(y, object)) ** 2).sum(1) for y in c], 1).astype(np.int64)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        a, _ = assign()
        c = [[int(s) // int((a == j).sum()) for s in x[a == j].sum(0)] if (a == j).any() else y for j, y in enumerate(c)]
    a, d = assign()
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((v, int(j), int(e), int(d[a == j].sum()), int(d.sum()), sha[j]) for (v, _), j, e in zip(kept, a, d, strict=True)), key=repr)


def vectors(n, m=64, seed=4, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (12, m))
    return [(i, [float(v) for v in np.float32(middle[rng.integers(12)] + spread * rng.normal(0, 1, m))]) for i in range(n)]


def odd_vectors():
    rows = vectors(400)
    rows += [(500 + i, rows[3][1]) for i in range(120)] + [rows[5], rows[5]]  # ties and repeated rows
    bad = list(rows[0][1])
    return rows + [(900, None), (901, []), (902, bad[:63]), (903, bad + [0.0]), (904, [None, *bad[1:]]), (905, [float("nan"), *bad[1:]]),
                   (906, [float("inf"), *bad[1:]]), (907, [float("-inf"), *bad[1:]]), (None, rows[7][1]), (None, None), (908, [0.0] * 64)]


def as_table(spark, rows):
    return spark.createDataFrame([(*r, i, 0.5, "x") for i, r in enumerate(rows)],
                                 "vec_id long, embedding array<float>, cluster int, upper double, moved string").repartition(4)


@pytest.mark.parametrize("rows", [odd_vectors(), vectors(5), vectors(300, seed=9, spread=4.0), [(1, None)], []],
                         ids=["odd", "few", "mixed", "none kept", "empty"])
def test_clusters_equal_plain_rounds(spark, rows):
    got = centroids.clustered(as_table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows)


def test_bounds_hold_and_skip(monkeypatch):
    """Every bound is on its side of the exact distance in every round, and most vectors of a late round are not rescanned."""
    rng = np.random.default_rng(0)
    middle = rng.integers(-900, 900, (8, 16))
    x = (middle[rng.integers(8, size=3000)] + rng.integers(-120, 120, (3000, 16))).astype(np.int32)
    history = x[:8][None].astype(np.int64)
    n = len(x)
    state = {"cluster": np.full(n, -1, np.int32), "upper": np.zeros(n), "lower": np.zeros(n),
             "upper_at": np.zeros(n, np.int32), "lower_at": np.zeros(n, np.int32)}
    scanned = []
    whole = centroids.squared_distances
    monkeypatch.setattr(centroids, "squared_distances", lambda a, c: scanned.append(len(a)) or whole(a, c))
    for _ in range(10):
        scanned.append(0)
        since = centroids.Displacements(history)
        centroids.evaluate(x, state, history, since, False)
        d = np.sqrt(whole(x, history[-1]).astype(float))
        own = d[np.arange(n), state["cluster"]]
        assert (own <= d.min(1) + 1e-9).all()
        assert (own <= state["upper"] + since.own(state["cluster"], state["upper_at"]) + 1e-6).all()
        d[np.arange(n), state["cluster"]] = np.inf
        assert (d.min(1) >= state["lower"] - since.others(state["cluster"], state["lower_at"]) - 1e-6).all()
        history = np.concatenate([history, [[x[state["cluster"] == j].astype(np.int64).sum(0) // (state["cluster"] == j).sum()
                                             for j in range(8)]]])
    assert max(scanned) == n and scanned[-1] < n / 2


def test_displacement_is_tighter_than_summed_drifts():
    there, back = np.zeros((2, 4), np.int64), np.full((2, 4), 5)
    assert centroids.Displacements(np.stack([there, back, there])).norm[0].tolist() == [0, 0]


def test_large_components(spark):
    rows = [(i, [float(np.float32(v * 2000.25)) for v in x]) for i, x in vectors(60)]
    assert sorted(map(tuple, centroids.clustered(as_table(spark, rows)).collect()), key=repr) == plain_clusters(rows)
    with pytest.raises(Exception, match="component out of range"):
        centroids.clustered(as_table(spark, [(1, [1e9] * 64)])).collect()


def test_cluster_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = centroids.op12(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(centroids.op12_sql()).fetchall(), key=repr)


# --- spelling

def plain_variants(rows, least=7, least_count=2, every=31, ratio=10):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    beside = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and near(w, v)] for w in n}
    form = {}
    for w, vs in beside.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(beside[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def spelled():
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdeéÀ×", k=rng.randint(6, 10))) for _ in range(60)]
    words = list(base)
    for w in base:
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcdeé") + w[i:], w[:i] + rng.choice("abcdeé") + w[i + 1:]]))
    texts = [" ".join(rng.choices(words, [40 if i < 60 else 1 for i in range(len(words))], k=rng.randint(0, 300))) for _ in range(60)]
    chain = ["aaaaaaaa"] * 400 + ["aaaaaaab"] * 30 + ["aaaaaabb"] * 3 + ["aaaaabbb"] * 2
    texts += [" ".join(chain), "SOMEWORD Someword somewordÀ 1someword2", "longword" * 3000 + " " + "longword" * 3000 + "x " + "longword" * 3000 + "x"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (7, texts[7]), (99, "")]


def spelled_table(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "doc_id long, text string, word string, n long, form_n int").repartition(5)


@pytest.mark.parametrize("classes", [(4, 6), (2,), (6, 8, 10)])
def test_variants_equal_brute_force(spark, monkeypatch, classes):
    monkeypatch.setattr(spelling, "CLASSES", classes)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 20)
    rows = spelled()
    got = spelling.variants(spelling.word_counts(spelled_table(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(rows)


def test_variants_of_the_documents(spark, odd, plain_rows, nothing):
    got = spelling.variants(spelling.word_counts(odd))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(plain_rows)
    assert spelling.variants(spelling.word_counts(nothing)).collect() == []


def test_small_pieces_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 30)
    monkeypatch.setattr(spelling, "ROWS", 5)
    rows = spelled()[:30]
    words = spelling.word_counts(spelled_table(spark, rows), least_length=4)
    pairs = {tuple(sorted((r.word, r.near))) for r in spelling.near_words(words).collect()}
    want = {tuple(sorted((w, v))) for w, v in near_by_deletion([r.word for r in words.collect()])}
    assert pairs == want


def near_by_deletion(words):
    """Pairs one edit apart, found by shared deletions."""
    for i, a in enumerate(words):
        holes = {a[:k] + "\0" + a[k + 1:] for k in range(len(a))}
        less = {a[:k] + a[k + 1:] for k in range(len(a))}
        for b in words[i + 1:]:
            if (len(a) == len(b) and holes & {b[:k] + "\0" + b[k + 1:] for k in range(len(b))}) or b in less \
                    or a in {b[:k] + b[k + 1:] for k in range(len(b))}:
                yield a, b


def test_steps_are_unambiguous():
    for classes in spelling.CLASSES:
        spelling._steps(classes)


def test_slices_of_lists():
    lists = pa.RecordBatch.from_arrays([pa.array([[1] * 100, [], None, [2] * 900, [3]], pa.list_(pa.int32()))], ["ids"])
    assert sum(b.num_rows for b in common.slices([lists], "ids", 1000)) == 5

