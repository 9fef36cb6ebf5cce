"""Best-fit packing by patterns: few-document length patterns, fitted to the length histogram by non-negative least squares.

The histogram has at most `capacity` rows whatever the corpus holds, so patterns, fit, rounding and the packing of residuals
run on the driver in bounded time. The places are then dealt out by Spark: each piece gets its rank among the pieces of its
length, and a rank falls into one slot of one pattern.

Null, repeated and odd input: a null or empty text is the end id alone, one token; a null doc_id stays null; repeated rows are
packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import chunk_encoder, documents, slices
from tidewatch.session import materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = chunk_encoder(tokenizer, True), np.array([end_id], "<u4").tobytes()
        for b in slices(batches, "text"):
            out = []
            for doc, got in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text")), strict=True):
                ids = got + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The token pieces of all documents: one each, or runs of `capacity` tokens of a longer one."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_pieces(tokenizer, end_id, capacity), PIECES)


def candidate_patterns(hist: np.ndarray, choices: int = 3) -> list[tuple[int, ...]]:
    """Length patterns of one to three documents that fill a sequence exactly, longest first.

    For each long piece: its complement, and `choices` ways to split the complement into the most frequent lengths.
    """
    capacity = len(hist) - 1
    found = {(capacity,)} if hist[capacity] else set()
    for a in np.flatnonzero(hist).tolist():
        rest = capacity - a
        if rest <= 0 or a < capacity / 3:
            continue
        if rest <= a and hist[rest]:
            found.add((a, rest))
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        c = rest - b
        both = np.minimum(hist[b], hist[c]) if len(b) else np.empty(0)
        for k in np.argsort(-both, kind="stable")[:choices].tolist():
            if both[k] > 0:
                found.add((a, int(b[k]), int(c[k])))
    return sorted(found, reverse=True)


def fit_counts(hist: np.ndarray, patterns: list[tuple[int, ...]], steps: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram, by accelerated projected gradient."""
    if not patterns:
        return np.empty(0)
    rows = np.concatenate([np.array(p) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    target, n = hist.astype(float), len(patterns)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, x[cols], len(hist))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(cols, r[rows], n)

    v = np.ones(n)
    for _ in range(20):  # largest eigenvalue, for the step
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def best_fit(rest: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram of lengths, as patterns with repeat counts: equal sequences are packed at once."""
    capacity, rest, out = len(rest) - 1, rest.copy(), []
    present = sorted(np.flatnonzero(rest).tolist())
    import bisect

    while present:
        used: dict[int, int] = defaultdict(int)
        pattern, room = [], capacity
        while (k := bisect.bisect_right(present, room)) > 0:
            while k > 0 and rest[present[k - 1]] - used[present[k - 1]] <= 0:
                k -= 1
            if k <= 0:
                break
            length = present[k - 1]
            pattern.append(length)
            used[length] += 1
            room -= length
        times = min(int(rest[x]) // n for x, n in used.items() if n)
        out.append((tuple(pattern), times))
        for x, n in used.items():
            rest[x] -= n * times
            if n and rest[x] == 0:
                present.remove(x)
    return out


def pattern_plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often to use each, together holding every piece of the histogram once."""
    patterns, rest, plan = candidate_patterns(hist), hist.astype(np.int64).copy(), []
    counts = np.floor(fit_counts(hist, patterns) + 1e-6).astype(np.int64)
    for k in np.argsort(-counts, kind="stable").tolist():
        if counts[k] <= 0:
            break
        need: dict[int, int] = defaultdict(int)
        for x in patterns[k]:
            need[x] += 1
        times = min(int(counts[k]), *(int(rest[x]) // n for x, n in need.items()))
        if times > 0:
            plan.append((patterns[k], times))
            for x, n in need.items():
                rest[x] -= n * times
    return plan + best_fit(rest)


def _slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: where each slot's ranks begin, its first sequence, and its offset in the sequence."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    begin: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            found[length].append((begin[length], sequence, offset))
            begin[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c) for c in zip(*v, strict=True)) for k, v in found.items()}


def _place(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(length[order])) + 1).tolist(), len(order)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    at = order[lo:hi]
                    begin, first, off = slots[int(length[at[0]])]
                    k = np.searchsorted(begin, rank[at], "right") - 1
                    sequence[at], offset[at] = first[k] + rank[at] - begin[k], off[k]
            keep = b.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence), pa.array(offset)],
                                             [*keep.schema.names, "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, capacity: int = 2048, rows_per_cell: int = 200_000) -> DataFrame:
    """Place each piece (any table of PIECES whose lengths are 1 to capacity) in a sequence.

    A length that a third of all pieces have is ranked in cells of bounded size: counts per cell give each cell its base.
    """
    hist_rows = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    hist = np.zeros(capacity + 1, np.int64)
    for r in hist_rows:
        hist[r.length] = r.n
    slots = _slots(pattern_plan(hist), capacity)
    cells = int(hist.sum()) // rows_per_cell + 1
    celled = parts.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    counts = celled.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = celled.withColumn("row", F.row_number().over(within)).join(bases, ["length", "cell"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row") - 1).alias("rank"))
    return ranked.mapInArrow(_place(slots), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut, count and pack the documents. The pieces are written once (a few numbers each), so texts are encoded once."""
    return pack(materialise(pieces(docs, tokenizer, capacity, end_id)), capacity)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
