"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its words. For each of SLOTS slots, every weighted word draws gamma and uniform numbers from a hash
of word and slot, and the word with the smallest sample, together with its quantised weight, is the slot's value. Two
fingerprints agree in a slot with a probability equal to the generalised Jaccard similarity (sum of smaller weights over sum of
larger ones) of the multisets. A slot is written as 16 bits in hex; unequal samples share them once in 65,536 times.

Null, repeated and odd input: a null text is an empty one; a text without words has an empty fingerprint, which is like another
empty one (1.0) and unlike all others (0.0); repeated rows and ties in doc_id are kept, ordered by text; a row with a null
doc_id is in no order, so its edited and next columns are null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, mix64, parts_for, range_bounds, range_of, slices, word_hashes, words_of

SLOTS = 64
#: Word and weight pairs sampled at once; bounds the memory of the sampler.
CHUNK = 8192


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0 ** -24)


def samples(words: np.ndarray, weights: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of each weighted word's sample, and its quantised weight, per slot."""
    seeds = mix64(np.arange(1, 2 * slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, slots)
    log_a, level = np.empty((len(words), slots), np.float32), np.empty((len(words), slots), np.int32)
    for at in range(0, len(words), CHUNK):
        h, log_w = words[at:at + CHUNK, None], np.log(weights[at:at + CHUNK, None].astype(np.float32))
        one, two = mix64(h ^ seeds[0]), mix64(h + seeds[1])
        r = -np.log(_uniform(one) * _uniform(one >> np.uint64(24)))  # gamma of shape 2
        c = -np.log(_uniform(two) * _uniform(two >> np.uint64(24)))
        beta = _uniform(mix64(one ^ two) >> np.uint64(20))
        t = np.floor(log_w / r + beta)
        log_a[at:at + CHUNK] = np.log(c) - r * (t - beta) - r
        level[at:at + CHUNK] = t
    return log_a, level


def signatures(texts: list[str], slots: int = SLOTS) -> np.ndarray:
    """A row of 16-bit slot values per text; the second result says which texts have words."""
    known = word_hashes()
    words, counts, sizes = [], [], []
    for text in texts:
        w, n = np.unique(known.of(words_of(text)), return_counts=True)
        words.append(w)
        counts.append(n)
        sizes.append(len(w))
    out, full = np.zeros((len(texts), slots), np.uint16), np.array(sizes) > 0
    if not full.any():
        return out, full
    word, count = np.concatenate(words), np.concatenate(counts)
    pair, first, where = np.unique(mix64(word) + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93),
                                   return_index=True, return_inverse=True)
    log_a, level = samples(word[first], count[first], slots)
    ends, column = np.cumsum(sizes), np.arange(slots)
    for i in np.flatnonzero(full).tolist():
        rows = where[ends[i] - sizes[i]:ends[i]]
        best = rows[np.argmin(log_a[rows], axis=0)]
        out[i] = mix64(word[first[best]] + level[best, column].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)
    return out, full


def _likeness(a: np.ndarray, a_full: bool, b: np.ndarray, b_full: bool) -> float:
    return float((a == b).mean()) if a_full and b_full else float(a_full == b_full)


def _hex(row: np.ndarray, full: bool) -> str:
    return row.astype(">u2").tobytes().hex() if full else ""


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(slots: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, whose next row is not known yet

        def finish(rows: list[tuple], after: list[tuple]) -> pa.RecordBatch:
            """rows: bucket, doc_id, text; after: the row behind each, of the same bucket, or None."""
            texts = [r[2] for r in rows]
            edited = [None if n is None else t[:len(t) - len(t) // 4] + n[2][:len(t) // 4] for t, n in zip(texts, after, strict=True)]
            nexts = [n and n[2] for n in after]
            unique = list(dict.fromkeys(x for x in [*texts, *edited, *nexts] if x is not None))
            at = {x: i for i, x in enumerate(unique)}
            sig, full = signatures(unique, slots)
            out = []
            for (_, doc, text), e, n in zip(rows, edited, nexts, strict=True):
                i = at[text]
                mine = _hex(sig[i], full[i])
                if e is None:
                    out.append((doc, len(text), None, mine, None, None, None))
                    continue
                j, k = at[e], at[n]
                out.append((doc, len(text), hashlib.sha256(e.encode()).hexdigest(), mine, _hex(sig[j], full[j]),
                            _likeness(sig[i], full[i], sig[j], full[j]), _likeness(sig[i], full[i], sig[k], full[k])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)],
                                              [x.split()[0] for x in OUT.split(", ")])

        for b in slices(batches, "text", 2 << 20):
            rows, after = [], []
            for row in zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(),
                           b.column("guard").to_pylist(), strict=True):
                if held is not None and not held[3]:
                    rows.append(held[:3])
                    same = held[0] == row[0] and held[1] is not None
                    after.append(row if same else None)
                held = row
            if rows:
                yield finish(rows, after)
        if held is not None and not held[3]:
            yield finish([held[:3]], [None])

    return run


def fingerprint_pairs(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document in doc_id order.

    Texts are shuffled once, to ranges of doc_id. A range ends with a guard: the first row of the range that follows (of the
    first range behind the last), so no row needs one outside its task.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = parts_for(docs.sparkSession, docs.count(), 50_000)
    bounds = range_bounds(plain, wanted)
    placed = plain.select(range_of(F.col("doc_id"), bounds).cast("int").alias("bucket"), "doc_id", "text", F.lit(False).alias("guard"))
    n = max(1, len(bounds))
    firsts = plain.where(F.col("doc_id").isin(bounds)).groupBy("doc_id").agg(F.min("text").alias("text"))
    guards = firsts.select(F.pmod(range_of(F.col("doc_id"), bounds) - 1, F.lit(n)).cast("int").alias("bucket"), "doc_id", "text",
                           F.lit(True).alias("guard"))
    rows = placed.unionByName(guards).repartitionById(n, "bucket").sortWithinPartitions("bucket", "guard", "doc_id", "text")
    return rows.mapInArrow(_compare(slots), OUT)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(documents(spark, sf_dir))
