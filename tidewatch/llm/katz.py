"""Language-model scoring: a Katz backoff model of words, Good-Turing discounted and exactly normalised.

The classes are the training words, the end of a text and one class for everything unknown. A bigram seen at least CUT times has
its discounted relative frequency; any other falls back to alpha(context) times the unigram probability, and an unknown word to
the mass that discounting left over. alpha is the context's remaining mass over the unigram mass of the words that were not
kept, so each context's probabilities add up to one.

The corpus goes through one shuffle. A task packs the pairs (context, word, document) of a slice of documents into rows per
shard; contexts are dealt to shards by hash, and those that hold a large share of all pairs (found on a sample, which decides
placement alone) by context and word, so that no word is a task of its own. The shards are read twice, first to count, then to
count again and score, and Spark keeps their shuffle files in between: bigrams are never written. What a shard lacks are the counts
of its second words. It sends its distinct words, packed, to parts dealt by word, where they meet the counts of the contexts, and
finds the answers in a file of its own in the shared folder. The sums of the heavy contexts are made shard by shard in between. A
document's score is the sum of what its shards add. Nothing is sent to all tasks but a few numbers and the heavy contexts, at most
two per shard.

Words are told apart by 48 bits of a hash. Null, repeated and odd input: a null or empty text is its end alone; a null doc_id
trains or not by the caller's rule (null counts as training); repeated rows count and are scored each; without training
documents every token is unknown with probability one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tidewatch.llm.common import crc_mod, documents, file_system, mix64, parts_for, slices, word_hashes, words_of
from tidewatch.session import materialise, shared_dir

#: Pairs in a shard; documents of a slice; counts above KEPT are not discounted; bigrams below CUT are not kept (1: all are).
SHARD, SLICE, KEPT, CUT = 2_000_000, 8 << 20, 5, 1
START, END = np.uint64(1), np.uint64(2)
STEP = np.uint64(0x9E3779B97F4A7C15)
STREAM = "shard int, kind int, batch long, docs int, sizes array<int>, trains binary, payload binary"
#: Kinds of COUNTS: context counts and distinct words of a shard by part; heavy pairs and statistics of a shard; totals of a part.
COUNTS = "kind int, part int, shard int, a binary, b binary, stats array<long>"
CONTEXTS, WORDS, HEAVY, TOTALS = range(4)


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * STEP + w)


def _shard(v: np.ndarray, w: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    spread = np.isin(v, heavy)
    return (mix64(np.where(spread, _pair(v, w), v)) % np.uint64(shards)).astype(np.int64)


def _bytes_apart(x: np.ndarray) -> bytes:
    """The low bytes of all values, then the next, and so on; compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _bytes_together(raw: np.ndarray, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).ravel() if n else np.empty(0, kind)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _pack(v: np.ndarray, w: np.ndarray, doc: np.ndarray) -> tuple[list[int], bytes]:
    """Pairs sorted by context and document: contexts, their pair counts, distinct words, word numbers, document steps."""
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    words, number = np.unique(w, return_inverse=True)
    number = number.astype("<u2" if len(words) <= 1 << 16 else "<u4")
    steps = np.diff(doc, prepend=np.uint16(0)).astype("<u2")
    raw = b"".join((v[first].tobytes(), np.diff(np.append(first, len(v))).astype("<u4").tobytes(), words.tobytes(),
                    _bytes_apart(number), _bytes_apart(steps)))
    return [len(first), len(words), len(v), len(raw)], _codec().compress(raw, asbytes=True)


def _unpack(sizes: list[int], payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts, their pair counts, and the word and document of each pair."""
    n_v, n_w, n, whole = sizes
    raw = np.frombuffer(_codec().decompress(payload, whole, asbytes=True), np.uint8)
    at = np.cumsum([0, 8 * n_v, 4 * n_v, 8 * n_w])
    kind = "<u2" if n_w <= 1 << 16 else "<u4"
    v, counts, words = raw[:at[1]].view(np.uint64), raw[at[1]:at[2]].view("<u4"), raw[at[2]:at[3]].view(np.uint64)
    cut = at[3] + n * np.dtype(kind).itemsize
    number = _bytes_together(raw[at[3]:cut], kind, n)
    doc = np.cumsum(_bytes_together(raw[cut:], "<u2", n), dtype=np.uint16)
    return v, counts, words[number], doc


def _squeeze(x: np.ndarray) -> bytes:
    """64-bit integers, compressed, with their number in front."""
    return len(x).to_bytes(4, "little") + _codec().compress(_bytes_apart(x) if len(x) else b"", asbytes=True)


def _loosen(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    return _bytes_together(np.frombuffer(_codec().decompress(packed[4:], 8 * n, asbytes=True) if n else b"", np.uint8), "<i8", n)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _stream(shards: int, heavy: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, known = TaskContext.get().partitionId() << 32, word_hashes()
        for whole in slices(batches, "text", SLICE):
            for at in range(0, whole.num_rows, 60_000):
                b = whole.slice(at, 60_000)
                words = [known.of(words_of(t)) >> np.uint64(16) for t in b.column("text").to_pylist()]
                sizes = np.array([len(x) for x in words], np.int64)
                held = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                trains = np.packbits(~held).tobytes()
                ids = b.column("doc_id")
                meta = (ids.fill_null(0).to_numpy().astype("<i8").tobytes() + sizes.astype("<i8").tobytes()
                        + ids.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes())
                rows = [(int(batch % shards), 1, batch, len(words), [], trains, meta)]
                v = np.concatenate([x for w in words for x in ([START], w)]).astype(np.uint64)
                w = np.concatenate([x for w in words for x in (w, [END])]).astype(np.uint64)
                doc = np.repeat(np.arange(len(words), dtype=np.uint16), sizes + 1)
                shard = _shard(v, w, heavy, shards)
                order = np.lexsort((v, shard))
                shard, v, w, doc = shard[order], v[order], w[order], doc[order]
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    sizes_, payload = _pack(v[lo:hi], w[lo:hi], doc[lo:hi])
                    rows.append((int(shard[lo]), 0, batch, len(words), sizes_, trains, payload))
                batch += 1
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 [x.split()[0] for x in STREAM.split(", ")])
        known.clear()  # the worker lives on beside those of the next stages

    return run


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows (key, ..., count) with equal keys made one, counts added."""
    key, *rest, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.empty(0, np.int64)
    total = np.add.reduceat(count[order], first) if len(key) else count
    return key[order][first], *(x[order][first] for x in rest), total


def _counted(rows: Iterable) -> tuple[np.ndarray, ...]:
    """Of one shard's training texts: contexts and counts; keys, contexts, words and counts of bigrams seen CUT times or more; how
    many bigrams have each small count."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    pairs, singles, held = [(none[0], *none[:1] * 2, none[1])], [none], 0
    for r in rows:
        v, n, w, doc = _unpack(r.sizes, r.payload)
        train = np.unpackbits(np.frombuffer(r.trains, np.uint8), count=r.docs).astype(bool)[doc]
        v = np.repeat(v, n)[train]
        w = w[train]
        ones = np.ones(len(v), np.int64)
        singles.append(_merge([(v, ones)]))
        pairs.append(_merge([(_pair(v, w), v, w, ones)]))
        held += len(pairs[-1][0])
        del r, v, w, n, doc, train, ones  # the next row is unpickled before this one's arrays would go
        if held > SHARD // 8:
            pairs, singles = [_merge(pairs)], [_merge(singles)]
            held = len(pairs[0][0])
    pairs, singles = _merge(pairs), _merge(singles)
    seen = np.bincount(np.minimum(pairs[-1], KEPT + 2), minlength=KEPT + 3)[1:KEPT + 2]
    if CUT > 1:
        pairs = tuple(x[pairs[-1] >= CUT] for x in pairs)
    return *singles, *pairs, seen


def _dealt(words: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of distinct words by part and value, and (part, from, to) of the parts that have any."""
    part = (mix64(words) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((words, part))
    part = part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return order, [(int(part[lo]), lo, hi) for lo, hi in itertools.pairwise(cuts) if hi > lo]


def _listed(w: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Distinct words in the order of `_dealt`, its parts, and the place of each word in that list."""
    words, number = np.unique(w, return_inverse=True)
    order, dealt = _dealt(words, parts)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return words[order], dealt, place[number]


def _count(parts: int, heavy: np.ndarray):
    """Of one shard: what the parts need (context counts, distinct words), and the pairs of heavy contexts by place of the word."""
    def run(rows: Iterable) -> Iterator[tuple]:
        rows = iter(rows)
        first = next(rows, None)
        if first is None:
            return
        shard = first.shard
        contexts, counts, _, v, w, c, seen = _counted(r for r in itertools.chain([first], rows) if not r.kind)
        order, dealt = _dealt(contexts, parts)
        contexts, counts = contexts[order], counts[order]
        for part, lo, hi in dealt:
            yield CONTEXTS, part, shard, _squeeze(_steps(contexts[lo:hi])), _squeeze(counts[lo:hi]), []
        words, dealt, place = _listed(w, parts)
        for part, lo, hi in dealt:
            yield WORDS, part, shard, _squeeze(_steps(words[lo:hi])), b"", []
        wide = np.isin(v, heavy)
        which, c = np.searchsorted(heavy, v[wide]), c[wide]
        sums = np.bincount(which * (KEPT + 1) + np.minimum(c, KEPT + 1) - 1, np.where(c > KEPT, c, 1), len(heavy) * (KEPT + 1))
        yield (HEAVY, 0, shard, _squeeze(_steps(np.sort(which * max(1, len(words)) + place[wide]))), _squeeze(sums.astype(np.int64)),
               [len(words), *seen.tolist()])

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _answer(heavy: np.ndarray, ends: int):
    """Of one part: the counts of each shard's words, in their order; totals and the counts of heavy contexts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, asked, part = [(np.empty(0, np.uint64), np.empty(0, np.int64))], [], None
        for b in batches:
            for r in b.to_pylist():
                part = r["part"]
                if r["kind"] == CONTEXTS:
                    counted.append((np.cumsum(_loosen(r["a"])).view(np.uint64), _loosen(r["b"])))
                else:
                    asked.append((r["shard"], r["a"]))
        if part is None:
            return
        v, c = _merge(counted)
        word, wide = v != START, np.isin(v, heavy)
        low = [int((word & (c == r)).sum()) for r in range(1, KEPT + 2)]
        yield _batch([(TOTALS, part, 0, v[wide].tobytes(), c[wide].tobytes(), [int(c[word].sum()), int(word.sum()), *low])], COUNTS)
        at = np.searchsorted(v, END)  # the end is no context
        v, c = np.insert(v, at, END), np.insert(c, at, ends)
        for shard, packed in asked:
            words = np.cumsum(_loosen(packed)).view(np.uint64)
            yield _batch([(WORDS, part, shard, _squeeze(c[np.searchsorted(v, words)]), b"", [])], COUNTS)

    return run


def _word_counts(folder: str, shard: int) -> np.ndarray:
    """The counts of a shard's distinct words, in the order of `_listed`."""
    import pyarrow.dataset as ds

    store, root = file_system(f"{folder}/shard={shard}")
    if store.get_file_info(root).type.name != "Directory":
        return np.empty(0, np.int64)
    rows = ds.dataset(root, filesystem=store, format="parquet").to_table().to_pylist()
    return np.concatenate([_loosen(r["a"]) for r in sorted(rows, key=lambda r: r["part"])])


def discounts(seen: list[int]) -> list[float]:
    """Factors for counts 1 to KEPT. seen[r - 1] counts have the value r; Good-Turing, or absolute discounting where the
    counts of counts are too few for Good-Turing factors between 0 and 1."""
    n = [0, *seen]
    if all(x > 0 for x in n[1:KEPT + 2]):
        common = (KEPT + 1) * n[KEPT + 1] / n[1]
        if common < 1:
            factors = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, KEPT + 1)]
            if all(0 < f < 1 for f in factors):
                return factors
    d = min(0.9, max(0.1, n[1] / max(1, n[1] + 2 * n[2])))
    return [(r - d) / r for r in range(1, KEPT + 1)]


class Numbers(NamedTuple):
    """What all tasks need: training tokens, distinct ones, discounts of unigrams and bigrams, unknown mass, heavy contexts."""

    tokens: int
    types: int
    one: list[float]
    two: list[float]
    unknown: float
    heavy: dict[int, tuple[int, float, float]]  # context: count, sum of discounted counts, unigram mass of kept words

    @staticmethod
    def factor(table: list[float], c: np.ndarray) -> np.ndarray:
        return np.array([1.0, *table, 1.0])[np.minimum(c, KEPT + 1)]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """Probability of a class by its count."""
        return np.where(c > 0, self.factor(self.one, c) * c / max(1, self.tokens), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))


def weights(count: np.ndarray, kept: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha and a factor on the kept probabilities of contexts, from counts, sums of discounted counts and unigram masses.

    A context whose bigrams leave less than half a count gives up that much, so that alpha is never 0.
    """
    share = kept / np.maximum(1, count)
    least = 0.5 / (count + 1)
    factor = np.where(1 - share < least, (1 - least) / np.maximum(share, 1e-300), 1.0)
    return (1 - factor * share) / (1 - mass), factor


HEAVY_SUMS = "heavy int, kept double, mass double"


def _heavy_sums(numbers: Numbers, folder: str):
    """What each shard holds of the heavy contexts' discounted counts and of their words' unigram mass."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.array([*(f * r for r, f in enumerate(numbers.two, 1)), 1.0])
        for b in batches:
            for r in b.to_pylist():
                kept = _loosen(r["b"]).reshape(-1, KEPT + 1) @ factors
                which, place = np.divmod(np.cumsum(_loosen(r["a"])), max(1, r["stats"][0]))
                mass = np.bincount(which, numbers.unigram(_word_counts(folder, r["shard"])[place]), len(kept))
                there = np.flatnonzero(kept > 0)
                if len(there):
                    yield _batch(list(zip(there.tolist(), kept[there].tolist(), mass[there].tolist(), strict=True)), HEAVY_SUMS)

    return run


def _table(numbers: Numbers, rows: list, parts: int, counts_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one shard: contexts, counts, logs of alpha; keys of kept bigrams and their gains over backing off."""
    contexts, counts, pairs, v, w, c, _ = _counted(rows)
    heavy = np.array(sorted(numbers.heavy), np.uint64)
    own = ~np.isin(contexts, heavy)
    contexts, counts = np.concatenate([contexts[own], heavy]), np.concatenate([counts[own], np.zeros(len(heavy), np.int64)])
    order = np.argsort(contexts)
    contexts, counts = contexts[order], counts[order]
    at = np.searchsorted(contexts, v)
    below = numbers.unigram(counts_of[_listed(w, parts)[2]]) if len(w) else np.empty(0)
    gain = numbers.factor(numbers.two, c) * c
    kept, mass = np.bincount(at, gain, len(contexts)), np.bincount(at, below, len(contexts))
    for k in np.searchsorted(contexts, heavy).tolist():
        counts[k], kept[k], mass[k] = numbers.heavy[int(contexts[k])]
    alpha, factor = weights(counts, kept, mass)
    gains = np.log10(factor[at] * gain / counts[at]) - np.log10(alpha[at]) - np.log10(below)
    return contexts, counts, np.log10(alpha), pairs, gains.astype(np.float32)


def _score(numbers: Numbers, parts: int, folder: str):
    """Rows per shard and batch: documents and what the shard adds to their scores."""
    def run(rows: Iterable) -> Iterator[tuple]:
        packed = []
        for r in rows:
            if r.kind:
                yield r.batch, r.docs, True, r.trains, r.payload, b"", b""
            else:
                packed.append(r)
        if not packed:
            return
        contexts, counts, alphas, pairs, gains = _table(numbers, packed, parts, _word_counts(folder, packed[0].shard))
        for r in packed:
            v, n, w, doc = _unpack(r.sizes, r.payload)
            at = np.searchsorted(contexts, v)
            hit = at < len(contexts)
            hit[hit] = contexts[at[hit]] == v[hit]
            c = np.zeros(len(v), np.int64)
            alpha = np.zeros(len(v))
            c[hit], alpha[hit] = counts[at[hit]], alphas[at[hit]]
            token = v != START
            add = alpha + np.where(token, np.log10(numbers.unigram(c)), 0)
            base = np.where(token, numbers.base(c), 0)
            key = _pair(np.repeat(v, n), w)
            where = np.searchsorted(pairs, key)
            found = where < len(pairs)
            found[found] = pairs[where[found]] == key[found]
            score = np.repeat(add, n)
            score[found] += gains[where[found]]
            docs = np.unique(doc)
            total = [np.bincount(doc, x, r.docs)[docs] for x in (score, np.repeat(base, n), np.repeat(token & (c > 0), n))]
            yield (r.batch, r.docs, False, docs.tobytes(), total[0].astype(np.float32).tobytes(), total[1].tobytes(),
                   total[2].astype("<u4").tobytes())

    return run


PARTIAL = "batch long, docs int, head boolean, a binary, b binary, c binary, d binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(numbers: Numbers, ends: int):
    end_log, end_base = float(np.log10(numbers.unigram(np.array([ends])))[0]), float(numbers.base(np.array([ends]))[0])

    def one(rows: list[dict]) -> pa.RecordBatch:
        head = next(r for r in rows if r["head"])
        n, raw = head["docs"], head["b"]
        ids, sizes = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
        valid = np.frombuffer(raw, "u1", n, 16 * n)
        held = np.unpackbits(np.frombuffer(head["a"], np.uint8), count=n) == 0
        score, base, known = np.full(n, end_log), np.full(n, end_base), np.full(n, int(ends > 0))
        for r in rows:
            if not r["head"]:
                docs = np.frombuffer(r["a"], np.uint16)
                score[docs] += np.frombuffer(r["b"], np.float32)
                base[docs] += np.frombuffer(r["c"])
                known[docs] += np.frombuffer(r["d"], "<u4")
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=valid == 0), pa.array(held), pa.array(sizes + 1), pa.array(known),
                                           pa.array(np.full(n, numbers.tokens)), pa.array(base), pa.array(score)],
                                          [x.split()[0] for x in OUT.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["batch"] != r["batch"]:
                    yield one(held)
                    held = []
                held.append(r)
        if held:
            yield one(held)

    return run


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = word_hashes()
    for b in slices(batches, "text"):
        found = [known.of(words_of(t)) >> np.uint64(16) for t in b.column("text").to_pylist()]
        v, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(n)], ["v", "n"])


def heavy_contexts(plain: DataFrame, rows: int, shards: int, sample: int = 4000) -> np.ndarray:
    """Words that make up more than half a shard's share of a sample, at most 2 * shards; and the start of a text."""
    part = plain.sample(min(1.0, sample / max(1, rows)), seed=11).select("text")
    counts = part.mapInArrow(_words, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    counts = materialise(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = counts.where(F.col("n") * 2 * shards > total)
    return np.unique(np.array([START, *(r.v for r in share.select("v").toLocalIterator())], np.uint64))


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Train on the documents that are not held out and score all (OUT)."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size, rows, ends = plain.agg(F.sum(F.octet_length("text")), F.count("*"), F.sum((~F.col("held_out")).cast("long"))).first()
    ends = ends or 0
    shards = parts_for(spark, (size or 0) / 6, SHARD)
    heavy = heavy_contexts(plain, rows, shards)
    # an RDD, because its shuffle files serve both passes; a DataFrame would write them twice
    sharded = plain.mapInArrow(_stream(shards, heavy), STREAM).repartitionById(shards, "shard").rdd
    parts = parts_for(spark, (size or 0) / 6, 8 * SHARD)
    counted = materialise(spark.createDataFrame(sharded.mapPartitions(_count(parts, heavy)), COUNTS, verifySchema=False))

    def summed(rows: DataFrame) -> list[int]:
        got = rows.select(F.posexplode("stats").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
        return [n for _, n in sorted((r.i, r.n) for r in got)]

    folder = shared_dir(spark, "katz")
    asked = counted.where(f"kind IN ({CONTEXTS}, {WORDS})").repartitionById(parts, "part")
    answered = materialise(asked.mapInArrow(_answer(heavy, ends), COUNTS))
    answered.where(f"kind = {WORDS}").select("shard", "part", "a").repartitionById(shards, "shard").write.partitionBy("shard").parquet(folder)
    totals = answered.where(f"kind = {TOTALS}")
    tokens, types, *seen = summed(totals) or [0] * (KEPT + 3)
    if ends:
        tokens, types = tokens + ends, types + 1
        if ends <= KEPT + 1:
            seen[ends - 1] += 1
    one = discounts(seen)
    left = sum((1 - f) * r * n for r, (f, n) in enumerate(zip(one, seen, strict=False), 1))
    two_seen = summed(counted.where(f"kind = {HEAVY}"))[1:] or [0] * (KEPT + 1)
    two = [0.0] * (CUT - 1) + discounts(two_seen)[CUT - 1:]
    numbers = Numbers(tokens, types, one, two, left / tokens if tokens else 1.0, {})

    sums = counted.where(f"kind = {HEAVY}").mapInArrow(_heavy_sums(numbers, folder), HEAVY_SUMS).groupBy("heavy").agg(
        F.sum("kept").alias("kept"), F.sum("mass").alias("mass")).collect()
    kept = {int(heavy[r.heavy]): (r.kept, r.mass) for r in sums}
    wide = [np.frombuffer(x, np.uint64 if n == "a" else np.int64) for r in totals.where("length(a) > 0").select("a", "b").collect()
            for n, x in r.asDict().items()]  # heavy contexts: at most 2 * shards + 1
    heavy_counts = {int(v): int(c) for vs, cs in zip(wide[::2], wide[1::2], strict=True) for v, c in zip(vs, cs, strict=True)}
    numbers = numbers._replace(heavy={v: (c, *kept.get(v, (0.0, 0.0))) for v, c in heavy_counts.items()})
    partial = spark.createDataFrame(sharded.mapPartitions(_score(numbers, parts, folder)), PARTIAL, verifySchema=False)
    ordered = partial.repartition(shards, "batch").sortWithinPartitions("batch")
    return ordered.mapInArrow(_finish(numbers, ends), OUT)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), crc_mod("doc_id", 7) == 2)
