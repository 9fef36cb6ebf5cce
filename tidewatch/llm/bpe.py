"""BPE encoding and decoding by speculation: propose tokens by greedy longest match, verify adjacent pairs, merge only what fails.

A split of a word into tokens is its BPE encoding exactly when every token encodes to itself and no merge crosses a border
between two neighbours: until the first crossing merge, both neighbours develop as they would alone, so that merge would show
in the pair already. A pair is tested by undoing, latest first, the merges beside its border; at each point in time a merge of
the two symbols at the border must rank behind the next one that consumes either. The test runs over all distinct pairs of a
batch at once in numpy. Words with a failing pair are merged exactly, with a heap.

Normaliser, pre-tokeniser and vocabulary are those of the tokenizers file; truncation and padding are not used. A control
string inside a text becomes its special token, as in the library (`control_tokens=False` takes it as plain text).

Null, empty and odd input: a null or empty text has no ids and decodes to an empty text; a null doc_id stays null; repeated
rows are encoded each; very long texts and words are encoded whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, slices

#: Chunks and words whose ids a task keeps; each table is emptied when it is full, which bounds the memory of a worker.
CACHED_CHUNKS, CACHED_WORDS = 500_000, 250_000

NEVER = np.int64(1) << 40
FAR = 1 << 62
#: A merge's rank and token in one number, so that the least number is the merge to do first.
MADE_BITS = 24
MADE = (1 << MADE_BITS) - 1
#: Up to so many symbols a plain search for the best pair is faster than a heap.
SHORT_WORD = 64
PLAIN_MARKS = ".,;:!?)"


class MergeTable:
    """Ranks and parts of all tokens of a BPE vocabulary, with the border test and exact merging."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = max(vocab.values()) + 1
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.merges[x, y] = k << MADE_BITS | made
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = k, x, y
        pairs = np.array(list(self.merges), np.int64).reshape(-1, 2)
        ranks = np.array(list(self.merges.values()), np.int64) >> MADE_BITS
        key = (pairs[:, 0] << 32) | pairs[:, 1]
        order = np.argsort(key)
        self.keys, self.ranks = np.append(key[order], np.iinfo(np.int64).max), np.append(ranks[order], NEVER)
        # symbols a word starts from: one character, its last one with the suffix
        self.inner = {t: i for t, i in vocab.items() if len(t) == 1}
        self.last = {t[:-len(suffix)]: i for t, i in vocab.items() if len(t) == len(suffix) + 1 and t.endswith(suffix)} \
            if suffix else self.inner
        self._tokens(vocab, suffix, merges)

    def _tokens(self, vocab: dict[str, int], suffix: str, merges: list[tuple[str, str]]) -> None:
        """The tokens that encode to themselves, for proposals; inside a word and at its end apart."""
        valid, ends = np.zeros(len(self.rank), bool), np.zeros(len(self.rank), bool)
        for i in chain(self.inner.values(), self.last.values()):
            valid[i] = True
        ends[list(self.last.values())] = True
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        kept = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i, ok in zip(made.tolist(), kept.tolist(), strict=True):
            a, b = self.left[i], self.right[i]
            # parts come before the whole, or undoing by rank would not run back in time
            valid[i] = ok and valid[a] and valid[b] and max(self.rank[a], self.rank[b]) < self.rank[i]
            ends[i] = ends[b]
        self.inside: dict[str, int] = {}
        self.at_end: dict[str, int] = {}
        for a, b in merges:
            i = vocab[a + b]
            if valid[i]:
                if suffix and ends[i]:
                    self.at_end[(a + b)[:-len(suffix)]] = i
                else:
                    self.inside[a + b] = i
        self.inside |= self.inner
        self.at_end = self.at_end | self.last if suffix else self.inside
        self.longest_end = max(map(len, self.at_end))
        self.begins: dict[str, int] = {}  # every beginning of a token inside a word: its id where it is one itself, or -1
        for t in self.inside:
            for n in range(1, len(t)):
                self.begins.setdefault(t[:n], -1)
        self.begins |= self.inside

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of rank below `limit` crosses the border between a[i] and b[i]."""
        ok = np.ones(len(a), bool)
        at, l, r = np.arange(len(a)), a.copy(), b.copy()
        until = np.full(len(a), NEVER) if limit is None else limit.copy()
        while len(at):
            crossed = self.pair_rank(l, r) < until
            ok[at[crossed]] = False
            rank_l, rank_r = self.rank[l], self.rank[r]
            go = ~crossed & (np.maximum(rank_l, rank_r) >= 0)
            at, l, r, rank_l, rank_r = at[go], l[go], r[go], rank_l[go], rank_r[go]
            # of equal ranks the right one came later, since merges run from the left; a crossing of that rank comes before it
            undo_left = rank_l > rank_r
            until = np.where(undo_left, rank_l, rank_r + 1)
            l, r = np.where(undo_left, self.right[l], l), np.where(undo_left, r, self.left[r])
        return ok

    def propose(self, word: str) -> list[int]:
        """Greedy longest match of a non-empty word."""
        at_end, begins = self.at_end.get, self.begins.get
        ids, at, n = [], 0, len(word)
        while at < n:
            end = at_end(word[at:] if n - at <= self.longest_end else "")
            if end is not None:
                ids.append(end)
                break
            stop, best = at + 1, -1
            while stop < n and (found := begins(word[at:stop])) is not None:
                if found >= 0:
                    best, reach = found, stop
                stop += 1
            ids.append(best)
            at = reach
        return ids

    def merge(self, word: str) -> list[int]:
        """Exact encoding of a non-empty word: always the pair of least rank, the leftmost of equals."""
        ids = [self.inner[c] for c in word[:-1]] + [self.last[word[-1]]]
        return self._merge_short(ids) if len(ids) <= SHORT_WORD else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        pair = self.merges.get
        found = [pair(p, FAR) for p in pairwise(ids)]
        while found and (best := min(found)) < FAR:
            i = found.index(best)
            ids[i:i + 2] = [best & MADE]
            del found[i]
            if i:
                found[i - 1] = pair((ids[i - 1], ids[i]), FAR)
            if i < len(found):
                found[i] = pair((ids[i], ids[i + 1]), FAR)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, pair = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(best, i) for i, p in enumerate(pairwise(ids)) if (best := pair(p, FAR)) < FAR]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if best == FAR or ids[i] < 0 or j >= n or pair((ids[i], ids[j]), FAR) != best:
                continue
            ids[i], ids[j] = best & MADE, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                heapq.heappush(heap, (pair((ids[i], ids[k]), FAR), i))
            h = before[i]
            if h >= 0:
                heapq.heappush(heap, (pair((ids[h], ids[i]), FAR), h))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct non-empty words: all proposed, every adjacent pair tested, failing words merged."""
        found = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        beside = np.flatnonzero(owner[1:] == owner[:-1])
        key, which = np.unique((flat[beside] << 32) | flat[beside + 1], return_inverse=True)
        bad = ~self.compatible(key >> 32, key & 0xFFFFFFFF)[which]
        for w in np.unique(owner[beside[bad]]).tolist():
            found[w] = self.merge(words[w])
        return found


class SpeculativeEncoder:
    """Texts to ids and back by one tokenizers file. Ids of chunks and words are cached in bounded tables."""

    def __init__(self, path: str, control_tokens: bool):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]
                                                     for t in spec["added_tokens"]):
            raise ValueError(f"{path} is not a plain BPE vocabulary")
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.pre_tokenise = library.pre_tokenizer.pre_tokenize_str
        # letters are one word in lower case and a mark behind them is another: known without asking the library
        self.simple = all(self._parts_by_library(a + m) == [a.lower(), *m] for a in ("a", "Zz", "qWerTy") for m in ("", *PLAIN_MARKS))
        self.table = MergeTable(model)
        self.control = {t["content"]: t["id"] for t in spec["added_tokens"]} if control_tokens else {}
        self.control_split = re.compile("(" + "|".join(
            map(re.escape, sorted(self.control, key=len, reverse=True))) + ")") if self.control else None
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _parts(self, chunk: str) -> list[str | int]:
        """Words of a chunk in the alphabet of the vocabulary, and the ids of control strings."""
        if self.simple and chunk and chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1] in PLAIN_MARKS and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
        out: list[str | int] = []
        for k, part in enumerate(self.control_split.split(chunk) if self.control_split else (chunk,)):
            if k % 2:
                out.append(self.control[part])
            elif part:
                out.extend(self._parts_by_library(part))
        return out

    def _parts_by_library(self, part: str) -> list[str]:
        return [w for w, _ in self.pre_tokenise(self.normalise(part)) if w]

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not cached, all their unknown words in one go."""
        parts = [self._parts(c) for c in chunks]
        all_words = {p for ps in parts for p in ps if isinstance(p, str)}
        new = list(all_words.difference(self.words))
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = list(all_words)
        self.words.update((w, np.array(ids, np.int32).tobytes()) for w, ids in zip(new, self.table.encode_words(new), strict=True))
        for c, ps in zip(chunks, parts, strict=True):
            self.chunks[c] = b"".join([p.to_bytes(4, "little") if isinstance(p, int) else self.words[p] for p in ps])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (one more than texts), and all ids. Texts are cut at ASCII white space, which no token
        spans; each distinct chunk is looked up once a batch."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if new := [c for c in chunks if c not in self.chunks]:
            if len(self.chunks) + len(new) > CACHED_CHUNKS:
                self.chunks.clear()
                new = chunks
            self._learn(new)
        found = [self.chunks[c] for c in chunks]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<i4")
        codes = coded.indices.to_numpy()
        taken = sizes[codes]
        ends = np.cumsum(taken)
        begins = (np.cumsum(sizes) - sizes)[codes]
        ids = flat[np.arange(int(taken.sum())) + np.repeat(begins - (ends - taken), taken)]
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return np.concatenate([[0], ends])[offsets], ids


class TokenNames:
    """The text of every token, for decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token texts joined by one space, as the library does where the file names no decoder; unknown ids are skipped."""
        flat = ids.flatten()
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.names)))
        if not pc.all(known, min_count=0).as_py():
            flat = pc.if_else(known, flat, None)
        texts = self.names.take(flat)
        begins = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        nested = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), texts)
        if not texts.null_count:
            return pc.binary_join(nested, " ")
        return pa.array([" ".join(t for t in row if t is not None) for row in nested.to_pylist()], pa.string())


@lru_cache(4)
def encoder(path: str, control_tokens: bool = True) -> SpeculativeEncoder:
    return SpeculativeEncoder(path, control_tokens)


@lru_cache(4)
def token_names(path: str) -> TokenNames:
    return TokenNames(path)


def _encoded(batches: Iterable[pa.RecordBatch], tokenizer: str, control_tokens: bool) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    coder = encoder(tokenizer, control_tokens)
    for b in slices(batches, "text"):
        begins, ids = coder.encode(b.column("text"))
        yield b.column("doc_id"), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer: str, control_tokens: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids in _encoded(batches, tokenizer, control_tokens):
            yield pa.RecordBatch.from_arrays([doc, ids], ["doc_id", "ids"])

    return _plain(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of `encode` with their decoded text; special tokens stay in it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids"):
            text = token_names(tokenizer).decode(part.column("ids"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), text], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, control_tokens: bool = True) -> DataFrame:
    """`decode(encode(docs))` in one pass over the rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, ids in _encoded(batches, tokenizer, control_tokens):
            yield pa.RecordBatch.from_arrays([doc, ids, token_names(tokenizer).decode(ids)], ["doc_id", "ids", "decoded"])

    return _plain(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    back = round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
