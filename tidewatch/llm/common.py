"""Helpers that the corpus operators share: reading, sizing, words, tokens, ordered ranges and files in the shared folder."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a token cache may hold before it is emptied; bounds the memory of a Python worker.
CACHE_ENTRIES = 1_200_000
WORD_ENTRIES = 250_000

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts_for(spark: SparkSession, units: float, per_part: float) -> int:
    """Partitions that hold at most about `per_part` units each, and never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(units / per_part))


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word (bytes), computed once per worker while the word stays cached."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(1)
def word_hashes() -> WordHashes:
    return WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8. bytes.lower and bytes.split do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Marks that are a token run of their own behind a word of letters.
MARKS = ".,;:!?)"


class ChunkEncoder:
    """Token ids of whole texts by the tokenizers library, with the ids of repeated chunks cached.

    A text is cut only where no token of the tokenizer can span: before a space that a non-space follows for a byte-level
    vocabulary (its pre-tokens carry a leading space), at white space for one that drops it. The ids of a text are therefore
    those of its chunks in order. A batch is cut and told apart in Arrow, each distinct chunk is looked up once, and a new word
    with a mark behind it is put together from both. `control_tokens`: a control string in a text becomes its special token, as
    the library does; such texts are encoded whole.
    """

    _odd = re.compile(r" (?:\s|$)|\x00")
    _cut = re.compile(r" (?=\S)")

    def __init__(self, path: str, drops_space: bool, control_tokens: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not control_tokens
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if control_tokens else []
        self._control = re.compile("|".join(map(re.escape, names))) if names else None
        self.drops_space = drops_space
        self.cache: dict[str, bytes] = {}
        self.marks = {m: self._whole(m) for m in MARKS}
        self.splits_marks = all(self._whole(lead + w + m) == self._whole(lead + w) + self.marks[m]
                                for lead in ("", " ") for w in ("a", "Zz", "the", "qWerTy") for m in MARKS)
        # plain letters in either case have the same ids where the tokenizer lower-cases
        self.folds = all(self._whole(w) == self._whole(w.lower()) for w in ("A", "Zz", "THE", "qWerTy"))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; unknown ones are encoded together."""
        cache = self.cache
        new = [c for c in chunks if c not in cache]
        if new:
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
                new = chunks
            made, plain = [], []  # chunks that a plainer word and a mark give, and those that the library encodes
            for c in new:
                word, mark = (c[:-1], c[-1]) if self.splits_marks and c[-1:] in self.marks else (c, "")
                if c.isascii() and word.strip(" ").isalpha():
                    word = word.lower() if self.folds else word
                    if word != c:
                        made.append((c, word, mark))
                        if word not in cache:
                            plain.append(word)
                        continue
                plain.append(c)
            plain = list(dict.fromkeys(plain))
            for at in range(0, len(plain), 4096):
                part = plain[at:at + 4096]
                for chunk, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    cache[chunk] = np.array(got.ids, "<u4").tobytes()
            for c, word, mark in made:
                cache[c] = cache[word] + self.marks[mark] if mark else cache[word]
        return [cache[c] for c in chunks]

    def _slow(self, text: str) -> bytes:
        """Ids of a text that Arrow's cut does not fit."""
        if self._control is not None and self._control.search(text):
            return self._whole(text)
        head, *rest = self._cut.split(text)
        chunks = [head, *(" " + c for c in rest)]
        distinct = list(dict.fromkeys(chunks))
        known = dict(zip(distinct, self._learn(distinct), strict=True))
        return b"".join(known[c] for c in chunks)

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Per text the ids as little-endian unsigned 32-bit integers; a null text has none."""
        values = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "").cast(pa.large_string())
        plain = values.to_pylist()
        odd = {i for i, t in enumerate(plain) if (self._control is not None and "<|" in t and self._control.search(t))
               or (not self.drops_space and self._odd.search(t))}
        if odd:
            values = pa.array(["" if i in odd else t for i, t in enumerate(plain)], pa.large_string())
        cut = pc.ascii_split_whitespace(values) if self.drops_space else pc.split_pattern(
            pc.replace_substring(values, " ", "\x00 "), "\x00")
        coded = cut.flatten().dictionary_encode()
        found = self._learn(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        codes = coded.indices.to_numpy()
        taken = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(taken)])
        begins = (np.cumsum(sizes) - sizes)[codes]
        ids = flat[np.arange(ends[-1]) + np.repeat(begins - ends[:-1], taken)].tobytes()
        at = (ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()] * 4).tolist()
        return [self._slow(plain[i]) if i in odd else ids[x:y] for i, (x, y) in enumerate(zip(at, at[1:], strict=False))]


@lru_cache(4)
def chunk_encoder(path: str, drops_space: bool, control_tokens: bool = True) -> ChunkEncoder:
    return ChunkEncoder(path, drops_space, control_tokens)


def release_caches() -> None:
    """Lets go of the words and tokens that earlier stages cached in this Python worker, which Spark uses again: a stage that needs
    neither adds its own memory to theirs otherwise."""
    chunk_encoder.cache_clear()
    word_hashes.cache_clear()


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """The batches cut so that the texts (or lists of numbers) of one piece hold about max_bytes at most; one longer text stays
    whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = pc.binary_length(values) if not pa.types.is_list(values.type) else pc.multiply(pc.list_value_length(values), 8)
        sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def range_bounds(docs: DataFrame, parts: int) -> list[int]:
    """Ascending doc_ids that begin ranges of about equal row counts; the first is the smallest id. At most `parts` values."""
    row = docs.agg(F.min("doc_id").cast("long").alias("low"),
                   F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)] or [0.5],
                                       20 * parts + 1000).alias("q")).first()
    return [] if row.low is None else sorted({row.low, *(row.q if parts > 1 else [])})


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of the range that holds doc_id (0 for null), by binary search over the bounds inside the expression."""
    if len(bounds) < 2:
        return F.lit(0)
    table = F.lit(bounds)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = F.get(table, mid) <= doc_id
        return F.when(acc["hi"] - acc["lo"] <= 1, acc).otherwise(
            F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi")))

    steps = F.array_repeat(F.lit(0), math.ceil(math.log2(len(bounds))) + 1)
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, halve, lambda a: a["lo"]))


def file_system(path: str):
    """The store and the path in it; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
