"""Spelling variants: words that differ by one letter, found by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter moves a word's letter-count vector by a squared distance of one or two. Words are laid in
blocks of equal counts per letter class (so of equal length); a word's variants lie in its own block or in few adjacent ones, those
with one letter less or one letter in another class. Per block, a NumPy product of the count matrices gives the squared distances of
its words to all words that can be near them; pairs at most two apart are compared letter by letter.

The letter classes share the letters of all words evenly. Their number is the smallest for which no block is too large for a quick
product, so blocks stay small as the vocabulary grows; all blocks are compared whole whatever their size.

Null, empty and odd input: a null or empty text has no words; a null doc_id counts as the text `null` in the deletion rule; repeated
rows count each; very long words are compared like others; equal counts go to the word that is smaller in code-point order; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import documents, mix64, slices
from tidewatch.session import materialise

#: Words a task counts before it hands them on.
COUNTED = 300_000
#: Rows of a count matrix that are multiplied at once.
ROWS = 2048
#: Letter classes tried, and the block size at which no more are needed.
CLASSES = (4, 6, 8, 10, 12)
BLOCK_WORDS = 1500


def _count(least: int, every: int):
    pattern = re.compile(r"[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())],
                                               ["word", "n"])
            counts.clear()
            return batch

        for b in slices(batches, "text"):
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                # bytes.lower changes A-Z alone
                runs = Counter(pattern.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                begin = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                for word, n in runs.items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > COUNTED:
                    yield out()
        if counts:
            yield out()

    return run


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """word and n of all words long and frequent enough, after the deletion rule."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = plain.mapInArrow(_count(least_length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the words as numbers below 256, and where each word begins (one more than words)."""
    words = column.to_pylist()
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), begins


def _count_matrix(letters: np.ndarray, begins: np.ndarray, number: np.ndarray, width: int) -> np.ndarray:
    """Occurrences per word of each number that `number` gives the letters."""
    rows = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    return np.bincount(rows * width + number[letters], minlength=(len(begins) - 1) * width).reshape(-1, width)


def letter_classes(words: DataFrame) -> dict[int, np.ndarray]:
    """For each number of classes, the class of every letter: the letters in order of frequency, each to the least used class."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            total += np.bincount(_letters(b.column("word"))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["letter", "n"])

    rows = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(256, np.int64)
    for r in rows:  # at most 256
        n[r.letter] = r.n
    out = {}
    for classes in CLASSES:
        number, load = np.zeros(256, np.int64), np.zeros(classes)
        for letter in np.argsort(-n, kind="stable").tolist():
            number[letter] = load.argmin()
            load[number[letter]] += n[letter] + 1e-9
        out[classes] = number
    return out


def _steps(classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A factor per class whose weighted sums name blocks, and the steps to adjacent blocks: what is added to the name, the class
    that gives a letter, and the class that gets it (-1: none, the word gets shorter).

    No step is zero, equals another or another's reverse: every pair of words meets at most once, even if names collide.
    """
    factor = mix64(np.arange(1, classes + 1, dtype=np.uint64)) | np.uint64(1)
    give, get = zip(*[(i, j) for i in range(classes) for j in range(i + 1, classes)], *[(i, -1) for i in range(classes)], strict=True)
    give, get = np.array(give), np.array(get)
    step = np.where(get < 0, np.uint64(0), factor[get]) - factor[give]
    if len({*step.tolist(), *(np.uint64(0) - step).tolist()} - {0}) != 2 * len(step):
        raise ValueError("block names are ambiguous")
    return factor, step, give, get


def _names(column: pa.Array, number: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    per_class = _count_matrix(*_letters(column), number, len(factor))
    return per_class, (per_class.astype(np.uint64) * factor).sum(1, dtype=np.uint64)


def largest_block(words: DataFrame, number: np.ndarray, classes: int) -> int:
    factor = _steps(classes)[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_names(b.column("word"), number, factor)[1].view(np.int64))], ["block"])

    sizes = words.select("word").mapInArrow(run, "block long").groupBy("block").agg(F.count("*").alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _meetings(number: np.ndarray, classes: int):
    """Each word once in its own block (guest false) and once in every adjacent one (guest true)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, step, give, _ = _steps(classes)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                per_class, name = _names(b.column("word"), number, factor)
                rows, steps = np.nonzero(per_class[:, give])  # only a class that has a letter can give one
                block = np.concatenate([name, name[rows] + step[steps]]).view(np.int64)
                row = pa.array(np.concatenate([np.arange(b.num_rows), rows]))
                guest = np.concatenate([np.zeros(b.num_rows, bool), np.ones(len(rows), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(guest), b.column("word").take(row), b.column("n").take(row)],
                                                 ["block", "guest", "word", "n"])

    return run


class Words:
    """Words of one block as letters, letter counts and occurrences."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = np.array(words, object), n
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.begins = np.cumsum(self.length) - self.length
        self.letters = flat

    def counts(self, width: np.ndarray, top: int, lo: int, hi: int) -> np.ndarray:
        begins = np.append(self.begins[lo:hi], self.begins[hi - 1] + self.length[hi - 1])
        matrix = _count_matrix(self.letters[begins[0]:begins[-1]], begins - begins[0], width, top)
        return matrix.astype(np.float32 if self.length[lo:hi].max() < 2000 else np.float64)  # products stay exact

    def padded(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), np.uint8)
        cols = np.arange(width)
        inside = cols < self.length[rows][:, None]
        out[inside] = self.letters[(self.begins[rows][:, None] + cols)[inside]]
        return out


def one_edit(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether word i of a and word j of b differ by exactly one inserted, deleted or replaced letter; a is never the longer."""
    ok = np.zeros(len(i), bool)
    la, lb = a.length[i], b.length[j]
    for n in np.unique(la).tolist():
        for more in (0, 1):
            at = np.flatnonzero((la == n) & (lb == n + more))
            for lo in range(0, len(at), max(1, (1 << 22) // (n + 1))):
                k = at[lo:lo + max(1, (1 << 22) // (n + 1))]
                x, y = a.padded(i[k], n), b.padded(j[k], n + more)
                if more:
                    front = np.logical_and.accumulate(x == y[:, :-1], 1).sum(1)
                    back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], 1).sum(1)
                    ok[k] = front + back >= n
                else:
                    ok[k] = (x != y).sum(1) == 1
    return ok


def near_pairs(home: Words, guests: Words | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (home, guest) of words one edit apart; without guests, pairs within home, each once."""
    other = home if guests is None else guests
    used = np.unique(np.concatenate([home.letters, other.letters]))
    number = np.zeros(256, np.int64)
    number[used] = np.arange(len(used))
    found = []
    for lo in range(0, len(home.words), ROWS):
        hi = min(lo + ROWS, len(home.words))
        x = home.counts(number, len(used), lo, hi)
        xx = (x * x).sum(1)
        for start in range(lo if guests is None else 0, len(other.words), ROWS):
            stop = min(start + ROWS, len(other.words))
            y = other.counts(number, len(used), start, stop)
            gram = x @ y.T.astype(x.dtype)
            gram *= -2
            gram += xx[:, None]
            gram += (y * y).sum(1)
            i, j = np.nonzero(gram <= 2)
            found.append((i + lo, j + start))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    keep = (i < j) if guests is None else np.ones(len(i), bool)
    keep &= np.abs(other.length[j] - home.length[i]) <= 1
    i, j = i[keep], j[keep]
    swap = home.length[i] > other.length[j]
    ok = np.zeros(len(i), bool)
    ok[~swap] = one_edit(home, other, i[~swap], j[~swap])
    ok[swap] = one_edit(other, home, j[swap], i[swap])
    return i[ok], j[ok]


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream blocks in order: a block's own words come first and stay, its guests pass by in pieces."""
    block, words, n, home, compared = None, [], [], None, False

    def rows(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(i), 50_000):
            x, y, nx, ny = a.words[i[at:at + 50_000]], b.words[j[at:at + 50_000]], a.n[i[at:at + 50_000]], b.n[j[at:at + 50_000]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x, y]), pa.string()), pa.array(np.concatenate([y, x]), pa.string()), pa.array(np.concatenate([ny, nx]))],
                ["word", "near", "near_n"])

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal home, compared
        if words and not compared:
            home, compared = Words(words, np.array(n, np.int64)), True
            yield from rows(home, home, *near_pairs(home, None))

    for b in batches:
        name, guest = b.column("block").to_numpy(), b.column("guest").to_numpy(zero_copy_only=False)
        text, count = b.column("word").to_pylist(), b.column("n").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(name) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if name[lo] != block:
                yield from settle()
                block, words, n, home, compared = name[lo], [], [], None, False
            if not guest[lo]:
                words.extend(text[lo:hi])
                n.extend(count[lo:hi].tolist())
            elif words:
                yield from settle()
                guests = Words(text[lo:hi], count[lo:hi])
                yield from rows(home, guests, *near_pairs(home, guests))
    yield from settle()


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n for every ordered pair of words (columns word, n; words distinct) one edit apart."""
    tables = letter_classes(words)
    for classes in CLASSES:
        if largest_block(words, tables[classes], classes) <= BLOCK_WORDS:
            break
    met = words.select("word", "n").mapInArrow(_meetings(tables[classes], classes), "block long, guest boolean, word string, n long")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, "block").sortWithinPartitions("block", "guest").mapInArrow(_compare, "word string, near string, near_n long")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Per word its form (the most frequent near word, if `ratio` times as frequent), its root, and the counts."""
    spark = words.sparkSession
    words = materialise(words)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    linked = words.join(near, "word", "left")
    has = -F.col("best.n") >= ratio * F.col("n")
    table = materialise(linked.select("word", F.when(has, F.col("best.near")).alias("form"), "n",
                                      F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("best.n")).alias("form_n")))
    roots = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # a form is `ratio` times as frequent: chains are short, and each step doubles what is followed
        roots = materialise(roots)
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(on, "root", "left_semi").head(1):
            break
        roots = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(word_counts(documents(spark, sf_dir)))
