"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may appear with up to k = floor(rate * m) edits. It is split into k + 1 pieces; a text that holds it
with k edits holds one piece exactly, so an automaton over all pieces finds every place to look at. A place is kept when its
window shares enough q-grams with the item (k edits destroy at most k * q of them), and then verified by Myers' bit-parallel
edit distance with free ends. Texts and items are compared in lower case with runs of white space as one space.

The items are the stated query set: they go to the tasks in blocks of BLOCK characters, every block against all rows.

Null, repeated and odd input: a null or empty text holds no item; an item that is null or has fewer than `least` normalised
characters is not searched; repeated rows and repeated items each get their rows; other columns are kept by `drop_leaks` and
ignored by `leaks`; empty tables give no leaks. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import documents, slices

RATE = 0.07
#: Characters of items in a block; an automaton of a block takes some tens of MB.
BLOCK = 1_000_000
LEAST = 24
Q = 3
LEAKS = "doc_id long, item_id long, distance int, place int"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length with their offsets."""
    cuts = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """One item prepared for Myers' algorithm and the q-gram test."""

    def __init__(self, item_id: int, item: str, rate: float):
        self.item_id, self.item, self.size = item_id, item, len(item)
        self.k = int(rate * self.size)
        self.where: dict[str, int] = {}
        for i, c in enumerate(item):
            self.where[c] = self.where.get(c, 0) | 1 << i
        self.grams = [item[i:i + Q] for i in range(self.size - Q + 1)]
        self.kinds = frozenset(self.grams)
        self.enough = len(self.grams) - self.k * Q

    def may_match(self, window: str) -> bool:
        if self.enough <= 0:
            return True
        there = self.kinds.intersection([window[i:i + Q] for i in range(len(window) - Q + 1)])
        return sum(g in there for g in self.grams) >= self.enough

    def distance(self, window: str) -> tuple[int, int]:
        """Smallest edit distance of the item to a substring of the window, and where that ends."""
        mask, top = (1 << self.size) - 1, 1 << self.size - 1
        plus, minus, score = mask, 0, self.size
        best, end = score, 0
        for at, c in enumerate(window):
            eq = self.where.get(c, 0)
            d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & mask
            hp, hm = (minus | ~(d0 | plus)) & mask, plus & d0
            if hp & top:
                score += 1
            elif hm & top:
                score -= 1
            hp, hm = hp << 1 & mask, hm << 1 & mask  # a match may begin anywhere
            plus, minus = (hm | ~(d0 | hp)) & mask, hp & d0
            if score < best:
                best, end = score, at + 1
        return best, end


class Block:
    """Items of one block with the automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.patterns = [Pattern(i, t, rate) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for offset, piece in pieces(p.item, p.k):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """item_id, smallest distance, end of that match, of each item the text holds."""
        best: dict[int, tuple[int, int]] = {}
        looked: set[tuple[int, int]] = set()
        for last, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                p = self.patterns[n]
                begin = last + 1 - size - offset  # where the item would begin without edits
                if (n, begin) in looked:
                    continue
                looked.add((n, begin))
                if n in best and best[n][0] == 0:
                    continue
                low = max(0, begin - p.k)
                window = text[low:begin + p.size + p.k]
                if p.may_match(window):
                    distance, end = p.distance(window)
                    if distance <= p.k and (n not in best or (distance, low + end) < best[n]):
                        best[n] = distance, low + end
        return [(self.patterns[n].item_id, d, e) for n, (d, e) in best.items()]


def _blocks(benchmark: DataFrame, least: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        item = normal(r.text)
        if len(item) >= least:
            block.append((r.item_id, item))
            size += len(item)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _find(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(items, rate)
        for b in slices(batches, "text"):
            out = [(doc, *hit) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                   for hit in block.search(normal(text))]
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                                             ["doc_id", "item_id", "distance", "place"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, smallest distance and where that match ends in the normalised text, of each held item."""
    plain = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")
    parts = [plain.mapInArrow(_find(items, rate), LEAKS) for items in _blocks(benchmark, least)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], LEAKS)


def _drop(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(items, rate)
        for b in slices(batches, "text"):
            clean = np.array([not block.search(normal(t)) for t in b.column("text").to_pylist()], bool)
            yield b.filter(pa.array(clean))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The documents that hold no item, with their columns; each is judged where it lies, without a shuffle."""
    for items in _blocks(benchmark, least):
        docs = docs.mapInArrow(_drop(items, rate), docs.schema)
    return docs


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
