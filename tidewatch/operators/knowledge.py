"""Text chunks, vector search and context packing; conversation windows."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import top_per_key

CHUNK_SIZE, OVERLAP = 512, 64
#: Texts cut at a time, and chunks of one written batch.
PIECE_BYTES, PIECE_ROWS = 2 << 20, 10_000
MAX_QUERIES = 1024


def cut_points(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Window ends at a paragraph, else a sentence, else a line break; the next window steps back by the overlap but
    always moves on by at least one character."""
    spans, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            stop = next((p for mark in ("\n\n", ". ", "\n") if (p := text.rfind(mark, start, end)) > start), -1)
            end = stop + 1 if stop > start else end
        spans.append((start, end))
        start = max(end - overlap, start + 1)
    return spans


def _chunk_pieces(size: int, overlap: int):
    """Batches of (key, text, source) to batches of chunks; documents are taken until their texts fill a piece, so what a task
    holds does not depend on the rows of a batch."""
    names = ["chunk_index", "char_start", "char_end", "chunk"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.flatnonzero(np.diff(np.cumsum(lengths) // PIECE_BYTES)) + 1
            for lo, hi in itertools.pairwise([0, *ends.tolist(), b.num_rows]):
                part, at, rows = b.slice(lo, hi - lo), [], []
                for n, t in enumerate(part.column(1)):
                    body, i = (t.as_py() or "").strip(), 0
                    for start, end in cut_points(body, size, overlap):
                        piece = body[start:end].strip()
                        if piece:
                            at.append(n)
                            rows.append((i, start, end, piece))
                            i += 1
                        if len(rows) == PIECE_ROWS:
                            yield told(part, at, rows)
                            at, rows = [], []
                if rows:
                    yield told(part, at, rows)

    def told(part: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        own = part.select([0, 2]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*own.columns, *columns], [part.schema.names[0], "source", *names])

    return run


def chunk_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str | None = "source",
                    size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, source, chunk_index, char_start, char_end, chunk). Sequential inside one document, so an Arrow map over
    batches of whole documents; there is no shuffle and documents never meet."""
    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, source string, chunk_index int, char_start int, char_end int, chunk string"
    origin = F.col(source).cast("string") if source else F.lit(None).cast("string")
    return df.select(key, F.col(text).cast("string").alias("_text"), origin.alias("_source")).mapInArrow(_chunk_pieces(size, overlap), schema)


def title_from_path(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.initcap(F.regexp_replace(name, "[_-]", " "))


def _blocks(queries: DataFrame, key: str, vector: str):
    ids, rows = [], []
    for r in queries.select(key, vector).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == MAX_QUERIES:
            yield ids, np.asarray(rows, dtype=np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.asarray(rows, dtype=np.float64)


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
                 query_key: str = "query_id", query_vector: str = "query_vector", floor: float | None = None) -> DataFrame:
    """Exact top k by inner product: (query_key, key, score, rank).

    Queries travel in blocks of at most MAX_QUERIES vectors; a larger set takes further passes over the corpus. Each
    Arrow batch is one matrix product and keeps k rows per query, so only k rows per query and batch are shuffled.
    """
    key_type = corpus.schema[key].dataType.simpleString()
    q_type = queries.schema[query_key].dataType.simpleString()
    found = None
    for ids, matrix in _blocks(queries, query_key, query_vector):
        def run(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) == 0:
                    continue
                scores = np.stack(b[vector].to_numpy()).astype(np.float64) @ matrix.T
                keys = b[key].to_numpy()
                keep = min(k, len(b))
                for j, q in enumerate(ids):
                    order = np.lexsort((keys, -scores[:, j]))[:keep]
                    yield pd.DataFrame({query_key: [q] * keep, key: keys[order], "score": scores[order, j]})

        part = corpus.select(key, vector).mapInPandas(run, f"{query_key} {q_type}, {key} {key_type}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no query vectors")
    out = top_per_key(found, [query_key], [F.desc("score"), F.col(key)], k, name="rank")
    return out.where(F.col("score") >= floor) if floor is not None else out


def pack_context(hits: DataFrame, query_key: str = "query_id", max_chars: int = 2000) -> DataFrame:
    """(query_key, context): numbered entries until max_chars; the entry that overflows is cut when more than 100
    characters remain. `hits` holds a few ranked rows per query: rank, score, source, title, text."""
    entry = F.concat(F.format_string("[%d] (score=%s, source=", F.col("rank"), F.round("score", 4).cast("string")),
                     F.coalesce("source", F.lit("unknown")), F.lit(")\n"),
                     F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit("Title: "), F.col("title"),
                                                                                 F.lit("\n"))).otherwise(""),
                     F.col("text"))
    w = Window.partitionBy(query_key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sized = hits.withColumn("_e", entry).withColumn("_before", F.coalesce(F.sum(F.length("_e")).over(w), F.lit(0)))
    room = max_chars - F.col("_before")
    piece = F.when(F.length("_e") <= room, F.col("_e")).when(room > 100, F.concat(
        F.substring(F.col("_e"), F.lit(1), room.cast("int")), F.lit("...")))
    packed = sized.where(room > 0).withColumn("_p", piece)
    return packed.groupBy(query_key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "rank", "_p"))), lambda s: s["_p"]), "\n\n").alias("context"))


def recent_messages(df: DataFrame, n: int = 20, cut_at: int = 500) -> DataFrame:
    """Last n messages per conversation, content cut."""
    kept = top_per_key(df, ["conv_id"], [F.desc("turn")], n)
    return kept.withColumn("text", F.substring("text", 1, cut_at)).drop("rn")


def most_recent(df: DataFrame, order: list[str], n: int = 10_000) -> DataFrame:
    return df.orderBy(*[F.desc(o) for o in order]).limit(n)


def recall_findings(memory: DataFrame, queries: DataFrame, k: int = 3, floor: float = 0.25, **names) -> DataFrame:
    """Past findings closest to each query above the floor."""
    return vector_top_k(memory, queries, k=k, floor=floor, **names)
