"""An inverted-file vector index with exact search: rows lie in cells around centroids, and a bound tells which cells a query needs.

Every row of a cell is at most the cell's radius away from its centroid. So no row of it can have an inner product with a query
above q·c + |q|·radius, nor be nearer than |q - c| - radius. A search reads the most promising cells first, takes the k-th best
score found, and then reads exactly those cells whose bound reaches it. Rows meet queries in blocks, by matrix products. Rows are
appended to the cells; nothing is rebuilt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.models import side_by_side
from tidewatch.operators.ordered import top_per_key
from tidewatch.session import materialise

#: Rows the centroids are fitted to, and the most centroids of an index; both bound what the driver and the tasks hold.
SAMPLE, MOST_CELLS = 20_000, 2_048
#: Rows of one cell that are written by one task; rows of a block, and queries, that meet in one task.
PART_ROWS, BLOCK_ROWS, SLICE_QUERIES = 50_000, 8_192, 4_096
SLACK = 1e-9


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Centroids of a sample: spread-out rows, moved to the means of their rows a few times."""
    c = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(sample, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_gaps(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class VectorIndex:
    """Vectors (key, vector) at a shared folder: `rows` partitioned by cell, `cells` with radius and size per append.

    `metric`: "inner" ranks by the largest inner product, "distance" by the smallest distance (score: minus the distance).
    """

    def __init__(self, spark: SparkSession, base: str, key: str = "vec_id", vector: str = "embedding", metric: str = "inner"):
        self.spark, self.base, self.key, self.vector, self.metric = spark, base, key, vector, metric

    def build(self, corpus: DataFrame, cells: int | None = None) -> VectorIndex:
        """Fit the centroids to a bounded sample picked by a digest of the key, write them, and append all rows."""
        usable = corpus.where(F.col(self.vector).isNotNull())
        if cells is None:
            cells = min(MOST_CELLS, max(1, math.isqrt(usable.count())))
        picked = usable.select(F.col(self.vector).cast("array<double>").alias("v"), F.col(self.key).cast("string").alias("k")).orderBy(
            F.md5("k"), "v").limit(SAMPLE).collect()
        centroids = fit_centroids(np.array([r.v for r in picked]), cells) if picked else np.zeros((0, 0))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").write.parquet(
            f"{self.base}/centroids")
        self.key_type = corpus.schema[self.key].dataType.simpleString()
        self._centroids = centroids
        return self.append(corpus)

    def append(self, rows: DataFrame) -> VectorIndex:
        """Add rows to the cells of their nearest centroids. One pass; the cells' radii grow where they must."""
        centroids, key, key_type = self._centroids, self.key, self.key_type

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = _matrix(b["v"])
                    own = _nearest(x, centroids)
                    yield pd.DataFrame({key: b[key], "v": b["v"], "cell": own, "away": np.sqrt(((x - centroids[own]) ** 2).sum(1))})

        plain = rows.where(F.col(self.vector).isNotNull()).select(key, F.col(self.vector).cast("array<double>").alias("v"))
        placed = materialise(plain.mapInPandas(place, f"{key} {key_type}, v array<double>, cell int, away double"))
        stats = materialise(placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")))
        part = F.pmod(F.xxhash64(key), F.greatest(F.ceil(F.col("n") / PART_ROWS), F.lit(1))).cast("int")
        # a cell's size is a row per cell: at most MOST_CELLS rows travel
        placed.join(F.broadcast(stats), "cell").withColumn("part", part).select(key, "v", "cell", "part").repartition("cell", "part").write.mode(
            "append").partitionBy("cell").parquet(f"{self.base}/rows")
        stats.withColumn("parts", F.greatest(F.ceil(F.col("n") / PART_ROWS), F.lit(1)).cast("int")).write.mode("append").parquet(f"{self.base}/cells")
        return self

    def _cells(self) -> list[tuple[int, float, int, int]]:
        """(cell, radius, rows, parts) of every filled cell: at most MOST_CELLS rows."""
        table = self.spark.read.schema("cell int, radius double, n long, parts int").parquet(f"{self.base}/cells")
        return [tuple(r) for r in table.groupBy("cell").agg(F.max("radius"), F.sum("n"), F.max("parts")).orderBy("cell").collect()]

    def _layout(self) -> Layout:
        cells = self._cells()
        numbers, radius, rows = (np.array([c[i] for c in cells], t) for i, t in ((0, int), (1, float), (2, int)))
        centroids = self._centroids[numbers] if len(cells) else np.zeros((0, 0))
        # cells are dealt to blocks of about BLOCK_ROWS rows; a larger one is dealt to several by the hash of the key
        subs, base, free, room = np.maximum(1, -(-rows // BLOCK_ROWS)), [], 0, 0
        for n, s in zip(rows.tolist(), subs.tolist(), strict=True):
            if s > 1 or n > room:
                base.append(free)
                free, room = free + s, 0 if s > 1 else BLOCK_ROWS - n
            else:
                base.append(free - 1)
                room -= n
        return Layout(numbers, radius, rows, centroids, np.array(base, int), subs, free, self.metric)

    def _blocks(self, vectors: DataFrame, layout: Layout, query_key: str, k: int) -> DataFrame:
        """(query, q, floor, block): the queries beside each block that holds a cell they need. Without a floor those are the cells
        with the best bounds that hold k rows together, each counted without the query itself."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows if len(layout.numbers) else 0, 256):
                    b = whole.slice(at, 256)
                    need = layout.needed(_arrow_matrix(b.column("q")), _floors(b), k)
                    which, cell = np.nonzero(need)
                    width = layout.subs[cell]
                    which, cell = np.repeat(which, width), np.repeat(cell, width)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width)
                    pairs = np.unique(np.stack([which, layout.base[cell] + nth]), axis=1)
                    yield pa.RecordBatch.from_arrays([*(b.column(x).take(pa.array(pairs[0])) for x in (query_key, "q", "floor")), pa.array(
                        pairs[1].astype(np.int32))], [query_key, "q", "floor", "block"])

        kind = vectors.schema[query_key].dataType.simpleString()
        return vectors.mapInArrow(run, f"{query_key} {kind}, q array<double>, floor double, block int")

    def _meet(self, vectors: DataFrame, layout: Layout, n: int, query_key: str, k: int, itself: bool) -> DataFrame:
        """(query, key, score): the k best rows of each query in every block it needs. A task holds a block's rows and a slice of
        the queries; scores are bounded by matrix products, and those that may be among the k best are computed term by term."""
        key, metric = self.key, self.metric
        slices = max(1, -(-n // SLICE_QUERIES))
        parts = max(1, layout.blocks * slices)

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            names = left[query_key]
            empty = pa.table([names.slice(0, 0), right[key].slice(0, 0), pa.array([], pa.float64())], [query_key, key, "score"])
            if not itself:
                right = right.filter(pc.is_valid(right[key]))
            if not left.num_rows or not right.num_rows:
                return empty
            right = right.sort_by([(key, "ascending")])
            v = _arrow_matrix(right["v"])
            keys = pc.unique(right[key])
            code = pc.index_in(right[key], keys).to_numpy()
            most = k if itself else k + int(np.bincount(code).max())  # rows of a query's own key are passed over
            # of equal vectors only the first by key can be found
            same = np.unique(np.ascontiguousarray(v).view(f"V{v.shape[1] * 8}").ravel(), return_inverse=True)[1]
            keep = pd.Series(same).groupby(same).cumcount().to_numpy() < most
            right, v, code = right.filter(pa.array(keep)), v[keep], code[keep]
            own = None if itself else pc.index_in(names.cast(keys.type), keys).fill_null(-1).to_numpy()
            q, floors = _arrow_matrix(left["q"]), _floors(left)
            at, size = np.searchsorted(layout.numbers, right["cell"].to_numpy()), (v * v).sum(1)
            out = []
            for lo in range(0, len(q), 256):
                x, floor = q[lo:lo + 256], floors[lo:lo + 256]
                rough = x @ v.T
                slack = SLACK * (1 + (x * x).sum(1) + size.max())
                if metric != "inner":
                    rough = 2 * rough - (x * x).sum(1)[:, None] - size
                    floor = -floor ** 2
                need = layout.needed(x, floors[lo:lo + 256], k)
                if not need.all():
                    rough[~need[:, at]] = -np.inf
                bar = np.where(np.isnan(floor), -np.inf, floor)
                if len(v) > most and (rough >= (bar - slack)[:, None]).sum() > 64 * len(x):
                    bar = np.fmax(bar, np.partition(rough, -most, axis=1)[:, -most])
                i, j = np.nonzero((rough >= (bar - slack)[:, None]) & (rough > -np.inf))
                if not itself:
                    other = own[lo + i] != code[j]
                    i, j = i[other], j[other]
                score = np.zeros(len(i))
                for d in range(v.shape[1]):
                    a, b = x[i, d], v[j, d]
                    score += a * b if metric == "inner" else (a - b) ** 2
                if metric != "inner":
                    score = -np.sqrt(score)
                order = np.lexsort((j, -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                out.append((lo + i[first], j[first], score[first]))
            i, j, score = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.table([names.take(pa.array(i)), right[key].take(pa.array(j)), pa.array(score)], [query_key, key, "score"])

        places = self.spark.createDataFrame(list(zip(layout.numbers.tolist(), layout.base.tolist(), layout.subs.tolist(), strict=True)),
                                            "cell int, base int, subs int")
        rows = self.spark.read.schema(f"{key} {self.key_type}, v array<double>, cell int").parquet(f"{self.base}/rows")
        rows = rows.join(F.broadcast(places), "cell").select(  # a row per cell: at most MOST_CELLS
            key, "v", "cell", (F.col("base") + F.pmod(F.xxhash64(key), F.col("subs"))).cast("int").alias("block"))
        rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(parts, "block", "slice")
        asked = self._blocks(vectors, layout, query_key, k).withColumn("slice", F.pmod(F.xxhash64(query_key), F.lit(slices)).cast("int"))
        kind = vectors.schema[query_key].dataType.simpleString()
        return asked.repartition(parts, "block", "slice").groupBy("block", "slice").cogroup(rows.groupBy("block", "slice")).applyInArrow(
            meet, f"{query_key} {kind}, {key} {self.key_type}, score double")

    def search(self, queries: DataFrame, k: int = 5, query_key: str = "query_id", query_vector: str = "query_vector",
               itself: bool = True) -> tuple[DataFrame, DataFrame]:
        """Exactly the k best rows of every query: (query, key, score, rank); ties by key. And (query, cells_read, cells).

        `itself` false leaves out the row whose key equals the query's. Queries are a table of any size. The first pass reads the
        cells with the best bounds and gives each query a floor; the second reads all cells whose bound reaches it.
        """
        vectors = materialise(queries.where(F.col(query_vector).isNotNull()).select(
            query_key, F.col(query_vector).cast("array<double>").alias("q"), F.lit(None).cast("double").alias("floor")))
        n, layout = vectors.count(), self._layout()
        best = [F.desc("score"), F.col(self.key)]
        if not layout.blocks:
            none = vectors.select(query_key, F.lit(None).cast(self.key_type).alias(self.key), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
            return none.limit(0), vectors.select(query_key, F.lit(0).alias("cells_read"), F.lit(0).alias("cells")).limit(0)
        one = top_per_key(self._meet(vectors, layout, n, query_key, k, itself), [query_key], best, k, name="rank")
        floor = one.groupBy(query_key).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        known = materialise(vectors.drop("floor").join(floor, query_key, "left").select(query_key, "q", F.coalesce("floor", F.lit(-math.inf)).alias("floor")))
        two = self._meet(known, layout, n, query_key, k, itself)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    q = _arrow_matrix(b.column("q"))
                    read = (layout.needed(q, _floors(b), k) | layout.needed(q, np.full(len(q), np.nan), k)).sum(1)
                    yield pa.RecordBatch.from_arrays([b.column(query_key), pa.array(read), pa.array(np.full(len(q), len(layout.numbers)))],
                                                     [query_key, "cells_read", "cells"])

        kind = vectors.schema[query_key].dataType.simpleString()
        return top_per_key(two, [query_key], best, k, name="rank"), known.mapInArrow(told, f"{query_key} {kind}, cells_read long, cells long")


class Layout(NamedTuple):
    """The filled cells of an index (at most MOST_CELLS), and the blocks that their rows are dealt to for a search."""

    numbers: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    centroids: np.ndarray
    base: np.ndarray
    subs: np.ndarray
    blocks: int
    metric: str

    def needed(self, q: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
        """Which cells each query has to read: those whose best possible score reaches its floor; without a floor (nan) the cells with
        the best bounds that hold k rows together, each counted without the query itself."""
        if self.metric == "inner":
            bound = q @ self.centroids.T + np.sqrt((q * q).sum(1))[:, None] * self.radius
        else:
            bound = -np.maximum(_gaps(q, self.centroids) - self.radius, 0)
        bound = bound + SLACK * (1 + np.abs(bound))
        out = bound >= floor[:, None]
        open_ = np.isnan(floor)
        if open_.any():
            order = np.argsort(-bound[open_], axis=1, kind="stable")
            before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
            first = np.empty(order.shape, bool)
            np.put_along_axis(first, order, before < k + 1, 1)
            out[open_] = first
        return out


def _arrow_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _floors(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return b.column("floor").cast(pa.float64()).fill_null(math.nan).to_numpy()


def interpolate(df: DataFrame, key: str, vector: str, label: str, base: str, neighbours: int = 5, seed: int = 0) -> DataFrame:
    """New rows that bring every class up to the largest: (label, key, copy_no, vector), each between a row and one of its exact
    `neighbours` nearest rows of its class. Classes are few; each has an index of its own, and a row of a class of one stays alone."""
    spark = df.sparkSession
    sizes = [tuple(r) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()]
    most = max((n for _, n in sizes), default=0)

    def one(case: tuple) -> DataFrame:
        j, name, n = case
        rows = df.where(F.col(label) == name).select(key, F.col(vector).cast("array<double>").alias(vector))
        near = materialise(nearest(spark, rows, key, vector, f"{base}/class-{j}", neighbours))
        return _between(rows, near, key, vector, most - n, n, seed).withColumn(label, F.lit(name))

    made = side_by_side(spark, one, [(j, name, n) for j, (name, n) in enumerate(sizes) if n not in (most, 1) and name is not None])
    if not made:
        return df.select(label, key, F.lit(1).alias("copy_no"), F.col(vector).cast("array<double>").alias(vector)).limit(0)
    return reduce(DataFrame.unionByName, made).select(label, key, "copy_no", vector)


def nearest(spark: SparkSession, rows: DataFrame, key: str, vector: str, base: str, k: int) -> DataFrame:
    """(key, neighbour, rank): the exact k nearest other rows of every row; ties by key."""
    index = VectorIndex(spark, base, key, vector, "distance").build(rows)
    asked = rows.select(F.col(key).alias("_asked"), F.col(vector).alias("_vector"))
    found, _ = index.search(asked, k, "_asked", "_vector", itself=False)
    return found.select(F.col("_asked").alias(key), F.col(key).alias("neighbour"), "rank", (-F.col("score")).alias("gap"))


def _between(rows: DataFrame, near: DataFrame, key: str, vector: str, missing: int, size: int, seed: int) -> DataFrame:
    digest = lambda *salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), *salt, F.lit(str(seed)))), 1, 12), 16, 10).cast(
        "double") / float(1 << 48)
    # the first `missing % size` rows by digest make one copy more; rows are ranked in slices of the key's hash, each with its share
    slices = max(1, size // 100_000 + 1)
    ranked = rows.select(key, vector).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")).withColumn("_u", F.md5(
        F.col(key).cast("string")))
    counts = ranked.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_s", before.alias("_off"))  # a row per slice of 100,000 rows
    placed = ranked.withColumn("_local", F.row_number().over(Window.partitionBy("_s").orderBy("_u", key))).join(offsets, "_s")
    copies = F.lit(missing // size) + (F.col("_off") + F.col("_local") <= missing % size).cast("int")
    made = placed.withColumn("_c", copies).where("_c > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_c"))))
    n_near = near.groupBy(key).agg(F.max("rank").alias("_k"))
    asked = made.select(key, vector, "copy_no").join(n_near, key).withColumn(
        "rank", (F.floor(digest(F.col("copy_no").cast("string"), F.lit("pick")) * F.col("_k")) + 1).cast("int"))
    other = rows.select(F.col(key).alias("neighbour"), F.col(vector).alias("_o"))
    picked = asked.join(near.select(key, "rank", "neighbour"), [key, "rank"]).join(other, "neighbour")
    t = digest(F.col("copy_no").cast("string"), F.lit("place"))
    return picked.withColumn("_t", t).select(key, "copy_no", F.zip_with(vector, "_o", lambda a, b: a + (b - a) * F.col("_t")).alias(vector))
