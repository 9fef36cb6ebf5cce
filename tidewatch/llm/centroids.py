"""Centroid clustering in exact integers, with ns-bounds that let most vectors skip most rounds.

Every vector keeps its centroid, an upper bound of the distance to it, a lower bound of the distance to all others, and for each
bound the round in which it was last evaluated. All former centroids are retained (rounds x centroids rows), so a stored bound
is loosened by the norm of the centroid's total displacement since that round, which is never more than the sum of the drifts
of the rounds between. A vector whose bounds stay apart keeps its centroid; the others are evaluated exactly, first against
their own centroid, then against all.

A round is one pass over one table: vectors with their bounds are read, tested and written for the next round, and vectors that
change their centroid leave their difference in a few extra rows, which Spark sums to one row per centroid and component. No
vector is shuffled. A round's table is removed as soon as the next one is written, so two exist at most.

Null, repeated and odd input: vectors that are null, of another length, or with a null or non-finite component are left out;
a null vec_id is hashed as the text `null`; repeated rows are vectors of their own; equal hashes are ordered by the components;
with fewer vectors than centroids there are fewer centroids; equal distances go to the smaller number; other columns are
ignored; an empty table gives no rows. Components of 2^25 and more after scaling raise an error: their squared distances would
not fit into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import ensure_checkpoint_dir, materialise, shared_dir

STATE = "vec_id long, vector array<int>, cluster int, upper double, lower double, upper_at int, lower_at int, moved array<long>"
LARGEST = 1 << 25
#: Vectors evaluated at once; bounds the memory of a task.
BLOCK = 4096


def kept_vectors(vectors: DataFrame, components: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the scaled, floored components of the vectors that have all of them."""
    x = F.col(vector_col)
    fine = (F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    scaled = F.transform(x.cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))))
    checked = F.transform(scaled, lambda v: F.when(F.abs(v) >= LARGEST, F.raise_error(F.lit("component out of range")).cast("int"))
                          .otherwise(v.cast("int")))
    return vectors.where(x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), checked.alias("vector"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of `seed:vec_id`: k rows on the driver."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = kept.select(F.sha2(name, 256).alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 52:  # all sums are exact in doubles, so the product may run as one
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids.astype(np.int64)], 1)


class Displacements:
    """How far centroids have gone since each round: one number per round and centroid."""

    def __init__(self, history: np.ndarray):
        self.now = history[-1]
        self.norm = np.sqrt(((history - history[-1]).astype(np.float64) ** 2).sum(2))
        order = np.sort(self.norm, 1)
        self.most, self.second, self.which = order[:, -1], order[:, -2] if order.shape[1] > 1 else 0 * order[:, -1], self.norm.argmax(1)

    def own(self, cluster: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.norm[at, cluster]

    def others(self, cluster: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The largest displacement among the centroids other than the given one."""
        return np.where(self.which[at] == cluster, self.second[at], self.most[at])


def evaluate(x: np.ndarray, state: dict[str, np.ndarray], history: np.ndarray, since: Displacements, last: bool) -> np.ndarray:
    """One round for a block: update the state in place, and give the exact distance to the own centroid where `last` asks for it.

    state: cluster (-1 before the first round), upper, lower, upper_at, lower_at.
    """
    rounds, centroids = len(history) - 1, history[-1]
    cluster = state["cluster"]
    fresh = cluster < 0
    own = np.maximum(cluster, 0)
    upper = state["upper"] + since.own(own, state["upper_at"])
    lower = state["lower"] - since.others(own, state["lower_at"])

    def unsure(u: np.ndarray, low: np.ndarray) -> np.ndarray:
        return u + 1e-9 * (1 + u + np.abs(low)) >= low  # the margin covers rounding; ties are always evaluated

    todo = np.flatnonzero(~fresh & unsure(upper, lower))
    exact = np.zeros(len(x), np.int64)
    tight = np.arange(len(x)) if last else todo
    if len(tight):
        d = ((x[tight].astype(np.int64) - centroids[own[tight]]) ** 2).sum(1)
        exact[tight] = d
        state["upper"][tight], state["upper_at"][tight] = np.sqrt(d.astype(np.float64)), rounds
    todo = todo[unsure(state["upper"][todo], lower[todo])]
    todo = np.concatenate([np.flatnonzero(fresh), todo])
    for at in range(0, len(todo), BLOCK):
        rows = todo[at:at + BLOCK]
        d = squared_distances(x[rows], centroids)
        best = d.argmin(1)  # the first of equals: the smaller number
        exact[rows] = d[np.arange(len(rows)), best]
        state["cluster"][rows], state["upper"][rows] = best, np.sqrt(exact[rows].astype(np.float64))
        d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        state["lower"][rows] = np.sqrt(d.min(1).astype(np.float64)) if d.shape[1] > 1 else np.inf
        state["upper_at"][rows] = state["lower_at"][rows] = rounds
    return exact


def _round(history: np.ndarray, last: bool, stated: bool):
    """Read vectors (with their bounds if `stated`), give them with new bounds; or in the last round their final cluster."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        since, (k, m) = Displacements(history), history.shape[1:]
        moved = np.zeros((k, m + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, m)
            if stated:
                state = {c: b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower", "upper_at", "lower_at")}
            else:
                n = b.num_rows
                state = {"cluster": np.full(n, -1, np.int32), "upper": np.zeros(n), "lower": np.zeros(n),
                         "upper_at": np.zeros(n, np.int32), "lower_at": np.zeros(n, np.int32)}
            before = state["cluster"].copy()
            exact = evaluate(x, state, history, since, last)
            if last:
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(state["cluster"]), pa.array(exact)],
                                                 ["vec_id", "cluster", "distance"])
                continue
            changed = np.flatnonzero(before != state["cluster"])
            rows = np.column_stack([np.ones(len(changed), np.int64), x[changed].astype(np.int64)])
            np.add.at(moved, state["cluster"][changed], rows)
            known = before[changed] >= 0
            np.subtract.at(moved, before[changed][known], rows[known])
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("vector"), *(pa.array(state[c]) for c in ("cluster", "upper", "lower", "upper_at", "lower_at")),
                 pa.nulls(b.num_rows, pa.list_(pa.int64()))],
                ["vec_id", "vector", "cluster", "upper", "lower", "upper_at", "lower_at", "moved"])
        if not last and moved.any():
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), pa.array([moved.ravel().tolist()], pa.list_(pa.int64()))],
                                             ["vec_id", "vector", "cluster", "upper", "lower", "upper_at", "lower_at", "moved"])

    return run


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate of this run; it lies in the shared checkpoint folder."""
    if not path.startswith(ensure_checkpoint_dir(spark)):
        raise ValueError(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, seed: int = 3,
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every kept vector after `rounds` rounds, and the final centroids."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, components, scale, id_col, vector_col)
    history = first_centroids(kept, k, seed)[None]
    if not history.size:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, components), np.int64)
    totals = np.zeros((history.shape[1], components + 1), np.int64).astype(object)
    source, path = kept, None
    for _ in range(rounds):
        following = shared_dir(spark, "centroids")
        source.mapInArrow(_round(history, False, path is not None), STATE).write.parquet(following)
        if path:
            remove_table(spark, path)
        path = following
        table = spark.read.schema(STATE).parquet(path)
        sums = table.where("moved IS NOT NULL").select(F.posexplode("moved").alias("pos", "v")).groupBy("pos").agg(
            F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # one row per centroid and component
        for r in sums:
            totals[divmod(r.pos, components + 1)] += int(r.v)
        new = history[-1].copy()
        for j, row in enumerate(totals):
            if row[0]:
                new[j] = [int(s) // int(row[0]) for s in row[1:]]
        history = np.concatenate([history, new[None]])
        source = table.where("moved IS NULL").drop("moved")
    result = source.mapInArrow(_round(history, True, path is not None), "vec_id long, cluster int, distance long")
    return result, history[-1]


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """The clusters with their inertia, the whole inertia and each cluster's centroid digest."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, **options)
    found = materialise(found)
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())],
                                    "cluster int, centroid_sha256 string")
    per = per.join(F.broadcast(digests), "cluster")
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # at most one row per centroid
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Plain rounds: every vector against every centroid."""
    ctes = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
            f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS j, x FROM (
        SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""]
    for t in range(rounds + 1):
        ctes.append(f"""a{t} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(j, (d, j)) AS j FROM (
        SELECT v.r, c.j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM v CROSS JOIN c{t} c) GROUP BY r)""")
        if t < rounds:
            ctes.append(f"""s{t} AS (SELECT j, i, sum(e)::BIGINT AS s, count(*) AS n FROM (
        SELECT a.j, unnest(v.x) AS e, unnest(range(64)) AS i FROM v JOIN a{t} a USING (r)) GROUP BY j, i),
        m{t} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{t} GROUP BY j),
        c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m USING (j))""")
    return f"""WITH {", ".join(ctes)}
        SELECT v.vec_id, a.j AS "cluster", a.d AS distance,
          CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.j"""
