"""Gradient-boosted trees over binned rows: Spark's own algorithm (logistic loss, variance gain, leaves of mean residuals, a validation
column that ends training), with one small job per level of a tree.

Rows are binned once and stay as blocks of packed codes: features with few values, such as flags, share a code, so a level sums a
row once per code and not once per feature. Sums per node and bin are all that leaves a task. Of two children only the smaller is
summed; the other is their parent less it.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize, HasValidationIndicatorCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import ensure_checkpoint_dir, side_by_side

#: Values of one packed code; rows of a block as built and as kept; trees between two checkpoints; bytes of sums gathered directly.
CODES, BUILT, KEPT, CUT, DIRECT = 2048, 16_384, 65_536, 25, 16 << 20


class _TreeParams(HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize, HasValidationIndicatorCol, HasWeightCol):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows a tree learns from", TypeConverters.toFloat)
    validationTol = Param(Params._dummy(), "validationTol", "least relative gain on the validation rows", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(maxIter=20, stepSize=0.1, maxDepth=5, maxBins=32, minInstancesPerNode=1, subsamplingRate=1.0, validationTol=0.01)


class BoostedTrees(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Drop-in for GBTClassifier with 0/1 labels; columns and defaults are the same."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", seed=42, maxIter=20, stepSize=0.1, maxDepth=5, maxBins=32,
                 minInstancesPerNode=1, subsamplingRate=1.0, validationTol=0.01):
        super().__init__()
        self._set(**self._input_kwargs)

    def setWeightCol(self, value: str) -> BoostedTrees:
        return self._set(weightCol=value)

    def setValidationIndicatorCol(self, value: str) -> BoostedTrees:
        return self._set(validationIndicatorCol=value)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        return fit_together([self], [dataset])[0]

    def plan(self, dataset: DataFrame) -> Fit:
        """The rows a fit reads, its bins and its settings."""
        flag, weighted = self.isDefined(self.validationIndicatorCol), self.isDefined(self.weightCol)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"),
            (F.col(self.getWeightCol()).cast("double") if weighted else F.lit(1.0)).alias("w"),
            (F.col(self.getValidationIndicatorCol()) if flag else F.lit(False)).alias("held"))
        bins = Bins(cut_points(rows, self.getOrDefault(self.maxBins)))
        return Fit(rows, bins, flag, weighted, *[self.getOrDefault(p) for p in (
            "maxIter", "maxDepth", "stepSize", "minInstancesPerNode", "subsamplingRate", "validationTol", "seed")])

    def model(self, trees: list[dict]) -> BoostedTreesModel:
        out = BoostedTreesModel()
        out._resetUid(self.uid)
        return out._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), trees=json.dumps(trees))


class BoostedTreesModel(Model, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction, probability and prediction, as a GBTClassificationModel does."""

    trees = Param(Params._dummy(), "trees", "weight, feature, threshold and leaf values of every tree, as JSON", TypeConverters.toString)

    @property
    def treeWeights(self) -> list[float]:
        return [t["weight"] for t in json.loads(self.getOrDefault(self.trees))]

    @property
    def getNumTrees(self) -> int:
        return len(self.treeWeights)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = self.getOrDefault(self.trees)

        @F.pandas_udf("double")
        def margins(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            # an inner node's feature and threshold in heap order; leaf values of the last level
            trees = [(t["weight"], *[np.array(t[c]) for c in ("feature", "threshold", "value")]) for t in json.loads(text)]
            for part in parts:
                n = len(part)
                flat = (np.stack(part.to_numpy()) if n else np.zeros((0, 1))).T.ravel()
                row, out = np.arange(n), np.zeros(n)
                for weight, feature, threshold, value in trees:
                    at = np.zeros(n, np.int64)
                    while len(feature) and n and at[0] < len(feature):  # all rows stand on one level
                        at = 2 * at + 2 - (flat.take(feature.take(at) * n + row) <= threshold.take(at))
                    out += weight * value.take(at - len(feature))
                yield pd.Series(out)

        out = dataset.withColumn("_margin", margins(vector_to_array(self.getFeaturesCol())))
        p = 1 / (1 + F.exp(-2 * F.col("_margin")))
        return out.withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))),
            "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (F.col("_margin") > 0).cast("double")}).drop("_margin")


# ---------------------------------------------------------------- bins and blocks
def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def cut_points(rows: DataFrame, most: int) -> list[np.ndarray]:
    """Per feature the thresholds between its bins: midpoints of all its values where they are at most `most`, else quantiles. Learned
    from all rows that are not held."""
    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for x in (_matrix(b) for b in batches if b.num_rows):
            for f in range(x.shape[1]):
                if seen.get(f, ()) is not None:
                    found = np.union1d(seen.get(f, x[:0, 0]), x[:, f])
                    seen[f] = found if len(found) <= most else None  # too many values: only the fact is passed on
        pairs = [(f, v) for f, s in seen.items() for v in ([None] if s is None else s.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in pairs], pa.int32()), pa.array([v for _, v in pairs], pa.float64())], ["f", "v"])

    train = rows.where("NOT held").select("x")
    seen = {}
    for r in train.mapInArrow(values, "f int, v double").distinct().collect():
        seen.setdefault(r.f, []).append(r.v)
    wide = [f for f, s in seen.items() if None in s or len(s) > most]
    cuts = {f: np.sort(s) for f, s in seen.items() if f not in wide}
    cuts = {f: (s[1:] + s[:-1]) / 2 for f, s in cuts.items()}
    if wide:
        at = [i / most for i in range(1, most)]
        found = train.agg(*[F.percentile_approx(F.col("x")[f], at, 100 * most).alias(str(f)) for f in wide]).first()
        cuts |= {f: np.unique(found[str(f)]) for f in wide}
    return [cuts[f] for f in range(len(cuts))]


class Bins:
    """Thresholds per feature, and the packing of features with at least two bins into codes: (feature, bins, stride) per code."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts, self.codes, size = cuts, [[]], 1
        for f, c in enumerate(cuts):
            n = len(c) + 1
            if n > 1:
                if size * n > CODES and self.codes[-1]:
                    self.codes.append([])
                    size = 1
                self.codes[-1].append((f, n, size))
                size *= n
        self.sizes = [c[-1][1] * c[-1][2] if c else 1 for c in self.codes]
        self.place = {f: (g, n, stride) for g, c in enumerate(self.codes) for f, n, stride in c}
        self.width = sum(n for _, n, _ in self.place.values())

    def pack(self, x: np.ndarray) -> list[np.ndarray]:
        bins = lambda f: np.searchsorted(self.cuts[f], x[:, f])  # a value on a threshold stays left; NaN goes right
        return [sum((bins(f) * stride for f, _, stride in c), np.zeros(len(x), np.int64)).astype(np.uint16) for c in self.codes]

    def by_feature(self, sums: list[np.ndarray]) -> np.ndarray:
        """(nodes, all bins of all features) from (nodes, code) per code."""
        return np.hstack([sums[g].reshape(len(sums[g]), -1, n, stride).sum((1, 3)) for g, n, stride in self.place.values()]
                         or [np.zeros((len(sums[0]), 0))])

    def tables(self, level: list[tuple[int, int, int]], nodes: int) -> dict[int, np.ndarray]:
        """Per code that a level's splits (node, feature, last bin on the left) use: 1 where a node sends a code to the right."""
        out = {}
        for node, f, last in level:
            g, n, stride = self.place[f]
            table = out.setdefault(g, np.zeros((nodes, self.sizes[g]), np.int8))
            table[node] = np.arange(self.sizes[g]) // stride % n > last
        return out


def packed(i: int, rows: DataFrame, bins: Bins, weighted: bool) -> DataFrame:
    """The rows of fit i as pickled blocks of codes, labels of -1 and 1, and weights or None."""
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = {False: [], True: []}
        number = TaskContext.get().partitionId() << 24

        def emit(held):
            nonlocal number
            number += 1
            codes, y, w = zip(*waiting[held])
            waiting[held] = []
            block = ([np.concatenate(c) for c in zip(*codes)], np.concatenate(y), np.concatenate(w) if weighted else None)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([held]), pa.array([pickle.dumps(block, 5)], pa.binary())],
                                              ["number", "held", "block"])

        for b in (b for b in batches if b.num_rows):
            x, held = _matrix(b), b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            y = np.where(b.column("y").to_numpy() > 0.5, 1, -1).astype(np.int8)
            w, codes = b.column("w").to_numpy(), bins.pack(x)
            for part in (False, True):
                rows_of = np.flatnonzero(held == part)
                if len(rows_of):
                    waiting[part].append(([c[rows_of] for c in codes], y[rows_of], w[rows_of]))
                    if sum(len(p[1]) for p in waiting[part]) >= BUILT:
                        yield emit(part)
        yield from (emit(part) for part in (False, True) if waiting[part])

    return rows.mapInArrow(build, "number long, held boolean, block binary").withColumn("fit", F.lit(i))


def dealt(blocks: DataFrame) -> RDD:
    """Blocks (fit, number, held, codes, labels, weights or None, margins of zero) of up to KEPT rows, dealt over the cores."""
    def join(rows: Iterable) -> Iterator[tuple]:
        def whole(parts):
            codes, y, w = zip(*parts)
            y = np.concatenate(y)
            return [np.concatenate(c) for c in zip(*codes)], y, None if w[0] is None else np.concatenate(w), np.zeros(len(y))

        kind, number, waiting = None, 0, []
        for r in sorted(rows, key=lambda r: (r.fit, r.held, r.number)):  # the order of a shuffle's pieces may change
            if waiting and (kind != (r.fit, r.held) or sum(len(p[1]) for p in waiting) >= KEPT):
                yield (kind[0], number, kind[1], *whole(waiting))
                waiting = []
            if not waiting:
                kind, number = (r.fit, r.held), r.number
            waiting.append(pickle.loads(r.block))
        if waiting:
            yield (kind[0], number, kind[1], *whole(waiting))

    return blocks.repartition(blocks.sparkSession.sparkContext.defaultParallelism).rdd.mapPartitions(join)


# ---------------------------------------------------------------- training
def _nodes(codes: list[np.ndarray], tables: list[dict[int, np.ndarray]]) -> np.ndarray:
    """Each row's node on the level below the given ones; a node without a split passes its rows to the left."""
    node = np.zeros(len(codes[0]), np.int64)
    for table in tables:
        right = 0
        for g, t in table.items():
            right = right + t.ravel().take(node * t.shape[1] + codes[g])
        node = 2 * node + right
    return node


def _step(grown: dict[int, tuple]):
    """Blocks of the fits in `grown` with one more tree (bins, levels, values, weight) in their margins; others are dropped."""
    def add(parts: Iterable[tuple]) -> Iterator[tuple]:
        prepared = {i: [bins.tables(level, 1 << d) for d, level in enumerate(levels)] for i, (bins, levels, *_) in grown.items()}
        for i, number, held, codes, y, w, margin in parts:
            if i in grown:
                *_, values, weight = grown[i]
                yield i, number, held, codes, y, w, margin + weight * values.take(_nodes(codes, prepared[i]))
    return add


class Wanted:
    """What a fit asks of its rows: sums at the nodes of the level below `levels` that have a slot. Before a tree's first level
    `grown` is the tree before it."""

    def __init__(self, fit: Fit, done: int, levels: list, slots: np.ndarray, grown: tuple | None = None):
        self.bins, self.weighted, self.rate, self.seed = fit.bins, fit.weighted, fit.sampled, (fit.seed + done) & 0xFFFFFFFF
        self.first, self.levels, self.slots, self.grown = not done, levels, slots, grown
        self.nodes = int(slots.max()) + 1
        self.bytes = 8 * (3 if fit.weighted else 2) * self.nodes * (fit.bins.width + 1)


def _sums(wanted: dict[int, Wanted]):
    """Per task and fit: rows, weights (where given) and weighted residuals by node and bin; and loss and weight of the held rows."""
    def run(parts: Iterable[tuple]) -> Iterator[dict]:
        prepared = {i: [q.bins.tables(level, 1 << d) for d, level in enumerate(q.levels)] for i, q in wanted.items()}
        sums = {i: [[np.zeros(q.nodes * size) for size in q.bins.sizes] for _ in range(3 if q.weighted else 2)] for i, q in wanted.items()}
        error = {i: np.zeros(2) for i in wanted}
        for i, number, held, codes, y, w, margin in parts:
            if i not in wanted:
                continue
            q = wanted[i]
            if held:
                if not q.levels:
                    e = 2 * np.logaddexp(0, -2 * y * margin)
                    error[i] += (e.sum(), len(y)) if w is None else ((e * w).sum(), w.sum())
                continue
            slot = q.slots.take(_nodes(codes, prepared[i]))
            use = slot >= 0
            if q.rate < 1:
                use &= np.random.default_rng([q.seed, number]).random(len(y), np.float32) < q.rate
            at = np.flatnonzero(use)
            slot, target = slot.take(at), y.take(at).astype(np.float64)
            if not q.first:
                target = 4 * target / (1 + np.exp(2 * target * margin.take(at)))
            if w is not None:
                w = w.take(at)
                target *= w
            for g, size in enumerate(q.bins.sizes):
                key = slot * size + codes[g].take(at)
                for total, values in zip(sums[i], (None, target, w)):
                    total[g] += np.bincount(key, values, q.nodes * size)

        def tabled(q, total):  # a node's sum over all its rows, then by bin
            total = [t.reshape(q.nodes, -1) for t in total]
            return np.hstack([total[0].sum(1, keepdims=True), q.bins.by_feature(total)])

        out = {}
        for i, q in wanted.items():
            rows, residuals, *weights = [tabled(q, total) for total in sums[i]]
            out[i] = np.stack([rows, *weights, residuals]), error[i]
        yield out
    return run


def _splits(bins: Bins, sums: np.ndarray, least: int) -> list[tuple | None]:
    """Per node the best split by variance gain (feature, last bin on the left, value left, value right, rows left); None for a leaf.
    Among equal gains the first feature and bin win. `sums`: rows, weights (where given) and residuals by node and bin."""
    if not bins.width:
        return [None] * sums.shape[1]
    total, parts = sums[:, :, :1], sums[:, :, 1:]
    sizes = np.array([n for _, n, _ in bins.place.values()])
    ends = np.cumsum(sizes)
    left = np.cumsum(parts, 2)
    before = np.concatenate([np.zeros((*left.shape[:2], 1)), left[:, :, ends[:-1] - 1]], 2)
    left = left - np.repeat(before, sizes, 2)
    right = total - left
    (n_l, w_l, s_l), (n_r, w_r, s_r), (_, w, s) = [(a[0], a[-2], a[-1]) for a in (left, right, total)]
    allowed = (n_l >= max(least, 1)) & (n_r >= max(least, 1))
    allowed[:, ends - 1] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, (s_l ** 2 / w_l + s_r ** 2 / w_r - s ** 2 / w) / w, -1.0)
    best = gain.max(1)
    at = np.argmax(gain >= best[:, None] * (1 - 1e-9), 1)
    owner, last = np.repeat(list(bins.place), sizes), np.concatenate([np.arange(n) for n in sizes])
    return [(int(owner[b]), int(last[b]), s_l[i, b] / w_l[i, b], s_r[i, b] / w_r[i, b], n_l[i, b]) if best[i] > 1e-14 else None
            for i, b in enumerate(at)]


def _gather(state: RDD, wanted: dict[int, Wanted]) -> dict[int, tuple]:
    """The sums of all tasks; through a tree of tasks where they are large."""
    add = lambda a, b: {i: (a[i][0] + b[i][0], a[i][1] + b[i][1]) for i in a}
    parts, size = state.mapPartitions(_sums(wanted)), sum(q.bytes for q in wanted.values())
    return parts.treeReduce(add) if size * state.getNumPartitions() > DIRECT else reduce(add, parts.collect())


def _release(state: RDD) -> None:
    """Let go of blocks that a later state has replaced, and of their checkpoint."""
    state.unpersist()
    if name := state.getCheckpointFile():
        where = state.ctx._jvm.org.apache.hadoop.fs.Path(name)
        where.getFileSystem(state.ctx._jsc.hadoopConfiguration()).delete(where, True)


def fit_together(estimators: list[BoostedTrees], tables: list[DataFrame]) -> list[BoostedTreesModel]:
    """One model per estimator and its table. All fits go tree by tree together and share each job, for a job costs more than a
    level's sums where rows are few. A fit that has ended leaves the blocks."""
    spark = tables[0].sparkSession
    ensure_checkpoint_dir(spark)
    fits = side_by_side(spark, lambda case: case[0].plan(case[1]), list(zip(estimators, tables)))
    blocks = reduce(DataFrame.unionByName, [packed(i, f.rows, f.bins, f.weighted) for i, f in enumerate(fits)])
    state, old, done = dealt(blocks).persist(StorageLevel.MEMORY_AND_DISK), [], 0
    running, trees = {i: f.run() for i, f in enumerate(fits)}, {}
    wanted = {i: next(g) for i, g in running.items()}
    try:
        while wanted:
            now = {i: q for i, q in wanted.items() if q.levels}
            if not now:  # all stand before a new tree
                now = wanted
                if grown := {i: q.grown for i, q in wanted.items() if q.grown}:
                    old.append(state)
                    state, done = state.mapPartitions(_step(grown)).persist(StorageLevel.MEMORY_AND_DISK), done + 1
                if done % CUT == 0:
                    state.checkpoint()  # cuts the chain of former states
            for i, sums in _gather(state, now).items():
                try:
                    wanted[i] = running[i].send(sums)
                except StopIteration as end:
                    trees[i] = end.value
                    del wanted[i]
            for s in old:
                _release(s)
            old = []
    finally:
        for s in [*old, state]:
            _release(s)
    return [e.model(trees[i]) for i, e in enumerate(estimators)]


@dataclass
class Fit:
    rows: DataFrame
    bins: Bins
    validate: bool
    weighted: bool
    trees: int
    depth: int
    rate: float
    least: int
    sampled: float
    tol: float
    seed: int

    def run(self) -> Generator[Wanted, tuple, list[dict]]:
        """Asks for sums; returns the trees up to the best on the held rows, as dicts of weight, feature, threshold and value."""
        fitted, best, lowest, grown, validate = [], 0, 0.0, None, self.validate
        while len(fitted) < self.trees or validate:
            first, (loss, mass) = yield Wanted(self, len(fitted), [], np.array([0]), grown)  # also the error of the trees there are
            validate = validate and mass > 0  # without a held row all trees are kept
            if validate and fitted:
                error = loss / mass
                if best and lowest - error < self.tol * max(error, 0.01):
                    break
                if not best or error < lowest:
                    best, lowest = len(fitted), error
            if len(fitted) == self.trees:
                break
            levels, values = yield from _tree(self, len(fitted), first)
            weight = self.rate if fitted else 1.0
            fitted.append(_flat(self.bins, levels, values, weight))
            grown = (self.bins, levels, values, weight)
        return fitted[:best] if validate else fitted


def _tree(fit: Fit, done: int, first: np.ndarray) -> Generator[Wanted, tuple, tuple[list, np.ndarray]]:
    """Splits per level (node, feature, last bin on the left), and the values of the nodes below the last level."""
    bins, depth, least = fit.bins, fit.depth, fit.least
    weight, residual = first[-2, 0, 0], first[-1, 0, 0]
    levels, values, opened = [], np.array([residual / weight if weight else 0.0]), {0: first[:, 0]}
    while opened and len(levels) < depth:
        nodes = sorted(opened)
        found = dict(zip(nodes, _splits(bins, np.stack([opened[n] for n in nodes], 1), least)))
        level = [(n, *s[:2]) for n, s in found.items() if s]
        if not level:
            break
        levels.append(level)
        values = np.repeat(values, 2)
        small, slots = {}, np.full(len(values), -1)
        for n, f, last in level:
            *_, values[2 * n], values[2 * n + 1], left = found[n]
            rows = opened[n][0, 0]
            if max(left, rows - left) >= 2 * least:  # a child may be split further
                small[n] = 2 * n + int(rows - left < left)
                slots[small[n]] = len(small) - 1
        if not small or len(levels) == depth:
            break
        below, _ = yield Wanted(fit, done, list(levels), slots)
        pairs = {n: (child, below[:, slots[child]]) for n, child in small.items()}
        opened = {c: s for n, (child, s) in pairs.items() for c, s in ((child, s), (child ^ 1, opened[n] - s)) if s[0, 0] >= 2 * least}
    return levels, values


def _flat(bins: Bins, levels: list, values: np.ndarray, weight: float) -> dict:
    """A tree in heap order; a node without a split sends its rows anywhere, and all leaves below it have its value."""
    inner = (1 << len(levels)) - 1
    feature, threshold, value = [0] * inner, [float("inf")] * inner, values.tolist()
    split = {(d, n) for d, level in enumerate(levels) for n, _, _ in level}
    for d, level in enumerate(levels):
        for n, f, last in level:
            feature[(1 << d) - 1 + n], threshold[(1 << d) - 1 + n] = f, float(bins.cuts[f][last])
        span = len(value) >> d  # leaves below a node of this level
        for n in range(1 << d):
            if (d, n) not in split:
                value[n * span:(n + 1) * span] = [value[n * span]] * span
    return {"weight": weight, "feature": feature, "threshold": threshold, "value": value}
