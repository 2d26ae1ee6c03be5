"""Second-order boosted trees on histograms, with Poisson, softmax and squared loss.

Inputs are binned once to one byte each, at quantiles, and written as blocks of rows, which are dealt evenly over the cores; the
fit goes over these blocks, kept as numpy arrays by column by the executors, which read them again if one is lost. A level of all trees of a round is one job: each task
adds gradients and curvatures of its rows by node, input and bin, the tables of fixed size are summed as a tree, and the
driver picks the splits. An RDD serves that loop as it does Spark's own iterative learners: a job per level then costs a third
of one that is planned as a query. Every ``CUT`` rounds the margins are computed into the blocks, so a task only goes through
the trees since then.

Each round takes a share of the rows, by a hash of their key and the round, and a share of the inputs, so a fit depends on
neither partitions nor order. Ties between splits go to the first input and the lowest bin. A node without a split that
gains keeps its rows. Null inputs are an error: impute before. An empty table gives a model without trees.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import fresh_path

BINS = 64
CUT = 10
TASK_ROWS = 25_000  # rows that are worth a task of their own
DIRECT = 32  # tables that the driver adds up itself; more are added in Spark first


@dataclass(frozen=True)
class Settings:
    loss: str  # poisson, softmax or squared
    classes: int = 1
    rounds: int = 250
    depth: int = 3
    rate: float = 0.04
    rows: float = 0.8
    inputs: float = 0.8
    penalty: float = 1.0
    least_weight: float = 1.0  # curvature that each side of a split needs
    least_gain: float = 1e-6
    most_step: float = 0.0  # for Poisson: bound of a leaf, which also widens the curvature
    bins: int = BINS
    seed: int = 42


@dataclass
class Tree:
    feature: np.ndarray  # of each inner node, -1 without a split
    cut: np.ndarray  # rows with a larger bin go right
    leaf: np.ndarray

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Number of each row's node on a level."""
        return self.places(bins, depth).astype(np.int64) + (1 << depth) - 1

    def places(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Place of each row's node on a level, from comparisons of whole columns."""
        place = np.zeros(len(bins), dtype=np.uint8 if depth <= 8 else np.int64)
        for level in range(depth):
            right = np.zeros(len(bins), dtype=bool)
            for at in range(1 << level):
                node = (1 << level) - 1 + at
                if self.feature[node] < 0:
                    continue
                side = bins[:, self.feature[node]] > int(self.cut[node])
                right |= side & (place == at) if level else side
            place = 2 * place + right
        return place


@dataclass
class Boosted:
    settings: Settings
    base: np.ndarray
    cuts: list[np.ndarray]
    trees: list[list[Tree]] = field(default_factory=list)  # by round and class
    gains: np.ndarray | None = None

    def margins(self, bins: np.ndarray, first: int = 0, start: np.ndarray | None = None) -> np.ndarray:
        out = np.array(np.tile(self.base, (len(bins), 1)) if start is None else start, order="F")
        for trees in self.trees[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.leaf[tree.places(bins, self.settings.depth)]
        return out

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8, order="F")
        for k, c in enumerate(self.cuts):
            out[:, k] = np.searchsorted(c, x[:, k], side="left")
        return out

    def predictions(self, margins: np.ndarray) -> np.ndarray:
        if self.settings.loss == "poisson":
            return np.exp(margins)
        if self.settings.loss == "softmax":
            e = np.exp(margins - margins.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        return margins


def slopes(settings: Settings, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss, rows x classes."""
    if settings.loss == "poisson":
        mean = np.exp(margins)
        return mean - y[:, None], np.exp(margins + settings.most_step)
    if settings.loss == "softmax":
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        return p - (y[:, None] == np.arange(settings.classes)), np.maximum(2 * p * (1 - p), 1e-16)
    return margins - y[:, None], np.ones_like(margins)


def _mixed(key: np.ndarray, salt: int) -> np.ndarray:
    x = key.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def taken(settings: Settings, key: np.ndarray, turn: int) -> np.ndarray:
    """Rows of a round."""
    return (_mixed(key, settings.seed * 100_003 + turn + 1) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < settings.rows


def histogram(settings: Settings, bins, g, h, node, features: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of g and h by (class, place of the node on its level, input, bin); rows of node -1 are left out."""
    n, width, level = settings.bins, bins.shape[1], int(node.max(initial=0)) + 1 if node.size else 1
    out = np.zeros((settings.classes, level, width, n, 2))
    for k in range(settings.classes):
        own = node[:, k] >= 0
        own = slice(None) if own.all() else own
        first, values = node[own, k] * n, [np.ascontiguousarray(value[own, k]) for value in (g, h)]
        for f in features[k]:
            cell = first + bins[own, f]
            for s, value in enumerate(values):
                out[k, :, f, :, s] = np.bincount(cell, weights=value, minlength=level * n).reshape(level, n)
    return out


def best_splits(settings: Settings, sums: np.ndarray, features: np.ndarray) -> list[tuple[float, int, int, np.ndarray, np.ndarray]]:
    """For each node of a class: gain, input, bin and the sums left and right; input -1 without a gain."""
    found = []
    for node in sums:
        whole = node[features[0]].sum(axis=0)
        left = np.cumsum(node[features], axis=1)[:, :-1]
        right = whole - left
        worth = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + settings.penalty, 1e-300)
        gain = worth(left) + worth(right) - worth(whole)
        gain[(np.minimum(left[..., 1], right[..., 1]) < max(settings.least_weight, 1e-12))] = -1
        at = int(np.argmax(np.round(gain, 12)))
        f, b = divmod(at, gain.shape[1]) if gain.size else (0, 0)
        if gain.size and gain[f, b] > settings.least_gain:
            found.append((float(gain[f, b]), int(features[f]), b, left[f, b], right[f, b]))
        else:
            found.append((0.0, -1, 0, whole, np.zeros(2)))
    return found


def leaf_values(settings: Settings, sums: np.ndarray) -> np.ndarray:
    value = np.where(sums[:, 1] > 0, -sums[:, 0] / np.maximum(sums[:, 1] + settings.penalty, 1e-300), 0.0)
    if settings.most_step:
        value = np.clip(value, -settings.most_step, settings.most_step)
    return settings.rate * value


def grow(settings: Settings, inputs: int, turn: int, summed, gains: np.ndarray) -> list[Tree]:
    """The trees of a round; ``summed(trees, level, features)`` gives the histogram of a level."""
    rng = np.random.default_rng([settings.seed, turn])
    some = max(1, math.ceil(settings.inputs * inputs))
    features = [np.sort(rng.permutation(inputs)[:some]) for _ in range(settings.classes)]
    inner = (1 << settings.depth) - 1
    trees = [Tree(np.full(inner, -1), np.zeros(inner, dtype=np.int64), np.zeros(inner + 1)) for _ in range(settings.classes)]
    ends = [None] * settings.classes
    for level in range(settings.depth):
        sums = summed(trees, level, features)
        for k, tree in enumerate(trees):
            ends[k] = []
            for place, (gain, f, b, left, right) in enumerate(best_splits(settings, sums[k], features[k])):
                node = (1 << level) - 1 + place
                tree.feature[node], tree.cut[node] = f, b
                if f >= 0:
                    gains[f] += gain
                ends[k] += [left, right]
    for k, tree in enumerate(trees):
        tree.leaf = leaf_values(settings, np.array(ends[k]))
    return trees


def fit(rows: DataFrame, settings: Settings, features: str = "features", label: str = "label", key: Sequence[str] = ("key",)) -> Boosted:
    """Fit on rows with an array of doubles, a label and key columns."""
    spark = rows.sparkSession
    ready = rows.where(F.col(label).isNotNull()).select(
        F.col(features).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(*key).alias("key")
    )
    first = ready.select(F.size("x").alias("n")).first()
    inputs = first["n"] if first else 0
    base = np.zeros(settings.classes)
    model = Boosted(settings, base, [np.zeros(0)] * inputs, gains=np.zeros(inputs))
    if not inputs:
        return model
    shares = [k / settings.bins for k in range(1, settings.bins)]
    facts = ready.agg(F.count("y").alias("rows"), F.avg("y").alias("mean"), *[F.percentile_approx(F.col("x")[k], shares, 10_000).alias(f"q{k}") for k in range(inputs)]).first()
    model.cuts = [np.unique(np.array(facts[f"q{k}"], dtype=np.float64)) for k in range(inputs)]
    if settings.loss == "poisson":
        base[:] = math.log(max(facts["mean"], 1e-6))
    elif settings.loss == "squared":
        base[:] = facts["mean"]
    model.base = base

    def start(batches):
        for batch in batches:
            offsets = batch.column("x").offsets.to_numpy()
            x = batch.column("x").values.to_numpy()[offsets[0] : offsets[-1]].reshape(-1, inputs)
            block = (model.binned(x), batch.column("y").to_numpy().copy(), batch.column("key").to_numpy().copy())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    path = fresh_path(spark, "boosting")
    ready.mapInArrow(start, "block binary").write.parquet(path)
    # Each level is a job: one even share of the rows for every core, fewer where there are few rows.
    tasks = max(1, min(spark.sparkContext.defaultParallelism, facts["rows"] // TASK_ROWS))
    blocks = spark.read.parquet(path).repartition(tasks).rdd
    current = None
    try:
        for turn in range(settings.rounds):
            if turn % CUT == 0:
                following = blocks.map(_with_margins(Boosted(settings, base, model.cuts, list(model.trees)))).persist(StorageLevel.MEMORY_AND_DISK)
                following.count()
                if current is not None:
                    current.unpersist()
                current, since = following, turn

            def summed(trees, level, features, here=current, since=since, turn=turn):
                return _summed(here, Boosted(settings, base, model.cuts, model.trees[since:]), turn, trees, level, features)

            model.trees.append(grow(settings, inputs, turn, summed, model.gains))
    finally:
        if current is not None:
            current.unpersist()
    return model


def _with_margins(model: Boosted):
    def run(row):
        bins, y, key = pickle.loads(row["block"])
        return bins, y, key, model.margins(bins)

    return run


def _summed(blocks, recent: Boosted, turn: int, trees, level: int, features) -> np.ndarray:
    """Histogram of a level over all rows."""
    settings = recent.settings
    shape = (settings.classes, 1 << level, len(recent.cuts), settings.bins, 2)

    def run(part):
        total = np.zeros(shape)
        for bins, y, key, margins in part:
            some = taken(settings, key, turn)
            if not some.any():
                continue
            bins, y = bins.T[:, some].T, y[some]
            g, h = slopes(settings, recent.margins(bins, 0, margins.T[:, some].T), y)
            node = np.array([t.places(bins, level) for t in trees], dtype=np.int64).T
            part_sums = histogram(settings, bins, g, h, node, features)
            total[:, : part_sums.shape[1]] += part_sums
        yield total

    sums = blocks.mapPartitions(run)
    if blocks.getNumPartitions() <= DIRECT:
        return sum(sums.collect(), np.zeros(shape))
    return sums.treeReduce(np.add, depth=2 + (blocks.getNumPartitions() > DIRECT**2))


def predict(df: DataFrame, model: Boosted, names: Sequence[str], features: str = "features") -> DataFrame:
    """Replace the array of inputs by the predictions, one column for each class."""
    kept = df.drop(*names)
    columns = [c for c in kept.columns if c != features]
    schema = T.StructType([*(kept.schema[c] for c in columns), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches):
        for batch in batches:
            column = batch.column(features)
            offsets = column.offsets.to_numpy()
            x = column.values.to_numpy()[offsets[0] : offsets[-1]].reshape(batch.num_rows, -1)
            bins = model.binned(x) if len(model.cuts) else np.zeros((batch.num_rows, 0), dtype=np.uint8)
            found = model.predictions(model.margins(bins))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *(pa.array(found[:, k]) for k in range(len(names)))], [*columns, *names]
            )

    return kept.mapInArrow(run, schema)
