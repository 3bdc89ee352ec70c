"""Boosted trees of Spark's kind, all of them grown in one stage: its tasks wait for each other, keep their rows and add up
histograms, where Spark's own classifier begins two stages for each level of each tree."""

from __future__ import annotations

import contextlib
import json
import math
import secrets
import socket
import time
import uuid
from collections.abc import Callable
from multiprocessing.connection import Client, Listener

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.sources import tables

#: Bins of a feature, as Spark has them by default.
BINS = 32
#: Bits of a feature's value that count where the bins' bounds are chosen.
VALUE_BITS = 13
#: Residuals are multiples of 1 / SCALE: their sums are exact, so neither the tasks nor their order change a tree.
SCALE = 2.0**24
SQUARE_SCALE = 2.0**20
#: Fewer distinct rows than this for each task aren't worth its messages.
TASK_ROWS = 10_000
NODE = "treeID int, id int, prediction double, impurity double, stats array<double>, raw long, gain double, left int, right int, feature int, threshold double"


def folder(spark: SparkSession) -> str | None:
    """Where trees can be put together; None if tasks can't wait for each other or share no folder."""
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return None
    return tables.shared_folder(spark)


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, as Spark counts them before it begins a barrier stage."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def columns_of(batch, names: list[str]) -> list[np.ndarray]:
    out = []
    for k, name in enumerate(names):
        if batch.column(k).null_count or np.isnan(x := batch.column(k).to_numpy(zero_copy_only=False)).any():
            raise ValueError(f"{name} has nulls or NaN")
        out.append(x)
    return out


def bounds(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Of each feature, the values that a split may compare with: between all neighbouring values, or, if these are too many,
    by Spark's rule for equal shares. Counted over all rows."""

    def counted(batches):
        import pyarrow as pa

        have = [(np.empty(0), np.empty(0, np.int64)) for _ in features]

        def merge(k, values, n):
            values, at = np.unique(np.concatenate([have[k][0], values]), return_inverse=True)
            have[k] = values, np.bincount(at, np.concatenate([have[k][1], n]), len(values)).astype(np.int64)

        for batch in batches:
            for k, x in enumerate(columns_of(batch, features)):
                m, e = np.frexp(x)
                merge(k, *np.unique(np.ldexp(np.rint(np.ldexp(m, VALUE_BITS)), e - VALUE_BITS) + 0.0, return_counts=True))
        for k, (values, n) in enumerate(have):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(n)], names=["k", "value", "n"])

    found = rows.select(*features).mapInArrow(counted, "k int, value double, n long").groupBy("k", "value").agg(F.sum("n").alias("n")).toArrow()
    k, value, n = (found.column(c).to_numpy() for c in ("k", "value", "n"))
    out = []
    for f in range(len(features)):
        order = np.flatnonzero(k == f)
        order = order[np.argsort(value[order])]
        out.append(chosen(value[order].tolist(), n[order].tolist()))
    return out


def chosen(values: list[float], n: list[int]) -> list[float]:
    between = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    if len(between) < BINS:
        return between
    stride = sum(n) / BINS
    out, target, now = [], stride, n[0]
    for i in range(1, len(values)):
        before, now = now, now + n[i]
        if abs(before - target) < abs(now - target):
            out.append(between[i - 1])
            target += stride
    return out[: BINS - 1]


def cells(rows: DataFrame, features: list[str], label: str, cuts: list[list[float]]) -> DataFrame:
    """(cell, n): rows with equal bins and labels are one; a cell has a byte for each feature and one for the label."""

    def binned(batches):
        import pyarrow as pa

        for batch in batches:
            *xs, y = columns_of(batch, [*features, label])
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError(f"{label} is neither 0 nor 1")
            made = np.stack([*(np.searchsorted(c, x) for c, x in zip(cuts, xs, strict=True)), y], axis=1).astype(np.uint8)
            at = np.arange(len(y) + 1, dtype=np.int32) * made.shape[1]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(y), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(made.tobytes())])], names=["cell"])

    return rows.select(*features, label).mapInArrow(binned, "cell binary").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (a public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draw:
    """For each tree, how many of the rows of each cell it sees: every row is drawn by a hash of its cell, its number in it, the
    tree and the seed."""

    def __init__(self, cell: np.ndarray, n: np.ndarray, share: float, seed: int):
        self.n, self.share, self.seed = n, share, seed
        key = np.zeros(len(n), np.uint64)
        for column in cell.T:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
        self.starts = np.cumsum(n) - n
        self.single = bool((n == 1).all())
        self.keys = key if self.single else np.repeat(key, n) + mixed((np.arange(n.sum()) - np.repeat(self.starts, n)).astype(np.uint64))

    def __call__(self, tree: int) -> np.ndarray:
        if self.share >= 1 or not len(self.n):
            return self.n
        own = np.random.default_rng([self.seed % 2**63, tree]).integers(0, 2**63, dtype=np.uint64)
        seen = (mixed(self.keys ^ own) >> np.uint64(11)) * 2.0**-53 < self.share
        return seen.astype(np.int64) if self.single else np.add.reduceat(seen, self.starts, dtype=np.int64)


class Tree:
    """Nodes in the order in which they were made; children follow their node, the right one the left one."""

    def __init__(self):
        self.count, self.total, self.gain, self.left, self.feature, self.cut = ([] for _ in range(6))

    def add(self, count: float, total: float) -> int:
        for x, value in ((self.count, count), (self.total, total), (self.gain, -1.0), (self.left, -1), (self.feature, -1), (self.cut, 0)):
            x.append(value)
        return len(self.count) - 1

    def values(self) -> np.ndarray:
        return np.array(self.total) / SCALE / np.maximum(np.array(self.count), 1.0)


def best_splits(counts: np.ndarray, sums: np.ndarray, open_: np.ndarray, least: int):
    """For each node the feature, bin and gain (of variance) of the best split, and what goes left. counts, sums: by node,
    feature and bin; open_: the same without the last bin, whether the split may be taken."""
    n, s = counts[:, 0].sum(1)[:, None, None], sums[:, 0].sum(1)[:, None, None]
    nl, sl = np.cumsum(counts, 2)[:, :, :-1], np.cumsum(sums, 2)[:, :, :-1]
    nr, sr = n - nl, s - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        both = (sl * sl / nl + sr * sr / nr) / n
        gain = both - s * s / n / n
        gain = np.where(open_ & (nl >= max(1, least)) & (nr >= max(1, least)) & (gain > 1e-12 * both), gain, -1.0)
    at = gain.reshape(len(gain), -1).argmax(1)
    f, k = np.divmod(at, gain.shape[2])
    i = np.arange(len(at))
    return f, k, gain[i, f, k] / SCALE**2, nl[i, f, k], sl[i, f, k]


def grown(cell: np.ndarray, n: np.ndarray, widths: list[int], trees: int, rate: float, depth: int, least: int, share: float, seed: int, added: Callable[[np.ndarray], np.ndarray]) -> list[tuple]:
    """The nodes of all trees. cell: bins and label of this task's rows, n: how often each occurs; added: sums an array over all
    tasks. All tasks make the same trees, as they see the same sums."""
    bins, rows = np.ascontiguousarray(cell[:, :-1].T), np.ascontiguousarray(cell[:, :-1]).ravel()
    m, size = bins.shape
    y = cell[:, -1] * 2.0 - 1.0
    base, margin, draw = np.arange(size) * m, np.zeros(size), Draw(cell, n, share, seed)
    real = np.arange(BINS) < np.array(widths)[:, None]
    may = (np.arange(BINS - 1) < np.array(widths)[:, None] - 1)[None]
    taken = min(m, math.ceil(share * m))
    forest, squares = [], []

    def histograms(slot, at, c, w, k):
        """Counts and sums by node, feature and bin. slot: places of the rows' nodes."""
        made = np.zeros((2, k, m, BINS))
        for f in range(m):
            code = slot * BINS + bins[f, at]
            made[0, :, f] = np.bincount(code, None if draw.single else c, k * BINS).reshape(k, BINS)
            made[1, :, f] = np.bincount(code, w, k * BINS).reshape(k, BINS)
        out = np.zeros_like(made)
        out[:, :, real] = added(made[:, :, real])
        return out

    for number in range(trees):
        with np.errstate(over="ignore"):
            residual = 4.0 * y / (1.0 + np.exp(2.0 * y * margin)) if number else y
        drawn = draw(number)
        on = np.flatnonzero(drawn)
        c = drawn[on].astype(float)
        w = c * np.rint(residual[on] * SCALE)
        node, tree = np.zeros(size, np.int64), Tree()
        hist = histograms(np.zeros(len(on), np.int64), on, c, w, 1)
        tree.add(*hist[:, 0, 0].sum(1))
        level = [0]
        for deep in range(depth):
            open_ = np.zeros((len(level), m, 1), bool)
            for i, k in enumerate(level):
                open_[i, np.random.default_rng([seed % 2**63, number, k]).permutation(m)[:taken] if taken < m else slice(None)] = True
            parents, small, large = [], [], []
            for i, (f, k, gain, nl, sl) in enumerate(zip(*best_splits(*hist, open_ & may, least), strict=True)):
                if gain > 0:
                    p = level[i]
                    tree.feature[p], tree.cut[p], tree.gain[p] = int(f), int(k), float(gain)
                    tree.left[p] = tree.add(float(nl), float(sl))
                    tree.add(tree.count[p] - float(nl), tree.total[p] - float(sl))
                    parents.append(i)
                    first = nl <= tree.count[p] - nl
                    small.append(tree.left[p] + (not first))
                    large.append(tree.left[p] + bool(first))
            if not parents:
                break
            feature, cut, left = np.array(tree.feature), np.array(tree.cut), np.array(tree.left)
            at = np.flatnonzero(feature[node] >= 0)
            own = node[at]
            node[at] = left[own] + (rows[base[at] + feature[own]] > cut[own])
            if deep + 1 == depth:
                break
            wanted = [i for i in range(len(parents)) if max(tree.count[small[i]], tree.count[large[i]]) >= 2 * max(1, least)]
            if not wanted:
                break
            place = np.full(len(tree.count), -1)
            place[[small[i] for i in wanted]] = np.arange(len(wanted))
            slot = place[node[on]]
            here = np.flatnonzero(slot >= 0)
            less = histograms(slot[here], on[here], c[here], w[here], len(wanted))
            rest = hist[:, [parents[i] for i in wanted]] - less
            level = [small[i] for i in wanted] + [large[i] for i in wanted]
            kept = [i for i, k in enumerate(level) if tree.count[k] >= 2 * max(1, least)]
            hist, level = np.concatenate([less, rest], 1)[:, kept], [level[i] for i in kept]
        margin += tree.values()[node] * (rate if number else 1.0)
        forest.append(tree)
        squares.append(np.bincount(node[on], c * np.rint(residual[on] ** 2 * SQUARE_SCALE), len(tree.count)))
    out, ends = [], np.cumsum([len(x.count) for x in forest])
    for number, (tree, square) in enumerate(zip(forest, np.split(added(np.concatenate(squares)), ends[:-1]), strict=True)):
        for k in reversed(range(len(square))):
            if tree.left[k] >= 0:
                square[k] = square[tree.left[k]] + square[tree.left[k] + 1]
        for k, value in enumerate(tree.values().tolist()):
            total, mean = square[k] / SQUARE_SCALE, max(1.0, tree.count[k])
            stats = [float(tree.count[k]), float(tree.total[k] / SCALE), float(total)]
            out.append((number, k, value, max(0.0, float(total / mean - value**2)), stats, int(tree.count[k]), tree.gain[k], tree.left[k], tree.left[k] + 1 if tree.left[k] >= 0 else -1, tree.feature[k], tree.cut[k]))
    return out


@contextlib.contextmanager
def linked(context, key: bytes):
    """What sums arrays over the tasks of a barrier stage: each adds those of the two tasks below it in a binary tree to its own,
    and hands the sum down again. The barrier itself only tells the ports; a call of it takes a second. If a task fails, the
    others' connections end, and the stage begins anew."""
    me, hosts = context.partitionId(), [x.address.rpartition(":")[0] for x in context.getTaskInfos()]
    below = [k for k in (2 * me + 1, 2 * me + 2) if k < len(hosts)]
    with contextlib.ExitStack() as todo:
        door = todo.enter_context(Listener((hosts[me], 0), backlog=2, authkey=key))
        ports = context.allGather(str(door.address[1]))
        above = [todo.enter_context(Client((hosts[k], int(ports[k])), authkey=key)) for k in [(me - 1) // 2] if me]
        below = [todo.enter_context(door.accept()) for _ in below]
        for link in (*above, *below):
            with socket.fromfd(link.fileno(), socket.AF_INET, socket.SOCK_STREAM) as s:
                s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

        def added(x: np.ndarray) -> np.ndarray:
            out = x.astype(float).ravel()
            for link in below:
                out += np.frombuffer(link.recv_bytes())
            for link in above:
                link.send_bytes(out)
                out = np.array(np.frombuffer(link.recv_bytes()))
            for link in below:
                link.send_bytes(out)
            return out.reshape(x.shape)

        yield added


def described(params, kind: str, version: str, **more) -> str:
    """What Spark's reader of models expects in front."""
    own, default = ({p.name: v for p, v in x.items()} for x in (params._paramMap, params._defaultParamMap))
    return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": version, "uid": params.uid, "paramMap": own, "defaultParamMap": default} | more)


def fit(rows: DataFrame, features: list[str], own: GBTClassifier, label: str, path: str) -> GBTClassificationModel:
    """A model by own's number of trees, rate, depth, least rows of a node, share of rows and features, and seed. The rows are
    read twice; path: a folder that driver and executors share, for Spark's own files of a model, read at once and deleted."""
    spark = rows.sparkSession
    cuts = bounds(rows, features)
    found = cells(rows, features, label, cuts).persist()
    try:
        if not (size := found.count()):
            raise ValueError("no rows to learn from")
        tasks = min(slots(spark), max(1, size // TASK_ROWS))
        share, widths = own.getSubsamplingRate(), [len(c) + 1 for c in cuts]
        settings = own.getMaxIter(), own.getStepSize(), own.getMaxDepth(), own.getMinInstancesPerNode(), share, own.getSeed()
        key = secrets.token_bytes(32)

        def task(batches):
            import pyarrow as pa
            from pyspark import BarrierTaskContext

            context = BarrierTaskContext.get()

            parts = [(b"".join(b.column(0).to_pylist()), b.column(1).to_numpy()) for b in batches]
            cell = np.frombuffer(b"".join(x for x, _ in parts), np.uint8).reshape(-1, len(features) + 1)
            with linked(context, key) as added:
                made = grown(cell, np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)]), widths, *settings, added)
            if context.partitionId() == 0:
                made = [(*x[:-1], cuts[x[-2]][x[-1]] if x[-2] >= 0 else 0.0) for x in made]
                names = [x.split()[0] for x in NODE.split(", ")]
                kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

        nodes = found.repartition(tasks).mapInArrow(task, NODE, barrier=True)
        bound = F.when(F.col("feature") < 0, F.array().cast("array<double>")).otherwise(F.array("threshold"))
        split = F.struct(F.col("feature").alias("featureIndex"), bound.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
        data = F.struct("id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"))
        path = f"{path.rstrip('/')}/trees-{uuid.uuid4().hex}"
        try:
            nodes.select("treeID", data.alias("nodeData")).write.parquet(f"{path}/data")
            base = DecisionTreeRegressor(maxDepth=settings[2], minInstancesPerNode=settings[3], seed=settings[5])
            one, kind = described(base, "regression.DecisionTreeRegressionModel", spark.version), "classification.GBTClassificationModel"
            weights = [(k, one, settings[1] if k else 1.0) for k in range(settings[0])]
            spark.createDataFrame(weights, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
            spark.createDataFrame([(described(own, kind, spark.version, numFeatures=len(features), numTrees=settings[0]),)], "value string").coalesce(1).write.text(f"{path}/metadata")
            return GBTClassificationModel.load(path)
        finally:
            tables.delete(spark, path)
    finally:
        found.unpersist()
