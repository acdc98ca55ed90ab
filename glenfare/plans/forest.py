"""Random forests over few features: the rows are binned and drawn once, whatever the number of trees and levels.

Spark's trees see a feature only through its bin (at most ``maxBins``, cut at points chosen from a sample of the rows),
but read every row again for each level and count it for each tree.  Rows in the same bins of all features are in the
same node of every tree.  With few features there are few such cells (``maxBins ** features`` at most), and a tree is
the same whether it is grown on the rows or on the sums of its cells:

* ``cut_points``: the bins, by the estimator's rule from a sample of the size that it takes.
* ``keyed`` and ``sums``: one pass over all rows.  Each row is drawn for each tree with its own Poisson count (the
  bootstrap), and a cell's counts, label sums and sums of squares are kept for each tree.  Rows are sorted by cell,
  so a task holds the sums of one block of cells.  Draws are seeded by cell; a cell that many rows fall into is dealt to
  several tasks.
* ``grow``: a tree of its cells, level by level: variance gain, a random subset of features for each node, first of equal
  splits, equal leaves merged, as Spark grows it.  A task holds one tree's cells.
* ``fit``: the trees in the form in which Spark saves a ``RandomForestRegressionModel``, loaded as one.
"""

from __future__ import annotations

import json
import math
import sys
import time
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glenfare.session import checkpoint_dir

#: Cells that a tree may have: the memory of a task that grows one (some 100 bytes a cell).
MOST_CELLS = 1 << 20
#: Rows of one cell from which on it is dealt to several tasks, and the most in a partition on the mean.
MANY_ROWS = 1_000_000
#: Rows drawn at once, and cells in one block of sums.
DRAWN, BLOCK = 4096, 1024
#: Parameters that may be set; with others the estimator fits on the rows.
SERVED = {"featuresCol", "labelCol", "numTrees", "seed", "maxDepth", "maxBins"}
#: Those of the forest that its trees do not have.
FOREST_ONLY = {"bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate"}

SUMS = "tree int, keys array<bigint>, n array<double>, s array<double>, q array<double>"
NODES = ("treeID int, nodeData struct<id:int, prediction:double, impurity:double, impurityStats:array<double>, rawCount:bigint, "
         "gain:double, leftChild:int, rightChild:int, split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, "
         "numCategories:int>>")
SPLIT_TYPE = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
                        ("numCategories", pa.int32())])
NODE_TYPE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
                       ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
                       ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", SPLIT_TYPE)])

#: Poisson(1) by the first 16 random bits; -1 where they do not decide.
CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(19)])
_EDGES = np.searchsorted(CDF, np.arange(65537) / 65536, side="right").astype(float)
DRAW = np.where(_EDGES[:-1] == _EDGES[1:], _EDGES[:-1], -1.0)


def serves(estimator, d: int) -> bool:
    """Whether ``fit`` does what ``estimator`` asks for, on ``d`` features."""
    return (isinstance(estimator, RandomForestRegressor) and estimator.getMaxBins() ** d <= MOST_CELLS
            and all(p.name in SERVED or not estimator.isSet(p) for p in estimator.params))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Where to cut a feature into at most ``bins`` bins: midway between neighbours, at each where they are few, else where the
    running count is nearest to a multiple of a bin's share."""
    x, counts = np.unique(values, return_counts=True)
    mids = (x[:-1] + x[1:]) / 2.0
    if len(mids) < bins:
        return mids
    running, stride = np.cumsum(counts), counts.sum() / bins
    out, target = [], stride
    for before, now, mid in zip(running[:-1], running[1:], mids):
        if abs(before - target) < abs(now - target):
            out.append(mid)
            target += stride
    return np.array(out)


def cells_of(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """The cell of each row: its bins as one number.  A value on a cut belongs to the left bin."""
    return np.ravel_multi_index([np.searchsorted(c, x) for x, c in zip(columns, cuts)], [len(c) + 1 for c in cuts])


def keyed(batches, cuts: list[np.ndarray], crowded: dict[int, int]):
    """(key, y) of rows (features..., y, at).  The key is the cell; in the ``crowded`` ones, the cell and one of its shares by ``at``."""
    size = math.prod(len(c) + 1 for c in cuts)
    hot, shares = np.array(sorted(crowded.items()), np.int64).reshape(-1, 2).T
    for b in batches:
        *x, y, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(len(cuts) + 2))
        key = cells_of(x, cuts).astype(np.int64)
        if len(hot):
            i = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            key += np.where(hot[i] == key, at % shares[i], 0) * size
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(y)], names=["key", "y"])


def drawn(g: np.random.Generator, rows: int, trees: int) -> np.ndarray:
    """How often each tree draws each row: independent Poisson(1) counts."""
    bits = g.integers(0, 65536, (rows, trees), np.uint16)
    w = DRAW[bits]
    open_ = w < 0
    if open_.any():
        w[open_] = np.searchsorted(CDF, (bits[open_] + g.random(int(open_.sum()))) / 65536, side="right")
    return w


def sums(batches, trees: int, seed: int):
    """For blocks of keys, a row for each tree: the keys, and for each the tree's count of draws, sum and sum of squares of ``y`` in
    them.  Rows (key, y) come sorted."""
    keys, done, last, g, open_ = [], [], None, None, np.zeros((3, trees))

    def block():
        at = np.arange(trees + 1, dtype=np.int32) * len(keys)
        own = [pa.array(np.tile(np.array(keys, np.int64), trees)), *[pa.array(v.T.ravel()) for v in np.stack(done, 1)]]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(trees, dtype=np.int32)), *[
            pa.ListArray.from_arrays(pa.array(at), v) for v in own]], names=["tree", "keys", "n", "s", "q"])

    for b in batches:
        key, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            if key[i] != last:
                if last is not None:
                    keys.append(last)
                    done.append(open_)
                    if len(keys) == BLOCK:
                        yield block()
                        keys, done = [], []
                last, open_ = int(key[i]), np.zeros((3, trees))
                g = np.random.Generator(np.random.Philox(key=np.array([seed, last], np.int64).view(np.uint64)))
            for k in range(i, j, DRAWN):
                v = y[k:min(k + DRAWN, j)]
                open_ += np.stack([np.ones(len(v)), v, v * v]) @ drawn(g, len(v), trees)
    if last is not None:
        keys.append(last)
        done.append(open_)
        yield block()


def impurity(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The variance of ``n`` labels with sum ``s`` and sum of squares ``q``."""
    n = np.maximum(n, 1.0)  # counts are whole; an empty side has no sums
    return (q - s * s / n) / n


def grow(bins: np.ndarray, stats: np.ndarray, cuts: list[np.ndarray], depth: int, subset) -> list[dict]:
    """The nodes of a tree, each after its parent.  ``bins``: features x cells; ``stats``: counts, sums and sums of squares x cells;
    ``subset(k)``: which features each of k nodes may split by, k x features."""
    def node(own) -> dict:
        return {"stats": own, "prediction": float(own[1] / own[0]), "gain": -1.0, "left": -1, "right": -1}

    nodes, level, at = [node(stats.sum(1))], [0], np.zeros(bins.shape[1], np.int64)
    for _ in range(depth):
        k = len(level)
        if not k:
            break
        total = np.array([nodes[i]["stats"] for i in level]).T
        own, may, each = impurity(*total), subset(k), np.arange(k)
        gain, by, cut, lefts = np.full(k, -np.inf), np.zeros(k, int), np.zeros(k, int), np.zeros((3, k))
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            size = len(c) + 1
            place = at * size + bins[f]
            left = np.stack([np.bincount(place, v, k * size).reshape(k, size).cumsum(1)[:, :-1] for v in stats])
            right = total[:, :, None] - left
            share = left[0] / total[0][:, None]
            found = own[:, None] - share * impurity(*left) - right[0] / total[0][:, None] * impurity(*right)
            found[(left[0] < 1) | (right[0] < 1) | ~may[:, f][:, None]] = -np.inf
            best = found.argmax(1)
            better = found[each, best] > gain
            gain[better], by[better], cut[better] = found[each, best][better], f, best[better]
            lefts[:, better] = left[:, each, best][:, better]
        after, sides = [], np.full((2, k), -1)
        for i in np.flatnonzero(gain > 0).tolist():
            parent = nodes[level[i]]
            parent |= {"gain": float(gain[i]), "feature": int(by[i]), "cut": float(cuts[by[i]][cut[i]])}
            for side, name, part in ((0, "left", lefts[:, i]), (1, "right", total[:, i] - lefts[:, i])):
                parent[name] = len(nodes)
                nodes.append(node(part))
                if abs(impurity(*part)) >= sys.float_info.epsilon:
                    sides[side, i] = len(after)
                    after.append(parent[name])
        at = sides[(bins[by[at], np.arange(len(at))] > cut[at]).astype(int), at]
        stay = at >= 0
        at, bins, stats, level = at[stay], bins[:, stay], stats[:, stay], after
    return nodes


def merged(nodes: list[dict]) -> list[dict]:
    """``nodes`` without pairs of leaves that predict the same, numbered anew."""
    for v in reversed(nodes):
        if v["left"] >= 0:
            a, b = nodes[v["left"]], nodes[v["right"]]
            if a["left"] < 0 and b["left"] < 0 and a["prediction"] == b["prediction"]:
                v["left"] = v["right"] = -1
    kept, new = [0], {}
    for i in kept:
        new[i] = len(new)
        if nodes[i]["left"] >= 0:
            kept += [nodes[i]["left"], nodes[i]["right"]]
    return [nodes[i] | {"left": new.get(nodes[i]["left"], -1), "right": new.get(nodes[i]["right"], -1)} for i in kept]


def saved(v: dict, i: int) -> dict:
    """A node in the form in which Spark saves it."""
    inner = v["left"] >= 0
    return {"id": i, "prediction": v["prediction"], "impurity": float(impurity(*v["stats"])),
            "impurityStats": [float(x) for x in v["stats"]], "rawCount": int(v["stats"][0]), "gain": v["gain"] if inner else -1.0,
            "leftChild": v["left"], "rightChild": v["right"],
            "split": {"featureIndex": v["feature"] if inner else -1, "leftCategoriesOrThreshold": [v["cut"]] if inner else [],
                      "numCategories": -1}}


def grower(cuts: list[np.ndarray], depth: int, features: int, seed: int):
    """The function that makes the saved nodes of one tree from its blocks of sums."""
    d, sizes = len(cuts), [len(c) + 1 for c in cuts]

    def tree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        keys, *stats = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(n).chunks])
                        for n in ("keys", "n", "s", "q"))
        order = np.argsort(keys)
        order = order[stats[0][order] > 0]  # the cells that the tree drew a row of
        bins = np.stack(np.unravel_index(keys[order] % math.prod(sizes), sizes))
        g = np.random.Generator(np.random.Philox(key=np.array([seed, -1 - number], np.int64).view(np.uint64)))

        def subset(k: int) -> np.ndarray:
            return g.random((k, d)).argsort(1).argsort(1) < features

        nodes = merged(grow(bins, np.stack(stats)[:, order], cuts, depth, subset))
        return pa.table({"treeID": pa.array([number] * len(nodes), pa.int32()),
                         "nodeData": pa.array([saved(v, i) for i, v in enumerate(nodes)], NODE_TYPE)})
    return tree


def _metadata(estimator, name: str, without: set[str], **more) -> str:
    """What Spark saves beside a model: class, parameters and ``more``."""
    own, default = ({p.name: v for p, v in m.items() if p.name not in without}
                    for m in (estimator._paramMap, estimator._defaultParamMap))
    return json.dumps({"class": f"org.apache.spark.ml.regression.{name}", "timestamp": int(time.time() * 1000),
                       "paramMap": own, "defaultParamMap": default, **more})


def fit(estimator: RandomForestRegressor, train: DataFrame, inputs: list[str], n: int) -> RandomForestRegressionModel:
    """``estimator`` fitted on the ``n`` rows of ``train``, where ``serves`` allows it; ``inputs`` are the columns of the features."""
    spark, seed, trees, bins = train.sparkSession, estimator.getSeed(), estimator.getNumTrees(), estimator.getMaxBins()
    d, label = len(inputs), estimator.getLabelCol()
    rows = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)], F.col(label).cast("double").alias("y"))

    # the cuts and, roughly, the crowded cells: from as many rows as the estimator takes for its cuts
    wanted, xs = max(bins * bins, 10_000), rows.drop("y")
    sample = np.array((xs if n <= wanted else xs.sample(False, wanted / n, seed)).collect(), float).reshape(-1, d).T
    cuts = [cut_points(x, bins) for x in sample]
    cells, counts = np.unique(cells_of(list(sample), cuts), return_counts=True)
    crowded = {int(c): math.ceil(k * n / (sample.shape[1] * MANY_ROWS)) for c, k in zip(cells, counts)
               if k * n > sample.shape[1] * MANY_ROWS}

    cores = spark.sparkContext.defaultParallelism
    keys = rows.withColumn("at", F.monotonically_increasing_id()).mapInArrow(partial(keyed, cuts=cuts, crowded=crowded),
                                                                            "key bigint, y double")
    dealt = keys.repartition(cores * math.ceil(n / (cores * MANY_ROWS)), "key").sortWithinPartitions("key", "y")
    blocks = dealt.mapInArrow(partial(sums, trees=trees, seed=seed), SUMS)
    grown = blocks.repartition(trees, "tree").groupBy("tree").applyInArrow(
        grower(cuts, estimator.getMaxDepth(), d if trees == 1 else math.ceil(d / 3), seed), NODES)

    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    grown.write.parquet(f"{path}/data")
    named = {"sparkVersion": spark.version}
    one = [(i, _metadata(estimator, "DecisionTreeRegressionModel", FOREST_ONLY, uid=f"{estimator.uid}_{i}", **named), 1.0)
           for i in range(trees)]
    spark.createDataFrame(one, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = _metadata(estimator, "RandomForestRegressionModel", set(), uid=estimator.uid, numFeatures=d, numTrees=trees, **named)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestRegressionModel.load(path)


# sent to the executors by value: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
