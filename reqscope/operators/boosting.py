"""Gradient-boosted trees (M5) for several training sets in the same passes over Spark.

The method is MLlib's ``GBTClassifier``: thresholds by equal-frequency bins of each feature,
regression trees of least variance grown level by level, logistic loss on labels -1 and 1, the
first tree with weight 1, the next ones with the step size.  MLlib needs a job with a shuffle for
every level of every tree of every training set; here a job grows one level of the same
tree of *all* training sets (the folds of a cross-validation), so k folds take as many jobs as one.

Rows stay in their partitions as binned blocks with their scores so far.  A pass sends the new trees
to the tasks, which return one sum each (rows, targets and squares by node, feature and bin), added
in a tree; the driver holds histograms of one level and the trees only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .optim import TOGETHER

BINS, DEPTH, STEP = 32, 5, 0.1
#: Rows that thresholds are taken from (as MLlib's findSplits), rows of a block, rounds after
#: which the rows' scores are brought up to date, and values that a task reads in a pass at least.
SPLIT_ROWS, BLOCK_ROWS, KEEP, TASK_VALUES = 10000, 1 << 14, 10, 1 << 20
NODES = 2 ** (DEPTH + 1) - 1
_BLOCK = "n int, bins binary, y binary, fold binary, score binary"


def thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds that divide the values evenly, halfway between distinct ones."""
    value, count = np.unique(values + 0.0, return_counts=True)  # + 0.0: one zero
    if len(value) - 1 <= most:
        return (value[:-1] + value[1:]) / 2
    stride = len(values) / (most + 1)
    out, seen, target = [], int(count[0]), stride
    for i in range(1, len(value)):
        before, seen = seen, seen + int(count[i])
        if abs(before - target) < abs(seen - target):
            out.append((value[i - 1] + value[i]) / 2)
            target += stride
    return np.array(out)


class Trees:
    """Trees of one training set as arrays by node: feature (-1: leaf), threshold's bin and value, value."""

    def __init__(self, n: int) -> None:
        self.feature = np.full((n, NODES), -1, np.int32)
        self.bin = np.zeros((n, NODES), np.int16)
        self.cut = np.zeros((n, NODES))
        self.value = np.zeros((n, NODES))

    def nodes(self, tree: int, x: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The node that each row has reached; ``by`` holds what ``x`` is compared with."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            f = self.feature[tree, at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[rows, f] > by[tree, at]))
        return at

    def score(self, lo: int, hi: int, x: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in range(lo, hi):
            out += (STEP if t else 1.0) * self.value[t, self.nodes(t, x, by)]
        return out

    def part(self, lo: int, hi: int) -> "Trees":
        """The trees lo..hi under their own numbers, the others empty: what a pass has to be sent."""
        out = Trees(0)
        for c in ("feature", "bin", "cut", "value"):
            a = getattr(self, c)[:hi].copy()
            a[:lo] = -1 if c == "feature" else 0
            setattr(out, c, a)
        return out


def _variance(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (q - s * s / n) / n, 0.0)


def best_splits(hist: np.ndarray, splits: np.ndarray, parent: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """By node (feature, bin, gain, left sums, right sums) of the first split of most gain; ``hist``: rows,
    targets and squares by node, feature and bin, ``splits``: thresholds of each feature, ``parent``:
    the sums by node (None: the root)."""
    total = np.cumsum(hist, axis=3)
    left, right = total[..., :-1], total[..., -1:] - total[..., :-1]
    whole = left + right if parent is None else np.broadcast_to(parent[:, :, None, None], left.shape)
    n = left[0] + right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _variance(*whole) - left[0] / n * _variance(*left) - right[0] / n * _variance(*right)
    possible = (left[0] >= 1) & (right[0] >= 1) & (gain >= 0) & (np.arange(gain.shape[2]) < splits[:, None])
    gain = np.where(possible, gain, -1.0).reshape(len(gain), -1)
    best, node = gain.argmax(1), np.arange(len(gain))
    f, b = np.divmod(best, left.shape[3])
    return f, b, gain[node, best], left[:, node, f, b], right[:, node, f, b]


def _blocks(cuts: list[list[np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                n = part.num_rows
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                bins = np.stack([np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(own)], 1) for own in cuts]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (
                    bins, part.column("y").to_numpy().astype(np.int8), part.column("fold").to_numpy().astype(np.int32), np.zeros((len(cuts), n)))]],
                    ["n", "bins", "y", "fold", "score"])
    return run


def _opened(rows: Iterator[tuple], sets: int) -> Iterator[tuple[np.ndarray, ...]]:
    for n, bins, y, fold, score in rows:
        yield (np.frombuffer(bins, np.uint8).reshape(sets, n, -1), np.frombuffer(y, np.int8), np.frombuffer(fold, np.int32),
               np.frombuffer(score, np.float64).reshape(sets, n))


def _scored(trees: list[Trees], lo: int, hi: int):
    """The blocks with the scores of the trees lo..hi added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in names))
            new = [np.stack([s + t.score(lo, hi, x, t.bin) for t, x, s in zip(trees, bins, score)]).tobytes() for bins, _, _, score in _opened(rows, len(trees))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:-1]], pa.array(new, pa.binary())], names)
    return run


def _level(trees: list[Trees], out: list[int], kept: int, tree: int, open_: list[np.ndarray], d: int):
    """Sums by node (of those that are ``open_``), feature and bin of the targets of a tree."""
    size = [3 * len(o) * d * BINS for o in open_]

    def run(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        sums = [np.zeros((3, s // 3)) for s in size]
        for bins, y, fold, score in _opened(rows, len(trees)):
            for t, x, s, held_out, nodes, into in zip(trees, bins, score, out, open_, sums):
                if not len(nodes):
                    continue
                place = np.full(NODES, -1)
                place[nodes] = np.arange(len(nodes))
                at = place[t.nodes(tree, x, t.bin)]
                take = np.flatnonzero((fold != held_out) & (at >= 0))
                label = 2.0 * y[take] - 1
                target = label
                if tree:
                    target = 4 * label / (1 + np.exp(2 * label * (s[take] + t.score(kept, tree, x[take], t.bin))))
                cell = ((at[take][:, None] * d + np.arange(d)) * BINS + x[take]).ravel()
                for k, weight in enumerate((None, target, target * target)):
                    into[k] += np.bincount(cell, None if weight is None else np.repeat(weight, d), into.shape[1])
        yield np.concatenate([s.ravel() for s in sums])
    return run


class BoostedTrees:
    """``fit`` gives a model whose ``transform`` adds prediction and probability; ``fit_without`` gives
    one for each fold, trained on the rows of all other folds."""

    def __init__(self, rounds: int = 100, seed: int = 42) -> None:
        self.rounds, self.seed = rounds, seed

    def fit(self, df: DataFrame) -> "BoostedModel":
        return self.fit_without(df.withColumn("fold", F.lit(0)), [-1])[0]

    def _cuts(self, rows: DataFrame, out: Sequence[int], d: int) -> list[list[np.ndarray]]:
        """Thresholds by training set and feature, from all rows or SPLIT_ROWS of a training set, about."""
        by_fold = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
        size = [sum(n for f, n in by_fold.items() if f != o) for o in out]
        share = [min(1.0, SPLIT_ROWS / max(n, 1)) for n in size]
        place = (F.pmod(F.xxhash64("pos", F.lit(self.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
        chosen = rows.select("fold", place, "x").where(F.col("u") < max(share))

        def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([c.tobytes() for c in x], pa.binary()),
                                                      *[pa.array([b.column(c).to_numpy().tobytes()] * d, pa.binary()) for c in ("fold", "u")]], ["j", "x", "fold", "u"])

        def found(t: pa.Table) -> pa.Table:
            x, fold, u = (np.concatenate([np.frombuffer(v, kind) for v in t.column(c).to_pylist()]) for c, kind in (("x", np.float64), ("fold", np.int32), ("u", np.float64)))
            cuts = [thresholds(x[(fold != o) & (u < s)], min(BINS, n) - 1) for o, s, n in zip(out, share, size)]
            return pa.table({"j": pa.array([t.column("j")[0].as_py()] * len(out), pa.int32()), "k": pa.array(range(len(out)), pa.int32()),
                             "cuts": pa.array([c.tobytes() for c in cuts], pa.binary())})

        told = chosen.mapInArrow(turned, "j int, x binary, fold binary, u binary").groupBy("j").applyInArrow(found, "j int, k int, cuts binary").collect()
        cuts = [[np.zeros(0)] * d for _ in out]
        for r in told:  # at most BINS - 1 numbers by feature and training set
            cuts[r["k"]][r["j"]] = np.frombuffer(bytes(r["cuts"]), np.float64)
        return cuts

    def fit_without(self, df: DataFrame, out: Sequence[int]) -> list["BoostedModel"]:
        d = df.select("features").first()[0].size
        n = df.count()
        tasks = max(1, -(-n * d * len(out) // TASK_VALUES))
        rows = df.select(F.col("pos"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), vector_to_array("features").alias("x"))
        cuts = self._cuts(rows, out, d)
        splits = [np.array([len(c) for c in own]) for own in cuts]
        blocks = cut_lineage(rows.coalesce(tasks).select("y", "fold", "x").mapInArrow(_blocks(cuts), _BLOCK))
        read = blocks.rdd.map(tuple).persist()
        parts = read.getNumPartitions()
        trees = [Trees(self.rounds) for _ in out]
        kept = 0
        for m in range(self.rounds):
            if m - kept == KEEP:
                read.unpersist()
                blocks = cut_lineage(blocks.mapInArrow(_scored([t.part(kept, m) for t in trees], kept, m), _BLOCK))
                read, kept = blocks.rdd.map(tuple).persist(), m
            open_ = [np.zeros(1, np.int64) for _ in out]
            known: list[dict[int, np.ndarray]] = [{} for _ in out]
            for level in range(DEPTH):
                if not any(len(o) for o in open_):
                    break
                sent = [t.part(kept, m + 1) for t in trees]
                sums = read.mapPartitions(_level(sent, list(out), kept, m, open_, d))
                flat = sum(sums.collect()) if parts <= TOGETHER else sums.treeReduce(add)
                at = 0
                for k, t in enumerate(trees):
                    hist = flat[at:at + 3 * len(open_[k]) * d * BINS].reshape(3, len(open_[k]), d, BINS)
                    at += hist.size
                    following = []
                    if not len(open_[k]):
                        continue
                    if not level:
                        count, total, _ = hist[:, 0, 0].sum(1)
                        t.value[m, 0] = total / count if count else 0.0
                    parents = np.stack([known[k][node] for node in open_[k].tolist()], 1) if level else None
                    f, b, gain, left, right = best_splits(hist, splits[k], parents)
                    for i in np.flatnonzero(gain > 0).tolist():
                        node = int(open_[k][i])
                        t.feature[m, node], t.bin[m, node], t.cut[m, node] = f[i], b[i], cuts[k][f[i]][b[i]]
                        for child, sums in ((2 * node + 1, left[:, i]), (2 * node + 2, right[:, i])):
                            t.value[m, child] = sums[1] / sums[0]
                            known[k][child] = sums
                            if level + 1 < DEPTH and abs(float(_variance(*sums))) >= np.finfo(float).eps:
                                following.append(child)
                    open_[k] = np.array(following, np.int64)
        read.unpersist()
        return [BoostedModel(t) for t in trees]


class BoostedModel:
    def __init__(self, trees: Trees) -> None:
        self.trees = trees

    def transform(self, df: DataFrame) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self.trees)  # of the size of the model
        keep = [c for c in df.columns if c != "features"]
        rows = df.select(F.struct(*[df[c] for c in keep]).alias("_row"), vector_to_array("features").alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    t = held.value
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(t.score(0, len(t.value), x, t.cut))], ["_row", "f"])

        p = 1 / (1 + F.exp(2 * F.col("f")))  # of class 0
        return rows.mapInArrow(run, rows.select("_row").schema.add("f", "double")).select(
            "_row.*", (F.col("f") > 0).cast("double").alias("prediction"), array_to_vector(F.array(p, 1 - p)).alias("probability"))
