"""Isolation forest (M7), grown in parallel, scored without a Python loop per row.

* Sampling: every tree needs the ``max_samples`` rows with the smallest
  ``md5('<seed>:<tree>:<id>')``.  Each row keeps only the trees whose hash falls
  under a threshold sized for ~1.5x the sample (plus a fixed slack), so the
  per-tree groups stay bounded; the exact smallest ones are taken inside the
  group.  If a tree comes up short the threshold is raised and sampling rerun.
* Growing: ``groupBy(tree).applyInPandas`` grows each tree (random feature,
  uniform split between the node's min and max, height limit
  ceil(log2(max_samples))) and returns its node table.
* Scoring: the node tables (trees × < 2·max_samples rows, a bounded size) are
  broadcast; a vectorised pandas UDF walks all trees for a batch of rows.
  score = 2^(-E[h(x)] / c(max_samples)); anomaly when score > 0.5.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search (as in scikit-learn)."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(seed: int, max_samples: int):
    height = int(math.ceil(math.log2(max(max_samples, 2))))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["u", "id"]).head(max_samples)
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        rng = np.random.default_rng([seed, tree])
        rows = []

        def build(idx, depth):
            node = len(rows)
            rows.append(None)
            sub = x[idx]
            if depth >= height or len(idx) <= 1:
                rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
                return node
            mins, maxs = sub.min(0), sub.max(0)
            usable = np.nonzero(maxs > mins)[0]
            if usable.size == 0:
                rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx), depth)
                return node
            f = int(rng.choice(usable))
            thr = float(rng.uniform(mins[f], maxs[f]))
            go_left = sub[:, f] < thr
            left = build(idx[go_left], depth + 1)
            right = build(idx[~go_left], depth + 1)
            rows[node] = (tree, node, f, thr, left, right, len(idx), depth)
            return node

        build(np.arange(x.shape[0]), 0)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size",
                                           "depth"])
    return fn


def path_lengths(nodes: pd.DataFrame, x: np.ndarray) -> np.ndarray:
    """Mean path length of each row of ``x`` over all trees in ``nodes`` (vectorised per tree)."""
    total = np.zeros(x.shape[0])
    n_trees = 0
    for _, t in nodes.groupby("tree"):
        n_trees += 1
        t = t.sort_values("node")
        feat, thr = t["feature"].to_numpy(), t["threshold"].to_numpy()
        left, right = t["left"].to_numpy(), t["right"].to_numpy()
        size, depth = t["size"].to_numpy(), t["depth"].to_numpy()
        cur = np.zeros(x.shape[0], dtype=np.int64)
        active = feat[cur] >= 0
        while active.any():
            idx = np.nonzero(active)[0]
            node = cur[idx]
            go_left = x[idx, feat[node]] < thr[node]
            cur[idx] = np.where(go_left, left[node], right[node])
            active = feat[cur] >= 0
        total += depth[cur] + c_factor(size[cur])
    return total / max(1, n_trees)


class IsolationForest:
    def __init__(self, n_trees: int = 100, max_samples: int = 256, seed: int = 42, slack: float = 1.5):
        self.n_trees, self.max_samples_param, self.seed, self.slack = n_trees, max_samples, seed, slack

    def fit(self, df: DataFrame, id_col: str, vec_col: str) -> "IsolationForest":
        n = df.count()
        self.max_samples = min(self.max_samples_param, n)
        factor = self.slack
        base = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_vec"))
        while True:
            tau = min(1.0, (self.max_samples * factor + 32) / max(n, 1))
            trees = F.sequence(F.lit(0), F.lit(self.n_trees - 1))
            u = lambda t: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), t.cast("string"),
                                                              F.col("_id").cast("string"))), 1, 12), 16, 10)
                           .cast("double") / float(16 ** 12))
            picked = base.select(F.col("_id").alias("id"), F.col("_vec").alias("vec"),
                               F.explode(F.filter(F.transform(trees, lambda t: F.struct(t.alias("tree"),
                                                                                     u(t).alias("u"))),
                                                  lambda s: s["u"] < tau)).alias("_t"))
            picked = picked.select("id", "vec", F.col("_t")["tree"].alias("tree"), F.col("_t")["u"].alias("u"))
            short = (picked.groupBy("tree").count().where(F.col("count") < self.max_samples).count()
                     + self.n_trees - picked.select("tree").distinct().count())
            if short == 0 or tau >= 1.0:
                break
            factor *= 2
        nodes = picked.groupBy("tree").applyInPandas(_grow(self.seed, self.max_samples), NODE_SCHEMA)
        self.nodes = nodes.toPandas()  # trees × < 2·max_samples rows
        return self

    def score(self, df: DataFrame, vec_col: str) -> DataFrame:
        """Adds ``y_score`` (anomaly score in (0, 1]) and ``y_pred`` (score > 0.5)."""
        spark = df.sparkSession
        bc = spark.sparkContext.broadcast(self.nodes)
        cn = float(c_factor([self.max_samples])[0]) or 1.0

        @F.pandas_udf("double")
        def _score(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()).astype(np.float64)
            return pd.Series(np.power(2.0, -path_lengths(bc.value, x) / cn))

        out = df.withColumn("y_score", _score(F.col(vec_col)))
        return out.withColumn("y_pred", (F.col("y_score") > 0.5).cast("int"))
