"""Connected components of a link table, in Spark, by contraction.

A level contracts the links of every task by union-find (bounded chunks), deals the result by
node, and contracts again: every node now has one label, and the labels that met at a node but
differ are the links of the next, smaller level.  Labels are chosen by a hash that is new on
every level, so that even a path shrinks by a constant factor.  A node occurs once per chunk,
so no node, however many links it has, gathers its links in one task.  A level of at most SMALL
links is finished by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import default_parts, scratch, seeded

CHUNK = 1 << 20
#: Links that one task may finish alone.
SMALL = 1 << 17
LABELS = "node long, label long, hook boolean"


def _union(a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their labels): connected parts of the links, labelled by the node of least hash."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    rank = np.argsort(np.argsort(seeded(nodes.view(np.uint64), 300 + level), kind="stable"), kind="stable")
    label = rank.copy()
    x, y = inverse[:len(a)], inverse[len(a):]
    while True:  # labels fall along links and along labels until nothing changes
        low = np.minimum(label[x], label[y])
        now = label.copy()
        np.minimum.at(now, x, low)
        np.minimum.at(now, y, low)
        of_rank = np.empty_like(rank)
        of_rank[rank] = now
        now = np.minimum(now, of_rank[now])
        if (now == label).all():
            break
        label = now
    by_rank = np.empty_like(nodes)
    by_rank[rank] = nodes
    return nodes, by_rank[label]


def _contract(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            nodes, labels = _union(a, b, level)
            return pa.RecordBatch.from_pydict({"node": nodes, "label": labels, "hook": np.zeros(len(nodes), bool)})

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= CHUNK:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _merge(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not sum(len(h[0]) for h in held):
            return
        node, label = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        every, final = _union(node, label, level)
        own = np.unique(node)
        met = np.unique(label)
        to = final[np.searchsorted(every, met)]
        differ = met != to
        yield pa.RecordBatch.from_pydict({"node": own, "label": final[np.searchsorted(every, own)], "hook": np.zeros(len(own), bool)})
        yield pa.RecordBatch.from_pydict({"node": met[differ], "label": to[differ], "hook": np.ones(int(differ.sum()), bool)})

    return run


def components(links: DataFrame, level: int = 0) -> DataFrame:
    """(node, root) for every node of the first two columns of ``links`` (long); connected nodes
    have the same root, one of them.  Rows with a null say nothing and are left out."""
    a, b = links.columns[:2]
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    if level and pairs.count() <= SMALL:
        return pairs.coalesce(1).mapInArrow(_contract(level), LABELS).select("node", F.col("label").alias("root"))
    dealt = pairs.mapInArrow(_contract(level), LABELS).repartition(default_parts(links.sparkSession), "node")
    merged = scratch(dealt.mapInArrow(_merge(level), LABELS), "components")
    labels, hooks = merged.where("not hook").select("node", "label"), merged.where("hook").select("node", "label")
    if hooks.isEmpty():
        return labels.withColumnRenamed("label", "root")
    above = components(hooks, level + 1).select(F.col("node").alias("_label"), "root")
    return labels.join(above, labels["label"] == above["_label"], "left").select("node", F.coalesce("root", "label").alias("root"))
