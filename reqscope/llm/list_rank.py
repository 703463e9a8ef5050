"""Distributed list ranking: how far every item of linked lists is from the end of its list.

Work-efficient contraction: in a round every item whose hash is above those of both neighbours
leaves (no two neighbours can, a third of the items is expected to), and the item before takes
over its link and its length.  Links are doubly kept, so an item knows by itself whether it
leaves, and a round is one exchange.  Once at most ``small`` items follow another, a bounded number,
one task walks them; the rounds are then undone backwards, an item's distance being its own
length plus that of the item it pointed to when it left.  Everything that is shuffled adds up
to a multiple of the list, not of the list times its logarithm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Items that one task may finish.
SMALL = 1 << 15
LINKS = "item long, prev long, next long, length long"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    item, nxt, length = (t.column(c).to_pylist() for c in ("item", "next", "length"))
    place = {x: k for k, x in enumerate(item)}
    prev = t.column("prev").to_pylist()
    tails = [k for k, x in enumerate(nxt) if x is None]
    dist = np.zeros(len(item), np.int64)
    for k in tails:
        far = 0
        while True:
            far += length[k]
            dist[k] = far
            if prev[k] is None:
                break
            k = place[prev[k]]
    yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int64()), "dist": pa.array(dist)})


def distances(links: DataFrame, small: int = SMALL, seed: int = 0) -> DataFrame:
    """(item, dist) of ``links`` (item, next), next null at the end of a list: the number of items
    from an item to the end of its list, itself included.  Items are bigint, once each."""
    told = links.select("item", F.lit(None).cast("long").alias("prev"), "next", F.lit(1).cast("long").alias("length")).unionByName(
        links.where("next is not null").select(F.col("next").alias("item"), F.col("item").alias("prev"), F.lit(None).cast("long").alias("next"), F.lit(None).cast("long").alias("length")))
    follows = F.col("prev").isNotNull()  # the first of a list never leaves
    left = scratch(told.groupBy("item").agg(F.max("prev").alias("prev"), F.max("next").alias("next"), F.max("length").alias("length")), "links", free=False)
    rounds: list[DataFrame] = []
    while left.where(follows).count() > small:
        rank = lambda c: F.xxhash64(F.col(c), F.lit(seed + len(rounds)))  # noqa: B023, E731
        above = lambda a, b: (rank(a) > rank(b)) | ((rank(a) == rank(b)) & (F.col(a) > F.col(b)))  # noqa: B023, E731
        leaves = follows & above("item", "prev") & (F.col("next").isNull() | above("item", "next"))
        marked = left.withColumn("_leaves", F.coalesce(leaves, F.lit(False)))
        gone = scratch(marked.where("_leaves").select("item", "next", "length", "prev"), "left-links", free=False)
        none = F.lit(None).cast("long")
        stays = marked.where("not _leaves").select("item", "prev", "next", "length", none.alias("new_prev"), none.alias("new_next"), none.alias("more"), F.lit(False).alias("cut"))
        ahead = gone.select(F.col("prev").alias("item"), none.alias("prev"), none.alias("next"), none.alias("length"), none.alias("new_prev"),
                            F.col("next").alias("new_next"), F.col("length").alias("more"), F.lit(True).alias("cut"))
        behind = gone.where("next is not null").select(F.col("next").alias("item"), none.alias("prev"), none.alias("next"), none.alias("length"),
                                                       F.col("prev").alias("new_prev"), none.alias("new_next"), none.alias("more"), F.lit(False).alias("cut"))
        one = stays.unionByName(ahead).unionByName(behind).groupBy("item").agg(
            F.coalesce(F.max("new_prev"), F.max("prev")).alias("prev"),
            F.when(F.max("cut"), F.max("new_next")).otherwise(F.max("next")).alias("next"),
            (F.max("length") + F.coalesce(F.max("more"), F.lit(0))).alias("length"))
        left = scratch(one, "links", free=False)
        rounds.append(gone)
    done = follows | F.col("next").isNotNull()
    walked = left.where(done).coalesce(1).mapInArrow(_finish, "item long, dist long")  # twice ``small`` at most
    known = [scratch(walked.unionByName(left.where(~done).select("item", F.col("length").alias("dist"))), "ranks", free=False)]
    for gone in reversed(rounds):
        so_far = reduce(DataFrame.unionByName, known).select(F.col("item").alias("next"), F.col("dist").alias("rest"))
        known.append(scratch(gone.join(so_far, "next", "left").select("item", (F.col("length") + F.coalesce(F.col("rest"), F.lit(0))).alias("dist")), "ranks", free=False))
    return reduce(DataFrame.unionByName, known)
