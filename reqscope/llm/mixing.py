"""Operator 9: mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to), so the
flow network has one node per pattern and per source, whatever the number of documents.  The
words of a pattern can be used once, twice, ... ``max_repeats`` times; the k-th use costs
k*k - (k-1)*(k-1), a convex cost, so fresh words are preferred to repetition.  The flow of a
pattern is then dealt to its documents: whole passes over all of them, and for the rest a
seeded order in which the last document may be used in part.

The order is two-level: documents are summed by (pattern, first hex digits of a seeded hash);
only the one bucket of a pattern in which the rest runs out is ranked row by row.  The driver
sees the pattern table, never documents.

Defined results: null text has no words.  A null source is a source of its own, ordered last;
a document with an empty or null membership list takes no part (taken 0).  Repeated rows are
documents of their own.  Empty table: empty result.  All input columns pass through.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, pack, scratch, slices, unpack, without

BUCKET_DIGITS = 3


def count_words(column: pa.Array) -> np.ndarray:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    out = [np.zeros(0, np.int64)]
    for _, _, data, at in slices(column):
        inside = ~SPACE[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        first = at[:-1][np.diff(at) > 0]
        start[first] = inside[first]
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(start, out=total[1:])
        out.append(total[at[1:]] - total[at[:-1]])
    return np.concatenate(out)


def _sizes(carry_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [c for c in b.schema.names if carry_text or c != "_text"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(count_words(b.column("_text")))], [*keep, "_size"])
    return run


def water_fill(sizes: dict, weights: dict, most: int) -> dict:
    """Exact shares of the sum of ``sizes`` by weight, none above ``most`` times its size; the
    excess is shared again by weight until none is above."""
    total, open_ = sum(sizes.values()), [s for s in sizes]
    target = {s: Fraction(0) for s in sizes}
    left = Fraction(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            target.update(share)
            break
        for s in above:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in set(above)]
    return target


def min_cost_flow(patterns: dict, quotas: dict, most: int) -> dict:
    """Words to take of each pattern: a largest flow pattern -> source, within the quotas, of
    least repetition cost (successive shortest paths; a convex cost makes the k-th use an arc
    of its own).  ``patterns``: pattern (tuple of sources) -> words."""
    graph: list[list[int]] = []
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def node() -> int:
        graph.append([])
        return len(graph) - 1

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
        return len(to) - 2

    flows = {}
    shared: dict = {}
    for p in patterns:
        for s in p:
            shared[s] = shared.get(s, 0) + 1
    alone = [p for p in patterns if len(p) == 1 and shared[p[0]] == 1]
    for p in alone:  # a component of one pattern and one source: its flow needs no search
        flows[p] = min(quotas[p[0]], most * patterns[p])
    rest = [p for p in patterns if p not in flows and p]
    source, sink = node(), node()
    at, uses = {}, {}
    for p in rest:
        mine = node()
        uses[p] = [arc(source, mine, patterns[p], k * k - (k - 1) * (k - 1)) for k in range(1, most + 1)]
        for s in p:
            if s not in at:
                at[s] = node()
                arc(at[s], sink, quotas[s], 0)
            arc(mine, at[s], most * patterns[p], 0)
    while rest:
        best, via, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in graph[x]:
                if room[e] and best[x] + cost[e] < best.get(to[e], 1 << 60):
                    best[to[e]], via[to[e]] = best[x] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if sink not in best:
            break
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    for p in rest:
        flows[p] = sum(room[e ^ 1] for e in uses[p])
    return {p: flows.get(p, 0) for p in patterns}


def mix(docs: DataFrame, sources, weights=(1, 2, 3), max_repeats: int = 3, seed: int = 0,
        id_col: str = "doc_id", text_col: str = "text", carry_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents with size and taken, table of sources).

    ``sources``: column with the array of sources of a document; ``weights`` are dealt to the
    sources in code point order, null last, again and again.  The table of sources has source,
    source_size, weight, target (double).  The pattern table must fit the driver: it grows with
    the number of distinct source combinations, not with the documents."""
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))
    packed = pack(docs, without(docs, text_col), _p=F.to_json(names), _k=F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("null")))),
                  _text=docs[f"`{text_col}`"].cast("string"))
    row = packed.schema["_row"].dataType.simpleString()
    kept = "_text string, " if carry_text else ""
    sized = scratch(packed.mapInArrow(_sizes(carry_text), f"_row {row}, _p string, _k string, {kept}_size long"), "sizes")
    buckets = sized.groupBy("_p", F.substring("_k", 1, BUCKET_DIGITS).alias("_b")).agg(F.sum("_size").alias("words"))
    buckets = scratch(buckets, "buckets")

    patterns = {r["_p"]: r["words"] for r in buckets.groupBy("_p").agg(F.sum("words").alias("words")).collect()}
    members = {p: tuple(json.loads(p)) for p in sorted(patterns)}
    total: dict = {}
    for p, who in members.items():
        for s in who:
            total[s] = total.get(s, 0) + patterns[p]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = water_fill({s: total[s] for s in order}, weight, max_repeats)
    flow = min_cost_flow({members[p]: patterns[p] for p in members}, {s: int(target[s]) for s in order}, max_repeats)

    plan = [(p, *(divmod(flow[members[p]], patterns[p]) if patterns[p] else (0, 0))) for p in members]
    plan = F.broadcast(spark.createDataFrame(plan, "_p string, passes long, rest long"))  # one row per pattern
    # the bucket of each pattern in which the rest runs out, and the words before it
    from pyspark.sql import Window

    before = F.coalesce(F.sum("words").over(Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (buckets.withColumn("before", before).join(plan, "_p")
            .where("before < rest and before + words >= rest").select("_p", "_b", "before"))
    last = {r["_p"]: (r["_b"], r["before"]) for r in last.collect()}
    cut = spark.createDataFrame([(p, *last.get(p, ("", 0))) for p in members], "_p string, cut_b string, before long")
    dealt = sized.join(plan, "_p").join(F.broadcast(cut), "_p").withColumn("_b", F.substring("_k", 1, BUCKET_DIGITS))
    at_cut = F.col("_b") == F.col("cut_b")
    w = Window.partitionBy("_p").orderBy("_k", "_size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.where(at_cut).withColumn("extra", F.greatest(F.lit(0), F.least(
        F.col("_size"), F.col("rest") - F.col("before") - F.coalesce(F.sum("_size").over(w), F.lit(0)))))
    plain = dealt.where(~at_cut).withColumn("extra", F.when(F.col("_b") < F.col("cut_b"), F.col("_size")).otherwise(0))
    done = plain.unionByName(ranked)
    columns = docs.columns if carry_text else without(docs, text_col)
    out = unpack(done, columns, {text_col: F.col("_text")} if carry_text else None, {"size": F.col("_size"), "taken": (F.col("passes") * F.col("_size") + F.col("extra")).cast("long")})
    table = spark.createDataFrame([(s, total[s], weight[s], float(target[s])) for s in order],
                                  "source string, source_size long, weight int, target double")
    return out, table


def mix_by_source(docs: DataFrame, source_col: str = "source", seed: int = 0, carry_text: bool = True) -> DataFrame:
    """One source per document: the documents with size, source_size, target and taken."""
    out, table = mix(docs, F.array(docs[f"`{source_col}`"].cast("string")), seed=seed, carry_text=carry_text)
    columns = [c for c in out.columns if c not in ("source_size", "target")]
    table = F.broadcast(table.select(F.col("source").alias("_source"), "source_size", "target"))  # one row per source
    return out.select(*[f"`{c}`" for c in columns]).join(table, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("_source")), "left").drop("_source")
