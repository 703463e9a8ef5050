"""Operator 7: exact top-k by integer inner product with block-at-a-time pruning.

Vectors are laid out in ranges of their id, cut into blocks of BLOCK rows; a block stores the
largest and smallest value of each term and, as a forward index, the vectors themselves.  For
a query, the sum over terms of what the term can add at most (its weight times the largest or,
if the weight is negative, the smallest value) bounds every score in the block.  Blocks are
opened by falling bound until the next bound is below the query's kth score, so no result can
be missed.

Queries go in blocks of QUERY_BLOCK against groups of GROUP blocks, each pair a task of bounded
size that returns at most k rows per query; a window merges them.  The work is queries x rows
by definition; what is pruned depends on how unlike the ranges are.

Defined results: vectors that are null, empty, or hold a null or non-finite component, and rows
without id, take no part; shorter vectors count as padded with zeros.  Repeated ids are rows of
their own; a query leaves out its own row only.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import default_parts, scratch

BLOCK = 512
GROUP = 32
QUERY_BLOCK = 1024
BLOCKS = "part int, seq int, dim int, ids binary, rids binary, vectors binary"


def whole_vectors(rows: DataFrame, vector: Column, ident: Column, factor: int = 64) -> DataFrame:
    """(vec_id, rid, v): floor(factor * x) of each component of the vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    table = rows.select(ident.cast("long").alias("vec_id"), vector.cast("array<double>").alias("v"), finite.alias("ok"))
    table = table.where("ok and vec_id is not null and size(v) > 0").select(
        "vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(factor))).cast("long")).alias("v"))
    return table.withColumn("rid", F.monotonically_increasing_id())


def _blocks(block: int):
    """Blocks of consecutive rows of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        part, seq = 0, 0

        def pack(rows: list) -> pa.RecordBatch:
            dim = max(len(r[2]) for r in rows)
            m = np.zeros((len(rows), dim), np.int64)
            for k, r in enumerate(rows):
                m[k, :len(r[2])] = r[2]
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "dim": pa.array([dim], pa.int32()),
                "ids": [np.array([r[0] for r in rows], np.int64).tobytes()], "rids": [np.array([r[1] for r in rows], np.int64).tobytes()],
                "vectors": [m.tobytes()]})

        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            lists = b.column("v")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            ids, rids = b.column("vec_id").to_numpy(), b.column("rid").to_numpy()
            for k in range(b.num_rows):
                held.append((ids[k], rids[k], flat[at[k]:at[k + 1]]))
                if len(held) == block:
                    yield pack(held)
                    held, seq = [], seq + 1
        if held:
            yield pack(held)

    return run


def _load(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for x in t.select(["part", "seq", "dim", "ids", "rids", "vectors"]).to_pylist():
        out.append((np.frombuffer(x["ids"], np.int64), np.frombuffer(x["rids"], np.int64), np.frombuffer(x["vectors"], np.int64).reshape(-1, x["dim"])))
    return out


def _wide(m: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m


def best_of_blocks(q_rid: np.ndarray, q: np.ndarray, blocks: list, k: int) -> tuple[list[list[tuple[int, int, int]]], int]:
    """For each query the k best (-score, id, rid) of the blocks, and how many (query, block)
    pairs were opened."""
    dim = max([q.shape[1], *(b[2].shape[1] for b in blocks)])
    q = _wide(q, dim)
    vectors = [_wide(b[2], dim) for b in blocks]
    high, low = np.stack([v.max(0) for v in vectors]), np.stack([v.min(0) for v in vectors])
    peak = max([1, int(np.abs(q).max()), int(max(np.abs(high).max(), np.abs(low).max()))])
    kind = np.float64 if peak * peak * dim < 1 << 53 else object  # exact in either
    qk = q.astype(kind)
    plus, minus = np.maximum(qk, 0), np.minimum(qk, 0)
    bound = plus @ high.astype(kind).T + minus @ low.astype(kind).T
    order = np.argsort(-bound, axis=1, kind="stable")
    vectors = [v.astype(kind) for v in vectors]
    best: list[list[tuple[int, int, int]]] = [[] for _ in q]
    live, opened = np.arange(len(q)), 0
    for p in range(len(blocks)):
        nxt = order[live, p]
        go = np.array([len(best[i]) < k or bound[i, b] >= -best[i][-1][0] for i, b in zip(live.tolist(), nxt.tolist())], bool)
        live, nxt = live[go], nxt[go]
        if not len(live):
            break
        for b in np.unique(nxt).tolist():
            who = live[nxt == b]
            score = qk[who] @ vectors[b].T
            ids, rids = blocks[b][0], blocks[b][1]
            opened += len(who)
            for i, s in zip(who.tolist(), score):
                can = np.flatnonzero((s >= -best[i][-1][0]) & (rids != q_rid[i])) if len(best[i]) >= k else np.flatnonzero(rids != q_rid[i])
                if len(can) > k:
                    can = can[np.lexsort((ids[can], -s[can].astype(np.float64) if kind is object else -s[can]))[:4 * k]] if kind is not object else can
                best[i] = sorted(best[i] + [(-int(x), y, z) for x, y, z in zip(s[can].tolist(), ids[can].tolist(), rids[can].tolist())])[:k]
    return best, opened


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if queries.num_rows and candidates.num_rows:
            blocks = _load(candidates)
            for ids, rids, q in _load(queries):
                best, _ = best_of_blocks(rids, q, blocks, k)
                rows += [(r, i, y, z, -x) for r, i, found in zip(rids.tolist(), ids.tolist(), best) for x, y, z in found]
        cols = list(zip(*rows)) if rows else [()] * 5
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("q_rid", "query_id", "vec_id", "c_rid", "score"), cols)})
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of all other rows for each query row.

    ``vectors``: result of ``whole_vectors``; ``is_query``: condition on vec_id."""
    spark = vectors.sparkSession
    parts = default_parts(spark)
    kept = scratch(vectors, "vectors")
    ranged = kept.repartitionByRange(parts, "vec_id", "rid").sortWithinPartitions("vec_id", "rid").withColumn("part", F.spark_partition_id())
    ranged = ranged.select("vec_id", "rid", "v", "part")
    candidates = scratch(ranged.mapInArrow(_blocks(BLOCK), BLOCKS), "blocks")
    asked = kept.where(is_query)
    asks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.repartitionByRange(asks, "vec_id", "rid").withColumn("part", F.spark_partition_id()).select("vec_id", "rid", "v", "part")
    queries = scratch(asked.mapInArrow(_blocks(QUERY_BLOCK), BLOCKS), "queries")
    groups = max(1, -(-candidates.count() // GROUP))
    # each side is numbered, and goes to every number of the other side
    left = queries.withColumn("q", F.pmod(F.xxhash64("rids"), F.lit(asks)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = candidates.withColumn("grp", F.pmod(F.xxhash64("rids"), F.lit(groups)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    found = left.groupBy("q", "grp").cogroup(right.groupBy("q", "grp")).applyInArrow(_search(k), "q_rid long, query_id long, vec_id long, c_rid long, score long")
    w = Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "c_rid")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
