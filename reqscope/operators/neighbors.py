"""Exact k-nearest neighbours, KNN scores and local outlier factor.

Up to REF_ROWS reference rows, as counted, go to the tasks as one block, and the queries stream
past it in their own partitions.  More are searched by a pivot index, which moves nothing
through the driver but at most PIVOT_SAMPLE rows to choose pivots from:

  * Every row belongs to the ring list of its nearest pivot, ordered by the distance to it; runs
    of a list are blocks, which know their least and largest distance to each pivot.  Queries
    are laid out in the same way, in smaller blocks.
  * By the triangle inequality, the gap between two blocks' distances to any pivot bounds the
    distance of their rows.  A query block first searches its HOMES nearest blocks, which
    gives every query a kth distance; then only the pairs of blocks whose bound does not exceed
    the largest kth distance of the query block are opened, and a window merges the lists.
  * Blocks are tables and meet by cogroup, a few reference blocks with a few query blocks at a time,
    so a block is sent once for several pairs, and neither a hot block nor many copies of one vector gather in a task.
  * Blocks are sent in passes, each of about the bytes that all blocks have, and what a pass has shuffled
    is dropped before the next: disks hold a few times the rows, however many pairs are opened.

Ties are broken by the reference id, so results do not depend on partitioning.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

log = logging.getLogger(__name__)

#: Reference rows that are broadcast as one block at most.
REF_ROWS = 32_768
#: Pivots, the rows they are chosen from, rows of a reference block (a query block has a quarter).
PIVOTS, PIVOT_SAMPLE, BLOCK_ROWS = 32, 2048, 2048
#: Blocks searched first; summaries compared at a time; query blocks that meet AGAINST reference blocks together.
HOMES, SUMMARIES, TOGETHER, AGAINST = 2, 1024, 32, 8
#: Parts that either side is dealt to at least, before more than TOGETHER and AGAINST blocks meet, at most MORE times as many.
PARTS, MORE = 16, 4
#: Bytes of blocks that a pass sends at least.
PASS_BYTES = 1 << 28
#: Candidates whose exact distances are taken at a time.
CANDIDATES = 65_536
NEIGHBOR_SCHEMA = "qid long, rank int, rid long, dist double"
BLOCK_SCHEMA = "block long, n long, ids binary, vecs binary, low binary, high binary"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("ids", "vecs", "low", "high")]])
FIRST_SCHEMA = "q long, most double, limits binary, homes array<long>, found array<struct<qid:long,rid:long,dist:double>>"
FIRST_ARROW = pa.schema([("q", pa.int64()), ("most", pa.float64()), ("limits", pa.binary()), ("homes", pa.list_(pa.int64())),
                         ("found", pa.list_(pa.struct([("qid", pa.int64()), ("rid", pa.int64()), ("dist", pa.float64())])))])


def _nearest(qid: np.ndarray, qv: np.ndarray, rid: np.ndarray, rv: np.ndarray, k: int, exclude_self: bool, limit: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest of each query row (``at``: its place), with ``limit`` only those that are not
    farther than the row's own limit."""
    # candidate selection with the dot-product form (without the query's own square), exact distances for the kept ones
    q2, r2 = (qv * qv).sum(1), (rv * rv).sum(1)
    form = (-2.0 * qv) @ rv.T
    form += r2
    if exclude_self:
        for i in np.flatnonzero(np.isin(qid, rid)):
            form[i, rid == qid[i]] = np.inf
    most = np.full(len(qid), np.inf)
    if limit is not None:
        square = limit * limit
        most = square + 1e-6 * np.maximum(1.0, square) + 1e-12 * (q2 + r2.max(initial=0.0)) - q2
    keep = form <= most[:, None]  # not those without a number
    crowded = np.flatnonzero(np.count_nonzero(keep, axis=1) > k)
    groups = 4 * k
    width = len(rid) // groups if k else 0
    if len(crowded) and width > 1:
        # the kth of the least of groups of rows is not below the kth of all rows
        least = np.fmin.reduce(form[crowded, :groups * width].reshape(len(crowded), groups, width), axis=2)
        kth = np.partition(np.where(np.isnan(least), np.inf, least), k - 1, axis=1)[:, k - 1]
        kth = kth + 1e-6 * np.maximum(1.0, np.abs(kth + q2[crowded]))
        keep[crowded] &= form[crowded] <= kth[:, None]
    keep[~np.isfinite(q2)] = False
    if exclude_self or not np.isfinite(r2).all():
        keep &= np.isfinite(form)
    out, ends = [], np.concatenate([[0], np.cumsum(np.count_nonzero(keep, axis=1))])
    lo = 0
    while lo < len(qid):  # rows of at most CANDIDATES candidates at a time, one row at least
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CANDIDATES, "right")) - 1)
        at, ref = np.nonzero(keep[lo:hi])
        at = at + lo
        exact = ((rv[ref] - qv[at]) ** 2).sum(1)
        order = np.lexsort((rid[ref], exact, at))
        at, ref, exact = at[order], ref[order], exact[order]
        rank = np.arange(1, len(at) + 1) - (ends[at] - ends[lo])
        first = rank <= k
        out.append((at[first], rank[first], rid[ref[first]], np.sqrt(exact[first])))
        lo = hi
    at, rank, ref, dist = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(4))
    if limit is not None:
        near = dist <= limit[at]
        at, rank, ref, dist = at[near], rank[near], ref[near], dist[near]
    return pd.DataFrame({"at": at, "qid": qid[at], "rank": rank, "rid": ref, "dist": dist})


def _broadcast_knn(q: DataFrame, r: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """All reference rows, at most REF_ROWS as counted, in one block that the queries stream past."""
    rows = r.collect()
    if not rows:
        return q.sparkSession.createDataFrame([], NEIGHBOR_SCHEMA)
    held = q.sparkSession.sparkContext.broadcast((np.array([x["id"] for x in rows], np.int64), np.array([x["vec"] for x in rows], np.float64)))

    def search(frames):
        ids, vectors = held.value
        for f in frames:
            for lo in range(0, len(f), 128):  # a bounded matrix of distances
                part = f.iloc[lo:lo + 128]
                yield _nearest(part["id"].to_numpy(np.int64), np.stack(part["vec"].to_numpy()).astype(np.float64), ids, vectors, k, exclude_self).drop(columns="at")

    return q.mapInPandas(search, NEIGHBOR_SCHEMA)


# ------------------------------------------------------------------ pivot index

def choose_pivots(refs: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """At most ``n`` reference vectors far from each other, out of a bounded sample by id hash."""
    rows = refs.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    v = np.array([r["vec"] for r in rows], np.float64)
    picked, far = [0], np.sqrt(((v - v[0]) ** 2).sum(1))
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.sqrt(((v - v[picked[-1]]) ** 2).sum(1)))
    return v[picked]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * v @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def _ring(pivots: np.ndarray):
    """Nearest pivot and the distance to it: the ring list that a row belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _to_pivots(_matrix(b.column("vec")), pivots)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["id", "vec", "cell", "near"])
    return run


def _rings_to_blocks(pivots: np.ndarray, size: int, kind: str):
    """Runs of ``size`` rows of a cell, by distance, with the least and largest distance to each pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, cell, seq = [], [], None, 0
        part = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            v = np.concatenate(vecs)
            d = _to_pivots(v, pivots)
            slack = 1e-7 * (1.0 + d.max(0) + np.abs(v).max())  # distances to pivots are rounded
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + seq], "n": [len(v)], "ids": [np.concatenate(ids).tobytes()], "vecs": [v.astype(kind).tobytes()],
                                               "low": [(d.min(0) - slack).tobytes()], "high": [(d.max(0) + slack).tobytes()]}, schema=BLOCK_ARROW)

        held = 0
        for b in batches:
            cells, v, i = b.column("cell").to_numpy(), _matrix(b.column("vec")), b.column("id").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                at = x
                while at < y:
                    if held and (held == size or cells[at] != cell):
                        yield block()
                        ids, vecs, held, seq = [], [], 0, seq + 1
                    take = min(y - at, size - held)
                    ids.append(i[at:at + take])
                    vecs.append(v[at:at + take])
                    cell, held, at = cells[at], held + take, at + take
        if held:
            yield block()
    return run


def _blocks(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ringed = rows.mapInArrow(_ring(pivots), f"id long, vec {rows.schema['vec'].dataType.simpleString()}, cell int, near double")
    placed = ringed.repartitionByRange(parts, "cell", "near", F.xxhash64("id")).sortWithinPartitions("cell", "near", F.xxhash64("id"))
    return stored(placed.mapInArrow(_rings_to_blocks(pivots, size, _kind(rows)), BLOCK_SCHEMA), "knn-blocks")


def _kind(rows: DataFrame) -> str:
    """How blocks hold vectors: as they came; distances are worked out in float64."""
    return "<f4" if rows.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"


def _pairs(homes: bool):
    """Of some query blocks and reference blocks: for each query block its HOMES nearest (``homes``), or
    all whose bound is not above its ``most`` and that were not its homes."""
    def run(queries: pa.Table, refs: pa.Table) -> pa.Table:
        qs, rs, bounds, apart = [], [], [], []
        if queries.num_rows and refs.num_rows:
            low_r, high_r = (np.array([np.frombuffer(x, np.float64) for x in refs.column(c).to_pylist()]) for c in ("low", "high"))
            ref = refs.column("block").to_numpy()
            for row in queries.to_pylist():
                low, high = np.frombuffer(row["low"], np.float64), np.frombuffer(row["high"], np.float64)
                bound = np.maximum(np.maximum(low - high_r, low_r - high).max(1), 0.0)
                middle = np.abs((low_r + high_r) - (low + high)).sum(1)
                take = np.lexsort((middle, bound))[:HOMES] if homes else np.flatnonzero((bound <= row["most"]) & ~np.isin(ref, row["homes"]))
                qs += [row["block"]] * len(take)
                rs += ref[take].tolist()
                bounds += bound[take].tolist()
                apart += middle[take].tolist()
        return pa.table({"q": pa.array(qs, pa.int64()), "r": pa.array(rs, pa.int64()), "bound": pa.array(bounds, pa.float64()), "apart": pa.array(apart, pa.float64())})
    return run


def _block_rows(t: pa.Table, kind: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(x["block"], np.frombuffer(x["ids"], np.int64), np.frombuffer(x["vecs"], kind).astype(np.float64).reshape(x["n"], -1)) for x in t.to_pylist()]


def _search_homes(k: int, exclude_self: bool, kinds: tuple[str, str] = ("<f8", "<f8")):
    """The first neighbours of a query block, the largest distance that a better one of each of its
    rows may have, and the largest of these."""
    def run(queries: pa.Table, refs: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return FIRST_ARROW.empty_table()
        (block, ids, v), near = _block_rows(queries, kinds[0])[0], _block_rows(refs, kinds[1])
        limits = np.full(len(ids), np.inf)
        found = pd.DataFrame(columns=["at", "qid", "rank", "rid", "dist"])
        if near:
            found = _nearest(ids, v, np.concatenate([x[1] for x in near]), np.concatenate([x[2] for x in near]), k, exclude_self)
            last = found[found["rank"] == k]
            limits[last["at"].to_numpy()] = last["dist"].to_numpy() * (1 + 1e-9) + 1e-9
        return pa.Table.from_pylist([{"q": block, "most": float(limits.max()), "limits": limits.tobytes(), "homes": [x[0] for x in near], "found": [
            {"qid": int(a), "rid": int(b), "dist": float(c)} for a, b, c in zip(found["qid"], found["rid"], found["dist"])]}], schema=FIRST_ARROW)
    return run


def _search_rest(k: int, exclude_self: bool, kinds: tuple[str, str] = ("<f8", "<f8")):
    """Query blocks against those of the unit's reference blocks that each has ``wanted``; a row
    keeps the k nearest that are not farther than its kth of the first round."""
    def run(queries: pa.Table, refs: pa.Table) -> pa.Table:
        out, held = [], {block: (ids, v) for block, ids, v in _block_rows(refs, kinds[1])}
        for wanted, limits, (_, ids, v) in zip(queries.column("wanted").to_pylist(), queries.column("limits").to_pylist(), _block_rows(queries, kinds[0])):
            limit, best = np.frombuffer(limits, np.float64).copy(), None
            for block in wanted:
                f = _nearest(ids, v, *held[block], k, exclude_self, limit)
                found = [f[c].to_numpy() for c in ("at", "dist", "rid")]
                at, dist, rid = found if best is None else [np.concatenate(x) for x in zip(best, found)]
                order = np.lexsort((rid, dist, at))
                at, dist, rid = at[order], dist[order], rid[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                last, first = rank == k - 1, rank < k
                limit[at[last]] = np.minimum(limit[at[last]], dist[last])
                best = at[first], dist[first], rid[first]
            if best is not None:
                out.append(pd.DataFrame({"qid": ids[best[0]], "rid": best[2], "dist": best[1]}))
        f = pd.concat(out) if out else pd.DataFrame({"qid": [], "rid": [], "dist": []})
        return pa.table({"qid": pa.array(f["qid"], pa.int64()), "rid": pa.array(f["rid"], pa.int64()), "dist": pa.array(f["dist"], pa.float64())})
    return run


def _meet(queries: DataFrame, refs: DataFrame, n_queries: int, n_refs: int, homes: bool) -> DataFrame:
    """(q, r, bound, apart): summaries of query blocks against those of reference blocks, SUMMARIES of
    either at a time."""
    groups, slots = -(-n_refs // SUMMARIES), -(-n_queries // SUMMARIES)
    number = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("s", number(slots).cast("int")).withColumn("g", every(groups))
    right = refs.select("block", "low", "high").withColumn("g", number(groups).cast("int")).withColumn("s", every(slots))
    return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(_pairs(homes), "q long, r long, bound double, apart double")


def _bytes(blocks: DataFrame) -> tuple[int, int]:
    """(blocks, their bytes)."""
    n, size = blocks.agg(F.count("*"), F.sum((F.octet_length("ids") + F.octet_length("vecs")).cast("long"))).first()
    return n, int(size or 0)


def _in_passes(sent: int, own: int, one) -> DataFrame:
    """The union of ``one(passes, number)`` for each pass, of so many that a pass sends about ``own`` bytes."""
    passes = max(1, -(-sent // max(own, PASS_BYTES)))
    out = None
    for number in range(passes):
        part = one(passes, number)
        out = part if out is None else out.unionByName(part)
    return out


def _share(df: DataFrame, passes: int, number: int, *key: str) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(*key), F.lit(passes)) == number) if passes > 1 else df


class PivotIndex:
    """Reference rows (id, vec) in blocks, which several searches can use."""

    def __init__(self, r: DataFrame, block: int = BLOCK_ROWS) -> None:
        self.pivots, self.size, self.kind = choose_pivots(r), block, _kind(r)
        self.blocks = _blocks(r, self.pivots, block)
        self.n, self.bytes = _bytes(self.blocks)

    def search(self, q: DataFrame, k: int, exclude_self: bool, work: dict | None = None) -> DataFrame:
        refs, n_refs, kinds = self.blocks, self.n, (_kind(q), self.kind)
        queries = _blocks(q, self.pivots, max(1, self.size // 4))
        n_queries, query_bytes = _bytes(queries)
        if not n_refs or not n_queries:
            return q.sparkSession.createDataFrame([], NEIGHBOR_SCHEMA)
        of_query, of_ref, own = query_bytes // n_queries, self.bytes // n_refs, query_bytes + self.bytes
        summary = queries.select("block", "low", "high")
        near = _meet(summary.withColumns({"most": F.lit(0.0), "homes": F.array().cast("array<long>")}), refs, n_queries, n_refs, True)
        first = Window.partitionBy("q").orderBy("bound", "apart", "r")
        near = stored(near.withColumn("i", F.row_number().over(first)).where(F.col("i") <= HOMES).select("q", "r"), "knn-homes")
        vectors = refs.select("block", "n", "ids", "vecs")
        sides = queries.select("block", "n", "ids", "vecs")

        def start_of(passes: int, number: int) -> DataFrame:
            shipped = _share(near, passes, number, "q").join(vectors, near["r"] == vectors["block"])
            mine = _share(sides, passes, number, "block")
            return stored(mine.groupBy("block").cogroup(shipped.groupBy("q")).applyInArrow(_search_homes(k, exclude_self, kinds), FIRST_SCHEMA), "knn-first")

        start = _in_passes(query_bytes + n_queries * min(HOMES, n_refs) * of_ref, own, start_of)
        left = summary.join(start.select(F.col("q").alias("block"), "most", "homes"), "block")
        rest = _meet(left, refs, n_queries, n_refs, False).select("q", "r")
        # a few reference blocks meet a few query blocks, so a block is sent once for several pairs
        against = max(AGAINST, min(MORE * AGAINST, n_refs // PARTS))
        together = max(TOGETHER, min(MORE * TOGETHER, n_queries // PARTS))
        groups, slots = -(-n_refs // against), -(-n_queries // together)
        units = stored(rest.select("q", "r", F.pmod(F.xxhash64("r"), F.lit(groups)).alias("group"), F.pmod(F.xxhash64("q"), F.lit(slots)).alias("slot")), "knn-pairs")
        limits = start.select(F.col("q").alias("_q"), "limits")
        wants = units.groupBy("group", "slot", "q").agg(F.collect_list("r").alias("wanted"))
        needed = units.select(F.col("group").alias("of"), F.col("slot").alias("part"), F.col("r").alias("unit")).distinct()
        opened, asked_for, sent = units.count(), wants.count(), needed.count()

        def more_of(passes: int, number: int) -> DataFrame:
            asked = _share(wants, passes, number, "group", "slot").join(sides, wants["q"] == sides["block"]).join(limits, wants["q"] == limits["_q"])
            held = _share(needed, passes, number, "of", "part").join(vectors, needed["unit"] == vectors["block"])
            return stored(asked.select("group", "slot", "block", "n", "ids", "vecs", "wanted", "limits").groupBy("group", "slot")
                          .cogroup(held.select("of", "part", "block", "n", "ids", "vecs").groupBy("of", "part"))
                          .applyInArrow(_search_rest(k, exclude_self, kinds), "qid long, rid long, dist double"), "knn-more")

        more = _in_passes(asked_for * of_query + sent * of_ref, own, more_of)
        log.info("kNN: %d of %d pairs of blocks opened", opened + n_queries * min(HOMES, n_refs), n_queries * n_refs)
        if work is not None:
            work.update(pairs=n_queries * n_refs, opened=opened + n_queries * min(HOMES, n_refs), sent=sent)
        found = start.select(F.explode("found").alias("f")).select("f.qid", "f.rid", "f.dist").unionByName(more)
        best = Window.partitionBy("qid").orderBy("dist", "rid")
        return stored(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "rank", "rid", "dist"), "knn")


def _rows(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, vec): vectors of floats as they are, others as doubles."""
    kind = df.schema[vec].dataType.simpleString()
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))


def knn(queries: DataFrame, refs: DataFrame, k: int, qid: str = "id", rid: str = "id", vec: str = "vec",
        exclude_self: bool = False, broadcast_rows: int = REF_ROWS, work: dict | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """(qid, rank 1..k, rid, dist) — exact Euclidean neighbours of each query among ``refs``.

    Up to ``broadcast_rows`` counted reference rows go to the tasks as one block, more by the pivot
    index (``work`` gets its pairs of blocks, those opened, and the reference blocks sent for them)."""
    r, q = _rows(refs, rid, vec), _rows(queries, qid, vec)
    if r.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return _broadcast_knn(q, r, k, exclude_self)
    return PivotIndex(r, block).search(q, k, exclude_self, work)


def knn_scores(neighbors: DataFrame, ref_labels: DataFrame, label_col: str = "y", positive_label: int = 1):
    """M6: score = share of anomalous neighbours, prediction = score > 0.5."""
    j = neighbors.join(ref_labels.select(F.col("id").alias("rid"), F.col(label_col).alias("_y")), "rid")
    return j.groupBy("qid").agg((F.avg((F.col("_y") == positive_label).cast("double"))).alias("y_score")) \
        .withColumn("y_pred", (F.col("y_score") > 0.5).cast("int"))


def lof(queries: DataFrame, refs: DataFrame, k: int = 20, vec: str = "vec",
        qid: str = "id", rid: str = "id", broadcast_rows: int = REF_ROWS) -> DataFrame:
    """M8: novelty LOF of each query against ``refs``: (qid, lof); anomaly when lof > 1.5.

    Reference neighbours exclude the point itself; query neighbours do not.
    """
    r, q = _rows(refs, rid, vec), _rows(queries, qid, vec)
    if r.limit(broadcast_rows + 1).count() <= broadcast_rows:
        search = lambda rows, exclude_self: _broadcast_knn(rows, r, k, exclude_self)
        keep = lambda df, name: df
    else:  # one index for both searches, and what joins have shuffled is dropped after each step
        index, keep = PivotIndex(r), stored
        search = lambda rows, exclude_self: index.search(rows, k, exclude_self)
    ref_nn = search(r, True)
    kdist = ref_nn.where(F.col("rank") == k).select(F.col("qid").alias("rid"), F.col("dist").alias("kdist"))
    ref_reach = ref_nn.join(kdist, "rid").select(
        "qid", F.greatest(F.col("kdist"), F.col("dist")).alias("reach"))
    lrd_ref = ref_reach.groupBy("qid").agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd")) \
        .select(F.col("qid").alias("rid"), "lrd")
    near = keep(kdist.join(lrd_ref, "rid"), "lof-refs")
    qj = search(q, False).join(near, "rid")
    agg = qj.groupBy("qid").agg(
        (1.0 / (F.avg(F.greatest(F.col("kdist"), F.col("dist"))) + 1e-10)).alias("_lrd_q"),
        F.avg("lrd").alias("_lrd_nb"))
    return agg.select("qid", (F.col("_lrd_nb") / F.col("_lrd_q")).alias("lof"))
