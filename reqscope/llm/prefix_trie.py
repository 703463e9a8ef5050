"""Operator 12: prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns; conversations that begin with it share the work of
reading it.  A prefix is known by the exclusive or of 120 bits of SHA-256 of each turn mixed with
its place, so that all prefixes come from running values (``scan``), however long a conversation;
nodes are then one aggregation.  For the subtrees, every node gives an arc that enters it and an
arc that leaves it: entering goes on to the first child or, at a leaf, to leaving; leaving goes on
to the next sibling or to leaving the parent.  The tour is ranked distributedly (``list_rank``);
in the order of the ranks, running sums of leaves and of savings at a node's two arcs differ by
exactly what its subtree holds.  No group is gathered: children are a range of consecutive
numbers, and what a parent tells its children is salted over pieces of that range.

A node's savings are (members - 1) times the UTF-8 bytes of its last text.

Defined results: null role or text is empty; null turns come first; equal turns of a conversation
go by the SHA-256 of "length of role:role text"; rows without conversation id take no part; all
rows count, also repeated ones; a table without conversations has no nodes, not even a root.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import default_parts, scratch
from .list_rank import SMALL, distances
from .scan import running

#: Rows of a key that go to one place; a key with more is dealt by pieces of so many.
PIECE = 4096
#: Ids that make one piece of a list to be hashed.
LIST_PIECE = 4096


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, t1, t2, size): turns numbered from 0, their 120-bit digest, and bytes of text."""
    role, text = (F.coalesce(rows[f"`{c}`"].cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda k: F.conv(F.substring(digest, k, 15), 16, 10).cast("long")
    turns = rows.select(rows[f"`{conv_col}`"].cast("long").alias("conv_id"), rows[f"`{turn_col}`"].alias("turn"), part(1).alias("t1"), part(16).alias("t2"),
                        F.octet_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("one")).where("conv_id is not null")
    numbered = running(turns, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")], keys=["conv_id"], add=["one"], name="turns")
    return numbered.select("conv_id", (F.col("run_one") - 1).alias("pos"), "t1", "t2", "size")


def borrow_heads(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first ``head`` turns (``most`` at most) of conversation ``base``, both
    expressions of conv_id, then the own turns after the first ``head``.

    Returns the turns with ``total`` turns of their conversation, and all (conv_id, total)."""
    few = F.when(F.col("pos") < most, F.struct("pos", "t1", "t2", "size"))
    convs = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"), F.sort_array(F.collect_list(few)).alias("first"))  # at most ``most``
    convs = scratch(convs, "conversations", free=False)
    lent = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("lent"))
    plan = convs.select("conv_id", "n", head.cast("int").alias("h"), base.alias("base")).join(lent, "base", "left")
    plan = plan.withColumn("lent", F.when(F.col("lent").isNotNull(), F.slice("lent", 1, F.col("h")))).withColumn("k", F.when(F.col("lent").isNull(), 0).otherwise(F.size("lent")))
    plan = scratch(plan.withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "n", "h", "k", "total", "lent"), "plan", free=False)
    heads = plan.select("conv_id", "total", F.explode("lent").alias("x")).select("conv_id", "total", "x.pos", "x.t1", "x.t2", "x.size")
    asked = plan.select("conv_id", "h", "k", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))).alias("piece"))
    own = turns.withColumn("piece", F.floor(F.col("pos") / PIECE)).join(asked, ["conv_id", "piece"]).where("pos >= h")
    own = own.select("conv_id", "total", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "t1", "t2", "size")
    return heads.unionByName(own), plan.select("conv_id", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """The turns with the key (k1, k2) of the prefix that ends with them and that (p1, p2) before."""
    mixed = turns.withColumn("x1", F.xxhash64("t1", "pos", F.lit(1))).withColumn("x2", F.xxhash64("t2", "pos", F.lit(2)))
    keyed = running(mixed, [F.col("conv_id"), F.col("pos")], keys=["conv_id"], xor=["x1", "x2"], name="prefixes")
    return keyed.select("conv_id", "pos", "total", "size", F.col("run_x1").alias("k1"), F.col("run_x2").alias("k2"),
                        F.col("run_x1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("run_x2").bitwiseXOR(F.col("x2")).alias("p2"))


def _join_ids(batches: Iterator[pa.RecordBatch], most: int = LIST_PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a node as comma-joined pieces of ``most`` ids at most."""
    held: tuple | None = None
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2][0] for r in out], pa.int64()),
                                           pa.array([",".join(map(str, r[2])) for r in out])], ["k1", "k2", "first", "ids"])

    for b in batches:
        k1, k2, ids = (b.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
        cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if hi == lo:
                continue
            key, run = (int(k1[lo]), int(k2[lo])), ids[lo:hi].tolist()
            if held is not None and held[:2] == key:
                run = held[2] + run
            elif held is not None:
                out.append(held)
            for k in range(0, len(run) - most, most):
                out.append((*key, run[k:k + most]))
            held = (*key, run[(len(run) - 1) // most * most:])
        if out:
            yield batch()
            out = []
    if held is not None:
        out = [held]
        yield batch()


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node, which come in order."""
    key, state = None, None
    for b in batches:
        out = []
        for k1, k2, ids in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("ids").to_pylist()):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["k1", "k2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], ["k1", "k2", "ends_sha256"])


def hash_ends(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): the digest of each node's ids, ascending."""
    parts = default_parts(ends.sparkSession)
    order = ["k1", "k2", "conv_id"]
    pieces = ends.select(order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_join_ids, "k1 long, k2 long, first long, ids string")
    dealt = pieces.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return dealt.mapInArrow(_hash_lists, "k1 long, k2 long, ends_sha256 string")


def tour(nodes: DataFrame) -> DataFrame:
    """(item, next): the arcs of the Euler tour; 2 * id enters a node, 2 * id + 1 leaves it.

    ``nodes``: id, first_child, last_child (null at leaves), has_next (a sibling with id - 1)."""
    enter = lambda c: F.col(c) * 2
    leave = lambda c: F.col(c) * 2 + 1
    arc = lambda a, b: F.struct(a.alias("item"), b.alias("next"))
    none = F.lit(None).cast("long")
    arcs = F.array(arc(enter("id"), F.coalesce(enter("first_child"), leave("id"))),
                   F.when(F.col("last_child").isNotNull(), arc(leave("last_child"), leave("id"))),
                   F.when(F.col("has_next"), arc(leave("id"), (F.col("id") - 1) * 2)),
                   F.when(F.col("depth") == 0, arc(leave("id"), none)))
    return nodes.select(F.explode(F.filter(arcs, lambda x: x.isNotNull())).alias("x")).select("x.item", "x.next")


def trie(turns: DataFrame, convs: DataFrame, small: int = SMALL) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens of its subtree, ends_sha256.

    ``turns``: (conv_id, pos, t1, t2, size, total); ``convs``: all (conv_id, total), turnless ones too."""
    keyed = scratch(prefixes(turns), "prefixes", free=False)
    zero = F.lit(0).cast("long")
    inner = keyed.groupBy("k1", "k2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min("conv_id").alias("conv_id"), (F.first("pos") + 1).alias("depth"),
                                          F.count("*").alias("n_convs"), F.first("size").alias("size"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("k1"), zero.alias("k2"), F.lit(-1).cast("long").alias("p1"), zero.alias("p2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("size"))
    ends = hash_ends(keyed.where("pos = total - 1").select("k1", "k2", "conv_id").unionByName(convs.where("total = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id")))
    # siblings get consecutive ids, the smallest member last; the root, top 0, is no one's sibling
    nodes = inner.withColumn("top", F.lit(1).cast("long")).unionByName(root.withColumn("top", zero)).withColumn("one", F.lit(1).cast("long"))
    placed = running(nodes, [F.col("top"), F.col("p1"), F.col("p2"), F.col("conv_id").desc(), F.col("k1"), F.col("k2")], keys=["top", "p1", "p2"], add=["one"], index="id", name="siblings")
    placed = placed.withColumn("has_next", F.col("run_one") > 1).drop("one", "run_one")
    children = placed.where("top = 1").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"), F.max("id").alias("first_child"), F.min("id").alias("last_child"))
    nodes = scratch(placed.join(children, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left"), "nodes", free=False)
    ranks = scratch(distances(tour(nodes), small), "tour", free=False)
    # what an arc adds: entering a leaf one leaf, entering a node its own savings
    own = nodes.select((F.col("id") * 2).alias("item"), F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    marks = own.unionByName(nodes.select((F.col("id") * 2 + 1).alias("item"), zero.alias("leaf"), zero.alias("saved")))
    summed = running(ranks.join(marks, "item"), [F.col("dist").desc()], add=["leaf", "saved"], name="sums")
    entering = F.col("item") % 2 == 0
    sums = summed.groupBy(F.floor(F.col("item") / 2).alias("id")).agg(*[
        (F.max(F.when(~entering, F.col(f"run_{c}"))) - F.max(F.when(entering, F.col(f"run_{c}") - F.col(c)))).alias(f"sub_{c}") for c in ("leaf", "saved")])
    # parents tell their children their smallest member, by pieces of the children's range
    piece = lambda c: F.floor(F.col(c) / PIECE)
    told = nodes.where("n_children is not null").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"),
                                                        F.explode(F.sequence(piece("last_child"), piece("first_child"))).alias("piece"))
    below = nodes.where("depth > 0").withColumn("piece", piece("id")).join(told, ["p1", "p2", "piece"]).select("id", "parent_conv_id")
    out = nodes.join(sums, "id").join(below, "id", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("sub_leaf").alias("n_leaves"),
                      F.col("sub_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
