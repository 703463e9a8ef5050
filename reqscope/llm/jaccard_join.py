"""Operator 8: exact n-gram Jaccard join with a token-group matrix.

1.  Documents with equal shingle sets form a class.
2.  Partition: the token space is hashed into slices, a few more than two sets above the
    threshold can differ in tokens, so such sets agree on at least one whole non-empty slice.
    Classes that agree on a slice are tied together (each slice content names one pivot, so a
    group of n copies makes n ties, not n * n pairs), and the connected ties are the groups.
    Every link lies inside one group.
3.  A large group is divided again: short slices of frequent tokens tie many sets that are not
    alike.  Two linked sets share one of their rarest tokens, as many as they can differ in and
    one more (prefix filter); only sets that share such a token stay tied.  Beyond COUNTED tokens
    their numbers are counted exactly, by shards of tokens, as a table of cells would be full and
    no token rare: chance meetings then tie most sets again.
4.  Token-group matrix: a group is cut into subgroups; each stores the union of its tokens.
    A query opens a subgroup only if its overlap with that union can reach the threshold;
    members of opened subgroups are compared exactly.
5.  A group that is still large is cut into blocks.  First all blocks meet the leader block; what is then
    connected needs no further comparison, so only blocks of the members outside the largest
    connected part meet all others.

Slices are matched inside map tasks first and then by slice content, so the commonest content
costs one row per map batch.  Nothing is capped; a set whose slices are too often empty is
dealt by a second hash, and in the end by its smallest tokens (prefix filter).

Defined results: null text, no words: empty set, linked with nothing.  Fewer words than
``width``: the whole sequence is the only shingle.  Repeated rows are documents of their own
with equal sets.  component_id is the smallest non-null doc_id that is reachable (null if all
are null).  Shingles are 64-bit hashes, classes 128-bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_long, default_parts, distinct_sets, mix64, pack, scratch, seeded, shingles, slices, text_of, trim, unpack, word_hashes
from .components import components

SEEDS = 4
BLOCK = 512
SUBGROUP = 16
#: Slice contents that a map task matches at a time.
HELD = 1 << 19
#: Cells of the frequency table of tokens (as a power of two), and parts by which it is summed.
CELL_BITS, PARTS = 21, 64
#: Tokens up to which that table tells rare ones; more are counted exactly, SHARE a shard at most on average.
COUNTED, SHARE = 1 << 19, 1 << 21
ENTRY = np.dtype([("sig", "<u8"), ("node", "<i8")])


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct shingles, row of each) by slices of a column."""
    for lo, hi, data, at in slices(column):
        h, row, _, _ = word_hashes(data, at)
        yield lo, hi, *distinct_sets(*shingles(h, row, hi - lo, width))


def set_hash(value: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each row's set, as two int64 arrays."""
    one, two = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
    np.add.at(one, row, seeded(value, 101))
    np.add.at(two, row, seeded(value, 102))
    return as_long(mix64(one)), as_long(mix64(two))


#: Bytes of sets that a pass of the second round shuffles at least.
PASS_BYTES = 1 << 26


class Bands:
    """Bands of set sizes such that sets above the threshold lie in the same or in
    neighbouring bands; for each band and its upper neighbour, by how many tokens two sets
    can differ at most and the number of slices."""

    def __init__(self, percent: int, longest: int) -> None:
        low, self.lows = 1, []
        while low <= 2 * longest + 2:
            self.lows.append(low)
            low = low * 100 // percent + 1
        lows = np.array([*self.lows, low, low * 100 // percent + 1], np.int64)
        highs = lows[1:] - 1
        self.differ = (100 - percent) * (highs[:-1] + highs[1:]) // (100 + percent)
        self.slices = self.differ + 2 + self.differ // 40
        self.slices[self.differ == 0] = 1
        self.lows = lows

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, "right") - 1


def slice_entries(value: np.ndarray, row: np.ndarray, n: np.ndarray, node: np.ndarray, bands: Bands) -> np.ndarray:
    """Slice contents of some sets, each with the set's node."""
    out = []
    own = bands.of(n)
    for below in (0, 1):
        band = own - below
        ok = (n > 0) & (band >= 0)
        for seed in range(SEEDS + 1):
            if not ok.any():
                break
            take = ok[row]
            v, r = value[take], row[take]
            m = np.where(ok, bands.slices[np.maximum(band, 0)], 0)
            differ = bands.differ[np.maximum(band, 0)]
            if seed == SEEDS:  # both sets' smallest tokens
                h = seeded(v, 55)
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                head = rank <= differ[r]
                sig = mix64(h[head] + seeded(band[r[head]].astype(np.uint64), 91))
                cells = r[head]
            else:
                base = np.zeros(len(n) + 1, np.int64)
                np.cumsum(m, out=base[1:])
                part = (seeded(v, seed) % m[r].astype(np.uint64)).astype(np.int64)
                cell = base[r] + part
                total = np.zeros(base[-1], np.uint64)
                np.add.at(total, cell, seeded(v, 77))
                full = np.flatnonzero(np.bincount(cell, minlength=base[-1]))
                cells = np.searchsorted(base, full, "right") - 1
                which = (band[cells] * np.int64(SEEDS) + seed) * np.int64(1 << 32) + full - base[cells]
                sig = mix64(total[full] + seeded(which.astype(np.uint64), 91))
                empty = m - np.bincount(cells, minlength=len(n))
                ok &= empty >= m - differ
            e = np.empty(len(sig), ENTRY)
            e["sig"], e["node"] = sig, node[cells]
            out.append(e)
    return np.concatenate(out) if out else np.empty(0, ENTRY)


def tie(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one entry per slice content, with its smallest node; ties of other nodes to that one)."""
    entries = entries[np.lexsort((entries["node"], entries["sig"]))]
    if not len(entries):
        return entries, np.zeros((0, 2), np.int64)
    first = np.ones(len(entries), bool)
    first[1:] = entries["sig"][1:] != entries["sig"][:-1]
    pivot = entries["node"][np.maximum.accumulate(np.where(first, np.arange(len(entries)), 0))]
    other = entries["node"] != pivot
    ties = np.unique(np.stack([entries["node"][other], pivot[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return entries[first], ties


def pack_entries(e: np.ndarray) -> bytes:
    """Entries of one shard: the lower 40 bits of the content's hash (the shard holds the upper
    ones; a chance meeting is only one more tie, and ties are verified) and a place in the list
    of nodes."""
    nodes, place = np.unique(e["node"], return_inverse=True)
    low = np.ascontiguousarray(e["sig"]).view(np.uint8).reshape(-1, 8)[:, :5]
    return np.array([len(nodes), len(e)], np.int64).tobytes() + nodes.tobytes() + place.astype(np.uint32 if len(nodes) > 65535 else np.uint16).tobytes() + low.tobytes()


def unpack_entries(blob: bytes) -> np.ndarray:
    n_nodes, n = np.frombuffer(blob, np.int64, 2).tolist()
    at = 16 + 8 * n_nodes
    nodes = np.frombuffer(blob, np.int64, n_nodes, 16)
    kind = np.uint32 if n_nodes > 65535 else np.uint16
    out = np.empty(n, ENTRY)
    out["node"] = nodes[np.frombuffer(blob, kind, n, at)]
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, at + np.dtype(kind).itemsize * n).reshape(-1, 5)
    out["sig"] = wide.view(np.uint64)[:, 0]
    return out


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, value, row in sets_of(b.column("_text"), width):
                one, two = set_hash(value, row, hi - lo)
                rows = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_pydict({"rid": rows.column("_rid"), "doc_id": rows.column("_doc"), "h1": one, "h2": two,
                                                  "n": np.bincount(row, minlength=hi - lo)})
    return run


def _shard(sig: np.ndarray, shards: int) -> np.ndarray:
    return (sig >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def _dealt(found: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """Entries matched among themselves: one blob per shard, and the ties found on the way."""
    kept, ties = tie(np.concatenate(found))
    cuts = np.searchsorted(_shard(kept["sig"], shards), np.arange(shards + 1))
    rows = [(int(s), False, pack_entries(kept[cuts[s]:cuts[s + 1]])) for s in np.flatnonzero(np.diff(cuts))]
    if len(ties):
        rows.append((int(ties[0, 0]) % shards, True, ties.tobytes()))
    return pa.RecordBatch.from_pydict({"shard": pa.array([r[0] for r in rows], pa.int32()), "tied": pa.array([r[1] for r in rows], pa.bool_()),
                                       "payload": pa.array([r[2] for r in rows], pa.binary())})


def _matched(entries: Iterator[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """Entries matched in the task, HELD at a time."""
    found, held = [], 0
    for e in entries:
        found.append(e)
        held += len(e)
        if held >= HELD:
            yield _dealt(found, shards)
            found, held = [], 0
    if found:
        yield _dealt(found, shards)


def _entries(width: int, percent: int, shards: int):
    """Slice contents, one blob per shard, and the ties found on the way."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for lo, hi, value, row in sets_of(b.column("_text"), width):
                n = np.bincount(row, minlength=hi - lo)
                one, _ = set_hash(value, row, hi - lo)
                yield slice_entries(value, row, n, one, Bands(percent, int(n.max(initial=1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _matched(each(batches), shards)

    return run


def _meet(t: pa.Table) -> pa.Table:
    trim()
    tied, payload = t.column("tied").to_pylist(), t.column("payload").to_pylist()
    entries = [unpack_entries(p) for p, x in zip(payload, tied) if not x]
    ties = [np.frombuffer(p, np.int64).reshape(-1, 2) for p, x in zip(payload, tied) if x]
    _, more = tie(np.concatenate(entries)) if entries else (None, np.zeros((0, 2), np.int64))
    both = np.unique(np.concatenate([*ties, more]), axis=0)
    return pa.table({"a": np.ascontiguousarray(both[:, 0]), "b": np.ascontiguousarray(both[:, 1])})


def linked_pairs(tokens: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, member) of sets that link, by the token-group matrix.

    ``others`` None: the pairs among ``tokens`` themselves."""
    members = tokens if others is None else others
    size = np.array([len(x) for x in members])
    order = np.lexsort((np.array([x.min() for x in members]), size))
    flat, inverse = np.unique(np.concatenate([*[members[i] for i in order], *([] if others is None else tokens)]), return_inverse=True)
    at = np.zeros(len(order) + 1, np.int64)
    np.cumsum(size[order], out=at[1:])
    sizes = size[order]
    groups = np.arange(0, len(order), SUBGROUP)
    unions = [np.unique(inverse[at[g]:at[min(g + SUBGROUP, len(order))]]) for g in groups]
    union_at = np.zeros(len(groups), np.int64)
    np.cumsum([len(u) for u in unions[:-1]], out=union_at[1:])
    matrix = np.concatenate(unions)
    largest = np.maximum.reduceat(sizes, groups)
    smallest = np.minimum.reduceat(sizes, groups)
    mark = np.zeros(len(flat), bool)
    left, right = [], []
    if others is None:
        queries = [(int(order[k]), inverse[at[k]:at[k + 1]], k) for k in range(len(order))]
    else:
        q_at = at[-1] + np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
        queries = [(k, inverse[q_at[k]:q_at[k + 1]], -1) for k in range(len(tokens))]
    for q, own, place in queries:
        n = len(own)
        mark[own] = True
        overlap = np.add.reduceat(mark[matrix], union_at, dtype=np.int64)  # bound for each subgroup
        open_ = np.flatnonzero((100 * overlap >= percent * np.maximum(n, smallest)) & (100 * largest >= percent * n))
        for g in open_:
            lo, hi = groups[g], min(groups[g] + SUBGROUP, len(order))
            if hi <= place:
                continue
            common = np.add.reduceat(mark[inverse[at[lo]:at[hi]]], at[lo:hi] - at[lo], dtype=np.int64)
            hit = lo + np.flatnonzero(100 * common >= percent * (n + sizes[lo:hi] - common))
            hit = hit[hit > place] if others is None else hit
            left.extend([q] * len(hit))
            right.extend(order[hit].tolist())
        mark[own] = False
    return np.array(left, np.int64), np.array(right, np.int64)


def _compare(percent: int):
    """Links within a unit: whole small groups, or two blocks of a large one."""
    def run(t: pa.Table) -> pa.Table:
        trim()
        cid, group, side = (t.column(c).to_numpy() for c in ("cid", "grp", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
        a, b = [], []
        order = np.lexsort((cid, group))
        bounds = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1 if len(order) else 0))
        for lo, hi in zip(bounds, [*bounds[1:], len(order)]):
            rows = order[lo:hi]
            own, other = rows[side[rows] == 0], rows[side[rows] == 1]
            if len(other):
                x, y = linked_pairs([sets[i] for i in own], [sets[i] for i in other], percent) if len(own) else ([], [])
                a.append(cid[own][x]), b.append(cid[other][y])
            elif len(own) > 1:
                x, y = linked_pairs([sets[i] for i in own], None, percent)
                a.append(cid[own][x]), b.append(cid[own][y])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})
    return run


def _tokens(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, value, row in sets_of(b.column("_text"), width):
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                rows = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_pydict({
                    "cid": rows.column("cid"), "grp": rows.column("grp"), "blocks": rows.column("blocks"),
                    "tokens": pa.array([value[at[i]:at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())})
    return run


def _pairs_of_blocks(sets: DataFrame, percent: int, units: int, passes: int = 1, number: int = 0) -> DataFrame:
    """Links of the blocks that meet: ``meets`` lists the pairs of blocks for each row's block; of
    several ``passes``, the ``number``-th takes its share of the units."""
    small = F.pmod(F.xxhash64("grp"), F.lit(units))
    large = F.xxhash64("grp", "meet.x", "meet.y").bitwiseOR(F.lit(1 << 62))
    rows = sets.select("cid", "grp", "tokens", "blocks", "block", F.explode("meets").alias("meet"))
    rows = rows.select(F.when(F.col("blocks") == 1, small).otherwise(large).alias("unit"), "cid", "grp", "tokens",
                       F.when(F.col("meet.x") == F.col("meet.y"), 0).otherwise((F.col("block") == F.col("meet.y")).cast("int")).alias("side"))
    rows = rows.where(F.pmod("unit", F.lit(passes)) == number) if passes > 1 else rows
    return rows.groupBy("unit").applyInArrow(_compare(percent), "a long, b long")


def _cell(token: np.ndarray) -> np.ndarray:
    return (seeded(token, 31) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of a task's tokens in each cell, at most 65,535, in PARTS parts."""
    counts = np.zeros(1 << CELL_BITS, np.uint32)
    for b in batches:
        for x in b.column("tokens"):
            np.add.at(counts, _cell(np.frombuffer(x.as_buffer(), np.uint64)), 1)
    parts = np.minimum(counts, 65535).astype(np.uint16).reshape(PARTS, -1)
    some = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "counts": pa.array([parts[k].tobytes() for k in some], pa.binary())})


def _added(t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.uint16) for x in t.column("counts").to_pylist()], 0, np.uint64)
    return pa.table({"part": t.column("part")[:1], "counts": pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())})


def token_counts(sets: DataFrame) -> np.ndarray:
    """For each cell that tokens are hashed to the tokens of all sets, at most 65,535: a bounded
    summary that puts rare tokens first.  Any order would do; none leaves out a pair."""
    rows = sets.select("tokens").mapInArrow(_frequencies, "part int, counts binary").groupBy("part").applyInArrow(_added, "part int, counts binary")
    out = np.zeros((PARTS, (1 << CELL_BITS) // PARTS), np.uint16)
    for r in rows.collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint16)
    return out.ravel()


def rare_entries(token: np.ndarray, counts: np.ndarray, percent: int, group: int, node: int) -> np.ndarray:
    """The tokens that a set shares with every set it links with, one of them at least: all but
    the most frequent that make up less than what linked sets have in common.  A token whose cell
    has no other ties nothing."""
    n = len(token)
    often = counts[_cell(token)]
    head = np.lexsort((token, often))[:n - (percent * n + 99) // 100 + 1]
    head = head[often[head] > 1]
    return token_entries(token[head], group, node)


def token_entries(token: np.ndarray, group: int, node: int) -> np.ndarray:
    """Entries of tokens as the members of one group see them."""
    e = np.empty(len(token), ENTRY)
    e["sig"], e["node"] = mix64(seeded(token, 57) + seeded(np.array([group]).view(np.uint64), 91)), node
    return e


def _rare(held, percent: int, shards: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        counts = held.value
        for b in batches:
            for x, cid, group in zip(b.column("tokens"), b.column("cid").to_pylist(), b.column("grp").to_pylist()):
                yield rare_entries(np.frombuffer(x.as_buffer(), np.uint64), counts, percent, group, cid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _matched(each(batches), shards)

    return run


def _every(shards: int):
    """All tokens of the sets, HELD at a time, one blob per shard."""
    def dealt(found: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(found)
        shard = _shard(e["sig"], shards)
        e = e[np.argsort(shard, kind="stable")]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(shard.astype(np.int64), minlength=shards))])
        some = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_pydict({"shard": pa.array(some, pa.int32()), "payload": pa.array([pack_entries(e[cuts[s]:cuts[s + 1]]) for s in some], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            for x, cid, group in zip(b.column("tokens"), b.column("cid").to_pylist(), b.column("grp").to_pylist()):
                found.append(token_entries(np.frombuffer(x.as_buffer(), np.uint64), group, cid))
                held += len(found[-1])
                if held >= HELD:
                    yield dealt(found)
                    found, held = [], 0
        if found:
            yield dealt(found)

    return run


def _shared(buckets: int):
    """Of one shard, the tokens that two sets or more have, with their number, dealt by set."""
    def run(t: pa.Table) -> pa.Table:
        trim()
        e = np.concatenate([unpack_entries(p) for p in t.column("payload").to_pylist()])
        e = e[np.argsort(e["sig"], kind="stable")]
        at = np.flatnonzero(np.concatenate([[True], e["sig"][1:] != e["sig"][:-1]]))
        often = np.repeat(n := np.diff(at, append=len(e)), n)
        e, often = e[often > 1], often[often > 1].astype(np.uint32)
        bucket = e["node"] % buckets
        order = np.argsort(bucket, kind="stable")
        e, often = e[order], often[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
        some = np.flatnonzero(np.diff(cuts))
        return pa.table({"bucket": pa.array(some, pa.int32()), "shard": pa.array([t.column("shard")[0].as_py()] * len(some), pa.int32()),
                         "often": pa.array([often[cuts[k]:cuts[k + 1]].tobytes() for k in some], pa.binary()),
                         "payload": pa.array([pack_entries(e[cuts[k]:cuts[k + 1]]) for k in some], pa.binary())})
    return run


def rarest(sig: np.ndarray, node: np.ndarray, often: np.ndarray, cid: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """As ``rare_entries``, of many sets (``cid`` with ``n`` tokens) whose shared tokens are given
    with their exact number; all tokens that are not given are a set's own, and rarer."""
    by = np.argsort(cid)
    order = np.lexsort((sig, often, node))
    sig, node = sig[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    k = np.diff(first, append=len(node))
    size = n[by][np.searchsorted(cid[by], node[first])]
    room = size - (percent * size + 99) // 100 + 1 - (size - k)  # places that a set's own tokens leave
    head = np.arange(len(node)) - np.repeat(first, k) < np.repeat(room, k)
    e = np.empty(int(head.sum()), ENTRY)
    e["sig"], e["node"] = sig[head], node[head]
    return e


def _heads(percent: int, shards: int):
    def run(shared: pa.Table, sizes: pa.Table) -> pa.Table:
        trim()
        if not shared.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "tied": pa.array([], pa.bool_()), "payload": pa.array([], pa.binary())})
        sig, node = [], []
        for shard, p in zip(shared.column("shard").to_pylist(), shared.column("payload").to_pylist()):
            e = unpack_entries(p)
            sig.append(mix64(e["sig"] + (np.uint64(shard) << np.uint64(40))))
            node.append(e["node"])
        often = np.concatenate([np.frombuffer(x, np.uint32) for x in shared.column("often").to_pylist()])
        e = rarest(np.concatenate(sig), np.concatenate(node), often, sizes.column("cid").to_numpy(), sizes.column("n").to_numpy(), percent)
        return pa.Table.from_batches([_dealt([e], shards)])
    return run


def exact_ties(large: DataFrame, percent: int, shards: int) -> DataFrame:
    """Entries of the rarest tokens of each set, by the exact number of each token in its group."""
    every = large.select("cid", "grp", "tokens").mapInArrow(_every(shards), "shard int, payload binary")
    shared = scratch(every.groupBy("shard").applyInArrow(_shared(shards), "bucket int, shard int, often binary, payload binary"), "shared")
    sizes = large.select(F.pmod("cid", F.lit(shards)).cast("int").alias("of"), "cid", (F.octet_length("tokens") / 8).cast("long").alias("n"))
    return shared.groupBy("bucket").cogroup(sizes.groupBy("of")).applyInArrow(_heads(percent, shards), "shard int, tied boolean, payload binary")


def _blocks(groups: DataFrame) -> DataFrame:
    """``groups`` (cid, grp) without those that are alone, with the number of blocks of the group."""
    counts = groups.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1")
    return groups.join(counts, "grp").select("cid", "grp", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))


def _block() -> Column:
    return F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block")


def regrouped(sets: DataFrame, percent: int, shards: int) -> DataFrame:
    """The sets with their large groups divided by rare tokens; what is alone then has no links."""
    large = sets.where("blocks > 1")
    tokens = int(large.agg(F.sum(F.octet_length("tokens").cast("long"))).first()[0] or 0) // 8
    if tokens <= COUNTED:
        held = sets.sparkSession.sparkContext.broadcast(token_counts(large))
        entries = large.select("cid", "grp", "tokens").mapInArrow(_rare(held, percent, shards), "shard int, tied boolean, payload binary")
    else:
        entries = exact_ties(large, percent, max(shards, -(-tokens // SHARE)))
    ties = entries.groupBy("shard").applyInArrow(_meet, "a long, b long")
    groups = scratch(_blocks(components(ties).select(F.col("node").alias("cid"), F.col("root").alias("grp"))), "regrouped")
    again = large.select("cid", "tokens").join(groups, "cid").select("cid", "grp", "blocks", "tokens", _block())
    return scratch(sets.where("blocks = 1").unionByName(again), "tokens")


def _meeting(x: str, y: str):
    return F.struct(F.least(F.expr(x), F.expr(y)).alias("x"), F.greatest(F.expr(x), F.expr(y)).alias("y"))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, n_shingles, component_id) for every row: links where
    100 * intersection >= percent * union of the sets of ``width``-word shingles.

    ``rid`` is a 64-bit key of a row's id and text, by which it can be joined again."""
    return _rooted(docs, width, percent, id_col, text_col).drop("root")


def _rooted(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``jaccard_components`` with ``root``, which names the component also where ids are null or repeat."""
    spark = docs.sparkSession
    parts = default_parts(spark)
    rid = F.xxhash64(docs[f"`{id_col}`"], text_of(docs, text_col))
    texts = docs.select(rid.alias("_rid"), docs[f"`{id_col}`"].cast("long").alias("_doc"), text_of(docs, text_col).alias("_text"))
    members = scratch(texts.mapInArrow(_members(width), "rid long, doc_id long, h1 long, h2 long, n long"), "sets")
    classes = members.where("n > 0").groupBy("h1", "h2").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("least_id"), F.max("n").alias("n"))

    shards = parts * 2
    ties = (texts.select("_text").mapInArrow(_entries(width, percent, shards), "shard int, tied boolean, payload binary")
            .groupBy("shard").applyInArrow(_meet, "a long, b long"))
    groups = components(ties)

    # classes that share a group with another one, their number and their blocks
    inside = scratch(classes.join(groups, classes.h1 == groups.node).select("cid", F.col("root").alias("grp"), "h2"), "grouped")
    inside = _blocks(inside.select("cid", "grp"))
    sets = scratch(texts.join(inside.hint("merge"), texts["_rid"] == inside["cid"]).select("cid", "grp", "blocks", "_text")
                   .mapInArrow(_tokens(width), "cid long, grp long, blocks int, tokens binary").dropDuplicates(["cid"])
                   .select("cid", "grp", "blocks", "tokens", _block()), "tokens")
    if not sets.where("blocks > 1").isEmpty():
        sets = regrouped(sets, percent, shards)

    # round 1: whole small groups; the leader block of large ones with every block
    leader = sets.withColumn("meets", F.when(F.col("block") == 0, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.lit(0).alias("x"), y.alias("y"))))
                             .otherwise(F.array(F.struct(F.lit(0).alias("x"), F.col("block").alias("y")))))
    links = scratch(_pairs_of_blocks(leader, percent, parts * 2), "round1")

    # round 2: in large groups, members outside the largest connected part meet all blocks but the leader
    large = sets.where("blocks > 1").select("cid", "grp", "blocks", "block")
    if not large.isEmpty():
        # which blocks meet is worked out without the token sets, which then are joined once
        joined = components(links)
        part = scratch(large.join(joined, large.cid == joined.node, "left").select("cid", "grp", "blocks", "block", F.coalesce("root", "cid").alias("part")), "parts")
        main = (part.groupBy("grp", "part").agg(F.count("*").alias("k"))
                .groupBy("grp").agg(F.max(F.struct("k", "part")).alias("m")).select("grp", F.col("m.part").alias("main")))
        part = part.join(main, "grp").withColumn("out", F.col("part") != F.col("main"))
        n_out = part.where("out").groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("outs"))
        part = part.join(n_out, "grp")
        # blocks 0.. of the outside members meet each other and, as numbers after them, all blocks of the inside ones
        number = F.when(F.col("out"), F.pmod(F.xxhash64("cid"), F.col("outs"))).otherwise(F.col("outs") + F.col("block")).cast("int")
        part = part.withColumn("block", number)
        meets = F.when(F.col("out"), F.transform(F.expr("sequence(0, outs + blocks - 1)"), lambda y: F.struct(F.least("block", y).alias("x"), F.greatest("block", y).alias("y")))) \
            .otherwise(F.transform(F.expr("sequence(0, outs - 1)"), lambda y: F.struct(y.alias("x"), F.col("block").alias("y"))))
        # the lists of meetings grow with the square of a group and are small only in a file, by which Spark
        # would size them for a broadcast: they are made where they are used, and the join is a shuffle
        part = scratch(part.select("cid", "grp", "blocks", "block", "outs", "out"), "meetings")
        part = scratch(part.hint("merge").join(sets.where("blocks > 1").select("cid", "tokens"), "cid"), "round2-sets")
        # a set goes to each of its meetings; so many go at a time as the sets themselves have bytes
        size = F.octet_length("tokens").cast("long")
        sent, own = part.agg(F.sum(size * F.expr("if(out, outs + blocks, outs)")), F.sum(size)).first()
        passes = max(1, -(-int(sent or 0) // max(int(own or 0), PASS_BYTES)))
        for number in range(passes):
            links = links.unionByName(scratch(_pairs_of_blocks(part.withColumn("meets", meets), percent, parts * 2, passes, number), "round2"))

    roots = components(links)
    named = (classes.join(roots, classes.cid == roots.node, "left")
             .select("h1", "h2", "least_id", F.coalesce("root", "cid").alias("root")))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_class = named.join(ids, "root").select("h1", "h2", "component_id", "root")
    return members.join(by_class.withColumnRenamed("h1", "g1").withColumnRenamed("h2", "g2"),
                        (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n") > 0), "left").select(
        "rid", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each group of linked documents one stays, that with
    the smallest id (null last), then the smallest hash of id and text, then the first as JSON of
    rows that repeat both (documents without words have no copies and all stay)."""
    found = _rooted(docs, width, percent, id_col, text_col).where("n_shingles > 0")
    rows = scratch(found.groupBy("root", "rid").agg(F.min("doc_id").alias("id"), F.count("*").alias("k")), "linked")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("best"))
    stays = F.col("rid") == F.col("best.rid")
    # written first, so that its size is known: Spark broadcasts it below its threshold, and joins by shuffle beyond
    marked = scratch(rows.join(best, "root").where(~stays | (F.col("k") > 1)).select("rid", stays.alias("stays")), "gone")
    rid = F.xxhash64(docs[f"`{id_col}`"], text_of(docs, text_col))
    packed = pack(docs, _rid=rid)
    once = packed.join(marked, packed["_rid"] == marked["rid"], "left_anti").select("_row")
    repeated = (packed.join(marked.where("stays"), packed["_rid"] == F.col("rid"), "left_semi")
                .groupBy("_rid").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row"))
    return unpack(once.unionByName(repeated), docs.columns)
