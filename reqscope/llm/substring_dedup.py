"""Operator 3: exact substring dedup with a distributed difference-cover suffix sort.

A byte goes if it is covered by a string of ``width`` bytes that also starts in a document with
a smaller id.

1.  Documents are packed into pieces (compressed, bounded), which all later steps are keyed by.
2.  Sampling: of each window of ``width`` bytes the first of the least hashed 16-byte grams is
    its anchor.  Equal windows have equal anchors, so only windows whose anchor occurs in two
    documents can repeat.  Pieces send each anchor once; a shard answers which are shared.
3.  The maximal runs of windows with one shared anchor are the contexts.  All contexts of an
    anchor meet in one shard; its distinct contexts are sorted as one text by the difference
    cover algorithm modulo 3: the triples at positions 1 and 2 modulo 3 are sorted and named,
    names are recursed on until they are distinct, the remaining suffixes are sorted by their
    first byte and the rank of the next suffix and merged; then adjacent suffixes are compared
    on their first ``width`` bytes.  Each class of equal windows gets its smallest document.
4.  Answers go back to the pieces, which cut the covered bytes.

An anchor that more than HOT pieces have is not gathered: its windows are spread over the shards
by their 64-bit hashes and matched by them, so what a third of all documents share costs a
few bytes per window and piece.

Defined results: null is empty; texts shorter than ``width`` stay whole; rows with the same id
are no reason to remove anything from each other; a null id counts as larger than all others.
Grams, contexts and shared windows are found by 64-bit hashes of their place and then compared
by their bytes.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import default_parts, mix64, scratch, seeded, slices, small_batches

GRAM = 16
PIECE = 1 << 20
HOT = 256
#: Bytes of context text that are sorted at a time (the contexts of one anchor stay together).
SORT_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max
PIECES = "piece long, ids binary, known binary, ends binary, data binary"
CONTEXTS = "shard int, piece long, n long, data binary, hot binary"


# ---- suffix sorting -------------------------------------------------------------------------

def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Ranks (from 1) of rows of non-negative columns, equal rows equal, and their number."""
    bits = [max(1, int(k.max(initial=0)).bit_length()) for k in keys]
    if sum(bits) <= 62:
        packed = keys[0].astype(np.int64)
        for k, b in zip(keys[1:], bits[1:]):
            packed = (packed << b) | k
        values, inverse = np.unique(packed, return_inverse=True)
        return inverse + 1, len(values)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank, int(new.sum()) + 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of positive integers in sorted order (difference cover modulo 3)."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    one = np.arange(1, n + (n % 3 == 1), 3)  # a sample at n closes the first string of names
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, distinct = _dense([padded[sample], padded[sample + 1], padded[sample + 2]])
    order = np.argsort(names, kind="stable") if distinct == len(sample) else suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    step = np.int64(len(sample) + 2)
    key0 = padded[zero] * step + rank[zero + 1]
    zero = zero[np.argsort(key0, kind="stable")]
    key0 = padded[zero] * step + rank[zero + 1]
    s1, s2 = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before1 = np.searchsorted(padded[s1] * step + rank[s1 + 1], key0)
    pairs, _ = _dense([np.concatenate([padded[s2], padded[zero]]), np.concatenate([padded[s2 + 1], padded[zero + 1]])])
    before2 = np.searchsorted(pairs[:len(s2)] * step + rank[s2 + 2], pairs[len(s2):] * step + rank[zero + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + before1 + before2
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zero
    out[~taken] = sorted_sample
    return out


def least_by_window(data: np.ndarray, size: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """For all windows of consecutive contexts in ``data``, in order, the least ``low`` of the
    contexts that have an equal window."""
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(int(begin[-1]) + width, np.int64)
    inside = np.arange(len(data)) + np.repeat(np.arange(len(size)), size)
    text[inside] = data.astype(np.int64) + 2  # 1 ends a context
    text[text == 0] = 1
    count = size - width + 1
    owner = np.repeat(np.arange(len(size)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begin[:-1][owner]
    number = np.full(len(text), -1, np.int64)
    number[start] = np.arange(len(start))
    order = suffix_array(text)
    order = order[number[order] >= 0]
    window = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), width)
    differ = np.ones(len(order), bool)
    for lo in range(1, len(order), 1 << 16):  # adjacent prefixes
        hi = min(len(order), lo + (1 << 16))
        differ[lo:hi] = (window[order[lo:hi]] != window[order[lo - 1:hi - 1]]).any(1)
    least = np.minimum.reduceat(low[owner[number[order]]], np.flatnonzero(differ)) if len(order) else np.zeros(0, np.int64)
    out = np.empty(len(order), np.int64)
    out[number[order]] = least[np.cumsum(differ) - 1]
    return out


# ---- pieces ---------------------------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        ids = b.column("_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(NO_ID).to_numpy()
        for lo, hi, data, at in slices(b.column("_text"), PIECE):
            raw = data.tobytes()
            key = mix64(np.array([hash_bytes(data) ^ np.uint64(hi - lo)], np.uint64) + ids[lo:hi].view(np.uint64).sum(dtype=np.uint64))
            yield pa.RecordBatch.from_pydict({"piece": key.view(np.int64), "ids": [ids[lo:hi].tobytes()], "known": [known[lo:hi].tobytes()],
                                              "ends": [at[1:].tobytes()], "data": [pack.compress(raw)]})


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = common._POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return total, down


def hash_bytes(data: np.ndarray) -> np.uint64:
    total, _ = prefix_sums(data)
    return mix64(total[-1:])[0]


class Piece:
    """A piece's documents with the anchors of all its windows."""

    def __init__(self, row: dict, width: int) -> None:
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["data"])
        self.data = np.frombuffer(self.raw, np.uint8)
        n = len(self.data)
        self.total, self.down = prefix_sums(self.data)
        starts = np.concatenate([[0], self.ends[:-1]])
        whole = self.ends - starts >= width
        count = np.where(whole, self.ends - starts - width + 1, 0)
        owner = np.repeat(np.arange(len(starts)), count)
        window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
        if not len(window):
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        grams = self.hashes(np.arange(n - GRAM + 1), GRAM)
        bits = np.uint64(max(1, n.bit_length()))
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        span, have = width - GRAM + 1, 1  # least over span grams, by doubling
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[:len(low) - step], low[step:])
            have += step
        at = (low[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        # runs of windows of a document with the same anchor
        new = np.ones(len(window), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        run = np.flatnonzero(new)
        self.first = window[run]
        self.last = window[np.append(run[1:], len(window)) - 1]
        self.doc = owner[run]
        self.anchor = seeded(grams[at[run]], 3)  # least hashes crowd near 0: hashed again

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        return mix64((self.total[start + size] - self.total[start]) * self.down[start])


def _sent(p: Piece, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the piece's distinct anchors in order, whether two documents have them, where the shards
    begin, the place of each run's anchor)."""
    values, place = np.unique(p.anchor, return_inverse=True)
    low, top = np.full(len(values), len(p.ids)), np.full(len(values), -1)
    np.minimum.at(low, place, p.doc)
    np.maximum.at(top, place, p.doc)
    return values, low != top, np.searchsorted((values >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1)), place


def _anchors(width: int, shards: int):
    """Per shard the piece's distinct anchors, their lower 40 bits (the shard holds the upper
    ones, and a chance meeting only makes one context too many), and which two documents have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p = Piece(row, width)
                if not len(p.anchor):
                    continue
                values, many, cuts, _ = _sent(p, shards)
                low = values.view(np.uint8).reshape(-1, 8)[:, :5]
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({"shard": pa.array(some, pa.int32()), "piece": pa.array([row["piece"]] * len(some), pa.int64()),
                                                  "anchors": pa.array([low[cuts[s]:cuts[s + 1]].tobytes() for s in some], pa.binary()),
                                                  "many": pa.array([np.packbits(many[cuts[s]:cuts[s + 1]]).tobytes() for s in some], pa.binary())})
    return run


def _shared(t: pa.Table) -> pa.Table:
    """What a shard answers each piece, in the order in which the piece sent its anchors: which
    two documents have, and which are hot."""
    sent = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in t.column("anchors").to_pylist()]
    size = [len(x) for x in sent]
    wide = np.zeros((sum(size), 8), np.uint8)
    wide[:, :5] = np.concatenate(sent)
    values, inverse, count = np.unique(wide.view(np.uint64)[:, 0], return_inverse=True, return_counts=True)
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("many").to_pylist(), size)]
    many = np.zeros(len(values), bool)
    np.logical_or.at(many, inverse, np.concatenate(flags).astype(bool))
    shared, hot = ((count > 1) | many)[inverse], (count > HOT)[inverse]
    edge = np.concatenate([[0], np.cumsum(size)]).tolist()
    bits = [np.packbits(np.concatenate([shared[a:b], hot[a:b]])).tobytes() for a, b in zip(edge, edge[1:])]
    return pa.table({"piece": t.column("piece"), "shard": t.column("shard"), "shared": pa.array(bits, pa.binary())})


def _contexts_of(p: Piece, answers: list[dict], shards: int, width: int) -> tuple[np.ndarray, ...]:
    """(anchor, first, size, doc, hot) of the contexts of a piece; windows of hot anchors are single."""
    values, _, cuts, place = _sent(p, shards)
    shared, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
    for a in answers:
        lo, hi = cuts[a["shard"]], cuts[a["shard"] + 1]
        bits = np.unpackbits(np.frombuffer(a["shared"], np.uint8), count=2 * (hi - lo)).astype(bool)
        shared[lo:hi], hot[lo:hi] = bits[:hi - lo], bits[hi - lo:]
    hot = (shared & hot)[place]
    whole = shared[place] & ~hot
    count = (p.last - p.first + 1)[hot]
    first = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(p.first[hot], count)
    n = int(whole.sum())
    return (np.concatenate([p.anchor[whole], np.zeros(len(first), np.uint64)]), np.concatenate([p.first[whole], first]),
            np.concatenate([(p.last - p.first)[whole] + width, np.full(len(first), width)]),
            np.concatenate([p.doc[whole], np.repeat(p.doc[hot], count)]), np.arange(n + len(first)) >= n)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _contexts(width: int, parts: int, shards: int):
    def run(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "piece": [], "n": [], "data": [], "hot": []}
        pack = zstandard.ZstdCompressor(level=3)
        told = answers.to_pylist()
        for row in pieces.to_pylist() if told else ():
            p = Piece(row, width)
            anchor, first, size, doc, hot = _contexts_of(p, told, parts, width)
            if not len(first):
                continue
            mark = p.hashes(first, size)
            for s, blob in _hot_windows(mark[hot], p.ids[doc[hot]], shards):
                for c, v in (("shard", s), ("piece", row["piece"]), ("n", 0), ("data", None), ("hot", pack.compress(blob))):
                    out[c].append(v)
            anchor, first, size, doc, mark = (x[~hot] for x in (anchor, first, size, doc, mark))
            if not len(first):
                continue
            order = np.lexsort((mark, anchor))
            anchor, first, size, doc, mark = anchor[order], first[order], size[order], doc[order], mark[order]
            new = np.ones(len(mark), bool)  # equal contexts once, with their least document
            new[1:] = (mark[1:] != mark[:-1]) | (anchor[1:] != anchor[:-1])
            at = np.flatnonzero(new)
            ids = p.ids[doc]
            low = np.minimum.reduceat(ids, at)
            many = low != np.maximum.reduceat(ids, at)
            anchor, first, size = anchor[at], first[at], size[at]
            cuts = np.searchsorted((anchor >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                k = slice(cuts[s], cuts[s + 1])
                blob = b"".join([anchor[k].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), size[k].astype(np.int32).tobytes(), low[k].tobytes(),
                                 many[k].tobytes(), p.data[_ranges(first[k], size[k])].tobytes()])
                for c, v in (("shard", int(s)), ("piece", row["piece"]), ("n", int(cuts[s + 1] - cuts[s])), ("data", pack.compress(blob)), ("hot", None)):
                    out[c].append(v)
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "piece": pa.array(out["piece"], pa.int64()),
                         "n": pa.array(out["n"], pa.int64()), "data": pa.array(out["data"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})
    return run


def _hot_windows(mark: np.ndarray, ids: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Per shard the distinct windows of hot anchors: hash, least document, whether there is a larger one."""
    order = np.lexsort((ids, mark))
    mark, ids = mark[order], ids[order]
    at = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])) if len(mark) else order
    low, many = ids[at], ids[np.append(at[1:], len(mark)) - 1] != ids[at] if len(at) else at.astype(bool)
    mark = mark[at]
    cuts = np.searchsorted((mark >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        k = slice(cuts[s], cuts[s + 1])
        yield s, np.int64(cuts[s + 1] - cuts[s]).tobytes() + mark[k].tobytes() + low[k].tobytes() + many[k].tobytes()


def _answer(mark: np.ndarray, runs: np.ndarray, least: np.ndarray, counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join([
        np.array([len(mark), len(least)], np.int64).tobytes(), mark.tobytes(), runs.astype(np.int32).tobytes(), least.tobytes(), counts.astype(np.int32).tobytes()]))


def _meet_hot(t: pa.Table) -> tuple[list, list]:
    """(pieces, answers) for the windows of hot anchors in a shard, matched by their hashes."""
    rows = []
    for k, x in enumerate(t.column("hot").to_pylist()):
        if x is not None:
            blob = zstandard.ZstdDecompressor().decompress(x)
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            rows.append((k, np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.int64, n, 8 + 8 * n), np.frombuffer(blob, bool, n, 8 + 16 * n)))
    if not rows:
        return [], []
    values, inverse = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    least = np.full(len(values), NO_ID)
    np.minimum.at(least, inverse, np.concatenate([r[2] for r in rows]))
    pieces, answers, at = [], [], 0
    names = t.column("piece").to_pylist()
    for k, mark, low, many in rows:
        own = least[inverse[at:at + len(mark)]]
        at += len(mark)
        go = many | (own < low)
        if go.any():
            one = np.ones(int(go.sum()), np.int64)
            pieces.append(names[k])
            answers.append(_answer(mark[go], one, own[go], one))
    return pieces, answers


def _unpacked(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(anchor, size, low, many, data, mark) of all contexts of a shard."""
    cols: list[list] = [[], [], [], [], []]
    unpack = zstandard.ZstdDecompressor()
    for n, x in zip(t.column("n").to_pylist(), t.column("data").to_pylist()):
        blob, at = unpack.decompress(x), 0
        for k, width in enumerate((5, 4, 8, 1)):
            cols[k].append(blob[at:at + width * n])
            at += width * n
        cols[4].append(blob[at:])
    joined = [b"".join(c) for c in cols]
    wide = np.zeros((len(joined[3]), 8), np.uint8)
    wide[:, :5] = np.frombuffer(joined[0], np.uint8).reshape(-1, 5)
    size = np.frombuffer(joined[1], np.int32).astype(np.int64)
    data = np.frombuffer(joined[4], np.uint8)
    total, down = prefix_sums(data)
    begin = np.cumsum(size) - size
    mark = mix64((total[begin + size] - total[begin]) * down[begin])
    return wide.view(np.uint64)[:, 0], size, np.frombuffer(joined[2], np.int64), np.frombuffer(joined[3], bool), data, mark


def _sort_contexts(width: int):
    def run(t: pa.Table) -> pa.Table:
        pieces, answers = _meet_hot(t)
        t = t.filter(pc.is_valid(t.column("data")))
        n = t.column("n").to_numpy()
        anchor, size, low, many, data, mark = _unpacked(t)
        begin = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((mark, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (mark[order][1:] != mark[order][:-1])
        head = order[new]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        least, most = np.full(len(head), NO_ID), np.full(len(head), np.iinfo(np.int64).min)
        np.minimum.at(least, of, low)
        np.maximum.at(most, of, np.where(many, NO_ID, low))  # many: some document of the piece is larger
        # a context that has no window in common with another one needs no sorting: its windows are
        # shared by those who have the whole context
        result: list = [None] * len(head)
        same = np.append(False, anchor[head][1:] == anchor[head][:-1]) if len(head) else np.zeros(0, bool)
        alone = ~same & ~np.append(same[1:], False) if len(head) else same
        rest = np.flatnonzero(~alone)
        if len(rest):
            count = size[head[rest]] - width + 1
            start = _ranges(begin[head[rest]], count)
            total, down = prefix_sums(data)
            h = (total[start + width] - total[start]) * down[start]
            place = np.argsort(h)
            twice = np.append(False, h[place][1:] == h[place][:-1])
            twice[:-1] |= twice[1:]
            met = np.zeros(len(h), bool)
            met[place] = twice
            alone[rest[~np.logical_or.reduceat(met, np.cumsum(count) - count)]] = True
        for j in np.flatnonzero(alone & (least < most)).tolist():
            result[j] = (least[j:j + 1], np.array([size[head[j]] - width + 1]))
        back = np.flatnonzero(~alone)
        head = head[back]
        least, most = least[back], most[back]
        # batches of distinct contexts, cut between anchors
        volume = np.cumsum(size[head] + 1)
        edge = np.flatnonzero(np.append(True, anchor[head][1:] != anchor[head][:-1])) if len(head) else back
        lo = 0
        while lo < len(head):
            k = np.searchsorted(edge, np.searchsorted(volume, volume[lo] + SORT_BYTES), "right") - 1
            hi = int(edge[k]) if k >= 0 and edge[k] > lo else int(np.append(edge, len(head))[np.searchsorted(edge, lo, "right")])
            if k + 1 >= len(edge) and volume[-1] <= volume[lo] + SORT_BYTES:
                hi = len(head)
            part = head[lo:hi]
            windows = least_by_window(data[_ranges(begin[part], size[part])], size[part], least[lo:hi], width)
            at = np.cumsum(size[part] - width + 1)[:-1]
            for j, w in zip(range(lo, hi), np.split(windows, at)):
                if w.min() < most[j]:
                    step = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                    result[back[j]] = (w[step], np.diff(np.append(step, len(w))))
            lo = hi
        # answers: per piece the context's mark and its windows' least documents, as runs
        some = np.array([result[j] is not None for j in of.tolist()], bool)
        names = t.column("piece").to_pylist()
        for k in np.unique(piece[some]).tolist():
            rows = np.flatnonzero(some & (piece == k))
            found = [result[j] for j in of[rows].tolist()]
            pieces.append(names[k])
            answers.append(_answer(mark[rows], np.array([len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])))
        return pa.table({"piece": pa.array(pieces, pa.int64()), "shard": pa.nulls(len(pieces), pa.int32()),
                         "shared": pa.nulls(len(pieces), pa.binary()), "least": pa.array(answers, pa.binary())})
    return run


def covered(p: Piece, answers: pa.Table, parts: int, width: int) -> np.ndarray:
    """Which bytes of a piece go."""
    every = answers.to_pylist()
    told = [x for x in every if x["shared"] is not None]
    gone = np.zeros(len(p.data) + 1, np.int64)
    cols: list[list] = [[], [], [], []]
    for x in every:
        if x["least"] is not None:
            blob = zstandard.ZstdDecompressor().decompress(x["least"])
            n, m = np.frombuffer(blob, np.int64, 2).tolist()
            at = 16
            for c, kind, k in zip(cols, (np.uint64, np.int32, np.int64, np.int32), (n, n, m, m)):
                c.append(np.frombuffer(blob, kind, k, at))
                at += k * np.dtype(kind).itemsize
    if not cols[0] or not len(p.first):
        return gone[:-1].astype(bool)
    _, first, size, doc, _ = _contexts_of(p, told, parts, width)
    mark, runs, least, count = (np.concatenate(c) for c in cols)
    runs, count = runs.astype(np.int64), count.astype(np.int64)
    order = np.argsort(mark, kind="stable")
    own = p.hashes(first, size)
    at = np.minimum(np.searchsorted(mark[order], own), len(mark) - 1)
    hit = np.flatnonzero(mark[order][at] == own)
    k = order[at[hit]]
    entry = _ranges((np.cumsum(runs) - runs)[k], runs[k])  # all runs of all contexts that were answered
    context = np.repeat(hit, runs[k])
    offset = np.cumsum(count) - count
    base = offset[(np.cumsum(runs) - runs)[k]]
    start = first[context] + offset[entry] - np.repeat(base, runs[k])
    go = least[entry] < p.ids[doc[context]]
    np.add.at(gone, start[go], 1)
    np.add.at(gone, start[go] + count[entry][go] + width - 1, -1)
    return np.cumsum(gone[:-1]) > 0


def _cut(width: int, parts: int):
    def run(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
        for row in pieces.to_pylist():
            p = Piece(row, width)
            gone = covered(p, answers, parts, width)
            lo = 0
            for i, hi in enumerate(p.ends.tolist()):
                g = gone[lo:hi]
                out["doc_id"].append(int(p.ids[i]) if p.known[i] else None)
                out["n_bytes"].append(hi - lo)
                out["n_removed"].append(int(g.sum()))
                out["n_spans"].append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
                out["kept"].append(p.raw[lo:hi] if not g.any() else p.data[lo:hi][~g].tobytes())
                lo = hi
        return pa.table({c: pa.array(v, pa.binary() if c == "kept" else pa.int64()) for c, v in out.items()})
    return run


def dedup_substrings(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row; ``kept`` has the bytes that stay."""
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    parts = default_parts(docs.sparkSession)
    small_batches(docs.sparkSession)
    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("_id"), docs[f"`{text_col}`"].cast("string").alias("_text"))
    pieces = scratch(texts.mapInArrow(_pieces, PIECES), "pieces")
    answers = scratch(pieces.mapInArrow(_anchors(width, parts), "shard int, piece long, anchors binary, many binary")
                      .groupBy("shard").applyInArrow(_shared, "piece long, shard int, shared binary"), "anchors")
    contexts = pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(_contexts(width, parts, parts * 2), CONTEXTS)
    least = contexts.groupBy("shard").applyInArrow(_sort_contexts(width), "piece long, shard int, shared binary, least binary")
    every = least.unionByName(answers.withColumn("least", F.lit(None).cast("binary")))
    return pieces.groupBy("piece").cogroup(every.groupBy("piece")).applyInArrow(
        _cut(width, parts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(rows: list[tuple], width: int) -> list[tuple]:
    """The definition, in plain Python, for tests: (id, n_bytes, n_removed, n_spans, kept)."""
    first: dict[bytes, float] = {}
    raw = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        for s in range(len(t) - width + 1):
            first[t[s:s + width]] = min(i, first.get(t[s:s + width], float("inf")))
    out = []
    for (ident, _), (i, t) in zip(rows, raw):
        gone = bytearray(len(t))
        for s in range(len(t) - width + 1):
            if first[t[s:s + width]] < i:
                gone[s:s + width] = b"\x01" * width
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((ident, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out
