"""Operator 13: ranked lexical search by K2-treaps over the grid of terms and documents.

Documents are indexed where they are read, in shards of at most SHARD_DOCS documents or about
SHARD_BYTES of text.  A shard's grid has a row a term and a column a document; a cell holds the
term's impact in the document, a whole number that needs the corpus only through its number of
documents and of terms.  The grid is cut into squares, each a K2-treap with K = 2: a cell of the
quadtree is there only if it is not empty, has a mask of the quarters that are there, and the
largest impact below it, kept as the difference to that of the cell above and compressed.
Columns are ordered by the documents' most frequent term and length, rows by document frequency,
so that neighbours are alike.

A query goes down the rows of all its terms at once, over ranges of documents: the sum of the
largest impacts on its row paths, times the terms' weights, bounds what a document of the range
can score.  Ranges are opened by falling bound, BEAM at a time, until no bound reaches the kth
score; ranges of one document have their exact score.  A task carries its kth scores from shard to
shard and returns at most k documents a query, which a window merges.

Queries go to the tasks in blocks of BLOCK_BYTES of distinct terms (and the query that crosses
the line), cut by running sums, so a larger set takes several passes.  Terms are compared by their
bytes, not by hashes.

Defined results: terms are the maximal runs of ASCII letters, digits and characters beyond ASCII,
A-Z lower-cased; null and wordless texts have none, match nothing and do not count as documents;
every row is a document or query of its own, also if ids repeat or are null (null ids last among
equal scores); texts are whole.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, slices, text_of
from .scan import running

SHARD_DOCS, SHARD_BYTES = 1 << 13, 12 << 20
BLOCK_BYTES = 1 << 20
BEAM = 256
#: Cells of open ranges that are kept; a query with more walks down from the top again.
KEPT = 1 << 24
#: Impacts are below 2**20.
IMPACT_BITS = 20
INDEX = "docs long, terms binary, ends binary, counts binary, ids binary, nulls binary, side int, masks array<binary>, falls array<binary>"

#: Bytes of terms: ASCII letters and digits, and all of characters beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: By mask and quarter: the place of the quarter among those that are there, or -1.
_PLACE = np.array([[(m & ((1 << c) - 1)).bit_count() if m >> c & 1 else -1 for c in range(4)] for m in range(16)], np.int8).ravel()
_COUNT = np.array([m.bit_count() for m in range(16)], np.int64)


def _starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to terms, and which begin one, in consecutive texts."""
    inside = _TERM[data]
    begins = inside.copy()
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begins[1:] &= ~inside[:-1] | first[1:len(data)]
    return inside, begins


def term_list(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of consecutive texts, one after the other, and the row of each."""
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    inside, begins = _starts(data, at)
    start = np.flatnonzero(begins)
    before = np.cumsum(inside, dtype=np.int64)
    offsets = np.append(before[start] - 1, before[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_FOLD[data[inside]])])
    return words, np.searchsorted(at, start, "right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for b in batches:
        for _, _, data, at in slices(b.column("_text"), 1 << 22):
            if len(data):
                total = np.concatenate([[0], np.cumsum(_starts(data, at)[1], dtype=np.int64)])
                n = np.diff(total[at])
                docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 16-bit numbers at every second place."""
    x = x.astype(np.uint64)
    for shift, keep in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def impacts(tf: np.ndarray, row: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 8 m), m = 10 + (90 n docs) div terms, of terms that occur tf times
    in documents ``row``, which have n terms."""
    m = np.array([10 + 90 * int(x) * docs // terms for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])


def build_shard(words: pa.Array, row: np.ndarray, n_rows: int, docs: int, terms: int) -> dict | None:
    """The index of one shard: terms, document frequencies, column order, and the treaps' levels."""
    if not len(words):
        return None
    coded = words.dictionary_encode()
    code, n_terms = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    length = np.bincount(row, minlength=n_rows)
    kept = np.flatnonzero(length)  # documents with terms
    col_of = np.cumsum(length > 0) - 1
    d = len(kept)
    key = np.sort(code * d + col_of[row])
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key)))
    code, col = np.divmod(key[at], d)
    counts = np.bincount(code, minlength=n_terms)
    impact = impacts(tf, col, length[kept], docs, terms)
    # columns by most frequent term, then length; rows by document frequency
    by_col = np.argsort(col.astype(np.uint16 if d <= 1 << 16 else np.int64), kind="stable")
    top = np.maximum.reduceat((tf * n_terms + (n_terms - 1 - code))[by_col], np.searchsorted(col[by_col], np.arange(d)))
    columns = np.lexsort((length[kept], n_terms - 1 - top % n_terms))
    rows = np.argsort(-counts, kind="stable")
    new_col, new_row = np.empty(d, np.int64), np.empty(n_terms, np.int64)
    new_col[columns], new_row[rows] = np.arange(d), np.arange(n_terms)
    side = max(1, (d - 1).bit_length())
    r, c = new_row[code], new_col[col]
    low = (_spread(r & ((1 << side) - 1)) << np.uint64(1)) | _spread(c)
    place = (r >> side).astype(np.uint64) << np.uint64(2 * side) | low
    packed = np.sort(place << np.uint64(IMPACT_BITS) | impact.astype(np.uint64))
    place, most = packed >> np.uint64(IMPACT_BITS), (packed & np.uint64((1 << IMPACT_BITS) - 1)).astype(np.int64)
    masks, falls = [], []
    for _ in range(side):
        above = place >> np.uint64(2)
        at = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, (place & np.uint64(3)).astype(np.int64)), at).astype(np.uint8))
        higher = np.maximum.reduceat(most, at)
        falls.append((np.repeat(higher, np.diff(np.append(at, len(place)))) - most).astype("<u4"))
        place, most = above[at], higher
    falls.append(most.astype("<u4"))  # of the squares themselves
    press = zstandard.ZstdCompressor(level=1).compress
    names = coded.dictionary.take(pa.array(rows))
    _, ends, letters = names.buffers()
    return {"docs": d, "terms": press(letters.to_pybytes()), "ends": press(np.frombuffer(ends, "<i8", n_terms + 1).tobytes()),
            "counts": press(counts[rows].astype("<i8").tobytes()), "kept": kept[columns], "side": side,
            "masks": [press(x.tobytes()) for x in masks], "falls": [press(x.tobytes()) for x in falls]}


def _index(docs: int, terms: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        schema = pa.schema([("docs", pa.int64()), *[(c, pa.binary()) for c in ("terms", "ends", "counts", "ids", "nulls")], ("side", pa.int32()),
                            ("masks", pa.list_(pa.binary())), ("falls", pa.list_(pa.binary()))])
        words, row, ids, rows, size = [], [], [], 0, 0

        def shard() -> Iterator[pa.RecordBatch]:
            built = build_shard(pa.concat_arrays(words), np.concatenate(row), rows, docs, terms) if rows else None
            if built:
                own = pa.concat_arrays(ids).take(pa.array(built.pop("kept")))
                built["ids"], built["nulls"] = press(own.fill_null(0).to_numpy().astype("<i8").tobytes()), press(own.is_null().to_numpy(zero_copy_only=False).tobytes())
                yield pa.RecordBatch.from_pylist([built], schema)

        for few in (b.slice(k, shard_docs) for b in batches for k in range(0, b.num_rows, shard_docs)):
            for lo, hi, data, at in slices(few.column("_text"), 1 << 21):
                w, r = term_list(data, at)
                words.append(w)
                row.append(r + rows)
                ids.append(few.column("_id").slice(lo, hi - lo))
                rows, size = rows + hi - lo, size + len(data)
                if rows >= shard_docs or size >= SHARD_BYTES:
                    yield from shard()
                    words, row, ids, rows, size = [], [], [], 0, 0
        yield from shard()
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, int, int]:
    """(index table with a row a shard, documents that have terms, terms with repeats)."""
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("_id"), text_of(docs, text_col).alias("_text"))
    n, total = rows.mapInArrow(_count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n, total = int(n or 0), int(total or 0)
    return scratch(rows.mapInArrow(_index(n, total, shard_docs), INDEX), "lexical-index"), n, total


class Shard:
    """One shard of the index, opened."""

    def __init__(self, row: dict) -> None:
        open_ = zstandard.ZstdDecompressor().decompress
        self.side = row["side"]
        ends = np.frombuffer(open_(row["ends"]), "<i8")
        self.terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(open_(row["terms"]))])
        if row.get("falls") is None:
            return
        self.ids, self.null = np.frombuffer(open_(row["ids"]), "<i8"), np.frombuffer(open_(row["nulls"]), bool)
        # a cell that is not there is the last of its level: no quarters, no impact
        self.most: list[np.ndarray] = [np.zeros(0)] * (self.side + 1)
        self.mask, self.first = [np.zeros(0)] * (self.side + 1), [np.zeros(0)] * (self.side + 1)
        self.most[self.side] = np.append(np.frombuffer(open_(row["falls"][-1]), "<u4").astype(np.int64), 0)
        for level in range(self.side, 0, -1):
            mask = np.frombuffer(open_(row["masks"][level - 1]), np.uint8)
            n = _COUNT[mask]
            self.mask[level], self.first[level] = np.append(mask, 0).astype(np.int64) * 4, np.append(np.cumsum(n) - n, 0)
            self.most[level - 1] = np.append(np.repeat(self.most[level][:-1], n) - np.frombuffer(open_(row["falls"][level - 1]), "<u4"), 0)

    def find(self, terms: pa.Array) -> np.ndarray:
        """The rows of terms, -1 where they do not occur."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def below(self, cells: np.ndarray, level: int, quarter: np.ndarray) -> np.ndarray:
        """The cells one level down, of the quarters given."""
        place = _PLACE[self.mask[level][cells] + quarter]
        return np.where(place >= 0, self.first[level][cells] + place, len(self.most[level - 1]) - 1)

    def from_top(self, rows: np.ndarray, level: int, ranges: np.ndarray) -> np.ndarray:
        cells = np.broadcast_to(rows >> self.side, (len(ranges), len(rows)))
        for up in range(self.side, level, -1):
            quarter = (rows >> (up - 1) & 1)[None, :] * 2 + (ranges >> (up - 1 - level) & 1)[:, None]
            cells = self.below(cells, up, quarter)
        return cells

    def search(self, rows: np.ndarray, weight: np.ndarray, best: tuple, k: int, kept: int = KEPT) -> tuple[tuple, int]:
        """The k best of ``best`` and this shard, as (score, null id, id) arrays, best first, and
        how many ranges were opened."""
        exact = float(weight.sum()) * (1 << IMPACT_BITS) < 2 ** 53
        w = weight.astype(np.float64 if exact else object)
        keep = len(rows) << self.side <= kept

        def bounds(cells: np.ndarray, level: int) -> np.ndarray:
            value = self.most[level][cells]
            return (value.astype(np.float64) @ w).astype(np.int64) if exact else (value.astype(object) @ w).astype(np.int64)

        start = (rows >> self.side)[None, :]
        bound, level, rng = bounds(start, self.side), np.array([self.side]), np.array([0])
        cells = start if keep else None
        opened = 0
        while len(bound):
            least = int(best[0][-1]) if len(best[0]) >= k else 1
            live = bound >= least
            if not live.all():
                bound, level, rng = bound[live], level[live], rng[live]
                cells = cells[live] if keep else None
            if not len(bound):
                break
            beam = max(1, min(BEAM, kept // max(1, len(rows))))
            if len(bound) > beam:
                go = np.zeros(len(bound), bool)
                go[np.argpartition(-bound, beam)[:beam]] = True
            else:
                go = np.ones(len(bound), bool)
            opened += int(go.sum())
            parts = [(bound[~go], level[~go], rng[~go], cells[~go] if keep else None)]
            for lv in np.unique(level[go]).tolist():
                who = go & (level == lv)
                own = cells[who] if keep else self.from_top(rows, lv, rng[who])
                side = (rows >> (lv - 1) & 1)[None, :] * 2
                for right in (0, 1):
                    down = self.below(own, lv, side + right)
                    value, at = bounds(down, lv - 1), rng[who] * 2 + right
                    ok = value >= least
                    if lv > 1:
                        parts.append((value[ok], np.full(int(ok.sum()), lv - 1), at[ok], down[ok] if keep else None))
                    elif ok.any():
                        best = _merge(best, (value[ok], self.null[at[ok]], self.ids[at[ok]]), k)
            bound, level, rng = (np.concatenate([p[c] for p in parts]) for c in range(3))
            cells = np.concatenate([p[3] for p in parts]) if keep else None
        return best, opened


def _merge(a: tuple, b: tuple, k: int) -> tuple:
    score, null, ids = (np.concatenate([x, y]) for x, y in zip(a, b))
    order = np.lexsort((ids, null, -score))[:k]
    return score[order], null[order], ids[order]


def _frequencies(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(terms.value, pa.large_binary())
        total = np.zeros(len(asked), np.int64)
        for b in batches:
            for row in b.to_pylist():
                at = Shard(row | {"side": 0}).find(asked)
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["counts"]), "<i8")
                total += np.where(at >= 0, counts[at], 0)
        there = np.flatnonzero(total)
        if len(there):
            yield pa.RecordBatch.from_pydict({"term": pa.array(there), "df": pa.array(total[there])})
    return run


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items = block.value
        asked = pa.array(terms, pa.large_binary())
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in items]
        for b in batches:
            for k_row in range(b.num_rows):
                shard = Shard(b.slice(k_row, 1).to_pylist()[0])
                at = shard.find(asked)
                for i, (_, own, weight) in enumerate(items):
                    rows = at[own]
                    there = rows >= 0
                    if there.any():
                        best[i], _ = shard.search(rows[there], weight[there], best[i], k)
        for (iid, _, _), (score, null, ids) in zip(items, best):
            if len(score):
                yield pa.RecordBatch.from_pydict({"iid": pa.array(np.full(len(score), iid)), "doc_id": pa.array(ids, mask=null), "score": pa.array(score)})
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, at in slices(b.column("_text"), 1 << 20):
            words, row = term_list(data, at)
            cuts = np.searchsorted(row, np.arange(hi - lo + 1))
            own = [sorted(set(words.slice(x, y - x).to_pylist())) for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id").slice(lo, hi - lo), "terms": pa.array([b" ".join(x) for x in own], pa.binary()),
                                              "size": pa.array([sum(map(len, x)) + len(x) for x in own], pa.int64())})


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents with a score above 0.

    A term's weight is floor(1000 ln((2 n_docs + 2) / (2 df + 1)))."""
    spark = index.sparkSession
    kind = items.schema[item_id].dataType
    texts = items.select(items[f"`{item_id}`"].alias("item_id"), text_of(items, item_text).alias("_text"))
    schema = texts.select("item_id").schema.add("terms", "binary").add("size", "long")
    asked = texts.mapInArrow(_item_terms, schema).where("size > 0").withColumn("row", F.monotonically_increasing_id())
    asked = scratch(asked, "items")
    numbered = scratch(running(asked.select("row", "size"), [F.col("row")], add=["size"], index="iid").withColumn("block", F.floor((F.col("run_size") - 1) / BLOCK_BYTES)), "blocks", free=False)
    asked = asked.join(numbered.select("row", "iid", "block"), "row")
    last = numbered.agg(F.max("block")).first()[0]
    found = spark.createDataFrame([], "iid long, doc_id long, score long")
    for number in range(0 if last is None else last + 1):
        rows = asked.where(F.col("block") == number).select("iid", "terms").collect()  # BLOCK_BYTES and one item
        own = {r["iid"]: bytes(r["terms"]).split(b" ") for r in rows}
        terms = sorted({t for x in own.values() for t in x})
        if not terms:
            continue
        counted = index.select("terms", "ends", "counts").mapInArrow(_frequencies(spark.sparkContext.broadcast(terms)), "term long, df long")
        df = {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # one row a term of the block
        weight = {terms[t]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        place = {t: i for i, t in enumerate(terms)}
        plan = []
        for iid, x in sorted(own.items()):
            x = [t for t in x if weight.get(t, 0) > 0]
            plan.append((iid, np.array([place[t] for t in x], np.int64), np.array([weight[t] for t in x], np.int64)))
        block = spark.sparkContext.broadcast((terms, plan))
        found = found.unionByName(index.mapInArrow(_search(block, k), "iid long, doc_id long, score long"))
    best = Window.partitionBy("iid").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = asked.select("iid", F.col("item_id").cast(kind).alias("item_id"))
    return ranked.join(names, "iid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
