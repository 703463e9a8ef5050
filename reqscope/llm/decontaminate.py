"""Operator 2: benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents may be long, so the Jaccard similarity of the two says little;
containment does: the share of an item's ``width``-word shingles that the document has.  Items
are partitioned by the power of two of their number of shingles.  A partition keeps of each
item its k smallest shingles under a random permutation (a MinHash sketch), where k is one
more than the shingles that a containing document may lack at the partition's upper size; so a
document that contains the item has at least one sketch value, however long it is, and no
match is missed.  A document asks the sketches with each of its shingles; every (document,
item) found so is verified by exact containment.

The documents are never shuffled.  Items go to the tasks in blocks of at most BLOCK_SHINGLES
shingles, a proven size; a larger benchmark takes several passes.

Defined results: an item with fewer than ``width`` words has its whole sequence as its only
shingle (as has a short document); null or wordless items and documents match nothing; each
row is an item or document of its own, also if ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, scratch, seeded, text_of, unpack, without
from .jaccard_join import sets_of

BLOCK_SHINGLES = 1 << 20


class ItemIndex:
    """Sketches and shingle sets of one block of items."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int) -> None:
        self.ids, self.percent = ids, percent
        self.n = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        value, owner = [], []
        for i, s in enumerate(sets):
            upper = (1 << len(s).bit_length()) - 1  # largest size of the partition
            k = upper * (100 - percent) // 100 + 1
            sketch = s[np.argsort(seeded(s, 11), kind="stable")[:k]]
            value.append(sketch)
            owner.append(np.full(len(sketch), i))
        value, owner = np.concatenate([np.zeros(0, np.uint64), *value]), np.concatenate([np.zeros(0, np.int64), *owner])
        order = np.lexsort((owner, value))
        self.value, self.owner = value[order], owner[order]

    def search(self, value: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, shingles found) of the items contained in the rows' sets."""
        lo, hi = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        hit = np.flatnonzero(hi > lo)
        pairs = {(r, i) for k, r in zip(hit.tolist(), row[hit].tolist()) for i in self.owner[lo[k]:hi[k]].tolist()}
        out = []
        for r, i in sorted(pairs):
            own = value[np.searchsorted(row, r):np.searchsorted(row, r, "right")]
            item = self.flat[self.at[i]:self.at[i + 1]]
            k = np.minimum(np.searchsorted(own, item), len(own) - 1)
            found = int((own[k] == item).sum())
            if 100 * found >= self.percent * len(item):
                out.append((r, i, found))
        return out


def _item_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, value, row in sets_of(b.column("_text"), width):
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_pydict({"item": b.slice(lo, hi - lo).column("_item"), "n": np.diff(at),
                                                  "shingles": pa.array([value[at[i]:at[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())})
    return run


def item_blocks(items: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> Iterator[ItemIndex]:
    """The items as indexes of bounded size, one at a time."""
    texts = items.select(items[f"`{id_col}`"].cast("long").alias("_item"), text_of(items, text_col).alias("_text"))
    sets = scratch(texts.mapInArrow(_item_sets(width), "item long, n long, shingles binary").where("n > 0"), "items")
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // (BLOCK_SHINGLES // 2))  # dealt by hash, hence half full on the mean
    for k in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("shingles", "item"), F.lit(blocks)) == k).collect()
        if rows:
            yield ItemIndex([r["item"] for r in rows], [np.frombuffer(bytes(r["shingles"]), np.uint64) for r in rows], percent)


def _probe(index, width: int, pairs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = index.value
        for b in batches:
            for lo, hi, value, row in sets_of(b.column("_text"), width):
                found = items.search(value, row)
                rows = b.slice(lo, hi - lo)
                if pairs:
                    if found:
                        r, i, n = (np.array(x, np.int64) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays(
                            [rows.column("_row").take(pa.array(r)), pa.array([items.ids[k] for k in i.tolist()], pa.int64()),
                             pa.array(items.n[i]), pa.array(n)], ["_row", "item_id", "n_shingles", "n_found"])
                else:
                    clean = np.ones(hi - lo, bool)
                    clean[[r for r, _, _ in found]] = False
                    yield rows.filter(pa.array(clean))
    return run


def find_contained(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document and each item it contains at ``percent`` or more: the document's
    columns (without its text), item_id, n_shingles of the item, n_found and containment."""
    columns = without(docs, text_col)
    packed = pack(docs, columns, _text=text_of(docs, text_col))
    row = packed.schema["_row"].dataType.simpleString()
    schema = f"_row {row}, item_id long, n_shingles long, n_found long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in item_blocks(items, width, percent, item_id, item_text):
        out = out.unionByName(packed.mapInArrow(_probe(docs.sparkSession.sparkContext.broadcast(index), width, True), schema))
    return unpack(out, columns, add={"item_id": F.col("item_id"), "n_shingles": F.col("n_shingles"), "n_found": F.col("n_found"),
                                     "containment": F.col("n_found") / F.col("n_shingles")})


def drop_contained(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item; all columns pass through."""
    packed = pack(docs, without(docs, text_col), _text=docs[f"`{text_col}`"].cast("string"))
    schema = packed.schema
    for index in item_blocks(items, width, percent, item_id, item_text):
        packed = packed.mapInArrow(_probe(docs.sparkSession.sparkContext.broadcast(index), width, False), schema)
    return unpack(packed, docs.columns, {text_col: F.col("_text")})
