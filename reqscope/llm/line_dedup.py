"""Operator 1: reversible line dedup with sharded cuckoo filters over exact reference counts.

State: a table ``refs`` (shard, hi, lo, n) that holds, for the 128-bit digest of every line
key, the exact number of documents that have it, and a table ``filters`` (shard, filter) with
one cuckoo filter per shard for the keys that ``threshold`` documents or more have.  Inserting
documents adds to the counts, deleting them subtracts; keys that cross the threshold enter or
leave their shard's filter, so deletion brings the former state back.

Nothing is grouped by document or by line: documents lie in chunks, a chunk asks once for each
of its distinct keys, so the most common line of all costs one row per chunk.  The shard's
filter answers first; what it lets through is held against the exact counts.

Defined results: null and empty texts are one empty line (key of no code points, never
dropped); every row is a document of its own, also when its doc_id or text repeats or is null;
all other columns pass through; on an empty table the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_parts, mix64, pack, scratch, text_of, unpack, without

#: Characters stripped at both ends of a line key: space and U+0009 to U+000D.
STRIP = b" \t\n\x0b\x0c\r"
SLOTS = 4
#: Line keys that a map task counts at a time.
HELD = 200_000
REFS = "shard int, hi long, lo long, n long"
FILTERS = "shard int, filter binary"


class CuckooFilter:
    """Cuckoo filter over 128-bit digests (two int64 arrays): 4 slots a bucket, 16-bit
    fingerprints, partial-key hashing, insertion and deletion."""

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def sized_for(n: int) -> "CuckooFilter":
        buckets = 1
        while buckets * SLOTS * 0.8 < n:
            buckets *= 2
        return CuckooFilter(buckets)

    @staticmethod
    def load(blob: bytes) -> "CuckooFilter":
        table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return CuckooFilter(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = (hi.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        a = lo.view(np.uint64) & np.uint64(self.buckets - 1)
        return fp, a.astype(np.int64), self._other(a.astype(np.int64), fp)

    def _other(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return at ^ (mix64(fp.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(hi, lo)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if the table is too full; it is then to be built anew, larger."""
        fp, a, b = self._places(hi, lo)
        rng = np.random.default_rng(7)
        for f, x, y in zip(fp.tolist(), a.tolist(), b.tolist()):
            f, x, y = np.uint16(f), x, y
            for _ in range(500):
                free = np.flatnonzero(self.table[x] == 0)
                if not len(free) and y is not None:
                    x, y = y, None
                    free = np.flatnonzero(self.table[x] == 0)
                if len(free):
                    self.table[x, free[0]] = f
                    break
                k = int(rng.integers(SLOTS))
                f, self.table[x, k] = self.table[x, k], f
                x, y = int(self._other(np.array([x]), np.array([f], np.uint16))[0]), None
            else:
                return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        fp, a, b = self._places(hi, lo)
        for f, x, y in zip(fp.tolist(), a.tolist(), b.tolist()):
            for at in (x, y):
                k = np.flatnonzero(self.table[at] == f)
                if len(k):
                    self.table[at, k[0]] = 0
                    break


def line_digests(text: bytes) -> list[bytes]:
    """Digest of the key of each line; b'' for a key without code points."""
    digest = xxhash.xxh3_128_digest
    return [digest(k) if (k := x.strip(STRIP)) else b"" for x in text.lower().split(b"\n")]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _shard(hi: np.ndarray, shards: int) -> np.ndarray:
    return (hi.view(np.uint64) % np.uint64(shards)).astype(np.int32)


def _count_lines(shards: int):
    """Documents per key; counted in the task until HELD keys are held."""

    def flush(found: dict) -> pa.RecordBatch:
        hi, lo = _halves(list(found))
        return pa.RecordBatch.from_pydict({"shard": _shard(hi, shards), "hi": hi, "lo": lo, "n": np.array(list(found.values()), np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column("_text").cast(pa.large_binary())
            for i in range(len(texts)):
                for k in set(line_digests(texts[i].as_py())):
                    if k:
                        found[k] = found.get(k, 0) + 1
            if len(found) >= HELD:
                yield flush(found)
                found = {}
        if found:
            yield flush(found)

    return run


def _lines_by_chunk(shards: int):
    """The distinct keys of each chunk, as far as a task has held them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, set[bytes]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, keys in found.items():
                if keys:
                    hi, lo = _halves(list(keys))
                    yield pa.RecordBatch.from_pydict({"shard": _shard(hi, shards), "hi": hi, "lo": lo, "chunk": np.full(len(hi), chunk, np.int32)})

        for batch in batches:
            texts, chunks = batch.column("_text").cast(pa.large_binary()), batch.column("_chunk").to_pylist()
            for i in range(len(texts)):
                keys = set(line_digests(texts[i].as_py()))
                keys.discard(b"")
                held += len(keys)
                found.setdefault(chunks[i], set()).update(keys)
            if held >= HELD:
                yield from flush()
                found, held = {}, 0
        yield from flush()

    return run


class LineIndex:
    """Reference counts and filters of all lines of the documents inserted so far.

    ``chunks`` and ``shards`` are numbers of work units; they follow the session's
    spark.sql.shuffle.partitions unless given."""

    def __init__(self, spark: SparkSession, threshold: int = 10, shards: int | None = None,
                 text_col: str = "text") -> None:
        self.spark, self.threshold, self.text_col = spark, threshold, text_col
        self.shards = shards or default_parts(spark)
        self.refs = spark.createDataFrame([], REFS)
        self.filters = spark.createDataFrame([], FILTERS)
        self.empty = True

    def _counts(self, docs: DataFrame, sign: int) -> DataFrame:
        texts = docs.select(text_of(docs, self.text_col).alias("_text"))
        return (texts.mapInArrow(_count_lines(self.shards), REFS)
                .groupBy("shard", "hi", "lo").agg((F.sum("n") * sign).alias("n")))

    def insert(self, docs: DataFrame) -> "LineIndex":
        return self._apply_delta(self._counts(docs, 1))

    def delete(self, docs: DataFrame) -> "LineIndex":
        """Takes documents out again that were inserted before."""
        return self._apply_delta(self._counts(docs, -1))

    def _apply_delta(self, delta: DataFrame) -> "LineIndex":
        threshold = self.threshold
        if self.empty:
            changed = delta.select("shard", "hi", "lo", F.lit(0).cast("long").alias("old"), F.col("n").alias("new"))
        else:
            changed = (self.refs.withColumn("old", F.col("n")).unionByName(delta.withColumn("old", F.lit(0).cast("long")))
                       .groupBy("shard", "hi", "lo").agg(F.sum("old").alias("old"), F.sum("n").alias("new")))
        changed = scratch(changed, "line-refs")
        crossed = changed.where((F.col("old") >= threshold) != (F.col("new") >= threshold))

        def update(blobs: pa.Table, keys: pa.Table) -> pa.Table:
            new = keys.column("new").to_numpy()
            hi, lo = keys.column("hi").to_numpy(), keys.column("lo").to_numpy()
            enter = new >= threshold
            shard = (keys if keys.num_rows else blobs).column("shard")[0].as_py()
            old = CuckooFilter.load(blobs.column("filter")[0].as_py()) if blobs.num_rows else None
            out = old or CuckooFilter.sized_for(int(enter.sum()))
            out.delete(hi[~enter], lo[~enter])
            grown = None if out.insert(hi[enter], lo[enter]) else b""  # b"": too full, built anew below
            return pa.table({"shard": pa.array([shard], pa.int32()),
                             "filter": pa.array([out.dump() if grown is None else grown], pa.binary())})

        filters = scratch(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(update, FILTERS),
                          "line-filters")
        self.refs = changed.where("new > 0").select("shard", "hi", "lo", F.col("new").alias("n"))
        full = filters.where("length(filter) = 0").select("shard")
        if not full.isEmpty():
            filters = filters.where("length(filter) > 0").unionByName(self._rebuilt(full))
        self.filters, self.empty = filters, False
        return self

    def _rebuilt(self, shards: DataFrame) -> DataFrame:
        """Larger filters from the exact counts, for shards whose filter ran full."""
        def build(keys: pa.Table) -> pa.Table:
            hi, lo = keys.column("hi").to_numpy(), keys.column("lo").to_numpy()
            room = 2 * len(hi)
            while not (out := CuckooFilter.sized_for(room)).insert(hi, lo):
                room *= 2
            return pa.table({"shard": keys.column("shard").slice(0, 1).cast(pa.int32()),
                             "filter": pa.array([out.dump()], pa.binary())})

        frequent = self.refs.where(F.col("n") >= self.threshold).join(shards, "shard", "left_semi")
        return scratch(frequent.groupBy("shard").applyInArrow(build, FILTERS), "line-filters")

    def frequent_in(self, keys: DataFrame) -> DataFrame:
        """Of rows (shard, hi, lo, chunk), those whose key reaches the threshold."""
        exact = self.refs.where(F.col("n") >= self.threshold).select("shard", "hi", "lo", F.lit(None).cast("binary").alias("filter"))
        state = exact.unionByName(self.filters.select("shard", F.lit(None).cast("long").alias("hi"),
                                                      F.lit(None).cast("long").alias("lo"), "filter"))

        def probe(asked: pa.Table, state: pa.Table) -> pa.Table:
            blob = next((b for b in state.column("filter").to_pylist() if b is not None), None)
            if blob is None or not asked.num_rows:
                return asked.slice(0, 0).select(["hi", "lo", "chunk"])
            hi, lo = asked.column("hi").to_numpy(), asked.column("lo").to_numpy()
            maybe = np.flatnonzero(CuckooFilter.load(blob).contains(hi, lo))
            exact = state.filter(pc.is_valid(state.column("hi")))
            rec = np.dtype([("hi", "<i8"), ("lo", "<i8")])
            sure, ask = np.empty(exact.num_rows, rec), np.empty(len(maybe), rec)
            sure["hi"], sure["lo"] = exact.column("hi").to_numpy(), exact.column("lo").to_numpy()
            ask["hi"], ask["lo"] = hi[maybe], lo[maybe]
            return asked.take(maybe[np.isin(ask, sure)]).select(["hi", "lo", "chunk"])

        return keys.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(probe, "hi long, lo long, chunk int")

    def apply(self, docs: DataFrame, chunks: int | None = None) -> DataFrame:
        """``docs`` without the lines whose key ``threshold`` inserted documents or more have.

        Adds n_lines and n_dropped (long)."""
        chunks = chunks or default_parts(docs.sparkSession, 2)
        text = text_of(docs, self.text_col)
        packed = pack(docs, without(docs, self.text_col), _text=text, _chunk=F.pmod(F.xxhash64(text, *[docs[f"`{c}`"] for c in docs.columns if c == "doc_id"]), F.lit(chunks)).cast("int"))
        asked = packed.select("_text", "_chunk").mapInArrow(_lines_by_chunk(self.shards), "shard int, hi long, lo long, chunk int")
        frequent = self.frequent_in(asked.dropDuplicates(["shard", "hi", "lo", "chunk"]))
        row_type = packed.schema["_row"].dataType.simpleString()

        def cut(rows: pa.Table, keys: pa.Table) -> pa.Table:
            drop = set()
            if keys.num_rows:
                both = np.stack([keys.column("hi").to_numpy(), keys.column("lo").to_numpy()], 1)
                raw = np.ascontiguousarray(both).tobytes()
                drop = {raw[k:k + 16] for k in range(0, len(raw), 16)}
            texts, lines, dropped = [], [], []
            for text in rows.column("_text"):
                text = text.as_py()
                raw = text.encode()
                own = line_digests(raw)
                gone = [d in drop for d in own] if drop else ()
                n = sum(gone)
                texts.append(text if not n else b"\n".join(x for x, g in zip(raw.split(b"\n"), gone) if not g).decode())
                lines.append(len(own))
                dropped.append(n)
            return pa.table({"_row": rows.column("_row"), "_text": pa.array(texts, pa.string()),
                             "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

        done = (packed.groupBy("_chunk").cogroup(frequent.withColumnRenamed("chunk", "_chunk").groupBy("_chunk"))
                .applyInArrow(cut, f"_row {row_type}, _text string, n_lines long, n_dropped long"))
        return unpack(done, docs.columns, {self.text_col: F.col("_text")},
                      {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")})


def dedup_lines(docs: DataFrame, threshold: int = 10, text_col: str = "text") -> DataFrame:
    """All lines that ``threshold`` documents or more have, dropped from every document."""
    return LineIndex(docs.sparkSession, threshold, text_col=text_col).insert(docs).apply(docs)


def brute_force(texts: list[str | None], threshold: int) -> list[tuple[int, int, str]]:
    """The definition, in plain Python, for tests: (n_lines, n_dropped, sha256)."""
    def key(line: str) -> str:
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(STRIP.decode()))

    split = [(t or "").split("\n") for t in texts]
    seen: dict[str, int] = {}
    for lines in split:
        for k in {key(x) for x in lines}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for lines in split:
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= threshold)]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
