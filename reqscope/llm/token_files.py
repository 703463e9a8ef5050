"""Operator 11: token ids of documents in binary files, one zstandard frame a document.

A shared zstandard dictionary is trained on serialized id arrays of a bounded sample; every
document is then compressed by itself with it, so a short document costs few bytes and can be
read alone.  A file is

    header   magic, version, bytes an id (2 or 4, little-endian), SHA-256 of the dictionary
    frames   one after the other, in ascending document order
    index    of each document: id, whether the id is null, offset of its frame, number of ids
    trailer  offset of the index, documents, ids, magic

and the dictionary lies beside the files under its hash, which a reader checks.

Tasks tokenize and compress the texts where they are read; only frames are shuffled, into ranges
of document ids, and a task writes the files of its range.  File names hold a random part, and
the manifest, a Parquet table that Spark commits, names the files of the attempts that count, so
lost executors and repeated tasks leave nothing wrong behind.  The folder must be one that all
executors reach through ``pyarrow.fs`` (a shared mount, hdfs, s3, gs).

``encode_pieces``: where the tokenizer's own rules cut anyway (white space, digits, ASCII letters
against ASCII signs but the apostrophe), texts are cut with numpy, and the library encodes each
distinct piece once.  A tokenizer with other rules (``cuts_like_words`` says no), and a text
with the string of an added token, is encoded whole.

Defined results: null is empty and an empty text has the end id only; documents are ordered by
id, null ids last, equal ids by their frames; every row is a document of its own; texts are whole,
whatever their length; an empty table gives an empty manifest and no documents.  Other columns
of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import default_parts, scratch, slices, text_of

MAGIC = b"TOKIDS\x00\x01"
HEADER = struct.Struct("<8sII32s")
TRAILER = struct.Struct("<QQQ8s")
LEVEL = 3
#: The dictionary is trained on at most so many documents, so many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1024, 8192, 32768
#: A file is closed at so many documents or bytes of frames.
FILE_DOCS, FILE_BYTES = 1 << 20, 1 << 30
#: Texts are cut, and files are read, so many bytes at a time (a longer document at once).
CUT_BYTES, READ_BYTES = 1 << 23, 1 << 22
#: Distinct pieces that a worker keeps.
PIECES = 1 << 19
MANIFEST = "part int, seq int, file string, first_id long, last_id long, has_null boolean, n_docs long, n_tokens long"

#: The rules of the word tokenizers whose pieces may be encoded one by one.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: Kinds of bytes: 0 space, 1 letter, 2 digit, 3 apostrophe, 4 other ASCII, 5 not ASCII.
_KIND = np.full(256, 5, np.uint8)
_KIND[:128] = 4
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 3
#: Whether a piece may end between two kinds; the second must be ASCII, else it may combine.
_CUT = np.zeros((6, 6), bool)
_CUT[:, 0] = _CUT[0, :] = True
_CUT[:, 2] = _CUT[2, :5] = True
_CUT[1, 3:5] = True
_CUT[4, 1] = True
_CUT_FLAT = _CUT.ravel()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def cuts_like_words(spec: str) -> bool:
    """Whether a tokenizer file has the rules that ``encode_pieces`` relies on."""
    t = json.loads(spec)
    norm = [x["type"] for x in (t.get("normalizer") or {}).get("normalizers", [])]
    pre = (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
    ok = norm == WORD_NORMALIZERS and len(pre) == 2 and pre[0]["type"] == "Split" and pre[0]["pattern"].get("Regex") == WORD_SPLIT
    ok = ok and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"]
    return bool(ok and not t.get("truncation") and not t.get("padding") and not any(a["lstrip"] or a["rstrip"] or a["normalized"] for a in t["added_tokens"]))


class IdEncoder:
    """Token ids of texts by the tokenizers library; distinct pieces are encoded once."""

    def __init__(self, spec: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores in its hands
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(spec), end_id
        self.pieces = cuts_like_words(spec)
        self.width = 2 if max(end_id + 1, self.tokenizer.get_vocab_size(with_added_tokens=True)) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        marks = set("".join(map(chr, range(33, 127))) + "".join(map(chr, range(161, 173))) + "".join(map(chr, range(174, 256))))
        rest = iter(range(256, 512))  # byte-level vocabularies show the other bytes by the characters from 256 on
        self.shown = {b: chr(b) if chr(b) in marks else chr(next(rest)) for b in range(256)}
        self.bare = Tokenizer.from_str(spec) if self.pieces else None
        if self.bare is not None:
            from tokenizers.normalizers import Sequence
            from tokenizers.pre_tokenizers import WhitespaceSplit

            self.bare.normalizer, self.bare.pre_tokenizer = Sequence([]), WhitespaceSplit()
            suffix, vocab = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
            self.last = np.zeros(1 << 8 * self.width if self.width == 2 else max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added)) if added else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.at, self.used = np.zeros(1 << 16, self.kind), np.zeros(1 << 16, np.int64), 0

    def _keep(self, words: list[bytes], n: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(words) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.at[first + 1:first + 1 + len(words)] = self.used + np.cumsum(n)
        self.used += len(ids)
        self.known.update(zip(words, range(first, first + len(words))))

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new pieces.  One of Latin letters only is a single word whose letters the
        rules merely lower; many of these go as one text, and come back cut where words end."""
        plain, shown, other = [], [], []
        for w in words:
            s = w.decode("utf-8", "replace")
            if s.isascii() and s.isalpha():
                plain.append(w)
                shown.append(s)
            elif s.isalpha() and max(s) <= "\xff":
                plain.append(w)
                shown.append(s.lower().encode().decode("latin-1").translate(self.shown))
            else:
                other.append(w)
        for k in range(0, len(plain), 1 << 10):
            some = plain[k:k + (1 << 10)]
            ids = np.array(self.bare.encode_batch_fast([" ".join(shown[k:k + (1 << 10)])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                self._keep(some, np.diff(ends, prepend=0), ids)
            else:
                other += some
        for k in range(0, len(other), 1 << 13):
            some = other[k:k + (1 << 13)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)]
            self._keep(some, np.fromiter(map(len, found), np.int64, len(found)), np.array([i for e in found for i in e], self.kind))

    def encode_pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offset of each row's ids) of consecutive texts, cut into pieces."""
        n, rows = len(data), len(at) - 1
        if not n:
            return np.zeros(0, self.kind), np.zeros(rows + 1, np.int64)
        kind = _KIND[data]
        edge = np.ones(n, bool)
        edge[1:] = _CUT_FLAT[kind[:-1] * np.uint8(6) + kind[1:]]
        begins = at[:-1]
        edge[begins[begins < n]] = True
        full = kind != 0
        edge &= full
        start = np.flatnonzero(edge)
        before = np.cumsum(full, dtype=np.int64)
        offsets = np.append(before[start] - 1, before[-1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_FOLD[data[full]])])
        coded = words.dictionary_encode()
        _, bounds, letters = coded.dictionary.buffers()
        letters = letters.to_pybytes() if letters is not None else b""
        bounds = np.frombuffer(bounds, np.int64, len(coded.dictionary) + 1).tolist()
        distinct = [letters[i:j] for i, j in zip(bounds, bounds[1:])]
        if len(self.known) + len(distinct) > PIECES:
            self._forget()
        where = list(map(self.known.get, distinct))
        if None in where:
            self._learn([w for w, k in zip(distinct, where) if k is None])
            where = list(map(self.known.get, distinct))
        place = np.array(where, np.int64)
        word = place[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        first, size = self.at[word], self.at[word + 1] - self.at[word]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(first - (ends - size), size) + np.arange(total)]
        until = np.concatenate([[0], ends])
        return ids, until[np.searchsorted(start, at)]

    def encode_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def batches(self, column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(first row, row after the last, ids with the end id) of a string column."""
        end = np.array([self.end_id], self.kind)
        for lo, hi, data, at in slices(column, CUT_BYTES):
            raw = data.tobytes() if self.added or not self.pieces else b""
            texts = lambda k: raw[at[k]:at[k + 1]].decode("utf-8", "replace")
            if self.pieces:
                flat, until = self.encode_pieces(data, at)
                out = [flat[until[k]:until[k + 1]] for k in range(hi - lo)]
                if self.added and self.added.search(raw.decode("utf-8", "replace")):
                    odd = [k for k in range(hi - lo) if self.added.search(texts(k))]
                    for k, ids in zip(odd, self.encode_whole([texts(k) for k in odd])):
                        out[k] = ids
            else:
                out = self.encode_whole([texts(k) for k in range(hi - lo)])
            yield lo, hi, [np.concatenate([ids, end]) for ids in out]


_ENCODERS: dict[tuple[str, int], IdEncoder] = {}


def _encoder(spec: str, end_id: int) -> IdEncoder:
    key = (hashlib.sha256(spec.encode()).hexdigest(), end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = IdEncoder(spec, end_id)
    return _ENCODERS[key]


def _sample(spec, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(spec.value, end_id)
        for b in batches:
            for _, _, docs in enc.batches(b.column("_text")):
                yield pa.RecordBatch.from_pydict({"ids": pa.array([x.tobytes()[:SAMPLE_BYTES] for x in docs], pa.binary())})
    return run


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; with too few samples to train, the samples themselves."""
    samples = [s for s in samples if s]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples)
        except zstandard.ZstdError:  # samples too small or too alike
            pass
    return zstandard.ZstdCompressionDict((b"".join(samples) or b"\x00" * 8)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == b"\x37\xa4\x30\xec"  # zstandard's own mark
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, up to CUT_BYTES: a distinct piece is looked up once in each."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CUT_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _frames(spec, end_id: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(spec.value, end_id)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=True)
        for t in _gathered(batches):
            ids = t.column("_id").combine_chunks()
            for lo, hi, docs in enc.batches(t.column("_text")):
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([len(x) for x in docs], pa.int64()),
                                                  pa.array([press.compress(x) for x in docs], pa.binary())], ["_id", "n", "frame"])
    return run


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    folder = re.sub(r"^file:/+", "/", folder)
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder)


class _File:
    """A file that is being written."""

    def __init__(self, fs: pafs.FileSystem, folder: str, part: int, seq: int, width: int, digest: bytes) -> None:
        self.name = f"part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.tokids"
        self.out = fs.open_output_stream(f"{folder}/{self.name}", compression=None)
        self.out.write(HEADER.pack(MAGIC, 1, width, digest))
        self.at, self.ids, self.n = [HEADER.size], [], []

    def add(self, ident: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.at.append(self.at[-1] + len(frame))
        self.ids.append(ident)
        self.n.append(n)

    def full(self) -> bool:
        return len(self.n) >= FILE_DOCS or self.at[-1] >= FILE_BYTES

    def close(self, part: int, seq: int) -> dict:
        known = [i for i in self.ids if i is not None]
        self.out.write(np.array([0 if i is None else i for i in self.ids], "<i8").tobytes())
        self.out.write(np.array([i is None for i in self.ids], "u1").tobytes())
        self.out.write(np.array(self.at, "<u8").tobytes())
        self.out.write(np.array(self.n, "<u8").tobytes())
        self.out.write(TRAILER.pack(self.at[-1], len(self.n), sum(self.n), MAGIC))
        self.out.close()
        return {"part": part, "seq": seq, "file": self.name, "first_id": known[0] if known else None, "last_id": known[-1] if known else None,
                "has_null": len(known) < len(self.ids), "n_docs": len(self.n), "n_tokens": sum(self.n)}


def _write(folder: str, width: int, digest: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        part, seq, file = TaskContext.get().partitionId(), 0, None
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()),
                            ("has_null", pa.bool_()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for b in batches:
            for ident, n, frame in zip(b.column("_id").to_pylist(), b.column("n").to_pylist(), b.column("frame")):
                if file is None:
                    file = _File(fs, path, part, seq, width, digest)
                file.add(ident, n, frame.as_buffer())
                if file.full():
                    yield pa.RecordBatch.from_pylist([file.close(part, seq)], schema)
                    file, seq = None, seq + 1
        if file is not None:
            yield pa.RecordBatch.from_pylist([file.close(part, seq)], schema)
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files of ``docs`` to ``folder`` and returns their manifest (also stored there).

    ``tokenizer``: path of a tokenizer file of the tokenizers library, read on the driver."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    spec = spark.sparkContext.broadcast(text)
    width = IdEncoder(text, end_id).width
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("_id"), text_of(docs, text_col).alias("_text"))
    step = max(1, docs.count() // SAMPLE_DOCS)
    picked = rows.where(F.pmod(F.xxhash64("_id", F.length("_text")), F.lit(step)) == 0).limit(SAMPLE_DOCS)
    dictionary = train_dictionary([bytes(r[0]) for r in picked.mapInArrow(_sample(spec, end_id), "ids binary").collect()]).as_bytes()
    digest = hashlib.sha256(dictionary).digest()
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{digest.hex()}.zdict", compression=None) as out:
        out.write(dictionary)
    frames = scratch(rows.mapInArrow(_frames(spec, end_id, dictionary), "_id long, n long, frame binary"), "frames")
    order = [F.col("_id").asc_nulls_last(), F.xxhash64("frame"), F.col("frame")]
    placed = frames.repartitionByRange(default_parts(spark), *order[:2]).sortWithinPartitions(*order)
    placed.mapInArrow(_write(folder, width, digest), MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class TokenFile:
    """One file: its index, and the ids of single documents or of all in order."""

    def __init__(self, fs: pafs.FileSystem, folder: str, name: str) -> None:
        self.file = fs.open_input_file(f"{folder}/{name}")
        end = self.file.size()
        index, self.n_docs, self.n_tokens, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, end - TRAILER.size))
        start, _, width, digest = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC or start != MAGIC:
            raise ValueError(f"{name} is no token file")
        self.kind = np.dtype(f"<u{width}")
        with fs.open_input_stream(f"{folder}/{digest.hex()}.zdict", compression=None) as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {name} is not the one it was written with")
        self.unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        raw, n = self.file.read_at(end - TRAILER.size - index, index), self.n_docs
        self.ids, self.null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.at, self.n = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64), np.frombuffer(raw, "<u8", n, 9 * n + 8 * (n + 1)).astype(np.int64)

    def _ids(self, frame: bytes, k: int) -> np.ndarray:
        ids = np.frombuffer(self.unpress.decompress(frame, max_output_size=int(self.n[k]) * self.kind.itemsize), self.kind)
        if len(ids) != self.n[k]:
            raise ValueError("a frame does not hold the ids that the index states")
        return ids

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, by one read of its frame."""
        return self._ids(self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])), k)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        lo = 0
        while lo < self.n_docs:
            hi = int(max(lo + 1, np.searchsorted(self.at, self.at[lo] + READ_BYTES, "right") - 1))
            raw = memoryview(self.file.read_at(int(self.at[hi] - self.at[lo]), int(self.at[lo])))
            for k in range(lo, hi):
                yield k, self._ids(raw[self.at[k] - self.at[lo]:self.at[k + 1] - self.at[lo]], k)
            lo = hi


def _digests(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for b in batches:
            for row in b.to_pylist():
                file = TokenFile(fs, path, row["file"])
                start = row["start"] + np.concatenate([[0], np.cumsum(file.n)[:-1]])
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in file.documents()), np.int64, file.n_docs)
                for k in range(0, file.n_docs, 1 << 14):
                    some = slice(k, k + (1 << 14))
                    yield pa.RecordBatch.from_arrays([pa.array(file.ids[some], mask=file.null[some]), pa.array(start[some]), pa.array(file.n[some]),
                                                      pa.array(crc[some])], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest, a row a file, with the number of ids of all files before."""
    earlier = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def _spread(files: DataFrame) -> DataFrame:
    """A file to a task, as far as there are tasks."""
    return files.repartition(default_parts(files.sparkSession), F.col("part"), F.col("seq"))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files: ids of all
    documents before it, its own ids, and the CRC-32 of those as unsigned 32-bit integers."""
    files = _spread(with_starts(read_manifest(spark, folder)))
    return files.mapInArrow(_digests(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _fetch(folder: str):
    def run(keys: tuple, wanted: pa.Table) -> pa.Table:
        fs, path = filesystem(folder)
        file = TokenFile(fs, path, keys[0].as_py())
        asked = pc.unique(wanted.column("_id")).to_numpy()
        place = np.flatnonzero(np.isin(file.ids, asked) & ~file.null)
        return pa.table({"doc_id": pa.array(file.ids[place]), "ids": pa.array([file.document(k).astype(np.int64) for k in place.tolist()], pa.list_(pa.int64()))})
    return run


def fetch(spark: SparkSession, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted documents: only files whose range holds an id are opened, and
    only the frames of those documents are read."""
    asked = wanted.select(wanted[f"`{id_col}`"].cast("long").alias("_id")).where("_id is not null").distinct()
    files = read_manifest(spark, folder).where("first_id is not null").select("file", "first_id", "last_id")
    met = asked.join(files, (asked["_id"] >= files["first_id"]) & (asked["_id"] <= files["last_id"])).select("file", "_id")
    return met.groupBy("file").applyInArrow(_fetch(folder), "doc_id long, ids array<long>")
