"""Operator 4: language identification with hyperdimensional n-gram profiles.

Each letter has a random vector of +1 and -1, a function of its code point alone.  An n-gram
binds (multiplies) the vectors of its letters, each permuted (rotated) by its place; a text
bundles (adds) the vectors of its n-grams, a language the unit vectors of its texts.  A text
gets the language whose prototype has the largest cosine with it, after the mean of all
prototypes has been taken from both (it holds what the languages share).

Letters are lower-cased; runs of anything else are one boundary symbol, so that n-grams know
word ends.  Bundling is a matrix product of n-gram counts and n-gram vectors, slice by slice;
prototypes are summed in integers, so any order gives the same sums.  What goes to the driver
is languages x dimensions numbers.

Defined results: a text that is null or without letters is ``und`` with score 0; ties go to
the language first in code point order; without labelled texts every text is ``und``.  Rows
with a null language teach nothing.  All input columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pack, slices, text_of, unpack, without

DIMENSIONS = 1024
N = 3
SCALE = 1 << 20
COLUMNS = 4096
CELLS = 1 << 21
#: Text bytes bundled at a time.
SLICE = 1 << 19
#: n-gram vectors that a worker keeps; beyond it they are made again when needed.
KEEP = 20_000

_letters: dict[int, np.ndarray] = {}
_is_letter = np.zeros(0, bool)


def letter_table() -> np.ndarray:
    """Whether a code point is a letter, per code point."""
    global _is_letter
    if not len(_is_letter):
        _is_letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _is_letter


def letter_vector(code: int) -> np.ndarray:
    if code not in _letters:
        if len(_letters) > 5000:
            _letters.clear()
        _letters[code] = np.random.default_rng([977, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return _letters[code]


class GramVectors:
    """Vectors of n-grams, kept from slice to slice."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.matrix = np.zeros((1024, DIMENSIONS), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        if len(self.place) + len(grams) > KEEP:
            self.place = {}
        out = np.empty(len(grams), np.int64)
        for k, g in enumerate(grams.tolist()):
            at = self.place.get(g)
            if at is None:
                at = self.place[g] = len(self.place)
                if at >= len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                v = np.ones(DIMENSIONS, np.int8)
                for j in range(N):
                    v = v * np.roll(letter_vector((g >> (21 * j)) & 0x1FFFFF), j)
                self.matrix[at] = v
            out[k] = at
        return self.matrix[out].astype(np.float32)


_grams = GramVectors()


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count), rows in order; an n-gram packs 21 bits per symbol, 0 is the boundary."""
    symbols, owner = [], []
    for k, t in enumerate(texts):
        code = np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        code = np.where(letter_table()[code], code, 0) if len(code) else code
        if not code.any():
            continue
        code = np.concatenate([[0], code, [0]])
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        code = code[keep]
        symbols.append(code)
        owner.append(np.full(len(code), k))
    if not symbols:
        e = np.zeros(0, np.int64)
        return e, e, e
    symbols, owner = np.concatenate(symbols), np.concatenate(owner)
    alphabet, small = np.unique(symbols, return_inverse=True)
    size = len(alphabet)
    m = len(symbols) - N + 1
    same = owner[:m] == owner[N - 1:]
    gram = np.zeros(max(m, 0), np.int64)
    for j in range(N):
        gram = gram * size + small[j:m + j]
    key, count = np.unique((owner[:m] * size ** N + gram)[same], return_counts=True)
    row, gram = key // size ** N, key % size ** N
    packed = np.zeros(len(gram), np.int64)
    for j in range(N):
        packed |= alphabet[gram % size] << (21 * j)
        gram = gram // size
    return row, packed, count


def text_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have letters, their unit vectors)."""
    row, gram, count = gram_counts(texts)
    own, r = np.unique(row, return_inverse=True)
    ids, col = np.unique(gram, return_inverse=True)
    out = np.zeros((len(own), DIMENSIONS), np.float32)
    edge = np.searchsorted(r, np.arange(len(own) + 1))
    for a in range(0, len(ids), COLUMNS):  # a bounded matrix of counts at a time; whole numbers, so sums are exact
        vectors = _grams.of(ids[a:a + COLUMNS])
        for lo in range(0, len(own), CELLS // COLUMNS):
            hi = min(len(own), lo + CELLS // COLUMNS)
            k = slice(edge[lo], edge[hi])
            part = (col[k] >= a) & (col[k] < a + COLUMNS)
            counts = np.zeros((hi - lo, len(vectors)), np.float32)
            counts[r[k][part] - lo, col[k][part] - a] = count[k][part]
            out[lo:hi] += counts @ vectors
    return own, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column("_lang").to_pylist()
        for lo, hi, _, _ in slices(b.column("_text"), SLICE):
            rows, vectors = text_vectors(b.column("_text").slice(lo, hi - lo).to_pylist())
            whole = np.rint(vectors.astype(np.float64) * SCALE).astype(np.int64)
            for lang in {langs[lo + r] for r in rows.tolist()}:
                mine = np.array([langs[lo + r] == lang for r in rows.tolist()])
                total[lang] = total.get(lang, np.zeros(DIMENSIONS, np.int64)) + whole[mine].sum(0)
    for lang, v in total.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "vector": pa.array([v.tolist()], pa.list_(pa.int64()))})


class LanguageModel:
    """Prototypes: one unit vector per language, without their common mean."""

    def __init__(self, langs: list[str], sums: np.ndarray) -> None:
        self.langs = langs
        unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.mean = unit.mean(0) if len(langs) > 1 else np.zeros(DIMENSIONS)
        own = unit - self.mean
        self.prototypes = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        if self.langs:
            rows, v = text_vectors(texts)
            v = v - self.mean.astype(np.float32)
            cosine = (v @ self.prototypes.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            for r, k, c in zip(rows.tolist(), cosine.argmax(1).tolist() if len(rows) else [], cosine.max(1).tolist() if len(rows) else []):
                pred[r], score[r] = self.langs[k], min(1.0, max(0.0, c))
        return pred, score


def train(docs: DataFrame, lang: Column, use: Column, text_col: str = "text") -> LanguageModel:
    """Prototypes from all rows for which ``use`` holds and whose language is not null."""
    texts = docs.select(text_of(docs, text_col).alias("_text"), lang.cast("string").alias("_lang"), use.alias("_use"))
    sums = (texts.where("_use and _lang is not null").select("_text", "_lang").mapInArrow(_sums, "lang string, vector array<long>")
            .select("lang", F.posexplode("vector").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v"))  # languages x dimensions
            .orderBy("lang").collect())
    return LanguageModel([r["lang"] for r in sums], np.array([[e["x"] for e in r["v"]] for r in sums], np.float64).reshape(len(sums), DIMENSIONS))


def _predict(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            text = b.column("_text")
            for lo, hi, _, _ in slices(text, SLICE):
                pred, score = m.predict(text.slice(lo, hi - lo).to_pylist())
                kept = [b.column(c).slice(lo, hi - lo) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score; prediction reads the text alone."""
    packed = pack(docs, without(docs, text_col), _text=docs[f"`{text_col}`"].cast("string"))
    row = f"_row {packed.schema['_row'].dataType.simpleString()}" + ", _text string" * carry_text
    names = ["_row", "_text"] if carry_text else ["_row"]
    out = packed.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), names), f"{row}, lang_pred string, score double")
    columns = docs.columns if carry_text else without(docs, text_col)
    return unpack(out, columns, {text_col: F.col("_text")} if carry_text else None, {"lang_pred": F.col("lang_pred"), "score": F.col("score")})


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 4 is 2 (a null id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
