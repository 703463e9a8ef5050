"""Token files: whole-text encodings by the library, order, single documents, and odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def library(texts, name="word_bpe_49k.json", end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def digest(rows):
    """(doc_id, start, n_tokens, ids_crc32) in order, by the definition."""
    order = sorted(zip([r[0] for r in rows], library([r[1] for r in rows])), key=lambda x: (x[0] is None, x[0] or 0))
    out, start = [], 0
    for ident, ids in order:
        out.append((ident, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_pieces_are_the_librarys_whole_text_ids():
    from reqscope.llm.token_files import IdEncoder, cuts_like_words

    spec = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    assert cuts_like_words(spec) and not cuts_like_words(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    rng = random.Random(7)
    parts = list("abISz'’,.!<|> \n\t0129é̸́ß…«»中文　 \x1c\x00\x7fΣσİ½٣-_‍😀=ÀÿµŸ×÷") + ["'s", "'ll", "<|endoftext|>", "endoftext", "the ", "It's"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    got = [x.tolist() for _, _, d in IdEncoder(spec, 2).batches(pa.array(texts)) for x in d]
    assert got == library(texts)


def test_query_matches_the_definition(spark):
    from reqscope.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_token_files"](spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(digest(rows))


def test_odd_rows_long_texts_and_single_documents(spark, tmpdir_path):
    from reqscope.llm import token_files as T

    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "Beta", "it's", "42", "née", "x,y"]) for _ in range(400_000))
    rows = [(3, "one two"), (1, None), (2, ""), (3, "one two"), (None, "tail"), (5, long), (-4, "<|endoftext|> now"), (7, "a" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "frame": F.lit(1), "_id": F.lit(0)}).repartition(3)
    manifest = T.write_token_files(docs, f"file://{tmpdir_path}/f", P.path("word_bpe_49k.json"), 2)
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    assert sorted(map(str, map(tuple, T.read_digests(spark, f"file://{tmpdir_path}/f").collect()))) == sorted(map(str, digest(rows)))
    wanted = spark.createDataFrame([(3,), (5,), (99,), (None,)], "doc_id long")
    found = sorted((r.doc_id, list(r.ids)) for r in T.fetch(spark, f"file://{tmpdir_path}/f", wanted).collect())
    assert found == sorted((i, ids) for (i, _), ids in zip(rows, library([t for _, t in rows])) if i in (3, 5))


def test_empty_table_and_other_tokenizers(spark, tmpdir_path):
    from reqscope.llm import token_files as T

    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.write_token_files(none, f"{tmpdir_path}/e", P.path("word_bpe_49k.json"), 2).count() == 0
    assert T.read_digests(spark, f"{tmpdir_path}/e").count() == 0
    docs = spark.createDataFrame([(k, f"Some text  number {k}\n" * k) for k in range(40)], "doc_id long, text string")
    T.write_token_files(docs, f"{tmpdir_path}/g", P.path("byte_bpe_50k.json"), 50256)
    got = {r.doc_id: list(r.ids) for r in T.fetch(spark, f"{tmpdir_path}/g", docs).collect()}
    assert [got[k] for k in range(40)] == library([f"Some text  number {k}\n" * k for k in range(40)], "byte_bpe_50k.json", 50256)


def test_a_wrong_dictionary_is_noticed(spark, tmpdir_path):
    import glob

    from reqscope.llm import token_files as T

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(5)], "doc_id long, text string")
    T.write_token_files(docs, f"{tmpdir_path}/d", P.path("word_bpe_49k.json"), 2)
    with open(glob.glob(f"{tmpdir_path}/d/*.zdict")[0], "ab") as f:
        f.write(b"!")
    fs, path = T.filesystem(f"{tmpdir_path}/d")
    with pytest.raises(ValueError):
        T.TokenFile(fs, path, T.read_manifest(spark, f"{tmpdir_path}/d").first().file)
