"""The corpus pipeline: stages, schema, and its SQL on the smallest tables."""

import duckdb

from reqscope.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    clash = {c: docs_extra() for c in ("n_lines", "n_dropped", "score", "lang_pred", "kept", "_row", "spans")}  # not null, and named like the operators' own
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(clash).limit(60).cache()
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert all(set(r) == {"clash"} for r in out.select(*clash).collect())
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_no_labelled_text_keeps_what_has_letters(spark):
    import corpus_pipeline as C

    rows = [(1, "some words", None), (2, "123 456", None), (3, None, None), (4, "mots", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in C.language_id(spark, docs, SF).collect()) == [1, 4]


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_run_matches_sql(spark):
    import corpus_pipeline as C

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = C.run(spark, SF)
    want = con.sql(C.ORACLE_SQL)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted((norm([r[c] for c in cols]) for r in got.collect()), key=repr) == sorted(
        (norm([r[list(want.columns).index(c)] for c in cols]) for r in want.fetchall()), key=repr)


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
