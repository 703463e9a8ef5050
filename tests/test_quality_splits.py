"""Duplicates, leakage (A1, N1, J1) and exact seeded splits (S7, X1–X5) — FIXTURES §4 cases."""

from pyspark.sql import functions as F

from reqscope.operators import quality as qa
from reqscope.operators import splits as sp


def _df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos long, text string")


def test_duplicates_and_first_positions(spark):
    df = _df(spark, ["a", "b", "a", "a"])
    r = qa.duplicate_report(df, "text").first()
    assert (r.n_total, r.n_unique, r.n_duplicate, r.duplicate_rate) == (4, 2, 2, 0.5)
    assert sorted(x.pos for x in qa.unique_first(df, "text").collect()) == [0, 1]
    empty = qa.duplicate_report(df.limit(0), "text").first()
    assert (empty.n_total, empty.duplicate_rate) == (0, 0.0)


def test_leakage(spark):
    r = qa.train_test_leakage(_df(spark, ["a", "b"]), _df(spark, ["a", "c"]), "text").first()
    assert (r.n_test, r.n_leaked, r.leakage_rate) == (2, 1, 0.5)
    e = qa.train_test_leakage(_df(spark, ["a"]), _df(spark, ["a"]).limit(0), "text").first()
    assert (e.n_test, e.leakage_rate) == (0, 0.0)


def test_subset_bankers_rounding(spark):
    df = _df(spark, list("abcde"))
    assert sp.sample_exact(df, 0.5, 42, "pos").count() == 2
    assert sp.sample_exact(df, 0.01, 42, "pos").count() == 1
    assert sp.sample_exact(df, 1.0, 42, "pos").count() == 5


def test_holdout_exact_disjoint_and_partition_independent(spark):
    rows = [(i, 1 if i % 4 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "pos long, label int")
    a = sp.holdout_split(df, "label", "pos", 0.3, 42)
    b = sp.holdout_split(df.repartition(7), "label", "pos", 0.3, 42)
    sa = {(r.pos, r.split) for r in a.collect()}
    sb = {(r.pos, r.split) for r in b.collect()}
    assert sa == sb
    test = [p for p, s in sa if s == "test"]
    assert len(test) == 300 and len(sa) == 1000
    assert sum(1 for p in test if p % 4 == 0) == 75


def test_holdout_fallback_and_folds(spark):
    one = spark.createDataFrame([(i, 0) for i in range(10)], "pos long, label int")
    assert {r.split for r in sp.holdout_split(one).collect()} == {"both"}
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "pos long, label int")
    folds = sp.kfold(df, 5, "label", "pos", 42).groupBy("fold", "label").count().collect()
    assert all(r["count"] == 5 for r in folds) and len(folds) == 10
    assert sp.safe_folds({0: 3, 1: 40}, 5) == 3 and sp.safe_folds({0: 10, 1: 40}, 5) == 5
    import pytest
    with pytest.raises(ValueError):
        sp.safe_folds({0: 1, 1: 40}, 5)


def test_validation_split(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "pos long")
    assert sp.validation_split(df, 0.05).where(F.col("is_val")).count() == 5
    assert sp.validation_split(df.limit(10), 0.05).where(F.col("is_val")).count() == 0


def test_cuts_match_plain_ranks(spark, monkeypatch):
    """Whatever the levels, the number of groups, null groups and quotas of none and all."""
    from pyspark.sql import Window

    df = spark.createDataFrame([(i, None if i % 11 == 0 else i % 5) for i in range(2000)], "pos long, g int")
    rank = F.row_number().over(Window.partitionBy("g").orderBy(sp.seeded_hash("pos", 7)))
    for quota in (lambda n, *_: F.floor(n / 3), lambda n, g: F.when(g == 1, 0).when(g == 2, n + 5).otherwise(7)):
        want = {r.pos for r in df.withColumns({"r": rank, "n": F.count("*").over(Window.partitionBy("g"))}).where(F.col("r") <= quota(F.col("n"), F.col("g"))).collect()}
        for literal, levels in ((128, {}), (128, {"digits": 1, "bucket_rows": 3}), (2, {"digits": 1, "bucket_rows": 3})):
            monkeypatch.setattr(sp, "LITERAL_GROUPS", literal)
            got = sp.mark_first(df, "pos", 7, quota, ("g",), **levels).where("_first")
            assert {r.pos for r in got.collect()} == want and want
    assert sp.sample_exact(df.limit(0), 0.5, 1, "pos").count() == 0


def test_samples_and_splits_move_no_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("label", (F.col("doc_id") % 2).cast("int"))
    for out in (sp.sample_exact(df, 0.4, 1, "doc_id", ("label",)), sp.holdout_split(df, "label", "doc_id"), sp.validation_split(df, 0.1, 1, "doc_id")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan, plan


def test_seeded_rank_two_level_matches_plain_window(spark):
    from pyspark.sql import Window
    df = spark.createDataFrame([(i, i % 3) for i in range(3000)], "pos long, g int")
    fast = sp.seeded_rank(df, "pos", 7, ("g",), out="r", bucket_rows=50)
    h = sp.seeded_hash("pos", 7)
    slow = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(h)) - 1)
    assert {(r.pos, r.r) for r in fast.collect()} == {(r.pos, r.r) for r in slow.collect()}


def test_profile_quality_ops(spark):
    df = spark.createDataFrame([(1, 1.0, "x", None), (1, 2.0, "x", None), (1, float("nan"), "y", None)],
                               "a int, b double, c string, d string")
    miss = {r.column: r.n_missing for r in qa.missing_values(df).collect()}
    assert miss == {"a": 0, "b": 1, "c": 0, "d": 3}
    const = {r.column: r.is_constant for r in qa.constant_columns(df).collect()}
    assert const == {"a": 1, "b": 0, "c": 0, "d": 1}
    dup = spark.createDataFrame([(1, 1.0, 2), (2, 2.0, 3)], "a int, b double, c int")
    assert {r.column: r.duplicate_of for r in qa.duplicate_columns(dup).collect()} == {"a": "", "b": "a", "c": ""}
