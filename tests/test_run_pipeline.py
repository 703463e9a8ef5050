"""The whole run on a small dump folder, and the readers' and loaders' order."""

import json
import os

from pyspark.sql import functions as F


def _dump(path, name, texts):
    with open(os.path.join(path, name), "w") as f:
        f.write("\n\n".join(texts) + "\n")


def test_request_runs_over_the_edge_of_a_part(spark, tmpdir_path):
    from reqscope.sources.dumps import load_bundle

    files = (("a.txt", 0, "lm_train"), ("b.txt", 1, "inference"))
    os.makedirs(f"{tmpdir_path}/a.txt")
    with open(f"{tmpdir_path}/a.txt/part-00000", "w") as f:
        f.write("junk\nPOST /x HTTP/1.1\nX-A: 1\n")
    with open(f"{tmpdir_path}/a.txt/part-00001", "w") as f:
        f.write("X-B: 2\n\nbody=1\n\nGET /y HTTP/1.1\n")
    _dump(tmpdir_path, "b.txt", ["GET /z HTTP/1.1"])
    got = load_bundle(spark, tmpdir_path, files).orderBy("split", "pos").collect()
    assert [(r.split, r.pos, r.target, len(r.headers), r.body, r.label) for r in got] == [
        ("inference", 0, "/z", 0, "", 1), ("lm_train", 0, "/x", 2, "body=1", 0), ("lm_train", 1, "/y", 0, "", 0)]


def test_structured_rows_in_file_order(spark, tmpdir_path):
    from reqscope.sources.dumps import load_structured

    for name, n in (("a.json", 1), ("b.json", 50)):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.writelines(json.dumps({"method": "GET", "target": f"/{name}/{i}"}) + "\n" for i in range(n))
    rows = load_structured(spark, tmpdir_path).orderBy("pos").collect()
    assert [r.target for r in rows] == ["/a.json/0"] + [f"/b.json/{i}" for i in range(50)]


def test_null_groups_and_outliers_keep_their_rows(spark):
    from reqscope.operators.distribution import histogram
    from reqscope.operators.ordered import exact_quantiles, weighted_prefix

    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0), ("a", 3.0)], "g string, v double")
    assert histogram(df, "v", ["g"], bins=2).agg(F.sum("n")).first()[0] == 4
    assert {(r.g, r.q) for r in exact_quantiles(df, "g", "v", [0.5]).collect()} == {(None, 1.5), ("a", 2.0)}
    far = spark.range(2000).select((F.col("id") + F.when(F.col("id") == 1999, 10**12).otherwise(0)).alias("p"), F.lit(1).alias("w"))
    got = weighted_prefix(far, [], "p", ["w"], n_parts=8)
    assert [r.cum_w for r in got.orderBy("p").collect()] == list(range(1, 2001))


def test_history_needs_a_place(spark):
    from reqscope.operators.lm import normalize_history

    hist = spark.createDataFrame([("r", 1.0, None, 0.5), ("r", None, None, 0.4)], "run string, step double, epoch double, loss double")
    assert [r.x for r in normalize_history(hist).collect()] == [1.0]


def test_small_split_falls_back(spark):
    from reqscope.operators.splits import holdout_split

    df = spark.createDataFrame([(i, i % 2) for i in range(4)], "pos long, label int")
    assert {r.split for r in holdout_split(df, test_size=0.1).collect()} == {"both"}


def test_long_pretoken_encodes_fast():
    from reqscope.operators.bpe import _bpe_word

    ranks = {(5, 5): (0, 6), (6, 6): (1, 7)}
    assert _bpe_word([5] * 20_000, ranks) == [7] * 5000 and _bpe_word([5] * 7, ranks) == [7, 6, 5]


def test_run_pipeline_from_dumps_to_reports(spark, tmpdir_path):
    """Entry points 1 to 3 on a small dump folder: every report is there, and the record holds them all."""
    from reqscope.plans.pipeline import PipelineConfig, run_pipeline
    from reqscope.sources.dumps import CSIC_FILES

    raw, out_dir = f"{tmpdir_path}/raw", f"{tmpdir_path}/out"
    os.makedirs(raw)
    for (name, label, _), n in zip(CSIC_FILES, (30, 40, 30)):
        texts = []
        for i in range(n):
            path = f"/shop/item{i % 13}.jsp?id={i}&q=a{i * 7 % 11}" + ("' OR '1'='1" + "<script>" * (i % 4) if label else "")
            texts.append(f"GET {path} HTTP/1.1\nHost: shop.example\nX-N: {i % 5}" if i % 3 else f"POST /login{i % 4} HTTP/1.1\nHost: shop.example\n\nuser=u{i}&pw={'%27' * label}{i}")
        _dump(raw, name, texts)
    cfg = PipelineConfig(vocab_size=300, max_length=64, embedding_dim=8, run_cv=False)
    out = run_pipeline(spark, raw, out_dir, cfg)
    models = {r.model for r in out["metrics"].select("model").distinct().collect()}
    assert {"logistic_regression", "linear_svc", "random_forest", "gradient_boosting", "knn", "mlp_head", "isolation_forest",
            "local_outlier_factor", "descriptive_logistic_regression", "lexical_linear_svc"} <= models
    assert out["bpe_merges"].count() == 300 - 261 and out["class_balance"].agg(F.sum("n")).first()[0] == 70
    record = {}
    for f in os.listdir(f"{out_dir}/record"):
        if f.endswith(".json"):
            with open(f"{out_dir}/record/{f}") as h:
                record.update((r["key"], r["value"]) for r in map(json.loads, h))
    assert {"config.vocab_size", "class.0", "class.1", "duplicate_rate.raw_text", "leakage_holdout", "leakage_cross", "dedup_delta.f1",
            "metric.logistic_regression.f1", "metric.mlp_head.mcc"} <= record.keys()
    assert record["class.1"] == "30" and record["config.max_length"] == "64"
    for name in ("comparison", "metrics", "confusion", "roc", "errors", "duplicates", "dedup_delta", "summary"):
        assert any(not f.startswith(("_", ".")) for f in os.listdir(f"{out_dir}/{name}")), name
