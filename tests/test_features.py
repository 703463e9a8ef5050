"""Descriptive features (F1–F17): FIXTURES F-1 values and a plain-Python cross-check."""

import collections
import math
from urllib.parse import urlsplit

import pytest

from reqscope.functions.features import FEATURE_COLUMNS, feature_frame
from reqscope.sources import views
from reqscope.sources.dumps import parse_dump_column
from test_parse import F1


def _py_features(target, body):
    """Independent plain-Python rendering of the feature rules, for cross-checks."""
    blob = target + body
    n = len(blob)
    counts = collections.Counter(blob)
    ent = 0.0 if not n else -sum((c / n) * math.log2(c / n) for c in counts.values())
    try:
        path = urlsplit(target).path
    except ValueError:
        path = target
    q = target.split("?", 1)[1] if "?" in target else None
    low = blob.lower()
    return {
        "target_length": len(target), "body_length": len(body),
        "n_query_params": 0 if q is None else sum(1 for p in q.split("&") if p),
        "path_depth": sum(1 for s in path.split("/") if s),
        "pct_encoding_count": blob.count("%"),
        "digit_ratio": (sum(c.isdigit() for c in blob) / n) if n else 0.0,
        "upper_ratio": (sum(c.isupper() for c in blob) / n) if n else 0.0,
        "non_alnum_ratio": (sum(not c.isalnum() for c in blob) / n) if n else 0.0,
        "shannon_entropy": ent,
        "contains_sql_keyword": int(any(k in low for k in ("select", "union", "drop", "insert", "--", ";",
                                                           "or ", "' or"))),
        "contains_script_tag": int("<script" in low or "%3cscript" in low),
    }


def test_f1_expected_values(spark):
    df = spark.createDataFrame([(1, F1)], "id long, text string")
    req = parse_dump_column(df, "id", "text").withColumnRenamed("block_no", "pos").withColumn("label", 1 + 0 * df.id)
    ff = {r.pos: r for r in feature_frame(req, keep=("pos",)).collect()}
    exp = {1: (33, 0, 5, 3, 2, 0, 0, 4.028946, 0, 0), 2: (22, 28, 1, 0, 2, 1, 2, 4.583465, 1, 1),
           3: (2, 0, 0, 0, 1, 0, 0, 1.0, 0, 0)}
    for pos, (tl, bl, nh, nq, pd_, hb, pc, ent, sq, sc) in exp.items():
        r = ff[pos]
        assert (r.target_length, r.body_length, r.n_headers, r.n_query_params, r.path_depth, r.has_body,
                r.pct_encoding_count, r.contains_sql_keyword, r.contains_script_tag) == (tl, bl, nh, nq, pd_, hb,
                                                                                           pc, sq, sc)
        assert round(r.shannon_entropy, 6) == ent
    assert ff[1].digit_ratio == pytest.approx(5 / 33) and ff[1].non_alnum_ratio == pytest.approx(11 / 33)
    assert ff[2].digit_ratio == pytest.approx(9 / 50) and ff[2].upper_ratio == pytest.approx(4 / 50)
    assert ff[2].non_alnum_ratio == pytest.approx(17 / 50) and ff[3].non_alnum_ratio == pytest.approx(0.5)


def test_schema_and_empty_input(spark):
    req = views.page_requests(spark, "/root/testdata/sf0.001").limit(0)
    ff = feature_frame(req)
    assert tuple(ff.columns) == FEATURE_COLUMNS and ff.count() == 0
    types = dict(ff.dtypes)
    assert types["method"] == "string" and types["shannon_entropy"] == "double" and types["label"] == "int"


def test_plain_python_cross_check_pages(spark):
    req = views.page_requests(spark, "/root/testdata/sf0.001")
    rows = req.select("pos", "target", "body").collect()
    got = {r.pos: r for r in feature_frame(req, keep=("pos",)).collect()}
    assert rows
    for r in rows:
        exp = _py_features(r.target, r.body)
        g = got[r.pos]
        for k, v in exp.items():
            assert getattr(g, k) == pytest.approx(v, abs=1e-9), (r.pos, k)


def test_unicode_classes(spark):
    texts = ["x²³①", "ÀÉÎ abc", "Ⅻ ⅻ", "١٢٣", "a b"]
    df = spark.createDataFrame([(i, "GET", t, "", 0) for i, t in enumerate(texts)],
                               "pos long, method string, target string, body string, label int")
    df = df.withColumn("headers", df.method.substr(1, 0).cast("string"))
    from pyspark.sql import functions as F
    df = df.withColumn("headers", F.array().cast("array<struct<name:string,value:string>>"))
    got = {r.pos: r for r in feature_frame(df, keep=("pos",)).collect()}
    for i, t in enumerate(texts):
        exp = _py_features(t, "")
        for k in ("digit_ratio", "upper_ratio", "non_alnum_ratio", "shannon_entropy"):
            assert getattr(got[i], k) == pytest.approx(exp[k], abs=1e-12), (t, k)
