"""Streaming wrappers, manifest checks and the driver entry points."""

import os

import pytest
from pyspark.sql import functions as F

from reqscope.functions.features import FEATURE_COLUMNS
from reqscope.sources import views
from reqscope.sources.dumps import check_manifest
from reqscope.streaming.requests import stream_dump_files, stream_features
from test_parse import F1


def test_stream_features_memory_sink(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "req")
    views.page_requests(spark, "/root/testdata/sf0.001").write.parquet(src)
    q = (stream_features(spark, src).writeStream.format("memory").queryName("feat_stream")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start())
    q.processAllAvailable()
    q.stop()
    out = spark.sql("select * from feat_stream")
    assert out.count() == views.table(spark, "/root/testdata/sf0.001", "pages").count()
    assert tuple(out.columns) == ("pos",) + FEATURE_COLUMNS


def test_stream_dump_files(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write(F1)
    sink = os.path.join(tmpdir_path, "out")
    q = stream_dump_files(spark, src, sink, label=1, checkpoint=os.path.join(tmpdir_path, "ck2"),
                          trigger_once=True)
    q.awaitTermination(120)
    rows = spark.read.parquet(sink).orderBy("pos").collect()
    assert [r.target for r in rows] == ["http://h:8080/shop/list?id=1&x=&y", "http://h:8080/shop/pay", "/a"]


def test_manifest_errors(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError, match="missing.txt"):
        check_manifest(spark, tmpdir_path, ["missing.txt"])
    open(os.path.join(tmpdir_path, "empty.txt"), "w").close()
    with pytest.raises(ValueError, match="empty.txt"):
        check_manifest(spark, tmpdir_path, ["empty.txt"])


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and "avg_shannon_entropy" in df.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 70
    r = qs["features_all"](spark, "/root/testdata/sf0.001")
    assert r.where(F.col("label") == 1).count() > 0
