"""Plan assertions: no Python in the feature projection, pushdown and
pruning at the scan, block numbering windowed per (file, split), no nested-loop joins."""

import os

from reqscope.functions.features import feature_frame
from reqscope.sources import views
from reqscope.sources.dumps import number_blocks, read_dump_lines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_stay_in_jvm_and_prune_columns(spark):
    plan = _plan(feature_frame(views.page_requests(spark, "/root/testdata/sf0.001")))
    assert "EvalPython" not in plan and "PythonUDF" not in plan
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan


def test_filter_pushdown(spark):
    from pyspark.sql import functions as F
    plan = _plan(views.table(spark, "/root/testdata/sf0.001", "events")
                 .where(F.col("event_type") == "error").select("event_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan


def test_block_numbering_window_is_per_split(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "d.txt")
    with open(p, "w") as f:
        f.write("GET / HTTP/1.1\n")
    plan = _plan(number_blocks(read_dump_lines(spark, p)))
    window_lines = [ln for ln in plan.splitlines() if "Window [" in ln]
    assert window_lines and all("source_file" in ln and "split_start" in ln for ln in window_lines)


def test_no_nested_loop_joins_in_metrics(spark):
    import __spark_entry__ as entry
    qs = entry.queries()
    for name in ("roc_points", "roc_auc", "leakage_holdout", "describe_num", "knn_topk"):
        plan = _plan(qs[name](spark, "/root/testdata/sf0.001"))
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
