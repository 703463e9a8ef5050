"""S9 structured loader, S10/S11 sinks, U5 registry merge, T4 best model, R6 confusion table."""

import json
import os

from pyspark.sql import functions as F

from reqscope.operators import report as RP
from reqscope.sources.dumps import REQUEST_COLUMNS, load_structured


def test_structured_loader(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "logs.json")
    with open(p, "w") as f:
        f.write(json.dumps({"verb": "GET", "url": "/a?x=1", "hdrs": "Host: h\nX: y", "label": 1}) + "\n")
        f.write(json.dumps({"verb": "POST", "url": "/b", "body": "k=v", "label": 0}) + "\n")
    req = load_structured(spark, p, "json", label="label",
                          columns={"method": "verb", "target": "url", "headers": "hdrs"})
    rows = req.orderBy("pos").collect()
    assert tuple(req.columns) == REQUEST_COLUMNS
    assert [r.pos for r in rows] == [0, 1]
    assert rows[0].raw == "GET /a?x=1\nHost: h\nX: y" and rows[0].headers[1].value == "y"
    assert rows[1].body == "k=v" and rows[1].label == 0 and rows[1].headers == []


def test_registry_merge_best_and_sinks(spark, tmpdir_path):
    a = spark.createDataFrame([("m1", 0.5), ("m2", 0.7)], "model string, f1 double")
    b = spark.createDataFrame([("m2", 0.9)], "model string, f1 double")
    merged = {r.model: r.f1 for r in RP.merge_registries(a, b).collect()}
    assert merged == {"m1": 0.5, "m2": 0.9}
    assert RP.best_overall(RP.merge_registries(a, b)) == "m2"
    RP.write_metrics_csv(a, os.path.join(tmpdir_path, "csv"))
    RP.write_json(b, os.path.join(tmpdir_path, "json"))
    assert spark.read.option("header", True).csv(os.path.join(tmpdir_path, "csv")).count() == 2
    assert spark.read.json(os.path.join(tmpdir_path, "json")).first().model == "m2"


def test_confusion_table_zero_cells(spark):
    preds = spark.createDataFrame([("m", 0, 0), ("m", 0, 0), ("m", 1, 1)], "model string, y_true int, y_pred int")
    t = {(r.true, r.predicted): r.n for r in RP.confusion_table(preds).collect()}
    assert t == {("normal", "normal"): 2, ("normal", "anomaly"): 0, ("anomaly", "normal"): 0,
                 ("anomaly", "anomaly"): 1}
    one = preds.where(F.col("y_true") == 0).withColumn("y_score", F.lit(0.5))
    assert RP.roc_overlay(one).count() == 0
