"""Plot-ready report tables and sinks.

Figures are re-aimed as tables; every table here is a small aggregate of the
predictions / metrics tables, written with the DataFrame writers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import COMPARISON_METRICS

CLASS_NAMES = ("normal", "anomaly")


def comparison_frame(long: DataFrame, metrics: Sequence[str] = COMPARISON_METRICS) -> DataFrame:
    """Model × metrics (fixed column list, NaN where a model lacks a metric)."""
    p = long.where(F.col("metric").isin(list(metrics))).groupBy("model").pivot("metric", list(metrics)) \
        .agg(F.first("value"))
    return p.select("model", *[F.coalesce(F.col(m), F.lit(float("nan"))).alias(m) for m in metrics])


def cv_table(summary: DataFrame, metrics: Sequence[str] = COMPARISON_METRICS) -> DataFrame:
    """R2: model × metric means from the CV summary."""
    return comparison_frame(summary.select("model", "metric", F.col("mean").alias("value")), metrics)


def focus(frame: DataFrame, models: Sequence[str]) -> DataFrame:
    """The baseline focus subset."""
    return frame.where(F.col("model").isin(list(models)))


def format_cv(summary: DataFrame) -> DataFrame:
    """``f1=0.812+/-0.011, mcc=…, roc_auc=…`` per model ('(no metrics)' when none)."""
    keys = ("f1", "mcc", "roc_auc")
    parts = summary.where(F.col("metric").isin(*keys)).select(
        "model", "metric", F.format_string("%s=%.3f+/-%.3f", "metric", "mean", "std").alias("s"))
    order = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("metric"))
    agg = parts.withColumn("_o", order).groupBy("model").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "s"))), lambda x: x["s"]), ", ")
        .alias("summary"))
    return agg.withColumn("summary", F.when(F.col("summary") == "", "(no metrics)").otherwise(F.col("summary")))


def format_point(wide: DataFrame) -> DataFrame:
    """``f1=…, mcc=…, roc_auc=…`` skipping NaN."""
    keys = ("f1", "mcc", "roc_auc")
    items = [F.when(~F.isnan(F.col(k)), F.format_string(f"{k}=%.3f", F.col(k))) for k in keys]
    s = F.concat_ws(", ", *items)
    return wide.select("model", F.when(s == "", "(no metrics)").otherwise(s).alias("summary"))


def confusion_table(preds: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys, true, predicted, n) with the fixed label order, zero cells included."""
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t in (0, 1) for p in (0, 1)])
    grid = preds.select(*keys).distinct().select(*keys, F.explode(cells).alias("_c"))
    counts = preds.groupBy(*keys, F.col("y_true").alias("t"), F.col("y_pred").alias("p")).agg(
        F.count("*").alias("n"))
    out = grid.select(*keys, F.col("_c")["t"].alias("t"), F.col("_c")["p"].alias("p")).join(
        counts, [*keys, "t", "p"], "left").fillna(0, ["n"])
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return out.select(*keys, F.element_at(names, F.col("t") + 1).alias("true"),
                      F.element_at(names, F.col("p") + 1).alias("predicted"), F.col("n").cast("long").alias("n"))


def comparison_long(long: DataFrame, metrics: Sequence[str] = COMPARISON_METRICS) -> DataFrame:
    """(model, metric, value) for the comparison metrics; empty input → empty table."""
    return long.where(F.col("metric").isin(list(metrics)))


def error_examples(preds: DataFrame, requests: DataFrame, text_col: str = "request_line", k: int = 5,
                   clip: int = 160) -> DataFrame:
    """First ``k`` false positives / negatives per model (by position) and their totals."""
    err = preds.withColumn("error_type", F.when((F.col("y_pred") == 1) & (F.col("y_true") == 0), "false_positive")
                           .when((F.col("y_pred") == 0) & (F.col("y_true") == 1), "false_negative"))
    err = err.where(F.col("error_type").isNotNull())
    totals = err.groupBy("model", "error_type").agg(F.count("*").alias("n_errors"))
    # rank <= k: Spark keeps k rows per group in each task before the shuffle
    first = Window.partitionBy("model", "error_type").orderBy("pos")
    firsts = err.select("model", "error_type", "pos", F.row_number().over(first).alias("rank")).where(F.col("rank") <= k)
    ex = firsts.join(requests.select("pos", F.substring(F.col(text_col), 1, clip).alias("example")), "pos")
    return ex.join(totals, ["model", "error_type"]).select(
        "model", "error_type", "n_errors", F.col("rank").cast("int").alias("rank"), "pos", "example")


def write_metrics_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """Metrics table rounded to 4 places as CSV."""
    out = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    out.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A report table as JSON lines."""
    df.write.mode("overwrite").json(path)


def run_summary(items: DataFrame, digits: int = 4) -> DataFrame:
    """(key, value) with NaN values dropped and values rounded to 4 places."""
    return items.where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "key", F.round("value", digits).alias("value"))


def roc_overlay(preds: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """ROC points of every model whose test rows hold both classes."""
    from .metrics import roc_points

    both = preds.groupBy(*keys).agg(F.countDistinct("y_true").alias("_k")).where(F.col("_k") == 2).drop("_k")
    return roc_points(preds.join(both, list(keys), "left_semi"), keys)


def best_overall(comparison: DataFrame, metric: str = "f1") -> str | None:
    """T4: the model with the highest ``metric`` (first on ties, by model name)."""
    row = comparison.where(~F.isnan(metric)).orderBy(F.col(metric).desc(), "model").select("model").first()
    return row[0] if row else None


def merge_registries(*tables: DataFrame, key: str = "model") -> DataFrame:
    """Union of per-model report tables; a later table's rows replace an earlier one's."""
    tagged = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(tables)]
    allr = tagged[0]
    for t in tagged[1:]:
        allr = allr.unionByName(t, allowMissingColumns=True)
    last = allr.groupBy(key).agg(F.max("_src").alias("_src"))
    return allr.join(last, [key, "_src"], "left_semi").drop("_src")
