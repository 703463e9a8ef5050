"""Classification metrics over a predictions table (A17–A25, N3, note C).

Predictions: ``(keys..., y_true int, y_pred int, y_score double)`` where keys
are e.g. ``model`` and ``fold``; every metric for every model comes out of one
aggregation.  The positive class is the anomaly (label 1) unless
``positive_label`` says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import join_keys, weighted_prefix

# Fixed values that must equal the reference: metric names and order.
THRESHOLD_METRICS = ("accuracy", "precision", "recall", "f1", "fbeta", "mcc")
COUNT_METRICS = ("tn", "fp", "fn", "tp")
COMPARISON_METRICS = ("f1", "fbeta", "mcc", "roc_auc", "precision", "recall", "accuracy",
                      "fpr_at_90", "fpr_at_99")
TPR_TARGETS = {"fpr_at_90": 0.90, "fpr_at_99": 0.99}


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0.0 on zero division (scikit-learn ``zero_division=0``)."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def confusion(preds: DataFrame, keys: Sequence[str] = (), positive_label: int = 1) -> DataFrame:
    """Tn, fp, fn, tp per key (label order fixed: negative, positive)."""
    t = F.col("y_true") == positive_label
    p = F.col("y_pred") == positive_label
    grp = preds.groupBy(*keys) if keys else preds.groupBy()
    return grp.agg(
        F.count_if(~t & ~p).cast("long").alias("tn"), F.count_if(~t & p).cast("long").alias("fp"),
        F.count_if(t & ~p).cast("long").alias("fn"), F.count_if(t & p).cast("long").alias("tp"))


def threshold_metrics(counts: DataFrame, beta: float = 2.0) -> DataFrame:
    """A18/A19 from confusion counts: accuracy, precision, recall, f1, fbeta, mcc."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNT_METRICS)
    b2 = beta * beta
    denom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(
        "*",
        _div0(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _div0((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("fbeta"),
        F.when(denom > 0, (tp * tn - fp * fn) / denom).otherwise(F.lit(0.0)).alias("mcc"),
    )


def _score_groups(preds: DataFrame, keys: Sequence[str], positive_label: int) -> DataFrame:
    pos = (F.col("y_true") == positive_label).cast("long")
    return preds.groupBy(*keys, "y_score").agg(F.sum(pos).alias("tp_inc"),
                                               F.sum(1 - pos).alias("fp_inc"))


def roc_curve(preds: DataFrame, keys: Sequence[str] = (), positive_label: int = 1) -> DataFrame:
    """Score groups in falling order: (keys, y_score, tp_inc, fp_inc, running sums, next group,
    class totals ``_P`` and ``_N``).  Everything about a ROC derives from this one pass."""
    g = _score_groups(preds, keys, positive_label)
    c = weighted_prefix(g, keys, "y_score", ["tp_inc", "fp_inc"], descending=True, lead_cols=["tp_inc", "fp_inc"])
    if keys:
        return join_keys(c, c.groupBy(*keys).agg(F.sum("tp_inc").alias("_P"), F.sum("fp_inc").alias("_N")), keys)
    total = c.agg(F.sum("tp_inc"), F.sum("fp_inc")).first()  # two numbers, inlined
    return c.select("*", F.lit(int(total[0] or 0)).alias("_P"), F.lit(int(total[1] or 0)).alias("_N"))


def _rate(num: Column, den: Column) -> Column:
    """NaN when the class is absent (as the ROC of one class)."""
    return F.when(den > 0, num / den).otherwise(F.lit(float("nan")))


def roc_summary(curve: DataFrame, keys: Sequence[str] = (), targets: dict | None = None) -> DataFrame:
    """A20/A21 from one curve: roc_auc (NaN when only one class is present) and the smallest
    FPR at each target TPR (1.0 when never reached)."""
    targets = TPR_TARGETS if targets is None else targets
    fpr, tpr = _rate(F.col("cum_fp_inc"), F.col("_N")), _rate(F.col("cum_tp_inc"), F.col("_P"))
    agg = curve.groupBy(*keys).agg(
        F.sum(F.col("fp_inc") * (F.col("cum_tp_inc") - F.col("tp_inc") / 2.0)).alias("_a"),
        F.sum("tp_inc").alias("_p"), F.sum("fp_inc").alias("_n"),
        *[F.coalesce(F.min(F.when(tpr >= t, fpr)), F.lit(1.0)).alias(name) for name, t in targets.items()])
    return agg.select(*keys, F.when(F.col("_p") * F.col("_n") > 0, F.try_divide(F.col("_a"), F.col("_p") * F.col("_n")))
                      .otherwise(F.lit(float("nan"))).alias("roc_auc"), *targets)


def roc_auc(preds: DataFrame, keys: Sequence[str] = (), positive_label: int = 1) -> DataFrame:
    """Trapezoidal ROC-AUC per key; ties of the score share one trapezoid."""
    return roc_summary(roc_curve(preds, keys, positive_label), keys, {})


def roc_points(preds: DataFrame, keys: Sequence[str] = (), positive_label: int = 1,
               drop_intermediate: bool = True) -> DataFrame:
    """ROC points (keys, threshold, fpr, tpr) with the (0,0) prefix.

    With ``drop_intermediate`` a point that is neither first nor last is dropped
    when its (Δfp, Δtp) equals the next point's (note C).
    """
    c = roc_curve(preds, keys, positive_label)
    first = F.col("cum_tp_inc") + F.col("cum_fp_inc") == F.col("tp_inc") + F.col("fp_inc")
    keep = F.lit(True)
    if drop_intermediate:
        last = F.col("next_tp_inc").isNull()
        same = (F.col("next_tp_inc") == F.col("tp_inc")) & (F.col("next_fp_inc") == F.col("fp_inc"))
        keep = first | last | ~same
    point = F.struct(F.col("y_score").cast("double").alias("threshold"), _rate(F.col("cum_fp_inc"), F.col("_N")).alias("fpr"),
                     _rate(F.col("cum_tp_inc"), F.col("_P")).alias("tpr"))
    origin = F.struct(F.lit(float("inf")).alias("threshold"), _rate(F.lit(0.0), F.col("_N")).alias("fpr"),
                      _rate(F.lit(0.0), F.col("_P")).alias("tpr"))
    pts = F.filter(F.array(F.when(first, origin), F.when(keep, point)), lambda p: p.isNotNull())
    return c.select(*keys, F.explode(pts).alias("_p")).select(*keys, "_p.threshold", "_p.fpr", "_p.tpr")


def fpr_at_tpr(points: DataFrame, keys: Sequence[str] = (), targets: dict | None = None) -> DataFrame:
    """Smallest FPR among ROC points with TPR >= target; 1.0 when never reached."""
    targets = targets or TPR_TARGETS
    grp = points.groupBy(*keys) if keys else points.groupBy()
    return grp.agg(*[F.coalesce(F.min(F.when(F.col("tpr") >= t, F.col("fpr"))), F.lit(1.0)).alias(name)
                     for name, t in targets.items()])


def classification_metrics(preds: DataFrame, keys: Sequence[str] = (), positive_label: int = 1,
                           beta: float = 2.0, with_score: bool = True) -> DataFrame:
    """Wide table of all metrics per key (one confusion aggregation, one ROC pass)."""
    no_keys = not keys
    if no_keys:
        preds, keys = preds.withColumn("_all", F.lit(0)), ["_all"]
    m = threshold_metrics(confusion(preds, keys, positive_label), beta)
    if with_score:
        m = join_keys(m, roc_summary(roc_curve(preds, keys, positive_label), keys), list(keys))
    return m.drop("_all") if no_keys else m


def metrics_long(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, value) from the wide metrics table."""
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ])).alias("_m")).select(*keys, "_m.metric", "_m.value")


def aggregate_cv(long: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population std per (keys, metric) over finite values only (W6), by name."""
    v = F.col("value")
    finite = long.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (finite.groupBy(*keys, "metric")
            .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
            .orderBy(*keys, "metric"))


def metric_delta(a: DataFrame, b: DataFrame, metrics=("f1", "mcc", "fpr_at_99")) -> DataFrame:
    """(metric, value_full, value_dedup, delta = dedup − full) from two one-row wide tables."""
    la = metrics_long(a.select(*metrics)).withColumnRenamed("value", "value_full")
    lb = metrics_long(b.select(*metrics)).withColumnRenamed("value", "value_dedup")
    return la.join(lb, "metric").withColumn("delta", F.col("value_dedup") - F.col("value_full"))
