"""Metrics (A17–A22, N3, note C) — FIXTURES §4 cases and brute-force ROC checks."""

import math
import random

import pytest

from reqscope.operators import metrics as M


def _preds(spark, y_true, y_pred, y_score):
    return spark.createDataFrame(list(zip(y_true, y_pred, [float(s) for s in y_score])),
                                 "y_true int, y_pred int, y_score double")


def test_small_case(spark):
    p = _preds(spark, [0, 0, 1, 1], [0, 1, 1, 1], [.1, .4, .35, .8])
    m = M.classification_metrics(p).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (1, 1, 0, 2)
    assert m.precision == pytest.approx(2 / 3) and m.recall == 1.0 and m.f1 == pytest.approx(0.8)
    assert m.fbeta == pytest.approx(10 / 11) and m.mcc == pytest.approx(1 / math.sqrt(3))
    assert m.roc_auc == pytest.approx(0.75) and m.fpr_at_90 == pytest.approx(0.5)


def test_zero_predictions_and_one_class(spark):
    m = M.classification_metrics(_preds(spark, [0, 1, 1], [0, 0, 0], [.1, .2, .3])).first()
    assert m.precision == 0.0 and m.f1 == 0.0 and m.mcc == 0.0
    one = M.classification_metrics(_preds(spark, [1, 1], [1, 0], [.1, .2])).first()
    assert math.isnan(one.roc_auc)


def test_cv_aggregate_finite_only(spark):
    long = spark.createDataFrame([("m", 0, "f1", 0.5), ("m", 1, "f1", float("nan")), ("m", 2, "f1", 0.7)],
                                 "model string, fold int, metric string, value double")
    r = M.aggregate_cv(long).first()
    assert r.mean == pytest.approx(0.6) and r.std == pytest.approx(0.1)


def _roc_reference(y, s):
    """Plain-Python ROC with intermediate-point thinning (collinear points dropped)."""
    order = sorted(range(len(s)), key=lambda i: -s[i])
    fps, tps, thr = [], [], []
    tp = fp = 0
    for k, i in enumerate(order):
        tp += y[i]
        fp += 1 - y[i]
        if k == len(order) - 1 or s[order[k + 1]] != s[i]:
            fps.append(fp), tps.append(tp), thr.append(s[i])
    if len(fps) > 2:
        keep = [0] + [j for j in range(1, len(fps) - 1)
                      if (fps[j + 1] - 2 * fps[j] + fps[j - 1]) or (tps[j + 1] - 2 * tps[j] + tps[j - 1])] \
            + [len(fps) - 1]
        fps, tps, thr = [fps[j] for j in keep], [tps[j] for j in keep], [thr[j] for j in keep]
    P, N = tps[-1], fps[-1]
    return [(float("inf"), 0.0, 0.0)] + [(t, f / N, p / P) for t, f, p in zip(thr, fps, tps)]


def test_roc_matches_reference_rule_and_auc_is_rank_statistic(spark):
    rnd = random.Random(3)
    for case in range(6):
        n = 60
        y = [rnd.randint(0, 1) for _ in range(n)]
        s = [rnd.choice([0.1, 0.2, 0.3, 0.5, 0.8, 0.9]) if case % 2 else rnd.random() for _ in range(n)]
        p = _preds(spark, y, [int(v > .5) for v in s], s)
        got = sorted((r.threshold, round(r.fpr, 12), round(r.tpr, 12)) for r in M.roc_points(p).collect())
        exp = sorted((t, round(f, 12), round(q, 12)) for t, f, q in _roc_reference(y, s))
        assert got == exp
        pos = [s[i] for i in range(n) if y[i]]
        neg = [s[i] for i in range(n) if not y[i]]
        pair = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert M.roc_auc(p).first().roc_auc == pytest.approx(pair)
        fpr90 = min([f for t, f, q in exp if q >= 0.9] or [1.0])
        assert M.fpr_at_tpr(M.roc_points(p)).first().fpr_at_90 == pytest.approx(fpr90)


def test_weighted_prefix_bucketed_equals_single_window(spark):
    from reqscope.operators.ordered import weighted_prefix
    rows = [(g, float(v), v % 5) for g in range(2) for v in range(500)]
    df = spark.createDataFrame(rows, "g int, v double, w long")
    a = {(r.g, r.v, r.cum_w, r.next_w) for r in weighted_prefix(df, ["g"], "v", ["w"], lead_cols=["w"]).collect()}
    b = {(r.g, r.v, r.cum_w, r.next_w) for r in
         weighted_prefix(df, ["g"], "v", ["w"], n_parts=7, lead_cols=["w"]).collect()}
    assert a == b
