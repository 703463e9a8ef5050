"""Linear SVC and perceptron against plain NumPy: weights, gradients, one Adam step, histories."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from reqscope.operators import models as ML
from reqscope.operators import optim as O


@pytest.fixture(scope="module")
def emb(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    return e.select(F.col("vec_id").alias("pos"), (F.col("label") == 0).cast("int").alias("y"), array_to_vector("embedding").alias("features"))


def plain_svc(x, y, c=1.0):
    """Newton's method with a line search, on the whole matrix."""
    x1, s = np.append(x, np.ones((len(x), 1)), 1), np.where(y > 0, 1.0, -1.0)
    w = np.zeros(x1.shape[1])
    f = lambda w: 0.5 * w @ w + c * (np.maximum(1 - s * (x1 @ w), 0) ** 2).sum()
    for _ in range(200):
        slack = 1 - s * (x1 @ w)
        on = slack > 0
        g = w - 2 * c * x1[on].T @ (s * slack)[on]
        if np.linalg.norm(g) < 1e-9:
            break
        step, t = np.linalg.solve(np.eye(len(w)) + 2 * c * x1[on].T @ x1[on], g), 1.0
        while f(w - t * step) > f(w):
            t /= 2
            if t < 1e-12:
                break
        w = w - t * step
    return w


@pytest.mark.parametrize("dense", [512, 0])
def test_svc_weights_equal_a_numpy_solver(emb, dense):
    rows = emb.collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.y for r in rows])
    model = O.SquaredHingeSVC(1.0, 1e-9, dense=dense).fit(emb)
    want = plain_svc(x, y)
    assert np.allclose(np.append(model.weights, model.intercept), want, atol=1e-4)
    got = {r.pos: (r.prediction, vector) for r, vector in ((r, r.rawPrediction.toArray()) for r in model.transform(emb).collect())}
    assert all(got[r.pos][1][1] == pytest.approx(f, abs=1e-3) and got[r.pos][0] == float(got[r.pos][1][1] > 0) for r, f in zip(rows, x @ want[:-1] + want[-1]))


def test_svc_on_sparse_rows(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = np.where(rng.random((120, 30)) < 0.2, rng.normal(size=(120, 30)), 0)
    x[5] = 0
    y = (x[:, :5].sum(1) + 0.1 * rng.normal(size=120) > 0).astype(int)
    rows = [(i, int(y[i]), Vectors.sparse(30, [(j, float(v)) for j, v in enumerate(x[i]) if v])) for i in range(120)]
    df = spark.createDataFrame(rows, ["pos", "y", "features"]).repartition(3)
    for dense in (512, 0):
        model = O.SquaredHingeSVC(1.0, 1e-9, dense=dense).fit(df)
        assert np.allclose(np.append(model.weights, model.intercept), plain_svc(x, y), atol=1e-4)
    assert model.transform(df).columns == ["pos", "y", "prediction", "rawPrediction"]


def test_perceptron_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, hidden = rng.normal(size=(9, 4)), rng.integers(0, 2, 9), 5
    theta = rng.normal(size=4 * hidden + hidden + 2 * hidden + 2)
    keep = (rng.random((9, hidden)) >= 0.3) / 0.7
    _, g = O.gradient(theta, x, y, hidden, keep)
    for k in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert g[k] == pytest.approx((O.gradient(up, x, y, hidden, keep)[0] - O.gradient(down, x, y, hidden, keep)[0]) / 2e-6, abs=1e-5)


def test_one_step_from_fixed_weights(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 2, 40)
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(40)], "pos long, y int, f array<double>").select("pos", "y", array_to_vector("f").alias("features"))
    mlp = O.MiniBatchMlp(hidden=6, dropout=0.0, batch=64, epochs=1, seed=5)
    theta, history = mlp.fit(df, df)
    start = mlp.start(3)
    loss, g = O.gradient(start, x, y, 6)
    g = g / 40
    m, v = 0.1 * g / 0.1, 0.001 * g * g / 0.001
    want = start * (1 - 5e-4 * 1e-4) - 5e-4 * m / (np.sqrt(v) + 1e-8)
    assert np.allclose(theta, want, atol=1e-12)
    assert history[0][1] == pytest.approx(loss / 40) and history[0][2] == pytest.approx(O.gradient(want, x, y, 6)[0] / 40)


def test_sums_of_many_partitions_are_added_in_a_tree(spark):
    rows = spark.range(0, 300, 1, 90)
    one = "n long, loss double, grad binary"

    def sums(batches):
        for b in batches:
            x = b.column("id").to_numpy()
            yield pa.RecordBatch.from_pydict({"n": [len(x)], "loss": [float(x.sum())], "grad": [np.array([x.sum(), 1.0 * len(x)]).tobytes()]})

    n, loss, grad = O._total(rows.mapInArrow(sums, one), one, 90)
    assert (n, loss, grad.tolist()) == (300, 44850.0, [44850.0, 300.0])


def test_perceptron_learns_and_keeps_a_row_an_epoch(emb):
    split = emb.withColumn("u", F.xxhash64("pos") % 4)
    preds, hist = ML.mlp_head(split.where("u <> 0").drop("u"), split.where("u = 0").drop("u"), max_epochs=6)
    rows = hist.orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] and rows[-1].eval_loss < rows[0].eval_loss
    again = ML.mlp_head(split.where("u <> 0").drop("u"), split.where("u = 0").drop("u"), max_epochs=6)[1].orderBy("epoch").collect()
    assert [r.loss for r in again] == pytest.approx([r.loss for r in rows])
    assert preds.columns == ["model", "fold", "pos", "y_true", "y_pred", "y_score"] and preds.where("y_score < 0 or y_score > 1").count() == 0


def test_newton_logistic_is_at_the_optimum_with_rare_features(spark):
    from pyspark.ml.linalg import Vectors

    from reqscope.operators.optim import NewtonLogistic

    rng = np.random.default_rng(4)
    x = np.where(rng.random((200, 60)) < np.geomspace(0.5, 0.006, 60), rng.random((200, 60)), 0.0)  # features of falling frequency
    y = (x[:, 0] + x[:, 30] + 0.3 * rng.normal(size=200) > 0.4).astype(int)
    rows = [(int(t), Vectors.sparse(60, [(j, float(v)) for j, v in enumerate(r) if v])) for t, r in zip(y, x)]
    df = spark.createDataFrame(rows, ["y", "features"])
    model = NewtonLogistic(1.0, 1e-4, 2000).fit(df)
    p = 1 / (1 + np.exp(-(x @ model.weights + model.intercept)))
    grad = np.append(model.weights + x.T @ (p - y), (p - y).sum())
    first = np.append(x.T @ (0.5 - y), (0.5 - y).sum())
    assert model.steps < 20 and np.linalg.norm(grad) <= 1e-4 * np.linalg.norm(first)
    got = model.transform(df).select("prediction", "probability").collect()
    assert np.allclose([r.probability[1] for r in got], p) and [r.prediction for r in got] == (p > 0.5).astype(int).tolist()


def _boosting_rows(spark, n=120, d=4):
    from reqscope.operators.models import vector_frame

    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=n) > 0).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return vector_frame(spark.createDataFrame(rows, "pos long, y int, v array<double>"), "pos", "y", "v").withColumn("fold", F.col("pos").cast("int") % 3)


def test_boosted_trees_equal_mllib(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    from reqscope.operators.boosting import BoostedTrees

    df = _boosting_rows(spark).coalesce(1).cache()
    p1 = lambda m: {r[0]: (r[1], r[2]) for r in m.transform(df).select("pos", "prediction", vector_to_array("probability")[1]).collect()}
    rounds = 12  # scores are brought up to date once
    models = BoostedTrees(rounds).fit_without(df, [0, 1, 2])
    for fold in (0,):
        train = df.where(F.col("fold") != fold).drop("fold")
        want = p1(GBTClassifier(maxIter=rounds, seed=42, labelCol="y").fit(train))
        got, own = p1(models[fold]), p1(BoostedTrees(rounds).fit(train))
        for pos, (label, p) in want.items():
            if pos % 3 == fold:  # ties between splits that part the training rows alike fall by rounding
                continue
            assert got[pos][0] == own[pos][0] == label
            assert abs(got[pos][1] - p) < 1e-9 and abs(own[pos][1] - p) < 1e-9


def test_folds_are_boosted_in_the_same_jobs(spark):
    from reqscope.operators.models import build_classifiers, cross_validate
    from reqscope.operators import models as ML

    df = _boosting_rows(spark, 60).drop("fold").coalesce(1).cache()
    spec = [s for s in build_classifiers() if s.name == "gradient_boosting"]
    rounds, ML.GBT_ROUNDS = ML.GBT_ROUNDS, 3
    jobs = []
    try:
        for k in (2, 4):
            before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
            assert cross_validate(df, spec, folds=k, with_knn=False).count() == 60
            jobs.append(spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before)
    finally:
        ML.GBT_ROUNDS = rounds
    assert jobs[1] < 1.5 * jobs[0]
