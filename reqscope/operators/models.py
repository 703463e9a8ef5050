"""Models and evaluation (M1–M17) on MLlib.

Every model turns a frame ``(pos, y, features)`` into predictions
``(model, fold, pos, y_true, y_pred, y_score)`` — higher score = more
anomalous — so all models are scored by one aggregation
(``metrics.classification_metrics`` keyed by model and fold).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from . import splits as sp

PRED_COLS = ("model", "fold", "pos", "y_true", "y_pred", "y_score")

# Fixed values that must equal the reference's defaults (scikit-learn's tol=1e-4
# for the linear models).
LR_MAX_ITER = 2000
LR_C = 1.0
LINEAR_TOL = 1e-4
PARALLELISM = 8
RF_TREES = 100
SVC_C = 1.0
SVC_MAX_ITER = 5000
GBT_ROUNDS = 100
KNN_K = 15
LOF_K = 20
IF_TREES = 100
MLP_HIDDEN = 256
MLP_MAX_EPOCHS = 40
MLP_PATIENCE = 8
MLP_VAL_FRACTION = 0.15


@dataclass
class ModelSpec:
    """M1: a named estimator; ``score`` reads the anomaly score from its output."""
    name: str
    make: Callable[[int], object]
    score: Callable[[], object]
    standardize: bool = True


def _prob1():
    return vector_to_array(F.col("probability"))[1]


def _raw1():
    return vector_to_array(F.col("rawPrediction"))[1]


def build_classifiers(seed: int = 42) -> list[ModelSpec]:
    """M2–M5 (M6 KNN is handled by the neighbour join)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    from .boosting import BoostedTrees
    from .optim import SquaredHingeSVC

    return [
        # L2 with C = 1 as the reference's default: C·Σloss + ½‖w‖² ≡ mean loss + ½‖w‖²/(C·n)
        ModelSpec("logistic_regression", lambda n: LogisticRegression(
            maxIter=LR_MAX_ITER, tol=LINEAR_TOL, regParam=1.0 / (LR_C * max(n, 1)), elasticNetParam=0.0,
            standardization=False, labelCol="y"), _prob1),
        ModelSpec("random_forest", lambda n: RandomForestClassifier(numTrees=RF_TREES, seed=seed, labelCol="y"),
                  _prob1, standardize=False),
        # scaling is explicit (E8) as in the reference; no hidden re-standardisation
        ModelSpec("linear_svc", lambda n: SquaredHingeSVC(SVC_C, LINEAR_TOL, SVC_MAX_ITER), _raw1),
        ModelSpec("gradient_boosting", lambda n: BoostedTrees(GBT_ROUNDS, seed),
                  _prob1, standardize=False),
    ]


def vector_frame(df: DataFrame, pos: str, y: str, vec: str) -> DataFrame:
    """(pos, y, features) with ``features`` an MLlib vector."""
    return df.select(F.col(pos).cast("long").alias("pos"), F.col(y).cast("int").alias("y"),
                     array_to_vector(F.col(vec)).alias("features"))


def _scaled(train: DataFrame, test: DataFrame):
    from pyspark.ml.feature import StandardScaler

    model = StandardScaler(inputCol="features", outputCol="_s", withMean=True, withStd=True).fit(train)
    fix = lambda d: model.transform(d).drop("features").withColumnRenamed("_s", "features")
    return fix(train), fix(test)


def fit_predict(spec: ModelSpec, train: DataFrame, test: DataFrame, fold: int = -1) -> DataFrame:
    tr, te = _scaled(train, test) if spec.standardize else (train, test)
    return _predictions(spec, spec.make(tr.count()).fit(tr), te, fold)


def _predictions(spec: ModelSpec, model, te: DataFrame, fold: int) -> DataFrame:
    out = model.transform(te)
    return out.select(F.lit(spec.name).alias("model"), F.lit(fold).alias("fold"), "pos",
                      F.col("y").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                      spec.score().cast("double").alias("y_score"))


def fit_predict_folds(spec: ModelSpec, folded: DataFrame, k: int) -> DataFrame:
    """``fit_predict`` for every fold, by an estimator that fits the models of all folds together."""
    models = spec.make(folded.count()).fit_without(folded, list(range(k)))
    return _union([_predictions(spec, m, folded.where(F.col("fold") == f).drop("fold"), f) for f, m in enumerate(models)])


def knn_predict(train: DataFrame, test: DataFrame, k: int = KNN_K, fold: int = -1) -> DataFrame:
    """M6 on standardised vectors: score = anomalous share of the k nearest training rows."""
    from .neighbors import knn, knn_scores

    tr, te = _scaled(train, test)
    tr = tr.select("pos", "y", vector_to_array("features").alias("vec"))
    te = te.select("pos", "y", vector_to_array("features").alias("vec"))
    nn = knn(te, tr, k, qid="pos", rid="pos", vec="vec")
    sc = knn_scores(nn, tr.select(F.col("pos").alias("id"), "y"), "y")
    return te.join(sc.withColumnRenamed("qid", "pos"), "pos").select(
        F.lit("knn").alias("model"), F.lit(fold).alias("fold"), "pos", F.col("y").alias("y_true"),
        "y_pred", "y_score")


def _run_parallel(tasks, parallelism: int = PARALLELISM) -> list[DataFrame]:
    """Fit independent models concurrently (Spark schedules the jobs side by side),
    as ``CrossValidator(parallelism=...)`` does."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(lambda t: t(), tasks))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for p in frames[1:]:
        out = out.unionByName(p)
    return out


def holdout_predictions(frame: DataFrame, specs: Sequence[ModelSpec] | None = None, with_knn: bool = True,
                        seed: int = 42, test_size: float = 0.3) -> DataFrame:
    """Every model fitted on the shared training split and scored on the shared test split."""
    split = sp.holdout_split(frame, "y", "pos", test_size, seed).cache()
    train, test = split.where(sp.is_train()).drop("split"), split.where(sp.is_test()).drop("split")
    tasks = [(lambda s=s: fit_predict(s, train, test).cache())
             for s in (specs if specs is not None else build_classifiers(seed))]
    if with_knn:
        tasks.append(lambda: knn_predict(train, test))
    return _union(_run_parallel(tasks))


def cross_validate(frame: DataFrame, specs: Sequence[ModelSpec] | None = None, folds: int = 5,
                   seed: int = 42, with_knn: bool = True) -> DataFrame:
    """Stratified k-fold predictions for every model (fold column = held-out fold)."""
    counts = sp.class_counts(frame, "y")
    k = sp.safe_folds(counts, folds)
    folded = sp.kfold(frame, k, "y", "pos", seed).cache()
    specs = list(specs if specs is not None else build_classifiers(seed))
    together = [s for s in specs if not s.standardize and hasattr(s.make(1), "fit_without")]
    tasks = [lambda s=s: fit_predict_folds(s, folded, k).cache() for s in together]
    specs = [s for s in specs if s not in together]
    for f in range(k):
        tr = folded.where(F.col("fold") != f).drop("fold")
        te = folded.where(F.col("fold") == f).drop("fold")
        tasks += [(lambda s=s, tr=tr, te=te, f=f: fit_predict(s, tr, te, f).cache()) for s in specs]
        if with_knn:
            tasks.append(lambda tr=tr, te=te, f=f: knn_predict(tr, te, fold=f))
    return _union(_run_parallel(tasks))


def cv_summary(cv_preds: DataFrame) -> DataFrame:
    """(model, metric, mean, std) over folds (A22) from fold-level metrics (one aggregation)."""
    wide = M.classification_metrics(cv_preds, ["model", "fold"])
    return M.aggregate_cv(M.metrics_long(wide, ["model", "fold"]), ["model"])


def best_model(summary: DataFrame, order: Sequence[str]) -> str:
    """Highest mean F1 (missing = -inf); the first in ``order`` wins ties."""
    rows = {r.model: r.mean for r in summary.where(F.col("metric") == "f1").collect()}
    best, best_v = None, float("-inf")
    for name in order:
        v = rows.get(name, float("-inf"))
        v = float("-inf") if v is None else v
        if best is None or v > best_v:
            best, best_v = name, v
    return best


def anomaly_predictions(frame: DataFrame, normal_train: DataFrame, test: DataFrame, seed: int = 42,
                        with_lof: bool = True) -> DataFrame:
    """Isolation forest and LOF fitted on normal-only rows, scored on ``test``."""
    from .iforest import IsolationForest
    from .neighbors import lof

    tr, te = _scaled(normal_train, test)
    tr = tr.select("pos", "y", vector_to_array("features").alias("vec"))
    te = te.select("pos", "y", vector_to_array("features").alias("vec"))
    forest = IsolationForest(n_trees=IF_TREES, seed=seed).fit(tr, "pos", "vec")
    ifp = forest.score(te, "vec").select(F.lit("isolation_forest").alias("model"), F.lit(-1).alias("fold"),
                                         "pos", F.col("y").alias("y_true"), "y_pred", "y_score")
    if not with_lof:
        return ifp
    lf = lof(te, tr, LOF_K, "vec", qid="pos", rid="pos")
    lofp = te.join(lf.withColumnRenamed("qid", "pos"), "pos").select(
        F.lit("local_outlier_factor").alias("model"), F.lit(-1).alias("fold"), "pos", F.col("y").alias("y_true"),
        (F.col("lof") > 1.5).cast("int").alias("y_pred"), F.col("lof").alias("y_score"))
    return ifp.unionByName(lofp)


def mlp_head(train: DataFrame, test: DataFrame, seed: int = 42, max_epochs: int = MLP_MAX_EPOCHS,
             patience: int = MLP_PATIENCE):
    """M9: [d, 256, 2] perceptron by mini-batch Adam with dropout and weight decay, early stop on
    the loss of a validation part (``optim.MiniBatchMlp``).

    Returns (predictions, history) — history rows (run, epoch, loss, eval_loss).
    """
    from .optim import MiniBatchMlp

    tr, te = _scaled(train, test)
    val_flag = sp.holdout_split(tr, "y", "pos", MLP_VAL_FRACTION, seed)
    mlp = MiniBatchMlp(MLP_HIDDEN, epochs=max_epochs, patience=patience, seed=seed)
    theta, history = mlp.fit(val_flag.where(sp.is_train()).drop("split"), val_flag.where(sp.is_test()).drop("split"))
    preds = mlp.predict(theta, te, ["pos", "y"]).select(
        F.lit("mlp_head").alias("model"), F.lit(-1).alias("fold"), "pos", F.col("y").alias("y_true"),
        (F.col("p1") > 0.5).cast("int").alias("y_pred"), F.col("p1").alias("y_score"))
    hist = train.sparkSession.createDataFrame([("mlp_head", float(e), float(a), float(b)) for e, a, b in history],
                                              "run string, epoch double, loss double, eval_loss double")
    return preds, hist


def descriptive_frame(features: DataFrame, numeric: Sequence[str]):
    """M14 inputs: method one-hot (unknown kept) + the numeric descriptive features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    pipe = Pipeline(stages=[
        StringIndexer(inputCol="method", outputCol="_mi", handleInvalid="keep"),
        OneHotEncoder(inputCol="_mi", outputCol="_mv", handleInvalid="keep"),
        VectorAssembler(inputCols=["_mv", *numeric], outputCol="features"),
    ])
    return pipe


def descriptive_baseline(features: DataFrame, numeric: Sequence[str], seed: int = 42) -> DataFrame:
    """Classic models on the 15 descriptive features, shared holdout."""
    pipe = descriptive_frame(features, numeric)
    base = features.select(F.col("pos").cast("long").alias("pos"), F.col("label").cast("int").alias("y"),
                           "method", *[F.col(c).cast("double").alias(c) for c in numeric])
    split = sp.holdout_split(base, "y", "pos", 0.3, seed).cache()
    train, test = split.where(sp.is_train()), split.where(sp.is_test())
    fitted = pipe.fit(train)
    tr = fitted.transform(train).select("pos", "y", "features")
    te = fitted.transform(test).select("pos", "y", "features")
    specs = [s for s in build_classifiers(seed) if s.name in ("logistic_regression", "random_forest")]
    preds = [fit_predict(s, tr, te) for s in specs]
    out = preds[0].unionByName(preds[1])
    return out.withColumn("model", F.concat(F.lit("descriptive_"), F.col("model")))


def lexical_baseline(requests: DataFrame, text_col: str = "raw", seed: int = 42, num_features: int | None = None) -> DataFrame:
    """Char n-gram TF-IDF (exact n-grams, fitted on train) + linear models, shared holdout.

    Texts are dealt to all cores, as n-grams and every pass of the models are work of the tasks."""
    from .lm import tfidf_features
    from .optim import NewtonLogistic

    base = requests.select(F.col("pos").cast("long").alias("pos"), F.col("label").cast("int").alias("y"),
                           F.col(text_col).alias("_text"))
    cores = requests.sparkSession.sparkContext.defaultParallelism
    split = sp.holdout_split(base, "y", "pos", 0.3, seed).repartition(cores, "pos").cache()
    staged, pipe = tfidf_features(split, "_text", num_features=num_features)
    train, test = staged.where(sp.is_train()), staged.where(sp.is_test())
    fitted = pipe.fit(train)
    tr = fitted.transform(train).select("pos", "y", "features")
    te = fitted.transform(test).select("pos", "y", "features")
    tr, te = tr.cache(), te.cache()
    specs = [s for s in build_classifiers(seed) if s.name in ("logistic_regression", "linear_svc")]
    make = {"logistic_regression": lambda n: NewtonLogistic(LR_C, LINEAR_TOL, LR_MAX_ITER)}
    preds = [fit_predict(ModelSpec(s.name, make.get(s.name, s.make), s.score, standardize=False), tr, te) for s in specs]
    out = preds[0].unionByName(preds[1])
    return out.withColumn("model", F.concat(F.lit("lexical_"), F.col("model")))


def dedup_reevaluate(frame: DataFrame, keys: DataFrame | None = None, model_name: str = "logistic_regression",
                     seed: int = 42, texts: DataFrame | None = None) -> DataFrame:
    """Keep the first row of each distinct key (N1), re-split (X2), refit, score.

    ``keys``: (pos, key); without it the key is the full text, given as ``texts`` (pos, text)."""
    from .quality import unique_first

    if keys is None:
        if texts is None:
            raise ValueError("give keys, or texts to de-duplicate on the full text")
        keys = texts.select("pos", F.md5(F.col("text").cast("binary")).alias("key"))
    keyed = frame.join(keys, "pos")
    dedup = unique_first(keyed, "key").drop("key")
    spec = [s for s in build_classifiers(seed) if s.name == model_name][0]
    split = sp.holdout_split(dedup, "y", "pos", 0.3, seed).cache()
    train, test = split.where(sp.is_train()).drop("split"), split.where(sp.is_test()).drop("split")
    return fit_predict(spec, train, test).withColumn("model", F.lit(f"{model_name}_dedup"))


def save_model(model, path: str) -> None:
    """Persist a fitted MLlib model (overwrite)."""
    model.write().overwrite().save(path)


def load_model(cls, path: str):
    """Reload a model saved with ``save_model`` (``cls`` = the model class)."""
    return cls.load(path)


def save_history(history: DataFrame, path: str) -> None:
    """The training log as a Parquet table."""
    history.write.mode("overwrite").parquet(path)
