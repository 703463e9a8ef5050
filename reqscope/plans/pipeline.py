"""End-to-end runs (the reference's ``run()``, notebook path and dedup path).

``run_pipeline`` chains the operators over a dump bundle: load → features and
quality → BPE vocabulary → n-gram LM → embeddings → models and detectors on one
shared holdout → metrics and report tables.  Every intermediate is a lazy
DataFrame; the few reused ones are checkpointed into the cluster's shared
checkpoint folder (lineage cut that survives executor loss).

``write_event_dumps`` derives three raw dumps from the ``events`` table so the
file path (S1–S6) runs on driver data.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import request as rq
from ..functions.features import NUMERIC_FEATURES, feature_frame
from ..operators import bpe, lm
from ..operators import embed as E
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import quality as qa
from ..operators import report as RP
from ..operators import splits as sp
from ..operators.correlation import correlation
from ..operators.distribution import feature_histograms
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import views
from ..sources.dumps import CSIC_FILES, load_bundle, tokenizer_corpus

EVENT_CUT = "2024-01-16 00:00:00"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/reqscope-{name}-{uuid.uuid4().hex[:12]}"


def write_event_dumps(spark: SparkSession, sf_dir: str, out_dir: str, parts: int = 4) -> str:
    """Three dumps from ``events``: older normal traffic (training), newer normal
    traffic (test) and error events (anomalous); requests in event order, each
    followed by a blank separator line, after two lines that belong to no request.
    Every dump is a directory of part files written in ranges of its *lines*, so
    parts may begin in the middle of a request.
    """
    ev = views.req_events(spark, sf_dir).join(
        views.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "ts"), "pos")
    role = (F.when(F.col("label") == 1, F.lit(CSIC_FILES[2][0]))
            .when(F.col("ts") < F.lit(EVENT_CUT).cast("timestamp_ntz"), F.lit(CSIC_FILES[0][0]))
            .otherwise(F.lit(CSIC_FILES[1][0])))
    lines = ev.select(role.alias("role"), "pos", F.posexplode(F.split(F.concat("raw", F.lit("\n")), "\n")).alias("i", "value"))
    for name, _label, _split in CSIC_FILES:
        junk = spark.createDataFrame([(name, -1, 0, "# dump"), (name, -1, 1, "X-Junk: 1")], "role string, pos long, i int, value string")
        mine = lines.where(F.col("role") == name).unionByName(junk).withColumn("at", F.col("pos") * 3 + F.col("i"))
        (mine.repartitionByRange(parts, "at").sortWithinPartitions("at").select("value")
         .write.mode("overwrite").text(f"{out_dir.rstrip('/')}/{name}"))
    return out_dir


@dataclass
class PipelineConfig:
    seed: int = 42
    subset_fraction: float | None = None
    vocab_size: int = 30_000
    min_frequency: int = 2
    max_length: int = 512
    embedding_dim: int = 64
    test_size: float = 0.3
    cv_folds: int = 5
    run_cv: bool = True
    first_line_only: bool = False


def run_pipeline(spark: SparkSession, raw_dir: str, out_dir: str | None = None,
                 config: PipelineConfig | None = None) -> dict[str, DataFrame]:
    """Entry point 1: the whole method from raw dumps to report tables."""
    cfg = config or PipelineConfig()
    bundle = rq.with_request_text(load_bundle(spark, raw_dir, subset_fraction=cfg.subset_fraction,
                                              subset_seed=cfg.seed), cfg.first_line_only)
    bundle = cut_lineage(bundle)
    lm_train = bundle.where(F.col("split") == "lm_train")
    inference = bundle.where(F.col("split") == "inference")
    out: dict[str, DataFrame] = {}

    # exploratory path (entry point 2)
    feats = feature_frame(inference, keep=("pos",))
    out["class_balance"] = qa.class_balance(inference)
    out["method_crosstab"] = qa.crosstab(inference, "method")
    columns = [c for c in feats.columns if c != "pos"]
    keyed = feature_frame(inference, keep=("pos", "text", "request_line"))
    out["duplicates"] = qa.duplicate_levels_of(keyed, {"raw_text": "text", "request_line": "request_line", "feature_fingerprint": columns})
    out["describe"] = qa.describe(feats, list(NUMERIC_FEATURES), (0.5, 0.9, 0.99))
    out["describe_text"] = qa.describe_text(feats, ["method"])
    out["missing"] = qa.missing_values(feats, columns)
    out["constant"] = qa.constant_columns(feats, columns)
    out["duplicate_rows"] = qa.duplicate_rows(feats, columns)
    out["duplicate_columns"] = qa.duplicate_columns(feats, columns)
    out["correlation"] = correlation(feats, [*NUMERIC_FEATURES, "label"], "spearman")
    out["distributions"] = feature_histograms(feats, list(NUMERIC_FEATURES), "label")

    # tokenizer on all traffic, language model on normal traffic
    corpus = tokenizer_corpus(bundle).select(F.explode("lines").alias("line"))
    vocab = bpe.train_bpe(corpus, "line", vocab_size=cfg.vocab_size, min_frequency=cfg.min_frequency)
    out["bpe_merges"] = vocab.merges_df(spark)
    val = sp.validation_split(lm_train.select("pos"), 0.05, cfg.seed)
    lm_rows = lm_train.join(val, "pos").select("pos", "text", F.when(F.col("is_val"), "val")
                                                .otherwise("train").alias("split"))
    ngram = lm.NgramLM().fit(lm_rows.where(F.col("split") == "train"), "pos", "text")
    lm_scores = ngram.score(lm_rows, "pos", "text", keep=("split",))
    out["lm_perplexity"] = lm.split_perplexity(lm_scores, "split")

    # embeddings of the learned tokens (E6, fitted on normal training lines), both views in one pass
    embedder = E.BpeLineEmbedder(vocab, cfg.max_length, dim=cfg.embedding_dim, seed=cfg.seed).fit(E.request_lines(lm_train))
    keyed_rows = bundle.select(F.struct("split", "pos", "label").alias("key"), "lines")
    emb = cut_lineage(E.embed_requests(keyed_rows, embedder, cfg.embedding_dim, id_col="key"))
    emb = emb.select("key.split", "key.pos", F.col("key.label").alias("y"), "embedding")
    emb_inf, emb_lm = (emb.where(F.col("split") == x).drop("split") for x in ("inference", "lm_train"))
    frame = ML.vector_frame(emb_inf, "pos", "y", "embedding")

    # models on one shared holdout (M11, M13, M9) and CV
    split = sp.holdout_split(frame, "y", "pos", cfg.test_size, cfg.seed).cache()
    train, test = split.where(sp.is_train()).drop("split"), split.where(sp.is_test()).drop("split")
    preds = [ML.holdout_predictions(frame, seed=cfg.seed, test_size=cfg.test_size)]
    normal_frame = ML.vector_frame(emb_lm, "pos", "y", "embedding")
    preds.append(ML.anomaly_predictions(frame, normal_frame, test, cfg.seed))
    # The detectors on the whole inference set
    out["detectors"] = M.classification_metrics(ML.anomaly_predictions(frame, normal_frame, frame, cfg.seed, with_lof=False), ["model"])
    mlp_preds, history = ML.mlp_head(train, test, cfg.seed)
    preds.append(mlp_preds)
    preds.append(ML.descriptive_baseline(feats, list(NUMERIC_FEATURES), cfg.seed))
    preds.append(ML.lexical_baseline(inference, "raw", cfg.seed))
    all_preds = cut_lineage(ML._union(preds))
    wide = M.classification_metrics(all_preds, ["model"])
    long = M.metrics_long(wide, ["model"])
    out["predictions"] = all_preds
    out["metrics"] = long
    out["comparison"] = RP.comparison_frame(long)
    out["confusion"] = RP.confusion_table(all_preds)
    out["roc"] = M.roc_points(all_preds, ["model"])
    out["errors"] = RP.error_examples(all_preds, inference, "request_line", k=5)
    out["learning_curve"] = lm.normalize_history(history)
    if cfg.run_cv:
        out["cv"] = cut_lineage(ML.cv_summary(ML.cross_validate(frame, folds=cfg.cv_folds, seed=cfg.seed)))
        # Best mean F1 over folds; its refit on the training side of the holdout is among the predictions
        best = ML.best_model(out["cv"], [s.name for s in ML.build_classifiers(cfg.seed)] + ["knn"])
        out["best"] = wide.where(F.col("model") == best)

    # leakage and de-duplicated re-evaluation (entry point 3)
    first = inference.select("pos", F.col("request_line").alias("key"))
    hold = sp.holdout_split(inference.select("pos", F.col("label").alias("y"), "request_line"),
                            "y", "pos", cfg.test_size, cfg.seed)
    out["leakage_holdout"] = qa.train_test_leakage(hold.where(sp.is_train()), hold.where(sp.is_test()),
                                                   "request_line")
    out["leakage_cross"] = qa.train_test_leakage(lm_train, inference, "text")
    dedup = ML.dedup_reevaluate(frame, first, "logistic_regression", cfg.seed)
    full = all_preds.where(F.col("model") == "logistic_regression")
    out["dedup_delta"] = M.metric_delta(M.classification_metrics(full), M.classification_metrics(dedup))

    # One line per headline, and the record of the run
    points = RP.format_point(wide).unionByName(RP.format_point(out["detectors"].withColumn("model", F.concat("model", F.lit("_all")))))
    out["summary"] = points if "cv" not in out else points.unionByName(
        RP.format_cv(out["cv"]).withColumn("model", F.concat(F.lit("cv_"), "model")))
    settings = [("config." + k, str(v)) for k, v in vars(cfg).items()]
    record = spark.createDataFrame(settings, "key string, value string")
    record = record.unionByName(long.where(~F.isnan("value")).select(F.concat_ws(".", F.lit("metric"), "model", "metric").alias("key"), F.round("value", 4).cast("string").alias("value")))
    record = record.unionByName(out["class_balance"].select(F.concat(F.lit("class."), F.col("label").cast("string")).alias("key"), F.col("n").cast("string").alias("value")))
    record = record.unionByName(out["duplicates"].select(F.concat(F.lit("duplicate_rate."), "level").alias("key"), F.round("duplicate_rate", 4).cast("string").alias("value")))
    for name in ("leakage_holdout", "leakage_cross"):
        record = record.unionByName(out[name].select(F.lit(name).alias("key"), F.round("leakage_rate", 4).cast("string").alias("value")))
    record = record.unionByName(out["dedup_delta"].where(~F.isnan("delta")).select(F.concat(F.lit("dedup_delta."), "metric").alias("key"), F.round("delta", 4).cast("string").alias("value")))
    if "best" in out:
        record = record.unionByName(out["best"].select(F.lit("best_model").alias("key"), F.col("model").alias("value")))
    out["record"] = record

    if out_dir:
        for name in ("comparison", "metrics", "confusion", "roc", "cv"):
            if name in out:
                RP.write_metrics_csv(out[name], os.path.join(out_dir, name))
        for name in ("errors", "duplicates", "leakage_holdout", "leakage_cross", "dedup_delta", "class_balance", "summary", "record"):
            RP.write_json(out[name], os.path.join(out_dir, name))
    return out
