"""Queries for embeddings, neighbours, detectors, models and report tables (E, J8, M, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import request as rq
from ..functions.features import NUMERIC_FEATURES, feature_frame
from ..operators import embed as E
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import neighbors as NB
from ..operators import report as RP
from ..operators import splits as sp
from ..operators.iforest import IsolationForest
from ..session import cut_lineage
from ..sources import views
from .queries import register, rounded, sql_round
from .queries_ml import _SCORED, _auc_sql, _part_fix, _roc_sql, _thr_sql

SEED = 42


def _emb(spark, sf):
    """Embeddings with the anomaly label: y = 1 for label 0."""
    return views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("pos"), "embedding", "label", (F.col("label") == 0).cast("int").alias("y"))


# ------------------------------------------------------------------ E2, E4, E9, E10

def _tokens(spark, sf):
    """Each embedding as a token vector of its label's text; every third is masked out."""
    return views.table(spark, sf, "embeddings").select(
        "label", F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))


@register("pool_mean", """
select label, list(round(v, 4) order by i) as mean_vec from (
  select label, i, avg(embedding[i]::double) as v
  from (select label, embedding, generate_subscripts(embedding, 1) as i from embeddings where vec_id % 3 <> 0)
  group by label, i) group by label""")
def q_pool_mean(spark, sf):
    """Masked mean of token vectors."""
    return E.pool_tokens(_tokens(spark, sf), "label").select(
        "label", F.transform("vec", lambda x: F.round(x.cast("double"), 4)).alias("mean_vec"))


@register("pool_cls", """
select label, list_transform(arg_min(embedding, vec_id), lambda x: round(x::double, 4)) as cls_vec from embeddings group by label""")
def q_pool_cls(spark, sf):
    """The first token's vector."""
    return E.pool_tokens(_tokens(spark, sf), "label", mode="cls").select(
        "label", F.transform("vec", lambda x: F.round(x.cast("double"), 4)).alias("cls_vec"))


@register("request_embedding")
def q_request_embedding(spark, sf):
    """E2 + E6: Word2Vec on normal page-request lines; request = mean of distinct-line vectors."""
    req = rq.with_request_text(views.page_requests(spark, sf))
    normal_lines = E.request_lines(req.where(F.col("label") == 0))
    embedder = E.Word2VecLineEmbedder(dim=64, seed=SEED).fit(normal_lines)
    return E.embed_requests(req, embedder, 64)


@register("pca_variance")
def q_pca_variance(spark, sf):
    return rounded(E.pca_variance(views.table(spark, sf, "embeddings"), "embedding"))


@register("projection_2d")
def q_projection_2d(spark, sf):
    return rounded(E.projection_2d(views.table(spark, sf, "embeddings"), "vec_id", "embedding", "label"))


# ------------------------------------------------------------------ J8, M8 exact neighbours

_DIST = "list_distance(list_transform({a}, lambda x: x::double), list_transform({b}, lambda x: x::double))"


_KNN_SQL = sql_round(f"""
with e as (select vec_id, embedding, label from embeddings),
r as (select * from e where label <> 0),
d as (select q.vec_id as qid, r.vec_id as rid, {_DIST.format(a='q.embedding', b='r.embedding')} as dist
      from e q, r where q.vec_id <> r.vec_id),
k as (select qid, rid, dist, row_number() over (partition by qid order by dist, rid) as rank from d)
select qid, cast(rank as integer) as rank, rid, dist from k where rank <= 15""", ["dist"])


@register("knn_topk", _KNN_SQL)
def q_knn_topk(spark, sf):
    emb = views.table(spark, sf, "embeddings")
    refs = emb.where(F.col("label") != 0)
    return rounded(NB.knn(emb, refs, 15, "vec_id", "vec_id", "embedding", exclude_self=True))


@register("knn_pivot", _KNN_SQL)
def q_knn_pivot(spark, sf):
    """The same by the pivot index, whatever the size."""
    emb = views.table(spark, sf, "embeddings")
    refs = emb.where(F.col("label") != 0)
    return rounded(NB.knn(emb, refs, 15, "vec_id", "vec_id", "embedding", exclude_self=True, broadcast_rows=0))


@register("lof_scores", sql_round(f"""
with e as (select vec_id, embedding, label from embeddings),
r as (select * from e where label <> 0),
rr as (select p.vec_id as pid, o.vec_id as oid, {_DIST.format(a='p.embedding', b='o.embedding')} as d
       from r p, r o where p.vec_id <> o.vec_id),
nn as (select * from (select *, row_number() over (partition by pid order by d, oid) as rk from rr) where rk <= 20),
kd as (select pid, d as kdist from nn where rk = 20),
lrd as (select nn.pid, 1.0 / (avg(greatest(kd.kdist, nn.d)) + 1e-10) as lrd
        from nn join kd on nn.oid = kd.pid group by nn.pid),
qr as (select q.vec_id as qid, o.vec_id as oid, {_DIST.format(a='q.embedding', b='o.embedding')} as d
       from e q, r o),
qn as (select * from (select *, row_number() over (partition by qid order by d, oid) as rk from qr) where rk <= 20)
select qn.qid, avg(l.lrd) / (1.0 / (avg(greatest(kd.kdist, qn.d)) + 1e-10)) as lof
from qn join kd on qn.oid = kd.pid join lrd l on qn.oid = l.pid group by qn.qid""", ["lof"]))
def q_lof_scores(spark, sf):
    emb = views.table(spark, sf, "embeddings")
    refs = emb.where(F.col("label") != 0)
    return rounded(NB.lof(emb, refs, 20, "embedding", qid="vec_id", rid="vec_id"))


# ------------------------------------------------------------------ M2–M17 models on embeddings

def _frame(spark, sf):
    return ML.vector_frame(_emb(spark, sf), "pos", "y", "embedding")


def _holdout_for(name):
    def q(spark, sf):
        specs = [s for s in ML.build_classifiers(SEED) if s.name == name]
        preds = ML.holdout_predictions(_frame(spark, sf), specs, with_knn=False, seed=SEED)
        return rounded(M.metrics_long(M.classification_metrics(preds, ["model"]), ["model"]))
    return q


for _name, _q in (("lr_holdout", "logistic_regression"), ("rf_holdout", "random_forest"),
                  ("svc_holdout", "linear_svc"), ("gbt_holdout", "gradient_boosting")):
    register(_name)(_holdout_for(_q))


def _knn_sql() -> str:
    from .queries_ml import _holdout_quota_sql, _holdout_rows_sql

    names = ("tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "fbeta", "mcc", "roc_auc", "fpr_at_90", "fpr_at_99")
    long = " union all ".join(f"select model, '{n}' as metric, {n}::double as value from wide" for n in names)
    return sql_round(f"""WITH emb as (select vec_id as pos, case when label = 0 then 1 else 0 end as y, embedding as e from embeddings),
{_holdout_quota_sql("emb", "y")},{_holdout_rows_sql("emb", "y")},
x as (select pos, y, split, unnest(e)::double as v, generate_subscripts(e, 1) as i from split_rows),
st as (select i, avg(v) as m, stddev_samp(v) as s from x where split = 'train' group by i),
z as (select pos, y, split, list((v - m) / s order by i) as e from x join st using (i) group by all),
nn as (select q.pos, q.y, r.y as ry, row_number() over (partition by q.pos order by list_distance(q.e, r.e), r.pos) as k
  from z q join z r on r.split = 'train' where q.split = 'test'),
preds as (select 'knn' as model, pos, any_value(y) as y_true, avg(ry) as y_score, case when avg(ry) > 0.5 then 1 else 0 end as y_pred
  from nn where k <= 15 group by pos),""" + _roc_sql("preds", "model") + f""",
thr as ({_thr_sql('preds', 'model')}),
auc as ({_part_fix(_auc_sql('preds', 'model'))}),
fat as (select model, coalesce(min(fpr) filter (where tpr >= 0.9), 1.0) as fpr_at_90,
        coalesce(min(fpr) filter (where tpr >= 0.99), 1.0) as fpr_at_99 from roc_pts group by model),
wide as (select * from thr join auc using (model) join fat using (model))
{long}""", ["value"])


@register("knn_holdout", _knn_sql())
def q_knn_holdout(spark, sf):
    preds = ML.holdout_predictions(_frame(spark, sf), [], with_knn=True, seed=SEED)
    return rounded(M.metrics_long(M.classification_metrics(preds, ["model"]), ["model"]))


@register("mlp_holdout")
def q_mlp_holdout(spark, sf):
    frame = _frame(spark, sf)
    split = sp.holdout_split(frame, "y", "pos", 0.3, SEED)
    preds, _hist = ML.mlp_head(split.where(sp.is_train()).drop("split"),
                               split.where(sp.is_test()).drop("split"), SEED)
    return rounded(M.metrics_long(M.classification_metrics(preds, ["model"]), ["model"]))


@register("mlp_history")
def q_mlp_history(spark, sf):
    """The MLP head's epoch history normalised into a learning-curve table."""
    from ..operators.lm import normalize_history

    frame = _frame(spark, sf)
    split = sp.holdout_split(frame, "y", "pos", 0.3, SEED)
    _preds, hist = ML.mlp_head(split.where(sp.is_train()).drop("split"),
                               split.where(sp.is_test()).drop("split"), SEED)
    return rounded(normalize_history(hist))


@register("iforest_scores")
def q_iforest_scores(spark, sf):
    """Isolation forest on normal rows, scored on every embedding."""
    emb = _emb(spark, sf)
    forest = IsolationForest(n_trees=100, max_samples=256, seed=SEED).fit(
        emb.where(F.col("y") == 0), "pos", "embedding")
    return rounded(forest.score(emb, "embedding").select("pos", "y", "y_score", "y_pred"))


@register("detectors_holdout")
def q_detectors_holdout(spark, sf):
    """Isolation forest + LOF fitted on normal training rows, scored on the shared holdout."""
    frame = _frame(spark, sf)
    split = sp.holdout_split(frame, "y", "pos", 0.3, SEED)
    train, test = split.where(sp.is_train()).drop("split"), split.where(sp.is_test()).drop("split")
    preds = ML.anomaly_predictions(frame, train.where(F.col("y") == 0), test, SEED)
    return rounded(M.metrics_long(M.classification_metrics(preds, ["model"]), ["model"]))


@register("cv_compare")
def q_cv_compare(spark, sf):
    """5-fold CV of every classifier, summary table and best model by F1."""
    cv = ML.cross_validate(_frame(spark, sf), folds=5, seed=SEED)
    return rounded(ML.cv_summary(cv))


@register("descriptive_baseline")
def q_descriptive_baseline(spark, sf):
    ff = feature_frame(views.page_requests(spark, sf), keep=("pos",))
    preds = ML.descriptive_baseline(ff, list(NUMERIC_FEATURES), SEED)
    return rounded(M.metrics_long(M.classification_metrics(preds, ["model"]), ["model"]))


@register("lexical_baseline")
def q_lexical_baseline(spark, sf):
    preds = ML.lexical_baseline(views.req_pages(spark, sf), "raw", SEED)
    return rounded(M.metrics_long(M.classification_metrics(preds, ["model"]), ["model"]))


@register("dedup_reeval")
def q_dedup_reeval(spark, sf):
    """M16 + A25: logistic regression on descriptive features, full vs first-line-deduplicated."""
    from pyspark.ml.feature import VectorAssembler

    req = rq.with_request_text(views.page_requests(spark, sf))
    ff = feature_frame(req, keep=("pos",))
    va = VectorAssembler(inputCols=list(NUMERIC_FEATURES), outputCol="features")
    frame = va.transform(ff.select("pos", F.col("label").alias("y"),
                                   *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES]))
    # the pages are parsed once for both models, whose splits read the rows several times
    frame = cut_lineage(frame.select("pos", "y", "features"))
    spec = [s for s in ML.build_classifiers(SEED) if s.name == "logistic_regression"]
    full = ML.holdout_predictions(frame, spec, with_knn=False, seed=SEED)
    keys = cut_lineage(req.select("pos", F.col("request_line").alias("key")))
    dedup = ML.dedup_reevaluate(frame, keys, "logistic_regression", SEED)
    a = M.classification_metrics(full, ["model"]).drop("model")
    b = M.classification_metrics(dedup, ["model"]).drop("model")
    return rounded(M.metric_delta(a, b))


# ------------------------------------------------------------------ J4, R1, A25, R14 on ``scored``

_TWO_MODELS = f"""{_SCORED},
preds as (select 'n_chars_gt_400' as model, pos, y_true, y_pred, y_score from scored
          union all select 'n_chars_gt_1000', pos, y_true, case when y_score > 1000 then 1 else 0 end, y_score
          from scored)"""


def _two_models(spark, sf):
    s = views.scored(spark, sf)
    return (s.withColumn("model", F.lit("n_chars_gt_400"))
            .unionByName(s.withColumn("y_pred", (F.col("y_score") > 1000).cast("int"))
                         .withColumn("model", F.lit("n_chars_gt_1000"))))


@register("error_examples", f"""WITH {_SCORED},
err as (select 'scored' as model, pos, case when y_pred = 1 and y_true = 0 then 'false_positive'
          when y_pred = 0 and y_true = 1 then 'false_negative' end as error_type from scored),
e2 as (select * from err where error_type is not null),
tot as (select model, error_type, count(*) as n_errors from e2 group by all),
r as (select *, row_number() over (partition by model, error_type order by pos) as rank from e2)
select r.model, r.error_type, tot.n_errors, cast(r.rank as integer) as rank, r.pos,
  substring(d.text, 1, 160) as example
from r join tot using (model, error_type) join documents d on d.doc_id = r.pos where r.rank <= 5""")
def q_error_examples(spark, sf):
    preds = views.scored(spark, sf).withColumn("model", F.lit("scored"))
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    return RP.error_examples(preds, docs, "text", k=5)


def _cmp_sql() -> str:
    return sql_round(f"WITH {_TWO_MODELS}," + _roc_sql("preds", "model") + f""",
thr as ({_thr_sql('preds', 'model')}),
auc as ({_part_fix(_auc_sql('preds', 'model'))}),
fat as (select model, coalesce(min(fpr) filter (where tpr >= 0.9), 1.0) as fpr_at_90,
        coalesce(min(fpr) filter (where tpr >= 0.99), 1.0) as fpr_at_99 from roc_pts group by model)
select model, f1, fbeta, mcc, roc_auc, precision, recall, accuracy, fpr_at_90, fpr_at_99
from thr join auc using (model) join fat using (model)""",
                     ["f1", "fbeta", "mcc", "roc_auc", "precision", "recall", "accuracy", "fpr_at_90", "fpr_at_99"])


@register("comparison_frame", _cmp_sql())
def q_comparison_frame(spark, sf):
    wide = M.classification_metrics(_two_models(spark, sf), ["model"])
    return rounded(RP.comparison_frame(M.metrics_long(wide, ["model"])))


@register("confusion_table", f"""WITH {_TWO_MODELS},
cells as (select model, t, p from (select distinct model from preds), (values (0,0),(0,1),(1,0),(1,1)) c(t, p))
select c.model, case when c.t = 0 then 'normal' else 'anomaly' end as true,
  case when c.p = 0 then 'normal' else 'anomaly' end as predicted, count(preds.pos) as n
from cells c left join preds on preds.model = c.model and preds.y_true = c.t and preds.y_pred = c.p
group by c.model, c.t, c.p""")
def q_confusion_table(spark, sf):
    return RP.confusion_table(_two_models(spark, sf))


def _delta_sql() -> str:
    return sql_round(f"""WITH {_SCORED},
dd as (select s.* from scored s join (select min(doc_id) as doc_id from documents group by text) f
       on s.pos = f.doc_id),
{_roc_sql('scored').replace('roc_', 'ra_').strip()},
{_roc_sql('dd').replace('roc_', 'rb_').strip()},
fa as ({_thr_sql('scored')}), fb as ({_thr_sql('dd')}),
pa as (select coalesce(min(fpr) filter (where tpr >= 0.99), 1.0) as fpr_at_99 from ra_pts),
pb as (select coalesce(min(fpr) filter (where tpr >= 0.99), 1.0) as fpr_at_99 from rb_pts)
select 'f1' as metric, fa.f1 as value_full, fb.f1 as value_dedup, fb.f1 - fa.f1 as delta from fa, fb
union all select 'mcc', fa.mcc, fb.mcc, fb.mcc - fa.mcc from fa, fb
union all select 'fpr_at_99', pa.fpr_at_99, pb.fpr_at_99, pb.fpr_at_99 - pa.fpr_at_99 from pa, pb""",
                     ["value_full", "value_dedup", "delta"])


@register("metric_delta", _delta_sql())
def q_metric_delta(spark, sf):
    from ..operators.quality import unique_first

    s = views.scored(spark, sf)
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    firsts = unique_first(docs, "text").select("pos")
    dd = s.join(firsts, "pos", "left_semi")
    a = M.classification_metrics(s)
    b = M.classification_metrics(dd)
    return rounded(M.metric_delta(a, b))


@register("run_summary", f"""WITH {_SCORED},
m as ({_thr_sql('scored')}),
auc as ({_part_fix(_auc_sql('scored'))}),
kv as (
  select 'n_rows' as key, (tn + fp + fn + tp)::double as value from m
  union all select 'share_anomalous', (fn + tp) / (tn + fp + fn + tp)::double from m
  union all select 'f1', f1 from m union all select 'mcc', mcc from m
  union all select 'roc_auc', roc_auc from auc
  union all select 'duplicate_rate', (count(*) - count(distinct text)) / count(*)::double from documents)
select key, round(value, 4) as value from kv where value is not null and not isnan(value)""")
def q_run_summary(spark, sf):
    s = views.scored(spark, sf)
    wide = M.classification_metrics(s)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    kv = wide.select(F.explode(F.array(
        F.struct(F.lit("n_rows").alias("key"), n.cast("double").alias("value")),
        *[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in (
            ("share_anomalous", (F.col("fn") + F.col("tp")) / n), ("f1", F.col("f1")), ("mcc", F.col("mcc")),
            ("roc_auc", F.col("roc_auc")))])).alias("_kv")).select("_kv.*")
    from ..operators.quality import duplicate_report

    dup = duplicate_report(views.table(spark, sf, "documents"), "text").select(
        F.lit("duplicate_rate").alias("key"), F.col("duplicate_rate").alias("value"))
    return RP.run_summary(kv.unionByName(dup))


# ------------------------------------------------------------------ R8, T8, W7

from ..operators import distribution as DI  # noqa: E402
from ..operators import quality as QA  # noqa: E402
from .queries import _PAGES_PARSED, _REQ_LINE_SQL  # noqa: E402

_R8_COLS = ["target_length", "body_length", "n_query_params", "digit_ratio", "upper_ratio"]


def _r8_sql() -> str:
    from .queries import _PAGES_FEATURES

    long = " union all ".join(f"select '{c}' as feature, label, {c}::double as v from ff" for c in _R8_COLS)
    return _PAGES_FEATURES + f""",
lg as ({long}),
rg0 as (select feature, min(v) as mn, max(v) as mx from lg group by feature),
rg as (select feature, case when mx > mn then mn else mn - 0.5 end as lo,
   (case when mx > mn then mx else mx + 0.5 end - case when mx > mn then mn else mn - 0.5 end) / 30 as step from rg0),
b0 as (select lg.feature, label, v, lo, step,
   least(greatest(cast(floor((v - lo) * (30.0 / (step * 30))) as integer), 0), 29) as i0 from lg join rg using (feature)),
b as (select feature, label, case when v < lo + i0 * step then i0 - 1
   when i0 < 29 and v >= lo + (i0 + 1) * step then i0 + 1 else i0 end as bin from b0),
cnt as (select feature, label, bin, count(*) as n from b group by all),
grid as (select p.feature, p.label, lo, step, unnest(range(0, 30)) as bin
         from (select distinct feature, label from lg) p join rg using (feature))
select g.feature, cast(g.label as integer) as label, cast(g.bin as integer) as bin, round(lo + g.bin * step, 6) as lo,
  round(case when g.bin = 29 then lo + step * 30 else lo + (g.bin + 1) * step end, 6) as hi, coalesce(c.n, 0) as n
from grid g left join cnt c on g.feature = c.feature and g.label = c.label and g.bin = c.bin"""


@register("feature_distributions", _r8_sql())
def q_feature_distributions(spark, sf):
    ff = feature_frame(views.page_requests(spark, sf), keep=("pos",))
    return rounded(DI.feature_histograms(ff, _R8_COLS, "label"))


@register("first_examples", _PAGES_PARSED + f"""
select cast(label as integer) as label, min(pos) as pos,
  substring(arg_min({_REQ_LINE_SQL}, pos), 1, 160) as example from pp group by label""")
def q_first_examples(spark, sf):
    req = rq.with_request_text(views.page_requests(spark, sf))
    return QA.first_examples(req)


@register("roc_overlay", sql_round(f"WITH {_TWO_MODELS}," + _roc_sql("preds", "model") +
                                   " select * from roc_pts", ["threshold", "fpr", "tpr"]))
def q_roc_overlay(spark, sf):
    """A third model that saw one class only has no curve."""
    two = _two_models(spark, sf)
    one_class = two.where((F.col("model") == "n_chars_gt_400") & (F.col("y_true") == 0)).withColumn("model", F.lit("one_class"))
    return rounded(RP.roc_overlay(two.unionByName(one_class)))


@register("metrics_positive0", sql_round(f"""WITH {_SCORED},
flipped as (select pos, 1 - y_true as y_true, 1 - y_pred as y_pred, y_score from scored),
m as ({_thr_sql('flipped')}),
auc as ({_part_fix(_auc_sql('flipped'))})
select tn, fp, fn, tp, accuracy, precision, recall, f1, fbeta, mcc, roc_auc from m, auc""",
                                         ["accuracy", "precision", "recall", "f1", "fbeta", "mcc", "roc_auc"]))
def q_metrics_positive0(spark, sf):
    """Label 0 as the positive class."""
    m = M.classification_metrics(views.scored(spark, sf), positive_label=0)
    return rounded(m.select("tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "fbeta", "mcc", "roc_auc"))


def _cv_f1_sql() -> str:
    return f"""{_TWO_MODELS},
folded as (select *, cast((row_number() over (partition by model, y_true
   order by md5(concat('{SEED}:', cast(pos as varchar)))) - 1) % 5 as integer) as fold from preds),
thr as ({_thr_sql('folded', 'model, fold')}),
f as (select model, avg(f1) as mean_f1 from thr group by model)"""


@register("best_model", sql_round(f"WITH {_cv_f1_sql()} select model, mean_f1 from f order by mean_f1 desc, model limit 1", ["mean_f1"]))
def q_best_model(spark, sf):
    """The model with the highest mean F1 over folds."""
    cv = None
    for name in ("n_chars_gt_1000", "n_chars_gt_400"):
        rows = _two_models(spark, sf).where(F.col("model") == name)
        folded = sp.kfold(rows.withColumnRenamed("y_true", "label"), 5, "label", "pos", SEED).withColumnRenamed("label", "y_true")
        cv = folded if cv is None else cv.unionByName(folded)
    summary = ML.cv_summary(cv)
    best = ML.best_model(summary, ["n_chars_gt_1000", "n_chars_gt_400"])
    return rounded(summary.where((F.col("model") == best) & (F.col("metric") == "f1")).select("model", F.col("mean").alias("mean_f1")))


@register("profile_head", _PAGES_PARSED + """
select pos, method, target, version, cast(len(hl) as integer) as n_headers, cast(label as integer) as label
from pp where pos < 5""")
def q_profile_head(spark, sf):
    """The first five requests by position (a filter, not a sort)."""
    _n, _types, head = QA.profile(views.page_requests(spark, sf))
    return head.select("pos", "method", "target", "version", F.size("headers").alias("n_headers"), "label")


def _cv_format_sql() -> str:
    from .queries_ml import _FOLDED

    names = ("f1", "fbeta", "mcc", "roc_auc", "precision", "recall", "accuracy", "fpr_at_90", "fpr_at_99")
    means = ", ".join(f"avg({n}) filter (where not isnan({n})) as {n}" for n in names)
    stds = ", ".join(f"stddev_pop({n}) filter (where not isnan({n})) as s_{n}" for n in ("f1", "mcc", "roc_auc"))
    text = " || ', ' || ".join(f"printf('{n}=%.3f+/-%.3f', {n}, s_{n})" for n in ("f1", "mcc", "roc_auc"))
    return sql_round(f"WITH {_FOLDED}," + _roc_sql("folded", "fold") + f""",
thr as ({_thr_sql('folded', 'fold')}),
auc as ({_part_fix(_auc_sql('folded', 'fold'))}),
fat as (select fold, coalesce(min(fpr) filter (where tpr >= 0.9), 1.0) as fpr_at_90,
        coalesce(min(fpr) filter (where tpr >= 0.99), 1.0) as fpr_at_99 from roc_pts group by fold),
wide as (select * from thr join auc using (fold) join fat using (fold)),
a as (select {means}, {stds} from wide)
select 'scored' as model, {text} as summary, {', '.join(names)} from a""", list(names))


@register("cv_format", _cv_format_sql())
def q_cv_format(spark, sf):
    """CV means as a model × metric table and the ``f1=…+/-…`` summary strings."""
    from .queries_ml import SEED as _S

    folded = sp.kfold(views.scored(spark, sf).withColumnRenamed("y_true", "label"), 5, "label", "pos", _S)
    folded = folded.withColumnRenamed("label", "y_true").withColumn("model", F.lit("scored"))
    summary = ML.cv_summary(folded)
    return rounded(RP.format_cv(summary).join(RP.cv_table(summary), "model"))
