"""Queries for leakage, sampling, splits, metrics and distributions.

Registered into the same ``QUERIES`` / ``ORACLE`` tables as ``queries``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distribution as dist
from ..operators import metrics as M
from ..operators import quality as qa
from ..operators import splits as sp
from ..sources import views
from . import oracle as O
from .queries import register, rounded, sql_round

SEED = 42

# ------------------------------------------------------------------ J1–J3 leakage

_LEAK_SQL = """select count(*) as n_test, count(*) filter (where hit) as n_leaked,
  case when count(*) > 0 then (count(*) filter (where hit)) / count(*)::double else 0.0 end as leakage_rate
from (select t.k, t.k in (select k from tr) as hit from te t)"""


def _holdout_quota_sql(src: str, label: str, test_size: float = 0.3) -> str:
    """SQL CTEs: per-class test quota (floor + largest remainder on the train share)."""
    return f"""
cc as (select {label} as lab, count(*) as c from {src} group by {label}),
tot as (select sum(c) as n, ceil({test_size} * sum(c)) as nt from cc),
al as (select lab, c, c * (n - nt) / n as cont, floor(c * (n - nt) / n) as fl from cc, tot),
nd as (select (select n - nt from tot) - sum(fl) as need from al),
rk as (select lab, c, fl, row_number() over (order by cont - fl desc, lab) as r from al),
quota as (select lab, c - (fl + case when r <= need then 1 else 0 end) as q from rk, nd)"""


def _holdout_rows_sql(src: str, label: str, key: str = "pos", seed: int = SEED) -> str:
    return f"""
ranked as (select s.*, row_number() over (partition by s.{label}
    order by md5(concat('{seed}:', cast(s.{key} as varchar)))) - 1 as rnk from {src} s),
split_rows as (select r.*, case when r.rnk < q.q then 'test' else 'train' end as split
    from ranked r join quota q on r.{label} = q.lab)"""


@register("leakage_holdout", sql_round("WITH " + O.REQ_EVENTS.strip() + "," + _holdout_quota_sql("req_events", "label")
          + "," + _holdout_rows_sql("req_events", "label") + """,
tr as (select request_line as k from split_rows where split = 'train'),
te as (select request_line as k from split_rows where split = 'test')
""" + _LEAK_SQL, ["leakage_rate"]))
def q_leakage_holdout(spark, sf):
    ev = sp.holdout_split(views.req_events(spark, sf), "label", "pos", 0.3, SEED)
    return rounded(qa.train_test_leakage(ev.where(sp.is_train()), ev.where(sp.is_test()), "request_line"))


@register("leakage_cross", sql_round("""WITH
tr as (select text as k from documents where cast(substring(source, 4) as integer) < 10),
te as (select text as k from documents where cast(substring(source, 4) as integer) >= 10)
""" + _LEAK_SQL, ["leakage_rate"]))
def q_leakage_cross(spark, sf):
    docs = views.table(spark, sf, "documents")
    src_no = F.substring("source", 4, 10).cast("int")
    return rounded(qa.train_test_leakage(docs.where(src_no < 10), docs.where(src_no >= 10), "text"))


@register("leak_benchmark", sql_round("""WITH
tr as (select text as k from documents), te as (select text as k from benchmark)
""" + _LEAK_SQL, ["leakage_rate"]))
def q_leak_benchmark(spark, sf):
    return rounded(qa.train_test_leakage(views.table(spark, sf, "documents"),
                                         views.table(spark, sf, "benchmark"), "text"))


# ------------------------------------------------------------------ S5–S8 sampling and views

@register("subset_fraction", "WITH " + O.REQ_EVENTS.strip() + f""",
sz as (select label, count(*) as n, greatest(1, round_even(count(*) * 0.4, 0)) as k from req_events group by label)
select pos, label from (
  select e.pos, e.label, row_number() over (partition by e.label
     order by md5(concat('{SEED}:', cast(e.pos as varchar)))) as rn, sz.k, sz.n
  from req_events e join sz on e.label = sz.label)
where rn <= case when k >= n then n else k end""")
def q_subset_fraction(spark, sf):
    ev = views.req_events(spark, sf)
    return sp.sample_exact(ev, 0.4, SEED, key="pos", group_cols=("label",)).select("pos", "label")


@register("head_cap", "WITH " + O.REQ_EVENTS.strip() + """
select pos, label from (select pos, label, row_number() over (partition by label order by pos) as rn
  from req_events) where rn <= 1000""")
def q_head_cap(spark, sf):
    ev = sp.ordered_rank(views.req_events(spark, sf), "pos", ("label",), out="file_pos")
    return sp.head_cap(ev, 1000, "file_pos").select("pos", "label")


_CUT = "2024-01-16 00:00:00"


@register("bundle_views", f"""WITH
ev as (select event_id, case when event_type = 'error' then 1 else 0 end as label,
  case when event_type = 'error' then 2 when ts < timestamp '{_CUT}' then 0 else 1 end as file_ord from events),
fp as (select *, row_number() over (partition by file_ord order by event_id) - 1 as fpos from ev),
n as (select count(*) filter (where file_ord = 0) as n0, count(*) filter (where file_ord = 1) as n1 from ev),
v as (
  select 'lm_train' as view, fpos as pos, event_id, label from fp where file_ord = 0
  union all
  select 'inference', case when file_ord = 1 then fpos else fpos + n1 end, event_id, label
    from fp, n where file_ord in (1, 2)
  union all
  select 'tokenizer_corpus', case when file_ord = 0 then fpos when file_ord = 1 then fpos + n0
    else fpos + n0 + n1 end, event_id, label from fp, n)
select view, cast(pos as bigint) as pos, event_id, cast(label as integer) as label from v""")
def q_bundle_views(spark, sf):
    from pyspark.sql import Window

    ev = views.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.when(F.col("event_type") == "error", 2)
        .when(F.col("ts") < F.lit(_CUT).cast("timestamp_ntz"), 0).otherwise(1).alias("file_ord"))
    ev = sp.ordered_rank(ev, "event_id", ("file_ord",), out="fpos")
    roles = spark.createDataFrame([(0, "lm_train"), (1, "inference"), (2, "inference")],
                                  "file_ord int, view string")
    ev = ev.join(F.broadcast(roles), "file_ord")
    sizes = ev.groupBy("view", "file_ord").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("view").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("view", "file_ord", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    views_df = ev.join(F.broadcast(offs), ["view", "file_ord"]).select(
        "view", (F.col("fpos") + F.col("_off")).cast("long").alias("pos"), "event_id", "label", "file_ord")
    n_lm = sizes.where(F.col("view") == "lm_train").agg(F.sum("_n")).first()[0] or 0
    corpus = (views_df.withColumn("_nlm", F.lit(n_lm))
              .select(F.lit("tokenizer_corpus").alias("view"),
                      F.when(F.col("view") == "lm_train", F.col("pos"))
                      .otherwise(F.col("pos") + F.coalesce(F.col("_nlm"), F.lit(0))).cast("long").alias("pos"),
                      "event_id", "label"))
    return views_df.drop("file_ord").unionByName(corpus)


# ------------------------------------------------------------------ X1–X6 splits

_LABELS = "labels"


@register("holdout_split", "WITH " + _holdout_quota_sql("lb", "label").replace(
    "cc as", "lb as (select doc_id as pos, quality as label from labels),\ncc as", 1)
    + "," + _holdout_rows_sql("lb", "label") + " select pos, cast(label as integer) as label, split from split_rows")
def q_holdout_split(spark, sf):
    lb = views.table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.col("quality").alias("label"))
    return sp.holdout_split(lb, "label", "pos", 0.3, SEED).select("pos", "label", "split")


@register("kfold", f"""
select doc_id as pos, cast(toxic as integer) as label,
  cast((row_number() over (partition by toxic order by md5(concat('{SEED}:', cast(doc_id as varchar)))) - 1) % 5
       as integer) as fold
from labels""")
def q_kfold(spark, sf):
    lb = views.table(spark, sf, "labels").select(F.col("doc_id").alias("pos"), F.col("toxic").alias("label"))
    return sp.kfold(lb, 5, "label", "pos", SEED).select("pos", "label", "fold")


@register("eval_split", "WITH " + O.REQ_EVENTS.strip() + f""",
nrm as (select pos from req_events where label = 0),
k as (select count(*) as n, greatest(1, round_even(count(*) * 0.05, 0)) as k from nrm)
select pos, cast(case when n >= 20 and rn <= k then 1 else 0 end as integer) as is_val
from (select pos, row_number() over (order by md5(concat('{SEED}:', cast(pos as varchar)))) as rn from nrm), k""")
def q_eval_split(spark, sf):
    ev = views.req_events(spark, sf).where(F.col("label") == 0).select("pos")
    return sp.validation_split(ev, 0.05, SEED).select("pos", F.col("is_val").cast("int").alias("is_val"))


@register("safe_folds", """
select cast(greatest(2, least(5, min(c))) as integer) as folds, cast(min(c) as bigint) as smallest_class
from (select toxic, count(*) as c from labels group by toxic)""")
def q_safe_folds(spark, sf):
    counts = sp.class_counts(views.table(spark, sf, "labels"), "toxic")
    folds = sp.safe_folds(counts, 5)
    return spark.range(1).select(F.lit(folds).alias("folds"),
                                 F.lit(min(counts.values())).cast("long").alias("smallest_class"))


# ------------------------------------------------------------------ A17–A24 metrics on ``scored``

_SCORED = """scored as (select l.doc_id as pos, l.toxic as y_true, case when d.n_chars > 400 then 1 else 0 end as y_pred,
  d.n_chars::double as y_score from labels l join documents d on l.doc_id = d.doc_id)"""

_CONF = """count(*) filter (where y_true <> 1 and y_pred <> 1) as tn,
  count(*) filter (where y_true <> 1 and y_pred = 1) as fp,
  count(*) filter (where y_true = 1 and y_pred <> 1) as fn,
  count(*) filter (where y_true = 1 and y_pred = 1) as tp"""


def _thr_sql(src: str, keys: str = "") -> str:
    k = (keys + ",") if keys else ""
    g = f"group by {keys}" if keys else ""
    return f"""select {k} tn, fp, fn, tp,
  case when n > 0 then (tp + tn) / n::double else 0.0 end as accuracy,
  case when tp + fp > 0 then tp / (tp + fp)::double else 0.0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn)::double else 0.0 end as recall,
  case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0.0 end as f1,
  case when 5 * tp + 4 * fn + fp > 0 then 5 * tp / (5 * tp + 4 * fn + fp)::double else 0.0 end as fbeta,
  case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
       then (tp * tn - fp * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) else 0.0 end as mcc
from (select {k} {_CONF}, count(*) as n from {src} {g})"""


def _roc_sql(src: str, keys: str = "") -> str:
    """CTE bodies roc_g / roc_c / roc_pts over ``src`` (y_true, y_score) per ``keys``."""
    k = (keys + ",") if keys else ""
    part = f"partition by {keys}" if keys else ""
    join_tot = f"join roc_t t using ({keys})" if keys else "cross join roc_t t"
    return f"""
roc_g as (select {k} y_score, sum(case when y_true = 1 then 1 else 0 end) as tp_inc,
    sum(case when y_true = 1 then 0 else 1 end) as fp_inc from {src} group by {k} y_score),
roc_c as (select {k} y_score, tp_inc, fp_inc,
    sum(tp_inc) over ({part} order by y_score desc rows between unbounded preceding and current row) as ctp,
    sum(fp_inc) over ({part} order by y_score desc rows between unbounded preceding and current row) as cfp,
    row_number() over ({part} order by y_score desc) as rn,
    lead(tp_inc) over ({part} order by y_score desc) as ntp,
    lead(fp_inc) over ({part} order by y_score desc) as nfp from roc_g),
roc_t as (select {k} sum(tp_inc) as P, sum(fp_inc) as N from roc_g {"group by " + keys if keys else ""}),
roc_pts as (
  select {"c." + keys.replace(",", ", c.") + "," if keys else ""} c.y_score as threshold,
    case when t.N > 0 then c.cfp / t.N::double else 'nan'::double end as fpr,
    case when t.P > 0 then c.ctp / t.P::double else 'nan'::double end as tpr
  from roc_c c {join_tot}
  where c.rn = 1 or c.ntp is null or not (c.ntp = c.tp_inc and c.nfp = c.fp_inc)
  union all
  select {k} 'inf'::double, case when N > 0 then 0.0 else 'nan'::double end,
    case when P > 0 then 0.0 else 'nan'::double end from roc_t)"""


def _auc_sql(src: str, keys: str = "") -> str:
    k = (keys + ",") if keys else ""
    part = f"partition by {keys}" if keys else ""
    g = f"group by {keys}" if keys else ""
    return f"""select {k} case when sum(y_true) * sum(1 - y_true) > 0 then
   (sum(case when y_true = 1 then rk else 0 end) - sum(y_true) * (sum(y_true) + 1) / 2.0)
     / (sum(y_true) * sum(1 - y_true))::double else 'nan'::double end as roc_auc
from (select {k} y_true, rank() over ({part} order by y_score) +
        (count(*) over ({part}, y_score) - 1) / 2.0 as rk from {src}) {g}"""


def _part_fix(sql: str) -> str:
    return sql.replace("over (, y_score)", "over (partition by y_score)").replace(
        "over (partition by fold, y_score)", "over (partition by fold, y_score)")


def _scored(spark, sf):
    return views.scored(spark, sf)


@register("confusion", f"WITH {_SCORED} select {_CONF} from scored")
def q_confusion(spark, sf):
    return M.confusion(_scored(spark, sf))


@register("threshold_metrics", sql_round(f"WITH {_SCORED} " + _thr_sql("scored"),
                                         ["accuracy", "precision", "recall", "f1", "fbeta", "mcc"]))
def q_threshold_metrics(spark, sf):
    return rounded(M.threshold_metrics(M.confusion(_scored(spark, sf))))


@register("mcc", sql_round(f"WITH {_SCORED}, m as ({_thr_sql('scored')}) select mcc from m", ["mcc"]))
def q_mcc(spark, sf):
    return rounded(M.threshold_metrics(M.confusion(_scored(spark, sf))).select("mcc"))


@register("roc_points", sql_round(f"WITH {_SCORED}," + _roc_sql("scored") + " select * from roc_pts",
                                  ["threshold", "fpr", "tpr"]))
def q_roc_points(spark, sf):
    return rounded(M.roc_points(_scored(spark, sf)))


@register("roc_auc", sql_round(f"WITH {_SCORED} " + _part_fix(_auc_sql("scored").replace(
    "partition by  order", "order").replace("over ()", "over ()")), ["roc_auc"]))
def q_roc_auc(spark, sf):
    return rounded(M.roc_auc(_scored(spark, sf)))


@register("fpr_at_tpr", sql_round(f"WITH {_SCORED}," + _roc_sql("scored") + """
select coalesce(min(fpr) filter (where tpr >= 0.9), 1.0) as fpr_at_90,
       coalesce(min(fpr) filter (where tpr >= 0.99), 1.0) as fpr_at_99 from roc_pts""",
                                  ["fpr_at_90", "fpr_at_99"]))
def q_fpr_at_tpr(spark, sf):
    return rounded(M.fpr_at_tpr(M.roc_points(_scored(spark, sf))))


_FOLDED = f"""{_SCORED},
folded as (select *, cast((row_number() over (partition by y_true
   order by md5(concat('{SEED}:', cast(pos as varchar)))) - 1) % 5 as integer) as fold from scored)"""


@register("cv_aggregate", sql_round(f"WITH {_FOLDED}," + _roc_sql("folded", "fold") + f""",
thr as ({_thr_sql('folded', 'fold')}),
auc as ({_part_fix(_auc_sql('folded', 'fold'))}),
fat as (select fold, coalesce(min(fpr) filter (where tpr >= 0.9), 1.0) as fpr_at_90,
        coalesce(min(fpr) filter (where tpr >= 0.99), 1.0) as fpr_at_99 from roc_pts group by fold),
wide as (select * from thr join auc using (fold) join fat using (fold)),
long as (select fold, 'tn' as metric, tn::double as value from wide union all select fold, 'fp' as metric, fp::double as value from wide union all select fold, 'fn' as metric, fn::double as value from wide union all select fold, 'tp' as metric, tp::double as value from wide union all select fold, 'accuracy' as metric, accuracy::double as value from wide union all select fold, 'precision' as metric, precision::double as value from wide union all select fold, 'recall' as metric, recall::double as value from wide union all select fold, 'f1' as metric, f1::double as value from wide union all select fold, 'fbeta' as metric, fbeta::double as value from wide union all select fold, 'mcc' as metric, mcc::double as value from wide union all select fold, 'roc_auc' as metric, roc_auc::double as value from wide union all select fold, 'fpr_at_90' as metric, fpr_at_90::double as value from wide union all select fold, 'fpr_at_99' as metric, fpr_at_99::double as value from wide)
select 'scored' as model, metric, avg(value) as mean, stddev_pop(value) as std
from long where value is not null and not isnan(value) and abs(value) <> 'inf'::double group by metric""",
                                    ["mean", "std"]))
def q_cv_aggregate(spark, sf):
    folded = sp.kfold(_scored(spark, sf).withColumnRenamed("y_true", "label"), 5, "label", "pos", SEED)
    folded = folded.withColumnRenamed("label", "y_true").withColumn("model", F.lit("scored"))
    wide = M.classification_metrics(folded, ["model", "fold"])
    return rounded(M.aggregate_cv(M.metrics_long(wide, ["model", "fold"]), ["model"]))


# ------------------------------------------------------------------ A15–A16 distributions

def _hist_sql(src: str, val: str, grp: str, bins: int = 30, shared: bool = False) -> str:
    rng_group = "" if shared else f"group by {grp}"
    rng_sel = "" if shared else f"{grp},"
    join = "cross join rg" if shared else f"join rg using ({grp})"
    return f"""
d as (select {grp}, {val}::double as v from {src} where {val} is not null and not isnan({val}::double)),
rg0 as (select {rng_sel} min(v) as mn, max(v) as mx from d {rng_group}),
rg as (select {rng_sel} case when mx > mn then mn else mn - 0.5 end as lo,
   case when mx > mn then mx else mx + 0.5 end as hi,
   (case when mx > mn then mx else mx + 0.5 end - case when mx > mn then mn else mn - 0.5 end) / {bins} as step
   from rg0),
nn as (select {grp}, count(*) as tot_n from d group by {grp}),
b0 as (select d.{grp}, v, lo, step,
   least(greatest(cast(floor((v - lo) * ({bins}.0 / (step * {bins}))) as integer), 0), {bins - 1}) as i0
   from d {join}),
b as (select {grp}, case when v < lo + i0 * step then i0 - 1
   when i0 < {bins - 1} and v >= lo + (i0 + 1) * step then i0 + 1 else i0 end as bin from b0),
cnt as (select {grp}, bin, count(*) as n from b group by {grp}, bin),
grid as (select nn.{grp}, tot_n, lo, step, unnest(range(0, {bins})) as bin from nn {join.replace('rg', 'rg')})
select g.{grp}, cast(g.bin as integer) as bin, lo + g.bin * step as lo,
  case when g.bin = {bins - 1} then lo + step * {bins} else lo + (g.bin + 1) * step end as hi,
  coalesce(c.n, 0) as n, coalesce(c.n, 0) / (tot_n * step) as density
from grid g left join cnt c on g.{grp} = c.{grp} and g.bin = c.bin"""


@register("hist_by_class", sql_round(f"WITH {_SCORED}," + _hist_sql("scored", "y_score", "y_true"),
                                     ["lo", "hi", "density"]))
def q_hist_by_class(spark, sf):
    return rounded(dist.histogram(_scored(spark, sf), "y_score", ["y_true"]))


@register("score_density", sql_round("WITH " + _hist_sql("events", "value", "event_type", shared=True),
                                     ["lo", "hi", "density"]))
def q_score_density(spark, sf):
    ev = views.table(spark, sf, "events")
    return rounded(dist.histogram(ev, "value", ["event_type"], shared_range=True))


@register("kde_scores", sql_round(f"""WITH {_SCORED},
d as (select y_true, y_score as v from scored),
st as (select y_true, count(*) as n, stddev_samp(v) as sd, min(v) as mn, max(v) as mx from d group by y_true
       having count(*) > 2 and max(v) > min(v)),
bw as (select *, pow(n::double, -0.2) * sd as h from st),
gr as (select y_true, n, h, mn - 3 * h as g0, (mx + 3 * h - (mn - 3 * h)) / 199 as gs,
       unnest(range(0, 200)) as i from bw),
dv as (select y_true, v, count(*) as w from d group by y_true, v)
select gr.y_true, cast(i as integer) as i, g0 + i * gs as x,
  sum(w * exp(-0.5 * pow((g0 + i * gs - v) / h, 2))) * (1 / sqrt(2 * pi())) / (n * h) as density
from gr join dv on gr.y_true = dv.y_true group by gr.y_true, i, g0, gs, n, h""", ["x", "density"]))
def q_kde_scores(spark, sf):
    return rounded(dist.kde(_scored(spark, sf), "y_score", ["y_true"]).withColumn("i", F.col("i").cast("int")))


# ------------------------------------------------------------------ A11–A13 correlations

from ..functions.features import NUMERIC_FEATURES  # noqa: E402
from ..operators import correlation as corr  # noqa: E402
from .queries import _PAGES_FEATURES, _page_features  # noqa: E402

_CORR_COLS = list(NUMERIC_FEATURES)


def _corr_matrix_sql(src: str, cols, ranked: bool) -> str:
    if ranked:
        rank_cols = ", ".join(
            f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in cols)
        src_sql = f"(select {rank_cols} from {src})"
    else:
        src_sql = src
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"select '{a}' as x, '{b}' as y, corr({a}::double, {b}::double) as r from {src_sql} t")
    return ("select x, y, case when isnan(r) then null else r end as r from ("
            + " union all ".join(parts) + ")")


@register("corr_pearson", sql_round(_PAGES_FEATURES + " " + _corr_matrix_sql("ff", _CORR_COLS, False), ["r"]))
def q_corr_pearson(spark, sf):
    return rounded(corr.pearson(_page_features(spark, sf), _CORR_COLS))


@register("corr_spearman", sql_round(_PAGES_FEATURES + " " + _corr_matrix_sql("ff", _CORR_COLS, True), ["r"]))
def q_corr_spearman(spark, sf):
    return rounded(corr.spearman(_page_features(spark, sf), _CORR_COLS))


_KENDALL_COLS = ["quality", "toxic", "n_chars"]


def _kendall_sql() -> str:
    parts = []
    for a in _KENDALL_COLS:
        for b in _KENDALL_COLS:
            parts.append(f"""select '{a}' as x, '{b}' as y,
  (sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) / 2.0) /
  sqrt((count(*) / 2.0 - sum(case when p.{a} = q.{a} then 1 else 0 end) / 2.0)
     * (count(*) / 2.0 - sum(case when p.{b} = q.{b} then 1 else 0 end) / 2.0)) as r
from lj p join lj q on p.rid <> q.rid""")
    return ("WITH lj as (select row_number() over () as rid, l.quality::double as quality, "
            "l.toxic::double as toxic, d.n_chars::double as n_chars from labels l join documents d "
            "on l.doc_id = d.doc_id) select x, y, case when isnan(r) then null else r end as r from ("
            + " union all ".join(parts) + ")")


@register("corr_kendall", sql_round(_kendall_sql(), ["r"]))
def q_corr_kendall(spark, sf):
    lj = views.table(spark, sf, "labels").join(views.table(spark, sf, "documents"), "doc_id")
    return rounded(corr.kendall(lj, _KENDALL_COLS))


# ------------------------------------------------------------------ S1–S6 on files derived from ``events``

@register("bundle_from_dumps", f"""WITH
ev as (select event_id, user_id, event_type, case when event_type = 'error' then 1 else 0 end as label,
  case when event_type = 'error' then 2 when ts < timestamp '{_CUT}' then 0 else 1 end as file_ord from events),
fp as (select *, row_number() over (partition by file_ord order by event_id) - 1 as fpos from ev),
n as (select count(*) filter (where file_ord = 1) as n1 from ev)
select case when file_ord = 0 then 'lm_train' else 'inference' end as split,
  cast(case when file_ord = 2 then fpos + n1 else fpos end as bigint) as pos,
  'GET' as method, concat('/shop/', event_type, '?u=', cast(user_id as varchar)) as target,
  'HTTP/1.1' as version, 1 as n_headers, 'X-E' as header_name, cast(event_id as varchar) as header_value,
  cast(label as integer) as label
from fp, n""")
def q_bundle_from_dumps(spark, sf):
    """Dumps written from ``events`` as part-file directories, read back through
    the file reader (split-safe block numbering) and the bundle loader."""
    from .pipeline import scratch_dir, write_event_dumps
    from ..sources.dumps import load_bundle

    out = write_event_dumps(spark, sf, scratch_dir(spark, "dumps"))
    b = load_bundle(spark, out)
    return b.select("split", "pos", "method", "target", "version",
                    F.size("headers").alias("n_headers"),
                    F.col("headers")[0]["name"].alias("header_name"),
                    F.col("headers")[0]["value"].alias("header_value"), "label")


@register("manifest_check", f"""WITH
ev as (select case when event_type = 'error' then 'anomalousTrafficTest.txt' when ts < timestamp '{_CUT}' then 'normalTrafficTraining.txt'
  else 'normalTrafficTest.txt' end as name from events),
n as (select name, count(*) as n from ev group by name)
select w.name, case when w.name = 'missing.txt' then 'missing' when coalesce(n.n, 0) >= 0 then 'ok' end as status
from (values ('normalTrafficTraining.txt'), ('normalTrafficTest.txt'), ('anomalousTrafficTest.txt'), ('missing.txt')) w(name)
left join n using (name)""")
def q_manifest_check(spark, sf):
    """S6 on dumps written from ``events`` (each holds at least its two leading lines) and one that is not there."""
    from .pipeline import scratch_dir, write_event_dumps
    from ..sources.dumps import CSIC_FILES, manifest_status

    out = write_event_dumps(spark, sf, scratch_dir(spark, "dumps"))
    return manifest_status(spark, out, [f[0] for f in CSIC_FILES] + ["missing.txt"])
