"""Queries for pre-tokens, BPE, masking, the n-gram LM and char TF-IDF (K1–K9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bpe
from ..operators import lm
from ..operators import splits as sp
from ..sources import views
from . import oracle as O
from .queries import register, rounded, sql_round

SEED = 42
MAX_LEN = 512  # fixed value: the reference's sequence length


def _byte_id_list_sql() -> str:
    vocab = bpe.initial_vocab()
    index = {t: i for i, t in enumerate(vocab)}
    b2u = bpe.byte_to_unicode()
    return "[" + ", ".join(str(index[b2u[b]]) for b in range(256)) + "]"


#: A run of spaces before a word gives its last character to the word's token (chr(1) marks the place).
@register("pretoken_counts", r"""
with d as (select regexp_replace(text, '(\s)(\s)([^\s])', '\1' || chr(1) || '\2\3', 'g') as t from documents),
p as (select unnest(regexp_extract_all(t, $$'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+$$)) as pretoken from d)
select pretoken, count(*) as n from p group by pretoken""")
def q_pretoken_counts(spark, sf):
    """K2 over all documents (checked against the public pre-tokenizer in tests)."""
    return bpe.pretoken_counts(views.table(spark, sf, "documents"), "text")


@register("bpe_merges")
def q_bpe_merges(spark, sf):
    """K1 on all documents, vocabulary 1000 (merge list checked against the public trainer in tests)."""
    model = bpe.train_bpe(views.table(spark, sf, "documents"), "text", vocab_size=1000, min_frequency=2)
    return model.merges_df(spark)


@register("bpe_encode")
def q_bpe_encode(spark, sf):
    """K3: request texts of req_events encoded with a vocabulary learned on them."""
    ev = views.req_events(spark, sf)
    model = bpe.train_bpe(ev.select(F.col("raw").alias("text")), "text", vocab_size=400, min_frequency=2)
    return bpe.encode(ev, model, "pos", "raw", max_length=MAX_LEN, pad=True)


def _byte_ids_spark(text_col: str):
    body = F.slice(bpe.byte_ids(F.col(text_col)), 1, MAX_LEN - 2)
    return F.concat(F.array(F.lit(0)), body, F.array(F.lit(2)))


_VOCAB = 261


@register("mlm_mask", "WITH " + O.REQ_EVENTS.strip() + f""",
tok as (select pos, list_concat([0], list_transform(regexp_extract_all(hex(encode(request_line)), '..'),
          lambda h: {_byte_id_list_sql()}[('0x' || h)::integer + 1])[1:{MAX_LEN - 2}], [2]) as ids
        from req_events),
m as (select pos, ids, list_transform(ids, lambda x, i: struct_pack(x := x,
          h := md5(concat('{SEED}:0:', cast(pos as varchar), ':', cast(i - 1 as varchar))))) as hs from tok),
u as (select pos, ids, list_transform(hs, lambda s: struct_pack(x := s.x,
          chosen := s.x >= 5 and ('0x' || substring(s.h, 1, 8))::bigint / 4294967296.0 < 0.15,
          u2 := ('0x' || substring(s.h, 9, 8))::bigint / 4294967296.0,
          rnd := (('0x' || substring(s.h, 17, 8))::bigint % {_VOCAB})::integer)) as us from m)
select pos, array_to_string(ids, ' ') as input_ids,
  array_to_string(list_transform(us, lambda s: case when not s.chosen then s.x when s.u2 < 0.8 then 4
     when s.u2 < 0.9 then s.rnd else s.x end), ' ') as masked_ids,
  array_to_string(list_transform(us, lambda s: case when s.chosen then s.x else -100 end), ' ') as labels
from u""")
def q_mlm_mask(spark, sf):
    ev = views.req_events(spark, sf).select("pos", _byte_ids_spark("request_line").alias("ids"))
    m = lm.mlm_mask(ev, "ids", "pos", vocab_size=_VOCAB, seed=SEED, epoch=0)
    return m.select("pos", F.array_join("ids", " ").alias("input_ids"),
                    F.array_join("masked_ids", " ").alias("masked_ids"),
                    F.array_join("labels", " ").alias("labels"))


def _lm_sql() -> str:
    return "WITH " + O.REQ_EVENTS.strip() + f""",
nrm as (select pos from req_events where label = 0),
vk as (select count(*) as n, greatest(1, round_even(count(*) * 0.05, 0)) as k from nrm),
val as (select pos from (select pos, row_number() over (order by md5(concat('{SEED}:', cast(pos as varchar))))
        as rn from nrm), vk where vk.n >= 20 and rn <= vk.k),
lab as (select e.pos, e.raw, e.label, case when e.label = 1 then 'anomalous' when v.pos is not null then 'val'
        else 'train' end as split from req_events e left join val v on e.pos = v.pos),
seqs as (select pos, split, list_concat([chr(2), chr(2)], string_split(raw, ''), [chr(3)]) as s from lab),
g as (select pos, split, s[i] as c0, s[i + 1] as c1, s[i + 2] as tok
      from (select pos, split, s, unnest(range(1, len(s) - 1)) as i from seqs)),
joint as (select c0, c1, tok, count(*) as nj from g where split = 'train' group by c0, c1, tok),
ctx as (select c0, c1, count(*) as nc from g where split = 'train' group by c0, c1),
v as (select count(distinct tok) + 1 as vsize from g where split = 'train'),
sc as (select g.pos, g.split, -ln((coalesce(j.nj, 0) + 1.0) / (coalesce(c.nc, 0) + 1.0 * v.vsize)) as nll
       from g left join joint j on g.c0 = j.c0 and g.c1 = j.c1 and g.tok = j.tok
       left join ctx c on g.c0 = c.c0 and g.c1 = c.c1 cross join v),
per as (select pos, split, count(*) as n_tokens, avg(nll) as loss from sc group by pos, split)
select split, sum(n_tokens) as n_tokens, sum(loss * n_tokens) / sum(n_tokens) as loss,
  exp(least(greatest(sum(loss * n_tokens) / sum(n_tokens), 0.0), 50.0)) as perplexity
from per group by split"""


@register("ngram_lm_perplexity", sql_round(_lm_sql(), ["loss", "perplexity"]))
def q_ngram_lm_perplexity(spark, sf):
    ev = views.req_events(spark, sf)
    normal = sp.validation_split(ev.where(F.col("label") == 0).select("pos"), 0.05, SEED)
    lab = ev.join(normal, "pos", "left").select(
        "pos", "raw", F.when(F.col("label") == 1, "anomalous").when(F.col("is_val"), "val")
        .otherwise("train").alias("split"))
    model = lm.NgramLM(order=3, k=1.0).fit(lab.where(F.col("split") == "train"), "pos", "raw")
    scores = model.score(lab, "pos", "raw", keep=("split",))
    return rounded(lm.split_perplexity(scores, "split"))


def _tfidf_sql() -> str:
    from .queries_ml import _holdout_quota_sql, _holdout_rows_sql

    grams = " union all ".join(
        f"select pos, train, substring(t, i, {n}) as gram from (select pos, train, t, "
        f"unnest(range(1, greatest(length(t) - {n} + 2, 1))) as i from an)"
        for n in (3, 4, 5))
    return ("WITH " + O.REQ_PAGES.strip() + "," + _holdout_quota_sql("req_pages", "label") + ","
            + _holdout_rows_sql("req_pages", "label") + f""",
an as (select pos, split = 'train' as train,
       regexp_replace(lower(raw), '\\s\\s+', ' ', 'g') as t from split_rows),
gr as ({grams}),
tf as (select pos, train, gram, count(*) as tf from gr group by pos, train, gram),
nt as (select count(*) as n from an where train),
dfq as (select gram, count(*) as df from tf where train group by gram),
idf as (select gram, ln((1.0 + n) / (1.0 + df)) + 1.0 as idf from dfq, nt),
w as (select tf.pos, tf.gram, tf.tf * idf.idf as w from tf join idf on tf.gram = idf.gram),
nr as (select pos, sqrt(sum(w * w)) as nrm from w group by pos)
select w.pos, w.gram, w.w / nr.nrm as tfidf from w join nr on w.pos = nr.pos""")


@register("char_tfidf", sql_round(_tfidf_sql(), ["tfidf"]))
def q_char_tfidf(spark, sf):
    rp = views.req_pages(spark, sf)
    split = sp.holdout_split(rp, "label", "pos", 0.3, SEED)
    return rounded(lm.char_tfidf(split, "pos", "raw", F.col("split") == "train"))
