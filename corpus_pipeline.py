"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet to
the shared scratch folder and read again as the documents of the next one.

1. language_id      documents that the prototypes can give no language, as they have no letters, go;
                    without any labelled text there are no prototypes and all texts with letters stay.
2. line_dedup       lines that 10 documents or more have go from every document.
3. jaccard_join     of documents that are linked by near copies (5-word shingles, Jaccard 0.8
                    or more), the one with the smallest doc_id stays.
4. decontamination  documents that contain a benchmark item (0.8 of its 5-word shingles) go.
5. mixing           words to take of each document so that sources meet their targets.

Stages 1 to 4 return the columns of documents, whatever these are called; n_chars follows the text that line dedup left.
A document that loses all lines stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqscope.llm.common import aside, restored, scratch
from reqscope.llm.decontaminate import drop_contained
from reqscope.llm.jaccard_join import keep_one
from reqscope.llm.language_id import held_out, identify, train
from reqscope.llm.line_dedup import dedup_lines
from reqscope.llm.mixing import mix_by_source


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, docs["lang"], ~held_out(docs["doc_id"]))
    if not model.langs:  # nothing to learn from: whatever has letters stays
        return docs.where(F.coalesce(docs["text"], F.lit("")).rlike(r"\p{L}"))
    return restored(identify(aside(docs, "text"), model).where("lang_pred <> 'und'"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(aside(docs, "text", "doc_id"), threshold=10)
    return restored(out, docs.columns, n_chars=F.length("text").cast("long"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_by_source(docs.select("doc_id", "source", "text"), carry_text=False).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _shingles(rows: str, key: str) -> str:
    return f"""(select {key}, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_distinct([array_to_string(w[k:k+4], ' ') for k in range(1, len(w) - 3)]) end as g
    from (select {key}, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from {rows}))"""


#: A text is rejected by stage 1 if and only if it has no letter (labelled texts exist).
ORACLE_SQL = f"""
with recursive s1 as (select row_number() over () as rid, * from documents where regexp_matches(coalesce(text, ''), '\\p{{L}}')),
ln as (select rid, doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from s1),
lk as (select *, {_LOWER.format(f'trim(line, {_SPACE})')} as key from ln),
bad as (select key from lk where key <> '' group by key having count(distinct rid) >= 10),
s2 as (select rid, any_value(doc_id) as doc_id, any_value(source) as source,
         coalesce(string_agg(line, chr(10) order by pos) filter (where bad.key is null), '') as text
       from lk left join bad on lk.key = bad.key group by rid),
g2 as {_shingles("s2", "rid, doc_id")},
t2 as (select doc_id, len(g) as n, unnest(g) as tok from g2),
pr as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
       from t2 a join t2 b on a.tok = b.tok and a.doc_id <> b.doc_id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by 1, 2),
lk2 as (select x, y from pr where 100 * k >= 80 * (na + nb - k)),
rt as (select doc_id as node, doc_id as root from s2 union select lk2.y, rt.root from rt join lk2 on lk2.x = rt.node),
s3 as (select s2.* from s2 join (select node, min(root) as root from rt group by node) m on m.node = s2.doc_id and m.root = s2.doc_id),
bm as (select row_number() over () as iid, text from benchmark),
gb as {_shingles("bm", "iid")},
tb as (select iid, len(g) as n, unnest(g) as tok from gb),
g3 as {_shingles("s3", "rid")},
t3 as (select rid, unnest(g) as tok from g3),
leak as (select distinct rid from (select rid, iid from t3 join tb on t3.tok = tb.tok group by rid, iid having 100 * count(*) >= 80 * any_value(n))),
s4 as (select doc_id, source, text from s3 where rid not in (select rid from leak)),
m as ({{mix}})
select m.doc_id, s4.source, m.size, m.source_size, m.target, m.taken from m join s4 on m.doc_id = s4.doc_id"""


def _oracle() -> str:
    from reqscope.llm.queries import MIX_SQL

    return ORACLE_SQL.replace("{mix}", MIX_SQL.replace("{documents}", "s4"))


ORACLE_SQL = _oracle()
