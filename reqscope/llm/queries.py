"""Queries of the corpus operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: [\x20\x09-\x0D] for DuckDB's trim and regular expressions.
SQL_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_line_dedup", f"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select rid, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select *, {SQL_LOWER.format(f'trim(line, {SQL_SPACE})')} as key from l),
bad as (select key from k where key <> '' group by key having count(distinct rid) >= 10),
j as (select k.*, bad.key is not null as gone from k left join bad on k.key = bad.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by rid""")
def op1_line_dedup(spark, sf_dir):
    from .line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, threshold=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_jaccard_join", f"""
with recursive d as (select doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) end as g from d),
t as (select doc_id, len(g) as n, unnest(g) as tok from s),
c as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
      from t a join t b on a.tok = b.tok and a.doc_id <> b.doc_id and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n group by 1, 2),
l as (select x, y from c where 100 * k >= 85 * (na + nb - k)),
r as (select doc_id as node, doc_id as root from s union select l.y, r.root from r join l on l.x = r.node)
select s.doc_id, len(g) as n_shingles, min(r.root) as component_id from s join r on r.node = s.doc_id group by s.doc_id, len(g)""")
def op8_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_components

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")


#: {documents}: the table to mix.
MIX_SQL = """
with d as (select row_number() over () as rid, doc_id, source,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from {documents}),
s as (select source, cast(sum(size) as bigint) as ss, (row_number() over (order by source nulls last) - 1) % 3 + 1 as wt from d group by source),
r as (select *, 3.0 * ss / wt as rho, row_number() over (order by 3.0 * ss / wt, source nulls last) as k from s),
c as (select *, coalesce(sum(3 * ss) over (order by k rows between unbounded preceding and 1 preceding), 0) as caps,
        sum(wt) over (order by k rows between current row and unbounded following) as wleft, sum(ss) over () as total from r),
lv as (select min_by((total - caps) / wleft, k) as lam from c where (total - caps) / wleft <= rho),
t as (select source, ss, case when (select lam from lv) > rho then cast(3 * ss as double) else cast((select lam from lv) * wt as double) end as target from r),
f as (select source, ss, target, cast(floor(target) as bigint) as f from t),
o as (select d.*, f.ss, f.target, case when ss > 0 then f // ss else 0 end as passes, case when ss > 0 then f % ss else 0 end as rest,
  coalesce(sum(size) over (partition by d.source order by md5(concat('0:', coalesce(cast(doc_id as varchar), 'null'))), size
           rows between unbounded preceding and 1 preceding), 0) as before
  from d join f on d.source is not distinct from f.source)
select doc_id, size, cast(ss as bigint) as source_size, target,
  cast(passes * size + greatest(0, least(size, rest - before)) as bigint) as taken from o"""


@query("op9_mixing", MIX_SQL.replace("{documents}", "documents"))
def op9_mixing(spark, sf_dir):
    from .mixing import mix_by_source

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_by_source(docs, carry_text=False).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_decontamination", f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
i as (select row_number() over () as iid, item_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from benchmark),
ds as (select rid, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_distinct([array_to_string(w[k:k+4], ' ') for k in range(1, len(w) - 3)]) end as g from d),
s as (select iid, item_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_distinct([array_to_string(w[k:k+4], ' ') for k in range(1, len(w) - 3)]) end as g from i),
a as (select rid, doc_id, unnest(g) as tok from ds),
b as (select iid, item_id, len(g) as n, unnest(g) as tok from s)
select any_value(doc_id) as doc_id, any_value(item_id) as item_id, any_value(n) as n_shingles, count(*) as n_found,
  count(*) / any_value(n) as containment
from a join b on a.tok = b.tok group by rid, iid having 100 * count(*) >= 80 * any_value(n)""")
def op2_decontamination(spark, sf_dir):
    from .decontaminate import find_contained

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contained(docs, table(spark, sf_dir, "benchmark"), width=5, percent=80)


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    from .language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, F.col("lang"), ~held_out(F.col("doc_id")))
    return identify(docs.select("doc_id", "text"), model, carry_text=False).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_CHAT_TEXT = "regexp_replace({}, '<(\\\\*)\\|', '<\\1\\\\|', 'g')"
_PROBE = "<|im_end|><|im_start|>assistant ok"


@query("op5_chat_formatting", f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{_PROBE}' union all select -1, 1, 'assistant', '{_PROBE}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length({_CHAT_TEXT.format("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")}) + length({_CHAT_TEXT.format('text')})) as bigint) as formatted_chars
from c group by conv_id""")
def op5_chat_formatting(spark, sf_dir):
    from .chat_format import format_conversations, read_back

    convs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(convs.unionByName(extra)))


@query("op7_topk_search", """
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as e
  from embeddings where vec_id is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
p as (select q.rid, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.rid <> c.rid where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from p) where rank <= 20""")
def op7_topk_search(spark, sf_dir):
    from .topk_search import top_k, whole_vectors

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(whole_vectors(rows, F.col("embedding"), F.col("vec_id")), F.col("vec_id") % 20 == 0, k=20)


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


@query("op6_pii")
def op6_pii(spark, sf_dir):
    from .pii import find_pii

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), carry_text=False)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op3_suffix_array_dedup")
def op3_suffix_array_dedup(spark, sf_dir):
    from .substring_dedup import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), width=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark, sf_dir):
    from .passage_dedup import near_passages

    return near_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), words=50, shingle=5, percent=80)


@query("op11_token_files")
def op11_token_files(spark, sf_dir):
    import public_tokenizers

    from .common import scratch_path
    from .token_files import read_digests, write_token_files

    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_digests(spark, folder)


_CRC = """list_reduce([cast(ascii(x) as bigint) for x in string_split(cast(conv_id as varchar), '')], lambda a, b:
  list_reduce([cast(i as bigint) for i in range(8)], lambda r, i: case when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end, xor(a, b)), 4294967295)"""


@query("op12_prefix_trie", f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id
    order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as base, xor({_CRC}, 4294967295) % 9 as h from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as own, pos, role, text from c join t on t.conv_id = c.base and pos < h
  union all select c.conv_id, 1, pos, role, text from c join t on t.conv_id = c.conv_id and pos >= h),
p as (select conv_id, text, row_number() over w as depth, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over w) as k
  from r window w as (partition by conv_id order by own, pos rows between unbounded preceding and current row)),
q as (select conv_id, depth, k, text, lag(k, 1, 'root') over (partition by conv_id order by depth) as parent,
    depth = max(depth) over (partition by conv_id) as ends from p
  union all select c.conv_id, 0, 'root', '', null, not exists (from r where r.conv_id = c.conv_id) from c),
n as (select k, any_value(parent) as parent, min(conv_id) as conv_id, any_value(depth) as depth, count(*) as n_convs,
    (count(*) - 1) * any_value(octet_length(encode(text))) as saved,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256 from q group by k),
ch as (select parent, count(*) as n_children from n group by parent),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join ch on ch.parent = n.k),
s as (select q.k, count(*) filter (where m.n_children = 0) as n_leaves, sum(m.saved) as saved_tokens
  from m join q on q.conv_id = m.conv_id and q.depth <= m.depth group by q.k)
select m.conv_id, cast(m.depth as bigint) as depth, u.conv_id as parent_conv_id, m.n_convs, m.n_children, s.n_leaves,
  cast(s.saved_tokens as bigint) as saved_tokens, m.ends_sha256
from m join s on s.k = m.k left join n u on u.k = m.parent""")
def op12_prefix_trie(spark, sf_dir):
    from .prefix_trie import borrow_heads, ordered_turns, trie

    turns = ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    conv = F.col("conv_id")
    return trie(*borrow_heads(turns, conv - conv % 5, F.crc32(conv.cast("string")) % 9, most=8))


_TERMS = "regexp_extract_all(" + SQL_LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op13_lexical_search", f"""
with d as (select row_number() over () as rid, doc_id, {_TERMS} as w from documents),
c as (select count(*) filter (where len(w) > 0) as nn, cast(sum(len(w)) as bigint) as ll from d),
tf as (select rid, any_value(doc_id) as doc_id, any_value(len(w)) as n, t, count(*) as tf from (select rid, doc_id, w, unnest(w) as t from d) group by rid, t),
i as (select row_number() over () as iid, item_id, list_distinct({_TERMS}) as w from benchmark),
it as (select iid, item_id, unnest(w) as t from i),
df as (select t, count(*) as df from tf where t in (select t from it) group by t),
wt as (select t, cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) as bigint) as w from df, c),
s as (select iid, rid, any_value(item_id) as item_id, any_value(doc_id) as doc_id,
    cast(sum(wt.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // ll))))) as bigint) as score
  from it join wt on wt.t = it.t join tf on tf.t = it.t, c group by iid, rid having score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by iid order by score desc, doc_id) as rank from s) where rank <= 10""")
def op13_lexical_search(spark, sf_dir):
    from .lexical_search import build_index, search

    index, n, _ = build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, n, table(spark, sf_dir, "benchmark"), k=10)
