"""Registered queries: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` SQL.

Every query reads the driver tables (or views Spark derives from them) in
full.  Doubles are rounded to 6 places in both the Spark result and the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import request as rq
from ..functions.features import FEATURE_COLUMNS, NUMERIC_FEATURES, feature_frame, with_entropy
from ..operators import quality as qa
from ..sources import views
from ..sources.dumps import parse_dump_column
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

R = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = R) -> DataFrame:
    """Round every double column (the compare is on values)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def sql_round(sql: str, cols: list[str], digits: int = R) -> str:
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _q"


def _pages(spark, sf):
    return rq.with_request_text(views.page_requests(spark, sf))


def _events(spark, sf):
    return rq.with_request_text(views.event_requests(spark, sf))


_PAGES_PARSED = O.with_ctes(O.REQ_PAGES, O.parse_cte("pp", "req_pages"))
_EVENTS_PARSED = O.with_ctes(O.REQ_EVENTS, O.parse_cte("pe", "req_events"))
_REQ_LINE_SQL = ("array_to_string(list_filter([method, target, version], lambda s: s <> ''), ' ')")

# ------------------------------------------------------------------ S2–S4, P1–P4


@register("parse_blocks", O.with_ctes(O.REQ_PAGES, f"""
dumps AS (
  select pos // 10 as dump_id, string_agg(raw, chr(10) order by pos) as dump from req_pages group by 1
),
dl AS (
  select dump_id, generate_subscripts(l, 1) as i, unnest(l) as line
  from (select dump_id, string_split(dump, chr(10)) as l from dumps)
),
ds AS (
  select dump_id, i, line,
    sum(case when regexp_matches(line, '^({O.METHODS})\\b.*\\bHTTP/\\d') then 1 else 0 end)
      over (partition by dump_id order by i rows between unbounded preceding and current row) as block_no
  from dl
),
blk AS (
  select dump_id, block_no, array_to_string(list(line order by i), chr(10)) as raw
  from ds where block_no > 0 group by dump_id, block_no
)""", O.parse_cte("pb", "blk", "dump_id, block_no")) + f"""
select cast(dump_id as bigint) as dump_id, cast(block_no as bigint) as block_no, method, target, version,
  cast(len(hl) as integer) as n_headers,
  array_to_string(list_transform({O.HEADER_PAIRS}, lambda h: h.name || '=' || h.value), '|') as header_text,
  body, raw
from pb""")
def q_parse_blocks(spark, sf):
    rp = views.req_pages(spark, sf).withColumn("dump_id", F.floor(F.col("pos") / 10).cast("long"))
    dumps = rp.groupBy("dump_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]),
                     "\n").alias("dump"))
    blocks = parse_dump_column(dumps, "dump_id", "dump")
    return blocks.select(
        "dump_id", "block_no", "method", "target", "version",
        F.size("headers").cast("int").alias("n_headers"),
        F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), h["value"])), "|")
        .alias("header_text"),
        "body", "raw")


# ------------------------------------------------------------------ P5–P13

@register("request_lines", _PAGES_PARSED + f"""
select pos, {_REQ_LINE_SQL} as request_line, substring({_REQ_LINE_SQL}, 1, 160) as request_line_clip,
  cast(label as integer) as label from pp""")
def q_request_lines(spark, sf):
    r = _pages(spark, sf)
    return r.select("pos", "request_line", rq.clip(F.col("request_line")).alias("request_line_clip"), "label")


@register("to_text", _PAGES_PARSED + f"""
select pos,
  array_to_string(list_concat(list_filter([{_REQ_LINE_SQL}], lambda s: s <> ''),
     list_transform({O.HEADER_PAIRS}, lambda h: h.name || ': ' || h.value),
     list_filter([body], lambda s: s <> '')), chr(10)) as text,
  array_to_string(list_filter([{_REQ_LINE_SQL}], lambda s: s <> ''), chr(10)) as text_first_line
from pp""")
def q_to_text(spark, sf):
    r = _pages(spark, sf)
    first = rq.to_text(rq.to_lines(F.col("request_line"), F.col("headers"), F.col("body"), True))
    return r.select("pos", "text", first.alias("text_first_line"))


@register("header_map", _PAGES_PARSED + f"""
, hm AS (select pos, {O.HEADER_PAIRS} as hs from pp)
select pos,
  cast(len(list_distinct(list_transform(hs, lambda h: h.name))) as integer) as n_keys,
  list_filter(hs, lambda h: h.name = 'X-Id')[-1].value as x_id,
  list_filter(hs, lambda h: h.name = 'Host')[-1].value as host
from hm""")
def q_header_map(spark, sf):
    r = _pages(spark, sf).withColumn("hm", rq.header_map(F.col("headers")))
    return r.select("pos", F.size("hm").cast("int").alias("n_keys"),
                    F.try_element_at("hm", F.lit("X-Id")).alias("x_id"),
                    F.try_element_at("hm", F.lit("Host")).alias("host"))


@register("explode_lines", _PAGES_PARSED + f"""
, ls AS (
  select pos, list_concat(list_filter([{_REQ_LINE_SQL}], lambda s: s <> ''),
     list_transform({O.HEADER_PAIRS}, lambda h: h.name || ': ' || h.value),
     list_filter([body], lambda s: s <> '')) as lines from pp
)
select pos, cast(generate_subscripts(lines, 1) - 1 as integer) as line_no, unnest(lines) as line from ls""")
def q_explode_lines(spark, sf):
    r = _pages(spark, sf)
    return rq.exploded_lines(r, "pos")


# ------------------------------------------------------------------ F1–F17

_FEATURE_DOUBLES = ["pct_encoding_ratio", "digit_ratio", "upper_ratio", "non_alnum_ratio", "shannon_entropy"]
_PAGES_FEATURES = O.with_ctes(O.REQ_PAGES, O.parse_cte("pp", "req_pages"), O.features_cte("ff", "pp"))


def _page_features(spark, sf):
    return feature_frame(views.page_requests(spark, sf), keep=("pos",))


@register("features_all", sql_round(_PAGES_FEATURES + " select * from ff", _FEATURE_DOUBLES))
def q_features_all(spark, sf):
    return rounded(_page_features(spark, sf))


@register("entropy", sql_round("""
with d as (select doc_id, text, length(text) as n from documents),
c as (select doc_id, ch, count(*)::double as c, any_value(n)::double as n
      from (select doc_id, n, unnest(string_split(text, '')) as ch from d) group by doc_id, ch),
e as (select doc_id, -sum((c / n) * log2(c / n) order by c) as h from c group by doc_id)
select d.doc_id, case when coalesce(e.h, 0.0) <= 0 then 0.0 else e.h end as shannon_entropy
from d left join e on d.doc_id = e.doc_id""", ["shannon_entropy"]))
def q_entropy(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    return rounded(with_entropy(docs, "text").select("doc_id", "shannon_entropy"))


# ------------------------------------------------------------------ A3–A10

@register("class_balance", sql_round(_PAGES_PARSED + """
select cast(label as integer) as label, count(*) as n, count(*) / sum(count(*)) over () as share
from pp group by label""", ["share"]))
def q_class_balance(spark, sf):
    return rounded(qa.class_balance(views.page_requests(spark, sf)))


@register("method_crosstab", _PAGES_PARSED + """
select method, count(*) filter (where label = 0) as normal, count(*) filter (where label = 1) as anomalous
from pp group by method""")
def q_method_crosstab(spark, sf):
    return qa.crosstab(views.page_requests(spark, sf), "method")


def _describe_sql(features_sql: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"""select '{c}' as column, count({c}) as count, avg({c}::double) as mean,
  stddev_samp({c}::double) as std, min({c})::double as min,
  quantile_cont({c}::double, 0.25) as p25, quantile_cont({c}::double, 0.5) as p50,
  quantile_cont({c}::double, 0.75) as p75, max({c})::double as max from ff""")
    return sql_round(features_sql + " " + " union all ".join(parts),
                     ["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("describe_num", _describe_sql(_PAGES_FEATURES, NUMERIC_FEATURES))
def q_describe_num(spark, sf):
    return rounded(qa.describe(_page_features(spark, sf), list(NUMERIC_FEATURES)))


@register("percentiles", sql_round("""
select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90,
  quantile_cont(value, 0.99) as p99
from events where value is not null group by event_type""", ["p50", "p90", "p99"]))
def q_percentiles(spark, sf):
    from ..operators.ordered import exact_quantiles

    ev = views.table(spark, sf, "events").where(F.col("value").isNotNull())
    q = exact_quantiles(ev.select("event_type", "value"), "event_type", "value", [0.5, 0.9, 0.99])
    p = q.groupBy("event_type").pivot("prob", [0.5, 0.9, 0.99]).agg(F.first("q"))
    return rounded(p.select("event_type", F.col("`0.5`").alias("p50"), F.col("`0.9`").alias("p90"),
                            F.col("`0.99`").alias("p99")))


_APPROX_COLS, _APPROX_PROBS, _APPROX = ("l_quantity", "l_extendedprice", "l_discount"), (0.01, 0.25, 0.5, 0.9, 0.999), 1000


@register("percentiles_approx", " union all ".join(
    f"select '{c}' as \"column\", {p}::double as prob, count({c}) as n, true as within from lineitem" for c in _APPROX_COLS for p in _APPROX_PROBS))
def q_percentiles_approx(spark, sf):
    """A8 in bounded memory: whether each quantile's exact ranks lie within the stated bound."""
    from ..operators.ordered import approx_quantiles

    li = views.table(spark, sf, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _APPROX_COLS])
    found = approx_quantiles(li, _APPROX_COLS, _APPROX_PROBS, _APPROX).collect()  # a row per column and probability
    ranks = li.agg(*[F.struct(F.count(r["column"]).alias("n"), F.count_if(F.col(r["column"]) < r["q"]).alias("below"),
                              F.count_if(F.col(r["column"]) <= r["q"]).alias("upto")).alias(f"r{i}") for i, r in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(r["column"]).alias("column"), F.lit(float(r["prob"])).alias("prob"), F.col(f"r{i}").alias("r")) for i, r in enumerate(found)])
    out = ranks.select(F.explode(rows).alias("x")).select("x.column", "x.prob", "x.r.n", "x.r.below", "x.r.upto")
    slack, at = F.col("n") / _APPROX + 1, F.col("prob") * F.col("n")
    return out.select("column", "prob", "n", ((F.col("below") <= at + slack) & (F.col("upto") >= at - slack)).alias("within"))


def _const_sql(cols):
    parts = [f"""select '{c}' as column, cast(case when count(distinct {c}) + max(case when {c} is null then 1 else 0 end)
  <= 1 then 1 else 0 end as integer) as is_constant from ff""" for c in cols]
    return _PAGES_FEATURES + " " + " union all ".join(parts)


@register("constant_cols", _const_sql(FEATURE_COLUMNS))
def q_constant_cols(spark, sf):
    return qa.constant_columns(_page_features(spark, sf), list(FEATURE_COLUMNS))


def _missing_sql(cols, dbl):
    parts = []
    for c in cols:
        cond = f"{c} is null" + (f" or isnan({c})" if c in dbl else "")
        parts.append(f"select '{c}' as column, count(*) filter (where {cond}) as n_missing from ev")
    return "with ev as (select * from events) " + " union all ".join(parts)


_EVENT_COLS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@register("missing_cols", _missing_sql(_EVENT_COLS, {"value"}))
def q_missing_cols(spark, sf):
    return qa.missing_values(views.table(spark, sf, "events"), list(_EVENT_COLS))


@register("dup_rows", _PAGES_FEATURES + f"""
select count(*) as n_total, count(distinct ({", ".join(FEATURE_COLUMNS)})) as n_distinct,
  count(*) - count(distinct ({", ".join(FEATURE_COLUMNS)})) as n_duplicate_rows from ff""")
def q_dup_rows(spark, sf):
    return qa.duplicate_rows(_page_features(spark, sf), list(FEATURE_COLUMNS))


def _dup_cols_sql(cols):
    parts = []
    for j, b in enumerate(cols):
        expr = "''"
        for a in reversed(cols[:j]):
            expr = (f"case when bool_and(coalesce({a}::double = {b}::double, "
                    f"{a} is null and {b} is null)) then '{a}' else {expr} end")
        if j == 0:
            parts.append(f"select '{b}' as column, '' as duplicate_of")
        else:
            parts.append(f"select '{b}' as column, {expr} as duplicate_of from ff")
    return _PAGES_FEATURES + " " + " union all ".join(parts)


@register("dup_columns", _dup_cols_sql(list(NUMERIC_FEATURES)))
def q_dup_columns(spark, sf):
    return qa.duplicate_columns(_page_features(spark, sf), list(NUMERIC_FEATURES))


# ------------------------------------------------------------------ A1, A2, N1, A26

def _dup_sql(level: str, frm: str, key: str) -> str:
    return f"""select '{level}' as level, count(*) as n_total, count(distinct {key}) as n_unique,
  count(*) - count(distinct {key}) as n_duplicate,
  case when count(*) > 0 then (count(*) - count(distinct {key})) / count(*)::double else 0.0 end
    as duplicate_rate from {frm}"""


_EVENTS_FEATURES = O.with_ctes(O.REQ_EVENTS, O.parse_cte("pp", "req_events"), O.features_cte("ff", "pp"))


@register("dup_three_levels", sql_round(_EVENTS_FEATURES + ", pe2 as (select * from req_events) "
          + " union all ".join([
              _dup_sql("raw_text", "pe2", "raw"),
              _dup_sql("request_line", "pe2", "request_line"),
              _dup_sql("feature_fingerprint", "ff", "(" + ", ".join(FEATURE_COLUMNS) + ")")]),
          ["duplicate_rate"]))
def q_dup_three_levels(spark, sf):
    ff = feature_frame(_events(spark, sf), keep=("raw", "request_line"))
    return rounded(qa.duplicate_levels_of(ff, {"raw_text": "raw", "request_line": "request_line",
                                               "feature_fingerprint": list(FEATURE_COLUMNS)}))


@register("describe_all", """
with kv as (select 'lang' as column, lang as value from documents union all select 'source', source from documents
  union all select 'event_type', event_type from events),
c as (select "column", value, count(*) as n from kv where value is not null group by all),
r as (select *, row_number() over (partition by "column" order by n desc, value) as k from c)
select "column", cast(sum(n) as bigint) as count, count(*) as unique, min(value) filter (where k = 1) as top, max(n) as freq
from r group by 1""")
def q_describe_all(spark, sf):
    """A7 for text columns of two tables."""
    return qa.describe_text(views.table(spark, sf, "documents"), ["lang", "source"]).unionByName(
        qa.describe_text(views.table(spark, sf, "events"), ["event_type"]))


@register("unique_first", """
select min(event_id) as pos from events
group by concat('GET /shop/', event_type, '?u=', cast(user_id as varchar), ' HTTP/1.1')""")
def q_unique_first(spark, sf):
    return qa.unique_first(views.req_events(spark, sf), "request_line").select("pos")


@register("n_unique", "select count(distinct text) as n_unique from documents")
def q_n_unique(spark, sf):
    return qa.n_unique(views.table(spark, sf, "documents"), "text")


@register("dup_documents", sql_round(_dup_sql("text", "documents", "text"), ["duplicate_rate"]))
def q_dup_documents(spark, sf):
    return rounded(qa.duplicate_levels({"text": (views.table(spark, sf, "documents"), "text")}))
