"""DuckDB SQL for each registered query (the correctness oracle).

Written independently of the Spark code: list lambdas, window functions and
RE2 regexes over the same parquet views.  Doubles are rounded to 6 places on
both sides.
"""

from __future__ import annotations

METHODS = "GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|TRACE|CONNECT"

REQ_PAGES = """
req_pages AS (
  select page_id as pos, method, target, body, label,
    concat(method, ' ', target, ' HTTP/1.1', chr(10), 'Host: h', chr(10), 'X-Id: ', cast(page_id as varchar),
      case when page_id % 5 = 0 then concat(chr(10), 'X-Id: again') else '' end,
      case when body <> '' then concat(chr(10), chr(10), body) else '' end) as raw
  from (select page_id,
      case when page_id % 3 = 0 then 'POST' else 'GET' end as method,
      concat(url, case when page_id % 7 = 1 then '?q=1'' or 1=1--' else '' end,
                  case when page_id % 11 = 2 then '/%3Cscript%3E' else '' end) as target,
      coalesce(html, '') as body,
      case when page_id % 7 = 1 or page_id % 11 = 2 then 1 else 0 end as label
    from pages) x
)"""

REQ_EVENTS = """
req_events AS (
  select event_id as pos,
    concat('GET /shop/', event_type, '?u=', cast(user_id as varchar), ' HTTP/1.1') as request_line,
    concat('GET /shop/', event_type, '?u=', cast(user_id as varchar), ' HTTP/1.1', chr(10),
           'X-E: ', cast(event_id as varchar)) as raw,
    case when event_type = 'error' then 1 else 0 end as label
  from events
)"""

BLANK = r"regexp_matches({x}, '^\s*$')"


def parse_cte(name: str, src: str, cols: str = "pos, label") -> str:
    """CTE ``name`` parsing ``src.raw`` (one block per row) into request fields."""
    nb = BLANK.format(x="x")
    return f"""
{name}_l AS (
  select {cols}, string_split(raw, chr(10)) as l0 from {src}
),
{name}_t AS (
  select {cols}, l0[1 : len(l0) - coalesce(list_position(list_reverse(
      list_transform(l0, lambda x: not {nb})), true), len(l0) + 1) + 1] as lines
  from {name}_l
),
{name}_b AS (
  select {cols}, lines, lines[1] as rl, lines[2:] as tail,
    list_position(list_transform(lines[2:], lambda x: {nb}), true) as blank
  from {name}_t
),
{name} AS (
  select {cols},
    regexp_extract(rl, '(?s)^\\s*(\\S*)\\s*(\\S*)\\s*(.*)$', 1) as method,
    regexp_extract(rl, '(?s)^\\s*(\\S*)\\s*(\\S*)\\s*(.*)$', 2) as target,
    regexp_extract(rl, '(?s)^\\s*(\\S*)\\s*(\\S*)\\s*(.*)$', 3) as version,
    case when blank is null or blank = 0 then tail else tail[1 : blank - 1] end as hl,
    case when blank is null or blank = 0 then ''
         else array_to_string(list_filter(tail[blank + 1 :], lambda x: not {nb}), chr(10)) end as body,
    array_to_string(lines, chr(10)) as raw
  from {name}_b
)"""


HEADER_PAIRS = """list_transform(hl, lambda x: case
    when position(': ' in x) > 0 then struct_pack(
        name := regexp_replace(x[1 : position(': ' in x) - 1], '^\\s+|\\s+$', '', 'g'),
        value := regexp_replace(x[position(': ' in x) + 2 :], '^\\s+|\\s+$', '', 'g'))
    when position(':' in x) > 0 then struct_pack(
        name := regexp_replace(x[1 : position(':' in x) - 1], '^\\s+|\\s+$', '', 'g'),
        value := regexp_replace(x[position(':' in x) + 1 :], '^\\s+|\\s+$', '', 'g'))
    else struct_pack(name := regexp_replace(x, '^\\s+|\\s+$', '', 'g'), value := '') end)"""


def features_cte(name: str, src: str) -> str:
    """CTE ``name``: the 16 features + pos from parsed requests ``src`` (method, target, body, hl)."""
    return f"""
{name}_x AS (
  select pos, method, target, body, hl, label, target || body as blob from {src}
),
{name}_ent AS (
  select pos, case when sum(c) is null then 0.0
     else -sum((c / n) * log2(c / n) order by c) end as h
  from (select pos, ch, count(*)::double as c, any_value(n)::double as n
        from (select pos, unnest(string_split(blob, '')) as ch, length(blob) as n from {name}_x)
        group by pos, ch)
  group by pos
),
{name} AS (
  select x.pos, method,
    cast(length(target) as integer) as target_length,
    cast(length(body) as integer) as body_length,
    cast(len(hl) as integer) as n_headers,
    cast(case when position('?' in target) > 0
         then len(list_filter(string_split(target[position('?' in target) + 1 :], '&'), lambda s: s <> ''))
         else 0 end as integer) as n_query_params,
    cast(len(list_filter(string_split(regexp_extract(target,
         '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), lambda s: s <> '')) as integer)
      as path_depth,
    cast(case when body <> '' then 1 else 0 end as integer) as has_body,
    cast(length(blob) - length(replace(blob, '%', '')) as integer) as pct_encoding_count,
    (length(blob) - length(replace(blob, '%', ''))) / greatest(length(blob), 1)::double as pct_encoding_ratio,
    case when length(blob) > 0 then len(regexp_extract_all(blob, '\\p{{Nd}}')) / length(blob)::double
         else 0.0 end as digit_ratio,
    case when length(blob) > 0 then len(regexp_extract_all(blob, '\\p{{Lu}}')) / length(blob)::double
         else 0.0 end as upper_ratio,
    case when length(blob) > 0 then len(regexp_extract_all(blob, '[^\\p{{L}}\\p{{N}}]')) / length(blob)::double
         else 0.0 end as non_alnum_ratio,
    case when coalesce(e.h, 0.0) <= 0 then 0.0 else e.h end as shannon_entropy,
    cast(case when contains(lower(blob), 'select') or contains(lower(blob), 'union')
           or contains(lower(blob), 'drop') or contains(lower(blob), 'insert')
           or contains(lower(blob), '--') or contains(lower(blob), ';')
           or contains(lower(blob), 'or ') or contains(lower(blob), ''' or') then 1 else 0 end as integer)
      as contains_sql_keyword,
    cast(case when contains(lower(blob), '<script') or contains(lower(blob), '%3cscript') then 1 else 0 end
         as integer) as contains_script_tag,
    cast(label as integer) as label
  from {name}_x x left join {name}_ent e on x.pos = e.pos
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
