"""Column expressions over the request structure (request line, headers, body).

Every function returns a ``Column`` so a whole parse is one fused projection:
no UDF, no shuffle, whole-stage codegen where Spark supports it (higher-order
functions run interpreted inside the same stage).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, is_blank, ustrip

# Fixed values that must equal the reference: the HTTP methods that open a
# request block, and the display clip length.
REQUEST_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT")
DISPLAY_CLIP = 160

_METHODS_ALT = "|".join(REQUEST_METHODS)
# A line opens a block when it starts with a method, a word boundary, and holds
# "HTTP/<digit>" later on the same line.  (?U): Unicode \b and \d as in Python.
REQUEST_LINE_RE = f"(?U)^(?:{_METHODS_ALT})\\b[^\\n]*\\bHTTP/\\d"
# The same test as a split point inside a multi-line text: an LF followed by a
# request line.
REQUEST_BOUNDARY_RE = f"(?U)\\n(?=(?:{_METHODS_ALT})\\b[^\\n]*\\bHTTP/\\d)"

_NWS = r"[^\s\x1c-\x1f]"
_REQ_LINE_PARTS = f"(?sU)^{WS}*({_NWS}*){WS}*({_NWS}*){WS}*(.*)$"

HEADER_TYPE = "array<struct<name:string,value:string>>"


def is_request_line(line: Column) -> Column:
    return line.rlike(REQUEST_LINE_RE)


def split_lines(text: Column, strip_cr: bool = True) -> Column:
    """LF split; with ``strip_cr`` every trailing CR of each line is removed."""
    lines = F.split(text, "\n", -1)
    if strip_cr:
        lines = F.transform(lines, lambda x: F.when(x.contains("\r"), F.regexp_replace(x, "\r+$", "")).otherwise(x))
    return lines


def strip_trailing_blanks(lines: Column) -> Column:
    """Drop blank (whitespace-only) lines at the end of a block.

    ``lines`` should be a column reference (it is used three times)."""
    from_end = F.array_position(F.reverse(F.transform(lines, lambda x: ~is_blank(x))), True)
    keep = F.size(lines) - from_end + F.lit(1)
    return F.when(from_end > 0, F.slice(lines, 1, keep)).otherwise(F.array().cast("array<string>"))


def with_block_lines(df, text: Column, out: str = "lines", strip_cr: bool = True):
    """Add ``out`` = LF-split, CR-stripped lines of ``text`` without trailing blanks."""
    return (df.withColumn("_raw_lines", split_lines(text, strip_cr))
            .withColumn(out, strip_trailing_blanks(F.col("_raw_lines")))
            .drop("_raw_lines"))


def request_line_parts(line: Column) -> tuple[Column, Column, Column]:
    """``line.split(maxsplit=2)`` padded with ``''`` → (method, target, version)."""
    return (F.regexp_extract(line, _REQ_LINE_PARTS, 1),
            F.regexp_extract(line, _REQ_LINE_PARTS, 2),
            F.regexp_extract(line, _REQ_LINE_PARTS, 3))


def parse_header(line: Column) -> Column:
    """``Name: value`` split on the first ': ' else the first ':'; both sides stripped."""
    i2 = F.instr(line, ": ")
    i1 = F.instr(line, ":")
    rest = F.length(line) + F.lit(1)
    name = (F.when(i2 > 0, line.substr(F.lit(1), i2 - 1))
            .when(i1 > 0, line.substr(F.lit(1), i1 - 1))
            .otherwise(line))
    value = (F.when(i2 > 0, line.substr(i2 + 2, rest))
             .when(i1 > 0, line.substr(i1 + 1, rest))
             .otherwise(F.lit("")))
    return F.struct(ustrip(name).alias("name"), ustrip(value).alias("value"))


def parse_block_df(df, lines_col: str = "lines", keep_lines: bool = False):
    """Parse the (trailing-blank-stripped) block lines into request fields.

    Staged projections so each intermediate array is built once per row.
    """
    lines = F.col(lines_col)
    n = F.size(lines)
    staged = (df.withColumn("_first", F.element_at(lines, 1))
              .withColumn("_tail", F.slice(lines, 2, F.greatest(n - 1, F.lit(0)))))
    staged = staged.withColumn("_blank", F.array_position(F.transform("_tail", is_blank), True))
    method, target, version = request_line_parts(F.col("_first"))
    tail, blank = F.col("_tail"), F.col("_blank")
    header_lines = F.when(blank == 0, tail).otherwise(
        F.slice(tail, 1, F.greatest(blank - 1, F.lit(0)).cast("int")))
    body_lines = F.when(blank == 0, F.array().cast("array<string>")).otherwise(
        F.slice(tail, (blank + 1).cast("int"), F.greatest(F.size(tail), F.lit(1))))
    others = [c for c in df.columns if c != lines_col or keep_lines]
    return staged.select(
        *others,
        method.alias("method"), target.alias("target"), version.alias("version"),
        F.transform(header_lines, parse_header).alias("headers"),
        F.array_join(F.filter(body_lines, lambda x: ~is_blank(x)), "\n").alias("body"),
        F.array_join(lines, "\n").alias("raw"))


def request_line(method: Column, target: Column, version: Column) -> Column:
    """Non-empty parts joined by one space."""
    return F.array_join(F.filter(F.array(method, target, version), lambda x: x != ""), " ")


def header_map(headers: Column) -> Column:
    """Ordered (name, value) pairs → map; on duplicate names the last one wins."""
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(
        headers, empty,
        lambda m, h: F.map_concat(F.map_filter(m, lambda k, v: k != h["name"]),
                                  F.create_map(h["name"], h["value"])))


def to_lines(req_line: Column, headers: Column, body: Column, first_line_only: bool = False) -> Column:
    first = F.filter(F.array(req_line), lambda x: x != "")
    if first_line_only:
        return first
    hdr = F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return F.concat(first, hdr, F.filter(F.array(body), lambda x: x != ""))


def to_text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def clip(c: Column, n: int = DISPLAY_CLIP) -> Column:
    return F.substring(c, 1, n)


def with_request_text(requests, first_line_only: bool = False):
    """Add ``request_line``, ``lines`` and ``text`` to a parsed request DataFrame."""
    rl = request_line(F.col("method"), F.col("target"), F.col("version"))
    return (requests
            .withColumn("request_line", rl)
            .withColumn("lines", to_lines(F.col("request_line"), F.col("headers"), F.col("body"),
                                          first_line_only))
            .withColumn("text", to_text(F.col("lines"))))


def exploded_lines(requests, *keep, lines_col: str = "lines", no: str = "line_no", line: str = "line"):
    """One row a line with the ``keep`` columns, its number from 0 and its text.

    A plain explode has Spark test the size of the array below it, where every step of the parse
    that made the array is written out again for each of its uses; the outer one has no such test."""
    return requests.select(*keep, F.posexplode_outer(lines_col).alias(no, line)).where(F.col(no).isNotNull())
