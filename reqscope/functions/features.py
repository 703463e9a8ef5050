"""The 16-column descriptive feature frame (F1–F17) as one fused projection.

``blob = target + body``.  Attack signatures are fixed literal substrings
(``contains``), never regexes built from data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import code_points, count_matches, digit_class, non_alnum_class, upper_class

# Fixed values that must equal the reference: lower-cased signature substrings.
SQL_KEYWORDS = ("select", "union", "drop", "insert", "--", ";", "or ", "' or")
SCRIPT_PATTERNS = ("<script", "%3cscript")

FEATURE_COLUMNS = (
    "method", "target_length", "body_length", "n_headers", "n_query_params", "path_depth",
    "has_body", "pct_encoding_count", "pct_encoding_ratio", "digit_ratio", "upper_ratio",
    "non_alnum_ratio", "shannon_entropy", "contains_sql_keyword", "contains_script_tag", "label",
)
NUMERIC_FEATURES = FEATURE_COLUMNS[1:-1]

# scheme?  //authority?  path   (urlsplit order: fragment, then query, cut the path)
_URL_PARTS = r"(?s)^[\x00-\x20]*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)"


def n_query_params(target: Column) -> Column:
    q = target.substr(F.instr(target, "?") + 1, F.length(target) + 1)
    n = F.size(F.filter(F.split(q, "&", -1), lambda x: x != ""))
    return F.when(F.instr(target, "?") > 0, n).otherwise(F.lit(0)).cast("int")


def path_depth(target: Column) -> Column:
    """Non-empty '/' segments of the URL path; the whole target when urlsplit would fail."""
    authority = F.regexp_extract(target, _URL_PARTS, 1)
    path = F.regexp_extract(target, _URL_PARTS, 2)
    has_open = F.instr(authority, "[") > 0
    has_close = F.instr(authority, "]") > 0
    bracket_host = F.regexp_extract(authority, r"\[([^\]]*)\]", 1)
    bad_brackets = (has_open != has_close) | (
        has_open & has_close & ~bracket_host.rlike(r"^(?:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.%\w]*|[vV][0-9A-Fa-f]+\..+)$"))
    use = F.when(bad_brackets, target).otherwise(path)
    return F.size(F.filter(F.split(use, "/", -1), lambda x: x != "")).cast("int")


def char_runs(text: Column) -> Column:
    """Runs of equal code points after sorting: one string per distinct point."""
    ordered = F.array_join(F.sort_array(code_points(text)), "")
    return F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), 0)


def entropy_of_runs(runs: Column, n: Column) -> Column:
    """Base-2 entropy from the runs of a text of ``n`` code points (0 if empty).

    Terms -(c/n)·log2(c/n) are summed in ascending count order, so texts with
    the same count profile get bit-identical values.  No explode, no shuffle.
    """
    nd = n.cast("double")
    counts = F.sort_array(F.transform(runs, lambda r: F.length(r)))
    h = F.aggregate(counts, F.lit(0.0), lambda a, c: a - (c / nd) * F.log2(c / nd))
    return F.when(n > 0, F.greatest(h, F.lit(0.0))).otherwise(F.lit(0.0))


def with_entropy(df: DataFrame, text_col: str, out: str = "shannon_entropy") -> DataFrame:
    # the length is staged: referenced inside the per-run lambda, it must not be recomputed
    return (df.withColumn("_runs", char_runs(F.col(text_col))).withColumn("_n", F.length(text_col))
            .withColumn(out, entropy_of_runs(F.col("_runs"), F.col("_n"))).drop("_runs", "_n"))


def _contains_any(lower_blob: Column, needles) -> Column:
    cond = F.lit(False)
    for s in needles:
        cond = cond | F.contains(lower_blob, F.lit(s))
    return cond.cast("int")


def feature_frame(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Requests (request schema) → the fixed 16-column feature frame.

    ``keep`` carries extra columns (e.g. ``pos``) in front.  Staged so the blob,
    its length and its sorted code points are each computed once per row.
    """
    staged = requests.select(*[F.col(k) for k in keep], "method", "target", "body", "headers", "label",
                             F.concat("target", "body").alias("_blob"))
    staged = staged.select(
        "*", F.length("_blob").alias("_blen"), F.lower("_blob").alias("_lower"),
        char_runs(F.col("_blob")).alias("_runs"),
        count_matches(F.col("_blob"), "%").alias("_pct"))
    target, body, blen = F.col("target"), F.col("body"), F.col("_blen")

    def ratio(cnt):
        return F.when(blen > 0, cnt / blen).otherwise(F.lit(0.0)).cast("double")

    blob = F.col("_blob")
    return staged.select(
        *[F.col(k) for k in keep],
        F.col("method").alias("method"),
        F.length(target).cast("int").alias("target_length"),
        F.length(body).cast("int").alias("body_length"),
        F.size("headers").cast("int").alias("n_headers"),
        n_query_params(target).alias("n_query_params"),
        path_depth(target).alias("path_depth"),
        (body != "").cast("int").alias("has_body"),
        F.col("_pct").cast("int").alias("pct_encoding_count"),
        (F.col("_pct") / F.greatest(blen, F.lit(1))).cast("double").alias("pct_encoding_ratio"),
        ratio(count_matches(blob, "(?U)" + digit_class())).alias("digit_ratio"),
        ratio(count_matches(blob, upper_class())).alias("upper_ratio"),
        ratio(count_matches(blob, "(?U)" + non_alnum_class())).alias("non_alnum_ratio"),
        entropy_of_runs(F.col("_runs"), blen).alias("shannon_entropy"),
        _contains_any(F.col("_lower"), SQL_KEYWORDS).alias("contains_sql_keyword"),
        _contains_any(F.col("_lower"), SCRIPT_PATTERNS).alias("contains_script_tag"),
        F.col("label").cast("int").alias("label"),
    )
