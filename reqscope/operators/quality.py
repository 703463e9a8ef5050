"""Duplicates, leakage and data-quality profiles.

All are one or two aggregations; none collects rows to the driver except the
bounded one-row-per-column summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key(key: Column | str | Sequence[str]) -> Column:
    if isinstance(key, Column):
        return key
    if isinstance(key, str):
        return F.col(key)
    return F.struct(*[F.col(c) for c in key])


def duplicate_report(df: DataFrame, key: Column | str | Sequence[str]) -> DataFrame:
    """A1: one row n_total, n_unique, n_duplicate, duplicate_rate (0.0 when empty).

    ``groupBy(key)`` with map-side partial counts, then a global sum: a hot key
    is pre-aggregated per task before the shuffle.
    """
    per_key = df.groupBy(_key(key).alias("_k")).agg(F.count("*").alias("_n"))
    agg = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_total"),
                      F.count("*").cast("long").alias("n_unique"))
    return agg.select(
        "n_total", "n_unique", (F.col("n_total") - F.col("n_unique")).alias("n_duplicate"),
        F.when(F.col("n_total") > 0, (F.col("n_total") - F.col("n_unique")) / F.col("n_total"))
        .otherwise(F.lit(0.0)).alias("duplicate_rate"))


def digest(key: Column | str | Sequence[str]) -> Column:
    """128-bit digest of a key, so that whole texts are no shuffle keys; NULL stays NULL.
    A list of columns is one key."""
    if isinstance(key, (Column, str)):
        return F.md5(_key(key).cast("string"))
    return F.md5(F.to_json(_key(key), {"ignoreNullFields": "false"}))


def duplicate_levels_of(df: DataFrame, levels: dict[str, Column | str | Sequence[str]]) -> DataFrame:
    """A2: all levels of one frame in one pass: (level, digest) pairs are counted, then summed."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("level"), digest(k).alias("_k")) for n, k in levels.items()])).alias("_p"))
    per_key = pairs.groupBy("_p.level", "_p._k").agg(F.count("*").alias("_n"))
    agg = per_key.groupBy("level").agg(F.sum("_n").cast("long").alias("n_total"), F.count("*").cast("long").alias("n_unique"))
    return agg.select("level", "n_total", "n_unique", (F.col("n_total") - F.col("n_unique")).alias("n_duplicate"),
                      ((F.col("n_total") - F.col("n_unique")) / F.col("n_total")).alias("duplicate_rate"))


def duplicate_levels(levels: dict[str, tuple[DataFrame, Column | str | Sequence[str]]]) -> DataFrame:
    """A2: ``duplicate_report`` for several (frame, key) levels, one row per level."""
    out = None
    for name, (df, key) in levels.items():
        r = duplicate_report(df, key).select(F.lit(name).alias("level"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def unique_first(df: DataFrame, key: Column | str | Sequence[str], pos_col: str = "pos") -> DataFrame:
    """The first row (smallest ``pos``) of each distinct key, one aggregation.

    ``min_by`` keeps a whole row per key with map-side partial aggregation, so a
    hot key is reduced inside each task before the shuffle and no join back is needed.
    """
    cols = df.columns
    firsts = df.groupBy(_key(key).alias("_k")).agg(F.min_by(F.struct(*cols), F.col(pos_col)).alias("_r"))
    return firsts.select("_r.*")


def train_test_leakage(train: DataFrame, test: DataFrame, key: Column | str | Sequence[str]) -> DataFrame:
    """n_test, n_leaked, leakage_rate — test rows whose key occurs in train.

    Counted test keys meet the *distinct* train keys (both reduced before the shuffle,
    by their 128-bit digest); a NULL key leaks into nothing.
    """
    train_keys = train.select(digest(key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    counted = test.groupBy(digest(key).alias("_k")).agg(F.count("*").alias("_n"))  # a hot key is one row
    agg = counted.join(train_keys, "_k", "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_test"),
        F.coalesce(F.sum(F.col("_n") * F.col("_hit")), F.lit(0)).cast("long").alias("n_leaked"))
    return agg.select("n_test", "n_leaked",
                      F.when(F.col("n_test") > 0, F.col("n_leaked") / F.col("n_test"))
                      .otherwise(F.lit(0.0)).alias("leakage_rate"))


def n_unique(df: DataFrame, key: Column | str | Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct count (exact, or HyperLogLog++ when ``approx``)."""
    k = _key(key)
    if approx:
        return df.agg(F.approx_count_distinct(k).cast("long").alias("n_unique"))
    return df.select(k.alias("_k")).distinct().agg(F.count("*").cast("long").alias("n_unique"))


def class_balance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Label, n, share."""
    counts = df.groupBy(label_col).agg(F.count("*").cast("long").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def crosstab(df: DataFrame, row: str, col: str = "label", values=(0, 1),
             names=("normal", "anomalous")) -> DataFrame:
    """A10: contingency table with fixed columns, 0 for absent cells."""
    p = df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1)))
    return p.select(row, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("long").alias(n)
                           for v, n in zip(values, names)])


def _unpivot(df: DataFrame, cols: Sequence[str], cast: str = "double") -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in cols
    ])).alias("_kv")).select("_kv.column", "_kv.value")


def missing_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A3: column, n_missing (NULL, or NaN for floating columns) in one pass."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    exprs = []
    for c in cols:
        cond = F.col(c).isNull()
        if types[c] in ("double", "float"):
            cond = cond | F.isnan(c)
        exprs.append(F.count_if(cond).cast("long").alias(c))
    row = df.agg(*exprs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in cols
    ])).alias("_m")).select("_m.*")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: n_total, n_distinct, n_duplicate_rows (repeats after the first)."""
    return duplicate_report(df, list(cols or df.columns)).select(
        "n_total", F.col("n_unique").alias("n_distinct"), F.col("n_duplicate").alias("n_duplicate_rows"))


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A5: column, is_constant — fewer than two distinct values, NULL counted as a value.

    One pass of min/max/null-count per column, no countDistinct.
    """
    cols = list(cols or df.columns)
    exprs = []
    for c in cols:
        exprs += [F.min(c).alias(f"{c}__mn"), F.max(c).alias(f"{c}__mx"),
                  F.count_if(F.col(c).isNull()).alias(f"{c}__nl"), F.count("*").alias(f"{c}__n")]
    row = df.agg(*exprs)
    items = []
    for c in cols:
        mn, mx, nl, n = (F.col(f"{c}__{s}") for s in ("mn", "mx", "nl", "n"))
        non_null_vals = F.when(mn.isNull(), 0).when(mn == mx, 1).otherwise(2)
        distinct = non_null_vals + F.when(nl > 0, 1).otherwise(0)
        items.append(F.struct(F.lit(c).alias("column"), (distinct <= 1).cast("int").alias("is_constant")))
    return row.select(F.explode(F.array(*items)).alias("_c")).select("_c.*")


def duplicate_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Column, duplicate_of — the first earlier column with identical values ('' if none).

    Values are compared in a common type (double when all columns are numeric,
    else string), as pandas compares 0 and 0.0 equal; NULL equals NULL. One pass
    of ``bool_and`` over all earlier pairs.
    """
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    numeric = all(types[c] in ("int", "bigint", "smallint", "tinyint", "double", "float") or
                  types[c].startswith("decimal") for c in cols)
    common = "double" if numeric else "string"
    exprs = []
    for j, b in enumerate(cols):
        for a in cols[:j]:
            exprs.append(F.bool_and(F.col(a).cast(common).eqNullSafe(F.col(b).cast(common)))
                         .alias(f"{a}__eq__{b}"))
    if not exprs:
        return df.sparkSession.createDataFrame([(c, "") for c in cols], "column string, duplicate_of string")
    row = df.agg(*exprs)
    items = []
    for j, b in enumerate(cols):
        first = F.lit("")
        for a in reversed(cols[:j]):
            first = F.when(F.coalesce(F.col(f"{a}__eq__{b}"), F.lit(True)), F.lit(a)).otherwise(first)
        items.append(F.struct(F.lit(b).alias("column"), first.alias("duplicate_of")))
    return row.select(F.explode(F.array(*items)).alias("_d")).select("_d.*")


def describe(df: DataFrame, cols: Sequence[str], percentiles=(0.25, 0.5, 0.75),
             exact: bool = True) -> DataFrame:
    """Column, count, mean, std (sample), min, p.., max — linear-interpolated percentiles.

    Exact percentiles come from ``exact_quantiles`` (distributed, distinct values
    first); ``exact=False`` uses the bounded-memory ``percentile_approx`` sketch.
    """
    from .ordered import exact_quantiles

    long = _unpivot(df, cols).where(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("value").cast("long").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    names = [f"p{int(round(p * 100))}" for p in percentiles]
    if exact:
        q = exact_quantiles(long, "column", "value", percentiles)
        qcols = q.groupBy("column").pivot("prob", list(percentiles)).agg(F.first("q"))
        qcols = qcols.select("column", *[F.col(f"`{p}`").alias(n) for p, n in zip(percentiles, names)])
    else:
        qcols = long.groupBy("column").agg(
            F.percentile_approx("value", list(percentiles), 10000).alias("_q"))
        qcols = qcols.select("column", *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return moments.join(qcols, "column").select("column", "count", "mean", "std", "min", *names, "max")


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A7 for text columns: column, count (non-null), unique, top (most frequent value, the
    smallest on ties), freq.  One grouping over (column, value) for all columns."""
    long = _unpivot(df, cols, "string").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count("*").alias("_n"))
    agg = counts.groupBy("column").agg(F.sum("_n").cast("long").alias("count"), F.count("*").cast("long").alias("unique"),
                                       F.min(F.struct((-F.col("_n")).alias("n"), "value")).alias("_t"))
    return agg.select("column", "count", "unique", F.col("_t")["value"].alias("top"), (-F.col("_t")["n"]).cast("long").alias("freq"))


def profile(df: DataFrame, pos_col: str = "pos", n: int = 5) -> tuple[int, list, DataFrame]:
    """Row count, (column, type) list, first ``n`` rows by position (a filter, not a sort)."""
    return df.count(), df.dtypes, df.where(F.col(pos_col) < n)


def first_examples(requests: DataFrame, label_col: str = "label", text_col: str = "request_line",
                   pos_col: str = "pos", clip: int = 160) -> DataFrame:
    """The first request of each class (smallest position), clipped for display."""
    return requests.groupBy(label_col).agg(
        F.min(pos_col).alias(pos_col),
        F.substring(F.min_by(F.col(text_col), F.col(pos_col)), 1, clip).alias("example"))
