"""Exact, seeded, partition-independent splits and samples (S7, X1–X7, note B).

Rows are ordered by ``md5('<seed>:<key>')``.  The first q rows of each group are those whose
hash is not above the group's *cut*, the q-th smallest hash, so samples, holdouts and
validation sets are plain filters on the rows where they are: ``seeded_cuts`` counts rows per
(group, hash prefix), finds the prefix that holds the q-th row by a running sum over that
bounded table, and ranks only the hashes of that one bucket (in a further level if the
bucket is large).  Keys are unique within a group; rows that share one stay together.

Where the rank itself is the result (folds), it is computed
in two levels so no window ever holds a whole group: rows are bucketed by a hash
prefix (or a range of an ordering column) sized to ~64k rows per bucket; bucket
counts (a small table) give each bucket's offset by a prefix sum, and
``row_number`` runs only inside a bucket.  Exact class counts come from the class
totals (one row per class).  The RNG streams of other libraries are not
reproduced; sizes, disjointness and determinism are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import join_keys, weighted_prefix

BUCKET_ROWS = 65536


def seeded_hash(key: Column | str, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def _max_group_size(df: DataFrame, group_cols: Sequence[str]) -> int:
    if group_cols:
        row = df.groupBy(*group_cols).count().agg(F.max("count")).first()
    else:
        row = df.agg(F.count("*")).first()
    return int(row[0] or 0)


def _two_level_rank(d: DataFrame, group_cols: Sequence[str], bucket: str,
                    order_cols: Sequence[str], out: str) -> DataFrame:
    g = list(group_cols)
    counts = d.groupBy(*g, bucket).agg(F.count("*").alias("_n"))
    w = (Window.partitionBy(*g) if g else Window).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(*g, bucket, (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    w2 = Window.partitionBy(*g, bucket).orderBy(*order_cols)
    return (join_keys(d, counts, [*g, bucket])
            .withColumn(out, (F.col("_before") + F.row_number().over(w2) - 1).cast("long"))
            .drop("_before"))


def seeded_rank(df: DataFrame, key: str, seed: int, group_cols: Sequence[str] = (),
                out: str = "rank", bucket_rows: int = BUCKET_ROWS, max_group: int | None = None) -> DataFrame:
    """0-based rank of each row inside its group by ``md5('<seed>:<key>')``.

    ``max_group`` (the largest group's size, when already known) saves a counting job.
    """
    n = max_group if max_group is not None else _max_group_size(df, group_cols)
    # 16**digits >= n / bucket_rows: buckets hold about bucket_rows rows or fewer
    digits = max(1, min(12, math.ceil(math.log(max(n / bucket_rows, 1.0), 16))))
    d = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    return _two_level_rank(d, group_cols, "_b", ["_h", key], out).drop("_h", "_b")


def ordered_rank(df: DataFrame, order_col: str, group_cols: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """0-based dense position by an ordering column unique in its group (e.g. ``pos``).

    Only the group and ordering columns are range-placed; the rank joins back on them."""
    g = list(group_cols)
    keys = df.select(*g, F.col(order_col).alias("_o")).withColumn("_one", F.lit(1).cast("long"))
    ranks = weighted_prefix(keys, g, "_o", ["_one"]).select(*g, "_o", (F.col("cum__one") - 1).alias("_rank"))
    return join_keys(df.withColumn("_o", F.col(order_col)), ranks, [*g, "_o"]).withColumn(out, F.col("_rank")).drop("_o", "_rank")


def class_counts(df: DataFrame, label_col: str = "label") -> dict:
    """{label: count} (one row per class is collected)."""
    return {r[0]: int(r[1]) for r in df.groupBy(label_col).count().collect()}


def keep_count(n: int, fraction: float) -> int:
    """Exact subset size: max(1, round(n * f)) with round-half-even."""
    return max(1, round(n * fraction))


#: Hex digits of the hash that a level of the cut counts by, and groups whose cuts go into a filter
#: as literals (more are joined).
CUT_DIGITS, LITERAL_GROUPS = 4, 128
_ALL, _NONE = "~", ""  # above and below every hash


def seeded_cuts(df: DataFrame, key: str, seed: int, quota: Callable[[Column], Column], group_cols: Sequence[str] = (),
                digits: int = CUT_DIGITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(group columns, _cut): the hash of the ``quota(rows of the group)``-th row of each group.

    Only hashes are read, and only those of the boundary buckets are exchanged."""
    g = list(group_cols)
    names = [f"_g{i}" for i in range(len(g))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(g, names)], seeded_hash(key, seed).alias("_h"))
    level = digits
    every = Window.partitionBy(*names)
    upto = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = rows.groupBy(*names, F.substring("_h", 1, level).alias("_b")).agg(F.count("*").alias("_n"))
    hist = hist.select("*", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("_total"))
    hist = hist.withColumn("_q", quota(F.col("_total"), *[F.col(n) for n in names]).cast("long"))
    done = F.when(F.col("_q") >= F.col("_total"), F.lit(_ALL)).when(F.col("_q") <= 0, F.lit(_NONE))
    holds = (F.col("_before") < F.col("_q")) & (F.col("_q") <= F.col("_before") + F.col("_n"))
    first = (F.col("_before") == 0) & done.isNotNull()
    at = cut_lineage(hist.where(F.coalesce(first | (done.isNull() & holds), F.lit(False)))
                     .select(*names, "_b", "_n", (F.col("_q") - F.col("_before")).alias("_need"), done.alias("_cut")))
    fixed, open_ = at.where("_cut is not null").select(*names, "_cut"), at.where("_cut is null")

    def within(buckets: DataFrame, length: int) -> DataFrame:
        """The rows of the boundary buckets, with what their group still needs."""
        few = buckets.limit(LITERAL_GROUPS + 1).collect()
        prefix = F.substring("_h", 1, length)
        if len(few) > LITERAL_GROUPS:
            return join_keys(rows.withColumn("_b", prefix), buckets.select(*names, "_b", "_need"), [*names, "_b"])
        hit, need = F.lit(False), F.lit(None).cast("long")
        for r in few:
            same = prefix == r["_b"]
            for n in names:
                same = same & F.col(n).eqNullSafe(F.lit(r[n]))
            hit, need = hit | same, F.when(same, F.lit(r["_need"])).otherwise(need)
        return rows.where(hit).withColumn("_need", need)

    largest = open_.agg(F.max("_n")).first()[0] or 0
    while largest > bucket_rows and level < 32:
        inside = within(open_, level)
        level = min(32, level + digits)
        hist = inside.groupBy(*names, F.substring("_h", 1, level).alias("_b")).agg(F.count("*").alias("_n"), F.first("_need").alias("_need"))
        hist = hist.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        open_ = cut_lineage(hist.where("_before < _need and _need <= _before + _n").select(*names, "_b", "_n", (F.col("_need") - F.col("_before")).alias("_need")))
        largest = open_.agg(F.max("_n")).first()[0] or 0
    ranked = within(open_, level).withColumn("_r", F.row_number().over(every.orderBy("_h")))
    cuts = fixed.unionByName(ranked.where("_r = _need").select(*names, F.col("_h").alias("_cut")))
    return cut_lineage(cuts.select(*[F.col(n).alias(c) for n, c in zip(names, g)], "_cut"))


def mark_first(df: DataFrame, key: str, seed: int, quota: Callable[[Column], Column], group_cols: Sequence[str] = (), out: str = "_first", **levels) -> DataFrame:
    """``df`` with a boolean: whether a row is among the first ``quota(rows of its group)`` of its group."""
    g = list(group_cols)
    cuts = seeded_cuts(df, key, seed, quota, g, **levels)
    few = cuts.limit(LITERAL_GROUPS + 1).collect()
    if len(few) > LITERAL_GROUPS:
        joined = join_keys(df, cuts, g)
        return joined.withColumn(out, seeded_hash(key, seed) <= F.col("_cut")).drop("_cut")
    cut = F.lit(_NONE)
    for r in few:
        same = F.lit(True)
        for c in g:
            same = same & F.col(c).eqNullSafe(F.lit(r[c]))
        cut = F.when(same, F.lit(r["_cut"])).otherwise(cut)
    return df.withColumn(out, F.coalesce(seeded_hash(key, seed) <= cut, cut == _ALL))


def sample_exact(df: DataFrame, fraction: float, seed: int, key: str = "pos",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Exactly ``max(1, round(n*f))`` rows per group (all if that is ≥ n)."""
    quota = lambda n, *_: F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction))))
    return mark_first(df, key, seed, quota, group_cols).where("_first").drop("_first")


def head_cap(df: DataFrame, cap: int | None, pos_col: str = "pos") -> DataFrame:
    """The first ``cap`` rows in file order (a filter, no sort)."""
    return df if cap is None else df.where(F.col(pos_col) < cap)


def proportional_counts(counts: dict, n_draws: int) -> dict:
    """Per-class draw counts: floor of the proportional share, remainders largest first
    (ties by class order)."""
    total = sum(counts.values())
    keys = sorted(counts)
    cont = {c: counts[c] * n_draws / total for c in keys}
    fl = {c: math.floor(cont[c]) for c in keys}
    need = n_draws - sum(fl.values())
    for c in sorted(keys, key=lambda c: (-(cont[c] - fl[c]), c)):
        if need <= 0:
            break
        fl[c] += 1
        need -= 1
    return fl


def stratified_test_counts(counts: dict, test_size: float) -> dict:
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    train = proportional_counts(counts, n_train)
    rest = {c: counts[c] - train[c] for c in counts}
    return proportional_counts(rest, n_test)


def holdout_split(df: DataFrame, label_col: str = "label", key: str = "pos",
                  test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``split`` ∈ {train, test}; ``both`` for every row when stratifying is impossible."""
    counts = class_counts(df, label_col)
    if len(counts) < 2 or min(counts.values()) < 2:
        return df.withColumn("split", F.lit("both"))
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    if min(n_test, n - n_test) < len(counts):  # a side would lack a class
        return df.withColumn("split", F.lit("both"))
    tc = stratified_test_counts(counts, test_size)

    def quota(_: Column, label: Column) -> Column:
        q = F.lit(None).cast("long")
        for k, v in tc.items():  # one value per class, counted above
            q = F.when(label == F.lit(k), F.lit(v)).otherwise(q)
        return q

    marked = mark_first(df, key, seed, quota, (label_col,), out="_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def is_train(split: Column | None = None) -> Column:
    s = split if split is not None else F.col("split")
    return s.isin("train", "both")


def is_test(split: Column | None = None) -> Column:
    s = split if split is not None else F.col("split")
    return s.isin("test", "both")


def safe_folds(counts: dict, requested: int) -> int:
    """Clamp folds to the smallest class, at least 2; error if a class has < 2 rows."""
    smallest = min(counts.values()) if counts else 0
    if smallest < 2:
        raise ValueError(f"cannot cross-validate: smallest class has {smallest} rows (< 2)")
    return max(2, min(requested, smallest))


def kfold(df: DataFrame, k: int = 5, label_col: str = "label", key: str = "pos",
          seed: int = 42) -> DataFrame:
    """Stratified fold id = seeded rank within class mod k."""
    ranked = seeded_rank(df, key, seed, (label_col,), out="_r")
    return ranked.withColumn("fold", F.pmod(F.col("_r"), F.lit(k)).cast("int")).drop("_r")


def validation_split(df: DataFrame, fraction: float = 0.05, seed: int = 42,
                     key: str = "pos", min_rows: int = 20) -> DataFrame:
    """``is_val`` for exactly max(1, round(n*f)) rows; none if f <= 0 or n < 20."""
    n = df.count()
    if fraction <= 0 or n < min_rows:
        return df.withColumn("is_val", F.lit(False))
    k = keep_count(n, fraction)
    return mark_first(df, key, seed, lambda _: F.lit(k), out="is_val")
