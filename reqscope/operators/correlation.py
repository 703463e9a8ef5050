"""Correlation tables (A11–A13, R9): (x, y, r) over numeric columns.

* Pearson: every pair's ``corr`` in one aggregation pass.
* Spearman: MLlib ``Correlation`` (distributed average ranks, ties averaged).
* Kendall tau-b: exact and distributed without emitting pairs.  Points are
  reduced to distinct (x, y) with weights; x values get dense ranks; a b-ary
  block tree over x ranks is walked level by level, and at each level every
  point counts the lighter-y points in earlier sibling blocks with a prefix sum
  over y (``weighted_prefix``) — O(n log_b n) work, no cross join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import weighted_prefix

METHODS = ("pearson", "spearman", "kendall")


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}; got {method!r}.")


def numeric_columns(df: DataFrame) -> list[str]:
    num = ("int", "bigint", "smallint", "tinyint", "double", "float")
    return [c for c, t in df.dtypes if t in num or t.startswith("decimal")]


def _square(spark, cols, values: dict) -> DataFrame:
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            r = values.get((a, b), values.get((b, a)))
            if r is not None and isinstance(r, float) and math.isnan(r):
                r = None
            rows.append((a, b, None if r is None else float(r)))
    return spark.createDataFrame(rows, "x string, y string, r double")


def pearson(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every pair in one aggregation; a constant column has no correlation (NULL)."""
    cols = list(cols or numeric_columns(df))
    exprs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
            exprs.append(F.try_divide(F.covar_pop(x, y), spread).alias(f"{a}__{b}"))
    row = df.agg(*exprs).first()
    vals = {(a, b): row[f"{a}__{b}"] for i, a in enumerate(cols) for b in cols[i:]}
    return _square(df.sparkSession, cols, vals)


def spearman(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    cols = list(cols or numeric_columns(df))
    vec = VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="keep").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    m = Correlation.corr(vec, "_v", "spearman").first()[0].toArray()
    ends = df.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__lo") for c in cols],
                  *[F.max(F.col(c).cast("double")).alias(f"{c}__hi") for c in cols]).first()
    constant = {c for c in cols if ends[f"{c}__lo"] == ends[f"{c}__hi"]}
    vals = {(a, b): float("nan") if {a, b} & constant else float(m[i][j]) for i, a in enumerate(cols) for j, b in enumerate(cols)}
    return _square(df.sparkSession, cols, vals)


def kendall(df: DataFrame, cols: Sequence[str] | None = None, branching: int = 16) -> DataFrame:
    """Exact Kendall tau-b (scipy / pandas semantics, NULL when undefined) of all pairs at once:
    every table below is keyed by the pair ``p``."""
    cols = list(cols or numeric_columns(df))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    val = [F.col(c).cast("double") for c in cols]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("p"), val[i].alias("x"), val[j].alias("y"))
                                         for k, (i, j) in enumerate(pairs)])).alias("_r")).select("_r.*")
    pts = (rows.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
           .groupBy("p", "x", "y").agg(F.count("*").alias("w")))
    rank = weighted_prefix(pts.select("p", "x").distinct().withColumn("_one", F.lit(1).cast("long")), ["p"], "x", ["_one"])
    pts = cut_lineage(pts.join(rank.select("p", "x", (F.col("cum__one") - 1).alias("rx")), ["p", "x"]))
    kx = int(pts.agg(F.max("rx")).first()[0] or 0) + 1
    # N(x < x_p) and N(x < x_p, y = y_p), both exclusive prefix sums
    px = weighted_prefix(pts.groupBy("p", "rx").agg(F.sum("w").alias("wx")), ["p"], "rx", ["wx"])
    pxy = weighted_prefix(pts.select("p", "y", "rx", "w"), ["p", "y"], "rx", ["w"])
    base = (pts.join(px.select("p", "rx", (F.col("cum_wx") - F.col("wx")).alias("n_lt_x")), ["p", "rx"])
            .join(pxy.select("p", "y", "rx", (F.col("cum_w") - F.col("w")).alias("n_lt_x_eq_y")), ["p", "y", "rx"]))
    allc = base.select("p", (F.col("w") * (F.col("n_lt_x_eq_y") - F.col("n_lt_x"))).alias("_c"))
    # + 2 * sum_p w_p * N(x < x_p, y < y_p): one term per block-tree level
    levels = max(1, math.ceil(math.log(kx, branching))) if kx > 1 else 0
    b = branching
    for lvl in range(levels):
        lv = pts.select("p", "y", "w", F.floor(F.col("rx") / b ** lvl).cast("long").alias("_blk"))
        lv = lv.select("p", "y", "w", F.floor(F.col("_blk") / b).alias("parent"),
                       F.pmod(F.col("_blk"), F.lit(b)).cast("int").alias("child"))
        per_y = lv.groupBy("p", "parent", "y").agg(
            *[F.sum(F.when(F.col("child") == k, F.col("w")).otherwise(0)).alias(f"w{k}") for k in range(b)])
        cum = weighted_prefix(per_y, ["p", "parent"], "y", [f"w{k}" for k in range(b)])
        # strictly lower y in earlier siblings: inclusive cum minus this y's own weights
        lookup = cum.select("p", "parent", "y", F.array(*[F.col(f"cum_w{k}") - F.col(f"w{k}") for k in range(b)]).alias("_below"))
        below = F.aggregate(F.slice("_below", 1, F.greatest(F.col("child"), F.lit(1))), F.lit(0).cast("long"), lambda a, v: a + v)
        allc = allc.unionByName(lv.join(lookup, ["p", "parent", "y"]).select(
            "p", (2 * F.col("w") * below * (F.col("child") > 0).cast("long")).alias("_c")))
    half = F.col("t") * (F.col("t") - 1) / 2
    ties = lambda c: pts.groupBy("p", c).agg(F.sum("w").alias("t")).groupBy("p").agg(F.sum(half).alias(f"t{c}"), F.sum("t").alias(f"n{c}"))
    got = (allc.groupBy("p").agg(F.sum("_c").alias("s")).join(ties("x"), "p").join(ties("y").drop("ny"), "p")).collect()  # one row per pair
    vals = {}
    for r in got:
        n0 = r.nx * (r.nx - 1) / 2
        denom = math.sqrt(max(0.0, (n0 - r.tx) * (n0 - r.ty)))
        i, j = pairs[r.p]
        vals[(cols[i], cols[j])] = float(r.s / denom) if denom > 0 else float("nan")
    return _square(df.sparkSession, cols, vals)


def kendall_tau_b(df: DataFrame, x: str, y: str) -> float:
    """Tau-b of one pair, NaN when undefined."""
    r = kendall(df.select(F.col(x).alias("x"), F.col(y).alias("y")), ["x", "y"]).where("x = 'x' and y = 'y'").first()["r"]
    return float("nan") if r is None else r


def correlation(df: DataFrame, cols: Sequence[str] | None = None, method: str = "spearman") -> DataFrame:
    """(x, y, r) for every ordered pair of numeric columns."""
    _check(method)
    return {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method](df, cols)
