"""Running sums and exact order statistics without a single-task window.

``weighted_prefix`` computes, for rows reduced to *distinct* ordering values per
key, the cumulative weight in value order.  Rows are range-partitioned by (key,
value) — bounds come from Spark's own sample, so neither outliers nor a key with
most of the rows end up in one task — and written to the shared checkpoint
folder, so that the placement cannot change between its uses.  Sums per (key,
partition) form a small table whose prefix gives every partition its offset;
the running sum itself runs inside a partition.  One path serves all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of key columns: a NULL group is a group."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined null-safely on ``keys``."""
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        one = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cond = one if cond is None else cond & one
    return left.join(named, cond, how).drop(*[f"_k{i}" for i in range(len(keys))])


def weighted_prefix(df: DataFrame, part_cols: Sequence[str], order_col: str,
                    weight_cols: Sequence[str], descending: bool = False,
                    lead_cols: Sequence[str] = (), n_parts: int | None = None) -> DataFrame:
    """Add ``cum_<w>`` (inclusive running sum of each weight in value order) and
    ``next_<c>`` (the value of ``c`` on the next row in that order, NULL on the last).

    ``order_col`` must be unique within each key; NULL keys are a group of their own.
    """
    parts = list(part_cols) or ["_whole"]
    d = df if part_cols else df.withColumn("_whole", F.lit(0))
    n = n_parts or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    placed = cut_lineage(d.repartitionByRange(n, *parts, order).withColumn("_pid", F.spark_partition_id()))
    first = F.max_by if descending else F.min_by
    sums = [F.sum(c).alias(f"_t_{c}") for c in weight_cols]
    if lead_cols:
        sums.append(first(F.struct(*lead_cols), F.col(order_col)).alias("_f"))
    wb = Window.partitionBy(*parts).orderBy("_pid")
    earlier = wb.rowsBetween(Window.unboundedPreceding, -1)
    tot = placed.groupBy(*parts, "_pid").agg(*sums)
    tot = tot.select(*parts, "_pid", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in weight_cols],
                     *([F.lead("_f").over(wb).alias("_nf")] if lead_cols else []))
    d = join_keys(placed, tot, [*parts, "_pid"])
    inside = Window.partitionBy(*parts, "_pid").orderBy(order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("*", *[(F.col(f"_o_{c}") + F.sum(c).over(running)).alias(f"cum_{c}") for c in weight_cols],
                 *([F.when(F.lead(F.lit(1)).over(inside).isNotNull(), F.lead(F.struct(*lead_cols)).over(inside))
                    .otherwise(F.col("_nf")).alias("_lead")] if lead_cols else []))
    d = d.select("*", *[F.col("_lead")[c].alias(f"next_{c}") for c in lead_cols])
    return d.drop("_whole", "_pid", "_nf", "_lead", *[f"_o_{c}" for c in weight_cols])


def exact_quantiles(long: DataFrame, part_col: str, value_col: str,
                    probs: Sequence[float]) -> DataFrame:
    """(part, prob, q): linear-interpolated quantiles (pandas / ``quantile_cont``).

    Distinct values are counted first (ties collapse, hot values cost one row),
    then ranks come from ``weighted_prefix``; a row is kept only if it holds one of
    the target ranks.
    """
    dv = long.groupBy(part_col, value_col).agg(F.count("*").alias("_n"))
    cum = weighted_prefix(dv, [part_col], value_col, ["_n"])
    totals = dv.groupBy(part_col).agg(F.sum("_n").alias("_N"))
    ranks = F.transform(F.array(*[F.lit(float(p)) for p in probs]),
                        lambda p: F.struct(p.alias("prob"), (p * (F.col("_N") - 1)).alias("h")))
    j = join_keys(cum, totals.select(part_col, ranks.alias("_targets")), [part_col])
    before, upto = F.col("cum__n") - F.col("_n"), F.col("cum__n")
    held = F.filter("_targets", lambda t: ((F.floor(t["h"]) >= before) & (F.floor(t["h"]) < upto))
                    | ((F.ceil(t["h"]) >= before) & (F.ceil(t["h"]) < upto)))
    j = j.select(part_col, value_col, before.alias("_before"), upto.alias("_upto"), F.explode(held).alias("_t"))
    h = F.col("_t")["h"]
    lo = F.when((F.floor(h) >= F.col("_before")) & (F.floor(h) < F.col("_upto")), F.col(value_col))
    hi = F.when((F.ceil(h) >= F.col("_before")) & (F.ceil(h) < F.col("_upto")), F.col(value_col))
    agg = j.groupBy(part_col, F.col("_t")["prob"].alias("prob"), h.alias("_h")).agg(F.min(lo).alias("_vlo"), F.min(hi).alias("_vhi"))
    return agg.select(part_col, "prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_h") - F.floor("_h"))).alias("q"))


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(column, prob, q) in bounded memory: one aggregation for all columns, partial in every task, with
    Spark's mergeable quantile summaries.  ``q`` is a value of the column whose rank differs from
    prob * n by n / ``accuracy`` at most; NULL and NaN take no part, a column without values gives NULL."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    ps = [float(p) for p in probs]
    row = df.agg(*[F.percentile_approx(value(c), ps, accuracy).alias(f"q{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"q{i}").alias("qs")) for i, c in enumerate(cols)])
    named = row.select(F.explode(each).alias("x")).select("x.column", F.posexplode_outer("x.qs").alias("i", "q"))
    prob = F.element_at(F.array(*[F.lit(p) for p in ps]), F.col("i") + 1)
    given = F.array(*[F.lit(p) for p in ps])
    return named.select("column", F.explode(F.when(F.col("i").isNull(), given).otherwise(F.array(prob))).alias("prob"), "q")
