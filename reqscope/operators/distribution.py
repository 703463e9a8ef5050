"""Histograms and kernel densities as plot-ready tables.

Bins follow ``numpy.histogram``: ``bins`` equal-width bins between the min and
max of each group (±0.5 when the range is empty), edges ``mn + k*step``, the
last bin closed.  The KDE is Gaussian with Scott's bandwidth evaluated on a
200-point grid extending 3 bandwidths past the data (seaborn's defaults); each
distinct value contributes one kernel array, summed per grid point by a
partial aggregation (no join with the grid).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import join_keys

BINS = 30
GRID = 200
CUT = 3.0


def _bin_index(v: Column, lo: Column, step: Column, bins: int) -> Column:
    raw = F.floor((v - lo) * (F.lit(float(bins)) / (step * bins))).cast("int")
    i0 = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    down = v < lo + i0 * step
    up = (i0 < bins - 1) & (v >= lo + (i0 + 1) * step)
    return F.when(down, i0 - 1).when(up, i0 + 1).otherwise(i0)


def histogram(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), bins: int = BINS,
              shared_range: bool = False) -> DataFrame:
    """(groups, bin, lo, hi, n, density) — per-group ranges unless ``shared_range``.

    Empty bins are included (``bins`` rows per group).
    """
    no_group = not group_cols
    g = list(group_cols) or ["_all"]
    v = F.col(value_col).cast("double")
    src = df.withColumn("_all", F.lit(0)) if no_group else df
    data = src.select(*g, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if shared_range:
        rng = data.agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx")).first()
        ranges = data.groupBy(*g).agg(F.count("*").alias("_N"), F.lit(rng["_mn"]).alias("_mn"),
                                      F.lit(rng["_mx"]).alias("_mx"))
    else:
        ranges = data.groupBy(*g).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"),
                                      F.count("*").alias("_N"))
    ranges = ranges.select(
        *g, "_N",
        F.when(F.col("_mx") > F.col("_mn"), F.col("_mn")).otherwise(F.col("_mn") - 0.5).alias("_lo"),
        F.when(F.col("_mx") > F.col("_mn"), F.col("_mx")).otherwise(F.col("_mx") + 0.5).alias("_hi"))
    ranges = ranges.withColumn("_step", (F.col("_hi") - F.col("_lo")) / bins)
    joined = join_keys(data, ranges, g)
    counts = (joined.withColumn("bin", _bin_index(F.col("_v"), F.col("_lo"), F.col("_step"), bins))
              .groupBy(*g, "bin").agg(F.count("*").alias("n")))
    grid = ranges.select(*g, "_N", "_lo", "_step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = join_keys(grid, counts, [*g, "bin"], "left").fillna(0, ["n"])
    keep = [] if no_group else g
    return out.select(
        *keep, "bin", (F.col("_lo") + F.col("bin") * F.col("_step")).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.col("_lo") + F.col("_step") * bins)
        .otherwise(F.col("_lo") + (F.col("bin") + 1) * F.col("_step")).alias("hi"),
        F.col("n").cast("long").alias("n"),
        (F.col("n") / (F.col("_N") * F.col("_step"))).alias("density"))


def kde(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), grid: int = GRID,
        cut: float = CUT) -> DataFrame:
    """(groups, i, x, density): Gaussian KDE, Scott bandwidth, only for groups with
    more than 2 points and a positive range (as in the reference's score plot)."""
    no_group = not group_cols
    g = list(group_cols) or ["_all"]
    v = F.col(value_col).cast("double")
    src = df.withColumn("_all", F.lit(0)) if no_group else df
    data = src.select(*g, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    stats = data.groupBy(*g).agg(
        F.count("*").alias("_n"), F.stddev_samp("_v").alias("_sd"),
        F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    stats = stats.where((F.col("_n") > 2) & (F.col("_mx") > F.col("_mn")))
    stats = stats.withColumn("_bw", F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_sd"))
    stats = stats.withColumn("_g0", F.col("_mn") - cut * F.col("_bw")).withColumn(
        "_gs", (F.col("_mx") + cut * F.col("_bw") - F.col("_g0")) / (grid - 1))
    distinct = data.groupBy(*g, "_v").agg(F.count("*").alias("_w"))
    j = join_keys(distinct, stats, g)
    inv = 1.0 / math.sqrt(2.0 * math.pi)
    idx = F.sequence(F.lit(0), F.lit(grid - 1))
    # one array of kernel weights per distinct value, exploded and summed per grid point
    dens = j.select(*g, "_n", "_g0", "_gs", "_bw", F.posexplode(F.transform(
        idx, lambda i: F.col("_w") * F.exp(-0.5 * F.pow((F.col("_g0") + i * F.col("_gs") - F.col("_v"))
                                                         / F.col("_bw"), 2)))).alias("i", "_k"))
    agg = dens.groupBy(*g, "i").agg(F.sum("_k").alias("_s"), F.first("_n").alias("_n"),
                                    F.first("_g0").alias("_g0"), F.first("_gs").alias("_gs"),
                                    F.first("_bw").alias("_bw"))
    return agg.select(*([] if no_group else g), "i", (F.col("_g0") + F.col("i") * F.col("_gs")).alias("x"),
                      (F.col("_s") * inv / (F.col("_n") * F.col("_bw"))).alias("density"))


def feature_histograms(features: DataFrame, cols: Sequence[str], hue: str = "label",
                       bins: int = BINS) -> DataFrame:
    """(feature, hue, bin, lo, hi, n) — per feature one range shared by all hue values."""
    long = features.select(hue, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_v")) for c in cols
    ])).alias("_kv")).select("_kv.feature", hue, "_kv._v").where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ranges = long.groupBy("feature").agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    ranges = ranges.select(
        "feature",
        F.when(F.col("_mx") > F.col("_mn"), F.col("_mn")).otherwise(F.col("_mn") - 0.5).alias("_lo"),
        F.when(F.col("_mx") > F.col("_mn"), F.col("_mx")).otherwise(F.col("_mx") + 0.5).alias("_hi"))
    ranges = ranges.withColumn("_step", (F.col("_hi") - F.col("_lo")) / bins)
    counts = (long.join(F.broadcast(ranges), "feature")  # one row per feature column
              .withColumn("bin", _bin_index(F.col("_v"), F.col("_lo"), F.col("_step"), bins))
              .groupBy("feature", hue, "bin").agg(F.count("*").alias("n")))
    pairs = long.select("feature", hue).distinct()
    grid = (pairs.join(F.broadcast(ranges), "feature")
            .select("feature", hue, "_lo", "_step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    out = grid.join(counts, ["feature", hue, "bin"], "left").fillna(0, ["n"])
    return out.select("feature", hue, "bin", (F.col("_lo") + F.col("bin") * F.col("_step")).alias("lo"),
                      F.when(F.col("bin") == bins - 1, F.col("_lo") + F.col("_step") * bins)
                      .otherwise(F.col("_lo") + (F.col("bin") + 1) * F.col("_step")).alias("hi"),
                      F.col("n").cast("long").alias("n"))
