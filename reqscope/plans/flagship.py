"""The flagship query: parse page requests, build features, average per label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import NUMERIC_FEATURES, feature_frame
from ..sources import views


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ff = feature_frame(views.page_requests(spark, sf_dir))
    return (ff.groupBy("label")
            .agg(F.count("*").cast("long").alias("n"),
                 *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in NUMERIC_FEATURES]))
