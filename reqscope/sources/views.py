"""Driver tables and the request views derived from them by string functions.

There is no HTTP dump among the driver tables, so request texts are built from
``pages`` and ``events`` (integers are the only values cast to strings, so both
Spark and SQL engines render them identically), then parsed like any dump.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dumps import requests_from_raw

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def req_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templated shop requests: pos, request_line, raw, label (error events = 1)."""
    ev = table(spark, sf_dir, "events")
    rl = F.concat(F.lit("GET /shop/"), F.col("event_type"), F.lit("?u="),
                  F.col("user_id").cast("string"), F.lit(" HTTP/1.1"))
    return ev.select(
        F.col("event_id").alias("pos"),
        rl.alias("request_line"),
        F.concat(rl, F.lit("\nX-E: "), F.col("event_id").cast("string")).alias("raw"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
    )


def req_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GET/POST page requests with injected SQL / script payloads: pos, method, target, body, label, raw.

    The body is the whole html of the page with its line breaks."""
    pg = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    method = F.when(pid % 3 == 0, "POST").otherwise("GET")
    target = F.concat(F.col("url"),
                      F.when(pid % 7 == 1, "?q=1' or 1=1--").otherwise(""),
                      F.when(pid % 11 == 2, "/%3Cscript%3E").otherwise(""))
    body = F.coalesce(F.col("html"), F.lit(""))
    label = F.when((pid % 7 == 1) | (pid % 11 == 2), 1).otherwise(0)
    x = pg.select(pid.alias("page_id"), method.alias("method"), target.alias("target"),
                  body.alias("body"), label.alias("label"))
    raw = F.concat(
        F.col("method"), F.lit(" "), F.col("target"), F.lit(" HTTP/1.1\nHost: h\nX-Id: "),
        F.col("page_id").cast("string"),
        F.when(F.col("page_id") % 5 == 0, "\nX-Id: again").otherwise(""),
        F.when(F.col("body") != "", F.concat(F.lit("\n\n"), F.col("body"))).otherwise(""))
    return x.select(F.col("page_id").alias("pos"), "method", "target", "body", "label",
                    raw.alias("raw"))


def page_requests(spark: SparkSession, sf_dir: str, split: str = "inference") -> DataFrame:
    """``req_pages`` parsed into the request schema."""
    return requests_from_raw(req_pages(spark, sf_dir), split=split, source="pages")


def event_requests(spark: SparkSession, sf_dir: str, split: str = "inference") -> DataFrame:
    """``req_events`` parsed into the request schema."""
    return requests_from_raw(req_events(spark, sf_dir), split=split, source="events")


def scored(spark: SparkSession, sf_dir: str, threshold: int = 400) -> DataFrame:
    """Predictions from ``labels`` ⋈ ``documents``: y_true = toxic, y_score = n_chars."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(
        F.col("doc_id").alias("pos"),
        F.col("toxic").cast("int").alias("y_true"),
        (F.col("n_chars") > threshold).cast("int").alias("y_pred"),
        F.col("n_chars").cast("double").alias("y_score"),
    )
