"""The stateless operators on streams (§2.15: the reference has no streaming).

* ``stream_features``: a stream of already-assembled requests (request schema,
  e.g. Parquet files landing in a folder) → the 16-column feature frame, per
  micro-batch, no state.
* ``stream_dump_files``: new dump files landing in a folder are parsed with the
  batch block assembly inside ``foreachBatch`` (a file is complete when it
  lands, so no request spans micro-batches) and appended to a Parquet table.

Checkpoints go under the cluster's shared checkpoint folder unless given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import feature_frame
from ..session import ensure_checkpoint_dir
from ..sources.dumps import REQUEST_SCHEMA_DDL, assemble_blocks, number_blocks, parse_blocks


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    return given or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"


def stream_features(spark: SparkSession, source_dir: str, keep=("pos",)) -> DataFrame:
    """Streaming DataFrame of features over request rows arriving as Parquet."""
    requests = spark.readStream.schema(REQUEST_SCHEMA_DDL).parquet(source_dir)
    return feature_frame(requests, keep=tuple(keep))


def stream_dump_files(spark: SparkSession, source_dir: str, sink_dir: str, label: int = 0,
                      checkpoint: str | None = None, trigger_once: bool = False):
    """Parse dump files as they land; append parsed requests to ``sink_dir``."""
    lines = (spark.readStream.format("text").load(source_dir)
             .select(F.col("_metadata.file_path").alias("source_file"),
                     F.col("_metadata.file_block_start").alias("split_start"),
                     F.make_valid_utf8("value").alias("line")))

    def per_batch(batch: DataFrame, epoch: int) -> None:
        numbered = number_blocks(batch.withColumn("mid", F.monotonically_increasing_id()))
        req = parse_blocks(assemble_blocks(numbered))
        (req.select((F.col("block_no") - 1).alias("pos"), "source_file", "block_no", "method", "target",
                    "version", "headers", "body", "raw", F.lit(label).alias("label"),
                    F.lit("stream").alias("split"))
         .write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={epoch}"))  # a retry replaces its own batch

    writer = (lines.writeStream.foreachBatch(per_batch)
              .option("checkpointLocation", _checkpoint(spark, "dumps", checkpoint)))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
