"""Running values over rows in a global order, without a window over a whole group.

Rows are range-partitioned by the order, sorted inside partitions, and every partition computes
its running values alone.  The last row of a partition says what it passes on; those rows, one
a partition, are combined on the driver and added to the rows that continue an earlier group.
So a group may span any number of partitions.  Equal rows are told apart by a row number, so a
run of them is split as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import default_parts, scratch, small_batches


def _local(keys: Sequence[str], add: Sequence[str], xor: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last: tuple | None = None
        carried = {c: np.int64(0) for c in (*add, *xor)}
        index, head, held = 0, True, None

        def flagged(batch: pa.RecordBatch, end: bool) -> pa.RecordBatch:
            flag = np.zeros(batch.num_rows, bool)
            flag[-1] = end
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(flag)], [*batch.schema.names, "_end"])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            first = []
            for c in keys:
                v = b.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
                first.append((v[0], v[-1]))
            new[0] = last is not None and tuple(x for x, _ in first) != last
            seg = np.cumsum(new)
            begin = np.concatenate([[0], np.flatnonzero(new[1:]) + 1])[seg - new[0]]
            goes_on = seg == 0
            out = {}
            for c in add:
                v = b.column(c).to_numpy().astype(np.int64)
                total = np.cumsum(v)
                out[c] = total - (total - v)[begin] + np.where(goes_on, carried[c], 0)
            for c in xor:
                v = b.column(c).to_numpy().astype(np.int64)
                total = np.bitwise_xor.accumulate(v)
                out[c] = total ^ (total ^ v)[begin] ^ np.where(goes_on, carried[c], 0)
            in_head = goes_on & head
            head = bool(in_head[-1])
            for c in out:
                carried[c] = out[c][-1]
            last = tuple(x for _, x in first)
            if held is not None:
                yield flagged(held, False)
            held = pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(out[c]) for c in (*add, *xor)], pa.array(index + 1 + np.arange(n)), pa.array(np.full(n, pid, np.int32)), pa.array(in_head)],
                [*b.schema.names, *[f"run_{c}" for c in (*add, *xor)], "_index", "_pid", "_head"])
            index += n
        if held is not None:
            yield flagged(held, True)
    return run


def running(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), add: Sequence[str] = (), xor: Sequence[str] = (),
            index: str | None = None, name: str = "scan") -> DataFrame:
    """``df`` with ``run_<c>``: sums (``add``) or exclusive ors (``xor``) of the bigint columns
    over the rows of the same ``keys`` up to and with the row, in ``order``; ``index``, if named,
    is the row's number in the whole order, from 0.

    ``order`` must keep rows of equal keys together; keys are bigint and not null."""
    spark = df.sparkSession
    small_batches(spark)
    columns = df.columns
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(default_parts(spark), *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    runs = [f"run_{c}" for c in (*add, *xor)]
    schema = T.StructType([*placed.schema.fields, *[T.StructField(c, T.LongType()) for c in runs], T.StructField("_index", T.LongType()),
                           T.StructField("_pid", T.IntegerType()), T.StructField("_head", T.BooleanType()), T.StructField("_end", T.BooleanType())])
    local = scratch(placed.mapInArrow(_local(list(keys), list(add), list(xor)), schema), name, free=False)
    carry, before, passed, at = [], None, dict.fromkeys((*add, *xor), 0), 0
    for r in sorted(local.where("_end").select("_pid", "_index", "_head", *keys, *runs).collect(), key=lambda r: r["_pid"]):  # one row a partition
        key = tuple(r[k] for k in keys)
        carry.append((r["_pid"], at, *(before or (None,) * len(keys)), *[int(passed[c]) for c in (*add, *xor)]))
        joined = bool(r["_head"]) and before == key
        passed = {c: int(r[f"run_{c}"]) + (passed[c] if joined else 0) for c in add} | {c: int(r[f"run_{c}"]) ^ (passed[c] if joined else 0) for c in xor}
        before, at = key, at + r["_index"]
    fields = ["_pid int", "_at long", *[f"_k{i} long" for i in range(len(keys))], *[f"_c_{c} long" for c in (*add, *xor)]]
    offsets = F.broadcast(spark.createDataFrame(carry, ", ".join(fields)))  # one row a partition
    goes_on = F.col("_head")
    for i, k in enumerate(keys):
        goes_on = goes_on & F.coalesce(F.col(f"_k{i}") == F.col(k), F.lit(False))
    if not keys:
        goes_on = F.lit(True)
    out = local.join(offsets, "_pid")
    out = out.select(*columns, *[(F.col(f"run_{c}") + F.when(goes_on, F.col(f"_c_{c}")).otherwise(0)).alias(f"run_{c}") for c in add],
                     *[F.col(f"run_{c}").bitwiseXOR(F.when(goes_on, F.col(f"_c_{c}")).otherwise(F.lit(0).cast("long"))).alias(f"run_{c}") for c in xor],
                     *([(F.col("_index") + F.col("_at") - 1).alias(index)] if index else []))
    return out
