"""Contiguous shards of nearly equal bytes.

Each partition of the input becomes a chunk that knows the running sizes of its rows. Only the totals of the chunks, one small row each,
are summed up across the table; a row's place in the global sequence of bytes is its chunk's start plus its own running size, and shards are
that sequence cut at equal targets. Nothing is sorted or dealt out by a key, so hot sources or copies can't weigh on one task.

A row counts its UTF-8 bytes plus ``OVERHEAD`` (null text: none). A row lies in the shard in which its middle byte lies, so shards differ
from the mean by at most one row; a very long text may fill more than a shard, and its neighbours are then empty. Rows follow one another as they
are read, by partition and place in it: the same files cut into other partitions give other shards, of the same balance. Ties don't
arise, as nothing is compared. Null ids, repeated rows and other columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandline.llm import _common

OVERHEAD = 16


def _numbered(df: DataFrame, size: str) -> DataFrame:
    """``df`` with its chunk, the row's number in it and the bytes before it there, each counted along the partition."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in ("chunk", "place", "before"))])

    def run(batches):
        from pyspark import TaskContext

        chunk, place, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n, bytes_ = b.num_rows, b.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(bytes_)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, chunk, np.int64)), pa.array(np.arange(place, place + n)), pa.array(ends - bytes_)], names=[*names, "chunk", "place", "before"])
            place, before = place + n, int(ends[-1]) if n else before

    return df.mapInArrow(run, schema)


def balanced(spark: SparkSession, rows: DataFrame, shards: int, size: str = "size") -> DataFrame:
    """``rows`` with shard (from 0) and slot (gapless from 0 within the shard), in the order of the input.

    The numbered rows are written to the shared folder before they are used: a task that is run anew can't number them otherwise.
    """
    numbered = _common.materialize(spark, _numbered(rows, size), "sharding")
    totals = numbered.groupBy("chunk").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    upto = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row for each chunk
    every = Window.partitionBy()
    starts = totals.select("chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("rows0"), F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes0"), F.sum("bytes").over(every).alias("all"))
    middle = (F.col("bytes0") + F.col("before")) * 2 + F.col(size)  # twice the middle, to stay with integers
    placed = numbered.join(starts, "chunk").withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (F.greatest(F.col("all"), F.lit(1)) * 2)).cast("int"))).withColumn("row", F.col("rows0") + F.col("place"))
    # The first row of a shard is the least of its rows' numbers; a chunk gives at most one candidate for each shard.
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(firsts, "shard").withColumn("slot", F.col("row") - F.col("first")).drop("chunk", "place", "before", "rows0", "bytes0", "all", "row", "first")


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return balanced(spark, slim, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
