"""What several training-data operators share: the shared folder, intermediate tables and bounded text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once (one longer text is handled alone).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Where the session names none, a temporary one is set on one machine (in tests); on a cluster that fails."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if name:
        return name.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    name = tempfile.mkdtemp(prefix="strandline-")
    spark.conf.set("spark.checkpoint.dir", name)
    return name


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder then stays for its owner to sweep
        pass


#: Rows of an Arrow batch where texts are read and where rows are narrow (Spark's own number), and bytes that a Parquet writer holds before it lets go of
#: them: all of these weigh on an executor next to its heap.
TEXT_ROWS, NARROW_ROWS, ROW_GROUP = 1000, 10_000, 16 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(df: DataFrame) -> DataFrame:
    """``df``, whose texts are about to be sent to Python: its session makes small Arrow batches from now on, unless it was given a number of its own."""
    if df.sparkSession.conf.get(_BATCH) == str(NARROW_ROWS):
        df.sparkSession.conf.set(_BATCH, str(TEXT_ROWS))
    return df


def materialize(spark: SparkSession, df: DataFrame, name: str, rows: int = NARROW_ROWS) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, so a lost executor costs no recomputation.

    rows: of an Arrow batch while it is written, unless the session was given a number of its own.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    try:
        if before in (str(TEXT_ROWS), str(NARROW_ROWS)):
            spark.conf.set(_BATCH, str(rows))
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def free_names(df: DataFrame, count: int) -> list[str]:
    """Names for columns of our own that no column of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for i in range(count + len(taken)):
        if f"__own{i}" not in taken:
            out.append(f"__own{i}")
    return out[:count]


def task(run):
    """``run`` (batches to batches) for mapInArrow, giving memory back to the system at its end: Spark keeps the worker for other tasks."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value; null counts as none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``limit`` bytes in ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.cumsum(sizes(batch.column(column))) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def texts_of(column: pa.Array) -> list[str]:
    """Texts as str; null is empty and bytes that are no UTF-8 become U+FFFD."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return [(x or b"").decode("utf-8", "replace") for x in column.to_pylist()]
    return [x or "" for x in column.to_pylist()]


def table(rows: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose crc32 of the id, as text, is divisible by five; these never train a model (nor do rows without an id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(df: DataFrame, bound: int, doc_id: str = "doc_id") -> DataFrame:
    """At most about ``bound`` rows outside the held-out fifth, chosen by a hash of the id: the same rows on any cluster."""
    known = df.filter(F.col(doc_id).isNotNull() & ~held_out(doc_id))
    rows = known.count()
    if rows <= bound:
        return known
    return known.filter(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) < int(bound / rows * (1 << 30)))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written: it does so only once the driver has collected its garbage, which on a quiet
    driver may be long after an operator with many steps has filled the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete an intermediate table that ``materialize`` gave and nothing reads any more."""
    _delete(spark, df._written_to)
