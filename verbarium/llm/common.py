"""What the operators of this subpackage share: tables, shared staging, Arrow text buffers and bounded samples."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder modulo HELD_OUT_FOLDS are never learned from.
HELD_OUT_FOLDS, HELD_OUT_FOLD = 4, 2
#: Bytes of text that a numpy kernel holds at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == HELD_OUT_FOLD, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one in local mode where that is unset.

    On a cluster without one this raises, since a machine-local folder would lose rows there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.gettempdir()}/verbarium-{os.getpid()}")
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_end(spark: SparkSession, folder: str) -> None:
    """Deletes an application's staged tables when the driver's Python ends, if its JVM is still there."""
    with contextlib.suppress(Exception):
        _delete(spark, folder)


@lru_cache(maxsize=8)
def _stage_dir(spark: SparkSession, application: str) -> str:
    folder = f"{shared_dir(spark)}/stage/{application}"
    atexit.register(_at_end, spark, folder)
    return folder


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends in files that outlive any executor.

    unstage() deletes such a table as soon as nothing reads it any more, the end of the application what is left.
    """
    spark = df.sparkSession
    path = f"{_stage_dir(spark, spark.sparkContext.applicationId)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that have been read for the last time."""
    for df in tables:
        _delete(df.sparkSession, df.staged_at)


def tidy(batches: Callable) -> Callable:
    """An Arrow function that gives its memory back to the system when a partition ends, as workers are used again."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _of_stage()
        try:
            yield from batches(rows)
        finally:
            release()

    return run


#: What tasks of one stage leave for each other in a worker: the stage, and values by key.
_KEPT: dict = {"stage": None, "values": {}}


def _of_stage() -> dict:
    """The values that this worker keeps for the running stage; those of an earlier stage are dropped."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if _KEPT["stage"] != stage:
        _KEPT.update(stage=stage, values={})
        release()
    return _KEPT["values"]


def kept(key: tuple, make: Callable):
    """make(), once for the tasks of a stage in this worker, until a task of another stage runs in it."""
    values = _of_stage()
    if key not in values:
        values[key] = make()
    return values[key]


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches end at 4 MB too, so that a run of very long texts does not fill a worker.

    The limit is the session's (Spark has none for a single plan) and stays, as plans are run after this returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def literal_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small bounded table as a JVM-side literal (no Python RDD)."""
    import json

    names = [c.split(" ")[0] for c in ddl.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = "array<struct<" + ",".join(c.replace(" ", ":", 1) for c in ddl.split(",")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of texts of at most limit bytes; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) over uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for each pair; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, np.float64), np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[starts]


def sample_ids(labels: DataFrame, docs: DataFrame, most_rows: int, most_bytes: int) -> list[int]:
    """doc_ids of a bounded, repeatable sample: lowest hashes first, until rows or bytes of text are used up.

    labels has doc_id; only ids, lengths and hashes reach the driver, most_rows of them.
    """
    found = (
        docs.select("doc_id", F.octet_length("text").alias("n"))
        .join(labels.select("doc_id").distinct(), "doc_id")
        .where("n > 0")
        .select("doc_id", "n", F.xxhash64(F.lit(17), "doc_id").alias("h"))
        .orderBy("h", "doc_id")
        .limit(most_rows)
        .collect()
    )
    ids, used = [], 0
    for r in found:
        if used + r.n <= most_bytes:
            ids.append(r.doc_id)
            used += r.n
    return ids


def fetch(docs: DataFrame, ids: list[int], *columns: str) -> DataFrame:
    """Rows of docs with these ids (a bounded list)."""
    keys = literal_rows(docs.sparkSession, [(i,) for i in ids], "doc_id long")
    return docs.join(F.broadcast(keys), "doc_id", "left_semi").select("doc_id", *columns)
