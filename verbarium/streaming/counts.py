"""Term counts over a stream of documents (an extension: the analysed feature set has no streaming).

Documents (ts timestamp, doc_id, text) become counts per event-time window and term; the watermark bounds both the
state and how late a document may come. Append mode emits each window once, when it is final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.corpus import terms


def windowed_terms(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, term, n, documents approximately)."""
    rows = stream.withWatermark("ts", late).select("ts", "doc_id", F.explode(terms(F.col("text"))).alias("term"))
    counts = rows.groupBy(F.window("ts", width).alias("w"), "term").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("documents"))
    return counts.select(F.col("w.start").alias("start"), "term", "n", "documents")


def run(stream: DataFrame, path: str, checkpoint: str, width: str = "1 hour", late: str = "10 minutes"):
    """Starts writing final windows to Parquet under path; returns the streaming query."""
    return windowed_terms(stream, width, late).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
