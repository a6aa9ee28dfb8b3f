"""Exact deduplication by content-defined chunk recipes.

A text (A-Z lower-cased) is cut where a rolling hash of its last 32 bytes hits a mask, so equal passages give equal
chunks wherever they stand. Its recipe is the ordered list of its chunks' 16-byte fingerprints. A fingerprint is an
identifier only once verified: all chunks that carry it must have the same length and SHA-256, which a distributed
aggregation over the distinct chunks checks; if any two differ, the recipes are made again of SHA-256 identifiers.
Two texts are equal if their lists are equal, element by element and in length. A text is read once where it lies and
never moved: recipes (16 bytes for ~2 KB of text) and chunk digests are what is shuffled.

Edge cases: null counts as empty and the empty text has the empty recipe; repeated rows (same doc_id and text) are
counted one by one, and kept goes by doc_id, so it is true for each row of the largest one; null doc_ids come last
(a group of them only has keep_id null and keeps them); an empty table gives an empty result; extra columns are not read. A hot group is pre-aggregated; joining it back goes through a
sort-merge join whose large partitions Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import mix64, small_batches, staged, table, text_slices, tidy

WINDOW = 32
#: One cut in 2 ** CUT_BITS positions on average, none before LEAST bytes, one after MOST at the latest.
CUT_BITS, LEAST, MOST = 11, 256, 16384
#: Chunks that a task remembers as reported, so as to report fewer of them twice.
SEEN = 100_000
#: The gear table: 256 pseudo-random words from a rule.
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Chunk ends of each text in data, relative to data. Depends on the text alone, not on its neighbours."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:  # the gear hash of the last 2 * width bytes from two of width bytes
        grown = h.copy()
        grown[width:] += h[:-width] << np.uint32(width) if len(h) > width else 0
        h, width = grown, 2 * width
    marks = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0)
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, last = [], start
        for m in marks[np.searchsorted(marks, start + LEAST - 1) : np.searchsorted(marks, end)].tolist():
            while m + 1 - last > MOST:
                last += MOST
                ends.append(last)
            if m + 1 - last >= LEAST:
                last = m + 1
                ends.append(last)
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end > last:
            ends.append(end)
        out.append(ends)
    return out


def normalised(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    for first, last, data, offsets in text_slices(batch, column):
        yield first, last, _LOWER[data], offsets


_RECIPES = "doc_id long, text_sha256 string, recipe binary, chunks array<struct<fp:binary,sha:binary,size:int>>"


def _recipes(strong: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # chunks this task has reported already; a bounded memory of them
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, offsets in normalised(batch, "text"):
                raw, shas, recipes, news = data.tobytes(), [], [], []
                for i, ends in enumerate(cuts(data, offsets)):
                    at, recipe, new = int(offsets[i]), [], []
                    shas.append(hashlib.sha256(raw[at : int(offsets[i + 1])]).hexdigest())
                    for end in ends:
                        chunk = raw[at:end]
                        fp = hashlib.sha256(chunk).digest() if strong else xxhash.xxh3_128_digest(chunk)
                        recipe.append(fp)
                        if not strong and (key := fp + (sha := hashlib.sha256(chunk).digest())) not in seen:
                            if len(seen) > SEEN:
                                seen.clear()
                            seen.add(key)
                            new.append({"fp": fp, "sha": sha, "size": end - at})
                        at = end
                    recipes.append(b"".join(recipe))
                    news.append(new)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(shas, pa.string()), pa.array(recipes, pa.binary()), pa.array(news, pa.list_(pa.struct([("fp", pa.binary()), ("sha", pa.binary()), ("size", pa.int32())])))],
                    names=["doc_id", "text_sha256", "recipe", "chunks"],
                )

    return run


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe) of each row, the identifiers in the recipe verified. Staged in the shared folder."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")
    out = staged(source.mapInArrow(tidy(_recipes(False)), _RECIPES), "recipes")
    chunks = out.select(F.explode("chunks").alias("c")).groupBy("c.fp").agg(F.min("c.sha").alias("a"), F.max("c.sha").alias("b"), F.min("c.size").alias("m"), F.max("c.size").alias("n"))
    if chunks.where("a <> b or m <> n").isEmpty():
        return out.drop("chunks")
    return staged(source.mapInArrow(tidy(_recipes(True)), _RECIPES), "recipes").drop("chunks")


def chunk_store(docs: DataFrame) -> DataFrame:
    """Distinct chunks: (fp, size, documents that report it): what a chunk store would hold once."""
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", "text").mapInArrow(tidy(_recipes(False)), _RECIPES)
    return out.select("doc_id", F.explode("chunks").alias("c")).groupBy("c.fp").agg(F.max("c.size").alias("size"), F.count(F.lit(1)).alias("reports"))


def normal(text: Column) -> Column:
    """What texts are compared by, as a column: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    made = recipes(docs)
    # staged, so that the join below has a plain exchange on either side and AQE may split a hot recipe
    held = staged(made.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return made.join(held, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: exact duplicates of all documents, A-Z lower-cased."""
    return groups(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
