"""A corpus pipeline: toxicity, exact duplicates, near duplicates, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns them with the columns
of documents; the last returns tokens' counts and digests. Between stages rows lie in Parquet.

Decisions hold for rows, not for identifiers: toxicity filters rows where they are scored and mixing multiplies them where
they lie, both without a join on doc_id; the two deduplicating stages drop rows by doc_id and a hash of their text.

Edge cases: a null text counts as empty; of rows that agree in doc_id and text one stays (the smallest in all columns);
rows of one doc_id with different texts are documents of their own; a null doc_id is a value like others, taken last as the
one that stays; a table without rows goes through all stages; columns beside those of documents go through unchanged, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from verbarium.llm.common import staged, table, unstage

#: Rows to leave out are broadcast up to this number (16 bytes each); beyond it rows are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _only(docs: DataFrame, decided: DataFrame, text: Column) -> DataFrame:
    """The rows of docs that decided keeps, one of those that agree in doc_id and text.

    decided has a row for each of docs: doc_id, hash (xxHash64 of the expression text on docs) and kept.
    """
    keys = staged(decided.groupBy("doc_id", "hash").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "decisions")
    some = staged(keys.where("NOT kept OR rows > 1"), "decided")
    if few := some.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    # the rows as one column each, so that no name of docs can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"))
    same = F.col("id").eqNullSafe(some["doc_id"]) & (F.col("h") == some["hash"])
    out = rows.join(some, same, "left_anti").select("row.*")
    again = keys.where("kept AND rows > 1")
    if not again.isEmpty():
        repeated = rows.join(F.broadcast(again) if few else again, F.col("id").eqNullSafe(again["doc_id"]) & (F.col("h") == again["hash"]))
        out = out.unionByName(repeated.groupBy("id", "h").agg(F.min("row").alias("row")).select("row.*"))
    return out


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the toxicity classifier rejects."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest doc_id."""
    found = exact_dedup.groups(docs)
    return _only(docs, found.select("doc_id", F.xxhash64("text_sha256").alias("hash"), "kept"), F.sha2(exact_dedup.normal(F.col("text")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates keeps the document with the smallest doc_id."""
    found = near_dedup.classes(docs)
    return _only(docs, found.select("doc_id", F.col("text_hash").alias("hash"), "kept"), F.coalesce(F.col("text"), F.lit("")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.taken(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe.digests(docs, *bpe.public_ranks())


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("tokens", tokens)]
#: Compression distances, Order MinHash and byte-pair merges are not SQL; tests/llm/test_pipeline.py compares the rows that
#: the stages keep and return with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
