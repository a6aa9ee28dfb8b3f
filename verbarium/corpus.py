"""The three relations that every analysis stands on: tokens, document-term counts, document lengths.

Positions come from the order inside each document's token array, so none of them needs a shuffle; counts are partial
aggregates. Fixed value: the lexical token pattern (words with inner apostrophes and hyphens, numbers).
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEXICAL = r"[\p{L}\p{M}](?:[\p{L}\p{M}\p{Nd}]|['’-][\p{L}\p{M}\p{Nd}])*|\p{Nd}+(?:[.,]\p{Nd}+)*"
SURFACE = LEXICAL + r"|[^\s]"
#: Rows of the small tables of bucket sums that give global offsets.
BUCKETS = 1024


def terms(text: Column, pattern: str = LEXICAL) -> Column:
    """The normalised tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): lexical tokens."""
    return docs.select("doc_id", F.posexplode(terms(F.col("text"))).alias("pos", "term"))


def doc_term(docs: DataFrame) -> DataFrame:
    """(doc_id, term, n)."""
    return docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, len), documents without tokens included."""
    return docs.select("doc_id", F.size(terms(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("len"))


def offsets(sizes: DataFrame, key: str = "doc_id", size: str = "len") -> DataFrame:
    """sizes with off: the sum of all sizes before this key, without a single-task window over all rows.

    Keys fall into BUCKETS ranges of equal width; bucket sums are summed up in one small window, rows only within
    their bucket.
    """
    span = sizes.agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    width = F.greatest((F.col("__hi") - F.col("__lo")) / BUCKETS, F.lit(1.0))
    rows = sizes.crossJoin(F.broadcast(span)).withColumn("__b", F.floor((F.col(key) - F.col("__lo")) / width))
    sums = rows.groupBy("__b").agg(F.sum(size).alias("__s"))
    before = sums.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    inner = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(before), "__b").withColumn("off", F.col("__o") + F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return out.drop("__b", "__o", "__lo", "__hi")


def sequence(docs: DataFrame) -> DataFrame:
    """(i, term): all tokens at their place in the corpus, documents by id."""
    at = offsets(lengths(docs)).select("doc_id", "off")
    return tokens(docs).join(at, "doc_id").select((F.col("off") + F.col("pos")).alias("i"), "term")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there: its plan starts anew, in files that outlive any executor.

    The folder is spark.checkpoint.dir; in local mode an own one is set where that is unset, a cluster without one raises.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"file://{tempfile.gettempdir()}/verbarium-{os.getpid()}"
        context.setCheckpointDir(folder)
    return df.checkpoint()


def round6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


_SQL_PATTERN = LEXICAL.replace("'", "''")
#: SQL of the relations, for oracles: tok(doc_id, pos, term), dt(doc_id, term, n), len(doc_id, len), seq(i, term).
SQL = f"""
WITH arr AS (SELECT doc_id, source, lang, regexp_extract_all(lower(coalesce(text, '')), '{_SQL_PATTERN}') AS a FROM documents),
tok AS (SELECT doc_id, source, lang, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS term FROM arr),
dt AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL),
len AS (SELECT doc_id, CAST(len(a) AS BIGINT) AS len FROM arr),
off AS (SELECT doc_id, len, coalesce(sum(len) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM len),
seq AS (SELECT CAST(off + pos AS BIGINT) AS i, term FROM tok JOIN off USING (doc_id))"""
