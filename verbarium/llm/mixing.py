"""Mixing sources to target weights by hash-threshold histograms, as DataFrame operations only.

Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share the total size by weight; a source's target
stops at MOST_REPEATS times its size and the excess goes to the others by weight until none is above its limit.
Of a source with target t and size s every document is taken floor(t / s) times, and once more if its hash lies
below the source's threshold. Thresholds for growing budgets are nested: a larger budget takes a superset.

Finding a threshold never sorts documents. Level 1 sums sizes by (source, highest BITS bits of the hash); where the
running sum crosses the budget lies the boundary bucket. Level 2 sums only rows of the boundary buckets by the next
bits, and so on until all LEVELS * BITS bits are used. Then the documents are filtered by hash <= threshold.
Histograms are aggregated before they are shuffled, so a hot source costs one row per bucket and task. The per-source
plan is a staged table of known size: Spark broadcasts it below its size limit and shuffles (and splits) beyond. Targets
take windows over one row per source in one task: fine for sources by the hundred thousand.

Edge cases: a null text has size 0; null sources form one source; an empty table gives an empty result; a source of
size 0 has target 0 and its documents are taken once per whole share (times may be 0). Rows with the same doc_id
share a hash and are taken together. The last threshold takes the crossing hash if that is nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.llm.common import staged, table, unstage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = 3
MOST_REPEATS = 3
#: Hash bits by level; 60 bits in all, so that hashes are positive longs in any SQL.
BITS, LEVELS = 12, 5


def hash60(key: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 of the key as text: the same in every engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> also weight and target: water-filling in closed form over the sources.

    In order of limit / weight, the level for the sources not yet at their limit is
    (total - limits before) / (weights left); the first source whose ratio reaches that level fixes it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("__ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    out = sizes.withColumn("weight", (F.row_number().over(order) - 1) % WEIGHTS + 1)
    out = out.withColumn("__limit", MOST_REPEATS * F.col("source_size")).withColumn("__ratio", F.col("__limit") / F.col("weight"))
    out = out.withColumn("__full", F.coalesce(F.sum("__limit").over(ratio), F.lit(0))).withColumn("__gone", F.coalesce(F.sum("weight").over(ratio), F.lit(0)))
    out = out.withColumn("__level", (F.sum("source_size").over(whole) - F.col("__full")) / (F.sum("weight").over(whole) - F.col("__gone")))
    out = out.withColumn("__fixed", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.col("__ratio"))).over(whole))
    out = out.withColumn("__cut", F.max(F.when(F.col("__ratio") == F.col("__fixed"), F.col("__level"))).over(whole))
    target = F.when(F.col("__ratio") < F.coalesce("__fixed", F.lit(0.0)), F.col("__limit").cast("double")).otherwise(F.least(F.col("__limit").cast("double"), F.col("weight") * F.col("__cut")))
    return out.select("source", "source_size", F.col("weight").cast("int").alias("weight"), F.coalesce(target, F.lit(0.0)).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows (source, h, size), budgets (source, budget) -> (source, threshold): take h < threshold, about budget in all."""
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double").alias("left"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(state, (rows["source"].eqNullSafe(state["source"])) & (F.shiftright(rows["h"], shift + BITS) == state["prefix"]))
        sums = inside.groupBy(state["source"], "prefix", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("upto", F.sum("size").over(upto))
        crossed = run.where("upto >= left").groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "left")).alias("x"))
        found = crossed.select("source", F.col("x.bucket").alias("bucket"), (F.col("x.left") - F.col("x.upto") + F.col("x.size")).alias("left"), F.col("x.size").alias("size"))
        if level < LEVELS - 1:
            state = staged(found.select("source", F.col("bucket").alias("prefix"), "left"), "mix-level")
        else:
            state = found
    return state.select("source", F.when(F.col("left") * 2 >= F.col("size"), F.col("bucket") + 1).otherwise(F.col("bucket")).alias("threshold"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h) of each document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), hash60(F.col(key)).alias("h"))


def cuts(rows: DataFrame) -> DataFrame:
    """One row per source of staged rows (source, size, h): __source, source_size, target, whole, threshold.

    A document of the source is taken whole times, and once more if its hash is under the threshold. The table is staged:
    its size is known, so documents of a hot source meet it by broadcast (or by a join that AQE can split).
    """
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = staged(plan.withColumn("whole", F.floor(share).cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    found = thresholds(rows, plan.where("budget > 0").select("source", "budget"))
    joined = plan.join(found.select(F.col("source").alias("__s"), "threshold"), F.col("source").eqNullSafe(F.col("__s")), "left")
    return staged(joined.select(F.col("source").alias("__source"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")), "mix-cuts")


def times(h: Column, plan: DataFrame) -> Column:
    """How often the mix takes a document with this hash."""
    return plan["whole"] + F.when(h < plan["threshold"], 1).otherwise(0)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, times (copies taken), taken (words taken)."""
    rows = staged(sized(docs, key, text, source), "mix-rows")
    plan = cuts(rows)
    out = rows.join(plan, rows["source"].eqNullSafe(plan["__source"])).withColumn("times", times(rows["h"], plan))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as many times as the mix takes it."""
    rows = staged(sized(docs, key, text, source).select("source", "size", "h"), "mix-rows")
    plan = cuts(rows)
    unstage(rows)
    copies = F.explode(F.expr("sequence(1L, __times)"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))  # no name in docs can clash
    out = whole.join(plan, F.col(f"__row.`{source}`").eqNullSafe(plan["__source"]))
    out = out.withColumn("__times", times(hash60(F.col(f"__row.`{key}`")), plan)).where("__times > 0")
    return out.select("__row", copies).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


#: The same by sorting: running sums over the hash order, and the crossing document if that is nearer to the budget.
SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source),
fill(round, source, source_size, weight, fixed) AS (
  SELECT 0, source, source_size, weight, source_size = 0 FROM src
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         fixed OR 3.0 * source_size < weight * (
           (sum(source_size) OVER () - sum(CASE WHEN fixed THEN 3 * source_size ELSE 0 END) OVER ())
           / nullif(sum(CASE WHEN fixed THEN 0 ELSE weight END) OVER (), 0))
  FROM fill WHERE round < 40),
target AS (
  SELECT source, source_size,
         CASE WHEN fixed THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * (
           (sum(source_size) OVER () - sum(CASE WHEN fixed THEN 3 * source_size ELSE 0 END) OVER ())
           / nullif(sum(CASE WHEN fixed THEN 0 ELSE weight END) OVER (), 0)) AS DOUBLE) END AS target
  FROM fill WHERE round = 40),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS budget
  FROM target),
run AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS at_h
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
final AS (
  SELECT *, CAST(whole + CASE WHEN budget > 0 AND (upto < budget OR (upto - at_h < budget AND (budget - upto + at_h) * 2 >= at_h)) THEN 1 ELSE 0 END AS BIGINT) AS times
  FROM run)
SELECT doc_id, size, source_size, target, CAST(times * size AS BIGINT) AS taken, source, times FROM final
"""
