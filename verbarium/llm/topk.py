"""Exact top-k inner product search by norm buckets.

Vectors are put into buckets of similar length, longest first. A query's k-th best score so far, theta, makes a local
cosine threshold in each bucket: theta / (|query| * longest vector of the bucket). Above 1 the bucket holds no result.
Below it candidates are cut either by length (only those with |p| >= theta / |query| can reach theta) or, if the
threshold is high enough for that to be sharper, by coordinates: a unit vector at cosine t or more to the query has
its value in the query's largest coordinates inside known intervals. What is left is verified by exact integer
products: in doubles where the lengths' product is under 2 ** 53, which bounds every partial sum, else in unbounded integers.

Plan: a histogram of lengths in BINS steps a doubling gives the buckets of about BLOCK rows (a bin of more rows is dealt
out by a hash of the identifier); a bucket and a block of QUERIES queries are packed into one binary row each.
Phase 1 meets all query blocks with the bucket of the longest vectors and yields theta per query; phase 2 meets
them with the other buckets under theta and keeps k results a query and bucket at most, of which a window takes the
best k. Scores equal to theta are kept, so ties go to the smaller vec_id. No result is approximate.

Edge cases: vectors null, or holding a null or non-finite component, take no part; vectors of another dimension than
the query's are no candidates; fewer than k candidates give all; repeated vec_ids are candidates of each other's
queries only under another vec_id; a component whose 64-fold leaves the range of doubles counts as the largest double;
a score beyond the range of a long is given, and ranked, as the nearest long; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.llm.common import small_batches, staged, table, tidy

K = 20
SCALE = 64
#: Candidates in a bucket, queries in a block.
BLOCK, QUERIES = 4096, 2048
#: Histogram bins per doubling of the squared length: neighbours in a bin differ by 0.3 % in squared length.
BINS = 256
#: From this local cosine threshold on, coordinates prune.
SHARP = 0.6
#: Coordinates looked at.
FOCUS = 3
#: Products of lengths under which double arithmetic is exact, and the largest long and double.
EXACT, LONG, DOUBLE = 2.0**53, (1 << 63) - 1, 1.7976931348623157e308


def _scaled(c: Column) -> Column:
    wide = F.greatest(F.least(SCALE * c.cast("double"), F.lit(DOUBLE)), F.lit(-DOUBLE))
    return F.when(F.abs(wide) < EXACT, F.floor(F.when(F.abs(wide) < EXACT, wide).otherwise(0.0)).cast("double")).otherwise(wide)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v array<int>, n2 squared length) of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    out = vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
    out = out.select("vec_id", F.size(x).alias("dim"), F.transform(x, _scaled).alias("v"))
    return out.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """One row from the rows of a block: identifiers and matrix as bytes, longest first, and the longest's length."""
    n2 = rows.column("n2").to_numpy()
    order = np.lexsort((rows.column("vec_id").to_numpy(), -n2))
    ids = rows.column("vec_id").to_numpy()[order].astype(np.int64)
    dim = key[0].as_py()
    flat = rows.column("v").combine_chunks()
    matrix = np.asarray(flat.flatten(), np.float64).reshape(-1, dim)[order] if dim else np.zeros((len(ids), 0))
    most = np.abs(matrix).max(initial=0.0)
    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "f8"
    columns = {
        "dim": pa.array([dim], pa.int32()),
        "block": pa.array([key[1].as_py()], pa.int32()),
        "longest": pa.array([float(np.sqrt(n2.max(initial=0.0)))], pa.float64()),
        "ids": pa.array([ids.tobytes()], pa.binary()),
        "kind": pa.array([kind], pa.string()),
        "m": pa.array([matrix.astype(kind).tobytes()], pa.binary()),
    }
    return pa.table(columns)


_PACKED = "dim int, block int, longest double, ids binary, kind string, m binary"


def _products(m: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of the rows of m with q, held to the range of a long; bound is the product of the lengths."""
    if bound < EXACT:
        return m @ q
    whole = [int(x) for x in q.tolist()]
    found = [max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in m.tolist()]
    return np.array(found, np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest identifier."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                qids = np.frombuffer(row["q_ids"], np.int64)
                ids, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_m"], row["q_kind"]).astype(float).reshape(len(qids), dim)
                m = np.frombuffer(row["m"], row["kind"]).astype(float).reshape(len(ids), dim)
                theta = np.frombuffer(row["theta"]) if row["theta"] is not None else np.full(len(qids), -np.inf)
                with np.errstate(over="ignore"):
                    norms, qn = np.sqrt((m * m).sum(1)), np.sqrt((q * q).sum(1))
                    unit = m / np.maximum(norms, 1e-300)[:, None]
                out_q, out_id, out_s, bar = [], [], [], theta.copy()
                for j in range(len(qids)):
                    some, bound = slice(0, len(ids)), float(qn[j] * norms[0]) if qn[j] else 0.0
                    if theta[j] > 0 and bound < EXACT:
                        if qn[j] * norms[0] * (1 + 1e-9) < theta[j]:
                            continue  # the whole bucket is too short
                        end = int(np.searchsorted(-norms, -theta[j] / qn[j] * (1 - 1e-9), "right"))
                        some = slice(0, end)
                        local = theta[j] / (qn[j] * norms[0])
                        if local >= SHARP:
                            some = _near(unit[:end], q[j] / qn[j], min(local, 1.0) * (1 - 1e-9))
                    scores, own = _products(m[some], q[j], bound), ids[some]
                    keep = np.flatnonzero((own != qids[j]) & (scores >= theta[j]))
                    best = keep[_best(scores[keep], own[keep], k)]
                    if len(best) == k:
                        bar[j] = scores[best[-1]] if bound < EXACT else np.nextafter(float(scores[best[-1]]), -np.inf)
                    out_q.append(np.full(len(best), qids[j]))
                    out_id.append(own[best])
                    out_s.append(scores[best].astype(np.int64))
                lists = [pa.array([np.concatenate(x) if x else np.zeros(0, np.int64)], pa.list_(pa.int64())) for x in (out_q, out_id, out_s)]
                # the length that a vector needs to be a result of any query here
                least = float(np.where(bar > 0, bar / np.maximum(qn, 1e-300), 0.0).min(initial=np.inf))
                head = [pa.array([dim], pa.int32()), pa.array([row["q_block"]], pa.int32()), pa.array([bar.tobytes()], pa.binary()), pa.array([least], pa.float64())]
                yield pa.RecordBatch.from_arrays([*head, *lists], names=["dim", "q_block", "theta", "least", "query_id", "vec_id", "score"])

    return run


def _near(unit: np.ndarray, q: np.ndarray, t: float) -> np.ndarray:
    """Places of unit vectors that may be at cosine t or more to q, by q's largest coordinates."""
    keep = np.ones(len(unit), bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        wide = np.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f]))) + 1e-9
        low = -1.0 if q[f] <= -t else q[f] * t - wide
        high = 1.0 if q[f] >= t else q[f] * t + wide
        keep &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
    return np.flatnonzero(keep)


_FOUND = "dim int, q_block int, theta binary, least double, query_id array<long>, vec_id array<long>, score array<long>"


def buckets(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """rows with block: 0 holds the longest vectors of its dimension; about size rows in each.

    Squared lengths are counted by dimension and bin, so the window over a dimension has at most 2048 * BINS rows
    whatever the input; running counts cut the bins into blocks, and a bin with more rows than a block is dealt out over
    several by a hash of the identifier. Bounds on a block use its own longest vector, so bins need not be exact.
    """
    rows = rows.withColumn("bin", F.floor(F.least(F.log2(F.col("n2") + 1), F.lit(2048.0)) * BINS).cast("int"))
    counts = rows.groupBy("dim", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("dim").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    ends = F.floor((F.col("before") + F.col("n") - 1) / size).cast("int")
    cut = staged(cut.select(F.col("dim").alias("__d"), F.col("bin").alias("__bin"), F.floor(F.col("before") / size).cast("int").alias("first"), ends.alias("last")), "norms")
    joined = rows.join(cut, (F.col("dim") == F.col("__d")) & (F.col("bin") == F.col("__bin")))
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("last") - F.col("first") + 1).cast("int")
    return joined.select("vec_id", "dim", "v", "n2", block.alias("block"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, size: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row where is_query (a condition on vec_id)."""
    small_batches(vectors.sparkSession)
    rows = staged(integers(vectors), "vectors")
    packed = staged(buckets(rows, size).groupBy("dim", "block").applyInArrow(_pack, _PACKED), "buckets")
    asked = rows.where(is_query)
    q_block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-asked.count() // QUERIES)))).cast("int")
    asked = asked.withColumn("block", q_block).groupBy("dim", "block").applyInArrow(_pack, _PACKED)
    asked = staged(asked.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("m").alias("q_m")), "questions")

    columns = ["dim", "q_block", "q_ids", "q_kind", "q_m", "ids", "kind", "m", "theta"]
    first = asked.withColumn("block", F.lit(0)).join(packed, ["dim", "block"]).withColumn("theta", F.lit(None).cast("binary"))
    found = staged(first.select(*columns).mapInArrow(tidy(_search(k)), _FOUND), "found")
    # which block of queries has to meet which bucket: numbers only, before the matrices move
    bounds = packed.where("block > 0").select("dim", "block", "longest")
    meet = found.select("dim", "q_block", "theta", "least").join(bounds, "dim").where(F.col("longest") * (1 + 1e-9) >= F.col("least"))
    under = asked.join(meet.select("dim", "q_block", "block", "theta"), ["dim", "q_block"]).join(packed, ["dim", "block"])
    rest = under.select(*columns).mapInArrow(tidy(_search(k)), _FOUND)
    each = found.unionByName(rest).select(F.inline(F.arrays_zip("query_id", "vec_id", "score")))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: of each vector whose id is divisible by 20, the 20 highest integer inner products."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, K)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
