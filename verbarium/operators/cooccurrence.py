"""Co-occurrence in documents and in token windows, and the association measures of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.corpus import SQL, doc_term, round6, table, terms
from verbarium.operators.ranking import top_terms

LEFT, RIGHT, LEAST_JOINT, TOP = 4, 4, 2, 500


def measures(j: Column, a: Column, b: Column, n: Column) -> dict[str, Column]:
    """PMI and NPMI (natural logs), Dice, Jaccard, t-score, logDice; NULL where the joint count is 0."""
    seen = j > 0
    some = F.when(seen, j)
    p = some / n
    pmi = F.log(some * n / (a * b))
    return {
        "pmi": pmi,
        "npmi": F.when(seen & (j == n), F.lit(1.0)).otherwise(pmi / -F.log(F.when(p < 1, p))),
        "dice": 2 * some / (a + b),
        "jaccard": some / (a + b - some),
        "tscore": (some - a * b / n) / F.sqrt(some),
        "logdice": 14 + F.log2(2 * some / (a + b)),
    }


def _with_measures(pairs: DataFrame, *keys: str) -> DataFrame:
    m = measures(*(F.col(c) for c in ("joint", "a", "b", "universe")))
    return pairs.select(*keys, "joint", "a", "b", *(round6(v).alias(k) for k, v in m.items()))


def doc_pairs(docs: DataFrame, k: int = 30) -> DataFrame:
    """Presence pairs of the k top terms: (x, y, joint, first, second, neither)."""
    top = top_terms(docs, k).select("term", "df")
    have = docs.select("doc_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(F.broadcast(top), "term")
    sets = have.groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("t"))  # at most k terms each
    each = sets.select(F.posexplode("t").alias("i", "x"), "t").select("x", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("y"))
    joint = each.groupBy("x", "y").agg(F.count(F.lit(1)).alias("joint"))
    d = docs.agg(F.count(F.lit(1)).alias("universe"))
    a, b = top.select(F.col("term").alias("x"), F.col("df").alias("a")), top.select(F.col("term").alias("y"), F.col("df").alias("b"))
    out = joint.join(F.broadcast(a), "x").join(F.broadcast(b), "y").crossJoin(F.broadcast(d))
    return out.withColumn("first", F.col("a") - F.col("joint")).withColumn("second", F.col("b") - F.col("joint")).withColumn("neither", F.col("universe") - F.col("a") - F.col("b") + F.col("joint"))


def doc_cooc(docs: DataFrame) -> DataFrame:
    return doc_pairs(docs).select("x", "y", "joint", "first", "second", "neither")


def doc_colloc(docs: DataFrame) -> DataFrame:
    return _with_measures(doc_pairs(docs), "x", "y")


def window_pairs(docs: DataFrame, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """(node, collocate, joint, sum of distances, sum of 1 / distance) of all ordered pairs in a window, without self pairs.

    Every pair of places is made once, looking right, and summed up by unordered pair; a row is mirrored after that. Looking
    right from node u, v is a collocate of u within right places, and u one of v within left places.
    """
    a = docs.select(terms(F.col("text")).alias("t")).where(F.size("t") > 1)
    near = a.select("t", F.posexplode("t").alias("i", "u")).select("u", F.slice("t", F.col("i") + 2, max(left, right)).alias("w"))
    rows = near.select("u", F.posexplode("w").alias("k", "v")).where("u <> v").withColumn("d", F.col("k") + 1)
    after, before = ((F.col("d") <= side).cast("int") for side in (right, left))
    first = F.col("u") < F.col("v")
    ways = (("xy", F.when(first, after).otherwise(before)), ("yx", F.when(first, before).otherwise(after)))
    if left == right:  # both ways count the same
        ways = (("xy", F.lit(1)),)
    sums = [s for name, is_in in ways for s in (F.sum(is_in).alias(f"n_{name}"), F.sum(is_in * F.col("d")).alias(f"d_{name}"), F.sum(is_in / F.col("d")).alias(f"w_{name}"))]
    pairs = rows.groupBy(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).agg(*sums)
    way = lambda node, other, name: F.struct(F.col(node).alias("node"), F.col(other).alias("collocate"), F.col(f"n_{name}").alias("joint"), F.col(f"d_{name}").alias("dist"), F.col(f"w_{name}").alias("weighted"))
    return pairs.select(F.inline(F.array(way("x", "y", "xy"), way("y", "x", ways[-1][0])))).where("joint > 0")


def scored_pairs(docs: DataFrame, least: int = LEAST_JOINT) -> DataFrame:
    """All window pairs with at least this joint count, and their measures; totals are taken before that filter.

    The counted pairs are kept for the four places that read them, so that texts are tokenised once.
    """
    p = window_pairs(docs).persist()
    a = p.groupBy("node").agg(F.sum("joint").alias("a"))
    b = p.groupBy("collocate").agg(F.sum("joint").alias("b"))
    n = p.agg(F.sum("joint").alias("universe"))
    out = p.where(F.col("joint") >= least).join(a, "node").join(b, "collocate").crossJoin(F.broadcast(n))
    m = measures(*(F.col(c) for c in ("joint", "a", "b", "universe")))
    return out.select("node", "collocate", "joint", "a", "b", round6(F.col("dist") / F.col("joint")).alias("mean_distance"), round6("weighted").alias("weighted"), *(round6(v).alias(k) for k, v in m.items()))


def win_colloc(docs: DataFrame, least: int = LEAST_JOINT, top: int = TOP) -> DataFrame:
    """The strongest window pairs: a report of the top ones of scored_pairs."""
    return scored_pairs(docs, least).orderBy(F.desc("joint"), F.desc_nulls_last("logdice"), "node", "collocate").limit(top)


def _q(f, **k):
    return lambda spark, sf: f(table(spark, sf, "documents"), **k)


_M = """round(ln(joint * universe / (a * b)), 6) AS pmi, round(CASE WHEN joint = universe THEN 1.0 ELSE ln(joint * universe / (a * b)) / -ln(joint / universe) END, 6) AS npmi,
 round(2 * joint / (a + b), 6) AS dice, round(joint / (a + b - joint), 6) AS jaccard, round((joint - a * b / universe) / sqrt(joint), 6) AS tscore, round(14 + log2(2 * joint / (a + b)), 6) AS logdice"""
_DOC = SQL + """, top AS (SELECT term, count(*) AS df, sum(n) AS f FROM dt GROUP BY term ORDER BY df DESC, f DESC, term LIMIT 30),
h AS (SELECT doc_id, term, df FROM dt JOIN top USING (term)),
p AS (SELECT x.term AS x, y.term AS y, count(*) AS joint, x.df AS a, y.df AS b, (SELECT count(*) FROM documents) AS universe
  FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL)"""
_WIN = SQL + """, p AS (SELECT x.term AS node, y.term AS collocate, count(*) AS joint, sum(abs(y.pos - x.pos)) AS dist, sum(1 / abs(y.pos - x.pos)) AS weighted
  FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND y.pos BETWEEN x.pos - 4 AND x.pos + 4 AND y.pos <> x.pos AND x.term <> y.term GROUP BY ALL),
m AS (SELECT *, CAST(sum(joint) OVER (PARTITION BY node) AS BIGINT) AS a, CAST(sum(joint) OVER (PARTITION BY collocate) AS BIGINT) AS b, CAST(sum(joint) OVER () AS BIGINT) AS universe FROM p)"""
#: SQL up to s: all window pairs of joint count 2 or more with their measures.
SCORED = f"{_WIN}, s AS (SELECT node, collocate, joint, a, b, {_M} FROM m WHERE joint >= 2)"
QUERIES = {"doc_cooc": _q(doc_cooc), "doc_colloc": _q(doc_colloc), "win_colloc": _q(win_colloc), "topk_pairs": _q(win_colloc, least=3, top=50)}
ORACLES = {
    "doc_cooc": _DOC + " SELECT x, y, joint, a - joint AS first, b - joint AS second, universe - a - b + joint AS neither FROM p",
    "doc_colloc": f"{_DOC} SELECT x, y, joint, a, b, {_M} FROM p",
    **{k: f"""{_WIN} SELECT node, collocate, joint, a, b, round(dist / joint, 6) AS mean_distance, round(weighted, 6) AS weighted, {_M} FROM m
      WHERE joint >= {j} ORDER BY joint DESC, logdice DESC, node, collocate LIMIT {n}""" for k, j, n in (("win_colloc", 2, 500), ("topk_pairs", 3, 50))},
}
