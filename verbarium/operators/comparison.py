"""Group comparison: similarity and divergence, contingency, keyness, p-value adjustment.

Everything counts in one pass with conditional sums per term; a Python tail function is applied to finished rows only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from verbarium.corpus import SQL, doc_term, round6, table, terms
from verbarium.functions import distributions as D

ALPHA = 0.5


def two_groups(docs: DataFrame, by: str = "lang", target: str = "en", reference: str = "de") -> DataFrame:
    """(term, x, y): counts in the target and in the reference group, one aggregation of the tokens where they lie."""
    tokens = docs.where(F.col(by).isin(target, reference)).select(F.col(by).alias("__g"), F.explode(terms(F.col("text"))).alias("term"))
    return tokens.groupBy("term").agg(*(F.count_if(F.col("__g") == g).alias(c) for g, c in ((target, "x"), (reference, "y"))))


def over(top: Column, bottom: Column) -> Column:
    """top / bottom, NULL where bottom is 0: the measure is not defined."""
    return top / F.when(bottom != 0, bottom)


def divergences(pairs: DataFrame) -> DataFrame:
    """All measures of two count vectors (x, y): one aggregation over the terms. NULL where a measure is not defined (a group
    without tokens)."""
    w = pairs.crossJoin(F.broadcast(pairs.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("v"))))
    p, q = over(F.col("x"), F.col("sx")), over(F.col("y"), F.col("sy"))
    m = (p + q) / 2
    ls = lambda c, s: (F.col(c) + ALPHA) / (F.col(s) + ALPHA * F.col("v"))  # noqa: E731  Lidstone
    part = lambda a, b: F.when(a > 0, a * F.log2(a / F.when(b > 0, b))).otherwise(0.0)
    x, y = F.col("x"), F.col("y")
    s = w.agg(
        F.sum((x > 0).cast("long")).alias("nx"), F.sum((y > 0).cast("long")).alias("ny"), F.sum(((x > 0) & (y > 0)).cast("long")).alias("both"),
        F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum((x - y) * (x - y)).alias("dd"), F.sum(F.abs(x - y)).alias("md"),
        F.sum(F.least("x", "y")).alias("least"), F.sum(F.greatest("x", "y")).alias("most"), F.max("sx").alias("sx"), F.max("sy").alias("sy"),
        F.sum(part(p, q)).alias("kl_part"), F.max(((p > 0) & (q == 0)).cast("int")).alias("open"),
        F.sum(part(ls("x", "sx"), ls("y", "sy"))).alias("kl_smooth"), (0.5 * F.sum(part(p, m)) + 0.5 * F.sum(part(q, m))).alias("js"),
        F.sum((F.sqrt(p) - F.sqrt(q)) * (F.sqrt(p) - F.sqrt(q))).alias("h"),
    )
    c = F.col
    one = lambda top, bottom: F.when(bottom == 0, 1.0).otherwise(top / F.when(bottom == 0, 1).otherwise(bottom))
    both = (c("sx") > 0) & (c("sy") > 0)
    return s.select(
        c("both").alias("shared_types"), round6(one(c("both"), c("nx") + c("ny") - c("both"))).alias("jaccard"), round6(one(2 * c("both"), c("nx") + c("ny"))).alias("dice"),
        round6(over(c("xy"), F.sqrt(c("xx").cast("double") * c("yy")))).alias("cosine"), round6(F.sqrt("dd")).alias("euclidean"), c("md").alias("manhattan"),
        round6(over(c("least"), c("most"))).alias("weighted_jaccard"), round6(over(2 * c("least"), c("sx") + c("sy"))).alias("multiset_dice"),
        round6(F.when(both & (c("open") == 0), c("kl_part"))).alias("kl"), round6("kl_smooth").alias("kl_smooth"),
        round6(F.when(both, c("js"))).alias("js_div"), round6(F.when(both, F.sqrt("js"))).alias("js_dist"), round6(F.sqrt("h") / math.sqrt(2)).alias("hellinger"),
    )


def corpus_similarity(docs: DataFrame) -> DataFrame:
    return divergences(two_groups(docs))


@F.pandas_udf(DoubleType())
def _g_p(g: pd.Series) -> pd.Series:
    return g.map(lambda v: None if v is None or np.isnan(v) else math.erfc(math.sqrt(max(v, 0) / 2)))


@F.pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    cells = list(zip(a, b, c, d, strict=True))  # rare terms have few different tables: each is worked out once a batch
    known = {t: D.fisher_exact(*map(int, t)) for t in set(cells)}
    return pd.Series([known[t] for t in cells], dtype=float)


def bh(p: Column, family: Column, order: list) -> Column:
    """Benjamini-Hochberg adjusted p over all rows: the running minimum of family size * p / rank from the largest p.

    The minimum runs over the reversed order: a frame that grows costs one step a row, one that shrinks all its rows.
    """
    rank = F.row_number().over(Window.orderBy(p, *order))
    return F.least(F.lit(1.0), F.min(family * p / rank).over(Window.orderBy(p.desc(), *(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, 0)))


def keyness_stats(docs: DataFrame) -> DataFrame:
    """Per term: G squared, log2 ratio with +0.5, odds ratio with its Woolf and ratio with its Katz interval.

    A group without tokens leaves direction "equal": there is nothing to compare with.
    """
    pairs = two_groups(docs)
    w = pairs.crossJoin(F.broadcast(pairs.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))))
    x, y, sx, sy = (F.col(c) for c in ("x", "y", "sx", "sy"))
    n = sx + sy
    e = [(r * k / n) for r, k in ((x + y, sx), (x + y, sy), (n - x - y, sx), (n - x - y, sy))]
    cells = [x, y, sx - x, sy - y]
    g = 2 * sum((F.when(o > 0, o * F.log(F.when(o > 0, o).otherwise(1) / F.when(v > 0, v).otherwise(1.0))).otherwise(0.0) for o, v in zip(cells, e, strict=True)), F.lit(0.0))
    a, b, c, d = (v + 0.5 for v in (x, y, sx - x, sy - y))
    ratio = (a / (sx + 1)) / (b / (sy + 1))
    z = D.normal_quantile(0.975)
    se_ratio, se_odds = F.sqrt(1 / a - 1 / (sx + 1) + 1 / b - 1 / (sy + 1)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    odds = a * d / (b * c)
    return w.select(
        "term", "x", "y", "sx", "sy", round6(g).alias("g2"), round6(F.log2(ratio)).alias("log2_ratio"), round6(odds).alias("odds_ratio"),
        round6(F.log2(ratio) - z * se_ratio / math.log(2)).alias("ratio_low"), round6(F.log2(ratio) + z * se_ratio / math.log(2)).alias("ratio_high"),
        round6(F.exp(F.log(odds) - z * se_odds)).alias("odds_low"), round6(F.exp(F.log(odds) + z * se_odds)).alias("odds_high"),
        F.when(over(x, sx) > over(y, sy), "target").when(over(x, sx) < over(y, sy), "reference").otherwise("equal").alias("direction"), round6(F.least(*e)).alias("least_expected"),
    )


def keyness(docs: DataFrame) -> DataFrame:
    """keyness_stats with p (chi-square tail of G squared, or Fisher where an expected count is under 5) and q."""
    s = keyness_stats(docs)
    exact = s.where("least_expected < 5").withColumn("p", _fisher(F.col("x"), F.col("y"), F.col("sx") - F.col("x"), F.col("sy") - F.col("y")))
    rest = s.where("least_expected >= 5").withColumn("p", _g_p("g2"))
    out = exact.unionByName(rest)
    return out.withColumn("q", bh(F.col("p"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))), ["term"]))


def contingency(rows: DataFrame, r: str, c: str) -> DataFrame:
    """Cells with expected counts and adjusted residuals; empty margins do not occur in observed cells. The residual is NULL
    where one category holds all rows."""
    cells = rows.groupBy(F.col(r).alias("r"), F.col(c).alias("c")).agg(F.count(F.lit(1)).alias("o"))
    n = F.sum("o").over(Window.partitionBy(F.lit(1)))
    rt, ct = F.sum("o").over(Window.partitionBy("r")), F.sum("o").over(Window.partitionBy("c"))
    e = rt * ct / n
    return cells.select("r", "c", "o", round6(e).alias("expected"), round6(over(F.col("o") - e, F.sqrt(e * (1 - rt / n) * (1 - ct / n)))).alias("residual"), rt.alias("rt"), ct.alias("ct"), n.alias("n"))


def association(rows: DataFrame, r: str, c: str) -> DataFrame:
    """Chi-square over all cells (sum of o^2 / e over the observed ones, less n), degrees of freedom, Cramer's V."""
    x = contingency(rows, r, c)
    s = x.agg(F.sum(F.col("o") * F.col("o") / (F.col("rt") * F.col("ct") / F.col("n"))).alias("s"), F.max("n").alias("n"), F.countDistinct("r").alias("nr"), F.countDistinct("c").alias("nc"))
    chi = F.col("s") - F.col("n")
    k = F.least(F.col("nr"), F.col("nc")) - 1
    return s.select(round6(chi).alias("chi2"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("df"), round6(F.sqrt(over(chi, F.col("n") * k))).alias("cramers_v"), "n")


def monte_carlo(table: np.ndarray, simulations: int = 2000, seed: int = 20260918) -> float:
    """Monte Carlo p of chi-square under independence, (1 + extreme) / (1 + simulations).

    Tables are drawn from the margins, row by row, so the work does not grow with the number of observations.
    """
    rng = np.random.default_rng(seed)
    t = np.asarray(table, int)
    t = t[t.sum(1) > 0][:, t.sum(0) > 0]
    if min(t.shape) < 2:
        return 1.0
    e = np.outer(t.sum(1), t.sum(0)) / t.sum()
    seen, extreme = ((t - e) ** 2 / e).sum(), 0
    for _ in range(simulations):
        left, rows = t.sum(0), []
        for n in t.sum(1)[:-1]:
            rows.append(rng.multivariate_hypergeometric(left, n, method="marginals"))
            left = left - rows[-1]
        o = np.array([*rows, left])
        extreme += ((o - e) ** 2 / e).sum() >= seen * (1 - 1e-12)
    return (1 + extreme) / (1 + simulations)


def mc_chisq(spark, sf: str) -> DataFrame:
    """Monte Carlo p of quality by toxicity labels, on the reduced 2 x 2 table; rows without both labels take no part."""
    cells = table(spark, sf, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").groupBy("quality", "toxic").count().collect()
    t = np.zeros((2, 2), int)
    for r in cells:
        t[r.quality, r.toxic] += r["count"]
    return spark.createDataFrame([(float(monte_carlo(t)),)], "p double")


def fisher(spark, sf: str, target: str = "en", reference: str = "de") -> DataFrame:
    """Fisher's exact test of one term per row: in how many documents of two languages each term stands."""
    docs = table(spark, sf, "documents").where(F.col("lang").isin(target, reference))
    n = docs.agg(*(F.count_if(F.col("lang") == g).alias(c) for g, c in ((target, "nx"), (reference, "ny"))))
    have = docs.select("lang", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    df = have.groupBy("term").agg(*(F.count_if(F.col("lang") == g).alias(c) for g, c in ((target, "a"), (reference, "b"))))
    x = df.crossJoin(F.broadcast(n))
    return x.select("term", "a", "b", round6(_fisher(F.col("a"), F.col("b"), F.col("nx") - F.col("a"), F.col("ny") - F.col("b"))).alias("p"))


def vector_pairs(spark, sf: str) -> DataFrame:
    """Cosine, Euclidean and Manhattan of consecutive embeddings."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("g"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    z = lambda f: add(F.zip_with("e", "g", f))
    return v.join(w, "vec_id").select("vec_id", round6(z(lambda a, b: a * b) / F.sqrt(add(F.transform("e", lambda a: a * a)) * add(F.transform("g", lambda a: a * a)))).alias("cosine"), round6(F.sqrt(z(lambda a, b: (a - b) * (a - b)))).alias("euclidean"), round6(z(lambda a, b: F.abs(a - b))).alias("manhattan"))


def _only(*names: str):
    return lambda spark, sf: corpus_similarity(table(spark, sf, "documents")).select(*names)


def _q(f, **k):
    return lambda spark, sf: f(table(spark, sf, "documents"), **k)


def _flags(f):
    return lambda spark, sf: f(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


def lidstone(docs: DataFrame) -> DataFrame:
    p = two_groups(docs)
    return p.crossJoin(F.broadcast(p.agg(F.sum("x").alias("sx"), F.count(F.lit(1)).alias("v")))).select("term", round6((F.col("x") + ALPHA) / (F.col("sx") + ALPHA * F.col("v"))).alias("share"))


def adjusted(docs: DataFrame) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg over all terms, of a p-like value that SQL can also make: 1 / (1 + G squared).

    Equal p values share their adjusted value, that of the last of them, so the running sums and minima go over the
    different values only.
    """
    s = keyness_stats(docs).select("term", (1 / (1 + F.col("g2"))).alias("p"))
    values = s.groupBy("p").agg(F.count(F.lit(1)).alias("k"))
    up = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.crossJoin(F.broadcast(values.agg(F.sum("k").alias("m")))).withColumn("rank", F.sum("k").over(up))
    down = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    q = ranked.select("p", round6(F.least(F.lit(1.0), F.col("m") * F.col("p"))).alias("bonferroni"), round6(F.least(F.lit(1.0), F.min(F.col("m") * F.col("p") / F.col("rank")).over(down))).alias("bh"))
    return s.join(q, "p").select("term", "bonferroni", "bh")


_PAIRS = SQL + """, pr AS (SELECT term, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS x, CAST(count(*) FILTER (lang = 'de') AS BIGINT) AS y FROM tok WHERE lang IN ('en', 'de') GROUP BY term),
s AS (SELECT sum(x) AS sx, sum(y) AS sy, count(*) AS v FROM pr), pq AS (SELECT *, x / sx AS p, y / sy AS q FROM pr, s)"""
_KL = "CASE WHEN {0} > 0 THEN {0} * log2({0} / {1}) ELSE 0 END"
_SIM = f"""{_PAIRS}, a AS (SELECT count(*) FILTER (x > 0) AS nx, count(*) FILTER (y > 0) AS ny, count(*) FILTER (x > 0 AND y > 0) AS common,
 sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy, sum((x - y) * (x - y)) AS dd, sum(abs(x - y)) AS md, sum(least(x, y)) AS lo, sum(greatest(x, y)) AS hi,
 max(sx) AS sx, max(sy) AS sy, bool_or(p > 0 AND q = 0) AS op, sum({_KL.format('p', 'nullif(q, 0)')}) AS klp,
 sum(((x + 0.5) / (sx + 0.5 * v)) * log2(((x + 0.5) / (sx + 0.5 * v)) / ((y + 0.5) / (sy + 0.5 * v)))) AS kls,
 0.5 * sum({_KL.format('p', '((p + q) / 2)')}) + 0.5 * sum({_KL.format('q', '((p + q) / 2)')}) AS js, sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q))) AS h FROM pq),
r AS (SELECT common AS shared_types, round(common / (nx + ny - common), 6) AS jaccard, round(2 * common / (nx + ny), 6) AS dice, round(xy / sqrt(xx::DOUBLE * yy::DOUBLE), 6) AS cosine,
 round(sqrt(dd), 6) AS euclidean, CAST(md AS BIGINT) AS manhattan, round(lo / hi, 6) AS weighted_jaccard, round(2 * lo / (sx + sy), 6) AS multiset_dice,
 CASE WHEN op THEN NULL ELSE round(klp, 6) END AS kl, round(kls, 6) AS kl_smooth, round(js, 6) AS js_div, round(sqrt(js), 6) AS js_dist, round(sqrt(h) / sqrt(2), 6) AS hellinger FROM a)"""
_NAMES = {"jaccard_set": "jaccard", "dice_set": "dice", "cosine": "cosine", "euclidean": "euclidean", "manhattan": "manhattan", "kl": "kl_smooth", "js_div": "js_div", "js_dist": "js_dist", "hellinger": "hellinger", "weighted_jaccard": "weighted_jaccard", "multiset_dice": "multiset_dice"}
_Z = "1.959963984540054"
_KEY = f"""{_PAIRS}, k AS (SELECT *, sx + sy AS n, x + 0.5 AS a, y + 0.5 AS b, sx - x + 0.5 AS c, sy - y + 0.5 AS d FROM pq),
key AS (SELECT term, x, y, CAST(sx AS BIGINT) AS sx, CAST(sy AS BIGINT) AS sy, round(2 * ({' + '.join(f'CASE WHEN {o} > 0 THEN {o} * ln({o} / ({r} * {t} / n)) ELSE 0 END' for o, r, t in (('x', '(x + y)', 'sx'), ('y', '(x + y)', 'sy'), ('(sx - x)', '(n - x - y)', 'sx'), ('(sy - y)', '(n - x - y)', 'sy')))}), 6) AS g2,
 round(log2((a / (sx + 1)) / (b / (sy + 1))), 6) AS log2_ratio, round(a * d / (b * c), 6) AS odds_ratio,
 round(log2((a / (sx + 1)) / (b / (sy + 1))) - {_Z} * sqrt(1 / a - 1 / (sx + 1) + 1 / b - 1 / (sy + 1)) / ln(2), 6) AS ratio_low,
 round(log2((a / (sx + 1)) / (b / (sy + 1))) + {_Z} * sqrt(1 / a - 1 / (sx + 1) + 1 / b - 1 / (sy + 1)) / ln(2), 6) AS ratio_high,
 round(exp(ln(a * d / (b * c)) - {_Z} * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS odds_low, round(exp(ln(a * d / (b * c)) + {_Z} * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 6) AS odds_high,
 CASE WHEN p > q THEN 'target' WHEN p < q THEN 'reference' ELSE 'equal' END AS direction,
 round(least((x + y) * sx / n, (x + y) * sy / n, (n - x - y) * sx / n, (n - x - y) * sy / n), 6) AS least_expected FROM k)"""
_CON = """WITH c AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS o FROM lineitem GROUP BY ALL),
x AS (SELECT *, CAST(sum(o) OVER (PARTITION BY r) AS BIGINT) AS rt, CAST(sum(o) OVER (PARTITION BY c) AS BIGINT) AS ct, CAST(sum(o) OVER () AS BIGINT) AS n FROM c)"""
QUERIES = {
    "corpus_similarity": _q(corpus_similarity), **{k: _only(v) for k, v in _NAMES.items()}, "lidstone": _q(lidstone), "vector_distances": vector_pairs,
    "keyness_stats": _q(keyness_stats), "keyness": _q(keyness), "p_adjust": _q(adjusted), "bonferroni": lambda s, sf: adjusted(table(s, sf, "documents")).select("term", "bonferroni"),
    "bh": lambda s, sf: adjusted(table(s, sf, "documents")).select("term", "bh"), "contingency": _flags(contingency), "association": _flags(association), "fisher": fisher, "mc_chisq": mc_chisq,
}
_BH = _KEY + """, ps AS (SELECT term, 1 / (1 + g2) AS p FROM key), m AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, term) AS rk FROM ps),
adj AS (SELECT term, round(least(1.0, m * p), 6) AS bonferroni, round(least(1.0, min(m * p / rk) OVER (ORDER BY p, term ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh FROM m)"""
ORACLES = {
    "corpus_similarity": _SIM + " SELECT * FROM r", **{k: f"{_SIM} SELECT {v} FROM r" for k, v in _NAMES.items()},
    "lidstone": _PAIRS + " SELECT term, round((x + 0.5) / (sx + 0.5 * v), 6) AS share FROM pq",
    "vector_distances": """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS euclidean,
      round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda t: abs(t[1] - t[2]))), 6) AS manhattan FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "keyness_stats": _KEY + " SELECT * FROM key", "p_adjust": _BH + " SELECT * FROM adj", "bonferroni": _BH + " SELECT term, bonferroni FROM adj", "bh": _BH + " SELECT term, bh FROM adj",
    "contingency": _CON + " SELECT r, c, o, round(rt * ct / n, 6) AS expected, round((o - rt * ct / n) / sqrt(rt * ct / n * (1 - rt / n) * (1 - ct / n)), 6) AS residual, rt, ct, n FROM x",
    "association": _CON + """, s AS (SELECT sum(o * o / (rt * ct / n)) - max(n) AS chi, max(n) AS n, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc FROM x)
      SELECT round(chi, 6) AS chi2, (nr - 1) * (nc - 1) AS df, round(sqrt(chi / (n * (least(nr, nc) - 1))), 6) AS cramers_v, n FROM s""",
    "fisher": SQL + """, n AS (SELECT count(*) FILTER (lang = 'en') AS nx, count(*) FILTER (lang = 'de') AS ny FROM documents),
      d AS (SELECT term, count(DISTINCT doc_id) FILTER (lang = 'en') AS a, count(DISTINCT doc_id) FILTER (lang = 'de') AS b FROM tok WHERE lang IN ('en', 'de') GROUP BY term),
      t AS (SELECT term, a, b, nx, ny, a + b AS k, unnest(range(greatest(0, a + b - ny), least(nx, a + b) + 1)) AS i FROM d, n),
      p AS (SELECT *, exp(lgamma(nx + 1) + lgamma(ny + 1) + lgamma(k + 1) + lgamma(nx + ny - k + 1) - lgamma(nx + ny + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(nx - i + 1) - lgamma(k - i + 1) - lgamma(ny - k + i + 1)) AS pr FROM t),
      o AS (SELECT *, max(CASE WHEN i = a THEN pr END) OVER (PARTITION BY term) AS seen FROM p)
      SELECT term, a, b, round(least(1.0, sum(pr) FILTER (pr <= seen * (1 + 1e-7))), 6) AS p FROM o GROUP BY term, a, b""",
}
