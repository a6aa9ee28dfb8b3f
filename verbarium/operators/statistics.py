"""Tests over samples: Spark makes sufficient statistics and midranks, Python the tails of the one row that is left.

A sample is a DataFrame (g, v): group and value. p-values are in their own columns, NULL where a test is undefined.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.corpus import lengths, offsets, round6, table
from verbarium.functions import distributions as D

SEED = 20260918
MASK = (1 << 64) - 1


def moments(sample: DataFrame) -> DataFrame:
    return sample.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))


def _groups(sample: DataFrame) -> list:
    """One row per group: a bounded number of them by the nature of a factor."""
    return sorted(moments(sample).collect(), key=lambda r: str(r.g))


def _row(spark, names: str, *values) -> DataFrame:
    return spark.createDataFrame([tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in values)], ", ".join(f"{n} double" for n in names.split()))


def welch(sample: DataFrame) -> DataFrame:
    """Welch's t of the first two groups, Satterthwaite df, pooled d, Hedges' g with its exact factor. All NULL where there are
    not two groups of two values, or no variance."""
    a, b = (_groups(sample) + [None, None])[:2]
    if b is None or min(a.n, b.n) < 2 or not a.s2 + b.s2:
        return _row(sample.sparkSession, "t df p d g", *[None] * 5)
    va, vb = a.s2 / a.n, b.s2 / b.n
    t = (a.m - b.m) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va * va / (a.n - 1) + vb * vb / (b.n - 1))
    pooled = math.sqrt(((a.n - 1) * a.s2 + (b.n - 1) * b.s2) / (a.n + b.n - 2))
    d, f = (a.m - b.m) / pooled, a.n + b.n - 2
    j = math.exp(math.lgamma(f / 2) - math.lgamma((f - 1) / 2)) / math.sqrt(f / 2)
    return _row(sample.sparkSession, "t df p d g", t, df, D.t_tail(t, df), d, d * j)


def anova(sample: DataFrame) -> DataFrame:
    """One-way analysis of variance; all NULL with one group, without variance inside groups, or without degrees of freedom."""
    g = _groups(sample)
    n, k = sum(r.n for r in g), len(g)
    if k < 2 or n <= k or not sum((r.n - 1) * (r.s2 or 0.0) for r in g):
        return _row(sample.sparkSession, "f df1 df2 p eta2", *[None] * 5)
    mean = sum(r.n * r.m for r in g) / n
    between, within = sum(r.n * (r.m - mean) ** 2 for r in g), sum((r.n - 1) * (r.s2 or 0.0) for r in g)
    f = (between / (k - 1)) / (within / (n - k))
    return _row(sample.sparkSession, "f df1 df2 p eta2", f, float(k - 1), float(n - k), D.f_tail(f, k - 1, n - k), between / (between + within))


def one_sample(values: DataFrame, mean: float = 0.0) -> DataFrame:
    """Student's t of one sample; all NULL with fewer than two values or without variance."""
    r = values.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    if not r.s:
        return _row(values.sparkSession, "t df p", None, None, None)
    t = (r.m - mean) / (r.s / math.sqrt(r.n))
    return _row(values.sparkSession, "t df p", t, float(r.n - 1), D.t_tail(t, r.n - 1))


def midranks(sample: DataFrame) -> DataFrame:
    """sample with r (midrank) and ties (rows of this value): counts by value, running sums over the distinct values.

    Values go into ranges by approximate quantiles first, so that no task sorts all distinct values.
    """
    counts = sample.groupBy("v").agg(F.count(F.lit(1)).alias("ties"))
    cuts = sample.approxQuantile("v", [i / 64 for i in range(1, 64)], 0.005)
    edges = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    counts = counts.withColumn("__b", F.size(F.filter(edges, lambda c: c < F.col("v"))))
    sums = counts.groupBy("__b").agg(F.sum("ties").alias("s")).select("__b", F.coalesce(F.sum("s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    inner = Window.partitionBy("__b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.join(F.broadcast(sums), "__b").withColumn("r", F.col("o") + F.coalesce(F.sum("ties").over(inner), F.lit(0)) + (F.col("ties") + 1) / 2)
    return sample.join(ranks.select("v", "r", "ties"), "v")


def _ties(ranked: DataFrame) -> Column:
    """Sum of t^3 - t over tie groups, as a sum over rows."""
    return F.sum(F.col("ties").cast("double") * F.col("ties") - 1)


def mann_whitney(sample: DataFrame) -> DataFrame:
    """U of both groups, z with continuity and tie correction, rank-biserial correlation. All NULL with one group or one value."""
    x = midranks(sample)
    g = sorted(x.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r")).collect(), key=lambda r: str(r.g))[:2]
    ties = x.agg(_ties(x).alias("t")).first().t
    if len(g) < 2 or ties == sum(r.n for r in g) ** 3 - sum(r.n for r in g):
        return _row(sample.sparkSession, "u1 u2 z p rank_biserial", *[None] * 5)
    a, b = g
    u1 = a.r - a.n * (a.n + 1) / 2
    u2, n = a.n * b.n - u1, a.n + b.n
    sd = math.sqrt(a.n * b.n / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (u1 - a.n * b.n / 2 - math.copysign(0.5, u1 - a.n * b.n / 2)) / sd if u1 != u2 else 0.0
    return _row(sample.sparkSession, "u1 u2 z p rank_biserial", float(u1), float(u2), z, 2 * D.normal_cdf(-abs(z)), 2 * u1 / (a.n * b.n) - 1)


def kruskal(sample: DataFrame) -> DataFrame:
    x = midranks(sample)
    g = x.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r")).collect()
    ties, n = x.agg(_ties(x).alias("t")).first().t, sum(r.n for r in g)
    if len(g) < 2 or ties == n**3 - n:
        return _row(sample.sparkSession, "h df p epsilon2", *[None] * 4)
    h = (12 / (n * (n + 1)) * sum(r.r**2 / r.n for r in g) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    return _row(sample.sparkSession, "h df p epsilon2", h, float(len(g) - 1), D.chi2_tail(h, len(g) - 1), h / (n - 1))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed ranks of x - y without zeros: W+, W-, z with continuity and tie correction."""
    d = pairs.select((F.col("x") - F.col("y")).alias("d")).where("d <> 0")
    x = midranks(d.select(F.signum("d").alias("g"), F.abs("d").alias("v")))
    r = x.agg(F.sum(F.when(F.col("g") > 0, F.col("r")).otherwise(0)).alias("w"), F.count(F.lit(1)).alias("n"), _ties(x).alias("t")).first()
    mean = r.n * (r.n + 1) / 4
    sd = math.sqrt(r.n * (r.n + 1) * (2 * r.n + 1) / 24 - r.t / 48)
    z = (r.w - mean - math.copysign(0.5, r.w - mean)) / sd if r.w != mean else 0.0
    return _row(pairs.sparkSession, "w_plus w_minus z p", float(r.w), r.n * (r.n + 1) / 2 - r.w, z, 2 * D.normal_cdf(-abs(z)))


def correlation(pairs: DataFrame, ranks: bool = False) -> DataFrame:
    """Pearson's (or Spearman's) r, t, p and Fisher's interval."""
    if ranks:
        pairs = _rank_pairs(pairs)
    s = pairs.agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).first()
    r, n = s.r, s.n
    t = r * math.sqrt((n - 2) / max(1 - r * r, 1e-300))
    e, z = math.atanh(max(-1 + 1e-16, min(1 - 1e-16, r))), D.normal_quantile(0.975) / math.sqrt(n - 3)
    return _row(pairs.sparkSession, "r t p low high", r, t, D.t_tail(t, n - 2), math.tanh(e - z), math.tanh(e + z))


def _rank_pairs(pairs: DataFrame) -> DataFrame:
    """(x, y) as midranks: two joins by value, the rows are never numbered."""
    first = midranks(pairs.select(F.col("x").alias("v"), "y")).select(F.col("r").alias("x"), F.col("y").alias("v"))
    return midranks(first).select("x", F.col("r").alias("y"))


def tukey(sample: DataFrame) -> DataFrame:
    """Tukey HSD and Games-Howell for all pairs of groups."""
    g = _groups(sample)
    n, k = sum(r.n for r in g), len(g)
    mse = sum((r.n - 1) * r.s2 for r in g) / (n - k)
    out = []
    for a, b in combinations(g, 2):
        d = a.m - b.m
        q = abs(d) / math.sqrt(mse / 2 * (1 / a.n + 1 / b.n))
        va, vb = a.s2 / a.n, b.s2 / b.n
        q2, df = abs(d) / math.sqrt((va + vb) / 2), (va + vb) ** 2 / (va * va / (a.n - 1) + vb * vb / (b.n - 1))
        out.append((str(a.g), str(b.g), d, q, 1 - D.tukey_cdf(q, k, n - k), q2, df, 1 - D.tukey_cdf(q2, k, df)))
    return sample.sparkSession.createDataFrame(out, "a string, b string, diff double, q double, p double, gh_q double, gh_df double, gh_p double")


def dunn(sample: DataFrame) -> DataFrame:
    """Dunn's z for all pairs of groups, Bonferroni adjusted."""
    x = midranks(sample)
    g = sorted(x.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m")).collect(), key=lambda r: str(r.g))
    ties, n = x.agg(_ties(x).alias("t")).first().t, sum(r.n for r in g)
    var = n * (n + 1) / 12 - ties / (12 * (n - 1))
    pairs = list(combinations(g, 2))
    out = [(str(a.g), str(b.g), z := (a.m - b.m) / math.sqrt(var * (1 / a.n + 1 / b.n)), p := 2 * D.normal_cdf(-abs(z)), min(1.0, p * len(pairs))) for a, b in pairs]
    return sample.sparkSession.createDataFrame(out, "a string, b string, z double, p double, p_adj double")


def contrasts(sample: DataFrame, weights: list[list[float]]) -> DataFrame:
    """Planned contrasts (weights sum to 0) on the pooled error."""
    g = _groups(sample)
    n, k = sum(r.n for r in g), len(g)
    mse, out = sum((r.n - 1) * r.s2 for r in g) / (n - k), []
    for i, w in enumerate(weights):
        if abs(sum(w)) > 1e-12 or len(w) != k:
            raise ValueError("contrast weights must be one per group and sum to 0")
        value = sum(c * r.m for c, r in zip(w, g, strict=True))
        t = value / math.sqrt(mse * sum(c * c / r.n for c, r in zip(w, g, strict=True)))
        out.append((i, value, t, float(n - k), p := D.t_tail(t, n - k), min(1.0, p * len(weights))))
    return sample.sparkSession.createDataFrame(out, "contrast int, estimate double, t double, df double, p double, p_bonferroni double")


class SplitMix64:
    """The SplitMix64 generator; index() rejects, so that it is unbiased."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        # fixed values of the published generator
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        return z ^ (z >> 31)

    def index(self, n: int) -> int:
        limit = (1 << 64) - (1 << 64) % n
        while (x := self.next()) >= limit:
            pass
        return x % n


def quantile7(ordered, p: float) -> float:
    h = (len(ordered) - 1) * p
    i = min(int(h), len(ordered) - 2) if len(ordered) > 1 else 0
    return float(ordered[i] + (h - i) * (ordered[min(i + 1, len(ordered) - 1)] - ordered[i]))


def bootstrap(x: list[float], level: float = 0.95, resamples: int = 2000, seed: int = SEED, block: int = 1) -> tuple[float, float]:
    """Percentile interval of the mean; block > 1 draws moving blocks."""
    rng, n, out = SplitMix64(seed), len(x), []
    for _ in range(resamples):
        draw: list[float] = []
        while len(draw) < n:
            at = rng.index(n - block + 1)
            draw += x[at : at + block]
        out.append(sum(draw[:n]) / n)
    out.sort()
    return quantile7(out, (1 - level) / 2), quantile7(out, (1 + level) / 2)


def bootstrap_bca(x: list[float], level: float = 0.95, resamples: int = 2000, seed: int = SEED) -> tuple[float, float]:
    """Bias-corrected and accelerated interval of the mean, acceleration by jackknife."""
    rng, n, mean = SplitMix64(seed), len(x), sum(x) / len(x)
    reps = sorted(sum(x[rng.index(n)] for _ in range(n)) / n for _ in range(resamples))
    below = min(max(sum(r < mean for r in reps), 0.5), resamples - 0.5) / resamples
    jack = np.array([(sum(x) - v) / (n - 1) for v in x])
    d = jack.mean() - jack
    a, z0 = float((d**3).sum() / (6 * (d**2).sum() ** 1.5 or 1)), D.normal_quantile(below)
    at = [D.normal_cdf(z0 + (z0 + D.normal_quantile(q)) / (1 - a * (z0 + D.normal_quantile(q)))) for q in ((1 - level) / 2, (1 + level) / 2)]
    return quantile7(reps, at[0]), quantile7(reps, at[1])


def permutation(x: list[float], y: list[float], most_exact: int = 200_000, draws: int = 9999, seed: int = SEED) -> float:
    """Two-sided permutation p of the difference of means: all assignments if they are few, else Monte Carlo."""
    both, n, s = x + y, len(x), sum(x) + sum(y)
    stat = lambda t: abs(t / n - (s - t) / (len(both) - n))
    seen = stat(sum(x)) * (1 - 1e-12)
    if math.comb(len(both), n) <= most_exact:
        hits = [stat(sum(c)) >= seen for c in combinations(both, n)]
        return sum(hits) / len(hits)
    rng, extreme = SplitMix64(seed), 0
    for _ in range(draws):
        pool = list(both)
        for i in range(n):
            j = i + rng.index(len(pool) - i)
            pool[i], pool[j] = pool[j], pool[i]
        extreme += stat(sum(pool[:n])) >= seen
    return (1 + extreme) / (1 + draws)


class Histogram:
    """A sample as its different values and their counts: what resampling means over whole tables needs of it."""

    def __init__(self, values: DataFrame, column: str = "v"):
        rows = values.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
        self.v, self.n = np.array([r.v for r in rows], float), np.array([r.n for r in rows], np.int64)
        self.size = int(self.n.sum())

    def sums(self, draws: int, resamples: int, rng) -> np.ndarray:
        """Sums of draws values drawn with replacement, for each resample: the counts drawn are multinomial."""
        return np.array([rng.multinomial(draws, self.n / self.size) @ self.v for _ in range(resamples)]) if draws and self.size else np.zeros(resamples)


def _interval(reps: np.ndarray, low: float, high: float) -> tuple[float, float]:
    ordered = np.sort(reps)
    return quantile7(ordered, low), quantile7(ordered, high)


def bootstrap_whole(h: Histogram, level: float = 0.95, resamples: int = 2000, seed: int = SEED) -> tuple[float, float]:
    """bootstrap() of any number of rows: the same distribution of resamples, drawn from counts. Empty: nan."""
    if not h.size:
        return math.nan, math.nan
    return _interval(h.sums(h.size, resamples, np.random.default_rng(seed)) / h.size, (1 - level) / 2, (1 + level) / 2)


def bootstrap_bca_whole(h: Histogram, level: float = 0.95, resamples: int = 2000, seed: int = SEED) -> tuple[float, float]:
    """bootstrap_bca() of any number of rows: the jackknife's moments come from the counts too."""
    if h.size < 2:
        return math.nan, math.nan
    mean = float(h.n @ h.v) / h.size
    reps = h.sums(h.size, resamples, np.random.default_rng(seed)) / h.size
    below = min(max(int((reps < mean).sum()), 0.5), resamples - 0.5) / resamples
    d = (h.v - mean) / (h.size - 1)
    a, z0 = float(h.n @ d**3) / (6 * float(h.n @ d**2) ** 1.5 or 1), D.normal_quantile(below)
    at = [D.normal_cdf(z0 + (z0 + D.normal_quantile(q)) / (1 - a * (z0 + D.normal_quantile(q)))) for q in ((1 - level) / 2, (1 + level) / 2)]
    return _interval(reps, *at)


def block_bootstrap_whole(rows: DataFrame, key: str, value: str, block: int = 10, level: float = 0.95, resamples: int = 2000, seed: int = SEED) -> tuple[float, float]:
    """bootstrap(block=...) of any number of rows in the order of key: what is drawn is a block's sum.

    Places are gapless numbers without a single-task window; each row adds to the block sums of the block starts that
    reach it. The last block of a resample is cut short, so it draws from the sums of shorter blocks.
    """
    placed = offsets(rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.lit(1).alias("one")), "k", "one")
    n = placed.count()
    if n < block:
        return math.nan, math.nan
    rest = n % block
    starts = placed.select("v", F.expr(f"explode(sequence(0, {block - 1}))").alias("at"), "off").withColumn("start", F.col("off") - F.col("at"))
    starts = starts.where((F.col("start") >= 0) & (F.col("start") <= n - block))
    sums = starts.groupBy("start").agg(F.sum("v").alias("v"), F.sum(F.when(F.col("at") < rest, F.col("v")).otherwise(0.0)).alias("part"))
    rng = np.random.default_rng(seed)
    total = Histogram(sums).sums(n // block, resamples, rng) + (Histogram(sums, "part").sums(1, resamples, rng) if rest else 0.0)
    return _interval(total / n, (1 - level) / 2, (1 + level) / 2)


def permutation_whole(x: Histogram, both: Histogram, draws: int = 9999, seed: int = SEED) -> float:
    """Monte Carlo permutation() of any number of rows: x's share of the pooled counts is multivariate hypergeometric."""
    n, rest, s = x.size, both.size - x.size, float(both.n @ both.v)
    if not n or not rest:
        return math.nan
    stat = lambda t: np.abs(t / n - (s - t) / rest)
    seen, rng, left, size = stat(float(x.n @ x.v)) * (1 - 1e-12), np.random.default_rng(seed), np.full(draws, n), both.size
    sums = np.zeros(draws)
    for v, k in zip(both.v, both.n.tolist(), strict=True):  # one value after the other, all draws at once
        got = left if k == size else _hypergeometric(rng, k, size - k, left)
        sums, left, size = sums + got * v, left - got, size - k
    return float((1 + (stat(sums) >= seen).sum()) / (1 + draws))


def _hypergeometric(rng, good: int, bad: int, drawn: np.ndarray) -> np.ndarray:
    """Hypergeometric draws; numpy's take populations under 1e9, beyond them the normal limit is used."""
    if good + bad < 10**9:
        return rng.hypergeometric(good, bad, drawn)
    size, p = good + bad, good / (good + bad)
    spread = np.sqrt(np.maximum(drawn * p * (1 - p) * (size - drawn) / max(size - 1, 1), 0.0))
    return np.clip(np.rint(rng.normal(drawn * p, spread)), np.maximum(0, drawn - bad), np.minimum(good, drawn)).astype(np.int64)


def _sample(spark, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("double").alias("v"))


def _two(spark, sf: str) -> DataFrame:
    return _sample(spark, sf).where(F.col("g") != "R")


def _pairs(spark, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 500).cast("double").alias("y"))


def doc_metric(spark, sf: str, term: str = "the") -> DataFrame:
    """Per document its length and the relative frequency of a term."""
    from verbarium.corpus import terms

    a = terms(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.size(a).cast("long").alias("len"), F.size(F.filter(a, lambda t: t == term)).alias("n")).select("doc_id", "len", round6(F.coalesce(F.try_divide("n", "len"), F.lit(0.0))).alias("rel"))


def group_comparison(spark, sf: str) -> DataFrame:
    """Document length by language, English and German: the tests in one row."""
    s = lengths(table(spark, sf, "documents").where(F.col("lang").isin("de", "en"))).join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("g")), "doc_id").select("g", F.col("len").cast("double").alias("v"))
    w, u = welch(s).select("t", "df", F.col("p").alias("p_t"), "g"), mann_whitney(s).select("u1", "z", F.col("p").alias("p_u"), "rank_biserial")
    return w.crossJoin(u)


def _pick(f, sample, *names):
    return lambda spark, sf: f(sample(spark, sf)).select(*(round6(n).alias(n) if n not in ("a", "b") else F.col(n) for n in names))


def _lengths(spark, sf: str, *langs: str) -> DataFrame:
    """Lengths of all documents, or of those in some languages."""
    docs = table(spark, sf, "documents")
    return lengths(docs.where(F.col("lang").isin(*langs)) if langs else docs)


def _low_high(f):
    return lambda spark, sf: _row(spark, "low high", *f(_lengths(spark, sf)))


_DIST = [("t", "dist_t", lambda: [D.t_tail(1.0, 1), D.t_quantile(0.975, 10)]), ("f", "dist_f", lambda: [D.f_tail(3.0, 2, 20)]), ("c", "dist_chi2", lambda: [D.chi2_tail(3.841458820694124, 1)]), ("n", "dist_norm", lambda: [D.normal_cdf(1.96), D.normal_quantile(0.975)]), ("q", "dist_tukey", lambda: [D.tukey_cdf(3.5, 3, 20), D.tukey_quantile(0.95, 3, 20)])]
QUERIES = {
    "welch_t": _pick(welch, _two, "t", "df"), "cohen_d": _pick(welch, _two, "d"), "hedges_g": _pick(welch, _two, "g"), "welch_p": _pick(welch, _two, "p"),
    "anova": _pick(anova, _sample, "f", "df1", "df2"), "t_one": _pick(lambda p: one_sample(p.select((F.col("x") - 25).alias("v"))), _pairs, "t", "df"),
    "t_paired": _pick(lambda p: one_sample(p.select((F.col("x") - F.col("y")).alias("v"))), _pairs, "t", "df"), "wilcoxon": _pick(wilcoxon, _pairs, "w_plus", "w_minus", "z"),
    "mann_whitney": _pick(mann_whitney, _two, "u1", "u2", "z"), "rank_biserial": _pick(mann_whitney, _two, "rank_biserial"), "kruskal": _pick(kruskal, _sample, "h", "df", "epsilon2"),
    "pearson": _pick(correlation, _pairs, "r", "t"), "fisher_z_ci": _pick(correlation, _pairs, "low", "high"), "spearman": _pick(lambda p: correlation(p, ranks=True), _pairs, "r", "t"),
    "tukey": _pick(tukey, _sample, "a", "b", "diff", "q"), "games_howell": _pick(tukey, _sample, "a", "b", "gh_q", "gh_df"), "dunn": _pick(dunn, _sample, "a", "b", "z"), "posthoc_bundle": lambda s, sf: tukey(_sample(s, sf)),
    "contrasts": _pick(lambda s: contrasts(s, [[1, -1, 0], [1, 1, -2]]), _sample, "estimate", "t", "df"), "doc_metric": doc_metric, "group_comparison": group_comparison,
    "bootstrap": _low_high(lambda x: bootstrap_whole(Histogram(x, "len"))), "bootstrap_bca": _low_high(lambda x: bootstrap_bca_whole(Histogram(x, "len"))), "block_bootstrap": _low_high(lambda x: block_bootstrap_whole(x, "doc_id", "len")),
    "permutation": lambda s, sf: _row(s, "p", permutation_whole(Histogram(_lengths(s, sf, "en"), "len"), Histogram(_lengths(s, sf, "en", "de"), "len"))), "splitmix64": lambda s, sf: s.createDataFrame([(i, f"{v:016X}") for r in [SplitMix64(0)] for i in range(3) for v in [r.next()]], "i int, value string"),
    "metric_correlation": lambda s, sf: correlation(doc_metric(s, sf).select(F.col("len").cast("double").alias("x"), F.col("rel").alias("y"))).select(round6("r").alias("r")),
    "paired_metrics": lambda s, sf: wilcoxon(doc_metric(s, sf).select((F.col("len") / 100).alias("x"), (F.col("rel") * 100).alias("y"))),
    **{name: (lambda f, n: lambda s, sf: s.createDataFrame([(i, float(v)) for i, v in enumerate(f())], "i int, value double"))(f, n) for n, name, f in _DIST},
}
_S = "WITH s AS (SELECT l_returnflag AS g, CAST(l_quantity AS DOUBLE) AS v FROM lineitem{}), m AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s2 FROM s GROUP BY g)"
_TWO = _S.format(" WHERE l_returnflag <> 'R'") + ", ab AS (SELECT a.n AS n1, a.m AS m1, a.s2 AS v1, b.n AS n2, b.m AS m2, b.s2 AS v2 FROM m a, m b WHERE a.g = 'A' AND b.g = 'N')"
_P = "WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount * 500 AS DOUBLE) AS y FROM lineitem)"
_RK = ", rk AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER (PARTITION BY v) AS ties FROM s), tt AS (SELECT sum(ties::DOUBLE * ties - 1) AS t, count(*) AS n FROM rk), gr AS (SELECT g, count(*) AS n, sum(r) AS r FROM rk GROUP BY g)"
_MW = _S.format(" WHERE l_returnflag <> 'R'") + _RK + ", u AS (SELECT a.n AS n1, b.n AS n2, a.r - a.n * (a.n + 1) / 2 AS u1, t, tt.n AS n FROM gr a, gr b, tt WHERE a.g = 'A' AND b.g = 'N')"
_D = "(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))"
_AN = _S.format("") + ", w AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum((n - 1) * s2) AS sw FROM m)"
_AB = ", ab AS (SELECT a.g AS a, b.g AS b, a.n AS n1, a.m AS m1, a.s2 / a.n AS v1, b.n AS n2, b.m AS m2, b.s2 / b.n AS v2 FROM m a JOIN m b ON a.g < b.g)"
ORACLES = {
    "welch_t": _TWO + " SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 6) AS df FROM ab",
    "cohen_d": _TWO + f" SELECT round({_D}, 6) AS d FROM ab",
    "hedges_g": _TWO + f" SELECT round({_D} * exp(lgamma((n1 + n2 - 2) / 2) - lgamma((n1 + n2 - 3) / 2)) / sqrt((n1 + n2 - 2) / 2), 6) AS g FROM ab",
    "anova": _AN + " SELECT round((sum(m.n * (m.m - w.mean) ** 2) / (max(w.k) - 1)) / (max(w.sw) / (max(w.n) - max(w.k))), 6) AS f, CAST(max(k) - 1 AS DOUBLE) AS df1, CAST(max(w.n) - max(k) AS DOUBLE) AS df2 FROM m, w",
    "t_one": _P + " SELECT round(avg(x - 25) / (stddev_samp(x - 25) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM p",
    "t_paired": _P + " SELECT round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM p",
    "wilcoxon": _P + """, d AS (SELECT x - y AS d FROM p WHERE x <> y), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS ties FROM d),
      w AS (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, count(*) AS n, sum(ties::DOUBLE * ties - 1) AS t FROM r)
      SELECT round(w, 6) AS w_plus, round(n * (n + 1) / 2 - w, 6) AS w_minus, round((w - n * (n + 1) / 4 - 0.5 * sign(w - n * (n + 1) / 4)) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48), 6) AS z FROM w""",
    "mann_whitney": _MW + " SELECT round(u1, 6) AS u1, round(n1 * n2 - u1, 6) AS u2, round((u1 - n1 * n2 / 2 - 0.5 * sign(u1 - n1 * n2 / 2)) / sqrt(n1 * n2 / 12 * (n + 1 - t / (n * (n - 1)))), 6) AS z FROM u",
    "rank_biserial": _MW + " SELECT round(2 * u1 / (n1 * n2) - 1, 6) AS rank_biserial FROM u",
    "kruskal": _S.format("") + _RK + """, h AS (SELECT (12 / (max(tt.n)::DOUBLE * (max(tt.n) + 1)) * sum(gr.r ** 2 / gr.n) - 3 * (max(tt.n) + 1)) / (1 - max(t) / (max(tt.n)::DOUBLE ** 3 - max(tt.n))) AS h, count(*) AS k, max(tt.n) AS n FROM gr, tt)
      SELECT round(h, 6) AS h, CAST(k - 1 AS DOUBLE) AS df, round(h / (n - 1), 6) AS epsilon2 FROM h""",
    "pearson": _P + " SELECT round(corr(x, y), 6) AS r, round(corr(x, y) * sqrt((count(*) - 2) / (1 - corr(x, y) ** 2)), 6) AS t FROM p",
    "fisher_z_ci": _P + " SELECT round(tanh(atanh(corr(x, y)) - 1.959963984540054 / sqrt(count(*) - 3)), 6) AS low, round(tanh(atanh(corr(x, y)) + 1.959963984540054 / sqrt(count(*) - 3)), 6) AS high FROM p",
    "spearman": _P + ", r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS y FROM p) SELECT round(corr(x, y), 6) AS r, round(corr(x, y) * sqrt((count(*) - 2) / (1 - corr(x, y) ** 2)), 6) AS t FROM r",
    "tukey": _AN + _AB + " SELECT a, b, round(m1 - m2, 6) AS diff, round(abs(m1 - m2) / sqrt(sw / (n - k) / 2 * (1 / n1 + 1 / n2)), 6) AS q FROM ab, w",
    "games_howell": _AN + _AB + " SELECT a, b, round(abs(m1 - m2) / sqrt((v1 + v2) / 2), 6) AS gh_q, round((v1 + v2) ** 2 / (v1 ** 2 / (n1 - 1) + v2 ** 2 / (n2 - 1)), 6) AS gh_df FROM ab",
    "dunn": _S.format("") + _RK + " SELECT a.g AS a, b.g AS b, round((a.r / a.n - b.r / b.n) / sqrt((tt.n::DOUBLE * (tt.n + 1) / 12 - t / (12 * (tt.n - 1))) * (1 / a.n + 1 / b.n)), 6) AS z FROM gr a JOIN gr b ON a.g < b.g, tt",
    "contrasts": _AN + """, c AS (SELECT * FROM (VALUES ('A', 1, 1), ('N', -1, 1), ('R', 0, -2)) t(g, c1, c2)), x AS (SELECT m.*, c1, c2 FROM m JOIN c USING (g)),
      r AS (SELECT sum(c1 * m) AS e, sum(c1 * c1 / n) AS v FROM x UNION ALL SELECT sum(c2 * m), sum(c2 * c2 / n) FROM x)
      SELECT round(e, 6) AS estimate, round(e / sqrt(sw / (n - k) * v), 6) AS t, CAST(n - k AS DOUBLE) AS df FROM r, w""",
    "splitmix64": "SELECT * FROM (VALUES (0, 'E220A8397B1DCDAF'), (1, '6E789E6AA1B965F4'), (2, '06C45D188009454F')) t(i, value)",
}


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of Mann-Whitney's U without ties, by counting rank sums."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for j in range(1, n1 + n2 + 1):
        for k in range(min(j, n1), 0, -1):
            step = j - k  # the k-th chosen of j has j - k others below it
            if step <= n2:
                ways[k, step:] += ways[k - 1, : ways.shape[1] - step]
    counts = ways[n1]
    low = counts[: int(min(u, n1 * n2 - u)) + 1].sum() / counts.sum()
    return float(min(1.0, 2 * low))


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided exact p of Wilcoxon's W+ without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    low = ways[: int(min(w, n * (n + 1) / 2 - w)) + 1].sum() / 2.0**n
    return float(min(1.0, 2 * low))


def spearman_exact(x: list[float], y: list[float]) -> float:
    """Two-sided exact p of Spearman's rho over all permutations, at most nine pairs."""
    from itertools import permutations

    if len(x) > 9:
        raise ValueError("too many pairs for an exact test")
    rank = lambda v: np.array([sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v])
    a, b = rank(x) - (len(x) + 1) / 2, rank(y) - (len(y) + 1) / 2
    seen = float(abs(a @ b)) - 1e-9
    hits = [float(abs(a @ b[list(p)])) >= seen for p in permutations(range(len(x)))]
    return sum(hits) / len(hits)


QUERIES["spearman_exact"] = lambda s, sf: _row(s, "p", spearman_exact(*zip(*[(float(r.x), float(r.y)) for r in table(s, sf, "nation").groupBy(F.col("n_regionkey").alias("x")).agg(F.sum("n_nationkey").alias("y")).orderBy("x").collect()])))
