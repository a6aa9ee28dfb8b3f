"""Term weighting, BM25 ranking, extractive summaries, top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.corpus import SQL, SURFACE, doc_term, lengths, round6, table, terms

K1, B = 1.2, 0.75
QUERY = "the that with from"


def tf(variant: str, n: Column, row_sum: Column, row_max: Column) -> Column:
    """Term frequency variants."""
    return {
        "raw": n.cast("double"),
        "binary": F.when(n > 0, 1.0).otherwise(0.0),
        "l1": n / row_sum,
        "max": n / row_max,
        "augmented": 0.5 + 0.5 * n / row_max,
        "sublinear": 1 + F.log(n),
    }[variant]


def idf(variant: str, df: Column, documents: Column) -> Column:
    """Inverse document frequency variants."""
    return {"none": F.lit(1.0), "unsmoothed": F.log(documents / df), "smooth": F.log((documents + 1) / (df + 1)) + 1}[variant]


def normed(variant: str, weight: Column, by: str = "doc_id") -> Column:
    """Row norms; a row of norm zero stays as it is."""
    w = Window.partitionBy(by)
    norm = {"none": F.lit(1.0), "l1": F.sum(F.abs(weight)).over(w), "l2": F.sqrt(F.sum(weight * weight).over(w))}[variant]
    return F.when(norm == 0, weight).otherwise(weight / F.when(norm == 0, 1.0).otherwise(norm))


def weighting(docs: DataFrame, tf_variant: str = "raw", idf_variant: str = "smooth", norm: str = "none") -> DataFrame:
    """(doc_id, term, weight) of a full scheme. One window by document serves row sums, maxima and norms."""
    dt = doc_term(docs)
    w = Window.partitionBy("doc_id")
    rows = dt.withColumn("s", F.sum("n").over(w)).withColumn("m", F.max("n").over(w)).withColumn("tf", tf(tf_variant, F.col("n"), F.col("s"), F.col("m")))
    if idf_variant != "none":
        df = dt.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rows = rows.join(df, "term").crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("D"))))
        rows = rows.withColumn("tf", F.col("tf") * idf(idf_variant, F.col("df"), F.col("D")))
    return rows.select("doc_id", "term", round6(normed(norm, F.col("tf"))).alias("weight"))


def query_terms(spark, text: str) -> DataFrame:
    """Distinct normalised terms of a free text."""
    return spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(text)))).alias("term"))


def bm25(docs: DataFrame, text: str = QUERY, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of all documents; a query term that no document has adds nothing. Order and cut as wanted.

    The distinct query terms are few by nature: their counts stand beside a document's length in one projection of its
    tokens, so nothing is shuffled but the sums over all documents.
    """
    asked = sorted(r.term for r in query_terms(docs.sparkSession, text).collect())
    t = docs.select("doc_id", terms(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    each = [(F.size("t") - F.size(F.array_remove("t", q))).alias(f"n{i}") for i, q in enumerate(asked)]
    counts = t.select("doc_id", F.size("t").alias("len"), *each).persist()  # a few numbers a document, read twice
    whole = counts.agg(F.count(F.lit(1)).alias("D"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(asked))))
    size = F.coalesce(F.col("len") / F.when(F.col("avg") > 0, F.col("avg")), F.lit(0.0))
    score = F.lit(0.0)
    for i in range(len(asked)):
        n, df = F.col(f"n{i}"), F.col(f"df{i}")
        score += F.log(1 + (F.col("D") - df + 0.5) / (df + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * size))
    return counts.crossJoin(F.broadcast(whole)).select("doc_id", round6(score).alias("score"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, text): split after . ! ? followed by white space, and at line ends."""
    parts = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), r"\n+")
    return docs.select("doc_id", F.posexplode(parts).alias("sent", "sentence")).where(F.length(F.trim("sentence")) > 0)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, tokens, score) of all sentences with tokens: the mean document TF-IDF weight, repeats counted."""
    each = sentences(docs).withColumn("terms", terms(F.col("sentence"))).select("doc_id", "sent", F.size("terms").alias("tokens"), F.explode("terms").alias("term"))
    return each.join(weighting(docs), ["doc_id", "term"]).groupBy("doc_id", "sent").agg(F.max("tokens").alias("tokens"), round6(F.avg("weight")).alias("score"))


def summary(docs: DataFrame, most: int = 20) -> DataFrame:
    """The sentences with the highest mean document TF-IDF weight of their tokens, repeats counted."""
    return scored(docs).select("doc_id", "sent", "score").orderBy(F.desc("score"), "doc_id", "sent").limit(most)


def summary_resolved(docs: DataFrame, most: int = 20) -> DataFrame:
    """summary with the text of each sentence: the bounded top list goes to the texts, not the texts to the list."""
    return sentences(docs).join(F.broadcast(summary(docs, most)), ["doc_id", "sent"]).select("doc_id", "sent", "score", "sentence")


def summary_budget(docs: DataFrame, tokens: int = 200, most: int = 1000) -> DataFrame:
    """Greedy under a token budget over all sentences by rank: one that does not fit is skipped and the next is tried.

    Sentences come to the driver in blocks of most ranks. What is left of the budget only falls, so each block is taken
    from the later sentences that still fit; its first one is always picked, which bounds the blocks by the budget.
    """
    rest = scored(docs).where(F.col("tokens") <= tokens).persist()
    left, got, after = tokens, [], F.lit(True)
    while left > 0 and (block := rest.where(after & (F.col("tokens") <= left)).orderBy(F.desc("score"), "doc_id", "sent").limit(most).collect()):
        for x in block:
            if x.tokens <= left:
                got.append(x)
                left -= x.tokens
        after = (F.col("score") < x.score) | (F.col("score") == x.score) & ((F.col("doc_id") > x.doc_id) | (F.col("doc_id") == x.doc_id) & (F.col("sent") > x.sent))
    rest.unpersist()
    return docs.sparkSession.createDataFrame(got, rest.schema)


def top_terms(docs: DataFrame, k: int = 30) -> DataFrame:
    """The k terms by document frequency, frequency and name."""
    t = doc_term(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("f"))
    return t.orderBy(F.desc("df"), F.desc("f"), "term").limit(k)


def _q(f, **k):
    return lambda spark, sf: f(table(spark, sf, "documents"), **k)


_TF = {"raw": "CAST(n AS DOUBLE)", "binary": "1.0::DOUBLE", "l1": "n / s", "max": "n / m", "augmented": "0.5 + 0.5 * n / m", "sublinear": "1 + ln(n)"}
_IDF = {"none": "1.0::DOUBLE", "unsmoothed": "ln(D / df)", "smooth": "ln((D + 1) / (df + 1)) + 1"}
_NORM = {"none": "w", "l1": "CASE WHEN sum(abs(w)) OVER d = 0 THEN w ELSE w / sum(abs(w)) OVER d END", "l2": "CASE WHEN sum(w * w) OVER d = 0 THEN w ELSE w / sqrt(sum(w * w) OVER d) END"}


def _weight_sql(t: str, i: str, n: str) -> str:
    return f"""{SQL}, r AS (SELECT doc_id, term, n, sum(n) OVER (PARTITION BY doc_id) AS s, max(n) OVER (PARTITION BY doc_id) AS m,
      count(*) OVER (PARTITION BY term) AS df, (SELECT count(*) FROM documents) AS D FROM dt),
      w AS (SELECT doc_id, term, ({_TF[t]}) * ({_IDF[i]}) AS w FROM r)
      SELECT doc_id, term, round({_NORM[n]}, 6) AS weight FROM w WINDOW d AS (PARTITION BY doc_id)"""


_SCHEMES = {
    **{f"tf_{t}": (t, "none", "none") for t in _TF},
    **{f"idf_{i}": ("raw", i, "none") for i in _IDF},
    **{f"rownorm_{n}": ("raw", "smooth", n) for n in _NORM},
    "tfidf_smooth": ("raw", "smooth", "none"),
    "weighting": ("sublinear", "unsmoothed", "l2"),
}
_SENT = """, s0 AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\\n+') AS p FROM documents),
s1 AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS sent, unnest(p) AS sentence FROM s0),
s2 AS (SELECT * FROM s1 WHERE length(trim(sentence)) > 0),
st AS (SELECT doc_id, sent, unnest(regexp_extract_all(lower(sentence), '{pat}')) AS term FROM s2),
w AS (SELECT doc_id, term, round(n * (ln(((SELECT count(*) FROM documents) + 1) / (count(*) OVER (PARTITION BY term) + 1)) + 1), 6) AS weight FROM dt),
sc AS (SELECT doc_id, sent, round(avg(weight), 6) AS score FROM st JOIN w USING (doc_id, term) GROUP BY ALL),
top AS (SELECT * FROM sc ORDER BY score DESC, doc_id, sent LIMIT 20)"""
from verbarium.corpus import LEXICAL  # noqa: E402

_SENT = SQL + _SENT.replace("{pat}", LEXICAL.replace("'", "''"))
QUERIES = {
    **{k: _q(weighting, tf_variant=t, idf_variant=i, norm=n) for k, (t, i, n) in _SCHEMES.items()},
    "bm25": _q(bm25), "query_terms": lambda spark, sf: query_terms(spark, "The cat's hat, and THE 3.5 dogs"),
    "summary": _q(summary), "summary_resolve": _q(summary_resolved), "summary_budget": _q(summary_budget), "topk_terms": _q(top_terms),
}
ORACLES = {
    **{k: _weight_sql(*v) for k, v in _SCHEMES.items()},
    "bm25": SQL + """, q AS (SELECT unnest(['the', 'that', 'with', 'from']) AS term), c AS (SELECT dt.* FROM dt JOIN q USING (term)),
      df AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT count(*) AS D, avg(len) AS a FROM len),
      s AS (SELECT doc_id, sum(ln(1 + (D - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (1 - 0.75 + 0.75 * len / a))) AS s
        FROM c JOIN df USING (term) JOIN len USING (doc_id), w GROUP BY doc_id)
      SELECT d.doc_id, round(coalesce(s, 0), 6) AS score FROM documents d LEFT JOIN s USING (doc_id)""",
    "query_terms": "SELECT unnest(['the', 'cat''s', 'hat', 'and', '3.5', 'dogs']) AS term",
    "summary": _SENT + " SELECT * FROM top",
    "summary_resolve": _SENT + " SELECT doc_id, sent, score, sentence FROM top JOIN s2 USING (doc_id, sent)",
    "topk_terms": SQL + " SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS f FROM dt GROUP BY term ORDER BY df DESC, f DESC, term LIMIT 30",
}
