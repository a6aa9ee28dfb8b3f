"""Corpus profile: frequencies, lexical diversity, n-grams, dispersion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbarium.corpus import LEXICAL, SQL, SURFACE, doc_term, lengths, round6, sequence, table, terms, tokens

_SURFACE_SQL = SURFACE.replace("'", "''")
WINDOW = 100
STOPWORDS = ("the", "of", "and")


def text_profile(docs: DataFrame) -> DataFrame:
    """Per document: bytes, characters, surface tokens, lexical tokens, types."""
    a = terms(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"), F.size(terms(F.col("text"), SURFACE)).cast("long").alias("surface"), F.size(a).cast("long").alias("lexical"), F.size(F.array_distinct(a)).cast("long").alias("types"))


def term_stats(docs: DataFrame) -> DataFrame:
    """Per term: f, relative frequency, document frequency, deviation of proportions.

    The deviation sums over documents that have the term; what the others add is one minus the share of those.
    """
    dt = doc_term(docs).join(lengths(docs), "doc_id")
    total = lengths(docs).agg(F.sum("len").alias("all"))
    freq = dt.groupBy("term").agg(F.sum("n").alias("f"), F.count(F.lit(1)).alias("df"))
    out = dt.join(freq, "term").crossJoin(F.broadcast(total))
    parts = out.groupBy("term", "f", "df", "all").agg(F.sum(F.abs(F.col("n") / F.col("f") - F.col("len") / F.col("all"))).alias("d"), F.sum(F.col("len") / F.col("all")).alias("s"))
    return parts.select("term", "f", "df", round6(F.col("f") / F.col("all")).alias("rel"), round6(0.5 * (F.col("d") + 1 - F.col("s"))).alias("dp"))


def corpus_profile(docs: DataFrame) -> DataFrame:
    """Documents, characters, tokens, types, type-token ratio."""
    base = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"))
    toks = tokens(docs).agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("term").alias("types"))
    return base.crossJoin(toks).withColumn("ttr", round6(F.try_divide(F.col("types"), F.col("tokens"))))


def ttr(docs: DataFrame) -> DataFrame:
    return tokens(docs).agg(round6(F.try_divide(F.countDistinct("term"), F.count(F.lit(1)))).alias("ttr"))


def msttr(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Mean type-token ratio of disjoint full windows; NULL below one window."""
    seq = sequence(docs).withColumn("w", F.floor(F.col("i") / window))
    each = seq.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("term").alias("v")).where(F.col("n") == window)
    return each.agg(round6(F.avg(F.col("v") / window)).alias("msttr"))


def mattr(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Mean type-token ratio of all sliding windows in closed form: a token counts in the windows that hold it first."""
    seq = sequence(docs)
    before = F.coalesce(F.lag("i").over(Window.partitionBy("term").orderBy("i")), F.lit(-1))
    seq = seq.withColumn("q", before).crossJoin(F.broadcast(seq.agg(F.count(F.lit(1)).alias("N"))))
    first = F.greatest(F.col("q") + 1, F.col("i") - (window - 1), F.lit(0))
    held = F.greatest(F.lit(0), F.least(F.col("i"), F.col("N") - window) - first + 1)
    return seq.groupBy("N").agg(F.sum(held).alias("s")).select(round6(F.when(F.col("N") >= window, F.col("s") / (window * (F.col("N") - window + 1)))).alias("mattr"))


def _direction(seq, threshold: float) -> float:
    """Tokens per factor in one direction; a factor closes at type-token ratio <= threshold."""
    factors, types, n = 0.0, set(), 0
    for x in seq:
        n += 1
        types.add(x)
        if len(types) / n <= threshold:
            factors, types, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(types) / n) / (1 - threshold)
    return len(seq) / factors if factors > 0 else float("inf")


def mtld(docs: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Per document both directions and their mean; +infinity without a factor, no row for documents without tokens.

    The fold is sequential in the tokens of a document, so it runs in Arrow batches rather than as an expression.
    """

    def run(batches):
        for batch in batches:
            seqs = batch.column(1).to_pylist()
            x, y = [_direction(s, threshold) for s in seqs], [_direction(s[::-1], threshold) for s in seqs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64()), pa.array(y, pa.float64())], names=["doc_id", "x", "y"])

    a = docs.select("doc_id", terms(F.col("text")).alias("a")).where(F.size("a") > 0)
    out = a.mapInArrow(run, "doc_id long, x double, y double")
    return out.select("doc_id", round6("x").alias("forward"), round6("y").alias("backward"), round6((F.col("x") + F.col("y")) / 2).alias("mtld"))


def grams(a: Column, n: int) -> Column:
    """The n-grams of an array of strings, joined by blanks."""
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngrams(docs: DataFrame, sizes=(2, 3)) -> DataFrame:
    """(n, gram, f, df) of word n-grams inside documents."""
    a = docs.select("doc_id", terms(F.col("text")).alias("a"))
    each = [a.select("doc_id", F.lit(n).alias("n"), F.explode(grams(F.col("a"), n)).alias("gram")) for n in sizes]
    rows = each[0]
    for x in each[1:]:
        rows = rows.unionByName(x)
    per = rows.groupBy("doc_id", "n", "gram").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("n", "gram").agg(F.sum("c").alias("f"), F.count(F.lit(1)).alias("df"))


def char_grams(docs: DataFrame, n: int = 3, padded: bool = False) -> DataFrame:
    """(gram, f): character n-grams of terms, with their share of all."""
    t = F.col("term") if not padded else F.concat(F.lit("_"), F.col("term"), F.lit("_"))
    by = tokens(docs).groupBy("term").agg(F.count(F.lit(1)).alias("c")).withColumn("t", t).where(F.length("t") >= n)
    g = by.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - (n - 1)), lambda i: F.substring("t", i, F.lit(n)))).alias("gram"))
    return g.groupBy("gram").agg(F.sum("c").alias("f"))


def term_filter(docs: DataFrame, stopwords=STOPWORDS, min_length=2, min_count=2, min_df=2, max_df_share=0.9) -> DataFrame:
    """(term, f, df, reason): the first rule of the filter that a term fails, NULL if it passes."""
    d = docs.agg(F.count(F.lit(1)).alias("D"))
    t = doc_term(docs).groupBy("term").agg(F.sum("n").alias("f"), F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(d))
    reason = F.when(F.col("term").isin(list(stopwords)), "stopword").when(F.length("term") < min_length, "length").when(F.col("f") < min_count, "count").when(F.col("df") < min_df, "df").when(F.col("df") > max_df_share * F.col("D"), "share")
    return t.select("term", "f", "df", reason.alias("reason"))


def ngram_freq(docs: DataFrame, limit: int = 100) -> DataFrame:
    """Rows of the term filter that pass, most frequent first, relative to all occurrences before filtering."""
    kept = term_filter(docs)
    total = kept.agg(F.sum("f").alias("N"))
    top = kept.where("reason IS NULL").orderBy(F.desc("f"), "term").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("term", "f", "df", round6(F.col("f") / F.col("N")).alias("rel"))


def dispersion(docs: DataFrame, part: str = "source") -> DataFrame:
    """Deviation of proportions per term over declared parts, plain and normalised. Rows without a part form one part."""
    rows = docs.select(F.col(part).alias("part"), F.explode(terms(F.col("text"))).alias("term"))
    pt = rows.groupBy("part", "term").agg(F.count(F.lit(1)).alias("n"))
    size = pt.groupBy("part").agg(F.sum("n").alias("size"))
    whole = size.agg(F.sum("size").alias("all"), F.min("size").alias("least"))
    f = pt.groupBy("term").agg(F.sum("n").alias("f"))
    x = pt.join(size.withColumnRenamed("part", "__part"), F.col("part").eqNullSafe(F.col("__part"))).join(f, "term").crossJoin(F.broadcast(whole))
    d = x.groupBy("term", "f", "all", "least").agg((0.5 * (F.sum(F.abs(F.col("n") / F.col("f") - F.col("size") / F.col("all"))) + 1 - F.sum(F.col("size") / F.col("all")))).alias("dp"), F.count(F.lit(1)).alias("range"))
    return d.select("term", "f", "range", round6("dp").alias("dp"), round6(F.try_divide(F.col("dp"), 1 - F.col("least") / F.col("all"))).alias("dpnorm"))


def content_digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit("sha256:"), F.sha2(F.col("text"), 256)).alias("digest"))


def lexical_filter(docs: DataFrame) -> DataFrame:
    """Surface tokens that are lexical: words and numbers, not punctuation or currency."""
    s = docs.select("doc_id", F.posexplode(terms(F.col("text"), SURFACE)).alias("pos", "token"))
    return s.where(F.col("token").rlike(r"^[\p{L}\p{M}\p{Nd}]"))


def _q(f, **k):
    return lambda spark, sf: f(table(spark, sf, "documents"), **k)


QUERIES = {
    "text_profile": _q(text_profile), "corpus_profile": _q(corpus_profile), "term_stats": _q(term_stats), "ttr": _q(ttr),
    "msttr": _q(msttr), "mattr": _q(mattr), "mtld": _q(mtld), "ngram_word": _q(ngrams),
    "ngram_char": _q(char_grams), "ngram_char_padded": _q(char_grams, n=4, padded=True), "f_termfilter": _q(term_filter),
    "ngram_freq": _q(ngram_freq), "dispersion": _q(dispersion), "content_digest": _q(content_digest),
    "f_lexical": lambda spark, sf: lexical_filter(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lexical")),
}

_FILTER = SQL + """,
t AS (SELECT term, CAST(sum(n) AS BIGINT) AS f, count(*) AS df FROM dt GROUP BY term),
flt AS (SELECT term, f, df, CASE WHEN term IN ('the', 'of', 'and') THEN 'stopword' WHEN length(term) < 2 THEN 'length'
  WHEN f < 2 THEN 'count' WHEN df < 2 THEN 'df' WHEN df > 0.9 * (SELECT count(*) FROM documents) THEN 'share' END AS reason FROM t)"""
_MTLD = """list_reduce(list_prepend({'f': 0.0::DOUBLE, 'ty': []::VARCHAR[], 'n': 0, 'x': ''},
  list_transform(%s, lambda w: {'f': 0.0::DOUBLE, 'ty': []::VARCHAR[], 'n': 0, 'x': w})),
  lambda p, q: CASE WHEN (len(p.ty) + CASE WHEN list_contains(p.ty, q.x) THEN 0 ELSE 1 END) / (p.n + 1) <= 0.72
    THEN {'f': p.f + 1, 'ty': []::VARCHAR[], 'n': 0, 'x': ''}
    ELSE {'f': p.f, 'ty': CASE WHEN list_contains(p.ty, q.x) THEN p.ty ELSE list_append(p.ty, q.x) END, 'n': p.n + 1, 'x': ''} END)"""
_FACTORS = "(s{0}.f + CASE WHEN s{0}.n > 0 THEN (1 - len(s{0}.ty) / s{0}.n) / (1 - 0.72) ELSE 0 END)"
ORACLES = {
    "text_profile": f"""{SQL} SELECT d.doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars,
      CAST(len(regexp_extract_all(lower(text), '{_SURFACE_SQL}')) AS BIGINT) AS surface, CAST(len(a) AS BIGINT) AS lexical,
      CAST(len(list_distinct(a)) AS BIGINT) AS types FROM documents d JOIN arr USING (doc_id)""",
    "corpus_profile": SQL + """ SELECT (SELECT count(*) FROM documents) AS documents, (SELECT CAST(sum(length(text)) AS BIGINT) FROM documents) AS chars,
      count(*) AS tokens, count(DISTINCT term) AS types, round(count(DISTINCT term) / count(*), 6) AS ttr FROM tok""",
    "term_stats": SQL + """, f AS (SELECT term, CAST(sum(n) AS BIGINT) AS f, count(*) AS df FROM dt GROUP BY term), N AS (SELECT sum(len) AS total FROM len)
      SELECT term, f, df, round(f / total, 6) AS rel, round(0.5 * (sum(abs(n / f - len / total)) + 1 - sum(len / total)), 6) AS dp
      FROM dt JOIN f USING (term) JOIN len USING (doc_id), N GROUP BY term, f, df, total""",
    "ttr": SQL + " SELECT round(count(DISTINCT term) / count(*), 6) AS ttr FROM tok",
    "msttr": SQL + """, w AS (SELECT i // 100 AS w, count(*) AS n, count(DISTINCT term) AS v FROM seq GROUP BY 1 HAVING count(*) = 100)
      SELECT round(avg(v / 100), 6) AS msttr FROM w""",
    "mattr": SQL + """, q AS (SELECT i, coalesce(lag(i) OVER (PARTITION BY term ORDER BY i), -1) AS q, count(*) OVER () AS N FROM seq)
      SELECT round(sum(greatest(0, least(i, N - 100) - greatest(q + 1, i - 99, 0) + 1)) / (100 * (max(N) - 99)), 6) AS mattr FROM q""",
    "mtld": SQL + f""", s AS (SELECT doc_id, a, {_MTLD % 'a'} AS s1, {_MTLD % 'list_reverse(a)'} AS s2 FROM arr WHERE len(a) > 0),
      m AS (SELECT doc_id, CASE WHEN {_FACTORS.format(1)} > 0 THEN len(a) / {_FACTORS.format(1)} ELSE 'inf'::DOUBLE END AS x,
      CASE WHEN {_FACTORS.format(2)} > 0 THEN len(a) / {_FACTORS.format(2)} ELSE 'inf'::DOUBLE END AS y FROM s)
      SELECT doc_id, round(x, 6) AS forward, round(y, 6) AS backward, round((x + y) / 2, 6) AS mtld FROM m""",
    "ngram_word": SQL + """, g AS (SELECT doc_id, 2 AS n, term || ' ' || lead(term) OVER w AS gram FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
      UNION ALL SELECT doc_id, 3, term || ' ' || lead(term) OVER w || ' ' || lead(term, 2) OVER w FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
      SELECT CAST(n AS INT) AS n, gram, count(*) AS f, count(DISTINCT doc_id) AS df FROM g WHERE gram IS NOT NULL GROUP BY n, gram""",
    "ngram_char": SQL + """, g AS (SELECT substr(term, unnest(range(1, length(term) - 1)), 3) AS gram FROM tok WHERE length(term) >= 3)
      SELECT gram, count(*) AS f FROM g GROUP BY gram""",
    "ngram_char_padded": SQL + """, g AS (SELECT substr('_' || term || '_', unnest(range(1, length(term))), 4) AS gram FROM tok WHERE length(term) >= 2)
      SELECT gram, count(*) AS f FROM g GROUP BY gram""",
    "f_termfilter": _FILTER + " SELECT * FROM flt",
    "ngram_freq": _FILTER + """ SELECT term, f, df, round(f / (SELECT sum(f) FROM flt), 6) AS rel FROM flt WHERE reason IS NULL ORDER BY f DESC, term LIMIT 100""",
    "dispersion": SQL + """, pt AS (SELECT source, term, count(*) AS n FROM tok GROUP BY ALL), size AS (SELECT source, sum(n) AS size FROM pt GROUP BY 1),
      f AS (SELECT term, CAST(sum(n) AS BIGINT) AS f, count(*) AS range FROM pt GROUP BY 1), w AS (SELECT sum(size) AS total, min(size) AS least FROM size),
      d AS (SELECT term, f, range, total, least, 0.5 * (sum(abs(n / f - size / total)) + 1 - sum(size / total)) AS dp
        FROM pt JOIN size ON pt.source IS NOT DISTINCT FROM size.source JOIN f USING (term), w GROUP BY ALL)
      SELECT term, f, range, round(dp, 6) AS dp, round(dp / (1 - least / total), 6) AS dpnorm FROM d""",
    "content_digest": "SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents",
    "f_lexical": SQL + " SELECT doc_id, count(*) AS lexical FROM tok GROUP BY doc_id",
}
