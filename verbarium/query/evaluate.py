"""Evaluation: a tree becomes two columns over a document's token array, whether it is satisfied and its anchors.

Everything a query needs lies in one document, so a whole query is one projection over documents: no join, no shuffle,
one scan. Gaps count surface tokens, punctuation included. Anchors are (first token, last token), both inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.corpus import LEXICAL, SURFACE, table
from verbarium.query.language import EVALUABLE, QueryError, parse

CONTEXT, MOST = 5, 1000
_ANCHORS = "array<struct<s:int,e:int>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once and not once per use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _none() -> Column:
    return F.array().cast(_ANCHORS)


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def _tokens(field: str) -> Column:
    if field not in EVALUABLE:
        raise QueryError("query.unsupported-field")
    return F.col("__low") if field == "normalized" else F.col("__tok")


def _places(tokens: Column, keep) -> Column:
    """Anchors of the tokens that keep(token) accepts."""
    marked = F.transform(tokens, lambda t, i: F.struct(_span(i, i).alias("a"), keep(t).alias("k")))
    return F.transform(F.filter(marked, lambda x: x["k"]), lambda x: x["a"])


def _phrase(tokens: Column, words: list[str], slop: int) -> Column:
    """From each first word the nearest next one again and again, while the skipped tokens stay within the slop."""

    def follow(start: Column) -> Column:
        state = F.struct(start.alias("p"), F.lit(slop).alias("left"))
        for w in words[1:]:
            state = _let(state, _follower(tokens, w))
        return state["p"]

    firsts = F.filter(F.transform(tokens, lambda t, i: F.when(t == words[0], i)), lambda i: i.isNotNull())
    spans = F.transform(firsts, lambda i: _span(i, follow(i)))
    return F.filter(spans, lambda a: a["e"].isNotNull())


def _follower(tokens: Column, word: str):
    return lambda state: _next(tokens, state, word)


def _next(tokens: Column, state: Column, word: str) -> Column:
    p, left = state["p"], state["left"]
    ahead = F.array_position(F.slice(tokens, F.coalesce(p, F.lit(0)) + 2, left + 1), word).cast("int")
    found = p.isNotNull() & (ahead > 0)
    return F.struct(F.when(found, p + ahead).alias("p"), F.when(found, left - ahead + 1).otherwise(F.lit(0)).alias("left"))


def compile_query(tree: tuple) -> tuple[Column, Column]:
    """(satisfied, anchors) of a tree over a row with __tok and __low."""
    kind = tree[0]
    if kind == "all":
        n = F.size("__tok")
        return F.lit(True), F.when(n > 0, F.array(_span(F.lit(0), n - 1))).otherwise(_none())
    if kind in ("term", "phrase", "regex"):
        tokens = _tokens(tree[1])
        fold = (lambda w: w.lower()) if tree[1] == "normalized" else (lambda w: w)
        if kind == "term":
            anchors = _places(tokens, lambda t: t == fold(tree[2]))
            anchors = F.when(F.array_contains(tokens, fold(tree[2])), anchors).otherwise(_none())
        elif kind == "phrase":
            anchors = _phrase(tokens, [fold(w) for w in tree[2]], tree[3])
        else:
            pattern = ("(?i)" if tree[3] else "") + tree[2]
            anchors = _places(tokens, lambda t: t.rlike(rf"^[\p{{L}}\p{{M}}\p{{Nd}}]") & t.rlike(pattern))
        return F.size(anchors) > 0, anchors
    if kind in ("near", "before"):
        (sa, a), (sb, b) = compile_query(tree[1]), compile_query(tree[2])
        n = tree[3]

        def fits(x: Column, y: Column) -> Column:
            forward = (y["s"] > x["e"]) & (y["s"] - x["e"] - 1 <= n)
            return forward if kind == "before" else forward | ((x["s"] > y["e"]) & (x["s"] - y["e"] - 1 <= n))

        def joined(ab: Column) -> Column:
            return F.flatten(F.transform(ab["a"], lambda x: F.transform(F.filter(ab["b"], lambda y: fits(x, y)), lambda y: _span(F.least(x["s"], y["s"]), F.greatest(x["e"], y["e"])))))

        anchors = F.when(sa & sb, F.array_distinct(_let(F.struct(a.alias("a"), b.alias("b")), joined))).otherwise(_none())
        return F.size(anchors) > 0, anchors
    if kind == "not":
        return ~compile_query(tree[1])[0], _none()
    if kind in ("and", "or"):
        parts = [compile_query(t) for t in tree[1:]]
        good = parts[0][0]
        for s, _ in parts[1:]:
            good = good & s if kind == "and" else good | s
        union = F.array_distinct(F.concat(*(a for _, a in parts)))
        return good, F.when(good, union).otherwise(_none())
    if kind == "within":
        s, a = compile_query(tree[1])
        here = F.col("doc_id") == tree[2]
        return s & here, F.when(here, a).otherwise(_none())
    raise QueryError("query.unsupported-field")


def satisfied(docs: DataFrame, query: str | tuple) -> DataFrame:
    """(doc_id, anchors): documents that satisfy the query."""
    tree = parse(query) if isinstance(query, str) else query
    good, anchors = compile_query(tree)
    rows = docs.select("doc_id", F.regexp_extract_all("text", F.lit(SURFACE), F.lit(0)).alias("__tok"))
    rows = rows.withColumn("__low", F.transform("__tok", F.lower))
    # a generator keeps the optimizer from copying the anchors' expression into a pushed-down filter
    made = F.struct("doc_id", "__tok", good.alias("__good"), anchors.alias("anchors"))
    return rows.select(F.inline(F.filter(F.array(made), lambda x: x["__good"]))).drop("__good")


def run(docs: DataFrame, query: str | tuple) -> DataFrame:
    """(doc_id, s, e, left, match, right): anchors with CONTEXT tokens on either side."""
    rows = satisfied(docs, query).select("doc_id", "__tok", F.explode("anchors").alias("a"))
    s, e = F.col("a.s"), F.col("a.e")
    low = F.greatest(s - CONTEXT, F.lit(0))
    return rows.select("doc_id", s.alias("s"), e.alias("e"), F.array_join(F.slice("__tok", low + 1, s - low), " ").alias("left"), F.array_join(F.slice("__tok", s + 1, e - s + 1), " ").alias("match"), F.array_join(F.slice("__tok", e + 2, F.lit(CONTEXT)), " ").alias("right"))


def project(docs: DataFrame, query: str | tuple, most: int = MOST) -> DataFrame:
    """The first results in order of document and place, and whether there are more."""
    found = run(docs, query).orderBy("doc_id", "s", "e").limit(most + 1).persist()
    return found.orderBy("doc_id", "s", "e").limit(most).withColumn("is_truncated", F.lit(found.count() > most))


def _q(text: str | tuple):
    return lambda spark, sf: run(table(spark, sf, "documents"), text).select("doc_id", "s", "e")


def _sat(text: str):
    return lambda spark, sf: satisfied(table(spark, sf, "documents"), text).select("doc_id")


_PAT, _LEX = SURFACE.replace("'", "''"), LEXICAL
_T = f"WITH arr AS (SELECT doc_id, regexp_extract_all(text, '{_PAT}') AS a FROM documents), t AS (SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INT) AS i, unnest(a) AS w FROM arr)"
_NEAR = ", x AS (SELECT * FROM t WHERE lower(w) = 'the'), y AS (SELECT * FROM t WHERE lower(w) = 'of')"
QUERIES = {
    "q_matchall": _q("*"), "q_term": _q("normalized:the"), "q_form": _q("form:The"), "q_phrase": _q('normalized:"of the"'), "q_phrase_slop": _q('normalized:"the of and"~4'), "q_regex": _q("form:/^th[ae]t?$/"), "q_near": _q("normalized:the NEAR/3 normalized:of"),
    "q_before": _q("normalized:the BEFORE/3 normalized:of"), "q_and": _q("normalized:the AND normalized:which"), "q_or": _q("normalized:which OR normalized:into"), "q_not": _sat("NOT normalized:the"), "q_within": _q(("within", ("term", "normalized", "the"), 2)),
    "q_kwic": lambda spark, sf: run(table(spark, sf, "documents"), "normalized:with"), "q_project": lambda spark, sf: project(table(spark, sf, "documents"), "normalized:the").select("doc_id", "s", "e", "is_truncated"),
}
ORACLES = {
    "q_matchall": _T + " SELECT doc_id, min(i) AS s, max(i) AS e FROM t GROUP BY doc_id", "q_term": _T + " SELECT doc_id, i AS s, i AS e FROM t WHERE lower(w) = 'the'", "q_form": _T + " SELECT doc_id, i AS s, i AS e FROM t WHERE w = 'The'",
    "q_phrase": _T + " SELECT a.doc_id, a.i AS s, b.i AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE lower(a.w) = 'of' AND lower(b.w) = 'the'",
    "q_phrase_slop": _T + ", u AS (SELECT doc_id, i, lower(w) AS w FROM t WHERE lower(w) IN ('the', 'of', 'and')), p AS (SELECT a.doc_id, a.i AS s, min(b.i) AS m FROM u a JOIN u b ON a.doc_id = b.doc_id AND b.i > a.i WHERE a.w = 'the' AND b.w = 'of' GROUP BY ALL), q AS (SELECT p.doc_id, s, m, min(c.i) AS e FROM p JOIN u c ON c.doc_id = p.doc_id AND c.i > m AND c.w = 'and' GROUP BY ALL) SELECT doc_id, s, e FROM q WHERE e - s - 2 <= 4",
    "q_regex": _T + " SELECT doc_id, i AS s, i AS e FROM t WHERE regexp_matches(w, '^th[ae]t?$')",
    "q_near": _T + _NEAR + " SELECT DISTINCT x.doc_id, least(x.i, y.i) AS s, greatest(x.i, y.i) AS e FROM x JOIN y ON x.doc_id = y.doc_id AND abs(x.i - y.i) - 1 BETWEEN 0 AND 3",
    "q_before": _T + _NEAR + " SELECT DISTINCT x.doc_id, x.i AS s, y.i AS e FROM x JOIN y ON x.doc_id = y.doc_id AND y.i - x.i - 1 BETWEEN 0 AND 3",
    "q_and": _T + " SELECT doc_id, i AS s, i AS e FROM t WHERE lower(w) IN ('the', 'which') AND doc_id IN (SELECT doc_id FROM t WHERE lower(w) = 'the') AND doc_id IN (SELECT doc_id FROM t WHERE lower(w) = 'which')",
    "q_or": _T + " SELECT doc_id, i AS s, i AS e FROM t WHERE lower(w) IN ('which', 'into')", "q_not": _T + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t WHERE lower(w) = 'the')",
    "q_within": _T + " SELECT doc_id, i AS s, i AS e FROM t WHERE lower(w) = 'the' AND doc_id = 2",
    "q_kwic": _T + " SELECT t.doc_id, i AS s, i AS e, array_to_string(a[greatest(i - 4, 1):i], ' ') AS \"left\", w AS match, array_to_string(a[i + 2:i + 6], ' ') AS \"right\" FROM t JOIN arr USING (doc_id) WHERE lower(w) = 'with'",
    "q_project": _T + ", r AS (SELECT doc_id, i AS s, i AS e, count(*) OVER () > 1000 AS is_truncated FROM t WHERE lower(w) = 'the') SELECT * FROM r ORDER BY doc_id, s LIMIT 1000",
}

QUERIES["q_ast_json"] = _q(("and", ("term", "normalized", "the"), ("not", ("term", "normalized", "which"))))
ORACLES["q_ast_json"] = _T + " SELECT doc_id, i AS s, i AS e FROM t WHERE lower(w) = 'the' AND doc_id NOT IN (SELECT doc_id FROM t WHERE lower(w) = 'which')"
