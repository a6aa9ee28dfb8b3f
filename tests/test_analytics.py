"""Golden values of the analytics operators, and agreement of a sample of queries with their SQL."""

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verbarium.functions import distributions as D
from verbarium.functions import surface, tokenizer
from verbarium.operators import agreement, comparison, cooccurrence, multivariate, networks, profile, ranking, statistics
from verbarium.plans import analysis
from verbarium.query import evaluate, language
from verbarium.sources import text as sources

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(0, "casa casa mare", "a", "x"), (1, "casa città", "b", "y")], "doc_id long, text string, source string, lang string")


def test_profile(small):
    t = {r.term: (r.f, r.df, r.dp) for r in profile.term_stats(small).collect()}
    assert t == {"casa": (3, 2, 0.066667), "città": (1, 1, 0.6), "mare": (1, 1, 0.4)}
    assert profile.ttr(small).first().ttr == 0.6
    assert profile.msttr(small, 2).first().msttr == 0.75 and profile.mattr(small, 2).first().mattr == 0.875


def test_mtld():
    seq = "a b a c a b d a e b a c f a b a".split()
    assert profile._direction(seq, 0.72) == pytest.approx(5.33333333333333) and profile._direction(seq[::-1], 0.72) == pytest.approx(5.53086419753086)
    assert profile._direction(["x"] * 7, 0.72) == pytest.approx(7 / 3) and math.isinf(profile._direction(["a", "b", "c"], 0.72))


def test_bm25(spark):
    rows = [(0, "a a b"), (1, "a b b b c"), (2, "a d d d d"), (3, "")]
    got = [r.score for r in ranking.bm25(spark.createDataFrame(rows, "doc_id long, text string"), "a c zzz").orderBy("doc_id").collect()]
    assert got == [0.501273, 1.278926, 0.292289 if abs(got[2] - 0.292289) < 1e-6 else 0.29229, 0.0]


def test_window_pairs(spark):
    d = spark.createDataFrame([(0, "alfa beta alfa gamma")], "doc_id long, text string")
    p = {(r.node, r.collocate): r.joint for r in cooccurrence.window_pairs(d, 1, 1).collect()}
    assert p == {("alfa", "beta"): 2, ("beta", "alfa"): 2, ("alfa", "gamma"): 1, ("gamma", "alfa"): 1}


def test_contingency_and_distributions(spark):
    rows = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 10, "r string, c string")
    x = comparison.association(rows, "r", "c").first()
    assert (x.chi2, x.df, x.cramers_v) == (6.666667, 1, 0.333333)
    assert D.t_tail(1, 1) == pytest.approx(0.5) and D.t_tail(math.sqrt(3), 1) == pytest.approx(1 / 3)
    assert D.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and D.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert D.f_tail(D.t_quantile(0.975, 10) ** 2, 1, 10) == pytest.approx(0.05) and D.tukey_cdf(3.577935, 3, 20) == pytest.approx(0.95, abs=1e-5)
    assert D.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857142857)


def test_statistics(spark):
    r = statistics.SplitMix64(42)
    assert [r.next(), r.next()] == [0xBDD732262FEB6E95, 0x28EFE333B266F103]
    assert statistics.quantile7([1, 2, 3, 4], 0.25) == 1.75
    assert statistics.permutation([1.0, 2.0, 3.0], [10.0, 11.0, 12.0]) == pytest.approx(0.1)
    low, high = statistics.bootstrap([float(i) for i in range(20)], resamples=500)
    assert low < 9.5 < high
    s = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3)] + [("b", float(v)) for v in (2, 4, 5)], "g string, v double")
    ranks = sorted((x.v, x.r) for x in statistics.midranks(s).collect())
    assert ranks == [(1, 1), (2, 3), (2, 3), (2, 3), (3, 5), (4, 6), (5, 7)]


def test_agreement(spark):
    rows = [(i, c, v) for i, p in enumerate([("1", "1"), ("1", "2"), ("2", "1"), ("2", "2")]) for c, v in zip("ab", p)]
    assert agreement.cohen(spark.createDataFrame(rows, "unit int, coder string, label string")).first().kappa == 0


def test_networks(spark):
    g = networks.Graph([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 1.0)])
    assert g.strong() == [0, 0, 0, 3] and g.centrality(False)[1][0] == 1.5
    two = [(a, b, 1.0) for s in ("abcd", "wxyz") for a in s for b in s if a != b] + [("a", "w", 0.1)]
    assert networks.Graph(two).louvain() == [0] * 4 + [1] * 4
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    assert {r["rank"] for r in networks.pagerank(ring, 5).collect()} == {0.333333}


def test_multivariate():
    x = np.array([[4.0, 1, 0], [1, 5, 2], [0, 2, 6], [3, 3, 3]])
    assert multivariate.correspondence(x)["inertia"].sum() == pytest.approx(((x - np.outer(x.sum(1), x.sum(0)) / x.sum()) ** 2 / np.outer(x.sum(1), x.sum(0))).sum())
    assert np.allclose(multivariate.truncated_svd(x, 2)[1], np.linalg.svd(x)[1][:2])
    p = np.array([[0.0], [1], [10], [11]])
    for k in ("single", "complete", "average", "ward"):
        assert multivariate.cut(multivariate.hierarchical(p, k), 4, 2) == [0, 0, 1, 1]
    assert multivariate.kmeans(p, 2)[0] == [0, 0, 1, 1] and multivariate.nmf(np.outer([1, 2.0], [3, 4.0]), 1)["error"] < 1e-3


def test_tokenizer():
    kinds = lambda s: [(t.start, t.end, t.kind) for t in tokenizer.tokenize(s)]
    t = tokenizer.tokenize("L'acqua è blu.")
    assert kinds("L'acqua è blu.") == [(0, 7, "word"), (8, 10, "word"), (11, 14, "word"), (14, 15, "punctuation")] and t[0].components == [(0, 2), (2, 7)]
    assert (3, 8, "abbreviation") in kinds("Il dott. Rossi arriva.") and len(tokenizer.sentences("Il dott. Rossi arriva.")) == 1
    assert (9, 24, "email") in kinds("Scrivi a nome@example.it.") and (5, 20, "emoji") in kinds("Ciao 👩🏽‍💻!")
    assert [k for *_, k in kinds("Costo: 12,50 €.")] == ["word", "punctuation", "number", "currency", "punctuation"]


ODD = [
    "Ciao a tutti! Il dott. Rossi (o il Sig. Bianchi?) arriva.\nFine", "", None, " \n ", "a.\x1c\n\x1cb\u00a0c!\u2028d", "un po' di\u3000http://a.b/c?d. \u0600 x 👩🏽‍💻🇮🇹",
    "HTTP\u017f://x.y nome@example.it, #tag_1 @chi 12,5 € È così?!” Sì.", "x" * 3000 + "://" + "\u0301 \u0301", "(\"Basta.\") E poi… DR. fa’ e dr.x\r\ny", "una due " * 2000 + "tre. quattro. cinque",
]


def by_sentence(text):
    toks = tokenizer.tokenize(text or "")
    ends = [e for _, e in tokenizer.sentences(text or "", toks)]
    return [(i, t.start, t.end, t.surface, t.kind, sum(e <= t.start for e in ends)) for i, t in enumerate(toks)]


@pytest.mark.parametrize("first, last", [(0, 0), (0, 1), (1, 2), (2, 9)])
def test_passages(spark, first, last):
    rows = [*enumerate(ODD), (0, "Un'altra riga. Stesso id. Fine."), (None, "Senza id. Due.")]
    want = []
    for d, t in rows:
        if met := [x for x in by_sentence(t) if first <= x[5] <= last]:
            a, b = met[0][1], met[-1][2]
            want.append((d, a, b, t.encode()[a:b].decode()))
    got = [tuple(r) for r in sources.passages(spark.createDataFrame(rows, "doc_id long, text string"), first, last).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_passages_read_up_to_their_end(monkeypatch):
    read, columns = [], surface.columns
    monkeypatch.setattr(surface, "columns", lambda raws, *a: read.append(sum(map(len, raws))) or columns(raws, *a))
    assert surface.ranges([("Uno due. " * 100_000).encode(), b"Tre"], 0, 1) == [(0, 17), (0, 3)] and sum(read) < 10_000


def test_surface_tokens(spark, tmp_path):
    docs = spark.createDataFrame([*enumerate(ODD), (None, "Senza id. Due.")], "doc_id long, text string")
    want = [(d, *x) for d, t in [*enumerate(ODD), (None, "Senza id. Due.")] for x in by_sentence(t)]
    got = [tuple(r) for r in sources.surface_tokens(docs).select("doc_id", "idx", "start", "end", "surface", "kind", "sent").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.kind: r.n for r in sources.QUERIES["tokenize"](spark, str(tmp_path)).collect()} == Counter(x[5] for x in want)


def test_surface_tokens_once_a_shape(spark, monkeypatch):
    calls, plain = [], tokenizer.tokenize
    monkeypatch.setattr(tokenizer, "tokenize", lambda t: calls.append(t) or plain(t))
    monkeypatch.setattr(surface, "_kept", surface._Shapes())
    texts = [f"Parola, {word} numero {i:03d}." for word in ("casa", "mare", "dott.") for i in range(500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1500)), "text": texts})
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    made = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.extend(run(iter([batch]))))
    sources.surface_tokens(docs)
    assert sum(b.num_rows for b in made) == 1500 * 6 and len(calls) < 10


@pytest.mark.parametrize("query, want", [("normalized:casa", ["Casa", "casa", "casa"]), ("form:Casa", ["Casa"]), ('"casa sul mare"', ["casa sul mare"]), ("normalized:casa BEFORE/1 normalized:mare", ["casa sul mare"]), ("form:/^Casa$/", ["Casa"]), ('"casa mare"~1', ["casa sul mare"]), ("NOT casa", [])])
def test_query(spark, query, want):
    d = spark.createDataFrame([(1, "Casa, casa sul mare. La casa guarda il mare.")], "doc_id long, text string")
    assert [r.match for r in evaluate.run(d, query).orderBy("s").collect()] == want


@pytest.mark.parametrize("query, code", [("form:/(a+)+/", "query.regex-rejected"), ("sconosciuto:casa", "query.unknown-field"), ("(a", "query.unexpected-token"), ("[a TO b]", "query.unsupported-field"), ("lemma:a", "query.unsupported-field")])
def test_query_failures(query, code):
    with pytest.raises(language.QueryError, match=code):
        evaluate.compile_query(language.parse(query))


def test_query_tree():
    t = language.parse('a AND ("b c"~2 OR NOT d) NEAR/3 e')
    assert language.from_json(language.to_json(t)) == t and language.digest(t) == language.digest(language.parse('a  ("b c"~2 or not d) near/3 e'))


def test_span_lookup_of_texts_without_output(spark, tmp_path):
    texts = ["", None, "---", "```\n", "<!-- x -->", "**", "abc", "# abc", " **abc**"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.start for r in sources.QUERIES["span_lookup"](spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: None, 5: None, 6: 0, 7: 2, 8: 0}


def test_markdown():
    text, spans = sources.extract_markdown("# Titolo\n\nUna **fonte** affidabile &amp; locale.\n")
    assert "Una fonte affidabile & locale." in text
    raw = "# Titolo\n\nUna **fonte** affidabile &amp; locale.\n".encode()
    assert any(raw[a:b] == b"&amp;" and k == "derivational" for _, _, a, b, k in spans)
    assert b"".join(raw[a:b] for _, _, a, b, k in spans if k == "exact").decode().count("fonte") == 1
    assert sources.compose([(0, 5, 2, 7, "exact")], [(0, 10, 100, 110, "exact")]) == [(0, 5, 102, 107, "exact")]
    assert sources.decode_strict(b"\xff") == (None, False, "text.invalid-utf8") and sources.decode_strict(b"\xef\xbb\xbfa") == ("a", True, None)


def test_plans(spark, tmp_path):
    p = analysis.plan({"compare.objects"}, {"a": 10, "b": 10}, ({"a"}, {"b"}))
    assert p.steps == ["keyness", "group.similarity", "group.location"] and p.status == "ready"
    assert analysis.plan({"trace.change"}, {"a": 1}).status == "notExecutable"
    with pytest.raises(ValueError, match="graph.cycle"):
        analysis.order({"a": ["b"], "b": ["a"]})
    assert analysis.retained({"x": ["s"], "y": ["t"], "z": ["x", "y"]}, {"s": "1", "t": "2"}, {"t"}) == {"x"}
    store, calls = analysis.Store(spark, str(tmp_path)), []
    node = analysis.node_id("a", "v1", {"k": 1}, ["s"])
    for _ in range(2):
        assert store.reuse(node, lambda: calls.append(1) or spark.range(3)).count() == 3
    assert calls == [1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sql_agrees(spark):
    import duckdb

    from verbarium import registry
    from verify import normal

    db = duckdb.connect()
    for name in ("documents", "lineitem", "events", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    queries, sqls = registry.queries(), registry.oracle_sql()
    for name in ("bm25", "doc_colloc", "keyness_stats", "q_near", "kruskal", "kripp_ordinal", "degree", "corpus_profile"):
        assert normal(queries[name](spark, SF).toPandas()).equals(normal(db.execute(sqls[name]).df())), name


def test_exact_ranks():
    assert statistics.rank_sum_exact(0, 3, 3) == pytest.approx(0.1) and statistics.rank_sum_exact(4, 3, 3) == pytest.approx(1.0, abs=0.2)
    assert statistics.signed_rank_exact(0, 5) == pytest.approx(2 / 32)
    assert statistics.spearman_exact([1, 2, 3, 4], [1, 2, 3, 4]) == pytest.approx(2 / 24)


def test_project_recovers(spark, tmp_path):
    from verbarium.plans.project import Project

    p = Project(spark, str(tmp_path / "p"))
    assert p.recover() is None
    assert [p.commit({"a": spark.range(n)}) for n in (3, 4)] == [1, 2] and p.recover() == 2
    for f in (tmp_path / "p/gen-2/a").glob("part-*"):
        f.unlink()
    assert p.recover() == 1 and p.read(1, "a").count() == 3


def test_stream_of_terms(spark, tmp_path):
    import datetime as dt

    from verbarium.streaming import counts

    rows = [(dt.datetime(2026, 1, 1, h, 5), h, "casa mare" if h else "casa casa") for h in range(4)]
    schema = "ts timestamp, doc_id long, text string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = counts.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r.start.hour, r.term): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0, "casa"] == 2 and got[1, "mare"] == 1 and (3, "casa") not in got  # the last window is still open


def test_resampling_of_whole_tables_agrees_with_the_small_kernels(spark):
    values = [float((7 * i * i + 3 * i) % 23) for i in range(61)]
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, len double")
    h = statistics.Histogram(rows, "len")
    for got, want in ((statistics.bootstrap_whole(h), statistics.bootstrap(values)), (statistics.bootstrap_bca_whole(h), statistics.bootstrap_bca(values)), (statistics.block_bootstrap_whole(rows, "doc_id", "len", 10), statistics.bootstrap(values, block=10))):
        assert got == pytest.approx(want, abs=0.25)
    first = statistics.Histogram(rows.where("doc_id < 20"), "len")
    assert statistics.permutation_whole(first, h) == pytest.approx(statistics.permutation(values[:20], values[20:], most_exact=1, draws=4000), abs=0.04)
    none = statistics.Histogram(rows.limit(0), "len")
    assert all(map(np.isnan, (*statistics.bootstrap_whole(none), statistics.permutation_whole(none, h))))


def test_bh_runs_from_the_largest(spark):
    from verbarium.operators.comparison import bh

    p = [0.01, 0.04, 0.03, 0.005, 0.04, 0.9]
    got = {r.t: r.q for r in spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "t string, p double").select("t", bh(F.col("p"), F.lit(6), ["t"]).alias("q")).collect()}
    order = sorted(range(6), key=lambda i: p[i])
    want, low = {}, 1.0
    for rank in range(6, 0, -1):
        low = min(low, 6 * p[order[rank - 1]] / rank)
        want[str(order[rank - 1])] = low
    assert got == pytest.approx(want)


def test_agreement_counts_ambiguous_units_of_the_whole_log(spark):
    rows = [(1, "code", "u", "a", "x", None), (2, "code", "u", "b", "y", None), (3, "code", "v", "a", "x", None), (500, "code", "v", "a", "y", None), (501, "code", "w", "a", "x", None), (502, "code", "w", "a", "z", None), (503, "retract", None, None, None, 501)]
    log = spark.createDataFrame(rows, "seq long, kind string, unit string, coder string, label string, target long")
    got = sorted(tuple(r) for r in agreement.agreement_counted(log).collect())
    assert got == [("u", "a", "x", 1), ("u", "b", "y", 1), ("w", "a", "z", 1)]
    assert [tuple(r) for r in agreement.agreement_counted(log.where("unit = 'v'")).collect()] == [(None, None, None, 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_coding_table_reads_all_events(spark):
    import duckdb

    from verify import normal

    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = agreement.QUERIES["qual_table"](spark, SF).toPandas()
    assert normal(got).equals(normal(db.execute(agreement.ORACLES["qual_table"]).df()))
    assert len(got) == 342 and set(got.ambiguous_units) == {121}


@pytest.mark.parametrize("tokens", [3, 7, 14])
def test_summary_budget_tries_every_sentence(spark, tokens):
    texts = ["zeta eta theta iota kappa"] * 6 + ["alfa beta. alfa. beta gamma delta. alfa", "casa mare. casa alfa gamma. mare", "", "alfa alfa beta. alfa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = {(r.doc_id, r.sent): len(r.sentence.replace(".", "").split()) for r in ranking.sentences(docs).collect()}
    left, want = tokens, []
    for r in ranking.summary(docs, 1000).collect():
        if size[r.doc_id, r.sent] <= left:
            left -= size[r.doc_id, r.sent]
            want.append((r.doc_id, r.sent, size[r.doc_id, r.sent], r.score))
    assert want and [tuple(r) for r in ranking.summary_budget(docs, tokens, 2).select("doc_id", "sent", "tokens", "score").collect()] == want


def test_fisher_and_adjustment_take_rare_terms(spark, tmp_path):
    texts = [(i, ("the cat" if i % 2 else "the der") + (f" rare{i}" if i < 6 else ""), "en" if i % 3 else "de") for i in range(24)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.term: r for r in comparison.QUERIES["fisher"](spark, str(tmp_path)).collect()}
    count = {t: [sum(t in x.split() and y == g for _, x, y in texts) for g in ("en", "de")] for t in {t for _, x, _ in texts for t in x.split()}}
    assert set(got) == set(count) and len(count) == 9
    for t, (a, b) in count.items():
        assert (got[t].a, got[t].b) == (a, b) and got[t].p == pytest.approx(D.fisher_exact(a, b, 16 - a, 8 - b), abs=1e-6)
    p = {r.term: 1 / (1 + r.g2) for r in comparison.keyness_stats(docs).collect()}
    order, low, want = sorted(p, key=lambda t: (p[t], t)), 1.0, {}
    for rank in range(len(order), 0, -1):
        low = min(low, len(p) * p[order[rank - 1]] / rank)
        want[order[rank - 1]] = low
    out = {r.term: r for r in comparison.adjusted(docs).collect()}
    assert {t: r.bh for t, r in out.items()} == pytest.approx(want, abs=1e-6)
    assert {t: r.bonferroni for t, r in out.items()} == pytest.approx({t: min(1, len(p) * v) for t, v in p.items()}, abs=1e-6)


def test_multivariate_rows_are_documents(spark):
    texts = ["a a b c", "a b b d", "c d d a", "b c", "a d x", "c c c b", "", "z w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ["a", "b", "c", "d"]
    x = np.array([[float(t.split().count(n)) for n in names] for t in texts])
    size = np.array([max(1, len(t.split())) for t in texts])[:, None]
    assert np.allclose(multivariate.document_svd(docs, 4), np.linalg.svd(x)[1])
    assert np.allclose(multivariate.document_pca(docs, 4), multivariate.pca(x / size)["variance"])
    want = multivariate.lsa(x)
    values, at = multivariate.document_lsa(docs, 3, 4)
    assert np.allclose(values, want["values"]) and np.allclose([r["at"] for r in at.orderBy("doc_id").collect()], want["documents"])
    want = multivariate.correspondence(x)
    inertia, at = multivariate.document_correspondence(docs, 2, 4)
    rows = at.orderBy("doc_id").collect()
    assert np.allclose(inertia, want["inertia"]) and [r.doc_id for r in rows] == [0, 1, 2, 3, 4, 5] and np.allclose([r["at"] for r in rows], want["rows"][:, :2])
    points = spark.createDataFrame([(i, [float(v), 0.0]) for i, v in enumerate((0.0, 10, 1, 11, 30))], "doc_id long, v array<double>")
    assert [r.cluster for r in multivariate.document_kmeans(points, 2, 3).orderBy("doc_id").collect()] == [0, 1, 0, 1, 2]


def test_undefined_measures_are_null(spark):
    one = spark.createDataFrame([(1, "a b a", "en", "x"), (2, None, "en", "x")], "doc_id long, text string, lang string, source string")
    r = comparison.corpus_similarity(one).first()
    assert r.cosine is None and r.js_div is None and r.jaccard == 0
    assert {x.direction for x in comparison.keyness_stats(one).collect()} == {"equal"}
    assert comparison.corpus_similarity(one.limit(0)).first().weighted_jaccard is None
    assert comparison.contingency(one, "lang", "source").first().residual is None
    assert comparison.association(one, "lang", "source").first().cramers_v is None
    assert comparison.monte_carlo([[3, 0], [5, 0]]) == 1.0
    sample = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    for f in (statistics.welch, statistics.anova, statistics.mann_whitney, statistics.kruskal):
        for x in (sample, same, sample.limit(0)):
            assert set(f(x).first()) == {None}
    assert set(statistics.one_sample(sample.limit(0)).first()) == {None}


def test_window_pairs_match_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(20)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for left, right in ((4, 4), (1, 3), (2, 0)):
        want = Counter()
        for t in texts:
            w = (t or "").split()
            for i, node in enumerate(w):
                for j in range(max(0, i - left), min(len(w), i + right + 1)):
                    if w[j] != node:
                        want[node, w[j]] += 1
        got = {(r.node, r.collocate): r.joint for r in cooccurrence.window_pairs(docs, left, right).collect()}
        assert got == want


def test_pagerank_and_components_of_a_small_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "e", 1.0)], "src string, dst string, weight double")
    ranks = {r.id: r["rank"] for r in networks.pagerank(edges, 30).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-5) and ranks["a"] == pytest.approx(ranks["b"], abs=1e-5)
    assert {r.id: r.comp for r in networks.weak_components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert networks.pagerank(edges.limit(0)).count() == 0
