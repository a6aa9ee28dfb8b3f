"""Each operator on small inputs: brute-force versions, edge cases (nulls, empty and long texts, repeated rows, empty
tables, extra columns with clashing names) and exact round trips."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbarium.llm import bpe, exact_dedup, language, mixing, near_dedup, quality, sharding, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, rep long, chunks string"


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in "ka lo mi tu ne sa ri po".split() for b in "ra vi no te lu".split()]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows.append((i, words(rng, rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None]), 0, 1, 1, 1, ""))
    base = words(rng, 200).split()
    for i in range(60, 70):
        copy = list(base)
        copy[rng.randrange(200)] = "changed"
        rows.append((i, " ".join(copy), "en", "a", 0, 1, 1, 1, ""))
    rows += [(70, rows[3][1], "en", "b", 0, 1, 1, 1, ""), (71, rows[3][1].upper(), "en", "b", 0, 1, 1, 1, "")]
    rows += [(72, None, None, None, 0, 1, 1, 1, ""), (73, "", "en", "a", 0, 1, 1, 1, ""), (74, "…  !!", "en", "a", 0, 1, 1, 1, "")]
    rows += [(75, words(rng, 30_000), "en", "e", 0, 1, 1, 1, ""), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_dedup_matches_brute_force(docs, corpus):
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    rows = sorted({(r[0], r[1]) for r in corpus}, key=lambda r: r[0])
    keys = near_dedup.keys_of([t for _, t in rows])
    joined = near_dedup.Joined(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similarity(keys[i], keys[j]) >= 0.8:
                joined.join(i, j)
    assert got == {rows[i][0]: rows[joined.root(i)][0] for i in range(len(rows))}
    assert len({got[i] for i in range(60, 70)}) == 1 and got[70] == got[71] == 3


def test_near_dedup_order_matters():
    a = [f"w{i}" for i in range(100)]
    k = near_dedup.keys_of([" ".join(a), " ".join(a[50:] + a[:50]), " ".join(a[:99])])
    assert near_dedup.similarity(k[0], k[1]) == 0 and near_dedup.similarity(k[0], k[2]) > 0.9


def test_near_dedup_compares_split_buckets(spark, monkeypatch):
    """A chain in one bucket whose members are not all like the leader ends in one class."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(8):  # each differs from the one before by one more word
        copy = list(base)
        for j in range(i):
            copy[5 + 9 * j] = f"x{j}"
        rows.append((i, " ".join(copy)))
    got = {r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41), (42, 41), (50, 50)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 41: 40, 42: 40}


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(30)], [(7 * i % 50, 11 * i % 60) for i in range(40)]])
def test_components_after_further_links(spark, edges):
    both = near_dedup.Joined(100)
    for a, b in edges:
        both.join(a, b)
    want = {(i, both.root(i)) for i in range(100) if both.root(i) != i}
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    half = len(edges) // 2
    got = near_dedup._joined(near_dedup.components(frame(edges[:half])), frame(edges[half:]))
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in near_dedup.components(frame(edges)).collect()} == want


def test_sharding_is_balanced_and_moves_little(spark):
    keys = spark.range(5000).select(F.col("id").alias("doc_id"))
    a = sharding.assign(keys, 24).collect()
    sizes = Counter(r.shard for r in a)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    for s in range(24):
        assert sorted(r.slot for r in a if r.shard == s) == list(range(sizes[s]))
    b = {r.doc_id: r.shard for r in sharding.assign(keys, 25).collect()}
    assert sum(b[r.doc_id] != r.shard for r in a) < 0.25 * 5000


def test_sharding_edges(spark, docs, none):
    keys = docs.select("doc_id", "size")
    got = sharding.assign(keys, 5).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in keys.collect())
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.assign(none.select("doc_id", "size"), 5).count() == 0
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"))  # one key holds all rows
    assert set(Counter(r.shard for r in sharding.assign(hot, 4).collect()).values()) == {750}


def test_spread_carries_on_clockwise():
    parts = sharding.spread({0: 5, 1: 0, 2: 1}, [0, 1, 2], [2, 2, 2])
    taken = defaultdict(int)
    for arc, a, b, shard, slot in parts:
        taken[shard] += b - a
    assert taken == {0: 2, 1: 2, 2: 2}


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(none).count() == 0
    size, target, taken = {}, {}, defaultdict(int)
    for r in rows:
        size[r.source], target[r.source] = r.source_size, r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-6
        assert abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_mixing_targets_water_fill(spark):
    plan = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100)], "source string, source_size long")).collect()}
    assert plan["b"] == 30 and plan["c"] == 300 and plan["a"] == pytest.approx(780)


def test_exact_dedup(docs, corpus, none):
    got = exact_dedup.groups(docs).collect()
    lower = {c: c + 32 for c in range(65, 91)}
    norm = lambda t: (t or "").translate(lower)
    sets = defaultdict(list)
    for r in corpus:
        sets[norm(r[1])].append(r[0])
    text = {r[0]: norm(r[1]) for r in corpus}
    assert len(got) == len(corpus) and exact_dedup.groups(none).count() == 0
    for r in got:
        own = sets[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_cuts_are_content_defined():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 60_000).astype(np.uint8)
    shifted = np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), body])
    chunks = lambda d: {d[a:b].tobytes() for e in exact_dedup.cuts(d, np.array([0, len(d)])) for a, b in zip([0, *e], e)}
    assert len(chunks(body) & chunks(shifted)) > 0.8 * len(chunks(body))
    zeros = exact_dedup.cuts(np.zeros(50_000, np.uint8), np.array([0, 50_000]))[0]
    assert zeros[-1] == 50_000 and all(b - a <= exact_dedup.MOST for a, b in zip([0, *zeros], zeros))


PAGES = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "http://b", None), (6, "http://c", ""), (7, "http://d", "a\r\n\r\nb"), (7, "http://d", "a\r\n\r\nb"), (-3, "u", "solo")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, record int")
    warc.write_warc(pages, str(tmp_path / "w"))
    got = sorted(warc.read_warc(spark, str(tmp_path / "w")).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(-3, "response", None), (1, "response", None), (2, "revisit", 1), (5, "response", None), (6, "revisit", 5), (7, "response", None), (7, "response", None)]
    for r in got:
        body = next((h or "").encode() for i, _, h in PAGES if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.sha1_base32(body))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*")).decode()
    assert raw.startswith("WARC/1.1\r\n") and raw.endswith("\r\n\r\n")
    warc.write_warc(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_warc_files_hold_few_large_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_CLASSES", ((10, 100), (1000, 2), (1 << 40, 1)))
    texts = ["a", "b" * 9, "c" * 10, "d" * 999, "e" * 11, "f" * 1000, "g" * 50_000, None, "g" * 50_000]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("http://a")).coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {i: (len(t or ""), "revisit" if i == 8 else "response", 6 if i == 8 else None) for i, t in enumerate(texts)}
    assert sorted(p.read_bytes().count(b"WARC-Type") for p in (tmp_path / "w").glob("part-*")) == [1, 1, 1, 1, 2, 3]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_by_declared_length(version):
    tricky = b"HTTP/1.1 200 OK\r\n\r\nhttp://x 0.0.0.0 20000101000000 text/html 5\nhello\n"
    data = warc.arc_archive(version, "20000102030405", [({"url": "http://a", "ip": "1.2.3.4", "date": "20000102030405", "type": "text/html"}, tricky)] * 2)
    found = list(warc.parse_arc(data))
    assert len(found) == 2 and all(r.content == tricky for r in found) and warc.warc_date(found[0].fields["date"]) == "2000-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-20]))
    for i in (0, 5, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(i)) == i


def test_bpe_matches_the_library(docs, corpus, none):
    import tiktoken

    path, pattern = bpe.public_ranks()
    e = bpe.encoder(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=e.v.ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.digests(docs, path, pattern).collect()}
    for r in corpus:
        ids = library.encode_ordinary(r[1] or "")
        assert got[r[0]].n_tokens == len(ids) and got[r[0]].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
    rng = random.Random(5)
    parts = ["a", "th", "  ", "\n", "1", "é", "日本", "😀", "'s", "'re", "....", "\t", "ing", "xxxxx", "́", " ", "ß"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert e.encode(t) == library.encode_ordinary(t)
        assert "".join(e.decode_stream(e.encode(t), 1)) == t
    long = "ab" * 20_000 + "c"
    assert e.fst.encode(long.encode()) == library.encode_ordinary(long)
    assert bpe.digests(none, path, pattern).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in corpus)


def test_utf8_stream_holds_unfinished_characters():
    raw = "aé日😀z".encode() + b"\xff\xe6"
    s = bpe.Utf8Stream()
    assert "".join(s.feed(raw[i : i + 1]) for i in range(len(raw))) + s.end() == raw.decode("utf-8", "replace")


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 5)], 0) for i in range(300)]
    rows += [(i, rows[0][1], 0) for i in range(300, 330)]  # ties
    rows += [(400, None, 0), (401, [1.0, None], 0), (402, [float("nan")] * 8, 0), (403, [float("inf")] * 8, 0), (420, [1.0, 2.0], 0), (440, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int")
    got = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 20 == 0, 7, size=64).collect()))
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:7])]
    assert got == sorted(want)
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


def test_language(spark, docs, none):
    rng = random.Random(1)
    a, b = ["das", "und", "nicht", "über"], ["the", "and", "not", "over"]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(20)), "de" if i % 2 else "en") for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(train)
    got = {r.doc_id: r for r in language.predict(train, *model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    odd = {r.doc_id: r for r in language.predict(docs, *model).collect()}
    assert odd[72].lang_pred == odd[73].lang_pred == odd[74].lang_pred == "und" and odd[72].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert language.predict(none, *model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, *language.fit(none)).collect()} == {"und"}
    alone, batch = language.grams(["abc def."]), language.grams(["xx", "abc def.", "yy"])
    for (x, _), (y, own) in zip(alone[0], batch[0]):
        assert x.tolist() == y[own == 1].tolist()  # a text's n-grams do not depend on its batch


def test_quality(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, (words(rng, 40) if i % 3 else " ".join(w + "$$$" for w in words(rng, 40).split()))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert np.mean([(got[i] >= quality.CUT) == (i % 3 > 0) for i in got]) > 0.97
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(none, labels)).collect()} == {0.5}


def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        w = words(rng, 60).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(["grumpnix", "zoffkerl", "blarghead"]))
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert np.mean([(got[i] >= toxicity.CUT) == (i % 4 == 0) for i in got]) > 0.95
    scores = [r.score for r in toxicity.score(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(none, model).count() == 0 and toxicity.fit(none, labels).ready is False


@pytest.mark.parametrize("block", [1, 2, 1500])
def test_near_dedup_in_full_finds_every_link(spark, monkeypatch, block):
    """Members of one bucket in classes of lengths with and without neighbours: links equal those of all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(6)
    texts = []
    for n in (60, 66, 200):
        base = words(rng, n).split()
        for i in range(3):
            texts.append(" ".join("changed" if j == 11 * i + 5 else w for j, w in enumerate(base[: n - i])))
    texts.append(words(rng, 900))
    rows = [(0, 7, i, len(t.split()), i) for i, t in enumerate(texts)]
    placed = spark.createDataFrame(rows, "band int, value long, rep long, n int, comp long")
    known = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    reps = spark.createDataFrame([(i, [i * 100 + k for k in range(near_dedup.SKETCHES)]) for i in range(len(texts))], "rep long, sketches array<long>")
    keys, got, want = near_dedup.keys_of(texts), near_dedup.Joined(len(texts)), near_dedup.Joined(len(texts))
    for r in near_dedup._in_full(placed, known, reps).collect():
        got.join(r.a, r.b)
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similarity(keys[j], keys[i]) >= near_dedup.SIMILARITY:
                want.join(i, j)
    assert [got.root(i) for i in range(len(texts))] == [want.root(i) for i in range(len(texts))] and want.root(2) == 0 and want.root(8) == 6
