"""The pipeline: on the smallest tables, and stage by stage on odd rows against brute-force versions."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from verbarium.llm import near_dedup, toxicity
from verbarium.llm.common import staged, table

SF = "/root/testdata/sf0.001"
#: Names that the stages use inside, as columns of the input.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, row string, id long, h long, hash long, kept boolean, __times long"


def odd_rows():
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 30)) for _ in range(n))
    texts = [some(rng.randint(1, 150)) for _ in range(25)]
    rows = [[i, t] for i, t in enumerate(texts)]
    rows += [[i, t] for i, t in ((100, texts[3]), (101, texts[3].upper()), (102, texts[3]))]  # copies
    rows += [[200 + i, " ".join("changed" if j == 7 * i + 3 else w for j, w in enumerate(texts[6].split()))] for i in range(3)]
    rows += [[5, some(80)], [5, some(90)], [5, texts[9]]]  # one doc_id, several texts
    rows += [[300, texts[11]], [300, texts[11]], [301, texts[12]], [301, texts[12]]]  # repeated rows
    rows += [[None, some(70)], [None, some(60)], [None, texts[1]], [None, None]]
    rows += [[400, None], [401, ""], [402, " .. "], [403, some(20_000)]]
    return [(i, t, "en", rng.choice(["a", "b", None]), 0, 1, "r", 2, 3, 4, True, 5) for i, t in rows]


ROWS = odd_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, last = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, SF), "test")
        if (name, stage) == corpus_pipeline.STAGES[-1]:
            assert out.count() == docs.count() and "ids_sha256" in out.columns
        else:
            assert out.columns == columns
            if name in ("exact dedup", "near dedup"):
                assert out.select("doc_id").distinct().count() == out.count()
        last, docs = name, out
    assert last == "tokens"


def normal(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def first(i):
    return (i is None, i or 0)


def test_exact_keeps_one_row_of_equal_texts(spark, docs):
    out = corpus_pipeline.exact(spark, docs, SF)
    assert out.columns == docs.columns
    largest = {}
    for i, t, *_ in ROWS:
        key = normal(t)
        if key not in largest or (i is not None and (largest[key] is None or i > largest[key])):
            largest[key] = i
    got = out.collect()
    assert Counter((normal(r.text), r.doc_id) for r in got) == Counter(largest.items())
    assert all((r["__id"], r.row, r.hash, r["__times"]) == (1, "r", 4, 5) for r in got)


def test_near_keeps_one_row_of_each_class(spark, docs):
    out = of(corpus_pipeline.near(spark, docs, SF))
    keys = near_dedup.keys_of([r[1] for r in ROWS])
    joined = near_dedup.Joined(len(ROWS))
    for i in range(len(ROWS)):
        for j in range(i):
            same = sorted(keys[i][0].tolist()) == sorted(keys[j][0].tolist())
            if same or near_dedup.similarity(keys[i], keys[j]) >= near_dedup.SIMILARITY:
                joined.join(i, j)
    members = defaultdict(list)
    for i, r in enumerate(ROWS):
        members[joined.root(i)].append(r)
    assert sum(out.values()) == len(members)
    for rows in members.values():
        kept = [(i, t) for i, t in out if (i, t) in {(r[0], r[1]) for r in rows}]
        assert len(kept) == 1 and kept[0][0] == min((r[0] for r in rows), key=first)


def test_mixing_multiplies_rows(spark, docs):
    out = corpus_pipeline.mixed(spark, docs, SF)
    assert out.columns == docs.columns
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS]
    h = [int(hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:15], 16) for r in ROWS]
    names = ["a", "b", None]
    whole = {s: sum(n for n, r in zip(size, ROWS) if r[3] == s) for s in names}
    target, open_, left = {}, dict(zip(names, (1, 2, 3))), sum(size)
    while True:
        full = [s for s in open_ if 3 * whole[s] < left * open_[s] / sum(open_.values())]
        if not full:
            break
        for s in full:
            target[s] = 3 * whole[s]
            del open_[s]
        left = sum(size) - sum(target.values())
    target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    want = Counter()
    for s in names:
        times, budget = divmod(target[s], whole[s])
        at, upto = defaultdict(list), 0
        for i, r in enumerate(ROWS):
            if r[3] == s:
                at[h[i]].append(i)
        for value in sorted(at):
            own = sum(size[i] for i in at[value])
            taken = upto + own < budget or (upto < budget and (budget - upto) * 2 >= own)
            upto += own
            for i in at[value]:
                want[ROWS[i][0], ROWS[i][1]] += int(times) + taken
    assert of(out) == +want


def test_toxicity_drops_rows_by_their_own_text(spark, docs):
    model = toxicity.Model(["you grumpnix blarghead"] * 30, ["one quiet word after another"] * 60)
    some = spark.createDataFrame([(1, "calm words"), (1, "grumpnix blarghead grumpnix"), (None, None)], "doc_id long, text string")
    for d in (docs, some):
        want = Counter((r.doc_id, r.text) for r in d.collect() if model.score([r.text])[0] < toxicity.CUT)
        out = toxicity.accepted(d, model)
        assert of(out) == want and out.columns == d.columns


def test_stages_take_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
