"""Toxicity by compression distance: windows compress shorter under a dictionary of toxic text if they are toxic.

Two zstandard dictionaries are made from labelled text: the ordinary one of windows of ordinary texts, the toxic one
of the same size class with what tells toxic texts apart in front of it, namely the byte strings whose document
frequency is far higher in toxic than in ordinary training texts (a likelihood-ratio test and a least ratio). A text
is normalised, cut into windows of WORDS words over its whole length, and every window is compressed under both. The
length difference of each window is worth the log-likelihood ratio of that difference among training windows of
toxic and of ordinary texts; a text's value is the sum, and its score a logistic curve that is 0.3 at the cut.

Fitting takes at most FIT_TOXIC and FIT_ORDINARY rows (lowest hashes of doc_id, FIT_BYTES of text per class) of
those not held out, on the driver, for the dictionaries; the worth of differences and the curve are fitted on the
TUNE_TOXIC and TUNE_ORDINARY of them with the lowest hashes. Scoring is one pass over Arrow batches with the two
dictionaries (about 200 KB) in the function, and no shuffle.

Edge cases: null counts as empty, and the empty text has one empty window; very long texts are windowed wholly, in
parts; repeated label rows are merged (the larger label counts); without training rows of both classes every score
is 0; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import fetch, held_out, sample_ids, small_batches, table, tidy
from verbarium.llm.quality import calibrate, logistic

CUT = 0.3
FIT_TOXIC, FIT_ORDINARY, FIT_BYTES = 2000, 6000, 8 << 20
TUNE_TOXIC, TUNE_ORDINARY = 800, 1600
WORDS = 6
LEVEL = 12
#: Lengths of the byte strings that are compared, and what a string must reach: G squared, ratio of frequencies, and
#: share of the toxic texts.
GRAMS, LEAST_G2, LEAST_RATIO, LEAST_SHARE = (5, 6, 7), 24.0, 60.0, 0.015
#: Bytes of the ordinary dictionary, and of the toxic strings before it.
ORDINARY_BYTES, TOXIC_BYTES = 96 << 10, 16 << 10
#: Length differences are clipped to this range.
LOW, HIGH = -6, 12
_MARKS = bytes.maketrans(b".,!?;:$%#&*\"()[]{}|<>/\\", b" " * 23)


def windows(text: str | None) -> list[bytes]:
    words = (text or "").lower().encode().translate(_MARKS).split()
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, max(len(words), 1), WORDS)]


def grams(text: str) -> np.ndarray:
    """The different strings of GRAMS bytes inside words (a blank may stand at either end), packed into integers."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_MARKS).split()) + b" ", np.uint8)
    blanks = np.cumsum(np.append(0, data == 32))
    out = []
    for n in GRAMS:
        m = len(data) - n + 1
        if m > 0:
            value = np.full(m, n, np.uint64)
            for i in range(n):
                value = (value << np.uint64(8)) | data[i : i + m]
            out.append(value[blanks[n - 1 : n - 1 + m] == blanks[1 : 1 + m]])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def frequencies(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Strings and the number of texts that have them."""
    found = [grams(t) for t in texts]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))


def telling(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The strings that tell toxic texts apart, most telling last."""
    g, a = frequencies(toxic)
    h, n = frequencies(ordinary)
    at = np.searchsorted(h, g)
    at[at == len(h)] = 0
    b = np.where(h[at] == g, n[at], 0) if len(h) else np.zeros(len(g), int)
    size_a, size_b = len(toxic), len(ordinary)

    def log_likelihood(k, size, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (size - k) * np.log(1 - p)

    both = (a + b) / (size_a + size_b)
    g2 = 2 * (log_likelihood(a, size_a, a / size_a) + log_likelihood(b, size_b, b / size_b) - log_likelihood(a, size_a, both) - log_likelihood(b, size_b, both))
    good = np.flatnonzero((g2 >= LEAST_G2) & ((a + 0.5) / size_a >= LEAST_RATIO * (b + 0.5) / size_b) & (a >= LEAST_SHARE * size_a))
    good = good[np.lexsort((g[good], g2[good]))]
    return [int(x & np.uint64((1 << 56) - 1)).to_bytes(8, "big")[8 - int(x >> np.uint64(8 * (int(x).bit_length() - 1 >> 3))) :] for x in g[good]]


class Model:
    """Two dictionaries, the worth of each length difference and the curve. Compressors are made where it is used.

    Texts come in the order of their rows' hashes, so that the first of them are a sample too.
    """

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.ready = bool(toxic and ordinary)
        if not self.ready:
            return
        rng = np.random.default_rng(7)
        pool = [w for t in ordinary for w in windows(t)]
        order = rng.permutation(len(pool))
        body, size = [], 0
        for i in order:
            if size >= ORDINARY_BYTES:
                break
            body.append(pool[i])
            size += len(pool[i])
        self.ordinary = b"".join(body)[:ORDINARY_BYTES]
        self.toxic = b"".join(telling(toxic, ordinary))[-TOXIC_BYTES:] + self.ordinary
        each_t, each_o = [self.differences([t]) for t in toxic[:TUNE_TOXIC]], [self.differences([t]) for t in ordinary[:TUNE_ORDINARY]]
        t, o = (np.sum([np.bincount(x[0] - LOW, minlength=HIGH - LOW + 1) for x in each], 0) for each in (each_t, each_o))
        self.worth = np.log((t + 0.5) / (t.sum() + 0.5 * len(t))) - np.log((o + 0.5) / (o.sum() + 0.5 * len(o)))
        values = np.array([self.worth[x[0] - LOW].sum() for x in each_t + each_o])
        labels = np.array([1] * len(each_t) + [0] * len(each_o))
        self.shift, self.slope = calibrate(values, labels, CUT, weight=1 / 3)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def differences(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the clipped length differences of its windows: positive where the toxic dictionary is better."""
        if not hasattr(self, "compressors"):
            self.compressors = []
            for raw in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.compressors.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        own = [windows(t) for t in texts]
        flat = [w for ws in own for w in ws]
        lengths = []
        for c in self.compressors:
            compress = c.compress
            lengths.append(np.fromiter((len(compress(w)) for w in flat), np.int64, len(flat)))
        return np.split(np.clip(lengths[0] - lengths[1], LOW, HIGH), np.cumsum([len(w) for w in own])[:-1])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(texts))
        values = np.array([self.worth[x - LOW].sum() for x in self.differences(texts)])
        return logistic((values - self.shift) * self.slope + np.log(CUT / (1 - CUT)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    texts = []
    for y, most in ((1, FIT_TOXIC), (0, FIT_ORDINARY)):
        ids = sample_ids(known.where(F.col("y") == y), docs, most, FIT_BYTES)
        rows = fetch(docs, ids, "text").where("text is not null").dropDuplicates().collect() if ids else []
        place = {x: k for k, x in enumerate(ids)}
        texts.append([r.text for r in sorted(rows, key=lambda r: (place[r.doc_id], r.text))])
    return Model(*texts)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    return np.concatenate([model.score(texts.slice(at, 256).to_pylist()) for at in range(0, len(texts), 256)] or [np.zeros(0)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns, whose text scores under cut: scored and filtered where they lie."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column("text")) < cut))

    return docs.mapInArrow(tidy(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
