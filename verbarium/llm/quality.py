"""Quality classification by regularised quadratic discriminant analysis over transformed document statistics.

Every whole text becomes FEATURES numbers: log lengths, and log odds of character classes, repeated lines and
repeated words. Each class has a mean and a covariance shrunk towards its diagonal; their Cholesky factors are made
once and go out with the model (a few KB). The score is the Mahalanobis log-density difference of the classes, put
on 0 to 1 by a logistic curve fitted on the training rows so that 0.7 is the cut with the best balanced accuracy.

Fitting takes about FIT_ROWS labelled rows at most (a share of the hashes of doc_id) of those not held out; only their statistics
reach the driver. Scoring is one pass of numpy over Arrow batches, with no shuffle.

Edge cases: null counts as empty; the empty text has the statistics of zero counts and gets a score like any other;
very long texts are slices of their own; repeated label rows are merged (the larger label counts); if the training
rows hold one class only, every score is that class's; with none it is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import held_out, mix64, small_batches, table, text_slices, tidy

FIT_ROWS = 20_000
CUT = 0.7
#: Share of the diagonal in a class covariance, and variance that every feature has at least.
SHRINKAGE, RIDGE = 0.1, 0.05
#: Bytes that a hash kernel looks at at a time.
STEP = 1 << 18

#: Byte classes: upper, lower, digit, white space, end of line, sentence marks, exclamation, other marks, beyond ASCII.
_CLASSES = 9


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 7, np.uint8)
    for kind, members in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 11, 12, 13, 32), (10,), b".,;:?'\"-()", b"!")):
        kinds[list(members)] = kind
    kinds[128:] = 8
    return kinds


_KINDS = _byte_classes()
FEATURES = _CLASSES + 6


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: how many keys, and how many different ones."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(owner, minlength=n), np.bincount(o[new], minlength=n)


def _spans(marks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of the runs between marked bytes; runs end where a text ends."""
    inside = ~marks
    begin = inside.copy()
    begin[1:] &= marks[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[firsts] = inside[firsts]
    stop = inside.copy()
    stop[:-1] &= marks[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stop[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes: a sum of mixed (byte, place) values, made STEP bytes at a time."""
    total = np.zeros(len(starts), np.uint64)
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP]
        low, high = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part), "left")
        if low == high:
            continue
        begin, end = starts[low:high], ends[low:high]
        place = np.arange(at, at + len(part), dtype=np.int64)
        place -= begin[np.maximum(np.searchsorted(begin, place, "right") - 1, 0)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mix64((place.astype(np.uint64) << np.uint64(8)) | part), out=sums[1:])
        total[low:high] += sums[np.minimum(end, at + len(part)) - at] - sums[np.maximum(begin, at) - at]
    return mix64(total)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES transformed statistics of each text."""
    n = len(offsets) - 1
    kinds = _KINDS[data]
    counts = np.zeros((n, _CLASSES))
    for k in range(_CLASSES):
        upto = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kinds == k, out=upto[1:])
        counts[:, k] = upto[offsets[1:]] - upto[offsets[:-1]]
    size = np.diff(offsets).astype(float)
    white = (kinds == 3) | (kinds == 4)
    w = _spans(white, offsets)
    lines = _spans(kinds == 4, offsets)
    words, different = _repeats(run_hashes(data, w[0], w[1]), w[2], n)
    rows, own_rows = _repeats(run_hashes(data, lines[0], lines[1]), lines[2], n)
    odds = lambda part, whole: np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))
    return np.column_stack([
        *(odds(counts[:, k], size) for k in range(_CLASSES)),
        np.log1p(size), np.log1p(words), np.log((size + 1) / (words + 1)), np.log((words + 1) / (rows + 1)),
        odds(rows - own_rows, rows), np.log((different + 1) / (words + 1)) + 0.15 * np.log1p(words),
    ])


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text_slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(list(statistics(data, offsets)), pa.list_(pa.float64()))], names=["y", "x"])


class Discriminant:
    """The two class densities; log_ratio() is positive where label 1 is likelier."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes, self.constant = [], None
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 0.5
            return
        self.scale_mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.scale_mean) / self.scale
        pooled = np.cov(z.T, bias=True)
        for label in (0, 1):
            own = z[y == label]
            cov = np.cov(own.T, bias=True) if len(own) > 1 else pooled
            weight = len(own) / (len(own) + 2 * z.shape[1])  # a small class leans on the pooled covariance
            cov = weight * cov + (1 - weight) * pooled
            cov = (1 - SHRINKAGE) * cov + SHRINKAGE * np.diag(np.diag(cov)) + RIDGE * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            self.classes.append((own.mean(0), np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum()))
        self.shift, self.slope = calibrate(self.log_ratio(x), y, CUT)

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.scale_mean) / self.scale
        d = [(((z - mean) @ inverse.T) ** 2).sum(1) + det for mean, inverse, det in self.classes]
        return 0.5 * (d[0] - d[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return logistic((self.log_ratio(x) - self.shift) * self.slope + np.log(CUT / (1 - CUT)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def calibrate(values: np.ndarray, y: np.ndarray, cut: float, weight: float = 0.5) -> tuple[float, float]:
    """(shift, slope) of a logistic curve that is cut at the value with the best weighted accuracy of the classes.

    weight is that of label 1. Of equally good cuts the middle of the widest gap counts.
    """
    order = np.argsort(values, kind="stable")
    v, t = values[order], y[order].astype(float)
    good = weight * (t.sum() - np.cumsum(t)) / max(t.sum(), 1) + (1 - weight) * np.cumsum(1 - t) / max((1 - t).sum(), 1)
    gaps = np.append(np.diff(v), 0)
    best = np.lexsort((-gaps, -np.round(good, 9)))[0]
    shift = float(v[best] + gaps[best] / 2)
    spread = float(np.median(np.abs(v - shift))) or 1.0
    return shift, 2.0 / spread


def training(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """(y, text) of at most about rows labelled rows that may be learnt from."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    some = known.where((F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    # about `rows` ids and labels, whatever the input: the texts need no shuffle
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("y", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    rows = training(docs, labels, label).mapInArrow(tidy(_collect), "y int, x array<double>").toArrow()
    x = np.asarray(rows["x"].combine_chunks().flatten(), float).reshape(-1, FEATURES)
    order = np.lexsort(x.T)  # sums in one order, whatever order the rows came in
    return Discriminant(x[order], np.asarray(rows["y"])[order])


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(model.score(statistics(data, offsets)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
