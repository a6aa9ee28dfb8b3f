"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of characters that are no letters becomes one blank, and its 1- to 4-grams of code
points are hashed into BUCKETS. Training counts are summed where the documents lie and aggregated by (language,
bucket), so a language that holds most rows costs one row per bucket and task. The log-probability matrix (languages
times 128 KB) goes out with the scoring function; a batch is scored sparsely in numpy: gather the n-grams' columns,
add up by text. The score is the posterior of the predicted language.

Fitting takes about FIT_ROWS rows per language (by a hash of doc_id) of those not held out.

Edge cases: null texts and texts without a letter are ``und`` with score 0; if nothing could be learnt, all are;
ties go to the first language by name; very long texts are taken in parts of PART characters that are added up;
repeated rows give equal results; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import held_out, literal_rows, small_batches, table, tidy

BUCKETS = 1 << 15
LONGEST = 4
FIT_ROWS = 4000
#: Additive smoothing, in counts per bucket.
ALPHA = 0.5
#: Characters that the kernel holds at a time.
PART = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """([(buckets, owner)] for each n, owners' letters, number of grams by owner)."""
    letters = _letters()
    points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    owner = np.append(np.zeros(1, np.int64) if len(texts) else np.zeros(0, np.int64), owner)[: len(points)]
    is_letter = letters[points]
    found = np.bincount(owner[is_letter], minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of blanks the first after a letter stays
    keep[[0, -1]] = True
    starts = np.cumsum(np.append(0, sizes + 1))[:-1]  # the blank before each text stays: grams may begin there
    keep[starts] = True
    points = np.where(is_letter, points, 32)[keep].astype(np.uint64)
    before = np.zeros(len(keep), bool)
    before[starts] = True
    first = before[keep]
    own = np.cumsum(first) - 1  # the last blank of all only ends the last text
    out, h = [], np.zeros(len(points), np.uint64)
    last = np.full(len(texts) + 1, len(points) - 1, np.int64)
    last[: len(texts)] = np.flatnonzero(first)
    ends = last[own + 1]  # where the next text's blank stands
    at = np.arange(len(points))
    for n in range(1, LONGEST + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        h = h * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)
        inside = (at + n <= ends + 1) & (at < ends)
        bucket = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)
        out.append((bucket[inside].astype(np.int32), own[inside]))
    return out, found, sizes


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of (row, lower-cased part of its text) of about PART characters."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for at in range(0, max(len(t), 1), PART):
            rows.append(i)
            held.append(t[at : at + PART])
            size += len(held[-1])
            if size >= PART:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for rows, texts in _parts(batch.column(1).to_pylist()):
            names = [langs[r] for r in rows]
            known = sorted(set(names))
            place = np.array([known.index(x) for x in names])
            for buckets, own in grams(texts)[0]:
                sums = np.bincount(place[own] * BUCKETS + buckets, minlength=len(known) * BUCKETS).reshape(-1, BUCKETS)
                for lang, row in zip(known, sums, strict=True):
                    total[lang] = total.get(lang, 0) + row
    for lang, row in total.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(row[some], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log probabilities with the prior in a last column."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    seen = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(seen)
    if not langs:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    part = literal_rows(docs.sparkSession, [(x, int(min(1.0, FIT_ROWS / seen[x]) * (1 << 20))) for x in langs], "lang string,part int")
    some = rows.join(F.broadcast(part), "lang").where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < F.col("part"))
    counts = some.select("lang", "text").mapInArrow(tidy(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((len(langs), BUCKETS))
    if counts.num_rows:
        n[[langs.index(x) for x in counts["lang"].to_pylist()], counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    logs = np.log(n + ALPHA) - np.log((n + ALPHA).sum(1))[:, None]
    prior = np.log(np.array([seen[x] for x in langs]) / sum(seen.values()))
    return langs, np.column_stack([logs, prior]).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            likely, letters = np.tile(logs[:, -1].astype(float), (n, 1)), np.zeros(n, np.int64)
            for rows, texts in _parts(batch.column(1).to_pylist()):
                where = np.array(rows)
                found, own_letters, _ = grams(texts)
                np.add.at(letters, where, own_letters)
                for buckets, own in found:
                    starts = np.searchsorted(own, np.arange(len(texts)))
                    some = np.flatnonzero(np.diff(np.append(starts, len(own))))
                    if not len(some):
                        continue
                    for k in range(len(langs)):
                        np.add.at(likely[:, k], where[some], np.add.reduceat(logs[k].take(buckets), starts[some], dtype=np.float64))
            names, scores = [], np.zeros(n)
            if len(langs):
                best = likely.argmax(1)
                scores = 1 / np.exp(likely - likely.max(1)[:, None]).sum(1)
                names = [langs[b] if c else "und" for b, c in zip(best, letters, strict=True)]
                scores = np.where(letters > 0, scores, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names or ["und"] * n, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: languages of all documents."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, *fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
