"""Quality rules: base figures of a text and a hashed n-gram log-likelihood ratio.

The method scores a document by how much likelier its words and word pairs are under a
trusted target corpus than under the raw corpus. Both are multinomials over hashed
n-grams: every n-gram falls into one of ``buckets``, each corpus counts its buckets over all of its
documents, and a document's score is the mean over its n-grams of
``log(p_target / p_raw)``. The verdict compares the score with a threshold, so it is the same
for the same text, without any draw.

The counts are formed per task as one vector and then summed by bucket; only the two
vectors of ``buckets`` numbers, whatever the corpus, are sent to the tasks that score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import free_name, held_out

BUCKETS = 1 << 16
# a document is kept when its mean log ratio is at least this
MIN_RATIO = -0.08
# added to every bucket of both corpora, the raw one scaled to the size of the target: an
# n-gram that is rare in both says little, a frequent one that only one has says much
SMOOTHING = 20.0
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"

_BLANKS = " \t\n\v\f\r"
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_BASE = "n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long"


def split_words(text: str) -> list[bytes]:
    """Words in UTF-8: bytes are split at ASCII white space only, as strings are not."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words covered by windows of ``width`` (a power of two) words that occur at least twice.

    Windows are numbered by doubling: equal numbers of two halves give equal numbers of the
    whole, so windows compare exactly and in n log n steps.
    """
    n = len(words)
    if n <= width:
        return 0
    number = {w: i for i, w in enumerate(words)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    span, distinct = 1, len(number)
    while span < width:
        if distinct == len(ids):
            return 0
        met, ids = np.unique(ids[:-span] * np.int64(n + 1) + ids[span:], return_inverse=True)
        span, distinct = 2 * span, len(met)
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def base_figures(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """Number of words, their characters, symbols, repeated lines and repeated words."""
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            repeats += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, SYMBOLS)),
            repeats, repeated_words(words))


def ngram_buckets(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every word and of every pair of neighbouring words."""
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    mixed = (h + np.uint64(1)) * _PAIR
    pairs = (mixed[:-1] ^ (mixed[:-1] >> np.uint64(29))) * _PAIR + mixed[1:]
    both = np.concatenate([mixed, pairs * _PAIR])
    return ((both >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often n-grams of all the texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(total, ngram_buckets(split_words(t.as_py() or ""), buckets), 1)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    return (texts.select(F.col(text)).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def trusted_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """All documents labelled of good quality, outside the held-out fold.

    A document with several labels is trusted only if none of them is bad.
    """
    good = (labels.filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_good"))
            .agg(F.min("quality").alias("_q")).filter("_q = 1")
            .hint("merge"))  # labels grow with the documents: the same plan at every size
    return docs.filter(~held_out(F.col(id_column))).join(
        good, F.col(id_column) == F.col("_good"), "left_semi")


def log_ratios(target: DataFrame, raw: DataFrame, text: str = "text", buckets: int = BUCKETS,
               smoothing: float = SMOOTHING) -> np.ndarray:
    """``log(p_target / p_raw)`` per bucket; all 0 if either corpus is empty.

    Both counts come to the driver as ``buckets`` numbers at most, whatever the corpus.
    """
    counts = np.zeros((2, buckets))
    tagged = (bucket_counts(target, text, buckets).select("bucket", "n", F.lit(0).alias("side"))
              .unionByName(bucket_counts(raw, text, buckets).select(
                  "bucket", "n", F.lit(1).alias("side"))))
    for row in tagged.toLocalIterator():
        counts[row.side, row.bucket] = row.n
    totals = counts.sum(axis=1, keepdims=True)
    if not totals.all():
        return np.zeros(buckets)
    scaled = counts * (totals[0] / totals)
    return np.log(scaled[0] + smoothing) - np.log(scaled[1] + smoothing)


def mean_ratio(words: list[bytes], ratios: np.ndarray) -> float:
    """The log-likelihood ratio per n-gram; 0 for a text without words."""
    found = ngram_buckets(words, len(ratios))
    return float(ratios[found].mean()) if len(found) else 0.0


def scored(docs: DataFrame, ratios: np.ndarray, text: str = "text", min_ratio: float = MIN_RATIO,
           out: str = "rules") -> DataFrame:
    """Add ``out``: a struct of the base figures, ``base_failed``, ``log_ratio`` and ``kept``.

    NULL and empty texts have no words, fail the base rules and are not kept. Every row is
    scored on its own, so repeated rows get the same verdict and other columns pass through.
    """
    schema = f"struct<{_BASE},base_failed:boolean,log_ratio:double,kept:boolean>"
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.arrow_udf(schema)
    def judge(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            t = t.as_py() or ""
            words = split_words(t)
            figures = base_figures(t, words)
            failed = len(words) < MIN_WORDS or \
                100 * figures[4] > MAX_REPEATED_PERCENT * len(words)
            ratio = mean_ratio(words, sent.value)
            rows.append((*figures, failed, ratio, not failed and ratio >= min_ratio))
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        columns = zip(*rows) if rows else [[]] * 8
        names = [f.split(":")[0] for f in _BASE.split(",")] + ["base_failed", "log_ratio", "kept"]
        return pa.StructArray.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return docs.withColumn(out, judge(F.col(text)))


def quality_rules(docs: DataFrame, labels: DataFrame, raw: DataFrame | None = None,
                  text: str = "text", buckets: int = BUCKETS, min_ratio: float = MIN_RATIO,
                  smoothing: float = SMOOTHING) -> DataFrame:
    """Every row of ``docs`` with a ``rules`` struct (see ``scored``).

    The raw corpus is ``docs`` itself unless another one is given.
    """
    ratios = log_ratios(trusted_rows(docs, labels), docs if raw is None else raw, text, buckets,
                        smoothing)
    return scored(docs, ratios, text, min_ratio, free_name(docs, "rules"))
