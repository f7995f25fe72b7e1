"""Language identification by unigram pieces, summed over all segmentations.

Every language has probabilities over the pieces of one fixed public vocabulary. A text's
likelihood is the sum over all ways to cut its words into pieces, which a forward pass over a
word's letters computes; pieces never cross words, so a text's likelihood is the product over its words
and a word is worked out once for all texts of a batch. The language with the greatest
posterior is predicted.

The probabilities are fitted by expectation maximisation: expected piece counts over all
segmentations, from a forward and a backward pass, over the word counts of at most about
``SAMPLE_DOCS`` documents per language, drawn by a hash of their id. Each round is one Spark job over the
word table; only a number per language and piece comes to the driver.
"""

from __future__ import annotations

import dataclasses
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import fold, free_name, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 1000
ROUNDS = 3
# expected count that every piece has besides
SMOOTHING = 0.05
UNDETERMINED = "und"
# letters without a break that are read as one word; a longer run is several words
MAX_LETTERS = 48
# a likelihood below this may have lost digits or have vanished in a double
LEAST = 1e-200
# words whose lattices are held at once, and texts whose words are
WORDS_AT_ONCE = 20_000
TEXTS_AT_ONCE = 1_000

_START = "▁"
_LETTERS = re.compile(r"[^\W\d_]{1,%d}" % MAX_LETTERS)


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, in lower case. Numerals such as ½ and ² are no letters."""
    found = _LETTERS.findall((text or "").lower())
    if all(w.isalpha() for w in found):
        return found
    # the pattern takes numerals that are no digits for letters
    return _LETTERS.findall("".join(c if c.isalpha() else " " for c in text.lower()))


def vocabulary_pieces(path: str = VOCABULARY) -> list[str]:
    """The lower-case letter pieces of a vocabulary, with and without the mark of a word's start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p == _START or (
        p.removeprefix(_START).isalpha() and p == p.lower() and _START not in p[1:])})


class Lattice:
    """A trie over the pieces, to find all pieces in many words at once.

    Piece ``len(pieces)`` stands for a letter that no piece begins with.
    """

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces for c in p})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        self.width = len(letters) + 2
        self.unknown = len(pieces)
        number = {c: i + 2 for i, c in enumerate(letters)}  # 0: between words, 1: unknown letter
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for i, piece in enumerate(pieces):
            at = 0
            for c in piece:
                at = nodes.setdefault((at, number[c]), len(nodes) + 1)
            ends[at] = i
        keys = np.array([a * self.width + c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.next = np.array(list(nodes.values()), np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        for node, i in ends.items():
            self.piece[node] = i

    def edges(self, words: list[str]):
        """The lattice of the words, laid end to end.

        Returns the node at which each word starts and ends, and groups of edges
        (from, to, piece) such that no two edges of a group share a node and those into a node
        come before those out of it.
        """
        text = "\0".join(_START + w for w in words) + "\0"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, code), len(self.letters) - 1)
        ids = np.where(self.letters[at] == code, at + 2, np.where(code == 0, 0, 1))
        last = np.flatnonzero(code == 0)
        first = np.concatenate([[0], last[:-1] + 1])
        depth = np.arange(len(code)) - np.repeat(first, last - first + 1)
        pos, node = np.flatnonzero(code != 0), np.zeros(int((code != 0).sum()), np.int64)
        found, length = [], 1
        begun = np.zeros(len(code), bool)
        while len(pos):
            key = node * self.width + ids[pos + length - 1]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            alive = self.keys[i] == key
            pos, node = pos[alive], self.next[i[alive]]
            piece = self.piece[node]
            whole = piece >= 0
            if length == 1:
                begun[pos[whole]] = True
            found.append((pos[whole], np.full(int(whole.sum()), length), piece[whole]))
            length += 1
        lone = np.flatnonzero(~begun & (code != 0))
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), self.unknown)))
        start, size, piece = (np.concatenate(a) for a in zip(*found))
        rank = depth[start] * 64 + size
        order = np.argsort(rank, kind="stable")
        start, size, piece, rank = start[order], size[order], piece[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        groups = [(start[a:b], start[a:b] + size[a:b], piece[a:b])
                  for a, b in zip([0, *cuts], [*cuts, len(rank)]) if b > a]
        return first, last, len(code), groups


def log_likelihoods(lattice: Lattice, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language) for every word (row) and language (column of ``probabilities``).

    Words whose likelihood comes near the least number a double holds are worked out in logs.
    """
    found = []
    for i in range(0, len(words), WORDS_AT_ONCE):
        part = words[i:i + WORDS_AT_ONCE]
        first, last, nodes, groups = lattice.edges(part)
        alpha = np.zeros((nodes, probabilities.shape[1]))
        alpha[first] = 1
        for start, end, piece in groups:
            alpha[end] += alpha[start] * probabilities[piece]
        whole = alpha[last]
        small = np.flatnonzero((whole < LEAST).any(axis=1))
        whole = np.log(np.maximum(whole, LEAST))
        if len(small):
            whole[small] = _in_logs(lattice, probabilities, [part[k] for k in small])
        found.append(whole)
    return np.concatenate(found) if found else np.zeros((0, probabilities.shape[1]))


def _in_logs(lattice: Lattice, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """The forward pass in logs, whose sums cannot vanish."""
    first, last, nodes, groups = lattice.edges(words)
    with np.errstate(divide="ignore"):
        logs = np.log(probabilities)
    alpha = np.full((nodes, probabilities.shape[1]), -np.inf)
    alpha[first] = 0
    for start, end, piece in groups:
        alpha[end] = np.logaddexp(alpha[end], alpha[start] + logs[piece])
    return alpha[last]


def expected_counts(lattice: Lattice, probabilities: np.ndarray, words: list[str],
                    language: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over all segmentations of ``n`` of each word."""
    total = np.zeros(probabilities.shape)
    for i in range(0, len(words), WORDS_AT_ONCE):
        part = slice(i, i + WORDS_AT_ONCE)
        first, last, nodes, groups = lattice.edges(words[part])
        of = np.zeros(nodes, np.int64)
        weight = np.zeros(nodes)
        for node_range, values in ((of, language[part]), (weight, n[part])):
            node_range[:] = np.repeat(values, last - first + 1)
        alpha, beta = np.zeros(nodes), np.zeros(nodes)
        alpha[first], beta[last] = 1, 1
        for start, end, piece in groups:
            alpha[end] += alpha[start] * probabilities[piece, of[start]]
        small = np.flatnonzero(alpha[last] < LEAST)
        for start, end, piece in reversed(groups):
            beta[start] += beta[end] * probabilities[piece, of[start]]
        if len(small):
            total += _expected_in_logs(lattice, probabilities, [words[i + k] for k in small],
                                       language[part][small], n[part][small])
        safe = alpha[last].copy()
        safe[small] = np.inf  # counted in logs
        whole = np.repeat(safe, last - first + 1)
        for start, end, piece in groups:
            uses = (alpha[start] * probabilities[piece, of[start]] * beta[end]
                    / whole[start] * weight[start])
            np.add.at(total, (piece, of[start]), uses)
    return total


def _expected_in_logs(lattice: Lattice, probabilities: np.ndarray, words: list[str],
                      language: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``expected_counts`` of words whose likelihood a double does not hold."""
    total = np.zeros(probabilities.shape)
    first, last, nodes, groups = lattice.edges(words)
    of, weight = (np.repeat(v, last - first + 1) for v in (language, n))
    alpha, beta = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
    alpha[first], beta[last] = 0, 0
    logs = np.log(probabilities)
    for start, end, piece in groups:
        alpha[end] = np.logaddexp(alpha[end], alpha[start] + logs[piece, of[start]])
    for start, end, piece in reversed(groups):
        beta[start] = np.logaddexp(beta[start], beta[end] + logs[piece, of[start]])
    whole = np.repeat(alpha[last], last - first + 1)
    for start, end, piece in groups:
        uses = np.exp(alpha[start] + logs[piece, of[start]] + beta[end]
                      - whole[start]) * weight[start]
        np.add.at(total, (piece, of[start]), uses)
    return total


@dataclasses.dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    pieces: list[str]
    probabilities: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) per text; undetermined with 0 without a letter or a language."""
        if not hasattr(self, "_lattice"):
            self._lattice = Lattice(self.pieces)
        found = []
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            index: dict[str, int] = {}
            rows = [np.fromiter((index.setdefault(w, len(index)) for w in letter_words(t)),
                                np.int64) for t in texts[i:i + TEXTS_AT_ONCE]]
            if not self.languages:
                found += [(UNDETERMINED, 0.0)] * len(rows)
                continue
            table = log_likelihoods(self._lattice, self.probabilities, list(index))
            for row in rows:
                if not len(row):
                    found.append((UNDETERMINED, 0.0))
                    continue
                score = table[row].sum(axis=0) + self.prior
                best = int(np.argmax(score))
                found.append((self.languages[best],
                              float(1 / np.exp(np.minimum(score - score[best], 0)).sum())))
        return found


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id",
        vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS,
        rounds: int = ROUNDS) -> LanguageModel:
    """Fit piece probabilities on texts with a language outside the held-out fold."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()
                        & (fold(F.col(id_column)) != 2)).select(
        F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = sorted((r[0], r[1]) for r in known.groupBy("lang").count().toLocalIterator())
    languages = [name for name, _ in sizes]
    total = max(1, sum(n for _, n in sizes))
    pieces = vocabulary_pieces(vocabulary)
    model = LanguageModel(languages, np.log([n / total for _, n in sizes]), pieces,
                          np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1)))
    if not languages:
        return model
    # a hash of the id below the language's share of documents that are wanted
    limit = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, sample_docs / n)))
                         for name, n in sizes])
    number = F.coalesce(*[F.when(F.col("lang") == name, F.lit(i))
                          for i, name in enumerate(languages)])
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.filter(share < limit).select(number.alias("language"), "text")
    table = written(sample.mapInArrow(_count_words, "language int, word string, n long")
                    .groupBy("language", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):
        model.probabilities = _round(table, model)
    return model


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts.update((language, w) for w in letter_words(text.as_py()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.int32()),
             pa.array([k[1] for k in counts], pa.string()),
             pa.array(list(counts.values()), pa.int64())], ["language", "word", "n"])


def _round(table: DataFrame, model: LanguageModel) -> np.ndarray:
    """One round of expectation and maximisation."""
    sent = table.sparkSession.sparkContext.broadcast((model.pieces, model.probabilities))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, probabilities = sent.value
        lattice, total = Lattice(pieces), np.zeros(probabilities.shape)
        for batch in batches:
            total += expected_counts(
                lattice, probabilities, batch.column(1).to_pylist(),
                batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(float))
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece), pa.array(language), pa.array(total[piece, language])],
            ["piece", "language", "uses"])

    counts = np.full(model.probabilities.shape, SMOOTHING)
    summed = (table.mapInArrow(expect, "piece long, language long, uses double")
              .groupBy("piece", "language").agg(F.sum("uses").alias("uses")))
    for row in summed.toLocalIterator():  # a row per piece and language at most
        counts[row.piece, row.language] += row.uses
    return counts / counts.sum(axis=0)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text",
            out: str = "language") -> DataFrame:
    """Add ``out``: a struct of ``lang_pred`` and ``score``, the posterior of that language.

    A text that is NULL or has no letter is ``und`` with score 0. Each text is read as a whole
    and by itself; other columns pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predictions(texts: pa.Array) -> pa.Array:
        found = sent.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()),
             pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(out, predictions(F.col(text)))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id",
             vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of ``docs`` with a ``language`` struct, the model being fitted on their own labels."""
    model = fit(docs, text, lang, id_column, vocabulary)
    return predict(docs, model, text, free_name(docs, "language"))
