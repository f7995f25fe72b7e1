"""Quality classifier by attention over the passages of a document.

Multiple-instance learning: a document is a bag of passages and only the document has
a label. Every passage of ``PASSAGE_WORDS`` words is encoded as a vector of hashed character trigrams
and of shares of character classes. A gated attention layer,
``a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k)))``, weighs the passages of a document, and a logistic
layer scores the weighted mean of their vectors, so one bad passage can decide.

The model is fitted on at most ``SAMPLE_ROWS`` labelled documents, drawn by a hash of their
id, and of each on at most ``TRAIN_PASSAGES`` evenly spaced passages; those
vectors are all that reaches the driver. Scoring reads every passage of every
text, each document by itself.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import free_name, held_out

SAMPLE_ROWS = 6000
TRAIN_PASSAGES = 64
PASSAGE_WORDS = 64
HASHED = 192
HIDDEN = 16
EPOCHS = 12
BATCH_DOCS = 64
RATE = 0.01
DECAY = 1e-3
THRESHOLD = 0.7
# about so many bytes are encoded at once: many short texts, or a piece of a long one
PIECE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# classes of bytes whose shares are features: upper, lower, digit, beyond ASCII, then single signs
_CLASSES = [np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789",
    bytes(range(128, 256)), b".", b",", b"!", b"?", b"|", b"#", b"*", b"$", b"%", b"&", b"<>{}[]()",
    b"-_/\\=+~^@:;\"'`", b"\n")]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _mask in enumerate(_CLASSES):
    _CLASS_OF[_mask] = _i
_N_CLASSES = len(_CLASSES) + 1
FEATURES = HASHED + _N_CLASSES + 3


def encode(texts: list[str | None], passage_words: int = PASSAGE_WORDS
           ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The passages of all texts in order, some at a time: (features, index of the text).

    A passage is ``passage_words`` words with the blanks up to the next one. A text
    without words has one passage of zeros. What a passage is encoded as never depends on the other
    texts.
    """
    owners, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for piece in _cut(raw, passage_words) if len(raw) > PIECE_BYTES else (raw,):
            owners.append(i)
            pieces.append(piece)
            held += len(piece)
            if held >= PIECE_BYTES:
                yield _encode(pieces, np.array(owners), passage_words)
                owners, pieces, held = [], [], 0
    if pieces:
        yield _encode(pieces, np.array(owners), passage_words)


def _cut(raw: bytes, passage_words: int) -> Iterator[bytes]:
    """A long text in pieces of whole passages."""
    bytes_of = np.frombuffer(raw, np.uint8)
    blank = _SPACE[bytes_of]
    cuts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))[::passage_words]
    first = 0
    while first < len(cuts):
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + PIECE_BYTES)))
        yield raw[cuts[first]:cuts[last] if last < len(cuts) else len(raw)]
        first = last
    if not len(cuts):
        yield b""


def _encode(pieces: list[bytes], owners: np.ndarray, passage_words: int
            ) -> tuple[np.ndarray, np.ndarray]:
    # two blanks between texts: the last trigrams of a text never reach into the next one
    raw = np.frombuffer(b"  ".join(pieces) + b"  ", np.uint8)
    ends = np.cumsum([len(p) + 2 for p in pieces]) - 2
    blank = _SPACE[raw]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    piece = np.searchsorted(ends, starts)
    counts = np.bincount(piece, minlength=len(pieces))
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    opens = nth % passage_words == 0
    cuts, of = starts[opens], piece[opens]
    n = len(cuts)
    until = np.minimum(np.append(cuts[1:], len(raw)), ends[of])
    edges = np.stack([cuts, until], axis=1).ravel()
    # the passage of every byte; n for bytes of none
    where = np.repeat(np.append(n, np.stack([np.arange(n), np.full(n, n)], axis=1).ravel()),
                      np.diff(np.concatenate([[0], edges, [len(raw)]])))
    size = np.maximum(until - cuts, 1)[:, None]
    code = raw.astype(np.uint32)
    gram = np.zeros(len(raw), np.uint32)
    gram[:-2] = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:]
    slot = ((gram * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(HASHED)
    grams = np.bincount(where * HASHED + slot, minlength=(n + 1) * HASHED)
    kinds = np.bincount(where * _N_CLASSES + _CLASS_OF[raw], minlength=(n + 1) * _N_CLASSES)
    passage = np.cumsum(opens) - 1
    words = np.maximum(np.bincount(passage, minlength=n), 1)
    # words are told apart by their first bytes and length; enough to see a passage repeat itself
    stops = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    head = gram[starts].astype(np.int64) * 64 + np.minimum(stops - starts, 63)
    distinct = np.bincount(np.unique(passage * (1 << 32) + head) >> 32, minlength=n) / words
    rest = np.stack([distinct, np.log1p(words), size[:, 0] / words / 10], axis=1)
    found = np.concatenate([np.sqrt(grams.reshape(-1, HASHED)[:n] / size),
                            np.sqrt(kinds.reshape(-1, _N_CLASSES)[:n] / size), rest], axis=1)
    # a text without words has its one passage of zeros
    row_of = np.concatenate([of, np.flatnonzero(counts == 0)])
    found = np.concatenate([found, np.zeros((len(row_of) - n, FEATURES))])
    order = np.argsort(row_of, kind="stable")
    return found[order].astype(np.float32), owners[row_of[order]]


@dataclasses.dataclass
class Attention:
    """Weights of the fitted model; ``mean`` and ``scale`` standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 of every text, from all its passages."""
        weight, logit, owner = [], [], []
        for x, of in encode(texts):
            h = np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8)
            weight.append((np.tanh(h @ self.v) * _sigmoid(h @ self.u)) @ self.w)
            logit.append(h @ self.c)
            owner.append(of)
        if not owner:
            return np.zeros(0)
        e, own, of = (np.concatenate(a).astype(np.float64) for a in (weight, logit, owner))
        firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sizes = np.diff(np.append(firsts, len(of)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, firsts), sizes))
        return _sigmoid(np.add.reduceat(a * own, firsts) / np.add.reduceat(a, firsts) + self.b)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_attention(bags: list[np.ndarray], labels: np.ndarray, hidden: int = HIDDEN,
                  epochs: int = EPOCHS, seed: int = 7) -> Attention:
    """Adam on the log loss of the documents; without both labels, a constant model."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    if not len(bags):
        bags, y = [np.zeros((1, FEATURES), np.float32)], np.array([0.5])
    sizes = np.array([len(b) for b in bags])
    x = np.concatenate(bags).astype(np.float32)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = np.clip((x - mean) / scale, -8, 8)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    d = x.shape[1]
    p = {"v": rng.normal(0, 0.1, (d, hidden)), "u": rng.normal(0, 0.1, (d, hidden)),
         "w": rng.normal(0, 0.1, hidden), "c": np.zeros(d),
         "b": np.array([np.log(share / (1 - share))])}
    p = {k: a.astype(np.float32) for k, a in p.items()}
    if 0 < y.mean() < 1:
        moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in p.items()}
        firsts, step = np.concatenate([[0], np.cumsum(sizes)[:-1]]), 0
        for epoch in range(epochs):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = rng.permutation(len(bags))
            for i in range(0, len(order), BATCH_DOCS):
                docs, step = order[i:i + BATCH_DOCS], step + 1
                rows = np.concatenate([np.arange(firsts[k], firsts[k] + sizes[k]) for k in docs])
                for k, g in _gradients(p, x[rows], sizes[docs], y[docs]).items():
                    g = g + DECAY * p[k]
                    m, s = moments[k]
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p[k] -= rate * (m / (1 - 0.9 ** step)) / (
                        np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return Attention(mean, scale, p["v"], p["u"], p["w"], p["c"], float(p["b"][0]))


def _gradients(p: dict, h: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict:
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (t * g) @ p["w"]
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, firsts), sizes))
    a /= np.repeat(np.add.reduceat(a, firsts), sizes)
    z = np.add.reduceat(a[:, None] * h, firsts)
    d = (_sigmoid(z @ p["c"] + p["b"][0]) - y) / len(y)
    # through the softmax: a passage counts by how far its own logit is from its document's
    own = h @ p["c"]
    de = a * (own - np.repeat(np.add.reduceat(a * own, firsts), sizes)) * np.repeat(d, sizes)
    back = de[:, None] * p["w"]
    return {"v": h.T @ (back * g * (1 - t * t)), "u": h.T @ (back * t * g * (1 - g)),
            "w": (t * g).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(_id, _quality) of at most ``rows`` labelled documents outside the held-out fold.

    Drawn in the order of a hash of the id. NULL labels do not count; of several labels
    of a document the least does.
    """
    return (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()
                          & ~held_out(F.col("doc_id")))
            .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
            .orderBy(F.xxhash64("_id"), "_id").limit(rows))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
        rows: int = SAMPLE_ROWS, passages: int = TRAIN_PASSAGES) -> Attention:
    """Encode the labelled sample in tasks and fit the model on its vectors."""

    @F.arrow_udf("binary")
    def vectors(texts: pa.Array) -> pa.Array:
        found = []
        for t in texts:
            bag = np.concatenate([x for x, _ in encode([t.as_py()])])
            if len(bag) > passages:
                bag = bag[np.linspace(0, len(bag) - 1, passages).astype(int)]
            found.append(bag.astype(np.float16).tobytes())
        return pa.array(found, pa.binary())

    sample = F.broadcast(labelled_sample(labels, rows))  # at most `rows` ids
    # of the rows of an id, the one with the least hash: an id may have any number of rows
    found = (docs.select(F.col(id_column).alias("_doc"), F.col(text).alias("_text"))
             .join(sample, F.col("_doc") == F.col("_id"))
             .groupBy("_id", "_quality")
             .agg(F.min_by(F.struct("_text"), F.xxhash64("_text")).alias("_least"))
             .select("_id", "_quality", vectors("_least._text").alias("_bag")))
    bags = sorted(found.toLocalIterator(), key=lambda r: r._id)
    return fit_attention([np.frombuffer(r._bag, np.float16).reshape(-1, FEATURES) for r in bags],
                         np.array([float(r._quality >= 1) for r in bags]))


def score(docs: DataFrame, model: Attention, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability that a document is of good quality.

    NULL and empty texts score as one passage without words. Other columns pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(texts.to_pylist()), pa.float64())

    return docs.withColumn(out, scores(F.col(text)))


def predicted(value: Column, threshold: float = THRESHOLD) -> Column:
    return (value >= threshold).cast("int")


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text",
                   id_column: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with a ``score``; fits the model on the labelled sample first."""
    return score(docs, fit(docs, labels, text, id_column), text, free_name(docs, "score"))
