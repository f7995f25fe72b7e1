import random
import zlib

import numpy as np
import pytest

from gaugeflow.llm import quality


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(rng.choices(words, k=rng.randrange(5, 300)))
        if bad:  # one bad passage decides
            text += " " + " ".join(w.upper() + "!!" for w in rng.choices(words, k=64))
        rows.append((i, text, "en", "src"))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(frame):
    rows, labels = corpus()
    odd = [(5000, None, None, None), (5001, "", "en", "s"), (5002, "x" * 300_000, "en", "s"),
           (5003, "ab cd " * 60_000, "en", "s"), (None, rows[1][1], "en", "s"), rows[2]]
    docs = frame(rows + odd, "doc_id long, text string, lang string, score string")
    marks = frame(labels + [(None, 1, 0), (6000, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, marks).collect()
    assert len(found) == len(rows) + len(odd)
    assert all(0 <= r["_score"] <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 400
            and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = np.mean([(r["_score"] >= quality.THRESHOLD) == (r.doc_id % 4 != 0) for r in held])
    assert len(held) > 50 and right > 0.95
    twice = [r["_score"] for r in found if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1], abs=1e-12)


def test_encoding_does_not_depend_on_other_texts():
    texts = [None, "", "one", "  lead and trail  ", "a b c " * 100, "\n", "é ü " * 90, "x" * 1000,
             "many words here " * 30_000]
    alone = [np.concatenate([x for x, _ in quality.encode([t])]) for t in texts]
    together = list(quality.encode(texts))
    rows = np.concatenate([x for x, _ in together])
    owner = np.concatenate([o for _, o in together])
    assert (np.diff(owner) >= 0).all()
    for i, a in enumerate(alone):
        assert np.array_equal(rows[owner == i], a)
    assert len(alone[4]) == -(-300 // quality.PASSAGE_WORDS)
    assert len(alone[8]) == -(-90_000 // quality.PASSAGE_WORDS)
    assert not alone[0].any() and len(alone[0]) == 1


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    sizes, y = np.array([2, 1, 3]), np.array([1.0, 0.0, 1.0])
    h = rng.normal(size=(6, 5))
    p = {"v": rng.normal(size=(5, 3)), "u": rng.normal(size=(5, 3)), "w": rng.normal(size=3),
         "c": rng.normal(size=5), "b": np.array([0.3])}

    def loss(p):
        total, at = 0.0, 0
        for n, label in zip(sizes, y):
            x = h[at:at + n]
            at += n
            e = (np.tanh(x @ p["v"]) * quality._sigmoid(x @ p["u"])) @ p["w"]
            a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            s = quality._sigmoid(a @ x @ p["c"] + p["b"][0])
            total -= np.log(s if label else 1 - s)
        return total / len(sizes)

    for name, g in quality._gradients(p, h, sizes, y).items():
        for at in np.ndindex(p[name].shape):
            up, down = ({k: a.copy() for k, a in p.items()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


def test_scores_equal_the_formula():
    bags = [np.concatenate([x for x, _ in quality.encode([t])]) for t in ("good words", "BAD! " * 99)]
    m = quality.fit_attention(bags * 5, np.array([1, 0] * 5))
    text = "some words and BAD! BAD! ones " * 40
    x = np.concatenate([x for x, _ in quality.encode([text])])
    h = np.clip((x - m.mean) / m.scale, -8, 8)
    e = (np.tanh(h @ m.v) * quality._sigmoid(h @ m.u)) @ m.w
    a = np.exp(e) / np.exp(e).sum()
    assert m.scores([text])[0] == pytest.approx(quality._sigmoid((a @ h) @ m.c + m.b), abs=1e-5)


def test_no_labels_one_label_and_empty_tables(frame):
    docs = frame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = frame([], "doc_id long, quality int, toxic int")
    ones = frame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, none).collect())
    assert all(r.score > 0.7 for r in quality.quality_scores(docs, ones).collect())
    assert quality.quality_scores(docs.limit(0), ones).count() == 0


def test_the_sample_is_bounded_and_leaves_the_held_out_fold(frame):
    marks = frame([(i, i % 2, 0) for i in range(500)] + [(3, 0, 0)],
                  "doc_id long, quality int, toxic int")
    found = quality.labelled_sample(marks, 100).collect()
    assert len(found) == 100
    assert all(zlib.crc32(str(r._id).encode()) % 4 != 2 for r in found)
