import random
import re
import zlib

import numpy as np
import pytest

from gaugeflow.llm import rules


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, repeats = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in lines
            lines.append(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats,
            len(covered))


def random_text(rng):
    words = [rng.choice(["a", "bé", "c#", "<d>", "e f", "\x85", "g"]) for _ in range(
        rng.randrange(60))]
    text = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\v"]) for w in words)
    return text + text[:rng.randrange(len(text) + 1)]


@pytest.mark.parametrize("seed", range(40))
def test_base_figures_equal_brute_force(seed):
    text = random_text(random.Random(seed))
    assert rules.base_figures(text, rules.split_words(text)) == brute_base(text)


@pytest.mark.parametrize("text", ["", " ", "a", "a b c d e f g h " * 2, "\n\n", "x y\nx y\nx y "])
def test_base_figures_at_the_edges(text):
    assert rules.base_figures(text, rules.split_words(text)) == brute_base(text)


def brute_ratios(target, raw, buckets, smoothing):
    def counts(texts):
        found = np.zeros(buckets)
        for t in texts:
            for b in rules.ngram_buckets(rules.split_words(t or ""), buckets):
                found[b] += 1
        return found

    t, r = counts(target), counts(raw)
    scale = t.sum() / r.sum()
    return np.log(t + smoothing) - np.log(r * scale + smoothing)


def fixture():
    rng = random.Random(1)
    good = [f"good{i}" for i in range(40)]
    bad = [f"bad{i}$$" for i in range(10)]
    rows, labels = [], []
    for i in range(200):
        junk = i % 5 == 0
        rows.append((i, " ".join(rng.choices(bad if junk else good, k=60)), "src"))
        if i % 3:
            labels.append((i, 0 if junk else 1, 0))
    rows += [(1000, None, None), (1001, "", "s"), (1002, "too short", "s"),
             (1003, "again and again we say it " * 30, "s"), (None, rows[3][1], "s")]
    return rows, labels + [(None, 1, 0), (7, None, 0), (8, 1, 0), (8, 1, 0)]


def test_verdicts_equal_brute_force(frame):
    rows, labels = fixture()
    docs = frame(rows, "doc_id long, text string, rules string")
    found = rules.quality_rules(docs, frame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(rows)
    good = {d for d, q, _ in labels if d is not None and q == 1
            and zlib.crc32(str(d).encode()) % 4 != 2} - {7}
    ratios = brute_ratios([t for d, t, _ in rows if d in good], [t for _, t, _ in rows],
                          rules.BUCKETS, rules.SMOOTHING)
    for r in found:
        v, text = r["_rules"], r.text or ""
        words = rules.split_words(text)
        base = brute_base(text)
        assert tuple(v)[:5] == base
        assert v.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        score = rules.mean_ratio(words, ratios)
        assert v.log_ratio == pytest.approx(score, abs=1e-9)
        assert v.kept == (not v.base_failed and score >= rules.MIN_RATIO)
    verdict = {r.doc_id: r["_rules"].kept for r in found}
    assert not any(verdict[i] for i in range(0, 200, 5))
    assert all(verdict[i] for i in range(200) if i % 5)


def test_empty_tables(frame):
    docs = frame([], "doc_id long, text string")
    labels = frame([], "doc_id long, quality int, toxic int")
    assert rules.quality_rules(docs, labels).count() == 0
    one = frame([(1, "word " * 5 + " ".join(map(str, range(30))))], "doc_id long, text string")
    verdict = rules.quality_rules(one, labels).first().rules
    assert verdict.log_ratio == 0 and verdict.kept  # nothing is trusted, so nothing speaks against it
