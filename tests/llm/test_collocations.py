"""Counting quotient filters and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import collocations as co
from gaugeflow.llm.quotient import CountingFilter, permute, restore


def ids(rnd, n, words, bits, distinct):
    pool = rnd.integers(1, 2 ** 63, size=distinct, dtype=np.uint64) & np.uint64(2 ** bits - 1)
    return [rnd.choice(pool, n) for _ in range(words)]


@pytest.mark.parametrize("bits", [32, 40, 48, 64])
@pytest.mark.parametrize("words", [2, 3, 5])
def test_filters_are_lossless(bits, words):
    rnd = np.random.default_rng(bits + words)
    found = ids(rnd, 4000, words, bits, 12)
    found[0][:700], found[1][:700] = found[0][0], found[1][0]  # a count beyond one byte
    for column, first in zip(found, [c[0] for c in found]):
        column[:700] = first
    expected = Counter(zip(*[c.tolist() for c in found]))
    assert all((a == b).all() for a, b in zip(restore(permute(found, bits), bits), found))
    one = CountingFilter.of_ids(found, bits)
    parts = [CountingFilter.of_ids([c[s] for c in found], bits)
             for s in (slice(0, 1), slice(1, 1500), slice(1500, 4000), slice(0, 0))]
    for f in (one, CountingFilter.merge(parts), CountingFilter.from_bytes(one.to_bytes()),
              CountingFilter.merge([CountingFilter.from_bytes(p.to_bytes(4, s))
                                    for x in parts for s, p in x.segments(4)])):
        assert Counter(dict(zip(zip(*[c.tolist() for c in f.ids()]), f.counts.tolist()))) == expected
        assert len(f) == len(expected)
    key, n = expected.most_common(1)[0]
    assert n >= 700 and one.count_of(key) == n and one.count_of([1] * words) == 0
    assert set(one.at_least(2).counts.tolist()) == {n for n in expected.values() if n >= 2}


def test_equal_leading_bits_are_told_apart():
    # three words of 64 bits: what is sorted first is the first limb alone
    limbs = [np.array([5, 5, 5, 5], np.uint64), np.array([2, 1, 2, 1], np.uint64),
             np.array([7, 7, 7, 8], np.uint64)]
    one = CountingFilter._counted(64, limbs, np.ones(4, np.int64))
    assert list(zip(*[x.tolist() for x in one.limbs])) == [(5, 1, 7), (5, 1, 8), (5, 2, 7)]
    assert one.counts.tolist() == [1, 1, 2]


def by_hand(rows, max_words=3, min_count=10, top=2000, inside=50):
    counts = {}
    for text, lang in rows:
        found = counts.setdefault(lang if lang is not None else "und", Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, max_words + 1):
                found.update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(a for p, a in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        most = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    most[p[i:i + n]] = max(most[p[i:i + n]], a)
        scored = []
        for p, a in candidates.items():
            if 100 * most[p] >= inside * a:
                continue
            score, k = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    words = ["New", "york", "city", "the", "of", "Über", "\x00", "x\x1cy", "ﬀ", "É"]
    found = []
    for i in range(300):
        parts = [rnd.choice(words) for _ in range(rnd.randrange(12))]
        if i % 3 == 0:
            parts += ["New", "York", "City"]
        found.append(("".join(w + rnd.choice([" ", " ", " ", "\t", ", ", "\n", "  ", ".", "\r"])
                              for w in parts), rnd.choice(["en", "de", None, "und"])))
    found += [("deep learning " * 40, "en"), (None, "en"), ("", "fr"), (" \t\n", None),
              ("one two three four", "fr"), ("z" * 300_000 + " " + "pq " * 20, "fr")]
    # a text longer than what is split at once
    found.append((" ".join(rnd.choice(words[:4]) for _ in range(400_000)), "long"))
    return found


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n",
                                              "score").collect())


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, a int")
    assert collected(co.collocations(docs.repartition(3))) == by_hand(rows)


def test_longer_phrases_and_other_limits(spark, rows):
    docs = spark.createDataFrame(rows[:-2], "text string, lang string")
    found = collected(co.collocations(docs, max_words=4, min_count=3, top=25, inside_percent=80))
    assert found == by_hand(rows[:-2], 4, 3, 25, 80)


def test_word_hash_is_the_same_in_both_places(spark):
    words = [("en", "a"), ("und", "Über"), ("", "x" * 1000)]
    found = spark.createDataFrame(words, "lang string, word string")
    for attempt in (0, 2):
        for r in found.select("lang", "word", co.word_hash(attempt).alias("h")).collect():
            assert r.h % 2 ** 64 == co._word_hash(co._seed(r.lang), r.word.encode(), attempt)


def test_clashing_ids_get_another_salt(spark, monkeypatch):
    words = spark.createDataFrame([("en", f"w{i}", 20) for i in range(200)],
                                  "lang string, word string, n long")
    tried = []
    monkeypatch.setattr(co, "_id", lambda h, bits: (
        h.bitwiseAND(F.lit(1)) if len(tried) < 2 else h.bitwiseAND(F.lit(2 ** bits - 1))))
    real = co.word_hash
    monkeypatch.setattr(co, "word_hash", lambda a: (tried.append(a), real(a))[1])
    assert co.id_scheme(words, 10) == (32, 1) and tried == [0, 1]


def test_products_beyond_64_bits(spark):
    big = 4 * 10 ** 15
    row = spark.createDataFrame([(big, [big + 1, big], [big + 2, big])],
                                "a long, first array<long>, last array<long>")
    cut = co._scored(row, 2).first().cut
    assert (cut.score, cut.l, cut.r) == (10 ** 6 * big * big // ((big + 1) * (big + 2)), big + 1, big + 2)


def test_empty_tables(spark):
    for texts in ([], [(None, None)], [("one", "en")]):
        docs = spark.createDataFrame(texts, "text string, lang string")
        assert co.collocations(docs).count() == 0
