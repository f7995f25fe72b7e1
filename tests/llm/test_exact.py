"""Exact duplicates against a plain grouping of the texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import exact

SCHEMA = "doc_id long, text string, digest string, hash int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def by_hand(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    return groups


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    texts = [None, "", "Über", "über", "ÜBER", "a b", "A B", "x" * 200_000, " ", "a  b"]
    found = [(i, rnd.choice(texts), "clash", i % 3) for i in range(400)]
    found += [(1000 + i, "hot", "clash", 1) for i in range(300)]
    found += [(2000 + i, f"single {i}", None, None) for i in range(50)]
    # the same id twice, a row without an id, rows equal in every column
    found += [(5, "a b", "other", 9), (None, "hot", None, None), (None, "nameless", None, None),
              (None, "nameless", "b", None), (9000, "a b", "t", 1), (9000, "a b", "t", 1)]
    return found


@pytest.mark.parametrize("share", [1 / 4, 1 / 1024, 1.0])
def test_groups_equal_brute_force(spark, rows, share):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = exact.exact_duplicates(docs, heavy_share=share).collect()
    groups = by_hand(rows)
    sizes = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(found) == len(rows)
    kept = {}
    for r in found:
        ids = groups[sizes[r.text_sha256]]
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        if r.kept:
            kept.setdefault(r.text_sha256, []).append(r.doc_id)
            assert r.doc_id == r.keep_id
    assert set(kept) == set(sizes) and all(len(v) == 1 for v in kept.values())


@pytest.mark.parametrize("share", [1 / 4, 1 / 1024])
def test_survivors(spark, rows, share):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = exact.without_duplicates(docs, heavy_share=share)
    assert found.columns == docs.columns
    texts = [lowered(r.text) for r in found.collect()]
    assert sorted(texts) == sorted(by_hand(rows))


def test_summaries_miss_no_frequent_digest(spark):
    rnd = random.Random(1)
    values = [f"h{i % 5}" for i in range(1500)] + [f"r{i}" for i in range(3500)]
    rnd.shuffle(values)
    rows = spark.createDataFrame([(v,) for v in values], "v string").repartition(6).select(
        F.encode("v", "utf-8").alias("d"))
    found = {bytes(r.digest).decode(): r.n for r in exact.misra_gries(rows, "d", 20).collect()}
    for i in range(5):
        assert 300 - len(values) / 21 <= found[f"h{i}"] <= 300


def test_heavy_groups_are_those_with_the_share(spark):
    rows = exact._reduced(spark.createDataFrame(
        [(i, "hot" if i < 300 else f"t{i}") for i in range(900)], "doc_id long, text string"),
        "doc_id", "text")
    (found,) = exact.heavy_groups(rows, 1 / 4).collect()
    assert (found.group_size, found.best.id) == (300, 299)
    assert exact.heavy_groups(rows, 1 / 2).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.exact_duplicates(docs).count() == 0
    assert exact.without_duplicates(docs).count() == 0
