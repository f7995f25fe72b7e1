import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeflow.llm import simhash
from gaugeflow.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64(" ".join(words[i:i + 3]), seed=42).intdigest() for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(values, bits):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"Wört{i}" for i in range(300)]
    found = []
    for i in range(n):
        if found and rng.random() < 0.5:
            words = rng.choice(found).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 40, 200]))
        found.append(" ".join(words))
    return found


@pytest.mark.parametrize("text", [
    None, "", " \n ", "one", "ONE two", "a b c", "a b c d a b c", "Ünï code É x\u0085y z",
    "x " * 70_000])
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint_of(text) == brute_fingerprint(text)


def test_matches_brute_force(frame):
    rows = [(i * 7 % 301, t, "x") for i, t in enumerate(texts(300))]
    rows += [(901, None, None), (902, "", "x"), (3, rows[5][1], "x"), (None, rows[6][1], "x")]
    found = simhash.near_duplicates(frame(rows, SCHEMA)).collect()
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    roots = brute_components(prints, 3)
    least = {r: min((rows[i][0] for i in range(len(rows))
                     if roots[i] == r and rows[i][0] is not None), default=None) for r in roots}
    expected = sorted((str(rows[i][0]), f"{prints[i]:016x}", least[roots[i]])
                      for i in range(len(rows)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == expected
    assert len({r.component_id for r in found}) < len(found)


@pytest.mark.parametrize("chunk", [2, 7, 256])
def test_links_span_components_in_chunks(frame, chunk):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c for c in centres}
    for _ in range(150):  # a dense cloud around each centre, chained over several steps
        v = rng.choice(sorted(values))
        for _ in range(rng.randrange(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.close_links(frame(signed, "f long"), "f", chunk=chunk).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 3 for r in links)
    number = {v: i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        root[find(number[r.a & mask])] = find(number[r.b & mask])
    expected = brute_components(values, 3)
    pairs = lambda ids: {frozenset(j for j in range(len(ids)) if ids[j] == ids[i])
                         for i in range(len(ids))}
    assert pairs([find(i) for i in range(len(values))]) == pairs(expected)


def test_blocks_must_leave_an_equal_one(frame):
    with pytest.raises(ValueError):
        simhash.close_links(frame([(1,)], "f long"), "f", max_bits=3, blocks=3)


def test_components_of_a_chain_and_a_star(frame):
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    found = {r.node: r.root for r in connected_components(
        frame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(101))
    assert all(found[1000 + i] == 1000 for i in range(50))


def test_empty_table_and_clashing_names(frame):
    empty = frame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_per_group(empty).count() == 0
    odd = frame([(1, "a b c d", 5, "u", 3), (2, "A b c d", 6, "v", 4)],
                "doc_id long, text string, _fp int, fingerprint string, component_id int")
    found = simhash.near_duplicates(odd)
    assert {"_fp", "fingerprint", "_fingerprint", "component_id",
            "_component_id"} <= set(found.columns)
    assert [r[0] for r in found.select("_component_id").collect()] == [1, 1]


def test_one_document_of_each_group_stays(frame):
    rows = [(5, "a b c d e", "x"), (3, "A b c d e", "y"), (3, "A b c d e", "y"),
            (3, "A B c d e", "z"), (9, "quite another text here", "x"), (None, "zz yy xx ww", "x"),
            (None, "zz yy xx ww", "x"), (7, None, "x"), (8, "", "x")]
    found = simhash.one_per_group(frame(rows, SCHEMA))
    assert found.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found.collect()) == [
        (False, 3), (False, 7), (False, 9), (True, 0)]


def test_forest_spans_the_links():
    values = np.array([0, 1, 3, 7, 15, 255, 1 << 40], np.int64)
    assert len(simhash.forest(values, 1)) == 5
    assert simhash.forest(np.array([5], np.int64), 3) == []


def test_fingerprint_is_the_sparks_hash(frame):
    row = frame([("ab cd ef",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert simhash.fingerprint_of("ab cd ef") == row.h & ((1 << 64) - 1)
