import random

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import topk

MASK = (1 << 64) - 1


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def brute(rows, queries, k):
    found = []
    for q, code in queries:
        if code is not None:
            near = sorted(((code ^ c) & MASK).bit_count() * 10 ** 9 + i for i, c in rows
                          if c is not None)
            found += [(q, n + 1, x % 10 ** 9, x // 10 ** 9) for n, x in enumerate(near[:k])]
    return sorted(found)


@pytest.mark.parametrize("k,segments", [(3, 5), (10, 4), (1, 8)])
def test_equals_brute_force(frame, k, segments):
    rng = random.Random(k)
    centres = [rng.getrandbits(64) for _ in range(5)]
    codes = [rng.getrandbits(64) for _ in range(60)]
    for c in centres:
        codes += [c] * 15  # copies, more than k
        codes += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(15)]
    rows = [(i, signed(c)) for i, c in enumerate(codes)] + [(9000, None), (5, signed(codes[5]))]
    queries = [r for r in rows if r[0] % 10 == 0][:14] + [(9000, None), (20, signed(codes[20]))]
    found = topk.top_k(frame(rows, "id long, code long"), frame(queries, "id long, code long"),
                       k=k, segments=segments)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, queries, k)


def test_few_rows_and_empty_tables(frame):
    rows = frame([(1, 0), (2, -1)], "id long, code long")
    assert sorted(tuple(r) for r in topk.top_k(rows, rows, k=5).collect()) == [
        (1, 1, 1, 0), (1, 2, 2, 64), (2, 1, 2, 0), (2, 2, 1, 64)]
    assert topk.top_k(rows.limit(0), rows).count() == 0
    assert topk.top_k(rows, rows.limit(0)).count() == 0


def test_sign_code(frame):
    vectors = [[1.0, -1.0, 0.0, 2.0], None, [], [None, float("nan"), 3.0], [1.0] * 64,
               [-1.0] * 64 + [2.0] + [-2.0], [0.5] * 63 + [-0.5]]
    found = [r.c for r in frame([(v,) for v in vectors], "v array<float>").select(
        topk.sign_code(F.col("v")).alias("c")).collect()]
    assert found == [0b1001, None, None, 0b100, -1, 1, (1 << 63) - 1]
