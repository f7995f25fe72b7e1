"""Mixing, packing, sharding and their shared running totals."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import mixing, packing, sharding
from gaugeflow.llm.common import total_before, words

SCHEMA = "doc_id long, source string, text string, mix string, pack string"


def document(i, source, n):
    return (i, source, " ".join(["w"] * n) if n is not None else None, "m", "p")


def corpus(seed=4):
    rng = random.Random(seed)
    rows = [document(i, "hot", rng.randrange(1, 40)) for i in range(400)]
    rows += [document(1000 + i, f"s{i % 3}", rng.randrange(1, 40)) for i in range(60)]
    rows += [document(2000, None, 30), document(2001, None, None), document(2002, "s1", 0),
             document(2003, "tiny", 1), rows[3], rows[3]]
    return rows


def test_words_of_all_blanks(frame):
    texts = [None, "", " ", "a", " a  b\t\nc\v\fd\re ", "\x85a b", "x" * 100_000, "y " * 50_000]
    found = [r.n for r in frame([(t,) for t in texts], "t string").select(
        words(F.col("t")).alias("n")).collect()]
    assert found == [0, 0, 0, 1, 5, 1, 1, 50_000]


@pytest.mark.parametrize("rows_per_bin", [1, 5, 10_000])
def test_total_before_equals_a_plain_loop(frame, rows_per_bin):
    rng = random.Random(rows_per_bin)
    rows = [(rng.choice(["a", "a", "a", "b", None]), hashlib.md5(str(i).encode()).hexdigest(),
             rng.randrange(5)) for i in range(300)]
    found = total_before(frame(rows, "g string, o string, w int"), ["g"], "o", "w", "before",
                         len(rows), rows_per_bin).collect()
    expected, running = [], Counter()
    for g, o, w in sorted(rows, key=lambda r: r[1]):
        expected.append((str(g), o, w, running[g]))
        running[g] += w
    assert sorted((str(r.g), r.o, r.w, r.before) for r in found) == sorted(expected)


def brute_exponent(totals, wanted, target, limit):
    total, n = sum(totals), len(totals)

    def measure(k):
        m = [(t / total) ** (k / 2 ** mixing.STEPS) for t in totals]
        z = sum(m)
        h = -sum(x / z * math.log(x / z) for x in m) / math.log(n)
        return h, max(x / z * wanted / t for x, t in zip(m, totals))

    def turn(holds):
        lo, hi = 0, 2 ** mixing.STEPS
        if holds(hi):
            return hi, hi
        if not holds(0):
            return 0, 0
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo, hi

    k = 2 ** mixing.STEPS if target is None and limit is None else 0
    if target is not None:
        k = turn(lambda x: measure(x)[0] >= target)[0]
    if limit is not None:
        k = max(k, turn(lambda x: measure(x)[1] > limit)[1])
    return k / 2 ** mixing.STEPS


@pytest.mark.parametrize("target,limit", [(0.95, 4.0), (0.7, None), (None, 2.0), (0.01, None),
                                          (1.5, None), (None, 1.0), (None, 0.5), (None, None)])
def test_exponent_meets_its_targets(frame, target, limit):
    totals = [10_000, 900, 350, 20, 1]
    table = frame([(str(i), 1, t) for i, t in enumerate(totals)],
                  "source string, n_docs long, n_tokens long")
    found = mixing.find_exponent(table, target, limit)
    assert found == brute_exponent(totals, sum(totals), target, limit)


@pytest.mark.parametrize("target,limit,budget", [(0.95, 4.0, None), (0.9, None, 5000),
                                                 (None, 2.0, 20_000), (0.1, None, None)])
def test_mixture_equals_brute_force(frame, target, limit, budget):
    rows = corpus()
    found = mixing.mix(frame(rows, SCHEMA), target_entropy=target, max_repetition=limit,
                       budget=budget, block_tokens=500)
    assert found.columns == ["doc_id", "source", "text", "mix", "pack", "_mix"]
    lengths = [(len((t or "").split()) + 1) for _, _, t, _, _ in rows]
    totals = Counter()
    for (_, s, *_), n in zip(rows, lengths):
        totals[s] += n
    total, wanted = sum(totals.values()), budget or sum(totals.values())
    a = brute_exponent(list(totals.values()), wanted, target, limit)
    mass = {s: (n / total) ** a for s, n in totals.items()}
    expected = []
    for s, n in totals.items():
        w = mass[s] / sum(mass.values())
        goal, quota = round(w * wanted), max(1, round(w * 500))
        for epoch in range(math.ceil(goal / n)):
            own = []
            for (i, source, text, *_), size in zip(rows, lengths):
                if source == s:
                    key = "|".join(["1", *("N" if x is None else f"{len(x)}:{x}"
                                           for x in (str(i), source, text))])
                    key = hashlib.md5(key.encode()).hexdigest()
                    own.append((hashlib.md5(f"{key}:{epoch}".encode()).hexdigest(), i, size))
            at = epoch * n
            for place, i, size in sorted(own):
                if at < goal:
                    order = hashlib.md5(f"{place}:p".encode()).hexdigest()
                    expected.append((at // quota, order, i, epoch, size))
                at += size
    expected.sort()
    position = {b: 0 for b, *_ in expected}
    want = []
    for block, _, i, epoch, size in expected:
        want.append((block, position[block], i, epoch, size))
        position[block] += 1
    got = [(r["_mix"].block, r["_mix"].position, r.doc_id, r["_mix"].epoch, r["_mix"].n_tokens)
           for r in found.collect()]
    assert sorted(got) == want
    if target == 0.95:  # a small source is repeated, the hot one cut; texts stay with their ids
        text = {i: t for i, _, t, *_ in rows}
        assert max(g[3] for g in got) > 0
        assert all(r.text == text[r.doc_id] for r in found.collect())


def test_shares_that_meet_the_target_give_every_row_once(frame):
    rows = [document(i, f"s{i % 4}", 5) for i in range(40)] + [document(1, "s1", 5)] * 2
    found = mixing.mix(frame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows)
    assert mixing.mix(frame([], SCHEMA)).count() == 0


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(5))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 9), rng.randrange(1, 200)]) for _ in range(40)]
    cells = [(n, c, n * c) for n, c in sorted(Counter(lengths).items())]
    for k in (1, 2, 3):
        bounds = packing.optimal_bounds(cells, k)
        best = min(padding(lengths, (*c, max(lengths))) for c in itertools.combinations(
            sorted(set(lengths))[:-1], k - 1))
        assert padding(lengths, bounds) == best and len(bounds) == k
    assert packing.optimal_bounds(cells, 999) == sorted(set(lengths))
    assert packing.optimal_bounds([], 3) == []


def test_cells_keep_leading_bits(frame):
    lengths = [1, 7, 8, 15, 16, 17, 1000, 10 ** 12 + 12345]
    found = [r.c for r in frame([(n,) for n in lengths], "n long").select(
        packing.cell(F.col("n"), 3).alias("c")).collect()]
    assert found == [n >> max(0, n.bit_length() - 3) << max(0, n.bit_length() - 3) for n in lengths]


def test_batches_are_full_and_within_budget(frame):
    rows = corpus() + [document(3000, "hot", 3000)]
    found = packing.pack(frame(rows, SCHEMA), buckets=4, batch_tokens=200).collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows)
    batches = defaultdict(list)
    for r in found:
        p = r["_pack"]
        assert p.n_tokens == len((r.text or "").split()) + 1 <= p.bucket_length
        batches[p.bucket, p.batch, p.bucket_length].append(p.slot)
    last = Counter()
    for b, n, _ in batches:
        last[b] = max(last[b], n)
    for (b, n, bound), slots in batches.items():
        fits = max(1, 200 // bound)
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) == fits or n == last[b] and len(slots) < fits
    bounds = sorted({p[2] for p in batches})
    lengths = [len((t or "").split()) + 1 for _, _, t, _, _ in rows]
    assert bounds == packing.optimal_bounds(
        [(n, c, n * c) for n, c in sorted(Counter(lengths).items())], 4)
    assert packing.pack(frame([], SCHEMA)).count() == 0


def brute_table(shards, slots):
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    prefer = [[(number(f"{s}|offset") + j * (number(f"{s}|skip") % (slots - 1) + 1)) % slots
               for j in range(slots)] for s in shards]
    table = {}
    for turn in range(slots):
        mine = turn % len(shards)
        table[next(p for p in prefer[mine] if p not in table)] = shards[mine]
    return [table[i] for i in range(slots)]


def test_table_is_even_and_steady():
    shards = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(shards, 499)
    assert table == brute_table(shards, 499)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(shards[:-1], 499)
    moved = sum(a != b for a, b in zip(table, fewer) if a != "n6")
    assert moved < 0.1 * 499
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 499)
    for slots in (500, 5):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, slots)


def test_rows_are_placed_by_key(frame):
    rows = [(i % 50, None if i % 7 == 0 else f"k{i % 5}", "x", "y") for i in range(400)]
    df = frame(rows, "doc_id long, name string, slot string, shard string")
    found = sharding.shard_rows(df, ["doc_id", "name"]).collect()
    assert len(found) == 400
    assert len({(r.doc_id, r.name) for r in found}) == len(
        {(r.doc_id, r.name, r["_slot"], r["_shard"]) for r in found})
    table = sharding.fill_table(sharding.SHARDS)
    assert all(table[r["_slot"]] == r["_shard"] for r in found)
    hot = frame([(1, str(i)) for i in range(3000)], "doc_id long, text string")
    assert sharding.shard_rows(hot, ["doc_id"]).select("shard").distinct().count() == 1
    spread = sharding.shard_rows(hot, ["doc_id"], spread=64)
    assert spread.select("shard").distinct().count() > 8
    assert sharding.shard_rows(hot.limit(0), ["doc_id"]).count() == 0


def test_placement_has_no_shuffle(frame):
    df = frame([(1,)], "doc_id long")
    plan = sharding.shard_rows(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan
