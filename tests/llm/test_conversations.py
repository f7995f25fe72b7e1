"""Conversation repair against plain dynamic programming over whole strings."""

import hashlib
import random
import zlib

import pytest

from gaugeflow.llm import conversations as cv, grammar as g

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
                          .encode()) % 20
        if code == 1:
            text = ""
        elif code == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        elif code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2],
                                       hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen
                      else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows} - {None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # state: what may come next, given the last role kept
    best = {"": (0, "", ())}

    def put(to, state, cost, edit, line):
        old = best[state]
        new = (old[0] + cost, old[1] + edit, old[2] + line)
        if to not in found or new[:2] < found[to][:2]:
            found[to] = new

    def inserted():
        nonlocal best, found
        for _ in range(3):
            found = dict(best)
            for state in best:
                name = "assistant" if state == "u" else "user"
                put(name[0], state, 2, "I", ((name, ""),))
            best = found

    found = {}
    for (_, _, role, text), fault in zip(rows, faults):
        inserted()
        found, late = {}, fault == "truncated"
        for state in best:
            put(state, state, 3, "D", ())
            if fault in ("blank", "duplicate"):
                continue
            name = "assistant" if state == "u" else "user"
            put(name[0], state, 2 + late, "R", ((name, text),))
            if role[:1] == name[0] or (role[:1] == "s" and state == ""):
                put(role[:1], state, late, "K", ((role, text),))
        best = found
    inserted()
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
            faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest), lines


def sample(n=60, seed=1):
    rnd = random.Random(seed)
    texts = ["Hello.", "Hello.", "why", "Yes!", "No? ", "", " \n", None, "a.", "b.", "c", "…", "\xa0"]
    rows = []
    for conv in range(n):
        for turn in range(rnd.randrange(12)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "ux"])
            rows.append((conv, rnd.choice([turn, turn, turn, None, 3, 100]), role, rnd.choice(texts)))
    rows += [(None, i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(9)]
    rows += [(5000, i, rnd.choice(["user", "assistant", "assistant", "system"]),
              rnd.choice(texts) if i % 5 else f"text {i}.") for i in range(400)]
    rows += [(6000, 1, "user", "the same.")] * 50 + [(7000, None, "system", "x" * 300_000)]
    return rows


def check(found, rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert len(found) == len(groups)
    for r in found:
        assert tuple(r[n] for n in NAMES) == by_hand(groups[r.conv_id])[0], r.conv_id


@pytest.mark.parametrize("chunk_rows", [3, 64, 4096])
def test_repair_equals_brute_force(spark, chunk_rows):
    rows = [(c, t, r or " ", x or " ") if r is None or x is None else (c, t, r, x)
            for c, t, r, x in sample()]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", conv int").repartition(5)
    check(cv.repair(docs, chunk_rows=chunk_rows).collect(), rows)


def test_damage_and_lost_conversations(spark):
    rows = sample(seed=2) + [(c, 0, "user", "alone.") for c in range(100, 200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = damaged(rows)
    assert sorted(map(tuple, cv.damage(docs).collect()), key=str) == sorted(left, key=str)
    found = cv.with_lost(cv.repair(cv.damage(docs)), docs).collect()
    present = {r[0] for r in left}
    check([r for r in found if r.conv_id in present], left)
    lost = [r for r in found if r.conv_id not in present]
    assert {r.conv_id for r in lost} == {r[0] for r in rows} - present and lost
    assert {tuple(r[n] for n in NAMES) for r in lost} == {
        (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    rows = [(c, t, r or " ", x or " ") if r is None or x is None else (c, t, r, x)
            for c, t, r, x in sample(seed=4)]
    found = cv.repaired_rows(spark.createDataFrame(rows, SCHEMA), chunk_rows=7).orderBy(
        "part", "no").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for conv, mine in groups.items():
        assert [(r.role, r.text) for r in found if r.conv_id == conv] == list(by_hand(mine)[1])


def test_grammar_changes_no_result():
    rnd = random.Random(8)
    rules = [("ua", "Ā"), ("ĀĀ", "ā"), ("xx", "Ă"),
             ("āā", "ă"), ("UĂ", "Ą"), ("ăă", "ą")]
    plain, shared = g.Grammar([]), g.Grammar(rules)
    for n in range(120):
        letters = "".join(rnd.choice(["ua", "ua", "uaua", "x", "xx", "U", "s", "o", "A", "a"])
                          for _ in range(n))
        assert plain.cheapest(letters) == shared.cheapest(letters)


def test_pairs_are_the_most_frequent(spark):
    sequences = spark.createDataFrame([("uauauaua",)] * 5 + [("suaxx",), ("",), ("x",)],
                                      "letters string")
    rules = g.learn(sequences, rounds=3, per_round=2).rules
    assert rules[0] == ("ua", "Ā") and "ĀĀ" in dict(rules)
    assert g.learn(sequences.limit(0)).rules == []


def test_order_of_ropes():
    a, b = g.joined("K" * 60, "D" * 60), g.joined("K" * 61, "D" * 60)
    assert g.less(a, b) and not g.less(b, a) and not g.less(a, a)
    assert g.less("", "D") and not g.less("", "") and not g.less("D", "")
    assert g.less(a, g.joined(a, "I")) and not g.less(g.joined(a, "I"), a)
    assert str(g.joined(a, b)) == "K" * 60 + "D" * 60 + "K" * 61 + "D" * 60


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert cv.with_lost(cv.repair(cv.damage(docs)), docs).count() == 0
    assert cv.repaired_rows(docs).count() == 0
