"""Re-Pair grammars over strings, and min-plus matrices of cheapest edits for their rules.

A conversation is a string with one letter per row. Re-Pair (Larsson and Moffat 2000) replaces the most
frequent pairs of neighbours by new letters, so that what conversations have in common becomes a
rule. Each letter has one transfer matrix: for every two states of the role pattern, the cheapest
edits that lead from one to the other, as cost and audit. A rule's matrix is the product of its two
letters' matrices, worked out once and used wherever the rule occurs.

Audits are ropes: a product refers to its factors' audits and copies neither. Of equally cheap edits
the least audit is kept. That is safe: of two cheapest audits between the same states none begins with
the other (the rest would be insertions, which are not free), so their order stays the same whatever
comes before or after them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gaugeflow.llm.common import written

# states of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FINAL = (START, ASSISTANT)
# row letters: the role's initial (o: any other), in capitals if truncated; x: must be deleted
LETTERS = "suaoSUAOx"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# new letters begin here
FIRST_RULE = 0x100
ROUNDS, RULES_PER_ROUND = 8, 16
# an audit of up to this length is a plain string
LEAF = 64


class Rope:
    """The audit ``left`` followed by ``right``."""

    __slots__ = ("left", "right")

    def __init__(self, left, right):
        self.left, self.right = left, right

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += (x.right, x.left)
        return "".join(out)


def joined(left, right):
    if not left or not right:
        return left or right
    if isinstance(left, str) and isinstance(right, str) and len(left) + len(right) <= LEAF:
        return left + right
    return Rope(left, right)


def less(x, y) -> bool:
    """Whether audit x comes before y; parts that both share are not read."""
    xs, ys = [x], [y]
    while xs and ys:
        a, b = xs.pop(), ys.pop()
        if a is b:
            continue
        if isinstance(a, Rope):
            xs += (a.right, a.left)
            ys.append(b)
        elif isinstance(b, Rope):
            ys += (b.right, b.left)
            xs.append(a)
        else:
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                return a[:n] < b[:n]
            if len(a) > n:
                xs.append(a[n:])
            if len(b) > n:
                ys.append(b[n:])
    return not xs and bool(ys)


# one row of a matrix: per end state a (cost, audit), or None
Row = list


def better(a, b):
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def times(row: Row, matrix: Sequence[Row]) -> Row:
    """A row followed by a matrix, in the min-plus sense with the least audit."""
    out = [None] * 4
    for k, start in enumerate(row):
        if start is None:
            continue
        cost, audit = start
        for j, step in enumerate(matrix[k]):
            if step is None:
                continue
            total, old = cost + step[0], out[j]
            if old is None or total < old[0]:
                out[j] = (total, joined(audit, step[1]))
            elif total == old[0]:
                new = joined(audit, step[1])
                if less(new, old[1]):
                    out[j] = (total, new)
    return out


def product(a: Sequence[Row], b: Sequence[Row]) -> list[Row]:
    return [times(row, b) for row in a]


def following(state: int) -> int:
    """The state after an inserted or re-roled row: the one role that the pattern wants next."""
    return ASSISTANT if state == USER else USER


def _inserts() -> list[Row]:
    """Any number of insertions: two lead from everywhere to wherever insertions lead."""
    matrix = [[None] * 4 for _ in STATES]
    for i in STATES:
        state = i
        for n in range(3):
            matrix[i][state] = better(matrix[i][state], (n * INSERT, "I" * n))
            state = following(state)
    return matrix


INSERTS = _inserts()


def letter_matrix(letter: str) -> list[Row]:
    """The edits of one row, after any insertions before it."""
    matrix = [[None] * 4 for _ in STATES]
    late = TRUNCATED if letter.isupper() else 0
    kept = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
            "a": {USER: ASSISTANT}}.get(letter.lower(), {})
    for i in STATES:
        matrix[i][i] = (DELETE, "D")
        if letter != "x":
            j = following(i)
            matrix[i][j] = better(matrix[i][j], (REROLE + late, "R"))
            if i in kept:
                matrix[i][kept[i]] = better(matrix[i][kept[i]], (KEEP + late, "K"))
    return product(INSERTS, matrix)


@dataclass
class Grammar:
    """Rules (pair, new letter) in the order in which they were made, and every letter's matrix."""

    rules: list[tuple[str, str]]

    def __post_init__(self):
        self.matrices = {c: letter_matrix(c) for c in LETTERS}
        for pair, letter in self.rules:
            self.matrices[letter] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def compressed(self, letters: str) -> str:
        for pair, letter in self.rules:
            letters = letters.replace(pair, letter)
        return letters

    def matrix(self, letters: str) -> list[Row]:
        """Edits of all rows of a part, without insertions after the last one."""
        found = [[(0, "") if i == j else None for j in STATES] for i in STATES]
        for letter in self.compressed(letters):
            found = product(found, self.matrices[letter])
        return found

    def cheapest(self, letters: str) -> tuple[int, str]:
        """Cost and audit of the cheapest repair of a whole conversation."""
        row: Row = [(0, ""), None, None, None]
        for letter in self.compressed(letters):
            row = times(row, self.matrices[letter])
        return finish(row)


def finish(row: Row) -> tuple[int, str]:
    """The cheapest way to a complete pattern, with insertions at the end if need be."""
    row = times(row, INSERTS)
    cost, audit = better(row[FINAL[0]], row[FINAL[1]])
    return cost, str(audit)


def disjoint(pairs: Iterable[str]) -> list[str]:
    """Those pairs, in order, that cannot overlap with one taken before."""
    taken: list[str] = []
    for p in pairs:
        if all(p[0] != q[1] and p[1] != q[0] for q in taken):
            taken.append(p)
    return taken


def learn(sequences: DataFrame, rounds: int = ROUNDS, per_round: int = RULES_PER_ROUND) -> Grammar:
    """The grammar of all ``sequences`` (column ``letters``), by Re-Pair.

    Each round counts all pairs of neighbours of all sequences and replaces the most frequent ones that
    cannot overlap each other, which is what replacing them one by one would give. Equal sequences are
    held once. Only the rules, at most ``rounds * per_round``, come to the driver. The grammar
    decides how much work is shared and never what comes out.
    """
    held = written(sequences.groupBy("letters").agg(F.count("*").alias("n")), "sequences")
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        pairs = F.transform(F.sequence(F.lit(1), F.char_length("letters") - 1),
                            lambda i: F.substring("letters", i, F.lit(2)))
        counted = (held.filter(F.char_length("letters") > 1)
                   .select("n", F.explode(pairs).alias("pair")).groupBy("pair")
                   .agg(F.sum("n").alias("n")).filter("n > 1")
                   .orderBy(F.desc("n"), "pair").limit(per_round * per_round).collect())
        new = disjoint(r.pair for r in counted)[:per_round]
        if not new:
            break
        named = [(p, chr(FIRST_RULE + len(rules) + i)) for i, p in enumerate(new)]
        rules += named
        letters = F.col("letters")
        for pair, letter in named:
            letters = F.replace(letters, F.lit(pair), F.lit(letter))
        held = written(held.select(letters.alias("letters"), "n")
                       .groupBy("letters").agg(F.sum("n").alias("n")), "sequences")
    return Grammar(rules)
