"""Long runs of letters that training did not see."""

import numpy as np
import pytest

from gaugeflow.llm import language

PIECES = sorted(["▁", "▁th", "t", "h", "e", "▁qu", "q", "u", "the", "que"])


def model(seen=5e-8):
    p = np.full((len(PIECES) + 1, 2), 1e-3)
    p[PIECES.index("the"), 0] = p[PIECES.index("que"), 1] = 0.5
    p[-1] = 5e-8, seen
    return language.LanguageModel(["xx", "yy"], np.log([0.5, 0.5]), PIECES, p / p.sum(axis=0))


@pytest.mark.parametrize("letter", ["漢", "ไ"])
@pytest.mark.parametrize("length", [45, 48, 100, 5000])
def test_unseen_letters_leave_the_rest_to_decide(letter, length):
    for words, lang in (("the " * 30, "xx"), ("que " * 30, "yy")):
        found, score = model().predict([words + letter * length])[0]
        assert found == lang and 0.99 < score <= 1
    assert model().predict([letter * length])[0][1] == pytest.approx(0.5)


def test_tiny_likelihoods_are_exact():
    m = model(1e-7)
    lattice = language.Lattice(PIECES)
    for n in (10, 20, 40, 48):
        found = language.log_likelihoods(lattice, m.probabilities, ["the" + "漢" * n, "que"])
        step = np.log(m.probabilities[-1])
        base = language.log_likelihoods(lattice, m.probabilities, ["the"])
        assert found[0] == pytest.approx(base[0] + n * step)
    # the same expected counts as those of a run that a double holds, per letter
    counts = [language.expected_counts(lattice, m.probabilities, ["漢" * n], np.array([0]),
                                       np.array([1.0])) for n in (10, 48)]
    assert counts[1][-1, 0] == pytest.approx(48) and counts[0][-1, 0] == pytest.approx(10)
