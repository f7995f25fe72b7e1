"""HTML extraction, license scan and language identification."""

import itertools
import zlib

import numpy as np
import pytest

from gaugeflow.llm import html, language, licenses


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


LONG = "This is a long paragraph of the article with a good many words in it."
CASES = {
    "article": (page(f"<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><article><h1>Head</h1>"
                     f"<p>{LONG}</p><p>Short.</p><p>{LONG}</article><footer>&copy; foot</footer>"),
                ["Head", LONG, "Short.", LONG]),
    "entities": (page("<main><p>caf&eacute; &amp; &#8364;5 &lt;b&gt; and more of it</p></main>"),
                 ["café & €5 <b> and more of it"]),
    "scripts": (page(f"<script>var t='</p><p>no</p>';</script><style>p{{}}</style><article><p>{LONG}"
                     "</p><noscript>no</noscript></article>", "<script>x</script>"), [LONG]),
    "comments and sidebars": (page(
        f"<div id='wrap'><div class='post-content'><p>{LONG}</p><ul><li>one</li><li>two</ul>"
        f"<div class='ad-box'>Buy now</div><p>{LONG}</p></div><div class='sidebar'>{LONG}</div>"
        f"<section id='comments'><p>{LONG}</p></section></div><form>Name <input></form>"),
        [LONG, "one", "two", LONG]),
    "unclosed": (page(f"<article><p><b>Bold<br>and on<p>{LONG}<p>Last"), ["Bold and on", LONG, "Last"]),
    "white space": (page(f"<article><p>a\n  b\t<i>c</i>&nbsp;d   {LONG} </p></article>"),
                    [f"a b c d {LONG}"]),
    "no article": (page(f"<ul><li><a href=/1>a</a><li><a href=/2>b</a></ul><div><p>{LONG}</p>"
                        f"<p>{LONG}</p></div>"), [LONG, LONG]),
    "hidden": (page(f"<article><p>{LONG}</p><p hidden>h</p><p style='display: none'>n</p></article>"),
               [LONG]),
    "comment": (f"<article><p>{LONG}</p><!-- <p>no</p> --></article><!-- open <p>no</p>", [LONG]),
    "bare text": ("just text & more", ["just text & more"]),
    "broken declaration": (f"<![odd[ x ]]><p>{LONG}</p>", [LONG]),
    "nothing": (page("<nav>Menu</nav>"), []), "empty": ("", []), "null": (None, []),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    source, blocks = CASES[name]
    assert html.main_text(source) == "\n\n".join(blocks)


def test_long_page_and_smoothing():
    text = html.main_text(page("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"))
    assert text.count(LONG) == 20_000
    values = np.array([1.0, 5, 2, 8])
    kernel = lambda d: np.exp(-0.5 * (d / html.SIGMA) ** 2)
    expected = [sum(kernel(i - j) * values[j] for j in range(4))
                / sum(kernel(i - j) for j in range(4)) for i in range(4)]
    assert html.smooth(values) == pytest.approx(expected)
    assert 3 < html.threshold(np.array([1.0, 2, 1, 9, 8])) < 8
    assert html.threshold(np.array([4.0, 4])) == 4


def test_pages_in_a_frame(frame):
    rows = [(i, "u", h, "t") for i, (h, _) in enumerate(CASES.values())]
    df = frame(rows + rows[:2], "page_id long, url string, html string, text string")
    found = html.extract_text(df)
    assert found.columns == ["page_id", "url", "text", "_text"]
    expected = [(i, "\n\n".join(b)) for i, (_, b) in enumerate(CASES.values())]
    assert sorted((r.page_id, r["_text"]) for r in found.collect()) == sorted(
        expected + expected[:2])
    assert html.extract_text(df.limit(0)).count() == 0


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in it. The above copyright notice
and this permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY. See the
# GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted.
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
"""
SCANS = [
    (MIT, "MIT", 0), (GPL, "GPL-3-OR-LATER", 0), (BSD, "BSD-2-CLAUSE", 0),
    (BSD + "3. Neither the name of X nor those of others may be used to endorse or promote products.",
     "BSD-3-CLAUSE", 0),
    ("Text before. Released under the MIT License. And after.", "MIT", 0),
    ("x\nLicensed under the Apache License, Version 2.0.\ny", "APACHE-2.0", 0),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3-ONLY", 0),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 0),
    ("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0", 0),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.",
     "MIT,APACHE-2.0", 0),
    ("This is licensed under our own terms.", "", 1),
    ("The permission of a warrant.", "", 0), ("No word of it", "", 0), ("", "", 0), (None, "", 0),
]


def test_license_scan(frame):
    rows = [(i, t, "l") for i, (t, _, _) in enumerate(SCANS)]
    rows += [(100, "filler words. " * 20_000 + "Released under the MIT License.", "l"), rows[0]]
    df = frame(rows, "doc_id long, text string, license string")
    found = licenses.scan(df)
    assert found.columns == ["doc_id", "text", "license", "_license"]
    got = sorted((r.doc_id, r["_license"].licenses, r["_license"].n_unmatched)
                 for r in found.collect())
    want = [(i, n, u) for i, (_, n, u) in enumerate(SCANS)] + [(100, "MIT", 0), (0, "MIT", 0)]
    assert got == sorted(want)
    assert licenses.scan(df.limit(0)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def brute_likelihood(word, pieces, p):
    """Sum over all segmentations, written out."""
    word = "▁" + word
    number = {x: i for i, x in enumerate(pieces)}
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        value = 1.0
        for part in parts:
            i = number.get(part, len(pieces) if len(part) == 1 else None)
            value *= 0 if i is None else p[i]
        total += value
    return total


PIECES = sorted(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abba"])


def test_forward_pass_sums_all_segmentations():
    rng = np.random.default_rng(0)
    p = rng.random((len(PIECES) + 1, 2))
    p /= p.sum(0)
    words = ["a", "abba", "abab", "xaby", "b", "bababbab"]
    found = language.log_likelihoods(language.Lattice(PIECES), p, words)
    for i, w in enumerate(words):
        for l in range(2):
            assert found[i, l] == pytest.approx(np.log(brute_likelihood(w, PIECES, p[:, l])))


def test_expected_counts_are_derivatives():
    rng = np.random.default_rng(1)
    p = rng.random((len(PIECES) + 1, 2))
    p /= p.sum(0)
    words, of, n = ["abba", "abab", "ya"], np.array([0, 1, 0]), np.array([2.0, 1.0, 3.0])
    lattice = language.Lattice(PIECES)
    found = language.expected_counts(lattice, p, words, of, n)
    for i, l in np.ndindex(found.shape):
        up = p.copy()
        up[i, l] *= 1 + 1e-6
        change = sum(c * (language.log_likelihoods(lattice, up, [w])[0, k]
                          - language.log_likelihoods(lattice, p, [w])[0, k])
                     for w, k, c in zip(words, of, n))
        assert found[i, l] == pytest.approx(change / 1e-6, abs=1e-4)


def test_language_of_held_out_texts(frame):
    rng = np.random.default_rng(2)
    syllables = {"xx": ["the", "ing", "er", "wh"], "yy": ["que", "eau", "oi", "ré"]}
    rows = []
    for i in range(200):
        lang = "xx" if i % 2 else "yy"
        text = " ".join("".join(rng.choice(syllables[lang], 2)) for _ in range(rng.integers(3, 40)))
        rows.append((i, text, lang, "s"))
    odd = [(900, None, "xx", "s"), (901, "", "xx", "s"), (902, "12 34 $$", "yy", "s"),
           (903, rows[0][1], None, "s"), (None, rows[1][1], "xx", "s"), (904, "z" * 50_000, "xx", "s")]
    df = frame(rows + odd + [rows[5]], "doc_id long, text string, lang string, language string")
    found = language.identify(df)
    assert "_language" in found.columns
    got = [(r.doc_id, r.lang, r["_language"]) for r in found.collect()]
    assert len(got) == len(rows) + len(odd) + 1
    assert all(p.lang_pred == lang for i, lang, p in got if i is not None and i < 200)
    assert any(zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in got if i is not None)
    by_id = {i: p for i, _, p in got}
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[903].lang_pred == "yy" and 0 < by_id[904].score <= 1
    assert language.identify(df.limit(0)).count() == 0
    unlabelled = frame([(1, "words", None)], "doc_id long, text string, lang string")
    assert language.identify(unlabelled).first().language.lang_pred == "und"
