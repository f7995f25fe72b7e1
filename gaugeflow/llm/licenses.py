"""License scan by sentence rules.

A text is cut into sentences, each is normalised, and sentences known from licenses get an
identifier. A text is one string with marks between its sentences, in which each pattern in turn
replaces the sentences (and the lines that one is wrapped over) it matches. The sequence of identifiers of a text is then matched against ordered rules, the
longest first: a rule that fits replaces its identifiers by the name of a license, so
no sentence counts twice. What is left over are license sentences without a known license.

Everything happens inside a row with built-in functions, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import free_name

# Words of the SQL twin, which reads only the sentences that hold one of them. The
# scan itself reads all sentences.
KEYWORDS = ("licen", "copyright", "redistribut", "warrant", "permission", "public domain", "spdx",
            "free software", "all rights reserved", "applicable law", "permitted", "endorse",
            "advertising materials", "be liable")

_UNDER = r"(is |are |be )?(hereby )?(re)?(released|licensed|distributed|available|provided|published|covered|free software)( to you)?( only)? (under|by)( the)?( terms of)?( the)?( an?)? ?"
_GPL = r"(gnu )?general public licen[sc]e|gpl"
_LGPL = r"(gnu )?(lesser|library) general public licen[sc]e|lgpl"
_AGPL = r"(gnu )?affero general public licen[sc]e|agpl"
_VERSION = r"[ ,(]*(either )?(version |v\.?)?"

# Known sentences in the order in which they are tried, as patterns over the normalised
# sentence. ``{1}`` in an identifier is the pattern's first marked group.
SENTENCES = (
    ("Spdx={1}", r"^spdx-license-identifier: *(?P<x>[a-z0-9.+-]+)"),
    ("ApacheRef2", _UNDER + r"apache( software)? licen[sc]e" + _VERSION + r"2"),
    ("ApacheExcept", r"^you may not use this (file|work|software) except in compliance with the licen[sc]e"),
    ("ApacheObtain", r"^you may obtain a copy of the licen[sc]e at"),
    ("ApacheAsIs", r"^unless required by applicable law or agreed to in writing"),
    ("MitRef", _UNDER + r"(mit|expat|x11)([ /(-]*(expat|style|x11)\)?)? ?licen[sc]e"),
    ("MitGrant", r"^permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MitNotice", r"^the above copyright notice and this permission notice .*shall be included in all copies"),
    ("MitAsIs", r"^the software is provided as is,? without warranty of any kind"),
    ("MitLiability", r"^in no event shall the (authors|copyright holders|x consortium).* be liable for any claim"),
    ("BsdRef{1}", _UNDER + r"(simplified |modified |new |revised )?(?P<x>[234])?[- ]?(clause )?bsd licen[sc]e"),
    ("BsdIntro", r"^redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("BsdSource", r"^redistributions? of source code must retain the above copyright notice"),
    ("BsdBinary", r"^redistributions? in binary form must reproduce the above copyright notice"),
    ("BsdAdvert", r"^all advertising materials mentioning features or use of this software"),
    ("BsdEndorse", r"^neither the names? of .* may be used to endorse or promote products"),
    ("BsdAsIs", r"^this software is provided by .* as is"),
    ("BsdLiability", r"^in no event shall .* be liable for any direct, indirect, incidental"),
    ("IscRef", _UNDER + r"isc licen[sc]e"),
    ("IscGrant", r"^permission to use, copy, modify,? (and/or|and) distribute this software for any purpose"),
    ("IscAsIs", r"^the software is provided as is and the author disclaims all warranties"),
    ("LgplLater{1}", r"(" + _LGPL + r")( as published by the free software foundation)?[;,]?" + _VERSION + r"(?P<x>2\.1|2|3)(\.0)?.*or .*later"),
    ("LgplRef{1}", _UNDER + r"(" + _LGPL + r")" + _VERSION + r"(?P<x>2\.1|2|3)?"),
    ("AgplLater{1}", r"(" + _AGPL + r")( as published by the free software foundation)?[;,]?" + _VERSION + r"(?P<x>1|3)(\.0)?.*or .*later"),
    ("AgplRef{1}", _UNDER + r"(" + _AGPL + r")" + _VERSION + r"(?P<x>1|3)?"),
    ("GplLater{1}", r"(" + _GPL + r")( as published by the free software foundation)?[;,]?" + _VERSION + r"(?P<x>1|2|3)(\.0)?.*or .*later"),
    ("GplRef{1}", _UNDER + r"(" + _GPL + r")( as published by the free software foundation)?[;,]?" + _VERSION + r"(?P<x>1|2|3)?"),
    ("GnuNoWarranty", r"^this (program|library|software|file) is distributed in the hope that it will be useful"),
    ("GnuDetails", r"^see the gnu (lesser |library |affero )?general public licen[sc]e for more details"),
    ("GnuReceived", r"^you should have received a copy of the gnu (lesser |library |affero )?general public licen[sc]e"),
    ("MplRef", r"subject to the terms of the mozilla public licen[sc]e|" + _UNDER + r"mozilla public licen[sc]e"),
    ("MplObtain", r"^if a copy of the mpl was not distributed with this file"),
    ("EplRef", _UNDER + r"eclipse public licen[sc]e"),
    ("CcRef=by{1}", _UNDER + r"(cc|creative commons)[ -](by|attribution)(?P<x>([- ](nc|nd|sa|noncommercial|noderivatives|sharealike))*([- ]\d\.\d)?)"),
    ("Cc0Ref", _UNDER + r"(cc0|creative commons zero)"),
    ("Unlicense", r"^this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(released|placed|dedicated) (in|into|to) the public domain"),
    ("BoostRef", _UNDER + r"boost software licen[sc]e"),
    ("ZlibAsIs", r"^this software is provided as-is,? without any express or implied warranty"),
    ("ZlibGrant", r"^permission is granted to anyone to use this software for any purpose"),
    ("Wtfpl", r"^everyone is permitted to copy and distribute verbatim or modified copies"),
    ("Copyright", r"^(copyright|\(c\)) .*\d{4}|^all rights reserved"),
    ("Unknown", r"licen[sc]ed under|^licen[sc]ed |^licen[sc]e: "),
)

# Rules in the order in which they are tried, as patterns over identifiers that each
# end in a semicolon. ``$1`` in a name is the pattern's first group.
RULES = (
    ("Apache-2.0", r"ApacheRef2;(ApacheExcept;)?(ApacheObtain;)?(ApacheAsIs;)?"),
    ("Apache-2.0", r"ApacheExcept;(ApacheObtain;)?(ApacheAsIs;)?"),
    ("MIT", r"MitGrant;(MitNotice;)?(MitAsIs;)?(MitLiability;)?"),
    ("MIT", r"MitRef;"),
    ("BSD-4-Clause", r"BsdIntro;BsdSource;BsdBinary;BsdAdvert;BsdEndorse;(BsdAsIs;)?(BsdLiability;)?"),
    ("BSD-3-Clause", r"BsdIntro;BsdSource;BsdBinary;BsdEndorse;(BsdAsIs;)?(BsdLiability;)?"),
    ("BSD-2-Clause", r"BsdIntro;BsdSource;BsdBinary;(BsdAsIs;)?(BsdLiability;)?"),
    ("BSD-$1-Clause", r"BsdRef([234]);"),
    ("BSD", r"BsdRef;"),
    ("ISC", r"IscGrant;(IscAsIs;)?"),
    ("ISC", r"IscRef;"),
    ("LGPL-$1-or-later", r"LgplLater([0-9.]+);(GnuNoWarranty;)?(GnuDetails;)?(GnuReceived;)?"),
    ("LGPL-$1-only", r"LgplRef([0-9.]+);(GnuNoWarranty;)?(GnuDetails;)?(GnuReceived;)?"),
    ("LGPL", r"LgplRef;"),
    ("AGPL-$1-or-later", r"AgplLater([0-9.]+);(GnuNoWarranty;)?(GnuDetails;)?(GnuReceived;)?"),
    ("AGPL-$1-only", r"AgplRef([0-9.]+);(GnuNoWarranty;)?(GnuDetails;)?(GnuReceived;)?"),
    ("AGPL", r"AgplRef;"),
    ("GPL-$1-or-later", r"GplLater([0-9.]+);(GnuNoWarranty;)?(GnuDetails;)?(GnuReceived;)?"),
    ("GPL-$1-only", r"GplRef([0-9.]+);(GnuNoWarranty;)?(GnuDetails;)?(GnuReceived;)?"),
    ("GPL", r"GplRef;"),
    ("MPL-2.0", r"MplRef;(MplObtain;)?"),
    ("EPL", r"EplRef;"),
    ("CC-BY$1", r"CcRef=by([^;]*);"),
    ("CC0-1.0", r"Cc0Ref;"),
    ("Unlicense", r"Unlicense;"),
    ("Public-Domain", r"PublicDomain;"),
    ("BSL-1.0", r"BoostRef;"),
    ("Zlib", r"ZlibAsIs;ZlibGrant;"),
    ("WTFPL", r"Wtfpl;"),
    ("$1", r"Spdx=([^;]*);"),
)

# Every alternative of every pattern above contains one of these, so a text
# without them has no identifier and is not searched pattern by pattern.
HINTS = ("licen[sc]e", "gpl", "mpl", "copyright", r"\(c\) ", "permission", "permitted", "redistribution",
         "software is provided", "applicable law", "be liable", "advertising materials", "endorse",
         "hope that it will be useful", "public domain", "cc0", "cc[ -](?:by|attribution)",
         "creative commons", "all rights reserved")

# comment signs and list marks at the start of a line
_LEADERS = r"(^|\n)[ \t]*(?://+|/?\*+/?|#+|;+|--+|[(]?[0-9a-z][.)])[ \t]*"
_END = r"([.!?])[\"')]*\s+|\n[ \t\r]*\n\s*"
_CAPITAL = r"\n[ \t]*(\p{Lu})"
_SENTENCE_END = f"{_END}|{_CAPITAL}"  # of the SQL twin
# between sentences, before a line that may start one, and around an identifier that stands for a sentence
_MARK, _LINE, _OPEN, _CLOSE = "\u0001", "\u0002", "\u0003", "\u0004"


def _plain(pattern: str) -> str:
    """Spark's and RE2's patterns alike: groups count by position, so only ``x`` may mark one."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("(?P<x>", i):
            out.append("(")
            i += 6
        elif pattern[i] == "\\":
            out.append(pattern[i:i + 2])
            i += 2
        elif pattern[i] == "(" and not pattern.startswith("(?", i):
            out.append("(?:")
            i += 1
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


KNOWN = tuple((name, _plain(p)) for name, p in SENTENCES)


def _marked(pattern: str) -> str:
    """A pattern over a sentence as one over a text of marked sentences.

    A line that begins with a capital letter may start a sentence or go on with one: patterns
    may begin at it and may run over it.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if c == "[":
            end = pattern.index("]", i)
            out.append(pattern[i:end + 1].replace(" ", f" {_LINE}"))
            i = end + 1
            continue
        if c == "^":
            out.append(_START)
        elif pattern.startswith(".*", i):
            out.append(_ANY)
            i += 1
        elif c == " ":
            out.append(f"[ {_LINE}]")
        else:
            out.append(c)
        i += 1
    return "".join(out)


# the start of a sentence, and the rest of one
_START = f"(?<![^{_MARK}{_LINE}])"
_REST = f"[^{_MARK}{_LINE}{_OPEN}]*"
# anything inside a line; else over lines, but not where the next one names a license of its own
_ANY = (f"(?:{_REST}?|(?!{_REST}{_LINE}{_REST}(?:gpl|public licen[sc]e))[^{_MARK}{_OPEN}]*?)")
_HINT = "|".join(_marked(h) for h in HINTS)


def normalised(text: Column) -> Column:
    """A text in lower case without quotes, its sentences normalised and set apart by marks."""
    clean = F.regexp_replace(F.translate(text, _LINE + _OPEN + _CLOSE, "   "), _LEADERS, "$1")
    cut = F.regexp_replace(F.regexp_replace(clean, _END, f"$1{_MARK}"), _CAPITAL, f"{_LINE}$1")
    plain = F.regexp_replace(F.regexp_replace(F.lower(cut), "[\"'“”‘’`]", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(plain, f" ?([{_MARK}{_LINE}]) ?", "$1"))


def identified(normal: Column) -> Column:
    """The normalised text with the identifier in place of every sentence that is known."""
    for name, pattern in KNOWN:
        normal = F.regexp_replace(
            normal, f"{_START}{_REST}?(?:{_marked(pattern)}){_REST}",
            f"{_OPEN}{name.replace('{1}', '$1')};{_CLOSE}")
    return normal


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with a struct ``license``: sentence_ids, licenses, n_unmatched.

    ``sentence_ids`` is the sequence of identifiers, each ending in ``;``; ``licenses`` the names found,
    each once, in order of appearance, joined by ``,``; ``n_unmatched`` the license sentences (but
    copyright lines) that no rule used. A NULL or empty text has none: '', '' and 0.
    """
    i, r, t = (free_name(docs, c) for c in ("_ids", "_named", "_normal"))
    found = F.regexp_extract_all(identified(F.col(t)), F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"), F.lit(1))
    ids = F.when(F.col(t).rlike(_HINT), F.translate(F.array_join(found, ""), f" {_LINE}", "--")).otherwise("")
    named = F.col(i)
    for name, pattern in RULES:
        named = F.regexp_replace(named, pattern, f"<{name}>")
    names = F.array_distinct(F.regexp_extract_all(F.col(r), F.lit("<([^>]*)>"), F.lit(1)))
    left = F.filter(F.regexp_extract_all(F.col(r), F.lit("([^<>;]+);"), F.lit(1)),
                    lambda s: s != "Copyright")
    out = F.struct(F.col(i).alias("sentence_ids"), F.upper(F.array_join(names, ",")).alias(
        "licenses"), F.size(left).cast("long").alias("n_unmatched"))
    return (docs.withColumn(t, normalised(F.col(text))).withColumn(i, ids).withColumn(r, F.when(F.col(i) == "", F.lit("")).otherwise(named))
            .withColumn(free_name(docs, "license"), out).drop(i, r, t))


def oracle() -> str:
    """The same scan in SQL."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    keyword = " OR ".join(f"contains({{0}}, {text(w)})" for w in KEYWORDS)
    cases = "\n".join(
        f"WHEN regexp_matches(s, {text(p)}) THEN " + (
            text(name) if "{1}" not in name else
            f"{text(name.replace('{1}', ''))} || replace(regexp_extract(s, {text(p)}, 1), ' ', '-')")
        for name, p in KNOWN)
    named = "ids"
    for name, pattern in RULES:
        named = f"regexp_replace({named}, {text(pattern)}, {text('<' + name.replace('$1', chr(92) + '1') + '>')}, 'g')"
    quotes = text("[\"'“”‘’`]")
    return f"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, {text(_LEADERS)}, '\\1', 'g'),
    {text(_SENTENCE_END)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts
  FROM documents WHERE {keyword.format("lower(text)")}),
parts AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS nth FROM cut),
plain AS (
  SELECT doc_id, nth, trim(regexp_replace(regexp_replace(lower(part), {quotes}, '', 'g'),
    '\\s+', ' ', 'g')) AS s FROM parts),
known AS (
  SELECT doc_id, nth, CASE {cases} END AS id FROM plain WHERE {keyword.format("s")}),
sequences AS (
  SELECT doc_id, string_agg(id || ';', '' ORDER BY nth) AS ids FROM known
  WHERE id IS NOT NULL GROUP BY doc_id),
named AS (SELECT doc_id, ids, {named} AS named FROM sequences),
lists AS (
  SELECT doc_id, ids, regexp_extract_all(named, '<([^>]*)>', 1) AS found,
    list_filter(regexp_extract_all(named, '([^<>;]+);', 1), lambda x: x <> 'Copyright') AS rest
  FROM named)
SELECT d.doc_id, coalesce(l.ids, '') AS sentence_ids,
  coalesce(upper(array_to_string(list_filter(l.found, lambda x, i:
    list_position(l.found, x) = i), ',')), '') AS licenses,
  CAST(coalesce(len(l.rest), 0) AS BIGINT) AS n_unmatched
FROM documents d LEFT JOIN lists l ON d.doc_id = l.doc_id"""
