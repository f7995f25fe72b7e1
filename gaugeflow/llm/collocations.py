"""Collocations: phrases whose words occur together more often than apart.

Words are reduced to hashed ids and phrases are counted in counting quotient filters
(``quotient``): each task fills one per language from packed word-id n-grams, cuts it by the
leading bits of the quotient into segments, and the sorted segments of all tasks are merged.

Phrases are counted length by length. A phrase can be frequent only if the phrases one word
shorter in it are, so membership tables of the frequent ones (of a bounded size, errors only let
more through) keep most rare phrases from being counted at all. No dictionary is sent out:
a word's id is a hash of the language and the word, of as many bits as the vocabulary
needs, and it is verified that no frequent word shares its id with any other word of its language.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeflow.llm.common import written
from gaugeflow.llm.quotient import CountingFilter, gram_hash

MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
# a phrase goes if a longer one has this many percent of its count
INSIDE_PERCENT = 50
SEED = 42
# bounds of what a task holds: distinct words, n-grams waiting, n-grams in filters, bytes split at once
HELD_WORDS = 1 << 17
HELD_GRAMS = 1 << 18
HELD_ENTRIES = 1 << 19
SPLIT_BYTES = 1 << 20
# occurrences of n-grams per merged segment
SEGMENT_GRAMS = 1 << 21
# bits of a membership table: per member, and at most
MEMBER_BITS, MOST_MEMBER_BITS = 16, 28
ATTEMPTS = 16
# parts of a language whose best phrases are found first
RANK_PARTS = 64

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(
    string.ascii_uppercase.encode() + _BREAKS + b"\t",
    string.ascii_lowercase.encode() + b"\n" * len(_BREAKS) + b" ")
_EMPTY = 2 ** 64 - 1
_U = np.uint64


def _lang(lang: Column) -> Column:
    return F.coalesce(lang, F.lit("und"))


def _pieces(text: bytes, size: int = SPLIT_BYTES) -> Iterator[bytes]:
    """The normalised text (words between spaces, pieces between line ends) in parts of about
    ``size`` bytes that end between words."""
    text, at = text.translate(_TABLE), 0
    while len(text) - at > size:
        ends = [e for e in (text.find(b" ", at + size), text.find(b"\n", at + size)) if e >= 0]
        if not ends:
            break
        yield text[at:min(ends)]
        at = min(ends)
    yield text[at:]


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            if text.is_valid:
                yield lang, text.as_py()


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n): how often each word occurs in the texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out():
            for name, words in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(words), pa.string()),
                     pa.array(words.keys(), pa.binary()).cast(pa.string()),
                     pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])
            found.clear()

        for name, data in _by_lang(batches):
            words = found.setdefault(name, Counter())
            for piece in _pieces(data):
                words.update(piece.split())
                if sum(map(len, found.values())) > HELD_WORDS:
                    yield from out()
                    words = found.setdefault(name, Counter())
        yield from out()

    return (docs.select(_lang(F.col(lang)).alias("lang"), F.col(text).alias("text"))
            .mapInArrow(count, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def word_hash(attempt: int) -> Column:
    """The hash of columns lang and word; the same as ``_word_hash`` of their bytes."""
    return F.xxhash64("lang", F.concat("word", F.lit(" " * attempt)))


def _word_hash(lang_hash: int, word: bytes, attempt: int) -> int:
    return xxhash.xxh64_intdigest(word + b" " * attempt, lang_hash)


def _id(hashed: Column, bits: int) -> Column:
    return hashed if bits == 64 else hashed.bitwiseAND(F.lit(2 ** bits - 1))


def id_scheme(words: DataFrame, min_count: int) -> tuple[int, int]:
    """(bits, attempt) by which every frequent word has an id of its own within its language.

    The ids have as many bits (32 to 64, whole bytes) as make a clash of a frequent word
    unlikely, and the hash is salted anew until there is none. This fails only beyond some 2 ** 32
    words, where 64 bits are not enough; it then raises an error.
    """
    total, frequent = words.agg(F.count("*"), F.count_if(F.col("n") >= min_count)).first()
    need = max(1, total).bit_length() + max(1, frequent).bit_length() + 4
    bits = min(64, max(32, -(-need // 8) * 8))
    for attempt in range(ATTEMPTS):
        ids = words.select("lang", "n", _id(word_hash(attempt), bits).alias("id"))
        shared = ids.groupBy("lang", "id").agg(F.count("*").alias("words"),
                                               F.max("n").alias("most")).filter(
            (F.col("most") >= min_count)
            & ((F.col("words") > 1) | F.col("id").isin(0, -1)))
        if shared.isEmpty():
            return bits, attempt
    raise RuntimeError(f"no clash-free ids of {bits} bits in {ATTEMPTS} attempts")


class Members:
    """A table of bits in which each member sets two (a Bloom filter); sent to the tasks.

    It takes 2 ** 28 bits (32 MB) at most; beyond some 16 million members it lets more strangers
    through, which costs time and changes no result.
    """

    def __init__(self, hashes: DataFrame, column: str):
        n = hashes.count()
        self.log = min(MOST_MEMBER_BITS, max(10, (MEMBER_BITS * n).bit_length()))
        h, mask = F.col(column), F.lit(2 ** self.log - 1)
        place = F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)))
        slots = (hashes.select(place.alias("p"))
                 .groupBy(F.shiftright("p", 6).alias("slot"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits"))
                 .toArrow())
        table = np.zeros(2 ** self.log // 64, np.int64)
        table[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
        self.table = table.view(_U)
        self.bytes = table.tobytes()

    def has_one(self, h: int) -> bool:
        mask = 2 ** self.log - 1
        return all(self.bytes[p >> 3] >> (p & 7) & 1 for p in (h & mask, h >> 32 & mask))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mask, found = _U(2 ** self.log - 1), np.ones(len(hashes), bool)
        for h in (hashes & mask, (hashes >> _U(32)) & mask):
            found &= (self.table[h >> _U(6)] >> (h & _U(63))) & _U(1) == 1
        return found


class _Ids(dict):
    """Ids of the words of one language: 0 for a break and for words that are not frequent."""

    def __init__(self, lang: str, bits: int, attempt: int, members: Members):
        super().__init__({b"\n": 0, b"": _EMPTY})
        self.lang, self.mask, self.attempt = _seed(lang), 2 ** bits - 1, attempt
        self.members = members

    def __missing__(self, word: bytes) -> int:
        h = _word_hash(self.lang, word, self.attempt)
        found = h & self.mask if self.members.has_one(h) else 0
        self[word] = found = 0 if found == _EMPTY else found
        return found

    def of(self, piece: bytes) -> np.ndarray:
        tokens = piece.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, tokens), _U, len(tokens))
        if len(self) > HELD_WORDS:  # within one very long text
            self.clear()
            self.update({b"\n": 0, b"": _EMPTY})
        return ids[ids != _EMPTY]


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), SEED)


def _grams(ids: np.ndarray, words: int, seed: int, shorter: Members | None) -> list[np.ndarray]:
    """All n-grams without a break whose shorter phrases may be frequent, one array per word."""
    size = len(ids) - words + 1
    if size < 1:
        return [ids[:0]] * words
    columns = [ids[i:i + size] for i in range(words)]
    found = np.logical_and.reduce([c != 0 for c in columns])
    if shorter is not None:
        at = np.flatnonzero(found)
        fits = [shorter.has(gram_hash([c[at] for c in columns[i:i + words - 1]], seed))
                for i in (0, 1)]
        found = at[fits[0] & fits[1]]
    return [c[found] for c in columns]


def count_filters(docs: DataFrame, words: int, bits: int, attempt: int, frequent: Members,
                  shorter: Members | None, segment_bits: int, min_count: int = 1,
                  text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, segment, filter): merged counting quotient filters of all phrases of ``words`` words.

    Phrases with a word that ``frequent`` does not know, or with a part that ``shorter`` does not
    know, are left out, and of the merged ones those below ``min_count``. A segment holds
    the phrases whose permuted n-gram begins with its ``segment_bits`` bits, a share of all that
    does not depend on how often any of them occurs.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Ids] = {}
        waiting: dict[str, list] = {}
        filters: dict[str, CountingFilter] = {}
        n = 0

        def fold():
            for name, parts in waiting.items():
                new = CountingFilter.of_ids([np.concatenate(c) for c in zip(*parts)], bits)
                filters[name] = CountingFilter.merge([filters[name], new]
                                                     if name in filters else [new])
            waiting.clear()

        def out():
            for name, one in filters.items():
                parts = one.segments(segment_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(parts), pa.string()), pa.array([s for s, _ in parts], pa.int32()),
                     pa.array([p.to_bytes(segment_bits, s) for s, p in parts], pa.binary())],
                    names=["lang", "segment", "filter"])
            filters.clear()

        for name, data in _by_lang(batches):
            ids = known.setdefault(name, _Ids(name, bits, attempt, frequent))
            if sum(map(len, known.values())) > HELD_WORDS:
                known = {name: ids}
            tail = np.empty(0, _U)
            for piece in _pieces(data):
                tail = np.concatenate([tail, ids.of(piece)])
                grams = _grams(tail, words, _seed(name), shorter)
                waiting.setdefault(name, []).append(grams)
                n += len(grams[0])
                tail = tail[len(tail) - words + 1:] if len(tail) >= words else tail
                if n > HELD_GRAMS:
                    fold()
                    n = 0
                    if sum(map(len, filters.values())) > HELD_ENTRIES:
                        yield from out()
        fold()
        yield from out()

    def merge(table: pa.Table) -> pa.Table:
        one = CountingFilter.merge([CountingFilter.from_bytes(f.as_py())
                                    for f in table["filter"]]).at_least(min_count)
        head = table.slice(0, 1 if len(one) else 0)
        segment = table["segment"][0].as_py()
        return head.set_column(2, "filter", pa.array([one.to_bytes(segment_bits, segment)] * len(head),
                                                     pa.binary()))

    schema = "lang string, segment int, filter binary"
    return (docs.select(_lang(F.col(lang)).alias("lang"), F.col(text).alias("text"))
            .mapInArrow(fill, schema).groupBy("lang", "segment").applyInArrow(merge, schema))


def phrases_of(filters: DataFrame) -> DataFrame:
    """(lang, ids, a, hash): the phrases of merged filters, their counts and their ``gram_hash``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                one = CountingFilter.from_bytes(data.as_py())
                ids = one.ids()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(one), pa.string()),
                     pa.FixedSizeListArray.from_arrays(
                         pa.array(np.stack(ids, 1).view(np.int64).reshape(-1)), len(ids)
                     ).cast(pa.list_(pa.int64())),
                     pa.array(one.counts), pa.array(gram_hash(ids, _seed(lang)).view(np.int64))],
                    names=["lang", "ids", "a", "hash"])

    return filters.mapInArrow(read, "lang string, ids array<long>, a long, hash long")


def _counted(docs: DataFrame, words: DataFrame, max_words: int, min_count: int,
             text: str, lang: str) -> dict[int, DataFrame]:
    """Frequent phrases by their number of words: lang, ids, words, a, and as ``first`` and ``last``
    the counts of their first and last 1, 2, ... words."""
    bits, attempt = id_scheme(words, min_count)
    total = words.agg(F.sum("n")).first()[0] or 0
    segment_bits = min(24, max(0, (total // SEGMENT_GRAMS).bit_length()))
    often = written(words.filter(F.col("n") >= min_count).withColumn("hash", word_hash(attempt)),
                    "frequent-words")
    found = {1: often.select("lang", F.array(_id(F.col("hash"), bits)).alias("ids"),
                             F.array("word").alias("words"), F.col("n").alias("a"),
                             F.array("n").alias("first"), F.array("n").alias("last"))}
    frequent, shorter = Members(often, "hash"), None
    for n in range(2, max_words + 1):
        filters = count_filters(docs, n, bits, attempt, frequent, shorter, segment_bits,
                                min_count, text, lang)
        plain = written(phrases_of(filters), f"phrases-{n}")
        if n < max_words:
            shorter = Members(plain, "hash")
        head, tail = (found[n - 1].select(
            F.col("lang").alias(f"_lang{e}"), F.col("ids").alias(f"_ids{e}"),
            *[F.col(c).alias(f"_{c}{e}") for c in columns])
            for e, columns in (("h", ("words", "first")), ("t", ("words", "last"))))
        joined = plain.join(head, (F.col("lang") == F.col("_langh"))
                            & (F.slice("ids", 1, n - 1) == F.col("_idsh")))
        joined = joined.join(tail, (F.col("lang") == F.col("_langt"))
                             & (F.slice("ids", 2, n - 1) == F.col("_idst")))
        found[n] = written(joined.select(
            "lang", "ids", F.concat("_wordsh", F.slice("_wordst", -1, 1)).alias("words"), "a",
            F.concat("_firsth", F.array("a")).alias("first"),
            F.concat("_lastt", F.array("a")).alias("last")), f"collocations-{n}")
    return found


def _exact(c: Column) -> Column:
    return c.cast("decimal(16,0)")


def _scored(phrases: DataFrame, n: int) -> DataFrame:
    """The cut with the lowest score, and of equal ones the first."""
    cuts = []
    for k in range(1, n):
        left, right = F.col("first")[k - 1], F.col("last")[n - k - 1]
        # a * a * 1000000 has at most 38 digits for counts of 16 digits
        above = _exact(F.col("a")) * _exact(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)")
        cuts.append(F.struct(
            F.call_function("div", above.cast("decimal(38,0)"),
                            (_exact(left) * _exact(right)).cast("decimal(38,0)")).alias("score"),
            F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return phrases.withColumn("cut", F.array_min(F.array(*cuts)))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                 top: int = TOP, inside_percent: int = INSIDE_PERCENT, text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each language by how they stick together.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at
    spaces and tabs; phrases lie within pieces. A candidate occurs ``min_count`` (2 or more) times
    in its language. Cut into two parts that occur l and r times, a phrase that occurs a times scores
    floor(10^6 a a / (l r)); the lowest-scoring cut counts, of equal ones the first. A candidate
    contained in a longer one with ``inside_percent`` of its count or more is dropped.

    Returns lang, rank (from 1), phrase, a, l, r, n (words of the language) and score, ordered
    within a language by score and a descending and by phrase in byte order. NULL texts are empty
    and a NULL language is ``und``; languages without candidates and empty tables give no rows.
    Repeated rows count as often as they occur. Other columns of ``docs`` are not read.
    """
    words = written(word_counts(docs, text, lang), "words")
    found = _counted(docs, words, max_words, min_count, text, lang)
    parts = []
    for n in range(2, max_words + 1):
        scored = _scored(found[n], n)
        if n < max_words:
            # a phrase inside a longer one is also inside a phrase one word longer, no less frequent
            longer = found[n + 1].select(
                F.col("lang").alias("_lang"), F.col("a").alias("_a"), F.explode(F.array(
                    F.slice("ids", 1, n), F.slice("ids", 2, n))).alias("_ids"))
            most = longer.groupBy("_lang", "_ids").agg(F.max("_a").alias("_most"))
            scored = scored.join(most, (F.col("lang") == F.col("_lang"))
                                 & (F.col("ids") == F.col("_ids")), "left").filter(
                F.col("_most").isNull()
                | (_exact(F.col("_most")) * 100 < _exact(F.col("a")) * inside_percent))
        parts.append(scored.select("lang", F.array_join("words", " ").alias("phrase"), "a",
                                   "cut.l", "cut.r", "cut.score"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # the best of a language are among the best of its parts, so no task orders a whole language
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = every.withColumn("_part", part).withColumn("rank", F.row_number().over(
        W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(
        W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"))
    return best.join(totals, F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    def words(first: int, last: int) -> str:
        return " || ' ' || ".join(f"w[{i}]" for i in range(first, last + 1))

    counts = " UNION ALL ".join(
        f"SELECT lang, {n} AS size, unnest(list_transform(range(1, len(w) - {n - 2}), "
        f"lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase FROM pieces"
        for n in range(1, MAX_WORDS + 1))
    cuts = " UNION ALL ".join(
        f"SELECT c.lang, c.size, c.phrase, c.a, {k} AS k, x.a AS l, y.a AS r, "
        f"CAST((1000000 * c.a::HUGEINT * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score "
        f"FROM (SELECT *, {words(1, k)} AS p, {words(k + 1, n)} AS q FROM candidates "
        f"WHERE size = {n}) c JOIN counted x ON x.lang = c.lang AND x.size = {k} AND x.phrase = c.p "
        f"JOIN counted y ON y.lang = c.lang AND y.size = {n - k} AND y.phrase = c.q"
        for n in range(2, MAX_WORDS + 1) for k in range(1, n))
    inside = " UNION ALL ".join(
        f"SELECT lang, {words(s, s + size - 1)} AS phrase, a FROM candidates WHERE size = {n}"
        for n in range(3, MAX_WORDS + 1) for size in range(2, n) for s in range(1, n - size + 2))
    return f"""
WITH normalised AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
    '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]') AS parts
  FROM documents),
pieces AS (
  SELECT lang, list_filter(string_split_regex(part, '[\\x20\\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(parts) AS part FROM normalised)),
counted AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS a FROM ({counts}) GROUP BY ALL),
candidates AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE size >= 2 AND a >= {MIN_COUNT}),
inside AS (SELECT lang, phrase, max(a) AS most FROM ({inside}) GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
best AS (
  SELECT * FROM ({cuts})
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (
    PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.most IS NULL OR 100 * i.most < {INSIDE_PERCENT} * b.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""
