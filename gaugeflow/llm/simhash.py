"""SimHash near-duplicates by the pigeonhole principle.

A document's fingerprint has 64 bits; each is the majority over the hashes of its word shingles.
Fingerprints within ``max_bits`` differing bits are linked. With the 64 bits cut into
``blocks`` pieces, such a pair agrees on ``blocks - max_bits`` whole pieces, so candidates
share one of the combinations of that many pieces; each candidate's distance is then verified.

Work is done on distinct fingerprints: exact copies meet in a partial aggregation and
never in a join of pairs. Fingerprints that share a combination are compared in groups of
bounded size: a larger group is cut into chunks, each pair of chunks is a group of its
own, and a group gives a spanning forest of its links instead of all its pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import free_name, written
from gaugeflow.llm.components import connected_components

BITS = 64
SHINGLE_WORDS = 3
MAX_BITS = 3
BLOCKS = 6
CHUNK = 256
SEED = 42
# bits of the shingle hashes that are counted at once; bounds memory for a very long text
HASHES_AT_ONCE = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    shingles = iter([b" ".join(words)]) if len(words) <= shingle_words else map(
        b" ".join, zip(*[words[i:] for i in range(shingle_words)]))
    ones, n = np.zeros(BITS, np.int64), 0
    while hashes := [xxhash.xxh64_intdigest(s, SEED)
                     for s in itertools.islice(shingles, HASHES_AT_ONCE)]:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def simhash(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long; 0 for a text that is NULL or has no word."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py(), shingle_words) for t in texts],
                                 np.uint64).view(np.int64))

    return fingerprints(text)


def _combinations(blocks: int, max_bits: int) -> list[int]:
    """One bit mask (signed) per combination of the blocks on which a close pair may agree."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    found = [sum(c) for c in itertools.combinations(masks, blocks - max_bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the values into the components of 'at most max_bits bits differ'."""
    root, bits = np.arange(len(values)), values.view(np.uint64)  # of a negative number, the bits of its absolute value would count
    links = []
    for i in range(1, len(values)):
        near = np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= max_bits)
        for r in np.unique(root[near]):
            # each component met so far is joined through one verified link
            links.append((int(values[near[root[near] == r][0]]), int(values[i])))
            root[root == r] = i
    return links


def close_links(fingerprints: DataFrame, column: str, max_bits: int = MAX_BITS,
                blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): verified links that span the components of the distinct fingerprints."""
    if not max_bits < blocks <= BITS:
        raise ValueError("blocks must be more than max_bits")
    masks = F.array(*[F.lit(m) for m in _combinations(blocks, max_bits)])
    keyed = fingerprints.select(F.col(column).alias("_f")).distinct().select(
        "_f", F.posexplode(masks).alias("_c", "_mask")).select(
        "_f", "_c", F.col("_f").bitwiseAND(F.col("_mask")).alias("_key"))
    shared = (keyed.groupBy("_c", "_key").agg(F.count("*").alias("_n")).filter("_n > 1")
              .withColumn("_chunks", F.ceil(F.col("_n") / chunk).cast("int"))
              .select(F.col("_c").alias("_c2"), F.col("_key").alias("_key2"), "_chunks"))
    own = F.pmod(F.xxhash64("_f"), F.col("_chunks")).cast("int")
    # the planner does not know how many keys a fingerprint has, so it must not broadcast them
    grouped = (keyed.join(shared.hint("merge"), (F.col("_c") == F.col("_c2")) & (F.col("_key") == F.col("_key2")))
               .withColumn("_own", own)
               .select("_f", "_c", "_key", "_own",
                       F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other"))
               .groupBy("_c", "_key", F.least("_own", "_other").alias("_lo"),
                        F.greatest("_own", "_other").alias("_hi"))
               .agg(F.collect_list("_f").alias("_fs")))

    @F.arrow_udf("array<struct<a:long,b:long>>")
    def spans(groups: pa.Array) -> pa.Array:
        found = []
        for g in groups:
            values = np.sort(g.values.to_numpy(zero_copy_only=False))
            if len(values) == 2:
                a, b = int(values[0]), int(values[1])
                near = ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits
                found.append([{"a": a, "b": b}] if near else [])
            else:
                found.append([{"a": a, "b": b} for a, b in forest(values, max_bits)])
        return pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return grouped.select(F.inline(spans("_fs"))).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Every row of ``docs`` with its ``fingerprint`` and its group.

    Returns all columns of ``docs`` but the text, and ``fingerprint`` (16 hex digits) and
    ``component_id``: the least id reachable over links, the row's own included. Rows
    without a word have the fingerprint 0 and link like any other. A NULL id never is a component's
    id unless a component has no other. Repeated rows stay; an empty table gives none.
    """
    f, out = free_name(docs, "_fp"), free_name(docs, "component_id")
    kept = [c for c in docs.columns if c != text]
    prints = written(docs.select(*kept, simhash(F.col(text)).alias(f)), "fingerprints")
    grouped = components(prints, f, id_column, max_bits, blocks).withColumnsRenamed(
        {"fp": "_gfp", "least": out})
    return prints.join(grouped, F.col(f) == F.col("_gfp")).select(
        *kept, F.lpad(F.lower(F.hex(f)), 16, "0").alias(free_name(docs, "fingerprint")), out)


def components(prints: DataFrame, column: str, id_column: str, max_bits: int = MAX_BITS,
               blocks: int = BLOCKS) -> DataFrame:
    """(fp, least): per distinct fingerprint, the least id of its component."""
    ids = prints.groupBy(F.col(column).alias("fp")).agg(F.min(id_column).alias("_id"))
    roots = connected_components(close_links(prints, column, max_bits, blocks))
    rooted = ids.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "_id", F.coalesce("root", "fp").alias("_root"))
    least = rooted.groupBy(F.col("_root").alias("_r")).agg(F.min("_id").alias("least"))
    return rooted.join(least, F.col("_root") == F.col("_r")).select("fp", "least")


def one_per_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                  max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs`` that stay when each near-duplicate group keeps one document.

    It is the row with the least id; among rows that share it, the least by a hash of all columns, and
    rows equal in every column count once. A group without any id keeps the least hash.
    """
    f, h, g, i = (free_name(docs, c) for c in ("_fp", "_hash", "_group", "_least"))
    columns = list(docs.columns)
    marked = docs.select("*", F.xxhash64(*columns).alias(h))
    prints = written(marked.select(F.col(id_column).alias("_id"), h,
                                   simhash(F.col(text)).alias(f)), "fingerprints")
    roots = connected_components(close_links(prints, f, max_bits, blocks))
    rooted = prints.join(roots, F.col(f) == F.col("node"), "left").select(
        "_id", h, F.coalesce("root", f).alias(g))
    best = rooted.groupBy(g).agg(F.min(F.struct(F.col("_id").isNull(), "_id", h)).alias("_best"))
    chosen = best.select(F.col("_best._id").alias(i), F.col(f"_best.{h}").alias("_h")).distinct()
    # one key only, so that the last step finds its rows together without another exchange
    same_id = F.coalesce(F.col(id_column) == F.col(i),
                         F.col(id_column).isNull() & F.col(i).isNull())
    stay = marked.join(chosen, (F.col(h) == F.col("_h")) & same_id, "left_semi")
    return stay.dropDuplicates().drop(h)
