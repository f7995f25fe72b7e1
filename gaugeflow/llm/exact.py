"""Exact duplicates with a heavy-hitter split.

Texts are the same if they are equal after lower-casing A-Z. Every row is reduced to its id and
the SHA-256 of its normalised text. Misra-Gries summaries (Misra and Gries 1982; merged as in Agarwal
et al. 2012), one per task, find the digests that a large share of all rows may have; a second pass
counts these exactly. The verified ones are at most ``1 / heavy_share``, whatever the number of
rows, so they are broadcast with the row that stays, and their copies are settled where they are
read. All other digests are rarer than ``heavy_share`` of the rows and meet by an ordinary shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeflow.llm.common import free_name, written

HEAVY_SHARE = 1 / 1024
# counters of a Misra-Gries summary for each digest that may be heavy; the estimate falls short of the
# count by at most a quarter of the share
COUNTERS_PER_HEAVY = 4


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of a text after lower-casing A-Z; NULL counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase,
                          string.ascii_lowercase)
    return F.unhex(F.sha2(lowered, 256))


def reduce_counters(keys: pa.Array, counts: np.ndarray, counters: int) -> tuple[pa.Array, np.ndarray]:
    """A summary of at most ``counters`` entries: all lose the largest count that has no place."""
    if len(keys) <= counters:
        return keys, counts
    cut = np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
    left = counts > cut
    return keys.filter(pa.array(left)), counts[left] - cut


def misra_gries(digests: DataFrame, column: str, counters: int) -> DataFrame:
    """(digest, n): a lower bound of each frequent digest's count, short by n / counters at most.

    Each task keeps one summary; the summaries' counters are added up. Every digest
    with more than 1 / ``counters`` of the rows is among them.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = pa.array([], pa.binary()), np.empty(0, np.int64)
        for batch in batches:
            seen = batch.column(0).value_counts()
            both = pa.table({
                "k": pa.concat_arrays([keys, seen.field("values").cast(pa.binary())]),
                "n": np.concatenate([counts, seen.field("counts").to_numpy()])
            }).group_by("k").aggregate([("n", "sum")]).combine_chunks()
            if both.num_rows:
                keys, counts = reduce_counters(both["k"].chunk(0), both["n_sum"].to_numpy(),
                                               counters)
        yield pa.RecordBatch.from_arrays([keys, pa.array(counts)], names=["digest", "n"])

    return (digests.select(column).mapInArrow(summarise, "digest binary, n long")
            .groupBy("digest").agg(F.sum("n").alias("n")))


def heavy_groups(rows: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """The groups of two or more rows with at least ``heavy_share`` of all rows.

    ``rows`` has (digest, id, hash, row). Returns one row per such digest: its exact number of rows,
    and as ``best`` the row that stays. There are at most ``1 / heavy_share`` of them.
    """
    total = rows.count()
    counters = int(COUNTERS_PER_HEAVY / heavy_share)
    least = total * heavy_share
    candidates = misra_gries(rows, "digest", counters).filter(
        F.col("n") >= least - total / (counters + 1)).select("digest")
    found = rows.join(F.broadcast(written(candidates, "frequent")), "digest", "left_semi")
    return _groups(found).filter((F.col("group_size") >= least) & (F.col("group_size") > 1))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max(F.struct("id", "hash", "row")).alias("best"),
                                      F.count("*").alias("group_size"))


def _reduced(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, digest, hash, row) of every row: hash over all columns, and a number of its own."""
    return written(docs.select(
        F.col(id_column).alias("id"), digest(F.col(text)).alias("digest"),
        F.xxhash64(*docs.columns).alias("hash"), F.monotonically_increasing_id().alias("row")),
        "digests")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                     heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of rows with equal texts the one with the largest id stays; a NULL id is less than any other, and
    ``keep_id`` is NULL only if no row of the group has an id. Among rows that share the largest id,
    one stays: the one with the greatest hash over all columns, and of rows equal in every
    column any one. NULL texts are empty texts. An empty table gives no rows.
    """
    rows = _reduced(docs.select(id_column, text), id_column, text)
    heavy = written(heavy_groups(rows, heavy_share), "heavy")
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    group = W.partitionBy("digest")
    light = marked.filter(F.col("group_size").isNull()).withColumns({
        "best": F.max(F.struct("id", "hash", "row")).over(group),
        "group_size": F.count("*").over(group)})
    return marked.filter(F.col("group_size").isNotNull()).unionByName(light).select(
        F.col("id").alias(id_column), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                       heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns.

    Copies of a heavy text are removed where they are read and never shuffled. Choices and
    special cases are those of ``exact_duplicates``.
    """
    rows = _reduced(docs, id_column, text)
    heavy = written(heavy_groups(rows, heavy_share), "heavy")
    light = _groups(rows.join(F.broadcast(heavy), "digest", "left_anti"))
    chosen = heavy.withColumn("heavy", F.lit(True)).unionByName(light.withColumn("heavy", F.lit(False)))
    # how many rows equal the chosen one in every column
    twins = written(rows.join(chosen, "digest").filter(
        F.col("id").eqNullSafe(F.col("best.id")) & (F.col("hash") == F.col("best.hash")))
        .groupBy("digest", "heavy", "id", "hash").agg(F.count("*").alias("twins")), "chosen")
    d, h, n = (free_name(docs, c) for c in ("_digest", "_hash", "_twins"))
    marked = docs.withColumns({d: digest(F.col(text)), h: F.xxhash64(*docs.columns)})
    first = F.broadcast(twins.filter("heavy").select(F.col("digest").alias("_d"), "id",
                                                     F.col("hash").alias("_h"), F.col("twins").alias(n)))
    rest = twins.filter("not heavy").select(F.col("digest").alias("_d2"), F.col("id").alias("_id2"),
                                            F.col("hash").alias("_h2"), F.col("twins").alias("_n2"))
    frequent = marked.join(first, F.col(d) == F.col("_d"), "left")
    stay = (frequent.filter(F.col("_d").isNotNull() & (F.col(h) == F.col("_h"))
                            & F.col(id_column).eqNullSafe(F.col("id")))
            .select(*docs.columns, n)
            .unionByName(frequent.filter(F.col("_d").isNull()).select(*docs.columns, d, h).join(
                rest, (F.col(d) == F.col("_d2")) & (F.col(h) == F.col("_h2"))
                & F.col(id_column).eqNullSafe(F.col("_id2"))).select(
                *docs.columns, F.col("_n2").alias(n))))
    stay = stay.select(*docs.columns, n)
    return (stay.filter(F.col(n) == 1).unionByName(stay.filter(F.col(n) > 1).dropDuplicates())
            .drop(n))


def oracle() -> str:
    return f"""
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}',
                           '{string.ascii_lowercase}') AS t
  FROM documents),
numbered AS (
  SELECT doc_id, sha256(t) AS text_sha256,
         count(*) OVER (PARTITION BY t) AS group_size, max(doc_id) OVER (PARTITION BY t) AS keep_id,
         row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS place
  FROM rows)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM numbered
"""
