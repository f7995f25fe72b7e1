"""Packing into optimal length buckets.

A batch pads its documents to the upper bound of their bucket. Dynamic programming over the
histogram of all lengths chooses the bounds of ``buckets`` buckets with the least padding. Inside a
bucket, documents in a hashed order fill batches of as many documents as the token budget allows at
the bucket's bound.

The histogram is exact for lengths below ``2 ** PRECISION`` and has ``2 ** (PRECISION - 1)`` cells
per doubling above; a cell knows its documents, tokens and greatest length, so padding is counted
exactly and bounds are lengths that occur. The driver thus sees at most a few thousand
cells, however many documents there are and however long they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import attach, free_name, key_sql, row_key, total_before, written
from gaugeflow.llm.mixing import token_count

BUCKETS = 16
BATCH_TOKENS = 1 << 15
PRECISION = 11


def cell(length: Column, precision: int = PRECISION) -> Column:
    """The histogram cell of a length: itself with all but its leading bits cleared."""
    # 0 for lengths below 2 ** precision, else the number of bits to clear
    digits = F.length(F.conv(length.cast("string"), 10, 2))
    drop = F.greatest(F.lit(0), digits - F.lit(precision))
    step = F.pow(F.lit(2.0), drop).cast("long")
    return (F.floor(length / step) * step).cast("long")


def histogram(lengths: DataFrame, length: str, precision: int = PRECISION) -> DataFrame:
    """(cell, n, tokens, longest) over all rows, summed in tasks before the shuffle."""
    return (lengths.groupBy(cell(F.col(length), precision).alias("cell"))
            .agg(F.count("*").alias("n"), F.sum(length).alias("tokens"),
                 F.max(length).alias("longest")))


def optimal_bounds(cells: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds that minimise padding, from (longest, n, tokens) cells in ascending order.

    ``best[j]`` is the least padding of the first j cells; a bucket over cells i..j-1 pads
    ``longest[j-1] * n - tokens``. As that cost is concave, the best split moves right with j
    and each layer is filled by halving. Of equal splits the leftmost is taken; fewer cells than
    buckets give a bound each.
    """
    if not cells:
        return []
    longest, n, tokens = (np.array(c, np.int64) for c in zip(*cells))
    docs, mass = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(tokens))
    m = len(cells)
    if m <= buckets:
        return longest.tolist()
    best = longest * docs[1:] - mass[1:]
    best = np.append(0, best)
    splits = []
    for used in range(2, buckets + 1):
        found, split = best.copy(), np.zeros(m + 1, np.int64)
        todo = [(used, m, used - 1, m - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            cost = best[i] + longest[j - 1] * (docs[j] - docs[i]) - (mass[j] - mass[i])
            at = int(np.argmin(cost))
            found[j], split[j] = cost[at], i[at]
            todo += [(lo, j - 1, left, int(i[at])), (j + 1, hi, int(i[at]), right)]
        best = found
        splits.append(split)
    bounds, j = [], m
    for split in reversed(splits):
        bounds.append(int(longest[j - 1]))
        j = int(split[j])
    bounds.append(int(longest[j - 1]))
    return bounds[::-1]


def length_bounds(lengths: DataFrame, length: str, buckets: int = BUCKETS,
                  precision: int = PRECISION) -> tuple[list[int], int]:
    """The optimal bounds and the number of rows."""
    rows = sorted(tuple(r) for r in histogram(lengths, length, precision).toLocalIterator())
    return optimal_bounds([(r[3], r[1], r[2]) for r in rows], buckets), sum(r[1] for r in rows)


def placements(docs: DataFrame, text: str = "text", id_column: str = "doc_id",
               buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS,
               precision: int = PRECISION, seed: int = 1) -> DataFrame:
    """Where every row goes: row_key, id, n_tokens, bucket, bucket_length, batch, slot.

    A document is its words and an end mark long; a NULL or empty text is one token. A batch
    (``batch`` counts from 0 in its bucket) holds ``batch_tokens // bucket_length``
    documents, one if the bound exceeds the budget; only a bucket's last batch may hold fewer.
    Documents of a bucket come in the order of an md5 of id, text and seed; rows equal in both follow
    one another. An empty table gives no rows.
    """
    rows = written(docs.select(
        row_key(seed, F.col(id_column), F.col(text)).alias("row_key"),
        F.col(id_column).alias("id"), token_count(F.col(text)).alias("n_tokens")), "lengths")
    bounds, size = length_bounds(rows, "n_tokens", buckets, precision)
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    placed = (rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("n_tokens"))))
              .withColumn("bucket_length", F.get(edges, F.col("bucket")))
              .withColumn("_one", F.lit(1)))
    ranked = total_before(placed, ["bucket"], "row_key", "_one", "_rank", size)
    fits = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bucket_length"))).cast("long")
    return ranked.select("row_key", "id", "n_tokens", "bucket", "bucket_length",
                         F.floor(F.col("_rank") / fits).cast("long").alias("batch"),
                         (F.col("_rank") % fits).cast("long").alias("slot"))


def pack(docs: DataFrame, text: str = "text", id_column: str = "doc_id", seed: int = 1,
         **limits) -> DataFrame:
    """Rows of ``docs`` with a struct ``pack``: n_tokens, bucket, bucket_length, batch, slot.

    See ``placements`` for the limits and for what becomes of NULLs, ties and repeated rows.
    """
    found = placements(docs, text, id_column, seed=seed, **limits)
    out = free_name(docs, "pack")
    placed = found.select(F.col("row_key").alias("_pack_key"), F.struct(
        "n_tokens", "bucket", "bucket_length", "batch", "slot").alias(out))
    key = row_key(seed, F.col(id_column), F.col(text))
    return attach(docs, placed, key, "_pack_key", [], out)


def oracle() -> str:
    """The packing of ``documents`` with the default limits in SQL, one query per layer of the
    dynamic programme."""
    span = 1 << 20  # a cost and the split it comes from are one number
    layers = [f"""
layer1 AS (SELECT j, CAST(longest * docs - mass AS HUGEINT) * {span} AS v FROM sums)"""]
    for k in range(2, BUCKETS + 1):
        layers.append(f"""
layer{k} AS MATERIALIZED (
  SELECT b.j, min((a.v // {span} + b.longest * (b.docs - c.docs) - (b.mass - c.mass)) * {span}
    + a.j) AS v
  FROM layer{k - 1} a JOIN sums c ON a.j = c.j JOIN sums b ON b.j > a.j GROUP BY b.j)""")
    ends = [f"end{BUCKETS} AS (SELECT max(j) AS j FROM sums)"]
    for k in range(BUCKETS, 1, -1):
        ends.append(f"end{k - 1} AS (SELECT v % {span} AS j FROM layer{k} "
                    f"WHERE j = (SELECT j FROM end{k}))")
    ends_of = " UNION ALL ".join(f"SELECT j FROM end{k}" for k in range(1, BUCKETS + 1))
    return rf"""
WITH lengths AS (
  SELECT doc_id, {key_sql(1, "CAST(doc_id AS VARCHAR)", "text")} AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n
  FROM documents),
cells AS (
  SELECT max(n) AS longest, count(*) AS docs, sum(n) AS mass FROM lengths
  GROUP BY n // (1 << greatest(0, length(bin(n)) - {PRECISION})), length(bin(n))),
sums AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY longest) AS j, longest,
         sum(docs) OVER (ORDER BY longest) AS docs, sum(mass) OVER (ORDER BY longest) AS mass
  FROM cells),{",".join(layers)},
{", ".join(ends)},
bounds AS (SELECT longest AS bound FROM sums WHERE j IN ({ends_of})),
placed AS (
  SELECT doc_id, k, n, (SELECT count(*) FROM bounds WHERE bound < n) AS bucket,
         (SELECT min(bound) FROM bounds WHERE bound >= n) AS bound FROM lengths),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY k) - 1 AS r,
         greatest(1, {BATCH_TOKENS} // bound) AS fits FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(bucket AS INTEGER) AS bucket,
       CAST(bound AS BIGINT) AS bucket_length, CAST(r // fits AS BIGINT) AS batch,
       CAST(r % fits AS BIGINT) AS slot
FROM ranked"""
