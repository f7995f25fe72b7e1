"""Shared pieces: words, folds, written tables and running totals in bounded windows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
# rows that share a window when running totals are formed
ROWS_PER_BIN = 1024


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then uses /tmp/checkpoints.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return "/tmp/checkpoints"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe when executors are lost."""
    path = f"{checkpoint_root(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def words(text: Column) -> Column:
    """Number of words of a text; 0 if there is none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(seed: int, *columns: Column) -> Column:
    """A hash by which rows are ordered at random; equal only for rows equal in the columns.

    Every value goes in with its length, a NULL as N, so that no two rows are spelt alike.
    """
    values = [c.cast("string") for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(
        F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("N")) for v in values]))


def key_sql(seed: int, *columns: str) -> str:
    """``row_key`` in SQL."""
    return f"md5(concat_ws('|', '{seed}', " + ", ".join(
        f"coalesce(length({c}) || ':' || {c}, 'N')" for c in columns) + "))"


def attach(docs: DataFrame, placed: DataFrame, key: Column, key_column: str, within: list[str],
           order: str) -> DataFrame:
    """Join placements to the rows of ``docs`` they are for, by ``key``.

    Rows with the same key are told apart by numbers that both sides give to them: by ``order`` among
    the placements with equal ``within``, by a hash of all columns among the documents.
    """
    k, c = free_name(docs, "_key"), free_name(docs, "_copy")
    numbered = docs.withColumn(k, key).withColumn(c, F.row_number().over(
        W.partitionBy(k).orderBy(F.xxhash64(*docs.columns))))
    copies = placed.withColumn("_nth", F.row_number().over(
        W.partitionBy(key_column, *within).orderBy(order)))
    return numbered.join(copies, (F.col(k) == F.col(key_column)) & (F.col(c) == F.col("_nth"))
                         ).drop(k, c, key_column, "_nth")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; NULL for a row without an id."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def hash_share(hexed: Column, digits: int = 8) -> Column:
    """The first hex digits of a hash as a fraction in [0, 1)."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("long") / F.lit(float(16 ** digits))


def total_before(df: DataFrame, groups: Sequence[str], order: str, weight: str, out: str,
                 rows: int, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of a group that come earlier by ``order``.

    ``order`` is a string of hex digits spread evenly, such as an md5. Its leading bits
    cut a group into bins of about ``rows_per_bin`` rows, and bins into as many spans as
    a span has bins; totals run over spans, over the bins of a span and over the rows of a bin, so
    that no window holds a whole group however many of the ``rows`` it has. Groups may be NULL. Rows
    of a group with the same ``order`` follow one another in any order.
    """
    bits = min(32, max(0, math.ceil(math.log2(max(1, rows) / rows_per_bin)) if rows else 0))
    fine, coarse = 2 ** bits, 2 ** (bits // 2)
    cells = df.withColumn("_bin", F.floor(hash_share(F.col(order)) * fine).cast("long"))
    keys = [*groups, "_bin"]
    sums = (cells.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
            .withColumn("_span", F.floor(F.col("_bin") * coarse / fine).cast("long")))
    spans = (sums.groupBy(*groups, "_span").agg(F.sum("_sum").alias("_sum"))
             .withColumn("_spans", F.coalesce(F.sum("_sum").over(
                 W.partitionBy(*groups).orderBy("_span").rowsBetween(
                     W.unboundedPreceding, -1)), F.lit(0))).drop("_sum"))
    sums = sums.withColumn("_bins", F.coalesce(F.sum("_sum").over(
        W.partitionBy(*groups, "_span").orderBy("_bin").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)))
    starts = same(sums, spans, [*groups, "_span"]).select(
        *keys, (F.col("_bins") + F.col("_spans")).alias("_start"))
    inner = F.coalesce(F.sum(weight).over(W.partitionBy(*keys).orderBy(order).rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    joined = same(cells.withColumn("_inner", inner), starts, keys)
    return joined.withColumn(out, F.col("_inner") + F.col("_start")).drop("_inner", "_start", "_bin")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys come from the left."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c)
                           for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    return left.join(right, on, how).drop(*[f"_r_{c}" for c in keys])
