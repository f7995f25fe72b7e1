"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by its own permutation, ``offset + j * skip``, and
the shards take turns claiming their next free slot until the table is full. A row goes to
the shard that holds the slot of its key's hash. Shards then hold slots to within one of each
other, and when a shard joins or leaves, few slots change hands among the rest.

The table's size is a parameter and does not grow with the data; it is filled once,
broadcast, and a row is placed by one look-up, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeflow.llm.common import free_name

# fixed size of the production table: a prime, and over a hundred slots per shard
SLOTS = 2053
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
# hex digits of the md5 that make a number
_DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16)


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[str]:
    """The shard of every slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be given and differ")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("the number of slots must be a prime, no less than that of shards")
    # with a prime size, any skip visits every slot
    place = [_number(f"{s}|offset") % slots for s in shards]
    skip = [_number(f"{s}|skip") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table: list[str | None] = [None] * slots
    left = slots
    while left:
        for i, shard in enumerate(shards):
            while table[place[i]] is not None:
                place[i] = (place[i] + skip[i]) % slots
            table[place[i]] = shard
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table, held in the plan itself."""
    numbers = {s: i for i, s in enumerate(shards)}
    filled = ",".join(str(numbers[s]) for s in fill_table(shards, slots))
    names = F.array(*[F.lit(s) for s in shards])
    return (spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "_n"))
            .select("slot", F.get(names, F.col("_n").cast("int")).alias("shard")))


def slot_of(keys: Sequence[Column], slots: int = SLOTS) -> Column:
    """The slot of a row: an md5 of its keys, a NULL key being the text ``\\N``."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys])
    number = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")
    return (number % F.lit(slots)).cast("int")


def shard_rows(df: DataFrame, keys: Sequence[str], shards: Sequence[str] = SHARDS,
               slots: int = SLOTS, spread: int = 1) -> DataFrame:
    """Every row of ``df`` with its ``slot`` and ``shard``.

    Rows with equal keys share a slot; NULL is a key value like others, empty tables give no
    rows, repeated rows stay. Where a key may be so hot that its shard would overflow,
    ``spread`` cuts every key into so many parts by a hash of the whole row.
    """
    columns = [F.col(k) for k in keys]
    if spread > 1:
        columns.append(F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    slot, shard, own = (free_name(df, c) for c in ("slot", "shard", "_table_slot"))
    table = table_frame(df.sparkSession, shards, slots).toDF(own, shard)
    placed = df.withColumn(slot, slot_of(columns, slots))
    return placed.join(F.broadcast(table),  # `slots` rows
                       F.col(slot) == F.col(own)).select(*df.columns, slot, shard)


def oracle() -> str:
    """The same placement in SQL, the table being filled turn by turn by recursion."""
    names = ", ".join(f"'{s}'" for s in SHARDS)
    number = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE names AS (SELECT [{names}] AS shards),
prefs AS (
  SELECT list_transform(shards, lambda s: {number.format("s || '|offset'")} % {SLOTS}) AS offsets,
         list_transform(shards, lambda s: {number.format("s || '|skip'")} % {SLOTS - 1} + 1) AS skips
  FROM names),
turns AS (
  SELECT 0 AS turn, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT turn + 1, list_append(taken, list_filter(
    list_transform(range({SLOTS}), lambda j: (offsets[turn % {len(SHARDS)} + 1]
                                         + j * skips[turn % {len(SHARDS)} + 1]) % {SLOTS}),
    lambda p: NOT list_contains(taken, p))[1])
  FROM turns, prefs WHERE turn < {SLOTS}),
filled AS (SELECT taken FROM turns WHERE turn = {SLOTS}),
slots AS (SELECT unnest(taken) AS slot, unnest(range({SLOTS})) % {len(SHARDS)} AS n FROM filled)
SELECT d.doc_id, CAST(s.slot AS INTEGER) AS slot, names.shards[s.n + 1] AS shard
FROM documents d, names, slots s
WHERE s.slot = {number.format("coalesce(CAST(d.doc_id AS VARCHAR), chr(92) || 'N')")} % {SLOTS}"""
