"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into segments and indexed by the value of each segment. A query
looks up, segment by segment, all values at radius 0, then 1, 2, ... from its own. A code
that was not met after radius r in the first j segments and r - 1 in the others differs from the
query in at least ``segments * r + j`` bits; as soon as the k-th verified distance is no greater than what is
covered, the query is done and takes no part in later rounds.

Rows with the same code are one entry of the index, and queries with the same code are one
query. Candidates are verified inside the join, against the k-th distance so far,
so only those that can still count are ever rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from gaugeflow.llm.common import written

BITS = 64
K = 10
# about BITS / log2(number of codes): a look-up then meets a few codes
SEGMENTS = 5


def sign_code(vector: Column) -> Column:
    """The signs of a vector's elements as the bits of a long; NULL for a NULL or empty vector.

    Element j sets bit ``j % 64`` if positive; where several fall on a bit, their sum decides. A
    NULL or NaN element counts as 0.
    """
    clean = F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0))
                        .otherwise(x.cast("double")))
    rows = F.ceil(F.size(vector) / F.lit(float(BITS))).cast("int")
    bit = lambda i: F.aggregate(
        F.sequence(F.lit(0), rows - 1), F.lit(0.0),
        lambda a, r: a + F.coalesce(F.get(clean, r * BITS + i), F.lit(0.0)))
    folded = F.when(F.size(vector) > BITS, F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)), bit)).otherwise(clean)
    bits = F.transform(folded, lambda x, i: F.when(
        x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(
            F.lit(0).cast("long")))
    return F.when(F.size(vector) > 0, F.aggregate(
        bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _cuts(segments: int) -> list[tuple[int, int]]:
    edges = [round(i * BITS / segments) for i in range(segments + 1)]
    return list(zip(edges, edges[1:]))


def _segment(code: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(code, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def _flips(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for c in itertools.combinations(range(width), radius)]


def top_k(rows: DataFrame, queries: DataFrame, id_column: str = "id", code: str = "code",
          k: int = K, segments: int = SEGMENTS) -> DataFrame:
    """(query_id, rank, id, distance): the k rows with the nearest codes for every query.

    Both tables have ``id_column`` and a long ``code``. Ties in distance go to the smaller id; a
    row with NULL code is no neighbour and a query with NULL code has none. With fewer than
    k rows, all are neighbours. Repeated rows count as often as they occur. A query meets itself if it is
    among the rows.
    """
    ranked = F.row_number().over(W.partitionBy("code").orderBy("id"))
    base = rows.select(F.col(code).alias("code"), F.col(id_column).alias("id")).filter(
        "code IS NOT NULL")
    # per code: how many rows, and the ids that can be among the k nearest
    counts = base.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    index = written(counts, "codes")
    total = index.agg(F.sum("n")).first()[0] or 0
    ids = base.withColumn("_nth", ranked).filter(F.col("_nth") <= k)
    asked = queries.select(F.col(id_column).alias("query_id"), F.col(code).alias("q"))
    wanted = asked.filter("q IS NOT NULL").select("q").distinct()

    cuts = _cuts(segments)
    keyed = index.select("code", "n", "least", F.posexplode(F.array(
        *[_segment(F.col("code"), lo, hi) for lo, hi in cuts])).alias("seg", "value"))
    state = written(wanted.select(
        "q", F.lit(BITS).alias("bound"), F.lit(0).cast("long").alias("met")), "search")
    found = None
    for radius in range(max(hi - lo for lo, hi in cuts) + 1):
        # a query needs the first segments of this radius until it is covered up to its bound
        active = state.filter((F.col("bound") >= segments * radius) & (F.col("met") < total))
        if active.isEmpty():
            break
        # as text, which folds into one constant array instead of thousands of expressions
        flips = [F.split(F.lit(",".join(map(str, _flips(hi - lo, radius)))), ",").cast(
            "array<bigint>") if radius <= hi - lo else F.lit(None).cast("array<bigint>")
            for lo, hi in cuts]
        probes = active.withColumn("_flips", F.array(*flips)).select(
            "q", "bound", F.posexplode("_flips").alias("seg", "_f")).filter(
            F.col("bound") >= segments * radius + F.col("seg"))
        own = F.coalesce(*[F.when(F.col("seg") == i, _segment(F.col("q"), lo, hi))
                           for i, (lo, hi) in enumerate(cuts)])
        probes = probes.select("q", "bound", F.col("seg").alias("s"), own.alias("_own"),
                               F.explode("_f").alias("_flip")).select(
            "q", "bound", "s", F.col("_own").bitwiseXOR(F.col("_flip")).alias("v"))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        # the planner does not know how many probes a query has, so it must not broadcast them
        near = (probes.join(keyed.hint("merge"), (F.col("s") == F.col("seg")) & (F.col("v") == F.col("value"))
                            & (distance <= F.col("bound")))
                .select("q", "code", "n", "least", distance.cast("int").alias("d")).distinct())
        if found is not None:
            near = found.unionByName(near).distinct()
        # the k nearest codes hold the k nearest rows
        w = W.partitionBy("q").orderBy("d", "least")
        near = near.withColumn("_nth", F.row_number().over(w)).filter(
            F.col("_nth") <= k).drop("_nth")
        found = written(near, "neighbours")
        upto = found.withColumn("_rows", F.sum("n").over(w))
        bounds = upto.groupBy("q").agg(
            F.coalesce(F.min(F.when(F.col("_rows") >= k, F.col("d"))), F.lit(BITS)).alias("bound"),
            F.sum("n").alias("met"))
        state = written(wanted.join(bounds.withColumnRenamed("q", "_q"),
                                    F.col("q") == F.col("_q"), "left")
                        .select("q", F.coalesce("bound", F.lit(BITS)).alias("bound"),
                                F.coalesce("met", F.lit(0)).alias("met")), "search")
    if found is None:
        found = wanted.select("q", F.lit(0).cast("long").alias("code"), F.lit(0).alias("d")).limit(0)
    nearest = (found.select("q", F.col("code").alias("_code"), "d")
               .join(ids, F.col("_code") == F.col("code"))
               .withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("d", "id")))
               .filter(F.col("rank") <= k).select(F.col("q").alias("_q"), "rank", "id", "d"))
    return asked.join(nearest, F.col("q") == F.col("_q")).select(
        "query_id", "rank", "id", F.col("d").alias("distance"))


def oracle() -> str:
    """Brute force in SQL over the signs of the embeddings."""
    return f"""
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(len(list_filter(list_zip(q.code, r.code), lambda p: p[1] <> p[2])) AS INTEGER) AS distance
  FROM codes q, codes r WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= {K}"""
