"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1
(as they are) and normalised. The exponent is bisected to meet a target entropy, a limit on
how often a source may be repeated, or both. Weights then become token budgets, and each source
fills its budget with whole passes over its documents, each pass in a new order, the last one cut
off at the budget. The mixture is laid out in blocks: every source advances through the blocks in
proportion to its weight, so each block holds the mixture, and a block's documents are permuted.

A document weighs its words and one token for its end, so every document weighs something.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from gaugeflow.llm.common import (attach, free_name, key_sql, row_key, total_before, words,
                                  written)

MAX_REPETITION = 4.0
TARGET_ENTROPY = 0.95
BLOCK_TOKENS = 1 << 17
# the exponent is a multiple of 2 ** -STEPS
STEPS = 20


def token_count(text: Column) -> Column:
    """Words of a document and its end mark."""
    return words(text) + F.lit(1)


def source_totals(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """(source, n_docs, n_tokens) per source, NULL being a source."""
    return docs.groupBy(F.col(source).alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum(tokens).alias("n_tokens"))


def find_exponent(totals: DataFrame, target_entropy: float | None = TARGET_ENTROPY,
                  max_repetition: float | None = MAX_REPETITION,
                  budget: int | None = None) -> float:
    """The exponent that meets the targets, to ``2 ** -STEPS``.

    Entropy is a fraction of the greatest possible, the logarithm of the number of sources; it falls
    as the exponent grows, and so does the largest repetition. The largest exponent with
    at least the target entropy is taken, 1 if the shares meet it as they are, 0
    if nothing does; then, if a source would be repeated more than ``max_repetition``
    times for ``budget`` tokens (default: all tokens there are), the smallest exponent with which none is, or 1.
    Each round of the bisection evaluates 15 exponents as sums over the sources in one pass,
    so that the sources themselves never come to the driver.
    """
    n, total = totals.agg(F.count("*"), F.sum("n_tokens")).first()
    if not n or n == 1:
        return 1.0
    wanted = budget or total
    share = F.log(F.col("n_tokens") / F.lit(float(total)))

    def evaluate(exponents: list[float]) -> list[tuple[float, float]]:
        columns = []
        for a in exponents:
            mass = F.exp(share * F.lit(a))
            columns += [F.sum(mass), F.sum(mass * share * F.lit(a)),
                        F.max(mass * F.lit(float(wanted)) / F.col("n_tokens"))]
        row = totals.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return [((math.log(z) - s / z) / math.log(n), m / z)
                for z, s, m in zip(row[0::3], row[1::3], row[2::3])]

    def search(holds) -> tuple[int, int]:
        """Neighbours lo, hi where ``holds`` turns from true to false, in steps of the grid."""
        lo, hi = 0, 1 << STEPS
        first, last = evaluate([0.0, 1.0])
        if holds(last):
            return hi, hi
        if not holds(first):
            return 0, 0
        while hi - lo > 1:
            grid = sorted({lo + (hi - lo) * i // 16 for i in range(1, 16)} - {lo, hi})
            for g, found in zip(grid, evaluate([g / (1 << STEPS) for g in grid])):
                if holds(found):
                    lo = g
                else:
                    hi = g
                    break
        return lo, hi

    exponent = 1 << STEPS
    if target_entropy is not None:
        exponent = search(lambda x: x[0] >= target_entropy)[0]
    elif max_repetition is not None:
        exponent = 0
    if max_repetition is not None:
        _, least = search(lambda x: x[1] > max_repetition)
        exponent = max(exponent, least)
    return exponent / (1 << STEPS)


def mixture_weights(totals: DataFrame, exponent: float, budget: int | None = None,
                    block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``totals`` with each source's ``weight``, token ``budget`` and ``quota`` per block."""
    total, = totals.agg(F.sum("n_tokens")).first()
    wanted = float(budget or total or 0)
    mass = F.pow(F.col("n_tokens") / F.lit(float(total or 1)), F.lit(exponent))
    norm, = totals.agg(F.sum(mass)).first()
    return (totals.withColumn("weight", mass / F.lit(norm or 1.0))
            .withColumn("budget", F.round(F.col("weight") * wanted).cast("long"))
            .withColumn("quota", F.greatest(F.lit(1), F.round(
                F.col("weight") * F.lit(float(block_tokens))).cast("long"))))


def placements(docs: DataFrame, source: str = "source", text: str = "text",
               id_column: str = "doc_id", target_entropy: float | None = TARGET_ENTROPY,
               max_repetition: float | None = MAX_REPETITION, budget: int | None = None,
               block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """The mixture without texts: key, id and source of a row, then where it goes.

    Columns: row_key, id, source, n_tokens, epoch, block, position. A document is taken in
    a pass (``epoch``, from 0) if the tokens of its source before it are fewer than the
    budget; so a source exceeds its budget by less than a document, and a source of which the
    budget is all its tokens gives each document once. NULL is a source like others; a NULL or
    empty text weighs one token. The order in a pass is that of an md5 of id, source, text,
    seed and pass; rows equal in these follow one another. An empty table gives no rows.
    """
    rows = written(docs.select(
        row_key(seed, F.col(id_column), F.col(source), F.col(text)).alias("row_key"),
        F.col(id_column).alias("id"), F.col(source).alias("source"),
        token_count(F.col(text)).alias("n_tokens")), "lengths")
    totals = written(source_totals(rows, "source", "n_tokens"), "sources")
    exponent = find_exponent(totals, target_entropy, max_repetition, budget)
    weights = mixture_weights(totals, exponent, budget, block_tokens).filter("budget > 0").select(
        F.col("source").alias("_source"), F.col("n_tokens").alias("_n"), "budget", "quota",
        F.ceil(F.col("budget") / F.col("n_tokens")).cast("int").alias("_passes"))
    taken = (rows.join(weights, F.col("source").eqNullSafe(F.col("_source")))
             .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1)))
             .withColumn("_order", F.md5(F.concat_ws(":", "row_key", "epoch"))))
    size = totals.agg(F.sum("n_docs")).first()[0] or 0
    at = (total_before(taken, ["source", "epoch"], "_order", "n_tokens", "_before", size)
          .withColumn("_at", F.col("_before") + F.col("epoch") * F.col("_n"))
          .filter("_at < budget")
          .withColumn("block", F.floor(F.col("_at") / F.col("quota")).cast("long")))
    position = F.row_number().over(W.partitionBy("block").orderBy(
        F.md5(F.concat_ws(":", "_order", F.lit("p"))), "_at")) - 1
    return at.select("row_key", "id", "source", "n_tokens", "epoch", "block",
                     position.cast("long").alias("position"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_column: str = "doc_id",
        seed: int = 1, **targets) -> DataFrame:
    """The mixture: rows of ``docs`` with a struct ``mix`` of n_tokens, epoch, block, position.

    See ``placements`` for the targets and for what becomes of NULLs, ties and repeated rows.
    """
    found = placements(docs, source, text, id_column, seed=seed, **targets)
    out = free_name(docs, "mix")
    placed = found.select(F.col("row_key").alias("_mix_key"), F.struct(
        "n_tokens", "epoch", "block", "position").alias(out))
    key = row_key(seed, F.col(id_column), F.col(source), F.col(text))
    return attach(docs, placed, key, "_mix_key", [f"{out}.epoch"], f"{out}.block")


def oracle() -> str:
    """The mixture of ``documents`` with the default targets in SQL, the exponent by recursion."""
    steps = 1 << STEPS
    entropy = ("(SELECT (ln(sum(exp(p * {0}))) - sum(exp(p * {0}) * p * {0}) / sum(exp(p * {0})))"
               " / ln(count(*)) FROM shares)")
    repeated = "(SELECT max(exp(p * {0}) * total / n) / sum(exp(p * {0})) FROM shares)"
    middle = f"((lo + hi) // 2) / {steps}.0"
    kept = f"{entropy} >= {TARGET_ENTROPY}"
    over = f"{repeated} > {MAX_REPETITION}"

    def search(name: str, holds: str) -> str:
        test = holds.format(middle)
        return f"""
{name} AS (
  SELECT 0 AS step, CASE WHEN {holds.format("1.0")} THEN {steps} ELSE 0 END AS lo,
         CASE WHEN {holds.format("1.0")} OR {holds.format("0.0")} THEN {steps} ELSE 0 END AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN hi - lo > 1 AND {test} THEN (lo + hi) // 2 ELSE lo END,
         CASE WHEN hi - lo > 1 AND NOT {test} THEN (lo + hi) // 2 ELSE hi END
  FROM {name} WHERE step < {STEPS + 1})"""

    return rf"""
WITH RECURSIVE lengths AS (
  SELECT doc_id, source, {key_sql(1, "CAST(doc_id AS VARCHAR)", "source", "text")} AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n
  FROM documents),
totals AS (SELECT source, sum(n) AS n FROM lengths GROUP BY source),
shares AS (
  SELECT source, n, sum(n) OVER () AS total, ln(n / CAST(sum(n) OVER () AS DOUBLE)) AS p
  FROM totals),{search("entropies", kept)},{search("repetitions", over)},
chosen AS (
  SELECT greatest((SELECT lo FROM entropies ORDER BY step DESC LIMIT 1),
                  (SELECT hi FROM repetitions ORDER BY step DESC LIMIT 1)) / {steps}.0 AS a),
masses AS (SELECT source, n, total, pow(n / CAST(total AS DOUBLE), a) AS m FROM shares, chosen),
weights AS (SELECT source, n, total, m / sum(m) OVER () AS w FROM masses),
budgets AS (
  SELECT source, n, CAST(round(w * total) AS BIGINT) AS budget,
         greatest(1, CAST(round(w * {BLOCK_TOKENS}) AS BIGINT)) AS quota FROM weights),
passes AS (
  SELECT source, n, budget, quota,
         unnest(range(CAST(ceil(budget / CAST(n AS DOUBLE)) AS BIGINT))) AS epoch FROM budgets),
taken AS (
  SELECT l.doc_id, l.source, l.n AS n_tokens, epoch, budget, quota, p.n AS source_n,
         md5(l.k || ':' || epoch) AS place
  FROM lengths l JOIN passes p ON l.source IS NOT DISTINCT FROM p.source),
placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + epoch * source_n AS spot FROM taken)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch,
       CAST(spot // quota AS BIGINT) AS block,
       row_number() OVER (PARTITION BY spot // quota ORDER BY md5(place || ':p'), spot) - 1
         AS position
FROM placed WHERE spot < budget"""
