"""Repair of the role structure of conversations, by cheapest edits.

Rows are ordered once by a range shuffle, which spreads even one conversation that holds a third of
all rows, and are packed into chunks of bounded size. Each row becomes a letter for its role and fault;
``grammar`` learns one Re-Pair grammar from all letter strings and works out one matrix per rule. A
conversation that lies in one chunk is solved where it lies. One that is longer, or lies at
the border of a partition, gives one matrix per chunk; these are chained in order, and the audit is cut
up again for its chunks. Only the chaining, and the digest of a conversation's repaired text, which
is defined as one sequence of bytes, see a whole conversation, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gaugeflow.llm import grammar as g
from gaugeflow.llm.common import same, written

# bounds of a chunk, and bytes that a task gives back at once
CHUNK_ROWS, CHUNK_BYTES, BATCH_BYTES = 4096, 4 << 20, 4 << 20
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL = {"su", "ua", "au"}
NAMES = {g.USER: "user", g.ASSISTANT: "assistant"}
# letters of rows that must be deleted; to the grammar they are one
BLANK, DUPLICATE = "b", "d"
# solved letter strings that a task remembers, and the longest of them
MEMO, MEMO_ROWS = 1 << 15, 64

_STATS = ("low long, high long, turns long, blank long, duplicate long, truncated long, "
          "illegal long, head string, tail string")
_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, " \
           "audit string, repaired_sha256 string"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Deterministic damage by crc32 of ``conv:turn`` (a NULL is one space) modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 sets the role
    user. NULL roles and texts become one space; other columns stay as they are.
    """
    blank = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col(turn).cast("string"), blank))) % 20
    words = F.coalesce(F.col(text), blank)
    changed = rows.withColumns({
        role: F.when(code == 4, "user").otherwise(F.coalesce(F.col(role), blank)),
        text: F.when(code == 1, "").when(code == 2, F.translate(words, ENDS, "")).otherwise(words)})
    times = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    # the code is of columns that the changes leave alone
    return changed.select("*", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


def letters_of(roles: list[str], texts: list[str]) -> str:
    """One letter per row, in order: its first fault, or its role's initial."""
    out, seen = [], set()
    for role, text in zip(roles, texts):
        end = text.rstrip(SPACE)
        if not end:
            out.append(BLANK)
        elif (role, text) in seen:
            out.append(DUPLICATE)
        else:
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            out.append(letter if end[-1] in ENDS else letter.upper())
    return "".join(out)


def _deleted(letters: str) -> str:
    return letters.replace(BLANK, "x").replace(DUPLICATE, "x")


def _stats(turns: list, roles: list[str], letters: str) -> dict:
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    return {"low": min(known, default=None), "high": max(known, default=None),
            "turns": len(set(known)), "blank": letters.count(BLANK),
            "duplicate": letters.count(DUPLICATE),
            "truncated": sum(map(str.isupper, letters)),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "head": initials[0], "tail": initials[-1]}


def _gaps(low, high, turns) -> int:
    return 0 if low is None else high - low + 1 - turns


def applied(audit: str, roles: list[str], texts: list[str], state: int = g.START
            ) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each repaired row; deleted rows are left out."""
    i = 0
    for edit in audit:
        if edit == "K":
            state = {"s": g.SYSTEM, "u": g.USER, "a": g.ASSISTANT}[roles[i][0]]
            yield edit, roles[i], texts[i]
        elif edit != "D":
            state = g.following(state)
            yield edit, NAMES[state], texts[i] if edit == "R" else ""
        i += edit != "I"


def _lines(rows: Iterator[tuple[str, str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for _, role, text in rows).encode("utf-8", "surrogatepass")


def _batches(rows: Iterator[tuple[dict, int]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows, given with their sizes, in batches of bounded size."""
    arrow, held, size = to_arrow_schema(schema), [], 0
    for row, weight in rows:
        held.append(row)
        size += weight + 200
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _each(df: DataFrame, schema: T.StructType,
          function: Callable[[Iterator[dict]], Iterator[tuple[dict, int]]]) -> DataFrame:
    """``function`` over the rows of each task, as a stream."""

    def stream(batches):
        for batch in batches:
            # few rows at a time: a chunk's texts are large
            for at in range(0, batch.num_rows, 64):
                yield from batch.slice(at, 64).to_pylist()

    return df.mapInArrow(lambda batches: _batches(function(stream(batches)), schema), schema)


def _pack(rows: Iterator[dict], chunk_rows: int) -> Iterator[tuple[dict, int]]:
    """Chunks of ordered rows. ``edge`` marks those whose conversation may have more of them."""
    serial, conv, held, size, edge = TaskContext.get().partitionId() << 33, None, [], 0, True

    def chunk(edge: bool) -> tuple[dict, int]:
        turns, roles, texts = ([r[c] for r in held] for c in ("turn", "role", "text"))
        letters = letters_of(roles, texts)
        digests = [None if c in (BLANK, DUPLICATE) else hashlib.sha256(
            f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).digest()
            for c, r, t in zip(letters, roles, texts)] if edge else None
        return {"conv": conv, "at": serial, "edge": edge, "letters": letters, "roles": roles,
                "texts": texts, "digests": digests, **_stats(turns, roles, letters)}, size

    for row in rows:
        if held and (row["conv"] != conv or len(held) >= chunk_rows or size >= CHUNK_BYTES):
            more = row["conv"] == conv
            yield chunk(edge or more)
            serial, held, size, edge = serial + 1, [], 0, more
        conv = row["conv"]
        held.append(row)
        size += len(row["text"]) + 40
    if held:
        yield chunk(True)


def _chunks(rows: DataFrame, conv: str, turn: str, role: str, text: str,
            chunk_rows: int) -> DataFrame:
    """All rows in order, packed; written, so that a chunk stays what it is."""
    blank = F.lit(" ")
    ready = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), blank).alias("role"),
                        F.coalesce(F.col(text), blank).alias("text"))
    # the last key only spreads equal rows, whose order does not matter
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.md5("text"), F.col("_any")]
    ordered = ready.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(
        *order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv", ready.schema["conv"].dataType), *T.StructType.fromDDL(
        "at long, edge boolean, letters string, roles array<string>, texts array<string>, "
        "digests array<binary>, " + _STATS).fields])
    return written(_each(ordered, schema, partial(_pack, chunk_rows=chunk_rows)), "chunks")


def _schema(chunks: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([chunks.schema["conv"], *T.StructType.fromDDL(ddl).fields])


def _whole(grammar: g.Grammar, rows_out: bool) -> Callable:
    """Solve conversations that lie in one chunk: a summary each, or their repaired rows."""

    def solve(chunks: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        remembered = lru_cache(MEMO)(grammar.cheapest)
        for c in chunks:
            letters = _deleted(c["letters"])
            cost, audit = (remembered if len(letters) <= MEMO_ROWS else grammar.cheapest)(letters)
            edits = applied(audit, c["roles"], c["texts"])
            if rows_out:
                for no, (edit, role, text) in enumerate(edits):
                    yield {"conv": c["conv"], "at": c["at"], "no": no, "edit": edit,
                           "role": role, "text": text}, len(text)
            else:
                yield {"conv": c["conv"], "gaps": _gaps(c["low"], c["high"], c["turns"]),
                       **{k: c[k] for k in ("blank", "duplicate", "truncated", "illegal")},
                       "cost": cost, "audit": audit,
                       "repaired_sha256": hashlib.sha256(_lines(edits)).hexdigest()}, len(audit)

    return solve


def _edges(chunks: DataFrame) -> DataFrame:
    """Chunks of conversations that may have several; rows repeated from an earlier chunk are
    marked as duplicates."""
    edges = chunks.filter("edge")
    seen = edges.select("conv", "at", F.posexplode("digests").alias("i", "digest")).filter(
        F.col("digest").isNotNull())
    first = seen.groupBy("conv", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    again = same(seen, first.filter("n > 1"), ["conv", "digest"]).filter("at > first")
    again = again.groupBy(F.col("at").alias("_at")).agg(F.collect_list("i").alias("again"))
    return written(edges.drop("digests").join(again, F.col("at") == F.col("_at"), "left")
                   .drop("_at"), "edges")


def _matrices(grammar: g.Grammar) -> Callable:
    def solve(chunks: Iterator[dict]) -> Iterator[tuple[dict, int]]:
        for c in chunks:
            letters, added = list(c["letters"]), {}
            for i in c["again"] or ():
                added["truncated"] = added.get("truncated", 0) - letters[i].isupper()
                added["duplicate"] = added.get("duplicate", 0) + 1
                letters[i] = DUPLICATE
            letters = _deleted("".join(letters))
            steps = [[None if e is None else {"cost": e[0], "audit": str(e[1])} for e in row]
                     for row in grammar.matrix(letters)]
            yield {**{k: v + added.get(k, 0) if k in added else v for k, v in c.items()},
                   "letters": letters, "steps": steps}, 20 * len(letters)

    return solve


def _grouped(rows: Iterator[dict]) -> Iterator[tuple[dict, bool]]:
    """Each row, and whether it is the last one of its conversation."""
    before = None
    for row in rows:
        if before is not None:
            yield before, row["conv"] != before["conv"]
        before = row
    if before is not None:
        yield before, True


def _chain(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    """Chain the matrices of each conversation's chunks; each chunk gets its piece of the audit."""
    row, parts, total = [(0, ""), None, None, None], [], {}
    for c, last in _grouped(rows):
        steps = [[None if e is None else (e["cost"], e["audit"]) for e in r] for r in c["steps"]]
        row = g.times(row, steps)
        if parts:
            total["illegal"] += total["tail"] + c["head"] not in LEGAL
            total["turns"] -= c["low"] is not None and total["high"] == c["low"]
        for k in ("turns", "blank", "duplicate", "truncated", "illegal"):
            total[k] = total.get(k, 0) + c[k]
        total["low"] = c["low"] if total.get("low") is None else total["low"]
        total["high"] = total.get("high") if c["high"] is None else c["high"]
        total["tail"] = c["tail"]
        parts.append((c["at"], c["letters"]))
        if not last:
            continue
        cost, audit = g.finish(row)
        summary = {"gaps": _gaps(total["low"], total["high"], total["turns"]), "cost": cost,
                   **{k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}}
        start, state = 0, g.START
        for n, (at, letters) in enumerate(parts):
            end, state_before, done = start, state, 0
            while end < len(audit) and (n == len(parts) - 1 or done < len(letters)):
                edit = audit[end]
                if edit == "K":
                    state = {"s": g.SYSTEM, "u": g.USER, "a": g.ASSISTANT}[letters[done].lower()]
                elif edit != "D":
                    state = g.following(state)
                done += edit != "I"
                end += 1
            yield {"conv": c["conv"], "at": at, "audit": audit[start:end], "state": state_before,
                   "summary": summary if n == len(parts) - 1 else None}, end - start
            start = end
        row, parts, total = [(0, ""), None, None, None], [], {}


def _edge_lines(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    for c in rows:
        text = _lines(applied(c["audit"], c["roles"], c["texts"], c["state"]))
        yield {"conv": c["conv"], "at": c["at"], "audit": c["audit"], "summary": c["summary"],
               "lines": text}, len(text)


def _edge_rows(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    for c in rows:
        for no, (edit, role, text) in enumerate(applied(c["audit"], c["roles"], c["texts"],
                                                        c["state"])):
            yield {"conv": c["conv"], "at": c["at"], "no": no, "edit": edit, "role": role,
                   "text": text}, len(text)


def _digest(rows: Iterator[dict]) -> Iterator[tuple[dict, int]]:
    digest, audit, begun = hashlib.sha256(), [], False
    for c, last in _grouped(rows):
        if c["lines"]:
            digest.update((b"\n" if begun else b"") + c["lines"])
            begun = True
        audit.append(c["audit"])
        if last:
            yield {"conv": c["conv"], **c["summary"], "audit": "".join(audit),
                   "repaired_sha256": digest.hexdigest()}, sum(map(len, audit))
            digest, audit, begun = hashlib.sha256(), [], False


def _streamed(df: DataFrame) -> DataFrame:
    """Each conversation's chunks in order, in one task; sorted on disk if need be."""
    return df.repartition("conv").sortWithinPartitions("conv", "at")


def _edge_plans(chunks: DataFrame, grammar: g.Grammar) -> DataFrame:
    """Edge chunks with their piece of the audit, the state before it, and on a conversation's last
    chunk its summary."""
    edges = _edges(chunks)
    solved = _each(edges.drop("edge", "roles", "texts"), _schema(
        chunks, "at long, letters string, steps array<array<struct<cost:long,audit:string>>>, "
        + _STATS), _matrices(grammar))
    plans = written(_each(_streamed(solved), _schema(
        chunks, "at long, audit string, state int, summary struct<gaps:long,cost:long,blank:long,"
        "duplicate:long,truncated:long,illegal:long>"), _chain), "edits")
    texts = edges.select(F.col("at").alias("_at"), "roles", "texts")
    return plans.join(texts, F.col("at") == F.col("_at")).drop("_at")


def _learned(chunks: DataFrame) -> g.Grammar:
    return g.learn(chunks.select(F.translate("letters", BLANK + DUPLICATE, "xx").alias("letters")))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation of ``rows``: its faults, and its cheapest repair.

    A conversation's rows are taken by turn, NULL first; rows of equal turn by role and then by the
    MD5 of their text. NULL roles and texts count as one space, and a NULL id is a conversation like
    any other. Each row has at most one fault: blank (nothing but ASCII white space), duplicate (role
    and text came before), or truncated (does not end with ``.!?``). Keeping a row costs 0, another
    role (user or assistant) 2, deleting it 3, an empty row of user or assistant 2; blank and duplicate
    rows must go, and a truncated one that stays adds 1. The initials of the roles then are
    ``(s?(ua)+)?``; of equally cheap repairs the one with the least audit is taken.

    Returns the id, gaps (turns missing between the least and the greatest), blank, duplicate,
    truncated, illegal (neighbouring roles other than su, ua, au), cost, audit (K, R, D, I in order)
    and repaired_sha256 (lines ``role:text``). Extra columns are not read; empty tables give no rows.
    """
    chunks = _chunks(rows, conv, turn, role, text, chunk_rows)
    grammar = _learned(chunks)
    schema = _schema(chunks, _SUMMARY)
    whole = _each(chunks.filter("not edge").drop("edge", "digests"), schema, _whole(grammar, False))
    lines = _each(_edge_plans(chunks, grammar), _schema(
        chunks, "at long, audit string, lines binary, summary struct<gaps:long,cost:long,blank:long,"
        "duplicate:long,truncated:long,illegal:long>"), _edge_lines)
    return whole.unionByName(_each(_streamed(lines), schema, _digest)).withColumnRenamed("conv", conv)


def repaired_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of the repaired conversations: id, ``part`` and ``no`` (their order), ``edit`` (K, R or
    I), role and text. Choices and special cases are those of ``repair``."""
    chunks = _chunks(rows, conv, turn, role, text, chunk_rows)
    grammar = _learned(chunks)
    schema = _schema(chunks, "at long, no int, edit string, role string, text string")
    found = _each(chunks.filter("not edge").drop("edge", "digests"), schema, _whole(grammar, True))
    found = found.unionByName(_each(_edge_plans(chunks, grammar), schema, _edge_rows))
    return found.withColumnsRenamed({"conv": conv, "at": "part", "role": role, "text": text})


def with_lost(summaries: DataFrame, ids: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``summaries`` with a row for every id of ``ids``: zeros and empty texts if it has no rows left."""
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def known(name: str, default) -> Column:
        return F.coalesce(name, F.lit(default)).alias(name)

    return same(ids.select(conv).distinct(), summaries, [conv], "left").select(
        conv, *[known(c, 0).cast("long").alias(c) for c in numbers], known("audit", ""),
        known("repaired_sha256", hashlib.sha256(b"").hexdigest()))


def oracle() -> str:
    """The same by recursion over the rows: per state the cheapest edits as padded cost and audit."""
    def add(state: str, cost: str, edit: str) -> str:
        return f"lpad(CAST(CAST({state}[1:9] AS INT) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{edit}'"

    def when(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} END"

    inserts = ", ".join((
        "s0 AS i0", "s1 AS i1",
        f"least(s2, {add('s0', '2', 'I')}, {add('s1', '2', 'I')}, {add('s3', '2', 'I')}) AS i2",
        f"least(s3, {add('s2', '2', 'I')}, {add('s0', '4', 'II')}, {add('s1', '4', 'II')}) AS i3"))
    to_user = ", ".join(
        when(f"NOT gone{extra}", add(s, cost, edit)) for s in ("i0", "i1", "i3")
        for extra, cost, edit in (("", "2 + late", "R"), (" AND initial = 'u'", "late", "K")))
    steps = ", ".join((
        f"{add('i0', '3', 'D')} AS s0",
        f"least({add('i1', '3', 'D')}, "
        f"{when('NOT gone AND initial = ' + chr(39) + 's' + chr(39), add('i0', 'late', 'K'))}) AS s1",
        f"least({add('i2', '3', 'D')}, {to_user}) AS s2",
        f"least({add('i3', '3', 'D')}, {when('NOT gone', add('i2', '2 + late', 'R'))}, "
        f"{when('NOT gone AND initial = ' + chr(39) + 'a' + chr(39), add('i2', 'late', 'K'))}) AS s3"))
    return f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(name, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
      ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 20 AS code
  FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended
  FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS initial, ended = '' AS blank,
    ended <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again
  FROM placed),
marked AS (
  SELECT *, blank OR again AS gone, CAST(NOT blank AND NOT again
      AND right(ended, 1) NOT IN ('.', '!', '?') AS INT) AS late,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
  FROM faults),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    CAST(sum(late) AS BIGINT) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list(role ORDER BY place) AS roles, list(text ORDER BY place) AS texts
  FROM marked GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS place, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2,
    NULL::VARCHAR AS s3 FROM counted
  UNION ALL
  SELECT conv_id, place, {steps}
  FROM (SELECT w.conv_id, m.place, m.gone, m.late, m.initial, {inserts}
        FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id
          AND m.place = w.place + 1)),
done AS (
  SELECT conv_id, least(i0, i3) AS best
  FROM (SELECT conv_id, place, {inserts} FROM walk) w
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
plans AS (
  SELECT c.*, CAST(d.best[1:9] AS BIGINT) AS cost, d.best[10:] AS audit
  FROM counted c JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id),
edits AS (
  SELECT conv_id, roles, texts, audit, 0 AS place, 1 AS row, 0 AS state, NULL::VARCHAR AS line,
    []::VARCHAR[] AS lines FROM plans
  UNION ALL
  SELECT conv_id, roles, texts, audit, place, row + CAST(edit <> 'I' AS INT),
    CASE edit WHEN 'D' THEN state WHEN 'K' THEN CASE left(roles[row], 1)
      WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE wanted END,
    NULL, CASE edit WHEN 'D' THEN lines ELSE list_append(lines,
      CASE WHEN edit = 'K' THEN roles[row] WHEN wanted = 2 THEN 'user' ELSE 'assistant' END || ':'
      || CASE WHEN edit = 'I' THEN '' ELSE texts[row] END) END
  FROM (SELECT *, CASE WHEN state = 2 THEN 3 ELSE 2 END AS wanted
        FROM (SELECT * EXCLUDE (place), place + 1 AS place, audit[place + 1] AS edit FROM edits
              WHERE place < length(audit)))),
repaired AS (
  SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
  FROM edits WHERE place = length(audit))
SELECT i.conv_id, coalesce(p.gaps, 0) AS gaps, coalesce(p.blank, 0) AS blank,
  coalesce(p.duplicate, 0) AS duplicate, coalesce(p.truncated, 0) AS truncated,
  coalesce(p.illegal, 0) AS illegal, coalesce(p.cost, 0) AS cost, coalesce(p.audit, '') AS audit,
  coalesce(r.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""
