"""Repair of the turn structure of conversations by a program over retained subsequences.

A conversation's rows are read in the order of turns. The repair keeps, reroles, deletes or inserts
turns so that the initials of the roles read ``(s?(ua)+)?`` at the least cost, and tells the edits.

``solve`` prices what is retained: between two retained turns all others are deleted (a difference
of prefix sums of deletions) and the pair of their roles determines the inserted turns, so the best
next retained turn is a running minimum for each role that the last one may have had. Of equally
cheap repairs the one with the ASCII-least string of edits is taken.

A conversation of any length is read in parallel: rows are range-partitioned by conversation and turn,
and each partition makes one letter of each turn (its role's kind and its fault). Only those letters
meet in one task, one byte a turn, as the string of edits that is asked for must in any case. Texts are
streamed past the edits in order, one at a time, since a digest of the whole can't be made in parts.

Defined cases. A null role, text, conversation or turn counts as one space where it is written into a
string; a null conversation is one of its own, a null turn stands first. Rows of one turn stand by role,
then by the SHA-256 of their text; repeated rows are duplicates. A role whose initial isn't s, u or a (an
empty one too) can't be kept. A conversation without rows left has zeros, no edits and the digest of an
empty string. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, parts, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: White space of the contract: blank and characters 9 to 13. Marks that end a sentence.
SPACE, END = " \t\n\v\f\r", ".!?"
#: Kinds of roles by initial, others are 3; faults of a row.
KINDS = "sua"
SOUND, CUT, BLANK, COPY = range(4)
#: Roles of turns that are inserted or reroled.
FULL = {"u": "user", "a": "assistant"}
#: Turns inserted between a role (or the beginning) and the next, and before the end.
BETWEEN = {("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1}
AT_END = {"": 0, "s": 2, "u": 1, "a": 0}
#: Pairs of kinds that may follow each other.
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Letters in one piece at most.
LETTERS = 1 << 20


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after the damage that the contract asks for; ``kind`` is the crc32's remainder."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    told = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    told = told.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return told.withColumn("_", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def letters(rows: DataFrame) -> DataFrame:
    """conv_id, place, letters and what joins them: the turns of a conversation in each partition that holds some.

    A letter is 4 times the role's kind plus the fault. ``place`` orders the pieces of a conversation.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    bare = rows.select(
        "conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), F.unhex(F.sha2("text", 256)).alias("digest"),
        F.substring(trimmed, -1, 1).isin(*END).alias("ended"), (trimmed == "").alias("blank"),
    )
    # what is said more than once: the join's one side has a row for each, its long side may be split
    same = bare.where("not blank").groupBy("conv_id", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("early"))
    same = same.where("n > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.when(~F.col("early"), F.col("first")).alias("first"), F.lit(True).alias("again"))
    told = bare.join(same.hint("merge"), bare.conv_id.eqNullSafe(same._c) & (bare.role == same._r) & (bare.digest == same._d), "left")
    later = F.col("again") & ~F.col("turn").eqNullSafe(F.col("first"))
    kind = F.lit(len(KINDS))
    for i, initial in enumerate(KINDS):
        kind = F.when(F.col("initial") == initial, i).otherwise(kind)
    fault = F.when(F.col("blank"), BLANK).when(later, COPY).when(F.col("ended"), SOUND).otherwise(CUT)
    order = ["conv_id", "turn", "role", "digest"]
    told = told.select(*order, (kind * 4 + fault).cast("int").alias("letter"))
    dealt = told.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("letters", T.BinaryType())])
    schema = schema.add("turns", "long").add("first_row", "string").add("last_row", "string")
    for name in ("first_turn", "low", "high"):
        schema = schema.add(name, rows.schema["turn"].dataType)
    return mapped(dealt.withColumn("place", F.monotonically_increasing_id()), _spelt, schema)


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to strings of letters; a row equal to the one before it is a copy unless it is blank."""
    here = None
    for batch in batches:
        done, types = [], [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), *[batch.schema.field(1).type] * 3]
        for conv, turn, role, digest, letter, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = f"{turn}:{digest.hex()}:{role}"
            if here is None or here["conv_id"] != conv or len(here["letters"]) >= LETTERS:
                if here is not None:
                    done.append(here)
                here = {"conv_id": conv, "place": place, "letters": bytearray(), "turns": 0, "first_row": row, "last_row": None, "first_turn": turn, "low": turn, "high": None}
            elif row == here["last_row"] and letter % 4 != BLANK:
                letter = letter - letter % 4 + COPY
            here["letters"].append(letter)
            if turn is not None:
                here["turns"] += turn != here["high"]
                here["high"] = turn
                here["low"] = turn if here["low"] is None else here["low"]
            here["last_row"] = row
        if done:
            yield _batch(done, types)
    if here is not None:
        yield _batch([here], types)


def _batch(rows: list[dict], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array([bytes(r[n]) if isinstance(r[n], bytearray) else r[n] for r in rows], t) for n, t in zip(rows[0], types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(rows[0]))


def solve(turns: bytes) -> tuple[int, str]:
    """Least cost of a repair, and its edits; the least of equally cheap ones."""
    n = len(turns)
    deleted = range(0, DELETE * (n + 1), DELETE)  # prefix sums: every deletion has one price
    # after[s][p]: least cost of all from row p on if the last retained turn before it has role s
    after = {s: [0] * (n + 1) for s in AT_END}
    least = {s: deleted[n] + INSERT * extra for s, extra in AT_END.items()}  # running minima, with deletions from the beginning on
    for s in AT_END:
        after[s][n] = least[s] - deleted[n]
    prices = [_retained(letter) for letter in range(16)]
    for p in range(n - 1, -1, -1):
        options = [(r, price + after[r][p + 1] + deleted[p]) for r, price in prices[turns[p]].items()]
        for s in AT_END:
            for r, whole in options:
                extra = BETWEEN.get((s, r))
                if extra is not None:
                    least[s] = min(least[s], whole + INSERT * extra)
            after[s][p] = least[s] - deleted[p]
    edits, state = [], ""
    for p in range(n):
        if after[state][p] == DELETE + after[state][p + 1]:
            edits.append("D")
            continue
        found = []
        for r, price in prices[turns[p]].items():
            extra = BETWEEN.get((state, r))
            if extra is not None and after[state][p] == INSERT * extra + price + after[r][p + 1]:
                found.append(("I" * extra + ("K" if KINDS[turns[p] // 4 : turns[p] // 4 + 1] == r else "R"), r))
        edit, state = min(found)
        edits.append(edit)
    edits.append("I" * AT_END[state])
    return after[""][0], "".join(edits)


def _retained(letter: int) -> dict[str, int]:
    """What it costs to retain a turn, by the role it then has; its own costs nothing."""
    kind, fault = KINDS[letter // 4 : letter // 4 + 1], letter % 4
    if fault in (BLANK, COPY):
        return {}
    more = TRUNCATED if fault == CUT else 0
    return {r: (KEEP if r == kind else REROLE) + more for r in KINDS if r == kind or r in FULL}


def _told(pieces: list[dict]) -> dict:
    """Counts, cost and edits of a conversation from its pieces in order."""
    turns, distinct, low, high, last = bytearray(), 0, None, None, None
    for p in pieces:
        own = bytearray(p["letters"])
        if last is not None:
            if p["first_row"] == last["last_row"] and own[0] % 4 != BLANK:
                own[0] += COPY - own[0] % 4
            distinct -= p["first_turn"] is not None and p["first_turn"] == last["high"]
        turns += own
        distinct += p["turns"]
        low = p["low"] if low is None else low
        high = p["high"] if p["high"] is not None else high
        last = p
    faults, kinds = bytes(t % 4 for t in turns), bytes(t // 4 for t in turns)
    cost, audit = solve(bytes(turns))
    return {
        "gaps": 0 if low is None else high - low + 1 - distinct, "blank": faults.count(BLANK), "duplicate": faults.count(COPY), "truncated": faults.count(CUT),
        "illegal": sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False)), "cost": cost, "audit": audit,
    }


#: Columns of a conversation's report beside its id, with their values where it has no rows left.
NOTHING = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            done = []
            for piece in batch.to_pylist():
                if held and held[0]["conv_id"] != piece["conv_id"]:
                    done.append({"conv_id": held[0]["conv_id"]} | _told(held))
                    held = []
                held.append(piece)
            if done:
                yield _batch(done, _types(batch))
        if held:
            yield _batch([{"conv_id": held[0]["conv_id"]} | _told(held)], _types(batch))

    pieces = letters(rows)
    dealt = pieces.repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
    return mapped(dealt, run, _schema(rows))


def _types(batch: pa.RecordBatch) -> list[pa.DataType]:
    return [batch.schema.field(0).type, *[pa.string() if v == "" else pa.int64() for v in NOTHING.values()]]


def _schema(rows: DataFrame) -> T.StructType:
    schema = T.StructType([rows.schema["conv_id"]])
    for name, value in NOTHING.items():
        schema = schema.add(name, "string" if value == "" else "long")
    return schema


def repaired_lines(edits: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of a repaired conversation's turns, from its edits and its rows in order."""
    state = ""
    for edit in edits:
        if edit == "I":
            state = "a" if state == "u" else "u"
            yield FULL[state], ""
            continue
        role, text = next(turns)
        if edit == "K":
            state = role[:1]
            yield role, text
        elif edit == "R":
            state = "a" if state == "u" else "u"
            yield FULL[state], text


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The report of every one of ``conversations`` (conv_id), by its ``rows``, with the digest of its repaired turns.

    Edits and rows of a conversation come to one task one after the other and are streamed past each other.
    """
    report = _schema(rows)
    names, order = report.names, ["conv_id", "step", "turn", "role", "digest"]
    blank = {n: F.lit(None).cast(report[n].dataType).alias(n) for n in names[1:]}
    text = {n: F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in ("turn", "role", "text")}
    no_digest = F.lit(None).cast("binary").alias("digest")
    ids = conversations.select("conv_id").distinct().select("conv_id", F.lit(0).alias("step"), *text.values(), no_digest, *blank.values())
    edits = judged(rows).select("conv_id", F.lit(1).alias("step"), *text.values(), no_digest, *names[1:])
    said = rows.select("conv_id", F.lit(2).alias("step"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), *blank.values())
    dealt = ids.union(edits).union(said).repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = ((batch, row) for batch in batches for row in batch.select(["conv_id", "step", "role", "text", *names[1:]]).to_pylist())
        for _, group in itertools.groupby(stream, key=lambda x: x[1]["conv_id"]):
            batch, row = next(group)
            found, first = {"conv_id": row["conv_id"]} | NOTHING, next(group, None)
            sha = hashlib.sha256()
            if first is not None:
                found |= {n: first[1][n] for n in NOTHING}
                for i, (role, said) in enumerate(repaired_lines(found["audit"], ((r["role"], r["text"]) for _, r in group))):
                    sha.update(f"{chr(10) if i else ''}{role}:{said}".encode())
            yield _batch([found | {"repaired_sha256": sha.hexdigest()}], [*_types(batch), pa.string()])

    return mapped(dealt, lambda batches: _gathered(run(batches)), _schema(rows).add("repaired_sha256", "string"))


def _gathered(ones: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one row to batches of some letters and rows."""
    held, size = [], 0
    for one in ones:
        held.append(one)
        size += one.nbytes + 256
        if size > LETTERS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage to and repair of all ``conversations``."""
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)


#: DuckDB SQL of the query; crc32 bit by bit, the least repairs by recursion over rows.
ORACLE = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 20 AS kind FROM (SELECT DISTINCT k FROM keyed)),
harmed AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed JOIN crc USING (k), range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    left(role, 1) AS c,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM harmed),
judged AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM placed),
shape AS (SELECT conv_id, (coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0))::BIGINT AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
walk(conv_id, i, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, '', 0::BIGINT, '', ''::VARCHAR FROM shape
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT w.conv_id, j.i, s.state, w.cost + s.price AS cost, w.audit || s.edit AS audit, w.lines || s.line AS lines,
      row_number() OVER (PARTITION BY w.conv_id, s.state ORDER BY w.cost + s.price, w.audit || s.edit) AS best
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1, LATERAL (
      SELECT w.state AS state, 2 AS price, 'D' AS edit, '' AS line
      UNION ALL
      SELECT m.r, 5 * m.ins + (j.c <> m.r)::INT + CASE j.fault WHEN 't' THEN 5 ELSE 0 END, repeat('I', m.ins) || CASE WHEN j.c = m.r THEN 'K' ELSE 'R' END,
        m.added || chr(10) || CASE WHEN j.c = m.r THEN j.role WHEN m.r = 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text
      FROM (VALUES ('', 's', 0, ''), ('', 'u', 0, ''), ('', 'a', 1, chr(10) || 'user:'), ('s', 'u', 0, ''), ('s', 'a', 1, chr(10) || 'user:'),
        ('u', 'u', 1, chr(10) || 'assistant:'), ('u', 'a', 0, ''), ('a', 'u', 0, ''), ('a', 'a', 1, chr(10) || 'user:')) m(l, r, ins, added)
      WHERE m.l = w.state AND j.fault NOT IN ('b', 'd') AND (m.r <> 's' OR j.c = 's')) s) WHERE best = 1),
ends AS (SELECT w.conv_id, w.cost + 5 * e.ins AS cost, w.audit || repeat('I', e.ins) AS audit, w.lines || e.added AS lines,
    row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 5 * e.ins, w.audit || repeat('I', e.ins)) AS best
  FROM walk w JOIN shape s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i
  JOIN (VALUES ('', 0, ''), ('u', 1, chr(10) || 'assistant:'), ('a', 0, ''), ('s', 2, chr(10) || 'user:' || chr(10) || 'assistant:')) e(state, ins, added) ON e.state = w.state)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN shape s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.best = 1"""
