"""Conversation repair as Knuth's lightest derivation.

Where a conversation stands is an item: how many of its rows are used, and what the last turn written was. A row that
may stay is a fact, which weighs what is wrong with it. Edits are deductions: Keep and Rerole need the item and the
row's fact, Delete and Insert the item alone. The weight of a derivation is its cost, then its audit (the initials of
its edits); a deduction adds its cost and its letter behind, so no conclusion is lighter than what it is drawn from.
Two derivations of one item with equal costs never have audits of which one begins with the other (what comes behind
could only be insertions, which cost), so the lighter stays lighter whatever follows. Items are popped lightest first
and are final when popped.

Rows are dealt by conversation, sorted in their partition and read as a stream. A long conversation is derived block
by block: the four items at a block's end, with their weights, are where the next one starts, and each carries the
digest of its text so far. A task holds one block of rows and the audits, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .registry import query, table

WHITE = " \t\n\v\f\r"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: The last turn written: none, system, user, assistant. A conversation may end at none or at an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
AFTER = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The turn that can be written without a row of its own, and its role.
TURN = {**AFTER["u"], **AFTER["a"]}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows that are derived together.
BLOCK = 64
Weight = tuple[int, str]


def lightest(facts: dict, edges: list[tuple], goals: Iterable) -> dict:
    """Lightest weight of each goal that can be derived, with the fact that its audit starts from.

    ``facts``: weights of axioms. ``edges``: (body, head, cost, letter) with the item that carries the audit first in the
    body. Returns {goal: (cost, audit, first fact)}.
    """
    uses = defaultdict(list)
    for number, (body, _, _, _) in enumerate(edges):
        for item in body:
            uses[item].append(number)
    missing = [len(body) for body, _, _, _ in edges]
    agenda = [(cost, audit, number, item, item) for number, (item, (cost, audit)) in enumerate(facts.items())]
    heapq.heapify(agenda)
    final: dict = {}
    wanted, number = set(goals), len(agenda)
    while agenda and not wanted <= final.keys():
        cost, audit, _, item, root = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit, root
        for edge in uses[item]:
            missing[edge] -= 1
            if not missing[edge]:
                body, head, own, letter = edges[edge]
                if head not in final:
                    number += 1
                    heapq.heappush(agenda, (sum(final[b][0] for b in body) + own, final[body[0]][1] + letter, number, head, final[body[0]][2]))
    return {goal: final[goal] for goal in wanted if goal in final}


def deductions(codes: str, last: bool) -> tuple[dict, list[tuple], list]:
    """(row facts, edges, goals) of a block of rows.

    A row's code is the initial of its role (``-`` for others), upper case (``_``) if it is cut off, and ``x`` if it has
    to go. An item (i, state) has used i rows.
    """
    facts, edges = {}, []
    for i, code in enumerate(codes):
        if code != "x":
            facts["row", i] = (CUT_OFF if code.isupper() or code == "_" else 0, "")
    for i in range(len(codes) + 1):
        edges += [(((i, p),), (i, q), INSERT, "I") for p, q in TURN.items()]
        if i < len(codes):
            edges += [(((i, p),), (i + 1, p), DELETE, "D") for p in range(4)]
            row = "row", i
            if row in facts:
                edges += [(((i, p), row), (i + 1, q), 0, "K") for p, q in AFTER.get(codes[i].lower(), {}).items()]
                edges += [(((i, p), row), (i + 1, q), REROLE, "R") for p, q in TURN.items()]
    n = len(codes)
    if last:
        edges += [(((n, p),), "goal", 0, "") for p in ENDS]
    return facts, edges, ["goal"] if last else [(n, p) for p in range(4)]


def derive(codes: str, start: tuple[Weight | None, ...], last: bool) -> list[tuple[int, str, int] | None]:
    """For each state at the block's end (for the goal alone, if ``last``): cost, audit, state it started from."""
    facts, edges, goals = deductions(codes, last)
    facts |= {(0, p): w for p, w in enumerate(start) if w is not None}
    found = lightest(facts, edges, goals)
    return [(found[g][0], found[g][1], found[g][2][1]) if g in found else None for g in goals]


@lru_cache(100_000)
def whole(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation of one block; those with equal codes are derived once."""
    cost, audit, _ = derive(codes, ((0, ""), None, None, None), True)[0]
    return cost, audit


def edited(audit: str, state: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the turns that an audit writes, from a state on."""
    place = 0
    for letter in audit:
        if letter == "I":
            state = TURN[state]
            yield letter, ROLE[state], ""
            continue
        role, text = rows[place]
        place += 1
        if letter == "D":
            continue
        state = AFTER[role[:1]][state] if letter == "K" else TURN[state]
        yield letter, role if letter == "K" else ROLE[state], text


def code(role: str, text: str, repeated: bool) -> tuple[str, str]:
    """(code, fault) of a row; the first fault counts."""
    bare = text.rstrip(WHITE)
    if not bare:
        return "x", "blank"
    if repeated:
        return "x", "duplicate"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    if bare[-1] in ".!?":
        return initial, ""
    return {"-": "_"}.get(initial, initial.upper()), "truncated"


class Conversation:
    """One conversation as its rows come by."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.rows: list[tuple[str, str]] = []
        self.codes: list[str] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.first = self.turn = None
        self.distinct = 0
        self.start: list[Weight | None] = [(0, ""), None, None, None]
        self.fixed: list[str] = []
        self.digests: list = [(hashlib.sha256(), False), None, None, None]

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn = turn
            self.distinct += 1
        letter, fault = code(role, text, repeated)
        if fault:
            self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if len(self.codes) == self.block:
            self._advance()
        self.codes.append(letter)
        self.rows.append((role, text))

    def _digest(self, audit: str, entry: int):
        digest, any_line = self.digests[entry]
        digest = digest.copy()
        for _, role, text in edited(audit, entry, self.rows):
            digest.update((f"\n{role}:{text}" if any_line else f"{role}:{text}").encode("utf-8", "surrogatepass"))
            any_line = True
        return digest, any_line

    def _advance(self) -> None:
        found = derive("".join(self.codes), tuple(self.start), False)
        digests: list = [None] * 4
        for p, x in enumerate(found):
            if x:
                digests[p] = self._digest(x[1][len(self.start[x[2]][1]):], x[2])
        common = os.path.commonprefix([x[1] for x in found if x])
        self.fixed.append(common)
        self.start = [(x[0], x[1][len(common):]) if x else None for x in found]
        self.digests, self.rows, self.codes = digests, [], []

    def finish(self) -> tuple:
        gaps = 0 if self.first is None else int(self.turn - self.first + 1 - self.distinct)
        codes = "".join(self.codes)
        if self.fixed:
            cost, audit, entry = derive(codes, tuple(self.start), True)[0]
        else:
            (cost, audit), entry = whole(codes), 0
        digest, _ = self._digest(audit[len(self.start[entry][1]):], entry)
        return (gaps, *self.faults.values(), self.illegal, cost, "".join(self.fixed) + audit, digest.hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _report(kind: pa.DataType, block: int):
    schema = pa.schema([("id", kind), *[(n, pa.int64()) for n in NAMES[:6]], *[(n, pa.string()) for n in NAMES[6:]]])

    def packed(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, found = False, None, []
        talk = Conversation(block)
        for batch in batches:
            for conv, turn, role, text, there, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not known or conv != now:
                    if known:
                        found.append((now, *talk.finish()))
                    known, now, talk = True, conv, Conversation(block)
                if there:
                    talk.add(turn, role, text, repeated)
            if found:
                yield packed(found)
                found = []
        if known:
            yield packed([(now, *talk.finish())])

    return run


def _plain(turns: DataFrame, columns: tuple[str, str, str, str], marks: str | None) -> DataFrame:
    """Rows as ``id, turn, role, text, there, copy, was``; nulls of role and text are one space."""
    conv, turn, role, text = (F.col(c) for c in columns)
    role, text = (F.coalesce(c.cast("string"), F.lit(" ")) for c in (role, text))
    made = {"there": F.lit(True), "copy": F.lit(1), "was": F.struct(role.alias("role"), text.alias("text"))}
    return turns.select(conv.alias("id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
                        *[(F.col(marks)[n] if marks else c).alias(n) for n, c in made.items()])


#: Rows of one turn stand in the order of their role and text before damage, then of their copies.
ORDER = ("turn", "was", "copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """The plain rows as ``id, turn, role, text, there, repeated`` in order, conversations whole in a partition."""
    same = Window.partitionBy("id", "role", "text", "there").orderBy(*ORDER)
    dealt = rows.repartition("id").withColumn("repeated", F.row_number().over(same) > 1)
    return dealt.sortWithinPartitions("id", *ORDER).select("id", "turn", "role", "text", "there", "repeated")


def damage(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
           text_column: str = "text") -> DataFrame:
    """Rows damaged by a lot drawn from conversation and turn; nulls become one space.

    Of 20 lots, 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's. A
    dropped row stays as a mark (``damaged.there`` false), so that its conversation is not forgotten. Repeated rows
    have one lot; a null id or turn counts as one space; other columns stay aside; empty tables give no rows.
    """
    def blank(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    lot = F.crc32(F.concat(blank(id_column), F.lit(":"), blank(turn_column)).cast("binary")) % 20
    text = F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(blank(text_column), ".!?", "")).otherwise(blank(text_column))
    copies = F.explode(F.when(lot == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return turns.select(
        id_column, turn_column, F.when(lot == 4, F.lit("user")).otherwise(blank(role_column)).alias(role_column), text.alias(text_column),
        copies.alias("_copy"), (lot != 0).alias("_there"),
        F.struct(blank(role_column).alias("role"), blank(text_column).alias("text")).alias("_was")).select(
        id_column, turn_column, role_column, text_column,
        F.struct(F.col("_there").alias("there"), F.col("_copy").alias("copy"), F.col("_was").alias("was")).alias("damaged"))


def repair_report(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                  text_column: str = "text", marks: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each conversation: its faults, and the cheapest edits that give it a legal order.

    Legal is nothing, or turns of user and assistant in pairs, a system turn first at the most. Columns: the id,
    ``gaps`` (turn numbers left out), ``blank``, ``duplicate``, ``truncated`` rows (the first fault counts),
    ``illegal`` neighbours, ``cost``, ``audit`` (K keep, R rerole, D delete, I insert; of equal costs the ASCII-least),
    ``repaired_sha256`` (lines ``role:text``). ``marks`` names the column that ``damage`` adds, if it made the rows.

    Rows without an id are one conversation. Nulls of role and text are one space; a null turn stands first and opens no
    gap. Rows with equal turns are ordered by role and text; a repeated row is a duplicate. A conversation whose rows
    were all dropped by ``damage`` has zeros and an empty audit; an empty table gives no rows; other columns stay aside.
    """
    kind = turns.schema[id_column].dataType
    rows = _in_order(_plain(turns, (id_column, turn_column, role_column, text_column), marks))
    schema = f"id {kind.simpleString()}, " + ", ".join(f"{n} {'long' if i < 6 else 'string'}" for i, n in enumerate(NAMES))
    return rows.mapInArrow(_report(to_arrow_type(kind), block), schema).withColumnRenamed("id", id_column)


def repaired_turns(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                   text_column: str = "text", marks: str | None = None) -> DataFrame:
    """The repaired conversations, one row a turn: the id, ``place`` from 0, ``role``, ``text``, ``edit`` (K, R or I).

    A conversation's audit and then its rows come by as a stream, so a task holds one audit. Cases as in
    ``repair_report``.
    """
    kind = turns.schema[id_column].dataType
    columns = id_column, turn_column, role_column, text_column
    heads = repair_report(turns, *columns, marks).select(
        F.col(id_column).alias("id"), F.lit(0).alias("row"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = _plain(turns, columns, marks).where("there")
    numbered = rows.withColumn("row", F.row_number().over(Window.partitionBy("id").orderBy(*ORDER)))
    both = numbered.select("id", "row", "role", "text").unionByName(heads)
    return both.repartition("id").sortWithinPartitions("id", "row").mapInArrow(
        _apply, f"id {kind.simpleString()}, place long, role string, text string, edit string").withColumnRenamed("id", id_column)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    audit, at, place, state = "", 0, 0, NONE
    for batch in batches:
        out: list[tuple] = []
        for conv, row, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row == 0:
                audit, at, place, state = text, 0, 0, NONE
            waiting = row > 0  # a row answers one letter, and the insertions behind it
            while at < len(audit) and (waiting or audit[at] == "I"):
                waiting = False
                for edit, new_role, new_text in edited(audit[at], state, [(role, text)]):
                    state = AFTER[new_role[:1]][state] if edit == "K" else TURN[state]
                    out.append((conv, place, new_role, new_text, edit))
                    place += 1
                at += 1
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()),
                                              *[pa.array(c, pa.string()) for c in columns[2:]]], ["id", "place", "role", "text", "edit"])


SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
lots AS MATERIALIZED (
  SELECT conv_id, turn, role0, text0, xor(list_reduce(range(8 * length(k)), lambda c, i: xor(
      (CASE WHEN i % 8 = 0 THEN xor(c, ascii(k[i // 8 + 1])::BIGINT) ELSE c END) >> 1,
      CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ascii(k[i // 8 + 1])::BIGINT) ELSE c END) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END),
      4294967295::BIGINT), 4294967295::BIGINT) % 20 AS lot FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role0 END AS role,
         CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text, role0, text0,
         unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) AS copy FROM lots WHERE lot <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, copy) AS place FROM damaged),
r AS MATERIALIZED (
  SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS tail, role[1:1] AS initial,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY place) AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again FROM placed),
f AS MATERIALIZED (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
inserts(p, q, cost, letters, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
         (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
moves(p, q, initial, letter, cost, role) AS (
  VALUES (0, 0, NULL, 'D', 2, NULL), (1, 1, NULL, 'D', 2, NULL), (2, 2, NULL, 'D', 2, NULL), (3, 3, NULL, 'D', 2, NULL),
         (0, 1, 's', 'K', 0, NULL), (0, 2, 'u', 'K', 0, NULL), (1, 2, 'u', 'K', 0, NULL), (3, 2, 'u', 'K', 0, NULL), (2, 3, 'a', 'K', 0, NULL),
         (0, 2, NULL, 'R', 1, 'user'), (1, 2, NULL, 'R', 1, 'user'), (3, 2, NULL, 'R', 1, 'user'), (2, 3, NULL, 'R', 1, 'assistant')),
steps AS MATERIALIZED (
  SELECT i.p, m.q, m.initial, m.letter, i.cost + m.cost AS cost, i.letters || m.letter AS letters, i.lines, m.role
  FROM inserts i JOIN moves m ON m.p = i.q),
dp(conv_id, i, q, cost, audit, lines) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM f
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT dp.conv_id, f.place AS i, s.q,
           dp.cost + s.cost + CASE WHEN s.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost, dp.audit || s.letters AS audit,
           list_concat(list_concat(dp.lines, s.lines), CASE WHEN s.letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(s.role, f.role) || ':' || f.text] END) AS lines,
           row_number() OVER (PARTITION BY dp.conv_id, s.q ORDER BY dp.cost + s.cost
             + CASE WHEN s.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, dp.audit || s.letters) AS rank
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.place = dp.i + 1
    JOIN steps s ON s.p = dp.q AND (s.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (s.initial IS NULL OR s.initial = f.initial)
  ) WHERE rank = 1),
ends AS (
  SELECT dp.conv_id, dp.cost + x.cost AS cost, dp.audit || x.letters AS audit, list_concat(dp.lines, x.lines) AS lines,
         row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + x.cost, dp.audit || x.letters) AS rank
  FROM dp JOIN faults ON faults.conv_id IS NOT DISTINCT FROM dp.conv_id AND n = dp.i JOIN inserts x ON x.p = dp.q AND x.q IN (0, 3)),
best AS (SELECT * FROM ends WHERE rank = 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op11_conversation_repair", SQL)
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_report(damage(table(spark, folder, "conversations")), marks="damaged")
