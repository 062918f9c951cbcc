"""Conversation structure repair.

A conversation's turns are edited into system?, then user and assistant in turn, at the least cost; of equally cheap edits
the audit string, one initial for each edit, decides. What the turns so far come to is one of four states: nothing yet, a
system turn, a user turn last, an assistant turn last. A macro edit is a run of inserts with the row's own edit behind it:
``D``, ``IIK`` and so on. Two inserts at most, since from each state two reach every other that can be reached, and more
come back to one for more. Macro codes are prefix-free (only their last letter isn't ``I``), so audit strings of equally many
rows compare as their macros do, one after the other, and none begins with another. So a layer (the states after a row) needs
no strings: each state has its cost and the rank of its audit string in the layer, from its parent's rank and the macro's
place in the ordered codes, and a pointer to the parent. The strings are put together once, backward from the end.

Conversations of up to ``BIG_ROWS`` rows and ``BIG_CHARS`` characters are one shuffle's groups, whole in a task. Larger ones
are sorted by range over tasks and cut into segments. A segment's table has cost and rank for each pair of states before and
after it; ranks of segments chain as macros do, since their audit strings are prefix-free too. With the chain's states each
segment makes its own edits. The digest runs over a conversation's text in order, so that is one task's streaming in the end.

Defined results: null roles, texts, conversation ids and turns count as one space where the damage reads or writes them; null
ids are one conversation; null turns come first, ties go by role and text; other columns play no role; repeated rows are
duplicates; an empty table gives no rows. A role's initial is its first character, none for an empty role.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE_CLASS, Scratch, pinned, sql_crc, table

BIG_ROWS, BIG_CHARS, SEGMENT = 20_000, 32_000_000, 20_000
#: States: nothing, system, user last, assistant last.
E, S, U, A = range(4)
INSERTED = {E: U, S: U, U: A, A: U}
KEPT = {(E, "s"): S, (E, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
INITIALS = {"s": 0, "u": 1, "a": 2}
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
CUT_OFF = 5
CODES = sorted("I" * n + x for n in range(3) for x in "DKR")
ROLES = {U: "user", A: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


def kind_of(fault: str, initial: str) -> int:
    """What the edits depend on: 0 for rows that must go, else initial and truncation."""
    return 0 if fault in ("b", "d") else 1 + 2 * INITIALS.get(initial, 3) + (fault == "t")


def edges(fault: str, initial: str) -> list[tuple[int, int, int, int]]:
    """(state before, code, state after, cost) of every macro edit of a row."""
    out = []
    for before in range(4):
        for code, name in enumerate(CODES):
            at = before
            for _ in name[:-1]:
                at = INSERTED[at]
            last = name[-1]
            if last != "D" and fault in ("b", "d"):
                continue
            after = at if last == "D" else INSERTED[at] if last == "R" else KEPT.get((at, initial))
            if after is not None:
                out.append((before, code, after, sum(map(COST.get, name)) + CUT_OFF * (last != "D" and fault == "t")))
    return out


KINDS = {kind_of(f, i): edges(f, i) for f in ("b", "t", "") for i in ("s", "u", "a", "?")}


class Layers:
    """Costs, ranks and parents, layer by layer; ``entries`` are the states to begin with, each followed apart but ranked together."""

    def __init__(self, entries: Sequence[int] = (E,)):
        self.now = {(e, e): (0, 0) for e in entries}
        self.parents: list[dict[tuple[int, int], tuple[int, int]]] = []

    def step(self, moves: list[tuple[int, int, int, int]]) -> None:
        best: dict[tuple[int, int], tuple[int, tuple[int, int], int]] = {}
        for (entry, state), (cost, rank) in self.now.items():
            for before, code, after, price in moves:
                if before == state:
                    found = (cost + price, (rank, code), state)
                    key = (entry, after)
                    if key not in best or found < best[key]:
                        best[key] = found
        ranks = {k: n for n, k in enumerate(sorted({b[1] for b in best.values()}))}
        self.now = {k: (cost, ranks[name]) for k, (cost, name, _) in best.items()}
        self.parents.append({k: (state, name[1]) for k, (_, name, state) in best.items()})

    def path(self, entry: int, state: int) -> list[tuple[int, int]]:
        """(state before, code) of each step on the way to a state."""
        out = []
        for layer in reversed(self.parents):
            before, code = layer[entry, state]
            out.append((before, code))
            state = before
        return out[::-1]

    def end(self) -> tuple[int, int, int]:
        """The cheapest last state from an empty start, the inserts behind it, and the cost of all."""
        tails = {E: 0, A: 0, U: 1, S: 2}
        cost, _, state = min((cost + COST["I"] * tails[s], rank, s) for (_, s), (cost, rank) in self.now.items())
        return state, tails[state], cost


def lines(state: int, code: int, role: str, text: str) -> list[str]:
    """The repaired turns that a macro edit of a row gives."""
    name, out = CODES[code], []
    for letter in name:
        if letter == "I":
            state = INSERTED[state]
            out.append(f"{ROLES[state]}:")
        elif letter == "R":
            out.append(f"{ROLES[INSERTED[state]]}:{text}")
        elif letter == "K":
            out.append(f"{role}:{text}")
    return out


def tail_lines(state: int, inserts: int) -> list[str]:
    out = []
    for _ in range(inserts):
        state = INSERTED[state]
        out.append(f"{ROLES[state]}:")
    return out


class Total:
    """The result row of a conversation, fed row by row in order."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.before = dict.fromkeys("bdt", 0), 0, None
        self.low = self.high = self.last = None
        self.turns, self.audit, self.sha, self.begun = 0, [], hashlib.sha256(), False

    def row(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += turn != self.last
            self.last = turn

    def edit(self, audit: str, made: list[str]) -> None:
        self.audit.append(audit)
        for line in made:
            self.sha.update(("\n" * self.begun + line).encode())
            self.begun = True

    def result(self, conv, cost: int) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return conv, gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.sha.hexdigest()


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _results(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *[T.StructField(n, T.LongType()) for n in NAMES[1:7]], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def _batch(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
    types = [of, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=NAMES)


def _streams(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    """(conversation, an iterator of the values of its rows), for rows sorted by ``conv``; each iterator has to be used up."""
    rows = (row for b in batches for row in zip(*[b.column(n).to_pylist() for n in ("conv", *names)], strict=True))
    held = next(rows, None)

    def group(conv) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[0] == conv:
            yield held[1:]
            held = next(rows, None)

    while held is not None:
        yield held[0], group(held[0])


# Faults


def damaged(df: DataFrame) -> DataFrame:
    """conv, turn, role, text and ``copies`` of each row of (conv_id, turn, role, text), damaged by a rule; 0 copies of those that are dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return df.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def intact(df: DataFrame) -> DataFrame:
    """The same of rows as they are."""
    return df.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


def _own_fault() -> Column:
    """b, t or nothing: a row's fault by its text alone."""
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    return F.when(ended == "", "b").when(~F.substring(ended, -1, 1).isin(".", "!", "?"), "t").otherwise("")


_ORDER = ("turn", "role", "text")


def _sorted(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


# Conversations that fit a task


def _small(rows: DataFrame) -> DataFrame:
    rows = rows.select("conv", "turn", "role", "text", "copies", _own_fault().alias("fault"), F.substring("role", 1, 1).alias("initial"))
    kind = rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, group in _streams(batches, ("turn", "role", "text", "copies", "fault", "initial")):
            total, layers, held, seen = Total(), Layers(), [], set()
            for turn, role, text, copies, fault, initial in group:
                for _ in range(copies):
                    fault = "d" if fault != "b" and (role, text) in seen else fault
                    seen.add((role, text))
                    total.row(turn, initial, fault)
                    layers.step(KINDS[kind_of(fault, initial)])
                    held.append((role, text))
            out.append(_finished(total, layers, held, conv))
            if len(out) >= 1000:
                yield _batch(out, to_arrow_type(kind))
                out = []
        if out:
            yield _batch(out, to_arrow_type(kind))

    return rows.repartition("conv").sortWithinPartitions(*_sorted("conv", *_ORDER)).mapInArrow(run, _results(kind))


def _finished(total: Total, layers: Layers, held: list[tuple[str, str]], conv) -> tuple:
    state, inserts, cost = layers.end()
    for (before, code), (role, text) in zip(layers.path(E, state), held, strict=True):
        total.edit(CODES[code], lines(before, code, role, text))
    total.edit("I" * inserts, tail_lines(state, inserts))
    return total.result(conv, cost)


# Conversations over many tasks


def _large(rows: DataFrame, scratch: Scratch) -> DataFrame:
    kind = rows.schema["conv"].dataType
    arrow = to_arrow_type(kind)
    alike = rows.where("copies > 0").groupBy("conv", *_ORDER).agg(F.sum("copies").alias("n"))
    alike = scratch.write(alike.withColumn("key", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)), "alike")
    turn = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    first = alike.groupBy(F.col("conv").alias("_c"), F.col("key").alias("_k")).agg(F.min(turn).alias("_first"))
    rows = alike.join(first, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    fault = F.when(_own_fault() == "b", "b").when((turn != F.col("_first")) | (F.col("copy") > 1), "d").otherwise(_own_fault())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("conv", "turn", "role", "text", "copy", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))
    rows = rows.repartitionByRange(n, *_sorted("conv", *_ORDER, "copy")).sortWithinPartitions(*_sorted("conv", *_ORDER, "copy"))
    # partition and place in it, in one number; segments are stretches of these numbers
    rows = scratch.write(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("segment", F.floor(F.col("at") / SEGMENT)), "sorted")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, group in _streams(batches, ("segment", "fault", "initial")):
            layers, at = None, None
            for segment, fault, initial in group:
                if segment != at:
                    if layers:
                        yield table_of(conv, at, layers)
                    layers, at = Layers(range(4)), segment
                layers.step(KINDS[kind_of(fault, initial)])
                layers.parents.clear()
            yield table_of(conv, at, layers)

    def table_of(conv, segment: int, layers: Layers) -> pa.RecordBatch:
        moves = [x for (before, after), (cost, rank) in layers.now.items() for x in (before, rank, after, cost)]
        return pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([segment], pa.int64()), pa.array([moves], pa.list_(pa.int64()))], names=["conv", "segment", "moves"])

    conv_field, segment_field = T.StructField("conv", kind), T.StructField("segment", T.LongType())
    made = rows.select("conv", "segment", "at", "fault", "initial").repartition("conv", "segment").sortWithinPartitions(*_sorted("conv", "segment", "at"))
    made = made.mapInArrow(tables, T.StructType([conv_field, segment_field, T.StructField("moves", T.ArrayType(T.LongType()))]))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, group in _streams(batches, ("segment", "moves")):
            layers, segments = Layers(), []
            for segment, moves in group:
                layers.step(list(map(tuple, np.array(moves).reshape(-1, 4).tolist())))
                segments.append(segment)
            state, inserts, cost = layers.end()
            befores = [b for b, _ in layers.path(E, state)]
            cols = [pa.array([conv] * len(segments), arrow), pa.array(segments, pa.int64()), pa.array(befores, pa.int32()), pa.array([*befores[1:], state], pa.int32())]
            last = [0] * (len(segments) - 1)
            yield pa.RecordBatch.from_arrays([*cols, pa.array([*last, inserts], pa.int32()), pa.array([*last, cost], pa.int64())], names=["conv", "segment", "before", "after", "inserts", "cost"])

    ints = [T.StructField(c, T.IntegerType()) for c in ("before", "after", "inserts")]
    chain = made.repartition("conv").sortWithinPartitions(*_sorted("conv", "segment")).mapInArrow(chained, T.StructType([conv_field, segment_field, *ints, T.StructField("cost", T.LongType())]))
    chain = scratch.write(chain, "chain")

    # a segment's chain row stands before its rows
    empty = lambda c: F.lit(None).cast(c[1]).alias(c[0])
    facts = [("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "string"), ("initial", "string")]
    steps = [("before", "int"), ("after", "int"), ("inserts", "int"), ("cost", "long")]
    both = chain.select("conv", "segment", F.lit(-1).cast("long").alias("at"), *map(empty, facts), *[c for c, _ in steps]).unionByName(rows.select("conv", "segment", "at", *[c for c, _ in facts], *map(empty, steps)))
    names = ("segment", "at", *[c for c, _ in facts], *[c for c, _ in steps])
    edited = T.StructType([conv_field, T.StructField("at", T.LongType()), T.StructField("turn", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("fault", "initial", "audit")], T.StructField("made", T.ArrayType(T.StringType())), T.StructField("cost", T.LongType())])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(conv, step: tuple, layers: Layers, held: list) -> pa.RecordBatch:
            before, after, inserts, cost = step
            out = [(conv, at, turn, fault, initial, CODES[code], lines(state, code, role, text), 0) for (state, code), (at, turn, role, text, fault, initial) in zip(layers.path(before, after), held, strict=True)]
            out.append((conv, held[-1][0], None, None, None, "I" * inserts, tail_lines(after, inserts), cost))
            types = [arrow, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=edited.names)

        for conv, group in _streams(batches, names):
            step, layers, held = None, None, []
            for _, at, turn, role, text, fault, initial, *own in group:
                if at < 0:
                    if held:
                        yield done(conv, step, layers, held)
                    step, layers, held = tuple(own), Layers((own[0],)), []
                else:
                    layers.step(KINDS[kind_of(fault, initial)])
                    held.append((at, turn, role, text, fault, initial))
            if held:
                yield done(conv, step, layers, held)

    edited_rows = both.repartition("conv", "segment").sortWithinPartitions(*_sorted("conv", "segment", "at")).mapInArrow(edits, edited)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, group in _streams(batches, ("turn", "fault", "initial", "audit", "made", "cost")):
            total, cost = Total(), 0
            for turn, fault, initial, audit, made_lines, own in group:
                if fault is not None:
                    total.row(turn, initial, fault)
                total.edit(audit, made_lines)
                cost += own
            yield _batch([total.result(conv, cost)], arrow)

    # a segment's own last row comes behind the row whose place it shares
    return edited_rows.repartition("conv").sortWithinPartitions(*_sorted("conv", "at"), F.col("fault").isNull()).mapInArrow(totals, _results(kind))


def repaired(rows: DataFrame) -> DataFrame:
    """A result row for each conversation of ``damaged`` or ``intact`` rows; their texts are read twice."""
    size = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    with Scratch(rows.sparkSession) as scratch:
        large = scratch.write(size.where((F.col("n") > BIG_ROWS) | (F.col("chars") > BIG_CHARS)).select(F.col("conv").alias("_c")), "large")
        n = large.count()
        if not n:
            return pinned(_small(rows))
        one = large.select(F.col("_c"), F.lit(True).alias("_large"))
        flagged = rows.join(F.broadcast(one) if n <= BIG_ROWS else one, F.col("conv").eqNullSafe(F.col("_c")), "left").drop("_c")
        small = _small(flagged.where("_large is null").drop("_large"))
        done = scratch.write(_large(flagged.where("_large").drop("_large"), scratch), "done")
        nothing = large.join(done, F.col("_c").eqNullSafe(F.col("conv_id")), "left_anti")  # all of their rows were dropped
        zeros = nothing.select(F.col("_c").alias("conv_id"), *[F.lit(0).cast("long").alias(c) for c in NAMES[1:7]], F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
        return pinned(small.unionByName(done).unionByName(zeros))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def _moves_sql() -> str:
    """(state before, macro, initial it needs, state after, cost, inserted roles, what becomes of the row)."""
    rows = []
    for before in range(4):
        for name in CODES:
            at, made = before, []
            for _ in name[:-1]:
                at = INSERTED[at]
                made.append(f"{ROLES[at]}:")
            last = name[-1]
            for need, after in [("*", at)] if last == "D" else [("*", INSERTED[at])] if last == "R" else [(i, to) for (s, i), to in KEPT.items() if s == at]:
                rows.append(f"({before}, '{name}', '{need}', {after}, {sum(map(COST.get, name))}, {made or '[]::VARCHAR[]'}, '{ROLES[after] if last == 'R' else ''}')")
    return ", ".join(rows)


ORACLE = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS c FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE c WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src
), num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM hurt
), r AS (
  SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^{SPACE_CLASS}]') THEN 'b' WHEN again > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][{SPACE_CLASS}]*$') THEN 't' ELSE '' END AS fault FROM num
), m(a, code, need, b, price, made, becomes) AS (
  VALUES {_moves_sql()}
), dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, []::VARCHAR[] AS made FROM src
  UNION ALL
  SELECT conv_id, i, st, cost, audit, made FROM (
    SELECT dp.conv_id, r.i, m.b AS st, dp.cost + m.price + CASE WHEN fault = 't' AND right(code, 1) <> 'D' THEN 5 ELSE 0 END AS cost, audit || code AS audit,
      list_concat(list_concat(dp.made, m.made), CASE right(code, 1) WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [becomes || ':' || text] END) AS made,
      row_number() OVER (PARTITION BY dp.conv_id, m.b ORDER BY dp.cost + m.price + CASE WHEN fault = 't' AND right(code, 1) <> 'D' THEN 5 ELSE 0 END, audit || code) AS n
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN m ON m.a = dp.st AND need IN ('*', ini) AND (fault NOT IN ('b', 'd') OR right(code, 1) = 'D')
  ) WHERE n = 1
), ends(st, tail, price, made) AS (
  VALUES (0, '', 0, []::VARCHAR[]), (3, '', 0, []::VARCHAR[]), (2, 'I', 5, ['assistant:']), (1, 'II', 10, ['user:', 'assistant:'])
), last AS (
  SELECT conv_id, max(i) AS i FROM dp GROUP BY conv_id
), f AS (
  SELECT dp.conv_id, cost + price AS cost, audit || tail AS audit, list_concat(dp.made, ends.made) AS made FROM dp JOIN last ON dp.conv_id IS NOT DISTINCT FROM last.conv_id AND dp.i = last.i JOIN ends ON dp.st = ends.st
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost + price, audit || tail) = 1
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM r) GROUP BY conv_id
)
SELECT f.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(array_to_string(made, chr(10))) AS repaired_sha256
FROM f LEFT JOIN g ON f.conv_id IS NOT DISTINCT FROM g.conv_id
"""
