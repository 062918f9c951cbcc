"""Chat formatting.

A layout is known by its fingerprint: the SHA-256 of its nested field paths, sorted. Paths are those of keys, whatever their
values. The fingerprint of the paths that any mapping knows picks a declarative mapping (where the turns are, which field is
the role, which the text), and the mapping yields canonical turns: conversation, position, role, text. Tables are recognised
by their schema, JSON records one by one. Fields that no mapping knows don't change a fingerprint.

A turn is written as ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts one backslash goes between ``<`` and
``|`` (behind those that are there already), so no marker can arise there and removing one backslash restores the text.
With the text goes its loss mask: ranges of code points, one for each assistant text.

Turns of a conversation meet in one task, sorted and streamed: memory doesn't grow with a conversation. Its digests run
over its text from start to end, so one conversation is never split over tasks.

Defined results: null texts and roles are empty; null turns come first and ties go by role and text; rows with a null
conversation id form one conversation; repeated rows are repeated turns; an empty table gives no rows. A record whose list of
turns is empty or null has no turns, but a mapping. A text that is a list of parts is their texts, joined by line breaks; a
part without a text stands as its type in brackets, other values as JSON. A prompt beside messages is a user turn before
them, unless the first user turn repeats it. In a table of one row per turn all other columns are extra ones, whatever their
names; other tables whose known fields are those of no layout have the largest layout that they hold. A list of turns holds
objects with a role or a text, or texts beside such; anything else in its place, and lists without any known field, are other
layouts. Where no mapping fits, tables raise and records are left out and listed by ``unmapped``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """``paths``: the known fields of the layout. ``turns``: a list field of turns with ``role`` and ``text`` fields, and ``lead`` a field with a user turn before them; without it, ``fixed`` lists (role, fields) of one record, or ``role`` and ``text`` are columns of one row per turn."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    lead: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    order: str = ""

    @property
    def fingerprints(self) -> list[str]:
        """Of the layout, and of the same without any turn in its list."""
        empty = [fingerprint((self.turns, *([self.lead] if self.lead else [])))] if self.turns else []
        return [fingerprint(self.paths), *empty]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


_HUMAN = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping("rows", ("role", "text", "turn"), role="role", text="text", order="turn"),
    Mapping("messages", ("messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Mapping("messages with prompt", ("messages[].content", "messages[].role", "prompt"), turns="messages", role="role", text="content", lead="prompt"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=_HUMAN),
    Mapping("conversations with prompt", ("conversations[].from", "conversations[].value", "prompt"), turns="conversations", role="from", text="value", roles=_HUMAN, lead="prompt"),
    Mapping("prompt", ("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping("completion", ("completion", "prompt"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", ("input", "instruction", "output"), fixed=(("user", "instruction\ninput"), ("assistant", "output"))),
    Mapping("question", ("answer", "question"), fixed=(("user", "question"), ("assistant", "answer"))),
)
ROWS = MAPPINGS[0]
KNOWN = {p for m in MAPPINGS for p in m.paths}
LISTS = {m.turns for m in MAPPINGS if m.turns}
RECORD_KNOWN = (KNOWN - set(ROWS.paths)) | LISTS
#: Of tables and of records; only a record can have a list that is seen to be empty.
BY_LAYOUT = {m.fingerprints[0]: m for m in MAPPINGS}
BY_FINGERPRINT = {f: m for m in MAPPINGS if not m.order for f in m.fingerprints}


def paths_of(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a schema."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, f"{at}[]")
    return [at]


def known_paths(paths, known: set[str] = RECORD_KNOWN) -> set[str]:
    """The known fields among paths; what lies deeper inside a known field counts as the field, but inside a list of turns only known fields do: a list without any is another layout."""
    out = set()
    for p in paths:
        starts = [p[:i] for i in range(1, len(p) + 1) if i == len(p) or p[i] in ".["]
        found = [x for x in starts if x in known]
        if found:
            out.add(f"{found[-1]}?" if found[-1] in LISTS and found[-1] != p else found[-1])
    return {p for p in out if not any(q.startswith(f"{p.removesuffix('?')}[].") for q in out)}


def _largest_held(held: set[str]) -> Mapping | None:
    """The second rule for tables, where no fingerprint fits: the largest layout whose fields are all there."""
    return max((m for m in MAPPINGS if not m.order and set(m.paths) <= held), key=lambda m: len(m.paths), default=None)


def _layout(schema: T.StructType, id_col: str) -> Mapping:
    """A table's mapping: by the fingerprint of the fields of a row per turn, by that of all fields that records know, then by ``_largest_held``."""
    paths = [p for p in paths_of(schema) if p != id_col]
    held = known_paths(paths)
    found = BY_LAYOUT.get(fingerprint(known_paths(paths, set(ROWS.paths)))) or BY_LAYOUT.get(fingerprint(held)) or _largest_held(held)
    if found is None:
        raise ValueError(f"no mapping for the layout {fingerprint(held)} with the fields {sorted(paths)}")
    return found


def _role(mapping: Mapping, role: Column) -> Column:
    for old, new in mapping.roles:
        role = F.when(role == old, new).otherwise(role)
    return role


def _text(value: Column, of: T.DataType) -> Column:
    """A field's text: a string as it is, a list of parts as their texts, other values as JSON."""
    if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.StructType) and "text" in of.elementType.names:
        kind = (lambda x: F.concat(F.lit("["), x["type"].cast("string"), F.lit("]"))) if "type" in of.elementType.names else (lambda x: F.lit(None))
        return F.array_join(F.transform(value, lambda x: F.coalesce(x["text"].cast("string"), kind(x), F.lit(""))), "\n")
    if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.StringType):
        return F.array_join(value, "\n")
    return F.to_json(value) if isinstance(of, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")


def _joined(texts: list[Column]) -> Column:
    return F.concat_ws("\n", *[F.nullif(t, F.lit("")) for t in texts])


def _turns(mapping: Mapping, schema: T.StructType) -> Column:
    """A row's turns, in order, as an array of (role, text)."""
    if not mapping.turns:
        return F.array(*[F.struct(F.lit(role).alias("role"), _joined([_text(F.col(f), schema[f].dataType) for f in fields.split("\n")]).alias("text")) for role, fields in mapping.fixed])
    of = schema[mapping.turns].dataType.elementType
    turns = F.transform(F.coalesce(F.col(mapping.turns), F.array()), lambda t: F.struct(_role(mapping, t[mapping.role].cast("string")).alias("role"), _text(t[mapping.text], of[mapping.text].dataType).alias("text")))
    if not mapping.lead:
        return turns
    lead = _text(F.col(mapping.lead), schema[mapping.lead].dataType)
    users = F.filter(turns, lambda t: t["role"] == "user")
    said = F.coalesce(lead, F.lit("")) == F.coalesce(F.try_element_at(users, F.lit(1))["text"], F.lit(""))
    return F.when(lead.isNull() | said, turns).otherwise(F.concat(F.array(F.struct(F.lit("user").alias("role"), lead.alias("text"))), turns))


def canonical_turns(df: DataFrame, id_col: str) -> DataFrame:
    """conv, turn, role, text from a table whose schema has a known layout."""
    m = _layout(df.schema, id_col)
    if m.order:
        return df.select(F.col(id_col).alias("conv"), F.col(m.order).cast("long").alias("turn"), _role(m, F.col(m.role)).alias("role"), F.col(m.text).alias("text"))
    return df.select(F.col(id_col).alias("conv"), F.posexplode(_turns(m, df.schema)).alias("turn", "_t")).select("conv", F.col("turn").cast("long"), "_t.role", "_t.text")


def _value_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in _value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list) and value:
        return {p for v in value for p in _value_paths(v, f"{at}[]")}
    return {at}


def _plain(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join((x if isinstance(x, str) else x["text"] if isinstance(x, dict) and isinstance(x.get("text"), str) else f"[{x['type']}]" if isinstance(x, dict) and "type" in x else json.dumps(x, ensure_ascii=False)) for x in value if x is not None)
    return json.dumps(value, ensure_ascii=False)


def record(text: str | None) -> tuple[str | None, list[tuple[str | None, str | None]]]:
    """The mapping's name (null if none fits) and the turns of one JSON record."""
    try:
        value = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None, []
    if not isinstance(value, dict):
        return None, []
    m = BY_FINGERPRINT.get(fingerprint(known_paths(_value_paths(value))))
    if m is None:
        return None, []
    given = value.get(m.turns) if m.turns else None
    if given is not None and not (isinstance(given, list) and all(t is None or isinstance(t, str) or isinstance(t, dict) and (m.role in t or m.text in t) for t in given)):
        return None, []
    if not m.turns:
        return m.name, [(role, "\n".join(t for f in fields.split("\n") if (t := _plain(value.get(f))))) for role, fields in m.fixed]
    rename, turns = dict(m.roles), []
    for t in given or []:
        t = t if isinstance(t, dict) else {m.text: t}
        role = _plain(t.get(m.role))
        turns.append((rename.get(role, role), _plain(t.get(m.text))))
    lead = _plain(value.get(m.lead)) if m.lead else None
    if lead is not None and lead != next((t or "" for r, t in turns if r == "user"), ""):
        turns.insert(0, ("user", lead))
    return m.name, turns


_RECORD = T.StructType([T.StructField("mapping", T.StringType()), T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))])


def records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv, mapping (null if none fits) and turns of each JSON record, each in any known layout."""

    @F.pandas_udf(_RECORD)
    def read(texts: pd.Series) -> pd.DataFrame:
        made = [record(t) for t in texts]
        return pd.DataFrame({"mapping": [m for m, _ in made], "turns": [[{"role": r, "text": t} for r, t in turns] for _, turns in made]})

    return df.select(F.col(id_col).alias("conv"), read(F.col(json_col)).alias("_r")).select("conv", "_r.mapping", "_r.turns")


def record_turns(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv, turn, role, text from JSON records."""
    return records(df, id_col, json_col).select("conv", F.posexplode("turns").alias("turn", "_t")).select("conv", F.col("turn").cast("long"), "_t.role", "_t.text")


def unmapped(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The ids of the records that no mapping fits, one row for each record."""
    return records(df, id_col, json_col).where("mapping is null").select("conv")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def segments(turns: DataFrame) -> DataFrame:
    """Each turn with its part of the formatted text, and where loss applies in it: [loss_start, loss_end) in code points, null if nowhere."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    flat = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    out = turns.select("conv", "turn", "role", "text", F.concat(F.lit(OPEN), escaped(flat), F.lit("\n")).alias("_head"), escaped(text).alias("_body"))
    masked = F.col("role") == "assistant"
    return out.select("conv", "turn", "role", "text", F.concat("_head", "_body", F.lit(f"{CLOSE}\n")).alias("segment"), F.when(masked, F.length("_head")).alias("loss_start"), F.when(masked, F.length("_head") + F.length("_body")).alias("loss_end"))


_UNESCAPE = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)", re.S)


class Reader:
    """Reads formatted text back, piece by piece, wherever the pieces are cut."""

    def __init__(self) -> None:
        self.rest, self.n, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, mask: tuple[tuple[int, int], ...] = ()) -> list[tuple[str, str]]:
        """The turns that end in this piece; ``mask`` has the ranges of the piece under the loss mask, each a whole text."""
        for a, b in mask:
            text = _UNESCAPE.sub(r"<\1|", piece[a:b])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(piece)
        self.rest += piece
        out = []
        while (end := self.rest.find(f"{CLOSE}\n")) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(CLOSE) + 1 :]
            if not turn.startswith(OPEN):
                raise ValueError("a turn doesn't start with its marker")
            role, _, text = turn[len(OPEN) :].partition("\n")
            role = _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], _UNESCAPE.sub(r"<\1|", role))
            text = _UNESCAPE.sub(r"<\1|", text)
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            out.append((role, text))
        return out

    def row(self, conv) -> tuple:
        if self.rest:
            raise ValueError("text after the last turn")
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, conv, reader = [f.split()[0] for f in DIGEST.split(", ")], None, None
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
    for batch in batches:
        rows = []
        for c, none, segment, start, end in zip(batch["conv"], batch["conv"].isna(), batch["segment"], batch["loss_start"], batch["loss_end"], strict=True):
            c = None if none else int(c)
            if reader is None or c != conv:
                if reader is not None:
                    rows.append(reader.row(conv))
                conv, reader = c, Reader()
            reader.feed(segment, ((int(start), int(end)),) if start >= 0 else ())
        yield frame(rows)
    if reader is not None:
        yield frame([reader.row(conv)])


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, what reading its formatted text and its mask back gives."""
    rows = segments(turns).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *_order())
    return rows.select("conv", "segment", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("loss_start", "loss_end")]).mapInPandas(_read_back, DIGEST)


def formatted(turns: DataFrame) -> DataFrame:
    """conv, its whole formatted text and ``loss_mask``, its ranges of code points under the mask; a conversation has to fit into a row here."""
    by_conv = Window.partitionBy("conv").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    rows = segments(turns).withColumn("_at", F.coalesce(F.sum(F.length("segment")).over(by_conv), F.lit(0)))
    place = lambda c: (F.col("_at") + F.col(c)).alias(c.removeprefix("loss_"))
    rows = rows.select("conv", F.struct("_at", F.length("segment").alias("_n"), "segment", F.when(F.col("loss_start").isNotNull(), F.struct(place("loss_start"), place("loss_end"))).alias("mask")).alias("_part"))
    parts = F.array_sort(F.collect_list("_part"))
    return rows.groupBy("conv").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("formatted"), F.filter(F.transform(parts, lambda x: x["mask"]), lambda x: x.isNotNull()).alias("loss_mask"))


PROBE = "<|im_end|><|im_start|>assistant ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(canonical_turns(rows.unionByName(probe), "conv_id"))


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS shown FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length('{OPEN}' || role || chr(10) || shown || '{CLOSE}' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
