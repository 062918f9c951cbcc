"""Benchmark decontamination.

Wu-Manber search over words. The patterns are all windows of ``WINDOW`` consecutive words of the test items; items of fewer
words are one pattern each, and patterns of one length share one set of tables. A block is ``BLOCK`` adjacent words. The
shift table says how far the search may go on when it sees a block: to where the block stands last in any pattern, or past
the block if it is in none. Where the shift is 0, the bucket of that suffix block selects the patterns that end in it, by
their prefix block, and comparing all words confirms them. So most positions of a clean text are never looked at.

Documents stay where they are: each task searches its rows with tables of the items. The items' words are counted first. Up
to ``MOST_CHARS`` characters they go to the tasks at once; beyond that pieces of items (overlapping, so that no window is
cut) are dealt into parts of checked size, and the documents go through one part after the other.

Defined results: null texts have no words, and an item without words has no window; items with equal ids count as one, items
with a null id mark words without being counted or named; of repeated items or windows each counts once; an empty table of
items marks nothing, one of documents gives no rows; null ids and repeated rows of documents are rows like others; columns
of documents that clash with new ones are replaced, all others go along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, pinned, table

WINDOW, BLOCK = 10, 2
#: Characters of items' words in one set of tables (some 100 MB in a worker), and words of an item in one piece.
MOST_CHARS, PIECE = 2_000_000, 1000

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Lower-cases A-Z and blanks all other bytes that no word has.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


class Tables:
    """Shift and bucket tables for patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        #: Suffix block -> prefix block -> the patterns, as numbers.
        self.buckets: dict[tuple, dict[tuple, list[int]]] = {}
        self.patterns: list[tuple] = []
        self.items: list[set] = []

    def add(self, pattern: tuple, item: str | None) -> None:
        b = self.block
        bucket = self.buckets.setdefault(pattern[-b:], {}).setdefault(pattern[:b], [])
        known = next((p for p in bucket if self.patterns[p] == pattern), None)
        if known is None:
            known = len(self.patterns)
            bucket.append(known)
            self.patterns.append(pattern)
            self.items.append(set())
            for end in range(b, self.length + 1):
                block, left = pattern[end - b : end], self.length - end
                if left < self.shift.get(block, self.far):
                    self.shift[block] = left
        if item is not None:
            self.items[known].add(item)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence, by start."""
        n, b, far, end = self.length, self.block, self.far, self.length
        shift, patterns, size = self.shift.get, self.patterns, len(words)
        while end <= size:
            skip = shift(tuple(words[end - b : end]), far)
            if skip:
                end += skip
                continue
            start = end - n
            for p in self.buckets[tuple(words[end - b : end])].get(tuple(words[start : start + b]), ()):
                if patterns[p] == tuple(words[start:end]):
                    yield start, p
            end += 1


def built(items: list[tuple[str | None, list[bytes], bool]]) -> list[Tables]:
    """Tables of (item, words, whole) with one set for each length; pieces of long items aren't ``whole``."""
    by_length: dict[int, Tables] = {}
    for item, words, whole in items:
        n = min(len(words), WINDOW) if whole else WINDOW
        for k in range(len(words) - n + 1 if n else 0):
            by_length.setdefault(n, Tables(n)).add(tuple(words[k : k + n]), item)
    return list(by_length.values())


def found(words: list[bytes], tables: list[Tables]) -> tuple[list[list[int]], set[str]]:
    """Merged ranges [start, end) of hit words, and the items."""
    spans, items = [], set()
    for t in tables:
        for start, p in t.occurrences(words):
            spans.append((start, start + t.length))
            items |= t.items[p]
    return merged(spans), items


def merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_WORDS = rf"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPANS, _ITEMS = T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType())


def _pieces(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, piece, w, whole): the items' words in pieces of ``PIECE`` windows at most."""
    w = F.array_remove(F.split(F.translate(F.coalesce(text_col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    rows = items.select(F.col(id_col).cast("string").alias("item"), w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("w"), F.lit(WINDOW)) - WINDOW) / PIECE).cast("int"))
    rows = rows.select("item", "w", F.explode(starts).alias("piece"))
    return rows.select("item", "piece", F.slice("w", F.col("piece") * PIECE + 1, F.lit(PIECE + WINDOW - 1)).alias("w"), (F.size("w") <= PIECE + WINDOW - 1).alias("whole"))


def _parts(pieces: DataFrame) -> list[DataFrame]:
    """The pieces, dealt into parts of ``MOST_CHARS`` characters, or of one piece."""
    size = F.length(F.array_join("w", " "))
    total = pieces.agg(F.sum(size)).first()[0] or 0
    n = -(-total // MOST_CHARS) or 1
    while n > 1:
        dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("item", "piece", F.hash("w")), F.lit(n)))
        worst = dealt.groupBy("_part").agg(F.sum(size).alias("n"), F.count_distinct(F.hash("w")).alias("k")).where("k > 1").agg(F.max("n")).first()[0] or 0
        if worst <= 2 * MOST_CHARS or n > 4 * total // MOST_CHARS + 64:
            return [dealt.where(F.col("_part") == k) for k in range(n)]
        n *= 2
    return [pieces]


def marked(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, ``spans`` ([start, end) of hit words) and ``items`` (ids as texts, sorted)."""
    made = ("n_words", "spans", "items")
    rest = [c for c in docs.columns if c not in made or c == text_col]
    fields = [docs.schema[c] for c in rest]
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(rest)], F.lit(None).cast(_SPANS).alias("_s"), F.lit(None).cast(_ITEMS).alias("_i"))
    at, n = rest.index(text_col), len(rest)
    schema = T.StructType([*[T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(fields)], T.StructField("_n", T.LongType()), T.StructField("_s", _SPANS), T.StructField("_i", _ITEMS)])
    parts = _parts(pinned(_pieces(items, item_col, item_text)))

    def searched(before: DataFrame, part: DataFrame) -> DataFrame:
        tables = before.sparkSession.sparkContext.broadcast(built([(r["item"], [w.encode() for w in r["w"]], r["whole"]) for r in part.collect()]))  # bounded by MOST_CHARS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, spans, named = [], [], []
                for text, s, i in zip(batch.column(at), batch.column("_s").to_pylist(), batch.column("_i").to_pylist(), strict=True):
                    words = words_of(text.as_py())
                    hit, ids = found(words, tables.value)
                    counts.append(len(words))
                    spans.append(merged([*map(tuple, s), *map(tuple, hit)]) if s else hit)
                    named.append(sorted(ids | set(i or ())))
                cols = [*[batch.column(k) for k in range(n)], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        return before.mapInArrow(run, schema)

    if len(parts) == 1:
        rows = searched(rows, parts[0])
    else:
        with Scratch(docs.sparkSession) as scratch:
            for k, part in enumerate(parts):
                rows = scratch.write(searched(rows, part), f"part-{k}")
                scratch.drop(f"part-{k - 1}")
            rows = pinned(rows)
    return rows.toDF(*rest, *made)


def digest(rows: DataFrame) -> DataFrame:
    """``marked`` rows with n_hit, n_items, items_sha256 and contaminated in place of spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return rows.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.size("spans") > 0}).drop("spans", "items")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(marked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).drop("text")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS k FROM (
    SELECT item_id, w, least(len(w), {WINDOW}) AS l, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM b WHERE len(w) > 0
  )
), l AS (
  SELECT DISTINCT l FROM p
), s AS (
  SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS s FROM d, l WHERE len(w) >= l
), h AS (
  SELECT DISTINCT doc_id, s.s, s.l, p.item_id FROM s JOIN p ON s.l = p.l AND array_to_string(s.w[s.s:s.s + s.l - 1], ' ') = p.k
), n AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + l)) AS i FROM h) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""
