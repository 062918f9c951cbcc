"""Substring dedup.

The graph is the sparse form of a De Bruijn graph. Of the token k-mers (``K`` words) of a window of ``SPAN`` words, the one
with the least hash is its anchor; it depends on the window alone, so equal windows have equal anchors. An edge is an
anchor with the run of consecutive windows that share it: a nonbranching path of single-word steps, compacted where it
arises. Edges with equal anchors meet in one Spark shuffle; an anchor met once is a path that repeats nowhere. Among
repeated ones, windows are compared at equal distance from the anchor by their own hashes, every window but the first by
(document, start) is marked at its source coordinates, and marked neighbours compact into spans. A join by document puts the
spans back onto the words.

Equal edges within a stretch of a task are combined before the shuffle: only the first travels, the others are marked on the
spot, since their windows start later. So a passage that a third of all documents share sends one edge per stretch.

A window counts as repeated when ``K``-word hash (64 bits), distance and ``SPAN``-word hash (40 bits) agree.

Defined results: null texts have no words; a null id sorts before all others; rows with equal ids and other texts are separate
documents, of whose windows the first is the one with the least (id, start, hash of the text), whatever the rows' order, and
all others are marked; rows that are alike in id and text are one document, and all keep or lose the same words; an empty table
gives no rows; input columns that clash with output columns are replaced, others may have any name; ids are whole numbers,
and others fail the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import struct_of, table
from .shingles import U, WordHashes, mixed, rolling

SPAN, K = 20, 10
NO_ID = -(1 << 63)
WORDS_AT_ONCE = 400_000
#: Bytes of a window's hash, bits of a chunk position beside an anchor's hash.
WIDE, PLACE = 5, 28
EDGE = struct_of("m long, d long, t long, at int, o int, w binary")
MARKED = struct_of("d long, t long, a long, b long")


def _edges(d: np.ndarray, t: np.ndarray, words: list[np.ndarray]) -> pa.RecordBatch:
    """Edges of some documents, sorted by id; local repeats as marked spans (``w`` null, ``o`` the number of windows)."""
    n = np.array([len(w) for w in words], np.int64)
    h = np.concatenate(words)
    row = np.repeat(np.arange(len(n)), n)
    begin = np.concatenate(([0], np.cumsum(n)))[:-1]
    place = np.arange(len(h)) - begin[row]
    raw = rolling(h, K)
    grams = mixed(raw)
    packed = (grams >> U(PLACE) << U(PLACE)) | np.arange(len(grams), dtype=U)
    low, width = packed, 1
    while width < SPAN - K + 1:  # least of the k-mers of each window
        step = min(width, SPAN - K + 1 - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    s = np.flatnonzero(place[: len(low)] <= n[row[: len(low)]] - SPAN)
    anchor = (low[s] & U((1 << PLACE) - 1)).astype(np.int64)
    window = mixed(raw[s] * U(0x9E3779B97F4A7C15) + mixed(raw[s + SPAN - K]))
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(s) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(s)))
    a, s0 = anchor[first], s[first]
    o = a - s0
    m = grams[a]
    whole = mixed(np.add.reduceat(mixed(window + (anchor - s).astype(U)), first) + m * U(3) + (o * 64 + count).astype(U)) if len(first) else np.empty(0, U)
    doc, start, text = d[row[s0]], place[s0], t[row[s0]]
    lead = _first(whole, doc, start, text)
    late = (doc != doc[lead]) | (start != start[lead]) | (text != text[lead])  # what remains leads, or is the same place of the same row once more
    send = np.flatnonzero(~late)
    raw_bytes = window.view(np.uint8).reshape(-1, 8)[:, :WIDE]
    take = np.repeat(first[send], count[send]) + _ramp(count[send])
    # runs of marked windows, one span each
    r, x, y = row[s0][late], start[late], (start + count)[late]
    cut = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != y[:-1])))) if len(r) else np.empty(0, np.int64)
    last = np.append(cut[1:], len(r))[: len(cut)] - 1 if len(cut) else cut
    ends = np.concatenate(([0], np.cumsum(count[send] * WIDE), np.full(len(cut), count[send].sum() * WIDE))).astype(np.int32)
    valid = np.concatenate((np.ones(len(send), bool), np.zeros(len(cut), bool)))
    w = pa.Array.from_buffers(pa.binary(), len(valid), [pa.py_buffer(np.packbits(valid, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw_bytes[take]))])
    both = lambda p, q, kind: pa.array(np.concatenate((p, q)).astype(kind))
    spread = mixed(d[r[cut]].astype(U)) if len(cut) else np.empty(0, U)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((m[send], spread)).view(np.int64)), both(doc[send], d[r[cut]], np.int64),
        both(text[send], t[r[cut]], np.int64), both(start[send], x[cut], np.int32), both(o[send], y[last] - x[cut], np.int32), w,
    ], names=EDGE.names)


def _first(key: np.ndarray, doc: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each row the place of the first one with its key, by (doc, start, text)."""
    order = np.lexsort((text, start, doc))
    _, lead, group = np.unique(key[order], return_index=True, return_inverse=True)
    out = np.empty(len(key), np.int64)
    out[order] = order[lead][group]
    return out


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def flush(held: list) -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        return _edges(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), [x[2] for x in held])

    for batch in batches:
        held, size = [], 0
        for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = (text.as_py() or "").encode().split()
            if len(words) >= SPAN:
                held.append((d, t, hashes.of(words)))
                size += len(words)
            if size >= WORDS_AT_ONCE:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)


class _Marker:
    """Marks repeated windows in edges sorted by (m, d, at + o, t); keeps the first windows of the last anchor from batch to batch.

    ``at + o`` is the anchor's place, and equal windows are equally far from it. So edges arrive in the order of their windows' starts, and what is kept comes before all that follows.
    """

    def __init__(self) -> None:
        self.m, self.kept = None, None

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        m, d, t, at, o = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        at = at.astype(np.int64)
        w = batch.column(5)
        done = w.is_null().to_numpy(zero_copy_only=False)
        out = [(d[done], t[done], at[done], at[done] + o[done])]
        live = np.flatnonzero(~done)
        if len(live):
            ml = m[live]
            same = ml[1:] == ml[:-1]
            several = np.concatenate(([self.m is not None and ml[0] == self.m], same)) | np.concatenate((same, [True]))
            pick = live[several]
            ends = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w) + 1].astype(np.int64)
            data = np.frombuffer(w.buffers()[2], np.uint8)
            count = (ends[pick + 1] - ends[pick]) // WIDE
            i, k = np.repeat(pick, count), _ramp(count)
            wide = np.zeros((len(i), 8), np.uint8)
            wide[:, :WIDE] = data[(ends[i] + k * WIDE)[:, None] + np.arange(WIDE)]
            key = mixed(wide.view(U).ravel() + (o[i] - k).astype(U) * U(1 << 60)) + m[i].view(U) * U(3)
            doc, start, text, old = d[i], at[i] + k, t[i], np.zeros(len(i), bool)
            mi = m[i]
            if self.kept is not None and self.m == ml[0]:
                n = len(self.kept[0])
                key, doc, start, text = (np.concatenate(p) for p in zip(self.kept, (key, doc, start, text), strict=True))
                old, mi = np.arange(len(key)) < n, np.concatenate((np.full(n, self.m), mi))
            lead = _first(key, doc, start, text)
            own = np.unique(lead[mi == ml[-1]])
            self.m, self.kept = ml[-1], (key[own], doc[own], start[own], text[own])
            late = ((doc != doc[lead]) | (start != start[lead]) | (text != text[lead])) & ~old
            dd, tt, ss = doc[late], text[late], start[late]
            cut = np.flatnonzero(np.concatenate(([True], (dd[1:] != dd[:-1]) | (tt[1:] != tt[:-1]) | (ss[1:] != ss[:-1] + 1)))) if len(dd) else np.empty(0, np.int64)
            last = np.append(cut[1:], len(dd))[: len(cut)] - 1 if len(cut) else cut
            out.append((dd[cut], tt[cut], ss[cut], ss[last] + 1))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=MARKED.names)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark = _Marker()
    for batch in batches:
        if batch.num_rows:
            yield mark(batch)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"_d": F.coalesce(F.col(id_col), F.lit(NO_ID)), "_t": F.xxhash64(text_col)})


def marked_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of windows that start earlier elsewhere: d (id), t (text key), first start a, behind the last start b."""
    rows = _keyed(docs, id_col, text_col).select("_d", "_t", text_col)
    edges = rows.mapInArrow(_map, EDGE)
    return edges.repartition("m").sortWithinPartitions("m", "d", F.col("at") + F.col("o"), "t").mapInArrow(_reduce, MARKED)


def _spans(pairs: list[int] | None) -> list[list[int]]:
    """Merged word ranges covered by runs of windows, packed as start << 32 | end of starts."""
    out: list[list[int]] = []
    for x in sorted(pairs or []):
        a, b = x >> 32, (x & 0xFFFFFFFF) + SPAN - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """``docs`` without its text, with n_words, n_removed and kept_sha256; with ``full`` also ``spans`` ([start, end) in words) and ``kept`` (the kept words joined by a space)."""
    extra = [T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType())] if full else []
    digest = struct_of("n_words long, n_removed long, kept_sha256 string")
    made = [*digest.names, *[f.name for f in extra]]
    rest = [f for f in docs.schema.fields if f.name != text_col and f.name not in made]
    names = [*[f.name for f in rest], *made]
    docs = docs.select(*[F.col(f.name).alias(f"c{k}") for k, f in enumerate(rest)], F.col(text_col).alias("t"), F.col(id_col).alias("i"))  # no name clashes with those of the steps
    rest, id_col, text_col = [T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(rest)], "i", "t"
    # a document's own spans meet; equal ones of repeated rows are combined before the shuffle
    spans = marked_windows(docs, id_col, text_col).groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set(F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("_spans"))
    rows = _keyed(docs, id_col, text_col).join(spans, ["_d", "_t"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in made]
            for text, pairs in zip(batch.column(len(rest)), batch.column(len(rest) + 1), strict=True):
                words = (text.as_py() or "").encode().split()
                merged, keep, at = _spans(pairs.as_py()), [], 0
                for a, b in merged:
                    keep += words[at:a]
                    at = b
                keep += words[at:]
                kept = b" ".join(keep)
                row = [len(words), len(words) - len(keep), hashlib.sha256(kept).hexdigest(), merged, kept.decode()]
                for values, value in zip(out, row, strict=False):
                    values.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(rest))], *[pa.array(v, t) for v, t in zip(out, types, strict=False)]], names=[*[f.name for f in rest], *made])

    return rows.select(*[f.name for f in rest], text_col, "_spans").mapInArrow(run, T.StructType([*rest, *digest.fields, *extra])).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - {SPAN} + 2)) AS p, w FROM d
), h AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + {SPAN - 1}], ' ')) AS k FROM s
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, p) > 1 AS late FROM h
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + {SPAN})) AS i FROM r WHERE late
), g AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
), f AS (
  SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON d.doc_id = g.doc_id
), u AS (
  SELECT doc_id, w, gone, unnest(range(1, len(w) + 1)) AS i FROM f
), k AS (
  SELECT u.doc_id, string_agg(u.w[u.i], ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id
)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(len(f.gone) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM f LEFT JOIN k ON f.doc_id = k.doc_id
"""
