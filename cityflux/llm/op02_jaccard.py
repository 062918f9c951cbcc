"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles; documents link at a Jaccard similarity of 0.8 or more. Then the sets
differ in at most (|A| + |B|) / 9 shingles. Shingles are hashed into the blocks of a sketch, and each block is the XOR of
its shingles' hashes, so every shingle that only one set has changes one block at most: the number of unequal blocks is
a lower bound of the symmetric difference. A size band has enough blocks that linked sets agree in more blocks than a set
leaves out, and a set posts its D + 1 fullest blocks (D: the most that a linked set differs), fullest first in an order that
depends on the block alone. By the pigeonhole principle two linked sets post an equal block in the band of the larger one.
Bands reach over a factor of four in size; a set near a band's start posts as the smaller one in that band too.

Equal sets are one class from the start (a hash of the set). Of the classes that share a block, the most central one (its
blocks have the most company) is compared with each other: stars, not all pairs. Candidates pass the size bound and a
parity sketch (each shingle flips one bit, so its Hamming distance is a lower bound too) and are verified on the texts.
Components of the links follow in Spark. Blocks whose classes are still in several components are finished exactly: their
sketches are compared in chunks of ``CHUNK`` classes, one pair of chunks per group, and only pairs across components within
the bound become rows, which are verified like the others. So no link between different components is lost. There is no cap.

Defined results: texts without words have an empty set and link with nothing; a null id never is a component's id unless all
its ids are null; rows with equal ids are separate rows; repeated rows are copies; an empty table gives no rows; input
columns that clash with output columns are replaced; ids are whole numbers, and others fail the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, looked_up, pinned, struct_of, table
from .components import components
from .shingles import U, WordHashes, mixed, shingle_set

WORDS = 5
#: Linked: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
BAND = 4
#: Bits of a parity sketch for sets below a size; a longer one folds to a shorter one.
BITS = ((1024, 512), (8192, 4096), (1 << 62, 32768))
CHUNK = 1024
#: Of a chunk of classes whose links are counted: classes and shingles about, and cells of a matrix.
LINK_CHUNK, LINK_SHINGLES, LINK_CELLS = 512, 1 << 20, 1 << 22


def most_difference(n: int) -> int:
    """The most shingles in which a set of n and one that links with it differ."""
    other = n * 100 // SIMILARITY
    return (n + other) * (100 - SIMILARITY) // (100 + SIMILARITY)


def blocks_of_band(band: int) -> int:
    """More than any set of the band may lose, and so many that a set can leave its emptiest blocks out."""
    top = BAND ** (band + 1) - 1
    return max(int(0.35 * top), most_difference(top) + 2)


def band_of(n: int) -> int:
    return 0 if n < BAND else (n.bit_length() - 1) // (BAND.bit_length() - 1)


def posts(s: np.ndarray) -> np.ndarray:
    """The block keys that a set posts; ``s`` is sorted, 64 bits each."""
    n = len(s)
    if n * 100 // SIMILARITY == n:  # too small to link with another set
        return np.empty(0, U)
    take, keys = most_difference(n) + 1, []
    bands = {band_of(n), band_of(n * 100 // SIMILARITY)}
    values = mixed(s ^ U(0x5851F42D4C957F2D))
    for band in sorted(bands):
        k = blocks_of_band(band)
        block = (s >> U(32)) * U(k) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        count = np.diff(np.append(first, n))
        key = mixed(np.bitwise_xor.reduceat(values, first) + block[first] * U(0x9E3779B97F4A7C15) + U(band))
        if len(key) < take:  # empty blocks count as equal too
            empty = np.setdiff1d(np.arange(k, dtype=U), block[first], assume_unique=True)
            key = np.concatenate((key, mixed(empty * U(0x9E3779B97F4A7C15) + U(band))))
            count = np.concatenate((count, np.zeros(len(empty), count.dtype)))
        if len(key) > take:
            rank = (U(255) - np.minimum(count, 255).astype(U)) << U(56) | key >> U(8)
            key = key[np.argpartition(rank, take - 1)[:take]]
        keys.append(key)
    return np.concatenate(keys)


def parity(s: np.ndarray) -> bytes:
    """A set's parity sketch."""
    bits = next(b for below, b in BITS if len(s) < below)
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as 64-bit numbers, folded to ``size`` bytes."""
    x = np.frombuffer(sketch, U)
    return np.bitwise_xor.reduce(x.reshape(-1, size // 8), 0) if len(sketch) > size else x


def within(distance: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of that total size can link at that distance at least."""
    return (100 + SIMILARITY) * distance <= (100 - SIMILARITY) * total


def class_hash(s: np.ndarray) -> int:
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = np.bitwise_xor.reduce(mixed(s + U(len(s)))) + s.sum() * U(0xD1342543DE82EF95)
    return int(mixed(np.array([x], U)).view(np.int64)[0])


PREPARED = struct_of("id long, k long, n long, c long, sketch binary").add("keys", T.ArrayType(T.LongType()))


def _shingles(hashes: WordHashes, text: str | None) -> np.ndarray:
    return shingle_set(hashes.of((text or "").encode().lower().split()), WORDS)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        n, c, sketches, keys, met = [], [], [], [], set()
        for text in batch.column(2):
            s = _shingles(hashes, text.as_py())
            n.append(len(s))
            c.append(class_hash(s))
            sketches.append(parity(s))
            keys.append(np.empty(0, U) if c[-1] in met else posts(s))  # one copy per batch posts for its class
            met.add(c[-1])
        flat = np.concatenate(keys) if keys else np.empty(0, U)
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(sketches, pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
        ], names=PREPARED.names)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _fits(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, at, left = WordHashes(), None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        linked = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            if at != a[i]:
                at, left = a[i], _shingles(hashes, x.as_py())
            right = _shingles(hashes, y.as_py())
            both = np.concatenate((left, right))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            linked.append(100 * common >= SIMILARITY * (len(both) - common))
        keep = [i for i, x in enumerate(linked) if x]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches are within the bound."""
    for batch in batches:
        keep = []
        for x, y, n in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), (batch.column(6).to_numpy() + batch.column(7).to_numpy()).tolist(), strict=True):
            size = min(len(x), len(y))
            keep.append(within(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()), n))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2, 3])


def _pairs_of(rows: list[np.ndarray | list]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs across labels of one group's classes that fit and are within the bound; of a group of two chunks, those between them."""
    c, n, label, side, sketch = rows
    n, label, side, c = (np.asarray(x) for x in (n, label, side, c))
    size = min(map(len, sketch))
    grid = np.array([folded(x, size) for x in sketch])
    two = side.min() != side.max()
    left = np.flatnonzero(side == 0) if two else np.arange(len(c))
    right = np.flatnonzero(side == 1) if two else np.arange(len(c))
    out_a, out_b, step = [], [], max(1, (1 << 19) // max(1, len(right) * grid.shape[1]))
    for i in range(0, len(left), step):
        part = left[i : i + step]
        ok = label[part][:, None] != label[right][None]
        ok &= 100 * np.minimum(n[part][:, None], n[right][None]) >= SIMILARITY * np.maximum(n[part][:, None], n[right][None])
        if not two:
            ok &= part[:, None] < right[None]
        if not ok.any():
            continue
        far = np.bitwise_count(grid[part][:, None] ^ grid[right][None]).sum(2, dtype=np.int64)
        ok &= within(far, n[part][:, None] + n[right][None])
        x, y = np.nonzero(ok)
        out_a.append(c[part[x]])
        out_b.append(c[right[y]])
    none = [np.empty(0, np.int64)]
    a, b = np.concatenate(out_a or none), np.concatenate(out_b or none)
    return np.minimum(a, b), np.maximum(a, b)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_pairs_of`` for each run of rows with equal group; a group has two chunks of rows at most."""
    at, held = None, None

    def frame(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        group = list(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True))
        cols = [batch.column(k).to_pylist() for k in range(3, 8)]
        start = 0
        while start < len(group):
            stop = start
            while stop < len(group) and group[stop] == group[start]:
                stop += 1
            if group[start] != at:
                if held is not None and len(held[0]) > 1:
                    yield frame(*_pairs_of(held))
                at, held = group[start], [[] for _ in cols]
            for have, col in zip(held, cols, strict=True):
                have += col[start:stop]
            start = stop
    if held is not None and len(held[0]) > 1:
        yield frame(*_pairs_of(held))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [_shingles(hashes, text.as_py()).tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["c", "shingles"])


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of each left set with each right one."""
    out = np.zeros((len(left), len(right)), np.int64)
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (left, right)]
    both = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    found = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(both, values), max(0, len(both) - 1))
        keep = both[at] == values if len(both) else np.zeros(len(values), bool)
        at, owner = at[keep], owner[keep]
        order = np.argsort(at, kind="stable")
        found.append((at[order], owner[order]))
    width = max(1, LINK_CELLS // max(len(left), len(right)))
    for start in range(0, len(both), width):
        size = min(width, len(both) - start)
        parts = []
        for (at, owner), sets in zip(found, (left, right), strict=True):
            a, b = np.searchsorted(at, (start, start + size))
            part = np.zeros((len(sets), size), np.float32)
            part[owner[a:b], at[a:b] - start] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)  # whole numbers below 2**24: exact
    return out


def _link_counts(group: pa.Table) -> pa.Table:
    """(c, links) of one group: a chunk's classes among themselves, or those of two chunks across."""
    c, n, copies, side = (group.column(k).to_numpy() for k in ("c", "n", "copies", "side"))
    sets = [np.frombuffer(x.as_py(), U) for x in group.column("shingles")]
    two = side.min() != side.max()
    left = np.flatnonzero(side == 0) if two else np.arange(len(c))
    right = np.flatnonzero(side == 1) if two else left
    common = _common([sets[i] for i in left], [sets[i] for i in right])
    ok = 100 * common >= SIMILARITY * (n[left][:, None] + n[right][None] - common)
    if two:
        where, links = np.concatenate((left, right)), np.concatenate((ok @ copies[right], copies[left] @ ok))
    else:
        np.fill_diagonal(ok, False)
        where, links = left, ok @ copies
    return pa.table({"c": pa.array(c[where], pa.int64()), "links": pa.array(links, pa.int64())})


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch):
        self.scratch, self.id, self.text = scratch, id_col, text_col
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("k", row_key("id", "text")).select("id", "k", "text")
        self.prepared = scratch.write(self.docs.mapInArrow(_prepare, PREPARED), "prepared")
        self.classes = self.prepared.where("n > 0").groupBy("c").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among candidate pairs (a, b) of classes, by sketch, then by text."""
        side = lambda x: self.classes.select(F.col("c").alias(x), F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "kb", "sa", "sb", "na", "nb")
        near = pinned(near.mapInArrow(_near, "a long, b long, ka long, kb long"))
        need = near.select(F.col("a").alias("c"), F.col("ka").alias("k")).unionAll(near.select(F.col("b").alias("c"), F.col("kb").alias("k"))).distinct()
        texts = self.docs.select("k", "text").join(need, "k").select("c", "text").dropDuplicates(["c"])
        texts = self.scratch.write(texts, "texts")
        right = near.select("a", "b").join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")
        both = right.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
        links = pinned(both.mapInArrow(_verify, "a long, b long"))
        self.scratch.drop("texts")
        return links

    def links(self) -> DataFrame:
        """Links (a, b) between classes that connect all that is connected."""
        posted = self.prepared.select("c", "n", F.explode("keys").alias("key"))
        by_key = Window.partitionBy("key")
        ranked = posted.withColumns({"last": F.lag("c").over(by_key.orderBy("c")), "m": F.count(F.lit(1)).over(by_key)})
        shared = self.scratch.write(ranked.where("m > 1 and (last is null or last <> c)").select("key", "c", "n", "m"), "shared")
        company = shared.groupBy("c").agg(F.sum("m").alias("company"))
        central = by_key.orderBy(F.desc("company"), "c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = shared.join(company, "c").withColumn("hub", F.first(F.struct("c", "n")).over(central)).where("hub.c <> c")
        ranked = self.scratch.write(ranked.select("key", "c", "n", F.col("hub.c").alias("hub"), F.col("hub.n").alias("hub_n")), "ranked")
        self.scratch.drop("shared")
        stars = ranked.where(_fits("n", "hub_n")).select(F.least("hub", "c").alias("a"), F.greatest("hub", "c").alias("b")).distinct()
        links = self.verified(stars)
        return links.unionAll(self.verified(self.across(ranked, links)))

    def across(self, ranked: DataFrame, links: DataFrame) -> DataFrame:
        """Candidate pairs across components within a block; pairs with the block's hub have been tried."""
        labels = components(links).withColumnRenamed("node", "c")
        members = ranked.select("key", "c", "n").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
        open_keys = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y").select("key", "m")
        chunks = F.ceil(F.col("m") / CHUNK).cast("int")
        rest = members.join(open_keys, "key").withColumn("i", F.pmod(F.xxhash64("c"), chunks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), chunks - 1)))
        rest = rest.select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "c", "n", "label", F.when(F.col("i") > F.col("j"), 1).otherwise(0).alias("side"))
        rest = rest.join(self.classes.select("c", "sketch"), "c").select("key", "i", "j", "c", "n", "label", "side", "sketch")
        return rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_across, "a long, b long").distinct()

    def link_counts(self, labels: DataFrame) -> DataFrame:
        """(c, links) of the classes that have links: how many rows of other classes each one links with."""
        every = self.prepared.where("n > 0").groupBy("c").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
        members = pinned(every.join(labels.withColumnRenamed("node", "c"), "c"))
        texts = self.docs.select("k", "text").join(members.select("c", "k"), "k").select("c", "text").dropDuplicates(["c"])
        sets = texts.mapInArrow(_sets, "c long, shingles binary")
        chunks = F.greatest(F.ceil(F.count(F.lit(1)) / LINK_CHUNK), F.ceil(F.sum("n") / LINK_SHINGLES)).cast("int")
        rest = members.join(members.groupBy("label").agg(chunks.alias("chunks")), "label").join(sets, "c")
        rest = rest.withColumn("i", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rest = rest.select("label", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "c", "n", "copies", F.when(F.col("i") > F.col("j"), 1).otherwise(0).alias("side"), "shingles")
        return rest.groupBy("label", "i", "j").applyInArrow(_link_counts, "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, k row key, n, c class) and (node, label) of the classes that have links; both pinned."""
    with Scratch(docs.sparkSession) as scratch:
        join = _Join(docs, id_col, text_col, scratch)
        labels = pinned(components(join.links()))
        return pinned(join.prepared.select("id", "k", "n", "c")), labels


def _by_class(rows: DataFrame, labels: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Per class: c, label, class_id and component_id (smallest ids), copies, and n_links with ``links``; pinned."""
    classes = rows.where("n > 0").groupBy("c").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    if links is not None:
        classes = classes.join(links, "c", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0))).drop("links")
    classes = pinned(classes)
    least = pinned(classes.groupBy("label").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("_classes")))
    return pinned(looked_up(classes, least, "label", "_classes"))


def _with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with their class's columns; rows without words stay out of the join."""
    return looked_up(rows.where("n > 0"), classes, "c", "copies").unionByName(rows.where("n = 0").withColumn("label", F.col("c")), allowMissingColumns=True)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, k (row key), n_shingles, class_id (hash of the set), component_id (smallest id)."""
    rows, labels = linked_classes(docs, id_col, text_col)
    out = _with_classes(rows, _by_class(rows, labels).drop("class_id"))
    return out.select("id", "k", F.col("n").alias("n_shingles"), F.col("c").alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "label")


def with_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, k (row key), n_shingles, class_id (smallest id with an equal set), component_id (smallest id), n_links (other rows at the similarity, copies too)."""
    with Scratch(docs.sparkSession) as scratch:
        join = _Join(docs, id_col, text_col, scratch)
        labels = pinned(components(join.links()))
        links = pinned(join.link_counts(labels))
        rows = pinned(join.prepared.select("id", "k", "n", "c"))
    named = lambda x: F.when(F.col("n") > 0, F.col(x)).otherwise(F.col("id")).alias(x)
    out = _with_classes(rows, _by_class(rows, labels, links))
    return out.select("id", "k", F.col("n").alias("n_shingles"), named("class_id"), named("component_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).alias("n_links"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest id, ties by row key. Rows without words stay."""
    rows = grouped(docs, id_col, text_col).where("n_shingles > 0")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("best")).select(F.col("best.k").alias("_k"))
    keyed = docs.withColumn("_k", row_key(id_col, text_col))
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chosen = keyed.where(~wordless).join(best, "_k", "left_semi").dropDuplicates(["_k"])
    return chosen.unionByName(keyed.where(wordless)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_links(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "class_id", "component_id", "n_links")


ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + {WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, least(len(w), 1)) + 1)) AS p FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON i.a = x.doc_id JOIN n y ON i.b = y.doc_id WHERE 100 * common >= {SIMILARITY} * (x.n + y.n - common)
), r AS (
  SELECT doc_id, doc_id AS root FROM d
  UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""
LINKS_ORACLE = (
    ORACLE[: ORACLE.rindex("SELECT r.doc_id")]
    + """, e AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS class_id FROM (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS g FROM s GROUP BY doc_id)
), k AS (
  SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a
), c AS (
  SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(class_id, doc_id) AS class_id, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM c LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN k USING (doc_id)
"""
)
