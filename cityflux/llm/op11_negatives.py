"""Hard-negative mining.

Vectors become whole numbers, so scores are exact. K-means on a bounded sample gives ``MOST_LISTS`` centroids at most; every
row goes to the list of its nearest centroid c, and each list keeps its radius r, the largest distance of its rows from c.
By Cauchy-Schwarz the score of an anchor a with any row of the list lies within c.a - r|a| and c.a + r|a|.

An anchor visits lists by falling upper bound, in two rounds for each search. The first visits the ``PROBE`` best lists and
gives a kth score; the second visits the lists that are left, but those whose upper bound is strictly below the kth score (an
equal one could hold a tie) or whose bounds lie outside the window. So results are those of comparing with all rows. Positives
have no window; an anchor's negatives are searched for all its positives at once, with one window for each positive score.

Lists are cut into blocks of about ``BLOCK`` rows by a hash, so a list of a third of all rows is many tasks' work. A round
is one shuffle of rows and of visits by (list, block), sorted so that a block's rows come first; a task holds one block and
streams its visits past it. Only the first k of each block go on.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors are
as if filled up with zeros; null ids come last among ties and are no anchors; rows with equal ids are rows of their own, so a
repeated anchor has results of its own and is its copy's positive; scores beyond a long stand as its ends; no rows or no
anchors give no rows; other columns play no role.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pinned, struct_of, table

POSITIVES, NEGATIVES, SCALE = 5, 5, 256
#: A negative's score lies between LOW / HIGH of its positive's score and that score.
LOW, HIGH = 80, 100
SAMPLE, MOST_LISTS, LIST_ROWS, STEPS = 20_000, 1024, 512, 6
BLOCK, PROBE, AT_ONCE = 1024, 2, 256
NO_ID, LEAST, MOST = (1 << 63) - 1, -(1 << 63), (1 << 63) - 1
KINDS = ((2, np.int16), (4, np.int32), (8, np.float64))


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of three forms that holds them."""
    top = np.abs(v).max(initial=0)
    return v.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64).tobytes()


def unpacked(rows: list[bytes], d: int) -> np.ndarray:
    """The rows as doubles, one per line."""
    out = np.zeros((len(rows), d))
    if d:
        sizes = np.array([len(x) // d for x in rows])
        for size, kind in KINDS:
            which = np.flatnonzero(sizes == size)
            if len(which):
                out[which] = np.frombuffer(b"".join([rows[k] for k in which]), kind).reshape(-1, d)
    return out


def scores(v: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products (rows x anchors) as 64-bit numbers, in doubles where they fit, else in longs, else without bound."""
    most = v.shape[1] * float(np.abs(v).max(initial=0)) * float(np.abs(a).max(initial=0))
    if most < 2**53:
        return (v @ a.T).astype(np.int64)
    if most < 2**62:
        return v.astype(np.int64) @ a.T.astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in v], object).reshape(v.shape) @ np.array([[int(x) for x in row] for row in a], object).reshape(a.shape).T
    return np.clip(whole, LEAST, MOST).astype(np.int64)


def k_means(v: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's steps, begun at rows far from each other."""
    centre = v[:1].copy()
    gap = ((v - centre[0]) ** 2).sum(1)
    r = np.random.default_rng(0)
    while len(centre) < k and gap.max() > 0:
        x = v[r.choice(len(v), p=gap / gap.sum())]
        centre = np.vstack((centre, x))
        gap = np.minimum(gap, ((v - x) ** 2).sum(1))
    for _ in range(STEPS):
        near = nearest(v, centre)
        for c in range(len(centre)):
            if (near == c).any():
                centre[c] = v[near == c].mean(0)
    return centre


def nearest(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(1) - 2 * v @ centre.T).argmin(1)


def quantised(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label and the vector times ``SCALE``, rounded down, of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.where(F.col(label_col).isNotNull() & v.isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.least(F.greatest(x.cast("double"), F.lit(-7e305)), F.lit(7e305))).alias("v"))


@dataclass(frozen=True)
class Lists:
    """What a task has to know of the lists: ``MOST_LISTS`` centroids, radii and numbers of blocks at most."""

    d: int
    centre: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of scores, anchors x lists, a little widened for rounding; infinite where floats overflow."""
        with np.errstate(all="ignore"):
            size, mid = np.sqrt((a**2).sum(1))[:, None], a @ self.centre.T
            reach = self.radius * size
            reach = reach + 1e-9 * (np.abs(mid) + reach + size * np.sqrt((self.centre**2).sum(1))) + 1e-3
            high, low = np.nan_to_num(mid + reach, nan=np.inf), np.nan_to_num(mid - reach, nan=-np.inf)
        return np.where(self.blocks > 0, high, -np.inf), np.where(self.blocks > 0, low, np.inf)


class Index:
    """The rows in lists: ``rows`` (row, id, label, v packed, list, block) and ``lists``."""

    def __init__(self, quantised_rows: DataFrame, scratch: Scratch):
        spark = quantised_rows.sparkSession
        stored = scratch.write(quantised_rows.withColumn("row", F.monotonically_increasing_id()), "quantised")
        n, d = stored.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        d = d or 0

        def matrix(column: pa.Array) -> np.ndarray:
            sizes = np.diff(column.offsets.to_numpy())
            out = np.zeros((len(sizes), d))
            out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = column.flatten().to_numpy(zero_copy_only=False)
            return np.floor(SCALE * out)

        some = stored.orderBy(F.xxhash64("v", "row"), "row").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
        sample = matrix(some) if n else np.zeros((0, d))
        centroids = k_means(sample, max(1, min(MOST_LISTS, n // LIST_ROWS))) if n and d else np.zeros((1, d))
        centre = spark.sparkContext.broadcast(centroids)

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = matrix(b.column("v"))
                near = nearest(v, centre.value)
                far = np.sqrt(((v - centre.value[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("label"), pa.array([packed(x) for x in v], pa.binary()), pa.array(near), pa.array(far)], names=["row", "id", "label", "v", "list", "far"])

        rows = scratch.write(stored.mapInArrow(assigned, struct_of("row long, id long, label long, v binary, list long, far double")), "assigned")
        radius, count = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64)
        for r in rows.groupBy("list").agg(F.max("far"), F.count(F.lit(1))).collect():  # MOST_LISTS rows at most
            radius[r[0]], count[r[0]] = r[1], -(-r[2] // BLOCK)
        blocks = F.element_at(F.array(*[F.lit(int(x)) for x in np.maximum(count, 1)]), (F.col("list") + 1).cast("int"))
        self.rows = rows.select("row", "id", "label", "v", "list", F.pmod(F.xxhash64("row"), blocks).alias("block"))
        self.lists = Lists(d, centroids, radius, count)


#: A visit: the anchor, whose score with a row of the block counts if it lies in a window [lows, highs] and is ``floor`` at least.
ASK = "row long, label long, v binary, same boolean, lows string, highs string, floors string"


def _longs(x: str) -> np.ndarray:
    return np.array([int(p) for p in x.split(",")], np.int64)


def visits(asks: DataFrame, index: Index, first: bool) -> DataFrame:
    """list, block and ask of every list to visit: the ``PROBE`` best ones, or those left that can still count."""
    held = asks.sparkSession.sparkContext.broadcast(index.lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        for b in batches:
            if not b.num_rows:
                continue
            high, low = x.bounds(unpacked(b.column("v").to_pylist(), x.d))
            lists, blocks, take = [], [], []
            for k, (lows, highs, floors) in enumerate(zip(*[map(_longs, b.column(c).to_pylist()) for c in ("lows", "highs", "floors")], strict=True)):
                inside = (high[k][:, None] >= lows) & (low[k][:, None] <= highs)
                open_ = (inside & (high[k][:, None] >= floors)).any(1) & (x.blocks > 0)
                seen = inside.any(1) & (x.blocks > 0)
                best = np.argsort(-high[k], kind="stable")
                probed = best[seen[best]][:PROBE]
                if first:
                    open_ = np.zeros_like(seen)
                    open_[probed] = True
                else:
                    open_[probed] = False
                which = np.flatnonzero(open_)
                count = x.blocks[which]
                lists.append(np.repeat(which, count))
                blocks.append(np.concatenate([np.arange(c) for c in count]) if len(count) else np.empty(0, np.int64))
                take.append(np.full(count.sum(), k))
            picked = b.take(pa.array(np.concatenate(take).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int64)), pa.array(np.concatenate(blocks).astype(np.int64)), *picked.columns], names=["list", "block", *b.schema.names])

    return asks.select(*ASK_NAMES).mapInArrow(run, struct_of(f"list long, block long, {ASK}"))


ASK_NAMES = [f.split()[0] for f in ASK.split(", ")]
HIT = "anchor long, w int, score long, id long, row long"


class _Blocks:
    """Compares visits with the rows of their block; rows of a block come before its visits."""

    def __init__(self, d: int, k: int):
        self.d, self.k, self.at, self.parts, self.block = d, k, None, [], None

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list", "block", "visit")], 1)
        cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else []
        out = [self.run(batch.slice(a, b - a), tuple(keys[a])) for a, b in zip(cut, [*cut[1:], len(keys)], strict=True)]
        cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*[o for o in out if o], strict=True)] or [np.empty(0, np.int64)] * 5
        names = [f.split()[0] for f in HIT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32 if n == "w" else np.int64)) for n, c in zip(names, cols, strict=True)], names=names)

    def run(self, batch: pa.RecordBatch, key: tuple):
        if key[:2] != self.at:
            self.at, self.parts, self.block = key[:2], [], None
        if not key[2]:
            self.parts.append(batch.select(["row", "id", "label", "v"]))
            return None
        if not self.parts:
            return None
        if self.block is None:
            rows = pa.Table.from_batches(self.parts)
            ids = np.array([NO_ID if x is None else x for x in rows.column("id").to_pylist()], np.int64)
            order = np.lexsort((rows.column("row").to_numpy(), ids))
            self.block = ids[order], rows.column("row").to_numpy()[order], rows.column("label").to_numpy()[order], unpacked(rows.column("v").to_pylist(), self.d)[order]
        out = [self.compare(batch.slice(a, AT_ONCE)) for a in range(0, batch.num_rows, AT_ONCE)]
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def compare(self, asks: pa.RecordBatch) -> list[np.ndarray]:
        ids, row, label, v = self.block
        s = scores(v, unpacked(asks.column("v").to_pylist(), self.d))
        anchor = asks.column("row").to_numpy()
        same = asks.column("same").to_numpy(zero_copy_only=False).astype(bool)
        fits = (label[:, None] == asks.column("label").to_numpy()) == same
        fits &= row[:, None] != anchor
        bounds = [[_longs(x) for x in asks.column(c).to_pylist()] for c in ("lows", "highs", "floors")]
        out = []
        for w in range(max(map(len, bounds[0]))):
            low, high, floor = (np.array([x[w] if w < len(x) else end for x in b], np.int64) for b, end in zip(bounds, (MOST, LEAST, MOST), strict=True))
            ok = fits & (s >= np.maximum(low, floor)) & (s <= high)
            kept = np.where(ok, s, LEAST)
            kth = np.partition(kept, -self.k, axis=0)[-self.k] if len(kept) > self.k else np.full(len(anchor), LEAST)
            i, j = np.nonzero(ok & (kept >= kth))
            order = np.lexsort((i, -s[i, j].astype(object) if len(i) and s[i, j].min() == LEAST else -s[i, j], j))  # rows stand by id
            i, j = i[order], j[order]
            begin = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1]))) if len(j) else np.empty(0, np.int64)
            rank = np.arange(len(j)) - np.repeat(begin, np.diff(np.append(begin, len(j))))
            i, j = i[rank < self.k], j[rank < self.k]
            out.append([anchor[j], np.full(len(j), w), s[i, j], ids[i], row[i]])
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def compared(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """The first k hits (anchor, w, score, id, row) of every visit, ``w`` being the window."""
    lists = index.rows.select("list", "block", F.lit(False).alias("visit"), "row", "id", "label", "v", F.lit(None).cast("boolean").alias("same"), *[F.lit(None).cast("string").alias(c) for c in ("lows", "highs", "floors")])
    wanted = asked.select("list", "block", F.lit(True).alias("visit"), "row", F.lit(None).cast("long").alias("id"), "label", "v", "same", "lows", "highs", "floors")
    d = index.lists.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(d, k)
        for batch in batches:
            yield blocks(batch)

    both = lists.unionByName(wanted).repartition("list", "block").sortWithinPartitions("list", "block", "visit")
    return both.mapInArrow(run, struct_of(HIT))


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(asks: DataFrame, index: Index, k: int, scratch: Scratch, name: str) -> DataFrame:
    """(anchor, w, score, id, row, rank): the k best rows in each window of every ask."""
    near = scratch.write(_best(compared(visits(asks, index, True), index, k), k), f"{name}-near")
    kth = near.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("_kth"))
    joined = asks.join(kth, F.col("row") == F.col("anchor"), "left")
    floors = F.transform(F.split("lows", ","), lambda _, w: F.coalesce(F.try_element_at("_kth", w), F.lit(LEAST)).cast("string"))
    rest = joined.withColumn("floors", F.array_join(floors, ",")).select(*ASK_NAMES)
    far = compared(visits(rest, index, False), index, k)
    return scratch.write(_best(near.drop("rank").unionByName(far), k), name)


def mined(df: DataFrame, anchor, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchor`` tells anchors by the column ``id``."""
    with Scratch(df.sparkSession) as scratch:
        index = Index(quantised(df, id_col, label_col, vector_col), scratch)
        anchors = scratch.write(index.rows.where(anchor(F.col("id"))).select("row", "id", "label", "v"), "anchors")
        whole = [F.lit(str(x)).alias(c) for c, x in (("lows", LEAST), ("highs", MOST), ("floors", LEAST))]
        own = searched(anchors.select("row", "label", "v", F.lit(True).alias("same"), *whole), index, positives, scratch, "positives")
        # one window for each positive score; below 0 none can hold a score
        scored = own.where("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("ps"))
        lowest = lambda p: F.ceil(p.cast("decimal(38,0)") * LOW / HIGH).cast("string")
        texts = [F.array_join(F.transform("ps", f), ",").alias(c) for c, f in (("lows", lowest), ("highs", lambda p: p.cast("string")), ("floors", lambda p: F.lit(str(LEAST))))]
        windows = anchors.join(scored, F.col("row") == F.col("anchor")).select("row", "label", "v", F.lit(False).alias("same"), *texts)
        others = searched(windows, index, negatives, scratch, "negatives")
        sure = own.join(scored, "anchor").where("score >= 0").select("anchor", F.col("row").alias("_p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.array_position("ps", F.col("score")) - 1).cast("int").alias("w"))
        hits = others.select("anchor", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        out = sure.join(hits, ["anchor", "w"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        return pinned(out.select("anchor_id", back("positive_id"), F.col("rank").cast("int").alias("rank"), back("negative_id"), "positive_score", "negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.select("vec_id", label.alias("label"), "embedding"), lambda i: i % 100 == 0)


ORACLE = f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= {POSITIVES}
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND {LOW} * p.score <= {HIGH} * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
