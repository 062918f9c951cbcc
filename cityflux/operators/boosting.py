"""Gradient boosting by histograms, with leaves grown best first.

Features become bins (at most ``BINS`` each, by exact quantiles), a row a few bytes. For a tree, each pass over the rows sums
the gradients and counts of the nodes asked for by feature and bin: tasks sum their own rows, Spark sums the tasks', and what
reaches the driver is bounded by nodes x features x bins. A pass asks for all leaves that the next splits may open, so a tree of
31 leaves needs about as many passes as it has levels. Gradients are summed as whole numbers, so results don't depend on the
order of rows or tasks. Predictions are written into the binned table every ``REFRESH`` trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from .forecast import forbid_leaks
from .ranks import order_statistics

BINS, REFRESH = 255, 10


@dataclass
class Tree:
    """Nodes by number: the root is 0, leaves have no feature."""

    feature: list[int] = field(default_factory=lambda: [-1])
    upto: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, upto: int) -> tuple[int, int]:
        """Rows whose bin is ``upto`` at most go to the first of the two new nodes."""
        self.feature[node], self.upto[node], self.left[node] = feature, upto, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.upto.append(0)
            self.left.append(0)
            self.value.append(0.0)
        return self.left[node], self.left[node] + 1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(bins), np.int64)
        feature, upto, left = map(np.array, (self.feature, self.upto, self.left))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = left[node] + (bins[rows, feature[node]] > upto[node])
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.places(bins)]


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many edges are below it; missing values have a bin above all others."""
    out = np.empty(values.shape, np.uint8)
    for k, e in enumerate(edges):
        v = values[:, k]
        out[:, k] = np.where(np.isnan(v), len(e) + 1, np.searchsorted(e, v, "left"))
    return out


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    upto: int


def best_split(g: np.ndarray, n: np.ndarray, scale: float, least: int, l2: float) -> Split | None:
    """The best split of a node with gradients and counts by feature and bin; the first of equal ones; none without gain."""
    gl, nl = np.cumsum(g, 1), np.cumsum(n, 1)
    total_g, total_n = gl[:, -1:], nl[:, -1:]
    score = lambda a, b: (a / scale) ** 2 / (b + l2)
    with np.errstate(all="ignore"):
        gain = score(gl, nl) + score(total_g - gl, total_n - nl) - score(total_g, total_n)
    gain = np.where((nl >= least) & (total_n - nl >= least), gain, -np.inf)
    k = int(gain.argmax())
    found = Split(float(gain.flat[k]), *map(int, divmod(k, g.shape[1])))
    return found if found.gain > 1e-12 else None


def grown(histograms, leaves: int, scale: float, least: int, l2: float, rate: float) -> Tree:
    """A tree by best-first growth; ``histograms(tree, nodes)`` gives {node: (gradients, counts)} of nodes of the tree."""
    full, split, sums, children = Tree(), {}, {}, {}

    def learn(nodes: list[int]) -> None:
        for node, (g, n) in histograms(full, nodes).items():
            sums[node] = int(g[0].sum()), int(n[0].sum())
            split[node] = best_split(g, n, scale, least, l2)

    learn([0])
    while True:
        # splits in the order of their gains, as far as they are known
        open_, done, unknown = [0], [], False
        while len(open_) < leaves:
            best = max((x for x in open_ if split[x]), key=lambda x: (split[x].gain, -x), default=None)
            if best is None:
                break
            if best not in children:
                unknown = True
                break
            done.append(best)
            open_.remove(best)
            open_ += children[best]
        if not unknown:
            break
        # all leaves that may still be split, the best first: their children come in one pass
        ask = sorted((x for x in open_ if split[x] and x not in children), key=lambda x: (-split[x].gain, x))[: leaves - len(open_)]
        for x in ask:
            children[x] = full.split(x, split[x].feature, split[x].upto)
        learn([c for x in ask for c in children[x]])
    tree, places = Tree(), {0: 0}
    for x in done:
        for old, new in zip(children[x], tree.split(places[x], split[x].feature, split[x].upto), strict=True):
            places[old] = new
    for old in open_:
        g, n = sums[old]
        tree.value[places[old]] = -rate * (g / scale) / (n + l2)
    return tree


@dataclass(frozen=True)
class Boosted:
    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    base: float
    trees: tuple[Tree, ...]

    def predict(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.edges)
        return self.base + sum((t.predict(bins) for t in self.trees), np.zeros(len(bins)))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self)  # trees of 31 leaves

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            return pd.Series(held.value.predict(np.stack([c.to_numpy(float) for c in columns], 1)))

        return df.withColumn(name, predicted(*_numbers(self.features)))


def _numbers(features: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in features]


def edges_of(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, ...]:
    """Edges of the bins: distinct quantiles; a value equal to an edge is in the bin below it."""
    at = [k / (BINS - 1) for k in range(BINS - 1)]
    found: dict[str, list[float]] = {}
    for c, _, v in order_statistics(df, features, at):
        if v is not None and not np.isnan(v):
            found.setdefault(c, []).append(v)
    return tuple(np.unique(np.array(found.get(c, []), float)) for c in features)


def fitted(df: DataFrame, features: Sequence[str], label: str = "trips", rounds: int = 200, rate: float = 0.08, leaves: int = 31, least: int = 30, l2: float = 1.0) -> Boosted:
    """A model for squared error; rows without a label are left out. Missing features are values of their own, above all others."""
    forbid_leaks(features)
    df = df.where(F.col(label).isNotNull())
    edges, width = edges_of(df, features), BINS + 1
    n, base, low, high = df.agg(F.count(F.lit(1)), F.avg(F.col(label).cast("double")), F.min(F.col(label).cast("double")), F.max(F.col(label).cast("double"))).first()
    if not n:
        return Boosted(tuple(features), edges, 0.0, ())
    base = float(f"{base:.9g}")  # the same whatever the order of summing
    # so that n sums of gradients, which stay within a few times the first ones, fit a long
    scale = 2.0 ** (60 - np.ceil(np.log2(n)) - np.ceil(np.log2(4 * max(high - base, base - low, 1e-9)))) if n > 1 else 1.0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(edges))], 1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in binned(v, edges)], pa.binary()), b.column(len(edges)), pa.array(np.full(len(v), base))], names=["x", "y", "p"])

    rows = pinned(df.select(*[c.alias(f"f{k}") for k, c in enumerate(_numbers(features))], F.col(label).cast("double").alias("y")).mapInArrow(packed, "x binary, y double, p double"))

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, len(edges))

    trees: list[Tree] = []
    for r in range(rounds):
        recent = trees[r - r % REFRESH :]
        if r and r % REFRESH == 0:
            last = trees[r - REFRESH :]

            def moved(batches: Iterator[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x = matrix(b)
                    yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(b.column("p").to_numpy() + sum(t.predict(x) for t in last))], names=["x", "y", "p"])

            rows = pinned(rows.mapInArrow(moved, "x binary, y double, p double"))

        def histograms(tree: Tree, nodes: list[int], rows=rows, recent=recent) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            size = len(edges) * width

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                g, c = np.zeros((len(nodes), size), np.int64), np.zeros((len(nodes), size), np.int64)
                index = np.full(len(tree.feature), -1)
                index[nodes] = np.arange(len(nodes))
                for b in batches:
                    x = matrix(b)
                    place = index[tree.places(x)]
                    use = place >= 0
                    grad = b.column("p").to_numpy() + sum((t.predict(x) for t in recent), np.zeros(len(x))) - b.column("y").to_numpy()
                    whole = np.round(grad[use] * scale).astype(np.int64)
                    for f in range(len(edges)):
                        at = place[use] * size + f * width + x[use, f]
                        np.add.at(g.reshape(-1), at, whole)
                        np.add.at(c.reshape(-1), at, 1)
                some = np.flatnonzero(c.reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g.reshape(-1)[some]), pa.array(c.reshape(-1)[some])], names=["at", "g", "n"])

            found = rows.mapInArrow(sums, "at long, g long, n long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()  # nodes x features x bins at most
            g, c = np.zeros(len(nodes) * size, np.int64), np.zeros(len(nodes) * size, np.int64)
            at = found.column("at").to_numpy()
            g[at], c[at] = found.column("g").to_numpy(), found.column("n").to_numpy()
            return {node: (g.reshape(len(nodes), len(edges), width)[k], c.reshape(len(nodes), len(edges), width)[k]) for k, node in enumerate(nodes)}

        trees.append(grown(histograms, leaves, scale, least, l2, rate))
    return Boosted(tuple(features), edges, base, tuple(trees))
