"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Input at a word: a word embedding plus the mean of its character n-gram embeddings (3 to 6 bytes, with word marks), both
hashed into fixed tables. Two gated recurrent layers run over a window of words, one each way; attention pools their states
and a logistic output scores the window. Windows of ``WINDOW`` words start every ``STRIDE`` words, half a window, and cover
the whole text; a document's score is a logistic combination of its ``TOP`` highest windows that don't overlap and its
length. All of it is numpy, in tasks: the trainings, those on folds and the last one, are the tasks of one job.

Training uses at most ``TRAIN_EACH`` documents of each class, least hashes first, as long as they have ``TRAIN_CHARS``
characters together at most, whatever the length of each, and only rows with crc32(id as text) mod 5 other than 0. A step
trains on the highest window of each document it draws, of the ``LEADING`` windows with the most telling words and
``OTHERS`` at random; in the first rounds a toxic document shows the window whose words, or their n-grams, are most of toxic
documents. For ``WORD_DROP`` of a batch's words the word table is left out, so that n-grams carry what unseen words show.
The number of rounds, the combination and its cut are those that do best on folds of the training documents which a network
hasn't seen; the cut counts a flagged clean document ``CLEAN_COST`` times. The seed, the order and so the weights are fixed
by the data.

A task computes a word's input once and keeps it in a table that starts anew at ``TABLE_WORDS`` words.

Defined results: a null or blank text is one empty window; a null id counts as held out; repeated rows are scored alike;
texts of any length are read whole; an empty table gives no rows; without labels of both classes the score is 0; input
columns that clash with output columns are replaced, other columns may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import struct_of, table

WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN = 4096, 16384, 16, 8
GRAMS = (3, 4, 5, 6)
TRAIN_EACH, TRAIN_CHARS = 800, 24_000_000
ROUNDS, SEED_ROUNDS, ROUND_BATCHES, BATCH, RATE = 7, 3, 60, 32, 0.01
FOLDS, WORD_DROP, DECAY, SMOOTH, CLEAN_COST, MEAN = 3, 0.8, 0.002, 4.0, 5, 0.98
#: Windows that a document's score combines; logits are cut at ``FAR``, which also stands for windows that a text lacks.
TOP, FAR, HEAD_DECAY = 3, 8.0, 0.001
#: Of a long document's windows a training step looks at these many; scoring looks at all.
LEADING, OTHERS = 8, 16
TABLE_WORDS, WORDS_AT_ONCE, WINDOWS_AT_ONCE = 200_000, 200_000, 2048
#: ASCII signs and digits part words.
_PLAIN = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PLAIN).split()


def gram_hashes(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n: how many n-grams each word has, and their 32-bit hashes, word by word."""
    x = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    size = np.array([len(w) + 2 for w in words], np.int64)
    left = np.repeat(size, size) - (np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size))  # characters up to the word's end
    h = np.full(len(x), 2166136261, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        size_n = max(0, len(x) - n + 1)
        h = (h[:size_n] ^ x[n - 1 :]) * np.uint32(16777619)
        if n in GRAMS:
            yield np.maximum(size - n + 1, 0), ((h ^ (h >> np.uint32(15))) * np.uint32(2654435761))[left[:size_n] >= n]


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Word rows; per n: (words that have n-grams, where theirs start, gram rows); gram counts."""
    x = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint32)
    size = np.array([len(w) + 2 for w in words], np.int64)
    start = np.cumsum(size) - size
    per_n, total = [], np.zeros(len(words), np.int64)
    for counts, hashes in gram_hashes(words):
        have = np.flatnonzero(counts)
        per_n.append((have, np.cumsum(counts[have]) - counts[have], ((hashes >> np.uint32(18)) % GRAM_ROWS).astype(np.int64)))
        total += counts
    whole = np.bitwise_xor.reduceat(x * (np.arange(len(x), dtype=np.uint32) - np.repeat(start, size).astype(np.uint32) + np.uint32(1)) * np.uint32(2246822519), start) if len(words) else np.empty(0, np.uint32)
    whole = (whole ^ (whole >> np.uint32(13))) * np.uint32(3266489917)
    return ((whole >> np.uint32(16)) % WORD_ROWS).astype(np.int64), per_n, total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Weights by name, all float32."""

    SHAPES = {"word": (WORD_ROWS, WIDTH), "gram": (GRAM_ROWS, WIDTH), "wx": (WIDTH, 6 * HIDDEN), "bx": (6 * HIDDEN,), "uf": (HIDDEN, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "wa": (2 * HIDDEN, HIDDEN), "ba": (HIDDEN,), "va": (HIDDEN,), "wo": (2 * HIDDEN,), "bo": ()}

    def __init__(self, weights: dict[str, np.ndarray] | None = None, head: np.ndarray | None = None, known: bool = True):
        rng = np.random.default_rng(7)
        self.w = weights or {k: (rng.standard_normal(s) * (0.1 if k in ("word", "gram") else 0 if k[0] == "b" else s[0] ** -0.5)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.head, self.known = np.append(np.eye(1, TOP + 1)[0], 0) if head is None else head, known

    # inputs

    def embed(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        rows, per_n, total = parts = word_inputs(words)
        x = np.zeros((len(words), WIDTH), np.float32)
        for have, starts, grams in per_n:
            if len(have):
                x[have] += np.add.reduceat(self.w["gram"][grams], starts)
        return self.w["word"][rows] + x / np.maximum(total, 1)[:, None].astype(np.float32), parts

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w["wx"] + self.w["bx"]

    # a layer's run over windows

    def _run(self, a: np.ndarray, ids: np.ndarray, real: np.ndarray | None, u: np.ndarray, order, keep: bool):
        h = np.zeros((len(ids), HIDDEN), np.float32)
        states, saved = np.empty((ids.shape[1], len(ids), HIDDEN), np.float32), []
        for t in order:
            g, hu = a[ids[:, t]], h @ u
            zr = sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if real is not None:
                new = np.where(real[:, t, None], new, h)
            if keep:
                saved.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
            h = states[t] = new
        return states, saved

    def forward(self, a: np.ndarray, ids: np.ndarray, real: np.ndarray | None, keep: bool = False):
        """Logits of windows; ``a`` the projected inputs, ``ids`` (windows, words), ``real`` where a window has words."""
        steps = range(ids.shape[1])
        f, sf = self._run(a[:, : 3 * HIDDEN], ids, real, self.w["uf"], steps, keep)
        b, sb = self._run(a[:, 3 * HIDDEN :], ids, real, self.w["ub"], reversed(steps), keep)
        s = np.concatenate((f, b), 2)
        e = np.tanh(s @ self.w["wa"] + self.w["ba"])
        q = e @ self.w["va"]
        if real is not None:
            q = np.where(real.T, q, -30)
        p = np.exp(q - q.max(0))
        p /= p.sum(0)
        if real is not None:
            p = p * real.T  # an empty window pools nothing
        c = np.einsum("tn,tnh->nh", p, s)
        logit = c @ self.w["wo"] + self.w["bo"]
        return (logit, (s, e, p, c, sf, sb)) if keep else logit

    def gradients(self, a, ids, real, d, saved) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the loss whose slope by logit is ``d``; also by projected input."""
        s, e, p, c, sf, sb = saved
        g = {"wo": c.T @ d, "bo": d.sum()}
        dc = d[:, None] * self.w["wo"]
        ds = p[:, :, None] * dc
        dp = np.einsum("nh,tnh->tn", dc, s)
        dq = p * (dp - (p * dp).sum(0))
        g["va"] = np.einsum("tn,tnh->h", dq, e)
        de = dq[:, :, None] * self.w["va"] * (1 - e * e)
        g["wa"], g["ba"] = np.einsum("tnh,tnk->hk", s, de), de.sum((0, 1))
        ds = ds + de @ self.w["wa"].T
        da = np.zeros_like(a)
        for name, part, steps, at in (("uf", ds[:, :, :HIDDEN], sf, 0), ("ub", ds[:, :, HIDDEN:], sb, 3 * HIDDEN)):
            u, gu, dh = self.w[name], np.zeros_like(self.w[name]), np.zeros((len(ids), HIDDEN), np.float32)
            for t, h, z, r, n, hun in reversed(steps):
                dh = dh + part[t]
                live = dh if real is None else np.where(real[:, t, None], dh, 0)
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dg = np.concatenate((dz, dr, dn), 1)
                dhu = np.concatenate((dz, dr, dn * r), 1)
                gu += h.T @ dhu
                np.add.at(da[:, at : at + 3 * HIDDEN], ids[:, t], dg)
                dh = (dh - live) + live * z + dhu @ u.T
            g[name] = gu
        return g, da

    # documents

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.round(sigmoid(features @ self.head[:-1] + self.head[-1]), 6) if self.known else np.zeros(len(features))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of all overlapping windows; the last one ends with the text. A text has one at least."""
    count = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, np.maximum(0, np.minimum(k * STRIDE, sizes[doc] - WINDOW))


def window_ids(flat: np.ndarray, sizes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    begin = np.cumsum(sizes) - sizes
    at = first[:, None] + np.arange(WINDOW)
    real = at < sizes[doc][:, None]
    ids = flat[np.minimum(begin[doc][:, None] + at, max(0, len(flat) - 1))] if len(flat) else np.zeros(at.shape, np.int64)
    return np.where(real, ids, 0), None if real.all() else real


class Scorer:
    """Scores texts with one network; words' inputs are computed once."""

    def __init__(self, net: Network):
        self.net, self.ids, self.a, self.n = net, {}, np.zeros((1024, 6 * HIDDEN), np.float32), 0

    def _known(self, texts: list[list[bytes]]) -> np.ndarray:
        flat = [w for t in texts for w in t]
        if self.n >= TABLE_WORDS:
            self.ids, self.n = {}, 0
        new = [w for w in dict.fromkeys(flat) if w not in self.ids]
        if new:
            if self.n + len(new) > len(self.a):
                self.a = np.concatenate((self.a[: self.n], np.zeros((self.n + 2 * len(new), 6 * HIDDEN), np.float32)))
            self.a[self.n : self.n + len(new)] = self.net.project(self.net.embed(new)[0])
            self.ids.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        return np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """Per text: the logits of its ``TOP`` highest windows that don't overlap, highest first, and its length."""
        flat, sizes = self._known(texts), np.array([len(t) for t in texts], np.int64)
        doc, first = windows(sizes)
        value = np.empty(len(doc), np.float64)
        for i in range(0, len(doc), WINDOWS_AT_ONCE):
            part = slice(i, i + WINDOWS_AT_ONCE)
            ids, real = window_ids(flat, sizes, doc[part], first[part])
            value[part] = self.net.forward(self.a, ids, real)
        value = np.clip(value, -FAR, FAR)
        out = np.full((len(texts), TOP + 1), -FAR, np.float64)
        out[:, TOP] = np.log1p(sizes)
        for k in range(TOP):
            order = np.lexsort((first, -value, doc))
            lead = order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))] if len(order) else order
            out[doc[lead], k] = value[lead]
            at = np.full(len(texts), -WINDOW, np.int64)
            at[doc[lead]] = first[lead]
            free = np.abs(first - at[doc]) >= WINDOW
            doc, first, value = doc[free], first[free], value[free]
        return out

    def scores(self, texts: Iterator[str | None]) -> np.ndarray:
        out, held, size = [], [], 0
        for text in texts:
            held.append(words_of(text))
            size += len(held[-1])
            if size >= WORDS_AT_ONCE:
                out.append(self.net.scores(self.features(held)))
                held, size = [], 0
        if held:
            out.append(self.net.scores(self.features(held)))
        return np.concatenate(out) if out else np.empty(0)


def _leanings(names: list[bytes], docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """How much each word, or the n-gram of it that leans most, is of toxic documents: its smoothed share of them."""
    owners, keys = [np.arange(len(names))], [np.arange(len(names), dtype=np.int64)]
    for n, (counts, hashes) in enumerate(gram_hashes(names), 1):
        owners.append(np.repeat(np.arange(len(names)), counts))
        keys.append(hashes.astype(np.int64) + (n << 33))
    owner = np.concatenate(owners)
    _, part = np.unique(np.concatenate(keys), return_inverse=True)
    order = np.argsort(owner, kind="stable")
    part, first = part[order], np.searchsorted(owner[order], np.arange(len(names) + 1))
    seen, bad, share = np.zeros(part.max() + 1), np.zeros(part.max() + 1), float(labels.mean())
    for words, label in zip(docs, labels, strict=True):
        words = np.unique(words)
        counts = first[words + 1] - first[words]
        held = np.unique(part[np.repeat(first[words], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)])
        seen[held] += 1
        bad[held] += label
    lean = (bad + SMOOTH * share) / (seen + SMOOTH)
    return np.maximum.reduceat(lean[part], first[:-1])


class _Trainer:
    """Documents as numbers of distinct words, their leanings, and one network in training."""

    def __init__(self, docs: list[list[bytes]], y: np.ndarray):
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
        self.names, self.y, self.docs = list(vocabulary), y, docs
        self.flat = [np.fromiter(map(vocabulary.__getitem__, d), np.int64, len(d)) for d in docs]
        self.lean = _leanings(self.names, self.flat, y) if self.names else np.zeros(1)
        self.net, self.rng, self.step = Network(), np.random.default_rng(11), 0
        self.leading = [self._leading(f) for f in self.flat]
        self.m = {k: np.zeros_like(v) for k, v in self.net.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.net.w.items()}
        self.mean = {k: v.astype(np.float64) for k, v in self.net.w.items()}

    def _leading(self, flat: np.ndarray) -> np.ndarray:
        """A document's first words of windows, those with the most leaning word first."""
        _, first = windows(np.array([len(flat)]))
        if len(flat) <= WINDOW:
            return first
        high = np.lib.stride_tricks.sliding_window_view(self.lean[flat], WINDOW)[first].max(1)
        return first[np.argsort(-high, kind="stable")]

    def round(self, seeded: bool) -> None:
        """Whole passes over the documents, in ``ROUND_BATCHES`` batches at least."""
        done = 0
        while done < ROUND_BATCHES:
            order = self.rng.permutation(len(self.flat))
            for i in range(0, len(order), BATCH):
                self._batch(order[i : i + BATCH], seeded)
                done += 1

    def _tried(self, d: int, seeded: bool) -> np.ndarray:
        """The windows of a document that a step looks at: those with the most leaning words, and others at random."""
        first = self.leading[d]
        if seeded and self.y[d] > 0:
            return first[:1]
        if len(first) <= LEADING + OTHERS:
            return first
        return np.concatenate((first[:LEADING], self.rng.choice(first[LEADING:], OTHERS, replace=False)))

    def _batch(self, part: np.ndarray, seeded: bool) -> None:
        net, y = self.net, self.y[part]
        tried = [self._tried(d, seeded) for d in part]
        doc, first = np.repeat(np.arange(len(part)), [len(t) for t in tried]), np.concatenate(tried)
        sizes = np.array([len(self.flat[d]) for d in part], np.int64)
        ids, real = window_ids(np.concatenate([self.flat[d] for d in part]), sizes, doc, first)
        words, ids = np.unique(ids, return_inverse=True)
        ids = ids.reshape(real.shape if real is not None else (len(doc), WINDOW))
        x, (rows, per_n, total) = net.embed([self.names[w] for w in words] if self.names else [b""])
        value = net.forward(net.project(x), ids, real)
        best = np.lexsort((-value, doc))
        best = best[np.concatenate(([True], doc[best][1:] != doc[best][:-1]))]
        ids, real = ids[best], None if real is None else real[best]
        # the word table is dropped for some words, so that n-grams learn what unseen words can show too
        known = self.rng.random(len(words)) >= WORD_DROP
        x = x - net.w["word"][rows] * ~known[:, None]
        a = net.project(x)
        logit, saved = net.forward(a, ids, real, keep=True)
        weight = np.where(y > 0, self.balance, 1).astype(np.float32)
        d = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g, da = net.gradients(a, ids, real, d, saved)
        g["wx"], g["bx"] = x.T @ da, da.sum(0)
        dx = da @ net.w["wx"].T
        g["word"], g["gram"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["gram"])
        hit = np.abs(da).sum(1) > 0
        used = np.flatnonzero(hit & known)
        np.add.at(g["word"], rows[used], dx[used])
        each = dx / np.maximum(total, 1)[:, None].astype(np.float32)
        for have, starts, grams in per_n:
            owner = np.repeat(have, np.diff(np.append(starts, len(grams))))
            keep = hit[owner]
            np.add.at(g["gram"], grams[keep], each[owner[keep]])
        self.step += 1
        for k in net.w:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.99 * self.v[k] + 0.01 * g[k] ** 2
            move = RATE * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.99**self.step)) + 1e-6)
            net.w[k] = (net.w[k] * (1 - (DECAY if k in ("word", "gram") else 0)) - move).astype(np.float32)
            self.mean[k] += (1 - MEAN) * (net.w[k] - self.mean[k])

    def averaged(self) -> Network:
        """The network of the running mean of the weights, which a single step moves little."""
        return Network({k: v.astype(np.float32) for k, v in self.mean.items()})

    @property
    def balance(self) -> float:
        return float((self.y == 0).sum() / max(1, (self.y > 0).sum()))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    """Mean logistic loss, both classes alike."""
    each = np.logaddexp(0, np.where(y > 0, -logits, logits))
    return float(np.mean([each[y == c].mean() for c in (0, 1) if (y == c).any()]))


def _head(features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic combination of a document's features, both classes alike; windows never count against a document."""
    x = np.column_stack((features, np.ones(len(y))))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.append(np.full(TOP, 0.3), (0, 0))
    for _ in range(3000):
        slope = x.T @ (weight * (sigmoid(x @ w) - y)) + HEAD_DECAY * np.append(w[:-1], 0)
        w -= 0.05 * slope
        w[:TOP] = np.maximum(w[:TOP], 0)
    return w


def _best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the cuts with the most toxic documents found, each share of clean ones flagged counting ``CLEAN_COST`` times."""
    ranked = np.argsort(logits, kind="stable")
    positive = y[ranked] > 0
    right = CLEAN_COST * np.concatenate(([0], np.cumsum(~positive))) / max(1, (~positive).sum()) + np.concatenate((np.cumsum(positive[::-1])[::-1], [0])) / positive.sum()
    cuts = np.flatnonzero(right >= right.max() - 1e-9)
    edge = np.concatenate(([logits[ranked[0]] - 1], logits[ranked], [logits[ranked[-1]] + 1]))
    cut = cuts[len(cuts) // 2]
    return float((edge[cut] + edge[cut + 1]) / 2)


def _rounds(texts: list[str], labels: list[int], fold: int) -> list:
    """One training, for itself: after each round from ``SEED_ROUNDS`` on, the features of the fold's documents, which it doesn't see; of fold -1, none, the weights."""
    docs, y = [words_of(t) for t in texts], np.array(labels, np.float32)
    place = _places(y)
    own, rest = np.flatnonzero(place != fold), np.flatnonzero(place == fold)
    if len(set(y[own])) < 2 or (fold >= 0 and not len(rest)):
        return []
    trainer, out = _Trainer([docs[i] for i in own], y[own]), []
    for k in range(ROUNDS):
        trainer.round(k < SEED_ROUNDS)
        if k + 1 >= SEED_ROUNDS:
            net = trainer.averaged()
            out.append(net.w if fold < 0 else Scorer(net).features([docs[i] for i in rest]))
    return out


def _places(y: np.ndarray) -> np.ndarray:
    """The fold of each document; each fold has its share of both classes."""
    place = np.empty(len(y), np.int64)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        place[at] = np.arange(len(at)) % FOLDS
    return place


def _apart(spark: SparkSession) -> Callable:
    """Runs trainings as the tasks of one job, which lost executors repeat; all weights have a fixed shape, features a row per training document."""

    def run(train_fold: Callable[[int], list], folds: list[int]) -> list[list]:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for fold in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([fold]), pa.array([pickle.dumps(train_fold(fold))], pa.binary())], names=["fold", "made"])

        start = folds[0]
        made = spark.range(start, start + len(folds), 1, len(folds)).mapInArrow(task, "fold long, made binary").collect()
        return [pickle.loads(r["made"]) for r in sorted(made, key=lambda r: r["fold"])]

    return run


def train(texts: list[str], labels: list[int], spark: SparkSession | None = None) -> Network:
    """A network; its rounds and its cut are those that are best on folds of the documents that a network hasn't seen. With a session, the trainings run side by side."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Network(known=False)
    folds = list(range(-1, FOLDS))
    if spark is None:
        final, *each = [_rounds(texts, labels, fold) for fold in folds]
    else:
        shared = spark.sparkContext.broadcast((texts, labels))  # 2 x TRAIN_EACH texts, TRAIN_CHARS characters in all
        final, *each = _apart(spark)(lambda fold: _rounds(*shared.value, fold), folds)
    place = _places(y)
    unseen = np.zeros((ROUNDS - SEED_ROUNDS + 1, len(y), TOP + 1))
    for fold, features in enumerate(each):
        for k, part in enumerate(features):
            unseen[k, place == fold] = part
    heads = [_head(u, y) for u in unseen]
    best = int(np.argmin([_loss(u @ h[:-1] + h[-1], y) for u, h in zip(unseen, heads, strict=True)]))
    head = heads[best]
    head[-1] -= _best_cut(unseen[best] @ head[:-1] + head[-1], y)
    net = Network(final[best])
    net.head = head
    return net


def remainder(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", each: int = TRAIN_EACH, chars: int = TRAIN_CHARS) -> Network:
    """A network trained on at most ``each`` documents of each class and ``chars`` characters in all."""
    own = labels.where(remainder(id_col) != 0).where(F.col("toxic").isin(0, 1)).select(F.col(id_col).alias("_i"), F.col("toxic").alias("_y")).groupBy("_i").agg(F.max("_y").alias("_y"))
    chosen = None
    for y in (0, 1):
        part = own.where(F.col("_y") == y).orderBy(F.xxhash64("_i"), "_i").limit(each)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_i")  # 2 x each rows at most
    texts = texts.groupBy("_i", "_y").agg(F.min("_t").alias("_t")).where("_t is not null")
    total, most = 0, None
    for row in sorted(texts.select(F.xxhash64("_i").alias("h"), F.length("_t").alias("n")).collect()):
        total += row["n"]
        if total > chars:
            break
        most = row["h"]
    rows = texts.where(F.xxhash64("_i") <= F.lit(most)).collect() if most is not None else []
    rows.sort(key=lambda r: r["_i"])
    return train([r["_t"] for r in rows], [r["_y"] for r in rows], docs.sparkSession)


DIGEST = struct_of("held_out boolean, score double, predicted int")


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with held_out, score and predicted."""
    rest = [f for f in docs.schema.fields if f.name != text_col and f.name not in DIGEST.names]
    shared = docs.sparkSession.sparkContext.broadcast((net.w, net.head, net.known))  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*shared.value))
        for batch in batches:
            score = scorer.scores(t.as_py() for t in batch.column(len(rest)))
            kept = [batch.column(k) for k in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*[f.name for f in rest], "score", "predicted"])

    out = docs.select(*[f.name for f in rest], text_col).mapInArrow(run, T.StructType([*rest, *DIGEST.fields[1:]]))
    return out.withColumn("held_out", remainder(id_col) == 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
