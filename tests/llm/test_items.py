"""Hard negatives, conversation repair and benchmark decontamination against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityflux.llm import op11_negatives as neg
from cityflux.llm import op12_repair as rep
from cityflux.llm import op13_contamination as con
from cityflux.llm import registry
from tests.oracle import connect, same


@pytest.mark.parametrize("name", ["op11_negatives", "op12_repair", "op13_contamination"])
def test_query_against_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLES[name])


# Hard negatives


def vectors(seed=3, n=700, d=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, d)) / 3
    rows = [(k, int(r.integers(0, 4)), (centres[r.integers(0, 7)] + r.normal(size=d) * 0.15).tolist()) for k in range(n)]
    hot = rows[5][2]
    rows = [(k, label, hot if k % 3 == 0 else v) for k, label, v in rows]
    rows += [(800, 1, [0.0] * d), (801, None, hot), (802, 1, None), (803, 1, [*hot[:-1], None]), (804, 1, [*hot[:-1], math.nan]), (805, 2, [*hot[:-1], math.inf])]
    rows += [(None, 1, hot), (900, 1, hot), (900, 1, hot), (900, 2, hot[:5]), (901, 3, []), (1000, 0, [-x for x in hot]), (1100, 2, [0.0] * d)]
    return rows


def brute_negatives(rows):
    d = max(len(v) for _, _, v in rows if v)
    live = [(i, label, [math.floor(256 * x) for x in v] + [0] * (d - len(v))) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (1, 0) if i is None else (0, i)
    out = []
    for k, (anchor, label, a) in enumerate(live):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a, v, strict=True)), i, own) for n, (i, own, v) in enumerate(live) if n != k]
        scored.sort(key=lambda x: (-x[0], last(x[1])))
        for p, positive, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(s, i) for s, i, own in scored if own != label and 80 * p <= 100 * s <= 100 * p]
            out += [(anchor, positive, rank, i, p, s) for rank, (s, i) in enumerate(fits[:5], 1)]
    return out


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"row": F.lit("x"), "list": F.lit(1)}).repartition(5)
    return sorted(map(tuple, neg.mined(df, lambda i: i % 100 == 0).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"LIST_ROWS": 20, "BLOCK": 9, "PROBE": 1, "AT_ONCE": 3}, {"LIST_ROWS": 5, "SAMPLE": 30, "MOST_LISTS": 4}])
def test_negatives_against_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(neg, name, value)
    rows = vectors()
    want = sorted(brute_negatives(rows), key=repr)
    assert len(want) > 60
    assert mined(spark, rows) == want


@pytest.mark.parametrize("scale", [1e4, 1e6, 1e16])
def test_negatives_of_large_numbers(spark, scale):
    rows = [(i, label, v and [x and x * scale for x in v]) for i, label, v in vectors(n=250)]
    clip = lambda x: max(neg.LEAST, min(neg.MOST, x))
    want = brute_negatives(rows)
    if scale == 1e16:  # beyond a long: scores stand as its ends
        assert {x[-1] for x in mined(spark, rows)} <= {neg.MOST, *[clip(x[-1]) for x in want]}
    else:
        assert mined(spark, rows) == sorted(want, key=repr)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(100, 0, []), (1, 0, []), (2, 1, [])]) == [(100, 1, 1, 2, 0, 0)]


def test_bounds_hold_and_lists_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(neg, "LIST_ROWS", 20)
    rows = spark.createDataFrame([x for x in vectors() if x[2]], "vec_id long, label int, embedding array<double>")
    with neg.Scratch(spark) as scratch:
        index = neg.Index(neg.quantised(rows, "vec_id", "label", "embedding"), scratch)
        found = index.rows.collect()
        v, near = neg.unpacked([r["v"] for r in found], index.lists.d), np.array([r["list"] for r in found])
        high, low = index.lists.bounds(v[:50])
        s = neg.scores(v, v[:50])
        for k in range(50):
            assert (s[:, k] <= high[k][near]).all()
            assert (s[:, k] >= low[k][near]).all()
        asks = index.rows.where("id % 50 = 0").select("row", "label", "v", F.lit(False).alias("same"), *[F.lit(x).alias(c) for c, x in (("lows", "200"), ("highs", "900"), ("floors", "400"))])
        second = neg.visits(asks, index, False).select("row", "list").distinct().count()
        assert 0 < second < asks.count() * (len(index.lists.centre) - neg.PROBE)


# Conversation repair


def brute_best(kinds):
    """Cheapest edits by trying all of them: kinds are (fault, initial)."""
    best = None
    runs = ["", "I", "II"]
    choices = [[r + x for r in runs for x in ("D" if f in ("b", "d") else "DKR")] for f, _ in kinds]
    for edit in itertools.product(*choices, runs):
        cost, state, ok = 0, "", True
        for (fault, initial), macro in zip(kinds, edit[:-1], strict=True):
            for letter in macro[:-1]:
                cost += 5
                state += "u" if not state or state[-1] in "sa" else "a"
            x = macro[-1]
            cost += {"K": 0, "R": 1, "D": 2}[x] + (5 if x != "D" and fault == "t" else 0)
            state += "" if x == "D" else initial if x == "K" else "u" if not state or state[-1] in "sa" else "a"
        for _ in edit[-1]:
            cost += 5
            state += "u" if not state or state[-1] in "sa" else "a"
        bare = state.removeprefix("s")
        ok = state == "" or bare and bare == "ua" * (len(bare) // 2)
        if ok and (best is None or (cost, "".join(edit)) < best):
            best = cost, "".join(edit)
    return best


def test_layers_against_all_edits():
    r = random.Random(1)
    for _ in range(250):
        kinds = [(r.choice(["", "", "t", "d", "b"]), r.choice("suaxsu")) for _ in range(r.randrange(5))]
        layers = rep.Layers()
        for fault, initial in kinds:
            layers.step(rep.KINDS[rep.kind_of(fault, initial)])
        state, inserts, cost = layers.end()
        assert (cost, "".join(rep.CODES[c] for _, c in layers.path(rep.E, state)) + "I" * inserts) == brute_best(kinds)


def chats(seed=2, n=120):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ursula"])
            rows.append((c, r.choice([t, t, t, t + 3, None]), role, r.choice([f"Text {r.randrange(9)}.", "no end", "  ", "", None, "End! \n", "ö? ", "x" * 50 + "."])))
    rows += [(None, t, "user", "Hi.") for t in range(40)] + [(None, None, None, None)] * 6 + [(7, 3, "user", "Hi.")] * 9
    rows += [(1000, t, "ua"[t % 2] + "x", f"{t}.") for t in range(300)]
    r.shuffle(rows)
    return rows


def brute_repair(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        show = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if code == 1 else "".join(x for x in text if x not in ".!?") if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, kinds = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kinds.append(("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "", role[:1]))
            seen.add((role, text))
        turns = {x[0] for x in own if x[0] is not None}
        paths = {"": (0, "", [])}  # role initials so far, shortened to what counts
        for (fault, initial), (_, role, text) in zip(kinds, own, strict=True):
            now = {}
            for state, (cost, audit, made) in paths.items():
                for run in range(3):
                    for x in "D" if fault in ("b", "d") else "DKR":
                        s, m = state, list(made)
                        for _ in range(run):
                            s = "a" if s == "u" else "u"
                            m.append({"u": "user:", "a": "assistant:"}[s])
                        if x == "K":
                            if not ((initial == "s" and s == "") or (initial == "u" and s != "u") or (initial == "a" and s == "u")):
                                continue
                            s = initial
                            m.append(f"{role}:{text}")
                        elif x == "R":
                            s = "a" if s == "u" else "u"
                            m.append({"u": "user:", "a": "assistant:"}[s] + text)
                        found = (cost + 5 * run + {"K": 0, "R": 1, "D": 2}[x] + (5 if x != "D" and fault == "t" else 0), audit + "I" * run + x, m)
                        now[s] = min(now[s], found) if s in now else found
            paths = now
        ends = []
        for s, (cost, audit, made) in paths.items():
            more = {"": [], "a": [], "u": ["assistant:"], "s": ["user:", "assistant:"]}[s]
            ends.append((cost + 5 * len(more), audit + "I" * len(more), made + more))
        cost, audit, made = min(ends)
        count = lambda f: sum(k[0] == f for k in kinds)  # noqa: B023, E731
        illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("sizes", [{}, {"BIG_ROWS": 6, "SEGMENT": 5}, {"BIG_ROWS": 0, "SEGMENT": 1}, {"BIG_CHARS": 40}])
def test_repair_against_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(rep, name, value)
    rows = chats()
    got = rep.repaired(rep.damaged(spark.createDataFrame(rows, CHAT).repartition(7))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_repair(rows)
    assert len(got) == len({r[0] for r in rows})


def test_repair_of_odd_rows(spark):
    made = lambda rows, kind=CHAT: {r[0]: tuple(r[1:]) for r in rep.repaired(rep.intact(spark.createDataFrame(rows, kind))).collect()}
    assert made([]) == {}
    assert made([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")], CHAT.replace("conv_id long", "conv_id string")) == {"a": (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest())}
    gone = next(t for t in range(999) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = rep.repaired(rep.damaged(spark.createDataFrame([(5, gone, "user", "Hi.")], CHAT))).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_dropped_large_conversations_stay(spark, monkeypatch):
    monkeypatch.setattr(rep, "BIG_ROWS", 1)
    gone = next(t for t in range(999) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = rep.repaired(rep.damaged(spark.createDataFrame([(5, gone, "user", "Hi.")] * 4, CHAT))).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# Benchmark decontamination


def brute_words(text):
    out, word = [], ""
    for c in [*(text or ""), " "]:
        if ord(c) > 127 or (c.isascii() and c.isalnum()):
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = brute_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = brute_words(t)
        hit, named = set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaks(seed=4):
    r = random.Random(seed)
    say = lambda n, of=5: " ".join(f"{r.choice('aBcÖd')}{r.randrange(of)}" for _ in range(n))
    items = [(k, say(r.choice([1, 2, 3, 7, 9, 10, 11, 14, 30]) if k % 2 else 12 + k, 6)) for k in range(30)]
    items += [(50, None), (51, " .,"), (52, items[9][1]), (9, items[3][1]), (None, say(12)), (60, "same " * 14), (61, "a b"), (62, "x")]
    docs = []
    for k in range(120):
        part = r.choice(items)[1] or ""
        w = part.split()
        if k % 3 == 0 and w:
            w[r.randrange(len(w))] = "zz"
        docs.append((k, say(r.randrange(40), 40) + " -- " + " ,".join(w).upper() + "! " + say(r.randrange(30), 6)))
    docs += [(None, None), (None, "same " * 9), (500, "same " * 25), (501, ""), (3, docs[5][1]), (502, "Ö" * 40000 + " x"), (503, say(9, 6) + " " + (items[0][1] + " ") * 300)]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"MOST_CHARS": 60}, {"MOST_CHARS": 300, "PIECE": 3}])
def test_hits_against_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(con, name, value)
    docs, items = leaks()
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], "doc_id long, text string, spans string, _s string, n_hit string").repartition(5)
    of = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, item string").repartition(3)
    got = con.digest(con.marked(df, of))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr) == brute_hits(docs, items)
    assert "_s" in got.columns


def test_hits_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[2:] for r in con.marked(docs, items).collect()] == [(3, [], [])]
    assert con.marked(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_blocks_of_clean_texts_are_passed_over():
    t = con.built([("1", [f"w{k}".encode() for k in range(12)], True)])[0]
    looked = []
    t.shift = type("Seen", (dict,), {"get": lambda s, k, d: looked.append(k) or dict.get(s, k, d)})(t.shift)
    assert list(t.occurrences([b"x"] * 900)) == []
    assert len(looked) == 99
    assert {0, 1} == {s for s, _ in t.occurrences([f"w{k}".encode() for k in range(11)])}
