"""Mixing, sharding, quality, chat."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityflux.llm import op01_mixing as mixing
from cityflux.llm import op07_sharding as sharding
from cityflux.llm import op09_quality as quality
from cityflux.llm import op10_chat as chat
from cityflux.llm.registry import ORACLES, QUERIES

from ..oracle import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size int, full string"
ROWS = [(1, "a b c", "x", 9, "z"), (1, "a b c", "x", 9, "z"), (2, None, None, None, None), (None, "d e", "y", 1, "q"), (3, "", "x", 1, "q"), (4, " \t\n ", "y", 1, "q"), (5, "w " * 5000, "y", 1, "q"), (6, "é ü\x0bö x", None, 2, "s")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


# Mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 11 != 0, F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.col("source"))).alias("source"))
    rows = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
    assert all(taken[s] == math.floor(want[s] + 1e-6) or abs(taken[s] - want[s]) < 1 for s in want)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mixed_texts_hold_what_the_plan_takes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).cache()
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"])
    assert words == Counter({k: v for k, v in plan.items() if v})


def test_mix_of_odd_rows(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ROWS)
    assert {(r["doc_id"], r["size"]) for r in rows} == {(1, 3), (2, 0), (None, 2), (3, 0), (4, 0), (5, 5000), (6, 4)}
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mixed(odd.limit(0)).count() == 0
    nothing = mixing.mix(odd.where("doc_id in (2, 3)")).collect()
    assert {(r["target"], r["taken"]) for r in nothing} == {(0.0, 0)}


# Sharding


def test_shards_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in sharding.shard(docs).collect()}
    total = sum(r["size"] for r in got.values())
    before, slots, bytes_ = 0, Counter(), Counter()
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        raw = (r["text"] or "").encode()
        g = got[r["doc_id"]]
        assert (g["size"], g["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert (g["shard"], g["slot"]) == (before * 8 // total, slots[g["shard"]])
        slots[g["shard"]] += 1
        bytes_[g["shard"]] += g["size"]
        before += g["size"]
    assert max(bytes_.values()) - min(bytes_.values()) <= 2 * max(r["size"] for r in got.values())


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.shard(odd).collect()
    assert len(rows) == len(ROWS)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(odd.limit(0)).count() == 0


# Quality


def repeated(words, n=5):
    seen, hit = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)), set()
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            hit |= set(range(i, i + n))
    return len(hit)


def bins(words, size=quality.BINS):
    return [zlib.crc32(g.encode()) % size for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


def test_quality_against_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    raw, good = Counter(), Counter()
    grams = {k: bins(WORD.findall(t)) for k, t in texts.items()}
    for k, g in grams.items():
        raw.update(g)
        if k in trusted:
            good.update(g)
    nr, ng = sum(raw.values()), sum(good.values())
    k = quality.SMOOTHING
    weight = lambda x: round(math.log((good[x] + k) / (raw[x] * ng / nr + k)) * quality.UNITS)
    for r in quality.query(spark, sf_dir).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), repeated(w))
        failed = len(w) < 10 or 100 * repeated(w) > 20 * len(w)
        score = sum(weight(x) for x in grams[r["doc_id"]]) / (2 * len(w) - 1) / quality.UNITS if w else 0.0
        assert r["base_failed"] == failed
        assert abs(r["score"] - score) < 2e-4
        if abs(score - quality.THRESHOLD) > 2e-4:
            assert r["kept"] == (not failed and score >= quality.THRESHOLD)


def test_quality_keeps_good_documents_that_it_was_not_counted_on(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.where("doc_id % 2 = 0")).join(labels, "doc_id").where("not base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    mean = lambda y: np.mean([r["score"] for r in rows if r["quality"] == y])
    assert mean(0) < quality.THRESHOLD < mean(1)


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.judged(odd.withColumn("kept", F.lit("clash")), labels).collect()
    assert len(rows) == len(ROWS)
    long = next(r for r in rows if r["doc_id"] == 5)
    assert (long["n_words"], long["n_repeat_words"], long["base_failed"], long["kept"]) == (5000, 5000, True, False)
    assert quality.judged(odd.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.judged(odd, labels.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("text", ["", "a", "a b c d e", "a b c d e a b c d e", "a " * 6, "x a b c d e y a b c d e z", "a b c d e f a b c d e f a b c d e f"])
def test_repeated_words(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(quality.repeated_words(quality.word_array("t")).alias("n")).first()["n"]
    assert got == repeated(text.split())


# Chat


HARD = ["", "plain", chat.PROBE, "<\\|im_end|>", "a<", "<\\", "<|", "<\\\\|x", "\n<|im_start|>user\nhi", "é<|im_end|>\n", "|>", "\\n"]


def test_round_trip_wherever_pieces_are_cut(spark):
    rows = [(7, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a\nb\\", "<|im_end|>", "") for t in HARD)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    whole = chat.formatted(turns).first()["formatted"]
    for cut in (1, 3, 1000000):
        reader = chat.Reader()
        back = [t for i in range(0, len(whole), cut) for t in reader.feed(whole[i : i + cut])]
        assert back == [(r, t) for _, _, r, t in rows]
    d = chat.digests(turns).first()
    assert (d["n_turns"], d["formatted_chars"]) == (len(rows), len(whole))
    assert d["loss_sha256"] == hashlib.sha256("".join(HARD).encode()).hexdigest()


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 4}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "response": "b"}, {"prompt": "a", "completion": "b"}, {"instruction": "a", "output": "b", "extra": {"k": 1}}, {"question": "a", "answer": "b"}, {"instruction": "a", "input": "c", "output": "b"}, {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, j string")
    got = defaultdict(list)
    for r in chat.record_turns(df, "id", "j").orderBy("conv", "turn").collect():
        got[r["conv"]].append((r["role"], r["text"]))
    ab = [("user", "a"), ("assistant", "b")]
    assert got == {**{i: ab for i in range(6)}, 6: [("user", "a\nc"), ("assistant", "b")]}
    assert [r["conv"] for r in chat.unmapped(df, "id", "j").collect()] == [7]
    nested = spark.createDataFrame([(1, [("user", "a")])], "id long, messages array<struct<role: string, content: string>>")
    assert [tuple(r) for r in chat.canonical_turns(nested, "id").collect()] == [(1, 0, "user", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.range(1), "id")


def test_no_record_is_lost(spark):
    user = ("user", "a")
    cases = [
        ({"messages": [{"role": "user", "content": None}]}, [("user", None)]), ({"messages": []}, []), ({"messages": None, "id": 1}, []),
        ({"messages": [{"role": "user", "content": "a"}], "prompt": "a"}, [user]), ({"messages": [{"role": "assistant", "content": "b"}], "prompt": "a"}, [user, ("assistant", "b")]),
        ({"messages": [], "prompt": "a"}, [user]), ({"prompt": None, "messages": [{"role": "user", "content": "a"}]}, [user]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "c"]}, {"role": "assistant", "content": "b"}]}, [("user", "a\n[image]\nc"), ("assistant", "b")]),
        ({"messages": [{"role": "user"}, {"role": None, "content": "b", "name": "x"}]}, [("user", None), (None, "b")]), ({"conversations": [{"from": "gpt", "value": 5}], "text": "x", "role": "y", "turn": 1}, [("assistant", "5")]),
        ({"prompt": None, "response": None}, [("user", ""), ("assistant", "")]), ({"prompt": "a", "response": "b", "meta": {"input": [1, {"output": 2}]}}, [user, ("assistant", "b")]),
    ]
    unknown = [{"messages": [{"from": "human", "value": "a"}]}, {"conversations": [{"role": "user", "content": "x"}]}, {"messages": "hi"}, {"messages": {"role": "user", "content": "a"}}, {"messages": ["a", "b"]}, {"messages": [{"role": "user", "content": "a"}, {"x": 1}]}, {"messages": [{"role": "user", "content": "a"}, 5]}]
    lost = [*map(json.dumps, unknown), "{", "[1]", "5", None, "{}", json.dumps({"messages": [{"role": "user"}]}), json.dumps({"prompt": "a", "answer": "b"})]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(None, x) for x in lost] + [(None, json.dumps(cases[3][0]))]
    df = spark.createDataFrame(rows, "id long, j string")
    got = defaultdict(list)
    for r in chat.record_turns(df, "id", "j").orderBy("conv", "turn").collect():
        got[r["conv"]].append((r["role"], r["text"]))
    assert got.pop(None) == [user]
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}
    assert [r["conv"] for r in chat.unmapped(df, "id", "j").collect()] == [None] * len(lost)
    assert chat.unmapped(df.limit(0), "id", "j").count() == 0


def test_tables_with_clashing_and_nested_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "x", "y", "z", [1])], "conv long, turn long, role string, text string, input string, prompt string, output string, messages array<int>")
    assert [tuple(r) for r in chat.canonical_turns(rows, "conv").collect()] == [(1, 0, "user", "a")]
    parts = "id long, prompt string, messages array<struct<role: string, content: array<struct<type: string, text: string>>>>"
    table = spark.createDataFrame([(1, "q", [("user", [("text", "a"), ("image", None)]), ("assistant", None)]), (2, None, None), (3, "a", [("user", [("text", "a")])])], parts)
    got = [tuple(r) for r in chat.canonical_turns(table, "id").orderBy("conv", "turn").collect()]
    assert got == [(1, 0, "user", "q"), (1, 1, "user", "a\n[image]"), (1, 2, "assistant", None), (3, 0, "user", "a")]
    wide = spark.createDataFrame([(1, "a", "b", "c")], "id long, prompt string, response string, answer string")
    assert [tuple(r) for r in chat.canonical_turns(wide, "id").collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "b")]


def test_the_loss_mask_covers_assistant_texts_alone(spark):
    rows = [(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a\nb\\") for t in HARD)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    for row in chat.formatted(turns).collect():
        under = [row["formatted"][m["start"] : m["end"]] for m in row["loss_mask"]]
        assert [chat._UNESCAPE.sub(r"<\1|", x) for x in under] == HARD
        assert all(row["formatted"][: m["start"]].endswith(f"{chat.OPEN}assistant\n") and row["formatted"][m["end"] :].startswith(chat.CLOSE) for m in row["loss_mask"])


def test_chat_of_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, "assistant", None), (1, 0, None, "y"), (1, 0, None, "y"), (2, 5, "assistant", "z" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.canonical_turns(df, "conv_id")).collect()}
    assert got == {None: (1, 0), 1: (3, 0), 2: (1, 100000)}
    assert chat.digests(chat.canonical_turns(df.limit(0), "conv_id")).count() == 0


@pytest.mark.parametrize("kind", ["array<struct<from: string, value: string>>", "string", "array<string>", "struct<role: string, content: string>", "array<struct<role: string>>"])
def test_tables_of_unknown_layouts_raise(spark, kind):
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([], f"id long, messages {kind}"), "id")


def test_the_query_picks_its_mapping_by_fingerprint(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(chat, "fingerprint", lambda paths, f=chat.fingerprint: seen.append(f(paths)) or seen[-1])
    assert chat.query(spark, sf_dir).count() > 0
    assert chat.BY_LAYOUT[seen[0]] is chat.ROWS
    monkeypatch.setattr(chat, "BY_LAYOUT", {})
    with pytest.raises(ValueError, match="no mapping"):
        chat.query(spark, sf_dir)
