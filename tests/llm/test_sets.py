"""Near duplicates, repeated substrings, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cityflux.llm import components as cc
from cityflux.llm import op02_jaccard as jac
from cityflux.llm import op08_substrings as sub
from cityflux.llm.shingles import WordHashes, shingle_set

SCHEMA = "doc_id long, text string, n_shingles string, label string, k string, spans string"


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=5):
    """Copies, near copies at many distances, shared passages, a hot group, and odd rows."""
    r = random.Random(seed)
    texts = []
    for n in (1, 3, 4, 5, 6, 9, 20, 60, 300, 1500):
        base = words(r, n)
        texts += [" ".join(base), " ".join(base).upper(), "\t" + "\n".join(base) + " "]
        for share in (0.005, 0.01, 0.02, 0.03, 0.04, 0.06):
            for _ in range(3):
                near = [w if r.random() > share else f"x{r.random()}" for w in base]
                texts.append(" ".join(near))
    hot = words(r, 120)
    for _ in range(120):
        texts.append(" ".join(w if r.random() > 0.025 else f"y{r.random()}" for w in hot))
    passage = words(r, 40)
    for _ in range(60):
        texts.append(" ".join(words(r, r.randrange(30), 10**9) + passage + words(r, r.randrange(60), 10**9)))
    texts += [" ".join(["same"] * n) for n in (3, 5, 30, 31, 200)] + ["", None, " \n ", "ö " * 30, "Ö " * 30]
    rows = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(5)


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_groups_against_brute_force(docs, rows):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jac.grouped(docs).collect()}
    want = brute_groups(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_groups_in_small_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(jac, "CHUNK", 7)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jac.grouped(docs).collect()}
    assert got == brute_groups(rows)


def brute_links(rows):
    sets = {i: shingles(t) for i, t in rows}
    first, links = {}, dict.fromkeys(sets, 0)
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            links[a] += a != b and bool(sets[a]) and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common)
    return {i: (first[frozenset(s)] if s else i, links[i]) for i, s in sets.items()}


@pytest.mark.parametrize("chunk", [jac.LINK_CHUNK, 7])
def test_links_within_components_against_brute_force(docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(jac, "LINK_CHUNK", chunk)
    got = jac.with_links(docs).collect()
    assert {r["id"]: (r["class_id"], r["n_links"]) for r in got} == brute_links(rows)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows)


def test_intersections_in_small_matrices(monkeypatch):
    monkeypatch.setattr(jac, "LINK_CELLS", 12)
    r = np.random.default_rng(3)
    left, right = ([np.unique(r.integers(0, 60, int(n)).astype(np.uint64)) for n in r.integers(1, 40, 5)] for _ in range(2))
    assert jac._common(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_linked_sets_post_a_common_block():
    r = np.random.default_rng(8)
    for n in [4, 5, 7, 12, 15, 16, 17, 40, 63, 64, 65, 200, 256, 257, 1000]:
        for _ in range(20):
            a = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64) * 2 + 1)
            lost = int(r.integers(0, jac.most_difference(n) + 1))
            gained = int(r.integers(0, jac.most_difference(n) - lost + 1))
            b = np.sort(np.concatenate((r.permutation(a)[: n - lost], r.integers(0, 1 << 63, gained, dtype=np.uint64) * 2)))
            common = n - lost
            if 100 * common >= 80 * (n + len(b) - common):
                assert len(a) == len(b) == common or set(jac.posts(a)) & set(jac.posts(b)), (n, lost, gained)
            p, q = jac.parity(a), jac.parity(b)
            size = min(len(p), len(q))
            assert np.bitwise_count(jac.folded(p, size) ^ jac.folded(q, size)).sum() <= lost + gained


def test_one_per_group(spark, docs, rows):
    want = brute_groups(rows)
    kept = sorted(r["doc_id"] for r in jac.one_per_group(docs).collect())
    assert kept == sorted(i for i, (n, c) in want.items() if c == i or not n)
    twice = spark.createDataFrame([(1, "a b", "", "", "", ""), (1, "a b", "", "", "", ""), (None, "a b", "", "", "", ""), (None, "c", "", "", "", "")], SCHEMA)
    out = jac.one_per_group(twice)
    assert out.columns == twice.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == ["(1, 'a b')", "(None, 'c')"]
    assert jac.one_per_group(docs.limit(0)).count() == 0
    assert jac.grouped(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(50)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_shingles_of_short_texts():
    h = WordHashes()
    of = lambda t: shingle_set(h.of(t.encode().split()), 5).tolist()
    assert of("") == []
    assert len(of("a b")) == 1
    assert of("a b") != of("b a")
    assert len(of("a b c d e")) == len(of("a a a a a a a a")) == 1


# Repeated substrings


def brute_removed(rows, span=sub.SPAN):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - span + 1):
            key, at = tuple(w[s : s + span]), (-1 if i is None else i, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - span + 1):
            if first[tuple(w[s : s + span])] < (-1 if i is None else i, s):
                gone |= set(range(s, s + span))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("at_once", [300, 400_000])
def test_substrings_against_brute_force(docs, rows, monkeypatch, at_once):
    monkeypatch.setattr(sub, "WORDS_AT_ONCE", at_once)
    got = sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in sub.deduped(docs).collect())
    assert got == brute_removed(rows)
    assert any("0, '" not in g for g in got)


def test_substrings_of_equal_ids_with_near_hashes(spark):
    passage, other = (" ".join(f"{x}{i}" for i in range(sub.SPAN + 5)) for x in "pq")
    low = F.xxhash64("text").bitwiseAND((1 << 24) - 1).alias("h")
    some = spark.range(12000)
    marked = some.select(F.concat(F.lit("z"), "id", F.lit(" " + passage)).alias("text")).select("text", low)
    clean = some.select(F.concat(F.lit(other + " y"), "id").alias("text")).select(F.col("text").alias("clean"), F.xxhash64("text").bitwiseAND((1 << 24) - 1).alias("h"))
    pair = marked.join(clean, "h").orderBy("text", "clean").first()
    rows = [(1, passage), (7, pair["text"]), (7, pair["clean"])]
    out = sub.deduped(spark.createDataFrame(rows, "doc_id long, text string"), full=True).collect()
    removed = {r["kept"].split()[-1]: r["n_removed"] for r in out}
    assert removed == {passage.split()[-1]: 0, pair["text"].split()[0]: sub.SPAN + 5, pair["clean"].split()[-1]: 0}


def test_substrings_of_odd_rows(spark):
    r = random.Random(9)
    a, b = " ".join(words(r, 30)), " ".join(words(r, 25))
    rows = [(1, a), (1, a), (1, b), (None, b), (2, f"{a}  {b}"), (3, ""), (4, None), (5, " ".join(["x"] * 45))]
    df = spark.createDataFrame([(i, t, "", "", "", "") for i, t in rows], SCHEMA)
    out = sub.deduped(df, full=True).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in out) == brute_removed(rows)
    assert [r["kept"] for r in out if r["doc_id"] == 2] == [""]
    assert sub.deduped(df.limit(0)).count() == 0


def test_batches_of_the_marker_dont_matter(docs, rows, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in sub.deduped(docs).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_removed(rows)


# Pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, seen = docs.count(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(docs.count())
    assert n > seen[0] > seen[1] == seen[2]
    assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.where("text like '%@mail%.example.com%'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    got = sorted(str(tuple(r)) for r in last.collect())
    assert got == sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, sf_dir).select(last.columns).collect())


def windows_kept(spark, rows):
    """Kept words of each (id, text) by the definition: the first of equal windows is the least by (id, start, hash of the text)."""
    keyed = {tuple(r)[:2]: r[2] for r in spark.createDataFrame(sorted(set(rows), key=repr), "i long, t string").select("i", "t", F.xxhash64("t")).collect()}
    at, kept = {}, {}
    for (i, t), h in keyed.items():
        w = t.split()
        for k in range(len(w) - sub.SPAN + 1):
            at.setdefault(tuple(w[k : k + sub.SPAN]), []).append(((i is not None, i or 0, k, h), (i, t), k))
    gone = {key: set() for key in keyed}
    for found in at.values():
        for _, key, k in sorted(found)[1:]:
            gone[key] |= set(range(k, k + sub.SPAN))
    for (i, t), g in gone.items():
        kept[i, t] = " ".join(w for k, w in enumerate(t.split()) if k not in g)
    return kept, at


@pytest.mark.parametrize("batch", [10000, 2])
def test_equal_and_null_ids_in_every_order(spark, batch):
    r = random.Random(8)
    new = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    passage, other = new(150), new(35)
    texts = [(None, passage), (None, new(30) + passage), (5, passage[20:90] + new(3)), (5, new(4) + passage[:100]), (5, other + passage[:60] + other), (None, other), (9, passage), (9, passage), (4, new(25) + other + other)]
    rows = [(i, " ".join(w)) for i, w in texts]
    want, at = windows_kept(spark, rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for n in range(7):
            r.shuffle(rows)
            df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1 + n % 3).withColumn("t", F.col("text"))
            got = sub.deduped(df, full=True).select("doc_id", "t", "kept").collect()
            assert len(got) == len(rows)
            assert {(x["doc_id"], x["t"]): x["kept"] for x in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # no word of the passages is lost altogether
    left = {w for text in want.values() for w in text.split()}
    assert {*passage, *other} <= left


def test_pipeline_of_odd_rows(spark, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a b c d e f g h i j k l", "en", None, 3), (1, "a b c d e f g h i j k l", "en", None, 3)], empty.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        stage(spark, odd, sf_dir).collect()


def test_columns_with_the_names_of_the_steps(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4, 5), (2, text, 1, 2, 3, 4, 5)], "doc_id long, text string, _spans int, _d int, _t int, c0 int, i int")
    rows = sorted(sub.deduped(docs).collect())
    assert [(r["doc_id"], r["n_removed"], r["_spans"], r["_d"], r["_t"], r["c0"], r["i"]) for r in rows] == [(1, 0, 1, 2, 3, 4, 5), (2, 30, 1, 2, 3, 4, 5)]


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(5, 5), (1, 2), (2, 1), (1, 2), (None, 3), (7, None)], "a long, b long")
    assert sorted(tuple(r) for r in cc.components(edges).distinct().collect()) == [(1, 1), (2, 1)]
    assert cc.components(edges.limit(0)).count() == 0
