"""Near-duplicate documents, repeated windows and near-duplicate vectors against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from segtable.cluster import ship
from segtable.llm import embedding_dedup, minhash_dedup, substring_dedup
from segtable.llm.components import connected_components


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def least(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = least({x for p in links for x in p}, links)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near-duplicate documents ---


def shingles(text):
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def near_corpus(seed=1, groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 6, 9, 40, 120, 400]))]
        texts += [" ".join(base)] * rng.choice([1, 1, 3])
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += ["", None, "   ", "Alone", "alone", " x y", "a b", "a  B\n", "x " * 3000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [8, 1])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(minhash_dedup, "SMALL_BUCKET", small)
    rows = near_corpus(small)
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = least(sets, links)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, component long")
    got = minhash_dedup.near_duplicates(df.repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(got) == len(rows)


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (None, 0, None, True)], key=repr)
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_document_links_by_any_of_its_texts(spark):
    """Two texts of one id, each with a near copy of its own; a row without words of a document that has words."""
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "more"])), (3, " ".join([*b, "more"])), (7, None), (7, " ".join(["c", *a])), (8, ""), (8, None), (9, "short"), (4, "short"), (4, " ".join(b[:20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: 1, 2: 1, 3: 1, 7: 1, 8: 8, 9: 4, 4: 4}
    for parts in (1, 3, 7):
        got = minhash_dedup.near_duplicates(df.repartition(parts)).collect()
        assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, c, i == c) for i, c in want.items()} and len(got) == len(rows)
        assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)


@pytest.mark.parametrize("small,broadcast", [(8, 0), (1, 1 << 20)])
def test_near_duplicates_with_repeated_ids_and_hot_keys(spark, monkeypatch, small, broadcast):
    """Brute force over documents of several texts, with joins dealt into pieces and by shuffle or broadcast; the same result over any partitions."""
    from segtable.llm import scratch

    monkeypatch.setattr(minhash_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash_dedup, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(scratch, "HOT_ROWS", 3)
    rng = random.Random(small)
    texts = [t for _, t in near_corpus(small + 10, 6)]
    rows = [(rng.randrange(len(texts) // 2) if rng.random() < 0.2 else k + 1000, t) for k, t in enumerate(texts)]
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    near = lambda x, y: x and y and 100 * len(x & y) >= 75 * len(x | y)
    links = [(i, j) for i in sets for j in sets if i < j and any(near(x, y) for x in sets[i] for y in sets[j])]
    want = least(sets, links)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(df.repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_join_of_hot_keys(spark, monkeypatch):
    from segtable.llm import scratch

    monkeypatch.setattr(scratch, "HOT_ROWS", 5)
    left = spark.createDataFrame([(k % 7 if k % 3 else 99, k) for k in range(300)] + [(1000, 0)], "a long, v long")
    right = spark.createDataFrame([(k, f"w{k}") for k in [*range(5), 99]], "a long, w string")
    hot = scratch.hot_keys(left.groupBy("a").count(), ["a"])
    assert 99 in [r.a for r in hot.collect()] and 1000 not in [r.a for r in hot.collect()]
    for how in ("inner", "left"):
        assert Counter(map(tuple, scratch.join_hot(left, right, ["a"], hot, how).select("a", "v", "w").collect())) == Counter(map(tuple, left.join(right, "a", how).select("a", "v", "w").collect()))
    assert scratch.hot_keys(left.limit(0).groupBy("a").count(), ["a"]) is None


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
    b = np.unique(np.concatenate([a[:450], rng.integers(0, 2**63, 150).astype(np.uint64)]))
    items, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    made = minhash_dedup.sketches(items, first, 1024)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((made[0] == made[1]).mean() - true) < 0.06


# --- repeated windows ---


def brute_spans(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append([x for x, g in zip(w, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("window,period", [(5, 3), (8, 7), (35, 21)])
def test_repeated_windows(spark, window, period):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefghijkl") for _ in range(window + rng.randint(-2, 9))] for _ in range(6)]
    texts = []
    for _ in range(60):
        w = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "\n"]).join(w))
    texts += [None, "", " ", texts[0], texts[3], "z " * 100]
    rows = [(k % 50, t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = substring_dedup.repeated_spans(df.repartition(3), window=window, period=period)
    got = Counter((r.doc_id, r.n_words - r.n_removed) for r in substring_dedup.digests(out).collect())
    kept = brute_spans(texts, window)
    assert got == Counter((r[0], len(k)) for r, k in zip(rows, kept, strict=True))
    cut = Counter((r.doc_id, r.text) for r in substring_dedup.without_repeats(out).collect())
    whole = Counter((r[0], r[1] if len(k) == len((r[1] or "").split()) else b" ".join(k).decode()) for r, k in zip(rows, kept, strict=True))
    assert cut == whole
    assert substring_dedup.repeated_spans(df.limit(0), window=window, period=period).count() == 0


@pytest.mark.parametrize("broadcast,bucket", [(0, 1 << 10), (8 << 20, 64 << 20)])
def test_repeated_windows_by_shuffle_and_broadcast(spark, tmp_path, monkeypatch, broadcast, bucket):
    """Both ways to bring spans to rows, and more buckets than shuffle partitions, from files whose size is known."""
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    rng = random.Random(3)
    passages = [[f"p{rng.randrange(50)}" for _ in range(40)] for _ in range(3)]
    texts = []
    for _ in range(80):
        w = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))]
        w[len(w) // 2 : len(w) // 2] = rng.choice([[], rng.choice(passages)])
        texts.append(" ".join(w))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert (substring_dedup._buckets(df) > 4) == (bucket < 1 << 20)
    got = {r.doc_id: r.text.encode().split() for r in substring_dedup.without_repeats(substring_dedup.repeated_spans(df)).collect()}
    assert got == dict(enumerate(brute_spans(texts, 35)))


def test_covers():
    for period in (1, 2, 3, 7, 13, 21):
        cover = substring_dedup.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(substring_dedup.difference_cover(21)) == 5


# --- near-duplicate vectors ---


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((k, (base + rng.normal(size=16) * 0.06).astype(np.float32).tolist(), label))
                k += 1
    big = rng.normal(size=16)
    rows += [(k + i, (big + rng.normal(size=16) * 0.02).astype(np.float32).tolist(), 1) for i in range(400)]
    k += 400
    rows += [(k, rows[0][1], 0), (k + 1, rows[0][1], 1), (k + 2, None, 0), (k + 3, [0.0] * 16, 0), (k + 4, [float("nan")] * 16, 0), (k + 5, [None] + [1.0] * 15, 0), (k + 6, [1.0] * 3, 0), (k + 7, [2.0] * 3, 0), (k + 8, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    good = [(i, np.array(v, float), x) for i, v, x in rows if i is not None and v and x is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = [(a, b) for j, (a, u, x) in enumerate(good) for b, w, y in good[:j] if x == y and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= 0.98]
    ids = [r[0] for r in rows if r[0] is not None]
    want, count = least(ids, links), Counter(x for p in links for x in p)
    got = embedding_dedup.near_duplicates(df.repartition(4)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {i: (count[i], want[i], want[i] == i) for i in ids}
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] and len(got) == len(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def linked_by_brute_force(x):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = []
    for k in range(0, len(x), 2000):
        a, b = np.nonzero(unit[k : k + 2000] @ unit.T >= 0.98)
        links += [(i + k, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i + k < j]
    return links


def check_vectors(spark, x, share=1.0):
    """Results of all vectors against brute force; at least a ``share`` of the links must be found."""
    links = linked_by_brute_force(x)
    want, count = least(range(len(x)), links), Counter(i for p in links for i in p)
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df.repartition(4)).collect()}
    if share == 1:
        assert got == {i: (count[i], want[i], want[i] == i) for i in range(len(x))}
    assert len(links) > 0 and sum(n for n, _, _ in got.values()) >= share * 2 * len(links)
    assert all(n <= count[i] and (c == i) == kept for i, (n, c, kept) in got.items())


def pairs_at(rng, x, cosine, n):
    """A partner at about ``cosine`` for each of the first ``n`` rows."""
    unit = x[:n] / np.linalg.norm(x[:n], axis=1, keepdims=True)
    across = rng.normal(size=unit.shape)
    across -= (across * unit).sum(1, keepdims=True) * unit
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    return cosine * unit + math.sqrt(1 - cosine**2) * across


@pytest.mark.parametrize("block", [2048, 24])
def test_near_vectors_of_a_dense_label(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    n = 3000 if block > 100 else 700
    centre = rng.normal(size=64) / 8
    dense = centre + rng.normal(size=(n, 64)) * 0.0238
    apart = np.repeat(rng.normal(size=(100, 64)), 5, axis=0) + rng.normal(size=(500, 64)) * 0.15
    check_vectors(spark, np.concatenate([dense, apart, 2 * dense[:20]]).astype(np.float32))


def test_near_vectors_of_a_narrow_cone(spark):
    """12,300 vectors of a mean cosine of 0.965 to each other, of which 300 pairs are at 0.983."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=256)
    centre /= np.linalg.norm(centre)
    x = centre + rng.normal(size=(12_000, 256)) * math.sqrt((1 / 0.965 - 1) / 256)
    x = np.concatenate([x, pairs_at(rng, x, 0.983, 300)]).astype(np.float32)
    unit = x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True)
    assert 0.96 < (unit @ unit.T).mean() < 0.97
    check_vectors(spark, x)


@pytest.mark.parametrize("n,window", [(6000, None), (3000, 16)])
def test_near_vectors_that_only_passes_compare(spark, monkeypatch, n, window):
    """Evenly spread vectors: no label is compared whole, and pairs just over the threshold meet in some pass."""
    monkeypatch.setattr(embedding_dedup, "WINDOW", window or embedding_dedup.WINDOW)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 48))
    x = np.concatenate([x, pairs_at(rng, x, 0.981, n // 4)]).astype(np.float32)
    kinds = spark.createDataFrame([(k, 1, v) for k, v in enumerate(x.tolist())], "node long, family long, vector array<float>")
    plan = embedding_dedup._planned(kinds, 0.98, embedding_dedup.WINDOW).select("passes", "size").distinct().collect()
    assert len(plan) == 1 and plan[0].size is None and 3 < plan[0].passes < 60
    check_vectors(spark, x, 0.998)


def test_passes_follow_the_bits_that_must_agree():
    made = [embedding_dedup.passes_for(bits, 0.98) for bits in (0, 1, 8, 16, 24)]
    assert made[0] == 1 and made == sorted(made) and made[-1] < 60
    a = np.array([0, 5, 1 << 61, 3], np.int64)
    b = np.array([0, 4, 0, 3 << 60], np.int64)
    assert embedding_dedup._shared_bits(a, b).tolist() == [62, 61, 0, 0]
