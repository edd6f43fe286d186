"""The registered queries without SQL, run over small tables and held against plain loops and the tokenizer libraries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from segtable.cluster import ship
from segtable.llm import mixing, queries, token_counts


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def documents():
    """Texts of many kinds under ids that are not in order: (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["th", "an", "er", "ou", "é", "ß", "語", "x1", "'s"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += [None, "", " \n\t ", "A", "Same text. Twice.", "Same text. Twice.", "日本語" * 400, "z" * 3000, "Line.\n" * 300, "👩‍👩‍👧 \x00   é", "12345 3.14 DON'T I'll"]
    ids = rng.sample(range(1000), len(texts))
    return [(i, t, rng.choice(["en", "de", "fr", None]), f"src{rng.randrange(6)}" if rng.random() < 0.95 else None, len(t or "")) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder), rows


def by_id(rows):
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1_equals_tiktoken(spark, sf):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("check", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(queries.op1_byte_bpe(spark, sf[0]).collect())
    for i, text, *_ in sf[1]:
        ids = encoding.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def greedy(word: bytes, tokens: set, longest: int) -> int:
    """Tokens of a word by plain longest match; 1 where none fits."""
    symbols, at, n = [*word[:-1], word[-1] + token_counts.FINAL], 0, 0
    while at < len(symbols):
        size = next((s for s in range(min(longest, len(symbols) - at), 0, -1) if tuple(symbols[at : at + s]) in tokens), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_op2_equals_longest_match(spark, sf):
    tokens = set(token_counts.word_end_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    longest = max(map(len, tokens))
    got = by_id(queries.op2_token_counts(spark, sf[0]).collect())
    for i, text, *_ in sf[1]:
        lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        assert got[i].n_tokens == sum(greedy(w, tokens, longest) for w in re.findall(rb"[^\x20\x09-\x0D]+", lowered)), i


@pytest.mark.parametrize("seed", range(12))
def test_long_words_count_like_short_steps(seed):
    rng = random.Random(seed)
    letters = b"abcxyz"[: rng.randint(2, 6)]
    tokens = {tuple(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 25))} | {(x,) for x in letters if rng.random() < 0.9}
    tokens |= {t[:-1] + (t[-1] + token_counts.FINAL,) for t in list(tokens) if rng.random() < 0.7}
    matcher = token_counts.LongestMatch(tokens)
    word = np.frombuffer(bytes(rng.choice(letters) for _ in range(rng.randint(257, 1500))), np.uint8)
    start, end = np.array([0, 3, 0]), np.array([len(word), len(word) - 1, 200])
    assert matcher.counts(word, start, end).tolist() == [greedy(word[a:b].tobytes(), tokens, 5) for a, b in zip(start, end, strict=True)]


def test_op9_equals_tokenizers(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = by_id(queries.op9_token_files(spark, sf[0]).collect()), 0
    for i, text, *_ in sorted(sf[1], key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)


def test_op6_equals_signs_summed_one_by_one(spark, sf):
    """Edited texts, and likeness from the hashes of each paragraph, bit by bit."""
    got = by_id(queries.op6_fingerprints(spark, sf[0]).collect())
    ordered = sorted(((i, t or "") for i, t, *_ in sf[1]), reverse=True)
    parts = lambda t: [p for p in re.split(r"\n+|(?<=[.!?])[ \t]+", t) if p]
    edited = {}
    for k, (i, t) in enumerate(ordered):
        n = len(t) // 3
        edited[i] = t[: len(t) - n] + ordered[(k + 1) % len(ordered)][1][:n]
    every = sorted({p for t in [*edited.values(), *(t for _, t in ordered)] for p in parts(t)})
    hashed = spark.createDataFrame([(p,) for p in every], "p string").select("p", F.xxhash64(F.lit(17), "p").alias("a"), F.xxhash64(F.lit(71), "p").alias("b")).collect()
    signs = {r.p: np.array([2 * (h >> j & 1) - 1 for h in (r.a, r.b) for j in range(60)], float) for r in hashed}
    total = lambda t: sum((signs[p] for p in parts(t)), np.zeros(120))

    def likeness(s, t):
        x, y = total(s), total(t)
        if sorted(parts(s)) == sorted(parts(t)):
            return 1.0
        return min(1.0, max(0.0, 2 * (x @ y) / (x @ x + y @ y))) if (x @ x + y @ y) else 0.0

    prints = defaultdict(set)
    for k, (i, t) in enumerate(ordered):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest(), i
        assert r.near_edited == pytest.approx(likeness(t, edited[i])) and r.near_next == pytest.approx(likeness(t, ordered[(k + 1) % len(ordered)][1])), i
        prints[tuple(sorted(parts(t)))].add(r.fingerprint)
        prints[tuple(sorted(parts(edited[i])))].add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)


def water(amount: float, nodes: dict, path: tuple, weights: dict, most: int) -> dict:
    """Shares of leaves by halving the level at which weights are filled, in place of any order of children."""
    inside = {p[: len(path) + 1] for p in nodes if p[: len(path)] == path}
    if path in nodes:
        return {path: amount}
    caps = {c: most * sum(n for p, n in nodes.items() if p[: len(c)] == c) for c in inside}
    amount = min(amount, sum(caps.values()))
    low, high = 0.0, max(caps.values(), default=0) / min(weights.get(c, 1.0) for c in inside) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(caps[c], level * weights.get(c, 1.0)) for c in inside) < amount else (low, level)
    out = {}
    for c in inside:
        out |= water(min(caps[c], high * weights.get(c, 1.0)), nodes, c, weights, most)
    return out


@pytest.mark.parametrize("leaves", [100_000, 3])
def test_op7_fills_the_tree_like_water(spark, sf, monkeypatch, leaves):
    monkeypatch.setattr(mixing, "MAX_LEAVES", leaves)
    got = by_id(queries.op7_mixing(spark, sf[0]).collect())
    weights = {(f"domain{k}",): w for k, w in enumerate((0.4, 0.3, 0.2, 0.1))}
    weights |= {(f"domain{k}", lang): w for k in range(4) for lang, w in {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}.items()}
    size, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, text, lang, source, _ in sf[1]:
        leaf = (f"domain{zlib.crc32(source.encode()) % 4}" if source else None, lang, source)
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        size[leaf] += n
        taken[leaf] += n * got[i].copies
        longest[leaf] = max(longest[leaf], n)
        assert 0 <= got[i].copies <= 4
    want = water(int(0.8 * sum(size.values())), size, (), weights, 4)
    for leaf, n in size.items():
        assert abs(taken[leaf] - want[leaf]) <= longest[leaf] / 2 + 3, leaf  # the prefix whose total is nearest, and rounding at three levels
