"""Byte-level BPE, longest-match counts and token files against the libraries and brute force."""

import base64
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from segtable.cluster import ship
from segtable.llm import byte_bpe, token_counts, token_files
from segtable.workspace import new_folder

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ALPHABET = "aAbßéÉÎ.,!?'’ś  \n\t\x1c ·×÷12½Ως日本ſK_#ﬁ🙂"
PIECES = ["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "don't.", "'S", "É́", "I'LL,", "hello", " world", "   ", "strawberry"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) if rng.random() < 0.85 else rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(RANKS, P.PATTERN)


def test_bpe_equals_tiktoken(bpe, tiktoken_encoding):
    many = [*texts(3000), None, ""]
    ids = bpe.encode(pa.array(many))
    assert ids.to_pylist() == [tiktoken_encoding.encode_ordinary(t or "") for t in many]
    assert bpe.decode(ids) == [(t or "").encode() for t in many]


def test_bpe_slices_long_texts(bpe, tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 40)
    text = " ".join(texts(60, 2))
    assert bpe.encode(pa.array([text, "x"])).to_pylist()[0] == tiktoken_encoding.encode_ordinary(text)


def test_bpe_offsets_and_split_characters(bpe):
    text = "né 🙂 日本"
    ids = bpe.encode(pa.array([text])).to_pylist()[0]
    starts = bpe.offsets(pa.array([text])).to_pylist()[0]
    assert len(starts) == len(ids) and starts[0] == 0 and starts == sorted(starts) and max(starts) < len(text)
    stream = byte_bpe.TextStream(bpe)
    assert "".join(stream.feed([i]) for i in ids) + stream.feed([], True) == text


def test_bpe_columns(spark):
    ship(spark)
    df = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, "y"), (1, "a b", 7, "x")], "doc_id long, text string, ids int, decoded string")
    out = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN, offsets=True), RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, r.ids, bytes(r.decoded), r.token_starts) for r in out] == [(1, "a b", [64, 275], b"a b", [0, 1]), (1, "a b", [64, 275], b"a b", [0, 1]), (2, None, [], b"", [])]
    assert byte_bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def brute_count(text, tokens):
    total = 0
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        word = word.lower() if word.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        symbols, at, n = [*word[:-1], word[-1] + token_counts.FINAL], 0, 0
        while at < len(symbols):
            end = next((e for e in range(len(symbols), at, -1) if tuple(symbols[at:e]) in tokens), None)
            if end is None:
                n, at = 1, len(symbols)
                break
            n, at = n + 1, end
        total += n
    return total


def test_counts_equal_brute_force():
    tokens = set(token_counts.word_end_vocabulary(WORDS))
    many = [*texts(400, 3), None, "", "x" * 5000, "Internationalization antidisestablishmentarianism"]
    got = token_counts.count_tokens(pa.array(many), token_counts.automaton(WORDS))
    assert got.tolist() == [brute_count(t, tokens) for t in many]


def test_counts_with_small_vocabularies():
    rng = random.Random(5)
    for _ in range(30):
        tokens = {tuple([*(rng.choice(b"ab") for _ in range(rng.randint(0, 3))), rng.choice(b"ab") + token_counts.FINAL * rng.randint(0, 1)]) for _ in range(8)}
        many = [" ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(3)) for _ in range(20)]
        got = token_counts.count_tokens(pa.array(many), token_counts.LongestMatch(tokens))

        def brute(text):
            total = 0
            for w in text.encode().split():
                s, at, n = [*w[:-1], w[-1] + token_counts.FINAL], 0, 0
                while at < len(s) and n >= 0:
                    e = next((e for e in range(len(s), at, -1) if tuple(s[at:e]) in tokens), None)
                    n, at = (n + 1, e) if e else (-1, at)
                total += 1 if n < 0 else n
            return total

        assert got.tolist() == [brute(t) for t in many]


def test_word_encoder_equals_library():
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    many = [*texts(3000, 4), None, ""]
    for at in range(0, len(many), 100):
        for t, got in zip(many[at : at + 100], ours.encode(many[at : at + 100]), strict=True):
            assert np.frombuffer(got, ours.kind).tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_token_files(spark):
    from tokenizers import Tokenizer

    ship(spark)
    library = Tokenizer.from_file(WORDS)
    rows = [(k, t, "s") for k, t in enumerate(texts(150, 6))] + [(None, "no id", "s"), (5, None, "s"), (900, "y " * 4000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    folder = new_folder(spark, "test-files")
    files = token_files.write(df.repartition(3), folder, WORDS, 1, length=16)
    got = token_files.read_documents(spark, folder, files).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t, _ in order:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    flat = []
    for f in files:
        file = token_files.TokenFile(folder, f["path"])
        for k in range(len(file)):
            ids, mask = file.sequence(k)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            flat += ids[mask].tolist()
    assert len(flat) == start
    empty = token_files.write(df.limit(0), new_folder(spark, "test-files"), WORDS, 1)
    assert empty == [] and token_files.read_documents(spark, folder, empty).count() == 0


