"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file (base64 bytes and rank per line) becomes a ``tokenizers`` model: bytes
map to printable characters, and each token's merge is recovered by running the
lower ranks on its own bytes. A piece that is itself a token is taken whole
(``ignore_merges``), as rank encoders do. Decoding reverses the byte table, so the
bytes return exactly even where a token ends inside a character.

Cases: a null text is an empty one; empty texts give no ids; repeated rows give
repeated results; an empty table gives an empty one; a column of the input named
as an output is replaced; texts longer than ``SLICE_CHARS`` are encoded in slices
cut where the pattern always ends a piece, with the same ids.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_columns import strings, with_columns

#: Characters handed to the library at once: bounds the memory its encodings take.
SLICE_CHARS = 1 << 18
#: A single space between other characters starts a piece of the pattern, whatever surrounds it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that lower ranks leave of ``token``; None if they leave more, so that no merge makes it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
        if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """Encoder and decoder of one rank file; build through :func:`load` to share it in a worker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        char = byte_characters()
        shown = {t: "".join(char[b] for b in t) for t in ranks}
        ordered = sorted((r, t) for t, r in ranks.items() if len(t) > 1)
        merges = [m for r, t in ordered if (m := merge_of(t, r, ranks))]
        model = models.BPE({shown[t]: r for t, r in ranks.items()}, [(shown[a], shown[b]) for a, b in merges], ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.bytes[r] = t

    def _slices(self, texts: list[str]):
        """Lists of (row, character offset, slice), each list about SLICE_CHARS long."""
        held, size = [], 0
        for row, text in enumerate(texts):
            at = 0
            while True:
                end = len(text)
                if end - at > SLICE_CHARS and (cut := _CUT.search(text, at + SLICE_CHARS)):
                    end = cut.start()
                held.append((row, at, text[at:end]))
                size += end - at
                if size >= SLICE_CHARS:
                    yield held
                    held, size = [], 0
                at = end
                if at >= len(text):
                    break
        if held:
            yield held

    def encode(self, column: pa.Array) -> pa.ListArray:
        """Token ids of each text."""
        counts, flat = np.zeros(len(column), np.int64), []
        for held in self._slices(strings(column)):
            for (row, _, _), e in zip(held, self.tokenizer.encode_batch_fast([s for _, _, s in held], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                counts[row] += len(ids)
                flat.append(ids)
        return _lists(counts, np.concatenate(flat) if flat else np.zeros(0, np.int32))

    def offsets(self, column: pa.Array) -> pa.ListArray:
        """The character at which each token begins; tokens that share a character repeat its place."""
        counts, flat = np.zeros(len(column), np.int64), []
        for held in self._slices(strings(column)):
            for (row, at, _), e in zip(held, self.tokenizer.encode_batch([s for _, _, s in held], add_special_tokens=False), strict=True):
                begins = np.fromiter((o[0] + at for o in e.offsets), np.int32, len(e.offsets))
                counts[row] += len(begins)
                flat.append(begins)
        return _lists(counts, np.concatenate(flat) if flat else np.zeros(0, np.int32))

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids; a null list decodes to nothing."""
        table = self.bytes.__getitem__
        flat, off = _flat(ids)
        return [b"".join(map(table, flat[a:b])) for a, b in zip(off, off[1:], strict=False)]


class TextStream:
    """Text from consecutive pieces of one token stream: a character split between pieces waits for its end."""

    def __init__(self, bpe: ByteBpe):
        self._bytes = bpe.bytes
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self._utf8.decode(b"".join(self._bytes[i] for i in ids), last)


def _lists(counts: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))


def _flat(ids: pa.ListArray) -> tuple[list[int], list[int]]:
    if ids.null_count:
        ids = ids.fill_null([])
    return ids.flatten().to_numpy(zero_copy_only=False).tolist(), (np.asarray(ids.offsets) - ids.offsets[0].as_py()).tolist()


@lru_cache(4)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array<int>) of the column ``text`` and, if asked, ``token_starts`` in characters."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe, column = load(path, pattern), batch.column(batch.schema.get_field_index(text))
        return {"ids": bpe.encode(column)} | ({"token_starts": bpe.offsets(column)} if offsets else {})

    return with_columns(df, "ids array<int>" + ", token_starts array<int>" * offsets, run)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of the column ``ids``."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"decoded": pa.array(load(path, pattern).decode(batch.column(batch.schema.get_field_index(ids))), pa.binary())}

    return with_columns(df, "decoded binary", run)


def round_trip(df: DataFrame, path: str, pattern: str, digest, fields: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass over each batch; ``digest(ids, decoded, text)`` makes the columns ``fields`` of them.

    ``ids`` is a list of ids, ``decoded`` the bytes they decode to and ``text`` the
    input, for one row. The text column goes no further than the worker.
    """
    kinds = dict(x.split(" ", 1) for x in fields.split(", "))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe, column = load(path, pattern), batch.column(batch.schema.get_field_index(text))
        rows = []
        for at in range(0, len(column), 64):
            part = column.slice(at, 64)
            ids = bpe.encode(part)
            flat, off = _flat(ids)
            rows += [digest(flat[a:b], d, t) for a, b, d, t in zip(off, off[1:], bpe.decode(ids), strings(part), strict=False)]
        return {n: pa.array([r[k] for r in rows], _ARROW[kind]) for k, (n, kind) in enumerate(kinds.items())}

    return with_columns(df, fields, run, without=(text,))


def ids_and_check(ids: list[int], decoded: bytes, text: str) -> tuple[int, list[int], bool]:
    """For :func:`round_trip`: how many ids, the ids, and whether they decode to the text."""
    return len(ids), ids, decoded == text.encode()


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
