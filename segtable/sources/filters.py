"""Membership filters of a segment's column: values for = and IN, byte trigrams for LIKE.

Both are Bloom filters over 64-bit hashes, kept as an array of longs in the segment
index. A probe says "no" only if the value is surely absent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash functions of a probe, taken from the halves of one hash.
PROBES = 6
#: A trigram filter that would be larger than this share of the column's bytes is left out.
TRIGRAM_SHARE = 1.0


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.concatenate([(low + np.uint64(k) * high) % np.uint64(bits) for k in range(PROBES)])


def built(hashes: np.ndarray, bits_per_value: int) -> np.ndarray:
    """Words of the filter of distinct hashes; its size is a multiple of 64 bits."""
    bits = max(1, -(-len(hashes) * bits_per_value // 64)) * 64
    words = np.zeros(bits // 64, np.uint64)
    at = positions(hashes, bits)
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words.view(np.int64)


def trigram_hash(code: np.ndarray) -> np.ndarray:
    """A fixed mixing of a trigram's 24 bits."""
    x = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return np.unique((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) if len(b) >= 3 else np.zeros(0, np.uint32)


def column_trigrams(column: pa.Array) -> np.ndarray:
    """Distinct trigrams within the values of a column, none across two of them."""
    column = column.drop_null()
    if not len(column):
        return np.zeros(0, np.uint32)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[off[0] : off[-1]].astype(np.uint32) if data is not None else np.zeros(0, np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    end = np.repeat(off[1:] - off[0], np.diff(off))
    inside = np.arange(len(b)) + 3 <= end
    return np.unique(((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[inside[: len(b) - 2]])


def segment_filters(rows: DataFrame, bloom: list[str], trigram: list[str], bits: int) -> DataFrame:
    """A row for each ``segment`` of ``rows``: ``bloom_<column>`` and ``tri_<column>``. A segment's rows are bounded."""
    hashed = rows.select("segment", *[F.xxhash64(_folded(rows, c)).alias(f"bloom_{c}") for c in bloom], *[F.col(c).isNull().alias(f"null_{c}") for c in bloom], *[F.col(c).cast("binary").alias(f"tri_{c}") for c in trigram])
    fields = ["segment string", *[f"bloom_{c} array<long>" for c in bloom], *[f"tri_{c} array<long>" for c in trigram]]

    def run(table: pa.Table) -> pa.Table:
        out = {"segment": [table["segment"][0].as_py()]}
        for c in bloom:
            present = ~table[f"null_{c}"].to_numpy()
            out[f"bloom_{c}"] = [built(np.unique(table[f"bloom_{c}"].to_numpy()[present].view(np.uint64)), bits).tolist()]
        for c in trigram:
            chunks = table[f"tri_{c}"].chunks
            found = np.unique(np.concatenate([column_trigrams(x) for x in chunks])) if chunks else np.zeros(0, np.uint32)
            words = built(trigram_hash(found), bits)
            size = sum(x.nbytes for x in chunks)
            out[f"tri_{c}"] = [words.tolist() if words.nbytes <= TRIGRAM_SHARE * max(size, 64) else None]
        names = [f.split()[0] for f in fields]
        kinds = [pa.string(), *[pa.list_(pa.int64())] * (len(fields) - 1)]
        return pa.table([pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return hashed.groupBy("segment").applyInArrow(run, ", ".join(fields))


def _folded(df: DataFrame, c: str) -> Column:
    """-0.0 and 0.0 are one value."""
    return F.col(c) + F.lit(0.0).cast(df.schema[c].dataType) if df.schema[c].dataType.typeName() in ("float", "double") else F.col(c)


def may_hold(words: Column, hashed: Column) -> Column:
    """True unless the filter rules the hash (a long) out; a missing filter rules nothing out."""
    bits = (F.size(words) * 64).cast("long")
    low, high = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32).bitwiseOR(F.lit(1).cast("long"))
    found = F.lit(True)
    for k in range(PROBES):
        at = F.pmod(low + k * high, bits)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        found = found & (F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(bit) != 0)
    return words.isNull() | found


def may_hold_text(words: Column, part: bytes) -> Column:
    """True unless the filter rules out a trigram of ``part``; shorter parts rule nothing out."""
    found = F.lit(True)
    for h in trigram_hash(trigrams(part)).view(np.int64).tolist():
        found = found & may_hold(words, F.lit(h).cast("long"))
    return found
