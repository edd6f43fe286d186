"""Exact removal of repeated word windows, found by difference-cover anchors.

A window is ``window`` consecutive words of one text. A window that also starts
anywhere else repeats, and every word it covers goes. Hashing each window of a large
corpus would move more bytes than the corpus has, so only anchors move: runs of
``window - period + 1`` words that begin at a place whose residue modulo ``period``
is in a difference cover. For any two places some shift below ``period`` takes both
into the cover, so two equal windows always share an aligned anchor. Anchors that
occur twice are extended: all windows around them are hashed in full and only
windows whose full hashes occur twice count.

Two exchanges by hash do the counting, in numpy, over packed arrays. A task first
settles the repeats it sees itself and sends one entry for each distinct hash, so a
passage that a third of all rows share arrives once for each task and not once for
each row. Spans return to their rows by a 64-bit key of id and text; hashes are 64
bits too, and a false repeat needs an anchor and a window to collide at once.

Cases: a null text has no words; texts shorter than a window keep all; rows repeated
whole are copies of one another and lose every window; ids may be null or repeat; an
empty table stays empty; other columns pass through, and one named ``spans`` is
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_columns import with_columns
from .scratch import bytes_of, save
from .words import Words, buffers, chunks, mix, windows

#: Words of a window, and the period of the cover. A period of 21 keeps 5 of 21 places.
WINDOW, PERIOD = 35, 21
#: Hashes a mapping task holds before it sends them.
HELD = 400_000
#: Input bytes for each bucket of an exchange, which a task holds at once; the most buckets; and a size that stands for an unknown one.
BUCKET_BYTES, MOST_BUCKETS, UNKNOWN_BYTES = 64 << 20, 1 << 20, 1 << 60
#: Spans written in at most so many bytes go to the rows by broadcast; more, by a join that shuffles both.
BROADCAST_BYTES = 8 << 20


def difference_cover(period: int) -> list[int]:
    """The first smallest set of residues whose differences give every residue."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            chosen = (0, *rest)
            if len({(a - b) % period for a in chosen for b in chosen}) == period:
                return list(chosen)
    return list(range(period))


# --- packed exchanges --------------------------------------------------------------

_SENT = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("key", pa.binary()), ("place", pa.binary()), ("known", pa.binary())])
_SENT_DDL = "bucket int, hash binary, key binary, place binary, known binary"


def _packed(bucket: np.ndarray, count: int, columns: list[np.ndarray | None]) -> pa.RecordBatch:
    """A row for each bucket that has entries; ``None`` columns stay empty."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(count + 1))
    full = np.flatnonzero(np.diff(edges))
    rows = [[x[order[edges[b] : edges[b + 1]]].tobytes() for b in full] if x is not None else [None] * len(full) for x in columns]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32())] + [pa.array(r, pa.binary()) for r in rows], schema=_SENT)


def _send(hash_: np.ndarray, key: np.ndarray, place: np.ndarray, count: int) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct hash, and the places of those that repeat here already."""
    if not len(hash_):
        return
    order = np.argsort(hash_, kind="stable")
    hash_, key, place = hash_[order], key[order], place[order]
    new = np.concatenate([[True], hash_[1:] != hash_[:-1]])
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1
    first = np.flatnonzero(new)
    yield _packed((hash_[first] >> np.uint64(20)) % np.uint64(count), count, [hash_[first], key[first], place[first], many])
    settled = many[group]
    yield _packed(mix(key[settled].view(np.uint64)) % np.uint64(count), count, [None, key[settled], place[settled], None])


def _bucket(batches: Iterator[pa.RecordBatch]) -> list[list[dict]]:
    """The rows of a partition, which is one bucket; no list where there are none."""
    held = [row for batch in batches for row in batch.to_pylist()]
    return [held] if held else []


def _joined(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def _repeats(count: int):
    """Places of hashes that occur twice, sent on to the buckets of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bucket(batches):
            settled, sent = [r for r in rows if r["hash"] is None], [r for r in rows if r["hash"] is not None]
            key, place = [_joined(settled, "key", np.int64)], [_joined(settled, "place", np.int32)]
            if sent:
                hash_, known = _joined(sent, "hash", np.uint64), _joined(sent, "known", bool)
                order = np.argsort(hash_, kind="stable")
                new = np.concatenate([[True], hash_[order][1:] != hash_[order][:-1]])
                group = np.cumsum(new) - 1
                twice = (np.bincount(group) > 1)[group] & ~known[order]  # known ones have their places sent already
                key.append(_joined(sent, "key", np.int64)[order[twice]])
                place.append(_joined(sent, "place", np.int32)[order[twice]])
            k, p = np.concatenate(key), np.concatenate(place)
            if len(k):
                yield _packed(mix(k.view(np.uint64)) % np.uint64(count), count, [None, k, p, None])

    return run


def _spans(before: int, after: int):
    """For each key the union of [place - before, place + after] of its places, as starts and ends in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bucket(batches):
            key, place = _joined(rows, "key", np.int64), _joined(rows, "place", np.int32).astype(np.int64)
            order = np.lexsort((place, key))
            key, place = key[order], place[order]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            start = fresh | np.concatenate([[True], place[1:] - place[:-1] > before + after + 1])
            at = np.flatnonzero(start)
            last = np.concatenate([at[1:], [len(key)]]) - 1
            flat = np.stack([np.maximum(place[at] - before, 0), place[last] + after + 1], 1).astype(np.int32).ravel()
            owner = np.flatnonzero(fresh[at])
            off = np.concatenate([owner, [len(at)]]) * 2
            yield pa.RecordBatch.from_arrays([pa.array(key[at[owner]]), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))], names=["__key", "spans"])

    return run


def _buckets(df: DataFrame) -> int:
    """Buckets of an exchange: the session's shuffle partitions, or more where the input's size is known and they would be large."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts, min(size // BUCKET_BYTES, MOST_BUCKETS)) if size < UNKNOWN_BYTES else parts


def _exchange(sent: DataFrame, before: int, after: int, parts: int, name: str) -> tuple[DataFrame, str]:
    found = sent.repartitionById(parts, "bucket").mapInArrow(_repeats(parts), _SENT_DDL)
    return save(found.repartitionById(parts, "bucket").mapInArrow(_spans(before, after), "__key long, spans array<int>"), name)


# --- the two scans -----------------------------------------------------------------


def _map(choose, count: int):
    """Hashes that ``choose`` takes from each chunk of (__key, text, spans...), sent when enough are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            off, data = buffers(batch.column(1))
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(off):
                words = Words(off, data, a, b)
                hash_, at = choose(words, batch.slice(a, b - a))
                row = np.searchsorted(words.first, at, "right") - 1
                held.append((hash_, key[a:b][row], (at - words.first[row]).astype(np.int32)))
                size += len(hash_)
                if size >= HELD:
                    yield from _send(*map(np.concatenate, zip(*held, strict=True)), count)
                    held, size = [], 0
        if held:
            yield from _send(*map(np.concatenate, zip(*held, strict=True)), count)

    return run


def _starts(words: Words, length: int) -> np.ndarray:
    """Which words begin a run of ``length`` words of one text."""
    n = len(words.hash)
    end = np.repeat(words.first[1:], np.diff(words.first))
    return np.arange(n) + length <= end


def _anchors(window: int, period: int):
    length = window - period + 1
    cover = np.zeros(period, bool)
    cover[difference_cover(period)] = True

    def choose(words: Words, _: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(words.first)
        within = np.arange(len(words.hash)) - np.repeat(words.first[:-1], size)
        at = np.flatnonzero(_starts(words, length) & cover[within % period] & np.repeat(size >= window, size))
        return windows(words.hash, length, 1)[at] if len(at) else np.zeros(0, np.uint64), at

    return choose


def _whole_windows(window: int):
    def choose(words: Words, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        spans = batch.column(2)
        flat = spans.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        row = np.repeat(np.arange(len(spans)), np.diff(np.asarray(spans.offsets)) // 2)
        step = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(step, np.minimum(words.first[row] + flat[:, 0], words.first[row + 1]), 1)
        np.add.at(step, np.minimum(words.first[row] + flat[:, 1], words.first[row + 1]), -1)
        at = np.flatnonzero((np.cumsum(step)[:-1] > 0) & _starts(words, window))
        return windows(words.hash, window, 2)[at] if len(at) else np.zeros(0, np.uint64), at

    return choose


def _joined_spans(keyed: DataFrame, spans: DataFrame, path: str, how: str) -> DataFrame:
    small = bytes_of(keyed.sparkSession, path) <= BROADCAST_BYTES
    return keyed.join(F.broadcast(spans) if small else spans, "__key", how)


def repeated_spans(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """``df`` with ``spans`` (array<int>): first and past-the-last word of each repeated run in turn; null where none repeats."""
    count = _buckets(df.select(text))
    keyed = df.drop("spans").withColumn("__key", F.xxhash64(F.col(id), F.col(text)))
    narrow = keyed.select("__key", F.col(text).alias("__text"))
    anchors = narrow.mapInArrow(_map(_anchors(window, period), count), _SENT_DDL)
    near, near_path = _exchange(anchors, period - 1, 0, count, "anchor-spans")
    around = _joined_spans(narrow, near, near_path, "inner").select("__key", "__text", "spans")
    full, full_path = _exchange(around.mapInArrow(_map(_whole_windows(window), count), _SENT_DDL), 0, window - 1, count, "window-spans")
    return _joined_spans(keyed, full, full_path, "left").drop("__key")


# --- what follows from the spans ----------------------------------------------------


def kept_words(text: str | None, spans: list[int] | None) -> tuple[int, list[bytes]]:
    """How many words a text has, and those outside its spans."""
    words = (text or "").encode().split()
    n = len(words)
    for a, b in reversed(list(zip(spans[::2], spans[1::2], strict=True)) if spans else []):
        del words[a:b]
    return n, words


def digests(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of :func:`repeated_spans`: id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                total, kept = kept_words(t.as_py(), s.as_py())
                n.append(total)
                removed.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=[id, "n_words", "n_removed", "kept_sha256"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, text, "spans").mapInArrow(run, f"`{id}` {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the spans' words cut from ``text``; texts without spans stay as they are, to the byte."""

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, spans = (batch.column(batch.schema.get_field_index(c)) for c in (text, "spans"))
        made = [t.as_py() if not s.is_valid else b" ".join(kept_words(t.as_py(), s.as_py())[1]).decode() for t, s in zip(texts, spans, strict=True)]
        return {text: pa.array(made, pa.string())}

    names = [c for c in df.columns if c != "spans"]
    return with_columns(df, f"`{text}` string", cut, without=("spans",)).select(*[F.col(f"`{c}`") for c in names])
