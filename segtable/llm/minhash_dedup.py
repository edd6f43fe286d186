"""Near-duplicate documents by one-permutation MinHash, confirmed on full shingle sets.

One hash of each shingle serves all bins of a sketch: its high bits name the bin, the
least rest in a bin is kept, and an empty bin takes the value of the first full one
in a probing order of its own (optimal densification). Bands of bins make buckets.

Documents with equal sets are one class first, so groups of exact copies of any size
cost one member. In a bucket only star edges to its hub are candidates, the member
that shares most buckets overall; a bucket of m classes makes m - 1 of them. What the
stars leave is done exactly: buckets that still hold several components compare
their classes across components, small ones directly, larger ones (over
``SMALL_BUCKET``) by a prefix-filter join over their classes' full sets, where two
sets can reach the threshold only if they share one of their rarest shingles.

All links rest on full sets: 100 * intersection >= 75 * union. A pair at the
threshold that shares no bucket is missed with a chance of about 5 in a million
(32 bands of 4), and the confirmed set is exact otherwise.

Cases: a null or empty text, or one without words, has no shingles and links with
nothing; fewer words than a shingle make one shingle of them all; rows with the same
id are one document, which links by any of its texts, and each row shows the size of
its own set; a row whose id is null links with nothing; an empty table stays empty;
other columns do not matter.

A key that holds more than a thousandth of the rows of a join (exact copies of one
text, a bucket or a hub of thousands) is dealt into pieces, see ``join_hot``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import bytes_of, hot_keys, join_hot, save
from .words import Words, buffers, chunks, mix, windows

SHINGLE, BANDS, ROWS = 5, 32, 4
#: Shared / all, in hundredths.
THRESHOLD = 75
#: Buckets of up to so many classes compare all of them across components; larger ones use the prefix join.
SMALL_BUCKET = 8
#: Pairs written in at most so many bytes are broadcast to the texts; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and where each row's begin."""
    n = np.diff(words.first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    at = words.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    hash_ = np.empty(len(row), np.uint64)
    for k in range(1, size + 1):
        of = (n[row] == k) if k < size else (n[row] >= size)
        if of.any():
            hash_[of] = windows(words.hash, k, k)[at[of]]
    order = np.lexsort((hash_, row))
    hash_, row = hash_[order], row[order]
    new = np.concatenate([[True], (hash_[1:] != hash_[:-1]) | (row[1:] != row[:-1])])
    return hash_[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def sketches(items: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation sketches of the rows that have items; ``bins`` is a power of two."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    size = np.diff(first)
    full_rows = np.flatnonzero(size)
    row = np.repeat(np.arange(len(full_rows)), size[full_rows])
    cell = row * bins + (items >> shift).astype(np.int64)
    lead = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    out = np.zeros(len(full_rows) * bins, np.uint64)
    full = np.zeros(len(full_rows) * bins, bool)
    out[cell[lead]] = items[lead]  # items ascend, so the first of a bin is its least
    full[cell[lead]] = True
    todo, turn = np.flatnonzero(~full), 0
    while len(todo):
        turn += 1
        own = (todo % bins).astype(np.uint64)
        probe = todo - todo % bins + (mix(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(bins)).astype(np.int64)
        hit = full[probe]
        out[todo[hit]] = out[probe[hit]]
        todo = todo[~hit]
    return out.reshape(-1, bins)


def _segment_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def sketch(df: DataFrame, id: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, a 128-bit key of the set, and band hashes (null without shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = buffers(batch.column(1))
            for a, b in chunks(off):
                items, first = shingle_sets(Words(off, data, a, b, lower=True))
                size = np.diff(first)
                made = sketches(items, first, bands * rows).reshape(-1, bands, rows)
                hash_ = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for k in range(rows):
                    hash_ = mix(hash_ ^ made[:, :, k])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((size > 0) * bands)]), pa.int32()), pa.array(np.ascontiguousarray(hash_).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(_segment_sums(mix(items ^ np.uint64(1)), first)), pa.array(_segment_sums(mix(items ^ np.uint64(2)), first)), listed,
                ], names=["id", "n", "k1", "k2", "bands"])

    return df.select(F.col(id).cast("long"), F.col(text)).mapInArrow(run, "id long, n long, k1 long, k2 long, bands array<long>")


def _sets(df: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` (longs) of ``df`` and ``items``, the shingle set of its column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = buffers(batch.column(len(kept)))
            for a, b in chunks(off):
                items, first = shingle_sets(Words(off, data, a, b, lower=True))
                listed = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(len(kept))] + [listed], names=[*kept, "items"])

    return df.select(*kept, "text").mapInArrow(run, ", ".join(f"{k} long" for k in kept) + ", items array<long>")


def _texts(docs: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """Texts of the rows of ``ids`` (id and more), by a broadcast of ``ids`` where its written size allows."""
    small = bytes_of(docs.sparkSession, path) <= BROADCAST_BYTES
    return docs.join(F.broadcast(ids) if small else ids, "id")


def _similar(one: tuple[str, str], other: tuple[str, str], threshold: int):
    """Sizes that allow the threshold: the smallest and the greatest set of two documents."""
    return (F.col(one[1]) * 100 >= F.col(other[0]) * threshold) & (F.col(other[1]) * 100 >= F.col(one[0]) * threshold)


def _each_text_once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with every text of the ids in ``repeated`` once for each of them."""
    if repeated.isEmpty():
        return docs
    several = docs.join(repeated, "id", "left_semi").groupBy("id", F.xxhash64("text").alias("hash")).agg(F.min("text").alias("text"))
    several, _ = save(several.select("id", "text"), "minhash-repeated")
    return docs.join(repeated, "id", "left_anti").unionByName(several)


def confirmed(docs: DataFrame, pairs: DataFrame, threshold: int, name: str) -> DataFrame:
    """The written pairs (hub, member) whose full sets reach the threshold, as links (a, b).

    A member's set moves once for each star it is in, to its hub; the members of a
    hub of very many are dealt into pieces.
    """
    pairs, path = save(pairs, name)
    hot = hot_keys(pairs.groupBy("hub").count(), ["hub"])
    hubs, hubs_path = save(pairs.select(F.col("hub").alias("id")).distinct(), name + "-hubs")
    members = _sets(_texts(docs, pairs.select("hub", F.col("member").alias("id")), path), ["hub", "id"]).select("hub", "id", F.col("items").alias("theirs"))
    own = _sets(_texts(docs, hubs, hubs_path), ["id"]).select(F.col("id").alias("hub"), F.col("items").alias("own"))
    both = join_hot(members, own, ["hub"], hot)
    shared = F.size(F.array_intersect("own", "theirs"))
    linked = both.where(shared * 100 >= (F.size("own") + F.size("theirs") - shared) * threshold)
    links, _ = save(linked.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), name + "-links")
    return links


def _prefix_pairs(docs: DataFrame, rest: DataFrame, threshold: int) -> DataFrame:
    """Pairs across components that may reach the threshold, complete for the classes of ``rest`` (id, component)."""
    rest, path = save(rest, "minhash-rest")
    sets = _sets(_texts(docs, rest, path), ["id", "component"])
    items = sets.select("id", "component", F.size("items").alias("n"), F.xxhash64("items").alias("set"), F.explode("items").alias("item"))
    items, _ = save(items, "minhash-rest-items")
    often = items.groupBy("item").agg(F.count("*").alias("often"), (F.min("component") != F.max("component")).alias("across"))
    order = Window.partitionBy("id", "set").orderBy("often", "item")
    placed = join_hot(items, often, ["item"], hot_keys(often, ["item"], "often")).withColumn("place", F.row_number().over(order) - 1)
    need = F.ceil(F.col("n") * threshold / 100)  # shared items that a partner must have at least
    prefix = placed.where((F.col("place") <= F.col("n") - need) & F.col("across"))
    x, y = (prefix.select("item", *[F.col(c).alias(f"{c}{k}") for c in ("id", "component", "n", "place")]) for k in (1, 2))
    most = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))  # items from here on, this one included
    able = _similar(("n1", "n1"), ("n2", "n2"), threshold) & (most * (100 + threshold) >= (F.col("n1") + F.col("n2")) * threshold)
    met = join_hot(x, y, ["item"], None).where((F.col("id1") < F.col("id2")) & (F.col("component1") != F.col("component2")) & able)
    return met.select(F.col("id1").alias("hub"), F.col("id2").alias("member")).distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """A row for each row of ``df``: id, n_shingles, component_id (least id reachable by links), kept."""
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sketched, _ = save(sketch(df, id, text), "minhash-sketch")
    able, rest = sketched.where("n > 0 and id is not null"), sketched.where("not (n > 0 and id is not null)")
    classes, _ = save(able.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.count("*").alias("rows")), "minhash-classes")
    copies = hot_keys(classes, ["k1", "k2"], "rows")
    classed = join_hot(able, classes.select("k1", "k2", "class"), ["k1", "k2"], copies, "left")
    # Read several times below, so written; bands are needed of a class's own document only.
    classed, _ = save(classed.select("id", "n", "k1", "k2", "class", F.when(F.col("id") == F.col("class"), F.col("bands")).alias("bands")), "minhash-classed")

    # Rows that share an id are one document: its classes are linked, and rows of it without words belong to it.
    by_id = classed.select("id", "class").unionByName(rest.where("id is not null").select("id", F.lit(None).cast("long").alias("class")))
    by_id = by_id.groupBy("id").agg(F.count("*").alias("rows"), F.min("class").alias("least"), F.max("class").alias("most")).where("rows > 1")
    repeated, _ = save(by_id, "minhash-repeated-ids")
    docs = _each_text_once(docs, repeated.select("id"))
    several = classed.select("id", "class").join(repeated.where("least < most").select("id", "least"), "id").where("class > least")
    several, _ = save(several.select(F.col("least").alias("a"), F.col("class").alias("b")).distinct(), "minhash-same-id")

    # A row for each text of a class's document: one id may have several, and each has bands of its own.
    lone = classed.where("id = class").groupBy("id", "k1", "k2").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    if repeated.isEmpty():
        lone = lone.withColumns({"low": F.col("n"), "high": F.col("n")})
    else:
        lone = lone.join(lone.groupBy("id").agg(F.min("n").alias("low"), F.max("n").alias("high")), "id")
    buckets, _ = save(lone.select("id", "low", "high", F.explode("bands").alias("bucket")), "minhash-bands")
    counts, _ = save(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "minhash-sizes")
    large = hot_keys(counts, ["bucket"], "size")
    shared, _ = save(join_hot(buckets, counts, ["bucket"], large), "minhash-buckets")

    score = shared.groupBy("id").agg(F.sum("size").alias("score"))
    hubs = shared.join(score, "id").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("id")).alias("least"), "low", "high")).alias("top"))
    hubs = hubs.select("bucket", (-F.col("top.least")).alias("hub"), F.col("top.low").alias("hub_low"), F.col("top.high").alias("hub_high"))
    stars = join_hot(shared, hubs, ["bucket"], large).where((F.col("id") != F.col("hub")) & _similar(("low", "high"), ("hub_low", "hub_high"), threshold))
    links = confirmed(docs, stars.select("hub", F.col("id").alias("member")).distinct(), threshold, "minhash-stars")
    found = connected_components(links.unionByName(several))

    placed = shared.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("bucket")
    left, _ = save(join_hot(placed, mixed, ["bucket"], large), "minhash-left")
    few = left.where(F.col("size") <= SMALL_BUCKET)
    x, y = (few.select("bucket", *[F.col(c).alias(f"{c}{k}") for c in ("id", "low", "high", "component")]) for k in (1, 2))
    direct = x.join(y, "bucket").where((F.col("id1") < F.col("id2")) & (F.col("component1") != F.col("component2")) & _similar(("low1", "high1"), ("low2", "high2"), threshold))
    direct = direct.select(F.col("id1").alias("hub"), F.col("id2").alias("member")).distinct()
    larger = _prefix_pairs(docs, left.where(F.col("size") > SMALL_BUCKET).select("id", "component").distinct(), threshold)
    more = confirmed(docs, direct.unionByName(larger).distinct(), threshold, "minhash-more")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more).unionByName(several))

    empty = rest.select("id", "n").withColumn("class", F.lit(None).cast("long"))
    owned = repeated.where("least is not null").select("id", "least")
    if not owned.isEmpty():  # rows without words of a document that has words elsewhere
        known = empty.where("id is not null")
        known = join_hot(known.select("id", "n"), owned.withColumnRenamed("least", "class"), ["id"], hot_keys(known.groupBy("id").count(), ["id"]), "left")
        empty = known.unionByName(empty.where("id is null"))
    whole = classed.select("id", "n", "class").unionByName(empty.where("class is not null"))
    by_class = hot_keys(classes.groupBy("class").agg(F.sum("rows").alias("rows")), ["class"], "rows")
    out = join_hot(whole, found.select(F.col("id").alias("class"), "component"), ["class"], by_class, "left")
    out = out.select("id", "n", F.coalesce("component", "class").alias("component")).unionByName(empty.where("class is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
