"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors of a label are ordered lexicographically by the concatenated
signs of random projections, and each is compared with the ``WINDOW`` before it, in
double precision. Pairs that reach the threshold are united, across windows and passes.
What moves on from a window is an edge from a vector to the root of its neighbourhood,
not every pair. Equal vectors are one class first.

How many passes a label needs is measured: the first ordering shows how many leading
bits two vectors must share to stand within a window, and two vectors at the threshold
share a bit with a chance of ``1 - angle / pi``. The passes of a label are as many as
leave a pair apart with a chance of at most ``MISS``, taken at the crowding that 95 of
100 of its vectors do not exceed. A label whose vectors crowd around one direction would
need more comparisons in passes than it has pairs; such a label (more than ``MOST``
passes, and more of them than pairs) is compared whole instead, in square blocks, which
leaves nothing to chance. A label of fewer vectors than a window is compared whole by its
single pass.

Links of a component are then counted exactly: its vectors are compared in square blocks
of ``BLOCK``, dealt out by block, and a row for each vector that links leaves a block.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows whose label or id is null, link with nothing; vectors of different lengths do
not link; equal vectors of one label link; rows with one id are taken as that id; an
empty table stays empty; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import hot_keys, join_hot, save

THRESHOLD, WINDOW, BITS = 0.98, 256, 62
#: Greatest chance that a pair at the threshold meets in no pass, and the passes that any label gets if it needs them.
MISS, MOST = 1e-4, 32
#: Vectors of a side of a block, and rows compared with a side at once.
BLOCK, STRIP = 2048, 256
#: Labels of several passes are broadcast up to so many; more are joined by a shuffle.
BROADCAST_FAMILIES = 200_000


def passes_for(bits: float, threshold: float, miss: float = MISS) -> int:
    """Passes after which two vectors at the threshold have shared ``bits`` leading bits once, but for a chance of ``miss``."""
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if meet >= 1 else math.ceil(math.log(miss) / math.log1p(-meet))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _batches_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose vectors have one length."""
    size = np.diff(np.asarray(batch.column(column).offsets))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(size)) + 1, [len(size)]]) if len(size) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``keys``: for each pass the signs of BITS projections, as one number whose order is lexicographic."""
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    planes: dict[tuple[int, int], np.ndarray] = {}
    for whole in batches:
        for batch in _batches_of(whole, 2):
            if not batch.num_rows:
                continue
            x, passes = _unit(_matrix(batch.column(2))), batch.column(3).to_numpy()
            keys = np.zeros((len(x), int(passes.max())), np.int64)
            for p in range(keys.shape[1]):
                if (p, x.shape[1]) not in planes:
                    planes[p, x.shape[1]] = np.random.default_rng([p, x.shape[1]]).standard_normal((x.shape[1], BITS))
                todo = passes > p
                keys[todo, p] = (x[todo] @ planes[p, x.shape[1]] > 0) @ weights
            ends = np.concatenate([[0], np.cumsum(passes)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[np.arange(keys.shape[1])[None, :] < passes[:, None]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], listed], names=["node", "family", "vector", "keys"])


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits in which keys agree."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1].clip(0, BITS)


def _crowding(window: int):
    """(family, bits, rows): how many leading bits a vector shares with the one a window before it, over ordered (family, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            family, key = (np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held))
            if len(key) > window:
                same = np.flatnonzero(family[window:] == family[:-window])
                found = np.stack([family[window:][same], _shared_bits(key[window:][same], key[:-window][same])], 1)
                kinds, rows = np.unique(found, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[:, 0]), pa.array(kinds[:, 1]), pa.array(rows)], names=["family", "bits", "rows"])
                family, key = family[-window:], key[-window:]
            held = family, key

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that it reaches by links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return root


def _neighbours(threshold: float, window: int):
    """Edges (a, b) from each vector to the root of its neighbourhood, over strips that overlap by a window."""

    def edges(group: np.ndarray, x: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for at in range(0, len(x), STRIP):
            to = min(at + STRIP + window, len(x))
            near = x[at : at + STRIP] @ x[at:to].T >= threshold
            a, b = np.nonzero(near)
            fits = (b > a) & (b - a <= window) & (group[at + a] == group[at + b])
            left.append(at + a[fits])
            right.append(at + b[fits])
        root = _roots(len(x), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(root != np.arange(len(x)))
        return node[moved], node[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last window of rows: group, vectors, nodes
        for whole in batches:
            for batch in _batches_of(whole, 3):
                if not batch.num_rows:
                    continue
                x = _unit(_matrix(batch.column(3)))
                group = batch.column(0).to_numpy() * np.int64(0x9E3779B1) ^ batch.column(1).to_numpy()
                node = batch.column(2).to_numpy()
                if held is not None and held[1].shape[1] == x.shape[1]:
                    group, x, node = (np.concatenate(p) for p in zip(held, (group, x, node), strict=True))
                a, b = edges(group, x, node)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held = group[-window:], x[-window:], node[-window:]

    return run


def _block_links(threshold: float):
    """For each block of a group, the vectors that link there: node, root of the neighbourhood, and how many vectors it links with, copies counted."""

    def linked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = rows["block"].to_numpy()
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        x, copies, node = _unit(_matrix(rows["vector"].combine_chunks())), rows["copies"].to_numpy(), rows["node"].to_numpy()
        p, q = np.flatnonzero(side == i), np.flatnonzero(side == j)
        links, at, to = np.zeros(len(x), np.int64), [], []
        for k in range(0, len(p), STRIP):
            a, b = np.nonzero(x[p[k : k + STRIP]] @ x[q].T >= threshold)
            a, b = p[k + a], q[b]
            other = a != b
            at.append(a[other])
            to.append(b[other])
        at, to = np.concatenate(at), np.concatenate(to)
        links += np.bincount(at, copies[to], len(x)).astype(np.int64)
        if i != j:
            links += np.bincount(to, copies[at], len(x)).astype(np.int64)
        root = _roots(len(x), at, to)
        found = np.flatnonzero(links)
        return node[found], node[root[found]], links[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in linked(pa.Table.from_batches(held))], names=["node", "root", "links"])

        last = None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and tuple(keys[a]) != last:
                    yield out()
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(keys[a])
        if held:
            yield out()

    return run


def _compared(members: DataFrame, threshold: float, name: str) -> DataFrame:
    """All vectors of each ``group`` (``size`` of them) compared in blocks: node, root and links there, written."""
    members = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "vector")
    made = spread.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_block_links(threshold), "node long, root long, links long")
    return save(made, name)[0]


def _planned(kinds: DataFrame, threshold: float, window: int) -> DataFrame:
    """``kinds`` with ``passes``, and ``size`` of its family where that is compared whole (null elsewhere)."""
    kind = f"node long, family long, {_typed(kinds, 'vector')}, keys array<long>"
    first = kinds.select("node", "family", "vector", F.lit(1).cast("long").alias("passes")).mapInArrow(_keys, kind).select("family", F.col("keys")[0].alias("key"))
    crowds = first.repartitionByRange("family", "key").sortWithinPartitions("family", "key").mapInArrow(_crowding(window), "family long, bits long, rows long")
    crowds = crowds.groupBy("family").agg(F.percentile("bits", F.lit(0.95), F.col("rows")).alias("bits"))
    sizes = kinds.groupBy("family").agg(F.count("*").alias("size")).where(F.col("size") > window)
    meet = F.pow(F.lit(1 - math.acos(threshold) / math.pi), F.col("bits") + 1)
    needed = F.greatest(F.lit(1), F.ceil(F.lit(math.log(MISS)) / F.log1p(-meet))).cast("long")
    plan = sizes.join(crowds, "family").withColumn("passes", needed)
    whole = (F.col("passes") > MOST) & (F.col("passes") * (2 * window) > F.col("size"))
    plan, _ = save(plan.select("family", F.when(whole, 1).otherwise(F.col("passes")).cast("long").alias("passes"), F.when(whole, F.col("size")).alias("size"), F.col("size").alias("rows")), "vector-passes")
    if plan.count() <= BROADCAST_FAMILIES:
        planned = kinds.join(F.broadcast(plan.drop("rows")), "family", "left")
    else:
        planned = join_hot(kinds, plan.drop("rows"), ["family"], hot_keys(plan, ["family"], "rows"), "left")
    return planned.withColumn("passes", F.coalesce("passes", F.lit(1).cast("long")))


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, window: int | None = None) -> DataFrame:
    """A row for each row of ``df``: id, n_links, component_id (least id reachable by links), kept."""
    window = window or WINDOW
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = F.coalesce(finite & F.col(id).isNotNull() & F.col(label).isNotNull(), F.lit(False))
    family = F.xxhash64(F.col(label), F.size(v))  # vectors that may link: one label, one length
    rows = df.select(F.col(id).alias("id"), F.when(valid, v).alias("vector"), F.when(valid, family).alias("family"))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    same = ["family", "h1", "h2"]
    kinds = rows.where("vector is not null").groupBy(*same).agg(F.min("id").cast("long").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    kinds, _ = save(kinds, "vector-classes")
    kind = f"node long, family long, {_typed(kinds, 'vector')}, keys array<long>"
    planned, _ = save(_planned(kinds, threshold, window), "vector-planned")

    passed = planned.where("size is null")
    dealt = passed.select("node", "family", "vector", "passes").mapInArrow(_keys, kind).select(F.posexplode("keys").alias("pass", "key"), "family", "node", "vector")
    ordered = dealt.repartitionByRange("pass", "family", "key").sortWithinPartitions("pass", "family", "key", "node")
    edges = ordered.select(F.col("pass").cast("long"), "family", "node", "vector").mapInArrow(_neighbours(threshold, window), "a long, b long")
    whole = _compared(planned.where("size is not null").withColumn("group", F.col("family")), threshold, "vector-whole")
    edges, _ = save(edges.unionByName(whole.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))).distinct(), "vector-edges")
    found = connected_components(edges)

    size = found.groupBy("component").agg(F.count("*").alias("size"))
    giants = hot_keys(size, ["component"], "size")
    sized = join_hot(found, size, ["component"], giants).select(F.col("id").alias("node"), F.col("component").alias("group"), "size")
    counted = _compared(passed.select("node", "copies", "vector").join(sized, "node"), threshold, "vector-links")
    linked = counted.unionByName(whole).groupBy("node").agg(F.sum("links").alias("links"))

    known = kinds.select(*same, "node", "copies").join(found.withColumnRenamed("id", "node"), "node", "left").join(linked, "node", "left")
    links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    known = known.select(*same, links.alias("links"), F.coalesce("component", "node").alias("component"))
    valid_rows, others = rows.where("family is not null").select("id", *same), rows.where("family is null")
    out = join_hot(valid_rows, known, same, hot_keys(kinds, same, "copies"), "left").select("id", "links", "component")
    out = out.unionByName(others.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _typed(df: DataFrame, column: str) -> str:
    return f"{column} {df.schema[column].dataType.simpleString()}"
