"""Managed tables: create and open, scan, and what is known about them.

A segment is one Parquet file of bounded rows, with statistics in the segment index.
Staged files, from inserts that no flush has taken yet, are segments without
statistics. Delete vectors name rows by file and position, so no file ever changes.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument, ReadOnly, SchemaMismatch
from ..functions.order_key import orderable
from ..options import TableOptions
from ..plans.pruning import scan_filters, survivors
from ..schema import TableSchema
from ..workspace import settings
from . import log
from .filters import segment_filters
from .log import Snapshot, Storage

#: Longest text or bytes kept as a bound; of longer ones the least is cut and the greatest cut and raised.
BOUND_LENGTH = 64
#: An index of at most so many bytes of Parquet is held by the driver, for as many snapshots.
SMALL_INDEX, KEPT_INDEXES = 4 << 20, 4
#: Delete vectors of at most so many rows are broadcast to a scan; beyond, both sides are shuffled.
BROADCAST_DELETES = 2_000_000
#: Folders of delete vectors that a snapshot may have before they are merged.
MERGE_DELETES = 16
#: Bytes that opening a segment counts for when the table itself reads them.
OPEN_COST = 256 << 10
#: What is asked of a segment that will be read.
CHOSEN = ("segment", "path", "rows", "bytes", "staged", "siblings")
INDEX_BASE = (("segment", T.StringType()), ("path", T.StringType()), ("rows", T.LongType()), ("bytes", T.LongType()), ("staged", T.BooleanType()), ("siblings", T.LongType()))


def bounded(kind: T.DataType) -> bool:
    return orderable(kind)


def index_schema(schema: TableSchema) -> T.StructType:
    """Columns of the segment index for this schema; those an older index lacks read as null, which is unknown."""
    fields = [T.StructField(n, k) for n, k in INDEX_BASE]
    for f in schema.fields:
        if bounded(f.field.dataType):
            fields += [T.StructField(f"min_{f.physical}", f.field.dataType), T.StructField(f"max_{f.physical}", f.field.dataType)]
        fields.append(T.StructField(f"nulls_{f.physical}", T.LongType()))
        fields += [T.StructField(f"{k}_{f.physical}", T.ArrayType(T.LongType())) for k in ("bloom", "tri")]
    return T.StructType(fields)


@dataclass(frozen=True)
class ScanPlan:
    """What a scan will read: for people, and for tests of pruning."""

    segments: int
    pruned: int
    staged: int
    predicate: str

    def __str__(self) -> str:
        return f"SegmentScan: segments={self.segments}, pruned={self.pruned}, staged={self.staged}, predicate={self.predicate or 'none'}"


class ManagedTable:
    """A table in a folder. Readers pin a snapshot; writers commit optimistically."""

    def __init__(self, spark: SparkSession, path: str, options: TableOptions | None):
        self.spark, self.storage = spark, Storage(spark, path)
        self._options = options
        self._indexes: dict[tuple, DataFrame] = {}
        self._plans: dict[tuple, object] = {}
        self.name: str | None = None  # what predicates may qualify columns with

    # --- opening ---

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, options: TableOptions | None = None) -> ManagedTable:
        options = options or TableOptions()
        table = cls(spark, path, options)
        if options.read_only:
            raise ReadOnly("cannot create a table to read it only")
        if log.commits(table.storage):
            raise InvalidArgument(f"a table exists at {path}")
        columns = TableSchema.of(schema)
        _check_options(columns, options)
        first = log.commit(table.storage, Snapshot(-1, columns, options))
        if first is None:
            raise InvalidArgument(f"a table exists at {path}")
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: TableOptions | None = None) -> ManagedTable:
        """Open a table; ``options`` take effect for what is written from now on."""
        table = cls(spark, path, options)
        _check_options(table.snapshot().schema, table.options)
        return table

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, schema: T.StructType, options: TableOptions | None = None) -> ManagedTable:
        if not log.commits(Storage(spark, path)):
            return cls.create(spark, path, schema, options)
        table = cls.open(spark, path, options)
        have = table.snapshot().schema.struct()
        if [(f.name, f.dataType, f.nullable) for f in have] != [(f.name, f.dataType, f.nullable) for f in schema]:
            raise SchemaMismatch("the table has another schema")
        return table

    @property
    def options(self) -> TableOptions:
        return self._options or self.snapshot().options

    def snapshot(self, txn: int | None = None) -> Snapshot:
        return log.latest(self.storage) if txn is None else log.at(self.storage, txn)

    def writable(self) -> None:
        if self.options.read_only:
            raise ReadOnly("the table was opened to be read")

    # --- reading ---

    def index(self, snapshot: Snapshot | None = None) -> DataFrame:
        """A row for each segment of the snapshot."""
        snapshot = snapshot or self.snapshot()
        schema = index_schema(snapshot.schema)
        if not snapshot.index:
            return self.spark.createDataFrame([], schema)
        key = (snapshot.index, tuple(schema.fieldNames()))
        if key not in self._indexes:
            whole = self.spark.read.schema(schema).parquet(*[self.storage.path(p) for p in snapshot.index])
            small = self.held(snapshot)
            # A small index becomes a local relation: the optimizer filters it without a job. Commits never change, so it stays right.
            while len(self._indexes) >= KEPT_INDEXES:
                self._indexes.pop(next(iter(self._indexes)))
            self._indexes[key] = self._held(whole.toArrow(), schema) if small else whole
        return self._indexes[key]

    def held(self, snapshot: Snapshot) -> bool:
        """Whether the driver holds this snapshot's index."""
        return self._once(("held", snapshot.index), lambda: sum(sum(self.storage.sizes(p).values()) for p in snapshot.index) <= SMALL_INDEX)

    def _held(self, rows: pa.Table, schema: T.StructType) -> DataFrame:
        """A small index without the statistics that none of its segments has: a verdict need not ask for them."""
        base = {n for n, _ in INDEX_BASE}
        kept = [f for f in schema.fields if f.name in base or rows[f.name].null_count < rows.num_rows]
        return self.spark.createDataFrame(rows.select([f.name for f in kept]), T.StructType(kept))

    def files(self, paths: list[str], schema: TableSchema) -> DataFrame:
        """Physical rows of data files."""
        if not paths:
            return self.spark.createDataFrame([], schema.physical())
        return self._reader(schema).parquet(*[self.storage.path(p) for p in paths])

    def _reader(self, schema: TableSchema):
        return self.spark.read.schema(schema.physical()).option("parquet.page.verify-checksum.enabled", str(self.options.verify_checksums).lower())

    def delete_vectors(self, snapshot: Snapshot) -> DataFrame:
        return self.spark.read.schema("segment string, row_index long").parquet(*[self.storage.path(f"{p}/rows") for p in snapshot.deletes])

    def delete_counts(self, snapshot: Snapshot) -> DataFrame:
        """Deleted rows of each segment that has any, from the counts kept beside the vectors."""
        counts = self.spark.read.schema("segment string, gone long").parquet(*[self.storage.path(f"{p}/counts") for p in snapshot.deletes])
        return counts.groupBy("segment").agg(F.sum("gone").alias("gone"))

    def dirty(self, snapshot: Snapshot) -> set[str]:
        """Segments with deleted rows."""
        return self._once(("dirty", snapshot.deletes), lambda: {r.segment for r in self.delete_counts(snapshot).select("segment").collect()})

    def rows(self, chosen: list, snapshot: Snapshot, positions: bool = False) -> DataFrame:
        """Live physical rows of index rows ``chosen``; with ``positions``, their file and place too."""
        schema = snapshot.schema
        dirty: set[str] = set()
        if snapshot.deletes and chosen:
            dirty = self.dirty(snapshot)
        clean = units([r for r in chosen if r.segment not in dirty])
        touched = units([r for r in chosen if r.segment in dirty])
        place = [F.col("_metadata.file_name").alias("segment"), F.col("_metadata.row_index").alias("row_index"), F.col("_metadata.file_path").alias("file")]
        read = lambda paths, more: self.files(paths, schema).select(*schema.physical().fieldNames(), *more)
        parts = []
        if clean or not touched:
            parts.append(read(clean, place if positions else []) if clean else self.files([], schema).select("*", *([F.lit("").alias("segment"), F.lit(0).cast("long").alias("row_index"), F.lit("").alias("file")] if positions else [])))
        if touched:
            vectors = self.delete_vectors(snapshot)
            vectors = F.broadcast(vectors) if snapshot.deleted <= BROADCAST_DELETES else vectors
            left = read(touched, place).join(vectors, ["segment", "row_index"], "left_anti")
            parts.append(left.select(*schema.physical().fieldNames(), *(["segment", "row_index", "file"] if positions else [])))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def probe(self, snapshot: Snapshot) -> DataFrame | None:
        """The table as one plain scan, for Catalyst to push filters to; None for a table without segments."""
        if not snapshot.index:
            return None
        return self._once(("probe", snapshot.txn), lambda: snapshot.schema.named(self.spark.read.schema(snapshot.schema.physical()).parquet(self.storage.path(snapshot.index[0]))))

    def whole(self, snapshot: Snapshot) -> DataFrame:
        """All live rows, for queries without a filter."""
        return self._once(("whole", snapshot.txn), lambda: snapshot.schema.named(self._everything(snapshot)))

    def _everything(self, snapshot: Snapshot) -> DataFrame:
        """All live physical rows. Without deletes a folder whose segments all live is read as a folder, so only folders come to the driver."""
        if snapshot.deletes or not snapshot.index:
            return self.rows(self.choose(snapshot, None)[0], snapshot)
        index = self.index(snapshot).withColumn("folder", F.regexp_extract("path", "^(.*)/", 1))
        if self.held(snapshot):
            return self.files(units(index.select("path", "siblings").collect()), snapshot.schema)
        folders = index.groupBy("folder").agg((F.count("*") == F.max("siblings")).alias("full"))
        full = [r.folder for r in folders.where("full").select("folder").collect()]
        parts = index.join(folders.where("not coalesce(full, false)"), "folder").select("path").collect()
        return self.files([*full, *(r.path for r in parts)], snapshot.schema)

    def _once(self, key: tuple, make):
        """What is known of a snapshot, found once: files never change."""
        if key not in self._plans:
            made = make()  # which may ask for other things itself
            while len(self._plans) >= 4 * KEPT_INDEXES:
                self._plans.pop(next(iter(self._plans)))
            self._plans[key] = made
        return self._plans[key]

    def choose(self, snapshot: Snapshot, filters: list[list] | None, counted: bool = False) -> tuple[list, ScanPlan]:
        """The segments that a query with these pushed filters may need; ``counted`` asks for how many there are besides."""
        index = self.index(snapshot)
        needed = index if not filters else survivors(index, filters)
        # Paths of the segments to be read: that list is what a file scan is made of.
        chosen = needed.select(*CHOSEN).collect()
        total = index.count() if counted and filters else len(chosen)
        staged = sum(r.staged for r in chosen)
        text = " OR ".join(" AND ".join(c.sql() for c in f) for f in filters or [])
        return chosen, ScanPlan(len(chosen) - staged, total - len(chosen), staged, text)

    def scan(self, where: str | Column | None = None, snapshot: Snapshot | None = None, positions: bool = False, alias: str | None = None) -> DataFrame:
        """Live rows, pinned to the snapshot; with ``where`` only segments that may hold a match are read."""
        snapshot = snapshot or self.snapshot()
        chosen, _ = self.choose(snapshot, self._pushed(where, snapshot, alias))
        extra = [F.col("segment"), F.col("row_index")] if positions else []
        out = self.aliased(snapshot.schema.named(self.rows(chosen, snapshot, positions), extra), alias)
        return out.where(where) if where is not None else out

    to_df = scan

    def aliased(self, df: DataFrame, alias: str | None = None) -> DataFrame:
        name = alias or self.name
        return df.alias(name) if name else df

    def explain(self, where: str | Column | None = None, snapshot: Snapshot | None = None) -> ScanPlan:
        snapshot = snapshot or self.snapshot()
        return self.choose(snapshot, self._pushed(where, snapshot), True)[1]

    def _pushed(self, where: str | Column | None, snapshot: Snapshot, alias: str | None = None) -> list[list] | None:
        probe = self.probe(snapshot)
        if where is None or probe is None:
            return None
        plan = self.aliased(probe, alias).where(where)._jdf.queryExecution().optimizedPlan()
        return scan_filters(plan, snapshot.index[0])

    def row_count(self) -> int:
        """Exact, from the commit alone."""
        return self.snapshot().live_rows

    def detail(self) -> DataFrame:
        """Segments with their live rows."""
        snapshot = self.snapshot()
        index = self.index(snapshot).select(*CHOSEN)
        if not snapshot.deletes:
            return index.withColumn("live", F.col("rows"))
        return index.join(self.delete_counts(snapshot), "segment", "left").withColumn("live", F.col("rows") - F.coalesce("gone", F.lit(0))).drop("gone")

    def live_rows(self, chosen: list, snapshot: Snapshot) -> int:
        """Rows of index rows ``chosen`` that no delete vector names, from the counts alone."""
        rows = {r.segment: r.rows for r in chosen}
        gone = self.delete_counts(snapshot).collect() if snapshot.deletes else []
        return sum(rows.values()) - sum(g.gone for g in gone if g.segment in rows)

    # --- writing, for the operators ---

    def packed(self):
        """While this lasts, a task reads many small segments: by Spark's own reckoning of 4 MB a file each task reads few, and the driver keeps a record of every task."""
        return settings(self.spark, {"spark.sql.files.openCostInBytes": OPEN_COST})

    def write_files(self, stored: DataFrame, staged: bool, options: TableOptions, schema: TableSchema, most: int = 0) -> tuple[str, int, int, int]:
        """Write physical rows, a file for each partition or (``most``) for so many rows of one, and their index; return its folder, rows, bytes and files."""
        name = f"data/{time.time_ns():020d}-{uuid.uuid4().hex}"  # names sort by time, so stored order is that of inserts
        filtered = {c: [schema.find(n).physical for n in _chosen(cs, schema)] for c, cs in (("bloom", options.bloom_columns), ("tri", options.trigram_columns))}
        given = options.parquet(schema.names, [] if staged else filtered["bloom"], options.row_group_rows)
        given |= {"maxRecordsPerFile": str(most)} if most else {}
        stored.write.options(**given).parquet(self.storage.path(name))
        sizes = {n: b for n, b in self.storage.sizes(name).items() if n.endswith(".parquet")}
        wanted = index_schema(schema)
        files = self.spark.createDataFrame([(n, f"{name}/{n}", b) for n, b in sizes.items()], "segment string, path string, bytes long")
        written = self.files([name], schema).select("*", F.col("_metadata.file_name").alias("segment")) if sizes else self.files([], schema).withColumn("segment", F.lit(""))
        stats = written.groupBy("segment").agg(F.count("*").alias("rows"), *([] if staged else _statistics(schema)))
        if not staged and (filtered["bloom"] or filtered["tri"]):
            text = [c for c in filtered["tri"] if isinstance(dict((f.physical, f.field.dataType) for f in schema.fields)[c], (T.StringType, T.BinaryType))]
            stats = stats.join(segment_filters(written, [c for c in filtered["bloom"] if bounded(dict((f.physical, f.field.dataType) for f in schema.fields)[c])], text, options.bloom_bits_per_value), "segment")
        index = files.join(stats, "segment").withColumn("staged", F.lit(staged)).withColumn("siblings", F.lit(len(sizes)))
        have = set(index.columns)
        index = index.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
        at = f"index/{uuid.uuid4().hex}"
        index.coalesce(max(1, len(sizes) // 4096)).write.parquet(self.storage.path(at))
        rows, size = self.spark.read.parquet(self.storage.path(at)).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        return at, int(rows), int(size), len(sizes)

    def write_deletes(self, positions: DataFrame) -> tuple[str, int]:
        """Write a delete vector, and beside it how many rows it names of each segment; return its folder and how many in all."""
        at = f"deletes/{uuid.uuid4().hex}"
        positions.select("segment", "row_index").write.parquet(self.storage.path(f"{at}/rows"))
        written = self.spark.read.schema("segment string, row_index long").parquet(self.storage.path(f"{at}/rows"))
        written.groupBy("segment").agg(F.count("*").alias("gone")).coalesce(1).write.parquet(self.storage.path(f"{at}/counts"))
        total = self.spark.read.schema("segment string, gone long").parquet(self.storage.path(f"{at}/counts")).agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]
        return at, int(total)

    def add_deletes(self, base: Snapshot, at: str, count: int) -> dict:
        """Changes that add a delete vector; once ``MERGE_DELETES`` folders are there they become one."""
        folders = (*base.deletes, at)
        if len(folders) >= MERGE_DELETES:
            folders = (self.write_deletes(self.delete_vectors(replace(base, deletes=folders)))[0],)
        return {"deletes": folders, "deleted": base.deleted + count}

    def pin(self, txn: int | None = None, name: str | None = None) -> str:
        """Keep a snapshot (the newest by default) readable through every vacuum until ``unpin``; returns the pin's name."""
        snapshot, name = self.snapshot(txn), name or uuid.uuid4().hex
        if not self.storage.create(f"_pins/{name}", str(snapshot.txn).encode(), "none"):
            raise InvalidArgument(f"a pin {name!r} exists")
        return name

    def unpin(self, name: str) -> None:
        self.storage.delete(f"_pins/{name}")

    def pins(self) -> dict[str, int]:
        """Pinned snapshots by the names of their pins."""
        return {n: int(self.storage.read(f"_pins/{n}")) for n in self.storage.names("_pins") if not n.startswith(".")}

    def vacuum(self, keep: int = 1, min_age_s: float = 0) -> int:
        """Remove what neither the newest ``keep`` commits nor a pinned snapshot refers to; returns folders removed.

        What is younger than ``min_age_s`` stays, as a writer may be about to commit it or a
        reader may have opened it just before; with 0 run it while nobody else uses the table.
        """
        self.writable()
        txns, pinned = log.commits(self.storage), set(self.pins().values())
        held = [t for t in txns if t in pinned or t in txns[-keep:] or self.storage.age_ms(f"_log/{t:020d}.json") < min_age_s * 1000]
        kept = [log.at(self.storage, t) for t in held]
        index, deletes = {"/".join(p.split("/")[:2]) for s in kept for p in s.index}, {p for s in kept for p in s.deletes}
        folders: set[str] = set()
        for s in kept:
            folders |= {r.f for r in self.index(s).select(F.regexp_extract("path", "^(data/[^/]+)/", 1).alias("f")).distinct().collect()}
        removed = 0
        for top, live in (("index", index), ("deletes", deletes), ("data", folders)):
            for n in self.storage.names(top):
                if f"{top}/{n}" not in live and self.storage.age_ms(f"{top}/{n}") >= min_age_s * 1000:
                    self.storage.delete(f"{top}/{n}")
                    removed += 1
        for t in set(txns) - set(held):
            self.storage.delete(f"_log/{t:020d}.json")
        return removed


def units(chosen: list) -> list[str]:
    """What a scan of these segments lists: folders of which all segments are there, and single files."""
    folders: dict[str, list] = {}
    for r in chosen:
        folders.setdefault(r.path.rsplit("/", 1)[0], []).append(r)
    return [u for f, rs in folders.items() for u in ([f] if len(rs) == rs[0].siblings else [r.path for r in rs])]


def _chosen(names: tuple[str, ...], schema: TableSchema) -> list[str]:
    return schema.names if names == ("*",) else list(names)


def _check_options(schema: TableSchema, options: TableOptions) -> None:
    for c in (*options.bloom_columns, *options.trigram_columns):
        if c != "*":
            schema.find(c)
    if len({c.lower() for c in options.cluster_by}) < len(options.cluster_by):
        raise InvalidArgument("a column orders once")
    for c in options.cluster_by:
        if not orderable(schema.find(c).field.dataType):
            raise InvalidArgument(f"column {c} has no order")


def _statistics(schema: TableSchema) -> list[Column]:
    """Least and greatest value and nulls of each column; unknown bounds are null."""
    out = []
    for f in schema.fields:
        c, kind = F.col(f.physical), f.field.dataType
        out.append(F.count_if(c.isNull()).alias(f"nulls_{f.physical}"))
        if not bounded(kind):
            continue
        low, high = F.min(c), F.max(c)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            nan = F.max(F.isnan(c))
            low, high = F.when(~nan, low), F.when(~nan, high)
        if isinstance(kind, (T.StringType, T.BinaryType)):
            # Of a long greatest value the cut text followed by the last character there is; kept only where that is above the value.
            last = F.lit("\U0010ffff") if isinstance(kind, T.StringType) else F.lit(b"\xff")
            above = F.concat(F.substring(high, 1, BOUND_LENGTH), last)
            high = F.when(F.length(high) <= BOUND_LENGTH, high).when(above > high, above)
            low = F.substring(low, 1, BOUND_LENGTH)
        out += [low.alias(f"min_{f.physical}"), high.alias(f"max_{f.physical}")]
    return out


