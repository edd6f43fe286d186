"""Inserts and flushes: staged files first, segments of chosen size and order later."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import WriterLocked
from ..functions.order_key import code, zorder
from ..sources import log
from ..sources.log import Snapshot
from ..sources.table import CHOSEN, ManagedTable, index_schema
from ..workspace import settings

#: Keys that a layout samples to cut equal segments: all of them in a small table, some hundreds a segment in a large one.
SAMPLES, LEAST_SAMPLES = 200_000, 200
_SAMPLE_CONF = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
#: Where segments are small, a task cuts several: of at least so many tasks, each of so many rows and at most so many segments; only if it cuts at least so many.
FEW_TASKS, TASK_ROWS, MOST_CUT, LEAST_CUT = 64, 131072, 500, 8
#: Times a write starts afresh after another writer was first.
ATTEMPTS = 20
#: Parts of an index that are merged into one, and values that a condition lists.
MOST_PARTS, LISTED = 512, 1_000


def committed(table: ManagedTable, attempt: Callable[[Snapshot], dict | None]) -> Snapshot | None:
    """Commit what ``attempt`` makes of the newest snapshot, again on a newer one if another writer was first.

    ``attempt`` returns the changes, or None if there is nothing to commit. What it wrote
    for a lost commit is referred to by nothing and goes with the next vacuum.
    """
    table.writable()
    for _ in range(ATTEMPTS):
        base = table.snapshot()
        changes = attempt(base)
        if changes is None:
            return None
        done = log.commit(table.storage, base, **({"options": table.options} | changes))
        if done is not None:
            return done
    raise WriterLocked(f"{ATTEMPTS} commits of others came first")


def insert(table: ManagedTable, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """Append rows as staged files in one commit; return how many. A flush follows when enough is staged.

    ``batch`` is a sink's name and batch number: a number that is not above the sink's
    last one was written before and does nothing.
    """
    schema = table.snapshot().schema
    written: list[tuple] = []

    def attempt(base: Snapshot) -> dict | None:
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            written[:] = [("", 0, 0, 0)]
            return None
        if not written or base.schema != schema:
            written[:] = [table.write_files(base.schema.stored(rows), True, table.options, base.schema)]
        at, n, size, files = written[0]
        seen = base.batches | ({batch[0]: batch[1]} if batch else {})
        if n == 0:
            return {"batches": seen} if batch else None
        return {"index": (*base.index, at), "rows": base.rows + n, "staged_bytes": base.staged_bytes + size, "staged_files": base.staged_files + files, "batches": seen}

    done = committed(table, attempt)
    if done and (done.staged_bytes >= table.options.staged_max_bytes or done.staged_files >= table.options.staged_max_files):
        flush(table)
    return written[0][1]


def dealt(total: int, group: int) -> tuple[int, int]:
    """Partitions for ``total`` rows in segments of ``group``, and the rows at which a partition is cut into segments; 0: each is one.

    Every partition costs the driver a task's record and sampled keys, so many small segments are not a partition each.
    """
    segments = max(1, -(-total // group))
    tasks = max(FEW_TASKS, -(-total // TASK_ROWS), -(-segments // MOST_CUT))
    return (tasks, group) if segments >= LEAST_CUT * tasks else (segments, 0)


def laid_out(table: ManagedTable, rows: DataFrame, parts: int, keep_order: list[str], snapshot: Snapshot) -> DataFrame:
    """Physical rows dealt into partitions: by interleaved key if clustered, else in stored order."""
    names = snapshot.schema.physical().fieldNames()
    if table.options.cluster_by:
        fields = [snapshot.schema.find(c) for c in table.options.cluster_by]
        coded = rows.withColumns({f"__code{k}": code(F.col(f.physical), f.field.dataType) for k, f in enumerate(fields)})
        words = zorder([F.col(f"__code{k}") for k in range(len(fields))])
        keyed = coded.withColumns({f"__order{k}": w for k, w in enumerate(words)})
        order = [f"__order{k}" for k in range(len(words))]
    else:
        keyed, order = rows, keep_order
    if parts == 1:
        return keyed.repartition(1).sortWithinPartitions(*order).select(*names)
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*names)


def rewrite(table: ManagedTable, base: Snapshot, chosen: list, schema=None, convert=None) -> tuple[str | None, int]:
    """Write the live rows of segments anew under the table's options; return the new index folder and its rows."""
    total = table.live_rows(chosen, base)
    if total == 0:
        return None, 0
    parts, cut = dealt(total, table.options.group_rows(total))
    laid = laid_out(table, table.rows(chosen, base, positions=True), parts, ["file", "row_index"], base)
    if convert is not None:
        laid = convert(laid)
    samples = LEAST_SAMPLES if cut else max(LEAST_SAMPLES, SAMPLES // parts)
    with table.packed(), settings(table.spark, {_SAMPLE_CONF: samples}):
        at, n, _, _ = table.write_files(laid, False, table.options, schema or base.schema, cut)
    return at, n


def replaced(table: ManagedTable, base: Snapshot, gone: list, new: list[str], added: int) -> dict:
    """Changes that take index rows ``gone`` out, bring the index folders ``new`` of ``added`` rows in, and drop deletes of what is gone.

    Only index files that name a gone segment are written anew, so a small change of a large
    table costs a small write; once the index has ``MOST_PARTS`` parts they become one.
    """
    names = {r.segment for r in gone}
    is_gone = _in(table, "segment", names)
    raw = table.spark.read.schema(index_schema(base.schema))
    parts = list(base.index)
    if len(parts) < MOST_PARTS:
        named = is_gone(raw.parquet(*[table.storage.path(p) for p in parts]).select("segment", F.col("_metadata.file_path").alias("file")), "left_semi")
        hit = {"/".join(r.file.split("/")[-2:]) for r in named.select("file").distinct().collect()}
        files = [(p, [f"{p}/{n}" for n in table.storage.sizes(p) if n.endswith(".parquet")] if p.count("/") == 1 else [p]) for p in parts]
        touched = [f for _, fs in files for f in fs if f.removeprefix("index/") in hit]
        parts = [u for p, fs in files for u in ([p] if not set(fs) & set(touched) else [f for f in fs if f not in touched])]
    else:
        touched, parts = parts, []
    if touched:
        at = f"index/{uuid.uuid4().hex}"
        is_gone(raw.parquet(*[table.storage.path(p) for p in touched]), "left_anti").coalesce(-(-len(touched) // 16)).write.parquet(table.storage.path(at))
        if not raw.parquet(table.storage.path(at)).isEmpty():
            parts.append(at)
    deletes, deleted = base.deletes, base.deleted
    if deletes and names & table.dirty(base):
        path, deleted = table.write_deletes(is_gone(table.delete_vectors(base), "left_anti"))
        deletes = (path,) if deleted else ()
    staged = [r for r in gone if r.staged]
    return {
        "index": (*parts, *new), "deletes": deletes, "deleted": deleted, "rows": base.rows - sum(r.rows for r in gone) + added,
        "staged_bytes": base.staged_bytes - sum(r.bytes for r in staged), "staged_files": base.staged_files - len(staged),
    }


def _in(table: ManagedTable, column: str, values: set[str]):
    """A function that keeps (``left_semi``) or drops (``left_anti``) rows with one of these values: by a list of bounded length, else by a join."""
    if len(values) < LISTED:
        listed = F.col(column).isin(list(values))
        return lambda df, how: df.where(listed if how == "left_semi" else ~listed)
    wanted = table.spark.createDataFrame([(v,) for v in values], f"{column} string")
    return lambda df, how: df.join(wanted, column, how)


def flush(table: ManagedTable) -> int:
    """Make segments of all staged rows that live; return how many rows moved."""
    moved = [0]

    def attempt(base: Snapshot) -> dict | None:
        staged = table.index(base).where("staged").select(*CHOSEN).collect()
        if not staged:
            return None
        at, moved[0] = rewrite(table, base, staged)
        return replaced(table, base, staged, [at] if at else [], moved[0])

    committed(table, attempt)
    return moved[0]


