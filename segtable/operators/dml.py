"""DELETE and UPDATE: matches become delete vectors, new versions of rows become staged files, in one commit."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, SchemaMismatch
from ..sources.log import Snapshot
from ..sources.table import CHOSEN, ManagedTable
from .writing import committed, replaced


def _matching(table: ManagedTable, base: Snapshot, where: str | Column | None, alias: str | None) -> DataFrame:
    """Live rows for which the predicate is true (not null), with their places."""
    return table.scan(where, base, positions=True, alias=alias)


def delete(table: ManagedTable, where: str | Column | None = None, alias: str | None = None) -> int:
    """Delete rows for which ``where`` is true, or all; return how many. ``alias`` is the name by which it may qualify columns."""
    counted = [0]

    def attempt(base: Snapshot) -> dict | None:
        counted[0] = 0
        if where is None:
            counted[0] = base.live_rows
            return {"index": (), "deletes": (), "rows": 0, "deleted": 0, "staged_bytes": 0, "staged_files": 0} if base.rows else None
        with table.packed():
            at, counted[0] = table.write_deletes(_matching(table, base, where, alias))
        return table.add_deletes(base, at, counted[0]) if counted[0] else None

    committed(table, attempt)
    return counted[0]


def update(table: ManagedTable, assignments: dict[str, str | Column], where: str | Column | None = None, alias: str | None = None) -> int:
    """Set columns of rows for which ``where`` is true, or of all; expressions see the old row. Returns how many.

    Values are cast to the column's type; one that does not fit is an error (ANSI), and
    then nothing changes.
    """
    counted = [0]

    def attempt(base: Snapshot) -> dict | None:
        counted[0] = 0
        fields = {base.schema.find(n).name: v for n, v in assignments.items()}
        if len(fields) < len(assignments):
            raise InvalidArgument("a column is set once")
        kept = f"matches/{uuid.uuid4().hex}"
        # Matches are written once: their places and their new versions must be of the same rows.
        with table.packed():
            _matching(table, base, where, alias).write.parquet(table.storage.path(kept))
        matched = table.spark.read.parquet(table.storage.path(kept))
        try:
            at, counted[0] = table.write_deletes(matched)
            if not counted[0]:
                return None
            columns = []
            for f in base.schema.fields:
                if f.name in fields:
                    value = fields[f.name]
                    value = F.expr(value) if isinstance(value, str) else value
                    columns.append(value.cast(f.field.dataType).alias(f.name))
                else:
                    columns.append(F.col(f"`{f.name}`"))
            index, n, size, files = table.write_files(base.schema.stored(table.aliased(matched, alias).select(*columns)), True, table.options, base.schema)
        finally:
            table.storage.delete(kept)
        return {
            **table.add_deletes(base, at, counted[0]), "index": (*base.index, index), "rows": base.rows + n,
            "staged_bytes": base.staged_bytes + size, "staged_files": base.staged_files + files,
        }

    committed(table, attempt)
    return counted[0]


def _new_deletes(table: ManagedTable, base: Snapshot, positions: DataFrame) -> tuple[str, int]:
    """A delete vector of those positions that exist and live; an unknown segment is an error."""
    wanted = positions.select("segment", "row_index").distinct()
    index = table.index(base).select("segment", "rows")
    if not wanted.join(index, "segment", "left_anti").isEmpty():
        raise SchemaMismatch("unknown segment")
    new = wanted.join(index, "segment").where("row_index >= 0 and row_index < rows")
    if base.deletes:
        new = new.join(table.delete_vectors(base), ["segment", "row_index"], "left_anti")
    return table.write_deletes(new)


def delete_positions(table: ManagedTable, positions: DataFrame) -> int:
    """Delete rows by (segment, row_index). Positions past the end or deleted already do nothing."""
    counted = [0]

    def attempt(base: Snapshot) -> dict | None:
        at, counted[0] = _new_deletes(table, base, positions)
        return table.add_deletes(base, at, counted[0]) if counted[0] else None

    committed(table, attempt)
    return counted[0]


def update_rows(table: ManagedTable, positions: DataFrame, rows: DataFrame) -> int:
    """Delete rows by position and insert ``rows`` in one commit; returns the greater of both counts."""
    counted = [0]

    def attempt(base: Snapshot) -> dict | None:
        at, gone = _new_deletes(table, base, positions)
        index, n, size, files = table.write_files(base.schema.stored(rows), True, table.options, base.schema)
        counted[0] = max(gone, n)
        return {
            **table.add_deletes(base, at, gone), "index": (*base.index, index), "rows": base.rows + n,
            "staged_bytes": base.staged_bytes + size, "staged_files": base.staged_files + files,
        } if counted[0] else None

    committed(table, attempt)
    return counted[0]


def delete_segments(table: ManagedTable, segments: list[str]) -> int:
    """Take whole segments out in one commit; return how many there were."""
    counted = [0]

    def attempt(base: Snapshot) -> dict | None:
        gone = table.index(base).where(F.col("segment").isin(segments)).select(*CHOSEN).collect()
        counted[0] = len(gone)
        return replaced(table, base, gone, [], 0) if gone else None

    committed(table, attempt)
    return counted[0]
