"""Adding computed columns to a DataFrame by a function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Rows computed and handed back at once, so that neither side holds a whole batch of results.
STEP = 512


def with_columns(df: DataFrame, fields: str, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns of the DDL string ``fields``, from one narrow pass without a shuffle.

    A column of ``df`` that has the name of a new one is replaced; all others pass
    through unchanged, but for those in ``without``, which only ``compute`` sees.
    Names are matched exactly, so extra columns cannot clash.
    """
    new = T.StructType.fromDDL(fields)
    names = {*new.fieldNames(), *without}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            made = compute(batch)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [made[n] for n in new.fieldNames()]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """Texts as Python strings; a null is an empty text."""
    return ["" if t is None else t for t in column.to_pylist()]
