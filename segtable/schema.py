"""Columns with stable physical names, so that names can change without a rewrite."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgument, SchemaMismatch


@dataclass(frozen=True)
class Field:
    id: int
    field: T.StructField

    @property
    def physical(self) -> str:
        return f"c{self.id}"

    @property
    def name(self) -> str:
        return self.field.name


@dataclass(frozen=True)
class TableSchema:
    fields: tuple[Field, ...]
    next_id: int

    @classmethod
    def of(cls, struct: T.StructType) -> TableSchema:
        names = [f.name.lower() for f in struct.fields]
        if not names:
            raise InvalidArgument("a table needs a column")
        if len(set(names)) < len(names):
            raise InvalidArgument("column names must differ")
        for f in struct.fields:
            if isinstance(f.dataType, T.NullType):
                raise InvalidArgument(f"column {f.name} has no type")
        return cls(tuple(Field(k, f) for k, f in enumerate(struct.fields)), len(struct.fields))

    def to_json(self) -> dict:
        return {"next_id": self.next_id, "fields": [{"id": f.id, "field": f.field.jsonValue()} for f in self.fields]}

    @classmethod
    def from_json(cls, x: dict) -> TableSchema:
        return cls(tuple(Field(f["id"], T.StructField.fromJson(f["field"])) for f in x["fields"]), x["next_id"])

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def struct(self) -> T.StructType:
        return T.StructType([f.field for f in self.fields])

    def physical(self) -> T.StructType:
        """The schema of the files; every column may be missing from an older one and then reads as null."""
        return T.StructType([T.StructField(f.physical, f.field.dataType, True) for f in self.fields])

    def find(self, name: str) -> Field:
        found = [f for f in self.fields if f.name.lower() == name.lower()]
        if not found:
            raise SchemaMismatch(f"no column {name!r}")
        return found[0]

    def named(self, df: DataFrame, extra: list[Column] = ()) -> DataFrame:
        """Physical columns under their names, with their metadata."""
        return df.select(*[F.col(f.physical).alias(f.name, metadata=f.field.metadata) for f in self.fields], *extra)

    def stored(self, df: DataFrame) -> DataFrame:
        """Rows under physical names; names, order, types and nullability must fit."""
        if [n.lower() for n in df.columns] != [n.lower() for n in self.names]:
            raise SchemaMismatch(f"columns {df.columns} are not {self.names}")
        for have, want in zip(df.schema.fields, self.fields, strict=True):
            if have.dataType.simpleString() != want.field.dataType.simpleString():
                raise SchemaMismatch(f"column {want.name} is {have.dataType.simpleString()}, not {want.field.dataType.simpleString()}")
        columns = []
        for have, want in zip(df.columns, self.fields, strict=True):
            c = F.col(f"`{have}`")
            if not want.field.nullable and df.schema[have].nullable:
                c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"null in column {want.name}")).cast(want.field.dataType))
            columns.append(c.alias(want.physical))
        return df.select(*columns)

    # --- changes ---

    def add(self, field: T.StructField) -> TableSchema:
        if not field.nullable:
            raise InvalidArgument("a new column must be nullable")
        if any(f.name.lower() == field.name.lower() for f in self.fields):
            raise InvalidArgument(f"column {field.name!r} exists")
        return TableSchema((*self.fields, Field(self.next_id, field)), self.next_id + 1)

    def rename(self, old: str, new: str) -> TableSchema:
        at = self.find(old)
        if any(f.name.lower() == new.lower() and f.id != at.id for f in self.fields):
            raise InvalidArgument(f"column {new!r} exists")
        field = T.StructField(new, at.field.dataType, at.field.nullable, at.field.metadata)
        return replace(self, fields=tuple(Field(f.id, field) if f.id == at.id else f for f in self.fields))

    def drop(self, name: str) -> TableSchema:
        at = self.find(name)
        if len(self.fields) == 1:
            raise InvalidArgument("the last column stays")
        return replace(self, fields=tuple(f for f in self.fields if f.id != at.id))

    def cast(self, name: str, kind: T.DataType) -> TableSchema:
        """The column under a new physical name, as its stored values change; its metadata stays."""
        at = self.find(name)
        field = T.StructField(at.name, kind, at.field.nullable, at.field.metadata)
        return TableSchema(tuple(Field(self.next_id, field) if f.id == at.id else f for f in self.fields), self.next_id + 1)
