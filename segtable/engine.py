"""SQL over managed tables: SELECT with segment pruning, INSERT, DELETE and UPDATE."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import InvalidArgument, Unsupported
from .functions.names import register as register_names
from .operators import dml, writing
from .options import TableOptions
from .plans.pruning import scan_filters
from .sources.table import ManagedTable, ScanPlan

_REFUSED = {"MergeIntoTable": "MERGE", "TruncateTable": "TRUNCATE"}


class Engine:
    """Names for managed tables in a Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, ManagedTable] = {}
        self.plans: dict[str, ScanPlan] = {}
        self.functions = register_names(spark)

    def register(self, name: str, path: str, options: TableOptions | None = None) -> ManagedTable:
        """Open the table at ``path`` under ``name``."""
        return self.attach(name, ManagedTable.open(self.spark, path, options))

    def create(self, name: str, path: str, schema: T.StructType, options: TableOptions | None = None) -> ManagedTable:
        return self.attach(name, ManagedTable.create(self.spark, path, schema, options))

    def attach(self, name: str, table: ManagedTable) -> ManagedTable:
        self._tables[name.lower()] = table
        table.name = name
        return table

    def table(self, name: str) -> ManagedTable:
        return self._tables[name.lower()]

    def sql(self, text: str) -> DataFrame:
        """Run a statement. A SELECT is pinned to the snapshots of this call; DML returns one row, ``count``."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        kind, ctes = plan.getClass().getSimpleName(), None
        if kind == "UnresolvedWith":  # WITH before an INSERT belongs to the rows it inserts
            inner = plan.child().getClass().getSimpleName()
            if inner in ("DeleteFromTable", "UpdateTable"):
                raise Unsupported("WITH before DELETE or UPDATE is not carried out on managed tables: put the query into the condition")
            if inner == "InsertIntoStatement":
                plan, kind, ctes = plan.child(), inner, plan
        if kind in _REFUSED:
            raise Unsupported(f"{_REFUSED[kind]} is not carried out on managed tables")
        if kind in ("DeleteFromTable", "UpdateTable", "InsertIntoStatement"):
            table, alias = self._target(plan.table())
            if table is not None:
                self._views({n: None for n in self._tables if n in text.lower()})  # for queries within the statement
                return self._counted(getattr(self, f"_{kind}")(plan, table, alias, ctes))
        return self._select(text)

    def export(self, text: str, path: str, kind: str = "parquet", **options: str) -> None:
        """Write the rows of a SELECT as files of another format; the folder must not exist."""
        self._select(text).write.format(kind).options(**options).save(path)

    def explain(self, text: str) -> dict[str, ScanPlan]:
        """What the scans of a SELECT would read, by table."""
        self._select(text, True)
        return dict(self.plans)

    def _target(self, relation) -> tuple[ManagedTable | None, str | None]:
        """The managed table that a statement changes, and the name it gives to it."""
        alias = None
        while relation.getClass().getSimpleName() == "SubqueryAlias":
            alias = alias or relation.alias()
            relation = relation.child()
        parts = relation.multipartIdentifier() if hasattr(relation, "multipartIdentifier") else None
        return (self._tables.get(parts.last().lower()) if parts is not None and parts.size() == 1 else None), alias

    def _counted(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "count long")

    def _column(self, expression) -> Column:
        """The parser's own expression, as it stands."""
        return Column(self.spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def _DeleteFromTable(self, plan, table: ManagedTable, alias: str | None, _) -> int:
        # Without WHERE the parser's condition is the literal true.
        return dml.delete(table, None if plan.condition().toString() == "true" else self._column(plan.condition()), alias)

    def _UpdateTable(self, plan, table: ManagedTable, alias: str | None, _) -> int:
        seq, where = plan.assignments(), plan.condition()
        pairs = [(seq.apply(k).key(), seq.apply(k).value()) for k in range(seq.size())]
        names = [k.nameParts().last() for k, _ in pairs]
        if len({n.lower() for n in names}) < len(names):
            raise InvalidArgument("a column is set once")
        return dml.update(table, {n: self._column(v) for n, (_, v) in zip(names, pairs, strict=True)}, self._column(where.get()) if where.isDefined() else None, alias)

    def _InsertIntoStatement(self, plan, table: ManagedTable, _: str | None, ctes) -> int:
        if plan.overwrite() or plan.ifPartitionNotExists():
            raise Unsupported("INSERT OVERWRITE is not carried out on managed tables")
        query = plan.query()
        if ctes is not None:
            jvm = self.spark._jvm
            query = ctes.withNewChildren(jvm.scala.jdk.javaapi.CollectionConverters.asScala(jvm.java.util.List.of(query)).toSeq())
        rows = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, query)
        rows = DataFrame(rows, self.spark)
        schema = table.snapshot().schema
        named = plan.userSpecifiedCols()
        names = [named.apply(k) for k in range(named.size())] or schema.names
        if len(rows.columns) != len(names):
            raise Unsupported(f"{len(rows.columns)} values for {len(names)} columns")
        given = {schema.find(n).name: rows.columns[k] for k, n in enumerate(names)}
        rows = rows.toDF(*[f"v{k}" for k in range(len(names))])
        place = {c: f"v{k}" for k, c in enumerate(given)}
        columns = [f"CAST({place[f.name] if f.name in place else 'NULL'} AS {f.field.dataType.simpleString()}) AS `{f.name}`" for f in schema.fields]
        return writing.insert(table, rows.selectExpr(*columns))

    def _views(self, filters: dict[str, list[list] | None], snapshots: dict | None = None, counted: bool = False) -> None:
        for name, wanted in filters.items():
            table = self._tables[name]
            snapshot = (snapshots or {}).get(name) or table.snapshot()
            if not wanted and not counted:
                table.whole(snapshot).createOrReplaceTempView(name)
                continue
            chosen, self.plans[name] = table.choose(snapshot, wanted, counted)
            snapshot.schema.named(table.rows(chosen, snapshot)).createOrReplaceTempView(name)

    def _select(self, text: str, counted: bool = False) -> DataFrame:
        """Catalyst pushes the query's filters to plain scans first; then each table is the segments these filters leave."""
        lowered = text.lower()
        named = {n: t for n, t in self._tables.items() if n in lowered}
        snapshots, marks = {}, {}
        filtered = re.search(r"\b(where|on|using|having|filter|intersect|except)\b", lowered)  # else nothing can be skipped
        self.plans = {}
        for name, table in named.items():
            snapshots[name] = table.snapshot()
            probe = table.probe(snapshots[name]) if counted or filtered else None
            if probe is None:
                self._views({name: None}, snapshots)
            else:
                marks[name] = snapshots[name].index[0]
                probe.createOrReplaceTempView(name)
        if marks:
            plan = self.spark.sql(text)._jdf.queryExecution().optimizedPlan()
            found = {name: scan_filters(plan, mark) for name, mark in marks.items()}
            self._views(found, snapshots, counted)
        return self.spark.sql(text)
