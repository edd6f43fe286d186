"""The registered queries over managed tables, and their SQL for an outside engine.

A query names the tables it reads; each is a managed table built once for a session
from the Parquet table of that name. Queries that change a table work on one of their
own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .operators import dml, maintenance
from .operators.writing import flush, insert
from .options import TableOptions
from .sources.table import ManagedTable
from .streaming.sink import write_stream
from .workspace import new_folder

#: How the standing tables are laid out.
OPTIONS = {
    "orders": TableOptions(bloom_columns=("o_custkey",)),
    "part": TableOptions(trigram_columns=("p_name",)),
    "documents": TableOptions(trigram_columns=("text",)),
    "lineitem": TableOptions(page_rows=2048, cluster_by=("l_orderkey",)),
}
_standing: dict[tuple[str, str, str], ManagedTable] = {}
_engines: dict[str, Engine] = {}


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(spark: SparkSession, rows: DataFrame, options: TableOptions, flushed: bool = True) -> ManagedTable:
    """A new managed table of ``rows`` in the shared storage."""
    table = ManagedTable.create(spark, new_folder(spark, "table"), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]), options)
    insert(table, rows)
    if flushed:
        flush(table)
    return table


def standing(spark: SparkSession, sf_dir: str, name: str) -> ManagedTable:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _standing:
        _standing[key] = build(spark, parquet(spark, sf_dir, name), OPTIONS.get(name, TableOptions()))
    return _standing[key]


def engine(spark: SparkSession, sf_dir: str, names: list[str]) -> Engine:
    app = spark.sparkContext.applicationId
    if app not in _engines:
        _engines[app] = Engine(spark)
    for n in names:
        _engines[app].attach(n, standing(spark, sf_dir, n))
    return _engines[app]


def own(spark: SparkSession, sf_dir: str, name: str, options: TableOptions | None = None, flushed: bool = True) -> tuple[Engine, ManagedTable]:
    """An engine with a table of its own under the name, for queries that change it."""
    e = Engine(spark)
    return e, e.attach(name, build(spark, parquet(spark, sf_dir, name), options or TableOptions(row_group_rows=8192, min_row_group_rows=256), flushed))


# --- queries that read: name -> (tables, SQL for both engines) or (tables, Spark's, the other's) ---

DEC = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


def _total(column: str) -> str:
    """A sum that does not depend on the order of addition."""
    return DEC.format(column)


READS: dict[str, tuple] = {
    "scan_full": ("lineitem", "SELECT * FROM lineitem"),
    "scan_projection": ("orders", "SELECT o_orderkey, o_orderpriority FROM orders"),
    "filter_range": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12"),
    "prune_zone_map": ("lineitem", f"SELECT count(*) AS n, {_total('l_extendedprice')} AS total FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 1200"),
    "prune_bloom_eq": ("orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37"),
    "prune_bloom_in": ("orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (3, 7, 1000000)"),
    "prune_pages": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 777"),
    "count_star": ("lineitem", "SELECT count(*) AS n FROM lineitem"),
    "filter_and_or": ("lineitem", "SELECT count(*) AS n FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity > 30) OR (l_linestatus = 'O' AND l_discount < 0.02)"),
    "filter_in": ("part", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)"),
    "filter_is_null": ("events", "SELECT count(*) AS n FROM events WHERE props IS NULL OR value IS NULL"),
    "filter_modulo": ("orders", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3"),
    "filter_between": ("orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 5000"),
    "filter_null_literal": ("orders", "SELECT count(*) AS n FROM orders WHERE o_custkey = NULL"),
    "like_substring": ("documents", "SELECT doc_id FROM documents WHERE text LIKE '%idiot%'"),
    "like_prefix": ("part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'sm%'"),
    "like_underscore": ("part", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_1'"),
    "not_like": ("documents", "SELECT doc_id FROM documents WHERE text NOT LIKE '%the%'"),
    "ilike": ("documents", "SELECT doc_id FROM documents WHERE text ILIKE '%IDIOT%'"),
    "like_escape": ("documents", "SELECT doc_id FROM documents WHERE text LIKE '%!%%' ESCAPE '!'"),
    "filter_regex": ("part", "SELECT p_partkey FROM part WHERE p_type RLIKE '^[A-M].*Y$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-M].*Y$')"),
    "case_when": ("orders", "SELECT CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1"),
    "in_subquery": ("orders customer", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "scalar_subquery": ("orders", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "subquery_exists": ("customer orders", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)"),
    "subquery_not_exists": ("customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"),
    "join_inner": ("orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3"),
    "join_three": ("customer nation region", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "join_left": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "join_right": ("nation supplier", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey"),
    "join_full": ("nation supplier", "SELECT n_nationkey, s_suppkey FROM nation FULL OUTER JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0"),
    "join_semi": ("supplier nation", "SELECT n_name FROM nation LEFT SEMI JOIN supplier ON s_nationkey = n_nationkey", "SELECT n_name FROM nation SEMI JOIN supplier ON s_nationkey = n_nationkey"),
    "join_anti": ("supplier nation", "SELECT n_name FROM nation LEFT ANTI JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000", "SELECT n_name FROM nation ANTI JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000"),
    "join_theta": ("nation region", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "join_cross": ("nation region", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region"),
    "join_self": ("nation", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_lateral": ("region nation", "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x"),
    "agg_global": ("lineitem", f"SELECT count(*) AS n, {_total('l_quantity')} AS total, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem"),
    "agg_count_col": ("events", "SELECT count(value) AS n, count(props) AS p FROM events"),
    "agg_group_by": ("lineitem", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_total('l_extendedprice')} AS total FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_max_length": ("documents", "SELECT CAST(max(character_length(text)) AS BIGINT) AS longest FROM documents", "SELECT CAST(max(length(text)) AS BIGINT) AS longest FROM documents"),
    "agg_stats": ("lineitem", "SELECT round(avg(l_quantity), 4) AS mean, round(stddev(l_quantity), 4) AS sd, round(var_samp(l_quantity), 3) AS var, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem"),
    "agg_median": ("orders", "SELECT o_orderstatus, round(median(o_totalprice), 2) AS mid FROM orders GROUP BY o_orderstatus"),
    "agg_bits": ("orders", "SELECT bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x, bool_and(o_totalprice > 0) AS every FROM orders"),
    "agg_collect": ("nation", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_distinct": ("lineitem", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem"),
    "agg_having": ("orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "agg_filter": ("lineitem", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "agg_cube": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "agg_grouping_sets": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "agg_date": ("orders", "SELECT year(o_orderdate) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1, 2", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM orders GROUP BY 1, 2"),
    "window_rank": ("orders", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"),
    "window_frame": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events"),
    "window_lag": ("events", "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "window_ntile": ("part", "SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS quarter FROM part"),
    "sort": ("nation", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name DESC"),
    "limit": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100"),
    "topk": ("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10"),
    "offset": ("orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25"),
    "set_union": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_union_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "set_intersect": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "set_except": ("nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000"),
    "set_intersect_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "set_except_all": ("customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "limit_plain": ("lineitem", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 5000)"),
    "agg_approx": (
        "orders lineitem",
        "SELECT abs(a - e) <= 0.1 * e AS distinct_near, p BETWEEN low AND high AS median_near FROM (SELECT approx_count_distinct(o_custkey) AS a, count(DISTINCT o_custkey) AS e, percentile_approx(o_totalprice, 0.5, 1000) AS p, percentile(o_totalprice, 0.48) AS low, percentile(o_totalprice, 0.52) AS high FROM orders)",
        "SELECT abs(a - e) <= 0.1 * e AS distinct_near, p BETWEEN low AND high AS median_near FROM (SELECT count(DISTINCT o_custkey) AS a, count(DISTINCT o_custkey) AS e, median(o_totalprice) AS p, quantile_cont(o_totalprice, 0.48) AS low, quantile_cont(o_totalprice, 0.52) AS high FROM orders)",
    ),
    "fn_json": ("events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "fn_map": (
        "orders",
        "SELECT o_orderkey, m['status'] AS status, size(m) AS n, array_join(sort_array(map_keys(m)), ',') AS keys FROM (SELECT o_orderkey, map('status', o_orderstatus, 'priority', o_orderpriority) AS m FROM orders)",
        "SELECT o_orderkey, m['status'] AS status, CAST(cardinality(m) AS INT) AS n, array_to_string(list_sort(map_keys(m)), ',') AS keys FROM (SELECT o_orderkey, MAP {'status': o_orderstatus, 'priority': o_orderpriority} AS m FROM orders)",
    ),
    "fn_struct": (
        "customer",
        "SELECT c_custkey, s.name AS name, s.at.nation AS nation FROM (SELECT c_custkey, named_struct('name', c_name, 'at', named_struct('nation', c_nationkey, 'segment', c_mktsegment)) AS s FROM customer) WHERE s.at.segment = 'BUILDING'",
        "SELECT c_custkey, s.name AS name, s.at.nation AS nation FROM (SELECT c_custkey, {'name': c_name, 'at': {'nation': c_nationkey, 'segment': c_mktsegment}} AS s FROM customer) WHERE s.at.segment = 'BUILDING'",
    ),
    "distinct": ("orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "cte": ("orders customer", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "values_list": ("nation", "SELECT n_name, v.w FROM nation JOIN (VALUES (0, 'a'), (1, 'b')) AS v(k, w) ON n_regionkey = v.k"),
    "fn_string": ("customer", "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 3, 4) AS s, length(c_name) AS n, replace(c_name, '0', 'o') AS r, concat(c_mktsegment, '-', c_custkey) AS j, lpad(c_mktsegment, 12, '*') AS p, reverse(c_mktsegment) AS b FROM customer", "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 3, 4) AS s, CAST(length(c_name) AS INT) AS n, replace(c_name, '0', 'o') AS r, concat(c_mktsegment, '-', c_custkey) AS j, lpad(c_mktsegment, 12, '*') AS p, reverse(c_mktsegment) AS b FROM customer"),
    "fn_strpos": ("customer", "SELECT c_custkey, strpos(c_name, '1') AS p FROM customer", "SELECT c_custkey, CAST(strpos(c_name, '1') AS INT) AS p FROM customer"),
    "fn_date": ("orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS d, CAST(o_orderdate AS DATE) AS day FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofyear(o_orderdate) AS INT) AS d, CAST(o_orderdate AS DATE) AS day FROM orders"),
    "fn_math": ("lineitem", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05D) AS a, floor(l_quantity) AS f, round(sqrt(l_quantity), 6) AS r, CAST(l_partkey AS BIGINT) div 7 AS q, l_partkey % 7 AS m FROM lineitem", "SELECT l_orderkey, l_linenumber, abs(l_discount - CAST(0.05 AS DOUBLE)) AS a, CAST(floor(l_quantity) AS BIGINT) AS f, round(sqrt(l_quantity), 6) AS r, l_partkey // 7 AS q, l_partkey % 7 AS m FROM lineitem"),
    "fn_conditional": ("events", "SELECT event_id, coalesce(value, -1.0D) AS v, nullif(event_type, 'click') AS t, greatest(event_id, user_id) AS g, least(event_id, user_id) AS l FROM events", "SELECT event_id, coalesce(value, CAST(-1.0 AS DOUBLE)) AS v, nullif(event_type, 'click') AS t, greatest(event_id, user_id) AS g, least(event_id, user_id) AS l FROM events"),
    "fn_array": ("embeddings", "SELECT vec_id, size(embedding) AS n, CAST(embedding[0] AS DOUBLE) AS first, CAST(array_max(embedding) AS DOUBLE) AS top FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings"),
    "fn_explode": ("documents", "SELECT doc_id, word FROM (SELECT doc_id, explode(split(lang || '-' || source, '-')) AS word FROM documents)", "SELECT doc_id, unnest(string_split(lang || '-' || source, '-')) AS word FROM documents"),
    "fn_cast": ("orders", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(o_totalprice AS BIGINT) AS b, CAST(o_orderdate AS DATE) AS d FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(trunc(o_totalprice) AS BIGINT) AS b, CAST(o_orderdate AS DATE) AS d FROM orders"),
    "nested_array_roundtrip": ("embeddings", "SELECT vec_id, label, embedding FROM embeddings"),
    "tpch_pricing": ("lineitem", f"SELECT l_returnflag, l_linestatus, {_total('l_quantity')} AS sum_qty, {_total('l_extendedprice')} AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY 1, 2", f"SELECT l_returnflag, l_linestatus, {_total('l_quantity')} AS sum_qty, {_total('l_extendedprice')} AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2"),
    "tpch_revenue": ("lineitem orders customer", f"SELECT c_mktsegment, {_total('l_extendedprice')} AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP_NTZ '1995-03-15 00:00:00' GROUP BY c_mktsegment", f"SELECT c_mktsegment, {_total('l_extendedprice')} AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1995-03-15 00:00:00' GROUP BY c_mktsegment"),
}


def _read(tables: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, tables.split()).sql(text)


# --- queries that change a table of their own, or need more than SQL ---


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "orders").groupBy("o_orderstatus").count().withColumnRenamed("count", "n")


def count_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(standing(spark, sf_dir, "lineitem").row_count(),)], "n long")


def scan_staged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "events")
    e = Engine(spark)
    table = e.attach("events", build(spark, rows.where("event_id % 2 = 0"), TableOptions()))
    insert(table, rows.where("event_id % 2 != 0"))
    return e.sql("SELECT event_id, user_id, event_type FROM events")


def zorder_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = TableOptions(cluster_by=("l_partkey", "l_suppkey"), row_group_rows=8192, min_row_group_rows=1024)
    e, _ = own(spark, sf_dir, "lineitem", options)
    return e.sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey BETWEEN 10 AND 60 AND l_suppkey BETWEEN 2 AND 5")


def _changed(name: str, *statements: str, select: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, _ = own(spark, sf_dir, name)
        for s in statements:
            e.sql(s)
        return e.sql(select)

    return run


def _maintained(name: str, change: Callable[[ManagedTable], object], select: str, options: TableOptions | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, table = own(spark, sf_dir, name, options)
        change(table)
        return e.sql(select)

    return run


def _delete_then(*more):
    def run(table: ManagedTable) -> None:
        dml.delete(table, "o_orderkey % 3 != 0")
        for m in more:
            m(table)

    return run


def snapshot_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, table = own(spark, sf_dir, "orders")
    pinned = e.sql("SELECT count(*) AS n, min(o_orderkey) AS low FROM orders")
    dml.delete(table, "o_orderkey < 500")
    maintenance.compact(table, 0.0)
    return pinned


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "events")
    source = new_folder(spark, "stream-source")
    rows.repartition(3).write.parquet(source)
    table = ManagedTable.create(spark, new_folder(spark, "table"), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    write_stream(table, stream, new_folder(spark, "stream-checkpoint"), "events", availableNow=True).awaitTermination()
    return table.scan().groupBy("event_type").count().withColumnRenamed("count", "n")


def filter_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate that no statistics answer, beside one that they do."""
    spark.udf.register("last_digit", F.udf(lambda k: k % 10, "long"))
    return engine(spark, sf_dir, ["orders"]).sql("SELECT o_orderkey FROM orders WHERE last_digit(o_orderkey) = 4 AND o_custkey < 500")


def write_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows through tables of two codecs."""
    rows = parquet(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    tables = [build(spark, rows, TableOptions(compression=c)) for c in ("lz4", "zstd")]
    return tables[0].scan().unionAll(tables[1].scan())


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query gives, written as plain files and read back as any other source."""
    path = new_folder(spark, "export")
    engine(spark, sf_dir, ["orders"]).export("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'", path, "csv", header="true")
    return spark.read.schema("o_orderkey long, o_totalprice double").option("header", "true").csv(path)


def prune_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments each predicate leaves to read and skips, as the scan's plan shows it."""
    asked = [
        ("lineitem", "l_orderkey BETWEEN 1000 AND 1200"), ("lineitem", "l_quantity > 0"), ("lineitem", "l_orderkey < 0"), ("orders", "o_custkey = 37"),
        ("orders", "o_orderkey IN (1, 2)"), ("documents", "text LIKE '%no such words%'"), ("part", "p_name LIKE '%zzz%'"),
    ]
    plans = [(name, where, standing(spark, sf_dir, name).explain(where)) for name, where in asked]
    return spark.createDataFrame([(n, w, p.segments, p.pruned) for n, w, p in plans], "table_name string, predicate string, segments long, pruned long")


def _file_source(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parquet(spark, sf_dir, "customer")
        path = new_folder(spark, f"source-{kind}")
        writer = rows.write.format(kind)
        (writer.option("header", "true") if kind == "csv" else writer).save(path)
        reader = spark.read.schema(rows.schema).format(kind)
        return (reader.option("header", "true") if kind == "csv" else reader).load(path)

    return run


_CUSTOMERS = "SELECT * FROM customer"
CHANGES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "scan_parquet": (scan_parquet, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    "source_csv": (_file_source("csv"), _CUSTOMERS),
    "source_json": (_file_source("json"), _CUSTOMERS),
    "source_orc": (_file_source("orc"), _CUSTOMERS),
    "count_metadata": (count_metadata, "SELECT count(*) AS n FROM lineitem"),
    "scan_staged_union": (scan_staged_union, "SELECT event_id, user_id, event_type FROM events"),
    "zorder_box": (zorder_box, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey BETWEEN 10 AND 60 AND l_suppkey BETWEEN 2 AND 5"),
    "delete_where": (_changed("orders", "DELETE FROM orders WHERE o_totalprice > 50000 AND o_orderstatus != 'P'", select="SELECT * FROM orders"), "SELECT * FROM orders WHERE NOT coalesce(o_totalprice > 50000 AND o_orderstatus != 'P', false)"),
    "delete_commented": (_changed("orders", "DELETE FROM orders -- it's (not all\n WHERE o_orderkey % 5 = 2 /* where ' */", "DELETE FROM orders /* don't ( */ AS x WHERE x.o_orderkey % 5 = 3", select="SELECT * FROM orders"), "SELECT * FROM orders WHERE o_orderkey % 5 NOT IN (2, 3)"),
    "update_commented": (_changed("customer", "UPDATE customer AS x SET x.c_mktsegment = 'a where (' -- it's (\n WHERE x.c_nationkey = 3", select="SELECT c_custkey, c_mktsegment FROM customer"), "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'a where (' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "insert_cte": (_changed("nation", "WITH c AS (SELECT n_nationkey + 100 AS k, n_name, n_regionkey FROM nation WHERE n_regionkey = 1) INSERT INTO nation SELECT * FROM c", select="SELECT * FROM nation"), "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1"),
    "filter_udf": (filter_udf, "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 4 AND o_custkey < 500"),
    "write_codecs": (write_codecs, "SELECT p_partkey, p_name, p_retailprice FROM part UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part"),
    "export_csv": (export_csv, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"),
    "delete_all": (_changed("nation", "DELETE FROM nation", select="SELECT * FROM nation"), "SELECT * FROM nation WHERE false"),
    "scan_after_delete": (_changed("lineitem", "DELETE FROM lineitem WHERE l_orderkey < 300", select="SELECT * FROM lineitem"), "SELECT * FROM lineitem WHERE l_orderkey >= 300"),
    "update_expr": (_changed("customer", "UPDATE customer SET c_acctbal = c_acctbal + 1, c_mktsegment = 'MOVED' WHERE c_nationkey < 5", select="SELECT c_custkey, c_acctbal, c_mktsegment FROM customer"), "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey < 5 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "update_null": (_changed("customer", "UPDATE customer SET c_mktsegment = NULL WHERE c_custkey % 2 = 0", select="SELECT c_custkey, c_mktsegment FROM customer"), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "insert_select": (_changed("nation", "INSERT INTO nation SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1", select="SELECT * FROM nation"), "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1"),
    "insert_values": (_changed("nation", "INSERT INTO nation VALUES (200, 'NOWHERE', 0), (201, NULL, NULL)", select="SELECT * FROM nation"), "SELECT * FROM nation UNION ALL VALUES (200, 'NOWHERE', 0), (201, NULL, NULL)"),
    "compact_after_delete": (_maintained("orders", _delete_then(lambda t: maintenance.compact(t, 0.5)), "SELECT * FROM orders"), "SELECT * FROM orders WHERE o_orderkey % 3 = 0"),
    "rewrite_all_zorder": (_maintained("orders", _delete_then(maintenance.rewrite_all), "SELECT * FROM orders", TableOptions(cluster_by=("o_custkey", "o_orderdate"), row_group_rows=1024, min_row_group_rows=256)), "SELECT * FROM orders WHERE o_orderkey % 3 = 0"),
    "vacuum_after_rewrite": (_maintained("orders", _delete_then(maintenance.rewrite_all, lambda t: t.vacuum()), "SELECT count(*) AS n FROM orders"), "SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 = 0"),
    "add_column_null": (_maintained("supplier", lambda t: maintenance.add_column(t, T.StructField("s_note", T.StringType())), "SELECT * FROM supplier"), "SELECT *, CAST(NULL AS VARCHAR) AS s_note FROM supplier"),
    "rename_column": (_maintained("supplier", lambda t: maintenance.rename_column(t, "s_name", "s_label"), "SELECT s_suppkey, s_label FROM supplier"), "SELECT s_suppkey, s_name AS s_label FROM supplier"),
    "drop_column": (_maintained("supplier", lambda t: maintenance.drop_column(t, "s_acctbal"), "SELECT * FROM supplier"), "SELECT s_suppkey, s_name, s_nationkey FROM supplier"),
    "cast_column_widen": (_maintained("supplier", lambda t: maintenance.cast_column(t, "s_nationkey", "long"), "SELECT s_suppkey, s_nationkey FROM supplier"), "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier"),
    "snapshot_isolation": (snapshot_isolation, "SELECT count(*) AS n, min(o_orderkey) AS low FROM orders"),
    "delete_in_subquery": (_changed("orders", "DELETE FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)", select="SELECT o_orderkey FROM orders"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)"),
    "prune_report": (prune_report, None),
    "stream_append": (stream_append, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _read(spec[0], spec[1]) for name, spec in READS.items()} | {name: run for name, (run, _) in CHANGES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: spec[-1] for name, spec in READS.items()} | {name: sql for name, (_, sql) in CHANGES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a key range, from the segments that can hold them."""
    return queries()["prune_zone_map"](spark, sf_dir)
