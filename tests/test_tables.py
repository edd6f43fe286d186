"""Managed tables end to end: scans, pruning, DML, layout, maintenance, schema changes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtable.engine import Engine
from segtable.errors import InvalidArgument, ReadOnly, SchemaMismatch, Unsupported
from segtable.operators import dml, maintenance
from segtable.operators.writing import flush, insert
from segtable.options import TableOptions
from segtable.sources import log
from segtable.sources.table import MERGE_DELETES, ManagedTable, units

ONE_GROUP = dict(row_group_rows=100, min_row_group_rows=100)


def scan_schema():
    return T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("score", T.IntegerType())])


def rows(spark, a, b):
    name = F.when(F.col("id") % 7 != 0, F.concat(F.lit("name-"), F.col("id").cast("string")))
    return spark.range(a, b).select("id", name.alias("name"), (F.col("id") % 100).cast("int").alias("score"))


def made(spark, path, segments, staged=0, **options):
    engine = Engine(spark)
    table = engine.create("t", str(path), scan_schema(), TableOptions(**(ONE_GROUP | options)))
    for k in range(segments):
        insert(table, rows(spark, k * 100, k * 100 + 100))
        flush(table)
    if staged:
        insert(table, rows(spark, segments * 100, segments * 100 + staged))
    return engine, table


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_scan_prunes_by_range_and_loses_nothing(spark, tmp_path):
    engine, table = made(spark, tmp_path / "t", 8, 40)
    plan = table.explain("id = 550")
    assert (plan.pruned, plan.segments) == (7, 1) and plan.staged > 0
    assert table.explain("id > 100000").segments == 0
    assert table.explain("id >= 0").pruned == 0
    for a in range(0, 840, 37 * 4):
        assert ids(engine.sql(f"select id from t where id >= {a} and id < {a + 37}")) == list(range(a, min(a + 37, 840)))
    r = engine.sql("select count(*) n, min(id) a, max(id) b, sum(id) s, count(name) c from t").first()
    assert (r.n, r.a, r.b, r.s) == (840, 0, 839, sum(range(840)))
    assert engine.sql("select id from t where name is null").count() == len([i for i in range(840) if i % 7 == 0])
    assert table.row_count() == 840
    for n in (1, 100, 840, 5000):
        assert engine.sql(f"select * from t limit {n}").count() == min(n, 840)
    assert "pruned=7" in str(plan)


def test_a_plan_keeps_its_snapshot(spark, tmp_path):
    engine, table = made(spark, tmp_path / "t", 2)
    before = engine.sql("select count(*) n from t")
    insert(table, rows(spark, 200, 300))
    flush(table)
    assert before.first().n == 200
    assert engine.sql("select count(*) n from t").first().n == 300
    dml.delete(table, "id < 150")
    maintenance.compact(table, 0.0)
    assert before.first().n == 200


def test_join_and_other_views(spark, tmp_path):
    engine, _ = made(spark, tmp_path / "t", 2)
    spark.range(50, 150).createOrReplaceTempView("u")
    assert ids(engine.sql("select t.id from t join u on t.id = u.id")) == list(range(50, 150))
    assert engine.explain("select * from t where exists (select 1 from u where u.id = t.id and u.id > 120) and t.id >= 100")["t"].pruned == 1


@pytest.fixture
def keyed(spark, tmp_path):
    def build(**options):
        engine = Engine(spark)
        schema = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("email", T.StringType())])
        table = engine.create("k", str(tmp_path / f"k{len(options)}"), schema, TableOptions(**(ONE_GROUP | options)))
        for k in range(10):
            insert(table, spark.range(100).select((F.col("id") * 10 + k).alias("key")).select("key", F.format_string("user%d@example.com", "key").alias("email")))
            flush(table)
        return engine, table

    return build


def test_membership_filters(spark, keyed):
    _, plain = keyed()
    assert plain.explain("key = 550").pruned == 0
    engine, table = keyed(bloom_columns=("*",))
    assert table.explain("key = 550").pruned >= 8
    assert table.explain("email = 'nobody@example.com'").pruned >= 9
    assert table.explain("key IN (3, 7)").pruned >= 7
    assert ids(engine.sql("select key id from k where key in (3, 7)")) == [3, 7]
    for key in range(0, 1000, 83):
        assert engine.sql(f"select * from k where key = {key}").count() == 1
    assert engine.sql("select * from k where key > 100 and key < 110").count() == 9
    assert engine.sql("select * from k where key = 1.5").count() == 0
    reopened = ManagedTable.open(spark, table.storage.root, TableOptions(**ONE_GROUP))
    assert reopened.explain("key = 550").pruned >= 8
    maintenance.rewrite_all(reopened)
    assert reopened.explain("key = 550").pruned == 0
    again = ManagedTable.open(spark, table.storage.root, TableOptions(**ONE_GROUP, bloom_columns=("key",)))
    maintenance.rewrite_all(again)
    assert again.explain("email = 'user555x@example.com'").pruned == 0


def test_substring_filters(spark, tmp_path):
    engine = Engine(spark)
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("body", T.StringType())])
    table = engine.create("b", str(tmp_path / "b"), schema, TableOptions(**ONE_GROUP, trigram_columns=("body",)))
    for k in range(10):
        insert(table, spark.range(100).select((F.lit(k * 100) + F.col("id")).alias("id"), F.format_string(f"segment{k} entry%d common-filler-text", "id").alias("body")))
        flush(table)
    expected = [
        ("body LIKE '%segment7 %'", 8, 100), ("body LIKE 'segment7 %'", 8, 100), ("body LIKE '%zzzqqqxxx%'", 9, 0), ("body LIKE '%common%zzzqqq%'", 9, 0),
        ("body LIKE '%common-filler%'", 0, 1000), ("body LIKE '%q%'", 0, 0), ("body NOT LIKE '%segment7 %'", 0, 900), ("body ILIKE '%SEGMENT7 %'", 0, 100),
        (r"body LIKE '%seg!%ment%' ESCAPE '!'", 0, 0), ("body LIKE '%segment7 %' OR body LIKE '%segment2 %'", 0, 200), ("body LIKE '%segment7 %' AND body LIKE '%zzzqqq%'", 9, 0),
    ]
    for predicate, pruned, count in expected:
        found = table.explain(predicate).pruned
        assert found >= pruned if pruned else found == 0, predicate
        assert engine.sql(f"select * from b where {predicate}").count() == count, predicate
    insert(table, spark.createDataFrame([(5000, "a marker of 100% here")], "id long, body string"))
    assert engine.sql("select * from b where body like '%marker%'").count() == 1
    assert engine.sql(r"select * from b where body like '%100\\%%'").count() == 1


def test_dml(spark, tmp_path):
    engine = Engine(spark)
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("score", T.IntegerType())])
    table = engine.create("d", str(tmp_path / "d"), schema, TableOptions(**ONE_GROUP))
    count = lambda text: engine.sql(text).first()[0]
    assert count("INSERT INTO d VALUES (1, 'a', 10), (2, 'b', 20), (3, NULL, 30)") == 3
    assert count("INSERT INTO d SELECT * FROM d WHERE id > 100") == 0
    assert count("INSERT INTO d (score, id) VALUES (7, 9)") == 1
    assert count("DELETE FROM d WHERE name = 'nobody'") == 0
    assert count("DELETE FROM d WHERE name = 'a' OR id = 9") == 2
    assert count("UPDATE d SET score = score + 1 WHERE d.id = 2") == 1
    assert count("UPDATE d SET score = NULL WHERE id = 3") == 1
    assert sorted(map(tuple, engine.sql("select * from d").collect())) == [(2, "b", 21), (3, None, None)]
    flush(table)
    insert(table, rows(spark, 10, 20))
    assert count("DELETE FROM d WHERE id >= 15 OR id = 2") == 6
    assert count("DELETE FROM d WHERE score > 1000") == 0
    assert ids(engine.sql("select id from d")) == [3, 10, 11, 12, 13, 14]
    assert ids(ManagedTable.open(spark, table.storage.root).scan()) == [3, 10, 11, 12, 13, 14]
    with pytest.raises(Exception, match="(?i)overflow|cast|malformed"):
        engine.sql("UPDATE d SET score = id * 10000000000 WHERE id = 10")
    with pytest.raises(SchemaMismatch):
        dml.update(table, {"nothing": "1"})
    with pytest.raises(Exception, match="(?i)null"):
        engine.sql("UPDATE d SET id = NULL")
    assert count("UPDATE d SET score = 0") == 6
    assert engine.sql("select sum(score) s, count(*) n from d").first() == (0, 6)
    assert count("DELETE FROM d") == 6
    assert engine.sql("select * from d").count() == 0
    for text in ("INSERT OVERWRITE d VALUES (1, 'a', 1)", "MERGE INTO d USING u ON d.id = u.id WHEN MATCHED THEN DELETE"):
        with pytest.raises(Unsupported):
            engine.sql(text)


def test_low_level_deletes(spark, tmp_path):
    _, table = made(spark, tmp_path / "t", 2)
    first = table.scan("id = 0", positions=True).first()
    positions = spark.createDataFrame([(first.segment, 0), (first.segment, 5), (first.segment, 10_000)], "segment string, row_index long")
    assert dml.delete_positions(table, positions) == 2
    assert dml.delete_positions(table, positions) == 0
    with pytest.raises(SchemaMismatch):
        dml.delete_positions(table, spark.createDataFrame([("none", 0)], "segment string, row_index long"))
    assert table.row_count() == table.scan().count() == 198
    assert dml.update_rows(table, positions.limit(0), rows(spark, 500, 502)) == 2
    assert dml.update_rows(table, spark.createDataFrame([(first.segment, 7)], "segment string, row_index long"), rows(spark, 7, 8)) == 1
    assert table.row_count() == table.scan().count() == 200 and table.scan("id = 7").count() == 1
    assert dml.delete(table, "id >= 500 or id = 7") == 3
    assert dml.delete_segments(table, [first.segment]) == 1
    assert ids(table.scan()) == list(range(100, 200))


def test_zorder(spark, tmp_path):
    schema = T.StructType([T.StructField(n, T.LongType(), False) for n in ("x", "y", "payload")])
    grid = spark.range(128 * 128).select((F.col("id") % 128).alias("x"), F.floor(F.col("id") / 128).alias("y"), ((F.col("id") % 128) * 128 + F.floor(F.col("id") / 128)).alias("payload"))
    pruned = {}
    for name, cluster in (("plain", ()), ("z", ("x", "y"))):
        table = ManagedTable.create(spark, str(tmp_path / name), schema, TableOptions(row_group_rows=2048, min_row_group_rows=1024, cluster_by=cluster))
        insert(table, grid.coalesce(1))
        flush(table)
        pruned[name] = [table.explain(f"{c} = 64").pruned for c in "xy"]
        assert table.scan("x = 64 AND y = 64").count() == 1
        assert table.scan("x = 64").count() == 128
    assert pruned["plain"][0] == 0 and min(pruned["z"]) > 0 and sum(pruned["z"]) > sum(pruned["plain"])
    with pytest.raises(InvalidArgument):
        ManagedTable.create(spark, str(tmp_path / "bad"), schema, TableOptions(cluster_by=("x", "x")))
    with pytest.raises(SchemaMismatch):
        ManagedTable.create(spark, str(tmp_path / "bad"), schema, TableOptions(cluster_by=("none",)))


@pytest.mark.parametrize("cluster", [(), ("score",)])
def test_many_small_segments_take_few_tasks(spark, tmp_path, monkeypatch, cluster):
    """Neither tasks of a layout nor paths that a rewrite lists grow with the number of small segments."""
    before = [spark.conf.get(f"spark.sql.{c}") for c in ("files.openCostInBytes", "execution.rangeExchange.sampleSizePerPartition")]
    engine = Engine(spark)
    table = engine.create("t", str(tmp_path / "t"), scan_schema(), TableOptions(row_group_rows=4, min_row_group_rows=4, cluster_by=cluster))
    insert(table, rows(spark, 0, 2400))
    assert flush(table) == 2400
    segments = sorted(table.index().collect(), key=lambda r: r.segment)
    assert len({r.segment[:10] for r in segments}) <= 64  # part-00000 and so on: a task each
    assert 600 <= len(segments) <= 664 and max(r.rows for r in segments) <= 4 and sum(r.rows for r in segments) == 2400
    key = "c2" if cluster else "c0"
    assert all(a[f"max_{key}"] <= b[f"min_{key}"] for a, b in zip(segments, segments[1:]))
    assert table.explain(f"{cluster[0] if cluster else 'id'} = 50").pruned > 500
    listed, files = [], ManagedTable.files
    monkeypatch.setattr(ManagedTable, "files", lambda self, paths, schema: listed.append(len(paths)) or files(self, paths, schema))
    assert dml.delete(table, "id % 3 != 0") == 1600
    chosen = table.choose(table.snapshot(), None)[0]
    assert table.live_rows(chosen, table.snapshot()) == table.row_count() == 800
    done = maintenance.rewrite_all(table)
    assert (done.segments, done.runs, done.stale) == (len(segments), 1, 0) and max(listed) == 1
    assert ids(engine.sql("SELECT * FROM t")) == list(range(0, 2400, 3)) and not table.snapshot().deletes
    assert before == [spark.conf.get(f"spark.sql.{c}") for c in ("files.openCostInBytes", "execution.rangeExchange.sampleSizePerPartition")]


def test_compaction(spark, tmp_path):
    _, table = made(spark, tmp_path / "t", 4)
    dml.delete(table, "id < 100 or (id >= 100 and id < 180)")
    assert maintenance.compact(table, 0.5).segments == 2
    assert table.row_count() == 220 and ids(table.scan()) == list(range(180, 400))
    assert table.detail().count() == 3 and not table.snapshot().deletes
    small = ManagedTable.open(spark, table.storage.root, TableOptions(**ONE_GROUP, compaction_max_bytes=1))
    done = maintenance.rewrite_all(small)
    assert done.runs == done.segments == 3
    assert table.vacuum() > 0 and ids(table.scan()) == list(range(180, 400))


def test_schema_changes(spark, tmp_path):
    engine, table = made(spark, tmp_path / "t", 2, 10, bloom_columns=("id",))
    maintenance.add_column(table, T.StructField("extra", T.DoubleType()))
    assert engine.sql("select count(*) n, count(extra) e from t").first() == (210, 0)
    maintenance.rename_column(table, "name", "label")
    assert engine.sql("select count(label) n from t").first().n == 180
    with pytest.raises(Exception, match="name"):
        engine.sql("select name from t").count()
    old = engine.sql("select label from t")
    maintenance.drop_column(table, "label")
    assert old.count() == 210
    maintenance.add_column(table, T.StructField("label", T.StringType()))
    assert engine.sql("select count(label) n from t").first().n == 0
    maintenance.cast_column(table, "score", "long")
    assert dict(engine.sql("select * from t").dtypes)["score"] == "bigint"
    assert table.explain("id = 150").pruned >= 1 and engine.sql("select sum(id) s from t").first().s == sum(range(210))
    insert(table, spark.createDataFrame([(1000, 5_000_000_000, 1.5, "x")], "id long, score long, extra double, label string"))
    with pytest.raises(Exception, match="(?i)overflow|cast"):
        maintenance.cast_column(table, "score", "int")
    assert dict(table.scan().dtypes)["score"] == "bigint" and table.row_count() == 211
    for bad in (lambda: maintenance.add_column(table, T.StructField("id", T.LongType())), lambda: maintenance.add_column(table, T.StructField("q", T.LongType(), False)), lambda: maintenance.rename_column(table, "score", "extra")):
        with pytest.raises(InvalidArgument):
            bad()


def test_opening(spark, tmp_path):
    _, table = made(spark, tmp_path / "t", 1)
    path = table.storage.root
    with pytest.raises(InvalidArgument):
        ManagedTable.create(spark, path, scan_schema())
    assert ManagedTable.open_or_create(spark, path, scan_schema()).row_count() == 100
    with pytest.raises(SchemaMismatch):
        ManagedTable.open_or_create(spark, path, T.StructType([T.StructField("z", T.LongType())]))
    reader = ManagedTable.open(spark, path, TableOptions(read_only=True))
    with pytest.raises(ReadOnly):
        insert(reader, rows(spark, 0, 1))
    with pytest.raises(SchemaMismatch):
        insert(table, spark.range(3))


def test_torn_commit_is_passed_over(spark, tmp_path):
    _, table = made(spark, tmp_path / "t", 1)
    last = table.snapshot().txn
    table.storage.create(f"_log/{last + 1:020d}.json", b'{"sha256": "x", "body": "{', True)
    assert table.snapshot().txn == last and table.row_count() == 100
    insert(table, rows(spark, 100, 110))
    assert table.row_count() == 110


def test_lost_race_starts_afresh(spark, tmp_path):
    _, table = made(spark, tmp_path / "t", 1)
    base = table.snapshot()
    insert(table, rows(spark, 100, 110))
    assert log.commit(table.storage, base, rows=0) is None
    assert dml.delete(table, "id >= 105") == 5 and table.row_count() == 105


def test_floats_nulls_and_nested(spark, tmp_path):
    engine = Engine(spark)
    ddl = "f double, s string, a array<double>, m map<string,int>, d decimal(10,2), t timestamp_ntz, b boolean"
    df = spark.sql("select * from values (-0.0D, 'x', array(1.0D), map('k', 1), 1.25, timestamp_ntz'2020-01-01 00:00:00', true), (0.0D, '', array(), map(), null, null, null), (double('nan'), null, null, null, -3.5, null, false) v(f, s, a, m, d, t, b)")
    df = df.select(*[F.col(c).cast(k) for c, k in (x.split(" ", 1) for x in ddl.split(", "))])
    table = engine.create("n", str(tmp_path / "n"), df.schema, TableOptions(bloom_columns=("f", "s"), trigram_columns=("s",)))
    insert(table, df)
    flush(table)
    assert engine.sql("select * from n where f = 0").count() == 2
    assert engine.sql("select * from n where f > 1e300").count() == 1  # NaN is the largest
    assert engine.sql("select * from n where s is null").count() == 1
    assert engine.sql("select * from n where size(a) = 0").count() == 1
    assert table.explain("d > 100").segments == 0 and engine.sql("select * from n where d < 0").count() == 1
    assert table.explain("t > timestamp_ntz'2021-01-01 00:00:00'").segments == 0
    assert table.explain("s > 'y'").segments == 0


def test_stream_appends_each_batch_once(spark, tmp_path):
    from segtable.streaming.sink import write_stream

    source = str(tmp_path / "source")
    rows(spark, 0, 50).write.parquet(source)
    table = ManagedTable.create(spark, str(tmp_path / "s"), T.StructType([T.StructField(f.name, f.dataType) for f in scan_schema()]))
    stream = spark.readStream.schema(table.snapshot().schema.struct()).parquet(source)
    write_stream(table, stream, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert table.row_count() == 50
    assert insert(table, rows(spark, 0, 50).select("id", "name", "score"), ("stream", 0)) == 0
    assert table.row_count() == 50


def test_aliases(spark):
    Engine(spark)
    assert spark.sql("select strpos('abc', 'c')").first()[0] == 3
    assert str(spark.sql("select date_bin(interval '15' minute, timestamp'2020-01-01 00:37:00', timestamp'2020-01-01 00:00:00')").first()[0]) == "2020-01-01 00:30:00"


def test_random_operations_against_a_model(spark, tmp_path):
    import random

    rng, model = random.Random(11), set()
    table = ManagedTable.create(spark, str(tmp_path / "m"), scan_schema(), TableOptions(row_group_rows=40, min_row_group_rows=8, bloom_columns=("id",)))
    following = 0
    for _ in range(18):
        step = rng.choice(["insert", "insert", "delete", "delete", "flush", "reopen", "compact"])
        if step == "insert":
            n = rng.randint(1, 40)
            insert(table, rows(spark, following, following + n).coalesce(1))
            model |= set(range(following, following + n))
            following += n
        elif step == "delete":
            a = rng.randint(0, max(following, 1))
            gone = {i for i in model if a <= i < a + 9}
            assert dml.delete(table, f"id >= {a} and id < {a + 9}") == len(gone)
            model -= gone
        elif step == "flush":
            flush(table)
        elif step == "compact":
            maintenance.compact(table, 0.3)
        else:
            table = ManagedTable.open(spark, table.storage.root)
        assert table.row_count() == len(model)
    assert ids(table.scan()) == sorted(model)


def test_a_writer_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    _, table = made(spark, tmp_path / "t", 1)

    def dies(*a, **k):
        raise RuntimeError("gone")

    for change in (lambda: insert(table, rows(spark, 100, 120)), lambda: dml.delete(table, "id < 50"), lambda: dml.update(table, {"score": "1"}), lambda: maintenance.rewrite_all(table), lambda: maintenance.cast_column(table, "score", "long")):
        with monkeypatch.context() as m:
            m.setattr(log, "commit", dies)
            with pytest.raises(RuntimeError):
                change()
        assert ids(table.scan()) == list(range(100)) and dict(table.scan().dtypes)["score"] == "int"
    table.vacuum()
    assert ids(table.scan()) == list(range(100))


def test_collated_texts_are_not_pruned_by_order(spark, tmp_path):
    df = spark.sql("select cast('A' as string collate utf8_lcase) s union all select cast('b' as string collate utf8_lcase)")
    table = ManagedTable.create(spark, str(tmp_path / "c"), df.schema)
    insert(table, df)
    flush(table)
    assert table.scan("s = 'a'").count() == 1 and table.scan("s = 'B'").count() == 1


def test_comments_do_not_hide_where(spark, tmp_path):
    engine, table = made(spark, tmp_path / "t", 1)
    for k, before in enumerate(("-- it's", "/* don't */", "-- (see", "/* where id = 1 */", "/* ` \" */")):
        assert engine.sql(f"DELETE FROM t {before}\n WHERE id = {k}").first()[0] == 1
    assert engine.sql("UPDATE t AS x SET score = 500, x.name = 'a where (b' -- it's (\n WHERE x.id = (SELECT max(id) FROM t)").first()[0] == 1
    assert ids(table.scan()) == list(range(5, 100)) and [(r.id, r.name) for r in table.scan("score = 500").collect()] == [(99, "a where (b")]


@pytest.mark.parametrize(
    "condition,gone",
    [
        ("name = 'where (' OR id IN (SELECT id FROM u WHERE id < 3)", [0, 1, 2]), (r"name = 'it\'s where' OR id = 4", [4]), ("`id` = 5 AND name != 'where'", [5]), ("id = (SELECT max(id) FROM u) -- where id = 3", [99]),
        ("EXISTS (SELECT 1 FROM u y WHERE y.id = x.id + 1 AND y.id = 5)", [4]), ("x.id = 6", [6]), ("NOT (x.id > 1)", [0, 1]), ("x.id = 7 AND x.name IS NULL", [7]), ("x.id = 8 AND x.name IS NULL", []), ("true", list(range(100))), ("false", []), ("1 = 1", list(range(100))),
    ],
)
def test_conditions_as_parsed(spark, tmp_path, monkeypatch, condition, gone):
    engine, plain = Engine(spark), rows(spark, 0, 100)
    table = engine.attach("t", ManagedTable(spark, str(tmp_path / "t"), None))
    spark.range(100).createOrReplaceTempView("u")
    taken = []
    monkeypatch.setattr(engine, "_views", lambda *a: None)
    monkeypatch.setattr(dml, "delete", lambda t, where=None, alias=None: taken.append((t, where, alias)) or 0)
    monkeypatch.setattr(dml, "update", lambda t, to, where=None, alias=None: taken.append((t, where, alias)) or 0)
    engine.sql(f"DELETE FROM t AS x WHERE {condition}")
    engine.sql(f"UPDATE t AS x SET x.score = 1, name = 'a where (b' WHERE {condition}")
    for t, where, alias in taken:
        matched = plain.alias(alias) if where is None else plain.alias(alias).where(where)
        assert t is table and alias == "x" and ids(matched) == gone


def test_statements_with_queries_named_before(spark, tmp_path):
    engine, table = made(spark, tmp_path / "t", 1)
    for k, text in enumerate(("WITH c AS (SELECT 1000L AS id, 'z' AS name, 1 AS score) INSERT INTO t SELECT * FROM c", "INSERT INTO t WITH c AS (SELECT 1001L AS id, 'z' AS name, 1 AS score) SELECT * FROM c")):
        assert engine.sql(text).first()[0] == 1 and ids(table.scan("id >= 1000")) == list(range(1000, 1001 + k))
    for text in ("WITH c AS (SELECT 1 AS id) DELETE FROM t WHERE id IN (SELECT id FROM c)", "WITH c AS (SELECT 1 AS id) UPDATE t SET score = 1 WHERE id IN (SELECT id FROM c)"):
        with pytest.raises(Unsupported):
            engine.sql(text)
    with pytest.raises(InvalidArgument):
        engine.sql("UPDATE t SET score = 1, SCORE = 2")
    assert table.row_count() == 102 and engine.sql("DELETE FROM t").first()[0] == 102 and ids(table.scan()) == []


def test_a_udf_prunes_nothing_and_limits_reach_the_scan(spark, tmp_path):
    engine, table = made(spark, tmp_path / "t", 4)
    spark.udf.register("odd", F.udf(lambda k: k % 2 == 1, "boolean"))
    assert engine.explain("SELECT id FROM t WHERE odd(id)")["t"].pruned == 0
    assert engine.explain("SELECT id FROM t WHERE odd(id) AND id < 100")["t"].pruned == 3
    assert ids(engine.sql("SELECT id FROM t WHERE odd(id) AND id < 100")) == list(range(1, 100, 2))
    plan = engine.sql("SELECT id FROM t LIMIT 7")
    assert plan.count() == 7 and "CollectLimit 7" in plan._jdf.queryExecution().executedPlan().toString()


def test_vacuum_keeps_pinned_and_young_snapshots(spark, tmp_path):
    _, table = made(spark, tmp_path / "t", 2)
    before = table.snapshot()
    pin = table.pin()
    dml.delete(table, "id < 50")
    maintenance.rewrite_all(table)
    assert table.vacuum(min_age_s=3600) == 0 and table.vacuum() > 0
    assert table.pins() == {pin: before.txn} and ids(table.scan(snapshot=before)) == list(range(200)) and ids(table.scan()) == list(range(50, 200))
    table.unpin(pin)
    assert table.vacuum() > 0 and table.pins() == {} and ids(table.scan()) == list(range(50, 200))
    assert log.commits(table.storage) == [table.snapshot().txn]


def test_no_local_folder_stands_in_on_a_cluster():
    from types import SimpleNamespace

    from segtable import workspace

    unset = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(InvalidArgument):
        workspace.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_folders_counts_and_index_parts(spark, tmp_path):
    """Whole folders are read as folders, deletes are counted beside their vectors and merged, and a change touches few index parts."""
    engine, table = made(spark, tmp_path / "t", 3)
    insert(table, rows(spark, 300, 700).repartition(4))
    flush(table)
    first = table.snapshot()
    chosen = sorted(table.choose(first, None)[0], key=lambda r: r.path)
    assert len(units(chosen)) == 4 and len(units(chosen[1:])) == 3 and len(units(chosen[:-1])) == 6 and ids(table.whole(first)) == list(range(700))
    before = set(first.index)
    for k in range(MERGE_DELETES):
        dml.delete(table, f"id = {k}")
    now = table.snapshot()
    assert len(now.deletes) < MERGE_DELETES and now.deleted == MERGE_DELETES == table.delete_vectors(now).count()
    assert {r.segment: r.gone for r in table.delete_counts(now).collect()} == {chosen[0].segment: MERGE_DELETES}
    assert ids(engine.sql("SELECT id FROM t")) == list(range(MERGE_DELETES, 700))
    assert maintenance.compact(table, 0.1).segments == 1
    after = table.snapshot()
    assert not after.deletes and after.rows == after.live_rows == 700 - MERGE_DELETES == table.row_count()
    assert len(before & set(after.index)) == len(before) - 1  # only the part that named the segment is another
    one = chosen[-1]
    left = after.rows - one.rows
    assert dml.delete_segments(table, [one.segment]) == 1 and table.row_count() == table.to_df().count() == table.whole(table.snapshot()).count() == left
    table.vacuum()
    assert ManagedTable.open(spark, str(tmp_path / "t")).to_df().count() == left


def test_long_texts_keep_both_bounds(spark, tmp_path):
    engine = Engine(spark)
    table = engine.create("t", str(tmp_path / "t"), T.StructType([T.StructField("s", T.StringType()), T.StructField("b", T.BinaryType())]), TableOptions(**ONE_GROUP))
    for c in ("a", "m", "\U0010ffff"):
        insert(table, spark.createDataFrame([(c * 80, c.encode() * 80)], "s string, b binary"))
        flush(table)
    high = {r.max_c0 for r in table.index().collect()}
    assert high == {"a" * 64 + "\U0010ffff", "m" * 64 + "\U0010ffff", None}
    assert [(p.segments, p.pruned) for p in (table.explain("s > 'b'"), table.explain(f"s >= '{'m' * 80}'"))] == [(2, 1), (2, 1)]
    assert table.scan(f"s >= '{'m' * 80}'").count() == 2 and table.scan("b > X'7A'").count() == 1


def test_a_damaged_page_is_an_error(spark, tmp_path):
    _, table = made(spark, tmp_path / "t", 1, dictionary_encoding=False, durability="full")
    (file,) = (tmp_path / "t" / "data" / table.choose(table.snapshot(), None)[0][0].path.split("/")[1]).glob("*.parquet")
    data = bytearray(file.read_bytes())
    data[data.index((57).to_bytes(8, "little"))] ^= 64
    file.write_bytes(data)
    for crc in file.parent.glob(".*.crc"):  # else the local file system finds the damage first
        crc.unlink()
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        table.to_df().collect()
    unchecked = ManagedTable.open(spark, str(tmp_path / "t"), TableOptions(verify_checksums=False))
    assert 57 not in ids(unchecked.to_df())
    with pytest.raises(InvalidArgument):
        TableOptions(durability="some")


def test_a_large_index_and_the_merging_of_its_parts(spark, tmp_path, monkeypatch):
    """What is done beyond the sizes that the driver holds gives the same rows."""
    _, table = made(spark, tmp_path / "t", 2)
    monkeypatch.setattr("segtable.sources.table.SMALL_INDEX", 0)
    monkeypatch.setattr("segtable.operators.writing.MOST_PARTS", 1)
    monkeypatch.setattr("segtable.operators.writing.LISTED", 0)
    table = ManagedTable.open(spark, str(tmp_path / "t"))
    assert not table.held(table.snapshot()) and ids(table.whole(table.snapshot())) == list(range(200))
    first = min(table.choose(table.snapshot(), None)[0], key=lambda r: r.path)
    assert dml.delete_segments(table, [first.segment]) == 1
    assert len(table.snapshot().index) == 1 and ids(table.whole(table.snapshot())) == list(range(100, 200)) and table.row_count() == 100
