"""Tables and folders in the storage that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import new_folder, remove

__all__ = ["bytes_of", "hot_keys", "hot_rows", "join_hot", "new_folder", "remove", "save", "table"]

#: A key is hot if it has more than one in ``HOT_SHARE`` of all rows and more than ``HOT_ROWS``; so there are fewer hot keys than ``HOT_SHARE``.
HOT_SHARE, HOT_ROWS = 1000, 500
#: Pieces that the rows of a hot key are dealt into.
PIECES = 64


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder; return it reread, and its path.

    This cuts the lineage: what follows reads replicated files, so a lost executor
    costs the tasks it ran and not the steps before.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes that a written table takes, by the file system's own summary."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def hot_rows(counts: DataFrame, keys: list[str], rows: str = "count") -> list:
    """The keys of ``counts`` (a row each) that hold more than their share of all ``rows``, fewer than ``HOT_SHARE``."""
    total, most = counts.agg(F.sum(rows), F.max(rows)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    return counts.where(F.col(rows) > least).select(*keys).collect() if (most or 0) > least else []


def hot_keys(counts: DataFrame, keys: list[str], rows: str = "count") -> DataFrame | None:
    """``hot_rows`` as a table; None if there are none."""
    found = hot_rows(counts, keys, rows)
    return counts.sparkSession.createDataFrame(found, counts.select(*keys).schema) if found else None


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """An inner or left join on ``keys``, where rows of ``left`` with a hot key are dealt into pieces and their partners repeated for each.

    Keys are not null; ``hot`` is a bounded list, so it is broadcast. Rows of a hot key are dealt by their whole content.
    """
    if hot is None:
        return left.join(right.hint("merge"), keys, how)
    flags = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    mine = left.join(flags, keys, "left")
    of = F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema.fields if f.dataType.typeName() in ("integer", "long", "string")])
    mine = mine.withColumn("__piece", F.when(F.col("__hot"), F.pmod(of, F.lit(PIECES)).cast("int")).otherwise(0)).drop("__hot")
    theirs = right.join(flags, keys, "left")
    theirs = theirs.withColumn("__piece", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return mine.join(theirs.hint("merge"), [*keys, "__piece"], how).drop("__piece")
