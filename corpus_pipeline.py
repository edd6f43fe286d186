"""A corpus pipeline: ``documents`` cleaned, deduplicated, mixed and tokenised by five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's ``docs``; all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtable.cluster import ship
from segtable.llm import byte_bpe, minhash_dedup, mixing, substring_dedup, toxicity
from segtable.llm.scratch import bytes_of, save

#: Scores from here on are toxic.
TOXIC = 0.7
#: Mix: nine tenths of the tokens, sources weighted by size to this power, no document twice.
POWER, FRACTION = 0.7, 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels that are not held out."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = toxicity.train(docs, labels)
    # A score follows from the text alone, so texts are known by their hash and only hashes of rejected ones move.
    keyed = docs.select(F.xxhash64("text").alias("key"), "text")
    gone, path = save(toxicity.score(keyed, model, without=("text",)).where(F.col("score") >= TOXIC).select("key").distinct(), "pipeline-toxic")
    small = bytes_of(spark, path) <= minhash_dedup.BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if small else gone, F.xxhash64("text") == F.col("key"), "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the least id; rows that repeat whole stay once."""
    ship(spark)
    found = minhash_dedup.near_duplicates(docs)
    gone, path = save(found.where("not kept").select("doc_id").distinct(), "pipeline-gone")
    small = bytes_of(spark, path) <= minhash_dedup.BROADCAST_BYTES
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():  # rows of one id are one document: the one of least hash stays, and of equal rows one
        several = kept.join(repeated, "doc_id", "left_semi").withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        least, _ = save(several.groupBy("doc_id").agg(F.min("__row").alias("__row")), "pipeline-least")
        several = several.join(least, ["doc_id", "__row"], "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(several)
    return kept.select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the word windows that repeat; ``n_chars`` follows the text."""
    ship(spark)
    cut = substring_dedup.without_repeats(substring_dedup.repeated_spans(docs))
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a mix of sources by tempered size takes."""
    ship(spark)
    from segtable.llm.queries import domain

    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    mixed = mixing.mix(docs, levels, mixing.tempered(POWER), fraction=FRACTION, max_epochs=1, seed=1)
    return mixed.where("copies > 0").select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document by byte-level BPE, and whether they decode to its text."""
    ship(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = docs.select("doc_id", "lang", "source", "text")
    return byte_bpe.round_trip(kept, vocabulary, public_tokenizers.PATTERN, byte_bpe.ids_and_check, "n_tokens long, ids array<int>, exact boolean")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]
#: SQL cannot express trained scores or sketches; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read back from what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
