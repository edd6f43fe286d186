"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, embedding_dedup, fingerprints, minhash_dedup, mixing, sql, substring_dedup, token_counts, token_files, toxicity
from .scratch import new_folder, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every document through byte-level BPE, as digests of ids and decoded bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, _bpe_digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


_DECIMAL: list[str] = []


def _bpe_digest(ids: list[int], decoded: bytes, _: str) -> tuple[int, str, str]:
    while len(_DECIMAL) <= max(ids, default=0):
        _DECIMAL.append(str(len(_DECIMAL)))
    line = " ".join(map(_DECIMAL.__getitem__, ids))
    return len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-match token counts of every document by a word-end vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs, public_tokenizers.path("word_bpe_49k.json"), without=("text",))


def _held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a model of the labelled rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~_held_out()))
    scored = toxicity.score(docs, model, without=("text",))
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings of one label, cosine 0.98."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Tools that a conversation may call, with the schemas of their arguments.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}},
    "calculate": {"type": "object", "required": ["expression"], "additionalProperties": False, "properties": {"expression": {"type": "string"}}},
    "fetch": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string"}, "headers": {"type": "object"}}},
}


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of all conversations in topological place, as canonical JSON."""
    return chat_format.format_chat(table(spark, sf_dir, "conversations"), TOOLS)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = fingerprints.with_next(fingerprints.fingerprints(docs, name="own"), "doc_id", "text", ["text", "own"])
    n = F.length("text").cast("long")
    taken = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - taken).cast("int")), F.substring(F.col("next.text"), F.lit(1), taken))
    pairs = pairs.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "own", F.col("next.own").alias("following"))
    pairs = fingerprints.fingerprints(pairs, "edited", "changed")
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.shown(F.col("own")).alias("fingerprint"), fingerprints.shown(F.col("changed")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        fingerprints.likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


#: Production weights: by domain, and by language in every domain; sources of one language weigh the same.
DOMAIN_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
LANGUAGE_WEIGHTS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}


def domain() -> Column:
    """Sources carry no domain here: each belongs to one of as many as there are weights, by its hash."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.col("source")), F.lit(len(DOMAIN_WEIGHTS))))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for a mix of 0.8 of all tokens, four epochs at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    weights = {(f"domain{k}",): w for k, w in enumerate(DOMAIN_WEIGHTS)} | {(f"domain{k}", lang): w for k in range(len(DOMAIN_WEIGHTS)) for lang, w in LANGUAGE_WEIGHTS.items()}
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    mixed = mixing.mix(docs, levels, mixing.given(weights), fraction=0.8, max_epochs=4, seed=1)
    return mixed.select("doc_id", "lang", "source", "copies")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five-word shingles, similarity 0.75."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the token files written of them all."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "token-files")
    files = token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_documents(spark, folder, files)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 35-word windows that repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digests(substring_dedup.repeated_spans(docs))


def queries() -> dict:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_token_counts": op2_token_counts,
        "op3_toxicity": op3_toxicity,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_chat_format": op5_chat_format,
        "op6_fingerprints": op6_fingerprints,
        "op7_mixing": op7_mixing,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_token_files": op9_token_files,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what a query computes; tests hold the others against brute force."""
    return dict(sql.ORACLES)
