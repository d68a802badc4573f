"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm import (additive, arrow_files, bpe, codes, collocations, jaccard, kneser_ney, neighbours, oracles, sharding, suffixes, token_counts,
                        toxicity, vantage)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op7_suffix_arrays": oracles.OP7, "op9_minhash_bands": oracles.OP9, "op12_limb_codes": oracles.OP12,
                           "op13_partitioned_phrases": oracles.OP13}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(additive.id_remainder("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes decoded from them, as digests."""
    found = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; rows with remainder 2 are held out."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), modulus=4, held_out=2))
    return found.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_matches")


@query
def op3_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids in Arrow files, and each document's ids read back from them."""
    docs = table(spark, sf_dir, "documents")
    manifest = arrow_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return arrow_files.read_back(spark, manifest, docs).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


@query
def op4_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; rows with remainder 1 are held out."""
    docs = table(spark, sf_dir, "documents")
    model, found = additive.fitted(docs, table(spark, sf_dir, "labels"), "quality", 3, 1)
    return additive.score(found, model).select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base scores of every whole text; rows with remainder 2 are held out from counting."""
    docs = table(spark, sf_dir, "documents")
    held_out = _held_out(7, 2)
    model = kneser_ney.train_model(docs, ~held_out, order=3)
    found = kneser_ney.score(docs, model)
    return found.select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes."""
    placed, _ = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


@query
def op7_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that lie in an occurrence of a benchmark window, and the items concerned."""
    found = suffixes.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op8_spliced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text."""
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op9_minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their five-word n-grams, and each document's number of links."""
    return jaccard.links(table(spark, sf_dir, "documents"))


@query
def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the largest inner product to every row whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op11_vantage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints are linked by at most two differing bits."""
    return vantage.groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op12_limb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, with the errors they leave."""
    vectors = table(spark, sf_dir, "embeddings")
    model = codes.fit(vectors)
    coded = codes.with_label_error(codes.encode(vectors, model, keep=("label",)))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(model.digest() if model else None).alias("codebooks_sha256"))


@query
def op13_partitioned_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
