"""Corpus pipeline: documents to training tokens in five stages.

Quality rules drop documents, the Jaccard join keeps one document of each group
of near copies, suffix-array dedup cuts passages that an earlier document has,
the mix repeats or leaves out documents so that sources reach their target
weights, and byte-level BPE turns what is left into token ids.

Rows without a doc_id belong to no group and stay; of rows that share one, the
first by text stays. A document whose bytes are all cut keeps its row with an
empty text; it has no words for the mix to take. Null texts count as empty and
fail the quality rules. Other columns of the documents pass through all stages
but the last, which returns doc_id, lang, source and the tokens; columns named
like an operator's outputs are kept as they were. Very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import byte_bpe, jaccard_join, quality_rules, source_mix, suffix_dedup
from quillgraph.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component stays."""
    groups = jaccard_join.joined(docs)
    first = written(groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_first")), "pipeline-first")
    stays = docs.join(first.distinct(), docs["doc_id"] == F.col("_first"), "left_semi")
    if not first.groupBy("_first").count().filter("count > 1").isEmpty():  # rows that share a doc_id: one of them stays
        line = Window.partitionBy("doc_id").orderBy("text")
        stays = stays.withColumn("_r", F.row_number().over(line)).filter("_r = 1").drop("_r")
    return stays.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(docs, texts=True).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN).drop("text")
    both = byte_bpe.decode(encoded, ranks)
    return both.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL expresses neither the dedup of byte strings nor the mix's draws; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split(" ")[0])
    return STAGES[-1][1](spark, docs, sf_dir)
