"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Null texts and texts without a letter go in the first stage, so later ones see neither. Rows that repeat a doc_id are one
document: they lose the same lines, stay or go together and are mixed together. Rows without doc_id keep their lines and
stay in the near-duplicate stage. An empty table gives an empty result in every stage. Other columns pass through to the
last stage, whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.llm import jaccard_join, language_id, line_dedup, packing, source_mix
from quarrylane.llm.common import staged


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars follows the text."""
    return out.select(*[F.coalesce(F.length("text"), F.lit(0)).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows with a language and drops documents in none: those without any letter. ``lang`` stays as it
    came where it came, and is the prediction elsewhere: null where no row has a language to learn from. A table without a ``lang`` column isn't
    one of documents."""
    model = language_id.train(docs)
    if model is None:
        return _columns(language_id.with_letter(docs), docs)
    found = language_id.identify(docs, model).where("lang_pred <> 'und'")
    return _columns(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the smallest doc_id alone; documents left without text go."""
    return _columns(line_dedup.dedup_lines(docs), docs).where("text <> ''")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (five-word shingles, Jaccard index of 0.8) stays."""
    return jaccard_join.one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating, and no document comes more than three times; one row for each copy."""
    return source_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids."""
    return packing.pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", identify_language), ("line_dedup", drop_repeated_lines), ("jaccard_join", drop_near_duplicates), ("source_mix", mix), ("packing", pack)]
#: Shingle components, learned classifiers and tokenizer ids are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
