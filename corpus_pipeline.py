"""A corpus from documents: language, near duplicates, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
further columns there are and however they are named. A null or empty text has no language and goes in the first stage; null identifiers,
languages and sources are kept (a null source is one source), and a null identifier comes first where identifiers break
ties. Of repeated rows near-duplicate removal keeps one. Texts are read whole, however long. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import language, mixing, near_dups, packing, repeats
from folioloom.llm.common import Scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no n-gram in common with any language learned."""
    model = language.train(spark, docs)
    found = language.identify(docs.select(F.struct("*").alias("_row"), "text"), model, ["_row"])
    return found.where("lang_pred <> 'und' AND score > 0").select("_row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return near_dups.deduplicate(spark, docs, k=5, percent=80)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes or more that repeat; documents that lose all of their text go. n_chars follows the text."""
    cut = repeats.deduplicate(spark, docs, length=200, drop_empty=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mixture that gives sources weights by the square root of their size."""
    return mixing.mix(spark, docs, alpha=0.5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, in the order of the mixture, which is planned again from the same documents."""
    return packing.pack_mixed(spark, docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, alpha=0.5)


STAGES = [("language", known_language), ("near_duplicates", one_of_near_duplicates), ("repeated_strings", without_repeated_strings), ("mixing", mixed), ("packing", packed)]

#: n-gram filters, signatures, repeated strings and tokens are beyond SQL; tests hold the pipeline to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
