"""The corpus pipeline: documents in, packed training windows out.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last
return the columns of documents. Quality is judged first, so copies of bad documents are gone before any are compared;
personal data is cut out of what is kept in the end, and that is packed.

For all stages: a null text counts as empty; rows with a null id are rows like others; an empty table gives an empty one;
columns of any other name stay as they are; very long texts are read whole, one row at a time.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, minhash, packing, pii, quality
from quarry.llm.common import materialize, table

#: Texts that go to a Python worker at once. An executor holds a batch several times over, in the JVM and in Python.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on this session deals texts to Python in batches of BATCH rows; no result depends on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking does not reject; empty texts and gibberish go, repeated rows share their fate.

    Without a good label nothing is rejected.
    """
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts, that of the smallest id; of rows that are equal in both, one."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; rows that repeat id and text stay together."""
    small_batches(spark)
    return minhash.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars stays that of the source text."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows with their ids; an empty text is packed as its end mark alone, repeated rows each."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", judge), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("pii", redact), ("packing", pack)]

#: The last stages' results depend on trained weights and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
