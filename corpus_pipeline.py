"""The corpus pipeline: what a training run reads, from raw documents to packed sequences.

Each stage applies one operator to all that its predecessor kept, is written as Parquet and read again.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayer.llm import decontaminate, packing, sanitise, setsketch, toxicity
from assayer.session import materialize


#: Rows that cross to Python at once. Whole texts make wide rows: Spark's default of 10,000 holds tens of MB on either side.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def narrow(stage):
    """``stage`` with the session's Arrow batches at most BATCH_ROWS rows high, from then on.

    A stage's rows are computed after it has returned, so the setting stays.
    """

    @wraps(stage)
    def narrowed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return narrowed


@narrow
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@narrow
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.clean(docs)


@narrow
def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@narrow
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise.clean(docs)


@narrow
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_texts),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses none of the learned, sketched and tokenised stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Null texts are empty, repeated rows and ties are treated as each stage's operator says, other columns are carried up to
    packing, and an empty table gives no piece.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace('_', '-')}")
    return docs
