"""Five stages from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Between
stages the rows are written as Parquet and read again, so a lost executor costs one stage at
most and no stage computes another anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.language import keep_known
from tessera.llm.mixing import mixed_documents
from tessera.llm.runtime import drop_path, new_path
from tessera.llm.simhash import keep_one
from tessera.llm.token_records import token_digests

END_ID = 2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with no language that makes up half of them, go."""
    return keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document of the least doc_id stays."""
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order; of one taken in part, its first words."""
    return mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, in ascending order of doc_id, read back."""
    import public_tokenizers

    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


STAGES = [
    ("language", known_language),
    ("simhash", one_of_each),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("tokens", token_records),
]

#: The stages train a model and run iterative algorithms, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has written goes when the next stage has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop_path(spark, before)
    return out
