"""From raw documents to token files, in five stages over whole tables.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the
last return the columns of ``documents``; the last returns the rows of the token file.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.decontamination import decontaminate
from wordloom.llm.language_id import fit as fit_languages
from wordloom.llm.language_id import identify
from wordloom.llm.mixing import mixed_documents
from wordloom.llm.ngram_join import near_duplicate_representatives
from wordloom.llm.queries import tokenizer_path
from wordloom.llm.shared import written
from wordloom.llm.token_binary import tokenise

#: Rows of an Arrow batch: long texts times many rows would fill the executors' Python.
BATCH_ROWS = "1000"


def _stage(function):
    """A stage in a session whose Arrow batches are small, also while its result is written."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return function(spark, docs, sf_dir)

    return run_stage


#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.5


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts of no certain language."""
    found = identify(docs, fit_languages(docs), "_language", "_certainty")
    return found.where(F.col("_language") != "und").where(F.col("_certainty") >= LEAST_SCORE).select(*docs.columns)


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return near_duplicate_representatives(docs)


@_stage
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as its rate says, so that the domains meet their target shares."""
    return mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns its rows: doc_id, start, n_tokens, ids_crc32."""
    return tokenise(docs, tokenizer_path())


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("tokens", token_file),
]

#: The stages learn, compare and encode in ways that SQL has no words for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
