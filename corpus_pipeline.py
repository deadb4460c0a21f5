"""documents -> a mixed training corpus, in five stages; each calls one operator of corpuskiln.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the
columns of documents. SQL can't express the language models, so ORACLE_SQL is None. The tests hold line_dedup,
near_dedup and the rates of mixing against brute force, decontamination against cases worked out by hand, and
language_id against held-out languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskiln.llm import language_id as languages
from corpuskiln.llm.common import fold, table, written
from corpuskiln.llm.decontaminate import decontaminate
from corpuskiln.llm.line_dedup import dedup_lines
from corpuskiln.llm.mixing import mix
from corpuskiln.llm.near_copies import keep_one_similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear enough; texts without a letter go."""
    model = languages.learn(docs.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))
    return languages.identify(docs.select(COLUMNS), model).where("NOT rejected").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that three or more share; n_chars follows the text."""
    return dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of texts that share four fifths of their five-word shingles."""
    return keep_one_similar(docs.select(COLUMNS)).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their rate: how often to take each for the target weights."""
    return mix(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
