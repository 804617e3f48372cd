"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes what its predecessor kept, written as Parquet and read again, and gives the columns
of ``documents`` back, but for the last one, which gives the packed pieces. ``lang`` is what the first
stage identified. A stage's decisions name rows by their places in the files that it read, so no stage
copies its input; a stage's tables are its own and stay as long as its result may be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import language, line_dedup, near_dup, packing, quality
from folioscope.llm.common import materialize, prepare, read_from_files, release
from folioscope.llm.tokens import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted again."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language, by the predicted language and its score, go; lang becomes the predicted language."""
    return language.keep_identified(docs.select(*COLUMNS), language.fit(docs), least=language.LEAST_SCORE).select(*COLUMNS)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines above the limits go from texts; documents that fail the base rules or are depleted go."""
    return _documents(quality.clean(docs.select(*COLUMNS), in_files=read_from_files(docs)))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go; documents of which nothing is left go with them."""
    left = line_dedup.dedup(docs.select(*COLUMNS), in_files=read_from_files(docs))
    return _documents(left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.one_of_each(docs.select(*COLUMNS), in_files=read_from_files(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("line dedup", remove_repeated_lines),
    ("MinHash near-dedup", remove_near_duplicates),
    ("packing", pack_sequences),
]

#: The machines of the first stage are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the tables between stages go when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
