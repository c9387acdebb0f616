"""Corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, mixing, token pages.

Every stage takes (spark, docs, sf_dir) and works on all of ``docs``; all but the last return the columns of documents.  Nulls,
empty and very long texts, repeated rows, empty tables and extra columns have the results that the operators' docstrings
give; rows that share a doc_id share the decisions that are taken by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktile.llm.bit_packing import read_token_index, write_token_pages
from sparktile.llm.decontamination import find_contamination
from sparktile.llm.hashing import text_session
from sparktile.llm.minhash import near_duplicates
from sparktile.llm.mixing import mixing_plan, with_copies, word_count
from sparktile.llm.quality_ordinal import grade_column
from sparktile.llm.queries import END_ID, VOCAB_SIZE, as_records, benchmark_items, quality_model, tokenizer_file
from sparktile.session import scratch_path

WEIGHTS = (5, 2, 1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are at least of grade 1 with probability 0.5 or more; filtered in place, without a shuffle."""
    text_session(spark)
    grade = grade_column(docs, quality_model(spark, sf_dir))
    return docs.where(grade(F.col("text"))["kept"])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at similarity 0.8 on five-word shingles: the one with the smallest doc_id."""
    text_session(spark)
    kept = near_duplicates(as_records(docs), shingle=5, percent=80).where("kept").select(F.col("source_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    text_session(spark)
    bad = find_contamination(as_records(docs), benchmark_items(spark, sf_dir)).where("contaminated").select(F.col("source_id").alias("bad_id"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 over the sources in order, three times at most."""
    text_session(spark)
    # one struct keeps the documents' own columns apart from the operator's names
    rows = docs.select(F.col("doc_id").alias("source_id"), F.col("source").alias("batch"), F.struct(*[docs[c] for c in docs.columns]).alias("document"))
    plan = mixing_plan(rows.select("source_id", "batch", word_count(F.col("document.text")).alias("size")), WEIGHTS)
    taken = with_copies(rows, plan).where("copies > 0")
    return taken.select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")


def token_pages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in bit-packed pages; returns the index read back from the files."""
    text_session(spark)
    path = scratch_path(spark, "corpus-pages")
    write_token_pages(as_records(docs), path, tokenizer_file(), VOCAB_SIZE, END_ID)
    return read_token_index(spark, path).withColumnRenamed("source_id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token pages", token_pages),
]

# tokens, sketches and the fitted model have no SQL form; tests/llm/test_pipeline.py holds every stage and run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
