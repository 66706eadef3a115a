"""The corpus pipeline: five operators in a row, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and gives documents with their own columns; its output is
written as Parquet and read again as the next one's input. The last stage gives token ids. What a
stage wrote is deleted when the stage after the next one has been written; the last two remain.

All stages: an empty table gives an empty one; columns that the stage doesn't know pass through,
whatever their names (the last stage takes doc_id, lang, source and text alone).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, line_dedup, near_copies, quality_rules
from quern.session import ensure_checkpoint_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote model of the rules finds good. A null or empty text has no words and goes; repeated rows get one verdict."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before, exactly or nearly, go; so does a document that had no others.

    A null text stays null; rows with one id and one text are one document; ties go to the least id, text hash and line number.
    """
    return line_dedup.keep_new_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more.

    Null and empty texts are copies of each other; the least id stays, a null id only where no other is; a repeated row is the same document.
    """
    return near_copies.deduplicate(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, each repeated row by itself. A null text and a null item have no words; an empty benchmark keeps all."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text. A null text has no tokens; repeated rows each give a row."""
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return done.select("doc_id", "lang", "source", F.size("input_ids").cast("bigint").alias("n_tokens"), "input_ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("decontaminate", benchmarks),
    ("bpe", tokens),
]

#: The stages learn a vote model, hash with XXH64 and merge byte pairs, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each gives is written to the shared checkpoint folder and reread."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, written = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        written.append(spark._jvm.org.apache.hadoop.fs.Path(path))
        if k > 1:
            written[k - 2].getFileSystem(spark._jsc.hadoopConfiguration()).delete(written[k - 2], True)
    return docs
