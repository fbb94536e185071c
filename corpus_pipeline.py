"""Training-data pipeline over `documents`.

    toxicity         documents whose score reaches the threshold go
    exact dedup      of equal texts the one with the smallest doc_id stays
    near dedup       of linked documents (5-word shingles, similarity 0.8) the smallest doc_id stays
    decontamination  documents that hold a benchmark text go
    byte-level BPE   token ids of each text, and the text decoded from them

Every stage works on all that the one before kept.  Nulls, empty texts, empty tables and extra columns
are handled as the operators say: null and empty texts are kept, counting as equal to each other in
exact dedup; documents without an id are kept.  The last stage adds `ids` and `n_tokens`, in place of
columns of these names if the input has them; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, contamination, exact, near, toxicity
from folioscope.llm.common import remainder, table
from folioscope.session import stage as written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_representatives(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = bpe.vocabulary()
    done = bpe.encode(docs, path, pattern, decoded="text")
    return done.withColumns({"n_tokens": F.size("ids").cast("long"), "text": F.col("text").cast("string")})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

# scores, links and alignments are beyond SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages one after the other; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
