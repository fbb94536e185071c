"""Engine inputs derived from the test tables, and the query registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx
from folioscope.operators import chunk as ck
from folioscope.operators import search as se
from folioscope.operators.prefix import running_count
from folioscope.operators.segment import HeadingRule
from folioscope.session import GROUP_BYTES, is_folder, spread, stage, staging_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# class rules over tokens that occur in the test texts; same shape as the default rules
CLASS_RULES = [
    ("治疗与干预", ["haing", "pour"]),
    ("诊断依据", ["ther", "ungen"]),
    ("并发症", ["edst", "ción"]),
    ("病因与危险因素", ["onre", "eaux"]),
    ("发生机制", ["heit", "tion"]),
    ("临床表现", ["and", "ment"]),
    ("预防管理", ["that", "que"]),
]


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files."""
    path = f"{sf}/{name}.parquet"
    source = spark.readStream.schema(table(spark, sf, name).schema)
    if is_folder(spark, path):
        return source.parquet(path)
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    root = staging_root(spark)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def parsed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """documents and chapters: a source is a book, a test document one of its chapters."""
    docs = documents(spark, sf)
    books = docs.select(F.col("source").alias("textbook_id")).distinct()
    books = books.withColumns(
        {"title": F.concat(F.lit("Book "), "textbook_id"), "filename": F.concat("textbook_id", F.lit(".txt"))}
    )
    chapters = docs.select(
        F.col("source").alias("textbook_id"),
        F.concat(F.lit("d"), "doc_id").alias("chapter_id"),
        F.concat(F.lit("Doc "), "doc_id").alias("title"),
        F.col("doc_id").alias("page_start"),
        F.col("doc_id").alias("page_end"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("char_count"),
    )
    return books, chapters


def eval_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select(
        F.concat("source", F.lit(":d"), "doc_id").alias("source_id"),
        F.col("source").alias("textbook_id"),
        F.concat(F.lit("Book "), "source").alias("book"),
        F.concat(F.lit("Doc "), "doc_id").alias("chapter"),
        F.concat(F.lit("d"), "doc_id").alias("chapter_id"),
        F.col("doc_id").alias("page_start"),
        F.col("doc_id").alias("page_end"),
        tx.flatten_space(F.col("text")).alias("text"),
    )
    return docs.filter(F.length("text") >= 20)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chapter chunks at 700/80, cut in the task that reads the chapter."""
    cut, _ = ck.chapter_chunks(*parsed(spark, sf))
    return cut


def staged_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chapter chunks for what reads them several times."""
    return staged_cut(*parsed(spark, sf))


def staged_cut(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chunks of the given chapters at 700/80, for what reads them several times."""
    return stage(ck.chapter_chunks(books, chapters)[0], "chunks", group=GROUP_BYTES)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page table: page number is the position of a document within its source."""
    docs = documents(spark, sf).withColumnRenamed("source", "textbook_id")
    numbered = running_count(docs.select("textbook_id", "doc_id", "text"), ["textbook_id"], "doc_id", F.lit(True), "page")
    return numbered.select("textbook_id", "doc_id", F.col("page").cast("int").alias("page"), "text")


def long_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{5,}"), F.lit(0))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        text.alias("question"),
        F.slice(F.array_distinct(long_words(text)), 1, 3).alias("expected_keywords"),
    )


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct first long words of the benchmark texts."""
    first = F.get(long_words(F.col("text")), F.lit(0))
    words = table(spark, sf, "benchmark").select(first.alias("topic")).filter(F.col("topic").isNotNull()).distinct()
    return words.select(F.col("topic").alias("graph_id"), "topic")


def sparse_evidence(spark: SparkSession, sf: str, asked: DataFrame, k: int) -> DataFrame:
    """Evidence rows of queries(query_id, query) over the chapter chunks."""
    cut = staged_chunks(spark, sf)
    return se.to_evidence(se.SparseIndex(cut, max_features=lx.MAX_FEATURES).search(asked, k), cut)


def topic_evidence(spark: SparkSession, sf: str) -> DataFrame:
    asked = topics(spark, sf).select(F.col("graph_id").alias("query_id"), F.col("topic").alias("query"))
    return stage(sparse_evidence(spark, sf, asked, 50), "evidence")


SHORT_LINE = HeadingRule(
    lambda line: (F.length(line) <= 40) & line.endswith("."),
    lambda line: F.substring(line, 1, 80),
)
