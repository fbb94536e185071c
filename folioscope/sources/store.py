"""Parsed-document store, index store, question sets and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx
from folioscope.session import SMALL, path_exists, staged

QUESTION_SCHEMA = (
    "id string, question string, expected_keywords array<string>, expected_topic string, "
    "expected_book_hint string, type string"
)
PARSED_SCHEMA = (
    "textbook_id string, title string, textbook string, filename string, "
    "chapters array<struct<chapter_id:string,title:string,page_start:bigint,page:bigint,page_end:bigint,content:string,text:string>>, "
    "pages array<struct<page:bigint,page_number:bigint,chapter:string,chapter_id:string,text:string,content:string>>, "
    "_corrupt_record string"
)
SUMMARY_COLUMNS = [
    "strategy", "hit_at_5", "keyword_recall", "context_chars", "evidence_count", "source_diversity", "citation_completeness",
]


class DocumentStore:
    """Tables of parsed documents in hash buckets of their key, sorted by it.

    `key` tells documents apart: the path where they come from files, since two names may share an id.  An
    upsert reads and rewrites the buckets of the given keys; a load of one key reads one bucket.
    """

    TABLES = ("documents", "chapters", "pages")

    def __init__(self, spark: SparkSession, root: str, key: str = "textbook_id", buckets: int = 32):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def save(self, table: str, rows: DataFrame) -> None:
        """Upsert: all rows of the given keys are replaced, others stay."""
        rows = rows.filter(F.length(self.key) > 0).withColumn("bucket", self._bucket(F.col(self.key)))
        if not path_exists(self.spark, self._path(table)):
            self._write(table, rows)
            return
        with staged(rows, "given") as given:  # may come from this very table
            touched = [r[0] for r in given.select("bucket").distinct().collect()]  # at most `buckets` numbers
            stored = self.spark.read.parquet(self._path(table)).filter(F.col("bucket").isin(touched))
            # staged, since a folder cannot be read while it is overwritten
            with staged(stored.join(given.select(self.key).distinct(), self.key, "left_anti"), "kept") as kept:
                self._write(table, given.unionByName(kept, allowMissingColumns=True))

    def _write(self, table: str, rows: DataFrame) -> None:
        (
            rows.repartition("bucket", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "bucket"]), F.lit(4)))
            .sortWithinPartitions("bucket", self.key)
            .write.mode("overwrite")
            .options(**SMALL)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(self._path(table))
        )

    def load(self, table: str, key: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self._path(table))
        if key is not None:
            rows = rows.filter((F.col("bucket") == self._bucket(F.lit(key))) & (F.col(self.key) == key))
        return rows.drop("bucket")

    def exists(self, key: str) -> bool:
        return not self.load("documents", key).isEmpty()


def save_index(root: str, chunks: DataFrame, vocab: DataFrame, vectors: DataFrame, meta: DataFrame) -> None:
    """Index tables as Parquet (S9); vectors as `index.tfidf_vectors` gives them, of either form."""
    for name, rows in (("chunks", chunks), ("vocab", vocab), ("vectors", vectors), ("meta", meta)):
        rows.write.mode("overwrite").options(**SMALL).parquet(f"{root}/{name}")


def load_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Index tables; a layout with long postings instead of vectors is accepted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    has_vectors = not files.filter(F.col("path").contains("/vectors/")).isEmpty()
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in ("chunks", "vocab", "meta")}
    if has_vectors:
        tables["vectors"] = spark.read.parquet(f"{root}/vectors")
    else:
        long = spark.read.parquet(f"{root}/postings")
        rows = long.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("_p"))
        tables["vectors"] = rows.select("chunk_id", F.col("_p.term").alias("terms"), F.col("_p.weight").alias("weights"))
    return tables


def index_status(chunks: DataFrame, vocab: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: counts, flags and the warning of the build (S10); files are `index_files`."""
    counted = chunks.agg(
        F.count("*").alias("chunk_count"), F.count_distinct("source_file").alias("textbook_count")
    )
    terms = vocab.agg(F.count("*").alias("term_count"))
    flags = meta.select("retrieval_backend", "has_embedding", "has_tfidf", "embedding_warning")
    one = F.lit(True)
    return counted.join(F.broadcast(terms), one).join(F.broadcast(flags), one).withColumns(
        {
            "exists": F.col("chunk_count") > 0,
            "fallback_backend": F.when(F.length("embedding_warning") > 0, "tfidf").otherwise(""),
        }
    )


def _given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(F.length(v) > 0, v) for v in values])


def _number(*values: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*[F.when(v != 0, v) for v in values]).cast("long")


def eval_corpus(documents: DataFrame, chapters: DataFrame, pages: DataFrame, demo: DataFrame | None = None) -> DataFrame:
    """Fragments for evaluation: chapters, or pages of documents without any.

    Texts under 20 characters are dropped.  `demo` is taken when nothing else is there.  Tables that
    have a path are joined by it, others by id; a null id counts as an empty one.
    """
    tables = [documents, chapters, pages]
    key = "path" if all("path" in t.columns for t in tables) else "textbook_id"
    tables = [t.withColumn("textbook_id", F.coalesce("textbook_id", F.lit(""))) for t in tables]
    documents, chapters, pages = tables
    names = {"textbook_id", key}
    book = documents.select(
        *names,
        _given(F.col("title"), F.col("textbook_id")).alias("book"),
        F.coalesce("filename", F.concat(F.col("textbook_id"), F.lit(".json"))).alias("filename"),
    )
    by_chapter = chapters.select(
        key,
        _given(F.col("title"), F.col("chapter_id")).alias("chapter"),
        "chapter_id",
        F.col("chapter_id").alias("_part"),
        F.col("page_start").cast("long").alias("page_start"),
        F.coalesce("page_end", "page_start").cast("long").alias("page_end"),
        tx.flatten_space(F.col("content")).alias("text"),
    )
    bare = pages.join(chapters.select(key).distinct(), key, "left_anti")
    numbered = F.concat(F.lit("page_"), "page")
    by_page = bare.select(
        key,
        tx.or_default(F.col("chapter"), "page").alias("chapter"),
        (_given(F.col("chapter_id"), numbered) if "chapter_id" in pages.columns else numbered).alias("chapter_id"),
        numbered.alias("_part"),
        F.col("page").cast("long").alias("page_start"),
        F.col("page").cast("long").alias("page_end"),
        tx.flatten_space(F.col("text")).alias("text"),
    )
    rows = by_chapter.unionByName(by_page).filter(F.length("text") >= 20).join(book, key)
    rows = rows.withColumn("source_id", F.concat_ws(":", "textbook_id", "_part")).drop("_part")
    rows = rows.withColumnRenamed("path", "source_path")
    if demo is not None and rows.isEmpty():
        return demo
    return rows


def read_parsed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chapters, pages) of parsed-document JSON files, each with the path of its file.

    What a file leaves out is made up for: ids and titles from its name, chapter ids and page numbers from
    their position, `text` for `content` and `page_number` for `page`.  Files that are no JSON are skipped.
    """
    data = spark.read.schema(PARSED_SCHEMA).json(path, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))
    name = F.element_at(F.split(F.url_decode("path"), "/"), -1)
    stem = tx.file_stem(name)
    data = data.filter(F.col("_corrupt_record").isNull()).select(
        "path",
        _given(F.col("textbook_id"), stem).alias("textbook_id"),
        _given(F.col("title"), F.col("textbook"), stem).alias("title"),
        _given(F.col("filename"), name).alias("filename"),
        "chapters",
        "pages",
    )
    documents = data.select("path", "textbook_id", "title", "filename")
    chapter, page, at = F.col("_c"), F.col("_p"), F.col("_at") + 1
    chapters = data.select("path", "textbook_id", F.posexplode("chapters").alias("_at", "_c")).select(
        "path",
        "textbook_id",
        _given(chapter["chapter_id"], F.format_string("ch_%03d", at)).alias("chapter_id"),
        chapter["title"].alias("title"),
        _number(chapter["page_start"], chapter["page"]).alias("page_start"),
        _number(chapter["page_end"], chapter["page_start"], chapter["page"]).alias("page_end"),
        _given(chapter["content"], chapter["text"]).alias("content"),
    )
    pages = data.select("path", "textbook_id", F.posexplode("pages").alias("_at", "_p")).select(
        "path",
        "textbook_id",
        _number(page["page"], page["page_number"], at).alias("page"),
        page["chapter"].alias("chapter"),
        page["chapter_id"].alias("chapter_id"),
        _given(page["content"], page["text"]).alias("text"),
    )
    return documents, chapters, pages


def read_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Question set, one JSON array per file or one object per line."""
    return spark.read.schema(QUESTION_SCHEMA).json(path, multiLine=not lines)


def _summary_columns(summary: DataFrame) -> list[str]:
    """Columns in their order in the files; the latency stands after the context length where there is one."""
    timed = "avg_latency_ms" in summary.columns
    at = SUMMARY_COLUMNS.index("context_chars") + 1
    return [*SUMMARY_COLUMNS[:at], *(["avg_latency_ms"] if timed else []), *SUMMARY_COLUMNS[at:]]


def run_metadata(documents: DataFrame, questions: DataFrame, strategies: Sequence[tuple] = tuple(lx.STRATEGIES)) -> DataFrame:
    """One row about a run: counts, strategies, vectorizer and time."""
    names = ("name", "size", "overlap", "parent_size", "parent_overlap")
    plans = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s)]) for s in strategies])
    counted = documents.agg(F.count("*").alias("doc_count")).join(F.broadcast(questions.agg(F.count("*").alias("question_count"))), F.lit(True))
    return counted.select(
        "question_count",
        "doc_count",
        plans.alias("strategies"),
        F.struct(F.lit("char_wb").alias("analyzer"), F.array(F.lit(2), F.lit(4)).alias("ngram_range"), F.lit(False).alias("lowercase")).alias("vectorizer"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
    )


def source_paths(documents: DataFrame) -> DataFrame:
    """Distinct source paths of a run; a table, since it grows with the corpus."""
    return documents.filter(F.length("source_path") > 0).select("source_path").distinct()


def write_results(root: str, results: DataFrame, summary: DataFrame, metadata: DataFrame | None = None) -> None:
    """Nested JSON, CSV with fixed columns and four decimals, Markdown table.

    `metadata` is a row of `run_metadata`, written beside the results.
    """
    results.write.mode("overwrite").json(f"{root}/raw_results")
    summary.write.mode("overwrite").json(f"{root}/summary")
    if metadata is not None:
        metadata.write.mode("overwrite").json(f"{root}/metadata")
    rounded = summary.select("strategy", *[F.round(c, 4).alias(c) for c in _summary_columns(summary)[1:]])
    rounded.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/results")
    summary_table(summary).coalesce(1).write.mode("overwrite").text(f"{root}/results_table")


def summary_table(summary: DataFrame) -> DataFrame:
    """Markdown table of the strategy summary as one text value."""
    columns = _summary_columns(summary)
    digits = {"context_chars": "%.1f", "avg_latency_ms": "%.2f", "evidence_count": "%.2f", "source_diversity": "%.2f"}
    line = F.format_string("| %s | " + " | ".join(digits.get(c, "%.3f") for c in columns[1:]) + " |", *columns)
    head = "| " + " | ".join(columns) + " |\n|---" + "|---:" * (len(columns) - 1) + "|\n"
    return summary.agg(
        F.concat(
            F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("strategy", line.alias("l")))), lambda r: r["l"]), "\n")
        ).alias("value")
    )
