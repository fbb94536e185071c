"""Scans of text, Markdown, page and paragraph files."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx
from folioscope.operators import segment as sg
from folioscope.session import broadcast_if_small, local_path, many_files, stage

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
UNSAFE = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")  # in the name of a folder


def write_texts(rows: DataFrame, root: str, by: str) -> None:
    """Each text of rows(`by`, text) as a file of its own, ended by a line feed, in a folder per value of `by`.

    On a mounted file system tasks write by themselves: without its native library Hadoop starts two
    processes per file there, to set permissions.  Other stores get Spark's writer; names are as it gives them.
    """
    spark = rows.sparkSession
    folder = local_path(spark, root)
    if folder is None:
        # tasks put their files in place themselves: renaming them all at the end would be the driver's work
        out = rows.select(by, "text").write.partitionBy(by).option("maxRecordsPerFile", 1)
        out.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root)
        return
    run = uuid.uuid4()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for value, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = UNSAFE.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else NO_VALUE
                if name not in made:
                    os.makedirs(f"{folder}/{by}={name}", exist_ok=True)
                    made.add(name)
                # a task that is run again writes the same names
                with open(f"{folder}/{by}={name}/part-{task:05d}-{run}.c{n:03d}.txt", "wb") as file:
                    file.write((text or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["files"])

    os.makedirs(folder, exist_ok=True)
    rows = rows.select(F.col(by).cast("string"), F.col("text").cast("binary"))
    rows.mapInArrow(put, "files long").agg(F.sum("files")).collect()


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """Files below a directory (S1); contents are not read unless asked for."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(directory)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(
        "path",
        name.alias("filename"),
        F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]+)$", 1)).alias("format"),
        "length",
        F.col("modificationTime").alias("modified"),
        "content",
    )


def decode(content) -> F.Column:
    """UTF-8, or GBK where the bytes are not UTF-8 (S2); only those rows go to Python.

    Spark's own decoder knows GBK only under a legacy setting, which a caller's session may not have.
    """
    other = F.when(~F.is_valid_utf8(content.cast("string")), content)

    @F.pandas_udf("string")
    def gbk(rows: pd.Series) -> pd.Series:
        return rows.map(lambda raw: None if raw is None else bytes(raw).decode("gbk", "replace"))

    return F.coalesce(gbk(other), F.decode(content, "UTF-8"))


def read_texts(files: DataFrame) -> DataFrame:
    """Identified text files with their decoded, cleaned text.

    `textbook_id` is for display: files with equal beginnings of their names share it.  The key of a
    file is its path.
    """
    return files.select(
        tx.document_id(F.col("filename")).alias("textbook_id"),
        "path",
        "filename",
        tx.book_title(F.col("filename")).alias("title"),
        "format",
        decode(F.col("content")).alias("text"),
    )


def page_scan(pages: DataFrame, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good pages, error rows) of a page-text table (S3).

    pages(source_file, source_path, page, text, error): blank pages are dropped, rows with
    an error become error rows.
    """
    bad = F.length(F.coalesce("error", F.lit(""))) > 0
    errors = pages.filter(bad).select("source_file", F.concat_ws(": ", "source_file", "error").alias("error"))
    good = pages.filter(~bad & (F.length(tx.strip(F.col("text"))) > 0))
    if max_pages is not None:
        good = good.filter(F.col("page") <= max_pages)
    return good.drop("error"), errors


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chapters) of files by extension (S4); chapters have the path of their file.

    Files of other formats become failed documents.  PDF and DOCX files are handled from
    their page and paragraph tables.
    """
    is_text = F.col("format").isin("md", "txt")
    # staged: each file is opened and decoded once, and files are listed once
    with many_files(files.sparkSession):
        listed = stage(read_texts(files.withColumn("content", F.when(is_text, F.col("content")))), "texts")
    texts = listed.filter(is_text)
    parts = [
        sg.heading_sections(texts.filter(F.col("format") == kind), "path", rule)
        for kind, rule in (("md", sg.MARKDOWN), ("txt", sg.PLAIN_TEXT))
    ]
    chapters = parts[0].unionByName(parts[1]).join(texts.select("path", "textbook_id"), "path")
    good = texts.select(
        "textbook_id",
        "path",
        "filename",
        "title",
        "format",
        F.length(tx.clean(F.col("text"))).cast("long").alias("total_chars"),
        F.lit("completed").alias("parse_status"),
        F.lit("").alias("error"),
    )
    other = listed.filter(~is_text).select(
        "textbook_id",
        "path",
        "filename",
        tx.file_stem(F.col("filename")).alias("title"),
        "format",
        F.lit(0).cast("long").alias("total_chars"),
        F.when(F.col("format").isin(lx.FORMATS), "pending").otherwise("failed").alias("parse_status"),
        F.when(F.col("format").isin(lx.FORMATS), "")
        .otherwise(F.concat(F.lit("Unsupported format: ."), "format"))
        .alias("error"),
    )
    return good.unionByName(other), chapters


def requested_files(files: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files to parse, error rows) for wanted(filename), or all supported files."""
    if wanted is None:
        none = files.sparkSession.createDataFrame([], "filename string, error string")
        return files.filter(F.col("format").isin(lx.FORMATS)), none
    names = wanted.select("filename").distinct()
    missing = names.join(files.select("filename"), "filename", "left_anti")
    # only paths and names meet in the joins; contents are read for the paths that are left
    paths = files.select("path", "filename").join(names, "filename", "left_semi").select("path")
    return (
        files.join(broadcast_if_small(paths), "path", "left_semi"),
        missing.select("filename", F.lit("File not found").alias("error")),
    )
