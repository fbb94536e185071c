"""Catalogues of discovered and parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx


def summary(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """Document columns with the number of chapters.

    Documents from files are joined by path, others by id.
    """
    key = "path" if {"path"} <= set(documents.columns) & set(chapters.columns) else "textbook_id"
    counted = chapters.groupBy(key).agg(F.count("*").alias("chapter_count"))
    return documents.join(counted, key, "left").withColumn(
        "chapter_count", F.coalesce("chapter_count", F.lit(0))
    )


def catalogue(directories: list[DataFrame], stored: DataFrame) -> DataFrame:
    """Files of several directories, the first directory wins per name.

    directories: (path, filename) each.  stored(textbook_id, title, total_pages, total_chars,
    chapter_count, parse_status, error), joined by path if it has one, by id otherwise.  The id is a cut
    of the name; files are told apart by the whole of it.  The winner is an aggregate, combined map-side.
    """
    key = "path" if "path" in stored.columns else "textbook_id"
    stored = stored.drop(*{"textbook_id", "path", "filename", "format", "priority"} - {key})
    listed = None
    for priority, files in enumerate(directories):
        rows = files.select(
            tx.document_key(F.col("filename")).alias("_key"), F.lit(priority).alias("priority"), "path", "filename"
        )
        listed = rows if listed is None else listed.unionByName(rows)
    first = listed.groupBy("_key").agg(F.min(F.struct("priority", "path", "filename")).alias("_f")).select("_f.*")
    rows = first.withColumn("textbook_id", tx.document_id(F.col("filename"))).join(stored, key, "left")
    return rows.select(
        "textbook_id",
        "priority",
        "path",
        "filename",
        F.coalesce("title", tx.file_stem(F.col("filename"))).alias("title"),
        F.regexp_extract("filename", r"(?<=.)\.([^.]+)$", 1).alias("format"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total_pages", "total_chars", "chapter_count")],
        F.coalesce("parse_status", F.lit("pending")).alias("parse_status"),
        F.coalesce("error", F.lit("")).alias("error"),
    )
