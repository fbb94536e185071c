"""Exact deduplication: two passes over digests with a Bloom filter between them.

The first pass counts, for a few bit positions per digest, which positions are hit twice; those bits
are the filter.  A digest all of whose positions are in it may be repeated, any other is unique.  In
the second pass only the possibly repeated rows are shuffled; the rest pass straight through.

The filter has a fixed greatest size, so it may be broadcast.  With more documents than it was made
for, more unique rows take the shuffled way; the result stays exact.

Null text counts as empty.  An empty table gives an empty result.  Rows without an id come after all
others in their group.  Extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.bloom import Bloom, split
from folioscope.llm.common import BLANKS, free_name, query, table
from folioscope.session import stage


def normal_digest(text: Column) -> Column:
    """SHA-256 in hex of the text with every run of ASCII blanks made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), 256)


def split_rows(df: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose digest is unique, rows whose digest may be repeated)."""
    digests = stage(df.select(digest), "digests")
    bloom = Bloom(digests, digest, digests.count(), repeated=True)
    return split(df, F.col(digest), bloom, free_name(df, "maybe_repeated"))


def exact_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: id, keep_id, group_size, kept and text_sha256.

    `keep_id` is the smallest id of the group.  Rows that repeat both id and text are counted one by
    one and marked alike.
    """
    digests = stage(
        df.select(F.col(id_column).alias("doc_id"), normal_digest(F.col(text)).alias("text_sha256")), "digests"
    )
    alone, suspects = split_rows(digests, "text_sha256")
    groups = suspects.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    alone = alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    found = alone.unionByName(suspects.join(groups, "text_sha256"))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with one row of each group of equal texts: that with the smallest id.

    Only possibly repeated rows are shuffled, and those of a group meet after each task has kept its
    first one.  Of rows that repeat both id and text any one stays.
    """
    digest = free_name(df, "text_sha256")
    alone, suspects = split_rows(df.withColumn(digest, normal_digest(F.col(text))), digest)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = suspects.groupBy(digest).agg(
        F.min_by(whole, F.struct(F.col(id_column).isNull(), F.col(id_column))).alias("row")
    )
    return alone.drop(digest).unionByName(first.select("row.*"))


OP6_SQL = r"""
WITH normal AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
), grouped AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM normal JOIN grouped USING (text_sha256)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
