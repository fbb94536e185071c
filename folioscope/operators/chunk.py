"""Chunking: table-generating operators from texts to windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as tx


def _cut(whole: Column, size: int, overlap: int) -> Column:
    """Windows of a text that is bound already; see `windows`."""
    step = max(1, size - overlap)
    run = -(-size // step)
    last = F.greatest(F.ceil((F.length(whole) - size) / step), F.lit(0)).cast("int")
    spans = tx.bind(
        F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)),
        lambda blocks: F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                (i * step).alias("start"),
                F.left(F.array_join(F.slice(blocks, i + 1, run), ""), F.lit(size)).alias("text"),
            ),
        ),
    )
    return F.transform(
        F.when(F.length(whole) > 0, spans),
        lambda w: F.struct(
            w["start"].alias("start"), (w["start"] + F.length(w["text"])).alias("end"), w["text"].alias("text")
        ),
    )


def windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end, text) of overlapping windows, in closed form.

    A window starts every `size - overlap` characters; the last is the first one that
    reaches the end.  The text is cut into step-sized blocks once and a window is a run of
    blocks, so the work is linear in the text however long it is.
    """
    return tx.bind(text, lambda whole: _cut(whole, size, overlap))


def _check(size: int, overlap: int) -> None:
    if size <= overlap:
        raise ValueError("chunk_size must be greater than overlap")


def split_fixed(df: DataFrame, text: str, size: int = 700, overlap: int = 80) -> DataFrame:
    """Replace `text` by its stripped windows, numbered from 1 per input row.

    Empty windows vanish and do not consume a number.
    """
    _check(size, overlap)
    others = [c for c in df.columns if c != text]
    pieces = F.transform(windows(tx.normalise(F.col(text)), size, overlap), lambda w: tx.strip(w["text"]))
    return (
        df.select(*others, F.posexplode(F.filter(pieces, lambda p: F.length(p) > 0)).alias("_n", text))
        .withColumn("chunk_no", F.col("_n") + 1)
        .drop("_n")
    )


def page_chunks(pages: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Chunks of pages(source_file, page, text), id `file::pN::cN`."""
    cut = split_fixed(pages, "text", size, overlap)
    return cut.withColumn(
        "chunk_id",
        F.concat(F.col("source_file"), F.lit("::p"), F.col("page"), F.lit("::c"), F.col("chunk_no")),
    )


def chapter_chunks(
    documents: DataFrame,
    chapters: DataFrame,
    requested: DataFrame | None = None,
    size: int = 700,
    overlap: int = 80,
) -> tuple[DataFrame, DataFrame]:
    """Chunks of parsed chapters, and an error row per requested id not stored.

    Where both tables have a path, documents are told apart by it: an id may be that of several files.
    Chunk ids then carry a digest of the path.
    """
    spark = documents.sparkSession
    key = "path" if "path" in documents.columns and "path" in chapters.columns else "textbook_id"
    books = documents.select(
        *{"textbook_id", key}, F.col("title").alias("book"), F.col("filename").alias("source_file")
    )
    if requested is None:
        errors = spark.createDataFrame([], "textbook_id string, error string")
    else:
        wanted = requested.select("textbook_id").distinct()
        errors = wanted.join(books, "textbook_id", "left_anti").select(
            "textbook_id",
            F.concat(F.lit("Textbook "), F.col("textbook_id"), F.lit(" not found in store")).alias("error"),
        )
        books = books.join(wanted, "textbook_id", "left_semi")
    body = chapters.filter(F.length(tx.strip(F.col("content"))) > 0).select(
        key,
        "chapter_id",
        F.col("title").alias("chapter"),
        "page_start",
        "page_end",
        F.col("content").alias("text"),
    )
    cut = split_fixed(body.join(books, key), "text", size, overlap)
    own = ["textbook_id"] if key == "textbook_id" else ["textbook_id", F.substring(F.md5("path"), 1, 16)]
    chunks = cut.withColumns(
        {
            "chunk_id": F.concat_ws("_", *own, "chapter_id", F.concat(F.lit("c"), F.col("chunk_no"))),
            "char_count": F.length("text"),
        }
    )
    return chunks, errors


def line_chunks(pages: DataFrame, size: int = 700, overlap: int = 80) -> DataFrame:
    """Pack whole lines into chunks of about `size` characters (C4).

    A blank line closes a chunk.  A line that would exceed the size closes it too and the
    last `overlap` characters are carried over.  Each step needs the packed text so far, so
    this is a fold inside one row; rows stay independent of each other.
    """
    state = T.StructType(
        [
            T.StructField("parts", T.ArrayType(T.StringType())),
            T.StructField("cur", T.StringType()),
            T.StructField("cur_len", T.IntegerType()),
        ]
    )

    def make(parts: Column, cur: Column, cur_len: Column) -> Column:
        return F.struct(
            parts.alias("parts"), cur.alias("cur"), cur_len.cast("int").alias("cur_len")
        ).cast(state)

    def step(acc: Column, line: Column) -> Column:
        parts, cur, cur_len = acc["parts"], acc["cur"], acc["cur_len"]
        is_open = cur.isNotNull()
        closed = F.concat(parts, F.array(cur))
        tail = F.right(cur, F.lit(overlap)) if overlap else F.lit("")
        return (
            F.when(
                line == "",
                make(F.when(is_open, closed).otherwise(parts), F.lit(None).cast("string"), F.lit(0)),
            )
            .when(
                is_open & (cur_len + F.length(line) > size),
                make(closed, F.concat(tail, F.lit("\n"), line), F.length(tail) + F.length(line)),
            )
            .otherwise(
                make(
                    parts,
                    F.when(is_open, F.concat(cur, F.lit("\n"), line)).otherwise(line),
                    cur_len + F.length(line),
                )
            )
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"].isNotNull(), F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"])

    lines = F.transform(F.split("text", "\n"), tx.strip)
    start = make(F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(0))
    others = [c for c in pages.columns if c != "text"]
    packed = pages.filter(F.length(tx.strip(F.col("text"))) > 0).select(
        *others, F.posexplode(F.aggregate(lines, start, step, finish)).alias("_n", "_t")
    )
    return (
        packed.filter(F.length(tx.strip(F.col("_t"))) > 0)
        .withColumns({"text": tx.strip(F.col("_t")), "chunk_no": F.col("_n") + 1})
        .withColumn(
            "chunk_id",
            F.concat(F.col("source_file"), F.lit("::p"), F.col("page"), F.lit("::c"), F.col("chunk_no")),
        )
        .drop("_n", "_t")
    )


def enrich_page_chunks(pages: DataFrame, size: int = 700, overlap: int = 80) -> DataFrame:
    """Line chunks that carry book, chapter, section and character count."""
    named = pages.withColumns(
        {
            "book": tx.book_title(F.col("source_file")),
            "chapter": tx.infer_chapter(F.col("text")),
            "section": F.lit(""),
        }
    )
    return line_chunks(named, size, overlap).withColumn("char_count", F.length("text"))


def eval_chunks(docs: DataFrame, settings: Iterable[tuple[int, int]], id_length: int = 16) -> DataFrame:
    """Windows of every document at every (size, overlap) setting in one pass.

    The settings are unrolled into the row, so there is no cross join.  Text keeps its
    offsets and is not stripped; windows under ten visible characters are dropped.  `id_length` is the
    number of hex digits of a chunk id; corpora of billions of chunks need up to 40.
    """
    def grid(whole: Column, size: int, overlap: int) -> Column:
        return F.transform(
            _cut(whole, size, overlap),
            lambda w: F.struct(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), w.alias("w")),
        )

    grids = tx.bind(F.col("text"), lambda whole: F.concat(*[grid(whole, s, o) for s, o in dict.fromkeys(settings)]))
    others = [c for c in docs.columns if c != "text"]
    cut = (
        docs.select(*others, F.explode(grids).alias("_g"))
        .select(
            *others,
            F.col("_g.size").alias("size"),
            F.col("_g.overlap").alias("overlap"),
            F.col("_g.w.start").alias("char_start"),
            F.col("_g.w.end").alias("char_end"),
            F.col("_g.w.text").alias("text"),
        )
        .filter(F.length(tx.strip(F.col("text"))) >= 10)
    )
    return cut.withColumn(
        "chunk_id",
        tx.stable_id(*[F.col(c) for c in ("source_id", "char_start", "char_end", "size", "overlap")], length=id_length),
    )
