"""Segmentation: lines, paragraphs, pages and tables of contents to chapters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx
from folioscope.operators.prefix import running_count, running_last

PAGE_BUCKET = 32
ENTRIES_PER_PAGE = 1 << 20
TOC_BLOCK = 1 << 13


@dataclass(frozen=True)
class HeadingRule:
    """What makes a stripped line a heading, and how sections are titled."""

    is_heading: Callable[[Column], Column]
    title: Callable[[Column], Column]
    first_title: str = lx.WHOLE_TEXT_TITLE
    check_title: bool = False


MARKDOWN = HeadingRule(
    lambda line: line.rlike(lx.MARKDOWN_HEADING),
    lambda line: F.substring(tx.strip(F.regexp_extract(line, lx.MARKDOWN_HEADING, 2)), 1, 80),
)
PLAIN_TEXT = HeadingRule(
    lambda line: line.rlike("(?U)" + "|".join(lx.TEXT_HEADINGS)),
    lambda line: F.substring(line, 1, 80),
    first_title="",
    check_title=True,
)


def _ordinal_title(n: Column) -> Column:
    return F.format_string("第 %d 节", n)


def heading_sections(docs: DataFrame, key: str = "doc_id", rule: HeadingRule = MARKDOWN) -> DataFrame:
    """Split docs(key, text) at heading lines (G1, G2); without sections one chapter.

    A document is one row, so its sections are cut inside the row: no shuffle, and a long
    document costs time in its own lines only.  Sections without body emit nothing.
    """

    # a line knows its number and whether it is a heading before any section is cut, so the cutting
    # itself works on plain columns and evaluates no heading test inside nested functions
    marked = F.transform(
        F.col("_lines"), lambda line, i: F.struct(i.alias("at"), line.alias("line"), rule.is_heading(line).alias("head"))
    )
    heads = F.transform(F.filter(F.col("_marked"), lambda m: m["head"]), lambda m: m["at"])
    starts, lines = F.col("_starts"), F.col("_lines")
    sections = F.transform(
        F.arrays_zip(starts.alias("at"), F.slice(F.concat(starts, F.array(F.size(lines))), F.lit(2), F.size(starts)).alias("end")),
        lambda s: F.struct(
            F.when(s["at"] < 0, F.lit(rule.first_title)).otherwise(rule.title(F.get(lines, s["at"]))).alias("title"),
            F.filter(F.slice(lines, s["at"] + 2, s["end"] - s["at"] - 1), lambda line: line != "").alias("body"),
        ),
    )
    sections = F.filter(sections, lambda s: F.size(s["body"]) > 0)

    cleaned = docs.select(key, tx.clean(F.coalesce("text", F.lit(""))).alias("text"))
    cleaned = cleaned.withColumn("_lines", F.transform(F.split("text", "\n"), tx.strip)).withColumn("_marked", marked)
    cleaned = cleaned.withColumn("_starts", F.concat(F.array(F.lit(-1)), heads))
    # a document without body keeps one empty section, which becomes the whole-text chapter
    cut = cleaned.select(key, "text", sections.alias("_s")).select(
        key,
        F.when(F.size("_s") == 0, F.col("text")).alias("_whole"),
        F.posexplode_outer("_s").alias("_n", "_s"),
    )
    number = F.coalesce(F.col("_n"), F.lit(0)) + 1
    whole = F.col("_whole").isNotNull()
    title = F.when(F.length("_s.title") > 0, tx.clean_title(F.col("_s.title"))).otherwise(_ordinal_title(number))
    if rule.check_title:
        title = F.when(tx.is_valid_title(title), title).otherwise(_ordinal_title(number))
    chars = F.aggregate("_s.body", F.lit(0), lambda acc, line: acc + F.length(line))
    return cut.select(
        key,
        F.format_string("ch_%03d", number).alias("chapter_id"),
        F.when(whole, F.lit(lx.WHOLE_TEXT_TITLE)).otherwise(title).alias("title"),
        F.lit(1).alias("level"),
        number.alias("page_start"),
        number.alias("page_end"),
        F.when(whole, F.col("_whole")).otherwise(F.array_join("_s.body", "\n")).alias("content"),
        F.when(whole, F.length("_whole")).otherwise(chars).alias("char_count"),
    )


def styled_sections(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chapters from paragraphs(key, pos, style, text) by heading styles 1 and 2.

    The section of a paragraph is the number of headings up to it, a running count that is
    taken in blocks, so one long document spreads over tasks.
    """
    first, second = (tx.contains_any(F.col("style"), s) for s in (lx.HEADING_STYLES_1, lx.HEADING_STYLES_2))
    body = paragraphs.select(key, "pos", F.coalesce("style", F.lit("")).alias("style"), tx.clean(F.col("text")).alias("text"))
    marked = body.filter(F.length("text") > 0).select(
        key, "pos", "text", (first | second).alias("_head"), F.when(first, 1).otherwise(2).alias("_level")
    )
    numbered = running_count(marked, [key], "pos", F.col("_head"), "_section")
    sections = numbered.groupBy(key, "_section").agg(
        F.max(F.when(F.col("_head"), F.struct(F.substring("text", 1, 80).alias("title"), F.col("_level").alias("level")))).alias("_h"),
        F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("pos", "text")))).alias("_b"),
    )
    whole = running_count(sections.filter(F.size("_b") > 0), [key], "_section", F.lit(True), "_n")
    title = tx.clean_title(F.coalesce(F.col("_h.title"), F.lit(lx.UNRECOGNISED_CHAPTER)))
    found = whole.select(
        key,
        F.format_string("ch_%03d", "_n").alias("chapter_id"),
        tx.or_default(title, lx.UNRECOGNISED_CHAPTER).alias("title"),
        F.coalesce(F.col("_h.level"), F.lit(1)).alias("level"),
        F.col("_n").cast("int").alias("page_start"),
        F.col("_n").cast("int").alias("page_end"),
        F.array_join("_b.text", "\n").alias("content"),
        F.aggregate("_b.text", F.lit(0), lambda acc, line: acc + F.length(line)).alias("char_count"),
    )
    # documents with headings only, or nothing at all, become one chapter of their text
    rest = paragraphs.select(key).distinct().join(found.select(key), key, "left_anti")
    texts = body.join(rest, key, "left_semi").groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.length("text") > 0, F.struct("pos", "text")))).alias("_b")
    )
    single = texts.select(
        key,
        F.lit("ch_001").alias("chapter_id"),
        F.lit(lx.UNRECOGNISED_CHAPTER).alias("title"),
        F.lit(1).alias("level"),
        F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"),
        F.array_join("_b.text", "\n").alias("content"),
        F.aggregate("_b.text", F.lit(0), lambda acc, line: acc + F.length(line)).alias("char_count"),
    )
    return found.unionByName(single)


def toc_by_rules(
    pages: DataFrame,
    chapter: str = lx.TOC_CHAPTER,
    section: str = lx.TOC_SECTION,
    max_pages: int | None = None,
    first_lines: int = 10,
    width: int = 80,
) -> DataFrame:
    """TOC entries from the first lines of each page(textbook_id, page, text)."""
    if max_pages is not None:
        pages = pages.filter(F.col("page") <= max_pages)
    lines = F.slice(F.split(tx.clean(F.col("text")), "\n"), 1, first_lines)
    line = tx.strip(F.col("_line"))
    level = F.when(line.rlike("(?U)" + chapter), 1).when(line.rlike("(?U)" + section), 2)
    entries = (
        pages.select("textbook_id", "page", F.posexplode(lines).alias("_pos", "_line"))
        .select("textbook_id", "page", "_pos", level.alias("level"), tx.clean_title(F.substring(line, 1, width)).alias("title"))
        .filter(F.col("level").isNotNull() & tx.is_valid_title(F.col("title")))
    )
    # the entry before may be many pages back: a blocked scan, so a long book is not one task
    placed = entries.withColumn("_at", F.col("page").cast("long") * first_lines + F.col("_pos"))
    after = running_last(placed, ["textbook_id"], "_at", ["title"])
    return after.filter(~F.col("title_before").eqNullSafe(F.col("title"))).select(
        "textbook_id", "level", "title", F.col("page").alias("page_start"), F.lit("rules").alias("origin"), F.col("_pos").alias("pos")
    )


def toc_supplied(toc: DataFrame, external: bool = False, last_page: int = 9999, deepest: int = 3) -> DataFrame:
    """Keep usable bookmark or external entries with cleaned titles."""
    page = F.col("page_start")
    keep = page.between(1, last_page) if external else ((F.col("level") <= deepest) & (page > 0))
    title = tx.clean_title(F.col("title"))
    return toc.filter(keep & tx.is_valid_title(title)).withColumns(
        {"title": title, "origin": F.lit("external" if external else "bookmarks")}
    )


def toc_garbled(documents: DataFrame, toc: DataFrame) -> DataFrame:
    """Per document, whether its external TOC is unusable; absent counts as garbled."""
    size = F.length("title")
    cjk = F.regexp_count("title", F.lit(r"[\x{4e00}-\x{9fff}]"))
    bad = (size < 4) | F.col("title").rlike(r"[\x00\x{fffd}]") | ((cjk < 2) & (size > 5))
    counts = toc.groupBy("textbook_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))
    joined = documents.select("textbook_id").join(counts, "textbook_id", "left")
    n, n_bad = F.coalesce("n", F.lit(0)), F.coalesce("n_bad", F.lit(0))
    garbled = (n == 0) | ((n >= 3) & (n_bad / n > 0.6)) | (n_bad >= 3)
    return joined.select("textbook_id", n.alias("n"), n_bad.alias("n_bad"), garbled.alias("garbled"))


def toc_select(documents: DataFrame, external: DataFrame, bookmarks: DataFrame, rules: DataFrame) -> DataFrame:
    """One TOC origin per document.

    A usable external TOC wins, then two or more bookmarks, then the rules.
    """
    usable = toc_garbled(documents, external).filter(~F.col("garbled")).select("textbook_id")
    columns = ["textbook_id", "level", "title", "page_start", "origin", "pos"]
    offered = [
        (1, toc_supplied(external, external=True).join(usable, "textbook_id", "left_semi"), 1),
        (2, toc_supplied(bookmarks), 2),
        (3, rules, 1),
    ]
    entries = None
    for priority, source, least in offered:
        rows = source.select(*columns, F.lit(priority).alias("_p"), F.lit(least).alias("_least"))
        entries = rows if entries is None else entries.unionByName(rows)
    best = (
        entries.groupBy("textbook_id", "_p")
        .agg(F.count("*").alias("_n"), F.first("_least").alias("_least"))
        .filter(F.col("_n") >= F.col("_least"))
        .groupBy("textbook_id")
        .agg(F.min("_p").alias("_p"))
    )
    return entries.join(best, ["textbook_id", "_p"], "left_semi").select(*columns)


def toc_ranges(toc: DataFrame, totals: DataFrame) -> DataFrame:
    """Page ranges of TOC entries; the last one ends with the document."""
    book = ["textbook_id"]
    at = F.col("page_start").cast("long") * ENTRIES_PER_PAGE + F.col("pos")
    placed = toc.withColumns({"_at": at, "_back": -at, "_next": F.col("page_start")})
    block = ENTRIES_PER_PAGE * TOC_BLOCK
    numbered = running_count(placed, book, "_at", F.lit(True), "_n", block=block)
    # the last value before it in reverse order is the next entry's page
    following = running_last(numbered, book, "_back", ["_next"], block=block)
    end = F.coalesce(F.col("_next_before") - 1, F.col("total_pages"))
    return following.join(totals.select("textbook_id", "total_pages"), "textbook_id").select(
        "textbook_id",
        F.format_string("ch_%03d", "_n").alias("chapter_id"),
        "title",
        "level",
        "page_start",
        F.greatest(end, F.col("page_start")).alias("page_end"),
    )


def whole_book_ranges(toc: DataFrame, totals: DataFrame) -> DataFrame:
    """`toc_ranges`, and one chapter of all its pages for a book without usable entries."""
    ranges = toc_ranges(toc, totals)
    bare = totals.join(ranges.select("textbook_id").distinct(), "textbook_id", "left_anti")
    return ranges.unionByName(
        bare.select(
            "textbook_id",
            F.lit("ch_001").alias("chapter_id"),
            F.lit(lx.WHOLE_TEXT_TITLE).alias("title"),
            F.lit(1).alias("level"),
            F.lit(1).cast(ranges.schema["page_start"].dataType).alias("page_start"),
            F.greatest(F.col("total_pages"), F.lit(1)).cast(ranges.schema["page_end"].dataType).alias("page_end"),
        )
    )


def chapter_content(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages BETWEEN start AND end of each chapter, joined by a blank line.

    Ranges are cut into page buckets so that the join has an equi key per bucket: a book
    with very many pages is compared bucket by bucket, not pages times chapters.
    """
    keys = ["textbook_id", "chapter_id"]
    body = (
        pages.select("textbook_id", "page", tx.clean(F.col("text")).alias("text"))
        .filter(F.length("text") > 0)
        .withColumn("_b", F.floor(F.col("page") / PAGE_BUCKET))
    )
    spans = chapters.select(*keys, "page_start", "page_end").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("page_start") / PAGE_BUCKET), F.floor(F.col("page_end") / PAGE_BUCKET)))
    )
    matched = spans.join(body, ["textbook_id", "_b"]).filter(F.col("page").between(F.col("page_start"), F.col("page_end")))
    filled = matched.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("content"),
        F.sum(F.length("text")).alias("char_count"),
    )
    return chapters.join(filled, keys, "left").withColumns(
        {"content": F.coalesce("content", F.lit("")), "char_count": F.coalesce("char_count", F.lit(0))}
    )


def document_totals(pages: DataFrame) -> DataFrame:
    """Pages, characters and status per document."""
    size = F.length(tx.clean(F.col("text")))
    return pages.groupBy("textbook_id").agg(
        F.max("page").alias("total_pages"),
        F.sum(size).alias("total_chars"),
        F.lit("completed").alias("parse_status"),
    )
