import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import chunk as ck


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


def test_cleaning_is_unicode_aware(spark):
    assert one(spark, tx.normalise(F.col("t")), t="　 a\t\x00 b\n\n\n\nc  ") == "a b\n\nc"
    assert one(spark, tx.clean(F.col("t")), t="﻿a　 b\x08c\n\n\n\nd ") == "a bc\n\nd"
    assert one(spark, tx.flatten_space(F.col("t")), t=" a　\n\x00b  ") == "a b"
    assert one(spark, tx.flatten_space(F.col("t")), t=None) == ""


def test_titles(spark):
    assert one(spark, tx.clean_title(F.col("t")), t="﻿ 第一章　细胞  56") == "第一章 细胞"
    assert one(spark, tx.clean_title(F.col("t")), t="引言.......") == "引言"
    for title, ok in [
        ("第一章 细胞", True), ("目录", False), ("Page 3 of9", False), ("Page 3 of 9", True), ("第 3 页/共 9 页", False),
        ("12", False), ("x", False), ("ab，，，，，，，，。。cd", False), ("，，。。ab", True), ("a" * 81, False),
    ]:
        assert one(spark, tx.is_valid_title(F.col("t")), t=title) is ok, title


def test_ids_and_labels(spark):
    assert one(spark, tx.document_id(F.col("t")), t="01_局部解剖学.pdf") == "book_01_局部解剖学"
    assert one(spark, tx.document_id(F.col("t")), t="a.md").startswith("book_") and len(one(spark, tx.document_id(F.col("t")), t="a.md")) == 13
    assert one(spark, tx.book_title(F.col("t")), t="12_Some Book.PDF") == "Some Book"
    assert one(spark, tx.book_title(F.col("t")), t="05_病理学.pdf") == "病理学"
    assert one(spark, tx.infer_chapter(F.col("t")), t="x\n 第三章 炎症 \ny") == "第三章 炎症"
    assert one(spark, F.array_join(tx.keywords(F.col("t")), "|"), t="请问 什么是 炎症 IL6 炎症 a") == "炎症|IL6"
    assert one(spark, tx.short_text(F.col("t"), 3), t="ab  cd") == "ab ..."
    line = tx.source_line(F.col("b"), F.col("c"), F.col("s"), F.col("e"))
    assert one(spark, line, b="B", c=None, s=3, e=5) == "B / 未知章节 / 页码 3-5"


def windows_of(spark, text, size, overlap):
    rows = ck.split_fixed(spark.createDataFrame([(text,)], "text string"), "text", size, overlap)
    return [r.text for r in rows.orderBy("chunk_no").collect()]


def test_windows(spark):
    cut = windows_of(spark, "细胞水肿" * 120, 100, 20)
    assert [len(c) for c in cut] == [100] * 5 + [80]
    assert windows_of(spark, "", 100, 20) == [] and windows_of(spark, "   \n\n  ", 100, 20) == []
    with pytest.raises(ValueError, match="chunk_size must be greater than overlap"):
        windows_of(spark, "abc" * 100, 50, 50)


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab 😀界", max_size=90), st.integers(2, 20), st.integers(0, 19))
def test_windows_reassemble(spark, text, size, overlap):
    overlap = min(overlap, size - 1)
    docs = spark.createDataFrame([(text,)], "t string")
    spans = docs.select(ck.windows(F.col("t"), size, overlap).alias("w")).first().w or []
    assert all(text[s.start : s.end] == s.text and len(s.text) <= size for s in spans)
    rebuilt = ""
    for s in spans:
        rebuilt += s.text[len(rebuilt) - s.start :]
    assert rebuilt == text


def pack(text, size, overlap):
    """Plain re-statement of line packing, to check the fold."""
    done, cur, length = [], [], 0
    for line in (part.strip() for part in text.split("\n")):
        if line and cur and length + len(line) > size:
            done.append("\n".join(cur))
            tail = done[-1][-overlap:]
            cur, length = [tail, line], len(tail) + len(line)
        elif line:
            cur.append(line)
            length += len(line)
        elif cur:
            done.append("\n".join(cur))
            cur, length = [], 0
    return [p.strip() for p in done + (["\n".join(cur)] if cur else [])]


def test_line_chunks_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.lit("f").alias("source_file"), F.col("doc_id").alias("page"), F.regexp_replace("text", r"\. A", ".\n\nA").alias("text")
    )
    for size, overlap in ((700, 80), (60, 20)):
        got = {}
        for r in ck.line_chunks(docs, size, overlap).orderBy("page", "chunk_no").collect():
            got.setdefault(r.page, []).append(r.text)
        for r in docs.collect():
            assert got.get(r.page, []) == [p for p in pack(r.text, size, overlap) if p], r.page


def test_book_without_contents_is_one_chapter(spark):
    from folioscope.operators import segment as sg

    toc = spark.createDataFrame(
        [("a", 1, "One", 3, 1), ("a", 1, "Two", 3, 2), ("a", 1, "Three", 7, 1)],
        "textbook_id string, level int, title string, page_start int, pos int",
    )
    totals = spark.createDataFrame([("a", 9), ("b", 4)], "textbook_id string, total_pages int")
    got = {(r.textbook_id, r.chapter_id, r.title): (r.page_start, r.page_end) for r in sg.whole_book_ranges(toc, totals).collect()}
    assert got == {
        ("a", "ch_001", "One"): (3, 3), ("a", "ch_002", "Two"): (3, 6), ("a", "ch_003", "Three"): (7, 9),
        ("b", "ch_001", "全文"): (1, 4),
    }
