"""Answers and citations from ranked evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx


def ranked_list(evidence: DataFrame, limit: int | None, *columns: str, by: str = "query_id") -> DataFrame:
    """(by, items, n): the first rows of each query as an array in rank order.

    Only the rows that are shown are gathered, never a whole result list.
    """
    kept = evidence if limit is None else evidence.filter(F.col("rank") <= limit)
    return kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("items"))


def citation(item: Column) -> Column:
    """Book, chapter, page and a 180-character quote (A2)."""
    return F.struct(
        item["book"].alias("book"),
        item["chapter"].alias("chapter"),
        item["page"].alias("page"),
        tx.quote(item["quote"], 180).alias("quote"),
    )


def ask_answers(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Extractive answer, citations and one flashcard per question (A1).

    questions(query_id, question); a question without evidence gets the fixed text.
    """
    items = ranked_list(evidence, 6, "book", "chapter", "page", "quote")
    counts = evidence.groupBy("query_id").agg(F.count("*").alias("retrieved_count"))
    rows = questions.join(items, "query_id", "left").join(counts, "query_id", "left").select(
        "query_id",
        "question",
        tx.keywords(F.col("question")).alias("keywords"),
        "items",
        F.coalesce("retrieved_count", F.lit(0)).alias("retrieved_count"),
    )
    found = F.col("items").isNotNull()
    word = F.get("keywords", F.lit(0))
    topic = F.coalesce(word, F.when(found, F.substring("question", 1, 20)).otherwise(F.col("question")))
    top = F.slice("items", 1, 3)
    quotes = F.filter(F.transform(top, lambda i: i["quote"]), lambda q: F.length(q) > 0)
    answer = F.concat(
        F.lit("围绕“"),
        topic,
        F.lit("”，教材证据提示："),
        F.array_join(F.transform(quotes, lambda q: tx.quote(q, 90)), "；"),
        F.lit(f"\n\n{lx.SAFETY_NOTE}"),
    )
    card = F.struct(
        topic.alias("title"),
        tx.quote(F.get("items", F.lit(0))["quote"], 120).alias("definition"),
        F.transform(quotes, lambda q: tx.quote(q, 70)).alias("key_points"),
        F.slice("keywords", 2, 5).alias("related_terms"),
        F.transform(top, lambda i: F.struct(i["book"].alias("book"), i["page"].alias("page"))).alias("source_refs"),
    )
    return rows.select(
        "query_id",
        topic.alias("topic"),
        F.when(found, answer).otherwise(lx.NO_EVIDENCE_ANSWER).alias("answer"),
        "keywords",
        F.coalesce(F.transform("items", citation), F.array()).alias("citations"),
        F.when(found, card).alias("flashcard"),
        "retrieved_count",
    )


def search_response(evidence: DataFrame) -> DataFrame:
    """Citation and source chunk of every evidence row (A3)."""
    return evidence.select(
        "query_id",
        "rank",
        "chunk_id",
        F.col("book").alias("textbook"),
        "chapter",
        "page",
        F.col("score").alias("relevance_score"),
        F.substring("quote", 1, 300).alias("quote"),
        F.substring("text", 1, 500).alias("chunk_text"),
    )


def citation_answers(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answer made of the first three citations only (A4)."""
    line = F.concat(
        F.format_string("[%d] [%s, %s, 第 %d 页]", "rank", "book", "chapter", "page"),
        F.when(
            F.length("quote") > 0,
            F.concat(F.lit('\n    "'), F.substring("quote", 1, 150), F.lit('..."')),
        ).otherwise(""),
    )
    shown = evidence.filter(F.col("rank") <= 3).select("query_id", "rank", line.alias("line"))
    lines = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    body = F.concat(
        F.lit("根据检索到的教材内容，回答如下：\n\n"),
        F.array_join("l.line", "\n"),
        F.lit("\n\n请注意，以上内容均来自上述引用来源。"),
    )
    return questions.select("query_id").join(lines, "query_id", "left").select(
        "query_id", F.when(F.col("l").isNotNull(), body).otherwise(lx.NO_RESULT_ANSWER).alias("answer")
    )


def brief_sources(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct (file, page) lines in rank order (A5)."""
    pages = evidence.groupBy("query_id", "source_file", "page").agg(F.min("rank").alias("rank"))
    lines = pages.select(
        "query_id", "rank", F.format_string("- %s，第 %d 页", "source_file", "page").alias("line")
    )
    grouped = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return questions.select("query_id").join(grouped, "query_id", "left").select(
        "query_id", F.coalesce(F.array_join("l.line", "\n"), F.lit(lx.NO_SOURCES)).alias("sources")
    )


def context_blocks(evidence: DataFrame) -> DataFrame:
    """Numbered context text per question with score to four decimals."""
    block = F.format_string(
        "[%d] 文件名：%s；页码：%d；chunk_id：%s；相似度：%.4f；命中方式：%s\n%s",
        "rank", "source_file", "page", "chunk_id", "score", "match_type", "text",
    )
    rows = evidence.select("query_id", "rank", block.alias("block"))
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return grouped.select("query_id", F.array_join("b.block", "\n\n").alias("contexts"))


def chat_rows(answers: DataFrame) -> DataFrame:
    """Answers in chat form: citations shown as retrieved chunks."""
    shown = F.transform(
        "citations",
        lambda c: F.struct(
            c["book"].alias("source_file"), c["page"].alias("page"), c["quote"].alias("text"), F.lit("evidence").alias("match_type")
        ),
    )
    return answers.select("query_id", "answer", F.lit("ask").alias("intent"), "keywords", shown.alias("retrieved_chunks"))
