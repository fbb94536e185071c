"""Overlap, compression, reports and evidence flows over graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx
from folioscope.operators.answers import citation


def compare_sources(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Books behind each node, and whether they overlap."""
    linked = nodes.select("graph_id", "node_id", F.explode("evidence_ids").alias("evidence_id")).join(
        evidence.select("graph_id", "evidence_id", "book"), ["graph_id", "evidence_id"]
    )
    books = linked.filter(F.length("book") > 0).groupBy("graph_id", "node_id").agg(
        F.sort_array(F.collect_set("book")).alias("books")
    )
    rows = nodes.select("graph_id", "node_id", "name").join(books, ["graph_id", "node_id"], "left")
    shared = F.coalesce(F.size("books") > 1, F.lit(False))
    return rows.select(
        "graph_id",
        "node_id",
        "name",
        F.coalesce("books", F.array().cast("array<string>")).alias("books"),
        shared.alias("shared"),
        F.when(shared, lx.OVERLAP_SHARED).otherwise(lx.OVERLAP_SINGLE).alias("overlap_analysis"),
        F.when(shared, lx.COMPLEMENT_SHARED).otherwise(lx.COMPLEMENT_SINGLE).alias("complement_analysis"),
    )


def compression_ratio(original_chars: Column, integrated_chars: Column) -> Column:
    """Integrated over original characters to four decimals, zero without originals."""
    return F.when(original_chars > 0, F.round(integrated_chars / original_chars, 4)).otherwise(0.0)


def summarise(topics: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Integration record per graph: coverage text and compression."""
    covered = evidence.groupBy("graph_id").agg(
        F.count_distinct(F.when(F.length("book") > 0, F.col("book"))).alias("books"),
        F.sum(F.length("quote")).alias("original_chars"),
    )
    # summaries joined by one separator: lengths add up, no text is gathered
    texts = nodes.groupBy("graph_id").agg((F.sum(F.length("summary")) + F.count("*") - 1).alias("integrated_chars"))
    rows = topics.join(covered, "graph_id", "left").join(texts, "graph_id", "left")
    original = F.coalesce("original_chars", F.lit(0))
    integrated = F.coalesce(F.when(F.col("integrated_chars") > 0, F.col("integrated_chars")), F.length("topic").cast("long"))
    return rows.select(
        "graph_id",
        "topic",
        F.format_string(
            "围绕“%s”，当前证据覆盖 %d 本教材；多书共同出现的内容可视为重点概念。", "topic", F.coalesce("books", F.lit(0))
        ).alias("overlap_summary"),
        F.lit(lx.COMPLEMENT_SUMMARY).alias("complement_summary"),
        F.lit(lx.MISSING_SUMMARY).alias("missing_summary"),
        original.alias("original_chars"),
        integrated.alias("integrated_chars"),
        compression_ratio(original, integrated).alias("compression_ratio"),
    )


def node_detail(nodes: DataFrame, evidence: DataFrame, searched: DataFrame, fallback: int = 5) -> DataFrame:
    """Definition, detail and citations of each node.

    Sources are the node's own evidence, else the first `fallback` rows of its search
    searched(graph_id, node_id, rank, ...).  Whether several books share the node is judged by its own
    evidence alone.
    """
    keys = ["graph_id", "node_id"]
    columns = ["rank", "evidence_id", "book", "chapter", "page", "quote"]
    own = nodes.select(*keys, F.explode("evidence_ids").alias("evidence_id")).join(
        evidence.select("graph_id", *columns), ["graph_id", "evidence_id"]
    )
    other = searched.filter(F.col("rank") <= fallback).join(own.select(*keys).distinct(), keys, "left_anti")
    sources = own.select(*keys, *columns, F.col("book").alias("own_book")).unionByName(
        other.select(*keys, *columns, F.lit("").alias("own_book"))
    )
    items = sources.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "book", "chapter", "page", "quote"))).alias("items"),
        F.count_distinct(F.when(F.length("own_book") > 0, F.col("own_book"))).alias("n_books"),
    )
    rows = nodes.select(*keys, "name", "summary").join(items, keys, "left")
    first = F.coalesce(F.get("items", F.lit(0))["quote"], F.lit(""))
    has_quote = F.length(first) > 0
    shared = F.coalesce(F.col("n_books") > 1, F.lit(False))
    return rows.select(
        *keys,
        "name",
        F.when(has_quote, tx.quote(first, 120)).otherwise("当前节点证据不足。").alias("definition"),
        F.when(F.length("summary") > 0, F.col("summary"))
        .when(has_quote, tx.quote(first, 260))
        .otherwise("可继续检索补充该节点证据。")
        .alias("detail"),
        F.when(shared, lx.OVERLAP_SHARED).otherwise(lx.OVERLAP_SINGLE).alias("overlap_analysis"),
        F.when(shared, lx.COMPLEMENT_SHARED).otherwise(lx.COMPLEMENT_SINGLE).alias("complement_analysis"),
        F.coalesce(F.transform("items", citation), F.array()).alias("sources"),
    )


def plain_number(value: Column, digits: int = 4) -> Column:
    """A double without exponent: at most `digits` decimals, at least one."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value), r"(\.\d+?)0+$", "$1")


def _lines(rows: DataFrame, order: str, line: Column, name: str) -> DataFrame:
    listed = rows.select("graph_id", F.struct(F.col(order).alias("o"), line.alias("l")).alias("_p"))
    grouped = listed.groupBy("graph_id").agg(F.array_sort(F.collect_list("_p")).alias("_l"))
    return grouped.select("graph_id", F.array_join("_l.l", "\n").alias(name))


def report(
    nodes: DataFrame, edges: DataFrame, evidence: DataFrame, feedback: DataFrame, integration: DataFrame
) -> DataFrame:
    """One Markdown report text per graph.

    feedback(graph_id, seq, time, action, target_id, comment).
    """
    counts = nodes.groupBy("graph_id").agg(
        F.count("*").alias("n_nodes"), F.min_by("summary", "ord").alias("first_summary")
    )
    n_edges = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    live = nodes.filter(F.col("status") != "deleted")
    parts = [
        counts,
        n_edges,
        _lines(live, "ord", F.concat(F.lit("- **"), "name", F.lit("**："), "summary"), "node_lines"),
        _lines(
            feedback,
            "seq",
            F.concat(F.lit("- "), "time", F.lit(" ["), "action", F.lit("] "), "target_id", F.lit(": "), "comment"),
            "feedback_lines",
        ),
        _lines(
            evidence,
            "rank",
            F.concat(
                F.lit("- "), "book", F.lit("，"), "chapter", F.lit("，第 "), "page", F.lit(" 页："), tx.quote(F.col("quote"), 80)
            ),
            "source_lines",
        ),
    ]
    rows = integration
    for part in parts:
        rows = rows.join(part, "graph_id", "left")
    body = [
        F.format_string("# 主题：%s", "topic"),
        F.lit(""),
        F.lit("## 1. 核心概念概述"),
        F.coalesce("first_summary", F.lit("证据不足。")),
        F.lit(""),
        F.lit("## 2. 跨教材知识图谱摘要"),
        F.format_string(
            "当前图谱包含 %d 个节点、%d 条关系。", F.coalesce("n_nodes", F.lit(0)), F.coalesce("n_edges", F.lit(0))
        ),
        F.lit(""),
        F.lit("## 3. 主要节点说明"),
        F.col("node_lines"),
        F.lit(""),
        F.lit("## 4. 跨教材重复知识点"),
        F.col("overlap_summary"),
        F.lit(""),
        F.lit("## 5. 跨教材互补知识点"),
        F.col("complement_summary"),
        F.lit(""),
        F.lit("## 6. 可能缺失或证据不足的部分"),
        F.col("missing_summary"),
        F.lit(""),
        F.lit("## 7. 教师反馈记录"),
        F.coalesce("feedback_lines", F.lit("暂无教师反馈。")),
        F.lit(""),
        F.lit("## 8. 压缩比说明"),
        F.concat(
            F.lit("原始证据字符数："), "original_chars", F.lit("；整合字符数："), "integrated_chars",
            F.lit("；压缩比："), plain_number(F.col("compression_ratio")), F.lit("。"),
        ),
        F.lit(""),
        F.lit("## 9. 教材引用来源"),
        F.col("source_lines"),
    ]
    return rows.select("graph_id", "topic", F.concat_ws("\n", *body).alias("markdown"))


def evidence_flow(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted links book to chapter and chapter to node type per graph."""
    book = F.coalesce(F.when(F.length("book") > 0, F.col("book")), F.when(F.length("source_file") > 0, F.col("source_file")), F.lit(lx.UNKNOWN_BOOK))
    rows = evidence.select(
        "graph_id", "evidence_id", book.alias("book"), tx.or_default(F.col("chapter"), lx.UNRECOGNISED_CHAPTER).alias("chapter")
    )
    linked = nodes.filter(F.col("status") != "deleted").select(
        "graph_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"), "type"
    )
    first = rows.select(
        "graph_id", F.concat(F.lit("教材::"), "book").alias("source"), F.concat(F.lit("章节::"), "chapter").alias("target")
    )
    second = rows.join(linked, ["graph_id", "evidence_id"], "left").select(
        "graph_id",
        F.concat(F.lit("章节::"), "chapter").alias("source"),
        F.concat(F.lit("节点类型::"), F.coalesce("type", F.lit(lx.UNLINKED_TYPE))).alias("target"),
    )
    return first.unionByName(second).groupBy("graph_id", "source", "target").agg(F.count("*").alias("value"))


def flow_nodes(links: DataFrame, limit: int = 18) -> DataFrame:
    """Distinct ends of the links with layer and shortened name."""
    end = F.explode(F.array("source", "target")).alias("name")
    full = F.substring_index("name", "::", 1).alias("layer")
    name = F.expr("substring(name, instr(name, '::') + 2)")
    short = F.when(F.length(name) > limit, F.concat(F.substring(name, 1, limit), F.lit("..."))).otherwise(name)
    return links.select("graph_id", end).distinct().select("graph_id", "name", full, name.alias("full_name"), short.alias("display_name"))


def compare_metrics(
    graphs: DataFrame, evidence: DataFrame, nodes: DataFrame, edges: DataFrame, decisions: DataFrame, stored: DataFrame
) -> DataFrame:
    """Before and after figures per graph.

    Stored compression figures win over computed ones where they are present.
    """
    before = evidence.groupBy("graph_id").agg(
        F.count("*").alias("evidence_count"),
        F.sum(F.length("quote")).alias("_chars"),
        F.count_distinct(F.when(F.length("book") > 0, F.col("book"))).alias("textbook_count"),
        F.count_distinct(F.when(F.length("chapter") > 0, F.col("chapter"))).alias("chapter_count"),
    )
    after = nodes.groupBy("graph_id").agg(F.count("*").alias("node_count"), F.sum(F.length("summary")).alias("_summary"))
    n_edges = edges.groupBy("graph_id").agg(F.count("*").alias("edge_count"))
    actions = decisions.groupBy("graph_id").agg(
        F.count("*").alias("decision_count"),
        *[F.count_if(F.col("action") == a).alias(f"{a}_count") for a in ("merge", "keep", "remove")],
    )
    kept = stored.select("graph_id", "original_chars", "integrated_chars", "compression_ratio")
    rows = graphs.select("graph_id")
    for part in (before, after, n_edges, actions, kept):
        rows = rows.join(part, "graph_id", "left")
    original = F.coalesce(F.when(F.col("original_chars") > 0, F.col("original_chars")), F.col("_chars"), F.lit(0))
    integrated = F.coalesce(F.when(F.col("integrated_chars") > 0, F.col("integrated_chars")), F.col("_summary"), F.lit(0))
    ratio = F.coalesce(
        F.when(F.col("compression_ratio") >= 0, F.col("compression_ratio")), integrated / F.greatest(original, F.lit(1))
    )
    counts = [
        "evidence_count", "textbook_count", "chapter_count", "node_count", "edge_count",
        "decision_count", "merge_count", "keep_count", "remove_count",
    ]
    return rows.select(
        "graph_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        original.alias("original_chars"),
        integrated.alias("integrated_chars"),
        ratio.alias("compression_ratio"),
        (ratio <= lx.COMPRESSION_TARGET).alias("on_target"),
    )


def hits_per_source(hits: DataFrame) -> DataFrame:
    """Number of hits per query and file."""
    return hits.groupBy("query_id", "source_file").agg(F.count("*").alias("value"))


def score_series(hits: DataFrame) -> DataFrame:
    """Labelled score per hit."""
    return hits.select(
        "query_id",
        "rank",
        F.concat_ws("@", F.col("rank").cast("string"), F.col("page").cast("string")).alias("label"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"),
    )


def find_nodes(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """Nodes whose name or summary contains the graph's search word, case ignored.

    words(graph_id, word): an equi join per graph, the containment is its condition.
    """
    word = F.lower(tx.strip(F.col("word")))
    asked = words.select("graph_id", word.alias("_w")).filter(F.col("_w") != "")
    hit = F.contains(F.lower("name"), F.col("_w")) | F.contains(F.lower("summary"), F.col("_w"))
    return nodes.join(asked, "graph_id").filter(hit).select(*nodes.columns).distinct()


def live(elements: DataFrame) -> DataFrame:
    """Nodes or edges that are not deleted."""
    return elements.filter(F.col("status") != "deleted")


def filter_evidence(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """Evidence named by wanted(graph_id, evidence_id); graphs that name none keep all."""
    named = evidence.join(wanted, ["graph_id", "evidence_id"], "left_semi")
    rest = evidence.join(wanted.select("graph_id").distinct(), "graph_id", "left_anti")
    return named.unionByName(rest)


def pending(catalogue: DataFrame) -> DataFrame:
    """Files that are still to be parsed."""
    return catalogue.filter(F.col("parse_status").isin("pending", "failed"))
