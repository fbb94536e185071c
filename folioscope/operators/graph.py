"""Evidence-linked concept graphs: one job builds or changes many graphs.

Tables are keyed by graph_id: nodes, edges and evidence.  Evidence of a graph is at most the
global k of its search, so arrays per graph stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import payload as pl
from folioscope.functions import text as tx
from folioscope.session import stage

Rules = Sequence[tuple[str, Sequence[str]]]
ROOT = "node_001"


def in_order(value: Column, order: Column) -> Column:
    """Aggregate: distinct non-empty values by first appearance."""
    pairs = F.array_sort(F.collect_list(F.when(F.length(value) > 0, F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["v"]))


def classify(text: Column, rules: Rules = tuple(lx.CLASS_RULES), default: str = lx.DEFAULT_CLASS) -> Column:
    """First class with a contained word (K1)."""
    chain = F.when(F.lit(False), F.lit(default))
    for name, words in rules:
        chain = chain.when(tx.contains_any(text, words), F.lit(name))
    return chain.otherwise(F.lit(default))


def _lookup(value: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in table.items() for v in p]), value), F.lit(default))


def type_for_name(name: Column) -> Column:
    """First type with a word contained in the name (K2)."""
    chain = F.when(F.lit(False), F.lit(""))
    for kind, words in lx.TYPE_WORDS:
        chain = chain.when(tx.contains_any(name, words), F.lit(kind))
    return chain.when(name.contains("定义"), F.lit("definition")).otherwise(F.lit("book_specific"))


def relation_for_type(kind: Column) -> Column:
    return _lookup(kind, lx.RELATION_BY_TYPE, lx.DEFAULT_RELATION)


def label_for_type(kind: Column) -> Column:
    return _lookup(kind, lx.LABEL_BY_TYPE, lx.DEFAULT_LABEL)


def label_for_relation(relation: Column) -> Column:
    return _lookup(relation, lx.LABEL_BY_RELATION, "")


def concepts(
    topics: DataFrame,
    evidence: DataFrame,
    rules: Rules = tuple(lx.CLASS_RULES),
    seeds: Sequence[str] = tuple(lx.SEED_CLASSES),
    default: str = lx.DEFAULT_CLASS,
    limit: int = 10,
    bare_seeds: int = 5,
) -> DataFrame:
    """Concepts per topic from classified evidence, the first `limit` in seed order (K3).

    topics(graph_id, topic), evidence(graph_id, rank, evidence_id, book, quote).  Without any
    evidence the first `bare_seeds` seeds are returned.
    """
    classed = evidence.withColumn("name", classify(F.col("quote"), rules, default))
    found = classed.groupBy("graph_id", "name").agg(
        F.count("*").alias("n"),
        F.min("rank").alias("first_rank"),
        F.min_by("quote", "rank").alias("first_quote"),
        in_order(F.col("book"), F.col("rank")).alias("books"),
        in_order(F.col("evidence_id"), F.col("rank")).alias("evidence_ids"),
    )
    seeded = topics.select(
        "graph_id", "topic", F.posexplode(F.array(*[F.lit(s) for s in seeds])).alias("ord", "name")
    )
    other = (
        found.filter(~F.col("name").isin(list(seeds)))
        .join(topics.select("graph_id", "topic"), "graph_id")
        .select("graph_id", "topic", (F.col("first_rank") + len(seeds)).cast("int").alias("ord"), "name")
    )
    rows = seeded.unionByName(other).join(found, ["graph_id", "name"], "left")
    is_seed = F.col("name").isin(list(seeds))
    n = F.coalesce("n", F.lit(0))
    group = W.partitionBy("graph_id")
    kept = rows.withColumn("_any", F.max(n).over(group)).filter(
        F.when(F.col("_any") > 0, n > 0).otherwise(F.col("ord") < bare_seeds)
    )
    kept = kept.withColumn("ord", F.row_number().over(group.orderBy("ord"))).filter(F.col("ord") <= limit)
    kind = type_for_name(F.col("name"))
    none = F.array().cast("array<string>")
    return kept.select(
        "graph_id",
        "topic",
        "ord",
        "name",
        kind.alias("type"),
        relation_for_type(kind).alias("relation"),
        label_for_type(kind).alias("label"),
        F.when(is_seed, F.format_string("从教材证据中整合“%s”的%s。", "topic", "name"))
        .otherwise(F.substring("first_quote", 1, 90))
        .alias("summary"),
        F.coalesce("books", none).alias("books"),
        F.coalesce("evidence_ids", none).alias("evidence_ids"),
        F.least(F.lit(0.92), F.when(is_seed, 0.55).otherwise(0.6) + 0.04 * n).alias("confidence"),
    )


def payload_concepts(
    topics: DataFrame, payloads: DataFrame, evidence: DataFrame, limit: int = 10, most_ids: int = 4, matched_ids: int = 3
) -> DataFrame:
    """Concepts from extracted node and edge payloads(graph_id, payload) (K4, K5).

    `limit` concepts of a graph, `most_ids` evidence ids of a concept, `matched_ids` that are looked up for
    a concept without any.
    """
    graph = payloads.withColumn("_j", pl.extract_json(F.col("payload"))).join(topics, "graph_id")
    raw = graph.select(
        "graph_id", "topic", F.posexplode(F.try_variant_get("_j", "$.nodes", "array<variant>")).alias("pos", "_n")
    )
    n = F.col("_n")
    ids = F.coalesce(pl.list_field(n, "evidence_ids"), pl.list_field(n, "evidence_id"))
    named = raw.select(
        "graph_id",
        "topic",
        "pos",
        tx.strip(F.coalesce(pl.string_field(n, "name"), F.lit(""))).alias("name"),
        pl.aliased(
            F.coalesce(pl.string_field(n, "type"), F.lit("concept")), lx.NODE_TYPE_ALIASES, lx.NODE_TYPES, "concept"
        ).alias("type"),
        F.coalesce(pl.string_field(n, "summary"), F.format_string("基于教材证据抽取的“%s”相关节点。", "topic")).alias("summary"),
        F.filter(ids, lambda i: i != "").alias("ids"),
        F.least(F.lit(0.98), F.greatest(F.lit(0.1), pl.number_field(n, "confidence", 0.72))).alias("confidence"),
    ).filter((F.col("name") != "") & (F.col("name") != F.col("topic")))
    once = named.withColumn(
        "_again", F.row_number().over(W.partitionBy("graph_id", "name").orderBy("pos"))
    ).filter(F.col("_again") == 1)
    # names are looked for in the topic's own evidence: an equi join per graph
    seen = once.select("graph_id", "name").join(evidence.select("graph_id", "rank", "evidence_id", "quote"), "graph_id")
    matched = seen.groupBy("graph_id", "name").agg(
        F.slice(in_order(F.when(F.contains("quote", "name"), F.col("evidence_id")), F.col("rank")), 1, matched_ids).alias("matched"),
        F.min_by("evidence_id", "rank").alias("first_id"),
    )
    linked = once.join(matched, ["graph_id", "name"], "left").withColumn(
        "evidence_ids",
        F.coalesce(
            F.when(F.size("ids") > 0, F.col("ids")),
            F.when(F.size("matched") > 0, F.col("matched")),
            F.when(F.col("first_id").isNotNull(), F.array("first_id")),
        ),
    ).filter(F.col("evidence_ids").isNotNull())
    books = (
        linked.select("graph_id", "name", F.explode("evidence_ids").alias("evidence_id"))
        .join(evidence.select("graph_id", "evidence_id", "book"), ["graph_id", "evidence_id"])
        .filter(F.length("book") > 0)
        .groupBy("graph_id", "name")
        .agg(F.sort_array(F.collect_set("book")).alias("books"))
    )
    edges = graph.select(
        "graph_id", "topic", F.posexplode(F.try_variant_get("_j", "$.edges", "array<variant>")).alias("pos", "_e")
    ).select(
        "graph_id",
        "topic",
        "pos",
        tx.strip(F.coalesce(pl.string_field(F.col("_e"), "source"), F.lit(""))).alias("source"),
        tx.strip(F.coalesce(pl.string_field(F.col("_e"), "target"), F.lit(""))).alias("target"),
        pl.aliased(
            F.coalesce(pl.string_field(F.col("_e"), "relation"), F.lit("")), lx.RELATION_ALIASES, lx.RELATIONS, lx.DEFAULT_RELATION
        ).alias("relation"),
    )
    # an edge with the topic comes before any other edge of the node (K5)
    ends = edges.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("name"))
    with_topic = (F.col("source") == F.col("topic")) | (F.col("target") == F.col("topic"))
    relations = ends.groupBy("graph_id", "name").agg(
        F.min_by("relation", F.struct(F.when(with_topic, 0).otherwise(1).alias("p"), F.col("pos"))).alias("edge_relation")
    )
    rows = linked.join(books, ["graph_id", "name"], "left").join(relations, ["graph_id", "name"], "left")
    relation = F.coalesce("edge_relation", relation_for_type(F.col("type")))
    label = label_for_relation(relation)
    ordered = rows.withColumn("ord", F.row_number().over(W.partitionBy("graph_id").orderBy("pos")))
    return ordered.filter(F.col("ord") <= limit).select(
        "graph_id",
        "topic",
        "ord",
        "name",
        "type",
        relation.alias("relation"),
        F.when(label != "", label).otherwise(label_for_type(F.col("type"))).alias("label"),
        F.substring("summary", 1, 120).alias("summary"),
        F.coalesce("books", F.array().cast("array<string>")).alias("books"),
        F.slice("evidence_ids", 1, most_ids).alias("evidence_ids"),
        "confidence",
    )


def _node_id(n: Column) -> Column:
    return F.format_string("node_%03d", n)


def _edge_id(n: Column) -> Column:
    return F.format_string("edge_%03d", n)


def build_nodes(topics: DataFrame, evidence: DataFrame, found: DataFrame, root_ids: int = 5) -> DataFrame:
    """Root node, with the first `root_ids` evidence ids, and concept nodes of every topic (K6)."""
    sources = evidence.groupBy("graph_id").agg(
        F.sort_array(F.collect_set(F.when(F.length("book") > 0, F.col("book")))).alias("book_sources"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence_id"))), lambda e: e["evidence_id"]), 1, root_ids).alias("evidence_ids"),
    )
    none = F.array().cast("array<string>")
    root = topics.join(sources, "graph_id", "left").select(
        "graph_id",
        F.lit(1).alias("ord"),
        F.lit(ROOT).alias("node_id"),
        F.col("topic").alias("name"),
        F.lit("concept").alias("type"),
        F.lit(0).alias("level"),
        F.format_string("%s 的跨教材整合主题节点。", "topic").alias("summary"),
        F.coalesce("book_sources", none).alias("book_sources"),
        F.coalesce("evidence_ids", none).alias("evidence_ids"),
        F.when(F.col("evidence_ids").isNotNull(), 0.85).otherwise(0.2).alias("confidence"),
        F.lit("normal").alias("status"),
    )
    number = F.col("ord") + 1
    return root.unionByName(
        found.select(
            "graph_id",
            number.alias("ord"),
            _node_id(number).alias("node_id"),
            "name",
            "type",
            F.when(number <= 7, 1).otherwise(2).alias("level"),
            "summary",
            F.col("books").alias("book_sources"),
            "evidence_ids",
            "confidence",
            F.lit("normal").alias("status"),
        )
    )


def build_edges(found: DataFrame, edge_ids: int = 2) -> DataFrame:
    """Star edges from the root to every concept, with its first `edge_ids` evidence ids (K6)."""
    return found.select(
        "graph_id",
        "ord",
        _edge_id(F.col("ord")).alias("edge_id"),
        F.lit(ROOT).alias("source"),
        _node_id(F.col("ord") + 1).alias("target"),
        "relation",
        "label",
        F.format_string("%s 与 %s 相关。", "name", "topic").alias("summary"),
        F.slice("evidence_ids", 1, edge_ids).alias("evidence_ids"),
        "confidence",
        F.lit("normal").alias("status"),
    )


def update_graph(
    nodes: DataFrame,
    edges: DataFrame,
    evidence: DataFrame,
    followup_evidence: DataFrame,
    found: DataFrame,
    limit: int = 4,
    edge_ids: int = 2,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(added nodes, added edges, evidence) after a follow-up question (K7).

    The first `limit` concepts are taken before names that exist already are left out; ids go
    on from the present counts.
    """
    unseen = followup_evidence.join(evidence.select("graph_id", "evidence_id"), ["graph_id", "evidence_id"], "left_anti")
    merged = evidence.unionByName(unseen.dropDuplicates(["graph_id", "evidence_id"]), allowMissingColumns=True)
    new = found.filter(F.col("ord") <= limit).join(nodes.select("graph_id", "name"), ["graph_id", "name"], "left_anti")
    n_nodes = nodes.groupBy("graph_id").agg(F.count("*").alias("_nodes"))
    n_edges = edges.groupBy("graph_id").agg(F.count("*").alias("_edges"))
    rows = (
        new.join(n_nodes, "graph_id")
        .join(n_edges, "graph_id", "left")
        .withColumn("_k", F.row_number().over(W.partitionBy("graph_id").orderBy("ord")))
        .withColumns(
            {
                "_node": F.col("_k") + F.col("_nodes"),
                "_edge": F.col("_k") + F.coalesce("_edges", F.lit(0)),
            }
        )
    )
    added_nodes = rows.select(
        "graph_id",
        F.col("_node").cast("int").alias("ord"),
        _node_id(F.col("_node")).alias("node_id"),
        "name",
        "type",
        F.lit(2).alias("level"),
        "summary",
        F.col("books").alias("book_sources"),
        "evidence_ids",
        "confidence",
        F.lit("added").alias("status"),
    )
    added_edges = rows.select(
        "graph_id",
        F.col("_edge").cast("int").alias("ord"),
        _edge_id(F.col("_edge")).alias("edge_id"),
        F.lit(ROOT).alias("source"),
        _node_id(F.col("_node")).alias("target"),
        F.lit(lx.DEFAULT_RELATION).alias("relation"),
        F.lit("补充").alias("label"),
        F.format_string("根据追问补充 %s 节点。", "name").alias("summary"),
        F.slice("evidence_ids", 1, edge_ids).alias("evidence_ids"),
        "confidence",
        F.lit("added").alias("status"),
    )
    return added_nodes, added_edges, merged


def chapter_graphs(books: DataFrame, chapters: DataFrame, limit: int = 30) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a book with its first chapters (K8).

    The count is a partial aggregate and the first chapters are cut before the shuffle, so
    a book with very many chapters does not gather in one task.
    """
    none = F.array().cast("array<string>")
    counted = chapters.groupBy("textbook_id").agg(F.count("*").alias("n"))
    titles = books.select("textbook_id", "title")
    root = titles.join(counted, "textbook_id").select(
        F.col("textbook_id").alias("graph_id"),
        F.lit(1).alias("ord"),
        F.lit(ROOT).alias("node_id"),
        F.col("title").alias("name"),
        F.lit("book").alias("type"),
        F.lit(0).alias("level"),
        F.format_string("医学教材：%s，共 %d 个章节", "title", "n").alias("summary"),
        F.array("title").alias("book_sources"),
        none.alias("evidence_ids"),
        F.lit(0.95).alias("confidence"),
        F.lit("normal").alias("status"),
        F.lit(None).cast("long").alias("page"),
    )
    first = W.partitionBy("textbook_id").orderBy("page_start", "chapter_id")
    shown = (
        chapters.select("textbook_id", "chapter_id", F.col("title").alias("chapter"), "page_start", "page_end", "char_count")
        .withColumn("ord", F.row_number().over(first))
        .filter(F.col("ord") <= limit)
        .join(titles, "textbook_id")
    )
    leaves = shown.select(
        F.col("textbook_id").alias("graph_id"),
        (F.col("ord") + 1).alias("ord"),
        _node_id(F.col("ord") + 1).alias("node_id"),
        F.col("chapter").alias("name"),
        F.lit("chapter").alias("type"),
        F.lit(1).alias("level"),
        F.format_string("%s，第 %d-%d 页，字数 %d", "chapter", "page_start", "page_end", "char_count").alias("summary"),
        F.array("title").alias("book_sources"),
        none.alias("evidence_ids"),
        F.lit(0.85).alias("confidence"),
        F.lit("normal").alias("status"),
        F.col("page_start").cast("long").alias("page"),
    )
    edges = shown.select(
        F.col("textbook_id").alias("graph_id"),
        "ord",
        _edge_id(F.col("ord")).alias("edge_id"),
        F.lit(ROOT).alias("source"),
        _node_id(F.col("ord") + 1).alias("target"),
        F.lit("contains").alias("relation"),
        F.lit("章节").alias("label"),
        F.format_string("%s 包含 %s", "title", "chapter").alias("summary"),
        none.alias("evidence_ids"),
        F.lit(0.9).alias("confidence"),
        F.lit("normal").alias("status"),
    )
    return root.unionByName(leaves), edges


def single_book_plan(requests: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """How each request(request_id, textbook_id, chapter_id) is served (K9).

    A known chapter gives a focused search graph that carries its page, an unknown one a
    search graph, none the chapter graph, a book without chapters a search graph.
    """
    counted = chapters.groupBy("textbook_id").agg(F.count("*").alias("_n"))
    chosen = chapters.select("textbook_id", "chapter_id", F.col("title").alias("_chapter"), F.col("page_start").alias("_page"))
    rows = (
        requests.join(books.select("textbook_id", "title"), "textbook_id", "left")
        .join(counted, "textbook_id", "left")
        .join(chosen, ["textbook_id", "chapter_id"], "left")
        .withColumn("_book", F.coalesce("title", "textbook_id"))
    )
    asked = F.length("chapter_id") > 0
    branch = (
        F.when(F.col("_n").isNull(), "search_book")
        .when(asked & F.col("_chapter").isNotNull(), "chapter")
        .when(asked, "search_chapter")
        .otherwise("chapters")
    )
    search = (
        F.when(F.col("branch") == "chapter", F.concat_ws(" ", "_book", "_chapter"))
        .when(F.col("branch") == "search_chapter", F.concat(F.lit("教材:"), "_book", F.lit(" "), "chapter_id"))
        .when(F.col("branch") == "search_book", F.concat(F.lit("教材:"), "_book"))
    )
    return rows.withColumn("branch", branch).select(
        "request_id",
        "textbook_id",
        "branch",
        F.when(F.col("branch") == "chapter", F.col("_chapter")).otherwise(F.col("_book")).alias("topic"),
        search.alias("query"),
        F.when(F.col("branch") == "chapter", F.col("_page")).alias("page"),
    )


def single_book_graph(
    plan: DataFrame, chapter_nodes: DataFrame, chapter_edges: DataFrame, found_nodes: DataFrame, found_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every planned request in one graph table keyed by request (K9).

    `plan` is that of `single_book_plan`.  Requests for a book's chapters take the chapter graph,
    keyed by textbook_id; all others the graph built from their search, keyed by request_id as text.
    The root of a focused graph carries its chapter's title and page.
    """
    request = F.col("request_id").cast("string")
    by_book = plan.filter(F.col("branch") == "chapters").select(request.alias("request"), "textbook_id")
    by_search = plan.filter(F.col("branch") != "chapters").select(
        request.alias("request"),
        "textbook_id",
        F.when(F.col("branch") == "chapter", F.col("topic")).alias("_chapter"),
        F.col("page").cast("long").alias("_page"),
    )

    def of_books(rows: DataFrame) -> DataFrame:
        asked = rows.join(by_book, rows["graph_id"] == by_book["textbook_id"])
        return asked.withColumn("graph_id", F.col("request")).drop("request")

    def of_searches(rows: DataFrame) -> DataFrame:
        asked = rows.join(by_search, rows["graph_id"] == by_search["request"])
        return asked.drop("request")

    shown = [c for c in found_nodes.columns if c != "page"]
    is_root = F.col("node_id") == ROOT
    searched = of_searches(found_nodes.select(*shown)).withColumns(
        {"chapter": F.when(is_root, F.col("_chapter")), "page": F.when(is_root, F.col("_page"))}
    )
    listed = of_books(chapter_nodes).withColumn("chapter", F.lit(None).cast("string"))
    columns = ["textbook_id", *shown, "chapter", "page"]
    nodes = listed.select(*columns).unionByName(searched.select(*columns))
    links = ["textbook_id", *found_edges.columns]
    edges = of_books(chapter_edges).select(*links).unionByName(of_searches(found_edges).select(*links))
    return nodes, edges


def of_textbooks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Evidence or chunk rows of the wanted(textbook_id) books only; an empty request means all."""
    if wanted.isEmpty():
        return rows
    return rows.join(wanted.select("textbook_id").distinct(), "textbook_id", "left_semi")


def mark_expanded(nodes: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all nodes, updated nodes) with expanded = true for the frontier; books are never expanded."""
    done = frontier.filter(F.col("type") != "book").select("graph_id", "node_id", F.lit(True).alias("_done")).distinct()
    marked = nodes.join(done, ["graph_id", "node_id"], "left")
    before = F.col("expanded") if "expanded" in nodes.columns else F.lit(False)
    marked = marked.withColumn("expanded", F.coalesce("_done", before, F.lit(False)))
    return marked.drop("_done"), marked.filter("_done").drop("_done")


def expansion_queries(frontier: DataFrame, topics: DataFrame) -> DataFrame:
    """Search text and hit limit for nodes to expand; books are not expanded."""
    rows = frontier.join(topics.select("graph_id", "topic"), "graph_id").filter(F.col("type") != "book")
    is_chapter = F.col("type") == "chapter"
    book = F.coalesce(F.get("book_sources", F.lit(0)), F.col("topic"))
    return rows.select(
        "graph_id",
        "node_id",
        "name",
        "type",
        F.when(is_chapter, F.concat_ws(" ", book, "name")).otherwise(F.col("name")).alias("query"),
        F.when(is_chapter, 15).otherwise(10).alias("top_k"),
    )


def expand_nodes(
    frontier: DataFrame, nodes: DataFrame, edges: DataFrame, found: DataFrame, limit: int = 8
) -> tuple[DataFrame, DataFrame]:
    """(added nodes, added edges) for a frontier of nodes.

    `found` are concepts whose graph_id is `graph_id::node_id`, where only the graph id may hold `::`; names that exist already are
    not tested.  Ids go on from the present counts in frontier order.
    """
    ends = frontier.select(
        "graph_id", F.col("node_id").alias("parent_id"), F.col("name").alias("parent"), F.col("type").alias("parent_type")
    )
    keyed = found.filter(F.col("ord") <= limit).withColumns(
        {
            "parent_id": F.substring_index("graph_id", "::", -1),
            "graph_id": F.expr("left(graph_id, length(graph_id) - length(substring_index(graph_id, '::', -1)) - 2)"),
        }
    )
    n_nodes = nodes.groupBy("graph_id").agg(F.count("*").alias("_nodes"))
    n_edges = edges.groupBy("graph_id").agg(F.count("*").alias("_edges"))
    rows = (
        keyed.join(ends, ["graph_id", "parent_id"])
        .join(n_nodes, "graph_id")
        .join(n_edges, "graph_id", "left")
        .withColumn("_k", F.row_number().over(W.partitionBy("graph_id").orderBy("parent_id", "ord")))
    )
    node_no, edge_no = F.col("_k") + F.col("_nodes"), F.col("_k") + F.coalesce("_edges", F.lit(0))
    is_chapter = F.col("parent_type") == "chapter"
    added_nodes = rows.select(
        "graph_id",
        "parent_id",
        _node_id(node_no).alias("node_id"),
        "name",
        "type",
        F.lit(2).alias("level"),
        F.substring("summary", 1, 200).alias("summary"),
        F.col("books").alias("book_sources"),
        "evidence_ids",
        "confidence",
        F.lit("added").alias("status"),
        F.lit(True).alias("expandable"),
        F.lit(False).alias("expanded"),
    )
    added_edges = rows.select(
        "graph_id",
        _edge_id(edge_no).alias("edge_id"),
        F.col("parent_id").alias("source"),
        _node_id(node_no).alias("target"),
        F.when(is_chapter, "contains").otherwise("related_to").alias("relation"),
        F.when(is_chapter, "包含").otherwise("相关").alias("label"),
        F.when(is_chapter, F.format_string("%s 包含 %s", "parent", "name"))
        .otherwise(F.format_string("%s 相关概念", "parent"))
        .alias("summary"),
        "evidence_ids",
        "confidence",
        F.lit("added").alias("status"),
    )
    return added_nodes, added_edges


def expand_rounds(
    nodes: DataFrame,
    edges: DataFrame,
    topics: DataFrame,
    frontier: DataFrame,
    search: Callable[[DataFrame, int], DataFrame],
    rounds: int = 1,
    rules: Rules = tuple(lx.CLASS_RULES),
    limit: int = 8,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(added nodes, added edges, expanded nodes) of `rounds` rounds of expansion, each row with its round.

    A round searches the texts of its frontier, adds the concepts found, and hands the added nodes to
    the next one.  `search(queries, k)` returns evidence rows of queries(query_id, query).  Equal texts
    are searched once, whatever graph they are of.  In a graph a text is expanded once, by the node of
    the smallest id; nodes with a text that was expanded before stay as they are, so rounds come to an
    end.  Nodes without a text and books are not expanded.  Every round is staged.
    """
    key = F.concat_ws("::", "graph_id", "node_id")
    held_nodes, held_edges = nodes.select("graph_id"), edges.select("graph_id")
    added, linked, done = [], [], []
    for number in range(1, rounds + 1):
        asked = expansion_queries(frontier, topics).filter(F.col("query").isNotNull())
        for before in done:
            asked = asked.join(before.select("graph_id", "query"), ["graph_id", "query"], "left_anti")
        first = F.min(F.struct("node_id", "name", "type", "top_k")).alias("first")
        chosen = asked.groupBy("graph_id", "query").agg(first).select("graph_id", "query", "first.*")
        chosen = stage(chosen.withColumn("round", F.lit(number)), "frontier")
        most = chosen.agg(F.max("top_k")).first()[0]
        if most is None and done:
            break
        texts = chosen.select(F.col("query").alias("query_id"), "query").distinct()
        wanted = chosen.select(key.alias("graph_id"), F.col("query").alias("query_id"), "top_k")
        hits = search(texts, most or 1).join(wanted, "query_id").filter(F.col("rank") <= F.col("top_k"))
        names = chosen.select(key.alias("graph_id"), F.col("name").alias("topic"))
        found = stage(concepts(names, hits, rules), "found")
        more, links = expand_nodes(chosen, held_nodes, held_edges, found, limit)
        more = stage(more.withColumn("round", F.lit(number)), "added")
        links = stage(links.withColumn("round", F.lit(number)), "linked")
        held_nodes = held_nodes.unionByName(more.select("graph_id"))
        held_edges = held_edges.unionByName(links.select("graph_id"))
        added.append(more)
        linked.append(links)
        done.append(chosen)
        frontier = more
    new_nodes, new_edges, expanded = (reduce(DataFrame.unionByName, parts) for parts in (added, linked, done))
    return mark_expanded(new_nodes, expanded)[0], new_edges, expanded


def patch_diff(
    current_nodes: DataFrame, current_edges: DataFrame, patch_nodes: DataFrame, patch_edges: DataFrame, returned_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Patch rows a client does not hold yet."""
    node, edge = ["graph_id", "node_id"], ["graph_id", "edge_id"]
    new_nodes = patch_nodes.join(current_nodes.select(*node), node, "left_anti")
    new_edges = patch_edges.join(returned_edges.select(*edge), edge, "left_semi").join(
        current_edges.select(*edge), edge, "left_anti"
    )
    return new_nodes, new_edges
