import json

import pytest
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import payload as pl
from folioscope.operators import evaluate as ev
from folioscope.operators import feedback as fb
from folioscope.operators import graph as gr
from folioscope.operators import integration as ig
from folioscope.operators import planning as pn
from folioscope.operators import segment as sg


def test_markdown_and_plain_text_sections(spark):
    docs = spark.createDataFrame(
        [
            ("m", "intro\n# One\n\n## Empty\n### Two 12\nbody  x\n\nmore"),
            ("none", "just text"),
            ("blank", " \n "),
            ("heads", "# A\n# B"),
        ],
        "doc_id string, text string",
    )
    got = {(r.doc_id, r.chapter_id): (r.title, r.content, r.char_count) for r in sg.heading_sections(docs).collect()}
    assert got == {
        ("m", "ch_001"): ("全文", "intro", 5),
        ("m", "ch_002"): ("Two", "body x\nmore", 10),
        ("none", "ch_001"): ("全文", "just text", 9),
        ("blank", "ch_001"): ("全文", "", 0),
        ("heads", "ch_001"): ("全文", "# A\n# B", 7),
    }
    book = spark.createDataFrame([("t", "preface\n第一章 细胞\nx\nChapter 2: 目\ny")], "doc_id string, text string")
    rows = sg.heading_sections(book, "doc_id", sg.PLAIN_TEXT).orderBy("chapter_id").collect()
    assert [r.title for r in rows] == ["第 1 节", "第一章 细胞", "Chapter 2: 目"]


def test_page_ranges_and_overlap(spark):
    toc = spark.createDataFrame(
        [("b", 1, "A", 1, 0), ("b", 1, "B", 40, 1), ("b", 2, "C", 40, 2)],
        "textbook_id string, level int, title string, page_start int, pos int",
    )
    pages = spark.range(1, 101).select(F.lit("b").alias("textbook_id"), F.col("id").alias("page"), F.concat(F.lit("p"), "id").alias("text"))
    totals = sg.document_totals(pages)
    ranges = sg.toc_ranges(toc, totals)
    filled = {r.title: (r.page_start, r.page_end, r.content) for r in sg.chapter_content(ranges, pages).collect()}
    assert filled["A"][:2] == (1, 39) and filled["A"][2].split("\n\n") == [f"p{i}" for i in range(1, 40)]
    assert filled["B"] == (40, 40, "p40") and filled["C"][:2] == (40, 100) and filled["C"][2].startswith("p40\n\n")


def test_parent_mapping_fallbacks(spark):
    fields = "chunk_id string, text string, textbook_id string, book string, chapter string, chapter_id string, page_start long, page_end long, source_id string, char_start int, char_end int"
    parents = spark.createDataFrame(
        [
            ("p1", "x", "b", "B", "c", "c1", 1, 1, "s1", 0, 100),
            ("p2", "x", "b", "B", "c", "c1", 1, 1, "s1", 80, 180),
            ("p3", "x", "b", "B", "c", "c2", 1, 1, "s2", 0, 50),
        ],
        fields,
    )
    hits = spark.createDataFrame(
        [
            ("h1", "x", "b", "B", "c", "c1", 1, 1, "s1", 80, 100, 1, 1, 0.9),
            ("h2", "x", "b", "B", "c", "c1", 1, 1, "s1", 0, 30, 1, 2, 0.8),
            ("h3", "x", "b", "B", "c", "c2", 1, 1, "zz", 0, 30, 1, 3, 0.7),
            ("h4", "x", "q", "B", "c", "c9", 1, 1, "zz", 0, 30, 1, 4, 0.6),
        ],
        fields + ", query_id int, rank int, score double",
    )
    mapped = ev.map_to_parent(hits, parents)
    assert {r["rank"]: r.chunk_id for r in mapped.collect()} == {1: "p1", 2: "p1", 3: "p3", 4: "h4"}
    kept = {r.chunk_id: (r["rank"], r.matched_small_chunk_id) for r in ev.first_parents(mapped).collect()}
    assert kept == {"p1": (1, "h1"), "p3": (3, "h3"), "h4": (4, "h4")}


def test_routing_and_expansion(spark):
    rows = spark.createDataFrame(
        [(1, " 你好 ", "ask", False), (2, "请导出报告", "ask", False), (3, "加一个节点", "graph", True), (4, "画知识图谱", "ask", False),
         (5, "炎症是什么", "ask", False), (6, "炎症", "graph", False)],
        "query_id int, query string, mode string, has_graph boolean",
    )
    got = {r.query_id: r.intent for r in pn.route_intent(rows).collect()}
    assert got == {1: "greeting", 2: "report", 3: "graph_update", 4: "graph_build", 5: "ask", 6: "graph_build"}
    plans = {r.query_id: r for r in pn.gate(pn.plan_queries(rows.withColumn("query", F.when(F.col("query_id") == 3, "炎症导致疼痛").otherwise(F.col("query"))))).collect()}
    assert plans[1].intent == "greeting" and not plans[1].searched
    assert plans[3].intent == "symptom_question"
    assert plans[3].search_keywords == ["疼痛", "痛", "疼", "刺痛", "胀痛", "压痛", "炎症", "炎性反应", "渗出", "充血", "水肿"]
    assert plans[5].expanded_query == "炎症是什么 炎症 炎性反应 渗出 充血 水肿 医学教材 机制 病理 生理"
    assert plans[2].skipped == "not needed" and plans[2].should_search


def test_payloads(spark):
    texts = [
        '{"a": 1}', 'so: {"a": {"b": "}"}} ok', "[1, 2]", '{"a": 1} } x', "nothing", '```json\n{"a": 2}\n```',
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {
        r.id: (r.j, r.f)
        for r in rows.select(
            "id",
            F.to_json(pl.extract_json(F.col("t"))).alias("j"),
            F.to_json(pl.extract_fenced_json(F.col("t"))).alias("f"),
        ).collect()
    }
    assert [got[i][0] for i in range(5)] == ['{"a":1}', '{"a":{"b":"}"}}', None, None, None]
    assert got[5][1] == '{"a":2}'
    payloads = spark.createDataFrame(
        [
            (1, "q one", "graph", True, json.dumps({"intent": "chat", "keywords": "a, b，c", "topic": " T ", "need_pdf_search": True})),
            (2, "q two", "graph", True, json.dumps({"intent": "odd", "search_keywords": ["x", "y"]})),
            (3, "what now", "ask", False, "broken {"),
        ],
        "query_id int, query string, mode string, has_graph boolean, payload string",
    )
    got = {r.query_id: r for r in pn.normalise_route(payloads).collect()}
    assert (got[1].intent, got[1].topic, got[1].keywords, got[1].need_retrieval) == ("greeting", "T", ["a", "b", "c"], True)
    assert (got[2].intent, got[2].topic, got[2].keywords) == ("graph_update", "x", ["x", "y"])
    assert (got[3].intent, got[3].parsed, got[3].keywords) == ("ask", False, ["what", "now"])


def evidence_rows(spark):
    return spark.createDataFrame(
        [
            ("g", 1, "e1", "B2", "病因是遗传因素"), ("g", 2, "e2", "B1", "渗出导致水肿"), ("g", 3, "e3", "B1", "遗传病因"), ("g", 4, "e4", "", "没有"),
        ],
        "graph_id string, rank int, evidence_id string, book string, quote string",
    )


def test_concepts_and_payload_nodes(spark):
    topics = spark.createDataFrame([("g", "炎症"), ("empty", "空")], "graph_id string, topic string")
    found = gr.concepts(topics, evidence_rows(spark))
    got = {(r.graph_id, r.ord): r for r in found.collect()}
    assert [got["g", i].name for i in (1, 2, 3)] == ["定义", "病因与危险因素", "发生机制"]
    assert got["g", 2].evidence_ids == ["e1", "e3"] and got["g", 2].books == ["B2", "B1"]
    assert got["g", 2].confidence == pytest.approx(0.63) and got["g", 2].relation == "causes"
    assert [r.name for r in found.filter("graph_id = 'empty'").orderBy("ord").collect()] == lx.SEED_CLASSES[:5]
    payload = json.dumps(
        {
            "nodes": [
                {"name": "炎症"}, {"name": " 水肿 ", "type": "etiology", "confidence": "bad"}, {"name": "水肿"},
                {"name": "遗传", "evidence_ids": "e3", "confidence": 5}, {"name": "无", "type": "odd", "evidence_ids": []},
            ],
            "edges": [
                {"source": "水肿", "target": "遗传", "relation": "causes"}, {"source": "炎症", "target": "水肿", "relation": "includes"},
            ],
        },
        ensure_ascii=False,
    )
    payloads = spark.createDataFrame([("g", f"结果 {payload}")], "graph_id string, payload string")
    rows = {r.name: r for r in gr.payload_concepts(topics, payloads, evidence_rows(spark)).collect()}
    assert set(rows) == {"水肿", "遗传", "无"}
    assert rows["水肿"].evidence_ids == ["e2"] and rows["水肿"].type == "cause" and rows["水肿"].relation == "contains"
    assert rows["水肿"].confidence == pytest.approx(0.72) and rows["遗传"].confidence == pytest.approx(0.98)
    assert rows["遗传"].relation == "causes" and rows["遗传"].books == ["B1"]
    assert rows["无"].evidence_ids == ["e1"] or rows["无"].evidence_ids == ["e4"]


def test_chapter_expansion(spark):
    books = spark.createDataFrame([("b", "Book", "b.txt")], "textbook_id string, title string, filename string")
    chapters = spark.range(40).select(
        F.lit("b").alias("textbook_id"), F.format_string("c%02d", "id").alias("chapter_id"), F.concat(F.lit("C"), "id").alias("title"),
        F.col("id").alias("page_start"), F.col("id").alias("page_end"), F.lit("x").alias("content"), F.lit(9).alias("char_count"),
    )
    nodes, edges = gr.chapter_graphs(books, chapters)
    assert nodes.count() == 31 and edges.count() == 30 and "共 40 个章节" in nodes.filter("type = 'book'").first().summary
    topics = spark.createDataFrame([("b", "Book")], "graph_id string, topic string")
    frontier = nodes.filter(F.col("node_id").isin("node_001", "node_002"))
    asked = gr.expansion_queries(frontier, topics).collect()
    assert [(r["query"], r.top_k) for r in asked] == [("Book C0", 15)]
    found = gr.concepts(
        spark.createDataFrame([("b::node_002", "C0")], "graph_id string, topic string"),
        evidence_rows(spark).withColumn("graph_id", F.lit("b::node_002")),
    )
    added, links = gr.expand_nodes(frontier, nodes, edges, found)
    assert sorted(r.node_id for r in added.collect()) == ["node_032", "node_033", "node_034"]
    assert {(r.source, r.relation) for r in links.collect()} == {("node_002", "contains")}
    # a graph's id may hold the separator
    def renamed(df):
        return df.withColumn("graph_id", F.regexp_replace("graph_id", "^b", "topic::7"))

    again, more = gr.expand_nodes(renamed(frontier), renamed(nodes), renamed(edges), renamed(found))
    assert sorted((r.graph_id, r.node_id) for r in again.collect()) == [("topic::7", f"node_03{i}") for i in (2, 3, 4)] and more.count() == 3


def test_compression(spark):
    rows = spark.createDataFrame([(6, 3), (0, 3)], "o int, i int")
    assert [r[0] for r in rows.select(ig.compression_ratio(F.col("o"), F.col("i"))).collect()] == [0.5, 0.0]


def elements(spark):
    return spark.createDataFrame(
        [("g", "node", "n1", "normal", None), ("g", "node", "n2", "normal", None), ("g", "edge", "e1", "normal", None)],
        "graph_id string, target_type string, target_id string, status string, note string",
    )


def log(spark):
    return spark.createDataFrame(
        [
            ("g", 1, "node", "n1", "delete", "不展示"), ("g", 2, "node", "n2", "edit", "补充机制解释"), ("g", 3, "node", "n2", "merge", ""),
            ("g", 4, "edge", "e1", "keep", ""), ("g", 5, "node", "zz", "keep", "x"), ("g", 6, "node", "n2", "odd", "y"),
        ],
        "graph_id string, seq long, target_type string, target_id string, action string, comment string",
    )


def test_feedback_fold_and_audit(spark):
    state = {r.target_id: (r.status, r.note) for r in fb.apply_feedback(elements(spark), log(spark)).collect()}
    assert state == {"n1": ("deleted", None), "n2": ("highlighted", ""), "e1": ("updated", "")}
    for block in (2, 1000):
        rows = {r.seq: r for r in fb.audit(elements(spark), log(spark), block).collect()}
        assert [rows[s].id for s in range(1, 7)] == [f"fb_{s:03d}" for s in range(1, 7)]
        assert tuple(rows[2].before) == ("normal", None) and tuple(rows[2].after) == ("updated", "补充机制解释")
        assert tuple(rows[3].before) == ("updated", "补充机制解释") and tuple(rows[3].after) == ("highlighted", "")
        assert rows[5].before is None and rows[5].after is None
        assert tuple(rows[6].after) == ("highlighted", "")


def test_supplement(spark):
    nodes = spark.createDataFrame(
        [("g", "n2", "渗出", "原摘要", ["e1"], "normal")],
        "graph_id string, node_id string, name string, summary string, evidence_ids array<string>, status string",
    )
    topics = spark.createDataFrame([("g", "炎症")], "graph_id string, topic string")
    asked = log(spark).withColumn("comment", F.when(F.col("seq") == 5, "增加 x").otherwise(F.col("comment")))
    triggers = fb.supplement_queries(asked, nodes, topics)
    assert {r.seq: r["query"] for r in triggers.collect()} == {2: "炎症 渗出 补充机制解释", 5: None}
    held = spark.createDataFrame([("g", "e1", "c1"), ("g", "ev_c3", "other")], "graph_id string, evidence_id string, chunk_id string")
    hits = spark.createDataFrame(
        [("g", 2, r, f"ev_c{r}", f"c{r}", "B", "f", "ch", 1, "q", 0.5) for r in (1, 2, 3, 4)],
        "graph_id string, seq long, rank int, evidence_id string, chunk_id string, book string, source_file string, chapter string, page long, quote string, score double",
    )
    changed, added, records = fb.supplement(nodes, held, triggers, hits)
    row = changed.first()
    assert row.evidence_ids == ["e1", "ev_c2", "ev_fb_c3"]
    assert row.summary == f"原摘要 {lx.SUPPLEMENT_NOTE}"
    assert sorted(r.evidence_id for r in added.collect()) == ["ev_c2", "ev_fb_c3"]
    got = {r.seq: (r.retrieval_triggered, r.added_evidence_count, r.warning) for r in records.collect()}
    assert got == {2: (True, 2, ""), 5: (False, 0, "目标节点不存在，已仅记录教师反馈")}
    # the status follows the log: what the search added counts at its own place in it
    own = spark.createDataFrame([("g", "node", "n2", "normal", None)], "graph_id string, target_type string, target_id string, status string, note string")
    split = spark.createDataFrame([("g", 2, "node", "n2", "split", "补充")], asked.select("graph_id", "seq", "target_type", "target_id", "action", "comment").schema)
    gone = spark.createDataFrame([("g", 3, "node", "n2", "delete", "")], split.schema)
    assert fb.apply_feedback(own, split, records).first().status == "updated"
    assert fb.apply_feedback(own, split).first().status == "highlighted"
    assert fb.apply_feedback(own, split.unionByName(gone), records).first().status == "deleted"
    images = {r.seq: r.after.status for r in fb.audit(own, split.unionByName(gone), records=records).collect()}
    assert images == {2: "updated", 3: "deleted"}


def test_single_book_graph_serves_every_branch(spark):
    books = spark.createDataFrame([("b", "Book")], "textbook_id string, title string")
    chapters = spark.createDataFrame(
        [("b", "c1", "One", 3, 4, 10), ("b", "c2", "Two", 5, 6, 10)],
        "textbook_id string, chapter_id string, title string, page_start long, page_end long, char_count long",
    )
    requests = spark.createDataFrame(
        [(1, "b", "c2"), (2, "b", ""), (3, "b", "x"), (4, "gone", "")], "request_id long, textbook_id string, chapter_id string"
    )
    plan = gr.single_book_plan(requests, books, chapters)
    topics = plan.filter("query IS NOT NULL").select(F.col("request_id").cast("string").alias("graph_id"), "topic")
    evidence = topics.select(
        "graph_id", F.lit(1).alias("rank"), F.lit("e1").alias("evidence_id"), F.lit("Book").alias("book"),
        F.concat("topic", F.lit(" 症状 and treatment")).alias("quote"), F.concat("topic", F.lit(" 症状")).alias("text"),
    )
    found = gr.concepts(topics, evidence)
    nodes, edges = gr.single_book_graph(
        plan, *gr.chapter_graphs(books, chapters), gr.build_nodes(topics, evidence, found), gr.build_edges(found)
    )
    roots = {r.graph_id: (r.name, r.chapter, r.page) for r in nodes.filter("level = 0").collect()}
    assert roots == {"1": ("Two", "Two", 5), "2": ("Book", None, None), "3": ("Book", None, None), "4": ("gone", None, None)}
    assert {r.graph_id for r in edges.collect()} == {"1", "2", "3", "4"}
    assert nodes.filter("graph_id = '2' AND type = 'chapter'").count() == 2


def test_book_filter_and_expanded_marks(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "textbook_id string, n int")
    wanted = spark.createDataFrame([("b",), ("b",)], "textbook_id string")
    assert [r.n for r in gr.of_textbooks(rows, wanted).collect()] == [2]
    assert gr.of_textbooks(rows, wanted.limit(0)).count() == 2
    nodes = spark.createDataFrame([("g", "n1", "book"), ("g", "n2", "chapter"), ("g", "n3", "concept")], "graph_id string, node_id string, type string")
    marked, updated = gr.mark_expanded(nodes, nodes.filter("node_id <> 'n3'"))
    assert {r.node_id: r.expanded for r in marked.collect()} == {"n1": False, "n2": True, "n3": False}
    assert [r.node_id for r in updated.collect()] == ["n2"]


def test_payload_nodes_of_every_text(spark):
    from folioscope.plans import corpus as cp
    from folioscope.plans import knowledge

    sf = "/root/testdata/sf0.001"
    words = F.array_distinct(cp.long_words(F.col("text")))
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", words.alias("w")).filter(F.size("w") > 1)
    want = {f"{r.w[0]}::{r.item_id}" for r in items.collect()}
    found = knowledge.payload_nodes(spark, sf).select("graph_id").distinct().collect()
    assert want and {r.graph_id for r in found} == want


def test_expansion_in_rounds(spark):
    """Later rounds expand what was added, each text once in a graph; books and empty rounds add nothing."""
    nodes = spark.createDataFrame(
        [("g", "node_001", "Book", "book", ["Book"]), ("g", "node_002", "C1", "chapter", ["Book"]), ("g", "node_003", "C2", "chapter", ["Book"])],
        "graph_id string, node_id string, name string, type string, book_sources array<string>",
    )
    edges = spark.createDataFrame([("g", "edge_001"), ("g", "edge_002")], "graph_id string, edge_id string")
    topics = spark.createDataFrame([("g", "Book")], "graph_id string, topic string")
    asked = []

    def search(queries, k):
        asked.append((sorted(r.query for r in queries.collect()), k))
        one = evidence_rows(spark).drop("graph_id")
        return queries.select("query_id").crossJoin(one)

    added, links, expanded = gr.expand_rounds(nodes, edges, topics, nodes, search, rounds=5)
    rows = {r.node_id: r for r in added.collect()}
    assert asked[0] == (["Book C1", "Book C2"], 15)
    # both chapters find the same three names; each is searched once, and the third round has nothing new
    assert len(asked) == 2 and len(asked[1][0]) == 3 and asked[1][1] == 10
    assert sorted(rows) == [f"node_{i:03d}" for i in range(4, 4 + 6 + 9)]
    assert sorted(r.edge_id for r in links.collect()) == [f"edge_{i:03d}" for i in range(3, 3 + 6 + 9)]
    assert {n for n, r in rows.items() if r.expanded} == {"node_004", "node_005", "node_006"}
    assert {(r.node_id, r["round"]) for r in expanded.collect()} == {
        ("node_002", 1), ("node_003", 1), ("node_004", 2), ("node_005", 2), ("node_006", 2)
    }
    nothing = gr.expand_rounds(nodes, edges, topics, nodes.filter("type = 'book'"), search, rounds=2)
    assert [df.count() for df in nothing] == [0, 0, 0]
