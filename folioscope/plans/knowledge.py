"""Queries for planning, answers, graphs, integration and feedback."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.operators import answers as an
from folioscope.operators import feedback as fb
from folioscope.operators import graph as gr
from folioscope.operators import integration as ig
from folioscope.operators import planning as pn
from folioscope.operators import search as se
from folioscope.plans import corpus as cp
from folioscope.plans import sql
from folioscope.plans.core import GRAPH_EVIDENCE
from folioscope.plans.corpus import ORACLES, query, table
from folioscope.session import stage, staging_root
from folioscope.streaming import feedback as sf_stream
from folioscope.streaming import keyed


def _joined(df, *columns, sep="|"):
    return df.withColumns({c: F.array_join(c, sep) for c in columns})


def _longs(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# --- planning --------------------------------------------------------------------
GREETINGS = ["hallo", "in nicht", "que la", "hello"]
REPORTS = ["heit ", "ción"]
GRAPHS = ["tion", "ment"]
DOMAIN = ["ther", "eaux", "ungen", "ción", "haing"]
SYMPTOMS = ["onre", "heit", "pour"]
DICTIONARY = {"ther": ["there", "thing"], "eau": ["eaux", "water", "ther"], "ung": ["ungen"], "ón": ["ción", "one"]}

_TURNS = """turns AS (
  SELECT conv_id || ':' || turn AS query_id, trim(text, ' ' || chr(10)) AS query,
    CASE WHEN turn > 0 THEN 'graph' ELSE 'ask' END AS mode, turn > 1 AS has_graph
  FROM conversations WHERE role = 'user')"""


def _turns(spark, sf):
    return table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"),
        F.col("text").alias("query"),
        F.when(F.col("turn") > 0, "graph").otherwise("ask").alias("mode"),
        (F.col("turn") > 1).alias("has_graph"),
    )


_WORDS = r"regexp_extract_all(query, '[\x{4e00}-\x{9fa5}A-Za-z0-9]{2,}')"


@query(
    "intent_route",
    f"""WITH {_TURNS},
    routed AS (SELECT *, CASE WHEN lower(query) IN ('hallo', 'in nicht', 'que la', 'hello') THEN 'greeting'
      WHEN {_any_sql('query', REPORTS)} THEN 'report' WHEN mode = 'graph' AND has_graph THEN 'graph_update'
      WHEN {_any_sql('query', GRAPHS)} THEN 'graph_build' WHEN mode = 'ask' THEN 'ask' ELSE 'graph_build' END AS intent,
      list_filter({_WORDS}, lambda w, i: list_position({_WORDS}, w) = i)[1:8] AS words FROM turns)
    SELECT query_id, intent, CASE WHEN intent = 'greeting' THEN '' ELSE coalesce(words[1], substr(query, 1, 24)) END AS topic,
      CASE WHEN intent = 'greeting' THEN '' ELSE array_to_string(words, ' ') END AS keywords, intent <> 'greeting' AS need_retrieval,
      lower(query) IN ('hallo', 'in nicht', 'que la', 'hello') OR (length(query) <= 12 AND {_any_sql('lower(query)', GREETINGS)}) AS greets
    FROM routed""",
)
def intent_route(spark, sf):
    turns = _turns(spark, sf)
    greets = turns.select("query_id", pn.is_greeting(F.col("query"), GREETINGS).alias("greets"))
    routed = pn.route_intent(turns, GREETINGS, REPORTS, GRAPHS)
    return _joined(routed, "keywords", sep=" ").join(greets, "query_id")


def _expansion_sql() -> str:
    groups = " || ".join(
        f"CASE WHEN contains(query, '{k}') THEN [{', '.join(repr(w) for w in [k, *v])}] ELSE []::VARCHAR[] END"
        for k, v in DICTIONARY.items()
    )
    return groups


def _field_sql(position: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {str(v[position]).upper() if position == 0 else repr(v[position])}" for k, v in lx.PLAN_FIELDS.items())
    return f"CASE intent {cases} ELSE {'FALSE' if position == 0 else repr('')} END"


@query(
    "query_plan",
    f"""WITH {_TURNS},
    classed AS (SELECT *, CASE WHEN {_any_sql('query', SYMPTOMS)} THEN 'symptom_question' WHEN {_any_sql('query', DOMAIN)} THEN 'study_question'
      ELSE 'non_medical_question' END AS rule,
      lower(query) IN ('hallo', 'in nicht', 'que la', 'hello') OR (length(query) <= 12 AND {_any_sql('lower(query)', GREETINGS)}) AS greets,
      {_expansion_sql()} AS first FROM turns),
    worded AS (SELECT *, CASE WHEN greets THEN 'greeting' ELSE rule END AS intent,
      CASE WHEN greets THEN []::VARCHAR[] ELSE
        (first || list_filter({DOMAIN + SYMPTOMS!r}, lambda w: contains(query, w) AND NOT list_contains(first, w)))[1:12] END AS words FROM classed),
    parts AS (SELECT query_id, unnest([query] || words || {lx.EXPANSION_TAIL!r}) AS part, generate_subscripts([query] || words || {lx.EXPANSION_TAIL!r}, 1) AS pos FROM worded),
    once AS (SELECT query_id, part, min(pos) AS pos FROM parts GROUP BY ALL),
    expanded AS (SELECT query_id, string_agg(part, ' ' ORDER BY pos) AS expanded FROM once GROUP BY 1),
    fields AS (SELECT query_id, intent, {_field_sql(0)} AS need_search, array_to_string(words, ' ') AS search_keywords,
      CASE WHEN greets THEN query ELSE expanded END AS expanded_query, {_field_sql(1)} AS opening, {_field_sql(2)} AS answer_focus
      FROM worded JOIN expanded USING (query_id))
    SELECT *, intent <> 'greeting' AS should_search, intent NOT IN ('greeting', 'non_medical_question') AS searched,
      CASE WHEN intent = 'greeting' THEN 'greeting' WHEN intent = 'non_medical_question' THEN 'not needed' ELSE '' END AS skipped
    FROM fields""",
)
def query_plan(spark, sf):
    planned = pn.plan_queries(_turns(spark, sf), DOMAIN, SYMPTOMS, DICTIONARY, greetings=GREETINGS)
    return _joined(pn.gate(planned), "search_keywords", sep=" ").drop("query", "goal")


def _payloads(spark, sf):
    """Route records as JSON: plain, wrapped in prose or broken, by text length."""
    words = F.col("expected_keywords")
    size = F.length("question")
    record = F.to_json(
        F.struct(
            F.when(size > 250, "chat").when(size > 200, "graph_single").when(size > 150, "odd").otherwise("ask").alias("intent"),
            F.when(size > 220, F.array_join(words, ", ")).alias("search_keywords"),
            F.when(size <= 220, words).alias("keywords"),
            F.when(size > 180, F.concat(F.lit(" "), F.get(words, F.lit(0)), F.lit(" "))).alias("topic"),
            F.when(size > 300, False).alias("need_retrieval"),
        )
    )
    payload = (
        F.when(size < 160, record)
        .when(size < 300, F.concat(F.lit("Here it is: "), record, F.lit(" end.")))
        .otherwise(F.concat(record, F.lit(" } broken")))
    )
    return cp.questions(spark, sf).select(
        "query_id", F.col("question").alias("query"), F.lit("graph").alias("mode"), (size > 240).alias("has_graph"), payload.alias("payload")
    )


@query("payload_plan")
def payload_plan(spark, sf):
    payloads = _payloads(spark, sf)
    routes = pn.normalise_route(payloads)
    plans = pn.normalise_plan(payloads, pn.plan_queries(payloads, DOMAIN, SYMPTOMS, DICTIONARY))
    named = plans.select("query_id", F.col("intent").alias("plan_intent"), F.array_join("search_keywords", " ").alias("plan_keywords"), "need_search")
    return _joined(routes, "keywords", sep=" ").join(named, "query_id")


# --- answers ---------------------------------------------------------------------
def _flat(expression: str) -> str:
    return rf"trim(regexp_replace({expression}, '\s+', ' ', 'g'))"


_ANSWERS = f"""{sql.question_evidence(8)},
asked_words AS (SELECT query_id, query AS question, list_filter({_WORDS}, lambda w, i: list_position({_WORDS}, w) = i)[1:8] AS words FROM asked),
topics_of AS (SELECT *, coalesce(words[1], substr(question, 1, 20)) AS topic FROM asked_words),
gathered AS (
  SELECT query_id, count(*) AS retrieved_count,
    string_agg(substr({_flat('quote')}, 1, 90), '；' ORDER BY rank) FILTER (rank <= 3) AS quotes,
    string_agg(book || '/' || chapter || '/' || page || '/' || substr({_flat('quote')}, 1, 180), '|' ORDER BY rank) FILTER (rank <= 6) AS citations,
    max(substr({_flat('quote')}, 1, 120)) FILTER (rank = 1) AS definition,
    string_agg(substr({_flat('quote')}, 1, 70), '|' ORDER BY rank) FILTER (rank <= 3) AS key_points,
    string_agg(book || ':' || page, '|' ORDER BY rank) FILTER (rank <= 3) AS refs
  FROM evidence GROUP BY 1)"""


def _question_evidence(spark, sf, k=8):
    asked = cp.questions(spark, sf).select("query_id", F.col("question").alias("query"))
    return stage(cp.sparse_evidence(spark, sf, asked, k), "evidence")


def _asked(spark, sf):
    return cp.questions(spark, sf).select("query_id", "question")


@query(
    "answers",
    f"""WITH {_ANSWERS}
    SELECT query_id, topic, '围绕“' || topic || '”，教材证据提示：' || quotes || chr(10) || chr(10) || '{lx.SAFETY_NOTE}' AS answer,
      array_to_string(words, ' ') AS keywords, citations, definition, key_points, array_to_string(words[2:6], ' ') AS related_terms, refs, retrieved_count
    FROM topics_of JOIN gathered USING (query_id)""",
)
def answers(spark, sf):
    rows = an.ask_answers(_asked(spark, sf), _question_evidence(spark, sf))
    card = F.col("flashcard")
    cited = F.transform(
        "citations", lambda c: F.concat_ws("/", c["book"], c["chapter"], c["page"].cast("string"), c["quote"])
    )
    refs = F.transform(card["source_refs"], lambda r: F.concat_ws(":", r["book"], r["page"].cast("string")))
    return rows.select(
        "query_id",
        "topic",
        "answer",
        F.array_join("keywords", " ").alias("keywords"),
        F.array_join(cited, "|").alias("citations"),
        card["definition"].alias("definition"),
        F.array_join(card["key_points"], "|").alias("key_points"),
        F.array_join(card["related_terms"], " ").alias("related_terms"),
        F.array_join(refs, "|").alias("refs"),
        "retrieved_count",
    )


@query(
    "search_response",
    f"""WITH {_ANSWERS}
    SELECT query_id, rank, chunk_id, book AS textbook, chapter, page, round(score, 6) AS relevance_score, substr(quote, 1, 300) AS quote,
      substr(text, 1, 500) AS chunk_text FROM evidence""",
)
def search_response(spark, sf):
    rows = an.search_response(_question_evidence(spark, sf))
    return _longs(rows, "rank").withColumn("relevance_score", F.round("relevance_score", 6))


@query(
    "citation_answers",
    f"""WITH {_ANSWERS},
    cited AS (SELECT query_id, '根据检索到的教材内容，回答如下：' || chr(10) || chr(10) || string_agg('[' || rank || '] [' || book || ', ' || chapter || ', 第 ' || page || ' 页]'
        || chr(10) || '    "' || substr(quote, 1, 150) || '..."', chr(10) ORDER BY rank) || chr(10) || chr(10) || '请注意，以上内容均来自上述引用来源。' AS answer
      FROM evidence WHERE rank <= 3 GROUP BY 1),
    blocks AS (SELECT query_id, string_agg('[' || rank || '] 文件名：' || source_file || '；页码：' || page || '；chunk_id：' || chunk_id
        || '；相似度：' || printf('%.4f', score) || '；命中方式：tfidf' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS contexts FROM evidence GROUP BY 1)
    SELECT query_id, coalesce(answer, '当前知识库中未找到相关信息') AS answer, md5(contexts) AS contexts
    FROM asked LEFT JOIN cited USING (query_id) LEFT JOIN blocks USING (query_id)""",
)
def citation_answers(spark, sf):
    evidence = _question_evidence(spark, sf)
    blocks = an.context_blocks(evidence).withColumn("contexts", F.md5("contexts"))
    return an.citation_answers(_asked(spark, sf), evidence).join(blocks, "query_id", "left")


@query(
    "brief_sources",
    f"""WITH {_ANSWERS},
    first AS (SELECT query_id, source_file, page, min(rank) AS rank FROM evidence GROUP BY ALL),
    listed AS (SELECT query_id, string_agg('- ' || source_file || '，第 ' || page || ' 页', chr(10) ORDER BY rank) AS sources FROM first GROUP BY 1)
    SELECT query_id, coalesce(sources, '本次回答未使用教材检索结果。') AS sources FROM asked LEFT JOIN listed USING (query_id)""",
)
def brief_sources(spark, sf):
    return an.brief_sources(_asked(spark, sf), _question_evidence(spark, sf))


@query(
    "chat_rows",
    f"""WITH {_ANSWERS}
    SELECT query_id, 'ask' AS intent, rank AS position, book AS source_file, page, substr({_flat('quote')}, 1, 180) AS text, 'evidence' AS match_type
    FROM evidence WHERE rank <= 6""",
)
def chat_rows(spark, sf):
    rows = an.chat_rows(an.ask_answers(_asked(spark, sf), _question_evidence(spark, sf)))
    shown = rows.select("query_id", "intent", F.posexplode("retrieved_chunks").alias("position", "c"))
    return shown.select("query_id", "intent", (F.col("position") + 1).cast("long").alias("position"), "c.*")


# --- graphs ----------------------------------------------------------------------
_SEEDS = """seeds(ord, name, type, relation, label) AS (VALUES
  (0, '定义', 'definition', 'associated_with', '相关'), (1, '病因与危险因素', 'cause', 'causes', '导致'),
  (2, '发生机制', 'mechanism', 'explains', '解释'), (3, '临床表现', 'symptom', 'associated_with', '相关'),
  (4, '诊断依据', 'diagnosis', 'diagnosed_by', '诊断'), (5, '治疗与干预', 'treatment', 'treated_by', '干预'),
  (6, '并发症', 'complication', 'complicates', '并发'), (7, '预防管理', 'prevention', 'prevents', '预防'))"""


def _concepts_sql(source: str, name: str) -> str:
    cases = " ".join(f"WHEN {_any_sql('quote', words)} THEN '{c}'" for c, words in cp.CLASS_RULES)
    return f"""{name}_classed AS (SELECT query_id AS graph_id, rank, evidence_id, book, CASE {cases} ELSE '定义' END AS name FROM {source}),
{name}_books AS (SELECT graph_id, name, string_agg(book, '|' ORDER BY r) AS books
  FROM (SELECT graph_id, name, book, min(rank) AS r FROM {name}_classed GROUP BY ALL) GROUP BY ALL),
{name}_found AS (SELECT graph_id, name, count(*) AS n, list(evidence_id ORDER BY rank) AS ids FROM {name}_classed GROUP BY ALL),
{name}_rows AS (SELECT t.topic AS graph_id, s.*, coalesce(n, 0) AS n, coalesce(books, '') AS books, coalesce(ids, []::VARCHAR[]) AS ids,
    max(coalesce(n, 0)) OVER (PARTITION BY t.topic) AS most
  FROM topics t CROSS JOIN seeds s LEFT JOIN {name}_found f ON f.graph_id = t.topic AND f.name = s.name
  LEFT JOIN {name}_books b ON b.graph_id = t.topic AND b.name = s.name),
{name} AS (SELECT graph_id, graph_id AS topic, row_number() OVER (PARTITION BY graph_id ORDER BY ord) AS ord, name, type, relation, label,
    '从教材证据中整合“' || graph_id || '”的' || name || '。' AS summary, books, ids, least(0.92, 0.55 + 0.04 * n)::DOUBLE AS confidence
  FROM {name}_rows WHERE CASE WHEN most > 0 THEN n > 0 ELSE ord < 5 END)"""


_GRAPH = f"""{sql.topic_evidence()}, {GRAPH_EVIDENCE}, {_SEEDS}, {_concepts_sql('graph_evidence', 'concepts')},
root_sources AS (SELECT query_id AS graph_id, list(evidence_id ORDER BY rank)[1:5] AS ids, string_agg(DISTINCT book, '|' ORDER BY book) AS books
  FROM graph_evidence GROUP BY 1),
nodes AS (
  SELECT topic AS graph_id, 1 AS ord, 'node_001' AS node_id, topic AS name, 'concept' AS type, 0 AS level, topic || ' 的跨教材整合主题节点。' AS summary,
    coalesce(books, '') AS books, coalesce(ids, []::VARCHAR[]) AS ids, CASE WHEN ids IS NULL THEN 0.2 ELSE 0.85 END::DOUBLE AS confidence, 'normal' AS status
  FROM topics LEFT JOIN root_sources ON graph_id = topic
  UNION ALL
  SELECT graph_id, ord + 1, printf('node_%03d', ord + 1), name, type, CASE WHEN ord + 1 <= 7 THEN 1 ELSE 2 END, summary, books, ids, confidence, 'normal' FROM concepts),
edges AS (
  SELECT graph_id, ord, printf('edge_%03d', ord) AS edge_id, 'node_001' AS source, printf('node_%03d', ord + 1) AS target, relation, label,
    name || ' 与 ' || topic || ' 相关。' AS summary, ids[1:2] AS ids, confidence, 'normal' AS status FROM concepts)"""


class _Graph:
    """Graph tables of every benchmark topic."""

    def __init__(self, spark, sf):
        self.topics = stage(cp.topics(spark, sf), "topics")
        self.searched = cp.topic_evidence(spark, sf)
        chosen = se.graph_evidence(self.searched).withColumnRenamed("query_id", "graph_id")
        self.evidence = stage(chosen, "graph_evidence")
        self.concepts = stage(gr.concepts(self.topics, self.evidence, cp.CLASS_RULES), "concepts")
        self.nodes = stage(gr.build_nodes(self.topics, self.evidence, self.concepts), "nodes")
        self.edges = stage(gr.build_edges(self.concepts), "edges")

    def rest(self):
        """Evidence after the first thirty, renumbered: a follow-up's result."""
        more = self.searched.filter(F.col("rank") > 30).withColumnRenamed("query_id", "graph_id")
        return more.withColumn("rank", F.col("rank") - 30)


@query(
    "concepts",
    f"""WITH {_GRAPH} SELECT graph_id, ord::INTEGER AS ord, name, type, relation, label, summary, books, array_to_string(ids, '|') AS evidence_ids,
    round(confidence, 6) AS confidence FROM concepts""",
)
def concepts(spark, sf):
    rows = _joined(_Graph(spark, sf).concepts, "books", "evidence_ids").drop("topic")
    return rows.withColumn("confidence", F.round("confidence", 6))


@query("payload_nodes")
def payload_nodes(spark, sf):
    """Concepts from node payloads: the long words of each benchmark text as nodes, a graph per text."""
    graph = _Graph(spark, sf)
    words = cp.long_words(F.col("text"))
    items = table(spark, sf, "benchmark").select(
        F.get(words, F.lit(0)).alias("topic"), "item_id", F.array_distinct(words).alias("w")
    ).filter(F.col("topic").isNotNull())
    nodes = F.transform(
        "w",
        lambda w, i: F.struct(
            w.alias("name"),
            F.when(i == 1, "etiology").when(i == 2, "odd").otherwise("mechanism").alias("type"),
            F.when(i == 3, 7.5).otherwise(0.5).alias("confidence"),
        ),
    )
    edges = F.transform("w", lambda w, i: F.struct(F.col("topic").alias("source"), w.alias("target"), F.lit("includes").alias("relation")))
    record = F.to_json(F.struct(nodes.alias("nodes"), edges.alias("edges")))
    # texts can share their topic: each has a graph of its own over the topic's evidence
    chosen = items.select(F.concat_ws("::", "topic", "item_id").alias("graph_id"), "topic", record.alias("payload"))
    keyed = chosen.select(F.col("graph_id").alias("_key"), F.col("topic").alias("graph_id"))
    topics = graph.topics.join(keyed, "graph_id").drop("graph_id").withColumnRenamed("_key", "graph_id")
    evidence = graph.evidence.join(keyed, "graph_id").drop("graph_id").withColumnRenamed("_key", "graph_id")
    found = gr.payload_concepts(topics, chosen.drop("topic"), evidence)
    return _joined(found, "books", "evidence_ids").drop("topic")


@query(
    "graph_nodes",
    f"""WITH {_GRAPH} SELECT graph_id, node_id, name, type, level::INTEGER AS level, summary, books AS book_sources, array_to_string(ids, '|') AS evidence_ids,
    round(confidence, 6) AS confidence, status FROM nodes""",
)
def graph_nodes(spark, sf):
    rows = _joined(_Graph(spark, sf).nodes, "book_sources", "evidence_ids").drop("ord")
    return rows.withColumn("confidence", F.round("confidence", 6))


@query(
    "graph_edges",
    f"""WITH {_GRAPH} SELECT graph_id, edge_id, source, target, relation, label, summary, array_to_string(ids, '|') AS evidence_ids,
    round(confidence, 6) AS confidence, status FROM edges""",
)
def graph_edges(spark, sf):
    rows = _joined(_Graph(spark, sf).edges, "evidence_ids").drop("ord")
    return rows.withColumn("confidence", F.round("confidence", 6))


@query(
    "chapter_graph",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    SELECT source AS graph_id, 'node_001' AS node_id, 'Book ' || source AS name, 'book' AS type,
      '医学教材：Book ' || source || '，共 ' || count(*) || ' 个章节' AS summary, -1::BIGINT AS page, NULL::VARCHAR AS edge_id, NULL::VARCHAR AS edge_summary
    FROM documents GROUP BY source
    UNION ALL SELECT source, printf('node_%03d', n + 1), 'Doc ' || doc_id, 'chapter', 'Doc ' || doc_id || '，第 ' || doc_id || '-' || doc_id || ' 页，字数 ' || n_chars,
      doc_id, printf('edge_%03d', n), 'Book ' || source || ' 包含 Doc ' || doc_id FROM c WHERE n <= 30""",
)
def chapter_graph(spark, sf):
    nodes, edges = gr.chapter_graphs(*cp.parsed(spark, sf))
    named = edges.select("graph_id", F.col("target").alias("node_id"), "edge_id", F.col("summary").alias("edge_summary"))
    rows = nodes.select("graph_id", "node_id", "name", "type", "summary", F.coalesce("page", F.lit(-1)).alias("page"))
    return rows.join(named, ["graph_id", "node_id"], "left")


@query(
    "single_book_plan",
    """WITH r AS (
      SELECT doc_id AS request_id, source AS textbook_id, CASE WHEN toxic IS NOT NULL THEN 'd' || doc_id WHEN lang = 'en' THEN 'x' || doc_id ELSE '' END AS chapter_id,
        doc_id, TRUE AS known FROM documents LEFT JOIN labels USING (doc_id)
      UNION ALL SELECT -1 - n_nationkey, 'none' || n_nationkey, 'd1', 0, FALSE FROM nation)
    SELECT request_id, textbook_id,
      CASE WHEN NOT known THEN 'search_book' WHEN chapter_id LIKE 'd%' THEN 'chapter' WHEN chapter_id <> '' THEN 'search_chapter' ELSE 'chapters' END AS branch,
      CASE WHEN NOT known THEN textbook_id WHEN chapter_id LIKE 'd%' THEN 'Doc ' || doc_id ELSE 'Book ' || textbook_id END AS topic,
      CASE WHEN NOT known THEN '教材:' || textbook_id WHEN chapter_id LIKE 'd%' THEN 'Book ' || textbook_id || ' Doc ' || doc_id
        WHEN chapter_id <> '' THEN '教材:Book ' || textbook_id || ' ' || chapter_id END AS query,
      CASE WHEN known AND chapter_id LIKE 'd%' THEN doc_id ELSE -1 END AS page
    FROM r""",
)
def single_book_plan(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    requests = docs.select(
        F.col("doc_id").alias("request_id"),
        F.col("source").alias("textbook_id"),
        F.when(F.col("toxic").isNotNull(), F.concat(F.lit("d"), "doc_id"))
        .when(F.col("lang") == "en", F.concat(F.lit("x"), "doc_id"))
        .otherwise("")
        .alias("chapter_id"),
    ).unionByName(
        table(spark, sf, "nation").select(
            (-1 - F.col("n_nationkey").cast("long")).alias("request_id"),
            F.concat(F.lit("none"), "n_nationkey").alias("textbook_id"),
            F.lit("d1").alias("chapter_id"),
        )
    )
    rows = gr.single_book_plan(requests, *cp.parsed(spark, sf))
    return rows.withColumn("page", F.coalesce("page", F.lit(-1)))


_UPDATE = f"""{_GRAPH},
rest AS (SELECT * EXCLUDE (rank), rank - 30 AS rank FROM evidence WHERE rank > 30),
{_concepts_sql('rest', 'more')},
new_concepts AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY ord) AS k FROM more m
  WHERE ord <= 4 AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph_id = m.graph_id AND n.name = m.name)),
sizes AS (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY 1),
edge_sizes AS (SELECT graph_id, count(*) AS n_edges FROM edges GROUP BY 1),
added AS (SELECT c.*, printf('node_%03d', k + n_nodes) AS node_id, printf('edge_%03d', k + coalesce(n_edges, 0)) AS edge_id
  FROM new_concepts c JOIN sizes USING (graph_id) LEFT JOIN edge_sizes USING (graph_id))"""


@query(
    "graph_update",
    f"""WITH {_UPDATE},
    merged AS (SELECT query_id AS graph_id, evidence_id FROM graph_evidence UNION SELECT query_id, evidence_id FROM rest),
    totals AS (SELECT graph_id, count(*) AS n_evidence FROM merged GROUP BY 1)
    SELECT graph_id, node_id, edge_id, name, type, books AS book_sources, array_to_string(ids, '|') AS evidence_ids, round(confidence, 6) AS confidence,
      '根据追问补充 ' || name || ' 节点。' AS edge_summary, n_evidence
    FROM added JOIN totals USING (graph_id)""",
)
def graph_update(spark, sf):
    graph = _Graph(spark, sf)
    rest = stage(graph.rest(), "rest")
    found = gr.concepts(graph.topics, rest, cp.CLASS_RULES)
    nodes, edges, evidence = gr.update_graph(graph.nodes, graph.edges, graph.evidence, rest, found)
    # a client that holds the first graph receives exactly the added rows
    new_nodes, new_edges = gr.patch_diff(
        graph.nodes, graph.edges, graph.nodes.unionByName(nodes), graph.edges.unionByName(edges), graph.edges.unionByName(edges)
    )
    named = new_edges.select("graph_id", F.col("target").alias("node_id"), "edge_id", F.col("summary").alias("edge_summary"))
    totals = evidence.groupBy("graph_id").agg(F.count("*").alias("n_evidence"))
    rows = _joined(new_nodes, "book_sources", "evidence_ids").join(named, ["graph_id", "node_id"]).join(totals, "graph_id")
    return rows.select(
        "graph_id", "node_id", "edge_id", "name", "type", "book_sources", "evidence_ids",
        F.round("confidence", 6).alias("confidence"), "edge_summary", "n_evidence",
    )


@query(
    "graph_expand",
    f"""WITH {_GRAPH},
    near AS (SELECT * FROM evidence WHERE rank <= 10), {_concepts_sql('near', 'around')},
    sizes AS (SELECT graph_id, count(*) AS n_nodes FROM nodes GROUP BY 1),
    edge_sizes AS (SELECT graph_id, count(*) AS n_edges FROM edges GROUP BY 1)
    SELECT graph_id, 'node_001' AS parent_id, printf('node_%03d', ord + n_nodes) AS node_id, printf('edge_%03d', ord + coalesce(n_edges, 0)) AS edge_id, name, type,
      array_to_string(ids, '|') AS evidence_ids, round(confidence, 6) AS confidence, 'related_to' AS relation, '相关' AS label, graph_id || ' 相关概念' AS edge_summary
    FROM around JOIN sizes USING (graph_id) LEFT JOIN edge_sizes USING (graph_id) WHERE ord <= 8""",
)
def graph_expand(spark, sf):
    """Every topic's root expanded by its ten nearest chunks."""
    graph = _Graph(spark, sf)
    frontier = graph.nodes.filter(F.col("level") == 0)
    asked = gr.expansion_queries(frontier, graph.topics)
    key = F.concat_ws("::", "graph_id", "node_id")
    topics = asked.select(key.alias("graph_id"), F.col("name").alias("topic"), F.col("graph_id").alias("_g"), "top_k")
    # a root is searched by its topic, which the graph's own search has done already
    hits = graph.searched.withColumnRenamed("query_id", "_g").join(topics, "_g").filter(F.col("rank") <= F.col("top_k"))
    found = gr.concepts(topics.select("graph_id", "topic"), hits, cp.CLASS_RULES)
    nodes, edges = gr.expand_nodes(frontier, graph.nodes, graph.edges, found)
    named = edges.select(
        "graph_id", F.col("target").alias("node_id"), "edge_id", "relation", "label", F.col("summary").alias("edge_summary")
    )
    rows = _joined(nodes, "evidence_ids").join(named, ["graph_id", "node_id"])
    return rows.select(
        "graph_id", "parent_id", "node_id", "edge_id", "name", "type", "evidence_ids",
        F.round("confidence", 6).alias("confidence"), "relation", "label", "edge_summary",
    )


def _round_sql(number: int, before: str) -> str:
    """Round `number` of an expansion: frontier -> hits -> added; `before` selects (graph_id, rows held so far)."""
    cases = " ".join(f"WHEN {_any_sql('quote', words)} THEN '{c}'" for c, words in cp.CLASS_RULES)
    r = str(number)
    return f"""asked{r} AS (SELECT DISTINCT query AS query_id, query FROM frontier{r}),
{sql.search('asked' + r, 15, 'hits' + r)},
classed{r} AS (SELECT f.graph_id, f.node_id, h.rank, 'ev_' || h.chunk_id AS evidence_id, book, substr(c.text, 1, 260) AS quote,
    CASE {cases} ELSE '定义' END AS name
  FROM frontier{r} f JOIN hits{r} h ON h.query_id = f.query JOIN chunks c USING (chunk_id) WHERE h.rank <= f.top_k),
held{r} AS (SELECT graph_id, node_id, name, count(*) AS n, list(evidence_id ORDER BY rank) AS ids FROM classed{r} GROUP BY ALL),
seeded{r} AS (SELECT f.graph_id, f.node_id AS parent_id, f.name AS parent, f.type AS parent_type, s.ord, s.name, s.type,
    coalesce(n, 0) AS n, coalesce(ids, []::VARCHAR[]) AS ids, max(coalesce(n, 0)) OVER (PARTITION BY f.graph_id, f.node_id) AS most
  FROM frontier{r} f CROSS JOIN seeds s LEFT JOIN held{r} h ON h.graph_id = f.graph_id AND h.node_id = f.node_id AND h.name = s.name),
kept{r} AS (SELECT *, row_number() OVER (PARTITION BY graph_id, parent_id ORDER BY ord) AS place FROM seeded{r}
  WHERE CASE WHEN most > 0 THEN n > 0 ELSE ord < 5 END),
numbered{r} AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY parent_id, place) AS k FROM kept{r} WHERE place <= 8),
before{r} AS ({before}),
added{r} AS (SELECT graph_id, {r}::INTEGER AS round, parent_id, printf('node_%03d', k + held + 1) AS node_id, printf('edge_%03d', k + held) AS edge_id,
    name, type, array_to_string(ids, '|') AS evidence_ids, round(least(0.92, 0.55 + 0.04 * n)::DOUBLE, 6) AS confidence,
    CASE WHEN parent_type = 'chapter' THEN 'contains' ELSE 'related_to' END AS relation,
    CASE WHEN parent_type = 'chapter' THEN '包含' ELSE '相关' END AS label,
    CASE WHEN parent_type = 'chapter' THEN parent || ' 包含 ' || name ELSE parent || ' 相关概念' END AS edge_summary,
    '从教材证据中整合“' || parent || '”的' || name || '。' AS summary
  FROM numbered{r} JOIN before{r} USING (graph_id))"""


@query(
    "graph_frontier",
    f"""WITH {sql.chapter_chunks()}, {sql.sparse_index()}, {_SEEDS},
    shown AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    frontier1 AS (SELECT source AS graph_id, printf('node_%03d', n + 1) AS node_id, 'Doc ' || doc_id AS name, 'chapter' AS type,
      'Book ' || source || ' Doc ' || doc_id AS query, 15 AS top_k FROM shown WHERE n <= 30),
    {_round_sql(1, 'SELECT graph_id, count(*) AS held FROM frontier1 GROUP BY 1')},
    frontier2 AS (SELECT graph_id, min(node_id) AS node_id, name, min(type) AS type, name AS query, 10 AS top_k FROM added1 GROUP BY graph_id, name),
    {_round_sql(2, 'SELECT graph_id, count(*) AS held FROM (SELECT graph_id FROM frontier1 UNION ALL SELECT graph_id FROM added1) GROUP BY 1')}
    SELECT a.*, f.node_id IS NOT NULL AS expanded FROM added1 a LEFT JOIN frontier2 f USING (graph_id, node_id)
    UNION ALL SELECT *, FALSE FROM added2""",
)
def graph_frontier(spark, sf):
    """Two rounds from the chapters of every book: their concepts, then what those find."""
    books, chapters = cp.parsed(spark, sf)
    nodes, edges = gr.chapter_graphs(books, chapters)
    nodes, edges = stage(nodes, "nodes"), stage(edges, "edges")
    cut = cp.chunks(spark, sf)
    index = se.SparseIndex(cut, max_features=lx.MAX_FEATURES)
    topics = books.select(F.col("textbook_id").alias("graph_id"), F.col("title").alias("topic"))
    added, links, _ = gr.expand_rounds(
        nodes, edges, topics, nodes, lambda asked, k: se.to_evidence(index.search(asked, k), cut), 2, cp.CLASS_RULES
    )
    named = links.select(
        "graph_id", F.col("target").alias("node_id"), "edge_id", "relation", "label", F.col("summary").alias("edge_summary")
    )
    return _joined(added, "evidence_ids").join(named, ["graph_id", "node_id"]).select(
        "graph_id", "round", "parent_id", "node_id", "edge_id", "name", "type", "evidence_ids",
        F.round("confidence", 6).alias("confidence"), "relation", "label", "edge_summary", "summary", "expanded",
    )


# --- integration -----------------------------------------------------------------
@query(
    "overlap",
    f"""WITH {_GRAPH},
    linked AS (SELECT graph_id, node_id, unnest(ids) AS evidence_id FROM nodes),
    held AS (SELECT l.graph_id, l.node_id, string_agg(DISTINCT book, '|' ORDER BY book) AS books, count(DISTINCT book) AS n
      FROM linked l JOIN graph_evidence e ON e.query_id = l.graph_id AND e.evidence_id = l.evidence_id GROUP BY ALL)
    SELECT graph_id, node_id, name, coalesce(h.books, '') AS books, coalesce(n > 1, FALSE) AS shared,
      CASE WHEN n > 1 THEN '{lx.OVERLAP_SHARED}' ELSE '{lx.OVERLAP_SINGLE}' END AS overlap_analysis
    FROM nodes LEFT JOIN held h USING (graph_id, node_id)""",
)
def overlap(spark, sf):
    graph = _Graph(spark, sf)
    return _joined(ig.compare_sources(graph.nodes, graph.evidence), "books").drop("complement_analysis")


_INTEGRATION = """integration AS (
  SELECT t.topic AS graph_id, coalesce(c.books, 0) AS n_books, coalesce(c.chars, 0)::BIGINT AS original_chars, n.chars::BIGINT AS integrated_chars,
    CASE WHEN c.chars > 0 THEN round(n.chars / c.chars, 4) ELSE 0.0 END AS compression_ratio
  FROM topics t
  LEFT JOIN (SELECT query_id, count(DISTINCT book) AS books, sum(length(quote)) AS chars FROM graph_evidence GROUP BY 1) c ON c.query_id = t.topic
  LEFT JOIN (SELECT graph_id, length(string_agg(summary, '；')) AS chars FROM nodes GROUP BY 1) n ON n.graph_id = t.topic)"""


@query(
    "compression",
    f"""WITH {_GRAPH}, {_INTEGRATION}
    SELECT graph_id, '围绕“' || graph_id || '”，当前证据覆盖 ' || n_books || ' 本教材；多书共同出现的内容可视为重点概念。' AS overlap_summary,
      original_chars, integrated_chars, compression_ratio FROM integration""",
)
def compression(spark, sf):
    graph = _Graph(spark, sf)
    rows = ig.summarise(graph.topics, graph.evidence, graph.nodes)
    return rows.select("graph_id", "overlap_summary", "original_chars", "integrated_chars", "compression_ratio")


@query(
    "node_evidence",
    f"""WITH {_GRAPH},
    shown AS (SELECT graph_id, node_id, name, topic, summary, CASE WHEN type IN ('definition', 'concept') THEN []::VARCHAR[] ELSE ids END AS ids
      FROM (SELECT *, graph_id AS topic FROM nodes)),
    node_queries AS (SELECT graph_id || '::' || node_id AS query_id, topic || ' ' || name AS query FROM shown),
    {sql.search('node_queries', 5, 'node_hits')},
    linked AS (SELECT graph_id, node_id, unnest(ids) AS evidence_id FROM shown),
    own AS (SELECT l.graph_id, l.node_id, e.rank, e.book, e.chapter, e.page, e.quote, e.book AS own_book FROM linked l
      JOIN graph_evidence e ON e.query_id = l.graph_id AND e.evidence_id = l.evidence_id),
    fallback AS (SELECT split_part(h.query_id, '::', 1) AS graph_id, split_part(h.query_id, '::', 2) AS node_id, h.rank, c.book, c.chapter,
        c.page_start AS page, substr(c.text, 1, 260) AS quote, NULL AS own_book
      FROM node_hits h JOIN chunks c USING (chunk_id)),
    sources AS (SELECT * FROM own UNION ALL SELECT * FROM fallback f
      WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.graph_id = f.graph_id AND o.node_id = f.node_id)),
    grouped AS (SELECT graph_id, node_id, arg_min(quote, rank) AS first_quote, count(DISTINCT own_book) AS n,
        string_agg(book || '/' || chapter || '/' || page || '/' || substr({_flat('quote')}, 1, 180), '|' ORDER BY rank) AS cited FROM sources GROUP BY ALL)
    SELECT graph_id, node_id, name, CASE WHEN first_quote IS NULL THEN '当前节点证据不足。' ELSE substr({_flat('first_quote')}, 1, 120) END AS definition,
      summary AS detail, CASE WHEN n > 1 THEN '{lx.OVERLAP_SHARED}' ELSE '{lx.OVERLAP_SINGLE}' END AS overlap_analysis, coalesce(cited, '') AS sources
    FROM shown LEFT JOIN grouped USING (graph_id, node_id)""",
)
def node_evidence(spark, sf):
    """Node details; the root and definition nodes hold no ids here and are searched."""
    graph = _Graph(spark, sf)
    bare = F.col("type").isin("definition", "concept")
    nodes = graph.nodes.withColumn(
        "evidence_ids", F.when(bare, F.array().cast("array<string>")).otherwise(F.col("evidence_ids"))
    )
    asked = se.node_queries(nodes, graph.topics)
    found = cp.sparse_evidence(spark, sf, asked, 5)
    searched = found.withColumns(
        {
            "graph_id": F.substring_index("query_id", "::", 1),
            "node_id": F.substring_index("query_id", "::", -1),
        }
    )
    rows = ig.node_detail(nodes, graph.evidence, stage(searched, "searched"))
    cited = F.transform("sources", lambda c: F.concat_ws("/", c["book"], c["chapter"], c["page"].cast("string"), c["quote"]))
    return rows.select(
        "graph_id", "node_id", "name", "definition", "detail", "overlap_analysis", F.array_join(cited, "|").alias("sources")
    )


@query(
    "report_lines",
    f"""WITH {_GRAPH}, {_INTEGRATION},
    feedback AS (SELECT regexp_extract(lower(text), '[a-z]{{5,}}') AS graph_id, item_id AS seq, text AS comment FROM benchmark WHERE regexp_matches(lower(text), '[a-z]{{5,}}')),
    a AS (SELECT graph_id, count(*) AS n_nodes, arg_min(summary, ord) AS first_summary, string_agg('- **' || name || '**：' || summary, chr(10) ORDER BY ord) AS node_lines FROM nodes GROUP BY 1),
    b AS (SELECT graph_id, count(*) AS n_edges FROM edges GROUP BY 1),
    c AS (SELECT graph_id, string_agg('- t [keep] n' || seq || ': ' || comment, chr(10) ORDER BY seq) AS feedback_lines FROM feedback GROUP BY 1),
    d AS (SELECT query_id AS graph_id, string_agg('- ' || book || '，' || chapter || '，第 ' || page || ' 页：' || substr({_flat('quote')}, 1, 80), chr(10) ORDER BY rank) AS source_lines
      FROM graph_evidence GROUP BY 1)
    SELECT graph_id, concat_ws(chr(10), '# 主题：' || graph_id, '', '## 1. 核心概念概述', first_summary, '', '## 2. 跨教材知识图谱摘要',
      '当前图谱包含 ' || n_nodes || ' 个节点、' || n_edges || ' 条关系。', '', '## 3. 主要节点说明', node_lines, '', '## 4. 跨教材重复知识点',
      '围绕“' || graph_id || '”，当前证据覆盖 ' || n_books || ' 本教材；多书共同出现的内容可视为重点概念。', '', '## 5. 跨教材互补知识点', '{lx.COMPLEMENT_SUMMARY}', '',
      '## 6. 可能缺失或证据不足的部分', '{lx.MISSING_SUMMARY}', '', '## 7. 教师反馈记录', coalesce(feedback_lines, '暂无教师反馈。'), '', '## 8. 压缩比说明',
      '原始证据字符数：' || original_chars || '；整合字符数：' || integrated_chars || '；压缩比：' || compression_ratio || '。', '', '## 9. 教材引用来源', source_lines) AS markdown
    FROM integration JOIN a USING (graph_id) JOIN b USING (graph_id) LEFT JOIN c USING (graph_id) LEFT JOIN d USING (graph_id)""",
)
def report_lines(spark, sf):
    graph = _Graph(spark, sf)
    first = F.get(cp.long_words(F.col("text")), F.lit(0))
    feedback = table(spark, sf, "benchmark").select(
        first.alias("graph_id"), F.col("item_id").alias("seq"), F.lit("t").alias("time"), F.lit("keep").alias("action"),
        F.concat(F.lit("n"), "item_id").alias("target_id"), F.col("text").alias("comment"),
    )
    integration = ig.summarise(graph.topics, graph.evidence, graph.nodes)
    rows = ig.report(graph.nodes, graph.edges, graph.evidence, feedback.filter(F.col("graph_id").isNotNull()), integration)
    return rows.select("graph_id", "markdown")


@query(
    "evidence_flow",
    f"""WITH {_GRAPH},
    linked AS (SELECT DISTINCT graph_id, node_id, type, unnest(ids) AS evidence_id FROM nodes),
    links AS (
      SELECT query_id AS graph_id, '教材::' || book AS source, '章节::' || chapter AS target FROM graph_evidence
      UNION ALL SELECT query_id, '章节::' || chapter, '节点类型::' || coalesce(type, '{lx.UNLINKED_TYPE}')
      FROM graph_evidence e LEFT JOIN linked l ON l.graph_id = e.query_id AND l.evidence_id = e.evidence_id),
    counted AS (SELECT graph_id, source, target, count(*) AS value FROM links GROUP BY ALL),
    ends AS (SELECT DISTINCT graph_id, unnest([source, target]) AS name FROM counted),
    sizes AS (SELECT graph_id, count(*) AS n_ends FROM ends GROUP BY 1)
    SELECT * FROM counted JOIN sizes USING (graph_id)""",
)
def evidence_flow(spark, sf):
    graph = _Graph(spark, sf)
    links = ig.evidence_flow(graph.evidence, graph.nodes)
    sizes = ig.flow_nodes(links).groupBy("graph_id").agg(F.count("*").alias("n_ends"))
    return links.join(sizes, "graph_id")


@query(
    "hit_charts",
    f"""WITH {sql.question_evidence(8)},
    sizes AS (SELECT query_id, source_file, count(*) AS value FROM evidence GROUP BY ALL)
    SELECT query_id, rank, rank || '@' || page AS label, round(score, 4) AS score, value FROM evidence JOIN sizes USING (query_id, source_file)""",
)
def hit_charts(spark, sf):
    evidence = _question_evidence(spark, sf)
    files = evidence.select("query_id", "rank", "source_file").join(ig.hits_per_source(evidence), ["query_id", "source_file"])
    rows = ig.score_series(evidence).join(files.drop("source_file"), ["query_id", "rank"])
    return _longs(rows, "rank")


@query(
    "compare_metrics",
    f"""WITH {_GRAPH}, {_INTEGRATION},
    e AS (SELECT query_id AS graph_id, count(*) AS evidence_count, count(DISTINCT book) AS textbook_count, count(DISTINCT chapter) AS chapter_count,
      sum(length(quote)) AS chars FROM graph_evidence GROUP BY 1),
    k AS (SELECT graph_id, count(*) AS node_count, sum(length(summary)) AS chars,
      count(*) FILTER (type = 'mechanism') AS merge_count, count(*) FILTER (type = 'definition') AS keep_count,
      count(*) FILTER (type NOT IN ('mechanism', 'definition')) AS remove_count FROM nodes GROUP BY 1),
    m AS (SELECT graph_id, count(*) AS edge_count FROM edges GROUP BY 1),
    s AS (SELECT * FROM integration WHERE n_books > 10)
    SELECT t.topic AS graph_id, coalesce(evidence_count, 0) AS evidence_count, coalesce(textbook_count, 0) AS textbook_count, coalesce(chapter_count, 0) AS chapter_count,
      node_count, edge_count, node_count AS decision_count, merge_count, keep_count, remove_count,
      coalesce(s.original_chars, e.chars, 0)::BIGINT AS original_chars, coalesce(s.integrated_chars, k.chars)::BIGINT AS integrated_chars,
      round(coalesce(s.compression_ratio, k.chars / greatest(coalesce(e.chars, 0), 1)), 6) AS compression_ratio,
      coalesce(s.compression_ratio, k.chars / greatest(coalesce(e.chars, 0), 1)) <= 0.3 AS on_target
    FROM topics t LEFT JOIN e ON e.graph_id = t.topic JOIN k ON k.graph_id = t.topic JOIN m ON m.graph_id = t.topic LEFT JOIN s ON s.graph_id = t.topic""",
)
def compare_metrics(spark, sf):
    """Graphs with more than ten books carry stored figures, the others are computed."""
    graph = _Graph(spark, sf)
    kind = F.col("type")
    decisions = graph.nodes.select(
        "graph_id", F.when(kind == "mechanism", "merge").when(kind == "definition", "keep").otherwise("remove").alias("action")
    )
    wide = graph.evidence.groupBy("graph_id").agg(F.count_distinct("book").alias("b")).filter(F.col("b") > 10)
    stored = ig.summarise(graph.topics, graph.evidence, graph.nodes).join(wide, "graph_id", "left_semi")
    rows = ig.compare_metrics(graph.topics, graph.evidence, graph.nodes, graph.edges, decisions, stored)
    return rows.withColumn("compression_ratio", F.round("compression_ratio", 6))


@query(
    "graph_filters",
    f"""WITH {_GRAPH},
    hit AS (SELECT graph_id, count(*) AS n_found FROM nodes WHERE contains(lower(name), '机制') OR contains(lower(summary), '机制') GROUP BY 1),
    wanted AS (SELECT graph_id, unnest(ids) AS evidence_id FROM nodes WHERE type = 'mechanism'),
    kept AS (SELECT query_id AS graph_id, count(*) AS n_evidence FROM graph_evidence e
      WHERE EXISTS (SELECT 1 FROM wanted w WHERE w.graph_id = e.query_id AND w.evidence_id = e.evidence_id)
         OR NOT EXISTS (SELECT 1 FROM wanted w WHERE w.graph_id = e.query_id) GROUP BY 1)
    SELECT topic AS graph_id, coalesce(n_found, 0) AS n_found, coalesce(n_evidence, 0) AS n_evidence,
      (SELECT count(*) FROM nodes n WHERE n.graph_id = topic AND type <> 'cause') AS n_live
    FROM topics LEFT JOIN hit ON hit.graph_id = topic LEFT JOIN kept ON kept.graph_id = topic""",
)
def graph_filters(spark, sf):
    """Nodes found by a word, evidence of mechanism nodes, and nodes left after a deletion."""
    graph = _Graph(spark, sf)
    found = ig.find_nodes(graph.nodes, graph.topics.select("graph_id", F.lit("机制").alias("word")))
    wanted = graph.nodes.filter(F.col("type") == "mechanism").select("graph_id", F.explode("evidence_ids").alias("evidence_id"))
    kept = ig.filter_evidence(graph.evidence, wanted)
    status = F.when(F.col("type") == "cause", "deleted").otherwise(F.col("status"))
    alive = ig.live(graph.nodes.withColumn("status", status))
    rows = graph.topics.select("graph_id")
    for part, name in ((found, "n_found"), (kept, "n_evidence"), (alive, "n_live")):
        rows = rows.join(part.groupBy("graph_id").agg(F.count("*").alias(name)), "graph_id", "left")
    return rows.select("graph_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_found", "n_evidence", "n_live")])


# --- feedback --------------------------------------------------------------------
_LOG = """log AS (
  SELECT 'g' AS graph_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'edge' ELSE 'node' END AS target_type, 'n' || user_id AS target_id,
    CASE event_type WHEN 'view' THEN 'keep' WHEN 'click' THEN 'edit' WHEN 'signup' THEN 'merge' WHEN 'purchase' THEN 'split' ELSE 'delete' END AS action,
    CASE WHEN json_extract(props, '$.k')::BIGINT % 2 = 0 THEN '' ELSE 'note ' || json_extract(props, '$.k') END AS comment FROM events),
elements AS (
  SELECT 'g' AS graph_id, 'node' AS target_type, 'n' || c_custkey AS target_id, 'normal' AS status, NULL::VARCHAR AS note FROM customer
  UNION ALL SELECT 'g', 'edge', 'n' || s_suppkey, 'normal', NULL FROM supplier),
effects AS (SELECT *,
  CASE WHEN action = 'delete' THEN 'deleted' WHEN target_type = 'edge' THEN 'updated' WHEN action IN ('keep', 'edit') THEN 'updated' ELSE 'highlighted' END AS set_status,
  CASE WHEN target_type = 'edge' OR action = 'merge' OR (action IN ('keep', 'edit') AND comment <> '') THEN comment END AS set_note FROM log),
state AS (
  SELECT e.graph_id, e.target_type, e.target_id, coalesce(f.status, e.status) AS status, coalesce(f.note, e.note) AS note
  FROM elements e LEFT JOIN (
    SELECT target_type, target_id, max_by(set_status, seq) AS status, max_by(set_note, seq) FILTER (set_note IS NOT NULL) AS note FROM effects GROUP BY ALL) f
  USING (target_type, target_id))"""


def feedback_log(events, *more):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.lit("g").alias("graph_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "edge").otherwise("node").alias("target_type"),
        F.concat(F.lit("n"), "user_id").alias("target_id"),
        F.when(kind == "view", "keep")
        .when(kind == "click", "edit")
        .when(kind == "signup", "merge")
        .when(kind == "purchase", "split")
        .otherwise("delete")
        .alias("action"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("note "), k)).alias("comment"),
        *more,
    )


def _elements(spark, sf):
    def rows(kind, name, key):
        return table(spark, sf, name).select(
            F.lit("g").alias("graph_id"),
            F.lit(kind).alias("target_type"),
            F.concat(F.lit("n"), key).alias("target_id"),
            F.lit("normal").alias("status"),
            F.lit(None).cast("string").alias("note"),
        )

    return rows("node", "customer", "c_custkey").unionByName(rows("edge", "supplier", "s_suppkey"))


_STATE_SQL = f"WITH {_LOG} SELECT * FROM state"


@query("feedback_state", _STATE_SQL)
def feedback_state(spark, sf):
    return fb.apply_feedback(_elements(spark, sf), feedback_log(table(spark, sf, "events"))).select(
        *fb.TARGET, "status", "note"
    )


@query(
    "feedback_audit",
    f"""WITH {_LOG},
    steps AS (SELECT *, row_number() OVER (ORDER BY seq) AS no,
        last_value(set_status IGNORE NULLS) OVER w AS was, last_value(set_note IGNORE NULLS) OVER w AS noted
      FROM effects WINDOW w AS (PARTITION BY target_type, target_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT printf('fb_%03d', no) AS id, seq, action, s.target_type, s.target_id, comment,
      CASE WHEN e.status IS NOT NULL THEN coalesce(was, e.status) END AS before_status, CASE WHEN e.status IS NOT NULL THEN coalesce(noted, e.note) END AS before_note,
      CASE WHEN e.status IS NOT NULL THEN set_status END AS after_status, CASE WHEN e.status IS NOT NULL THEN coalesce(set_note, noted, e.note) END AS after_note
    FROM steps s LEFT JOIN elements e ON e.target_type = s.target_type AND e.target_id = s.target_id""",
)
def feedback_audit(spark, sf):
    return _audit_columns(fb.audit(_elements(spark, sf), feedback_log(table(spark, sf, "events"))))


def _audit_columns(rows):
    return rows.select(
        "id", "seq", "action", "target_type", "target_id", "comment",
        F.col("before.status").alias("before_status"), F.col("before.note").alias("before_note"),
        F.col("after.status").alias("after_status"), F.col("after.note").alias("after_note"),
    )


TRIGGERS = ["ther", "heit", "eaux", "ción"]


@query(
    "feedback_supplement",
    f"""WITH {sql.chapter_chunks()}, {sql.sparse_index()},
    actions AS (SELECT conv_id * 1000 + turn AS seq, 'c' || conv_id AS target_id, text AS comment,
      CASE WHEN turn > 2 THEN 'delete' WHEN turn > 0 THEN 'edit' ELSE 'split' END AS action FROM conversations WHERE role = 'user'),
    log AS (SELECT 'talk' AS graph_id, * FROM actions WHERE action <> 'delete' AND {_any_sql('comment', TRIGGERS)}),
    nodes AS (SELECT 'c' || conv_id AS node_id, min(role) AS name FROM conversations GROUP BY conv_id),
    asked AS (SELECT seq AS query_id, trim(name || ' ' || comment, ' ' || chr(10)) AS query FROM log JOIN nodes ON node_id = target_id),
    {sql.search('asked', 3)},
    held AS (SELECT chunk_id FROM chunks JOIN labels ON chapter_id = 'd' || doc_id),
    looked AS (SELECT query_id AS seq, rank, chunk_id, chunk_id IN (SELECT chunk_id FROM held) AS known,
      row_number() OVER (PARTITION BY chunk_id ORDER BY query_id, rank) = 1 AS first FROM hits),
    linked AS (SELECT target_id, chunk_id, min(seq * 10 + rank) AS o FROM looked JOIN log USING (seq) GROUP BY ALL),
    ids AS (SELECT target_id, string_agg('ev_' || chunk_id, '|' ORDER BY o) AS evidence_ids FROM linked GROUP BY 1),
    counts AS (SELECT target_id, count(*) FILTER (NOT known AND first) AS added FROM looked JOIN log USING (seq) GROUP BY 1),
    triggers AS (SELECT target_id, count(*) AS n_triggers FROM log GROUP BY 1),
    grew AS (SELECT DISTINCT seq FROM looked WHERE NOT known AND first),
    steps AS (SELECT target_id, arg_max(CASE WHEN action = 'delete' THEN 'deleted' WHEN action = 'edit' OR seq IN (SELECT seq FROM grew) THEN 'updated'
      ELSE 'highlighted' END, seq) AS status FROM actions GROUP BY 1)
    SELECT node_id, coalesce(evidence_ids, '') AS evidence_ids, coalesce(status, 'normal') AS status,
      CASE WHEN added > 0 THEN 'old {lx.SUPPLEMENT_NOTE}' ELSE 'old' END AS summary, coalesce(added, 0) AS added, coalesce(n_triggers, 0) AS n_triggers
    FROM nodes LEFT JOIN ids ON ids.target_id = node_id LEFT JOIN counts c ON c.target_id = node_id LEFT JOIN triggers t ON t.target_id = node_id
      LEFT JOIN steps s ON s.target_id = node_id""",
)
def feedback_supplement(spark, sf):
    """User turns as comments on their conversation's node, late ones deletes; one graph holds them all."""
    talks = table(spark, sf, "conversations")
    log = talks.filter(F.col("role") == "user").select(
        F.lit("talk").alias("graph_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("node").alias("target_type"),
        F.concat(F.lit("c"), "conv_id").alias("target_id"),
        F.when(F.col("turn") > 2, "delete").when(F.col("turn") > 0, "edit").otherwise("split").alias("action"),
        F.col("text").alias("comment"),
    )
    nodes = talks.groupBy("conv_id").agg(F.min("role").alias("name")).select(
        F.lit("talk").alias("graph_id"), F.concat(F.lit("c"), "conv_id").alias("node_id"), "name", F.lit("old").alias("summary"),
        F.array().cast("array<string>").alias("evidence_ids"), F.lit("normal").alias("status"),
    )
    topics = spark.createDataFrame([("talk", "")], "graph_id string, topic string")
    triggers = stage(fb.supplement_queries(log, nodes, topics, TRIGGERS), "triggers")
    cut = cp.staged_chunks(spark, sf)
    asked = triggers.filter(F.col("query").isNotNull()).select(F.col("seq").alias("query_id"), "query")
    hits = se.to_evidence(se.SparseIndex(cut, max_features=lx.MAX_FEATURES).search(asked, 3), cut).withColumnRenamed("query_id", "seq")
    hits = stage(hits.withColumn("graph_id", F.lit("talk")), "hits")
    labelled = table(spark, sf, "labels").select(F.concat(F.lit("d"), "doc_id").alias("chapter_id"))
    held = cut.join(labelled, "chapter_id", "left_semi").select(
        F.lit("talk").alias("graph_id"), F.concat(F.lit("ev_"), "chunk_id").alias("evidence_id"), "chunk_id"
    )
    changed, added, records = fb.supplement(nodes, held, triggers, hits)
    counts = records.groupBy(F.col("target_id").alias("node_id")).agg(
        F.sum("added_evidence_count").alias("added"), F.count("*").alias("n_triggers")
    )
    elements = nodes.select(
        "graph_id", F.lit("node").alias("target_type"), F.col("node_id").alias("target_id"), "status", F.lit("").alias("note")
    )
    folded = fb.apply_feedback(elements, log, records).select(F.col("target_id").alias("node_id"), "status")
    rows = _joined(changed.drop("status"), "evidence_ids").join(counts, "node_id", "left").join(folded, "node_id")
    return rows.select(
        "node_id", "evidence_ids", "status", "summary", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "n_triggers")]
    )


@query("stream_feedback", _STATE_SQL)
def stream_feedback(spark, sf):
    """The event table streamed as a log; must equal the batch fold."""
    root = staging_root(spark)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    root = f"{root}/feedback-{uuid.uuid4().hex}"
    events = cp.table_stream(spark, sf, "events")
    sf_stream.follow(feedback_log(events), f"{root}/folds", f"{root}/checkpoint").awaitTermination()
    return sf_stream.current_state(spark, _elements(spark, sf), f"{root}/folds").select(*fb.TARGET, "status", "note")


@query("stream_keyed_state", _STATE_SQL)
def stream_keyed_state(spark, sf):
    """As `stream_feedback` with state per target, event time and every action sent twice."""
    root = cp.scratch(spark, "keyed")
    events = cp.table_stream(spark, sf, "events")
    log = feedback_log(events, "ts")
    twice = log.withColumn("_twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_twice")
    keyed.follow_keyed(twice, f"{root}/states", f"{root}/checkpoint", "3650 days").awaitTermination()
    states = keyed.keyed_states(spark, f"{root}/states")
    return keyed.current_state(_elements(spark, sf), states).select(*fb.TARGET, "status", "note")


@query("stream_audit", ORACLES["feedback_audit"])
def stream_audit(spark, sf):
    """Audit records of the streamed log; equal to those of the batch."""
    root = cp.scratch(spark, "audit")
    events = cp.table_stream(spark, sf, "events")
    log = feedback_log(events)
    sf_stream.follow(log, f"{root}/folds", f"{root}/checkpoint", f"{root}/trail").awaitTermination()
    return _audit_columns(sf_stream.audit_trail(spark, _elements(spark, sf), f"{root}/trail"))
