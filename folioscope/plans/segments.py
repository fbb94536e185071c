"""Queries for segmentation, sources, stores, catalogues and ingest."""

from __future__ import annotations


from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import evaluate as ev
from folioscope.operators import index as ix
from folioscope.operators import search as se
from folioscope.operators import segment as sg
from folioscope.operators.integration import pending
from folioscope.plans import core
from folioscope.plans import corpus as cp
from folioscope.plans import sql
from folioscope.plans.corpus import query, scratch, table
from folioscope.session import stage
from folioscope.sources import catalog, files, store
from folioscope.streaming import ingest as st

TITLE_SQL = r"""trim(trim(regexp_replace(regexp_replace(regexp_replace({0}, ' +', ' ', 'g'), '\s+\d+$', ''), '\.+$', '')),
  '.,，、；;:：!?！？"''')"""


def valid_sql(title: str, raw: str) -> str:
    return rf"""(length({raw}) >= 2 AND length({title}) BETWEEN 2 AND 80
  AND len(regexp_extract_all({title}, '[\x{{4e00}}-\x{{9fff}}A-Za-z]')) >= 2
  AND NOT regexp_matches({title}, '^\d+\s*$') AND NOT regexp_matches({title}, 'Page\s*\d+\s*of\s*\d+')
  AND NOT (length({title}) > 10 AND len(regexp_extract_all({title}, '[，。、；：]')) / length({title}) > 0.4))"""


def _sections_sql(head: str, title: str, source: str = "documents") -> str:
    return f"""cleaned AS (SELECT doc_id, {sql.NORMALISED} AS text FROM {source}),
lines AS (
  SELECT doc_id, pos, trim(string_split(text, chr(10))[pos]) AS line
  FROM cleaned, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(pos)),
flagged AS (SELECT *, {head} AS head FROM lines),
numbered AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM flagged),
bodies AS (
  SELECT doc_id, section, max({title}) FILTER (head) AS title, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head AND line <> '') AS content,
    sum(length(line)) FILTER (NOT head) AS chars
  FROM numbered GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS n FROM bodies WHERE content IS NOT NULL),
sections AS (
  SELECT doc_id, n, {TITLE_SQL.format("coalesce(title, '全文')")} AS title, content, chars::INTEGER AS char_count FROM kept
  UNION ALL SELECT doc_id, 1, '全文', text, length(text)::INTEGER FROM cleaned WHERE doc_id NOT IN (SELECT doc_id FROM kept))"""


_SECTIONS = _sections_sql("length(line) <= 40 AND ends_with(line, '.')", "line")
_MARKDOWN = _sections_sql(
    r"regexp_matches(line, '^#{1,4}\s+.+')", r"substr(trim(regexp_extract(line, '^(#{1,4})\s+(.+)', 2)), 1, 80)"
)


def _section_columns(rows):
    return rows.select(
        "doc_id", "chapter_id", "title", F.md5("content").alias("content"), F.col("char_count").cast("int").alias("char_count")
    )


@query(
    "heading_sections",
    f"""WITH {_SECTIONS} SELECT doc_id, printf('ch_%03d', n) AS chapter_id, title, md5(content) AS content, char_count FROM sections""",
)
def heading_sections(spark, sf):
    docs = cp.documents(spark, sf).select("doc_id", "text")
    return _section_columns(sg.heading_sections(docs, "doc_id", cp.SHORT_LINE))


@query(
    "markdown_sections",
    f"WITH {_MARKDOWN} SELECT doc_id, printf('ch_%03d', n) AS chapter_id, title, md5(content) AS content, char_count FROM sections",
)
def markdown_sections(spark, sf):
    """The default heading rule; most test documents have no such heading."""
    return _section_columns(sg.heading_sections(cp.documents(spark, sf).select("doc_id", "text")))


_ORDINAL = "'第 ' || n || ' 节'"
_PLAIN = _sections_sql(r"regexp_matches(line, '^Chapter\s+\d+[\s:。：]')", "substr(line, 1, 80)", "numbered_docs").replace(
    TITLE_SQL.format("coalesce(title, '全文')"), TITLE_SQL.format("coalesce(title, '')")
)


@query(
    "plain_sections",
    rf"""WITH numbered_docs AS (SELECT doc_id, regexp_replace(text, '(?m)^([^\n]{{1,40}}\.)$', 'Chapter 7: \1', 'g') AS text FROM documents),
    {_PLAIN}
    SELECT doc_id, printf('ch_%03d', n) AS chapter_id, CASE WHEN {valid_sql('title', 'title')} THEN title ELSE {_ORDINAL} END AS title,
      md5(content) AS content, char_count FROM sections""",
)
def plain_sections(spark, sf):
    """The plain-text rule with checked titles; short lines are made chapter lines."""
    text = F.regexp_replace("text", r"(?m)^([^\n]{1,40}\.)$", "Chapter 7: $1")
    docs = cp.documents(spark, sf).select("doc_id", text.alias("text"))
    return _section_columns(sg.heading_sections(docs, "doc_id", sg.PLAIN_TEXT))


def _paragraphs(spark, sf):
    docs = cp.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    line = tx.strip(F.col("text"))
    style = F.when((F.length(line) <= 40) & line.endswith("."), F.when(F.length(line) <= 15, "Heading 1").otherwise("标题 2"))
    return docs.withColumn("style", F.coalesce(style, F.lit("Normal")))


@query(
    "styled_sections",
    rf"""WITH lines AS (
      SELECT doc_id, pos, trim(regexp_replace(string_split(text, chr(10))[pos], ' +', ' ', 'g')) AS line, trim(string_split(text, chr(10))[pos]) AS raw
      FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(pos)),
    flagged AS (SELECT *, length(raw) <= 40 AND ends_with(raw, '.') AS head FROM lines WHERE line <> ''),
    numbered AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM flagged),
    bodies AS (
      SELECT doc_id, section, max(line) FILTER (head) AS title, max(length(raw)) FILTER (head) AS size,
        string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head) AS content, sum(length(line)) FILTER (NOT head) AS chars
      FROM numbered GROUP BY ALL),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS n FROM bodies WHERE content IS NOT NULL),
    rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS content, sum(length(line)) AS chars FROM lines
             WHERE line <> '' AND doc_id NOT IN (SELECT doc_id FROM kept) GROUP BY doc_id)
    SELECT doc_id, printf('ch_%03d', n) AS chapter_id,
      CASE WHEN title IS NULL OR {TITLE_SQL.format('title')} = '' THEN '未识别章节' ELSE {TITLE_SQL.format('title')} END AS title,
      CASE WHEN size > 15 THEN 2 ELSE 1 END AS level, md5(content) AS content, chars::INTEGER AS char_count FROM kept
    UNION ALL SELECT doc_id, 'ch_001', '未识别章节', 1, md5(content), chars::INTEGER FROM rest
    UNION ALL SELECT doc_id, 'ch_001', '未识别章节', 1, md5(''), 0 FROM documents WHERE trim(text, ' ' || chr(10)) = ''""",
)
def styled_sections(spark, sf):
    rows = sg.styled_sections(_paragraphs(spark, sf))
    return rows.select(
        "doc_id", "chapter_id", "title", "level", F.md5("content").alias("content"), F.col("char_count").cast("int").alias("char_count")
    )


# tables of contents: external ones from the labelled pages, bookmarks from the pages that
# are not English, rules from line beginnings
_FIRST = "regexp_extract(text, '[^.\\n]+')"
_PAGES = "paged AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents)"
_TOC = rf"""{_PAGES},
external AS (
  SELECT source AS textbook_id, 1 + quality + toxic AS level,
    CASE WHEN toxic = 0 THEN '第一章 病理 ' ELSE '' END || {_FIRST} AS title, page AS page_start
  FROM paged JOIN labels USING (doc_id)),
bookmarks AS (SELECT source AS textbook_id, length(lang) AS level, {_FIRST} AS title, page AS page_start FROM paged WHERE lang <> 'en'),
bad AS (SELECT textbook_id, count(*) AS n,
  count(*) FILTER (length(title) < 4 OR (len(regexp_extract_all(title, '[\x{{4e00}}-\x{{9fff}}]')) < 2 AND length(title) > 5)) AS n_bad
  FROM external GROUP BY 1),
usable AS (SELECT textbook_id FROM bad WHERE NOT (n >= 3 AND n_bad / n > 0.6) AND n_bad < 3),
cleaned AS (SELECT source AS textbook_id, page, {sql.NORMALISED} AS text FROM paged),
lines AS (SELECT textbook_id, page, pos, trim(string_split(text, chr(10))[pos]) AS line
  FROM cleaned, unnest(range(1, least(10, len(string_split(text, chr(10)))) + 1)) AS r(pos)),
matched AS (SELECT *, CASE WHEN regexp_matches(line, '^Th') THEN 1 WHEN regexp_matches(line, '^(An|En)') THEN 2 END AS level,
  {TITLE_SQL.format('substr(line, 1, 80)')} AS title FROM lines),
valid AS (SELECT * FROM matched WHERE level IS NOT NULL AND {valid_sql('title', 'title')}),
rules AS (SELECT * FROM (SELECT *, lag(title) OVER (PARTITION BY textbook_id ORDER BY page, pos) AS before FROM valid)
  WHERE before IS DISTINCT FROM title),
offered AS (
  SELECT textbook_id, 1 AS p, level, {TITLE_SQL.format('title')} AS title, title AS raw, page_start, 'external' AS origin, 0 AS pos, 1 AS least
  FROM external WHERE page_start BETWEEN 1 AND 9999 AND textbook_id IN (SELECT textbook_id FROM usable)
  UNION ALL SELECT textbook_id, 2, level, {TITLE_SQL.format('title')}, title, page_start, 'bookmarks', 0, 2 FROM bookmarks WHERE level <= 3 AND page_start > 0
  UNION ALL SELECT textbook_id, 3, level, title, title, page, 'rules', (pos - 1), 1 FROM rules),
entries AS (SELECT * FROM offered WHERE {valid_sql('title', 'title')} AND length(raw) >= 2),
sizes AS (SELECT textbook_id, p FROM entries GROUP BY textbook_id, p, least HAVING count(*) >= least),
best AS (SELECT textbook_id, min(p) AS p FROM sizes GROUP BY 1),
toc AS (SELECT * FROM entries JOIN best USING (textbook_id, p))"""


def _toc_inputs(spark, sf):
    paged = stage(cp.pages(spark, sf), "paged")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    first = F.regexp_extract("text", "[^.\n]+", 0)
    base = ["textbook_id", "level", "title", F.col("page").alias("page_start"), F.lit(0).alias("pos")]
    labelled = paged.join(table(spark, sf, "labels"), "doc_id")
    external = labelled.withColumns(
        {
            "level": (1 + F.col("quality") + F.col("toxic")).cast("int"),
            "title": F.concat(F.when(F.col("toxic") == 0, "第一章 病理 ").otherwise(""), first),
        }
    ).select(*base)
    foreign = paged.join(docs.filter(F.col("lang") != "en"), "doc_id")
    bookmarks = foreign.withColumns({"level": F.length("lang"), "title": first}).select(*base)
    rules = sg.toc_by_rules(paged, "^Th", "^(An|En)")
    books = paged.select("textbook_id").distinct()
    return paged, books, external, bookmarks, rules


@query(
    "toc_select",
    f"WITH {_TOC} SELECT textbook_id, level::INTEGER AS level, title, page_start::INTEGER AS page_start, origin, pos::INTEGER AS pos FROM toc",
)
def toc_select(spark, sf):
    _, books, external, bookmarks, rules = _toc_inputs(spark, sf)
    return sg.toc_select(books, external, bookmarks, rules)


_RANGES = """totals AS (SELECT source AS textbook_id, max(page) AS total_pages FROM paged GROUP BY 1),
ranges AS (
  SELECT textbook_id, row_number() OVER w AS n, title, raw, level, page_start,
    greatest(coalesce(lead(page_start) OVER w - 1, total_pages), page_start) AS page_end
  FROM entries JOIN totals USING (textbook_id) WHERE origin = 'bookmarks'
  WINDOW w AS (PARTITION BY textbook_id ORDER BY page_start, pos))"""


@query(
    "toc_ranges",
    f"""WITH {_TOC}, {_RANGES} SELECT textbook_id, printf('ch_%03d', n) AS chapter_id, title,
      page_start::INTEGER AS page_start, page_end::INTEGER AS page_end FROM ranges""",
)
def toc_ranges(spark, sf):
    paged, _, _, bookmarks, _ = _toc_inputs(spark, sf)
    rows = sg.toc_ranges(sg.toc_supplied(bookmarks), sg.document_totals(paged))
    return rows.select("textbook_id", "chapter_id", "title", "page_start", "page_end")


@query(
    "page_chapter_join",
    f"""WITH {_TOC}, {_RANGES},
    totalled AS (SELECT textbook_id, max(page) AS total_pages, sum(length(text))::BIGINT AS total_chars FROM cleaned GROUP BY 1)
    SELECT r.textbook_id, printf('ch_%03d', n) AS chapter_id,
      md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page), '')) AS content, coalesce(sum(length(text)), 0)::BIGINT AS char_count,
      any_value(t.total_pages)::INTEGER AS total_pages, any_value(t.total_chars) AS total_chars
    FROM ranges r JOIN totalled t ON t.textbook_id = r.textbook_id
    LEFT JOIN cleaned c ON c.textbook_id = r.textbook_id AND c.page BETWEEN page_start AND page_end AND text <> ''
    GROUP BY r.textbook_id, n""",
)
def page_chapter_join(spark, sf):
    paged, _, _, bookmarks, _ = _toc_inputs(spark, sf)
    totals = sg.document_totals(paged)
    ranges = stage(sg.toc_ranges(sg.toc_supplied(bookmarks), totals), "ranges")
    rows = sg.chapter_content(ranges, paged).join(totals, "textbook_id")
    return rows.select(
        "textbook_id", "chapter_id", F.md5("content").alias("content"), "char_count", "total_pages", "total_chars"
    )


# --- sources and stores ----------------------------------------------------------
@query(
    "scan_files",
    rf"""SELECT source, count(*) AS files, sum(length({sql.NORMALISED}))::BIGINT AS total_chars, count(*)::BIGINT AS chapter_count
    FROM documents GROUP BY source""",
)
def scan_files(spark, sf):
    """Each document written as a text file, scanned, decoded and split again; counted per source.

    All files of a source begin with the same characters, so only their paths tell them apart.
    """
    root = scratch(spark, "files")
    files.write_texts(table(spark, sf, "documents"), root, "source")
    found = files.list_files(spark, root, "*.txt")
    wanted, missing = files.requested_files(found)
    documents, chapters = files.parse_files(wanted)
    counted = catalog.summary(documents, chapters)
    good, errors = files.page_scan(
        counted.select(
            F.col("filename").alias("source_file"),
            F.col("path").alias("source_path"),
            F.lit(1).alias("page"),
            F.col("title").alias("text"),
            "error",
            "total_chars",
            "chapter_count",
        )
    )
    source = F.regexp_extract("source_path", "source=([^/]+)", 1).alias("source")
    return good.groupBy(source).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("total_chars").alias("total_chars"),
        F.sum("chapter_count").alias("chapter_count"),
    )


@query(
    "store_roundtrip",
    f"WITH {sql.question_evidence(5)} SELECT query_id, rank, chunk_id, book, round(score, 6) AS score FROM evidence",
)
def store_roundtrip(spark, sf):
    """Parsed tables, index and results through their stores and back."""
    root = scratch(spark, "store")
    books, chapters = cp.parsed(spark, sf)
    parsed = store.DocumentStore(spark, f"{root}/parsed")
    parsed.save("documents", books)
    parsed.save("chapters", chapters)
    parsed.save("chapters", parsed.load("chapters"))
    cut = cp.staged_cut(parsed.load("documents"), parsed.load("chapters"))
    vocab = stage(ix.numbered(stage(ix.vocabulary(cut, cut.count()), "vocab")), "numbered")
    store.save_index(
        f"{root}/index", cut, vocab, ix.tfidf_vectors(cut, vocab), ix.index_meta(cut, None, 700, 80, "tfidf")
    )
    index = store.load_index(spark, f"{root}/index")
    asked = cp.questions(spark, sf)
    asked.select(F.col("query_id").cast("string").alias("id"), "question", "expected_keywords").write.json(f"{root}/questions")
    again = store.read_questions(spark, f"{root}/questions", lines=True).select(
        F.col("id").cast("long").alias("query_id"), F.col("question").alias("query")
    )
    asked = se.query_vectors(again, index["vocab"].select("term", "idf"))
    hits = se.sparse_top_k(index["vectors"], asked, 5, index["vocab"])
    hits.write.json(f"{root}/results")
    schema = "query_id long, chunk_id string, score double, rank int"
    back = spark.read.schema(schema).json(f"{root}/results")
    return se.with_chunks(back, index["chunks"]).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "book", F.round("score", 6).alias("score")
    )


@query(
    "result_sinks",
    f"WITH {core.CONTEXTS}, {core.SUMMARY} SELECT strategy, {', '.join(f'round({m}, 4) AS {m}' for m in ev.METRICS)} FROM summary",
)
def result_sinks(spark, sf):
    """Evaluation results as JSON, CSV and Markdown; the CSV is read back."""
    root = scratch(spark, "sinks")
    docs, questions = cp.eval_docs(spark, sf), cp.questions(spark, sf)
    contexts, times = ev.evaluate_timed(docs, questions)
    names = ["baseline_medium", "small_only", "small_to_big"]
    rows = stage(ev.question_metrics(contexts, questions, names), "metrics")
    nested = ev.nested_results(rows, contexts, questions, times)
    store.write_results(root, nested, ev.strategy_summary(rows, times), store.run_metadata(docs, questions))
    columns = ["hit_at_5", "keyword_recall", "context_chars", "avg_latency_ms", *store.SUMMARY_COLUMNS[4:]]
    schema = "strategy string, " + ", ".join(f"{c} double" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(f"{root}/results").drop("avg_latency_ms")


_NESTED = """nested AS (SELECT m.strategy, m.query_id, m.hit_at_5::DOUBLE AS hit_at_5, q.question, coalesce(c.ids, '') AS chunk_ids
  FROM metrics m JOIN questions q USING (query_id) LEFT JOIN (
    SELECT strategy, query_id, string_agg(rank || ':' || chunk_id || ':' || md5(substr(text, 1, 280)), '|' ORDER BY rank) AS ids
    FROM contexts GROUP BY ALL) c USING (strategy, query_id))"""


@query("nested_results", f"WITH {core.CONTEXTS}, {core.SUMMARY}, {_NESTED} SELECT * FROM nested")
def nested_results(spark, sf):
    """Every question's metrics and contexts written as nested JSON and read back."""
    root = scratch(spark, "nested")
    docs, questions = cp.eval_docs(spark, sf), cp.questions(spark, sf)
    contexts, times = ev.evaluate_timed(docs, questions)
    rows = ev.question_metrics(contexts, questions, ["baseline_medium", "small_only", "small_to_big"])
    nested = ev.nested_results(rows, contexts, questions, times)
    nested.write.json(f"{root}/raw_results")
    back = spark.read.schema(nested.schema).json(f"{root}/raw_results").withColumn(
        "chunk_ids", F.array_join(F.transform("contexts", lambda c: F.concat_ws(":", c["rank"].cast("string"), c["chunk_id"], F.md5(c["snippet"]))), "|")
    )
    return back.select("strategy", "query_id", "hit_at_5", "question", "chunk_ids")


@query(
    "eval_corpus",
    f"""WITH d AS (SELECT doc_id, {sql.FLAT} AS text, doc_id IN (SELECT doc_id FROM labels) AS split FROM documents)
    SELECT 'b' || doc_id AS textbook_id, CASE WHEN split THEN 'b' || doc_id || ':ch_001' ELSE 'b' || doc_id || ':page_' || doc_id END AS source_id,
      CASE WHEN split THEN 'ch_001' ELSE 'page' END AS chapter, 'b' || doc_id || '.json' AS filename, doc_id AS page_start, md5(text) AS text
    FROM d WHERE length(text) >= 20""",
)
def eval_corpus(spark, sf):
    """Every document a book; the labelled ones have a chapter, the others pages only."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("b"), "doc_id").alias("textbook_id"), "doc_id", "text")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    chapters = labelled.select(
        "textbook_id", F.lit("ch_001").alias("chapter_id"), F.lit("").alias("title"), F.col("doc_id").alias("page_start"),
        F.col("doc_id").alias("page_end"), F.col("text").alias("content"),
    )
    pages = docs.select("textbook_id", F.col("doc_id").alias("page"), F.lit(None).cast("string").alias("chapter"), "text")
    books = docs.select("textbook_id", F.lit("").alias("title"), F.lit(None).cast("string").alias("filename"))
    rows = store.eval_corpus(books, chapters, pages)
    return rows.select("textbook_id", "source_id", "chapter", "filename", "page_start", F.md5("text").alias("text"))


@query(
    "catalog_summary",
    """SELECT s.source AS textbook_id, 'Book ' || s.source AS title, count(d.doc_id) AS chapter_count,
      CASE WHEN max(d.lang) = 'fr' THEN 'pending' WHEN count(DISTINCT d.lang) > 3 THEN 'failed' ELSE 'completed' END AS parse_status,
      CASE WHEN max(d.lang) = 'fr' OR count(DISTINCT d.lang) > 3 THEN TRUE ELSE FALSE END AS to_parse
    FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN documents d ON d.source = s.source GROUP BY 1, 2""",
)
def catalog_summary(spark, sf):
    books, chapters = cp.parsed(spark, sf)
    docs = table(spark, sf, "documents")
    state = docs.groupBy(F.col("source").alias("textbook_id")).agg(
        F.when(F.max("lang") == "fr", "pending")
        .when(F.count_distinct("lang") > 3, "failed")
        .otherwise("completed")
        .alias("parse_status")
    )
    rows = catalog.summary(books.join(state, "textbook_id"), chapters)
    todo = pending(rows).select("textbook_id", F.lit(True).alias("todo"))
    return rows.join(todo, "textbook_id", "left").select(
        "textbook_id", "title", "chapter_count", "parse_status", F.coalesce("todo", F.lit(False)).alias("to_parse")
    )


@query(
    "catalog_priority",
    r"""WITH f AS (
      SELECT 0 AS priority, 'up/' || doc_id AS path, 'doc_' || doc_id || '.md' AS filename FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
      UNION ALL SELECT 1, 'book/' || doc_id, 'doc_' || doc_id || '.txt' FROM documents),
    k AS (SELECT *, 'book_' || regexp_replace(filename, '\.[^.]+$', '') AS textbook_id FROM f),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY textbook_id ORDER BY priority, path) AS n FROM k) WHERE n = 1),
    s AS (SELECT 'book_doc_' || doc_id AS textbook_id, 'Doc ' || doc_id AS title, n_chars FROM documents WHERE lang = 'en')
    SELECT w.textbook_id, priority, coalesce(title, regexp_replace(filename, '\.[^.]+$', '')) AS title,
      regexp_extract(filename, '[^.]+$') AS format, coalesce(n_chars, 0) AS total_chars,
      CASE WHEN title IS NULL THEN 'pending' ELSE 'completed' END AS parse_status
    FROM w LEFT JOIN s USING (textbook_id)""",
)
def catalog_priority(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labelled = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    first = labelled.select(
        F.concat(F.lit("up/"), "doc_id").alias("path"), F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("filename")
    )
    second = docs.select(
        F.concat(F.lit("book/"), "doc_id").alias("path"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename")
    )
    stored = docs.filter(F.col("lang") == "en").select(
        F.concat(F.lit("book_doc_"), "doc_id").alias("textbook_id"),
        F.concat(F.lit("Doc "), "doc_id").alias("title"),
        F.lit(1).alias("total_pages"),
        F.col("n_chars").alias("total_chars"),
        F.lit(1).alias("chapter_count"),
        F.lit("completed").alias("parse_status"),
        F.lit("").alias("error"),
    )
    rows = catalog.catalogue([first, second], stored)
    return rows.select("textbook_id", "priority", "title", "format", "total_chars", "parse_status")


@query(
    "index_status",
    f"""WITH {sql.chapter_chunks()}, {sql.counts('chunks', 'chunk_id', 'text', 'tf')},
    v AS (SELECT count(DISTINCT chunk_id) AS n FROM chunks JOIN embeddings ON 'd' || vec_id = chapter_id),
    status AS (
      SELECT count(*) AS chunk_count, count(DISTINCT source_file) AS textbook_count,
        (SELECT count(DISTINCT term) FROM tf) AS term_count, 'hybrid' AS retrieval_backend,
        count(*) = (SELECT n FROM v) AS has_embedding, TRUE AS has_tfidf,
        CASE WHEN count(*) = (SELECT n FROM v) THEN '' ELSE 'vectors incomplete, sparse index kept' END AS embedding_warning,
        TRUE AS exists, CASE WHEN count(*) = (SELECT n FROM v) THEN '' ELSE 'tfidf' END AS fallback_backend
      FROM chunks)
    SELECT * FROM (SELECT source_file, count(*) AS file_chunks FROM chunks GROUP BY 1), status""",
)
def index_status(spark, sf):
    """Every indexed file with the status of the index."""
    cut = cp.staged_chunks(spark, sf)
    vocab = ix.vocabulary(cut, cut.count())
    ids = table(spark, sf, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("chapter_id"))
    vectors = cut.join(ids, "chapter_id", "left_semi")
    status = store.index_status(cut, vocab, ix.index_meta(cut, vectors, 700, 80))
    return ix.index_files(cut).join(F.broadcast(status), F.lit(True))


# --- ingest stream ---------------------------------------------------------------
@query(
    "stream_ingest",
    f"""WITH {_SECTIONS},
    sized AS (SELECT doc_id, n, title, trim(content, ' ' || chr(10)) AS body FROM sections),
    windows AS (SELECT doc_id, n, title, i, trim(substr(body, i * 620 + 1, 700), ' ' || chr(10)) AS text
      FROM sized, unnest(range(0, CASE WHEN length(body) <= 700 THEN 1 ELSE ceil((length(body) - 700) / 620)::BIGINT + 1 END)) AS r(i))
    SELECT doc_id || printf('_ch_%03d', n) || '_c' || row_number() OVER (PARTITION BY doc_id, n ORDER BY i) AS chunk_id,
      title AS chapter, md5(text) AS text
    FROM windows WHERE text <> ''""",
)
def stream_ingest(spark, sf):
    root = scratch(spark, "ingest")
    docs = cp.table_stream(spark, sf, "documents").select("doc_id", "text")
    st.ingest(docs, f"{root}/chunks", f"{root}/checkpoint", cp.SHORT_LINE, buckets=16).awaitTermination()
    return spark.read.parquet(f"{root}/chunks").select("chunk_id", "chapter", F.md5("text").alias("text"))
