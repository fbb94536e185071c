"""Queries for text, chunking, indexing, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx
from folioscope.operators import chunk as ck
from folioscope.operators import evaluate as ev
from folioscope.operators import index as ix
from folioscope.operators import search as se
from folioscope.operators.postings import PostingsIndex
from folioscope.operators.vectors import VectorIndex
from folioscope.plans import corpus as cp
from folioscope.plans import sql
from folioscope.plans.corpus import query, scratch, table
from folioscope.session import GROUP_BYTES, broadcast_if_small, stage


# --- text ------------------------------------------------------------------------
@query(
    "clean_text",
    f"""SELECT doc_id, md5({sql.NORMALISED}) AS normalised, md5({sql.NORMALISED}) AS cleaned,
               md5({sql.FLAT}) AS flat, length({sql.FLAT})::INTEGER AS flat_chars FROM documents""",
)
def clean_text(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(tx.normalise(text)).alias("normalised"),
        F.md5(tx.clean(text)).alias("cleaned"),
        F.md5(tx.flatten_space(text)).alias("flat"),
        F.length(tx.flatten_space(text)).alias("flat_chars"),
    )


_TITLE = r"""trim(trim(regexp_replace(regexp_replace(regexp_replace(line, ' +', ' ', 'g'), '\s+\d+$', ''), '\.+$', '')),
  '.,，、；;:：!?！？"''')"""


@query(
    "clean_title_valid",
    rf"""WITH lines AS (
      SELECT doc_id, pos, string_split(text, chr(10))[pos] AS line
      FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(pos)),
    titles AS (SELECT *, {_TITLE} AS title FROM lines)
    SELECT doc_id, (pos - 1)::INTEGER AS pos, title,
      length(line) >= 2 AND length(title) BETWEEN 2 AND 80
      AND len(regexp_extract_all(title, '[\x{{4e00}}-\x{{9fff}}A-Za-z]')) >= 2
      AND NOT regexp_matches(title, '^\d+\s*$') AND NOT regexp_matches(title, 'Page\s*\d+\s*of\s*\d+')
      AND NOT (length(title) > 10 AND len(regexp_extract_all(title, '[，。、；：]')) / length(title) > 0.4) AS valid
    FROM titles""",
)
def clean_title_valid(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(
        "doc_id", "pos", tx.clean_title(F.col("line")).alias("title"), tx.is_valid_title(F.col("line")).alias("valid")
    )


@query(
    "derive_ids",
    r"""WITH names AS (
      SELECT doc_id, unnest([doc_id || '_' || source || ' ' || lang || '.PDF', doc_id || '.txt', '05_病理学.pdf']) AS name FROM documents),
    keyed AS (SELECT *, trim(regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS k FROM names)
    SELECT doc_id, name,
      'book_' || CASE WHEN length(k) < 3 THEN substr(md5(name), 1, 8) ELSE substr(k, 1, 20) END AS textbook_id,
      CASE WHEN name = '05_病理学.pdf' THEN '病理学'
           ELSE trim(regexp_replace(regexp_replace(name, '^\d+_', ''), '\.(pdf|md|txt|docx)$', '', 'i')) END AS title,
      substr(sha1(name || '::' || doc_id), 1, 16) AS stable_id
    FROM keyed""",
)
def derive_ids(spark, sf):
    names = F.array(
        F.concat("doc_id", F.lit("_"), "source", F.lit(" "), "lang", F.lit(".PDF")),
        F.concat("doc_id", F.lit(".txt")),
        F.lit("05_病理学.pdf"),
    )
    name = F.col("name")
    return table(spark, sf, "documents").select("doc_id", F.explode(names).alias("name")).select(
        "doc_id",
        "name",
        tx.document_id(name).alias("textbook_id"),
        tx.book_title(name).alias("title"),
        tx.stable_id(name, F.col("doc_id")).alias("stable_id"),
    )


@query(
    "infer_chapter",
    """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:12], lambda x: trim(x)) AS lines FROM documents)
    SELECT doc_id, coalesce(substr(list_filter(lines, lambda x: regexp_matches(x, 'tion|ung'))[1], 1, 80), '章节待识别') AS chapter,
           '章节待识别' AS default_chapter
    FROM l""",
)
def infer_chapter(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", tx.infer_chapter(text, "tion|ung").alias("chapter"), tx.infer_chapter(text).alias("default_chapter")
    )


@query(
    "keywords",
    r"""WITH w AS (
      SELECT doc_id, list_filter(regexp_extract_all(text, '[\x{4e00}-\x{9fa5}A-Za-z0-9]{2,}'), lambda x: x NOT IN ('the', 'die')) AS l FROM documents),
    p AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM w),
    f AS (SELECT doc_id, word, min(pos) AS pos FROM p GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f)
    SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY n) FILTER (n <= 8), '') AS keywords
    FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id""",
)
def keywords(spark, sf):
    stop = ["the", "die"]
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(tx.keywords(F.col("text"), stop=stop), " ").alias("keywords")
    )


@query(
    "display_text",
    f"""WITH d AS (SELECT *, {sql.FLAT} AS flat FROM documents)
    SELECT doc_id, substr(flat, 1, 90) AS quote,
      CASE WHEN length(flat) <= 180 THEN flat ELSE substr(flat, 1, 180) || '...' END AS short_text,
      CASE WHEN lang = 'en' THEN source ELSE '未知教材' END || ' / ' || CASE WHEN toxic IS NULL THEN '未知章节' ELSE 'Doc ' || doc_id END
        || ' / 页码 ' || CASE WHEN doc_id = 0 THEN '未知' WHEN doc_id <> n_chars THEN doc_id || '-' || n_chars ELSE doc_id::VARCHAR END AS source_line,
      lang = 'en' AND toxic IS NOT NULL AS complete,
      round(n_chars / 7.0, 6) AS score, substr(text, 1, 280) AS snippet
    FROM d LEFT JOIN labels USING (doc_id)""",
)
def display_text(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    book = F.when(F.col("lang") == "en", F.col("source")).otherwise("")
    chapter = F.when(F.col("toxic").isNotNull(), F.concat(F.lit("Doc "), "doc_id"))
    where = (book, chapter, F.col("doc_id"), F.col("n_chars"))
    return docs.select(
        "doc_id",
        tx.quote(F.col("text"), 90).alias("quote"),
        tx.short_text(F.col("text")).alias("short_text"),
        tx.source_line(*where).alias("source_line"),
        tx.citation_complete(*where).alias("complete"),
        *tx.context_fields(F.col("n_chars") / 7.0, F.col("text")),
    )


# --- chunks ----------------------------------------------------------------------
@query(
    "chunk_fixed",
    f"""WITH {sql.chapter_chunks()}
    SELECT chunk_id, textbook_id, book, chapter, page_start, length(text)::INTEGER AS char_count, md5(text) AS text FROM chunks""",
)
def chunk_fixed(spark, sf):
    books, chapters = cp.parsed(spark, sf)
    cut, _ = ck.chapter_chunks(books, chapters)
    return cut.select("chunk_id", "textbook_id", "book", "chapter", "page_start", "char_count", F.md5("text").alias("text"))


@query(
    "chunk_requested",
    """SELECT 'src' || nation.n_nationkey AS textbook_id, 'Textbook src' || nation.n_nationkey || ' not found in store' AS error
    FROM nation WHERE 'src' || nation.n_nationkey NOT IN (SELECT source FROM documents)""",
)
def chunk_requested(spark, sf):
    """Error rows of the chapter route: one requested book per nation key."""
    books, chapters = cp.parsed(spark, sf)
    wanted = table(spark, sf, "nation").select(F.concat(F.lit("src"), "n_nationkey").alias("textbook_id"))
    return ck.chapter_chunks(books, chapters, wanted)[1]


@query(
    "chunk_pages",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, {sql.NORMALISED} AS body FROM documents),
    c AS (SELECT source, page, i, trim(substr(body, i * 850 + 1, 1000), ' ' || chr(10)) AS text
      FROM p, unnest(range(0, CASE WHEN length(body) <= 1000 THEN 1 ELSE ceil((length(body) - 1000) / 850)::BIGINT + 1 END)) AS r(i))
    SELECT source || '::p' || page || '::c' || row_number() OVER (PARTITION BY source, page ORDER BY i) AS chunk_id, md5(text) AS text
    FROM c WHERE text <> ''""",
)
def chunk_pages(spark, sf):
    rows = cp.pages(spark, sf).select(F.col("textbook_id").alias("source_file"), "page", "text")
    return ck.page_chunks(rows).select("chunk_id", F.md5("text").alias("text"))


@query("chunk_lines")
def chunk_lines(spark, sf):
    rows = cp.pages(spark, sf).select(F.col("textbook_id").alias("source_file"), "page", "text")
    return ck.enrich_page_chunks(rows).select("chunk_id", "book", "chapter", "section", "char_count", "text")


@query(
    "chunk_eval",
    f"WITH {sql.DOCS}, {sql.eval_chunks(700, 80)} SELECT chunk_id, source_id, char_start, char_end, md5(text) AS text FROM chunks",
)
def chunk_eval(spark, sf):
    cut = ck.eval_chunks(cp.eval_docs(spark, sf), [(700, 80)])
    return cut.select("chunk_id", "source_id", "char_start", "char_end", F.md5("text").alias("text"))


@query(
    "chunk_multires",
    f"""WITH {sql.DOCS}, {sql.eval_chunks(700, 80, 'a')}, {sql.eval_chunks(300, 50, 'b')}, {sql.eval_chunks(1200, 150, 'c')}
    SELECT chunk_id, size, overlap, char_start, char_end, md5(text) AS text
    FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""",
)
def chunk_multires(spark, sf):
    cut = ck.eval_chunks(cp.eval_docs(spark, sf), [(700, 80), (300, 50), (1200, 150)])
    return cut.select("chunk_id", "size", "overlap", "char_start", "char_end", F.md5("text").alias("text"))


# --- index -----------------------------------------------------------------------
@query(
    "char_ngrams",
    f"""WITH {sql.counts('documents', 'doc_id', 'text', 'tf')}
    SELECT doc_id, sum(tf)::BIGINT AS n_grams, count(*) AS n_terms, max(term) AS last_term FROM tf GROUP BY doc_id""",
)
def char_ngrams(spark, sf):
    """N-grams are counted inside the row; only those of ids that several rows share are grouped."""
    docs = cp.documents(spark, sf).select("doc_id", "text")
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"))
    shared = broadcast_if_small(stage(shared, "shared"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    own = F.transform(
        F.array(ix.char_ngrams(F.col("text"))),
        lambda grams: F.struct(
            F.size(grams).cast("long").alias("n_grams"),
            F.size(F.array_distinct(grams)).cast("long").alias("n_terms"),
            F.array_max(grams).alias("last_term"),
        ),
    )
    # filtered as an array: a filter of the rows would count them a second time
    own = F.explode(F.filter(own, lambda counted: counted["n_grams"] > 0)).alias("_g")
    once = docs.join(shared, same, "left_anti").select("doc_id", own).select("doc_id", "_g.*")
    grams = docs.join(shared, same, "left_semi").select("doc_id", F.explode(ix.char_ngrams(F.col("text"))).alias("term"))
    counted = grams.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    several = counted.groupBy("doc_id").agg(
        F.sum("tf").alias("n_grams"), F.count("*").alias("n_terms"), F.max("term").alias("last_term")
    )
    return once.unionByName(several)


@query(
    "vocab_topn",
    f"""WITH {sql.chapter_chunks()}, {sql.sparse_index(cap=20000)}
    SELECT term, df, cf, round(idf, 6) AS idf FROM vocab""",
)
def vocab_topn(spark, sf):
    cut = cp.staged_chunks(spark, sf)
    vocab = ix.vocabulary(cut, cut.count(), 20_000)
    return vocab.select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query(
    "tfidf_weights",
    f"""WITH {sql.chapter_chunks()}, {sql.sparse_index()}
    SELECT chunk_id, count(*) AS n_terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top, round(sum(weight * weight), 6) AS norm
    FROM weights GROUP BY chunk_id""",
)
def tfidf_weights(spark, sf):
    cut = cp.staged_chunks(spark, sf)
    vocab = stage(ix.vocabulary(cut, cut.count(), lx.MAX_FEATURES), "vocab")
    rows = ix.postings(ix.tfidf_vectors(cut, vocab))
    weight = F.col("weight")
    return rows.groupBy("chunk_id").agg(
        F.count("*").alias("n_terms"),
        F.round(F.sum(weight), 6).alias("total"),
        F.round(F.max(weight), 6).alias("top"),
        F.round(F.sum(weight * weight), 6).alias("norm"),
    )


@query(
    "dense_normalize",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
    g AS (SELECT count(*) AS chunk_count, count(vec_id) AS vector_count FROM documents LEFT JOIN embeddings ON doc_id = vec_id)
    SELECT vec_id, round(list_sum(v) / norm, 6) AS total, round(v[1] / norm, 6) AS first_value, chunk_count, vector_count,
           chunk_count = vector_count AS has_embedding,
           CASE WHEN chunk_count = vector_count THEN '' ELSE 'vectors incomplete, sparse index kept' END AS embedding_warning
    FROM n, g""",
)
def dense_normalize(spark, sf):
    vectors = table(spark, sf, "embeddings")
    gate = ix.dense_gate(
        table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id")),
        vectors.select(F.col("vec_id").alias("chunk_id")),
    )
    unit = vectors.select("vec_id", ix.l2_normalise(F.col("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x)
    # the gate is one row
    return unit.select(
        "vec_id", F.round(total, 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first_value")
    ).join(F.broadcast(gate), F.lit(True))


_LABELLED = "labelled AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


@query(
    "index_merge",
    f"""WITH {_LABELLED}, {sql.chapter_chunks(source='labelled', name='old')}, {sql.chapter_chunks(name='new')},
    merged AS (SELECT chunk_id, 'old' AS origin, text FROM old UNION ALL
               SELECT chunk_id, 'new', text FROM new WHERE chunk_id NOT IN (SELECT chunk_id FROM old)),
    {sql.sparse_index('merged', cap=None)}
    SELECT term, df, cf, round(idf, 6) AS idf, old_chunks, new_chunks FROM vocab,
      (SELECT count(*) FILTER (origin = 'old') AS old_chunks, count(*) FILTER (origin = 'new') AS new_chunks FROM merged)""",
)
def index_merge(spark, sf):
    new = cp.chunks(spark, sf)
    labelled = table(spark, sf, "labels").select(F.concat(F.lit("d"), "doc_id").alias("chapter_id"))
    old = new.join(labelled, "chapter_id", "left_semi")
    merged = stage(
        ix.merge_chunks(old.select("chunk_id", "text", F.lit("old").alias("origin")), new.select("chunk_id", "text", F.lit("new").alias("origin"))),
        "merged",
    )
    # only the unseen chunks are tokenised for the update; counts add up
    before = ix.vocabulary(merged.filter(F.col("origin") == "old"), 0)
    added = ix.vocabulary(merged.filter(F.col("origin") == "new"), 0)
    sizes = merged.agg(
        F.count_if(F.col("origin") == "old").alias("old_chunks"), F.count_if(F.col("origin") == "new").alias("new_chunks")
    )
    vocab = ix.merge_vocabulary(before, added, merged.count())
    return vocab.select("term", "df", "cf", F.round("idf", 6).alias("idf")).join(F.broadcast(sizes), F.lit(True))


# --- retrieval -------------------------------------------------------------------
_EVIDENCE_COLUMNS = "query_id, rank, chunk_id, book, chapter, page, quote, round(score, 6) AS score"


def _evidence_columns(evidence):
    return evidence.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "chunk_id",
        "book",
        "chapter",
        "page",
        "quote",
        F.round("score", 6).alias("score"),
    )


def _questions(spark, sf):
    return cp.questions(spark, sf).select("query_id", F.col("question").alias("query"))


@query("search_sparse", f"WITH {sql.question_evidence(5)} SELECT {_EVIDENCE_COLUMNS} FROM evidence")
def search_sparse(spark, sf):
    return _evidence_columns(cp.sparse_evidence(spark, sf, _questions(spark, sf), 5))


_HITS = "query_id, chunk_id, rank, round(score, 6) AS score"


def _hit_columns(hits):
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


@query(
    "search_postings",
    f"""WITH {sql.chapter_chunks()}, {sql.sparse_index(cap=None)}, {_ASKED}, {sql.search('asked', 5)}
    SELECT {_HITS} FROM hits""",
)
def search_postings(spark, sf):
    """Questions against the index on disk: only asked buckets and windows within reach of the result are read."""
    index = PostingsIndex(spark, scratch(spark, "postings"), buckets=16, window=128)
    index.append(cp.chunks(spark, sf))
    return _hit_columns(index.search(_questions(spark, sf), 5))


_CHANGED = """changed AS (
  SELECT chunk_id, CASE WHEN page_start % 7 = 0 THEN substr(text, 1, 100) ELSE text END AS text FROM chunks)"""


def _segmented(spark, sf, name):
    """Index after three appends, a replacing one of shortened chunks and one that adds nothing."""
    chunks = stage(cp.chunks(spark, sf), "chunks")
    index = PostingsIndex(spark, scratch(spark, name), buckets=16, window=128)
    for part in range(3):
        index.append(chunks.filter(F.col("page_start") % 3 == part))
    short = chunks.filter(F.col("page_start") % 7 == 0).withColumn("text", F.substring("text", 1, 100))
    index.append(short, replace=True)
    index.append(chunks)
    return index


@query(
    "index_segments",
    f"""WITH {sql.chapter_chunks()}, {_CHANGED}, {sql.sparse_index('changed', cap=None)}, {_ASKED}, {sql.search('asked', 10)}
    SELECT {_HITS} FROM hits""",
)
def index_segments(spark, sf):
    """Search over five segments; equals an index built anew."""
    return _hit_columns(_segmented(spark, sf, "segments").search(_questions(spark, sf), 10))


@query(
    "index_compacted",
    f"""WITH {sql.chapter_chunks()}, {_CHANGED}, {sql.sparse_index('changed', cap=None)}
    SELECT term, df, cf, round(idf, 6) AS idf FROM vocab""",
)
def index_compacted(spark, sf):
    """Vocabulary after the segments have become one."""
    index = _segmented(spark, sf, "compacted")
    index.compact()
    return index.vocabulary().select("term", "df", "cf", F.round("idf", 6).alias("idf"))


_CENTROIDS = """parts AS (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i) GROUP BY ALL),
dense_queries AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS q FROM parts GROUP BY label)"""


def _label_centroids(spark, sf):
    """One query vector per label: the mean of its vectors."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding")
    )


@query(
    "search_dense",
    f"""WITH {_CENTROIDS},
    scored AS (SELECT query_id, 'v' || vec_id AS chunk_id,
      list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]))
      / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) / sqrt(list_sum(list_transform(q, lambda x: x * x))) AS score
      FROM embeddings, dense_queries),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM scored)
    SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 60""",
)
def search_dense(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("chunk_id"), "embedding")
    hits = se.dense_top_k(vectors, _label_centroids(spark, sf), 60)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_NEAREST = """scored AS (SELECT a.vec_id AS query_id, 'v' || b.vec_id AS chunk_id,
      list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]))
      / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x))) / sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x))) AS score
      FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"""


@query(
    "search_vectors",
    f"""WITH {_NEAREST},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM scored)
    SELECT query_id, chunk_id AS best, round(score, 6) AS score, 10::BIGINT AS hits, TRUE AS recall_reached,
      (SELECT count(DISTINCT label) FROM embeddings) AS errors FROM ranked WHERE rank = 1""",
)
def search_vectors(spark, sf):
    """Every twentieth vector against all in projection buckets; recall is measured against the full scan.

    A vector of ten values per label stands for those that cannot be compared.
    """
    given = table(spark, sf, "embeddings")
    short = given.groupBy("label").agg(F.slice(F.min_by("embedding", "vec_id"), 1, 10).alias("embedding"))
    vectors = given.select(F.concat(F.lit("v"), "vec_id").alias("chunk_id"), "embedding").unionByName(
        short.select(F.concat(F.lit("short"), "label").alias("chunk_id"), "embedding")
    )
    asked = given.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    index = VectorIndex(vectors, scratch(spark, "vectors"), 64, bucket_rows=50)
    reached = index.tune(asked, 10)
    hits = stage(index.search(asked, 10), "hits")
    counted = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    best = hits.filter(F.col("rank") == 1).select("query_id", F.col("chunk_id").alias("best"), F.round("score", 6).alias("score"))
    return best.join(counted, "query_id").withColumns(
        {"recall_reached": F.lit(reached >= 0.9), "errors": F.lit(index.errors.count()).cast("long")}
    )


# hybrid: a chunk is a whole document, the vector of a document or question is the one
# with the same number, that of an expanded question the one after it
_VARIANTS = f"""{sql.QUESTIONS},
variants AS (
  SELECT query_id, 3 AS list_no, 'tfidf_original' AS match_type, 0.9 AS w, question AS query FROM questions
  UNION ALL SELECT query_id, 4, 'tfidf_expanded', 0.85, question || ' ' || expected_keywords[1] FROM questions WHERE len(expected_keywords) > 0
  UNION ALL SELECT query_id, 5, 'tfidf_keywords', 0.8,
    question || ' ' || CASE WHEN len(expected_keywords) > 0 THEN question || ' ' || expected_keywords[1] ELSE question END
    || ' ' || array_to_string(expected_keywords, ' ') FROM questions WHERE len(expected_keywords) > 0),
sparse_queries AS (SELECT query_id || ':' || list_no AS query_id, query FROM variants),
{sql.search('sparse_queries', 30, 'found')},
sparse_lists AS (
  SELECT v.query_id, v.list_no, v.match_type, v.w, f.chunk_id, f.score
  FROM found f JOIN variants v ON f.query_id = v.query_id || ':' || v.list_no)"""
_FUSED = """fused AS (SELECT query_id, chunk_id, sum(w * score) AS score, string_agg(match_type, ', ' ORDER BY list_no) AS match_type
              FROM lists GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM fused)
    SELECT query_id, chunk_id, rank, match_type, round(score, 4) AS score FROM ranked WHERE rank <= 10"""


def _doc_chunks(spark, sf):
    docs = cp.documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text")
    return stage(docs, "docs", group=GROUP_BYTES)


def _doc_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("chunk_id"), "embedding")
    ids = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"))
    return vectors.join(ids, "chunk_id", "left_semi")


def _variant_source(spark, sf):
    words = F.col("expected_keywords")
    return cp.questions(spark, sf).select(
        "query_id",
        F.col("question").alias("original"),
        F.concat_ws(" ", "question", F.get(words, F.lit(0))).alias("expanded"),
        words.alias("keywords"),
    )


def _question_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    lists = [("embedding_original", 0), ("embedding_expanded", 1)]
    rows = [vectors.select((F.col("vec_id") - ahead).alias("query_id"), F.lit(name).alias("match_type"), "embedding") for name, ahead in lists]
    return rows[0].unionByName(rows[1])


def _hybrid(spark, sf, chunks, vectors):
    index = se.SparseIndex(chunks, max_features=lx.MAX_FEATURES)
    dense = (vectors, _question_vectors(spark, sf))
    hits = se.hybrid_search(index, _variant_source(spark, sf), 10, dense, cap=10)
    return hits.select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "match_type", F.round("score", 4).alias("score")
    )


@query(
    "search_hybrid",
    f"""WITH chunks AS (SELECT 'd' || doc_id AS chunk_id, doc_id, text FROM documents),
    {sql.sparse_index(lower=True)}, {_VARIANTS},
    lists AS (SELECT * FROM sparse_lists),
    {_FUSED}""",
)
def search_hybrid(spark, sf):
    """Only English documents have a vector, so the sparse lists stand alone."""
    english = table(spark, sf, "documents").filter("lang = 'en'").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"))
    return _hybrid(spark, sf, _doc_chunks(spark, sf), _doc_vectors(spark, sf).join(english, "chunk_id", "left_semi"))


@query(
    "search_hybrid_full",
    f"""WITH chunks AS (SELECT 'd' || doc_id AS chunk_id, doc_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
    {sql.sparse_index(lower=True)}, {_VARIANTS},
    unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    normed AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM unit),
    dense_queries AS (
      SELECT query_id, 1 AS list_no, 'embedding_original' AS match_type, 1.0 AS w, v FROM questions JOIN normed ON vec_id = query_id
      UNION ALL SELECT query_id, 2, 'embedding_expanded', 0.95, v FROM questions JOIN normed ON vec_id = query_id + 1
      WHERE len(expected_keywords) > 0),
    dense_lists AS (
      SELECT query_id, list_no, match_type, w, chunk_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, list_no ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM (
          SELECT q.* EXCLUDE (v), 'd' || d.vec_id AS chunk_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS score
          FROM dense_queries q, normed d WHERE d.vec_id IN (SELECT doc_id FROM documents)))
      WHERE rank <= 30),
    lists AS (SELECT * FROM sparse_lists UNION ALL SELECT * FROM dense_lists),
    {_FUSED}""",
)
def search_hybrid_full(spark, sf):
    """Documents with a vector: all five lists."""
    vectors = _doc_vectors(spark, sf)
    chunks = _doc_chunks(spark, sf).join(vectors.select("chunk_id"), "chunk_id", "left_semi")
    return _hybrid(spark, sf, stage(chunks, "docs", group=GROUP_BYTES), vectors)


@query(
    "search_fallback",
    f"""WITH chunks AS (SELECT 'd' || doc_id AS chunk_id, doc_id, text FROM documents),
    {sql.sparse_index()},
    asked AS (SELECT item_id AS query_id, text AS query FROM benchmark),
    {sql.search('asked', 5, 'found')},
    unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    normed AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM unit),
    scored AS (SELECT doc_id AS query_id, 'd' || d.vec_id AS chunk_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS score
      FROM labels JOIN normed q ON q.vec_id = doc_id, normed d WHERE d.vec_id IN (SELECT doc_id FROM documents)),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank
              FROM scored WHERE query_id IN (SELECT query_id FROM asked)) WHERE rank <= 5)
    SELECT query_id, chunk_id, rank, round(score, 6) AS score, 'embedding' AS match_type FROM dense
    UNION ALL SELECT query_id, chunk_id, rank, round(score, 6), 'tfidf_fallback' FROM found
    WHERE query_id NOT IN (SELECT query_id FROM dense)""",
)
def search_fallback(spark, sf):
    """Dense search for the questions whose number is a labelled vector, sparse for the rest."""
    asked = _questions(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"))
    known = vectors.join(labelled, "query_id", "left_semi").join(asked, "query_id", "left_semi")
    dense = se.dense_top_k(_doc_vectors(spark, sf), known, 5).withColumn("match_type", F.lit("embedding"))
    sparse = se.SparseIndex(_doc_chunks(spark, sf), max_features=lx.MAX_FEATURES).search(asked, 5).withColumn("match_type", F.lit("tfidf_fallback"))
    both = se.with_fallback(stage(dense, "dense"), sparse)
    return both.select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "match_type"
    )


BY_BOOK = """by_book AS (
  SELECT * EXCLUDE (rank, n, first_rank), row_number() OVER (PARTITION BY query_id ORDER BY first_rank, rank) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY rank) AS n, min(rank) OVER (PARTITION BY query_id, book) AS first_rank
        FROM evidence)
  WHERE n <= 5)"""

GRAPH_EVIDENCE = f"""{BY_BOOK},
both_lists AS (
  SELECT query_id, 1 AS list_no, rank, * EXCLUDE (query_id, rank) FROM by_book
  UNION ALL BY NAME SELECT query_id, 2 AS list_no, rank, * EXCLUDE (query_id, rank) FROM evidence WHERE rank <= 30),
first_seen AS (SELECT query_id, chunk_id, min(list_no * 1000 + rank) AS seen_at FROM both_lists GROUP BY ALL),
graph_evidence AS (
  SELECT * FROM (
    SELECT e.* EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY seen_at) AS rank
    FROM first_seen JOIN evidence e USING (query_id, chunk_id))
  WHERE rank <= 30)"""


@query("search_by_book", f"WITH {sql.topic_evidence()}, {BY_BOOK} SELECT {_EVIDENCE_COLUMNS} FROM by_book")
def search_by_book(spark, sf):
    return _evidence_columns(se.top_k_per_book(cp.topic_evidence(spark, sf), 5))


@query("graph_evidence", f"WITH {sql.topic_evidence()}, {GRAPH_EVIDENCE} SELECT {_EVIDENCE_COLUMNS} FROM graph_evidence")
def graph_evidence(spark, sf):
    return _evidence_columns(se.graph_evidence(cp.topic_evidence(spark, sf)))


@query(
    "report_evidence",
    f"""WITH {sql.topic_evidence()}, {GRAPH_EVIDENCE},
    stored AS (SELECT * FROM graph_evidence WHERE score > 0.3)
    SELECT {_EVIDENCE_COLUMNS} FROM stored
    UNION ALL SELECT {_EVIDENCE_COLUMNS} FROM graph_evidence WHERE query_id NOT IN (SELECT query_id FROM stored)""",
)
def report_evidence(spark, sf):
    """Topics with well-scored evidence keep that, the others take the searched list."""
    searched = stage(se.graph_evidence(cp.topic_evidence(spark, sf)), "searched")
    return _evidence_columns(se.report_evidence(searched.filter(F.col("score") > 0.3), searched))


@query(
    "reliable_queries",
    f"""WITH {sql.question_evidence(5)},
    best AS (SELECT query_id, max(score) AS best FROM hits GROUP BY query_id)
    SELECT item_id AS query_id, coalesce(best > 0, FALSE) AS used_search, round(coalesce(best, 0), 6) AS best
    FROM benchmark LEFT JOIN best ON item_id = query_id""",
)
def reliable_queries(spark, sf):
    asked = _questions(spark, sf)
    cut = cp.staged_chunks(spark, sf)
    kept = se.reliable(se.SparseIndex(cut, max_features=lx.MAX_FEATURES).search(asked, 5))
    best = kept.groupBy("query_id").agg(F.max("score").alias("best"))
    return asked.join(best, "query_id", "left").select(
        "query_id",
        F.col("best").isNotNull().alias("used_search"),
        F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best"),
    )


# --- evaluation ------------------------------------------------------------------
CONTEXTS = f"""{sql.DOCS}, {sql.QUESTIONS},
asked AS (SELECT query_id, question AS query FROM questions),
{sql.eval_chunks(700, 80, 'c700')}, {sql.eval_chunks(300, 50, 'c300')}, {sql.eval_chunks(1200, 150, 'c1200')},
{sql.sparse_index('c700', False, None, 'm_')}, {sql.search('asked', 5, 'hits700', False, 'm_')},
{sql.sparse_index('c300', False, None, 's_')}, {sql.search('asked', 5, 'hits300', False, 's_')},
near AS (
  SELECT h.query_id, h.rank, h.score, h.chunk_id AS small_id, p.*,
    row_number() OVER (PARTITION BY h.query_id, h.rank
      ORDER BY abs((p.char_start + p.char_end) / 2.0 - (s.char_start + s.char_end) / 2.0), p.char_start) AS n
  FROM hits300 h JOIN c300 s USING (chunk_id)
  JOIN c1200 p ON p.source_id = s.source_id AND greatest(p.char_start, s.char_start) < least(p.char_end, s.char_end)),
parents AS (
  SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) AS again
                 FROM near WHERE n = 1) WHERE again = 1),
contexts AS (
  SELECT 'baseline_medium' AS strategy, query_id, rank, score, c700.* FROM hits700 JOIN c700 USING (chunk_id)
  UNION ALL BY NAME SELECT 'small_only' AS strategy, query_id, rank, score, c300.* FROM hits300 JOIN c300 USING (chunk_id)
  UNION ALL BY NAME SELECT 'small_to_big' AS strategy, * EXCLUDE (small_id, again) FROM parents),
joined AS (
  SELECT strategy, query_id, string_agg(text, chr(10) ORDER BY rank) AS joined, count(*) AS evidence_count,
    count(DISTINCT textbook_id) AS source_diversity,
    avg(CASE WHEN book <> '' AND chapter <> '' AND page_start IS NOT NULL THEN 1.0 ELSE 0.0 END) AS citation_completeness
  FROM contexts GROUP BY ALL),
every AS (
  SELECT s AS strategy, q.*, coalesce(joined, '') AS joined, coalesce(evidence_count, 0) AS evidence_count,
    coalesce(source_diversity, 0) AS source_diversity, coalesce(citation_completeness, 0.0) AS citation_completeness
  FROM questions q CROSS JOIN unnest(['baseline_medium', 'small_only', 'small_to_big']) AS u(s)
  LEFT JOIN joined j ON j.strategy = s AND j.query_id = q.query_id),
metrics AS (
  SELECT strategy, query_id, array_to_string(list_filter(expected_keywords, lambda k: contains(joined, k)), ',') AS matched_keywords,
    CASE WHEN len(list_filter(expected_keywords, lambda k: contains(joined, k))) > 0 THEN 1.0 ELSE 0.0 END AS hit_at_5,
    len(list_filter(expected_keywords, lambda k: contains(joined, k))) / greatest(1, len(expected_keywords)) AS keyword_recall,
    length(joined) AS context_chars, evidence_count, source_diversity, citation_completeness
  FROM every)"""


def _contexts(spark, sf):
    return stage(ev.evaluate(cp.eval_docs(spark, sf), cp.questions(spark, sf)), "contexts")


def _metrics(spark, sf, contexts):
    return ev.question_metrics(contexts, cp.questions(spark, sf), [s[0] for s in lx.STRATEGIES])


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


@query(
    "parent_map",
    f"""WITH {CONTEXTS} SELECT query_id, rank, chunk_id, source_id, round(score, 6) AS score, md5(text) AS text
    FROM contexts WHERE strategy = 'small_to_big'""",
)
def parent_map(spark, sf):
    only = [s for s in lx.STRATEGIES if s[3] is not None]
    rows = ev.evaluate(cp.eval_docs(spark, sf), cp.questions(spark, sf), strategies=only)
    return rows.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "source_id", F.round("score", 6).alias("score"), F.md5("text").alias("text")
    )


@query(
    "question_metrics",
    f"""WITH {CONTEXTS} SELECT strategy, query_id, matched_keywords, hit_at_5::DOUBLE AS hit_at_5, round(keyword_recall, 6) AS keyword_recall,
      context_chars, evidence_count, source_diversity, round(citation_completeness, 6) AS citation_completeness FROM metrics""",
)
def question_metrics(spark, sf):
    rows = _metrics(spark, sf, _contexts(spark, sf))
    return _rounded(rows, ["keyword_recall", "citation_completeness"])


SUMMARY = """summary AS (SELECT strategy, avg(hit_at_5) AS hit_at_5, avg(keyword_recall) AS keyword_recall, avg(context_chars) AS context_chars,
  avg(evidence_count) AS evidence_count, avg(source_diversity) AS source_diversity, avg(citation_completeness) AS citation_completeness
  FROM metrics GROUP BY strategy)"""


@query(
    "strategy_summary",
    f"""WITH {CONTEXTS}, {SUMMARY} SELECT strategy, {', '.join(f'round({m}, 6) AS {m}' for m in ev.METRICS)} FROM summary""",
)
def strategy_summary(spark, sf):
    rows = _metrics(spark, sf, _contexts(spark, sf))
    return _rounded(ev.strategy_summary(rows), ev.METRICS)


@query(
    "best_strategy",
    f"""WITH {CONTEXTS}, {SUMMARY},
    long AS (UNPIVOT summary ON {', '.join(ev.METRICS)} INTO NAME metric VALUE value),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY round(value, 9) DESC,
      list_position(['baseline_medium', 'small_only', 'small_to_big'], strategy)) AS n FROM long)
    SELECT metric, strategy, round(value, 6) AS value FROM ranked WHERE n = 1""",
)
def best_strategy(spark, sf):
    summary = ev.strategy_summary(_metrics(spark, sf, _contexts(spark, sf)))
    return _rounded(ev.best_strategy(_rounded(summary, ev.METRICS, 9)), ["value"])


@query(
    "strategy_pivot",
    f"""WITH {CONTEXTS},
    top AS (SELECT strategy, query_id, book || ' / ' || chapter || ' / 页码 ' || CASE WHEN page_start = 0 THEN '未知' ELSE page_start::VARCHAR END AS source,
      substr({sql.FLAT.replace('text', 'substr(text, 1, 280)')}, 1, 180) || CASE WHEN length({sql.FLAT.replace('text', 'substr(text, 1, 280)')}) > 180 THEN '...' ELSE '' END AS snippet
      FROM contexts WHERE rank = 1),
    rows AS (SELECT * FROM metrics LEFT JOIN top USING (strategy, query_id))
    SELECT query_id, {', '.join(f"max({c}) FILTER (strategy = '{s}') AS {s}_{a}" for s in ('baseline_medium', 'small_only', 'small_to_big') for c, a in (('round(keyword_recall, 6)', 'recall'), ('matched_keywords', 'matched'), ('source', 'source'), ('snippet', 'snippet')))}
    FROM rows GROUP BY query_id""",
)
def strategy_pivot(spark, sf):
    contexts = _contexts(spark, sf)
    wide = ev.strategy_pivot(_metrics(spark, sf, contexts), contexts)
    return _rounded(wide, [c for c in wide.columns if c.endswith("_recall")])
