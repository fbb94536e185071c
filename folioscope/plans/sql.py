"""Building blocks of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
NORMALISED = r"trim(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"

# documents as chapters of books, whitespace flattened
DOCS = f"""docs AS (
  SELECT * FROM (
    SELECT doc_id, source || ':d' || doc_id AS source_id, source AS textbook_id, 'Book ' || source AS book,
           'Doc ' || doc_id AS chapter, 'd' || doc_id AS chapter_id, doc_id AS page_start, doc_id AS page_end,
           {FLAT} AS text
    FROM documents)
  WHERE length(text) >= 20)"""

QUESTIONS = """long_words AS (
  SELECT item_id, text, regexp_extract_all(lower(text), '[a-z]{5,}') AS words FROM benchmark),
questions AS (
  SELECT item_id AS query_id, text AS question,
         list_filter(words, lambda w, i: list_position(words, w) = i)[1:3] AS expected_keywords
  FROM long_words)"""

TOPICS = """topics AS (
  SELECT DISTINCT regexp_extract(lower(text), '[a-z]{5,}') AS topic
  FROM benchmark WHERE regexp_matches(lower(text), '[a-z]{5,}'))"""


def eval_chunks(size: int, overlap: int, name: str = "chunks", docs: str = "docs") -> str:
    step = size - overlap
    return f"""{name} AS (
  SELECT * FROM (
    SELECT substr(sha1(concat_ws('::', source_id, i * {step}, least(length(text), i * {step} + {size}), {size}, {overlap})), 1, 16) AS chunk_id,
           source_id, textbook_id, book, chapter, chapter_id, page_start, page_end,
           {size} AS size, {overlap} AS overlap,
           (i * {step})::INTEGER AS char_start, least(length(text), i * {step} + {size})::INTEGER AS char_end,
           substr(text, i * {step} + 1, {size}) AS text
    FROM {docs}, unnest(range(0, CASE WHEN length(text) <= {size} THEN 1
                                 ELSE ceil((length(text) - {size}) / {step})::BIGINT + 1 END)) AS r(i))
  WHERE length(trim(text)) >= 10)"""


def chapter_chunks(size: int = 700, overlap: int = 80, name: str = "chunks", source: str = "documents") -> str:
    step = size - overlap
    return f"""{name} AS (
  SELECT textbook_id || '_' || chapter_id || '_c' || row_number() OVER (PARTITION BY chapter_id ORDER BY i) AS chunk_id,
         textbook_id, book, source_file, chapter, chapter_id, page_start, page_end, text
  FROM (
    SELECT source AS textbook_id, 'd' || doc_id AS chapter_id, 'Book ' || source AS book, source || '.txt' AS source_file,
           'Doc ' || doc_id AS chapter, doc_id AS page_start, doc_id AS page_end, i,
           trim(substr(body, i * {step} + 1, {size}), ' ' || chr(10)) AS text
    FROM (SELECT *, {NORMALISED} AS body FROM {source}),
         unnest(range(0, CASE WHEN length(body) <= {size} THEN 1
                         ELSE ceil((length(body) - {size}) / {step})::BIGINT + 1 END)) AS r(i))
  WHERE text <> '')"""


def counts(source: str, key: str, text: str, name: str, lower: bool = True) -> str:
    body = f"lower({text})" if lower else text
    return f"""{name} AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, substr(' ' || w || ' ', i, n) AS term
    FROM (SELECT {key}, unnest(string_split(trim(regexp_replace({body}, '\\s+', ' ', 'g')), ' ')) AS w FROM {source}),
         unnest([2, 3, 4]) AS a(n), unnest(range(1, length(w) + 4 - n)) AS b(i)
    WHERE w <> '')
  GROUP BY ALL)"""


def sparse_index(source: str = "chunks", lower: bool = True, cap: int | None = 200000, p: str = "") -> str:
    limit = f"ORDER BY cf DESC, term LIMIT {cap}" if cap else ""
    return f"""{counts(source, 'chunk_id', 'text', p + 'tf', lower)},
{p}n AS (SELECT count(*) AS n FROM {source}),
{p}vocab AS (
  SELECT term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM {p}tf GROUP BY term {limit}), {p}n),
{p}weights AS (
  SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight
  FROM (SELECT chunk_id, term, tf * idf AS w FROM {p}tf JOIN {p}vocab USING (term)))"""


def search(queries: str, k: int, name: str = "hits", lower: bool = True, p: str = "") -> str:
    """queries(query_id, query) over the index with prefix `p`."""
    return f"""{counts(queries, 'query_id', 'query', name + '_qtf', lower)},
{name}_qw AS (
  SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight
  FROM (SELECT query_id, term, tf * idf AS w FROM {name}_qtf JOIN {p}vocab USING (term))),
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank
    FROM (SELECT q.query_id, d.chunk_id, sum(q.weight * d.weight) AS score
          FROM {name}_qw q JOIN {p}weights d USING (term) GROUP BY 1, 2))
  WHERE rank <= {k})"""


EVIDENCE = """evidence AS (
  SELECT h.query_id, h.rank, 'ev_' || h.chunk_id AS evidence_id, h.chunk_id, c.book, c.source_file, c.chapter,
         c.page_start AS page, substr(c.text, 1, 260) AS quote, c.text, h.score
  FROM hits h JOIN chunks c USING (chunk_id))"""


def question_evidence(k: int) -> str:
    return ",\n".join(
        [
            chapter_chunks(),
            sparse_index(),
            "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)",
            search("asked", k),
            EVIDENCE,
        ]
    )


def topic_evidence(k: int = 50) -> str:
    return ",\n".join(
        [
            chapter_chunks(),
            sparse_index(),
            TOPICS,
            "asked AS (SELECT topic AS query_id, topic AS query FROM topics)",
            search("asked", k),
            EVIDENCE,
        ]
    )
