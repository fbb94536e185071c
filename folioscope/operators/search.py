"""Batch retrieval: top-k, fusion, evidence lists.

A table of queries is answered in one pass over the chunk vectors.  Each task scores its
own chunks against the broadcast queries and keeps k rows per query, so what is shuffled
is k rows per query and batch, never (query, chunk) pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx
from folioscope.operators import index as ix
from folioscope.operators.index import Weigher
from folioscope.session import MAX_BROADCAST_TERMS, broadcast_if_small, fits, stage, stage_all

QUERY_BLOCK = 256
MAX_CELLS = 1 << 24
SPARSE = 16  # a term of at least one in so many queries of a table counts as frequent there
ROOM = 4  # rows that a task holds per query, as a multiple of k, before it cuts them to k


def clamp(k: int, high: int | None = None) -> int:
    """At least one; at most `high` where the caller wants a limit."""
    return max(1, int(k) if high is None else min(int(k), high))


def _batch_best(scores: np.ndarray, k: int, positive: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best rounded scores in each column, only above zero if `positive`.

    Rows come in chunk_id order, so equal scores are cut exactly as the final ranking does.
    """
    rounded = np.round(scores, 6)
    kept = min(k, len(rounded))
    floor = np.partition(rounded, len(rounded) - kept, axis=0)[len(rounded) - kept]
    above = rounded > floor
    level = rounded == floor
    room = kept - above.sum(axis=0)
    chosen = above | (level & (np.cumsum(level, axis=0) <= room))
    return np.nonzero(chosen & (scores > 0) if positive else chosen)


class _Running:
    """The k best rows per query that a task has seen so far, in the order of the final ranking."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, ROOM * k * max(1, queries)
        self.held: list[pa.Table] = []
        self.rows = 0
        self.floor = np.full(max(1, queries), -np.inf)  # k-th best at the last cut; what is below cannot be kept

    def add(self, query: np.ndarray, chunk_ids: pa.Array, scores: np.ndarray) -> None:
        rounded = np.round(scores, 6)
        if (rounded < self.floor[query]).any():
            good = rounded >= self.floor[query]
            query, scores, rounded = query[good], scores[good], rounded[good]
            chunk_ids = chunk_ids.filter(pa.array(good))
        if not len(query):
            return
        columns = [pa.array(query), chunk_ids, pa.array(scores), pa.array(rounded)]
        self.held.append(pa.table(columns, names=["query", "chunk_id", "score", "rounded"]))
        self.rows += len(query)
        if self.rows > self.limit:
            self.cut()

    def cut(self) -> None:
        if not self.held:
            return
        whole = pa.concat_tables(self.held).sort_by(
            [("query", "ascending"), ("rounded", "descending"), ("chunk_id", "ascending")]
        )
        query = whole.column("query").to_numpy()
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        last = place == self.k - 1
        self.floor[query[last]] = whole.column("rounded").to_numpy()[last]
        whole = whole.filter(pa.array(place < self.k))
        self.held, self.rows = [whole], whole.num_rows

    def batches(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        self.cut()
        for whole in self.held:
            ids = query_ids.take(whole.column("query").combine_chunks())
            table = pa.table([ids, whole.column("chunk_id"), whole.column("score")], names=["query_id", "chunk_id", "score"])
            yield from table.combine_chunks().to_batches()


def rank_hits(hits: DataFrame, k: int | None, key: str = "chunk_id") -> DataFrame:
    """Rank per query by rounded score, then key; keep k (all when k is None)."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), F.asc(key))
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _passes(queries: DataFrame, width: str) -> Iterator[list[DataFrame]]:
    """Blocks of queries, in groups that share one pass over the corpus.

    `width` is the array that spans the table's other side; a block of q queries with at
    most w entries each has at most q * w rows and q columns, and no more rows than there are terms
    in all queries.  The tables of a pass have at most MAX_CELLS cells, so what is broadcast stays
    bounded.  The queries are staged first: a block must see the same rows on every read.
    """
    queries = stage(queries, "queries")
    total, widest = queries.agg(F.count("*"), F.max(F.size(width))).first()
    if not total:
        yield [queries]
        return
    widest = max(1, widest)
    block = max(1, min(QUERY_BLOCK, math.isqrt(MAX_CELLS // widest)))
    cells = block * block * widest
    if width == "terms":  # queries on one subject share most of them
        known = max(1, queries.select(F.explode(width)).distinct().count())
        block = max(block, min(QUERY_BLOCK, MAX_CELLS // known))
        cells = block * min(block * widest, known)
    if total <= block:
        yield [queries]
        return
    parts = -(-total // max(1, block * 3 // 4))
    part_of = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    blocks = [queries.filter(part_of == part) for part in range(parts)]
    together = max(1, MAX_CELLS // cells)
    for at in range(0, parts, together):
        yield blocks[at : at + together]


class Scorer:
    """Scores of sparse rows against one query table.

    Terms that many queries have meet them in a matrix product, the others in their own few cells.
    """

    def __init__(self, table: np.ndarray):
        filled = table != 0
        many = filled.sum(axis=1) * SPARSE >= table.shape[1]
        self.queries = table.shape[1]
        self.hot = np.where(many, np.cumsum(many) - 1, -1)
        self.table = table[many]
        term, self.column = np.nonzero(filled & ~many[:, None])
        self.value = table[term, self.column]
        self.ends = np.searchsorted(term, np.arange(len(table) + 1))

    def scores(self, rows: int, row: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Score matrix of `rows` rows with (row, term of the table, weight)."""
        place = self.hot[at]
        many = place >= 0
        dense = np.zeros((rows, len(self.table)))
        dense[row[many], place[many]] = weights[many]
        scores = dense @ self.table
        row, at, weights = row[~many], at[~many], weights[~many]
        sizes = self.ends[at + 1] - self.ends[at]
        cell = np.repeat(self.ends[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        target = np.repeat(row * self.queries, sizes) + self.column[cell]
        added = np.bincount(target, np.repeat(weights, sizes) * self.value[cell], rows * self.queries)
        return scores + added.reshape(rows, self.queries)


def _query_table(block: DataFrame) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(query ids, query terms, term x query weights) of one bounded block."""
    rows = block.select("query_id", "terms", "weights").toArrow()
    terms = pa.array(sorted(set(pc.list_flatten(rows.column("terms")).to_pylist())), pa.string())
    table = np.zeros((len(terms), max(1, rows.num_rows)))
    for column, (words, weights) in enumerate(zip(rows.column("terms"), rows.column("weights"))):
        if len(words):
            table[pc.index_in(words.values, value_set=terms).to_numpy(), column] = weights.values.to_numpy()
    return rows.column("query_id").combine_chunks(), terms, table


def _one_pass(chunks: DataFrame, tables: list[tuple], score_batch, k: int, kind: str, positive: bool) -> DataFrame:
    """Score every batch against all query tables; a task puts out k rows per query at its end.

    `score_batch(tables)` gives a function of a batch that yields a score matrix, or none, per table, made
    once per task.  Batches are cut into slices, so what is held does not grow with them.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Running(len(ids), k) for ids, *_ in shared.value]
        scored = score_batch(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.sort_indices(batch.column(0)))
            for part in _slices(batch):
                for (ids, *_), running, scores in zip(shared.value, best, scored(part)):
                    if scores is not None and len(ids):
                        row, column = _batch_best(scores, k, positive)
                        running.add(column, part.column(0).take(pa.array(row)), scores[row, column])
        for (ids, *_), running in zip(shared.value, best):
            yield from running.batches(ids)

    return chunks.mapInArrow(run, f"query_id {kind}, chunk_id string, score double")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of few rows, texts also of few characters."""
    if pa.types.is_string(batch.schema.field(1).type):
        parts = ix.text_slices(batch.column(1).to_pylist())
    else:
        parts = (slice(at, min(at + ix.SLICE_ROWS, batch.num_rows)) for at in range(0, batch.num_rows, ix.SLICE_ROWS))
    for part in parts:
        yield batch.slice(part.start, part.stop - part.start)


def sparse_top_k(vectors: DataFrame, query_vectors: DataFrame, k: int, vocab: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine over stored vectors.

    Scores of zero are no hits.  Vectors (chunk_id, counts) are weighed with their `numbered` vocabulary.
    """
    kind = query_vectors.schema["query_id"].dataType.simpleString()
    packed = "counts" in vectors.columns
    words = ix.share_vocabulary(vocab) if packed else None

    def score_batch(tables):
        scorers = [Scorer(table) for *_, table in tables]
        places = _places(words.value.terms, tables) if packed else []

        def scored(batch):
            if packed:
                at, tfs, row = ix.unpack(batch.column(1).to_pylist())
                yield from _scores(batch.num_rows, row, at, words.value.weights(at, tfs, row, batch.num_rows), tables, places, scorers)
                return
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            terms, weights = batch.column(1).flatten(), batch.column(2).flatten().to_numpy()
            for (_, known, _), scorer in zip(tables, scorers):
                if not len(known):
                    yield None
                    continue
                at = pc.index_in(terms, value_set=known)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                yield scorer.scores(batch.num_rows, row[hit], at.drop_null().to_numpy(), weights[hit])

        return scored

    stored = vectors.select("chunk_id", *(("counts",) if packed else ("terms", "weights")))
    parts = [
        _one_pass(stored, [_query_table(block) for block in blocks], score_batch, k, kind, True)
        for blocks in _passes(query_vectors, "terms")
    ]
    return rank_hits(stage_all(parts, "hits"), k)


def _places(names: pa.Array, tables: list[tuple]) -> list[np.ndarray]:
    """Per query table, the place in it of each term of the vocabulary, else -1."""
    places = []
    for _, known, _ in tables:
        asked = np.full(len(names), -1)
        asked[pc.index_in(known, value_set=names).to_numpy()] = np.arange(len(known))
        places.append(asked)
    return places


def _scores(rows: int, row: np.ndarray, at: np.ndarray, weights: np.ndarray, tables, places, scorers) -> Iterator[np.ndarray | None]:
    """Score matrix per query table of rows with the vocabulary's terms `at`."""
    for (_, known, _), asked, scorer in zip(tables, places, scorers):
        own = asked[at]
        hit = own >= 0
        yield scorer.scores(rows, row[hit], own[hit], weights[hit]) if len(known) else None


def text_top_k(chunks: DataFrame, vocab: DataFrame, query_vectors: DataFrame, k: int, lower: bool = True) -> DataFrame:
    """As `sparse_top_k`, weighing the chunk texts in the same pass.

    For one batch of queries this beats storing the vectors, which are an order of
    magnitude larger than the text.  A text is cut into terms once, however many blocks of queries
    there are.  The vocabulary must be within the broadcast bound.
    """
    kind = query_vectors.schema["query_id"].dataType.simpleString()
    words = ix.share_vocabulary(vocab)

    def score_batch(tables):
        weigher = Weigher(words.value, lower)
        scorers, places = [Scorer(table) for *_, table in tables], _places(words.value.terms, tables)

        def scored(batch):
            at, weights, row = weigher.rows(batch.column(1).to_pylist())
            yield from _scores(batch.num_rows, row, at, weights, tables, places, scorers)

        return scored

    texts = chunks.select("chunk_id", "text")
    parts = [
        _one_pass(texts, [_query_table(block) for block in blocks], score_batch, k, kind, True)
        for blocks in _passes(query_vectors, "terms")
    ]
    return rank_hits(stage_all(parts, "hits"), k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k of query vectors over chunk vectors.

    `vectors(chunk_id, embedding)` and `queries(query_id, embedding)`.  One matrix product
    per Arrow batch and block; no cross join.  Scores of zero and below are hits like others.  Vectors
    whose length no query has cannot be compared; `vectors.comparison_errors` lists them.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    unit = vectors.select("chunk_id", ix.l2_normalise(F.col("embedding")).alias("embedding"))
    asked = queries.select("query_id", ix.l2_normalise(F.col("embedding")).alias("embedding"))

    def score_batch(tables):
        def scored(batch):
            values, offsets = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            matrix = values.reshape(batch.num_rows, -1) if offsets[-1] > offsets[0] else None
            for _, table in tables:
                yield matrix @ table if matrix is not None and matrix.shape[1] == len(table) else None

        return scored

    sizes = [r[0] for r in asked.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect()]
    parts = []
    for size in sizes:
        fitting = unit.filter(F.size("embedding") == size)
        for blocks in _passes(asked.filter(F.size("embedding") == size), "embedding"):
            tables = []
            for block in blocks:
                rows = block.toArrow()
                matrix = np.array(rows.column("embedding").to_pylist(), dtype=np.float64).reshape(rows.num_rows, -1)
                tables.append((rows.column("query_id").combine_chunks(), matrix.T))
            parts.append(_one_pass(fitting, tables, score_batch, k, kind, False))
    if not parts:
        parts = [unit.sparkSession.createDataFrame([], f"query_id {kind}, chunk_id string, score double")]
    return rank_hits(stage_all(parts, "hits"), k)


def query_vectors(queries: DataFrame, vocab: DataFrame, lower: bool = True) -> DataFrame:
    """TF-IDF vectors of query texts over the index vocabulary; blank queries vanish."""
    asked = queries.filter(F.length(tx.strip(F.col("query"))) > 0)
    return ix.tfidf_vectors(asked, vocab, "query_id", "query", lower)


class SparseIndex:
    """Vocabulary of a chunk table, and searches over it.

    `max_features` keeps the most frequent terms only; rare terms are the selective ones, so by default all stay.
    """

    def __init__(self, chunks: DataFrame, lower: bool = True, max_features: int | None = None):
        self.chunks, self.lower = chunks, lower
        self.n_chunks = chunks.count()
        self.vocab = stage(ix.vocabulary(chunks, self.n_chunks, max_features, lower), "vocab")

    def search(self, queries: DataFrame, k: int, high: int | None = None) -> DataFrame:
        """Top-k per row of queries(query_id, query); `high` limits k where the caller asks for it."""
        asked = query_vectors(queries, self.vocab, self.lower)
        if fits(self.vocab, MAX_BROADCAST_TERMS):
            return text_top_k(self.chunks, self.vocab, asked, clamp(k, high), self.lower)
        vectors = stage(ix.tfidf_vectors(self.chunks, self.vocab, lower=self.lower), "vectors")
        return sparse_top_k(vectors, asked, clamp(k, high))


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk columns of the hits.  Hits are k per query, so they are the small side."""
    hits = stage(hits, "hits")
    return chunks.join(broadcast_if_small(hits), "chunk_id")


def query_variants(queries: DataFrame) -> DataFrame:
    """One row per query and sparse or dense list that is to be searched.

    From queries(query_id, original, expanded, keywords).  Expanded lists are left out when
    the expanded query adds nothing, the keyword list when there are no keywords.
    """
    original, words = F.col("original"), F.array_join("keywords", " ")
    expanded = F.when(F.length("expanded") > 0, F.col("expanded")).otherwise(original)
    has_more = (tx.strip(expanded) != "") & (tx.strip(expanded) != tx.strip(original))
    has_words = F.length(tx.strip(words)) > 0
    parts = F.filter(F.array(original, expanded, words), lambda p: F.length(tx.strip(p)) > 0)
    full = F.array_join(parts, " ")
    lists = [
        (1, "embedding_original", original, F.lit(True)),
        (2, "embedding_expanded", expanded, has_more),
        (3, "tfidf_original", original, F.lit(True)),
        (4, "tfidf_expanded", expanded, has_more),
        (5, "tfidf_keywords", full, has_words),
    ]
    rows = F.array(
        *[
            F.when(
                wanted,
                F.struct(F.lit(no).alias("list_no"), F.lit(name).alias("match_type"), query.alias("query")),
            )
            for no, name, query, wanted in lists
        ]
    )
    return queries.select("query_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("_r")).select(
        "query_id", "_r.list_no", "_r.match_type", "_r.query"
    )


def weight_of(match_type: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in lx.LIST_WEIGHTS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, match_type), F.lit(lx.OTHER_LIST_WEIGHT))


def fuse(candidates: DataFrame, k: int, cap: int | None = None) -> DataFrame:
    """Weighted sum over candidate lists, match types in list order, top k.

    candidates(query_id, chunk_id, score, match_type, list_no).  `cap=10` limits k.
    """
    merged = candidates.groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("score") * weight_of(F.col("match_type"))).alias("score"),
        F.array_sort(F.collect_set(F.struct("list_no", "match_type"))).alias("_types"),
    )
    named = merged.withColumn("match_type", F.array_join(F.col("_types.match_type"), ", ")).drop("_types")
    return rank_hits(named, clamp(k, cap))


def hybrid_search(
    sparse: SparseIndex,
    queries: DataFrame,
    k: int,
    dense: tuple[DataFrame, DataFrame] | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Candidate lists of max(3k, 10) rows each, fused.

    `dense` is (chunk vectors, query vectors keyed by query_id and match_type).  It is used only if
    there is a vector for every chunk (X5); else the sparse lists stand alone, and
    `index.dense_gate` has the warning.
    """
    if dense is not None and not ix.dense_gate(sparse.chunks, dense[0]).first().has_embedding:
        dense = None
    wanted = max(3 * k, 10)
    variants = query_variants(queries)
    texts = variants.filter(F.col("match_type").startswith("tfidf")).select(
        F.struct("query_id", "match_type", "list_no").alias("_v"), "query"
    )
    # one search answers all sparse lists: the list is part of the query key
    keyed = texts.select(F.to_json("_v").alias("query_id"), "query")
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"struct<query_id:{kind},match_type:string,list_no:int>"

    def unkey(hits: DataFrame) -> DataFrame:
        return hits.select(F.from_json("query_id", schema).alias("_v"), "chunk_id", "score").select(
            "_v.query_id", "_v.match_type", "_v.list_no", "chunk_id", "score"
        )

    lists = unkey(sparse.search(keyed, wanted))
    if dense is not None:
        chunk_vectors, vectors = dense
        asked = variants.filter(F.col("match_type").startswith("embedding")).join(vectors, ["query_id", "match_type"])
        asked = asked.select(
            F.to_json(F.struct("query_id", "match_type", "list_no")).alias("query_id"), "embedding"
        )
        lists = lists.unionByName(unkey(dense_top_k(chunk_vectors, asked, clamp(wanted))))
    return fuse(lists, k, cap)


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of `first`; queries it has no row for take those of `second`."""
    missing = second.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.unionByName(missing, allowMissingColumns=True)


def to_evidence(hits: DataFrame, chunks: DataFrame, quote: int = 260) -> DataFrame:
    """Evidence rows with defaults for what a chunk lacks.

    `evidence_id` follows the chunk, so ids of two searches never clash; `label` is the
    positional display name.
    """
    rows = with_chunks(hits, chunks)
    have = set(rows.columns)

    def column(name: str, default: Column) -> Column:
        return F.col(name) if name in have else default

    page = [F.col(c).cast("long") for c in ("page", "page_start") if c in have]
    source = column("source_file", F.lit(""))
    return rows.select(
        "query_id",
        "rank",
        F.concat(F.lit("ev_"), F.col("chunk_id")).alias("evidence_id"),
        F.format_string("ev_%03d", "rank").alias("label"),
        F.coalesce(F.when(F.length(column("book", F.lit(""))) > 0, column("book", F.lit(""))), tx.book_title(source)).alias("book"),
        source.alias("source_file"),
        tx.or_default(column("chapter", F.lit("")), lx.UNKNOWN_CHAPTER).alias("chapter"),
        F.coalesce(column("section", F.lit("")), F.lit("")).alias("section"),
        F.coalesce(*page, F.lit(0).cast("long")).alias("page"),
        F.substring("text", 1, quote).alias("quote"),
        "text",
        "chunk_id",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(column("match_type", F.lit("tfidf")), F.lit("tfidf")).alias("match_type"),
    )


def top_k_per_book(evidence: DataFrame, per_book: int) -> DataFrame:
    """First k rows of every book, books in order of first appearance, renumbered.

    `evidence` is the over-fetched list: max(10k, 30) rows per query.
    """
    by_book = W.partitionBy("query_id", "book")
    kept = (
        evidence.withColumns(
            {
                "_n": F.row_number().over(by_book.orderBy("rank")),
                "_first": F.min("rank").over(by_book),
            }
        )
        .filter(F.col("_n") <= per_book)
        .withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_first", "rank")))
    )
    return kept.drop("_n", "_first").withColumn("label", F.format_string("ev_%03d", "rank"))


def graph_evidence(evidence: DataFrame, per_book: int = 5, global_k: int = 30) -> DataFrame:
    """Per-book list followed by the global list, one row per chunk.

    A chunk keeps the position of its first mention and the values of its last.
    """
    first = top_k_per_book(evidence.filter(F.col("rank") <= max(10 * per_book, 30)), per_book)
    second = evidence.filter(F.col("rank") <= global_k)
    both = first.withColumn("_list", F.lit(1)).unionByName(second.withColumn("_list", F.lit(2)))
    values = [c for c in evidence.columns if c not in ("query_id", "rank", "label")]
    key = F.when(F.length("chunk_id") > 0, F.col("chunk_id")).otherwise(
        F.concat_ws(":", "source_file", "page", F.substring("quote", 1, 20))
    )
    order = F.struct("_list", "rank")
    merged = (
        both.withColumn("_key", key)
        .groupBy("query_id", "_key")
        .agg(F.min(order).alias("_at"), F.max_by(F.struct(*values), order).alias("_v"))
        .withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_at")))
        .filter(F.col("rank") <= global_k)
    )
    return merged.select("query_id", "rank", F.format_string("ev_%03d", "rank").alias("label"), "_v.*")


def node_queries(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """Query text `topic name` for every graph node."""
    return nodes.join(topics, "graph_id").select(
        F.concat_ws("::", F.col("graph_id"), F.col("node_id")).alias("query_id"),
        F.concat_ws(" ", "topic", "name").alias("query"),
    )


def report_evidence(stored: DataFrame, searched: DataFrame) -> DataFrame:
    """Stored evidence of a topic when there is any, else the searched list."""
    return with_fallback(stored, searched)


def reliable(hits: DataFrame) -> DataFrame:
    """Rows of queries whose best score is above zero."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return hits.withColumn("_best", best).filter(F.col("_best") > 0).drop("_best")
