"""Parent mapping and retrieval evaluation."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import text as tx
from folioscope.operators import chunk as ck
from folioscope.operators import search as se
from folioscope.session import broadcast_if_small, stage

METRICS = [
    "hit_at_5",
    "keyword_recall",
    "context_chars",
    "evidence_count",
    "source_diversity",
    "citation_completeness",
]
CONTEXT = ["chunk_id", "text", "textbook_id", "book", "chapter", "chapter_id", "page_start", "page_end", "source_id"]


def map_to_parent(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent of each hit.

    Among parents of the same source whose range overlaps the hit, the one with the
    nearest midpoint, the earlier on ties; else the first parent of the chapter; else the
    hit itself.  hits(query_id, rank, score, chunk columns); one row per hit comes back.
    """
    hit_key = ["query_id", "rank"]
    small = stage(hits, "small")
    found = small.select(
        *hit_key,
        "score",
        F.col("chunk_id").alias("matched_small_chunk_id"),
        F.col("source_id").alias("_source"),
        F.col("char_start").alias("_start"),
        F.col("char_end").alias("_end"),
    )
    overlap = (
        (F.col("source_id") == F.col("_source"))
        & (F.greatest("char_start", "_start") < F.least("char_end", "_end"))
    )
    near = parents.join(broadcast_if_small(found), overlap)
    gap = F.abs(F.col("char_start") + F.col("char_end") - F.col("_start") - F.col("_end"))
    best = near.groupBy(*hit_key).agg(
        F.min_by(
            F.struct("score", "matched_small_chunk_id", *CONTEXT), F.struct(gap.alias("g"), F.col("char_start"))
        ).alias("_p")
    )
    direct = best.select(*hit_key, "_p.*")
    lost = small.join(direct.select(*hit_key), hit_key, "left_anti")
    chapter = ["textbook_id", "chapter_id"]
    first = parents.join(broadcast_if_small(lost.select(*chapter).distinct()), chapter, "left_semi").groupBy(*chapter).agg(
        F.min_by(F.struct(*CONTEXT), F.struct("source_id", "char_start")).alias("_p")
    )
    second = lost.select(*hit_key, "score", F.col("chunk_id").alias("matched_small_chunk_id"), *chapter).join(first, chapter)
    by_chapter = second.select(*hit_key, "score", "matched_small_chunk_id", "_p.*")
    itself = lost.join(by_chapter.select(*hit_key), hit_key, "left_anti").select(
        *hit_key, "score", F.col("chunk_id").alias("matched_small_chunk_id"), *CONTEXT
    )
    return direct.unionByName(by_chapter).unionByName(itself)


def first_parents(mapped: DataFrame) -> DataFrame:
    """Keep each parent once per query, at its best hit."""
    order = W.partitionBy("query_id", "chunk_id").orderBy("rank")
    return mapped.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")


def question_metrics(contexts: DataFrame, questions: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Metrics per (strategy, question); questions without context count as zero.

    contexts(strategy, query_id, rank, CONTEXT...), questions(query_id, expected_keywords).
    """
    complete = tx.citation_complete(F.col("book"), F.col("chapter"), F.col("page_start"), F.col("page_end"))
    grouped = contexts.groupBy("strategy", "query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"]), "\n"
        ).alias("joined"),
        F.count("*").alias("evidence_count"),
        F.count_distinct(F.coalesce("textbook_id", "book")).alias("source_diversity"),
        F.avg(complete.cast("double")).alias("citation_completeness"),
    )
    every = questions.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    rows = every.join(grouped, ["strategy", "query_id"], "left")
    joined = F.coalesce("joined", F.lit(""))
    # the text is a column here, so the lambda reads it and does not rebuild it
    matched = F.filter("expected_keywords", lambda word: F.contains(joined, word))
    found = rows.withColumn("matched", matched)
    return found.select(
        "strategy",
        "query_id",
        F.array_join("matched", ",").alias("matched_keywords"),
        F.when(F.size("matched") > 0, 1.0).otherwise(0.0).alias("hit_at_5"),
        (F.size("matched") / F.greatest(F.lit(1), F.size("expected_keywords"))).alias("keyword_recall"),
        F.length(joined).cast("long").alias("context_chars"),
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("evidence_count", "source_diversity")
        ],
        F.coalesce("citation_completeness", F.lit(0.0)).alias("citation_completeness"),
    )


def strategy_summary(metrics: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Mean of every metric per strategy, and of the time of `evaluate_timed` where it is given."""
    means = metrics.groupBy("strategy").agg(*[F.avg(m).alias(m) for m in METRICS])
    return means if times is None else means.join(times.select("strategy", "avg_latency_ms"), "strategy", "left")


def evaluate(
    docs: DataFrame, questions: DataFrame, k: int = 5, strategies: Sequence[tuple] = tuple(lx.STRATEGIES)
) -> DataFrame:
    """contexts of every strategy and question in one job.

    Every distinct window size is chunked and searched once, whichever strategies use it;
    parents are cut only from documents that hold a hit.
    """
    return reduce(DataFrame.unionByName, [rows for _, rows, _, _ in _strategies(docs, questions, k, strategies)])


def evaluate_timed(
    docs: DataFrame, questions: DataFrame, k: int = 5, strategies: Sequence[tuple] = tuple(lx.STRATEGIES)
) -> tuple[DataFrame, DataFrame]:
    """(contexts as `evaluate` gives them, one row per strategy of what its jobs were).

    Times: strategy, questions, chunks, contexts, job_ms, avg_latency_ms.  A job answers all questions at once,
    so the latency of a question is its share.  A search that two strategies use counts for both; building
    chunks counts for none.  Rows are counted by the jobs that write them.
    """
    spark, parts, rows = docs.sparkSession, [], []
    asked = questions.count()
    for name, contexts, seconds, chunks in _strategies(docs, questions, k, strategies):
        seen, start = Observation(), time.perf_counter()
        parts.append(stage(contexts.observe(seen, F.count(F.lit(1)).alias("contexts")), "contexts"))
        job = 1000 * (seconds + time.perf_counter() - start)
        rows.append((name, asked, chunks, seen.get["contexts"], job, job / asked if asked else 0.0))
    schema = "strategy string, questions long, chunks long, contexts long, job_ms double, avg_latency_ms double"
    return reduce(DataFrame.unionByName, parts), spark.createDataFrame(rows, schema)


def _strategies(
    docs: DataFrame, questions: DataFrame, k: int, strategies: Sequence[tuple]
) -> Iterator[tuple[str, DataFrame, float, int]]:
    """(strategy, contexts, seconds of its search, chunks searched)."""
    sizes = list(dict.fromkeys((size, overlap) for _, size, overlap, _, _ in strategies))
    cut = ck.eval_chunks(docs, sizes).repartition("chunk_id")
    # a folder per size, so that a search reads the windows of its own size only
    chunks = stage(cut, "chunks", by="size")
    asked = questions.select("query_id", F.col("question").alias("query"))
    hits: dict[tuple[int, int], tuple[DataFrame, float, int]] = {}
    for size, overlap in sizes:
        part = chunks.filter((F.col("size") == size) & (F.col("overlap") == overlap))
        index, start = se.SparseIndex(part, lower=False, max_features=None), time.perf_counter()
        found = stage(se.with_chunks(index.search(asked, k, high=None), part), "found")
        hits[size, overlap] = found, time.perf_counter() - start, index.n_chunks
    for name, size, overlap, parent_size, parent_overlap in strategies:
        rows, seconds, searched = hits[size, overlap]
        if parent_size is not None:
            sources = rows.select("source_id").distinct()
            kept = docs.join(broadcast_if_small(sources), "source_id", "left_semi")
            parents = stage(ck.eval_chunks(kept, [(parent_size, parent_overlap)]), "parents")
            rows = first_parents(map_to_parent(rows, parents))
        yield name, rows.select(F.lit(name).alias("strategy"), "query_id", "rank", "score", *CONTEXT), seconds, searched


def nested_results(metrics: DataFrame, contexts: DataFrame, questions: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """One row per strategy and question: the question, its metrics and its contexts as a list.

    Lists hold k contexts at most.  All columns of `questions` are carried along.
    """
    payload = F.struct(
        "rank",
        "chunk_id",
        *tx.context_fields(F.col("score"), F.col("text")),
        *[F.col(c) for c in CONTEXT if c not in ("chunk_id",)],
    )
    lists = contexts.groupBy("strategy", "query_id").agg(F.array_sort(F.collect_list(payload)).alias("contexts"))
    asked = questions.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in _names(metrics)])))
    rows = asked.join(metrics, ["strategy", "query_id"]).join(lists, ["strategy", "query_id"], "left")
    none = F.array().cast(lists.schema["contexts"].dataType)
    rows = rows.withColumn("contexts", F.coalesce("contexts", none))
    if times is None:
        return rows
    return rows.join(times.select("strategy", F.round("avg_latency_ms", 3).alias("latency_ms")), "strategy", "left")


def _names(metrics: DataFrame) -> list[str]:
    return [r.strategy for r in metrics.select("strategy").distinct().orderBy("strategy").collect()]


def best_strategy(summary: DataFrame, order: Sequence[str] = tuple(s[0] for s in lx.STRATEGIES)) -> DataFrame:
    """Best strategy per metric, the earlier one on ties."""
    rows = summary.unpivot("strategy", METRICS, "metric", "value")
    position = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("strategy"))
    return rows.groupBy("metric").agg(
        F.max_by("strategy", F.struct(F.col("value"), (-position).alias("p"))).alias("strategy"),
        F.max("value").alias("value"),
    )


def strategy_pivot(
    metrics: DataFrame, contexts: DataFrame, strategies: Sequence[str] = tuple(s[0] for s in lx.STRATEGIES)
) -> DataFrame:
    """Side by side per question: recall, matches and first source of each strategy (E5)."""
    top = contexts.filter(F.col("rank") == 1).select(
        "strategy",
        "query_id",
        tx.source_line(F.col("book"), F.col("chapter"), F.col("page_start"), F.col("page_end")).alias("source"),
        tx.short_text(F.substring("text", 1, 280)).alias("snippet"),
    )
    rows = metrics.join(top, ["strategy", "query_id"], "left")
    return rows.groupBy("query_id").pivot("strategy", list(strategies)).agg(
        F.first("keyword_recall").alias("recall"),
        F.first("matched_keywords").alias("matched"),
        F.first("source").alias("source"),
        F.first("snippet").alias("snippet"),
    )
