"""Planning over a table of user questions: intents, expansion, gating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import lexicon as lx
from folioscope.functions import payload as pl
from folioscope.functions import text as tx


def is_greeting(query: Column, greetings: Sequence[str] = tuple(lx.PLAN_GREETINGS)) -> Column:
    """A greeting, or up to 12 characters that contain one."""
    said = F.lower(tx.strip(query))
    return said.isin(list(greetings)) | ((F.length(said) <= 12) & tx.contains_any(said, greetings))


def route_intent(
    queries: DataFrame,
    greetings: Sequence[str] = tuple(lx.ROUTE_GREETINGS),
    report_words: Sequence[str] = tuple(lx.REPORT_WORDS),
    graph_words: Sequence[str] = tuple(lx.GRAPH_WORDS),
) -> DataFrame:
    """Rule intent, topic and keywords of queries(query_id, query, mode, has_graph)."""
    query = tx.strip(F.col("query"))
    greets = F.lower(query).isin(list(greetings)) | query.isin(list(greetings))
    intent = (
        F.when(greets, "greeting")
        .when(tx.contains_any(query, report_words), "report")
        .when((F.col("mode") == "graph") & F.col("has_graph"), "graph_update")
        .when(tx.contains_any(query, graph_words), "graph_build")
        .when(F.col("mode") == "ask", "ask")
        .otherwise("graph_build")
    )
    words = F.when(greets, F.array().cast("array<string>")).otherwise(tx.keywords(query))
    topic = F.when(greets, "").otherwise(F.coalesce(F.get(words, F.lit(0)), F.substring(query, 1, 24)))
    return queries.select(
        "query_id",
        intent.alias("intent"),
        topic.alias("topic"),
        words.alias("keywords"),
        (intent != "greeting").alias("need_retrieval"),
    )


def expand_keywords(
    query: Column, dictionary: dict[str, list[str]], words: Sequence[str], limit: int = 12
) -> Column:
    """Contained dictionary keys with their synonyms, then other contained words.

    The dictionary is a few rows of fixed size, so it is unrolled into the expression; order
    is dictionary position, then word position.
    """
    none = F.array().cast("array<string>")
    groups = [
        F.when(query.contains(key), F.array(*[F.lit(w) for w in [key, *values]])).otherwise(none)
        for key, values in dictionary.items()
    ]
    first = F.concat(*groups) if groups else none
    seen = F.array(*[F.lit(w) for w in dict.fromkeys(words)]) if words else none
    extra = tx.bind(first, lambda have: F.concat(
        have, F.filter(seen, lambda w: F.contains(query, w) & ~F.array_contains(have, w))
    ))
    return F.slice(extra, 1, limit)


def plan_queries(
    queries: DataFrame,
    domain_words: Sequence[str] = tuple(lx.DOMAIN_WORDS),
    symptom_words: Sequence[str] = tuple(lx.SYMPTOM_WORDS),
    dictionary: dict[str, list[str]] | None = None,
    tail: Sequence[str] = tuple(lx.EXPANSION_TAIL),
    greetings: Sequence[str] = tuple(lx.PLAN_GREETINGS),
) -> DataFrame:
    """Class, search need, keywords and expanded query per question."""
    dictionary = lx.EXPANSIONS if dictionary is None else dictionary
    query = tx.strip(F.col("query"))
    is_symptom = tx.contains_any(query, symptom_words)
    is_domain = is_symptom | tx.contains_any(query, domain_words)
    greets = is_greeting(query, greetings)
    rule = (
        F.when(is_symptom, "symptom_question").when(is_domain, "study_question").otherwise("non_medical_question")
    )
    words = expand_keywords(query, dictionary, [*domain_words, *symptom_words])
    expanded = F.array_join(
        F.array_distinct(F.concat(F.array(query), F.col("_words"), F.array(*[F.lit(t) for t in tail]))), " "
    )

    def field(position: int) -> Column:
        chain = None
        for name, fields in lx.PLAN_FIELDS.items():
            is_it = F.col("intent") == name
            chain = F.when(is_it, fields[position]) if chain is None else chain.when(is_it, fields[position])
        return chain.otherwise(False if position == 0 else "")

    planned = queries.select(
        "query_id",
        query.alias("query"),
        F.when(greets, "greeting").otherwise(rule).alias("intent"),
        F.when(greets, F.array().cast("array<string>")).otherwise(words).alias("_words"),
    )
    return planned.select(
        "query_id",
        "query",
        "intent",
        field(0).alias("need_search"),
        F.col("_words").alias("search_keywords"),
        F.when(F.col("intent") == "greeting", F.col("query")).otherwise(expanded).alias("expanded_query"),
        field(1).alias("opening"),
        field(2).alias("answer_focus"),
        field(3).alias("goal"),
    )


def gate(plans: DataFrame, force: bool = True, index_exists: bool = True) -> DataFrame:
    """Which planned questions are searched, and why the others are not."""
    intent = F.col("intent")
    greeting = intent == "greeting"
    should = ~greeting & (F.lit(force) | F.col("need_search"))
    wanted = ~greeting & (F.col("need_search") | (F.lit(force) & (intent != "non_medical_question")))
    return plans.withColumns(
        {
            "should_search": should,
            "searched": wanted & F.lit(index_exists),
            "skipped": F.when(greeting, "greeting")
            .when(~wanted, "not needed")
            .when(F.lit(not index_exists), "index missing")
            .otherwise(""),
        }
    )


def normalise_route(payloads: DataFrame) -> DataFrame:
    """Externally produced routes(query_id, query, mode, has_graph, payload) (P5)."""
    record = payloads.withColumn("_j", pl.extract_json(F.col("payload")))
    j, query = F.col("_j"), F.col("query")
    updating = (F.col("mode") == "graph") & F.col("has_graph")
    default = F.when(updating, "graph_update").otherwise("ask")
    raw = tx.strip(F.coalesce(pl.string_field(j, "intent"), F.lit("")))
    intent = pl.aliased(raw, lx.INTENT_ALIASES, lx.INTENTS, default)
    words = F.coalesce(pl.list_field(j, "keywords"), pl.list_field(j, "search_keywords"), tx.keywords(query))
    rows = record.select("query_id", "query", "_j", intent.alias("intent"), words.alias("_w"))
    asked_topic = tx.strip(F.coalesce(pl.string_field(j, "topic"), F.lit("")))
    topic = F.when(asked_topic != "", asked_topic).otherwise(
        F.coalesce(F.get("_w", F.lit(0)), F.substring("query", 1, 24))
    )
    need = F.coalesce(
        pl.flag_field(j, "need_retrieval"),
        pl.flag_field(j, "need_pdf_search"),
        ~F.col("intent").isin(["greeting", "unknown"]),
    )
    return rows.select(
        "query_id",
        j.isNotNull().alias("parsed"),
        "intent",
        topic.alias("topic"),
        F.slice("_w", 1, 8).alias("keywords"),
        need.alias("need_retrieval"),
    )


def normalise_plan(payloads: DataFrame, plans: DataFrame) -> DataFrame:
    """Externally produced plans over the rule plans as defaults (P5).

    Rule plans of the kinds in `lexicon.RULE_PLANS` stand whatever the payload says.
    """
    joined = plans.join(payloads.select("query_id", pl.extract_json(F.col("payload")).alias("_p")), "query_id", "left")
    joined = joined.withColumn("_j", F.when(~F.col("intent").isin(lx.RULE_PLANS), F.col("_p")))
    j = F.col("_j")
    intent = F.coalesce(pl.string_field(j, "intent"), F.col("intent"))
    words = F.coalesce(pl.list_field(j, "search_keywords"), F.col("search_keywords"))

    def text(name: str, default: str) -> Column:
        return F.coalesce(pl.string_field(j, name), F.col(default))

    return joined.select(
        "query_id",
        F.when(intent.isin(lx.PLAN_INTENTS), intent).otherwise(F.col("intent")).alias("intent"),
        F.coalesce(pl.flag_field(j, "need_pdf_search"), F.col("need_search")).alias("need_search"),
        F.slice(words, 1, 12).alias("search_keywords"),
        text("expanded_query", "expanded_query").alias("expanded_query"),
        text("user_emotion_reply", "opening").alias("opening"),
        text("answer_focus", "answer_focus").alias("answer_focus"),
        text("conversation_goal", "goal").alias("goal"),
    )
