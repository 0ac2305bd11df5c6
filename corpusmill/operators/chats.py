"""Conversations: rendering, supervised spans, selection, trees and transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import bound, clean, normalize
from corpusmill.operators.ordering import BUCKET, first_wins, placed
from corpusmill.operators.records import chat_problem

START, END = "<|im_start|>", "<|im_end|>"
#: Most messages of a chain from the root to a leaf.
DEPTH = 8


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) from rows (conv_id, turn, role, text)."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(rows, lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


def rendered(messages: Column, prompt: bool = False) -> Column:
    each = F.transform(messages, lambda m: F.concat(F.lit(START), m.role, F.lit("\n"), m.content, F.lit(END + "\n")))
    body = F.array_join(each, "")
    return F.concat(body, F.lit(f"{START}assistant\n")) if prompt else body


def supervised_length(messages: Column) -> Column:
    """Tokens that answers supervise, one per character: each answer and the token that ends it."""
    return F.aggregate(messages, F.lit(0).cast("long"), lambda a, m: a + F.when(m.role == "assistant", F.length(m.content) + 1).otherwise(0))


def dialogue_identity(messages: Column) -> Column:
    """A digest of roles and normalized contents. A Python function can't run inside an array, so the whole dialogue is
    normalized at once, its parts apart by marks, around which blanks go."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(m.role, F.lit("\0"), F.coalesce(m.content, F.lit("")))), "\x01")
    return F.sha2(F.regexp_replace(F.concat(normalize(body), F.lit("\x01")), " ?([\\x00\\x01]) ?", "$1"), 256)


def selected(chats: DataFrame, order: str, most: int, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Chats that obey the grammar and fit, one per normalized dialogue, and one row of counters."""
    fit = chats.withColumn("__ok", problem.isNull() & (F.length(rendered(F.col("messages"))) <= most))
    good = fit.filter("__ok").drop("__ok").withColumn("identity", dialogue_identity(F.col("messages")))
    kept = first_wins(good, ["identity"], order)
    counters = fit.agg(F.count("*").alias("candidates"), F.count_if(~F.col("__ok")).alias("rejected"))
    return kept, counters.crossJoin(kept.agg(F.count("*").alias("kept"))).withColumn("duplicates", F.expr("candidates - rejected - kept"))


def chains(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(id, path) from each leaf of nodes (id, parent) to its root. Chains longer than depth, dangling
    parents and cycles give none. A join per level, of which there are at most depth, each computed once: rows that
    have reached their root go on as they are (adaptive execution splits their share of a join)."""
    parents = nodes.select(F.col("parent").alias("id")).filter("id is not null").distinct()
    live = nodes.join(parents, "id", "left_anti").select("id", F.col("parent").alias("at"), F.array("id").alias("path"))
    up = nodes.select(F.col("id").alias("at"), F.col("parent").alias("next"), F.lit(True).alias("there"))
    for _ in range(depth - 1):
        joined = live.join(up, "at", "left").filter("at is null or there")
        path = F.when(F.col("at").isNotNull(), F.concat(F.array("at"), "path")).otherwise(F.col("path"))
        live = joined.select("id", F.col("next").alias("at"), path.alias("path"))
    return live.filter("at is null").select("id", "path")


def last_turn(transcript: Column, human: str = "\n\nHuman:", assistant: str = "\n\nAssistant:") -> Column:
    """(prompt, response) of the last turn of a transcript, or null."""

    def turn(tail: Column) -> Column:
        at = F.locate(assistant, tail)
        prompt, response = F.substring(tail, F.lit(1), at - 1), F.substring(tail, at + len(assistant), F.length(tail))
        return F.when(at > 0, F.struct(clean(prompt).alias("prompt"), clean(response).alias("response")))

    def whole(t: Column) -> Column:
        return F.when(t.prompt.isNotNull() & t.response.isNotNull() & ~t.response.contains(assistant), t)

    # Bound step by step, so that no step's expression is written out for each of its uses.
    tail = bound(clean(transcript), lambda t: F.when(t.contains(human), F.substring_index(t, human, -1)))
    return bound(bound(tail, turn), whole)


def task_family(task: Column, transform: Column | None = None) -> Column:
    """Fixed task names and the families that sampling weights are given for."""
    numeric = task.isin("math-verifiable", "numeric")
    if transform is not None:
        numeric = numeric | F.coalesce(transform == "msvamp-parallel-integer-v1", F.lit(False))
    return (
        F.when(task == "classification", "classification")
        .when(task.isin("short_qa", "closed_qa", "open_qa", "information_extraction"), "short_qa")
        .when(task == "structured", "structured")
        .when(numeric, "numeric")
        .otherwise("general")
    )


def preference_pairs(responses: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, rank, chosen, rejected): the n-th preferred with the n-th other response of each group, texts that
    are equal once stripped left out. responses: (by.., order integer, text, preferred)."""
    numbered = placed(responses, [*by, "preferred"], [F.floor(F.col(order) / BUCKET)], [order], "rank")
    good = numbered.filter("preferred").select(*by, "rank", F.col(order).alias("chosen_id"), F.col("text").alias("chosen"))
    bad = numbered.filter("not preferred").select(*by, "rank", F.col(order).alias("rejected_id"), F.col("text").alias("rejected"))
    return good.join(bad, [*by, "rank"]).filter(clean(F.col("chosen")) != clean(F.col("rejected")))


def selected_sources(sources: dict[str, DataFrame], most: int, length: Column, control: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chats of several sources (id, language, messages, synthetic) by name: (kept, counters, counts). Synthetic ones,
    those that break the grammar, end without an answer or are longer than most are rejected, never cut; of equal
    normalized dialogues the one of the smallest id stays, whatever its source. counts: rows per source and language,
    sources without any left out."""
    every = reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df in sources.items()])
    last = F.get("messages", F.size("messages") - 1).role
    fit = chat_problem(F.col("messages"), control).isNull() & (last == "assistant") & (length <= most) & ~F.coalesce("synthetic", F.lit(False))
    judged = every.withColumn("__ok", F.coalesce(fit, F.lit(False)))
    good = judged.filter("__ok").drop("__ok").withColumn("identity", dialogue_identity(F.col("messages")))
    kept = first_wins(good, ["identity"], "id")
    counters = judged.agg(F.count("*").alias("candidates"), F.count_if(~F.col("__ok")).alias("rejected")).crossJoin(kept.agg(F.count("*").alias("kept")))
    return kept, counters.withColumn("duplicates", F.expr("candidates - rejected - kept")), kept.groupBy("source", "language").agg(F.count("*").alias("records"))


def protocol_errors(records: DataFrame, declared: DataFrame, languages: list[str], size: Column, most: int, control: Column) -> DataFrame:
    """(split, id, error) of records (split, id, source_id, language, messages, transform, uri, synthetic), the first
    rule that each breaks: its source's prefix is one of declared (source, transform, uri, excluded) and says the same,
    its language is allowed, it is a chat of at most most tokens that ends with an answer, isn't synthetic, and no
    earlier record has the same normalized dialogue. declared is a recipe's list."""
    parts = F.split("source_id", ":", 2)
    prefixed = records.withColumn("source", F.get(parts, 0)).withColumn("__rest", F.get(parts, 1)).withColumn("__identity", dialogue_identity(F.col("messages")))
    named = prefixed.join(F.broadcast(declared.withColumnsRenamed({"transform": "__transform", "uri": "__uri"})), "source", "left")
    first = prefixed.groupBy("__identity").agg(F.min(F.struct("split", "id")).alias("__first"))
    joined = named.join(first, "__identity")
    last = F.get("messages", F.size("messages") - 1).role
    error = (
        F.when(~F.coalesce(F.col("language").isin(languages), F.lit(False)), "language")
        .when(F.coalesce(F.col("__rest"), F.lit("")) == "", "source_id has no prefix")
        .when(F.col("__transform").isNull(), "source isn't declared")
        .when(~F.col("transform").eqNullSafe(F.col("__transform")), "transform differs")
        .when(~F.col("uri").eqNullSafe(F.col("__uri")), "uri differs")
        .when(chat_problem(F.col("messages"), control).isNotNull(), F.concat(F.lit("chat: "), chat_problem(F.col("messages"), control)))
        .when(F.coalesce(last != "assistant", F.lit(True)), "ends without answer")
        .when(size > most, "too long")
        .when(F.struct("split", "id") != F.col("__first"), "repeated dialogue")
        .when(F.coalesce("synthetic", F.lit(False)), "synthetic")
        .when(F.coalesce("excluded", F.lit(False)), "excluded source")
    )
    return joined.select("split", "id", error.alias("error")).filter("error is not null")
