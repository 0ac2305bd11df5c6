"""Source transforms: raw rows of a public source become records of a training stage.

Each transform is a filter, a derivation of records and identities, and a first-wins deduplication by the
column line, declared as one plan; its candidates then go through one ranked selection (least). Rows whose
fields are null, blank, too long or hold control strings are no candidates. Texts are never cut but for the
excerpt around an answer, which is the feature.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.ident import keyed_digest, record_digest
from corpusmill.functions.text import bound, clean, excerpt, has_control, normalize
from corpusmill.operators.chats import last_turn
from corpusmill.operators.ordering import first_wins

#: Control strings that raw texts may not hold.
CONTROL = ("<|pad|>", "<|bos|>", "<|eos|>", "<|unk|>", "<|chat_start|>", "<|chat_end|>")
#: Task categories of instruction rows and the family each is drawn for.
FAMILIES = {
    "classification": "classification",
    "closed_qa": "short_qa",
    "information_extraction": "short_qa",
    "brainstorming": "general",
    "creative_writing": "general",
    "general_qa": "general",
    "open_qa": "general",
    "summarization": "general",
}
#: Wording of prompts.
ANSWER_ONLY = "\n\nReply with the answer only."
ASK = {
    "en": ("Answer the question from the context. Return only the shortest answer span.\n\nContext:\n", "\n\nQuestion:\n"),
    "zh": ("根据上下文回答问题，只输出最短答案片段。\n\n上下文：\n", "\n\n问题：\n"),
}
AS_JSON = {
    "en": {"count": 'Return JSON only with the key "count" and integer answer.\n\n', "label": 'Return JSON only with the key "label" and string answer.\n\n'},
    "zh": {"count": '只输出 JSON，键为 "count"，值为整数答案。\n\n', "label": '只输出 JSON，键为 "label"，值为字符串答案。\n\n'},
}
LANGUAGES = {"english": "en", "chinese": "zh"}


class SelectionError(ValueError):
    """A selection that isn't valid, or that the rows can't fill."""


@dataclass(frozen=True)
class Source:
    """Where rows come from; the record ids depend on repository and revision."""

    name: str
    transform: str
    repository: str
    revision: str
    file: str
    split: str = "train"

    @property
    def uri(self) -> str:
        return f"hf://datasets/{self.repository}@{self.revision}/{self.file}"


@dataclass(frozen=True)
class Outcome:
    """candidates: every eligible record once, with its group and key. quotas: how many each group gives."""

    candidates: DataFrame
    quotas: Mapping[str, int]

    @property
    def records(self) -> DataFrame:
        return least(self.candidates, self.quotas).drop("group", "key", "line")

    def shortfalls(self) -> DataFrame:
        """(group, required, found) of groups with fewer candidates than their quota."""
        wanted = F.explode(F.create_map(*[F.lit(x) for pair in self.quotas.items() for x in pair]))
        found = self.candidates.groupBy("group").agg(F.count("*").alias("found"))
        asked = self.candidates.sparkSession.range(1).select(wanted.alias("group", "required"))
        return asked.join(found, "group", "left").select("group", "required", F.coalesce("found", F.lit(0)).alias("found")).filter("found < required")


def least(candidates: DataFrame, quotas: Mapping[str, int]) -> DataFrame:
    """The quota of each group with the least keys, ties by id. A bounded sort per group, so that a group with
    most of the rows is never sorted in one task; groups are few, as a recipe names them."""
    parts = [candidates.filter(F.col("group") == g).orderBy("key", "id").limit(n) for g, n in quotas.items() if n > 0]
    return reduce(DataFrame.unionByName, parts)


def integer_answer(value: Column) -> Column:
    """The digits of a whole decimal number in any notation ('12.0' gives '12'), or null. Exponents are read
    up to 28 digits; digits may be ASCII or full-width."""

    def whole(plain: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(plain, "^[+-]?([0-9]*)", 1), "^0+(?=.)", "")
        return bound(digits, lambda d: F.when(d.isin("", "0"), "0").when(plain.startswith("-"), F.concat(F.lit("-"), d)).otherwise(d))

    def scaled(plain: Column) -> Column:
        return bound(plain.try_cast("decimal(38,10)"), lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")))

    def read(plain: Column) -> Column:
        exponent = plain.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)[eE][+-]?[0-9]+$")
        return F.when(plain.rlike("^[+-]?([0-9]+\\.?0*|\\.0+)$"), whole(plain)).when(exponent, scaled(plain))

    return bound(F.translate(F.replace(clean(value), F.lit("_"), F.lit("")), "０１２３４５６７８９", "0123456789"), read)


def _held(*texts: Column) -> Column:
    return reduce(lambda a, b: a | b, [has_control(t, CONTROL) for t in texts])


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _settled(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """select(), each column computed once a row: filters aren't pushed through a generator, where the optimizer
    would write the columns' whole expressions out for every use in them."""
    return rows.select(F.inline(F.array(F.struct(*(columns or rows.columns)))))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _metadata(source: Source, *more: Column) -> Column:
    return F.struct(F.lit(source.uri).alias("source"), F.lit(source.transform).alias("transform"), *more).alias("metadata")


def _dialogues(rows: DataFrame, source: Source, recipe: str, language: str, most: int, grouped: bool, *more: Column) -> DataFrame:
    """Candidates of one question and answer. rows: (line, group, prompt, response, columns of more)."""
    p, r = F.col("prompt"), F.col("response")
    fit = _settled(rows).filter(_true(~_held(p, r) & (F.length(p) + F.length(r) <= most)))
    named = first_wins(fit.withColumn("identity", record_digest({"prompt": normalize(p), "response": normalize(r)})), ["identity"], "line")
    i = F.col("identity")
    return named.select(
        "line",
        "group",
        keyed_digest(recipe, source.name, *([F.col("group")] if grouped else []), i).alias("key"),
        keyed_digest(source.repository, source.revision, "sft", i, language).alias("id"),
        F.concat(F.lit(source.name + ":"), i).alias("source_id"),
        F.lit(language).alias("language"),
        F.array(_message("user", p), _message("assistant", r)).alias("messages"),
        _metadata(source, *more),
    )


def _preferences(rows: DataFrame, source: Source, recipe: str, most: int, grouped: bool, *more: Column) -> DataFrame:
    """Candidates of a prompt and two answers. rows: (line, group, language, prompt, chosen, rejected, columns of more)."""
    p, c, r = F.col("prompt"), F.col("chosen"), F.col("rejected")
    fit = _settled(rows).filter(_true((c != r) & ~_held(p, c, r) & (F.length(p) + F.greatest(F.length(c), F.length(r)) <= most)))
    digest = record_digest({"prompt": normalize(p), "chosen": normalize(c), "rejected": normalize(r)})
    named = first_wins(fit.withColumn("identity", digest), ["identity"], "line")
    i = F.col("identity")
    return named.select(
        "line",
        "group",
        keyed_digest(recipe, source.name, *([F.col("language")] if grouped else []), i).alias("key"),
        keyed_digest(source.repository, source.revision, "dpo", i, F.col("language")).alias("id"),
        F.concat(F.lit(source.name + ":"), i).alias("source_id"),
        "language",
        "prompt",
        "chosen",
        "rejected",
        _metadata(source, *more),
    )


def instructions(rows: DataFrame, source: Source, recipe: str, config: Mapping) -> Outcome:
    """rows (line, instruction, context, response, category). The balanced form draws each family apart and
    holds its answers to a length of their own."""
    task = F.coalesce("category", F.lit("instruction"))
    context = clean(F.col("context"))
    asked = clean(F.col("instruction"))
    prompt = F.when(context.isNotNull(), F.concat(asked, F.lit("\n\nContext:\n"), context)).otherwise(asked)
    found = rows.select("line", prompt.alias("prompt"), clean(F.col("response")).alias("response"), task.alias("task"))
    if source.transform != "dolly-balanced-sft-v1":
        quotas = {"all": config["records"]}
        found = found.withColumn("group", F.lit("all"))
    else:
        quotas = {g: config[f"{g}_records"] for g in ("general", "classification", "short_qa")}
        family = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])[F.col("task")]
        limit = reduce(lambda c, g: c.when(F.col("group") == g, config[f"{g}_max_answer_characters"]), ("classification", "short_qa"), F.when(F.lit(False), 0))
        found = found.withColumn("group", family).filter("group is not null").filter(F.length("response") <= F.coalesce(limit, F.lit(config["max_characters"])))
        found = found.withColumn("prompt", F.when(F.col("group") == "general", F.col("prompt")).otherwise(F.concat("prompt", F.lit(ANSWER_ONLY))))
    return Outcome(_dialogues(found, source, recipe, "en", config["max_characters"], len(quotas) > 1, F.col("task")), quotas)


def first_answers(rows: DataFrame, source: Source, recipe: str, config: Mapping) -> Outcome:
    """rows (line, question, human_answers array, source): the first answer of each question."""
    found = rows.select(
        "line", F.lit("all").alias("group"), clean(F.col("question")).alias("prompt"), clean(F.get("human_answers", F.lit(0))).alias("response"), F.coalesce("source", F.lit("open_qa")).alias("task")
    )
    return Outcome(_dialogues(found, source, recipe, "zh", config["max_characters"], False, F.col("task"), F.lit("human").alias("answer_origin")), {"all": config["records"]})


def extractive(rows: DataFrame, source: Source, recipe: str, config: Mapping) -> Outcome:
    """rows (line, id, question, context, answers struct of arrays (text, answer_start)): a short-answer view,
    and for each of its records one JSON view. Views can't share a dialogue, as their prompts begin apart, so
    each is deduplicated by itself."""
    language = "en" if source.transform == "squad-extractive-sft-v1" else "zh"
    lead, turn = ASK[language]
    found = _settled(
        rows,
        "line",
        clean(F.col("id").cast("string")).alias("upstream_id"),
        clean(F.col("question")).alias("question"),
        clean(F.col("context")).alias("context"),
        clean(F.get("answers.text", F.lit(0))).alias("answer"),
        F.get("answers.answer_start", F.lit(0)).alias("given"),
    )
    c, a, q = F.col("context"), F.col("answer"), F.col("question")
    found = found.filter(_true(F.col("upstream_id").isNotNull() & (F.length(a) <= config["max_answer_characters"]) & ~_held(q, c, a)))
    stated = _true((F.col("given") >= 0) & (F.substring(c, (F.col("given") + 1).cast("int"), F.length(a)) == a))
    at = F.when(stated, F.col("given")).otherwise(F.position(a, c) - 1)
    found = _settled(found, "line", "upstream_id", "question", "context", "answer", at.alias("at")).filter("at >= 0")
    found = found.withColumn("prompt", F.concat(F.lit(lead), excerpt(c, F.col("at"), F.length(a), config["max_context_characters"]), F.lit(turn), q))
    found = _settled(found, "line", "upstream_id", "question", "answer", "prompt").filter(F.length("prompt") + F.length(a) <= config["max_characters"])
    digest = record_digest({"upstream_id": F.col("upstream_id"), "question": normalize(q), "answer": normalize(a)})
    once = first_wins(found.withColumn("identity", digest), ["identity"], "line")
    dialogue = lambda p, r: record_digest({"prompt": normalize(F.col(p)), "response": normalize(F.col(r))})
    short = first_wins(once.withColumn("dialogue", dialogue("prompt", "answer")), ["dialogue"], "line").drop("dialogue", "question")

    short = _settled(short, "line", "identity", "upstream_id", "answer", "prompt", integer_answer(a).alias("whole"))
    whole = F.col("whole")
    wording = AS_JSON[language]
    view_of = lambda view, prompt, response, task: F.struct(view.alias("view"), prompt.alias("prompt"), response.alias("response"), task.alias("task"))
    views = F.array(
        view_of(F.lit("short-qa"), F.col("prompt"), a, F.lit("short_qa")),
        view_of(
            F.when(whole.isNotNull(), "json-integer").otherwise("json-string"),
            F.concat(F.when(whole.isNotNull(), wording["count"]).otherwise(wording["label"]), F.col("prompt")),
            F.when(whole.isNotNull(), F.concat(F.lit('{"count":'), whole, F.lit("}"))).otherwise(F.to_json(F.struct(a.alias("label")))),
            F.lit("structured"),
        ),
    )
    each = short.select("line", "identity", "upstream_id", F.explode(views).alias("v")).select("line", "identity", "upstream_id", "v.*")
    each = each.filter((F.col("view") == "short-qa") | (F.length("prompt") + F.length("response") <= config["max_characters"]))
    each = first_wins(each.withColumn("dialogue", dialogue("prompt", "response")), ["view", "dialogue"], "line")
    i, view = F.col("identity"), F.col("view")
    candidates = each.select(
        "line",
        view.alias("group"),
        keyed_digest(recipe, source.name, view, i).alias("key"),
        keyed_digest(source.repository, source.revision, view, i, language).alias("id"),
        F.concat(F.lit(source.name + ":"), i).alias("source_id"),
        F.lit(language).alias("language"),
        F.array(_message("user", F.col("prompt")), _message("assistant", F.col("response"))).alias("messages"),
        _metadata(source, F.col("upstream_id"), F.lit("human-extractive").alias("answer_origin"), F.col("task")),
    )
    return Outcome(candidates, {"short-qa": config["records"], "json-integer": config["json_integer_records"], "json-string": config["json_string_records"]})


def signed_preferences(rows: DataFrame, source: Source, recipe: str, config: Mapping) -> Outcome:
    """rows (line, language, domain, context array of (role, content), response1, response2,
    overall_preference): below zero the first answer is the chosen one; zero says nothing."""
    quotas = config.get("records_by_language") or {x: config["records_per_language"] for x in LANGUAGES.values()}
    last = F.element_at("context", -1)
    policy = F.size("context") == 1 if config["context_messages"] == 1 else F.size("context") > 0
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[F.lower("language")]
    sign = F.col("overall_preference").cast("double")
    usable = rows.filter(_true(policy & (F.col("overall_preference") != 0)))
    one, two = clean(F.col("response1")), clean(F.col("response2"))
    found = usable.filter(_true(last.role == "user")).select(
        "line",
        language.alias("language"),
        language.alias("group"),
        clean(last.content).alias("prompt"),
        F.when(sign < 0, one).otherwise(two).alias("chosen"),
        F.when(sign < 0, two).otherwise(one).alias("rejected"),
        F.coalesce("domain", F.lit("")).alias("domain"),
        F.abs(sign).alias("preference_strength"),
    )
    found = found.filter("language is not null")
    return Outcome(_preferences(found, source, recipe, config["max_characters"], True, F.col("domain"), F.col("preference_strength")), quotas)


def transcript_preferences(rows: DataFrame, source: Source, recipe: str, config: Mapping) -> Outcome:
    """rows (line, chosen, rejected): two transcripts whose last prompts agree once normalized."""
    turns = _settled(rows, "line", last_turn(F.col("chosen")).alias("a"), last_turn(F.col("rejected")).alias("b")).filter("a is not null and b is not null")
    found = turns.filter(normalize(F.col("a.prompt")) == normalize(F.col("b.prompt"))).select(
        "line", F.lit("all").alias("group"), F.lit("en").alias("language"), "a.prompt", F.col("a.response").alias("chosen"), F.col("b.response").alias("rejected")
    )
    return Outcome(_preferences(found, source, recipe, config["max_characters"], False, F.lit("helpfulness").alias("task")), {"all": config["records"]})


def paired_preferences(rows: DataFrame, source: Source, recipe: str, config: Mapping) -> Outcome:
    """rows (line, prompt, pos_resp, neg_resp, pos_type, neg_type)."""
    kinds = [F.coalesce(c, F.lit("")).alias(n) for c, n in (("pos_type", "chosen_type"), ("neg_type", "rejected_type"))]
    found = rows.select(
        "line", F.lit("all").alias("group"), F.lit("zh").alias("language"), clean(F.col("prompt")).alias("prompt"), clean(F.col("pos_resp")).alias("chosen"), clean(F.col("neg_resp")).alias("rejected"), *kinds
    )
    more = (F.lit("values-alignment").alias("task"), F.col("chosen_type"), F.col("rejected_type"))
    return Outcome(_preferences(found, source, recipe, config["max_characters"], False, *more), {"all": config["records"]})


def message_trees(rows: DataFrame, source: Source, recipe: str, config: Mapping) -> Outcome:
    """rows (line, message_id, parent_id, message_tree_id, text, role, lang, review_result, deleted, synthetic,
    rank, tree_state): the way from each best answer up to its root, as a conversation.

    Messages that no conversation may hold go before the joins. A join per level, of which there are at most
    max_messages, in one linear plan; the parents' side has unique ids, so a parent with many children skews one
    side alone, which adaptive execution splits."""
    answered = F.col("role") == "assistant"
    body = clean(F.col("text"))
    sound = (
        F.col("lang").isin(*LANGUAGES.values())
        & F.col("review_result")
        & ~F.col("deleted")
        & ~F.col("synthetic")
        & (F.col("tree_state") == "ready_for_export")
        & ~has_control(body, CONTROL)
        & ((F.col("role") == "prompter") | (answered & (F.col("rank") == 0)))
    )
    nodes = rows.filter(_true(sound) & clean(F.col("message_id")).isNotNull()).select(
        clean(F.col("message_id")).alias("at"),
        clean(F.col("parent_id")).alias("parent"),
        "message_id",
        "message_tree_id",
        "line",
        "lang",
        answered.alias("answers"),
        F.struct(F.when(answered, "assistant").otherwise("user").alias("role"), body.alias("content")).alias("message"),
    )
    up = nodes.select(F.col("at").alias("step"), F.col("parent").alias("above"), F.col("lang").alias("up_lang"), F.col("answers").alias("up_answers"), F.col("message").alias("up_message"))
    live = nodes.filter("answers").select("line", "message_id", "message_tree_id", "lang", "parent", "answers", F.array("message").alias("messages"))
    columns = live.columns
    ended = F.col("parent").isNull()
    for _ in range(config["max_messages"] - 1):
        # Chains at their root go along in one plan; keys of their own keep them from meeting in one task.
        step = F.coalesce("parent", F.concat(F.lit("\u0000"), "message_id"))
        live = live.withColumn("step", step).join(up, "step", "left").filter(ended | _true((F.col("lang") == F.col("up_lang")) & (F.col("answers") != F.col("up_answers"))))
        onward = {"messages": F.concat(F.array("up_message"), "messages"), "answers": F.col("up_answers"), "parent": F.col("above")}
        live = live.select(*[F.when(ended, F.col(c)).otherwise(onward[c]).alias(c) if c in onward else F.col(c) for c in columns])
    rooted = live.filter("parent is null and not answers")
    whole = rooted.filter(F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(m.content)) <= config["max_characters"])
    m, lang = F.col("message_id"), F.col("lang")
    candidates = whole.select(
        "line",
        lang.alias("group"),
        keyed_digest(recipe, source.name, lang, m).alias("key"),
        keyed_digest(source.repository, source.revision, "sft", m, lang).alias("id"),
        F.concat(F.lit(source.name + ":"), "message_tree_id").alias("source_id"),
        lang.alias("language"),
        "messages",
        _metadata(source, m.alias("upstream_message_id")),
    )
    return Outcome(candidates, {x: config["records_per_language"] for x in LANGUAGES.values()})


def repeated_messages(rows: DataFrame) -> DataFrame:
    """(message_id, times) of ids that occur more than once, which a source of trees may not have."""
    return rows.select(clean(F.col("message_id")).alias("message_id")).filter("message_id is not null").groupBy("message_id").agg(F.count("*").alias("times")).filter("times > 1")


@dataclass(frozen=True)
class Parallel:
    """Records of both kinds, and (invalid, duplicates, groups) in one row."""

    sft: DataFrame
    grpo: DataFrame
    counts: DataFrame


def parallel_numbers(rows: DataFrame, source: Source, recipe: str, config: Mapping) -> Parallel:
    """rows (line, query, m_query, equation, response): each question in two languages with one whole number.
    The groups with the least keys, sft_warmup_groups of them, are answered records; the others are prompts
    with an answer to verify. The warm-up is a bounded sort; no window ranks all groups."""
    q, m = clean(F.col("query")), clean(F.col("m_query"))
    raw = _settled(rows, "line", q.alias("query"), m.alias("m_query"), clean(F.col("equation")).alias("equation"), integer_answer(F.col("response").cast("string")).alias("answer"))
    good = _true(F.col("equation").isNotNull() & F.col("answer").isNotNull() & ~_held(F.col("query"), F.col("m_query")))
    digest = record_digest({"query": normalize(F.col("query")), "m_query": normalize(F.col("m_query")), "equation": F.col("equation"), "answer": F.col("answer")})
    valid = raw.filter(good).withColumn("identity", digest)
    groups = first_wins(valid, ["identity"], "line")
    i = F.col("identity")
    groups = groups.withColumn("key", keyed_digest(recipe, source.name, i))
    head = groups.select("identity", "key").orderBy("key", "identity").limit(config["sft_warmup_groups"]).select("identity", F.lit("sft-warmup").alias("partition"))
    parted = groups.join(head, "identity", "left").withColumn("partition", F.coalesce("partition", F.lit("grpo")))
    asked = lambda language, text: F.struct(F.lit(language).alias("language"), text.alias("prompt"))
    both = F.explode(F.array(asked("en", F.col("query")), asked("zh", F.col("m_query"))))
    each = parted.withColumn("v", both).select(
        keyed_digest(source.repository, source.revision, F.col("partition"), i, F.col("v.language")).alias("id"),
        F.concat(F.lit(source.name + ":"), i).alias("source_id"),
        "v.language",
        "v.prompt",
        "answer",
        "partition",
        "equation",
    )
    common = [F.lit(source.split).alias("upstream_split"), F.lit("training").alias("intended_use"), F.col("partition"), F.col("equation")]
    sft = each.filter("partition = 'sft-warmup'").select("id", "source_id", "language", F.array(_message("user", F.col("prompt")), _message("assistant", F.col("answer"))).alias("messages"), _metadata(source, *common))
    grpo = each.filter("partition = 'grpo'").select("id", "source_id", "language", "prompt", "answer", _metadata(source, *common, F.lit("integer").alias("verifier")))
    # One pass over identities: how many there are and how often they occur.
    per = raw.withColumn("identity", F.when(good, digest)).groupBy("identity").agg(F.count("*").alias("n"))
    known = F.col("identity").isNotNull()
    counts = per.agg(
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("invalid"), F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicates"), F.count_if(known).alias("groups")
    )
    return Parallel(sft, grpo, counts)


Transform = Callable[[DataFrame, Source, str, Mapping], "Outcome | Parallel"]
RANK, POSITIVE, NATURAL = "stable-hash-rank", 1, 0
SINGLE = {"strategy": RANK, "records": POSITIVE, "max_characters": POSITIVE}
QA = SINGLE | {"json_integer_records": NATURAL, "json_string_records": NATURAL, "max_context_characters": POSITIVE, "max_answer_characters": POSITIVE}
#: Transform by its id: the function, the stages its records are for, and the fields of its selection, each
#: with the least value of a count or the one value allowed.
TRANSFORMS: dict[str, tuple[Transform, tuple[str, ...], dict[str, object]]] = {
    "oasst-ranked-conversation-v1": (
        message_trees,
        ("sft",),
        {"strategy": RANK, "records_per_language": POSITIVE, "max_messages": POSITIVE, "max_characters": POSITIVE, "require_all_assistant_rank_zero": True},
    ),
    "dolly-single-turn-sft-v1": (instructions, ("sft",), SINGLE),
    "dolly-balanced-sft-v1": (
        instructions,
        ("sft",),
        {"strategy": RANK, "max_characters": POSITIVE}
        | {f"{g}_records": POSITIVE for g in ("general", "classification", "short_qa")}
        | {f"{g}_max_answer_characters": POSITIVE for g in ("classification", "short_qa")},
    ),
    "hc3-human-single-turn-sft-v1": (first_answers, ("sft",), SINGLE),
    "squad-extractive-sft-v1": (extractive, ("sft",), QA),
    "cmrc-extractive-sft-v1": (extractive, ("sft",), QA),
    "helpsteer3-single-turn-preference-v1": (
        signed_preferences,
        ("dpo",),
        {"strategy": RANK, "max_characters": POSITIVE, "context_messages": {1, "last-user"}, "nonzero_preference": True},
    ),
    "hh-helpful-single-turn-preference-v1": (transcript_preferences, ("dpo",), SINGLE),
    "cvalues-helpful-single-turn-preference-v1": (paired_preferences, ("dpo",), SINGLE),
    "msvamp-parallel-integer-v1": (
        parallel_numbers,
        ("sft", "grpo"),
        {"strategy": "stable-hash-partition", "expected_groups": POSITIVE, "sft_warmup_groups": POSITIVE},
    ),
}


def _fault(name: str, value: object, rule: object) -> str | None:
    if type(rule) is int:
        whole = isinstance(value, int) and not isinstance(value, bool)
        return None if whole and value >= rule else f"{name} must be a whole number of at least {rule}"
    fits = value in rule if isinstance(rule, set) else value is rule if isinstance(rule, bool) else value == rule
    return None if fits else f"{name} may not be {value!r}"


def check_selection(transform: str, config: Mapping) -> list[str]:
    """What is wrong with a selection; empty if nothing is."""
    if transform not in TRANSFORMS:
        return [f"unknown transform {transform}"]
    fields = dict(TRANSFORMS[transform][2])
    config = dict(config)
    if transform.startswith("helpsteer3"):
        by = config.pop("records_by_language", None)
        if by is None:
            fields["records_per_language"] = POSITIVE
        else:
            config |= {f"records_by_language.{x}": n for x, n in by.items()} if isinstance(by, Mapping) else {"records_by_language": by}
            fields |= {f"records_by_language.{x}": POSITIVE for x in LANGUAGES.values()}
    if set(config) != set(fields):
        return [f"fields {sorted(config)} where {sorted(fields)} are due"]
    found = [f for f in (_fault(n, config[n], rule) for n, rule in fields.items()) if f]
    if found:
        return found
    rules = {
        "max_messages must be even": config.get("max_messages", 0) % 2 == 0,
        "a structured view is due": "json_integer_records" not in config or config["json_integer_records"] + config["json_string_records"] > 0,
        "the warm-up must leave a group": "expected_groups" not in config or config["sft_warmup_groups"] < config["expected_groups"],
    }
    return [text for text, kept in rules.items() if not kept]


def apply(rows: DataFrame, source: Source, recipe: str, config: Mapping, strict: bool = True) -> dict[str, DataFrame]:
    """The records of a source by stage. strict: count first and raise where a quota can't be filled, or where
    the source breaks a rule of its own (repeated message ids, invalid or repeated groups)."""
    faults = check_selection(source.transform, config)
    if faults:
        raise SelectionError("; ".join(faults))
    function, stages, _ = TRANSFORMS[source.transform]
    outcome = function(rows, source, recipe, config)
    if isinstance(outcome, Parallel):
        if strict:
            n = outcome.counts.first()
            if n.invalid or n.duplicates or n.groups != config["expected_groups"]:
                raise SelectionError(f"{source.name}: {n.invalid} invalid rows, {n.duplicates} duplicates, {n.groups} groups where {config['expected_groups']} are due")
        return {"sft": outcome.sft, "grpo": outcome.grpo}
    if strict:
        if function is message_trees and (again := repeated_messages(rows).first()):
            raise SelectionError(f"{source.name}: message {again.message_id} occurs {again.times} times")
        short = outcome.shortfalls().collect()  # a row per group of the recipe at most
        if short:
            raise SelectionError("; ".join(f"{source.name}.{s.group} has {s.found} of {s.required} records" for s in short))
    return {stages[0]: outcome.records}
