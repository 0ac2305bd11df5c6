"""Registered queries over the driver's tables, each with the SQL of its result where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import ident, schedule, text
from corpusmill.operators import chats, contamination, evaluation, gates, ordering, records, sampling, splits, transforms, windows
from corpusmill.plans.entries import CODES, ENTRIES, NORMAL, SIZE, SPLIT, WS, Entry, collapse, query, score, split_sql, strip, table
from corpusmill.streaming import metrics

__all__ = ["ENTRIES", "Entry"]

# --- splits ---------------------------------------------------------------------------------------------


@query(f"select split, count(*) as records, count(distinct doc_id) as groups from (select doc_id, {SPLIT} as split from documents) group by split")
def split_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.split_counts(splits.with_split(docs, "doc_id"), "doc_id")


@query(f"select doc_id, {score(42, 'doc_id::varchar')} as score, {SPLIT} as split from documents")
def split_assignments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return splits.with_split(docs.withColumn("score", ident.unit_score(42, F.col("doc_id").cast("string"))), "doc_id")


@query(f"select split, count(*) as records, count(distinct source) as groups from (select source, {split_sql('source')} as split from documents) group by split")
def split_by_source_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source")
    return splits.split_counts(splits.with_split(docs, "source"), "source")


@query(f"with t as (select sha256({collapse('text')}) as identity, {SPLIT} as split from documents) select identity, count(distinct split) as splits, count(*) as records from t group by identity having count(distinct split) > 1")
def split_leakage(spark, sf_dir):
    docs = splits.with_split(table(spark, sf_dir, "documents"), "doc_id")
    return splits.leakage(docs.select("split", F.sha2(text.normalize(F.col("text")), 256).alias("identity")), "identity")


# --- records --------------------------------------------------------------------------------------------


@query(f"select 'source' as field, 'missing_or_empty' as code, count(*) as n from documents where source is null or {strip('source')} = '' having count(*) > 0 union all select 'text', 'missing_or_empty', count(*) from documents where text is null or {strip('text')} = '' having count(*) > 0 union all select 'text', 'too_short', count(*) from documents where length({strip('text')}) < 200 having count(*) > 0")
def validate_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text", "source")
    short = F.array_compact(F.array(F.when(F.length(text.strip(F.col("text"))) < 200, records.issue("text", "too_short"))))
    found = docs.select(F.explode(F.concat(records.required(["text", "source"]), short)).alias("i"))
    return found.groupBy("i.field", "i.code").agg(F.count("*").alias("n"))


#: Turns some of which break a rule: an unknown role, no content, a control token.
BROKEN = """select conv_id, turn, case when conv_id % 17 = 2 and turn % 4 = 1 then 'tool' else role end as role, case when conv_id % 13 = 1 and turn % 3 = 0 then '' when conv_id % 11 = 3 and turn % 2 = 0 then text || '<|im_end|>' else text end as text from conversations"""


def _broken(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    role = F.when((conv % 17 == 2) & (turn % 4 == 1), "tool").otherwise(F.col("role"))
    said = F.when((conv % 13 == 1) & (turn % 3 == 0), "").when((conv % 11 == 3) & (turn % 2 == 0), F.concat("text", F.lit("<|im_end|>"))).otherwise(F.col("text"))
    return chats.conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), said.alias("text")))


def _control(messages: str = "messages"):
    return F.exists(messages, lambda m: text.has_control(m.content))


@query(f"""with b as ({BROKEN}), m as (select *, row_number() over (partition by conv_id order by turn) - 1 as i from b)
select conv_id as line, 'messages[' || i || '].role' as field, 'invalid_role' as code from m where role not in ('system', 'user', 'assistant') union all select conv_id, 'messages[' || i || '].content', 'empty_content' from m where text = ''
union all select conv_id, 'messages', 'missing_assistant' from m group by conv_id having count_if(role = 'assistant') = 0""")
def validate_conversations(spark, sf_dir):
    chat = _broken(spark, sf_dir).select(F.col("conv_id").alias("line"), F.col("conv_id").cast("string").alias("id"), "messages")
    return records.issues(chat, "sft").select("line", "field", "code")


@query("select event_id as line, user_id as id, first_line from (select event_id, user_id, min(event_id) over (partition by user_id) as first_line from events) where event_id > first_line")
def duplicate_id_issues(spark, sf_dir):
    return records.duplicate_ids(table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.col("user_id").alias("id")))


@query("select event_id as line, 0 as seq, 'value' as field, 'too_small' as code from events where value < 5 order by event_id limit 100")
def issue_truncation(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("value < 5")
    return records.truncated(events.select(F.col("event_id").alias("line"), F.lit(0).alias("seq"), F.lit("value").alias("field"), F.lit("too_small").alias("code")), 100)


@query("select count(*) as records, count(*) - count_if(value < 5) as valid, count_if(value < 5) as invalid, count_if(value < 5) as issues from events")
def validation_report(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), "value")
    return records.report(events, events.filter("value < 5")).select("records", "valid", "invalid", "issues")


# --- identities and selection ---------------------------------------------------------------------------


@query(f"""select doc_id as line, sha256('repo' || chr(0) || 'rev' || chr(0) || 'train' || chr(0) || doc_id::varchar || chr(0) || {strip('text')}) as id
from documents where length({strip('text')}) >= 200 order by doc_id limit 300""")
def source_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), text.strip(F.col("text")).alias("text"))
    kept, _ = ordering.first_n(docs, "line", F.length("text") >= 200, 300)
    return kept.select("line", ident.keyed_digest("repo", "rev", "train", F.col("line"), F.col("text")).alias("id"))


@query(f"with k as (select doc_id from documents where length({strip('text')}) >= 200 order by doc_id limit 300) select count(*) as accepted, (select count(*) from documents where doc_id <= (select max(doc_id) from k)) - count(*) as skipped from k")
def source_prefix_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ordering.first_n(docs, "doc_id", F.length(text.strip(F.col("text"))) >= 200, 300)[1]


@query("""select conv_id, turn, sha256('{"role":"' || role || '","turn":' || turn::varchar || '}') as digest from conversations""")
def record_digests(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", ident.record_digest({"turn": F.col("turn"), "role": F.col("role")}).alias("digest"))


@query(f"select min(doc_id) as doc_id, sha256(body) as identity from ({NORMAL}) group by body")
def normalized_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("identity"))
    return ordering.first_wins(docs, ["identity"], "doc_id")


@query("select lang, doc_id, rank from (select lang, doc_id, row_number() over (partition by lang order by sha256('recipe' || chr(0) || doc_id::varchar), doc_id) as rank from documents) where rank <= 20")
def hash_rank_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", ident.keyed_digest("recipe", F.col("doc_id")).alias("key"))
    return ordering.top_k(docs, ["lang"], ["key", "doc_id"], 20).select("lang", "doc_id", "rank")


@query("select p_partkey, case when row_number() over (order by sha256(p_partkey::varchar), p_partkey) <= 100 then 'warm-up' else 'reserved' end as part from part")
def rank_partition(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.col("p_partkey").cast("string"), 256).alias("key"))
    last = parts.orderBy("key", "p_partkey").limit(100).agg(F.max(F.struct("key", "p_partkey")).alias("last"))
    within = F.struct("key", "p_partkey") <= F.col("last")
    return parts.crossJoin(F.broadcast(last)).select("p_partkey", F.when(within, "warm-up").otherwise("reserved").alias("part"))


@query("select lang, doc_id, row_number() over (partition by lang order by doc_id) as turn from documents")
def round_robin_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return ordering.interleaved(docs, "lang", ["doc_id"])


# --- conversations --------------------------------------------------------------------------------------

RENDERED = "string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn)"


@query(f"select conv_id, sha256({RENDERED}) as digest, sum(length(text) + length(role) + 24)::bigint as chars from conversations group by conv_id")
def chat_render(spark, sf_dir):
    chat = chats.conversations(table(spark, sf_dir, "conversations"))
    body = chats.rendered(F.col("messages"))
    return chat.select("conv_id", F.sha2(body, 256).alias("digest"), F.length(body).cast("long").alias("chars"))


@query(f"""with b as ({BROKEN}), s as (select *, case when first(role order by turn) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) = 'system' then 1 else 0 end as shift, row_number() over (partition by conv_id order by turn) - 1 as i from b)
select conv_id, case when bool_or(role not in ('system', 'user', 'assistant')) then 'role' when bool_or(text = '') then 'content' when bool_or(contains(text, '<|im_end|>')) then 'control' when bool_or(i >= shift and role <> (case when (i - shift) % 2 = 0 then 'user' else 'assistant' end)) then 'order' end as problem from s group by conv_id""")
def chat_grammar(spark, sf_dir):
    return _broken(spark, sf_dir).select("conv_id", records.chat_problem(F.col("messages"), _control()).alias("problem"))


@query(f"""with b as ({BROKEN}), s as (select *, case when first(role order by turn) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) = 'system' then 1 else 0 end as shift, row_number() over (partition by conv_id order by turn) - 1 as i from b),
c as (select conv_id, {RENDERED} as body, string_agg(role || chr(0) || {collapse('text')}, chr(0) order by turn) as identity, bool_or(text = '' or contains(text, '<|im_end|>') or role = 'tool' or (i >= shift and role <> (case when (i - shift) % 2 = 0 then 'user' else 'assistant' end))) as bad from s group by conv_id),
f as (select *, length(body) <= 4000 and not bad as ok from c)
select count(*) as candidates, count_if(not ok) as rejected, count(distinct case when ok then identity end) as kept, count_if(ok) - count(distinct case when ok then identity end) as duplicates from f""")
def sft_selection_counters(spark, sf_dir):
    problem = records.chat_problem(F.col("messages"), _control())
    return chats.selected(_broken(spark, sf_dir), "conv_id", 4000, problem)[1]


@query("select conv_id, sum(case when role = 'assistant' then length(text) + 1 else 0 end)::bigint as supervised, sum(length(text) + length(role) + 24)::bigint as tokens from conversations group by conv_id")
def assistant_supervision(spark, sf_dir):
    chat = chats.conversations(table(spark, sf_dir, "conversations"))
    return chat.select("conv_id", chats.supervised_length(F.col("messages")).alias("supervised"), F.length(chats.rendered(F.col("messages"))).cast("long").alias("tokens"))


@query("""with recursive n as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as parent from conversations),
leaf as (select conv_id, max(turn) as turn from conversations group by conv_id),
up as (select l.conv_id, l.turn as leaf, n.parent, 1 as depth from leaf l join n on n.conv_id = l.conv_id and n.turn = l.turn
union all select u.conv_id, u.leaf, n.parent, u.depth + 1 from up u join n on n.conv_id = u.conv_id and n.turn = u.parent)
select conv_id, leaf, depth from up where parent is null and depth <= 8""")
def message_chains(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    # Messages point to the one before; ids are made of conversation and turn.
    earlier = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).select("conv_id", F.posexplode("t").alias("i", "turn"), "t")
    nodes = earlier.select(F.struct("conv_id", "turn").alias("id"), F.when(F.col("i") > 0, F.struct("conv_id", F.get("t", F.col("i") - 1).alias("turn"))).alias("parent"))
    found = chats.chains(nodes)
    return found.select("id.conv_id", F.col("id.turn").alias("leaf"), F.size("path").alias("depth"))


@query("""with p as (select doc_id, text, quality = 1 as preferred, source from documents join labels using (doc_id) where quality is not null),
r as (select *, row_number() over (partition by source, preferred order by doc_id) as rank from p)
select a.source, a.rank, a.doc_id as chosen_id, b.doc_id as rejected_id from r a join r b on a.source = b.source and a.rank = b.rank and a.preferred and not b.preferred where a.text <> b.text""")
def preference_pairs(spark, sf_dir):
    judged = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", (F.col("quality") == 1).alias("preferred"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source").join(judged, "doc_id")
    return chats.preference_pairs(rows, ["source"], "doc_id").select("source", "rank", "chosen_id", "rejected_id")


@query("""with t as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as response, lead(turn) over w as next_turn, lag(turn) over w as earlier, max(turn) over (partition by conv_id) as last from conversations window w as (partition by conv_id order by turn))
select conv_id, sha256(text) as prompt, sha256(response) as response from t where role = 'user' and next_role = 'assistant' and next_turn = last and earlier is not null""")
def last_turns(spark, sf_dir):
    chat = chats.conversations(table(spark, sf_dir, "conversations")).withColumn("n", F.size("messages"))
    named = F.transform("messages", lambda m: F.concat(F.when(m.role == "user", "\n\nHuman: ").when(m.role == "assistant", "\n\nAssistant: ").otherwise("\n\nSystem: "), m.content))
    ends = F.get("messages", F.col("n") - 1).role == "assistant"
    found = chat.filter(ends).select("conv_id", chats.last_turn(F.array_join(named, "")).alias("t")).filter("t is not null")
    return found.select("conv_id", F.sha2("t.prompt", 256).alias("prompt"), F.sha2("t.response", 256).alias("response"))


@query(f"""with d as (select {SPLIT} as split, lang, case when n_chars < 500 then 'short_qa' when n_chars < 2000 then 'structured' else 'general' end as family, n_chars from documents)
select case when grouping(lang) = 1 then 'all' else lang end as lang, case when grouping(family) = 1 then 'all' else family end as family, split, count(*) as examples, sum(n_chars)::bigint as tokens
from d group by grouping sets ((split), (split, lang), (split, family), (split, lang, family))""")
def task_family_rollup(spark, sf_dir):
    docs = splits.with_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    task = F.when(F.col("n_chars") < 500, "short_qa").when(F.col("n_chars") < 2000, "structured").otherwise("open")
    sets = [["split"], ["split", "lang"], ["split", "family"], ["split", "lang", "family"]]
    named = docs.withColumn("family", chats.task_family(task))
    sums = named.groupingSets([[F.col(c) for c in s] for s in sets], "split", "lang", "family").agg(
        F.count("*").alias("examples"), F.sum("n_chars").alias("tokens"), F.grouping("lang").alias("gl"), F.grouping("family").alias("gf")
    )
    every = lambda c, g: F.when(F.col(g) == 1, "all").otherwise(F.col(c)).alias(c)
    return sums.select("split", every("lang", "gl"), every("family", "gf"), "examples", "tokens")


# --- source transforms ----------------------------------------------------------------------------------

REVISION = "0" * 40
RECIPE = "local"
PAIRS = """select a.conv_id * 1000 + a.turn as line, a.conv_id, a.turn, {prompt} as prompt, {answer} as answer
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'"""
PAIRS = PAIRS.format(prompt=strip("a.text"), answer=strip("b.text"))


def _source(transform: str) -> transforms.Source:
    return transforms.Source(transform.split("-")[0], transform, "local/tables", REVISION, "table.parquet")


def _joined(*parts: str) -> str:
    return "sha256(" + " || chr(0) || ".join(parts) + ")"


def _id_sql(view: str, identity: str, language: str) -> str:
    return _joined("'local/tables'", f"'{REVISION}'", view, identity, language)


def _json_digest(**fields: str) -> str:
    return "sha256('{' || " + " || ',' || ".join(f"'\"{k}\":' || to_json({fields[k]})" for k in sorted(fields)) + " || '}')"


def _pairs(spark, sf_dir):
    """A question and the answer after it. The turns of a conversation are neighbours by key."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    return asked.join(answers, ["conv_id", "turn"]).withColumn("line", F.col("conv_id") * 1000 + F.col("turn"))


def _said(df: DataFrame) -> DataFrame:
    return df.select("id", "source_id", "language", F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content)), "|"), 256).alias("dialogue"))


def _preferred(df: DataFrame) -> DataFrame:
    return df.select("id", "source_id", "language", F.sha2(F.concat_ws("|", "prompt", "chosen", "rejected"), 256).alias("pair"))


DOLLY = _json_digest(prompt=collapse("p"), response=collapse("r"))


@query(f"""with p as (select line, case turn % 3 when 0 then 'closed_qa' when 1 then 'classification' else 'summarization' end as task, case turn % 3 when 0 then 'short_qa' when 1 then 'classification' else 'general' end as family,
prompt || case when conv_id % 2 = 0 then chr(10) || chr(10) || 'Context:' || chr(10) || 'conversation ' || conv_id else '' end as q, answer as r from ({PAIRS}) where prompt <> '' and answer <> ''),
f as (select line, family, q || case when family = 'general' then '' else chr(10) || chr(10) || 'Reply with the answer only.' end as p, r from p where length(r) <= case family when 'classification' then 150 when 'short_qa' then 200 else 4000 end),
i as (select *, {DOLLY} as identity from f where length(p) + length(r) <= 4000 qualify row_number() over (partition by identity order by line) = 1),
k as (select *, {_id_sql("'sft'", "identity", "'en'")} as id, {_joined("'local'", "'dolly'", "family", "identity")} as key from i qualify row_number() over (partition by family order by key, id) <= case family when 'general' then 5 when 'classification' then 3 else 4 end)
select id, 'dolly:' || identity as source_id, 'en' as language, sha256('user:' || p || '|assistant:' || r) as dialogue from k""")
def transform_instructions(spark, sf_dir):
    config = {"general_records": 5, "classification_records": 3, "short_qa_records": 4, "classification_max_answer_characters": 150, "short_qa_max_answer_characters": 200, "max_characters": 4000}
    task = F.when(F.col("turn") % 3 == 0, "closed_qa").when(F.col("turn") % 3 == 1, "classification").otherwise("summarization")
    context = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("conversation "), "conv_id"))
    rows = _pairs(spark, sf_dir).select("line", F.col("prompt").alias("instruction"), context.alias("context"), F.col("answer").alias("response"), task.alias("category"))
    return _said(transforms.instructions(rows, _source("dolly-balanced-sft-v1"), RECIPE, config).records)


@query(f"""with i as (select line, prompt as p, answer as r, {_json_digest(prompt=collapse('prompt'), response=collapse('answer'))} as identity from ({PAIRS}) where prompt <> '' and answer <> '' and length(prompt) + length(answer) <= 2000 qualify row_number() over (partition by identity order by line) = 1),
k as (select *, {_id_sql("'sft'", "identity", "'zh'")} as id from i order by {_joined("'local'", "'hc3'", "identity")}, id limit 10)
select id, 'hc3:' || identity as source_id, 'zh' as language, sha256('user:' || p || '|assistant:' || r) as dialogue from k""")
def transform_first_answers(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("line", F.col("prompt").alias("question"), F.array("answer", "prompt").alias("human_answers"), F.lit(None).cast("string").alias("source"))
    return _said(transforms.first_answers(rows, _source("hc3-human-single-turn-sft-v1"), RECIPE, {"records": 10, "max_characters": 2000}).records)


PAIR = _json_digest(prompt=collapse("p"), chosen=collapse("c"), rejected=collapse("r"))


@query(f"""with b as (select line, case when conv_id % 2 = 0 then 'en' else 'zh' end as language, prompt as p, answer as a, {strip('reverse(answer)')} as z, turn % 4 - 1 as s from ({PAIRS}) where prompt <> '' and answer <> ''),
c as (select line, language, p, case when s < 0 then a else z end as c, case when s < 0 then z else a end as r from b where s <> 0 and a <> z and length(p) + greatest(length(a), length(z)) <= 3000),
i as (select *, {PAIR} as identity from c qualify row_number() over (partition by identity order by line) = 1),
k as (select *, {_id_sql("'dpo'", "identity", "language")} as id, {_joined("'local'", "'helpsteer3'", "language", "identity")} as key from i qualify row_number() over (partition by language order by key, id) <= case language when 'en' then 6 else 4 end)
select id, 'helpsteer3:' || identity as source_id, language, sha256(p || '|' || c || '|' || r) as pair from k""")
def transform_signed_preferences(spark, sf_dir):
    config = {"records_by_language": {"en": 6, "zh": 4}, "max_characters": 3000, "context_messages": 1}
    context = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    rows = _pairs(spark, sf_dir).select(
        "line",
        F.when(F.col("conv_id") % 2 == 0, "English").otherwise("CHINESE").alias("language"),
        F.lit(None).cast("string").alias("domain"),
        context.alias("context"),
        F.col("answer").alias("response1"),
        F.reverse("answer").alias("response2"),
        (F.col("turn") % 4 - 1).alias("overall_preference"),
    )
    return _preferred(transforms.signed_preferences(rows, _source("helpsteer3-single-turn-preference-v1"), RECIPE, config).records)


def _both_ways(name: str, language: str) -> str:
    return f"""with c as (select line, prompt as p, answer as c, {strip('reverse(answer)')} as r from ({PAIRS}) where prompt <> '' and answer <> ''),
i as (select *, {PAIR} as identity from c where c <> r and length(p) + greatest(length(c), length(r)) <= 3000 qualify row_number() over (partition by identity order by line) = 1),
k as (select *, {_id_sql("'dpo'", "identity", f"'{language}'")} as id from i order by {_joined("'local'", f"'{name}'", "identity")}, id limit 8)
select id, '{name}:' || identity as source_id, '{language}' as language, sha256(p || '|' || c || '|' || r) as pair from k"""


@query(_both_ways("hh", "en"))
def transform_transcript_preferences(spark, sf_dir):
    said = lambda answer: F.concat(F.lit("Start\n\nHuman: hello\n\nAssistant: yes\n\nHuman: "), "prompt", F.lit("\n\nAssistant: "), answer)
    rows = _pairs(spark, sf_dir).select("line", said(F.col("answer")).alias("chosen"), said(F.reverse("answer")).alias("rejected"))
    return _preferred(transforms.transcript_preferences(rows, _source("hh-helpful-single-turn-preference-v1"), RECIPE, {"records": 8, "max_characters": 3000}).records)


@query(_both_ways("cvalues", "zh"))
def transform_paired_preferences(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = _pairs(spark, sf_dir).select("line", "prompt", F.col("answer").alias("pos_resp"), F.reverse("answer").alias("neg_resp"), none.alias("pos_type"), none.alias("neg_type"))
    return _preferred(transforms.paired_preferences(rows, _source("cvalues-helpful-single-turn-preference-v1"), RECIPE, {"records": 8, "max_characters": 3000}).records)


@query(f"""with t as (select conv_id, turn, role, {strip('text')} as body, row_number() over (partition by conv_id order by turn) as i from conversations),
w as (select *, bool_and(body <> '' and role = case when i % 2 = 1 then 'user' else 'assistant' end) over h as sound, sum(length(body)) over h as chars,
string_agg(role || ':' || body, '|') over h as said, conv_id || '-' || turn as m, case when conv_id % 3 = 0 then 'zh' else 'en' end as language from t window h as (partition by conv_id order by turn)),
k as (select *, {_id_sql("'sft'", "m", "language")} as id, {_joined("'local'", "'oasst'", "language", "m")} as key from w where sound and role = 'assistant' and i <= 6 and chars <= 6000 qualify row_number() over (partition by language order by key, id) <= 7)
select id, 'oasst:' || conv_id as source_id, language, sha256(said) as dialogue from k""")
def transform_message_trees(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    each = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).select("conv_id", F.posexplode("t").alias("i", "turn"), "t")
    earlier = each.select("conv_id", "turn", F.when(F.col("i") > 0, F.concat_ws("-", "conv_id", F.get("t", F.col("i") - 1))).alias("parent_id"))
    rows = turns.join(earlier, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("line"),
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        "parent_id",
        F.col("conv_id").cast("string").alias("message_tree_id"),
        "text",
        F.when(F.col("role") == "user", "prompter").otherwise(F.col("role")).alias("role"),
        F.when(F.col("conv_id") % 3 == 0, "zh").otherwise("en").alias("lang"),
        F.lit(True).alias("review_result"),
        F.lit(False).alias("deleted"),
        F.lit(False).alias("synthetic"),
        F.lit(0).alias("rank"),
        F.lit("ready_for_export").alias("tree_state"),
    )
    config = {"records_per_language": 7, "max_messages": 6, "max_characters": 6000}
    return _said(transforms.message_trees(rows, _source("oasst-ranked-conversation-v1"), RECIPE, config).records)


LEAD, TURN = (x.replace("\n", "' || chr(10) || '") for x in transforms.ASK["en"])
COUNT, LABEL = (transforms.AS_JSON["en"][x].replace("\n", "' || chr(10) || '") for x in ("count", "label"))


@query(f"""with d as (select doc_id as line, {strip("text || ' This text has ' || n_chars || ' characters.'")} as t, case when doc_id % 2 = 0 then n_chars::varchar else {strip(f"substr({strip('text')}, 11, 12)")} end as a from documents),
q as (select *, 'What about ' || line || '?' as q, instr(t, a) - 1 as pos, length(t) as size, length(a) as n from d where a <> ''),
e as (select *, least(size, greatest(0, pos - greatest(0, (300 - n) // 2)) + 300) as r from q where pos >= 0),
p as (select line, q, a, '{LEAD}' || case when size <= 300 then t else substr(t, (greatest(0, r - 300) + 1)::bigint, (r - greatest(0, r - 300))::bigint) end || '{TURN}' || q as p from e),
i as (select *, {_json_digest(upstream_id="line::varchar", question=collapse('q'), answer=collapse('a'))} as identity, regexp_full_match(a, '[0-9]+') as whole from p),
v as (select *, 'short-qa' as view, p as p2, a as r2 from i union all by name
select *, case when whole then 'json-integer' else 'json-string' end as view, case when whole then '{COUNT}' else '{LABEL}' end || p as p2, case when whole then '{{"count":' || try_cast(a as bigint) || '}}' else '{{"label":' || to_json(a) || '}}' end as r2 from i),
k as (select *, {_id_sql("view", "identity", "'en'")} as id, {_joined("'local'", "'squad'", "view", "identity")} as key from v qualify row_number() over (partition by view order by key, id) <= case view when 'short-qa' then 30 when 'json-integer' then 20 else 10 end)
select id, 'squad:' || identity as source_id, 'en' as language, sha256('user:' || p2 || '|assistant:' || r2) as dialogue from k""")
def transform_extractive_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    answer = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")).otherwise(F.substring(text.strip(F.col("text")), 11, 12))
    rows = docs.select(
        F.col("doc_id").alias("line"),
        F.col("doc_id").alias("id"),
        F.concat(F.lit("What about "), "doc_id", F.lit("?")).alias("question"),
        F.concat("text", F.lit(" This text has "), "n_chars", F.lit(" characters.")).alias("context"),
        F.struct(F.array(answer).alias("text"), F.array(F.lit(-1)).alias("answer_start")).alias("answers"),
    )
    config = {"records": 30, "json_integer_records": 20, "json_string_records": 10, "max_context_characters": 300, "max_answer_characters": 100, "max_characters": 4000}
    return _said(transforms.extractive(rows, _source("squad-extractive-sft-v1"), RECIPE, config).records)


PART = _json_digest(query="q", m_query="m", equation="e", answer="a")


@query(f"""with p as (select {collapse('p_name')} as q, p_brand || ' ' || p_partkey as m, p_partkey || '+0' as e, p_size::varchar as a from part),
i as (select *, {PART} as identity from p), r as (select *, case when row_number() over (order by {_joined("'local'", "'msvamp'", "identity")}, identity) <= 50 then 'sft-warmup' else 'grpo' end as view from i),
l as (select *, 'en' as language, q as prompt from r union all by name select *, 'zh' as language, m as prompt from r)
select {_id_sql("view", "identity", "language")} as id, view as kind, language, prompt, a as answer from l""")
def transform_parallel_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("line"),
        F.col("p_name").alias("query"),
        F.concat_ws(" ", "p_brand", "p_partkey").alias("m_query"),
        F.concat("p_partkey", F.lit("+0")).alias("equation"),
        F.col("p_size").cast("double").alias("response"),
    )
    found = transforms.parallel_numbers(rows, _source("msvamp-parallel-integer-v1"), RECIPE, {"sft_warmup_groups": 50})
    content = lambda i: F.get("messages", F.lit(i)).content
    sft = found.sft.select("id", F.lit("sft-warmup").alias("kind"), "language", content(0).alias("prompt"), content(1).alias("answer"))
    return sft.unionByName(found.grpo.select("id", F.lit("grpo").alias("kind"), "language", "prompt", "answer"))


@query("select string_agg(distinct source, ' AND ' order by source) as licence, (select string_agg(lang, ',' order by f) from (select lang, min(doc_id) as f from documents group by lang)) as languages from documents")
def licence_expression(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    first = docs.groupBy("lang").agg(F.min("doc_id").alias("f")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "lang"))), lambda x: x.lang), ",").alias("languages"))
    names = docs.select("source").distinct().agg(F.array_join(F.array_sort(F.collect_list("source")), " AND ").alias("licence"))
    return names.crossJoin(first)


# --- packing --------------------------------------------------------------------------------------------

SPANS = "select doc_id, lang, source, text, coalesce(sum(length(text) + 2) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start, length(text) + 2 as n from documents"
TOTAL = f"with s as (select *, start + n as stop from ({SPANS})), t as (select max(stop) as tokens, ceil((max(stop) - 1) / 511.0)::bigint as examples, count(*) as documents from s)"
MEMBERS = TOTAL + f""", m as (select s.doc_id, s.lang, s.text, s.start, s.stop, unnest(range((greatest(s.start - 1, 0) // 511)::bigint, (least((s.stop - 1) // 511, t.examples - 1) + 1)::bigint)) as win from s, t),
p as (select *, greatest(start, win * 511) as lo, least(stop, win * 511 + {SIZE}) as hi from m)"""


def _spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("n", (F.length("text") + 2).cast("long"))
    return windows.spans(docs, "doc_id", "n")


@query(f"select doc_id, start, (start + n)::bigint as stop from ({SPANS})")
def pack_offsets(spark, sf_dir):
    return _spans(spark, sf_dir).select("doc_id", "start", "stop")


@query(TOTAL + " select documents, tokens::bigint as tokens, examples, (examples * 511 + 1 - tokens)::bigint as padding from t")
def pack_stats(spark, sf_dir):
    return windows.stats(_spans(spark, sf_dir), SIZE)


@query(MEMBERS + " select win as \"window\", count(*) as parts, sum(hi - lo)::bigint as tokens, min(lo)::bigint as first, max(hi)::bigint as last from p where hi > lo group by win")
def pack_windows(spark, sf_dir):
    members = windows.memberships(_spans(spark, sf_dir), SIZE)
    return members.groupBy("window").agg(F.count("*").alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("tokens"), F.min("lo").alias("first"), F.max("hi").alias("last"))


@query(MEMBERS + " select win as \"window\", sha256(string_agg(substr(chr(1) || text || chr(2), (lo - start + 1)::bigint, (hi - lo)::bigint), '' order by lo)) as digest from p where hi > lo group by win")
def pack_window_texts(spark, sf_dir):
    members = windows.memberships(_spans(spark, sf_dir), SIZE)
    marked = F.concat(F.lit("\x01"), F.col("text"), F.lit("\x02"))
    part = F.substring(marked, (F.col("lo") - F.col("start") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    rows = members.select("window", F.struct("lo", part.alias("t")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.t), "")
    return rows.groupBy("window").agg(F.sha2(joined, 256).alias("digest"))


@query(MEMBERS + """, c as (select win, case lang when 'en' then 0 when 'de' then 1 when 'fr' then 2 when 'es' then 3 else -1 end as code, sum(hi - lo)::bigint as n from p where hi > lo group by all)
select win as "window", arg_max(code, n * 100 - code) as code, max(n) as n from c group by win""")
def pack_language_strata(spark, sf_dir):
    code = F.lit(-1)
    for lang, i in CODES.items():
        code = F.when(F.col("lang") == lang, i).otherwise(code)
    members = windows.memberships(_spans(spark, sf_dir), SIZE)
    return windows.dominant(members.withColumn("code", code), "code")


# --- sampling -------------------------------------------------------------------------------------------

WEIGHTS = {"de": 0.125, "en": 0.5, "es": 0.125, "fr": 0.25}
WEIGHT = "(case lang when 'en' then 0.5::double when 'fr' then 0.25::double else 0.125::double end)"
STRATUM = "(case lang when 'de' then 0 when 'en' then 1 when 'es' then 2 else 3 end)"


@query(f"""select doc_id, lang, (coalesce(sum(n_chars) over (partition by lang order by sha256('7' || chr(0) || '0' || chr(0) || doc_id::varchar), doc_id rows between unbounded preceding and 1 preceding), 0) / {WEIGHT})::double as quota, {STRATUM}::integer as stratum_index from documents""")
def quota_sample_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.quota_order(docs, "lang", "n_chars", "doc_id", WEIGHTS, 7).select("doc_id", "lang", "quota", "stratum_index")


@query("select doc_id, lang, turn from (select doc_id, lang, row_number() over (partition by lang order by sha256(doc_id::varchar)) as turn from documents) order by turn, lang limit 50")
def stratified_subset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified(docs, "lang", F.col("doc_id").cast("string"), 50)


@query("""select epoch, doc_id, place, ((place - 1) // 64)::bigint as batch from (select epoch, doc_id, row_number() over (partition by epoch order by sha256('42' || chr(0) || epoch::varchar || chr(0) || doc_id::varchar), doc_id) as place
from documents, (select unnest(range(2))::integer as epoch))""")
def epoch_shuffle_batches(spark, sf_dir):
    return sampling.epoch_batches(table(spark, sf_dir, "documents"), "doc_id", 42, 2, 64)


@query("select lang, source, count(*) as n, round(1.0 / (select count(distinct lang) from documents) / count(*) over (partition by lang), 9) as weight from documents group by lang, source")
def balanced_weights(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return sampling.balanced_weights(counts, "lang").withColumn("weight", F.round("weight", 9))


@query("select event_id as step, round(case when event_id < 100 then (event_id + 1) / 100.0::double else 0.1::double + 0.9::double * 0.5 * (1 + cos(pi() * least(greatest((event_id - 100) / 9900.0::double, 0), 1))) end, 9) as factor from events")
def lr_schedule(spark, sf_dir):
    step = F.col("event_id")
    return table(spark, sf_dir, "events").select(step.alias("step"), F.round(schedule.lr_factor(step, 100, 10_000, 0.1), 9).alias("factor"))


@query("""with t as (select count(*) as examples, sum(n_chars)::bigint as tokens from documents), p as (select tokens / ceil(examples / 2.0) * 5 as per, tokens from t)
select 7::bigint as steps, ceil(7 * per)::bigint as target_tokens, ceil(7 * per)::bigint as estimated_tokens from p
union all select ceil(3 * tokens / per)::bigint, (3 * tokens)::bigint, ceil(ceil(3 * tokens / per) * per)::bigint from p""")
def budget_resolution(spark, sf_dir):
    t = table(spark, sf_dir, "documents").agg(F.count("*").alias("examples"), F.sum("n_chars").alias("tokens")).first()
    found = [schedule.budget(t.examples, t.tokens, 2, 5, steps=7), schedule.budget(t.examples, t.tokens, 2, 5, epochs=3)]
    return spark.createDataFrame([(b.steps, b.target_tokens, b.estimated_tokens) for b in found], "steps long, target_tokens long, estimated_tokens long")


# --- contamination --------------------------------------------------------------------------------------

HITS = f"select d.doc_id, b.item_id from ({NORMAL}) d join (select item_id, {collapse('text')} as q from benchmark) b on contains(d.body, b.q) where length(b.q) >= 24"


def _hits(spark, sf_dir):
    asked = contamination.queries(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return contamination.hits(table(spark, sf_dir, "documents"), "doc_id", "text", asked, "item_id")


@query(HITS)
def contamination_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"select doc_id from documents where doc_id not in (select doc_id from ({HITS}))")
def contamination_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(_hits(spark, sf_dir), "doc_id", "left_anti")


@query(f"select count(*) as items, (select count(distinct item_id) from ({HITS})) as matched, round((select count(distinct item_id) from ({HITS})) / nullif(count(*), 0)::double, 9) as share from benchmark")
def overlap_fractions(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("items"))
    matched = _hits(spark, sf_dir).agg(F.countDistinct("item_id").alias("matched"))
    return items.crossJoin(matched).withColumn("share", F.round(F.try_divide("matched", "items"), 9))


@query(f"with d as (select doc_id, {SPLIT} as split, sha256({collapse('text')}) as digest from documents) select doc_id, split, digest from d where split <> 'train' and digest in (select digest from d where split = 'train')")
def heldout_exact_overlap(spark, sf_dir):
    docs = splits.with_split(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split", F.sha2(text.normalize(F.col("text")), 256).alias("digest"))
    return contamination.exact_overlap(docs.filter("split <> 'train'"), docs.filter("split = 'train'")).select("doc_id", "split", "digest")


@query(f"with d as (select doc_id, lang, {SPLIT} as split from documents where n_chars >= 96) select doc_id, lang, split, probe from (select *, row_number() over (partition by split, lang order by doc_id) as probe from d where split <> 'dev') where probe <= 2")
def memory_probes(spark, sf_dir):
    docs = splits.with_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return contamination.probes(docs, ["split", "lang"], "doc_id", (F.col("n_chars") >= 96) & (F.col("split") != "dev")).select("doc_id", "lang", "split", "probe")


@query(f"""with h as ({HITS}), d as (select h.doc_id, h.item_id, {strip('d.text')} as t, {strip('b.text')} as a from h join documents d using (doc_id) join benchmark b using (item_id)),
p as (select *, instr(t, a) - 1 as pos, length(t) as size, length(a) as n from d where instr(t, a) > 0),
e as (select *, least(size, greatest(0, pos - greatest(0, (400 - n) // 2)) + 400) as r from p)
select doc_id, item_id, sha256(case when size <= 400 then t else substr(t, (greatest(0, r - 400) + 1)::bigint, (r - greatest(0, r - 400))::bigint) end) as excerpt from e""")
def extractive_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.strip(F.col("text")).alias("t"))
    items = table(spark, sf_dir, "benchmark").select("item_id", text.strip(F.col("text")).alias("a"))
    both = _hits(spark, sf_dir).join(docs, "doc_id").join(items, "item_id").withColumn("at", F.expr("locate(a, t)") - 1).filter("at >= 0")
    return both.select("doc_id", "item_id", F.sha2(text.excerpt(F.col("t"), F.col("at"), F.length("a"), 400), 256).alias("excerpt"))


@query(f"""with g as (select doc_id, string_split({collapse('text')}, ' ') as w from documents), t as (select doc_id, len(w) - 2 as n, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as grams from g)
select doc_id, round(case when n > 0 then (n - len(list_distinct(grams))) / n::double else 0 end, 9) as share from t""")
def repeated_trigrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(text.collapse(F.col("text")), " ").alias("w"))
    return docs.select("doc_id", F.round(text.repeated_share(F.col("w")), 9).alias("share"))


# --- metrics --------------------------------------------------------------------------------------------

LOG = "select event_id, event_type, user_id, value / 100 as loss, (user_id % 7 + 1) as tokens, (user_id % 5) as bytes from events"


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id", (F.col("value") / 100).alias("loss"), (F.col("user_id") % 7 + 1).alias("tokens"), (F.col("user_id") % 5).alias("bytes")
    )


@query(f"""select case when grouping(event_type) = 1 then 'all' else event_type end as event_type, sum(tokens)::bigint as tokens, round(sum(loss * tokens) / sum(tokens), 6) as loss,
round(exp(least(sum(loss * tokens) / sum(tokens), 20)), 6) as perplexity, round(case when sum(bytes) > 0 then sum(loss * tokens) / ln(2::double) / sum(bytes) end, 6) as bits_per_byte from ({LOG}) group by rollup (event_type)""")
def language_loss_buckets(spark, sf_dir):
    return evaluation.loss_rollup(_log(spark, sf_dir), "event_type")


@query(f"""with p as (select event_type, sum(loss * tokens) as nll, sum(tokens) as tokens from ({LOG}) group by event_type), t as (select sum(nll) / sum(tokens) as loss, sum(nll / tokens * tokens) / sum(tokens) as again, sum(case when event_type = 'view' then nll / 2 else nll end) / sum(tokens) as bad from p)
select name, isfinite(parts) and abs(loss - parts) <= greatest(1e-6::double * greatest(abs(loss), abs(parts)), 1e-6::double) as consistent, round(loss, 6) as loss from (select 'as recorded' as name, loss, again as parts from t union all select 'a language halved', loss, bad from t)""")
def loss_consistency(spark, sf_dir):
    per = _log(spark, sf_dir).groupBy("event_type").agg(F.sum(F.col("loss") * F.col("tokens")).alias("nll"), F.sum("tokens").alias("tokens"))
    halved = F.when(F.col("event_type") == "view", F.col("nll") / 2).otherwise(F.col("nll"))
    means = per.withColumn("mean", F.col("nll") / F.col("tokens"))
    sums = means.agg(F.sum("nll").alias("nll"), F.sum("tokens").alias("tokens"), F.sum(F.col("mean") * F.col("tokens")).alias("again"), F.sum(halved).alias("bad"))
    loss = F.col("nll") / F.col("tokens")
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col(c) / F.col("tokens")).alias("parts")) for n, c in (("as recorded", "again"), ("a language halved", "bad"))]))
    return sums.select(loss.alias("loss"), cases.alias("c")).select("c.name", evaluation.consistent(F.col("loss"), F.col("c.parts")).alias("consistent"), F.round("loss", 6).alias("loss"))


@query(f"""with v as (select event_type as name, loss as value, (user_id % 3)::double as baseline from ({LOG}) where event_type <> 'signup')
select e.name, round(avg(value), 6) as value, count(value) as count, round(avg(baseline), 6) as baseline, case when count(value) > 0 then 'ok' else 'not-checked' end as status from (select distinct event_type as name from events) e left join v using (name) group by e.name""")
def metric_rollup_with_baseline(spark, sf_dir):
    log = _log(spark, sf_dir)
    values = log.filter("event_type <> 'signup'").select(F.col("event_type").alias("name"), F.col("loss").alias("value"), (F.col("user_id") % 3).cast("double").alias("baseline"))
    return evaluation.metric_rollup(values, log.select(F.col("event_type").alias("name")).distinct())


@query("""with r as (select date_trunc('day', ts)::date::varchar as stage, event_type as name, avg(value) as value from events group by all),
f as (select name, arg_min(value, stage) as first from r group by name)
select stage, name, round(value, 6) as value, round(value - first, 6) as delta from r join f using (name)""")
def report_delta(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    reports = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("stage"), F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    return evaluation.report_deltas(reports, "stage")


@query("""select event_type, min(value) as best_loss, min(event_id) filter (where value = m) as best_step, arg_min(value, event_id) as baseline_loss, arg_max(value, event_id) as final_loss
from (select *, min(value) over (partition by event_type) as m from events) group by event_type""")
def best_checkpoint(spark, sf_dir):
    return evaluation.best_step(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_id", "value", ["event_type"])


@query("""select event_id, case when props = '{"k": ' || user_id::varchar || '}' then 1.0::double else 0.0::double end as score from events""")
def score_exact(spark, sf_dir):
    answer = F.concat(F.lit('{"k": '), F.col("user_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", evaluation.exact_score(F.col("props"), answer).alias("score"))


#: props are objects of one integer, of which the strict parser and SQL's see the same; hand cases are in the tests.
@query("""select event_id, (json_type(props) = 'OBJECT' and len(json_keys(props)) = 1 and json_type(props, '$.k') in ('UBIGINT', 'BIGINT') and (props::json ->> 'k') = user_id::varchar)::integer::double as score from events""")
def score_json(spark, sf_dir):
    answer = F.concat(F.lit('{"k":'), F.col("user_id").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", evaluation.json_score("props", answer).alias("score"))


@query("select event_type, round(avg(case when abs(value - 50) <= 1e-8 then 0.5 else (value > 50)::integer::double end), 9) as accuracy from events group by event_type")
def preference_accuracy(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.round(F.avg(evaluation.preference_score(F.col("value"), F.lit(50.0))), 9).alias("accuracy"))


# --- gates ----------------------------------------------------------------------------------------------


@query(f"""select 'unique-ids' as name, case when count(*) = count(distinct doc_id) then 'pass' else 'fail' end as status, (count(*) - count(distinct doc_id))::varchar as message from documents
union all select 'no-exact-copies', case when count(*) = count(distinct {collapse('text')}) then 'pass' else 'warn' end, (count(*) - count(distinct {collapse('text')}))::varchar from documents
union all select 'languages', case when count(distinct lang) >= 2 then 'pass' else 'fail' end, count(distinct lang)::varchar from documents""")
def gate_run_checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(text.collapse(F.col("text")), 256).alias("identity"))
    facts = docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.countDistinct("identity").alias("texts"), F.countDistinct("lang").alias("langs"))
    return gates.gate(
        gates.check(facts, "unique-ids", F.col("n") == F.col("ids"), F.col("n") - F.col("ids")),
        gates.check(facts, "no-exact-copies", F.col("n") == F.col("texts"), F.col("n") - F.col("texts"), warn=True),
        gates.check(facts, "languages", F.col("langs") >= 2, F.col("langs")),
    )


@query("select count_if(status = 'pass') as passed, count_if(status = 'warn') as warned, count_if(status = 'fail') as failed, count_if(status = 'fail') = 0 as ok from (select case when value < 1 then 'fail' when value < 5 then 'warn' else 'pass' end as status from events)")
def gate_status_counts(spark, sf_dir):
    status = F.when(F.col("value") < 1, "fail").when(F.col("value") < 5, "warn").otherwise("pass")
    return gates.status_counts(table(spark, sf_dir, "events").select(status.alias("status")))


@query("""with a as (select n_nationkey, n_name, n_regionkey::varchar as n_regionkey from nation where n_nationkey <> 3), b as (select n_nationkey, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) as n_name, (case when n_nationkey = 5 then 9 else n_regionkey end)::varchar as n_regionkey from nation)
select n_nationkey, 'n_name' as field, a.n_name as "left", b.n_name as "right" from a full join b using (n_nationkey) where a.n_name is distinct from b.n_name
union all select n_nationkey, 'n_regionkey', a.n_regionkey, b.n_regionkey from a full join b using (n_nationkey) where a.n_regionkey is distinct from b.n_regionkey""")
def manifest_field_diff(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    name = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)")))
    other = nation.select("n_nationkey", name.alias("n_name"), F.when(F.col("n_nationkey") == 5, 9).otherwise(F.col("n_regionkey")).alias("n_regionkey"))
    return gates.field_differences(nation.filter("n_nationkey <> 3"), other, "n_nationkey")


@query("select (select count(*) from (select o_custkey from orders except all select c_custkey from customer)) as missing, (select count(*) from (select c_custkey from customer except all select o_custkey from orders)) as unexpected")
def row_set_difference(spark, sf_dir):
    return gates.same_rows(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


def _part_sum(i: int) -> str:
    return f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::bigint)::hugeint::varchar"


@query(f"with r as (select {SPLIT} as split, sha256(doc_id::varchar || chr(0) || text) as d from documents) select split, count(*) as records, sha256(count(*)::varchar || ':' || {_part_sum(0)} || ':' || {_part_sum(1)} || ':' || {_part_sum(2)} || ':' || {_part_sum(3)}) as digest from r group by split")
def content_digest_per_split(spark, sf_dir):
    docs = splits.with_split(table(spark, sf_dir, "documents"), "doc_id").select("split", ident.keyed_digest(F.col("doc_id"), F.col("text")).alias("d"))
    return ident.content_digest(docs, ["split"], "d")


# --- streams --------------------------------------------------------------------------------------------


@query("select event_type, min(value) as best_loss, min(event_id) filter (where value = m) as best_step, count(*) as rows from (select *, min(value) over (partition by event_type) as m from events) group by event_type")
def metrics_stream_running_min(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = metrics.log_stream(spark, f"{sf_dir}/events.parquet*", schema)
    return metrics.run_once(metrics.running_best(stream, "event_type", "event_id", "value"), "complete")
