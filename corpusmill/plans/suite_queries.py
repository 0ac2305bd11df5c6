"""Records of several sources, their protocol, sampling, and the metrics of suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import chats, contamination, records, sampling, splits, suite
from corpusmill.plans.catalogue import HITS, STRATUM, WEIGHT, WEIGHTS
from corpusmill.plans.entries import SPLIT, collapse, query, strip, table

# --- records --------------------------------------------------------------------------------------------

PAIR = """select a.event_id as line, a.event_type || ' ' || a.user_id as id, case when a.event_id % 7 = 0 then ' ' else a.event_type end as prompt, a.user_id::varchar as chosen,
case when a.event_id % 5 = 0 then ' ' || a.user_id || ' ' else a.event_type end as rejected from events a"""


@query(f"""with p as ({PAIR}), f as (select id, min(line) as first from p group by id)
select line, 'prompt' as field, 'missing_or_empty' as code from p where prompt = ' ' union all select line, 'rejected', 'identical_pair' from p where {strip('chosen')} = {strip('rejected')}
union all select line, 'id', 'duplicate_id' from p join f using (id) where line > first""")
def dpo_issues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pairs = e.select(
        F.col("event_id").alias("line"),
        F.concat_ws(" ", "event_type", "user_id").alias("id"),
        F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_type")).alias("prompt"),
        F.col("user_id").cast("string").alias("chosen"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(" "), "user_id", F.lit(" "))).otherwise(F.col("event_type")).alias("rejected"),
    )
    return records.issues(pairs, "dpo").select("line", "field", "code")


@query("""select event_id as line, 'metadata' as field, 'invalid_metadata' as code from events where event_id % 9 in (0, 1, 2) union all select event_id, 'answer', 'missing_or_empty' from events where event_id % 4 = 0""")
def grpo_issues(spark, sf_dir):
    i = F.col("event_id")
    metadata = F.when(i % 9 == 0, "[1]").when(i % 9 == 1, "3").when(i % 9 == 2, '{"k": ').when(i % 9 == 3, None).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(i.alias("line"), i.cast("string").alias("id"), F.col("event_type").alias("prompt"), F.when(i % 4 != 0, "x").alias("answer"), metadata.alias("metadata"))
    return records.issues(rows, "grpo").select("line", "field", "code")


@query("""select conv_id, turn from conversations where turn % 3 <> 0 and not regexp_matches(text, '<\\|(pad|bos|eos|unk|im_start|im_end)\\|>')""")
def control_token_filter(spark, sf_dir):
    said = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" <|im_end|>"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").filter(~text.has_control(said)).select("conv_id", "turn")


def _turns(spark, sf_dir):
    """Conversations up to their last answer, with a control token in the middle of some."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    said = F.when((F.col("conv_id") % 11 == 3) & (F.col("turn") == F.col("last")), F.concat("text", F.lit("<|eos|>"))).otherwise(F.col("text"))
    return turns.join(last, "conv_id").filter((F.col("conv_id") % 13 == 0) | (F.col("turn") <= F.col("last"))).withColumn("text", said).drop("last")


TURNS = """with l as (select conv_id, max(turn) as last from conversations where role = 'assistant' group by conv_id),
t as (select conv_id, turn, role, case when conv_id % 11 = 3 and turn = last then text || '<|eos|>' else text end as text from conversations join l using (conv_id) where conv_id % 13 = 0 or turn <= last),
s as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, case when first(role order by turn) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) = 'system' then 1 else 0 end as shift from t),
c as (select conv_id, sum(length(text) + length(role) + 24) as n, arg_max(role, turn) as last, bool_or(regexp_matches(text, '<\\|(pad|bos|eos|unk|im_start|im_end)\\|>')) as control, bool_or(text = '') as blank,
bool_or(i >= shift and role <> (case when (i - shift) % 2 = 0 then 'user' else 'assistant' end)) as misplaced, string_agg(role || chr(0) || """ + collapse("text") + """, chr(0) order by turn) as identity from s group by conv_id)"""
SOURCES = TURNS + """, r as (select conv_id::varchar as id, 'first' as source, case when conv_id % 2 = 0 then 'en' else 'zh' end as language, conv_id % 10 = 0 as synthetic, * exclude (conv_id) from c
union all select 'x' || conv_id, 'second', 'en', false, * exclude (conv_id) from c where conv_id % 3 = 0),
o as (select *, not synthetic and last = 'assistant' and not control and not blank and not misplaced and n <= 4000 as ok from r), k as (select identity, arg_min(source, id) as source, arg_min(language, id) as language, min(id) as id from o where ok group by identity)"""


def _selected(spark, sf_dir):
    chat = chats.conversations(_turns(spark, sf_dir))
    first = chat.select(F.col("conv_id").cast("string").alias("id"), F.when(F.col("conv_id") % 2 == 0, "en").otherwise("zh").alias("language"), "messages", (F.col("conv_id") % 10 == 0).alias("synthetic"))
    second = chat.filter("conv_id % 3 = 0").select(F.concat(F.lit("x"), "conv_id").alias("id"), F.lit("en").alias("language"), "messages", F.lit(False).alias("synthetic"))
    control = F.exists("messages", lambda m: text.has_control(m.content))
    return chats.selected_sources({"first": first, "second": second}, 4000, F.length(chats.rendered(F.col("messages"))), control)


@query(SOURCES + " select id, source, language from k")
def selection_of_sources(spark, sf_dir):
    return _selected(spark, sf_dir)[0].select("id", "source", "language")


@query(SOURCES + " select count(*) as candidates, count_if(not ok) as rejected, (select count(*) from k) as kept, count_if(ok) - (select count(*) from k) as duplicates from o")
def selection_counters(spark, sf_dir):
    return _selected(spark, sf_dir)[1]


@query(SOURCES + " select source, language, count(*) as records from k group by all")
def selection_counts(spark, sf_dir):
    return _selected(spark, sf_dir)[2]


PROTOCOL = TURNS + """, r as (select case when conv_id % 4 = 0 then 'dev' else 'train' end as split, conv_id::varchar as id, case when conv_id % 6 = 1 then 'none' when conv_id % 6 = 2 then 'left:' when conv_id % 6 = 5 then 'out:' || conv_id else 'in:' || conv_id end as source_id,
case when conv_id % 17 = 0 then 'fr' else 'en' end as language, case when conv_id % 6 = 3 then 'b' else 'a' end as transform, conv_id % 19 = 0 as synthetic, c.* from c), f as (select *, min(row(split, id)) over (partition by identity) as first from r)
select split, id, case when language = 'fr' then 'language' when source_id = 'none' or source_id = 'left:' then 'source_id has no prefix' when transform <> 'a' then 'transform differs' when blank then 'chat: content' when control then 'chat: control' when misplaced then 'chat: order'
when last <> 'assistant' then 'ends without answer' when n > 3000 then 'too long' when row(split, id) <> first then 'repeated dialogue' when synthetic then 'synthetic' when source_id like 'out:%' then 'excluded source' end as error from f where error is not null"""


@query(PROTOCOL)
def conversation_protocol(spark, sf_dir):
    chat, i = chats.conversations(_turns(spark, sf_dir)), F.col("conv_id")
    prefix = F.when(i % 6 == 1, "none").when(i % 6 == 2, "left:").when(i % 6 == 5, F.concat(F.lit("out:"), i)).otherwise(F.concat(F.lit("in:"), i))
    rows = chat.select(
        F.when(i % 4 == 0, "dev").otherwise("train").alias("split"),
        i.cast("string").alias("id"),
        prefix.alias("source_id"),
        F.when(i % 17 == 0, "fr").otherwise("en").alias("language"),
        F.when(i % 6 == 3, "b").otherwise("a").alias("transform"),
        F.lit("local").alias("uri"),
        (i % 19 == 0).alias("synthetic"),
        "messages",
    )
    declared = spark.createDataFrame([("in", "a", "local", False), ("out", "a", "local", True)], "source string, transform string, uri string, excluded boolean")
    control = F.exists("messages", lambda m: text.has_control(m.content))
    return chats.protocol_errors(rows, declared, ["en", "zh"], F.length(chats.rendered(F.col("messages"))), 3000, control)


# --- contamination --------------------------------------------------------------------------------------

FORBIDDEN = f"with h as (select distinct doc_id from ({HITS})), g as (select source from documents where lang = 'es' group by source having count(*) >= 3)"


@query(FORBIDDEN + " select doc_id, case when doc_id in (select doc_id from h) then 'passage' else 'group' end as reason from documents where doc_id in (select doc_id from h) or source in (select source from g)")
def forbidden_overlap(spark, sf_dir):
    """Training records that hold a passage of the benchmark, or belong to a group that is kept out."""
    docs = table(spark, sf_dir, "documents")
    asked = contamination.queries(table(spark, sf_dir, "benchmark"), "item_id", "text")
    groups = docs.filter("lang = 'es'").groupBy("source").count().filter("count >= 3").select("source")
    return contamination.forbidden(docs, "doc_id", "text", "source", asked, "item_id", groups)


@query(f"""with d as (select doc_id, lang, {SPLIT} as split, sha256({collapse('text')}) as digest, n_chars from documents), h as ({HITS})
select (select count(*) from d where split <> 'train') as held_out, (select count(*) from d where split <> 'train' and digest in (select digest from d where split = 'train')) as exact,
(select count(distinct item_id) from h) as items, (select count(*) from h) as hits, (select count(*) from (select row_number() over (partition by split, lang order by doc_id) as r from d where split <> 'dev' and n_chars >= 96) where r <= 2) as probes""")
def corpus_report(spark, sf_dir):
    docs = splits.with_split(table(spark, sf_dir, "documents"), "doc_id")
    asked = contamination.queries(table(spark, sf_dir, "benchmark"), "item_id", "text")
    probes = contamination.probes(docs, ["split", "lang"], "doc_id", (F.col("n_chars") >= 96) & (F.col("split") != "dev"))
    return contamination.report(docs, "doc_id", "text", asked, "item_id", probes)


@query("select source, lang in ('es', 'fr') as allowed from (select distinct source, lang from documents where lang in ('es', 'de')) where lang = 'es' union all select source, false from (select distinct source, lang from documents) where lang = 'de'")
def policy_intersection(spark, sf_dir):
    """Sources by language with whether a policy's list has them: rows of both, and those to be kept out."""
    rows = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    allowed = rows.filter(F.col("lang").isin("es", "fr"))
    asked = rows.filter(F.col("lang").isin("es", "de"))
    both = asked.intersect(allowed).select("source", F.lit(True).alias("allowed"))
    return both.unionByName(asked.exceptAll(allowed).select("source", F.lit(False).alias("allowed")))


# --- sampling -------------------------------------------------------------------------------------------

EPOCHS = """select epoch, doc_id, place, ((place - 1) // 64)::bigint as batch from (select epoch, doc_id, row_number() over (partition by epoch order by sha256('42' || chr(0) || epoch::varchar || chr(0) || doc_id::varchar), doc_id) as place
from documents, (select unnest(range(2))::integer as epoch))"""


@query(f"select * from ({EPOCHS}) where epoch > 0 or batch >= 2")
def epoch_resume(spark, sf_dir):
    return sampling.resumed(sampling.epoch_batches(table(spark, sf_dir, "documents"), "doc_id", 42, 2, 64), 0, 2)


def _family(n: str) -> str:
    return f"case when {n} < 500 then 'short_qa' when {n} < 2000 then 'structured' else 'general' end"


@query(f"""with f as (select {_family('n_chars')} as family, count(*) as examples, sum(n_chars)::double as tokens from documents group by 1), w as (select family, examples, tokens, case family when 'general' then 0.5::double else 0.25::double end as weight from f),
m as (select 1 / sum(weight / (tokens / examples)) as mean, sum(examples) as examples from w) select family, weight, round(mean, 6) as mean_tokens, round(m.examples * mean)::bigint as epoch_tokens from w, m""")
def sampling_resolution(spark, sf_dir):
    family = F.when(F.col("n_chars") < 500, "short_qa").when(F.col("n_chars") < 2000, "structured").otherwise("general")
    counts = table(spark, sf_dir, "documents").groupBy(family.alias("f"), "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("t")).collect()  # a row a stratum
    strata = {f"{r.f}.{r.lang}": (r.n, r.t) for r in counts}
    families = {f: (sum(r.n for r in counts if r.f == f), sum(r.t for r in counts if r.f == f)) for f in {r.f for r in counts}}
    found = sampling.resolved({"general": 2, "short_qa": 1, "structured": 1}, families, strata)
    rows = [(k, w, round(found["mean_tokens"], 6), found["epoch_tokens"]) for k, w in found["weights"].items()]
    return spark.createDataFrame(rows, "family string, weight double, mean_tokens double, epoch_tokens long")


ORDERED = f"""select doc_id, n_chars, (coalesce(sum(n_chars) over (partition by lang order by sha256('7' || chr(0) || '0' || chr(0) || doc_id::varchar), doc_id rows between unbounded preceding and 1 preceding), 0) / {WEIGHT})::double as quota, {STRATUM} as stratum from documents"""


@query(f"select count(*) as samples, sum(n_chars)::bigint as tokens from (select n_chars from ({ORDERED}) order by quota, stratum limit 120)")
def predicted_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.predicted_tokens(docs, "lang", "n_chars", "doc_id", WEIGHTS, 7, 120)


@query(f"""with n as (select lang, sum(n_chars) as t from documents group by lang), need as (select (2 * min(t) + 100)::bigint as need from n), e as (select max(ceil(need * {WEIGHT} / t) + 1)::bigint as epochs from n, need),
o as (select doc_id, lang, epoch, n_chars, (coalesce(sum(n_chars) over (partition by lang order by epoch, sha256('7' || chr(0) || epoch::varchar || chr(0) || doc_id::varchar), doc_id rows between unbounded preceding and 1 preceding), 0) / {WEIGHT})::double as quota, {STRATUM} as s
from documents, (select unnest(range(epochs)) as epoch from e)), r as (select doc_id, lang, epoch, coalesce(sum(n_chars) over (order by quota, s, epoch, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as seen from o)
select doc_id, lang, epoch::integer as epoch, seen from r, need where seen < need""")
def recycled_quota_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    least = docs.groupBy("lang").agg(F.sum("n_chars").alias("t")).agg(F.min("t").alias("t")).first().t
    found = sampling.recycled(docs, "lang", "n_chars", "doc_id", WEIGHTS, 7, 2 * least + 100)
    return found.select("doc_id", "lang", "epoch", F.col("seen").cast("long").alias("seen"))


# --- metrics --------------------------------------------------------------------------------------------


@query("select event_id, case when event_id % 3 = 0 then 'text ' || event_id when event_id % 3 = 1 then 'ask ' || event_id || chr(10) || 'again ' || event_id else 'ask ' || event_id end as text from events")
def case_texts(spark, sf_dir):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "corpus").when(i % 3 == 1, "multiturn").otherwise("qa")
    turns = F.array(F.struct(F.concat(F.lit("ask "), i).alias("prompt")), F.struct(F.concat(F.lit("again "), i).alias("prompt")))
    return table(spark, sf_dir, "events").select("event_id", suite.case_text(kind, F.concat(F.lit("text "), i), F.concat(F.lit("ask "), i), turns).alias("text"))


@query("select event_id, case when event_id % 4 = 0 then 0.0::double else round(1.0::double / (event_id % 4 + 1), 9) end as baseline from events")
def rule_baselines(spark, sf_dir):
    choices = F.transform(F.sequence(F.lit(0), F.col("event_id") % 4), lambda i: F.concat(F.lit("c"), i))
    rule = F.when(F.col("event_id") % 4 == 0, '{"type": "exact", "answer": "c0"}').otherwise(F.to_json(F.struct(F.lit("exact").alias("type"), choices.alias("choices"))))
    return table(spark, sf_dir, "events").select("event_id", F.round(suite.baseline(rule), 9).alias("baseline"))


@query("select conv_id, bool_and(length(text) > 40)::integer::double as correct from conversations where role = 'assistant' group by conv_id")
def all_turns_correct(spark, sf_dir):
    scores = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", (F.length("text") > 40).cast("double").alias("score"))
    return suite.all_correct(scores, ["conv_id"])


@query("""with v as (select event_type as name, value, (user_id % 3)::double as baseline, case when event_type = 'view' or user_id % 2 = 0 then 'rule' else 'random' end as kind, 'd' || user_id % 2 as description from events)
select name, round(avg(value), 6) as value, count(value) as count, round(avg(baseline), 6) as baseline, case when count(distinct kind) > 1 then 'mixed' else min(kind) end as kind, string_agg(distinct description, ' | ' order by description) as descriptions from v group by name""")
def mixed_baselines(spark, sf_dir):
    kind = F.when((F.col("event_type") == "view") | (F.col("user_id") % 2 == 0), "rule").otherwise("random")
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"), "value", (F.col("user_id") % 3).cast("double").alias("baseline"), kind.alias("kind"), F.concat(F.lit("d"), F.col("user_id") % 2).alias("description")
    )
    return suite.merged_baselines(e).withColumn("value", F.round("value", 6)).withColumn("baseline", F.round("baseline", 6))


@query("select metric, count(*) as n, round(avg(length(text)), 6) as value from (select text, unnest(['chars', 'chars.' || lang]) as metric from documents) group by metric")
def fine_and_rolled_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("chars").alias("name"), "lang", F.length("text").alias("v"))
    return suite.fine_and_rolled(docs, "name", "lang").groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("value"))


REPORTS = "select date_trunc('day', ts)::date as stage, event_type as name, count(*) as count, case when event_type = 'view' and date_trunc('day', ts)::date = (select min(ts)::date from events) then 'down' else 'up' end as direction from events group by all"


@query(f"""with r as ({REPORTS}), p as (select name, count(distinct stage) as n, count(distinct count) as counts, count(distinct direction) as ways from r group by name)
select name, case when n < (select count(distinct stage) from r) then 'metric sets differ' else 'denominators differ' end as problem from p where n < (select count(distinct stage) from r) or counts > 1 or ways > 1""")
def incomparable_reports(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("stage", F.to_date("ts"))
    first = events.agg(F.min("stage").alias("first"))
    direction = F.when((F.col("event_type") == "view") & (F.col("stage") == F.col("first")), "down").otherwise("up")
    rows = events.crossJoin(F.broadcast(first)).groupBy("stage", F.col("event_type").alias("name"), direction.alias("direction")).agg(F.count("*").alias("count"))
    return suite.comparable(rows, "stage")


@query("select name, round(value, 6) as value, count, direction, status from (select event_type as name, avg(value) as value, count(*) as count, 'up' as direction, 'ok' as status from events group by event_type)")
def metric_envelopes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n")).collect()  # a row a metric
    made = [(r.event_type, suite.metric(r.v, r.n, "up", {"kind": "rule", "value": 0.0, "description": "empty"})) for r in rows]
    df = spark.createDataFrame([(k, m["value"], m["count"], m["direction"], m["status"]) for k, m in made], "name string, value double, count long, direction string, status string")
    return df.withColumn("value", F.round("value", 6))


