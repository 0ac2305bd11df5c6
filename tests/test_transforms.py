"""Source transforms on small rows with known results, and their selections."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import transforms as T

REV = "a" * 40


def source(transform, name="s"):
    return T.Source(name, transform, "org/set", REV, "f.json")


def sha(*parts):
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def test_integer_answer(spark):
    cases = {"12": "12", " 12.0 ": "12", "-0": "0", "+007": "7", "1_000": "1000", "1e3": "1000", "12.5": None, "1.5e1": "15", ".0": "0", "１２": "12", "x": None, "": None, None: None, "9" * 60: "9" * 60, "1,000": None, "NaN": None, "-3.": "-3"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string").select("*", T.integer_answer(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.got != r.want] == []


def test_instructions(spark):
    rows = [
        (1, " Name it ", None, "one", "open_qa"),
        (2, "Name  it", "", "one ", "open_qa"),  # the same once normalized
        (3, "Which?", "a or b", "a", "classification"),
        (4, "Which?", "a or b", "a" * 30, "classification"),  # answer too long
        (5, "Hm", None, "<|eos|>", "open_qa"),
        (6, None, None, "x", "open_qa"),
        (7, "Sum", None, "y", "unknown"),
        (8, "Find", "in c", "c", "closed_qa"),
    ]
    df = spark.createDataFrame(rows, "line long, instruction string, context string, response string, category string")
    config = {"strategy": T.RANK, "general_records": 1, "classification_records": 1, "short_qa_records": 1, "classification_max_answer_characters": 10, "short_qa_max_answer_characters": 10, "max_characters": 200}
    got = {r.metadata.task: r for r in T.apply(df, source("dolly-balanced-sft-v1"), "r", config)["sft"].collect()}
    assert set(got) == {"open_qa", "classification", "closed_qa"}
    assert got["classification"].messages[0].content == "Which?\n\nContext:\na or b\n\nReply with the answer only."
    assert got["open_qa"].messages[0].content == "Name it"
    identity = hashlib.sha256(b'{"prompt":"Name it","response":"one"}').hexdigest()
    assert got["open_qa"].source_id == "s:" + identity and got["open_qa"].id == sha("org/set", REV, "sft", identity, "en")
    with pytest.raises(T.SelectionError, match="s.general has 1 of 2"):
        T.apply(df, source("dolly-balanced-sft-v1"), "r", config | {"general_records": 2})


def test_selection_takes_the_least_keys(spark):
    df = spark.createDataFrame([(i, f"q{i}", [f"a{i}", "other"], None) for i in range(20)], "line long, question string, human_answers array<string>, source string")
    got = T.apply(df, source("hc3-human-single-turn-sft-v1"), "r", {"strategy": T.RANK, "records": 5, "max_characters": 50})["sft"].collect()
    ids = {i: hashlib.sha256(f'{{"prompt":"q{i}","response":"a{i}"}}'.encode()).hexdigest() for i in range(20)}
    least = sorted(ids.values(), key=lambda d: sha("r", "s", d))[:5]
    assert {r.source_id for r in got} == {"s:" + d for d in least}
    assert {r.metadata.task for r in got} == {"open_qa"}


def test_extractive_views(spark):
    rows = [
        (1, "a", "How many?", "there are 12 eggs", (["12"], [10])),
        (2, "b", "Which?", '  the "red" one', (['"red"'], [0])),  # the start is wrong and found again
        (3, "c", "Where?", "nowhere", (["gone"], None)),
        (4, "a", "How  many?", "there are 12 eggs", (["12"], None)),  # the first one again
        (5, "d", "How many?", "there are 12 eggs", (["12"], None)),  # another id, the same dialogue
        (6, None, "q", "c", (["c"], None)),
        (7, "e", "q", "c", None),
    ]
    df = spark.createDataFrame(rows, "line long, id string, question string, context string, answers struct<text: array<string>, answer_start: array<int>>")
    config = {"strategy": T.RANK, "records": 2, "json_integer_records": 1, "json_string_records": 1, "max_context_characters": 400, "max_answer_characters": 20, "max_characters": 400}
    got = {(r.metadata.upstream_id, r.metadata.task): [m.content for m in r.messages] for r in T.apply(df, source("squad-extractive-sft-v1"), "r", config)["sft"].collect()}
    assert set(got) == {(i, t) for i in "ab" for t in ("short_qa", "structured")}
    assert got["a", "structured"][1] == '{"count":12}' and got["b", "structured"][1] == '{"label":"\\"red\\""}'
    assert got["b", "short_qa"][0].endswith('Context:\nthe "red" one\n\nQuestion:\nWhich?')


def test_preferences(spark):
    row = lambda n, p, lang="English", context=(("user", "q"),), one="x", two="y": (n, lang, None, [*context], one, two, p)
    rows = [row(1, -2), row(2, 1, "CHINESE"), row(3, 0), row(4, None), row(5, 1, "French"), row(6, 1, context=(("user", "a"), ("user", "b"))), row(7, 1, context=(("assistant", "a"),)), row(8, 3, one=" x", two="x"), row(9, -1), row(10, 1, context=())]
    schema = "line long, language string, domain string, context array<struct<role: string, content: string>>, response1 string, response2 string, overall_preference int"
    df = spark.createDataFrame(rows, schema)
    config = {"strategy": T.RANK, "records_per_language": 1, "max_characters": 100, "context_messages": 1, "nonzero_preference": True}
    got = sorted((r.language, r.prompt, r.chosen, r.rejected, r.metadata.preference_strength) for r in T.apply(df, source("helpsteer3-single-turn-preference-v1"), "r", config)["dpo"].collect())
    assert got == [("en", "q", "x", "y", 2.0), ("zh", "q", "y", "x", 1.0)]


def test_transcripts(spark):
    a, b = "\n\nHuman: hi\n\nAssistant: yo\n\nHuman: q\n\nAssistant: good", "\n\nHuman: hi\n\nAssistant: yo\n\nHuman:  q \n\nAssistant: bad"
    rows = [(1, a, b), (2, a, a), (3, a, "\n\nHuman: z\n\nAssistant: bad"), (4, None, b), (5, a, "no turn")]
    df = spark.createDataFrame(rows, "line long, chosen string, rejected string")
    got = T.apply(df, source("hh-helpful-single-turn-preference-v1"), "r", {"strategy": T.RANK, "records": 1, "max_characters": 99})["dpo"].collect()
    assert [(r.prompt, r.chosen, r.rejected) for r in got] == [("q", "good", "bad")]


def test_message_trees(spark):
    good = dict(review_result=True, deleted=False, synthetic=False, rank=0, tree_state="ready_for_export", lang="en")
    rows = []

    def add(i, parent, role, text="t", **more):
        v = good | more
        rows.append((len(rows), i, parent, "tree", text, role, v["lang"], v["review_result"], v["deleted"], v["synthetic"], v["rank"], v["tree_state"]))

    add("a", None, "prompter", " hello "), add("b", "a", "assistant"), add("c", "b", "prompter"), add("d", "c", "assistant")
    add("e", "c", "assistant", rank=1), add("f", "d", "prompter"), add("g", "f", "assistant")  # too long a chain
    add("h", "missing", "assistant"), add("i", "a", "assistant", deleted=True), add("j", "i", "prompter"), add("k", "j", "assistant")
    add("l", "m", "assistant"), add("m", "l", "prompter")  # a cycle
    add("n", None, "assistant"), add("o", "a", "assistant", lang="zh"), add("p", "a", "assistant", text=None), add(None, "a", "assistant")
    add("y", None, "prompter", lang="zh"), add("z", "y", "assistant", lang="zh"), add("q", "a", "assistant", rank=None)
    schema = "line long, message_id string, parent_id string, message_tree_id string, text string, role string, lang string, review_result boolean, deleted boolean, synthetic boolean, rank int, tree_state string"
    df = spark.createDataFrame(rows, schema)
    config = {"strategy": T.RANK, "records_per_language": 1, "max_messages": 4, "max_characters": 100, "require_all_assistant_rank_zero": True}
    outcome = T.message_trees(df, source("oasst-ranked-conversation-v1"), "r", config)
    got = {r.metadata.upstream_message_id: [(m.role, m.content) for m in r.messages] for r in outcome.candidates.collect()}
    assert set(got) == {"b", "d", "z"}
    assert got["d"] == [("user", "hello"), ("assistant", "t"), ("user", "t"), ("assistant", "t")]
    with pytest.raises(T.SelectionError, match="occurs 2 times"):
        T.apply(df.union(df.filter("message_id = 'a'")), source("oasst-ranked-conversation-v1"), "r", config)


def test_parallel_numbers(spark):
    df = spark.createDataFrame([(i, f"q{i}", f"m{i}", "e", float(i)) for i in range(6)], "line long, query string, m_query string, equation string, response double")
    config = {"strategy": "stable-hash-partition", "expected_groups": 6, "sft_warmup_groups": 2}
    got = T.apply(df, source("msvamp-parallel-integer-v1"), "r", config)
    sft, grpo = got["sft"].collect(), got["grpo"].collect()
    assert len(sft) == 4 and len(grpo) == 8 and not {r.source_id for r in sft} & {r.source_id for r in grpo}
    assert len({r.id for r in sft + grpo}) == 12 and {r.language for r in sft} == {"en", "zh"}
    for bad in (df.union(df.limit(1)), df.withColumn("response", F.col("response") + 0.5), df.filter("line > 0")):
        with pytest.raises(T.SelectionError):
            T.apply(bad, source("msvamp-parallel-integer-v1"), "r", config)


def test_selections():
    single = {"strategy": T.RANK, "records": 1, "max_characters": 1}
    assert T.check_selection("dolly-single-turn-sft-v1", single) == []
    assert T.check_selection("dolly-single-turn-sft-v1", single | {"records": True}) and T.check_selection("dolly-single-turn-sft-v1", single | {"more": 1})
    assert T.check_selection("none", {}) and T.check_selection("hc3-human-single-turn-sft-v1", single | {"strategy": "x"})
    steer = {"strategy": T.RANK, "max_characters": 1, "context_messages": "last-user", "nonzero_preference": True}
    assert T.check_selection("helpsteer3-single-turn-preference-v1", steer | {"records_by_language": {"en": 1, "zh": 2}}) == []
    assert T.check_selection("helpsteer3-single-turn-preference-v1", steer | {"records_by_language": {"en": 1}}) and T.check_selection("helpsteer3-single-turn-preference-v1", steer)
    trees = {"strategy": T.RANK, "records_per_language": 1, "max_messages": 3, "max_characters": 1, "require_all_assistant_rank_zero": True}
    assert T.check_selection("oasst-ranked-conversation-v1", trees) == ["max_messages must be even"]
    qa = single | {"json_integer_records": 0, "json_string_records": 0, "max_context_characters": 1, "max_answer_characters": 1}
    assert T.check_selection("squad-extractive-sft-v1", qa) == ["a structured view is due"]
    parallel = {"strategy": "stable-hash-partition", "expected_groups": 2, "sft_warmup_groups": 2}
    assert T.check_selection("msvamp-parallel-integer-v1", parallel) == ["the warm-up must leave a group"]


def test_empty_rows(spark):
    df = spark.createDataFrame([], "line long, prompt string, pos_resp string, neg_resp string, pos_type string, neg_type string")
    config = {"strategy": T.RANK, "records": 1, "max_characters": 9}
    assert T.apply(df, source("cvalues-helpful-single-turn-preference-v1"), "r", config, strict=False)["dpo"].count() == 0
