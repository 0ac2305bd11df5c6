"""Files, manifests, gates, suites, tokens and streams: what holds, and what tampering breaks."""

import hashlib
import json
import math
import os

import pytest
from compare import TABLES, connection, differences
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import chats, contamination, evaluation, gates, records, sampling, suite, tokenization
from corpusmill.plans import ENTRIES
from corpusmill.sources import files
from corpusmill.streaming import metrics


def lines(folder, name, *rows):
    path = folder / name
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def test_line_numbers_of_files_in_stretches(spark, tmp_path):
    path = lines(tmp_path, "long.jsonl", *[json.dumps({"id": i}) if i % 1000 else "[1]" for i in range(1, 20_001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        rows, issues = files.strict_jsonl(spark, path, "id long", most=5)
        assert [r.line for r in issues.collect()] == [1000, 2000, 3000, 4000, 5000]
        assert rows.filter("id <> line").count() == 0 and rows.count() == 19_980
        with pytest.raises(ValueError, match="line 1000 "):
            files.plain_jsonl(spark, path, "id long")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_plain_lines_let_nan_through(spark, tmp_path):
    path = lines(tmp_path, "a.jsonl", '{"x": NaN}', "", '{"x": 1.5}')
    assert sorted(math.isnan(r.x) for r in files.plain_jsonl(spark, path, "x double").collect()) == [False, True]
    with pytest.raises(ValueError):
        files.metrics_log(spark, lines(tmp_path, "b.jsonl", '{"x": 1}', "3"), "x double")


def test_published_tables_notice_every_change(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "train" if i % 3 else "dev") for i in range(20)], "id long, text string, split string")
    place = str(tmp_path / "out")
    manifest = files.publish(df, place, {"licence": "x"}, by="split")
    assert manifest["records"] == 20 and manifest["parts"]["dev"]["records"] == 7
    assert files.load_published(spark, place)[0].count() == 20
    with pytest.raises(FileExistsError):
        files.publish(df, place, {})
    changed = df.withColumn("text", F.when(F.col("id") == 3, "other").otherwise(F.col("text")))
    for i, bad in enumerate((changed, df.filter("id <> 3"), df.union(df.limit(1)), df.withColumnRenamed("text", "body"))):
        copy = str(tmp_path / f"copy{i}")
        files.publish(df, copy, {})
        bad.write.mode("overwrite").parquet(f"{copy}/data")
        with pytest.raises(ValueError):
            files.load_published(spark, copy)
    with pytest.raises(Exception, match="no number"):
        files.publish(df.withColumn("x", F.raise_error(F.lit("no number"))), str(tmp_path / "none"), {})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["copy0", "copy1", "copy2", "copy3", "out"]


def test_pinned_files(spark, tmp_path):
    path = tmp_path / "blob"
    path.write_bytes(os.urandom(3 * files.CHUNK + 17))
    sha = hashlib.sha256(path.read_bytes()).hexdigest()
    assert files.digest_of(spark, str(path)) == (path.stat().st_size, sha) and files.pinned(spark, str(path), sha)
    with pytest.raises(ValueError):
        files.pinned(spark, str(path), "0" * 64)


def test_mappings_logs_and_reports(spark, tmp_path):
    files.dump_mapping({"id": "b", "é": 1}, tmp_path / "b.json")
    files.dump_mapping({"id": "a"}, tmp_path / "a.json")
    assert [m["id"] for m in files.catalogue(tmp_path, "id")] == ["a", "b"] and "é" in (tmp_path / "b.json").read_text(encoding="utf-8")
    with pytest.raises(FileExistsError):
        files.claim(tmp_path / "a.json", {})
    assert files.update_status(tmp_path / "a.json", "completed") == {"id": "a", "status": "completed"} == files.load_mapping(tmp_path / "a.json")
    assert files.frozen(tmp_path / "f.json", {"x": 1}) == files.frozen(tmp_path / "f.json", {"x": 1})
    with pytest.raises(ValueError, match="x"):
        files.frozen(tmp_path / "f.json", {"x": 2})
    files.append_metric(tmp_path / "log.jsonl", {"step": 1})
    files.append_metric(tmp_path / "log.jsonl", {"step": 2})
    with pytest.raises(ValueError):
        files.append_metric(tmp_path / "log.jsonl", {"step": math.nan})
    assert files.metrics_log(spark, str(tmp_path / "log.jsonl"), "step long").count() == 2
    files.write_report(tmp_path / "report", {"m": 1}, [{"m": 0.5}, {"m": None}, {"m": 1e-6}], ["m"])
    assert "| 0.500000 |\n| unchecked |\n| 1.0000e-06 |" in (tmp_path / "report/report.md").read_text()
    with pytest.raises(FileExistsError):
        files.write_report(tmp_path / "report", {}, [], ["m"])
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.load_mapping(tmp_path / "c.json")


def test_paths_stay_below_their_root(tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    assert files.safe_relative("real/x", tmp_path) == "real/x"
    for bad in ("/x", "../x", "a/../../x", ""):
        with pytest.raises(ValueError):
            files.safe_relative(bad, tmp_path)
    with pytest.raises(ValueError):
        files.safe_relative("link/x", tmp_path)


def test_training_texts(spark):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    assert sorted(files.training_texts(df)) == ["a", "b"]
    with pytest.raises(ValueError):
        list(files.training_texts(df.union(spark.createDataFrame([(" ",)], "text string"))))


def test_metadata_and_roles(spark):
    rows = [(1, "a", "p", "x", '{"k": [1]}'), (2, "b", "p", "x", None), (3, "c", "p", "x", "[1]"), (4, "d", "p", "x", "{"), (5, "e", " ", None, '"s"')]
    df = spark.createDataFrame(rows, "line long, id string, prompt string, answer string, metadata string")
    got = {(r.line, r.code) for r in records.issues(df, "grpo").collect()}
    assert got == {(3, "invalid_metadata"), (4, "invalid_metadata"), (5, "invalid_metadata"), (5, "missing_or_empty")}


# --- gates ----------------------------------------------------------------------------------------------


def test_mappings_are_told_apart():
    a = {"x": {"y": 1, "z": True}, "w": []}
    assert gates.differing(a, {"x": {"y": 1, "z": True}, "w": []}) == []
    assert gates.differing(a, {"x": {"y": 1.0, "z": 1}}) == ["w", "x.y", "x.z"]
    assert gates.differing(a, {"x": {"y": 2}}, ["x"]) == ["x.y", "x.z"]


def test_failures_skip_what_comes_after(spark):
    def boom():
        raise AssertionError

    good = lambda: gates.said(spark, "a", True, "g", "b")
    bad = lambda: gates.said(spark, "b", False, "g", "b")
    found = gates.staged(spark, [("a", good), ("b", bad), ("c", boom)])
    assert [(r.name, r.status) for r in found.collect()] == [("a", "pass"), ("b", "fail"), ("c", "skipped")]
    assert gates.exit_code(found) == 1 and gates.exit_code(good()) == 0


LOG = "line long, event string, step long, train_loss double, gradient_norm double, eval_loss double, eval_en_loss double"


def log_rows(final=1.0, en=1.0, norm=0.5):
    return [(1, "baseline", 0, None, None, 4.0, 4.0), (2, "step", 1, 3.0, norm, None, None), (3, "step", 2, 2.0, 0.5, 1.0, 1.0), (4, "step", 3, 1.0, 0.5, final, en)]


@pytest.mark.parametrize("change,failed", [({}, set()), ({"final": 1.03}, {"near-best"}), ({"final": 2.5}, {"near-best", "halved"}), ({"en": 4.5}, {"improves-eval_en_loss"}), ({"norm": math.inf}, {"finite-metrics"}), ({"en": math.nan}, {"finite-metrics", "improves-eval_en_loss"})])
def test_only_what_regresses_fails(spark, change, failed):
    facts = gates.metrics_facts(spark.createDataFrame(log_rows(**change), LOG), ["eval_loss", "eval_en_loss"])
    assert {r.name for r in gates.acceptance(facts, ["eval_loss", "eval_en_loss"], 3).collect() if r.status == "fail"} == failed


def test_a_log_without_its_baseline_first(spark):
    rows = [(9, *r[1:]) if r[1] == "baseline" else r for r in log_rows()]
    facts = gates.metrics_facts(spark.createDataFrame(rows, LOG), ["eval_loss"])
    assert {r.name for r in gates.acceptance(facts, ["eval_loss"], 4).collect() if r.status == "fail"} == {"baseline-first", "final-step"}

EVENTS = "event_id long, user_id long, value double"
STEPS = [(0, 1, 1.28), (10, 1, 0.5), (20, 1, 0.53)]


@pytest.mark.parametrize(
    "events",
    [
        [*STEPS, (30, 1, 0.0), (40, 1, 2.0)],  # infinite beside its best
        [*STEPS, (30, 1, 0.0)],  # no number beside its best
        [*STEPS, (30, 1, -2.0), (40, 1, -0.0)],
        [(0, 1, 0.64), (10, 1, 0.041)],  # a quotient of 0.0640625
        [(0, 1, 2.0), (10, 1, 1.9999999)],
        [(0, 1, 2.0), (10, 1, 1.0), (20, 1, math.nan)],
        [(0, 1, 3.0), (0, 1, 2.0), (0, 1, None), (10, 1, 1.0)],
        [(0, 1, 3.0)],
        [],
    ],
)
def test_acceptance_of_odd_logs_is_its_sql(spark, sf_dir, tmp_path, events):
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("gate_acceptance", "gate_acceptance_tampered"):
        assert differences(ENTRIES[name].query(spark, str(tmp_path)), connection(str(tmp_path)).sql(ENTRIES[name].sql)) == ""


def test_a_budget_of_nothing_is_its_sql(spark, sf_dir, tmp_path):
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    spark.createDataFrame([(1, 4), (2, 6)], "doc_id long, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(ENTRIES["gate_budget"].query(spark, str(tmp_path)), connection(str(tmp_path)).sql(ENTRIES["gate_budget"].sql)) == ""



def test_machine_checks(spark, tmp_path):
    found = {r.name: r.status for r in gates.doctor(spark, str(tmp_path), packages={"pyspark": None, "no-such-package": None, "numpy": "0.0.1"}, free_gib=1e9).collect()}
    assert found == {"python": "pass", "package-pyspark": "pass", "package-no-such-package": "fail", "package-numpy": "fail", "write": "pass", "disk": "warn"}
    assert {r.name: r.status for r in gates.doctor(spark, str(tmp_path / "none")).collect()}["write"] == "fail"
    now = gates.runtime_facts()
    frozen = {"python": now["python"], "packages": {"numpy": now["packages"]["numpy"] + "+local"}}
    assert gates.frozen_runtime(spark, frozen, now).first().status == "pass"
    assert gates.frozen_runtime(spark, frozen | {"python": "2.7.1"}, now).first().status == "fail"
    assert gates.clean_worktree(spark, str(tmp_path)).first().status == "fail"


def test_digests_against_recorded_ones(spark):
    rows = spark.createDataFrame([("a", "1" * 64), ("a", "2" * 64), ("b", "3" * 64)], "part string, d string")
    recorded = gates.content_digest(rows, ["part"], "d").select("part", "digest")
    assert all(r.matches for r in gates.digest_chain(rows, recorded, "part", "d").collect())
    assert {r.part: r.matches for r in gates.digest_chain(rows.limit(2), recorded, "part", "d").collect()} == {"a": True, "b": False}


# --- suites and scores ----------------------------------------------------------------------------------

CASES = [
    {"id": "1", "group": "g", "language": "en", "kind": "qa", "prompt": "p", "rule": {"type": "exact", "answer": "a", "choices": ["a", "b"]}},
    {"id": "2", "group": "g", "language": "zh", "kind": "multiturn", "turns": [{"prompt": "x", "rule": {"type": "json", "answer": {"k": 1}}}] * 2},
    {"id": "3", "group": "g", "language": "zh", "kind": "preference", "prompt": "p", "chosen": "c", "rejected": "d"},
    {"id": "4", "group": "g", "language": "en", "kind": "corpus", "text": "t"},
    {"id": "5", "group": "g", "language": "en", "kind": "continuation", "prompt": "p"},
]
SUITE = {"suite_id": "s", "license": "l", "description": "d", "cases": CASES}


def test_suites(spark):
    cases = suite.load_suite(spark, SUITE)
    shown = {r.id: (r.t, r.b) for r in cases.select("id", suite.case_text(F.col("kind"), F.col("text"), F.col("prompt"), F.col("turns")).alias("t"), suite.baseline(F.col("rule")).alias("b")).collect()}
    assert shown == {"1": ("p", 0.5), "2": ("x\nx", 0.0), "3": ("p", 0.0), "4": ("t", 0.0), "5": ("p", 0.0)}


@pytest.mark.parametrize("change", [
    {"cases": []}, {"license": " "}, {"cases": CASES + CASES[:1]}, {"cases": CASES[:1]}, {"cases": [*CASES, CASES[3] | {"id": "6", "text": "a <|eos|>"}]},
    {"cases": [*CASES, CASES[0] | {"id": "6", "rule": {"type": "exact", "answer": "z", "choices": ["a", "b"]}}]}, {"cases": [*CASES, CASES[2] | {"id": "6", "rejected": "c"}]},
    {"cases": [*CASES, CASES[1] | {"id": "6", "turns": CASES[1]["turns"][:1]}]}, {"cases": [*CASES, CASES[0] | {"id": "6", "rule": {"type": "json", "answer": {"k": math.nan}}}]}, {"cases": [*CASES, CASES[0] | {"id": "6", "kind": "poem"}]},
])
def test_broken_suites(spark, change):
    with pytest.raises(ValueError):
        suite.load_suite(spark, SUITE | change)


def test_metric_values():
    assert suite.metric(None, 0, "up", {"value": 0.0}, "not-checked")["status"] == "not-checked"
    for value, count, base in ((math.inf, 1, 0.0), (1.0, -1, 0.0), (1.0, 1, math.nan)):
        with pytest.raises(ValueError):
            suite.metric(value, count, "up", {"value": base})


@pytest.mark.parametrize("a,b,same", [
    ('{"a": 1, "b": [true]}', '{"b":[true],"a":1}', True), ('{"a": 1}', '{"a": 1.0}', False), ('{"a": true}', '{"a": 1}', False), ('{"a": 1, "a": 1}', '{"a": 1}', False),
    ('{"a": NaN}', '{"a": NaN}', False), ('{"a": 1e999}', '{"a": 1e999}', False), (None, "{}", False), ("{}", "{}", True), ('{"a": "\\u00e9"}', '{"a": "é"}', True), ("[" * 3000, "[" * 3000, False),
])
def test_same_json(a, b, same):
    assert evaluation.same_json(a, b) is same


# --- tokens ---------------------------------------------------------------------------------------------


def test_windows_rebuild_the_stream(spark):
    docs = spark.createDataFrame([(i, "wörd " * i, "en" if i % 2 else "zh") for i in range(12)], "id long, text string, lang string")
    streamed = tokenization.document_stream(docs, "text", "lang", tokenization.Bytes())
    stream = [x for r in sorted(streamed.collect()) for x in r.ids]
    rows = tokenization.examples(streamed, "id", 16).orderBy("window").collect()
    rebuilt = [rows[0].input_ids[0]] + [x for r in rows for x, on in list(zip(r.input_ids, r.attention_mask))[1:] if on]
    assert rebuilt == stream and all(len(r.input_ids) == 16 for r in rows)
    last = rows[-1]
    valid = sum(last.attention_mask)
    assert last.labels[valid:] == [-100] * (16 - valid) and last.language_ids[valid:] == [-1] * (16 - valid) and set(rows[3].language_ids) <= {0, 1}
    assert sum(r.source_bytes for r in rows) == sum(len(("wörd " * i).encode()) for i in range(12))
    facts = tokenization.packing_facts(streamed, 16).first()
    assert facts.examples == len(rows) and facts.source_tokens == len(stream) and facts.padding == 16 - valid


def test_vocabulary_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizer = tokenization.Vocabulary(public.path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(1, "hello world", "en"), (2, "", "en"), (3, None, "fr")], "id long, text string, lang string")
    rows = {r.id: r for r in tokenization.document_stream(docs, "text", "lang", tokenizer).collect()}
    assert len(rows[1].ids) == 4 and rows[1].ids[0] == tokenization.BOS and rows[2].ids == [tokenization.BOS, tokenization.EOS] and rows[3].language_id == -1
    assert docs.filter("id = 1").select(tokenizer.decode(tokenizer.encode(F.col("text"))).alias("t")).first().t.strip() == "hello world"


def test_label_spans(spark):
    chat = spark.createDataFrame([([("user", "hi"), ("assistant", "yo"), ("user", "x")],), ([("user", "hi")],)], "messages array<struct<role:string,content:string>>")
    rows = chat.select(tokenization.chat_example(F.col("messages"), tokenization.Bytes()).alias("x"), "messages").select("x.*", tokenization.chat_problem(F.col("messages"), F.col("x"), 99).alias("p"), tokenization.supervised(F.col("x.labels")).alias("n")).collect()
    first = rows[0]
    answer = [b + tokenization.SPECIAL for b in b"yo"] + [tokenization.END]
    at = [i for i, x in enumerate(first.labels) if x != -100]
    assert [first.labels[i] for i in at] == answer == [first.ids[i] for i in at] and first.n == 3
    assert bytes(i - tokenization.SPECIAL for i in first.ids if i >= tokenization.SPECIAL) == b"user\nhi\nassistant\nyo\nuser\nx\n"
    assert first.p == "ends_without_answer" and rows[1].n == 0


# --- sampling, selection, contamination, streams --------------------------------------------------------


def test_sampling_weights_cover_all():
    families = {"a": (10, 100), "b": (10, 300)}
    strata = {"a.en": (10, 100), "b.en": (5, 100), "b.zh": (5, 200)}
    found = sampling.resolved({"a": 1, "b": 1}, families, strata)
    assert found["weights"] == {"a": 0.5, "b": 0.5} and found["mean_tokens"] == pytest.approx(1 / (0.5 / 10 + 0.5 / 30)) and found["epoch_tokens"] == 300
    assert sampling.resolved({k: 1 for k in strata}, families, strata)["by"] == "stratum" and sampling.resolved(None, families, strata)["epoch_tokens"] == 400
    for bad in ({"a": 1}, {"a": 1, "b": 0}, {"a": 1, "b": math.nan}, {"a": 1, "b": True}, {"a": 1, "b": 1, "c": 1}):
        with pytest.raises(ValueError):
            sampling.resolved(bad, families, strata)


def test_normalized_duplicates_across_sources(spark):
    schema = "id string, language string, messages array<struct<role:string,content:string>>, synthetic boolean"
    wide = [("user", "Ｈｅｌｌｏ  x"), ("assistant", "ok")]
    a = spark.createDataFrame([("a", "en", [("user", "Hello x"), ("assistant", "ok")], False), ("s", "en", [("user", "q"), ("assistant", "r")], True), ("long", "en", [("user", "q"), ("assistant", "r" * 600)], None)], schema)
    b = spark.createDataFrame([("b", "zh", wide, None)], schema)
    length = F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(m.content))
    kept, counters, counts = chats.selected_sources({"one": a, "two": b}, 512, length, F.lit(False))
    assert [r.id for r in kept.collect()] == ["a"] and [tuple(r) for r in counts.collect()] == [("one", "en", 1)]
    c = counters.first()
    assert (c.candidates, c.rejected, c.kept, c.duplicates) == (4, 2, 1, 1)


@pytest.mark.parametrize("few", [64, 0])
def test_queries_of_any_words_are_found(spark, monkeypatch, few):
    monkeypatch.setattr(contamination, "FEW", few)
    long = "x" * 30
    texts = [f"a{long}b", f"one {long} two three", "alpha beta gamma delta epsilon zeta", "lpha beta gamma delta epsilon ze", f"Ｆｕｌｌ  width {long}", "none", None, ""]
    asked = [f"{long}", f"e {long} tw", "pha beta gamma delta epsilon z", "ull width " + long, "beta gamma delta epsilon zeta", "not there at all, anywhere here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string")
    queries = contamination.queries(spark.createDataFrame(list(enumerate(asked)), "q long, text string"), "q", "text")
    got = {(r.d, r.q) for r in contamination.hits(docs, "d", "text", queries, "q").collect()}
    import unicodedata

    plain = [" ".join(unicodedata.normalize("NFKC", t or "").split()) for t in texts]
    assert got == {(i, j) for i, t in enumerate(plain) for j, q in enumerate(asked) if q in t} and len(got) >= 7


def test_contamination_plans_have_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "some words of a text that is long enough")], "d long, text string")
    asked = contamination.queries(docs.withColumnRenamed("d", "q"), "q", "text")
    plan = contamination.hits(docs, "d", "text", asked, "q")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_repeated_share_is_exact(spark):
    rows = [(["a", "b", "c", "a", "b", "c"],), (["a"] * 5,), (["a b", "c"],), ([],), (["x", "y", "z"],)]
    got = [r.s for r in spark.createDataFrame(rows, "w array<string>").select(text.repeated_share(F.col("w")).alias("s")).collect()]
    assert got == [0.25, pytest.approx(2 / 3), 0.0, 0.0, 0.0]


def test_streams_keep_state(spark, tmp_path):
    schema = "id string, t timestamp, stratum string, place long, tokens long"
    for i in range(2):
        rows = [(f"r{k % 3}", f"2024-01-01 00:00:0{k}", "en" if k % 2 else "de", k + 10 * i, 5) for k in range(4)]
        spark.createDataFrame(rows, "id string, t string, stratum string, place long, tokens long").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = metrics.log_stream(spark, f"{tmp_path}/in", schema)
    assert sorted(r.id for r in metrics.run_once(metrics.first_seen(stream, "id", "t", "1 hour"), "append", f"{tmp_path}/c1").collect()) == ["r0", "r1", "r2"]
