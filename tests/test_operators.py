"""Invariants of the operators and differential tests against plain Python."""

import hashlib
import json
import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import ident, schedule, text
from corpusmill.operators import chats, contamination, evaluation, gates, ordering, records, sampling, splits, windows
from corpusmill.sources import files
from corpusmill.streaming import metrics


def test_whitespace_agrees_with_python(spark):
    chars = [chr(c) for c in range(1, 0x3100)]
    rows = [(i, f"a{c} b{c}") for i, c in enumerate(chars)] + [(-1, " 　x  "), (-2, None)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", "t", text.strip(F.col("t")).alias("s"), text.collapse(F.col("t")).alias("c"), text.normalize(F.col("t")).alias("n"))
    for r in df.collect():
        if r.t is None:
            assert r.s is None and r.n is None
            continue
        assert r.s == r.t.strip() and r.c == " ".join(r.t.split())
        assert r.n == " ".join(unicodedata.normalize("NFKC", r.t).split())


def test_identities(spark):
    df = spark.createDataFrame([("bé", 3, None)], "x string, n int, z string")
    row = df.select(ident.record_digest({"x": F.col("x"), "n": F.col("n")}), ident.unit_score(42, F.col("x")), ident.keyed_digest("k", F.col("z"))).first()
    assert row[0] == hashlib.sha256(json.dumps({"n": 3, "x": "bé"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert row[1] == int.from_bytes(hashlib.sha256("42\0bé".encode()).digest()[:8], "big") / 2**64
    assert row[2] is None


def test_split_is_order_free_and_disjoint(spark):
    rows = [(f"r{i}", f"g{i // 2}") for i in range(60)]
    a = {r.id: r.split for r in splits.with_split(spark.createDataFrame(rows, "id string, g string"), "g").collect()}
    b = {r.id: r.split for r in splits.with_split(spark.createDataFrame(rows[::-1], "id string, g string"), "g").collect()}
    assert a == b and all(a[f"r{i}"] == a[f"r{i + 1}"] for i in range(0, 60, 2))
    assert splits.leakage(splits.with_split(spark.createDataFrame(rows, "id string, g string"), "g"), "g").count() == 0


def test_round_robin(spark):
    df = spark.createDataFrame([("zh", i) for i in range(4)] + [("en", i) for i in range(2)], "lang string, i int")
    got = [r.lang for r in ordering.interleaved(df, "lang", ["i"]).orderBy("turn", "lang").collect()]
    assert got == ["en", "zh", "en", "zh", "zh", "zh"]


def test_offsets_cross_buckets(spark):
    rng = random.Random(3)
    rows = [(i * 97, rng.randint(0, 9)) for i in range(500)]
    got = {r.i: r.offset for r in ordering.offsets(spark.createDataFrame(rows, "i long, n long"), "i", "n").collect()}
    at = 0
    for i, n in rows:
        assert got[i] == at
        at += n


def test_first_wins_and_first_n(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, None), (5, None)], "i int, k string")
    assert sorted(r.i for r in ordering.first_wins(df, ["k"], "i").collect()) == [1, 2, 4]
    kept, counts = ordering.first_n(df, "i", F.col("k").isNotNull() & (F.col("i") != 1), 1)
    assert [r.i for r in kept.collect()] == [2] and tuple(counts.first()) == (1, 1)


def test_validators(spark):
    chat = spark.createDataFrame(
        [(1, "a", [("user", "hi"), ("assistant", "yo")]), (2, "a", []), (3, "b", [("robot", " ")]), (4, "c", None)],
        "line long, id string, messages array<struct<role:string,content:string>>",
    )
    got = {(r.line, r.field, r.code) for r in records.issues(chat, "sft").collect()}
    assert got == {
        (2, "messages", "invalid_messages"), (2, "id", "duplicate_id"), (4, "messages", "invalid_messages"),
        (3, "messages[0].role", "invalid_role"), (3, "messages[0].content", "empty_content"), (3, "messages", "missing_assistant"),
    }
    pairs = spark.createDataFrame([(1, "x", "p", "a ", "a"), (2, "x", "p", "a", "")], "line long, id string, prompt string, chosen string, rejected string")
    assert {r.code for r in records.issues(pairs, "dpo").collect()} == {"identical_pair", "duplicate_id", "missing_or_empty"}


def test_chat_grammar(spark):
    cases = [
        ([("system", "s"), ("user", "u"), ("assistant", "a")], None), ([("user", "u"), ("system", "s")], "order"), ([("assistant", "a")], "order"),
        ([("user", "")], "content"), ([("bot", "x")], "role"), ([], "empty"),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m array<struct<role:string,content:string>>")
    got = {r.i: r.p for r in df.select("i", records.chat_problem(F.col("m"), F.lit(False)).alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(cases)}
    body = df.filter("i = 0").select(chats.rendered(F.col("m"), prompt=True)).first()[0]
    assert body.startswith("<|im_start|>system\ns<|im_end|>\n") and body.endswith("<|im_start|>assistant\n")


def test_chains_leave_out_cycles_and_dangling_parents(spark):
    rows = [("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r.id: r.path for r in chats.chains(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert got == {"b": ["r", "a", "b"]}


def test_last_turn(spark):
    cases = ["q\n\nHuman: one\n\nAssistant: two", "\n\nHuman: only\n\nAssistant: no", "x\n\nHuman: a\n\nAssistant: b\n\nAssistant: c", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(chats.last_turn(F.col("t"))).collect()]
    assert [g and tuple(g) for g in got] == [("one", "two"), None, None, None]


@pytest.mark.parametrize("size", [2, 5, 16])
def test_windows_rebuild_the_stream(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.randint(1, 99) for _ in range(rng.randint(0, 12))]) for i in range(30)]
    docs = spark.createDataFrame(rows, "i long, ids array<int>").withColumn("n", F.size("ids").cast("long"))
    spanned = windows.spans(docs, "i", "n")
    got = windows.token_windows(windows.memberships(spanned, size), F.col("ids"), size).orderBy("window").collect()
    stream = [t for _, ids in rows for t in ids]
    count = windows.stats(spanned, size).first()
    assert [r.window for r in got] == list(range(count.examples)) and count.tokens == len(stream)
    for r in got:
        want = stream[r.window * (size - 1) : r.window * (size - 1) + size]
        assert r.ids[: r.valid] == want and len(r.ids) == size
    assert sum(size - r.valid for r in got) == count.padding


def test_places_agree_with_a_window(spark):
    rng = random.Random(3)
    rows = [(i * 997, rng.choice(["a", "a", "b", None]), rng.randint(0, 5)) for i in range(300)] + [(5, "c", None)]
    df = spark.createDataFrame(rows, "i long, g string, n long")
    want = {r.i: r.rank for r in ordering.ranked(df, ["g"], ["i"]).collect()}
    assert {r.i: r.turn for r in ordering.interleaved(df, "g", ["i"]).collect()} == want
    assert ordering.interleaved(df.limit(0), "g", ["i"]).columns == ["i", "g", "n", "turn"]
    sums = {r.i: r.s for r in ordering.running(df, ["g"], [F.floor(F.col("i") / 4096)], ["i"], F.col("n"), "s").collect()}
    assert sums == {i: sum(m for j, h, m in rows if h == g and j < i) for i, g, _ in rows}


def test_quota_order_is_the_greedy_order(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.randint(1, 10)) for i in range(80)]
    weights = {"a": 0.25, "b": 0.75}
    df = sampling.quota_order(spark.createDataFrame(rows, "i long, s string, n long"), "s", "n", "i", weights, 7)
    got = [r.i for r in df.orderBy("quota", "stratum_index").collect()]
    key = lambda i: hashlib.sha256(f"7\0000\0{i}".encode()).hexdigest()
    left = {s: sorted([r for r in rows if r[1] == s], key=lambda r: (key(r[0]), r[0])) for s in "ab"}
    taken, want = dict.fromkeys("ab", 0), []
    while any(left.values()):
        s = min((s for s in "ab" if left[s]), key=lambda s: (taken[s] / weights[s], s))
        r = left[s].pop(0)
        want.append(r[0])
        taken[s] += r[2]
    assert got == want


@pytest.mark.parametrize("stratum", ["c", None])
def test_quota_order_refuses_strata_without_weight(spark, stratum):
    df = spark.createDataFrame([(1, "a", 3), (2, stratum, 4)], "i long, s string, n long")
    with pytest.raises(Exception, match="no weight for stratum"):
        sampling.quota_order(df, "s", "n", "i", {"a": 1.0}, 7).collect()


def test_stratified_subset_and_epochs(spark):
    df = spark.createDataFrame([(i, "en" if i % 2 else "zh") for i in range(10)], "i long, lang string")
    got = sampling.stratified(df, "lang", F.col("i").cast("string"), 6).collect()
    assert sorted(r.lang for r in got) == ["en"] * 3 + ["zh"] * 3
    batches = sampling.epoch_batches(df, "i", 1, 2, 4)
    assert batches.groupBy("epoch").agg(F.countDistinct("i").alias("n")).filter("n = 10").count() == 2
    assert batches.groupBy("epoch", "batch").count().filter("count = 2").count() == 2


def test_budget_and_schedule(spark):
    b = schedule.budget(100, 1000, 2, 5, steps=7)
    assert (b.steps, b.target_tokens) == (7, 700)
    assert schedule.budget(100, 1000, 2, 5, train_tokens=550).steps == 6
    assert schedule.budget(100, 1000, 2, 5, epochs=1).estimated_tokens == 1000
    with pytest.raises(ValueError):
        schedule.budget(0, 1, 1, 1, steps=1)
    got = [r[0] for r in spark.range(21).select(schedule.lr_factor(F.col("id"), 5, 20, 0.1)).collect()]
    assert got[0] == pytest.approx(0.2) and got[4] == pytest.approx(1.0) and got[20] == pytest.approx(0.1)


def test_contamination(spark):
    docs = spark.createDataFrame([(1, "so  the quick brown fox jumps over it all"), (2, "nothing here"), (3, None)], "d long, t string")
    items = spark.createDataFrame([(7, "the quick brown\nfox jumps over"), (8, "short")], "q long, t string")
    got = contamination.hits(docs, "d", "t", contamination.queries(items, "q", "t"), "q").collect()
    assert [tuple(r) for r in got] == [(1, 7)]


def test_scores(spark):
    assert evaluation.same_json('{"a": 1, "b": [true]}', '{"b":[true],"a":1}')
    for a, b in (('{"a": 1}', '{"a": 1.0}'), ("1", "true"), ('{"a":1,"a":1}', '{"a":1}'), ("NaN", "NaN"), ("1e999", "1e999"), (None, "1")):
        assert not evaluation.same_json(a, b)
    df = spark.createDataFrame([(" x\n", "x", 1.0, 1.0), ("X", "x", 2.0, 1.0)], "r string, a string, c double, d double")
    got = df.select(evaluation.exact_score(F.col("r"), F.col("a")), evaluation.preference_score(F.col("c"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5), (0.0, 1.0)]


def test_loss_rollup_is_consistent(spark):
    rows = [("en", 1.5, 10, 40), ("zh", 2.0, 30, 0)]
    got = {r.lang: r for r in evaluation.loss_rollup(spark.createDataFrame(rows, "lang string, loss double, tokens long, bytes long"), "lang").collect()}
    assert got["all"].loss == pytest.approx(1.875) and got["zh"].bits_per_byte is None
    assert got["en"].bits_per_byte == pytest.approx(15 / math.log(2) / 40, abs=1e-6)


def test_gates(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (3, "z")], "k int, v string")
    assert {(r.k, r.left, r.right) for r in gates.field_differences(a, b, "k").collect()} == {(1, "x", "y"), (3, None, "z")}
    assert tuple(gates.same_rows(a, b).first()) == (1, 2)
    checks = gates.gate(gates.check(a.agg(F.count("*").alias("n")), "n", F.col("n") == 2, "rows"), gates.check(a.agg(F.max("v").alias("v")), "v", F.col("v") == "q", "value"))
    assert tuple(gates.status_counts(checks).first()) == (1, 0, 1, False)


def test_sources(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"id":"a","score":1}\n\n{"id":"b","score":NaN}\n[1]\n{"id":\n', encoding="utf-8")
    rows, bad = files.strict_jsonl(spark, str(path), "id string, score double")
    assert [r.id for r in rows.collect()] == ["a"] and bad.count() == 3
    assert files.fingerprints(spark, str(path)).first().sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    with pytest.raises(ValueError):
        files.read(spark, str(path), "jsonl", ["lacking"], "id string")
    with pytest.raises(ValueError):
        files.safe_relative("../x")
    files.publish(rows.select("id"), str(tmp_path / "out"), {"licence": "x"})
    df, manifest = files.load_published(spark, str(tmp_path / "out"))
    assert df.count() == manifest["records"] == 1
    with pytest.raises(Exception, match="exists"):
        files.publish(rows.select("id"), str(tmp_path / "out"), {})
    sums = tmp_path / "sums"
    sums.write_text(f"{'0' * 64}  a\n{'1' * 64}  a\nbad\n")
    entries, problems = files.checksum_lines(spark, str(sums))
    assert entries.count() == 2 and {r.code for r in problems.collect()} == {"duplicate", "format"}
    assert "| unchecked |" in files.markdown([{"a": None}], ["a"])


def test_streams(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("r", i, 3.0 - i)], "run string, step long, loss double").write.mode("append").parquet(str(tmp_path / "log"))
    stream = metrics.log_stream(spark, str(tmp_path / "log"), "run string, step long, loss double")
    got = metrics.run_once(metrics.running_best(stream, "run", "step", "loss"), "complete").collect()
    assert [tuple(r) for r in got] == [("r", 1.0, 2, 3)]
