"""Secrets, personal data, quality rules and token operators against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing, pii, quality, secrets, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


HARD = [
    None, "", "  \n\t ", "token:secret:abcdefgh123", "𝔘 password=\"aaaaaaaa\" é TOKEN = 'bbbbbbbbbb' " + "0123456789abcdef" * 2 + " AKIAAKIA1234567890",
    "token=abcdefgh1 " * 700, "paſſword=12345678 toKen=12345678 api_key: 12345678 apikey=1234567", "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----",
    "a@b.com_x@y.org a@b@c.d x@y.z.w.._q@r.s", "1.2.3.4.5.6.7.8 001.002.003.256 1.2.3.4567.8.9.1 255.255.255.255", "4111 1111 1111 1111 4111-1111-1111-1111-2 5 4111111111111111",
    "4111 1111 1111 1111  4111111111111111", "+1 (555) 123-4567 +1+2345678901 +12 +1((((((", "1 " * 5000, "x@" + "a." * 5000 + "c", "1" * 9000, "é@b.c é.x@b.c",
]


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def plain_secrets(text):
    rules = (
        ("assign", r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )
    found = [[(m.start(), o, f"{k}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "") if ok(m)] for o, (k, p, ok) in enumerate(rules)]
    return (*map(len, found), digest(s for *_, s in sorted(sum(found, []))))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in rules]
    return (*map(len, found), digest(sum(found, [])))


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{32,}") == secrets.ANY
    assert secrets.trigram_query("AKIA[A-Z]+") == frozenset([frozenset(["aki", "kia"])])
    assert secrets.trigram_query("(abc|bcd)x+") == frozenset([frozenset(["abc"]), frozenset(["bcd"])])
    assert secrets.trigram_query("ab?c") == secrets.ANY


def test_secrets_equal_brute_force(spark, documents):
    for docs in (frame(spark, HARD), documents):
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in secrets.secret_report(docs).collect():
            assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == plain_secrets(texts[r.doc_id])


def test_redaction_keeps_the_rest(spark):
    clashing = frame(spark, ["x token=abcdefgh1 y", "clean", None]).withColumn("found_assign", F.lit(1)).withColumn("rules", F.lit(2))
    got = {r.doc_id: r for r in secrets.redact(clashing).collect()}
    assert got[0].text == "x [SECRET] y" and got[0].n_chars == 12 and got[1].text == "clean" and got[2].text is None
    assert secrets.redact(clashing).columns == clashing.columns


def test_redaction_takes_whole_keys(spark):
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = ["MIIEpAIBAAKCAQEA" + "aB3/" * 12] * 400 + ["Qz9+ab=="]
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    texts = {
        "x\n" + "\n".join([begin, *body, end]) + "\ny": "x\n[SECRET]\ny",
        "x\r\n" + "\r\n".join([begin, *body, end]) + "\r\ny": "x\r\n[SECRET]\r\ny",
        'k = "' + "\\n".join([begin, *body, end]) + '\\n"': 'k = "[SECRET]\\n"',
        f"{begin}\n{fields}" + "\n".join([*body, end]): "[SECRET]",
        "x\n" + "\n".join([begin, *body]) + "\nand so on": "x\n[SECRET]\nand so on",
        f"{begin}\n{fields}" + "\n".join(body): "[SECRET]",
        "\n".join([begin, *body, begin, *body, end, "z z"]): "[SECRET][SECRET]\nz z",
        f"as in {begin} and so on - or not": "as in [SECRET] and so on - or not",
    }
    got = {r.doc_id: r.text for r in secrets.redact(frame(spark, list(texts))).collect()}
    for i, want in enumerate(texts.values()):
        assert got[i].replace("[SECRET]\n[SECRET]", "[SECRET][SECRET]") == want


def test_pii_equals_brute_force(spark, documents):
    model = pii.learn(documents)
    for docs in (frame(spark, HARD), documents):
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in pii.pii_report(docs, model).collect():
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == plain_pii(texts[r.doc_id])


def planted_pii(n=600):
    """Texts with base spans, things of the same sort that no base pattern takes, and plain numbers; and the truth."""
    rng = random.Random(11)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    fill = lambda: " ".join(rng.choice(["the", "sold", "at", "green", "was", "year", "dot", "units"]) for _ in range(rng.randint(2, 6)))
    texts, truth = [], []
    for i in range(n):
        phone, other = (f"({rng.randint(200, 999)}) 555-{digits(4)}" for _ in range(2))
        mail = f"{rng.choice(['ann', 'bob', 'eve'])}{rng.randint(1, 99)}", f"mail{rng.randint(1, 9)}.org"
        card = f"4{digits(15)}"
        base = rng.choice([f"{rng.choice(['call', 'dial'])} +1 {phone}", "@".join(mail), f"10.{rng.randint(0, 255)}.3.{rng.randint(0, 255)}"])
        added = {0: other, 1: f"{mail[0]} at {mail[1].replace('.', ' dot ')}", 2: f"{mail[0]}(at){mail[1]}", 3: card}.get(i % 8)
        if added == card and luhn(card):
            added = None
        while not luhn(valid := f"4{digits(15)}"):
            pass
        plain = rng.choice([f"{digits(8)} units", f"9{digits(19)}", f"{rng.randint(1000, 9999)}-{digits(2)}-{digits(2)}", f"0.{digits(9)}"])
        text = f"{fill()} {base} {fill()} {valid} {fill()} {plain} {fill()} {added or ''} {fill()}"
        texts.append(text)
        truth.append({(text.index(added), text.index(added) + len(added))} if added else set())
    return texts, truth


def added_spans(spans):
    return {tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x.split(":")[0] in pii.ADDED}


def test_pii_trees_add_what_base_patterns_miss(spark):
    texts, truth = planted_pii()
    found = {r.doc_id: added_spans(r.spans) for r in pii.pii_report(frame(spark, texts)).collect()}
    right = sum(len(found[i] & truth[i]) for i in range(len(texts)))
    assert right >= 0.8 * sum(map(len, truth)) and right >= 0.9 * sum(map(len, found.values()))
    # without trees nothing is added: it is they that select
    none = pii.pii_report(frame(spark, texts), pii.boosting.Boosted(0.0, [])).collect()
    assert not any(added_spans(r.spans) for r in none)
    model = pii.learn(frame(spark, texts))
    assert set(model.thresholds) == {0, 1} and all(p >= pii.PRECISION and r > 0.9 for p, r in model.held_out.values())


def test_pii_candidates_beside_and_over_others(spark):
    texts, _ = planted_pii()
    hard = ["10.0.0.1 4111111111111112 x", "12345678 4111111111111112 x", "+1 (826) 555-4081 190.137.1.2", None, "", "1-" * 4000, "a at " * 3000]
    model = pii.learn(frame(spark, texts))
    docs = spark.createDataFrame([(*r, "x", 1) for r in [(None, hard[0]), (7, hard[0]), (7, hard[0]), *enumerate(hard)]], "doc_id long, text string, found_ip string, candidates int")
    got = pii.pii_report(docs, model).collect()
    assert len(got) == len(hard) + 3 and sum(r.doc_id is None for r in got) == 1 and len({r.spans for r in got if r.doc_id == 7}) == 1
    spans = {r.doc_id: added_spans(r.spans) for r in got}
    assert spans[0] == {(9, 25)} and (9, 25) in spans[1] and all((a, b) == (c, d) or b <= c or d <= a for s in spans.values() for a, b in s for c, d in s)
    assert any(a <= 3 < b for a, b in spans[2]) and spans[3] == spans[4] == set()
    kept = pii.with_pii(docs, model)
    assert kept.select("d.*").columns == docs.columns and kept.count() == docs.count()


def plain_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_equals_brute_force(spark, documents):
    rng = random.Random(1)
    made = ["".join(rng.choice(["a ", "b ", "c\n", "c ", "é", "# ", "\x0b", "\xa0", "\r\n"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for docs in (frame(spark, HARD + made), documents.filter("n_chars < 6000")):
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in quality.quality_report(docs).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_keeps_good_documents(spark, sf_dir, documents):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    judged = quality.quality_report(documents).join(good, "doc_id")
    assert judged.filter("not kept and not base_failed").count() == 0
    assert quality.quality_filter(documents.withColumn("n_words", F.lit("x"))).columns[-1] == "n_words"


ALPHABET = list("aAbB'sdtm09.,!?<|>_- \t\n  \x1c\x0b▁") + ["é", "É", "İ", "ß", "Σ", "ς", "漢", "😀", "½", "´", "×", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", "don't", "́", "ﬁ", "\x00", "<s>"]


def made_texts(n):
    rng = random.Random(7)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["", None, "x" * 30_000, "word " * 9000]


def test_token_counts_equal_the_library(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    model = public.path("piece_bpe_32k.model")
    texts = made_texts(1500) + [r.text for r in documents.collect()]
    want = [len(tokens.load(model).encode(t or "")) for t in texts]
    got = {r.doc_id: r for r in tokens.token_counts(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == want[i] and got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 4096)


def test_packing_is_exact_and_gapless(spark, documents):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    texts = made_texts(1500) + [r.text for r in documents.collect()]
    ids = [e.ids + [0] for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = packing.pack(frame(spark, texts), path).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in enumerate(ids):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(own) // 2048)))
        for r in pieces:
            part = own[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and len(part) == r.length == min(2048, len(own) - r.start)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, ids))
    assert len(by_sequence) <= 1.05 * total / 2048 + 1


def test_plan_pairs_large_pieces():
    runs, used = packing.plan({1000: 3, 1048: 3, 700: 2, 5: 10}, 2048)
    assert used == 4 and sum(1 for r in runs if r[0] == 1000) == 1
    assert packing.plan({}, 2048) == ([], 0)


def test_targets_stop_at_three_times():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    goal = mixing.targets([100, 1, 100], [1, 2, 3])
    assert goal[1] == 3 and sum(goal) == pytest.approx(201) and goal[2] == pytest.approx(3 * goal[0])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_splitting_tree_is_exact_and_even():
    quotas = mixing.splitting_tree([1000, 10, 0, 3], 7)
    assert quotas.sum(0).tolist() == [1000, 10, 0, 3] and quotas.sum(1).max() - quotas.sum(1).min() <= 1
    assert (quotas >= 0).all() and (quotas == mixing.splitting_tree([1000, 10, 0, 3], 7)).all()


def plain_draws(words, give, leaves, seed):
    """Block draws card by card: each shard in turn takes its share from the cards that are left of the round."""
    import numpy as np

    rng, left, out, used = np.random.default_rng(seed), sorted(words), [], 0
    cards = [(shard, n) for shard, n in enumerate(leaves) if n]
    for shard, n in cards:
        while n > 0:
            mixed = [left[i] for i in rng.permutation(len(left))]
            out += [(b, shard) for b in mixed[:n]]
            left, n = sorted(mixed[n:]) or sorted(words), n - len(mixed)
    if len(left) < len(words):
        out += [(left[i], cards[-1][0]) for i in rng.permutation(len(left))]
    taken = {b: [] for b in words}
    for b, shard in out:
        if used < give:
            taken[b].append((shard, min(words[b], give - used)))
            used += taken[b][-1][1]
    return taken


def test_draws_equal_card_by_card():
    rng = random.Random(4)
    for case in range(60):
        words = {b: rng.randint(1, 40) for b in range(rng.randint(1, 30))}
        give = rng.randint(0, 3 * sum(words.values()))
        quota, shards = mixing.quota(words, give), rng.randint(1, 12)
        leaves = mixing.splitting_tree([quota, 50], shards, case)[:, 0]
        got = {b: [] for b in words}
        for b, shard, n in mixing.drawn(words, give, leaves, (case, 0)):
            got[b].append((shard, n))
        assert got == plain_draws(words, give, leaves.tolist(), (case, 0))
        assert sum(n for own in got.values() for _, n in own) == give and all(len(own) <= 4 and sum(n for _, n in own) <= 3 * words[b] for b, own in got.items())


def mixed_fixture(spark):
    rng = random.Random(3)
    texts = ["w " * rng.randint(0, 30) for _ in range(1200)] + [None, "", "one two", "one two", "long " * 20_000]
    sources = [rng.choice(["a", "b", "c", None]) for _ in range(1200)] + ["b", None, "d", "d", "e"]
    rows = [(i if i % 9 else None, t, "en", s, 0, "x") for i, (t, s) in enumerate(zip(texts, sources))]
    rows += [(5000, "twice over", "en", "a", 0, "x")] * 3
    return spark.createDataFrame(rows, SCHEMA + ", shard string")


def test_mix_reaches_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    docs = mixed_fixture(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    taken, target, rows = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and len(r.shards) >= -(-r.taken // max(r.size, 1))
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], rows[r.source] = r.target, rows.get(r.source, 0) + 1
    assert {r.source: r.source_size for r in got} == {s: sum(r.size for r in got if r.source == s) for s in target}
    want = mixing.targets([sum(r.size for r in got if r.source == s) for s in ["a", "b", "c", "d", "e", None]], [1, 2, 3, 1, 2, 3])
    assert [target[s] for s in ["a", "b", "c", "d", "e", None]] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)  # of repeated rows up to two words can't be shared evenly
    assert {s for r in got for s in r.shards} == set(range(8))


def test_mix_follows_its_tree(spark, monkeypatch):
    """Another tree, another mix: what is taken, where to, and the words of each shard come from its leaves."""
    monkeypatch.setattr(mixing, "BLOCKS", 64)
    docs = mixed_fixture(spark)
    mix = lambda: sorted(map(repr, mixing.mix(docs).select("doc_id", "source", "size", "taken").collect()))
    mine = mix()

    def to_one(counts, shards, seed=0):
        import numpy as np

        return np.vstack([np.array(counts, np.int64)[None], np.zeros((shards - 1, len(counts)), np.int64)])

    monkeypatch.setattr(mixing, "splitting_tree", to_one)
    assert mix() != mine
    assert {s for r in mixing.mix(docs).collect() for s in r.shards} == {0}


def test_mixed_documents_come_in_shards(spark, tmp_path):
    docs = mixed_fixture(spark)
    assert mixing.mixed_documents(docs).columns == docs.columns
    rows = mixing.sharded(docs).withColumn("task", F.spark_partition_id()).collect()
    times = {}
    for r in mixing.mix(docs).collect():
        whole = r.taken // r.size if r.size else len(r.shards)
        times[r.doc_id] = times.get(r.doc_id, 0) + whole + (2 * (r.taken - whole * r.size) >= max(r.size, 1))
    got = {}
    for r in rows:
        got[r.d.doc_id] = got.get(r.d.doc_id, 0) + 1
    assert got == {k: n for k, n in times.items() if n}
    by_task = {}
    for r in rows:
        by_task.setdefault((r.task, r.shard), []).append(r.local_order)
    assert all(own == sorted(own) for own in by_task.values()) and len({s for _, s in by_task}) == 8
    mixing.write_shards(docs, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").groupBy("shard").count().count() == 8


def test_empty_tables(spark):
    public = pytest.importorskip("public_tokenizers")
    empty = frame(spark, [])
    model, words = public.path("piece_bpe_32k.model"), public.path("word_bpe_49k.json")
    for df in (
        secrets.secret_report(empty), secrets.redact(empty), pii.pii_report(empty), quality.quality_report(empty), quality.quality_filter(empty),
        tokens.token_counts(empty, model), packing.pack(empty, words), mixing.mix(empty), mixing.mixed_documents(empty),
    ):
        assert df.count() == 0
