"""Operators against plain versions where ties, collisions, hot groups and odd values matter."""

import math
import random
import zlib

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learned_operators import components

from corpusmill.llm import common, langid, packing, secrets, simhash, tokens, toxicity, vectors, wordhash

SCHEMA = "doc_id long, text string"


def thue_morse(n, letters=b"ab"):
    return bytes(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_of_even_parity_differ():
    for n in (1024, 2048, 4096):
        a = thue_morse(n)
        b = a.translate(bytes.maketrans(b"ab", b"ba"))
        for _ in range(20):
            _, _, h, second = wordhash.Hasher()(b" " + a + b" " + b + b" ")
            assert h[0] != h[1] and second[0] != second[1]


def test_shared_hashes_are_drawn_anew(monkeypatch):
    """With hashes of a few bits words share them all the time; rows still are those of the words."""
    plain = wordhash.Hasher.__call__
    draws = []

    def weak(self, buffer):
        starts, ends, h, second = plain(self, buffer)
        draws.append(self)
        return starts, ends, h % np.uint64(3) if len(set(map(id, draws))) < 4 else h, second

    monkeypatch.setattr(wordhash.Hasher, "__call__", weak)
    rows = wordhash.Rows(lambda words: np.array([[len(w), w[0]] for w in words], float), 2, 3)
    texts = [b"a bb ccc dddd", b"", b"eeeee bb a", b"ccc ccc f"]
    for _ in range(3):
        got = [(values.tolist(), counts.tolist()) for values, counts in rows(texts)]
        assert [v for part, _ in got for v in part] == [[len(w), w[0]] for t in texts for w in t.split()]
        assert [c for _, part in got for c in part] == [4, 0, 3, 3]


def test_ids_of_words_that_used_to_collide():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    encoder = packing.Encoder(path)
    texts = [w for n in (1024, 2048) for a in (thue_morse(n), thue_morse(n, b"xy")) for w in (a, a.translate(bytes.maketrans(b"abxy", b"bayx")))]
    want = [e.ids for e in packing.load(path).encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder(texts)] == want


def test_packing_refuses_other_tokenizers(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.BPE()).save(f"{tmp_path}/t.json")
    with pytest.raises(ValueError):
        packing.load(f"{tmp_path}/t.json")


def plain_packing(lengths, capacity):
    """Large-item matching piece by piece: the longest large piece with the longest other large one that fits; then
    smaller pieces, longest first, into the tightest gap."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        fits = [i for i, b in enumerate(large) if a + b <= capacity]
        gaps.append(capacity - a - (large.pop(fits[0]) if fits else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fitting = [g for g in gaps if g >= n]
        gap = min(fitting, default=capacity)
        if fitting:
            gaps.remove(gap)
        gaps.append(gap - n)
    return sorted(gaps)


def test_plan_equals_piece_by_piece():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 30, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        runs, used = packing.plan(dict(Counter(lengths)), capacity)
        filled = Counter()
        for length, own in sorted(Counter(lengths).items()):
            mine = sorted(r for r in runs if r[0] == length)
            for rank in range(own):
                _, first, sequence, per, _ = [r for r in mine if r[1] <= rank][-1]
                filled[sequence + (rank - first) // per] += length
        assert set(filled) == set(range(used)) and sorted(capacity - n for n in filled.values()) == plain_packing(lengths, capacity)


def test_packing_edge_rows(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "RANKED", 4)
    rows = [(1, "a b", "x", 9)] * 300 + [(None, "c", "x", 9), (None, None, "x", 9), (3, "word " * 30_000, "x", 9), (3, "word " * 30_000, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, salt long")
    got = packing.pack(docs, public.path("word_bpe_49k.json")).collect()
    taken = defaultdict(list)
    for r in got:
        taken[r.sequence_id].append((r.offset, r.length))
    assert sum(r.doc_id == 1 for r in got) == 300 and sum(r.doc_id is None for r in got) == 2 and len(got) == 302 + 2 * 15
    for own in taken.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_counts_of_texts_without_blanks():
    public = pytest.importorskip("public_tokenizers")
    model = public.path("piece_bpe_32k.model")
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc漢字😀") for _ in range(n)) for n in (10, 64, 65, 3000, 20_000)] + ["x " * 5000, "x", None]
    counter = tokens.Counter(model, tokens.whole_tokens(model))
    assert counter(texts) == [len(tokens.load(model).encode(t or "")) for t in texts]
    assert max(map(len, counter.known)) <= max(tokens.KEPT_CHARS, max(map(len, counter.proved)))


def test_token_counts_edge_rows(spark):
    public = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(None, "a b", 1), (4, "a b", 1), (4, "a b", 1), (4, None, 1)], SCHEMA + ", n_tokens int")
    got = tokens.token_counts(docs, public.path("piece_bpe_32k.model")).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2, 2, 2] and sum(r.doc_id == 4 for r in got) == 3


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame([(1, "same")] * 500 + [(1, f"t{i}") for i in range(500)], SCHEMA)
    assert common.bounded_sample(rows, 10).count() == 10 and common.bounded_sample(rows, 5000).count() == 1000


# --- vectors --------------------------------------------------------------------------------------------


def vector_links(rows, cosine=0.95):
    """(n_links, component) of rows (id, vector) by brute force."""
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = (np.array(rows[k][1], float) for k in (i, j))
            if i != j and len(a) == len(b):
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                near[i, j] = a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine
    return near.sum(1), components(n, list(zip(*np.nonzero(near))))


@pytest.mark.parametrize("least,fan", [(64, 8), (3, 2)])
def test_vectors_of_any_size_and_density(spark, monkeypatch, least, fan):
    monkeypatch.setattr(vectors, "LEAST", least)
    monkeypatch.setattr(vectors, "INTERVAL", 2 * least)
    monkeypatch.setattr(vectors, "FAN", fan)
    monkeypatch.setattr(vectors, "LEAF", 4)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 5))
    rows = [v * s for v in base for s in (1e-170, 1.0, 1e300)]  # the same direction, tiny and huge
    rows += [np.array([1.0, 1e-3 * i, 0, 0, 0]) for i in range(40)]  # one dense cell
    rows += [np.array([5e-324, 0, 0, 0, 0]), np.array([0, 0, 1e-320, 0, 0]), np.array([2.0, 1.0]), np.array([4.0, 2.0]), np.array([3.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    links, least_of = vector_links(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (links[i], least_of[i]) for i in range(len(rows))}


def test_interval_pairs_lose_none(spark):
    rng = np.random.default_rng(9)
    lo = rng.normal(size=(70, vectors.DIMENSIONS))
    hi = lo + rng.random(lo.shape)
    boxes = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(lo, hi))], "node long, lo array<double>, hi array<double>")
    got = {(r.a, r.b) for r in vectors.interval_pairs(boxes, 70, 0.8).collect()}
    assert got == {(i, j) for i in range(70) for j in range(i, 70) if not vectors.apart(lo[i], hi[i], lo[j], hi[j], 0.8)}


# --- simhash --------------------------------------------------------------------------------------------


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for b in base]))
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 3
    want = components(len(values), list(zip(*np.nonzero(near))))
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    for hot in (10**9, 3):
        monkeypatch.setattr(simhash, "HOT", hot)
        links = [(at[r.src], at[r.dst]) for r in simhash.fingerprint_links(prints).collect()]
        assert components(len(values), links) == want


def test_near_copies_go_and_the_rest_stays(spark):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(1)
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, t, "en") for i, t in enumerate(texts[:10])]
    rows += [(5, texts[5], "xx"), (5, texts[5], "xx"), (None, texts[7], "en"), (None, "only here, with no id", "en"), (None, "only here, with no id", "en"), (8, texts[9], "same id")]
    docs = spark.createDataFrame(rows, SCHEMA + ", key string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, *sorted([*range(9), *range(10, 40), 8])]


# --- toxicity -------------------------------------------------------------------------------------------


def plain_score(model, text):
    """Forward-backward token by token, then the calibrated evidence."""
    words = [w.decode() for w in (text or "").encode().lower().split()]
    p = []
    if words:
        T = np.exp(model.trans)
        x = np.array([[1.0, math.exp(min(30, max(-30, model.emission(w))))] for w in words])
        a, b = np.zeros((len(words), 2)), np.ones((len(words), 2))
        a[0] = x[0] * [1, math.exp(model.first)]
        a[0] /= a[0].sum()
        for t in range(1, len(words)):
            a[t] = a[t - 1] @ T * x[t]
            a[t] /= a[t].sum()
        for t in range(len(words) - 2, -1, -1):
            b[t] = T @ (x[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = (a * b)[:, 1] / (a * b).sum(1)
    z = model.calibration @ [1, math.log1p(sum(p)), max(p, default=0.0), 20 * sum(p) / (len(p) + 40)]
    return 1 / (1 + math.exp(-z)), [bool(v > 0.5) for v in p]


def test_scores_and_spans_equal_step_by_step(spark, monkeypatch):
    monkeypatch.setattr(wordhash, "BUFFER", 3000)  # several parts
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(200):
        own = rng.choices(words, k=rng.randint(5, 60))
        for _ in range(3 * (i % 4 == 0)):
            own.insert(rng.randint(0, len(own)), rng.choice(["Vilething", "grimbag,"]))
        texts.append(" ".join(own))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, labels)
    asked = [None, "", " \n", "grimbag, vilething " * 400, "é grimbag \x1f a\x0bgrimbag", *texts[:60], " ".join(texts)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(asked)] + [(None, "x", 0.5)], SCHEMA + ", score double")
    got = {r.doc_id: r.toxicity for r in toxicity.with_scores(docs, model).collect()}
    for i, t in enumerate(asked):
        score, flags = plain_score(model, t)
        assert got[i].score == pytest.approx(score, abs=1e-9)
        covered = {k for s in got[i].spans for k in range(s.start, s.end)}
        places = [m.span() for m in toxicity.re.finditer(toxicity.WORD, t or "")]
        assert [a in covered for a, _ in places] == flags and len(places) == len(flags)


def test_one_repeated_label_and_id(spark):
    docs = spark.createDataFrame([(1, "x")] * 50 + [(3, "y")], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity_report(docs, labels).count() == 51


# --- languages ------------------------------------------------------------------------------------------


def plain_entropy(counts, text, floor):
    """Bits per character of a text under interpolated Kneser-Ney counts {4-gram: n}, term by term."""
    tables, own = [], dict(counts)
    for k in range(4, 0, -1):
        tables.insert(0, own)
        shorter = Counter(g[1:] for g in own)
        own = dict(shorter)
    discounts = []
    for table in tables:
        once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
        discounts.append(once / (once + 2 * twice) if once and twice else 0.5)

    def p(gram):
        if not gram:
            return floor
        k = len(gram)
        table, D = tables[k - 1], discounts[k - 1]
        same = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        lower = p(gram[1:])
        if not same:
            return lower
        return ((table[gram] - D) if gram in table else 0) / sum(same) + D * len(same) / sum(same) * lower

    bits, chars = 0.0, 0
    for word in text.lower().split():
        if word := langid.letters(word):
            s = "\x02" * 3 + word + "\x03"
            bits -= sum(math.log2(p(s[i : i + 4])) for i in range(len(s) - 3))
            chars += len(word) + 1
    return bits / chars if chars else 0.0


def test_entropy_equals_term_by_term(monkeypatch):
    monkeypatch.setattr(wordhash, "BUFFER", 40)
    counts = {k: langid.grams(Counter(t.encode().split())) for k, t in {"aa": "kala maka lami kala ka", "bb": "schung erung schere ung", "cc": "ção ções que quo"}.items()}
    model = langid.build(counts)
    texts = ["kala ungsch", "que 12 ção!", "", "12", "zz", "kala " * 50, "Schung, ERUNG schung"]
    h, chars = langid.Identifier(model).entropy([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert h[i, j] == pytest.approx(plain_entropy(counts[lang], t, model.floor))
    alone = np.concatenate([langid.Identifier(model).entropy([t.encode()])[0] for t in texts])
    assert (alone == h).all()  # no text's score depends on those beside it


def test_joined_models_say_the_same(spark, monkeypatch):
    rng = random.Random(7)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"], "cc": ["ção", "que", "os"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=rng.randint(1, 3))) for _ in range(9)), k) for i in range(90) for k in [rng.choice(list(kinds))]]
    rows += [(None, "ka lo", "aa"), (901, None, "aa"), (902, "12 !!", "bb"), (903, "", None), (904, "zzyx \U0001d518", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string")
    get = lambda: sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 9), r.rejected) for r in langid.language_report(docs).collect())
    want = get()
    monkeypatch.setattr(langid, "BROADCAST_GRAMS", 0)
    assert get() == want and len(want) == len(rows)


def test_languages_do_not_depend_on_size(spark, monkeypatch):
    """More learning rows than a sample of 1000 had: limits come from all of them, wherever the models are held."""
    rng = random.Random(11)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"]}

    def made(parts, strange):
        return " ".join("".join(rng.choices(parts if rng.random() > strange else "zxqwvjyh", k=3)) for _ in range(12))

    rows = [(i, made(kinds[k], rng.random() * 0.2), k) for i in range(1700) for k in [rng.choice(list(kinds))]]
    rows += [(i, made(kinds["aa"], rng.random()), None) for i in range(1700, 2100)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string")
    get = lambda df: sorted(map(tuple, langid.language_report(df).collect()))
    held = get(docs)
    model = langid.learn(docs)
    h, chars = langid.Identifier(model).entropy([t.encode() for _, t, _ in rows])
    learnt = [zlib.crc32(str(i).encode()) % langid.FOLDS != langid.HELD_OUT and lang is not None for i, _, lang in rows]
    limit = {}
    for j, lang in enumerate(model.languages):
        own = h[[ok and r[2] == lang for ok, r in zip(learnt, rows)], j]
        limit[lang] = own.mean() + langid.LIMIT_SD * own.std()
    least = {r[0]: v for r, v in zip(rows, h.min(1))}
    assert sum(learnt) > 1200 and 20 < sum(r[4] for r in held) < 380
    assert [r[4] for r in held] == [bool(least[r[0]] > limit[r[2]]) for r in held]
    monkeypatch.setattr(langid, "BROADCAST_GRAMS", 0)
    assert get(docs.repartition(3)) == held  # to the last bit


def test_ties_and_long_texts_of_languages(spark):
    rows = [(i, "kala maka", lang) for i in range(40) for lang in ("bb", "aa")] + [(100, "kala " * 60_000, None)]
    got = langid.language_report(spark.createDataFrame(rows, SCHEMA + ", lang string")).collect()
    assert {r.lang_pred for r in got} == {"aa"} and len(got) == 81


# --- secrets --------------------------------------------------------------------------------------------


def test_added_secrets_are_found(spark):
    web = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    texts = ["x ghp_" + "aB3" * 13, "xoxb-1234567890-ab y", "AIza" + "a1_" * 11 + "zz", web, "-----BEGIN EC PRIVATE KEY-----", "\U0001d518 " + web + " ghp_short"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[3], "x", 1)] * 2 + [(None, "word " * 50_000 + texts[1], "x", 1)], SCHEMA + ", found_forge string, rules int")
    got = defaultdict(list)
    for r in secrets.secret_report(docs).collect():
        got[r.doc_id].append(r.spans)
    assert [got[i] for i in range(6)] == [["forge:2:45"], ["chat:0:18"], ["cloud:0:39"], [f"webtoken:0:{len(web)}"], ["pem:0:30"], [f"webtoken:2:{2 + len(web)}"]]
    assert got[7] == got[3] * 2 and got[None] == ["chat:250000:250018"]


# --- pipeline -------------------------------------------------------------------------------------------


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = [(None, None, None, None, None, "z"), (None, "", "en", "s", 0, "z"), (10**9, "twice " * 60, "en", "s", 360, "z"), (10**9, "twice " * 60, "en", "s", 360, "z"), (10**9 + 1, "long " * 50_000, None, "t", 1, "z")]
    docs = good.withColumn("shard", F.lit("x")).union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, shard string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in packed.collect()}
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and ids
    stages = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, str(tmp_path))
        assert stages.columns == docs.columns, name
    assert {r.doc_id for r in stages.select("doc_id").collect()} == ids
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0



# --- quality --------------------------------------------------------------------------------------------


def test_quality_of_odd_rows(spark):
    from corpusmill.llm import quality

    rows = [(None, None, "x"), (None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x"), (4, "long " * 60_000, "x"), (5, "\n\n \n", "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_words string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_repeat_words, r.kept) for r in quality.quality_report(docs).collect())
    assert got == [(-1, 0, 0, False), (-1, 2, 0, False), (3, 2, 0, False), (3, 2, 0, False), (4, 60_000, 60_000, False), (5, 0, 0, False)]
    assert quality.quality_filter(docs).columns == docs.columns
