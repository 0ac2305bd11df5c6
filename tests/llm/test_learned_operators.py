"""Near duplicates, vectors, toxicity and languages against brute force or held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import langid, simhash, toxicity, vectors
from corpusmill.llm.common import connected_components

SCHEMA = "doc_id long, text string"


def components(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(label[i], label[j])
            if label[i] != least or label[j] != least:
                label[i] = label[j] = least
                changed = True
    return label


def plain_fingerprint(text):
    import xxhash

    words = bytes((text or ""), "utf-8").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_every_pair():
    masks = simhash.covering_masks(3)
    rng = random.Random(0)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(not m & bits for m in masks)


def test_buckets_of_any_size_keep_connectivity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)) for b in base]))
    small = sorted(simhash._walk(values, 3))
    old, simhash.DIRECT = simhash.DIRECT, 50
    try:
        large = simhash.star_edges(values, 3)
    finally:
        simhash.DIRECT = old
    at = {int(v): i for i, v in enumerate(values)}
    want = components(len(values), [(at[int(a)], at[int(b)]) for a, b in small])
    assert want == components(len(values), [(at[int(a)], at[int(b)]) for a, b in large])


def test_simhash_equals_brute_force(spark, sf_dir):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", " ", "One two", "one TWO", "É é"]
    for _ in range(25):
        t = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        texts += [" ".join(t), " ".join(t), " ".join(t[:-1] + ["x"]), " ".join(t).upper()]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    want = components(len(texts), links)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA + ", fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert all(got[i].fingerprint == f"{prints[i]:016x}" and got[i].component_id == want[i] for i in range(len(texts)))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_simhash_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "q r s t u v")], SCHEMA)
    assert sorted((r.component_id or -1) for r in simhash.near_duplicates(docs).collect()) == [-1, 4, 4, 4, 4]
    assert sorted((r.doc_id or -1) for r in simhash.drop_near_duplicates(docs).collect()) == [-1, 4]
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), "test").collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)}


@pytest.mark.parametrize("leaf,interval", [(512, 8192), (16, 64)])
def test_vectors_equal_brute_force(spark, monkeypatch, leaf, interval):
    monkeypatch.setattr(vectors, "LEAF", leaf)
    monkeypatch.setattr(vectors, "INTERVAL", interval)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 12))
    v = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0, 0.05, 0.1, 0.2, 0.3)]).astype(np.float32)
    v[120:140] = v[0]
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = components(len(v), list(zip(*np.nonzero(near))))
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)], "vec_id long, embedding array<float>")).collect()}
    for i in range(len(v)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), want[i], want[i] == i)


def test_vector_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (None, [1.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (10, [None, 1.0]), (11, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cid string")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 6, 7, 10, 11)]
    assert got == sorted([(0, 2, 1, False), (1, 2, 1, True), (2, 2, 1, False), (9, 1, 9, True), (9, 1, 9, True), *alone])
    assert vectors.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("sample,interval", [(20_000, 8192), (1, 8)])
def test_vectors_of_every_length_link(spark, monkeypatch, sample, interval):
    monkeypatch.setattr(vectors, "SAMPLE", sample)
    monkeypatch.setattr(vectors, "INTERVAL", interval)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for width, n in ((12, 40), (10, 20), (3, 20), (1, 3)):
        base = rng.normal(size=(n, width))
        v = np.concatenate([base, base * 2, base + rng.normal(size=base.shape) * 0.05]).astype(np.float32)
        x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
        near = x @ x.T >= 0.95
        np.fill_diagonal(near, False)
        at = len(rows)
        rows += [(at + i, a.tolist()) for i, a in enumerate(v)]
        least = components(len(v), list(zip(*np.nonzero(near))))
        want |= {at + i: (near[i].sum(), at + least[i]) for i in range(len(v))}
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == want


def test_chain_equals_step_by_step():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 1, 5, 300, 700, 256])
    e, trans, first = rng.normal(size=lengths.sum()) * 2, np.array([[0, -1.3], [0.2, 0.9]]), -0.7
    got, pairs = toxicity.Chain(lengths).marginals(e, trans, first, pairs=True)
    T, at, total = np.exp(trans), 0, np.zeros((2, 2))
    for n in lengths[lengths > 0]:
        x = np.column_stack([np.ones(n), np.exp(e[at : at + n])])
        a, b = np.zeros((n, 2)), np.ones((n, 2))
        a[0] = x[0] * [1, np.exp(first)]
        for t in range(1, n):
            a[t] = a[t - 1] / a[t - 1].sum() @ T * x[t]
        for t in range(n - 2, -1, -1):
            b[t] = T @ (x[t + 1] * b[t + 1] / b[t + 1].sum())
        q = a * b
        assert np.allclose(got[at : at + n], q[:, 1] / q.sum(1))
        for t in range(1, n):
            z = a[t - 1][:, None] * T * x[t] * b[t]
            total += z / z.sum()
        at += n
    assert np.allclose(pairs, total)


def made_language(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = made_language(rng, ["ka", "lo", "mi", "ten", "ru", "sa"], rng.randint(40, 90)).split()
        toxic = i % 5 == 0
        for _ in range(4 * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(["grimbag", "snotface", "Vilecrab!"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None, "x"), (1000, "", "x")], SCHEMA + ", score string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs, known)
    judged = got.join(known, "doc_id").filter("held_out")
    assert judged.filter("predicted <> toxic").count() <= 0.03 * judged.count() and judged.count() > 100
    spans = got.filter("doc_id = 0").first().spans
    text = rows[0][1]
    assert {text[int(a) : int(b)] for a, b in (s.split(":") for s in spans)} <= {"grimbag", "snotface", "Vilecrab!"} | {s for s in text.split() if s}
    assert got.filter("doc_id is null and not held_out and predicted = 0").count() == 1
    kept = toxicity.reject_toxic(docs, known)
    assert kept.columns == docs.columns and 470 <= kept.count() <= 490
    none = toxicity.toxicity_report(docs, known.limit(0))
    assert none.filter("score = 0").count() == docs.count()
    assert toxicity.toxicity_report(docs.limit(0), known).count() == 0


def test_kneser_ney_is_a_distribution():
    model = langid.build({"a": {"\x02\x02\x02b": 3, "\x02\x02bc": 2, "\x02bc\x03": 2, "\x02\x02b\x03": 1}})
    total = 0.0
    for last in "bc\x03z":  # every character after the start, one of them unseen
        codes = langid._codes(["\x02\x02\x02" + last])
        p = model.floor
        for k, order in enumerate(model.orders, 1):
            h, c = langid._hashes(codes, k)[-1:], (langid._hashes(codes, k - 1)[-2:-1] if k > 1 else np.zeros(1, np.uint64))
            p = float(order.share(h, 1)[0, 0] + order.rest(c, 1)[0, 0] * p)
        total += p
    assert total == pytest.approx(1.0)


def test_languages_held_out(spark):
    rng = random.Random(6)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"], "cc": ["ção", "que", "os"]}
    rows = [(i, made_language(rng, kinds[lang], 12), lang, "x") for i in range(300) for lang in [rng.choice(list(kinds))]]
    rows += [(None, "ka lo", "aa", "x"), (901, None, "aa", "x"), (902, "12 !!", "bb", "x"), (903, "", None, "x"), (904, "ungersch", None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string, score string")
    got = {r.doc_id: r for r in langid.language_report(docs).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert len(held) > 30 and all(got[i].lang_pred == rows[i][2] for i in held)
    assert got[None].held_out and got[None].lang_pred == "aa" and got[904].lang_pred == "bb"
    assert [got[i].lang_pred for i in (901, 902, 903)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert langid.language_report(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_learns_from_long_documents(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(800)]
    texts = [" ".join(rng.choices(words, k=3200)) for _ in range(60)]
    rows = [(i, t + (" zzqxvile" * 5 if i % 3 == 0 else "")) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert min(len(t) for _, t in rows) > 20_000
    model = toxicity.learn(spark.createDataFrame(rows, SCHEMA), labels)
    assert model is not None and model.weights["zzqxvile"] > 0


def test_languages_keep_every_ngram(spark):
    """More n-grams than 200,000, all but some once: the rare ones keep the discount and the lower orders."""
    rng = random.Random(9)
    text = " ".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40)) for _ in range(6000))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % langid.FOLDS != langid.HELD_OUT][:4]
    rows = [(ids[0], text, "zh"), (ids[1], "abab abc", "en"), (ids[2], "abab", "en"), (ids[3], None, "en")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    grams = langid.grams(Counter(text.encode().split()))
    once, twice = (sum(n == k for n in grams.values()) for k in (1, 2))
    zh = model.languages.index("zh")
    top = model.orders[-1]
    assert (top.share.values[top.share.langs == zh] > 0).sum() == len(grams) > 200_000
    D = once / (once + 2 * twice) if twice else 0.5
    total = Counter()
    for g, n in grams.items():
        total[g[:-1]] += n
    for g in list(grams)[::5000]:
        assert np.isclose(top.share(langid._hashes(langid._codes([g]), 4), 2)[0, zh], (grams[g] - D) / total[g[:-1]])
    one = model.orders[0]
    kinds = {a[-2:] for a in {g[1:] for g in grams}}  # bigrams
    last = Counter(b[-1] for b in kinds)
    for c in list(last)[::300]:
        own = sum(n == 1 for n in last.values()), sum(n == 2 for n in last.values())
        d = own[0] / (own[0] + 2 * own[1]) if all(own) else 0.5
        assert np.isclose(one.share(langid._hashes(langid._codes([c]), 1), 2)[0, zh], (last[c] - d) / len(kinds))
