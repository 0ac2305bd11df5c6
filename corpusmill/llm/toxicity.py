"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are the stretches between white space. Labels exist for documents only, so token labels are
derived from them: in a toxic document the tokens with a feature (word or stem) that is far more
frequent in toxic documents, nothing in others. The field has two states; a token's emission adds the
weights of its word and of its first 4 to 7 letters, and transitions tie neighbours. Forward-backward
marginals give each token's probability; their sum, maximum and density give the document's score by
a logistic calibration, and runs of tokens above one half are the offending spans.

Fitting uses a sample: SAMPLE labelled rows of each class, the first by a hash of id and text, whole whatever
their length; rows that repeat count once.
Scoring covers every text whole.

Defined cases: null or blank text has no tokens, no spans and the score of zero evidence; documents
without a label (or a null doc_id) are scored, never learnt from; a doc_id that labels have twice is toxic
if one of them says so; with no or one class of labels every score is 0; very long texts are scored whole, in
lanes, some 100 bytes a token; a score of just the threshold counts as toxic; repeated rows score
alike; an empty table gives an empty result; further columns are ignored (reject_toxic keeps them)."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, give_back, materialize, packed, released, unpacked, workers
from corpusmill.llm.simhash import fingerprint
from corpusmill.llm.wordhash import Rows, ranges

THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
SAMPLE = 1500
#: Tokens of a block of documents that fitting passes over at once.
BLOCK = 300_000
#: Documents of the sample that a feature has to be in.
MIN_DOCS = 4
#: A token of a toxic document is labelled when a feature of it has such log odds of toxic to other
#: documents, and its shares among them differ by so many standard deviations.
ODDS, DEVIATES = 2.0, 4.5
STEMS = (4, 5, 6, 7)
#: Differing bits of two fingerprints of near copies in the sample, at most.
COPY_BITS = 10
LANE, LONG = 64, 2048
KEPT = 400_000
STEPS = 40
SPANS = "array<struct<start:int,end:int>>"


def features(chunk: str) -> list[str]:
    word = re.sub(r"^\W+|\W+$", "", chunk.lower())
    return [word] + ["^" + word[:k] for k in STEMS if len(word) >= k] if word else []


@dataclass
class Chain:
    """Tokens of several documents in lanes of LANE (or LONG, where a document has very many), for vector
    forward-backward passes: steps within lanes are taken for all lanes at once, steps between them one by one."""

    lengths: np.ndarray  # of documents

    def __post_init__(self):
        self.lane = LANE if self.lengths.max(initial=0) < LANE * LONG else LONG
        per = -(-self.lengths // self.lane)
        self.n_lanes = int(per.sum())
        self.doc = np.repeat(np.arange(len(per)), per)
        self.nth = np.arange(self.n_lanes) - np.repeat(np.cumsum(per) - per, per)
        self.size = np.minimum(self.lane, self.lengths[self.doc] - self.nth * self.lane)
        self.mask = np.arange(self.lane) < self.size[:, None]

    def marginals(self, emission: np.ndarray, trans: np.ndarray, first: float, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(state 1) of each token and, if pairs, the expected transitions (2, 2) of all documents.

        emission: log odds of state 1; trans: log weights; first: log odds of state 1 at the start. Two numbers
        a token are held at a time."""
        seen = np.zeros((2, 2))
        if not self.n_lanes:
            return np.zeros(0), seen
        (t00, t01), (t10, t11) = np.exp(trans).tolist()
        x, on = np.ones((self.n_lanes, self.lane)), self.mask
        x[on] = np.exp(np.clip(emission, -30, 30))
        x, on, head = np.ascontiguousarray(x.T), np.ascontiguousarray(on.T), self.nth == 0
        heads, opening = np.flatnonzero(head), math.exp(first)
        count = np.bincount(self.doc, minlength=len(self.lengths))[self.doc[heads]]
        # What comes into each lane and what follows it, lane by lane of all documents at once.
        start, end = np.full((2, self.n_lanes), 0.5), np.ones((2, self.n_lanes))
        if (most := int(count.max())) > 1:
            P = self._products(x, on, head, (t00, t01, t10, t11), opening)
            for k in range(1, most):
                own = heads[count > k] + k
                v = start[0, own - 1] * P[:2, own - 1] + start[1, own - 1] * P[2:, own - 1] if k > 1 else P[:2, own - 1]
                start[:, own] = v / v.sum(0)
            for k in range(most - 2, -1, -1):
                own = heads[count > k + 1] + k
                after, into = P[:, own + 1], end[:, own + 1]
                v = np.stack([after[0] * into[0] + after[1] * into[1], after[2] * into[0] + after[3] * into[1]])
                end[:, own] = v / v.sum(0)
        forward = np.empty((self.lane, self.n_lanes))
        a0, a1 = start
        for t in range(self.lane):
            b0, b1 = a0 * t00 + a1 * t10, (a0 * t01 + a1 * t11) * x[t]
            if t == 0:
                b0, b1 = np.where(head, 1.0, b0), np.where(head, opening * x[t], b1)
            a1 = np.where(on[t], b1 / (b0 + b1), a1)
            a0 = 1 - a1
            forward[t] = a1
        b0, b1 = end
        for t in range(self.lane - 1, -1, -1):
            xb = x[t] * b1
            if pairs:
                f1 = forward[t - 1] if t else start[1]
                f0 = 1 - f1 if t else start[0]
                w = np.stack([f0 * t00 * b0, f0 * t01 * xb, f1 * t10 * b0, f1 * t11 * xb])
                seen += (w / w.sum(0))[:, on[t] & ~head if t == 0 else on[t]].sum(1).reshape(2, 2)
            one = forward[t] * b1
            forward[t] = one / (one + (1 - forward[t]) * b0)  # from here on the marginal
            c0, c1 = t00 * b0 + t01 * xb, t10 * b0 + t11 * xb
            b0, b1 = np.where(on[t], c0 / (c0 + c1), b0), np.where(on[t], c1 / (c0 + c1), b1)
        return forward.T[self.mask], seen

    @staticmethod
    def _products(x: np.ndarray, on: np.ndarray, head: np.ndarray, t: tuple, opening: float) -> np.ndarray:
        """The product of each lane's transfer matrices, by rows, rescaled on the way; a first lane's has one row."""
        t00, t01, t10, t11 = t
        P = np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), x.shape[1], axis=1)
        for k in range(len(x)):
            Q = np.stack([P[0] * t00 + P[1] * t10, (P[0] * t01 + P[1] * t11) * x[k], P[2] * t00 + P[3] * t10, (P[2] * t01 + P[3] * t11) * x[k]])
            if k == 0:
                Q = np.where(head, np.stack([np.ones(len(head)), opening * x[0], np.zeros(len(head)), np.zeros(len(head))]), Q)
            P = np.where(on[k], Q / Q.sum(0), P)
        return P


@dataclass
class Model:
    weights: dict[str, float]
    trans: np.ndarray
    first: float
    bias: float
    calibration: np.ndarray  # of evidence()

    def emission(self, chunk: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(chunk))


def evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(1, log sum, maximum, density) of each document's marginals."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(doc, p, minlength=len(lengths))
    most = np.zeros(len(lengths))
    np.maximum.at(most, doc, p)
    return np.column_stack([np.ones(len(lengths)), np.log1p(total), most, 20 * total / (lengths + 40)])


def logistic(X: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    w = np.zeros(X.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        H = (X * (q * (1 - q))[:, None]).T @ X + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(H, X.T @ (q - y) + ridge * w), -4, 4)
    return w


def distinct(texts: list[str]) -> list[int]:
    """The places of texts that aren't near copies of an earlier one: copies would pass for evidence."""
    prints = np.array([fingerprint(t) for t in texts], np.int64).view(np.uint64)
    kept: list[int] = []
    for i in range(len(texts)):
        if not kept or np.bitwise_count(prints[kept] ^ prints[i]).min() > COPY_BITS:
            kept.append(i)
    return kept


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None) -> Model | None:
    """A model from labelled texts; None where either class is missing."""
    kept = distinct(texts)
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    weights = weights and [weights[i] for i in kept]
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        return None
    number: dict[bytes, int] = {}
    docs = [np.fromiter((number.setdefault(c, len(number)) for c in t.encode("utf-8", "surrogatepass").lower().split()), np.int32) for t in texts]
    # Features by number, each string held once: of the words in turn, and of all together in whole arrays.
    numbered: dict[str, int] = {}
    flat, sizes = array("i"), array("i")
    for c in number:
        own = features(c.decode("utf-8", "replace"))
        flat.extend(numbered.setdefault(f, len(numbered)) for f in own)
        sizes.append(len(own))
    del number
    flat, sizes = np.asarray(flat, np.int32), np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    in_docs, in_toxic = np.zeros(len(numbered), np.int64), np.zeros(len(numbered), np.int64)
    for d, label in zip(docs, labels):
        words = np.unique(d)
        own = np.unique(flat[ranges(starts[words], sizes[words])])
        in_docs[own] += 1
        in_toxic[own] += label
    n1, n0 = int(y.sum()), int((1 - y).sum())
    a, b, share = in_toxic, in_docs - in_toxic, in_docs / (n1 + n0)
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    tells = (odds > ODDS) & ((a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12) > DEVIATES)
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    marked = np.bincount(word, tells[flat], minlength=len(sizes)) > 0
    common = in_docs >= MIN_DOCS
    place = np.cumsum(common) - 1
    names = {f: int(place[i]) for f, i in numbered.items() if common[i]}
    word, feature = word[common[flat]], place[flat[common[flat]]]
    del numbered, flat, starts, in_docs, in_toxic, a, b, share, odds, tells
    # Blocks of documents, so that the passes need little memory; of each token its word and target.
    blocks = []
    for part in np.array_split(np.arange(len(docs)), max(1, sum(map(len, docs)) // BLOCK)):
        own = np.concatenate([docs[i] for i in part]) if len(part) else np.zeros(0, np.int32)
        lengths = np.array([len(docs[i]) for i in part], np.int64)
        blocks.append((Chain(lengths), own, marked[own] & np.repeat(y[part] == 1, lengths)))
    gold = np.zeros((2, 2))
    for chain, _, target in blocks:
        inside = np.ones(len(target), bool)
        inside[(np.cumsum(chain.lengths) - chain.lengths)[chain.lengths > 0]] = False
        gold += np.bincount((target[:-1] * 2 + target[1:])[inside[1:]], minlength=4).reshape(2, 2)
    # The model's own expectations are matched to the labels' by AdaGrad, with a pull to zero.
    w, trans, bias, first = np.zeros(len(names)), np.array([[0.0, -2.0], [0.0, -1.0]]), -2.0, -2.0
    gw, gt, gb = np.full(len(names), 1e-8), np.full((2, 2), 1e-8), 1e-8

    def emissions() -> np.ndarray:
        """Of each word."""
        return bias + np.bincount(word, w[feature], minlength=len(marked))

    for _ in range(STEPS):
        e, miss, dt = emissions(), np.zeros(len(marked)), gold.copy()
        for chain, own, target in blocks:
            p, seen = chain.marginals(e[own], trans, first, pairs=True)
            miss += np.bincount(own, target - p, minlength=len(marked))
            dt -= seen
        d, db = np.bincount(feature, miss[word], minlength=len(names)) - 0.05 * w, miss.sum()
        gw, gt, gb = gw + d * d, gt + dt * dt, gb + db * db
        w += 0.7 * d / np.sqrt(gw)
        step = 0.2 * dt / np.sqrt(gt)
        step[0, 0] = 0.0  # one of the weights is free
        trans = trans + step
        bias += 0.3 * db / math.sqrt(gb)
    e = emissions()
    X = np.concatenate([evidence(c.marginals(e[own], trans, first)[0], c.lengths) for c, own, _ in blocks])
    scale = np.ones(len(y)) if weights is None else np.asarray(weights)
    keep = np.repeat(np.arange(len(y)), np.maximum(1, np.round(scale)).astype(int))
    used = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}
    return Model(used, trans, first, bias, logistic(X[keep], y[keep]))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known = Rows(lambda chunks: np.array([[model.emission(c.decode("utf-8", "replace"))] for c in chunks]), 1, KEPT)

    def __call__(self, texts) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """The score and the offending spans of each text (UTF-8)."""
        lowered, scores, spans = [(t or b"").lower() for t in texts], [np.zeros(0)], []
        raws = iter(texts)
        for e, lengths in self.known(lowered):
            p, _ = Chain(lengths).marginals(e[:, 0], self.model.trans, self.model.first)
            z = evidence(p, lengths) @ self.model.calibration
            scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            for n, end, text in zip(lengths, np.cumsum(lengths), raws):
                own = p[end - n : end] > 0.5
                spans.append(offending(text.decode("utf-8", "replace"), own) if own.any() else [])
        return np.concatenate(scores), spans


def offending(text: str, flags: np.ndarray) -> list[tuple[int, int]]:
    """Spans (code points, end exclusive) of runs of flagged tokens."""
    out: list[tuple[int, int]] = []
    last = False
    for m, on in zip(re.finditer(WORD, text), flags):
        if on and last:
            out[-1] = (out[-1][0], m.end())
        elif on:
            out.append(m.span())
        last = bool(on)
    return out


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the sample of docs (doc_id, text) and labels (doc_id, toxic). Ids and hashes alone meet the labels;
    texts are fetched for the sample, whose ids are few enough to go to every task."""
    spark = docs.sparkSession
    known = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).filter(fold(F.col("doc_id")) != HELD_OUT)
    pairs = materialize(rows.select("doc_id", "h").join(known, "doc_id").groupBy("doc_id", "h", "toxic").count(), "toxicity-labelled")
    classes = {r.toxic: r.n for r in pairs.groupBy("toxic").agg(F.sum("count").alias("n")).collect()}
    keys = [tuple(r) for toxic in (0, 1) for r in pairs.filter(F.col("toxic") == toxic).select("doc_id", "h", "toxic").orderBy("h", "doc_id").limit(SAMPLE).collect()]
    if not keys:
        return None
    wanted = F.broadcast(spark.createDataFrame(keys, "doc_id long, h long, toxic int"))  # at most SAMPLE rows a class
    found = sorted(rows.join(wanted, ["doc_id", "h"]).groupBy("toxic", "doc_id", "h").agg(F.first("text").alias("text")).collect())
    ys = [r.toxic for r in found]
    scale = [classes[y] / ys.count(y) for y in ys]
    least = min(scale, default=1.0)
    return fit([r.text for r in found], ys, [min(20.0, s / least) for s in scale])


def with_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with toxicity (score double, spans array)."""

    @F.pandas_udf(f"struct<score:double,spans:{SPANS}>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model) if model else None
        for texts in released(batches):
            values, spans = scorer(texts) if scorer else (np.zeros(len(texts)), [[] for _ in texts])
            yield pd.DataFrame({"score": values, "spans": [[{"start": a, "end": b} for a, b in own] for own in spans]})
        del scorer
        give_back()

    workers(docs.sparkSession)
    return docs.withColumn("toxicity", score(F.col("text").cast("binary")))


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row of docs (doc_id, text)."""
    scored = with_scores(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= threshold).cast("int").alias("predicted"),
        F.transform("toxicity.spans", lambda x: F.concat_ws(":", x.start, x.end)).alias("spans"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs below the threshold, with their own columns."""
    kept = with_scores(packed(docs, "text"), learn(docs, labels)).filter(F.col("toxicity.score") < threshold)
    return unpacked(kept, docs.columns)
