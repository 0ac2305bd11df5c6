"""Language identification by interpolated Kneser-Ney character models held in sorted hash arrays.

Every learnt language has a model of ORDER characters within words, counted over all learning rows:
tasks count words, then their n-grams, and only n-gram counts are shuffled. Lower orders use
continuation counts, every order its own absolute discount. The models of all languages share one
sorted array of n-gram hashes per order, with the probabilities of the languages that know each. A text gets the
language of lowest cross-entropy per character; a limit per language, calibrated on all learning texts,
marks texts that no model explains (column rejected). Bits are whole numbers of a small unit, so sums are exact:
results depend neither on the order of rows nor on where the models are held.

Defined cases: null text, or text without a letter, is `und` with score 0; rows without a language, or
whose id's fold is held out, are never learnt from; a null doc_id is held out; with nothing to learn
from every text is `und`; of languages of equal cross-entropy the first by name is taken; very long texts
are read whole, and each word counts as often as it occurs; repeated rows get the same answer, whatever
rows are beside them; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, workers
from corpusmill.llm.wordhash import Rows, ranges, sums

ORDER = 4
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
START, END = "\x02", "\x03"
#: Distinct words that a task counts before it hands on their n-grams.
WORDS = 200_000
#: N-grams of all languages up to which their models are held by every worker, some 40 bytes each.
BROADCAST_GRAMS = 5_000_000
#: Bits are counted in this part of one; their sums are exact in a double up to some 100 million characters.
UNIT = 2.0**-20
#: Standard deviations above a language's mean cross-entropy from which a text is marked.
LIMIT_SD = 5.0
#: Characters whose evidence the score counts at most.
SHARPNESS = 24.0
KEPT = 400_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def letters(chunk: str) -> str:
    return "".join(filter(str.isalpha, chunk)).lower()


def grams(words: Counter) -> Counter:
    """Counts of ORDER-grams of words, with marks around each."""
    out: Counter = Counter()
    for chunk, n in words.items():
        if word := letters(chunk.decode("utf-8", "replace")):
            s = START * (ORDER - 1) + word + END
            for i in range(len(s) - ORDER + 1):
                out[s[i : i + ORDER]] += n
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: dict[str, Counter] = defaultdict(Counter)

    def handed_on():
        for lang, own in words.items():
            g = grams(own)
            yield pd.DataFrame({"lang": lang, "gram": list(g), "n": np.fromiter(g.values(), np.int64, len(g))})
        words.clear()

    for pdf in batches:
        for lang, text in zip(pdf.lang, pdf.text):
            words[lang].update(text.lower().split())
        if sum(map(len, words.values())) > WORDS:
            yield from handed_on()
    yield from handed_on()


def _codes(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the length characters that end at each position from length-1 on."""
    n = len(codes) - length + 1
    h = np.full(max(n, 0), length, np.uint64)
    for k in range(length):
        h = (h ^ codes[k : k + n]) * PRIME
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Sparse:
    """A row of numbers by language for each of sorted hashes, only those that differ from the default held."""

    keys: np.ndarray
    starts: np.ndarray  # of each key's entries, and the end of the last
    langs: np.ndarray
    values: np.ndarray
    default: float

    @classmethod
    def of(cls, keys: np.ndarray, row: np.ndarray, lang: np.ndarray, values: np.ndarray, default: float) -> Sparse:
        """From entries (row among the keys, language, value), no two of a row and language."""
        order = np.argsort(row, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(keys)))])
        return cls(keys, starts.astype(np.int64), lang[order].astype(np.int32), values[order], default)

    def __call__(self, h: np.ndarray, size: int) -> np.ndarray:
        """The rows (len(h), size) of hashes; the default where there is none."""
        out = np.full((len(h), size), self.default)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == h)
            sizes = self.starts[at[hit] + 1] - self.starts[at[hit]]
            entry = ranges(self.starts[at[hit]], sizes)
            out[np.repeat(hit, sizes), self.langs[entry]] = self.values[entry]
        return out


@dataclass
class Order:
    share: Sparse  # by n-gram: discounted probability
    rest: Sparse  # by context: weight of the lower order


@dataclass
class Model:
    languages: list[str]
    orders: list[Order]
    floor: float  # probability of a character under no model


def _row_hashes(codes: np.ndarray) -> np.ndarray:
    """_hashes of each row of an array of code points."""
    h = np.full(len(codes), codes.shape[1], np.uint64)
    for column in codes.T:
        h = (h ^ column.astype(np.uint64)) * PRIME
        h ^= h >> np.uint64(29)
    return h


def assembled(languages: list[str], codes: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Model | None:
    """The model of distinct n-grams of languages (their places): ORDER code points a row, and their counts."""
    if not languages:
        return None
    orders: list[Order] = []
    size = len(languages)
    for _ in range(ORDER):
        keys, at = np.unique(_row_hashes(codes), return_inverse=True)
        contexts, head = np.unique(_row_hashes(codes[:, :-1]), return_inverse=True)
        once, twice = np.bincount(lang[n == 1], minlength=size), np.bincount(lang[n == 2], minlength=size)
        discount = np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.5)
        slots, slot = np.unique(head * size + lang, return_inverse=True)
        total, kinds, whose = np.bincount(slot, n), np.bincount(slot), slots % size
        share = Sparse.of(keys, at, lang, (n - discount[lang]) / total[slot], 0.0)
        orders.insert(0, Order(share, Sparse.of(contexts, slots // size, whose, discount[whose] * kinds / total, 1.0)))
        # continuation counts: in how many n-grams a shorter one ends
        tail = np.unique(_row_hashes(codes[:, 1:]), return_inverse=True)[1]
        _, first, n = np.unique(tail * size + lang, return_index=True, return_counts=True)
        codes, lang = codes[first, 1:], lang[first]
    return Model(languages, orders, 1.0 / (1 + len(orders[0].share.keys)))


def build(counts: dict[str, dict[str, int]]) -> Model | None:
    """The model of language: {n-gram: count}."""
    languages = sorted(counts)
    codes = _codes([g for k in languages for g in counts[k]]).astype("<u4").reshape(-1, ORDER)
    lang = np.repeat(np.arange(len(languages)), [len(counts[k]) for k in languages])
    return assembled(languages, codes, lang, np.array([n for k in languages for n in counts[k].values()], np.int64))


def units(p: np.ndarray) -> np.ndarray:
    """Bits of probabilities, in UNITs."""
    return np.rint(-np.log2(p) / UNIT)


def word_bits(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each word (of letters) under each language in UNITs, and its characters with the end mark."""
    lengths = np.array([len(w) + 1 if w else 0 for w in words])
    padded = [START * (ORDER - 1) + w + END for w in words if w]
    bits = np.zeros((len(words), len(model.languages)))
    if not padded:
        return bits, lengths
    codes = _codes(padded)
    # the positions of characters to predict: all but the marks in front
    sizes = lengths[lengths > 0]
    starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    ends = np.repeat(starts + ORDER - 1 - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    p = np.full((len(ends), len(model.languages)), model.floor)
    for k, order in enumerate(model.orders, 1):
        h = _hashes(codes, k)[ends - k + 1]
        context = _hashes(codes, k - 1)[ends - k + 1] if k > 1 else np.zeros(len(ends), np.uint64)
        p = order.share(h, p.shape[1]) + order.rest(context, p.shape[1]) * p
    firsts = np.cumsum(sizes) - sizes
    bits[lengths > 0] = np.add.reduceat(units(p), firsts, axis=0)
    return bits, lengths


class Identifier:
    def __init__(self, model: Model):
        self.model = model
        self.known = Rows(self._rows, len(model.languages) + 1, KEPT)

    def _rows(self, chunks: list[bytes]) -> np.ndarray:
        return np.column_stack(word_bits(self.model, [letters(c.decode("utf-8", "replace")) for c in chunks]))

    def totals(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text (UTF-8) under each language in UNITs, and its characters (0: no letter)."""
        parts = [sums(*part) for part in self.known([(t or b"").lower() for t in texts])]
        total = np.concatenate([np.zeros((0, self.known.width)), *parts])
        return total[:, :-1], np.rint(total[:, -1]).astype(np.int64)

    def entropy(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text (UTF-8) under each language, and its characters (0: no letter)."""
        total, chars = self.totals(texts)
        return total * UNIT / np.maximum(chars, 1)[:, None], chars

    def __call__(self, texts, taught) -> pd.DataFrame:
        return answers(*self.totals(texts), self.model.languages, taught)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _collected(counts: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """What assembled() takes of counts (lang, gram, n): through Arrow, some 40 bytes an n-gram and no objects."""
    table = counts.select("lang", "gram", "n").toArrow()
    if not table.num_rows:
        return [], np.zeros((0, ORDER), "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
    named = table["lang"].combine_chunks().dictionary_encode()
    found = named.dictionary.to_pylist()
    languages = sorted(found)
    place = np.array([languages.index(x) for x in found], np.int64)
    codes = np.concatenate([_codes(["".join(c.to_pylist())]).astype("<u4") for b in table["gram"].chunks for c in _slices(b)])
    return languages, codes.reshape(-1, ORDER), place[named.indices.to_numpy()], table["n"].to_numpy()


def _slices(chunk, rows: int = 100_000):
    return [chunk.slice(i, rows) for i in range(0, len(chunk), rows)]


def _learning(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).filter(~held_out(F.col("doc_id")))


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of the learning rows of docs (doc_id, text, lang), as a table."""
    workers(docs.sparkSession)
    rows = _learning(docs).select("lang", F.col("text").cast("binary").alias("text"))
    counts = rows.mapInPandas(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return materialize(counts, "language-counts")


def learn(docs: DataFrame, counts: DataFrame | None = None) -> Model | None:
    """The models of all languages of docs (doc_id, text, lang), held-out rows left out."""
    return assembled(*_collected(_counts(docs) if counts is None else counts))


ANSWER = "struct<lang_pred:string,score:double,least:long,own:long>"


def answers(total: np.ndarray, chars: np.ndarray, languages: list[str], taught) -> pd.DataFrame:
    """(lang_pred, score, least, own) from bits by language in UNITs and numbers of characters. least is the cross-entropy
    in UNITs under lang_pred, null without letters; own that under the language a learning row teaches, null for others.
    What a row teaches has no part in its prediction."""
    h = total / np.maximum(chars, 1)[:, None]
    row, best = np.arange(len(h)), h.argmin(1)
    least = h[row, best]
    sharp = np.minimum(chars, SHARPNESS)[:, None] * UNIT
    score = np.where(chars > 0, 1 / np.exp2(-(h - least[:, None]) * sharp).sum(1), 0.0)
    place = {x: j for j, x in enumerate(languages)}
    at = np.array([place.get(x, -1) for x in taught], np.int64)
    whole = lambda x, known: pd.arrays.IntegerArray(np.rint(x).astype(np.int64), ~known)
    pred = np.where(chars > 0, np.array(languages, object)[best], UNKNOWN)
    return pd.DataFrame({"lang_pred": pred, "score": score, "least": whole(least, chars > 0), "own": whole(h[row, at], (chars > 0) & (at >= 0))})


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, held_out, taught, text): taught is the language of a learning row, text binary."""
    out = F.col("text").isNull() | held_out(F.col("doc_id"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(~out, F.col("lang")).alias("taught"), F.col("text").cast("binary").alias("text"), *more)


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs (doc_id, text, lang). Models of at most
    BROADCAST_GRAMS n-grams go to every worker; larger ones stay tables, which the documents' n-grams meet in joins,
    with the same numbers. Limits of rejection come from all learning rows, once all rows have answers."""
    counts = _counts(docs)
    n = counts.count()
    if not n:
        return _rows(docs).select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    answered = joined_answers(docs, counts) if n > BROADCAST_GRAMS else held_answers(docs, learn(docs, counts))
    return _limited(materialize(answered.select("doc_id", "held_out", "taught", "x.*"), "language-answers"))


def held_answers(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, taught, x: ANSWER) by a model that every worker holds."""

    @F.pandas_udf(ANSWER)
    def identify(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        identifier = Identifier(model)
        for texts, taught in batches:
            yield identifier(texts, taught)

    return _rows(docs).select("doc_id", "held_out", "taught", identify("text", "taught").alias("x"))


def _limited(answered: DataFrame) -> DataFrame:
    """The report of a table of answers. A language's limit is LIMIT_SD standard deviations above the mean of what its
    learning rows have, from sums that are exact."""
    spread = answered.filter("own is not null").groupBy("taught").agg(
        F.count("*").alias("n"), F.sum("own").alias("s"), F.sum((F.col("own") * F.col("own")).cast("decimal(38,0)")).alias("q")
    )
    limits = [(r.taught, (r.s + LIMIT_SD * math.sqrt(r.n * int(r.q) - r.s**2)) / r.n) for r in spread.collect() if r.n > 1]  # a row a language
    known = answered.sparkSession.createDataFrame(limits, "lang_pred string, limit double")
    rejected = F.col("least").isNull() | F.coalesce(F.col("least") > F.col("limit"), F.lit(False))
    return answered.join(F.broadcast(known), "lang_pred", "left").select("doc_id", "held_out", "lang_pred", "score", rejected.alias("rejected"))


# --- models too large for a worker ----------------------------------------------------------------------


def _row_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for rid, text in zip(pdf.rid, pdf.text):
            own = grams(Counter((text or b"").lower().split()))
            if own:
                yield pd.DataFrame({"rid": rid, "gram": list(own), "n": np.fromiter(own.values(), np.int64, len(own))})


def _by_language(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, map of language to value): as many entries as there are languages, at most."""
    return df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias(value))


def _gram_bits(asked: DataFrame, counts: DataFrame, languages: list[str]) -> DataFrame:
    """(gram, bits) of asked (gram): the bits of its last character after the others in UNITs, an array by language."""

    @F.pandas_udf("array<long>")
    def bits(p: pd.Series) -> pd.Series:
        return pd.Series(list(units(np.stack(p)).astype(np.int64)) if len(p) else [], dtype=object)  # as word_bits() has them


    orders, table = [], counts
    for k in range(ORDER, 0, -1):
        told = table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))  # a row a language
        discount = F.when((F.col("once") > 0) & (F.col("twice") > 0), F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.5)
        spread = table.join(F.broadcast(told.select("lang", discount.alias("d"))), "lang").withColumn("context", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        contexts = spread.groupBy("lang", "context", "d").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        share = spread.join(contexts.select("lang", "context", "total"), ["lang", "context"]).select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"))
        rest = contexts.select("lang", "context", (F.col("d") * F.col("kinds") / F.col("total")).alias("rest"))
        orders.insert(0, (_by_language(share, "gram", "share"), _by_language(rest, "context", "rest")))
        table = materialize(table.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "language-order") if k > 1 else table
    floor = 1.0 / (1 + table.select("gram").distinct().count())
    names = F.array(*[F.lit(x) for x in languages])
    out = asked.select("gram", F.array_repeat(F.lit(floor), len(languages)).alias("p"))
    for k, (share, rest) in enumerate(orders, 1):
        own = out.withColumn("__g", F.right("gram", F.lit(k))).withColumn("__c", F.expr(f"substring(__g, 1, {k - 1})") if k > 1 else F.lit(""))
        own = own.join(share.withColumnRenamed("gram", "__g"), "__g", "left").join(rest.withColumnRenamed("context", "__c"), "__c", "left")
        given = F.transform(names, lambda x: F.struct(F.coalesce(F.try_element_at("share", x), F.lit(0.0)).alias("s"), F.coalesce(F.try_element_at("rest", x), F.lit(1.0)).alias("r")))
        out = own.select("gram", F.zip_with(given, "p", lambda g, p: g.s + g.r * p).alias("p"))
    return out.select("gram", bits("p").alias("bits"))


def joined_answers(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """held_answers() by joins: each document's n-grams and their numbers meet the n-grams' bits. No model is held by a
    worker or the driver."""
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())  # a row a language
    rows = materialize(_rows(docs, F.monotonically_increasing_id().alias("rid")), "language-rows")
    own = materialize(rows.select("rid", "text").mapInPandas(_row_grams, "rid long, gram string, n long"), "language-grams")
    bits = _gram_bits(own.select("gram").distinct(), counts, languages)
    sums = [F.sum(F.col("n") * F.col("bits")[j]).alias(f"b{j}") for j in range(len(languages))]
    total = own.join(bits, "gram").groupBy("rid").agg(F.sum("n").alias("chars"), *sums)
    total = total.select("rid", "chars", F.array(*[f"b{j}" for j in range(len(languages))]).alias("total"))

    @F.pandas_udf(ANSWER)
    def identify(total: pd.Series, chars: pd.Series, taught: pd.Series) -> pd.DataFrame:
        values = np.array([np.zeros(len(languages)) if x is None else x for x in total], float).reshape(-1, len(languages))
        return answers(values, chars.fillna(0).to_numpy(np.int64), languages, taught)

    return rows.drop("text").join(total, "rid", "left").select("doc_id", "held_out", "taught", identify("total", "chars", "taught").alias("x"))
