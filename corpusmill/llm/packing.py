"""Best-fit packing of documents into sequences of fixed capacity by large-item matching.

Documents become token ids and a separator; those longer than the capacity are cut into full pieces
and a rest. Packing works on the histogram of piece lengths, which the capacity bounds: pieces above
a third of the capacity are matched greedily, the longest first with the longest partner that still
fits, so at most two share a sequence; shorter ones go, longest first, to the tightest gap. The plan
is a list of runs (length, ranks, sequences), so its size depends on the capacity and not on the data,
and every piece finds its place from its rank among pieces of its length.

Defined cases: null or empty text is the separator alone; very long texts are cut like others; repeated
rows are packed once each; pieces of equal length, rows of equal doc_id among them, take their places in
the order of doc_id (null first), piece, start and checksum, and what ties there is interchangeable; a null
doc_id is packed like any other; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import workers, materialize, released
from corpusmill.llm.wordhash import Growing, Words, ranges

CAPACITY = 2048
SEPARATOR = 0
#: Chunks, and ids, that a worker keeps in each of two generations.
KEPT, KEPT_IDS = 600_000, 8_000_000
#: Pieces of one length that are ranked in one task, on average, at most.
RANKED = 50_000

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long>>"


#: Letters, which composition leaves alone and lower-casing maps one to one, and other such characters.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PLAIN = re.compile(f"[!-&(-~{LETTERS}\u00a1\u00ab\u00bb\u00bf]+")
PLAIN_CHUNKS = re.compile(f"[ -&(-~{LETTERS}\u00a1\u00ab\u00bb\u00bf]*")
#: Of plain characters: 0 blank, 1 letter, 2 digit, 3 other. A pre-token is a run of letters, a run of
#: others or a digit, and ends in one end-of-word token.
CLASSES = np.array([0 if c == 32 else 1 if re.match(f"[{LETTERS}]", chr(c)) else 2 if 48 <= c < 58 else 3 for c in range(0x250)], np.int8)
END_OF_WORD = "</w>"
#: The normalizer and the pre-tokenizer for which the above holds; load() takes no others.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def load(path: str):
    """The tokenizer; ValueError where it isn't one whose chunks between blanks are known to encode on their own."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    model = spec["model"]
    parts = [(spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers")]
    plain = model["type"] == "BPE" and model["end_of_word_suffix"] == END_OF_WORD and not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
    if parts != [NORMALIZER, PRE_TOKENIZER] or not plain or not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
        raise ValueError(f"{path}: chunks of this tokenizer aren't known to encode on their own")
    return tokenizer


class Encoder(Words):
    """Ids of texts (UTF-8) by chunks between blanks, which encode on their own: no pattern of the
    pre-tokenizer and no composition of the normalizer reaches over a blank. The ids of known chunks lie in
    one array, found by the chunks' hashes; new chunks of plain characters are encoded together and divided
    at end-of-word tokens. Memory is bounded by two generations of chunks."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True
        super().__init__(KEPT)

    def clear(self) -> None:
        self.ids, self.starts, self.sizes = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    @staticmethod
    def lowered(raw: bytes | None) -> bytes:
        """Letters are lower-cased by the normalizer anyway; not where they might then spell a special string."""
        raw = raw or b""
        return raw if b"<|" in raw else raw.lower()

    def encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after another, and how many each has."""
        if b"<|" not in (text := b" ".join(chunks)) and PLAIN_CHUNKS.fullmatch(plain := text.decode("utf-8", "surrogatepass")):
            kinds = CLASSES[np.frombuffer(plain.encode("utf-32-le"), "<u4")]
            begins = (kinds > 0) & ((kinds == 2) | (kinds != np.concatenate([[0], kinds[:-1]])))
            words = np.cumsum(begins)[np.append(np.flatnonzero(kinds == 0), len(kinds) - 1)]
            ids = np.array(self.tokenizer.encode_batch_fast([plain], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == words[-1]:
                return ids, np.diff(ends[words - 1], prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "surrogatepass") for c in chunks], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def full(self) -> bool:
        return super().full() or self.ids.n > KEPT_IDS

    def learn(self, keys: np.ndarray, seconds: np.ndarray, chunks: list[bytes]) -> None:
        special = np.array([b"<|" in c or not PLAIN.fullmatch(c.decode("utf-8", "surrogatepass")) for c in chunks], bool)
        for own in (np.flatnonzero(~special), np.flatnonzero(special)):
            for at in range(0, len(own), 2000):
                part = own[at : at + 2000]
                self.keep(keys[part], seconds[part], *self.encoded([chunks[i] for i in part.tolist()]))

    def keep(self, keys: np.ndarray, seconds: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.register(keys, seconds, self.starts.n)
        self.starts.extend(self.ids.n + np.cumsum(sizes) - sizes)
        self.ids.extend(ids)
        self.sizes.extend(sizes)

    def rows(self) -> tuple[np.ndarray, ...]:
        return self.ids.all, self.starts.all, self.sizes.all

    def carry(self, keys: np.ndarray, seconds: np.ndarray, places: np.ndarray, *rows: np.ndarray) -> None:
        ids, starts, sizes = rows
        self.keep(keys, seconds, ids[ranges(starts[places], sizes[places])], sizes[places])

    def __call__(self, texts) -> Iterator[np.ndarray]:
        for at, firsts in self.parts([self.lowered(t) for t in texts]):
            sizes = self.sizes.all[at]
            ids = self.ids.all[ranges(self.starts.all[at], sizes)]
            stops = np.concatenate([[0], np.cumsum(sizes)])[firsts]
            for start, stop in zip(stops[:-1], stops[1:]):
                yield ids[start:stop]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    return Encoder(path)


def cut(ids: np.ndarray, capacity: int, separator: int) -> list[dict]:
    raw = ids.astype("<u4").tobytes() + int(separator).to_bytes(4, "little")
    step = 4 * capacity
    return [
        {"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
        for k, at in enumerate(range(0, len(raw), step))
        for part in [raw[at : at + step]]
    ]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), a row for each piece of each row of docs."""

    @F.pandas_udf(PIECES)
    def divide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(tokenizer)
        for texts in released(batches):
            yield pd.Series([cut(ids, capacity, separator) for ids in encoder(texts)], dtype=object)

    workers(docs.sparkSession)
    return docs.select("doc_id", F.explode(divide(F.col("text").cast("binary"))).alias("p")).select("doc_id", "p.*")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces per sequence, offset) and the number of sequences.

    The piece of that length and rank r, from the run's first rank on to the next run of the length, goes
    to sequence first + (r - first rank) // per, at offset + (r - first rank) % per * length."""
    left = {n: c for n, c in histogram.items() if c}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    used = 0

    def put(length: int, first: int, n: int, per: int, offset: int) -> None:
        """n pieces of the length into sequences from first on, per in each."""
        runs.append((length, rank[length], first, per, offset))
        rank[length] += n
        left[length] -= n

    def leave(gap: int, first: int, n: int) -> None:
        if n:
            gaps.setdefault(gap, []).append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == a else 1):
                at -= 1
            b = large[at] if at >= 0 else None
            n = 0 if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            if n and a == b:
                put(a, used, 2 * n, 2, 0)
            elif n:
                put(a, used, n, 1, 0)
                put(b, used, n, 1, a)
            else:
                n, b = left[a], 0
                put(a, used, n, 1, 0)
            leave(capacity - a - b, used, n)
            used += n

    open_gaps = sorted(gaps)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                n = -(-left[length] // (capacity // length))
                leave(capacity, used, n)
                open_gaps.append(capacity)
                used += n
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            per = gap // length
            full = min(n, left[length] // per)
            remains: list[tuple[int, int, int]] = []
            if full:
                put(length, first, full * per, per, capacity - gap)
                remains.append((gap - per * length, first, full))
            if full < n and left[length]:
                part = left[length]  # fewer than per
                put(length, first + full, part, part, capacity - gap)
                remains.append((gap - part * length, first + full, 1))
                full += 1
            remains.append((gap, first + full, n - full))
            for g, f, k in remains:
                if k:
                    if g not in gaps:
                        bisect.insort(open_gaps, g)
                    leave(g, f, k)
    return runs, used


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    cut_up = materialize(pieces(docs, tokenizer, capacity, separator), "packing-pieces")
    histogram = {r.length: r["count"] for r in cut_up.groupBy("length").count().collect()}  # at most capacity rows
    runs, _ = plan(histogram, capacity)
    # A length is ranked in as many tasks as it has pieces for: each gets a salt and goes on where the ones before it end.
    ranked = min(RANKED, max(256, sum(histogram.values()) // capacity))
    salts = F.broadcast(spark.createDataFrame([(n, -(-c // ranked)) for n, c in histogram.items()], "length long, salts long"))
    salted = cut_up.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    by_length: dict[int, list] = {}
    for length, *run in sorted(runs):
        by_length.setdefault(length, []).append(run)
    known = spark.sparkContext.broadcast({n: np.array(r, np.int64).T for n, r in by_length.items()})

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        tables, n, r = known.value, length.to_numpy(), ranks.to_numpy()
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for value in np.unique(n):
            own = np.flatnonzero(n == value)
            rank = r[own]
            firsts, bins, per, base = tables[int(value)]
            run = np.searchsorted(firsts, rank, side="right") - 1
            sequence[own] = bins[run] + (rank - firsts[run]) // per[run]
            offset[own] = base[run] + (rank - firsts[run]) % per[run] * value
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("within", F.row_number().over(within) - 1).join(before, ["length", "salt"])
    placed = numbered.withColumn("at", place("length", F.col("before") + F.col("within")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
