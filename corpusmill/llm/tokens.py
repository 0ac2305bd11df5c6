"""Token counts of whole texts by the whole-token shortcut.

A text is divided before every run of blanks. Offline it is proved that no vocabulary string goes on
past such a place, so the pre-tokens encode independently, and which vocabulary strings encode alone
as one token. Those count one without running a merge; only other pre-tokens are merged, by the
library, and their counts are kept in a bounded table.

Defined cases: null text counts as empty (0 tokens, 0 bytes); a null doc_id is kept; very long texts are
counted whole, one at a time; repeated rows, and rows of equal doc_id, are each counted; a text of just the
limit isn't over it; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import workers

#: Tokens beyond which a document is over the limit.
LIMIT = 4096
#: Pre-tokens whose counts a worker keeps; when there are more it starts again from the proved ones. Longer ones than
#: KEPT_CHARS aren't kept, so that texts without blanks don't fill its memory.
KEPT, KEPT_CHARS = 400_000, 64
BLANK = "▁"


@lru_cache(maxsize=4)
def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@lru_cache(maxsize=4)
def whole_tokens(model: str) -> tuple[str, ...]:
    """Vocabulary strings (their leading blank left out) that encode alone as one token.

    Raises ValueError where the vocabulary has a string with a blank after another character: then
    pre-tokens would not encode independently."""
    sp = load(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        raise ValueError("a vocabulary string crosses a blank")
    words = [p[1:] for p in pieces if p.startswith(BLANK) and len(p.lstrip(BLANK)) == len(p) - 1 > 0]
    return tuple(w for w, ids in zip(words, sp.encode(words, num_threads=1)) if len(ids) == 1)


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, the last blank before each left out: they encode as they do in place."""
    parts = text.replace(BLANK, " ").split(" ") if text else []
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if p:
            out.append(" " * run + p)
            run = 0
        else:
            run += 1
    if run:
        out.append(" " * (run - 1))  # the model's own blank in front makes up the last
    return out


class Counter:
    """Token counts of texts. known: pre-token to count."""

    def __init__(self, model: str, proved: tuple[str, ...]):
        self.sp, self.proved = load(model), proved
        self.known = self.fresh()

    def fresh(self) -> dict[str, int]:
        return dict.fromkeys(self.proved, 1) | {"": 1}  # "": a single blank at the end

    def __call__(self, texts) -> list[int]:
        return [self.count(t or "") for t in texts]

    def count(self, text: str) -> int:
        words = pretokens(text)
        if len(self.known) > KEPT:
            self.known = self.fresh()
        rest = [w for w in set(words) if w not in self.known]
        found = dict(zip(rest, map(len, self.sp.encode(rest, num_threads=1))))
        self.known.update((w, n) for w, n in found.items() if len(w) <= KEPT_CHARS)
        if all(len(w) <= KEPT_CHARS for w in rest):
            return sum(map(self.known.__getitem__, words))
        return sum(found[w] if w in found else self.known[w] for w in words)


@lru_cache(maxsize=2)
def _counter(model: str, proved: tuple[str, ...]) -> Counter:
    return Counter(model, proved)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text)."""
    proved = whole_tokens(model)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model, proved)
        for texts in batches:
            yield pd.Series(counter(texts), dtype="int64")

    workers(docs.sparkSession)
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
