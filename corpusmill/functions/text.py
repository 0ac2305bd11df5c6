"""Text expressions with Unicode white space as Python's str methods see it."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the code points that count as white space, as one class for Java and RE2.
WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: The control strings of the chat format; none may occur in content.
CONTROL_TOKENS = ("<|pad|>", "<|bos|>", "<|eos|>", "<|unk|>", "<|im_start|>", "<|im_end|>")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}+", ""), f"{WS}+$", "")


def clean(text: Column) -> Column:
    """strip(), null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


# The optimizer copies deterministic expressions into the null filters of joins, where the function would run again.
_nfkc = _nfkc.asNondeterministic()


def normalize(text: Column) -> Column:
    """NFKC, then white space collapsed. A conditional doesn't keep rows from a Python function, so texts in
    ASCII, which NFKC leaves as they are, go there as nulls."""
    return collapse(F.coalesce(_nfkc(F.when(text.rlike("[^\\x00-\\x7f]"), text)), text))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def has_control(text: Column, tokens: Sequence[str] = CONTROL_TOKENS) -> Column:
    return text.rlike("|".join("\\Q" + t + "\\E" for t in tokens))


def escape_control(text: Column, tokens: Sequence[str] = CONTROL_TOKENS, instead: str = "[control token]", empty: str = "[empty response]") -> Column:
    """text with control strings replaced, and a text of nothing named."""
    out = F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(text)
    for t in tokens:
        out = F.replace(out, F.lit(t), F.lit(instead))
    return out


def same_folded(a: Column, b: Column) -> Column:
    """Equality without case, for texts in ASCII."""
    return F.lower(a) == F.lower(b)


def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


#: What identifiers, digests and versions look like.
IDENTIFIER, SHA256, VERSION = "[a-z0-9][a-z0-9._-]*", "[0-9a-f]{64}", "[0-9]+\\.[0-9]+(\\.[0-9]+)?"


def full_match(text: Column, pattern: str) -> Column:
    """Whether the whole text matches; null doesn't."""
    return F.coalesce(text.rlike(f"\\A(?:{pattern})\\z"), F.lit(False))


def dotted(record: Column, path: str) -> Column:
    """A string at a dotted path of JSON, or null; of numbers and booleans their text."""
    return F.get_json_object(record, "$." + path)


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; of a key in both the second's value."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(kept, second)


def utc_seconds(at: Column) -> Column:
    """ISO time in seconds of a timestamp, in UTC where the session is."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def excerpt(text: Column, start: Column, length: Column, limit: int) -> Column:
    """At most limit characters of text around the length characters from start (0-based) on."""
    size = F.length(text)
    half = F.greatest(F.lit(0), F.floor((F.lit(limit) - length) / 2))
    right = F.least(size, F.greatest(F.lit(0), start - half) + limit)
    left = F.greatest(F.lit(0), right - limit)
    return F.when(size <= limit, text).otherwise(F.substring(text, (left + 1).cast("int"), (right - left).cast("int")))


def repeated_share(tokens: Column, n: int = 3) -> Column:
    """The share of n-grams of an array that repeat an earlier one; 0 without n-grams. The n-grams are compared as
    strings, which are hashed (arrays of arrays are compared pair by pair); tokens hold no NUL."""
    count = F.size(tokens) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), "\0", ""))
    return F.when(count > 0, (count - F.size(F.array_distinct(grams))) / count).otherwise(F.lit(0.0))
