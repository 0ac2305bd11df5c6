"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each rule names a ratio over the text (length, symbols, stop words, lines, repeated windows) and the
range it has to stay in. The table becomes one Boolean expression; no user function runs.

Defined cases: null or blank text has no words and fails the base rule; very long texts are measured
whole; repeated rows are judged alike; an empty table gives an empty result; further columns are
ignored (quality_filter keeps them)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import WORD, let, packed, unpacked

SPACE = "\x20\t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by at this or an from a "
    "de la le les et des un une du en que qui pour dans est sur au par pas plus "
    "der die und den das von zu mit sich des auf ist im dem nicht ein eine "
    "el los las y del se por con no su para al lo"
).split()

#: (rule, measure, least, most); None: no bound on that side. A document is kept within all of them.
THRESHOLDS = (
    ("mean word length", "chars_per_word", 1.5, 24.0),
    ("symbols", "symbols_per_word", None, 0.5),
    ("exclamations", "exclamations_per_word", None, 0.5),
    ("stop words", "stop_words_per_word", 0.01, None),
    ("repeated lines", "dup_lines_per_line", None, 0.5),
)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of WINDOW words that occurs at least twice in the array."""

    def numbered(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]).alias("v"), i.alias("i")),
        )

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1).v == x.v) | (F.get(s, k + 1).v == x.v))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
        return F.aggregate(
            p,
            start,
            lambda a, i: F.struct((a.n + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
            lambda a: a.n,
        )

    count = let(F.sort_array(let(words, numbered)), lambda s: covered(places(s)))
    return F.when(F.size(words) > WINDOW, count).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """docs (.., text) with the counts that the rules need."""
    t = F.coalesce("text", F.lit(""))
    split = docs.withColumn("words", words_of(F.col("text")))
    w = F.col("words")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    out = split.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": (F.length(t) - F.regexp_count(t, F.lit("[\\x20\\x09-\\x0D]"))).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_exclamations": F.regexp_count(t, F.lit("!")).cast("long"),
            "n_lines": let(lines, lambda x: F.size(x)).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            "n_repeat_words": repeated_words(w).cast("long"),
        }
    )
    return out.drop("words")


MEASURES = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "exclamations_per_word": ("n_exclamations", "n_words"),
    "stop_words_per_word": ("n_stop_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
}


def within(thresholds=THRESHOLDS) -> Column:
    """The table as one expression over the columns of measured()."""
    parts = []
    for _, measure, least, most in thresholds:
        over, under = MEASURES[measure]
        if least is not None:
            parts.append(F.col(over) >= F.col(under) * F.lit(float(least)))
        if most is not None:
            parts.append(F.col(over) <= F.col(under) * F.lit(float(most)))
    return reduce(and_, parts, F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_report(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row."""
    m = measured(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within(thresholds)).alias("kept")
    )


def quality_filter(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns."""
    kept = measured(packed(docs, "text")).filter(~base_failed() & within(thresholds))
    return unpacked(kept, docs.columns)
