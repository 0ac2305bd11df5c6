"""Spans of regular expressions as DataFrame expressions: code-point offsets, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.llm.common import let

SPAN = "array<struct<s:int,e:int,m:string>>"
#: Elements that one level of the running sum covers.
CHUNK = 256


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running(values: Column) -> Column:
    """Sum of the elements before each element, by chunk sums, so that long arrays stay near linear."""

    def before(v: Column, sums: Column) -> Column:
        return F.transform(
            v,
            lambda x, i: _total(F.slice(sums, 1, F.floor(i / CHUNK).cast("int")))
            + _total(F.slice(v, (F.floor(i / CHUNK) * CHUNK + 1).cast("int"), (i % CHUNK).cast("int"))),
        )

    def chunks(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: _total(F.slice(v, c * CHUNK + 1, CHUNK)))

    return let(values, lambda v: let(chunks(v), lambda sums: before(v, sums)))


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches the empty string."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def place(m: Column, g: Column) -> Column:
        starts = running(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(g, i))))
        return let(
            starts,
            lambda s: F.transform(
                m,
                lambda x, i: F.struct(
                    (F.get(s, i) + F.length(F.get(g, i))).alias("s"),
                    (F.get(s, i) + F.length(F.get(g, i)) + F.length(x)).alias("e"),
                    x.alias("m"),
                ),
            ),
        )

    placed = let(matches, lambda m: let(gaps, lambda g: place(m, g)))
    return F.when(text.rlike(pattern), placed).otherwise(none())


def none() -> Column:
    return F.array().cast(SPAN)


def kind_spans(found: dict[str, Column]) -> Column:
    """One array of (s, o, e, k) of all kinds, o the kind's place in found."""

    def tagged(o: int, k: str):
        return lambda x: F.struct(x.s.alias("s"), F.lit(o).alias("o"), x.e.alias("e"), F.lit(k).alias("k"))

    return F.concat(*[F.transform(c, tagged(o, k)) for o, (k, c) in enumerate(found.items())])


def joined(spans: Column) -> Column:
    """kind:start:end of each of an array of (.., s, .., e, .., k), comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.k, x.s, x.e)), ",")


def masked(text: Column, spans: Column, marker: str) -> Column:
    """text with every stretch that sorted spans (s, e) cover replaced by the marker."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    kept = F.aggregate(
        spans,
        start,
        lambda a, x: F.when(x.e <= a.at, a)
        .when(x.s < a.at, F.struct(x.e.alias("at"), a.out.alias("out")))
        .otherwise(
            F.struct(
                x.e.alias("at"),
                F.concat(a.out, F.array(F.substring(text, a.at + 1, x.s - a.at), F.lit(marker))).alias("out"),
            )
        ),
    )
    rest = let(kept, lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a.at + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
