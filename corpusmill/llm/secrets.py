"""Secret scans over a trigram inverted index, in DataFrame functions alone.

From each rule's regex a Boolean query over trigrams of the lower-cased text is derived. The index has
a posting (trigram, row) for every trigram that some query names; intersecting the postings of a row
gives the rules that may match it, and only those are verified with the regex, over the whole text.
Rules from which no trigram follows (hexadecimal runs) scan every text.

Defined cases: null text counts as empty; repeated rows are each reported; a null doc_id is kept;
overlapping spans of different kinds are all reported; an empty table gives an empty result; further
columns are ignored."""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, packed, unpacked
from corpusmill.llm.spans import find, joined, kind_spans, masked, none

#: Fixed patterns: the base kinds, in their order, then those that the method adds.
RULES = {
    "assign": "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
    "forge": "gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": "xox[abprs]-[A-Za-z0-9-]{10,}",
    "cloud": "AIza[A-Za-z0-9_-]{35}",
    "webtoken": "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}",
    "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
#: What redaction takes for a pem span: the key up to its END line or, where that is missing, over the header
#: fields and base64 lines that follow. The report's span stays the BEGIN line, as in its SQL.
KEY = (
    RULES["pem"]
    + "(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    + "|(?:\\s*+(?:Proc-Type|DEK-Info): [^\\n]*+)*+(?:(?:\\s|\\\\[nr]|[\"'>])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\\s|\\\\[nr]|[\"'>])++[A-Za-z0-9+/=]++(?=[\"']?[^\\S\\n]*(?:\\n|$)|\\\\[nr]))*+)"
)
BASE = ("assign", "access", "hex")
#: Code points that group 2 of an assignment has at least.
VALUE = 8
#: Candidate rows up to which they are broadcast (some 50 MB); beyond it rows meet in a shuffle.
BROADCAST_ROWS = 1_000_000
#: Strings that a part of a pattern may stand for before the query gives up on them.
STRINGS = 64

Query = frozenset[frozenset[str]]
#: Trigrams in disjunctive form: one conjunction has to be there in full. A rule that needs none.
ANY: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x, y in product(a, b))


def _needs(strings: set[str]) -> Query:
    terms = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return ANY if not strings or frozenset() in terms else frozenset(terms)


def _strings(node) -> set[str] | None:
    """The lower-cased strings that a part stands for, or None where they are too many."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        out: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                out.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < STRINGS:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[3])
    if kind is op.BRANCH:
        parts = [_sequence_strings(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] == 1:
        inner = _sequence_strings(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        own = _strings(node)
        if own is None or len(out) * len(own) > STRINGS:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def trigram_query(pattern: str) -> Query:
    """What trigrams a text has to have, lower-cased, for the pattern to match it."""

    def walk(nodes) -> Query:
        query, strings = ANY, {""}
        for node in nodes:
            own = _strings(node)
            if own is not None and len(strings) * len(own) <= STRINGS:
                strings = {a + b for a, b in product(strings, own)}
                continue
            query, strings = _both(query, _needs(strings)), {""}
            if own is not None and len(own) <= STRINGS:
                strings = own
                continue
            kind, value = node
            if kind is op.SUBPATTERN:
                query = _both(query, walk(value[3]))
            elif kind is op.BRANCH:
                query = _both(query, frozenset().union(*(walk(x) for x in value[1])))
            elif kind is op.MAX_REPEAT and value[0] >= 1:
                query = _both(query, walk(value[2]))
        return _both(query, _needs(strings))

    query = walk(parser.parse(pattern))
    return frozenset(t for t in query if not any(o < t for o in query))


def row_key(text: Column) -> Column:
    """Stands for a row in the index; rows that share it are verified one by one all the same."""
    return F.xxhash64("doc_id", text)


def candidates(docs: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, rules) for rows of docs (doc_id, text) that may match, rules the bits of queries in order."""
    grams = sorted({g for q in queries.values() for term in q for g in term})
    at = {g: i for i, g in enumerate(grams)}
    text = F.coalesce("text", F.lit(""))
    lower = docs.select(row_key(text).alias("key"), F.lower(text).alias("low"))
    named = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(i)) for g, i in at.items()]))
    postings = lower.select("key", F.explode(named).alias("gram"))
    words = range(0, len(grams), 62)
    bits = [F.expr(f"bit_or(if(gram between {w} and {w + 61}, shiftleft(1L, gram - {w}), 0L)) as w{w}") for w in words]
    lists = postings.groupBy("key").agg(*bits)

    def holds(term: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in words:
            if need := sum(1 << (at[g] - w) for g in term if w <= at[g] < w + 62):
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(need)) == need)
        return out

    rules = F.lit(0)
    for i, q in enumerate(queries.values()):
        either = F.lit(False)
        for term in sorted(q, key=sorted):
            either = either | holds(term)
        rules = rules + F.when(either, 1 << i).otherwise(0)
    return lists.select("key", rules.cast("int").alias("rules")).filter("rules > 0")


def with_secrets(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """docs with found_<rule>, an array of (s, e, m), for each rule."""
    queries = {k: trigram_query(p) for k, p in rules.items()}
    indexed = {k: q for k, q in queries.items() if q != ANY}
    few = materialize(candidates(docs.select("doc_id", "text"), indexed), "secrets-candidates")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("__key", row_key(text)).join(few.withColumnRenamed("key", "__key").withColumnRenamed("rules", "__rules"), "__key", "left")
    out = {}
    for k, p in rules.items():
        spans = find(text, p)
        if k == "assign":
            spans = F.filter(spans, lambda x: F.length(F.regexp_extract(x.m, RULES["assign"], 2)) >= VALUE)
        if k in indexed:
            bit = 1 << list(indexed).index(k)
            spans = F.when(F.col("__rules").bitwiseAND(F.lit(bit)) != 0, spans).otherwise(none())
        out[f"found_{k}"] = spans
    return keyed.withColumns(out).drop("__key", "__rules")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs (doc_id, text)."""
    found = with_secrets(docs.select("doc_id", "text"))
    base = F.array_sort(kind_spans({k: f"found_{k}" for k in BASE}))
    every = F.array_sort(kind_spans({k: f"found_{k}" for k in RULES}))
    return found.select(
        "doc_id",
        *[F.size(f"found_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )


def redact(docs: DataFrame, marker: str = "[SECRET]") -> DataFrame:
    """docs with every found secret in text replaced by the marker, and n_chars, if there, brought in line."""
    found = with_secrets(packed(docs, "doc_id", "text"), RULES | {"pem": KEY})
    spans = F.array_sort(kind_spans({k: F.col(f"found_{k}") for k in RULES}))
    found = found.withColumn("masked", masked(F.col("text"), spans, marker))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("masked") != F.col("text"), F.length("masked")).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    return unpacked(found, docs.columns, **new)
