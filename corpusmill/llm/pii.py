"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Strict patterns give the base spans. High-recall generators propose further candidates, which may overlap
one another: runs of digits with and without signs between them, and addresses whose signs may be spelt
out. Boosted trees judge each from format and context, all small integers; whether a checksum, a range of
bytes or a leading plus holds, which makes a base span, isn't among them.

Labels aren't the base spans alone: each base span stands for its written variants too (signs between the
digits changed or left out, the plus or the country's code missing, an address spelt out), in its own
context. Other candidates are unlabelled, with the same variants, so that signs by themselves tell nothing:
those that score like base spans in folds the trees never saw aren't held against them, the others are the
negatives. Examples are counted by feature values (a table bounded by the product of their ranges) over the whole corpus, in folds
by text: a kind's threshold is the least at which candidates of held-out folds reach PRECISION. Trees and
thresholds become one expression. Of selected candidates that overlap, the one of higher score stays.

Defined cases: null text counts as empty; a candidate that overlaps a base span isn't added; where no
candidate, or no base span to learn from, is seen nothing is added; of equal scores the longer span, then
the earlier one stays; repeated rows are each reported and each counted; a null doc_id is kept; texts of
any length are searched whole, in time near linear; an empty table gives an empty result; further columns
are ignored (with_pii keeps them)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import boosting
from corpusmill.llm.common import let, materialize, packed
from corpusmill.llm.spans import find, joined, kind_spans, none

PRECISION = 0.98
FOLDS = 5

#: Fixed patterns. They match what the plain forms match from left to right, but can't backtrack at
#: length: a match begins where a run of its characters begins or the last match ended.
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
CARD = "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){15,18}(?![\\x20-]?[0-9])"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Generators of candidates by kind: numbers whose groups are kept together, over blanks and without them, or are three
#: as telephone numbers have, and addresses with or without their signs spelt out.
GENERATORS = (
    ("number", "\\+?\\(?[0-9][0-9().\\x20-]{5,}[0-9]"),
    ("number", "\\+?\\(?[0-9][0-9().-]{5,}[0-9]"),
    ("number", "(?:\\+[0-9]{1,3}[\\x20.-]?)?\\(?[0-9]{2,4}\\)?[\\x20.-][0-9]{3,4}[\\x20.-][0-9]{3,4}(?![0-9])"),
    ("address", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\\x20?[(\\[]at[)\\]]\\x20?|\\x20at\\x20)[A-Za-z0-9-]++(?:\\.|\\x20?[(\\[]dot[)\\]]\\x20?|\\x20dot\\x20)[A-Za-z]{2,24}"),
)
ADDED = ("number", "address")
CUES = "(?i)(?:call|phone|tel|mobil|fax|mail|contact|card|visa|iban|account|acct|ssn|server|host|address|addr)"
#: Characters in front of a candidate that are searched for cues.
CONTEXT = 32


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (s, e, m) of each base kind in a text that isn't null."""
    some = text.rlike("[0-9]")

    def count(x: Column) -> Column:
        return F.length(_digits(x.m))

    found = {
        "email": F.when(text.contains("@"), find(text, EMAIL)),
        "ip": F.when(some & text.contains("."), F.filter(find(text, IP), lambda x: x.m.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$"))),
        "card": F.when(some, F.filter(find(text, CARD), lambda x: luhn(_digits(x.m)))),
        "phone": F.when(text.contains("+"), F.filter(find(text, PHONE), lambda x: count(x).between(8, 15))),
    }
    return {k: F.coalesce(c, none()) for k, c in found.items()}


#: (feature, values it has at most). Each is computed by _features, in this order.
FEATURES = (("kind", 2), ("digits", 21), ("separators", 7), ("groups", 7), ("longest", 6), ("leading", 10), ("last", 9), ("cue", 2), ("style", 4), ("touching", 3))


def _features(kind: Column, m: Column, before: Column, after: Column) -> Column:
    """The features of a candidate from its text, the CONTEXT characters before it and the one after it."""
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    longest = F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.length(g)))
    digits = _digits(m)
    values = (
        kind,
        F.least(F.length(digits), F.lit(20)),
        F.least(F.regexp_count(m, F.lit("[\\x20().-]")), F.lit(6)),
        F.least(F.size(groups), F.lit(6)),
        F.when(longest <= 2, 0).when(longest <= 3, 1).when(longest <= 4, 2).when(longest <= 8, 3).when(longest <= 15, 4).otherwise(5),
        F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(0)),
        F.least(F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)), F.lit(8)),
        before.rlike(CUES).cast("int"),
        (m.contains(".").cast("int") + 2 * m.contains("(").cast("int")),
        before.rlike("[A-Za-z0-9]$").cast("int") + after.rlike("^[A-Za-z0-9]").cast("int"),
    )
    return F.struct(*[v.cast("int").alias(n) for (n, _), v in zip(FEATURES, values)])


def _variants(kind: Column, m: Column) -> Column:
    """How else the same thing may be written; the plus always left out, as only base spans may need it."""
    plain = F.regexp_replace(m, "^\\+", "")
    spaced = F.regexp_replace(plain, "[().\\x20-]+", " ")
    national = F.regexp_replace(m, "^\\+[0-9]{1,3}[\\x20.-]*", "")
    written = F.array(plain, national, F.regexp_replace(plain, "[\\x20-]", "."), F.regexp_replace(F.trim(spaced), "\\x20", "-"), F.regexp_replace(plain, "[().\\x20-]", ""))
    at = F.regexp_replace(F.regexp_replace(m, "@", " at "), "\\.", " dot ")
    spelt = F.array(m, F.regexp_replace(m, "@", "(at)"), F.regexp_replace(m, "@", "[at]"), at)
    return F.array_distinct(F.when(kind == 0, written).otherwise(spelt))


def _over(a: Column, b: Column) -> Column:
    return (a.s < b.e) & (b.s < a.e)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base_<kind> spans, candidates (s, e, kind, f) off them, and the examples (f, yes) of a text."""
    body = F.coalesce(text, F.lit(""))
    out = docs.withColumns({f"base_{k}": c for k, c in base_spans(body).items()})
    some = body.rlike("[0-9]")

    def tagged(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.m.alias("m"), F.lit(kind).alias("kind")))

    signs = body.contains("@") | body.contains("(at") | body.contains("[at") | body.contains(" at ")
    proposed = F.concat(*[tagged(F.coalesce(F.when(some if k == "number" else signs, find(body, p)), none()), ADDED.index(k)) for k, p in GENERATORS])
    base = F.concat(*[tagged(F.col(f"base_{k}"), ADDED.index("address" if k == "email" else "number")) for k in KINDS])

    def around(x: Column, then) -> Column:
        before = F.substring(body, F.greatest(x.s - CONTEXT, F.lit(0)) + 1, F.least(x.s, F.lit(CONTEXT)))
        return let(F.struct(before.alias("b"), F.substring(body, x.e + 1, F.lit(1)).alias("a")), then)

    def judged(x: Column) -> Column:
        f = around(x, lambda c: _features(x.kind, x.m, c.b, c.a))
        return F.struct(x.s.alias("s"), x.e.alias("e"), x.kind.alias("kind"), f.alias("f"))

    def shown(yes: bool):
        def each(x: Column) -> Column:
            return around(x, lambda c: F.transform(_variants(x.kind, x.m), lambda v: F.struct(_features(x.kind, v, c.b, c.a).alias("f"), F.lit(yes).alias("yes"))))

        return lambda xs: F.flatten(F.transform(xs, each))

    # A candidate that two generators propose is one.
    out = out.withColumn("__base", base).withColumn("__free", F.filter(F.array_distinct(proposed), lambda x: ~F.exists("__base", lambda y: _over(x, y))))
    out = out.withColumn("candidates", F.when(F.size("__free") > 0, F.transform("__free", judged)).otherwise(F.array()))
    examples = F.when(F.size("__base") + F.size("__free") > 0, F.concat(shown(True)(F.col("__base")), shown(False)(F.col("__free")))).otherwise(F.array())
    return out.withColumn("examples", examples).withColumn("fold", F.pmod(F.xxhash64(body), F.lit(FOLDS)).cast("int")).drop("__base", "__free")


def learn(docs: DataFrame, precision: float = PRECISION) -> boosting.Boosted:
    """Trees over the examples of all rows of docs (text)."""
    return _learn(with_candidates(docs.select("text")), precision)


def _learn(found: DataFrame, precision: float) -> boosting.Boosted:
    names = [n for n, _ in FEATURES]
    each = found.filter(F.size("examples") > 0).select("fold", F.explode("examples").alias("c"))
    counts = each.select("fold", "c.f.*", "c.yes").groupBy("fold", *names).agg(F.count_if("yes").alias("p"), F.count_if(~F.col("yes")).alias("n"))
    rows = sorted(tuple(r) for r in counts.collect())  # bounded by the product of the features' ranges
    x = np.array([r[1:-2] for r in rows], np.int64).reshape(-1, len(names))
    positive, negative, fold = (np.array([r[i] for r in rows], float) for i in (-2, -1, 0))
    if not positive.sum() or not negative.sum():
        return boosting.Boosted(0.0, [])
    return boosting.calibrated(x, positive, negative, fold, x[:, 0], precision)


def _added(model: boosting.Boosted) -> Column:
    """The selected candidates (s, e, kind), none over another."""
    none_added = F.array().cast("array<struct<s:int,e:int,kind:int>>")
    if not model.thresholds:
        return none_added
    scored = F.transform(
        "candidates",
        lambda c: F.struct((-model.column([c.f[n] for n, _ in FEATURES])).alias("rank"), (c.s - c.e).alias("size"), c.s.alias("s"), c.e.alias("e"), c.kind.alias("kind")),
    )
    least = F.lit(None).cast("double")
    passed = F.filter(scored, lambda c: F.coalesce(-c["rank"] >= F.coalesce(*[F.when(c.kind == k, t) for k, t in model.thresholds.items()], least), F.lit(False)))

    def place(a: Column, c: Column) -> Column:
        return F.when(F.exists(a, lambda y: _over(c, y)), a).otherwise(F.concat(a, F.array(F.struct(c.s.alias("s"), c.e.alias("e"), c.kind.alias("kind")))))

    return F.when(F.size("candidates") > 0, F.array_sort(F.aggregate(F.array_sort(passed), none_added, place))).otherwise(none_added)


def selected(found: DataFrame, model: boosting.Boosted) -> DataFrame:
    """found_<kind> spans, base ones and those of ADDED, in place of what with_candidates() gave."""
    out = found.withColumn("__added", _added(model))
    out = out.withColumns({f"found_{k}": F.filter("__added", lambda x: x.kind == i) for i, k in enumerate(ADDED)})
    return out.drop("__added", "candidates", "examples", "fold").withColumnsRenamed({f"base_{k}": f"found_{k}" for k in KINDS})


def with_pii(docs: DataFrame, model: boosting.Boosted | None = None) -> DataFrame:
    """(d, found_<kind>..): each row d of docs with its spans of KINDS and of ADDED."""
    found = with_candidates(packed(docs, "text"))
    return selected(found, model or _learn(found, PRECISION)).drop("text")


def pii_report(docs: DataFrame, model: boosting.Boosted | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs (doc_id, text). Texts are
    read once: what they hold goes to a table, from which the trees learn and the result follows."""
    found = materialize(with_candidates(docs.select("doc_id", "text")).drop("text"), "pii-candidates")
    found = selected(found, model or _learn(found, PRECISION))
    base = kind_spans({k: F.col(f"found_{k}") for k in KINDS})  # kinds in order, each from left to right
    every = kind_spans({k: F.col(f"found_{k}") for k in (*KINDS, *ADDED)})
    return found.select(
        "doc_id",
        *[F.size(f"found_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )
