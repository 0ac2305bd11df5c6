"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import langid, mixing, packing, pii, quality, secrets, simhash, tokens, toxicity, vectors
from corpusmill.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


ALL = (
    op1_secret_scan,
    op2_source_mixing,
    op3_token_counts,
    op4_simhash_dedup,
    op5_quality_rules,
    op6_toxicity,
    op7_personal_data,
    op8_embedding_dedup,
    op9_best_fit_packing,
    op10_language_id,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """Spans from the plain patterns: matches and the gaps between them give the offsets."""
    kinds = list(secrets.RULES)
    parts = []
    for o, (k, p) in enumerate(secrets.RULES.items()):
        keep = f" and length(regexp_extract(m[i], {_quoted(p)}, 2)) >= {secrets.VALUE}" if k == "assign" else ""
        start = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        parts.append(
            f"select doc_id, '{k}' as k, {o} as o, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: true{keep}), lambda i: {{'s': {start}, 'e': {start} + length(m[i])}})) as x"
            f" from (select doc_id, regexp_extract_all(t, {_quoted(p)}) as m, string_split_regex(t, {_quoted(p)}) as g from d)"
        )
    name = "k || ':' || x.s::bigint::varchar || ':' || x.e::bigint::varchar"
    base = ", ".join(_quoted(k) for k in secrets.BASE)
    counts = ", ".join(f"count_if(k = '{k}') as n_{k}" for k in secrets.BASE)
    return (
        "with d as (select doc_id, coalesce(text, '') as t from documents), s as ("
        + " union all ".join(parts)
        + f"), p as (select doc_id, {counts}, string_agg({name}, ',' order by x.s, o) filter (where k in ({base})) as b, string_agg({name}, ',' order by x.s, o) as every from s group by doc_id)"
        + f" select d.doc_id, {', '.join(f'coalesce(n_{k}, 0)::bigint as n_{k}' for k in kinds[:3])}, sha256(coalesce(b, '')) as base_sha256, coalesce(every, '') as spans from d left join p using (doc_id)"
    )


def _quality_sql() -> str:
    stop = ", ".join(_quoted(w) for w in quality.STOP_WORDS)
    rules = []
    for _, measure, least, most in quality.THRESHOLDS:
        over, under = quality.MEASURES[measure]
        rules += [f"{over} >= {under} * {float(least)}::double"] if least is not None else []
        rules += [f"{over} <= {under} * {float(most)}::double"] if most is not None else []
    return f"""with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
g as (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as v from d),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, v) as n from g) where n > 1),
c as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from r) group by doc_id),
m as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '{quality.SYMBOLS}'))::bigint as n_symbols, len(regexp_extract_all(t, '!')) as n_exclamations,
len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop_words from d left join c using (doc_id)),
b as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(rules)} as kept from b"""


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; tests hold the others against brute force or held-out rows."""
    return {"op1_secret_scan": _secrets_sql(), "op5_quality_rules": _quality_sql()}
