"""What the registered queries share: the registry, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusmill.functions import text

WS = text.WS
SIZE = 512
CODES = {"en": 0, "de": 1, "fr": 2, "es": 3}


@dataclass(frozen=True)
class Entry:
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None):
    def register(f):
        ENTRIES[f.__name__] = Entry(f, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collapse(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'))"


def strip(column: str) -> str:
    return f"regexp_replace(regexp_replace({column}, '^{WS}+', ''), '{WS}+$', '')"


def score(seed: int, group: str) -> str:
    return f"(('0x' || substr(sha256('{seed}' || chr(0) || {group}), 1, 16))::ubigint::double / 18446744073709551616)"


def split_sql(group: str, seed: int = 42) -> str:
    return f"case when {score(seed, group)} < 0.8::double then 'train' when {score(seed, group)} < 0.8::double + 0.1::double then 'dev' else 'test' end"


NORMAL = f"select doc_id, lang, source, n_chars, {collapse('text')} as body, text from documents"
SPLIT = split_sql("doc_id::varchar")
