"""Record validation: coded issues per line, duplicate ids, truncation and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import blank, strip

ROLES = ("system", "user", "assistant")


def issue(field: Column | str, code: str) -> Column:
    return F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(code).alias("code"))


def required(fields: Sequence[str]) -> Column:
    """An issue for each field that is null or blank."""
    return F.array_compact(F.array(*[F.when(blank(F.col(f)), issue(f, "missing_or_empty")) for f in fields]))


def message_issues(messages: Column) -> Column:
    def each(m: Column, i: Column) -> Column:
        at = F.concat(F.lit("messages["), i.cast("string"), F.lit("]"))
        bad_role = F.when(~F.coalesce(m.role.isin(*ROLES), F.lit(False)), issue(F.concat(at, F.lit(".role")), "invalid_role"))
        empty = F.when(blank(m.content), issue(F.concat(at, F.lit(".content")), "empty_content"))
        return F.when(m.isNull(), F.array(issue(at, "invalid_message"))).otherwise(F.array_compact(F.array(bad_role, empty)))

    answered = F.exists(messages, lambda m: F.coalesce(m.role == "assistant", F.lit(False)))
    missing = F.when(~answered, F.array(issue("messages", "missing_assistant"))).otherwise(F.array().cast("array<struct<field:string,code:string>>"))
    found = F.concat(F.flatten(F.transform(messages, each)), missing)
    return F.when(F.coalesce(F.size(messages), F.lit(0)) > 0, found).otherwise(F.array(issue("messages", "invalid_messages")))


def pair_issues() -> Column:
    same = F.when(strip(F.col("chosen")) == strip(F.col("rejected")), issue("rejected", "identical_pair"))
    return F.concat(required(["prompt", "chosen", "rejected"]), F.array_compact(F.array(same)))


def metadata_issues(metadata: Column) -> Column:
    """metadata is JSON text: an object, or null where there is none."""
    wrong = metadata.isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json(metadata)).startswith("OBJECT"), F.lit(False))
    return F.array_compact(F.array(F.when(wrong, issue("metadata", "invalid_metadata"))))


VALIDATORS = {
    "pretrain": lambda: required(["id", "text", "source"]),
    "sft": lambda: F.concat(required(["id"]), message_issues(F.col("messages"))),
    "dpo": lambda: F.concat(required(["id"]), pair_issues()),
    "grpo": lambda: F.concat(required(["id", "prompt", "answer"]), metadata_issues(F.col("metadata"))),
}


def issues(records: DataFrame, kind: str, line: str = "line") -> DataFrame:
    """(line, field, code) of every issue of records of the kind, duplicate ids included."""
    own = records.select(line, F.posexplode(VALIDATORS[kind]()).alias("seq", "i")).select(line, "seq", "i.field", "i.code")
    return own.unionByName(duplicate_ids(records, line).select(line, F.lit(1 << 20).alias("seq"), F.lit("id").alias("field"), F.lit("duplicate_id").alias("code")))


def duplicate_ids(records: DataFrame, line: str = "line", key: str = "id") -> DataFrame:
    """(line, key, first_line) of rows whose id an earlier row has, valid or not."""
    first = records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(line).alias("first_line"))
    return records.select(line, key).join(first, key).filter(F.col(line) > F.col("first_line"))


def truncated(found: DataFrame, most: int, line: str = "line") -> DataFrame:
    """The first issues up to most: a bounded sort, not a global window."""
    return found.orderBy(line, "seq").limit(most)


def report(records: DataFrame, found: DataFrame, line: str = "line") -> DataFrame:
    """One row: records, valid and invalid records, issues."""
    bad = found.agg(F.countDistinct(line).alias("invalid"), F.count("*").alias("issues"))
    return records.agg(F.count("*").alias("records")).crossJoin(bad).withColumn("valid", F.col("records") - F.col("invalid"))


def chat_problem(messages: Column, control: Column) -> Column:
    """The first rule of the chat grammar that an array of (role, content) breaks, or null.
    control: whether some content has a control token."""
    shift = F.when(F.get(messages, 0).role == "system", 1).otherwise(0)

    def misplaced(m: Column, i: Column) -> Column:
        wanted = F.when((i - shift) % 2 == 0, "user").otherwise("assistant")
        return (i >= shift) & (m.role != wanted)

    return (
        F.when(F.coalesce(F.size(messages), F.lit(0)) == 0, "empty")
        .when(F.exists(messages, lambda m: ~F.coalesce(m.role.isin(*ROLES), F.lit(False))), "role")
        .when(F.exists(messages, lambda m: F.coalesce(m.content, F.lit("")) == ""), "content")
        .when(control, "control")
        .when(F.exists(F.transform(messages, misplaced), lambda x: x), "order")
    )
