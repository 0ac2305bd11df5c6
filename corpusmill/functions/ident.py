"""Identities: canonical JSON, digests and stable scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\u0000"


def canonical_json(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def record_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def keyed_digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by NUL; a null part makes it null instead of vanishing."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    joined = columns[0]
    for c in columns[1:]:
        joined = F.concat(joined, F.lit(NUL), c)
    return F.sha2(joined, 256)


def unit_score(seed: int, group: Column) -> Column:
    """A stable number in [0, 1): the first 64 bits of the digest of seed and group."""
    head = F.conv(F.substring(keyed_digest(str(seed), group), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def content_digest(rows: DataFrame, by: Sequence[str], digest: str) -> DataFrame:
    """One digest per group that doesn't depend on the order of rows: a hash of the sums of the four parts of
    the rows' digests, so it combines before the shuffle and no group is gathered."""
    parts = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("records"), *parts)
    joined = F.concat_ws(":", "records", *[F.col(f"p{i}").cast("string") for i in range(4)])
    return sums.select(*by, "records", F.sha2(joined, 256).alias("digest"))
