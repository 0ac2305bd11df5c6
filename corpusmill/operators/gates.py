"""Gates: checks as rows (name, status, message), and comparisons of tables and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import shutil
import subprocess
import sys
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from importlib import metadata
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.ident import content_digest
from corpusmill.functions.schedule import close, finite, quotient, rounded
from corpusmill.functions.text import SHA256, full_match
from corpusmill.operators.splits import NAMES, RATIOS, with_split


def check(df: DataFrame, name: str, passed: Column, message: Column | str, warn: bool = False) -> DataFrame:
    """One row from a one-row (or aggregated) frame; null counts as not passed."""
    failed = "warn" if warn else "fail"
    said = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(name).alias("name"), F.when(F.coalesce(passed, F.lit(False)), "pass").otherwise(failed).alias("status"), said.cast("string").alias("message"))


def gate(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def status_counts(checks: DataFrame) -> DataFrame:
    """One row: passed, warned, failed and ok."""
    one = [F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("warn", "warned"), ("fail", "failed"))]
    return checks.agg(*one).withColumn("ok", F.col("failed") == 0)


def field_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, field, left, right) where the rows of a key differ, null-safe; rows on one side only included."""
    fields = [c for c in a.columns if c != key]

    def long(df: DataFrame, out: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(out)) for f in fields])
        return df.select(key, F.explode(pairs).alias("p")).select(key, "p.field", f"p.{out}")

    both = long(a, "left").join(long(b, "right"), [key, "field"], "full_outer")
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (missing, unexpected): rows of a that b lacks, and of b that a lacks, repeats counted."""
    missing = a.exceptAll(b).agg(F.count("*").alias("missing"))
    return missing.crossJoin(b.exceptAll(a).agg(F.count("*").alias("unexpected")))


def digest_chain(parts: DataFrame, recorded: DataFrame, by: str, digest: str) -> DataFrame:
    """(by, records, digest, matches): the content digests of parts against recorded ones."""
    now = content_digest(parts, [by], digest)
    past = recorded.select(by, F.col("digest").alias("recorded"))
    return now.join(past, by, "full_outer").withColumn("matches", F.col("digest").eqNullSafe(F.col("recorded")))


# --- checks from facts that the driver holds: manifests, configurations, the machine --------------------

CHECK = "name string, status string, message string"


def said(spark: SparkSession, name: str, passed: bool, good: str, bad: str, warn: bool = False) -> DataFrame:
    return spark.createDataFrame([(name, "pass" if passed else "warn" if warn else "fail", good if passed else bad)], CHECK)


def differing(expected: Mapping, actual: Mapping, fields: Sequence[str] | None = None) -> list[str]:
    """Dotted paths at which two mappings differ, types included; of all fields unless some are given."""

    def flat(value, at: str) -> dict:
        if isinstance(value, Mapping):
            return {k: v for key, inner in value.items() for k, v in flat(inner, f"{at}.{key}" if at else str(key)).items()} or {at: {}}
        return {at: (type(value).__name__, value)}

    a, b = flat(expected, ""), flat(actual, "")
    asked = sorted(a.keys() | b.keys()) if fields is None else [k for f in fields for k in sorted({f} | {x for x in a.keys() | b.keys() if x.startswith(f + ".")})]
    return [k for k in asked if a.get(k) != b.get(k)]


def same_mapping(spark: SparkSession, name: str, expected: Mapping, actual: Mapping, fields: Sequence[str] | None = None) -> DataFrame:
    """Recipe, tokenizer, policy, budget, runtime or checkpoint identity: every field as it was frozen."""
    wrong = differing(expected, actual, fields)
    return said(spark, name, not wrong, "as frozen", "differs in " + ", ".join(wrong[:20]))


def canonical_hash(value: Mapping) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def locked(spark: SparkSession, name: str, value: Mapping, sha256: str) -> DataFrame:
    """A configuration whose canonical form has the frozen hash."""
    found = canonical_hash(value)
    return said(spark, name, found == sha256, "as locked", f"has {found}")


def staged(spark: SparkSession, blocks: Sequence[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """Blocks of checks one after another; once one has a failure those after it are skipped, not run."""
    done, failed = [], False
    for name, block in blocks:
        if failed:
            done.append(spark.createDataFrame([(name, "skipped", "an earlier check failed")], CHECK))
            continue
        rows = spark.createDataFrame(block().collect(), CHECK)  # a handful of rows
        done.append(rows)
        failed = rows.filter("status = 'fail'").count() > 0
    return gate(*done)


def exit_code(checks: DataFrame) -> int:
    return int(checks.filter("status = 'fail'").limit(1).count() > 0)


# --- checks of tables -----------------------------------------------------------------------------------


def artifacts(expected: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of expected (path, size_bytes, sha256) files that files lack or have otherwise; a null size or hash
    asks for a file that isn't empty."""
    found = files.select(F.col("path"), F.col("size_bytes").alias("__size"), F.col("sha256").alias("__sha"))
    joined = expected.join(found, "path", "left")
    problem = (
        F.when(F.col("__size").isNull(), "missing")
        .when(F.col("__size") == 0, "empty")
        .when(F.col("size_bytes").isNotNull() & (F.col("size_bytes") != F.col("__size")), "size differs")
        .when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("__sha")), "hash differs")
    )
    return joined.select("path", problem.alias("problem")).filter("problem is not null")


def problem_check(problems: DataFrame, name: str, listed: Column, most: int = 20) -> DataFrame:
    """One row: fail with the first problems, pass without any."""
    first = problems.select(listed.cast("string").alias("p")).orderBy("p").limit(most)
    text = first.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p")), "; ").alias("all"))
    return check(text, name, F.col("n") == 0, F.when(F.col("n") == 0, "none").otherwise(F.col("all")))


def hash_chain(links: DataFrame) -> DataFrame:
    """(child, problem) of links (child, parent, recorded) beside the artifacts' own digests (child, digest): a parent that
    isn't there, or has another digest than the child recorded."""
    own = links.select(F.col("child").alias("parent"), F.col("digest").alias("__digest"), F.lit(True).alias("__there"))
    joined = links.filter("parent is not null").join(own, "parent", "left")
    problem = F.when(F.col("__there").isNull(), "parent missing").when(~F.col("recorded").eqNullSafe(F.col("__digest")), "digest differs")
    return joined.select("child", problem.alias("problem")).filter("problem is not null")


def array_map(entries: DataFrame) -> DataFrame:
    """One row (paths, map): path to sha256 of entries, empty where a path occurs twice or a value is missing."""
    facts = entries.agg(
        F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.count_if(F.col("path").isNull() | F.col("sha256").isNull()).alias("bad"),
        F.array_sort(F.collect_list(F.when(F.col("path").isNotNull() & F.col("sha256").isNotNull(), F.struct("path", "sha256")))).alias("e"),
    )
    sound = (F.col("n") == F.col("paths")) & (F.col("bad") == 0)
    e = F.when(sound, F.col("e")).otherwise(F.array().cast("array<struct<path:string,sha256:string>>"))
    return facts.select(F.size(e).alias("paths"), F.map_from_entries(e).alias("map"))


def tree_digest(entries: DataFrame) -> DataFrame:
    """One row (paths, digest): SHA-256 of the canonical {path: sha256} of entries."""
    found = array_map(entries)
    pairs = F.array_sort(F.map_entries("map"))
    body = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p.key, F.lit('":"'), p.value, F.lit('"'))), ",")
    return found.select("paths", F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256).alias("digest"))


def resplit(source: DataFrame, stored: DataFrame, group: str, digest: str, seed: int = 42, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """(split, missing, unexpected, records, groups): rows that a split made anew from source has and stored (split, ..)
    lacks, and the other way round; repeats counted."""
    again = with_split(source.drop("split"), group, seed, ratios).select("split", digest)
    tagged = again.withColumn("d", F.lit(1)).unionByName(stored.select("split", digest).withColumn("d", F.lit(-1)))
    net = tagged.groupBy("split", digest).agg(F.sum("d").alias("d"))
    counts = net.groupBy("split").agg(F.sum(F.greatest("d", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("unexpected"))
    held = stored.groupBy("split").agg(F.count("*").alias("records"), F.countDistinct(group).alias("groups"))
    return counts.join(held, "split", "left").na.fill(0, ["records", "groups"])


def declared_splits(found: DataFrame, declared: DataFrame) -> DataFrame:
    """One row: whether the splits are just train, dev and test and each has the records and groups it declares."""
    joined = declared.select("split", F.col("records").alias("r"), F.col("groups").alias("g")).join(found, "split", "full_outer")
    wrong = F.count_if(~(F.col("records").eqNullSafe(F.col("r")) & F.col("groups").eqNullSafe(F.col("g"))))
    facts = joined.agg(F.array_sort(F.collect_set("split")).alias("names"), wrong.alias("wrong"))
    return check(facts, "split-artifacts", (F.col("names") == F.array(*[F.lit(n) for n in sorted(NAMES)])) & (F.col("wrong") == 0), F.col("wrong"))


def balance(counts: DataFrame, frozen: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key.., examples, tokens, expected_examples, expected_tokens) that differ from the freeze."""
    named = frozen.withColumnsRenamed({"examples": "expected_examples", "tokens": "expected_tokens"})
    both = counts.join(named, list(key), "full_outer")
    return both.filter(~(F.col("examples").eqNullSafe(F.col("expected_examples")) & F.col("tokens").eqNullSafe(F.col("expected_tokens"))))


def metrics_facts(log: DataFrame, losses: Sequence[str], missing_fails: bool = True) -> DataFrame:
    """One row of a training log (line, event, step, train_loss, gradient_norm, losses..): for each loss its baseline (the
    least, where lines repeat), best and final value; the final step; baselines; numbers that aren't finite. A log
    without rows has null counts, as it shows nothing. Missing numbers count as not finite if missing_fails."""
    first = losses[0]
    sound = finite if missing_fails else lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    base, evaluated = F.col("event") == "baseline", F.col("train_loss").isNotNull() & F.col(first).isNotNull()
    needed = F.when(base | evaluated, reduce(lambda a, b: a & b, [sound(F.col(c)) for c in losses])).otherwise(True)
    trained = F.when(F.col("train_loss").isNotNull(), sound(F.col("train_loss")) & sound(F.col("gradient_norm"))).otherwise(True)
    counted = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = [counted(base).alias("baselines"), counted(~(needed & trained)).alias("unfinite"), F.max_by(F.when(evaluated, F.col("step")), F.when(evaluated, F.col("line"))).alias("final_step")]
    out += [F.min(F.when(base, F.col("line"))).alias("baseline_line"), F.min(F.when(evaluated, F.col("line"))).alias("first_line")]
    for c in losses:
        out += [F.min(F.when(base & F.col(c).isNotNull(), F.struct("line", c)))[c].alias(f"baseline_{c}"), F.min(F.when(evaluated, F.col(c))).alias(f"best_{c}")]
        out += [F.max_by(F.when(evaluated, F.col(c)), F.when(evaluated, F.col("line"))).alias(f"final_{c}")]
    return log.agg(*out)


def acceptance(facts: DataFrame, losses: Sequence[str], steps: int, regress: float = 1.02, halve: float = 0.5) -> DataFrame:
    """The checks of a finished run: one baseline before all else, finite numbers, the last step evaluated, every loss
    better than its baseline, the first no worse than regress times its best and at most halve of its baseline."""
    first = losses[0]
    final, base, best = (F.col(f"{k}_{first}") for k in ("final", "baseline", "best"))
    ahead = (F.col("baselines") == 1) & (F.col("baseline_line") < F.col("first_line"))
    checks = [
        check(facts, "baseline-first", ahead, F.col("baselines")),
        check(facts, "finite-metrics", F.col("unfinite") == 0, F.col("unfinite")),
        check(facts, "final-step", F.col("final_step") == steps, F.col("final_step")),
        *[check(facts, f"improves-{c}", F.col(f"final_{c}") < F.col(f"baseline_{c}"), rounded(F.col(f"final_{c}") - F.col(f"baseline_{c}"), 6)) for c in losses],
        check(facts, "near-best", final <= regress * best, rounded(quotient(final, best), 6)),
        check(facts, "halved", final <= halve * base, rounded(quotient(final, base), 6)),
    ]
    return gate(*checks)


def coverage(facts: DataFrame, most: float = 1.01) -> DataFrame:
    """The checks of a budget: facts (global_step, max_steps, tokens_seen, target_tokens, reported)."""
    share = quotient(F.col("tokens_seen"), F.col("target_tokens"))
    return gate(
        check(facts, "budget-steps", F.col("global_step") == F.col("max_steps"), F.col("global_step")),
        check(facts, "token-coverage", share.between(1.0, most), rounded(share, 9)),
        check(facts, "reported-coverage", finite(share) & close(share, F.col("reported"), 0.0, 1e-12), rounded(F.col("reported"), 9)),
    )


def suite_reports(expected: DataFrame, reports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(suite, problem) of expected (suite, samples) whose report is missing, counts other samples, or lacks a positive
    finite value."""
    joined = expected.withColumnRenamed("samples", "__n").join(reports, "suite", "left")
    sound = reduce(lambda a, b: a & b, [finite(F.col(k)) & (F.col(k) > 0) for k in keys])
    problem = F.when(F.col("samples").isNull(), "missing").when(F.col("samples") != F.col("__n"), "samples differ").when(~F.coalesce(sound, F.lit(False)), "bad value")
    return joined.select("suite", problem.alias("problem")).filter("problem is not null")


def source_policy(sources: DataFrame, allowed: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """(source, problem) of a recipe's sources (place, source, transform, revision, sha256, licence) against an ordered
    list of allowed ones with the same columns."""
    a = allowed.withColumnsRenamed({c: f"__{c}" for c in allowed.columns if c != "source"})
    both = sources.join(a, "source", "full_outer")
    fields = ("transform", "revision", "sha256", "licence", "place")
    problems = [F.when(F.col("__place").isNull(), "not allowed"), F.when(F.col("place").isNull(), "missing"), F.when(F.col("source").isin(*excluded) & F.col("place").isNotNull(), "excluded")]
    known = F.col("place").isNotNull() & F.col("__place").isNotNull()
    problems += [F.when(known & ~F.col(c).eqNullSafe(F.col(f"__{c}")), f"{c} differs") for c in fields]
    problems += [F.when(F.col("place").isNotNull() & ~full_match(F.col("sha256"), SHA256), "no pinned hash")]
    return both.select("source", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


# --- the machine ----------------------------------------------------------------------------------------


def doctor(spark: SparkSession, folder: str, least_python: tuple[int, int] = (3, 11), packages: Mapping[str, str | None] = {}, free_gib: float = 1.0) -> DataFrame:  # noqa: B006
    """Whether this machine can run: Python, packages (a version, or None for any), a folder to write to and its space."""
    rows = [said(spark, "python", sys.version_info[:2] >= least_python, platform.python_version(), platform.python_version())]
    for name, version in packages.items():
        try:
            found = metadata.version(name)
        except metadata.PackageNotFoundError:
            found = None
        same = found is not None and (version is None or found.split("+")[0] == version)
        rows.append(said(spark, f"package-{name}", same, str(found), str(found)))
    probe = Path(folder) / f".probe-{os.getpid()}"
    try:
        probe.write_bytes(b"")
        probe.unlink()
        wrote = True
    except OSError:
        wrote = False
    rows.append(said(spark, "write", wrote, "writable", "not writable"))
    free = shutil.disk_usage(folder).free / 2**30 if os.path.isdir(folder) else 0.0
    rows.append(said(spark, "disk", free >= free_gib, f"{free:.1f} GiB", f"{free:.1f} GiB", warn=True))
    return gate(*rows)


def runtime_facts() -> dict:
    """What a run records of its surroundings."""
    return {"python": platform.python_version(), "platform": platform.platform(), "packages": {d.name: d.version for d in metadata.distributions() if d.name}}


def frozen_runtime(spark: SparkSession, frozen: Mapping, now: Mapping) -> DataFrame:
    """Python's major and minor version and the packages' versions, local suffixes left out."""

    def plain(facts: Mapping) -> dict:
        return {"python": ".".join(str(facts["python"]).split(".")[:2]), "packages": {k: str(v).split("+")[0] for k, v in facts["packages"].items()}}

    return same_mapping(spark, "frozen-runtime", plain(frozen), {**plain(now), "packages": {k: v for k, v in plain(now)["packages"].items() if k in frozen["packages"]}})


def clean_worktree(spark: SparkSession, folder: str) -> DataFrame:
    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True, timeout=60).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    commit, status = git("rev-parse", "HEAD"), git("status", "--porcelain")
    return said(spark, "clean-worktree", bool(commit) and status == "", str(commit), "no commit" if not commit else "changed files")
