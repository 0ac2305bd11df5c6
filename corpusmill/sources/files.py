"""Sources and sinks: strict JSON lines, registered formats, fingerprints, and tables with manifests."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.ident import content_digest
from corpusmill.functions.text import WS


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, line counted from 1 in each. A file's stretches are read by several tasks, each
    in order, so a line's number is the lines of the stretches before its own, and its place in that one."""
    places = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    read = spark.read.text(path).select(*places, "value")
    counts = read.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "block", (before - F.col("least") + 1).alias("shift"))  # a row a stretch
    return read.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def strict_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of JSON lines: rows with file, line and raw beside the schema's columns; issues (file, line,
    code), the first most of them, of lines that aren't a JSON object with finite numbers, or empty_dataset at line 0.
    Blank lines are passed over."""
    lines = numbered_lines(spark, path).filter(~F.col("value").rlike(f"^{WS}*$"))
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*typed.fields, T.StructField("_bad", T.StringType())])
    options = {"allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.withColumn("r", F.from_json("value", full, options))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull() | ~F.col("value").rlike(f"^{WS}*\\{{")
    rows = parsed.filter(~bad).select("file", "line", F.col("value").alias("raw"), *[F.col(f"r.{f.name}") for f in typed.fields])
    issues = parsed.filter(bad).select("file", "line", F.lit("invalid_json").alias("code"))
    empty = lines.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("").alias("file"), F.lit(0).cast("long").alias("line"), F.lit("empty_dataset").alias("code"))
    issues = issues.unionByName(empty)
    return rows, issues if most is None else issues.orderBy("file", "line").limit(most)


def plain_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines, not-a-number let through; the first line that doesn't parse is an error with its number."""
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*typed.fields, T.StructField("_bad", T.StringType())])
    parsed = numbered_lines(spark, path).filter(F.trim("value") != "").withColumn("r", F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad"}))
    bad = parsed.filter(F.col("r._bad").isNotNull() | F.col("r").isNull()).orderBy("file", "line").select("file", "line").first()
    if bad:
        raise ValueError(f"{bad.file} line {bad.line} isn't a JSON object")
    return parsed.select(*[F.col(f"r.{f.name}") for f in typed.fields])


#: Readers by format; compressed JSON lines are recognised by their suffix.
READERS: dict[str, Callable[[SparkSession, str, str | T.StructType | None], DataFrame]] = {
    "parquet": lambda spark, path, schema: spark.read.parquet(path),
    "jsonl": lambda spark, path, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(path),
    "jsonl.gz": lambda spark, path, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(path),
    "json": lambda spark, path, schema: spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path),
    "text": lambda spark, path, schema: spark.read.text(path),
}


def read(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """A source of a registered format; a column that isn't there raises."""
    if kind not in READERS:
        raise ValueError(f"unknown format {kind}; known: {', '.join(sorted(READERS))}")
    df = READERS[kind](spark, path, schema)
    if columns:
        if lacking := [c for c in columns if c not in df.columns]:
            raise ValueError(f"{path} lacks {', '.join(lacking)}")
        df = df.select(*columns)
    return df


#: Bytes of a file that are read at once.
CHUNK = 1 << 20


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of every file below a path. The listing is Spark's; a task reads its files in chunks
    through the session's file systems where the whole of one wouldn't fit a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") < 1 << 30).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    large = [r.path for r in files.filter(F.col("length") >= 1 << 30).select("path").collect()]  # a name a gigabyte
    if not large:
        return small
    rows = [(p, *digest_of(spark, p)) for p in large]
    return small.unionByName(spark.createDataFrame(rows, "path string, size_bytes long, sha256 string"))


def digest_of(spark: SparkSession, path: str) -> tuple[int, str]:
    """(bytes, SHA-256) of a file of any size, chunk by chunk, from any store the session reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(place).getLen()
    sha, stream = hashlib.sha256(), fs.open(place)
    try:
        at = 0
        while at < size:
            part = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(CHUNK, size - at)))
            sha.update(part)
            at += len(part)
    finally:
        stream.close()
    return size, sha.hexdigest()


def pinned(spark: SparkSession, path: str, sha256: str) -> str:
    """The path of a file whose content is the pinned one; else ValueError."""
    if (found := digest_of(spark, path)[1]) != sha256:
        raise ValueError(f"{path} has SHA-256 {found}, not {sha256}")
    return path


def checksum_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of a list of checksums: (sha256, path), and lines that are malformed or repeat a path."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = lines.select("value", F.regexp_extract("value", "^([0-9a-f]{64})\\s+\\*?(\\S.*)$", 1).alias("sha256"), F.regexp_extract("value", "^([0-9a-f]{64})\\s+\\*?(\\S.*)$", 2).alias("path"))
    entries = parts.filter("sha256 <> ''").select("sha256", "path")
    twice = entries.groupBy("path").count().filter("count > 1").select("path", F.lit("duplicate").alias("code"))
    return entries, parts.filter("sha256 = ''").select(F.col("value").alias("path"), F.lit("format").alias("code")).unionByName(twice)


def safe_relative(path: str, root: str | Path | None = None) -> str:
    """The path, if it stays below its root and no part of it there is a link; else ValueError."""
    pure = PurePosixPath(path)
    if pure.is_absolute() or ".." in pure.parts or not pure.parts:
        raise ValueError(f"unsafe path {path!r}")
    if root is not None:
        at = Path(root)
        for part in pure.parts:
            at = at / part
            if at.is_symlink():
                raise ValueError(f"{at} is a link")
    return str(pure)


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """Canonical JSON lines: keys sorted, no overwriting."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(text.alias("value")).write.mode("errorifexists").option("compression", compression).text(path)


def record_count(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).filter(~F.col("value").rlike(f"^{WS}*$")).count()


def _filesystem(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, facts: dict, by: str | None = None) -> dict:
    """Write a table beside its place, then its manifest, then move both there at once: a path either holds the whole
    or nothing, and what a failure leaves is removed. An existing path is an error. Returns the manifest: facts, the
    columns, records and a digest of all rows that doesn't depend on their order, and those by value of by."""
    spark = df.sparkSession
    place, fs = _filesystem(spark, path)
    if fs.exists(place):
        raise FileExistsError(f"{path} exists")
    beside, _ = _filesystem(spark, f"{path.rstrip('/')}.part-{uuid.uuid4().hex}")
    try:
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(f"{beside}/data")
        written = spark.read.schema(df.schema).parquet(f"{beside}/data")
        manifest = {**facts, "columns": sorted(written.columns), **totals(written)}
        if by:
            parts = content_digest(written.withColumn("__d", row_digest(written)), [by], "__d").collect()  # a row a part
            manifest["parts"] = {str(r[by]): {"records": r.records, "digest": r.digest} for r in parts}
        text = json.dumps(manifest, sort_keys=True, ensure_ascii=False, indent=2)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{beside}/_manifest")
        if not fs.rename(beside, place):
            raise FileExistsError(f"{path} exists")
    except BaseException:
        fs.delete(beside, True)
        raise
    return manifest


def row_digest(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def totals(df: DataFrame) -> dict:
    """records and digest of all rows."""
    found = content_digest(df.withColumn("__d", row_digest(df)).withColumn("__all", F.lit(1)), ["__all"], "__d").first()
    return {"records": found.records, "digest": found.digest} if found else {"records": 0, "digest": ""}


def load_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a published path: its closed set of typed fields, or ValueError."""
    manifest = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(f"{path}/_manifest").collect()))
    typed = {"columns": list, "records": int, "digest": str}
    wrong = [k for k, t in typed.items() if not isinstance(manifest.get(k), t) or isinstance(manifest.get(k), bool)]
    parts = manifest.get("parts", {})
    if wrong or manifest["records"] < 0 or (parts and sum(p["records"] for p in parts.values()) != manifest["records"]):
        raise ValueError(f"{path}: bad manifest ({', '.join(wrong) or 'records'})")
    return manifest


def load_published(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(table, manifest) of a published path; raises if a record is missing, added or changed."""
    manifest = load_manifest(spark, path)
    df = spark.read.parquet(f"{path}/data")
    found = totals(df)
    if found["records"] != manifest["records"]:
        raise ValueError(f"{path} has {found['records']} records, its manifest {manifest['records']}")
    if found["digest"] != manifest["digest"] or sorted(df.columns) != manifest["columns"]:
        raise ValueError(f"{path} isn't what its manifest says")
    return df, manifest


def load_mapping(path: str | Path) -> dict:
    """A JSON or, with the library at hand, YAML file whose root is a mapping."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        value = json.loads(text)
    else:
        import yaml

        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: the root has to be a mapping")
    return value


def catalogue(folder: str | Path, key: str) -> list[dict]:
    """All mappings of a folder by the value of key, which no two share."""
    found = [load_mapping(p) for p in sorted(Path(folder).iterdir()) if p.suffix in (".json", ".yaml", ".yml")]
    names = [m.get(key) for m in found]
    if None in names or len(set(names)) < len(names):
        raise ValueError(f"{folder}: {key} missing or repeated")
    return sorted(found, key=lambda m: m[key])


def dump_mapping(value: dict, path: str | Path) -> None:
    """Sorted keys, characters as they are, a newline at the end; an existing file is an error."""
    with open(path, "x", encoding="utf-8") as handle:
        handle.write(json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2, allow_nan=False) + "\n")
        handle.flush()
        os.fsync(handle.fileno())


def append_metric(path: str | Path, row: dict) -> None:
    """One more JSON line of a log, on disk when this returns; numbers are finite."""
    line = json.dumps(row, sort_keys=True, ensure_ascii=False, allow_nan=False)
    with open(path, "a", encoding="utf-8") as handle:
        handle.write(line + "\n")
        handle.flush()
        os.fsync(handle.fileno())


def update_status(path: str | Path, status: str) -> dict:
    """The manifest at path with a new status, replaced at once."""
    value = load_mapping(path) | {"status": status}
    beside = Path(f"{path}.{uuid.uuid4().hex}.json")
    dump_mapping(value, beside)
    os.replace(beside, path)
    return value


def claim(path: str | Path, value: dict) -> None:
    """A file that can be made once: the second claim is an error."""
    dump_mapping(value, path)


def frozen(path: str | Path, value: dict) -> dict:
    """value written at the first call; later calls with another value are an error."""
    if not Path(path).exists():
        dump_mapping(value, path)
    elif (kept := load_mapping(path)) != value:
        raise ValueError(f"{path} differs in {', '.join(sorted(k for k in kept.keys() | value.keys() if kept.get(k) != value.get(k)))}")
    return value


def write_report(folder: str | Path, report: dict, rows: list[dict], columns: list[str]) -> None:
    """report.json and report.md in a folder that doesn't exist yet."""
    Path(folder).mkdir(parents=True)
    dump_mapping(report, Path(folder) / "report.json")
    with open(Path(folder) / "report.md", "x", encoding="utf-8") as handle:
        handle.write(markdown(rows, columns) + "\n")


def metrics_log(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """(line, fields..) of a log of JSON objects; a line that isn't one is an error."""
    rows, issues = strict_jsonl(spark, path, schema)
    if bad := issues.filter("code <> 'empty_dataset'").orderBy("file", "line").first():
        raise ValueError(f"{bad.file} line {bad.line} isn't an object")
    return rows.drop("file", "raw")


def training_texts(df: DataFrame, column: str = "text"):
    """Texts one after another, partition by partition, for a trainer; a blank one is an error."""
    for row in df.select(column).toLocalIterator(prefetchPartitions=True):
        if not row[0] or not row[0].strip():
            raise ValueError("a record has no text")
        yield row[0]


def rendered_number(v) -> str:
    """Six places; scientific where that would be nothing; unchecked for null."""
    if v is None:
        return "unchecked"
    if isinstance(v, float):
        return f"{v:.4e}" if v and abs(v) < 1e-4 else f"{v:.6f}"
    return str(v)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A small table as Markdown; numbers with six places, nulls as unchecked."""

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(rendered_number(r.get(c)) for c in columns) + " |" for r in rows])
