"""Sources and sinks: tables written in a format, read again, and held against the table they come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators import evaluation, gates, splits
from corpusmill.plans.entries import SPLIT, query, table
from corpusmill.sources import files
from corpusmill.sources.scratch import fresh

SMALL = "doc_id long, lang string, n_chars long"


@query("select doc_id, lang, n_chars from documents")
def jsonl_round_trip(spark, sf_dir):
    path = fresh(spark, "jsonl")
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return files.plain_jsonl(spark, path, SMALL)


@query("select doc_id, lang, n_chars from documents")
def jsonl_gz_round_trip(spark, sf_dir):
    path = fresh(spark, "jsonl-gz")
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path, "gzip")
    return files.read(spark, path, "jsonl.gz", schema=SMALL)


@query("select n_nationkey, n_name from nation")
def json_array_scan(spark, sf_dir):
    path = fresh(spark, "json-array")
    rows = table(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("j"))  # a table of 25 rows
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")).write.text(path)
    return files.read(spark, path, "json", ["n_nationkey", "n_name"], "n_nationkey int, n_name string")


def _lines(spark, sf_dir):
    """Lines of events some of which aren't JSON objects, or blank."""
    i = F.col("event_id")
    good = F.to_json(F.struct(i.alias("id"), "value"))
    line = F.when(i % 50 == 0, F.concat(F.lit('{"value": NaN, "id": '), i, F.lit("}"))).when(i % 50 == 1, F.concat(F.lit("["), good, F.lit("]"))).when(i % 50 == 2, "  ").when(i % 50 == 3, F.lit('{"id": ')).otherwise(good)
    path = fresh(spark, "lines")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return path


@query("select 'invalid_json' as code, count(*) as n from events where event_id % 50 in (0, 1, 3) union all select 'row', count(*) from events where event_id % 50 > 3")
def strict_jsonl_issues(spark, sf_dir):
    rows, issues = files.strict_jsonl(spark, _lines(spark, sf_dir), "id long, value double")
    return issues.groupBy("code").agg(F.count("*").alias("n")).unionByName(rows.groupBy(F.lit("row").alias("code")).agg(F.count("*").alias("n")))


@query("select 'empty_dataset' as code, 0::bigint as line, (select count(*) from events where event_id % 50 <> 2) as records")
def empty_dataset_issue(spark, sf_dir):
    path = fresh(spark, "blank")
    table(spark, sf_dir, "events").select(F.lit("\t ").alias("value")).write.text(path)
    _, issues = files.strict_jsonl(spark, path, "id long")
    return issues.select("code", "line").withColumn("records", F.lit(files.record_count(spark, _lines(spark, sf_dir))).cast("long"))


FIXED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_linenumber)::bigint as lines from lineitem group by all")
def fixed_columns_scan(spark, sf_dir):
    items = files.read(spark, f"{sf_dir}/lineitem.parquet", "parquet", FIXED)
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


CHECKSUMS = "select sha256(n_name) as sha256, case when n_nationkey = 5 then (select n_name from nation where n_nationkey = 4) else n_name end as path from nation where n_nationkey <> 3"


@query(f"""select path, sha256 as found from ({CHECKSUMS}) union all select path, 'duplicate' from ({CHECKSUMS}) group by path having count(*) > 1 union all select 'no checksum', 'format'""")
def checksum_list(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    other = nation.filter("n_nationkey = 4").select(F.col("n_name").alias("other"))
    named = nation.crossJoin(F.broadcast(other)).withColumn("p", F.when(F.col("n_nationkey") == 5, F.col("other")).otherwise(F.col("n_name")))
    path = fresh(spark, "sums")
    named.select(F.when(F.col("n_nationkey") == 3, "no checksum").otherwise(F.concat(F.sha2("n_name", 256), F.lit("  "), "p")).alias("value")).write.text(path)
    entries, problems = files.checksum_lines(spark, path)
    return entries.select("path", F.col("sha256").alias("found")).unionByName(problems.select("path", F.col("code").alias("found")))


@query("select sum(octet_length(encode(n_name)) + 1)::bigint as size_bytes, sha256(string_agg(n_name || chr(10), '' order by n_nationkey)) as sha256 from nation")
def file_fingerprints(spark, sf_dir):
    path = fresh(spark, "names")
    table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("value")).coalesce(1).write.text(path)
    return files.fingerprints(spark, path).filter(F.col("path").endswith(".txt")).select("size_bytes", "sha256")


@query(f"select split, count(*) as records, true as verified from (select {SPLIT} as split from documents) group by split")
def published_splits(spark, sf_dir):
    """Published, verified by digest, and the records that the manifest declares of each part."""
    path = fresh(spark, "published")
    docs = splits.with_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    files.publish(docs, path, {"licence": "synthetic"}, by="split")
    _, manifest = files.load_published(spark, path)
    return spark.createDataFrame([(k, p["records"], True) for k, p in manifest["parts"].items()], "split string, records long, verified boolean")


@query("""select event_type as event, min(value) as best_loss, min(event_id) filter (where value = m) as best_step from (select *, min(value) over (partition by event_type) as m from events) group by event_type""")
def metrics_log_scan(spark, sf_dir):
    path = fresh(spark, "log")
    files.write_jsonl(table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("event"), F.col("value").alias("loss")), path)
    log = files.metrics_log(spark, path, "step long, event string, loss double")
    return evaluation.best_step(log, "step", "loss", ["event"]).select("event", "best_loss", "best_step")


ENTRY = "select n_name as path, sha256(n_name) as h from nation"


@query(f"""select count(*) as paths, sha256('{{' || string_agg('"' || path || '":"' || h || '"', ',' order by path) || '}}') as digest from ({ENTRY})""")
def tree_digest(spark, sf_dir):
    return gates.tree_digest(table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256")))


@query("""select conv_id, turn, upper(substr(role, 1, 1)) || lower(substr(role, 2)) as named, octet_length(encode(text)) as bytes, lower(text) = lower(upper(text)) as folded, regexp_full_match(role, '[a-z0-9][a-z0-9._-]*') as identifier,
sha256(case when turn % 5 = 0 then 'a[control token]b[control token]' || text when turn % 5 = 1 then '[empty response]' else text end) as safe from conversations""")
def text_scalars(spark, sf_dir):
    said = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("a<|im_end|>b<|bos|>"), "text")).when(F.col("turn") % 5 == 1, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        text.capitalized(F.col("role")).alias("named"),
        F.octet_length("text").cast("long").alias("bytes"),
        text.same_folded(F.col("text"), F.upper("text")).alias("folded"),
        text.full_match(F.col("role"), text.IDENTIFIER).alias("identifier"),
        F.sha2(text.escape_control(said), 256).alias("safe"),
    )


@query("""select event_id, (props::json ->> 'k') as k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, strftime(ts, '%Y%m%dT%H%M%SZ') as stamp, event_type || '/' || (case when event_id % 2 = 0 then 'even' else event_type end) as merged from events""")
def record_scalars(spark, sf_dir):
    first = F.create_map(F.lit("type"), F.col("event_type"), F.lit("parity"), F.col("event_type"))
    second = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("parity"), F.lit("even"))).otherwise(F.create_map().cast("map<string,string>"))
    both = text.merged(first, second)
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.dotted(F.col("props"), "k").alias("k"),
        text.utc_seconds(F.col("ts")).alias("at"),
        text.run_stamp(F.col("ts")).alias("stamp"),
        F.concat_ws("/", both["type"], both["parity"]).alias("merged"),
    )
