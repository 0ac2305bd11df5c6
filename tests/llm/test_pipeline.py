"""The pipeline's stages, each on its predecessor's rows, and the registration of its queries."""


def test_stages(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, counts = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == documents.columns
        counts.append(docs.count())
    assert counts[0] < documents.count() and counts[1] < counts[0] and counts[2] == counts[1] and counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_every_query_on_small_tables(spark, sf_dir):
    import __spark_entry__

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, query in __spark_entry__.queries().items():
        if name.startswith("op") and name[2].isdigit():
            n = query(spark, sf_dir).count()
            assert n >= documents if not name.startswith("op8_") else n > 0


def test_queries_with_sql(spark, sf_dir):
    from compare import connection, differences

    from corpusmill.llm import queries

    for name, sql in queries.oracle_sql().items():
        assert differences(queries.queries()[name](spark, sf_dir), connection(sf_dir).sql(sql)) == "", name


def test_workers_give_memory_back(spark):
    """Workers stay for later stages: what a stage's batches took isn't held on to."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from corpusmill.llm import packing, simhash, toxicity
    from corpusmill.llm.queries import vocabulary

    @F.pandas_udf("long")
    def held(x: pd.Series) -> pd.Series:
        import ctypes
        import re
        from pathlib import Path

        import pyarrow as pa

        def used() -> int:
            return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())))

        before = used()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        return x * 0 + before - used()

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.substring(F.md5(F.concat_ws(":", F.col("id"), i)), 1, 7)), " ")
    docs = spark.range(0, 2400, 1, 4).select(F.col("id").alias("doc_id"), words.alias("text")).cache()
    model = toxicity.Model({"a": 1.0}, np.zeros((2, 2)), -2.0, -2.0, np.zeros(4))
    for name, stage in {
        "packing": lambda: packing.pieces(docs, vocabulary("word_bpe_49k.json")),
        "simhash": lambda: simhash.with_fingerprints(docs),
        "toxicity": lambda: toxicity.with_scores(docs, model),
    }.items():
        stage().write.format("noop").mode("overwrite").save()
        most = spark.range(0, 4, 1, 4).select(held("id").alias("kb")).agg(F.max("kb")).first()[0]
        print(name, most)
        assert most < 24_000, (name, most)
