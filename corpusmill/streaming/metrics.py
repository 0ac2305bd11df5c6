"""Streams: running summaries of a metrics log, first-wins ids and resumable sampling positions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor


def log_stream(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def running_best(log: DataFrame, by: str, step: str, loss: str) -> DataFrame:
    """The least loss so far and its step, per run; small state: one row per run."""
    return log.groupBy(by).agg(F.min(loss).alias("best_loss"), F.min(F.struct(loss, step))[step].alias("best_step"), F.count("*").alias("rows"))


def first_seen(records: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each id once, within the watermark."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, window: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))


class Quotas(StatefulProcessor):
    """Per stratum, the sampling key of each arriving row: tokens seen before over the stratum's weight. The
    state survives restarts, so a resumed stream goes on with the keys it would have given."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def init(self, handle) -> None:
        self.taken = handle.getValueState("taken", "tokens long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        taken = self.taken.get()[0] if self.taken.exists() else 0
        for pdf in rows:
            pdf = pdf.sort_values("place")
            before = taken + pdf.tokens.cumsum() - pdf.tokens
            taken += int(pdf.tokens.sum())
            yield pd.DataFrame({"stratum": key[0], "place": pdf.place, "quota": before / self.weights[key[0]]})
        self.taken.update((int(taken),))

    def close(self) -> None:
        pass


def run_once(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """What a stream has given once all available input is taken, as a table in memory: for small results."""
    name = f"t{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
