"""Observation logs as a stream: lines are parsed as they arrive, records and faults go to tables of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.sources import observations


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, text) of the ``.obs`` files that appear in a folder."""
    return spark.readStream.format("text").option("pathGlobFilter", "*.obs").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def start(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append good records and faults below ``target``; a batch that is run again overwrites its own files."""

    def write(batch: DataFrame, number: int) -> None:
        records = observations.parsed(batch).persist()
        observations.observations(records).write.mode("overwrite").parquet(f"{target}/observations/batch={number}")
        observations.retirements(records).write.mode("overwrite").parquet(f"{target}/retirements/batch={number}")
        records.where("fault is not null").select("path", "text", "fault").write.mode("overwrite").parquet(f"{target}/faults/batch={number}")
        records.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """What the log resolves to so far."""
    taken = spark.read.parquet(f"{target}/observations")
    gone = spark.read.parquet(f"{target}/retirements").select(F.col("supersedes").alias("id")).distinct()
    return taken.join(gone, "id", "left_anti")


def retirement_faults(records: DataFrame) -> DataFrame:
    """A stateful check of a stream of records (key, form, id): what is retired before it is seen, or twice.

    ``key`` is the id of the observation that a record is or retires, so one state is a few bytes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, retired = state.get if state.exists else (False, False)
        out = []
        for batch in batches:
            for form, id_ in zip(batch["form"], batch["id"], strict=True):
                if form == "obs":
                    if seen:
                        out.append((key[0], id_, "written twice"))
                    seen = True
                else:
                    if not seen:
                        out.append((key[0], id_, "retired before it was written"))
                    if retired:
                        out.append((key[0], id_, "retired twice"))
                    retired = True
        state.update((seen, retired))
        yield pd.DataFrame(out, columns=["key", "id", "fault"])

    return records.groupBy("key").applyInPandasWithState(step, "key string, id string, fault string", "seen boolean, retired boolean", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Records (session, at) grouped where pauses are shorter than ``gap``; what is later than ``late`` is not waited for."""
    return events.withWatermark("at", late).groupBy("session", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
