"""Heartbeat verdicts on a stream: the highest sequence of each worker is its state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import shared_folder

OUTPUT = "worker bigint, id bigint, seq bigint, verdict string"


class Verdicts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getValueState("high", "seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        known = self.high.get()
        high = None if known is None else known[0]
        batch = pd.concat(list(rows)).sort_values(["at", "id"])
        out = []
        for id_, seq in zip(batch["id"], batch["seq"], strict=True):
            verdict = "applied" if high is None or seq > high else "duplicate" if seq == high else "stale"
            high = seq if high is None else max(high, seq)
            out.append((key[0], id_, seq, verdict))
        self.high.update((int(high),))
        yield pd.DataFrame(out, columns=["worker", "id", "seq", "verdict"])

    def close(self) -> None:
        pass


def verdict_stream(beats: DataFrame) -> DataFrame:
    """A stream of (worker, at, id, seq) with each beat's verdict.  Beats of one micro-batch are taken in order of arrival time.

    A worker's beats of one micro-batch are sorted in memory, so the source's rate limits (maxFilesPerTrigger and the like) bound them.
    """
    return beats.groupBy("worker").transformWithStateInPandas(statefulProcessor=Verdicts(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def run_to_end(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All that a bounded stream gives, through the RocksDB state store into a table of the shared folder: no row passes the driver."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
