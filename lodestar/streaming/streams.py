"""Structured Streaming over feed events: validated, deduplicated, idempotent.

The batch rules of lodestar.operators.ingest are used as they are; state is bounded by watermarks, or kept in tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "event_id string, kind string, tech_id string, value string, at timestamp"
KINDS = ["impression", "click", "dwell"]


def events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """New JSON files of a folder as a stream."""
    return spark.readStream.schema(schema).json(path)


def validated(df: DataFrame) -> DataFrame:
    """Known kinds and ids that parse; a value that doesn't is null."""
    out = df.select("event_id", F.lower("kind").alias("kind"), F.expr("try_cast(tech_id AS BIGINT)").alias("tech_id"), F.expr("try_cast(value AS DOUBLE)").alias("value"), "at")
    return out.where(F.col("kind").isin(KINDS) & F.col("tech_id").isNotNull())


def once(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once, however often a client sends it within the watermark."""
    return df.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def rolling_counts(df: DataFrame, late: str = "1 hour", window: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Events of each item and kind by sliding window; rows later than the watermark are dropped."""
    return df.withWatermark("at", late).groupBy(F.window("at", window, slide), "tech_id", "kind").agg(F.count("*").alias("n"))


def append_existing(df: DataFrame, items: DataFrame, target: str, checkpoint: str, key: str = "event_id") -> StreamingQuery:
    """Appends events of existing items to a Parquet table, by day. A batch that is run again adds nothing: rows that are there already are left
    out by key, of the days of the batch alone, and items is read anew for each batch."""

    def write(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key]).join(items.select("tech_id"), "tech_id", "left_semi").select(key, "kind", "tech_id", "value", "at", F.to_date("at").alias("day"))
        if _exists(spark, target):
            days = [r.day for r in rows.select("day").distinct().collect()]
            rows = rows.join(spark.read.parquet(target).where(F.col("day").isin(days)).select(key), key, "left_anti")
        rows.write.mode("append").partitionBy("day").parquet(target)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The queue as the last run left it; empty before the first one."""
    runs = sorted(_children(spark, path), key=lambda name: int(name.split("=")[1]))
    return spark.read.schema(schema).parquet(f"{path}/{runs[-1]}") if runs else spark.createDataFrame([], schema)


def next_queue(queue: DataFrame, path: str) -> None:
    """Writes the queue for the next run beside the ones before, so that a run that fails leaves the last one in place."""
    runs = [int(name.split("=")[1]) for name in _children(queue.sparkSession, path)]
    queue.write.parquet(f"{path}/run={max(runs, default=0) + 1}")


def stage(df: DataFrame, known: DataFrame, path: str, schema: str, checkpoint: str, key: str = "source_url") -> StreamingQuery:
    """Adds what is new of a stream of crawled rows to the queue: rows whose key neither known nor the queue has. Rows for another try stay, as no run
    drops a row that ``next_queue`` doesn't."""

    def write(batch: DataFrame, _epoch: int) -> None:
        queue = queue_of(batch.sparkSession, path, schema)
        fresh = batch.dropDuplicates([key]).join(known.select(key), key, "left_anti").join(queue.select(key), key, "left_anti").select(*queue.columns)
        next_queue(queue.unionByName(fresh), path)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


OUTCOME_SCHEMA = "request_id long, tech_id long, wanted string, old_status string, outcome string, writes_history boolean"


def transitions(requests: DataFrame) -> DataFrame:
    """Outcomes of a stream of requests (request_id, tech_id, wanted, at_s), as ``ingest.outcomes_in_turn`` gives them for a batch. An item's status
    is kept as state; of a micro-batch its requests go by time, then id, while those of a later one count as later. A request with null request_id tells
    the status that an item had before, and has no outcome. One item's requests of one micro-batch are held together, so bound these at the source."""

    def step(key, chunks, state):
        rows = pd.concat(list(chunks)).sort_values(["at_s", "request_id"], na_position="first")
        status = state.get[0] if state.exists else None
        out = []
        for request, wanted in zip(rows["request_id"].tolist(), rows["wanted"].tolist()):
            if request == request and request is not None:
                outcome = "CREATED" if status is None else "NOOP" if status == wanted else "TRANSITIONED"
                out.append((int(request), key[0], wanted, status, outcome, outcome == "TRANSITIONED"))
            status = wanted
        state.update((status,))
        yield pd.DataFrame(out, columns=["request_id", "tech_id", "wanted", "old_status", "outcome", "writes_history"])

    return requests.groupBy("tech_id").applyInPandasWithState(step, OUTCOME_SCHEMA, "status string", "append", "NoTimeout")


def new_since(stored: DataFrame, cursor_s: int) -> DataFrame:
    """How many stored events came after a cursor."""
    return stored.where(F.unix_timestamp("at") > cursor_s).agg(F.count("*").alias("n"))


def alert_once(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """Alerts (asset_id, other_id) without a marker in history: what makes at-least-once delivery harmless."""
    marks = history.select("asset_id", F.col("changed_from").alias("m"))
    return pairs.join(marks, (pairs["asset_id"] == marks["asset_id"]) & (pairs["other_id"].cast("string") == marks["m"]), "left_anti")


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished runs in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [f.getName() for f in found if f.getName().startswith("run=") and fs.exists(done(f, "_SUCCESS"))]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
