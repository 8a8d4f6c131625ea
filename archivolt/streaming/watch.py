"""Streams over append-only logs: new events, windows with late data, revocations, changes of state, hash chains that grow."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import audit


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that a path or glob names, now and later."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n): counts in tumbling windows; events later than the watermark are dropped once a window is closed."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, length).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), key, "n")
    )


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(session_start, session_end, key, n): sessions of a key that end after a gap."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")
    )


def without_repeats(events: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """The first delivery of every key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def not_revoked(events: DataFrame, revoked: DataFrame, key: str) -> DataFrame:
    """A stream without the keys of a static table of revocations."""
    return events.join(revoked.select(key).distinct(), key, "left_anti")


def state_changes(events: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """(key, time, before, after): the changes of every key's state, the first with null before; state is kept per key.

    Within a micro-batch events count in order of time; one that comes in a later batch counts when it comes.
    """
    columns = events.select(key, time, state)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        last = kept.get[0] if kept.exists else None
        seen = kept.exists
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for t, s in zip(rows[time], rows[state], strict=True):
            if not seen or s != last:
                out.append((keys[0], t, last, s))
            last, seen = s, True
        kept.update((last,))
        yield pd.DataFrame(out, columns=[key, time, "before", "after"])

    kinds = dict(columns.dtypes)
    schema = f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, before string, after string"
    return columns.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", "NoTimeout")


def extend_chains(stream: DataFrame, log: str, checkpoint: str) -> None:
    """Appends what a stream of events holds now to the hash chains of a log in Parquet, micro-batch by micro-batch.

    A batch goes on from the last hash of every record. Events that the log has are left out, so a batch that is run again
    after a failure adds nothing twice.
    """

    def emit(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(log)
        except AnalysisException:  # the log begins with this batch
            old = None
        if old is None:
            audit.emit_chain(batch).write.parquet(log)
            return
        heads = old.groupBy("record_id").agg(F.max("line").alias("lines"), F.max_by("hash", "line").alias("head"))
        audit.emit_chain(audit.append(old, batch), heads).write.mode("append").parquet(log)

    stream.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its result as a table (for bounded results)."""
    name = "drain_" + uuid.uuid4().hex
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
