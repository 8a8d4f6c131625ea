"""Hash-chained audit logs: canonical form, verification, emission, order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import bare_sha256
from archivolt.operators.hierarchy import hex_digits

FIELDS = ("actor_id", "actor_role", "event_id", "event_type", "evidence_ref", "metadata", "prev_hash", "reason", "record_id", "timestamp")
KEEP_NULL = ("prev_hash", "actor_id", "evidence_ref")


def canonical_json(prev_hash: Column, metadata: Column, reason: Column, others: dict[str, Column]) -> Column:
    """The event as compact JSON with sorted keys, without its hash.

    Metadata that is null or empty and a null reason are left out; prev_hash, actor_id and evidence_ref stay as null.
    """
    ordered_map = F.map_from_entries(F.array_sort(F.map_entries(metadata)))
    values = {**others, "prev_hash": prev_hash, "metadata": ordered_map, "reason": reason}

    def dump(skip: tuple[str, ...]) -> Column:
        names = [n for n in FIELDS if n not in skip]
        return F.to_json(F.struct(*[values[n].alias(n) for n in names]), {"ignoreNullFields": "false"})

    no_meta = F.coalesce(F.size(metadata), F.lit(0)) <= 0
    return (
        F.when(no_meta & reason.isNull(), dump(("metadata", "reason")))
        .when(no_meta, dump(("metadata",)))
        .when(reason.isNull(), dump(("reason",)))
        .otherwise(dump(()))
    )


def _canonical(prev_hash: Column) -> Column:
    return canonical_json(
        prev_hash,
        F.col("metadata"),
        F.col("reason"),
        {
            "actor_id": F.col("actor_id"),
            "actor_role": F.col("actor_role"),
            "event_id": F.col("event_id"),
            "event_type": F.col("event_type"),
            "evidence_ref": F.col("evidence_ref"),
            "record_id": F.col("record_id"),
            "timestamp": F.col("event_time"),
        },
    )


def verify_hashes(events: DataFrame) -> DataFrame:
    """(event_id, record_id, intact): whether the hash is that of the event as it stands, spelling of the digests aside.

    The event is put into canonical form with prev_hash as ``sha256:`` and lower-case digits, or null if it has none, as
    it is when emitted, and with prev_hash as it is stored; either may give the hash.
    """
    own = hex_digits(F.col("hash"))
    usual = F.sha2(_canonical(F.concat(F.lit("sha256:"), hex_digits(F.col("prev_hash")))), 256)
    stored = F.sha2(_canonical(F.col("prev_hash")), 256)
    return events.select("event_id", "record_id", F.coalesce((usual == own) | (stored == own), F.lit(False)).alias("intact"))


def first_deliveries(events: DataFrame) -> DataFrame:
    """One row per event_id: the delivery ingested first."""
    names = [c for c in events.columns if c not in ("event_id", "ingested_at", "metadata")]
    packed = F.struct("ingested_at", *names, F.array_sort(F.map_entries("metadata")).alias("_m"))
    one = events.groupBy("event_id").agg(F.min(packed).alias("e"))
    return one.select("event_id", "e.ingested_at", *[f"e.{n}" for n in names], F.map_from_entries("e._m").alias("metadata"))


def chain_report(events: DataFrame, order: Sequence[str] = ("event_time", "event_id")) -> DataFrame:
    """(record_id, n_events, n_unlinked, n_out_of_order, first_bad): every record's log, by default in order of event time
    and id; ``order`` may name a line number instead.

    An event is linked if prev_hash has the digits of the hash before it (null or blank for the first). Order of wire
    times is by string. first_bad is the 1-based line of the first event that is not linked, null if there is none.
    """
    one = first_deliveries(events)
    w = Window.partitionBy("record_id").orderBy(*order)
    before = F.lag(hex_digits(F.col("hash"))).over(w)
    lined = one.select(
        "record_id",
        F.row_number().over(w).alias("line"),
        hex_digits(F.col("prev_hash")).eqNullSafe(before).alias("linked"),
        F.coalesce(F.lag("event_time").over(Window.partitionBy("record_id").orderBy("ingested_at", "event_id")) > F.col("event_time"), F.lit(False)).alias("late"),
    )
    return lined.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(~F.col("linked")).alias("n_unlinked"),
        F.count_if("late").alias("n_out_of_order"),
        F.min(F.when(~F.col("linked"), F.col("line"))).alias("first_bad"),
    )


def emit_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(event_id, record_id, line, prev_hash, hash): the log re-emitted as one hash chain per record.

    ``heads`` is (record_id, lines, head): chains that are there already and go on; the others start with a null prev_hash.

    A hash needs the one before it, so a record's chain is a fold; the rows of a record pass through one task as a
    sorted stream, batch by batch, and only the last hash is kept. All else of an event is put together beforehand: the
    canonical JSON on either side of prev_hash's value.
    """
    mark = "\u0002PREV\u0002"
    body = _canonical(F.lit(mark))
    w = Window.partitionBy("record_id").orderBy("event_time", "event_id")
    lined = first_deliveries(events).withColumn("line", F.row_number().over(w)).select(
        "record_id",
        "line",
        "event_id",
        F.split(body, r'"\\u0002PREV\\u0002"').alias("p"),
    ).select("record_id", "line", "event_id", F.get("p", F.lit(0)).alias("head"), F.get("p", F.lit(1)).alias("tail"))
    if heads is None:
        parts = lined.withColumn("before", F.lit(None).cast("string"))
    else:
        known = heads.select("record_id", "lines", F.col("head").alias("before"))
        parts = lined.join(known, "record_id", "left").withColumn("line", (F.col("line") + F.coalesce("lines", F.lit(0))).cast("int"))
    ordered = parts.repartition("record_id").sortWithinPartitions("record_id", "line")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        record, last = object(), None
        for pdf in batches:
            prev, own = [], []
            for r, head, tail, before in zip(pdf["record_id"], pdf["head"], pdf["tail"], pdf["before"], strict=True):
                if r != record:
                    record, last = r, before
                prev.append(last)
                value = "null" if last is None else f'"{last}"'
                last = "sha256:" + hashlib.sha256(f"{head}{value}{tail}".encode()).hexdigest()
                own.append(last)
            yield pd.DataFrame({"event_id": pdf["event_id"], "record_id": pdf["record_id"], "line": pdf["line"], "prev_hash": prev, "hash": own})

    return ordered.mapInPandas(fold, "event_id string, record_id string, line int, prev_hash string, hash string")


def append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch that may be appended: one per event_id, and none whose event_id the log has."""
    return batch.dropDuplicates(["event_id"]).join(log.select("event_id"), "event_id", "left_anti")


def refused(log: DataFrame, batch: DataFrame) -> DataFrame:
    """(event_id, reason) of the rows of a batch that must not be appended: null, known to the log, or repeated."""
    n = batch.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    known = log.select("event_id").distinct().withColumn("known", F.lit(True))
    reason = F.when(F.col("event_id").isNull(), "no_id").when(F.col("known"), "known").when(F.col("n") > 1, "repeated")
    return n.join(known, "event_id", "left").select("event_id", reason.alias("reason")).where("reason is not null")
