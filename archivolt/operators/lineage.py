"""Lineage of derived artefacts: digests of long groups, descriptors, and the audit events that record them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.text import bare_sha256
from archivolt.operators.audit import canonical_json
from archivolt.operators.hierarchy import hex_digits


def fold_digest(df: DataFrame, group: str, order: str, value: str, between: str = "\n", after: str = "") -> DataFrame:
    """(group, n, byte_size, digest): ``sha256:`` and the digest of a group's values in order, joined by ``between`` and
    followed by ``after``.

    The values pass through one task a group as a sorted stream and only the state of the digest is kept, so a group may be
    of any size. Null values are left out; a null group is one; a group without values gives no row.
    """
    kind = df.schema[group].dataType
    name = kind.simpleString()
    schema = f"`{group}` {name}, n bigint, byte_size bigint, digest string"
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).alias("v"))
    ordered = rows.repartition("g").sortWithinPartitions("g", "o", "v").select("g", "v")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        state, current, n, size = None, None, 0, 0
        done: list[tuple] = []

        def close() -> None:
            state.update(after.encode())
            done.append((current, n, size + len(after.encode()), "sha256:" + state.hexdigest()))

        type_of = None
        for b in batches:
            type_of = b.schema.field(0).type
            for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state is None or g != current:
                    if state is not None:
                        close()
                    state, current, n, size = hashlib.sha256(), g, 0, 0
                data = (between if n else "").encode() + v.encode()
                state.update(data)
                n, size = n + 1, size + len(data)
            if len(done) >= 1000:
                yield _digests(done, group, type_of)
                done.clear()
        if state is not None:
            close()
            yield _digests(done, group, type_of)

    return ordered.mapInArrow(fold, schema)


def _digests(rows: list[tuple], group: str, kind: pa.DataType) -> pa.RecordBatch:
    g, n, size, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g, type=kind), pa.array(n, type=pa.int64()), pa.array(size, type=pa.int64()), pa.array(digest)], names=[group, "n", "byte_size", "digest"])


def combine_hashes(files: DataFrame, group: str, position: str, digest: str) -> DataFrame:
    """(group, n_inputs, input_hash): the digest of the line-joined digests of a group in order of position."""
    rows = files.select(group, position, F.concat(F.lit("sha256:"), bare_sha256(F.col(digest))).alias(digest))
    return fold_digest(rows, group, position, digest).select(group, F.col("n").alias("n_inputs"), F.col("digest").alias("input_hash"))


def descriptors(inputs: DataFrame, payload: DataFrame, record: str, pipeline: str, version: str) -> DataFrame:
    """(record, pipeline, pipeline_version, n_inputs, inputs_hash, output_path, outputs_hash, byte_size) of one artefact a record.

    ``inputs`` is (record, position, digest), ``payload`` (record, position, line): the lines of the artefact, each ended
    by a line feed. A record without inputs has none of its own (see ``descriptor_faults``).
    """
    taken = fold_digest(inputs, record, "position", "digest").select(record, F.col("n").alias("n_inputs"), F.col("digest").alias("inputs_hash"))
    made = fold_digest(payload, record, "position", "line", after="\n").select(record, F.col("digest").alias("outputs_hash"), "byte_size")
    path = F.concat(F.lit(f"derived/{pipeline}/"), F.col(record), F.lit(".jsonl"))
    return made.join(taken, record, "left").select(
        record, F.lit(pipeline).alias("pipeline"), F.lit(version).alias("pipeline_version"), F.coalesce("n_inputs", F.lit(0)).alias("n_inputs"), "inputs_hash",
        path.alias("output_path"), "outputs_hash", "byte_size",
    )


def descriptor_faults(path: Column, pipeline: Column, n_inputs: Column) -> Column:
    """What is wrong with a descriptor, null if nothing: its path is not under ``derived/<pipeline>/``, or it has no input."""
    return F.when(~F.coalesce(F.startswith(path, F.concat(F.lit("derived/"), pipeline, F.lit("/"))), F.lit(False)), "path").when(F.coalesce(n_inputs, F.lit(0)) < 1, "no_inputs")


def log_heads(log: DataFrame) -> DataFrame:
    """(record_id, lines, head): length of every record's log in order of ingestion, and its last hash as ``sha256:`` and digits."""
    one = log.groupBy("event_id").agg(F.min(F.struct("ingested_at", "record_id", "hash")).alias("e"))
    last = F.max(F.struct("e.ingested_at", "event_id", F.col("e.hash").alias("hash")))
    heads = one.groupBy(F.col("e.record_id").alias("record_id")).agg(F.count(F.lit(1)).alias("lines"), last.alias("last"))
    return heads.select("record_id", "lines", F.concat(F.lit("sha256:"), hex_digits(F.col("last.hash"))).alias("head"))


def audit_descriptors(made: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """The descriptors with the audit event that records each: (..., event_id, prev_hash, hash, audit_event_ref).

    Needs record_id and one descriptor a record; a record without a log starts one. The event's id derives from what it
    records, so that a repeated run emits the same event, which the log then refuses as known.
    """
    ready = made.join(log_heads(log), "record_id", "left")
    event = F.left(F.sha2(F.concat_ws("\u0001", "record_id", "pipeline", "pipeline_version", "output_path", "outputs_hash"), 256), F.lit(32))
    at = F.concat("output_path", F.lit(".descriptor.json"))
    metadata = F.create_map(
        *[x for k, v in (("pipeline", "pipeline"), ("pipeline_version", "pipeline_version"), ("descriptor_path", "at"), ("output_path", "output_path"), ("outputs_hash", "outputs_hash")) for x in (F.lit(k), F.col(v))]
    )
    ready = ready.withColumn("event_id", event).withColumn("at", at).withColumn("meta", metadata)
    body = canonical_json(
        F.col("head"), F.col("meta"), F.concat(F.lit("derived asset emitted by pipeline "), F.col("pipeline")),
        {
            "actor_id": F.concat(F.lit("pipelines."), F.col("pipeline")), "actor_role": F.lit("system"), "event_id": F.col("event_id"), "event_type": F.lit("derived_asset_emitted"),
            "evidence_ref": F.col("at"), "record_id": F.col("record_id"), "timestamp": F.lit(now),
        },
    )
    line = F.coalesce("lines", F.lit(0)) + 1
    return ready.select(
        *made.columns, "event_id", F.col("head").alias("prev_hash"), F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("hash"),
        F.concat(F.lit("audit/events.jsonl#L"), line.cast("string")).alias("audit_event_ref"),
    )
