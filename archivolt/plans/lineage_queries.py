"""Queries over lineage, packages, sentences, the built-in policy and events in time, with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import audit, lineage, moderation, segments, timeline
from archivolt.plans.archive_queries import _FIRST_EVENTS, ORACLES as ARCHIVE_ORACLES, _dump_sql, _strip_sql
from archivolt.runtime import save, table
from archivolt.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PIPELINE, VERSION, NOW = "memory_atoms", "1.0", "2026-01-01T00:00:00Z"


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    """(atom_id, record_id, text): atoms with a text and a record, repeated deliveries once."""
    rows = table(spark, d, "atoms").where("atom_id is not null and record_id is not null and text is not null")
    return rows.groupBy("atom_id").agg(F.min(F.struct("record_id", "text")).alias("a")).select("atom_id", "a.record_id", "a.text")


_ATOMS = "a AS (SELECT atom_id, min(record_id) AS record_id, min(text) AS text FROM atoms WHERE atom_id IS NOT NULL AND record_id IS NOT NULL AND text IS NOT NULL GROUP BY atom_id)"


def _made(spark: SparkSession, d: str) -> DataFrame:
    atoms = _atoms(spark, d)
    inputs = atoms.select("record_id", F.col("atom_id").alias("position"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("digest"))
    payload = atoms.select("record_id", F.col("atom_id").alias("position"), F.to_json(F.struct("atom_id", "text")).alias("line"))
    return lineage.descriptors(inputs, payload, "record_id", PIPELINE, VERSION)


_MADE = f"""
{_ATOMS},
lines AS (SELECT *, to_json(struct_pack(atom_id := atom_id, text := text))::VARCHAR AS line FROM a),
made AS (
  SELECT record_id, '{PIPELINE}' AS pipeline, '{VERSION}' AS pipeline_version, count(*) AS n_inputs,
         'sha256:' || sha256(string_agg('sha256:' || sha256(text), chr(10) ORDER BY atom_id)) AS inputs_hash,
         'derived/{PIPELINE}/' || record_id || '.jsonl' AS output_path,
         'sha256:' || sha256(string_agg(line, chr(10) ORDER BY atom_id) || chr(10)) AS outputs_hash, sum(strlen(line) + 1)::BIGINT AS byte_size
  FROM lines GROUP BY record_id)
"""


@query(f"WITH {_MADE} SELECT *, NULL::VARCHAR AS fault FROM made")
def lineage_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """A descriptor for every record's file of atoms: digests of its inputs and of its lines, and what is wrong with it."""
    return _made(spark, d).withColumn("fault", lineage.descriptor_faults(F.col("output_path"), F.col("pipeline"), F.col("n_inputs")))


@query(
    f"""
WITH {_FIRST_EVENTS}, {_MADE},
heads AS (
  SELECT record_id, count(*) AS lines, 'sha256:' || arg_max(own, struct_pack(t := ingested_at, e := event_id)) AS head FROM hexed GROUP BY record_id),
ready AS (
  SELECT m.*, coalesce(h.lines, 0) AS lines, h.head, left(sha256(concat_ws(chr(1), m.record_id, m.pipeline, m.pipeline_version, m.output_path, m.outputs_hash)), 32) AS event_id,
         'pipelines.' || m.pipeline AS actor_id, 'system' AS actor_role, 'derived_asset_emitted' AS event_type, m.output_path || '.descriptor.json' AS evidence_ref,
         'derived asset emitted by pipeline ' || m.pipeline AS reason, '{NOW}' AS event_time,
         map(['pipeline', 'pipeline_version', 'descriptor_path', 'output_path', 'outputs_hash'],
             [m.pipeline, m.pipeline_version, m.output_path || '.descriptor.json', m.output_path, m.outputs_hash]) AS metadata
  FROM made m LEFT JOIN heads h ON h.record_id = m.record_id)
SELECT record_id, output_path, event_id, head AS prev_hash, 'sha256:' || sha256({_dump_sql("head")}) AS hash,
       'audit/events.jsonl#L' || (lines + 1)::VARCHAR AS audit_event_ref
FROM ready
"""
)
def lineage_events(spark: SparkSession, d: str) -> DataFrame:
    """The audit events that record the descriptors, each behind the last event of its record, and the references to them."""
    done = lineage.audit_descriptors(_made(spark, d), table(spark, d, "audit_events"), NOW)
    return done.select("record_id", "output_path", "event_id", "prev_hash", "hash", "audit_event_ref")


@query(
    rf"""
WITH {_ATOMS},
p AS (SELECT atom_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+|\s*\n\s*', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)) AS p FROM a),
s AS (SELECT atom_id, i, {_strip_sql("p[i]")} AS text FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p))
SELECT atom_id, (row_number() OVER (PARTITION BY atom_id ORDER BY i) - 1)::INTEGER AS sentence, text, length(text) > 4096 AS is_cut FROM s WHERE text <> ''
"""
)
def atom_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all atoms."""
    return segments.sentence_atoms(_atoms(spark, d).select("atom_id", "text")).select("atom_id", "sentence", "text", "is_cut")


@query(
    rf"""
WITH {_ATOMS}
SELECT atom_id, CASE
  WHEN regexp_matches(text, '\b(?:kill|hurt|harm|cut)\s+myself\b|\bend\s+my\s+life\b|\bsuicide\s+(?:plan|note|method)\b|\b(?:kill|murder|stab|shoot)\s+(?:you|him|her|them)\b|\bI\s+will\s+(?:kill|murder|hurt)\s+\w+', 'i') THEN 'block'
  WHEN regexp_matches(text, '((^|[^\p{{L}}\p{{N}}_])[A-Za-z0-9_]|[\p{{L}}\p{{N}}_][.%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}([^\p{{L}}\p{{N}}_]|$)') OR regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{{9}}([^0-9]|$)') THEN 'flag'
  ELSE 'pass' END AS outcome
FROM a
"""
)
def builtin_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What the built-in policy says about every atom."""
    return moderation.judge(_atoms(spark, d).select("atom_id", "text"), moderation.BUILTIN).select("atom_id", "outcome")


@query(
    f"""
WITH {_FIRST_EVENTS},
t AS (SELECT * FROM first WHERE event_type = 'consent_withdrawn' AND record_id IS NOT NULL AND event_ts IS NOT NULL),
c AS (SELECT * FROM first WHERE event_type = 'consent_verified' AND record_id IS NOT NULL AND event_ts IS NOT NULL)
SELECT record_id, event_id, epoch_us(event_ts) AS opened_us, epoch_us(event_ts + INTERVAL 7 DAY) AS closes_us,
  CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.record_id = t.record_id AND c.event_ts > t.event_ts AND c.event_ts < t.event_ts + INTERVAL 7 DAY) THEN 'cancelled'
       WHEN event_ts + INTERVAL 7 DAY <= TIMESTAMP '2024-06-01' THEN 'expired' ELSE 'open' END AS status
FROM t
"""
)
def dispute_windows(spark: SparkSession, d: str) -> DataFrame:
    """Seven days after every withdrawal, and whether they are over or cut short by a new consent."""
    events = audit.first_deliveries(table(spark, d, "audit_events"))
    now = F.lit("2024-06-01 00:00:00").cast(dict(events.dtypes)["event_ts"])
    windows = timeline.dispute_windows(
        events, "record_id", "event_id", "event_ts", F.col("event_type") == "consent_withdrawn", F.col("event_type") == "consent_verified", now
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return windows.select("record_id", "event_id", micros("opened_at").alias("opened_us"), micros("closes_at").alias("closes_us"), "status")


@query(
    f"""
WITH {_FIRST_EVENTS},
s AS (SELECT record_id, event_ts, event_id, event_type AS after, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM first WINDOW w AS (PARTITION BY record_id ORDER BY event_ts, event_id))
SELECT record_id, event_id, before, after FROM s WHERE k = 1 OR before IS DISTINCT FROM after
"""
)
def state_changes(spark: SparkSession, d: str) -> DataFrame:
    """The events of a record that are of another type than the one before."""
    events = audit.first_deliveries(table(spark, d, "audit_events"))
    return timeline.changes(events, "record_id", ["event_ts", "event_id"], "event_type").select("record_id", "event_id", "before", "after")


@query(
    f"""
WITH i AS ({ARCHIVE_ORACLES["audit_intact"]}), t AS (SELECT DISTINCT event_id, arg_min(event_type, ingested_at) OVER (PARTITION BY event_id) AS event_type FROM audit_events)
SELECT event_type, count(*) AS n, count(*) FILTER (NOT intact) AS n_failed, bool_and(intact) AS passed FROM i JOIN t USING (event_id) GROUP BY ROLLUP (event_type)
"""
)
def verification_report(spark: SparkSession, d: str) -> DataFrame:
    """How many events of every type stand the check of their hash."""
    first = audit.first_deliveries(table(spark, d, "audit_events"))
    checked = audit.verify_hashes(first).select("event_id", "intact").join(first.select("event_id", "event_type"), "event_id")
    return timeline.run_report(checked, "event_type", "intact")


@query(f"WITH {_ATOMS} SELECT atom_id, record_id, text FROM a WHERE {_strip_sql('text')} <> ''")
def json_lines_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The atoms written as JSON lines and read again; rows without a text are skipped by the reader."""
    folder = save(_atoms(spark, d).limit(0)) + ".jsonl"
    writers.write_json_lines(_atoms(spark, d), folder)
    return readers.read_json_lines(spark, folder, "atom_id string, record_id string, text string")


@query(f"WITH {_ATOMS} SELECT record_id AS package, 'atoms/' || atom_id || '.txt' AS path, strlen(text)::BIGINT AS size, 'sha256:' || sha256(text) AS sha256 FROM a")
def archive_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The atoms of every record packed into an archive, and the members read out of it."""
    members = _atoms(spark, d).select(
        F.col("record_id").alias("package"), F.concat(F.lit("atoms/"), "atom_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content")
    )
    packed = writers.build_archives(members, "package.json").select("package", F.col("archive").alias("content"))
    return readers.archive_members(packed).select("package", "path", "size", "sha256")


#: descriptors by the last hex digit of an atom's id, with what is wrong with their bytes and with their entries
_FORMS = (
    ('{"contents":[{"path":"a","sha256":"b","size":1}]}', None, None), ("{}", None, None), ("[1]", "not_object", None), ("{broken", "not_json", None), ('{"contents":7}', None, "not_array"),
    ('{"contents":[{"path":"a","sha256":"b","size":1},3]}', None, "entry_not_object"), ('{"contents":[{"sha256":"b","size":1}]}', None, "entry_path_missing"),
    ('{"contents":[{"path":"a","sha256":5,"size":1}]}', None, "entry_sha_missing"), ('{"contents":[{"path":"a","sha256":"b","size":"1"}]}', None, "entry_size_missing"), (None, "missing", None),
    ('{"contents":[{"path":7,"size":1},{"sha256":"b"}]}', None, "entry_path_missing"), ('"text"', "not_object", None), ('{"contents":[]}', None, None), ("\xff", "not_utf8", None), ("", "not_json", None), ("null", "not_object", None),
)
_CASES = " ".join(f"WHEN '{i:x}' THEN {{}}" for i in range(16))
_quote = lambda v: "NULL" if v is None else f"'{v}'"


@query(
    f"""
WITH {_ATOMS}
SELECT atom_id, CASE right(atom_id, 1) {_CASES.format(*(_quote(s) for _, s, _ in _FORMS))} END AS status,
       CASE right(atom_id, 1) {_CASES.format(*(_quote(e) for _, _, e in _FORMS))} END AS fault
FROM a
"""
)
def descriptor_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with descriptors of sixteen forms, dealt out over the atoms by the last digit of their id."""
    content, text = F.lit(None).cast("binary"), F.lit(None).cast("string")
    for i, (form, _, _) in enumerate(_FORMS):
        raw = None if form is None else (b"\xff" if form == "\xff" else form.encode())
        at = F.right("atom_id", F.lit(1)) == f"{i:x}"
        content = F.when(at, F.lit(raw).cast("binary")).otherwise(content)
        text = F.when(at, F.lit("" if form == "\xff" else form)).otherwise(text)
    rows = _atoms(spark, d).select("atom_id", content.alias("content"), text.alias("text"))
    return rows.select("atom_id", readers.descriptor_status(F.col("content")).alias("status"), readers.entry_faults(F.col("text")).alias("fault"))
