"""Queries over the whole test tables, one or more per operator, and DuckDB SQL with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions import text as tx
from archivolt.operators import audit, cascade, graph, lineage, moderation, relations, segments
from archivolt.operators.hierarchy import parent_links
from archivolt.operators.neighbours import neighbours
from archivolt.operators.vectors import hash_embedding
from archivolt.plans import pipelines
from archivolt.runtime import spread, table
from archivolt.streaming import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_STRIP_SQL = r"[\s\v\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_STRIP_SQL}|{_STRIP_SQL}$', '', 'g')"


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


# ---- text ----------------------------------------------------------------------------------------------------------


# DuckDB's engine has no look-around, so the ends of runs of digits are marked first; its rules stand for those of
# functions.text, with room for the marks
_OCTET = "⟦(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])⟧"
_MARKED_RULES = (
    ("url_with_credentials", r"[a-zA-Z][a-zA-Z0-9+.⟦⟧-]*://[^\s/@]+:[^\s/@]+@[^\s]+"),
    ("email", r"[A-Za-z0-9._%+⟦⟧-]+@[A-Za-z0-9.⟦⟧-]+\.[A-Za-z]{2,}"),
    ("id_cn", "⟦[0-9]{17}(?:[0-9]⟧|⟧[Xx])"),
    ("phone_cn", "⟦1[3-9][0-9]{9}⟧"),
    ("ipv4", rf"{_OCTET}(?:\.{_OCTET}){{3}}"),
    ("credit_card_like", "⟦(?:[0-9]⟧?[ -]?⟦?){12,18}[0-9]⟧"),
    ("phone_generic", r"\+?⟦[0-9]⟧?(?:⟦?[0-9 \-().]⟧?){6,18}⟦?[0-9]⟧"),
)
_MARKED = "|".join(f"({rule})" for _, rule in _MARKED_RULES)


@query(
    rf"""
WITH t AS (SELECT regexp_replace(regexp_replace(text, '(^|[^0-9])([0-9])', '\1⟦\2', 'g'), '([0-9])([^0-9]|$)', '\1⟧\2', 'g') AS t FROM documents),
k AS ({" UNION ALL ".join(f"SELECT '{name}' AS kind, len(list_filter(regexp_extract_all(t, '{_MARKED}', {i}), lambda x: x <> '')) AS n FROM t" for i, (name, _) in enumerate(_MARKED_RULES, start=1))})
SELECT kind, sum(n)::BIGINT AS n FROM k GROUP BY kind HAVING sum(n) > 0
"""
)
def text_redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    """Redactions by kind over all documents (Python parity is tested as well)."""
    kinds = F.explode(F.transform(tx.redaction_matches(F.col("text")), tx.rule_of)).alias("kind")
    return _docs(spark, d).select(kinds).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    """Digest and spans of the normalised and redacted documents."""
    out = pipelines.text(_docs(spark, d))
    return out.select("doc_id", "text_sha256", F.size("spans").alias("n_spans"))


@query(
    rf"""
SELECT doc_id, length(t) AS n_chars, sha256(t) AS digest FROM (
  SELECT doc_id, {_strip_sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200b}-\x{200d}\x{feff}]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS t
  FROM documents)
"""
)
def text_whitespace(spark: SparkSession, d: str) -> DataFrame:
    """Documents after all steps of normalisation but the compatibility form."""
    t = tx.normalise(F.col("text"), compatibility=False)
    return _docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS text_sha256, right(text, 1) = chr(10) AS ends_line FROM documents")
def text_digests(spark: SparkSession, d: str) -> DataFrame:
    """Content digests of all documents."""
    return _docs(spark, d).select("doc_id", tx.sha256(F.col("text")).alias("text_sha256"), F.col("text").endswith("\n").alias("ends_line"))


@query(
    r"""
SELECT record_id, replace(replace(lower(display_name), ' ', '-'), '_', '-') AS slug,
  replace(replace(replace(replace(replace(display_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html,
  regexp_replace(path, '^.*/', '') AS leaf
FROM (SELECT DISTINCT record_id, display_name, path FROM records)
"""
)
def record_names(spark: SparkSession, d: str) -> DataFrame:
    """Slugs, escaped names and folder names of the records."""
    r = table(spark, d, "records").select("record_id", "display_name", "path").distinct()
    return r.select("record_id", tx.slug(F.col("display_name")).alias("slug"), tx.html_escape(F.col("display_name")).alias("html"), F.regexp_replace("path", "^.*/", "").alias("leaf"))


@query(
    r"""
SELECT DISTINCT evidence_ref,
  CASE WHEN contains(evidence_ref, '://') THEN split_part(evidence_ref, '://', 1) ELSE 'obj' END AS scheme,
  evidence_ref <> '' AND NOT contains(evidence_ref, '\') AND NOT list_has_any(string_split(evidence_ref, '/'), ['', '.', '..']) AS safe,
  CASE WHEN regexp_matches(evidence_ref, '(\.clean\.txt|\.transcript\.json|\.atoms\.jsonl)$')
    THEN regexp_replace(regexp_replace(evidence_ref, '^.*/', ''), '(\.clean\.txt|\.transcript\.json|\.atoms\.jsonl)$', '')
    ELSE regexp_replace(regexp_replace(evidence_ref, '^.*/', ''), '\.[^.]+$', '') END AS stem
FROM audit_events WHERE evidence_ref IS NOT NULL
"""
)
def evidence_paths(spark: SparkSession, d: str) -> DataFrame:
    """Schemes, safety and stems of the paths that events refer to."""
    ref = F.col("evidence_ref")
    return (
        table(spark, d, "audit_events").where("evidence_ref is not null").select("evidence_ref").distinct()
        .select("evidence_ref", tx.uri_scheme(ref).alias("scheme"), tx.safe_member(ref).alias("safe"), tx.stem(ref).alias("stem"))
    )


# ---- segments ------------------------------------------------------------------------------------------------------


@query(
    f"""
WITH one AS (SELECT transcript_id, seg_index, max(coalesce(text, '')) AS text FROM segments GROUP BY ALL)
SELECT transcript_id, {_strip_sql("string_agg(text, chr(10) ORDER BY seg_index)")} AS text FROM one GROUP BY transcript_id
"""
)
def transcript_texts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts from their segments."""
    return segments.transcript_text(table(spark, d, "segments"))


@query(
    f"""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS para, text FROM (
  SELECT doc_id, i, {_strip_sql("p[i]")} AS text
  FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS i FROM documents))
WHERE text <> ''
"""
)
def document_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of all documents."""
    return segments.paragraphs(_docs(spark, d))


@query()
def document_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Redacted paragraph atoms of all documents."""
    return pipelines.memory_atoms(_docs(spark, d))


@query(
    rf"""
WITH cut AS (
  SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS p,
         list_concat(list_transform(regexp_extract_all(text, '\n\s*\n'), lambda x: length(x)), [0::BIGINT]) AS gaps FROM documents),
placed AS (
  SELECT doc_id, i, p[i] AS raw,
    list_sum(list_transform(p[1:i-1], lambda x: length(x))) AS a, list_sum(gaps[1:i-1]) AS b
  FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM cut)),
para AS (
  SELECT doc_id, i, {_strip_sql("raw")} AS text,
    coalesce(a, 0) + coalesce(b, 0) + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS start
  FROM placed),
win AS (
  SELECT doc_id, i, w, substring(text, (w * 520 + 1)::BIGINT, 600) AS text, start + w * 520 AS char_start,
         start + least(w * 520 + 600, length(text)) AS char_end
  FROM (SELECT *, unnest(range(0, greatest(0, ceil((length(text) - 600) / 520.0))::BIGINT + 1)) AS w FROM para WHERE text <> ''))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, w) - 1)::INTEGER AS chunk_id, text,
       char_start::INTEGER AS char_start, char_end::INTEGER AS char_end, 'sha256:' || sha256(text) AS text_sha256
FROM win
"""
)
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows over the paragraphs of all documents."""
    return segments.chunks(_docs(spark, d))


# ---- moderation ----------------------------------------------------------------------------------------------------

_RULE_HITS = r"""
hits AS (
  SELECT d.doc_id, r.rule_name, coalesce(r.category, 'custom') AS category, coalesce(r.severity, 'medium') AS severity,
         len(regexp_extract_all(d.text, r.pattern, 0, 'i')) AS n
  FROM documents d, (SELECT rule_name, category, severity, unnest(patterns) AS pattern FROM policy_rules) r
  WHERE regexp_matches(d.text, r.pattern, 'i'))
"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return moderation.flags(_docs(spark, d), moderation.policy_from_table(table(spark, d, "policy_rules")))


@query(f"WITH {_RULE_HITS} SELECT doc_id, rule_name AS rule, sum(n)::BIGINT AS n FROM hits GROUP BY ALL")
def moderation_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matches of every rule in every document."""
    return _flags(spark, d).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH m AS (
  SELECT d.doc_id, r.rule_name, coalesce(r.category, 'custom') AS category, coalesce(r.severity, 'medium') AS severity,
         list_transform(regexp_split_to_array(d.text, '(?i)' || r.pattern), lambda x: length(x)) AS gaps,
         list_transform(regexp_extract_all(d.text, r.pattern, 0, 'i'), lambda x: length(x)) AS sizes
  FROM documents d, (SELECT rule_name, category, severity, unnest(patterns) AS pattern FROM policy_rules) r
  WHERE regexp_matches(d.text, r.pattern, 'i')),
e AS (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM m),
s AS (SELECT *, (list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0))::INTEGER AS start FROM e)
SELECT doc_id, rule_name AS rule, category, severity, start, (start + sizes[i])::INTEGER AS "end" FROM s
"""
)
def moderation_spans(spark: SparkSession, d: str) -> DataFrame:
    """Places of all matches."""
    return _flags(spark, d)


@query(
    f"""
WITH {_RULE_HITS},
w AS (SELECT doc_id, max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS worst, sum(n) AS n FROM hits GROUP BY 1)
SELECT d.doc_id, CASE worst WHEN 2 THEN 'block' WHEN 1 THEN 'flag' ELSE 'pass' END AS outcome, coalesce(n, 0)::BIGINT AS n_flags
FROM documents d LEFT JOIN w USING (doc_id)
"""
)
def moderation_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of every document."""
    return pipelines.moderate(_docs(spark, d), moderation.policy_from_table(table(spark, d, "policy_rules")))


@query(f"WITH {_RULE_HITS} SELECT severity, category, sum(n)::BIGINT AS n FROM hits GROUP BY GROUPING SETS ((severity), (category), ())")
def moderation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of flags by severity, by category and in total."""
    return moderation.summary(_flags(spark, d))


# ---- graph ---------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in graph.STOP_WORDS)
_MENTIONS = rf"""
units AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS para, text FROM (
    SELECT doc_id, i, {_strip_sql("p[i]")} AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
  WHERE text <> ''),
runs AS (
  SELECT doc_id, para, list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\P{{L}}]', '_', 'g'), '\b[A-Z][a-z]+(?: [A-Z][a-z]+){{0,3}}\b'),
    lambda c: contains(c, ' ') OR c NOT IN ({_STOP})) AS c FROM units),
each AS (SELECT doc_id, para, lower(c[i]) AS key, c[i] AS label, i FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM runs)),
first AS (SELECT doc_id, para, key, arg_min(label, i) AS label, min(i) AS i FROM each GROUP BY doc_id, para, key)
"""


@query(
    f"""
WITH {_MENTIONS},
forms AS (SELECT doc_id, key, label, count(*) AS n, min(struct_pack(para := para, i := i)) AS seen FROM first GROUP BY doc_id, key, label),
n AS (SELECT doc_id, key, arg_min(label, struct_pack(n := -n, seen := seen, label := label)) AS label, sum(n)::BIGINT AS mentions FROM forms GROUP BY doc_id, key)
SELECT doc_id, key, label, mentions, mentions / max(mentions) OVER (PARTITION BY doc_id) AS salience FROM n
"""
)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entities of every document, every line a unit."""
    found, _ = pipelines.knowledge_graph(_docs(spark, d))
    return found.drop("node_id", "aliases")


_NODE_ID = "'node_' || left(sha256(doc_id::VARCHAR || chr(1) || {}), 12)"


@query(
    f"""
WITH {_MENTIONS},
n AS (SELECT doc_id, key, count(DISTINCT label) AS forms FROM first GROUP BY doc_id, key)
SELECT doc_id, {_NODE_ID.format("key")} AS node_id, least(64, forms - 1)::INTEGER AS n_aliases FROM n
"""
)
def graph_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the entities of every document, and how many other forms each has."""
    found, _ = pipelines.knowledge_graph(_docs(spark, d))
    return found.select("doc_id", "node_id", F.size("aliases").alias("n_aliases"))


@query(
    f"""
WITH {_MENTIONS},
e AS (SELECT doc_id, para, i, key AS source, lead(key) OVER (PARTITION BY doc_id, para ORDER BY i) AS target FROM first)
SELECT doc_id, {_NODE_ID.format("source")} AS subject_node_id, {_NODE_ID.format("target")} AS object_node_id, para::INTEGER AS para,
       (row_number() OVER (PARTITION BY doc_id, para ORDER BY i))::INTEGER AS number
FROM e WHERE target IS NOT NULL
"""
)
def graph_links(spark: SparkSession, d: str) -> DataFrame:
    """The edges between the ids of neighbouring entities, numbered within their line."""
    _, found = pipelines.knowledge_graph(_docs(spark, d))
    number = F.row_number().over(Window.partitionBy("doc_id", "para").orderBy("pos"))
    return graph.links(found, "doc_id").select("doc_id", "subject_node_id", "object_node_id", F.col("para").cast("int").alias("para"), number.alias("number"))


@query(
    f"""
WITH {_MENTIONS},
e AS (SELECT doc_id, para, key AS source, lead(key) OVER (PARTITION BY doc_id, para ORDER BY i) AS target FROM first)
SELECT doc_id, source, target, count(*) AS n FROM e WHERE target IS NOT NULL GROUP BY ALL
"""
)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring entities, counted by document."""
    _, found = pipelines.knowledge_graph(_docs(spark, d))
    return found.groupBy("doc_id", "source", "target").agg(F.count(F.lit(1)).alias("n"))


# ---- vectors -------------------------------------------------------------------------------------------------------


@query(
    r"""
WITH h AS (
  SELECT sample_id, array_to_string(list_transform(range(8), lambda i: sha256(sample_id::VARCHAR || chr(0) || text || chr(0) || chr(i::INTEGER))), '') AS x FROM lang_samples),
w AS (
  SELECT sample_id, list_transform(range(64), lambda i:
    ('0x' || substring(x, i * 8 + 7, 2) || substring(x, i * 8 + 5, 2) || substring(x, i * 8 + 3, 2) || substring(x, i * 8 + 1, 2))::UBIGINT / 4294967295.0::DOUBLE * 2.0 - 1.0) AS v FROM h)
SELECT sample_id, round(v[1] / n, 6) AS first, round(v[32] / n, 6) AS middle, round(v[64] / n, 6) AS last, round(list_sum(list_transform(v, lambda a: a / n)), 6) AS total
FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda b: b * b))) AS n FROM w)
"""
)
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Hash embeddings of all samples."""
    s = table(spark, d, "lang_samples")
    v = s.select("sample_id", hash_embedding(F.col("sample_id").cast("string"), F.col("text")).alias("v"))
    return v.select(
        "sample_id",
        F.round(F.get("v", F.lit(0)), 6).alias("first"),
        F.round(F.get("v", F.lit(31)), 6).alias("middle"),
        F.round(F.get("v", F.lit(63)), 6).alias("last"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query()
def document_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Hash embeddings of the chunks of all documents (tested against brute force; the SQL of hash_embeddings covers the form)."""
    return pipelines.vectorization(_docs(spark, d)).select("doc_id", "chunk_id", "text_sha256", "embedding")


@query(
    """
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id,
         round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS similarity
  FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, neighbour_id, round(similarity, 6) AS similarity FROM r WHERE rank <= 5
"""
)
def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    e = table(spark, d, "embeddings")
    return neighbours(e, e.where("vec_id % 50 = 0")).withColumn("similarity", F.round("similarity", 6))


# ---- audit ---------------------------------------------------------------------------------------------------------

_FIRST_EVENTS = """
first AS (SELECT * FROM audit_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) = 1),
hexed AS (
  SELECT *, nullif(regexp_extract(regexp_replace(lower(hash), '[\\s\\x{00a0}\\x{3000}]+', '', 'g'), '^(?:sha-?256)?[:=]?([0-9a-f]{64})$', 1), '') AS own,
    nullif(regexp_extract(regexp_replace(lower(prev_hash), '[\\s\\x{00a0}\\x{3000}]+', '', 'g'), '^(?:sha-?256)?[:=]?([0-9a-f]{64})$', 1), '') AS prev
  FROM first)
"""


def _dump_sql(prev: str) -> str:
    """The canonical JSON of an event in DuckDB."""
    meta = "CASE WHEN cardinality(metadata) > 0 THEN '\"metadata\":' || to_json(map_from_entries(list_sort(map_entries(metadata))))::VARCHAR || ',' ELSE '' END"
    part = lambda name, x: f"'\"{name}\":' || coalesce(to_json({x})::VARCHAR, 'null') || ','"
    return (
        "'{' || "
        + " || ".join(part(n, n) for n in ("actor_id", "actor_role", "event_id", "event_type", "evidence_ref"))
        + f" || coalesce({meta}, '') || {part('prev_hash', prev)} || CASE WHEN reason IS NULL THEN '' ELSE {part('reason', 'reason')} END"
        + f" || {part('record_id', 'record_id')} || '\"timestamp\":' || coalesce(to_json(event_time)::VARCHAR, 'null') || '}}'"
    )


@query(
    f"""
WITH {_FIRST_EVENTS}
SELECT event_id, record_id, coalesce(sha256({_dump_sql("'sha256:' || prev")}) = own OR sha256({_dump_sql("prev_hash")}) = own, false) AS intact FROM hexed
"""
)
def audit_intact(spark: SparkSession, d: str) -> DataFrame:
    """Whether every event's hash is that of the event as it stands."""
    return audit.verify_hashes(audit.first_deliveries(table(spark, d, "audit_events")))


@query(
    f"""
WITH {_FIRST_EVENTS},
l AS (
  SELECT record_id, row_number() OVER w AS line, prev IS NOT DISTINCT FROM lag(own) OVER w AS linked,
    coalesce(lag(event_time) OVER (PARTITION BY record_id ORDER BY ingested_at, event_id) > event_time, false) AS late
  FROM hexed WINDOW w AS (PARTITION BY record_id ORDER BY event_time, event_id))
SELECT record_id, count(*) AS n_events, count(*) FILTER (NOT linked) AS n_unlinked, count(*) FILTER (late) AS n_out_of_order,
       min(line) FILTER (NOT linked)::INTEGER AS first_bad
FROM l GROUP BY record_id
"""
)
def audit_chains(spark: SparkSession, d: str) -> DataFrame:
    """State of the chain of every record."""
    return audit.chain_report(table(spark, d, "audit_events"))


@query(
    rf"""
WITH RECURSIVE {_FIRST_EVENTS},
lined AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY event_time, event_id) AS line FROM first),
chain AS (
  SELECT event_id AS ev, record_id AS rec, line AS k, NULL::VARCHAR AS p, 'sha256:' || sha256({_dump_sql("NULL")}) AS h FROM lined WHERE line = 1
  UNION ALL
  SELECT event_id, record_id, line, h, 'sha256:' || sha256({_dump_sql("h")}) FROM chain JOIN lined ON record_id IS NOT DISTINCT FROM rec AND line = k + 1)
SELECT ev AS event_id, rec AS record_id, k::INTEGER AS line, p AS prev_hash, h AS hash FROM chain
"""
)
def audit_reemitted(spark: SparkSession, d: str) -> DataFrame:
    """The log emitted anew as one chain per record."""
    return audit.emit_chain(table(spark, d, "audit_events"))


@query(
    """
SELECT record_id, count(*) AS n_inputs,
  'sha256:' || sha256(string_agg('sha256:' || regexp_replace(audio_sha256, '^sha256:', ''), chr(10) ORDER BY transcript_id)) AS input_hash
FROM transcripts WHERE audio_sha256 IS NOT NULL GROUP BY record_id
"""
)
def lineage_input_hashes(spark: SparkSession, d: str) -> DataFrame:
    """One digest for all audio files of a record."""
    return lineage.combine_hashes(table(spark, d, "transcripts"), "record_id", "transcript_id", "audio_sha256")


_TREE = """
links AS (
  SELECT h.event_id AS node, o.parent FROM hexed h
  LEFT JOIN (SELECT record_id, own, min(event_id) AS parent FROM hexed WHERE own IS NOT NULL GROUP BY ALL) o
    ON o.record_id = h.record_id AND o.own = h.prev)
"""


@query(
    f"""
WITH RECURSIVE {_FIRST_EVENTS}, {_TREE},
tree AS (
  SELECT node, [node] AS path FROM links WHERE parent IS NULL
  UNION ALL SELECT l.node, list_append(t.path, l.node) FROM tree t JOIN links l ON l.parent = t.node),
up AS (SELECT node, unnest(path) AS ancestor, unnest(range(len(path) - 1, -1, -1)) AS distance FROM tree)
SELECT u.node, arg_min(u.ancestor, u.distance) AS origin, min(u.distance)::INTEGER AS distance
FROM up u JOIN first f ON f.event_id = u.ancestor AND f.event_type = 'consent_withdrawn' WHERE u.distance > 0 GROUP BY u.node
"""
)
def withdrawal_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Events that follow from a withdrawal, with the nearest one above them."""
    events = table(spark, d, "audit_events")
    return cascade.tainted(parent_links(events), events.where("event_type = 'consent_withdrawn'").select(F.col("event_id").alias("node")))


# ---- relations -----------------------------------------------------------------------------------------------------


@query("SELECT record_id, path, risk_level, epoch_us(updated_at) AS updated_us FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC) AS k FROM records) WHERE k = 1")
def records_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every record."""
    return relations.latest(table(spark, d, "records"), "record_id", ["updated_at"]).select("record_id", "path", "risk_level", F.unix_micros("updated_at").alias("updated_us"))


_INVENTORY = """
declared AS (SELECT DISTINCT doc_id, chunk_id::VARCHAR AS path, char_end - char_start AS size, text_sha256 AS sha FROM chunks WHERE char_start IS NOT NULL),
actual AS (SELECT DISTINCT doc_id, chunk_id::VARCHAR AS path, length(text) AS size, sha256(text) AS sha FROM chunks WHERE text IS NOT NULL),
both_sides AS (
  SELECT coalesce(d.doc_id, a.doc_id) AS doc_id, coalesce(d.path, a.path) AS path,
    CASE WHEN d.path IS NULL THEN 'extra' WHEN a.path IS NULL THEN 'missing' WHEN d.size <> a.size THEN 'size'
         WHEN regexp_replace(d.sha, '^sha256:', '') <> a.sha THEN 'hash' ELSE 'ok' END AS status
  FROM declared d FULL JOIN actual a ON d.doc_id = a.doc_id AND d.path = a.path)
"""


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    declared = c.where("char_start is not null").select(
        "doc_id", F.col("chunk_id").cast("string").alias("path"), (F.col("char_end") - F.col("char_start")).alias("size"), F.col("text_sha256").alias("sha256")
    ).distinct()
    actual = c.where("text is not null").select(
        "doc_id", F.col("chunk_id").cast("string").alias("path"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha256")
    ).distinct()
    return relations.compare_inventory(declared, actual, "doc_id")


@query(f"WITH {_INVENTORY} SELECT doc_id, path, status FROM both_sides WHERE status <> 'ok'")
def inventory_faults(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose offsets or digests do not fit their text."""
    return _inventory(spark, d).where("status <> 'ok'")


@query(
    f"""
WITH {_INVENTORY}
SELECT doc_id, count(*) AS n_entries,
  CASE min(CASE status WHEN 'missing' THEN 1 WHEN 'size' THEN 2 WHEN 'hash' THEN 3 WHEN 'extra' THEN 4 END)
    WHEN 1 THEN 'missing' WHEN 2 THEN 'size' WHEN 3 THEN 'hash' WHEN 4 THEN 'extra' ELSE 'ok' END AS verdict,
  coalesce(array_to_string(list_sort(list(DISTINCT path) FILTER (status = 'extra'))[1:5], ','), '') ||
    CASE WHEN count(DISTINCT path) FILTER (status = 'extra') > 5 THEN ',...' ELSE '' END AS extras
FROM both_sides GROUP BY doc_id
"""
)
def inventory_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """First failure of every document's chunks."""
    return relations.inventory_verdict(_inventory(spark, d), "doc_id")


@query(
    """
SELECT record_id, backend, count(*) AS n, round(sum(duration_seconds), 6) AS total, grouping(record_id, backend)::BIGINT AS level
FROM transcripts GROUP BY ROLLUP (record_id, backend)
"""
)
def duration_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Durations by record and backend, by record, and in all."""
    return relations.roll_up(table(spark, d, "transcripts"), "record_id", "backend", "duration_seconds").withColumn("total", F.round("total", 6))


@query(
    """
WITH p AS (SELECT DISTINCT r.path || '/' || e.evidence_ref AS path FROM audit_events e JOIN (SELECT DISTINCT record_id, path FROM records) r USING (record_id) WHERE e.evidence_ref IS NOT NULL),
o AS (SELECT path AS dir, min(record_id) AS owner FROM records GROUP BY path)
SELECT p.path, coalesce(arg_max(o.owner, length(o.dir)), '<unknown>') AS owner FROM p LEFT JOIN o ON starts_with(p.path, o.dir || '/') GROUP BY p.path
"""
)
def evidence_owners(spark: SparkSession, d: str) -> DataFrame:
    """The record whose folder holds a piece of evidence."""
    r = table(spark, d, "records").select("record_id", "path").distinct()
    paths = table(spark, d, "audit_events").where("evidence_ref is not null").join(r, "record_id").select(F.concat_ws("/", "path", "evidence_ref").alias("path")).distinct()
    owners = r.groupBy(F.col("path").alias("dir")).agg(F.min("record_id").alias("owner"))
    return relations.nearest_owner(paths, owners)


@query(
    r"""
SELECT record_id, path FROM (
  SELECT record_id, evidence_ref AS path, row_number() OVER (PARTITION BY record_id ORDER BY
    CASE WHEN regexp_matches(evidence_ref, '^derived/text/') THEN 0 WHEN regexp_matches(evidence_ref, '^derived/') THEN 1 ELSE 2 END, evidence_ref) AS k
  FROM audit_events WHERE evidence_ref IS NOT NULL) WHERE k = 1
"""
)
def preferred_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The input of every record by priority of its kind."""
    files = table(spark, d, "audit_events").where("evidence_ref is not null").select("record_id", F.col("evidence_ref").alias("path"))
    return relations.first_by_priority(files, "record_id", ["^derived/text/", "^derived/", "."])


@query("SELECT audio_path, count(DISTINCT audio_sha256) AS n_digests FROM transcripts WHERE audio_sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT audio_sha256) > 1")
def audio_substitutions(spark: SparkSession, d: str) -> DataFrame:
    """Audio paths under which more than one content goes."""
    return relations.substitutions(table(spark, d, "transcripts"), ["audio_path"], "audio_sha256")


@query(
    """
WITH o AS (SELECT DISTINCT unnest(badges) AS name FROM records WHERE visibility = 'public_indexed'),
w AS (SELECT DISTINCT record_id, badges FROM records),
e AS (SELECT record_id, unnest(badges) AS name, unnest(range(len(badges))) AS position FROM w),
m AS (SELECT record_id, arg_min(e.name, position) AS chosen, min(position)::INTEGER AS position FROM e JOIN o USING (name) GROUP BY 1)
SELECT r.record_id, chosen, position FROM (SELECT DISTINCT record_id FROM records) r LEFT JOIN m USING (record_id)
"""
)
def resolved_badges(spark: SparkSession, d: str) -> DataFrame:
    """The first of a record's badges that any indexed record carries."""
    r = table(spark, d, "records").select("record_id", "badges", "visibility").distinct()
    offered = r.where("visibility = 'public_indexed'").select(F.explode("badges").alias("name"))
    return relations.resolve_in_order(r.select("record_id", "badges").distinct(), "record_id", "badges", offered)


@query(
    """
SELECT record_id, epoch_us(updated_at) AS updated_us,
  greatest(0, least(100, round_even(((0.0::DOUBLE + ((list_position(['high', 'medium', 'low'], risk_level) - 1)::DOUBLE / 2) * 2)
    + ((list_position(['private', 'public_unlisted', 'public_indexed'], visibility) - 1)::DOUBLE / 2) * 1) * 100 / 3, 0)))::INTEGER AS score
FROM (SELECT DISTINCT record_id, updated_at, risk_level, visibility FROM records) WHERE risk_level IS NOT NULL
"""
)
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    """A weighted score of ordered enums, rounded half to even."""
    r = table(spark, d, "records").where("risk_level is not null").select("record_id", "updated_at", "risk_level", "visibility").distinct()
    levels = {"risk_level": ["high", "medium", "low"], "visibility": ["private", "public_unlisted", "public_indexed"]}
    return r.select("record_id", F.unix_micros("updated_at").alias("updated_us"), relations.weighted_score(levels, {"risk_level": 2, "visibility": 1}).alias("score"))


@query(
    """
SELECT atom_id, coalesce(array_to_string(list_filter([
    CASE WHEN NOT coalesce(regexp_matches(atom_id, '^atom_[0-9a-f]+$'), false) THEN 'atom_id' END,
    CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence' END,
    CASE WHEN NOT coalesce(language IN ('en', 'fr', 'de', 'es', 'zh', 'pt', 'it', 'nl'), false) THEN 'language' END,
    CASE WHEN NOT coalesce(length(text) BETWEEN 1 AND 4096, false) THEN 'text' END], lambda x: x IS NOT NULL), ','), '') AS failed, count(*) AS n
FROM atoms GROUP BY ALL
"""
)
def atom_checks(spark: SparkSession, d: str) -> DataFrame:
    """The schema predicates that every delivered atom fails."""
    checks = {
        "atom_id": F.col("atom_id").rlike("^atom_[0-9a-f]+$"),
        "confidence": F.col("confidence").between(0, 1),
        "language": F.col("language").isin("en", "fr", "de", "es", "zh", "pt", "it", "nl"),
        "text": F.length("text").between(1, 4096),
    }
    failed = F.array_join(relations.failed_checks(checks), ",").alias("failed")
    return table(spark, d, "atoms").select("atom_id", failed).groupBy("atom_id", "failed").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT record_id, array_to_string(list_filter(badges, lambda k: k NOT IN ('verified-consent', 'public-data-only') AND NOT starts_with(k, 'x-')), ',') AS unknown, count(*) AS n
FROM records GROUP BY ALL
"""
)
def unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    """Badges beyond a core set and its extensions."""
    unknown = F.array_join(relations.known_or_extension(F.col("badges"), ["verified-consent", "public-data-only"]), ",")
    return table(spark, d, "records").select("record_id", unknown.alias("unknown")).groupBy("record_id", "unknown").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""
WITH t AS (SELECT DISTINCT event_id, event_time AS created, replace(event_time, '2024-', '2025-') AS expires FROM audit_events),
p AS (SELECT *, try_cast(created AS TIMESTAMPTZ) AS s, try_cast(expires AS TIMESTAMPTZ) AS e, TIMESTAMPTZ '2025-03-01 00:00:00+00' AS now FROM t)
SELECT event_id, CASE WHEN s IS NULL THEN 'created_unparseable' WHEN e IS NULL THEN 'expires_unparseable' WHEN s > now + INTERVAL 30 SECOND THEN 'created_in_future' WHEN e <= now THEN 'expired' WHEN e <= s THEN 'expires_before_created' END AS problem FROM p
"""
)
def validity_periods(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with periods that begin at the events' times, as of a fixed moment."""
    t = table(spark, d, "audit_events").select("event_id", "event_time").distinct()
    expires = F.replace("event_time", F.lit("2024-"), F.lit("2025-"))
    return t.select("event_id", relations.time_bounds(F.col("event_time"), expires, F.to_timestamp(F.lit("2025-03-01T00:00:00Z"))).alias("problem"))


@query(
    """
WITH w AS (SELECT DISTINCT lang FROM lang_samples), i AS (SELECT DISTINCT record_id FROM documents WHERE record_id IS NOT NULL)
SELECT i.record_id, w.lang FROM i, w WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.record_id = i.record_id AND d.lang = w.lang)
"""
)
def missing_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages in which a record has no document labelled so."""
    docs = table(spark, d, "documents").where("record_id is not null").select("record_id", "lang").distinct()
    return relations.coverage(docs, table(spark, d, "lang_samples"), docs, "record_id", "lang")


@query(
    """
WITH f(backend, weight) AS (VALUES ('faster-whisper', 2.0::DOUBLE), ('dummy', 0.5))
SELECT transcript_id, coalesce(f.weight, 0.5) AS weight FROM transcripts t LEFT JOIN f ON f.backend = t.backend
"""
)
def joined_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A small table joined with a default row for unknown keys."""
    f = spark.createDataFrame([("faster-whisper", 2.0), ("dummy", 0.5)], "backend string, weight double")
    return relations.priced(table(spark, d, "transcripts").select("transcript_id", "backend"), f, "backend", "dummy").select("transcript_id", "weight")


@query(
    """
SELECT record_id, event_id, rank FROM (
  SELECT record_id, event_id, row_number() OVER (PARTITION BY record_id ORDER BY event_time DESC, event_id)::INTEGER AS rank
  FROM (SELECT DISTINCT record_id, event_id, event_time FROM audit_events)) WHERE rank <= 3
"""
)
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    """The three latest events of every record."""
    e = table(spark, d, "audit_events").select("record_id", "event_id", "event_time").distinct()
    return relations.top_k(e, ["record_id"], [F.desc("event_time"), F.col("event_id")], 3).drop("event_time")


@query(
    """
SELECT item_id, rule_name, n FROM (
  SELECT d.item_id, d.rule_name, count(*) AS n FROM moderation_flags d WHERE d.item_kind = 'document' GROUP BY ALL)
WHERE item_id NOT IN (SELECT item_id FROM moderation_labels WHERE item_kind = 'document')
"""
)
def unreviewed_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flagged documents without a review."""
    labels = table(spark, d, "moderation_labels").where("item_kind = 'document'").select("item_id").distinct()
    flags = table(spark, d, "moderation_flags").where("item_kind = 'document'")
    return flags.join(labels, "item_id", "left_anti").groupBy("item_id", "rule_name").agg(F.count(F.lit(1)).alias("n"))


# ---- streaming -----------------------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return watch.read_events(spark, f"{d}/events.parquet*", schema)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, as a stream over the log."""
    counts = watch.windowed_counts(_event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return watch.drain(counts, "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100 AND user_id IS NOT NULL)")
def stream_not_revoked(spark: SparkSession, d: str) -> DataFrame:
    """Events of users without a large error, as a stream against a static table."""
    revoked = table(spark, d, "events").where("event_type = 'error' and value > 100").select("user_id")
    return watch.drain(watch.not_revoked(_event_stream(spark, d), revoked, "user_id").select("event_id", "user_id"), "append")
