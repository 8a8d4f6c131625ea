"""The pN_ queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import abuse, language, mixing, packing, pii, spans, splitting
from archivolt.llm.tokens import token_count_sql
from archivolt.runtime import table


def _item(df: DataFrame, kind: str, item_id: str, **columns: str) -> DataFrame:
    return df.select(
        F.lit(kind).alias("item_kind"), F.col(item_id).cast("string").alias("item_id"), *[F.col(c).alias(n) for n, c in columns.items()]
    )


def _private_texts(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segments", busy=True).select(
        F.lit("segment").alias("item_kind"), F.concat_ws("#", "transcript_id", "seg_index").alias("item_id"), "text"
    )
    return _item(table(spark, d, "atoms", busy=True), "atom", "atom_id", text="text").unionByName(segments)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Type and place of every personal datum in atoms and segments."""
    texts = _private_texts(spark, d)
    return pii.find_all(texts, pii.learn_names(texts)).select("item_kind", "item_id", "pii_type", "span_start").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Atoms and segments with placeholders for their personal data, one row per item and text."""
    texts = _private_texts(spark, d)
    return pii.redact_all(texts, pii.learn_names(texts)).distinct()


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs = _item(table(spark, d, "documents", busy=True), "document", "doc_id", source="source", text="text")
    atoms = _item(table(spark, d, "atoms", busy=True), "atom", "atom_id", text="text").withColumn("source", F.lit(None).cast("string"))
    texts = docs.unionByName(atoms)
    return abuse.score(texts, abuse.fit_labels(texts, table(spark, d, "moderation_labels")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The categories of abusive content in documents and atoms."""
    return abuse.found_categories(_scores(spark, d))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of abusive content by source of the documents."""
    return abuse.source_rates(_scores(spark, d))


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    texts = (
        _item(table(spark, d, "documents", busy=True), "document", "doc_id", text="text")
        .unionByName(_item(table(spark, d, "atoms", busy=True), "atom", "atom_id", text="text"))
        .unionByName(_item(table(spark, d, "segments", busy=True), "transcript", "transcript_id", text="text"))
    )
    return language.stretches(texts, language.fit_samples(table(spark, d, "lang_samples")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose language label is missing or wrong, or that mix languages."""
    labels = (
        _item(table(spark, d, "documents"), "document", "doc_id", label="lang")
        .unionByName(_item(table(spark, d, "atoms"), "atom", "atom_id", label="language"))
        .unionByName(_item(table(spark, d, "transcripts"), "transcript", "transcript_id", label="language"))
    )
    return language.wrong_labels(language.item_languages(_stretches(spark, d)), labels)


def p3_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language with its confidence; offsets of transcripts are within a segment."""
    return _stretches(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that had to be split, from their pieces."""
    pieces = splitting.split_chunks(table(spark, d, "chunks"), table(spark, d, "documents", busy=True))
    return pieces.where("piece = 0").select("doc_id", "chunk_id", "forced")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized chunks, with their places in the documents."""
    return splitting.split_chunks(table(spark, d, "chunks"), table(spark, d, "documents", busy=True))


def p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of every oversized chunk cover of its document, and the rules they break, which must be none."""
    documents = table(spark, d, "documents", busy=True)
    return splitting.coverage(splitting.split_chunks(table(spark, d, "chunks"), documents), documents)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that had to be split, from the packing."""
    packed = packing.pack(table(spark, d, "documents", busy=True))
    return packed.where("is_split").select("doc_id").distinct()


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers and how full they are."""
    return packing.fill_report(packing.pack(table(spark, d, "documents", busy=True)))


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, documents and split documents of the packing, counted from its containers, and how many are over full."""
    packed = packing.pack(table(spark, d, "documents", busy=True))
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    over = per.agg(F.count_if(F.col("n") > 1024).alias("n_over_full"))
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("is_split").alias("split"))
    sizes = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.count_if("split").alias("n_split"))
    both = sizes.withColumn("one", F.lit(1)).join(over.withColumn("one", F.lit(1)), "one")
    return both.select("n_docs", "n_tokens", "n_split", "n_over_full")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources that cannot reach their share, from the report of the mix."""
    _, report = mixing.mix(table(spark, d, "documents", busy=True), table(spark, d, "mix_targets"))
    return report.where("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    _, report = mixing.mix(table(spark, d, "documents", busy=True), table(spark, d, "mix_targets"))
    return report


def p7_quotas(spark: SparkSession, d: str) -> DataFrame:
    """What every source has and what it is to give, in blocks of 1,024 tokens."""
    _, report = mixing.mix(table(spark, d, "documents", busy=True), table(spark, d, "mix_targets"))
    return report.select("source", "tokens", "blocks", "slots", "passes", "short")


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and most passes over any document, by source, counted from the mixed set itself."""
    mixed, _ = mixing.mix(table(spark, d, "documents", busy=True), table(spark, d, "mix_targets"))
    return mixed.groupBy("out_shard", "source").agg(
        F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.countDistinct("doc_id").alias("n_docs")
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of documents that share at least 200 characters in a row."""
    return spans.shared_pairs(table(spark, d, "documents", busy=True))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The shared stretches themselves, between one document of every text."""
    return spans.shared_stretches(table(spark, d, "documents", busy=True))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document stands word for word in others."""
    return spans.shared_report(table(spark, d, "documents", busy=True))


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_stretches": p3_stretches,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_cover": p5_cover,
    "p6_found": p6_found,
    "p6_fill": p6_fill,
    "p6_sizes": p6_sizes,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_quotas": p7_quotas,
    "p7_sizes": p7_sizes,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_report": p8_report,
}

ORACLES = {
    "p5_found": r"""
WITH full_text AS (
  SELECT DISTINCT c.doc_id, c.chunk_id, coalesce(c.text, substring(d.text, (c.char_start + 1)::BIGINT, (c.char_end - c.char_start)::BIGINT)) AS text
  FROM chunks c LEFT JOIN documents d USING (doc_id)),
big AS (SELECT * FROM full_text WHERE length(text) > 600)
SELECT doc_id, chunk_id,
  (list_max(list_transform(regexp_split_to_array(text, '[\s\x{00A0}\x{3000}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\v.!?;。！？；]'), lambda x: length(x))) > 600)::INTEGER AS forced
FROM big
""",
    "p5_cover": r"""
WITH full_text AS (
  SELECT DISTINCT c.doc_id, c.chunk_id, c.char_start, d.text AS doc_text,
         coalesce(c.text, substring(d.text, (c.char_start + 1)::BIGINT, (c.char_end - c.char_start)::BIGINT)) AS text
  FROM chunks c LEFT JOIN documents d USING (doc_id)),
big AS (
  SELECT doc_id, chunk_id, any_value(text) AS text, coalesce(max(char_start), any_value(strpos(doc_text, text) - 1))::INTEGER AS char_start
  FROM full_text WHERE length(text) > 600 GROUP BY doc_id, chunk_id)
SELECT doc_id, chunk_id, char_start, (char_start + length(text))::INTEGER AS char_end,
       0::BIGINT AS too_long, 0::BIGINT AS gaps, 0::BIGINT AS wide_overlaps, 0::BIGINT AS wrong_texts
FROM big
""",
    "p6_sizes": f"""
WITH d AS (SELECT doc_id, {token_count_sql('text')} AS n FROM documents)
SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, count(*) FILTER (n > 1024) AS n_split, 0::BIGINT AS n_over_full FROM d
""",
    "p6_found": f"SELECT DISTINCT doc_id FROM documents WHERE {token_count_sql('text')} > 1024",
    "p7_found": rf"""
WITH sized AS (
  SELECT lower(regexp_replace(source, '^[\t\n\r \x{{00A0}}\x{{3000}}]+|[\t\n\r \x{{00A0}}\x{{3000}}]+$', '', 'g')) AS key,
         sum({token_count_sql('text')}) AS n
  FROM documents GROUP BY 1),
t AS (
  SELECT m.source, m.target_share, m.max_repeats, coalesce(s.n, 0) AS n
  FROM mix_targets m LEFT JOIN sized s ON s.key = lower(trim(m.source)))
SELECT source FROM t WHERE max_repeats * n < target_share * (SELECT sum(n) FROM t)
""",
    "p7_quotas": rf"""
WITH sized AS (
  SELECT lower(regexp_replace(source, '^[\t\n\r \x{{00A0}}\x{{3000}}]+|[\t\n\r \x{{00A0}}\x{{3000}}]+$', '', 'g')) AS key,
         sum({token_count_sql('text')}) AS n
  FROM documents GROUP BY 1),
t AS (
  SELECT m.source, m.target_share, m.max_repeats, coalesce(s.n, 0)::BIGINT AS tokens, (coalesce(s.n, 0)::BIGINT + 1023) // 1024 AS blocks,
         ((coalesce(s.n, 0)::BIGINT + 1023) // 1024) * m.max_repeats AS cap
  FROM mix_targets m LEFT JOIN sized s ON s.key = lower(trim(m.source))),
want AS (SELECT (sum(tokens)::BIGINT + 1023) // 1024 AS n, sum(tokens) AS all_tokens FROM t),
-- sources by how soon they are full; the level is the blocks per share that those not yet full give
o AS (
  SELECT *, cap / target_share AS full_at,
         (SELECT n FROM want) - coalesce(sum(cap) OVER w, 0) AS rest, 1.0 - coalesce(sum(target_share) OVER w, 0) AS weight
  FROM t WINDOW w AS (ORDER BY cap / target_share, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest / weight AS l FROM o WHERE rest / weight <= full_at ORDER BY full_at, source LIMIT 1),
g AS (SELECT *, CASE WHEN full_at <= l THEN cap ELSE l * target_share END AS given FROM o, level),
f AS (SELECT *, floor(given + 1e-9)::BIGINT AS low FROM g),
r AS (SELECT *, row_number() OVER (ORDER BY (low >= cap)::INTEGER, low - given, source) AS k,
             (SELECT least((SELECT n FROM want), sum(cap)) - sum(low) FROM f) AS spare FROM f),
s AS (SELECT *, low + (k <= spare AND low < cap)::INTEGER AS slots FROM r)
SELECT source, tokens, blocks, slots::BIGINT AS slots, CASE WHEN blocks = 0 THEN 0 ELSE (slots + blocks - 1) // blocks END::BIGINT AS passes,
       max_repeats * tokens < target_share * (SELECT all_tokens FROM want) AS short
FROM s
""",
    "p8_found": """
WITH w AS (
  SELECT DISTINCT doc_id, hash(substring(text, i, 200)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
many AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT w.* FROM w JOIN many USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id
""",
    "p8_spans": """
WITH one AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL GROUP BY text),
w AS (
  SELECT doc_id, i - 1 AS i, hash(substring(text, i, 200)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM one)),
many AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT w.* FROM w JOIN many USING (h)),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, a.i, b.i - a.i AS diagonal FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY x, y, diagonal ORDER BY i) AS run FROM met)
SELECT x AS doc_id_a, y AS doc_id_b, min(i)::INTEGER AS start_a, (min(i) + diagonal)::INTEGER AS start_b, (count(*) + 199)::INTEGER AS length
FROM runs GROUP BY x, y, diagonal, run
""",
    "p8_report": """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL),
w AS (
  SELECT doc_id, i - 1 AS i, hash(substring(text, i, 200)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d)),
many AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN many USING (h)),
per AS (
  SELECT doc_id, count(*) FILTER (before IS NULL OR i > before + 200) AS n_spans,
         sum(CASE WHEN before IS NULL OR i > before + 200 THEN 200 ELSE i - before END) AS shared_chars
  FROM m GROUP BY doc_id),
classes AS (SELECT text, min(doc_id) AS class_id FROM d GROUP BY text)
SELECT d.doc_id, class_id, length(d.text) AS n_chars, n_spans, shared_chars::BIGINT AS shared_chars,
       shared_chars::DOUBLE / length(d.text) AS shared_fraction
FROM per JOIN d USING (doc_id) JOIN classes USING (text)
""",
}
