"""Queries of problem 4: the trees of the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import hierarchy as h
from archivolt.runtime import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return h.parent_links(table(spark, d, "audit_events"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every event; events on a circle or below one as ('cycle', -1)."""
    return h.build_hierarchy(_links(spark, d)).select(
        F.col("node").alias("event_id"),
        F.when(F.col("cyclic"), F.lit("cycle")).otherwise(F.col("root")).alias("root_event_id"),
        F.when(F.col("cyclic"), F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("depth"),
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Path, number of children and descendants, and height below, of every event that a root reaches."""
    tree = h.build_hierarchy(_links(spark, d), with_paths=True)
    return h.descendant_counts(tree).select(
        F.col("node").alias("event_id"), F.array_join("path", "/").alias("path"), "n_children", "n_descendants", "height"
    )


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of every event that a root reaches, with its distance."""
    pairs = h.ancestor_pairs(h.build_hierarchy(_links(spark, d), with_paths=True))
    return pairs.select("ancestor", "descendant", F.col("distance").cast("int").alias("distance"))


def p4_circles(spark: SparkSession, d: str) -> DataFrame:
    """The events that no root reaches, told apart by whether they lie on the circle or below it."""
    links = _links(spark, d)
    return h.circles(links, h.build_hierarchy(links)).select(F.col("node").alias("event_id"), "on_circle")


QUERIES = {"p4_found": p4_found, "p4_descendants": p4_descendants, "p4_pairs": p4_pairs, "p4_circles": p4_circles}

_NODES = r"""
first AS (
  SELECT event_id, arg_min(record_id, ingested_at) AS record_id, arg_min(hash, ingested_at) AS hash,
         arg_min(prev_hash, ingested_at) AS prev_hash
  FROM audit_events GROUP BY event_id),
hexed AS (
  SELECT event_id, record_id,
    nullif(regexp_extract(regexp_replace(lower(hash), '[\s\x{00a0}\x{3000}]+', '', 'g'), '^(?:sha-?256)?[:=]?([0-9a-f]{64})$', 1), '') AS own,
    nullif(regexp_extract(regexp_replace(lower(prev_hash), '[\s\x{00a0}\x{3000}]+', '', 'g'), '^(?:sha-?256)?[:=]?([0-9a-f]{64})$', 1), '') AS prev
  FROM first),
owners AS (SELECT record_id, own, min(event_id) AS parent FROM hexed WHERE own IS NOT NULL GROUP BY ALL),
links AS (
  SELECT h.event_id AS node, o.parent FROM hexed h LEFT JOIN owners o ON o.record_id = h.record_id AND o.own = h.prev)
"""

ORACLES = {
    "p4_found": f"""
WITH RECURSIVE {_NODES},
tree AS (
  SELECT node, node AS root, 0 AS depth FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.node, t.root, t.depth + 1 FROM tree t JOIN links l ON l.parent = t.node)
SELECT l.node AS event_id, coalesce(t.root, 'cycle') AS root_event_id, coalesce(t.depth, -1)::INTEGER AS depth
FROM links l LEFT JOIN tree t ON t.node = l.node
""",
    "p4_descendants": f"""
WITH RECURSIVE {_NODES},
tree AS (
  SELECT node, node AS path, 0 AS depth FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.node, t.path || '/' || l.node, t.depth + 1 FROM tree t JOIN links l ON l.parent = t.node),
pairs AS (
  SELECT a.anc AS ancestor, t.depth + 1 - a.pos AS distance
  FROM tree t, LATERAL (SELECT unnest(string_split(t.path, '/')) AS anc, unnest(range(1, t.depth + 2)) AS pos) a),
below AS (
  SELECT ancestor, count(*) FILTER (distance = 1) AS n_children, count(*) AS n_descendants, max(distance) AS height
  FROM pairs WHERE distance > 0 GROUP BY ancestor)
SELECT t.node AS event_id, t.path, coalesce(n_children, 0)::BIGINT AS n_children,
       coalesce(n_descendants, 0)::BIGINT AS n_descendants, coalesce(height, 0)::INTEGER AS height
FROM tree t LEFT JOIN below b ON b.ancestor = t.node
""",
    "p4_pairs": f"""
WITH RECURSIVE {_NODES},
pairs AS (
  SELECT l.parent AS ancestor, l.node AS descendant, 1 AS distance FROM links l JOIN (
    WITH RECURSIVE tree AS (
      SELECT node FROM links WHERE parent IS NULL
      UNION ALL SELECT k.node FROM tree t JOIN links k ON k.parent = t.node)
    SELECT node FROM tree) r ON r.node = l.node
  WHERE l.parent IS NOT NULL
  UNION ALL SELECT p.ancestor, l.node, p.distance + 1 FROM pairs p JOIN links l ON l.parent = p.descendant)
SELECT ancestor, descendant, distance::INTEGER AS distance FROM pairs
""",
    "p4_circles": f"""
WITH RECURSIVE {_NODES},
tree AS (
  SELECT node FROM links WHERE parent IS NULL
  UNION ALL SELECT l.node FROM tree t JOIN links l ON l.parent = t.node),
lost AS (SELECT node, parent FROM links WHERE node NOT IN (SELECT node FROM tree)),
walk AS (
  SELECT node AS origin, parent AS at, 1 AS n FROM lost
  UNION
  SELECT w.origin, l.parent, w.n + 1 FROM walk w JOIN lost l ON l.node = w.at WHERE w.at <> w.origin AND w.n < 400)
SELECT l.node AS event_id, coalesce(bool_or(w.at = w.origin), false) AS on_circle
FROM lost l LEFT JOIN walk w ON w.origin = l.node GROUP BY l.node
""",
}
