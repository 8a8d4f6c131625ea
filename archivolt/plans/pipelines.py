"""Whole pipelines as functions from tables to tables, by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions.text import join_redacted, normalise, redaction_matches, redaction_pieces, redaction_spans, rule_of, sha256
from archivolt.operators import graph, moderation, segments
from archivolt.operators.vectors import hash_embedding


@dataclass(frozen=True)
class Pipeline:
    """A named pipeline: what it takes and gives, and how it runs."""

    name: str
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]
    run: Callable[..., DataFrame]


def text(df: DataFrame, mode: str = "both") -> DataFrame:
    """Clean text with the spans of the placeholders and a digest; needs (doc_id, text)."""
    if mode not in ("normalize", "redact", "both"):
        raise ValueError(mode)
    body = df.select("doc_id", "text") if mode == "redact" else df.select("doc_id", normalise(F.col("text")).alias("text"))
    if mode == "normalize":
        out = body.withColumn("spans", F.array().cast("array<struct<kind:string,start:int,end:int,replacement:string>>"))
    else:
        # the text is matched twice, for the pieces and for the matches; all else works on these
        found = body.select("doc_id", redaction_pieces(F.col("text")).alias("p"), F.transform(redaction_matches(F.col("text")), rule_of).alias("k"))
        out = found.select("doc_id", join_redacted(F.col("p"), F.col("k")).alias("text"), redaction_spans(F.col("p"), F.col("k")).alias("spans"))
    return out.withColumn("text_sha256", sha256(F.col("text")))


def vectorization(df: DataFrame, max_chars: int = 600, overlap: int = 80) -> DataFrame:
    """Chunks of (doc_id, text) with hash embeddings."""
    cut = segments.chunks(df.select("doc_id", "text"), max_chars=max_chars, overlap=overlap)
    key = F.concat_ws("#", "doc_id", "chunk_id")
    return cut.withColumn("embedding", hash_embedding(key, F.col("text")))


def memory_atoms(df: DataFrame) -> DataFrame:
    """Redacted paragraph atoms of (doc_id, text)."""
    return segments.paragraph_atoms(df.select("doc_id", "text"))


def knowledge_graph(df: DataFrame, min_mentions: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of (doc_id, text), every line a unit."""
    units = segments.paragraphs(df.select("doc_id", "text"), pattern=r"\n")
    found = graph.mentions(units, "doc_id", ["para"], min_mentions=min_mentions)
    return graph.nodes(found, "doc_id", ["para"]), graph.edges(found, "doc_id", ["para"])


def moderate(df: DataFrame, rules: Sequence[moderation.Rule]) -> DataFrame:
    """Outcome of every row of (doc_id, text)."""
    return moderation.judge(df.select("doc_id", "text"), rules)


REGISTRY = {
    p.name: p
    for p in (
        Pipeline("text", ("documents",), ("clean_text",), text),
        Pipeline("vectorization", ("documents",), ("chunks", "embeddings"), vectorization),
        Pipeline("moderation", ("documents", "policy_rules"), ("outcomes",), moderate),
        Pipeline("memory_atoms", ("documents",), ("atoms",), memory_atoms),
        Pipeline("knowledge_graph", ("documents",), ("nodes", "edges"), knowledge_graph),
    )
}
