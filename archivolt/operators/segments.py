"""Cutting texts into paragraphs, atoms and overlapping chunks, and joining segments into transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.text import let, redact, sha256, strip

ATOM_CAP = 4096


def transcript_text(segments: DataFrame, key: str = "transcript_id", order: str = "seg_index") -> DataFrame:
    """(key, text): the segments of a transcript in order, joined by line feeds, null as empty; then stripped.

    Repeated segments of one place count once (the greatest text). A transcript is one row and so must fit a row.
    """
    one = segments.groupBy(key, order).agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return one.groupBy(key).agg(strip(F.array_join(F.transform(parts, lambda s: s["text"]), "\n")).alias("text"))


def paragraphs(df: DataFrame, text: str = "text", pattern: str = r"\n\n") -> DataFrame:
    """All columns but the text, plus (para, text): non-empty stripped paragraphs, numbered from 0."""
    found = F.filter(F.transform(F.split(F.col(text), pattern), strip), lambda p: p != "")
    # the outer form, as the optimizer would otherwise test the array for emptiness by computing it once more
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode_outer(found).alias("para", "text")).where("text is not null")


def paragraph_atoms(df: DataFrame, text: str = "text", redacted: bool = True, cap: int = ATOM_CAP) -> DataFrame:
    """Paragraph atoms: split at empty lines, cut at ``cap`` characters, redacted again by default.

    Adds (para, text, is_cut, confidence, sensitivity, erasable, atom_id), the id derived from the content.
    """
    body = df.withColumn(text, redact(F.col(text))) if redacted else df
    atoms = paragraphs(body, text, r"\n\s*\n+")
    capped = atoms.withColumn("text", F.left("text", F.lit(cap)))
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in capped.columns])
    with_flag = atoms.withColumn("is_cut", F.length("text") > cap).withColumn("text", F.left("text", F.lit(cap)))
    return with_flag.select(
        "*",
        F.lit(0.6).alias("confidence"),
        F.lit("S2_SENSITIVE").alias("sensitivity"),
        F.lit(True).alias("erasable"),
        F.concat(F.lit("atom_"), F.left(F.sha2(key, 256), F.lit(12))).alias("atom_id"),
    )


#: where a sentence may end: marks with white space behind, wide marks, line breaks
SENTENCE_END = r"(?<=[.!?])\s+|(?<=[。！？])|\s*\n\s*"


def sentence_atoms(df: DataFrame, text: str = "text", cap: int = ATOM_CAP) -> DataFrame:
    """Sentence atoms by punctuation: all columns but the text, plus (sentence, text, confidence, is_cut), numbered from 0.

    A rule-based stand-in for a model: abbreviations end sentences too. Text beyond ``cap`` characters is cut, as is told.
    """
    found = F.filter(F.transform(F.split(F.col(text), SENTENCE_END, -1), strip), lambda p: p != "")
    kept = [c for c in df.columns if c != text]
    each = df.select(*kept, F.posexplode_outer(found).alias("sentence", "text")).where("text is not null")
    return each.select(*kept, "sentence", F.left("text", F.lit(cap)).alias("text"), F.lit(0.7).alias("confidence"), (F.length("text") > cap).alias("is_cut"))


def _paragraph_places(text: Column) -> Column:
    """array<struct<text, start>> of stripped, non-empty paragraphs with their offsets."""
    pieces = F.split(text, r"\n\s*\n", -1)
    gaps = F.concat(F.transform(F.regexp_extract_all(text, F.lit(r"\n\s*\n"), F.lit(0)), lambda g: F.length(g)), F.array(F.lit(0)))
    # offsets by a running sum over the lengths of the pieces and of what parts them
    sums = F.aggregate(
        F.zip_with(pieces, gaps, lambda p, g: F.length(p) + F.coalesce(g, F.lit(0))),
        F.array(F.lit(0)),
        lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)),
    )
    lead = lambda p: F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))
    places = lambda at: F.transform(pieces, lambda p, i: F.struct(strip(p).alias("text"), (F.get(at, i) + lead(p)).alias("start")))
    return F.filter(let(sums, places), lambda p: p["text"] != "")


def chunks(df: DataFrame, text: str = "text", max_chars: int = 600, overlap: int = 80) -> DataFrame:
    """Windows of ``max_chars`` over every paragraph, each starting ``max_chars - overlap`` after the one before.

    Adds (chunk_id, text, char_start, char_end, text_sha256), numbered over the whole document from 0.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and below max_chars")
    stride = max_chars - overlap

    def windows(p: Column) -> Column:
        size = F.length(p["text"])
        last = F.greatest(F.lit(0), F.ceil((size - max_chars) / stride)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                F.substring(p["text"], i * stride + 1, F.lit(max_chars)).alias("text"),
                (p["start"] + i * stride).alias("char_start"),
                (p["start"] + F.least(i * stride + max_chars, size)).alias("char_end"),
            ),
        )

    all_windows = F.flatten(F.transform(_paragraph_places(F.col(text)), windows))
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode_outer(all_windows).alias("chunk_id", "c")).where("c is not null").select(
        *kept, "chunk_id", "c.text", "c.char_start", "c.char_end", sha256(F.col("c.text")).alias("text_sha256")
    )
