"""Column functions on text: normalisation, redaction, paragraphs, slugs, URIs. All of them run inside the JVM except the
Unicode compatibility step, which is only called for text that is not ASCII."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: rule names, patterns and placeholders, in order of precedence
REDACTION_RULES = (
    ("url_with_credentials", r"\b[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/@]+:[^\s/@]+@[^\s]+", "<URL_WITH_CREDENTIALS>"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    ("id_cn", r"(?<!\d)\d{17}[\dXx](?!\d)", "<ID_CN>"),
    ("phone_cn", r"(?<!\d)1[3-9]\d{9}(?!\d)", "<PHONE_CN>"),
    (
        "ipv4",
        r"(?<!\d)(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?!\d)",
        "<IPV4>",
    ),
    ("credit_card_like", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", "<CARD>"),
    ("phone_generic", r"(?<!\d)\+?\d[\d \-().]{6,18}\d(?!\d)", "<PHONE>"),
)
HORIZONTAL_SPACE = r"[ \t  -   　]+"
#: white space as Python's str.strip understands it
STRIP = r"[\s\u001c-\u001f\u0085   -     　]+"
#: one alternation: the leftmost match wins, and of those that start together the earlier rule. The runs before "://" and
#: "@" cannot hold what follows them, so they are matched without backtracking.
_ANY_RULE = "(?U)" + "|".join(f"(?:{p.replace('*://', '*+://').replace(']+@[A-Z', ']++@[A-Z')})" for _, p, _ in REDACTION_RULES)


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves decomposed letters apart, so the standard library does it; most texts are normal already
    return pa.array([t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], type=pa.string())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"^{STRIP}|{STRIP}$", "")


def normalise(text: Column, compatibility: bool = True) -> Column:
    """NFKC, zero-width characters deleted, line ends unified, blanks collapsed, at most one empty line, stripped."""
    out = F.when(text.rlike(r"[^\x00-\x7f]"), _nfkc(text)).otherwise(text) if compatibility else text
    out = F.regexp_replace(out, r"[​-‍﻿]", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, HORIZONTAL_SPACE, " ")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def redaction_matches(text: Column) -> Column:
    """The matches of all rules from left to right, none overlapping: array<string>."""
    return F.regexp_extract_all(text, F.lit(_ANY_RULE), F.lit(0))


def rule_of(match: Column) -> Column:
    """The name of the rule that made a match: the first that fits it as a whole (the word boundary before it lies outside)."""
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(REDACTION_RULES):
        own = pattern.removeprefix(r"\b")
        out = F.when(match.rlike(f"(?U)^(?:{own})$"), F.lit(name)).otherwise(out)
    return out


def placeholder_of(rule: Column) -> Column:
    """The placeholder of a rule name."""
    out = F.lit(None).cast("string")
    for name, _, mark in reversed(REDACTION_RULES):
        out = F.when(rule == name, F.lit(mark)).otherwise(out)
    return out


def redaction_pieces(text: Column) -> Column:
    """What stands before, between and after the matches: array<string>, one more than the matches."""
    return F.split(text, _ANY_RULE, -1)


def redact(text: Column) -> Column:
    """Text with every match replaced by its placeholder."""
    return join_redacted(redaction_pieces(text), F.transform(redaction_matches(text), rule_of))


def join_redacted(pieces: Column, kinds: Column) -> Column:
    """The redacted text from its pieces and the rules of its matches."""
    marks = F.concat(F.transform(kinds, placeholder_of), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, m)), "")


def redaction_spans(pieces: Column, kinds: Column) -> Column:
    """array<struct<kind, start, end, replacement>>: places of the placeholders in the redacted text, never what they hide."""
    lengths = F.transform(pieces, lambda p: F.length(p))

    def span(lengths: Column, kinds: Column, kind: Column, i: Column) -> Column:
        mark = placeholder_of(kind)
        before = F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, n: a + n) + F.aggregate(
            F.slice(kinds, F.lit(1), i), F.lit(0), lambda a, k: a + F.length(placeholder_of(k))
        )
        return F.struct(kind.alias("kind"), before.alias("start"), (before + F.length(mark)).alias("end"), mark.alias("replacement"))

    return let(lengths, lambda n: F.transform(kinds, lambda k, i: span(n, kinds, k, i)))


def clean(text: Column, mode: str = "both") -> Column:
    """``normalize``, ``redact`` or ``both``."""
    if mode not in ("normalize", "redact", "both"):
        raise ValueError(mode)
    out = text if mode == "redact" else normalise(text)
    return out if mode == "normalize" else redact(out)


def with_final_newline(text: Column) -> Column:
    """Text that ends in a line feed."""
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def slug(name: Column) -> Column:
    """Lower case, blanks and underscores as hyphens."""
    return F.translate(F.lower(name), " _", "--")


def uri_scheme(uri: Column, default: str = "obj") -> Column:
    """What stands before ``://``, else the default."""
    return F.when(F.contains(uri, F.lit("://")), F.substring_index(uri, "://", 1)).otherwise(F.lit(default))


def uri_parts(uri: Column) -> Column:
    """struct<scheme, bucket, key>; null unless all three are there."""
    part = lambda i: F.nullif(F.regexp_extract(uri, r"^([a-z][a-z0-9+.-]*)://([^/]+)/(.+)$", i), F.lit(""))
    return F.when(part(3).isNotNull(), F.struct(part(1).alias("scheme"), part(2).alias("bucket"), part(3).alias("key")))


def safe_member(name: Column) -> Column:
    """Whether an archive member's name is safe: not empty, relative, no backslash, no empty or dotted segment."""
    bad = F.arrays_overlap(F.split(name, "/"), F.array(F.lit(""), F.lit("."), F.lit("..")))
    return F.coalesce((name != "") & ~F.contains(name, F.lit("\\")) & ~bad, F.lit(False))


def bare_sha256(digest: Column) -> Column:
    """A digest without its ``sha256:`` prefix."""
    return F.regexp_replace(digest, "^sha256:", "")


def sha256(text: Column) -> Column:
    """``sha256:`` and the hex digest of the UTF-8 text."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def html_escape(text: Column) -> Column:
    """The five characters of HTML as entities."""
    out = text
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def stem(path: Column) -> Column:
    """File name without its single or known double suffix."""
    name = F.regexp_replace(path, "^.*/", "")
    return F.regexp_replace(name, r"(?:\.clean\.txt|\.transcript\.json|\.atoms\.jsonl|\.[^.]+)$", "")


def audit_line(ref: Column) -> Column:
    """Line number of ``audit/events.jsonl#L<n>``, n at least 1, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(ref, r"^audit/events\.jsonl#L([1-9][0-9]*)$", 1), F.lit("")), F.lit("9999999999999")).cast("bigint")


def key_values(pairs: Column) -> Column:
    """map of an array of ``key=value``, split at the first ``=``; entries without one are left out, the last of a key counts."""
    good = F.filter(pairs, lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(good, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))

    def last_of_each(es: Column) -> Column:
        after = lambda i: F.slice(es, i + 2, F.size(es))
        return F.filter(es, lambda e, i: ~F.exists(after(i), lambda later: later["k"] == e["k"]))

    return F.map_from_entries(let(entries, last_of_each))
