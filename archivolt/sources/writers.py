"""Writers: JSON lines, CSV, HTML, append-only logs, deterministic archives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.text import html_escape
from archivolt.operators.audit import refused


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, separator: str = "|") -> None:
    """CSV with header; arrays joined by the separator."""
    flat = [F.array_join(c, separator).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def html_row(columns: list[Column]) -> Column:
    """A table row with escaped cells; null as empty."""
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(html_escape(c.cast("string")), F.lit("")), F.lit("</td>")) for c in columns], F.lit("</tr>"))


def append_events(log: DataFrame, batch: DataFrame, path: str) -> None:
    """Appends a batch of events to a log in Parquet; a batch with null, known or repeated event ids is refused as a whole."""
    bad = refused(log, batch).limit(5).collect()
    if bad:
        raise ValueError("refused: " + ", ".join(f"{r.event_id} ({r.reason})" for r in bad))
    batch.write.mode("append").parquet(path)


def build_archives(members: DataFrame, first: str) -> DataFrame:
    """(package, archive) of (package, path, content): the descriptor first, the others by path, fixed times and modes.

    An archive is one value, so a package must fit a row.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        out = io.BytesIO()
        rows = sorted(zip(pdf["path"], pdf["content"], strict=True), key=lambda r: (r[0] != first, r[0]))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in rows:
                info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
                info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
                z.writestr(info, bytes(content))
        return pd.DataFrame({"package": [pdf["package"].iloc[0]], "archive": [out.getvalue()]})

    return members.groupBy("package").applyInPandas(build, "package string, archive binary")


def rows_iterator(df: DataFrame) -> Iterator:
    """Rows one partition at a time, for sinks that speak a protocol of their own."""
    return df.toLocalIterator(prefetchPartitions=True)
