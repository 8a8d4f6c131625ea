"""Token counts and white space as every size in this subpackage understands them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: tab, LF, CR, space, no-break space, ideographic space
WHITE = r"\t\n\r  　"
WHITE_SQL = r"\t\n\r \x{00A0}\x{3000}"


def token_count(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, plus single other characters that are not white space; null counts 0.

    Two linear passes of the JVM's regex engine and a code point length; no array of tokens is built.
    """
    runs = F.regexp_replace(text, "[A-Za-z0-9]+", "a")
    return F.coalesce(F.length(F.regexp_replace(runs, f"[{WHITE}]+", "")), F.lit(0)).cast("bigint")


def token_count_sql(text: str) -> str:
    """The same count for DuckDB."""
    return (
        f"coalesce(length(regexp_replace(regexp_replace({text}, '[A-Za-z0-9]+', 'a', 'g'), '[{WHITE_SQL}]+', '', 'g')), 0)::BIGINT"
    )


def clean_source(source: Column) -> Column:
    """A source in lower case without outer white space; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(source, f"^[{WHITE}]+|[{WHITE}]+$", "")), F.lit(""))
