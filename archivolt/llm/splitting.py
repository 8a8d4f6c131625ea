"""Splitting oversized items at natural boundaries: dynamic programming over boundary positions.

A piece ends at a boundary and the next begins at the first boundary at most ``overlap`` characters before that end, so
pieces cover the whole text and overlap by up to ``overlap``. Of all such sequences of pieces of at most ``max_chars``
characters the cheapest is taken: a cut costs by the kind of its boundary (paragraph, line, sentence, word, none), a
piece by the square of its distance from the even size and by the overlap it lacks. Only inside a run of more than ``max_chars`` characters without
white space or sentence mark are cuts without a boundary admitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PENALTY = {"paragraph": 0.0, "line": 0.02, "sentence": 0.05, "word": 0.35, "none": 1.5}
KINDS = tuple(PENALTY)
_COST = np.array([PENALTY[k] for k in KINDS])
SENTENCE_ENDS = ".!?;。！？；"
#: cost of a piece that overlaps the one before not at all, in proportion for less
LOST_OVERLAP = 0.3
#: up to so many boundaries the dynamic programme runs on full matrices
DENSE = 600

_SPACE = np.zeros(0x110000, dtype=bool)
for _c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    _SPACE[_c] = True
_SENT = np.zeros(0x110000, dtype=bool)
for _c in SENTENCE_ENDS:
    _SENT[ord(_c)] = True
_WIDE = np.zeros(0x110000, dtype=bool)
for _c in "。！？；":
    _WIDE[ord(_c)] = True

PIECES = "doc_id bigint, chunk_id int, piece int, char_start int, char_end int, text string, cut string, forced int"


def code_points(text: str) -> np.ndarray:
    """The code points of a text; lone surrogates are kept."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def longest_run(cp: np.ndarray) -> int:
    """Length of the longest run that holds neither white space nor a sentence mark."""
    stops = np.flatnonzero(_SPACE[cp] | _SENT[cp])
    return int(np.diff(np.concatenate(([-1], stops, [len(cp)]))).max()) - 1


def boundaries(cp: np.ndarray, max_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, kinds) where a text may be cut, both ends included; white space goes to the piece before the cut."""
    n = len(cp)
    space, sent = _SPACE[cp], _SENT[cp]
    kind = np.full(n + 1, len(KINDS) - 1, dtype=np.int8)  # kind of the cut before position p
    ok = np.zeros(n + 1, dtype=bool)
    after_space = np.flatnonzero(space) + 1
    kind[after_space] = 3
    ok[after_space] = True
    marks = np.flatnonzero(sent)
    kind[marks + 1] = 3  # a full stop inside a word or number is a weak place
    ok[marks + 1] = True
    wide = np.flatnonzero(_WIDE[cp])
    kind[wide + 1] = 2
    # the white space that follows a mark, and the line breaks in it, lift the cut after it
    starts = np.flatnonzero(space & ~np.concatenate(([False], space[:-1])))
    if len(starts):
        ends = np.flatnonzero(space & ~np.concatenate((space[1:], [False]))) + 1
        feeds = np.concatenate(([0], np.cumsum((cp == 10) | ((cp == 13) & (np.append(cp[1:], 0) != 10)))))
        n_feeds = feeds[ends] - feeds[starts]
        before = np.where(starts > 0, sent[np.maximum(starts - 1, 0)], False)
        k = np.where(n_feeds >= 2, 0, np.where(n_feeds == 1, 1, np.where(before, 2, 3)))
        kind[ends] = np.minimum(kind[ends], k)
    ok[0] = ok[n] = True
    kind[0] = kind[n] = 0
    pos = np.flatnonzero(ok)
    gaps = np.flatnonzero(np.diff(pos) > max_chars)
    if len(gaps):
        more = np.concatenate([np.arange(pos[g] + 1, pos[g + 1]) for g in gaps])  # any place inside an unbroken run
        kind[more] = len(KINDS) - 1
        ok[more] = True
        pos = np.flatnonzero(ok)
    return pos, kind[pos]


def split_points(cp: np.ndarray, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, kind of the end) of the pieces of a text of more than ``max_chars`` characters."""
    n = len(cp)
    pos, kind = boundaries(cp, max_chars)
    pieces = max(1, -(-(n - overlap) // max(1, max_chars - overlap)))
    even = min(max_chars, (n + (pieces - 1) * overlap) / pieces)
    lengths = np.arange(max_chars + 1)
    uneven = 1.0 + ((lengths - even) / max_chars) ** 2
    # first boundary that a piece may start at, by the end before it and by its own end
    by_previous = np.searchsorted(pos, pos - overlap)
    by_end = np.searchsorted(pos, pos - max_chars)
    m = len(pos)
    by_previous[0] = 0
    penalty = np.where(np.arange(m) < m - 1, _COST[kind], 0.0)
    if m <= DENSE:
        ends = _dense(pos, by_previous, by_end, uneven, penalty, overlap)
    else:
        ends = _banded(pos, by_previous, by_end, uneven, penalty, overlap)
    out = []
    for p, e in zip(ends, ends[1:], strict=False):
        s = max(int(by_previous[p]), int(by_end[e]))
        out.append((int(pos[s]), int(pos[e]), int(kind[e])))
    return out


def _dense(pos, by_previous, by_end, uneven, penalty, overlap: int) -> list[int]:
    """The ends of the cheapest pieces, by number of pieces: one matrix of all (previous end, end), one minimum a piece.

    Every piece costs 1 at least, so k + 1 pieces cannot beat a cost of at most k + 1.
    """
    m = len(pos)
    start = np.maximum(by_previous[:, None], by_end[None, :])
    p = np.arange(m)
    length = pos[None, :] - pos[np.minimum(start, m - 1)]
    fits = (start <= p[:, None]) & (p[:, None] < p[None, :])
    short = LOST_OVERLAP * (1.0 - (pos[:, None] - pos[np.minimum(start, m - 1)]) / max(1, overlap))
    short[0] = 0.0
    weight = np.where(fits, uneven[np.clip(length, 0, len(uneven) - 1)] + short, np.inf) + penalty[None, :]
    cost, backs, best, best_k = weight[0], [], np.inf, 0
    while True:
        if cost[-1] < best:
            best, best_k = float(cost[-1]), len(backs)
        if len(backs) + 2 >= best:
            break
        total = cost[:, None] + weight
        back = total.argmin(axis=0)
        backs.append(back)
        cost = total[back, p]
    ends = [m - 1]
    for back in backs[:best_k][::-1]:
        ends.append(int(back[ends[-1]]))
    return [0, *ends[::-1]]


def _banded(pos, by_previous, by_end, uneven, penalty, overlap: int) -> list[int]:
    """The same for very many boundaries: end by end, in memory linear in their number."""
    m = len(pos)
    cost, back = np.full(m, np.inf), np.zeros(m, dtype=np.int64)
    cost[0] = 0.0
    for e in range(1, m):
        lo = by_end[e]
        start = np.maximum(by_previous[lo:e], lo)
        short = LOST_OVERLAP * (1.0 - (pos[lo:e] - pos[start]) / max(1, overlap))
        if lo == 0:
            short[0] = 0.0
        c = cost[lo:e] + uneven[pos[e] - pos[start]] + short
        best = int(c.argmin())
        cost[e], back[e] = c[best] + penalty[e], lo + best
    ends = [m - 1]
    while ends[-1] > 0:
        ends.append(int(back[ends[-1]]))
    return ends[::-1]


def split_text(text: str, max_chars: int = 600, overlap: int = 80) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of the pieces of a text; a text within the limit is one piece, an empty one none."""
    if not text:
        return []
    if len(text) <= max_chars:
        return [(0, len(text), "paragraph")]
    return [(s, e, KINDS[k]) for s, e, k in split_points(code_points(text), max_chars, overlap)]


def resolved_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, text, char_start): text and offset of every chunk, one row per key.

    A null text is cut out of the document by the offsets, which are then right; a null offset is found by looking for
    the text in the document (equal chunks in the order of their numbers), and a given offset is trusted only if the text stands there. char_end is never read where
    the text is known. Of repeated rows the most complete counts. A chunk without text and without offsets, or whose
    document is missing, keeps a null text; one whose text is not in its document keeps a null offset.
    """
    filled = F.col("text").isNotNull().cast("int") + F.col("char_start").isNotNull().cast("int")
    one = (
        chunks.where("doc_id is not null and chunk_id is not null")
        .groupBy("doc_id", "chunk_id")
        .agg(F.max(F.struct(filled, "text", "char_start", "char_end")).alias("c"))
        .select("doc_id", "chunk_id", "c.text", F.col("c.char_start").cast("int").alias("char_start"), F.col("c.char_end").cast("int").alias("char_end"))
    )
    # equal chunks of one document stand at its first, second, ... such place
    turn = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("chunk_id"))
    docs = documents.select("doc_id", F.col("text").alias("doc_text"))
    both = one.withColumn("turn", F.when(F.col("text").isNotNull(), turn)).join(docs, "doc_id", "left")
    text = F.coalesce("text", F.expr("substring(doc_text, char_start + 1, char_end - char_start)"))
    stands = F.expr("substring(doc_text, char_start + 1, length(text)) = text")
    nth = F.expr("length(substring_index(doc_text, text, turn))")
    found = F.when(nth < F.length("doc_text"), nth).otherwise(F.expr("nullif(instr(doc_text, text), 0) - 1"))
    start = F.when(F.col("text").isNull() | stands, F.col("char_start")).otherwise(found).cast("int")
    return both.select("doc_id", "chunk_id", text.alias("text"), start.alias("char_start"))


def split_chunks(
    chunks: DataFrame, documents: DataFrame, max_chars: int = 600, overlap: int = 80
) -> DataFrame:
    """(doc_id, chunk_id, piece, char_start, char_end, text, cut, forced): the pieces of every oversized chunk.

    char_start and char_end point into the document's text (null where the chunk is not found there). ``cut`` is the kind
    of boundary at the piece's end, ``forced`` is 1 if the chunk holds a run of more than ``max_chars`` characters
    without white space or sentence mark. Chunks within the limit, or without a text, give no rows.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and below max_chars")
    # a null text has right offsets, so its length is known before the join: small chunks are never shuffled
    size = F.coalesce(F.length("text"), F.col("char_end") - F.col("char_start"))
    big = resolved_chunks(chunks.where(size > max_chars), documents).where(F.length("text") > max_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, chunk, text, at in zip(pdf["doc_id"], pdf["chunk_id"], pdf["text"], pdf["char_start"], strict=True):
                cp = code_points(text)
                forced = int(longest_run(cp) > max_chars)
                base = None if at is None or at != at else int(at)
                for i, (s, e, k) in enumerate(split_points(cp, max_chars, overlap)):
                    where = (None, None) if base is None else (base + s, base + e)
                    rows.append((doc, chunk, i, *where, text[s:e], KINDS[k], forced))
            out = pd.DataFrame(rows, columns=["doc_id", "chunk_id", "piece", "char_start", "char_end", "text", "cut", "forced"])
            yield out.astype({"char_start": "Int32", "char_end": "Int32"})

    return big.mapInPandas(run, PIECES)


def coverage(pieces: DataFrame, documents: DataFrame, max_chars: int = 600, overlap: int = 80) -> DataFrame:
    """(doc_id, chunk_id, char_start, char_end, too_long, gaps, wide_overlaps, wrong_texts): what the pieces of every chunk
    cover of its document, and how many of them break a rule of splitting."""
    docs = documents.select("doc_id", F.col("text").alias("doc_text"))
    order = Window.partitionBy("doc_id", "chunk_id").orderBy("piece")
    met = pieces.withColumn("before", F.lag("char_end").over(order)).join(docs, "doc_id", "left")
    stands = F.coalesce(F.expr("substring(doc_text, char_start + 1, char_end - char_start) = text"), F.lit(False))
    return met.groupBy("doc_id", "chunk_id").agg(
        F.min("char_start").alias("char_start"),
        F.max("char_end").alias("char_end"),
        F.count_if(F.length("text") > max_chars).alias("too_long"),
        F.count_if(F.col("char_start") > F.col("before")).alias("gaps"),
        F.count_if(F.col("char_start") < F.col("before") - overlap).alias("wide_overlaps"),
        F.count_if(~stands).alias("wrong_texts"),
    )
