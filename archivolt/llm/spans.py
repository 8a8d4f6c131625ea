"""Long exact spans shared between records: fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half the least span length. A span of that length holds
at least one whole block of the one document, and the other document holds that block as one of its rolling windows. So:

1. index: the hashes of all reference blocks, aggregated by hash (a block that stands in several texts is marked);
2. probe: every rolling window of every text against a filter of the indexed hashes; the hits are joined exactly;
3. extend: blocks and windows of the shared hashes, with as much text on either side as decides about the least length,
   meet on the hash; equal text is extended to the left and right, and neighbouring hits on one diagonal are merged into
   maximal repeats.

Exact copies are one class: their blocks and windows are merged before anything is joined, and copies are multiplied out
only in the result. The join on the hash is salted: the windows of a hash that stands in very many places are dealt out
over many tasks, and its blocks go to each. The filter is broadcast and has at most ``MAX_FILTER_BYTES``; beyond that,
anchors are chosen by content on both sides (the windows that are the least of a row that any span of ``least`` holds),
shared hashes are found by a shuffle of hashes, and only a filter of the shared ones is broadcast, behind the same bound;
the spans found are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.runtime import cut

MAX_FILTER_BYTES = 128 << 20
#: places of one hash that are joined in one task at most, on the side that is dealt out
HOT_PLACES = 2_000
#: texts are hashed together in runs of about so many characters
RUN_CHARS = 400_000
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        one = np.ones(1, dtype=np.uint64)
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate((one, np.full(n - 1, _BASE, dtype=np.uint64))))
            inverse = pow(_BASE, -1, 1 << 64)
            self.down = np.cumprod(np.concatenate((one, np.full(n - 1, inverse, dtype=np.uint64))))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def window_hashes(cp: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` code points: a polynomial from prefix sums, then mixed."""
    n = len(cp)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.upto(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((cp + np.uint64(1)) * up, out=sums[1:])
    h = sums[width:] - sums[:-width]
    h *= down[: n - width + 1]
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def runs(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, code points, offsets of the texts in them) of runs of consecutive texts."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= RUN_CHARS or i == len(texts) - 1:
            part = texts[first : i + 1]
            cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            yield first, cp, np.concatenate(([0], np.cumsum([len(x) for x in part])))
            first, size = i + 1, 0


def block_positions(offsets: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, numbers of their texts) of the whole reference blocks of the texts of a run."""
    counts = np.diff(offsets) // block
    number = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[number] + within * block, number


def inside(offsets: np.ndarray, n_windows: int, width: int) -> np.ndarray:
    """Which windows lie within one text."""
    ok = np.ones(n_windows, dtype=bool)
    for end in offsets[1:-1]:
        ok[max(0, end - width + 1) : end] = False
    return ok


class HashFilter:
    """A set of 64-bit hashes with few false members: four bits in one 64-bit word, one memory access a probe."""

    def __init__(self, log_words: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - log_words), words

    @staticmethod
    def log_words(n: int) -> int:
        """Words for ``n`` hashes: a power of two of at least 1.2 words a hash."""
        return max(10, int(np.ceil(np.log2(max(1.0, 1.2 * n)))))

    @staticmethod
    def mask(h: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        return (
            (one << (h & low))
            | (one << ((h >> np.uint64(6)) & low))
            | (one << ((h >> np.uint64(12)) & low))
            | (one << ((h >> np.uint64(18)) & low))
        )

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` of the hashes that may be members."""
        words = self.words[h >> self.shift]
        some = np.flatnonzero(words >> (h & np.uint64(63)) & np.uint64(1))
        m = self.mask(h[some])
        return some[(words[some] & m) == m]


def build_filter(hashes: DataFrame, n: int) -> HashFilter:
    """The filter of a one-column table of distinct 64-bit hashes: every task fills its own range of words.

    Its size follows from ``n``, which the caller has held against the bound; only the words come to the driver.
    """
    log = HashFilter.log_words(n)
    log_slices = max(0, log - 18)
    shift, per = 64 - log, 1 << (log - log_slices)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["hash"].to_numpy().view(np.uint64)
        at = (h >> np.uint64(shift)).astype(np.int64)
        words = np.zeros(per, dtype=np.uint64)
        np.bitwise_or.at(words, at & (per - 1), HashFilter.mask(h))
        return pd.DataFrame({"slice": [int(at[0] // per)], "words": [words.tobytes()]})

    sliced = hashes.select(F.shiftrightunsigned("hash", 64 - log_slices).alias("slice") if log_slices else F.lit(0).cast("bigint").alias("slice"), "hash")
    words = np.zeros(1 << log, dtype=np.uint64)
    for row in sliced.groupBy("slice").applyInPandas(fill, "slice bigint, words binary").toLocalIterator():
        words[row["slice"] * per : (row["slice"] + 1) * per] = np.frombuffer(row["words"], dtype=np.uint64)
    return HashFilter(log, words)


def thin_periodic(doc: np.ndarray, pos: np.ndarray, h: np.ndarray, block: int, period: int | None = None) -> np.ndarray:
    """Indexes to keep of the hits of a run, given by text and position.

    Where one hash recurs in overlapping windows the text is periodic. A shared span either reaches the end of the
    periodic stretch or fits at its start, so the windows within one block of either end are enough. With ``period``
    only stretches of at most that period are thinned.
    """
    apart = block if period is None else period + 1
    order = np.lexsort((pos, h, doc))
    d, p, x = doc[order], pos[order], h[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (p[1:] - p[:-1] >= apart)
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    keep = (p - p[first][group] <= block) | (p[last][group] - p <= block)
    return order[keep]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` values in a row, by doubling."""
    out, size = h.copy(), 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(h) - w + 1], out[w - size : w - size + len(h) - w + 1]) if w > size else out


def _texts(documents: DataFrame, least: int) -> DataFrame:
    """(key, text) of the texts that are long enough; the key is the class of equal texts. Texts without an id are left out."""
    return documents.where((F.length("text") >= least) & F.col("doc_id").isNotNull()).select(F.unhex(F.md5("text")).alias("key"), "text")


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)


def _index(texts: DataFrame, block: int) -> DataFrame:
    """(hash, multi): the distinct hashes of all reference blocks, and whether they stand in several classes."""
    schema = pa.schema([("hash", pa.int64()), ("class", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(k[:8] for k in b.column(0).to_pylist()), dtype=np.int64)
            for first, cp, off in runs(b.column(1).to_pylist()):
                pos, number = block_positions(off, block)
                h = window_hashes(cp, block)[pos]
                yield _batch({"hash": h.view(np.int64), "class": keys[first + number]}, schema)

    rows = texts.mapInArrow(scan, "hash bigint, class bigint")
    return rows.groupBy("hash").agg((F.min("class") != F.max("class")).alias("multi"))


def _probe(texts: DataFrame, block: int, known: HashFilter, multi: HashFilter) -> DataFrame:
    """(hash): hashes of rolling windows that may be blocks of another text."""
    sc = texts.sparkSession.sparkContext
    shared_known, shared_multi = sc.broadcast(known), sc.broadcast(multi)
    schema = pa.schema([("hash", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, multi = shared_known.value, shared_multi.value
        for b in batches:
            for _, cp, off in runs(b.column(1).to_pylist()):
                h = window_hashes(cp, block)
                at = known.hits(h)
                blocks, _ = block_positions(off, block)
                own = np.zeros(len(h), dtype=bool)  # a block trivially meets itself: it counts if it stands elsewhere too
                own[blocks] = True
                at = at[~own[at] & inside(off, len(h), block)[at]]
                again = blocks[multi.hits(h[blocks])]
                yield _batch({"hash": np.unique(h[np.concatenate((at, again))]).view(np.int64)}, schema)

    return texts.mapInArrow(scan, "hash bigint")


ANCHOR = "hash bigint, key binary, pos int, is_block boolean, is_end boolean, before int, around string"


def _anchors(texts: DataFrame, block: int, least: int, shared: HashFilter, every: bool, repeats: bool) -> DataFrame:
    """Blocks and windows of the shared hashes, with the text around them that decides about the least length.

    In periodic stretches only the blocks near the ends are kept, and with ``every`` all windows, else those near the ends.
    With ``repeats`` all blocks and windows are kept; is_end tells those near the ends, or outside of such stretches.
    """
    sc = texts.sparkSession.sparkContext
    lookup = sc.broadcast(shared)
    side = least - block
    schema = pa.schema(
        [("hash", pa.int64()), ("key", pa.binary()), ("pos", pa.int32()), ("is_block", pa.bool_()), ("is_end", pa.bool_()), ("before", pa.int32()), ("around", pa.string())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = lookup.value
        for b in batches:
            keys, bodies = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, cp, off in runs(bodies):
                h = window_hashes(cp, block)
                at = wanted.hits(h)
                at = at[inside(off, len(h), block)[at]]
                if not len(at):
                    continue
                number = np.searchsorted(off, at, side="right") - 1
                pos = at - off[number]
                kept = np.zeros(len(at), dtype=bool)
                kept[thin_periodic(number, pos, h[at], block, block // 2 if repeats else None)] = True
                if not (every or repeats):
                    number, pos, at, kept = number[kept], pos[kept], at[kept], kept[kept]
                start = np.maximum(pos - side, 0)
                around = [bodies[first + d][s : p + block + side] for d, s, p in zip(number.tolist(), start.tolist(), pos.tolist(), strict=True)]
                yield _batch(
                    {
                        "hash": h[at].view(np.int64),
                        "key": [keys[first + d] for d in number.tolist()],
                        "pos": pos.astype(np.int32),
                        "is_block": (kept | repeats) & (pos % block == 0),
                        "is_end": kept,
                        "before": (pos - start).astype(np.int32),
                        "around": around,
                    },
                    schema,
                )

    return texts.mapInArrow(scan, ANCHOR)


def _chosen(h: np.ndarray, row: int) -> np.ndarray:
    """Positions of the windows of a text that are the least of some ``row`` windows in a row; ties are all taken."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    low = sliding_min(h, min(row, len(h)))
    edge = np.zeros(row - 1, dtype=np.uint64)
    return np.flatnonzero(h == _sliding_max(np.concatenate((edge, low, edge)), row)[: len(h)])


def _content_anchors(texts: DataFrame, block: int, least: int, every: bool, repeats: bool) -> DataFrame:
    """The anchors beyond the filter's bound: windows that are the least of ``least - block + 1`` in a row, both ways.

    First the hashes that stand in several classes are found by a shuffle of hashes alone. They are few, so a second scan
    looks its windows up in a filter of them and takes the text around them along; only if that filter too is beyond the
    bound do all windows meet the shared hashes, and then their texts, in shuffle joins.
    """
    row, side = least - block + 1, least - block
    classes = pa.schema([("hash", pa.int64()), ("class", pa.int64())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(k[:8] for k in b.column(0).to_pylist()), dtype=np.int64)
            for first, cp, off in runs(b.column(1).to_pylist()):
                h = window_hashes(cp, block)
                own = [h[off[d] : max(off[d], off[d + 1] - block + 1)] for d in range(len(off) - 1)]
                some = [np.unique(o[_chosen(o, row)]) for o in own]
                number = np.repeat(np.arange(len(some)), [len(x) for x in some])
                yield _batch({"hash": np.concatenate(some).view(np.int64), "class": keys[first + number]}, classes)

    met = texts.mapInArrow(sketch, "hash bigint, class bigint").groupBy("hash").agg((F.min("class") != F.max("class")).alias("multi"))
    shared = cut(met.where("multi").select("hash"))
    n = shared.count()
    fits = 8 << HashFilter.log_words(n) <= MAX_FILTER_BYTES
    lookup = texts.sparkSession.sparkContext.broadcast(build_filter(shared, n)) if fits else None
    fields = [("hash", pa.int64()), ("key", pa.binary()), ("pos", pa.int32()), ("is_block", pa.bool_()), ("is_end", pa.bool_())]
    schema = pa.schema([*fields, ("before", pa.int32()), ("around", pa.string())] if fits else fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = lookup.value if lookup else None
        for b in batches:
            keys, bodies = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, cp, off in runs(bodies):
                h = window_hashes(cp, block)
                for d in range(len(off) - 1):
                    own = h[off[d] : max(off[d], off[d + 1] - block + 1)]
                    pos = _chosen(own, row)
                    if wanted:
                        pos = pos[wanted.hits(own[pos])]
                    if not len(pos):
                        continue
                    kept = np.zeros(len(pos), dtype=bool)
                    kept[thin_periodic(np.zeros(len(pos), dtype=np.int64), pos, own[pos], block, block // 2 if repeats else None)] = True
                    if not (every or repeats):
                        pos, kept = pos[kept], kept[kept]
                    out = {"hash": own[pos].view(np.int64), "key": [keys[first + d]] * len(pos), "pos": pos.astype(np.int32), "is_block": kept | repeats, "is_end": kept}
                    if wanted:
                        start = np.maximum(pos - side, 0)
                        out["before"] = (pos - start).astype(np.int32)
                        out["around"] = [bodies[first + d][s : p + block + side] for s, p in zip(start.tolist(), pos.tolist(), strict=True)]
                    yield _batch(out, schema)

    if fits:
        return texts.mapInArrow(scan, ANCHOR)
    found = texts.mapInArrow(scan, "hash bigint, key binary, pos int, is_block boolean, is_end boolean").distinct()
    one_text = texts.groupBy("key").agg(F.first("text").alias("text"))
    return (
        found.join(shared, "hash")
        .join(one_text, "key")
        .select(
            "hash",
            "key",
            "pos",
            "is_block",
            "is_end",
            F.least("pos", F.lit(side)).alias("before"),
            F.expr(f"substring(text, greatest(pos - {side}, 0) + 1, least(pos, {side}) + {block + side})").alias("around"),
        )
    )


def _sliding_max(h: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~h, w)


def common(a: str, b: str, i: int, j: int, block: int, side: int) -> tuple[int, int]:
    """(left, right): how far equal blocks at ``i`` and ``j`` of two texts extend; left is -1 if they differ."""
    if a[i : i + block] != b[j : j + block]:
        return -1, 0
    left, most = 0, min(i, j, side)
    if a[i - most : i] == b[j - most : j]:
        left = most
    else:
        while left < most and a[i - left - 1] == b[j - left - 1]:
            left += 1
    x, y = a[i + block : i + block + side], b[j + block : j + block + side]
    right, most = 0, min(len(x), len(y))
    if x[:most] == y[:most]:
        right = most
    else:
        while x[right] == y[right]:
            right += 1
    return left, right


def salted(places: DataFrame) -> DataFrame:
    """The places with a column ``salts``: into how many tasks the places of a hash are dealt out, 1 for nearly all."""
    hot = cut(
        places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PLACES)
        .select("hash", F.ceil(F.col("n") / HOT_PLACES).cast("int").alias("salts"))
    )
    if hot.isEmpty():
        return places.withColumn("salts", F.lit(1))
    return places.join(hot, "hash", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))  # broadcast only if it is small


def class_hits(
    documents: DataFrame, least: int = 200, max_filter_bytes: int = MAX_FILTER_BYTES, every: bool = False, repeats: bool = False
) -> DataFrame:
    """(key_a, key_b, pos_a, pos_b, left, right, block): equal blocks of two different texts that extend to ``least`` or more.

    block is their length, left and right are the equal characters on either side, up to ``least - block``. Either key_a < key_b
    and one hit at least for every pair and stretch, or with ``every`` both ways round and all hits in text b. With
    ``repeats`` key_a < key_b and one hit at least for every maximal repeat: where a block and a window both lie inside
    of periodic stretches, the hit one period or block before them is of the same repeat, so one of the two is always
    near an end.
    """
    if least < 2:
        raise ValueError("least must be at least 2")
    block = least // 2
    side = least - block
    texts = _texts(documents, least)
    index = cut(_index(texts, block))
    n = index.count()
    if 8 << HashFilter.log_words(n) <= max_filter_bytes:
        marked = index.where("multi").select("hash")
        probes = _probe(texts, block, build_filter(index.select("hash"), n), build_filter(marked, marked.count()))
        shared = cut(probes.distinct().join(index, "hash", "left_semi"))
        anchors = _anchors(texts, block, least, build_filter(shared, shared.count()), every, repeats)
    else:
        block = least - least // 4  # longer windows, chosen from shorter rows, are shared by fewer texts
        side = least - block
        anchors = _content_anchors(texts, block, least, every, repeats)
    once = anchors.groupBy("hash", "key", "pos", "is_block", "is_end").agg(F.first(F.struct("before", "around")).alias("v"))
    once = salted(cut(once))
    a = once.where("is_block").select("hash", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("key").alias("key_a"), F.col("pos").alias("pos_a"), F.col("v").alias("va"), F.col("is_end").alias("end_a"))
    b = once.select("hash", F.pmod(F.xxhash64("key", "pos"), "salts").cast("int").alias("salt"), F.col("key").alias("key_b"), F.col("pos").alias("pos_b"), F.col("v").alias("vb"), F.col("is_end").alias("end_b"))

    @F.pandas_udf("left int, right int")
    def extend(i: pd.Series, x: pd.Series, j: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = [common(p, q, m, n, block, side) for m, p, n, q in zip(i, x, j, y, strict=True)]
        return pd.DataFrame(found, columns=["left", "right"]).astype("int32")

    if repeats:  # two joins, so that pairs of inner places, whose number is the product of two lengths, are never made
        joined = a.where("end_a").join(b, ["hash", "salt"]).unionByName(a.where("not end_a").join(b.where("end_b"), ["hash", "salt"]))
    else:
        joined = a.join(b, ["hash", "salt"])
    met = joined.where("key_a <> key_b" if every else "key_a < key_b")
    grown = met.select("key_a", "key_b", "pos_a", "pos_b", extend("va.before", "va.around", "vb.before", "vb.around").alias("e"))
    return grown.select("key_a", "key_b", "pos_a", "pos_b", "e.left", "e.right", F.lit(block).alias("block")).where(
        (F.col("left") >= 0) & (F.col("left") + F.col("right") + block >= least)
    )


def members(documents: DataFrame, least: int = 200) -> DataFrame:
    """(key, doc_id): the class of equal texts of every document that is long enough to share a span."""
    return (
        documents.where((F.length("text") >= least) & F.col("doc_id").isNotNull())
        .select(F.unhex(F.md5("text")).alias("key"), "doc_id")
        .distinct()
    )


def _ends(a: np.ndarray, b: np.ndarray, i: int, j: int, n: int) -> tuple[int, int]:
    """(start, stop) in a of the longest equal text around ``n`` equal characters at ``i`` and ``j``."""

    def equal(x: np.ndarray, y: np.ndarray) -> int:
        done, step, most = 0, 64, min(len(x), len(y))
        while done < most:
            differ = np.flatnonzero(x[done : min(done + step, most)] != y[done : min(done + step, most)])
            if len(differ):
                return done + int(differ[0])
            done, step = min(done + step, most), step * 2
        return most

    return i - equal(a[:i][::-1], b[:j][::-1]), i + n + equal(a[i + n :], b[j + n :])


def _extended(opened: DataFrame, texts: DataFrame) -> DataFrame:
    """(key_a, key_b, diagonal, start, stop) of equal stretches, grown over the whole texts: each text once a pair."""
    pairs = opened.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("diagonal", "start", "stop")).alias("at"))
    keys = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    bodies = texts.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    both = pairs.join(bodies.select(F.col("key").alias("key_a"), F.col("text").alias("text_a")), "key_a").join(
        bodies.select(F.col("key").alias("key_b"), F.col("text").alias("text_b")), "key_b"
    )

    @F.pandas_udf("array<struct<diagonal:int,start:int,stop:int>>")
    def grow(x: pd.Series, y: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for p, q, stretches in zip(x, y, at, strict=True):
            a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (p, q))
            grown = {(s["diagonal"], *_ends(a, b, s["start"], s["start"] + s["diagonal"], s["stop"] - s["start"])) for s in stretches}
            out.append([{"diagonal": d, "start": i, "stop": j} for d, i, j in grown])
        return pd.Series(out)

    return both.select("key_a", "key_b", F.explode(grow("text_a", "text_b", "at")).alias("s")).select("key_a", "key_b", "s.diagonal", "s.start", "s.stop")


def maximal_repeats(hits: DataFrame, texts: DataFrame, least: int = 200) -> DataFrame:
    """(key_a, key_b, start_a, start_b, length): hits on one diagonal merged and grown into maximal exact repeats.

    A hit shows equal text up to ``least - block`` characters off its block. Merged stretches whose outermost hit ends
    only there are grown further in the texts (key, text).
    """
    block, side = F.col("block"), least - F.col("block")
    diagonal = Window.partitionBy("key_a", "key_b", "diagonal").orderBy("start", "stop")
    island = Window.partitionBy("key_a", "key_b", "diagonal")
    spans = hits.select(
        "key_a",
        "key_b",
        (F.col("pos_b") - F.col("pos_a")).alias("diagonal"),
        (F.col("pos_a") - F.col("left")).alias("start"),
        (F.col("pos_a") + block + F.col("right")).alias("stop"),
        ((F.col("left") == side) & (F.col("pos_a") > F.col("left")) & (F.col("pos_b") > F.col("left"))).alias("open_left"),
        (F.col("right") == side).alias("open_right"),
    ).distinct()
    reach = F.max("stop").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("new").over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    merged = cut(
        numbered.groupBy("key_a", "key_b", "diagonal", "run")
        .agg(F.min(F.struct("start", "open_left")).alias("l"), F.max(F.struct("stop", (~F.col("open_right")).alias("closed"))).alias("r"))
        .select("key_a", "key_b", "diagonal", "l.start", "r.stop", (F.col("l.open_left") | ~F.col("r.closed")).alias("open"))
    )
    whole = merged.where("not open").drop("open").unionByName(_extended(merged.where("open").drop("open"), texts)).distinct()
    return whole.select(
        "key_a", "key_b", F.col("start").alias("start_a"), (F.col("start") + F.col("diagonal")).alias("start_b"), (F.col("stop") - F.col("start")).alias("length")
    )


def shared_pairs(documents: DataFrame, least: int = 200, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: all pairs of documents with ``least`` equal characters in a row.

    Null ids and texts, and texts shorter than ``least``, are in no pair; repeated rows count once.
    """
    of = members(documents, least)
    between = class_hits(documents, least, max_filter_bytes).select("key_a", "key_b").distinct()
    a = of.select(F.col("key").alias("key_a"), F.col("doc_id").alias("x"))
    b = of.select(F.col("key").alias("key_b"), F.col("doc_id").alias("y"))
    met = between.join(a, "key_a").join(b, "key_b").where("x <> y")
    copies = of.select("key", F.col("doc_id").alias("x")).join(of.select("key", F.col("doc_id").alias("y")), "key").where("x < y")
    return (
        met.select("x", "y").unionByName(copies.select("x", "y"))
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        .distinct()
    )


def shared_report(documents: DataFrame, least: int = 200, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(doc_id, class_id, n_chars, n_spans, shared_chars, shared_fraction): how much of every document stands elsewhere.

    One row per document that shares a span; class_id is the least doc_id with the same text. Spans of one document
    that overlap or touch are merged first. A text that has an exact copy is shared as a whole.
    """
    hits = class_hits(documents, least, max_filter_bytes, every=True)
    copies = members(documents, least).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    whole = (
        documents.where(F.length("text") >= least).select(F.unhex(F.md5("text")).alias("key"), F.length("text").alias("stop"))
        .join(copies.where("n > 1"), "key").select("key", F.lit(0).alias("start"), "stop").distinct()
    )
    stretches = (
        hits.select(F.col("key_b").alias("key"), (F.col("pos_b") - F.col("left")).alias("start"), (F.col("pos_b") + F.col("block") + F.col("right")).alias("stop"))
        .unionByName(whole)
        .distinct()
    )
    w = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs_ = stretches.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn(
        "run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = runs_.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    per = merged.groupBy("key").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    docs = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select(
        F.unhex(F.md5("text")).alias("key"), "doc_id", F.length("text").alias("n_chars")
    ).distinct()
    classes = members(documents, least).groupBy("key").agg(F.min("doc_id").alias("class_id"))
    return docs.join(per, "key").join(classes, "key").select(
        "doc_id", "class_id", "n_chars", "n_spans", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("shared_fraction")
    )


def shared_stretches(documents: DataFrame, least: int = 200, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(doc_id_a, doc_id_b, start_a, start_b, length): the maximal repeats of two different texts.

    Either document stands for all with its text: it is the one with the least doc_id.
    """
    classes = members(documents, least).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    a = classes.select(F.col("key").alias("key_a"), F.col("doc_id").alias("x"))
    b = classes.select(F.col("key").alias("key_b"), F.col("doc_id").alias("y"))
    hits = class_hits(documents, least, max_filter_bytes, repeats=True)
    met = maximal_repeats(hits, _texts(documents, least), least).join(a, "key_a").join(b, "key_b")
    turned = F.col("x") > F.col("y")
    return met.select(
        F.least("x", "y").alias("doc_id_a"),
        F.greatest("x", "y").alias("doc_id_b"),
        F.when(turned, F.col("start_b")).otherwise(F.col("start_a")).alias("start_a"),
        F.when(turned, F.col("start_a")).otherwise(F.col("start_b")).alias("start_b"),
        "length",
    )
