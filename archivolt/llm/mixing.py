"""Mixing sources to target weights.

The tokens of every source are laid end to end in a pseudorandom order of its documents and cut into blocks of one
length. Quotas of blocks follow the target shares; a source that cannot reach its share with ``max_repeats`` passes gives
all it has, and what is missing goes to the others in proportion to their shares. The slots of a source fall into the
output shards by a multinomial draw, made as nested binomial splits of the range of shards, so that every task draws its
own shards and the totals come out exactly; a shard's counts by source are then multinomial given its size. Slot k of a
source is block ``perm(k mod n)`` of pass ``k div n``, perm being a keyed permutation of the block indexes that
needs no shuffle and no memory, and the block's documents are found by joining on (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.llm.tokens import clean_source, token_count
from archivolt.runtime import cut, groups_for, salt

ROWS_PER_BUCKET = 20_000
#: rows of the targets table; a table of sources is small by nature and read into the driver
MAX_SOURCES = 10_000
#: output shards that are drawn together
SHARDS_AT_ONCE = 64


@dataclass(frozen=True)
class Quota:
    """What one source is to give. ``short``: its documents, each taken max_repeats times, are less than its share."""

    source: str
    target_share: float
    max_repeats: int
    tokens: int
    blocks: int
    slots: int
    short: bool


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of ``[0, n)`` at ``index``: a Feistel network over the next even power of two, cycle-walked."""
    index, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)))
    half = np.maximum(1, np.ceil(bits / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def network(x: np.ndarray, half: np.ndarray, mask: np.ndarray, key: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(4):
            f = (right + key + np.uint64(r * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << half) | right

    out = network(index, half, mask, key)
    todo = np.flatnonzero(out >= n)
    while len(todo):
        out[todo] = network(out[todo], half[todo], mask[todo], key[todo])
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def plan_quotas(rows: list[tuple[str, float, int, int]], block: int) -> list[Quota]:
    """Quotas of blocks for (source, target_share, max_repeats, tokens); ties and order do not matter."""
    total = sum(r[3] for r in rows)
    want = -(-total // block)
    blocks = [-(-r[3] // block) for r in rows]
    cap = [b * max(0, r[2]) for b, r in zip(blocks, rows, strict=True)]
    given = [0.0] * len(rows)
    free, left = {i for i, r in enumerate(rows) if r[1] > 0 and cap[i] > 0}, float(want)
    while free and left > 1e-9:
        weight = sum(rows[i][1] for i in free)
        full = {i for i in free if given[i] + left * rows[i][1] / weight >= cap[i]}
        if not full:
            for i in free:
                given[i] += left * rows[i][1] / weight
            break
        for i in full:
            left -= cap[i] - given[i]
            given[i] = float(cap[i])
        free -= full
    slots = [min(cap[i], int(g)) for i, g in enumerate(given)]
    spare = min(want, sum(cap[i] for i in range(len(rows)) if rows[i][1] > 0)) - sum(slots)
    for i in sorted(range(len(rows)), key=lambda i: (slots[i] - given[i], rows[i][0])):
        if spare > 0 and slots[i] < cap[i] and rows[i][1] > 0:
            slots[i] += 1
            spare -= 1
    return [
        Quota(r[0], r[1], r[2], r[3], b, s, r[2] * r[3] < r[1] * total)
        for r, b, s in zip(rows, blocks, slots, strict=True)
    ]


def draw_shards(slots: np.ndarray, shards: int, begin: int, end: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot, slots) by source, for the shards in [begin, end) of ``shards``.

    The slots of every source are split binomially between the halves of a range of shards, down to single shards. A
    split is seeded by its range, so any task that comes by draws the same; only ranges that meet [begin, end) are.
    """
    todo = [(0, shards, np.zeros(len(slots), dtype=np.int64), slots.astype(np.int64))] if shards else []
    while todo:
        low, high, first, n = todo.pop()
        if high <= begin or end <= low:
            continue
        if high - low == 1:
            yield low, first, n
            continue
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(n, (middle - low) / (high - low))
        todo += [(middle, high, first + left, n - left), (low, middle, first, left)]


def source_blocks(documents: DataFrame, targets: DataFrame, block: int, seed: int = 0) -> DataFrame:
    """(source, block, doc_id, token_from, token_to): the parts of documents that make up every block of its source.

    The running token count of a source is taken within hash buckets of bounded size, and then over the buckets'
    totals: no task ever holds a whole source.
    """
    buckets = groups_for(documents.count(), ROWS_PER_BUCKET)
    docs = (
        documents.select("doc_id", clean_source(F.col("source")).alias("source"), token_count(F.col("text")).alias("n"))
        .where("n > 0 and source is not null and doc_id is not null")
        .join(F.broadcast(targets.select("source")), "source", "left_semi")  # at most MAX_SOURCES rows, see mix
        .select("*", salt(F.col("doc_id"), buckets, seed).alias("bucket"), F.xxhash64("doc_id", F.lit(seed)).alias("rank"))
    )
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "n")
    docs = docs.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    before = (
        docs.groupBy("source", "bucket")
        .agg(F.sum("n").alias("size"))
        .withColumn(
            "base",
            F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("size"),
        )
        .drop("size")
    )
    placed = docs.join(before, ["source", "bucket"]).select(
        "source", "doc_id", (F.col("base") + F.col("upto") - F.col("n")).alias("start"), (F.col("base") + F.col("upto")).alias("stop")
    )
    parts = placed.select(
        "*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}"))).alias("block")
    )
    return parts.select(
        "source",
        "block",
        "doc_id",
        (F.greatest(F.col("block") * block, "start") - F.col("start")).alias("token_from"),
        (F.least((F.col("block") + 1) * block, "stop") - F.col("start")).alias("token_to"),
    )


def _normal_targets(targets: DataFrame) -> DataFrame:
    return (
        targets.select(
            F.col("source").alias("name"),
            clean_source(F.col("source")).alias("source"),
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        )
        .where("source is not null")
        .groupBy("source")
        .agg(F.min("name").alias("name"), F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )


def mix(
    documents: DataFrame, targets: DataFrame, block: int = 1024, slots_per_shard: int = 4096, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """The mixed set and its report.

    Set: (out_shard, source, pass, block, doc_id, token_from, token_to), the parts of documents of every slot. Report:
    (source, target_share, max_repeats, tokens, blocks, slots, short, mixed_tokens, actual_share, passes), one row per
    source of ``targets`` as spelled there. The set is as large as all documents of the named sources, up to the last
    block of each. Null texts, sources or ids count no tokens; a source without documents gives none; of targets that
    differ only in spelling the larger values count; an empty table gives an empty set and zero shares.
    """
    if block < 1 or slots_per_shard < 1:
        raise ValueError("block and slots_per_shard must be positive")
    spark, wanted = documents.sparkSession, _normal_targets(targets)
    if wanted.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    parts = cut(source_blocks(documents, wanted, block, seed))  # read for the totals, the set and the report
    tokens = parts.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    rows = wanted.join(tokens, "source", "left").select(
        "source", "name", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens")
    ).orderBy("source").collect()
    quotas = plan_quotas([(r.source, r.target_share, r.max_repeats, r.tokens) for r in rows], block)
    names = {r.source: r.name for r in rows}
    sources, slots_of = [q.source for q in quotas], np.array([q.slots for q in quotas], dtype=np.int64)
    blocks_of = np.array([q.blocks for q in quotas], dtype=np.int64)
    shards = -(-int(slots_of.sum()) // slots_per_shard)

    def draw(ranges: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in ranges:
            for piece in pdf["id"]:
                for shard, first, n in draw_shards(slots_of, shards, piece * SHARDS_AT_ONCE, min(shards, (piece + 1) * SHARDS_AT_ONCE), seed):
                    some = np.flatnonzero(n)
                    yield pd.DataFrame({"out_shard": shard, "source": [sources[i] for i in some], "first": first[some], "n": n[some], "blocks": blocks_of[some], "number": some})

    pieces = spark.range(-(-shards // SHARDS_AT_ONCE))
    runs = pieces.mapInPandas(draw, "out_shard int, source string, first bigint, n bigint, blocks bigint, number int")

    @F.pandas_udf("bigint")
    def block_of(it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for at, n, number, turn in it:
            key = (number.to_numpy() * 1_000_003 + turn.to_numpy() * 7_919 + seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield pd.Series(permute(at.to_numpy(), n.to_numpy(), key))

    slots = (
        runs.select("*", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("k"))
        .select("out_shard", "source", "number", "blocks", F.expr("k div blocks").alias("pass"), F.expr("k % blocks").alias("at"))
        .select("out_shard", "source", "pass", block_of("at", "blocks", "number", "pass").alias("block"))
    )
    mixed = slots.join(parts, ["source", "block"]).select(
        "out_shard", "source", "pass", "block", "doc_id", "token_from", "token_to"
    )
    reached = mixed.groupBy("source").agg(
        F.sum(F.col("token_to") - F.col("token_from")).alias("mixed_tokens"), (F.max("pass") + 1).alias("passes")
    )
    planned = spark.createDataFrame(
        [(q.source, names[q.source], q.target_share, q.max_repeats, q.tokens, q.blocks, q.slots, q.short) for q in quotas],
        "key string, source string, target_share double, max_repeats int, tokens bigint, blocks bigint, slots bigint, short boolean",
    )
    got = reached.select(F.col("source").alias("key"), "mixed_tokens", "passes")
    overall = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # over one row a source
    report = planned.join(got, "key", "left").withColumn("all_tokens", overall).select(
        *[c for c in planned.columns if c != "key"],
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("passes", F.lit(0)).cast("bigint").alias("passes"),
    )
    return mixed, report
