"""Filling fixed-capacity containers: conflict-constrained best fit.

Items are dealt to shards by a hash of their id; a shard holds a bounded number of ids and sizes (never texts), so the
number of shards grows with the table and a hot source or group of copies is spread evenly over all of them. Within a
shard, items go in falling size into the bin with the least room that still takes them. Bins are ordered by residual
capacity and carry two bitmaps: the sources and the duplicate clusters of what they hold. An item may not enter a bin
that holds a copy of it (copies in one container waste it) or a source that its own source must not meet; the successor
search goes on over larger residuals until the tightest compatible bin is found, and a new bin is opened only when there
is none. What remains open costs less than one container per shard and conflict.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.tokens import WHITE, clean_source, token_count
from archivolt.runtime import groups_for, salt

ROWS_PER_SHARD = 20_000
UNKNOWN = "?"
RESULT = "doc_id bigint, piece int, container_id bigint, n_tokens bigint, token_start bigint, is_split boolean"


class Bins:
    """Open bins of one shard, by residual capacity and then by source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []
        self.by_residual: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.opened = 0

    def put(self, residual: int, sources: int, number: int, clusters: int) -> None:
        """Files a bin under its residual; a full bin is closed."""
        if residual <= 0:
            return
        slot = self.by_residual.get(residual)
        if slot is None:
            slot = self.by_residual[residual] = {}
            insort(self.residuals, residual)
        slot.setdefault(sources, []).append((number, clusters))

    def take(self, size: int, banned: int, cluster_bit: int) -> tuple[int, int, int, int] | None:
        """Removes and returns the tightest bin with room for ``size``, no banned source and no copy of the item."""
        for at in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[at]
            slot = self.by_residual[residual]
            for sources, bins in slot.items():
                if sources & banned:
                    continue
                for i in range(len(bins) - 1, -1, -1):
                    if not bins[i][1] & cluster_bit:
                        number, clusters = bins[i]
                        bins[i] = bins[-1]
                        bins.pop()
                        if not bins:
                            del slot[sources]
                            if not slot:
                                del self.by_residual[residual]
                                del self.residuals[at]
                        return residual, sources, number, clusters
        return None

    def open(self) -> int:
        """The number of a new bin."""
        self.opened += 1
        return self.opened - 1


def best_fit(
    items: Iterable[tuple[int, int, int, int]], capacity: int, banned_by_source: Mapping[int, int]
) -> list[int]:
    """The bin of each item (size, source bit, cluster bit, any), given in falling size with equal clusters together.

    Copies of one text have one size, so they stand together; bins that got a copy are held back until the run ends
    instead of being searched again by the next copy.
    """
    bins, result = Bins(capacity), []
    held: list[tuple[int, int, int, int]] = []
    run = (0, 0)
    for size, source, cluster, _ in items:
        if (size, cluster) != run or not cluster:
            for b in held:
                bins.put(*b)
            held, run = [], (size, cluster)
        found = bins.take(size, banned_by_source.get(source, 0), cluster)
        if found is None:
            residual, sources, number, clusters = capacity, 0, bins.open(), 0
        else:
            residual, sources, number, clusters = found
        result.append(number)
        entry = (residual - size, sources | source, number, clusters | cluster)
        if cluster:
            held.append(entry)
        else:
            bins.put(*entry)
    return result


#: stands for a null id between the JVM and pandas, where whole numbers have no null; the least number, so no id of use
NO_ID = -(1 << 63)


def pack_shard(pdf: pd.DataFrame, capacity: int, apart: Mapping[str, frozenset[str]]) -> pd.DataFrame:
    """Packs the items of one shard (doc_id, n_tokens, source, cluster, shard)."""
    shard = int(pdf["shard"].iloc[0])
    names = sorted(set(pdf["source"]))
    bit = {name: 1 << i for i, name in enumerate(names)}
    banned = {
        bit[a]: sum(bit[b] for b in names if b in apart.get(a, ()) or a in apart.get(b, ())) for a in names
    }
    known = bit[UNKNOWN] if UNKNOWN in bit else 0
    if known:  # documents of unknown source never share a container with documents of a known one
        for name in names:
            banned[bit[name]] |= known if name != UNKNOWN else sum(v for n, v in bit.items() if n != UNKNOWN)
    counts = pdf["cluster"].value_counts()
    cluster_bit = {c: 1 << i for i, c in enumerate(counts.index[counts > 1])}
    rows, out = [], []
    for doc, n, source, cluster in zip(pdf["doc_id"], pdf["n_tokens"], pdf["source"], pdf["cluster"], strict=True):
        whole, rest = divmod(int(n), capacity)
        split = n > capacity
        for k in range(whole):
            out.append((int(doc), k, -1, capacity, k * capacity, split))
        if rest or not n:
            rows.append((rest, cluster, int(doc), whole, bit[source], split))
    rows.sort(key=lambda r: (-r[0], r[1], r[2]))
    where = best_fit(((r[0], r[4], cluster_bit.get(r[1], 0), 0) for r in rows), capacity, banned)
    n_bins = max(where, default=-1) + 1
    out = [(d, k, n_bins + i, n, s, sp) for i, (d, k, _, n, s, sp) in enumerate(out)]
    out += [(r[2], r[3], b, r[0], r[3] * capacity, r[5]) for r, b in zip(rows, where, strict=True)]
    result = pd.DataFrame(out, columns=["doc_id", "piece", "container_id", "n_tokens", "token_start", "is_split"])
    result["container_id"] += shard << 40
    return result


def pack(
    documents: DataFrame,
    capacity: int = 1024,
    apart: Mapping[str, Iterable[str]] | None = None,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> DataFrame:
    """(doc_id, piece, container_id, n_tokens, token_start, is_split): where every document went.

    Takes (doc_id, text, source); other columns are ignored. Only a document of more than ``capacity`` tokens is split:
    into full pieces, each filling a container, and a rest that is packed like any other item. A null or empty text
    has 0 tokens and takes a place in a container without using room. A null doc_id or source is kept (source as
    unknown); repeated rows are packed once each. ``apart`` names sources that must not share a container.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    keep_apart = {a: frozenset(b) for a, b in (apart or {}).items()}
    shards = groups_for(documents.count(), rows_per_shard)
    spaced = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{WHITE}]+", " "))
    items = documents.select(
        "doc_id",
        token_count(F.col("text")).alias("n_tokens"),
        F.coalesce(clean_source(F.col("source")), F.lit(UNKNOWN)).alias("source"),
        F.xxhash64(spaced).alias("cluster"),
        salt(F.col("doc_id"), shards).alias("shard"),
    ).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_tokens", "source", "cluster", "shard")
    packed = items.groupBy("shard").applyInPandas(lambda pdf: pack_shard(pdf, capacity, keep_apart), RESULT)
    return packed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def fill_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """(n_containers, n_pieces, n_tokens, fill): how full the containers are, over all of them."""
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n").alias("n_pieces"),
        F.sum("used").alias("n_tokens"),
        (F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"),
    )


