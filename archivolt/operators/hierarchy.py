"""Parent-child links to full hierarchies.

Frontier joins from the roots. A frontier of one level a round would need as many rounds as the tree is deep; here the
frontier of round ``k`` is the whole range of depths ``[2**k, 2**(k+1))``: every node that is not reached yet keeps a
pointer to its ``2**k``-th ancestor, and one equi-join on that pointer either meets a node that has been reached (the
node gets root, depth and path from it) or doubles the pointer. A tree of depth ``d`` takes ``log2(d) + 2`` joins, each on
a unique key, so a record that holds a third of all events costs no more than any other. Ranges of depth are contiguous:
a round that reaches nothing proves that all that remain lie on a circle or below one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from archivolt.runtime import cut, save

#: rows of up to so many values (ids of some 40 bytes, so about 40 MB) are broadcast
BROADCAST_VALUES = 1_000_000
HEX64 = r"^(?:sha-?256)?[:=]?([0-9a-f]{64})$"


def hex_digits(col: Column) -> Column:
    """The 64 hex digits of a hash in any spelling (letter case, prefix, blanks), else null."""
    bare = F.regexp_replace(F.lower(col), r"[\s 　]+", "")
    return F.nullif(F.regexp_extract(bare, HEX64, 1), F.lit(""))


def parent_links(events: DataFrame) -> DataFrame:
    """(node, parent): one row per distinct non-null event_id of an audit log.

    The parent is the event of the same record whose hash has the digits of prev_hash. Of repeated deliveries of an
    event_id the first ingested counts; of several events with one hash in a record the least event_id. A null
    record_id, prev_hash or hash matches nothing, so the event is a root. Columns beside those named are ignored.
    """
    first = (
        events.where(F.col("event_id").isNotNull())
        .groupBy("event_id")
        .agg(F.min(F.struct("ingested_at", "record_id", "hash", "prev_hash")).alias("e"))
        .select(
            F.col("event_id").alias("node"),
            F.col("e.record_id").alias("grp"),
            hex_digits(F.col("e.hash")).alias("own"),
            hex_digits(F.col("e.prev_hash")).alias("prev"),
        )
    )
    owners = (
        first.where("grp is not null and own is not null").groupBy("grp", "own").agg(F.min("node").alias("parent"))
    ).select("grp", F.col("own").alias("prev"), "parent")
    # rows without a predecessor never enter the join: null keys would all meet in one task
    linked = first.where("grp is not null and prev is not null").join(owners, ["grp", "prev"], "left")
    plain = first.where("grp is null or prev is null").withColumn("parent", F.lit(None).cast("string"))
    return linked.select("node", "parent").unionByName(plain.select("node", "parent"))


def _start(links: DataFrame, with_paths: bool, marks: bool) -> DataFrame:
    """The links as state of round 0: roots are reached, all others point to their parent."""
    marked = F.col("marked") if marks else F.lit(False)
    known = links.select(F.col("node").alias("parent"), F.lit(True).alias("known"), marked.alias("above"))
    joined = links.where("parent is not null").select("node", "parent").join(known, "parent", "left")
    rows = joined.select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), "above").unionByName(
        links.where("parent is null").select("node", "parent", F.lit(False).alias("above"))
    )
    root = F.col("parent").isNull()
    return rows.select(
        "node", "parent", F.col("parent").alias("ptr"), F.when(root, F.col("node")).alias("root"), F.when(root, 0).cast("int").alias("depth"),
        *([F.array("node").alias("path")] if with_paths else []),
        *([F.when(F.col("above"), F.struct(F.lit(1).alias("distance"), F.col("parent").alias("node"))).alias("near")] if marks else []),
    )


def build_hierarchy(links: DataFrame, with_paths: bool = False, marks: bool = False, doubling: bool = True) -> DataFrame:
    """(node, parent, root, depth, cyclic[, path][, near]) of a table (node, parent[, marked]) with unique, non-null nodes.

    A parent that is null or no node makes a root (depth 0, own root). Nodes on a circle or below one have
    ``cyclic = true`` and null root, depth, path and near. ``path`` runs from the root to the node, both included. With
    ``marks``, ``near`` is the (distance, node) of the nearest proper ancestor whose ``marked`` is true, null if there is
    none. Without ``doubling`` a frontier is one level. Empty input gives an empty result.

    Links are read once. A node is written once when it is reached, and in the rounds before it; rows that have been
    reached are never written again. Every round is a table in the checkpoint folder, so a lost executor costs a round.
    """
    extra = [*(["path"] if with_paths else []), *(["near"] if marks else [])]
    first = _start(links, with_paths, marks)
    # what the rows not reached yet hold, in values; few enough are sent to all tasks instead of shuffling what is reached
    values = F.sum(F.when(F.col("root").isNull(), 3 + (F.size("path") if with_paths else 0) + (2 if marks else 0)))
    seen = Observation()
    rounds, step = [save(first.observe(seen, values.alias("open")))], 1  # the tables of the rounds so far: rows that a round has reached, and those it has not

    def rows(of: list[str], met: bool) -> DataFrame:
        table = links.sparkSession.read.schema(first.schema).parquet(*of)
        return table.where(F.col("root").isNotNull() if met else F.col("root").isNull())

    while True:
        pending = rows(rounds[-1:], met=False)
        # a frontier that doubles may meet any reached node or a pending one, one of a single level only the level before
        frontier = rows(rounds, met=True).unionByName(pending) if doubling else rows(rounds[-1:], met=True)
        target = frontier.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr_t"), "root", "depth", *[F.col(c).alias(f"{c}_t") for c in extra])
        few = doubling and (seen.get["open"] or 0) <= BROADCAST_VALUES
        mine = pending.select("node", "parent", "ptr", *extra)
        moved = (F.broadcast(mine) if few else mine).join(target, "ptr", "inner" if doubling else "left")
        met = F.col("root").isNotNull()
        longer = F.concat("path_t", "path") if with_paths else None
        further = F.when(F.col("near_t").isNotNull(), F.struct((F.col("near_t.distance") + step).cast("int").alias("distance"), F.col("near_t.node").alias("node"))) if marks else None
        seen = Observation()
        rounds.append(save(
            moved.select(
                "node", "parent", F.when(~met, F.col("ptr_t") if doubling else F.col("ptr")).alias("ptr"), "root", (F.col("depth") + step).cast("int").alias("depth"),
                *([(longer if doubling else F.when(met, longer).otherwise(F.col("path"))).alias("path")] if with_paths else []),
                *([F.coalesce("near", further).alias("near")] if marks else []),
            ).observe(seen, F.count("root").alias("met"), values.alias("open"))
        ))
        if not seen.get["met"]:
            break
        step = step * 2 if doubling else 1
    circular = rows(rounds[-1:], met=False).select(
        "node", "parent", "root", "depth", F.lit(True).alias("cyclic"), *[F.lit(None).cast(first.schema[c].dataType).alias(c) for c in extra]
    )
    return rows(rounds, met=True).select("node", "parent", "root", "depth", F.lit(False).alias("cyclic"), *extra).unionByName(circular)


def ancestor_pairs(hierarchy: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): every proper ancestor of every node, from the paths."""
    return (
        hierarchy.where("path is not null and depth > 0")
        .select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
        .where("pos < depth")
        .select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )


def descendant_counts(hierarchy: DataFrame) -> DataFrame:
    """(node, path, n_children, n_descendants, height) for every node reached from a root; leaves have zeros.

    The paths are dealt out in ranges of their order, so that what lies below one node lies together and is counted
    before it is shuffled; a node with very much below it spreads over several ranges. Each node also gives a zero of its
    own, so that no join is needed.
    """
    paths = hierarchy.where("path is not null").select("path").repartitionByRange("path")
    last = F.size("path") - 1
    each = paths.select(
        F.posexplode("path").alias("pos", "node"), last.alias("depth"), F.col("path").alias("whole")
    ).select("node", (F.col("depth") - F.col("pos")).alias("distance"), F.when(F.col("pos") == F.col("depth"), F.col("whole")).alias("path"))
    return each.groupBy("node").agg(
        F.max("path").alias("path"),
        F.count_if(F.col("distance") == 1).alias("n_children"),
        F.count_if(F.col("distance") > 0).alias("n_descendants"),
        F.max("distance").cast("int").alias("height"),
    )


def circles(links: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(node, on_circle): the nodes that no root reaches; ``on_circle`` is false for those that only hang below one.

    Peels nodes without a child inside the set, level range by level range: after doubling the pointers past the size
    of the set, every pointer rests on a circle, and every node of a circle is pointed at.
    """
    state = cut(hierarchy.where("cyclic").select("node", F.col("parent").alias("ptr")))
    n, step = state.count(), 1
    while step < n:
        nxt = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr_t"))
        state = cut(state.join(nxt, "ptr").select("node", F.col("ptr_t").alias("ptr")))
        step *= 2
    on = state.select(F.col("ptr").alias("node")).distinct().withColumn("on_circle", F.lit(True))
    return state.select("node").join(on, "node", "left").select("node", F.coalesce("on_circle", F.lit(False)).alias("on_circle"))
