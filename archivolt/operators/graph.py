"""Co-mention graphs: named entities of context units, nodes with salience, edges between neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import let

CANDIDATE = r"(?U)\b[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}\b"
# fixed values: single words that are never an entity
STOP_WORDS = (
    "A An And As At But By For From He Her His I In Is It Its My No Of On Or She So That The Their Then There These They This "
    "Those To Was We Were What When Where Which Who Why With You Your"
).split()


def candidates(text: Column) -> Column:
    """array<string>: the capitalised runs of a unit in order of first mention, one per lower-case form."""
    runs = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    names = F.filter(runs, lambda c: F.contains(c, F.lit(" ")) | ~c.isin(STOP_WORDS))
    low = F.transform(names, lambda c: F.lower(c))
    return let(low, lambda keys: F.filter(names, lambda c, i: F.array_position(keys, F.lower(c)) == i + 1))


def mentions(units: DataFrame, group: str, unit: list[str], text: str = "text", min_mentions: int = 1) -> DataFrame:
    """(group, *unit, pos, key, label): mentions of the entities that at least ``min_mentions`` units of their group hold."""
    each = units.select(group, *unit, F.posexplode_outer(candidates(F.col(text))).alias("pos", "label")).where("label is not null").withColumn("key", F.lower("label"))
    if min_mentions <= 1:
        return each
    frequent = each.groupBy(group, "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_mentions)
    return each.join(frequent.select(group, "key"), [group, "key"], "left_semi")


#: most aliases of a node
MAX_ALIASES = 64


def node_id(group: Column, key: Column) -> Column:
    """The id of a node, derived from its group and key."""
    return F.concat(F.lit("node_"), F.left(F.sha2(F.concat_ws("\u0001", group.cast("string"), key), 256), F.lit(12)))


def nodes(found: DataFrame, group: str, unit: list[str]) -> DataFrame:
    """(group, key, label, mentions, salience, node_id, aliases): label is the most frequent form, the first seen of equals;
    aliases are the other forms in the order in which they were first seen, at most ``MAX_ALIASES``."""
    forms = found.groupBy(group, "key", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*unit, "pos")).alias("first"))
    per = forms.groupBy(group, "key").agg(
        F.sum("n").alias("mentions"), F.min(F.struct((-F.col("n")).alias("n"), "first", "label")).alias("best"),
        F.array_sort(F.collect_list(F.struct("first", "label"))).alias("forms"),
    )
    top = F.max("mentions").over(Window.partitionBy(group))
    return per.select(
        group,
        "key",
        F.col("best.label").alias("label"),
        "mentions",
        (F.col("mentions") / top).alias("salience"),
        node_id(F.col(group), F.col("key")).alias("node_id"),
        F.slice(F.filter(F.transform("forms", lambda f: f["label"]), lambda x: x != F.col("best.label")), 1, MAX_ALIASES).alias("aliases"),
    )


def links(edges: DataFrame, group: str) -> DataFrame:
    """The edges with subject_node_id and object_node_id in place of the keys."""
    kept = [c for c in edges.columns if c not in ("source", "target")]
    return edges.select(*kept, node_id(F.col(group), F.col("source")).alias("subject_node_id"), node_id(F.col(group), F.col("target")).alias("object_node_id"))


def edges(found: DataFrame, group: str, unit: list[str]) -> DataFrame:
    """(group, *unit, pos, source, target): each mention with the next one of its unit; n mentions make n - 1 edges."""
    following = F.lead("key").over(Window.partitionBy(group, *unit).orderBy("pos"))
    return (
        found.withColumn("target", following)
        .where("target is not null and target <> key")
        .select(group, *unit, "pos", F.col("key").alias("source"), "target")
    )
