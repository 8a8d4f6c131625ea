"""Relational operators on archives: inventories, nearest ancestors, roll-ups, version checks, ordered resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import bare_sha256


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by the order columns, ties by all other columns, so that the result is unique."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(key, *[f"r.{c}" for c in (*order, *rest)]).select(*df.columns)


def compare_inventory(declared: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """(group, path, status) of two tables (group, path, size, sha256): ok, missing, size, hash or extra, in that order of
    precedence. A null declared size or digest is not compared."""
    d = declared.select(group, "path", F.col("size").alias("d_size"), bare_sha256(F.col("sha256")).alias("d_sha"), F.lit(1).alias("d"))
    a = actual.select(group, "path", F.col("size").alias("a_size"), bare_sha256(F.col("sha256")).alias("a_sha"), F.lit(1).alias("a"))
    status = (
        F.when(F.col("d").isNull(), "extra")
        .when(F.col("a").isNull(), "missing")
        .when(F.col("d_size") != F.col("a_size"), "size")
        .when(F.col("d_sha") != F.col("a_sha"), "hash")
        .otherwise("ok")
    )
    return d.join(a, [group, "path"], "full_outer").select(group, "path", status.alias("status"))


def inventory_verdict(compared: DataFrame, group: str, listed: int = 5) -> DataFrame:
    """(group, n_entries, verdict, extras): the first failure in order missing, size, hash, extra; the first extras listed."""
    rank = {"missing": 1, "size": 2, "hash": 3, "extra": 4}
    number = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in rank.items()])
    extras = F.array_sort(F.collect_set(F.when(F.col("status") == "extra", F.col("path"))))
    out = compared.groupBy(group).agg(F.count(F.lit(1)).alias("n_entries"), F.min(number).alias("first"), extras.alias("e"))
    name = F.lit("ok")
    for k, v in rank.items():
        name = F.when(F.col("first") == v, k).otherwise(name)
    shown = F.array_join(F.slice("e", 1, listed), ",")
    return out.select(
        group, "n_entries", name.alias("verdict"), F.when(F.size("e") > listed, F.concat(shown, F.lit(",..."))).otherwise(shown).alias("extras")
    )


def roll_up(df: DataFrame, group: str, part: str, size: str) -> DataFrame:
    """(group, part, n, total): counts and sums per group and part, per group, and over all; null stands for all."""
    return df.rollup(group, part).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.grouping_id().alias("level"))


def priced(df: DataFrame, prices: DataFrame, key: str, default: str) -> DataFrame:
    """Left join to a table by key; keys that it lacks, and null keys, take the row of ``default``.

    A key that stands twice counts once, by its least row; without a row of ``default`` the values are null. A value that
    is null in a key's own row stays null.
    """
    values = [c for c in prices.columns if c != key]
    one = prices.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*values)).alias("_own"))
    fallback = one.where(F.col(key) == default).agg(F.min("_own")).scalar()  # one row whatever the table holds
    joined = df.join(one, key, "left").withColumn("_row", F.coalesce("_own", fallback))
    return joined.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in values])


def ancestor_dirs(path: Column) -> Column:
    """array<string>: all directories above a path, longest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def nearest_owner(paths: DataFrame, owners: DataFrame, unknown: str = "<unknown>") -> DataFrame:
    """(path, owner): the owner of the deepest directory above a path; an equi-join on its ancestors, not a prefix join."""
    up = paths.select("path", F.posexplode(ancestor_dirs(F.col("path"))).alias("rank", "dir"))
    met = up.join(owners.select("dir", "owner"), "dir").groupBy("path").agg(F.min(F.struct("rank", "owner")).alias("m"))
    return paths.select("path").distinct().join(met, "path", "left").select("path", F.coalesce("m.owner", F.lit(unknown)).alias("owner"))


def first_by_priority(files: DataFrame, group: str, patterns: Sequence[str]) -> DataFrame:
    """(group, path): the file of the first pattern that matches any; of several the least path."""
    rank = F.lit(None).cast("int")
    for i in range(len(patterns) - 1, -1, -1):
        rank = F.when(F.col("path").rlike(patterns[i]), F.lit(i)).otherwise(rank)
    return (
        files.withColumn("rank", rank).where("rank is not null").groupBy(group).agg(F.min(F.struct("rank", "path")).alias("m")).select(group, "m.path")
    )


def substitutions(df: DataFrame, version: Sequence[str], digest: str) -> DataFrame:
    """(version columns, n_digests): versions under which more than one content goes."""
    return df.where(F.col(digest).isNotNull()).groupBy(*version).agg(F.count_distinct(digest).alias("n_digests")).where("n_digests > 1")


def resolve_in_order(wanted: DataFrame, key: str, choices: str, offered: DataFrame) -> DataFrame:
    """(key, chosen, position): the first of a row's ordered choices that is offered (one column ``name``); null if none."""
    each = wanted.select(key, F.posexplode(choices).alias("position", "name"))
    met = each.join(offered.select("name").distinct(), "name", "left_semi").groupBy(key).agg(F.min(F.struct("position", "name")).alias("m"))
    return wanted.select(key).distinct().join(met, key, "left").select(key, F.col("m.name").alias("chosen"), F.col("m.position").alias("position"))


def weighted_score(levels: dict[str, Sequence[str]], weights: dict[str, int]) -> Column:
    """0 to 100 from ordered enums: sum of (index / last index) * weight over the sum of weights, rounded half to even.

    Null if any value is null or not in its enum.
    """
    total = F.lit(0.0)
    for name, order in levels.items():
        index = F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name)), F.lit(0)) - 1
        total = total + (index.cast("double") / (len(order) - 1)) * weights[name]
    score = F.bround(total * 100 / sum(weights.values())).cast("int")
    return F.when(score < 0, 0).when(score > 100, 100).otherwise(score)


def band(score: Column, bands: Sequence[tuple[int, str]]) -> Column:
    """The name of the last band whose lower bound the score reaches; bands by rising bound."""
    out = F.lit(None).cast("string")
    for low, name in bands:
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def failed_checks(checks: dict[str, Column]) -> Column:
    """array<string>: the names of the predicates that do not hold, in order; null counts as not holding."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def first_failure(checks: dict[str, Column]) -> Column:
    """The name of the first predicate that does not hold, null if all do."""
    return F.get(failed_checks(checks), F.lit(0))


def known_or_extension(keys: Column, core: Sequence[str], prefix: str = "x-") -> Column:
    """array<string>: the keys that are neither in the core set nor extensions."""
    return F.filter(keys, lambda k: ~k.isin(list(core)) & ~k.startswith(prefix))


def time_bounds(created: Column, expires: Column, now: Column, skew_seconds: int = 30) -> Column:
    """What is wrong with a validity period given as strings with a time zone, null if nothing; the first of: missing,
    unparseable, created in the future beyond the skew, expired, expired before creation."""
    zoned = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"
    parse = lambda c: F.when(c.rlike(zoned), F.try_to_timestamp(c))
    start, end = parse(created), parse(expires)
    return (
        F.when(created.isNull() | expires.isNull() | (created == "") | (expires == ""), "missing")
        .when(start.isNull(), "created_unparseable")
        .when(end.isNull(), "expires_unparseable")
        .when(start > now + F.make_dt_interval(secs=F.lit(skew_seconds)), "created_in_future")
        .when(end <= now, "expired")
        .when(end <= start, "expires_before_created")
    )


def coverage(items: DataFrame, wanted: DataFrame, have: DataFrame, item: str, want: str) -> DataFrame:
    """(item, want): the wanted entries that an item lacks; ``wanted`` is a short list, joined by explosion, not crossed."""
    names = [r[0] for r in wanted.select(want).distinct().orderBy(want).limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("too many wanted entries")
    full = items.select(item).distinct().select(item, F.explode(F.array(*[F.lit(n) for n in names])).alias(want))
    return full.join(have.select(item, want), [item, want], "left_anti")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of every group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
