"""Events in time: changes of a state, windows that open, close and can be cancelled, reports of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(key, *order, before, after): the rows of a key whose state differs from that of the row before; the first of a key
    counts with null before. Null states are states; ties of ``order`` are settled by the state."""
    w = Window.partitionBy(key).orderBy(*order, state)
    seen = df.select(key, *order, F.lag(state).over(w).alias("before"), F.col(state).alias("after"), F.row_number().over(w).alias("k"))
    return seen.where((F.col("k") == 1) | ~F.col("before").eqNullSafe(F.col("after"))).drop("k")


def dispute_windows(events: DataFrame, key: str, event: str, time: str, trigger: Column, cancel: Column, now: Column, days: int = 7) -> DataFrame:
    """(key, event, opened_at, closes_at, status): every trigger opens a window of some days; it is cancelled by the first
    cancelling event of its key after it and before its end, else expired when it is past, else open.

    Triggers meet cancelling events on key and stretch of ``days``, in their own stretch and the next, so that a key with
    very many events is spread over its stretches of time. Rows without key or time open and cancel nothing.
    """
    stretch = F.floor(F.unix_seconds(F.col(time)) / (days * 86400))
    known = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    opened = known.where(trigger).select(key, F.col(event).alias("_event"), F.col(time).alias("opened_at"), (F.col(time) + F.make_dt_interval(days=F.lit(days))).alias("closes_at"), stretch.alias("s"))
    ended = known.where(cancel).select(key, F.col(time).alias("at"), stretch.alias("s"))
    reach = opened.withColumn("s", F.explode(F.array("s", F.col("s") + 1)))
    met = reach.join(ended, [key, "s"]).where((F.col("at") > F.col("opened_at")) & (F.col("at") < F.col("closes_at")))
    cancelled = met.select(key, "_event", "opened_at").distinct().withColumn("cancelled", F.lit(True))
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("closes_at") <= now, "expired").otherwise("open")
    return opened.drop("s").join(cancelled, [key, "_event", "opened_at"], "left").select(key, F.col("_event").alias(event), "opened_at", "closes_at", status.alias("status"))


def run_report(steps: DataFrame, step: str, passed: str) -> DataFrame:
    """(step, n, n_failed, passed) per step and over all (null step); a null result counts as failed."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    return steps.rollup(step).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("n_failed"), F.every(ok).alias("passed"))
