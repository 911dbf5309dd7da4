"""Joins and selections along time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def around(events: DataFrame, at: Column, ts: str, key: str, n: int, tie: str | None = None) -> DataFrame:
    """The ``n`` events before a time and the ``n`` at or after it, with column ``side``, both in time order.

    Events of one time are ordered by ``tie`` (nulls last) and ``key``.
    """
    by = [ts, *([tie] if tie else []), key]
    before = events.where(F.col(ts) < at).orderBy(*[F.desc_nulls_first(c) for c in by]).limit(n).withColumn("side", F.lit("before"))
    after = events.where(F.col(ts) >= at).orderBy(*[F.asc_nulls_last(c) for c in by]).limit(n).withColumn("side", F.lit("after"))
    return before.unionByName(after).orderBy(*[F.asc_nulls_last(c) for c in by])


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, take: Sequence[str], bucket_s: int | None = None) -> DataFrame:
    """For each left row the last right row of its key at or before its time.

    One union and one window over (key, time): linear, and no range join. Right rows sort before left rows of
    the same time. With ``bucket_s`` the window is one of (key, time bucket), so that a busy key is many tasks: the last
    right row of each bucket is found first, and each bucket begins with the last one of those before it.
    """
    held = F.struct(F.col(right_ts).alias("_ts"), *[F.col(c) for c in take])
    number = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bucket_s) if bucket_s else F.lit(0).cast("long")
    r = right.select(*keys, number(right_ts).alias("_b"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), held.alias("_held"))
    l = left.select(*keys, number(left_ts).alias("_b"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = l.unionByName(r, allowMissingColumns=True)
    if bucket_s:
        ends = r.groupBy(*keys, "_b").agg(F.max_by("_held", "_t").alias("_end"))
        every = l.select(*keys, "_b").unionByName(r.select(*keys, "_b")).distinct().join(ends, [*keys, "_b"], "left")
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        begin = every.select(*keys, "_b", F.lit(-1).alias("_side"), before.alias("_held")).where("_held is not null")
        both = both.unionByName(begin, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy(F.asc_nulls_first("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_held", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in take])


def points_in_intervals(points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, bucket_s: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of points and half-open intervals that hold them, by an equi join on time buckets.

    Intervals are listed under each bucket they touch; choose ``bucket_s`` near their usual length.
    """
    b = lambda c: F.floor(F.unix_timestamp(c) / bucket_s)
    p = points.withColumn("_b", b(F.col(ts)))
    i = intervals.withColumn("_b", F.explode(F.sequence(b(F.col(start)), b(F.col(end)))))
    return p.join(i, [*keys, "_b"]).where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_b")


def within_distance(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of equal ``keys`` at most ``seconds`` apart: buckets of that length and their neighbours."""
    b = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    l = left.withColumn("_b", F.explode(F.array(*[b(F.col(left_ts)) + d for d in (-1, 0, 1)])))
    r = right.withColumn("_b", b(F.col(right_ts)))
    apart = F.abs(F.unix_micros(F.col(left_ts).cast("timestamp")) - F.unix_micros(F.col(right_ts).cast("timestamp")))
    return l.join(r, [*keys, "_b"]).where(apart <= seconds * 1_000_000).drop("_b")


def superseded(facts: DataFrame, keys: Sequence[str], value: str, start: str, end: str) -> DataFrame:
    """``facts`` with ``end`` closed at the first later start of a different value of the same key (as far as it is open or later)."""
    w = Window.partitionBy(*keys).orderBy(start)
    # The next start with another value: group runs of equal values, then take the first start of the next run.
    run = F.sum(F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(start).over(w).isNotNull(), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = facts.withColumn("_run", run)
    first = runs.groupBy(*keys, "_run").agg(F.min(start).alias("_next")).withColumn("_run", F.col("_run") - 1)
    return runs.join(first, [*keys, "_run"], "left").withColumn(end, F.least(F.col(end), F.col("_next"))).drop("_run", "_next")


def chains(events: DataFrame, episode: str, ts: str, key: str, types: Sequence[str], kind: str, limit: int, fields: Sequence[str]) -> DataFrame:
    """The first ``limit`` episodes by their earliest event, each with its causal steps in time order."""
    chosen = events.groupBy(episode).agg(F.min(ts).alias("started")).orderBy("started", episode).limit(limit)
    steps = events.where(F.col(kind).isin(*types)).join(chosen, episode)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(ts), F.col(key), *[F.col(c) for c in fields if c not in (ts, key)])))
    return steps.groupBy(episode, "started").agg(ordered.alias("steps"))


#: What ends with its episode, and which outcomes end an episode. Fixed values.
ENDING_KINDS, ENDED = ("cause", "impact"), ("resolved", "closed")


def backfill(facts: DataFrame, episodes: DataFrame, keys: Sequence[str] = ("subject_entity_id", "predicate", "fact_kind"), value: str = "object_value") -> DataFrame:
    """``facts`` with times from their episodes and supersession, and ``filled`` (the rules that changed a row).

    Starts come from the episode's start; causes and impacts end with an episode that was resolved or closed; an active fact
    ends, and is superseded, where the first active fact of its key with another value starts later and before it ends. Starts
    of a key are visited once, in order: runs of one value are passed over, so no fact meets all others of its key.
    """
    e = episodes.select("episode_id", F.col("start_at").alias("_start"), F.col("end_at").alias("_end"), F.col("outcome").alias("_outcome"))
    d = facts.join(e, "episode_id", "left")
    began = F.col("valid_from").isNull() & F.col("_start").isNotNull()
    ended = F.col("valid_to").isNull() & F.col("_end").isNotNull() & F.col("_outcome").isin(*ENDED) & F.col("fact_kind").isin(*ENDING_KINDS)
    d = d.withColumns({"_began": began, "_ended": F.coalesce(ended, F.lit(False)), "valid_from": F.coalesce("valid_from", "_start"), "valid_to": F.when(ended, F.col("_end")).otherwise(F.col("valid_to"))})

    said = F.coalesce(F.col(value).cast("string"), F.lit(""))
    active = d.where((F.col("current_status") == "active") & F.col("valid_from").isNotNull())
    for k in keys:
        active = active.where(F.col(k).isNotNull())
    starts = active.groupBy(*keys, F.col("valid_from").alias("_t")).agg(F.min(said).alias("_low"), F.max(said).alias("_high"))
    w = Window.partitionBy(*keys).orderBy("_t")
    one = F.when(F.col("_low") == F.col("_high"), F.col("_low"))  # null where a start has several values
    new = ~F.coalesce((one == F.lag(one).over(w)), F.lit(False))
    starts = starts.withColumn("_one", one).withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = starts.groupBy(*keys, "_run").agg(F.min("_t").alias("_from"))
    runs = runs.withColumn("_after", F.lead("_from").over(Window.partitionBy(*keys).orderBy("_run"))).drop("_from")
    starts = starts.join(runs, [*keys, "_run"])
    follow = lambda c: F.lead(c).over(w)
    starts = starts.select(*keys, F.col("_t").alias("valid_from"), follow("_t").alias("_next"), follow("_one").alias("_next_one"), follow("_after").alias("_next_after"))
    d = d.join(starts, [*keys, "valid_from"], "left")
    other = F.when(F.col("_next_one") == said, F.col("_next_after")).otherwise(F.col("_next"))
    over = F.coalesce((F.col("current_status") == "active") & other.isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > other)), F.lit(False))
    rules = F.array_compact(F.array(F.when(F.col("_began"), "start"), F.when(F.col("_ended"), "end"), F.when(over, "superseded")))
    d = d.withColumns({"filled": rules, "valid_to": F.when(over, other).otherwise(F.col("valid_to")), "current_status": F.when(over, "superseded").otherwise(F.col("current_status"))})
    return d.select(*facts.columns, "filled")
