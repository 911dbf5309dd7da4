"""Order-dependent folds over sorted arrays, kept inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, item: str, budget: int | str, truncate_first: bool = False) -> DataFrame:
    """Greedy packing: in order, each item that still fits the remaining budget is taken, others are skipped.

    With ``truncate_first`` an oversized first item is cut to the budget and ends the package. A request's
    items form one array; requests are bounded by the retrieval limit before they get here. ``budget`` may name a column.
    """
    whole = F.max(budget) if isinstance(budget, str) else F.lit(budget)
    listed = rows.withColumn("_o", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    grouped = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", F.col(size).cast("long").alias("n"), F.col(item).alias("i")))).alias("all"), whole.cast("long").alias("_whole"))
    kind = f"array<{listed.schema[item].dataType.simpleString()}>"
    start = F.struct(F.array().cast(kind).alias("taken"), F.col("_whole").alias("left"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["over"] & (x["n"] <= acc["left"])
        cut = F.lit(truncate_first) & ~fits & ~acc["over"] & (F.size(acc["taken"]) == 0) & (acc["left"] > 0)
        take = fits | cut
        return F.struct(
            F.when(take, F.concat(acc["taken"], F.array(x["i"]))).otherwise(acc["taken"]).alias("taken"),
            F.when(fits, acc["left"] - x["n"]).when(cut, F.lit(0).cast("long")).otherwise(acc["left"]).alias("left"),
            (acc["over"] | cut | (fits & (acc["left"] - x["n"] <= 0))).alias("over"),
        )

    folded = grouped.withColumn("f", F.aggregate("all", start, step))
    return folded.select(*keys, F.col("f.taken").alias("items"), (F.col("_whole") - F.col("f.left")).alias("used"))


def clamped_sums(events: DataFrame, keys: Sequence[str], order: Sequence[str], deltas: dict[str, str], bucket: Column | None = None, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(keys, steps, and for each name a struct (low, high, shift)): what a sequence of clamped steps does to a score.

    Clamped steps compose: any run of them maps x to min(high, max(low, x + shift)). With ``bucket``, a column that never
    falls along the order, runs are folded by (keys, bucket) and their maps after that, so a key with very many
    events is never one array. ``apply_clamped`` gives the score.
    """
    bucket = F.lit(0) if bucket is None else bucket
    d = events.withColumn("_b", bucket)
    run = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).cast("double").alias(f"_d{i}") for i, c in enumerate(deltas.values())])))
    clamp = lambda x, a, b: F.greatest(a, F.least(b, x))
    none = F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0.0).alias("shift"))

    def then(acc: Column, a: Column, b: Column, c: Column) -> Column:
        return F.struct(clamp(acc["low"] + c, a, b).alias("low"), clamp(acc["high"] + c, a, b).alias("high"), (acc["shift"] + c).alias("shift"))

    lo, hi = F.lit(float(low)), F.lit(float(high))
    step = lambda i: lambda acc, x: then(acc, lo, hi, x[f"_d{i}"])
    join = lambda i: lambda acc, x: then(acc, x[f"_m{i}"]["low"], x[f"_m{i}"]["high"], x[f"_m{i}"]["shift"])
    runs = d.groupBy(*keys, "_b").agg(run.alias("_r"), F.count("*").alias("_n"))
    runs = runs.select(*keys, "_b", "_n", *[F.aggregate("_r", none, step(i)).alias(f"_m{i}") for i in range(len(deltas))])
    maps = runs.groupBy(*keys).agg(F.sum("_n").alias("steps"), F.array_sort(F.collect_list(F.struct("_b", *[f"_m{i}" for i in range(len(deltas))]))).alias("_r"))
    whole = [F.aggregate("_r", none, join(i)).alias(name) for i, name in enumerate(deltas)]
    return maps.select(*keys, "steps", *whole)


def apply_clamped(effect: Column, start: Column) -> Column:
    """The score after the steps, from a start."""
    return F.greatest(effect["low"], F.least(effect["high"], start + effect["shift"]))


def clamped_sum(events: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str, start: float = 0.5, low: float = 0.0, high: float = 1.0, bucket: Column | None = None) -> DataFrame:
    """A running value clamped to [low, high] after every step; a plain sum gives other results."""
    d = clamped_sums(events, keys, order, {"_e": delta}, bucket, low, high)
    return d.select(*keys, apply_clamped(F.col("_e"), F.lit(float(start))).alias("score"), "steps")


def contains_in_order(actual: Column, expected: Column) -> Column:
    """Whether ``expected`` is a subsequence of ``actual``."""
    n = F.size(expected)
    at = F.aggregate(actual, F.lit(0), lambda acc, x: acc + F.when((acc < n) & (F.get(expected, acc) == x), 1).otherwise(0))
    return at == n


def segments(turns: DataFrame, keys: Sequence[str], order: str, starts: Column) -> DataFrame:
    """Turns numbered by segment: a new one begins at each row where ``starts`` holds."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def sessions(events: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], gap_s: float) -> DataFrame:
    """Events numbered by session: a gap of more than ``gap_s`` seconds starts a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    return events.withColumn("_new", F.when(gap.isNull() | (gap > gap_s), 1).otherwise(0)).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
