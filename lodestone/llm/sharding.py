"""Balanced label propagation over documents with equal texts, with DataFrame functions only.

Documents start in random shards. In each round the links' ends meet: parts of a group of linked documents (the
documents of one text that are in one shard) are joined with the shards of all parts of the group, and move to
the shard that most of their neighbours are in, as far as quotas allow: a shard takes linked documents only up to
its capacity. Quotas come from the 8 by 8 table of wished moves; where a shard has too little room, a hash of
the group decides which of the wishes are granted. Rounds end when no move is wished or none can be granted.

Groups larger than a shard (fewer than shards + 1 of them exist) fill whole shards first, the largest first, so
they lie in as few shards as they can; the room that is left is what the others start in and move into.

Afterwards the law ``rows`` is met exactly: the tail of each shard beyond its capacity (unlinked documents come
last, so groups are cut only if nothing else is left) goes to the free slots of the others, by arithmetic on ranks.
Ranks are counted within (shard, kind, hash bucket); a group of more than ``PART`` documents is dealt to several
buckets, so no shard or group is ever sorted in one task. The join of documents with their group's moves is on (text,
shard); adaptive execution splits hot ones.

Defined cases: null text has size 1 and crc32 0 and is linked to nothing; empty texts are equal texts;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BUCKETS, PART = 512, 1000


def _quotas(load: list[float], cap: list[int], wish: dict[tuple[int, int], float]) -> list[float]:
    """For each shard, the share of the moves into it that is granted."""
    n = len(load)
    into = [sum(v for (_, j), v in wish.items() if j == s) for s in range(n)]
    grant = [1.0] * n
    for _ in range(20):  # what leaves depends on what the others take
        out = [sum(v * grant[j] for (i, j), v in wish.items() if i == s) for s in range(n)]
        grant = [min(1.0, max(0.0, cap[s] - load[s] + out[s]) / into[s]) if into[s] else 1.0 for s in range(n)]
    return grant


def _pick(values: list, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), by.cast("int") + 1)


def _dealt(by: Column, weights: list[int]) -> Column:
    """The index that a draw from 0 to 1 falls on, by weights."""
    total = sum(weights)
    out, ends = F.lit(max(range(len(weights)), key=lambda i: weights[i])), list(accumulate(weights))
    for i in reversed(range(len(weights))):
        if weights[i]:
            out = F.when(by < ends[i] / total, F.lit(i)).otherwise(out)
    return out.cast("int")


def _draw(seed: int, *by: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 20)) / F.lit(float(1 << 20))


def propagate(groups: DataFrame, cap: list[int], rounds: int = 8) -> DataFrame:
    """groups: (h1, h2, start, n, ...); the result has ``shard`` as well."""
    g = groups.withColumn("shard", F.col("start"))
    for r in range(rounds):
        held = g.groupBy("h1", "h2", "shard").agg(F.sum("n").alias("held")).withColumnRenamed("shard", "near")
        met = g.join(held, ["h1", "h2"])  # every part with its neighbours' shards, at most shards squared rows for a group
        order = F.struct("held", F.xxhash64("h1", "near"), "near")
        others = [c for c in g.columns if c not in ("h1", "h2", "start")]
        wished = materialize(met.groupBy("h1", "h2", "start").agg(F.max_by("near", order).alias("to"), *[F.first(c).alias(c) for c in others]))
        load = [0.0] * len(cap)
        wish = {}
        for i, j, n in wished.groupBy("shard", "to").agg(F.sum("n")).collect():  # at most shards squared rows
            load[i] += n
            if i != j:
                wish[i, j] = float(n)
        quotas = _quotas(load, cap, wish)
        if not any(quotas[j] for _, j in wish):
            return wished.drop("to")
        g = wished.withColumn("shard", F.when(_draw(r, "h1", "h2") < _pick(quotas, F.col("to")), F.col("to")).otherwise(F.col("shard"))).drop("to")
    return materialize(g)


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", rounds: int = 8) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard."""
    t = F.col(text)
    items = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(t).alias("h1"),
        F.xxhash64(F.lit(7919), t).alias("h2"),
        t.isNotNull().alias("linkable"),
        F.xxhash64(F.lit(17), F.col(key), t).alias("draw"),
    )
    total = docs.count()
    cap = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = materialize(items.where("linkable").groupBy("h1", "h2").agg(F.count("*").alias("all")).where("all > 1"))
    room, at = list(cap), F.lit(None).cast("int")
    # Groups above a shard's capacity, fewer than shards + 1 of them.
    for big in sizes.where(F.col("all") > min(cap)).orderBy(F.desc("all"), "h1", "h2").collect():
        left, share = big["all"], [0] * shards
        for s in sorted(range(shards), key=lambda s: -room[s]):
            share[s] = min(room[s], left)
            left -= share[s]
        room = [a - b for a, b in zip(room, share, strict=True)]
        at = F.when((F.col("h1") == big["h1"]) & (F.col("h2") == big["h2"]) & F.col("linkable"), _dealt(_draw(3, "draw"), share)).otherwise(at)
    items = items.withColumn("large", at).withColumn("start", F.coalesce("large", _dealt(_draw(5, "draw"), room) if sum(room) else F.lit(0)))
    counted = items.where("linkable and large is null").groupBy("h1", "h2", "start").agg(F.count("*").alias("n"))
    moved = propagate(counted.join(sizes, ["h1", "h2"]), room, rounds)
    # Documents without a partner and those of large groups are keyed by their own draw, so they are dealt evenly.
    alone = ~F.col("linkable") | F.col("large").isNotNull()
    rows = items.withColumns({"j1": F.when(alone, F.col("draw")).otherwise(F.col("h1")), "j2": F.when(alone, F.lit(0)).otherwise(F.col("h2"))})
    label = moved.select(F.col("h1").alias("j1"), F.col("h2").alias("j2"), "start", F.col("shard").alias("label"), "all")
    placed = rows.join(label, ["j1", "j2", "start"], "left").select(
        key, "size", "text_crc32", "h1", "h2", "draw", "all",
        F.coalesce("label", "start").alias("s"),
        F.when(F.col("large").isNotNull(), F.lit(0)).when(F.col("label").isNotNull(), F.lit(1)).otherwise(F.lit(2)).alias("kind"),
    )
    buckets = max(BUCKETS, total // (shards * PART))
    part = F.pmod("draw", F.floor(F.col("all") / PART) + 1)
    placed = placed.withColumn("b", F.when(F.col("kind") == 1, F.pmod("h1", F.lit(buckets)) + F.lit(buckets) * part).otherwise(F.pmod("draw", F.lit(buckets)))).drop("all")
    placed = materialize(placed)
    counts = materialize(placed.groupBy("s", "kind", "b").agg(F.count("*").alias("n")))  # one row for some PART documents
    before = counts.select("s", "kind", "b", (F.sum("n").over(W.partitionBy("s").orderBy("kind", "b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    size = [0] * shards
    for s, n in counts.groupBy("s").agg(F.sum("n")).collect():
        size[s] = n
    rank = F.row_number().over(W.partitionBy("s", "kind", "b").orderBy("h1", "h2", "draw", key)) - 1
    ranked = placed.withColumn("r", rank).join(before, ["s", "kind", "b"]).withColumn("slot", (F.col("r") + F.col("before")).cast("long"))
    # The e-th document too many, over all shards in turn, takes the e-th free slot.
    extra = [max(0, size[s] - cap[s]) for s in range(shards)]
    free = [max(0, cap[s] - size[s]) for s in range(shards)]
    extra_before = [0, *accumulate(extra)][:shards]
    ends = list(accumulate(free))
    e = F.col("slot") - _pick([int(x) for x in cap], F.col("s")) + _pick([int(x) for x in extra_before], F.col("s"))
    over = F.col("slot") >= _pick([int(x) for x in cap], F.col("s"))
    to, at = F.lit(None).cast("int"), F.lit(None).cast("long")  # no shard is too full where none has room
    for s in reversed(range(shards)):
        if free[s]:
            inside = F.col("e") < ends[s]
            to = F.when(inside, F.lit(s)).otherwise(to)
            at = F.when(inside, F.col("e") - (ends[s] - free[s]) + size[s]).otherwise(at)
    out = ranked.withColumn("e", e).withColumns({"shard": F.when(over, to).otherwise(F.col("s")).cast("int"), "slot": F.when(over, at).otherwise(F.col("slot")).cast("long")})
    return out.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
