"""Benchmark decontamination, with DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. The windows of the test
items (``size`` consecutive words, or the whole of a shorter item) form a hash set; every window of every
document is looked up, hits are verified on the words themselves, and the words inside verified windows are
marked. ``remove`` cuts these spans, or drops documents with too large a share of them.

The set is broadcast while it has at most ``broadcast_windows`` windows and ``BROADCAST_BYTES`` bytes (of words and
item ids, both added up first). A larger set meets the documents' windows in a shuffled join on the hash, and hits are
verified after they have come back to their document.

Defined cases: null or empty texts and items have no words; repeated rows get equal results; an item id that
occurs twice counts once; null item ids count as the string ``null``; empty tables give no hits or rows; other columns
pass, whatever their names (``remove``), or are ignored (``contamination``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """The words of a text; pure ASCII takes the fast path of lower()."""
    t = f"coalesce({text}, '')"
    low = f"if(octet_length({t}) = length({t}), lower({t}), translate({t}, '{UPPER}', '{LOWER}'))"
    return F.array_remove(F.split(F.expr(low), NOT_WORD), "")


def item_windows(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """(wh, len, ws, items): the distinct windows of the items, with their hash, words and item ids."""
    d = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    d = d.select("item", F.expr(f"explode(transform(sequence(1, greatest(size(w) - {size} + 1, 1)), i -> slice(w, i, {size})))").alias("ws"))
    d = d.groupBy("ws").agg(F.collect_set("item").alias("items"))
    return d.select(F.expr("xxhash64(transform(ws, x -> xxhash64(x)))").alias("wh"), F.size("ws").alias("len"), "ws", "items")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_k1": F.xxhash64(F.col(key), t), "_k2": F.xxhash64(F.lit(1), t)})


def hits(keyed: DataFrame, items: DataFrame, size: int = 10, item_id: str = "item_id", text: str = "text", item_text: str = "text", broadcast_windows: int = 200_000) -> DataFrame:
    """(_k1, _k2, spans, found): for each document with hits, the marked windows (first word, length) and the item ids."""
    table = item_windows(items, size, item_id, item_text).cache()
    try:
        bytes_ = F.expr("8 + octet_length(array_join(ws, ' ')) + aggregate(items, 0L, (a, x) -> a + octet_length(x) + 8)")
        found = table.groupBy("len").agg(F.count("*"), F.sum(bytes_)).collect()  # at most ``size`` rows
        lengths = {r[0]: r[1] for r in found}
        small = sum(lengths.values()) <= broadcast_windows and sum(r[2] for r in found) <= BROADCAST_BYTES
        rows = [r.asDict() for r in table.collect()] if small else None
    finally:
        table.unpersist()
    if small:  # the checked set becomes a local relation
        table = keyed.sparkSession.createDataFrame(rows or [], table.schema)
    sizes = [size, *sorted((n for n in lengths if n < size), reverse=True)]
    d = keyed.select("_k1", "_k2", words(text).alias("w"))
    d = d.select("_k1", "_k2", "w", F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    arrays = [f"if(size(h) < {n}, cast(array() as array<bigint>), transform(sequence(1, greatest(size(h) - {n} + 1, 1)), i -> xxhash64(slice(h, i, {n}))))" for n in sizes]
    d = d.select("_k1", "_k2", "w", F.expr(arrays[0] if len(arrays) == 1 else f"concat({', '.join(arrays)})").alias("all"))
    # The outer form: for the inner one Spark infers a filter on the array and computes all of it a second time.
    d = d.select("_k1", "_k2", "w", F.posexplode_outer("all").alias("at", "wh")).where("wh is not null")
    first, start, length = "0", "case", "case"
    for n in sizes:
        count = f"greatest(size(w) - {n} + 1, 0)"
        start += f" when at < {first} + {count} then at - ({first})"
        length += f" when at < {first} + {count} then {n}"
        first += f" + {count}"
    begin, span = F.expr(f"{start} end").alias("start"), F.expr(f"{length} end").alias("span")
    if small:
        met = d.join(F.broadcast(table), "wh").select("_k1", "_k2", "w", begin, span, "ws", "items")
        # Written as two comparisons: an equality would become a join key and be computed for every window.
        met = met.where("slice(w, start + 1, span) >= ws and slice(w, start + 1, span) <= ws")
        found = met.select("_k1", "_k2", F.struct("start", "span").alias("s"), "items")
        return found.groupBy("_k1", "_k2").agg(F.collect_set("s").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("found"))
    met = d.select("_k1", "_k2", "wh", begin, span).join(table, "wh").where("span = len")
    met = met.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "span", "ws", "items")).alias("c"))
    back = keyed.select("_k1", "_k2", words(text).alias("w")).dropDuplicates(["_k1", "_k2"]).join(met, ["_k1", "_k2"])
    back = back.select("_k1", "_k2", F.expr("filter(c, x -> slice(w, x.start + 1, x.span) = x.ws)").alias("c")).where(F.size("c") > 0)
    return back.select("_k1", "_k2", F.expr("transform(c, x -> struct(x.start as start, x.span as span))").alias("spans"), F.expr("array_distinct(flatten(transform(c, x -> x.items)))").alias("found"))


#: The marked word positions of an array of spans.
_MARKED = "array_distinct(flatten(transform(spans, x -> sequence(x.start, x.start + x.span - 1))))"


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row per document: key, n_words, n_hit, found (sorted item ids)."""
    keyed = _keyed(docs.select(key, text), key, text)
    found = hits(keyed, items, text=text, **options)  # type: ignore[arg-type]
    found = found.select("_k1", "_k2", F.expr(f"cast(size({_MARKED}) as bigint)").alias("n_hit"), F.sort_array("found").alias("found"))
    base = keyed.select(key, "_k1", "_k2", F.size(words(text)).cast("long").alias("n_words"))
    d = base.join(found, ["_k1", "_k2"], "left")
    return d.select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def remove(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars", max_share: float = 1.0, **options: int) -> DataFrame:
    """``docs`` without the marked words; documents of which ``max_share`` of the words or more are marked go."""
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    keyed = _keyed(named, "key", "text")
    d = keyed.join(hits(keyed, items, text="text", **options), ["_k1", "_k2"], "left")  # type: ignore[arg-type]
    d = d.withColumn("_m", F.expr(f"if(spans is null, null, array_sort({_MARKED}))"))
    n = F.size(words("text"))
    d = d.where(F.col("_m").isNull() | (F.size("_m") < max_share * n))
    # A flag for each word, from the sorted marked positions in one pass; then words and what stands between them, in turn.
    flags = "flatten(transform(_m, (x, i) -> concat(array_repeat(false, x - if(i = 0, 0, _m[i - 1] + 1)), array(true))))"
    d = d.withColumn("_f", F.expr(f"if(_m is null, null, {flags})"))
    word, gap = f"regexp_extract_all(text, '{_sql(RAW_WORD)}', 0)", f"split(text, '{_sql(RAW_WORD)}')"
    rebuilt = f"array_join(zip_with({gap}, zip_with({word}, _f, (x, f) -> if(coalesce(f, false), '', x)), (g, x) -> concat(g, coalesce(x, ''))), '')"
    d = d.withColumn("text", F.when(F.col("_m").isNull(), F.col("text")).otherwise(F.expr(rebuilt)))
    new = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)} | {text: F.col("text")}
    if chars in docs.columns:
        new[chars] = F.when(F.col("_m").isNull(), new[chars]).otherwise(F.length("text")).cast(docs.schema[chars].dataType)
    return d.select(*[new[c].alias(c) for c in docs.columns])


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")
