"""Importance resampling towards a target, with DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z; features are all runs of one to
``ngram`` words. Each feature falls into one of ``buckets`` by its crc32. A bucket's gain is the floored, scaled log ratio of
its smoothed share in the target and in the corpus; a document's weight is the floored mean of its features' gains. With a
Gumbel number drawn from a hash of seed and id, the highest scores are a sample without replacement in proportion to
exp(weight). Documents of at least ``min_words`` words take part; ``percent`` of them are drawn.

N-grams are exploded from arrays; buckets are counted in the map task first and meet the documents again as a broadcast
table of at most ``buckets`` rows. Features of a document follow one another in a task, so their sum needs no
large shuffle. Ranks come from a range-partitioned sort: the row's place in its partition plus the sizes of those before.

Defined cases: null or empty text has no features, weight 0 and no rank; a null id counts as '' in the hash and sorts last;
ties go to the smaller id, then to the earlier row; repeated rows are rows of their own; an empty target counts no
feature; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .decontam import words


def ngrams(docs: DataFrame, text: str = "text", ngram: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, n_words, w): a row for each word and the n-grams that start there, as an array; outer, so no document is lost."""
    d = docs.select(*keep, words(text).alias("w"))
    runs = ", ".join(["x", *[f"if(i + {n} <= size(w), array_join(slice(w, i + 1, {n}), ' '), null)" for n in range(2, ngram + 1)]])
    d = d.select(*keep, F.size("w").alias("n_words"), F.expr(f"transform(w, (x, i) -> array({runs}))").alias("w"))
    return d.select(*keep, "n_words", F.explode_outer("w").alias("w"))


def _buckets(ngram: int, buckets: int) -> list[Column]:
    return [F.expr(f"cast(pmod(crc32(cast(w[{n}] as binary)), {buckets}) as int)").alias(f"b{n}") for n in range(ngram)]


def bucket_counts(docs: DataFrame, text: str = "text", ngram: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): the features of all texts."""
    d = ngrams(docs, text, ngram).where("w is not null").select(F.explode(F.array(*_buckets(ngram, buckets))).alias("bucket"))
    return d.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of the buckets of either, from counts of at most ``buckets`` rows each."""
    zero, every = F.lit(0).cast("long"), Window.partitionBy(F.lit(0))
    d = corpus.select("bucket", F.col("n").alias("here"), zero.alias("there")).unionByName(target.select("bucket", zero.alias("here"), F.col("n").alias("there")))
    d = d.groupBy("bucket").agg(F.sum("here").alias("here"), F.sum("there").alias("there"))
    d = d.withColumns({"all_here": F.sum("here").over(every), "all_there": F.sum("there").over(every)})
    smooth = lambda n, by: F.col(n).cast("double") + by
    ratio = smooth("there", 1) * smooth("all_here", buckets) / (smooth("here", 1) * smooth("all_there", buckets))
    return d.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, key: str = "doc_id", text: str = "text", ngram: int = 2, buckets: int = 10_000) -> DataFrame:
    """(row, key, n_words, n_features, weight), one row for each row of ``docs``."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    d = ngrams(d, "text", ngram, ("row", "key")).select("row", "key", "n_words", *_buckets(ngram, buckets))
    for n in range(ngram):
        d = d.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{n}"), F.col("gain").alias(f"g{n}"))), f"b{n}", "left")
    total = sum((F.coalesce(f"g{n}", F.lit(0)) for n in range(1, ngram)), F.coalesce("g0", F.lit(0)))
    many = sum((F.col(f"b{n}").isNotNull().cast("long") for n in range(1, ngram)), F.col("b0").isNotNull().cast("long"))
    d = d.groupBy("row", "key", "n_words").agg(F.sum(many).alias("n_features"), F.sum(total).alias("total"))
    floored = F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)")
    return d.select("row", "key", F.col("n_words").cast("long").alias("n_words"), "n_features", floored.alias("weight"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rank (from 1): sorted by ranges, each partition's ranks start after the rows of those before."""
    d = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    d = materialize(d)
    part = F.shiftright("_at", 33)
    sizes = d.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    d = d.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return d.withColumn("rank", F.expr("_offset + (_at & 8589934591) + 1")).drop("_part", "_at", "_offset")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", ngram: int = 2, buckets: int = 10_000, min_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """(key, n_features, weight, score, rank), one row for each document; rank is null unless it is drawn."""
    gain = materialize(gains(bucket_counts(docs, text, ngram, buckets), bucket_counts(target, target_text, ngram, buckets), buckets))
    d = weights(docs, gain, key, text, ngram, buckets)
    h = F.expr(f"cast(conv(substring(sha2(concat('{seed}:', coalesce(cast(key as string), '')), 256), 1, 8), 16, 10) as double)")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    d = materialize(d.withColumn("score", F.col("weight") + noise))
    fit = d.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    top = ranked(fit, [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = d.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
