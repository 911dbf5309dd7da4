"""Full-text matching and ranking: stemmed lexemes with positions, AND-match, cover density.

A word is a run of Unicode letters and digits, lower-cased; stop words are no lexemes but count as positions. Words are
split and lower-cased where they are read and stemmed through a cache, one Arrow batch at a time: no shuffle. Texts
are taken whole. ``postings`` is the stored form for many questions: one row per (lexeme, object).

``forms``, where given, closes some lexemes: only the listed words count as one of them. Another word that the stemmer would
bring to it is a lexeme by itself, as is a name that only looks inflected.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stem
from .text import STOP_WORDS, col

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_STOP = frozenset(STOP_WORDS)
#: The weight of a lexeme without a label. Fixed value.
WEIGHT = 0.1
#: Places in a batch of postings. Fixed value.
CHUNK = 100_000
Forms = Mapping[str, Collection[str]]


def lexeme(word: str, forms: Forms | None = None) -> str:
    """The stem of a lower-cased word, or the word itself if its stem is closed to it."""
    k = stem(word)
    return word if forms and k in forms and word not in forms[k] else k


def query_lexemes(question: str | None, forms: Forms | None = None) -> tuple[str, ...]:
    """The distinct lexemes of a question, in order."""
    return tuple(dict.fromkeys(lexeme(w, forms) for w in _WORD.findall((question or "").lower()) if w not in _STOP))


def positions(text: str, forms: Forms | None = None) -> list[tuple[str, int]]:
    """(lexeme, position) of a lower-cased text; positions count stop words as well."""
    return [(lexeme(w, forms), i) for i, w in enumerate(_WORD.findall(text)) if w not in _STOP]


def cover_density(places: list[tuple[int, int]], n: int) -> float:
    """The sum over minimal covers of WEIGHT / (1 + other words inside); ``places`` are (position, lexeme number)
    in order of position. Zero unless all ``n`` lexemes occur."""
    if n == 0 or len({k for _, k in places}) < n:
        return 0.0
    if n == 1:
        return WEIGHT * len(places)
    total, inside, first = 0.0, Counter(), 0
    for last, (end, k) in enumerate(places):
        inside[k] += 1
        while inside[places[first][1]] > 1:  # the earliest place is spare
            inside[places[first][1]] -= 1
            first += 1
        if len(inside) == n:
            # A minimal cover: dropping either end loses a lexeme. It is counted at the first end that closes it.
            total += WEIGHT / (1 + (end - places[first][0]) - (last - first))
            del inside[places[first][1]]
            first += 1
    return total


def proximity(places: list[tuple[int, int]], n: int) -> float:
    """The rank of procedures: occurrences of a single lexeme, each counting less than the one before, or how near
    the occurrences of different lexemes are to each other. Those over 100 words apart weigh nothing that a double shows."""
    if n == 0 or len({k for _, k in places}) < n:
        return 0.0
    if n == 1:
        return sum(WEIGHT / (j + 1) ** 2 for j in range(len(places))) / 1.64493406685
    of: list[list[int]] = [[] for _ in range(n)]
    for i, k in places:
        of[k].append(i)
    apart = 1.0
    for a in range(n):
        for b in range(a + 1, n):
            for i in of[a]:
                for j in of[b][bisect_left(of[b], i - 100) : bisect_right(of[b], i + 100)]:
                    apart *= 1 - WEIGHT * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(i - j) / 1.5 - 2)))
    return 1 - apart


def stemmed(text: Column | str) -> Column:
    """The distinct lexemes of a text; null for null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else list(dict.fromkeys(k for k, _ in positions(x))))

    return run(F.lower(col(text)))


def text_rank(text: Column | str, lexemes: Iterable[str], score: Callable = cover_density, forms: Forms | None = None) -> Column:
    """The score of the lexemes in a text; null where the text lacks one, or there are no lexemes."""
    number = {k: i for i, k in enumerate(dict.fromkeys(lexemes))}
    if not number:
        return F.lit(None).cast("double")

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> float | None:
            places = [(i, number[k]) for k, i in positions(x or "", forms) if k in number]
            return score(places, len(number)) if len({k for _, k in places}) == len(number) else None

        return texts.map(one).astype("float64")

    # A mapped None is NaN in pandas and null again here.
    return F.nanvl(run(F.lower(col(text))), F.lit(None).cast("double"))


def may_match(low: Column, lexemes: Iterable[str]) -> Column:
    """A native test that a matching text always passes: each lexeme's word begins with the lexeme less two letters."""
    out = F.lit(True)
    for k in lexemes:
        if k.isascii():
            out = out & F.contains(low, F.lit(k[: max(1, len(k) - 2)]))
    return out


def matching(df: DataFrame, text: Column | str, question: str, rank: str = "v", forms: Forms | None = None) -> DataFrame:
    """The rows whose text has all lexemes of the question, with their cover density; none for an empty question."""
    lexemes = query_lexemes(question, forms)
    if not lexemes:
        return df.where(F.lit(False)).withColumn(rank, F.lit(None).cast("double"))
    # The native test is a filter of its own, so that it runs before rows are sent to Python.
    found = df.where(may_match(F.lower(col(text)), lexemes))
    return found.withColumn(rank, text_rank(text, lexemes, forms=forms)).where(F.col(rank).isNotNull())


def posted(batches: Iterable[pa.RecordBatch], kept: Collection[str] | None = None, forms: Forms | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of (lexeme, key, places), of about ``CHUNK`` places each, for batches of (key, lower-cased text)."""
    for b in batches:
        words, rows, places, n = [], [], [], 0
        for row, x in enumerate(b["text"]):
            found: dict[str, list[int]] = {}
            for k, i in positions(x.as_py() or "", forms):
                if kept is None or k in kept:
                    found.setdefault(k, []).append(i)
                    n += 1
            words.extend(found)
            rows.extend([row] * len(found))
            places.extend(found.values())
            if n >= CHUNK or row == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), b["key"].take(pa.array(rows, pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["lexeme", "key", "places"])
                words, rows, places, n = [], [], [], 0


def postings(df: DataFrame, key: str, text: Column | str, only: Collection[str] | None = None, forms: Forms | None = None) -> DataFrame:
    """(lexeme, key, places): every lexeme of every text with its positions. To be stored by lexeme.

    ``only``: the lexemes to be kept, where all questions are known. A task's memory does not grow with its rows.
    """
    kept = None if only is None else frozenset(only)
    schema = T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("key", df.select(key).schema[0].dataType), T.StructField("places", T.ArrayType(T.IntegerType()))])
    d = df.select(F.col(key).alias("key"), F.lower(col(text)).alias("text"))
    return d.mapInArrow(lambda batches: posted(batches, kept, forms), schema).toDF("lexeme", key, "places")


def batch_search(stored: DataFrame, questions: DataFrame, key: str, limit: int, forms: Forms | None = None) -> DataFrame:
    """(query_id, key, rank_value, place): the ``limit`` best objects of each question (query_id, question).

    Each question's lexemes meet the postings in one equi join; its candidates are those of its rarest lexeme, so a
    frequent word beside a rare one does not widen the search. Places meet per (question, object). ``stored`` is read three times.
    """

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: list(query_lexemes(x, forms)))

    @F.pandas_udf("double")
    def rank(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: cover_density(sorted((int(i), k) for k, p in enumerate(x) for i in p), len(x))).astype("float64")

    asked = questions.select("query_id", split("question").alias("_q")).select("query_id", F.size("_q").alias("n"), F.explode("_q").alias("lexeme"))
    often = stored.join(asked.select("lexeme").distinct(), "lexeme", "left_semi").groupBy("lexeme").agg(F.count("*").alias("often"))
    asked = asked.join(often, "lexeme")
    rarest = asked.groupBy("query_id").agg(F.min_by("lexeme", F.struct("often", "lexeme")).alias("lexeme"), F.count("*").alias("known"), F.max("n").alias("n")).where("known = n")
    candidates = rarest.select("query_id", "lexeme").join(stored.select("lexeme", key), "lexeme").select("query_id", key)
    wanted = asked.join(rarest.select("query_id"), "query_id", "left_semi").select("query_id", "lexeme", "n")
    met = candidates.join(wanted, "query_id").join(stored, ["lexeme", key])
    full = met.groupBy("query_id", key).agg(F.array_sort(F.collect_list(F.struct("lexeme", "places"))).alias("_l"), F.max("n").alias("n")).where(F.size("_l") == F.col("n"))
    ranked = full.select("query_id", key, F.round(rank(F.transform("_l", lambda x: x["places"])), 9).alias("rank_value"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_value"), F.asc(key))
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
