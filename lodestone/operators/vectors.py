"""Nearest vectors for many questions in one pass over the index.

Questions form matrices of at most ``BLOCK`` rows, small enough to be sent to every task; a larger set takes several
passes. A task multiplies each Arrow batch of the index with the questions and keeps the ``k`` best of the batch for each
question and part; Spark merges what the batches kept. No pair of question and row leaves a task unless it is among
the best of its batch, and similarities are those of exact cosines, rounded to ``DIGITS``, ties to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranking

BLOCK, GATHER, COLUMNS, DIGITS = 4096, 32 << 20, 256, 6


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, all of ``width`` values, with length 1; a zero row becomes NaN."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norm = np.sqrt((m * m).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / norm[:, None]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _best(similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest values of each column; of equal values the upper rows."""
    n = len(similarity)
    if n > k:
        least = np.partition(similarity, n - k, axis=0)[n - k]
        row, column = np.nonzero(similarity >= least)
    else:
        row, column = np.nonzero(similarity > -np.inf)
    order = np.lexsort((row, -similarity[row, column], column))
    row, column = row[order], column[order]
    start = np.searchsorted(column, column)
    keep = (np.arange(len(column)) - start < k) & (similarity[row, column] > -np.inf)
    return row[keep], column[keep]


def nearest(index: DataFrame, questions: DataFrame, k: int, question: str = "question_id", vector: str = "vector", part: str = "part", key: str = "object_id", embedding: str = "embedding") -> DataFrame:
    """(question, part, key, similarity, rank): the ``k`` nearest index rows of each part for each question.

    Vectors of another width than the questions', zero vectors and nulls are near to nothing. A key with several vectors in
    a part counts once, with its best. Question ids must not repeat; vectors of different widths are an error.
    """
    asked = questions.select(F.col(question).alias("q"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    found = asked.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    n, width, widest = found[0], found[1], found[2]
    if n and width != widest:
        raise ValueError(f"question vectors have {width} to {widest} values")
    rows = index.select(F.col(part).cast("string").alias("p"), F.col(key).alias("k"), F.col(embedding).cast("array<double>").alias("e")).where(F.size("e") == F.lit(width or 0))
    fields = [T.StructField("q", asked.schema["q"].dataType), T.StructField("p", T.StringType()), T.StructField("k", rows.schema["k"].dataType), T.StructField("s", T.DoubleType())]
    blocks = -(-2 * n // BLOCK)
    parts = []
    for b in range(blocks):  # each is small by its count; a hash deals them out
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        parts.append(_pass(rows, block.toArrow(), width, k, T.StructType(fields)))
    if not parts:
        parts.append(index.sparkSession.createDataFrame([], T.StructType(fields)))
    merged = reduce(lambda x, y: x.unionByName(y), parts)
    order = [F.desc("s"), F.asc("k")]
    merged = ranking.first_per_key(merged, ["q", "p", "k"], [F.desc("s")])
    merged = ranking.first_per_key(merged, ["q", "p"], order, k, "rank")
    return merged.select(F.col("q").alias(question), F.col("p").alias(part), F.col("k").alias(key), F.col("s").alias("similarity"), "rank")


def _pass(rows: DataFrame, block: pa.Table, width: int, k: int, schema: T.StructType) -> DataFrame:
    """The best of each batch for one block of questions."""
    asked = rows.sparkSession.sparkContext.broadcast((block["q"].combine_chunks(), _matrix(block["v"].combine_chunks(), width)))
    # A key may have several vectors, so more than k rows of a batch may be needed; those of one key are reduced first.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        for table in _gathered(batches):
            table = table.sort_by([("p", "ascending"), ("k", "ascending")]).combine_chunks()
            parts = table["p"].combine_chunks().fill_null("").dictionary_encode()
            which, keys = parts.indices.to_numpy(), table["k"].combine_chunks()
            m = _matrix(table["e"].combine_chunks(), width)
            code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for p in range(len(parts.dictionary)):
                at = np.flatnonzero(which == p)
                first = np.flatnonzero(np.concatenate([[True], code[at][1:] != code[at][:-1]]))
                for c in range(0, len(q), COLUMNS):
                    s = np.round(m[at] @ q[c : c + COLUMNS].T, DIGITS)
                    s = np.where(np.isnan(s), -np.inf, s)
                    s = s if len(first) == len(at) else np.maximum.reduceat(s, first, axis=0)
                    row, column = _best(s, k)
                    name = pa.array([parts.dictionary[p].as_py()] * len(row), pa.string())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(column + c)), name, keys.take(pa.array(at[first][row])), pa.array(s[row, column] + 0.0)], names=["q", "p", "k", "s"])

    return rows.mapInArrow(run, schema)
