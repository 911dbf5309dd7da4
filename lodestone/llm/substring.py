"""Substring dedup with difference-cover anchors, over words.

A window is ``window`` consecutive words. Two equal windows at i and j need not start at the same residue of
their positions, but for a difference cover D modulo v there is a shift s < v with (i + s) mod v and
(j + s) mod v both in D. So hashing only the anchors (runs of ``window - v + 1`` words) that start at covered
positions is enough: any two equal windows share an anchor. Anchors seen twice extend to the windows that
contain them, and those windows are compared by 128 bit hashes of all their words.

Cost: |D| / v of the positions are shuffled once as 64 bit keys; full windows only around repeated anchors.
Exact copies are combined first, equal keys of a task are combined before the shuffle, and a key bucket gets
each key once per task, so neither a huge group of copies nor a very common passage makes a hot task.

Defined cases: null or empty text has no words; texts shorter than a window lose nothing; repeated rows are
copies and lose every window; an empty table gives an empty result; other columns pass, but for those named like a
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Powers, WordHash, distinct_texts, exchange, gathered, key_buckets, mix, prefix_hash, ship, utf8, window_hash, wire, WIRE, with_results

ship(__name__)

#: Perfect difference sets: modulus -> residues whose differences give every residue. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}


def cover(window: int) -> tuple[int, np.ndarray]:
    """The period and the covered residues for a window: anchors keep at least two fifths of its words."""
    v = max(v for v in COVERS if v == 1 or v <= 0.62 * window)
    return v, np.array(COVERS[v])


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    table = np.stack([batch["h1"].to_numpy(zero_copy_only=False), batch["h2"].to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
    return table, batch["copies"].to_numpy(zero_copy_only=False) > 1


def _flush(keys: list, docs: list, pos: list, table: np.ndarray, copied: np.ndarray, silent: np.ndarray, buckets: int, words: int) -> Iterator[pa.RecordBatch]:
    if keys:
        yield wire(np.concatenate(keys).reshape(-1, words), np.concatenate(docs), np.concatenate(pos), table, copied, silent, buckets)


def anchors(window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    v, residues = cover(window)
    length = window - v + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, hashes = Powers(BASES[0]), WordHash()
        for batch in gathered(batches):
            table, copied = _documents(batch)
            keys, docs, pos = [], [], []
            for i, text in enumerate(utf8(batch["text"])):
                words = text.split()
                if len(words) < window:
                    continue
                h = window_hash(prefix_hash(hashes.of(words), powers), length, powers)
                at = np.arange(len(h))
                at = at[np.isin(at % v, residues)] if v > 1 else at
                keys.append(mix(h[at]))
                pos.append(at)
                docs.append(np.full(len(at), i))
            yield from _flush(keys, docs, pos, table, copied, np.zeros(len(copied), bool), buckets, 1)  # copied texts need the answer to be witnesses

    return run


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, whether one of the ranges [start, end) holds it."""
    step = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _marks(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int32)


def windows(window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Extension: every window that contains a repeated anchor, as 128 bits over its words. Copied texts are witnesses for others."""
    v, _ = cover(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, hashes = Powers(BASES[0]), Powers(BASES[1]), WordHash()
        for batch in gathered(batches):
            table, copied = _documents(batch)
            keys, docs, pos = [], [], []
            marks = batch["pos"].to_pylist()
            for i, text in enumerate(utf8(batch["text"])):
                words = text.split()
                n = len(words) - window + 1
                if n < 1:
                    continue
                at = _marks(marks[i])
                at = np.flatnonzero(covered(np.clip(at - v + 1, 0, n), np.clip(at + 1, 0, n), n))
                if not len(at):
                    continue
                h = hashes.of(words)
                k = np.stack([mix(window_hash(prefix_hash(h, first), window, first)[at]), mix(window_hash(prefix_hash(h, second), window, second)[at])], axis=1)
                keys.append(k)
                pos.append(at)
                docs.append(np.full(len(at), i))
            yield from _flush(keys, docs, pos, table, copied, copied, buckets, 2)

    return run


RESULT = "h1 long, h2 long, n_words long, n_removed long, kept string"


def removal(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, copied = _documents(batch)
            marks = batch["pos"].to_pylist()
            total, gone, kept = [], [], []
            for i, text in enumerate(utf8(batch["text"])):
                words = text.split()
                n = len(words)
                total.append(n)
                if copied[i] and n >= window:
                    words = []
                elif marks[i]:
                    at = _marks(marks[i])
                    words = [words[j] for j in np.flatnonzero(~covered(at, at + window, n)).tolist()]
                gone.append(n - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict({"h1": table[:, 0], "h2": table[:, 1], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())})

    return run


def dedup_substrings(docs: DataFrame, window: int = 35, text: str = "text", per_text: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``docs``' other columns with n_words, n_removed and kept: the words outside windows that occur twice or more.

    ``per_text`` is applied to (h1, h2, n_words, n_removed, kept) of the distinct texts before the results
    are spread over the copies, for callers that want digests instead of texts.
    """
    texts = distinct_texts(docs, text)
    buckets = key_buckets(docs, text)
    shared = exchange(texts.mapInArrow(anchors(window, buckets), WIRE), 1, buckets)
    open_texts = texts.join(shared, ["h1", "h2"])
    starts = exchange(open_texts.mapInArrow(windows(window, buckets), WIRE), 2, buckets)
    result = per_text(texts.join(starts, ["h1", "h2"], "left").mapInArrow(removal(window), RESULT))
    return with_results(docs, text, result)
