"""Byte-level BPE encoding and decoding with a given vocabulary (never trained here).

A piece of text becomes a doubly linked list of byte symbols; a priority queue holds the ranks of the pairs
that can merge. The least rank (leftmost on ties) is taken; entries whose symbols have merged meanwhile are
stale and are skipped. Decoding concatenates the vocabulary's strings. Pieces up to ``PIECE`` characters are
cached in a bounded table; a piece without white space may be of any length and costs n log n.

Defined cases: null or empty text has no tokens and decodes to the empty text; added tokens in a text become
their own ids, as in the tokenizers library; other columns pass through unless their names clash with results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, ship

ship(__name__)

PIECE, CACHE = 64, 600_000
#: White space as in the White_Space property; the split pattern of the byte-level pre-tokenizer. Fixed values.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same text cut at white space only; the pattern above never looks beyond such a chunk.
CHUNK = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairEncoder(dict):
    """``encode`` and ``decode`` for the JSON of a byte-level BPE; as a dict it caches chunks and pieces, in two generations."""

    def __init__(self, source: str):
        import re

        import regex

        super().__init__()
        self.older: dict[str, tuple[int, ...]] = {}
        spec = json.loads(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is supported")
        vocab = model["vocab"]
        letters = byte_alphabet()
        raw = {c: b for b, c in letters.items()}
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        self.rank, self.made = {}, []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.made.append(vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with strip or single_word are not supported")
        self.added = added
        self.special = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.bytes = {i: bytes(raw[c] for c in t) if all(c in raw for c in t) else t.encode() for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        self.text = {i: str(i) for i in self.bytes}
        self.chunks, self.pieces = re.compile(CHUNK).findall, regex.compile(PATTERN).findall

    def merge(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        rank, made = self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, r in enumerate([rank(a << 32 | b) for a, b in zip(ids, ids[1:])]) if r is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            j = after[i]
            if j >= n or ids[i] < 0 or rank(ids[i] << 32 | ids[j]) != r:
                continue  # stale
            a = ids[i] = made[r]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank(a << 32 | ids[k])) is not None:
                    heappush(heap, s << 32 | i)
            h = before[i]
            if h >= 0 and (s := rank(ids[h] << 32 | a)) is not None:
                heappush(heap, s << 32 | h)
        return [x for x in ids if x >= 0]

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.older.get(chunk)
        if ids is None:
            pieces = self.pieces(chunk)
            if len(pieces) == 1:
                byte_id = self.byte_id
                ids = tuple(self.merge([byte_id[b] for b in chunk.encode()]))
            else:  # a piece by itself splits into itself, so pieces share the cache with chunks
                ids = tuple(chain.from_iterable(map(self.__getitem__, pieces)))
        if len(chunk) <= PIECE:
            if len(self) >= CACHE:  # the older half stays in reach, so frequent pieces survive
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def ordinary(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.chunks(text))))

    def encode(self, text: str) -> list[int]:
        if self.special is None or not self.special.search(text):
            return self.ordinary(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.ordinary(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.ordinary(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_READY: dict[int, BytePairEncoder] = {}


def encoder(source: str) -> BytePairEncoder:
    """One encoder per worker process and vocabulary."""
    key = hash(source)
    if key not in _READY:
        _READY.clear()
        _READY[key] = BytePairEncoder(source)
    return _READY[key]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read once on the driver; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, path: str, text: str, out: dict[str, T.DataType], f: Callable[[BytePairEncoder, object], tuple]) -> DataFrame:
    keep = [c for c in df.columns if c not in out and c != text]
    shared = _vocabulary(df, path)
    schema = T.StructType([*(x for x in df.schema.fields if x.name in keep), *(T.StructField(c, t) for c, t in out.items())])
    kinds = {c: {"long": pa.int64(), "string": pa.string(), "array": pa.list_(pa.int32())}[t.typeName() if t.typeName() != "bigint" else "long"] for c, t in out.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in batches:
            rows = [f(bpe, x) for x in batch[text].to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(v, kinds[c]) for c, v in zip(out, columns, strict=True))], names=[*keep, *out])

    return df.select(*keep, text).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the text replaced by its token ids, an array of integers."""
    return _mapped(docs, path, text, {ids: T.ArrayType(T.IntegerType())}, lambda bpe, x: (bpe.encode(x or ""),))


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the ids replaced by their text."""
    return _mapped(tokens, path, ids, {text: T.StringType()}, lambda bpe, x: (bpe.decode(x or []),))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each text: encoded, then decoded from the ids, in one pass."""

    def digests(bpe: BytePairEncoder, x: object) -> tuple:
        ids = bpe.encode(x or "")
        listed = ",".join(map(bpe.text.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    bounded_batches(docs.sparkSession)
    return _mapped(docs, path, text, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, digests)
