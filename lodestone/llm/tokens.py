"""Token counts of whole texts, by the library of the given vocabulary file (never trained here).

Arrow functions return lengths only; no ids leave a task. Long texts are split at safe boundaries into parts of about
``PART`` characters, parts are gathered into batches of about ``BATCH`` bytes, and each batch is cut at every safe
boundary into chunks, most of which occur many times. A chunk met for the first time is encoded by the library, in
calls of about ``CALL`` bytes; its length stays in a bounded table of the worker.

A boundary is safe where the pre-tokenizer of a plain byte-level BPE always splits: before white space that follows
something else. No added token may hold white space; vocabularies of other kinds get whole texts, in the same batches.
In an unbroken run above ``PART`` characters a change between ASCII letters and digits is safe too, if no added token holds a digit.

Defined cases: null or empty text has no bytes and no tokens; added tokens in a text become their own ids, the default
of the tokenizers library; a run without any safe boundary is encoded as it is, whatever its length; repeated rows
get equal results; an empty table gives an empty result; other columns pass unless their names clash with results.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SPACE
from .common import bounded_batches, ship

ship(__name__)

PART, BATCH, CALL = 1 << 18, 1 << 20, 1 << 16
#: Entries of a worker's table of lengths, and characters of the longest chunk that is kept in it.
KNOWN, KEPT_CHARS = 1_000_000, 48
RUN_EDGE = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"


def balanced(texts: list[str], size: int) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``size`` bytes; a longer text is a list of its own."""
    held, total = [], 0
    for t in texts:
        n = len(t.encode())
        if held and total + n > size:
            yield held
            held, total = [], 0
        held.append(t)
        total += n
    if held:
        yield held


class TokenCounter:
    """Counts tokens with the tokenizers library (``json``) or with sentencepiece (``model``)."""

    def __init__(self, kind: str, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.known: dict[str, int] = {}
        self.cut = self.run_edge = self.chunks = None
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(content)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]
        if plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(rf"[{SPACE}]", t["content"]) for t in added):
            self.cut, self.chunks = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])"), re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
            if not any(re.search("[0-9]", t["content"]) for t in added):
                self.run_edge = re.compile(RUN_EDGE)

    def parts(self, text: str) -> Iterator[str]:
        """A text in parts of about ``PART`` characters that tokenize as they do in the whole."""
        at = 0
        while self.cut and len(text) - at > PART:
            m = self.cut.search(text, at + PART, at + 2 * PART) or (self.run_edge and self.run_edge.search(text, at + PART)) or self.cut.search(text, at + 2 * PART)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def lengths(self, parts: list[str]) -> list[int]:
        """The number of tokens of each part of one batch."""
        if not self.chunks:
            return [n for call in balanced(parts, CALL) for n in self.encode(call)]
        chunks = [self.chunks(p) for p in parts]
        new = set().union(*chunks).difference(self.known)
        long = {c: 0 for c in new if len(c) > KEPT_CHARS}
        if len(self.known) + len(new) > KNOWN:
            self.known = {}
            new = set().union(*chunks)
        for call in balanced(sorted(new), CALL):
            self.known.update(zip(call, self.encode(call), strict=True))
        out = [sum(map(self.known.__getitem__, c)) for c in chunks]
        for c in long:
            self.known.pop(c, None)
        return out

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; parts of a text may fall into several batches."""
        out = [0] * len(texts)
        rows: list[int] = []
        held: list[str] = []
        size = 0

        def flush() -> None:
            for i, n in zip(rows, self.lengths(held), strict=True):
                out[i] += n
            rows.clear()
            held.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text):
                rows.append(i)
                held.append(part)
                size += len(part.encode())
                if size >= BATCH:
                    flush()
                    size = 0
        flush()
        return out


_READY: dict[int, TokenCounter] = {}


def counter(kind: str, content: bytes) -> TokenCounter:
    """One counter per worker process and vocabulary."""
    key = hash((kind, content))
    if key not in _READY:
        _READY.clear()
        _READY[key] = TokenCounter(kind, content)
    return _READY[key]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` without the text, with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""
    bounded_batches(docs.sparkSession)
    out = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in docs.columns if c not in out and c != text]
    kind = "model" if path.endswith(".model") else "json"
    with open(path, "rb") as f:  # its size does not depend on the data
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    plain = [f"c{i}" for i in range(len(keep))]  # Arrow functions take no column with a dot in its name
    fields = [T.StructField(p, docs.schema[c].dataType) for p, c in zip(plain, keep, strict=True)]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(kind, shared.value)
        for batch in batches:
            texts = pc.fill_null(batch["text"].cast(pa.large_string()), "")
            n = tokens.count(texts.to_pylist())
            columns = [pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in plain), *columns], names=[*plain, *out])

    named = docs.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, keep, strict=True)], F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, schema).toDF(*keep, *out)
