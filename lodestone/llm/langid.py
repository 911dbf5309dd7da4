"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are the 1 to 4 grams of lower-cased letters, words marked by boundaries, hashed into ``BUCKETS``
rows of an embedding table. A text's vector is the mean over all its subwords; a linear layer and a softmax
give the languages. Training sees about ``per_lang`` labelled rows for each language, drawn by a hash of the
row's id (the bound is the parameter); four fifths are fitted, one fifth sets the softmax's temperature and
the confidence below which a prediction is rejected. Prediction reads whole texts; as everything before the
softmax is linear, embeddings and layer are folded into one table of scores per subword, unless there are more
languages than dimensions; what is broadcast is 8 MB at most, and the layer. Every language is learned: with many of
them each has fewer rows, so that ``max_rows`` bounds the sample.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled rows all are;
repeated rows get equal results; an empty table gives an empty result; other columns pass, but for those named
like a result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, ship

ship(__name__)

BUCKETS, DIM, GRAMS = 1 << 17, 16, 4
#: Up to this size the table of the languages' row counts is broadcast.
BROADCAST_BYTES = 8 << 20
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_STATE: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    if "letters" not in _STATE:
        _STATE["letters"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _STATE["letters"]


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: the bucket of the gram at each code point, and whether there is one. Texts are joined by boundaries."""
    code = np.frombuffer("\0".join(["", *texts, "\0" * GRAMS]).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, np.uint32(0))
    n = len(code) - GRAMS
    inside = code != 0
    h = np.zeros(n, np.uint32)
    ok = np.ones(n, bool)
    for k in range(GRAMS):
        h = (h ^ (h >> np.uint32(15))) * _ODD[0] + (code[k : n + k] + np.uint32(k + 1)) * _ODD[k]
        if k >= 2:
            ok &= inside[k - 1 : n + k - 1]  # only the ends of a gram may be boundaries
        valid = inside[:n] if k == 0 else (inside[:n] | inside[1 : n + 1]) if k == 1 else ok
        x = h ^ (h >> np.uint32(16))
        yield (x * _ODD[1]) >> np.uint32(32 - 17), valid


class Model:
    """table: a row of each bucket, as scores, or as embeddings where ``layer`` turns their mean into scores."""

    def __init__(self, langs: list[str], table: np.ndarray, layer: np.ndarray | None, bias: np.ndarray, temperature: float, threshold: float):
        self.langs, self.table, self.layer, self.bias, self.temperature, self.threshold = langs, table, layer, bias, temperature, threshold

    def logits(self, texts: list[str]) -> np.ndarray:
        texts = [t.lower() for t in texts]
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        total = np.zeros((len(texts), self.table.shape[1]))
        count = np.zeros(len(texts))
        for idx, valid in subwords(texts):
            s = self.table[np.where(valid, idx, np.uint32(BUCKETS))]
            total += np.add.reduceat(s, starts, axis=0)
            count += np.add.reduceat(valid.astype(np.int32), starts)
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if self.layer is None else mean @ self.layer.T) + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.4, seed: int = 1) -> Model | None:
    """A model of (text, language) rows."""
    rows = [(t.lower(), g) for t, g in rows if any(map(str.isalpha, t))]
    langs = sorted({g for _, g in rows})
    if not langs:
        return None
    number = {g: i for i, g in enumerate(langs)}
    bags = []
    for t, g in rows:
        idx = np.concatenate([i[v] for i, v in subwords([t])])
        u, c = np.unique(idx, return_counts=True)
        bags.append((u, (c / c.sum()).astype(np.float32), number[g]))
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(bags))
    held, train = order[: len(bags) // 5], order[len(bags) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((len(langs), DIM), np.float32), np.zeros(len(langs), np.float32)
    out += rng.normal(0, 0.1, out.shape)
    step, steps = 0, epochs * max(1, len(train))
    for _ in range(epochs):
        for j in rng.permutation(train):
            u, c, g = bags[j]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = c @ emb[u]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[g] -= 1
            grad = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= lr * p
            emb[u] -= (lr * len(u) ** 0.5) * c[:, None] * grad
    layer = out if len(langs) > DIM else None
    rows_ = emb if layer is not None else emb @ out.T
    table = np.vstack([rows_, np.zeros((1, rows_.shape[1]), np.float32)]).astype(np.float32)
    check = held if len(held) else train
    z = np.array([out @ (c @ emb[u]) + bias for u, c, _ in (bags[j] for j in check)])
    y = np.array([bags[j][2] for j in check])
    grid = np.geomspace(0.05, 8, 40)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    by = np.argsort(-best)
    precise = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= 0.99
    last = int(np.flatnonzero(precise)[-1]) if precise.any() else -1
    threshold = 0.0 if last == len(by) - 1 else float(best[by][last]) if last >= 0 else 1.0
    return Model(langs, table, layer, bias, temperature, threshold)


def training_rows(docs: DataFrame, usable: Column, per_lang: int = 800, max_rows: int = 200_000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """About ``per_lang`` rows of each language, ``max_rows`` in all, the same ones at every call; the driver holds twice that at most."""
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).agg(F.count("*").alias("_rows"))
    langs, size = counts.agg(F.count("*"), F.sum(F.octet_length(lang) + 16)).first()
    if not langs:
        return []
    share = min(per_lang, max(1, max_rows // langs))
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(key), F.col(text)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.select(draw.alias("_draw"), text, lang).join(F.broadcast(counts) if size <= BROADCAST_BYTES else counts, lang).where(F.col("_draw") * F.col("_rows") < share)
    # The order makes the bound, which only rows with one draw can reach, leave the same rows at every call.
    return sorted((r[text], r[lang]) for r in picked.orderBy("_draw", text, lang).limit(2 * min(max_rows, share * langs)).collect())


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred, score (0 to 1) and accepted (score reaches the calibrated threshold)."""
    out = {"lang_pred": T.StringType(), "score": T.DoubleType(), "accepted": T.BooleanType()}
    keep = [c for c in docs.columns if c not in out and c != text]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, t) for c, t in out.items())])
    bounded_batches(docs.sparkSession)
    # Plain values: a worker makes the model of them, so it needs no copy of the package.
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.langs, model.table, model.layer, model.bias, model.temperature, model.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value and Model(*shared.value)
        for batch in batches:
            texts = batch[text].to_pylist()
            langs, scores, accepted = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            part: list[int] = []
            size = 0
            for i, t in enumerate([*texts, None]):
                if m is not None and t and any(map(str.isalpha, t)):
                    part.append(i)
                    size += len(t)
                if part and (size > 1_000_000 or i == len(texts)):
                    for j, b, s in zip(part, *m.predict([texts[j] for j in part]), strict=True):
                        langs[j], scores[j], accepted[j] = m.langs[b], float(s), bool(s >= m.threshold)
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=[*keep, *out])

    return docs.select(*keep, text).mapInArrow(run, schema)
