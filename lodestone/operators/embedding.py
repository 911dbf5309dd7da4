"""What is still to be embedded, and embedding it: scans for each role, and an encoder applied in small batches.

An encoder is any function of a list of texts that gives a list of vectors. It may raise ``Busy`` with the seconds to wait;
it is then asked again, a bounded number of times. Whatever else it raises, or a wrong number or width of vectors, gives
zero vectors (which are near to nothing) and the reason, so one bad batch does not lose the others.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Fixed values.
DIMENSION, MAX_CHARS = 384, 8000
Encoder = Callable[[list[str]], list[list[float]]]


class Busy(Exception):
    """The encoder asks for another try after some seconds."""

    def __init__(self, seconds: float | None = None):
        super().__init__(seconds)
        self.seconds = seconds


def hash_encoder(dimension: int = DIMENSION) -> Encoder:
    """An encoder without a model: each word adds 1 or -1 at a place by its MD5, and the vector is brought to length 1."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = hashlib.md5(w.encode()).hexdigest()
                v[int(h[:4], 16) % dimension] += 1 if int(h[4], 16) % 2 == 0 else -1
            norm = float(np.sqrt((v * v).sum()))
            out.append((v / norm if norm else v).tolist())
        return out

    return run


def embed(rows: DataFrame, text: str, encoder: Encoder, dimension: int = DIMENSION, batch: int = 32, attempts: int = 4, base: float = 0.5, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep, element: T.DataType = T.FloatType()) -> DataFrame:
    """``rows`` with ``embedding`` and ``embedding_error`` (null where it went well); null and blank texts are not sent.

    Batches have ``batch`` texts, at least ``pause`` seconds apart in a task. A busy encoder is asked ``attempts`` times in all,
    after the seconds it names or ``base`` times two, four, ... seconds. Values are stored as floats, or as the encoder
    gave them with ``element`` a double.
    """
    names = [c for c in rows.columns if c not in ("embedding", "embedding_error")]
    plain = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([*(T.StructField(p, rows.schema[c].dataType) for p, c in zip(plain, names, strict=True)), T.StructField("embedding", T.ArrayType(element)), T.StructField("embedding_error", T.StringType())])
    zero = [0.0] * dimension
    stored = pa.list_(pa.float64() if isinstance(element, T.DoubleType) else pa.float32())

    def ask(texts: list[str]) -> tuple[list[list[float]], str | None]:
        for n in range(attempts):
            try:
                got = encoder(texts)
                if len(got) != len(texts) or any(len(v) != dimension for v in got):
                    return [zero] * len(texts), "wrong shape"
                return got, None
            except Busy as e:
                if n + 1 < attempts:
                    sleep(e.seconds if e.seconds is not None else base * 2 ** (n + 1))
            except Exception as e:  # noqa: BLE001  (any failure of a service means no vector)
                return [zero] * len(texts), f"{type(e).__name__}: {e}"[:200]
        return [zero] * len(texts), f"busy after {attempts} attempts"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for b in batches:
            texts = b["text"].to_pylist()
            at = [i for i, t in enumerate(texts) if t and t.strip()]
            vectors: list[list[float]] = [zero] * len(texts)
            errors: list[str | None] = [None if t and t.strip() else "no text" for t in texts]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                if pause and last and (wait := last + pause - time.monotonic()) > 0:
                    sleep(wait)
                last = time.monotonic()
                got, error = ask([texts[i] for i in part])
                for i, v in zip(part, got, strict=True):
                    vectors[i], errors[i] = v, error
            yield pa.RecordBatch.from_arrays([*(b[p] for p in plain), pa.array(vectors, stored), pa.array(errors, pa.string())], names=[*plain, "embedding", "embedding_error"])

    d = rows.select(*[F.col(f"`{c}`").alias(p) for p, c in zip(plain, names, strict=True)], F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(run, schema).toDF(*names, "embedding", "embedding_error")


def _meta(column: str, *names: str) -> Column:
    return F.coalesce(*[F.try_element_at(F.col(column), F.lit(n)) for n in names])


def candidates(tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """(role, target_id, text): what has a text for a role and no vector of that role yet, in the order of creation.

    tables: segment, fact, fact_evidence, procedure, media_artifact, visual_region, embedding_index. Texts are redacted and cut to
    ``MAX_CHARS``. ``limit`` is one for each role, the oldest first. A fact has a row for each of its evidence.
    """
    t = tables
    blank = F.lit("")
    one = lambda d, role, key, body, made: d.select(F.lit(role).alias("role"), F.col(key).alias("target_id"), body.alias("text"), F.col(made).alias("_made"))
    evidence = t["fact"].join(t["fact_evidence"].select("fact_id", "excerpt", F.col("created_at").alias("_seen")), "fact_id")
    regions = t["visual_region"].join(t["media_artifact"].select("tenant", "media_id"), ["tenant", "media_id"], "left_semi")
    said = F.coalesce("excerpt", F.concat_ws(" ", "predicate", F.coalesce("object_value", blank)))
    alive = F.coalesce("lifecycle_state", F.lit("draft")) != "retired"
    rows = (
        one(t["segment"], "text", "segment_id", F.col("content"), "created_at")
        .unionByName(one(evidence, "evidence", "fact_id", said, "_seen"))
        .unionByName(one(t["procedure"].where(alive), "procedure", "procedure_id", F.trim(F.concat_ws(" ", F.coalesce("title", blank), F.coalesce("summary", blank))), "updated_at"))
        .unionByName(one(t["media_artifact"], "media_caption", "media_id", F.coalesce(_meta("media_meta", "caption"), "caption", _meta("media_meta", "description", "title", "alt_text")), "created_at"))
        .unionByName(one(regions, "visual_ocr", "region_id", F.coalesce(_meta("region_meta", "ocr_text"), "ocr_text", _meta("region_meta", "text")), "created_at"))
        .unionByName(one(regions, "visual_caption", "region_id", F.coalesce(_meta("region_meta", "caption"), "label"), "created_at"))
    )
    target = F.coalesce("segment_id", "fact_id", "procedure_id", "media_id", "region_id")
    have = t["embedding_index"].select("role", target.alias("target_id")).distinct()
    d = rows.where(F.trim("text") != "").join(have, ["role", "target_id"], "left_anti")
    if limit is not None:
        from . import ranking

        d = ranking.first_per_key(d, ["role"], [F.asc_nulls_last("_made"), F.asc("target_id"), F.asc("text")], limit)
    return d.select("role", "target_id", F.substring(X.redact_secrets("text"), 1, MAX_CHARS).alias("text"))
