"""Helpers shared by the training-data operators.

* ``work_dir`` / ``materialize`` -- lineage is cut by writing Parquet under ``spark.checkpoint.dir``, the
  folder all executors share; a lost executor never loses such a table.
* ``distinct_texts`` -- one row per distinct text with its number of copies, so that groups of exact copies
  (however large) are combined before anything is compared.
* ``exchange`` / ``settle`` -- the rendezvous used by the substring operators: map tasks send 64 or 128 bit
  keys, already combined within the task, to key buckets; the reduce side tells which keys occur twice.
* ``connected_components`` -- contraction by joins, no component is ever gathered in one place.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Send this module's functions to Python workers by value, so workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local folder only where it is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch, instead of Spark's defaults.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216")}
#: Bytes of text that a map task of the substring operators looks at together.
GATHER = 24 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches in this session, as texts may be long; settings other than Spark's defaults are left alone."""
    for name, (default, value) in BATCH.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``GATHER`` bytes, so that more equal keys are combined before they are sent."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch[column].nbytes
        if size >= GATHER:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    del held
    pa.default_memory_pool().release_unused()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Bytes of text for which a key bucket is provided; a reducer holds the keys of one bucket, about as many bytes.
BUCKET_BYTES = 128 << 20


def key_buckets(docs: DataFrame, text: str) -> int:
    """Key buckets by the size of the texts, which one scan adds up; at least one for each shuffle partition."""
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def with_results(docs: DataFrame, text: str, result: DataFrame) -> DataFrame:
    """``docs`` without the text and columns named like a result, with the results for (h1, h2) of each row's text."""
    new = [c for c in result.columns if c not in ("h1", "h2")]
    keep = [c for c in docs.columns if c != text and c not in new]
    row = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    rows = docs.select(row.alias("_row"), *text_key(F.col(text)))
    return rows.join(result, ["h1", "h2"], "left").select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(keep)], *new)


def text_key(text: F.Column) -> list[F.Column]:
    """128 bits of a text, as two independently seeded 64 bit hashes; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7919), t).alias("h2")]


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, text, copies): one row per distinct text. Copies are combined before the shuffle."""
    one = docs.select(*text_key(F.col(text)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return one.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


# ---------------------------------------------------------------- numpy hashing

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up), 4096)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(m, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


#: Odd bases of the two polynomial hashes (1 - base has one factor two only).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def prefix_hash(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums P with P[i] = sum over k < i of values[k] * base**k, modulo 2**64."""
    up, _ = powers.upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Hashes of all windows of ``length`` values."""
    n = len(prefix) - length
    return (prefix[length:] - prefix[:-length]) * powers.upto(len(prefix))[1][:n]


class WordHash(dict):
    """Bounded cache word -> 64 bit hash."""

    def __init__(self, limit: int = 150_000):
        import xxhash

        super().__init__()
        self.limit, self.f = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = self.f(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column, without decoding it; null as empty."""
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield bytes(view[at[i] : at[i + 1]]) if valid is None or valid[i] else b""


# ---------------------------------------------------------------- rendezvous

#: One row per map batch and key bucket. keys: uint64 key words; multi: 1 if the batch alone shows two
#: occurrences; at, counts, docs: where the keys are, as positions, run lengths and the documents' keys.
#: The s_ columns hold places that are settled already and pass through.
WIRE = "bucket int, keys binary, multi binary, pos binary, counts binary, docs binary, s_pos binary, s_counts binary, s_docs binary"
PLACES = "h1 long, h2 long, pos binary"
_NONE = np.zeros(0, np.int64)


def _places(doc: np.ndarray, pos: np.ndarray, table: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """doc: for each place its row of table, in runs."""
    if not len(doc):
        return b"", b"", b""
    cut = np.flatnonzero(np.diff(doc)) + 1
    first = np.concatenate([[0], cut])
    return pos.astype(np.int32).tobytes(), np.diff(np.concatenate([first, [len(doc)]])).astype(np.int32).tobytes(), table[doc[first]].tobytes()


def wire(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, table: np.ndarray, twice: np.ndarray, silent: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of WIRE for one batch.

    keys: (n, k) uint64; doc, pos: where each is; table: (documents, 2) int64 keys of the documents; twice:
    per document, whether it stands for several copies; silent: per document, whether it needs no answer.
    Equal keys of the batch are combined: one of them is sent, all of them are settled.
    """
    order = np.lexsort(keys.T)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    size = np.bincount(group, minlength=group[-1] + 1 if len(group) else 0)
    many = (size > 1) | (np.bincount(group, weights=twice[doc[order]], minlength=len(size)) > 0)
    answer = ~silent[doc[order]]
    settled = order[many[group] & answer]
    send = np.flatnonzero(new)
    lone, sent_multi = order[send], many
    out: dict[str, list] = {c.split()[0]: [] for c in WIRE.split(", ")}
    for places, names in (((lone, sent_multi), ("pos", "counts", "docs")), ((settled, None), ("s_pos", "s_counts", "s_docs"))):
        index, flags = places
        bucket = (mix(keys[index, 0]) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((pos[index], doc[index], bucket))
        index, bucket = index[by], bucket[by]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in range(buckets):
            part = index[edge[b] : edge[b + 1]]
            for name, blob in zip(names, _places(doc[part], pos[part], table), strict=True):
                out[name].append(blob)
            if flags is not None:
                out["keys"].append(keys[part].tobytes())
                out["multi"].append(flags[by][edge[b] : edge[b + 1]].astype(np.uint8).tobytes())
    out["bucket"] = list(range(buckets))
    full = [i for i in range(buckets) if out["pos"][i] or out["s_pos"][i]]
    types = {"bucket": pa.int32()}
    return pa.RecordBatch.from_pydict({c: pa.array([v[i] for i in full], types.get(c, pa.binary())) for c, v in out.items()})


def _gather(table: pa.Table, pos: str, counts: str, docs: str) -> tuple[np.ndarray, np.ndarray]:
    p = np.frombuffer(b"".join(table[pos].to_pylist()), np.int32)
    c = np.frombuffer(b"".join(table[counts].to_pylist()), np.int32)
    d = np.frombuffer(b"".join(table[docs].to_pylist()), np.int64).reshape(-1, 2)
    return p, np.repeat(np.arange(len(c)), c) if len(c) else _NONE, d  # type: ignore[return-value]


#: One row per reducer and home bucket of documents.
HOMES = "home int, pos binary, counts binary, docs binary"


def homes_table(pos: np.ndarray, run: np.ndarray, docs: np.ndarray, homes: int) -> pa.Table:
    """Places, as runs of documents, dealt to the home buckets of their documents."""
    rows: dict[str, list] = {c.split()[0]: [] for c in HOMES.split(", ")}
    if len(run):
        home = (mix(docs[:, 0].astype(np.uint64) ^ mix(docs[:, 1].astype(np.uint64))) % np.uint64(homes)).astype(np.int64)[run]
        order = np.lexsort((run, home))
        edge = np.searchsorted(home[order], np.arange(homes + 1))
        for b in np.flatnonzero(np.diff(edge)).tolist():
            part = order[edge[b] : edge[b + 1]]
            rows["home"].append(b)
            for name, blob in zip(("pos", "counts", "docs"), _places(run[part], pos[part], docs), strict=True):
                rows[name].append(blob)
    return pa.table({c: pa.array(v, pa.int32() if c == "home" else pa.binary()) for c, v in rows.items()})


def at_home(table: pa.Table) -> pa.Table:
    """One row per document of a home bucket, with all its places in the order they came."""
    pos, run, docs = _gather(table, "pos", "counts", "docs")
    unique, doc = np.unique(docs, axis=0, return_inverse=True)
    doc = doc.ravel()[run] if len(run) else run
    order = np.argsort(doc, kind="stable")
    edge = np.searchsorted(doc[order], np.arange(len(unique) + 1)) * 4
    raw = pos[order].astype(np.int32).tobytes()
    return pa.table({"h1": pa.array(unique[:, 0], pa.int64()), "h2": pa.array(unique[:, 1], pa.int64()), "pos": pa.array([raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary())})


def by_document(homes: DataFrame) -> DataFrame:
    return homes.groupBy("home").applyInArrow(at_home, PLACES)


def settle(words: int, homes: int) -> Callable[[pa.Table], pa.Table]:
    """Reduce side: the places whose key of ``words`` 64 bit words occurs twice or more."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64).reshape(-1, words)
        multi = np.frombuffer(b"".join(table["multi"].to_pylist()), np.uint8)
        pos, at, docs = _gather(table, "pos", "counts", "docs")
        order = np.lexsort(keys.T)
        k = keys[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        n = int(group[-1]) + 1 if len(group) else 0
        seen = np.bincount(group, minlength=n) + np.bincount(group, weights=multi[order], minlength=n)
        hit = np.zeros(len(k), bool)
        hit[order] = seen[group] > 1
        hit &= multi == 0
        s_pos, s_at, s_docs = _gather(table, "s_pos", "s_counts", "s_docs")
        return homes_table(np.concatenate([pos[hit], s_pos]), np.concatenate([at[hit], s_at + len(docs)]), np.concatenate([docs, s_docs]), homes)

    return run


def exchange(wired: DataFrame, words: int, buckets: int) -> DataFrame:
    """(h1, h2, pos): for each document the places whose keys occur elsewhere too, as int32 bytes."""
    return by_document(wired.groupBy("bucket").applyInArrow(settle(words, buckets), HOMES))


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all ids in ``edges`` (two columns of longs); component is the smallest id reached.

    Hooking and shortcutting on the contracted graph: every label takes its smallest neighbouring label,
    chains are shortened by two jumps, and edges inside a component vanish, until none is left. Each round is
    three small joins whose results are written to the shared folder; a hub is a key of partial minima.
    """
    edges = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    rest = edges
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b"), F.col("a")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("up"))
        up = materialize(up)
        for _ in range(2):
            far = up.select(F.col("x").alias("up"), F.col("up").alias("top"))
            up = up.join(far, "up", "left").select("x", F.coalesce("top", "up").alias("up"))
        up = materialize(up)
        labels = materialize(labels.join(up.withColumnRenamed("x", "component"), "component", "left").select("id", F.coalesce("up", "component").alias("component")))
        l, r = up.select(F.col("x").alias("a"), F.col("up").alias("la")), up.select(F.col("x").alias("b"), F.col("up").alias("lb"))
        rest = materialize(rest.join(l, "a").join(r, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct())
    return labels
