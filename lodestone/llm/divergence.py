"""Source divergence audit: how far the word use of each (language, source) group lies from its sister groups.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms of at least
``min_docs`` of its documents (V of them). A group gives each kept term the integer probability
p = 1 + floor(scale * (count + 1) / (N + V)), N its occurrences of kept terms. The divergence of a group from another is
the sum over kept terms of floor((p - q) * (p - q) / q), all in integers.

The sum over terms is split by the number of groups that use a term. Terms of more than ``dense_share`` of the language's
groups are heavy: tiles of them become dense numpy matrices (groups x terms), compared row by row. All others are light: a group
that lacks such a term has its constant p0 there, so the sum is first taken as if no two groups shared a light term
(their number times the constant, corrected by how often each p occurs in a group), and the pairs inside each posting
list then correct what they share. Each tile of either kind gives partial sums of (group, group); Spark adds them up.

Counts are combined within each Arrow batch and again before the shuffle. Lists of a term are no longer than the
language's number of groups, the square of which is the size of the result; tiles hold about ``TILE`` entries.

Defined cases: null text, lang or source count as ''; each row is a document; a group without terms has count 0 for
every kept term; without kept terms all values of pairs are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, gathered, materialize, ship, utf8

ship(__name__)

SCALE = 1_000_000_000
#: Entries of a tile; cells of a dense tile that are compared at once.
TILE, CELLS = 1 << 17, 1 << 20
#: Every byte that no term holds becomes a space; A-Z become a-z.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def _count_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of each gathered batch; a row with a null term for each of its groups."""
    for batch in gathered(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), utf8(batch["text"]), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(_TERM_BYTES).split()
            n.update(terms)
            docs.update(set(terms))
        for (lang, source), (n, docs) in groups.items():
            size = len(n) + 1
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """COUNTS by (lang, source, term), with a row of null term for each group."""
    bounded_batches(docs.sparkSession)
    blank = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return blank.mapInArrow(_count_batch, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: str, total: str) -> F.Column:
    """1 + floor(scale * (n + 1) / (total + v)) in decimals, so that no count overflows."""
    return F.expr(f"1 + cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0)) div cast({total} + v as decimal(20, 0))")


def _f(p: str, q: str) -> F.Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _g(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


PARTIAL = "lang string, a int, b int, v long"


def _dense(i: np.ndarray, p: np.ndarray, t: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sums over the tile's terms for all ordered pairs of groups."""
    size = len(p0)
    _, column = np.unique(t, return_inverse=True)
    tile = np.repeat(p0[:, None], column.max() + 1, axis=1)
    tile[i, column] = p
    step = max(1, CELLS // tile.size)
    for a in range(0, size, step):
        v = _g(tile[a : a + step, None, :], tile[None, :, :]).sum(axis=2)
        yield np.repeat(np.arange(a, a + len(v)), size), np.tile(np.arange(size), len(v)), v.ravel()


def _pairs(i: np.ndarray, p: np.ndarray, t: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For two groups that share a light term: their value, less what each alone was counted for."""
    order = np.argsort(t, kind="stable")
    i, p, t = i[order], p[order], t[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    length = np.diff(np.concatenate([first, [len(t)]]))
    start, many = np.repeat(first, length), np.repeat(length, length)
    done = np.concatenate([[0], np.cumsum(many)])
    at = 0
    while at < len(i):  # entries whose partners are about CELLS rows together
        to = max(at + 1, int(np.searchsorted(done, done[at] + CELLS, "right")) - 1)
        a = np.repeat(np.arange(at, to), many[at:to])
        b = np.arange(len(a)) - np.repeat(done[at:to] - done[at], many[at:to]) + np.repeat(start[at:to], many[at:to])
        a, b = a[a != b], b[a != b]
        x, y = p0[i[a]], p0[i[b]]
        v = _g(p[a], p[b]) - _g(p[a], y) - _g(x, p[b]) + _g(x, y)
        code, where = np.unique(i[a].astype(np.int64) * len(p0) + i[b], return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, where, v)
        yield code // len(p0), code % len(p0), total
        at = to


def _alone(i: np.ndarray, p: np.ndarray, m: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For m light terms of one p in a group: their value against any group that lacks them, less the constant."""
    every, size = np.arange(len(p0)), len(p0)
    for a in np.unique(i):
        own, times = p[i == a][:, None], m[i == a][:, None]
        out, back = np.zeros(size, np.int64), np.zeros(size, np.int64)
        step = max(1, CELLS // size)
        for k in range(0, len(own), step):
            q, n = own[k : k + step], times[k : k + step]
            out += (n * (_g(q, p0[None, :]) - _g(p0[a], p0)[None, :])).sum(axis=0)
            back += (n * (_g(p0[None, :], q) - _g(p0, p0[a])[None, :])).sum(axis=0)
        yield np.full(size, a), every, out
        yield every, np.full(size, a), back


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARTIAL of each tile: kind, lang, p0 of the language's groups, and entries (i, p, term, m)."""
    work = {"dense": _dense, "pairs": _pairs, "alone": _alone}
    for batch in batches:
        for k in range(batch.num_rows):
            entries = batch["entries"][k].values
            kind = batch["kind"][k].as_py()
            i, p = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("i", "p"))
            x = entries.field("m").to_numpy(zero_copy_only=False) if kind == "alone" else entries.field("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            p0 = batch["p0"][k].values.to_numpy(zero_copy_only=False)
            lang = batch["lang"][k].as_py()
            for a, b, v in work[kind](i, p, x, p0):
                use = (a != b) & (v != 0)
                a, b, v = a[use], b[use], v[use]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.int64())], names=["lang", "a", "b", "v"])


#: A language's rows are dealt to so many parts where they meet a table by language.
SALTS = 32


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _tiled(rows: DataFrame, kind: str, by: str, sizes: DataFrame) -> DataFrame:
    """Tiles (kind, lang, tile, entries) of rows (lang, i, p, term, m); rows of one ``by`` stay together. sizes: (lang, salt, n)."""
    h = F.xxhash64(by)
    rows = rows.withColumn("salt", F.pmod(F.shiftright(h, 32), F.lit(SALTS)).cast("int")).join(sizes, ["lang", "salt"])
    rows = rows.withColumn("tile", F.pmod(h, F.ceil(F.col("n") / TILE)))
    return rows.groupBy("lang", "tile").agg(F.collect_list(F.struct("i", "p", "term", "m")).alias("entries")).select(F.lit(kind).alias("kind"), "lang", "tile", "entries")


def audit(docs: DataFrame, min_docs: int = 3, term_ranks: int = 200, dense_share: float = 0.25) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the divergence from each other source of the language,
    part ``term`` the kept terms that a group uses more than its language, by their share of the divergence from it."""
    counts = materialize(term_counts(docs))
    in_lang = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").withColumns({"d": F.sum("docs").over(in_lang), "n_lang": F.sum("n").over(in_lang), "k": F.count("*").over(in_lang)})
    kept = materialize(kept.where(F.col("d") >= min_docs).select("lang", "source", "term", "n", "n_lang", "k"))
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count("*").alias("v"))
    groups = counts.where("term is null").select("lang", "source").join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["total", "total_lang", "v"])
    groups = groups.withColumns({"i": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, "g": F.count("*").over(Window.partitionBy("lang"))})
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, _p("0", "total")))
    groups = materialize(groups)

    dealt = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    used = dealt.join(_salted(groups), ["lang", "source", "salt"]).withColumns({"p": _p("n", "total"), "q": _p("n_lang", "total_lang")})
    used = materialize(used.select("lang", "source", "term", "i", "p", "q", (F.col("k") > dense_share * F.col("g")).alias("heavy")))
    terms = used.where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
    best = [F.desc("value"), F.asc("item")]
    salted = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(32))).orderBy(*best)
    terms = terms.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= term_ranks).drop("r")
    by_group = Window.partitionBy("lang", "source").orderBy(*best)
    terms = terms.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= term_ranks)

    entry = used.select("lang", "i", "p", "term", F.lit(None).cast("long").alias("m"), "heavy")
    light = entry.where("not heavy")
    alone = light.groupBy("lang", "i", "p").agg(F.lit(None).cast("string").alias("term"), F.count("*").alias("m"))
    # Written first, so that their size is known when they are joined.
    sizes = materialize(entry.groupBy("lang").agg(F.count_if("heavy").alias("dense"), F.count_if(~F.col("heavy")).alias("pairs")))
    of = lambda kind: _salted(sizes.select("lang", F.greatest(kind, F.lit(1)).alias("n")))
    tiles = _tiled(entry.where("heavy"), "dense", "term", of("dense")).unionByName(_tiled(light, "pairs", "term", of("pairs"))).unionByName(_tiled(alone, "alone", "i", of("pairs")))
    p0 = materialize(groups.where("v > 0").groupBy("lang").agg(F.expr("transform(array_sort(collect_list(struct(i, p0))), s -> s.p0)").alias("p0")))
    tiles = tiles.withColumn("salt", F.pmod("tile", F.lit(SALTS)).cast("int")).join(_salted(p0), ["lang", "salt"])
    sums = tiles.mapInArrow(_partial_sums, PARTIAL).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))

    n_light = used.where("not heavy").select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("light"))
    a = groups.select("lang", F.col("source"), F.col("i").alias("a"), F.col("p0").alias("pa")).join(n_light, "lang", "left")
    b = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("b"), F.col("p0").alias("pb"))
    pairs = a.join(b, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("light") * _f("pa", "pb"), F.lit(0)) + F.coalesce("v", F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(by_group))
    out = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return out(pairs, "pair").unionByName(out(terms, "term"))
