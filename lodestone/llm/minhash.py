"""Near-duplicate detection with min-max hashing.

Each document's set of word shingles is hashed under ``PERMUTATIONS`` permutations and both the minimum and
the maximum under each are kept: two unbiased estimates of the Jaccard similarity for one evaluation. The
values form ``2 * PERMUTATIONS // ROWS`` bands. Documents that share a band are candidates; links are confirmed
on the full shingle sets. At a similarity of 0.85 the 26 bands of 5 miss a pair with probability 2.4e-7.

No group is ever expanded into all its pairs:

1. Documents with equal sets are combined by the digest of the set; one of each goes on.
2. Documents connected by shared bands form a group. Its pivot is the member whose bands hold most documents, in
   a group of near copies one close to what they are copies of. Every member is compared with the pivot, exactly;
   links with it connect most of the group.
3. For x and y near a pivot p, what x and y do not share is what their differences from p do not share. So
   members that are not linked with p are looked up by those differences: near copies differ from p in
   places of their own, so the rarest elements of a difference, as many as the exact threshold
   asks for (prefix and position filter), meet few others. Only pairs found so are compared.
   A group may hold crowds of its own, such as copies of another edition: of the members that are not linked with the pivot,
   those of bands that ``CROWD`` of them share are compared with pivots of their own, the least member of each such band. What
   one pivot links is connected, so the look-up is for pairs of different crowds only, and elements that one crowd alone
   holds are not looked up at all.
4. Members farther than ``NEAR`` from the pivot get a pivot of their own group in a next turn; after ``TURNS``
   turns the rest are looked up by the rarest elements of the sets themselves. All steps are exact: a pair
   that links is near a pivot together or in the rest together. No bucket is capped.

Pivots' sets are salted in proportion to their partners. Hubs of the joins on groups, ids and elements
are narrow rows; adaptive execution splits such keys.

Defined cases: null or empty texts have an empty set and are linked to nothing; with fewer words than a shingle
the whole sequence is the one shingle; a null id is its own component and is kept; rows that share an id are
one node, linked by what any of them is linked by; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Powers, WordHash, bounded_batches, connected_components, materialize, mix, prefix_hash, ship, utf8, window_hash

ship(__name__)

PERMUTATIONS, ROWS, PARTNERS = 65, 5, 128
#: Turns with a pivot, and the distance (per cent) within which a node is settled by one.
TURNS, NEAR = 2, 50
#: Members of a band from which on they get a pivot of their own.
CROWD = 16
_RNG = np.random.Generator(np.random.PCG64(42))
#: Odd multipliers and offsets of the permutations of 32 bit values.
A = (_RNG.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
B = _RNG.integers(0, 1 << 32, PERMUTATIONS, np.uint32)[:, None]


def shingles(text: bytes, size: int, hashes: WordHash, powers: Powers) -> np.ndarray:
    """Sorted distinct 64 bit hashes of the word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = mix(window_hash(prefix_hash(hashes.of(words), powers), min(size, len(words)), powers))
    # a short sequence must not equal a shingle: it never has ``size`` words, so its length is mixed in
    return np.unique(h if len(words) >= size else mix(h + np.uint64(len(words))))


def signature(h: np.ndarray) -> np.ndarray:
    """Minima and maxima under all permutations."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    most = np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 8192):
        p = A * x[None, i : i + 8192] + B
        p ^= p >> np.uint32(15)
        np.minimum(least, p.min(axis=1), out=least)
        np.maximum(most, p.max(axis=1), out=most)
    return np.concatenate([least, most])


_BAND = np.arange(2 * PERMUTATIONS // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values[: len(_BAND) * ROWS].reshape(len(_BAND), ROWS).astype(np.uint64)
    key = _BAND.copy()
    for j in range(ROWS):
        key = mix(key ^ v[:, j])
    return key


def _kind(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n_shingles, s1, s2, bands): s1 and s2 are a 128 bit digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, powers = WordHash(), Powers(BASES[0])
        for batch in batches:
            n, digests, bands = [], [], []
            for t in utf8(batch["text"]):
                h = shingles(t, size, hashes, powers)
                n.append(len(h))
                if len(h):
                    d = xxhash.xxh3_128_digest(h.tobytes())
                    digests.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
                    bands.append(band_keys(signature(h)).view(np.int64))
                else:
                    digests.append((None, None))
                    bands.append(None)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "n_shingles": pa.array(n, pa.int64()), "s1": pa.array([d[0] for d in digests], pa.int64()), "s2": pa.array([d[1] for d in digests], pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {_kind(docs, key)}, n_shingles long, s1 long, s2 long, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, v, hashes) of (id, text): v is s1 of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, powers = WordHash(), Powers(BASES[0])
        for batch in batches:
            sets = [shingles(t, size, hashes, powers) for t in utf8(batch["text"])]
            v = [int.from_bytes(xxhash.xxh3_128_digest(h.tobytes())[:8], "little", signed=True) for h in sets]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "v": pa.array(v, pa.int64()), "hashes": _lists([h.view(np.int64) for h in sets])})

    return docs.select("id", "text").mapInArrow(run, f"id {_kind(docs, 'id')}, v long, hashes array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of int64 arrays."""
    edges = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), pa.int64()))


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a list column of int64, without copies."""
    edges = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a set and its pivot's do not share, and how many they share."""
    for batch in batches:
        common, diff = [], []
        for a, b in zip(_rows(batch["hashes"]), _rows(batch["p_hashes"]), strict=True):
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            twice = both[1:] == both[:-1]
            common.append(int(twice.sum()))
            single = np.ones(len(both), bool)
            single[1:] &= ~twice
            single[:-1] &= ~twice
            diff.append(both[single])
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("g", "id", "v", "n", "pn", "p")), pa.array(common, pa.int64()), _lists(diff)], names=["g", "id", "v", "n", "pn", "p", "common", "d"])


def _placed(members: DataFrame) -> DataFrame:
    """(id, v, n, g, p, pv, pn, salts): the group of each node, by shared bands, and the group's pivot, its most central node."""
    met = materialize(members.groupBy("id", "v", "n", "lead").agg(F.sum("m").alias("m")))
    groups = connected_components(met.select("id", "lead"), "id", "lead").withColumnRenamed("component", "g")
    nodes = materialize(met.groupBy("id", "v", "n").agg(F.sum("m").alias("m")).join(groups, "id"))
    pivots = nodes.groupBy("g").agg(F.max_by(F.struct("id", "v", "n"), F.struct("m", F.xxhash64("id", "v"))).alias("p"), (F.floor((F.count("*") - 1) / PARTNERS) + 1).alias("salts"))
    return materialize(nodes.join(pivots, "g").select("id", "v", "n", "g", F.col("p.id").alias("p"), F.col("p.v").alias("pv"), F.col("p.n").alias("pn"), "salts"))


def _met(placed: DataFrame, sets: DataFrame, pivots: DataFrame) -> DataFrame:
    """Nodes (g, id, v, n, p, pn, salts) with their pivot's set compared: (g, id, v, n, pn, p, common, d). pivots: (g, p, pv, salts)."""
    kind = _kind(placed, "id")
    left = placed.join(sets, ["id", "v"]).withColumn("salt", F.pmod(F.xxhash64("id", "v"), "salts")).drop("salts")
    of = sets.select(F.col("id").alias("p"), F.col("v").alias("pv"), F.col("hashes").alias("p_hashes"))
    salted = pivots.join(of, ["p", "pv"]).dropDuplicates(["g"]).select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "p_hashes")
    return left.join(salted, ["g", "salt"]).select("g", "id", "v", "n", "pn", "p", "hashes", "p_hashes").mapInArrow(_difference, f"g {kind}, id {kind}, v long, n long, pn long, p {kind}, common long, d array<long>")


def _crowds(rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame] | None:
    """(links (a, b), labels (id, label)) of the nodes that link with a pivot of a crowd. rows: (band, id, v, n).

    A crowd is a band of ``CROWD`` nodes or more, its pivot the least id. A node is compared with the pivots of all its crowds,
    most of which share few; what these links connect has one label.
    """
    crowd = _shared(rows, CROWD)
    if crowd.isEmpty():
        return None
    nodes = materialize(crowd.select("id", "v", "n", F.col("lead").alias("p")).distinct())
    which = nodes.groupBy(F.col("id").alias("p")).agg(F.min(F.struct("v", "n")).alias("x")).select("p", F.col("x.v").alias("pv"), F.col("x.n").alias("pn"))
    pivots = materialize(nodes.groupBy("p").agg((F.floor((F.count("*") - 1) / PARTNERS) + 1).alias("salts")).join(which, "p").withColumn("g", F.col("p")))
    linked = _met(nodes.join(pivots.select("g", "p", "pn", "salts"), "p").where("id <> p"), sets, pivots).where(f"100 * common >= {percent} * (n + pn - common)")
    linked = materialize(linked.select(F.col("id").alias("a"), F.col("p").alias("b")))
    return linked, materialize(connected_components(linked).withColumnRenamed("component", "label"))


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``nodes`` (id, v, linked, p) with the label of their crowd, of the pivot they are linked with, or their own."""
    own = F.when(F.col("linked"), F.col("p")).otherwise(F.col("id"))
    if labels is None:
        return nodes.withColumn("label", own)
    c = labels.withColumnRenamed("label", "_crowd")
    return nodes.join(c, "id", "left").withColumn("label", F.coalesce("_crowd", own)).drop("_crowd")


def _need(percent: int, a: str, b: str, n: str) -> str:
    """SQL: 2 * (100 + percent) times the least overlap of two difference sets of sizes a and b, given both sets' sizes' sum n."""
    return f"({100 + percent} * ({a} + {b}) - {100 - percent} * ({n}))"


def _late_pairs(near: DataFrame, percent: int, pivoted: bool) -> DataFrame:
    """Links between nodes of a group with different labels: near has (g, id, v, n, pn, linked, label, d), d being the set, or its difference from the pivot's.

    Two sets link if their differences overlap by what ``_need`` says. Elements are ordered by how many of the
    group have them, the rare first, those that one label alone has before all; sets that overlap by o share one of the first size - o + 1 elements
    of each. So only those are posted, and a pair is made where the places of a shared element leave room for o.
    """
    near = near.withColumn("a", F.size("d"))
    tokens = near.select("g", "id", "v", "n", "pn", "a", "linked", "label", F.explode("d").alias("e"))
    often = tokens.groupBy("g", "e").agg(F.count("*").alias("f"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("lo", "hi")
    ordered = tokens.join(often, ["g", "e"]).groupBy("g", "id", "v", "n", "pn", "a", "linked", "label").agg(F.sort_array(F.collect_set(F.struct("f", "e"))).alias("s"))
    posted = ordered.select("g", "id", "v", "n", "pn", "a", "linked", "label", F.size("s").alias("z"), F.posexplode("s").alias("k", "s")).select("g", "id", "v", "n", "a", "linked", "label", "pn", F.col("s.e").alias("e"), F.expr("a - z + k + 1").alias("at"))
    # The least that any partner can ask for, as the smaller and as the larger of two differences.
    most = f"(n + floor(100 * n / {percent}))"
    if pivoted:
        # a node that is not linked with the pivot differs from it by more than this
        apart = f"{(100 - percent) / (100 + percent)} * ({percent / 100} * n + pn)"
        as_small = _need(percent, "a", f"greatest(a, if(linked, {apart}, 0))", most)
        as_large = _need(percent, "a", f"greatest(if(linked, {apart}, 0), a - {(100 - percent) / (100 + percent)} * {most})", most)
    else:
        as_small, as_large = f"{4 * percent} * n", f"{2 * percent} * (n + {percent / 100} * n)"
    room = f"{2 * (100 + percent)} * (a - at + 1) + 1"  # one more, for rounding
    posted = materialize(posted.withColumns({"small": F.expr(f"{room} >= {as_small}"), "large": F.expr(f"{room} >= {as_large}")}).where("small or large").drop("pn"))
    x = posted.where("small").select("g", "e", *[F.col(c).alias(f"x_{c}") for c in ("id", "v", "n", "a", "at", "label")])
    y = posted.where("large").select("g", "e", *[F.col(c).alias(f"y_{c}") for c in ("id", "v", "n", "a", "at", "label")])
    asked = _need(percent, "x_a", "y_a", "x_n + y_n")
    rest = f"{2 * (100 + percent)} * (least(x_a - x_at, y_a - y_at) + 1) >= {asked}"
    fits = f"100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n) and (x_a, x_id, x_v) < (y_a, y_id, y_v) and x_id <> y_id and x_label <> y_label"
    pairs = materialize(x.join(y, ["g", "e"]).where(f"{fits} and {rest}").select("g", "x_id", "x_v", "x_n", "x_a", "y_id", "y_v", "y_n", "y_a").distinct())
    own = lambda s: near.select("g", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "v", "d")])
    met = pairs.join(own("x"), ["g", "x_id", "x_v"]).join(own("y"), ["g", "y_id", "y_v"])
    return met.where(f"{2 * (100 + percent)} * size(array_intersect(x_d, y_d)) >= {asked}").select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))


def links(docs: DataFrame, members: DataFrame, size: int, percent: int) -> list[DataFrame]:
    """Tables of links (a, b) that connect whatever the links among ``members`` connect. docs: (id, text)."""
    found = []
    sets = None
    for turn in range(TURNS + 1):
        if members.isEmpty():
            return found
        placed = _placed(members)
        if sets is None:
            sets = materialize(_sets(docs.join(placed.select("id").distinct(), "id", "left_semi"), size))
        if turn == TURNS:  # what no pivot is near to: the sets themselves are compared
            rest = placed.select("id", "v", "n", "g").join(sets, ["id", "v"]).select("g", "id", "v", "n", F.lit(0).alias("pn"), F.lit(False).alias("linked"), F.col("id").alias("p"), F.col("hashes").alias("d"))
            crowds = _crowds(members.drop("m", "lead"), sets, percent)
            if crowds:
                found.append(crowds[0])
            rest = _labelled(rest, crowds and crowds[1])
            return [*found, materialize(_late_pairs(rest, percent, False))]
        # A pair that links has its first member within NEAR of a pivot at a turn at which both are within NEAR + 100 - percent.
        wide = max(0, 100 - NEAR - (100 - percent))
        sized = placed.where(f"100 * least(n, pn) >= {wide} * greatest(n, pn)")
        compared = _met(sized, sets, placed.where("id = p and v = pv").select("g", "p", "pv", "salts"))
        compared = compared.where(f"100 * common >= {wide} * (n + pn - common)")
        compared = materialize(compared.withColumn("linked", F.expr(f"100 * common >= {percent} * (n + pn - common)")))
        found.append(compared.where("linked and id <> p").select(F.col("id").alias("a"), F.col("p").alias("b")))
        # Nodes linked with the pivot are connected already; if all near it are, nothing is left to look at.
        reach = F.expr(f"{100 - percent} * n - {100 + percent} * size(d)")
        state = compared.groupBy("g").agg(F.count_if(~F.col("linked")).alias("open"), F.max_by(F.struct("id", reach.alias("reach")), F.when(F.col("linked"), reach)).alias("best"))
        state = state.where("open > 0").select("g", F.col("best.id").alias("b"), F.col("best.reach").alias("reach"))
        near = compared.join(state, "g")
        # Differences so small together that they need no overlap: the far-reaching member links without a look.
        sure = f"not linked and id <> b and {100 - percent} * n - {100 + percent} * size(d) + reach >= 0"
        found.append(near.where(sure).select(F.col("id").alias("a"), "b"))
        open_ = compared.where("not linked").select("id", "v")
        crowds = _crowds(members.drop("m", "lead").join(open_, ["id", "v"], "left_semi"), sets, percent)
        if crowds:
            found.append(crowds[0])
        found.append(materialize(_late_pairs(_labelled(near, crowds and crowds[1]).drop("b", "reach", "p", "common"), percent, True)))
        done = compared.where(f"100 * common >= {100 - NEAR} * (n + pn - common)").select("id", "v")
        left_over = members.drop("m", "lead").join(placed.select("id", "v"), ["id", "v"], "left_semi").join(done, ["id", "v"], "left_anti")
        members = _shared(left_over)
    return found


def _shared(rows: DataFrame, least: int = 2) -> DataFrame:
    """The rows (band, id, v, n) whose band has several, ``least`` at least, with its size and least id."""
    shared = rows.groupBy("band").agg(F.count("*").alias("m"), F.min("id").alias("lead"), F.max("id").alias("last")).where(F.col("m") >= least).where("lead <> last").drop("last")
    return materialize(rows.join(shared, "band"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable), kept (whether that is its own)."""
    bounded_batches(docs.sparkSession)
    signed = materialize(signatures(docs, key, text, size))
    usable = signed.where("s1 is not null and id is not null")
    reps = usable.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    same = usable.select("id", "s1", "s2").join(reps, ["s1", "s2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    rows = usable.join(reps.withColumnRenamed("rep", "id"), ["s1", "s2", "id"]).dropDuplicates(["s1", "s2"])
    rows = rows.select(F.explode(F.array_distinct("bands")).alias("band"), "id", F.col("s1").alias("v"), F.col("n_shingles").alias("n"))
    found = links(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), _shared(rows), size, percent)
    edges = same
    for table in found:
        edges = edges.union(table)
    joined = connected_components(edges).withColumnRenamed("component", "component_id")
    own = F.coalesce("component_id", "id")
    out = signed.join(joined, "id", "left")
    return out.select(F.col("id").alias(key), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not the representative of its group; all rows with the representative's id stay.

    The ids that go are usually the smaller side, so they are what is joined.
    """
    gone = near_duplicates(docs.select(key, text), size, percent, key, text).where(~F.col("kept")).select(key).distinct()
    return docs.join(gone, key, "left_anti").select(*docs.columns)


def keep_one_row(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group, however often its id is repeated and whether or not it has one.

    Of rows that share the representative's id the least by a hash stays. Rows without an id are linked like all
    others: their texts are numbered by hash, above the largest id where there is room. Those without a word stay.
    Ids that are not whole numbers are compared as strings. A column named ``_lodestone_node`` is replaced.
    """
    whole = _kind(docs, key) in ("tinyint", "smallint", "int", "bigint")
    ids = F.col(key).cast("long") if whole else F.col(key).cast("string")
    found = docs.agg(F.max(ids).alias("top"), F.count_if(ids.isNull()).alias("nulls")).first()
    node = ids
    if found.nulls:
        h = F.xxhash64(text)
        if whole:
            top = max(found.top or 0, 0)
            number = h if top >= 1 << 62 else F.shiftrightunsigned(h, 2) + F.lit(top + 1)
        else:  # behind all other ids
            number = F.concat(F.lit(found.top or ""), F.lit("\U0010ffff"), F.hex(h), F.hex(F.xxhash64(F.lit(1), text)))
        node = F.coalesce(ids, F.when(F.col(text).rlike(r"[^ \t-\r]"), number))
    d = docs.withColumn("_lodestone_node", node)
    groups = near_duplicates(d.select("_lodestone_node", text), size, percent, "_lodestone_node", text).where("_lodestone_node is not null").groupBy("_lodestone_node")
    special = materialize(groups.agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    out = d.join(special, "_lodestone_node", "left_anti").select(*docs.columns)
    repeated = special.where("kept").select("_lodestone_node")
    if repeated.isEmpty():
        return out
    # Each map task sends one row of an id, so an id repeated in many rows is no hot key.
    order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    rows = d.join(repeated, "_lodestone_node", "left_semi").groupBy("_lodestone_node").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return out.union(rows.select("row.*"))
