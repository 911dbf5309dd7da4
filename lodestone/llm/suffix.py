"""Exact substring dedup over bytes, by a hash-compared suffix sort of candidate suffixes.

1. Candidates. In every ``length``-byte string the position of the least hash among its first
   ``length - gram + 1`` grams is its anchor (leftmost on ties), so equal strings have equal anchors at equal
   places. Anchors are sparse, about one in (length - gram) / 2 bytes; only those whose gram occurs twice go on.
2. Cells. The strings of one anchor are dealt into cells of ``CELL`` neighbouring starts. All strings of a cell
   share its core, and the cell's extent holds them all; cells meet by the hash of their core. Cells of equal
   extent (by a digest, then by their bytes) are combined in the map task and again in the reducer: every string of a repeated extent is repeated.
3. Suffix sort. Where a core has several extents, the suffixes of the extents that start at the cell's strings
   are sorted: prefix polynomial hashes and a binary search give the common extension of two suffixes, so a
   comparison takes a logarithmic number of steps, in a bottom-up mergesort. A suffix whose common extension
   with a neighbour reaches ``length`` is a repeated string, once its bytes are compared as well.

Skew: exact copies are combined first; equal extents are combined in each task. Where one task alone sees more
than ``SPREAD`` different extents of a core, these are spread over all buckets by their own hash; each bucket
then settles what it can and passes one witness per string on to a last exchange by the strings' own digests,
where their bytes are compared as well.

Defined cases: null or empty text has no bytes; shorter texts lose nothing; repeated rows are copies and lose
all bytes; an empty table gives an empty result; other columns pass, whatever their names (``clean``), but for those
named like a result (``dedup_bytes``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, HOMES, WIRE, Powers, _gather, _places, by_document, distinct_texts, exchange, gathered, homes_table, key_buckets, mix, prefix_hash, ship, utf8, window_hash, wire, with_results
from .substring import _documents, _marks, covered

ship(__name__)

GRAM, CELL, BLOCK, SPREAD = 50, 32, 1 << 20, 256
#: A fixed random 64 bit value for each byte.
BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = np.uint64((1 << 24) - 1)


def cell_size(length: int) -> int:
    return max(1, min(CELL, length // 4))


def anchor_runs(data: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, gram hash) of each run of ``length``-byte strings with one anchor."""
    gram = max(1, min(GRAM, length // 4))
    reach = length - gram + 1
    out = []
    for base in range(0, len(data) - length + 1, BLOCK):
        part = data[base : base + BLOCK + length - 1]
        h = mix(window_hash(prefix_hash(BYTES[part], powers), gram, powers))
        packed = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(packed) // reach)
        grid = np.full(rows * reach, np.iinfo(np.uint64).max, np.uint64)
        grid[: len(packed)] = packed
        grid = grid.reshape(rows, reach)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(packed) - reach + 1
        least = np.minimum(right[:n], left[reach - 1 : reach - 1 + n]) & _POSITION
        first = np.concatenate([[0], np.flatnonzero(np.diff(least.view(np.int64))) + 1])
        last = np.concatenate([first[1:] - 1, [n - 1]])
        at = least[first].astype(np.int64)
        out.append((at + base, first + base, last + base, h[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def anchors(length: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASES[0])
        for batch in gathered(batches):
            table, copied = _documents(batch)
            keys, docs, pos = [], [], []
            for i, text in enumerate(utf8(batch["text"])):
                if len(text) < length:
                    continue
                k = anchor_runs(np.frombuffer(text, np.uint8), length, powers)[3]
                keys.append(k)
                pos.append(np.arange(len(k)))
                docs.append(np.full(len(k), i))
            if keys:
                yield wire(np.concatenate(keys)[:, None], np.concatenate(docs), np.concatenate(pos), table, copied, np.zeros(len(copied), bool), buckets)

    return run


# ---------------------------------------------------------------- cells

#: One row per batch and bucket. core: uint64; extent: bytes, padded to the extent's width; lo, hi, size: the
#: starts in use and the bytes in use; multi: the batch alone shows two; spread: 1 for extents dealt by their
#: own hash, 2 for a mark that some extents of this core were. pos, counts, docs: place of start 0 of the extent.
CELLS = "bucket int, core binary, extent binary, lo binary, hi binary, multi binary, spread binary, pos binary, counts binary, docs binary, s_pos binary, s_counts binary, s_docs binary"


def _digest(rows: np.ndarray) -> np.ndarray:
    """128 bits for each row of bytes."""
    out = np.empty((len(rows), 2), np.uint64)
    for j, base in enumerate(BASES):
        up, _ = Powers(base).upto(rows.shape[1] + 1)
        for a in range(0, len(rows), 4096):
            part = BYTES[rows[a : a + 4096]]
            out[a : a + 4096, j] = mix((part * up[1:]).sum(axis=1, dtype=np.uint64))
    return out


def _first(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (n, k) keys: the group of each row, one row of each group, and the groups' sizes."""
    order = np.lexsort(keys.T)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    group = np.empty(len(k), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new], np.bincount(group)


def _same(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_first``, for rows of bytes with keys made of their digests: rows of one group have the same bytes."""
    group, first, size = _first(keys)
    for a in range(0, len(rows), 4096):
        if (rows[a : a + 4096] != rows[first[group[a : a + 4096]]]).any():  # digests collide, so the bytes tell groups apart
            _, number = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel(), return_inverse=True)
            return _first(np.column_stack([keys, number.ravel().astype(np.uint64)]))
    return group, first, size


def cells(length: int, buckets: int, spread_over: int = SPREAD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    cell = cell_size(length)
    width = length + cell - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BASES[0])
        for batch in gathered(batches):
            table, copied = _documents(batch)
            marks = batch["pos"].to_pylist()
            core, extent, lo, hi, at, doc = [], [], [], [], [], []
            for i, text in enumerate(utf8(batch["text"])):
                if len(text) < length:
                    continue
                data = np.frombuffer(text, np.uint8)
                a, s0, s1, _ = (x[np.unique(_marks(marks[i]))] for x in anchor_runs(data, length, powers))
                padded = np.concatenate([np.zeros(cell, np.uint8), data, np.zeros(cell, np.uint8)])
                prefix = prefix_hash(BYTES[data], powers)
                down = powers.upto(len(prefix))[1]
                for q in range((length - 1) // cell + 1):  # cell q: starts a - d with d in [cell q, cell (q + 1))
                    start = a - cell * (q + 1) + 1  # start 0 of the cell
                    b, e = np.maximum(s0, start), np.minimum(s1, a - cell * q)
                    use = np.flatnonzero(b <= e)
                    if not len(use):
                        continue
                    st = start[use]
                    c0, c1 = st + cell - 1, st + length  # the core is in every string of the cell
                    core.append(mix((prefix[c1] - prefix[c0]) * down[c0] + np.uint64(q)))
                    x = padded[(st + cell)[:, None] + np.arange(width)]
                    lo.append(b[use] - st)
                    hi.append(e[use] - st)
                    # bytes outside the strings in use say nothing about them; they are blanked
                    out = (np.arange(width) < lo[-1][:, None]) | (np.arange(width) >= hi[-1][:, None] + length)
                    x[out] = 0
                    extent.append(x)
                    at.append(st)
                    doc.append(np.full(len(use), i))
            if not core:
                continue
            core, extent, lo, hi, at, doc = map(np.concatenate, (core, extent, lo, hi, at, doc))
            digest = _digest(extent)
            group, first, size = _same(np.stack([digest[:, 0], digest[:, 1], core, (lo * 64 + hi).astype(np.uint64)], axis=1), extent)
            many = (size > 1) | (np.bincount(group, weights=copied[doc], minlength=len(size)) > 0)
            settled = np.flatnonzero(many[group] & ~copied[doc])
            yield from _cell_rows(core, extent, lo, hi, at, doc, table, digest, first, many, settled, buckets, spread_over)

    return run


def _cell_rows(core, extent, lo, hi, at, doc, table, digest, first, many, settled, buckets, spread_over) -> Iterator[pa.RecordBatch]:
    n = len(first)
    group, _, size = _first(core[first][:, None])
    apart = size[group] > spread_over
    home = (core[first] % np.uint64(buckets)).astype(np.int64)
    bucket = np.where(apart, (digest[first, 0] % np.uint64(buckets)).astype(np.int64), home)
    marked = np.unique(core[first][apart])
    entry = np.concatenate([np.arange(n), np.arange(len(marked))])
    is_mark = np.concatenate([np.zeros(n, bool), np.ones(len(marked), bool)])
    where = np.concatenate([bucket, (marked % np.uint64(buckets)).astype(np.int64)])
    s_where = np.zeros(0, np.int64)
    if len(settled):
        s_where = (core[settled] % np.uint64(buckets)).astype(np.int64)
    rows: dict[str, list] = {c.split()[0]: [] for c in CELLS.split(", ")}
    for b in range(buckets):
        own = np.flatnonzero(where == b)
        passed = settled[s_where == b]
        if not len(own) and not len(passed):
            continue
        real = entry[own[~is_mark[own]]]
        real = real[np.lexsort((at[first[real]], doc[first[real]]))]
        r = first[real]
        mark = marked[entry[own[is_mark[own]]]]
        rows["bucket"].append(b)
        rows["core"].append(np.concatenate([core[r], mark]).tobytes())
        rows["extent"].append(extent[r].tobytes())
        rows["lo"].append(lo[r].astype(np.uint8).tobytes())
        rows["hi"].append(hi[r].astype(np.uint8).tobytes())
        rows["multi"].append(many[real].astype(np.uint8).tobytes())
        rows["spread"].append(np.concatenate([apart[real], np.full(len(mark), 2)]).astype(np.uint8).tobytes())
        for names, index in ((("pos", "counts", "docs"), r), (("s_pos", "s_counts", "s_docs"), None)):
            if index is None:
                # settled places are pairs: first start, number of starts
                j = passed[np.lexsort((at[passed], doc[passed]))]
                blobs = _places(np.repeat(doc[j], 2), np.stack([at[j] + lo[j], hi[j] - lo[j] + 1], axis=1).ravel(), table)
            else:
                blobs = _places(doc[index], at[index], table)
            for name, blob in zip(names, blobs, strict=True):
                rows[name].append(blob)
    types = {"bucket": pa.int32()}
    yield pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.binary())) for c, v in rows.items()})


# ---------------------------------------------------------------- suffix sort


class SuffixSorter:
    """Sorts suffixes of fixed-width rows of bytes, comparing at most ``length`` bytes of each."""

    def __init__(self, rows: np.ndarray, length: int):
        self.rows, self.length = rows, length
        self.powers = Powers(BASES[0])
        up, self.down = self.powers.upto(rows.shape[1] + 1)
        self.prefix = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum(BYTES[rows] * up[1:], axis=1, out=self.prefix[:, 1:])

    def common(self, row_a, off_a, row_b, off_b) -> np.ndarray:
        """Lengths of common extensions, by binary search over prefix hashes."""
        lo = np.zeros(len(row_a), np.int64)
        hi = np.full(len(row_a), self.length)
        pa_, pb_ = self.prefix[row_a, off_a], self.prefix[row_b, off_b]
        da, db = self.down[off_a], self.down[off_b]
        for _ in range(int(self.length).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[row_a, off_a + mid] - pa_) * da == (self.prefix[row_b, off_b + mid] - pb_) * db
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, mid - 1)
        return lo

    def less(self, row_a, off_a, row_b, off_b, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b; ties says so for equal ones."""
        k = self.common(row_a, off_a, row_b, off_b)
        end = k >= self.length
        k = np.minimum(k, self.length - 1)
        return np.where(end, ties, self.rows[row_a, off_a + k] < self.rows[row_b, off_b + k])

    def sort(self, segment: np.ndarray, row: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The order of suffixes (row, off) within their segments (nondecreasing), by a bottom-up mergesort.

        In a merge step every suffix finds its rank in the sibling run by binary search, all at once.
        """
        n = len(row)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if n else np.zeros(0, np.int64)
        number = np.cumsum(np.concatenate([[True], segment[1:] != segment[:-1]])) - 1 if n else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [n]]))
        run = 1
        while len(size) and run < size.max():
            at = np.flatnonzero(size[number] > run)  # only segments that are not in order yet
            base, total = first[number[at]], size[number[at]]
            local = at - base
            block = local // run
            sibling = block ^ 1
            s0 = np.minimum(sibling * run, total)
            s1 = np.minimum(s0 + run, total)
            left = block % 2 == 0
            lo, hi = s0.copy(), s1.copy()
            mine = order[at]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                other = order[base[open_] + mid]
                a = mine[open_]
                before = self.less(row[other], off[other], row[a], off[a], ~left[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            pair = (block // 2) * 2 * run
            target = base + pair + (local - block * run) + (lo - s0)
            new = order.copy()
            new[target] = mine
            order = new
            run *= 2
        return order


def _repeated(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix in use: its row, its start, and the class of equal strings it belongs to.

    Strings of one core meet only at equal starts, so a segment of the sort is a core and a start.
    """
    count = hi - lo + 1
    row = np.repeat(np.arange(len(rows)), count)
    off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[row]
    key = group[row] * (CELL + 1) + off
    by = np.argsort(key, kind="stable")
    row, off, key = row[by], off[by], key[by]
    sorter = SuffixSorter(rows, length)
    order = sorter.sort(key, row, off)
    row, off = row[order], off[order]
    same = np.zeros(len(row), bool)
    if len(row) > 1:
        near = np.flatnonzero(key[1:] == key[:-1]) + 1
        full = near[sorter.common(row[near - 1], off[near - 1], row[near], off[near]) >= length]
        for a in range(0, len(full), 8192):  # hashes may collide, bytes decide
            f = full[a : a + 8192]
            span = np.arange(length)
            same[f] = (rows[row[f - 1][:, None], off[f - 1][:, None] + span] == rows[row[f][:, None], off[f][:, None] + span]).all(axis=1)
    return row, off, np.cumsum(~same) - 1


#: Places are pairs (first start, number of starts), for the home buckets of their documents. keys: witnesses,
#: six words each: digest, document, start, whether it is known to be repeated; for the bucket of the digest.
#: strings: their bytes.
WITNESS = "bucket int, pos binary, counts binary, docs binary, keys binary, strings binary"


def _pairs(run: np.ndarray, start: np.ndarray, count: np.ndarray, docs: np.ndarray, homes: int) -> pa.Table:
    by = np.lexsort((start, run))
    return homes_table(np.stack([start[by], count[by]], axis=1).ravel(), np.repeat(run[by], 2), docs, homes)


def _witness_rows(places: list[pa.Table], keys: np.ndarray | None, strings: np.ndarray | None, buckets: int) -> pa.Table:
    t = pa.concat_tables(places)
    t = t.rename_columns(["bucket", "pos", "counts", "docs"]).append_column("keys", pa.nulls(len(t), pa.binary())).append_column("strings", pa.nulls(len(t), pa.binary()))
    if keys is None or strings is None or not len(keys):
        return t
    to = (keys[:, 1] % np.uint64(buckets)).astype(np.int64)
    number = np.unique(to)
    nothing = pa.nulls(len(number), pa.binary())
    return pa.concat_tables([t, pa.table({"bucket": pa.array(number, pa.int32()), "pos": nothing, "counts": nothing, "docs": nothing, "keys": pa.array([keys[to == b].tobytes() for b in number.tolist()], pa.binary()), "strings": pa.array([strings[to == b].tobytes() for b in number.tolist()], pa.binary())})])


def settle_cells(length: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Reduce side of the cells: places of repeated strings, and witnesses for the strings of spread cores."""
    width = length + cell_size(length) - 1

    def run(table: pa.Table) -> pa.Table:
        blobs = {c: table[c].to_pylist() for c in ("core", "spread", "extent", "lo", "hi", "multi")}
        core = np.frombuffer(b"".join(blobs["core"]), np.uint64)
        spread = np.frombuffer(b"".join(blobs["spread"]), np.uint8)
        real = spread < 2
        marked = np.unique(core[spread > 0])
        core = core[real]
        rows = np.frombuffer(b"".join(blobs["extent"]), np.uint8).reshape(-1, width)
        lo, hi, multi = (np.frombuffer(b"".join(blobs[c]), np.uint8).astype(np.int64) for c in ("lo", "hi", "multi"))
        start, at, docs = _gather(table, "pos", "counts", "docs")
        start = start.astype(np.int64)
        out = [homes_table(*_gather(table, "s_pos", "s_counts", "s_docs"), buckets)]
        keys = strings = None
        if len(core):
            digest = _digest(rows)
            group, first, size = _same(np.stack([digest[:, 0], digest[:, 1], core, (lo * 64 + hi).astype(np.uint64)], axis=1), rows)
            twice = (size > 1) | (np.bincount(group, weights=multi, minlength=len(size)) > 0)
            of_core, _, classes = _first(core[first][:, None])
            far = np.isin(core[first], marked)
            sort = np.flatnonzero((classes[of_core] > 1) | far)
            mine = np.flatnonzero(twice[group] & (multi == 0))
            out.append(_pairs(at[mine], start[mine] + lo[mine], hi[mine] - lo[mine] + 1, docs, buckets))
            if len(sort):
                f = first[sort]
                row, off, cls = _repeated(rows[f], lo[f], hi[f], of_core[sort], length)
                found = np.bincount(cls) > 1
                new = np.flatnonzero(found[cls] & ~twice[sort[row]])  # extents seen twice are reported above
                m = f[row[new]]
                out.append(_pairs(at[m], start[m] + off[new], np.ones(len(m), np.int64), docs, buckets))
                lead = np.flatnonzero(np.diff(cls, prepend=-1))
                lead = lead[far[sort[row[lead]]]]
                if len(lead):
                    known = np.bincount(cls, weights=twice[sort[row]])[cls[lead]] > 0
                    known |= found[cls[lead]]
                    span = np.arange(length)
                    strings = np.concatenate([rows[f[row[x]][:, None], off[x][:, None] + span] for x in np.array_split(lead, len(lead) // 8192 + 1)])
                    d = _digest(strings)
                    m = f[row[lead]]
                    keys = np.column_stack([d, docs[at[m]].view(np.uint64), (start[m] + off[lead]).astype(np.uint64), known.astype(np.uint64)])
        return _witness_rows(out, keys, strings, buckets)

    return run


def settle_witnesses(length: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Last exchange: witnesses whose string another bucket has as well; places pass through."""

    def run(table: pa.Table) -> pa.Table:
        placed = table.filter(pa.compute.is_null(table["keys"]))
        out = [placed.select(["bucket", "pos", "counts", "docs"]).rename_columns(["home", "pos", "counts", "docs"])]
        blobs = [b for b in table["keys"].to_pylist() if b is not None]
        if blobs:
            k = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 6)
            strings = np.frombuffer(b"".join(b for b in table["strings"].to_pylist() if b is not None), np.uint8).reshape(-1, length)
            group, _, size = _same(k[:, :2], strings)
            known = k[:, 5] > 0
            more = (size > 1) | (np.bincount(group, weights=known, minlength=len(size)) > 0)
            hit = k[more[group] & ~known]
            docs, doc = np.unique(hit[:, 2:4].view(np.int64), axis=0, return_inverse=True)
            out.append(_pairs(doc.ravel(), hit[:, 4].astype(np.int64), np.ones(len(hit), np.int64), docs, buckets))
        return pa.concat_tables(out)

    return run


# ---------------------------------------------------------------- removal

RESULT = "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept {}, spans array<struct<start:long,end:long>>"


def removal(length: int, decode: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            table, copied = _documents(batch)
            marks = batch["pos"].to_pylist()
            total, gone, kept, spans = [], [], [], []
            for i, data in enumerate(utf8(batch["text"])):
                n = len(data)
                total.append(n)
                cut: list[tuple[int, int]] = []
                if copied[i] and n >= length:
                    cut = [(0, n)]
                elif marks[i]:
                    at, count = _marks(marks[i]).reshape(-1, 2).astype(np.int64).T
                    edge = np.flatnonzero(np.diff(covered(at, at + count + length - 1, n).astype(np.int8), prepend=0, append=0))
                    cut = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                edges = [0, *(x for c in cut for x in c), n]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cut else data)
                gone.append(n - len(kept[-1]))
                spans.append([{"start": a, "end": b} for a, b in cut])
            yield pa.RecordBatch.from_pydict({"h1": table[:, 0], "h2": table[:, 1], "n_bytes": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(list(map(len, spans)), pa.int64()), "kept": pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if decode else pa.array(kept, pa.binary()), "spans": pa.array(spans, kind)})

    return run


def dedup_bytes(docs: DataFrame, length: int = 200, text: str = "text", per_text: Callable[[DataFrame], DataFrame] = lambda d: d, spread_over: int = SPREAD, decode: bool = False) -> DataFrame:
    """``docs``' other columns with n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans (removed, in bytes).

    ``per_text`` is applied to the results of the distinct texts before they are spread over the copies. With ``decode``,
    kept is a string, without the bytes of characters that were cut in part.
    """
    texts, buckets = distinct_texts(docs, text), key_buckets(docs, text)
    shared = exchange(texts.mapInArrow(anchors(length, buckets), WIRE), 1, buckets)
    met = texts.join(shared, ["h1", "h2"]).mapInArrow(cells(length, buckets, spread_over), CELLS)
    first = met.groupBy("bucket").applyInArrow(settle_cells(length, buckets), WITNESS)
    starts = by_document(first.groupBy("bucket").applyInArrow(settle_witnesses(length, buckets), HOMES))
    result = per_text(texts.join(starts, ["h1", "h2"], "left").mapInArrow(removal(length, decode), RESULT.format("string" if decode else "binary")))
    return with_results(docs, text, result)


def clean(docs: DataFrame, length: int = 200, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; a character that a cut splits goes as a whole.

    No row goes: a text of nothing but repeated bytes becomes empty, null stays null. ``chars`` is counted anew.
    """

    rest = [c for c in docs.columns if c != text]
    named = docs.select(F.col(text).alias("t"), F.col(text).isNull().alias("null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    d = dedup_bytes(named, length, "t", lambda x: x.select("h1", "h2", F.col("kept").alias("_kept")), decode=True)
    new = {c: F.col(f"c{i}") for i, c in enumerate(rest)}
    if chars in rest:
        new[chars] = F.when(F.col("null"), F.lit(None)).otherwise(F.length("_kept")).cast(docs.schema[chars].dataType)
    new[text] = F.when(~F.col("null"), F.col("_kept"))
    return d.select(*[new[c].alias(c) for c in docs.columns])
