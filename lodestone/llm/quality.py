"""Quality rules, with DataFrame functions only.

Base rules look at one text (words, symbols, repeated lines, repeated three-word windows). The corpus rule
hashes normalised lines (lower case, digit runs as 0, white space collapsed), counts for each host the
distinct documents a line occurs in, removes lines above the limits and rejects documents that this depletes.
Documents are told apart by a hash of the whole text, so exact copies count once.

With ``by_rest``, as in the pipeline, near copies count once too, so that a group of them does not turn its own
lines into boilerplate. Documents that hold a line above the limits are looked at once more: of what they hold
besides such lines, ``SKETCHES`` minima over hashes of the three-word windows are taken, and the one that
most documents of the host share stands for the document. Different stand-ins are counted.

A line is above the limits if it is in more than ``min_docs`` documents of a host and in more than ``share`` of
its documents (0 by default, so the limit does not grow with a host). The table of such lines is broadcast
if a count shows at most ``broadcast_rows`` rows, ``BROADCAST_BYTES`` bytes and ``HOST_LINES`` lines of one host (each line of a
document is compared with those); beyond, documents and lines meet in a shuffled join, salted by the documents of the most frequent line.

Defined cases: null or empty text has no words and fails the base rules; a null host is a host of its own, the
same as an empty one; repeated rows get equal results; an empty table gives an empty result; other columns pass,
whatever their names (``clean``), pass unless a result has their name (``judge``), or are ignored (``assess``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACES = r"[ \t-\r]+"
NO_SPACE = r"[^ \t-\r]"
SYMBOLS = r"[^#*$%&|<>]+"
#: The hash of a line l after normalising.
LINE_HASH = r"xxhash64(trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0'), '[ \\t-\\r]+', ' ')))"
SALT_ROWS, SKETCHES = 1_000_000, 4
BROADCAST_BYTES, HOST_LINES = 16 << 20, 2000


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(text, SPACES), "")


def repeated_window_words(w: str, n: str, b: str) -> tuple[str, str]:
    """SQL for the sorted three-word windows of array ``w`` (``n`` words, ``b`` bits hold a position), and for the
    number of words in windows found twice or more, given that array as column ``tri``.

    A window is 64 - b bits of its hash with its position below; neighbours in the sorted array with equal
    hashes are compared word by word. Should two different windows collide, the text is done again on the words.
    """
    tri = f"if({n} < 3, array(), sort_array(transform(sequence(0, greatest({n} - 3, 0)), i -> shiftleft(shiftright(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), {b}), {b}) | cast(i as bigint))))"
    at = f"cast(tri[k] & (shiftleft(1L, {b}) - 1) as int)"
    before = at.replace("tri[k]", "tri[k - 1]")
    near = f"filter(sequence(1, greatest(size(tri) - 1, 1)), k -> k < size(tri) and shiftright(tri[k], {b}) = shiftright(tri[k - 1], {b}))"
    pairs = f"transform({near}, k -> named_struct('p', {before}, 'q', {at}))"
    same = " and ".join(f"{w}[x.p + {d}] = {w}[x.q + {d}]" for d in range(3))
    covered = "size(array_distinct(flatten(transform({pairs}, x -> array(x.p, x.p + 1, x.p + 2, x.q, x.q + 1, x.q + 2)))))"
    exact = f"sort_array(transform(sequence(0, {n} - 3), i -> struct({w}[i] as a, {w}[i + 1] as b, {w}[i + 2] as c, i as i)))"
    exact_pairs = f"flatten(transform(array({exact}), s -> transform(filter(sequence(1, size(s) - 1), k -> s[k].a = s[k - 1].a and s[k].b = s[k - 1].b and s[k].c = s[k - 1].c), k -> named_struct('p', s[k - 1].i, 'q', s[k].i))))"
    count = f"case when size(pairs) = 0 then 0 when exists(pairs, x -> not ({same})) then {covered.format(pairs=exact_pairs)} else {covered.format(pairs='pairs')} end"
    return tri, pairs + "\x00" + count


def base_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of the column _text."""
    t = F.coalesce(F.col("_text"), F.lit(""))
    d = docs.withColumn("_w", words(t)).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(NO_SPACE)))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    tri, rest = repeated_window_words("_w", "size(_w)", "_b")
    pairs, count = rest.split("\x00")
    d = d.withColumn("_b", F.length(F.bin(F.col("n_words"))))
    d = d.withColumn("tri", F.expr(tri)).withColumn("pairs", F.expr(pairs))
    d = d.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr(count).cast("long"),
        }
    ).drop("_w", "_lines", "_b", "tri", "pairs")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


#: SQL for the distinct hashes of a text's lines.
LINES = f"array_distinct(transform(filter(split(coalesce(_text, ''), '\\n'), l -> l rlike '[^ \\\\t-\\\\r]'), l -> {LINE_HASH}))"


def frequent_lines(docs: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(_host, line, n): hashes of the lines above the limits in docs (_text, _host), n being their documents."""
    rows = docs.select("_host", F.xxhash64("_text").alias("mark"), F.explode(F.expr(LINES)).alias("line"))
    counts = rows.groupBy("_host", "line", "mark").agg(F.lit(1).alias("one")).groupBy("_host", "line").agg(F.count("*").alias("n"))
    return _above(counts, docs, min_docs, share)


def _above(counts: DataFrame, docs: DataFrame, min_docs: int, share: float) -> DataFrame:
    counts = counts.where(F.col("n") > min_docs)
    if not share:
        return counts
    hosts = docs.groupBy("_host").agg(F.count("*").alias("docs"))
    return counts.join(hosts, "_host").where(F.col("n") > share * F.col("docs")).select("_host", "line", "n")


def frequent_by_rest(docs: DataFrame, min_docs: int, share: float, broadcast_rows: int) -> DataFrame:
    """(_host, line, n) as ``frequent_lines``, with near copies counted once."""
    # A line that too few different documents hold when compared as a whole is not looked at.
    maybe = materialize(frequent_lines(docs, min_docs, share))
    d = _attach(docs.select("_text", "_host"), maybe, broadcast_rows).where("_freq is not null")
    d = d.select("_host", F.xxhash64("_text").alias("doc"), F.expr(LINES).alias("hashes"), "_freq", F.expr(f"filter(split(coalesce(_text, ''), '\\n'), l -> not array_contains(_freq, {LINE_HASH}))").alias("rest"))
    d = d.select("_host", "doc", "hashes", F.array_intersect("hashes", "_freq").alias("found"), words(F.regexp_replace(F.lower(F.array_join("rest", "\n")), "[0-9]+", "0")).alias("w")).where(F.size("found") > 0)
    windows = "case when size(w) = 0 then array(xxhash64(array_sort(hashes))) when size(w) < 3 then array(xxhash64(w)) else transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) end"
    # The ever-true test keeps the windows in a column of their own, evaluated once and not once for each sketch.
    d = d.select("_host", "doc", "found", F.expr(windows).alias("g"), F.monotonically_increasing_id().alias("_n")).where("_n >= 0")
    sketches = F.array(*[F.expr(f"array_min(transform(g, x -> xxhash64(x, {k})))") for k in range(SKETCHES)])
    seen = materialize(d.select("_host", "doc", "found", sketches.alias("s")).dropDuplicates(["_host", "doc"]))
    marks = seen.select("_host", "doc", F.posexplode("s").alias("k", "mark"))
    shared = marks.groupBy("_host", "k", "mark").agg(F.count("*").alias("c"))
    stand_in = marks.join(shared, ["_host", "k", "mark"]).groupBy("_host", "doc").agg(F.max(F.struct("c", "k", "mark")).alias("m"))
    met = seen.select("_host", "doc", F.explode("found").alias("line")).join(stand_in, ["_host", "doc"])
    each = met.groupBy("_host", "line", "m").agg(F.lit(1).alias("one")).groupBy("_host", "line").agg(F.count("*").alias("n"))
    return _above(each, docs, min_docs, share)


def _attach(docs: DataFrame, frequent: DataFrame, broadcast_rows: int) -> DataFrame:
    """``docs`` (_text, _host, ...) with _freq, the hashes in ``frequent`` (_host, line, n) that may be lines of the row's text; null for none."""
    hosts = frequent.groupBy("_host").agg(F.count("*").alias("lines"), F.max("n").alias("n"))
    size = hosts.agg(F.sum("lines"), F.max("lines"), F.sum(F.octet_length("_host") + 8 * F.col("lines")), F.max("n")).first()
    lines, most, bytes_, n = (x or 0 for x in size)
    if lines <= broadcast_rows and most <= HOST_LINES and bytes_ <= BROADCAST_BYTES:
        table = frequent.groupBy("_host").agg(F.collect_list("line").alias("_freq"))
        return docs.join(F.broadcast(table), "_host", "left")
    # Rows with one text and host get one answer.
    keyed = docs.withColumns({"_key": F.xxhash64("_text"), "_key2": F.xxhash64(F.lit(1), "_text")})
    salts = 1 + n // SALT_ROWS
    found = keyed.select("_host", "_key", "_key2", F.explode(F.expr(LINES)).alias("line")).withColumn("_salt", F.pmod("_key2", F.lit(salts)))
    salted = frequent.select("_host", "line", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("_salt"))
    found = found.join(salted, ["_host", "line", "_salt"]).groupBy("_key", "_key2", "_host").agg(F.collect_set("line").alias("_freq"))
    return keyed.join(found, ["_key", "_key2", "_host"], "left").drop("_key", "_key2")


def _judged(docs: DataFrame, text: str, host: str, min_docs: int, share: float, min_left: int, broadcast_rows: int, by_rest: bool) -> DataFrame:
    """The rows of ``docs`` as the struct _row, with what ``judge`` adds."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"))
    narrow = d.select("_text", "_host")
    frequent = materialize(frequent_by_rest(narrow, min_docs, share, broadcast_rows) if by_rest else frequent_lines(narrow, min_docs, share))
    d = base_stats(_attach(d, frequent, broadcast_rows))
    hit = f"array_contains(_freq, {LINE_HASH})"
    d = d.withColumn("_gone", F.expr(f"if(_freq is null, array(), filter(split(coalesce(_text, ''), '\\n'), l -> l rlike '[^ \\\\t-\\\\r]' and {hit}))"))
    d = d.withColumn("n_line_words", F.expr("aggregate(_gone, 0L, (a, l) -> a + size(array_remove(split(l, '[ \\\\t-\\\\r]+'), '')))"))
    d = d.withColumn("cleaned", F.expr(f"if(size(_gone) = 0, _text, array_join(filter(split(_text, '\\n'), l -> not (l rlike '[^ \\\\t-\\\\r]' and {hit})), '\\n'))"))
    depleted = 100 * (F.col("n_words") - F.col("n_line_words")) < min_left * F.col("n_words")
    d = d.withColumn("kept", ~F.col("base_failed") & ~depleted)
    # The ever-true test on a generated number keeps filters above the projection: pushed below it, Spark would
    # write the nested expressions out inside their own lambdas and evaluate them for every window of a text.
    return d.withColumn("_n", F.monotonically_increasing_id()).where("_n >= 0")


def judge(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = 20, share: float = 0.0, min_left: int = 30, broadcast_rows: int = 200_000, by_rest: bool = False) -> DataFrame:
    """``docs`` with the base statistics, n_line_words (words in removed lines), cleaned (the text without them) and kept.

    A document is depleted if less than ``min_left`` per cent of its words are left.
    """
    d = _judged(docs, text, host, min_docs, share, min_left, broadcast_rows, by_rest)
    return d.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **limits: float) -> DataFrame:
    """One row per document: its id, the statistics and the verdict."""
    return judge(docs.select(key, text, host), text, host, **limits).drop(text, host, "cleaned")  # type: ignore[arg-type]


def clean(docs: DataFrame, text: str = "text", host: str = "source", chars: str = "n_chars", min_docs: int = 20, share: float = 0.0, min_left: int = 30, broadcast_rows: int = 200_000, by_rest: bool = False) -> DataFrame:
    """The documents that are kept, with frequent lines removed and ``chars`` (if there is such a column) counted anew."""
    d = _judged(docs, text, host, min_docs, share, min_left, broadcast_rows, by_rest).where("kept")
    new = {text: F.col("cleaned").alias(text)}
    if chars in docs.columns:
        new[chars] = F.length("cleaned").cast(docs.schema[chars].dataType).alias(chars)
    return d.select(*[new.get(c, F.col(f"_row.`{c}`")) for c in docs.columns])


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "cleaned", "kept")
