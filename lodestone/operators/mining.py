"""Consolidation: patterns, playbooks, duplicate titles, conflicts, event frames, procedures, revisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import TRUSTED_CLASSES, pattern_confidence
from ..functions.fulltext import stemmed
from ..functions.text import matches_all, tokens


def patterns(facts: DataFrame, keys: Sequence[str], episode: str, value: str, fact_id: str, scope: str | None = None, least: int = 2, ids: bool = True) -> DataFrame:
    """Groups of facts seen in at least ``least`` episodes: support, usual value (lowest on ties), confidence, fingerprint, and with ``ids`` the lists of facts and episodes.

    Values are counted by (keys, value) and episodes by (keys, episode), both combined in the map task; what meets in
    a group is one row of each kind, not its facts.
    """
    said = facts.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    usual = said.groupBy(*keys).agg(F.min_by("_v", F.struct(-F.col("_n"), "_v")).alias("usual_value"))
    seen = facts.where(F.col(episode).isNotNull()).select(*keys, episode).distinct().groupBy(*keys).agg(F.count("*").alias("support"))
    parts = seen.unionByName(usual, allowMissingColumns=True)
    lists = ["fact_ids", "episode_ids"] if ids else []
    if ids or scope:
        aggs = [F.array_sort(F.collect_set(fact_id)).alias("fact_ids"), F.array_sort(F.collect_set(episode)).alias("episode_ids")] if ids else []
        parts = parts.unionByName(facts.groupBy(*keys).agg(*aggs, *([F.min(scope).alias("scope_path")] if scope else [])), allowMissingColumns=True)
    columns = ["support", "usual_value", *lists, *(["scope_path"] if scope else [])]
    # One row of each kind has the value, the others null.
    out = parts.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns]).where(F.col("support") >= least)
    return out.withColumns({"confidence": pattern_confidence(F.col("support")), "state": F.when(F.col("support") >= 2, "published").otherwise("draft"), "fingerprint": F.sha2(F.concat(F.lit("pattern:"), F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys])), 256)})


def trusted(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("assertion_class").isin(*TRUSTED_CLASSES) & (F.col("current_status") == "active"))


def playbooks(facts: DataFrame, subject: str, text: str, episode: str, outcome: str, fact_id: str, score: str) -> DataFrame:
    """Remediations with a resolved, closed or unknown outcome, grouped by subject and normalized text."""
    norm = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))
    ok = F.col(outcome).isNull() | F.col(outcome).isin("resolved", "closed")
    g = facts.where(ok).withColumn("step", norm).groupBy(subject, "step")
    out = g.agg(F.count("*").alias("uses"), F.array_sort(F.collect_set(fact_id)).alias("fact_ids"), F.array_sort(F.collect_set(episode)).alias("episode_ids"), F.max(score).alias("best"))
    return out.withColumns({"confidence": F.least(F.col("best"), F.lit(0.95)), "fingerprint": F.sha2(F.concat_ws("|", F.lit("playbook"), F.col(subject), F.substring("step", 1, 200)), 256)})


def duplicate_titles(memories: DataFrame, title: str, scope: Sequence[str], order: Sequence[Column], key: str) -> DataFrame:
    """Memories that share a lower-cased title in a scope: their place, the one to keep and how many there are."""
    w = Window.partitionBy(F.lower(F.col(title)), *scope)
    ordered = w.orderBy(*order)
    return memories.withColumns({"place": F.row_number().over(ordered), "keeper": F.first(key).over(ordered), "copies": F.count("*").over(w)}).where("copies > 1")


def conflict_counts(memories: DataFrame, key: str, block: Sequence[str], title: str, narrative: str) -> DataFrame:
    """(key, class_id, n_conflicts): memories with one block, title (in any case) and narrative are a class, named by its
    least key; a memory conflicts with those of its block and title in other classes. Nulls count as empty.

    Classes are counted first, so a title that a third of all rows share is a few counts and not its pairs.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    m = memories.select(F.col(key), *[empty(c).alias(f"_b{i}") for i, c in enumerate(block)], F.lower(empty(title)).alias("_t"), F.sha2(empty(narrative), 256).alias("_h"))
    group = [*[f"_b{i}" for i in range(len(block))], "_t"]
    classes = m.groupBy(*group, "_h").agg(F.min(key).alias("class_id"), F.count("*").alias("_n"))
    total = classes.groupBy(*group).agg(F.sum("_n").alias("_total"))
    links = classes.join(total, group).select(*group, "_h", "class_id", (F.col("_total") - F.col("_n")).alias("n_conflicts"))
    return m.join(links, [*group, "_h"]).select(key, "class_id", "n_conflicts")


def conflicts(memories: DataFrame, cues: DataFrame, key: str = "memory_id", block: Sequence[str] = ("tenant", "scope_path"), title: str = "title", narrative: str = "narrative", full_text: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, in one block with different narratives that share a title or a cue; with the number of shared cues.

    With ``full_text`` also the pairs where one's text has all lexemes of the other's title. Null blocks, titles
    and narratives count as empty. Candidates come from equi joins on (block, title), (block, cue) and (block,
    the title's rarest lexeme) and are then verified; there is no join of a block with itself.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    m = memories.select(key, *map(empty, block), empty(title), empty(narrative))

    def pairs(rows: DataFrame, on: str) -> DataFrame:
        a = rows.select(*block, F.col(on).alias("_k"), F.col(key).alias("a"))
        b = rows.select(*block, F.col(on).alias("_k"), F.col(key).alias("b"))
        return a.join(b, [*block, "_k"]).where("a < b")

    by_title = pairs(m.withColumn("_t", F.lower(title)), "_t").select("a", "b", F.lit(1).alias("same_title"), F.lit(0).alias("cue"))
    by_cue = pairs(m.join(cues.select(key, "cue_hash").distinct(), key), "cue_hash").select("a", "b", F.lit(0).alias("same_title"), F.lit(1).alias("cue"))
    met = by_title.union(by_cue)
    if full_text:
        met = met.union(_title_in_text(m, key, block, title, narrative).select("a", "b", F.lit(0), F.lit(0)))
    met = met.groupBy("a", "b").agg(F.max("same_title").alias("same_title"), F.sum("cue").alias("shared_cues"))
    # SHA-256 stands for the narrative, so that texts are not moved.
    text = m.select(F.col(key), F.sha2(narrative, 256))
    out = met.join(text.toDF("a", "na"), "a").join(text.toDF("b", "nb"), "b")
    return out.where(F.col("na") != F.col("nb")).drop("na", "nb")


def conflict_edges(memories: DataFrame, cues: DataFrame, known: DataFrame, tenant: str, key: str = "memory_id", block: Sequence[str] = ("tenant", "scope_path"), title: str = "title", narrative: str = "narrative") -> tuple[DataFrame, DataFrame]:
    """(new edges, bumps): contradiction edges for memories of one block that share a title or a cue but not their narrative.

    A class (block and title, or block and cue) is no set of pairs: its representative is its smallest key, and each member with
    another narrative gets one edge to it; members with the representative's narrative get one to the smallest key with another.
    So every member that contradicts some other has an edge, and edges grow with the rows. ``bumps`` (key, n) has each
    memory at an end of an edge that was not ``known`` by its fingerprint, once.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    m = memories.select(F.col(key), *[empty(c).alias(f"_b{i}") for i, c in enumerate(block)], F.col("scope_path"), F.lower(empty(title)).alias("_t"), F.sha2(empty(narrative), 256).alias("_h"))
    by_title = m.select(key, *[f"_b{i}" for i in range(len(block))], "scope_path", F.concat(F.lit("t:"), "_t").alias("_k"), "_h")
    by_cue = m.join(cues.select(key, "cue_hash").distinct(), key).select(key, *[f"_b{i}" for i in range(len(block))], "scope_path", F.concat(F.lit("c:"), "cue_hash").alias("_k"), "_h")
    rows = by_title.unionByName(by_cue)
    group = [*[f"_b{i}" for i in range(len(block))], "_k"]
    heads = rows.groupBy(*group, "_h").agg(F.min(key).alias("_head"))  # a row for each narrative of a class
    best = F.array_sort(F.collect_list(F.struct("_head", "_h")))
    two = heads.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_head"))).where("_n <= 2").groupBy(*group).agg(best.alias("_two")).where(F.size("_two") > 1)
    d = rows.join(two, group)
    first, second = F.get("_two", F.lit(0)), F.get("_two", F.lit(1))
    other = F.when(F.col("_h") != first["_h"], first["_head"]).otherwise(second["_head"])
    ends = d.select(F.least(key, other).alias("source_id"), F.greatest(key, other).alias("target_id"), "scope_path").dropDuplicates(["source_id", "target_id"])
    print_ = F.sha2(F.concat_ws("|", F.lit(tenant), F.lit("memory"), F.col("source_id").cast("string"), F.lit("contradicts"), F.lit("memory"), F.col("target_id").cast("string")), 256)
    kind = F.lit("memory")
    edges = ends.select(F.lit(tenant).alias("tenant"), kind.alias("source_type"), "source_id", kind.alias("target_type"), "target_id", F.lit("contradicts").alias("edge_type"), print_.alias("edge_fingerprint"), F.lit(0.6).alias("confidence"), F.lit("deterministic").alias("assertion_class"), "scope_path")
    new = edges.join(known.select("tenant", "edge_fingerprint"), ["tenant", "edge_fingerprint"], "left_anti").select(*edges.columns)
    bumps = new.select(F.explode(F.array("source_id", "target_id")).alias(key)).distinct().withColumn("n", F.lit(1))
    return new, bumps


def _title_in_text(m: DataFrame, key: str, block: Sequence[str], title: str, narrative: str) -> DataFrame:
    """Pairs (a, b), a < b, in one block where the text of one has all lexemes of the title of the other."""
    texts = m.select(*block, F.col(key).alias("t"), stemmed(F.concat_ws(" ", title, narrative)).alias("x"))
    terms = texts.select(*block, "t", F.explode("x").alias("term"))
    titles = m.select(*block, F.col(key).alias("q"), stemmed(title).alias("y")).where(F.size("y") > 0)
    often = terms.groupBy(*block, "term").agg(F.count("*").alias("n"))
    probes = titles.select(*block, "q", F.explode("y").alias("term")).join(often, [*block, "term"])
    rarest = probes.groupBy(*block, "q").agg(F.min_by("term", F.struct("n", "term")).alias("term"))
    found = rarest.join(terms, [*block, "term"]).where("q <> t").select("q", "t")
    full = found.join(titles.select("q", "y"), "q").join(texts.select("t", "x"), "t").where(matches_all(F.col("x"), F.col("y")))
    return full.select(F.least("q", "t").alias("a"), F.greatest("q", "t").alias("b")).distinct()


#: Words in the predicate that tell an edge's type, then words in the object that do; tried in this order. Fixed values.
EDGE_RULES = (
    ("caused_by", ("caus",), ()),
    ("precedes", ("preced", "before"), ()),
    ("follows", ("follow", "after"), ()),
    ("fixes", ("fix", "remediat"), ("fix", "remediat")),
    ("mitigates", ("mitigat",), ("mitigat",)),
    ("supersedes", ("supersed",), ("supersed",)),
    ("duplicates", ("duplicat",), ("duplicat",)),
    ("depends_on", ("depend", "require"), ("depend", "require")),
)
#: Edge types that a fact's kind tells as well; kinds of facts that make edges. Fixed values.
KIND_EDGES = {"caused_by": "cause", "fixes": "remediation"}
LINK_KINDS = ("cause", "impact", "decision", "remediation", "constraint", "config_change")


def edge_type(support_type: Column, fact_kind: Column, predicate: Column, value: Column) -> Column:
    """The type of the edge from a fact to a memory; ``supports`` where nothing tells more."""
    said, of = F.lower(F.coalesce(predicate, F.lit(""))), F.lower(F.coalesce(value.cast("string"), F.lit("")))
    out = F.lit("supports")
    for name, in_predicate, in_object in reversed(EDGE_RULES):
        tells = said.rlike("|".join(in_predicate))
        if in_object:
            tells = tells | of.rlike("|".join(in_object))
        if name in KIND_EDGES:
            tells = tells | (F.coalesce(fact_kind, F.lit("")) == KIND_EDGES[name])
        out = F.when(tells, name).otherwise(out)
    return F.when(F.coalesce(support_type, F.lit("")) == "counter", "contradicts").otherwise(out)


def steps(text: Column) -> Column:
    """Steps of a procedure text: bullet or numbered lines without their marks, at least four characters; else the whole text."""
    lines = F.transform(F.split(text, r"\n|;"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"(?i)^([-*•]|\d+[.)]|step\s+\d+[:.)]?)\s*", "")))
    good = F.filter(lines, lambda x: F.length(x) >= 4)
    return F.when(F.size(good) > 0, good).otherwise(F.array(F.trim(text)))


def contradictions(facts: DataFrame, keys: Sequence[str], value: str, score: str, sure: float = 0.8) -> DataFrame:
    """Keys with more than one value, more than one of them asserted with confidence ``sure`` or more."""
    out = facts.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.count_if(F.col(score) >= sure).alias("n_sure"))
    return out.where("n_values > 1 and n_sure > 1")


def revision_kinds(memories: DataFrame, now: Column) -> DataFrame:
    """Memories with the revision they call for: created, enriched, demoted or retired (merges come from duplicate_titles)."""
    kind = (
        F.when(F.col("contradictions") > F.col("support"), "retired")
        .when(F.col("updated_at") < F.add_months(now, -6).cast("timestamp_ntz"), "demoted")
        .when(F.col("support") >= 5, "enriched")
        .when(F.col("support") == 1, "created")
    )
    return memories.withColumn("revision", kind).where("revision is not null")


def narrative_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda x: F.length(x) >= 4)))
