"""The engine's read and consolidation operations over a catalog, one method each, all lazy DataFrames.

Hybrid search is one plan: candidate streams are sub-plans, fusion is a union and an aggregate, governance and
lifecycle filters are anti joins on small sets of tainted ids. Nothing is collected before the final limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import fulltext
from ..functions import predicates as P
from ..functions import scores as S
from ..functions import text as X
from ..operators import folds, graph, merge, mining, ranking, revisions, snapshot, temporal, vectors

#: Columns of a candidate; streams pad what they lack with nulls.
CANDIDATE = "object_id string, object_type string, title string, summary string, confidence double, valid_from timestamp, valid_to timestamp, scope_path string, priority int"
#: The role of a vector, the kind of object it leads to and the column that holds the object's id.
ROLES = {
    "evidence": ("fact", "fact_id"), "text": ("segment", "segment_id"), "procedure": ("procedure", "procedure_id"), "media_caption": ("media_artifact", "media_id"),
    "visual_ocr": ("visual_region", "region_id"), "visual_caption": ("visual_region", "region_id"),
}
ROLE_KINDS = ("fact", "segment", "procedure", "media_artifact", "visual_region")
STOP_ENTITIES = frozenset("what when where which that this with from have does about were been into your their there will would could should happened caused fixed".split())


@dataclass(frozen=True)
class Plan:
    """What a question asks for, read from its words."""

    entities: tuple[str, ...]
    scopes: tuple[str, ...]
    predicates: tuple[str, ...]
    times: tuple[str, ...]
    answer: str


def plan(question: str) -> Plan:
    import re

    low = question.lower()
    words = re.findall(r"[a-z0-9][a-z0-9_.:-]*", low)
    quoted = [q.strip() for q in re.findall(r"[\"']([^\"']+)[\"']", low)]
    unique = lambda xs: tuple(dict.fromkeys(x for x in xs if x))
    kinds = tuple(k for k, hints in X.PREDICATE_HINTS.items() if any(h in low for h in hints))
    times = unique(re.findall(r"\d{4}-\d{2}-\d{2}|\b(?:today|yesterday|last week|last month)\b", low))[:4]
    answer = "procedure" if re.search(r"\bhow (?:to|do)\b|steps|procedure|playbook", low) else "timeline" if times or re.search(r"\bwhen\b|timeline|before|after", low) else "cause" if "cause" in kinds else "entity" if re.search(r"\bwho\b|\bwhich\b|\bwhat\b", low) else "general"
    return Plan(unique(quoted + [w for w in words if len(w) >= 4 and w not in STOP_ENTITIES])[:8], unique(w for w in words if ":" in w or "/" in w)[:6], kinds, times, answer)


class Engine:
    def __init__(self, catalog: Catalog, tenant: str = "default"):
        self.catalog, self.tenant = catalog, tenant

    def table(self, name: str) -> DataFrame:
        return self.catalog.read(name, self.tenant)

    # ------------------------------------------------------------------ governance

    def unsafe_memories(self) -> DataFrame:
        return self.table("memory").where(P.unsafe()).select("memory_id")

    def tainted(self, kind: str) -> DataFrame:
        """Ids of facts, episodes or segments that support an excluded memory."""
        support = self.catalog.read("memory_support").join(self.unsafe_memories(), "memory_id")
        facts = support.where("fact_id is not null").select("fact_id")
        if kind == "fact":
            by_episode = self.table("fact").join(support.where("episode_id is not null").select("episode_id"), "episode_id", "left_semi").select("fact_id")
            return facts.union(by_episode).distinct()
        if kind == "episode":
            of_facts = self.table("fact").join(facts, "fact_id", "left_semi").where("episode_id is not null").select("episode_id")
            return support.where("episode_id is not null").select("episode_id").union(of_facts).distinct()
        return self.catalog.read("fact_evidence").join(self.tainted("fact"), "fact_id", "left_semi").where("segment_id is not null").select("segment_id").distinct()

    def hidden(self, kind: str) -> DataFrame:
        d = self.table("lifecycle_target_intelligence").where((F.col("target_kind") == kind) & F.col("lifecycle_status").isin(*S.HIDDEN_STATUSES))
        return d.select("target_id").distinct()

    def visible(self, df: DataFrame, kind: str, key: str) -> DataFrame:
        return df.join(self.hidden(kind).withColumnRenamed("target_id", key), key, "left_anti")

    # ------------------------------------------------------------------ candidates

    def objects(self, kinds: tuple[str, ...], scope: str | None, at: Column | None, include_excluded: bool) -> DataFrame:
        """Searchable objects as candidates with their document text and vector."""
        keep = lambda d, kind, key: d if include_excluded else d.join(self.tainted(kind), key, "left_anti")
        valid = P.valid_at(at) if at is not None else F.lit(True)
        parts = []
        none = lambda t: F.lit(None).cast(t)
        if "fact" in kinds:
            f = keep(self.table("fact").where(P.in_scope(scope) & valid & (F.col("current_status") == "active")), "fact", "fact_id")
            e = self.table("entity").select(F.col("entity_id").alias("subject_entity_id"), F.col("canonical_name").alias("subject"))
            f = f.join(e, "subject_entity_id", "left")
            parts.append(f.select(F.col("fact_id").alias("object_id"), F.lit("fact").alias("object_type"), F.concat_ws(" ", "subject", "predicate").alias("title"), F.col("object_value").alias("summary"), "confidence", "valid_from", "valid_to", "scope_path", "priority", F.concat_ws(" ", "predicate", "object_value").alias("document"), "embedding", F.lit(0).alias("part")))
        if "memory" in kinds:
            m = self.table("memory").where(P.in_scope(scope) & P.governed(include_excluded) & F.coalesce(F.col("lifecycle_state") == "published", F.lit(True)))
            parts.append(m.select(F.col("memory_id").alias("object_id"), F.lit("memory").alias("object_type"), "title", F.col("narrative").alias("summary"), "confidence", none("timestamp").alias("valid_from"), none("timestamp").alias("valid_to"), "scope_path", "priority", F.concat("title", F.lit(" "), "narrative").alias("document"), "embedding", F.lit(1).alias("part")))
        if "segment" in kinds:
            g = keep(self.table("segment").where(P.in_scope(scope)), "segment", "segment_id")
            parts.append(g.select(F.col("segment_id").alias("object_id"), F.lit("segment").alias("object_type"), F.col("section_label").alias("title"), F.substring("content", 1, 500).alias("summary"), none("double").alias("confidence"), none("timestamp").alias("valid_from"), none("timestamp").alias("valid_to"), "scope_path", none("int").alias("priority"), F.col("content").alias("document"), "embedding", F.lit(2).alias("part")))
        if "episode" in kinds:
            p = keep(self.table("episode").where(P.in_scope(scope)), "episode", "episode_id")
            parts.append(p.select(F.col("episode_id").alias("object_id"), F.lit("episode").alias("object_type"), "title", "summary", none("double").alias("confidence"), F.col("start_at").alias("valid_from"), F.col("end_at").alias("valid_to"), "scope_path", none("int").alias("priority"), F.concat_ws(" ", "title", "summary").alias("document"), "embedding", F.lit(3).alias("part")))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def structured(self, question: str, scope: str | None, at: Column | None, limit: int) -> DataFrame:
        named = self.table("entity").where(P.any_ilike(question, "canonical_name") | P.any_ilike_list("aliases", question)).orderBy("canonical_name", "entity_id").limit(20)
        facts = self.table("fact").where(P.in_scope(scope) & (P.valid_at(at) if at is not None else F.lit(True)) & (F.col("current_status") == "active"))
        d = facts.join(F.broadcast(named.select(F.col("entity_id").alias("subject_entity_id"), F.col("canonical_name").alias("subject"))), "subject_entity_id")
        d = d.select(F.col("fact_id").alias("object_id"), F.lit("fact").alias("object_type"), F.concat_ws(" ", "subject", "predicate").alias("title"), F.col("object_value").alias("summary"), "confidence", "valid_from", "valid_to", "scope_path", "priority")
        return ranking.stream(d, "structured", [F.desc_nulls_last("confidence"), F.asc("object_id")], 3 * limit)

    def full_text(self, objects: DataFrame, question: str, limit: int) -> DataFrame:
        """Each kind's best matches, kinds one after the other; the rank is the place in that list."""
        d = fulltext.matching(objects, "document", question)
        d = ranking.first_per_key(d, ["part"], [F.desc("v"), F.asc("object_id")], 3 * limit)
        return ranking.stream(d.drop("document", "embedding"), "fts", [F.asc("part"), F.desc("v"), F.asc("object_id")], 12 * limit).drop("v", "part")

    def by_vector(self, objects: DataFrame, vector: list[float] | None, limit: int) -> DataFrame | None:
        """Nearest objects by cosine; a zero or missing query vector means that the stream is off."""
        if not vector or not any(vector):
            return None
        d = objects.where("embedding is not null").withColumn("v", S.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])))
        d = ranking.first_per_key(d.where("v is not null"), ["part"], [F.desc("v"), F.asc("object_id")], 3 * limit)
        return ranking.stream(d.drop("document", "embedding"), "vector", [F.asc("part"), F.desc("v"), F.asc("object_id")], 12 * limit).drop("v", "part")

    def role_owners(self, kinds: Sequence[str], scope: str | None, at: Column | None, include_excluded: bool) -> DataFrame:
        """The objects that vectors of a role lead to, as candidates with the roles' part number."""
        none = lambda t: F.lit(None).cast(t)
        keep = lambda d, kind, key: d if include_excluded else d.join(self.tainted(kind), key, "left_anti")
        times = [none("timestamp").alias("valid_from"), none("timestamp").alias("valid_to")]
        parts = []
        if "fact" in kinds:
            f = self.table("fact").where(P.in_scope(scope) & (P.valid_at(at) if at is not None else F.lit(True)) & (F.col("current_status") == "active"))
            parts.append(keep(f, "fact", "fact_id").select(F.col("fact_id").alias("object_id"), F.lit("fact").alias("object_type"), F.col("predicate").alias("title"), F.coalesce("object_value", F.lit("")).alias("summary"), "confidence", "valid_from", "valid_to", "scope_path", "priority"))
        if "segment" in kinds:
            g = keep(self.table("segment").where(P.in_scope(scope)), "segment", "segment_id")
            parts.append(g.select(F.col("segment_id").alias("object_id"), F.lit("segment").alias("object_type"), F.col("section_label").alias("title"), F.substring("content", 1, 500).alias("summary"), none("double").alias("confidence"), *times, "scope_path", none("int").alias("priority")))
        if "procedure" in kinds:
            d = self.visible(self.table("procedure").where(P.in_scope(scope) & (F.coalesce("lifecycle_state", F.lit("draft")) != "retired")), "procedure", "procedure_id")
            parts.append(d.select(F.col("procedure_id").alias("object_id"), F.lit("procedure").alias("object_type"), "title", "summary", "confidence", *times, "scope_path", none("int").alias("priority")))
        meta = lambda column, names: [F.try_element_at(F.col(column), F.lit(n)) for n in names]
        if "media_artifact" in kinds:
            m = self.table("media_artifact").where(P.in_scope(scope))
            title = F.coalesce(*meta("media_meta", ("title", "caption", "description")), "media_type")
            summary = F.coalesce(F.try_element_at("media_meta", F.lit("caption")), "caption", *meta("media_meta", ("description", "alt_text", "title")), F.lit(""))
            parts.append(m.select(F.col("media_id").alias("object_id"), F.lit("media_artifact").alias("object_type"), title.alias("title"), summary.alias("summary"), none("double").alias("confidence"), *times, "scope_path", none("int").alias("priority")))
        if "visual_region" in kinds:
            media = self.table("media_artifact").select("media_id", F.col("scope_path").alias("_scope"))
            r = self.table("visual_region").join(media, "media_id").withColumn("scope_path", F.coalesce(F.try_element_at("region_meta", F.lit("scope_path")), "_scope"))
            r = r.where(P.in_scope(scope))
            summary = F.coalesce(F.try_element_at("region_meta", F.lit("ocr_text")), "ocr_text", *meta("region_meta", ("text", "caption")), "label", F.lit(""))
            parts.append(r.select(F.col("region_id").alias("object_id"), F.lit("visual_region").alias("object_type"), F.coalesce("label", "region_type").alias("title"), summary.alias("summary"), "confidence", *times, "scope_path", none("int").alias("priority")))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def by_role(self, questions: DataFrame, *, limit: int = 10, scope: str | None = None, at: Column | None = None, kinds: Sequence[str] = ROLE_KINDS, include_excluded: bool = False) -> DataFrame:
        """The vector stream of many questions (question_id, vector) over the typed embeddings, one pass over the index.

        Each role leads to its owner: evidence to facts, text to segments, captions to media, text and captions of regions to
        regions. Owners are filtered before the nearest are taken, ``3 * limit`` of each kind, kinds one after the other; an
        owner with several vectors counts once, with its best.
        """
        unknown = [k for k in kinds if k not in ROLE_KINDS]
        if unknown:
            raise ValueError(f"no vectors lead to {', '.join(unknown)}")
        limit = P.bounded(limit, 1, 200)
        owners = self.role_owners(kinds, scope, at, include_excluded)
        owner = F.coalesce(*[F.when(F.col("role") == role, F.struct(F.lit(kind).alias("object_type"), F.col(key).alias("object_id"))) for role, (kind, key) in ROLES.items()])
        rows = self.table("embedding_index").select(owner.alias("_o"), "embedding").where("_o is not null").select("_o.object_type", "_o.object_id", "embedding")
        rows = rows.join(owners.select("object_type", "object_id"), ["object_type", "object_id"], "left_semi")
        hits = vectors.nearest(rows, questions, 3 * limit, part="object_type")
        number = F.array_position(F.array(*map(F.lit, ROLE_KINDS)), F.col("object_type"))
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(number, "rank")))
        return hits.join(owners, ["object_type", "object_id"]).withColumn("stream", F.lit("vector"))

    def expansion(self, seen: DataFrame, scope: str | None, limit: int) -> DataFrame:
        """Facts that share a subject with found facts, then facts of found episodes; none that was seen."""
        facts = self.table("fact").where(P.in_scope(scope) & (F.col("current_status") == "active"))
        ids = seen.select("object_id", "object_type").distinct()
        subjects = facts.join(ids.where("object_type = 'fact'").select(F.col("object_id").alias("fact_id")), "fact_id", "left_semi").select("subject_entity_id").distinct()
        near = facts.join(subjects, "subject_entity_id", "left_semi").withColumn("way", F.lit(0))
        of = facts.join(ids.where("object_type = 'episode'").select(F.col("object_id").alias("episode_id")), "episode_id", "left_semi").withColumn("way", F.lit(1))
        d = near.unionByName(of).join(ids.select(F.col("object_id").alias("fact_id")), "fact_id", "left_anti")
        d = ranking.first_per_key(d, ["fact_id"], [F.asc("way")])
        d = ranking.first_per_key(d, ["way"], [F.desc_nulls_last("confidence"), F.asc("fact_id")], 2 * limit)
        d = d.select(F.col("fact_id").alias("object_id"), F.lit("fact").alias("object_type"), F.col("predicate").alias("title"), F.col("object_value").alias("summary"), "confidence", "valid_from", "valid_to", "scope_path", "priority", "way")
        return ranking.stream(d, "temporal", [F.asc("way"), F.desc_nulls_last("confidence"), F.asc("object_id")], 4 * limit).drop("way")

    def graph_stream(self, seen: DataFrame, objects: DataFrame, limit: int) -> DataFrame:
        seeds = seen.select(F.col("object_type").alias("node_type"), F.col("object_id").alias("node_id")).distinct()
        far = graph.far_ends(self.table("memory_edge"), seeds, 4 * limit).withColumn("path", graph.path_text())
        best = ranking.first_per_key(far, ["far_type", "far_id"], [F.desc_nulls_last("confidence"), F.asc("edge_id")]).select(F.col("far_type").alias("object_type"), F.col("far_id").alias("object_id"), F.col("confidence").alias("v"), "path")
        d = objects.where("object_type <> 'segment'").join(best, ["object_type", "object_id"]).drop("document", "embedding", "part", "path")
        return ranking.stream(d, "graph", [F.desc_nulls_last("v"), F.asc("object_id")], limit).drop("v")

    def search(self, question: str, *, limit: int = 10, scope: str | None = None, at: Column | None = None, kinds: tuple[str, ...] = ("fact", "memory", "segment", "episode"), vector: list[float] | None = None, with_graph: bool = False, rerank: bool = False, include_excluded: bool = False) -> DataFrame:
        """Hybrid search: fused, boosted, filtered, with evidence; best first."""
        limit = P.bounded(limit, 1, 200)
        objects = self.objects(kinds, scope, at, include_excluded)
        weights = dict(S.GRAPH_WEIGHTS if with_graph else S.WEIGHTS)
        streams = [self.full_text(objects, question, limit)]
        if "fact" in kinds:
            streams.insert(0, self.structured(question, scope, at, limit))
        if (v := self.by_vector(objects, vector, limit)) is not None:
            streams.append(v)
        cols = ["object_id", "object_type"]
        seen = reduce(lambda a, b: a.unionByName(b), [s.select(*cols) for s in streams])
        streams.append(self.expansion(seen, scope, limit))
        if with_graph:
            streams.append(self.graph_stream(seen, objects, limit))
        fused = ranking.fuse(streams, weights)
        for kind in ("fact", "memory", "procedure"):
            hidden = self.hidden(kind).withColumnRenamed("target_id", "object_id").withColumn("object_type", F.lit(kind))
            fused = fused.join(hidden, ["object_id", "object_type"], "left_anti")
        fused = self.with_evidence(fused)
        if rerank:
            fused = fused.withColumn("score", self.rerank(plan(question)))
            return ranking.ranked(fused, limit, "score")
        return ranking.ranked(fused.withColumn("score", F.round("total_score", 6)), limit)

    def rerank(self, p: Plan) -> Column:
        text = F.lower(F.concat_ws(" ", "title", "summary", "scope_path", "object_type"))
        count = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
        zero = F.lit(0.0)
        answer = {
            "procedure": F.when(F.col("object_type") == "procedure", 1.0).when((F.col("object_type") == "memory") & text.rlike("playbook|fix"), 1.0).otherwise(0.0),
            "timeline": F.when((F.col("object_type") == "episode") | F.col("valid_from").isNotNull(), 1.0).otherwise(0.0),
            "cause": F.when(text.rlike("cause|why"), 1.0).otherwise(0.0),
            "entity": F.when(F.col("object_type").isin("fact", "episode"), 1.0).otherwise(0.0),
        }.get(p.answer, zero)
        extra = F.when(text.rlike("fix|remediat"), 1).otherwise(0) if "remediation" in p.predicates else F.lit(0)
        when = F.lower(F.concat_ws(" ", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"), "summary"))
        return ranking.rerank_score(F.col("total_score"), {
            "entity": F.least(F.lit(1.0), count(p.entities) / max(1, min(len(p.entities), 4))) if p.entities else zero,
            "scope": F.coalesce(reduce(lambda a, b: a | b, [F.lower("scope_path").startswith(s) for s in p.scopes]).cast("double"), zero) if p.scopes else zero,
            "predicate": F.least(F.lit(1.0), (count(p.predicates) + extra) / max(1, len(p.predicates))) if p.predicates else zero,
            "answer": answer,
            "evidence": F.least(F.lit(1.0), F.size("evidence") / 3.0),
            "graph": F.least(F.lit(1.0), F.coalesce(F.try_element_at("scores", F.lit("graph")), zero) * 100.0),
            "time": F.coalesce(reduce(lambda a, b: a | b, [F.contains(when, F.lit(h)) for h in p.times]).cast("double"), zero) if p.times else zero,
            "confidence": F.coalesce("confidence", F.lit(0.5)),
            "priority": S.priority_boost("priority") / 2.0,
        })

    def with_evidence(self, fused: DataFrame) -> DataFrame:
        """Evidence of facts, and of memories through their supporting facts, heaviest first."""
        e = self.catalog.read("fact_evidence")
        own = e.select(F.col("fact_id").alias("object_id"), "weight", "segment_id", "excerpt", "source_relpath")
        via = self.catalog.read("memory_support").where("fact_id is not null").join(e, "fact_id").select(F.col("memory_id").alias("object_id"), "weight", "segment_id", "excerpt", "source_relpath")
        wanted = own.unionByName(via).join(fused.select("object_id"), "object_id", "left_semi")
        lists = wanted.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("weight", F.lit(0.0))).alias("w"), "segment_id", "excerpt", "source_relpath"))).alias("evidence"))
        empty = F.array().cast("array<struct<w:double,segment_id:string,excerpt:string,source_relpath:string>>")
        return fused.join(lists, "object_id", "left").withColumn("evidence", F.coalesce("evidence", empty))

    # ------------------------------------------------------------------ time

    def frames(self, subject: str | None = None, scope: str | None = None, event_type: str | None = None) -> DataFrame:
        e = self.table("entity").select("entity_id", "canonical_name")
        d = self.visible(self.table("event_frame").where(P.in_scope(scope)), "event_frame", "event_frame_id")
        for end in ("actor", "target", "location"):
            d = d.join(e.toDF(f"{end}_entity_id", end), f"{end}_entity_id", "left")
        if event_type:
            d = d.where(F.col("event_type") == event_type)
        return d.where(P.any_ilike(subject, "actor", "target", "location")) if subject else d

    def with_frame_evidence(self, frames: DataFrame) -> DataFrame:
        """Frames with the evidence of their own fact and segment: a row for each excerpt, nulls where there is none."""
        e = self.catalog.read("fact_evidence").select(F.col("fact_id").alias("source_fact_id"), F.col("segment_id").alias("evidence_segment_id"), "excerpt", "source_relpath", "line_start", "line_end")
        return frames.join(e, ["source_fact_id", "evidence_segment_id"], "left")

    def timeline(self, subject: str | None = None, scope: str | None = None, event_type: str | None = None, start: Column | None = None, end: Column | None = None, limit: int = 50, evidence: bool = False) -> DataFrame:
        d = self.frames(subject, scope, event_type)
        d = d.where(P.within("time_start", start, end)) if start is not None or end is not None else d
        if evidence:
            d = self.with_frame_evidence(d)
            return ranking.top(d, [F.asc_nulls_last("time_start"), F.asc("created_at"), F.asc("event_frame_id"), F.asc_nulls_first("excerpt")], P.bounded(limit, 1, 200))
        return ranking.top(d, [F.asc_nulls_last("time_start"), F.asc("created_at"), F.asc("event_frame_id")], P.bounded(limit, 1, 200))

    def before_after(self, at: Column, n: int = 3, subject: str | None = None, scope: str | None = None, event_type: str | None = None) -> DataFrame:
        return temporal.around(self.frames(subject, scope, event_type).where("time_start is not null"), at, "time_start", "event_frame_id", P.bounded(n, 1, 50), "created_at")

    def causal_chains(self, subject: str | None = None, scope: str | None = None, limit: int = 10) -> DataFrame:
        """The subject chooses the episodes; all causal steps of an episode are returned."""
        chosen = self.frames(subject, scope).where("episode_id is not null").groupBy("episode_id").agg(F.min("time_start").alias("t")).orderBy(F.asc_nulls_last("t"), "episode_id").limit(limit)
        steps = self.frames(None, scope).join(chosen.select("episode_id"), "episode_id", "left_semi")
        return temporal.chains(steps, "episode_id", "time_start", "event_frame_id", S.CAUSAL_TYPES, "event_type", limit, ["event_type", "action", "outcome"])

    def state_at(self, entity: str, at: Column) -> DataFrame:
        e = self.table("entity").where(F.col("canonical_name") == entity).select(F.col("entity_id").alias("subject_entity_id"))
        return self.table("fact").where(P.valid_at(at) & (F.col("current_status") == "active")).join(e, "subject_entity_id", "left_semi")

    def explain(self, object_id: str) -> DataFrame:
        """Everything that supports an object: (kind, id, excerpt)."""
        support = self.catalog.read("memory_support").where(F.col("memory_id") == object_id)
        facts = support.select("fact_id").union(self.catalog.spark.createDataFrame([(object_id,)], "fact_id string")).where("fact_id is not null")
        evidence = self.catalog.read("fact_evidence").join(facts, "fact_id", "left_semi")
        return support.where("fact_id is not null").select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), F.col("notes").alias("excerpt")).union(support.where("episode_id is not null").select(F.lit("episode"), "episode_id", "notes")).union(evidence.select(F.lit("segment"), "segment_id", "excerpt"))

    # ------------------------------------------------------------------ procedures, visuals

    def procedures(self, question: str, scope: str | None = None, limit: int = 10) -> DataFrame:
        text = F.concat(F.col("title"), F.lit(" "), F.coalesce("summary", F.lit("")))
        d = self.visible(self.table("procedure").where(P.in_scope(scope)), "procedure", "procedure_id")
        d = d.withColumn("rank", fulltext.text_rank(text, fulltext.query_lexemes(question), fulltext.proximity))
        d = d.where(F.col("rank").isNotNull() | P.any_ilike(question, "title", "summary")).withColumn("rank", F.coalesce("rank", F.lit(0.0)))
        d = ranking.top(d, [F.desc("rank"), F.desc_nulls_last("confidence"), F.asc("procedure_id")], limit)
        steps = self.catalog.read("procedure_step").groupBy("procedure_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "step_id", "action", "expected_result"))).alias("steps"))
        return d.join(steps, "procedure_id", "left")

    def next_step(self, question: str, completed: int = 0, scope: str | None = None, limit: int = 10) -> DataFrame:
        d = self.procedures(question, scope, limit)
        later = F.filter("steps", lambda s: s["step_index"] > completed)
        return d.select("procedure_id", "title", F.get(later, F.lit(0)).alias("next_step")).where("next_step is not null")

    def failed_remediations(self, question: str, scope: str | None = None, limit: int = 10) -> DataFrame:
        d = self.procedures(question, scope, limit).join(self.table("episode").select("episode_id", F.col("outcome").alias("episode_outcome")), "episode_id", "left")
        d = d.withColumn("step", F.explode_outer("steps")).select("procedure_id", "title", "summary", "episode_outcome", "step.*")
        return d.where(F.lower(F.concat_ws(" ", "episode_outcome", "summary", "expected_result")).rlike(S.FAILURE))

    def visuals(self, question: str, scope: str | None = None, limit: int = 10) -> DataFrame:
        m = self.table("media_artifact").where(P.in_scope(scope))
        a = m.where(P.any_ilike(question, "caption")).select(F.lit("media").alias("kind"), "media_id", F.lit(None).cast("string").alias("region_id"), F.col("caption").alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit(1).alias("rank_group"), "created_at")
        r = self.table("visual_region").join(m.select("media_id"), "media_id", "left_semi").where(P.any_ilike(question, "label", "ocr_text"))
        b = r.select(F.lit("region").alias("kind"), "media_id", "region_id", F.coalesce("ocr_text", "label").alias("text"), "confidence", F.lit(0).alias("rank_group"), "created_at")
        return ranking.top(a.unionByName(b), [F.asc("rank_group"), F.desc_nulls_last("confidence"), F.desc_nulls_last("created_at"), F.asc("media_id")], limit)

    # ------------------------------------------------------------------ recall

    def prompt_search(self, question: str, scope: str | None = None, limit: int = 20) -> DataFrame:
        d = self.visible(self.table("memory").where(P.in_scope(scope) & P.governed()), "memory", "memory_id")
        d = d.withColumn("text_rank", fulltext.text_rank(F.concat("title", F.lit(" "), "narrative"), fulltext.query_lexemes(question)))
        d = d.where(F.col("text_rank").isNotNull() | P.any_ilike(question, "title", "narrative")).withColumn("text_rank", F.coalesce("text_rank", F.lit(0.0)))
        rank = S.prompt_rank(F.col("text_rank"), F.coalesce("quality_score", "confidence"), F.coalesce(F.col("source_class") == "corrected_by_user", F.lit(False)), F.coalesce(F.col("governance_status") == "validated", F.lit(False)), F.col("strength"), F.col("priority"))
        return ranking.top(d.withColumn("prompt_rank", rank), [F.desc("text_rank"), F.desc_nulls_last("quality_score"), F.asc_nulls_last("priority"), F.desc_nulls_last("updated_at"), F.asc("memory_id")], limit)

    def recall(self, question: str, budget: int = 800, scope: str | None = None, limit: int = 20) -> DataFrame:
        """The memories packed into a token budget, with section and role."""
        d = self.prompt_search(question, scope, limit).withColumn("content", X.redact("narrative"))
        text = F.concat_ws(" ", "title", "content")
        item = F.struct("memory_id", S.section(F.col("namespace"), F.col("governance_status"), text).alias("section"), S.role(F.col("namespace"), F.col("governance_status"), text).alias("role"), "content", F.coalesce("token_count", X.token_estimate("content")).alias("token_count"))
        rows = d.withColumn("item", item).withColumn("size", F.col("item.token_count")).withColumn("request", F.lit(question))
        return folds.pack(rows, ["request"], [F.desc("prompt_rank"), F.asc("memory_id")], "size", "item", budget)

    def snapshots(self, requests: DataFrame, matches: DataFrame | None = None, markers: tuple[str, ...] = (), limit: int = snapshot.LIMIT) -> DataFrame:
        """The memory snapshot of each request (``operators.snapshot``). Without ``matches`` the queries are searched for here:
        a memory matches a request with all lexemes of its query, found by the rarest of them."""
        memories = self.visible(self.table("memory"), "memory", "memory_id")
        if matches is None:
            asked = snapshot.resolve(requests, markers).where("query <> ''").select(F.col("request_id").alias("query_id"), F.col("query").alias("question"))
            stored = fulltext.postings(memories.where(P.governed()), "memory_id", F.concat_ws(" ", "title", "narrative"))
            matches = fulltext.batch_search(stored, asked, "memory_id", 10 * limit).select(F.col("query_id").alias("request_id"), "memory_id", F.col("rank_value").alias("text_rank"))
        return snapshot.build(requests, memories, matches, markers, limit)

    # ------------------------------------------------------------------ consolidation

    def revisions(self, now: Column, scope: str | None = None, limit: int | None = None) -> DataFrame:
        """What memories call for: created, enriched, merged, demoted or retired (``operators.revisions``)."""
        return revisions.proposals(self.table("memory"), self.catalog.read("memory_support"), self.table("fact"), now, scope, limit)

    def contradiction_edges(self) -> tuple[DataFrame, DataFrame]:
        """(new edges, memories whose contradictions rise by one): each memory that contradicts others gets an edge, not each pair."""
        return mining.conflict_edges(self.table("memory").where(P.governed()), self.table("memory_cue"), self.table("memory_edge"), self.tenant)

    def backfilled(self) -> DataFrame:
        """The tenant's facts with times from episodes and supersession, and the rules that changed them."""
        return temporal.backfill(self.table("fact"), self.table("episode"))

    def pattern_candidates(self) -> DataFrame:
        return mining.patterns(mining.trusted(self.table("fact")), ["subject_entity_id", "predicate", "fact_kind"], "episode_id", "object_value", "fact_id", "scope_path")

    def reconcile_patterns(self, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """The memory table with patterns added or updated (and flags telling which), and the support rows that are new.

        A pattern that is known keeps its id and title; its support never falls.
        """
        now = F.current_timestamp() if now is None else now
        names = self.table("entity").select(F.col("entity_id").alias("subject_entity_id"), F.col("canonical_name").alias("_name"))
        c = self.pattern_candidates().join(names, "subject_entity_id", "left").withColumn("subject", F.coalesce("_name", "subject_entity_id"))
        old = self.table("memory").groupBy("fingerprint").agg(F.min("memory_id").alias("_known"), F.max("support_count").alias("_count"))
        c = c.join(old, "fingerprint", "left").withColumn("n", F.greatest("support", F.coalesce("_count", F.lit(0))))
        digest = F.md5(F.concat_ws("|", F.lit(self.tenant), "fingerprint"))
        parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        c = c.withColumn("memory_id", F.coalesce("_known", F.concat_ws("-", *parts)))
        value = F.when(F.length("usual_value") > 200, F.concat(F.substring("usual_value", 1, 200), F.lit("..."))).when(F.length("usual_value") > 0, F.col("usual_value"))
        narrative = F.concat_ws(
            "\n",
            F.format_string('Pattern: %s exhibits "%s" behavior.', "subject", "predicate"),
            F.format_string("Kind: %s", "fact_kind"),
            F.format_string("Support: %d independent episodes confirm this pattern.", "support"),
            F.concat(F.lit("Representative value: "), value),
            F.format_string("Episodes: %d corroborating episodes.", F.size("episode_ids")),
            F.format_string("Facts: %d supporting facts.", F.size("fact_ids")),
        )
        rows = c.select(
            F.lit(self.tenant).alias("tenant"), "fingerprint", "memory_id", F.lit("pattern").alias("memory_type"),
            F.format_string("%s %s (%s)", "subject", "predicate", "fact_kind").alias("title"), narrative.alias("narrative"),
            F.least(0.5 + F.col("n") * 0.1, F.lit(0.95)).alias("confidence"), F.col("n").cast("int").alias("support_count"), F.lit(0).alias("contradiction_count"),
            F.when(F.col("n") >= 2, "published").otherwise("draft").alias("lifecycle_state"), "scope_path", now.cast("timestamp").alias("updated_at"), now.cast("timestamp").alias("created_at"),
        )
        merged = merge.upsert(self.table("memory"), rows, ["tenant", "fingerprint"], {"title": "keep", "scope_path": "keep", "contradiction_count": "keep", "created_at": "keep", "memory_id": "keep"})
        both = lambda ids, kind, note: c.select("memory_id", F.explode(ids).alias(kind), F.lit("supporting").alias("support_type"), F.col(note).alias("notes"), F.lit(self.tenant).alias("tenant"))
        support = both("fact_ids", "fact_id", "predicate").unionByName(both("episode_ids", "episode_id", "subject"), allowMissingColumns=True)
        known = self.catalog.read("memory_support").select("memory_id", "fact_id", "episode_id").distinct()
        same = [support[k].eqNullSafe(known[k]) for k in ("memory_id", "fact_id", "episode_id")]
        return merged, support.join(known, same, "left_anti")

    def retired(self, now: Column, days: int = 7) -> DataFrame:
        """Memories with more contradictions than support, old enough and without priority-1 support."""
        guarded = self.catalog.read("memory_support").join(self.table("fact").where("priority = 1").select("fact_id"), "fact_id", "left_semi").select("memory_id")
        old = F.unix_timestamp("created_at") < F.unix_timestamp(now) - days * 86400
        return self.table("memory").where((F.col("contradiction_count") > F.col("support_count")) & old).join(guarded, "memory_id", "left_anti")

    def memory_conflicts(self) -> DataFrame:
        return mining.conflicts(self.table("memory").where(P.governed()), self.table("memory_cue"), full_text=True)

    def link_candidates(self, scope: str | None = None) -> DataFrame:
        """New typed edges from trusted facts with evidence to the memories they support or counter; plain support is not an edge."""
        f = mining.trusted(self.table("fact")).where(F.col("fact_kind").isin(*mining.LINK_KINDS)).select("fact_id", "predicate", "object_value", "fact_kind", F.col("confidence").alias("_fc"), "assertion_class", F.col("scope_path").alias("_fs"))
        m = self.table("memory").where(F.coalesce("lifecycle_state", F.lit("draft")) != "retired").select("memory_id", F.col("confidence").alias("_mc"), F.col("scope_path").alias("_ms"))
        order = F.struct(F.coalesce("weight", F.lit(float("-inf"))), -F.coalesce(F.unix_micros("created_at"), F.lit(1 << 62)))
        proof = self.catalog.read("fact_evidence").groupBy("fact_id").agg(F.max_by("segment_id", order).alias("evidence_segment_id"))
        s = self.catalog.read("memory_support").where(F.col("fact_id").isNotNull() & F.col("support_type").isin("supporting", "counter")).select("memory_id", "fact_id", "support_type").distinct()
        d = s.join(m, "memory_id").join(f, "fact_id").join(proof, "fact_id").withColumn("scope_path", F.coalesce("_ms", "_fs"))
        d = d.where(P.in_scope(scope)) if scope else d
        d = d.withColumn("edge_type", mining.edge_type(F.col("support_type"), F.col("fact_kind"), F.col("predicate"), F.col("object_value"))).where("edge_type <> 'supports'")
        sure = F.least(F.coalesce("_fc", F.lit(0.5)), F.coalesce("_mc", "_fc", F.lit(0.5)))
        e = d.select(F.lit(self.tenant).alias("tenant"), F.lit("fact").alias("source_type"), F.col("fact_id").alias("source_id"), F.lit("memory").alias("target_type"), F.col("memory_id").alias("target_id"), "edge_type", sure.alias("confidence"), "assertion_class", "evidence_segment_id", "scope_path")
        return merge.insert_if_absent(self.table("memory_edge"), e.withColumn("edge_fingerprint", graph.edge_fingerprint()), ["tenant", "source_type", "source_id", "target_type", "target_id", "edge_type"])
