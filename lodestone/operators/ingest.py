"""Loading extraction records: one batch of any number of items becomes the next version of every table it touches.

All steps are joins on keys, so a batch costs the same number of shuffles whatever its size. Ids are digests of keys: a
batch that is loaded again gives the same rows. What an artifact brought before is taken out first. Items are shuffled only
if a key repeats, facts once; what an item says of its facts (types, episode) is looked up in the item itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_text
from ..sources.readers import gate
from . import merge
from .upkeep import date_range, ensure_artifacts, fact_fingerprint, fact_text, new_artifact_id, new_reviews, priority

#: An item: an artifact with what was found in it. Dates are texts; ``segments`` of a fact are ordinals.
ITEM = """tenant string, source_key string, source_type string, original_path string, content string, scope_path string,
episode struct<type:string,title:string,start:string,end:string,severity:string,outcome:string,summary:string>, entities array<struct<name:string,type:string>>,
segments array<struct<ordinal:int,label:string,content:string,line_start:int,line_end:int>>,
facts array<struct<subject:string,predicate:string,value:string,kind:string,assertion_class:string,confidence:double,segments:array<int>,valid_from:string,valid_to:string,meta:map<string,string>>>"""
#: Tables that a load rewrites.
TABLES = ("artifact", "entity", "extraction_run", "episode", "segment", "fact", "fact_evidence", "memory_support", "review_queue")
#: Reviews that a kind of source asks for. Fixed values.
REVIEWS = {"project_doc": "project_doc_value_review", "vestige_memory": "assistant_memory_import_review", "pai_auto_memory": "assistant_memory_import_review"}
TOO_LARGE = "source_too_large"
EXCERPT = 500


def digest(*parts: Column | str) -> Column:
    """A 32 digit id of key parts; null parts count as empty."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *texts), 256), 1, 32)


def oversized(items: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(items to load, artifacts that wait for a decision): contents above ``limit`` bytes are not extracted."""
    size = F.octet_length(F.coalesce("content", F.lit("")))
    large = items.where(size > limit).select("tenant", "source_key", "source_type", "original_path", "content", F.coalesce("scope_path", F.concat(F.lit("incident:"), "source_key")).alias("scope_path"))
    return items.where(size <= limit), large.withColumn("preservation_state", F.lit("pending_escalation"))


def identified(d: DataFrame) -> DataFrame:
    """Rows of (tenant, source_key, _known: the stored artifact, episode or has_episode) with the ids that follow from them."""
    d = d.withColumn("artifact_id", F.coalesce("_known", new_artifact_id()))
    return d.withColumns({"run_id": digest("artifact_id", F.lit("run")), "episode_id": F.when(F.col("has_episode"), digest("artifact_id", F.lit("episode")))})


def found_facts(items: DataFrame) -> DataFrame:
    """One row per fact ``f`` of items: its place, the types that its item gives to its subject and value, and why it is rejected.

    Digests are left to ``identified_facts``: they do not compress, so they are taken after facts have been shuffled.
    """
    named = lambda name: F.array_min(F.transform(F.filter("entities", lambda e: e["name"] == name), lambda e: e["type"]))
    d = items.select("tenant", "source_key", "_known", "source_type", "scope_path", "severity", "has_episode", "episode_id", "entities", F.posexplode("facts").alias("place", "f"))
    d = d.select("*", "f.subject", "f.predicate", "f.confidence", "f.meta", F.coalesce("f.segments", F.array().cast("array<int>")).alias("segment_ids"))
    return gate(d).withColumns({"_st": F.coalesce(named(F.col("subject")), F.lit("config_item")), "_ot": named(F.col("f.value"))}).drop("entities", "episode_id")


def _text(make: Callable) -> Column:
    return make(F.col("f.subject"), F.col("f.predicate"), json_text(F.coalesce("f.value", F.lit(""))))


def identified_facts(found: DataFrame) -> DataFrame:
    """Found facts with their ids, fingerprint, priority and dates."""
    d = identified(found).withColumns({"fact_id": digest("artifact_id", F.lit("fact"), "place"), "canonical_fingerprint": _text(fact_fingerprint), "priority": priority(F.lit(False), F.col("severity"), F.col("f.assertion_class"))})
    dates = date_range(F.col("f.valid_from"), F.col("f.valid_to"))
    fields = {c: F.col(f"f.{c}") for c in ("subject", "predicate", "confidence", "meta", "assertion_class")}
    return d.withColumns({**fields, "fact_kind": F.col("f.kind"), "object_value": F.col("f.value"), "valid_from": dates["start"], "valid_to": dates["end"], "segment_ids": F.coalesce("f.segments", F.array().cast("array<int>"))})


def first_of_kind(found: DataFrame, facts: DataFrame) -> DataFrame:
    """The first found fact, by source and place, of each tenant, fingerprint and kind, with the stored one (``_stored``) if there is one.

    What a fingerprint is made of stands for it in the shuffle, and the join meets stored fingerprints by an expression.
    """
    first = Window.partitionBy("tenant", "_text", "f.kind").orderBy("source_key", "place")
    names = ("tenant", "source_key", "_known", "scope_path", "severity", "has_episode", "place", "f", "_st", "_ot")
    one = found.select(*names, _text(fact_text).alias("_text")).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*names)
    stored = facts.groupBy(F.col("tenant").alias("_tenant"), F.col("canonical_fingerprint").alias("_print"), F.col("fact_kind").alias("_kind")).agg(F.min("fact_id").alias("_stored"))
    same = (F.col("tenant") == F.col("_tenant")) & (_text(fact_fingerprint) == F.col("_print")) & (F.col("f.kind") == F.col("_kind"))
    return one.join(stored, same, "left").select(*names, "_stored")


def load(tables: Mapping[str, DataFrame], items: DataFrame, now: Column, max_bytes: int | None = None, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> dict[str, DataFrame]:
    """The next versions of TABLES, and ``rejected``: the facts that the gate let not pass, with the reason.

    ``keep`` may write what several tables are made of (the items, the first facts of each fingerprint, the entities) and read it
    back, so that it is not computed for each table again. An item without facts, segments or episode is an artifact and a run. Of items with one key in a batch the same one is loaded into every table.
    """
    large = None
    if max_bytes is not None:
        items, large = oversized(items, max_bytes)
    out = dict(tables)
    key = ["tenant", "source_key"]
    d = merge.unique(items, key)
    every = merge.unique(items.unionByName(large, allowMissingColumns=True), key) if large is not None else None
    d = keep(d.join(tables["artifact"].select(*key, F.col("artifact_id").alias("_known")), key, "left"))
    ids, artifacts = ensure_artifacts(tables["artifact"], every if every is not None else d.drop("_known"), unique=True)
    d = identified(d.where("tenant is not null and source_key is not null").withColumns({"has_episode": F.col("episode").isNotNull(), "severity": F.col("episode.severity")}))
    if large is not None:
        waiting = large.select("tenant", "source_key", "preservation_state").distinct()
        artifacts = artifacts.drop("preservation_state").join(waiting, ["tenant", "source_key"], "left").withColumn("preservation_state", F.coalesce("preservation_state", F.lit("discovered")))
    mark = {"created_at": now, "updated_at": now}

    def add(name: str, kept: DataFrame, new: DataFrame) -> DataFrame:
        """The kept rows and the new ones, in the columns of the table."""
        want = tables[name].schema
        new = new.withColumns({k: v for k, v in mark.items() if k in want.names})
        return kept.select(*want.names).unionByName(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields]))

    # What these artifacts brought before.
    changed = d.select("artifact_id")
    old_runs = tables["extraction_run"].join(changed, "artifact_id", "left_semi").select(F.col("run_id").alias("created_run_id"))
    old_facts = tables["fact"].join(old_runs, "created_run_id", "left_semi").select("fact_id")
    old_episodes = tables["episode"].join(changed.select(F.col("artifact_id").alias("primary_artifact_id")), "primary_artifact_id", "left_semi").select("episode_id")
    kept_facts = tables["fact"].join(old_runs, "created_run_id", "left_anti")
    out["memory_support"] = tables["memory_support"].join(old_facts, "fact_id", "left_anti").join(old_episodes, "episode_id", "left_anti").select(*tables["memory_support"].columns)

    found = found_facts(d)
    out["rejected"] = found.where("reject_reason is not null").select("tenant", "source_key", "place", "subject", "predicate", "reject_reason")
    firsts = keep(first_of_kind(found.where("reject_reason is null"), kept_facts))
    seen = firsts.where("_stored is not null").select(F.col("_stored").alias("fact_id")).distinct()
    fresh = firsts.where("_stored is null").drop("_stored")

    # Entities: those named by the item, then subjects that nothing names; a name's type is the item's first of it.
    named = d.select("tenant", "artifact_id", F.explode("entities").alias("e")).select("tenant", "artifact_id", F.col("e.name").alias("name"), F.col("e.type").alias("type"))
    wanted = named.select("tenant", "type", "name").union(fresh.select("tenant", "_st", "f.subject")).distinct()
    wanted = wanted.select("tenant", F.col("type").alias("entity_type"), F.col("name").alias("canonical_name"), digest("tenant", "type", "name").alias("entity_id"), now.alias("first_seen_at"), now.alias("last_seen_at"), now.alias("created_at"), now.alias("updated_at"))
    entities = merge.upsert(tables["entity"], wanted, ["tenant", "entity_type", "canonical_name"], {"entity_id": "keep", "first_seen_at": "keep", "created_at": "keep", "last_seen_at": "greatest"}).select(*tables["entity"].columns)
    entities = keep(entities)
    out["entity"] = entities
    # A new entity's id follows from its name, a stored one's is looked up.
    known = tables["entity"].select("tenant", F.col("entity_type").alias("_t"), F.col("canonical_name").alias("_n"), "entity_id")
    new_facts = fresh.withColumns({"_subject": F.col("f.subject"), "_value": F.col("f.value")}).join(known.toDF("tenant", "_st", "_subject", "_sid"), ["tenant", "_st", "_subject"], "left").join(known.toDF("tenant", "_ot", "_value", "_oid"), ["tenant", "_ot", "_value"], "left")
    new_facts = identified_facts(new_facts).withColumns({"subject_entity_id": F.coalesce("_sid", digest("tenant", "_st", "_subject")), "object_entity_id": F.when(F.col("_ot").isNotNull(), F.coalesce("_oid", digest("tenant", "_ot", "_value")))})

    # Facts that were seen again are touched, not added.
    touched = kept_facts.join(seen.withColumn("_seen", F.lit(True)), "fact_id", "left")
    touched = touched.withColumn("updated_at", F.when(F.col("_seen"), now).otherwise(F.col("updated_at")))
    new_facts = new_facts.select("*", F.col("run_id").alias("created_run_id"), F.lit("active").alias("current_status"))
    out["fact"] = add("fact", touched, new_facts)

    parts = d.select("tenant", "source_key", "artifact_id", "episode_id", "scope_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("_whole"), F.explode("segments").alias("s")).select("tenant", "source_key", "artifact_id", "episode_id", "scope_path", "_whole", F.col("s.ordinal").alias("ordinal"), F.col("s.label").alias("section_label"), F.col("s.content").alias("content"), "s.line_start", "s.line_end")
    segments = parts.withColumns({"segment_id": digest("artifact_id", F.lit("segment"), "ordinal"), "source_sha256": F.sha2("content", 256)})
    out["segment"] = add("segment", tables["segment"].join(changed, "artifact_id", "left_anti"), segments)
    shown = parts.select("tenant", "source_key", "ordinal", F.substring("content", 1, EXCERPT).alias("excerpt"), "line_start", "line_end", F.col("_whole").alias("source_sha256")).where("excerpt <> ''")
    proof = fresh.select("tenant", "source_key", "_known", "scope_path", "has_episode", "place", F.explode(F.array_distinct("f.segments")).alias("ordinal")).join(shown, ["tenant", "source_key", "ordinal"])
    proof = identified(proof).withColumns({"fact_id": digest("artifact_id", F.lit("fact"), "place"), "segment_id": digest("artifact_id", F.lit("segment"), "ordinal"), "excerpt_hash": F.sha2("excerpt", 256), "extraction_method": F.lit("rule")})
    out["fact_evidence"] = add("fact_evidence", tables["fact_evidence"].join(old_facts, "fact_id", "left_anti"), proof)

    e = F.col("episode")
    dates = date_range(e["start"], e["end"])
    episodes = d.where("episode is not null").select("tenant", "episode_id", e["type"].alias("episode_type"), e["title"].alias("title"), dates["start"].alias("start_at"), dates["end"].alias("end_at"), "severity", e["outcome"].alias("outcome"), e["summary"].alias("summary"), F.col("artifact_id").alias("primary_artifact_id"), "scope_path")
    out["episode"] = add("episode", tables["episode"].join(changed.select(F.col("artifact_id").alias("primary_artifact_id")), "primary_artifact_id", "left_anti"), episodes)
    runs = d.select("tenant", "artifact_id", "run_id", F.lit("deterministic-only").alias("model_name"), F.lit("success").alias("status"), now.alias("started_at"), now.alias("finished_at"))
    out["extraction_run"] = add("extraction_run", tables["extraction_run"].join(changed, "artifact_id", "left_anti"), runs)
    out["artifact"] = add("artifact", tables["artifact"], artifacts)

    reason = F.create_map(*[F.lit(x) for kv in REVIEWS.items() for x in kv])[F.col("source_type")]
    reviews = d.select("tenant", F.lit("artifact").alias("target_type"), F.col("artifact_id").alias("target_id"), reason.alias("reason")).where("reason is not null")
    if large is not None:
        wait = large.select("tenant", "source_key").distinct().join(ids, ["tenant", "source_key"])
        reviews = reviews.unionByName(wait.select("tenant", F.lit("artifact").alias("target_type"), F.col("artifact_id").alias("target_id"), F.lit(TOO_LARGE).alias("reason")))
    asked = new_reviews(tables["review_queue"], reviews).withColumn("review_id", digest("target_type", "target_id", "reason", F.unix_micros(now)))
    out["review_queue"] = add("review_queue", tables["review_queue"], asked)
    return out
