"""Tables of the evidence memory: schemas, tenant-filtered reads, versioned writes.

A missing table reads as an empty DataFrame of its schema, so optional features degrade to empty results.
A table is a folder of data folders and a log of numbered versions. A write creates a data folder, then an entry of the
log, which lists the version's data folders. An entry is written under a name of its own and then renamed to its number, which
fails if the number is taken; so an entry is whole as soon as it can be seen, a reader sees a version as a whole, and of
two writers one loses: an append is tried again, a replacement fails. An entry without its end belongs to a writer at work
while it is younger than ``patience`` seconds; then its writer is taken for dead, and the next version takes a later number.
This holds where a rename to a name that exists fails, as in HDFS; on a local disk up to the moment between look and move. Object stores without such
a rename need one writer for each table. An append adds a folder and leaves the others as they are. Errors in reading
are raised; only a table without a log is empty.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.predicates import both_or_neither, exactly_one, violations


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # type: ignore[return-value]


_META = "tenant string, created_at timestamp, updated_at timestamp"
_EVIDENCE = "fact_id string, segment_id string, memory_id string, episode_id string, excerpt string, weight double, tenant string, created_at timestamp"

#: The tables with their columns, as DDL.
DDL: dict[str, str] = {
    "artifact": f"artifact_id string, source_type string, source_key string, original_path string, sha256 string, size_bytes long, preservation_state string, scope_path string, project_id string, attrs map<string,string>, discovered_at timestamp, {_META}",
    "segment": f"segment_id string, artifact_id string, episode_id string, ordinal int, section_label string, content string, source_sha256 string, source_relpath string, line_start int, line_end int, embedding array<float>, scope_path string, {_META}",
    "extraction_run": f"run_id string, artifact_id string, pipeline_version string, model_name string, prompt_version string, status string, started_at timestamp, finished_at timestamp, {_META}",
    "entity": f"entity_id string, entity_type string, canonical_name string, aliases array<string>, attrs map<string,string>, first_seen_at timestamp, last_seen_at timestamp, {_META}",
    "project_service_map": f"service_name string, project_id string, {_META}",
    "episode": f"episode_id string, episode_type string, title string, start_at timestamp, end_at timestamp, severity string, outcome string, summary string, primary_artifact_id string, scope_path string, project_id string, embedding array<float>, {_META}",
    "event": f"event_id string, episode_id string, event_type string, event_at timestamp, description string, {_META}",
    "fact": f"fact_id string, subject_entity_id string, object_entity_id string, predicate string, object_value string, fact_kind string, assertion_class string, confidence double, current_status string, episode_id string, valid_from timestamp, valid_to timestamp, canonical_fingerprint string, created_run_id string, scope_path string, project_id string, priority int, importance int, embedding array<float>, {_META}",
    "fact_evidence": "fact_id string, segment_id string, excerpt string, extraction_method string, source_sha256 string, source_relpath string, excerpt_hash string, line_start int, line_end int, weight double, created_at timestamp",
    "memory": f"memory_id string, memory_type string, title string, narrative string, lifecycle_state string, fingerprint string, confidence double, support_count int, contradiction_count int, priority int, scope_path string, project_id string, namespace string, governance_status string, source_class string, trust_class string, quality_score double, salience double, strength double, stability double, token_count long, pipeline_version string, model_name string, prompt_version string, embedding array<float>, last_supported_at timestamp, valid_from timestamp, {_META}",
    "memory_support": "memory_id string, fact_id string, episode_id string, support_type string, notes string, tenant string, created_at timestamp",
    "review_queue": f"review_id string, target_type string, target_id string, reason string, status string, reviewed_at timestamp, {_META}",
    "schema_migration": "name string, checksum string, applied_at timestamp",
    "publish_note": f"memory_id string, note_path string, content_hash string, {_META}",
    "eval_run": f"eval_id string, metrics string, results string, {_META}",
    "eval_case": f"case_id string, artifact_id string, gold string, complexity string, device string, {_META}",
    "memory_edge": f"edge_id string, source_type string, source_id string, target_type string, target_id string, edge_type string, edge_fingerprint string, confidence double, assertion_class string, evidence_segment_id string, scope_path string, valid_from timestamp, valid_to timestamp, {_META}",
    "memory_edge_evidence": "edge_id string, fact_id string, segment_id string, memory_id string, created_at timestamp",
    "memory_revision": f"revision_id string, memory_id string, revision_type string, revision_class string, previous_narrative string, new_narrative string, {_META}",
    "memory_revision_support": "revision_id string, fact_id string, memory_id string",
    "event_frame": f"event_frame_id string, frame_fingerprint string, episode_id string, source_fact_id string, event_type string, actor_entity_id string, action string, target_entity_id string, location_entity_id string, object_value string, time_start timestamp, time_end timestamp, outcome string, confidence double, assertion_class string, evidence_segment_id string, scope_path string, frame_json string, {_META}",
    "procedure": f"procedure_id string, title string, summary string, fingerprint string, confidence double, lifecycle_state string, assertion_class string, source_fact_id string, evidence_segment_id string, episode_id string, scope_path string, {_META}",
    "procedure_step": "procedure_id string, step_id string, step_index int, action string, expected_result string, step_json string, confidence double, evidence_segment_id string",
    "reflection_class": "reflection_class string, description string",
    **{name: f"{name}_id string, subject_entity_id string, statement string, assertion_class string, confidence double, fingerprint string, scope_path string, {_META}" for name in ("entity_summary", "belief", "rule")},
    **{f"{name}_evidence": f"{name}_id string, {_EVIDENCE}" for name in ("entity_summary", "belief", "rule", "memory_health")},
    "memory_usage": f"usage_id string, source string, captured_at timestamp, total int, unsupported int, stale int, contradicted int, gaps int, scope_path string, {_META}",
    "memory_health": f"health_id string, health_status string, risk double, scope_path string, captured_at timestamp, {_META}",
    "task_session": f"session_id string, session_key string, agent_name string, task_title string, status string, started_at timestamp, last_seen_at timestamp, ended_at timestamp, scope_path string, expires_at timestamp, closed_at timestamp, session_meta map<string,string>, {_META}",
    "working_memory": f"working_memory_id string, session_id string, working_memory_fingerprint string, memory_kind string, content string, status string, promotion_status string, promotion_reason string, promotion_target_kind string, promotion_marked_at timestamp, source_segment_id string, source_fact_id string, evidence_segment_id string, promotion_target_type string, promotion_target_id string, expires_at timestamp, {_META}",
    "media_artifact": f"media_id string, artifact_id string, media_type string, mime_type string, sha256 string, caption string, scope_path string, media_meta map<string,string>, {_META}",
    "visual_region": f"region_id string, media_id string, region_type string, x_min double, y_min double, x_max double, y_max double, label string, ocr_text string, linked_fact_id string, confidence double, region_meta map<string,string>, {_META}",
    "embedding_index": f"embedding_id string, role string, fact_id string, segment_id string, memory_id string, procedure_id string, media_id string, region_id string, embedding array<float>, source_hash string, {_META}",
    "lifecycle_outbox": f"outbox_id string, event_id string, event_type string, source_service string, idempotency_key string, payload string, status string, attempt_count int, claimed_at timestamp, next_retry_at timestamp, target_kind string, target_id string, evidence_refs array<string>, received_at timestamp, {_META}",
    "lifecycle_target_intelligence": f"target_kind string, target_id string, lifecycle_status string, salience double, strength double, stability double, quality double, support_count int, contradiction_count int, lock_version int, {_META}",
    "lifecycle_cue": f"cue_id string, target_kind string, target_id string, cue_text string, cue_hash string, cue_type string, usefulness double, {_META}",
    "context_recall_audit": f"audit_id string, session_key string, query string, recalled array<string>, omitted array<string>, truncated boolean, {_META}",
    "lifecycle_feedback_event": f"feedback_id string, target_kind string, target_id string, signal string, details string, {_META}",
    "lifecycle_score_audit": f"audit_id string, target_kind string, target_id string, field string, old_value double, new_value double, {_META}",
    "lifecycle_audit_log": f"audit_id string, action string, target_kind string, target_id string, details string, {_META}",
    "memory_lifecycle_outbox": f"outbox_id string, event_id string, event_type string, payload string, status string, attempt_count int, claimed_at timestamp, next_retry_at timestamp, received_at timestamp, {_META}",
    "memory_cue": f"cue_id string, memory_id string, cue_text string, cue_hash string, cue_type string, extraction_method string, confidence double, usefulness_score double, {_META}",
    "memory_context_audit": f"audit_id string, request_id string, memory_ids array<string>, omitted_ids array<string>, mode string, {_META}",
    "memory_feedback_event": f"feedback_id string, memory_id string, signal string, details string, {_META}",
    "memory_quality_audit": f"audit_id string, memory_id string, old_quality double, new_quality double, reason string, {_META}",
    "archive_object": f"object_id string, artifact_id string, archive_path string, sha256 string, size_bytes long, {_META}",
}

#: Tables that only grow.
APPEND_ONLY = frozenset({"context_recall_audit", "lifecycle_feedback_event", "lifecycle_score_audit", "lifecycle_audit_log", "memory_context_audit", "memory_feedback_event", "memory_quality_audit"})

#: The columns that identify a row.
KEYS: dict[str, tuple[str, ...]] = {
    "artifact": ("tenant", "source_key"), "entity": ("tenant", "entity_type", "canonical_name"), "memory": ("tenant", "fingerprint"), "memory_edge": ("tenant", "edge_fingerprint"),
    "event_frame": ("tenant", "frame_fingerprint"), "procedure": ("tenant", "fingerprint"), "procedure_step": ("procedure_id", "step_index"), "task_session": ("tenant", "session_key"),
    "lifecycle_outbox": ("tenant", "idempotency_key"), "lifecycle_target_intelligence": ("tenant", "target_kind", "target_id"), "lifecycle_cue": ("tenant", "target_kind", "target_id", "cue_hash"),
}


def schema(name: str) -> T.StructType:
    return _schema(DDL[name])


def rules(name: str) -> dict[str, Column]:
    """Row constraints of a table, by name."""
    share = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    out: dict[str, dict[str, Column]] = {
        "fact": {"confidence": share("confidence"), "priority": F.col("priority").isNull() | F.col("priority").between(1, 10), "value_or_object": F.col("object_value").isNotNull() | F.col("object_entity_id").isNotNull()},
        "memory": {"confidence": share("confidence"), "priority": F.col("priority").isNull() | F.col("priority").between(1, 10)},
        "memory_edge": {"confidence": share("confidence"), "no_loop": ~((F.col("source_type") == F.col("target_type")) & (F.col("source_id") == F.col("target_id")))},
        "memory_edge_evidence": {"has_evidence": F.coalesce("fact_id", "segment_id", "memory_id").isNotNull()},
        "event_frame": {"ordered": F.col("time_end").isNull() | (F.col("time_end") >= F.col("time_start"))},
        "procedure": {"has_evidence": F.coalesce("source_fact_id", "evidence_segment_id", "episode_id").isNotNull()},
        "procedure_step": {"index": F.col("step_index") > 0},
        "belief": {"not_deterministic": F.col("assertion_class") != "deterministic"},
        "visual_region": {"box": (F.col("x_min") >= 0) & (F.col("y_min") >= 0) & (F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min"))},
        "embedding_index": {"one_target": exactly_one("fact_id", "segment_id", "memory_id", "procedure_id", "media_id", "region_id"), "dimension": F.size("embedding") == 384},
        "working_memory": {"target_pair": both_or_neither("promotion_target_type", "promotion_target_id"), "promoted": (F.col("status") != "promoted") | (F.col("promotion_target_id").isNotNull() & F.col("evidence_segment_id").isNotNull())},
        "lifecycle_outbox": {"target_pair": both_or_neither("target_kind", "target_id")},
    }
    return out.get(name, {})


class Catalog:
    """Tables below ``root``; registered DataFrames (``tables``) take precedence, for tests and views."""

    def __init__(self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame] | None = None, patience: float = 600):
        self.spark, self.root, self.tables, self.patience = spark, root.rstrip("/") if root else None, dict(tables or {}), patience

    def _log(self, name: str):
        """The file system and the folder of the table's log."""
        jvm = self.spark._jvm  # type: ignore[attr-defined]
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_log")
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), folder  # type: ignore[attr-defined]

    def _entries(self, name: str) -> list[int]:
        fs, folder = self._log(name)
        if not fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())

    def version(self, name: str) -> tuple[int, list[str]]:
        """The number of the table's version, 0 for none, and its data folders."""
        _, folder = self._log(name)
        for number in reversed(self._entries(name)):
            text = self.spark.read.text(f"{folder.toString()}/{number:020d}", wholetext=True).first()
            if text and text[0].endswith("\n"):  # else its writer died
                return number, json.loads(text[0])
        return 0, []

    def _commit(self, name: str, after: int, folders: list[str]) -> bool:
        """Add the log's entry that follows version ``after``; False if there is a newer version by now, or a writer at work.

        The entry takes the number after the last one, finished or not. Of two writers with one number only one can
        rename its file to it; the other then finds a newer version.
        """
        fs, folder = self._log(name)
        fs.mkdirs(folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path  # type: ignore[attr-defined]
        open_ = [n for n in self._entries(name) if n > after]
        age = lambda n: time.time() - fs.getFileStatus(path(folder, f"{n:020d}")).getModificationTime() / 1000
        if self.version(name)[0] != after or any(age(n) < self.patience for n in open_):
            return False
        number = max([after, *open_]) + 1
        temp, entry = path(folder, f"_{uuid.uuid4().hex}"), path(folder, f"{number:020d}")
        out = fs.create(temp, False)
        out.write(bytearray((json.dumps(folders) + "\n").encode()))
        out.close()
        taken = fs.exists(entry)
        if not taken:
            files = self.spark._jvm.org.apache.hadoop.fs  # type: ignore[attr-defined]
            rename = getattr(files, "Options$Rename")
            never = self.spark.sparkContext._gateway.new_array(rename, 1)  # type: ignore[union-attr]
            never[0] = rename.NONE
            try:  # fails where the number is taken, unlike FileSystem.rename
                files.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(temp, entry, never)
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception):
                    raise
                taken = True
        if taken:
            fs.delete(temp, False)
        return not taken

    def read(self, name: str, tenant: str | None = None) -> DataFrame:
        df = self.tables.get(name)
        if df is None and self.root and (folders := self.version(name)[1]):
            df = self.spark.read.schema(schema(name)).parquet(*[f"{self.root}/{name}/{f}" for f in folders])
        if df is None:
            df = self.spark.createDataFrame([], schema(name))
        else:  # columns that a writer left out read as null
            df = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name).fields])
        return df.where(F.col("tenant") == tenant) if tenant is not None and "tenant" in df.columns else df

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def replace(self, name: str, df: DataFrame) -> None:
        """Make ``df`` the table's next version; fails if the table changes meanwhile."""
        if name in APPEND_ONLY:
            raise ValueError(f"{name} only grows; use append")
        if not self.root:
            self.tables[name] = df
            return
        number, _ = self.version(name)
        if not self._commit(name, number, [self._write(name, df.select(*schema(name).names))]):
            raise RuntimeError(f"{name} was changed meanwhile; read it again")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add ``rows``; what is there is not written again."""
        empty = self.spark.createDataFrame([], schema(name))
        new = empty.unionByName(rows.select(*[c for c in rows.columns if c in empty.columns]), allowMissingColumns=True)
        if not self.root:
            self.tables[name] = self.read(name).unionByName(new)
            return
        folder, last = self._write(name, new), time.time() + 2 * self.patience + 60
        while True:
            number, folders = self.version(name)
            if self._commit(name, number, [*folders, folder]):
                return
            if time.time() > last:
                raise RuntimeError(f"other writers kept {name} from taking an entry after {number}")
            time.sleep(0.2)

    def check(self, name: str) -> DataFrame:
        """Rows of a table that break its rules, with the names of the rules."""
        return self.read(name).withColumn("broken", violations(rules(name))).where(F.size("broken") > 0)

    def missing(self, names: list[str]) -> list[str]:
        return [n for n in names if n not in DDL]
