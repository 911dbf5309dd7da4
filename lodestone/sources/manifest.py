"""Archive manifests: the files below a folder with size and SHA-256, one digest over all, and checks against them.

Files are read whole by the ``binaryFile`` source, a file in a row, so no file may exceed two gigabytes. The digest is a tree:
names are dealt to ``FANOUT`` groups by their hash, each group's sorted lines are hashed, then the groups' digests in
order. Only the last step sees all groups, as ``FANOUT`` short rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 4096


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, size, sha256) of the files below a folder; names are relative to it."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    below = F.regexp_replace("path", r"^.*?" + _quoted(folder), "")
    return d.select(F.regexp_replace(below, "^/+", "").alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _quoted(folder: str) -> str:
    """The folder's path without scheme, as a literal pattern."""
    path = folder.split("://", 1)[-1] if "://" in folder else folder.split(":", 1)[-1] if folder.startswith("file:") else folder
    return "\\Q" + path.rstrip("/") + "\\E"


def line() -> Column:
    return F.concat_ws("  ", "sha256", F.col("size").cast("string"), "name")


def digest(manifest: DataFrame) -> DataFrame:
    """One row (files, bytes, digest) for a manifest, whatever the order of its rows; files of one name are an error."""
    group = F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(FANOUT)).cast("int")
    named = manifest.groupBy("name").agg(F.count("*").alias("_n"), F.min("size").alias("size"), F.min("sha256").alias("sha256"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two files are named "), "name")).cast("string")).otherwise(line())
    lines = named.select(group.alias("g"), "size", F.struct("name", once.alias("l")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n")
    groups = lines.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sha2(text, 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: F.concat_ws(" ", x["g"].cast("string"), x["d"])), "\n")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(whole, 256).alias("digest"))


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem): files that are missing, changed, or not in the manifest."""
    m = manifest.select("name", F.col("sha256").alias("_want"), F.col("size").alias("_size"))
    d = m.join(found.select("name", "sha256", "size"), "name", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when((F.col("sha256") != F.col("_want")) | (F.col("size") != F.col("_size")), "changed")
    return d.select("name", problem.alias("problem")).where("problem is not null")


def missing_artifacts(artifacts: DataFrame, archive: DataFrame) -> DataFrame:
    """Artifacts whose archived copy is not where it should be: (artifact_id, archive_path, reason).

    artifacts: (artifact_id, sha256); archive: (artifact_id, archive_path, sha256), from the archive's own listing.
    """
    d = artifacts.select("artifact_id", F.col("sha256").alias("_want")).join(archive.select("artifact_id", "archive_path", "sha256"), "artifact_id", "left")
    reason = F.when(F.col("archive_path").isNull(), "not archived").when(F.col("sha256").isNull(), "no digest").when(F.lower("sha256") != F.lower("_want"), "digest differs")
    return d.select("artifact_id", "archive_path", reason.alias("reason")).where("reason is not null")
