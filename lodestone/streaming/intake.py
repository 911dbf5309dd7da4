"""Intake of feeds that repeat themselves: messages and alerts are taken once, with a bounded memory per source.

A feed is polled from an offset and may send rows again, in any order. Per source the state holds the ids taken last, at most
``keep``, and a mark: ids up to the mark count as taken. When the ids outgrow ``keep``, the smallest leave and the greatest of
them becomes the mark. So a row is never taken twice, and none is lost as long as it comes before ``keep`` greater
ids of its source. ``shards`` deals the ids of a source to several states, each with its own mark, so that one busy source
is not one task; the guarantee then holds within each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..sources.readers import FACTS

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP = 1000


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; a store that the session names itself is left alone if it is that one."""
    if spark.conf.get(PROVIDER) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


class _Recent(StatefulProcessor):
    def __init__(self, id_column: str, keep: int, columns: list[str]):
        self.id_column, self.keep, self.columns = id_column, keep, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "mark long, ids array<long>")

    def handleInputRows(self, key: object, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.recent.get()
        mark, ids = (held[0], list(held[1])) if held else (None, [])
        seen = set(ids)
        for chunk in rows:
            found = chunk[self.id_column]
            fresh = ~found.duplicated() & ~found.isin(seen)
            if mark is not None:
                fresh &= found > mark
            seen.update(int(x) for x in found[fresh])
            yield chunk.loc[fresh, self.columns]
        ids = sorted(seen)
        if len(ids) > self.keep:
            mark, ids = ids[-self.keep - 1], ids[-self.keep :]
        self.recent.update((mark, ids))

    def close(self) -> None:
        pass


def once_per_source(stream: DataFrame, source: list[str], id_column: str, keep: int = KEEP, shards: int = 1) -> DataFrame:
    """The rows of a stream whose id (a long, greater for later rows) was not taken before; rows without id are left out."""
    keyed_state(stream.sparkSession)
    d = stream.where(F.col(id_column).isNotNull()).withColumn("_shard", F.pmod(F.xxhash64(id_column), F.lit(shards)).cast("int"))
    out = T.StructType(stream.schema.fields)
    return d.groupBy(*source, "_shard").transformWithStateInPandas(_Recent(id_column, keep, stream.columns), outputStructType=out, outputMode="append", timeMode="none")


def offsets(taken: DataFrame, source: list[str], id_column: str) -> DataFrame:
    """Where each source is polled from next: one past the greatest id, own messages included."""
    return taken.groupBy(*source).agg((F.max(id_column) + 1).alias("next_offset"), F.count("*").alias("taken"))


# ------------------------------------------------------------------ messenger updates

_PERSON = "struct<id:long,is_bot:boolean,first_name:string,last_name:string>"
_MESSAGE = f"struct<message_id:long,`from`:{_PERSON},chat:struct<id:long,type:string>,date:long,text:string,reply_to_message:struct<message_id:long>>"
UPDATE = f"update_id long, message {_MESSAGE}, edited_message {_MESSAGE}"


def messenger_updates(lines: DataFrame, value: str = "value") -> DataFrame:
    """Update lines (JSON) as history rows; lines that are no update have no update_id and go."""
    d = lines.select(F.from_json(value, UPDATE).alias("u")).where("u.update_id is not null")
    d = d.select("u.update_id", F.coalesce("u.message", "u.edited_message").alias("m")).where("m is not null")
    person = F.concat_ws(" ", F.nullif(F.col("m.from.first_name"), F.lit("")), F.nullif(F.col("m.from.last_name"), F.lit("")))
    return d.select(
        F.col("m.message_id").alias("message_id"), "update_id", F.when(person == "", "Unknown").otherwise(person).alias("from_user"), F.coalesce("m.from.id", F.lit(0)).alias("from_id"), F.coalesce("m.from.is_bot", F.lit(False)).alias("is_bot"),
        F.col("m.chat.id").alias("chat_id"), F.col("m.chat.type").alias("chat_type"), F.timestamp_seconds("m.date").alias("sent_at"), F.coalesce("m.text", F.lit("")).alias("text"), F.col("m.reply_to_message.message_id").alias("reply_to"),
    )


def messages(history: DataFrame, devices: list[str] = [], services: list[str] = []) -> DataFrame:  # noqa: B006
    """Messages with something to say, as records with facts: what was stated (the first 1,000 characters) and what was mentioned.

    The body is the first 2,000 characters, as in the feed's own history.
    """
    d = history.where(~F.col("is_bot") & X.substantial("text"))
    user = F.regexp_replace(F.lower("from_user"), r"\s+", "_")
    row = lambda predicate, value, sure: F.struct(user.alias("subject"), F.lit(predicate).alias("predicate"), value.alias("value"), F.lit("state").alias("kind"), F.lit(sure).alias("confidence"))
    named = lambda predicate, names: F.transform(X.token_boundary_search("text", names), lambda x: row(predicate, x, 0.9)) if names else F.array().cast(FACTS)
    found = F.concat(F.array(row("stated", F.substring("text", 1, 1000), 1.0)), named("mentioned_device", devices), named("mentioned_service", services))
    label: Column = F.concat(F.col("from_user"), F.lit(" @ "), F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return d.select(F.lit("messenger").alias("source_type"), F.concat_ws(":", F.lit("messenger"), "chat_id", "message_id").alias("source_key"), label.alias("title"), F.substring("text", 1, 2000).alias("body"), found.cast(FACTS).alias("facts"), F.col("sent_at").alias("ts"))


# ------------------------------------------------------------------ alert annotations

ANNOTATION = "id long, alertName string, dashboardUID string, panelId long, time long, timeEnd long, tags array<string>, text string, newState string, prevState string"


def alert_rule(text: Column | str) -> Column:
    """The rule's title: what stands before the labels in braces."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(c, r"(?s)\{.*", ""))


def annotations(lines: DataFrame, value: str = "value") -> DataFrame:
    """Annotation lines (JSON) as rows for ``readers.alerts``: labels from the text in braces and from ``key=value`` tags, the text's first."""
    from ..sources.readers import label_map

    d = lines.select(F.from_json(value, ANNOTATION).alias("a")).where("a.id is not null").select("a.*")
    braces = F.regexp_extract(F.coalesce("text", F.lit("")), r"\{([^}]+)\}", 0)
    own = label_map(braces)
    tagged = label_map(F.concat(F.lit("{"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("}")))
    labels = F.map_concat(F.map_filter(tagged, lambda k, v: ~F.map_contains_key(own, k)), own)
    name = F.coalesce(F.nullif(F.col("alertName"), F.lit("")), F.try_element_at(labels, F.lit("alertname")), F.nullif(alert_rule(F.coalesce("text", F.lit(""))), F.lit("")), F.concat(F.lit("alert:"), "id"))
    return d.select("id", name.alias("name"), "time", "text", F.col("newState").alias("new_state"), labels.alias("labels"), F.coalesce("dashboardUID", F.lit("")).alias("dashboard"))
