"""Table changes as DataFrame rewrites: the next version of a table from the current one and a batch of rows.

Every function is a single keyed join or aggregate; none loops over rows. Callers write the result as a new
version (``catalog.Catalog.replace``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, keys: Sequence[str], among: Sequence[str] | None = None) -> DataFrame:
    """One row of each key, the same at every call: the one whose other columns (or ``among``) have the least digest.

    ``dropDuplicates`` takes whichever row comes first, another one each time it is computed.
    """
    others = [c for c in (among or rows.columns) if c not in keys]
    text = [F.to_json(F.struct(F.col(c))) for c in others]
    mark = F.sha2(F.concat_ws("\x1f", *text), 256) if others else F.lit("")
    w = Window.partitionBy(*keys).orderBy("_mark")
    return rows.withColumn("_mark", mark).withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_mark", "_place")


def unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``one_per_key`` for rows whose keys hardly ever repeat: the keys alone are counted first, and where none repeats the rows stay where they are."""
    return one_per_key(rows, keys) if rows.groupBy(*keys).count().where("count > 1").limit(1).count() else rows


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``rows`` whose key is not in ``table``, one for each key."""
    return one_per_key(rows, keys).join(table.select(*keys), list(keys), "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], rules: dict[str, str] | None = None) -> DataFrame:
    """The merged table with ``inserted`` and ``touched`` flags.

    Rules by column: ``new`` (default; null keeps the old value), ``greatest``, ``least``, ``sum``, ``keep``, ``merge`` (maps, new keys win).
    """
    rules = rules or {}
    old = table.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in table.columns if c not in keys], F.lit(True).alias("_old"))
    new = rows.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in table.columns if c not in keys and c in rows.columns], F.lit(True).alias("_new"))
    both = old.join(new, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"_o_{c}").alias(c)
        o, n = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        rule = rules.get(c, "new")
        if rule == "greatest":
            out = F.greatest(o, n)
        elif rule == "least":
            out = F.least(o, n)
        elif rule == "sum":
            out = F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0))
        elif rule == "keep":
            out = F.coalesce(o, n)
        elif rule == "merge":
            kept = F.map_filter(F.coalesce(o, F.create_map().cast(table.schema[c].dataType)), lambda k, v: ~F.coalesce(F.map_contains_key(n, k), F.lit(False)))
            out = F.when(n.isNull(), o).otherwise(F.map_concat(kept, n))
        else:
            out = F.coalesce(n, o)
        return out.alias(c)

    flags = [(F.col("_old").isNull()).alias("inserted"), F.col("_new").isNotNull().alias("touched")]
    return both.select(*keys, *[value(c) for c in table.columns if c not in keys], *flags)


def update_where(table: DataFrame, guard: Column, values: dict[str, Column]) -> DataFrame:
    """The rewritten table with ``touched``, true for the rows that the guard let change."""
    hit = F.coalesce(guard, F.lit(False))
    kept = [F.when(F.col("touched"), values[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns]
    return table.withColumn("touched", hit).select(*kept, "touched")


def update_from(table: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: values of the one source row of each key; duplicates of a key take the smallest value."""
    src = source.groupBy(*keys).agg(*[F.min(c).alias(f"_n_{c}") for c in values])
    out = table.join(src, list(keys), "left")
    return out.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in values else F.col(c) for c in table.columns])


def delete_first(table: DataFrame, guard: Column, order: Sequence[Column], limit: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(rest, deleted): at most ``limit`` guarded rows in a total order are taken out."""
    gone = table.where(guard).orderBy(*order).limit(limit)
    return table.join(gone.select(key), key, "left_anti"), gone


def rebase_prefix(path: Column, old: str, new: str) -> Column:
    """A literal prefix replaced, other paths unchanged."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
