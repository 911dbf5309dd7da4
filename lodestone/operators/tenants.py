"""Tenants of rows that were written without one: inference along references, repair of shared rows, and clones.

Nodes are (kind, id); a reference leads from a referring to a referred-to node. A referred-to node is needed by its own
tenant and by every tenant that a referrer belongs to. The set of (node, tenant) pairs grows along the references until
nothing is new; a round joins only the pairs of the last one, written to the shared folder. A node that must have exactly one
tenant and has none or several is ambiguous, which is an error and not a guess.

A shared row becomes one row for each tenant that needs it. Its own tenant keeps the id; another gets the row it has already
under the same natural key, or else a new row whose id follows from tenant and old id, so that a second run finds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking
from .written import written

#: Attributes that tell of the life of a project in its own tenant and do not go to another. Fixed values.
LIFE = ("status", "archived_at", "archive_reason", "forked_from", "forked_at", "merged_into", "merged_at")


class AmbiguousTenant(ValueError):
    """Rows whose tenant cannot be told."""


def infer(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """(kind, id, tenant): all tenants that need a node, from nodes (kind, id, tenant or null) and references (from_kind, from_id, kind, id)."""
    known = written(nodes.where("tenant is not null").select("kind", "id", "tenant").distinct())
    refs = written(references.where("from_id is not null and id is not null").select("from_kind", "from_id", "kind", "id").distinct())
    front = known
    while not front.isEmpty():
        reached = refs.join(front.toDF("from_kind", "from_id", "tenant"), ["from_kind", "from_id"]).select("kind", "id", "tenant").distinct()
        front = written(reached.join(known, ["kind", "id", "tenant"], "left_anti"))
        known = known.unionByName(front)
    return known


def ambiguous(nodes: DataFrame, inferred: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(kind, id, n): nodes of ``kinds`` that do not have exactly one tenant."""
    some = inferred.groupBy("kind", "id").agg(F.count("*").alias("n"))
    d = nodes.where(F.col("kind").isin(*kinds)).select("kind", "id").distinct().join(some, ["kind", "id"], "left")
    return d.withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def assign(nodes: DataFrame, references: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(kind, id, tenant) of the nodes of ``kinds``, each with its one tenant; raises where there is none or more than one."""
    found = written(infer(nodes, references))
    bad = ambiguous(nodes, found, kinds)
    n = bad.count()
    if n:
        first = bad.orderBy("kind", "id").first()
        raise AmbiguousTenant(f"{n} rows have no single tenant, such as {first['kind']} {first['id']} with {first['n']}")
    return found.where(F.col("kind").isin(*kinds)).join(nodes.select("kind", "id").distinct(), ["kind", "id"])


def new_id(tenant: Column, old: Column) -> Column:
    """A UUID-like id that follows from the tenant and the old id."""
    d = F.md5(F.concat_ws("|", tenant, old.cast("string")))
    return F.concat_ws("-", *[F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def split(table: DataFrame, wanted: DataFrame, key: str, natural: Sequence[str], drop_attributes: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(new rows, id map): the rows that other tenants lack, and (old_id, tenant, new_id) for all wanted pairs.

    ``wanted`` has (id, tenant). A row of the wanted tenant with the same natural key is used instead of a new one; of several
    that would be new under one key, the smallest old id stands for all. ``drop_attributes`` go from the map column ``attrs``.
    """
    src = table.select(F.col(key).alias("old_id"), F.col("tenant").alias("_own"), *natural)
    w = wanted.select(F.col("id").alias("old_id"), "tenant").distinct().join(src, "old_id")
    keys = ["tenant", *natural]

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        """A left join on tenant and natural key, nulls equal."""
        r = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
        return left.join(r, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys], "left").drop(*[f"_r_{c}" for c in keys])

    there = ranking.first_per_key(table.select(*keys, F.col(key).cast("string").alias("_there")), keys, [F.asc("_there")])
    met = meet(w, there)
    fresh = met.where("_there is null and tenant <> _own").groupBy(*keys).agg(F.min("old_id").alias("_from"))
    fresh = fresh.withColumn("_new", new_id(F.col("tenant"), F.col("_from")))
    own = F.when(F.col("tenant") == F.col("_own"), F.col("old_id").cast("string"))
    ids = meet(met, fresh.drop("_from")).select("old_id", "tenant", F.coalesce(own, "_there", "_new").alias("new_id"))
    rows = fresh.select(F.col("_from").alias(key), F.col("tenant").alias("_t"), "_new").join(table, key)
    if drop_attributes:
        rows = rows.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.isin(*drop_attributes)))
    rows = rows.select(*[F.col("_new").cast(table.schema[c].dataType).alias(c) if c == key else F.col("_t").alias(c) if c == "tenant" else F.col(c) for c in table.columns])
    return rows, ids


def remap(rows: DataFrame, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` whose references lead to the row of their own tenant; references that need no change stay."""
    out = rows
    for c in columns:
        m = ids.select(F.col("old_id").alias(c), "tenant", F.col("new_id").cast(rows.schema[c].dataType).alias("_new"))
        out = out.join(m, [c, "tenant"], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(*rows.columns)


def clone(entities: DataFrame, mappings: DataFrame, tenant: str, source: str = "default", kind: str = "project", reference: str = "project_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new entities, newer sightings, new mappings) that bring the defaults of ``source`` to ``tenant``.

    Entities are matched by type and name; those that are there only take the later sighting. Mappings lead to the tenant's own
    entities. A second run gives no new row, and for the source itself nothing is done.
    """
    base = entities.where((F.col("tenant") == source) & (F.col("entity_type") == kind) & (F.lit(tenant) != F.lit(source)))
    wanted = base.select(F.col("entity_id").alias("id"), F.lit(tenant).alias("tenant"))
    rows, ids = split(entities, wanted, "entity_id", ["entity_type", "canonical_name"], LIFE)
    seen = ids.join(base.select(F.col("entity_id").alias("old_id"), F.col("last_seen_at").alias("_seen")), "old_id").groupBy(F.col("new_id").alias("entity_id")).agg(F.max("_seen").alias("last_seen_at"))
    own = entities.where(F.col("tenant") == tenant).select("entity_id", F.col("last_seen_at").alias("_own"))
    newer = seen.join(own, "entity_id").where(F.col("_own").isNull() | (F.col("last_seen_at") > F.col("_own"))).select("entity_id", "last_seen_at")
    led = mappings.join(ids.select(F.col("old_id").alias(reference), F.col("new_id").alias("_new")), reference)
    led = led.withColumn(reference, F.col("_new").cast(mappings.schema[reference].dataType)).drop("_new").withColumn("tenant", F.lit(tenant)).select(*mappings.columns)
    return rows, newer, led.dropDuplicates([reference, "service_name"]).join(mappings.select(reference, "service_name"), [reference, "service_name"], "left_anti").select(*mappings.columns)
