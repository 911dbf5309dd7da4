"""The catalog's log behind dead writers, and one row of each key wherever it is computed."""

import pytest
from pyspark.sql import functions as F

from lodestone import catalog as cat
from lodestone.operators import merge


def rows(spark, *ids):
    return spark.createDataFrame([(i, "default") for i in ids], "entity_id string, tenant string")


def test_stranded_entries_do_not_block(spark, tmp_path):
    c = cat.Catalog(spark, str(tmp_path), patience=0)
    c.append("entity", rows(spark, "1"))
    log = tmp_path / "entity" / "_log"
    (log / f"{2:020d}").write_text("")
    (log / f"{3:020d}").write_text('["half')
    assert c.version("entity")[0] == 1
    c.append("entity", rows(spark, "2"))
    assert c.version("entity")[0] == 4 and sorted(r.entity_id for r in c.read("entity").collect()) == ["1", "2"]
    c.replace("entity", c.read("entity").where("entity_id = '2'").select("entity_id", "tenant", *[F.lit(None).cast(f.dataType).alias(f.name) for f in cat.schema("entity").fields if f.name not in ("entity_id", "tenant")]))
    assert [r.entity_id for r in c.read("entity").collect()] == ["2"] and not [f for f in log.iterdir() if f.name.startswith("_")]


def test_a_writer_at_work_is_waited_for(spark, tmp_path):
    c = cat.Catalog(spark, str(tmp_path), patience=3)
    c.append("entity", rows(spark, "1"))
    (tmp_path / "entity" / "_log" / f"{2:020d}").write_text("")
    with pytest.raises(RuntimeError):
        c.replace("entity", c.read("entity"))
    c.append("entity", rows(spark, "2"))  # after three seconds
    assert c.version("entity")[0] == 3


def test_two_writers_of_one_number(spark, tmp_path):
    c, d = cat.Catalog(spark, str(tmp_path)), cat.Catalog(spark, str(tmp_path))
    c.append("entity", rows(spark, "1"))
    folder = d._write("entity", c.read("entity"))
    c.append("entity", rows(spark, "2"))
    assert not d._commit("entity", 1, [folder]) and c.version("entity")[0] == 2


def test_one_per_key_is_the_same_everywhere(spark):
    d = spark.range(200).select((F.col("id") % 7).alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), F.array("id").alias("a"))
    one = lambda n: sorted(map(tuple, merge.one_per_key(d.repartition(n), ["k"]).collect()))
    assert one(1) == one(5) == one(8) and len(one(2)) == 7
    assert merge.one_per_key(d.select("k"), ["k"]).count() == 7
