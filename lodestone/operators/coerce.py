"""Results of language models as facts: lenient reading, repair of known quirks, and a reason for whatever is wrong.

A result is text that should be a JSON object with ``facts``, ``lessons`` and ``questions``. Fences round it are taken off; it is
read as a variant, so that any shape can be looked at. Unknown kinds of facts are mapped, lists of values joined; these
repairs are warnings. Every field is then held against its type and range; one error makes the whole result invalid,
as nothing of it can be trusted, but all errors are told.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of facts, what other words for them mean, and states of a fact. Fixed values.
KINDS = ("state", "cause", "impact", "decision", "remediation", "lesson", "constraint", "config_change", "event")
OTHER_KINDS = {
    "verification": "state", "requirement": "constraint", "dependency": "constraint", "observation": "state", "action": "remediation", "fix": "remediation",
    "prevention": "remediation", "context": "state", "symptom": "impact", "trigger": "cause", "workaround": "remediation", "recommendation": "lesson",
}
STATES, SURE = ("confirmed", "hypothesis"), 0.8
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)$"


def unfenced(text: Column) -> Column:
    """The text within a Markdown fence, or the text itself, trimmed."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\n?", ""), r"\n?```$", "")).otherwise(t)


def _type(v: Column) -> Column:
    """The type of a variant, null where there is none; a JSON null is VOID."""
    return F.schema_of_variant(v)


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _told(checks: list[tuple[str, Column]], path: Column) -> Column:
    """The names of the fields that fail, with the first reason of each: ``path.field: reason``."""
    return F.array_compact(F.array(*[F.when(reason.isNotNull(), F.concat(path, F.lit(f"{field}: "), reason)) for field, reason in checks]))


def _string(v: Column, name: str) -> Column:
    t = _type(_field(v, name))
    return F.when(t.isNull(), "missing").when(t != "STRING", "no string").when(_text(v, name) == "", "empty")


def _share(v: Column, name: str) -> Column:
    t, x = _type(_field(v, name)), F.try_variant_get(v, f"$.{name}", "double")
    return F.when(t.isNull(), "missing").when(~t.rlike(_NUMBER), "no number").when(x < 0, "below 0").when(x > 1, "above 1")


def _strings(v: Column, name: str, least: int) -> Column:
    f = _field(v, name)
    t, items = _type(f), _list(f)
    return F.when(t.isNull(), "missing").when(~t.startswith("ARRAY"), "no list").when(F.size(items) < least, "empty").when(F.exists(items, lambda x: ~F.coalesce(_type(x) == "STRING", F.lit(False))), "holds no strings")


def _value(v: Column) -> Column:
    """The value as text: lists joined, objects as JSON; null stays null."""
    f = _field(v, "object_value")
    t, items = _type(f), _list(f)
    joined = F.array_join(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null"))), ", ")
    return F.when(t.startswith("ARRAY"), joined).when(t.startswith("OBJECT"), F.to_json(f)).when(t == "VOID", None).otherwise(F.try_variant_get(v, "$.object_value", "string"))


def _pieces(doc: Column, name: str) -> Column:
    return F.coalesce(_list(_field(doc, name)), F.array().cast("array<variant>"))


def read(results: DataFrame, key: str = "result_id", raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(documents, facts).

    documents: key, valid, errors, warnings, n_facts. facts, of all results that could be read: key, i (from 0), subject,
    predicate, value, kind, confidence, status, segment_ids, errors, valid (that of the document).
    """
    d = results.select(key, F.try_parse_json(unfenced(F.coalesce(F.col(raw), F.lit("")))).alias("doc"))
    listed = _type(_field(F.col("doc"), "facts"))
    top = F.when(F.col("doc").isNull(), F.lit("JSON parse error")).when(listed.isNull(), "facts: missing").when(~listed.startswith("ARRAY"), "facts: no list")
    d = d.withColumn("top", F.array_compact(F.array(top)))

    f = d.select(key, F.posexplode(_pieces(F.col("doc"), "facts")).alias("i", "f"))
    v, path = F.col("f"), F.concat(F.lit("facts."), F.col("i"), F.lit("."))
    kind, kind_type = _text(v, "fact_kind"), _type(_field(v, "fact_kind"))
    meant = reduce(lambda c, x: F.when(F.lower(kind) == x[0], x[1]).otherwise(c), OTHER_KINDS.items(), F.lit(None).cast("string"))
    odd = (kind_type == "STRING") & (kind != "") & ~kind.isin(*KINDS)
    repaired = F.when(odd, F.coalesce(meant, F.lit("state"))).otherwise(kind)
    warned = F.when(odd & meant.isNotNull(), F.concat(F.lit('Coerced fact_kind "'), kind, F.lit('" -> "'), meant, F.lit('"'))).when(odd, F.concat(F.lit('Unknown fact_kind "'), kind, F.lit('" -> "state"')))
    status_type, status = _type(_field(v, "status")), _text(v, "status")
    checks = [
        ("subject", _string(v, "subject")),
        ("predicate", _string(v, "predicate")),
        ("object_value", F.when(_type(_field(v, "object_value")).isNull(), "missing")),
        ("fact_kind", F.when(kind_type.isNull(), "missing").when((kind_type != "STRING") | ~repaired.isin(*KINDS), "no known kind")),
        ("confidence", _share(v, "confidence")),
        ("segment_ids", _strings(v, "segment_ids", 1)),
        ("status", F.when(status_type.isNotNull() & ((status_type != "STRING") | ~status.isin(*STATES)), "no known status")),
    ]
    whole = F.coalesce(_type(v).startswith("OBJECT"), F.lit(False))
    errors = F.when(whole, _told(checks, path)).otherwise(F.array(F.concat(F.lit("facts."), F.col("i"), F.lit(": no object"))))
    f = f.select(
        key, "i", _text(v, "subject").alias("subject"), _text(v, "predicate").alias("predicate"), _value(v).alias("value"), repaired.alias("kind"), F.try_variant_get(v, "$.confidence", "double").alias("confidence"),
        F.coalesce(status, F.lit("confirmed")).alias("status"), F.transform(_list(_field(v, "segment_ids")), lambda x: F.try_variant_get(x, "$", "string")).alias("segment_ids"), errors.alias("errors"), F.when(whole, warned).alias("warning"),
    )

    def side(name: str, text: str, least: int, scored: bool) -> DataFrame:
        x = d.select(key, F.posexplode(_pieces(F.col("doc"), name)).alias("i", "f"))
        c = [(text, _string(F.col("f"), text)), *([("confidence", _share(F.col("f"), "confidence"))] if scored else []), ("segment_ids", _strings(F.col("f"), "segment_ids", least))]
        return x.select(key, F.lit(name).alias("part"), "i", _told(c, F.concat(F.lit(f"{name}."), F.col("i"), F.lit("."))).alias("errors"))

    def no_list(name: str) -> Column:
        t = _type(_field(F.col("doc"), name))
        return F.when(F.col("doc").isNotNull() & t.isNotNull() & ~t.startswith("ARRAY"), F.lit(f"{name}: no list"))

    pieces = f.select(key, F.lit("facts").alias("part"), "i", "errors").unionByName(side("lessons", "description", 1, True)).unionByName(side("questions", "text", 0, False))
    told = pieces.where(F.size("errors") > 0).groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "i", "errors"))), lambda x: x["errors"])).alias("found"))
    warnings = f.where("warning is not null").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "warning"))), lambda x: x["warning"]).alias("coerced"))
    n = f.groupBy(key).agg(F.count("*").alias("n_facts"))
    none = F.array().cast("array<string>")
    d = d.withColumn("top", F.concat("top", F.array_compact(F.array(no_list("lessons"), no_list("questions"))))).select(key, "top")
    d = d.join(told, key, "left").join(warnings, key, "left").join(n, key, "left").join(disagreements(f, key), key, "left")
    errors = F.concat("top", F.coalesce("found", none))
    valid = F.size(errors) == 0
    documents = d.select(key, valid.alias("valid"), errors.alias("errors"), F.concat(F.coalesce("coerced", none), F.when(valid, F.coalesce("disagree", none)).otherwise(none)).alias("warnings"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))
    return documents, f.drop("warning").join(documents.select(key, "valid"), key)


def disagreements(facts: DataFrame, key: str) -> DataFrame:
    """(key, disagree): subjects and predicates of states with several values in one result, more than one of them sure."""
    same = facts.where("kind = 'state'").groupBy(key, "subject", "predicate").agg(F.count_distinct(F.coalesce("value", F.lit("null"))).alias("n"), F.count_if(F.col("confidence") >= SURE).alias("sure"))
    text = F.concat(F.lit("Contradiction: "), "subject", F.lit("::"), "predicate", F.lit(" has "), F.col("n").cast("string"), F.lit(" different values at high confidence"))
    return same.where("n > 1 and sure > 1").groupBy(key).agg(F.array_sort(F.collect_list(text)).alias("disagree"))
