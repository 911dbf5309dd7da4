"""Memory snapshots: the text that an agent's session starts with, for many requests at once.

A request (request_id, cwd, git_root, prompt, profile, max_tokens, mode) is resolved to domains, a scope, cues and a token
budget. Its candidates are memories in scope that a search matched; a request whose package stays empty falls back to the
best memories of its scope. Candidates are packed into four times the budget, a profile then chooses its cards: those that
guard safety first, with caps on cards and on the number and tokens of fallback cards. Cards are rendered as sections, and
the text is cut until it fits the budget together with the notice of the cut.

All folds run over arrays of at most ``LIMIT`` items, a request's candidates. The scope fallback meets memories by the
prefixes of their scope, so no pair of request and memory outside the scope is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..functions.predicates import governed
from . import folds, ranking

LIMIT = 20
#: Profiles: budget, cards, tokens of a card's body, tokens and number of fallback cards. Fixed values.
PROFILES = {"compact": (1200, 4, 220, 420, 2), "risk": (3000, 5, 850, None, None), "deep": (5000, 8, 1200, None, None)}
DEFAULT_BUDGET, CARD_EXTRA = 3000, 80
#: Cues that the risk profile adds; what makes a card go first, with its points. Fixed values.
RISK_CUES = ("feedback_pre_push_gate_is_load_bearing", "feedback_codex_review_before_approve", "pre-push", "codex", "review", "github")
FIRST_CARDS = ((100, ("83856999-727b-42f8-b826-8e1eebb6208b", "pre-push sanitization gate")), (90, ("0fbc63fc-6991-47b7-8f7a-d138f12c8276", "codex review plans")))
SAFETY = r"\b(github|gitea|public|security|secret|sanitize|merge|dependabot|migration|rollback|incident)\b"
MATCHED, FALLBACK = "runtime-snapshot", "runtime-snapshot-scope-fallback"
NOTICE = "\n\n## Budget Notice\n\nSnapshot truncated to respect the configured token budget.\n"
SHORTENED = "\n\n[Full narrative retained in memory.]"
HEAD = (
    "Use the following memory snapshot as supporting context only.",
    "If it conflicts with the live repo, runtime, or direct instructions, trust the live repo and direct instructions.",
    "",
    "# Memory Snapshot",
    "",
)
NONE_ELIGIBLE = "## No Prompt-Eligible Memories\n\nNo reviewed memories were returned for this snapshot. Imported assistant memories remain gated until explicitly approved.\n"


def _of_profile(i: int, otherwise: int | None) -> Column:
    """The i-th value of the request's profile."""
    out = F.lit(otherwise).cast("long")
    for name, values in PROFILES.items():
        out = F.when(F.col("profile") == name, F.lit(values[i]).cast("long")).otherwise(out)
    return out


def budget(profile: Column, max_tokens: Column) -> Column:
    """A profile's budget is an upper limit; a request without profile may ask for any."""
    base = _of_profile(0, DEFAULT_BUDGET)
    asked = F.when(max_tokens > 0, max_tokens)
    return F.when(asked.isNull(), base).when(profile.isin(*PROFILES), F.least(asked, base)).otherwise(asked).cast("long")


def domains(cwd: Column, git_root: Column, markers: tuple[str, ...] = ()) -> Column:
    """Names of the project: what follows a marker folder in the path, and the name of the root folder."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    steps = lambda path: F.array_remove(F.split(F.coalesce(path, F.lit("")), "/"), "")
    after = lambda path: F.coalesce(F.lit(None).cast("string"), *[F.get(steps(path), F.nullif(F.array_position(steps(path), m), F.lit(0)).cast("int")) for m in markers])
    root = F.coalesce(F.when(git_root != "", git_root), cwd)
    name = F.element_at(F.concat(F.array(F.lit("")), steps(root)), -1)
    found = F.array(F.coalesce(after(cwd), after(git_root)), F.when(~name.isin("", ".", "/"), name))
    return F.array_distinct(F.filter(F.transform(F.array_compact(found), clean), lambda x: x != ""))


def cues(prompt: Column, profile: Column) -> Column:
    own = F.slice(F.filter(F.split(F.coalesce(prompt, F.lit("")), "[^A-Za-z0-9_-]+"), lambda x: F.length(x) >= 4), 1, 8)
    return F.when(profile == "risk", F.concat(own, F.array(*map(F.lit, RISK_CUES)))).otherwise(own)


def resolve(requests: DataFrame, markers: tuple[str, ...] = ()) -> DataFrame:
    """The requests with domains, scope, cues, query text, budget and the budget of the recall."""
    d = requests.withColumn("mode", F.coalesce("mode", F.lit("shadow"))).withColumn("domains", domains(F.col("cwd"), F.col("git_root"), markers))
    first = F.get("domains", F.lit(0))
    d = d.withColumns({"scope": F.concat(F.lit("project:"), first), "cues": cues(F.col("prompt"), F.col("profile")), "budget": budget(F.col("profile"), F.col("max_tokens"))})
    d = d.withColumn("query", F.trim(F.array_join(F.filter(F.concat(F.array(F.col("prompt")), F.col("cues")), lambda x: F.trim(x) != ""), " ")))
    return d.withColumn("recall_budget", F.when(F.col("profile").isin(*PROFILES), F.col("budget") * 4).otherwise(F.col("budget")))


def in_scope(resolved: DataFrame, memories: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(request_id, text_rank, memory...): the best memories of each request's scope.

    A memory is found by the prefixes of its own scope; the best of a scope are taken once for all its requests.
    """
    scopes = resolved.where("scope is not null").select("scope").distinct()
    m = memories.where(F.col("scope_path").startswith("project:"))
    m = m.withColumn("scope", F.explode(F.transform(F.sequence(F.lit(len("project:") + 1), F.greatest(F.length("scope_path"), F.lit(len("project:") + 1))), lambda n: F.substring(F.col("scope_path"), F.lit(1), n))))
    m = m.dropDuplicates(["scope", "memory_id"]).join(scopes, "scope")
    best = ranking.first_per_key(m, ["scope"], _order(), limit)
    return resolved.select("request_id", "scope").join(best, "scope").drop("scope").withColumn("text_rank", F.lit(0.0))


def _order() -> list[Column]:
    return [F.desc(F.coalesce("quality_score", "confidence", F.lit(0.5))), F.asc_nulls_last("priority"), F.desc_nulls_last("updated_at"), F.asc("memory_id")]


def candidates(resolved: DataFrame, memories: DataFrame, matches: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` matches (request_id, memory_id, text_rank) of each request that lie in its scope."""
    d = matches.join(memories, "memory_id").join(resolved.select("request_id", "scope"), "request_id")
    d = d.where(F.col("scope").isNull() | F.coalesce(F.col("scope_path").startswith(F.col("scope")), F.lit(False))).drop("scope")
    return ranking.first_per_key(d, ["request_id"], [F.desc("text_rank"), *_order()], limit)


def package(resolved: DataFrame, found: DataFrame, reason: str) -> DataFrame:
    """(request_id, items, omitted, retrieved): candidates packed into the recall budget, best first.

    The best one is cut if it alone exceeds the budget; if its words keep it above, it is left out again.
    """
    d = found.join(resolved.select("request_id", "recall_budget", "mode"), "request_id")
    content = X.redact(F.coalesce("narrative", F.lit("")))
    d = d.withColumn("content", content).withColumn("tokens", F.coalesce(F.col("token_count").cast("long"), X.token_estimate("content")))
    rank = S.prompt_rank(F.col("text_rank"), F.coalesce("quality_score", "confidence"), F.coalesce(F.col("source_class") == "corrected_by_user", F.lit(False)), F.coalesce(F.col("governance_status") == "validated", F.lit(False)), F.col("strength"), F.col("priority"))
    d = d.withColumn("place", F.row_number().over(ranking.Window.partitionBy("request_id").orderBy(F.desc("text_rank"), *_order()))).withColumn("score", rank)
    text = F.concat_ws(" ", "title", "content")
    item = F.struct("memory_id", S.section(F.col("namespace"), F.col("governance_status"), text).alias("section"), F.lit(reason).alias("reason"), "content", F.col("tokens").alias("n"), F.col("governance_status").alias("governance"), "place")
    d = d.withColumn("item", item)
    packed = folds.pack(d, ["request_id"], [F.desc("score"), F.asc("place")], "tokens", "item", "recall_budget", truncate_first=True)
    packed = packed.join(resolved.select("request_id", "recall_budget", "mode"), "request_id")
    cut = F.transform("items", lambda x: x.withField("content", X.budget_cut(x["content"], F.col("recall_budget"))).withField("n", F.when(x["n"] > F.col("recall_budget"), X.token_estimate(X.budget_cut(x["content"], F.col("recall_budget")))).otherwise(x["n"])))
    packed = packed.withColumn("results", cut)
    kept = F.filter("results", lambda x: (x["n"] <= F.col("recall_budget")) & (F.col("mode") != "off"))
    packed = packed.withColumn("items", kept)
    every = d.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", "memory_id", "governance_status", "trust_class"))).alias("_all"))
    packed = packed.join(every, "request_id")
    why = lambda x: (
        F.when(x["governance_status"].isin("quarantined", "suppressed", "retired"), x["governance_status"]).when(x["trust_class"] == "retired_superseded", x["trust_class"])
        .when(F.col("mode") == "off", "injection_mode_off").otherwise("token_budget_or_low_rank")
    )
    inside = F.transform("items", lambda x: x["memory_id"])
    omitted = F.transform(F.filter("_all", lambda x: ~F.array_contains(inside, x["memory_id"])), lambda x: F.struct(x["memory_id"].alias("memory_id"), why(x).alias("reason")))
    return packed.select("request_id", "items", omitted.alias("omitted"), F.size("results").alias("retrieved"))


def _safety(x: Column) -> Column:
    text = F.lower(F.concat_ws(" ", x["memory_id"], x["content"]))
    points = F.when(text.rlike(SAFETY), 10).otherwise(0)
    for n, marks in FIRST_CARDS:
        found = F.contains(text, F.lit(marks[0]))
        for m in marks[1:]:
            found = found | F.contains(text, F.lit(m))
        points = points + F.when(found, n).otherwise(0)
    return points


def choose(d: DataFrame) -> DataFrame:
    """The cards of the profile from ``items``; without a profile all of them, as they are."""
    cards, body, generic_tokens, generic_cards = (_of_profile(i, None) for i in (1, 2, 3, 4))
    d = d.withColumns({"_cards": cards, "_body": body, "_gt": generic_tokens, "_gc": generic_cards})
    order = F.array_sort(F.transform("items", lambda x, i: F.struct((-_safety(x)).alias("s"), i.alias("i"), x.alias("x"))))
    kind = f"array<{d.schema['items'].dataType.elementType.simpleString()}>"  # type: ignore[attr-defined]
    start = F.struct(F.array().cast(kind).alias("taken"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("tokens"))

    def step(acc: Column, y: Column) -> Column:
        x = y["x"]
        cost = F.least(x["n"], F.col("_body") + CARD_EXTRA)
        generic = x["reason"].rlike("(?i)fallback")
        room = (F.col("_gc").isNull() | (acc["n"] < F.col("_gc"))) & (F.col("_gt").isNull() | (acc["tokens"] + cost <= F.col("_gt")))
        take = (F.size(acc["taken"]) < F.col("_cards")) & (~generic | room)
        return F.struct(
            F.when(take, F.concat(acc["taken"], F.array(x.withField("n", cost)))).otherwise(acc["taken"]).alias("taken"),
            F.when(take & generic, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(take & generic, acc["tokens"] + cost).otherwise(acc["tokens"]).alias("tokens"),
        )

    chosen = F.when(F.col("_cards").isNotNull(), F.aggregate(order, start, step)["taken"]).otherwise(F.col("items"))
    return d.withColumn("cards", chosen).drop("_cards", "_gt", "_gc")


def _card(x: Column) -> Column:
    long = F.col("_body").isNotNull() & (X.token_estimate(x["content"]) > F.col("_body"))
    body = F.when(long, F.concat(F.rtrim(F.regexp_replace(F.substring(x["content"], F.lit(1), (F.col("_body") * 4).cast("int")), r"\s+$", "")), F.lit(SHORTENED))).otherwise(x["content"])
    lines = F.array(
        F.concat(F.lit("### "), x["section"]), F.concat(F.lit("- Memory ID: "), x["memory_id"]), F.concat(F.lit("- Reason: "), x["reason"]), F.concat(F.lit("- Tokens: "), x["n"].cast("string")),
        F.concat(F.lit("- Governance: "), x["governance"]), F.lit(""), body, F.lit(""),
    )
    return F.array_join(lines, "\n")


def render(d: DataFrame) -> DataFrame:
    """``markdown`` of the cards of each request."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    names = F.when(F.size("domains") > 0, F.array_join("domains", ", ")).otherwise("none")
    injected = F.when(F.col("mode").isin("eval", "default_on"), "yes").otherwise("no")
    facts = F.array_compact(F.array(
        line("Context cwd", F.col("cwd")), F.when(F.col("git_root") != "", line("Context git root", F.col("git_root"))), line("Candidate domains", names), line("Profile", F.coalesce("profile", F.lit("legacy"))),
        line("Mode", F.col("mode")), line("Injected", injected), line("Prompt-eligible memories", F.size("cards").cast("string")), line("Retrieved memories", F.col("retrieved").cast("string")), F.lit(""),
    ))
    some = F.concat(F.array(F.lit("## Memories"), F.lit("")), F.transform("cards", _card))
    body = F.when(F.size("cards") > 0, some).otherwise(F.array(F.lit(NONE_ELIGIBLE.rstrip("\n"))))
    listed = F.transform("omitted", lambda o: F.concat(F.lit("- "), o["memory_id"], F.lit(": "), o["reason"]))
    tail = F.when(F.size("omitted") > 0, F.concat(F.array(F.lit("## Omitted"), F.lit("")), listed)).otherwise(F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(*map(F.lit, HEAD)), facts, body, tail), "\n")
    return d.withColumn("markdown", F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")))


def fit(markdown: Column, limit: Column) -> Column:
    """The text itself if it fits; else cut to four characters a token, then by 64 more at a time until it fits with the notice."""
    room = F.greatest(F.lit(1), limit - X.token_estimate(F.lit(NOTICE))) * 4
    shorter = lambda n: F.concat(F.regexp_replace(F.substring(markdown, F.lit(1), n.cast("int")), r"\s+$", ""), F.lit(NOTICE))
    least = F.least(room, F.lit(16))
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil((room - least) / 64)))
    size = F.aggregate(steps, F.lit(-1).cast("long"), lambda acc, i: F.when(acc >= 0, acc).when(X.token_estimate(shorter(F.greatest(least, room - i * 64))) <= limit, F.greatest(least, room - i * 64)).otherwise(acc))
    return F.when((limit <= 0) | (X.token_estimate(markdown) <= limit), markdown).otherwise(shorter(F.when(size >= 0, size).otherwise(least)))


def build(requests: DataFrame, memories: DataFrame, matches: DataFrame, markers: tuple[str, ...] = (), limit: int = LIMIT) -> DataFrame:
    """One row per request: domains, scope, fallback, cards, omitted, markdown, tokens, truncated.

    ``matches`` (request_id, memory_id, text_rank) come from a search with the request's query text (``resolve``).
    """
    resolved = resolve(requests, markers)
    usable = memories.where(governed())
    none = F.array()
    first = package(resolved, candidates(resolved, usable, matches, limit), MATCHED)
    first = resolved.join(first, "request_id", "left")
    again = first.where("scope is not null and size(cues) > 0 and coalesce(size(items), 0) = 0").select(*resolved.columns)
    second = package(again, in_scope(again, usable, limit), FALLBACK).toDF("request_id", "_items", "_omitted", "_retrieved").withColumn("_fallback", F.lit(True))
    second = again.select("request_id").join(second, "request_id", "left").withColumn("_again", F.lit(True))
    d = first.join(second, "request_id", "left")
    pick = lambda a, b: F.when(F.col("_again"), F.col(a)).otherwise(F.col(b))
    empty = lambda name: F.coalesce(F.col(name), none.cast(first.schema[name].dataType))
    d = d.withColumns({"items": pick("_items", "items"), "omitted": pick("_omitted", "omitted"), "retrieved": F.coalesce(pick("_retrieved", "retrieved"), F.lit(0)), "fallback": F.coalesce("_again", F.lit(False))})
    d = d.withColumns({"items": empty("items"), "omitted": empty("omitted")})
    d = render(choose(d)).withColumn("_text", F.col("markdown"))
    d = d.withColumn("markdown", fit(F.col("_text"), F.col("budget")))
    return d.select("request_id", "domains", "scope", "fallback", "cards", "omitted", "markdown", X.token_estimate("markdown").alias("tokens"), (F.col("markdown") != F.col("_text")).alias("truncated"))
