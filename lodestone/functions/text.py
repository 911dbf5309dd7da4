"""Text expressions: tokens, full-text matching, redaction, token budgets, query planning hints. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words of the full-text configuration. Fixed values.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now""".split()

#: Keywords that hint at the kind of fact a question asks for. Fixed values.
PREDICATE_HINTS = {
    "cause": ("cause", "caused", "causing", "root cause", "why"),
    "impact": ("impact", "impacted", "affected", "down"),
    "decision": ("decision", "decided", "chose"),
    "remediation": ("fix", "fixed", "remediate", "remediation", "resolve", "repair"),
    "constraint": ("must", "should", "guardrail", "policy", "require", "depends"),
    "config_change": ("config", "changed", "setting", "parameter"),
}

#: Phrases that mark an attempt to steer a model. Fixed values.
INJECTION_MARKERS = ("ignore previous", "ignore above", "system:", "developer:", "assistant:", "you are now", "act as", "follow these instructions instead", "<|im_start|>", "<|system|>", "begin prompt", "role:")

#: Redaction of secrets in governed texts, applied in this order. Fixed values.
REDACTIONS = (
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+\/=:-]{12,}", "Bearer [REDACTED]"),
    (r"(?i)\bfake-secret(?:-[A-Za-z0-9_-]+)?\b", "[REDACTED_SECRET]"),
    (r"\b(?:sk|pk|rk)-[A-Za-z0-9][A-Za-z0-9_-]{20,}\b", "[REDACTED_TOKEN]"),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", "[REDACTED_TOKEN]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,}\b", "[REDACTED_TOKEN]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b", "[REDACTED_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bAIza[0-9A-Za-z_-]{20,}\b", "[REDACTED_API_KEY]"),
    (r"(?i)\b((?:[a-z][a-z0-9_-]*[_-]?)?(?:api[_-]?key|token|secret|password))\s*[:=]\s*[\"']?[^\"'\s,;}]{8,}", "$1=[REDACTED]"),
    (r"\b[A-Za-z0-9_-]{32,}\b", "[REDACTED_TOKEN]"),
)

#: Secrets as they are taken out before a text leaves for an embedding service. Fixed values.
SECRETS = (
    (r"(?i)(?:AWS_SECRET_ACCESS_KEY|aws_secret_access_key)\s*[:=]\s*['\"]?([a-zA-Z0-9/+=]{30,})['\"]?", "aws_secret"),
    (r"(?i)(?:api[_-]?key|apikey|client[_-]?secret|access[_-]?key|credential)\s*[:=]\s*['\"]?([a-zA-Z0-9_\-./+=]{16,})['\"]?", "api_key"),
    (r"(?i)(?:password|passwd|pwd)\s*[:=]\s*['\"]?([^\s'\"]{8,})['\"]?", "password"),
    (r"(?i)(?:token|secret)\s*[:=]\s*['\"]?([a-zA-Z0-9_\-.]{20,})['\"]?", "token"),
    (r"(?i)(?:authorization\s*:\s*)?bearer\s+[a-zA-Z0-9._\-]{20,}", "bearer_token"),
    (r"\beyJ[a-zA-Z0-9_\-]+?\.[a-zA-Z0-9_\-]+?\.[a-zA-Z0-9_\-]+", "jwt"),
    (r"(?i)(?:session(?:id)?|cookie|refresh[_-]?token)\s*[:=]\s*['\"]?([^\s'\";]{16,})['\"]?", "session_secret"),
    (r"-----BEGIN (?:OPENSSH |RSA |EC |DSA )?PRIVATE KEY-----[\s\S]*?-----END (?:OPENSSH |RSA |EC |DSA )?PRIVATE KEY-----", "private_key"),
    (r"(?i)(?:postgresql|mysql|mongodb|redis):\/\/[^\s]+", "connection_string"),
    (r"(?:sk-|pk_live_|pk_test_|sk_live_|sk_test_|ghp_|gho_|github_pat_|xox[baprs]-|ya29\.|hf_[A-Za-z0-9]{20,}|glpat-|sg\.[A-Za-z0-9._-]{20,})[a-zA-Z0-9_\-\.]{10,}", "vendor_key"),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "aws_access_key"),
    (r"\"(?:type)\"\s*:\s*\"service_account\"[\s\S]{0,250}?\"private_key_id\"\s*:\s*\"[^\"]{16,}\"[\s\S]{0,250}?\"client_email\"\s*:\s*\"[^\"]+@[^\"]+\.iam\.gserviceaccount\.com\"", "google_service_account"),
    (r"\bhttps:\/\/hooks\.slack\.com\/services\/[A-Z0-9]{8,}\/[A-Z0-9]{8,}\/[A-Za-z0-9]{20,}\b", "slack_webhook"),
    (r"\bhttps:\/\/(?:canary\.|ptb\.)?discord(?:app)?\.com\/api\/webhooks\/\d{17,20}\/[A-Za-z0-9._-]{40,}\b", "discord_webhook"),
    (r"\b\d{8,10}:[A-Za-z0-9_-]{35}\b", "telegram_bot_token"),
    (r"\bnpm_[A-Za-z0-9]{36}\b", "npm_token"),
    (r"\"auth\"\s*:\s*\"[A-Za-z0-9+/=]{20,}\"", "docker_auth"),
    (r"(?i)machine\s+\S+\s+login\s+\S+\s+password\s+\S+", "netrc"),
    (r"\b[A-Za-z0-9+/]{40,}={0,2}\b", "high_entropy"),
)

#: Messages without content. Fixed value.
TRIVIAL = r"(?i)^(ok|okay|yes|no|yep|nope|thanks|thx|ty|sure|k|kk|lol|lmao|haha|hmm|ah|oh|nice|cool|great|done|got it|np)$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(col(text)), "[^a-z0-9]+"), "")


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.array_remove(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), "")


def matches_all(document: Column, query: Column) -> Column:
    """AND-match of lexemes; an empty query matches nothing."""
    return (F.size(query) > 0) & (F.size(F.array_except(query, document)) == 0)


def has_words(text: Column | str, wanted: tuple[str, ...]) -> Column:
    """Whether a text has all of some lower-case words; texts without them as substrings are not split."""
    low = F.lower(col(text))
    inside = reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in wanted])
    return inside & matches_all(words(text), F.array(*map(F.lit, wanted)))


def term_rank(document: Column, query: Column) -> Column:
    """Occurrences of query lexemes per lexeme of the document."""
    hits = F.size(F.filter(document, lambda x: F.array_contains(query, x)))
    return F.when(F.size(document) > 0, hits / F.size(document)).otherwise(F.lit(0.0))


def redact(text: Column | str) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), REDACTIONS, col(text))


def redact_secrets(text: Column | str) -> Column:
    """The text with every secret of SECRETS as ``[REDACTED:kind]``, tried in their order."""
    return reduce(lambda c, p: F.regexp_replace(c, p[0], f"[REDACTED:{p[1]}]"), SECRETS, col(text))


def token_estimate(text: Column | str) -> Column:
    """ceil(max(length / 4, words * 1.3)), at least 1; 0 for blank text."""
    t = F.trim(F.regexp_replace(col(text), r"^\s+|\s+$", ""))
    words = F.size(F.split(t, r"\s+"))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.greatest(F.length(col(text)) / 4, words * F.lit(1.3))))).cast("long")


def json_text(text: Column) -> Column:
    """A string as JSON text, quotes included; null stays null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def budget_cut(text: Column | str, budget: Column | int) -> Column:
    """The text cut to four characters per token where its estimate exceeds the budget."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    return F.when((b <= 0) | (token_estimate(text) <= b), col(text)).otherwise(F.rtrim(F.substring(col(text), F.lit(1), F.greatest(F.lit(1), b * 4).cast("int"))))


def injection_marker(text: Column | str) -> Column:
    """The first marker that the text contains, or null."""
    low = F.lower(col(text))
    return F.get(F.filter(F.array(*map(F.lit, INJECTION_MARKERS)), lambda m: F.contains(low, m)), F.lit(0))


def substantial(text: Column | str) -> Column:
    t = F.trim(col(text))
    return F.coalesce((F.length(t) >= 20) & ~t.rlike(TRIVIAL), F.lit(False))


def slug(text: Column | str, limit: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.substring(s, 1, limit)


def unique_ordered(values: Column) -> Column:
    """Trimmed lower-case strings without blanks, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def predicate_hints(query: Column | str) -> Column:
    """The kinds of PREDICATE_HINTS whose keywords occur in the query."""
    low = F.lower(col(query))
    return F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(kind)) for kind, words in PREDICATE_HINTS.items()]))


def query_tokens(query: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(query)), F.lit(r"[a-z0-9][a-z0-9_.:-]*"), F.lit(0))


def token_boundary_search(text: Column | str, names: list[str]) -> Column:
    """The names that occur in the text with no letter, digit or underscore beside them."""
    low = F.lower(col(text))
    return F.array_compact(F.array(*[F.when(low.rlike(rf"(?<![a-z0-9_])\Q{n.lower()}\E(?![a-z0-9_])"), F.lit(n)) for n in names]))


def word_overlap(a: Column | str, b: Column | str, least: int = 4) -> Column:
    """Share of the expected words of at least ``least`` letters that the other text has as well."""
    long_words = lambda c: F.array_distinct(F.filter(tokens(c), lambda x: F.length(x) >= least))
    x, y = long_words(a), long_words(b)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def headings(text: Column | str) -> Column:
    """Lines outside code fences with their heading number: array of (line, text, heading)."""
    lines = F.split(col(text), "\n")
    start = F.struct(F.array().cast("array<struct<line:int,text:string,heading:int>>").alias("rows"), F.lit(False).alias("fence"), F.lit(0).alias("h"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        mark = line.rlike(r"^\s*(```|~~~)")
        head = ~acc["fence"] & line.rlike(r"^#{1,6}\s")
        h = acc["h"] + F.when(head, 1).otherwise(0)
        row = F.struct((acc["n"] + 1).alias("line"), line.alias("text"), h.alias("heading"))
        return F.struct(F.concat(acc["rows"], F.array(row)).alias("rows"), F.when(mark, ~acc["fence"]).otherwise(acc["fence"]).alias("fence"), h.alias("h"), (acc["n"] + 1).alias("n"))

    return F.aggregate(lines, start, step, lambda acc: acc["rows"])
