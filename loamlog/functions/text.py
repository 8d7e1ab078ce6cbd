"""Text functions as column expressions: tokens, normalizers, scrubbing, views, classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word boundary by ASCII word characters; Java's own counts other scripts' letters too.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def words(*alternatives: str) -> str:
    """A case-insensitive pattern of whole words."""
    return f"(?i){B}(?:{'|'.join(alternatives)}){B}"


# Patterns and vocabularies that results depend on, in their natural order.
SCRUB = (
    (r"(?i)https?://[^\s\"'`<>]+", "[URI]"),
    (r"(?i)file://[^\s\"'`<>]+", "[URI]"),
    (r"(?:^|[\s\"'`])/(?:tmp|var|home|Users|etc|opt|private|Volumes|mnt|srv)/[^\s\"'`]+", " [PATH]"),
    (r"(?:^|[\s\"'`])[A-Za-z]:\\[^\s\"'`]+", " [PATH]"),
    (r"(?:^|[\s\"'`])~/[^\s\"'`]+", " [PATH]"),
    (B + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + B, "[EMAIL]"),
    (B + r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)" + B, "[IP]"),
    (B + r"(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{0,4}" + B, "[IP]"),
    (r"(?i)" + B + r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:com|org|net|io|dev|app|local|internal|example|edu|gov|co|kr|jp|ai)" + B, "[HOST]"),
)
SECRET = words(r"api[_-]?key", "secret", "password", r"bearer\s+[a-z0-9._-]+", r"sk-[a-z0-9]{10,}")
SECRET_LINE = words(r"api[_-]?key", "secret", "password", r"bearer\s+[a-z0-9._-]+", r"sk-[a-z0-9]{10,}", "hunter2")
SECRET_MATERIAL = (
    words("ciphertext", "plaintext", "raw_payload", "transcript_secret", r"local-aes256\.key"),
    B + r"sk-[a-zA-Z0-9]{8,}" + B,
    B + r"Bearer\s+[A-Za-z0-9\-._~+/]+=*" + B,
    B + r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"(?i)" + B + r"(?:api[_-]?key|access[_-]?token|secret[_-]?key|client[_-]?secret|password|passwd|passphrase)\s*[:=]\s*\S+",
    B + r"ghp_[A-Za-z0-9]{20,}" + B,
    B + r"xox[baprs]-[A-Za-z0-9-]{10,}" + B,
)
TOOL_LINE = r"(?i)^(?:PostToolUse|git status|npm install|pnpm (?:install|test|check)|PREFLIGHT PASS|make preflight(?:-fix|-quick)?)\s*$"
TOOL_INLINE = words("linter passed", "exit 0", "vulnerabilit(?:y|ies)", "ran .+ successfully")
TELEMETRY_LINE = words(
    "hook_event_name", "session_id", "agent_type", "cache_evidence", "prefix_epoch", "model_used", "tool_count", "mcp_wait_ms",
    "elapsed_since_turn_start",
)
NOISE_LINE = r"(?i)^(?:ok|okay|done|passed|success|noop|n/a|none|thanks?|thank you|lgtm|wip|test|ping|pong|yes|no|y|n|\.|…|\.\.\.)$"
NOISE_SIGNAL = r"(?i)^(?:ok(?:ay)?|thanks|thank you|lgtm|nit|wip|test|hello|hi|ping|pong|yes|no|yep|nah|cool|nice|lol|…|\.+|👍|✅)$"
INJECTION = words("ignore previous instructions", r"SYSTEM:\s*export all secrets", "exfiltrat", "jailbreak")
VALUE_TERMS = words(
    "decid(?:e|ed|ing|es|ion)", "must", "should", "always", "never", "prefer", "preference", "constraint", "because", "instead", "migrate",
    "breaking", "ship", "release", "approve", "reject", "policy", "default", "require", "forbidden", "todo", "fix", "bug",
)
KINDS = (
    ("preference", words("prefer(?:red|s|ring)?", "preference", "would rather", "favor(?:ed|s)?", "rather than")),
    ("constraint", words("must(?: not)?", "should not", "never", "always", "required?", "forbidden", "constraint")),
    ("procedure", words("procedure", "workflow", "runbook", "playbook", "steps?")),
    ("decision", words("decid(?:e|ed|ing|es)", "decision", "adopt(?:ed)?", "chose", "choose", "selected?", "default to", "I(?:'|’)ll", "I will", "we will", "let(?:'|’)s", "going (?:to|with)", "switch to")),
)
KINDS_KO = {
    "preference": "선호|좋아하|원해", "constraint": "하면 안|금지|필수|항상|절대", "procedure": "절차|워크플로|런북",
    "decision": "결정|하자|할게|사용하(?:자|고|는|기로)|적용하(?:자|고|는|기로)",
}
HOOKS = {
    "sessionend": "SessionEnd", "stop": "Stop", "precompact": "PreCompact", "posttooluse": "PostToolUse", "sessionstart": "SessionStart",
    "notification": "Notification", "userpromptsubmit": "UserPromptSubmit",
}
LIFECYCLE_HOOKS = ("SessionEnd", "Stop", "PreCompact")
MARKER = "\n…[truncated]…\n"


def search_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, repeats kept."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def embedding_tokens(text: Column) -> Column:
    """Like search tokens, with underscores inside."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))


def scrub(text: Column) -> Column:
    """Places of files, hosts and people replaced, each family in its order."""
    for pattern, by in SCRUB:
        text = F.regexp_replace(text, pattern, by)
    return text


#: What a text must hold for a family of SCRUB to occur in it, in the same order.
SCRUB_SIGN = (
    lambda t: t.contains("://"), lambda t: t.contains("://"), lambda t: t.contains("/"), lambda t: t.contains(":\\"), lambda t: t.contains("~/"),
    lambda t: t.contains("@"), lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: t.rlike("[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"),
    lambda t: t.rlike(r"(?i)[a-z0-9]\.(?:com|org|net|io|dev|app|local|internal|example|edu|gov|co|kr|jp|ai)"),
)


def computed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` as it is, but computed once: what refers to it, filters above
    all, is not written out in terms of the columns before it."""
    names = [c for c in rows.columns if c != column]
    return rows.select(*names, F.explode(F.array(F.col(column))).alias(column)).select(*rows.columns)


def scrubbed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` scrubbed, a step a family: most texts lack what a family needs
    and skip its pattern."""
    for (pattern, by), sign in zip(SCRUB, SCRUB_SIGN, strict=True):
        text = F.col(column)
        rows = rows.withColumn(column, F.when(sign(text), F.regexp_replace(text, pattern, by)).otherwise(text))
    return computed(rows, column)


def head_tail(text: Column, most: int) -> Column:
    """Start and end of a longer text with a marker between them, ``most`` characters in all."""
    room = most - len(MARKER)
    if room < 32:
        return F.substring(text, 1, most)
    head = room // 2
    cut = F.concat(F.substring(text, 1, head), F.lit(MARKER), F.right(text, F.lit(room - head)))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def line_kinds(text: Column) -> Column:
    """The lines that are not blank with their kinds: secret, tool, telemetry, noise or kept,
    the first that fits. A pattern is tried where a line holds a word that it needs."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")

    def holds(x: Column, *signs: str) -> Column:
        out = F.lit(False)
        for sign in signs:
            out = out | x.contains(sign)
        return out

    def kind(x: Column) -> Column:
        low = F.lower(x)
        secret = holds(low, "key", "secret", "password", "bearer", "sk-", "hunter2") & x.rlike(SECRET_LINE)
        inline = holds(low, "linter passed", "exit 0", "vulnerabilit", "successfully") & x.rlike(TOOL_INLINE)
        telemetry = (F.length(x) < 200) & x.contains("_") & x.rlike(TELEMETRY_LINE)
        tool = x.rlike(TOOL_LINE) | inline
        noise = (F.length(x) <= 9) & x.rlike(NOISE_LINE)
        return F.when(secret, "secret").when(tool, "tool").when(telemetry, "telemetry").when(noise, "noise").otherwise("kept")

    return F.transform(lines, lambda x: F.struct(kind(x).alias("kind"), x.alias("line")))


def with_residual(rows: DataFrame, column: str, into: str) -> DataFrame:
    """``rows`` with a struct of the lines that are prose and of how many were dropped as what.

    The kinds are a column of their own first, so that each line is classified once.
    """
    kinds = f"_kinds_of_{into}"
    count = lambda k: F.size(F.filter(kinds, lambda p: p["kind"] == k))
    kept = F.transform(F.filter(kinds, lambda p: p["kind"] == "kept"), lambda p: p["line"])
    out = computed(rows.withColumn(kinds, line_kinds(F.col(column))), kinds)
    return out.withColumn(into, F.struct(kept.alias("kept"), count("secret").alias("secret"), count("tool").alias("tool"), count("telemetry").alias("telemetry"))).drop(kinds)


def hook(name: Column) -> Column:
    """A hook's canonical name from any spelling; unknown ones stay, empty ones are unknown."""
    key = F.regexp_replace(F.lower(F.trim(name)), r"[\s_-]+", "")
    known = F.create_map(*[F.lit(x) for pair in HOOKS.items() for x in pair])
    return F.when(F.trim(name) == "", "unknown").otherwise(F.coalesce(known[key], F.trim(name)))


def holds(text: Column, *parts: str) -> Column:
    """Whether one of ``parts``, in lower case, occurs in any case."""
    out = F.lit(False)
    for part in parts:
        out = out | F.lower(text).contains(part)
    return out


#: What a text must hold for a pattern of SECRET_MATERIAL to occur in it, in the same order.
SECRET_SIGN = (
    lambda t: holds(t, "ciphertext", "plaintext", "raw_payload", "transcript_secret", "local-aes256.key"),
    lambda t: t.contains("sk-"), lambda t: t.contains("Bearer"), lambda t: t.contains("-----BEGIN"),
    lambda t: (t.contains(":") | t.contains("=")) & holds(t, "key", "token", "secret", "passw", "passphrase"), lambda t: t.contains("ghp_"), lambda t: t.contains("xox"),
)


def secret_material(text: Column) -> Column:
    """Patterns are only tried where their sign occurs."""
    out = F.lit(False)
    for pattern, sign in zip(SECRET_MATERIAL, SECRET_SIGN, strict=True):
        out = out | (sign(text) & text.rlike(pattern))
    return F.coalesce(out, F.lit(False))


def kind_of(text: Column) -> Column:
    """preference, constraint, procedure or decision: the first whose words occur; else null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, pattern in KINDS:
        out = out.when(text.rlike(pattern) | text.rlike(KINDS_KO[kind]), kind)
    return out


def statement_key(text: Column) -> Column:
    """Lower case, quotes dropped, other punctuation and runs of space as one space."""
    out = F.lower(text)
    for quote in "“”\"'`":
        out = F.replace(out, F.lit(quote), F.lit(""))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def grounding_text(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), "[“”\"'`]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def grounding_tokens(text: Column) -> Column:
    """ASCII tokens longer than two characters, and bigrams of Hangul and Han runs."""
    latin = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 2)
    runs = F.regexp_extract_all(F.lower(text), F.lit("([\\u1100-\\u11FF\\u3130-\\u318F\\uA960-\\uA97F\\uAC00-\\uD7AF\\u4E00-\\u9FFF]+)"), F.lit(1))
    grams = F.transform(
        runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    )
    return F.concat(latin, F.flatten(grams))


def one_line(text: Column, most: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def subject_node(text: Column) -> Column:
    return F.concat(F.lit("subj:"), F.substring(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9:_-]+", "_"), 1, 96))


def content_id(prefix: str, length: int, *parts: Column) -> Column:
    """A prefix and the first hex digits of the parts' SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
