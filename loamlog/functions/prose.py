"""Rules over prose as column expressions: what lasts, what corrects, what may be shown."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamlog.functions.text import B, secret_material, words

# Patterns and vocabularies that results depend on, in their natural order.
DURABLE = words(
    "decid(?:e|ed|ing|es)", "decisions?", "prefer(?:ence)?", "must", "should", "always", "never", "constraint", "procedure", "workflow",
    "adopt(?:ed)?", "chose", "choose", "default", "policy", "correction", "corrected", "retract(?:ed|ion)?", "replace(?:d|ment)?", "instead", "no longer",
)
DURABLE_KO = "(결정|선호|반드시|항상|절대|기본값|정책|절차|정정|철회|대신|더 이상)"
FUTURE = words("will", "plan(?:s)? to", "planning to", "going to", "intend(?:s|ed)? to", "may", "might", "could")
FUTURE_KO = "(할 예정이다|계획이다|계획입니다|하려고 한다|할 수 있다)"
CORRECTION = words(
    "correction", "corrected", "retract(?:ed|ion)?", "replace(?:d|ment)?", "instead of", "no longer",
    r"(?:(?:do|does|did) not|don't|must not|should not|never)\s+(?:use|prefer|allow|support)",
)
CORRECTION_KO = r"(?:정정|철회|대신|더 이상)|(?:사용|선호|허용|지원)하지\s*않(?:습니다|는다|다)?"
OBSOLETE = (
    r"\binstead of ([a-z0-9][a-z0-9 _-]{1,80})",
    r"\breplace ([a-z0-9][a-z0-9 _-]{1,80}) with\b",
    r"\bno longer (?:use|prefer|allow|support) ([a-z0-9][a-z0-9 _-]{1,80})",
    r"\b(?:(?:do|does|did) not|don't|must not|should not|never) (?:use|prefer|allow|support) ([a-z0-9][a-z0-9 _-]{1,80})",
    r"(?:^|[:.]\s*|\s)([가-힣a-z0-9][가-힣a-z0-9 _-]{0,80}?)(?:을|를)\s*(?:사용|선호|허용|지원)하지\s*않",
)
SHORT_NOISE = r"(?i)^(?:ok(?:ay)?|thanks?|thank you|lgtm|done|wip|test|ping|pong|yes|no|y|n|\.+|…)$"
DUMP = r"(?i)[{}\[\]]|" + B + r"(?:reasoning_content|tool_calls?|raw_payload|transcript)\s*[:=]"
POLICY = (
    ("redact_secret", (r"(?:^|[^A-Za-z0-9])sk-[A-Za-z0-9]{10,}", r"^sk-[A-Za-z0-9]+$")),
    ("redact_path_or_uri", (r"(?:^|[\s\"'`])/(?:tmp|var|home|Users|etc)/", r"(?:^|[\s\"'`])[A-Za-z]:\\", r"^/[A-Za-z0-9._/-]+$", r"(?i)https?://", r"(?i)file://")),
    ("redact_structured", ()),
    ("redact_tool_payload", (r"\{?\s*tool_calls\s*\}?",)),
    ("redact_prompt_injection", (r"(?i)ignore\s+previous\s+instructions",)),
)
STRICT_LEAST, RELAXED_LEAST, PROSE_MOST = 8, 4, 1200


#: White space of any script, as the policies mean it: a pattern's own class is ASCII alone.
SPACES = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"


def flat(text: Column) -> Column:
    """Runs of white space, of any script, as one space."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")


def sanitized(text: Column, strict: bool = True) -> Column:
    """Prose fit for a candidate, or null. Strictly, dumps and structured text are refused and
    eight characters are due; otherwise four are, and only noise and secrets are refused."""
    one = flat(text)
    refused = (F.length(one) < (STRICT_LEAST if strict else RELAXED_LEAST)) | one.rlike(SHORT_NOISE) | secret_material(one)
    if strict:
        listing = one.rlike(B + "PID" + B) & one.contains("%CPU") & (F.length(one) > 200)
        refused = refused | one.rlike(DUMP) | listing
    return F.when(~refused, F.substring(one, 1, PROSE_MOST))


def is_future(text: Column) -> Column:
    return text.rlike(FUTURE) | text.rlike(FUTURE_KO)


def is_durable(text: Column) -> Column:
    """Whether a line states what lasts: it names a rule or choice and is no mere intention."""
    return ~text.rlike(SHORT_NOISE) & ~is_future(text) & (text.rlike(DURABLE) | text.rlike(DURABLE_KO))


def is_correction(text: Column) -> Column:
    return text.rlike(CORRECTION) | text.rlike(CORRECTION_KO)


def obsolete_terms(text: Column) -> Column:
    """What a correction says to give up: the first match of each form, two characters at least."""
    low = repeat_key(text)
    found = F.array(*[F.trim(F.regexp_extract(low, p, 1)) for p in OBSOLETE])
    return F.filter(found, lambda t: F.length(t) >= 2)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def repeat_key(text: Column) -> Column:
    """What makes two lines the same: compatible characters as one, spaces and case aside."""
    return F.lower(flat(nfkc(text)))


def nfc_lf(text: Column) -> Column:
    """Unicode composition and line feeds alone as line ends."""
    return F.regexp_replace(nfc(text), "\r\n?", "\n")


def policy_code(text: Column) -> Column:
    """The first policy that refuses a text, or null: secrets, paths and addresses, whole JSON
    documents, tool payloads, prompt injection."""
    bare = F.trim(text)
    braced = (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, patterns in POLICY:
        hit = braced & F.coalesce(F.try_parse_json(bare).isNotNull(), F.lit(False)) if not patterns else F.lit(False)
        for p in patterns:
            hit = hit | text.rlike(p)
        out = out.when(hit, code)
    return out


def approximate_tokens(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def stable_json(**fields: Column) -> Column:
    """One JSON object with sorted keys; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def stable_json_nulls(**fields: Column) -> Column:
    """As ``stable_json``, with null fields written as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def stable_length(**fields: Column) -> Column:
    """Characters of the object's stable JSON, the unit of budgets."""
    return F.length(stable_json(**fields))


def digest(text: Column, prefix: str = "sha-256:") -> Column:
    return F.concat(F.lit(prefix), F.sha2(text, 256))


def utc_text(text: Column) -> Column:
    """A time in ISO form, UTC, without zero milliseconds; null if it is no time."""
    at = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())
    return F.replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(".000Z"), F.lit("Z"))


def span_overlap(segment: tuple[Column, Column], start: tuple[Column, Column], end: tuple[Column, Column]) -> Column:
    """none, duplicate, containment or crossing of two half-open spans."""
    (s1, s2), (a1, a2), (b1, b2) = segment, start, end
    inside = ((a1 <= a2) & (b1 >= b2)) | ((a2 <= a1) & (b2 >= b1))
    return (
        F.when(s1 != s2, "none").when((a1 == a2) & (b1 == b2), "duplicate").when((a1 >= b2) | (a2 >= b1), "none")
        .when(inside, "containment").otherwise("crossing")
    )


def dev_embedding(text: Column, dimensions: int = 768) -> Column:
    """The bytes of the text's SHA-256 over 255, repeated up to ``dimensions``."""
    hexed = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substr(hexed, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), byte)


def token(text: Column, fallback: str, most: int = 64) -> Column:
    """A name with other characters than letters, digits and ``_./+-`` as underscores."""
    out = F.substring(F.regexp_replace(F.trim(text), r"[^\w./+-]+", "_"), 1, most)
    return F.when(F.coalesce(F.length(out), F.lit(0)) == 0, fallback).otherwise(out)


def metadata_statement(provider: Column, hook: Column, kind: Column, media: Column, subject: Column) -> Column:
    """A sentence of fixed form about what was captured."""
    place = F.substring(F.regexp_replace(F.trim(F.coalesce(subject, F.lit("project"))), r"[^\w.:/@_+-]+", "_"), 1, 200)
    place = F.when(F.length(place) > 120, F.concat(F.substring(place, 1, 119), F.lit("…"))).otherwise(place)
    return F.concat(
        F.lit("Captured "), token(provider, "unknown"), F.lit(" "), token(hook, "unknown"), F.lit(" evidence ("), token(F.coalesce(kind, F.lit("transcript")), "transcript"),
        F.lit(", "), token(F.coalesce(media, F.lit("application/json")), "application/json"), F.lit(") for "), place, F.lit("."),
    )
