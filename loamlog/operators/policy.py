"""Deterministic text policies: front gate, adjudication, grounding, promotion gate, rubrics."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.functions import prose as P
from loamlog.functions import text as T
from loamlog.operators.components import checkpointed

#: Fixed values of the policies.
PROMOTE_HOOKS = ("Stop", "SessionEnd", "PreCompact")
HOLD_HOOKS = ("UserPromptSubmit",)
PROMOTE_KINDS = ("decision", "constraint", "preference")
HOLD_REASONS = {"open_question": "open_question_side_channel", "procedure": "procedure_hold_biased_v1", "fact_candidate": "fact_candidate_not_in_v1_allowlist"}
#: Candidate spans: characters of a signal and of a span, and spans of a signal.
SOURCE_CHARS, SPAN_CHARS, SPANS = 1200, 240, 3
#: value, durability, risk and noise of what is rejected out of hand.
REJECTED = {
    "secret_like_material": (0.0, 0.0, 1.0, 0.5), "post_tool_use_noise": (0.1, 0.1, 0.2, 0.95), "lifecycle_not_eligible": (0.25, 0.3, 0.1, 0.8),
    "noise_only_signal": (0.05, 0.05, 0.1, 0.95),
}
LENGTH_FACTOR, OVERLAP, COVERAGE, CONFIDENCE = 3, 0.35, 0.6, 0.55


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(0.0))))


def front_gate(rows: DataFrame) -> DataFrame:
    """case_id, hook, signal -> normalized hook, pass or drop, reason, residual text."""
    signal = F.trim(F.coalesce("signal", F.lit("")))
    base = T.with_residual(rows.withColumns({"hook": T.hook(F.col("hook")), "s": signal}), "s", "r")
    text = F.trim(F.array_join("r.kept", "\n"))
    dropped_only = F.when((F.col("r.secret") > 0) & (F.col("r.tool") == 0) & (F.col("r.telemetry") == 0), "secret_like_material").when(
        (F.col("r.tool") > 0) | (F.col("r.telemetry") > 0),
        F.when((F.col("r.telemetry") > 0) & (F.col("r.tool") == 0), "telemetry_only_signal").otherwise("tool_noise_signal"),
    ).otherwise("noise_only_signal")
    reason = (
        F.when(F.col("s") == "", "empty_signal").when(F.col("s").rlike(T.INJECTION), "injection_or_exfil_pattern")
        .when(F.col("hook") == "PostToolUse", "post_tool_use_noise").when(F.col("s").rlike(T.NOISE_LINE), "noise_only_signal")
        .when(~F.col("hook").isin(*T.LIFECYCLE_HOOKS), "lifecycle_not_eligible").when(F.size("r.kept") == 0, dropped_only)
        .when(F.length(text) < 8, "signal_too_short").when(text.rlike(T.NOISE_LINE), "noise_only_signal")
    )
    out = base.withColumn("reason", F.coalesce(reason, F.lit("front_v1_pass")))
    passed = F.col("reason") == "front_v1_pass"
    return out.select("case_id", "hook", F.when(passed, "pass").otherwise("drop").alias("decision"), "reason", F.when(passed, text).alias("residual"))


def flat_start(signal: Column) -> Column:
    """What candidate spans are taken from."""
    return F.substring(P.flat(F.coalesce(signal, F.lit(""))), 1, SOURCE_CHARS)


def candidate_spans(signal: Column) -> Column:
    """Up to three sentences of twelve characters and more that name a kind, each cut to 240,
    as structs of kind and text; none of noise, secrets or structured dumps."""
    return spans_of(flat_start(signal))


def spans_of(flat: Column) -> Column:
    """``candidate_spans`` of a signal's ``flat_start``, which is read many times and should be a
    column computed before."""
    refused = (flat == "") | flat.rlike(T.NOISE_SIGNAL) | T.secret_material(flat) | flat.rlike(P.DUMP)
    parts = F.when(~refused, F.split(F.regexp_replace(flat, "([.!?]+) ", "$1\u0001"), "\u0001")).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.transform(parts, lambda x: F.trim(x)), lambda x: F.struct(T.kind_of(x).alias("kind"), F.trim(F.substring(x, 1, SPAN_CHARS)).alias("text"), F.length(x).alias("length")))
    return F.slice(F.filter(named, lambda x: x["kind"].isNotNull() & (x["length"] >= 12)), 1, SPANS)


def adjudicate(rows: DataFrame) -> DataFrame:
    """case_id, hook, signal, provider, subject -> disposition, reasons, the four scores and the
    statement that a promote or hold would write.

    Fixed scores belong to what is rejected out of hand; else value, durability and noise add up
    from the hook, the words and the length of the signal, and 0.45 of their weighted sum
    promotes what has a span, 20 characters and a boundary hook.
    """
    base = rows.withColumns({"s": F.trim(F.coalesce("signal", F.lit(""))), "h": T.hook(F.col("hook")), "flat": flat_start(F.col("signal"))})
    base = T.computed(base, "flat").withColumn("spans", spans_of(F.col("flat")))
    base = T.computed(base, "spans")
    s, hook, span = F.col("s"), F.col("h"), F.try_element_at("spans", F.lit(1))
    metadata = P.metadata_statement(F.col("provider"), F.col("hook"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("subject"))
    has = F.size("spans") > 0
    statement = F.when(has, F.concat(metadata, F.lit(" Knowledge fragment ("), span["kind"], F.lit("): "), span["text"])).otherwise(metadata)
    base = base.withColumns({"statement": statement, "has": has, "n": F.length(s)})
    n, boundary, holding = F.col("n"), hook.isin(*PROMOTE_HOOKS), hook.isin(*HOLD_HOOKS)
    secret = T.secret_material(F.col("statement")) | T.secret_material(s)
    terms = s.rlike(T.VALUE_TERMS) | F.col("statement").rlike(T.VALUE_TERMS)
    base = base.withColumns({"terms": terms, "early": (
        F.when(secret, "secret_like_material").when(hook == "PostToolUse", "post_tool_use_noise").when(~boundary & ~holding, "lifecycle_not_eligible")
        .when((n > 0) & s.rlike(T.NOISE_SIGNAL), "noise_only_signal")
    )})
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    terms, early = F.col("terms"), F.col("early")
    value = F.lit(0.25) + add(boundary, 0.35) + add(holding, 0.15) + add(terms, 0.3) + add(n >= 40, 0.1)
    scores = {
        "value": F.when(n == 0, F.least(value, F.lit(0.45))).otherwise(value), "durability": F.lit(0.3) + add(boundary, 0.35) + add(holding, 0.1) + add(terms, 0.2) + add(n >= 40, 0.1),
        "risk": F.lit(0.1), "noise": F.lit(0.4) + add(holding, 0.15) + add((n > 0) & (n < 12), 0.25) + add(n == 0, 0.2),
    }
    for i, (name, score) in enumerate(scores.items()):
        out = clamp(score)
        for reason, fixed in REJECTED.items():
            out = F.when(early == reason, fixed[i]).otherwise(out)
        scores[name] = F.round(out, 6)
    base = base.withColumns(scores).withColumn("score", F.col("value") * 0.5 + F.col("durability") * 0.4 - F.col("noise") * 0.35 - F.col("risk") * 0.5)
    promote = F.col("has") & (F.col("score") >= 0.45 - 1e-9) & (F.col("value") >= 0.5) & (F.col("noise") < 0.55) & boundary & (n >= 20)
    base = base.withColumn("disposition", F.when(early.isNotNull(), "reject").when(promote, "promote").otherwise("hold"))
    reasons = F.array_compact(F.array(
        F.when(~F.col("has"), "no_safe_candidate_span"), F.when(boundary, "lifecycle_boundary_signal"), F.when(holding, "user_prompt_needs_review"), F.when(terms, "value_terms"),
        F.when(n >= 40, "signal_length").when((n > 0) & (n < 12), "short_signal"), F.when(n == 0, "metadata_only_weak"),
        F.when(F.col("disposition") == "promote", "promote_threshold").otherwise("hold_for_review"),
    ))
    return base.select(
        "case_id", "disposition", F.coalesce(early, F.array_join(reasons, ",")).alias("reasons"), *scores, span["kind"].alias("kind"), "statement",
        F.when(F.col("disposition") == "promote", "active").otherwise("draft").alias("lifecycle"),
    )


def observation_plan(rows: DataFrame) -> DataFrame:
    """case_id, hook, provider, subject -> whether an observation of fixed form is extracted
    from the capture, and its statement."""
    hook = F.when(F.trim("hook") == "", "unknown").otherwise(F.trim("hook"))
    fits = T.hook(F.col("hook")).isin(*PROMOTE_HOOKS, *HOLD_HOOKS)
    statement = P.metadata_statement(F.col("provider"), hook, F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("subject"))
    return rows.select(
        "case_id", F.when(fits, "extract").otherwise("skip").alias("status"), F.when(fits, "observation").otherwise("none").alias("target"), F.when(fits, statement).alias("statement"),
    )


def grounded(statement: Column, quote: Column) -> Column:
    """Why a statement is or is not grounded in its quote, by length, containment, overlap.

    The numerator of both overlap measures counts repeated tokens of the statement.
    """
    s, q = T.grounding_text(statement), T.grounding_text(quote)
    a, b = T.grounding_tokens(s), F.array_distinct(T.grounding_tokens(q))
    inter = F.size(F.filter(a, lambda t: F.array_contains(b, t)))
    overlap = inter / F.size(F.array_union(a, b))
    return (
        F.when(F.length(s) < 8, "statement_too_short_for_grounding").when(F.trim(quote) == "", "no_quote_for_grounding")
        .when(F.length(s) > F.length(q) * LENGTH_FACTOR, "statement_longer_than_cited_span")
        .when((F.length(q) > 0) & (F.contains(q, s) | F.contains(s, q)), "statement_grounded_containment")
        .when((F.size(a) == 0) | (F.size(b) == 0), "statement_ungrounded_empty_tokens")
        .when((overlap >= OVERLAP) | (inter / F.size(a) >= COVERAGE), "statement_grounded_overlap").otherwise("statement_not_grounded_in_citations")
    )


def gate(rows: DataFrame) -> DataFrame:
    """case_id, kind, statement, quote, pack, confidence -> grounding reason, decision, reason."""
    quoted = F.trim(F.coalesce("quote", F.lit("")))
    base = rows.withColumns({"q": quoted, "grounding": grounded(F.col("statement"), quoted)})
    in_pack = (F.col("q") != "") & F.contains(F.col("pack"), F.col("q"))
    cited = in_pack & F.col("grounding").isin("statement_grounded_containment", "statement_grounded_overlap")
    secret = F.col("statement").rlike(T.SECRET) | F.col("q").rlike(T.SECRET)
    holds = F.create_map(*[F.lit(x) for pair in HOLD_REASONS.items() for x in pair])
    sure = F.col("confidence").isNull() | (F.col("confidence") >= CONFIDENCE)
    outcome = (
        F.when(secret, "reject:secret_like_material").when(~cited, "reject:missing_or_failed_citation")
        .when(F.length(F.trim("statement")) < 8, "reject:statement_too_short").when(holds[F.col("kind")].isNotNull(), F.concat(F.lit("hold:"), holds[F.col("kind")]))
        .when(~F.col("kind").isin(*PROMOTE_KINDS), "hold:kind_not_in_usable_allowlist").when(sure, "promote:promote_when_verified").otherwise("hold:hold_confidence_or_features")
    )
    out = base.withColumn("o", F.split(outcome, ":"))
    return out.select("case_id", "grounding", F.col("o")[0].alias("decision"), F.col("o")[1].alias("reason"))


def contradictions(rows: DataFrame) -> DataFrame:
    """Pairs of one subject whose statements contradict: never against always or must, allow
    against forbid, with two longer tokens in common.

    Pairs meet by subject and a shared token, never as all pairs of a subject.
    """
    s = F.lower("statement")
    negation = F.array(*[F.lit(x) for x in ("never", "must", "always", "should")])
    tokens = F.array_distinct(F.filter(F.split(s, "[^a-z0-9]+"), lambda t: (F.length(t) > 3) & ~F.array_contains(negation, t)))
    said = lambda *w: s.rlike(T.words(*w))
    marked = rows.select(
        "subject", "id", F.explode(tokens).alias("token"), said("never", "must not").alias("never"), said("always", "must").alias("always"),
        said("forbid", "forbidden", "prohibit", "ban", "disallow").alias("forbid"), said("allow", "allowed", "permit", "permitted").alias("allow"),
    ).where("never OR always OR forbid OR allow")
    right = marked.select("subject", "token", *[F.col(c).alias(f"{c}2") for c in ("id", "never", "always", "forbid", "allow")])
    polar = (F.col("never") & F.col("always2")) | (F.col("never2") & F.col("always"))
    rule = (F.col("forbid") & F.col("allow2")) | (F.col("forbid2") & F.col("allow"))
    pairs = marked.join(right, ["subject", "token"]).where((F.col("id") < F.col("id2")) & (polar | rule)).groupBy("subject", "id", "id2").agg(F.count("*").alias("shared"), F.max(polar).alias("polar"))
    return pairs.where("shared >= 2").select("subject", F.col("id").alias("left_id"), F.col("id2").alias("right_id"), F.when(F.col("polar"), "polarity_never_vs_must").otherwise("allow_vs_forbid").alias("code"))


def duplicate_statements(rows: DataFrame) -> DataFrame:
    """Groups of equal normalized statements per subject: which to keep (active first, then
    smallest id), how many there are. Statements under 8 characters are left out."""
    keyed = T.computed(rows.withColumn("key", T.statement_key(F.col("statement"))), "key").where(F.length("key") >= 8)
    rank = F.when(F.col("lifecycle") == "active", 0).when(F.col("lifecycle") == "draft", 1).otherwise(2)
    return keyed.groupBy(F.lower("subject").alias("subject"), F.sha2("key", 256).alias("key")).agg(F.min_by("id", F.struct(rank, F.col("id"))).alias("keep_id"), F.count("*").alias("n_statements")).where("n_statements > 1")


def before(rows: DataFrame, by: list[str], value: Column, total: Callable[[Column], Column], into: str) -> DataFrame:
    """``total`` of ``value`` over the rows of the same ``by`` with a smaller number.

    Slices are totalled on their own and the earlier slices' totals are added, so no group
    has to fit into one task. ``by`` must not be null.
    """
    parts = rows.groupBy(*by, "slice").agg(total(value).alias("_part"))
    earlier = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*by, "slice").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "slice", total(F.col("_part")).over(earlier).alias("_earlier"))
    both = F.array_compact(F.array("_earlier", "_within"))
    whole = F.aggregate(both, F.lit(0).cast("long"), lambda x, y: x + y) if total is F.sum else F.array_max(both)
    return rows.withColumn("_within", total(value).over(within)).join(parts, [*by, "slice"]).withColumn(into, whole).drop("_within", "_earlier")


#: Rows of a zone that one task walks through in order.
HOLD_SLICE = 20_000


def held_in_order(rows: DataFrame, recent: int, size: int) -> DataFrame:
    """(place, number) of the rows (place, slice, number, key) that are held.

    A slice is ``size`` numbers of a place. It is walked in order from what the slice before it
    leaves behind: the keys of the last ``recent`` promotes. All are walked from nothing at first;
    those that were given something else than is now left behind are walked again, until none
    is. What a slice is given matters little beyond ``recent`` promotes, so few are walked often.
    """
    kinds = "place string, slice long, number long, keys array<string>, lasts array<long>, from_keys array<string>, from_lasts array<long>"

    def run(table: pa.Table) -> pa.Table:
        rows = table.filter(pc.is_valid(table.column("number"))).sort_by("number")
        place, at = table.column("place")[0].as_py(), table.column("slice")[0].as_py()
        given = table.filter(pc.is_null(table.column("number")))
        keys, lasts = given.column("keys")[0].as_py(), given.column("lasts")[0].as_py()
        last, held = dict(zip(keys, lasts, strict=True)), []
        for number, key in zip(rows.column("number").to_pylist(), rows.column("key").to_pylist(), strict=True):
            turn = number - at * size - len(held)
            if turn - last.get(key, turn - recent - 1) <= recent:
                held.append(number)
            else:
                last[key] = turn
        end = size - len(held)
        left = sorted((t - end, k) for k, t in last.items() if end - t <= recent)
        n = len(held)
        columns = [[place] * (n + 1), [at] * (n + 1), [*held, None], [*[None] * n, [k for _, k in left]], [*[None] * n, [t for t, _ in left]], [*[None] * n, keys], [*[None] * n, lasts]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    texts, numbers = pa.list_(pa.string()), pa.list_(pa.int64())
    shape = pa.schema([("place", pa.string()), ("slice", pa.int64()), ("number", pa.int64()), ("keys", texts), ("lasts", numbers), ("from_keys", texts), ("from_lasts", numbers)])
    none = [F.lit(None).cast(t) for t in ("array<string>", "array<long>")]
    given = rows.select("place", "slice").distinct().select("place", "slice", F.array().cast("array<string>").alias("keys"), F.array().cast("array<long>").alias("lasts"))
    done, turn = None, 0
    while True:
        asked = rows.join(given.select("place", "slice"), ["place", "slice"], "left_semi").select("place", "slice", "number", "key", none[0].alias("keys"), none[1].alias("lasts"))
        asked = asked.unionByName(given.withColumns({"number": F.lit(None).cast("long"), "key": F.lit(None).cast("string")}))
        walked = checkpointed(asked.groupBy("place", "slice").applyInArrow(run, kinds).withColumn("turn", F.lit(turn)))
        done = walked if done is None else done.unionAll(walked)
        ends = done.where("number IS NULL").groupBy("place", "slice").agg(F.max_by(F.struct("keys", "lasts", "from_keys", "from_lasts", "turn"), "turn").alias("e")).select("place", "slice", "e.*")
        left = ends.select("place", (F.col("slice") + 1).alias("slice"), F.col("keys").alias("k"), F.col("lasts").alias("l"))
        given = ends.join(left, ["place", "slice"]).where("k <> from_keys OR l <> from_lasts").select("place", "slice", F.col("k").alias("keys"), F.col("l").alias("lasts"))
        given, turn = checkpointed(given), turn + 1
        if given.isEmpty():
            return done.where("number IS NOT NULL").join(ends.select("place", "slice", "turn"), ["place", "slice", "turn"], "left_semi").select("place", "number")


def hold_repeats(rows: DataFrame, recent: int = 200, size: int = HOLD_SLICE) -> DataFrame:
    """Holds a statement whose key stood among its zone's ``recent`` last promotes.

    Rows follow one another by ``position``. ``gap`` counts promotes of the zone from the last
    one with the same key; held rows do not count, and statements without a key are never held.
    Whether a row is held changes the distance of later ones, see ``held_in_order``. Only keys
    that repeat in their zone take part in that.
    """
    size = max(size, recent)  # of a slice without repeats nothing of an earlier one is left
    zone = F.coalesce(F.concat(F.lit("="), F.col("zone").cast("string")), F.lit(""))
    keyed = T.computed(rows.select("id", "zone", "position", zone.alias("place"), T.statement_key(F.col("statement")).alias("key")), "key")
    # keys are laid down first: a range partitioning reads its rows twice, once for its bounds
    keyed = checkpointed(keyed.withColumn("key", F.sha2(F.when(F.col("key") != "", F.col("key")), 256)))
    cut = checkpointed(keyed.repartitionByRange("place", "position").withColumn("part", F.spark_partition_id()))
    rank = F.row_number().over(Window.partitionBy("place", "part").orderBy("position", "id", "key"))
    sizes = cut.groupBy("place", "part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("place", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = checkpointed(cut.withColumn("_rank", rank).join(sizes, ["place", "part"]).withColumn("number", F.col("_rank") + F.col("_before")).drop("_rank", "_before", "position", "part"))
    repeated = numbered.where("key IS NOT NULL").groupBy("place", "key").agg(F.count("*").alias("_n")).where("_n > 1").select("place", "key")
    state = checkpointed(numbered.join(repeated, ["place", "key"]).select("place", F.floor(F.col("number") / size).alias("slice"), "number", "key"))
    held = held_in_order(state, recent, size).withColumn("_held", F.lit(True))
    state = checkpointed(state.join(held, ["place", "number"], "left").withColumn("held", F.coalesce("_held", F.lit(False))).drop("_held"))
    turn = F.col("number") - F.coalesce("_held", F.lit(0))
    counted = before(state, ["place"], F.col("held").cast("long"), F.sum, "_held").withColumn("turn", turn)
    since = before(counted, ["place", "key"], F.when(~F.col("held"), F.col("turn")), F.max, "_last").withColumn("gap", F.col("turn") - F.col("_last"))
    out = numbered.join(since.select("place", "number", "held", "gap"), ["place", "number"], "left")
    return out.select("id", "zone", F.when(F.col("held"), "hold").otherwise("promote").alias("decision"), "gap")


def inferred_kind(text: Column) -> Column:
    """constraint, preference, procedure, decision, question or fact: another order and other
    words than those of candidate spans."""
    return (
        F.when(text.rlike(T.words("constraint", "must never")), "constraint").when(text.rlike(T.words("preference", "prefer")), "preference")
        .when(text.rlike(T.words("procedure", "how to")), "procedure").when(text.rlike(T.words("decision", "we (?:will|decided)")), "decision")
        .when(text.contains("?"), "open_question").otherwise("fact_candidate")
    )


def sentences(text: Column, most: int = 3) -> Column:
    """The first sentences of 12 to 240 characters, ``most`` of them."""
    found = F.transform(F.regexp_extract_all(text, F.lit("([^.!?\n]+[.!?]?)"), F.lit(1)), lambda x: F.trim(x))
    return F.slice(F.filter(found, lambda s: F.length(s).between(12, 240)), 1, most)


def best_line(text: Column) -> Column:
    """The line that reads most like knowledge; of equals the longer, then the earlier."""
    lines = F.filter(F.transform(F.split(text, "\n+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 8)
    strong = T.words("decision", "constraint", "preference", "we will", "must never", "require", "prefer")
    score = lambda x: F.when(x.rlike(strong), 6).otherwise(0) - F.when(F.length(x) < 16, 3).otherwise(0) + F.when(F.length(x) >= 40, 2).otherwise(0)
    ranked = F.transform(lines, lambda x, i: F.struct(score(x).alias("score"), F.length(x).alias("length"), (-i).alias("order"), x.alias("line")))
    return F.array_max(ranked)["line"]


def quality_filter(rows: DataFrame) -> DataFrame:
    """case_id, kind, statement, quote, view -> keep, reason: quotes must stand once in the
    view, statements must not restate metadata; kinds that are never promoted pass."""
    q = F.trim(F.coalesce("quote", F.lit("")))
    times = (F.length("view") - F.length(F.replace(F.col("view"), q, F.lit("")))) / F.length(q)
    reason = (
        F.when(~F.col("kind").isin(*PROMOTE_KINDS, "procedure"), "quality_non_promote_kind_passthrough").when(q == "", "quality_empty_quote")
        .when(~F.contains(F.col("view"), q), "quality_quote_not_in_extract_view").when(times > 1, "quality_ambiguous_quote")
        .when(F.col("statement").rlike(T.words("hook captured", "captured from provider")), "quality_metadata_restatement").otherwise("quality_ok")
    )
    return rows.withColumn("reason", reason).select("case_id", F.col("reason").isin("quality_ok", "quality_non_promote_kind_passthrough").alias("keep"), "reason")


def supersession_components(links: DataFrame) -> DataFrame:
    """Components over source, target and replacement of supersessions: members, id by the
    hash of the sorted members, and whether a chain of replacements in it leads back to where
    it began, of any length."""
    from loamlog.operators.components import connected, cyclic_components

    ends = links.select(F.col("source").alias("a"), F.col("target").alias("b")).unionAll(links.where("replacement IS NOT NULL").select(F.col("source").alias("a"), F.col("replacement").alias("b")))
    parts = connected(ends)
    nodes = parts.unionAll(parts.select(F.col("component").alias("node"), "component")).distinct()
    step = links.where("replacement IS NOT NULL").select(F.col("target").alias("a"), F.col("replacement").alias("b")).distinct()
    back = cyclic_components(step, nodes).withColumn("cycle", F.lit(True))
    out = nodes.groupBy("component").agg(F.sort_array(F.collect_set("node")).alias("m")).join(back, "component", "left").withColumn("has_cycle", F.coalesce("cycle", F.lit(False)))
    return out.select(T.content_id("rec_", 16, F.array_join("m", ",")).alias("component_id"), F.array_join("m", ",").alias("members"), "has_cycle")


def on_cycles(step: DataFrame) -> DataFrame:
    """The edges (a, b) that lie on a cycle or between two: edges from where nothing leads, or
    to where nothing goes on, are dropped until none is left to drop."""
    step = checkpointed(step)
    size = step.count()
    while size:
        inner = step.join(step.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(step.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        step = checkpointed(inner.select("a", "b"))
        left = step.count()
        if left == size:
            break
        size = left
    return step


def knowledge_form(rows: DataFrame) -> DataFrame:
    """Adds ``predicted``: reject, insufficient, observation or claim_candidate."""
    bad = T.secret_material(F.col("statement")) | (F.length(F.trim("statement")) < 8) | ~F.col("visible")
    kind = F.when(bad, "reject").when(F.col("evidence") == 0, "insufficient").when(F.col("kind") == "claim", "claim_candidate").otherwise("observation")
    return rows.withColumn("predicted", kind)
