"""Records around the log: aliases, support, imports, exports, indexes, rendered notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.functions import text as T
from loamlog.sources import log as L

#: Prefixes of payload ids by event type, least length of exported statements.
PAYLOAD_PREFIX = {"EvidenceArtifact": "art_", "Observation": "obs_", "Claim": "clm_", "AcceptanceDecision": "dec_", "Supersession": "sup_"}
EXPORT_LENGTH = 8


def payload_id(log_type: Column, n: Column) -> Column:
    prefixes = F.create_map(*[F.lit(x) for pair in PAYLOAD_PREFIX.items() for x in pair])
    return F.concat(prefixes[log_type], n.cast("string"))


def aliases(log: DataFrame) -> DataFrame:
    """alias -> event_id: events answer to their own id and to their payload's."""
    both = F.array(F.col("event_id"), payload_id(F.col("event_type"), F.col("n")))
    return log.select(F.explode(both).alias("alias"), "event_id")


def resolved_support(log: DataFrame) -> DataFrame:
    """Claims and what their support resolves to; references go by payload id for even
    targets and by event id for odd ones. What does not resolve falls back to the claim."""
    target = log.select(F.col("n").alias("t"), F.col("event_type").alias("tt"))
    claims = log.where("event_type = 'Claim'").join(target, F.col("target_n") == F.col("t"), "left")
    ref = F.when(F.col("target_n") % 2 == 0, payload_id(F.col("tt"), F.col("t"))).otherwise(F.col("target_id"))
    rows = claims.select(F.col("event_id").alias("claim_id"), ref.alias("alias"))
    found = rows.join(aliases(log), "alias", "left")
    return found.select("claim_id", F.coalesce("event_id", "claim_id").alias("support_id"), F.col("event_id").isNotNull().alias("resolved"))


def latest_writers(log: DataFrame) -> DataFrame:
    """First and last event of each subject and type: maps keep the last writer, decisions
    the first. min_by and max_by combine on the map side; no window is needed."""
    order = F.struct("recorded", "n")
    return log.groupBy("subject", "event_type").agg(F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"), F.count("*").alias("n_events"))


def bundle(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Portable bundle: the newest active statements, or all, each text once (the newest stands)."""
    units = log.where("event_type IN ('Observation', 'Claim') AND lifecycle = 'active'").withColumn("key", T.statement_key(F.col("statement"))).where(F.length("key") >= EXPORT_LENGTH)
    newest = units.groupBy("key").agg(F.max_by(F.struct("event_id", "event_type", "statement"), F.struct("recorded", "n")).alias("u"), F.max(F.struct("recorded", "n")).alias("at"))
    newest = newest if limit is None else newest.orderBy(F.desc("at")).limit(limit)
    return newest.select("u.event_id", "u.event_type", "u.statement", F.sha2("u.statement", 256).alias("idempotency_key"))


def bundle_import(log: DataFrame, rows: DataFrame) -> DataFrame:
    """What of a bundle is new: keys that no statement of the log has, counted by outcome."""
    have = log.where("statement IS NOT NULL").select(F.sha2("statement", 256).alias("idempotency_key")).distinct().withColumn("known", F.lit(True))
    status = F.when(F.length(F.trim("statement")) < EXPORT_LENGTH, "too_short").when(F.col("known"), "skipped").otherwise("imported")
    return rows.join(have, "idempotency_key", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def import_rows(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The events to append for a bundle: drafts under ids from their keys, so that importing
    it again adds none; statements that are too short or known are left out."""
    have = log.where("statement IS NOT NULL").select(F.sha2("statement", 256).alias("idempotency_key")).distinct()
    new = rows.where(F.length(F.trim("statement")) >= EXPORT_LENGTH).join(have, "idempotency_key", "left_anti")
    return new.select(T.content_id("evt_", 32, F.lit("import"), F.col("idempotency_key")).alias("event_id"), "event_type", "statement", F.lit("draft").alias("lifecycle"), "idempotency_key")


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_id, status of an index rebuild: added, kept, changed or stale."""
    o = old.select("chunk_id", F.col("text_digest").alias("before"))
    n = new.select("chunk_id", F.col("text_digest").alias("after"))
    status = F.when(F.col("after").isNull(), "stale").when(F.col("before").isNull(), "added").when(F.col("before") != F.col("after"), "changed").otherwise("kept")
    return o.join(n, "chunk_id", "full").select("chunk_id", status.alias("status"))


def source_records(log: DataFrame) -> DataFrame:
    """Events as the source records of chunks: their own and their target's, sorted by zone,
    padded sequence, kind and id; with the status and authority a chunk derives from them."""
    seq = L.sequenced(log)
    record = lambda p="": F.struct(F.col(f"{p}zone").alias("zone"), F.lpad(F.col(f"{p}zone_sequence").cast("string"), 16, "0").alias("seq"), F.col(f"{p}event_type").alias("kind"), F.col(f"{p}event_id").alias("id"), F.col(f"{p}lifecycle").alias("lifecycle"), F.col(f"{p}authority").alias("authority"))
    other = seq.select(*[F.col(c).alias(f"t_{c}") for c in ("event_id", "zone", "zone_sequence", "event_type", "lifecycle", "authority")])
    rows = seq.join(other, F.col("target_id") == F.col("t_event_id"), "left")
    records = F.array_sort(F.array_distinct(F.filter(F.array(record(), F.when(F.col("t_event_id").isNotNull(), record("t_"))), lambda r: r.isNotNull())))
    rows = rows.select("event_id", records.alias("r"))
    has = lambda a: F.exists("r", lambda x: x["authority"] == a)
    authority = F.when(has("verified"), "verified").when(has("derived"), "derived").otherwise(F.col("r")[0]["authority"])
    return rows.select(
        "event_id", F.size("r").alias("n_records"), F.array_join(F.transform("r", lambda x: x["id"]), ",").alias("ids"),
        F.when(F.exists("r", lambda x: x["lifecycle"] == "draft"), "draft").otherwise("active").alias("lifecycle"), authority.alias("authority"),
    )


def yaml_scalar(x: Column) -> Column:
    """A double-quoted YAML scalar."""
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def notes(log: DataFrame, category: DataFrame) -> DataFrame:
    """A Markdown note with front matter per claim, its path and digest."""
    rows = log.where("event_type = 'Claim'").join(category.select("event_id", "category"), "event_id")
    body = F.concat(
        F.lit("---\nid: "), yaml_scalar(F.col("event_id")), F.lit("\nzone: "), yaml_scalar(F.col("zone")), F.lit("\ncategory: "), F.col("category"),
        F.lit("\n---\n# "), T.one_line(F.col("statement")), F.lit("\n\nSubject: [["), F.col("subject"), F.lit("]]\n"),
    )
    path = F.concat(F.lit("claims/"), F.col("category"), F.lit("/"), F.col("event_id"), F.lit(".md"))
    return rows.select(path.alias("path"), body.alias("body"), F.sha2(body, 256).alias("digest"))


def dashboard(loops: DataFrame) -> DataFrame:
    """One Markdown line per kind of open loop, largest id first shown as the example."""
    out = loops.groupBy("kind").agg(F.count("*").alias("n"), F.max("loop_id").alias("example"))
    return out.select("kind", F.concat(F.lit("- "), "kind", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), "example", F.lit(")")).alias("line"))


def missing_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of an earlier manifest that a new plan no longer has."""
    return before.select("path").join(after.select("path"), "path", "left_anti")


def resolve_unit(full: Column, summary: Column, embedding_ref: Column, level: str, most: int) -> Column:
    """The best resolution allowed: R3 full text if it fits, R2 summary, R1 reference, R0 id."""
    rank = ("R0", "R1", "R2", "R3").index(level)
    cut = F.when(F.length(summary) <= most, summary).otherwise(F.concat(F.substring(summary, 1, max(0, most - 1)), F.lit("…")))
    out = F.struct(F.lit("R0").alias("level"), F.lit(None).cast("string").alias("text"))
    if rank >= 1:
        out = F.when(embedding_ref.isNotNull(), F.struct(F.lit("R1").alias("level"), F.lit(None).cast("string").alias("text"))).otherwise(out)
    if rank >= 2:
        out = F.struct(F.lit("R2").alias("level"), cut.alias("text"))
    if rank >= 3:
        out = F.when(full.isNotNull() & (F.length(full) <= most), F.struct(F.lit("R3").alias("level"), full.alias("text"))).otherwise(out)
    return out


def neighbourhood_paths(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Seeds with a provenance path of at least two references, and the longest found."""
    from loamlog.operators.graph import walk

    return walk(seeds, links, depth, directed=True).groupBy("seed").agg(F.max("hop").alias("longest"), F.count("*").alias("n_reached")).where("longest >= 2")


def proposal_edges(log: DataFrame) -> DataFrame:
    """Proposed edges of new claims: derived_from and about once each, supports as often as cited."""
    rows = log.where("event_type = 'Claim' AND lifecycle = 'draft'")
    derived = rows.where("target_id IS NOT NULL").select(F.lit("derived_from").alias("kind"), F.col("event_id").alias("from_id"), F.col("target_id").alias("to_id")).distinct()
    about = rows.select(F.lit("about").alias("kind"), F.col("event_id").alias("from_id"), T.subject_node(F.col("subject")).alias("to_id")).distinct()
    cited = F.array_repeat(F.col("target_id"), (1 + F.col("k") % 2).cast("int"))
    supports = rows.where("target_id IS NOT NULL").select(F.lit("supports").alias("kind"), F.col("event_id").alias("from_id"), F.explode(cited).alias("to_id"))
    return derived.unionAll(about).unionAll(supports)


def backfill(log: DataFrame, limit: int) -> DataFrame:
    """Evidence not yet in the feed, in order, until ``limit`` rows are pending; the rows
    skipped on the way count nothing.

    Days are summed first, so the running count is a small window over days plus one within
    each day.
    """
    rows = log.where("event_type = 'EvidenceArtifact' AND n % 4 <> 0").withColumn("pending", (F.col("k") % 3 > 0).cast("int")).withColumn("day", F.to_date("recorded"))
    days = rows.groupBy("day").agg(F.sum("pending").alias("s"))
    earlier = F.coalesce(F.sum("s").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(days.select("day", earlier.alias("before")), "day")
    before = F.col("before") + F.coalesce(F.sum("pending").over(Window.partitionBy("day").orderBy("recorded", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("ahead", before).where(F.col("ahead") < limit).select("event_id", F.when(F.col("pending") == 1, "pending").otherwise("skipped").alias("state"))


def context_pack(log: DataFrame, max_items: int, max_chars: int, most_of_key: int = 8) -> DataFrame:
    """Per subject the records of its context pack, by section slots, then what is left over,
    within a budget; an item that does not fit is skipped and later ones may still fit. Of one
    diversity key, here the claim or other record that is referred to, a section takes
    ``most_of_key`` at most.

    What goes to a subject's group is bounded and loses nothing. The budget only shrinks, so of
    equal size, section and key none is taken after one that did not fit: ``most_of_key`` at
    most, the first ones. Of equal size and section ``max_items`` are taken at most, and before
    them stand no more than the rows of keys that are used up. What is larger than the whole
    budget is never taken.
    """
    import pandas as pd

    from loamlog.operators.facts import classify

    slots = {"accepted": 6, "conflict": 2, "supersession": 1, "observation": 4, "evidence": 1, "draft": 0, "rejected": 0, "erasure": 0}
    rows = log.join(classify(log).select("event_id", "section"), "event_id").where(F.col("section").isin(*slots))
    text = F.coalesce("statement", F.concat(F.lit("Record "), "event_id"))
    rows = rows.select("subject", "section", "event_id", "recorded", F.length(text).alias("size"), F.coalesce("target_id", "event_id").alias("key")).where(F.col("size") <= max_chars)
    keyed = F.row_number().over(Window.partitionBy("subject", "section", "size", "key").orderBy(F.desc("recorded"), "event_id"))
    alike = F.row_number().over(Window.partitionBy("subject", "section", "size").orderBy(F.desc("recorded"), "event_id"))
    few = rows.withColumn("r", keyed).where(F.col("r") <= most_of_key).withColumn("r", alike).where(F.col("r") <= max_items + most_of_key * (max_items // most_of_key)).drop("r")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["recorded", "event_id"], ascending=[False, True])
        queues: dict[str, list] = {s: [] for s in slots}
        for r in pdf[["section", "event_id", "size", "key"]].itertuples(index=False):
            queues[r.section].append(r)
        met: dict = {}
        out, used = [], 0
        for most in (slots, dict.fromkeys(slots, max_items)):
            for section in slots:
                taken, rest = 0, []
                for r in queues[section]:
                    if taken < most[section]:
                        if len(out) < max_items and used + r.size <= max_chars and met.get((section, r.key), 0) < most_of_key:
                            out.append((pdf["subject"].iloc[0], section, r.event_id, len(out) + 1))
                            used += r.size
                            taken += 1
                            met[section, r.key] = met.get((section, r.key), 0) + 1
                    else:
                        rest.append(r)
                queues[section] = rest
        return pd.DataFrame(out, columns=["subject", "section", "event_id", "place"])

    return few.groupBy("subject").applyInPandas(pack, "subject string, section string, event_id string, place int")
