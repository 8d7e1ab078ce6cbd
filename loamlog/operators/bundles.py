"""Portable bundles: concepts, index and log documents, conformance; digests of what was derived
from what; compaction summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.functions import prose as P
from loamlog.functions import text as T
from loamlog.operators import facts
from loamlog.sources import log as L

#: Fixed values of bundles.
FOLDERS = {"Claim": "claims", "Observation": "observations", "EvidenceArtifact": "evidence"}
RESERVED = ("index.md", "log.md", "manifest.json")
SUMMARY_CHARS = 2000


def path_of(kind: Column, event_id: Column) -> Column:
    folders = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    return F.concat(folders[kind], F.lit("/"), event_id, F.lit(".md"))


def concepts(log: DataFrame, zone: str) -> DataFrame:
    """path, type, title, source_path, event_id: accepted claims of a zone, its active
    observations that stand, and the evidence that these refer to, each once."""
    stands = facts.eligible(log).where(F.col("zone") == zone)
    accepted = facts.claim_category(log).where("category = 'accepted'").select("event_id")
    claims = stands.where("event_type = 'Claim'").join(accepted, "event_id", "left_semi")
    units = claims.unionByName(stands.where("event_type = 'Observation'"))
    evidence = stands.where("event_type = 'EvidenceArtifact'").join(units.select(F.col("target_id").alias("event_id")).distinct(), "event_id", "left_semi")
    rows = units.unionByName(evidence)
    kinds = log.select(F.col("event_id").alias("t"), F.col("event_type").alias("t_type"))
    linked = rows.join(kinds, F.col("target_id") == F.col("t"), "left")
    title = F.coalesce(T.one_line(F.col("statement"), 80), F.concat(F.lit("Evidence of "), "subject"))
    target = F.when(F.col("event_type") != "EvidenceArtifact", path_of(F.col("t_type"), F.col("t")))
    return linked.select(path_of(F.col("event_type"), F.col("event_id")).alias("path"), F.lower("event_type").alias("type"), title.alias("title"), target.alias("source_path"), "event_id")


def documents_of(rows: DataFrame) -> DataFrame:
    """path, body of each concept's Markdown file."""
    link = F.when(F.col("source_path").isNotNull(), F.concat(F.lit("\nSource: [source](../"), "source_path", F.lit(")\n"))).otherwise("")
    body = F.concat(F.lit("---\ntype: "), "type", F.lit("\ntitle: "), F.col("title"), F.lit("\n---\n# "), "title", F.lit("\n"), link)
    return rows.select("path", body.alias("body"))


def index_lines(rows: DataFrame) -> DataFrame:
    """section, path, line: the index document, one row a line in the order of (section, path).

    The document stays in rows: as one text it would be one row of the size of the bundle.
    """
    section = F.element_at(F.split("path", "/"), 1)
    return rows.select(section.alias("section"), "path", F.concat(F.lit("* ["), "title", F.lit("]("), "path", F.lit(") - "), "type").alias("line"))


def log_line(rows: DataFrame, day: str) -> DataFrame:
    """The update log's entry for an export."""
    return rows.agg(F.count("*").alias("n")).select(F.lit(day).alias("day"), F.concat(F.lit("* **Export**: "), F.col("n").cast("string"), F.lit(" concepts.")).alias("line"))


def conformance(files: DataFrame) -> DataFrame:
    """path, code, severity: unsafe, reserved, duplicate and non-Markdown paths, missing front
    matter fields, and links: out of the bundle is an error, to no file a warning."""
    safe = ~F.col("path").startswith("/") & ~F.col("path").contains("..") & ~F.col("path").contains("\\") & (F.col("path") != "")
    codes = F.array_compact(F.array(
        F.when(~safe, F.struct(F.lit("invalid_path").alias("code"), F.lit("error").alias("severity"))),
        F.when(safe & F.col("path").isin(*RESERVED), F.struct(F.lit("reserved_path").alias("code"), F.lit("error").alias("severity"))),
        F.when(safe & ~F.col("path").endswith(".md") & ~F.col("path").isin(*RESERVED), F.struct(F.lit("not_markdown").alias("code"), F.lit("error").alias("severity"))),
        F.when(~F.col("body").rlike(r"^---\n(?s:.*?)\n---\n"), F.struct(F.lit("invalid_front_matter").alias("code"), F.lit("error").alias("severity"))),
        F.when(F.col("body").rlike(r"^---\n") & ~F.col("body").rlike(r"\ntype: \S"), F.struct(F.lit("missing_type").alias("code"), F.lit("error").alias("severity"))),
    ))
    own = files.select("path", F.explode(codes).alias("x")).select("path", "x.code", "x.severity")
    twice = files.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate_path").alias("code"), F.lit("error").alias("severity"))
    links = files.select("path", F.explode(F.regexp_extract_all("body", F.lit(r"\]\(([^)]+)\)"), F.lit(1))).alias("link")).where(~F.col("link").rlike("^[a-z]+:"))
    to = F.regexp_replace("link", r"^\.\./", "")
    outside = links.where(to.contains("..")).select("path", F.lit("link_escapes_bundle").alias("code"), F.lit("error").alias("severity"))
    known = files.select(F.col("path").alias("to")).distinct()
    loose = links.withColumn("to", to).where(~F.col("to").contains("..")).join(known, "to", "left_anti").select("path", F.lit("unresolved_link").alias("code"), F.lit("warning").alias("severity"))
    return own.unionAll(twice).unionAll(outside).unionAll(loose).distinct()


def derivations(log: DataFrame, config: dict[str, str]) -> DataFrame:
    """event_id, config_digest, input_digest, latest_recorded of what is derived from an event
    and the one it refers to: digests of stable JSON, sources in normalized order."""
    seq = L.sequenced(log)
    side = lambda p="": F.struct(F.col(f"{p}zone").alias("zone"), F.lpad(F.col(f"{p}zone_sequence").cast("string"), 16, "0").alias("sequence"), F.col(f"{p}event_id").alias("id"), F.date_format(f"{p}recorded", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("recorded"))
    other = seq.select(*[F.col(c).alias(f"t_{c}") for c in ("event_id", "zone", "zone_sequence", "recorded")])
    rows = seq.join(other, F.col("target_id") == F.col("t_event_id"), "left")
    records = F.array_sort(F.array_distinct(F.array_compact(F.array(side(), F.when(F.col("t_event_id").isNotNull(), side("t_"))))))
    settings = P.stable_json(**{k: F.lit(v) for k, v in config.items()})
    manifest = F.to_json(F.transform(records, lambda r: F.struct(r["id"].alias("id"), r["sequence"].alias("sequence"), r["zone"].alias("zone"))))
    return rows.select("event_id", P.digest(settings).alias("config_digest"), P.digest(manifest).alias("input_digest"), F.array_max(F.transform(records, lambda r: r["recorded"])).alias("latest_recorded"))


def compaction(log: DataFrame, most: int = SUMMARY_CHARS) -> DataFrame:
    """One summary per zone and day: the day's statements in order, joined by line ends and cut
    to ``most`` characters with an ellipsis, and what of the budget was used and left out.

    Only statements that begin within the budget are gathered, so a summary's row is bounded.
    """
    rows = log.where("statement IS NOT NULL").select("zone", F.date_format("recorded", "yyyy-MM-dd").alias("day"), "event_id", "recorded", "n", F.trim("statement").alias("text"))
    ordered = Window.partitionBy("zone", "day").orderBy("recorded", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(ordered), F.lit(0)))
    part = F.when(F.col("at") <= most, F.struct("at", "n", "text"))
    out = placed.groupBy("zone", "day").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.count("*").alias("n_items"), (F.sum(F.length("text") + 1) - 1).alias("full"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    summary = F.when(F.col("full") > most, F.concat(F.substring(joined, 1, most - 1), F.lit("…"))).otherwise(joined)
    out = out.withColumn("summary", summary)
    cid = F.concat(F.lit("cmp_"), F.substring(F.sha2(P.stable_json(zone=F.col("zone"), created=F.col("day"), summary=F.sha2("summary", 256)), 256), 1, 32))
    return out.select(cid.alias("compaction_id"), "zone", "day", "n_items", F.length("summary").cast("long").alias("used_characters"), (F.col("full") > most).alias("truncated"), F.greatest(F.lit(0), F.col("full") - F.length("summary")).cast("long").alias("omitted_characters"))


def tree_digest(rows: DataFrame, key: str, content: Column, width: int = 4096, levels: int = 3) -> DataFrame:
    """Digest of a whole corpus by ids: digests of ``width`` neighbours, joined in the order of
    the id, are digested again, ``levels`` times. No list is longer than ``width``."""
    level = rows.select(F.col(key).cast("long").alias("id"), F.sha2(content, 256).alias("d"))
    for _ in range(levels):
        listed = F.sort_array(F.collect_list(F.struct("id", "d")))
        level = level.groupBy(F.floor(F.col("id") / width).cast("long").alias("up")).agg(listed.alias("l")).select(F.col("up").alias("id"), F.sha2(F.array_join(F.transform("l", lambda x: x["d"]), ""), 256).alias("d"))
    return level.select("id", F.col("d").alias("digest"))
