"""Property graph of the log: nodes, edges, bounded walks, connected threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlog.functions import text as T
from loamlog.operators.components import checkpointed
from loamlog.sources import log as L

NODE_KINDS = {"EvidenceArtifact": "evidence", "Observation": "meaning_unit", "Claim": "meaning_unit", "AcceptanceDecision": "acceptance", "Supersession": "supersession"}


def nodes(log: DataFrame) -> DataFrame:
    """One node per event, subject, project and worktree. A shared node takes the zone of the
    last event that wrote it."""
    kinds = F.create_map(*[F.lit(x) for pair in NODE_KINDS.items() for x in pair])
    own = log.select(F.concat(F.lit("evt:"), "event_id").alias("node_id"), kinds[F.col("event_type")].alias("node_kind"), "zone")
    origin = L.origins(log)
    rows = log.select("event_id", "zone", "subject", "recorded", "n").join(origin, "event_id", "left")
    shared = F.filter(
        F.array(
            F.struct(T.subject_node(F.col("subject")).alias("node_id"), F.lit("subject").alias("node_kind")),
            F.when(F.col("project_id").isNotNull(), F.struct(F.concat(F.lit("project:"), "project_id").alias("node_id"), F.lit("project").alias("node_kind"))),
            F.when(F.col("worktree_id").isNotNull(), F.struct(F.concat(F.lit("worktree:"), "worktree_id").alias("node_id"), F.lit("worktree").alias("node_kind"))),
        ),
        lambda x: x.isNotNull(),
    )
    written = rows.select(F.explode(shared).alias("x"), "zone", "recorded", "n").groupBy("x.node_id", "x.node_kind").agg(F.max_by("zone", F.struct("recorded", "n")).alias("zone"))
    return own.unionAll(written)


def edges(log: DataFrame) -> DataFrame:
    """Edges by kind: derived_from, supports, supersedes, accepted_by, about, belongs_to,
    observed_in. Targets that are not in the log give no edge."""
    known = log.select(F.col("event_id").alias("target_id"))
    node = lambda c: F.concat(F.lit("evt:"), F.col(c))
    kinds = (
        F.when(F.col("event_type") == "Claim", "supports").when(F.col("event_type") == "Supersession", "supersedes")
        .when(F.col("event_type").isin("Observation", "AcceptanceDecision"), "derived_from")
    )
    refs = log.select("event_id", "target_id", "zone", kinds.alias("edge_kind")).where("edge_kind IS NOT NULL").join(known, "target_id")
    out = refs.select("edge_kind", node("event_id").alias("from_id"), node("target_id").alias("to_id"), "zone")
    out = out.unionAll(L.decisions(log).select(F.lit("accepted_by").alias("edge_kind"), node("claim_id").alias("from_id"), node("event_id").alias("to_id"), "zone"))
    about = log.where("event_type IN ('Observation', 'Claim')").select(F.lit("about").alias("edge_kind"), node("event_id").alias("from_id"), T.subject_node(F.col("subject")).alias("to_id"), "zone")
    origin = L.origins(log).join(log.select("event_id", "zone"), "event_id")
    place = lambda kind, prefix, c: origin.where(F.col(c).isNotNull()).select(F.lit(kind).alias("edge_kind"), node("event_id").alias("from_id"), F.concat(F.lit(prefix), F.col(c)).alias("to_id"), "zone")
    return out.unionAll(about).unionAll(place("belongs_to", "project:", "project_id")).unionAll(place("observed_in", "worktree:", "worktree_id"))


def walk(seeds: DataFrame, links: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(seed, node_id, hop): nodes within ``depth`` links of each seed, at their least hop.

    One join per hop, of the frontier only; ``depth`` is small by contract (4 at most).
    """
    if not 0 <= depth <= 4:
        raise ValueError("walks are bounded to four hops")
    step = links.select(F.col("from_id").alias("node_id"), F.col("to_id").alias("next"))
    if not directed:
        step = step.unionAll(links.select(F.col("to_id").alias("node_id"), F.col("from_id").alias("next")))
    seen = frontier = seeds.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("hop")).distinct()
    if depth > 1:  # each hop is cut off, or the plan would hold all earlier hops twice
        step, seen = checkpointed(step.distinct()), checkpointed(seen)
        frontier = seen
    for hop in range(1, depth + 1):
        new = frontier.join(step, "node_id").select("seed", F.col("next").alias("node_id")).distinct()
        frontier = new.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti").withColumn("hop", F.lit(hop))
        frontier = checkpointed(frontier) if hop < depth else frontier
        seen = seen.unionAll(frontier)
    return seen


def neighborhood(seeds: DataFrame, links: DataFrame, depth: int, most: int) -> DataFrame:
    """As ``walk``, with at most ``most`` nodes a seed: nearer ones first, then by id.

    A seed's nodes are ranked in one window, so they should be few: ``depth`` bounds them.
    """
    near = walk(seeds, links, depth)
    place = F.row_number().over(Window.partitionBy("seed").orderBy("hop", "node_id"))
    return near.withColumn("place", place).where(F.col("place") <= most).drop("place")


def threads(log: DataFrame, links: DataFrame) -> DataFrame:
    """Decision threads: connected meaning units of one subject, two at least.

    Connections are derived_from, supports and supersedes edges within the subject. The
    thread's id is a digest of its members as a set: of their number, the first one and the sum
    of their hashes, so members are never gathered in one row.
    """
    from loamlog.operators.components import connected

    units = log.where("event_type IN ('Observation', 'Claim')").select(F.concat(F.lit("evt:"), "event_id").alias("id"), "subject", "n")
    a = units.select(F.col("id").alias("from_id"), F.col("subject").alias("s1"), F.col("n").alias("a"))
    b = units.select(F.col("id").alias("to_id"), F.col("subject").alias("s2"), F.col("n").alias("b"))
    pairs = links.where("edge_kind IN ('derived_from', 'supports', 'supersedes')").join(a, "from_id").join(b, "to_id").where("s1 = s2").select("a", "b")
    parts = connected(pairs)
    members = units.join(parts.select(F.col("node").alias("n"), "component"), "n", "left").withColumn("component", F.coalesce("component", "n"))
    digits = F.conv(F.substring(F.sha2("id", 256), 1, 12), 16, 10).cast("decimal(38,0)")
    thread = members.groupBy("subject", "component").agg(F.count("*").alias("n_members"), F.min("id").alias("first_member"), F.sum(digits).alias("_sum")).where("n_members > 1")
    seed = (F.col("n_members").cast("string"), F.col("first_member"), F.col("_sum").cast("string"))
    return thread.select(T.content_id("thread_", 24, *seed).alias("thread_id"), "subject", "n_members", "first_member")


def density(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Per node kind: nodes, their mean degree (a loop counts twice), and those without edges."""
    ends = edge_rows.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    joined = node_rows.join(ends, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return joined.groupBy("node_kind").agg(
        F.count("*").alias("n_nodes"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("n_isolated")
    )


def lineage(log: DataFrame, depth: int = 4) -> DataFrame:
    """What accepted decisions rest on: provenance targets up to ``depth`` references back."""
    links = log.where("target_id IS NOT NULL").select(F.col("event_id").alias("from_id"), F.col("target_id").alias("to_id"))
    seeds = log.where("decision = 'accepted'").select(F.col("event_id").alias("seed"))
    return walk(seeds, links, depth, directed=True).where("hop > 0")
