"""Connected components, cycles and reachability of edge lists, as iterated joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Rounds in which edges without a way in or out are dropped before components are sought.
TRIMS = 2


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the session's spark.checkpoint.dir; a folder of its own only in local
    mode and where none is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="loamlog-"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder. Unlike a checkpoint's, its size is known
    from its files; estimates carried through many rounds of joins grow without bound."""
    path = shared_folder(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def encoded(nodes: DataFrame) -> DataFrame:
    """(node, id) of each different node; ids are longs and follow the order of the nodes."""
    ranged = nodes.where("node IS NOT NULL").distinct().repartitionByRange("node").sortWithinPartitions("node")
    return checkpointed(ranged.withColumn("id", F.monotonically_increasing_id()))


def coded(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (a, b) with the ids of their nodes."""
    name = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    return edges.join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b) of any orderable type; component is the least node.
    The least node itself has no row.

    The rounds run on longs, in which sums and joins cost a part of what they do in strings.
    Nodes with one neighbour take that one's component and stay out of the rounds.
    """
    if not isinstance(edges.schema["a"].dataType, LongType):
        edges = checkpointed(edges.select("a", "b").where("a <> b").distinct())
        ids = encoded(edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node"))))
        found = connected(coded(edges, ids))
        back = lambda c: ids.select(F.col("id").alias(f"{c}_id"), F.col("node").alias(c))
        return found.toDF("node_id", "component_id").join(back("node"), "node_id").join(back("component"), "component_id").select("node", "component")
    pairs = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    ends = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    single = ends.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1").select("u", "v")
    leaf = lambda c: single.select(F.col("u").alias(c), F.lit(True).alias(f"{c}_leaf"))
    marked = checkpointed(pairs.join(leaf("a"), "a", "left").join(leaf("b"), "b", "left"))
    inner = in_rounds(marked.where("a_leaf IS NULL AND b_leaf IS NULL").select("a", "b"))
    # of two leaves that are each other's only neighbour the greater one hangs on the other
    hung = marked.where("b_leaf").select(F.col("b").alias("leaf"), F.col("a").alias("at")).unionAll(marked.where("a_leaf AND b_leaf IS NULL").select(F.col("a").alias("leaf"), F.col("b").alias("at")))
    home = hung.join(inner.withColumnRenamed("node", "at"), "at", "left").select("leaf", F.coalesce("component", "at").alias("root"))
    members = checkpointed(home.unionAll(inner.select("node", "component")))
    least = members.groupBy("root").agg(F.min("leaf").alias("low")).select("root", F.least("root", "low").alias("component"))
    found = members.join(least, "root").select(F.col("leaf").alias("node"), "component")
    return found.unionAll(least.where("component < root").select("root", "component")).where("component < node")


def in_rounds(pairs: DataFrame) -> DataFrame:
    """``connected`` for different pairs (a, b) with a < b."""
    before = None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u AND m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("e"))
        pairs = checkpointed(small.select("e.a", "e.b").where("a < b").distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = now


def shrunk(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round of the search for cycles in edges (a, b, component): what is left of them, and
    the components that were found to have one.

    Edges from where nothing leads or to where nothing goes on are dropped. A component that
    loses none by that has a cycle: each of its nodes leads on. Else nodes with one edge in and
    one out are bridged where their hash is the least among their neighbours', so a chain loses
    about a third of its nodes a round.
    """
    tails, heads = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
    marked = edges.join(tails.withColumn("led", F.lit(True)), "a", "left").join(heads.withColumn("goes", F.lit(True)), "b", "left")
    marked = written(marked.select("a", "b", "component", (F.col("led").isNotNull() & F.col("goes").isNotNull()).alias("inner")))
    whole = marked.groupBy("component").agg(F.min("inner").alias("all"), F.max(F.col("a") == F.col("b")).alias("loop")).where("all OR loop").select("component")
    rest = marked.where("inner").select("a", "b", "component").join(whole, "component", "left_anti").select("a", "b", "component")
    out = rest.groupBy(F.col("a").alias("v"), "component").agg(F.count("*").alias("n"), F.min("b").alias("w")).where("n = 1").drop("n")
    into = rest.groupBy(F.col("b").alias("v")).agg(F.count("*").alias("n"), F.min("a").alias("u")).where("n = 1").drop("n")
    between = out.join(into, "v").withColumn("h", F.struct(F.xxhash64("v", F.lit(turn)), "v"))
    beside = between.select("v", "h")
    before, after = beside.select(F.col("v").alias("u"), F.col("h").alias("hu")), beside.select(F.col("v").alias("w"), F.col("h").alias("hw"))
    bridged = between.join(before, "u", "left").join(after, "w", "left").where("(hu IS NULL OR h < hu) AND (hw IS NULL OR h < hw)")
    bridged = written(bridged.select("u", "v", "w", "component"))
    gone_a, gone_b = bridged.select(F.col("v").alias("a")), bridged.select(F.col("v").alias("b"))
    kept = rest.join(gone_a, "a", "left_anti").join(gone_b, "b", "left_anti").select("a", "b", "component")
    left = kept.unionAll(bridged.select(F.col("u").alias("a"), F.col("w").alias("b"), "component")).distinct()
    return written(left), written(whole)


def cyclic_components(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The components (of ``parts``: node, component) in which directed edges (a, b) lead from
    some node back to it. A chain of n edges takes some 2.5 log2(n) rounds."""
    named = edges.join(parts.withColumnRenamed("node", "a"), "a").select("a", "b", "component").distinct()
    left, found, turn = written(named), None, 0
    while not left.isEmpty():
        left, here = shrunk(left, turn)
        found, turn = here if found is None else found.unionAll(here), turn + 1
    return named.select("component").limit(0) if found is None else found.distinct()


def reaching(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (start, goal) whose goal is reached from their start over edges (a, b), and those
    whose two ends are one.

    Only pairs whose ends share a component in which edges and pairs (goal to start) together
    have a cycle can be such; the others are not followed. The rounds that are left are as
    many as the longest way within such a component has edges.
    """
    pairs = pairs.select("start", "goal").where("start IS NOT NULL AND goal IS NOT NULL").distinct()
    leads = pairs.join(edges.select(F.col("a").alias("start")), "start", "left_semi").join(edges.select(F.col("b").alias("goal")), "goal", "left_semi")
    pairs = written(leads.select("start", "goal").unionByName(pairs.where("start = goal")).distinct())
    if pairs.where("start <> goal").isEmpty():
        return pairs
    both = edges.select("a", "b").unionAll(pairs.select(F.col("goal").alias("a"), F.col("start").alias("b"))).where("a <> b").distinct()
    for _ in range(TRIMS):  # what lies on a cycle stays; most of the rest goes before components are sought
        inner = both.join(both.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(both.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        both = written(inner.select("a", "b"))
    ends = connected(both)
    parts = ends.unionAll(ends.select(F.col("component").alias("node"), "component")).distinct()
    cyclic = written(parts.join(cyclic_components(both, parts), "component", "left_semi"))
    edges = edges.join(both, ["a", "b"], "left_semi")
    steps = written(edges.join(cyclic.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b").distinct())
    apart = pairs.where("start <> goal").join(cyclic.select(F.col("node").alias("start")), "start", "left_semi")
    front = written(apart.withColumn("at", F.col("start")))
    seen, found = front, pairs.where("start = goal")
    while not front.isEmpty():
        on = front.join(steps.withColumnRenamed("a", "at"), "at").select("start", "goal", F.col("b").alias("at")).distinct()
        on = written(on.join(seen, ["start", "goal", "at"], "left_anti"))
        hit = on.where("at = goal").select("start", "goal").distinct()
        found = written(found.unionAll(hit))
        front = written(on.join(hit, ["start", "goal"], "left_anti"))
        seen = written(seen.unionAll(front))
    return found


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the one that driver and executors share."""
    checkpointed(spark.range(0))  # sets the folder in local mode where none is set
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
