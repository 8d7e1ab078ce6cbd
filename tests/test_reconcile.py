"""Reconciliation: each verdict from records made for it, taints, cycles at length."""

import random

import pytest
from pyspark.sql import functions as F

from loamlog.operators import components, reconcile

OBSERVATIONS = "source_id string, event_id string, policy string, key string, subject string, lifecycle string, imported boolean"
RELATIONS = "event_id string, zone string, target string, replacement string, imported boolean"


def worlds(spark, cases):
    """Sources ``a`` of all cases side by side, each with names of its own: an old and a new
    observation, and what a case changes of them."""
    frames = {"sources": [], "observations": [], "judgements": [], "reviews": [], "relations": []}
    usual = {"sources": [("a", "z", "s", False, True)], "observations": [O1, O2], "judgements": [("a", "old", "promote"), ("a", "new", "promote")]}
    named = {"sources": (0,), "observations": (0, 1), "judgements": (0,), "reviews": (0,), "relations": (0, 2, 3)}
    for name, (changes, _) in cases.items():
        for table, rows in (usual | changes).items():
            frames[table] += [tuple(f"{name}/{v}" if i in named[table] and v is not None else v for i, v in enumerate(row)) for row in rows]
    schemas = ("source_id string, zone string, subject string, imported boolean, conforms boolean", OBSERVATIONS, "source_id string, policy string, disposition string", "source_id string, policy string, decision string", RELATIONS)
    return [spark.createDataFrame(rows, schema) for rows, schema in zip(frames.values(), schemas, strict=True)]


O1, O2 = ("a", "o1", "old", "ordinary", "s", "active", False), ("a", "o2", "new", "ordinary", "s", "active", False)
REJECTED = [("a", "old", "promote"), ("a", "new", "reject")]
CASES = {
    "replace": ({}, ("replace", "o1", "o2", True)),
    "replaced already": ({"relations": [("r", "z", "o1", "o2", False)]}, ("already_applied", "o1", "o2", True)),
    "replaced twice": ({"relations": [("r", "z", "o1", "o2", False), ("r2", "z", "o1", "o2", False)]}, ("ambiguous_unsafe", "o1", "o2", True)),
    "replaced by an import": ({"relations": [("r", "z", "o1", "o2", True)]}, ("imported_unsafe", "o1", "o2", True)),
    "replaced by another": ({"relations": [("r", "z", "o1", "x", False)]}, ("conflicting_intent_unsafe", "o1", "o2", True)),
    "replaced in another zone": ({"relations": [("r", "y", "o1", "o2", False)]}, ("zone_unsafe", "o1", "o2", True)),
    "leads back": ({"relations": [("r", "z", "o2", "m", False), ("r2", "z", "m", "o1", False)]}, ("cycle_unsafe", "o1", "o2", True)),
    "one and the same": ({"observations": [O1, ("a", "o1", "new", "ordinary", "s", "active", False)]}, ("cycle_unsafe", "o1", "o1", True)),
    "invalidate": ({"judgements": REJECTED, "observations": [O1]}, ("invalidate", "o1", None, True)),
    "invalidated already": ({"judgements": REJECTED, "observations": [O1], "relations": [("r", "z", "o1", None, False)]}, ("already_applied", "o1", None, True)),
    "invalidated twice": ({"judgements": REJECTED, "observations": [O1], "relations": [("r", "z", "o1", None, False), ("r2", "z", "o1", None, False)]}, ("ambiguous_unsafe", "o1", None, True)),
    "invalidated by an import": ({"judgements": REJECTED, "observations": [O1], "relations": [("r", "z", "o1", None, True)]}, ("imported_unsafe", "o1", None, True)),
    "rejected but replaced": ({"judgements": REJECTED, "observations": [O1], "relations": [("r", "z", "o1", "x", False)]}, ("conflicting_intent_unsafe", "o1", None, True)),
    "rejected, other zone": ({"judgements": REJECTED, "observations": [O1], "relations": [("r", "y", "o1", None, False)]}, ("zone_unsafe", "o1", None, True)),
    "no source": ({"sources": []}, ("missing_unsafe", None, None, True)),
    "imported source": ({"sources": [("a", "z", "s", True, True)]}, ("imported_unsafe", None, None, True)),
    "odd source": ({"sources": [("a", "z", "s", False, False)]}, ("lineage_unsafe", None, None, False)),
    "other subject": ({"observations": [O1, ("a", "o2", "new", "ordinary", "t", "active", False)]}, ("lineage_unsafe", None, None, True)),
    "wrong key": ({"observations": [O1, ("a", "o2", "new", "held", "s", "active", False)]}, ("ambiguous_unsafe", None, None, True)),
    "imported new": ({"observations": [O1, ("a", "o2", "new", "ordinary", "s", "active", True)]}, ("imported_unsafe", None, "o2", True)),
    "not judged anew": ({"judgements": [("a", "old", "promote")], "observations": [O1]}, ("missing_unsafe", None, None, True)),
    "judged too often": ({"judgements": [("a", "old", "promote"), ("a", "new", "promote"), ("a", "new", "promote")]}, ("lineage_unsafe", None, None, False)),
    "held, not reviewed": ({"judgements": [("a", "old", "promote"), ("a", "new", "hold")], "observations": [O1]}, ("missing_unsafe", None, None, True)),
    "held and reviewed": ({"judgements": [("a", "old", "promote"), ("a", "new", "hold")], "reviews": [("a", "new", "promote")], "observations": [O1, ("a", "o2", "new", "held", "s", "active", False)]}, ("replace", "o1", "o2", True)),
    "held, review says no": ({"judgements": [("a", "old", "promote"), ("a", "new", "hold")], "reviews": [("a", "new", "reject")], "observations": [O1]}, ("ambiguous_unsafe", None, None, True)),
    "nothing old": ({"observations": [O2]}, ("missing_unsafe", None, None, True)),
    "two old": ({"observations": [O1, ("a", "o1b", "old", "ordinary", "s", "active", False), O2]}, ("ambiguous_unsafe", None, None, True)),
    "nothing new": ({"observations": [O1]}, ("missing_unsafe", "o1", None, True)),
    "two new": ({"observations": [O1, O2, ("a", "o2b", "new", "ordinary", "s", "active", False)]}, ("ambiguous_unsafe", "o1", None, True)),
    "a draft": ({"observations": [("a", "o1", "old", "ordinary", "s", "draft", False), O2]}, ("missing_unsafe", None, None, True)),
    "its own observation": ({"observations": [("a", "a", "old", "ordinary", "s", "active", False), O2]}, ("self_unsafe", "a", "o2", True)),
    "too many": ({"observations": [(*O1[:1], f"p{i}", *O1[2:]) for i in range(9)]}, ("lineage_unsafe", None, None, False)),
}


def test_every_verdict(spark):
    plain = lambda x: x and x.split("/")[1]
    rows = reconcile.verdicts(*worlds(spark, CASES), "old", "new").collect()
    got = {r["source_id"].split("/")[0]: (r["verdict"], plain(r["target_id"]), plain(r["replacement_id"]), r["conforms"]) for r in rows}
    assert len(rows) == len(CASES) and got == {name: want for name, (_, want) in CASES.items()}


ENTRY = "source_id string, zone string, target_id string, replacement_id string, verdict string, subject string, target_subject string, replacement_subject string, conforms boolean"


def planned(spark, rows, relations=(), lineage=(), **options):
    candidates = spark.createDataFrame([(*row[:1], "z", *row[1:4], "s", *(row[4] if len(row) > 4 else ("s", "s", True))) for row in rows], ENTRY)
    links = spark.createDataFrame([("r", "z", t, p, False) for t, p in relations], RELATIONS)
    found = components.checkpointed(reconcile.entries(candidates, spark.createDataFrame(list(lineage), "source_id string, ref_id string"), links))
    tainted = reconcile.taints(found, links, **options)
    return {r["source_id"]: r for r in found.collect()}, {r["taint"] for r in tainted.collect()}, reconcile.plan(found, tainted).collect()[0]


def test_a_clean_plan(spark):
    entries, taints, plan = planned(spark, [("a", "o1", "o2", "replace"), ("b", "p1", None, "invalidate"), ("c", "q1", "q2", "already_applied"), ("d", None, None, "missing_unsafe")], [("q1", "q2")])
    assert taints == set() and plan["admissible"] and plan["sound"]
    assert (plan["n_writes"], plan["n_noops"], plan["n_unsafe"]) == (2, 1, 1) and plan["reasons"] == "already_applied=1,invalidate=1,missing_unsafe=1,replace=1"
    assert len({e["component_id"] for e in entries.values()}) == 4 and entries["c"]["bucket"] == "eligible_noop"
    again = planned(spark, [("d", None, None, "missing_unsafe"), ("c", "q1", "q2", "already_applied"), ("b", "p1", None, "invalidate"), ("a", "o1", "o2", "replace")], [("q1", "q2")])
    assert again[2]["plan_digest"] == plan["plan_digest"]


def test_unsafe_beside_eligible_taints_both(spark):
    entries, taints, plan = planned(spark, [("a", "o1", "o2", "replace"), ("b", "p1", None, "zone_unsafe"), ("c", "q1", None, "invalidate")], lineage=[("a", "e"), ("b", "e")])
    assert taints == {"eligible_unsafe_overlap_global_taint", "unsafe_influences_eligible_global_taint", "eligible_cross_zone_global_taint"}
    assert entries["a"]["component_id"] == entries["b"]["component_id"] != entries["c"]["component_id"]
    assert not plan["admissible"] and (plan["n_tainted_components"], plan["n_tainted_entries"]) == (1, 2)


@pytest.mark.parametrize("reason,taint", [*reconcile.CARRIED.items()])
def test_reasons_that_carry_a_taint(spark, reason, taint):
    assert taint in planned(spark, [("a", "o1", "o2", "replace"), ("b", "o1", None, reason)])[1]
    assert planned(spark, [("a", "o1", "o2", "replace"), ("b", "p1", None, reason)])[1] == set()


def test_two_writes_of_one_target(spark):
    assert planned(spark, [("a", "o1", "o2", "replace"), ("b", "o1", None, "invalidate")])[1] == {"conflicting_eligible_intent_global_taint"}


def test_writes_that_lead_round(spark):
    """Each is safe on its own; together they close a circle through a known supersession."""
    assert planned(spark, [("a", "x", "y", "replace"), ("b", "w", "x", "replace")], [("y", "w")])[1] == {"eligible_reachable_cycle_global_taint"}
    assert planned(spark, [("a", "x", "y", "replace"), ("b", "w", "x", "replace")], [("w", "y")])[1] == set()


def test_other_subjects_and_unproved_rows(spark):
    assert planned(spark, [("a", "o1", "o2", "replace", ("s", "t", True))])[1] == {"eligible_subject_uncertainty_global_taint"}
    assert planned(spark, [("a", "o1", None, "invalidate", ("s", "t", True))])[1] == set()
    assert planned(spark, [("a", "o1", "o2", "lineage_unsafe", ("s", "s", False))])[1] == {"unproved_conformance_global_taint"}


def test_given_taints_and_a_cut_enumeration(spark):
    _, taints, plan = planned(spark, [("a", "o1", "o2", "replace")], given=("unstable_snapshot_global_taint",), truncated=True)
    assert taints == {"unstable_snapshot_global_taint", "incomplete_enumeration_global_taint"} and not plan["admissible"] and plan["n_tainted_components"] == 0


def test_verdicts_that_do_not_hold(spark):
    entries, _, _ = planned(spark, [("a", "a", "o2", "replace"), ("b", "o1", "o1", "replace"), ("c", "p1", "p2", "invalidate"), ("d", None, None, "already_applied"), ("e", "q", None, "strange word")])
    assert {k: v["reason"] for k, v in entries.items()} == {"a": "self_unsafe", "b": "missing_unsafe", "c": "missing_unsafe", "d": "missing_unsafe", "e": "missing_unsafe"}


def chain(spark, n, start=0):
    return spark.range(start, start + n).select(F.format_string("%07d", "id").alias("a"), F.format_string("%07d", F.col("id") + 1).alias("b"))


def rounds_of(edges, component):
    left, turn, found = components.checkpointed(edges.withColumn("component", F.lit(component))), 0, 0
    while not left.isEmpty():
        left, here = components.shrunk(left, turn)
        found, turn = found + here.count(), turn + 1
    return turn, found


def test_a_long_chain_takes_few_rounds(spark):
    turns, found = rounds_of(chain(spark, 100_000), "c")
    assert turns < 40 and found == 0


def test_rings_and_tails(spark):
    ring = chain(spark, 50).unionAll(spark.createDataFrame([("0000050", "0000010")], "a string, b string"))
    assert rounds_of(ring, "c")[1] == 1
    loop = spark.createDataFrame([("p", "p"), ("p", "q")], "a string, b string")
    ladder = spark.createDataFrame([(f"l{i}", f"l{j}") for i in range(8) for j in range(i + 1, 8)], "a string, b string")
    edges = ring.unionAll(loop).unionAll(ladder)
    parts = components.connected(edges.where("a <> b"))
    parts = parts.unionAll(parts.select(F.col("component").alias("node"), "component")).distinct()
    assert {r[0] for r in components.cyclic_components(edges, parts).collect()} == {"0000000", "p"}


def test_reaching(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("x", "y"), ("e", "e")], "a string, b string")
    pairs = [("a", "d"), ("d", "a"), ("b", "d"), ("c", "b"), ("x", "y"), ("y", "x"), ("k", "k"), ("a", "x"), ("e", "e"), (None, "a")]
    got = {tuple(r) for r in components.reaching(spark.createDataFrame(pairs, "start string, goal string"), edges).collect()}
    assert got == {("a", "d"), ("b", "d"), ("c", "b"), ("x", "y"), ("k", "k"), ("e", "e")}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_leaves_stay_out_of_the_rounds_of_components(spark, monkeypatch, kind):
    """Against union-find; pairs, stars and whiskers of cores, and the least node may be a leaf."""
    rng, seen, parent = random.Random(1), [], {}
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 420)] + [(500, 501), (501, 500), (7, 7)]
    edges = [(f"x{a}", f"x{b}") for a, b in edges] if kind == "string" else edges

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    rounds = components.in_rounds
    monkeypatch.setattr(components, "in_rounds", lambda pairs: seen.append(pairs.count()) or rounds(pairs))
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert len(seen) == 1 and 0 < seen[0] < len(set(edges)) * 2 // 3
