"""Consolidating pairwise matches into groups.

Method: strip, compress, solve the core, restore. Vertices of degree one and two make up paths and cycles; list
ranking (each end of a path is reached by doubling pointers along it, so a path of n vertices takes log n steps) gives
each of them the ends of its path. A path that hangs on one other vertex is stripped, one between two is compressed
into a link of these, one by itself and a cycle are groups already. This is repeated until no vertex of degree one
or two is left. What remains is the reduced core: its vertices hook onto the neighbour of least rank, pointers are
doubled to the end of these chains, and each chain's end stands for all that leads to it, until no edge is left.
Removed vertices then take their label from the vertex they were attached to, last round first.

A round removes at least half of the vertices of any tree, so everything that is like a tree or a chain is gone after
as many rounds as the binary logarithm of the vertices. A graph that still has vertices to strip then (one that peels
a few at a time, such as a strip of triangles) counts as core.

Nothing is collected: every round is joins and aggregations over edges (hubs are counted with map-side
combination), and each round's tables are written to the shared folder and dropped when they are used.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from claimforge.session import Scratch


def _rank(vertex: Column, round_no: int) -> Column:
    """A total order of vertices that is random in each round."""
    return F.struct(F.xxhash64(vertex, F.lit(round_no)).alias("h"), vertex.alias("v"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("n")), F.struct(F.col("w").alias("v"), F.col("u").alias("n")))).alias("e")).select("e.*")


def _edge(a: str, b: str) -> Column:
    return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("w"))


def _rank_lists(low: DataFrame, name: str, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """(v, end, high, least) twice for each vertex of degree two, once for one of degree one: where a walk from it ends.

    A walk leaves ``v`` to ``x`` and goes on through vertices of degree two. It ends at a vertex that is not low
    (``high``) or at one of degree one; on a cycle it has no end, and ``least`` is the least vertex of the cycle.
    """
    steps = low.select("v", F.explode(F.array_distinct(F.array("n1", "n2"))).alias("x"))
    met = low.select(F.col("v").alias("x"), "n1", "n2", F.lit(True).alias("low"))
    on = F.coalesce(F.col("low") & (F.col("n1") != F.col("n2")), F.lit(False))
    walks = steps.join(met, "x", "left").select(
        "v",
        "x",
        F.when(on, F.col("x")).alias("nv"),
        F.when(on, F.when(F.col("n1") == F.col("v"), F.col("n2")).otherwise(F.col("n1"))).alias("nx"),
        F.when(~on, F.col("x")).alias("end"),
        F.col("low").isNull().alias("high"),
        F.least("v", "x").alias("least"),
        F.lit(True).alias("lower"),
    )
    done, names, before = [], [], None
    for k in itertools.count():
        seen = Observation()
        names.append(f"{name}-{k}")
        open_ = F.col("end").isNull()
        walks = scratch.write(walks.observe(seen, F.count_if(open_).alias("open"), F.count_if(open_ & F.col("lower")).alias("lower")), names[-1])
        n = seen.get["open"]
        # A step ends some walk of every path that has any left, so where none ended only cycles are left. There a
        # step compares the least vertices of two stretches that follow each other; where none is less than the one
        # before it, all around the cycle, all are equal.
        if not n or (n == before and not seen.get["lower"]):
            break
        before = n
        done.append(walks.where("end is not null"))
        known = walks
        for other in done[:-1]:
            known = known.unionByName(other)
        target = known.select(F.col("v").alias("nv"), F.col("x").alias("nx"), F.col("nv").alias("_v"), F.col("nx").alias("_x"), F.col("end").alias("_end"), F.col("high").alias("_high"), F.col("least").alias("_least"))
        walks = walks.where("end is null").join(target, ["nv", "nx"]).select("v", "x", F.col("_v").alias("nv"), F.col("_x").alias("nx"), F.col("_end").alias("end"), F.col("_high").alias("high"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("lower"))
    for other in done:
        walks = walks.unionByName(other)
    return walks.select("v", "end", "high", "least"), names


def _strip(edges: DataFrame, low: DataFrame, round_no: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Paths of low vertices taken out: (v, parent) of these, and the edges that are left with those in place of paths."""
    walks, names = _rank_lists(low, f"walks{round_no}", scratch)
    tips = low.where("n1 = n2").select("v", F.col("v").alias("end"), F.lit(False).alias("high"), F.col("v").alias("least"))
    high = F.when(F.col("high"), F.col("end"))
    by = walks.unionByName(tips).groupBy("v").agg(F.min(high).alias("one"), F.max(high).alias("other"), F.min("end").alias("tip"), F.min("least").alias("least"), F.count_if(F.col("end").isNull()).alias("open"))
    parent = F.coalesce("one", F.when(F.col("open") == 0, F.col("tip")).otherwise(F.col("least")))
    gone = scratch.write(by.select("v", parent.alias("parent"), "one", "other"), f"gone{round_no}")
    cut = low.select(F.explode(F.array_distinct(F.array(_edge("v", "n1"), _edge("v", "n2")))).alias("e")).select("e.u", "e.w", F.lit(1).alias("cut"))
    bridges = gone.where("one <> other").select(F.col("one").alias("u"), F.col("other").alias("w"), F.lit(0).alias("cut"))
    left = edges.withColumn("cut", F.lit(0)).unionByName(cut).unionByName(bridges).groupBy("u", "w").agg(F.max("cut").alias("cut")).where("cut = 0").select("u", "w")
    for name in names:
        scratch.drop(name)
    return gone.where("v <> parent").select("v", "parent"), left


def _hook(edges: DataFrame, round_no: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The core contracted: (v, parent) of vertices that lead to another, and the edges between what they lead to."""
    own = _rank(F.col("v"), round_no)
    vertices = _ends(edges).groupBy("v").agg(F.min(_rank(F.col("n"), round_no)).alias("least"))
    gone = scratch.write(vertices.where(own > F.col("least")).select("v", F.col("least.v").alias("parent")), f"hooks{round_no}/first")
    # Ranks fall along the parents, so these chains end; doubling the pointers brings each vertex to its end.
    for k in itertools.count():
        seen = Observation()
        up = gone.select(F.col("v").alias("parent"), F.col("parent").alias("above"))
        far = gone.join(up, "parent", "left").observe(seen, F.count("above").alias("n")).select("v", F.coalesce("above", "parent").alias("parent"))
        gone = scratch.write(far, f"hooks{round_no}/{k}")
        scratch.drop(f"hooks{round_no}/{k - 1}" if k else f"hooks{round_no}/first")
        if not seen.get["n"]:
            break
    moved = edges
    for end in ("u", "w"):
        to = gone.select(F.col("v").alias(end), F.col("parent").alias("to"))
        moved = moved.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return gone, moved.where("u <> w").select(_edge("u", "w").alias("e")).select("e.u", "e.w").distinct()


def connected_groups(links: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(member, group_id) for each vertex of ``links``; group_id is the smallest member of the group.

    Links with a null end and links of a vertex to itself say nothing and are left out, repeated and reversed
    links count once, and vertices without any other link do not come out. An empty table gives no rows.
    Other columns of ``links`` are ignored, so clashing names do no harm.
    """
    scratch = Scratch(links.sparkSession, "groups")
    edges = links.select(F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b")).where("_a <> _b").select(_edge("_a", "_b").alias("e")).select("e.u", "e.w").distinct()
    edges = scratch.write(edges, "edges0")
    layers: list[DataFrame] = []
    stripping, most_strips = True, 1
    for round_no in range(max_rounds):
        seen = Observation()
        degrees = _ends(edges).groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("n").alias("n1"), F.max("n").alias("n2"))
        low = scratch.write(degrees.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("deg") <= 2).alias("low")).where("deg <= 2").select("v", "n1", "n2"), f"low{round_no}") if stripping else None
        if stripping:
            n = seen.get["n"]
            most_strips = most_strips if round_no else n.bit_length() + 1
            stripping = seen.get["low"] > 0 and round_no < most_strips
        else:
            n = len(edges.take(1))
        if not n:
            break
        gone, left = _strip(edges, low, round_no, scratch) if stripping else _hook(edges, round_no, scratch)
        edges = scratch.write(left, f"edges{round_no + 1}")
        scratch.drop(f"edges{round_no}")
        scratch.drop(f"low{round_no}")
        layers.append(gone)
    else:
        raise RuntimeError("groups did not settle")
    labels = edges.select(F.col("u").alias("v"), F.col("w").alias("root")).limit(0)
    for k, gone in reversed(list(enumerate(layers))):
        above = labels.select(F.col("v").alias("parent"), "root")
        labels = scratch.write(labels.unionByName(gone.join(above, "parent", "left").select("v", F.coalesce("root", "parent").alias("root"))), f"labels{k}")
        for used in (f"labels{k + 1}", f"gone{k}", f"hooks{k}"):
            scratch.drop(used)
    least = labels.groupBy("root").agg(F.min("v").alias("v")).select("root", F.least("root", "v").alias("group_id"))
    named = labels.join(least, "root").select(F.col("v").alias("member"), "group_id")
    return named.unionByName(least.select(F.col("root").alias("member"), "group_id"))
