"""Walks over edge tables: pointer doubling for single-successor graphs, frontier rounds for the rest.

Every round is written to the shared folder, so the plan stays short and a lost executor
costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.session import stored, stored_counted


def follow(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Walk `edges(node, next)` from `starts(start, node)`; rows `(start, node, hops)`.

    `node` has at most one `next`. Distances double each round, so a chain of n pages takes
    log2(n) joins. A walk that meets itself keeps the first visit of each node.
    """
    jump, jumps = stored_counted(edges.filter(F.col("next").isNotNull()).select("node", "next"), "jump")
    seen, count = stored_counted(starts.select("start", "node", F.lit(0).cast("long").alias("hops")), "seen")
    reach = 1
    while jumps:
        step = jump.select("node", F.col("next").alias("to"))
        further = seen.join(step, "node").select(
            "start", F.col("to").alias("node"), (F.col("hops") + reach).alias("hops")
        )
        both = seen.unionByName(further).groupBy("start", "node").agg(F.min("hops").alias("hops"))
        seen, now = stored_counted(both, "seen")
        if now == count:
            break
        count, reach = now, reach * 2
        jump, jumps = stored_counted(_compose(jump), "jump")
    return seen


def _compose(jump: DataFrame) -> DataFrame:
    onward = jump.select(F.col("node").alias("next"), F.col("next").alias("onward"))
    return jump.join(onward, "next").select("node", F.col("onward").alias("next"))


def ends(edges: DataFrame) -> DataFrame:
    """Where the walk from each node with a successor ends: `(node, end)`; one successor per node.

    Only the end is kept while distances double, so a round holds one row for each node. A walk that runs into a
    cycle has no end.
    """
    jump, n = stored_counted(edges.filter(F.col("next").isNotNull()).select("node", "next"), "jump")
    going, reach = n, 1
    while going and reach < 2 * n:
        onward = jump.select(F.col("node").alias("next"), F.col("next").alias("onward"))
        further = jump.join(onward, "next", "left").select("node", F.coalesce("onward", "next").alias("next"), F.col("onward").isNotNull().alias("going"))
        moved = stored(further, "jump")
        going, jump, reach = moved.filter("going").count(), moved.select("node", "next"), reach * 2
    inner = edges.filter(F.col("next").isNotNull()).select(F.col("node").alias("next"))
    return jump.join(inner, "next", "left_anti").select("node", F.col("next").alias("end"))


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes of `edges(node, next)` that reach themselves; one successor per node.

    After at least as many steps as there are edges a walk either ended or is on a cycle,
    and every node of a cycle is where some walk stands.
    """
    jump, jumps = stored_counted(edges.filter(F.col("next").isNotNull()).select("node", "next"), "jump")
    all_edges, reach = jumps, 1
    while reach < all_edges and jumps:
        jump, jumps = stored_counted(_compose(jump), "jump")
        reach *= 2
    return jump.select(F.col("next").alias("node")).distinct()


def ancestors(edges: DataFrame, cycle: DataFrame | None = None) -> DataFrame:
    """All `(node, ancestor, depth)` of `edges(node, next)`, depth 1 and up.

    Nodes whose chain runs into a cycle are left out; `cycle` is `on_cycle(edges)` if known.
    """
    edges = stored(edges.filter(F.col("next").isNotNull()).select("node", "next"), "edges")
    bad = on_cycle(edges) if cycle is None else cycle
    if not bad.isEmpty():
        parents = edges.select(F.col("next").alias("node"), F.col("node").alias("child"))
        edges = stored(
            edges.join(leads_to(parents.select("node", F.col("child").alias("next")), bad), "node", "left_anti"),
            "edges",
        )
    jump = edges
    closure = edges.select("node", F.col("next").alias("ancestor"), F.lit(1).cast("long").alias("depth"))
    reach = 1
    while True:
        onward = closure.select(F.col("node").alias("next"), "ancestor", (F.col("depth") + reach).alias("depth"))
        further, n = stored_counted(jump.join(onward, "next").select("node", "ancestor", "depth"), "closure")
        if not n:
            return closure
        closure = closure.unionByName(further)
        jump, reach = stored(_compose(jump), "jump"), reach * 2


def leads_to(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct nodes reachable from `starts(node)` along `edges(node, next)`, starts included."""
    frontier, n = stored_counted(starts.select("node").distinct(), "seen")
    seen = frontier
    while n:
        new = (
            frontier.join(edges, "node")
            .select(F.col("next").alias("node"))
            .distinct()
            .join(seen, "node", "left_anti")
        )
        frontier, n = stored_counted(new, "frontier")
        seen = seen.unionByName(frontier)
    return seen


def closure_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All `(root, node)` with node reachable from root in one or more steps of any digraph."""
    step = edges.select("node", F.col("next").alias("to"))
    first = roots.select(F.col("node").alias("root"), "node").join(step, "node")
    frontier, n = stored_counted(first.select("root", F.col("to").alias("node")).distinct(), "closure")
    seen = frontier
    while n:
        new = (
            frontier.join(step, "node")
            .select("root", F.col("to").alias("node"))
            .distinct()
            .join(seen, ["root", "node"], "left_anti")
        )
        frontier, n = stored_counted(new, "closure")
        seen = seen.unionByName(frontier)
    return seen


def cycles(edges: DataFrame) -> DataFrame:
    """`(node, component)` of every node of `edges(node, next)` that reaches itself; a component is named by its least node.

    Each round first draws chains together: nodes with one way in and one way out are left out by pointer doubling,
    so a ring or a tail of any length takes log2(length) joins. Then nodes without a way in or out are trimmed off.
    When neither changes anything, colours spread forward (each node takes the greatest that reaches it) and the node
    that gave a colour collects, backward, those of its colour that reach it: a component. A round shuffles what edges
    are left; no pairs of nodes are formed. What was left out of a chain is in a component if both ends are in it.
    """
    given = stored(edges.where(F.col("node").isNotNull() & F.col("next").isNotNull()).select("node", "next").distinct(), "edges")
    own = given.where("node = next").select("node")
    left, n = stored_counted(given.where("node <> next"), "edges")
    found = own.select("node", F.col("node").alias("root")).limit(0)
    chains: list[DataFrame] = []
    while n:
        left, own, found, drawn = _drawn(left, own, found, chains)
        heads, tails = left.select(F.col("next").alias("node")).distinct(), left.select(F.col("node").alias("next")).distinct()
        left, now = stored_counted(left.join(heads, "node", "left_semi").join(tails, "next", "left_semi").select("node", "next"), "edges")
        if now == n and not drawn:
            some = stored(_coloured(left), "component")
            found = found.unionByName(some)
            gone = some.select("node")
            rest = left.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "next"), "next", "left_anti")
            left, now = stored_counted(rest.select("node", "next"), "edges")
        n = now
    return _named(found, own, chains)


def _drawn(left: DataFrame, own: DataFrame, found: DataFrame, chains: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Edges without the nodes that have one way in and one way out; loops and whole rings that this shows."""
    ins = left.groupBy(F.col("next").alias("node")).count().where("count = 1").select("node")
    outs = left.groupBy("node").count().where("count = 1").select("node")
    through, n = stored_counted(ins.join(outs, "node"), "through")
    if not n:
        return left, own, found, 0
    ahead = stored(left.join(through, "node", "left_semi").select("node", "next"), "ahead")
    back = left.join(through.withColumnRenamed("node", "next"), "next", "left_semi").select(F.col("next").alias("node"), F.col("node").alias("next"))
    to = stored(ends(ahead), "ends")
    chains.append(stored(to.join(ends(back).withColumnRenamed("end", "start"), "node"), "chain"))
    rings = _rings(ahead.join(to, "node", "left_anti").select("node", "next"))
    outer = left.join(through, "node", "left_anti").select(F.col("node").alias("a"), F.col("next").alias("b"))
    moved = stored(outer.join(to, F.col("b") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("end", "b").alias("next")).distinct(), "moved")
    loops = moved.where("node = next").select("node")
    return moved.where("node <> next"), own.unionByName(loops), found.unionByName(rings), n


def _rings(jump: DataFrame) -> DataFrame:
    """`(node, root)` of rings of nodes with one successor each: the least node of each ring, by doubling."""
    jump, n = stored_counted(jump.withColumn("root", F.col("node")), "ring")
    reach = 1
    while reach < n:
        onward = jump.select(F.col("node").alias("next"), F.col("next").alias("onward"), F.col("root").alias("other"))
        jump = stored(jump.join(onward, "next").select("node", F.col("onward").alias("next"), F.least("root", "other").alias("root")), "ring")
        reach *= 2
    return jump.select("node", "root")


def _coloured(edges: DataFrame) -> DataFrame:
    """`(node, root)`: for each node whose own colour it has, the nodes of that colour that reach it, itself included."""
    nodes = edges.select("node").unionByName(edges.select(F.col("next").alias("node"))).distinct()
    colour, changed = stored(nodes.withColumn("colour", F.col("node")), "colour"), 1
    while changed:
        brought = edges.join(colour, "node").groupBy(F.col("next").alias("node")).agg(F.max("colour").alias("brought"))
        new = colour.join(brought, "node", "left").select("node", F.greatest("colour", "brought").alias("now"), (F.col("brought") > F.col("colour")).alias("up"))
        seen = Observation()
        new = stored(new.observe(seen, F.count(F.when(F.col("up"), 1)).alias("n")), "colour")
        colour, changed = new.select("node", F.col("now").alias("colour")), seen.get["n"]
    far = colour.select(F.col("node").alias("next"), F.col("colour").alias("other"))
    inside = stored(edges.join(colour, "node").join(far, "next").where("colour = other").select("node", "next"), "inside")
    frontier, n = stored_counted(colour.where("node = colour").select("node", F.col("colour").alias("root")), "reached")
    reached = frontier
    while n:
        more = inside.join(frontier.withColumnRenamed("node", "next"), "next").select("node", "root").distinct().join(reached, ["node", "root"], "left_anti")
        frontier, n = stored_counted(more, "reached")
        reached = reached.unionByName(frontier)
    return reached


def _named(found: DataFrame, own: DataFrame, chains: list[DataFrame]) -> DataFrame:
    own = stored(own.distinct(), "own")
    sizes = found.groupBy("root").count().where("count > 1").select("root")
    several = found.join(sizes, "root", "left_semi").select("node", "root")
    # A node with a loop of its own is a component if it is in no larger one; one left out of a chain is told there.
    alone = own.join(several.select("node"), "node", "left_anti")
    for chain in chains:
        alone = alone.join(chain.select("node"), "node", "left_anti")
    found = stored(several.unionByName(alone.select("node", F.col("node").alias("root"))), "found")
    for chain in reversed(chains):
        first = found.select(F.col("node").alias("start"), F.col("root").alias("r"))
        last = found.select(F.col("node").alias("end"), "root")
        inner = stored(chain.join(first, "start").join(last, "end").where("r = root").select("node", "root"), "inner")
        loops = chain.select("node").join(own, "node").join(inner.select("node"), "node", "left_anti")
        found = stored(found.unionByName(inner).unionByName(loops.select("node", F.col("node").alias("root"))), "found")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
