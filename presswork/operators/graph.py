"""Connected components by repeated contraction.

Each round maps every vertex to the smallest vertex among itself and its neighbours, then rewrites the edges. Vertices
are compared in a scrambled order, so a long chain loses a constant share of its vertices in a round, as in a random
order, and the number of rounds grows with the logarithm of the graph. Aggregations combine on the map side and joins are
plain equi-joins that adaptive execution can split, so a hub with a third of all edges is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswork.session import checkpoint


_LOW = (1 << 32) - 1


def _mix(half: Column) -> Column:
    return F.hash(half).cast("long").bitwiseAND(F.lit(_LOW))


def _scramble(x: Column) -> Column:
    """A bijection of 64-bit integers that keeps no order: three Feistel rounds over a hash of one half."""
    left, right = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    for _ in range(3):
        left, right = right, left.bitwiseXOR(_mix(right))
    return F.shiftleft(left, 32).bitwiseOR(right)


def _unscramble(x: Column) -> Column:
    """The inverse of ``_scramble``."""
    left, right = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(_LOW))
    for _ in range(3):
        left, right = right.bitwiseXOR(_mix(left)), left
    return F.shiftleft(left, 32).bitwiseOR(right)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every vertex on a real edge; ``component`` is the smallest vertex reachable.

    Edges are undirected long pairs. Loops, repeats and edges with a null end are ignored; a vertex whose only edge is a
    loop does not appear; no edges give no rows.
    """
    a, b = _scramble(F.col(src).cast("long")), _scramble(F.col(dst).cast("long"))
    live = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    live = checkpoint(live)
    members: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = checkpoint(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("v"), F.least("a", "low").alias("p")))
        if members is None:
            members = parent.select(F.col("v").alias("node"), F.col("p").alias("rep"))
        else:
            members = (
                members.join(parent, members.rep == parent.v, "left")
                .select("node", F.coalesce("p", "rep").alias("rep"))
            )
        left = live.join(parent, live.a == parent.v).select(F.col("p").alias("a"), "b")
        right = left.join(parent, left.b == parent.v).select("a", F.col("p").alias("b"))
        live = checkpoint(
            right.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
    if members is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    members = checkpoint(members.select(_unscramble(F.col("node")).alias("node"), "rep"))
    lowest = members.groupBy("rep").agg(F.min("node").alias("component"))
    return members.join(lowest, "rep").select("node", "component")
