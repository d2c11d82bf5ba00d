"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps, for every node, edges to the smallest node it knows; the steps alternate
until every node has one edge, to a node that has none. Before the first round every task
contracts the edges it happens to hold, chunk by chunk, to trees of depth one, which saves
rounds; where that leaves few edges, one more such task ends it. A node's smallest neighbour
comes from a partially aggregated group; the few nodes that hold more than a thousandth of
all edges are joined by broadcast, so none is a hot spot. Every round is written to the
shared folder: the plan stays short and a lost executor repeats one round only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.skew import heavy_join
from stratafold.scratch import discard, materialize

#: Edges that a task contracts at once.
CHUNK = 200_000
#: Edges that one task ends alone.
FEW = 20_000


def contract(edges: list[tuple]) -> list[tuple]:
    """Edges (node, smallest node of its tree) that connect the same nodes as the given ones."""
    above: dict = {}

    def top(x):
        root = x
        while (up := above.setdefault(root, root)) != root:
            root = up
        while above[x] != root:
            above[x], x = root, above[x]
        return root

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return [(x, r) for x in above if (r := top(x)) != x]


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for pdf in batches:
        held += zip(pdf["a"], pdf["b"])
        if len(held) >= CHUNK:
            yield pd.DataFrame(contract(held), columns=["a", "b"])
            held = []
    if held:
        yield pd.DataFrame(contract(held), columns=["a", "b"])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Links the larger neighbours of every node to the node's smallest neighbour."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = edges.select(ends.alias("e")).select("e.a", "e.b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("held"))
    rows = heavy_join(both.filter("b > a"), least, ["a"], "held", 2 * total)
    return rows.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Links every node and its smaller neighbours to the smallest of these (edges have a > b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("held"))
    # The node's own link stands at its smallest neighbour, those of the others lead from them.
    rows = heavy_join(edges, least, ["a"], "held", total)
    rows = rows.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return rows.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node leads to one node only, from which no edge leads on."""
    split = edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo <> hi")
    deep = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return split.isEmpty() and deep.isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component = least node.

    Edges with a null end, loops and repeated edges are ignored; an empty table gives no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b")
    now = materialize(pairs.mapInPandas(_contracted, pairs.schema), "edges")
    for _ in range(max_rounds):
        if (total := now.count()) <= FEW:
            before, now = now, materialize(now.coalesce(1).mapInPandas(_contracted, pairs.schema), "edges")
            discard(before)
            break
        if _settled(now):
            break
        larger = materialize(_large_star(now, total), "edges")
        before, now = now, materialize(_small_star(larger, larger.count()), "edges")
        discard(before, larger)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
