"""Connected components of an edge table, as Spark joins and minima.

Alternating star contraction: every node hands the smallest node it knows to
its larger neighbours (large star), then to its smaller ones (small star),
until every edge points at the smallest node of its component.  Only minima
per node are gathered, with map-side combine, so a hub needs no large group;
the join that hands them out is split by adaptive execution if it is skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.scratch import Scratch

#: Edges that one local contraction step holds at once.
LOCAL_EDGES = 200_000
_SCHEMA = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over bounded chunks of edges: each chunk becomes (node, smallest node of its tree)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root and x != root:
            parent[x], x = root, p
        return root

    def flush() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        roots = [find(x) for x in nodes]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
                parent.setdefault(min(u, v), min(u, v))
        if len(parent) > LOCAL_EDGES:
            yield flush()
    yield flush()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u > v)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node long, component long): every node of the edges (a, b) with the smallest node it can reach.

    Edges may repeat and point either way; an edge from a node to itself or
    with a null end says nothing.  Nodes without an edge have no row; an empty
    table gives an empty one.  The rounds are logarithmic in the longest
    chain; each writes its edges to the shared folder.
    """
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .where("a is not null and b is not null and u > v").distinct())
    e = scratch.keep(e.mapInArrow(_forest, _SCHEMA).distinct(), f"{name}-0")
    mark, k = None, 0
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if not now[0] or now == mark:
            break
        mark, k = now, k + 1
        e = scratch.keep(_star(_star(e, True), False), f"{name}-{k}")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
