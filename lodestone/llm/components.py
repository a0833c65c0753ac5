"""Connected components: contraction within tasks, then alternating large-star and small-star steps.

Tasks of bounded size first replace their edges by stars, each node linked to
the smallest that it reaches there; this leaves few rounds to be shuffled. Each
step keeps the components and moves edges towards each component's smallest
node; it ends when the edges stop changing. Every round is written to the
shared folder, so a lost executor costs at most a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import materialise

#: Edges that a task holds at once.
EDGES_A_TASK = 400_000


def contracted(u: list, v: list) -> tuple[list, list]:
    """(node, smallest node that it reaches) of the nodes that have a smaller one."""
    parent: dict = {}

    def find(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for a, b in zip(u, v, strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return nodes, [find(x) for x in nodes]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, roots = contracted(table.column("u").to_pylist(), table.column("v").to_pylist())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes, table.schema.field("u").type), pa.array(roots, table.schema.field("u").type)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= EDGES_A_TASK:
            yield out()
            size = 0
    if held:
        yield out()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of the component.

    ``links`` is a written table with columns a and b of one orderable type.
    Self-links and nulls are ignored; an empty table gives an empty table.
    """
    edges = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tasks = -(-edges.count() // EDGES_A_TASK)
    edges = materialise(edges.coalesce(max(1, tasks)).mapInArrow(_contract, edges.schema), "edges")
    # One task saw every edge: its stars are the components.
    state, done = None, tasks <= 1
    while not done:
        edges = materialise(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
        done, state = (now["n"], now["h"]) == state, (now["n"], now["h"])
    if tasks <= 1:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
