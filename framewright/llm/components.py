"""Connected components of a link table: union-find within each partition, and star steps between the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.bpe import tidy
from framewright.llm.common import join_groups, stored

MAX_ROUNDS = 60
#: Distinct links (16 bytes each) a task; the number of partitions follows from it.
TASK_LINKS = 1_000_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = np.fromiter(root, np.int64, len(root))
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([find(x) for x in part.tolist()], pa.int64())], names=["node", "component"])


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One star step over edges (u > v). Large: a node's larger neighbours link to its least neighbour; small: its smaller ones do."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = stored(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    linked = join_groups(near, least, "u", "n", total)
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): component is the least node reachable.

    A round makes a forest of the links of each partition, then links nodes of different partitions to the least node they
    know; with few links a single partition is left. Rounds are logarithmic in the longest path. A node with very many links is pre-aggregated and joined by broadcast, so
    that it doesn't fill one task. Links are any integers; repeated links and self-links are harmless; no link, no row.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or not now[0]:
            break
        state = now
        parts = -(-now[0] // task_links)
        forest = (edges.coalesce(1) if parts == 1 else edges.repartition(parts, "v")).mapInArrow(tidy(_union_find), "node long, component long")
        if parts == 1:  # no other partition has a link to these
            return forest
        edges = stored(forest.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).distinct(), "forest")
        edges = stored(_star(edges, 2 * now[0], large=True), "edges")
        edges = stored(_star(edges, now[0], large=False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)
