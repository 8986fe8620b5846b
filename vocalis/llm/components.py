"""Connected components of an edge table by contraction inside buckets.

In a round every node's edges meet in one bucket, where what is connected becomes a star around its least node. A node with very
many edges (a hub) has them dealt to several buckets; each of those also gets the edge to the hub's least neighbour, so that all
of them move on. Rounds go on until nothing changes; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.frames import saved, shuffle_partitions

#: A node with more than this share of all edge ends is a hub; there can't be more hubs than its inverse.
HUB_SHARE, LEAST_HUB = 1 / 200, 150
#: Edge ends of a bucket, on average.
BUCKET_EDGES = 500_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it is connected with), for all nodes but those least ones; nodes in order."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        one, two = label[a], label[b]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def _stars(table: pa.Table) -> pa.Table:
    u, v, m = (np.asarray(table.column(c)) for c in ("u", "v", "m"))
    hub = np.unique(np.stack((u, m))[:, u != m], axis=1)
    node, least = contract(np.concatenate((u, hub[0])), np.concatenate((v, hub[1])))
    return pa.table({"u": pa.array(node), "v": pa.array(least)})


def _round(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    most = max(LEAST_HUB, int(2 * n * HUB_SHARE))
    hubs = both.groupBy("u").agg(F.count("*").alias("ends"), F.min("v").alias("least")).where(F.col("ends") > most).collect()  # at most 1 / HUB_SHARE rows, by arithmetic
    part, least = F.lit(-1).cast("bigint"), F.col("u")
    if hubs:
        of = lambda c: F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") for h in hubs for x in (h.u, h[c])]), F.col("u"))
        part = F.coalesce(F.pmod(F.xxhash64("v"), F.ceil(of("ends") / most)), part)
        least = F.coalesce(of("least"), "u")
    buckets = max(shuffle_partitions(edges.sparkSession), 2 * n // BUCKET_EDGES)
    dealt = both.select("u", "v", least.alias("m"), F.pmod(F.xxhash64("u", part), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(_stars, "u bigint, v bigint")


def connected(edges: DataFrame) -> DataFrame:
    """From the columns (a, b): one row (node, component) for each node that has an edge and isn't its component's least node.

    ``component`` is the least node of the component. A round ends the work if its edges, each counted and hashed, are those of the
    round before. Nothing but those two numbers and the hubs (at most 1 / HUB_SHARE) reaches the driver.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark or not seen.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = (seen.n, seen.h)
        now = saved(_round(now, seen.n).distinct())
