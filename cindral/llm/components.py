"""Consolidating pairwise matches into groups (problem 3).

Connected components over a two-dimensional grid: vertices are hashed into blocks, and every edge belongs to the grid cell of its two
blocks. A round runs union-find inside each cell; each vertex then takes the smallest of the representatives that the cells of its row
and column gave it as parent, and the representatives themselves are linked to that parent for the next round, in which only they
remain. "Smallest" is by a bijective mix of the identifier, so that at least a constant share of the vertices goes in every round whatever
the identifiers look like; the grid shrinks with the edges until one cell holds them all. Parents are then followed back down.

A cell has at most about `cell_edges` edges: the blocks grow with the edges, and a cell that is fuller (a vertex with a third of all
links fills its row and column) is cut into parts, for union-find within any part of the edges is right. Links and groups never pass
through the driver.

Nulls and odd input: pairs with a null end, loops and repeated pairs add nothing; a group identifier is the smallest identifier in the
group, a record in no pair has no row; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindral.session import cut


def mixed(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (multiply by an odd number, fold, twice)."""
    x = v.astype(np.int64).view(np.uint64).copy()
    for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x ^= x >> np.uint64(32)
        x *= np.uint64(m)
    x ^= x >> np.uint64(32)
    return x


def local_union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, representatives): the vertex of smallest mix in each component of the edges (a, b)."""
    names = np.unique(np.concatenate([a, b]))
    names = names[np.argsort(mixed(names))]
    order = np.argsort(names)
    i, j = (order[np.searchsorted(names, v, sorter=order)] for v in (a, b))
    top = np.arange(len(names))
    while len(i):
        lo = np.minimum(top[i], top[j])
        np.minimum.at(top, top[i], lo)
        np.minimum.at(top, top[j], lo)
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up
        open_ = top[i] != top[j]
        i, j = i[open_], j[open_]
    return names, names[top]


def _round(edges: DataFrame, n: int, cell_edges: int) -> DataFrame:
    """(v, r, pr): the representatives that the grid's cells give each vertex, and their mix as a sortable number."""
    side = max(1, math.ceil(math.sqrt(n / cell_edges)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    e = edges.withColumn("cell", block(F.col("a")) * side + block(F.col("b")))
    parts = side * side
    if side > 1:
        # At most side * side rows, far below the edges; only cells above the bound are cut.
        full = e.groupBy("cell").count().where(F.col("count") > 2 * cell_edges).select("cell", F.ceil(F.col("count") / cell_edges).cast("int").alias("cuts"))
        e = e.join(full, "cell", "left").withColumn("part", F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("a", "b"), F.col("cuts"))).otherwise(F.lit(0))).drop("cuts")
    else:
        e = e.withColumn("part", F.lit(0))

    def run(batches):
        import pandas as pd

        a, b = [], []
        for x in batches:
            a.append(x["a"].to_numpy())
            b.append(x["b"].to_numpy())
        if not a:
            return
        v, r = local_union(np.concatenate(a), np.concatenate(b))
        yield pd.DataFrame({"v": v, "r": r, "pr": mixed(r).view(np.int64) ^ np.int64(-(2**63))})

    return e.repartition(parts, "cell", "part").select("a", "b").mapInPandas(run, "v long, r long, pr long")


def components(pairs: DataFrame, a: str, b: str, key: str = "id", cell_edges: int = 500_000, most_rounds: int = 60) -> DataFrame:
    """(key, group_id) of every record linked to at least one other; a and b are whole-number identifiers."""
    ends = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
    edges = cut(ends.distinct())
    n = edges.count()
    levels = []
    for _ in range(most_rounds):
        if n == 0:
            break
        stars = cut(_round(edges, n, cell_edges))
        parents = stars.groupBy("v").agg(F.min_by("r", "pr").alias("p"))
        if n <= cell_edges:  # one cell held all edges: the representatives are final
            levels.append(parents)
            n = 0
            break
        parents = cut(parents)
        levels.append(parents)
        links = stars.join(parents, "v").where(F.col("r") != F.col("p")).select(F.least("r", "p").alias("a"), F.greatest("r", "p").alias("b"))
        edges = cut(links.distinct())
        n = edges.count()
    if n:
        raise RuntimeError("components did not stabilise")
    if not levels:
        return edges.select(F.col("a").alias(key), F.col("b").alias("group_id")).limit(0)
    # Down again: a vertex's root is the root of its parent. The last level's parents are roots.
    roots = levels[-1].select("v", F.col("p").alias("root"))
    for below in reversed(levels[:-1]):
        # Vertices of the level above keep their roots (all are among the vertices below or their parents).
        up = below.join(roots.select(F.col("v").alias("p"), "root"), "p", "left").select("v", F.coalesce("root", "p").alias("root"))
        roots = cut(up)
    smallest = roots.groupBy("root").agg(F.min("v").alias("least"))
    return roots.join(smallest, "root").select(F.col("v").alias(key), F.least("least", "root").alias("group_id"))


def event_links(responses: DataFrame, event: str = "event_id", members: str = "det_ids") -> DataFrame:
    """(a, b): each member of an event (its name without regard to case, all rows together) with the event's smallest member."""
    rows = responses.where(F.col(event).isNotNull()).select(F.lower(F.trim(F.col(event))).alias("event"), F.explode(members).alias("a")).where(F.col("a").isNotNull()).distinct()
    least = rows.groupBy("event").agg(F.min("a").alias("b"))
    return rows.join(least, "event").where("a <> b").select("a", "b")
