"""Consolidating pairwise matches into groups.

Method: a two-dimensional grid. Vertices are hashed into blocks, an edge belongs to the cell of its
two blocks, and each cell runs union-find over its own edges. Each vertex then takes the best of the
representatives which the cells of its row and column gave it; what other representatives it met
become the edges of the next round, over representatives only. The rounds end when none is left.

Representatives are chosen by a hash that changes each round, not by id, so that long sorted chains
shrink by a constant share each round. A cell that holds more than ``cell_edges`` edges (a hot vertex
fills its whole row) is split further by a hash of the edge; the union over cells stays the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracemill.llm._sets import mix
from tracemill.runtime import Scratch


def local_union(u: np.ndarray, v: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union-find over one cell: its vertices, each one's representative and that one's priority (lower is better)."""
    ids, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    priority = mix(ids.view(np.uint64) ^ np.uint64(seed)).view(np.int64)
    order = np.argsort(priority, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    a, b = rank[where[: len(u)]], rank[where[len(u) :]]
    parent = np.arange(len(ids))
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    best = order[parent[rank]]
    return ids, ids[best], priority[best]


def _solver(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def solve(cell: pd.DataFrame) -> pd.DataFrame:
        v, rep, priority = local_union(cell.u.to_numpy(), cell.v.to_numpy(), seed)
        return pd.DataFrame({"v": v, "rep": rep, "priority": priority})

    return solve


def grid_components(edges: DataFrame, scratch: Scratch, *, cell_edges: int = 500_000, blocks: int = 4) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (u, v of type long; rows with a null or u = v link nothing).

    The root is some vertex of the component, the same for all its vertices. No edges: an empty table.
    """
    spark = edges.sparkSession
    pair = lambda x, y: [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]
    left = scratch.keep(edges.where("u <> v").select(*pair("u", "v")).distinct())
    parents: list[DataFrame] = []
    seed = 0
    while True:
        n = left.count()
        if not n:
            break
        seed += 1
        # At least `blocks` a side; a cell holds cell_edges of an even spread.
        side = min(256, max(blocks, math.ceil(math.sqrt(2 * n / cell_edges))))
        block = lambda x: F.pmod(F.xxhash64(F.lit(seed), x), F.lit(side))  # noqa: B023, E731
        cells = left.select("u", "v", F.least(block("u"), block("v")).alias("i"), F.greatest(block("u"), block("v")).alias("j"))
        # At most side * (side + 1) / 2 <= 32,896 rows, so the broadcast is bounded.
        parts = cells.groupBy("i", "j").agg(F.ceil(F.count("*") / cell_edges).alias("parts"))
        cells = cells.join(F.broadcast(parts), ["i", "j"]).withColumn("part", F.pmod(F.xxhash64("u", "v"), "parts"))

        met = cells.groupBy("i", "j", "part").applyInPandas(_solver(seed), "v long, rep long, priority long")
        # A vertex meets one representative a cell of its row and column: a bounded set.
        chosen = scratch.keep(met.groupBy("v").agg(F.min(F.struct("priority", "rep")).rep.alias("m"), F.collect_set("rep").alias("reps")))
        parents.append(chosen)
        before, left = left, scratch.keep(chosen.select("m", F.explode("reps").alias("rep")).where("m <> rep").select(*pair("m", "rep")).distinct())
        scratch.drop(before)
    if not parents:
        return spark.createDataFrame([], "v long, root long")
    # v's parent of the first round has its own in the second, and so on; later rounds have ever fewer vertices.
    out = parents[0].select("v", F.col("m").alias("root"))
    for chosen in parents[1:]:
        out = out.join(chosen.select(F.col("v").alias("root"), "m"), "root", "left").select("v", F.coalesce("m", "root").alias("root"))
    return out


def group_members(pairs: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """Every member whose group has at least two: (id, group_id), group_id the smallest id of the group.

    pairs(a, b): links between ids. sets(set_id, id): ids that one set holds together. members(id): the
    known ids; any other links nothing. Nulls, a = b, repeated rows and ids link nothing more. Either
    table may be empty. An id or a set may have any share of the rows: ids meet in hash joins whose
    skewed partitions AQE splits, sets are reduced by partial aggregation.
    """
    scratch = Scratch(members.sparkSession, "groups")
    known = scratch.keep(members.where("id is not null").select("id").distinct().withColumn("n", F.monotonically_increasing_id()))
    of = lambda name: known.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"))
    linked = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    linked = linked.join(of("a"), "a").join(of("b"), "b").select(F.col("a_n").alias("u"), F.col("b_n").alias("v"))
    held = sets.where("id is not null and set_id is not null").distinct().join(known, "id").select("set_id", "n")
    first = held.groupBy("set_id").agg(F.min("n").alias("u"), F.max("n").alias("last")).where("u < last").drop("last")
    star = held.join(first, "set_id").select("u", F.col("n").alias("v"))
    roots = grid_components(linked.unionByName(star), scratch)
    named = scratch.keep(roots.join(known, roots.v == known.n).select("id", "root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("group_id"))
    return named.join(smallest, "root").select("id", "group_id")


def fact_groups(relations: DataFrame, facts: DataFrame, mentions: DataFrame, *, label: str = "EQUIVALENT", confidence: float = 0.85) -> DataFrame:
    """(mention_id, group_id): mentions joined by relations of this label and confidence, or by one facts row.

    Case and surrounding whitespace of labels are ignored, null labels never match, null confidence counts
    as 1. Contradicting rows do not undo a link. Extra columns are ignored.
    """
    judged = relations.where((F.upper(F.trim(F.regexp_replace("relation", r"^\s+|\s+$", ""))) == label) & (F.coalesce("confidence", F.lit(1.0)) >= confidence))
    held = facts.select(F.col("ord").alias("set_id"), F.explode("mention_ids").alias("id"))
    out = group_members(judged.select("a", "b"), held, mentions.select(F.col("mention_id").alias("id")))
    return out.select(F.col("id").alias("mention_id"), "group_id")
