"""Connected components by alternating minima: every vertex takes the smallest of its neighbours' labels, then its label's label."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracemill.runtime import Scratch


#: Edges that a task joins at once before the rounds.
CHUNK = 200_000


def _joined(edges: pd.DataFrame) -> pd.DataFrame:
    """Each vertex but the smallest with the smallest of its component, by hooking roots and halving paths."""
    ids, code = np.unique(np.concatenate([edges.u.to_numpy(), edges.v.to_numpy()]), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(code[: len(edges)].tolist(), code[len(edges) :].tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    root = np.array([find(x) for x in range(len(ids))], np.int64)
    child = root != np.arange(len(ids))
    return pd.DataFrame({"u": ids[child], "v": ids[root[child]]})


def _contracted(chunk: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), chunk):
                held.append(batch[at : at + chunk])
                n += len(held[-1])
                if n >= chunk:
                    yield _joined(pd.concat(held))
                    held, n = [], 0
        if n:
            yield _joined(pd.concat(held))

    return run


def connected(edges: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(id, root) of every vertex of edges (u, v), root the smallest id of its component.

    Each task first joins the edges it holds, so many at a time, and hands on a star for each part it found. Then
    large-star and small-star rounds over the distributed edges (Kiveris et al., 2014), each written to the shared
    folder; they end when the edges no longer change. Rows with nulls or u = v link nothing.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    kind = dict(e.dtypes)["u"]
    e = scratch.keep(e.mapInPandas(_contracted(chunk), f"u {kind}, v {kind}"))
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = digest(e)
    while True:
        # Large star: larger neighbours of each vertex go to the smallest vertex around it.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each vertex and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        nxt = scratch.keep(small)
        now = digest(nxt)
        scratch.drop(e)
        e = nxt
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
