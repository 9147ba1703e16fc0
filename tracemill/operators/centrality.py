"""Betweenness centrality (Brandes, 2001), one source at a time over the part of the graph it belongs to."""

from __future__ import annotations

import heapq
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracemill.operators.components import connected


def brandes(edges: list[tuple[str, str]]) -> dict[str, float]:
    """Unnormalised betweenness of a directed graph, all sources."""
    out: dict[str, list[str]] = {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
        out.setdefault(v, [])
    score = dict.fromkeys(out, 0.0)
    for s in out:
        order, paths, dist, before = [], {s: 1.0}, {s: 0}, {s: []}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    return score


def betweenness(t, edges: DataFrame) -> DataFrame:
    """(id, score): positive betweenness over edges (u, v), divided by (n - 1)(n - 2) for the whole graph's n.

    Shortest paths never leave a weakly connected part, so each part is one group.
    """
    parts = edges.join(connected(edges).withColumnRenamed("id", "u"), "u")
    n = edges.select(F.explode(F.array("u", "v")).alias("x")).distinct().agg(F.count("*").alias("n"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        score = brandes(list(zip(part.u, part.v)))
        return pd.DataFrame({"id": list(score), "score": list(score.values())})

    scored = parts.groupBy("root").applyInPandas(solve, "id string, score double").where("score > 0")
    return scored.crossJoin(F.broadcast(n)).select("id", F.round(F.col("score") / ((F.col("n") - 1) * (F.col("n") - 2)), 12).alias("score"))


def weighted_betweenness(edges: list[tuple]) -> dict:
    """Directed betweenness over edges (u, v, weight), a path's length the sum of its weights; no normalisation."""
    out: dict = {}
    for u, v, w in edges:
        out.setdefault(u, {})[v] = w
        out.setdefault(v, {})
    score = dict.fromkeys(out, 0.0)
    for s in out:
        dist, paths, before, done, heap, n = {s: 0}, {s: 1.0}, {s: []}, [], [(0, 0, s)], 0
        seen = set()
        while heap:
            d, _, v = heapq.heappop(heap)
            if v in seen:
                continue
            seen.add(v)
            done.append(v)
            for x, w in out[v].items():
                if x not in dist or d + w < dist[x]:
                    n += 1
                    dist[x], paths[x], before[x] = d + w, paths[v], [v]
                    heapq.heappush(heap, (d + w, n, x))
                elif d + w == dist[x] and x not in seen:
                    paths[x] += paths[v]
                    before[x].append(v)
        share = dict.fromkeys(done, 0.0)
        for x in reversed(done):
            for v in before[x]:
                share[v] += paths[v] / paths[x] * (1 + share[x])
            if x != s:
                score[x] += share[x]
    return score


def brokers(edges: DataFrame, agents: DataFrame) -> DataFrame:
    """(execution_id, agent_id, score) of every agent of agents(execution_id, agent_id, rounds): betweenness over the
    turns of a run, of edges (execution_id, a, rk, b, weight) from a round to the next, summed over rounds and divided
    by (n - 1)(n - 2) for its n turns."""

    def solve(run: pd.DataFrame) -> pd.DataFrame:
        score = weighted_betweenness([((r.a, r.rk), (r.b, r.rk + 1), r.weight) for r in run.itertuples(index=False)])
        rows = pd.DataFrame({"execution_id": run.execution_id.iloc[0], "agent_id": [a for a, _ in score], "score": list(score.values())})
        return rows.groupby(["execution_id", "agent_id"], as_index=False).score.sum()

    found = edges.groupBy("execution_id").applyInPandas(solve, "execution_id string, agent_id string, score double")
    n = agents.groupBy("execution_id").agg((F.count("*") * F.max("rounds")).alias("n"))
    rows = agents.select("execution_id", "agent_id").join(found, ["execution_id", "agent_id"], "left").join(n, "execution_id")
    score = F.when((F.col("n") > 2) & F.col("score").isNotNull(), F.col("score") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    return rows.select("execution_id", "agent_id", F.round(score, 12).alias("score"))
