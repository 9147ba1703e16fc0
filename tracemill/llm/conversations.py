"""Rebuilding conversations from message rows.

Method: each conversation's reply graph is sorted topologically with Kahn's algorithm, ties broken by
the order columns; turns left over reveal a cycle. Then role alternation and completeness are checked.

A conversation of any size may stand in the data, so counts come first, by partial aggregation: only
a conversation with exactly as many turns as its roster asks for reaches the sort, which bounds the
rows that one group can bring to a task by roles x rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Characters that show nothing although their class is not blank, control or format.
UNSEEN = "͏ᅟᅠ឴឵⠀ㅤﾠ︀-️"


def visible(text: str | Column) -> Column:
    """Whether a text has a character that shows; false for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(rf"[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}\p{{Cn}}\p{{Cs}}{UNSEEN}]")


def kahn(nodes: list, parents: list[list], keys: list) -> list[int] | None:
    """Positions in topological order, the smallest key first among those free; None if a turn is left over,
    stands twice or replies to a turn that is not there."""
    at = {n: i for i, n in enumerate(nodes)}
    if len(at) < len(nodes):
        return None
    waits, replies = [0] * len(nodes), [[] for _ in nodes]
    for i, ps in enumerate(parents):
        for p in ps:
            j = at.get(p)
            if j is None:
                return None
            replies[j].append(i)
            waits[i] += 1
    free = [(keys[i], i) for i, n in enumerate(waits) if not n]
    heapq.heapify(free)
    out = []
    while free:
        _, i = heapq.heappop(free)
        out.append(i)
        for j in replies[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(free, (keys[j], j))
    return out if len(out) == len(nodes) else None


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    """Groups of rows with one conversation id; rows come sorted by it, and groups may span batches."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["conversation"] != at and rows:
                yield at, rows
                rows = []
            at = row["conversation"]
            rows.append(row)
    if rows:
        yield at, rows


def sort_turns(turns: DataFrame) -> DataFrame:
    """(conversation, turn_no, record_no, speaker) of every conversation whose reply graph is sound.

    turns(conversation string, node string, parents array<string>, rank array<string or number> as a
    sortable struct ``key``, record_no long, speaker string, cast int): ``cast`` is the number of speakers
    who must each speak once in every stretch of that many turns. A conversation with a cycle, a missing
    parent, a repeated node or a broken alternation is left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"conversation": [], "turn_no": [], "record_no": [], "speaker": []}
        for at, rows in _conversations(batches):
            order = kahn([r["node"] for r in rows], [r["parents"] for r in rows], [tuple(r["key"].values()) for r in rows])
            if order is None:
                continue
            cast = rows[0]["cast"]
            said = [rows[i]["speaker"] for i in order]
            if len(said) % cast or any(len(set(said[i : i + cast])) < cast for i in range(0, len(said), cast)):
                continue
            out["conversation"] += [at] * len(order)
            out["turn_no"] += range(1, len(order) + 1)
            out["record_no"] += [rows[i]["record_no"] for i in order]
            out["speaker"] += said
            if len(out["turn_no"]) > 50_000:
                yield pa.RecordBatch.from_pydict(out, SCHEMA)
                out = {k: [] for k in out}
        yield pa.RecordBatch.from_pydict(out, SCHEMA)

    SCHEMA = pa.schema([("conversation", pa.string()), ("turn_no", pa.int64()), ("record_no", pa.int64()), ("speaker", pa.string())])
    rows = turns.select("conversation", "node", "parents", "key", "record_no", "speaker", "cast")
    return rows.repartition("conversation").sortWithinPartitions("conversation").mapInArrow(run, "conversation string, turn_no long, record_no long, speaker string")


def whole_debates(trace_records: DataFrame, debates: DataFrame) -> DataFrame:
    """(execution_id, turn_no, record_no, agent_id, role): the output turns of whole debates, in order.

    A debate is whole when debates has its row, each agent of roles has exactly one output record in each
    round from 1 to rounds, no other output record of the execution exists, and each text has a visible
    character. Redelivered records (one record_no) are one; so are repeated debates rows. Null execution
    ids, null or empty roles and null or non-positive rounds make no whole debate. Turns count by round,
    then agent. Empty tables give an empty result; extra columns are ignored.
    """
    said = trace_records.where("provenance.channel = 'output' and provenance.execution_id is not null and record_no is not null")
    said = said.select("record_no", F.col("provenance.execution_id").alias("execution_id"), F.col("provenance.agent_id").alias("agent_id"), F.col("provenance.round").alias("round"), visible("text").alias("seen"), "logged_at")
    said = said.groupBy("record_no").agg(F.min(F.struct("logged_at", "execution_id", "agent_id", "round", "seen")).alias("r")).select("record_no", "r.*")
    held = debates.where("execution_id is not null and rounds > 0 and size(roles) > 0").groupBy("execution_id").agg(F.min_by(F.struct("roles", "rounds"), F.struct("started_at", F.to_json("roles"), "rounds")).alias("d"))
    held = held.select("execution_id", "d.roles", "d.rounds")
    fit = (F.col("agent_id").isNotNull() & F.col("round").isNotNull() & F.col("seen"))
    counts = said.groupBy("execution_id").agg(F.count("*").alias("n"), F.count(F.when(~fit, 1)).alias("bad"))
    held = held.join(counts, "execution_id").where("bad = 0 and n = size(roles) * rounds").select("execution_id", "roles", "rounds")
    turns = said.join(held, "execution_id").select(
        F.col("execution_id").alias("conversation"),
        F.concat_ws("|", F.col("round").cast("string"), "agent_id").alias("node"),
        # Each turn answers all turns of the round before; the first round answers none.
        F.when(F.col("round") == 1, F.array().cast("array<string>")).otherwise(F.transform(F.map_keys("roles"), lambda a: F.concat_ws("|", (F.col("round") - 1).cast("string"), a))).alias("parents"),
        F.struct("round", "agent_id", "logged_at").alias("key"),
        "record_no", F.col("agent_id").alias("speaker"), F.size("roles").alias("cast"),
        F.col("roles")[F.col("agent_id")].alias("role"), F.array_contains(F.map_keys("roles"), F.col("agent_id")).alias("known"), "round", "rounds",
    )
    off = turns.where("not known or round < 1 or round > rounds").select("conversation").distinct()
    turns = turns.join(off, "conversation", "left_anti")
    out = sort_turns(turns)
    roles = held.select(F.col("execution_id").alias("conversation"), "roles")
    return out.join(roles, "conversation").select(F.col("conversation").alias("execution_id"), "turn_no", "record_no", F.col("speaker").alias("agent_id"), F.col("roles")[F.col("speaker")].alias("role"))
