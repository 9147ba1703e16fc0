"""What a viewer draws: turns and documents as nodes, facts as edges; who produced, passed on and kept them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tracemill.operators.base import Trace
from tracemill.plans.census import TOPICS
from tracemill.plans.lifecycle import r6
from tracemill.plans.registry import query
from tracemill.plans.restated import _count
from tracemill.plans.topics import _topic

SLOTS = ", sl AS (SELECT execution_id, agent_id, round, rk, fact_id, agent_id || '|' || round AS slot FROM sa)"


def _slots(t: Trace) -> DataFrame:
    return t.said_at.select("execution_id", "agent_id", "round", "rk", "fact_id", F.concat_ws("|", "agent_id", "round").alias("slot"))


def _next(t: Trace) -> DataFrame:
    """A fact in a turn and, by the same agent or another, in the next round; by another only if it did not say it in this one."""
    s = _slots(t)
    a = s.select("execution_id", "fact_id", "rk", F.col("agent_id").alias("a"), F.col("slot").alias("src"))
    b = s.select("execution_id", "fact_id", (F.col("rk") - 1).alias("rk"), F.col("agent_id").alias("b"), F.col("slot").alias("dst"))
    own = s.select("execution_id", "fact_id", "rk", F.col("agent_id").alias("b"), F.lit(True).alias("own"))
    e = a.join(b, ["execution_id", "fact_id", "rk"]).join(own, ["execution_id", "fact_id", "rk", "b"], "left").where("a = b or own is null")
    return e.withColumn("kind", F.when(F.col("a") == F.col("b"), "persistence").otherwise("transmission"))


@query(SLOTS + """, ed AS (SELECT p.execution_id, CASE WHEN p.agent_id = n.agent_id THEN 'persistence' ELSE 'transmission' END AS kind, p.slot AS src, n.slot AS dst, p.fact_id FROM sl p JOIN sl n ON n.execution_id = p.execution_id AND n.fact_id = p.fact_id AND n.rk = p.rk + 1
  LEFT JOIN sl o ON o.execution_id = p.execution_id AND o.fact_id = p.fact_id AND o.rk = p.rk AND o.agent_id = n.agent_id WHERE p.agent_id = n.agent_id OR o.slot IS NULL
UNION ALL SELECT sl.execution_id, 'origin', 'SRC', slot, fact_id FROM sl JOIN (SELECT DISTINCT execution_id, fact_id FROM m WHERE channel = 'source') USING (execution_id, fact_id) WHERE rk = 1)
SELECT execution_id, kind, src, dst, array_to_string(list_sort(list_distinct(list(fact_id))), ',') AS facts FROM ed GROUP BY 1, 2, 3, 4""")  # fmt: skip
def view_spacetime(t: Trace) -> DataFrame:
    """Edges of the graph of turns with their facts: from the sources to the first round, kept, and passed on.

    The facts of an edge are those of one turn, so the list is no longer than a turn.
    """
    origin = _slots(t).where("rk = 1").join(t.source_facts, ["execution_id", "fact_id"]).select("execution_id", F.lit("origin").alias("kind"), F.lit("SRC").alias("src"), F.col("slot").alias("dst"), "fact_id")
    e = _next(t).select("execution_id", "kind", "src", "dst", "fact_id").unionByName(origin)
    return e.groupBy("execution_id", "kind", "src", "dst").agg(F.array_join(F.array_sort(F.collect_set("fact_id")), ",").alias("facts"))


@query(SLOTS + """, fs AS (SELECT execution_id, agent_id, fact_id, min(round) AS f FROM said GROUP BY 1, 2, 3),
lt AS (SELECT rc.execution_id, listener, rc.round, speaker, rc.fact_id, max(sent_round) AS sent FROM rc JOIN fs ON fs.execution_id = rc.execution_id AND fs.agent_id = listener AND fs.fact_id = rc.fact_id AND f = rc.round WHERE sent_round < rc.round AND speaker <> listener GROUP BY 1, 2, 3, 4, 5)
SELECT DISTINCT fs.execution_id, fs.fact_id, 'origin' AS kind, doc_id AS src, fs.agent_id || '|' || f AS dst FROM fs JOIN (SELECT execution_id, fact_id, doc_id FROM m WHERE channel = 'source' AND doc_id IS NOT NULL) d ON d.execution_id = fs.execution_id AND d.fact_id = fs.fact_id
UNION ALL SELECT p.execution_id, p.fact_id, 'persistence', p.slot, n.slot FROM sl p JOIN sl n ON n.execution_id = p.execution_id AND n.fact_id = p.fact_id AND n.agent_id = p.agent_id AND n.rk = p.rk + 1
UNION ALL SELECT execution_id, fact_id, 'transmission', speaker || '|' || sent, listener || '|' || round FROM lt""")  # fmt: skip
def view_links(t: Trace) -> DataFrame:
    """Links of each fact: from a document to the turn in which an agent first said it, kept to the next round, and from
    the latest delivered turn of each speaker to the turn in which it was new to the receiver."""
    slot = lambda a, r: F.concat_ws("|", a, r)
    docs = t.mentions.where("channel = 'source' and doc_id is not null").select("execution_id", "fact_id", F.col("doc_id").alias("src")).distinct()
    origin = t.first_said.join(docs, ["execution_id", "fact_id"]).select("execution_id", "fact_id", F.lit("origin").alias("kind"), "src", slot("agent_id", "first_round").alias("dst"))
    keep = _next(t).where("kind = 'persistence'").select("execution_id", "fact_id", "kind", "src", "dst")
    new = t.first_said.select("execution_id", F.col("agent_id").alias("listener"), "fact_id", F.col("first_round").alias("round"))
    sent = t.received.where("sent_round < round and speaker <> listener").join(new, ["execution_id", "listener", "fact_id", "round"])
    sent = sent.groupBy("execution_id", "fact_id", "listener", "round", "speaker").agg(F.max("sent_round").alias("sent"))
    sent = sent.select("execution_id", "fact_id", F.lit("transmission").alias("kind"), slot("speaker", "sent").alias("src"), slot("listener", "round").alias("dst"))
    return origin.unionByName(keep).unionByName(sent)


FROM = """, gt AS (SELECT DISTINCT execution_id, listener AS agent_id, round, fact_id FROM rc WHERE speaker <> listener), sr AS (SELECT DISTINCT execution_id, fact_id FROM m WHERE channel = 'source'),
fm AS (SELECT sa.*, own_first_rk < rk AS own, gt.fact_id IS NOT NULL AS got, sr.fact_id IS NOT NULL AS src FROM sa LEFT JOIN gt ON gt.execution_id = sa.execution_id AND gt.agent_id = sa.agent_id AND gt.round = sa.round AND gt.fact_id = sa.fact_id LEFT JOIN sr ON sr.execution_id = sa.execution_id AND sr.fact_id = sa.fact_id)"""


def _from(t: Trace) -> DataFrame:
    """Each fact of a turn with whether the agent had said it, peers had delivered it, a source holds it."""
    got = t.received.where("speaker <> listener").select("execution_id", F.col("listener").alias("agent_id"), "round", "fact_id").distinct().withColumn("got", F.lit(True))
    s = t.said_at.join(got, ["execution_id", "agent_id", "round", "fact_id"], "left").join(t.source_facts.withColumn("src", F.lit(True)), ["execution_id", "fact_id"], "left")
    return s.withColumns({"own": F.col("own_first_rk") < F.col("rk"), "got": F.coalesce("got", F.lit(False)), "src": F.coalesce("src", F.lit(False))})


@query(FROM + " SELECT execution_id, agent_id, round, count(*) AS n, count(CASE WHEN src AND NOT own AND NOT got THEN 1 END) AS from_source, count(CASE WHEN got AND NOT own AND NOT src THEN 1 END) AS from_peer, count(CASE WHEN own THEN 1 END) AS held_over, count(CASE WHEN NOT (own OR got OR src) THEN 1 END) AS novel FROM fm GROUP BY 1, 2, 3")
def operator_turns(t: Trace) -> DataFrame:
    """Facts of each turn that only a source, only peers, or the agent's own turns held before, or nothing did."""
    return _from(t).groupBy("execution_id", "agent_id", "round").agg(F.count("*").alias("n"), _count("src and not own and not got").alias("from_source"), _count("got and not own and not src").alias("from_peer"), _count("own").alias("held_over"), _count("not (own or got or src)").alias("novel"))


@query(FROM + """, e AS (SELECT execution_id, agent_id AS src, agent_id AS dst, 'persist' AS kind FROM fm WHERE own
UNION ALL SELECT fm.execution_id, r.speaker, fm.agent_id, 'transmit' FROM fm JOIN (SELECT DISTINCT execution_id, listener, round, fact_id, speaker FROM rc WHERE speaker <> listener) r ON r.execution_id = fm.execution_id AND r.listener = fm.agent_id AND r.round = fm.round AND r.fact_id = fm.fact_id WHERE NOT own
UNION ALL SELECT fm.execution_id, d.doc_id, fm.agent_id, 'read' FROM fm JOIN (SELECT DISTINCT execution_id, fact_id, doc_id FROM m WHERE channel = 'source' AND doc_id IS NOT NULL) d ON d.execution_id = fm.execution_id AND d.fact_id = fm.fact_id WHERE NOT own AND NOT got
UNION ALL SELECT execution_id, agent_id || '*', agent_id, 'invent' FROM fm WHERE NOT (own OR got OR src)) SELECT execution_id, src, dst, kind, count(*) AS weight FROM e GROUP BY 1, 2, 3, 4""")  # fmt: skip
def operator_edges(t: Trace) -> DataFrame:
    """Weights of keeping, passing on, reading and inventing between agents and documents."""
    f = _from(t)
    row = lambda d, src, kind: d.select("execution_id", src.alias("src"), F.col("agent_id").alias("dst"), F.lit(kind).alias("kind"))
    speakers = t.received.where("speaker <> listener").select("execution_id", F.col("listener").alias("agent_id"), "round", "fact_id", "speaker").distinct()
    docs = t.mentions.where("channel = 'source' and doc_id is not null").select("execution_id", "fact_id", "doc_id").distinct()
    e = row(f.where("own"), F.col("agent_id"), "persist")
    e = e.unionByName(row(f.where("not own").join(speakers, ["execution_id", "agent_id", "round", "fact_id"]), F.col("speaker"), "transmit"))
    e = e.unionByName(row(f.where("not own and not got").join(docs, ["execution_id", "fact_id"]), F.col("doc_id"), "read"))
    e = e.unionByName(row(f.where("not (own or got or src)"), F.concat("agent_id", F.lit("*")), "invent"))
    return e.groupBy("execution_id", "src", "dst", "kind").agg(F.count("*").alias("weight"))


@query(", h AS (SELECT execution_id, fact_id, count(DISTINCT agent_id) AS n FROM said GROUP BY 1, 2) SELECT execution_id, count(*) AS facts, count(CASE WHEN n = 1 THEN 1 END) AS dead_ends, count(CASE WHEN n > 1 THEN 1 END) AS spread, round(coalesce(avg(CASE WHEN n > 1 THEN n - 1 END), 0), 6) AS fanout FROM h GROUP BY 1")
def fact_reach(t: Trace) -> DataFrame:
    """Facts that stayed with one agent, those that spread, and to how many others."""
    h = t.said.groupBy("execution_id", "fact_id").agg(F.countDistinct("agent_id").alias("n"))
    return h.groupBy("execution_id").agg(F.count("*").alias("facts"), _count("n = 1").alias("dead_ends"), _count("n > 1").alias("spread"), r6(F.coalesce(F.avg(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0.0))).alias("fanout"))


@query(", fs AS (SELECT execution_id, agent_id, fact_id, min(round) AS f FROM said GROUP BY 1, 2, 3) SELECT us.execution_id, fs.agent_id AS peer, us.agent_id, count(*) AS adopted FROM us JOIN fs ON fs.execution_id = us.execution_id AND fs.fact_id = us.fact_id AND fs.agent_id <> us.agent_id AND f < us.round WHERE use = 'adopted' GROUP BY 1, 2, 3")
def es_adopted_matrix(t: Trace) -> DataFrame:
    """Adopted facts by every peer that had said them in any earlier round."""
    p = t.first_said.select("execution_id", F.col("agent_id").alias("peer"), "fact_id", "first_round")
    u = t.uses.where("use = 'adopted'").select("execution_id", "agent_id", "round", "fact_id").join(p, ["execution_id", "fact_id"])
    return u.where("peer <> agent_id and first_round < round").groupBy("execution_id", "peer", "agent_id").agg(F.count("*").alias("adopted"))


@query(TOPICS + ", vs AS (SELECT execution_id, fact_id FROM m WHERE channel = 'source' UNION SELECT execution_id, fact_id FROM rc), mx AS (SELECT execution_id, coalesce(topic, 'unlabelled') AS topic, side, count(*) AS n FROM (SELECT execution_id, fact_id, 'context' AS side FROM vs UNION ALL SELECT DISTINCT execution_id, fact_id, 'output' FROM said) LEFT JOIN tp USING (fact_id) GROUP BY 1, 2, 3), sh AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY execution_id, side) AS p FROM mx) SELECT execution_id, topic, round(sum(CASE WHEN side = 'context' THEN p ELSE 0 END), 6) AS context, round(sum(CASE WHEN side = 'output' THEN p ELSE 0 END), 6) AS output, round(sum(CASE WHEN side = 'output' THEN p ELSE -p END), 6) AS tilt FROM sh GROUP BY 1, 2")
def context_output_mix(t: Trace) -> DataFrame:
    """A label's share of what a run's agents could see and of what they said, and the difference."""
    seen = t.source_facts.unionByName(t.received.select("execution_id", "fact_id")).distinct().withColumn("side", F.lit("context"))
    d = _topic(t, seen.unionByName(t.said.select("execution_id", "fact_id").distinct().withColumn("side", F.lit("output"))))
    n = d.groupBy("execution_id", "topic", "side").agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("execution_id", "side")))
    of = lambda s: F.sum(F.when(F.col("side") == s, F.col("p")).otherwise(0.0))
    return n.groupBy("execution_id", "topic").agg(r6(of("context")).alias("context"), r6(of("output")).alias("output"), r6(of("output") - of("context")).alias("tilt"))


@query(", q AS (SELECT n.execution_id, n.agent_id, n.fact_id, n.rk, bool_or(p.agent_id = n.agent_id) AS own, bool_or(p.agent_id <> n.agent_id) AS peer FROM sa n LEFT JOIN sa p ON p.execution_id = n.execution_id AND p.fact_id = n.fact_id AND p.rk = n.rk - 1 WHERE n.rk > 1 GROUP BY 1, 2, 3, 4) SELECT execution_id, agent_id, count(*) AS later, round(avg(CAST(coalesce(peer AND NOT own, false) AS DOUBLE)), 6) AS adoption, round(avg(CAST(coalesce(own, false) AS DOUBLE)), 6) AS persistence FROM q GROUP BY 1, 2")
def adoption_persistence(t: Trace) -> DataFrame:
    """Of what an agent said after the first round: the share peers had said in the round before and it had not, and the share it had."""
    s = t.said_at.select("execution_id", "agent_id", "fact_id", "rk")
    p = s.select("execution_id", "fact_id", (F.col("rk") + 1).alias("rk"), F.col("agent_id").alias("p"))
    same, no = F.col("p") == F.col("agent_id"), F.lit(False)
    q = s.where("rk > 1").join(p, ["execution_id", "fact_id", "rk"], "left").groupBy("execution_id", "agent_id", "fact_id", "rk").agg(F.bool_or(same).alias("own"), F.bool_or(~same).alias("peer"))
    share = lambda c: r6(F.avg(F.coalesce(c, no).cast("double")))
    return q.groupBy("execution_id", "agent_id").agg(F.count("*").alias("later"), share(F.col("peer") & ~F.col("own")).alias("adoption"), share(F.col("own")).alias("persistence"))
