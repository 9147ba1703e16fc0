"""What becomes of statements from round to round: weakened, strengthened, kept; by whom and before whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracemill.operators.base import Trace
from tracemill.plans.lifecycle import r6
from tracemill.plans.registry import query

KINDS = ("equivalent", "weaken", "strengthen")

EVENTS = """,
jm AS (SELECT jd.a, jd.b, label, x.execution_id, x.fact_id AS fa, y.fact_id AS fb, x.agent_id AS ga, y.agent_id AS gb, x.round AS ra, y.round AS rb
  FROM jd JOIN m x ON jd.a = x.mention_id JOIN m y ON jd.b = y.mention_id AND x.execution_id = y.execution_id
  WHERE x.channel = 'output' AND y.channel = 'output' AND x.agent_id IS NOT NULL AND y.agent_id IS NOT NULL AND x.round > 0 AND y.round > 0 AND x.round <> y.round
  AND label IN ('EQUIVALENT', 'A_ENTAILS_B', 'B_ENTAILS_A')),
oe AS (SELECT DISTINCT execution_id, CASE WHEN ra < rb THEN a ELSE b END AS early, CASE WHEN ra < rb THEN b ELSE a END AS late,
  CASE WHEN ra < rb THEN fa ELSE fb END AS early_fact, CASE WHEN ra < rb THEN fb ELSE fa END AS late_fact, CASE WHEN ra < rb THEN ga ELSE gb END AS speaker,
  CASE WHEN ra < rb THEN gb ELSE ga END AS listener, least(ra, rb) AS sent_round, greatest(ra, rb) AS round,
  CASE WHEN label = 'EQUIVALENT' THEN 'equivalent' WHEN (label = 'A_ENTAILS_B') = (ra < rb) THEN 'weaken' ELSE 'strengthen' END AS kind FROM jm),
ev AS (SELECT oe.*, CASE WHEN oe.speaker = oe.listener THEN 'self' WHEN dl.speaker IS NOT NULL THEN 'peer' ELSE 'invisible' END AS side FROM oe
  LEFT JOIN dl ON dl.execution_id = oe.execution_id AND dl.listener = oe.listener AND dl.round = oe.round AND dl.speaker = oe.speaker AND dl.sent_round = oe.sent_round),
fs AS (SELECT execution_id, agent_id, fact_id, min(round) AS first_round FROM said GROUP BY 1, 2, 3),
sf AS (SELECT DISTINCT execution_id, fact_id FROM m WHERE channel = 'source')"""


def _count(c: Column | str) -> Column:
    return F.count(F.when(F.expr(c) if isinstance(c, str) else c, 1))


@query(EVENTS + " SELECT execution_id, side, kind, count(*) AS edges, count(DISTINCT late) AS targets FROM ev GROUP BY 1, 2, 3")
def ec_events(t: Trace) -> DataFrame:
    return t.restatements.groupBy("execution_id", "side", "kind").agg(F.count("*").alias("edges"), F.countDistinct("late").alias("targets"))


FLAGS = (
    EVENTS
    + """,
pw AS (SELECT ev.*, early_fact = late_fact AS same_cluster FROM ev WHERE side = 'peer' AND kind = 'weaken'),
rp AS (SELECT DISTINCT execution_id, listener, round, fact_id FROM rc), ls AS (SELECT execution_id, listener, round, speaker, max(sent_round) AS last_sent FROM dl GROUP BY 1, 2, 3, 4),
fg AS (SELECT pw.*, p.fact_id IS NOT NULL AS weak_in_peer, coalesce(w.first_round < pw.round, false) AS weak_in_self, ws.fact_id IS NOT NULL AS weak_in_source,
  coalesce(s.first_round < pw.round, false) AS strong_in_self, ss.fact_id IS NOT NULL AS strong_in_source, k.fact_id IS NOT NULL AS strong_retained, pw.sent_round = ls.last_sent AS latest_delivery
  FROM pw LEFT JOIN rp p ON p.execution_id = pw.execution_id AND p.listener = pw.listener AND p.round = pw.round AND p.fact_id = late_fact
  LEFT JOIN fs w ON w.execution_id = pw.execution_id AND w.agent_id = pw.listener AND w.fact_id = late_fact
  LEFT JOIN fs s ON s.execution_id = pw.execution_id AND s.agent_id = pw.listener AND s.fact_id = early_fact
  LEFT JOIN sf ws ON ws.execution_id = pw.execution_id AND ws.fact_id = late_fact LEFT JOIN sf ss ON ss.execution_id = pw.execution_id AND ss.fact_id = early_fact
  LEFT JOIN said k ON k.execution_id = pw.execution_id AND k.agent_id = pw.listener AND k.round = pw.round AND k.fact_id = early_fact
  JOIN ls ON ls.execution_id = pw.execution_id AND ls.listener = pw.listener AND ls.round = pw.round AND ls.speaker = pw.speaker),
fl2 AS (SELECT *, NOT (weak_in_peer OR weak_in_self OR weak_in_source) AS new_weak FROM fg),
wf AS (SELECT *, new_weak AND NOT (same_cluster OR strong_in_self OR strong_in_source OR strong_retained) AS conservative FROM fl2)"""
)
_FLAGS = ("same_cluster", "weak_in_peer", "weak_in_self", "weak_in_source", "strong_in_self", "strong_in_source", "strong_retained", "latest_delivery", "new_weak", "conservative")


def _weakenings(t: Trace) -> DataFrame:
    """Peers' statements that a later turn weakened, with where the weak and the strong form stood before."""
    e = t.restatements.where("side = 'peer' and kind = 'weaken'").drop("side", "kind")
    flag = lambda d, name: d.withColumn(name, F.lit(True))
    got = flag(t.received.select("execution_id", "listener", "round", F.col("fact_id").alias("late_fact")).distinct(), "weak_in_peer")
    first = lambda fact, name: t.first_said.select("execution_id", F.col("agent_id").alias("listener"), F.col("fact_id").alias(fact), F.col("first_round").alias(name))
    source = lambda fact, name: flag(t.source_facts.withColumnRenamed("fact_id", fact), name)
    kept = flag(t.said.select("execution_id", F.col("agent_id").alias("listener"), "round", F.col("fact_id").alias("early_fact")), "strong_retained")
    last = t.deliveries.groupBy("execution_id", "listener", "round", "speaker").agg(F.max("sent_round").alias("last_sent"))
    e = e.join(got, ["execution_id", "listener", "round", "late_fact"], "left").join(first("late_fact", "own_weak"), ["execution_id", "listener", "late_fact"], "left")
    e = e.join(first("early_fact", "own_strong"), ["execution_id", "listener", "early_fact"], "left").join(kept, ["execution_id", "listener", "round", "early_fact"], "left")
    e = e.join(source("late_fact", "weak_in_source"), ["execution_id", "late_fact"], "left").join(source("early_fact", "strong_in_source"), ["execution_id", "early_fact"], "left")
    e = e.join(last, ["execution_id", "listener", "round", "speaker"])
    no = F.lit(False)
    e = e.withColumns({
        "same_cluster": F.col("early_fact") == F.col("late_fact"), "weak_in_self": F.coalesce(F.col("own_weak") < F.col("round"), no), "strong_in_self": F.coalesce(F.col("own_strong") < F.col("round"), no),
        "latest_delivery": F.col("sent_round") == F.col("last_sent"), **{c: F.coalesce(c, no) for c in ("weak_in_peer", "weak_in_source", "strong_in_source", "strong_retained")},
    })
    e = e.withColumn("new_weak", ~(F.col("weak_in_peer") | F.col("weak_in_self") | F.col("weak_in_source")))
    return e.withColumn("conservative", F.col("new_weak") & ~(F.col("same_cluster") | F.col("strong_in_self") | F.col("strong_in_source") | F.col("strong_retained")))


@query(FLAGS + f" SELECT execution_id, early, late, {', '.join(_FLAGS)} FROM wf")
def ec_weaken_flags(t: Trace) -> DataFrame:
    return _weakenings(t).select("execution_id", "early", "late", *_FLAGS)


TARGETS = (
    EVENTS
    + """, om AS (SELECT execution_id, agent_id, round, mention_id, fact_id FROM m WHERE channel = 'output' AND agent_id IS NOT NULL AND round > 0),
tf AS (SELECT late, bool_or(side = 'peer' AND kind = 'weaken') AS pw, bool_or(side = 'peer' AND kind = 'strengthen') AS ps, bool_or(side = 'peer' AND kind = 'equivalent') AS pe,
  bool_or(side = 'self' AND kind = 'weaken') AS sw, bool_or(side = 'self' AND kind = 'strengthen') AS ss FROM ev GROUP BY 1),
tt AS (SELECT execution_id, agent_id, round, count(*) AS output_mentions, count(DISTINCT fact_id) AS output_facts, count(CASE WHEN pw THEN 1 END) AS peer_weaken, count(CASE WHEN ps THEN 1 END) AS peer_strengthen,
  count(CASE WHEN pe THEN 1 END) AS peer_equivalent, count(CASE WHEN sw THEN 1 END) AS self_weaken, count(CASE WHEN ss THEN 1 END) AS self_strengthen, count(CASE WHEN pw OR ps OR pe THEN 1 END) AS peer_related,
  count(CASE WHEN pw AND NOT pe THEN 1 END) AS weaken_only FROM om LEFT JOIN tf ON late = mention_id GROUP BY 1, 2, 3)"""
)


def _targets(t: Trace) -> DataFrame:
    hit = lambda side, kind: F.bool_or((F.col("side") == side) & (F.col("kind") == kind))
    f = t.restatements.groupBy(F.col("late").alias("mention_id")).agg(hit("peer", "weaken").alias("pw"), hit("peer", "strengthen").alias("ps"), hit("peer", "equivalent").alias("pe"), hit("self", "weaken").alias("sw"), hit("self", "strengthen").alias("ss"))
    m = t.mentions.where("channel = 'output' and agent_id is not null and round > 0").join(f, "mention_id", "left")
    return m.groupBy("execution_id", "agent_id", "round").agg(
        F.count("*").alias("output_mentions"), F.countDistinct("fact_id").alias("output_facts"), _count("pw").alias("peer_weaken"), _count("ps").alias("peer_strengthen"), _count("pe").alias("peer_equivalent"),
        _count("sw").alias("self_weaken"), _count("ss").alias("self_strengthen"), _count("pw or ps or pe").alias("peer_related"), _count("pw and not pe").alias("weaken_only"),
    )


@query(TARGETS + " SELECT * FROM tt")
def ec_turn_targets(t: Trace) -> DataFrame:
    """Mentions of each turn that restate an earlier turn, by how and whose."""
    return _targets(t)


RATES = FLAGS + TARGETS.removeprefix(EVENTS) + """,
cv AS (SELECT execution_id, count(DISTINCT listener || '|' || round || '|' || late_fact) AS conservative FROM wf WHERE conservative GROUP BY 1),
rt AS (SELECT execution_id, CAST(sum(peer_weaken) AS DOUBLE) / nullif(sum(output_mentions), 0) AS weaken_rate, CAST(sum(peer_strengthen) AS DOUBLE) / nullif(sum(output_mentions), 0) AS strengthen_rate,
  CAST(sum(peer_related) AS DOUBLE) / nullif(sum(output_mentions), 0) AS related_rate, coalesce(max(conservative), 0) / nullif(CAST(sum(output_facts) AS DOUBLE), 0) AS conservative_rate FROM tt LEFT JOIN cv USING (execution_id) WHERE round > 1 GROUP BY 1)"""
_RATES = ("weaken_rate", "strengthen_rate", "related_rate", "conservative_rate")


def _rates(t: Trace) -> DataFrame:
    c = _weakenings(t).where("conservative").groupBy("execution_id").agg(F.countDistinct("listener", "round", "late_fact").alias("conservative"))
    g = _targets(t).where("round > 1").groupBy("execution_id").agg(*(F.sum(x).alias(x) for x in ("output_mentions", "output_facts", "peer_weaken", "peer_strengthen", "peer_related"))).join(c, "execution_id", "left")
    of = lambda x, n: F.try_divide(F.col(x).cast("double"), F.col(n))
    return g.select("execution_id", of("peer_weaken", "output_mentions").alias("weaken_rate"), of("peer_strengthen", "output_mentions").alias("strengthen_rate"), of("peer_related", "output_mentions").alias("related_rate"), F.try_divide(F.coalesce("conservative", F.lit(0)).cast("double"), F.col("output_facts")).alias("conservative_rate"))


@query(RATES + " SELECT execution_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATES) + " FROM rt")
def ec_rates(t: Trace) -> DataFrame:
    """Shares of what later rounds said that weakens, strengthens or restates what peers had delivered."""
    return _rates(t).select("execution_id", *(r6(c).alias(c) for c in _RATES))


@query(", q AS (SELECT ea AS execution_id, count(CASE WHEN label IN ('A_ENTAILS_B', 'B_ENTAILS_A') THEN 1 END) AS oneway, count(CASE WHEN label = 'EQUIVALENT' THEN 1 END) AS equal FROM lf WHERE ea = eb GROUP BY 1) SELECT execution_id, oneway, equal, round(CAST(oneway AS DOUBLE) / nullif(oneway + equal, 0), 6) AS oneway_share FROM q")
def ec_oneway_share(t: Trace) -> DataFrame:
    q = t.lifted.where("ea = eb").groupBy(F.col("ea").alias("execution_id")).agg(_count("label in ('A_ENTAILS_B', 'B_ENTAILS_A')").alias("oneway"), _count("label = 'EQUIVALENT'").alias("equal"))
    return q.withColumn("oneway_share", r6(F.try_divide(F.col("oneway").cast("double"), F.col("oneway") + F.col("equal"))))


@query(EVENTS + ", w AS (SELECT * FROM ev WHERE side = 'peer' AND kind = 'weaken') SELECT x.execution_id, count(*) AS paths, count(DISTINCT CASE WHEN x.early_fact <> x.late_fact AND x.late_fact <> y.late_fact AND x.early_fact <> y.late_fact THEN x.early_fact || x.late_fact || y.late_fact END) AS fact_paths FROM w x JOIN w y ON x.execution_id = y.execution_id AND x.late = y.early GROUP BY 1")
def ec_two_step(t: Trace) -> DataFrame:
    """Weakened twice, the mention in the middle being the same."""
    w = t.restatements.where("side = 'peer' and kind = 'weaken'")
    x = w.select("execution_id", F.col("late").alias("middle"), F.col("early_fact").alias("f1"), F.col("late_fact").alias("f2"))
    y = w.select("execution_id", F.col("early").alias("middle"), F.col("late_fact").alias("f3"))
    three = F.when(F.expr("f1 <> f2 and f2 <> f3 and f1 <> f3"), F.concat("f1", "f2", "f3"))
    return x.join(y, ["execution_id", "middle"]).groupBy("execution_id").agg(F.count("*").alias("paths"), F.countDistinct(three).alias("fact_paths"))


CELLS = {"x00": ("chain", "none"), "x01": ("chain", "full"), "x10": ("broadcast", "none"), "x11": ("broadcast", "full")}
EFFECTS = {"topology_without_memory": "x10 - x00", "topology_with_memory": "x11 - x01", "memory_on_chain": "x01 - x00", "memory_on_broadcast": "x11 - x10", "interaction": "x11 - x10 - x01 + x00"}


@query(
    RATES + ", lg AS (SELECT case_id, topology, memory, u.metric, u.v FROM rt JOIN db USING (execution_id), LATERAL (SELECT unnest(['weaken_rate', 'strengthen_rate', 'related_rate', 'conservative_rate']) AS metric, unnest([weaken_rate, strengthen_rate, related_rate, conservative_rate]) AS v) u), "
    + "pv AS (SELECT case_id, metric, " + ", ".join(f"avg(CASE WHEN topology = '{a}' AND memory = '{b}' THEN v END) AS {k}" for k, (a, b) in CELLS.items()) + " FROM lg GROUP BY 1, 2) "
    + " UNION ALL ".join(f"SELECT metric, '{k}' AS effect, count({e}) AS cases, round(avg({e}), 6) AS mean FROM pv GROUP BY 1" for k, e in EFFECTS.items())
)
def ec_effects(t: Trace) -> DataFrame:
    """Paired differences between topologies and memories over the cases, and their interaction, for each rate."""
    d = _rates(t).join(t.debates, "execution_id")
    d = d.select("case_id", "topology", "memory", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in _RATES))).alias("e")).select("case_id", "topology", "memory", "e.*")
    p = d.groupBy("case_id", "metric").agg(*(F.avg(F.when((F.col("topology") == a) & (F.col("memory") == b), F.col("v"))).alias(k) for k, (a, b) in CELLS.items()))
    p = p.select("metric", F.explode(F.array(*(F.struct(F.lit(k).alias("effect"), F.expr(e).alias("d")) for k, e in EFFECTS.items()))).alias("e")).select("metric", "e.*")
    return p.groupBy("metric", "effect").agg(F.count("d").alias("cases"), r6(F.avg("d")).alias("mean"))


# --- occurrences: a fact in a turn ------------------------------------------------------------------

ORIGIN = EVENTS + """,
inp AS (SELECT execution_id, listener AS agent_id, round, late_fact AS fact_id, bool_or(kind = 'equivalent') AS equal FROM ev WHERE side <> 'invisible' GROUP BY 1, 2, 3, 4),
oc AS (SELECT us.execution_id, us.agent_id, us.round, us.fact_id, CASE WHEN sf.fact_id IS NOT NULL THEN 'source' WHEN use = 'held' THEN 'self' WHEN use = 'adopted' THEN 'peer' WHEN equal THEN 'unmerged_equivalent' WHEN inp.fact_id IS NOT NULL THEN 'transformed' ELSE 'unmatched' END AS origin
  FROM us LEFT JOIN sf ON sf.execution_id = us.execution_id AND sf.fact_id = us.fact_id LEFT JOIN inp ON inp.execution_id = us.execution_id AND inp.agent_id = us.agent_id AND inp.round = us.round AND inp.fact_id = us.fact_id)"""
_ORIGINS = ("source", "self", "peer", "unmerged_equivalent", "transformed", "unmatched")


def _origins(t: Trace) -> DataFrame:
    """Each fact of each turn with the first of: a source, the agent's own turns, delivered turns, a judged restatement of one."""
    inputs = t.restatements.where("side <> 'invisible'").groupBy("execution_id", F.col("listener").alias("agent_id"), "round", F.col("late_fact").alias("fact_id")).agg(F.bool_or(F.col("kind") == "equivalent").alias("equal"))
    u = t.uses.join(t.source_facts.withColumn("src", F.lit(True)), ["execution_id", "fact_id"], "left").join(inputs, ["execution_id", "agent_id", "round", "fact_id"], "left")
    origin = F.when(F.col("src"), "source").when(F.col("use") == "held", "self").when(F.col("use") == "adopted", "peer").when(F.col("equal"), "unmerged_equivalent").when(F.col("equal").isNotNull(), "transformed").otherwise("unmatched")
    return u.select("execution_id", "agent_id", "round", "fact_id", origin.alias("origin"))


@query(ORIGIN + " SELECT execution_id, agent_id, round, count(*) AS n, " + ", ".join(f"count(CASE WHEN origin = '{o}' THEN 1 END) AS {o}" for o in _ORIGINS) + " FROM oc GROUP BY 1, 2, 3")
def ig_origin_mix(t: Trace) -> DataFrame:
    """Facts of each turn by origin, those without an equal source told apart by judged restatements."""
    return _origins(t).groupBy("execution_id", "agent_id", "round").agg(F.count("*").alias("n"), *(_count(F.col("origin") == o).alias(o) for o in _ORIGINS))


@query(
    ORIGIN + """, ed AS (
SELECT oc.execution_id, 'origin' AS type, count(DISTINCT doc_id || '|' || oc.agent_id || '|' || oc.round || '|' || oc.fact_id) AS edges FROM oc JOIN (SELECT DISTINCT execution_id, fact_id, doc_id FROM m WHERE channel = 'source' AND doc_id IS NOT NULL) s USING (execution_id, fact_id) GROUP BY 1
UNION ALL SELECT execution_id, 'unmatched_origin', count(*) FROM oc WHERE origin = 'unmatched' GROUP BY 1
UNION ALL SELECT x.execution_id, 'persistence', count(*) FROM said x JOIN said y ON x.execution_id = y.execution_id AND x.agent_id = y.agent_id AND x.fact_id = y.fact_id AND x.round < y.round GROUP BY 1
UNION ALL SELECT rc.execution_id, 'transmission', count(*) FROM rc JOIN said ON said.execution_id = rc.execution_id AND said.agent_id = rc.listener AND said.round = rc.round AND said.fact_id = rc.fact_id WHERE rc.speaker <> rc.listener GROUP BY 1
UNION ALL SELECT execution_id, side || '_' || kind, count(*) FROM (SELECT DISTINCT execution_id, speaker, sent_round, early_fact, listener, round, late_fact, side, kind FROM ev WHERE side <> 'invisible' AND kind <> 'equivalent') GROUP BY 1, 2)
SELECT * FROM ed"""
)
def ig_occurrence_edges(t: Trace) -> DataFrame:
    """Edges between occurrences of facts by type."""
    o = _origins(t)
    docs = t.mentions.where("channel = 'source' and doc_id is not null").select("execution_id", "fact_id", "doc_id").distinct()
    n = F.count("*").alias("edges")
    typed = lambda d, name: d.groupBy("execution_id").agg(n).select("execution_id", F.lit(name).alias("type"), "edges")
    later = t.said.withColumnRenamed("round", "later")
    kept = t.said.join(later, ["execution_id", "agent_id", "fact_id"]).where("round < later")
    sent = t.received.where("speaker <> listener").join(t.said.withColumnRenamed("agent_id", "listener"), ["execution_id", "listener", "round", "fact_id"])
    e = t.restatements.where("side <> 'invisible' and kind <> 'equivalent'").select("execution_id", "speaker", "sent_round", "early_fact", "listener", "round", "late_fact", F.concat_ws("_", "side", "kind").alias("type")).distinct()
    parts = [typed(o.join(docs, ["execution_id", "fact_id"]), "origin"), typed(o.where("origin = 'unmatched'"), "unmatched_origin"), typed(kept, "persistence"), typed(sent, "transmission")]
    out = e.groupBy("execution_id", "type").agg(n)
    for p in parts:
        out = out.unionByName(p)
    return out


@query(EVENTS + ", p AS (SELECT * FROM ev WHERE side = 'peer') SELECT x.execution_id, x.kind || '>' || y.kind AS path, count(DISTINCT x.early_fact || x.late_fact || y.late_fact || x.speaker || '|' || x.listener || '|' || x.round || '|' || y.listener) AS paths FROM p x JOIN p y ON x.execution_id = y.execution_id AND x.late = y.early WHERE x.sent_round = 1 AND y.round = 3 GROUP BY 1, 2")
def ig_typed_paths(t: Trace) -> DataFrame:
    """Two steps from the first round to the third through one judged mention, by the types of the steps."""
    p = t.restatements.where("side = 'peer'")
    x = p.where("sent_round = 1").select("execution_id", F.col("late").alias("middle"), F.col("kind").alias("k1"), F.col("early_fact").alias("f1"), F.col("late_fact").alias("f2"), F.col("speaker").alias("g1"), F.col("listener").alias("g2"), F.col("round").alias("r2"))
    y = p.where("round = 3").select("execution_id", F.col("early").alias("middle"), F.col("kind").alias("k2"), F.col("late_fact").alias("f3"), F.col("listener").alias("g3"))
    return x.join(y, ["execution_id", "middle"]).groupBy("execution_id", F.concat("k1", F.lit(">"), "k2").alias("path")).agg(F.countDistinct("f1", "f2", "f3", "g1", "g2", "r2", "g3").alias("paths"))


# --- interaction, screened by what the receiver had said before ------------------------------------

SCREEN = EVENTS + """,
ed2 AS (SELECT ev.*, row_number() OVER () AS k FROM ev WHERE side = 'peer' AND round = sent_round + 1),
eq2 AS (SELECT DISTINCT a AS mid, b AS other FROM jd WHERE label = 'EQUIVALENT' UNION SELECT DISTINCT b, a FROM jd WHERE label = 'EQUIVALENT'),
pe AS (SELECT k FROM ed2 JOIN eq2 ON mid IN (early, late) JOIN m ON m.mention_id = other AND m.execution_id = ed2.execution_id AND m.agent_id = ed2.listener AND m.channel = 'output' AND m.round < ed2.round AND m.round > 0),
pf AS (SELECT k FROM ed2 JOIN fs ON fs.execution_id = ed2.execution_id AND fs.agent_id = ed2.listener AND fs.fact_id IN (early_fact, late_fact) AND first_round < ed2.round),
sc AS (SELECT *, k IN (SELECT k FROM pe) OR k IN (SELECT k FROM pf) AS prior FROM ed2)"""


def _screened(t: Trace) -> DataFrame:
    """Restatements of a delivered turn of the round before; prior where the receiver had said either fact, or a mention judged equal to either, in an earlier round."""
    e = t.restatements.where("side = 'peer' and round = sent_round + 1")
    said = t.first_said.select("execution_id", F.col("agent_id").alias("listener"), F.col("fact_id").alias("fact"), F.col("first_round").alias("since"))
    q = t.judged.where("label = 'EQUIVALENT'").select("a", "b").distinct()
    q = q.unionByName(q.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    own = t.mentions.where("channel = 'output' and round > 0 and agent_id is not null").select(F.col("mention_id").alias("b"), "execution_id", F.col("agent_id").alias("listener"), F.col("round").alias("since"))
    equal = q.join(own, "b").groupBy("execution_id", "listener", F.col("a").alias("mention")).agg(F.min("since").alias("since"))
    no, key = F.lit(False), ["execution_id", "listener"]
    prior = no
    for name, side, column in (("p1", said, "early_fact"), ("p2", said, "late_fact"), ("p3", equal, "early"), ("p4", equal, "late")):
        e = e.join(side.withColumnRenamed("fact", column).withColumnRenamed("mention", column).withColumnRenamed("since", name), [*key, column], "left")
        prior = prior | F.coalesce(F.col(name) < F.col("round"), no)
    return e.withColumn("prior", prior).drop("p1", "p2", "p3", "p4")


@query(SCREEN + " SELECT execution_id, speaker, sent_round, listener, kind, count(DISTINCT late_fact) AS targets, count(DISTINCT CASE WHEN NOT prior THEN late_fact END) AS screened FROM sc GROUP BY 1, 2, 3, 4, 5")
def ii_prior_screen(t: Trace) -> DataFrame:
    g = _screened(t).groupBy("execution_id", "speaker", "sent_round", "listener", "kind")
    return g.agg(F.countDistinct("late_fact").alias("targets"), F.countDistinct(F.when(~F.col("prior"), F.col("late_fact"))).alias("screened"))


PAIRS = SCREEN + """,
tn AS (SELECT execution_id, agent_id AS listener, round, count(*) AS n FROM said GROUP BY 1, 2, 3),
hit AS (SELECT execution_id, speaker, sent_round, listener, count(DISTINCT late_fact) AS raw, count(DISTINCT CASE WHEN NOT prior THEN late_fact END) AS screened FROM sc GROUP BY 1, 2, 3, 4),
pr AS (SELECT d.execution_id, d.speaker, d.sent_round, d.listener, n, coalesce(raw, 0) * 1.0 / n AS raw_rate, coalesce(screened, 0) * 1.0 / n AS screened_rate FROM dl d JOIN tn ON tn.execution_id = d.execution_id AND tn.listener = d.listener AND tn.round = d.round
  LEFT JOIN hit ON hit.execution_id = d.execution_id AND hit.speaker = d.speaker AND hit.sent_round = d.sent_round AND hit.listener = d.listener WHERE d.round = d.sent_round + 1 AND d.speaker <> d.listener)"""


def _pair_rates(t: Trace) -> DataFrame:
    """For each delivered turn of the round before: shares of the receiver's facts that restate it, all and screened."""
    key = ["execution_id", "speaker", "sent_round", "listener"]
    n = t.said.groupBy("execution_id", F.col("agent_id").alias("listener"), "round").agg(F.count("*").alias("n"))
    hit = _screened(t).groupBy(*key).agg(F.countDistinct("late_fact").alias("raw"), F.countDistinct(F.when(~F.col("prior"), F.col("late_fact"))).alias("screened"))
    d = t.deliveries.where("round = sent_round + 1 and speaker <> listener").join(n, ["execution_id", "listener", "round"]).join(hit, key, "left")
    return d.select(*key, "n", (F.coalesce("raw", F.lit(0)) / F.col("n")).alias("raw_rate"), (F.coalesce("screened", F.lit(0)) / F.col("n")).alias("screened_rate"))


@query(PAIRS + " SELECT topology, sent_round, speaker, listener, count(*) AS n, round(avg(raw_rate), 6) AS raw, round(avg(screened_rate), 6) AS screened FROM pr JOIN db USING (execution_id) GROUP BY 1, 2, 3, 4")
def ii_matrix(t: Trace) -> DataFrame:
    g = _pair_rates(t).join(t.debates, "execution_id").groupBy("topology", "sent_round", "speaker", "listener")
    return g.agg(F.count("*").alias("n"), r6(F.avg("raw_rate")).alias("raw"), r6(F.avg("screened_rate")).alias("screened"))


@query(", d AS (SELECT ea AS execution_id, CASE WHEN label = 'A_ENTAILS_B' THEN a ELSE b END AS strong, CASE WHEN label = 'A_ENTAILS_B' THEN b ELSE a END AS weak, CASE WHEN label = 'A_ENTAILS_B' THEN coalesce(ra, 0) ELSE coalesce(rb, 0) END AS strong_round, CASE WHEN label = 'A_ENTAILS_B' THEN coalesce(rb, 0) ELSE coalesce(ra, 0) END AS weak_round FROM lf WHERE ea = eb AND label IN ('A_ENTAILS_B', 'B_ENTAILS_A')) SELECT DISTINCT * FROM d WHERE strong_round < weak_round")
def degradation_edges(t: Trace) -> DataFrame:
    """A specific statement and a later, vaguer one that it entails; sources count as round 0."""
    ab = F.col("label") == "A_ENTAILS_B"
    pick = lambda x, y: F.when(ab, F.coalesce(x, F.lit(0)) if x.startswith("r") else F.col(x)).otherwise(F.coalesce(y, F.lit(0)) if y.startswith("r") else F.col(y))
    d = t.lifted.where("ea = eb and label in ('A_ENTAILS_B', 'B_ENTAILS_A')").select(F.col("ea").alias("execution_id"), pick("a", "b").alias("strong"), pick("b", "a").alias("weak"), pick("ra", "rb").alias("strong_round"), pick("rb", "ra").alias("weak_round"))
    return d.where("strong_round < weak_round").distinct()


@query(", s AS (SELECT execution_id, agent_id, round, count(*) AS n FROM m WHERE agent_id IS NOT NULL AND round IS NOT NULL GROUP BY 1, 2, 3) SELECT x.execution_id, x.agent_id AS sender, y.agent_id AS receiver, CAST(sum(x.n * y.n) AS BIGINT) AS opportunities FROM s x JOIN s y ON x.execution_id = y.execution_id AND x.agent_id <> y.agent_id AND y.round > x.round GROUP BY 1, 2, 3")
def j_full_cross_opportunity(t: Trace) -> DataFrame:
    """Pairs of an earlier and a later proposition of two agents, counted by turns and never listed."""
    return _opportunities(t).groupBy("execution_id", "sender", "receiver").agg(F.sum("pairs").alias("opportunities"))


def _opportunities(t: Trace) -> DataFrame:
    s = t.mentions.where("agent_id is not null and round is not null").groupBy("execution_id", "agent_id", "round").agg(F.count("*").alias("n"))
    x = s.select("execution_id", F.col("agent_id").alias("sender"), F.col("round").alias("r1"), F.col("n").alias("n1"))
    y = s.select("execution_id", F.col("agent_id").alias("receiver"), F.col("round").alias("r2"), F.col("n").alias("n2"))
    return x.join(y, "execution_id").where("sender <> receiver and r2 > r1").withColumn("pairs", F.col("n1") * F.col("n2"))


SEATS = """, am AS (SELECT execution_id, agent_id, round, mention_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, min(round) OVER (PARTITION BY execution_id) AS r0 FROM m WHERE agent_id IS NOT NULL AND round IS NOT NULL),
ps AS (SELECT execution_id, agent_id, count(*) AS props, avg(CAST(round = r0 AS DOUBLE)) AS first_share, avg(words) AS mean_words FROM am GROUP BY 1, 2),
s0 AS (SELECT execution_id, agent_id, round, count(*) AS n FROM am GROUP BY 1, 2, 3),
op AS (SELECT x.execution_id, x.agent_id AS u, y.agent_id AS v, sum(x.n * y.n) AS n FROM s0 x JOIN s0 y ON x.execution_id = y.execution_id AND x.agent_id <> y.agent_id AND y.round > x.round GROUP BY 1, 2, 3),
jr AS (SELECT DISTINCT jd.a, jd.b, label, x.execution_id, CASE WHEN x.round < y.round THEN x.agent_id ELSE y.agent_id END AS u, CASE WHEN x.round < y.round THEN y.agent_id ELSE x.agent_id END AS v FROM jd JOIN am x ON jd.a = x.mention_id JOIN am y ON jd.b = y.mention_id AND x.execution_id = y.execution_id WHERE label <> 'UNRELATED' AND x.round <> y.round),
od AS (SELECT execution_id, u AS agent_id, count(CASE WHEN u <> v THEN 1 END) AS d_out, count(DISTINCT CASE WHEN u <> v THEN v END) AS spread, count(CASE WHEN u = v THEN 1 END) AS rep FROM jr GROUP BY 1, 2),
idg AS (SELECT execution_id, v AS agent_id, count(*) AS d_in FROM jr WHERE u <> v GROUP BY 1, 2),
oo AS (SELECT execution_id, u AS agent_id, sum(n) AS n_out FROM op GROUP BY 1, 2), oi AS (SELECT execution_id, v AS agent_id, sum(n) AS n_in FROM op GROUP BY 1, 2)
SELECT execution_id, agent_id, props, round(first_share, 6) AS first_share, round(mean_words, 6) AS mean_words, round(coalesce(d_out, 0) * 1000.0 / greatest(coalesce(n_out, 0), 1), 6) AS out_degree, round(coalesce(d_in, 0) * 1000.0 / greatest(coalesce(n_in, 0), 1), 6) AS in_degree, coalesce(spread, 0) AS spread, round(coalesce(rep, 0) * 1.0 / props, 6) AS self_repeat
FROM ps LEFT JOIN od USING (execution_id, agent_id) LEFT JOIN idg USING (execution_id, agent_id) LEFT JOIN oo USING (execution_id, agent_id) LEFT JOIN oi USING (execution_id, agent_id)"""


@query(SEATS)
def seat_profile(t: Trace) -> DataFrame:
    """Each seat of a run: propositions, share in the first round, words, judged links out and in per thousand opportunities, reach, self-repetition."""
    key = ["execution_id", "agent_id"]
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    m = t.worded("text").where("agent_id is not null and round is not null").select(*key, "round", "mention_id", words.alias("words"))
    first = m.groupBy("execution_id").agg(F.min("round").alias("r0"))
    p = m.join(first, "execution_id").groupBy(*key).agg(F.count("*").alias("props"), F.avg((F.col("round") == F.col("r0")).cast("double")).alias("first_share"), F.avg("words").alias("mean_words"))
    slot = lambda x: t.mentions.where("agent_id is not null and round is not null").select(F.col("mention_id").alias(x), F.col("execution_id").alias(f"e{x}"), F.col("agent_id").alias(f"g{x}"), F.col("round").alias(f"r{x}"))
    j = t.judged.where("label <> 'UNRELATED'").select("a", "b", "label").distinct().join(slot("a"), "a").join(slot("b"), "b").where("ea = eb and ra <> rb")
    first = F.col("ra") < F.col("rb")
    j = j.select(F.col("ea").alias("execution_id"), F.when(first, F.col("ga")).otherwise(F.col("gb")).alias("u"), F.when(first, F.col("gb")).otherwise(F.col("ga")).alias("v"))
    out = j.groupBy("execution_id", F.col("u").alias("agent_id")).agg(_count("u <> v").alias("d_out"), F.countDistinct(F.when(F.expr("u <> v"), F.col("v"))).alias("spread"), _count("u = v").alias("rep"))
    into = j.where("u <> v").groupBy("execution_id", F.col("v").alias("agent_id")).agg(F.count("*").alias("d_in"))
    o = _opportunities(t)
    n_out, n_in = (o.groupBy("execution_id", F.col(c).alias("agent_id")).agg(F.sum("pairs").alias(n)) for c, n in (("sender", "n_out"), ("receiver", "n_in")))
    for d in (out, into, n_out, n_in):
        p = p.join(d, key, "left")
    p = p.na.fill(0, ["d_out", "spread", "rep", "d_in", "n_out", "n_in"])
    degree = lambda d, n: r6(F.col(d) * 1000.0 / F.greatest(F.col(n), F.lit(1)))
    return p.select(*key, "props", r6("first_share").alias("first_share"), r6("mean_words").alias("mean_words"), degree("d_out", "n_out").alias("out_degree"), degree("d_in", "n_in").alias("in_degree"), "spread", r6(F.col("rep") / F.col("props")).alias("self_repeat"))


@query(", d AS (SELECT DISTINCT ea AS execution_id, CASE WHEN label = 'A_ENTAILS_B' THEN ga ELSE gb END AS strong, CASE WHEN label = 'A_ENTAILS_B' THEN gb ELSE ga END AS weak, CASE WHEN label = 'A_ENTAILS_B' THEN rb - ra ELSE ra - rb END AS span, a, b FROM lf WHERE ea = eb AND ga IS NOT NULL AND gb IS NOT NULL AND ra > 0 AND rb > 0 AND label IN ('A_ENTAILS_B', 'B_ENTAILS_A')), e AS (SELECT * FROM d WHERE span > 0), x AS (SELECT execution_id, strong AS agent_id, 1 AS o, 0 AS i, CAST(strong <> weak AS INT) AS c, span FROM e UNION ALL SELECT execution_id, weak, 0, 1, 0, NULL FROM e) SELECT execution_id, agent_id, CAST(sum(o) AS BIGINT) AS weakened_by_others_or_self, CAST(sum(i) AS BIGINT) AS weakens, CAST(sum(c) AS BIGINT) AS by_peers, round(avg(span), 6) AS span FROM x GROUP BY 1, 2")
def entail_degrees(t: Trace) -> DataFrame:
    """For each agent: its statements weakened later, those it weakened, how many by peers, and over how many rounds."""
    ab = F.col("label") == "A_ENTAILS_B"
    pick = lambda x, y: F.when(ab, F.col(x)).otherwise(F.col(y))
    d = t.lifted.where("ea = eb and ga is not null and gb is not null and ra > 0 and rb > 0 and label in ('A_ENTAILS_B', 'B_ENTAILS_A')")
    e = d.select(F.col("ea").alias("execution_id"), pick("ga", "gb").alias("strong"), pick("gb", "ga").alias("weak"), (pick("rb", "ra") - pick("ra", "rb")).alias("span"), "a", "b").distinct().where("span > 0")
    sides = F.array(F.struct(F.col("strong").alias("agent_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col("strong") != F.col("weak")).cast("int").alias("c"), F.col("span").alias("s")), F.struct(F.col("weak").alias("agent_id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("c"), F.lit(None).cast("int").alias("s")))
    x = e.select("execution_id", F.explode(sides).alias("x")).select("execution_id", "x.*")
    return x.groupBy("execution_id", "agent_id").agg(F.sum("o").alias("weakened_by_others_or_self"), F.sum("i").alias("weakens"), F.sum("c").alias("by_peers"), r6(F.avg("s")).alias("span"))
