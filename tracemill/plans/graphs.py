"""Graph queries over facts and over agents and rounds, and the census of judged relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tracemill.operators.base import Trace
from tracemill.operators.centrality import betweenness
from tracemill.operators.components import connected
from tracemill.plans.lifecycle import FLOW, _roled, r6
from tracemill.plans.registry import query

ENTAIL = ", en AS (SELECT CASE WHEN label = 'A_ENTAILS_B' THEN fa ELSE fb END AS u, CASE WHEN label = 'A_ENTAILS_B' THEN fb ELSE fa END AS v FROM lf WHERE label IN ('A_ENTAILS_B', 'B_ENTAILS_A'))"


def _entail(t: Trace) -> DataFrame:
    ab = F.col("label") == "A_ENTAILS_B"
    return t.lifted.where("label in ('A_ENTAILS_B', 'B_ENTAILS_A')").select(F.when(ab, F.col("fa")).otherwise(F.col("fb")).alias("u"), F.when(ab, F.col("fb")).otherwise(F.col("fa")).alias("v"))


@query(ENTAIL + " SELECT u, v, 'entails' AS kind, count(*) AS weight FROM en GROUP BY 1, 2 UNION ALL SELECT x, y, 'contradicts', count(*) FROM (SELECT fa AS x, fb AS y FROM lf WHERE label = 'CONTRADICTS' UNION ALL SELECT fb, fa FROM lf WHERE label = 'CONTRADICTS') GROUP BY 1, 2")
def g_fact_graph(t: Trace) -> DataFrame:
    c = t.lifted.where("label = 'CONTRADICTS'")
    both = c.select(F.col("fa").alias("u"), F.col("fb").alias("v")).unionByName(c.select(F.col("fb").alias("u"), F.col("fa").alias("v")))
    e = _entail(t).withColumn("kind", F.lit("entails")).unionByName(both.withColumn("kind", F.lit("contradicts")))
    return e.groupBy("u", "v", "kind").agg(F.count("*").alias("weight"))


@query("SELECT execution_id, a, rk AS from_rk, b, rk + 1 AS to_rk, count(*) AS weight, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS kind FROM tx GROUP BY 1, 2, 3, 4, 5")
def g_spacetime(t: Trace) -> DataFrame:
    kind = F.when(F.countDistinct("kind") > 1, "mixed").otherwise(F.min("kind"))
    return t.transmissions.groupBy("execution_id", "a", F.col("rk").alias("from_rk"), "b", (F.col("rk") + 1).alias("to_rk")).agg(F.count("*").alias("weight"), kind.alias("kind"))


@query("SELECT ag.execution_id, ag.agent_id, rd.round, count(fact_id) AS n_said FROM ag JOIN rd USING (execution_id) LEFT JOIN said ON said.execution_id = ag.execution_id AND said.agent_id = ag.agent_id AND said.round = rd.round GROUP BY 1, 2, 3")
def spacetime_nodes(t: Trace) -> DataFrame:
    return t.agents.join(t.rounds, "execution_id").join(t.said, ["execution_id", "agent_id", "round"], "left").groupBy("execution_id", "agent_id", "round").agg(F.count("fact_id").alias("n_said"))


@query(FLOW + " SELECT execution_id, role_from, role_to, count(*) AS weight FROM fl GROUP BY 1, 2, 3")
def g_role_graph(t: Trace) -> DataFrame:
    return _roled(t).groupBy("execution_id", "role_from", "role_to").agg(F.count("*").alias("weight"))


@query(", n AS (SELECT execution_id, count(*) AS nodes FROM ag JOIN rd USING (execution_id) GROUP BY 1), e AS (SELECT execution_id, count(*) AS edges FROM (SELECT DISTINCT execution_id, a, b, rk FROM tx) GROUP BY 1) SELECT execution_id, nodes, coalesce(edges, 0) AS edges, round(CASE WHEN nodes > 1 THEN coalesce(edges, 0) * 1.0 / (nodes * (nodes - 1)) ELSE 0 END, 6) AS density FROM n LEFT JOIN e USING (execution_id)")
def g_density(t: Trace) -> DataFrame:
    n = t.agents.join(t.rounds, "execution_id").groupBy("execution_id").agg(F.count("*").alias("nodes"))
    e = t.transmissions.select("execution_id", "a", "b", "rk").distinct().groupBy("execution_id").agg(F.count("*").alias("edges"))
    j = n.join(e, "execution_id", "left").na.fill(0, ["edges"])
    return j.withColumn("density", r6(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)))



def reach(edges: str, key: str) -> str:
    """SQL that gives every vertex of ``edges`` (u, v) the smallest vertex it is joined to: only smaller roots are passed on."""
    return f", ed AS ({edges}), ee AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed), reach AS (SELECT DISTINCT u AS id, u AS root FROM ee UNION SELECT ee.v, root FROM reach JOIN ee ON ee.u = reach.id WHERE root < ee.v) SELECT id AS {key}, min(root) AS root FROM reach GROUP BY 1"


# Shortest paths are listed step by step: the recursion carries each vertex's distance and number of paths from a source.
CRUX = ENTAIL + """, es AS (SELECT DISTINCT u, v FROM en), vs AS (SELECT u AS x FROM es UNION SELECT v FROM es),
ds AS (SELECT u AS s, v, 1 AS d FROM es WHERE u <> v UNION SELECT ds.s, es.v, ds.d + 1 FROM ds JOIN es ON es.u = ds.v WHERE ds.d < 60 AND es.v <> ds.s),
mn AS (SELECT s, v, min(d) AS d FROM ds GROUP BY 1, 2), pc AS (SELECT x AS s, x AS v, 0 AS d, 1.0::DOUBLE AS n FROM vs UNION ALL SELECT s, v, d, sum(n) FROM (SELECT pc.s, es.v, pc.d + 1 AS d, pc.n FROM pc JOIN es ON es.u = pc.v JOIN mn ON mn.s = pc.s AND mn.v = es.v AND mn.d = pc.d + 1) GROUP BY 1, 2, 3),
bt AS (SELECT a.v AS id, sum(a.n * b.n / c.n) AS score FROM pc a JOIN pc b ON b.s = a.v JOIN pc c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY 1)
SELECT id, round(score / ((SELECT count(*) FROM vs) - 1) / ((SELECT count(*) FROM vs) - 2), 12) AS score FROM bt WHERE score > 0"""


@query(CRUX, recursive=True)
def g_crux(t: Trace) -> DataFrame:
    """Facts by betweenness in the entailment graph, exact, over each weakly connected part."""
    return betweenness(t, _entail(t).distinct())


@query(reach("SELECT fa AS u, fb AS v FROM lf WHERE label IN ('A_ENTAILS_B', 'B_ENTAILS_A', 'CONTRADICTS')", "fact_id"), recursive=True)
def g_components(t: Trace) -> DataFrame:
    """(fact_id, root) of the facts that entailment or contradiction joins, whatever the direction."""
    e = g_fact_graph(t).select("u", "v")
    return connected(e).select(F.col("id").alias("fact_id"), "root")


@query(reach("SELECT a AS u, b AS v FROM jd WHERE label = 'EQUIVALENT' AND confidence >= 0.85", "mention_id"), recursive=True)
def cluster(t: Trace) -> DataFrame:
    """(mention_id, root): mentions joined by judgements of equivalence with a confidence of 0.85 or more."""
    e = t.judged.where("label = 'EQUIVALENT' and confidence >= 0.85").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return connected(e).select(F.col("id").alias("mention_id"), "root")


@query(reach("SELECT a AS u, b AS v FROM jd WHERE label = 'EQUIVALENT' AND confidence >= 0.95", "mention_id"), recursive=True)
def recluster(t: Trace) -> DataFrame:
    """The same cut at 0.95, from the stored judgements."""
    e = t.judged.where("label = 'EQUIVALENT' and confidence >= 0.95").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return connected(e).select(F.col("id").alias("mention_id"), "root")


@query(", nb AS (SELECT execution_id, agent_id, lead(agent_id) OVER (PARTITION BY execution_id ORDER BY agent_id) AS nxt, first_value(agent_id) OVER (PARTITION BY execution_id ORDER BY agent_id) AS hub FROM rl) SELECT db.execution_id, x.agent_id AS a, y.agent_id AS b FROM db JOIN nb x USING (execution_id) JOIN nb y USING (execution_id) WHERE x.agent_id <> y.agent_id AND (topology = 'broadcast' OR (topology = 'chain' AND x.nxt = y.agent_id) OR (topology = 'ring' AND (x.nxt = y.agent_id OR (x.nxt IS NULL AND y.agent_id = y.hub))) OR (topology = 'star' AND (x.agent_id = x.hub OR y.agent_id = y.hub)))")
def g_neighbours(t: Trace) -> DataFrame:
    """Who hears whom (a is heard by b): broadcast all; chain the next; ring the next, around; star through the first agent."""
    w = W.partitionBy("execution_id").orderBy("agent_id")
    n = t.roles.select("execution_id", "agent_id", F.lead("agent_id").over(w).alias("nxt"), F.first("agent_id").over(w).alias("hub"))
    x, y = (n.select("execution_id", *(F.col(c).alias(f"{k}_{c}") for c in ("agent_id", "nxt", "hub"))) for k in "xy")
    ok = "topology = 'broadcast' or (topology = 'chain' and x_nxt = y_agent_id) or (topology = 'ring' and (x_nxt = y_agent_id or (x_nxt is null and y_agent_id = y_hub))) or (topology = 'star' and (x_agent_id = x_hub or y_agent_id = y_hub))"
    return t.debates.join(x, "execution_id").join(y, "execution_id").where(f"x_agent_id <> y_agent_id and ({ok})").select("execution_id", F.col("x_agent_id").alias("a"), F.col("y_agent_id").alias("b"))


# --- census of relations --------------------------------------------------------------------------

TEMPORAL = """, te AS (SELECT *, CASE WHEN ca = 'source' OR cb = 'source' THEN 'source_involved' WHEN ea IS DISTINCT FROM eb THEN 'other_run' WHEN ra = rb THEN 'parallel' ELSE (CASE WHEN ga = gb THEN 'self_' ELSE 'peer_' END) || CASE WHEN label = 'EQUIVALENT' THEN 'equivalent' WHEN label IN ('UNRELATED', 'CONTRADICTS') THEN lower(label) WHEN (label = 'A_ENTAILS_B') = (ra < rb) THEN 'weaken' ELSE 'strengthen' END END AS category FROM lf WHERE ra IS NOT NULL AND rb IS NOT NULL AND ga IS NOT NULL AND gb IS NOT NULL OR ca = 'source' OR cb = 'source')"""


def _temporal(t: Trace) -> DataFrame:
    known = F.col("ra").isNotNull() & F.col("rb").isNotNull() & F.col("ga").isNotNull() & F.col("gb").isNotNull()
    source = (F.col("ca") == "source") | (F.col("cb") == "source")
    later = F.when(F.col("label") == "EQUIVALENT", "equivalent").when(F.col("label").isin("UNRELATED", "CONTRADICTS"), F.lower("label")).when((F.col("label") == "A_ENTAILS_B") == (F.col("ra") < F.col("rb")), "weaken").otherwise("strengthen")
    kind = F.when(source, "source_involved").when(~F.col("ea").eqNullSafe(F.col("eb")), "other_run").when(F.col("ra") == F.col("rb"), "parallel").otherwise(F.concat(F.when(F.col("ga") == F.col("gb"), "self_").otherwise("peer_"), later))
    return t.lifted.where(known | source).withColumn("category", kind)


@query(TEMPORAL + " SELECT category, count(*) AS edges FROM te GROUP BY 1")
def ec_temporal(t: Trace) -> DataFrame:
    return _temporal(t).groupBy("category").agg(F.count("*").alias("edges"))


@query(TEMPORAL + " SELECT category, count(DISTINCT least(fa, fb) || '|' || greatest(fa, fb)) AS fact_pairs, count(DISTINCT CASE WHEN ra <= rb THEN fb ELSE fa END) AS targets FROM te GROUP BY 1")
def ec_distinct_sets(t: Trace) -> DataFrame:
    pair = F.concat(F.least("fa", "fb"), F.lit("|"), F.greatest("fa", "fb"))
    return _temporal(t).groupBy("category").agg(F.countDistinct(pair).alias("fact_pairs"), F.countDistinct(F.when(F.col("ra") <= F.col("rb"), F.col("fb")).otherwise(F.col("fa"))).alias("targets"))


@query(TEMPORAL + " SELECT ea AS execution_id, ga AS a, gb AS b, category, count(*) AS edges FROM te WHERE category LIKE 'peer%' GROUP BY 1, 2, 3, 4")
def interaction_graph(t: Trace) -> DataFrame:
    return _temporal(t).where("category like 'peer%'").groupBy(F.col("ea").alias("execution_id"), F.col("ga").alias("a"), F.col("gb").alias("b"), "category").agg(F.count("*").alias("edges"))


STEPS = ENTAIL + ", st AS (SELECT DISTINCT u, v FROM en)"


@query(STEPS + " SELECT x.u AS strong, x.v AS middle, y.v AS weak FROM st x JOIN st y ON x.v = y.u WHERE x.u <> y.v")
def j_two_hop(t: Trace) -> DataFrame:
    s = _entail(t).distinct()
    x, y = s.select(F.col("u").alias("strong"), F.col("v").alias("middle")), s.select(F.col("u").alias("middle"), F.col("v").alias("weak"))
    return x.join(y, "middle").where("strong <> weak").select("strong", "middle", "weak")


@query(STEPS + ", hp AS (SELECT x.u AS p, y.v AS r FROM st x JOIN st y ON x.v = y.u WHERE x.u <> y.v), dr AS (SELECT DISTINCT fa, fb, label FROM lf UNION SELECT fb, fa, CASE label WHEN 'A_ENTAILS_B' THEN 'B_ENTAILS_A' WHEN 'B_ENTAILS_A' THEN 'A_ENTAILS_B' ELSE label END FROM lf) SELECT coalesce(label, 'unscored') AS endpoint, count(*) AS paths FROM hp LEFT JOIN dr ON dr.fa = p AND dr.fb = r GROUP BY 1")
def of_q4_endpoint(t: Trace) -> DataFrame:
    from tracemill.functions.text import flipped

    hops = j_two_hop(t).select(F.col("strong").alias("fa"), F.col("weak").alias("fb"))
    lf = t.lifted.select("fa", "fb", "label")
    direct = lf.unionByName(lf.select(F.col("fb").alias("fa"), F.col("fa").alias("fb"), flipped(F.col("label")).alias("label"))).distinct()
    return hops.join(direct, ["fa", "fb"], "left").groupBy(F.coalesce("label", F.lit("unscored")).alias("endpoint")).agg(F.count("*").alias("paths"))


@query(ENTAIL + " SELECT v AS fact_id, count(DISTINCT u) AS strong_facts FROM en GROUP BY 1 HAVING count(DISTINCT u) >= 2")
def g_meeting_points(t: Trace) -> DataFrame:
    return _entail(t).groupBy(F.col("v").alias("fact_id")).agg(F.countDistinct("u").alias("strong_facts")).where("strong_facts >= 2")


@query(ENTAIL + ", d AS (SELECT x, sum(o) AS out_deg, sum(i) AS in_deg FROM (SELECT u AS x, 1 AS o, 0 AS i FROM (SELECT DISTINCT u, v FROM en) UNION ALL SELECT v, 0, 1 FROM (SELECT DISTINCT u, v FROM en)) GROUP BY 1) SELECT x AS fact_id, CAST(out_deg AS BIGINT) AS out_deg, CAST(in_deg AS BIGINT) AS in_deg, CAST(out_deg - in_deg AS BIGINT) AS balance FROM d")
def network_balance(t: Trace) -> DataFrame:
    e = _entail(t).distinct()
    d = e.select(F.col("u").alias("fact_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("v").alias("fact_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return d.groupBy("fact_id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg")).withColumn("balance", F.col("out_deg") - F.col("in_deg"))


@query("SELECT label, CASE WHEN ga = gb THEN 'self' ELSE 'peer' END AS side, round(avg(abs(rb - ra)), 6) AS span, count(*) AS edges FROM lf WHERE ga IS NOT NULL AND gb IS NOT NULL AND ra IS NOT NULL AND rb IS NOT NULL GROUP BY 1, 2")
def entail_graph_stats(t: Trace) -> DataFrame:
    j = t.lifted.where("ga is not null and gb is not null and ra is not null and rb is not null")
    return j.groupBy("label", F.when(F.col("ga") == F.col("gb"), "self").otherwise("peer").alias("side")).agg(r6(F.avg(F.abs(F.col("rb") - F.col("ra")))).alias("span"), F.count("*").alias("edges"))


@query(", mt AS (SELECT DISTINCT fa AS x FROM lf WHERE label IN ('EQUIVALENT', 'A_ENTAILS_B', 'B_ENTAILS_A') UNION SELECT DISTINCT fb FROM lf WHERE label IN ('EQUIVALENT', 'A_ENTAILS_B', 'B_ENTAILS_A')) SELECT execution_id, agent_id, round(avg(CAST(fact_id IN (SELECT x FROM mt) AS DOUBLE)), 6) AS covered FROM (SELECT DISTINCT execution_id, agent_id, fact_id FROM said) GROUP BY 1, 2")
def ii_overlap(t: Trace) -> DataFrame:
    m = t.lifted.where("label in ('EQUIVALENT', 'A_ENTAILS_B', 'B_ENTAILS_A')").select(F.explode(F.array("fa", "fb")).alias("fact_id")).distinct().withColumn("hit", F.lit(1.0))
    return t.said.select("execution_id", "agent_id", "fact_id").distinct().join(m, "fact_id", "left").groupBy("execution_id", "agent_id").agg(r6(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("covered"))


@query(", e AS (SELECT execution_id, a, b, count(*) AS v FROM tx WHERE kind = 'transmission' GROUP BY 1, 2, 3), p AS (SELECT x.execution_id, 2 * least(x.v, coalesce(y.v, 0)) AS m, x.v + coalesce(y.v, 0) AS s FROM e x LEFT JOIN e y ON x.execution_id = y.execution_id AND x.a = y.b AND x.b = y.a WHERE x.a < x.b OR y.a IS NULL) SELECT execution_id, round(CAST(sum(m) AS DOUBLE) / sum(s), 6) AS reciprocity FROM p GROUP BY 1")
def ii_reciprocity(t: Trace) -> DataFrame:
    e = t.transmissions.where("kind = 'transmission'").groupBy("execution_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count(F.when(F.col("a") < F.col("b"), 1)).alias("f"), F.count(F.when(F.col("a") > F.col("b"), 1)).alias("g"))
    return e.groupBy("execution_id").agg(r6(F.sum(2 * F.least("f", "g")).cast("double") / F.sum(F.col("f") + F.col("g"))).alias("reciprocity"))
