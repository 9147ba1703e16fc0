"""Exposure, coverage, novelty, topics and event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tracemill.functions import text as T
from tracemill.operators.base import Trace
from tracemill.plans.lifecycle import j_first_exposure, r6
from tracemill.plans.registry import SQL, BASE, query

_EX = SQL["j_first_exposure"][len(BASE) :]
EXPOSED = f", ex AS ({_EX}), r2 AS (SELECT DISTINCT fa AS p, fb AS q, label FROM lf UNION SELECT fb, fa, CASE label WHEN 'A_ENTAILS_B' THEN 'B_ENTAILS_A' WHEN 'B_ENTAILS_A' THEN 'A_ENTAILS_B' ELSE label END FROM lf), k0 AS (SELECT DISTINCT ex.execution_id, listener, ex.fact_id, first_round, side, label FROM ex LEFT JOIN said s ON s.execution_id = ex.execution_id AND s.agent_id = listener AND s.round = first_round LEFT JOIN r2 ON r2.p = ex.fact_id AND r2.q = s.fact_id), k1 AS (SELECT execution_id, listener, fact_id, first_round, side, label FROM k0 WHERE label IS NOT NULL), kk AS (SELECT * FROM k1 WHERE label <> 'UNRELATED' OR (execution_id, listener, fact_id) NOT IN (SELECT execution_id, listener, fact_id FROM k1 WHERE label <> 'UNRELATED'))"


def oriented(t: Trace) -> DataFrame:
    """(p, q, label) of facts, each judgement seen from both ends."""
    lf = t.lifted.select(F.col("fa").alias("p"), F.col("fb").alias("q"), "label")
    return lf.unionByName(lf.select(F.col("q").alias("p"), F.col("p").alias("q"), T.flipped(F.col("label")).alias("label"))).distinct()


def _kinds(t: Trace) -> DataFrame:
    """(execution, listener, fact, first_round, side, label): relations of a fact first seen then to what its listener said
    in that round; UNRELATED only where there is no other."""
    s = t.said.select("execution_id", F.col("agent_id").alias("listener"), F.col("round").alias("first_round"), F.col("fact_id").alias("q"))
    k = j_first_exposure(t).withColumnRenamed("fact_id", "p").join(s, ["execution_id", "listener", "first_round"]).join(oriented(t), ["p", "q"])
    k = k.select("execution_id", "listener", F.col("p").alias("fact_id"), "first_round", "side", "label").distinct()
    best = F.bool_or(F.col("label") != "UNRELATED").over(W.partitionBy("execution_id", "listener", "fact_id"))
    return k.withColumn("better", best).where("label <> 'UNRELATED' or not better").drop("better")


@query(EXPOSED + " SELECT p, label, count(*) AS partners FROM r2 GROUP BY 1, 2")
def of_load(t: Trace) -> DataFrame:
    return oriented(t).groupBy("p", "label").agg(F.count("*").alias("partners"))


@query(EXPOSED + " SELECT side, label, count(*) AS exposures FROM kk GROUP BY 1, 2")
def of_q2_own_vs_peer(t: Trace) -> DataFrame:
    return _kinds(t).groupBy("side", "label").agg(F.count("*").alias("exposures"))


@query(EXPOSED + ", g AS (SELECT execution_id, fact_id, first_round FROM ex GROUP BY 1, 2, 3 HAVING count(*) >= 2), s AS (SELECT execution_id, listener, fact_id, first_round, string_agg(label, ',' ORDER BY label) AS kinds FROM kk GROUP BY 1, 2, 3, 4), c AS (SELECT g.execution_id, g.fact_id, count(kinds) AS told, count(DISTINCT kinds) AS ways FROM g LEFT JOIN s USING (execution_id, fact_id, first_round) GROUP BY g.execution_id, g.fact_id, g.first_round) SELECT execution_id, count(*) AS propositions, count(CASE WHEN told >= 2 THEN 1 END) AS comparable, count(CASE WHEN told >= 2 AND ways = 1 THEN 1 END) AS agree FROM c GROUP BY 1")
def of_q1_multi_receiver(t: Trace) -> DataFrame:
    key = ["execution_id", "fact_id", "first_round"]
    g = j_first_exposure(t).groupBy(*key).agg(F.count("*").alias("n")).where("n >= 2")
    s = _kinds(t).groupBy(*key, "listener").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("kinds"))  # at most five labels
    c = g.join(s, key, "left").groupBy(*key).agg(F.count("kinds").alias("told"), F.countDistinct("kinds").alias("ways"))
    return c.groupBy("execution_id").agg(F.count("*").alias("propositions"), F.count(F.when(F.col("told") >= 2, 1)).alias("comparable"), F.count(F.when((F.col("told") >= 2) & (F.col("ways") == 1), 1)).alias("agree"))


@query(EXPOSED + ", eq AS (SELECT DISTINCT p, q FROM r2 WHERE label = 'EQUIVALENT' UNION SELECT fact_id, fact_id FROM said), pr AS (SELECT x.execution_id, x.round, x.agent_id AS a, y.agent_id AS b, count(DISTINCT x.fact_id) AS covered FROM said x JOIN eq ON eq.p = x.fact_id JOIN said y ON y.execution_id = x.execution_id AND y.round = x.round AND y.agent_id <> x.agent_id AND y.fact_id = eq.q GROUP BY 1, 2, 3, 4), n AS (SELECT execution_id, round, agent_id, count(*) AS n FROM said GROUP BY 1, 2, 3) SELECT x.execution_id, x.round, x.agent_id AS a, y.agent_id AS b, round(coalesce(covered, 0) * 1.0 / x.n, 6) AS covered FROM n x JOIN n y ON x.execution_id = y.execution_id AND x.round = y.round AND x.agent_id <> y.agent_id LEFT JOIN pr ON pr.execution_id = x.execution_id AND pr.round = x.round AND pr.a = x.agent_id AND pr.b = y.agent_id")
def of_q5_coverage(t: Trace) -> DataFrame:
    """Share of what one agent said in a round that another said in it, in the same or an equivalent fact."""
    same = t.said.select("fact_id").distinct().select(F.col("fact_id").alias("p"), F.col("fact_id").alias("q"))
    eq = oriented(t).where("label = 'EQUIVALENT'").select("p", "q").unionByName(same).distinct()
    x = t.said.select("execution_id", "round", F.col("agent_id").alias("a"), F.col("fact_id").alias("p"))
    y = t.said.select("execution_id", "round", F.col("agent_id").alias("b"), F.col("fact_id").alias("q"))
    pr = x.join(eq, "p").join(y, ["execution_id", "round", "q"]).where("a <> b").groupBy("execution_id", "round", "a", "b").agg(F.countDistinct("p").alias("c"))
    n = x.groupBy("execution_id", "round", "a").agg(F.count("*").alias("n"))
    grid = n.join(n.select("execution_id", "round", F.col("a").alias("b")), ["execution_id", "round"]).where("a <> b")
    return grid.join(pr, ["execution_id", "round", "a", "b"], "left").select("execution_id", "round", "a", "b", r6(F.coalesce("c", F.lit(0)) / F.col("n")).alias("covered"))


@query(EXPOSED + ", h AS (SELECT s.execution_id, s.agent_id, s.round, s.fact_id, min(CASE label WHEN 'EQUIVALENT' THEN 1 WHEN 'A_ENTAILS_B' THEN 2 WHEN 'B_ENTAILS_A' THEN 3 WHEN NULL THEN 5 ELSE CASE WHEN label IS NULL THEN 5 ELSE 4 END END) AS k FROM said s LEFT JOIN (SELECT ex.execution_id, listener, first_round, q, label FROM ex JOIN r2 ON p = ex.fact_id) v ON v.execution_id = s.execution_id AND v.listener = s.agent_id AND v.first_round <= s.round AND v.q = s.fact_id GROUP BY 1, 2, 3, 4) SELECT round, CASE k WHEN 1 THEN 'equivalent' WHEN 2 THEN 'weaker' WHEN 3 THEN 'refined' WHEN 4 THEN 'unrelated' ELSE 'unmatched' END AS novelty, count(*) AS facts FROM h GROUP BY 1, 2")
def of_q6_novelty(t: Trace) -> DataFrame:
    """Each output against all that was visible to its speaker by then; the first of the classes that applies."""
    v = j_first_exposure(t).withColumnRenamed("fact_id", "p").join(oriented(t), "p").select("execution_id", F.col("listener").alias("agent_id"), "first_round", F.col("q").alias("fact_id"), "label")
    code = F.when(F.col("label") == "EQUIVALENT", 1).when(F.col("label") == "A_ENTAILS_B", 2).when(F.col("label") == "B_ENTAILS_A", 3).when(F.col("label").isNotNull(), 4).otherwise(5)
    key = ["execution_id", "agent_id", "fact_id"]
    s, v = t.said.alias("s"), v.alias("v")
    j = s.join(v, [F.col(f"s.{c}") == F.col(f"v.{c}") for c in key] + [F.col("v.first_round") <= F.col("s.round")], "left")
    h = j.groupBy("s.execution_id", "s.agent_id", "s.round", "s.fact_id").agg(F.min(code).alias("k"))
    name = F.element_at(F.array(*map(F.lit, ("equivalent", "weaker", "refined", "unrelated", "unmatched"))), F.col("k"))
    return h.groupBy("round", name.alias("novelty")).agg(F.count("*").alias("facts"))


@query(", n AS (SELECT execution_id, count(DISTINCT fact_id) AS n FROM said GROUP BY 1), j AS (SELECT ea AS execution_id, count(DISTINCT least(fa, fb) || greatest(fa, fb)) AS judged FROM lf WHERE ea = eb GROUP BY 1) SELECT topology, CAST(sum(coalesce(judged, 0)) AS BIGINT) AS judged, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS possible FROM n JOIN db USING (execution_id) LEFT JOIN j USING (execution_id) GROUP BY 1")
def of_scored_coverage(t: Trace) -> DataFrame:
    n = t.said.groupBy("execution_id").agg(F.countDistinct("fact_id").alias("n"))
    j = t.lifted.where("ea = eb").groupBy(F.col("ea").alias("execution_id")).agg(F.countDistinct(F.concat(F.least("fa", "fb"), F.greatest("fa", "fb"))).alias("judged"))
    return n.join(t.debates, "execution_id").join(j, "execution_id", "left").groupBy("topology").agg(F.sum(F.coalesce("judged", F.lit(0))).alias("judged"), F.sum(F.expr("n * (n - 1) div 2")).alias("possible"))


@query(", f AS (SELECT s.execution_id, s.fact_id, min(first_rk) AS f, max(last_rk) AS l, count(DISTINCT CASE WHEN own_first_rk > first_rk THEN agent_id END) AS fanout FROM sa s GROUP BY 1, 2) SELECT execution_id, count(*) AS eligible, round(avg(fanout), 6) AS fanout, round(avg(CAST(fanout = 0 AS DOUBLE)), 6) AS dead FROM f WHERE f < l GROUP BY 1")
def ig_fanout_death(t: Trace) -> DataFrame:
    """Facts born before the last round: how many agents took each up later, and the share that no one did."""
    f = t.said_at.groupBy("execution_id", "fact_id").agg(F.min("first_rk").alias("f"), F.max("last_rk").alias("l"), F.countDistinct(F.when(F.col("own_first_rk") > F.col("first_rk"), F.col("agent_id"))).alias("fanout"))
    return f.where("f < l").groupBy("execution_id").agg(F.count("*").alias("eligible"), r6(F.avg("fanout")).alias("fanout"), r6(F.avg((F.col("fanout") == 0).cast("double"))).alias("dead"))


@query(", fs AS (SELECT execution_id, fact_id FROM sa WHERE rk = last_rk GROUP BY 1, 2 HAVING count(DISTINCT agent_id) >= 2), o AS (SELECT ind.*, 1.0 / count(*) OVER (PARTITION BY ind.execution_id, ind.fact_id) AS c FROM ind) SELECT execution_id, agent_id, round(sum(c), 6) AS credit FROM o JOIN fs USING (execution_id, fact_id) GROUP BY 1, 2")
def ig_fractional_credit(t: Trace) -> DataFrame:
    """Credit for facts that two agents or more say in the last round, split among their starters."""
    fs = t.said_at.where("rk = last_rk").groupBy("execution_id", "fact_id").agg(F.countDistinct("agent_id").alias("n")).where("n >= 2").drop("n")
    o = t.independent.withColumn("c", 1 / F.count("*").over(W.partitionBy("execution_id", "fact_id")))
    return o.join(fs, ["execution_id", "fact_id"]).groupBy("execution_id", "agent_id").agg(r6(F.sum("c")).alias("credit"))


@query(", src AS (SELECT DISTINCT execution_id, fact_id, 1 AS src FROM m WHERE channel = 'source') SELECT execution_id, agent_id, round, count(*) AS n, count(src) AS source, count(CASE WHEN src IS NULL AND use = 'held' THEN 1 END) AS self, count(CASE WHEN src IS NULL AND use = 'adopted' THEN 1 END) AS peer, count(CASE WHEN src IS NULL AND use = 'novel' THEN 1 END) AS unmatched FROM us LEFT JOIN src USING (execution_id, fact_id) GROUP BY 1, 2, 3")
def ig_operator_mix(t: Trace) -> DataFrame:
    """Facts of each turn by the first of source, self, peer, unmatched."""
    src = t.mentions.where("channel = 'source'").select("execution_id", "fact_id").distinct().withColumn("src", F.lit(1))
    of = lambda k, y: F.count(F.when(F.col("src").isNull() & (F.col("use") == k), 1)).alias(y)
    return t.uses.join(src, ["execution_id", "fact_id"], "left").groupBy("execution_id", "agent_id", "round").agg(F.count("*").alias("n"), F.count("src").alias("source"), of("held", "self"), of("adopted", "peer"), of("novel", "unmatched"))


@query("SELECT us.execution_id, grounding, count(*) AS adoptions FROM us JOIN gr ON gr.execution_id = us.execution_id AND gr.fact_id = us.fact_id WHERE use = 'adopted' GROUP BY 1, 2")
def ig_adoption_source(t: Trace) -> DataFrame:
    return t.uses.where("use = 'adopted'").join(t.grounding, ["execution_id", "fact_id"]).groupBy("execution_id", "grounding").agg(F.count("*").alias("adoptions"))


VISIBLE = ", ve AS (SELECT e.execution_id, e.label, e.ga AS a, e.gb AS b, e.ra AS r, e.fb AS target FROM (SELECT ea AS execution_id, label, fa, fb, ga, gb, ra, rb FROM lf WHERE ea = eb AND ra < rb AND ga <> gb UNION ALL SELECT ea, CASE label WHEN 'A_ENTAILS_B' THEN 'B_ENTAILS_A' WHEN 'B_ENTAILS_A' THEN 'A_ENTAILS_B' ELSE label END, fb, fa, gb, ga, rb, ra FROM lf WHERE ea = eb AND rb < ra AND ga <> gb) e JOIN dl ON dl.execution_id = e.execution_id AND dl.listener = e.gb AND dl.round = e.rb AND dl.speaker = e.ga AND dl.sent_round = e.ra)"


def _visible(t: Trace) -> DataFrame:
    lf = t.lifted.where("ea = eb and ga <> gb")
    fwd = lf.where("ra < rb").select(F.col("ea").alias("execution_id"), "label", F.col("ga").alias("a"), F.col("gb").alias("b"), F.col("ra").alias("r"), F.col("rb").alias("s"), F.col("fb").alias("target"))
    back = lf.where("rb < ra").select(F.col("ea").alias("execution_id"), T.flipped(F.col("label")).alias("label"), F.col("gb").alias("a"), F.col("ga").alias("b"), F.col("rb").alias("r"), F.col("ra").alias("s"), F.col("fa").alias("target"))
    d = t.deliveries.select("execution_id", F.col("listener").alias("b"), F.col("round").alias("s"), F.col("speaker").alias("a"), F.col("sent_round").alias("r"))
    return fwd.unionByName(back).join(d, ["execution_id", "a", "b", "r", "s"])


@query(VISIBLE + " SELECT execution_id, a, b, label, count(*) AS edges, count(DISTINCT target) AS targets FROM ve GROUP BY 1, 2, 3, 4")
def j_visibility_edge(t: Trace) -> DataFrame:
    """Judged edges from an earlier turn to a later one in whose context it stood."""
    return _visible(t).groupBy("execution_id", "a", "b", "label").agg(F.count("*").alias("edges"), F.countDistinct("target").alias("targets"))


@query(VISIBLE + ", n AS (SELECT execution_id, agent_id AS b, count(*) AS n FROM said GROUP BY 1, 2) SELECT ve.execution_id, a, ve.b, round(count(DISTINCT target) * 1.0 / max(n), 6) AS rate FROM ve JOIN n ON n.execution_id = ve.execution_id AND n.b = ve.b GROUP BY 1, 2, 3")
def ii_interaction(t: Trace) -> DataFrame:
    n = t.said.groupBy("execution_id", F.col("agent_id").alias("b")).agg(F.count("*").alias("n"))
    return _visible(t).join(n, ["execution_id", "b"]).groupBy("execution_id", "a", "b").agg(r6(F.countDistinct("target") / F.max("n")).alias("rate"))


@query("SELECT lf.a, lf.b, label, EXISTS (SELECT 1 FROM dl WHERE dl.execution_id = ea AND dl.listener = gb AND dl.round = rb AND dl.speaker = ga AND dl.sent_round = ra) AS could_see FROM lf WHERE ea = eb AND ra < rb")
def j_could_see(t: Trace) -> DataFrame:
    d = t.deliveries.select(F.col("execution_id").alias("ea"), F.col("listener").alias("gb"), F.col("round").alias("rb"), F.col("speaker").alias("ga"), F.col("sent_round").alias("ra")).withColumn("hit", F.lit(True))
    return t.lifted.where("ea = eb and ra < rb").join(d, ["ea", "gb", "rb", "ga", "ra"], "left").select("a", "b", "label", F.coalesce("hit", F.lit(False)).alias("could_see"))


CRITICAL = ", ev AS (SELECT DISTINCT execution_id, unnest(evidence) AS e FROM debates), tx2 AS (SELECT execution_id, text, min(fact_id) AS fact_id FROM m WHERE channel = 'source' GROUP BY 1, 2), cp AS (SELECT execution_id, fact_id, row_number() OVER (PARTITION BY execution_id ORDER BY e.id) AS i FROM ev JOIN tx2 ON tx2.execution_id = ev.execution_id AND tx2.text = e.text)".replace("SELECT execution_id, fact_id, row_number", "SELECT ev.execution_id, fact_id, row_number").replace("PARTITION BY execution_id ORDER BY e.id", "PARTITION BY ev.execution_id ORDER BY e.id")


@query(CRITICAL + ", sl AS (SELECT execution_id, agent_id, round FROM said JOIN (SELECT * FROM cp WHERE i <= 2) USING (execution_id, fact_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT i) = 2) SELECT execution_id, min(round) AS join_round, arg_min(agent_id, round * 1000 + ascii(agent_id)) AS join_agent, count(*) AS slots FROM sl GROUP BY 1")
def j_critical_pair(t: Trace) -> DataFrame:
    """Turns that hold both of a debate's first two pieces of evidence, and the first of them."""
    ev = t.raw("debates").select("execution_id", F.explode("evidence").alias("e")).distinct().select("execution_id", "e.id", "e.text")
    src = t.worded("text").where("channel = 'source'").groupBy("execution_id", "text").agg(F.min("fact_id").alias("fact_id"))
    cp = ev.join(src, ["execution_id", "text"]).withColumn("i", F.row_number().over(W.partitionBy("execution_id").orderBy("id"))).where("i <= 2")
    sl = t.said.join(cp.select("execution_id", "fact_id", "i"), ["execution_id", "fact_id"]).groupBy("execution_id", "agent_id", "round").agg(F.countDistinct("i").alias("n")).where("n = 2")
    return sl.groupBy("execution_id").agg(F.min("round").alias("join_round"), F.min(F.struct("round", "agent_id")).agent_id.alias("join_agent"), F.count("*").alias("slots"))


@query(", a AS (SELECT x.execution_id, x.a, x.b, y.b AS c, count(*) AS facts FROM tx x JOIN tx y ON x.execution_id = y.execution_id AND x.fact_id = y.fact_id AND x.b = y.a AND y.rk = x.rk + 1 WHERE x.kind = 'transmission' AND y.kind = 'transmission' AND x.a <> y.b GROUP BY 1, 2, 3, 4) SELECT execution_id, a, b, c, facts FROM a")
def chain_path(t: Trace) -> DataFrame:
    """Facts that went from one agent over a second to a third in three rounds on end."""
    x = t.transmissions.where("kind = 'transmission'")
    y = x.select("execution_id", "fact_id", F.col("a").alias("b"), F.col("b").alias("c"), (F.col("rk") - 1).alias("rk"))
    return x.drop("kind").join(y, ["execution_id", "fact_id", "b", "rk"]).where("a <> c").groupBy("execution_id", "a", "b", "c").agg(F.count("*").alias("facts"))


@query("SELECT execution_id, round(avg(CASE WHEN channel = 'context' THEN CAST(polarity = 'negate' AS DOUBLE) END), 6) AS context, round(avg(CASE WHEN channel = 'output' THEN CAST(polarity = 'negate' AS DOUBLE) END), 6) AS output FROM m GROUP BY 1")
def context_output_tilt(t: Trace) -> DataFrame:
    of = lambda c: r6(F.avg(F.when(F.col("channel") == c, (F.col("polarity") == "negate").cast("double")))).alias(c)
    return t.mentions.groupBy("execution_id").agg(of("context"), of("output"))


@query(", r AS (SELECT case_id, count(CASE WHEN use = 'adopted' THEN 1 END) AS n, count(*) AS d FROM us JOIN db USING (execution_id) GROUP BY 1) SELECT count(*) AS cases, round(avg(n * 1.0 / d), 6) AS mean_ratio FROM r")
def case_ratio_mean(t: Trace) -> DataFrame:
    r = t.uses.join(t.debates, "execution_id").groupBy("case_id").agg(F.count(F.when(F.col("use") == "adopted", 1)).alias("n"), F.count("*").alias("d"))
    return r.agg(F.count("*").alias("cases"), r6(F.avg(F.col("n") / F.col("d"))).alias("mean_ratio"))


@query("SELECT topology, model, count(*) AS runs, count(correct) AS answered, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM db GROUP BY 1, 2")
def qa_accuracy(t: Trace) -> DataFrame:
    return t.debates.groupBy("topology", "model").agg(F.count("*").alias("runs"), F.count("correct").alias("answered"), r6(F.avg(F.col("correct").cast("double"))).alias("accuracy"))


@query("SELECT execution_id, listener, round, speaker, sent_round, row_number() OVER (PARTITION BY execution_id, listener ORDER BY round, speaker, sent_round) AS nth FROM dl")
def dg_delivery_list(t: Trace) -> DataFrame:
    w = W.partitionBy("execution_id", "listener").orderBy("round", "speaker", "sent_round")
    return t.deliveries.select("execution_id", "listener", "round", "speaker", "sent_round", F.row_number().over(w).alias("nth"))


# --- topics: labels that the registry gives to facts -----------------------------------------------

TOPICS = ", tp AS (SELECT fact_id, min(properties['topic']) AS topic FROM facts GROUP BY 1)"


def _topics(t: Trace) -> DataFrame:
    return t.raw("facts").groupBy("fact_id").agg(F.min(F.col("properties")["topic"]).alias("topic"))


@query(TOPICS + " SELECT execution_id, agent_id, round, coalesce(topic, 'unlabelled') AS topic, count(*) AS facts FROM said LEFT JOIN tp USING (fact_id) GROUP BY 1, 2, 3, 4")
def tf_seat_topic(t: Trace) -> DataFrame:
    return t.said.join(_topics(t), "fact_id", "left").groupBy("execution_id", "agent_id", "round", F.coalesce("topic", F.lit("unlabelled")).alias("topic")).agg(F.count("*").alias("facts"))


@query(TOPICS + " SELECT execution_id, count(*) AS facts, count(topic) AS labelled FROM (SELECT DISTINCT execution_id, fact_id FROM said) LEFT JOIN tp USING (fact_id) GROUP BY 1")
def tf_label_coverage(t: Trace) -> DataFrame:
    return t.said.select("execution_id", "fact_id").distinct().join(_topics(t), "fact_id", "left").groupBy("execution_id").agg(F.count("*").alias("facts"), F.count("topic").alias("labelled"))


@query(TOPICS + " SELECT x.topic AS topic_a, y.topic AS topic_b, label, count(DISTINCT fa || fb) AS fact_pairs FROM lf JOIN tp x ON x.fact_id = fa JOIN tp y ON y.fact_id = fb GROUP BY 1, 2, 3")
def df_transitions(t: Trace) -> DataFrame:
    of = lambda k: _topics(t).select(F.col("fact_id").alias(f"f{k}"), F.col("topic").alias(f"topic_{k}"))
    return t.lifted.join(of("a"), "fa").join(of("b"), "fb").groupBy("topic_a", "topic_b", "label").agg(F.countDistinct(F.concat("fa", "fb")).alias("fact_pairs"))


@query(TOPICS + ", x AS (SELECT DISTINCT execution_id, listener AS agent_id, round, fact_id FROM rc) SELECT coalesce(topic, 'unlabelled') AS topic, count(*) AS delivered, count(said.round) AS used FROM x LEFT JOIN said USING (execution_id, agent_id, round, fact_id) LEFT JOIN tp USING (fact_id) GROUP BY 1".replace("count(said.round)", "count(u)").replace("LEFT JOIN said USING", "LEFT JOIN (SELECT *, 1 AS u FROM said) USING"))
def df_uptake(t: Trace) -> DataFrame:
    key = ["execution_id", "agent_id", "round", "fact_id"]
    x = t.received.select("execution_id", F.col("listener").alias("agent_id"), "round", "fact_id").distinct().join(t.said.withColumn("u", F.lit(1)), key, "left")
    return x.join(_topics(t), "fact_id", "left").groupBy(F.coalesce("topic", F.lit("unlabelled")).alias("topic")).agg(F.count("*").alias("delivered"), F.count("u").alias("used"))


@query(TOPICS + ", s AS (SELECT execution_id, fact_id, channel AS scope FROM m UNION ALL SELECT execution_id, fact_id, 'delivered' FROM rc) SELECT scope, coalesce(topic, 'unlabelled') AS topic, count(DISTINCT execution_id || fact_id) AS facts FROM s LEFT JOIN tp USING (fact_id) GROUP BY 1, 2")
def df_profile(t: Trace) -> DataFrame:
    s = t.mentions.select("execution_id", "fact_id", F.col("channel").alias("scope")).unionByName(t.received.select("execution_id", "fact_id", F.lit("delivered").alias("scope")))
    return s.join(_topics(t), "fact_id", "left").groupBy("scope", F.coalesce("topic", F.lit("unlabelled")).alias("topic")).agg(F.countDistinct(F.concat("execution_id", "fact_id")).alias("facts"))


@query(", l AS (SELECT DISTINCT fact_id, canonical_text FROM facts) SELECT m.mention_id, coalesce(x.fact_id, y.fact_id) AS label FROM m LEFT JOIN (SELECT DISTINCT fact_id FROM l) x ON x.fact_id = m.fact_id LEFT JOIN (SELECT canonical_text, min(fact_id) AS fact_id FROM l GROUP BY 1) y ON y.canonical_text = m.text")
def j_label_fallback(t: Trace) -> DataFrame:
    """A label by the mention's fact, else by its text."""
    l = t.raw("facts").select("fact_id", "canonical_text").distinct()  # noqa: E741
    by_text = l.groupBy(F.col("canonical_text").alias("text")).agg(F.min("fact_id").alias("l2"))
    m = t.worded("text").join(l.select("fact_id").distinct().withColumn("l1", F.col("fact_id")), "fact_id", "left").join(by_text, "text", "left")
    return m.select("mention_id", F.coalesce("l1", "l2").alias("label"))


# --- event log ------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS batch_start FROM events", base=False)
def w_batch_cut(t: Trace) -> DataFrame:
    """The first event of each batch: one user's events of a kind on a day count as simultaneous."""
    return t.raw("events").select("event_id", "user_id", F.min("event_id").over(W.partitionBy("user_id", "event_type", F.to_date("ts"))).alias("batch_start"))


@query("SELECT event_id, user_id, count(*) OVER w AS seen, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER w, 4) AS spent, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS last_click FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", base=False)
def w_state_fold(t: Trace) -> DataFrame:
    """State of each user before every event: events seen, sum spent, last click."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    e = t.raw("events")
    spent = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)).over(w)
    return e.select("event_id", "user_id", F.count("*").over(w).alias("seen"), F.round(spent, 4).alias("spent"), F.last(F.when(F.col("event_type") == "click", F.col("event_id")), True).over(w).alias("last_click"))


@query(", l AS (SELECT user_id, event_type AS now, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT before, now, count(*) AS moves FROM l WHERE before IS NOT NULL GROUP BY 1, 2")
def w_verdict_lag(t: Trace) -> DataFrame:
    l = t.raw("events").select(F.col("event_type").alias("now"), F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id")).alias("before"))  # noqa: E741
    return l.where("before is not null").groupBy("before", "now").agg(F.count("*").alias("moves"))


@query(", c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, count(*) OVER (PARTITION BY user_id) AS kinds FROM c) SELECT user_id, event_type AS majority, n AS votes, kinds = 1 AS unanimous FROM r WHERE r = 1 AND n >= 2")
def majority(t: Trace) -> DataFrame:
    """The verdict most often given, with two votes at least; ties go to the first by name."""
    c = t.raw("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "event_type")).alias("b"), F.count("*").alias("kinds"))
    return m.where("b.k <= -2").select("user_id", F.col("b.event_type").alias("majority"), (-F.col("b.k")).alias("votes"), (F.col("kinds") == 1).alias("unanimous"))


@query(", p AS (SELECT a AS x, b AS y, confidence FROM jd UNION ALL SELECT b, a, confidence FROM jd), q AS (SELECT x, y, max(confidence) AS c FROM p GROUP BY 1, 2) SELECT x, y, c FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM q) WHERE r <= 3")
def w_topk_row(t: Trace) -> DataFrame:
    """The three judged partners of each mention with the highest confidence."""
    j = t.judged.select(F.col("a").alias("x"), F.col("b").alias("y"), "confidence")
    q = j.unionByName(j.select(F.col("y").alias("x"), F.col("x").alias("y"), "confidence")).groupBy("x", "y").agg(F.max("confidence").alias("c"))
    return q.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy(F.desc("c"), "y"))).where("r <= 3").drop("r")
