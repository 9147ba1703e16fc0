"""What flows by topic: offers and uptake, overlap, edges, mixes of agents; survival, relays, grounding, place in the turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tracemill.operators import stats
from tracemill.operators.base import Trace
from tracemill.plans.census import TOPICS, _topics
from tracemill.plans.lifecycle import r6
from tracemill.plans.registry import query
from tracemill.plans.restated import EVENTS, SCREEN, _count, _opportunities, _screened

ALL = "all"


def _topic(t: Trace, d: DataFrame, fact: str = "fact_id") -> DataFrame:
    """With each fact's topic, 'unlabelled' where it has none."""
    return d.join(_topics(t).withColumnRenamed("fact_id", fact), fact, "left").withColumn("topic", F.coalesce("topic", F.lit("unlabelled")))


OFFERS = TOPICS + """,
fs AS (SELECT execution_id, agent_id, fact_id, min(round) AS first_round FROM said GROUP BY 1, 2, 3),
o0 AS (SELECT DISTINCT rc.execution_id, rc.listener, rc.round, rc.speaker, rc.fact_id FROM rc LEFT JOIN fs ON fs.execution_id = rc.execution_id AND fs.agent_id = rc.listener AND fs.fact_id = rc.fact_id WHERE rc.speaker <> rc.listener AND (first_round IS NULL OR first_round >= rc.round)),
of AS (SELECT o0.*, coalesce(topic, 'unlabelled') AS topic, 1.0 / count(*) OVER (PARTITION BY o0.execution_id, listener, o0.round, o0.fact_id) AS credit, said.fact_id IS NOT NULL AS taken
  FROM o0 LEFT JOIN said ON said.execution_id = o0.execution_id AND said.agent_id = o0.listener AND said.round = o0.round AND said.fact_id = o0.fact_id LEFT JOIN tp ON tp.fact_id = o0.fact_id)"""


def _offers(t: Trace) -> DataFrame:
    """Facts in delivered turns that the listener had not said before, credit shared among their distinct speakers."""
    first = t.first_said.withColumnRenamed("agent_id", "listener")
    o = t.received.where("speaker <> listener").select("execution_id", "listener", "round", "speaker", "fact_id").distinct().join(first, ["execution_id", "listener", "fact_id"], "left")
    o = o.where("first_round is null or first_round >= round").withColumn("taken", F.coalesce(F.col("first_round") == F.col("round"), F.lit(False)))
    return _topic(t, o.withColumn("credit", 1 / F.count("*").over(W.partitionBy("execution_id", "listener", "round", "fact_id"))))


@query(OFFERS + " SELECT execution_id, speaker, listener, topic, round(sum(credit), 6) AS offered, round(sum(CASE WHEN taken THEN credit ELSE 0 END), 6) AS taken FROM of GROUP BY 1, 2, 3, 4")
def stance_flow(t: Trace) -> DataFrame:
    """Credit offered and taken on each edge by the facts' label (here their topic)."""
    g = _offers(t).groupBy("execution_id", "speaker", "listener", "topic")
    return g.agg(r6(F.sum("credit")).alias("offered"), r6(F.sum(F.when(F.col("taken"), F.col("credit")).otherwise(0.0))).alias("taken"))


@query(OFFERS + ", fl AS (SELECT topic, sum(credit) AS c FROM of WHERE taken GROUP BY 1), po AS (SELECT coalesce(topic, 'unlabelled') AS topic, count(*) AS n FROM (SELECT DISTINCT execution_id, fact_id FROM said) LEFT JOIN tp USING (fact_id) GROUP BY 1) SELECT topic, round(coalesce(c, 0) / (SELECT sum(c) FROM fl), 6) AS flow_share, round(n * 1.0 / (SELECT sum(n) FROM po), 6) AS pool_share, round(coalesce(c, 0) / (SELECT sum(c) FROM fl) / (n * 1.0 / (SELECT sum(n) FROM po)), 6) AS lift FROM po LEFT JOIN fl USING (topic)")
def stance_flow_lift(t: Trace) -> DataFrame:
    """Each label's share of what was taken beside its share of what was said."""
    flow = _offers(t).where("taken").groupBy("topic").agg(F.sum("credit").alias("c"))
    pool = _topic(t, t.said.select("execution_id", "fact_id").distinct()).groupBy("topic").agg(F.count("*").alias("n")).join(flow, "topic", "left")
    whole = pool.agg(F.sum("n").alias("all_n"), F.sum("c").alias("all_c"))
    fs, ps = F.coalesce("c", F.lit(0.0)) / F.col("all_c"), F.col("n") / F.col("all_n")
    return pool.crossJoin(F.broadcast(whole)).select("topic", r6(fs).alias("flow_share"), r6(ps).alias("pool_share"), r6(fs / ps).alias("lift"))  # one row


# --- edges and overlap by topic ---------------------------------------------------------------------


@query(
    SCREEN + TOPICS + """,
rs AS (SELECT DISTINCT d.execution_id, d.speaker, d.listener, d.round, s.fact_id FROM dl d JOIN said s ON s.execution_id = d.execution_id AND s.agent_id = d.listener AND s.round = d.round WHERE d.round = d.sent_round + 1 AND d.speaker <> d.listener),
ht AS (SELECT execution_id, speaker, listener, round, late_fact AS fact_id, bool_and(prior) AS prior FROM sc GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT rs.*, coalesce(topic, 'unlabelled') AS topic, ht.fact_id IS NOT NULL AS hit, coalesce(NOT prior, false) AS screened FROM rs LEFT JOIN ht ON ht.execution_id = rs.execution_id AND ht.speaker = rs.speaker AND ht.listener = rs.listener AND ht.round = rs.round AND ht.fact_id = rs.fact_id LEFT JOIN tp ON tp.fact_id = rs.fact_id)
SELECT execution_id, speaker, listener, coalesce(topic, 'all') AS topic, count(*) AS n, round(avg(CAST(hit AS DOUBLE)), 6) AS raw, round(avg(CAST(screened AS DOUBLE)), 6) AS screened FROM x GROUP BY GROUPING SETS ((execution_id, speaker, listener, topic), (execution_id, speaker, listener))"""
)
def df_edges(t: Trace) -> DataFrame:
    """For each ordered pair of agents and topic, and over all topics: shares of the receiver's facts that restate a turn just delivered."""
    d = t.deliveries.where("round = sent_round + 1 and speaker <> listener").select("execution_id", "speaker", "listener", "round").distinct()
    r = d.join(t.said.withColumnRenamed("agent_id", "listener"), ["execution_id", "listener", "round"])
    key = ["execution_id", "speaker", "listener", "round", "fact_id"]
    hit = _screened(t).groupBy("execution_id", "speaker", "listener", "round", F.col("late_fact").alias("fact_id")).agg(F.bool_and("prior").alias("prior"))
    x = _topic(t, r.join(hit, key, "left")).withColumns({"hit": F.col("prior").isNotNull(), "fresh": F.coalesce(~F.col("prior"), F.lit(False))})
    x = x.withColumn("topic", F.explode(F.array("topic", F.lit(ALL))))
    return x.groupBy("execution_id", "speaker", "listener", "topic").agg(F.count("*").alias("n"), r6(F.avg(F.col("hit").cast("double"))).alias("raw"), r6(F.avg(F.col("fresh").cast("double"))).alias("screened"))


MIXES = TOPICS + """,
ot AS (SELECT execution_id, topic, count(*) AS n FROM (SELECT DISTINCT execution_id, fact_id FROM said) JOIN tp USING (fact_id) WHERE topic IS NOT NULL GROUP BY 1, 2),
st AS (SELECT execution_id, topic, count(*) AS n FROM (SELECT DISTINCT execution_id, fact_id FROM m WHERE channel = 'source') JOIN tp USING (fact_id) WHERE topic IS NOT NULL GROUP BY 1, 2),
os AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY execution_id) AS p FROM ot), ss AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY execution_id) AS p FROM st),
en AS (SELECT db.case_id, db.panel, os.topic, os.p AS output, os.p - coalesce(ss.p, 0) AS enrichment FROM os JOIN db USING (execution_id) LEFT JOIN ss ON ss.execution_id = os.execution_id AND ss.topic = os.topic),
cx AS (SELECT case_id, topic, avg(CASE WHEN panel = 'experts' THEN output END) - avg(CASE WHEN panel = 'lay' THEN output END) AS output, avg(CASE WHEN panel = 'experts' THEN enrichment END) - avg(CASE WHEN panel = 'lay' THEN enrichment END) AS enrichment FROM en GROUP BY 1, 2)"""


def _contrasts(t: Trace) -> DataFrame:
    def mix(d: DataFrame, name: str) -> DataFrame:
        n = d.select("execution_id", "fact_id").distinct().join(_topics(t), "fact_id").where("topic is not null").groupBy("execution_id", "topic").agg(F.count("*").alias("n"))
        return n.select("execution_id", "topic", (F.col("n") / F.sum("n").over(W.partitionBy("execution_id"))).alias(name))

    x = mix(t.said, "output").join(t.debates, "execution_id").join(mix(t.source_facts, "given"), ["execution_id", "topic"], "left").withColumn("enrichment", F.col("output") - F.coalesce("given", F.lit(0.0)))
    of = lambda c: F.avg(F.when(F.col("panel") == "experts", F.col(c))) - F.avg(F.when(F.col("panel") == "lay", F.col(c)))
    return x.groupBy("case_id", "topic").agg(of("output").alias("output"), of("enrichment").alias("enrichment")).where("output is not null")


@query(MIXES + " SELECT case_id, topic, round(output, 6) AS output, round(enrichment, 6) AS enrichment FROM cx WHERE output IS NOT NULL")
def df_contrasts(t: Trace) -> DataFrame:
    """Experts less laymen on one case: a topic's share of what was said, and of that beyond its share of the sources."""
    return _contrasts(t).select("case_id", "topic", r6("output").alias("output"), r6("enrichment").alias("enrichment"))


@query(MIXES + " SELECT topic, count(*) AS cases, round(avg(output), 6) AS output, round(avg(enrichment), 6) AS enrichment FROM cx WHERE output IS NOT NULL GROUP BY 1")
def df_summary(t: Trace) -> DataFrame:
    """The contrasts, each case counting once."""
    return _contrasts(t).groupBy("topic").agg(F.count("*").alias("cases"), r6(F.avg("output")).alias("output"), r6(F.avg("enrichment")).alias("enrichment"))


@query(TOPICS + ", q AS (SELECT x.execution_id, x.agent_id, x.fact_id, y.agent_id AS other, y.fact_id AS other_fact FROM jd JOIN m x ON x.mention_id = a JOIN m y ON y.mention_id = b AND x.execution_id = y.execution_id AND x.agent_id <> y.agent_id WHERE label = 'EQUIVALENT' AND x.channel = 'output' AND y.channel = 'output'), cv AS (SELECT execution_id, agent_id, fact_id FROM q UNION SELECT execution_id, other, other_fact FROM q) SELECT coalesce(topic, 'unlabelled') AS topic, count(*) AS facts, count(cv.fact_id) AS covered FROM (SELECT DISTINCT execution_id, agent_id, fact_id FROM said) s LEFT JOIN cv ON cv.execution_id = s.execution_id AND cv.agent_id = s.agent_id AND cv.fact_id = s.fact_id LEFT JOIN tp ON tp.fact_id = s.fact_id GROUP BY 1")
def tf_overlap_axis(t: Trace) -> DataFrame:
    """Facts of each topic that another agent of the run stated equally."""
    of = lambda x: t.mentions.where("channel = 'output' and agent_id is not null").select(F.col("mention_id").alias(x), F.col("execution_id").alias(f"e{x}"), F.col("agent_id").alias(f"g{x}"), F.col("fact_id").alias(f"f{x}"))
    q = t.judged.where("label = 'EQUIVALENT'").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").where("ea = eb and ga <> gb")
    c = q.select(F.explode(F.array(*(F.struct(F.col("ea").alias("execution_id"), F.col(f"g{x}").alias("agent_id"), F.col(f"f{x}").alias("fact_id")) for x in "ab"))).alias("c")).select("c.*").distinct().withColumn("hit", F.lit(1))
    s = t.said.select("execution_id", "agent_id", "fact_id").distinct().join(c, ["execution_id", "agent_id", "fact_id"], "left")
    return _topic(t, s).groupBy("topic").agg(F.count("*").alias("facts"), F.count("hit").alias("covered"))


@query(EVENTS + TOPICS + " SELECT CASE side WHEN 'self' THEN 'self' ELSE 'cross' END AS edge, kind, coalesce(topic, 'unlabelled') AS topic, count(*) AS edges FROM ev LEFT JOIN tp ON tp.fact_id = late_fact WHERE side <> 'invisible' GROUP BY 1, 2, 3")
def tf_edge_topic(t: Trace) -> DataFrame:
    """Topics of the later facts on edges within and between agents."""
    e = _topic(t, t.restatements.where("side <> 'invisible'"), "late_fact")
    return e.groupBy(F.when(F.col("side") == "self", "self").otherwise("cross").alias("edge"), "kind", "topic").agg(F.count("*").alias("edges"))


@query(", rs AS (SELECT execution_id, listener, round, fact_id, count(DISTINCT speaker) AS n FROM rc WHERE speaker <> listener GROUP BY 1, 2, 3, 4) SELECT said.execution_id, said.agent_id, count(CASE WHEN n IS NULL THEN 1 END) AS none, count(CASE WHEN n = 1 THEN 1 END) AS one, count(CASE WHEN n > 1 THEN 1 END) AS more FROM said LEFT JOIN rs ON rs.execution_id = said.execution_id AND rs.listener = said.agent_id AND rs.round = said.round AND rs.fact_id = said.fact_id GROUP BY 1, 2")
def discipline_redundancy(t: Trace) -> DataFrame:
    """Facts said that no, one or several peers had delivered."""
    r = t.received.where("speaker <> listener").groupBy("execution_id", F.col("listener").alias("agent_id"), "round", "fact_id").agg(F.countDistinct("speaker").alias("n"))
    return t.said.join(r, ["execution_id", "agent_id", "round", "fact_id"], "left").groupBy("execution_id", "agent_id").agg(_count("n is null").alias("none"), _count("n = 1").alias("one"), _count("n > 1").alias("more"))


SEAT_MIX = TOPICS + """, sm AS (SELECT execution_id, agent_id, topic, count(*) AS n FROM (SELECT DISTINCT execution_id, agent_id, fact_id FROM said) JOIN tp USING (fact_id) WHERE topic IS NOT NULL GROUP BY 1, 2, 3), sp AS (SELECT *, n * 1.0 / sum(n) OVER w AS p, sum(n) OVER w AS total FROM sm WINDOW w AS (PARTITION BY execution_id, agent_id))"""


def _seat_mix(t: Trace) -> DataFrame:
    n = t.said.select("execution_id", "agent_id", "fact_id").distinct().join(_topics(t), "fact_id").where("topic is not null").groupBy("execution_id", "agent_id", "topic").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("execution_id", "agent_id"))
    return n.withColumns({"p": F.col("n") / total, "total": total})


@query(SEAT_MIX + ", ag2 AS (SELECT DISTINCT execution_id, agent_id FROM sp), pr AS (SELECT x.execution_id, x.agent_id AS a, y.agent_id AS b FROM ag2 x JOIN ag2 y ON x.execution_id = y.execution_id AND x.agent_id < y.agent_id), tt AS (SELECT DISTINCT execution_id, topic FROM sp), pq AS (SELECT pr.*, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM pr JOIN tt USING (execution_id) LEFT JOIN sp x ON x.execution_id = pr.execution_id AND x.agent_id = a AND x.topic = tt.topic LEFT JOIN sp y ON y.execution_id = pr.execution_id AND y.agent_id = b AND y.topic = tt.topic) SELECT execution_id, a, b, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM pq GROUP BY 1, 2, 3")
def discipline_network(t: Trace) -> DataFrame:
    """Jensen-Shannon divergence in bits between the topic mixes of each two agents of a run."""
    s = _seat_mix(t).groupBy("execution_id", "agent_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "p"))).alias("mix"))
    x, y = s.select("execution_id", F.col("agent_id").alias("a"), F.col("mix").alias("x")), s.select("execution_id", F.col("agent_id").alias("b"), F.col("mix").alias("y"))
    keys = F.array_union(F.map_keys("x"), F.map_keys("y"))
    at = lambda m: F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0)))
    p, q = at("x"), at("y")
    return x.join(y, "execution_id").where("a < b").select("execution_id", "a", "b", p.alias("p"), q.alias("q")).select("execution_id", "a", "b", r6(stats.jensen_shannon("p", "q")).alias("js"))


@query(SEAT_MIX + ", tt AS (SELECT DISTINCT execution_id, topic FROM sp), nn AS (SELECT DISTINCT execution_id, agent_id, total FROM sp) SELECT tt.execution_id, tt.topic, round(coalesce(x.p, 0) - coalesce(y.p, 0), 6) AS index FROM tt JOIN nn b ON b.execution_id = tt.execution_id AND b.agent_id = 'B' AND b.total >= 10 JOIN nn c ON c.execution_id = tt.execution_id AND c.agent_id = 'C' AND c.total >= 10 LEFT JOIN sp x ON x.execution_id = tt.execution_id AND x.agent_id = 'B' AND x.topic = tt.topic LEFT JOIN sp y ON y.execution_id = tt.execution_id AND y.agent_id = 'C' AND y.topic = tt.topic")
def specialisation_index(t: Trace) -> DataFrame:
    """Share of a topic in agent B's facts less that in agent C's, where both have ten labelled facts at least."""
    s = _seat_mix(t)
    both = s.groupBy("execution_id").agg(F.max(F.when(F.col("agent_id") == "B", F.col("total"))).alias("b"), F.max(F.when(F.col("agent_id") == "C", F.col("total"))).alias("c")).where("b >= 10 and c >= 10")
    of = lambda k: F.coalesce(F.max(F.when(F.col("agent_id") == k, F.col("p"))), F.lit(0.0))
    return s.join(both, "execution_id").groupBy("execution_id", "topic").agg(r6(of("B") - of("C")).alias("index"))


@query(", s0 AS (SELECT execution_id, agent_id, round, count(*) AS n FROM m WHERE agent_id IS NOT NULL AND round IS NOT NULL GROUP BY 1, 2, 3), op AS (SELECT topology, sum(x.n * y.n) AS n FROM s0 x JOIN s0 y ON x.execution_id = y.execution_id AND x.agent_id <> y.agent_id AND y.round > x.round JOIN db ON db.execution_id = x.execution_id GROUP BY 1), j AS (SELECT topology, label, ra = rb AS same, count(*) AS n FROM lf JOIN db ON db.execution_id = ea WHERE ea = eb AND ga <> gb AND ra IS NOT NULL AND rb IS NOT NULL GROUP BY 1, 2, 3) SELECT topology, label, CAST(sum(CASE WHEN NOT same THEN j.n ELSE 0 END) AS BIGINT) AS later, CAST(sum(CASE WHEN same THEN j.n ELSE 0 END) AS BIGINT) AS same_round, round(sum(CASE WHEN NOT same THEN j.n ELSE 0 END) * 1000.0 / max(op.n), 6) AS per_thousand FROM j JOIN op USING (topology) GROUP BY 1, 2")
def perspectrum_topology(t: Trace) -> DataFrame:
    """Judged edges between agents by topology and label: in later rounds, in the same round, and per thousand opportunities."""
    o = _opportunities(t).join(t.debates, "execution_id").groupBy("topology").agg(F.sum("pairs").alias("pairs"))
    j = t.lifted.where("ea = eb and ga <> gb and ra is not null and rb is not null").join(t.debates.select(F.col("execution_id").alias("ea"), "topology"), "ea")
    g = j.groupBy("topology", "label").agg(_count("ra <> rb").alias("later"), _count("ra = rb").alias("same_round"))
    return g.join(o, "topology").select("topology", "label", "later", "same_round", r6(F.col("later") * 1000.0 / F.col("pairs")).alias("per_thousand"))


@query(EVENTS + " SELECT x.execution_id, x.speaker AS sender, x.listener AS hub, y.listener AS receiver, count(*) AS witnesses FROM ev x JOIN ev y ON x.execution_id = y.execution_id AND x.late = y.early WHERE x.side = 'peer' AND y.side = 'peer' AND x.speaker <> y.listener GROUP BY 1, 2, 3, 4")
def hub_relay_witness(t: Trace) -> DataFrame:
    """Two judged steps through one mention of the agent in the middle, to a third agent."""
    e = t.restatements.where("side = 'peer'")
    x = e.select("execution_id", F.col("speaker").alias("sender"), F.col("listener").alias("hub"), F.col("late").alias("middle"))
    y = e.select("execution_id", F.col("listener").alias("receiver"), F.col("early").alias("middle"))
    return x.join(y, ["execution_id", "middle"]).where("sender <> receiver").groupBy("execution_id", "sender", "hub", "receiver").agg(F.count("*").alias("witnesses"))


# --- survival and relay -----------------------------------------------------------------------------


@query(", al AS (SELECT DISTINCT execution_id, fact_id, rk, first_rk, last_rk FROM sa), pk AS (SELECT execution_id, max(n) AS peak FROM (SELECT execution_id, rk, count(*) AS n FROM al GROUP BY 1, 2) GROUP BY 1), fa AS (SELECT execution_id, fact_id, min(first_rk) = 1 AS early, bool_or(rk = last_rk) AS last FROM al GROUP BY 1, 2), ad AS (SELECT DISTINCT execution_id, fact_id FROM us WHERE use = 'adopted') SELECT fa.execution_id, round(coalesce(avg(CASE WHEN early THEN CAST(last AS DOUBLE) END), 0), 6) AS first_survival, round(count(CASE WHEN last THEN 1 END) * 1.0 / max(peak), 6) AS of_peak, round(coalesce(avg(CASE WHEN ad.fact_id IS NOT NULL THEN CAST(last AS DOUBLE) END), 0), 6) AS adopted_kept FROM fa JOIN pk USING (execution_id) LEFT JOIN ad ON ad.execution_id = fa.execution_id AND ad.fact_id = fa.fact_id GROUP BY 1")
def es_survival(t: Trace) -> DataFrame:
    """Shares alive in the last round: of the first round's facts, of the fullest round's number, of the adopted facts."""
    a = t.said_at.select("execution_id", "fact_id", "rk", "first_rk", "last_rk").distinct()
    peak = a.groupBy("execution_id", "rk").agg(F.count("*").alias("n")).groupBy("execution_id").agg(F.max("n").alias("peak"))
    f = a.groupBy("execution_id", "fact_id").agg((F.min("first_rk") == 1).alias("early"), F.bool_or(F.col("rk") == F.col("last_rk")).alias("last"))
    adopted = t.uses.where("use = 'adopted'").select("execution_id", "fact_id").distinct().withColumn("adopted", F.lit(True))
    f = f.join(adopted, ["execution_id", "fact_id"], "left").join(peak, "execution_id").withColumn("x", F.col("last").cast("double"))
    of = lambda c: r6(F.coalesce(F.avg(F.when(F.col(c), F.col("x"))), F.lit(0.0)))
    return f.groupBy("execution_id").agg(of("early").alias("first_survival"), r6(F.sum("x") / F.max("peak")).alias("of_peak"), of("adopted").alias("adopted_kept"))


@query(", st AS (SELECT execution_id, min(agent_id) AS hub FROM rl JOIN db USING (execution_id) WHERE topology = 'star' GROUP BY 1), fs AS (SELECT execution_id, agent_id, fact_id, min(rk) AS f FROM sa GROUP BY 1, 2, 3), x AS (SELECT DISTINCT st.execution_id, hub, s.agent_id AS sender, t.agent_id AS receiver, s.fact_id, tf.f AS got, hf.f AS via FROM st JOIN sa s ON s.execution_id = st.execution_id AND s.agent_id <> hub AND s.rk = 1 JOIN (SELECT DISTINCT execution_id, agent_id FROM rl) t ON t.execution_id = st.execution_id AND t.agent_id <> hub AND t.agent_id <> s.agent_id LEFT JOIN fs tf ON tf.execution_id = st.execution_id AND tf.agent_id = t.agent_id AND tf.fact_id = s.fact_id LEFT JOIN fs hf ON hf.execution_id = st.execution_id AND hf.agent_id = hub AND hf.fact_id = s.fact_id) SELECT execution_id, sender, receiver, count(*) AS total, count(CASE WHEN got IS NULL THEN 1 END) AS never, count(CASE WHEN got = 1 THEN 1 END) AS coincide, count(CASE WHEN got > 1 THEN 1 END) AS forced, count(CASE WHEN got > 1 AND via < got THEN 1 END) AS via_hub FROM x GROUP BY 1, 2, 3")
def es_relay(t: Trace) -> DataFrame:
    """In a star: first-round facts of one outer agent that another never said, said at once, or later, the hub before it or not."""
    hub = t.roles.join(t.debates.where("topology = 'star'").select("execution_id"), "execution_id").groupBy("execution_id").agg(F.min("agent_id").alias("hub"))
    first = t.said_at.groupBy("execution_id", "agent_id", "fact_id").agg(F.min("rk").alias("f"))
    s = t.said_at.where("rk = 1").select("execution_id", F.col("agent_id").alias("sender"), "fact_id").distinct().join(hub, "execution_id").where("sender <> hub")
    r = t.roles.select("execution_id", F.col("agent_id").alias("receiver")).distinct()
    x = s.join(r, "execution_id").where("receiver <> hub and receiver <> sender")
    of = lambda who, name: first.select("execution_id", F.col("agent_id").alias(who), "fact_id", F.col("f").alias(name))
    x = x.join(of("receiver", "got"), ["execution_id", "receiver", "fact_id"], "left").join(of("hub", "via"), ["execution_id", "hub", "fact_id"], "left")
    return x.groupBy("execution_id", "sender", "receiver").agg(F.count("*").alias("total"), _count("got is null").alias("never"), _count("got = 1").alias("coincide"), _count("got > 1").alias("forced"), _count("got > 1 and via < got").alias("via_hub"))


# --- grounding and place in the turn ----------------------------------------------------------------

GROUND = ", dc AS (SELECT DISTINCT execution_id, fact_id, doc_id FROM m WHERE channel = 'source' AND doc_id IS NOT NULL AND doc_id <> 'claim'), sy AS (SELECT DISTINCT execution_id, agent_id, fact_id FROM said)"


@query(GROUND + " SELECT panel, agent_id, count(*) AS facts, round(avg(CAST(d.fact_id IS NOT NULL AS DOUBLE)), 6) AS grounded FROM sy JOIN db USING (execution_id) LEFT JOIN (SELECT DISTINCT execution_id, fact_id FROM dc) d ON d.execution_id = sy.execution_id AND d.fact_id = sy.fact_id GROUP BY 1, 2")
def grounding_by_role(t: Trace) -> DataFrame:
    """Share of each seat's facts that a source document of the run holds."""
    docs = _docs(t).select("execution_id", "fact_id").distinct().withColumn("hit", F.lit(1.0))
    s = t.said.select("execution_id", "agent_id", "fact_id").distinct().join(t.debates, "execution_id").join(docs, ["execution_id", "fact_id"], "left")
    return s.groupBy("panel", "agent_id").agg(F.count("*").alias("facts"), r6(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("grounded"))


def _docs(t: Trace) -> DataFrame:
    return t.mentions.where("channel = 'source' and doc_id is not null and doc_id <> 'claim'").select("execution_id", "fact_id", "doc_id").distinct()


@query(GROUND + ", dn AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY execution_id, fact_id) AS credit FROM dc) SELECT sy.execution_id, doc_id, agent_id, round(sum(credit), 6) AS credit FROM sy JOIN dn ON dn.execution_id = sy.execution_id AND dn.fact_id = sy.fact_id GROUP BY 1, 2, 3")
def document_flow(t: Trace) -> DataFrame:
    """Flow from documents to agents, a fact's credit shared among the documents that hold it."""
    d = _docs(t).withColumn("credit", 1 / F.count("*").over(W.partitionBy("execution_id", "fact_id")))
    s = t.said.select("execution_id", "agent_id", "fact_id").distinct()
    return s.join(d, ["execution_id", "fact_id"]).groupBy("execution_id", "doc_id", "agent_id").agg(r6(F.sum("credit")).alias("credit"))


@query(", qt AS (SELECT m.execution_id, m.agent_id, m.round, m.fact_id, min((length(substr(text, 1, instr(text, quote) + length(quote) - 1)) - length(replace(substr(text, 1, instr(text, quote) + length(quote) - 1), ' ', '')) + 1.0) / (length(text) - length(replace(text, ' ', '')) + 1)) AS place FROM (SELECT * EXCLUDE (text) FROM m) m JOIN turns USING (execution_id, agent_id, round) WHERE m.channel = 'output' AND quote <> '' AND instr(text, quote) > 0 GROUP BY 1, 2, 3, 4) SELECT panel, use, count(*) AS facts, round(avg(least(1, place)), 6) AS place FROM qt JOIN us USING (execution_id, agent_id, round, fact_id) JOIN db USING (execution_id) GROUP BY 1, 2")
def position_in_turn(t: Trace) -> DataFrame:
    """How far into its turn a fact's quote ends, in words, for held, adopted and novel facts of each panel."""
    q = t.worded("quote").where("channel = 'output' and quote <> ''").select("execution_id", "agent_id", "round", "fact_id", "quote")
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1
    j = q.join(t.turns, ["execution_id", "agent_id", "round"]).withColumn("at", F.expr("instr(text, quote)")).where("at > 0")
    place = words(F.expr("substring(text, 1, at + length(quote) - 1)")) / words(F.col("text"))
    p = j.groupBy("execution_id", "agent_id", "round", "fact_id").agg(F.min(place).alias("place"))
    u = p.join(t.uses.select("execution_id", "agent_id", "round", "fact_id", "use"), ["execution_id", "agent_id", "round", "fact_id"]).join(t.debates, "execution_id")
    return u.groupBy("panel", "use").agg(F.count("*").alias("facts"), r6(F.avg(F.least(F.lit(1.0), F.col("place")))).alias("place"))
