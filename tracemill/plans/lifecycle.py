"""Lifecycle queries: classes, trajectories, signatures, flow, uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracemill.operators.base import Trace
from tracemill.plans.registry import query

SIX = 6


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, SIX)


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


# --- base relations -------------------------------------------------------------------------------


@query("SELECT execution_id, agent_id, round, fact_id FROM said")
def said(t: Trace) -> DataFrame:
    return t.said


@query("SELECT (SELECT count(DISTINCT execution_id) FROM m) AS executions, (SELECT count(*) FROM ag) AS agents, (SELECT count(*) FROM rd) AS rounds")
def store_dims(t: Trace) -> DataFrame:
    parts = [t.mentions.agg(F.countDistinct("execution_id").alias("executions")), t.agents.agg(F.count("*").alias("agents")), t.rounds.agg(F.count("*").alias("rounds"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # three rows of one number each


@query(", s AS (SELECT fact_id, count(*) AS n FROM m GROUP BY 1) SELECT count(*) AS facts, sum(n) AS mentions, max(n) AS largest, count(CASE WHEN n = 1 THEN 1 END) AS singletons, quantile_disc(n, 0.5) AS median FROM s")
def stats(t: Trace) -> DataFrame:
    s = t.mentions.groupBy("fact_id").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("facts"), F.sum("n").alias("mentions"), F.max("n").alias("largest"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("long").alias("median"))


@query("SELECT label, count(*) AS n, round(avg(confidence), 6) AS confidence FROM jd GROUP BY 1")
def stats_relations(t: Trace) -> DataFrame:
    return t.judged.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("confidence")).alias("confidence"))


@query("SELECT fact_id, execution_id, grounding FROM gr")
def grounding(t: Trace) -> DataFrame:
    return t.grounding


@query("SELECT fact_id FROM ct")
def contested(t: Trace) -> DataFrame:
    return t.contested


@query("SELECT execution_id, fact_id, agent_id FROM ind")
def independent(t: Trace) -> DataFrame:
    return t.independent


@query("SELECT execution_id, fact_id, grounding, support, spread, fate, contested FROM cl")
def fact_classes(t: Trace) -> DataFrame:
    return t.classes.drop("sources", "first_rk")


@query("SELECT fact_id, execution_id, agent_id, round, channel, count(*) AS mentions FROM m GROUP BY ALL")
def j_mention_fact(t: Trace) -> DataFrame:
    return t.mentions.groupBy("fact_id", "execution_id", "agent_id", "round", "channel").agg(F.count("*").alias("mentions"))


@query("SELECT execution_id, agent_id, round, fact_id, bool_or(channel = 'context') AS in_context, bool_or(channel = 'output') AS in_output FROM m WHERE agent_id IS NOT NULL AND round IS NOT NULL GROUP BY 1, 2, 3, 4")
def j_observed(t: Trace) -> DataFrame:
    m = t.mentions.where("agent_id is not null and round is not null")
    return m.groupBy("execution_id", "agent_id", "round", "fact_id").agg(F.bool_or(F.col("channel") == "context").alias("in_context"), F.bool_or(F.col("channel") == "output").alias("in_output"))


@query("SELECT a, b, label, confidence, fa, fb FROM lf")
def j_relation_lift(t: Trace) -> DataFrame:
    return t.lifted.select("a", "b", "label", "confidence", "fa", "fb")


# --- trajectories ---------------------------------------------------------------------------------

ALIVE = ", al AS (SELECT DISTINCT execution_id, rk, last_rk, fact_id, first_rk FROM sa), al2 AS (SELECT *, lag(rk) OVER (PARTITION BY execution_id, fact_id ORDER BY rk) AS prev, lead(rk) OVER (PARTITION BY execution_id, fact_id ORDER BY rk) AS nxt FROM al)"
TRAJECTORY = (
    ALIVE
    + """, live AS (SELECT execution_id, rk, count(*) AS alive, count(CASE WHEN rk = first_rk THEN 1 END) AS born, count(CASE WHEN prev = rk - 1 THEN 1 END) AS carried FROM al2 GROUP BY 1, 2),
dead AS (SELECT execution_id, rk + 1 AS rk, count(*) AS died FROM al2 WHERE (nxt IS NULL OR nxt > rk + 1) AND rk < last_rk GROUP BY 1, 2),
sd AS (SELECT execution_id, rk, count(*) AS said FROM sa GROUP BY 1, 2),
traj AS (SELECT rd.execution_id, rd.round, rk, coalesce(alive, 0) AS alive, coalesce(born, 0) AS born, coalesce(died, 0) AS died, coalesce(carried, 0) AS carried, coalesce(said, 0) AS said, CAST(sum(coalesce(born, 0)) OVER (PARTITION BY rd.execution_id ORDER BY rk) AS BIGINT) AS cumulative FROM rd LEFT JOIN live USING (execution_id, rk) LEFT JOIN dead USING (execution_id, rk) LEFT JOIN sd USING (execution_id, rk))"""
)


def _alive(t: Trace) -> DataFrame:
    a = t.said_at.select("execution_id", "rk", "last_rk", "fact_id", "first_rk").distinct()
    w = W.partitionBy("execution_id", "fact_id").orderBy("rk")
    return a.withColumns({"prev": F.lag("rk").over(w), "nxt": F.lead("rk").over(w)})


def _trajectory(t: Trace) -> DataFrame:
    a = _alive(t)
    live = a.groupBy("execution_id", "rk").agg(F.count("*").alias("alive"), F.count(F.when(F.col("rk") == F.col("first_rk"), 1)).alias("born"), F.count(F.when(F.col("prev") == F.col("rk") - 1, 1)).alias("carried"))
    dead = a.where("(nxt is null or nxt > rk + 1) and rk < last_rk").groupBy("execution_id", (F.col("rk") + 1).alias("rk")).agg(F.count("*").alias("died"))
    spoken = t.said_at.groupBy("execution_id", "rk").agg(F.count("*").alias("said"))
    key = ["execution_id", "rk"]
    out = t.rounds.join(live, key, "left").join(dead, key, "left").join(spoken, key, "left").na.fill(0, ["alive", "born", "died", "carried", "said"])
    return out.withColumn("cumulative", F.sum("born").over(W.partitionBy("execution_id").orderBy("rk")))


@query(TRAJECTORY + " SELECT execution_id, round, alive, born, died, carried, cumulative, said FROM traj")
def trajectory(t: Trace) -> DataFrame:
    return _trajectory(t).select("execution_id", "round", "alive", "born", "died", "carried", "cumulative", "said")


_MEANS = ("alive", "born", "died", "carried", "cumulative", "said")


@query(TRAJECTORY + " SELECT round, count(*) AS n_runs, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _MEANS) + " FROM traj GROUP BY 1")
def trajectory_mean(t: Trace) -> DataFrame:
    return _trajectory(t).groupBy("round").agg(F.count("*").alias("n_runs"), *(r6(F.avg(c)).alias(c) for c in _MEANS))


@query(TRAJECTORY + " SELECT execution_id, CAST(sum(died) AS BIGINT) AS died, CAST(sum(alive) AS BIGINT) AS alive, round(CAST(sum(died) AS DOUBLE) / nullif(sum(alive), 0), 6) AS churn FROM traj GROUP BY 1")
def churn(t: Trace) -> DataFrame:
    g = _trajectory(t).groupBy("execution_id").agg(F.sum("died").alias("died"), F.sum("alive").alias("alive"))
    return g.withColumn("churn", r6(F.try_divide(F.col("died"), F.col("alive"))))


@query(TRAJECTORY + " SELECT correct, count(DISTINCT execution_id) AS runs, round(CAST(sum(died) AS DOUBLE) / nullif(sum(alive), 0), 6) AS churn FROM traj JOIN db USING (execution_id) GROUP BY 1")
def churn_by_outcome(t: Trace) -> DataFrame:
    g = _trajectory(t).join(t.debates.select("execution_id", "correct"), "execution_id").groupBy("correct")
    return g.agg(F.countDistinct("execution_id").alias("runs"), r6(F.try_divide(F.sum("died"), F.sum("alive"))).alias("churn"))


@query(ALIVE + ", co AS (SELECT execution_id, first_rk, count(DISTINCT fact_id) AS cohort FROM al GROUP BY 1, 2), hit AS (SELECT execution_id, first_rk, rk, count(*) AS n FROM al GROUP BY 1, 2, 3) SELECT co.execution_id, co.first_rk AS born_rk, rd.rk, cohort, round(coalesce(n, 0) * 1.0 / cohort, 6) AS alive FROM co JOIN rd ON rd.execution_id = co.execution_id AND rd.rk >= co.first_rk LEFT JOIN hit ON hit.execution_id = co.execution_id AND hit.first_rk = co.first_rk AND hit.rk = rd.rk")
def survival_curve(t: Trace) -> DataFrame:
    a = t.said_at.select("execution_id", "rk", "fact_id", "first_rk").distinct()
    cohort = a.groupBy("execution_id", F.col("first_rk").alias("born_rk")).agg(F.countDistinct("fact_id").alias("cohort"))
    hit = a.groupBy("execution_id", F.col("first_rk").alias("born_rk"), "rk").agg(F.count("*").alias("n"))
    grid = cohort.join(t.rounds.select("execution_id", "rk"), "execution_id").where("rk >= born_rk")
    return grid.join(hit, ["execution_id", "born_rk", "rk"], "left").select("execution_id", "born_rk", "rk", "cohort", r6(F.coalesce("n", F.lit(0)) / F.col("cohort")).alias("alive"))


@query("SELECT execution_id, grounding, count(*) AS born, count(CASE WHEN contested THEN 1 END) AS born_contested, count(CASE WHEN fate = 'survived' THEN 1 END) AS born_survives, first_rk FROM cl GROUP BY execution_id, grounding, first_rk")
def trajectory_splits(t: Trace) -> DataFrame:
    return t.classes.groupBy("execution_id", "grounding", "first_rk").agg(F.count("*").alias("born"), F.count(F.when(F.col("contested"), 1)).alias("born_contested"), F.count(F.when(F.col("fate") == "survived", 1)).alias("born_survives"))


# --- signatures -----------------------------------------------------------------------------------

AXES = {"grounding": ("gold", "context", "injected"), "support": ("multi", "single"), "spread": ("shared", "private"), "fate": ("survived", "dropped")}
_SHARES = ", ".join(f"avg(CAST({a} = '{v}' AS DOUBLE)) AS {a}_{v}" for a, vs in AXES.items() for v in vs)
SIGNATURE = f""", sg AS (SELECT execution_id, count(*) AS n_facts, {_SHARES}, avg(CAST(contested AS DOUBLE)) AS contested, coalesce(avg(CASE WHEN spread = 'shared' THEN CAST(sources = 1 AS DOUBLE) END), 0) AS echo_rate FROM cl GROUP BY 1),
sgn AS (SELECT sg.*, 1 - n_facts * 1.0 / n AS redundancy FROM sg JOIN (SELECT execution_id, count(*) AS n FROM said GROUP BY 1) USING (execution_id))"""
_SIG = [f"{a}_{v}" for a, vs in AXES.items() for v in vs] + ["contested", "echo_rate", "redundancy"]


def _signature(t: Trace) -> DataFrame:
    shares = [share(F.col(a) == v).alias(f"{a}_{v}") for a, vs in AXES.items() for v in vs]
    s = t.classes.groupBy("execution_id").agg(F.count("*").alias("n_facts"), *shares, share(F.col("contested")).alias("contested"), F.coalesce(F.avg(F.when(F.col("spread") == "shared", (F.col("sources") == 1).cast("double"))), F.lit(0.0)).alias("echo_rate"))
    n = t.said.groupBy("execution_id").agg(F.count("*").alias("n"))
    return s.join(n, "execution_id").withColumn("redundancy", 1 - F.col("n_facts") / F.col("n")).drop("n")


@query(SIGNATURE + " SELECT execution_id, n_facts, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SIG) + " FROM sgn")
def signature(t: Trace) -> DataFrame:
    return _signature(t).select("execution_id", "n_facts", *(r6(c).alias(c) for c in _SIG))


@query(SIGNATURE + " SELECT count(*) AS runs, round(avg(n_facts), 6) AS n_facts, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _SIG) + " FROM sgn")
def mean_signature(t: Trace) -> DataFrame:
    return _signature(t).agg(F.count("*").alias("runs"), r6(F.avg("n_facts")).alias("n_facts"), *(r6(F.avg(c)).alias(c) for c in _SIG))


@query(SIGNATURE + " SELECT model, topology, panel, memory, count(*) AS runs, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _SIG) + " FROM sgn JOIN db USING (execution_id) GROUP BY 1, 2, 3, 4")
def summary_by_config(t: Trace) -> DataFrame:
    g = _signature(t).join(t.debates, "execution_id").groupBy("model", "topology", "panel", "memory")
    return g.agg(F.count("*").alias("runs"), *(r6(F.avg(c)).alias(c) for c in _SIG))


# --- flow -----------------------------------------------------------------------------------------

FLOW = ", fl AS (SELECT tx.*, coalesce(x.role, a) AS role_from, coalesce(y.role, b) AS role_to FROM tx LEFT JOIN rl x ON x.execution_id = tx.execution_id AND x.agent_id = tx.a LEFT JOIN rl y ON y.execution_id = tx.execution_id AND y.agent_id = tx.b)"


def _roled(t: Trace) -> DataFrame:
    of = lambda x, y: t.roles.select("execution_id", F.col("agent_id").alias(x), F.col("role").alias(y))
    f = t.transmissions.join(of("a", "role_from"), ["execution_id", "a"], "left").join(of("b", "role_to"), ["execution_id", "b"], "left")
    return f.withColumns({"role_from": F.coalesce("role_from", "a"), "role_to": F.coalesce("role_to", "b")})


@query(FLOW + " SELECT execution_id, role_from, role_to, grounding, count(*) AS facts FROM fl JOIN cl USING (execution_id, fact_id) GROUP BY 1, 2, 3, 4")
def compressed_flow(t: Trace) -> DataFrame:
    return _roled(t).join(t.classes.select("execution_id", "fact_id", "grounding"), ["execution_id", "fact_id"]).groupBy("execution_id", "role_from", "role_to", "grounding").agg(F.count("*").alias("facts"))


@query(FLOW + " SELECT role_from, role_to, grounding, round(count(*) * 1.0 / (SELECT count(DISTINCT execution_id) FROM m), 6) AS facts FROM fl JOIN cl USING (execution_id, fact_id) GROUP BY 1, 2, 3")
def mean_flow(t: Trace) -> DataFrame:
    n = t.mentions.agg(F.countDistinct("execution_id").alias("n"))
    g = compressed_flow(t).groupBy("role_from", "role_to", "grounding").agg(F.sum("facts").alias("facts"))
    return g.crossJoin(F.broadcast(n)).select("role_from", "role_to", "grounding", r6(F.col("facts") / F.col("n")).alias("facts"))


@query("SELECT execution_id, a, b, rk, kind, count(*) AS facts FROM tx GROUP BY ALL")
def flow_f1(t: Trace) -> DataFrame:
    return t.transmissions.groupBy("execution_id", "a", "b", "rk", "kind").agg(F.count("*").alias("facts"))


@query("SELECT n.execution_id, p.agent_id AS a, n.agent_id AS b, p.rk, CASE WHEN p.agent_id = n.agent_id THEN 'persistence' ELSE 'transmission' END AS kind, count(*) AS facts FROM sa n JOIN sa p ON p.execution_id = n.execution_id AND p.fact_id = n.fact_id AND p.rk = n.rk - 1 LEFT JOIN sa own ON own.execution_id = n.execution_id AND own.fact_id = n.fact_id AND own.rk = n.rk - 1 AND own.agent_id = n.agent_id WHERE p.agent_id = n.agent_id OR own.agent_id IS NULL GROUP BY ALL")
def flow_f2(t: Trace) -> DataFrame:
    """Transmission only if the receiver did not say the fact in the round before; persistence only from that round."""
    s = t.said_at.select("execution_id", "fact_id", "agent_id", "rk")
    now = s.select("execution_id", "fact_id", F.col("agent_id").alias("b"), (F.col("rk") - 1).alias("rk"))
    pairs = now.join(s.withColumnRenamed("agent_id", "a"), ["execution_id", "fact_id", "rk"])
    pairs = pairs.withColumn("own", F.bool_or(F.col("a") == F.col("b")).over(W.partitionBy("execution_id", "fact_id", "rk", "b")))
    return pairs.where("a = b or not own").groupBy("execution_id", "a", "b", "rk", F.when(F.col("a") == F.col("b"), "persistence").otherwise("transmission").alias("kind")).agg(F.count("*").alias("facts"))


@query(", lt AS (SELECT execution_id, listener, round, speaker, fact_id, max(sent_round) AS sent_round FROM rc WHERE sent_round < round GROUP BY ALL) SELECT lt.execution_id, lt.speaker AS a, lt.listener AS b, lt.sent_round, lt.round, count(*) AS facts FROM lt JOIN us ON us.execution_id = lt.execution_id AND us.agent_id = lt.listener AND us.round = lt.round AND us.fact_id = lt.fact_id AND us.use = 'adopted' WHERE lt.speaker <> lt.listener GROUP BY ALL")
def flow_f3(t: Trace) -> DataFrame:
    """New to the receiver, from the latest delivered turn of each sender that held the fact."""
    last = t.received.where("sent_round < round").groupBy("execution_id", "listener", "round", "speaker", "fact_id").agg(F.max("sent_round").alias("sent_round"))
    new = t.uses.where("use = 'adopted'").select("execution_id", F.col("agent_id").alias("listener"), "round", "fact_id")
    return last.where("speaker <> listener").join(new, ["execution_id", "listener", "round", "fact_id"]).groupBy("execution_id", F.col("speaker").alias("a"), F.col("listener").alias("b"), "sent_round", "round").agg(F.count("*").alias("facts"))


@query(", src AS (SELECT DISTINCT execution_id, fact_id, true AS src FROM m WHERE channel = 'source') SELECT execution_id, agent_id, round, CASE WHEN use = 'held' THEN 'persist' WHEN use = 'adopted' THEN 'transmit' WHEN src THEN 'read' ELSE 'invent' END AS operator, count(*) AS facts FROM us LEFT JOIN src USING (execution_id, fact_id) GROUP BY ALL")
def flow_f4(t: Trace) -> DataFrame:
    """Each turn's facts by where they came from: persist, transmit, read, invent."""
    src = t.mentions.where("channel = 'source'").select("execution_id", "fact_id").distinct().withColumn("src", F.lit(True))
    kind = F.when(F.col("use") == "held", "persist").when(F.col("use") == "adopted", "transmit").when(F.col("src"), "read").otherwise("invent")
    return t.uses.join(src, ["execution_id", "fact_id"], "left").groupBy("execution_id", "agent_id", "round", kind.alias("operator")).agg(F.count("*").alias("facts"))


@query(", cr AS (SELECT DISTINCT rc.execution_id, rc.listener, rc.speaker, rc.round, rc.fact_id FROM rc JOIN us ON us.execution_id = rc.execution_id AND us.agent_id = rc.listener AND us.round = rc.round AND us.fact_id = rc.fact_id AND us.use = 'adopted'), c2 AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY execution_id, listener, round, fact_id) AS credit FROM cr) SELECT execution_id, speaker, listener, round(sum(credit), 6) AS credit FROM c2 GROUP BY 1, 2, 3")
def flow_f5(t: Trace) -> DataFrame:
    """Credit for each adoption, shared among the distinct speakers who had delivered the fact."""
    new = t.uses.where("use = 'adopted'").select("execution_id", F.col("agent_id").alias("listener"), "round", "fact_id")
    c = t.received.select("execution_id", "listener", "speaker", "round", "fact_id").distinct().join(new, ["execution_id", "listener", "round", "fact_id"])
    c = c.withColumn("credit", 1 / F.count("*").over(W.partitionBy("execution_id", "listener", "round", "fact_id")))
    return c.groupBy("execution_id", "speaker", "listener").agg(r6(F.sum("credit")).alias("credit"))


@query("SELECT execution_id, agent_id, count(CASE WHEN own THEN 1 END) AS facts FROM ag LEFT JOIN (SELECT execution_id, fact_id, agent_id, true AS own FROM cl JOIN ind USING (execution_id, fact_id) WHERE fate = 'survived' AND grounding = 'gold' AND sources = 1) USING (execution_id, agent_id) GROUP BY 1, 2")
def load_bearing(t: Trace) -> DataFrame:
    only = t.classes.where("fate = 'survived' and grounding = 'gold' and sources = 1").select("execution_id", "fact_id").join(t.independent, ["execution_id", "fact_id"])
    return t.agents.join(only, ["execution_id", "agent_id"], "left").groupBy("execution_id", "agent_id").agg(F.count("fact_id").alias("facts"))


@query("SELECT execution_id, round(coalesce(avg(CASE WHEN fate = 'survived' AND grounding = 'gold' THEN CAST(sources <= 1 AS DOUBLE) END), 0), 6) AS fragility FROM cl GROUP BY 1")
def fragility(t: Trace) -> DataFrame:
    c = F.when((F.col("fate") == "survived") & (F.col("grounding") == "gold"), (F.col("sources") <= 1).cast("double"))
    return t.classes.groupBy("execution_id").agg(r6(F.coalesce(F.avg(c), F.lit(0.0))).alias("fragility"))


# --- uses, reach and roles ------------------------------------------------------------------------

USES = ", u AS (SELECT execution_id, count(*) AS n, count(CASE WHEN use = 'novel' THEN 1 END) AS novel, count(CASE WHEN use = 'held' THEN 1 END) AS held, count(CASE WHEN use = 'adopted' THEN 1 END) AS adopted FROM us GROUP BY 1)"


@query(USES + " SELECT execution_id, novel, held, adopted, round(adopted * 1.0 / n, 6) AS adopted_share, round(held * 1.0 / n, 6) AS held_share FROM u")
def flow_profile(t: Trace) -> DataFrame:
    of = lambda x: F.count(F.when(F.col("use") == x, 1)).alias(x)
    g = t.uses.groupBy("execution_id").agg(F.count("*").alias("n"), of("novel"), of("held"), of("adopted"))
    return g.select("execution_id", "novel", "held", "adopted", r6(F.col("adopted") / F.col("n")).alias("adopted_share"), r6(F.col("held") / F.col("n")).alias("held_share"))


@query(USES + " SELECT model, topology, persona, count(*) AS runs, round(avg(novel), 6) AS novel, round(avg(held), 6) AS held, round(avg(adopted), 6) AS adopted FROM u JOIN db USING (execution_id) GROUP BY 1, 2, 3")
def es_cells(t: Trace) -> DataFrame:
    g = flow_profile(t).join(t.debates, "execution_id").groupBy("model", "topology", "persona")
    return g.agg(F.count("*").alias("runs"), *(r6(F.avg(c)).alias(c) for c in ("novel", "held", "adopted")))


@query(", es AS (SELECT execution_id, a, b, CAST(sum(CASE WHEN kind = 'transmission' THEN 1 ELSE 0 END) AS BIGINT) AS v FROM tx WHERE a <> b GROUP BY 1, 2, 3), rk2 AS (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY v, a, b) - 1 AS i, count(*) OVER (PARTITION BY execution_id) AS n FROM es) SELECT execution_id, round(CAST(sum((2 * i - n + 1) * v) AS DOUBLE) / nullif(max(n) * sum(v), 0), 6) AS gini FROM rk2 GROUP BY 1")
def gini(t: Trace) -> DataFrame:
    """Inequality of the volumes that edges between agents carry."""
    e = t.transmissions.where("a <> b").groupBy("execution_id", "a", "b").agg(F.count("*").alias("v"))
    # At most agents x agents rows an execution.
    w = W.partitionBy("execution_id")
    e = e.withColumns({"i": F.row_number().over(w.orderBy("v", "a", "b")) - 1, "n": F.count("*").over(w)})
    return e.groupBy("execution_id").agg(r6(F.try_divide(F.sum((2 * F.col("i") - F.col("n") + 1) * F.col("v")).cast("double"), F.max("n") * F.sum("v"))).alias("gini"))


SETS = ", s1 AS (SELECT DISTINCT execution_id, agent_id, fact_id FROM said), sz AS (SELECT execution_id, agent_id, count(*) AS n FROM s1 GROUP BY 1, 2), pr AS (SELECT x.execution_id, x.agent_id AS a, y.agent_id AS b, count(*) AS both_n FROM s1 x JOIN s1 y ON x.execution_id = y.execution_id AND x.fact_id = y.fact_id GROUP BY 1, 2, 3), pz AS (SELECT x.execution_id, x.agent_id AS a, y.agent_id AS b, x.n AS na, y.n AS nb, coalesce(both_n, 0) AS both_n FROM sz x JOIN sz y ON x.execution_id = y.execution_id LEFT JOIN pr ON pr.execution_id = x.execution_id AND pr.a = x.agent_id AND pr.b = y.agent_id)"


def _overlaps(t: Trace) -> DataFrame:
    s = t.said.select("execution_id", "agent_id", "fact_id").distinct()
    n = s.groupBy("execution_id", "agent_id").agg(F.count("*").alias("n"))
    both = s.withColumnRenamed("agent_id", "a").join(s.withColumnRenamed("agent_id", "b"), ["execution_id", "fact_id"]).groupBy("execution_id", "a", "b").agg(F.count("*").alias("both_n"))
    grid = n.select("execution_id", F.col("agent_id").alias("a"), F.col("n").alias("na")).join(n.select("execution_id", F.col("agent_id").alias("b"), F.col("n").alias("nb")), "execution_id")
    return grid.join(both, ["execution_id", "a", "b"], "left").na.fill(0, ["both_n"])


@query(SETS + " SELECT execution_id, round(avg(both_n * 1.0 / nb), 6) AS nestedness FROM pz WHERE a <> b GROUP BY 1")
def nestedness(t: Trace) -> DataFrame:
    return _overlaps(t).where("a <> b").groupBy("execution_id").agg(r6(F.avg(F.col("both_n") / F.col("nb"))).alias("nestedness"))


@query(SETS + " SELECT execution_id, round(avg(both_n * 1.0 / least(na, nb)), 6) AS nestedness FROM pz WHERE a < b GROUP BY 1")
def es_nestedness_min(t: Trace) -> DataFrame:
    return _overlaps(t).where("a < b").groupBy("execution_id").agg(r6(F.avg(F.col("both_n") / F.least("na", "nb"))).alias("nestedness"))


@query(SETS + ", jj AS (SELECT execution_id, a, b, both_n * 1.0 / (na + nb - both_n) AS j FROM pz) SELECT execution_id, round(power(sum(CASE WHEN a = b THEN j ELSE 0 END), 2) / sum(j), 6) AS n_eff FROM jj GROUP BY 1")
def es_n_eff(t: Trace) -> DataFrame:
    j = _overlaps(t).withColumn("j", F.col("both_n") / (F.col("na") + F.col("nb") - F.col("both_n")))
    return j.groupBy("execution_id").agg(r6(F.pow(F.sum(F.when(F.col("a") == F.col("b"), F.col("j")).otherwise(0.0)), F.lit(2)) / F.sum("j")).alias("n_eff"))


@query(", f AS (SELECT execution_id, fact_id, count(DISTINCT agent_id) AS staters, count(DISTINCT CASE WHEN own_first_rk = first_rk THEN agent_id END) AS starters FROM sa GROUP BY 1, 2) SELECT execution_id, round(avg(staters), 6) AS reach, round(avg(CASE WHEN staters > 1 THEN CAST(starters = 1 AS DOUBLE) END), 6) AS echo FROM f GROUP BY 1")
def es_echo_reach(t: Trace) -> DataFrame:
    return t.said_at.groupBy("execution_id", "fact_id").agg(F.countDistinct("agent_id").alias("staters"), F.countDistinct(F.when(F.col("own_first_rk") == F.col("first_rk"), F.col("agent_id"))).alias("starters")).groupBy("execution_id").agg(r6(F.avg("staters")).alias("reach"), r6(F.avg(F.when(F.col("staters") > 1, (F.col("starters") == 1).cast("double")))).alias("echo"))


@query(", k AS (SELECT execution_id, fact_id, min(rk) AS f, max(rk) AS l FROM sa GROUP BY 1, 2) SELECT execution_id, f AS first_rk, count(*) AS facts, round(avg(CAST(l > f AS DOUBLE)), 6) AS resaid FROM k GROUP BY 1, 2")
def resaid_survival(t: Trace) -> DataFrame:
    k = t.said_at.groupBy("execution_id", "fact_id").agg(F.min("rk").alias("first_rk"), F.max("rk").alias("l"))
    return k.groupBy("execution_id", "first_rk").agg(F.count("*").alias("facts"), r6(share(F.col("l") > F.col("first_rk"))).alias("resaid"))


@query(", o AS (SELECT execution_id, fact_id, agent_id, 1.0 / count(*) OVER (PARTITION BY execution_id, fact_id) AS c, min(agent_id) OVER (PARTITION BY execution_id, fact_id) AS firstname FROM ind) SELECT execution_id, agent_id, round(sum(c), 6) AS shared_credit, count(CASE WHEN agent_id = firstname THEN 1 END) AS first_credit FROM o GROUP BY 1, 2")
def es_credit(t: Trace) -> DataFrame:
    w = W.partitionBy("execution_id", "fact_id")
    o = t.independent.withColumns({"c": 1 / F.count("*").over(w), "firstname": F.min("agent_id").over(w)})
    return o.groupBy("execution_id", "agent_id").agg(r6(F.sum("c")).alias("shared_credit"), F.count(F.when(F.col("agent_id") == F.col("firstname"), 1)).alias("first_credit"))


@query(", b AS (SELECT unnest([1, 2, 4, 8]) AS budget), k AS (SELECT execution_id, fact_id, min(rk) AS f FROM sa GROUP BY 1, 2) SELECT execution_id, budget, count(CASE WHEN f <= budget THEN 1 END) AS facts FROM k CROSS JOIN b GROUP BY 1, 2")
def es_production(t: Trace) -> DataFrame:
    """Distinct facts produced within the first 1, 2, 4 and 8 rounds."""
    k = t.said_at.select("execution_id", "fact_id", "first_rk").distinct()
    return k.withColumn("budget", F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))).groupBy("execution_id", "budget").agg(F.count(F.when(F.col("first_rk") <= F.col("budget"), 1)).alias("facts"))


@query("SELECT execution_id, a, b, count(*) AS adopted FROM tx WHERE kind = 'transmission' GROUP BY 1, 2, 3")
def transmission_matrix(t: Trace) -> DataFrame:
    return t.transmissions.where("kind = 'transmission'").groupBy("execution_id", "a", "b").agg(F.count("*").alias("adopted"))


@query("SELECT execution_id, agent_id, round, count(*) AS said, count(CASE WHEN use = 'held' THEN 1 END) AS inherited, count(CASE WHEN use = 'adopted' THEN 1 END) AS relayed, count(CASE WHEN use = 'novel' THEN 1 END) AS derived FROM us GROUP BY 1, 2, 3")
def role_profile(t: Trace) -> DataFrame:
    of = lambda x, y: F.count(F.when(F.col("use") == x, 1)).alias(y)
    return t.uses.groupBy("execution_id", "agent_id", "round").agg(F.count("*").alias("said"), of("held", "inherited"), of("adopted", "relayed"), of("novel", "derived"))


@query(", x AS (SELECT DISTINCT execution_id, listener, fact_id FROM rc), a AS (SELECT DISTINCT execution_id, agent_id AS listener, fact_id, max(last_rk) OVER (PARTITION BY execution_id) AS l FROM us WHERE use = 'adopted'), k AS (SELECT DISTINCT execution_id, agent_id AS listener, fact_id FROM sa WHERE rk = last_rk) SELECT x.execution_id, count(*) AS exposed, count(a.fact_id) AS adopted, count(CASE WHEN a.fact_id IS NOT NULL THEN k.fact_id END) AS retained FROM x LEFT JOIN a USING (execution_id, listener, fact_id) LEFT JOIN k USING (execution_id, listener, fact_id) GROUP BY 1")
def funnel(t: Trace) -> DataFrame:
    """Facts delivered to a listener, adopted by it, and still said in the last round."""
    key = ["execution_id", "agent_id", "fact_id"]
    x = t.received.select("execution_id", F.col("listener").alias("agent_id"), "fact_id").distinct()
    a = t.uses.where("use = 'adopted'").select(*key).distinct().withColumn("a", F.lit(1))
    k = t.said_at.where("rk = last_rk").select(*key).distinct().withColumn("k", F.lit(1))
    return x.join(a, key, "left").join(k, key, "left").groupBy("execution_id").agg(F.count("*").alias("exposed"), F.count("a").alias("adopted"), F.count(F.when(F.col("a").isNotNull(), F.col("k"))).alias("retained"))


@query("SELECT s.execution_id, s.fact_id, count(DISTINCT s.agent_id) AS reached_by, min(s.round) AS first_round, bool_or(s.rk = s.last_rk) AS survived FROM sa s JOIN gr ON gr.execution_id = s.execution_id AND gr.fact_id = s.fact_id AND grounding = 'gold' GROUP BY 1, 2")
def gold_coverage(t: Trace) -> DataFrame:
    gold = t.grounding.where("grounding = 'gold'").select("execution_id", "fact_id")
    return t.said_at.join(gold, ["execution_id", "fact_id"]).groupBy("execution_id", "fact_id").agg(F.countDistinct("agent_id").alias("reached_by"), F.min("round").alias("first_round"), F.bool_or(F.col("rk") == F.col("last_rk")).alias("survived"))


@query(", s AS (SELECT DISTINCT execution_id, fact_id FROM m WHERE channel = 'source'), x AS (SELECT s.*, round FROM s LEFT JOIN said USING (execution_id, fact_id)) SELECT execution_id, count(DISTINCT fact_id) AS sources, count(DISTINCT CASE WHEN round = 1 THEN fact_id END) AS r1, count(DISTINCT CASE WHEN round = 2 THEN fact_id END) AS r2, count(DISTINCT CASE WHEN round = 3 THEN fact_id END) AS r3 FROM x GROUP BY 1")
def source_survival(t: Trace) -> DataFrame:
    s = t.mentions.where("channel = 'source'").select("execution_id", "fact_id").distinct().join(t.said, ["execution_id", "fact_id"], "left")
    return s.groupBy("execution_id").agg(F.countDistinct("fact_id").alias("sources"), *(F.countDistinct(F.when(F.col("round") == r, F.col("fact_id"))).alias(f"r{r}") for r in (1, 2, 3)))


@query("SELECT execution_id, fact_id, min(CASE WHEN coalesce(round, 0) = 0 THEN 9 ELSE round END) AS first_round FROM m WHERE (execution_id, fact_id) NOT IN (SELECT execution_id, fact_id FROM m WHERE channel = 'source' AND execution_id IS NOT NULL) GROUP BY 1, 2")
def novel_facts(t: Trace) -> DataFrame:
    src = t.mentions.where("channel = 'source'").select("execution_id", "fact_id").distinct()
    first = F.when(F.coalesce("round", F.lit(0)) == 0, 9).otherwise(F.col("round"))
    return t.mentions.join(src, ["execution_id", "fact_id"], "left_anti").groupBy("execution_id", "fact_id").agg(F.min(first).alias("first_round"))


@query(", p AS (SELECT execution_id, fact_id, grounding, EXISTS (SELECT 1 FROM said WHERE said.execution_id = gr.execution_id AND said.fact_id = gr.fact_id) AS x FROM gr WHERE grounding <> 'injected'), r AS (SELECT execution_id, avg(CASE WHEN grounding = 'gold' THEN CAST(x AS DOUBLE) END) AS gold, avg(CASE WHEN grounding = 'context' THEN CAST(x AS DOUBLE) END) AS other FROM p GROUP BY 1) SELECT execution_id, round(gold, 6) AS gold, round(other, 6) AS other, round(gold - other, 6) AS selectivity FROM r")
def selectivity(t: Trace) -> DataFrame:
    x = t.said.select("execution_id", "fact_id").distinct().withColumn("x", F.lit(1.0))
    p = t.grounding.where("grounding <> 'injected'").join(x, ["execution_id", "fact_id"], "left").na.fill(0.0, ["x"])
    of = lambda g: F.avg(F.when(F.col("grounding") == g, F.col("x")))
    return p.groupBy("execution_id").agg(r6(of("gold")).alias("gold"), r6(of("context")).alias("other"), r6(of("gold") - of("context")).alias("selectivity"))


@query("SELECT execution_id, listener, fact_id, min(round) AS first_round, CASE WHEN min(CASE WHEN speaker = listener THEN round END) IS NULL THEN 'peer' WHEN min(CASE WHEN speaker <> listener THEN round END) IS NULL THEN 'own' WHEN min(CASE WHEN speaker = listener THEN round END) < min(CASE WHEN speaker <> listener THEN round END) THEN 'own' WHEN min(CASE WHEN speaker = listener THEN round END) > min(CASE WHEN speaker <> listener THEN round END) THEN 'peer' ELSE 'both' END AS side FROM rc GROUP BY 1, 2, 3")
def j_first_exposure(t: Trace) -> DataFrame:
    own, peer = F.min(F.when(F.col("speaker") == F.col("listener"), F.col("round"))), F.min(F.when(F.col("speaker") != F.col("listener"), F.col("round")))
    side = F.when(own.isNull(), "peer").when(peer.isNull(), "own").when(own < peer, "own").when(own > peer, "peer").otherwise("both")
    return t.received.groupBy("execution_id", "listener", "fact_id").agg(F.min("round").alias("first_round"), side.alias("side"))


@query("SELECT execution_id, listener, speaker, count(*) AS delivered_facts, count(DISTINCT fact_id) AS facts FROM rc GROUP BY 1, 2, 3")
def j_delivery(t: Trace) -> DataFrame:
    return t.received.groupBy("execution_id", "listener", "speaker").agg(F.count("*").alias("delivered_facts"), F.countDistinct("fact_id").alias("facts"))


@query("SELECT execution_id, p.round AS round, n.round AS next_round, p.rk FROM rd p JOIN rd n USING (execution_id) WHERE n.rk = p.rk + 1")
def w_adjacent(t: Trace) -> DataFrame:
    return t.rounds.withColumn("next_round", F.lead("round").over(W.partitionBy("execution_id").orderBy("rk"))).where("next_round is not null").select("execution_id", "round", "next_round", "rk")


@query("SELECT execution_id, agent_id, round, count(*) AS facts, count(CASE WHEN own_first_rk < rk THEN 1 END) AS said_before FROM sa GROUP BY 1, 2, 3")
def w_prior_self(t: Trace) -> DataFrame:
    return t.said_at.groupBy("execution_id", "agent_id", "round").agg(F.count("*").alias("facts"), F.count(F.when(F.col("own_first_rk") < F.col("rk"), 1)).alias("said_before"))


TOKENS = ", tk AS (SELECT execution_id, agent_id, round, record_no, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM turns)"


def _tokens(t: Trace) -> DataFrame:
    return t.turns.select("execution_id", "agent_id", "round", "record_no", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n"))


@query(TOKENS + " SELECT execution_id, agent_id, round, record_no, n AS turn_tokens, CAST(coalesce(sum(n) OVER (PARTITION BY execution_id ORDER BY round, agent_id, record_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before FROM tk")
def token_clock(t: Trace) -> DataFrame:
    """Words said before each turn of its execution; a window over the turns of one execution, in their order."""
    w = W.partitionBy("execution_id").orderBy("round", "agent_id", "record_no").rowsBetween(W.unboundedPreceding, -1)
    return _tokens(t).select("execution_id", "agent_id", "round", "record_no", F.col("n").alias("turn_tokens"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("tokens_before"))


@query(TOKENS + ", a AS (SELECT execution_id, CAST(sum(n) AS BIGINT) AS tokens FROM tk GROUP BY 1), f AS (SELECT execution_id, count(DISTINCT fact_id) AS facts FROM said GROUP BY 1) SELECT execution_id, tokens, facts, round(1000.0 * facts / nullif(tokens, 0), 6) AS facts_per_k FROM a JOIN f USING (execution_id)")
def token_lifecycle(t: Trace) -> DataFrame:
    a = _tokens(t).groupBy("execution_id").agg(F.sum("n").alias("tokens"))
    f = t.said.groupBy("execution_id").agg(F.countDistinct("fact_id").alias("facts"))
    return a.join(f, "execution_id").select("execution_id", "tokens", "facts", r6(F.try_divide(1000.0 * F.col("facts"), F.col("tokens"))).alias("facts_per_k"))


@query("SELECT execution_id, fact_id, min(rk) AS birth, max(rk) AS last, max(rk) - min(rk) + 1 AS span FROM sa GROUP BY 1, 2")
def fate_times(t: Trace) -> DataFrame:
    return t.said_at.groupBy("execution_id", "fact_id").agg(F.min("rk").alias("birth"), F.max("rk").alias("last"), (F.max("rk") - F.min("rk") + 1).alias("span"))


@query(", d AS (SELECT execution_id, listener, round, speaker, sent_round FROM dl), mv AS (SELECT d.*, (SELECT count(*) FROM said s JOIN us u ON u.execution_id = s.execution_id AND u.fact_id = s.fact_id WHERE s.execution_id = d.execution_id AND s.agent_id = d.speaker AND s.round = d.sent_round AND u.agent_id = d.listener AND u.round = d.round AND u.own_first_rk = u.rk) AS moved FROM d) SELECT execution_id, count(*) AS deliveries, round(avg(CAST(moved > 0 AS DOUBLE)), 6) AS delivery_use FROM mv GROUP BY 1")
def delivery_use(t: Trace) -> DataFrame:
    new = t.uses.where("own_first_rk = rk").select("execution_id", F.col("agent_id").alias("listener"), "round", "fact_id").withColumn("moved", F.lit(1))
    key = ["execution_id", "listener", "round", "speaker", "sent_round"]
    moved = t.received.join(new, ["execution_id", "listener", "round", "fact_id"]).select(*key).distinct().withColumn("moved", F.lit(1.0))
    return t.deliveries.join(moved, key, "left").groupBy("execution_id").agg(F.count("*").alias("deliveries"), r6(F.avg(F.coalesce("moved", F.lit(0.0)))).alias("delivery_use"))
