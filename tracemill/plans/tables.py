"""Talk at a table over a run: what is said in public and in private, true and false claims, teams.

The log is read from the trace: a run is a game, a round a quest, an agent a seat, outputs are public and contexts
private; a claim is a mention with its polarity as the side it takes and its fact's topic as its subject. It counts as
true where it affirms. Seats of roles that come first by name are one team, the others the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracemill.operators.base import Trace
from tracemill.plans.census import TOPICS
from tracemill.plans.lifecycle import r6
from tracemill.plans.registry import query
from tracemill.plans.restated import _count
from tracemill.plans.topics import _topic

CLAIMS = TOPICS + """,
te AS (SELECT execution_id, agent_id, role, CASE WHEN row_number() OVER (PARTITION BY execution_id ORDER BY role, agent_id) * 2 <= count(*) OVER (PARTITION BY execution_id) THEN 'first' ELSE 'second' END AS team FROM rl),
cm AS (SELECT m.mention_id, m.execution_id AS game, m.agent_id AS seat, m.round AS quest, m.channel = 'output' AS public, m.polarity AS side, m.polarity = 'affirm' AS truth, coalesce(topic, 'unlabelled') AS subject, role, team
  FROM m JOIN te ON te.execution_id = m.execution_id AND te.agent_id = m.agent_id LEFT JOIN tp ON tp.fact_id = m.fact_id WHERE m.round > 0 AND m.channel IN ('output', 'context')),
eg AS (SELECT DISTINCT least(jd.a, jd.b) AS a, greatest(jd.a, jd.b) AS b, label FROM jd WHERE label <> 'UNRELATED'),
dr AS (SELECT a, b, label FROM eg UNION ALL SELECT b, a, label FROM eg),
rd2 AS (SELECT x.game, x.mention_id AS early, y.mention_id AS late, x.seat AS u, y.seat AS v, x.team AS tu, y.team AS tv, x.role AS ru, y.role AS rv, x.quest AS qu, y.quest AS qv, x.truth AS xt, y.truth AS yt, x.public AS pu, y.public AS pv, label FROM dr JOIN cm x ON x.mention_id = dr.a JOIN cm y ON y.mention_id = dr.b AND x.game = y.game)"""


def _claims(t: Trace) -> DataFrame:
    """A row a claim, with its seat's role and team."""
    w = W.partitionBy("execution_id")  # the seats of one run
    half = F.row_number().over(w.orderBy("role", "agent_id")) * 2 <= F.count("*").over(w)
    team = t.roles.select("execution_id", "agent_id", "role", F.when(half, "first").otherwise("second").alias("team"))
    m = _topic(t, t.mentions.where("round > 0 and channel in ('output', 'context')").join(team, ["execution_id", "agent_id"]))
    return m.select("mention_id", F.col("execution_id").alias("game"), F.col("agent_id").alias("seat"), F.col("round").alias("quest"), (F.col("channel") == "output").alias("public"), F.col("polarity").alias("side"), (F.col("polarity") == "affirm").alias("truth"), F.col("topic").alias("subject"), "role", "team")


def _related(t: Trace) -> DataFrame:
    """Judged pairs of claims of one game that are not unrelated, each in both directions."""
    c = _claims(t)
    e = t.judged.where("label <> 'UNRELATED'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label").distinct()
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "label"))
    of = lambda k, s: c.select(F.col("mention_id").alias(k), F.col("game").alias(f"g{s}"), F.col("seat").alias(s), F.col("team").alias(f"t{s}"), F.col("role").alias(f"r{s}"), F.col("quest").alias(f"q{s}"), F.col("truth").alias(f"{'xy'['uv'.index(s)]}t"), F.col("public").alias(f"p{s}"))
    return e.withColumnsRenamed({"a": "early", "b": "late"}).join(of("early", "u"), "early").join(of("late", "v"), "late").where("gu = gv").withColumnRenamed("gu", "game").drop("gv")


def _share(c: str) -> Column:
    return r6(F.avg(F.expr(c).cast("double")))


@query(CLAIMS + ", p AS (SELECT ru AS role, u, game, count(*) AS n, avg(CAST(label = 'EQUIVALENT' AS DOUBLE)) AS s FROM rd2 WHERE u = v AND pu AND NOT pv GROUP BY 1, 2, 3) SELECT role, count(*) AS seats, CAST(sum(n) AS BIGINT) AS pairs, round(avg(s), 6) AS equal FROM p GROUP BY 1")
def av_say_think(t: Trace) -> DataFrame:
    """How far seats of a role say in public what they hold in private, over judged pairs of their own claims."""
    p = _related(t).where("u = v and pu and not pv").groupBy(F.col("ru").alias("role"), "u", "game").agg(F.count("*").alias("n"), F.avg((F.col("label") == "EQUIVALENT").cast("double")).alias("s"))
    return p.groupBy("role").agg(F.count("*").alias("seats"), F.sum("n").alias("pairs"), r6(F.avg("s")).alias("equal"))


@query(CLAIMS + ", f AS (SELECT mention_id, truth, count(DISTINCT CASE WHEN v <> u THEN v END) AS others, coalesce(max(qv - qu), 0) AS quests FROM cm LEFT JOIN (SELECT * FROM rd2 WHERE qv >= qu AND pv) r ON r.early = mention_id WHERE public GROUP BY 1, 2) SELECT truth, count(*) AS claims, round(avg(others), 6) AS others, round(avg(quests), 6) AS quests FROM f GROUP BY 1")
def av_truth_fanout(t: Trace) -> DataFrame:
    """Of true and of false public claims: how many other seats took them up in the same quest or later, and for how many quests."""
    r = _related(t).where("qv >= qu and pv").select(F.col("early").alias("mention_id"), "u", "v", "qu", "qv")
    f = _claims(t).where("public").select("mention_id", "truth").join(r, "mention_id", "left").groupBy("mention_id", "truth").agg(F.countDistinct(F.when(F.expr("v <> u"), F.col("v"))).alias("others"), F.coalesce(F.max(F.expr("qv - qu")), F.lit(0)).alias("quests"))
    return f.groupBy("truth").agg(F.count("*").alias("claims"), r6(F.avg("others")).alias("others"), r6(F.avg("quests")).alias("quests"))


@query(CLAIMS + " SELECT xt AS early_truth, yt AS late_truth, label, count(*) AS edges FROM rd2 WHERE qu < qv AND pu AND pv GROUP BY 1, 2, 3")
def av_truth_flip(t: Trace) -> DataFrame:
    """Edges from a quest to a later one by the truth of both ends."""
    return _related(t).where("qu < qv and pu and pv").groupBy(F.col("xt").alias("early_truth"), F.col("yt").alias("late_truth"), "label").agg(F.count("*").alias("edges"))


@query(CLAIMS + ", g AS (SELECT game FROM cm WHERE public GROUP BY 1 HAVING count(*) >= 20), l AS (SELECT DISTINCT late AS mention_id, true AS linked FROM rd2 WHERE qu < qv) SELECT quest, count(*) AS claims, round(avg(CAST(subject <> 'unlabelled' AS DOUBLE)), 6) AS labelled, round(avg(CAST(truth AS DOUBLE)), 6) AS accuracy, round(avg(CAST(coalesce(linked, false) AS DOUBLE)), 6) AS linked FROM cm JOIN g USING (game) LEFT JOIN l USING (mention_id) WHERE public GROUP BY 1")
def av_identity_time(t: Trace) -> DataFrame:
    """By quest, over games with twenty public claims at least: shares with a subject, true, and linked to an earlier quest."""
    c = _claims(t).where("public")
    g = c.groupBy("game").agg(F.count("*").alias("n")).where("n >= 20").select("game")
    linked = _related(t).where("qu < qv").select(F.col("late").alias("mention_id")).distinct().withColumn("linked", F.lit(True))
    return c.join(g, "game").join(linked, "mention_id", "left").groupBy("quest").agg(F.count("*").alias("claims"), _share("subject <> 'unlabelled'").alias("labelled"), _share("truth").alias("accuracy"), _share("coalesce(linked, false)").alias("linked"))


OPPORTUNITIES = CLAIMS + ", s0 AS (SELECT game, seat, team, quest, count(*) AS n FROM cm WHERE public GROUP BY 1, 2, 3, 4), op AS (SELECT x.game, x.seat AS u, y.seat AS v, x.team AS tu, y.team AS tv, sum(x.n * y.n) AS chances FROM s0 x JOIN s0 y ON x.game = y.game AND x.seat <> y.seat AND y.quest > x.quest GROUP BY 1, 2, 3, 4, 5), ne AS (SELECT game, u, v, count(*) AS n FROM rd2 WHERE pu AND pv AND u <> v AND qu < qv GROUP BY 1, 2, 3), ab AS (SELECT op.*, coalesce(n, 0) AS edges FROM op LEFT JOIN ne USING (game, u, v))"
LEAST = 20


def _uptake(t: Trace) -> DataFrame:
    """For each ordered pair of seats: chances (pairs of an earlier and a later public claim) and judged edges among them."""
    s = _claims(t).where("public").groupBy("game", "seat", "team", "quest").agg(F.count("*").alias("n"))
    x, y = s.select("game", F.col("seat").alias("u"), F.col("team").alias("tu"), F.col("quest").alias("q1"), F.col("n").alias("n1")), s.select("game", F.col("seat").alias("v"), F.col("team").alias("tv"), F.col("quest").alias("q2"), F.col("n").alias("n2"))
    op = x.join(y, "game").where("u <> v and q2 > q1").groupBy("game", "u", "v", "tu", "tv").agg(F.sum(F.col("n1") * F.col("n2")).alias("chances"))
    e = _related(t).where("pu and pv and u <> v and qu < qv").groupBy("game", "u", "v").agg(F.count("*").alias("edges"))
    return op.join(e, ["game", "u", "v"], "left").na.fill(0, ["edges"])


@query(OPPORTUNITIES + f" SELECT game, tu AS sender, tv AS receiver, CAST(sum(chances) AS BIGINT) AS chances, round(sum(edges) * 1000.0 / sum(chances), 6) AS per_thousand FROM ab GROUP BY 1, 2, 3 HAVING sum(chances) >= {LEAST}")
def av_team_subgraph(t: Trace) -> DataFrame:
    """Edges between and within teams per thousand chances, in games with enough of them."""
    g = _uptake(t).groupBy("game", F.col("tu").alias("sender"), F.col("tv").alias("receiver")).agg(F.sum("chances").alias("chances"), F.sum("edges").alias("edges"))
    return g.where(F.col("chances") >= LEAST).select("game", "sender", "receiver", "chances", r6(F.col("edges") * 1000.0 / F.col("chances")).alias("per_thousand"))


@query(OPPORTUNITIES + f", r AS (SELECT tv AS receiver, tu AS sender, edges * 1000.0 / chances AS x FROM ab WHERE chances >= {LEAST}) SELECT receiver, sender, count(*) AS pairs, round(avg(x), 6) AS uptake FROM r GROUP BY 1, 2")
def av_absorption(t: Trace) -> DataFrame:
    """What a team's seats take up of each seat of a team, per thousand chances, each pair of seats counting once."""
    return _uptake(t).where(F.col("chances") >= LEAST).groupBy(F.col("tv").alias("receiver"), F.col("tu").alias("sender")).agg(F.count("*").alias("pairs"), r6(F.avg(F.col("edges") * 1000.0 / F.col("chances"))).alias("uptake"))


@query(CLAIMS + ", x AS (SELECT late, v, u, qu, min(qu) OVER (PARTITION BY late) AS q0 FROM (SELECT DISTINCT game, late, v, u, qu FROM rd2 WHERE pu AND pv AND u <> v AND qu < qv)), y AS (SELECT DISTINCT late, u, v FROM x WHERE qu = q0), z AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY late) AS credit FROM y) SELECT u AS sender, v AS receiver, round(sum(credit), 6) AS credit FROM z GROUP BY 1, 2")
def av_earliest_credit(t: Trace) -> DataFrame:
    """Credit of each public claim to the seats that came earliest with a related one, shared among them."""
    x = _related(t).where("pu and pv and u <> v and qu < qv").select("late", "v", "u", "qu").distinct()
    first = x.groupBy("late").agg(F.min("qu").alias("q0"))
    y = x.join(first, "late").where("qu = q0").select("late", "u", "v").distinct()
    n = y.groupBy("late").agg(F.count("*").alias("n"))
    return y.join(n, "late").groupBy(F.col("u").alias("sender"), F.col("v").alias("receiver")).agg(r6(F.sum(1 / F.col("n"))).alias("credit"))


@query(CLAIMS + ", e AS (SELECT DISTINCT early, late, u, v, qu, qv, game FROM rd2 WHERE pu AND pv AND u <> v AND qu < qv) SELECT x.game, x.u AS a, x.v AS b, y.v AS c, count(*) AS paths FROM e x JOIN e y ON x.late = y.early AND x.u <> y.v GROUP BY 1, 2, 3, 4")
def av_three_agent_paths(t: Trace) -> DataFrame:
    """Two public steps through one claim, over three seats."""
    e = _related(t).where("pu and pv and u <> v and qu < qv").select("game", "early", "late", "u", "v").distinct()
    x, y = e.select("game", F.col("u").alias("a"), F.col("v").alias("b"), F.col("late").alias("middle")), e.select(F.col("early").alias("middle"), F.col("v").alias("c"))
    return x.join(y, "middle").where("a <> c").groupBy("game", "a", "b", "c").agg(F.count("*").alias("paths"))


@query(CLAIMS + ", tg AS (SELECT late, bool_or(label = 'EQUIVALENT') AS equal FROM rd2 WHERE u <> v AND qu < qv AND pu GROUP BY 1) SELECT game, seat, quest, count(*) AS claims, count(tg.late) AS related, count(CASE WHEN equal THEN 1 END) AS equal FROM cm LEFT JOIN tg ON tg.late = mention_id WHERE public GROUP BY 1, 2, 3")
def av_turn_coverage(t: Trace) -> DataFrame:
    """Public claims of each turn that relate to, or equal, what others had said in an earlier quest."""
    r = _related(t).where("u <> v and qu < qv and pu").groupBy(F.col("late").alias("mention_id")).agg(F.bool_or(F.col("label") == "EQUIVALENT").alias("equal"))
    return _claims(t).where("public").join(r, "mention_id", "left").groupBy("game", "seat", "quest").agg(F.count("*").alias("claims"), F.count("equal").alias("related"), _count("equal").alias("equal"))


@query(CLAIMS + ", k AS (SELECT game, subject, side, seat, role, min(quest) AS q FROM cm WHERE public AND subject <> 'unlabelled' GROUP BY 1, 2, 3, 4, 5), f AS (SELECT game, subject, side, min(q) AS q0 FROM k GROUP BY 1, 2, 3), o AS (SELECT k.game, k.subject, k.side, min(role) AS origin FROM k JOIN f ON f.game = k.game AND f.subject = k.subject AND f.side = k.side AND q = q0 GROUP BY 1, 2, 3), rp AS (SELECT k.game, k.subject, k.side, min(q) AS q1 FROM k JOIN f ON f.game = k.game AND f.subject = k.subject AND f.side = k.side AND q > q0 GROUP BY 1, 2, 3) SELECT origin, count(*) AS claims, count(q1) AS repeated, round(avg(q1 - q0), 6) AS quests FROM o JOIN f USING (game, subject, side) LEFT JOIN rp USING (game, subject, side) GROUP BY 1")
def av_claim_uptake(t: Trace) -> DataFrame:
    """Claims (a subject and a side) by the role that made them first: how many another seat first made in a later quest, and when."""
    key = ["game", "subject", "side"]
    k = _claims(t).where("public and subject <> 'unlabelled' and side is not null").groupBy(*key, "seat", "role").agg(F.min("quest").alias("q"))
    f = k.groupBy(*key).agg(F.min("q").alias("q0"))
    k = k.join(f, key)
    g = k.groupBy(*key, "q0").agg(F.min(F.when(F.expr("q = q0"), F.col("role"))).alias("origin"), F.min(F.when(F.expr("q > q0"), F.col("q"))).alias("q1"))
    return g.groupBy("origin").agg(F.count("*").alias("claims"), F.count("q1").alias("repeated"), r6(F.avg(F.expr("q1 - q0"))).alias("quests"))


@query(CLAIMS + " SELECT role, count(DISTINCT cm.game || '|' || seat) AS seats, count(*) AS claims, round(avg(CAST(public AS DOUBLE)), 6) AS public, round(avg(CAST(truth AS DOUBLE)), 6) AS affirmed, round(avg(CAST(subject <> 'unlabelled' AS DOUBLE)), 6) AS labelled FROM cm GROUP BY 1")
def av_role_profile(t: Trace) -> DataFrame:
    """How seats of each role talk."""
    return _claims(t).groupBy("role").agg(F.countDistinct("game", "seat").alias("seats"), F.count("*").alias("claims"), _share("public").alias("public"), _share("truth").alias("affirmed"), _share("subject <> 'unlabelled'").alias("labelled"))


_WAY = "CASE WHEN u = v THEN 'self' ELSE CASE WHEN pu THEN 'public' ELSE 'private' END || '>' || CASE WHEN pv THEN 'public' ELSE 'private' END END"


@query(CLAIMS + f", own AS (SELECT DISTINCT late FROM rd2 WHERE u = v AND qu < qv), i AS (SELECT {_WAY} AS way, label, rd2.late, own.late IS NOT NULL AS prior FROM rd2 LEFT JOIN own USING (late) WHERE qu < qv) SELECT way, label, count(*) AS edges, count(DISTINCT late) AS targets, count(DISTINCT CASE WHEN NOT prior THEN late END) AS screened FROM i GROUP BY 1, 2")
def av_info_flow(t: Trace) -> DataFrame:
    """Edges to later quests by channel and label, and their targets, all and without those the seat had said something related to before."""
    r = _related(t).where("qu < qv")
    own = r.where("u = v").select("late").distinct().withColumn("prior", F.lit(True))
    side = lambda c: F.when(F.col(c), "public").otherwise("private")
    way = F.when(F.expr("u = v"), "self").otherwise(F.concat(side("pu"), F.lit(">"), side("pv")))
    g = r.join(own, "late", "left").groupBy(way.alias("way"), "label")
    return g.agg(F.count("*").alias("edges"), F.countDistinct("late").alias("targets"), F.countDistinct(F.when(F.col("prior").isNull(), F.col("late"))).alias("screened"))
