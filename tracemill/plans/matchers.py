"""Blocking, matching, scoring of matchers, and statistics over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracemill.functions import text as T
from tracemill.operators import matching, stats
from tracemill.operators.base import Trace
from tracemill.plans.lifecycle import SIGNATURE, USES, _signature, r6
from tracemill.plans.registry import fact_id_sql, query, tokens_sql

WORDKEY = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || '|' || polarity"


@query(f", k AS (SELECT execution_id, mention_id, {WORDKEY} AS key FROM m), f AS (SELECT execution_id, key, min(mention_id) AS first_id FROM k WHERE execution_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) SELECT execution_id, mention_id, first_id FROM k JOIN f USING (execution_id, key)")
def j_exact_first(t: Trace) -> DataFrame:
    return matching.exact_pairs(t.worded("text"))


def _similar(key: str) -> str:
    """SQL of matching.similar_token_sets: sets of equal tokens (and key), their pairs, and the copies of each."""
    return f""", w AS (SELECT execution_id, mention_id, polarity, {tokens_sql('text')} AS w, {key} AS k FROM m),
rp AS (SELECT execution_id, w, k, min(mention_id) AS rep, arg_min(polarity, mention_id) AS polarity FROM w WHERE execution_id IS NOT NULL AND len(w) > 0 GROUP BY 1, 2, 3),
sp AS (SELECT x.execution_id, x.rep AS a, y.rep AS b, x.polarity AS pa, y.polarity AS pb, len(list_intersect(x.w, y.w)) AS n, len(x.w) AS na, len(y.w) AS nb FROM rp x JOIN rp y ON x.execution_id = y.execution_id AND x.rep < y.rep AND least(len(x.w), len(y.w)) >= 0.8 * greatest(len(x.w), len(y.w))),
sj AS (SELECT execution_id, a, b, pa, pb, n * 1.0 / (na + nb - n) AS jaccard FROM sp UNION ALL SELECT w.execution_id, rep, mention_id, rp.polarity, w.polarity, 1.0 FROM w JOIN rp ON rp.execution_id = w.execution_id AND rp.w = w.w AND rp.k = w.k WHERE mention_id <> rep)"""


@query(_similar("1") + " SELECT execution_id, a, b, round(jaccard, 6) AS jaccard FROM sj WHERE jaccard >= 0.8 - 1e-9")
def j_partitioned_block(t: Trace) -> DataFrame:
    return matching.similar_token_sets(t.worded("text"), 0.8).withColumn("jaccard", r6("jaccard"))


@query(_similar("coalesce(polarity, '')") + " SELECT execution_id, a, b, CASE WHEN pa <> pb THEN 'CONTRADICTS' ELSE 'EQUIVALENT' END AS relation FROM sj WHERE jaccard >= 0.8 - 1e-9")
def light_match(t: Trace) -> DataFrame:
    return matching.light_match(t.worded("text"))


# TF-IDF of words, pairs of words and characters within words, by execution; the larger of cosine and containment.
CANDIDATES = f""", cx AS (SELECT execution_id, mention_id, agent_id, round, channel, text, {tokens_sql('text')} AS tk FROM m WHERE execution_id IS NOT NULL),
wl AS (SELECT execution_id, mention_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\p{{M}}]{{2,}}') AS w, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS s FROM cx),
g0 AS (SELECT execution_id, mention_id, 'w' AS block, unnest(w) AS term FROM wl UNION ALL SELECT execution_id, mention_id, 'w', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM wl
UNION ALL SELECT execution_id, mention_id, 'c', unnest(flatten(list_transform(s, lambda x: CASE WHEN length(x) + 2 > n THEN list_transform(range(1, length(x) + 4 - n), lambda i: substr(' ' || x || ' ', i, n)) WHEN length(x) + 2 = n OR n = 3 THEN [' ' || x || ' '] ELSE [] END))) FROM wl CROSS JOIN (SELECT unnest([3, 4, 5]) AS n)),
tf AS (SELECT execution_id, mention_id, block, term, 1 + ln(count(*)) AS tf FROM g0 GROUP BY 1, 2, 3, 4),
nn AS (SELECT execution_id, count(*) AS n FROM cx GROUP BY 1), dfr AS (SELECT execution_id, block, term, count(*) AS df FROM tf GROUP BY 1, 2, 3),
w0 AS (SELECT tf.*, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfr USING (execution_id, block, term) JOIN nn USING (execution_id)),
w1 AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY execution_id, mention_id, block)) AS v FROM w0), w2 AS (SELECT execution_id, mention_id, block || ':' || term AS term, v / sqrt(sum(v * v) OVER (PARTITION BY execution_id, mention_id)) AS v FROM w1),
co AS (SELECT x.execution_id, x.mention_id AS i, y.mention_id AS j, sum(x.v * y.v) AS cosine FROM w2 x JOIN w2 y ON x.execution_id = y.execution_id AND x.term = y.term AND x.mention_id < y.mention_id GROUP BY 1, 2, 3),
ap AS (SELECT x.execution_id, x.mention_id AS i, y.mention_id AS j, round(greatest(coalesce(cosine, CAST(0 AS DOUBLE)), coalesce(CAST(len(list_intersect(x.tk, y.tk)) AS DOUBLE) / nullif(least(len(x.tk), len(y.tk)), 0), CAST(0 AS DOUBLE))), 9) AS sim,
  x.agent_id IS DISTINCT FROM y.agent_id OR x.round IS DISTINCT FROM y.round OR x.channel IS DISTINCT FROM y.channel AS apart FROM cx x JOIN cx y ON x.execution_id = y.execution_id AND x.mention_id < y.mention_id LEFT JOIN co ON co.execution_id = x.execution_id AND co.i = x.mention_id AND co.j = y.mention_id),
bw AS (SELECT execution_id, i, j, sim, apart FROM ap UNION ALL SELECT execution_id, j, i, sim, apart FROM ap),
tk2 AS (SELECT *, row_number() OVER (PARTITION BY execution_id, i ORDER BY sim DESC, j) AS r FROM bw)
SELECT execution_id AS pool, least(i, j) AS a, greatest(i, j) AS b, round(max(sim), 4) AS sim FROM tk2 WHERE r <= 12 AND sim >= 0.5 AND apart GROUP BY 1, 2, 3"""


@query(CANDIDATES)
def candidate_pairs(t: Trace) -> DataFrame:
    return matching.candidate_pairs(t.worded("text")).withColumn("sim", F.round("sim", 4))


@query(", ed AS (SELECT a AS u, b AS v FROM jd WHERE label = 'EQUIVALENT' AND confidence >= 0.85), ee AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed), reach AS (SELECT DISTINCT u AS id, u AS root FROM ee UNION SELECT ee.v, root FROM reach JOIN ee ON ee.u = reach.id WHERE root < ee.v), rt AS (SELECT id, min(root) AS root FROM reach GROUP BY 1), g AS (SELECT m.*, coalesce(root, mention_id) AS grp FROM m LEFT JOIN rt ON rt.id = m.mention_id) SELECT mention_id, first_value(" + fact_id_sql("text") + ") OVER (PARTITION BY grp ORDER BY channel <> 'source', -coalesce(len(qualifiers), 0), -length(text), ord, mention_id) AS fact_id FROM g", recursive=True)
def match(t: Trace) -> DataFrame:
    return matching.match(t.worded("text", "qualifiers"), t.judged)


@query("SELECT fact_id, mention_id FROM (SELECT fact_id, mention_id, row_number() OVER (PARTITION BY fact_id ORDER BY channel <> 'source', -coalesce(len(qualifiers), 0), -length(text), ord, mention_id) AS r FROM m) WHERE r = 1")
def pick_canonical(t: Trace) -> DataFrame:
    return matching.pick_canonical(t.worded("text", "qualifiers"), "fact_id")


@query("SELECT fact_id, mention_id, row_number() OVER (PARTITION BY fact_id ORDER BY ord, mention_id) AS r FROM m QUALIFY r <= 3")
def s_limit_examples(t: Trace) -> DataFrame:
    """The first three mentions of each fact."""
    w = W.partitionBy("fact_id").orderBy("ord", "mention_id")
    return t.mentions.select("fact_id", "mention_id", F.row_number().over(w).alias("r")).where("r <= 3")


@query(f", k AS (SELECT execution_id, agent_id, round, channel, {fact_id_sql('text')} AS norm_id, mention_id FROM m) SELECT execution_id, agent_id, round, channel, norm_id, min(mention_id) AS mention_id, count(*) AS copies FROM k GROUP BY 1, 2, 3, 4, 5")
def dedup_turns(t: Trace) -> DataFrame:
    """One mention for each text of a slot."""
    return t.worded("text").groupBy("execution_id", "agent_id", "round", "channel", T.make_fact_id(F.col("text")).alias("norm_id")).agg(F.min("mention_id").alias("mention_id"), F.count("*").alias("copies"))


# A matcher that calls a judged pair the same when token containment reaches a cut, against the judges' labels.
SWEEP, FINE = 80, 200
SCORED = f", tk AS (SELECT mention_id, {tokens_sql('text')} AS w FROM m), pr AS (SELECT jd.a, jd.b, jd.label, label = 'EQUIVALENT' AS gold, substr(md5(jd.a || '|' || jd.b), 1, 1) < '8' AS fit, len(list_intersect(x.w, y.w)) * 1.0 / least(len(x.w), len(y.w)) AS s FROM (SELECT DISTINCT a, b, label FROM jd) jd JOIN tk x ON x.mention_id = jd.a JOIN tk y ON y.mention_id = jd.b)"
_BY_CUT = "SELECT k, count(CASE WHEN s >= k / {n}.0 - 1e-9 AND gold THEN 1 END) AS tp, count(CASE WHEN s >= k / {n}.0 - 1e-9 AND NOT gold THEN 1 END) AS fp, count(CASE WHEN NOT coalesce(s >= k / {n}.0 - 1e-9, false) AND gold THEN 1 END) AS fn, count(CASE WHEN NOT coalesce(s >= k / {n}.0 - 1e-9, false) AND NOT gold THEN 1 END) AS tn FROM pr CROSS JOIN (SELECT unnest(range(0, {n} + 1)) AS k) GROUP BY 1"


def _scored(t: Trace) -> DataFrame:
    of = lambda x: t.texts("text").select(F.col("mention_id").alias(x), T.tokenize(F.col("text")).alias(f"w{x}"))
    p = t.judged.select("a", "b", "label").distinct().join(of("a"), "a").join(of("b"), "b")
    fit = F.substring(F.md5(F.concat("a", F.lit("|"), "b")), 1, 1) < "8"
    return p.select("label", (F.col("label") == "EQUIVALENT").alias("gold"), fit.alias("fit"), T.containment(F.col("wa"), F.col("wb")).alias("s"))


def _by_cut(scored: DataFrame, n: int) -> DataFrame:
    """(k, tp, fp, fn, tn) of the cuts k / n: pairs are counted by the last cut they reach, and only those counts are summed over the cuts."""
    reached = F.least(F.floor((F.coalesce("s", F.lit(-1.0)) + 1e-9) * n), F.lit(n))
    h = scored.groupBy(reached.alias("r"), "gold").agg(F.count("*").alias("c"))  # at most 2 (n + 2) rows
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    h = h.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("same", F.col("r") >= F.col("k"))
    return h.groupBy("k").agg(of(F.col("same") & F.col("gold")).alias("tp"), of(F.col("same") & ~F.col("gold")).alias("fp"), of(~F.col("same") & F.col("gold")).alias("fn"), of(~F.col("same") & ~F.col("gold")).alias("tn"))


_F1 = "round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"


def _f1() -> Column:
    return r6(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def _confusion(g, cut: float = 0.8) -> DataFrame:
    s, y = F.coalesce(F.col("s") >= cut - 1e-9, F.lit(False)), F.col("gold")
    c = lambda x: F.count(F.when(x, 1))
    return g.agg(c(s & y).alias("tp"), c(s & ~y).alias("fp"), c(~s & y).alias("fn"), c(~s & ~y).alias("tn")).withColumn("f1", _f1())


_AT = "count(CASE WHEN s >= 0.8 - 1e-9 AND gold THEN 1 END) AS tp, count(CASE WHEN s >= 0.8 - 1e-9 AND NOT gold THEN 1 END) AS fp, count(CASE WHEN NOT coalesce(s >= 0.8 - 1e-9, false) AND gold THEN 1 END) AS fn, count(CASE WHEN NOT coalesce(s >= 0.8 - 1e-9, false) AND NOT gold THEN 1 END) AS tn"


@query(SCORED + f", c AS ({_BY_CUT.format(n=SWEEP)}) SELECT k, tp, fp, fn, tn, {_F1} FROM c")
def sweep_threshold(t: Trace) -> DataFrame:
    """The confusion at each of 81 cuts over the range of scores."""
    return _by_cut(_scored(t), SWEEP).withColumn("f1", _f1())


@query(SCORED + f", c AS (SELECT {_AT} FROM pr) SELECT tp, fp, fn, tn, {_F1} FROM c")
def score_binary(t: Trace) -> DataFrame:
    return _confusion(_scored(t).groupBy())


@query(SCORED + f", c AS (SELECT label, {_AT} FROM pr GROUP BY 1) SELECT label, tp, fp, fn, tn, {_F1} FROM c")
def breakdown(t: Trace) -> DataFrame:
    return _confusion(_scored(t).groupBy("label"))


@query(SCORED + f", f AS ({_BY_CUT.format(n=FINE).replace('FROM pr', 'FROM (SELECT * FROM pr WHERE fit)')}), h AS ({_BY_CUT.format(n=FINE).replace('FROM pr', 'FROM (SELECT * FROM pr WHERE NOT fit)')}), b AS (SELECT k, {_F1} FROM f ORDER BY f1 DESC NULLS LAST, k LIMIT 1) SELECT b.k / 200.0 AS cut, b.f1 AS fitted_f1, round(h.tp * 1.0 / nullif(h.tp + h.fp, 0), 6) AS precision, round(h.tp * 1.0 / nullif(h.tp + h.fn, 0), 6) AS recall, round(2.0 * h.tp / nullif(2 * h.tp + h.fp + h.fn, 0), 6) AS f1 FROM b JOIN h USING (k)")
def calibrate_threshold(t: Trace) -> DataFrame:
    """The first of 201 cuts with the best F1 on one half of the pairs, and what it gives on the half held out. A hash of the pair deals it to a half."""
    scored = _scored(t)
    best = _by_cut(scored.where("fit"), FINE).withColumn("f1", _f1()).orderBy(F.desc_nulls_last("f1"), "k").limit(1).select("k", F.col("f1").alias("fitted_f1"))
    h = _by_cut(scored.where("not fit"), FINE).join(best, "k")
    share = lambda x: r6(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(x)))
    return h.select((F.col("k") / FINE).alias("cut"), "fitted_f1", share("fp").alias("precision"), share("fn").alias("recall"), _f1().alias("f1"))


@query("SELECT label, p AS policy, count(*) AS pairs, count(CASE WHEN label = 'EQUIVALENT' OR (p <> 'strict' AND label = 'A_ENTAILS_B' AND confidence >= 0.9) OR (p = 'entail' AND label IN ('A_ENTAILS_B', 'B_ENTAILS_A')) THEN 1 END) AS same FROM jd CROSS JOIN (SELECT unnest(['strict', 'near', 'entail']) AS p) GROUP BY 1, 2")
def relabel_policy(t: Trace) -> DataFrame:
    """Judged pairs counted as the same under three policies."""
    j = t.judged.withColumn("policy", F.explode(F.array(*map(F.lit, ("strict", "near", "entail")))))
    same = (F.col("label") == "EQUIVALENT") | ((F.col("policy") != "strict") & (F.col("label") == "A_ENTAILS_B") & (F.col("confidence") >= 0.9)) | ((F.col("policy") == "entail") & F.col("label").isin("A_ENTAILS_B", "B_ENTAILS_A"))
    return j.groupBy("label", "policy").agg(F.count("*").alias("pairs"), F.count(F.when(same, 1)).alias("same"))


#: Pairs that a judge of both directions scores a second.
JUDGED_A_SECOND = 15.5 / 2


@query(f", u AS (SELECT execution_id, count(*) AS n, count(DISTINCT {WORDKEY}) AS d FROM m WHERE execution_id IS NOT NULL GROUP BY 1), p AS (SELECT execution_id, n AS mentions, CAST(n * (n - 1) / 2 AS BIGINT) AS possible_pairs, CAST(d * (d - 1) / 2 AS BIGINT) AS distinct_pairs FROM u) SELECT *, possible_pairs - distinct_pairs AS saved_pairs, round(distinct_pairs / {JUDGED_A_SECOND}, 6) AS seconds FROM p")
def estimate_matching(t: Trace) -> DataFrame:
    """What judging all pairs of a run would take, and what joining equal wordings first saves."""
    key = F.concat_ws("|", T.norm_word(F.col("text")), "polarity")
    u = t.worded("text").where("execution_id is not null").groupBy("execution_id").agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"))
    pairs = lambda c, name: (F.col(c) * (F.col(c) - 1) / 2).cast("long").alias(name)
    p = u.select("execution_id", F.col("n").alias("mentions"), pairs("n", "possible_pairs"), pairs("d", "distinct_pairs"))
    return p.withColumns({"saved_pairs": F.col("possible_pairs") - F.col("distinct_pairs"), "seconds": r6(F.col("distinct_pairs") / JUDGED_A_SECOND)})


# --- statistics over runs -------------------------------------------------------------------------


@query(", q AS (SELECT execution_id, count(DISTINCT fact_id) AS x FROM said GROUP BY 1) SELECT topology, count(*) AS runs, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(CASE WHEN count(*) > 1 THEN stddev_samp(x) ELSE 0 END, 6) AS sd FROM q JOIN db USING (execution_id) GROUP BY 1")
def w_pctl_interp(t: Trace) -> DataFrame:
    q = t.said.groupBy("execution_id").agg(F.countDistinct("fact_id").alias("x")).join(t.debates, "execution_id")
    p = lambda v: F.round(F.percentile("x", F.lit(v)), 6)
    return q.groupBy("topology").agg(F.count("*").alias("runs"), p(0.25).alias("q25"), p(0.5).alias("q50"), p(0.75).alias("q75"), r6(F.when(F.count("*") > 1, F.stddev_samp("x")).otherwise(0.0)).alias("sd"))


CONTRAST = SIGNATURE + ", c AS (SELECT case_id, avg(CASE WHEN topology = 'broadcast' THEN n_facts END) AS x, avg(CASE WHEN topology = 'chain' THEN n_facts END) AS y FROM sgn JOIN db USING (execution_id) GROUP BY 1)"


def _contrast(t: Trace) -> DataFrame:
    of = lambda k: F.avg(F.when(F.col("topology") == k, F.col("n_facts")))
    return _signature(t).join(t.debates, "execution_id").groupBy("case_id").agg(of("broadcast").alias("x"), of("chain").alias("y")).where("x is not null and y is not null")


@query(CONTRAST + " SELECT case_id, round(x, 6) AS broadcast, round(y, 6) AS chain, round(x - y, 6) AS difference FROM c WHERE x IS NOT NULL AND y IS NOT NULL")
def st_paired_contrast(t: Trace) -> DataFrame:
    return _contrast(t).select("case_id", r6("x").alias("broadcast"), r6("y").alias("chain"), r6(F.col("x") - F.col("y")).alias("difference"))


@query(CONTRAST + " SELECT count(*) AS cases, round(avg(x - y), 6) AS mean_difference, count(CASE WHEN x > y THEN 1 END) AS wins, count(CASE WHEN x < y THEN 1 END) AS losses FROM c WHERE x IS NOT NULL AND y IS NOT NULL")
def st_signs(t: Trace) -> DataFrame:
    return _contrast(t).agg(F.count("*").alias("cases"), r6(F.avg(F.col("x") - F.col("y"))).alias("mean_difference"), F.count(F.when(F.col("x") > F.col("y"), 1)).alias("wins"), F.count(F.when(F.col("x") < F.col("y"), 1)).alias("losses"))


DIFFERENCES = CONTRAST + ", d AS (SELECT case_id, x - y AS d FROM c WHERE x IS NOT NULL AND y IS NOT NULL)"
_U = "CAST('0x' || substr(md5(concat_ws('|', {key}, draw, 1)), 1, 13) AS BIGINT) / 4503599627370496.0"
_POISSON = " + ".join(f"CAST(u >= {c} AS INT)" for c in stats.POISSON)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places."""
    return df.select(*(r6(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def bootstrap_sql(key: str, value: str, rows: str, draws: int = 20_000) -> str:
    """SQL of stats.bootstrap_mean over a relation."""
    return f", bw AS (SELECT draw, v, {_POISSON} AS w FROM (SELECT draw, {value} AS v, {_U.format(key=key)} AS u FROM {rows} CROSS JOIN (SELECT unnest(range(0, {draws})) AS draw))), bm AS (SELECT sum(w * v) / nullif(sum(w), 0) AS m FROM bw GROUP BY draw) SELECT (SELECT count({value}) FROM {rows}) AS n, (SELECT round(avg({value}), 6) FROM {rows}) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN m > 1e-12 THEN 1.0 WHEN m >= -1e-12 THEN 0.5 ELSE 0.0 END), 6) AS positive FROM bm WHERE m IS NOT NULL"


@query(DIFFERENCES + bootstrap_sql("case_id", "d", "d"))
def st_paired_bootstrap(t: Trace) -> DataFrame:
    return rounded(stats.bootstrap_mean(_contrast(t).select("case_id", (F.col("x") - F.col("y")).alias("d")), "d", key="case_id"))


PERMUTED = SIGNATURE + ", pd AS (SELECT execution_id, CAST(n_facts AS DOUBLE) AS x, topology = 'chain' AS g FROM sgn JOIN db USING (execution_id) WHERE topology IN ('broadcast', 'chain')), ob AS (SELECT count(CASE WHEN g THEN 1 END) AS k, avg(CASE WHEN g THEN x END) - avg(CASE WHEN NOT g THEN x END) AS difference FROM pd), rk2 AS (SELECT draw, x, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', execution_id, draw, 1))) AS r FROM pd CROSS JOIN (SELECT unnest(range(0, 1000)) AS draw)), dm AS (SELECT draw, avg(CASE WHEN r <= k THEN x END) - avg(CASE WHEN r > k THEN x END) AS m FROM rk2 CROSS JOIN ob GROUP BY 1)"


@query(PERMUTED + " SELECT round(difference, 6) AS difference, round((count(CASE WHEN abs(m) >= abs(difference) - 1e-9 THEN 1 END) + 1) / (count(*) + 1.0), 6) AS p FROM dm CROSS JOIN ob GROUP BY difference")
def st_permutation(t: Trace) -> DataFrame:
    d = _signature(t).join(t.debates.where("topology in ('broadcast', 'chain')"), "execution_id").select("execution_id", F.col("n_facts").cast("double").alias("x"), (F.col("topology") == "chain").alias("g"))
    return rounded(stats.permutation(d, "x", "g", key="execution_id"))


@query(USES + ", g AS (SELECT topology, persona, avg(adopted * 1.0 / n) AS x FROM u JOIN db USING (execution_id) GROUP BY 1, 2) SELECT persona, round(max(CASE WHEN topology = 'broadcast' THEN x END) - max(CASE WHEN topology = 'chain' THEN x END), 6) AS gap, round((max(CASE WHEN topology = 'broadcast' THEN x END) - max(CASE WHEN topology = 'chain' THEN x END)) - (SELECT max(CASE WHEN topology = 'broadcast' THEN x END) - max(CASE WHEN topology = 'chain' THEN x END) FROM g WHERE persona = 'neutral'), 6) AS did FROM g WHERE persona IS NOT NULL GROUP BY 1")
def st_did(t: Trace) -> DataFrame:
    """Gap between two topologies for each persona, and its difference from that of the neutral one."""
    u = t.uses.groupBy("execution_id").agg(F.avg((F.col("use") == "adopted").cast("double")).alias("s")).join(t.debates, "execution_id").where("persona is not null")
    of = lambda k: F.avg(F.when(F.col("topology") == k, F.col("s")))
    g = u.groupBy("persona").agg((of("broadcast") - of("chain")).alias("g"))
    return g.join(F.broadcast(g.where("persona = 'neutral'").agg(F.max("g").alias("base"))), F.lit(True), "left").select("persona", r6("g").alias("gap"), r6(F.col("g") - F.col("base")).alias("did"))


@query(", q AS (SELECT topology, count(DISTINCT fact_id) AS x FROM said JOIN db USING (execution_id) GROUP BY execution_id, topology), w AS (SELECT topology, count(*) AS n, avg(x) AS mu FROM q GROUP BY 1), a AS (SELECT avg(x) AS mu, var_pop(x) * count(*) AS sst FROM q) SELECT round(sum(w.n * power(w.mu - a.mu, 2)) / nullif(max(a.sst), 0), 6) AS eta2 FROM w CROSS JOIN a")
def eta_squared(t: Trace) -> DataFrame:
    q = t.said.join(t.debates, "execution_id").groupBy("execution_id", "topology").agg(F.countDistinct("fact_id").alias("x"))
    return stats.eta_squared(q, "x", "topology")


LABELS = ", lb AS (SELECT e.execution_id, coalesce(e.v.stance, 'none') AS stance, count(*) AS n FROM (SELECT execution_id, unnest(ev) AS v FROM (SELECT DISTINCT execution_id, evidence AS ev FROM debates)) e GROUP BY 1, 2), lt AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY execution_id) AS p FROM lb)"


def _stances(t: Trace) -> DataFrame:
    e = t.raw("debates").select("execution_id", "evidence").distinct().select("execution_id", F.explode("evidence").alias("v"))
    n = e.groupBy("execution_id", F.coalesce("v.stance", F.lit("none")).alias("stance")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("execution_id")))


@query(LABELS + " SELECT execution_id, round(-sum(p * ln(p)) / ln(3), 6) AS entropy, round(exp(-sum(p * ln(p))), 6) AS effective FROM lt GROUP BY 1")
def stance_diversity(t: Trace) -> DataFrame:
    h = -F.sum(F.col("p") * F.log("p"))
    return _stances(t).groupBy("execution_id").agg(r6(h / F.log(F.lit(3.0))).alias("entropy"), r6(F.exp(h)).alias("effective"))


@query(LABELS + ", c AS (SELECT execution_id, sum(CASE WHEN stance = 'pro' THEN n ELSE 0 END) AS a, sum(CASE WHEN stance = 'con' THEN n ELSE 0 END) AS b FROM lt GROUP BY 1) SELECT execution_id, round(CAST(a - b AS DOUBLE) / nullif(a + b, 0), 6) AS lean, round(1 - abs(CAST(a - b AS DOUBLE)) / nullif(a + b, 0), 6) AS balance FROM c")
def citation_lean(t: Trace) -> DataFrame:
    of = lambda k: F.sum(F.when(F.col("stance") == k, F.col("n")).otherwise(0))
    c = _stances(t).groupBy("execution_id").agg(of("pro").alias("a"), of("con").alias("b"))
    lean = F.try_divide((F.col("a") - F.col("b")).cast("double"), F.col("a") + F.col("b"))
    return c.select("execution_id", r6(lean).alias("lean"), r6(1 - F.abs(lean)).alias("balance"))


MIX = ", mx AS (SELECT execution_id, agent_id, use, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY execution_id, agent_id) AS p FROM us GROUP BY 1, 2, 3), ks AS (SELECT unnest(['held', 'adopted', 'novel']) AS use), gx AS (SELECT a.execution_id, a.agent_id, ks.use, coalesce(mx.p, 0) AS p FROM (SELECT DISTINCT execution_id, agent_id FROM mx) a CROSS JOIN ks LEFT JOIN mx ON mx.execution_id = a.execution_id AND mx.agent_id = a.agent_id AND mx.use = ks.use), pp AS (SELECT x.execution_id, x.agent_id AS a, y.agent_id AS b, x.p AS p, y.p AS q FROM gx x JOIN gx y ON x.execution_id = y.execution_id AND x.use = y.use AND x.agent_id < y.agent_id)"


def _mixes(t: Trace) -> DataFrame:
    n = t.uses.groupBy("execution_id", "agent_id").pivot("use", ["held", "adopted", "novel"]).count().na.fill(0)
    total = F.col("held") + F.col("adopted") + F.col("novel")
    p = n.select("execution_id", "agent_id", F.array(*(F.col(c) / total for c in ("held", "adopted", "novel"))).alias("p"))
    x, y = p.select("execution_id", F.col("agent_id").alias("a"), "p"), p.select("execution_id", F.col("agent_id").alias("b"), F.col("p").alias("q"))
    return x.join(y, "execution_id").where("a < b")


@query(MIX + " SELECT execution_id, a, b, round(sum(abs(p - q)) / 2, 6) AS tv, round(sum(abs(p - q)), 6) AS l1 FROM pp GROUP BY 1, 2, 3")
def ig_profile_tv(t: Trace) -> DataFrame:
    l1 = stats.l1("p", "q")
    return _mixes(t).select("execution_id", "a", "b", r6(l1 / 2).alias("tv"), r6(l1).alias("l1"))


@query(MIX + ", js AS (SELECT execution_id, a, b, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d FROM pp GROUP BY 1, 2, 3) SELECT execution_id, a, b, round(d, 6) AS js FROM js")
def ml_js_divergence(t: Trace) -> DataFrame:
    return _mixes(t).select("execution_id", "a", "b", r6(stats.jensen_shannon("p", "q")).alias("js"))


@query(DIFFERENCES + f", n AS (SELECT count(*) AS n, coalesce(sum(d), 0) AS total FROM d), nb AS (SELECT *, row_number() OVER (ORDER BY case_id) - 1 AS bit FROM d), fs AS (SELECT draw, sum(CASE WHEN n <= 16 THEN CASE WHEN (draw >> bit) & 1 = 1 THEN d ELSE -d END ELSE CASE WHEN {_U.format(key='case_id')} < 0.5 THEN d ELSE -d END END) AS s FROM nb CROSS JOIN n CROSS JOIN (SELECT unnest(range(0, 65536)) AS draw) WHERE draw < CASE WHEN n <= 16 THEN 1 << n ELSE 20000 END GROUP BY 1) SELECT n, round(total / nullif(n, 0), 6) AS observed, round(avg(CAST(abs(s) >= abs(total) - 1e-9 AS DOUBLE)), 6) AS p FROM fs CROSS JOIN n GROUP BY n, total")
def st_signflip_exact(t: Trace) -> DataFrame:
    return rounded(stats.signflip(_contrast(t).select("case_id", (F.col("x") - F.col("y")).alias("d")), "d", key="case_id"))
