"""Answers read from texts, audits of facts, clocks, chains, and reports over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tracemill.functions import text as T
from tracemill.operators import matching, pipeline, stats
from tracemill.operators.base import Trace
from tracemill.plans.census import TOPICS
from tracemill.plans.matchers import bootstrap_sql, rounded
from tracemill.plans.lifecycle import TOKENS, USES, _tokens, r6
from tracemill.plans.registry import fact_id_sql, query, tokens_sql
from tracemill.plans.restated import SCREEN, _count, _screened
from tracemill.plans.topics import OFFERS, _offers, _topic
from tracemill.runtime import Scratch

# --- answers in texts -------------------------------------------------------------------------------

#: Texts of the forms that the parsers read, beside those of the documents.
FORMS = ["Reasoning.\nFINAL ANSWER: (c)", "final answer: B\nFinal Answer: d", "FINAL ANSWER: none of these\n", "VERDICT: SUPPORT", "Verdict：Leans to undermine\nverdict: uncertain", "E1 and E3 agree; E1 is newer, E10 is not evidence.", "No marker.\nLast line", " \n "]
_FORM_ROWS = ", ".join(f"({-n}, '{x}')" for n, x in enumerate(FORMS, 1))
_ANSWERS = f"WITH tx AS (SELECT doc_id AS id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL) UNION ALL SELECT * FROM (VALUES {_FORM_ROWS}) v(id, text)) "


def _answered(t: Trace) -> DataFrame:
    d = t.raw("documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), "text").distinct()
    return d.unionByName(t.spark.createDataFrame([(-n, x) for n, x in enumerate(FORMS, 1)], "id long, text string"))


@query(_ANSWERS + r"SELECT id, upper(list_last(regexp_extract_all(text, '(?i)FINAL ANSWER:\s*\(?([A-J])\)?', 1))) AS letter FROM tx WHERE regexp_matches(text, '(?i)FINAL ANSWER:\s*\(?([A-J])\)?')", base=False)
def extract_letter(t: Trace) -> DataFrame:
    """The last answer letter of a text, texts without one left out."""
    d = _answered(t).withColumn("letter", T.answer_letter(F.col("text")))
    return d.where("letter <> ''").select("id", "letter")


@query(_ANSWERS + r", ln AS (SELECT id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '') AS l FROM tx WHERE text IS NOT NULL), mk AS (SELECT id, l, list_last(list_filter(l, lambda x: starts_with(upper(x), 'FINAL ANSWER:'))) AS m FROM ln) SELECT id, CASE WHEN m IS NOT NULL THEN trim(substr(m, 14), E' \t') WHEN len(l) > 0 THEN substr(list_last(l), 1, 120) ELSE '' END AS final FROM mk", base=False)
def extract_final(t: Trace) -> DataFrame:
    """What follows the marker in the last line that begins with it, else the last line, of which 120 characters count."""
    return _answered(t).where("text is not null").select("id", T.last_line(F.col("text"), "FINAL ANSWER:").alias("final"))


@query(_ANSWERS + r"SELECT id, upper(trim(regexp_extract(text, '(?i)VERDICT\s*[:：]\s*([A-Za-z_ ]+)', 1))) AS verdict FROM tx WHERE regexp_matches(text, '(?i)VERDICT\s*[:：]\s*([A-Za-z_ ]+)')", base=False)
def extract_verdict(t: Trace) -> DataFrame:
    d = _answered(t).withColumn("verdict", T.verdict(F.col("text")))
    return d.where("verdict <> ''").select("id", "verdict")


@query(_ANSWERS + r", c AS (SELECT id, unnest(regexp_extract_all(text, '\bE[1-9]\b')) AS evidence FROM tx) SELECT id, evidence, count(*) AS citations FROM c GROUP BY 1, 2", base=False)
def evidence_citations(t: Trace) -> DataFrame:
    c = _answered(t).select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\bE[1-9]\b"), F.lit(0))).alias("evidence"))
    return c.groupBy("id", "evidence").agg(F.count("*").alias("citations"))


# --- audit ------------------------------------------------------------------------------------------

FACTS = "WITH fc AS (SELECT fact_id, min(canonical_text) AS text FROM facts WHERE fact_id IS NOT NULL AND canonical_text IS NOT NULL GROUP BY 1)"


def _facts(t: Trace) -> DataFrame:
    return t.raw("facts").where("fact_id is not null and canonical_text is not null").groupBy("fact_id").agg(F.min("canonical_text").alias("canonical_text"))


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _low_names(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{T.PROPER}', 1), lambda s: lower(s))"


#: Names that two texts share, the longest first, each behind six digits that order them.
def _shared(x: str, y: str) -> str:
    return f"list_sort(list_transform(list_distinct(list_intersect({_low_names(x)}, {_low_names(y)})), lambda s: lpad(CAST(100000 - length(s) AS VARCHAR), 6, '0') || s))"


def _without(names: str, x: str) -> str:
    return f"list_reduce({names}, lambda s, n: replace(s, substr(n, 7), ' '), {x})"


_CONTENT = "list_sort(list_filter(w, lambda x: length(x) > 3 AND NOT list_contains([" + ", ".join(f"'{x}'" for x in pipeline.FUNCTION_WORDS) + "], x)))"
AUDIT = f"""{FACTS},
pl AS (SELECT fact_id, text, list_reduce(regexp_extract_all(text, '{T.PROPER}', 1), lambda s, n: replace(s, n, ' '), text) AS plain FROM fc),
tx AS (SELECT 'high' AS severity, 'quantified-aggregate' AS kind, fact_id FROM pl WHERE regexp_matches(text, '{_q(T.QUANTIFIED)}')
UNION ALL SELECT 'high', 'unresolved-referent', fact_id FROM pl WHERE regexp_matches(text, '{_q(T.UNRESOLVED)}') AND NOT regexp_matches(text, '{_q(T.RESOLVED_INLINE)}') AND NOT regexp_matches(text, '{_q(T.QUANTIFIED)}')
UNION ALL SELECT 'medium', 'unsplit-conjunction', fact_id FROM pl WHERE regexp_matches(plain, '{_q(T.CONJUNCTION)}') UNION ALL SELECT 'medium', 'source-meta', fact_id FROM pl WHERE regexp_matches(text, '{_q(T.SOURCE_META)}')),
mf AS (SELECT mention_id, min(fact_id) AS fact_id FROM (SELECT unnest(mention_ids) AS mention_id, fact_id FROM facts) GROUP BY 1),
mw AS (SELECT DISTINCT fact_id, {tokens_sql('text')} AS w FROM mf JOIN (SELECT DISTINCT mention_id, text FROM mentions) USING (mention_id)),
sm AS (SELECT x.fact_id FROM mw x JOIN mw y ON x.fact_id = y.fact_id AND x.w <> y.w GROUP BY 1 HAVING min(len(list_intersect(x.w, y.w)) * 1.0 / nullif(least(len(x.w), len(y.w)), 0)) < 0.34),
fw AS (SELECT * FROM (SELECT fact_id, text, {tokens_sql('text')} AS w FROM fc) WHERE len(w) > 0), f1 AS (SELECT *, min(fact_id) OVER (PARTITION BY w) AS first FROM fw),
ky AS (SELECT fact_id, text, {_CONTENT} AS k FROM f1 WHERE fact_id = first),
mt AS (SELECT x.fact_id, y.fact_id AS partner_id, {_shared('x.text', 'y.text')} AS names, lower(x.text) AS tx, lower(y.text) AS ty FROM ky x JOIN ky y ON x.k = y.k AND x.fact_id < y.fact_id),
rs AS (SELECT fact_id, partner_id, {tokens_sql(_without('names', 'tx'))} AS x, {tokens_sql(_without('names', 'ty'))} AS y FROM mt),
mm AS (SELECT fact_id, partner_id FROM rs WHERE len(x) > 0 AND len(y) > 0 AND greatest(len(list_intersect(x, y)) * 1.0 / (len(x) + len(y) - len(list_intersect(x, y))), len(list_intersect(x, y)) * 1.0 / least(len(x), len(y))) >= 0.82 UNION ALL SELECT fact_id, first FROM f1 WHERE fact_id <> first),
au AS (SELECT *, CAST(NULL AS VARCHAR) AS partner_id FROM tx UNION ALL SELECT 'high', 'suspect-merge', fact_id, NULL FROM sm UNION ALL SELECT 'medium', 'possible-missed-merge', fact_id, partner_id FROM mm)"""


@query(AUDIT + " SELECT severity, kind, fact_id, partner_id FROM au", base=False)
def u_audit(t: Trace) -> DataFrame:
    """All six kinds of flags, the severe first."""
    return pipeline.audit(_facts(t), t.bridge, t.texts("text"))


@query(AUDIT + " SELECT kind, count(*) AS flags FROM au GROUP BY 1", base=False)
def u_audit_summary(t: Trace) -> DataFrame:
    return u_audit(t).groupBy("kind").agg(F.count("*").alias("flags"))


@query(FACTS + f" SELECT fact_id FROM fc WHERE regexp_matches(text, '{T.FORBIDDEN_OPENERS}')", base=False)
def rx_forbidden_openers(t: Trace) -> DataFrame:
    return _facts(t).where(F.col("canonical_text").rlike(T.FORBIDDEN_OPENERS)).select("fact_id")


@query(FACTS + f" SELECT fact_id, array_to_string(regexp_extract_all(text, '{T.PROPER}', 1), '|') AS spans FROM fc", base=False)
def proper_spans(t: Trace) -> DataFrame:
    """Runs of two capitalised words or more, small words between them allowed."""
    return _facts(t).select("fact_id", F.array_join(T.proper_spans(F.col("canonical_text")), "|").alias("spans"))


@query(f", nt AS (SELECT jd.a, jd.b, lower(x.text) AS ta, lower(y.text) AS tb, {_shared('x.text', 'y.text')} AS names FROM (SELECT DISTINCT a, b FROM jd) jd JOIN m x ON x.mention_id = jd.a JOIN m y ON y.mention_id = jd.b) SELECT a, b, {_without('names', 'ta')} AS rest_a, {_without('names', 'tb')} AS rest_b FROM nt")
def strip_shared_names(t: Trace) -> DataFrame:
    """Both texts of each judged pair, lower-cased, without the names that both hold, longest first."""
    of = lambda x: t.texts("text").select(F.col("mention_id").alias(x), F.col("text").alias(f"t{x}"))
    j = t.judged.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    x, y = T.without_shared_names(F.col("ta"), F.col("tb"))
    return j.select("a", "b", x.alias("rest_a"), y.alias("rest_b"))


@query(f", fo AS (SELECT execution_id, fact_id, min(text) AS text FROM m WHERE channel = 'output' GROUP BY 1, 2), w AS (SELECT execution_id, fact_id, {tokens_sql('text')} AS w FROM fo) SELECT x.execution_id, x.fact_id AS small, y.fact_id AS large FROM w x JOIN w y ON x.execution_id = y.execution_id AND len(x.w) >= 2 AND len(x.w) < len(y.w) AND list_has_all(y.w, x.w)")
def granularity_siblings(t: Trace) -> DataFrame:
    """Two facts of a run's outputs, the words of one a strict part, two at least, of the other's."""
    w = _output_texts(t).select("execution_id", "fact_id", T.tokenize(F.col("text")).alias("w"))
    return matching.strict_subsets(w)


def _output_texts(t: Trace) -> DataFrame:
    return t.worded("text").where("channel = 'output'").groupBy("execution_id", "fact_id").agg(F.min("text").alias("text"))


@query(f", fo AS (SELECT execution_id, fact_id, min(text) AS text FROM m WHERE channel = 'output' GROUP BY 1, 2), w AS (SELECT execution_id, fact_id, {tokens_sql('text')} AS w FROM fo), p AS (SELECT x.execution_id, x.fact_id AS a, y.fact_id AS b, len(list_intersect(x.w, y.w)) AS n, len(x.w) AS na, len(y.w) AS nb FROM w x JOIN w y ON x.execution_id = y.execution_id AND x.fact_id < y.fact_id AND least(len(x.w), len(y.w)) >= 0.85 * greatest(len(x.w), len(y.w)) - 1e-9) SELECT execution_id, a, b, round(n * 1.0 / (na + nb - n), 6) AS similarity FROM p WHERE n * 1.0 / (na + nb - n) >= 0.85 - 1e-9")
def undermerge_probe(t: Trace) -> DataFrame:
    """Facts of one run's outputs that stayed apart though their token sets are alike by 0.85 or more (in place of sentence vectors)."""
    f = _output_texts(t).withColumnRenamed("fact_id", "mention_id")
    return matching.similar_token_sets(f, 0.85).withColumnRenamed("jaccard", "similarity").withColumn("similarity", r6("similarity"))


@query(", l AS (SELECT least(a, b) AS a, greatest(a, b) AS b, label FROM jd GROUP BY 1, 2, 3) SELECT x.label AS label, y.label AS other, count(*) AS pairs FROM l x JOIN l y ON x.a = y.a AND x.b = y.b GROUP BY 1, 2")
def mast_label_stats(t: Trace) -> DataFrame:
    """Pairs of mentions by label, and how often two labels were given to one pair."""
    j = t.judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label").distinct()
    return j.join(j.withColumnRenamed("label", "other"), ["a", "b"]).groupBy("label", "other").agg(F.count("*").alias("pairs"))


@query(", x AS (SELECT DISTINCT case_id, channel, text, min(mention_id) OVER (PARTITION BY case_id, channel, text) AS uid, mention_id, fact_id FROM m JOIN db USING (execution_id))" + TOPICS + " SELECT mention_id, uid, coalesce(topic, 'U') AS label, CASE WHEN topic IS NULL THEN 'missing' ELSE 'labelled' END AS status FROM x LEFT JOIN tp USING (fact_id)")
def label_manifest(t: Trace) -> DataFrame:
    """Equal texts of a case and channel are labelled once; every mention gets its label back, U where there is none."""
    m = t.worded("text").join(t.debates.select("execution_id", "case_id"), "execution_id").select("case_id", "channel", "text", "mention_id", "fact_id").distinct()
    m = m.withColumn("uid", F.min("mention_id").over(W.partitionBy("case_id", "channel", "text")))
    label = F.when(F.col("topic") == "unlabelled", "U").otherwise(F.col("topic"))
    return _topic(t, m).select("mention_id", "uid", label.alias("label"), F.when(F.col("topic") == "unlabelled", "missing").otherwise("labelled").alias("status"))


@query("WITH r AS (SELECT ord, fact_id, properties FROM facts), d AS (SELECT ord, count(*) AS n FROM r GROUP BY 1) SELECT 'duplicate_ord' AS problem, count(CASE WHEN n > 1 THEN 1 END) AS rows FROM d UNION ALL SELECT 'null_fact_id', count(CASE WHEN fact_id IS NULL THEN 1 END) FROM r UNION ALL SELECT 'no_properties', count(CASE WHEN properties IS NULL THEN 1 END) FROM r UNION ALL SELECT 'salience_out_of_range', count(CASE WHEN NOT coalesce(TRY_CAST(properties['salience'] AS DOUBLE) BETWEEN 0 AND 1, true) THEN 1 END) FROM r UNION ALL SELECT 'no_topic', count(CASE WHEN properties IS NOT NULL AND properties['topic'] IS NULL THEN 1 END) FROM r", base=False)
def label_validate(t: Trace) -> DataFrame:
    """Rows that break a rule of the labels: repeated keys, missing ids, missing or impossible values."""
    r = t.raw("facts")
    salience = F.col("properties")["salience"].try_cast("double")
    checks = {"null_fact_id": F.col("fact_id").isNull(), "no_properties": F.col("properties").isNull(), "salience_out_of_range": ~F.coalesce(salience.between(0, 1), F.lit(True)), "no_topic": F.col("properties").isNotNull() & F.col("properties")["topic"].isNull()}
    one = r.agg(*(_count(c).alias(k) for k, c in checks.items()))
    parts = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("problem"), F.col(k).alias("rows")) for k in checks))).alias("p")).select("p.*")
    return parts.unionByName(r.groupBy("ord").agg(F.count("*").alias("n")).agg(_count("n > 1").alias("rows")).select(F.lit("duplicate_ord").alias("problem"), "rows"))


# --- orderings --------------------------------------------------------------------------------------


@query(", p AS (SELECT a, b, max(confidence) AS confidence FROM jd GROUP BY 1, 2) SELECT a, b, confidence, row_number() OVER (ORDER BY confidence DESC, a, b) AS place FROM p QUALIFY place <= 100")
def s_pairs_desc(t: Trace) -> DataFrame:
    """The hundred most certain pairs, in order: each task keeps its own hundred first."""
    p = t.judged.groupBy("a", "b").agg(F.max("confidence").alias("confidence")).orderBy(F.desc("confidence"), "a", "b").limit(100)
    return p.withColumn("place", F.row_number().over(W.orderBy(F.desc("confidence"), "a", "b")))


@query(", n AS (SELECT execution_id, fact_id, count(*) AS n, min(CASE channel WHEN 'source' THEN 0 WHEN 'context' THEN 1 ELSE 2 END) AS origin FROM m WHERE execution_id IS NOT NULL GROUP BY 1, 2) SELECT execution_id, fact_id, n, origin, row_number() OVER (PARTITION BY execution_id ORDER BY origin, n DESC, fact_id) AS place FROM n QUALIFY place <= 50")
def s_facts_view(t: Trace) -> DataFrame:
    """The first fifty facts of each run as a viewer lists them: sources first, then the most frequent."""
    origin = F.min(F.when(F.col("channel") == "source", 0).when(F.col("channel") == "context", 1).otherwise(2))
    n = t.mentions.where("execution_id is not null").groupBy("execution_id", "fact_id").agg(F.count("*").alias("n"), origin.alias("origin"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("execution_id").orderBy("origin", F.desc("n"), "fact_id"))).where("place <= 50")


@query(", e AS (SELECT DISTINCT ea AS execution_id, a, b FROM lf WHERE ea = eb) SELECT execution_id, arg_min(a, md5('7|' || a || '|' || b)) AS a, arg_min(b, md5('7|' || a || '|' || b)) AS b FROM e GROUP BY 1")
def s_audit_sample(t: Trace) -> DataFrame:
    """One pair of each run for review, drawn by a hash of a seed and the pair."""
    e = t.lifted.where("ea = eb").select(F.col("ea").alias("execution_id"), "a", "b").distinct()
    key = F.md5(F.concat(F.lit("7|"), "a", F.lit("|"), "b"))
    return e.groupBy("execution_id").agg(F.min(F.struct(key.alias("k"), "a", "b")).alias("x")).select("execution_id", "x.a", "x.b")


# --- clocks -----------------------------------------------------------------------------------------

CLOCK = TOKENS + ", ck AS (SELECT execution_id, agent_id, round, min(e) AS tokens FROM (SELECT execution_id, agent_id, round, sum(n) OVER (PARTITION BY execution_id ORDER BY round, agent_id, record_no) AS e FROM tk) GROUP BY 1, 2, 3), fc AS (SELECT execution_id, fact_id, min({'t': tokens, 'r': round, 'g': agent_id}) AS f, max(tokens) AS last FROM said JOIN ck USING (execution_id, agent_id, round) GROUP BY 1, 2)"


def _clock(t: Trace) -> DataFrame:
    """Words said in the run by the end of each agent's turn."""
    w = W.partitionBy("execution_id").orderBy("round", "agent_id", "record_no").rowsBetween(W.unboundedPreceding, 0)
    c = _tokens(t).withColumn("e", F.sum("n").over(w))
    return c.groupBy("execution_id", "agent_id", "round").agg(F.min("e").alias("tokens"))


def _first_clock(t: Trace) -> DataFrame:
    s = t.said.join(_clock(t), ["execution_id", "agent_id", "round"])
    return s.groupBy("execution_id", "fact_id").agg(F.min(F.struct(F.col("tokens").alias("t"), F.col("round").alias("r"), F.col("agent_id").alias("g"))).alias("f"), F.max("tokens").alias("last"))


@query(CLOCK + " SELECT execution_id, fact_id, CAST(f.t AS BIGINT) AS tokens, f.r AS round, f.g AS agent_id FROM fc")
def w_first_clock(t: Trace) -> DataFrame:
    """Where a fact was first said: the run's words by then, the round, the agent."""
    return _first_clock(t).select("execution_id", "fact_id", F.col("f.t").alias("tokens"), F.col("f.r").alias("round"), F.col("f.g").alias("agent_id"))


@query(CLOCK + " SELECT execution_id, fact_id, CAST(f.t AS BIGINT) AS birth, CAST(last AS BIGINT) AS last, CAST(last - f.t AS BIGINT) AS span FROM fc")
def fate_clock(t: Trace) -> DataFrame:
    """Birth, last saying and span of each fact on the clock of words."""
    return _first_clock(t).select("execution_id", "fact_id", F.col("f.t").alias("birth"), "last", (F.col("last") - F.col("f.t")).alias("span"))


BUDGETS = (500, 1000, 1500, 2000, 2500)


@query(CLOCK + ", g AS (SELECT unnest([500, 1000, 1500, 2000, 2500]) AS budget) SELECT execution_id, budget, count(CASE WHEN f.t <= budget THEN 1 END) AS facts, CAST(max(f.t) AS BIGINT) AS total FROM fc CROSS JOIN g GROUP BY 1, 2")
def es_production_clock(t: Trace) -> DataFrame:
    """Facts produced by the time so many words were said."""
    f = _first_clock(t).select("execution_id", F.col("f.t").alias("t"), F.explode(F.array(*map(F.lit, BUDGETS))).alias("budget"))
    return f.groupBy("execution_id", "budget").agg(_count("t <= budget").alias("facts"), F.max("t").alias("total"))


GRID = (50, 100, 200, 400)


@query(CLOCK + ", fu AS (SELECT execution_id FROM ck GROUP BY 1 HAVING max(tokens) >= 400), g AS (SELECT unnest([50, 100, 200, 400]) AS budget), c AS (SELECT topology, execution_id, budget, count(CASE WHEN f.t <= budget THEN 1 END) AS facts FROM fc JOIN fu USING (execution_id) JOIN db USING (execution_id) CROSS JOIN g GROUP BY 1, 2, 3) SELECT topology, budget, count(*) AS runs, round(avg(facts), 6) AS facts FROM c GROUP BY 1, 2 HAVING count(*) >= 3")
def fixed_set_curve(t: Trace) -> DataFrame:
    """Mean facts by words said, over the same runs at every point: those that span the whole grid, three at least."""
    whole = _clock(t).groupBy("execution_id").agg(F.max("tokens").alias("m")).where(F.col("m") >= max(GRID)).select("execution_id")
    f = _first_clock(t).join(whole, "execution_id").join(t.debates, "execution_id").select("topology", "execution_id", F.col("f.t").alias("t"), F.explode(F.array(*map(F.lit, GRID))).alias("budget"))
    c = f.groupBy("topology", "execution_id", "budget").agg(_count("t <= budget").alias("facts"))
    return c.groupBy("topology", "budget").agg(F.count("*").alias("runs"), r6(F.avg("facts")).alias("facts")).where("runs >= 3")


@query(TOKENS + ", tt AS (SELECT execution_id, agent_id, round, sum(n) OVER (PARTITION BY execution_id ORDER BY round, agent_id, record_no) AS e FROM tk), ck AS (SELECT execution_id, agent_id, round, min(e) AS tokens FROM tt GROUP BY 1, 2, 3), x AS (SELECT execution_id, tokens, count(*) AS said, count(CASE WHEN use = 'adopted' THEN 1 END) AS adopted FROM us JOIN ck USING (execution_id, agent_id, round) GROUP BY 1, 2) SELECT execution_id, CAST(tokens AS BIGINT) AS tokens, round(CAST(sum(adopted) OVER w AS DOUBLE) / sum(said) OVER w, 6) AS adopted_share FROM x WINDOW w AS (PARTITION BY execution_id ORDER BY tokens)")
def uptake_trajectory(t: Trace) -> DataFrame:
    """Share of adopted facts in all that was said by then, on the clock of words."""
    x = t.uses.join(_clock(t), ["execution_id", "agent_id", "round"]).groupBy("execution_id", "tokens").agg(F.count("*").alias("said"), _count("use = 'adopted'").alias("adopted"))
    w = W.partitionBy("execution_id").orderBy("tokens")
    return x.select("execution_id", "tokens", r6(F.sum("adopted").over(w).cast("double") / F.sum("said").over(w)).alias("adopted_share"))


# --- runs and cells ---------------------------------------------------------------------------------


@query(SCREEN + ", w AS (SELECT execution_id, round, speaker, listener, count(DISTINCT late_fact) AS n FROM sc WHERE NOT prior GROUP BY 1, 2, 3, 4), g AS (SELECT execution_id, agent_id, round FROM said GROUP BY 1, 2, 3), o AS (SELECT execution_id, round, speaker AS agent_id, sum(n) AS n FROM w GROUP BY 1, 2, 3), i AS (SELECT execution_id, round, listener AS agent_id, sum(n) AS n FROM w GROUP BY 1, 2, 3) SELECT execution_id, agent_id, round, CAST(coalesce(o.n, 0) AS BIGINT) AS outgoing, CAST(coalesce(i.n, 0) AS BIGINT) AS incoming, CAST(coalesce(o.n, 0) - coalesce(i.n, 0) AS BIGINT) AS balance FROM g LEFT JOIN o USING (execution_id, agent_id, round) LEFT JOIN i USING (execution_id, agent_id, round)")
def agent_balance(t: Trace) -> DataFrame:
    """What peers took up from an agent in each round, less what it took up from them, screened by what they had said before."""
    w = _screened(t).where("not prior").groupBy("execution_id", "round", "speaker", "listener").agg(F.countDistinct("late_fact").alias("n"))
    key = ["execution_id", "agent_id", "round"]
    side = lambda who, name: w.groupBy("execution_id", F.col(who).alias("agent_id"), "round").agg(F.sum("n").alias(name))
    g = t.said.select(*key).distinct().join(side("speaker", "outgoing"), key, "left").join(side("listener", "incoming"), key, "left").na.fill(0, ["outgoing", "incoming"])
    return g.withColumn("balance", F.col("outgoing") - F.col("incoming"))


@query(", d AS (SELECT topology, execution_id, correct, row_number() OVER (PARTITION BY topology, correct ORDER BY execution_id) AS i FROM db WHERE correct IS NOT NULL), n AS (SELECT topology, count(*) AS failures FROM d WHERE NOT correct GROUP BY 1) SELECT topology, execution_id, CASE WHEN correct THEN 'control' ELSE 'failure' END AS kind FROM d JOIN n USING (topology) WHERE NOT correct OR i <= failures")
def screen_hard_subset(t: Trace) -> DataFrame:
    """Runs that failed, and as many of the same topology that did not."""
    d = t.debates.where("correct is not null").withColumn("i", F.row_number().over(W.partitionBy("topology", "correct").orderBy("execution_id")))
    n = d.where("not correct").groupBy("topology").agg(F.count("*").alias("failures"))
    return d.join(F.broadcast(n), "topology").where("not correct or i <= failures").select("topology", "execution_id", F.when(F.col("correct"), "control").otherwise("failure").alias("kind"))  # a row a topology


@query(", f AS (SELECT execution_id, count(DISTINCT fact_id) AS facts FROM said GROUP BY 1), src AS (SELECT DISTINCT execution_id, fact_id FROM m WHERE channel = 'source'), k AS (SELECT src.execution_id, count(*) AS given, count(s.fact_id) AS kept FROM src LEFT JOIN (SELECT DISTINCT execution_id, fact_id FROM said) s USING (execution_id, fact_id) GROUP BY 1), nv AS (SELECT s.execution_id, count(*) AS novel FROM (SELECT DISTINCT execution_id, fact_id FROM said) s LEFT JOIN src USING (execution_id, fact_id) WHERE src.fact_id IS NULL GROUP BY 1), en AS (SELECT ea AS execution_id, count(*) AS entailed FROM lf WHERE ea = eb AND label IN ('A_ENTAILS_B', 'B_ENTAILS_A') GROUP BY 1) SELECT model, topology, panel, memory, count(*) AS runs, round(avg(facts), 6) AS facts, round(CAST(sum(kept) AS DOUBLE) / nullif(sum(given), 0), 6) AS source_kept, round(avg(coalesce(novel, 0)), 6) AS novel, round(avg(coalesce(entailed, 0)), 6) AS entailed FROM f JOIN db USING (execution_id) LEFT JOIN k USING (execution_id) LEFT JOIN nv USING (execution_id) LEFT JOIN en USING (execution_id) GROUP BY 1, 2, 3, 4".replace("count(s.fact_id) AS kept", "count(hit) AS kept").replace("LEFT JOIN (SELECT DISTINCT execution_id, fact_id FROM said) s USING", "LEFT JOIN (SELECT DISTINCT execution_id, fact_id, 1 AS hit FROM said) s USING").replace("LEFT JOIN src USING (execution_id, fact_id) WHERE src.fact_id IS NULL", "ANTI JOIN src USING (execution_id, fact_id)"))
def flow_compare(t: Trace) -> DataFrame:
    """Each configuration: facts a run, the pooled share of source facts that were said, facts of no source, entailed pairs."""
    said = t.said.select("execution_id", "fact_id").distinct()
    f = said.groupBy("execution_id").agg(F.count("*").alias("facts"))
    k = t.source_facts.join(said.withColumn("hit", F.lit(1)), ["execution_id", "fact_id"], "left").groupBy("execution_id").agg(F.count("*").alias("given"), F.count("hit").alias("kept"))
    nv = said.join(t.source_facts, ["execution_id", "fact_id"], "left_anti").groupBy("execution_id").agg(F.count("*").alias("novel"))
    en = t.lifted.where("ea = eb and label in ('A_ENTAILS_B', 'B_ENTAILS_A')").groupBy(F.col("ea").alias("execution_id")).agg(F.count("*").alias("entailed"))
    x = f.join(t.debates, "execution_id").join(k, "execution_id", "left").join(nv, "execution_id", "left").join(en, "execution_id", "left").na.fill(0, ["novel", "entailed"])
    return x.groupBy("model", "topology", "panel", "memory").agg(F.count("*").alias("runs"), r6(F.avg("facts")).alias("facts"), r6(F.try_divide(F.sum("kept").cast("double"), F.sum("given"))).alias("source_kept"), r6(F.avg("novel")).alias("novel"), r6(F.avg("entailed")).alias("entailed"))


@query(USES + ", x AS (SELECT topology, persona, correct, adopted * 1.0 / n AS v FROM u JOIN db USING (execution_id) WHERE correct IS NOT NULL), c AS (SELECT *, v - avg(v) OVER (PARTITION BY topology, persona) AS adj FROM x) SELECT count(CASE WHEN correct THEN 1 END) AS yes_n, count(CASE WHEN NOT correct THEN 1 END) AS no_n, round(avg(CASE WHEN correct THEN v END), 6) AS yes_mean, round(avg(CASE WHEN NOT correct THEN v END), 6) AS no_mean, round(avg(CASE WHEN correct THEN v END) - avg(CASE WHEN NOT correct THEN v END), 6) AS difference, round(avg(CASE WHEN correct THEN adj END) - avg(CASE WHEN NOT correct THEN adj END), 6) AS adjusted FROM c")
def st_group_diff(t: Trace) -> DataFrame:
    """Adopted share of runs that came out right less that of the others, plain and about the means of their cells."""
    x = t.uses.groupBy("execution_id").agg(F.avg((F.col("use") == "adopted").cast("double")).alias("v")).join(t.debates.where("correct is not null"), "execution_id")
    cell = x.groupBy("topology", "persona").agg(F.avg("v").alias("mu"))
    x = x.join(F.broadcast(cell), x.topology.eqNullSafe(cell.topology) & x.persona.eqNullSafe(cell.persona)).withColumn("adj", F.col("v") - F.col("mu"))  # a row a cell
    yes, no = (lambda c: F.avg(F.when(F.col("correct"), F.col(c)))), (lambda c: F.avg(F.when(~F.col("correct"), F.col(c))))
    return x.agg(_count("correct").alias("yes_n"), _count("not correct").alias("no_n"), r6(yes("v")).alias("yes_mean"), r6(no("v")).alias("no_mean"), r6(yes("v") - no("v")).alias("difference"), r6(yes("adj") - no("adj")).alias("adjusted"))


LIFTS = OFFERS + ", f AS (SELECT case_id, sum(CASE WHEN taken THEN credit ELSE 0 END) AS taken, sum(CASE WHEN taken AND topic <> 'unlabelled' THEN credit ELSE 0 END) AS labelled, sum(credit) AS offered, sum(CASE WHEN topic <> 'unlabelled' THEN credit ELSE 0 END) AS offered_labelled FROM of JOIN db USING (execution_id) GROUP BY 1), lx AS (SELECT case_id, labelled / nullif(taken, 0) / nullif(offered_labelled / nullif(offered, 0), 0) AS lift FROM f), lf2 AS (SELECT case_id, lift, lift - 1 AS d FROM lx WHERE lift IS NOT NULL)"


@query(LIFTS + " SELECT case_id, round(lift, 6) AS lift FROM lf2")
def st_lift(t: Trace) -> DataFrame:
    """For each case, how much likelier labelled facts were taken up than their share of the offers."""
    return _lifts(t).select("case_id", r6("lift").alias("lift"))


def _lifts(t: Trace) -> DataFrame:
    of = lambda c: F.sum(F.when(F.expr(c), F.col("credit")).otherwise(0.0))
    f = _offers(t).join(t.debates, "execution_id").groupBy("case_id").agg(of("taken").alias("taken"), of("taken and topic <> 'unlabelled'").alias("labelled"), of("true").alias("offered"), of("topic <> 'unlabelled'").alias("offered_labelled"))
    lift = F.try_divide(F.try_divide(F.col("labelled"), F.col("taken")), F.try_divide(F.col("offered_labelled"), F.col("offered")))
    return f.select("case_id", lift.alias("lift")).where("lift is not null")


@query(LIFTS + bootstrap_sql("case_id", "d", "lf2"))
def st_lift_ci(t: Trace) -> DataFrame:
    """Mean lift less one over the cases, its interval and the share of draws above zero."""
    return rounded(stats.bootstrap_mean(_lifts(t).select("case_id", (F.col("lift") - 1).alias("d")), "d", key="case_id"))


@query(", e AS (SELECT ea AS execution_id, CASE WHEN label = 'A_ENTAILS_B' THEN fa ELSE fb END AS u, CASE WHEN label = 'A_ENTAILS_B' THEN fb ELSE fa END AS v, CASE WHEN label = 'A_ENTAILS_B' THEN ra ELSE rb END AS p, CASE WHEN label = 'A_ENTAILS_B' THEN rb ELSE ra END AS q FROM lf WHERE ea = eb AND ra > 0 AND rb > 0 AND label IN ('A_ENTAILS_B', 'B_ENTAILS_A')), d AS (SELECT DISTINCT * FROM e WHERE p < q), w AS (SELECT execution_id, v, q, 1 AS n FROM d UNION SELECT d.execution_id, d.v, d.q, w.n + 1 FROM w JOIN d ON d.execution_id = w.execution_id AND d.u = w.v AND d.p >= w.q) SELECT execution_id, max(n) AS longest FROM w GROUP BY 1", recursive=True)
def g_longest_chain(t: Trace) -> DataFrame:
    """The longest run of weakenings from fact to fact through ever later rounds of an execution.

    A step looks at the facts that chains of n edges end at, each with the earliest round in which one does, as what
    goes on from a later end goes on from an earlier one too. Steps end when no chain is longer, after as many as there
    are rounds at most; each is written, so that no plan holds the one before.
    """
    ab = F.col("label") == "A_ENTAILS_B"
    pick = lambda x, y: F.when(ab, F.col(x)).otherwise(F.col(y))
    e = t.lifted.where("ea = eb and ra > 0 and rb > 0 and label in ('A_ENTAILS_B', 'B_ENTAILS_A')")
    d = e.select(F.col("ea").alias("execution_id"), pick("fa", "fb").alias("u"), pick("fb", "fa").alias("v"), pick("ra", "rb").alias("p"), pick("rb", "ra").alias("q")).where("p < q").distinct()
    scratch = Scratch(t.spark, "chains")
    d = scratch.keep(d)
    ends = lambda x, n: scratch.keep(x.groupBy("execution_id", "v").agg(F.min("q").alias("q")).withColumn("n", F.lit(n)))
    steps = [ends(d, 1)]
    while steps[-1].take(1):
        w = steps[-1].select("execution_id", F.col("v").alias("u"), F.col("q").alias("w"))
        steps.append(ends(d.join(w, ["execution_id", "u"]).where("p >= w"), len(steps) + 1))
    found = t.spark.read.schema(steps[0].schema).parquet(*(scratch.paths[id(w)] for w in steps))
    return found.groupBy("execution_id").agg(F.max("n").alias("longest"))


@query()
def g_broker(t: Trace) -> DataFrame:
    """Each agent's weighted betweenness in its run's graph of turns, summed over the rounds; zero below three turns.

    A run's graph has a node a turn, agents by rounds at most, so a run is one small group.
    """
    from tracemill.operators.centrality import brokers

    e = t.transmissions.groupBy("execution_id", "a", "b", "rk").agg(F.count("*").alias("weight"))
    agents = t.agents.join(t.rounds.groupBy("execution_id").agg(F.count("*").alias("rounds")), "execution_id")
    return brokers(e, agents)


@query(", pt AS (SELECT execution_id, agent_id, round, text FROM turns), cx AS (SELECT DISTINCT execution_id, agent_id, round, text FROM tr WHERE channel = 'context' AND agent_id IS NOT NULL AND round > 1), h AS (SELECT cx.execution_id, cx.agent_id, cx.round, bool_or(p.agent_id = cx.agent_id AND contains(cx.text, left(p.text, 80))) AS own, bool_or(p.agent_id <> cx.agent_id AND contains(cx.text, left(p.text, 80))) AS peer FROM cx JOIN pt p ON p.execution_id = cx.execution_id AND p.round = cx.round - 1 AND length(p.text) >= 80 GROUP BY 1, 2, 3) SELECT round, count(*) AS turns, count(CASE WHEN own THEN 1 END) AS own, count(CASE WHEN peer THEN 1 END) AS peer FROM h GROUP BY 1")
def dg_self_history(t: Trace) -> DataFrame:
    """Whether an agent's context held the beginning of its own turn of the round before, and of a peer's."""
    c = t._records("context").where("agent_id is not null and round > 1").select("execution_id", "agent_id", "round", "text").distinct()
    p = t.turns.where(F.length("text") >= 80).select("execution_id", (F.col("round") + 1).alias("round"), F.col("agent_id").alias("speaker"), F.substring("text", 1, 80).alias("head"))
    hit = F.contains("text", "head")
    h = c.join(p, ["execution_id", "round"]).groupBy("execution_id", "agent_id", "round").agg(F.bool_or((F.col("speaker") == F.col("agent_id")) & hit).alias("own"), F.bool_or((F.col("speaker") != F.col("agent_id")) & hit).alias("peer"))
    return h.groupBy("round").agg(F.count("*").alias("turns"), _count("own").alias("own"), _count("peer").alias("peer"))


EVIDENCE = r"(?i)\b(registry|survey|experiment|trial|audit|study|report)\b"
MATERIAL = r"(?i)\b(evidence|material|document|statement|speaker|source)s?\b"


@query(f", fo AS (SELECT fact_id, min(text) AS text FROM m GROUP BY 1), k AS (SELECT fact_id, CASE WHEN regexp_matches(text, '{EVIDENCE}') THEN 'named' WHEN regexp_matches(text, '{MATERIAL}') THEN 'material' ELSE 'world' END AS kind FROM fo) SELECT use, kind, count(*) AS facts FROM us JOIN k USING (fact_id) GROUP BY 1, 2")
def dg_anchor(t: Trace) -> DataFrame:
    """What adopted, held and novel facts speak of: a named study, material in general, or the world."""
    f = t.worded("text").groupBy("fact_id").agg(F.min("text").alias("text"))
    kind = F.when(F.col("text").rlike(EVIDENCE), "named").when(F.col("text").rlike(MATERIAL), "material").otherwise("world")
    return t.uses.join(f.select("fact_id", kind.alias("kind")), "fact_id").groupBy("use", "kind").agg(F.count("*").alias("facts"))
