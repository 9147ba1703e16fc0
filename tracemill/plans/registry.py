"""Queries and their SQL, registered side by side. SQL begins with SELECT, or with ', name AS (...)' after the base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.functions import text as T
from tracemill.operators.base import Trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{T.WHITESPACE}', ' ', 'g'))"


def fact_id_sql(x: str) -> str:
    return f"'f_' || substr(sha1({norm_sql(x)}), 1, 16)"


STEM = "CASE WHEN regexp_matches(t, '[0-9]') THEN t " + " ".join(f"WHEN length(t) > {len(s) + 2} AND ends_with(t, '{s}') THEN left(t, length(t) - {len(s)})" for s in T.SUFFIXES) + " ELSE t END"


def tokens_sql(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(lower({x}), '{T.TOKEN}'), lambda t: {STEM})))"


BASE = f"""WITH mf AS (SELECT mention_id, min(fact_id) AS fact_id FROM (SELECT unnest(mention_ids) AS mention_id, fact_id FROM facts) GROUP BY 1),
m0 AS (SELECT DISTINCT mention_id, text, polarity, quote, qualifiers, execution_id, agent_id, round, channel, doc_id, ord FROM mentions WHERE mention_id IS NOT NULL),
m AS (SELECT m0.*, coalesce(mf.fact_id, {fact_id_sql('m0.text')}) AS fact_id FROM m0 LEFT JOIN mf USING (mention_id)),
tr AS (SELECT DISTINCT record_no, text, provenance.execution_id AS execution_id, provenance.agent_id AS agent_id, provenance.round AS round, provenance.channel AS channel, provenance.doc_id AS doc_id, provenance.extra['gold'] AS gold, provenance.extra['from'] AS sent FROM trace_records WHERE record_no IS NOT NULL),
turns AS (SELECT * FROM tr WHERE channel = 'output' AND agent_id IS NOT NULL AND round > 0),
dl AS (SELECT DISTINCT execution_id, agent_id AS listener, round, split_part(sent, '|', 1) AS speaker, CAST(split_part(sent, '|', 2) AS INT) AS sent_round FROM tr WHERE channel = 'context' AND sent IS NOT NULL AND agent_id IS NOT NULL AND round > 0),
gd AS (SELECT DISTINCT execution_id, doc_id FROM tr WHERE channel = 'source' AND gold = 'true' AND doc_id IS NOT NULL),
db AS (SELECT DISTINCT execution_id, case_id, model, topology, panel, persona, memory, rounds, correct FROM debates WHERE execution_id IS NOT NULL),
rl AS (SELECT DISTINCT execution_id, e.key AS agent_id, e.value AS role FROM (SELECT execution_id, unnest(map_entries(roles)) AS e FROM debates)),
ag AS (SELECT DISTINCT execution_id, agent_id FROM m WHERE agent_id IS NOT NULL),
rd AS (SELECT execution_id, round, row_number() OVER (PARTITION BY execution_id ORDER BY round) AS rk FROM (SELECT DISTINCT execution_id, round FROM m WHERE round > 0)),
said AS (SELECT DISTINCT execution_id, agent_id, round, fact_id FROM m WHERE channel = 'output' AND agent_id IS NOT NULL AND round > 0),
sa AS (SELECT *, min(rk) OVER (PARTITION BY execution_id, fact_id) AS first_rk, min(rk) OVER (PARTITION BY execution_id, fact_id, agent_id) AS own_first_rk FROM said JOIN rd USING (execution_id, round) JOIN (SELECT execution_id, max(rk) AS last_rk FROM rd GROUP BY 1) USING (execution_id)),
jd AS (SELECT DISTINCT a, b, upper(trim(regexp_replace(relation, '{T.WHITESPACE}', ' ', 'g'))) AS label, coalesce(confidence, 1.0) AS confidence, margin_ab, margin_ba FROM relations WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b AND relation IS NOT NULL),
lf AS (SELECT jd.*, x.fact_id AS fa, y.fact_id AS fb, x.execution_id AS ea, y.execution_id AS eb, x.agent_id AS ga, y.agent_id AS gb, x.round AS ra, y.round AS rb, x.channel AS ca, y.channel AS cb FROM jd JOIN m x ON a = x.mention_id JOIN m y ON b = y.mention_id WHERE x.fact_id <> y.fact_id),
gr AS (SELECT execution_id, fact_id, CASE max(CASE WHEN channel = 'source' THEN coalesce(g, 0) END) WHEN 1 THEN 'gold' WHEN 0 THEN 'context' ELSE 'injected' END AS grounding FROM m LEFT JOIN (SELECT *, 1 AS g FROM gd) USING (execution_id, doc_id) GROUP BY 1, 2),
ct AS (SELECT DISTINCT unnest([fa, fb]) AS fact_id FROM lf WHERE label = 'CONTRADICTS'),
ind AS (SELECT DISTINCT execution_id, fact_id, agent_id FROM sa WHERE own_first_rk = first_rk),
cl AS (SELECT s.execution_id, s.fact_id, grounding, CASE WHEN sources > 1 THEN 'multi' ELSE 'single' END AS support, CASE WHEN holders > 1 THEN 'shared' ELSE 'private' END AS spread, CASE WHEN survives = 1 THEN 'survived' ELSE 'dropped' END AS fate, ct.fact_id IS NOT NULL AS contested, sources, first_rk FROM (SELECT execution_id, fact_id, count(DISTINCT agent_id) AS holders, count(DISTINCT CASE WHEN own_first_rk = first_rk THEN agent_id END) AS sources, max(CAST(rk = last_rk AS INT)) AS survives, min(first_rk) AS first_rk FROM sa GROUP BY 1, 2) s JOIN gr USING (execution_id, fact_id) LEFT JOIN ct ON ct.fact_id = s.fact_id),
tx AS (SELECT execution_id, fact_id, agent_id AS a, agent_id AS b, rk - 1 AS rk, 'persistence' AS kind FROM sa WHERE own_first_rk < rk UNION ALL SELECT n.execution_id, n.fact_id, p.agent_id, n.agent_id, p.rk, 'transmission' FROM sa n JOIN sa p ON p.execution_id = n.execution_id AND p.fact_id = n.fact_id AND p.rk = n.rk - 1 AND p.agent_id <> n.agent_id WHERE n.own_first_rk = n.rk),
rc AS (SELECT dl.*, fact_id FROM dl JOIN (SELECT execution_id, agent_id AS speaker, round AS sent_round, fact_id FROM said) USING (execution_id, speaker, sent_round)),
us AS (SELECT sa.*, CASE WHEN own_first_rk < rk THEN 'held' WHEN got THEN 'adopted' ELSE 'novel' END AS use FROM sa LEFT JOIN (SELECT DISTINCT execution_id, listener AS agent_id, round, fact_id, true AS got FROM rc) USING (execution_id, agent_id, round, fact_id))
"""


def query(sql: str | None = None, *, base: bool = True, name: str | None = None, recursive: bool = False):
    """Registers a function of a Trace under its own name."""

    def register(f: Callable[[Trace], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Trace(spark, sf_dir))
        if sql:
            SQL[key] = (BASE.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else BASE) + sql if base else sql
        return f

    return register
