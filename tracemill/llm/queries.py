"""The pN_ queries over the domain tables, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.llm import components, conversations, copies, encoding, history, leakage, lookalike, mixture, neardup
from tracemill.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.fact_groups(table(spark, sf_dir, "relations"), table(spark, sf_dir, "facts"), table(spark, sf_dir, "mentions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.whole_debates(table(spark, sf_dir, "trace_records"), table(spark, sf_dir, "debates")).select("execution_id", "turn_no", "record_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.said_already(table(spark, sf_dir, "facts"), table(spark, sf_dir, "new_mentions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.mention_pairs(table(spark, sf_dir, "mentions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("mentions", "ord", "quote"), ("trace_records", "record_no", "text")]
    parts = [lookalike.same_looking_pairs(table(spark, sf_dir, name), key, column).select(F.lit(name).alias("tbl"), "*") for name, key, column in parts]
    return parts[0].unionByName(parts[1])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.domain_records(*(table(spark, sf_dir, t) for t in ("mentions", "facts", "fact_dumps")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copied_rows(_records(spark, sf_dir))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.counted_copies(_records(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the method, passages and their check included; a leak of 13 words is the strongest of a document and item."""
    return p7_leaks(spark, sf_dir).where("exact").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with their source's target and actual share."""
    drawn, shares = mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return drawn.join(F.broadcast(shares.select("source", "target_share", "wanted_share", "actual_share")), "source")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.restored(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if re.match(r"p\d_", k)}


P1 = r"""WITH RECURSIVE known AS (SELECT DISTINCT mention_id AS id FROM mentions WHERE mention_id IS NOT NULL),
held AS (SELECT DISTINCT ord, id FROM (SELECT ord, unnest(mention_ids) AS id FROM facts) JOIN known USING (id)),
links AS (SELECT a AS u, b AS v FROM relations JOIN known x ON x.id = a JOIN known y ON y.id = b WHERE a <> b AND upper(trim(regexp_replace(relation, '^\s+|\s+$', '', 'g'))) = 'EQUIVALENT' AND coalesce(confidence, 1.0) >= 0.85 UNION SELECT min(id) OVER (PARTITION BY ord), id FROM held),
edges AS (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v),
reach AS (SELECT DISTINCT u AS id, u AS root FROM edges UNION SELECT edges.v, root FROM reach JOIN edges ON edges.u = reach.id WHERE root < edges.v)
SELECT id AS mention_id, min(root) AS group_id FROM reach GROUP BY 1"""

P2 = r"""WITH said AS (SELECT DISTINCT record_no, provenance.execution_id AS execution_id, provenance.agent_id AS agent_id, provenance.round AS round, regexp_matches(coalesce(text, ''), '[^\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]') AS seen FROM trace_records WHERE provenance.channel = 'output'),
d AS (SELECT DISTINCT execution_id, rounds, map_keys(roles) AS agents FROM debates WHERE rounds > 0 AND len(map_keys(roles)) > 0),
ok AS (SELECT execution_id FROM said JOIN d USING (execution_id) GROUP BY execution_id, rounds, agents HAVING count(*) = len(agents) * rounds AND count(DISTINCT agent_id || '|' || round) = count(*) AND bool_and(seen AND agent_id IS NOT NULL AND round BETWEEN 1 AND rounds AND list_contains(agents, agent_id)))
SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY round, agent_id) AS turn_no, record_no FROM said JOIN ok USING (execution_id)"""

_PLAIN = r"regexp_replace(lower({}), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|\p{{P}}|\p{{Z}}|\p{{C}}', '', 'g')"
_FIELDS = " || '|' || ".join(f"coalesce({_PLAIN.format(f'json_extract_string(payload, {chr(39)}$.{f}{chr(39)})')}, '~')" for f in ("canonical_text", "polarity", "properties.topic", "properties.place", "properties.rank", "properties.gold"))
P6_ROWS = f"""WITH r AS (SELECT DISTINCT 'mentions' AS tbl, ord AS row_no, {_PLAIN.format('text')} AS form FROM mentions WHERE text IS NOT NULL
UNION SELECT 'facts', ord, {_PLAIN.format('canonical_text')} FROM facts WHERE canonical_text IS NOT NULL
UNION SELECT 'fact_dumps', dump_id, {_FIELDS} FROM fact_dumps WHERE json_valid(payload))"""
P6 = P6_ROWS + " SELECT tbl, row_no, first_row_no FROM (SELECT *, min(row_no) OVER w AS first_row_no, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY tbl, form)) WHERE n > 1"

P7 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)), eg AS (SELECT item_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)"""


_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"
#: Pairs of texts tx(id, w) alike by 0.70, by the words they share.
_ALIKE = """wd AS (SELECT id, len(w) AS n, unnest(w) AS word FROM tx), al AS (SELECT x.id AS a, y.id AS b FROM wd x JOIN wd y ON x.word = y.word AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n HAVING count(*) * 100 >= 70 * (x.n + y.n - count(*)))"""

P4 = f"""WITH RECURSIVE mt AS (SELECT DISTINCT mention_id, {_WORDS.format("concat_ws(' ', text, array_to_string(qualifiers, ' '))")} AS w0 FROM mentions WHERE mention_id IS NOT NULL),
ms AS (SELECT mention_id, list_sort(w0) AS w FROM mt WHERE len(w0) > 0), tx AS (SELECT w, min(mention_id) AS id FROM ms GROUP BY 1), {_ALIKE},
edges AS (SELECT a AS u, b AS v FROM al UNION ALL SELECT b, a FROM al),
reach AS (SELECT id, id AS root FROM tx UNION SELECT edges.v, root FROM reach JOIN edges ON edges.u = reach.id WHERE root < edges.v),
gr AS (SELECT mention_id, root FROM ms JOIN tx USING (w) JOIN (SELECT id, min(root) AS root FROM reach GROUP BY 1) USING (id))
SELECT x.mention_id AS mention_id_a, y.mention_id AS mention_id_b FROM gr x JOIN gr y ON x.root = y.root AND x.mention_id < y.mention_id"""

_MADE = r"'f_' || substr(sha1(trim(regexp_replace(lower(text), '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))), 1, 16)".replace("{{", "{").replace("}}", "}")
#: Each open set, in the order of its first row, is accepted unless it is alike to one accepted before.
P3 = f"""WITH RECURSIVE fw AS (SELECT fact_id, list_sort({_WORDS.format('canonical_text')}) AS w FROM (SELECT ord, min({{'f': fact_id, 't': canonical_text}}) AS r FROM facts WHERE ord IS NOT NULL AND fact_id IS NOT NULL AND canonical_text IS NOT NULL GROUP BY 1) JOIN LATERAL (SELECT r.f AS fact_id, r.t AS canonical_text) ON true),
nw AS (SELECT mention_id, pos, {_MADE} AS made, list_sort({_WORDS.format('text')}) AS w FROM (SELECT mention_id, CAST(batch_no AS BIGINT) * 1099511627776 + ord AS pos, text FROM (SELECT DISTINCT mention_id, batch_no, ord, text FROM new_mentions WHERE mention_id IS NOT NULL AND batch_no IS NOT NULL AND ord IS NOT NULL AND text IS NOT NULL))),
tx AS (SELECT w, row_number() OVER (ORDER BY w) AS id FROM (SELECT w FROM fw UNION SELECT w FROM nw) WHERE len(w) > 0), {_ALIKE},
near AS (SELECT a, b FROM al UNION ALL SELECT b, a FROM al UNION ALL SELECT id, id FROM tx),
fi AS (SELECT DISTINCT id, fact_id FROM fw JOIN tx USING (w)), ni AS (SELECT mention_id, pos, made, id FROM nw JOIN tx USING (w)),
op AS (SELECT id, min(pos) AS pos, arg_min(made, pos) AS made FROM ni WHERE id NOT IN (SELECT near.a FROM near JOIN fi ON fi.id = near.b) GROUP BY 1),
oo AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM op), nb AS (SELECT oo.id, k, coalesce(list(near.b) FILTER (WHERE near.b <> oo.id), []) AS others FROM oo LEFT JOIN near ON near.a = oo.id GROUP BY 1, 2),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS accepted UNION ALL SELECT nb.k, CASE WHEN list_has_any(accepted, others) THEN accepted ELSE list_append(accepted, nb.id) END FROM walk JOIN nb ON nb.k = walk.k + 1),
ac AS (SELECT unnest(accepted) AS id FROM (SELECT arg_max(accepted, k) AS accepted FROM walk)),
kn AS (SELECT id, fact_id, CAST(-1 AS BIGINT) AS since FROM fi UNION ALL SELECT id, made, pos FROM oo WHERE id IN (SELECT id FROM ac))
SELECT DISTINCT mention_id, fact_id FROM ni JOIN near ON near.a = ni.id JOIN kn ON kn.id = near.b WHERE since < pos"""


def oracle_sql() -> dict[str, str]:
    """The others are random or fitted, or need tables that SQL has not; tests/llm holds them against brute force."""
    counts = P6_ROWS + " SELECT tbl, min(row_no) AS first_row_no, count(*) AS copies FROM r GROUP BY tbl, form"
    return {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p4_found": P4, "p6_found": P6, "p6_counts": counts, "p7_found": P7}
