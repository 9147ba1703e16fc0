"""Scalar functions, predicates and parsers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tracemill.functions import text as T
from tracemill.operators.base import Trace
from tracemill.plans.registry import fact_id_sql, norm_sql, query, tokens_sql


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"SELECT mention_id, {norm_sql('text')} AS norm, regexp_replace({norm_sql('text')}, '\\.+$', '') AS rstripped, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS ascii_key FROM m")
def norm_text(t: Trace) -> DataFrame:
    c = F.col("text")
    return t.texts("text").select("mention_id", T.norm_text(c).alias("norm"), T.norm_text_rstrip(c).alias("rstripped"), T.norm_ascii(c).alias("ascii_key"))


@query("SELECT mention_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS word_key, polarity FROM m")
def norm_word(t: Trace) -> DataFrame:
    return t.texts("text", "polarity").select("mention_id", T.norm_word(F.col("text")).alias("word_key"), "polarity")


@query(f"SELECT mention_id, {fact_id_sql('text')} AS made_id FROM m")
def make_fact_id(t: Trace) -> DataFrame:
    return t.texts("text").select("mention_id", T.make_fact_id(F.col("text")).alias("made_id"))


_QUOTED = "CASE WHEN {x} IS NULL THEN 'None' ELSE '''' || {x} || '''' END"


@query("SELECT mention_id, 'm_' || substr(sha1(text || '|(' || " + _QUOTED.format(x="execution_id") + " || ', ' || " + _QUOTED.format(x="agent_id") + " || ', ' || coalesce(CAST(round AS VARCHAR), 'None') || ', ' || " + _QUOTED.format(x="channel") + " || ')'), 1, 16) AS made_id FROM m")
def make_mention_id(t: Trace) -> DataFrame:
    return t.worded("text").select("mention_id", T.make_mention_id(F.col("text"), F.col("execution_id"), F.col("agent_id"), F.col("round"), F.col("channel")).alias("made_id"))


@query("SELECT fact_id, ord, sha256(canonical_text || '|' || polarity) AS digest FROM (SELECT DISTINCT fact_id, ord, canonical_text, polarity FROM facts)")
def make_cache_key(t: Trace) -> DataFrame:
    f = t.raw("facts").select("fact_id", "ord", "canonical_text", "polarity").distinct()
    return f.select("fact_id", "ord", F.sha2(F.concat("canonical_text", F.lit("|"), "polarity").cast("binary"), 256).alias("digest"))


@query(f"SELECT mention_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM m")
def tokenize_stem(t: Trace) -> DataFrame:
    return t.texts("text").select("mention_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens"))


PAIRS = f", tk AS (SELECT mention_id, {tokens_sql('text')} AS w FROM m), pr AS (SELECT jd.a, jd.b, x.w AS wa, y.w AS wb, len(list_intersect(x.w, y.w)) AS n FROM (SELECT DISTINCT a, b FROM jd) jd JOIN tk x ON x.mention_id = jd.a JOIN tk y ON y.mention_id = jd.b)"


def _pairs(t: Trace) -> DataFrame:
    of = lambda x: t.texts("text").select(F.col("mention_id").alias(x), T.tokenize(F.col("text")).alias(f"w{x}"))
    return t.judged.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")


@query(PAIRS + " SELECT a, b, round(n * 1.0 / least(len(wa), len(wb)), 6) AS containment FROM pr")
def containment(t: Trace) -> DataFrame:
    return _pairs(t).select("a", "b", F.round(T.containment(F.col("wa"), F.col("wb")), 6).alias("containment"))


@query(PAIRS + " SELECT a, b, round(n * 1.0 / (len(wa) + len(wb) - n), 6) AS jaccard FROM pr")
def jaccard(t: Trace) -> DataFrame:
    return _pairs(t).select("a", "b", F.round(T.jaccard(F.col("wa"), F.col("wb")), 6).alias("jaccard"))


@query(PAIRS + ", s AS (SELECT a, b, n * 1.0 / least(len(wa), len(wb)) AS s FROM pr) SELECT CASE WHEN s < 0.55 THEN 'UNRELATED' WHEN s >= 0.95 THEN 'EQUIVALENT' ELSE 'ask' END AS band, count(*) AS pairs FROM s GROUP BY 1")
def filter_bands(t: Trace) -> DataFrame:
    return _pairs(t).select(T.band(T.containment(F.col("wa"), F.col("wb")), 0.55, 0.95).alias("band")).groupBy("band").agg(F.count("*").alias("pairs"))


FLAGS = {"looks_joined": T.JOINED, "rx_quantified": T.QUANTIFIED, "rx_source_meta": T.SOURCE_META, "rx_conjunction": T.CONJUNCTION, "rx_resolved_inline": T.RESOLVED_INLINE}


def _flag(name: str, pattern: str) -> None:
    @query(f"SELECT mention_id FROM m WHERE regexp_matches(text, '{_q(pattern)}')", name=name)
    def rows(t: Trace) -> DataFrame:
        return t.texts("text").where(F.col("text").rlike(pattern)).select("mention_id")


for _name, _pattern in FLAGS.items():
    _flag(_name, _pattern)


@query(f"SELECT mention_id FROM m WHERE regexp_matches(text, '{_q(T.UNRESOLVED)}') AND NOT regexp_matches(text, '{_q(T.RESOLVED_INLINE)}') AND NOT regexp_matches(text, '{_q(T.QUANTIFIED)}')")
def rx_unresolved(t: Trace) -> DataFrame:
    return t.texts("text").where(T.unresolved(F.col("text"))).select("mention_id")


@query(f"SELECT execution_id, count(*) AS facts, round(avg(CAST(regexp_matches(text, '(?i)\\b(and|or)\\b') AS DOUBLE)), 6) AS joined FROM m WHERE channel = 'output' GROUP BY 1")
def dg_conjunction(t: Trace) -> DataFrame:
    return t.worded("text").where("channel = 'output'").groupBy("execution_id").agg(F.count("*").alias("facts"), F.round(F.avg(F.col("text").rlike(r"(?i)\b(and|or)\b").cast("double")), 6).alias("joined"))


@query(f"SELECT execution_id, number, count(*) AS n FROM (SELECT execution_id, unnest(regexp_extract_all(text, '{T.NUMBER}')) AS number FROM turns) GROUP BY 1, 2")
def numeric_tokens(t: Trace) -> DataFrame:
    return t.turns.select("execution_id", F.explode(F.regexp_extract_all("text", F.lit(T.NUMBER), F.lit(0))).alias("number")).groupBy("execution_id", "number").agg(F.count("*").alias("n"))


@query(f", nm AS (SELECT DISTINCT execution_id, round, unnest(regexp_extract_all(text, '{T.NUMBER}')) AS number FROM turns), f AS (SELECT execution_id, number, min(round) AS f, bool_or(round = 3) AS r3 FROM nm GROUP BY 1, 2) SELECT execution_id, count(*) AS numbers, round(avg(CAST(r3 AS DOUBLE)), 6) AS retained FROM f WHERE f = 1 GROUP BY 1")
def es_numeric_retention(t: Trace) -> DataFrame:
    n = t.turns.select("execution_id", "round", F.explode(F.regexp_extract_all("text", F.lit(T.NUMBER), F.lit(0))).alias("number")).distinct()
    f = n.groupBy("execution_id", "number").agg(F.min("round").alias("f"), F.bool_or(F.col("round") == 3).alias("r3")).where("f = 1")
    return f.groupBy("execution_id").agg(F.count("*").alias("numbers"), F.round(F.avg(F.col("r3").cast("double")), 6).alias("retained"))


@query("SELECT slot, count(*) AS mentions FROM (SELECT CASE WHEN channel = 'source' THEN 'SRC' ELSE coalesce(agent_id, '?') || coalesce(CAST(round AS VARCHAR), '?') END AS slot FROM m) GROUP BY 1")
def slot_label(t: Trace) -> DataFrame:
    return t.mentions.select(T.slot_label(F.col("channel"), F.col("agent_id"), F.col("round")).alias("slot")).groupBy("slot").agg(F.count("*").alias("mentions"))


SHORT = f"""WITH tu AS (SELECT DISTINCT record_no, trim(regexp_replace(text, '{T.WHITESPACE}', ' ', 'g')) AS t FROM trace_records WHERE record_no IS NOT NULL AND provenance.channel = 'output' AND provenance.agent_id IS NOT NULL AND provenance.round > 0),
hd AS (SELECT *, left(t, 120) AS h FROM tu),
ed AS (SELECT *, greatest(length(regexp_extract(h, '^(.*)\\. ', 1)) + CAST(contains(h, '. ') AS INT), length(regexp_extract(h, '^(.*); ', 1)) + CAST(contains(h, '; ') AS INT)) AS e FROM hd)
SELECT record_no, CASE WHEN length(t) <= 120 THEN t WHEN e - 1 >= 60 THEN substr(t, 1, e) ELSE regexp_replace(h, ' [^ ]*$', '') || ' ...' END AS short FROM ed"""


@query(SHORT, base=False)
def shorten_sentence(t: Trace) -> DataFrame:
    return t.turns.select("record_no", T.shorten(F.col("text"), 120).alias("short"))


@query("SELECT a, b, margin_ab, margin_ba, CASE WHEN margin_ab >= 2.64 AND margin_ba >= 2.64 THEN 'EQUIVALENT' WHEN margin_ab >= 2.64 THEN 'A_ENTAILS_B' WHEN margin_ba >= 2.64 THEN 'B_ENTAILS_A' ELSE 'UNRELATED' END AS derived FROM jd WHERE margin_ab IS NOT NULL AND margin_ba IS NOT NULL")
def entail_label(t: Trace) -> DataFrame:
    return t.judged.where("margin_ab is not null and margin_ba is not null").select("a", "b", "margin_ab", "margin_ba", T.entail_label(F.col("margin_ab"), F.col("margin_ba"), 2.64).alias("derived"))


@query(", th AS (SELECT unnest([0.0, 2.64, 5.28, 7.92, 10.56]) AS th) SELECT CAST(th AS DOUBLE) AS threshold, CASE WHEN margin_ab >= th AND margin_ba >= th THEN 'EQUIVALENT' WHEN margin_ab >= th THEN 'A_ENTAILS_B' WHEN margin_ba >= th THEN 'B_ENTAILS_A' ELSE 'UNRELATED' END AS derived, count(*) AS n FROM jd CROSS JOIN th WHERE margin_ab IS NOT NULL AND margin_ba IS NOT NULL GROUP BY 1, 2")
def ec_relabel(t: Trace) -> DataFrame:
    j = t.judged.where("margin_ab is not null and margin_ba is not null").withColumn("threshold", F.explode(F.array(*map(F.lit, (0.0, 2.64, 5.28, 7.92, 10.56)))))
    return j.groupBy("threshold", T.entail_label(F.col("margin_ab"), F.col("margin_ba"), F.col("threshold")).alias("derived")).agg(F.count("*").alias("n"))


@query("SELECT x AS a, y AS b, label, count(*) AS n FROM (SELECT a AS x, b AS y, label FROM jd UNION ALL SELECT b, a, CASE label WHEN 'A_ENTAILS_B' THEN 'B_ENTAILS_A' WHEN 'B_ENTAILS_A' THEN 'A_ENTAILS_B' ELSE label END FROM jd) GROUP BY 1, 2, 3")
def flip_relation(t: Trace) -> DataFrame:
    j = t.judged.select("a", "b", "label")
    both = j.unionByName(j.select(F.col("b").alias("a"), F.col("a").alias("b"), T.flipped(F.col("label")).alias("label")))
    return both.groupBy("a", "b", "label").agg(F.count("*").alias("n"))


@query("SELECT dump_id, json_extract_string(payload, '$.polarity') AS polarity, json_extract_string(payload, '$.properties.topic') AS topic, CAST(json_extract_string(payload, '$.properties.rank') AS INT) AS rank FROM (SELECT DISTINCT dump_id, payload FROM fact_dumps) WHERE json_valid(payload)", base=False)
def json_object_parse(t: Trace) -> DataFrame:
    v = F.try_parse_json("payload")
    d = t.raw("fact_dumps").select("dump_id", "payload").distinct().where(v.isNotNull())
    get = lambda p, k: F.try_variant_get(v, p, k)
    return d.select("dump_id", get("$.polarity", "string").alias("polarity"), get("$.properties.topic", "string").alias("topic"), get("$.properties.rank", "int").alias("rank"))


@query("SELECT model, CASE model WHEN 'larch-large' THEN CAST(2.0 AS DOUBLE) WHEN 'larch-small' THEN 0.5 WHEN 'juniper-chat' THEN 1.0 END AS price, count(*) AS runs FROM db GROUP BY ALL")
def src_price_table(t: Trace) -> DataFrame:
    """A price joined to each model; an unknown model has none, never 0."""
    prices = t.spark.createDataFrame([("larch-large", 2.0), ("larch-small", 0.5), ("juniper-chat", 1.0)], "model string, price double")
    return t.debates.join(F.broadcast(prices), "model", "left").groupBy("model", "price").agg(F.count("*").alias("runs"))


@query("SELECT execution_id, regexp_extract(execution_id, '^ex-(\\d+)-', 1) AS shard, CAST(nullif(regexp_extract(execution_id, '-(\\d+)$', 1), '') AS BIGINT) AS number FROM db")
def src_filename_fields(t: Trace) -> DataFrame:
    n = F.regexp_extract("execution_id", r"-(\d+)$", 1)
    return t.debates.select("execution_id", F.regexp_extract("execution_id", r"^ex-(\d+)-", 1).alias("shard"), F.when(n != "", n).cast("long").alias("number"))


# The place of each mention's quote in its turn, and overlapping places merged.
SPANS = ", sp AS (SELECT DISTINCT tr.record_no, instr(tr.text, m.quote) AS s, instr(tr.text, m.quote) + length(m.quote) AS e FROM m JOIN turns tr ON tr.execution_id = m.execution_id AND tr.agent_id = m.agent_id AND tr.round = m.round WHERE m.channel = 'output' AND m.quote IS NOT NULL AND m.quote <> '' AND instr(tr.text, m.quote) > 0)"


def _spans(t: Trace) -> DataFrame:
    q = t.worded("quote").where("channel = 'output' and quote is not null and quote <> ''").select("execution_id", "agent_id", "round", "quote")
    j = q.join(t.turns, ["execution_id", "agent_id", "round"]).withColumn("s", F.expr("instr(text, quote)")).where("s > 0")
    return j.select("record_no", "s", (F.col("s") + F.length("quote")).alias("e")).distinct()


@query(SPANS + " SELECT record_no, s, e FROM sp")
def fold_locate_quote(t: Trace) -> DataFrame:
    return _spans(t)


@query(SPANS + ", g AS (SELECT *, max(e) OVER (PARTITION BY record_no ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sp), i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY record_no ORDER BY s, e) AS island FROM g) SELECT record_no, min(s) AS s, max(e) AS e, count(*) AS spans FROM i GROUP BY record_no, island")
def merge_spans(t: Trace) -> DataFrame:
    w = W.partitionBy("record_no").orderBy("s", "e")
    g = _spans(t).withColumn("pe", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)))
    i = g.withColumn("island", F.sum(F.when(F.col("pe").isNull() | (F.col("s") >= F.col("pe")), 1).otherwise(0)).over(w))
    return i.groupBy("record_no", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("spans")).drop("island")


@query("SELECT DISTINCT execution_id, trim(regexp_replace(split_part(role, '.', 1), '^You are (a|an|the) ', '')) AS short FROM rl")
def short_role(t: Trace) -> DataFrame:
    return t.roles.select("execution_id", F.trim(F.regexp_replace(F.split("role", r"\.")[0], "^You are (a|an|the) ", "")).alias("short")).distinct()


@query("SELECT execution_id, count(DISTINCT CASE WHEN channel = 'source' THEN doc_id END) AS held, count(DISTINCT CASE WHEN channel = 'source' AND gold = 'true' THEN doc_id END) AS gold FROM tr GROUP BY 1")
def deal_coverage(t: Trace) -> DataFrame:
    src = F.col("channel") == "source"
    return t.records.groupBy("execution_id").agg(F.countDistinct(F.when(src, F.col("doc_id"))).alias("held"), F.countDistinct(F.when(src & (F.col("gold") == "true"), F.col("doc_id"))).alias("gold"))


@query(", ev AS (SELECT DISTINCT execution_id, unnest(evidence) AS e FROM debates) SELECT execution_id, agent_id, e.id AS item FROM ev JOIN rl USING (execution_id)")
def deal_full(t: Trace) -> DataFrame:
    """Every agent holds every piece of evidence of its debate."""
    ev = t.raw("debates").select("execution_id", F.explode("evidence").alias("e")).distinct()
    return ev.join(t.roles, "execution_id").select("execution_id", "agent_id", F.col("e.id").alias("item"))


@query(", ev AS (SELECT DISTINCT execution_id, unnest(evidence) AS e FROM debates), n AS (SELECT execution_id, e.id AS item, row_number() OVER (PARTITION BY execution_id ORDER BY e.id) - 1 AS k FROM ev), a AS (SELECT execution_id, agent_id, row_number() OVER (PARTITION BY execution_id ORDER BY agent_id) - 1 AS j, count(*) OVER (PARTITION BY execution_id) AS c FROM rl) SELECT n.execution_id, agent_id, item FROM n JOIN a ON a.execution_id = n.execution_id AND k % c = j")
def deal_partition(t: Trace) -> DataFrame:
    """Evidence dealt out in turn, each piece to one agent."""
    w = W.partitionBy("execution_id")
    n = t.raw("debates").select("execution_id", F.explode("evidence").alias("e")).distinct().select("execution_id", F.col("e.id").alias("item"), (F.row_number().over(w.orderBy("e.id")) - 1).alias("k"))
    a = t.roles.select("execution_id", "agent_id", (F.row_number().over(w.orderBy("agent_id")) - 1).alias("j"), F.count("*").over(w).alias("c"))
    return n.join(a, "execution_id").where("k % c = j").select("execution_id", "agent_id", "item")


@query(", ev AS (SELECT DISTINCT execution_id, unnest(evidence) AS e FROM debates), s AS (SELECT execution_id, 'source' AS channel, NULL AS agent_id, NULL AS round, e.text AS text FROM ev UNION ALL SELECT execution_id, 'output', agent_id, round, text FROM turns) SELECT execution_id, channel, agent_id, round, count(*) AS pieces, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY 1, 2, 3, 4")
def src_debate_slots(t: Trace) -> DataFrame:
    ev = t.raw("debates").select("execution_id", F.explode("evidence").alias("e")).distinct()
    a = ev.select("execution_id", F.lit("source").alias("channel"), F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("int").alias("round"), F.col("e.text").alias("text"))
    b = t.turns.select("execution_id", F.lit("output").alias("channel"), "agent_id", "round", "text")
    return a.unionByName(b).groupBy("execution_id", "channel", "agent_id", "round").agg(F.count("*").alias("pieces"), F.sum(F.length("text")).alias("chars"))


@query("SELECT execution_id FROM db WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.execution_id = db.execution_id)")
def j_anti_done(t: Trace) -> DataFrame:
    """Debates without any mention: inputs still to be processed."""
    return t.debates.select("execution_id").join(t.mentions.select("execution_id").distinct(), "execution_id", "left_anti")


@query("SELECT mention_id, text, polarity, execution_id, agent_id, round, channel, doc_id FROM m")
def strip_store(t: Trace) -> DataFrame:
    return t.worded("text").select("mention_id", "text", "polarity", "execution_id", "agent_id", "round", "channel", "doc_id")
