"""Hand-built stores with obvious answers, and the operators around them."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracemill.functions import text as T
from tracemill.operators import matching, pipeline, stats
from tracemill.operators.base import Trace
from tracemill.operators.centrality import brandes
from tracemill.operators.components import connected
from tracemill.plans import catalogue, lifecycle as L
from tracemill.sources import stores
from tracemill.streaming import registry

MENTIONS = "mention_id string, text string, polarity string, quote string, qualifiers array<string>, execution_id string, agent_id string, round int, channel string, doc_id string, extra map<string, string>, ord long, extracted_at string"
FACTS = "ord long, fact_id string, canonical_text string, polarity string, mention_ids array<string>, properties map<string, string>"
RELATIONS = "a string, b string, relation string, confidence double, rationale string, margin_ab double, margin_ba double"
RECORDS = "record_no long, text string, provenance struct<execution_id: string, agent_id: string, round: int, channel: string, doc_id: string, extra: map<string, string>>, logged_at string"
DEBATES = "execution_id string, case_id string, model string, topology string, panel string, persona string, memory string, rounds int, roles map<string, string>, evidence array<struct<id: string, text: string, stance: string, tags: array<string>>>, correct boolean"


@pytest.fixture
def store(spark, tmp_path):
    """store(said {(agent, round): [text]}, sources [(text, gold)], relations [(text, text, label)], roles) -> Trace"""
    numbers = itertools.count()

    def make(said, sources=(), relations=(), roles=None, delivered=()):
        mentions, records, n = [], [], itertools.count(1)
        for (agent, rnd), texts in said.items():
            for x in texts:
                mentions.append((f"m{next(n)}", x, "affirm", None, [], "e", agent, rnd, "output", None, None, len(mentions), "t"))
            records.append((len(records), " ".join(texts), ("e", agent, rnd, "output", None, None), "t"))
        for x, gold in sources:
            mentions.append((f"m{next(n)}", x, "affirm", None, [], "e", None, 0, "source", f"d-{x}", None, len(mentions), "t"))
            records.append((len(records), x, ("e", None, 0, "source", f"d-{x}", {"gold": "true"} if gold else None), "t"))
        for listener, rnd, sent in delivered:
            records.append((len(records), "", ("e", listener, rnd, "context", None, {"from": sent}), "t"))
        of = {}
        for m in mentions:
            of.setdefault(m[1], m[0])
        rel = [(of[a], of[b], label, 1.0, None, None, None) for a, b, label in relations]
        d = tmp_path / str(next(numbers))
        debates = [("e", "c", "m", "chain", "p", None, "none", max(r for _, r in said), roles or {}, [], None)]
        for name, rows, schema in (("mentions", mentions, MENTIONS), ("facts", [], FACTS), ("relations", rel, RELATIONS), ("trace_records", records, RECORDS), ("debates", debates, DEBATES)):
            spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
        return Trace(spark, str(d))

    return make


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return df.first()


def fid(spark, text):
    return spark.range(1).select(T.make_fact_id(F.lit(text))).first()[0]


def test_simultaneous_speakers_are_independent(spark, store):
    t = store({("A", 1): ["X"], ("B", 1): ["X"], ("C", 1): ["X"]})
    assert {r.agent_id for r in t.independent.collect()} == {"A", "B", "C"} and t.classes.first().support == "multi"


def test_an_echo_is_no_support(spark, store):
    t = store({("A", 1): ["X"], ("B", 2): ["X"], ("C", 2): ["X"]})
    assert [r.agent_id for r in t.independent.collect()] == ["A"]
    c = t.classes.first()
    assert (c.support, c.spread) == ("single", "shared") and L.signature(t).first().echo_rate == 1.0


def test_grounding_fate_and_redundancy(spark, store):
    t = store({("A", 1): ["G", "C", "I"], ("A", 2): ["G"]}, sources=[("G", True), ("C", False), ("NEVER", True)])
    got = {r.fact_id: (r.grounding, r.fate) for r in t.classes.collect()}
    assert got == {fid(spark, "G"): ("gold", "survived"), fid(spark, "C"): ("context", "dropped"), fid(spark, "I"): ("injected", "dropped")}
    assert L.signature(store({("A", 1): ["X"], ("B", 1): ["X"], ("A", 2): ["X"], ("B", 2): ["X"]})).first().redundancy == 0.75


def test_load_bearing_and_fragility(spark, store):
    t = store({("A", 1): ["G"], ("A", 2): ["G"], ("B", 2): ["G"]}, sources=[("G", True)])
    assert {r.agent_id: r.facts for r in L.load_bearing(t).collect()} == {"A": 1, "B": 0} and L.fragility(t).first().fragility == 1.0
    t = store({("A", 1): ["G"], ("B", 1): ["G"], ("A", 2): ["G"], ("B", 2): ["G"]}, sources=[("G", True)])
    assert L.fragility(t).first().fragility == 0.0


def test_edges_and_role_flow(spark, store):
    t = store({("A", 1): ["X"], ("A", 2): ["X"], ("B", 2): ["X"]}, roles={"A": "critic", "B": "solver"})
    assert {(r.a, r.b, r.kind) for r in t.transmissions.collect()} == {("A", "A", "persistence"), ("A", "B", "transmission")}
    assert {(r.role_from, r.role_to, r.grounding): r.facts for r in L.compressed_flow(t).collect()} == {("critic", "critic", "injected"): 1, ("critic", "solver", "injected"): 1}


def test_trajectory_and_survival(spark, store):
    t = store({("A", 1): ["X", "Y"], ("A", 2): ["Y", "Z"], ("A", 3): ["Z"]})
    rows = L.trajectory(t).orderBy("round").collect()
    assert [(r.born, r.died, r.carried, r.cumulative) for r in rows] == [(2, 0, 0, 2), (1, 1, 1, 3), (0, 1, 1, 3)]
    t = store({("A", 1): ["X", "Y"], ("A", 2): ["X"], ("A", 3): ["X"]})
    assert [r.alive for r in L.survival_curve(t).where("born_rk = 1").orderBy("rk").collect()] == [1.0, 0.5, 0.5]


def test_contested(spark, store):
    t = store({("A", 1): ["X"], ("B", 1): ["not X"]}, relations=[("X", "not X", " contradicts ")])
    assert t.contested.count() == 2 and all(r.contested for r in t.classes.collect())


def test_uses_partition_what_was_said(spark, store):
    t = store({("A", 1): ["X", "Y"], ("B", 1): ["Z"], ("A", 2): ["X", "Z", "W"]}, delivered=[("A", 2, "B|1")])
    p = L.flow_profile(t).first()
    assert (p.novel, p.held, p.adopted) == (4, 1, 1) and p.novel + p.held + p.adopted == t.said.count()
    assert L.flow_f5(t).first().credit == 1.0
    assert L.funnel(t).first().asDict() == {"execution_id": "e", "exposed": 1, "adopted": 1, "retained": 1}


@pytest.mark.parametrize("local", [1, 200_000])
def test_components_on_chains_stars_and_pairs(spark, local):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.id: r.root for r in connected(spark.createDataFrame(edges, "u long, v long"), chunk=local).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected(spark.createDataFrame([], "u long, v long"), chunk=local).count() == 0


def test_wording_is_shuffled_only_where_it_is_asked_for(spark):
    """No quote, qualifiers or text in an exchange, but for the evidence that is joined by its text."""

    def nodes(p):
        yield p
        children = p.children()
        for i in range(children.size()):
            yield from nodes(children.apply(i))
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            yield from nodes(p.initialPlan())

    wide = {}
    for name in ("trajectory_mean", "signature", "fact_classes", "compressed_flow", "flow_profile", "funnel", "stats", "of_q5_coverage", "j_relation_lift", "ec_temporal", "gold_coverage", "grounding", "chain_path", "ii_overlap"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        for p in nodes(plan):
            if p.getClass().getSimpleName() == "ShuffleExchangeExec":
                out = p.output()
                wide.setdefault(name, set()).update({out.apply(i).name() for i in range(out.size())} & {"quote", "qualifiers", "text"})
        assert "mentions.parquet" not in plan.toString(), name
    assert not any(wide.values())


def test_betweenness():
    assert brandes([("p", "r"), ("r", "q")]) == {"p": 0.0, "r": 1.0, "q": 0.0}


def test_text_functions(spark):
    df = spark.createDataFrame([("  The  Cats\tWalked. ", "The cat")], "a string, b string")
    r = df.select(T.norm_text(F.col("a")).alias("n"), T.norm_text_rstrip(F.col("a")).alias("r"), T.tokenize(F.col("a")).alias("t"), T.containment(T.tokenize(F.col("a")), T.tokenize(F.col("b"))).alias("c"), T.shorten(F.lit("One. Two three four"), 12).alias("s"), T.shorten(F.lit("One two.  Three four"), 12).alias("s2")).first()
    assert (r.n, r.r) == ("the cats walked.", "the cats walked") and r.t == ["cat", "the", "walked."] and r.c == 1.0 and r.s == "One. Two ..." and r.s2 == "One two."


def test_blocking_quartet(spark):
    rows = [("a", "A basic income of 500 dollars a month reduced poverty by 20% in rural counties"), ("b", "A basic income reduced poverty"), ("c", "A basic income of 500 dollars a month did not reduce poverty by 20% in rural counties"), ("d", "Whales migrate south each winter")]
    df = spark.createDataFrame([(i, t, "e", i, 1, "output") for i, t in rows], "mention_id string, text string, execution_id string, agent_id string, round int, channel string")
    got = {(r.a, r.b): r.sim for r in matching.candidate_pairs(df).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and ("a", "d") not in got
    assert matching.candidate_pairs(df.withColumn("agent_id", F.lit("x"))).count() == 0
    exact = {(r.a, r.b) for r in matching.similar_token_sets(df, 0.5).collect()}
    assert exact == {("a", "c")}


def test_pipeline(spark):
    rec = spark.createDataFrame([("One thing is so. It was not.  One thing is so.", "e", "A", 1, "output", None), (" ", "e", "B", 1, "output", None), ("boom", "e", "C", None, "output", None)], "text string, execution_id string, agent_id string, round int, channel string, doc_id string")

    def extractor(text):
        if text == "boom":
            raise ValueError("no")
        return pipeline.sentence_extractor(text)

    rows = pipeline.extract(rec, extractor).orderBy("agent_id", "n").collect()
    assert [(r.agent_id, r.text, r.polarity, r.status) for r in rows] == [("A", "One thing is so.", "affirm", "ok"), ("A", "It was not.", "negate", "ok"), ("C", None, None, "ValueError('no')")]
    m = spark.createDataFrame([("m1", "rent was cut and prices were low", "e", "A", 1, "output"), ("m2", "plain claim", "e", "A", 1, "output"), ("m3", "Plain claim.", "e", "A", 1, "output")], "mention_id string, text string, execution_id string, agent_id string, round int, channel string")
    assert {(r.mention_id, r.split_from) for r in pipeline.atomize(m).collect()} == {("m1#1", "m1"), ("m1#2", "m1"), ("m2", None)}
    pairs = spark.createDataFrame([("a", "b", "x", "y", 0.4), ("a", "c", "x", "z", 0.97), ("b", "c", "y", "z", 0.9), ("b", "d", "y", "w", 0.6)], "a string, b string, text_a string, text_b string, sim double")
    got = {(r.a, r.b): (r.relation, r.status) for r in pipeline.identify(pairs, lambda ps: [(s > 0.8, "none") for *_, s in ps][:1], reject=0.55, accept=0.95).coalesce(1).collect()}
    assert got[("a", "b")] == ("UNRELATED", "band") and got[("a", "c")] == ("EQUIVALENT", "band")
    spec = [pipeline.PropertySpec("truth", "?", "boolean"), pipeline.PropertySpec("kind", "?", "choice", ("x", "y"))]
    facts = spark.createDataFrame([("f1", "t1"), ("f2", "t2"), ("f3", None)], "fact_id string, canonical_text string")
    got = {r.fact_id: r.annotation for r in pipeline.annotate(facts, spec, lambda ts: [{"truth": True, "kind": "z"} for _ in ts]).collect()}
    assert got["f1"].truth is True and got["f1"].kind is None and got["f3"] is None
    with pytest.raises(ValueError):
        pipeline.PropertySpec("k", "?", "choice").field()


def test_stores_round_trip(spark, tmp_path):
    prov = {"execution_id": "e", "agent_id": "A", "round": 1, "channel": "output", "doc_id": None, "extra": {}}
    (tmp_path / "run1.store.json").write_text(json.dumps({"mentions": {"m1": {"mention_id": "m1", "text": "x", "polarity": "affirm", "qualifiers": [], "provenance": prov}}, "facts": {"f1": {"fact_id": "f1", "canonical_text": "x", "polarity": "affirm", "mention_ids": ["m1"], "properties": {}}}, "mention_to_fact": {"m1": "f1"}, "relations": [{"a": "m1", "b": "m2", "relation": "EQUIVALENT", "confidence": 0.9}]}))
    (tmp_path / "run1.debate.json").write_text(json.dumps({"execution_id": "e", "rounds": 1, "roles": {"A": "judge"}, "transcript": {"A|1": "x", "B|2": "y"}, "delivery": {"B|2": {"peer_turns": ["A|1"]}}}))
    (tmp_path / "trace.json").write_text(json.dumps([{"text": "x", "provenance": {"agent_id": "A", "round": 1, "channel": "output"}}]))
    got = stores.read_store_json(spark, str(tmp_path / "*.store.json"))
    assert got["mentions"].first().execution_id == "e" and got["mention_fact"].first().fact_id == "f1" and got["relations"].count() == 1
    d = stores.read_debate_json(spark, str(tmp_path / "*.debate.json"))
    assert {(r.agent_id, r.round) for r in d["turns"].collect()} == {("A", 1), ("B", 2)}
    assert (d["deliveries"].first().speaker, d["deliveries"].first().sent_round) == ("A", 1)
    assert stores.pair_by_stem(got["facts"], d["debates"]).count() == 1
    assert stores.read_trace_json(spark, str(tmp_path / "trace.json")).first().provenance.execution_id == "exec-0"
    stores.write_store(got, str(tmp_path / "out"))
    back = stores.read_store(spark, str(tmp_path / "out"))
    assert back["mentions"].select("mention_id", "text").collect() == got["mentions"].select("mention_id", "text").collect()


def test_streaming_registry_keeps_ids(spark, tmp_path):
    schema = "mention_id string, text string"
    for i, rows in enumerate([[("m1", "A b"), ("m2", "c")], [("m3", " a  B "), ("m4", "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    spark.createDataFrame([], "fact_id string, canonical_text string").write.parquet(str(tmp_path / "reg/batch=-1"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    registry.run_registry(spark, stream, str(tmp_path / "reg"), str(tmp_path / "links"), str(tmp_path / "cp")).awaitTermination()
    links = {r.mention_id: r.fact_id for r in spark.read.parquet(str(tmp_path / "links")).collect()}
    assert links["m1"] == links["m3"] and len(set(links.values())) == 3
    assert spark.read.parquet(str(tmp_path / "reg")).count() == 3


def test_statistics(spark):
    d = spark.createDataFrame([(str(i), x) for i, x in enumerate((1.0, 2.0, 3.0, 4.0))], "k string, d double")
    assert stats.signflip(d, "d", key="k").first().p == pytest.approx(2 / 16)
    b = stats.bootstrap_mean(d, "d", key="k").first()
    assert b.mean == 2.5 and b.low < 2.5 < b.high and b.positive == 1.0
    g = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 3.0), ("b", 3.0)], "g string, x double")
    assert stats.eta_squared(g, "x", "g").first().eta2 == 1.0


def test_every_query_with_sql_is_registered():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
