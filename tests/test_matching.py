"""Judging and joining of pairs, audits, subsets, brokers: stores of several executions with dirt."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.operators import matching, pipeline
from tracemill.operators.centrality import weighted_betweenness

PAIR = "a string, b string, text_a string, text_b string, sim double"


def test_bands_are_off_by_default(spark):
    """A similarity that a caller made up decides nothing: each pair is asked about."""
    pairs = spark.createDataFrame([("a", "b", "x", "y", 1.0), ("a", "c", "x", "z", 0.0)], PAIR)
    got = {(r.a, r.b): (r.relation, r.status) for r in pipeline.identify(pairs, lambda ps: [(s < 0.5, None) for *_, s in ps]).collect()}
    assert got == {("a", "b"): ("UNRELATED", "judged"), ("a", "c"): ("EQUIVALENT", "judged")}


def test_bands_decide_without_the_judge(spark):
    def never(ps):
        raise AssertionError("asked")

    pairs = spark.createDataFrame([("a", "b", "x", "y", 0.97), ("a", "c", "x", "z", 0.4)], PAIR)
    got = {(r.a, r.b): r.relation for r in pipeline.identify(pairs, never, reject=0.55, accept=0.95).collect()}
    assert got == {("a", "b"): "EQUIVALENT", ("a", "c"): "UNRELATED"}


def test_notes_and_missing_answers(spark):
    pairs = spark.createDataFrame([("a", "b", "x", "y", 0.8), ("c", "d", "x", "y", 0.8), ("e", "f", "x", "y", 0.8)], PAIR).coalesce(1)
    got = {r.a: (r.relation, r.note, r.status) for r in pipeline.identify(pairs, lambda ps: [(True, "differs in scope"), (False, "none")]).collect()}
    assert got == {"a": ("EQUIVALENT", "differs in scope", "judged"), "c": ("UNRELATED", None, "judged"), "e": (None, None, "missing")}


def test_a_vaguer_restatement_is_not_the_same(spark):
    """All its words stand in the other text, so the similarity is one."""
    pairs = spark.createDataFrame([("a", "b", "The grant halved arrears by 2019 in Selm county", "The grant halved arrears", 1.0), ("c", "d", "Rents fell, in May.", "In May rents fell", 0.6)], PAIR)
    assert {r.a: r.relation for r in pipeline.identify(pairs).collect()} == {"a": "UNRELATED", "c": "EQUIVALENT"}


@pytest.mark.parametrize("confidence, label, groups", [(0.95, "EQUIVALENT", 2), (0.85, "EQUIVALENT", 2), (0.84, "EQUIVALENT", 4), (0.99, "UNRELATED", 4)])
def test_only_certain_equality_joins_and_chains(spark, confidence, label, groups):
    m = spark.createDataFrame([(f"m{i}", f"claim {i}", "affirm", f"e{i % 2}", "output", i, None) for i in range(4)], "mention_id string, text string, polarity string, execution_id string, channel string, ord long, qualifiers array<string>")
    judged = spark.createDataFrame([("m0", "m1", label, confidence), ("m1", "m2", label, confidence), ("m2", None, label, confidence)], "a string, b string, label string, confidence double")
    got = matching.match(m, judged).collect()
    assert len(got) == 4 and len({r.fact_id for r in got}) == groups


def test_strict_subsets_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"e{i % 3}", f"f{i}", sorted({rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))})) for i in range(90)] + [("e0", "empty", []), ("e1", "null", None)]
    got = {tuple(r) for r in matching.strict_subsets(spark.createDataFrame(rows, "execution_id string, fact_id string, w array<string>")).collect()}
    assert got == {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] and y[2] and len(x[2]) >= 2 and set(x[2]) < set(y[2])}


def test_missed_merges(spark):
    rows = [("f1", "The Selm Bridge Trust was founded in 1932 by the town"), ("f2", "Selm Bridge Trust founded in 1932 by town"), ("f3", "The Selm Bridge Trust was closed in 1932 by the town"), ("f4", "The Selm Bridge Trust was founded in 1932 by the town"), ("f5", None), ("f6", "of the")]
    got = {tuple(r) for r in pipeline.missed_merges(spark.createDataFrame(rows, "fact_id string, canonical_text string")).collect()}
    assert ("f1", "f2") in got and ("f4", "f1") in got and not any("f3" in g or "f6" in g for g in got)
    assert pipeline.missed_merges(spark.createDataFrame([], "fact_id string, canonical_text string")).count() == 0


def test_names_are_taken_out_longest_first(spark):
    df = spark.createDataFrame([("Lead of the Selm Valley Board of Health met Selm Valley voters", "near Selm Valley Board of Health, where Selm Valley agreed")], "a string, b string")
    x, y = T.without_shared_names(F.col("a"), F.col("b"))
    r = df.select(T.proper_spans(F.col("a")).alias("s"), x.alias("x"), y.alias("y")).first()
    assert r.s == ["Selm Valley Board of Health", "Selm Valley"] and "valley" not in r.x


def test_answers(spark):
    texts = ["a\nfinal answer: (c)\nFINAL ANSWER: d ", "x\r\nlast  line", "", None, "Verdict ： Leans to undermine."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.answer_letter(F.col("t")).alias("l"), T.last_line(F.col("t"), "FINAL ANSWER:").alias("f"), T.verdict(F.col("t")).alias("v")).collect()
    assert [r.l for r in rows] == ["D", "", "", "", ""]
    assert [r.f for r in rows][:3] == ["d", "last  line", ""] and rows[4].v == "LEANS TO UNDERMINE"


def brute_betweenness(edges):
    """Shortest paths listed one by one."""
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    cost = {(u, v): w for u, v, w in edges}
    best: dict = {}
    for n in range(2, len(nodes) + 1):
        for path in itertools.permutations(nodes, n):
            if all(step in cost for step in itertools.pairwise(path)):
                best.setdefault((path[0], path[-1]), []).append((sum(cost[s] for s in itertools.pairwise(path)), path))
    score = dict.fromkeys(nodes, 0.0)
    for paths in best.values():
        least = min(c for c, _ in paths)
        short = [p for c, p in paths if c == least]
        for p in short:
            for x in p[1:-1]:
                score[x] += 1 / len(short)
    return score


@pytest.mark.parametrize("seed", range(6))
def test_weighted_betweenness_against_listed_paths(seed):
    rng = random.Random(seed)
    edges = [(u, v, rng.randrange(1, 4)) for u in range(6) for v in range(6) if u != v and rng.random() < 0.4]
    got = weighted_betweenness(edges)
    assert got == pytest.approx(brute_betweenness(edges))


def test_links_go_to_first_sayers_and_new_receivers(spark, monkeypatch):
    """A fact kept by its sayer is no uptake; the latest delivered turn of a speaker is the source of one."""
    from tracemill.operators.base import Trace
    from tracemill.plans import views

    said = spark.createDataFrame([("e", a, r, "f") for a, r in (("A", 1), ("B", 1), ("B", 2), ("C", 3))] + [("other", "A", 1, "f")], "execution_id string, agent_id string, round int, fact_id string")
    sent = [("e", "B", 2, "A", 1), ("e", "C", 3, "A", 1), ("e", "C", 3, "B", 1), ("e", "C", 3, "B", 2), ("e", "C", 2, "A", 1)]
    t = Trace(spark, "")
    t.said = said
    t.mentions = said.withColumns({"channel": F.lit("output"), "doc_id": F.lit(None).cast("string")}).unionByName(spark.createDataFrame([("e", None, None, "f", "source", "d1")] * 2, "execution_id string, agent_id string, round int, fact_id string, channel string, doc_id string"))
    t.deliveries = spark.createDataFrame(sent, "execution_id string, listener string, round int, speaker string, sent_round int")
    got = {(r.kind, r.src, r.dst) for r in views.view_links(t).where("execution_id = 'e'").collect()}
    assert got == {("origin", "d1", "A|1"), ("origin", "d1", "B|1"), ("origin", "d1", "C|3"), ("persistence", "B|1", "B|2"), ("transmission", "A|1", "C|3"), ("transmission", "B|2", "C|3")}
    r = views.fact_reach(t).where("execution_id = 'e'").first()
    assert (r.facts, r.dead_ends, r.spread, r.fanout) == (1, 0, 1, 2.0)


def test_a_batch_links_reworded_mentions_to_registered_facts(spark):
    from tracemill.streaming import registry

    old = spark.createDataFrame([("f1", "The old stone bridge opened in 1932."), ("f2", None)], "fact_id string, canonical_text string").withColumn("fact_id", F.coalesce(T.make_fact_id(F.col("canonical_text")), "fact_id"))
    known = old.first().fact_id
    new = spark.createDataFrame([("a", "the old  stone bridge opened in 1932."), ("b", "In 1932 the old stone bridge opened."), ("c", "The bridge opened."), ("d", "Rain fell all week."), ("e", "rain fell ALL week."), ("n", None)], "mention_id string, text string")
    links, fresh = registry.register_batch(new, old)
    got = {r.mention_id: r.fact_id for r in links.collect()}
    assert got["a"] == got["b"] == known and got["c"] != known and got["d"] == got["e"] and got["n"] is None
    assert {r.canonical_text for r in fresh.where("fact_id is not null").collect()} == {"The bridge opened.", "Rain fell all week."}
    links, _ = registry.register_batch(new, old, threshold=None)
    assert {r.mention_id for r in links.where(F.col("fact_id") == known).collect()} == {"a"}
    assert registry.register_batch(new.limit(0), old)[0].count() == 0


def test_a_chain_through_many_rounds_is_walked_step_by_step(spark):
    """Plans that hold the step before twice would double with each of the 30 rounds."""
    from tracemill.operators.base import Trace
    from tracemill.plans import review

    weaker = [("e", f"f{i}", f"f{i + 1}", i + 1, i + 2) for i in range(30)]
    # A later end of f1 alone, a way back in time, and a run whose steps don't meet.
    weaker += [("e", "f0", "f1", 1, 9), ("e", "f3", "f0", 4, 1), ("g", "x", "y", 1, 5), ("g", "y", "z", 4, 6)]
    rows = [(e, e, u, v, p, q, "A_ENTAILS_B") if i % 2 else (e, e, v, u, q, p, "B_ENTAILS_A") for i, (e, u, v, p, q) in enumerate(weaker)]
    t = Trace(spark, "")
    t.lifted = spark.createDataFrame(rows, "ea string, eb string, fa string, fb string, ra int, rb int, label string")
    assert {r.execution_id: r.longest for r in review.g_longest_chain(t).collect()} == {"e": 30, "g": 1}
    t.lifted = t.lifted.limit(0)
    assert review.g_longest_chain(t).count() == 0


def test_a_crowd_of_sets_that_all_meet_shuffles_no_pairs(spark):
    """Every two of 1,200 sets share a token of their prefixes; only the few near the threshold may leave the join."""
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(30), 20)) for _ in range(1200)]
    for i in range(0, 1200, 40):
        sets[i] = sorted({*sets[i + 1][1:], rng.randrange(60, 70)})
    rows = [("e1" if i < 3 else "e0", f"m{i:04}", " ".join(f"w{t:02}" for t in w)) for i, w in enumerate(sets)]
    rows += [("e0", "n1", rows[5][2]), ("e0", "n2", None), ("e0", "n3", "-"), (None, "n4", rows[5][2])]
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._gateway

    def written():
        stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    got = {tuple(r)[:3] for r in matching.similar_token_sets(spark.createDataFrame(rows, "execution_id string, mention_id string, text string"), 0.8).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    shuffled = sum(n for k, n in written().items() if k not in before)
    print("bytes shuffled", shuffled)
    assert shuffled < 150_000
    words = {(e, m): set(t.split()) for e, m, t in rows if e and t and t != "-"}
    copies = {("e0", "n1")}
    keys = sorted(k for k in words if k not in copies)
    want = {(e, a, b) for (e, a), (f, b) in itertools.combinations(keys, 2) if e == f and len(words[e, a] & words[f, b]) >= 0.8 * len(words[e, a] | words[f, b]) - 1e-9}
    first = min(m for (e, m), w in words.items() if e == "e0" and w == words["e0", "n1"])
    assert got == want | ({("e0", first, "n1")} if first != "n1" else set()) and len(want) >= 20


def test_candidate_pairs_of_pools_in_chunks(spark):
    """Whole pools, screened or not, and pools in chunks give what all pairs in one block give."""
    rng = np.random.default_rng(5)
    words = [a + b for a in ("Ost", "lüm", "vel", "rud", "kañ", "mås") for b in ("dal", "ford", "gla", "cor", "x")] + ["the", "of", "is", "a"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(230)] + ["the of", "the  of", "", " ", None, "—", "x", "x"] * 2
    rows = [(f"m{n:03}", t, "e" if n % 4 else ("f" if n % 8 else None), f"a{n % 3}", n % 2, "output") for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "mention_id string, text string, execution_id string, agent_id string, round int, channel string")
    known = df.where("execution_id is not null")
    vectors = matching.tfidf(known).groupBy("mention_id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "weight")).alias("v"))
    held = known.join(vectors, "mention_id").select("execution_id", F.lit(0).alias("chunk"), F.col("mention_id").alias("key"), F.col("v.t").alias("terms"), F.col("v.weight").alias("weights"), F.transform(T.tokenize(F.col("text")), lambda x: F.xxhash64(x)).alias("tokens")).toPandas()
    slot = {r[0]: r[2:] for r in rows}
    want = {}
    for pool, part in held.groupby("execution_id"):
        for r in matching._scorer(12)((pool, 0, 0), part.reset_index(drop=True)).itertuples():
            if r.sim >= 0.5 and slot[r.i] != slot[r.j]:
                want[pool, *sorted((r.i, r.j))] = r.sim
    assert len(want) > 300 and {k[0] for k in want} == {"e", "f"}
    for sizes in ({}, {"whole": 2, "rows": 50}, {"whole": 100, "rows": 1_000}):
        assert {(r.pool, r.a, r.b): r.sim for r in matching.candidate_pairs(df, **sizes).collect()} == want
    assert matching.candidate_pairs(df.limit(0)).count() == 0
    alone = spark.createDataFrame([("a", "one", "e", "x", 1, "output"), ("b", "two", "e", "y", 1, "output")], df.schema)
    assert matching.candidate_pairs(alone, whole=1, rows=1).count() == 0


def test_candidate_pairs_spread_no_terms(spark, monkeypatch):
    """Neither a row a term nor a copy of a row for each other chunk of its pool stands in the plan."""
    monkeypatch.setattr(matching, "tfidf", lambda *_: pytest.fail("a row a term"))
    rows = [(f"m{n:03}", f"whales migrate south in winter {n % 90}", "e", f"a{n}", 1, "output") for n in range(200)]
    df = spark.createDataFrame(rows, "mention_id string, text string, execution_id string, agent_id string, round int, channel string")
    for sizes in ({}, {"whole": 100, "rows": 50}):
        got = matching.candidate_pairs(df, **sizes)
        assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() > 1_000
