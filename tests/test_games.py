import pytest
from pyspark.sql import functions as F

from tracemill.operators import classify, games


def test_parsers(spark):
    df = spark.createDataFrame([("TEAM: 3, 1\nteam: 0 2", "VOTE: approve", "Player 3 is not Good.", "affirm"), ("TEAM: 1, 1", "VOTE: maybe", "If Player 3 is Evil then so", "affirm"), ("none", "", "Player 2 is the Assassin", "negate"), (None, None, "Player 1 is a loyal Servant", "affirm")], "team string, vote string, text string, polarity string")
    rows = df.select(games.parse_team(F.col("team")).alias("t"), games.parse_word(F.col("vote"), "VOTE", ("APPROVE", "REJECT")).alias("v"), games.parse_alignment(F.col("text"), F.col("polarity")).alias("a")).collect()
    assert [r.t for r in rows] == [[0, 2], None, None, None] and [r.v for r in rows] == ["APPROVE", None, None, None]
    assert [r.a and (r.a.subject, r.a.evil) for r in rows] == [(3, True), None, None, (1, False)]


def test_claims_worlds_and_audit(spark):
    roles = spark.createDataFrame([("g", 0, "Merlin"), ("g", 1, "Assassin"), ("g", 2, "Minion"), ("g", 3, "Servant"), ("g", 4, "Servant")], "execution_id string, seat int, role string")
    m = spark.createDataFrame([("g", "m1", "P0", "Player 1 is Evil", "affirm", "assertion", "public"), ("g", "m2", "P1", "Player 0 is Evil", "affirm", "belief", "public"), ("g", "m3", "P1", "Player 0 is Evil", "affirm", "question", "public")], "execution_id string, mention_id string, agent_id string, text string, polarity string, modality string, visibility string")
    assert {r.mention_id: r.truth for r in games.claim_truth(m, roles).collect()} == {"m1": True, "m2": False}
    ev = [("g", 1, 1, 1, "discussion", None, None, "agent", 0, [1]), ("g", 2, 1, 1, "mission-result", [1, 2], 2, "environment", None, []), ("g", 3, 2, 1, "discussion", None, None, "agent", 1, None), ("g", 5, 2, 1, "discussion", None, None, "agent", None, [2])]
    e = spark.createDataFrame(ev, "execution_id string, event_id int, quest int, proposal int, phase string, team array<int>, fail_count int, kind string, actor int, recipients array<int>")
    assert {r.event_id: r.worlds for r in games.possible_worlds(e).collect()} == {1: 10, 2: 10, 3: 1, 5: 1}
    assert games.audit_log(e).first().asDict() == {"execution_id": "g", "events": 4, "gaps": 1, "agent_without_actor": 1, "empty_recipients": 1}


def test_enzymes_and_grades(spark):
    turns = spark.createDataFrame([("r", "A", 2, "htx-3B and HTX-1A"), ("r", "A", 1, "HTX-1A")], "execution_id string, agent_id string, round int, text string")
    held = spark.createDataFrame([("r", "A", "HTX-1A")], "execution_id string, agent_id string, text string")
    assert [tuple(r) for r in games.enzyme_transfer(turns, held).collect()] == [("r", "A", "HTX-3B", 2)]
    f = spark.createDataFrame([("r", "A", "FINAL ANSWER: YES\nMECHANISM: via htx-3b"), ("r", "B", "final answer: **YES"), ("r", "C", "FINAL ANSWER: NO"), ("q", "A", "dunno")], "execution_id string, agent_id string, text string")
    g = spark.createDataFrame([("r", True, "HTX-3B"), ("q", True, None)], "execution_id string, gold boolean, enzyme string")
    got = {r.execution_id: (r.verdict, r.votes, r.unanimous, r.correct, r.named_enzyme) for r in games.grade(f, g).collect()}
    assert got == {"r": (True, 2, False, True, True), "q": (None, 0, True, False, False)}


def test_classifier_beats_the_majority(spark):
    rows = [(f"run{i}", "a" if i % 3 else "b", (2.0 if i % 3 else -2.0) + (i % 5) * 0.1, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows + [("x", None, 1.0, 1.0)], "run string, role string, f double, g double")
    r = classify.leave_one_out(df, "run", "role", ["f", "g"], folds=3).agg(F.sum("n").alias("n"), F.avg("accuracy").alias("a"), F.avg("baseline").alias("b")).first()
    assert r.n == 60 and r.a == pytest.approx(1.0) and r.b < 0.9


def test_as_many_folds_as_runs_leave_each_out_alone(spark):
    rows = [(f"run{i}", "ab"[j % 2], float(j % 2) + i / 100) for i in range(5) for j in range(4)]
    df = spark.createDataFrame(rows, "run string, role string, f double")
    assert [r.n for r in classify.leave_one_out(df, "run", "role", ["f"]).collect()] == [4] * 5
