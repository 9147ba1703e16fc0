"""Role-game and drug-interaction operators over event logs and runs: parsers, claims, possible worlds, joins, grades."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Wordings that decide results.
ALIGNMENT = r"(?i)^Player ([0-9]) is (not )?(?:(?:a|an|the) )?(?:loyal )?(Good|Evil|Servant|Minion|Assassin)(?: player)?[. ]*$"
EVIL = ("evil", "minion", "assassin")
EVIL_ROLES = ("Minion", "Assassin", "Evil")
ENZYME = r"HTX-\d[A-Z]"


def parse_team(c: Column) -> Column:
    """The sorted seats of the last TEAM: line, null if it names none or one twice."""
    line = F.try_element_at(F.regexp_extract_all(F.upper(c), F.lit(r"TEAM:\s*([0-9 ,]+)"), F.lit(1)), F.lit(-1))
    seats = F.regexp_extract_all(line, F.lit(r"[0-9]+"), F.lit(0))
    return F.when((F.size(seats) > 0) & (F.size(F.array_distinct(seats)) == F.size(seats)), F.array_sort(F.transform(seats, lambda x: x.cast("int"))))


def parse_word(c: Column, field: str, allowed: tuple[str, ...]) -> Column:
    """The last value of a field such as VOTE or MISSION, null unless allowed."""
    word = F.try_element_at(F.regexp_extract_all(F.upper(c), F.lit(rf"{field}:\s*([A-Z]+)"), F.lit(1)), F.lit(-1))
    return F.when(word.isin(*allowed), word)


def parse_alignment(text: Column, polarity: Column) -> Column:
    """(subject, evil) of a whole, unconditional claim of a seat's side; null for others and for a denied role."""
    label = F.lower(F.regexp_extract(text, ALIGNMENT, 3))
    denied = (F.regexp_extract(text, ALIGNMENT, 2) != "") | (polarity == "negate")
    evil = label.isin(*EVIL)
    side = F.when(denied & label.isin("good", "evil"), ~evil).when(~denied, evil)
    return F.when((label != "") & side.isNotNull(), F.struct(F.regexp_extract(text, ALIGNMENT, 1).cast("int").alias("subject"), side.alias("evil")))


def claim_truth(mentions: DataFrame, roles: DataFrame) -> DataFrame:
    """(execution_id, mention_id, speaker_role, subject_role, visibility, truth) of alignment claims.

    mentions(execution_id, mention_id, agent_id, text, polarity, modality, visibility); roles(execution_id, seat, role).
    """
    m = mentions.where("modality in ('assertion', 'belief', 'speculation')").withColumn("c", parse_alignment(F.col("text"), F.col("polarity"))).where("c is not null")
    subject = roles.select("execution_id", F.col("seat").alias("subject"), F.col("role").alias("subject_role"))
    speaker = roles.select("execution_id", F.concat(F.lit("P"), "seat").alias("agent_id"), F.col("role").alias("speaker_role"))
    m = m.withColumn("subject", F.col("c.subject")).join(subject, ["execution_id", "subject"]).join(speaker, ["execution_id", "agent_id"])
    return m.select("execution_id", "mention_id", "agent_id", "speaker_role", "subject", "subject_role", "visibility", (F.col("subject_role").isin(*EVIL_ROLES) == F.col("c.evil")).alias("truth"))


def possible_worlds(events: DataFrame, seats: int = 5, evil: int = 2) -> DataFrame:
    """(execution_id, event_id, worlds): before each event, the evil sets that all missions of earlier batches allow.

    events(execution_id, event_id, quest, proposal, phase, team array<int>, fail_count int). A batch is one (quest,
    proposal, phase); a mission of n fails needs n of an evil set in its team. The table of sets is fixed by the seats.
    """
    sets = events.sparkSession.createDataFrame([(list(c),) for c in itertools.combinations(range(seats), evil)], "world array<int>")
    cut = F.min("event_id").over(W.partitionBy("execution_id", "quest", "proposal", "phase"))
    e = events.select("execution_id", "event_id", cut.alias("cut"))
    r = events.where("phase = 'mission-result' and fail_count > 0").select("execution_id", F.col("event_id").alias("at"), "team", "fail_count")
    # One ruled-out moment for each set and run: the first mission it can't explain.
    bad = r.crossJoin(F.broadcast(sets)).where(F.size(F.array_intersect("world", "team")) < F.col("fail_count")).groupBy("execution_id", "world").agg(F.min("at").alias("at"))
    out = e.join(bad, (e.execution_id == bad.execution_id) & (bad["at"] < e["cut"]), "left").groupBy(e.execution_id, e.event_id).agg(F.count(bad["at"]).alias("gone"))
    n = sum(1 for _ in itertools.combinations(range(seats), evil))
    return out.select("execution_id", "event_id", (F.lit(n) - F.col("gone")).alias("worlds"))


def audit_log(events: DataFrame) -> DataFrame:
    """(execution_id, events, gaps, agent_without_actor, empty_recipients): structural checks of an event log."""
    w = W.partitionBy("execution_id").orderBy("event_id")
    e = events.withColumn("step", F.col("event_id") - F.lag("event_id").over(w))
    c = lambda x: F.count(F.when(x, 1))
    return e.groupBy("execution_id").agg(F.count("*").alias("events"), c(F.col("step") != 1).alias("gaps"), c((F.col("kind") == "agent") & F.col("actor").isNull()).alias("agent_without_actor"), c(F.col("recipients").isNotNull() & (F.size("recipients") == 0)).alias("empty_recipients"))


def enzymes(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(ENZYME), F.lit(0))))


def enzyme_transfer(turns: DataFrame, held: DataFrame) -> DataFrame:
    """(execution_id, agent_id, enzyme, first_round): enzymes an agent names that its own dossier doesn't hold.

    turns(execution_id, agent_id, round, text); held(execution_id, agent_id, text).
    """
    said = turns.select("execution_id", "agent_id", "round", F.explode(enzymes(F.col("text"))).alias("enzyme"))
    own = held.select("execution_id", "agent_id", F.explode(enzymes(F.col("text"))).alias("enzyme")).distinct()
    return said.join(own, ["execution_id", "agent_id", "enzyme"], "left_anti").groupBy("execution_id", "agent_id", "enzyme").agg(F.min("round").alias("first_round"))


def grade(finals: DataFrame, gold: DataFrame) -> DataFrame:
    """(execution_id, verdict, votes, unanimous, correct, named_enzyme) from agents' final texts.

    finals(execution_id, agent_id, text) hold FINAL ANSWER: YES or NO and MECHANISM: ...; gold(execution_id, gold boolean,
    enzyme). The verdict is the majority, ties and no answers give none.
    """
    text = F.upper("text")
    f = finals.select("execution_id", F.regexp_extract(text, r"FINAL ANSWER:\s*\**\s*(YES|NO)", 1).alias("v"), F.regexp_extract(text, r"MECHANISM:\s*([^\n]*)", 1).alias("how"))
    n = f.groupBy("execution_id").agg(F.count(F.when(F.col("v") == "YES", 1)).alias("yes"), F.count(F.when(F.col("v") == "NO", 1)).alias("no"), F.concat_ws(" ", F.collect_list("how")).alias("how"))
    verdict = F.when(F.col("yes") > F.col("no"), True).when(F.col("no") > F.col("yes"), False)
    j = n.join(gold, "execution_id").withColumn("verdict", verdict)
    return j.select("execution_id", "verdict", F.greatest("yes", "no").alias("votes"), (F.least("yes", "no") == 0).alias("unanimous"), F.coalesce(F.col("verdict") == F.col("gold"), F.lit(False)).alias("correct"), F.coalesce(F.col("how").contains(F.upper("enzyme")), F.lit(False)).alias("named_enzyme"))
