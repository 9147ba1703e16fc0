"""Base relations of a trace store: mentions, facts, turns, deliveries, judgements and what follows from them.

Every relation is a lazy plan. Rows of one key are one record. All later operators group by execution (and
agent, round or fact), so they distribute by execution and fact; windows over one execution run only over its
distinct rounds, which are few.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tracemill.functions import text as T
from tracemill.runtime import materialised, table


class Trace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def mentions(self) -> DataFrame:
        """Mentions without their wording, each with the fact it stands for: the one whose row lists it, else the
        fact its own text makes. Written once: texts are read and hashed in that scan only and never shuffled."""

        def build() -> DataFrame:
            m = self.raw("mentions").where("mention_id is not null").select("mention_id", "polarity", "execution_id", "agent_id", "round", "channel", "doc_id", "ord", T.make_fact_id(F.col("text")).alias("made")).distinct()
            return m.join(self.bridge, "mention_id", "left").withColumn("fact_id", F.coalesce("fact_id", "made")).drop("made")

        return materialised(self.spark, self.sf_dir, "mentions", ("mentions", "facts"), build)

    @cached_property
    def bridge(self) -> DataFrame:
        return self.raw("facts").select(F.explode("mention_ids").alias("mention_id"), "fact_id").groupBy("mention_id").agg(F.min("fact_id").alias("fact_id"))

    def texts(self, *columns: str) -> DataFrame:
        """mention_id and these columns of the raw table, a row a mention; the scan reads no other."""
        return self.raw("mentions").where("mention_id is not null").groupBy("mention_id").agg(*(F.min(c).alias(c) for c in columns))

    def worded(self, *columns: str) -> DataFrame:
        """``mentions`` with these columns of the raw table."""
        return self.texts(*columns).join(self.mentions, "mention_id")

    def _records(self, channel: str) -> DataFrame:
        p = {c: F.col(f"provenance.{c}").alias(c) for c in ("execution_id", "agent_id", "round", "channel", "doc_id")}
        r = self.raw("trace_records").where("record_no is not null").where(F.col("provenance.channel") == channel)
        return r.select("record_no", "text", *p.values(), F.col("provenance.extra")["gold"].alias("gold"), F.col("provenance.extra")["from"].alias("sent"))

    @cached_property
    def records(self) -> DataFrame:
        """Records without their texts."""
        p = [F.col(f"provenance.{c}").alias(c) for c in ("execution_id", "agent_id", "round", "channel", "doc_id")]
        return self.raw("trace_records").where("record_no is not null").select("record_no", *p, F.col("provenance.extra")["gold"].alias("gold")).distinct()

    @cached_property
    def turns(self) -> DataFrame:
        t = self._records("output").where("agent_id is not null and round > 0")
        return t.groupBy("record_no").agg(*(F.min(c).alias(c) for c in ("execution_id", "agent_id", "round", "text")))

    @cached_property
    def deliveries(self) -> DataFrame:
        """Which earlier turn an agent had in its context in a round."""
        d = self._records("context").where("sent is not null and agent_id is not null and round > 0")
        parts = F.split("sent", r"\|")
        return d.select("execution_id", F.col("agent_id").alias("listener"), "round", parts[0].alias("speaker"), parts[1].cast("int").alias("sent_round")).distinct()

    @cached_property
    def gold_docs(self) -> DataFrame:
        return self._records("source").where("gold = 'true' and doc_id is not null").select("execution_id", "doc_id").distinct()

    @cached_property
    def debates(self) -> DataFrame:
        return self.raw("debates").where("execution_id is not null").select("execution_id", "case_id", "model", "topology", "panel", "persona", "memory", "rounds", "correct").distinct()

    @cached_property
    def roles(self) -> DataFrame:
        return self.raw("debates").select("execution_id", F.explode("roles").alias("agent_id", "role")).distinct()

    @cached_property
    def agents(self) -> DataFrame:
        return self.mentions.where("agent_id is not null").select("execution_id", "agent_id").distinct()

    @cached_property
    def rounds(self) -> DataFrame:
        """Rounds of each execution, on whatever channel, with their place among them."""
        r = self.mentions.where("round > 0").select("execution_id", "round").distinct()
        return r.withColumn("rk", F.row_number().over(W.partitionBy("execution_id").orderBy("round")))

    @cached_property
    def said(self) -> DataFrame:
        """Distinct (execution, agent, round, fact) over outputs."""
        return self.mentions.where("channel = 'output' and agent_id is not null and round > 0").select("execution_id", "agent_id", "round", "fact_id").distinct()

    @cached_property
    def said_at(self) -> DataFrame:
        """said, with the round's place, the first place of the fact, of the agent's saying it, and the last place of the run."""
        last = self.rounds.groupBy("execution_id").agg(F.max("rk").alias("last_rk"))
        s = self.said.join(self.rounds, ["execution_id", "round"]).join(last, "execution_id")
        return s.withColumns({"first_rk": F.min("rk").over(W.partitionBy("execution_id", "fact_id")), "own_first_rk": F.min("rk").over(W.partitionBy("execution_id", "fact_id", "agent_id"))})

    @cached_property
    def judged(self) -> DataFrame:
        """Judgements with clean labels between two different mentions."""
        label = F.upper(F.trim(F.regexp_replace("relation", T.WHITESPACE, " ")))
        return self.raw("relations").where("a is not null and b is not null and a <> b and relation is not null").select("a", "b", label.alias("label"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "margin_ab", "margin_ba").distinct()

    @cached_property
    def lifted(self) -> DataFrame:
        """Judgements between different facts."""
        of = lambda x: self.mentions.select(F.col("mention_id").alias(x), F.col("fact_id").alias(f"f{x}"), F.col("execution_id").alias(f"e{x}"), F.col("agent_id").alias(f"g{x}"), F.col("round").alias(f"r{x}"), F.col("channel").alias(f"c{x}"))
        return self.judged.join(of("a"), "a").join(of("b"), "b").where("fa <> fb")

    @cached_property
    def grounding(self) -> DataFrame:
        """gold, context or injected for each fact of an execution."""
        m = self.mentions.join(self.gold_docs.withColumn("is_gold", F.lit(1)), ["execution_id", "doc_id"], "left")
        g = m.groupBy("execution_id", "fact_id").agg(F.max(F.when(F.col("channel") == "source", F.coalesce("is_gold", F.lit(0)))).alias("g"))
        return g.select("execution_id", "fact_id", F.when(F.col("g") == 1, "gold").when(F.col("g") == 0, "context").otherwise("injected").alias("grounding"))

    @cached_property
    def contested(self) -> DataFrame:
        return self.lifted.where("label = 'CONTRADICTS'").select(F.explode(F.array("fa", "fb")).alias("fact_id")).distinct()

    @cached_property
    def independent(self) -> DataFrame:
        """Agents that said a fact in the round in which anyone first did."""
        return self.said_at.where("own_first_rk = first_rk").select("execution_id", "fact_id", "agent_id").distinct()

    @cached_property
    def classes(self) -> DataFrame:
        """Five labels of every uttered fact of an execution."""
        s = self.said_at.groupBy("execution_id", "fact_id").agg(F.countDistinct("agent_id").alias("holders"), F.countDistinct(F.when(F.col("own_first_rk") == F.col("first_rk"), F.col("agent_id"))).alias("sources"), F.max((F.col("rk") == F.col("last_rk")).cast("int")).alias("survives"), F.min("first_rk").alias("first_rk"))
        s = s.join(self.grounding, ["execution_id", "fact_id"]).join(self.contested.withColumn("c", F.lit(True)), "fact_id", "left")
        return s.select("execution_id", "fact_id", "grounding", F.when(F.col("sources") > 1, "multi").otherwise("single").alias("support"), F.when(F.col("holders") > 1, "shared").otherwise("private").alias("spread"), F.when(F.col("survives") == 1, "survived").otherwise("dropped").alias("fate"), F.coalesce("c", F.lit(False)).alias("contested"), "sources", "first_rk")

    @cached_property
    def transmissions(self) -> DataFrame:
        """Edges from round to next round: persistence of what the agent said before, else transmission from each who said it."""
        s = self.said_at
        later = s.select("execution_id", "fact_id", F.col("agent_id").alias("b"), F.col("rk").alias("b_rk"), "own_first_rk")
        keep = later.where("own_first_rk < b_rk").select("execution_id", "fact_id", F.col("b").alias("a"), "b", (F.col("b_rk") - 1).alias("rk"), F.lit("persistence").alias("kind"))
        sent = later.where("own_first_rk = b_rk").join(s.select("execution_id", "fact_id", F.col("agent_id").alias("a"), (F.col("rk") + 1).alias("b_rk")), ["execution_id", "fact_id", "b_rk"]).where("a <> b")
        return keep.unionByName(sent.select("execution_id", "fact_id", "a", "b", (F.col("b_rk") - 1).alias("rk"), F.lit("transmission").alias("kind")))

    @cached_property
    def received(self) -> DataFrame:
        """Facts in the turns delivered to a listener, with their speakers."""
        d = self.deliveries.select("execution_id", "listener", "round", "speaker", "sent_round")
        s = self.said.select("execution_id", F.col("agent_id").alias("speaker"), F.col("round").alias("sent_round"), "fact_id")
        return d.join(s, ["execution_id", "speaker", "sent_round"])

    @cached_property
    def uses(self) -> DataFrame:
        """said, each fact held (said before), adopted (new, and delivered) or novel."""
        r = self.received.select("execution_id", F.col("listener").alias("agent_id"), "round", "fact_id").distinct().withColumn("got", F.lit(True))
        u = self.said_at.join(r, ["execution_id", "agent_id", "round", "fact_id"], "left")
        return u.withColumn("use", F.when(F.col("own_first_rk") < F.col("rk"), "held").when(F.col("got"), "adopted").otherwise("novel")).drop("got")

    @cached_property
    def restatements(self) -> DataFrame:
        """Judged pairs of output mentions of two rounds of one execution, the earlier one first: kind is equivalent,
        weaken or strengthen, side is self, peer where the earlier turn was delivered to the later one, or invisible."""
        of = lambda x: self.mentions.where("channel = 'output' and agent_id is not null and round > 0").select(F.col("mention_id").alias(x), F.col("execution_id").alias(f"x{x}"), F.col("fact_id").alias(f"f{x}"), F.col("agent_id").alias(f"g{x}"), F.col("round").alias(f"r{x}"))
        j = self.judged.where("label in ('EQUIVALENT', 'A_ENTAILS_B', 'B_ENTAILS_A')").select("a", "b", "label").join(of("a"), "a").join(of("b"), "b").where("xa = xb and ra <> rb")
        first = F.col("ra") < F.col("rb")
        pick = lambda c, early, late: [F.when(first, F.col(f"{c}a")).otherwise(F.col(f"{c}b")).alias(early), F.when(first, F.col(f"{c}b")).otherwise(F.col(f"{c}a")).alias(late)]
        kind = F.when(F.col("label") == "EQUIVALENT", "equivalent").when((F.col("label") == "A_ENTAILS_B") == first, "weaken").otherwise("strengthen")
        e = j.select(F.col("xa").alias("execution_id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"), *pick("f", "early_fact", "late_fact"), *pick("g", "speaker", "listener"), *pick("r", "sent_round", "round"), kind.alias("kind")).distinct()
        seen = self.deliveries.withColumn("seen", F.lit(True))
        e = e.join(seen, ["execution_id", "listener", "round", "speaker", "sent_round"], "left")
        return e.withColumn("side", F.when(F.col("speaker") == F.col("listener"), "self").when(F.col("seen"), "peer").otherwise("invisible")).drop("seen")

    @cached_property
    def first_said(self) -> DataFrame:
        """The round in which each agent first said a fact."""
        return self.said.groupBy("execution_id", "agent_id", "fact_id").agg(F.min("round").alias("first_round"))

    @cached_property
    def source_facts(self) -> DataFrame:
        return self.mentions.where("channel = 'source'").select("execution_id", "fact_id").distinct()
