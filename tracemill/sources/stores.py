"""Readers and writers of trace records, mentions, debates and stores, as explicit-schema JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PROVENANCE = "struct<execution_id: string, agent_id: string, round: int, channel: string, doc_id: string, extra: map<string, string>>"
RECORD = f"text string, provenance {PROVENANCE}"
MENTION = f"mention_id string, text string, polarity string, quote string, qualifiers array<string>, provenance {PROVENANCE}"
_MENTION = f"struct<mention_id: string, text: string, polarity: string, quote: string, qualifiers: array<string>, provenance: {PROVENANCE}>"
_FACT = "struct<fact_id: string, canonical_text: string, polarity: string, mention_ids: array<string>, properties: map<string, string>>"
_RELATION = "struct<a: string, b: string, relation: string, confidence: double, rationale: string, properties: map<string, string>>"
STORE = f"mentions map<string, {_MENTION}>, facts map<string, {_FACT}>, mention_to_fact map<string, string>, relations array<{_RELATION}>"
DEBATE = "execution_id string, case_id string, topology string, panel string, memory string, rounds int, roles map<string, string>, evidence array<struct<id: string, text: string, stance: string, tags: array<string>>>, transcript map<string, string>, delivery map<string, struct<source_ids: array<string>, peer_turns: array<string>, self_turn: string, visible_peer_turns: array<string>, visible_self_turns: array<string>>>"


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_trace_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of trace records; a missing execution is exec-0, as in a single-run file."""
    p = F.col("provenance")
    return _json(spark, path, RECORD).withColumn("provenance", p.withField("execution_id", F.coalesce(p["execution_id"], F.lit("exec-0"))))


def read_mentions_json(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, MENTION).select("*", "provenance.*").drop("provenance")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _json(spark, path, schema, lines=True)


def read_store_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """mentions, facts, mention_fact and relations of all store files under a path, each row with its file's stem."""
    raw = _json(spark, path, STORE).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.(?:nli\.)?store\.json$", 1))
    m = raw.select("stem", F.explode(F.map_values("mentions")).alias("m")).select("stem", "m.*").select("*", "provenance.*").drop("provenance")
    f = raw.select("stem", F.explode(F.map_values("facts")).alias("f")).select("stem", "f.*")
    return {
        "mentions": m,
        "facts": f,
        "mention_fact": f.select("stem", F.explode("mention_ids").alias("mention_id"), "fact_id").distinct(),
        "relations": raw.select("stem", F.explode("relations").alias("r")).select("stem", "r.*"),
    }


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under the path; mentions by a bucket of the execution, so that runs prune."""
    for name, df in tables.items():
        if "execution_id" in df.columns:
            df = df.withColumn("bucket", F.pmod(F.xxhash64("execution_id"), F.lit(64)))
            df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str, names: tuple[str, ...] = ("mentions", "facts", "mention_fact", "relations")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").drop("bucket") for n in names}


def read_debate_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """debates, turns ('A|1' keys split), and deliveries, what a slot was sent and may still see."""
    raw = _json(spark, path, DEBATE).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.debate\.json$", 1))
    slot = lambda c: (F.split(c, r"\|")[0], F.split(c, r"\|")[1].cast("int"))
    turns = raw.select("stem", "execution_id", F.explode("transcript").alias("slot", "text"))
    turns = turns.select("stem", "execution_id", slot("slot")[0].alias("agent_id"), slot("slot")[1].alias("round"), "text")
    d = raw.select("stem", "execution_id", F.explode("delivery").alias("slot", "d"))
    seen = F.coalesce("d.visible_peer_turns", "d.peer_turns")
    d = d.select("stem", "execution_id", slot("slot")[0].alias("listener"), slot("slot")[1].alias("round"), F.explode_outer(seen).alias("peer"), "d.source_ids")
    d = d.select("stem", "execution_id", "listener", "round", slot("peer")[0].alias("speaker"), slot("peer")[1].alias("sent_round"), "source_ids")
    return {"debates": raw.drop("transcript", "delivery"), "turns": turns, "deliveries": d}


def pair_by_stem(stores: DataFrame, debates: DataFrame) -> DataFrame:
    """Rows of stores whose run has a debate file of the same stem."""
    return stores.join(debates.select("stem").distinct(), "stem", "left_semi")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def attach_labels(facts: DataFrame, labels: DataFrame, layer: str) -> DataFrame:
    """facts with a column ``layer``: the label of the fact's id, else that of its text in the same run."""
    by_id = labels.groupBy("execution_id", "fact_id").agg(F.min("label").alias("l1"))
    by_text = labels.groupBy("execution_id", "canonical_text").agg(F.min("label").alias("l2"))
    out = facts.join(by_id, ["execution_id", "fact_id"], "left").join(by_text, ["execution_id", "canonical_text"], "left")
    return out.withColumn(layer, F.coalesce("l1", "l2")).drop("l1", "l2")
