"""Loaders of task cases: a registry of readers, each giving (case_id, question, items, meta).

``items`` is array<struct<id, text, side, holder>>; holder names the agent who holds an item, null for all. Cases are
drawn by a hash of seed and case, so a draw repeats on any cluster; it is not that of another random generator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ITEM = "struct<id: string, text: string, side: string, holder: string>"
LOADERS: dict[str, Callable[..., DataFrame]] = {}


def loader(name: str):
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LOADERS[name] = f
        return f

    return register


def read_records(spark: SparkSession, path: str, schema: str, wrapped: str | None = None) -> DataFrame:
    """Records of a JSON array, of JSON lines (by the .jsonl ending), or of an object that holds them under a name."""
    reader = spark.read.option("multiLine", not path.endswith(".jsonl"))
    if wrapped:
        return reader.schema(f"`{wrapped}` array<struct<{schema}>>").json(path).select(F.explode(wrapped).alias("r")).select("r.*")
    return reader.schema(schema).json(path)


def draw(cases: DataFrame, n: int | None, seed: int) -> DataFrame:
    """The first n cases in the order of a seeded hash; a limit is what a draw is."""
    ordered = cases.orderBy(F.xxhash64(F.lit(seed), "case_id"), "case_id")
    return ordered if n is None else ordered.limit(n)


def load_cases(spark: SparkSession, name: str, path: str, *, n: int | None = None, seed: int = 0, **options) -> DataFrame:
    if name not in LOADERS:
        raise KeyError(f"no loader {name!r}; there are {', '.join(sorted(LOADERS))}")
    return draw(LOADERS[name](spark, path, **options), n, seed)


def _item(id_: Column, text: Column, side: Column | None = None, holder: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(id_.alias("id"), text.alias("text"), (null if side is None else side).alias("side"), (null if holder is None else holder).alias("holder"))


@loader("perspectrum")
def perspectrum(spark: SparkSession, path: str) -> DataFrame:
    """Distinct cases of debate files, the first file of each claim."""
    schema = "case_id string, claim string, evidence array<struct<id: string, text: string, stance: string>>"
    d = read_records(spark, path, schema).withColumn("file", F.input_file_name())
    first = d.groupBy("case_id").agg(F.min_by(F.struct("claim", "evidence"), "file").alias("d"))
    return first.select("case_id", F.col("d.claim").alias("question"), F.transform("d.evidence", lambda e: _item(e["id"], e["text"], e["stance"])).alias("items"), F.create_map().cast("map<string, string>").alias("meta"))


@loader("multiple_choice")
def multiple_choice(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """Questions whose options become lettered lines."""
    r = read_records(spark, path, "question_id string, question string, options array<string>, answer string, category string")
    if categories:
        r = r.where(F.col("category").isin(categories))
    lines = F.array_join(F.transform("options", lambda x, i: F.concat(F.chr(i + 65), F.lit(". "), x)), "\n")
    return r.select(F.col("question_id").alias("case_id"), F.concat("question", F.lit("\n"), lines).alias("question"), F.array().cast(f"array<{ITEM}>").alias("items"), F.create_map(F.lit("answer"), "answer", F.lit("category"), "category").alias("meta"))


@loader("clinical")
def clinical(spark: SparkSession, path: str, tasks: tuple[str, ...] = ("diagnosis", "treatment"), marker: str = "SUMMARY:") -> DataFrame:
    """One case a record and task; each report section an item, cut where a repeated summary begins."""
    r = read_records(spark, path, "id string, reports map<string, string>")
    sections = F.transform(F.map_entries("reports"), lambda e: _item(e["key"], F.trim(F.split_part(e["value"], F.lit(marker), F.lit(1)))))
    t = r.withColumn("task", F.explode(F.array(*map(F.lit, tasks))))
    return t.select(F.concat_ws("/", "id", "task").alias("case_id"), F.col("task").alias("question"), F.filter(F.array_sort(sections), lambda x: x["text"] != "").alias("items"), F.create_map(F.lit("record"), "id").alias("meta"))


@loader("allocation")
def allocation(spark: SparkSession, path: str) -> DataFrame:
    """Private resources held by their agent, public ones by all, and each agent's positive values of tasks."""
    r = read_records(spark, path, "id string, public array<string>, private map<string, array<string>>, values map<string, map<string, double>>")
    public = F.transform("public", lambda x: _item(F.concat(F.lit("public:"), x), x))
    private = F.flatten(F.transform(F.map_entries("private"), lambda e: F.transform(e["value"], lambda x: _item(F.concat(e["key"], F.lit(":"), x), x, holder=e["key"]))))
    values = F.flatten(F.transform(F.map_entries("values"), lambda e: F.transform(F.filter(F.map_entries(e["value"]), lambda v: v["value"] > 0), lambda v: _item(F.concat(e["key"], F.lit("="), v["key"]), F.concat(v["key"], F.lit(" is worth "), v["value"].cast("string")), holder=e["key"]))))
    return r.select(F.col("id").alias("case_id"), F.lit("allocate").alias("question"), F.concat(public, private, values).alias("items"), F.create_map().cast("map<string, string>").alias("meta"))


@loader("menu")
def menu(spark: SparkSession, path: str) -> DataFrame:
    """Pantry amounts and the non-empty fields known of each guest, the first row of each id."""
    r = read_records(spark, path, "id string, pantry map<string, string>, guests map<string, map<string, string>>").dropDuplicates(["id"])
    pantry = F.transform(F.map_entries("pantry"), lambda e: _item(F.concat(F.lit("pantry:"), e["key"]), F.concat_ws(" ", e["value"], e["key"])))
    guests = F.flatten(F.transform(F.map_entries("guests"), lambda g: F.transform(F.filter(F.map_entries(g["value"]), lambda v: F.coalesce(v["value"], F.lit("")) != ""), lambda v: _item(F.concat_ws(":", g["key"], v["key"]), F.concat_ws(": ", v["key"], v["value"]), holder=g["key"]))))
    return r.select(F.col("id").alias("case_id"), F.lit("menu").alias("question"), F.concat(pantry, guests).alias("items"), F.create_map().cast("map<string, string>").alias("meta"))


@loader("negotiation")
def negotiation(spark: SparkSession, path: str, domains: list[str] | None = None, min_agents: int = 2, max_agents: int = 8) -> DataFrame:
    """Shareable, private and verifiable items of each agent; hidden conditions stay in meta."""
    r = read_records(spark, path, "id string, domain string, task string, hidden string, agents array<struct<name: string, shareable: array<string>, private: array<string>, verifiable: array<string>>>")
    r = r.where(F.size("agents").between(min_agents, max_agents))
    if domains:
        r = r.where(F.col("domain").isin(domains))
    of = lambda a, side: F.transform(F.coalesce(a[side], F.array().cast("array<string>")), lambda x, i: _item(F.concat_ws(":", a["name"], F.lit(side), i.cast("string")), x, F.lit(side), a["name"]))
    items = F.flatten(F.transform("agents", lambda a: F.concat(of(a, "shareable"), of(a, "private"), of(a, "verifiable"))))
    return r.select(F.col("id").alias("case_id"), F.col("task").alias("question"), items.alias("items"), F.create_map(F.lit("domain"), "domain", F.lit("hidden"), "hidden").alias("meta"))


def deal_sample(items: DataFrame, agents: DataFrame, share: float, seed: int) -> DataFrame:
    """(case_id, agent, item): each item to each agent with this chance, by a hash; an item that none got goes to one agent."""
    chance = F.pmod(F.xxhash64(F.lit(seed), "case_id", "agent", "item"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    grid = items.join(agents, "case_id").withColumn("u", chance)
    got = grid.where(F.col("u") < share)
    lost = grid.join(got.select("case_id", "item").distinct(), ["case_id", "item"], "left_anti").groupBy("case_id", "item").agg(F.min_by("agent", F.struct("u", "agent")).alias("agent"))
    return got.select("case_id", "agent", "item").unionByName(lost.select("case_id", "agent", "item"))


def deal_role_aligned(items: DataFrame, agents: DataFrame) -> DataFrame:
    """(case_id, agent, item): items(case_id, item, tags) to the agents(case_id, agent, tags) that share a tag; an item without such goes to all."""
    grid = items.withColumnRenamed("tags", "item_tags").join(agents, "case_id").withColumn("fits", F.coalesce(F.arrays_overlap("item_tags", "tags"), F.lit(False)))
    any_fit = grid.groupBy("case_id", "item").agg(F.bool_or("fits").alias("any"))
    return grid.join(any_fit, ["case_id", "item"]).where("fits or not any").select("case_id", "agent", "item")


def first_rows(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n rows of a Parquet or JSON-lines dataset, in the order of its files; no more files are read than hold them."""
    return (spark.read.json(path) if path.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")) else spark.read.parquet(path)).limit(n)


def cases_of_debates(debates: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """The cases that debates were held on, each once by its first run; ValueError where they aren't those of expected(case_id)."""
    first = debates.where("case_id is not null").groupBy("case_id").agg(F.min_by("evidence", "execution_id").alias("evidence"), F.min_by("gold_perspectives", "execution_id").alias("gold_perspectives"))
    if expected is not None:
        ids = first.select("case_id")
        wrong = [r.case_id for r in ids.exceptAll(expected.select("case_id").distinct()).unionByName(expected.select("case_id").distinct().exceptAll(ids)).limit(5).collect()]
        if wrong:
            raise ValueError(f"cases differ from those expected: {', '.join(map(str, wrong))}, ...")
    return first


def synthetic_cases(spark: SparkSession, positive: int, negative: int, seed: int = 0) -> DataFrame:
    """(case_id, drug_a, drug_b, enzyme_a, enzyme_b, interacts): made-up pairs, which interact where the enzymes are one.

    Every value depends on the seed and the case's number only, so any cluster makes the same cases.
    """
    enzyme = lambda salt: F.concat(F.lit("CYP"), F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "n"), F.lit(40)) + 1)
    d = spark.range(positive + negative).withColumnRenamed("id", "n").withColumn("interacts", F.col("n") < positive)
    other = F.concat(F.lit("CYP"), F.pmod(F.xxhash64(F.lit(seed), F.lit("a"), "n"), F.lit(40)) + 41)
    name = lambda x: F.concat(F.lit(f"drug-{x}-"), F.hex(F.xxhash64(F.lit(seed), F.lit(x), "n")))
    return d.select(F.format_string("case-%05d", "n").alias("case_id"), name("a").alias("drug_a"), name("b").alias("drug_b"), enzyme("a").alias("enzyme_a"), F.when(F.col("interacts"), enzyme("a")).otherwise(other).alias("enzyme_b"), "interacts")
