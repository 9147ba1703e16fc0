"""Extract, atomize, identify, annotate and audit: Spark plans around a pluggable extractor, judge and annotator.

An extractor, judge or annotator is a function over a batch; the defaults are deterministic rules. Python is
entered once a batch of an Arrow stream, and failures come out as rows with a status, not as lost rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as S

from tracemill.functions import text as T

Extractor = Callable[[str], list[dict]]
Splitter = Callable[[str], list[str]]
Judge = Callable[[list[tuple[str, str, float]]], list[tuple[bool | None, str | None]]]


def sentence_extractor(text: str) -> list[dict]:
    """Each sentence a proposition, a denial if it holds a negation."""
    out = []
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if s:
            out.append({"text": s, "polarity": "negate" if re.search(r"\b(not|never|no|failed to)\b", s, re.I) else "affirm", "quote": s})
    return out


def extract(records: DataFrame, extractor: Extractor = sentence_extractor, *, attempts: int = 3) -> DataFrame:
    """(execution_id, agent_id, round, channel, doc_id, n, text, polarity, quote, status) of flat records(text, slot columns).

    A record whose extraction fails every attempt gives one row with its error as status; repeated texts of one
    extraction are given once; blank records give nothing.
    """
    slot = ["execution_id", "agent_id", "round", "channel", "doc_id"]
    schema = "execution_id string, agent_id string, round int, channel string, doc_id string, n int, text string, polarity string, quote string, status string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                at = [None if pd.isna(x) else x for x in (r.execution_id, r.agent_id, r.round, r.channel, r.doc_id)]
                if not isinstance(r.text, str) or not r.text.strip():
                    continue
                for k in range(attempts):
                    try:
                        found = extractor(r.text)
                        break
                    except Exception as e:  # noqa: BLE001
                        found = None if k == attempts - 1 else []
                        error = repr(e)
                if found is None:
                    rows.append([*at, 0, None, None, None, error])
                    continue
                seen = set()
                for n, f in enumerate(found, 1):
                    key = " ".join(f["text"].lower().split())
                    if key not in seen:
                        seen.add(key)
                        rows.append([*at, n, f["text"], f.get("polarity", "affirm"), f.get("quote"), "ok"])
            yield pd.DataFrame(rows, columns=[*slot, "n", "text", "polarity", "quote", "status"]).astype({"round": "Int32", "n": "int32"})

    return records.select(*slot, "text").mapInPandas(run, schema)


def conjunction_splitter(text: str) -> list[str]:
    parts = re.split(r",?\s+and\s+(?=[a-z]+\s+(?:was|were|is|are)\b)", re.sub(r"^(?:E\d+|Agent\s+\w+)\s+\w+s\s+that\s+", "", text))
    return [p.strip() for p in parts if p.strip()]


def atomize(mentions: DataFrame, splitter: Splitter = conjunction_splitter) -> DataFrame:
    """mentions with joined propositions split: parts get the id ``parent#n`` and split_from; texts the prefilter
    passes over, and those that come back unchanged, keep their id. One mention of a text stays for each slot."""
    cols = mentions.columns
    schema = mentions.schema.add("split_from", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                parts = splitter(r["text"])
                same = len(parts) <= 1 and (not parts or parts[0].strip().rstrip(".").lower() == r["text"].strip().rstrip(".").lower())
                out += [{**r, "split_from": None}] if same else [{**r, "text": p, "mention_id": f"{r['mention_id']}#{n}", "split_from": r["mention_id"]} for n, p in enumerate(parts, 1)]
            yield pd.DataFrame(out, columns=[*cols, "split_from"])

    joined = mentions.where(T.looks_joined(F.col("text")))
    whole = mentions.where(~T.looks_joined(F.col("text"))).withColumn("split_from", F.lit(None).cast("string"))
    parts = whole.unionByName(joined.mapInPandas(run, schema))
    first = parts.groupBy("execution_id", "agent_id", "round", "channel", T.norm_text_rstrip(F.col("text")).alias("norm")).agg(F.min("mention_id").alias("mention_id"))
    return parts.join(first.select("mention_id"), "mention_id", "left_semi")


#: Word sets, punctuation aside, that are alike by this much say the same, where no judge is given.
SAME = 0.80


def identify(pairs: DataFrame, judge: Judge | None = None, *, batch: int = 16, reject: float = 0.0, accept: float = 1.01) -> DataFrame:
    """(a, b, relation, confidence, note, status) of pairs(a, b, text_a, text_b, sim).

    The judge is asked in batches, and a pair that it leaves out has status missing. Without a judge, word sets alike
    by ``SAME`` are equivalent: a similarity of containment, which a vaguer restatement reaches too, decides nothing.
    The bands are off by default; where set, pairs below ``reject`` are UNRELATED and from ``accept`` on EQUIVALENT unasked.
    """
    kind = T.band(F.col("sim"), reject, accept)
    note = F.lit(None).cast("string").alias("note")
    known = pairs.where(kind != "ask").select("a", "b", kind.alias("relation"), F.col("sim").alias("confidence"), note, F.lit("band").alias("status"))
    asked = pairs.where(kind == "ask").select("a", "b", "text_a", "text_b", "sim")
    if judge is None:
        words = lambda c: T.tokenize(T.norm_word(F.col(c)))
        alike = T.jaccard(words("text_a"), words("text_b"))
        ruled = asked.withColumn("j", alike).select("a", "b", F.when(F.col("j") >= SAME - 1e-9, "EQUIVALENT").otherwise("UNRELATED").alias("relation"), F.greatest("j", "sim").alias("confidence"), note, F.lit("rule").alias("status"))
        return known.unionByName(ruled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                said = judge(list(zip(part.text_a, part.text_b, part.sim)))
                said += [(None, None)] * (len(part) - len(said))
                for (same, note), r in zip(said, part.itertuples(index=False)):
                    relation = None if same is None else "EQUIVALENT" if same else "UNRELATED"
                    out.append((r.a, r.b, relation, r.sim, None if note in (None, "none") else note, "missing" if same is None else "judged"))
            yield pd.DataFrame(out, columns=["a", "b", "relation", "confidence", "note", "status"])

    return known.unionByName(asked.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in known.dtypes)))


@dataclass(frozen=True)
class PropertySpec:
    """A property of facts: boolean, number, string, or a choice of given values."""

    name: str
    description: str
    type: str = "boolean"
    choices: tuple[str, ...] = ()

    def field(self) -> S.StructField:
        if self.type == "choice" and not self.choices:
            raise ValueError(f"property {self.name!r} is of type 'choice' but has no choices")
        kinds = {"boolean": S.BooleanType(), "number": S.DoubleType()}
        return S.StructField(self.name, kinds.get(self.type, S.StringType()))


def annotate(facts: DataFrame, specs: list[PropertySpec], annotator: Callable[[list[str]], list[dict | None]], *, batch: int = 15) -> DataFrame:
    """facts with a struct column ``annotation`` of the specs' types; null where the annotator gave none, and a value
    outside a choice is null. Equal texts are annotated once."""
    inner = S.StructType([s.field() for s in specs])
    schema = S.StructType([S.StructField("canonical_text", S.StringType()), S.StructField("annotation", inner)])
    allowed = {s.name: set(s.choices) for s in specs if s.type == "choice"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = rows.canonical_text.tolist()
            out = []
            for i in range(0, len(texts), batch):
                got = annotator(texts[i : i + batch])
                out += (got + [None] * batch)[: len(texts[i : i + batch])]
            clean = [None if g is None else {s.name: g.get(s.name) if s.name not in allowed or g.get(s.name) in allowed[s.name] else None for s in specs} for g in out]
            yield pd.DataFrame({"canonical_text": texts, "annotation": clean})

    unique = facts.select("canonical_text").where("canonical_text is not null").distinct()
    return facts.join(unique.mapInPandas(run, schema), "canonical_text", "left")


#: Fixed word list: words that tell no two facts apart.
FUNCTION_WORDS = """a an the of in on at to for by with from as is was were are be been being
later then also that which who whom whose and or but not no it its his her
their this these those there here when while during had has have do does did
named called serve served hold held include included""".split()


def missed_merges(facts: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(fact_id, partner_id) of facts(fact_id, canonical_text) that differ in function words and words of three letters
    at most once the names both hold are taken out, and are alike or contained by the threshold.

    Facts that pass have the same other words, names included, so they meet on those alone. Of equal token sets one
    speaks for all, so a set with any share of the facts gives a pair a fact.
    """
    w = facts.where("canonical_text is not null").select("fact_id", F.col("canonical_text").alias("text"), T.tokenize(F.col("canonical_text")).alias("w")).where(F.size("w") > 0)
    content = F.filter("w", lambda x: (F.length(x) > 3) & ~x.isin(FUNCTION_WORDS))
    first = w.groupBy("w").agg(F.min(F.struct("fact_id", "text")).alias("f")).select("w", F.col("f.fact_id").alias("fact_id"), F.col("f.text").alias("text"))
    same = w.join(first.select("w", F.col("fact_id").alias("first")), "w").where("fact_id <> first").select("fact_id", F.col("first").alias("partner_id"))
    keyed = first.select("fact_id", "text", F.array_join(F.array_sort(content), " ").alias("key"))
    met = keyed.join(keyed.select("key", F.col("fact_id").alias("partner_id"), F.col("text").alias("partner")), "key").where("fact_id < partner_id")
    x, y = T.without_shared_names(F.col("text"), F.col("partner"))
    rest = met.select("fact_id", "partner_id", T.tokenize(x).alias("x"), T.tokenize(y).alias("y")).where((F.size("x") > 0) & (F.size("y") > 0))
    alike = F.greatest(T.jaccard(F.col("x"), F.col("y")), T.containment(F.col("x"), F.col("y"))) >= threshold
    return rest.where(alike).select("fact_id", "partner_id").unionByName(same)


def audit(facts: DataFrame, mention_fact: DataFrame, mentions: DataFrame) -> DataFrame:
    """(severity, kind, fact_id, partner_id), by severity and kind: texts that quantify, leave a referent open, join
    predicates outside names or speak of the source, facts two of whose members share under a third of the shorter
    one's tokens, and facts that look like one proposition with a partner."""
    c = F.col("canonical_text")
    plain = F.aggregate(T.proper_spans(c), c, lambda text, name: F.replace(text, name, F.lit(" ")))
    flag = lambda severity, kind, cond: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind")))
    flags = F.array_compact(F.array(
        flag("high", "quantified-aggregate", c.rlike(T.QUANTIFIED)), flag("high", "unresolved-referent", T.unresolved(c)),
        flag("medium", "unsplit-conjunction", plain.rlike(T.CONJUNCTION)), flag("medium", "source-meta", c.rlike(T.SOURCE_META)),
    ))
    texts = facts.select("fact_id", F.explode(flags).alias("f")).select("f.severity", "f.kind", "fact_id")
    # Members of one fact by distinct token set, so that copies are compared once.
    m = mention_fact.join(mentions.select("mention_id", T.tokenize(F.col("text")).alias("w")), "mention_id").select("fact_id", "w").distinct()
    pairs = m.join(m.withColumnRenamed("w", "v"), "fact_id").where("w <> v").groupBy("fact_id").agg(F.min(T.containment(F.col("w"), F.col("v"))).alias("worst"))
    row = lambda severity, kind: [F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), "fact_id"]
    none = F.lit(None).cast("string").alias("partner_id")
    out = texts.select("*", none).unionByName(pairs.where("worst < 0.34").select(*row("high", "suspect-merge"), none))
    out = out.unionByName(missed_merges(facts).select(*row("medium", "possible-missed-merge"), "partner_id"))
    return out.orderBy("severity", "kind", "fact_id")
