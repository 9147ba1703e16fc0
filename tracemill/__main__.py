"""Command line: python -m tracemill extract | match | annotate | stats | view. Inputs and outputs are paths Spark can reach."""

from __future__ import annotations

import argparse
import html
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.functions import text as T
from tracemill.operators import matching, pipeline
from tracemill.runtime import ship
from tracemill.sources import stores

PROPERTIES = {"truth": ("boolean", ()), "critical": ("boolean", ()), "relevant": ("boolean", ()), "abstraction": ("choice", ("concrete", "general")), "finding_kind": ("string", ())}


def extract(spark: SparkSession, args: argparse.Namespace) -> int:
    records = stores.read_trace_json(spark, args.trace).select("text", "provenance.*")
    found = pipeline.extract(records)
    ok = found.where("status = 'ok'").withColumn("mention_id", T.make_mention_id(F.col("text"), F.col("execution_id"), F.col("agent_id"), F.col("round"), F.col("channel")))
    ok.drop("status").write.mode("overwrite").parquet(f"{args.output}/mentions")
    found.where("status <> 'ok'").write.mode("overwrite").parquet(f"{args.output}/failures")
    return 0


def match(spark: SparkSession, args: argparse.Namespace) -> int:
    """Candidates, the deterministic judge, clusters; with --store mentions that say a registered fact first get its id, and the rest is clustered."""
    m = spark.read.parquet(f"{args.mentions}/mentions").dropDuplicates(["mention_id"]).withColumns({"qualifiers": F.array().cast("array<string>"), "ord": F.col("n").cast("long")})
    fresh, linked = m, None
    if args.store:
        old = spark.read.parquet(f"{args.store}/facts").select("fact_id", "canonical_text", "polarity")
        said = pipeline.identify(matching.registry_pairs(m, old, threshold=args.threshold, top_k=args.top_k))
        linked = matching.kept(matching.registry_links(said.withColumnRenamed("relation", "label")), "linked")
        fresh = m.join(linked, "mention_id", "left_anti")
    pairs = matching.candidate_pairs(fresh, threshold=args.threshold, top_k=args.top_k)
    text = lambda k: m.select(F.col("mention_id").alias(k), F.col("text").alias(f"text_{k}"))
    judged = pipeline.identify(pairs.join(text("a"), "a").join(text("b"), "b")).withColumnRenamed("relation", "label")
    links = matching.match(fresh, judged.where("label is not null"))
    facts = m.select("mention_id", "text", "polarity").join(links, "mention_id").groupBy("fact_id").agg(F.min(F.when(T.make_fact_id(F.col("text")) == F.col("fact_id"), F.col("text"))).alias("canonical_text"), F.min("polarity").alias("polarity"))
    if args.store:
        links = links.unionByName(linked)
        facts = old.unionByName(facts.join(old.select("fact_id"), "fact_id", "left_anti"))
    stores.write_store({"mentions": m, "mention_fact": links, "facts": facts, "relations": judged}, args.output)
    return 0


def annotate(spark: SparkSession, args: argparse.Namespace) -> int:
    names = [p for p in args.props.split(",") if p]
    if unknown := [p for p in names if p not in PROPERTIES]:
        print(f"unknown properties: {', '.join(unknown)}", file=sys.stderr)
        return 2
    specs = [pipeline.PropertySpec(p, p, *PROPERTIES[p]) for p in names]
    facts = spark.read.parquet(f"{args.store}/facts")
    pipeline.annotate(facts, specs, lambda texts: [{s.name: bool(t) if s.type == "boolean" else None for s in specs} for t in texts]).write.mode("overwrite").parquet(f"{args.output}/facts")
    return 0


def summary(links: DataFrame) -> DataFrame:
    s = links.groupBy("fact_id").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("facts"), F.sum("n").alias("mentions"), F.max("n").alias("largest"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"))


def stats(spark: SparkSession, args: argparse.Namespace) -> int:
    summary(spark.read.parquet(f"{args.store}/mention_fact")).show(truncate=False)
    return 0


def view(spark: SparkSession, args: argparse.Namespace) -> int:
    """A self-contained page of the facts of a store, rows streamed from the cluster."""
    links = spark.read.parquet(f"{args.store}/mention_fact").groupBy("fact_id").agg(F.count("*").alias("n"))
    rows = spark.read.parquet(f"{args.store}/facts").join(links, "fact_id", "left").orderBy(F.desc("n"), "canonical_text")
    with open(args.output, "w", encoding="utf-8") as out:
        out.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(args.title)}</title><h1>{html.escape(args.title)}</h1><table>")
        for r in rows.toLocalIterator():
            out.write(f"<tr><td>{html.escape(r.fact_id or '')}<td>{r.n or 0}<td>{html.escape(r.canonical_text or '')}\n")
        out.write("</table>")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracemill", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(f.__name__)
        for name in positional:
            c.add_argument(name)
        c.set_defaults(run=f)
        return c

    command(extract, "trace").add_argument("-o", "--output", default="mentions")
    c = command(match, "mentions")
    c.add_argument("-o", "--output", default="store")
    c.add_argument("--store")
    c.add_argument("--threshold", type=float, default=0.50)
    c.add_argument("--top-k", type=int, default=12)
    c = command(annotate, "store")
    c.add_argument("--props", default="truth")
    c.add_argument("-o", "--output", default="annotated")
    command(stats, "store")
    c = command(view, "store")
    c.add_argument("-o", "--output", default="store.html")
    c.add_argument("--title", default="facts")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tracemill").getOrCreate()
    ship(spark)
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
