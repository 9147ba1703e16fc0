"""Mixing sources to target weights.

Method: cube-method balanced sampling. Each source wants so many tokens; every document of it stands in the
mixture as often as the whole part of wanted / present tokens says, and once more with the fraction left over.
Those inclusion probabilities move through the null space of the balancing constraints (token and document
totals of the source) until each is zero or one but for a few, block by block in parallel; the few of all
blocks move on together, and only a landing problem of two or three documents a source remains.

Sizes are tokens of a public tokenizer, whose file is a parameter. Only sums by source reach the driver, and
mix_targets bounds those.
"""

from __future__ import annotations

import base64
import itertools
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.runtime import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that goes with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that one task moves.
BLOCK = 20_000
#: Longest piece given to the tokenizer at once; texts are cut before a blank, which no token crosses to the left.
PIECE = 100_000


def spelling(source: str) -> Column:
    """A source's name whatever its case, blanks around it and hyphens."""
    return F.regexp_replace(F.lower(F.trim(F.col(source))), r"[-\s]+", "_")


def _pieces(text: str) -> Iterator[str]:
    begin = 0
    while len(text) - begin > PIECE:
        end = text.rfind(" ", begin + 1, begin + PIECE)
        end = end if end > begin else begin + PIECE
        yield text[begin:end]
        begin = end
    yield text[begin:]


def token_counts(documents: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, kept columns, tokens) of every document, whole texts; null counts none."""
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokenizer).read_bytes().splitlines()) if a}
        encoding = tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [sum(len(encoding.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "tokens"])

    head = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep))
    return documents.select(key, *keep, text).mapInArrow(run, f"{head}, tokens long")


def flight(sizes: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances moved until all but two at most are 0 or 1; sums of chances and of chance * size stay."""
    out = chance.astype(float).tolist()
    sizes = sizes.astype(float).tolist()
    draws = iter(rng.random(len(out) + 8).tolist())
    active: list[int] = []
    for i, c in enumerate(out):
        if not 1e-9 < c < 1 - 1e-9:
            out[i] = float(round(c))
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = [sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min(((1 - out[i]) if d > 0 else out[i]) / abs(d) for i, d in zip(active, u) if d)
        down = min((out[i] if d > 0 else (1 - out[i])) / abs(d) for i, d in zip(active, u) if d)
        step = up if next(draws) * (up + down) < down else -down
        left = []
        for i, d in zip(active, u):
            x = out[i] + step * d
            if x < 1e-9 or x > 1 - 1e-9:
                out[i] = float(round(x))
            else:
                out[i] = x
                left.append(i)
        active = left
    return np.array(out)


def landing(sizes: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The choice for the few left (at most two after a flight) whose tokens, then documents, come nearest to what is due."""
    open_ = np.flatnonzero((chance > 0) & (chance < 1))
    due, number = float((sizes[open_] * chance[open_]).sum()), float(chance[open_].sum())
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda s: (abs(float(np.dot(sizes[open_], s)) - due), abs(sum(s) - number)))
    chance = chance.copy()
    chance[open_] = best
    return chance


def _mover(seed: int, land: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def move(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("key", kind="stable")
        rng = np.random.default_rng([seed, int(block.block.iloc[0]) & 0x7FFFFFFF, len(block)])
        sizes = block.tokens.to_numpy()
        moved = flight(sizes, block.chance.to_numpy(), rng)
        return block.assign(chance=landing(sizes, moved) if land else moved)

    return move


def mixture(documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares). drawn(key, source, copies, tokens): documents in the mixture and how often. shares(source,
    target_share, wanted_share, actual_share, tokens, documents, drawn_documents, max_repeats): a row a target.

    The total is the largest at which no source needs more than max_repeats copies of a document, unless given;
    then a source that can't reach its part gives all it may. Targets without documents are reported with an
    actual share of 0 and their part goes to the others in proportion (wanted_share). Sources not named, null
    sources, null keys, blank texts and targets with null or non-positive share or repeats take no part; a
    repeated target row counts once. Empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixture")
    named = targets.where("source is not null").select(spelling("source").alias("src"), "target_share", "max_repeats").groupBy("src").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = {r.src: r for r in named.collect()}
    usable = [s for s, r in wanted.items() if (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0]
    rows = documents.where(F.col(key).isNotNull() & F.trim(F.coalesce(F.col(text), F.lit(""))).rlike(r"\S")).select(F.col(key).alias("key"), spelling(source).alias("src"), F.col(text).alias("text")).where(F.col("src").isin(usable))
    sized = scratch.keep(token_counts(rows, "key", "text", ("src",), tokenizer=tokenizer).where("tokens > 0"))
    sums = {r.src: r for r in sized.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    whole = sum(wanted[s].target_share for s in sums)
    share = {s: wanted[s].target_share / whole for s in sums}
    total = total_tokens or min((wanted[s].max_repeats * sums[s].tokens / share[s] for s in sums), default=0)
    rate = {s: min(float(wanted[s].max_repeats), total * share[s] / sums[s].tokens) for s in sums}
    # A rate that is whole but for rounding is whole.
    rate = {s: float(round(r)) if abs(r - round(r)) < 1e-9 else r for s, r in rate.items()}
    plan = spark.createDataFrame([(s, math.floor(r), r - math.floor(r), max(1, math.ceil(sums[s].n / BLOCK))) for s, r in rate.items()], "src string, base int, fraction double, blocks long")
    due = sized.join(F.broadcast(plan), "src")
    state = due.where("fraction > 0").select("key", "src", "tokens", F.col("fraction").alias("chance"), F.pmod(F.xxhash64("key"), "blocks").alias("block"))
    kind = dict(sized.dtypes)["key"]
    schema = f"key {kind}, src string, tokens long, chance double, block long"
    chosen, most, level = [], max([math.ceil(r.n / BLOCK) for r in sums.values()], default=0), 0
    while most:
        last = most <= 1
        state = scratch.keep(state.groupBy("src", "block").applyInPandas(_mover(seed + level, last), schema))
        chosen.append(state.where("chance = 1").select("key", "src"))
        # Two at most of each block stay open, so each level has a ten-thousandth of the one before.
        most, level = 0 if last else math.ceil(2 * most / BLOCK), level + 1
        state = state.where("chance > 0 and chance < 1").withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(max(1, most))))
    extra = spark.createDataFrame([], f"key {kind}, src string")
    for c in chosen:
        extra = extra.unionByName(c)
    drawn = due.select("key", "src", "tokens", "base").join(extra.select("key", "src", F.lit(1).alias("more")), ["key", "src"], "left")
    drawn = drawn.select("key", "src", (F.col("base") + F.coalesce("more", F.lit(0))).alias("copies"), "tokens").where("copies > 0")
    drawn = scratch.keep(drawn)
    got = drawn.groupBy("src").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.sum("copies").alias("documents"), F.count("*").alias("drawn_documents"))
    all_tokens = got.agg(F.sum("tokens")).first()[0] or 0
    info = spark.createDataFrame([(s, r.target_share, share.get(s, 0.0), r.max_repeats) for s, r in wanted.items()], "src string, target_share double, wanted_share double, max_repeats int")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = info.join(got, "src", "left").select(F.col("src").alias("source"), "target_share", "wanted_share", (F.coalesce("tokens", F.lit(0)) / F.lit(max(1, all_tokens))).alias("actual_share"), zero("tokens"), zero("documents"), zero("drawn_documents"), "max_repeats")
    return drawn.select(F.col("key").alias(key), F.col("src").alias("source"), "copies", "tokens"), shares
