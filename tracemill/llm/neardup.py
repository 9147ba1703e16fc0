"""Near-duplicate records with small edits.

Method: b-bit MinHash. Of 128 minima the low eight bits are kept. A band is some of the minima, drawn from all
128, and gives candidates; the lowest bits are packed in two words, and counting the agreeing bits of two texts gives
the collision-corrected similarity. Candidates that the estimate does not rule out are checked exactly on their
whole word sets, and the links so found are joined into groups.

Texts are split into words and signed once, 136 bytes a text. Bands are searched in waves: what crosses the network
for one text and band is a band key, the id of the word set and the packed bits, 28 bytes, and a wave's shuffle is
gone before the next begins. So the layout is the same at every size: more texts take more bands and waves, not more
minima and not more disk a text. Equal word sets are one text, collapsed batch by batch before the shuffle, so a
group of copies with any share of the rows weighs no more than its share of batches. Buckets are searched whole.
Where a bucket holds so many similar texts that its pairs would outgrow it, the pairs of near neighbours are checked
and joined first; what then still stands in different groups is compared without limit. A bucket that would outgrow
a task is cut into pieces, each searched as a bucket, and then compared as a whole in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracemill.llm._sets import BITS, WordSets, agreeing, least_agreeing, low_bits, minima_of, mix
from tracemill.llm.components import grid_components
from tracemill.runtime import Scratch

ENTRIES = "part int, keys binary, ids binary, bits binary"
_ENTRIES = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("bits", pa.binary())])
#: Texts of one band that a task searches, bands of a wave, and texts of one bucket from which it is cut into pieces.
PART, WAVE, HOT = 500_000, 6, 2_000_000
#: Slots by which a band's keys are counted to find hot ones.
SLOTS = 1 << 16
#: Members of a crowded bucket on either side of a task that compares them.
CROWD = 20_000


def plan_bands(rows: int, threshold: float, recall: float = 0.988) -> list[np.ndarray]:
    """Bands for so many texts, each the positions of its minima: five minima up to a million texts and one more with
    each sixfold growth, as unrelated texts meet in a band with the square of their number, and always enough bands
    that a pair at the very threshold is met with at least this chance; a pair well above it practically always is."""
    width = min(BITS // 4, 5 + max(0, math.ceil(math.log(max(rows, 1) / 1e6) / math.log(6))))
    # Minima agree for equal words, or when eight bits of others do.
    p = threshold + (1 - threshold) / 256
    agree = [math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k) for k in range(BITS + 1)]
    meet = [math.comb(k, width) / math.comb(BITS, width) for k in range(BITS + 1)]
    bands = 1
    while sum(a * (1 - (1 - m) ** bands) for a, m in zip(agree, meet)) < recall:
        bands += 1
    rng = np.random.default_rng(17)
    return [rng.choice(BITS, width, replace=False) for _ in range(bands)]


def set_table(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, id, words) of every text with a word: id numbers its set of words, words holds their 32-bit hashes."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = WordSets(batch.column(1).to_pylist())
            offsets, words = sets.words()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sets.rows)), pa.array(sets.ids()), pa.ListArray.from_arrays(offsets, pa.array(words))], ["key", "id", "words"])

    return texts.select(key, column).mapInArrow(run, f"key {kind}, id long, words array<int>")


def batch_minima(batch: pa.RecordBatch, functions: int, some: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, minima) of the distinct word sets of a batch (id, words)."""
    ids, first = np.unique(batch.column(0).to_numpy(), return_index=True)
    lists = batch.column(1).take(pa.array(first))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
    known, index = np.unique(flat, return_inverse=True)
    return ids, minima_of(mix(known.astype(np.int64).view(np.uint64)), index, starts, functions, some=some)


def sketches(batch: pa.RecordBatch, functions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, minima, packed bits) of the distinct word sets of a batch (id, words)."""
    ids, minima = batch_minima(batch, max(BITS, functions))
    return ids, minima, low_bits(minima)


def signatures(sets: DataFrame) -> DataFrame:
    """(id, minima): the low eight bits of 128 minima of the word sets (id, words), each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, minima, _ = sketches(batch, BITS)
            data = np.ascontiguousarray(minima[:BITS].astype(np.uint8).T)
            offsets = np.arange(0, data.size + 1, BITS, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids), packed], ["id", "minima"])

    return sets.select("id", "words").mapInArrow(run, "id long, minima binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, minima [128, texts]) of a batch of signatures."""
    return batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BITS).T


def band_key(minima: np.ndarray, band: np.ndarray) -> np.ndarray:
    key = np.zeros(minima.shape[1], np.uint64)
    for m in band:
        key = mix(key ^ minima[m].astype(np.uint64))
    return key


def hot_slots(signed: DataFrame, bands: list[np.ndarray], limit: int) -> list[tuple[int, int, int]]:
    """(band, slot, texts) of slots of keys that hold more than some ``limit`` texts: at most 256 a band.

    A partition names the slots with more than a 256th of its rows, so a slot's number is short by that at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((len(bands), SLOTS), np.int32), 0
        for batch in batches:
            ids, minima = _unpacked(batch)
            n += len(ids)
            for b, band in enumerate(bands):
                counts[b] += np.bincount((band_key(minima, band) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.int32)
        band, slot = np.nonzero(counts > n / 256)
        yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(slot), pa.array(counts[band, slot].astype(np.int64))], ["band", "slot", "n"])

    found = signed.mapInArrow(run, "band long, slot long, n long").groupBy("band", "slot").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in found.where(F.col("n") > limit).orderBy("band", "slot").collect()]


class Parts:
    """Which part an entry goes to: a range of one band's keys, or a piece of a hot slot of it."""

    def __init__(self, rows: int, bands: int, hot: list[tuple[int, int, int]], size: int):
        self.splits = max(1, math.ceil(rows / size))
        self.first_hot = bands * self.splits
        self.band_of, self.hot = [], {}
        for band, slot, n in hot:
            pieces = math.ceil(n / size)
            self.hot.setdefault(band, []).append((slot, self.first_hot + len(self.band_of), pieces))
            self.band_of += [band] * pieces

    def of(self, band: int, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        part = band * self.splits + ((keys >> np.uint64(16)) % np.uint64(self.splits)).astype(np.int64)
        for slot, first, pieces in self.hot.get(band, ()):
            at = keys % np.uint64(SLOTS) == np.uint64(slot)
            part[at] = first + (mix(ids[at].view(np.uint64)) % np.uint64(pieces)).astype(np.int64)
        return part

    def band(self, part: int) -> int:
        return part // self.splits if part < self.first_hot else self.band_of[part - self.first_hot]


def band_entries(signed: DataFrame, bands: list[np.ndarray], wave: range, parts: Parts) -> DataFrame:
    """The entries of every text in the bands of a wave, packed by batch and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, minima = _unpacked(batch)
            bits = low_bits(minima)
            out: dict[str, list] = {"part": [], "keys": [], "ids": [], "bits": []}
            for b in wave if len(ids) else ():
                keys = band_key(minima, bands[b])
                part = parts.of(b, keys, ids)
                order = np.argsort(part, kind="stable")
                short = (keys >> np.uint64(32)).astype(np.uint32)
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                for at in np.split(order, cuts):
                    out["part"].append(int(part[at[0]]))
                    out["keys"].append(short[at].tobytes())
                    out["ids"].append(ids[at].tobytes())
                    out["bits"].append(bits[at].tobytes())
            yield pa.RecordBatch.from_pydict(out, _ENTRIES)

    return signed.mapInArrow(run, ENTRIES)


def similar_in_buckets(keys: np.ndarray, ids: np.ndarray, bits: np.ndarray, least: int, groups: np.ndarray | None = None, most: float = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of positions of equal key whose bits agree in at least ``least`` places, and the positions of
    buckets left before their end because they gave more than ``most`` pairs a member.

    All offsets within a bucket are tried, one vector operation each. With ``groups``, pairs within one
    group are left out. Arrays must be sorted by key.
    """
    n = len(keys)
    end = np.searchsorted(keys, keys, side="right")
    start = np.searchsorted(keys, keys, side="left")
    active = np.flatnonzero(end - np.arange(n) > 1)
    given = np.zeros(n, np.int64)
    over = np.zeros(n, bool)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    step = 1
    while len(active):
        other = active + step
        hit = agreeing(bits[active], bits[other]) >= least
        if groups is not None:
            hit &= groups[active] != groups[other]
        if hit.any():
            a, b = active[hit], other[hit]
            left.append(a)
            right.append(b)
            np.add.at(given, start[a], 1)
            full = given[start[a]] > most * (end[a] - start[a])
            over[start[a[full]]] = True
        step += 1
        active = active[active + step < end[active]]
        if over.any():
            active = active[~over[start[active]]]
    rest = np.flatnonzero(over[start])
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)]), rest


FOUND = "a long, b long, bucket long, low long, high long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("a", "b", "bucket", "low", "high")])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def candidates(entries: DataFrame, parts: Parts, least: int) -> DataFrame:
    """Rows (a, b) of ids to check, and rows (a, null, bucket, low, high) of the buckets to search again: crowded
    ones, and all of hot slots, whose other pieces are searched elsewhere."""

    def search(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        whole = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        keys, ids, bits = whole("keys", np.uint32), whole("ids", np.int64), whole("bits", np.uint64).reshape(-1, 2)
        order = np.lexsort((ids, keys))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])
        order = order[new]
        keys, ids, bits = keys[order], ids[order], bits[order]
        a, b, rest = similar_in_buckets(keys, ids, bits, least)
        if part >= parts.first_hot:
            rest = np.arange(len(keys))
        found = np.unique(np.sort(np.stack([ids[a], ids[b]], 1), axis=1), axis=0)
        n, m = len(found), len(rest)
        left = np.arange(n + m) >= n
        column = lambda x, y, null: pa.array(np.concatenate([x, y]), mask=null)
        none = np.zeros(n, np.int64)
        bucket = (np.int64(parts.band(part)) << np.int64(32)) | keys[rest].astype(np.int64)
        sketch = bits[rest].view(np.int64)
        return pa.table([column(found[:, 0], ids[rest], None), column(found[:, 1], np.zeros(m, np.int64), left), *(column(none, x, ~left) for x in (bucket, sketch[:, 0], sketch[:, 1]))], schema=_FOUND)

    return entries.groupBy("part").applyInArrow(search, FOUND)


def search_again(rest: DataFrame, roots: DataFrame, least: int, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of ids of one bucket that are similar and stand in different groups, without a limit.

    Two members of different groups are not both of the bucket's largest one. So those outside it are compared
    with all members, in tasks of so many of either side.
    """
    told = rest.distinct().join(roots.select(F.col("v").alias("a"), "root"), "a", "left").select("bucket", F.col("a").alias("id"), "low", "high", F.coalesce("root", "a").alias("root"))
    sizes = told.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    sizes = sizes.where("most.n < all").select("bucket", F.col("most.root").alias("largest"), F.ceil(F.col("all") / crowd).alias("ms"), F.ceil((F.col("all") - F.col("most.n")) / crowd).alias("ls"))
    told = told.join(sizes, "bucket")
    chunk = lambda n: F.pmod(F.xxhash64("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ["id", "low", "high", "root"]
    members = told.select("bucket", chunk(F.col("ms")).alias("m"), every(F.col("ls")).alias("l"), F.lit(False).alias("asks"), *columns)
    asking = told.where("root <> largest").select("bucket", every(F.col("ms")).alias("m"), chunk(F.col("ls")).alias("l"), F.lit(True).alias("asks"), *columns)

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids, low, high, roots = (group.column(c).to_numpy() for c in columns)
        bits = np.column_stack([low, high]).view(np.uint64)
        mine, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = [np.zeros((0, 2), np.int64)]
        for x in mine.tolist():
            hit = other[(agreeing(bits[x], bits[other]) >= least) & (roots[other] != roots[x])]
            out.append(np.column_stack([np.full(len(hit), ids[x]), ids[hit]]))
        found = np.sort(np.concatenate(out), axis=1)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=_PAIR)

    return members.unionByName(asking).groupBy("bucket", "m", "l").applyInArrow(search, "a long, b long").distinct()


def alike(a: str, b: str, threshold: float) -> F.Column:
    """Whether two arrays of distinct words share at least this part of the words of either."""
    shared = F.size(F.array_intersect(a, b))
    part = round(threshold * 1_000_000)
    return shared.cast("long") * 1_000_000 >= part * (F.size(a) + F.size(b) - shared).cast("long")


def checked(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Those pairs of ids (u, v) whose whole word sets are alike. words(id, words), one row an id."""
    of = lambda x: words.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(alike("a_words", "b_words", threshold)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicate_groups(texts: DataFrame, *, key: str = "key", column: str = "text", threshold: float = 0.8, recall: float = 0.988, scratch: Scratch | None = None) -> DataFrame:
    """(key, group): every record whose group has at least two records, group the smallest key in it.

    Records are linked when the shared part of their distinct words reaches the threshold; a group is all
    that is linked directly or indirectly. Rows of one key are one record. Null and wordless texts belong to
    no group; texts of any length count whole. An empty table gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(texts.sparkSession, "neardup")
    texts = texts.where(F.col(key).isNotNull() & F.col(column).isNotNull())
    sets = scratch.keep(set_table(texts, key, column))
    signed = scratch.keep(signatures(sets))
    rows = signed.count()
    bands = plan_bands(rows, threshold, recall)
    least = least_agreeing(threshold)
    # No slot can be hot among fewer rows.
    parts = Parts(rows, len(bands), hot_slots(signed, bands, HOT) if rows > HOT else [], PART)
    waves = [scratch.keep(candidates(band_entries(signed, bands, range(at, min(at + WAVE, len(bands))), parts), parts, least)) for at in range(0, len(bands), WAVE)]
    scratch.drop(signed)
    found = reduce(DataFrame.unionByName, waves)
    words = lambda pairs: sets.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.first("words").alias("words"))
    pairs = scratch.keep(found.where("b is not null").select("a", "b").distinct())
    links = scratch.keep(checked(pairs, words(pairs), threshold))
    roots = scratch.keep(grid_components(links, scratch))
    rest = found.where("b is null")
    if rest.take(1):
        pairs = scratch.keep(search_again(rest, roots, least))
        roots = scratch.keep(grid_components(links.unionByName(checked(pairs, words(pairs), threshold)), scratch))
    scratch.drop(*waves, pairs)
    named = sets.select("key", "id").distinct().join(roots, F.col("id") == F.col("v"), "left").select("key", F.coalesce("root", "id").alias("root"))
    named = scratch.keep(named)
    groups = named.groupBy("root").agg(F.min("key").alias("group"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(groups, "root").select("key", "group")


def mention_pairs(mentions: DataFrame, *, threshold: float = 0.70) -> DataFrame:
    """(mention_id_a, mention_id_b), a < b: every two mentions of one near-duplicate group.

    A mention's text is followed by its qualifiers; null qualifiers add nothing.
    """
    scratch = Scratch(mentions.sparkSession, "mentions")
    texts = mentions.select("mention_id", F.concat_ws(" ", "text", "qualifiers").alias("text"))
    groups = scratch.keep(near_duplicate_groups(texts, key="mention_id", threshold=threshold, scratch=scratch))
    a, b = groups.select(F.col("key").alias("mention_id_a"), "group"), groups.select(F.col("key").alias("mention_id_b"), "group")
    return a.join(b, "group").where("mention_id_a < mention_id_b").select("mention_id_a", "mention_id_b")
