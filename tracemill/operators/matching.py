"""Blocking and matching of mentions: TF-IDF vectors, all pairs of a pool in blocks, exact and light matching.

A pool (one execution) may hold a tenth of all mentions, so it never stands in one task: it is cut into chunks,
and each pair of chunks is a task of its own. Each task keeps the best few partners of a row; the final ranking
then sees at most k rows a chunk and row.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracemill.functions import text as T
from tracemill.operators.components import connected
from tracemill.runtime import Scratch, delete

CHUNK = 512
#: Buckets in which tokens are counted, and bits of a set's bitmap.
BUCKETS, BITS = 1 << 20, 128
#: Rows of a chunk of candidate_pairs, most of a pool that stays whole, and of one that is compared without a screen.
ROWS, WHOLE, FEW = 2048, 4096, 128
#: Columns of a screen that a frequent term, or token, has for itself, and those that the others share.
OWN, SHARED = {"terms": 256, "tokens": 192}, {"terms": 256, "tokens": 64}
#: More than what the screens' single precision loses.
SLACK = 1e-3


def word_grams(c: Column) -> Column:
    """Words of two letters or digits at least, and their neighbouring pairs."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def char_grams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words padded by a blank on each side; a padded word shorter than n gives itself once."""
    words = F.transform(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: int) -> Column:
        # A function of one argument: a second would be the position in the array.
        cut = F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))
        return F.when(F.length(w) > n, cut).when((F.length(w) == n) | F.lit(n == low), F.array(w)).otherwise(F.array().cast("array<string>"))

    def grams(w: Column) -> Column:
        return F.concat(*(of(w, n) for n in range(low, high + 1)))

    return F.flatten(F.transform(words, grams))


def tfidf(texts: DataFrame, pool: str = "execution_id", key: str = "mention_id", text: str = "text") -> DataFrame:
    """(pool, key, term, weight): sublinear counts times smooth inverse document frequency, fitted on each pool;
    word and character blocks each of length one, then the whole of length one."""
    kinds = [("w", word_grams), ("c", char_grams)]
    grams = [texts.select(pool, key, F.lit(k).alias("block"), F.explode(g(F.col(text))).alias("term")) for k, g in kinds]
    tf = grams[0].unionByName(grams[1]).groupBy(pool, key, "block", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    n = texts.groupBy(pool).agg(F.count("*").alias("n"))
    df = tf.groupBy(pool, "block", "term").agg(F.count("*").alias("df"))
    w = tf.join(df, [pool, "block", "term"]).join(n, pool).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(W.partitionBy(pool, key, "block"))))
    w = w.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(W.partitionBy(pool, key))))
    return w.select(pool, key, F.concat("block", F.lit(":"), "term").alias("term"), "weight")


def _scorer(k: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def score(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pool, i, j = group
        left, right = rows[rows.chunk == i], rows[rows.chunk == j]
        names = pd.unique(np.concatenate([*rows.terms, np.zeros(0, np.int64)]))
        at = pd.Index(names)

        def matrix(part: pd.DataFrame, terms: str, weights: str | None, index: pd.Index) -> np.ndarray:
            out = np.zeros((len(part), len(index)))
            for r, x in enumerate(part[terms]):
                out[r, index.get_indexer(x)] = 1 if weights is None else part[weights].iloc[r]
            return out

        tokens = pd.Index(pd.unique(np.concatenate([*rows.tokens, np.zeros(0, np.int64)])))
        sim = matrix(left, "terms", "weights", at) @ matrix(right, "terms", "weights", at).T
        a, b = matrix(left, "tokens", None, tokens), matrix(right, "tokens", None, tokens)
        least = np.minimum(a.sum(1)[:, None], b.sum(1)[None])
        # Nine places, so that what is equal but for rounding ties everywhere.
        sim = np.round(np.maximum(sim, np.divide(a @ b.T, least, out=np.zeros_like(sim), where=least > 0)), 9)
        out = []
        for mine, other, s in ((left, right, sim), (right, left, sim.T)) if i != j else ((left, right, sim),):
            keys, others = mine.key.to_numpy(), other.key.to_numpy()
            if i == j:
                np.fill_diagonal(s, -1)
            # The k-th best of each row bounds its candidates, so only those and their ties are ordered.
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(keys), -1.0)
            for r in range(len(keys)):
                near = np.flatnonzero((s[r] >= least[r]) & (s[r] >= 0) & (others != keys[r]))
                for c in near[np.lexsort((others[near], -s[r, near]))[:k]]:
                    out.append((pool, keys[r], others[c], float(s[r, c])))
        return pd.DataFrame(out, columns=["pool", "i", "j", "sim"])

    return score


def _grams(piece: str, low: int = 3, high: int = 5) -> list[str]:
    """``char_grams`` of one word."""
    w = f" {piece} "
    return [g for n in range(low, high + 1) for g in ([w[i : i + n] for i in range(len(w) - n + 1)] if len(w) > n else [w] if len(w) == n or n == low else [])]


def _hashes(strings: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(strings, object), categorize=False) if strings else np.zeros(0, np.uint64)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class _Bags:
    """The terms of rows (words, pieces, tokens), as 64-bit hashes whose last two bits tell the block: words and their
    neighbouring pairs, grams within pieces, tokens. The grams of a piece are remembered."""

    def __init__(self):
        self.pieces: dict[str, np.ndarray] = {}

    def of(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count), sorted by row and term."""
        found = []

        def flat(name: str) -> tuple[np.ndarray, pa.Array]:
            lists = rows.column(name).combine_chunks()
            return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()

        row, words = flat("words")
        coded = words.dictionary_encode()
        h = _hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] >> np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9) + h[1:]
        inside = row[:-1] == row[1:]
        found += [(row, h, 0), (row[:-1][inside], pairs[inside], 0)]
        row, pieces = flat("pieces")
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.pieces) > 500_000:
            self.pieces.clear()
        missing = [x for x in names if x not in self.pieces]
        grams = [_grams(x) for x in missing]
        cuts = np.cumsum([len(g) for g in grams])
        self.pieces.update(zip(missing, np.split(_hashes([x for g in grams for x in g]), cuts[:-1]) if missing else []))
        each = [self.pieces[x] for x in names]
        count = np.array([len(x) for x in each], np.int64)
        at = coded.indices.to_numpy()
        n = count[at]
        h = np.concatenate([*each, np.zeros(0, np.uint64)])[_spread((np.cumsum(count) - count)[at], n)]
        found.append((np.repeat(row, n), h, 1))
        row, tokens = flat("tokens")
        found.append((row, tokens.to_numpy().view(np.uint64), 2))
        row = np.concatenate([r for r, _, _ in found])
        terms, at = np.unique(np.concatenate([h & ~np.uint64(3) | np.uint64(b) for _, h, b in found]), return_inverse=True)
        key, count = np.unique(row * max(1, len(terms)) + at, return_counts=True)
        return key // max(1, len(terms)), terms[key % max(1, len(terms))], count


def _weights(row: np.ndarray, term: np.ndarray, count: np.ndarray, df: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sublinear counts times smooth inverse document frequency; word and character blocks each of length one, then both."""
    block = (term & np.uint64(3)).astype(np.int64)
    w = np.where(block < 2, (1 + np.log(count)) * (np.log((1 + n) / (1 + df)) + 1), 1.0)
    at = row * 3 + block
    w[block < 2] /= np.sqrt(np.bincount(at, w * w))[at[block < 2]]
    blocks = np.bincount(np.unique(at[block < 2]) // 3, minlength=int(row.max(initial=-1)) + 1)
    return np.where(block < 2, w / np.sqrt(np.maximum(blocks, 1))[row], w)


@dataclass
class _Sparse:
    start: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    screen: np.ndarray

    def dots(self, other: _Sparse, i: np.ndarray, j: np.ndarray, step: int = 128) -> np.ndarray:
        """The products of rows i, which ascend, and the other's rows j."""
        out = np.zeros(len(i))
        names = np.zeros(1 + max(self.term.max(initial=0), other.term.max(initial=0)), np.int64)
        for low in range(0, len(self.start) - 1, step):
            begin, end = np.searchsorted(i, [low, low + step])
            if begin == end:
                continue
            high = min(low + step, len(self.start) - 1)
            mine = slice(self.start[low], self.start[high])
            terms = np.unique(self.term[mine])
            names[terms] = np.arange(1, len(terms) + 1)
            dense = np.zeros((high - low, len(terms) + 1))
            dense[np.repeat(np.arange(high - low), np.diff(self.start[low : high + 1])), names[self.term[mine]]] = self.weight[mine]
            for a in range(begin, end, 5_000):
                b = min(a + 5_000, end)
                n = other.start[j[a:b] + 1] - other.start[j[a:b]]
                at = _spread(other.start[j[a:b]], n)
                pair = np.repeat(np.arange(b - a), n)
                out[a:b] = np.bincount(pair, dense[(i[a:b] - low)[pair], names[other.term[at]]] * other.weight[at], b - a)
            names[terms] = 0
        return out


@dataclass
class _Chunk:
    """Rows in the order of their keys. A row's screen has a column for each frequent term, and the length of what it
    has of the other terms of a shared column: the product of two screens is never less than that of the rows."""

    keys: np.ndarray
    size: np.ndarray
    terms: _Sparse
    tokens: _Sparse

    @classmethod
    def made(cls, keys: np.ndarray, size: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, column: np.ndarray) -> _Chunk:
        """term: a number for each term of the pool; column: its column of the screen, those of tokens after the others."""
        parts = []
        first = OWN["terms"] + SHARED["terms"]
        for kind, mine in (("terms", column < first), ("tokens", column >= first)):
            r, w = row[mine], weight[mine]
            wide = OWN[kind] + SHARED[kind]
            c = column[mine] - (first if kind == "tokens" else 0)
            screen = np.sqrt(np.bincount(r * wide + c, w * w, len(keys) * wide)).reshape(-1, wide).astype(np.float32)
            parts.append(_Sparse(np.searchsorted(r, np.arange(len(keys) + 1)), term[mine], w, screen))
        return cls(keys, size, *parts)

    def near(self, other: _Chunk, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, sim) of all pairs of rows at the threshold; of a chunk with itself each pair once."""
        mine, its = (np.where(x.size > 0, x.size, np.inf) for x in (self, other))
        z = self.terms.screen @ other.terms.screen.T
        t = self.tokens.screen @ other.tokens.screen.T
        t += SLACK
        least = np.minimum(mine[:, None], its[None]).astype(np.float32)
        met = (z >= threshold - SLACK) | (t >= threshold * least)
        if other is self:
            met = np.triu(met, 1)
        i, j = np.nonzero(met)
        z, t = z[i, j], t[i, j]
        sim = np.zeros(len(i))
        held = np.flatnonzero(t >= threshold * least[i, j])
        sim[held] = self.tokens.dots(other.tokens, i[held], j[held]) / np.minimum(mine[i[held]], its[j[held]])
        # Where the screen is below the containment, the cosine is too. All else has no containment at the threshold.
        open_ = np.flatnonzero((z >= threshold - SLACK) & (z >= sim - SLACK))
        sim[open_] = np.maximum(sim[open_], self.terms.dots(other.terms, i[open_], j[open_]))
        # Nine places, so that what is equal but for rounding ties everywhere.
        sim = np.round(sim, 9)
        kept = sim >= threshold
        return i[kept], j[kept], sim[kept]

    def best(self, other: _Chunk, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, key, sim): the k best partners at the threshold that a row of one has in the other, both ways."""
        i, j, sim = self.near(other, threshold)
        apart = self.keys[i] != other.keys[j]
        i, j, sim = i[apart], j[apart], sim[apart]
        ways = [(self.keys, other.keys, i, j, sim), (other.keys, self.keys, j, i, sim)]
        if other is self:
            ways = [(self.keys, self.keys, np.append(i, j), np.append(j, i), np.append(sim, sim))]
        out = []
        for mine, its, a, b, s in ways:
            order = np.lexsort((b, -s, a))  # rows stand in the order of their keys
            a, b, s = a[order], b[order], s[order]
            top = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append((mine[a[top]], its[b[top]], s[top]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _columns(terms: np.ndarray, df: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Each term's column of the screen. Terms that are rare share one by ``least``, the smallest hash of the rows they
    stand in: so the grams of one rare word fall into one column, and those of different words seldom."""
    out = np.empty(len(terms), np.int64)
    first = 0
    for kind, mine in (("terms", terms & np.uint64(3) < 2), ("tokens", terms & np.uint64(3) == 2)):
        at = np.flatnonzero(mine)
        out[at] = first + OWN[kind] + (least[at] >> np.uint64(9)).astype(np.int64) % SHARED[kind]
        often = at[np.argsort(-df[at], kind="stable")[: OWN[kind]]]
        out[often] = first + np.arange(len(often))
        first += OWN[kind] + SHARED[kind]
    return out


def _in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows sorted by key, the keys, and the numbers of their tokens."""
    rows = rows.take(pc.sort_indices(rows.column("key")))
    return rows, np.array(rows.column("key").to_pylist(), object), pc.list_value_length(rows.column("tokens")).to_numpy()


def _whole(threshold: float, k: int) -> Callable[[pa.Table], pa.Table]:
    """(pool, i, j, sim) of rows (pool, n, key, words, pieces, tokens) of whole pools."""

    def run(rows: pa.Table) -> pa.Table:
        rows, keys, size = _in_order(rows)
        rows = rows.append_column("code", pc.dictionary_encode(rows.column("pool").combine_chunks()).indices)
        order = np.argsort(rows.column("code").to_numpy(), kind="stable")
        rows, keys, size = rows.take(pa.array(order)), keys[order], size[order]
        code, n = rows.column("code").to_numpy().astype(np.int64), rows.column("n").to_numpy()
        row, term, count = bags.of(rows)
        names, at = np.unique(term, return_inverse=True)
        at = code[row] * max(1, len(names)) + at  # a term of a pool
        _, at, df = np.unique(at, return_inverse=True, return_counts=True)
        weight = _weights(row, term, count, df[at], n[row])
        cuts = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
        parts, pools = [], []
        many = df[at] > 1
        row, term, at, weight = row[many], term[many], at[many], weight[many]
        hashed = _hashes(list(keys))
        for low, high in zip(cuts, cuts[1:]):
            mine = slice(*np.searchsorted(row, [low, high]))
            own, which = np.unique(at[mine], return_inverse=True)
            r, t = row[mine] - low, term[mine]
            if high - low <= FEW:
                got = _few(keys[low:high], size[low:high], r, which, t, weight[mine], len(own), threshold, k)
            else:
                names = np.zeros(len(own), np.uint64)
                names[which] = t
                least = np.full(len(own), np.iinfo(np.uint64).max)
                np.minimum.at(least, which, hashed[low:high][r])
                columns = _columns(names, df[own], least)
                chunk = _Chunk.made(keys[low:high], size[low:high], r, which, weight[mine], columns[which])
                got = chunk.best(chunk, threshold, k)
            parts.append(got)
            pools.append(np.full(len(got[0]), low))
        i, j, sim = (np.concatenate(x) for x in zip(*parts))
        return pa.Table.from_arrays([rows.column("pool").take(pa.array(np.concatenate(pools))), pa.array(i, pa.string()), pa.array(j, pa.string()), pa.array(sim, pa.float64())], ["pool", "i", "j", "sim"])

    bags = _Bags()
    return run


def _few(keys: np.ndarray, size: np.ndarray, row: np.ndarray, at: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_Chunk.best`` of a small pool with itself, without a screen."""
    dense = np.zeros((len(keys), terms))
    dense[row, at] = weight
    token = np.zeros(terms, bool)
    token[at[term & np.uint64(3) == 2]] = True
    words, shared = dense[:, ~token], dense[:, token]
    least = np.minimum(size[:, None], size[None])
    sim = np.round(np.maximum(words @ words.T, np.divide(shared @ shared.T, least, out=np.zeros(least.shape), where=least > 0)), 9)
    sim[keys[:, None] == keys[None]] = -1
    i, j = np.nonzero(sim >= threshold)
    order = np.lexsort((j, -sim[i, j], i))
    i, j = i[order], j[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return keys[i[top]], keys[j[top]], sim[i[top], j[top]]


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI as Spark writes it, and the path on it."""
    return pafs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path.replace("s3a://", "s3://", 1))


def _put(path: str, **arrays: np.ndarray) -> None:
    held = io.BytesIO()
    np.savez(held, **arrays)
    fs, at = _file(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at, compression="zstd") as out:
        out.write(held.getbuffer())


def _get(path: str) -> dict[str, np.ndarray]:
    fs, at = _file(path)
    with fs.open_input_stream(at, compression="zstd") as f:
        return dict(np.load(io.BytesIO(f.read())))


def _counted(folder: str) -> Callable[[pa.Table], pa.Table]:
    """Writes the terms of a chunk's rows; (no, n, path, terms, counts, least) tells in how many of them each stands."""

    def run(rows: pa.Table) -> pa.Table:
        rows, keys, size = _in_order(rows)
        row, term, count = _Bags().of(rows)
        terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
        least = np.full(len(terms), np.iinfo(np.uint64).max)
        np.minimum.at(least, at, _hashes(list(keys))[row])
        path = f"{folder}/{uuid.uuid4().hex}"
        _put(path, keys=keys.astype(str), size=size, start=np.searchsorted(row, np.arange(len(keys) + 1)), at=at.astype(np.int32), terms=terms, count=count.astype(np.min_scalar_type(count.max(initial=0))))
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (terms.view(np.int64), df, (least >> np.uint64(1)).view(np.int64))]
        return pa.Table.from_arrays([rows.column("no")[:1], rows.column("n")[:1], pa.array([path]), *lists], ["no", "n", "path", "terms", "counts", "least"])

    return run


def _weighed(counts: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Beside each chunk (no, n, path) of ``_counted`` writes what the pool says of its terms: number, rows and column.
    A term of one row only has none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if now != r["no"]:
                    now = r["no"]
                    fs, at = _file(f"{counts}/no={now}")
                    names = df = least = np.zeros(0, np.int64)  # no folder where no term stands in two rows
                    if fs.get_file_info(at).type != pafs.FileType.NotFound:
                        held = pq.read_table(at, filesystem=fs, partitioning=None)
                        names, df, least = (held.column(c).to_numpy() for c in ("term", "n", "least"))
                    order = np.argsort(names.view(np.uint64))
                    names, df, least = names.view(np.uint64)[order], df[order], least.astype(np.uint64)[order]
                    columns = _columns(names, df, least)
                terms = _get(r["path"])["terms"]
                at = np.searchsorted(names, terms)
                many = np.append(names, np.uint64(0))[at] == terms
                many &= at < len(names)
                number, rows, column = np.zeros(len(terms), np.int32), np.ones(len(terms), np.int64), np.zeros(len(terms), np.int16)
                number[many], rows[many], column[many] = at[many], df[at[many]], columns[at[many]]
                _put(f"{r['path']}-pool", n=np.array([r["n"]]), number=number, rows=rows, column=column)
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([r["path"]])], ["no", "path"])

    return run


def _compared(threshold: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(no, i, j, sim) of pairs of chunks (no, left, right) of ``_weighed``."""

    def load(path: str) -> _Chunk:
        x, pool = _get(path), _get(f"{path}-pool")
        at, start = x["at"], x["start"]
        row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        df = pool["rows"][at]
        weight = _weights(row, x["terms"][at], x["count"], df, pool["n"])
        kept = df > 1
        at = at[kept]
        return _Chunk.made(x["keys"].astype(object), x["size"], row[kept], pool["number"][at], weight[kept], pool["column"][at].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple[str, _Chunk | None] = ("", None)
        for batch in batches:
            for r in batch.to_pylist():
                if left[0] != r["left"]:
                    left = (r["left"], load(r["left"]))
                i, j, sim = left[1].best(left[1] if r["right"] == r["left"] else load(r["right"]), threshold, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), r["no"]), pa.int32()), pa.array(i, pa.string()), pa.array(j, pa.string()), pa.array(sim, pa.float64())], ["no", "i", "j", "sim"])

    return run


def candidate_pairs(mentions: DataFrame, *, threshold: float = 0.50, top_k: int = 12, pool: str = "execution_id", same_slot_ok: bool = False, whole: int = WHOLE, rows: int = ROWS) -> DataFrame:
    """(pool, a, b, sim), a < b: for each mention its top_k partners of the pool by the larger of TF-IDF cosine and
    token containment, then those at the threshold and of another slot (execution, agent, round, channel).

    Ties go to the smaller id. Same-slot partners use up the top_k, as they rank before the filter. Partners below the
    threshold rank after all others, so only pairs at the threshold are looked for: products of short rows that bound
    both measures screen all pairs of a pool, and what passes is computed exactly. Pools of up to ``whole`` rows are
    compared in one task, several at once; larger ones in chunks of about ``rows``, which tasks read from the shared folder.
    """
    spark = mentions.sparkSession
    scratch = Scratch(spark, "pairs")
    kind = dict(mentions.dtypes)[pool]
    m = scratch.keep(mentions.where(F.col(pool).isNotNull()).select(F.col(pool).alias("pool"), F.col("mention_id").alias("key"), "text"))
    sizes = scratch.keep(m.groupBy("pool").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > whole).orderBy("pool").collect()  # no more than one in ``whole`` rows
    rest = sizes.where(F.col("n") <= whole).agg(F.sum("n")).first()[0] or 0
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)).alias("words")
    pieces = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("pieces")
    tokens = F.transform(T.tokenize(F.col("text")), lambda x: F.xxhash64(x)).alias("tokens")
    columns = ["pool", "n", "key", words, pieces, tokens]
    m = m.where("text is not null and key is not null")
    best = m.join(sizes.where(F.col("n") <= whole), "pool").select(F.pmod(F.xxhash64("pool"), F.lit(max(1, -(-rest // whole)))).alias("group"), *columns)
    best = best.groupBy("group").applyInArrow(_whole(threshold, top_k), f"pool {kind}, i string, j string, sim double")
    if large:
        numbers = spark.createDataFrame([(r.pool, no, r.n, -(-r.n // rows)) for no, r in enumerate(large)], f"pool {kind}, no int, n long, chunks long")
        cut = m.join(F.broadcast(numbers), "pool").select("no", F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk"), *columns)
        folder = scratch.path()
        chunks = scratch.keep(cut.groupBy("no", "chunk").applyInArrow(_counted(folder), "no int, n long, path string, terms array<long>, counts array<long>, least array<long>"))
        shown = chunks.select("no", F.explode(F.arrays_zip("terms", "counts", "least")).alias("x")).groupBy("no", F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"), F.min("x.least").alias("least"))
        shown = scratch.keep(shown.where("n > 1"), by="no")
        made = sum(-(-r.n // rows) for r in large)
        chunks = scratch.keep(chunks.select("no", "n", "path").repartition(min(made, 2_000)).sortWithinPartitions("no").mapInArrow(_weighed(scratch.paths[id(shown)]), "no int, path string"))
        left, right = (chunks.select("no", F.col("path").alias(c)) for c in ("left", "right"))
        pairs = left.join(right, "no").where("left <= right").repartition(min(made * (made + 1) // 2, 2_000)).sortWithinPartitions("left")
        found = scratch.keep(pairs.mapInArrow(_compared(threshold, top_k), "no int, i string, j string, sim double"))
        delete(spark, folder)
        best = best.unionByName(found.join(F.broadcast(numbers), "no").select("pool", "i", "j", "sim"))
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("pool", "i").orderBy(F.desc("sim"), "j"))).where(F.col("rank") <= top_k)
    slot = lambda x: mentions.select(F.col("mention_id").alias(x), F.struct("execution_id", "agent_id", "round", "channel").alias(f"slot_{x}"))
    kept = best.where(F.col("sim") >= threshold)
    if not same_slot_ok:
        kept = kept.join(slot("i"), "i").join(slot("j"), "j").where(~F.col("slot_i").eqNullSafe(F.col("slot_j")))
    return kept.groupBy("pool", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("sim").alias("sim"))


def registry_pairs(mentions: DataFrame, registered: DataFrame, *, threshold: float = 0.70, top_k: int = 12) -> DataFrame:
    """(a, b, text_a, text_b, sim): for each mention its top_k facts of registered(fact_id, canonical_text), whatever the
    execution, by the larger of TF-IDF cosine (fitted on both) and token containment, then those at the threshold.

    Each pair of a chunk of mentions and a chunk of facts is a task. Ties go to the smaller fact id.
    """
    sides = [mentions.select(F.concat(F.lit("m"), "mention_id").alias("key"), "text"), registered.select(F.concat(F.lit("r"), "fact_id").alias("key"), F.col("canonical_text").alias("text"))]
    sides = [s.where("key is not null and text is not null").dropDuplicates(["key"]).withColumn("pool", F.lit("all")) for s in sides]
    chunks = [max(1, -(-s.count() // CHUNK)) for s in sides]
    both = sides[0].unionByName(sides[1])
    vectors = tfidf(both, "pool", "key").groupBy("key").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "weight")).alias("v"))

    def spread(side: DataFrame, mine: str, other: str, count: int, first: int, others: int, first_other: int) -> DataFrame:
        x = side.join(vectors, "key").select("pool", "key", F.col("v.t").alias("terms"), F.col("v.weight").alias("weights"), F.transform(T.tokenize(F.col("text")), lambda w: F.xxhash64(w)).alias("tokens"))
        x = x.withColumn("chunk", (F.lit(first) + F.pmod(F.xxhash64("key"), F.lit(count))).cast("int"))
        return x.withColumn(mine, F.col("chunk")).withColumn(other, F.explode(F.sequence(F.lit(first_other), F.lit(first_other + others - 1))))

    rows = spread(sides[0], "ci", "cj", chunks[0], 0, chunks[1], chunks[0]).unionByName(spread(sides[1], "cj", "ci", chunks[1], chunks[0], chunks[0], 0))
    best = rows.groupBy("pool", "ci", "cj").applyInPandas(_scorer(top_k), "pool string, i string, j string, sim double").where("i like 'm%'")
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(F.desc("sim"), "j"))).where((F.col("rank") <= top_k) & (F.col("sim") >= threshold))
    texts = lambda s, k, t: s.select(F.col("key").alias(k), F.col("text").alias(t))
    named = best.join(texts(sides[0], "i", "text_a"), "i").join(texts(sides[1], "j", "text_b"), "j")
    return named.select(F.expr("substring(i, 2)").alias("a"), F.expr("substring(j, 2)").alias("b"), "text_a", "text_b", "sim")


def registry_links(judged: DataFrame, *, union_min: float = 0.85) -> DataFrame:
    """(mention_id, fact_id): the closest registered fact b that mention a was judged to equal."""
    same = judged.where((F.col("label") == "EQUIVALENT") & (F.col("confidence") >= union_min))
    return same.groupBy(F.col("a").alias("mention_id")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "b")).alias("x")).select("mention_id", F.col("x.b").alias("fact_id"))


def similar_token_sets(mentions: DataFrame, threshold: float, pool: str = "execution_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(pool, a, b, jaccard), a < b, exact. Mentions of equal tokens (and equal ``also``) are one set, which its smallest
    mention stands for: each other is a row with that one, and pairs are of sets.

    Two sets that reach the threshold share one of their rarest tokens, of which each brings only as many as it could
    lack (prefix filtering), so common tokens are never joined on. A set goes there as a number and a bitmap of its
    tokens: the bits in which two sets differ bound what they share, so of the pairs that meet only those near the
    threshold leave the join, and their words are looked up and compared. Rarity is counted in hash buckets, as any
    order of tokens gives the same pairs. Null pools and texts without a token have no pair.
    """
    scratch = Scratch(mentions.sparkSession, "sets")
    m = mentions.select(pool, F.col("mention_id").alias("id"), T.tokenize(F.col("text")).alias("w"), *(F.coalesce(c, F.lit("")).alias(c) for c in also)).where((F.size("w") > 0) & F.col(pool).isNotNull())
    m = m.withColumn("w", F.array_join("w", " "))  # half the bytes of an array; tokens hold no blanks
    same = W.partitionBy(pool, "w", *also).orderBy("id")
    m = m.withColumns({"rep": F.first("id").over(same), "nth": F.row_number().over(same)})
    m = scratch.keep(m.select(pool, "id", "rep", F.when(F.col("nth") == 1, F.col("w")).alias("w"), F.monotonically_increasing_id().alias("no")))
    copies = m.where("id <> rep").select(pool, F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    sets = m.where("w is not null")
    hashed = m.where("w is not null").select(F.col(pool).alias("pool"), "no", F.transform(F.split("w", " "), lambda x: F.xxhash64(x)).alias("w"))
    df = hashed.select(F.explode("w").alias("t")).groupBy(F.pmod("t", F.lit(BUCKETS)).alias("at")).agg(F.count("*").alias("n")).toPandas()  # a row a bucket at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[df["at"]] = df["n"]
    names = [f"b{k}" for k in range(BITS // 64)]
    prefix = hashed.mapInArrow(_prefixes(counts, threshold), f"pool {dict(mentions.dtypes)[pool]}, no long, n int, t long, {', '.join(f'{b} long' for b in names)}")
    prefix = prefix.select(F.xxhash64("pool", "t").alias("k"), "no", "n", *names)
    x, y = (prefix.select("k", F.col("no").alias(k), F.col("n").alias(f"n{k}"), *(F.col(b).alias(f"{b}{k}") for b in names)) for k in "ab")
    apart = sum((F.bit_count(F.col(f"{b}a").bitwiseXOR(F.col(f"{b}b"))) for b in names), F.lit(0))
    both = F.col("na") + F.col("nb")
    near = (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (both - apart >= 2 * threshold / (1 + threshold) * both - 1e-6)
    pairs = x.join(y, "k").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    of = lambda k: sets.select(F.col(pool).alias(f"pool_{k}"), F.col("no").alias(k), F.col("id").alias(f"id_{k}"), F.col("w").alias(f"w{k}"))
    scored = pairs.join(of("a"), "a").join(of("b"), "b").where("pool_a = pool_b").withColumn("jaccard", T.jaccard(F.split("wa", " "), F.split("wb", " ")))
    return scored.where(F.col("jaccard") >= threshold - 1e-9).select(F.col("pool_a").alias(pool), F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard").unionByName(copies)


def _prefixes(counts: np.ndarray, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sets (pool, no, w: hashes) a row for each of the rarest tokens, as many as the set could lack and one more,
    with the set's size and the bitmap of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column(2)).to_numpy()
            if not len(n):
                continue
            w = batch.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            bits = np.zeros((len(n), BITS // 64), np.uint64)
            h = w.view(np.uint64)
            np.bitwise_or.at(bits, (row, (h >> np.uint64(38)).astype(np.int64) % bits.shape[1]), np.uint64(1) << (h >> np.uint64(32) & np.uint64(63)))
            order = np.lexsort((w, counts[w % len(counts)], row))
            nth = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            keep = order[nth < (n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1)[row]]
            at = pa.array(row[keep])
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(n.astype(np.int32)[row[keep]]), pa.array(w[keep]), *(pa.array(b[row[keep]]) for b in bits.view(np.int64).T)]
            yield pa.RecordBatch.from_arrays(columns, ["pool", "no", "n", "t", *(f"b{k}" for k in range(len(columns) - 4))])

    return run


def strict_subsets(sets: DataFrame, pool: str = "execution_id", key: str = "fact_id") -> DataFrame:
    """(pool, small, large): the words of small, two at least, all stand in large, which has more. sets(pool, key, w).

    A set that holds another holds its rarest word, so sets meet on the rarest word of the smaller one only.
    """
    words = sets.select(pool, key, F.explode("w").alias("word"))
    df = words.groupBy(pool, "word").agg(F.count("*").alias("df"))
    rarest = words.join(df, [pool, "word"]).groupBy(pool, key).agg(F.min(F.struct("df", "word")).alias("r")).select(pool, key, F.col("r.word").alias("word"))
    small = sets.where(F.size("w") >= 2).join(rarest, [pool, key]).select(pool, "word", F.col(key).alias("small"), F.col("w").alias("sw"))
    large = words.select(pool, "word", F.col(key).alias("large"))
    met = small.join(large, [pool, "word"]).join(sets.select(pool, F.col(key).alias("large"), F.col("w").alias("lw")), [pool, "large"])
    return met.where((F.size("sw") < F.size("lw")) & (F.size(F.array_except("sw", "lw")) == 0)).select(pool, "small", "large")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """A plan written to the shared folder and read back."""
    return Scratch(df.sparkSession, tag).keep(df)


def exact_pairs(mentions: DataFrame, pool: str = "execution_id") -> DataFrame:
    """(pool, key, mention_id, first_id): mentions whose words and polarity agree, each with the smallest of them.

    A star in place of all pairs: every mention links to one representative, whatever the group's size.
    """
    keyed = mentions.select(pool, "mention_id", F.concat_ws("|", T.norm_word(F.col("text")), "polarity").alias("key"))
    first = keyed.groupBy(pool, "key").agg(F.min("mention_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, [pool, "key"]).select(pool, "mention_id", "first_id")


def light_match(mentions: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(pool, a, b, relation): close token sets of one run; a clash of polarity contradicts, else they are equivalent."""
    pol = lambda k: mentions.select(F.col("mention_id").alias(k), F.col("polarity").alias(f"p{k}"))
    pairs = similar_token_sets(mentions, threshold, also=("polarity",)).join(pol("a"), "a").join(pol("b"), "b")
    return pairs.select("execution_id", "a", "b", F.when(F.col("pa") != F.col("pb"), "CONTRADICTS").otherwise("EQUIVALENT").alias("relation"))


def pick_canonical(members: DataFrame, group: str) -> DataFrame:
    """(group, mention_id): source mentions first, then most qualifiers, then the longest text, then the first."""
    best = F.min(F.struct((F.col("channel") != "source").alias("s"), (-F.coalesce(F.size("qualifiers"), F.lit(0))).alias("q"), (-F.length("text")).alias("l"), "ord", "mention_id"))
    return members.groupBy(group).agg(best.alias("x")).select(group, "x.mention_id")


def match(mentions: DataFrame, judged: DataFrame, *, union_min: float = 0.85) -> DataFrame:
    """(mention_id, fact_id): clusters of accepted equivalences, each named by its canonical mention's text."""
    edges = judged.where((F.col("label") == "EQUIVALENT") & (F.col("confidence") >= union_min)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected(edges)
    m = mentions.drop("fact_id").join(roots.withColumnRenamed("id", "mention_id"), "mention_id", "left").withColumn("root", F.coalesce("root", "mention_id"))
    named = pick_canonical(m, "root").join(mentions.select("mention_id", T.make_fact_id(F.col("text")).alias("fact_id")), "mention_id").drop("mention_id")
    return m.join(named, "root").select("mention_id", F.col("fact_id"))
