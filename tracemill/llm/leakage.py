"""Evaluation texts leaking into training text.

Method: latent semantic retrieval. Evaluation items are cut into overlapping passages, weighted by TF-IDF
with the document frequencies of the whole corpus, and a randomised SVD, its products computed over the
partitions, gives their latent space. Documents are projected into it twice. Each 13 neighbouring words, by
themselves, are a point; those at the place of 13 neighbouring words of an item are candidates of an exact leak,
and their words are compared. Equal words have equal points whatever stands beside them and whatever the weights,
so no exact leak is lost at any size of the corpus. Each passage, as a whole, is a candidate of a paraphrase by
its cosine to an evaluation passage; longest common subsequence and the answer's presence are then checked.

Passages are two neighbouring blocks of 13 words, so each run of 13 words lies whole in one. Every word has some
weight, the most frequent ones little. The evaluation set is the stated query set: it is taken in blocks of items, so
that what is broadcast (latent space and passages of one block) has a fixed bound; the corpus is read once a block
and never shuffled. The document frequencies of the evaluation set's words are exact; those of all other words, which
only lengthen a document's vector, are counted in 2^20 hash buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracemill.llm._sets import WORD

BUCKETS = 1 << 20
RUN = 13
#: Latent dimensions, and those beyond them that the random range finder takes.
RANK, OVERSAMPLE, POWERS = 256, 64, 2
#: Points of runs are found by a range search along one line through the space: its radius, far above rounding, and
#: most candidates compared at once.
RADIUS, COMPARED = 1e-9, 2_000_000
#: Paraphrases: least cosine, and least share of an evaluation passage's words that are common in order.
PARAPHRASE_COSINE, PARAPHRASE_LCS = 0.5, 0.55
#: Evaluation items a block.
ITEMS = 500
_BASE = 0x9E3779B97F4A7C15


class Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hashed(texts: list[str | None], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    get = known.__getitem__
    for i, text in enumerate(texts):
        if text:
            found = WORD.findall(text.lower())
            counts[i] = len(found)
            flat.extend(map(get, found))
    return np.array(flat, np.uint64), counts


def grams(words: np.ndarray, n: int = RUN) -> np.ndarray:
    """A hash of each n neighbouring words; shorter inputs have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(_BASE) + words[k : k + m]
    return out


class Places:
    """The place of a word: its number in the sorted evaluation vocabulary (hashes), or a bucket behind that."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.present = np.zeros(BUCKETS, bool)
        self.present[(vocabulary % np.uint64(BUCKETS)).astype(np.int64)] = True
        self.size = len(vocabulary) + BUCKETS

    def of(self, words: np.ndarray) -> np.ndarray:
        bucket = (words % np.uint64(BUCKETS)).astype(np.int64)
        out = len(self.vocabulary) + bucket
        some = np.flatnonzero(self.present[bucket])
        if len(some):
            at = np.minimum(np.searchsorted(self.vocabulary, words[some]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == words[some]
            out[some[same]] = at[same]
        return out


def document_frequencies(documents: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents that hold a word of each place, number of documents), over all documents."""
    size = len(vocabulary) + BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(vocabulary)
        counts, docs, known = np.zeros(size, np.int64), 0, Hashes()
        for batch in batches:
            flat, sizes = hashed(batch.column(0).to_pylist(), known)
            docs += batch.num_rows
            key = np.unique(np.repeat(np.arange(len(sizes)), sizes) * size + places.of(flat))
            counts += np.bincount(key % size, minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], docs))], ["place", "n"])

    rows = documents.select(text).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = rows.toPandas()  # at most a row a place, whatever the corpus
    df = np.zeros(size, np.int64)
    real = found.place.to_numpy() >= 0
    df[found.place[real]] = found.n[real]
    return df, int(found.n[~real].sum())


def weights_of(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, smoothed so that none is zero."""
    return np.log(1 + n / (1 + df)).astype(np.float32)


def passages(items: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """(item, word hashes) of each two neighbouring blocks of an item."""
    return [(i, words[s : s + 2 * RUN]) for i, words in items for s in range(0, max(1, len(words) - RUN), RUN) if len(words)]


class Space:
    """The latent space of one block of items: term vectors by bucket, and the passages' unit vectors."""

    def __init__(self, spark, items: list[tuple[int, np.ndarray]], answers: dict[int, str | None], weights: np.ndarray, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        places = Places(vocabulary)
        parts = passages(items)
        at_of = [places.of(w) for _, w in parts]
        self.terms = np.unique(np.concatenate(at_of)) if parts else np.zeros(0, np.int64)
        self.weights = weights[self.terms]
        self.passage_item = np.array([i for i, _ in parts], np.int64)
        self.passage_words = [w for _, w in parts]
        self.answers = answers
        self.passages_of: dict[int, list[int]] = {}
        for k, (i, _) in enumerate(parts):
            self.passages_of.setdefault(i, []).append(k)
        rows = [b.tolist() for b in at_of]
        basis = randomised_svd(spark, rows, self.terms, self.weights)
        self.vectors = (basis * self.weights[:, None]).astype(np.float32)
        at = np.zeros((len(rows), basis.shape[1]), np.float32)
        for k, r in enumerate(rows):
            at[k] = self.vectors[np.searchsorted(self.terms, r)].sum(0)
        self.passage_vectors = at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
        # Runs: the words' coordinate along a line, and the runs in order of theirs.
        line = np.random.default_rng(13).standard_normal(basis.shape[1])
        self.along = self.vectors.astype(np.float64) @ line
        item = [np.full(max(0, len(words) - RUN + 1), i) for i, words in items]
        at = [run_points(self.along[np.searchsorted(self.terms, places.of(words))]) for _, words in items]
        at, run, item = np.concatenate([np.zeros(0), *at]), np.concatenate([np.zeros(0, np.uint64), *(grams(words) for _, words in items)]), np.concatenate([np.zeros(0, np.int64), *item])
        order = np.argsort(at, kind="stable")
        self.run_at, self.run_gram, self.run_item = at[order], run[order], item[order]

    def runs_at(self, at: np.ndarray, run: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which of the given runs, item) for those that are a run of the item: neighbours on the line, then equal words."""
        low, high = np.searchsorted(self.run_at, at - RADIUS, "left"), np.searchsorted(self.run_at, at + RADIUS, "right")
        near = np.flatnonzero(low < high)
        total = np.cumsum((high - low)[near])
        begin = 0
        while begin < len(near):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + COMPARED, "right")))
            some = near[begin:stop]
            n = (high - low)[some]
            which = np.repeat(some, n)
            other = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
            same = self.run_gram[other] == run[which]
            yield which[same], self.run_item[other[same]]
            begin = stop


def run_points(along: np.ndarray) -> np.ndarray:
    """The coordinate of each 13 neighbouring words, always added in their order, so that equal words give equal sums."""
    m = max(0, len(along) - RUN + 1)
    out = np.zeros(m)
    for k in range(RUN):
        out += along[k : k + m]
    return out


def randomised_svd(spark, rows: list[list[int]], terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the TF-IDF passages, rows of length one.

    Each product with the matrix and its transpose runs over the partitions of the passages; the driver sums
    matrices of terms x (rank + oversample), whose size one block of items bounds.
    """
    if not rows or not len(terms):
        return np.zeros((len(terms), 1), np.float32)
    width = min(len(terms), len(rows), RANK + OVERSAMPLE)
    data = spark.createDataFrame([(r,) for r in rows], "terms array<long>").repartition(min(8, len(rows)))

    def product(q: np.ndarray, gram: bool) -> np.ndarray:
        """A'(A q), or with gram (A q)'(A q)."""
        given = spark.sparkContext.broadcast((terms, weights, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, weights, q = given.value
            total = np.zeros((q.shape[1] if gram else len(terms), q.shape[1]))
            for batch in batches:
                a = np.zeros((batch.num_rows, len(terms)))
                for k, r in enumerate(batch.column(0).to_pylist()):
                    at = np.searchsorted(terms, r)
                    np.add.at(a[k], at, weights[at])
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
                y = a @ q
                total += y.T @ y if gram else a.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        parts = data.mapInArrow(run, "part binary").collect()
        given.unpersist()
        return sum(np.frombuffer(p.part).reshape(-1, q.shape[1]) for p in parts)

    q = np.linalg.qr(np.random.default_rng(11).standard_normal((len(terms), width)))[0]
    for _ in range(POWERS):
        q = np.linalg.qr(product(q, False))[0]
    _, turn = np.linalg.eigh(product(q, True))
    return (q @ turn[:, ::-1])[:, :RANK]


def common_in_order(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


LEAK = "item_id long, exact boolean, cosine double, lcs double, answered boolean"


def search(documents: DataFrame, key: str, text: str, space: Space, weights: np.ndarray, paraphrases: bool) -> DataFrame:
    """(key, item_id, exact, cosine, lcs, answered), a row for each passage found."""
    spark = documents.sparkSession
    given = spark.sparkContext.broadcast((space, weights))
    kind = dict(documents.dtypes)[key]

    def chunk(keys: list, texts: list, s: Space, weights: np.ndarray, places: Places, place: np.ndarray, along: np.ndarray, known: Hashes, out: list) -> None:
        flat, counts = hashed(texts, known)
        if not len(flat):
            return
        bucket = places.of(flat)
        ends = np.cumsum(counts)
        starts = ends - counts
        doc = np.repeat(np.arange(len(counts)), counts)
        at = place[bucket]
        done: set = set()
        # Exact leaks: runs of words of the items only, within one document.
        point = along[bucket]
        strange = np.append(0, np.cumsum(np.isnan(point)))
        runs = np.flatnonzero(strange[RUN:] == strange[: max(0, len(strange) - RUN)])
        runs = runs[doc[runs] == doc[runs + RUN - 1]]
        if len(runs):
            point[np.isnan(point)] = 0
            for which, items in s.runs_at(run_points(point)[runs], grams(flat)[runs]):
                for r, item in zip(runs[which].tolist(), items.tolist()):
                    d = int(doc[r])
                    begin, stop = r - (r - int(starts[d])) % RUN, int(ends[d])
                    if (begin, item) not in done:
                        done.add((begin, item))
                        mine = slice(begin, min(begin + 2 * RUN, stop))
                        z, w = s.vectors[at[mine][at[mine] >= 0]].sum(0), weights[bucket[mine]]
                        cosine = (s.passage_vectors[s.passages_of[item]] @ z).max() / max(float(np.sqrt(w @ w)), 1e-9)
                        out.append((keys[d], item, True, float(cosine), 1.0, _answered(s.answers.get(item), flat[begin:stop], known)))
        if not paraphrases:
            return
        nth = np.arange(len(flat)) - starts[doc]
        blocks = (counts + RUN - 1) // RUN
        first = np.cumsum(blocks) - blocks
        block = first[doc] + nth // RUN
        n = int(blocks.sum())
        weight = weights[bucket]
        mass = np.bincount(block, weight * weight, n)
        hit = np.flatnonzero(at >= 0)
        z = np.zeros((n, s.vectors.shape[1]), np.float32)
        if len(hit):
            where, begin = np.unique(block[hit], return_index=True)
            z[where] = np.add.reduceat(s.vectors[at[hit]], begin, axis=0)
        block_doc = np.repeat(np.arange(len(blocks)), blocks)
        pair = np.flatnonzero(block_doc[1:] == block_doc[:-1])
        z[pair] += z[pair + 1]
        mass[pair] += mass[pair + 1]
        inside = np.einsum("ij,ij->i", z, z)
        # No cosine is above the root of the share of the weight that lies in the latent space.
        good = np.flatnonzero(inside >= 0.99 * PARAPHRASE_COSINE**2 * np.maximum(mass, 1e-9))
        if not len(good):
            return
        cosine = (z[good] / np.sqrt(mass[good])[:, None].astype(np.float32)) @ s.passage_vectors.T
        p, q = np.nonzero(cosine >= PARAPHRASE_COSINE)
        for a, b in zip(p.tolist(), q.tolist()):
            g, item = int(good[a]), int(s.passage_item[b])
            d = int(block_doc[g])
            begin = int(starts[d]) + (g - int(first[d])) * RUN
            stop = int(ends[d])
            if (begin, item) not in done:
                words = s.passage_words[b].tolist()
                mine = flat[begin : min(begin + 2 * RUN, stop)].tolist()
                share = common_in_order(mine, words) / max(1, len(words))
                if share >= PARAPHRASE_LCS:
                    out.append((keys[d], item, False, float(cosine[a, b]), share, _answered(s.answers.get(item), flat[begin:stop], known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, weights = given.value
        places = Places(s.vocabulary)
        place = np.full(places.size, -1, np.int32)
        place[s.terms] = np.arange(len(s.terms))
        along = np.full(places.size, np.nan)
        along[s.terms] = s.along
        known = Hashes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list = []
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 300_000 or i == len(texts) - 1:
                    chunk(keys[begin : i + 1], texts[begin : i + 1], s, weights, places, place, along, known, out)
                    begin, size = i + 1, 0
            columns = list(zip(*out)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "item_id", "exact", "cosine", "lcs", "answered"])

    return documents.select(key, text).mapInArrow(run, f"key {kind}, {LEAK}").withColumnRenamed("key", key)


def _answered(answer: str | None, words: np.ndarray, known: Hashes) -> bool | None:
    """Whether the answer's words follow in the rest of the document; null without an answer."""
    wanted = [known[w] for w in WORD.findall((answer or "").lower())]
    if not wanted:
        return None
    return wanted[0] in set(words.tolist()) if len(wanted) == 1 else bool(set(grams(np.array(wanted, np.uint64), len(wanted)).tolist()) & set(grams(words, len(wanted)).tolist()))


def leaks(documents: DataFrame, eval_items: DataFrame, *, key: str = "doc_id", text: str = "text", paraphrases: bool = True) -> DataFrame:
    """(doc_id, item_id, exact, cosine, lcs, answered), the strongest passage of each document and item.

    exact: 13 neighbouring words of the item stand in the document. Otherwise a paraphrase: a passage close in
    the latent space whose words follow those of an evaluation passage. Null and short texts leak nothing
    (an item below 13 words can't leak exactly); rows of one item_id are taken once; empty tables give an
    empty result. Documents count whole, whatever their length.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    rows = {r.item_id: r for r in eval_items.where("item_id is not null and text is not null").select("item_id", "text", "answer").orderBy("item_id", "text").toLocalIterator()}
    known = Hashes()
    items = [(i, hashed([r.text], known)[0]) for i, r in sorted(rows.items())]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in items)]))
    df, n = document_frequencies(docs, text, vocabulary)
    weights = weights_of(df, n)
    found = spark.createDataFrame([], f"{key} {dict(documents.dtypes)[key]}, {LEAK}")
    for at in range(0, len(items), ITEMS):
        part = items[at : at + ITEMS]
        space = Space(spark, part, {i: rows[i].answer for i, _ in part}, weights, vocabulary)
        found = found.unionByName(search(docs, key, text, space, weights, paraphrases))
    best = found.groupBy(key, "item_id").agg(F.max(F.struct("exact", "lcs", "cosine", "answered")).alias("b"))
    return best.select(key, "item_id", "b.exact", "b.cosine", "b.lcs", "b.answered")
