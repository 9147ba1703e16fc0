"""Components, near-duplicates, history and copies against brute force, and their dirty inputs."""

import hashlib
import json
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import _runs, components, copies, history, neardup
from tracemill.llm._sets import WordSets, agreeing, least_agreeing, low_bits, words
from tracemill.runtime import Scratch


def closure(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("cell", [50, 500_000])
def test_grid_components_match_union_find(spark, cell):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(400)]  # a sorted chain
    links += [(1000, 1000 + i) for i in range(1, 300)]  # a hot vertex
    links += [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(250)]
    df = spark.createDataFrame(links + [(5, 5)], "u long, v long")
    got = {r.v: r.root for r in components.grid_components(df, Scratch(spark, "t"), cell_edges=cell).collect()}
    want = closure([x for x in links if x[0] != x[1]])
    assert got.keys() == want.keys()
    by_root = defaultdict(set)
    for v, root in got.items():
        by_root[root].add(v)
    assert sorted(map(min, by_root.values())) == sorted(set(want.values()))
    assert all(len({want[v] for v in vs}) == 1 for vs in by_root.values())


def test_fact_groups_dirt(spark):
    m = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("e", 5), (None, 6)], "mention_id string, root long")
    rel = spark.createDataFrame(
        [("a", "b", " equivalent\t", None, 1), ("b", "a", "EQUIVALENT", 0.99, 1), ("b", "c", "EQUIVALENT", 0.84, 1), ("c", "c", "EQUIVALENT", 1.0, 1), ("c", None, "EQUIVALENT", 1.0, 1), ("c", "zz", "EQUIVALENT", 1.0, 1), ("d", "zz", "EQUIVALENT", 1.0, 1), ("c", "d", None, 1.0, 1), ("a", "b", "CONTRADICTS", 1.0, 1)],
        "a string, b string, relation string, confidence double, n int",
    )
    facts = spark.createDataFrame([(1, ["d", "nope", None, "e", "e"]), (2, []), (3, None), (4, ["c", "nope"])], "ord long, mention_ids array<string>")
    got = {tuple(r) for r in components.fact_groups(rel, facts, m).collect()}
    assert got == {("a", "a"), ("b", "a"), ("d", "d"), ("e", "d")}
    none = components.fact_groups(rel.limit(0), facts.limit(0), m.limit(0))
    assert none.count() == 0 and none.columns == ["mention_id", "group_id"]


def test_sketch_estimates_similarity():
    base = [f"w{i}" for i in range(60)]
    sets = WordSets([" ".join(base), " ".join(base[:50] + [f"x{i}" for i in range(10)]), " ".join(f"y{i}" for i in range(60)), None, "", "?!"])
    assert sets.rows.tolist() == [0, 1, 2]
    bits = low_bits(sets.minima(128))
    est = 2 * agreeing(bits[[0, 0]], bits[[1, 2]]) / 128 - 1
    assert abs(est[0] - 50 / 70) < 0.25 and abs(est[1]) < 0.3
    assert least_agreeing(0.7) < 109


def _texts(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"n{rng.randrange(4000)}" for _ in range(18)] + ["the", "of", "and"]
        out.append((f"k{i:04d}", " ".join(w)))
        for j in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(9999)}"
            rng.shuffle(v)
            out.append((f"k{i:04d}{j}", " ".join(v).upper()))
    return out


def test_near_duplicate_groups_match_brute_force(spark):
    rows = _texts(1)
    df = spark.createDataFrame(rows + [rows[0], ("z1", None), ("z2", ""), ("z3", " .. "), (None, rows[0][1]), ("z4", "x " * 50_000)], "key string, text string").withColumn("id", F.lit(1)).withColumn("root", F.lit(2)).withColumn("group", F.lit("clash"))
    got = {r.key: r.group for r in neardup.near_duplicate_groups(df, threshold=0.7).collect()}
    sets = {k: set(words(t)) for k, t in rows}
    want = closure([(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.7])
    assert got == want
    assert neardup.near_duplicate_groups(df.limit(0), threshold=0.7).count() == 0


def test_hot_buckets_in_pieces_lose_no_link(spark, monkeypatch):
    """A third of the texts share their bands; buckets are cut into pieces and compared again in small tasks."""
    monkeypatch.setattr(neardup, "HOT", 60)
    monkeypatch.setattr(neardup, "PART", 40)
    base = [f"w{i}" for i in range(40)]
    rows = _texts(8, 60) + [(f"h{i}", " ".join([*base[: 40 - i % 9], f"x{i}"])) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, text string")
    scratch = Scratch(spark, "t")
    signed = scratch.keep(neardup.signatures(neardup.set_table(df, "key", "text")))
    bands = neardup.plan_bands(len(rows), 0.7)
    assert neardup.hot_slots(signed, bands, 60)
    got = {r.key: r.group for r in neardup.near_duplicate_groups(df, threshold=0.7).collect()}
    sets = {k: set(words(t)) for k, t in rows}
    assert got == closure([(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.7])
    rest = spark.createDataFrame([(i, 1, i % 3, 0) for i in range(50)], "a long, bucket long, low long, high long")
    roots = spark.createDataFrame([(i, 100 + (i < 45)) for i in range(50)], "v long, root long")
    pairs = {tuple(r) for r in neardup.search_again(rest, roots, 128, crowd=4).collect()}
    assert pairs == {(a, b) for a in range(45) for b in range(45, 50) if a % 3 == b % 3}


def test_more_texts_take_more_bands_not_more_minima():
    for rows in (10**5, 10**6, 10**8, 10**9):
        bands = neardup.plan_bands(rows, 0.7)
        print(rows, len(bands), "bands of", len(bands[0]), "shuffled at once, bytes a text:", 28 * min(neardup.WAVE, len(bands)), "in all:", 28 * len(bands))
        assert all(len(set(b)) == len(b) and max(b) < 128 for b in bands)


def test_crowded_buckets_are_searched_to_the_end():
    rng = np.random.default_rng(0)
    bits = np.repeat(rng.integers(0, 2**63, (2, 2), dtype=np.uint64), 300, axis=0)  # two crowds of equal sketches
    keys = np.zeros(600, np.uint32)
    a, b, rest = neardup.similar_in_buckets(keys, np.arange(600), bits, 100)
    assert len(rest) == 600 and len(a) < 600 * 40
    groups = np.repeat([0, 1], 300)
    a, b, rest = neardup.similar_in_buckets(keys, np.arange(600), bits, 100, groups, np.inf)
    assert not len(a) and not len(rest)
    groups[:10] = 7
    a, b, _ = neardup.similar_in_buckets(keys, np.arange(600), bits, 100, groups, np.inf)
    assert len(a) == 10 * 290


def test_mention_pairs_count_qualifiers(spark):
    t = "alpha beta gamma delta epsilon zeta eta"
    rows = [("a", t, ["one two"]), ("b", t, ["one two"]), ("c", t, None), ("d", t + " x1 x2 x3 x4", None), ("e", None, None), ("f", t, [None, "three four five six"])]
    df = spark.createDataFrame(rows, "mention_id string, text string, qualifiers array<string>")
    assert {tuple(r) for r in neardup.mention_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def fact_id(text):
    return "f_" + hashlib.sha1(" ".join(text.lower().split()).encode()).hexdigest()[:16]


def brute_history(facts, new):
    accepted, out = [(set(words(t)), f) for _, f, t in facts if t], set()
    for mid, batch, ord_, text in sorted(new, key=lambda r: (r[1], r[2])):
        w = set(words(text))
        hits = {f for s, f in accepted if w and jaccard(s, w) >= 0.7}
        out |= {(mid, f) for f in hits}
        if w and not hits:
            accepted.append((w, fact_id(text)))
    return out


def test_history_matches_sequential_brute_force(spark):
    texts = _texts(5, 50)
    facts = [(i, fact_id(t), t) for i, (_, t) in enumerate(texts[:40])] + [(99, "f_x", None)]
    rng = random.Random(2)
    rest = texts[30:] + [(f"r{i}", t) for i, (_, t) in enumerate(rng.choices(texts[40:], k=25))]
    rng.shuffle(rest)
    new = [(k, 1 + i * 3 // len(rest), i, t) for i, (k, t) in enumerate(rest)]
    f = spark.createDataFrame(facts, "ord long, fact_id string, canonical_text string")
    n = spark.createDataFrame([(b, m, o, t, 1) for m, b, o, t in new + [new[0], ("zz", 1, 9999, None), ("zy", 2, 9998, "...")]], "batch_no int, mention_id string, ord long, text string, id int")
    assert {tuple(r) for r in history.said_already(f, n).collect()} == brute_history(facts, new)
    assert history.said_already(f, n.limit(0)).count() == 0
    assert {tuple(r) for r in history.said_already(f.limit(0), n.where("batch_no = 1")).collect()} == brute_history([], [r for r in new if r[1] == 1])


@pytest.mark.parametrize("most", [2, 16])
def test_leaders_across_batches(spark, most):
    """Pairs with the first few of a prefix, and what stands behind more, wherever Arrow batches begin."""
    rng = random.Random(4)
    rows = [(i, i * 3, [rng.randrange(4)]) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.a, r.b) for r in history.leaders(spark.createDataFrame(rows, "id long, pos long, labels array<long>"), history.MINIMA, most).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = set()
    for p in range(4):
        ids = [i for i, _, (q,) in rows if q == p]
        want |= {(a, b) for n, a in enumerate(ids) for b in ids[: min(n, most)]} | {(a, None) for n, a in enumerate(ids) if n >= most}
    assert got == want


def test_a_crowd_is_decided_in_order(spark, monkeypatch):
    """Many texts of one prefix, more than a round compares."""
    monkeypatch.setattr(history, "LEADERS", 2)
    base = [f"w{i}" for i in range(12)]
    new = [(f"m{i:03d}", 1, i, " ".join(base[: 12 - i % 5] + [f"x{i % 7}", f"y{i * 7 % 60}"])) for i in range(60)]
    n = spark.createDataFrame([(b, m, o, t) for m, b, o, t in new], "batch_no int, mention_id string, ord long, text string")
    f = spark.createDataFrame([], "ord long, fact_id string, canonical_text string")
    assert {tuple(r) for r in history.said_already(f, n).collect()} == brute_history([], new)


@pytest.mark.parametrize("settle", [0, 5_000_000])
def test_batches_of_one_call_are_one_sequence(spark, monkeypatch, settle):
    """Eight batches take no more jobs than two, no label is a row of a plan, and the answer is that of one row after
    another: crowds, waves, sets that come again, and cases of history that are alike to new texts as well."""
    monkeypatch.setattr(history, "LEADERS", 4)
    monkeypatch.setattr(history, "WAVE_FROM", 2000)
    monkeypatch.setattr(history, "FILE_ENTRIES", 3000)
    monkeypatch.setattr(history, "SETTLE", settle)
    texts = _texts(11, 40)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(12)]
    crowd = [" ".join(base[: 12 - i % 5] + [f"x{i % 7}", f"y{i * 7 % 60}"]) for i in range(40)]
    facts = [(i, fact_id(t), t) for i, (_, t) in enumerate(texts[:20])]
    said = [t for _, t in texts[10:]] + crowd
    said += rng.choices(said, k=30)
    rng.shuffle(said)
    f = spark.createDataFrame(facts, "ord long, fact_id string, canonical_text string")
    jobs = []
    for batches in (2, 8):
        new = [(f"m{i}", 1 + i * batches // len(said), i, t) for i, t in enumerate(said)]
        n = spark.createDataFrame([(b, m, o, t) for m, b, o, t in new], "batch_no int, mention_id string, ord long, text string")
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        assert {tuple(r) for r in history.said_already(f, n).collect()} == brute_history(facts, new)
        jobs.append(spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before)
    print("jobs of two and of eight batches", jobs)
    assert jobs[1] <= jobs[0] + 2
    sets = spark.createDataFrame([(1, 1, [1, 2], 0, 0)], "id long, pos long, words array<int>, low long, high long")
    assert "Generate" not in history.leaders(sets, 5)._jdf.queryExecution().toString()


def test_forest_is_opened_again_and_reads_what_a_batch_hits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "LABEL_GROUP", 64)
    monkeypatch.setattr(history, "TEXT_GROUP", 16)
    texts = _texts(7, 3000)
    read = []
    for n in (400, 4000):
        facts = [(i, fact_id(t), t) for i, (_, t) in enumerate(texts[:n])]
        batches = [[(f"m{b}{k}", b, k, t) for k, (_, t) in enumerate(texts[at : at + 20] + texts[4500 + at : 4510 + at])] for b, at in ((1, 100), (2, 300))]
        f = spark.createDataFrame(facts, "ord long, fact_id string, canonical_text string")
        path = f"file://{tmp_path}/{n}"
        frame = lambda rows: spark.createDataFrame([(b, m, o, t) for m, b, o, t in rows], "batch_no int, mention_id string, ord long, text string")
        got = history.said_already(f, frame(batches[0]), path=path).collect()
        forest = history.HashForest.open(spark, path)
        got += history.check_batches(forest, frame(batches[1])).collect()
        assert {tuple(r) for r in got} == brute_history(facts, batches[0] + batches[1])
        read.append(forest.rows_read.value)
    print("rows read by a batch at 400 and 4,000 facts", read)
    assert read[1] < 3 * read[0]


def test_range_search_finds_all_with_a_common_prefix(spark, tmp_path):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 54, 3000) >> 40 << 40
    spark.createDataFrame([(0, int(k), i) for i, k in enumerate(keys)], "part int, key long, i long").createOrReplaceTempView("runs")
    files = _runs.write_run(spark.table("runs"), f"file://{tmp_path}/r", 1, 100)
    q = np.sort(rng.choice(keys, 50))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(50, np.int32)), pa.array(q)], ["file", "key"])
    got = [(int(a), rows.column("i")[int(b)].as_py()) for _, x, rows, y in _runs.range_search(iter([batch]), files, None, history.prefix_ranges(1)) for a, b in zip(x, y)]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in range(50) for j in range(3000) if q[i] >> 45 == keys[j] >> 45}
    assert history.depth_for(0.99) >= history.depth_for(0.7) >= 1


def test_copies(spark):
    a = {"canonical_text": "A b, C!", "polarity": "affirm", "properties": {"rank": 1, "gold": True, "tags": ["x", "y"]}}
    b = {"properties": {"tags": [" X", "Y."], "gold": True, "rank": 1.0}, "polarity": "AFFIRM", "canonical_text": "a  B c"}
    c = {"properties": {"tags": ["y", "x"], "gold": True, "rank": 1}, "polarity": "AFFIRM", "canonical_text": "a  B c"}
    d = {**b, "properties": {**b["properties"], "gold": "true"}}
    payloads = [json.dumps(a), json.dumps(b, indent=2), json.dumps(c), json.dumps(d), json.dumps(a)[:-1], None, "NaN", "[" * 5000, json.dumps(a, ensure_ascii=True)]
    dumps = spark.createDataFrame([(i, p, 1) for i, p in enumerate(payloads)] + [(0, payloads[0], 1)], "dump_id long, payload string, digest int")
    m = spark.createDataFrame([(1, "Hello, World"), (2, "hello world!"), (3, "hello word"), (4, None), (5, ""), (6, "…"), (1, "Hello, World"), (7, "«Hello» WORLD")], "ord long, text string")
    f = spark.createDataFrame([], "ord long, canonical_text string")
    records = copies.domain_records(m, f, dumps)
    got = {tuple(r) for r in copies.copied_rows(records).collect()}
    assert got == {("mentions", 1, 1), ("mentions", 2, 1), ("mentions", 7, 1), ("mentions", 5, 5), ("mentions", 6, 5), ("fact_dumps", 0, 0), ("fact_dumps", 1, 0), ("fact_dumps", 8, 0)}
    counts = {(r.tbl, r.first_row_no): r.copies for r in copies.counted_copies(records).collect()}
    assert counts[("mentions", 1)] == 3 and counts[("fact_dumps", 0)] == 3 and counts[("mentions", 3)] == 1


def test_deeply_nested_payloads_count(spark):
    """Beyond the interpreter's stack, records are parsed and hashed with one of their own, with the same result."""
    deep = lambda leaf, n=30_000: "[" * n + leaf + "]" * n
    dumps = spark.createDataFrame([(1, deep('{"a": 1, "b": "X"}')), (2, deep(' {"b":"x.","a":1.0}')), (3, deep('{"a": 2, "b": "X"}')), (4, "[" * 30_000)], "dump_id long, payload string")
    assert {(r.row_no, r.first_row_no) for r in copies.copied_rows(copies.digests(dumps, "dump_id", "payload", True).select(F.lit("t").alias("tbl"), "*")).collect()} == {(1, 1), (2, 1)}
    for x in ('{"a": [1, {"b": null}], "c": "d, [e]"}', "[]", "{}", "[[], {}]", " 1.50 ", '"x\\"y"', "[true, false]"):
        assert copies.parse_deep(x) == copies.parse(x) and copies.merkle_deep(copies.parse(x)) == copies.merkle(copies.parse(x))
    for x in ("", "[1,]", "{1:2}", '{"a" 1}', "[1 2]", "[}", "]", "{,}", '{"a":1,}', "1 2", "nul", "[NaN]"):
        with pytest.raises(ValueError):
            copies.parse_deep(x)
