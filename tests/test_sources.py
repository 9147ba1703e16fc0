"""Result cache, calls with failures, task specifications, cases."""

import json

import pytest

from tracemill.operators.cache import ResultCache, called, request_key
from tracemill.sources import loaders, spec


def test_cache_asks_once_and_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    items = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, "a", 9), (4, None, 9), (5, "bad", 1)], "id int, text string, value int").drop("value")

    def fn(row):
        if row["text"] == "bad":
            raise ValueError("no answer")
        return {"length": len(row["text"] or "")}

    cache = ResultCache(spark, path)
    got = {r.id: (r.value and json.loads(r.value)["length"], r.error) for r in cache.get_or_call(items, fn, columns=["text"]).collect()}
    assert got == {1: (1, None), 2: (1, None), 3: (1, None), 4: (0, None), 5: (None, "ValueError: no answer")}
    assert cache.usage == {"calls": 4, "hits": 0, "failures": 1}
    again = ResultCache(spark, path)
    got = again.get_or_call(items, lambda row: {"length": -1}, columns=["text"], concurrency=2)
    assert {r.id: json.loads(r.value)["length"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: -1}
    assert again.usage == {"calls": 1, "hits": 3, "failures": 0}
    off = ResultCache(spark, path, enabled=False)
    assert {json.loads(r.value)["length"] for r in off.get_or_call(items, lambda row: {"length": 9}, columns=["text"]).collect()} == {9}
    assert cache.get_or_call(items.limit(0), fn, columns=["text"]).count() == 0


def test_keys_and_failures(spark):
    d = spark.createDataFrame([("x", 1), ("x", None)], "a string, b int")
    assert d.select(request_key("a", "b").alias("k")).collect() == d.select(request_key("b", "a").alias("k")).collect()
    assert d.select(request_key("a", "b")).distinct().count() == 2

    def fail(row):
        raise KeyError("x")

    with pytest.raises(Exception, match="KeyError"):
        called(d.select(request_key("a", "b").alias("key"), "a"), fail, tolerate=False).collect()


YAML = """
loader: menu
agents: [A, B]
personas: {neutral: [be brief, be brief], sides: [argue for, argue against]}
conditions: {open: {persona: sides, disclosure: {mode: full}}, plain: {persona: neutral}, sided: {persona: sides}}
disclosure: {mode: role_aligned, affinity: {sides: {A: pro, B: con}}, fallback: partition}
task: {system: s, answer_line: "FINAL ANSWER:", context: "Q {question}\\n{public}\\n{items}\\n"}
"""


def test_spec_resolves_what_is_shown(tmp_path):
    p = tmp_path / "menus.yaml"
    p.write_text(YAML)
    s = spec.load_spec(p)
    assert (s.name, s.rounds, s.persona("plain"), s.persona("sides")) == ("menus", 3, "neutral", "sides")
    assert s.disclosure_for("open") == {"mode": "full"} and s.disclosure_for("plain") == {"mode": "partition"}
    assert s.disclosure_for("sided") == s.disclosure_for("sides") == {"mode": "role_aligned", "affinity": {"A": "pro", "B": "con"}}
    assert s.render("why", "all", ["one", "two"]) == "Q why\nall\none\n\ntwo"


@pytest.mark.parametrize("old, new, what", [("loader: menu", "", "loader"), ("sides: [argue for, argue against]", "sides: [argue]", "prompts"), ("persona: neutral", "persona: nobody", "nobody"), ("disclosure: {mode: full}", "disclosure: full", "mapping"), ("affinity: {sides:", "affinity: {gone:", "affinity"), ("personas: {neutral: [be brief, be brief], sides: [argue for, argue against]}", "personas: {}", "persona")])
def test_spec_names_what_is_wrong(tmp_path, old, new, what):
    p = tmp_path / "x.yaml"
    p.write_text(YAML.replace(old, new))
    with pytest.raises(ValueError, match=what):
        spec.load_spec(p)


def test_cases(spark, tmp_path):
    d = spark.createDataFrame([("e2", "c1", ["late"]), ("e1", "c1", ["first"]), ("e3", "c2", None), ("e4", None, None)], "execution_id string, case_id string, evidence array<string>").selectExpr("*", "evidence as gold_perspectives")
    assert {(r.case_id, tuple(r.evidence or ())) for r in loaders.cases_of_debates(d).collect()} == {("c1", ("first",)), ("c2", ())}
    with pytest.raises(ValueError, match="c3"):
        loaders.cases_of_debates(d, spark.createDataFrame([("c1",), ("c2",), ("c3",)], "case_id string"))
    c = loaders.synthetic_cases(spark, 5, 7, seed=3).collect()
    assert [r.interacts for r in c] == [True] * 5 + [False] * 7 and all((r.enzyme_a == r.enzyme_b) == r.interacts for r in c)
    assert c == loaders.synthetic_cases(spark, 5, 7, seed=3).collect() != loaders.synthetic_cases(spark, 5, 7, seed=4).collect()
    d.write.parquet(str(tmp_path / "d"))
    assert loaders.first_rows(spark, str(tmp_path / "d"), 2).count() == 2
