import json

import pytest

from tracemill.sources import loaders


def _write(path, rows):
    path.write_text(json.dumps(rows))
    return str(path)


def test_loaders(spark, tmp_path):
    p = _write(tmp_path / "mc.json", [{"question_id": str(i), "question": "q?", "options": ["x", "y"], "answer": "B", "category": "law" if i % 2 else "art"} for i in range(6)])
    got = loaders.load_cases(spark, "multiple_choice", p, n=2, seed=1, categories=["law"]).collect()
    assert len(got) == 2 and got[0].question == "q?\nA. x\nB. y" and got[0].meta["category"] == "law"
    assert [r.case_id for r in got] == [r.case_id for r in loaders.load_cases(spark, "multiple_choice", p, n=2, seed=1, categories=["law"]).collect()]
    p = _write(tmp_path / "c.json", [{"id": "r1", "reports": {"lab": "ok SUMMARY: again", "scan": "SUMMARY: x"}}])
    got = loaders.load_cases(spark, "clinical", p).collect()
    assert {r.case_id for r in got} == {"r1/diagnosis", "r1/treatment"} and [i.text for i in got[0]["items"]] == ["ok"]
    p = _write(tmp_path / "a.json", [{"id": "t", "public": ["road"], "private": {"A": ["ax"]}, "values": {"A": {"t1": 2.0, "t2": 0.0}}}])
    got = loaders.load_cases(spark, "allocation", p).first()["items"]
    assert {(i.id, i.holder) for i in got} == {("public:road", None), ("A:ax", "A"), ("A=t1", "A")}
    p = _write(tmp_path / "m.json", [{"id": "m", "pantry": {"rice": "2 kg"}, "guests": {"Ann": {"diet": "vegan", "note": ""}}}] * 2)
    got = loaders.load_cases(spark, "menu", p).collect()
    assert len(got) == 1 and {i.text for i in got[0]["items"]} == {"2 kg rice", "diet: vegan"}
    p = _write(tmp_path / "n.json", [{"id": "n", "domain": "rent", "task": "t", "hidden": "h", "agents": [{"name": "A", "shareable": ["s"], "private": ["p"]}, {"name": "B"}]}, {"id": "solo", "domain": "rent", "agents": [{"name": "A"}]}])
    got = loaders.load_cases(spark, "negotiation", p, domains=["rent"]).collect()
    assert len(got) == 1 and {(i.side, i.holder, i.text) for i in got[0]["items"]} == {("shareable", "A", "s"), ("private", "A", "p")} and got[0].meta["hidden"] == "h"
    p = _write(tmp_path / "p.json", [{"case_id": "c", "claim": "x", "evidence": [{"id": "e", "text": "t", "stance": "pro"}]}] * 2)
    assert loaders.load_cases(spark, "perspectrum", p).count() == 1
    with pytest.raises(KeyError):
        loaders.load_cases(spark, "none", p)


def test_dealing(spark):
    items = spark.createDataFrame([("c", f"e{i}", ["law"] if i == 0 else ["art"] if i == 1 else []) for i in range(30)], "case_id string, item string, tags array<string>")
    agents = spark.createDataFrame([("c", "A", ["law"]), ("c", "B", ["sport"])], "case_id string, agent string, tags array<string>")
    dealt = loaders.deal_sample(items.drop("tags"), agents.drop("tags"), 0.3, 7)
    assert dealt.select("item").distinct().count() == 30 and dealt.count() < 45
    got = {(r.agent, r.item) for r in loaders.deal_role_aligned(items, agents).collect()}
    assert ("A", "e0") in got and ("B", "e0") not in got and {("A", "e1"), ("B", "e1")} <= got
