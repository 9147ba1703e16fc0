import json

from tracemill.__main__ import main


def test_command_line(spark, tmp_path):
    rows = [{"text": t, "provenance": {"execution_id": "e", "agent_id": a, "round": r, "channel": "output"}} for t, a, r in (("The bridge opened in 1932.", "A", 1), ("The bridge opened in 1932!", "B", 2), ("Rain fell all week. The bridge opened in 1932.", "C", 2))]
    (tmp_path / "t.json").write_text(json.dumps(rows))
    out = lambda x: str(tmp_path / x)
    assert main(["extract", out("t.json"), "-o", out("m")]) == 0
    assert main(["match", out("m"), "-o", out("s")]) == 0
    links = spark.read.parquet(out("s") + "/mention_fact")
    assert links.count() == 4 and links.select("fact_id").distinct().count() == 2
    assert main(["match", out("m"), "-o", out("s2"), "--store", out("s")]) == 0
    assert spark.read.parquet(out("s2") + "/facts").count() == 2
    assert main(["annotate", out("s"), "--props", "nope"]) == 2
    assert main(["annotate", out("s"), "--props", "truth,abstraction", "-o", out("a")]) == 0
    assert spark.read.parquet(out("a") + "/facts").first().annotation.truth is True
    assert main(["stats", out("s")]) == 0
    assert main(["view", out("s"), "-o", out("v.html")]) == 0 and "Rain fell" in (tmp_path / "v.html").read_text()


def test_reworded_mention_keeps_the_registered_fact(spark, tmp_path):
    out = lambda x: str(tmp_path / x)
    for run, texts in (("one", ["The old stone bridge opened in 1932."]), ("two", ["In 1932 the old stone bridge opened.", "Rain fell all week."])):
        (tmp_path / run).write_text(json.dumps([{"text": t, "provenance": {"execution_id": run, "agent_id": "A", "round": r, "channel": "output"}} for r, t in enumerate(texts, 1)]))
        assert main(["extract", out(run), "-o", out(f"m-{run}")]) == 0
    assert main(["match", out("m-one"), "-o", out("s")]) == 0
    assert main(["match", out("m-two"), "-o", out("s2"), "--store", out("s")]) == 0
    old = spark.read.parquet(out("s") + "/facts").first().fact_id
    links = spark.read.parquet(out("s2") + "/mention_fact").join(spark.read.parquet(out("s2") + "/mentions"), "mention_id")
    assert {r.text: r.fact_id == old for r in links.collect()} == {"In 1932 the old stone bridge opened.": True, "Rain fell all week.": False}
    assert spark.read.parquet(out("s2") + "/facts").count() == 2
