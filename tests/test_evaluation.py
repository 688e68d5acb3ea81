import json

from pyspark.sql import functions as F

from quillgraph import cli
from quillgraph.graph import Graph
from quillgraph.evaluation import report, scoring, transcripts

NONE: list[str] = []


def case(i, must, ban=NONE, least=0, category="c"):
    return (i, category, (must, ban, least))


def result(i, method, items, tokens=100, claims=NONE):
    return (i, method, items, tokens, 0, 0, claims)


def frames(spark, cases, results):
    return (
        spark.createDataFrame(cases, "id string, category string, ground_truth struct<must_include:array<string>,must_exclude:array<string>,minimum_count:int>"),
        spark.createDataFrame(results, "test_case_id string, method string, answer_items array<string>, total_tokens_in int, total_tokens_out int, total_tool_calls int, unsupported_claims array<string>"),
    )


def test_baseline(spark):
    got = scoring.baseline(*frames(spark, [case("a", ["X ", "y"], ["Bad"], 3), case("b", [])], [result("a", "graph_assisted", [" x", "Y", "y", "bad"], claims=["q"]), result("b", "tools_only", [])])).collect()
    a, b = sorted(got, key=lambda r: r.id)
    assert (a.found, a.missing, a.wrongly_included, a.item_count, a.meets_minimum, a.passed, a.hallucinations) == (["x", "y"], [], ["bad"], 4, True, False, 1)
    assert b.passed and b.meets_minimum and b.item_count == 0


def test_winner_rules(spark):
    g, t = "graph_assisted", "tools_only"
    many = [f"i{k}" for k in range(9)]
    table = {
        "pass": (["x"], [], 100, 100, "graph"), "fail": ([], ["x"], 100, 100, "tools"), "exclusive": (["x", "a", "b", "c"], ["x", "d"], 100, 100, "graph"), "not_enough": (["x", "a", "b"], ["x"], 100, 100, "tie"),
        "exact_double": (["x", "a", "b", "c", "d"], ["x", "e", "f"], 100, 100, "tie"), "count": (["x", "x", "x", "x", "x"], ["x"], 100, 100, "graph"), "cheap": (["x"], ["x"], 100, 151, "graph"), "edge": (["x"], ["x"], 100, 150, "tie"),
        "dear": (["x"], ["x"], 100, 66, "tools"), "no_tokens": (["x"], ["x"], 0, 50, "tie"), "free": (["x"], ["x"], 100, 0, "tie"), "tools_more": (["x"], ["x", *many], 100, 100, "tools"),
    }
    cases = [case(i, ["x"]) for i in table]
    results = [r for i, (a, b, ta, tb, _) in table.items() for r in (result(i, g, a, ta), result(i, t, b, tb))]
    compared = scoring.compare(*frames(spark, cases, results + [result("alone", g, ["x"])]))
    assert {r.id: r.winner for r in compared.collect()} == {i: w for i, (*_, w) in table.items()}
    total = scoring.overall_report(compared).first()
    assert (total.n_cases, total.graph_wins, total.tools_wins, total.ties) == (12, 4, 3, 5)
    assert total.token_ratio == round(total.tools_tokens / total.graph_tokens, 3)
    text = report.markdown(compared)
    assert "### exact_double" in text and "| c | 12 | 4 | 3 | 5 |" in text
    assert len(report.flat(compared).columns) == 20


def test_recommendations(spark):
    g, t = "graph_assisted", "tools_only"
    cases = [case(i, ["x"], category=c) for i, c in (("a1", "good"), ("a2", "good"), ("b1", "skip"), ("d1", "same"), ("d2", "same"))]
    answers = {"a1": (["x"], []), "a2": (["x", "q"], []), "b1": ([], ["x"]), "d1": (["x"], ["x"]), "d2": (["x"], ["x"])}
    results = [r for i, (a, b) in answers.items() for r in (result(i, g, a), result(i, t, b))]
    advice = {r.advice: r.categories for r in scoring.recommendations(scoring.category_report(scoring.compare(*frames(spark, cases, results)))).collect()}
    assert advice == {"use graph": "good", "skip graph": "skip", "redundant": "same", "review exclusive graph items": "good"}
    empty = scoring.compare(*frames(spark, cases, []))
    assert [r.advice for r in scoring.recommendations(scoring.category_report(empty)).collect()] == ["not enough data"]


TEXT = """invoke name="read" .. invoke name="read" .. invoke name="read_g_cypher"
```json
{"answer_items": ["Old"], "confidence": 0.1}
```
```json
{"answer_items": ["A", "B"], "confidence": 0.9, "unsupported_claims": ["c"]}
```
```json
{"answer_items": ["broken",
```
"""


def test_transcripts(spark, tmp_path):
    texts = {"one_graph_assisted": TEXT, "one_tools_only": '* `Foo`\n- Bar baz\n| Qux |\n- foo\n git grep x; git log', "two_graph_assisted": 'so {"answer_items": ["In"], "confidence": 1.0} end', "note": "no"}
    (tmp_path / "s").mkdir()
    for n, t in texts.items():
        (tmp_path / "s" / f"{n}.txt").write_text(t)
    got = {(r.test_case_id, r.method): r for r in transcripts.results(transcripts.read_sessions(spark, str(tmp_path / "s"))).collect()}
    a, b, d = got["one", "graph_assisted"], got["one", "tools_only"], got["two", "graph_assisted"]
    assert len(got) == 3 and a.answer_items == ["A", "B"] and a.unsupported_claims == ["c"] and a.tools == {"read": 2, "read_g_cypher": 1} and (a.graph_queries, a.file_reads, a.total_tool_calls) == (1, 2, 3)
    assert b.answer_items == ["Foo", "Bar", "Qux"] and b.tools == {"grep": 1, "shell": 2} and d.answer_items == ["In"]
    assert a.total_tokens_in == int(len(TEXT) // 4 * 0.2) and transcripts.read_meta(spark, str(tmp_path / "s")).count() == 0
    (tmp_path / "s" / "one_graph_assisted.meta.json").write_text('{"duration_ms": 1500.5, "model": "m"}')
    timed = transcripts.results(transcripts.read_sessions(spark, str(tmp_path / "s")), transcripts.read_meta(spark, str(tmp_path / "s"))).collect()
    assert {(r.test_case_id, r.method): r.wall_time_ms for r in timed} == {("one", "graph_assisted"): 1500, ("one", "tools_only"): None, ("two", "graph_assisted"): None}
    nested = 'x {"answer_items": ["a {b}", "c"], "answer_summary": "```", "confidence": 1} y {"other": {"answer_items": 1}}'
    assert spark.createDataFrame([(nested,), ("{" * 50,), (None,)], "t string").select(transcripts.last_answer(F.col("t")).alias("x")).select("x.answer_items").collect() == [(["a {b}", "c"],), (None,), (None,)]
    cases = [{"id": "one", "scenario": "s", "category": "ownership", "tags": ["t"], "ground_truth": {"expected_items": ["a"], "excluded_items": ["z"], "other": 1}}, {"id": "two", "category": "blast_radius", "ground_truth": {}}]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    read = {r.id: r for r in transcripts.read_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert read["one"].ground_truth.must_include == ["a"] and read["two"].ground_truth.must_exclude == []
    all_cases = transcripts.read_cases(spark, str(tmp_path / "cases.json"))
    assert [r.id for r in scoring.select_cases(all_cases, tags=["t", "u"]).collect()] == ["one"] and scoring.select_cases(all_cases, ids=["two"], categories=["x"]).count() == 0
    assert cli.main(["evaluate", "--cases", str(tmp_path / "cases.json"), "--sessions", str(tmp_path / "s"), "--out", str(tmp_path / "out")], spark) == 0
    assert cli.main(["cases", "--cases", str(tmp_path / "cases.json")], spark) == 0
    assert spark.read.csv(str(tmp_path / "out/report_csv"), header=True).count() == 1


def test_results_entered_by_hand_are_evaluated(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "one", "category": "c", "ground_truth": {"must_include": ["a"]}}, {"id": "two", "category": "c", "ground_truth": {}}]))
    results = str(tmp_path / "results")
    for case, method, items in (("one", "graph_assisted", "a, b"), ("one", "tools_only", "b"), ("two", "tools_only", "x")):
        assert cli.main(["record", "--results", results, "--case", case, "--method", method, "--items", items, "--tokens-in", "5"], spark) == 0
    assert cli.main(["evaluate", "--cases", str(tmp_path / "cases.json"), "--results", results, "--out", str(tmp_path / "out")], spark) == 0
    got = [r.asDict() for r in spark.read.csv(str(tmp_path / "out/report_csv"), header=True).collect()]
    assert len(got) == 1 and "graph" in str(got[0])


def test_cli_build(spark, tmp_path, capsys):
    root = tmp_path / "repo"
    for name, text in {"settings.gradle": "include ':a'", "a/build.gradle": "", "a/src/main/java/p/A.java": "package p; class A {}", ".github/CODEOWNERS": "/a @x/team"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    out = str(tmp_path / "graph")
    assert cli.main(["build", "--root", str(root), "--out", out, "--only", "gradle", "java", "infra_owners", "--validate"], spark) == 0
    assert cli.main(["stats", "--graph", out], spark) == 0 and cli.main(["ask", "class_owner", "--graph", out, "--set", "name=A"], spark) == 0
    assert "team" in capsys.readouterr().out
    (root / ".gitlab-ci-extra.yaml").write_text("job:\n  script: [x]\n  rules:\n  - changes: ['a/**']\n")
    assert cli.main(["build", "--root", str(root), "--out", out, "--only", "gradle", "gitlab_ci", "--clean"], spark) == 0
    stored = Graph.read(spark, out)
    assert "JavaClass" not in stored.frames and [r.from_id for r in stored.nodes("CI_TRIGGERED_BY").collect()] == ["job"]
    stored.write(str(tmp_path / "copy"))
    Graph(spark, {"Module": stored.nodes("Module")}).write(str(tmp_path / "copy"))
    assert set(Graph.read(spark, str(tmp_path / "copy")).frames) == {"Module"}
