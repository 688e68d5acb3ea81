"""Scores of answer sets against known minimums, and head-to-head comparison.

Cases: id, category, ground_truth (must_include, must_exclude, minimum_count). Results:
test_case_id, method (graph_assisted or tools_only), answer_items, total_tokens_in and
_out, unsupported_claims and, optionally, graph_queries, grep_calls and file_reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import normalised

GRAPH, TOOLS = "graph_assisted", "tools_only"


def items(c: str | Column) -> Column:
    """Answer items as they are compared: trimmed, lower case, distinct, sorted."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(col, F.array().cast("array<string>")), normalised)))


def baseline(cases: DataFrame, results: DataFrame) -> DataFrame:
    """A row per case and method: what of the known minimum it found, missed or broke.

    item_count is the raw length of the answer, repeated items included; it is scored
    against minimum_count but takes no part in passed.
    """
    joined = cases.join(results, cases["id"] == results["test_case_id"])
    t = F.col("ground_truth")
    joined = joined.withColumns({"_got": items("answer_items"), "_must": items(t["must_include"]), "_ban": items(t["must_exclude"])})
    out = joined.withColumns({
        "found": F.array_intersect("_must", "_got"),
        "missing": F.array_except("_must", "_got"),
        "wrongly_included": F.array_intersect("_ban", "_got"),
        "item_count": F.coalesce(F.size("answer_items"), F.lit(0)),
        "hallucinations": F.coalesce(F.size("unsupported_claims"), F.lit(0)),
    })
    out = out.withColumns({"include_pass": F.size("missing") == 0, "exclude_pass": F.size("wrongly_included") == 0, "meets_minimum": F.col("item_count") >= F.coalesce(t["minimum_count"], F.lit(0))})
    return out.withColumn("passed", F.col("include_pass") & F.col("exclude_pass")).drop("_must", "_ban", "_got", "test_case_id")


def token_ratio(tools: Column, graph: Column) -> Column:
    """Tools tokens for each graph token, to three places; 0 where the graph used none."""
    return F.when(graph > 0, F.bround(tools / graph, 3)).otherwise(0.0)


def winner(g_pass: Column, t_pass: Column, g_only: Column, t_only: Column, g_count: Column, t_count: Column, ratio: Column) -> Column:
    """Ordered rules: baseline, exclusive items, item counts, token cost, tie.

    A ratio of 0 means that tokens are unknown for a side and decides nothing.
    """
    rules = [
        (g_pass & ~t_pass, "graph"), (t_pass & ~g_pass, "tools"),
        ((g_only > 2 * t_only) & (g_only >= 3), "graph"), ((t_only > 2 * g_only) & (t_only >= 3), "tools"),
        (g_count - t_count > 3, "graph"), (t_count - g_count > 3, "tools"),
        (ratio > 1.5, "graph"), ((ratio > 0) & (ratio < 0.67), "tools"),
    ]
    out = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for test, name in rules[1:]:
        out = out.when(test, F.lit(name))
    return out.otherwise("tie")


def reason() -> Column:
    """Why the winner won, in words; over the columns of compare()."""
    c = F.col
    s = lambda x: c(x).cast("string")
    g, t = F.size("graph_only").cast("string"), F.size("tools_only").cast("string")
    return (
        F.when(c("graph_pass") & ~c("tools_pass"), F.lit("tools failed the baseline"))
        .when(c("tools_pass") & ~c("graph_pass"), F.lit("graph failed the baseline"))
        .when((F.size("graph_only") > 2 * F.size("tools_only")) & (F.size("graph_only") >= 3), F.concat(F.lit("graph alone found "), g, F.lit(" items, tools alone "), t))
        .when((F.size("tools_only") > 2 * F.size("graph_only")) & (F.size("tools_only") >= 3), F.concat(F.lit("tools alone found "), t, F.lit(" items, graph alone "), g))
        .when(F.abs(c("graph_item_count") - c("tools_item_count")) > 3, F.concat(F.lit("graph gave "), s("graph_item_count"), F.lit(" items, tools "), s("tools_item_count")))
        .when(c("winner") != "tie", F.concat(F.lit("like results at a token ratio of "), s("token_ratio")))
        .otherwise("like results at like cost")
    )


def compare(cases: DataFrame, results: DataFrame) -> DataFrame:
    """A row per case that both methods answered: overlap, exclusives, costs, winner."""
    for name in ("graph_queries", "grep_calls", "file_reads"):
        if name not in results.columns:
            results = results.withColumn(name, F.lit(0))
    scored = baseline(cases, results)

    def side(method: str, p: str) -> DataFrame:
        s = scored.where(F.col("method") == method)
        cols = {"items": items("answer_items"), "item_count": F.col("item_count"), "pass": F.col("passed"), "include_pass": F.col("include_pass"), "tokens": F.col("total_tokens_in") + F.col("total_tokens_out"), "queries": F.col("graph_queries"), "grep": F.col("grep_calls"), "reads": F.col("file_reads")}
        return s.select("id", *([F.col("category")] if p == "graph" else []), *[c.alias(f"{p}_{n}") for n, c in cols.items()])

    both = side(GRAPH, "graph").join(side(TOOLS, "tools"), "id")
    both = both.withColumns({"agreed": F.array_intersect("graph_items", "tools_items"), "graph_only": F.array_except("graph_items", "tools_items"), "tools_only": F.array_except("tools_items", "graph_items"), "token_ratio": token_ratio(F.col("tools_tokens"), F.col("graph_tokens"))})
    c = F.col
    both = both.withColumn("winner", winner(c("graph_pass"), c("tools_pass"), F.size("graph_only"), F.size("tools_only"), c("graph_item_count"), c("tools_item_count"), c("token_ratio")))
    return both.withColumn("reason", reason())


def _rates(verdicts: bool) -> list[Column]:
    won = lambda w: F.count_if(F.col("winner") == w)
    out = [
        F.count("*").alias("n_cases"), won("graph").alias("graph_wins"), won("tools").alias("tools_wins"), won("tie").alias("ties"),
        F.avg(F.col("graph_pass").cast("int")).alias("graph_pass_rate"), F.avg(F.col("tools_pass").cast("int")).alias("tools_pass_rate"),
        F.avg(F.col("graph_include_pass").cast("int")).alias("graph_include_rate"), F.avg(F.col("tools_include_pass").cast("int")).alias("tools_include_rate"),
        F.avg("graph_item_count").alias("avg_graph_items"), F.avg("tools_item_count").alias("avg_tools_items"), F.avg(F.size("agreed")).alias("avg_overlap"), F.avg("token_ratio").alias("avg_token_ratio"),
        F.sum(F.size("graph_only")).alias("graph_exclusive"), F.sum(F.size("tools_only")).alias("tools_exclusive"), F.sum(F.size("agreed")).alias("agreed"),
        F.sum("graph_tokens").alias("graph_tokens"), F.sum("tools_tokens").alias("tools_tokens"),
    ]
    for p in ("graph", "tools"):
        n = F.sum(F.size(F.filter(f"{p}_findings", lambda f: f["verdict"] == "correct"))) if verdicts else F.lit(0).cast("long")
        out.append(n.alias(f"{p}_exclusive_correct"))
    return out


def category_report(compared: DataFrame) -> DataFrame:
    """Measures for each category; graph_findings and tools_findings, arrays of (item, verdict), are optional."""
    return compared.groupBy("category").agg(*_rates("graph_findings" in compared.columns))


def overall_report(compared: DataFrame) -> DataFrame:
    """One row of totals and the ratio of token sums."""
    total = compared.agg(*_rates("graph_findings" in compared.columns))
    return total.withColumn("token_ratio", F.coalesce(token_ratio(F.col("tools_tokens"), F.col("graph_tokens")), F.lit(0.0)))


def recommendations(report: DataFrame) -> DataFrame:
    """advice, categories: which categories of a category report meet each rule."""
    c = F.col
    rules = {
        "use graph": (c("graph_wins") > c("tools_wins")) & (c("n_cases") >= 2),
        "skip graph": (c("graph_wins") == 0) & (c("tools_wins") >= c("n_cases") / 2),
        "redundant": (c("avg_overlap") > 0.8 * F.greatest("avg_graph_items", "avg_tools_items")) & (c("n_cases") >= 2),
        "review exclusive graph items": c("graph_exclusive") > 0,
        "graph is cheaper": (c("avg_token_ratio") > 1.5) & (c("n_cases") >= 2),
    }
    met = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])))
    found = report.select("category", met.alias("advice")).groupBy("advice").agg(F.array_join(F.sort_array(F.collect_list("category")), ", ").alias("categories"))
    none = report.sparkSession.range(1).select(F.lit("not enough data").alias("advice"), F.lit("").alias("categories"))
    return found.unionByName(none.join(found.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_anti"))


def select_cases(cases: DataFrame, ids: list[str] | None = None, categories: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Cases by id, category and any of the tags; an absent filter keeps all."""
    if ids:
        cases = cases.where(F.col("id").isin(ids))
    if categories:
        cases = cases.where(F.col("category").isin(categories))
    if tags:
        cases = cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return cases
