"""Reports of a comparison: Markdown, CSV and JSON. Only report rows come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.evaluation import scoring

CSV_COLUMNS = (
    "id", "category", "winner", "reason", "graph_item_count", "tools_item_count", "agreed_count", "graph_only_count", "tools_only_count", "graph_pass", "tools_pass", "graph_include_pass", "tools_include_pass",
    "graph_tokens", "tools_tokens", "token_ratio", "graph_queries", "graph_grep", "tools_grep", "tools_reads",
)


def flat(compared: DataFrame) -> DataFrame:
    """A row per case with the columns of the CSV report."""
    sized = compared.withColumns({f"{n}_count": F.size(n) for n in ("agreed", "graph_only", "tools_only")})
    return sized.select(*CSV_COLUMNS)


def markdown(compared: DataFrame) -> str:
    """The report as Markdown text."""
    total = scoring.overall_report(compared).first().asDict()
    categories = scoring.category_report(compared).orderBy("category").collect()
    advice = scoring.recommendations(scoring.category_report(compared)).orderBy("advice").collect()
    cases = compared.orderBy("id").collect()
    pct = lambda x: f"{100 * (x or 0):.0f}%"
    out = ["# Evaluation", "", f"Cases: {total['n_cases']}; graph {total['graph_wins'] or 0}, tools {total['tools_wins'] or 0}, ties {total['ties'] or 0}.", f"Tokens: graph {total['graph_tokens'] or 0}, tools {total['tools_tokens'] or 0}, ratio {total['token_ratio']}.", ""]
    out += ["## Categories", "", "| category | cases | graph | tools | ties | graph passes | tools passes | token ratio |", "|-|-|-|-|-|-|-|-|"]
    out += [f"| {r['category']} | {r['n_cases']} | {r['graph_wins']} | {r['tools_wins']} | {r['ties']} | {pct(r['graph_pass_rate'])} | {pct(r['tools_pass_rate'])} | {r['avg_token_ratio'] or 0:.2f} |" for r in categories]
    out += ["", "## Advice", ""] + [f"- {r['advice']}: {r['categories']}" if r["categories"] else f"- {r['advice']}" for r in advice]
    out += ["", "## Cases", ""]
    for r in cases:
        out += [f"### {r['id']}", "", f"Winner: {r['winner']} ({r['reason']}).", "", f"Agreed: {', '.join(r['agreed']) or 'none'}.", f"Graph only: {', '.join(r['graph_only']) or 'none'}.", f"Tools only: {', '.join(r['tools_only']) or 'none'}.", ""]
    return "\n".join(out)


def save(compared: DataFrame, folder: str) -> None:
    """report_md (text), report_csv and report_json folders."""
    spark = compared.sparkSession
    spark.createDataFrame([(markdown(compared),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report_md")
    flat(compared).coalesce(1).write.mode("overwrite").csv(f"{folder}/report_csv", header=True)
    compared.write.mode("overwrite").json(f"{folder}/report_json")
