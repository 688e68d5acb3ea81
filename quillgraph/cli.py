"""Command line: build a graph, show its statistics, ask it, evaluate answers.

python -m quillgraph.cli build --root DIR --out DIR [--only NAME...] [--append] [--validate] [--archives DIR...] [--prefixes CSV]
python -m quillgraph.cli stats --graph DIR
python -m quillgraph.cli ask QUESTION --graph DIR [--set KEY=VALUE...]
python -m quillgraph.cli cases --cases FILE [--ids ID...] [--categories C...] [--tags T...]
python -m quillgraph.cli record --results DIR --case ID --method NAME --items A,B [--summary TEXT] [--confidence X] [--tokens-in N] [--tokens-out N] [--tool-calls N]
python -m quillgraph.cli evaluate --cases FILE (--sessions DIR | --results DIR) --out DIR [--ids ID...] [--categories C...]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--root", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--only", nargs="*")
    b.add_argument("--append", action="store_true")
    b.add_argument("--clean", action="store_true", help="delete the stored graph first")
    b.add_argument("--validate", action="store_true")
    b.add_argument("--archives", nargs="*", help="archive caches (files-2.1 folders) in place of the build tool's own")
    b.add_argument("--prefixes", help="CSV with prefix, coordinate for imports that no archive owns")
    s = sub.add_parser("stats")
    s.add_argument("--graph", required=True)
    a = sub.add_parser("ask")
    a.add_argument("question")
    a.add_argument("--graph", required=True)
    a.add_argument("--set", nargs="*", default=[])
    for name in ("cases", "evaluate"):
        c = sub.add_parser(name)
        c.add_argument("--cases", required=True)
        c.add_argument("--ids", nargs="*")
        c.add_argument("--categories", nargs="*")
        c.add_argument("--tags", nargs="*")
        if name == "evaluate":
            given = c.add_mutually_exclusive_group(required=True)
            given.add_argument("--sessions", help="transcripts named CASE_METHOD.txt")
            given.add_argument("--results", help="results entered by record; cases with both methods count")
            c.add_argument("--out", required=True)
    r = sub.add_parser("record")
    for name in ("results", "case", "method", "items"):
        r.add_argument(f"--{name}", required=True)
    r.add_argument("--summary", default="")
    r.add_argument("--confidence", type=float, default=0.0)
    for name in ("tokens-in", "tokens-out", "tool-calls"):
        r.add_argument(f"--{name}", type=int, default=0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillgraph").getOrCreate()
    from quillgraph.evaluation import record, report, scoring, transcripts
    from quillgraph.extract import build, libraries, registry
    from quillgraph.graph import Graph
    from quillgraph.operators import patterns
    from quillgraph.sources import corpus

    if args.command == "build":
        if args.clean:
            Graph.clear(spark, args.out)
        files = corpus.tree(spark, args.root).unionByName(corpus.hidden(spark, args.root, ("CODEOWNERS", r"\.gitlab-ci.*\.ya?ml")))
        manual = args.prefixes and spark.read.csv(args.prefixes, header=True, schema="prefix string, coordinate string")
        usage = libraries.extractor(args.archives, f"{args.out}/_packages", f"{args.root}/gradle.lockfile", manual or None)
        graph, summary = registry.run(spark, files, args.only, extra={"lib_usage": usage, "lib_transitivity": build.dependency_trees(args.root)})
        graph.write(args.out, "append" if args.append else "overwrite")
        summary.show(100, truncate=80)
        if "UnresolvedImports" in graph.frames:
            print("imports that no library owns:")
            patterns.top_k(graph.frames["UnresolvedImports"], 20, "n", "import").show(20, truncate=False)
        broken = graph.constraint_violations()
        if not broken.isEmpty():
            print("keys that are not unique:")
            broken.orderBy("label", "key").show(20, truncate=False)
        if args.validate:
            graph.broken_paths(files).show()
        return int(bool(summary.where("status = 'failed'").count()))
    if args.command == "stats":
        Graph.read(spark, args.graph).stats().orderBy("kind", "name").show(200, truncate=False)
    elif args.command == "record":
        record.record(spark, args.results, args.case, args.method, args.items, answer_summary=args.summary, confidence=args.confidence, total_tokens_in=args.tokens_in, total_tokens_out=args.tokens_out, total_tool_calls=args.tool_calls)
    elif args.command == "ask":
        params = dict(x.split("=", 1) for x in args.set)
        params = {k: int(v) if v.isdigit() else v for k, v in params.items()}
        Graph.read(spark, args.graph).query(args.question, **params).show(200, truncate=False)
    else:
        cases = scoring.select_cases(transcripts.read_cases(spark, args.cases), args.ids, args.categories, args.tags)
        if args.command == "cases":
            cases.select("id", "category", "scenario").orderBy("id").show(500, truncate=100)
        else:
            if args.results:
                given = record.paired(record.recorded(spark, args.results))
            else:
                given = transcripts.results(transcripts.read_sessions(spark, args.sessions), transcripts.read_meta(spark, args.sessions))
            compared = scoring.compare(cases, given)
            report.save(compared, args.out)
            scoring.overall_report(compared).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
