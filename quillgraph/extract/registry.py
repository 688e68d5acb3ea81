"""The extractors in the order of their needs, and a run that one's failure does not end."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.extract import build, java, libraries, rules, scripts, web
from quillgraph.graph import Graph
from quillgraph.session import ship

Extractor = Callable[[DataFrame, dict[str, DataFrame]], dict[str, DataFrame]]

REGISTRY: dict[str, Extractor] = {
    "gradle": build.gradle, "java": java.java, "sail": rules.rules, "cross_language": rules.bind, "spring_di": java.spring, "external_libs": build.external_libraries, "lib_transitivity": build.dependency_tree, "lib_usage": libraries.extractor(),
    "npm": build.npm, "typescript": scripts.typescript, "k": scripts.k_files, "db": web.database, "toggle": rules.toggles, "infra_jsp": web.pages, "infra_docker": web.services, "infra_owners": web.owners, "infra_api": web.endpoints,
    "expression_tests": rules.expression_tests, "resource_bundles": rules.resource_bundles, "xsd_cdt": rules.data_types, "gitlab_ci": web.pipelines, "freemarker": web.templates, "web_xml": web.descriptors, "groovy_tests": web.groovy_tests,
}


def run(spark: SparkSession, files: DataFrame, only: Iterable[str] | None = None, graph: Graph | None = None, extra: dict[str, Extractor] | None = None) -> tuple[Graph, DataFrame]:
    """The graph of a corpus, and extractor, status, elapsed_seconds, error of each run.

    extra adds plug-ins, or takes an extractor's place (lib_usage with other archive caches).
    """
    ship(spark)
    graph = graph or Graph(spark)
    summary = []
    for name, extract in (REGISTRY | (extra or {})).items():
        if only is not None and name not in only:
            continue
        began = time.time()
        try:
            graph.frames |= extract(files, graph.frames)
            summary.append((name, "success", time.time() - began, None))
        except Exception as e:  # the others go on
            summary.append((name, "failed", time.time() - began, f"{type(e).__name__}: {e}"[:500]))
    return graph, spark.createDataFrame(summary, "extractor string, status string, elapsed_seconds double, error string")
