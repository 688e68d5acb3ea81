"""Results that are entered by hand: appended rows, and the pairs that a comparison takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.evaluation.scoring import GRAPH, TOOLS

SCHEMA = "test_case_id string, method string, answer_items array<string>, answer_summary string, confidence double, unsupported_claims array<string>, total_tokens_in long, total_tokens_out long, total_tool_calls long, graph_queries long, grep_calls long, file_reads long, wall_time_ms long"


def record(spark: SparkSession, path: str, test_case_id: str, method: str, answer_items: Sequence[str] | str, **more) -> None:
    """Appends a result; items may be one text with commas."""
    if method not in (GRAPH, TOOLS):
        raise ValueError(f"unknown method {method!r}")
    given = answer_items.split(",") if isinstance(answer_items, str) else answer_items
    row = {c.split()[0]: 0 for c in SCHEMA.split(", ") if c.endswith(" long")} | {"answer_summary": "", "confidence": 0.0, "unsupported_claims": []} | more
    row |= {"test_case_id": test_case_id, "method": method, "answer_items": [x.strip() for x in given if x.strip()]}
    spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA).coalesce(1).write.mode("append").json(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def paired(results: DataFrame) -> DataFrame:
    """Results of the cases that both methods have answered."""
    both = results.groupBy("test_case_id").agg(F.countDistinct("method").alias("n")).where("n = 2")
    return results.join(both.select("test_case_id"), "test_case_id", "left_semi")
