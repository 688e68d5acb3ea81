"""Expression rules and what binds to them: calls, functions, toggles, types, tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.extract.build import contained
from quillgraph.functions import text as T
from quillgraph.operators import merge, resolve
from quillgraph.sources import corpus as C

# How rule texts name rules, functions, reactions, types and toggles.
RULE_CALL = r"a!(\w+)\s*\("
FUNCTION_CALL = r"fn!(\w+)\s*\("
REACTION_CALL = r'a!externalReaction\s*\(\s*"([^"]+)"'
TYPE_REFERENCE = r"'type!\{[^}]+\}(\w+)'"
RULE_TOGGLE = r'a!isFeatureEnabled\(\s*"([^"]+)"'
# How Java registers functions and reactions and asks for toggles.
FUNCTION_ID = r'FN_ID\s*=\s*new\s+Id\(\s*Domain\.\w+\s*,\s*"(\w+)"\s*\)'
FUNCTION_NAME = r'FN_NAME\s*=\s*"(\w+)"'
REACTION_KEY = r'(?:REACTION_KEY|KEY|getKey|key)\s*(?:=|return)\s*"([^"]+)"'
TOGGLE_USES = (r'isFeatureEnabled\(\s*"([^"]+)"', r'getBoolean\(\s*"([^"]+)"', r'getBooleanFromModernClientWithFallback\(\s*"([^"]+)"')
TOGGLE_CONSTANT = r'(?:static\s+final\s+String|final\s+static\s+String)\s+(\w+)\s*=\s*"(ae\.[^"]+)"'
TOGGLE_CONSTANT_USE = r"isFeatureEnabled\(\s*(?:[\w.]+\.)?([A-Z_][A-Z0-9_]*)\s*\)"

RULE_SCHEMA = "name string, uuid string, path string, parentUuid string, isSystemOnly boolean, functionCategory string, description string, definitionLineCount int, definition string"


def parse_rules(files: DataFrame) -> DataFrame:
    """Rules with their definitions; broken XML is read by patterns instead."""

    def parse(batches):
        import re
        import xml.etree.ElementTree as ET

        import pandas as pd

        fields = ("name", "uuid", "parentUuid", "description", "functionCategory", "definition", "metadataExpr")

        def by_pattern(content: str) -> dict:
            body = re.search(r"<(?:\w+:)?rule\b.*", content, re.S)
            out = {}
            for f in fields if body else ():
                m = re.search(rf"<(?:\w+:)?{f}\b[^>]*>(.*?)</(?:\w+:)?{f}>", body[0], re.S)
                if m:
                    out[f] = re.sub(r"^\s*<!\[CDATA\[|\]\]>\s*$", "", m[1])
            return out

        def by_tree(content: str) -> dict:
            root = ET.fromstring(content.lstrip("﻿").encode())
            rule = next((e for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "rule"), None)
            return {} if rule is None else {c.tag.rpartition("}")[2]: c.text or "" for c in reversed(list(rule)) if isinstance(c.tag, str)}

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    got = by_tree(content or "")
                except ET.ParseError:
                    got = by_pattern(content or "")
                if not got.get("name") or not got.get("uuid"):
                    continue
                d, meta = got.get("definition") or "", got.get("metadataExpr") or ""
                rows.append((got["name"], got["uuid"], path, got.get("parentUuid") or "", "systemOnly: fn!true()" in meta or "systemOnly:fn!true()" in meta, got.get("functionCategory") or "", (got.get("description") or "")[:200], d.count("\n") + 1 if d else 0, d))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULE_SCHEMA.split(", ")])

    return C.rule_files(files).select("path", "content").mapInPandas(parse, RULE_SCHEMA)


def rules(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """SailRule (with called functions and reactions), CALLS, CONTAINS."""
    parsed = resolve.elect(parse_rules(files), "uuid", F.col("path").desc())
    names = lambda p: F.array_sort(F.array_distinct(T.find_all(F.col("definition"), p)))
    nodes = parsed.withColumns({"_fnCalls": names(FUNCTION_CALL), "_reactionCalls": names(REACTION_CALL)}).drop("definition")
    calls = parsed.select(F.col("uuid").alias("from_id"), "name", F.explode(F.array_distinct(T.find_all(F.col("definition"), RULE_CALL))).alias("called"), F.col("path").alias("sourceFile"))
    calls = calls.where("called <> name").join(parsed.select(F.col("name").alias("called")).distinct(), "called", "left_semi")
    calls = calls.select("from_id", F.concat(F.lit("SYSTEM_SYSRULES_"), "called").alias("to_id"), "sourceFile")
    out = {"SailRule": nodes}
    out["CALLS"] = merge.merge_edges(calls.withColumn("seq", F.col("sourceFile")), nodes, nodes, "uuid", "uuid", ["from_id", "to_id"], "seq")
    if "Module" in graph:
        out["CONTAINS_SailRule"] = contained(nodes, graph["Module"], "uuid")
    return out


def bind(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """CALLS_BUILTIN and CALLS_REACTION: names that rules call, bound to Java classes.

    Function ids override function names; among ids the last file counts, among names the
    first; reactions are looked for in files named so.
    """
    java = C.java_files(files).withColumn("fqn", T.java_fqn(F.col("path"), strict=True)).where("fqn IS NOT NULL")
    marked = java.where(F.col("content").contains("FN_ID") | F.col("content").contains("FN_NAME"))
    found = lambda df, p: df.select(F.explode(T.find_all(F.col("content"), p)).alias("name"), "fqn", "path")
    ids, fn = resolve.registry(found(marked, FUNCTION_ID), "name", "path"), resolve.registry(found(marked, FUNCTION_NAME), "name", "path", last=False)
    functions = merge.priority_merge(ids.select("name", "fqn"), fn.select("name", "fqn"), key="name")
    keyed = found(java.where(C.file_name().contains("Reaction") & F.col("content").contains("Reaction")), REACTION_KEY)
    reactions = resolve.registry(keyed.where((F.length("name") < 100) & ~F.col("name").contains(" ")), "name", "path").select("name", "fqn")
    rules_, classes = graph["SailRule"], graph["JavaClass"]

    def edges(called: str, table: DataFrame, prop: str) -> DataFrame:
        calls = rules_.select(F.col("uuid").alias("from_id"), F.explode(called).alias("name")).join(table, "name")
        return merge.merge_edges(calls.select("from_id", F.col("fqn").alias("to_id"), F.col("name").alias(prop)), rules_, classes, "uuid", "fqn")

    return {"CALLS_BUILTIN": edges("_fnCalls", functions, "functionName"), "CALLS_REACTION": edges("_reactionCalls", reactions, "reactionKey")}


def toggles(files: DataFrame, graph: dict[str, DataFrame], properties: str = r"feature-toggles\.properties") -> dict[str, DataFrame]:
    """FeatureToggle, DEFINED_IN, GATES to classes and to rules; constants resolve in two steps."""
    c = F.col
    listed = resolve.registry(C.properties(C.named(files, properties)).select(c("key").alias("name"), c("value").alias("defaultValue"), "path", "line_no"), "name", "line_no").select("name", "defaultValue")
    java = C.java_files(files).withColumn("fqn", T.java_fqn(c("path")))
    constants = java.select("path", "fqn", F.posexplode(T.find_groups(c("content"), TOGGLE_CONSTANT, 2)).alias("n", "m")).select("path", "fqn", "n", c("m.g1").alias("constantName"), c("m.g2").alias("toggle"))
    found = constants.select(c("toggle").alias("name")).distinct().withColumn("defaultValue", F.lit(""))
    nodes = merge.priority_merge(listed, found, key="name")
    defined = constants.where("fqn IS NOT NULL").select(c("toggle").alias("from_id"), c("fqn").alias("to_id"), "constantName", c("path").alias("sourceFile"), F.concat("path", F.format_string("%06d", "n")).alias("seq"))
    values = resolve.registry(constants.withColumn("seq", F.concat("path", F.format_string("%06d", "n"))), "constantName", "seq").select("constantName", "toggle")
    direct = None
    for p in TOGGLE_USES:
        d = java.select("path", "fqn", F.explode(T.find_all(c("content"), p)).alias("toggle"))
        direct = d if direct is None else direct.union(d)
    by_name = java.select("path", "fqn", F.explode(T.find_all(c("content"), TOGGLE_CONSTANT_USE)).alias("constantName")).join(values, "constantName").select("path", "fqn", "toggle")
    gates = direct.union(by_name).where("fqn IS NOT NULL").select(c("toggle").alias("from_id"), c("fqn").alias("to_id"), c("path").alias("sourceFile"), c("path").alias("seq"))
    in_rules = C.rule_files(files).select(C.stem().alias("to_id"), c("path").alias("sourceFile"), c("path").alias("seq"), F.explode(T.find_all(c("content"), RULE_TOGGLE)).alias("from_id"))
    first = ["from_id", "to_id"]
    return {
        "FeatureToggle": nodes,
        "DEFINED_IN": merge.merge_edges(defined, nodes, graph["JavaClass"], "name", "fqn", first, "seq"),
        "GATES_JavaClass": merge.merge_edges(gates, nodes, graph["JavaClass"], "name", "fqn", first, "seq"),
        "GATES_SailRule": merge.merge_edges(in_rules, listed, graph["SailRule"], "name", "uuid", first, "seq"),
    }


def data_types(files: DataFrame, graph: dict[str, DataFrame], namespace: str = "") -> dict[str, DataFrame]:
    """CdtType from XML schemas and REFERENCES_CDT from rule texts; namespaces do not matter."""
    schemas = C.named(files, r".*\.xsd")

    def parse(batches):
        import xml.etree.ElementTree as ET

        import pandas as pd

        local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    root = ET.fromstring((content or "").encode())
                except ET.ParseError:
                    continue
                for e in root.iter():
                    kind = local(e)
                    if kind not in ("complexType", "simpleType") or not e.get("name"):
                        continue
                    info = next((x for x in e.iter() if local(x) == "appinfo"), None)
                    hidden = kind == "complexType" and info is not None and "HIDDEN" in (info.text or "")
                    of = "element" if kind == "complexType" else "enumeration"
                    rows.append((e.get("name"), hidden, kind, sum(local(x) == of for x in e.iter()), path))
            yield pd.DataFrame(rows, columns=["name", "isHidden", "kind", "fieldCount", "path"])

    parsed = schemas.select("path", "content").mapInPandas(parse, "name string, isHidden boolean, kind string, fieldCount int, path string")
    nodes = resolve.elect(parsed, "name", F.col("kind").desc(), F.col("path").desc()).withColumn("namespace", F.lit(namespace))
    edges = C.rule_files(files).select(C.stem().alias("from_id"), F.explode(F.array_distinct(T.find_all(F.col("content"), TYPE_REFERENCE))).alias("to_id"))
    return {"CdtType": nodes, "REFERENCES_CDT": merge.merge_edges(edges, graph["SailRule"], nodes, "uuid", "name")}


def expression_tests(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """ExpressionTest, TESTS_RULE (primary by file name, references by content), CONTAINS."""
    c = F.col
    kind = F.when(c("path").contains("/unit/"), "unit").when(c("path").contains("/integration/"), "integration").when(c("path").contains("/shared/"), "shared").otherwise("unknown")
    tests = C.named(files, r"expressions-.*\.txt").withColumn("primaryRule", F.regexp_extract(C.file_name(), r"^expressions-(.+)\.txt$", 1))
    nodes = tests.select("path", C.file_name().alias("name"), kind.alias("testType"), "primaryRule")
    by_name = graph["SailRule"].select(c("name").alias("rule"), c("uuid").alias("to_id"))
    primary = nodes.select(c("path").alias("from_id"), c("primaryRule").alias("rule"), F.lit("primary").alias("relationship"), F.lit(0).alias("seq"))
    named = tests.select(c("path").alias("from_id"), "primaryRule", F.explode(F.array_distinct(T.find_all(c("content"), RULE_CALL))).alias("rule")).where("rule <> primaryRule").select("from_id", "rule", F.lit("references").alias("relationship"), F.lit(1).alias("seq"))
    edges = primary.union(named).join(by_name, "rule").select("from_id", "to_id", "relationship", "seq")
    out = {"ExpressionTest": nodes, "TESTS_RULE": merge.merge_edges(edges, nodes, graph["SailRule"], "path", "uuid", ["from_id", "to_id"], "seq")}
    if "Module" in graph:
        out["CONTAINS_ExpressionTest"] = contained(nodes, graph["Module"])
    return out


def resource_bundles(files: DataFrame, graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """ResourceBundle with its number of keys, CONTAINS."""
    bundles = C.named(files, r".*_en_US\.properties")
    key = lambda x: (F.trim(x) != "") & ~x.startswith("#") & x.contains("=")
    nodes = bundles.select("path", C.stem().alias("name"), F.size(F.filter(F.split("content", r"\r\n|\n|\r", -1), key)).alias("keyCount"))
    out = {"ResourceBundle": nodes}
    if "Module" in graph:
        out["CONTAINS_ResourceBundle"] = contained(nodes, graph["Module"])
    return out
