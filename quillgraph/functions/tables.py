"""Parsers as table functions of SQL: one row of text in, its declarations out.

After register(spark), `SELECT c.* FROM files, LATERAL java_classes(content) c` reads sources in
SQL alone. Null gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillgraph.session import ship


def _read(content: str | None):
    from quillgraph.extract.java_syntax import Reader

    return Reader(content or "")


@udtf(returnType="fqn string, name string, kind string, package string, enclosing string, line int")
class JavaClasses:
    """Types that a Java source declares, nested ones too."""

    def eval(self, content: str) -> Iterator[tuple]:
        for c in _read(content).classes:
            yield c["fqn"], c["name"], c["kind"], c["package"], c["enclosingFqn"], c["lineNumber"]


@udtf(returnType="id string, owner string, name string, signature string, arity int, line int")
class JavaMethods:
    """Methods and constructors that a Java source declares."""

    def eval(self, content: str) -> Iterator[tuple]:
        for m in _read(content).methods:
            yield m["id"], m["ownerFqn"], m["name"], m["signature"], m["arity"], m["lineNumber"]


@udtf(returnType="from_id string, kind string, name string")
class JavaReferences:
    """Supertypes as a Java source writes them, and its single imports (from_id: the package)."""

    def eval(self, content: str) -> Iterator[tuple]:
        unit = _read(content)
        for r in unit.refs:
            yield r["from_id"], r["kind"], r["raw"]
        for name in unit.imports:
            yield unit.package, "IMPORTS", name


TABLE_FUNCTIONS = {"java_classes": JavaClasses, "java_methods": JavaMethods, "java_references": JavaReferences}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL, and the package to its executors."""
    ship(spark)
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
