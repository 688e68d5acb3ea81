"""Indented text read as a tree, in splits: each line's nearest open line above it.

A line of some depth closes what is open at its depth or deeper, and stays open itself. What is
open is a stack, which a sequential reader carries from line to line. Here every chunk of a
file is read by itself, from an empty stack. What a chunk does to the stack that comes in is
its summary: how deep that may be to stay (the least depth the chunk has seen), and what the
chunk leaves open itself. Two summaries combine into one, so the stacks before all chunks of
all files come from a scan over the summaries, in groups of ``FAN``, level by level, and lines
whose parent lies before their chunk are joined with the stack of that chunk.

Lines are shuffled only if their parent lies before their chunk; no task sees more than one
chunk's lines, in a stream, or ``FAN`` summaries, each as long as the nesting is deep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.operators.traverse import kept
from quillgraph.session import ship

#: Summaries of one file that a task combines.
FAN = 64
#: Deeper than any line: nothing was seen yet. And less: all was closed.
UNSEEN, CLOSED = (1 << 31) - 1, -1
OPEN = "array<struct<depth:int,name:string>>"
#: What a chunk does to the stack `a` that comes in, in SQL.
AFTER = "concat(filter({a}, y -> y.depth < {b}.floor), {b}.open)"


class Stack:
    """The open lines of one chunk, as far as the chunk itself has opened them."""

    def __init__(self) -> None:
        self.floor, self.open = UNSEEN, []

    def read(self, depth: int | None, name: str | None, opens: bool) -> tuple[str | None, int | None]:
        """The nearest named line above, or how shallow it has to be in the stack that comes in; (None, None): there is none."""
        if depth is None:
            self.floor = CLOSED
            self.open.clear()
            return None, None
        if opens:
            self.floor = min(self.floor, depth)
            while self.open and self.open[-1][0] >= depth:
                self.open.pop()
        above = next((n for d, n in reversed(self.open) if n is not None and d < depth), None)
        need = None if above is not None or self.floor == CLOSED else min(self.floor, depth)
        if opens:
            self.open.append((depth, name))
        return above, need


def parents(lines: DataFrame, depth: str = "depth", name: str = "name", opens: str = "opens", parent: str = "parent") -> DataFrame:
    """lines with parent: the name of the nearest line above that is open, shallower and has a name.

    lines need path, chunk (long) and their order in it. depth null closes all that is open; a
    line that does not open anything only asks. Lines without a name are open, but nobody's
    parent. Rows whose depth is null are left out of the result, in which order is not kept.
    Their columns must not be called need, floor or open.
    """
    ship(lines.sparkSession)
    columns = lines.columns
    read = lines.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, Stack()

        def summary(schema: pa.Schema) -> pa.RecordBatch:
            row = dict.fromkeys(columns) | {"path": at[0], "chunk": at[1], parent: None, "need": None, "floor": stack.floor, "open": [{"depth": d, "name": n} for d, n in stack.open]}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([*batch.schema, pa.field(parent, pa.string()), pa.field("need", pa.int32()), pa.field("floor", pa.int32()), pa.field("open", pa.list_(pa.struct([("depth", pa.int32()), ("name", pa.string())])))])
            found, rows = [], []
            for k, (path, chunk, d, n, o) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "chunk", depth, name, opens)))):
                if at != (path, chunk):
                    if at is not None:
                        yield summary(schema)
                    at, stack = (path, chunk), Stack()
                above, need = stack.read(d, n, o)
                if d is not None:
                    rows.append(k)
                    found.append((above, need))
            taken = batch.take(pa.array(rows, pa.int64()))
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), none.cast(pa.int32()), none.cast(schema.field("open").type)], schema=schema)
        if at is not None:
            yield summary(schema)

    seen = kept(lines.mapInArrow(run, f"{read}, {parent} string, need int, floor int, open {OPEN}"))
    each = seen.where("floor IS NOT NULL").select("path", F.struct("floor", "open").alias("s"), (F.row_number().over(W.partitionBy("path").orderBy("chunk")) - 1).alias("no"), "chunk")
    stacks = before(each).select("path", "chunk", F.col("stack").alias("before"))
    own = seen.where("floor IS NULL")
    asked = own.where("need IS NOT NULL").join(stacks, ["path", "chunk"])
    asked = asked.withColumn(parent, F.expr("get(reverse(filter(before, x -> x.depth < need AND x.name IS NOT NULL)), 0).name"))
    return own.where("need IS NULL").select(*columns, parent).unionByName(asked.select(*columns, parent))


def before(each: DataFrame) -> DataFrame:
    """path, no (from 0), chunk, s (floor and open) with stack: what is open before each.

    Levels of groups: the stack before a group comes from the level above, and that before each
    of its members by going through at most FAN of them.
    """
    most = each.agg(F.max("no")).first()[0] or 0
    step = f"(a, x) -> named_struct('floor', least(a.floor, x.s.floor), 'open', {AFTER.format(a='a.open', b='x.s')}, 'all', array_append(a.all, named_struct('no', x.no, 'chunk', x.chunk, 'floor', a.floor, 'open', a.open)))"
    start = f"named_struct('floor', {UNSEEN}, 'open', cast(array() AS {OPEN}), 'all', cast(array() AS array<struct<no:int,chunk:bigint,floor:int,open:{OPEN}>>))"
    groups = each.groupBy("path", F.expr(f"no div {FAN}").cast("int").alias("g")).agg(F.array_sort(F.collect_list(F.struct("no", "chunk", "s"))).alias("m"))
    groups = groups.withColumn("t", F.expr(f"aggregate(m, {start}, {step})")).select("path", "g", F.struct("t.floor", "t.open").alias("s"), "t.all")
    if most < FAN:
        above = groups.withColumn("stack", F.expr(f"cast(array() AS {OPEN})"))
    else:
        groups = kept(groups)
        higher = before(groups.select("path", F.col("g").alias("no"), F.col("g").cast("long").alias("chunk"), "s"))
        above = groups.join(higher.select("path", F.col("no").alias("g"), "stack"), ["path", "g"])
    return above.select("path", "stack", F.explode("all").alias("x")).select("path", F.col("x.no").alias("no"), F.col("x.chunk").alias("chunk"), F.expr(AFTER.format(a="stack", b="x")).alias("stack"))


def sections(lines: DataFrame, header: str, section: str = "section") -> DataFrame:
    """lines with the last header at or above each, in splits; header is a column, null on other lines."""
    held = lines.withColumns({"depth": F.when(F.col(header).isNotNull(), 0).otherwise(1), "opens": F.col(header).isNotNull()})
    found = parents(held, "depth", header, "opens", section)
    return found.withColumn(section, F.coalesce(header, section)).drop("depth", "opens")
