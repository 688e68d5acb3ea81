"""Merkle dataset manifest with parent-preimage paths (operator 11).

Every row is a leaf; in each group (a source) leaves in order are hashed three by three until
one node is left, and the groups' roots are hashed likewise into the root of the dataset.

Method: a parent is stored as its preimage, the concatenated hex digests of its children. A
leaf's proof joins the preimages of its ancestors; at each level the leaf's own 64 characters
are cut out of the preimage, which leaves the siblings, or are replaced by another digest,
whose hash goes on to the next level (folding).

How it scales: texts are read once and never shuffled, only digests are. Ranks within a group
come from one range partitioning of all leaves and the counts of its partitions, so a group
with a third of all rows is spread like any other. Preimages are kept in blocks of
``ARITY ** LEVELS`` neighbours, so a tree over n leaves takes log27(n) shuffles, each a 27th
of the one before; paths are handed down from block to block, and a leaf joins one block,
which 27 leaves share at most. Nothing is collected but two sums and one maximum.

Defined results: a null field is written ``-``, whatever its type; a null group is a group of
its own and the first one; rows of one group with the same id are ordered by their leaves, and
repeated rows are leaves each. Null ids come first and are never tampered with. A group of one
leaf has that leaf as its root, and so has a dataset of one group. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillgraph.llm.common import BROADCAST_BYTES, cut, table

ARITY = 3
#: Levels of a tree that one block holds.
LEVELS = 3
SPAN = ARITY**LEVELS
#: Characters of a digest.
SLOT = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEPS = "array<struct<pre:string,slot:int>>"


def digest(fields: list[Column]) -> Column:
    """The leaf of a row: each field is ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    written = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*written).cast("binary"), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """g (the group, written so that null comes first), key, leaf and what else is to stay with it; written once."""
    more = [c.alias(name) for name, c in (carry or {}).items()]
    g = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    # repeated rows are told apart by row, so that a range never has to hold all copies of one
    return cut(docs.select(g.alias("g"), F.col(key).alias("key"), digest([F.col(f) for f in fields]).alias("leaf"), *more, F.monotonically_increasing_id().alias("row")), "leaves")


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds idx (place within g by order, from 0) and n (nodes of g)."""
    ranged = cut(nodes.repartitionByRange(*[F.col(c).asc_nulls_first() for c in ("g", *order)]).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    size = counts.agg(F.sum(F.octet_length("g") + 64)).first()[0] or 0
    groups = W.partitionBy("g")
    bases = counts.select("g", "part", (F.sum("rows").over(groups.orderBy("part")) - F.col("rows") - F.col("first")).alias("base"), F.sum("rows").over(groups).alias("n"))
    if size <= BROADCAST_BYTES:
        bases = F.broadcast(bases)
    return ranged.join(bases, ["g", "part"]).withColumn("idx", F.col("base") + F.col("at")).drop("part", "base", "at")


def _above(n: str) -> str:
    return f"if({n} <= 1, {n}, ({n} + {ARITY - 1}) div {ARITY})"


def blocks(nodes: DataFrame) -> DataFrame:
    """g, block, n, p1 .. p3 (preimages by level; none above a tree's root), h and up_n: the node on top and how many its level has."""
    runs = nodes.groupBy("g", F.expr(f"idx div {SPAN}").alias("block")).agg(F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(idx, h))), x -> x.h)").alias("hs"))
    runs = runs.withColumn("up_n", F.col("n"))
    for k in range(1, LEVELS + 1):
        runs = runs.withColumn(f"p{k}", F.expr(f"if(up_n <= 1, cast(array() AS array<string>), transform(sequence(0, (size(hs) - 1) div {ARITY}), j -> array_join(slice(hs, cast({ARITY} * j + 1 AS int), {ARITY}), '')))"))
        runs = runs.withColumn("hs", F.expr(f"if(up_n <= 1, hs, transform(p{k}, p -> sha2(p, 256)))")).withColumn("up_n", F.expr(_above("up_n")))
    return runs.withColumn("h", F.expr("hs[0]")).drop("hs")


def grown(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of each level of blocks over nodes (g, idx, n, h), lowest first, each written once."""
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        levels.append(cut(blocks(nodes), f"{name}{len(levels)}"))
        for _ in range(LEVELS):
            most = -(-most // ARITY)
        if most <= 1:
            return levels
        nodes = levels[-1].where("up_n > 1").select("g", F.col("block").alias("idx"), F.col("up_n").alias("n"), "h")


def roots(levels: list[DataFrame]) -> DataFrame:
    """g and h: the root of every group, from the level where its tree ends."""
    found = [level.where("up_n = 1").select("g", "h") for level in levels]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def steps(idx: str) -> Column:
    """The preimages above a node of a block, and the slot of the way up in each; then those above the block."""
    own = ", ".join(f"named_struct('pre', get(p{k}, cast(({idx} % {SPAN}) div {ARITY ** k} AS int)), 'slot', cast(({idx} div {ARITY ** (k - 1)}) % {ARITY} AS int))" for k in range(1, LEVELS + 1))
    return F.expr(f"concat(filter(array({own}), s -> s.pre IS NOT NULL), path)")


def paths(levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The lowest blocks, each with path (what is above it), top (its group's root) and root.

    above has g, path and root of every group's root; without it that root is the last.
    """
    found = None
    for level in reversed(levels):
        ended = level.where("up_n = 1").withColumn("top", F.col("h"))
        ended = ended.join(above, "g") if above is not None else ended.withColumns({"path": F.expr(f"cast(array() AS {STEPS})"), "root": F.col("h")})
        if found is not None:
            higher = found.select("g", F.col("block").alias("higher"), *[f"p{k}" for k in range(1, LEVELS + 1)], "path", "top", "root")
            higher = level.where("up_n > 1").select("g", "block", *[F.col(f"p{k}").alias(f"q{k}") for k in range(1, LEVELS + 1)], F.expr(f"block div {SPAN}").alias("higher")).join(higher, ["g", "higher"])
            rest = higher.select("g", "block", *[F.col(f"q{k}").alias(f"p{k}") for k in range(1, LEVELS + 1)], steps("block").alias("path"), "top", "root")
            ended = ended.select(rest.columns).unionByName(rest)
        found = ended
    return found.select("g", "block", *[f"p{k}" for k in range(1, LEVELS + 1)], "path", "top", "root")


class Manifest(NamedTuple):
    """Leaves (with idx and n), their trees' blocks, the groups' roots (with idx and n) and the blocks above those."""

    leaves: DataFrame
    trees: list[DataFrame]
    groups: DataFrame
    crown: list[DataFrame]

    def root(self) -> DataFrame:
        """One row, root; none for an empty table."""
        return roots(self.crown).select(F.col("h").alias("root"))

    def proofs(self) -> DataFrame:
        """Every leaf's row with path (its ancestors' preimages and slots), subroot and root."""
        above = self.groups.withColumn("block", F.expr(f"idx div {SPAN}")).withColumnRenamed("g", "of").withColumn("g", F.lit(""))
        above = above.join(paths(self.crown, None), ["g", "block"]).select(F.col("of").alias("g"), steps("idx").alias("path"), "root")
        low = paths(self.trees, above)
        found = self.leaves.withColumn("block", F.expr(f"idx div {SPAN}")).join(low, ["g", "block"])
        return found.withColumn("path", steps("idx")).drop("block", *[f"p{k}" for k in range(1, LEVELS + 1)]).withColumnRenamed("top", "subroot")


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a dataset: written tables in the shared folder, which outlive any executor.

    fields make the leaf, in order; carry are columns of docs to keep beside it.
    """
    found = numbered(leaves(docs, fields, group, key, carry), ["key", "leaf", "row"], "ranged").drop("row")
    trees = grown(found.select("g", "idx", "n", F.col("leaf").alias("h")), "tree")
    tops = roots(trees).select(F.lit("").alias("g"), F.col("g").alias("of"), "h")
    tops = numbered(tops, ["of"], "groups")
    crown = grown(tops.select("g", "idx", "n", "h"), "crown")
    return Manifest(found, trees, tops.select(F.col("of").alias("g"), "idx", "n", "h"), crown)


def siblings(path: str) -> Column:
    """The digests beside the way up, level by level, left to right, as one string."""
    return F.expr(f"array_join(transform({path}, s -> concat(substr(s.pre, 1, {SLOT} * s.slot), substr(s.pre, {SLOT} * s.slot + {SLOT + 1}))), '')")


def folded(leaf: str, path: str) -> Column:
    """The root that leaf gives with the siblings of path."""
    return F.expr(f"aggregate({path}, {leaf}, (h, s) -> sha2(concat(substr(s.pre, 1, {SLOT} * s.slot), h, substr(s.pre, {SLOT} * s.slot + {SLOT + 1})), 256))")


def verified(manifest: Manifest, docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id") -> DataFrame:
    """key and verified for the rows of a dataset that claims to be the manifest's, by key.

    Null where the manifest has no such key. Keys are taken to be unique in both.
    """
    now = docs.select(F.col(key).alias("key"), digest([F.col(f) for f in fields]).alias("now"))
    found = now.join(manifest.proofs().select("key", "path", "root"), "key", "left")
    return found.select(F.col("key").alias(key), (folded("now", "path") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    other = [F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]
    proofs = build(docs, carry={"changed": F.when(changed, digest(other))}).proofs()
    rows = proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), folded("coalesce(changed, leaf)", "path").alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in (*FIELDS[:-1], text)) + ")"


def _tree_sql(name: str, nodes: str, depth: int) -> str:
    """{name}0 .. {name}depth: g, idx, h, n and hs (the run's digests) by level, from nodes (g, idx, h)."""
    sql = ""
    for k in range(depth + 1):
        if k:
            nodes = f"(SELECT g, idx // {ARITY} AS idx, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h FROM {name}{k - 1} GROUP BY g, idx // {ARITY})"
        sql += f"{name}{k} AS MATERIALIZED (SELECT g, idx, h, count(*) OVER (PARTITION BY g) AS n, array_agg(h) OVER (PARTITION BY g, idx // {ARITY} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hs FROM {nodes}),\n"
    return sql


def _fold_sql(name: str, first: str, tree: str, depth: int) -> str:
    """{name}0 .. {name}depth: rid, o (the group), g, idx, sib (siblings so far) and f (folded so far) on the way up tree."""
    sql = f"{name}0 AS MATERIALIZED ({first}),\n"
    for k in range(depth):
        sql += (
            f"{name}{k + 1} AS MATERIALIZED (SELECT rid, o, g, idx // {ARITY} AS idx, CASE WHEN n = 1 THEN sib ELSE sib || array_to_string(hs[1:idx % {ARITY}] || hs[idx % {ARITY} + 2:], '') END AS sib, "
            f"CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(hs[1:idx % {ARITY}] || [f] || hs[idx % {ARITY} + 2:], '')) END AS f FROM {name}{k} JOIN {tree}{k} USING (g, idx)),\n"
        )
    return sql


#: Levels that the SQL has for leaves of a group and for groups: enough for 3 ** 16 and 3 ** 10.
_DEEP, _WIDE = 16, 10

ORACLE_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || source, '') AS g, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS other,
    list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM documents),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx FROM d),
{_tree_sql("t", "(SELECT g, idx, leaf AS h FROM ranked)", _DEEP)}
s AS MATERIALIZED (SELECT g AS o, h, row_number() OVER (ORDER BY g) - 1 AS idx FROM t{_DEEP}),
{_tree_sql("u", "(SELECT 0 AS g, idx, h FROM s)", _WIDE)}
{_fold_sql("v", "SELECT rid, g AS o, g, idx, '' AS sib, CASE WHEN crc % 2 = 1 THEN coalesce(other, leaf) ELSE leaf END AS f FROM ranked", "t", _DEEP)}
{_fold_sql("w", f"SELECT rid, o, 0 AS g, s.idx, sib, f FROM v{_DEEP} JOIN s USING (o)", "u", _WIDE)}
z AS (SELECT rid, s.h AS subroot, u{_WIDE}.h AS root, sha256(sib) AS proof_sha256, f AS folded_root FROM w{_WIDE} JOIN s USING (o) CROSS JOIN u{_WIDE})
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM d JOIN z USING (rid)
"""
