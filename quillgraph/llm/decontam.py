"""Benchmark decontamination by a prefix-filtered set join (operator 10, native).

Every benchmark item yields windows of 13 consecutive words. A window can occur in a
document only where its rarest word occurs, so that word alone (the prefix of the window
in rarity order) is joined with the documents' words; length and position bounds and an
exact comparison of the whole window follow for the few places that are left.

Windows carry no lists of items: windows of the same items share an owner number, a
document gathers the numbers it meets, and items are looked up once for each set of numbers.
While the windows are small (measured in bytes) they are sent round and compared where the
text is; beyond, places alone are shuffled, and texts are joined to those that have any.

Defined results: null text and null items have no words; a text without words has
``n_words`` 0 and is clean; repeated rows each get their row; an empty benchmark leaves
every document clean; a null ``item_id`` hits words but is not listed among the items.
Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import BROADCAST_BYTES, broadcast_if_small, cut, fresh, table

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words while the text still has its case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a row of the join table beside the window's own.
ROW_BYTES = 64


def words(text: Column) -> Column:
    """Words of a text in their own case; lower-casing waits until it is needed."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows_of(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows: w, win (words joined by blanks), len, owner; and owner, items (sorted ids as strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), F.transform(words(F.col("text")), ascii_lower).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    each = w.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item", F.slice("w", F.col("at") + 1, size).alias("w"))
    per = cut(each.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    owners = cut(per.select("items").distinct().withColumn("owner", F.monotonically_increasing_id()), "owners")
    return per.join(owners, "items").select("w", F.array_join("w", " ").alias("win"), F.size("w").alias("len"), "owner"), owners


def prefix_tokens(docs: DataFrame, windows: DataFrame, n_bytes: int, limit: int) -> DataFrame:
    """For every window its rarest word over all documents, with the word's place."""
    parts = windows.select("win", "len", "owner", F.posexplode("w").alias("off", "token")).withColumn("key", F.lower("token"))
    vocabulary = broadcast_if_small(parts.select("key").distinct(), n_bytes, 1, limit)
    counts = docs.select(F.explode(words(F.col("text"))).alias("word")).select(F.lower("word").alias("key")).join(vocabulary, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    rated = parts.join(counts, "key", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("key"), F.col("off"))
    return rated.groupBy("win", "len", "owner").agg(F.min(rank).alias("r")).select(F.col("r.key").alias("key"), F.col("r.off").alias("off"), "len", "win", "owner")


def _found(start: Column, length: Column) -> Column:
    """The words of w from start on, as a window has them."""
    return ascii_lower(F.array_join(F.slice("w", F.greatest(start + 1, F.lit(1)), length), " "))


def occurrences(docs: DataFrame, tokens: DataFrame, near: bool) -> DataFrame:
    """doc_id, h, n_words, s, e, owner: a row with null owner for each document, others for each window in it."""
    w = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    place = (start.alias("s"), (start + F.col("len")).alias("e"), F.col("owner"))
    if near:
        # The empty word closes every document's words; its one partner gives the document's own row.
        mark = docs.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(0).alias("off"), F.lit(0).alias("len"), F.lit("").alias("win"), F.lit(None).cast("long").alias("owner"))
        each = w.select("doc_id", "h", "w", F.size("w").alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
        met = each.withColumn("key", F.lower("word")).join(F.broadcast(tokens.unionByName(mark)), "key")
        return met.where((F.col("len") == 0) | (fits & (_found(start, F.col("len")) == F.col("win")))).select("doc_id", "h", "n_words", *place)
    own = w.select("doc_id", "h", F.size("w").alias("n_words"))
    places = w.select("doc_id", "h", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    met = places.select("doc_id", "h", "n_words", "pos", F.lower("word").alias("key")).join(tokens, "key").where(fits).select(F.col("doc_id").alias("d"), F.col("h").alias("t"), *place, "win")
    likely = met.groupBy("d", "t").agg(F.collect_set(F.struct("s", "e", "owner", "win")).alias("likely"))
    texts = w.join(likely, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")))
    exact = F.filter("likely", lambda x: _found(x["s"], x["e"] - x["s"]) == x["win"])
    hits = texts.select("doc_id", "h", F.size("w").alias("n_words"), F.explode(exact).alias("x")).select("doc_id", "h", "n_words", "x.s", "x.e", "x.owner")
    return own.select("*", F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(None).cast("long").alias("owner")).unionByName(hits)


def covered(spans: str) -> Column:
    """How many words the sorted spans (s, e) of an array cover together."""
    return F.expr(f"aggregate({spans}, named_struct('end', 0, 'n', 0), (a, x) -> named_struct('end', greatest(a.end, x.e), 'n', a.n + greatest(0, x.e - greatest(a.end, x.s))), a -> a.n)")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per document: what the benchmark's windows cover in it.

    contaminated: at least one word is hit and share * n_hit >= n_words.
    """
    return judged(docs, items, size, share).drop("h")


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of docs that are not contaminated."""
    bad_id, bad_h = fresh(docs.columns, "bad_id"), fresh(docs.columns, "bad_h")
    bad = judged(docs, items, size, share).where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("h").alias(bad_h)).distinct()
    bad = cut(bad, "contaminated")
    gone = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_h))
    return docs.join(broadcast_if_small(bad, bad.count()), gone, "left_anti")


def judged(docs: DataFrame, items: DataFrame, size: int, share: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """As decontaminate, with h, the hash of the text. limit: bytes of windows that are sent round."""
    windows, owners = windows_of(items, size)
    n_bytes = windows.agg(F.coalesce(F.sum(F.octet_length("win") + ROW_BYTES), F.lit(0))).first()[0]
    met = cut(occurrences(docs, prefix_tokens(docs, windows, n_bytes, limit), n_bytes <= limit), "occurrences")
    hits = met.where("owner IS NOT NULL").groupBy(F.col("doc_id").alias("d"), F.col("h").alias("t")).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"), F.sort_array(F.collect_set("owner")).alias("owners"))
    hits = cut(hits.select("d", "t", covered("spans").alias("hit"), F.sha2(F.array_join("owners", ","), 256).alias("bag"), "owners"), "hits")
    bags = hits.groupBy("bag").agg(F.first("owners").alias("owners")).select("bag", F.explode("owners").alias("owner")).join(owners, "owner")
    bags = bags.select("bag", F.explode("items").alias("item")).groupBy("bag").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    per = hits.select("d", "t", "hit", "bag").join(bags, "bag", "left")
    out = met.where("owner IS NULL").select("doc_id", "h", "n_words").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left")
    n_words, n_hit, ids = F.col("n_words").cast("long"), F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "h", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS t
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
  FROM (SELECT rid, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes)),
occ AS (SELECT p.rid, p.i, p.n, x.item FROM places p JOIN win x ON p.t = x.t AND p.n = x.n),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM occ) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM occ GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
