"""Near-duplicate documents by Order MinHash (operator 3).

Words are runs of letters, digits and underscores in lower case; a text's shingles are its
runs of five words (a shorter text is one shingle). Two texts are near-duplicates if the
longest common subsequence L of their shingle sequences gives L / (a + b - L) >= 0.8: a
Jaccard similarity that also asks for equal order, found by banded bit-parallel alignment.

1. Texts of equal words are one class; only one text of a class goes on.
2. Order MinHash: under each of ``SKETCHES`` permutations the two least occurrence-labelled
   shingles, in text order, make a key. Two texts at 0.8 share no key with odds of 5e-6.
3. Texts that share a key are a bucket; of buckets with the same members one is kept. The
   members' shingle sequences meet in one task. Exact overlaps of all labelled shingle sets
   (a matrix product) rule out most pairs; the rest are aligned, most alike first, and only
   until no pair is left whose members are still apart. What is written are the links of
   that forest, so output grows with members, and no link between parts is lost.
4. Buckets of over ``BLOCK`` texts or ``BLOCK_BYTES`` are dealt to blocks. Each member is first
   aligned with ``STARS`` members of its bucket. Members that are then, over all buckets, in
   one component need no more comparisons among themselves: only those outside a bucket's
   largest component meet all others, block by block. A group of near copies of any size so
   costs in proportion to its members.
5. Links of all buckets are joined into components.

Defined results: a document's class is the smallest doc_id of its component; texts without
words (null, empty, signs only) are classes of their own; repeated rows share a class, one
of them is kept; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import broadcast_if_small, cut, fresh, prepared, release, remembered, table
from quillgraph.llm.components import components

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 12
#: Texts, and bytes of shingles, of a block: a task holds two.
BLOCK, BLOCK_BYTES = 1_536, 12 << 20
#: Members of a crowded bucket that all others are aligned with first.
STARS = 8
#: Columns of the overlap matrix that are multiplied at a time.
COLUMNS = 4_096
WORD_CACHE = 150_000

_WORD = re.compile(r"\w+").findall


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = h
        return h


def _hashes() -> _Hashes:
    return remembered("word hashes", _Hashes)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    words = _WORD(text.lower())
    return np.fromiter(map(_hashes().__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of the runs of size words, in order; of all words if they are fewer."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return out


_SEEDS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def order_minhash(seq: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """The keys of a shingle sequence: two least labelled shingles, in text order, each."""
    n = len(seq)
    order = seq.argsort(kind="stable")
    ranked = seq[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    if not new.all():  # label the k-th occurrence of a shingle with k
        at = np.arange(n)
        label = np.empty(n, dtype=np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        seq = _mix(seq + label * np.uint64(0x632BE59BD9B4E019))
    h = _mix(seq[None, :] ^ _SEEDS[:sketches, None])
    if n == 1:
        return _mix(h[:, 0])
    if n == 2:
        least = np.tile([0, 1], (sketches, 1))
    else:
        least = np.sort(np.argpartition(h, 1, axis=1)[:, :2], axis=1)
    a, b = h[np.arange(sketches), least[:, 0]], h[np.arange(sketches), least[:, 1]]
    return _mix(a * np.uint64(3) + b)


def common_subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose path stays within the band.

    Bit-parallel: a row of the alignment is one integer of which only the band's bits are
    worked on, in strips of rows.
    """
    low = 0
    n = min(len(a), len(b))
    if n:
        same = a[:n] == b[:n]
        low = n if same.all() else int(same.argmin())
        a, b = a[low:], b[low:]
        n = min(len(a), len(b))
        if n:
            same = a[::-1][:n] == b[::-1][:n]
            tail = n if same.all() else int(same.argmin())
            a, b, low = a[: len(a) - tail], b[: len(b) - tail], low + tail
    if not len(a) or not len(b):
        return low
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a.tolist()):
        where[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    strip = max(64, band)
    tokens = b.tolist()
    for top in range(0, len(tokens), strip):
        left, right = max(0, top - band), min(len(a), top + strip + band + 1)
        if left >= right:
            continue
        mask = (1 << (right - left)) - 1
        part = (v >> left) & mask
        for y in tokens[top : top + strip]:
            m = where.get(y)
            if m is None:
                continue
            u = part & (m >> left) & mask
            part = ((part + u) | (part - u)) & mask
        v = (v & ~(mask << left)) | (part << left)
    return low + len(a) - v.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the alignment of two shingle sequences reaches the similarity."""
    need = least / (1 + least) * (len(a) + len(b))
    if min(len(a), len(b)) < need - 1e-9:
        return False
    if min(np.isin(a, b).sum(), np.isin(b, a).sum()) < need - 1e-9:
        return False
    return common_subsequence(a, b, int(len(a) + len(b) - 2 * need) + 1) >= need - 1e-9


def sketched(rows: DataFrame, sketches: int = SKETCHES) -> DataFrame:
    """rid, doc_id, key (of the words; null without words), n (shingles), keys (8 bytes each)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, keys = [], [], []
            for text in batch.column(2):
                w = word_hashes(text.as_py() or "")
                if not len(w):
                    key.append(None)
                    n.append(0)
                    keys.append(None)
                    continue
                s = shingles(w)
                key.append(xxhash.xxh3_128_digest(w.tobytes()))
                n.append(len(s))
                keys.append(order_minhash(s, sketches).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.binary())], ["rid", "doc_id", "key", "n", "keys"])

    return rows.mapInArrow(sketch, "rid long, doc_id long, key binary, n int, keys binary")


def labelled(seq: np.ndarray) -> np.ndarray:
    """Shingles told apart by occurrence, so that set overlaps are multiset overlaps."""
    order = seq.argsort(kind="stable")
    ranked = seq[order]
    at = np.arange(len(seq))
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(seq)]
    return ranked.astype(np.uint64) | (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) << np.uint64(32)


def overlaps(seqs: list[np.ndarray]) -> np.ndarray:
    """Sizes of the multiset intersections of all pairs of sequences."""
    n = len(seqs)
    member = np.repeat(np.arange(n), [len(s) for s in seqs])
    _, column, count = np.unique(np.concatenate([labelled(s) for s in seqs]), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    member, column = member[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = column.argsort(kind="stable")
    member, column = member[order], column[order]
    total = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - first)), dtype=np.float32)
        part[member[lo:hi], column[lo:hi] - first] = 1
        total += part @ part.T
    return total


def bucket_links(seqs: list[np.ndarray], own: np.ndarray, label: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (by place) that join all members that similar pairs connect.

    own: the members' sides; if there are two, only pairs between them are looked at.
    label: members of one label are joined already.
    """
    size = np.array([len(s) for s in seqs], dtype=np.float32)
    both = size[:, None] + size[None, :]
    overlap = overlaps(seqs)
    likely = np.triu(overlap >= least / (1 + least) * both - 1e-3, 1)
    if own.min() != own.max():
        likely &= own[:, None] != own[None, :]
    i, j = np.nonzero(likely)
    order = np.argsort(-(overlap[i, j] / (both[i, j] - overlap[i, j])), kind="stable")
    i, j = i[order], j[order]
    part, links, at = np.unique(label, return_inverse=True)[1], [], 0
    while at < len(i):
        near = slice(at, at + 4096)
        apart = np.flatnonzero(part[i[near]] != part[j[near]])
        if not len(apart):
            at += 4096
            continue
        at += int(apart[0])
        x, y = int(i[at]), int(j[at])
        at += 1
        if similar(seqs[x], seqs[y], least):
            links.append((x, y))
            part[part == part[y]] = part[x]
    return links


def buckets(texts: DataFrame, sketches: int, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """bucket, g, rid: members of the buckets to be looked at, in g blocks each.

    texts: rid, n, keys, a row for each distinct text.
    """
    band = F.explode(F.sequence(F.lit(0), F.lit(sketches - 1)))
    each = texts.select("rid", "n", "keys", band.alias("band")).select("rid", "n", F.xxhash64("band", F.expr("substring(keys, band * 8 + 1, 8)")).alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("a"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("b")).where("size > 1")
    g = F.ceil(F.greatest(F.col("size") / block, 4 * F.col("n") / block_bytes)).cast("int")
    once = cut(sizes.groupBy("size", "n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", F.greatest(g, F.lit(1)).alias("g")), "buckets")
    return each.select("bucket", "rid").join(once, "bucket")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["x", "y"])


def linked(met: DataFrame, least: float) -> DataFrame:
    """x, y: labels of members that verified links join.

    met: bucket, p, q (which together are a task's), own (side), rid, label, seq.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(out: list[tuple[int, int]]) -> None:
            if len(held) > 1:
                found = bucket_links([np.frombuffer(h[6], np.uint32) for h in held], np.array([h[3] for h in held]), np.array([h[5] for h in held]), least)
                out += [(held[i][5], held[j][5]) for i, j in found]
            held.clear()

        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if held and row[:3] != held[0][:3]:
                    flush(out)
                held.append(row)
            yield _pairs(out)
        out = []
        flush(out)
        yield _pairs(out)

    dealt = met.select("bucket", "p", "q", "own", "rid", "label", "seq").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "rid")
    return dealt.mapInArrow(verify, "x long, y long")


def _dealt(n: str) -> Column:
    return F.pmod(F.xxhash64("rid", F.lit(1)), F.col(n)).cast("int")


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def starred(crowded: DataFrame, seqs: DataFrame, least: float, stars: int) -> DataFrame:
    """x, y: links between members of crowded buckets (bucket, g, rid) and the bucket's stars."""
    h = F.xxhash64("rid", F.lit(2))
    chosen = crowded.groupBy("bucket", "g", F.pmod(h, F.lit(stars)).cast("int").alias("star")).agg(F.min(F.struct(h.alias("h"), "rid"))["rid"].alias("rid"))
    sent = chosen.join(seqs, "rid").select("bucket", _every("g").alias("own"), "star", "rid", "seq")
    members = crowded.join(seqs, "rid").select("bucket", _dealt("g").alias("own"), F.lit(stars).alias("star"), "rid", "seq")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, centres = None, []
        for batch in batches:
            out = []
            for bucket, own, star, rid, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if task != (bucket, own):
                    task, centres = (bucket, own), []
                seq = np.frombuffer(raw, np.uint32)
                if star < stars:
                    centres.append((rid, seq))
                    continue
                at = next((c for c in centres if c[0] == rid), None)
                # a star looks for an earlier one, others for the first that is like them
                for c in centres:
                    if c is at:
                        break
                    if similar(seq, c[1], least):
                        out.append((rid, c[0]))
                        break
            yield _pairs(out)

    dealt = sent.unionByName(members).repartition("bucket", "own").sortWithinPartitions("bucket", "own", "star", "rid")
    return dealt.mapInArrow(align, "x long, y long")


def across(crowded: DataFrame, seqs: DataFrame, labels: DataFrame) -> DataFrame:
    """What linked takes: members outside the largest component of their crowded bucket, against all others.

    labels: node, root of the components so far.
    """
    named = crowded.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("bucket", "g", "rid", F.coalesce("root", "rid").alias("label"))
    named = cut(named, "named")
    sizes = named.groupBy("bucket", "g", "label").agg(F.count("*").alias("n")).groupBy("bucket", "g").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("total"))
    # their blocks, f, are of the size that the g blocks of all are of
    few = F.col("total") - F.col("m.n")
    sizes = cut(sizes.where(few > 0).select("bucket", F.col("m.label").alias("most"), F.ceil(F.col("g") * few / F.col("total")).cast("int").alias("f")), "sizes")
    met = named.join(sizes, "bucket").join(seqs, "rid")
    few = met.where("label <> most").select("bucket", _dealt("f").alias("p"), _every("g").alias("q"), F.lit(0).alias("own"), "rid", "label", "seq")
    return few.unionByName(met.select("bucket", _every("f").alias("p"), _dealt("g").alias("q"), F.lit(1).alias("own"), "rid", "label", "seq"))


def sequences(rows: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """rid, seq (4 bytes a shingle) of the wanted texts."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [(shingles(word_hashes(t.as_py() or "")) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.binary())], ["rid", "seq"])

    return rows.select("rid", "text").join(broadcast_if_small(wanted, n_wanted), "rid", "left_semi").mapInArrow(cut_up, "rid long, seq binary").dropDuplicates(["rid"])


def with_rids(docs: DataFrame) -> tuple[DataFrame, bool]:
    """rid, doc_id, text; rid is the doc_id unless ids repeat or lack, then a hash of the row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = not ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select((F.xxhash64("doc_id", "text") if odd else F.col("doc_id")).alias("rid"), "doc_id", "text"), odd


def kept_documents(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """The rows of docs that stand for their classes."""
    rows, odd = with_rids(docs)
    found = _classes(rows, odd, least, sketches)
    out = fresh(docs.columns, "gone")
    if odd:  # what goes is told by row; of rows that are alike in id and text one stays
        rid = fresh(docs.columns, "rid")
        mine = F.xxhash64(F.col("doc_id").cast("long"), "text")
        gone = cut(found.groupBy("rid").agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col("rid").alias(out)), "gone")
        return docs.withColumn(rid, mine).join(broadcast_if_small(gone, gone.count()), F.col(rid) == F.col(out), "left_anti").dropDuplicates([rid]).drop(rid)
    gone = cut(found.where("NOT kept").select(F.col("doc_id").alias(out)), "gone")
    return docs.join(broadcast_if_small(gone, gone.count()), F.col("doc_id") == F.col(out), "left_anti")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, class_id, kept: a row for each row of docs; one row of a class is kept."""
    prepared(docs.sparkSession)
    return _classes(*with_rids(docs), least, sketches, block, block_bytes).drop("rid")


def _classes(rows: DataFrame, odd: bool, least: float, sketches: int, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid, doc_id, class_id, kept of rows (rid, doc_id, text)."""
    sketch = cut(sketched(rows, sketches), "sketches")
    classes = sketch.where("key IS NOT NULL").groupBy("key").agg(F.min("rid").alias("rid"))
    # the sketch of a class is that of the document that stands for it
    texts = cut(sketch.select("rid", "n", "keys").join(classes.select("rid"), "rid", "left_semi").dropDuplicates(["rid"]), "texts")
    members = cut(buckets(texts, sketches, block, block_bytes), "members")
    wanted = members.select("rid").distinct()
    seqs = cut(sequences(rows, wanted, members.count()), "sequences")
    release(rows.sparkSession)
    single = members.where("g = 1").join(seqs, "rid").select("bucket", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("own"), "rid", F.col("rid").alias("label"), "seq")
    links = linked(single, least)
    crowded = members.where("g > 1")
    if not crowded.isEmpty():
        known = components(cut(links.unionByName(starred(crowded, seqs, least, STARS)), "links"))
        links = known.toDF("x", "y").unionByName(linked(across(crowded, seqs, known), least))
    links = cut(links, "links")
    release(rows.sparkSession)
    roots = components(links).select(F.col("node").alias("rid"), "root")
    of_class = classes.join(roots, "rid", "left")
    of_class = of_class.select("key", F.coalesce("root", "rid").alias("root"))
    out = sketch.select("rid", "doc_id", "key").join(of_class, "key", "left").select("rid", "doc_id", F.coalesce("root", "rid").alias("root"))
    if not odd:
        return out.select("rid", "doc_id", F.col("root").alias("class_id"), (F.col("doc_id") == F.col("root")).alias("kept"))
    least_id = out.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = out.join(least_id, "root").withColumn("first", F.col("doc_id").eqNullSafe(F.col("class_id")))
    nth = F.row_number().over(W.partitionBy("root", "first").orderBy("doc_id"))
    firsts = out.where("first").withColumn("kept", nth == 1)
    return firsts.unionByName(out.where("NOT first").withColumn("kept", F.lit(False))).select("rid", "doc_id", "class_id", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
