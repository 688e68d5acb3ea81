"""Best-fit packing of tokenised documents into fixed-length sequences (operator 8).

Method: large-item matching. Pieces above a third of the capacity share a sequence at most
two at a time; a greedy matching gives each, largest first, the largest partner that still
fits. Smaller pieces then go, largest first, where they leave the least room.

Only lengths matter to the plan, and there are at most ``capacity`` of them, so the plan is
made from a histogram (at most ``capacity`` rows on the driver, whatever the corpus). Bins
of like content are planned together as (pattern, number). Each piece then finds its bin
from its rank among the pieces of its length; ranks come from counts per (length, bucket),
so no task gathers a length. The result is exactly what piece-by-piece packing would give.

Defined results: null text is an empty text and yields one piece that is the end mark
alone; repeated rows are packed each; an empty table yields no rows. Other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import string
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from quillgraph.llm.common import cut, prepared, remembered, table

CAPACITY = 2048
END = 0
#: Ranks within a length are counted in buckets: this many at least, and one for so many pieces.
BUCKETS, BUCKET_ROWS = 64, 200_000
#: Signs that make one token run of their own after a word.
SIGNS = string.punctuation
#: Words whose ids a worker remembers at most (some 35 MB).
CACHE_WORDS = 200_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids of a text (little-endian, 4 bytes each), put together from remembered words.

    The tokenizer lower-cases, drops white space and merges within words only, so a text's
    ids are its words' ids one after the other. Texts with anything but Latin letters,
    ASCII and a few signs go to the tokenizer whole, so normalisation cannot differ.
    """

    #: Letters whose NFC form and lower case are one code point each.
    _LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        # for one word that is already in lower case: the same merges without the regexes
        self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}))
        self.plain = re.compile(rf"[{self._LETTERS}\x20-\x3B=\x3F-\x7E\n\t]*").fullmatch
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{self._LETTERS}]+|[0-9]|[^\s{self._LETTERS}0-9]+").findall
        self.limit = limit

    def __missing__(self, chunk: str) -> bytes:
        """Of what stands between blanks, in lower case; remembered up to the limit."""
        if chunk.isalpha():
            found = self.packed(self.merges.encode(chunk, add_special_tokens=False).ids)
        elif (word := chunk.rstrip(SIGNS)).isalpha():
            return self[word] + self[chunk[len(word) :]]
        elif len(parts := self.split(chunk)) > 1:
            return b"".join(map(self.__getitem__, parts))
        else:
            found = self.packed(self.merges.encode(chunk, add_special_tokens=False).ids)
        if len(self) < self.limit:
            self[chunk] = found
        return found

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if not self.plain(text):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.lower().split()))


def word_ids(path: str) -> WordIds:
    """One for each Python worker, which outlives its tasks."""
    return remembered(f"ids of {path}", lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; the texts stay behind."""
    prepared(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(path), struct.pack("<I", END)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, number of bins) covering the histogram exactly."""
    left = {n: c for n, c in histogram.items() if c}
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if not bins[room]:
            insort(gaps, room)
        bins[room].append((pattern, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        if k < 0:
            put((a,), left[a])
            left[a] = 0
            continue
        b = large[k]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if not n:  # the last of its length pairs with a smaller one, if any
            smaller = [x for x in large[:k] if left[x]]
            put((a, smaller[-1]) if smaller else (a,), 1)
            left[a] -= 1
            if smaller:
                left[smaller[-1]] -= 1
            continue
        put((a, b), n)
        left[a] -= n
        left[b] -= n
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[size]
        while todo:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                fit = capacity // size
                if todo >= fit:
                    put((size,) * fit, todo // fit)
                if todo % fit:
                    put((size,) * (todo % fit), 1)
                break
            room = gaps[at]
            pattern, n = bins[room].pop()
            if not bins[room]:
                gaps.pop(at)
            fit = room // size
            full = min(n, todo // fit)
            if full:
                put(pattern + (size,) * fit, full)
                n -= full
                todo -= full * fit
            if n and todo:  # fewer than fit are left: one bin takes them
                put(pattern + (size,) * todo, 1)
                n -= 1
                todo = 0
            if n:
                put(pattern, n)
    return [x for group in bins.values() for x in group]


def slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first bin, offset and pieces per bin of every stretch of ranks."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, n in bins:
        at, k = 0, 0
        while k < len(pattern):
            size, run = pattern[k], 1
            while k + run < len(pattern) and pattern[k + run] == size:
                run += 1
            out[size].append((used[size], first, at, run))
            used[size] += run * n
            at, k = at + run * size, k + run
        first += n
    return {size: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for size, rows in out.items()}


def ranked(items: DataFrame, buckets: int) -> DataFrame:
    """Adds rank: from 0 within each length, without gathering a length in one task."""
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    # the window and the join need the same partitioning, so items are shuffled once
    inner = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("rank", F.row_number().over(inner) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    prepared(docs.sparkSession)
    spark = docs.sparkSession
    items = cut(pieces(docs, path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(BUCKETS, sum(histogram.values()) // BUCKET_ROWS)
    n_full = histogram.pop(capacity, 0)
    bins = plan(histogram, capacity)
    where = spark.sparkContext.broadcast((slots([*bins, ((capacity,), n_full)] if n_full else bins), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size, _ = where.value
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                mine = np.flatnonzero(size == s)
                start, first, at, run = by_size[int(s)]
                k = np.searchsorted(start, rank[mine], side="right") - 1
                d = rank[mine] - start[k]
                seq[mine], off[mine] = first[k] + d // run[k], at[k] + d % run[k] * s
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(items, buckets).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
