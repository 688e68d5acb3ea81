"""Exact repeated-passage removal over suffix arrays (operator 1).

Every byte that a ``MATCH``-byte string covers which also starts somewhere else is removed.

*Where suffixes meet.* A window is a string of MATCH bytes. Its anchor is the gram of GRAM
bytes in it with the least hash, the leftmost of equals; that depends on the window's bytes
alone, so equal windows have equal anchors. Runs of successive windows with one anchor form
a segment, some 300 bytes long, and only segments whose anchor gram occurs more than once
can hold a repeat. Where all segments of a gram are the same string, all their windows are
repeats and no text moves. Otherwise the gram's distinct segments go to one task:

*Two-stage suffix sort.* There the segments are concatenated; suffixes smaller than their
successors are sorted directly, all others are induced from them by a scan over the
buckets of first bytes; common prefixes of neighbours then show the repeated windows.
Suffixes that no window needs are left out.

*Hot grams.* A gram with more than ``HOT`` distinct segments (the edge of a passage that very
many documents share) is not gathered: its windows are counted by hash, pre-aggregated.

Defined results: null text counts as empty; texts shorter than MATCH keep all bytes;
repeated rows are repeats of one another and each gets its row; rows without a doc_id are
told apart by their text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, prepared, release, table

MATCH = 200
GRAM = 32
#: Bytes that are hashed at a time.
BLOCK = 1 << 20
#: Bytes of segments that are sorted at a time, unless one gram has more.
SORT_BYTES = 1 << 17
#: Distinct segments of a gram up to which they are sorted in one task (some 6 MB).
HOT = 20_000

_BASE = 0x9E3779B97F4A7C15
_POS = np.uint64(21)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base), dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Grams:
    """Rolling hashes of grams and least ones in windows, over blocks of bytes."""

    def __init__(self, match: int, gram: int):
        self.match, self.gram, self.wide = match, gram, match - gram + 1
        n = BLOCK + match + 1
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def segments(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Segments of the texts data[first:last]: gram hash, start, end.

        The texts lie one after the other in data; those shorter than match have none.
        """
        n, k, w = len(data), self.gram, self.wide
        none = np.zeros(0, np.int64)
        if n < self.match:
            return none.astype(np.uint64), none, none
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(data * self.down[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self.up[k - 1 : n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        order = (h >> _POS << _POS) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(order) // w) + 1
        grid = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        grid[: len(order)] = order
        grid = grid.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        m = n - self.match + 1
        at = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & np.uint64((1 << 21) - 1)).astype(np.int64)
        # windows that lie within one text
        edge = np.zeros(n + 1, dtype=np.int32)
        long = last - first >= self.match
        np.add.at(edge, first[long], 1)
        np.add.at(edge, last[long] - self.match + 1, -1)
        good = np.cumsum(edge)[:m] > 0
        fresh = good.copy()
        fresh[1:] &= (at[1:] != at[:-1]) | ~good[:-1]
        fresh[first[long]] = True
        starts = np.flatnonzero(fresh)
        stop = good & ~np.append(good[1:] & ~fresh[1:], False)
        return h[at[starts]], starts, np.flatnonzero(stop) + self.match


def _blocks(offsets: np.ndarray, match: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Spans of bytes of at most BLOCK + match, with the texts (row, first, last) in them.

    A longer text is cut into pieces that overlap so far that every window is in one.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        a, b = int(offsets[row]), int(offsets[row + 1])
        if b - a > BLOCK:
            for at in range(a, b - match + 1, BLOCK):
                end = min(b, at + BLOCK + match - 1)
                yield at, end, [(row, at, end)]
            row += 1
            continue
        inside, start = [], a
        while row < rows and int(offsets[row + 1]) - start <= BLOCK:
            inside.append((row, int(offsets[row]), int(offsets[row + 1])))
            row += 1
        yield start, inside[-1][2], inside


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and where each row begins and ends."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def segments(docs: DataFrame, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """gram, seg (hash of the whole segment), rid, place (start << 16 | length); docs: rid, bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(match, gram)
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rids = batch.column(0).to_numpy()
            data, offsets = _bytes_of(batch.column(1))
            for a, b, inside in _blocks(offsets, match):
                row, first, last = (np.array(x) for x in zip(*inside))
                own = data[a:b]
                keys, starts, ends = grams.segments(own, first - a, last - a)
                if not len(keys):
                    continue
                raw = own.tobytes()
                seg = np.array([digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)
                of = row[np.searchsorted(first - a, starts, side="right") - 1] if len(row) > 1 else np.full(len(starts), row[0])
                place = (starts + a - offsets[of]) << 16 | (ends - starts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(rids[of]), pa.array(place)], ["gram", "seg", "rid", "place"])

    return docs.select("rid", "bytes").mapInArrow(find, "gram long, seg long, rid long, place long")


def two_stage_sort(text: np.ndarray, need: np.ndarray, depth: int) -> np.ndarray:
    """The needed suffixes of text in order of their first depth bytes.

    need must hold, with every suffix greater than its successor, the successor too.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    step = np.sign(padded[1 : n + 1].astype(np.int16) - text)
    step[-1] = 1  # the last suffix goes with the smaller ones
    ahead = np.where(step != 0, np.arange(n), n - 1)
    ahead = np.minimum.accumulate(ahead[::-1])[::-1]
    smaller = step[ahead] > 0
    direct = np.flatnonzero(need & smaller)
    views = np.lib.stride_tricks.sliding_window_view(padded, depth)
    direct = direct[np.ascontiguousarray(views[direct]).view(f"S{depth}").reshape(-1).argsort(kind="stable")]
    induced = need & ~smaller
    firsts = text[direct]
    waiting: dict[int, list[np.ndarray]] = {}
    out = []
    for c in range(256):
        lo, hi = np.searchsorted(firsts, [c, c + 1])
        parts = waiting.pop(c, [])
        if lo == hi and not parts:
            continue
        mine = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        runs = [mine]
        while len(mine):  # c before c: still the same bucket
            mine = mine[mine > 0] - 1
            mine = mine[induced[mine] & (text[mine] == c)]
            runs.append(mine)
        bucket = np.concatenate([*runs, direct[lo:hi]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before]]
        chars = text[before]
        before, chars = before[chars > c], chars[chars > c]
        order = chars.argsort(kind="stable")
        before, chars = before[order], chars[order]
        cuts = np.flatnonzero(np.diff(chars)) + 1
        for part in np.split(before, cuts):
            if len(part):
                waiting.setdefault(int(text[part[0]]), []).append(part)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def repeated_windows(parts: list[bytes], match: int) -> list[np.ndarray]:
    """For each string the starts of windows that another place among the strings holds too."""
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = ends - [len(p) + 1 for p in parts]
    raw = np.frombuffer(b"\xff".join(parts) + b"\xff", dtype=np.uint8)
    text = raw + np.uint8(1)  # UTF-8 has no byte 255, so 0 now ends a string and nothing else
    n = len(text)
    at = np.arange(n)
    of = np.searchsorted(ends, at, side="right")
    window = at + match < ends[of]
    need = window.copy()
    todo = np.flatnonzero(window[:-1] & ~window[1:]) + 1
    step = np.diff(text.astype(np.int16), append=300)
    ahead = np.minimum.accumulate(np.where(step != 0, at, n - 1)[::-1])[::-1]
    smaller = step[ahead] > 0
    while len(todo):  # whatever a needed suffix is induced from is needed
        need[todo] = True
        todo = todo[~smaller[todo]] + 1
    order = two_stage_sort(text, need, match)
    order = order[window[order]]
    hit = np.zeros(n, dtype=bool)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(match, dtype=np.uint8)]), match)
    for k in range(0, len(order) - 1, 1 << 16):
        a, b = order[k : k + (1 << 16)], order[k + 1 : k + 1 + (1 << 16)]
        a = a[: len(b)]
        differs = views[a] != views[b]
        prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), match)  # common prefixes of neighbours
        same = prefix >= match
        hit[a[same]] = True
        hit[b[same]] = True
    found = np.flatnonzero(hit)
    return [found[i:j] - s for i, j, s in zip(np.searchsorted(found, starts), np.searchsorted(found, ends), starts)]


def covered(starts: np.ndarray, match: int) -> list[tuple[int, int]]:
    """Maximal byte runs that windows at sorted starts cover."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > match) + 1
    return [(int(p[0]), int(p[-1]) + match) for p in np.split(starts, cuts)]


RUNS = "array<struct<s:long,e:long>>"


def sort_segments(distinct: DataFrame, match: int) -> DataFrame:
    """gram, seg, runs: what of each distinct segment (gram, seg, bytes, n) is repeated."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = repeated_windows([h[2] for h in held], match)
            runs = [[{"s": 0, "e": len(h[2])}] if h[3] > 1 else [{"s": s, "e": e} for s, e in covered(f, match)] for h, f in zip(held, found)]
            out = [(h[0], h[1], r) for h, r in zip(held, runs) if r]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], ["gram", "seg", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield flush()
                    size = 0
                held.append(row)
                size += len(row[2])
        if held:
            yield flush()

    dealt = distinct.select("gram", "seg", "bytes", "n").repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(work, f"gram long, seg long, runs {RUNS}")


def count_windows(distinct: DataFrame, match: int) -> DataFrame:
    """As sort_segments, for grams with too many segments: windows are counted by hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, seg, raw, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                w = [hashlib.blake2b(raw[k : k + match], digest_size=16).digest() for k in range(len(raw) - match + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([gram] * len(w)), pa.array([seg] * len(w)), pa.array(range(len(w)), pa.int64()), pa.array(w, pa.binary()), pa.array([n] * len(w))], ["gram", "seg", "at", "w", "n"])

    windows = cut(distinct.select("gram", "seg", "bytes", "n").mapInArrow(explode, "gram long, seg long, at long, w binary, n long"), "windows")
    again = windows.groupBy("w").agg(F.sum("n").alias("k")).where("k > 1").select("w")
    hit = windows.join(again, "w").select("gram", "seg", "at")
    return hit.groupBy("gram", "seg").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + match).alias("e")))).alias("runs"))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def result_row(raw: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    digest, at = hashlib.sha256(), 0
    for s, e in runs:
        digest.update(raw[at:s])
        at = e
    digest.update(raw[at:])
    return len(raw), sum(e - s for s, e in runs), len(runs), digest.hexdigest()


def _gather(spark: SparkSession, rows: DataFrame, match: int, gram: int) -> DataFrame:
    """rows with runs (of grams whose segments are all alike) and mixed (segments to compare).

    A table by buckets of rid, so that the texts need no second shuffle.
    """
    places = segments(rows, match, gram)
    grams = places.groupBy("gram").agg(F.count("*").alias("n"), F.min("seg").alias("a"), F.max("seg").alias("b")).where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed"))
    grams = cut(grams, "grams")  # written, so that the join below can split hot grams
    hits = places.join(grams, "gram").select("rid", F.shiftright("place", 16).alias("at"), F.col("place").bitwiseAND(0xFFFF).alias("len"), F.when(F.col("mixed"), F.col("gram")).alias("gram"), F.when(F.col("mixed"), F.col("seg")).alias("seg"))
    by_doc = hits.groupBy("rid").agg(F.collect_set(F.when(F.col("gram").isNull(), F.struct(F.col("at").alias("s"), (F.col("at") + F.col("len")).alias("e")))).alias("runs"), F.collect_set(F.when(F.col("gram").isNotNull(), F.struct("at", "len", "gram", "seg"))).alias("mixed"))
    name = f"quillgraph_suffixes_{uuid.uuid4().hex}"
    rows.join(by_doc, "rid", "left").write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid").saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and runs (removed byte runs), a row for each row."""
    prepared(docs.sparkSession)
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = not ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()
    rid = F.xxhash64("doc_id", "text") if odd else F.col("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(rid.alias("rid"), "doc_id", F.col("text").cast("binary").alias("bytes"))

    state = _gather(spark, rows, match, gram)
    release(spark)

    mixed = state.select("rid", "bytes", F.explode("mixed").alias("m")).select("rid", "m.*", F.expr("substring(bytes, cast(m.at + 1 as int), cast(m.len as int))").alias("bytes"))
    distinct = cut(mixed.groupBy("gram", "seg").agg(F.first("bytes").alias("bytes"), F.count("*").alias("n")), "segments")
    release(spark)
    per_gram = distinct.groupBy("gram").agg(F.count("*").alias("k"))
    crowded = per_gram.where(F.col("k") > hot).select("gram")
    if crowded.isEmpty():
        found = sort_segments(distinct, match)
    else:
        crowded = cut(crowded, "crowded")
        found = sort_segments(distinct.join(crowded, "gram", "left_anti"), match).unionByName(count_windows(distinct.join(crowded, "gram", "left_semi"), match))
    spread = state.select("rid", F.explode("mixed").alias("m")).select("rid", "m.at", "m.gram", "m.seg").join(found, ["gram", "seg"])
    more = spread.groupBy("rid").agg(F.flatten(F.collect_list(F.transform("runs", lambda r: F.struct((r["s"] + F.col("at")).alias("s"), (r["e"] + F.col("at")).alias("e"))))).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, runs_out = [], []
            for raw, runs, extra in zip(batch.column("bytes"), batch.column("runs").to_pylist(), batch.column("more").to_pylist()):
                runs = merged([(r["s"], r["e"]) for r in (runs or []) + (extra or [])])
                out.append(result_row(raw.as_py(), runs))
                runs_out.append([{"s": s, "e": e} for s, e in runs])
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))), pa.array(runs_out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"])

    return state.select("rid", "doc_id", "bytes", "runs").join(more, "rid", "left").mapInArrow(finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, runs {RUNS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("runs")


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT rid, b, unnest(range(1, octet_length(b) - {MATCH - 2})) AS i FROM d WHERE octet_length(b) >= {MATCH}),
w AS (SELECT rid, i, md5(b[i:i + {MATCH - 1}]) AS h FROM places),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT rid, i FROM w SEMI JOIN again USING (h)),
steps AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= {MATCH} THEN 0 ELSE 1 END AS fresh FROM hit),
islands AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM steps),
runs AS (SELECT rid, min(i) AS s, max(i) + {MATCH} AS e FROM islands GROUP BY rid, k),
l AS (SELECT rid, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es, sum(e - s) AS removed, count(*) AS n FROM runs GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN ss IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(ss) + 1),
    lambda j: b[(CASE WHEN j = 0 THEN 1 ELSE es[j] END):(CASE WHEN j = len(ss) THEN octet_length(b) ELSE ss[j + 1] - 1 END)]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN l USING (rid)
"""
