"""Product codes of vectors, learned in exact integers (operator 13).

Components become integers, floor(256 x); vectors are cut into 16 parts, and each part position
has a codebook of 64 entries, learned by Lloyd's rounds.

Method (Heap Lloyd): with each part goes a lower bound of how far the second nearest entry is
and an upper bound of how far its own is. Their difference, the slack, is the key of a heap
that every entry keeps over its parts in a block of rows. When entries move, a part's slack
shrinks by no more than its entry's move and the largest move of another one; these add up by
entry. A round pops from each heap the parts whose key the sum has reached, compares those
alone with all entries, exactly, and pushes them anew, keyed by their new slack above the sum
so far. All others keep their entry: it cannot have changed.

A heap is kept as a sorted run, which is a heap whose pops are a prefix, so a block's heaps are
three arrays (keys, rows and where each entry's run starts). Keys are rounded down, so that
rounding makes a part be compared again at worst.

How it scales: the table is read twice (for the first entries, then into blocks of at most
``BLOCK_ROWS`` rows with their heaps); each round reads and writes the blocks in place of
the table, without a shuffle. Blocks carry their own sums by entry, which Spark adds up, so the
driver gets one row per entry and part position (entries x dimensions numbers) and sends back
the codebooks, of the same size. Rounds are written to the shared folder; a lost executor
repeats its own blocks from the last written round.

Defined results: rows whose vector is null or holds a null or non-finite component are left
out; repeated rows count each, also among the first entries; with fewer rows than entries the
codebooks are as small; an empty table gives no rows; labels may be null and are a group then.
Other columns are ignored. Vectors of unlike length, a length that parts do not divide, and
components of 2 ** 18 or more raise an error, for no exact code is defined there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import BROADCAST_BYTES, cut, prepared, remove, scratch_path, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows of a block, and numbers of a block's vectors: row places fit two bytes, blocks a few MB.
BLOCK_ROWS, BLOCK_NUMBERS = 8192, 1 << 20
#: Scaled components stay below this, so every squared distance is exact in 64-bit numbers.
LARGEST = 1 << 26
#: Up to this, products are exact in floating point too, where they are faster.
EXACT_FLOAT = 1 << 20
#: What bounds give away for rounding, relative.
MARGIN = 1e-9
#: Copies of a label's sum beyond BROADCAST_BYTES, so that a hot label's rows are spread.
SALTS = 32


def scaled(flat: np.ndarray) -> np.ndarray:
    found = np.floor(SCALE * flat.astype(np.float64))
    if len(found) and np.abs(found).max() >= LARGEST:
        raise ValueError(f"a scaled component reaches {LARGEST}")
    return found.astype(np.int32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x from rows of c, exact whole numbers."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT_FLOAT and x.shape[1] <= 512 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (the lower of equals) and the slack to the second, never too large."""
    d = distances(x, c).astype(np.float64)
    rows, own = np.arange(len(x)), d.argmin(1)
    upper = np.sqrt(d[rows, own])
    d[rows, own] = np.inf
    lower = np.sqrt(d.min(1))
    return own, np.where(np.isinf(lower), np.inf, lower - upper - MARGIN * (1 + np.where(np.isinf(lower), 0, lower) + upper))


class Heaps(NamedTuple):
    """Of a block: keys in order within each (part position, entry), the rows they belong to, and where each one's run starts."""

    keys: np.ndarray
    rows: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, keys: np.ndarray, rows: np.ndarray, n: int) -> Heaps:
        """codes: position * entries + entry; n: how many of those there are."""
        order = np.lexsort((keys, codes))
        return cls(np.nextafter(keys[order].astype(np.float32), np.float32(-np.inf)), rows[order].astype(np.uint16), np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n))]).astype(np.int32))

    def codes(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def popped(self, sums: np.ndarray) -> np.ndarray:
        """Which of the entries in the runs the sums have reached."""
        out = np.zeros(len(self.keys), bool)
        for s, e, reached in zip(self.starts[:-1], self.starts[1:], sums.ravel()):
            out[s : s + np.searchsorted(self.keys[s:e], reached, side="right")] = True
        return out


def first_heaps(x: np.ndarray, books: np.ndarray) -> Heaps:
    """x: rows x dimensions; books: positions x entries x width."""
    parts, entries, width = books.shape
    found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
    codes = np.concatenate([p * entries + own for p, (own, _) in enumerate(found)])
    return Heaps.of(codes, np.concatenate([slack for _, slack in found]), np.tile(np.arange(len(x)), parts), parts * entries)


def next_heaps(x: np.ndarray, books: np.ndarray, heaps: Heaps, sums: np.ndarray) -> tuple[Heaps, int]:
    """After the entries moved to books; sums: what each entry's slacks have lost so far. And how many parts were compared."""
    parts, entries, width = books.shape
    out, codes = heaps.popped(sums), heaps.codes()
    keys, rows = heaps.keys.astype(np.float64), heaps.rows.astype(np.int64)
    for p in range(parts):
        at = heaps.starts[p * entries] + np.flatnonzero(out[heaps.starts[p * entries] : heaps.starts[(p + 1) * entries]])
        if len(at):
            own, slack = nearest(x[rows[at], p * width : (p + 1) * width], books[p])
            codes[at], keys[at] = p * entries + own, slack + sums[p, own]
    return Heaps.of(codes, keys, rows, parts * entries), int(out.sum())


def entry_sums(x: np.ndarray, heaps: Heaps, parts: int) -> list[dict]:
    """j (position * entries + entry), n and s (sums by component) of the entries that have parts."""
    width, entries = x.shape[1] // parts, (len(heaps.starts) - 1) // parts
    out = []
    for j in np.flatnonzero(np.diff(heaps.starts)):
        p = j // entries
        own = x[heaps.rows[heaps.starts[j] : heaps.starts[j + 1]], p * width : (p + 1) * width]
        out.append({"j": int(j), "n": len(own), "s": own.sum(0, dtype=np.int64).tolist()})
    return out


SUMS = pa.list_(pa.struct([("j", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))


def block_row(ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: Heaps, parts: int, rescanned: int) -> pa.RecordBatch:
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    kind = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32
    columns = {
        "ids": one(ids), "labels": one(labels), "short": pa.array([kind is np.int16]), "x": pa.array([x.astype(kind).tobytes()]), "keys": pa.array([heaps.keys.tobytes()]),
        "rows": pa.array([heaps.rows.tobytes()]), "starts": pa.array([heaps.starts.tobytes()]), "sums": pa.array([entry_sums(x, heaps, parts)], SUMS), "rescanned": pa.array([rescanned], pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def unpacked(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, pa.Array, np.ndarray, Heaps]:
    get = lambda name: batch.column(name)[k].as_py()
    ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
    x = np.frombuffer(get("x"), np.int16 if get("short") else np.int32).reshape(len(ids), -1)
    return ids, labels, x, Heaps(np.frombuffer(get("keys"), np.float32), np.frombuffer(get("rows"), np.uint16), np.frombuffer(get("starts"), np.int32))


class Codes(NamedTuple):
    """rows: key, label, code and error of every vector kept; books: positions x entries x width; rescanned: parts compared anew by round."""

    rows: DataFrame
    books: np.ndarray
    rescanned: list[int]

    def digest(self) -> str:
        """Of all entries' components in decimal, by position, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codebooks of vectors and every vector's code (two hex digits a part) and error."""
    spark = vectors.sparkSession
    prepared(spark)
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(fine)
    first = np.array([r["v"] for r in kept.orderBy("id", "v").limit(entries).select("v").collect()], dtype=np.float64)
    width = first.shape[1] // parts if len(first) else 0
    if len(first) and width * parts != first.shape[1]:
        raise ValueError(f"{parts} equal parts do not make up {first.shape[1]} components")
    dims = width * parts
    books = scaled(first.ravel()).reshape(len(first), parts, width).transpose(1, 0, 2).astype(np.int64) if len(first) else np.zeros((parts, 0, 0), np.int64)
    kind = kept.schema["label"].dataType.simpleString()
    state_type = f"ids array<long>, labels array<{kind}>, short boolean, x binary, keys binary, rows binary, starts binary, sums array<struct<j:int,n:long,s:array<long>>>, rescanned long"
    size = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, dims)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0

        def made(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, n
            while n >= size or last and n:
                whole = pa.Table.from_batches(waiting).combine_chunks()
                part = whole.slice(0, size)
                lists = part.column("v").combine_chunks()
                if (np.diff(lists.offsets.to_numpy()) != dims).any():
                    raise ValueError(f"a vector does not have {dims} components")
                x = scaled(lists.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
                yield block_row(part.column("id").combine_chunks(), part.column("label").combine_chunks(), x, first_heaps(x, books), parts, len(x) * parts)
                waiting, n = whole.slice(size).to_batches(), n - part.num_rows

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            yield from made(False)
        yield from made(True)

    def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    state, path = written(kept.mapInArrow(begin, state_type), "blocks")
    lost, rescanned, sent = np.zeros(books.shape[:2]), [], None
    for k in range(rounds):
        each = state.select(F.explode("sums").alias("e")).groupBy("e.j").agg(F.sum("e.n").alias("n"), *[F.sum(F.col("e.s")[i]).alias(f"s{i}") for i in range(width)])
        moved = books.copy()
        for r in each.collect():  # at most parts x entries rows
            moved[r["j"] // books.shape[1], r["j"] % books.shape[1]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        drift = np.sqrt(((moved - books) ** 2).sum(2).astype(np.float64)) * (1 + MARGIN)
        lost = lost + drift + others(drift)
        books = moved
        rescanned.append(state.agg(F.sum("rescanned")).first()[0] or 0)
        sent = spark.sparkContext.broadcast((books, lost))
        if k + 1 < rounds:
            (state, later), old = written(state.mapInArrow(lambda batches, sent=sent: advance(batches, *sent.value), state_type), "blocks"), path
            path = later
            remove(spark, old)
    if sent is None:
        sent = spark.sparkContext.broadcast((books, lost))
    rows = state.mapInArrow(lambda batches: finish(batches, *sent.value), f"id long, label {kind}, code string, error long")
    rows = cut(rows.withColumnsRenamed({"id": key, "label": label}), "codes")
    remove(spark, path)
    return Codes(rows, books, rescanned)


def others(drift: np.ndarray) -> np.ndarray:
    """For each entry of a position the largest move of another one."""
    if drift.shape[1] < 2:
        return np.zeros_like(drift)
    two = np.sort(drift, axis=1)[:, -2:]
    return np.where(drift == two[:, 1:], np.where((drift == two[:, 1:]).sum(1, keepdims=True) > 1, two[:, 1:], two[:, :1]), two[:, 1:])


def advance(batches: Iterator[pa.RecordBatch], books: np.ndarray, lost: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks after a round."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels, x, heaps = unpacked(batch, k)
            heaps, n = next_heaps(x, books, heaps, lost)
            yield block_row(ids, labels, x, heaps, len(books), n)


def finish(batches: Iterator[pa.RecordBatch], books: np.ndarray, lost: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of the blocks, with their last entries and errors."""
    parts, entries, width = books.shape
    for batch in batches:
        for k in range(batch.num_rows):
            ids, labels, x, heaps = unpacked(batch, k)
            heaps, _ = next_heaps(x, books, heaps, lost)
            codes = heaps.codes()
            own = np.empty((len(x), parts), np.int64)
            own[heaps.rows, codes // entries] = codes % entries
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                error += ((x[:, p * width : (p + 1) * width] - books[p][own[:, p]]) ** 2).sum(1)
            text = own.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], ["id", "label", "code", "error"])


def with_label_error(rows: DataFrame, label: str = "label", key: str = "vec_id") -> DataFrame:
    """Adds label_error: errors summed over equal labels; a hot label's rows stay where they are, or are spread."""
    sums = rows.groupBy(F.col(label).alias("_of")).agg(F.sum("error").alias("label_error"))
    size = sums.agg(F.sum(F.coalesce(F.octet_length(F.col("_of").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_of"))).drop("_of")
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return salted.join(sums, F.col(label).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_salt"))).drop("_of", "_salt", "_part")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(found.rows).select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    near = "list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"""a{k} AS MATERIALIZED (SELECT rid, q.p, any_value(q.x) AS x, min({{'d': CAST({near} AS BIGINT), 'j': j}}) AS m FROM q JOIN c{k} c ON q.p = c.p GROUP BY rid, q.p),
"""


def _move_sql(k: int) -> str:
    return f"""u{k} AS (SELECT p, j, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x FROM (SELECT p, m.j AS j, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM q))) AS i) GROUP BY p, m.j, i) GROUP BY p, j),
c{k + 1} AS MATERIALIZED (SELECT p, j, coalesce(u.x, c.x) AS x FROM c{k} c LEFT JOIN u{k} u USING (p, j)),
"""


ORACLE_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM k, (SELECT unnest(range({PARTS})) AS p)),
c0 AS MATERIALIZED (SELECT p, j, x FROM (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS j FROM k) JOIN q USING (rid) WHERE j < {ENTRIES}),
{"".join(_round_sql(k) + _move_sql(k) for k in range(ROUNDS))}{_round_sql(ROUNDS)}
e AS (SELECT rid, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e USING (rid) CROSS JOIN b
"""
