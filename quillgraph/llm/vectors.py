"""Near-duplicate embeddings over an inverted multi-index (operator 9).

Unit vectors are cut in two halves with a codebook each; a vector lives in the cell of the
product grid that its halves name. A multi-sequence traversal visits cells in order of
distance; how many is calibrated on a sample so that the target share of true pairs is
found in each band of cosines, in groups of near copies and outside them. Every candidate is verified by cosine in double precision.

* Codebooks and the number of visited cells come from a bounded sample (``SAMPLE`` rows, more
  for large codebooks, those of the smallest hashes); every row is indexed and queried. The
  codebooks grow with the square root of the rows, so cells stay of about ``CELL`` rows.
* Equal vectors are one class. A link is found if either side visits the other's cell; a
  task credits link counts and contracts links to a forest, so pairs are never written.
* Cells that lie together form a region of about ``BLOCK`` rows; a vector is sent once to each
  region that it visits. Crowded regions are split into blocks of rows and of queries, so no
  task gathers a hot cell.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, nor does a row without a vec_id; vectors of different length never link; a repeated row counts as another
vector, as does another vector of the same vec_id; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, prepared, table
from quillgraph.llm.components import components

THRESHOLD = 0.9
SAMPLE = 8_192
TARGET = 0.995
#: Bands of cosines, as shares of the way from the threshold to 1, that each must meet the target.
BANDS = (0.0, 0.2, 0.5, 0.8)
#: Made-up pairs of each kind that calibration adds to the sample's own.
MADE = 1_024
#: Rows of a cell, and of a block of a region, that are aimed at.
CELL, BLOCK = 200, 4_096
#: Words of a codebook at most; a sample holds at least eight rows for each.
WORDS = 4_096
#: Products that a task holds at a time.
PRODUCTS = 1 << 20
SLACK = 1e-12


def units(raws: list[bytes], kind: str = "f8") -> np.ndarray:
    """Unit vectors, a row each, of packed finite vectors of one length that are not zero."""
    x = np.frombuffer(b"".join(raws), dtype=kind).reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def unit(raw: bytes) -> np.ndarray | None:
    x = np.frombuffer(raw, dtype=np.float64)
    top = np.abs(x).max(initial=0.0)
    return units([raw])[0] if top and np.isfinite(top) else None


def prepare(vectors: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, key (16 bytes, equal for equal vectors), vec (packed); and how vec is packed.

    key null: links with nothing. Tables of floats travel as floats, which loses nothing.
    """
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    good = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if kind == 'f4' else 'double'}>").alias("embedding"))
    rows = rows.select("vec_id", F.when(F.coalesce(good, F.lit(False)) & (F.size("embedding") > 0) & F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            for x in batch.column(1):
                v = x.values.to_numpy() + 0.0 if x.is_valid else None
                raw = None if v is None or not v.any() else v.astype(kind).tobytes()
                keys.append(raw and hashlib.blake2b(raw, digest_size=16).digest())
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "key", "vec"])

    return rows.mapInArrow(pack, "vec_id long, key binary, vec binary"), kind


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([((c * c).sum(1) - 2 * part @ c.T).argmin(1) for part in np.array_split(x, len(x) * len(c) // PRODUCTS + 1)])
        order = own.argsort(kind="stable")
        used, first = np.unique(own[order], return_index=True)
        c[used] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return c


def in_line(c: np.ndarray) -> np.ndarray:
    """Codewords in order along their main direction, so that neighbours have near numbers."""
    x = c - c.mean(0)
    return c[(x @ np.linalg.svd(x, full_matrices=False)[2][0]).argsort(kind="stable")] if len(c) > 1 else c


class MultiIndex:
    """Two codebooks and the number of cells to visit, for vectors of one length."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, target: float, rows: int = 0):
        self.half = sample.shape[1] // 2
        held = sample[: len(sample) // 4] if len(sample) >= 8 else sample
        fitted = sample[len(held) :] if len(sample) >= 8 else sample
        self.books = (kmeans(fitted[:, : self.half], k), in_line(kmeans(fitted[:, self.half :], k)))
        self.k = len(self.books[1])
        #: second codewords of a region: all that go with one first codeword, or fewer where rows are many
        self.span = max(1, math.ceil(self.k / max(1, round(rows / len(self.books[0]) / BLOCK))))
        self.visits = self._calibrate(fitted, held, threshold, target)

    def _distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [((h * h).sum(1)[:, None] + (c * c).sum(1) - 2 * h @ c.T) for h, c in zip((x[:, : self.half], x[:, self.half :]), self.books)]

    def cells(self, x: np.ndarray, visits: int | None = None) -> list[list[int]]:
        """For each vector the nearest cells by multi-sequence traversal; its own is first."""
        return self.reach(x, visits)[0]

    def reach(self, x: np.ndarray, visits: int | None = None) -> tuple[list[list[int]], np.ndarray]:
        """As cells, and for each vector a distance between those of the visited cells and of all others."""
        out, radius = [], np.full(len(x), np.inf)
        for row, (d, e) in enumerate(zip(*self._distances(x))):
            p, q = d.argsort(kind="stable"), e.argsort(kind="stable")
            heap, seen, found, last = [(d[p[0]] + e[q[0]], 0, 0)], {(0, 0)}, [], 0.0
            while heap:
                if len(found) >= (visits or self.visits) and heap[0][0] > last + 1e-9:  # cells as near as the last are visited too
                    radius[row] = (last + heap[0][0]) / 2
                    break
                last, i, j = heapq.heappop(heap)
                found.append(int(p[i]) * self.k + int(q[j]))
                for a, b in ((i + 1, j), (i, j + 1)):
                    if a < len(p) and b < len(q) and (a, b) not in seen:
                        seen.add((a, b))
                        heapq.heappush(heap, (d[p[a]] + e[q[b]], a, b))
            out.append(found)
        return out, radius

    def region(self, cell: int) -> int:
        return cell // self.k * -(-self.k // self.span) + cell % self.k // self.span

    def _needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair the visits after which one side reaches the other's cell."""
        out = []
        for at in range(0, len(a), 64):
            da, ea = self._distances(a[at : at + 64])
            db, eb = self._distances(b[at : at + 64])
            row = np.arange(len(da))
            sides = []
            for d, e, p, q in ((da, ea, db.argmin(1), eb.argmin(1)), (db, eb, da.argmin(1), ea.argmin(1))):
                bound = d[row, p] + e[row, q] + 1e-9  # ties and rounding count as nearer
                e = np.sort(e, axis=1)
                sides.append([sum(np.searchsorted(e_row, b - d_row, side="right")) for d_row, e_row, b in zip(d, e, bound)])
            out.append(np.minimum(*np.array(sides)))
        return np.concatenate(out)

    def _calibrate(self, fitted: np.ndarray, held: np.ndarray, threshold: float, target: float) -> int:
        """Visits that find the target share of pairs in each band of cosines.

        A row gives a pair a band at most and counts by one over its partners, so that groups
        of near copies weigh no more than the rows outside. Borderline pairs are always
        made up too, from rows that the codebooks were not fitted to.
        """
        rng = np.random.default_rng(5)
        sample = np.concatenate([fitted, held])
        asked = rng.permutation(len(sample))[:2048]
        cosines = sample[asked] @ sample.T
        cosines[np.arange(len(asked)), asked] = -1
        degree = (cosines >= threshold).sum(1)
        edges = threshold + (1 - threshold) * np.array(BANDS)
        groups = []
        for low, high in zip(edges, [*edges[1:], np.inf]):
            inside = (cosines >= low) & (cosines < high)
            mine = np.flatnonzero(inside.any(1))
            partner = (inside[mine] * rng.random((len(mine), 1 + inside.shape[1]))[:, 1:]).argmax(1)
            groups.append((sample[asked[mine]], sample[partner], 1 / np.maximum(degree[mine], 1)))
        base = rng.permutation(len(held))
        weight = 1 / np.maximum((held[base] @ held.T >= threshold).sum(1), 1)
        for low, high in ((0, BANDS[1]), (0, 1)):
            x = held[rng.choice(base, MADE, p=weight / weight.sum())]
            noise = rng.normal(size=x.shape)
            noise -= (noise * x).sum(1)[:, None] * x
            noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-300)[:, None]
            cosine = (threshold + (1 - threshold) * rng.uniform(low, high, size=MADE))[:, None]
            groups.append((x, cosine * x + np.sqrt(1 - cosine**2) * noise, np.ones(MADE)))
        visits = 2
        for a, b, w in groups:
            if len(a):
                need = self._needed(a, b)
                order = need.argsort(kind="stable")
                share = np.cumsum(w[order]) / w.sum()
                visits = max(visits, int(need[order][min(np.searchsorted(share, target), len(need) - 1)]))
        return min(visits, len(self.books[0]) * self.k)


def fit_index(classes: DataFrame, n: int, threshold: float, target: float, kind: str) -> dict[int, MultiIndex]:
    """An index for each vector length that the sample holds."""
    k = int(min(WORDS, max(1, 2 ** round(math.log2(max(n, 1) / CELL) / 2)))) if n > CELL else 1
    rows = classes.select("vec", F.xxhash64("cid").alias("h")).orderBy("h").limit(max(SAMPLE, 8 * k)).collect()  # bounded
    by_length: dict[int, list[bytes]] = {}
    for r in rows:
        by_length.setdefault(len(r["vec"]), []).append(bytes(r["vec"]))
    return {d: MultiIndex(units(x, kind), k, threshold, target, n * len(x) // len(rows)) for d, x in by_length.items()}


class Links:
    """Link counts of the vectors of a block, and who is joined with whom, as products come in."""

    def __init__(self, n: int):
        self.counts, self.joined = np.zeros(n, dtype=np.int64), np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the places a with the places b: hook roots to smaller ones, then shorten the ways."""
        while True:
            x, y = self.joined[a], self.joined[b]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.joined, np.maximum(x, y), np.minimum(x, y))
            while (shorter := self.joined[self.joined]).tobytes() != self.joined.tobytes():
                self.joined = shorter


def block_links(index: MultiIndex | None, group: dict[str, np.ndarray], x: np.ndarray, cells: list[list[int]], threshold: float) -> Links:
    """Links between the stored rows of a block and the queries that visit their cells.

    group: stored, cid, n, home, radius; x: unit vectors; cells: what each query visits here.
    """
    stored, ids, n, home = group["stored"], group["cid"], group["n"], group["home"]
    links = Links(len(ids))
    data = np.flatnonzero(stored)
    data = data[home[data].argsort(kind="stable")]
    asks = np.flatnonzero(~stored)
    visit = np.array([c for k in asks for c in cells[k]], dtype=np.int64)
    by = np.repeat(asks, [len(cells[k]) for k in asks])
    order = visit.argsort(kind="stable")
    visit, by = visit[order], by[order]
    distances = index._distances(x[data]) if index and len(data) else None
    for cell in np.intersect1d(home[data], visit):
        lo, hi = np.searchsorted(home[data], [cell, cell + 1])
        mine = data[lo:hi]
        ask = by[slice(*np.searchsorted(visit, [cell, cell + 1]))]
        step = max(1, PRODUCTS // len(mine))
        for at in range(0, len(ask), step):
            some = ask[at : at + step]
            cosine = x[some] @ x[mine].T
            i, j = np.nonzero(cosine >= threshold - SLACK)
            keep = ids[some[i]] != ids[mine[j]]
            for k in np.flatnonzero(keep & (cosine[i, j] < threshold + SLACK)):
                keep[k] = np.dot(x[some[i[k]]], x[mine[j[k]]]) >= threshold
            i, j = i[keep], j[keep]
            a, b = some[i], mine[j]
            links.counts += np.bincount(a, weights=n[b], minlength=len(ids)).astype(np.int64)
            if distances:  # where the other side does not visit, it will not find this link
                back = distances[0][lo + j, home[a] // index.k] + distances[1][lo + j, home[a] % index.k] > group["radius"][b]
                links.counts += np.bincount(b[back], weights=n[a[back]], minlength=len(ids)).astype(np.int64)
            links.add(a, b)
    return links


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of vectors."""
    prepared(vectors.sparkSession)
    spark = vectors.sparkSession
    packed, kind = prepare(vectors)
    rows = cut(packed, "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("vec_id", "vec")).alias("x"))
    # numbers in the order of vec_id, so that the least of a component has its least vec_id
    classes = classes.select("key", "n", F.col("x.vec_id").alias("rep"), F.col("x.vec").alias("vec")).orderBy("rep", "key").withColumn("cid", F.monotonically_increasing_id())
    classes = cut(classes, "classes")
    total = classes.count()
    index = spark.sparkContext.broadcast(fit_index(classes, total, threshold, target, kind))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("vec").to_pylist()
            length = np.array([len(r) for r in raws])
            home, radius = np.zeros(len(raws), dtype=np.int64), np.full(len(raws), np.inf)
            regions: list[list[dict]] = [[]] * len(raws)
            for d in np.unique(length):
                mine = np.flatnonzero(length == d)
                own = index.value.get(int(d))
                found, radius[mine] = own.reach(units([raws[i] for i in mine], kind)) if own else ([[0]] * len(mine), np.inf)
                for i, c in zip(mine, found):
                    home[i] = c[0]
                    by: dict[int, list[int]] = {}
                    for cell in c:
                        by.setdefault(int(d) << 32 | (own.region(cell) if own else 0), []).append(cell)
                    regions[i] = [{"region": r, "cells": x} for r, x in by.items()]  # its own is first
            kept = [batch.column(c) for c in ("cid", "n", "vec")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(home), pa.array(radius), pa.array(regions, pa.list_(pa.struct([("region", pa.int64()), ("cells", pa.list_(pa.int32()))])))], ["cid", "n", "vec", "home", "radius", "regions"])

    placed = cut(classes.select("cid", "n", "vec").mapInArrow(locate, "cid long, n long, vec binary, home long, radius double, regions array<struct<region:long,cells:array<int>>>"), "placed")
    kept = ("cid", "n", "vec", "home", "radius")
    own = placed.select(*kept, F.col("regions")[0]["region"].alias("region"))
    asked = placed.select(*kept, F.explode("regions").alias("r")).select(*kept, "r.region", "r.cells")
    # a row for each region: the blocks that its rows and its queries are dealt to
    blocks = placed.select(F.explode(F.transform("regions", lambda r, i: F.struct(r["region"].alias("region"), (i == 0).alias("stored")))).alias("r")).select("r.*")
    blocks = blocks.groupBy("region").agg(F.ceil(F.sum(F.col("stored").cast("int")) / BLOCK).cast("int").alias("db"), F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("qb")).where("db > 0")
    blocks = cut(blocks, "blocks")
    own, asked = own.join(blocks, "region"), asked.join(blocks, "region")
    deal = lambda n: F.pmod(F.xxhash64("cid", "region"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = own.select("region", deal("db").alias("d"), every("qb").alias("q"), F.lit(True).alias("stored"), *kept, F.array().cast("array<int>").alias("cells"))
    sides = sides.union(asked.select("region", every("db").alias("d"), deal("qb").alias("q"), F.lit(False).alias("stored"), *kept, "cells"))

    def verify(group: pa.Table) -> pa.Table:
        own = {c: group.column(c).to_numpy() for c in ("cid", "n", "home", "radius")} | {"stored": np.array(group.column("stored").to_pylist(), dtype=bool)}
        raws = group.column("vec").to_pylist()
        found = block_links(index.value.get(len(raws[0])), own, units(raws, kind), group.column("cells").to_pylist(), threshold)
        # a vector may be here twice, as a row and as a query
        roots = found.joined
        met = np.flatnonzero((found.counts > 0) | (roots != np.arange(len(roots))))
        return pa.table({"cid": pa.array(own["cid"][met]), "links": pa.array(found.counts[met]), "to": pa.array(own["cid"][roots[met]])})

    found = cut(sides.groupBy("region", "d", "q").applyInArrow(verify, "cid long, links long, to long"), "links")
    roots = components(found.select("cid", "to"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    per_class = classes.select("key", "n", "cid", "rep").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    heads = classes.select(F.col("cid").alias("root"), F.col("rep").alias("component_id")).join(roots.select("root").distinct(), "root")
    per_class = per_class.join(heads, "root", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("vec_id", "key").join(per_class, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS r FROM v WHERE list_inner_product(e, e) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.r * b.r) >= 0.9),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS k FROM link GROUP BY x) c ON vec_id = c.x LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON vec_id = r.x
"""
