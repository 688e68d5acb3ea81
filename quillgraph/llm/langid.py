"""Language identification (operator 2).

A sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams
(1 to 3 characters, lower case), trained with follow-the-regularised-leader (FTRL-proximal,
elastic net) and calibrated with a temperature.

* Document frequencies come from every training document.
* The classifier is fitted on a bounded sample: the ``per_label`` training documents of
  each label with the smallest hashes of their ids. That bound is a parameter and holds for
  repeated and lacking ids too; the labels are taken to be few (one weight column each).
* Weights are ``dims`` x labels numbers, so their broadcast does not grow with the data.
* Long texts are counted and scored in blocks, so a task's memory does not grow with them.

Defined results: null text, and text without a letter, gets ``und`` with score 0; with no
training documents at all every prediction is ``und``; rows with null labels are predicted
but never learnt from; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, fresh, table
from quillgraph.session import ship

DIMS = 1 << 16
PER_LABEL = 600
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
UNDETERMINED = "und"
#: Weights of a text's n-grams sum to this.
SCALE = 20.0
#: Code points that are turned into n-grams at a time.
BLOCK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(0x9E3779B1)
    return x ^ (x >> np.uint32(15))


def grams(codes: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(3, n) hashed ids of the 1-, 2- and 3-grams that begin at each code point."""
    with np.errstate(over="ignore"):
        one = _mix(codes + np.uint32(1))
        two, three = np.zeros_like(one), np.zeros_like(one)
        two[:-1] = _mix(one[:-1] * np.uint32(31) + one[1:])
        three[:-2] = _mix(two[:-2] * np.uint32(37) + one[2:])
        two[:-1] += np.uint32(0x51ED27)
        three[:-2] += np.uint32(0xA3B195)
    out = np.stack([one, two, three])
    return (_mix(out) >> np.uint32(32 - int(math.log2(dims)))).astype(np.int32)


def _text_codes(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pieces(codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of a text's codes, and how many codes at their end only complete n-grams begun before."""
    for at in range(0, max(1, len(codes) - 2), BLOCK):
        part = codes[at : at + BLOCK + 2]
        yield part, 2 if at + BLOCK + 2 < len(codes) else 0


def id_blocks(text: str, dims: int = DIMS) -> Iterator[np.ndarray]:
    """Ids of all n-grams of one text, a block at a time."""
    for part, extra in pieces(_text_codes(text)):
        g = grams(part, dims)
        yield np.concatenate([g[k, : len(part) - max(k, extra)] for k in range(3)])


def counted(text: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and how often each occurs."""
    blocks = id_blocks(text, dims)
    ids = next(blocks)
    if len(ids) > dims // 2:
        counts = np.bincount(ids, minlength=dims)
        for more in blocks:
            counts += np.bincount(more, minlength=dims)
        ids = np.flatnonzero(counts)
        return ids, counts[ids]
    return np.unique(np.concatenate([ids, *blocks]), return_counts=True)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def document_frequencies(docs: DataFrame, dims: int) -> tuple[np.ndarray, dict[str, int]]:
    """How many of the documents hold each hashed n-gram, and how many each label has, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, labels = np.zeros(dims, dtype=np.int64), Counter()
        seen = np.zeros(dims, dtype=bool)
        for batch in batches:
            for text in batch.column(0):
                for ids in id_blocks(text.as_py(), dims):
                    seen[ids] = True
                total += seen
                seen[:] = False
            labels.update(batch.column(1).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.string()), pa.array(total[at])], ["id", "lang", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(labels), pa.int32()), pa.array(list(labels), pa.string()), pa.array(list(labels.values()), pa.int64())], ["id", "lang", "n"])

    df, n_of = np.zeros(dims, dtype=np.int64), {}
    counts = docs.select("text", "lang").mapInArrow(count, "id int, lang string, n long").groupBy("id", "lang").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # dims rows and one a label at most
        if r["lang"] is None:
            df[r["id"]] = r["n"]
        else:
            n_of[r["lang"]] = r["n"]
    return df, n_of


def inverse(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Smoothed inverse document frequencies."""
    return np.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def weighted(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of a text's n-grams: their shares of the text, SCALE in all, times idf."""
    return SCALE * counts / counts.sum() * idf[ids]


def sampled(train: DataFrame, n_of: dict[str, int], per_label: int) -> DataFrame:
    """lang, text, k (from 1): at most per_label rows of each label, those of the least hashes.

    Ids are first thinned by a bound on their hash, from the label counts, so that no task
    ranks more than a few samples of each label; where ids repeat so much that too few are
    left, the bound is widened, up to all of them.
    """
    rows = train.withColumn("h", F.xxhash64("doc_id"))
    share = {x: min(1.0, (1.5 * per_label + 64) / n) for x, n in n_of.items()}
    while True:
        bound = F.element_at(F.create_map(*[F.lit(v) for x in share.items() for v in x]), F.col("lang"))
        ids = rows.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= bound).select("lang", "h", "doc_id").distinct()
        ranked = ids.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= per_label)
        ranked = cut(ranked.select(F.col("lang").alias("l"), F.col("doc_id").alias("d")), "sample")
        got = {r["l"]: r["count"] for r in ranked.groupBy("l").count().collect()}  # a row a label
        few = [x for x in share if share[x] < 1 and got.get(x, 0) < per_label]
        if not few:
            break
        share |= {x: min(1.0, 8 * share[x]) for x in few}
    # Only the sample's few ids travel; its texts are read by a join with that bounded table.
    met = rows.join(F.broadcast(ranked), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("lang") == F.col("l")))
    order = W.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    return met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label).select("lang", "text", "k")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], dims: int, n_labels: int, epochs: int = EPOCHS, l1: float = L1, l2: float = L2) -> np.ndarray:
    """FTRL-proximal with an elastic net (l1, l2); one accumulator pair per weight.

    A weight whose accumulated gradient stays within l1 is exactly 0, so unseen and
    uninformative n-grams have none.
    """
    z, n = np.zeros((dims, n_labels)), np.zeros((dims, n_labels))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            ids, x, y = samples[k]
            zi, ni = z[ids], n[ids]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + l2))
            p = softmax(x @ wi)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[ids] = zi + g - step * wi
            n[ids] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    a, b, g = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fit(docs: DataFrame, dims: int = DIMS, per_label: int = PER_LABEL) -> tuple[list[str], np.ndarray]:
    """Labels and calibrated weights (dims x labels, inverse document frequency included)."""
    ship(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    df, n_of = document_frequencies(train, dims)
    if not n_of:
        return [], np.zeros((dims, 0), dtype=np.float32)
    idf = inverse(df, sum(n_of.values()))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for text in batch.column(1):
                i, c = counted(text.as_py(), dims)
                ids.append(i.astype(np.int32).tobytes())
                counts.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "k", "ids", "counts"])

    rows = sampled(train, n_of, per_label).mapInArrow(featurise, "lang string, k int, ids binary, counts binary").collect()  # per_label rows of each label
    labels = sorted({r["lang"] for r in rows})
    number = {x: k for k, x in enumerate(labels)}
    held, kept = [], []
    for r in sorted(rows, key=lambda r: (r["k"], r["lang"], r["ids"])):
        i, c = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32)
        (held if r["k"] % 5 == 0 else kept).append((i, weighted(i, c, idf), number[r["lang"]]))
    w = train_ftrl(kept, dims, len(labels))
    if held and len(labels) > 1:
        w = w / temperature(np.array([x @ w[i] for i, x, _ in held]), np.array([y for _, _, y in held]))
    return labels, (w * idf[:, None] * SCALE).astype(np.float32)


def predict(docs: DataFrame, labels: list[str], weights: np.ndarray, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the columns of names, prediction and score (which replace any of those names), the rest kept."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    dims = len(weights)

    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        w = model.value
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not labels:
            return names, scores
        sums, counts = np.zeros((len(texts), len(labels))), np.zeros(len(texts))
        block: list[tuple[int, np.ndarray, int]] = []

        def flush() -> None:
            codes = np.concatenate([c for _, c, _ in block])
            lengths, extra = np.array([len(c) for _, c, _ in block]), np.array([e for _, _, e in block])
            ends = np.cumsum(lengths)
            g = grams(codes, dims)
            total = np.zeros((len(codes), len(labels)), dtype=np.float32)
            own = np.array([k for k, _, _ in block])
            for n in range(3):
                part = w[g[n]]
                # an n-gram that reaches into the next text, or begins in the next piece, counts for nothing here
                for back in (1, 2):
                    part[ends[np.maximum(extra, n) >= back] - back] = 0
                total += part
                np.add.at(counts, own, lengths - np.maximum(extra, n))
            np.add.at(sums, own, np.add.reduceat(total, ends - lengths, axis=0, dtype=np.float64))
            block.clear()

        size = 0
        for k, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)):
                continue
            for part, extra in pieces(_text_codes(text)):
                block.append((k, part, extra))
                size += len(part)
                if size >= BLOCK:
                    flush()
                    size = 0
        if block:
            flush()
        known = np.flatnonzero(counts)
        p = softmax(sums[known] / counts[known, None])
        for k, best, row in zip(known.tolist(), p.argmax(axis=1).tolist(), p):
            names[k], scores[k] = labels[best], float(min(1.0, row[best]))
        return names, scores

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def identify(texts):
        import pandas as pd

        found, scores = score([None if t is None or t != t else t for t in texts])
        return pd.DataFrame({"lang_pred": found, "score": scores})

    found = fresh([*docs.columns, *names], "found")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.withColumn(found, identify("text")).select(*kept, F.col(found)["lang_pred"].alias(names[0]), F.col(found)["score"].alias(names[1]))


def identify_languages(docs: DataFrame, dims: int = DIMS, per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: doc_id, text, held_out, lang_pred, score."""
    labels, weights = fit(docs, dims, per_label)
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), labels, weights)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
