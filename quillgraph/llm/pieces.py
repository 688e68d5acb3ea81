"""SentencePiece encoding with byte spans, and decoding (operator 12).

Method: a text is normalised by longest-prefix matches in the model's compiled character map
(a double-array trie over UTF-8 with a table of replacements); every byte of the result keeps
the place of the source byte that it came from. The normalised text is cut into pieces, and
each piece's span is projected through that alignment to a span of bytes of the source.

The map is walked only at characters that begin one of its keys; what lies between is copied,
with its alignment, in one go. Merging itself is the library's, on a model whose own
normaliser is switched off. No piece of a BPE vocabulary reaches over the blank before a
word (this is checked), so words are merged one by one and frequent ones are remembered.

How it scales: a text is encoded by itself, in batches that Spark bounds by bytes; nothing is
shuffled. A worker remembers ``CACHE_WORDS`` short words at most, others are merged anew.

Defined results: null text counts as empty and gives the begin and end ids alone; every row
gets a row, repeated ones too; other columns are ignored, whatever their names. Spans are
byte offsets, ends exclusive; of a character that is written as byte pieces the last one has
the span and those before are empty; begin and end ids lie empty at the ends of the text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor

from quillgraph.llm.common import prepared, remembered, table

#: What stands for a blank.
BLANK = "▁"
#: Words a worker remembers at most, and the longest it does.
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
#: Fixed values of the model file: field numbers of pieces and of the two specifications, kinds of pieces, the kind of model.
PIECE, TRAINER, NORMALIZER, USER_DEFINED, BYTE, BPE = 1, 2, 3, 4, 6, 2


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """Number, value and written form of each field of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        began = at
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value, message[began:at]


class Normalized(NamedTuple):
    """A normalised text; align has the source byte of each of its bytes, and where the source ends."""

    text: str
    align: np.ndarray


class CharMap:
    """A compiled character map: the trie's size, its units, then the replacements, each ended by a zero."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = compiled[4 + size :]
        starts = sorted({key.decode("utf-8", "ignore")[:1] for key in self.keys()} - {""})
        #: The characters that begin a key.
        self.candidate = re.compile("[" + "".join(map(re.escape, starts)) + "]") if starts else None

    def below(self, node: int) -> Iterator[tuple[int, int, int | None]]:
        """Byte, node and value (if a key ends there) of a node's children."""
        for byte in range(1, 256):
            if (node ^ byte) < len(self.units) and (child := self.step(node, byte)):
                yield byte, *child

    def step(self, node: int, byte: int) -> tuple[int, int | None] | None:
        unit = self.units[node ^ byte]
        if unit & 0x800000FF != byte:
            return None
        then = node ^ byte ^ self.offset(unit)
        return then, self.units[then] & 0x7FFFFFFF if unit >> 8 & 1 else None

    @staticmethod
    def offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def keys(self) -> Iterator[bytes]:
        todo = [(b"", self.offset(self.units[0]))] if self.units else []
        while todo:
            key, node = todo.pop()
            for byte, then, value in self.below(node):
                if value is not None:
                    yield key + bytes([byte])
                todo.append((key + bytes([byte]), then))

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at a place of source, and what replaces it."""
        node, found = self.offset(self.units[0]), None
        for k in range(at, len(source)):
            if (node ^ source[k]) >= len(self.units) or not (step := self.step(node, source[k])):
                break
            node, value = step
            if value is not None:
                found = k + 1 - at, value
        return found and (found[0], self.replacements[found[1] : self.replacements.index(0, found[1])])

    def apply(self, text: str) -> tuple[bytes, np.ndarray]:
        """The mapped bytes, each with the source byte where what it replaces begins."""
        source = text.encode()
        if not self.candidate or not self.candidate.search(text):
            return source, np.arange(len(source), dtype=np.int32)
        out, align, at, skip = [], [], 0, 0
        last = place = 0
        for m in self.candidate.finditer(text):
            place += len(text[last : m.start()].encode())
            last = m.start()
            if place < skip or not (found := self.longest(source, place)):
                continue
            out += [source[at:place], found[1]]
            align += [np.arange(at, place, dtype=np.int32), np.full(len(found[1]), place, np.int32)]
            at = skip = place + found[0]
        return b"".join([*out, source[at:]]), np.concatenate([*align, np.arange(at, len(source), dtype=np.int32)])


    def heading(self, source: bytes) -> int:
        """Where the first character stands that is not mapped to a blank."""
        at = 0
        while at < len(source):
            n, to = (self.units and self.longest(source, at)) or (1, source[at : at + 1])
            if to != b" ":
                break
            at += n
        return at


class Pieces:
    """Encodes and decodes as the library does, and gives each piece's bytes of the source."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        with open(path, "rb") as f:
            model = f.read()
        own, trainer, kinds, rest = {}, {}, [], []
        for number, value, written in fields(model):
            if number == NORMALIZER:
                own = {n: v for n, v, _ in fields(value)}
                continue
            rest.append(written)
            if number == PIECE:
                entry = {n: v for n, v, _ in fields(value)}
                kinds.append((entry.get(1, b"").decode(), entry.get(3, 1)))
            elif number == TRAINER:
                trainer = {n: v for n, v, _ in fields(value)}
        if trainer.get(24, 0):
            raise ValueError("models that write blanks after words are not supported")
        self.map = CharMap(own.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        if self.squeeze and b"  " in self.map.replacements:
            raise ValueError("a replacement of two blanks in a row is not supported")
        self.library = SentencePieceProcessor(model_file=path)
        off = b"".join(bytes([k << 3, 0]) for k in (3, 4, 5))
        self.merger = SentencePieceProcessor()
        self.merger.LoadFromSerializedProto(b"".join(rest) + bytes([NORMALIZER << 3 | 2, len(off)]) + off)
        self.ends = struct.pack("<I", self.library.bos_id()), struct.pack("<I", self.library.eos_id())
        self.lengths = [len(piece.encode()) if kind != BYTE else -int(piece[3:5], 16) - 1 for piece, kind in kinds]
        alone = trainer.get(3, 1) == BPE and not any(kind == USER_DEFINED or re.search(f"[^{BLANK}]{BLANK}", piece) for piece, kind in kinds)
        self.words = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if alone else r"(?s).+").findall
        self.unknown = self.library.unk_id()
        self.memory: dict[str, tuple[bytes, bytes]] = {}
        self.limit = limit

    def normalized(self, text: str) -> Normalized:
        data, align = self.map.apply(text)
        end = len(text.encode())
        if not end:
            return Normalized("", np.zeros(1, np.int32))
        codes = np.frombuffer(data, np.uint8)
        blank = codes == 32
        first, mark = 0, BLANK if self.escape else " "
        if self.squeeze:
            keep = ~blank
            keep[1:] |= ~blank[:-1]
            first, data, align, blank = self.map.heading(text.encode()), codes[keep].tobytes(), align[keep], blank[keep]
        out = data.decode()
        if self.escape:
            out, align = out.replace(" ", BLANK), np.repeat(align, 1 + 2 * blank)
        if self.prefix:
            out, align = mark + out, np.concatenate([np.full(len(mark.encode()), first, np.int32), align])
        if self.squeeze and out.endswith(mark):  # blanks at the end go, with the prefix if nothing else is there
            out = out.rstrip(mark)
            size = len(out.encode())
            end, align = int(align[size]), align[:size]
        return Normalized(out, np.append(align, np.int32(end)))

    def word(self, word: str) -> tuple[bytes, bytes]:
        """Ids and normalised lengths of a word's pieces, 4 bytes each; remembered if it is short."""
        ids = self.merger.encode(word)
        lengths, data, at = [], word.encode() if self.unknown in ids else b"", 0
        for k, i in enumerate(ids):
            n = self.lengths[i]
            if n < 0:  # a byte: the last of its character has the character's length
                lead = -n - 1
                if lead >= 0xC0:
                    at = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                    size = at
                elif lead < 0x80:
                    at = size = 1
                at -= 1
                n = 0 if at else size
            elif i == self.unknown:  # what the pieces around leave of the word
                rest = [self.lengths[j] for j in ids[k + 1 :]]
                if self.unknown in ids[k + 1 :] or min(rest, default=0) < 0:
                    raise ValueError("unknown characters in models without byte pieces: one run a word is supported")
                n = len(data) - sum(lengths) - sum(rest)
            lengths.append(n)
        found = struct.pack(f"<{len(ids)}I", *ids), struct.pack(f"<{len(ids)}I", *lengths)
        if len(word) <= CACHE_LENGTH and len(self.memory) < self.limit:
            self.memory[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids with begin and end, and the spans of their source bytes: begin and end by turns. Little-endian, 4 bytes each."""
        normal = self.normalized(text)
        get, word = self.memory.get, self.word
        found = [get(w) or word(w) for w in self.words(normal.text)]
        begin, end = self.ends
        ids = b"".join([begin, *[f[0] for f in found], end])
        places = np.zeros(len(ids) // 4 - 1, np.int64)
        np.cumsum(np.frombuffer(b"".join([f[1] for f in found]), "<u4"), out=places[1:])
        source = normal.align[places]
        spans = np.empty((len(ids) // 4, 2), "<u4")
        spans[0], spans[-1] = source[0] * 0, len(text.encode())
        spans[1:-1, 0], spans[1:-1, 1] = source[:-1], source[1:]
        return ids, spans.tobytes()

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def pieces(path: str) -> Pieces:
    """One for each Python worker, which outlives its tasks."""
    return remembered(f"pieces of {path}", lambda: Pieces(path))


def encoded(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids and spans (little-endian unsigned 32-bit numbers) of every text, and decoded, their text, if asked for."""
    prepared(docs.sparkSession)
    names = ["doc_id", "ids", "spans", *["decoded"] * decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            rows = [own.encode(text.as_py() or "") for text in batch.column(1)]
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
            if decode:
                columns.append(pa.array([own.decode(r[0]) for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, spans binary" + ", decoded string" * decode)


def decoded(tokens: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """tokens with the text of a column of ids as encoded() writes them; null stays null."""
    prepared(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            texts = [None if x.as_py() is None else own.decode(x.as_py()) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField(name, StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(table(spark, sf_dir, "documents"), model_path(), decode=True)
    return found.select("doc_id", F.expr("cast(octet_length(ids) div 4 AS long) AS n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))
