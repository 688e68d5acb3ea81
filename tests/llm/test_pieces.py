import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece as spm
from pyspark.sql import Row

from quillgraph.llm import pieces as P

PARTS = ["Hello", " ", "  ", "\n", "\t", "é", "日本", "ሴ", "x" * 70, "▁", "a▁b", "<s>", "</s>", "<0x41>", "\x00", "😀", "ﬁ", "①", "Ａ", " ", "　", "​", "\x01", "¨", "ﷺ", "é", "word", "don't", "12345", "ÿ", "\U00010348"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["", " ", "   ", "\x01", *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(n))]


def places(text):
    """Byte offset of each character, and of the end."""
    return np.cumsum([0, *(len(c.encode()) for c in text)])


@pytest.fixture(scope="module")
def own():
    return P.Pieces(P.model_path(), 50)


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=P.model_path())


def test_ids_and_spans_equal_the_library(own, library):
    for t in texts(3000, 1):
        ids, spans = own.encode(t)
        ids, spans = np.frombuffer(ids, "<u4").tolist(), np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()
        assert ids == library.encode(t, add_bos=True, add_eos=True), repr(t)
        assert spans[1:-1] == [[p.begin, p.end] for p in library.encode(t, return_type="proto").pieces], repr(t)
        assert own.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)


def with_spec(spec):
    """The public model with another normaliser."""
    with open(P.model_path(), "rb") as f:
        rest = b"".join(w for n, _, w in P.fields(f.read()) if n != P.NORMALIZER)
    size, head = len(spec), b""
    while True:
        head += bytes([size & 127 | (128 if size > 127 else 0)])
        size >>= 7
        if not size:
            return rest + bytes([P.NORMALIZER << 3 | 2]) + head + spec


@pytest.mark.parametrize("rule, flags", [("nmt_nfkc", {}), ("nfkc_cf", {"remove_extra_whitespaces": True}), ("nmt_nfkc", {"remove_extra_whitespaces": False}), ("nfkc", {"add_dummy_prefix": False}), ("nfkc", {"escape_whitespaces": False})])
def test_compiled_maps(tmp_path, rule, flags):
    norm = spm.SentencePieceNormalizer(rule_name=rule, **flags)
    path = tmp_path / "m.model"
    path.write_bytes(with_spec(norm.serialized_normalizer_spec()))
    ours, whole = P.Pieces(str(path)), spm.SentencePieceProcessor(model_file=str(path))
    if flags.get("escape_whitespaces", True):
        for t in texts(1500, 2):
            ids, spans = ours.encode(t)
            spans = np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_bos=True, add_eos=True), repr(t)
            assert spans[1:-1] == [[p.begin, p.end] for p in whole.encode(t, return_type="proto").pieces], repr(t)
    for t in texts(1500, 3):
        got = ours.normalized(t)
        text, offsets = norm.normalize(t, with_offsets=True)
        assert got.text == text, repr(t)
        if text:
            at = places(t).tolist()
            assert [at.index(b) for b in got.align[places(got.text)]] == offsets, repr(t)


def test_keys_of_a_map_are_found(tmp_path):
    """Against brute force: the longest key at every place."""
    norm = spm.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = {n: v for n, v, _ in P.fields(norm.serialized_normalizer_spec())}
    found = P.CharMap(spec[2])
    rules = {k.encode() if isinstance(k, str) else k: v for k, v in norm.decompile()}
    assert set(found.keys()) == set(rules) and len(rules) > 1000
    for t in texts(400, 4):
        source = t.encode()
        for at in places(t)[:-1].tolist():
            want = max((k for k in (source[at : at + n] for n in range(1, 40)) if k in rules), key=len, default=None)
            got = found.longest(source, at)
            assert (got and source[at : at + got[0]]) == want
            assert want is None or got[1].decode() == rules[want]


def test_query(spark, tmp_path, library):
    rows = [Row(doc_id=k, text=t, ids="x", spans=1) for k, t in enumerate([None, "", "same", "same", "long wörds\n" * 20_000, *texts(60, 5)])]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, spans int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in P.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    tokens = P.encoded(spark.read.parquet(str(tmp_path / "documents.parquet")), P.model_path())
    back = {r.doc_id: r.text for r in P.decoded(tokens, P.model_path()).collect()}
    assert back[4] == rows[4].text and back[0] == ""
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert P.query(spark, str(tmp_path / "e")).collect() == []
