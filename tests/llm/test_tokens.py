"""Operators 3 and 8 against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import packing
from larkspur.llm.bpe import Decoder, Encoder, bpe_decode, bpe_encode, op8_bpe
from larkspur.llm.chunks import cuts
from larkspur.llm.packing import best_fit, op3_best_fit_packing, pack, token_pieces

LINES = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS, DECODER = Encoder(LINES, P.PATTERN), Decoder(LINES)
HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
IDS = packing.Ids(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
ODD = ["", " ", "  ", "a  b", "a   b\n\n c ", "\n \n x", "x  y　 z", " \x1c a", "don't <|endoftext|> we'll", "<|endoftext|><|endoftext|>x", "a.'s b,'sun ''t x'll've 1a,2", "wordé,c'd", "日本語 テキスト", "é" * 300, "ab" * 3000, "x" * 5000 + " tail ", "1 22  333\t4444 ", " lead", "é \U0001f600\U0001f600"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t a1.'s\x1c"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_like_the_libraries(text):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    at = cuts(data, np.array([0, len(data)])).tolist()
    chunks = [data[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)]
    assert "".join(chunks) == text
    assert OURS.encode(text) == LIBRARY.encode_ordinary(text)
    assert DECODER.decode(np.array(OURS.encode(text), dtype=np.int64), 7)[0] == text.encode()
    assert IDS(data, np.array([0, len(data)]))[0].tolist() == HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    test_like_the_libraries.hypothesis.inner_test(text)


def test_frames(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, None, "own"), (1, "two words", "own"), (None, "x", None)], "doc_id long, text string, decoded string")
    got = bpe_decode(bpe_encode(df, path, P.PATTERN), path).collect()
    assert sorted((r.ids, bytes(r.decoded)) for r in got) == sorted([([], b""), (LIBRARY.encode("two words"), b"two words"), (LIBRARY.encode("x"), b"x")])
    assert bpe_encode(df.limit(0), path, P.PATTERN).count() == 0


def test_op8(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_bpe(spark, sf).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def whole(rows, capacity=2048):
    """Checks places; gives the number of sequences and the least possible."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_op3(spark):
    sf = "/root/testdata/sf0.01"
    rows = op3_best_fit_packing(spark, sf).collect()
    got = {(r.doc_id, r.piece): r for r in rows}
    assert len(got) == len(rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for doc_id, text in texts.items():
        ids = HF.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) % 2048 or 2048) if len(ids) > 2048 else len(ids)
        cuts = [0, first, *range(first + 2048, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            r = got.pop((doc_id, p))
            assert (r.start, r.length, r.ids_crc32) == (a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))
    assert not got
    used, least = whole(rows)
    assert used <= least + 1


def test_tree_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "NODE_BINS", 40)
    r = random.Random(3)
    items = [(i, r.choice([3, 700, 1100, 1500, 2048, 1024, r.randint(1, 2048)])) for i in range(900)]
    df = spark.createDataFrame([(i, n, 5) for i, n in items], "x long, length long, offset int").repartition(12)
    rows = pack(df).collect()
    assert sorted((r.x, r.length) for r in rows) == items
    assert whole(rows)[0] <= len(best_fit(np.array([n for _, n in items]), 2048)[1]) * 1.05


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    rows = pack(token_pieces(df, P.path("byte_bpe_50k.json"))).collect()
    assert sorted((r.offset, r.length, len({x.sequence_id for x in rows})) for r in rows) == [(0, 1, 1), (1, 1, 1), (2, 1, 1)]
    assert pack(token_pieces(df.limit(0), P.path("byte_bpe_50k.json"))).count() == 0


def test_batches_of_documents():
    """Documents of one batch don't run into each other, and kept chunks pass through both generations."""
    r = random.Random(1)
    texts = [" ".join(r.choices(["a", "bc", "d,", "x'll", " ", "é", "\n"], k=r.randint(0, 30))) for _ in range(300)] + ODD
    data = [x.encode() for x in texts]
    buf, offsets = np.frombuffer(b"".join(data), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])
    for encode in (IDS, packing.Ids(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())):
        encode.chunks.most = 5
        ids, at = encode(buf, offsets)
        for x, a, b in zip(texts, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == HF.encode(x, add_special_tokens=False).ids


def test_unlike_partitions(spark, monkeypatch):
    """Long items in some partitions and short ones in others meet, whatever the number of nodes."""
    monkeypatch.setattr(packing, "NODE_BINS", 40)
    df = spark.range(2000, numPartitions=8).selectExpr("id as x", "if(id < 1000, 1500L, 500L) as length")
    assert whole(pack(df).collect())[0] <= len(best_fit(np.array([1500] * 1000 + [500] * 1000), 2048)[1]) * 1.01


def test_long_text(spark):
    text = "word, 12 " * 40_000 + "x" * 30_000
    rows = sorted(token_pieces(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect(), key=lambda r: (r.doc_id, r.piece))
    ids = np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in rows if r.doc_id == 1]).tolist()
    assert ids == HF.encode(text, add_special_tokens=False).ids + [0] and len(rows) == -(-len(ids) // 2048) + 1
