"""Operators 2, 4 and 5: round trips and brute force."""

import math
import hashlib
import struct
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.chat import CHAT_SQL, OWN_MARKS, Formatter, Template, chat_format, chat_read_back, op4_chat_formatting
from larkspur.llm.media import as_wave, op2_media_columns, samples, sniff, sniff_media, stored_texts
from larkspur.llm.topk import TOPK_SQL, exact_topk, op5_exact_topk

SF = "/root/testdata/sf0.01"


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\0\0\0\xff\xff\xff!\xf9\x04\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cdsc\xff\x00an\xff\xd3x\xff\xd9"
PDF = b"%PDF-1.4 body startxref 9 %%EOF"


@pytest.mark.parametrize("kind,data", [("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("application/pdf", PDF), ("audio/wav", as_wave(b"abc")), ("audio/wav", as_wave(b""))])
def test_formats(kind, data):
    assert sniff(data) == [(kind, 0, len(data))]
    assert sniff(b"RIFF GIF89a" + data + b"\x89PNG\r\n\x1a\n tail") == [(kind, 11, 11 + len(data))]
    assert sniff(data[:-1]) == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_wave_round_trip(data):
    assert samples(as_wave(data)) == data
    assert sniff(as_wave(data + b"RIFF")) == [("audio/wav", 0, len(as_wave(data + b"RIFF")))]


def test_media_columns(spark):
    rows = [(1, png() + GIF, "image/gif", 1), (1, None, None, 1), (2, b"", "x/y", 2), (None, b"text " + as_wave(b"ab"), None, 3)]
    df = spark.createDataFrame(rows, "id long, media binary, declared string, found int")
    out = {(r.id, r.media is None): r for r in sniff_media(df, declared="declared").collect()}
    r = out[1, False]
    assert (r.media_type, r.mismatch, [bytes(f.bytes) for f in r.found]) == ("image/png", True, [png(), GIF])
    assert (out[1, True].media_type, out[1, True].found) == ("unknown", []) and out[2, False].media_type == "x/y"
    assert [(f.start, f.type) for f in out[None, False].found] == [(5, "audio/wav")]
    assert stored_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op2(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_media_columns(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        wave = as_wave(payload)
        assert tuple(r)[1:7] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wave), hashlib.sha256(wave).hexdigest())
        assert r.feature.startswith("audio/wav 16000 Hz")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a: b\\", "### x </turn>\n"]), st.text(alphabet="\\#: </turn>\nab### ", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    f = Formatter(Template())
    s, segments = f.format(turns)
    assert f.read_back(s) == turns
    assert [a for a, _, _ in segments] == [0, *(b for _, b, _ in segments)][: len(segments)]
    assert [f.unescape(s[a:b]) for a, b, loss in segments if loss] == [t for r, t in turns if r == "assistant"]


def test_chat_order_and_odd_rows(spark):
    f = Formatter(Template())
    assert f.valid(["system", "user", "assistant"]) and not f.valid(["assistant"]) and not f.valid(["user"]) and not f.valid(["user", "user"]) and not f.valid([])
    rows = [(1, 0, None, None), (None, 0, "user", "a"), (None, 0, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r.conv_id: r for r in chat_read_back(chat_format(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("", "")] and len(got[2].turns) == 3 and got[2].loss_text == "bb" and not got[2].valid
    assert chat_format(df.limit(0)).count() == 0


def as_views():
    c = duckdb.connect()
    for t in ("conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_op4(spark):
    out = op4_chat_formatting(spark, SF)
    rows = sorted(tuple(r) for r in out.collect())
    assert rows == sorted(as_views().execute(CHAT_SQL).fetchall()) and rows[0][0] == -7 and rows[0][3] == len(OWN_MARKS)


def test_op5(spark):
    out = op5_exact_topk(spark, SF)
    assert sorted(tuple(r) for r in out.collect()) == sorted(as_views().execute(TOPK_SQL).fetchall())


@pytest.mark.parametrize("block,lead", [(16, 2), (64, 4), (1000, 8)])
def test_topk_brute(spark, block, lead):
    r = np.random.default_rng(block)
    x = r.normal(size=(400, 8)) * r.choice([0.01, 1, 3], size=(400, 1))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [1.0]), (20, x[7].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = {}
    for row in exact_topk(df, lambda i: i % 20 == 0, k=5, block=block, lead=lead).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    ids = [i for i, v in rows if i < 900]
    v = np.array([np.floor(np.array(v) * 64) for i, v in rows if i < 900])
    for q in {i for i in ids if i % 20 == 0} - {20}:
        s = v @ v[ids.index(q)]
        want = sorted((-int(a), c) for a, c in zip(s, ids, strict=True) if c != q)[:5]
        assert sorted(got[q]) == [(k + 1, c, -a) for k, (a, c) in enumerate(want)]
    assert exact_topk(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert exact_topk(df.where("vec_id < 3"), lambda i: i == 0).count() == 2


@pytest.mark.parametrize("block", [8, 1000])
def test_topk_of_large_components(spark, block):
    """Squared lengths far beyond doubles' integers, and beyond a long."""
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(120, 4)) * 10.0 ** r.choice([0, 6, 8, 12, 30, 300], size=(120, 1)), 3)
    x[50:60] = x[50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = [[min(max(math.floor(64 * y) if abs(y) < 1e200 else int(math.copysign(1 << 63, y)), -(1 << 63)), (1 << 63) - 1) for y in row] for row in x.tolist()]
    cut = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = set()
    for q in range(0, 120, 20):
        s = sorted((-cut(sum(a * b for a, b in zip(v[q], v[c], strict=True))), c) for c in range(120) if c != q)[:7]
        want |= {(q, k + 1, c, -a) for k, (a, c) in enumerate(s)}
    assert {tuple(r) for r in exact_topk(df, lambda i: i % 20 == 0, k=7, block=block, lead=2).collect()} == want


def test_chat_long_text():
    f = Formatter(Template())
    text = "a:\\\n### b </turn> " * 200_000
    s, _ = f.format([("user", text), ("assistant", "x" * 3_000_000)])
    assert f.read_back(s) == [("user", text), ("assistant", "x" * 3_000_000)]
    with pytest.raises(ValueError):
        f.read_back(s[:-2])
