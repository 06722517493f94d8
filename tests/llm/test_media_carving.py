"""Carving: media that follow one another are found with their own bounds."""

import gzip
import itertools
import random
import struct
import zlib

import pytest

from larkspur.llm.media import as_wave, sniff


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


PDF = b"%PDF-1.4\n1 0 obj\n<</Length 3>>\nstream\nabc\nendstream endobj\nxref\nstartxref\n9\n%%EOF"
UPDATED = PDF + b"\n% changed\n2 0 obj\n<<>> endobj\nxref\nstartxref\n90\n%%EOF"
LINEAR = b"%PDF-1.4\n1 0 obj\n<<>> endobj\nxref\nstartxref\n0\n%%EOF\n2 0 obj\n<<>> endobj\nxref\nstartxref\n9\n%%EOF"
OUTER = b"%PDF-1.4\n1 0 obj\n<</Length 9>>\nstream\n" + UPDATED + png() + b"\nendstream endobj\nxref\nstartxref\n9\n%%EOF"
MEDIA = {
    "wav": ("audio/wav", as_wave(b"abcd")),
    "png": ("image/png", png()),
    "gif": ("image/gif", b"GIF89a\x01\x00\x01\x00\x80\x00\x00\0\0\0\xff\xff\xff!\xf9\x04\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"),
    "jpeg": ("image/jpeg", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cdsc\xff\x00an\xff\xd3x\xff\xd9"),
    "pdf": ("application/pdf", PDF),
    "updated": ("application/pdf", UPDATED),
    "linear": ("application/pdf", LINEAR),
    "outer": ("application/pdf", OUTER),
    "gzip": ("application/gzip", gzip.compress(b"some text " * 9, mtime=0)),
    "long gzip": ("application/gzip", gzip.compress(random.Random(1).randbytes(300_000), mtime=0)),
}
FLAC = ("audio/flac", b"fLaC\x80\0\0\x22" + b"\0" * 60)


@pytest.mark.parametrize("names", [*itertools.product(MEDIA, repeat=2), ("pdf", "png", "pdf"), ("gzip", "png", "updated", "wav", "gzip", "gif", "linear", "jpeg", "outer", "long gzip")])
@pytest.mark.parametrize("gap", [b"", b" text "])
def test_concatenations(names, gap):
    data, want = b"", []
    for kind, one in [*map(MEDIA.get, names), FLAC]:  # a FLAC runs to the end
        data += gap
        want.append((kind, len(data), len(data) + len(one)))
        data += one
    assert sniff(data) == want


def test_gzip_must_end():
    whole = MEDIA["long gzip"][1]
    assert sniff(b"text \x1f\x8b\x08") == [] and sniff(whole[:-1]) == []
    assert sniff(whole[:2000] + bytes([whole[2000] ^ 255]) + whole[2001:]) == []
    assert sniff(whole[:-1] + MEDIA["png"][1])[-1][0] == "image/png"
    assert sniff(gzip.compress(b"\0" * 5_000_000) + b"x") == [("application/gzip", 0, len(gzip.compress(b"\0" * 5_000_000)))]


def test_pdf_must_end():
    assert sniff(PDF[:40] + PDF) == [("application/pdf", 40, 40 + len(PDF))]
    assert sniff(b"%PDF-1.7 begun " + PDF) == [("application/pdf", 15, 15 + len(PDF))]
    assert sniff(PDF[:-1]) == []
