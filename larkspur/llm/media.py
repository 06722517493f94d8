"""Operator 2, media columns: signature sniffing of byte strings.

An Aho-Corasick automaton over all magic byte strings finds where media may begin, in one
pass; a validator per format then confirms the structure and gives the length, so that a
stray magic string is no find. The declared type is corrected by what is found at the start,
and media embedded further on are carved out with their exact bounds.

Formats: WAV (RIFF chunks up to the declared length), PNG (chunks with their checksums up to
IEND), GIF (blocks up to the trailer), ZIP-free PDF (header to the %%EOF of its last incremental
revision), JPEG (segments, then scan data up to the end marker), gzip (inflated to its end, with
its checksum; each member is a find), FLAC (header; it runs to the end of the bytes).

``as_wave`` stores any bytes losslessly as the samples of an 8-bit mono WAV file.

Defined results: null bytes sniff as null media, no finds and type ``unknown`` (or null where
none was declared); empty bytes give no finds; nested media inside one that was confirmed are
not reported again; other columns are handed through, namesakes of output columns replaced;
rows are independent, so repeated rows give equal results and an empty table an empty one.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import blocks as B
from larkspur.llm.session import documents

RATE = 16_000
WAVE_HEADER = 44
GZIP_PIECE = 1 << 16
#: The byte strings by which formats begin.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"%PDF-": "application/pdf",
    b"fLaC": "audio/flac",
    b"\x1f\x8b\x08": "application/gzip",
}


def wave_end(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0] if p + 8 <= len(b) else 0
        if name == b"data" and b"fmt " not in seen:
            return None
        seen.add(name)
        p += 8 + n + (n & 1)
    return end if p == end <= len(b) and {b"fmt ", b"data"} <= seen else None


def png_end(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or (first and name != b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if name == b"IEND":
            return p
    return None


def gif_end(b: bytes, at: int) -> int | None:
    def blocks(p: int) -> int:
        while b[p]:
            p += 1 + b[p]
        return p + 1

    try:
        flags = b[at + 10]
        p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
        while b[p] != 0x3B:
            if b[p] == 0x21:
                p = blocks(p + 2)
            elif b[p] == 0x2C:
                p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0))
            else:
                return None
        return p + 1
    except IndexError:
        return None


def jpeg_end(b: bytes, at: int) -> int | None:
    p = at + 2
    try:
        while b[p] == 0xFF:
            kind = b[p + 1]
            if kind == 0xD9:
                return p + 2
            p += 2 + struct.unpack_from(">H", b, p + 2)[0]
            if kind == 0xDA:  # scan data: 0xFF is followed by 0 or a restart marker
                while True:
                    p = b.index(b"\xff", p)
                    if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                        p += 2
                    else:
                        break
    except (IndexError, ValueError, struct.error):
        pass
    return None


PDF_MARK = re.compile(rb"(%%EOF)|(%PDF-)|(>>\s*stream\r?\n)|(endstream)")
PDF_UPDATE = re.compile(rb"(?:\s|%(?!PDF-)[^\r\n]*[\r\n])*(?:\d+\s+\d+\s+obj|xref|startxref)\b")


def pdf_end(b: bytes, at: int) -> int | None:
    """The last %%EOF before the next header and before bytes that are no update; files in streams belong to the outer one."""
    end, p, depth = None, at + 5, 0
    for m in PDF_MARK.finditer(b, at + 5):
        if m[3]:
            depth += 1
        elif m[4]:
            depth = max(depth - 1, 0)
        elif depth:
            continue
        elif m[2] or (end is not None and not PDF_UPDATE.match(b, end)):
            return end
        elif (x := b.rfind(b"startxref", p, m.start())) >= 0:
            p = m.end()
            if b[x + 9 : m.start()].strip() != b"0":  # the first part of a linearized file refers to 0
                end = p
    return end


def flac_end(b: bytes, at: int) -> int | None:
    return len(b) if len(b) >= at + 42 and b[at + 4] & 127 == 0 and b[at + 5 : at + 8] == b"\0\0\x22" else None


def gzip_end(b: bytes, at: int) -> int | None:
    d, p = zlib.decompressobj(31), at
    try:
        while not d.eof:
            piece = d.unconsumed_tail
            if not piece:
                piece, p = b[p : p + GZIP_PIECE], p + GZIP_PIECE
                if not piece:
                    return None
            d.decompress(piece, GZIP_PIECE)
    except zlib.error:
        return None
    return min(p, len(b)) - len(d.unused_data)


VALIDATORS = {"audio/wav": wave_end, "image/png": png_end, "image/gif": gif_end, "image/jpeg": jpeg_end, "application/pdf": pdf_end, "audio/flac": flac_end, "application/gzip": gzip_end}

_automaton = None


def automaton():
    """Over Latin-1 text, in which each byte is one character; one for each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            _automaton.add_word(magic.decode("latin-1"), (len(magic), kind))
        _automaton.make_automaton()
    return _automaton


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of the media in the bytes, outermost only, in order."""
    found, past = [], 0
    for last, (n, kind) in automaton().iter(data.decode("latin-1")):
        at = last - n + 1
        if at >= past and (end := VALIDATORS[kind](data, at)) is not None:
            found.append((kind, at, end))
            past = end
    return found


def as_wave(payload: bytes, rate: int = RATE) -> bytes:
    """The bytes as the samples of an 8-bit mono WAV file; an odd number is padded by RIFF's rule."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def samples(wave: bytes) -> bytes:
    """The data chunk of a WAV file, whatever chunks come before it."""
    p = 12
    while wave[p : p + 4] != b"data":
        n = struct.unpack_from("<I", wave, p + 4)[0]
        p += 8 + n + (n & 1)
    return wave[p + 8 : p + 8 + struct.unpack_from("<I", wave, p + 4)[0]]


FOUND = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("bytes", T.BinaryType())]))


def sniff_media(df: DataFrame, media: str = "media", declared: str | None = None, carve: bool = True, text: str | None = None) -> DataFrame:
    """df with media_type (corrected), mismatch and found (the carved media).

    ``declared`` names a column with the type that was claimed. Without ``carve`` the found
    media have no bytes, only bounds.
    """
    fields = [f for f in df.schema.fields if f.name not in ("media_type", "mismatch", "found")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("media_type", T.StringType()), T.StructField("mismatch", T.BooleanType()), T.StructField("found", FOUND)])
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.binary())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.rebatched(batches, media):
            claims = b.column(names.index(declared)).to_pylist() if declared else [None] * b.num_rows
            types, wrong, found = [], [], []
            for x, claim in zip(b.column(names.index(media)).to_pylist(), claims, strict=True):
                hits = sniff(x) if x else []
                own = hits[0][0] if hits and hits[0][1] == 0 else None
                types.append(own or claim or "unknown")
                wrong.append(own is not None and claim is not None and own != claim)
                found.append([{"type": k, "start": s, "end": e, "bytes": x[s:e] if carve else None} for k, s, e in hits])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(found, kind)], names=[*names, "media_type", "mismatch", "found"])

    return df.select(names).mapInArrow(B.streaming(work), schema)


def stored_texts(docs: DataFrame, unit: int = 64, text: str = "text") -> DataFrame:
    """docs with n_bytes and media: the text's bytes, padded to a positive multiple of the unit, as a WAV file."""
    fields = [f for f in docs.schema.fields if f.name not in (text, "n_bytes", "media")]
    names = [f.name for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in B.rebatched(batches, text):
            raw = [(x or "").encode() for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            media = [as_wave(x + b"\0" * (-len(x) % unit if x else unit)) for x in raw]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in names), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=[*names, "n_bytes", "media"])

    return docs.mapInArrow(B.streaming(work), T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def sample_features(df: DataFrame) -> DataFrame:
    """df with payload, read from the first WAV that was carved, and feature: type, rate, mean and zero crossings."""
    fields = [f for f in df.schema.fields if f.name not in ("payload", "feature", "found")]
    names = [f.name for f in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 200) for x in batches for i in range(0, x.num_rows, 200)):
            payloads, features = [], []
            for found in b.column(b.schema.get_field_index("found")).to_pylist():
                wave = next((f["bytes"] for f in found or [] if f["type"] == "audio/wav"), None)
                if wave is None:
                    payloads.append(None)
                    features.append(None)
                    continue
                payloads.append(data := samples(wave))
                x = np.frombuffer(data, dtype=np.uint8)
                crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
                features.append(f"audio/wav {struct.unpack_from('<I', wave, 24)[0]} Hz n={len(x)} sum={int(x.sum(dtype=np.int64))} peak={int(x.max(initial=0))} crossings={crossings}")
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=[*names, "payload", "feature"])

    return df.mapInArrow(B.streaming(work), T.StructType([*fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]))


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = sample_features(sniff_media(stored_texts(docs)))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
