import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from routelens.llm import progressive_jpeg as pj


@pytest.mark.parametrize("n", [64, 128, 64 * 6, 64 * 7, 64 * 97, 64 * 1000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    assert pj.load(pj.store(payload)) == payload
    for payload in (bytes(n), b"\xff" * n):
        assert pj.load(pj.store(payload)) == payload


def test_symbol_by_symbol_reads_the_same(monkeypatch):
    payload = random.Random(1).randbytes(64 * 20)
    media = pj.store(payload)
    fast = pj.rgb(media)
    monkeypatch.setattr(pj, "_uniform", lambda *a: False)
    assert pj.load(media) == payload
    assert (pj.rgb(media) == fast).all()


def test_transform_inverts():
    block = np.random.default_rng(0).integers(0, 255, (8, 8)).astype(np.float32)
    assert np.allclose(pj.WAVES.T @ (pj.WAVES @ block @ pj.WAVES.T) @ pj.WAVES, block, atol=1e-3)
    assert sorted(pj.ZIGZAG) == list(range(64)) and list(pj.ZIGZAG[:6]) == [0, 1, 8, 16, 9, 2]


def _bits(text):
    bits = [int(b) for b in text]
    return pj._stuffed(np.array(bits, np.uint8))


def test_foreign_progressive_file():
    """One grey component, 16 x 8, built by hand: runs of zeros, an end-of-band run, and new coefficients in a refinement."""
    frame = pj._segment(0xC2, struct.pack(">BHHB", 8, 8, 16, 1) + bytes([1, 0x11, 0]))
    quant = pj._segment(0xDB, b"\x00" + b"\x02" * 64)

    def table(kind, symbols):  # all codes of two bits
        return pj._segment(0xC4, bytes([kind << 4, 0, len(symbols)]) + bytes(14) + bytes(symbols))

    scans = [
        table(0, [3, 2]) + pj._segment(0xDA, bytes([1, 1, 0, 0, 0, 0x00])) + _bits("00101" + "0101"),  # 5, then 5 - 2
        table(1, [0x21, 0x10, 0x01]) + pj._segment(0xDA, bytes([1, 1, 0, 1, 63, 0x01])) + _bits("001" + "01" + "0"),  # block 0: AC 3 = 2; end of band for both
        table(1, [0x01, 0x00]) + pj._segment(0xDA, bytes([1, 1, 0, 1, 63, 0x10])) + _bits("000" + "01" + "1" + "01"),  # block 0: AC 1 = -1, AC 3 -> 3; block 1 nothing
    ]
    parts, quants, wide, tall, _ = pj.coefficients(b"\xff\xd8" + quant + frame + b"".join(scans) + b"\xff\xd9")
    values = parts[0].values
    assert values[0, :5].tolist() == [5, -1, 0, 3, 0] and values[1, 0] == 3
    assert not values[0, 5:].any() and not values[1, 1:].any()
    grey = pj._tensor(parts, quants, wide, tall)
    assert grey.shape == (8, 16, 3) and (grey[:, 8:] == round(128 + 3 * 2 / 8)).all()


def test_query(spark):
    texts = [None, "", "abc", "abc", "é" * 777, "x" * 20000]
    docs = spark.createDataFrame([(i, t, b"0") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in pj.digest_media(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
    assert got[2][1:] == got[3][1:] and got[0][1:] == got[1][1:]
    rows = {r.doc_id: r for r in pj.media_column(docs).collect()}
    for i, r in rows.items():
        assert len(r.rgb) == r.height * r.width * 3
        assert hashlib.sha256(r.media).hexdigest() == got[i].media_sha256 and len(r.media) == got[i].media_bytes
    assert pj.digest_media(docs.limit(0)).count() == 0
