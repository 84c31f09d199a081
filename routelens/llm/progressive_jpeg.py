"""Media columns as progressive JPEG.

``store`` writes a payload losslessly as the coefficients of a progressive,
three-component 4:2:0 JPEG: 64 bytes are a block, one byte a coefficient. Each
component is sent in five scans: DC with its last bit held back, that bit, AC
1-5 and AC 6-63 with their last bits held back, and those bits. Coefficients are
shifted so that a scan needs a single Huffman code and as many bits for each
value; such scans are packed and unpacked by numpy without a loop.

``coefficients`` reads progressive JPEG in general: spectral selection,
successive approximation, end-of-band runs, restarts and interleaved DC scans,
one symbol at a time where a scan isn't of the uniform kind. ``rgb`` dequantises,
inverse-transforms, upsamples chroma and gives the full-resolution tensor.

Null texts count as empty. The payload is the UTF-8 text, padded by zero bytes to
a positive multiple of 64. Equal texts have equal values; repeated rows repeat; a null
doc_id stays null. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, spread, table, texts_of

BLOCK = 64
OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _zigzag() -> np.ndarray:
    """Natural index of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_k = np.arange(8)
#: Rows are the cosine waves: spatial = WAVES.T @ coefficients @ WAVES.
WAVES = (np.where(_k == 0, math.sqrt(1 / 8), math.sqrt(2 / 8))[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * math.pi / 16)).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits, filled by ones to whole bytes, with a zero byte after each byte 255."""
    if pad := -len(bits) % 8:
        bits = np.concatenate([bits, np.ones(pad, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _single_code(kind: int, symbol: int) -> bytes:
    """A Huffman table of one symbol, coded as the bit 0."""
    return _segment(0xC4, bytes([kind << 4, 1]) + bytes(15) + bytes([symbol]))


def _low_bits(values: np.ndarray, n: int) -> np.ndarray:
    """The n low bits of each value, high first, after the code bit 0: shape (len, n + 1)."""
    out = np.zeros((len(values), n + 1), np.uint8)
    for i in range(n):
        out[:, n - i] = (values >> i) & 1
    return out


def _scan(component: int, first: int, last: int, high: int, low: int, bits: np.ndarray) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, first, last, high << 4 | low])) + _stuffed(bits)


def store(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload``, whose length is a multiple of 64."""
    blocks = len(payload) // BLOCK
    units = max(1, -(-blocks // 6))
    across = math.isqrt(units - 1) + 1
    down = -(-units // across)
    raw = np.zeros((6 * across * down, BLOCK), np.uint8)
    raw.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", blocks)), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_single_code(0, 9), _single_code(1, 8)]
    at = 0
    later: list[bytes] = []
    for component, n in ((1, 4 * across * down), (2, across * down), (3, across * down)):
        own = raw[at : at + n]
        at += n
        # DC alternates between two far ranges, so that every halved difference has nine bits.
        dc = own[:, 0].astype(np.int32) + np.where(np.arange(n) % 2 == 0, 512, -256)
        steps = np.diff(dc >> 1, prepend=0)
        out.append(_scan(component, 0, 0, 0, 1, _low_bits(np.where(steps > 0, steps, steps + 511), 9).reshape(-1)))
        later.append(_scan(component, 0, 0, 1, 0, (dc & 1).astype(np.uint8)))
        # AC is 256 and up: the halved value has eight bits.
        for first, last in ((1, 5), (6, 63)):
            halves = (own[:, first : last + 1] >> 1) | 0x80
            bits = np.zeros((halves.size, 9), np.uint8)
            bits[:, 1:] = np.unpackbits(halves.reshape(-1, 1), axis=1)
            out.append(_scan(component, first, last, 0, 1, bits.reshape(-1)))
        bits = np.zeros((n, 64), np.uint8)  # each block: the end-of-band code, then a bit for each coefficient
        bits[:, 1:] = own[:, 1:] & 1
        later.append(_single_code(1, 0) + _scan(component, 1, 63, 1, 0, bits.reshape(-1)))
    return b"".join([*out, *later, b"\xff\xd9"])


@dataclass
class _Part:
    """A component: sampling, quantisation, blocks across and down (padded, and of its own scans), coefficients."""

    h: int
    v: int
    quant: int
    wide: int = 0
    tall: int = 0
    own_wide: int = 0
    own_tall: int = 0
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


class _Bits:
    """Bits of an entropy-coded segment, one after another."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("not a Huffman code")

    def value(self, n: int) -> int:
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


def _uniform(part: _Part, data: bytes, codes: dict, first: int, last: int, high: int, low: int) -> bool:
    """Decode a scan of one component whose every value has as many bits; False if it is of another kind."""
    n, wide = part.own_wide * part.own_tall, last - first + 1
    if (part.own_wide, part.own_tall) != (part.wide, part.tall):
        return False
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    if first == 0 and high:
        if len(bits) < n:
            return False
        part.values[:n, 0] |= bits[:n].astype(np.int16) << low
        return True
    if list(codes) != [(1, 0)]:
        return False
    size = codes[1, 0]
    if first and high:
        if size or len(bits) < n * (wide + 1) or (part.values[:n, first : last + 1] < 1).any():
            return False
        part.values[:n, first : last + 1] += bits[: n * (wide + 1)].reshape(n, wide + 1)[:, 1:].astype(np.int16) << low
        return True
    count = n * wide
    if not 0 < size <= 11 or (first and size >> 4) or len(bits) < count * (size + 1):
        return False
    rows = bits[: count * (size + 1)].reshape(count, size + 1)
    if rows[:, 0].any():
        return False
    if size <= 8:
        values = (np.packbits(rows[:, 1:], axis=1).reshape(-1) >> (8 - size)).astype(np.int32)
    else:
        values = np.packbits(rows[:, 1:], axis=1).astype(np.int32) @ np.array([256, 1]) >> (16 - size)
    values = np.where(rows[:, 1] == 1, values, values - (1 << size) + 1)
    if first == 0:
        values = np.cumsum(values)
    part.values[:n, first : last + 1] = (values << low).reshape(n, wide)
    return True


def _refined(bits: _Bits, block: np.ndarray, k: int, bit: int) -> None:
    if bits.take(1):
        block[k] += bit if block[k] > 0 else -bit


def _ac_block(bits: _Bits, block: np.ndarray, codes: dict, first: int, last: int, high: int, low: int, run: int) -> int:
    """Decode the band of a block; how many blocks more the end-of-band run covers."""
    bit, k = 1 << low, first
    if not run:
        while k <= last:
            zeros, size = divmod(bits.symbol(codes), 16)
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            new = bits.value(size) * bit if size else 0
            if not high:
                k += zeros
            else:
                while k <= last and (block[k] or zeros):
                    if block[k]:
                        _refined(bits, block, k, bit)
                    else:
                        zeros -= 1
                    k += 1
            if new and k <= last:
                block[k] = new
            k += 1
    if not run:
        return 0
    if high:
        for j in range(k, last + 1):
            if block[j]:
                _refined(bits, block, j, bit)
    return run - 1


def _coded(parts: list[tuple[_Part, dict, dict]], pieces: list[bytes], interval: int, first: int, last: int, high: int, low: int, units: int, across: int) -> None:
    """Decode a scan symbol by symbol; ``pieces`` are the segments between restarts."""
    done = 0
    for piece in pieces:
        bits, before, run = _Bits(piece), [0] * len(parts), 0
        for unit in range(done, min(units, done + (interval or units))):
            for i, (part, dc, ac) in enumerate(parts):
                if len(parts) == 1:
                    places = [unit // part.own_wide * part.wide + unit % part.own_wide]
                else:
                    y, x = divmod(unit, across)
                    places = [(y * part.v + v) * part.wide + x * part.h + h for v in range(part.v) for h in range(part.h)]
                for place in places:
                    block = part.values[place]
                    if first:
                        run = _ac_block(bits, block, ac, first, last, high, low, run)
                    elif high:
                        block[0] |= bits.take(1) << low
                    else:
                        before[i] += bits.value(bits.symbol(dc))
                        block[0] = before[i] << low
        done += interval or units


def coefficients(media: bytes) -> tuple[list[_Part], dict[int, np.ndarray], int, int, bytes]:
    """Components with accumulated coefficients (zigzag order), quantisation tables, width, height, comment."""
    at, interval, comment = 2, 0, b""
    parts: dict[int, _Part] = {}
    quants: dict[int, np.ndarray] = {}
    codes: dict[int, dict] = {}
    wide = tall = across = down = 0
    while media[at + 1] != 0xD9:
        marker, size = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDB:
            while body:
                n = 129 if body[0] >> 4 else 65
                quants[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if n == 129 else np.uint8).astype(np.float32)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                counts, total, code, found = body[1:17], 17, 0, {}
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        found[n, code] = body[total]
                        total, code = total + 1, code + 1
                    code <<= 1
                codes[body[0]] = found
                body = body[total:]
        elif marker == 0xC2:
            _, tall, wide, n = struct.unpack_from(">BHHB", body)
            for i in range(n):
                c, hv, q = body[6 + 3 * i : 9 + 3 * i]
                parts[c] = _Part(hv >> 4, hv & 15, q)
            most_h, most_v = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            across, down = -(-wide // (8 * most_h)), -(-tall // (8 * most_v))
            for p in parts.values():
                p.wide, p.tall = across * p.h, down * p.v
                p.own_wide, p.own_tall = -(-(-(-wide * p.h // most_h)) // 8), -(-(-(-tall * p.v // most_v)) // 8)
                p.values = np.zeros((p.wide * p.tall, 64), np.int16)
        elif marker == 0xDA:
            n = body[0]
            own = [(parts[body[1 + 2 * i]], codes.get(body[2 + 2 * i] >> 4, {}), codes.get(0x10 | body[2 + 2 * i] & 15, {})) for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            pieces, begin = [], at
            while True:  # to the next marker that isn't a restart
                at = media.index(b"\xff", at)
                if media[at + 1] == 0:
                    at += 2
                    continue
                pieces.append(media[begin:at].replace(b"\xff\x00", b"\xff"))
                if not 0xD0 <= media[at + 1] <= 0xD7:
                    break
                at += 2
                begin = at
            units = own[0][0].own_wide * own[0][0].own_tall if n == 1 else across * down
            if n > 1 or len(pieces) > 1 or not _uniform(own[0][0], pieces[0], own[0][2 if first else 1], first, last, approx >> 4, approx & 15):
                _coded(own, pieces, interval, first, last, approx >> 4, approx & 15, units, across)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a progressive JPEG")
    return list(parts.values()), quants, wide, tall, comment


def load(media: bytes) -> bytes:
    """The payload that ``store`` wrote, from the accumulated coefficients."""
    return _payload(*coefficients(media)[::4])


def _payload(parts: list[_Part], comment: bytes) -> bytes:
    out = []
    for p in parts:
        own = p.values.astype(np.int32)
        own[:, 0] -= np.where(np.arange(len(own)) % 2 == 0, 512, -256)
        own[:, 1:] -= 256
        out.append(own.astype(np.uint8).tobytes())
    return b"".join(out)[: BLOCK * struct.unpack(">Q", comment)[0]]


def _tensor(parts: list[_Part], quants: dict[int, np.ndarray], wide: int, tall: int) -> np.ndarray:
    planes = []
    most_h, most_v = max(p.h for p in parts), max(p.v for p in parts)
    for p in parts:
        own = np.empty((len(p.values), 64), np.float32)
        own[:, ZIGZAG] = p.values * quants[p.quant]
        own = WAVES.T @ own.reshape(-1, 8, 8) @ WAVES
        plane = own.reshape(p.tall, p.wide, 8, 8).swapaxes(1, 2).reshape(8 * p.tall, 8 * p.wide)
        plane = np.clip(np.rint(plane + 128), 0, 255)
        planes.append(plane.repeat(most_v // p.v, 0).repeat(most_h // p.h, 1)[:tall, :wide])
    if len(planes) == 1:
        planes *= 3
        return np.stack(planes, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    both = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


def rgb(media: bytes) -> np.ndarray:
    """Full-resolution tensor, height x width x 3, 8 bits."""
    return _tensor(*coefficients(media)[:4])


def feature(tensor: np.ndarray) -> str:
    """Mean of each channel in thousandths, and a digest of a coarse brightness grid."""
    means = tensor.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (tensor.shape[0] * tensor.shape[1])
    grid = [part.sum(dtype=np.int64) * 64 // max(1, part.size) for row in np.array_split(tensor[:, :, 1], 4) for part in np.array_split(row, 4, 1)]
    return ",".join(map(str, [*means, *grid]))


def _payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, media binary, height, width and the RGB tensor (row by row) read back from the media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                media = [store(_payload_of(t)[1]) for t in texts_of(own["text"])]
                tensors = [rgb(m) for m in media]
                yield pa.RecordBatch.from_arrays(
                    [own["doc_id"], pa.array(media, pa.binary()), pa.array([x.shape[0] for x in tensors], pa.int32()), pa.array([x.shape[1] for x in tensors], pa.int32()), pa.array([x.tobytes() for x in tensors], pa.binary())],
                    ["doc_id", "media", "height", "width", "rgb"],
                )

    return spread(docs.select("doc_id", "text")).transform(mapped, run, "doc_id long, media binary, height int, width int, rgb binary")


def digest_media(docs: DataFrame) -> DataFrame:
    """Digests of what each text's media holds, and features of its tensor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), strict=True):
                n, payload = _payload_of(text)
                media = store(payload)
                parts, quants, wide, tall, comment = coefficients(media)
                back = _payload(parts, comment)
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(_tensor(parts, quants, wide, tall))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

    return spread(docs.select("doc_id", "text")).transform(mapped, run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every whole document as a progressive JPEG and back."""
    return digest_media(table(spark, sf_dir, "documents"))
