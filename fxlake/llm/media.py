"""Media columns: progressive JPEG files.

`encode_media` stores a payload without loss in the coefficients of a progressive JPEG (colour, chroma at half
resolution both ways). `decode_media` reads any progressive Huffman-coded JPEG of 8-bit samples: its scans are
accumulated into coefficient arrays (spectral selection and successive approximation, DC and AC), which give the
payload back, and an inverse transform in numpy, chroma upsampling and colour conversion give the full-resolution
RGB tensor.

How a payload is stored: byte b is the coefficient whose magnitude category is 8 and whose eight extra bits are b
(b from 128, else b - 255). Each block holds 48 of them, in zigzag places 1 to 48; place 0 (DC) is zero. 576 bytes
fill two 16 x 16 units of six blocks. Each scan of AC coefficients goes down to bit 1 first and bit 0 after.

Null and empty texts give one padding unit of 576 bytes of 255. Damaged files raise ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fxlake.llm.common import bounded_batches, read_table, text_or_empty

UNIT, IN_BLOCK, FILL = 576, 48, 255
#: Payload units in a column of the picture; longer payloads make it wider (65,535 lines is the format's limit).
UNITS_DOWN = 4000
#: The bands of the first AC scans of each component.
FIRST_BANDS = {1: ((1, 24), (25, 48)), 2: ((1, 48),), 3: ((1, 48),)}


def pad(data: bytes) -> bytes:
    return data + bytes([FILL]) * (-len(data) % UNIT or (0 if data else UNIT))


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, slot: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, coded as the bit 0."""
    return _segment(0xC4, bytes([kind << 4 | slot, 1, *[0] * 15, symbol]))


def _scan(parts: list[tuple[int, int]], band: tuple[int, int], high: int, low: int, coded: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes([c, t]) for c, t in parts) + bytes([*band, high << 4 | low])
    return _segment(0xDA, head) + coded.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits to bytes; the last byte is filled with ones."""
    flat = bits.reshape(-1)
    return np.packbits(np.concatenate([flat, np.ones(-flat.size % 8, flat.dtype)])).tobytes()


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG file holding the payload, whose length is a multiple of 576."""
    units = len(payload) // UNIT
    across = -(-units // UNITS_DOWN)
    down = -(-units // across)
    data = np.full(across * down * UNIT, FILL, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = data.reshape(-1, IN_BLOCK)
    n = len(blocks)
    planes = {1: blocks[: 4 * n // 6], 2: blocks[4 * n // 6 : 5 * n // 6], 3: blocks[5 * n // 6 :]}
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, bytes([0] + [1] * 64))]
    frame = bytes([8]) + (16 * down).to_bytes(2, "big") + (32 * across).to_bytes(2, "big")
    out.append(_segment(0xC2, frame + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_table(0, 0, 0x00), _table(1, 0, 0x07), _table(1, 1, 0x00)]  # DC: no difference; AC: seven bits; AC: end of block
    everything = [(1, 0x00), (2, 0x00), (3, 0x00)]
    none = np.zeros(n, np.uint8)
    out.append(_scan(everything, (0, 0), 0, 1, _packed(none)))
    for c, plane in planes.items():
        for first, last in FIRST_BANDS[c]:  # the code's bit 0 and seven bits of the value make a byte
            out.append(_scan([(c, 0x00)], (first, last), 0, 1, (plane[:, first - 1 : last] >> 1).tobytes()))
    out.append(_scan(everything, (0, 0), 1, 0, _packed(none)))
    for c, plane in planes.items():
        bits = np.zeros((len(plane), IN_BLOCK + 1), np.uint8)
        bits[:, 1:] = (plane ^ (plane >> 7) ^ 1) & 1  # the lowest bit of the magnitude: b from 128, 255 - b below
        out.append(_scan([(c, 0x01)], (1, IN_BLOCK), 1, 0, _packed(bits)))
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- reading


_NEXT_MARKER, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S), re.compile(rb"\xff[\xd0-\xd7]")


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("entropy-coded data ends early")
        value = 0
        for bit in self.bits[self.at : self.at + n]:
            value = value << 1 | bit
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        bits = self.take(size)
        return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


class _Component:
    def __init__(self, h: int, v: int, table: int):
        self.h, self.v, self.table = h, v, table
        self.coefficients = np.zeros((0, 0, 64), np.int16)
        self.blocks = (0, 0)  # rows and columns that the picture needs; the array also has those that fill the last unit
        self.places = np.zeros(64, np.uint8)  # of each zigzag place: 0 untouched, 1 nonzero in every block, 2 anything


def _even_scan(part: _Component, coder: dict, first: int, last: int, high: int, low: int, data: bytes) -> bool:
    """A scan of one component in which every block has the same layout of bits, decoded at once. The layout is
    taken from the start of the scan and held against every block; False if one differs, with nothing changed."""
    rows, columns = part.blocks
    target = part.coefficients[:rows, :columns, first : last + 1]
    n, width = rows * columns, last - first + 1
    if high:
        length, code = next(((k, c) for (k, c), s in coder.items() if s == 0), (0, 0))
        if not length or len(data) != -(-n * (length + width) // 8) or (part.places[first : last + 1] != 1).any():
            return False
        bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (length + width)).reshape(n, -1)
        prefix = [code >> (length - 1 - i) & 1 for i in range(length)]
        if (bits[:, :length] != prefix).any():
            return False
        step = bits[:, length:].reshape(rows, columns, width).astype(np.int16) << low
        target += np.where(target < 0, -step, step)
        return True
    length, code, size = next(((k, c, s) for (k, c), s in coder.items() if 0 < s < 16), (0, 0, 0))
    if length + size != 8 or len(data) != n * width or part.places[first : last + 1].any():
        return False
    octets = np.frombuffer(data, np.uint8)
    if (octets >> size != code).any():
        return False
    value = (octets & ((1 << size) - 1)).astype(np.int16)
    value -= np.where(value >> (size - 1), 0, (1 << size) - 1).astype(np.int16)
    target[...] = value.reshape(rows, columns, width) << low
    part.places[first : last + 1] = 1
    return True


def _any_scan(parts: list[tuple[_Component, dict, dict]], units: tuple[int, int], band: tuple[int, int], high: int, low: int, segments: list[bytes], interval: int) -> None:
    """A scan of any layout, bit by bit."""
    first, last = band
    if len(parts) == 1:
        rows, columns = parts[0][0].blocks
        places = [[(0, r, c)] for r in range(rows) for c in range(columns)]
    else:
        places = [
            [(k, r * p.v + y, c * p.h + x) for k, (p, _, _) in enumerate(parts) for y in range(p.v) for x in range(p.h)]
            for r in range(units[0]) for c in range(units[1])
        ]
    for part, _, _ in parts:
        part.places[first : last + 1] = 2
    step, bits, before, run = 1 << low, None, [], 0
    for i, unit in enumerate(places):
        if bits is None or interval and i % interval == 0:
            if not segments:
                raise ValueError("a restart interval is missing")
            bits, before, run = _Bits(segments.pop(0)), [0] * len(parts), 0
        for k, row, column in unit:
            part, dc, ac = parts[k]
            block = part.coefficients[row, column]
            if first == 0:
                if high:
                    block[0] |= bits.take(1) << low
                else:
                    before[k] += bits.value(bits.symbol(dc))
                    block[0] = before[k] << low
                continue
            at = first
            if not run:
                while at <= last:
                    symbol = bits.symbol(ac)
                    zeros, size = symbol >> 4, symbol & 15
                    if not size and zeros < 15:
                        run = (1 << zeros) + bits.take(zeros)
                        break
                    if not high:
                        at += zeros
                        if size:
                            if at > last:
                                raise ValueError("a coefficient beyond the band")
                            block[at] = bits.value(size) << low
                        at += 1
                        continue
                    new = (step if bits.take(1) else -step) if size else 0
                    while at <= last:
                        if block[at]:
                            if bits.take(1) and not block[at] & step:
                                block[at] += step if block[at] > 0 else -step
                        elif zeros == 0:
                            if new:
                                block[at] = new
                            at += 1
                            break
                        else:
                            zeros -= 1
                        at += 1
            if run:
                if high:
                    for j in range(at, last + 1):
                        if block[j] and bits.take(1) and not abs(int(block[j])) & step:
                            block[j] += step if block[j] > 0 else -step
                run -= 1


def decode_scans(file: bytes) -> tuple[int, int, list[_Component], dict[int, np.ndarray], list[bytes]]:
    """Width, height, components with their accumulated coefficients (zigzag order), quantisers, comments."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, interval, width, height = 2, 0, 0, 0
    parts: dict[int, _Component] = {}
    quantisers: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    comments: list[bytes] = []
    units = (0, 0)
    while at + 4 <= len(file) and file[at : at + 2] != b"\xff\xd9":
        marker, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], f">u{wide}").astype(np.float32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, code, symbols, place = body[1:17], 0, {}, 17
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        symbols[length, code] = body[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                tables[body[0] >> 4, body[0] & 15] = symbols
                body = body[place:]
        elif marker == 0xC2:
            if body[0] != 8:
                raise ValueError("only samples of 8 bits are read")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for i in range(body[5]):
                name, factors, quantiser = body[6 + 3 * i : 9 + 3 * i]
                parts[name] = _Component(factors >> 4, factors & 15, quantiser)
            most_h, most_v = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            units = (-(-height // (8 * most_v)), -(-width // (8 * most_h)))
            for p in parts.values():
                p.coefficients = np.zeros((units[0] * p.v, units[1] * p.h, 64), np.int16)
                p.blocks = (-(-height * p.v // (8 * most_v)), -(-width * p.h // (8 * most_h)))
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif marker == 0xDA:
            end = _NEXT_MARKER.search(file, at)
            coded, at = file[at : end.start() if end else len(file)], end.start() if end else len(file)
            segments = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(coded)]
            named = [body[1 + 2 * i : 3 + 2 * i] for i in range(body[0])]
            first, last, bits = body[1 + 2 * body[0] :][:3]
            chosen = [(parts[c], tables.get((0, t >> 4), {}), tables.get((1, t & 15), {})) for c, t in named]
            if first and len(chosen) == 1 and not interval and _even_scan(chosen[0][0], chosen[0][2], first, last, bits >> 4, bits & 15, segments[0]):
                continue
            if not first and not interval and _flat_dc(chosen, bits >> 4, segments[0]):
                continue
            _any_scan(chosen, units, (first, last), bits >> 4, bits & 15, segments, interval)
    return width, height, list(parts.values()), quantisers, comments


def _flat_dc(chosen: list, high: int, data: bytes) -> bool:
    """A DC scan of zero bits only, where the bit 0 means no difference (or, in a refinement, a bit 0): nothing
    changes."""
    n = sum(p.coefficients.shape[0] * p.coefficients.shape[1] if len(chosen) > 1 else p.blocks[0] * p.blocks[1] for p, _, _ in chosen)
    plain = high or all(dc.get((1, 0)) == 0 for _, dc, _ in chosen)
    return bool(plain) and len(data) == -(-n // 8) and not data[: n // 8].strip(b"\0") and (n % 8 == 0 or data[-1] >> (8 - n % 8) == 0)


@cache
def _inverse() -> np.ndarray:
    """Zigzag coefficient -> 8 x 8 samples, as a matrix of 64 x 64."""
    places = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    n = np.arange(8)
    basis = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.stack([np.outer(basis[y], basis[x]).reshape(64) for y, x in places]).astype(np.float32)


def rgb_tensor(width: int, height: int, parts: list[_Component], quantisers: dict[int, np.ndarray]) -> np.ndarray:
    """height x width x 3 samples of 8 bits."""
    most_h, most_v = max(p.h for p in parts), max(p.v for p in parts)
    planes = []
    for p in parts:
        rows, columns, _ = p.coefficients.shape
        samples = (p.coefficients.reshape(-1, 64) * quantisers[p.table]) @ _inverse()
        samples += 128
        np.clip(np.rint(samples, samples), 0, 255, samples)
        plane = samples.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
        planes.append(plane.repeat(most_v // p.v, 0).repeat(most_h // p.h, 1)[:height, :width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((height, width, 3), np.uint8)
    for i, plane in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, i] = np.clip(np.rint(plane), 0, 255)
    return out


def payload_of(parts: list[_Component], comments: list[bytes]) -> bytes:
    """The payload of a file written by encode_payload."""
    length = next((int(c.split()[1]) for c in comments if c.startswith(b"payload ")), None)
    if length is None:
        raise ValueError("the file holds no payload")
    values = np.concatenate([p.coefficients[:, :, 1 : IN_BLOCK + 1].reshape(-1) for p in parts])
    return (values + np.where(values < 0, 255, 0)).astype(np.uint8).tobytes()[:length]


# ---------------------------------------------------------------- columns


def encode_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add the text's UTF-8 bytes, padded to a positive multiple of 576, as a progressive JPEG. Other columns stay."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf(T.BinaryType())
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encode_payload(pad(t.encode("utf-8", "surrogatepass"))) for t in texts], dtype=object)

    return df.withColumn(out, stored(text_or_empty(text)))


DECODED = "payload binary, width int, height int, rgb binary, channel_sums array<bigint>"


def decode_media(df: DataFrame, media: str = "media", out: str = "decoded") -> DataFrame:
    """Add a struct of the payload, width, height, the RGB tensor (row by row, three bytes a pixel) and the sum of
    each channel. A null file gives a null struct's fields. Other columns stay."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf(DECODED)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for file in files:
                if file is None:
                    rows.append((None,) * 5)
                    continue
                width, height, parts, quantisers, comments = decode_scans(file)
                rgb = rgb_tensor(width, height, parts, quantisers)
                rows.append((payload_of(parts, comments), width, height, rgb.tobytes(), rgb.sum((0, 1), dtype=np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["payload", "width", "height", "rgb", "channel_sums"])

    return df.withColumn(out, read(F.col(media)))


def op4_media(spark, sf_dir: str) -> DataFrame:
    """The stored form of every document and what is read back from it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = encode_media(docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), "text")).drop("text")
    d = "decoded"
    return decode_media(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length(f"{d}.payload").cast("long").alias("payload_bytes"),
        F.sha2(f"{d}.payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring({d}.payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", f"{d}.width", f"{d}.height"), F.concat_ws(",", F.transform(f"{d}.channel_sums", lambda x: x.cast("string"))), F.lpad(F.hex(F.crc32(f"{d}.rgb")), 8, "0")).alias("feature"),
    )
