"""Media columns: progressive JPEG written from bytes, read back into coefficients and RGB tensors.

A payload is the bytes of a text followed by zero bytes up to a positive multiple of 64. Its unit is the
quantised coefficient: each 64 bytes are one 8 x 8 block in zigzag order, quantised by 1, so nothing is
lost. Blocks fill the Y plane first, then Cb and Cr (4:2:0); missing ones are zero bytes. An AC value is its byte plus
256, and a component's DC values are its bytes plus 768 and plus 0 in turn, so that all AC values, and all DC
differences, have the same number of bits. Scans: DC without its last bit; AC without its last bit, Y in two
spectral bands; then a refinement scan of DC, and one of each component's AC whose end-of-band runs carry whole
bit planes. A comment holds the two lengths.

The reader takes any baseline-precision progressive stream: spectral selection, successive approximation,
end-of-band runs, restart markers, any sampling factors. Scans whose tables leave no choice are read as arrays;
the others bit by bit. The inverse transform is a product with an integer matrix, exact in doubles, so
equal streams give equal tensors on any machine. Chroma is repeated to full resolution.

Null and empty texts are a payload of 64 zero bytes with n_bytes 0. Rows are handled one by one: ids may be null
or repeat, and an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
BANDS = (((1, 5), (6, 63)), ((1, 63),), ((1, 63),))
SWING = 768
SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))  # component, horizontal, vertical
RUN = 32767
BLOCKS = 8192  # blocks transformed at once


def _zigzag() -> np.ndarray:
    """Position in the 8 x 8 block of each coefficient in scan order: along antidiagonals, turning at each end."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _transform() -> np.ndarray:
    """Integer matrix from 64 coefficients in scan order to 64 samples, scaled by 2^16."""
    x, u = np.arange(8), np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1)[:, None] / 2
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.rint(both[ZIGZAG] * 65536)


TRANSFORM = _transform()


# Writing.
def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _table(kind: int, symbols: list[int]) -> bytes:
    """A table in which one symbol has the code 0, or up to three have codes of two bits."""
    sizes = [0] * 16
    sizes[0 if len(symbols) == 1 else 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4, *sizes, *symbols]))


def _scan(components: list[int], ss: int, se: int, ah: int, al: int, bits: np.ndarray) -> bytes:
    head = bytes([len(components), *[x for c in components for x in (c, 0)], ss, se, ah << 4 | al])
    fill = np.ones(-len(bits) % 8, np.uint8)
    return _segment(0xDA, head) + np.packbits(np.concatenate([bits, fill])).tobytes().replace(b"\xff", b"\xff\x00")


def _coded(values: np.ndarray, width: int) -> np.ndarray:
    """The code 0 and ``width`` big-endian bits for each value."""
    return ((values[:, None] >> np.arange(width, -1, -1)) & 1).astype(np.uint8).ravel()


@functools.cache
def _interleaved(wide: int, high: int) -> np.ndarray:
    """Order in which an interleaved scan visits the blocks of all planes, as places in the planes one after another."""
    units = wide * high
    rows, columns = np.divmod(np.arange(units), wide)
    luma = [(2 * rows + dy) * 2 * wide + 2 * columns + dx for dy in (0, 1) for dx in (0, 1)]
    return np.stack([*luma, 4 * units + np.arange(units), 5 * units + np.arange(units)], 1).ravel()


def write(text: bytes) -> bytes:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    data = np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, 64)
    units = -(-len(data) // 6)
    wide = int(np.ceil(np.sqrt(units)))
    high = -(-units // wide)
    units = wide * high
    blocks = np.zeros((6 * units, 64), np.uint8)
    blocks[: len(data)] = data
    out = [b"\xff\xd8", _segment(0xFE, f"{size} {len(text)}".encode()), _segment(0xDB, bytes([0] + [1] * 64))]
    parts = b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in SAMPLING)
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + parts))
    visit = _interleaved(wide, high)
    turn = visit.reshape(-1, 6)
    dc = blocks[:, 0].astype(np.int16)
    for plane in (turn[:, :4].ravel(), turn[:, 4], turn[:, 5]):
        dc[plane[::2]] += SWING
    steps = np.empty(len(dc), np.int16)
    for plane in (turn[:, :4].ravel(), turn[:, 4], turn[:, 5]):
        steps[plane] = np.diff(dc[plane] >> 1, prepend=0)
    steps = steps[visit]
    out += [_table(0, [9]), _scan([1, 2, 3], 0, 0, 0, 1, _coded(np.where(steps > 0, steps, steps + 511), 9))]
    planes = (blocks[: 4 * units], blocks[4 * units : 5 * units], blocks[5 * units :])
    out.append(_table(1, [8]))
    for component, plane in enumerate(planes, 1):
        for ss, se in BANDS[component - 1]:
            bits = np.zeros((len(plane) * (se - ss + 1), 9), np.uint8)
            bits[:, 1:] = np.unpackbits((plane[:, ss : se + 1] >> 1 | 128).reshape(-1, 1), axis=1)
            out.append(_scan([component], ss, se, 0, 1, bits.ravel()))
    out.append(_scan([1, 2, 3], 0, 0, 1, 0, (dc[visit] & 1).astype(np.uint8)))
    for component, plane in enumerate(planes, 1):
        runs = [min(RUN, len(plane) - k) for k in range(0, len(plane), RUN)]
        symbols = sorted({(r.bit_length() - 1) << 4 for r in runs})
        bits = []
        for k, r in enumerate(runs):
            n = r.bit_length() - 1
            code = [0] if len(symbols) == 1 else [symbols.index(n << 4) >> 1, symbols.index(n << 4) & 1]
            extra = [(r >> i) & 1 for i in range(n - 1, -1, -1)]
            bits += [np.array(code + extra, np.uint8), (plane[k * RUN : k * RUN + r, 1:] & 1).ravel()]
        out += [_table(1, symbols), _scan([component], 1, 63, 1, 0, np.concatenate(bits))]
    out.append(b"\xff\xd9")
    return b"".join(out)


# Reading.
class _Codes:
    """A Huffman table: (length, code) to symbol."""

    def __init__(self, sizes: bytes, symbols: bytes):
        self.symbols, self.codes, code, k = list(symbols), {}, 0, 0
        for length, n in enumerate(sizes, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.single = len(self.symbols) == 1 and (1, 0) in self.codes


def _fixed(reader: _Reader, count: int, size: int) -> np.ndarray:
    """``count`` signed numbers of ``size`` bits, each after the one-bit code 0."""
    rows = reader.take(count * (size + 1)).reshape(-1, size + 1)
    if rows[:, 0].any():
        raise ValueError("no such code")
    if size == 8:
        value = np.packbits(rows[:, 1:], axis=1)[:, 0].astype(np.int16)
    else:
        value = rows[:, 1:].astype(np.int16) @ (1 << np.arange(size - 1, -1, -1)).astype(np.int16)
    return value - (rows[:, 1] == 0) * np.int16((1 << size) - 1)


class _Reader:
    """Bits of an entropy-coded part, one at a time or as arrays."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> np.ndarray:
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("the scan ends early")
        return self.bits[self.at - n : self.at]

    def number(self, n: int) -> int:
        value = 0
        for b in self.take(n).tolist():
            value = value * 2 + b
        return value

    def symbol(self, codes: _Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code * 2 + int(self.take(1)[0])
            if (length, code) in codes.codes:
                return codes.codes[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.number(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _dc(reader: _Reader, planes: list, order: list, codes: list, ah: int, al: int) -> None:
    """``order``: (scan component, block) for each block in turn; arrays of both."""
    which, block = order
    if ah:
        bits = reader.take(len(block)).astype(np.int16) << al
        for c in range(len(planes)):
            mine = which == c
            planes[c][block[mine], 0] |= bits[mine]
    elif all(t.single and t.symbols == codes[0].symbols and 0 < t.symbols[0] < 15 for t in codes):
        steps = _fixed(reader, len(block), codes[0].symbols[0])
        for c in range(len(planes)):
            mine = which == c
            planes[c][block[mine], 0] = np.cumsum(steps[mine]) << al
    elif all(t.single and t.symbols == [0] for t in codes):
        reader.take(len(block))
    else:
        last = [0] * len(planes)
        for c, b in zip(which.tolist(), block.tolist(), strict=True):
            last[c] += reader.signed(reader.symbol(codes[c]))
            planes[c][b, 0] = last[c] << al


def _part(plane: np.ndarray, blocks: np.ndarray, at: int = 0, run: int | None = None):
    """Blocks at to at + run of a scan: a slice where the scan visits the whole plane in order."""
    run = len(blocks) - at if run is None else run
    return slice(at, at + run) if len(blocks) == len(plane) else blocks[at : at + run]


def _ac_first(reader: _Reader, plane: np.ndarray, blocks: np.ndarray, codes: _Codes, ss: int, se: int, al: int) -> None:
    if codes.single and 0 < codes.symbols[0] < 15:
        value = _fixed(reader, len(blocks) * (se - ss + 1), codes.symbols[0])
        plane[_part(plane, blocks), ss : se + 1] = (value << al).reshape(len(blocks), -1)
        return
    run = 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            zeros, size = divmod(reader.symbol(codes), 16)
            if size:
                k += zeros
                plane[b, k] = reader.signed(size) * (1 << al)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + (reader.number(zeros) if zeros else 0) - 1
                break


def _ac_refine(reader: _Reader, plane: np.ndarray, blocks: np.ndarray, codes: _Codes, ss: int, se: int, al: int) -> None:
    one, at = 1 << al, 0
    if all(s % 16 == 0 and s < 0xF0 for s in codes.symbols):
        while at < len(blocks):
            n = reader.symbol(codes) >> 4
            run = (1 << n) + (reader.number(n) if n else 0)
            here = _part(plane, blocks, at, run)
            band = plane[here, ss : se + 1]
            if (band > 0).all():
                plane[here, ss : se + 1] = band + (reader.take(band.size).reshape(band.shape).astype(np.int16) << al)
            else:
                added = np.zeros(band.shape, np.int16)
                added[band != 0] = reader.take(int((band != 0).sum()))
                plane[here, ss : se + 1] = band + added * np.sign(band) * np.int16(one)
            at += run
        return
    run = 0
    for b in blocks.tolist():
        row, k = plane[b], ss

        def correct(k: int) -> None:
            if reader.number(1):
                row[k] += one if row[k] > 0 else -one

        while k <= se and not run:
            zeros, size = divmod(reader.symbol(codes), 16)
            if not size and zeros < 15:
                run = (1 << zeros) + (reader.number(zeros) if zeros else 0)
                break
            new = (one if reader.number(1) else -one) if size else 0
            while k <= se:
                if row[k]:
                    correct(k)
                elif not zeros:
                    break
                else:
                    zeros -= 1
                k += 1
            if new and k <= se:
                row[k] = new
            k += 1
        if run:
            for j in range(k, se + 1):
                if row[j]:
                    correct(j)
            run -= 1


@functools.lru_cache(512)
def _order(size: tuple, units: tuple, most: tuple, sampling: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(scan component, block) of a scan's blocks in turn; one row for each unit between which a restart may stand."""
    wide, high = units
    if len(sampling) == 1:
        h, v = sampling[0]
        across = -(-(-(-size[0] * h // most[0])) // 8)
        down = -(-(-(-size[1] * v // most[1])) // 8)
        block = (np.arange(down)[:, None] * wide * h + np.arange(across)).reshape(-1, 1)
        return np.zeros(block.shape, int), block
    row, column = np.divmod(np.arange(wide * high), wide)
    which, block = [], []
    for i, (h, v) in enumerate(sampling):
        for dy in range(v):
            for dx in range(h):
                which.append(np.full(wide * high, i))
                block.append((v * row + dy) * wide * h + h * column + dx)
    return np.stack(which, 1), np.stack(block, 1)


class Picture:
    """Coefficient planes of a progressive stream, accumulated over its scans."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        full = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[full + 1]
        stops = full[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
        self.comment, self.quant, self.planes, tables, restart, at = b"", {}, [], {}, 0, 2
        while data[at + 1] != 0xD9:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = _Codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                end = int(stops[np.searchsorted(stops, at)])
                self._scan(body, data[at:end], tables, restart)
                at = end

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.most = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.units = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        self.planes = [np.zeros((self.units[0] * h * self.units[1] * v, 64), np.int16) for _, h, v, _ in self.parts]

    def _scan(self, body: bytes, data: bytes, tables: dict, restart: int) -> None:
        n = body[0]
        names = [p[0] for p in self.parts]
        chosen = [names.index(body[1 + 2 * i]) for i in range(n)]
        ss, se, ah, al = *body[1 + 2 * n : 3 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        which, block = _order((self.width, self.height), self.units, self.most, tuple(self.parts[c][1:3] for c in chosen))
        step = restart or len(block)
        parts = _between_restarts(data) if restart else [data]
        for k, part in zip(range(0, len(block), step), parts, strict=True):
            reader = _Reader(part.replace(b"\xff\x00", b"\xff"))
            turn = which[k : k + step].ravel(), block[k : k + step].ravel()
            if ss == 0:
                _dc(reader, [self.planes[c] for c in chosen], turn, [tables.get(body[2 + 2 * i] >> 4) for i in range(n)], ah, al)
            else:
                (_ac_refine if ah else _ac_first)(reader, self.planes[chosen[0]], turn[1], tables[0x10 | body[2] & 15], ss, se, al)

    def rgb(self) -> np.ndarray:
        """(height, width, 3) bytes at full resolution."""
        wide, high = self.units
        full = []
        for (_, h, v, q), plane in zip(self.parts, self.planes, strict=True):
            samples = np.empty((len(plane), 64), np.uint8)
            for k in range(0, len(plane), BLOCKS):
                exact = (plane[k : k + BLOCKS] * self.quant[q]).astype(float) @ TRANSFORM
                exact += 32768 + 128 * 65536
                exact /= 65536
                samples[k : k + BLOCKS] = np.clip(np.floor(exact, out=exact), 0, 255, out=exact)
            full.append(samples.reshape(high * v, wide * h, 8, 8).swapaxes(1, 2).reshape(high * v * 8, wide * h * 8))

        def spread(image: np.ndarray, h: int, v: int) -> np.ndarray:
            return image.repeat(self.most[1] // v, 0).repeat(self.most[0] // h, 1)[: self.height, : self.width]

        light = spread(full[0], *self.parts[0][1:3])
        if len(full) == 1:
            return np.repeat(light[:, :, None], 3, 2)
        if self.parts[1][1:3] != self.parts[2][1:3]:
            full[1:] = [spread(image, *part[1:3]) for image, part in zip(full[1:], self.parts[1:], strict=True)]
            chroma = self.most
        else:
            chroma = self.parts[1][1:3]
        cb, cr = full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        # Factors of the standard conversion, times 2^16 (fixed values): 1.402, 0.344136, 0.714136, 1.772.
        for i, added in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
            step = spread(((added + 32768) >> 16).astype(np.int16), *chroma)
            out[:, :, i] = np.clip(step + light, 0, 255)
        return out


def _between_restarts(data: bytes) -> list[bytes]:
    out, start = [], 0
    raw = np.frombuffer(data, np.uint8)
    for at in np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist():
        out.append(data[start:at])
        start = at + 2
    return [*out, data[start:]]


def payload(picture: Picture) -> tuple[bytes, int]:
    """(payload, n_bytes) of a stream made by ``write``."""
    size, n = map(int, picture.comment.split())
    # 256 and 768 are multiples of 256: the byte is what is left of each value.
    return np.concatenate(picture.planes)[: size // UNIT].astype(np.uint8).tobytes(), n


# Columns.
def media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text as a progressive stream."""
    def store(batches):
        for batch in batches:
            made = [write(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(store, "doc_id long, media binary")


def tensors(stored: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb): full-resolution tensors, height x width x 3 bytes."""
    def read(batches):
        for batch in batches:
            for doc, data in zip(batch.column("doc_id"), batch.column("media").to_pylist(), strict=True):
                image = Picture(data).rgb()
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([image.tobytes()], pa.binary())], ["doc_id", "height", "width", "rgb"])

    return stored.select("doc_id", "media").mapInArrow(read, "doc_id long, height int, width int, rgb binary")


def digests(stored: DataFrame) -> DataFrame:
    """What the stored streams hold, from their bytes alone; ``feature``: size and channel sums of the tensor."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches):
        for batch in batches:
            out = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                picture = Picture(data)
                image = picture.rgb()
                found, n = payload(picture)
                sums = image.reshape(-1, 3).sum(0, dtype=np.int64).tolist()
                out.append((doc, n, len(found), hashlib.sha256(found).hexdigest(), zlib.crc32(found[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), f"{image.shape[0]}x{image.shape[1]}:{':'.join(map(str, sums))}"))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "media").mapInArrow(read, schema)


def query(spark, folder: str) -> DataFrame:
    return digests(media(spark.read.parquet(f"{folder}/documents.parquet")))
