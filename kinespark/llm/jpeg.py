"""A vectorised baseline JPEG coder for frames whose 8 x 8 blocks are flat.

Each byte of a payload is the sample value of one block: with a quantiser of 8 the DC
coefficient is exactly the sample less 128, so any baseline decoder gives back 64 equal
samples of that value, and nothing is lost. Frames are grey, one restart interval per row
of blocks. Restart intervals start on a byte and with a fresh predictor, so all of them,
over all frames of a batch, are coded and decoded side by side, one block a step.
``luma`` reads any other baseline frame, one symbol after another.
"""

from __future__ import annotations

import re

import numpy as np

SIDE = 32  # blocks
FRAME_BYTES = SIDE * SIDE
_DC_BITS = (0, 1, 4, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)  # codes by length, 1 to 16
_DC_VALUES = (5, 4, 6, 3, 0, 7, 2, 1, 8)


def _codes(bits: tuple[int, ...], values: tuple[int, ...]) -> tuple[dict[int, tuple[int, int]], np.ndarray, np.ndarray]:
    """Canonical Huffman codes: {value: (code, length)}, and value and length by the next 16 bits."""
    table, value_of, length_of = {}, np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    code = k = 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            table[values[k]] = (code, length)
            lo = code << (16 - length)
            value_of[lo : lo + (1 << (16 - length))], length_of[lo : lo + (1 << (16 - length))] = values[k], length
            code, k = code + 1, k + 1
        code <<= 1
    return table, value_of, length_of


_TABLE, _, _ = _codes(_DC_BITS, _DC_VALUES)
_EOB_BITS = 1  # the only AC code: end of block, a single 0


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


HEADER = (
    b"\xff\xd8"
    + _segment(0xE0, b"AVI1\0\0\0\0\0\0\0\0\0\0")
    + _segment(0xDB, b"\0" + bytes([8]) + b"\1" * 63)
    + _segment(0xC0, b"\x08" + (8 * SIDE).to_bytes(2, "big") * 2 + b"\x01\x01\x11\x00")
    + _segment(0xC4, b"\x00" + bytes(_DC_BITS) + bytes(_DC_VALUES))
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    + _segment(0xDD, SIDE.to_bytes(2, "big"))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a block by its difference + 255: DC code, extra bits, end of block."""
    bits, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = _TABLE[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], length[d + 255] = ((code << size) | extra) << _EOB_BITS, n + size + _EOB_BITS
    return bits, length


_BITS, _LENGTH = _symbols()


def encode(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG files of frames (n, FRAME_BYTES), one after another, and the offset of each."""
    lanes = samples.reshape(-1, SIDE).astype(np.int32)
    n = len(lanes)
    delta = lanes - 128
    delta[:, 1:] = lanes[:, 1:] - lanes[:, :-1]
    delta += 255
    bits, length = _BITS[delta], _LENGTH[delta]
    total = length.sum(axis=1)
    size = -(-total // 8)
    # the bits of each interval, padded with ones, then its restart marker (0xFFD0 to 0xFFD7; end of image after the last)
    first = np.r_[0, np.cumsum(size)]
    at = np.cumsum(length, axis=1) - length + 8 * first[:-1, None]
    byte, off = (at >> 3).ravel(), (at & 7).ravel()
    word = (bits.ravel() << (32 - off - length.ravel()).astype(np.uint64)).astype(np.uint64)
    out = np.zeros(int(first[-1]) + 4, dtype=np.float64)
    for k in range(4):
        out += np.bincount(byte + k, weights=((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=len(out))[: len(out)]
    data = out[: int(first[-1])].astype(np.uint8)
    data[first[1:] - 1] |= ((1 << (8 * size - total)) - 1).astype(np.uint8)
    # stuffing: a zero after each 0xFF
    full = data == 0xFF
    row = np.repeat(np.arange(n), size)
    stuffed = size + np.bincount(row[full], minlength=n)
    in_frame = np.arange(n) % SIDE
    head = np.where(in_frame == 0, len(HEADER), 0)
    start = np.r_[0, np.cumsum(head + stuffed + 2)]
    result = np.zeros(int(start[-1]), dtype=np.uint8)
    body = start[:-1] + head
    before = np.cumsum(full) - full
    spot = body[row] + (np.arange(len(data)) - first[:-1][row]) + (before - before[first[:-1]][row])
    result[spot] = data
    end = start[1:] - 2
    result[end] = 0xFF
    result[end + 1] = np.where(in_frame == SIDE - 1, 0xD9, 0xD0 + in_frame % 8)
    tops = start[:-1][in_frame == 0]
    result[tops[:, None] + np.arange(len(HEADER))] = np.frombuffer(HEADER, np.uint8)
    return result, np.r_[tops, start[-1]]


class JpegError(ValueError):
    """The bytes aren't a grey baseline JPEG with flat blocks."""


def _parse(head: bytes) -> tuple[tuple, int, int, int, int]:
    """Tables and shape from the segments up to the scan: DC code, first quantiser, blocks a row, rows, restart interval, header length."""
    if head[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    i, quant, dc, ac, width, height, every = 2, {}, {}, {}, 0, 0, 0
    while True:
        if head[i : i + 1] != b"\xff":
            raise JpegError("no marker")
        marker, n = head[i + 1], int.from_bytes(head[i + 2 : i + 4], "big")
        body = head[i + 4 : i + 2 + n]
        i += 2 + n
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise JpegError("16-bit quantisers")
                quant[body[0]], body = body[1], body[65:]
        elif marker == 0xC4:
            while body:
                bits = tuple(body[1:17])
                k = 17 + sum(bits)
                (ac if body[0] >> 4 else dc)[body[0] & 15] = (bits, tuple(body[17:k]))
                body = body[k:]
        elif marker == 0xC0:
            if body[0] != 8 or body[5] != 1:
                raise JpegError("not 8-bit grey")
            height, width, q = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[8]
        elif marker == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            d, a = body[2] >> 4, body[2] & 15
            break
        elif 0xC1 <= marker <= 0xCF:
            raise JpegError("not a baseline frame")
    if ac[a] != ((1,) + (0,) * 15, (0,)):
        raise JpegError("blocks aren't flat")
    return dc[d], quant[q], -(-width // 8), -(-height // 8), every, i


_PARSED: dict[bytes, tuple] = {}


def decode(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sample of each block, (frame, block), of the JPEG files ``data[starts[i]:ends[i]]`` that share one header."""
    if not len(starts):
        return np.zeros((0, FRAME_BYTES), np.uint8)
    scan = data[starts[0] : ends[0]].tobytes()
    head = scan[: scan.index(b"\xff\xda") + 10]
    if head not in _PARSED:
        if len(_PARSED) > 64:
            _PARSED.clear()
        code, quant, wide, high, every, size = _parse(head)
        _, value_of, length_of = _codes(*code)
        _PARSED[head] = (value_of, length_of, quant, wide, high, every or wide * high, size)
    value_of, length_of, quant, wide, high, every, size = _PARSED[head]
    if (data[starts[:, None] + np.arange(size)] != np.frombuffer(head, np.uint8)).any():
        raise JpegError("frames differ in their headers")
    # all scans, each split at its restart markers, with the stuffed zeros taken out
    length = ends - starts - size
    frame = np.repeat(np.arange(len(starts)), length)
    src = np.arange(len(frame)) - np.r_[0, np.cumsum(length)][:-1][frame] + (starts + size)[frame]
    raw = data[src]
    after = np.r_[raw[1:], np.uint8(0)]
    prior = np.r_[np.uint8(0), raw[:-1]]
    mark = (raw == 0xFF) & (after >= 0xD0) & (after <= 0xD9)
    gone = mark | ((prior == 0xFF) & ((raw == 0) | ((raw >= 0xD0) & (raw <= 0xD9))))
    stay = ~gone
    lane_end = np.cumsum(stay)[mark] if mark.any() else np.zeros(0, np.int64)
    kept = np.r_[raw[stay], np.zeros(8, np.uint8)].astype(np.uint64)
    lanes = -(-(wide * high) // every)
    if len(lane_end) != lanes * len(starts):
        raise JpegError(f"{len(lane_end)} intervals for {len(starts)} frames of {lanes}")
    at = np.r_[0, lane_end[:-1]] * 8
    out = np.zeros((len(at), every), dtype=np.int64)
    # 32 bits from each byte on, so a step reads one word a lane
    word = (kept[:-4] << np.uint64(32)) | (kept[1:-3] << np.uint64(24)) | (kept[2:-2] << np.uint64(16)) | (kept[3:-1] << np.uint64(8)) | kept[4:]
    value = np.zeros(len(at), dtype=np.int64)
    for k in range(every):
        w = word[at >> 3] << (np.uint64(24) + (at & 7).astype(np.uint64))
        top = (w >> np.uint64(48)).astype(np.int64)
        size_ = value_of[top]
        n = length_of[top]
        extra = (((w << n.astype(np.uint64)) >> np.uint64(1)) >> (np.uint64(63) - size_.astype(np.uint64))).astype(np.int64)
        value += np.where(extra < (np.int64(1) << size_) >> 1, extra - (np.int64(1) << size_) + 1, extra)
        out[:, k] = value
        at = np.minimum(at + n + size_ + 1, 8 * len(word) - 1)
    samples = np.clip(np.round(out * quant / 8) + 128, 0, 255).astype(np.uint8)
    return samples.reshape(len(starts), -1)[:, : wide * high]


# -- any baseline frame, one symbol after another ---------------------------------------

_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _spans(*pairs: tuple[int, int]) -> list[int]:
    return [x for a, b in pairs for x in range(a, b + 1)]


_NINE = tuple((16 * r + 3, 16 * r + 10) for r in range(4, 8))
#: The tables that motion-JPEG frames without tables of their own mean, by (class, number).
_STANDARD = {
    (0, 0): ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))),
    (0, 1): ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12))),
    (1, 0): (
        (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
        tuple(bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a"))
        + tuple(_spans((0x34, 0x3A), *_NINE, (0x83, 0x8A), *((16 * r + 2, 16 * r + 10) for r in range(9, 14)), (0xE1, 0xEA), (0xF1, 0xFA))),
    ),
    (1, 1): (
        (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
        tuple(bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a".replace(" ", "")))
        + tuple(_spans((0x35, 0x3A), *_NINE, *((16 * r + 2, 16 * r + 10) for r in range(8, 16)))),
    ),
}
_BASIS = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Reader:
    """Bits of one restart interval, stuffing taken out."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, 0

    def peek(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 4], "big") >> (16 - (self.at & 7))) & 0xFFFF

    def symbol(self, table: tuple[np.ndarray, np.ndarray]) -> int:
        if self.at > 8 * len(self.data):
            raise JpegError("the scan ends early")
        k = self.peek()
        n = int(table[1][k])
        if not n:
            raise JpegError("no such code")
        self.at += n
        return int(table[0][k])

    def extra(self, size: int) -> int:
        if not size:
            return 0
        v = self.peek() >> (16 - size)
        self.at += size
        return v if v >> (size - 1) else v - (1 << size) + 1


def luma(data: bytes) -> np.ndarray:
    """The first component, (height, width) in samples, of any 8-bit baseline JPEG: grey or colour, any sampling, with or without Huffman tables and restarts."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    i, quant, parts, every = 2, {}, [], 0
    tables = {k: _codes(*v)[1:] for k, v in _STANDARD.items()}
    width = height = 0
    coefficients: np.ndarray | None = None
    while i + 4 <= len(data):
        if data[i] != 0xFF:
            raise JpegError("no marker")
        marker = data[i + 1]
        if marker == 0xFF:
            i += 1
            continue
        if marker == 0xD9:
            break
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        body, i = data[i + 4 : i + 2 + n], i + 2 + n
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15], body = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64), body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                bits = tuple(body[1:17])
                k = 17 + sum(bits)
                tables[body[0] >> 4, body[0] & 15] = _codes(bits, tuple(body[17:k]))[1:]
                body = body[k:]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise JpegError("not 8 bits")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise JpegError("not a baseline frame")
        elif marker == 0xDD:
            every = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if not parts:
                raise JpegError("a scan before its frame")
            end = i
            while not (data[end] == 0xFF and data[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
                if end + 1 >= len(data):
                    raise JpegError("the scan ends early")
            asked = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            got = _scan(data[i:end], asked, parts, tables, every, width, height)
            coefficients = got if got is not None else coefficients
            i = end
    if coefficients is None:
        raise JpegError("no scan of the first component")
    _, h, v, q = parts[0]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    blocks = np.zeros((*coefficients.shape[:2], 64))
    blocks[..., _ZIGZAG] = coefficients * quant[q]
    pixels = np.einsum("ux,rcuv,vy->rxcy", _BASIS, blocks.reshape(*coefficients.shape[:2], 8, 8), _BASIS)
    plane = pixels.reshape(pixels.shape[0] * 8, -1)[: -(-height * v // most_v), : -(-width * h // most_h)]
    return np.clip(np.round(plane) + 128, 0, 255).astype(np.uint8)


def _scan(raw: bytes, asked: list[tuple], parts: list[tuple], tables: dict, every: int, width: int, height: int) -> np.ndarray | None:
    """Coefficients (block row, block column, 64 in zigzag order) of the first component, if the scan has it."""
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    by_id = {p[0]: p for p in parts}
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    alone = len(asked) == 1
    if alone:  # a scan of one component runs over its own blocks
        _, h, v, _ = by_id[asked[0][0]]
        across, down = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
    main = parts[0]
    mine = [a for a in asked if a[0] == main[0]]
    out = np.zeros((down * (1 if alone else main[2]), across * (1 if alone else main[1]), 64), dtype=np.int64)
    pieces = re.split(b"\xff[\xd0-\xd7]", raw)
    total = across * down
    for k, piece in enumerate(pieces):
        bits, last = _Reader(piece), dict.fromkeys(by_id, 0)
        for unit in range(k * every, min(total, (k + 1) * every) if every else total):
            for who, dc, ac in asked:
                _, h, v, _ = by_id[who]
                for y in range(1 if alone else v):
                    for x in range(1 if alone else h):
                        last[who] += bits.extra(bits.symbol(tables[0, dc]))
                        at, values = 1, {0: last[who]}
                        while at < 64:
                            s = bits.symbol(tables[1, ac])
                            run, size = s >> 4, s & 15
                            if not size and run != 15:
                                break
                            at += run
                            if size:
                                values[at] = bits.extra(size)
                            at += 1
                        if who == main[0]:
                            row, col = unit // across * (1 if alone else v) + y, unit % across * (1 if alone else h) + x
                            for z, value in values.items():
                                if z > 63:
                                    raise JpegError("a block runs over")
                                out[row, col, z] = value
    return out if mine else None
