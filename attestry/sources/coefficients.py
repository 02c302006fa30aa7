"""Quantised coefficients of baseline JPEGs, and the comb that a second compression leaves in their histograms."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .embedded import segments

# What is decoded at most, and the histogram's measures.
MOST_BLOCKS, LEAST_BLOCKS, HALF, POSITIONS, LEAST, REACH, CANDIDATES = 8_000_000, 1_024, 64, (1, 2, 3, 4, 5, 6), 30, 3, 6
THRESHOLD = 0.3


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each 16-bit prefix, the length of the code it begins with (0: none) and its symbol."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            if code >= 1 << bits or at >= len(symbols):
                raise ValueError("a Huffman table is broken")
            part = slice(code << 16 - bits, code + 1 << 16 - bits)
            length[part], symbol[part] = bits, symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return length.tolist(), symbol.tolist()


class _Bits:
    """The bits of one restart interval, without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            more = self.data[self.at : self.at + 4].ljust(4, b"\xff") if self.at < len(self.data) + 8 else None
            if more is None:
                raise EOFError
            self.held, self.n, self.at = (self.held & (1 << self.n) - 1) << 32 | int.from_bytes(more, "big"), self.n + 32, self.at + 4

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        self.need(16)
        head = self.held >> self.n - 16 & 0xFFFF
        bits = table[0][head]
        if not bits:
            raise EOFError
        self.n -= bits
        return table[1][head]

    def value(self, bits: int) -> int:
        """A signed number of so many bits."""
        if not bits:
            return 0
        self.need(bits)
        self.n -= bits
        v = self.held >> self.n & (1 << bits) - 1
        return v if v >> bits - 1 else v - (1 << bits) + 1


def _block(bits: _Bits, dc: tuple, ac: tuple, before: int, out: np.ndarray) -> int:
    """One block in zigzag order; returns its DC value."""
    out[0] = before = before + bits.value(bits.symbol(dc) & 15)
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        if s & 15:
            k += s >> 4
            if k > 63:
                raise EOFError
            out[k] = bits.value(s & 15)
            k += 1
        elif s == 0xF0:
            k += 16
        else:
            break
    return before


def _scan(b: bytes, at: int, parts: list, tables: dict, restart: int, frame: dict) -> None:
    """Fill the blocks of one scan; a broken one ends early, and the rest stay zero."""
    stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(b, at)
    raw = b[at : stop.start() if stop else len(b)]
    runs = [r.replace(b"\xff\x00", b"\xff") for r in re.split(rb"\xff+[\xd0-\xd7]", raw)]
    single = len(parts) == 1
    wide, high = frame["wide"], frame["high"]
    order = []  # (component, its tables, blocks of a unit)
    for c, dc, ac in parts:
        order.append((c, tables[0, dc], tables[1, ac], 1 if single else c["h"], 1 if single else c["v"]))
    across, down = (order[0][0]["across"], order[0][0]["down"]) if single else (wide, high)
    before, bits, unit = [0] * len(order), None, 0
    try:
        for y in range(down):
            for x in range(across):
                if bits is None or restart and unit % restart == 0:
                    i = unit // restart if restart else 0
                    if i >= len(runs):
                        return
                    bits, before = _Bits(runs[i]), [0] * len(order)
                unit += 1
                for n, (c, dc, ac, h, v) in enumerate(order):
                    for j in range(v):
                        for k in range(h):
                            before[n] = _block(bits, dc, ac, before[n], c["blocks"][y * v + j, x * h + k])
    except (EOFError, OverflowError):
        return


def decode(b: bytes) -> list[np.ndarray]:
    """Per component its blocks (n x 64, zigzag order, only those of the image); ValueError for what isn't an 8-bit sequential Huffman JPEG."""
    tables: dict = {}
    frame: dict | None = None
    restart, end = 0, 2
    for kind, at, data in segments(b):
        end = at + len(data)
        if kind == 0xC4:
            while len(data) >= 17:
                n = sum(data[1:17])
                tables[data[0] >> 4, data[0] & 15] = _lookup(data[1:17], data[17 : 17 + n])
                data = data[17 + n :]
        elif kind == 0xDD and len(data) >= 2:
            restart = int.from_bytes(data[:2], "big")
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            if kind > 0xC1:
                raise ValueError("not sequential Huffman coding")
            frame = _frame(data)
    if frame is None:
        raise ValueError("no frame")
    while end + 4 <= len(b):
        while end < len(b) and b[end] == 0xFF:
            end += 1
        kind = b[end] if end < len(b) else 0xD9
        size = int.from_bytes(b[end + 1 : end + 3], "big")
        data, end = b[end + 3 : end + 1 + size], end + 1 + size
        if kind == 0xC4:
            while len(data) >= 17:
                n = sum(data[1:17])
                tables[data[0] >> 4, data[0] & 15] = _lookup(data[1:17], data[17 : 17 + n])
                data = data[17 + n :]
        elif kind == 0xDD and len(data) >= 2:
            restart = int.from_bytes(data[:2], "big")
        elif kind == 0xDA:
            n = data[0] if data else 0
            chosen = [(data[1 + 2 * i], data[2 + 2 * i] >> 4, data[2 + 2 * i] & 15) for i in range(n) if 2 + 2 * i < len(data)]
            parts = [(c, dc, ac) for i, dc, ac in chosen for c in frame["components"] if c["id"] == i]
            if not parts or any((0, dc) not in tables or (1, ac) not in tables for _, dc, ac in parts):
                raise ValueError("a scan without tables")
            _scan(b, end, parts, tables, restart, frame)
            m = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(b, end)
            if not m:
                break
            end = m.start()
        elif kind == 0xD9 or size < 2:
            break
        if end >= len(b) or b[end] != 0xFF:
            break
    return [c["blocks"][: c["down"], : c["across"]].reshape(-1, 64) for c in frame["components"]]


def _frame(data: bytes) -> dict:
    if len(data) < 6 or len(data) < 6 + 3 * data[5] or not data[5]:
        raise ValueError("a frame header ends early")
    if data[0] != 8:
        raise ValueError("not 8 bits")
    height, width = int.from_bytes(data[1:3], "big"), int.from_bytes(data[3:5], "big")
    own = [{"id": data[i], "h": data[i + 1] >> 4, "v": data[i + 1] & 15} for i in range(6, 6 + 3 * data[5], 3)]
    if not height or not width or any(not 1 <= c[k] <= 4 for c in own for k in "hv"):
        raise ValueError("a frame of no size")
    most_h, most_v = max(c["h"] for c in own), max(c["v"] for c in own)
    wide, high = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    if sum(wide * high * c["h"] * c["v"] for c in own) > MOST_BLOCKS:
        raise ValueError("too many blocks")
    for c in own:
        c["across"], c["down"] = -(-(-(-width * c["h"] // most_h)) // 8), -(-(-(-height * c["v"] // most_v)) // 8)
        c["blocks"] = np.zeros((high * c["v"], wide * c["h"], 64), np.int32)
    return {"components": own, "wide": wide, "high": high}


def comb(blocks: np.ndarray) -> tuple[float, int]:
    """(score, blocks): the mean of the three largest shares of gaps and spikes among the bins of a position."""
    found = []
    for p in POSITIONS:
        v = blocks[:, p]
        bins = np.bincount(v[np.abs(v) <= HALF] + HALF, minlength=2 * HALF + 1)
        candidates = odd = 0
        for side in (bins[HALF:], bins[HALF::-1]):
            padded = np.concatenate((side, np.zeros(REACH, side.dtype)))
            k = np.arange(1, len(side) - 1)
            outer = np.max([padded[k + r] for r in range(1, REACH + 1)], axis=0)
            inner = side[k - 1]
            candidates += int((outer >= LEAST).sum())
            odd += int(((outer >= LEAST) & (side[k] < 0.25 * outer)).sum() + ((k >= 2) & (inner >= LEAST) & (side[k] > 2.5 * inner)).sum())
        if candidates >= CANDIDATES:
            found.append(odd / candidates)
    best = sorted(found, reverse=True)[:3]
    return (sum(best) / len(best) if best else 0.0), len(blocks)


def double_compression(content: Column, threshold: float = THRESHOLD) -> Column:
    """struct<status, score, blocks, error>: a comb in the first component is present, none absent; what can't be decoded or is too small is inconclusive."""

    def one(b: bytes | None) -> tuple:
        try:
            own = decode(b or b"")
        except ValueError as e:
            return "inconclusive", None, None, str(e)
        if len(own[0]) < LEAST_BLOCKS:
            return "inconclusive", None, len(own[0]), "too small"
        score, n = comb(own[0])
        return ("present" if score >= threshold else "absent"), score, n, None

    @F.pandas_udf("status string, score double, blocks int, error string")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in contents], columns=["status", "score", "blocks", "error"], dtype=object)

    return run(content)
