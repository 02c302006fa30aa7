"""HEIF files: boxes, items, their places, and the XMP packets among them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .embedded import MOST_XMP, decoded

# The box of a manifest store, and limits on what is read.
MANIFEST = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")
MOST_BOXES, MOST_ITEMS, MOST_EXTENTS = 4_096, 4_096, 1_024


def boxes(b: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, where its content begins, where it ends) of the boxes between two places; ValueError for a broken one."""
    end, n = len(b) if end is None else end, 0
    while at < end:
        if at + 8 > end or n == MOST_BOXES:
            raise ValueError("a box's header ends early" if n < MOST_BOXES else "too many boxes")
        size, kind = struct.unpack_from(">I4s", b, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box's header ends early")
            (size,), head = struct.unpack_from(">Q", b, at + 8), 16
        stop = end if size == 0 else at + size
        if stop > end or stop < at + head:
            raise ValueError("a box's length is wrong")
        yield kind, at + head, stop
        at, n = stop, n + 1


class _Reader:
    def __init__(self, b: bytes, at: int, end: int):
        self.b, self.at, self.end = b, at, end

    def number(self, size: int) -> int:
        if self.at + size > self.end:
            raise ValueError("a box ends early")
        self.at += size
        return int.from_bytes(self.b[self.at - size : self.at], "big")

    def version(self) -> int:
        return self.number(4) >> 24

    def text(self) -> str:
        """Up to the next zero byte, or the end."""
        stop = self.b.find(b"\0", self.at, self.end)
        stop = self.end if stop < 0 else stop
        out, self.at = self.b[self.at : stop].decode("utf-8", "replace"), min(stop + 1, self.end)
        return out

    def kind(self) -> str:
        return self.number(4).to_bytes(4, "big").decode("latin-1")


def _items(b: bytes, at: int, end: int) -> list[dict]:
    r = _Reader(b, at, end)
    n = r.number(2 if r.version() == 0 else 4)
    if n > MOST_ITEMS:
        raise ValueError("too many items")
    out = []
    for kind, begin, stop in boxes(b, r.at, end):
        if kind != b"infe":
            continue
        e = _Reader(b, begin, stop)
        v = e.version()
        number = e.number(4 if v == 3 else 2)
        e.number(2)
        what = e.kind() if v >= 2 else ""
        name = e.text()
        content = e.text() if what == "mime" or v < 2 else None
        out.append({"id": number, "kind": what, "name": name, "content_type": content or None})
    return out[:MOST_ITEMS]


def _places(b: bytes, at: int, end: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per item its extents (method, offset, length)."""
    r = _Reader(b, at, end)
    v = r.version()
    if v > 2:
        raise ValueError(f"places of version {v}")
    sizes = r.number(2)
    offset, length, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if v else 0
    n = r.number(4 if v == 2 else 2)
    if n > MOST_ITEMS:
        raise ValueError("too many items")
    out: dict[int, list[tuple[int, int, int]]] = {}
    for _ in range(n):
        item = r.number(4 if v == 2 else 2)
        method = r.number(2) & 15 if v else 0
        r.number(2)
        begin, count = r.number(base), r.number(2)
        if count > MOST_EXTENTS:
            raise ValueError("too many extents")
        own = []
        for _ in range(count):
            r.number(index)
            own.append((method, begin + r.number(offset), r.number(length)))
        out.setdefault(item, own)
    return out


def _content(extents: list[tuple[int, int, int]], b: bytes, inner: bytes | None) -> bytes:
    parts, total = [], 0
    for method, begin, length in extents:
        if method not in (0, 1) or method == 1 and inner is None:
            raise ValueError(f"method {method} can't be read")
        source = b if method == 0 else inner
        stop = begin + length if length else len(source)
        if begin > stop or stop > len(source):
            raise ValueError("an extent lies outside its source")
        total += stop - begin
        if total > MOST_XMP:
            raise ValueError("the item is too large")
        parts.append(source[begin:stop])
    if not parts:
        raise ValueError("no extents")
    return b"".join(parts)


def structure(b: bytes) -> dict:
    """brand, items, primary item, handler, XMP texts, unreadable XMP items, and whether a manifest store is there; ValueError for what is no such file."""
    top = list(boxes(b))
    if not top or top[0][0] != b"ftyp" or top[0][2] - top[0][1] < 8:
        raise ValueError("no ftyp box first")
    begin, stop = top[0][1:]
    out: dict = {"brand": b[begin : begin + 4].decode("latin-1"), "brands": [b[i : i + 4].decode("latin-1") for i in range(begin + 8, stop - 3, 4)], "items": [], "primary": None, "handler": None, "xmp": [], "unreadable": []}
    out["manifest"] = any(k == b"uuid" and b[x : x + 16] == MANIFEST for k, x, _ in top)
    places, inner = {}, None
    meta = next(((x, y) for k, x, y in top if k == b"meta"), None)
    for kind, x, y in boxes(b, meta[0] + 4, meta[1]) if meta and meta[1] - meta[0] >= 4 else ():
        r = _Reader(b, x, y)
        if kind == b"hdlr":
            r.number(8)
            out["handler"] = r.kind()
        elif kind == b"pitm":
            out["primary"] = r.number(2 if r.version() == 0 else 4)
        elif kind == b"iinf":
            out["items"] = _items(b, x, y)
        elif kind == b"iloc":
            places = _places(b, x, y)
        elif kind == b"idat":
            inner = b[x:y]
    for item in out["items"]:
        if item["kind"] == "mime" and (item["content_type"] or "").lower() == "application/rdf+xml":
            try:
                if item["id"] not in places:
                    raise ValueError("it has no place")
                out["xmp"].append(decoded(_content(places[item["id"]], b, inner)))
            except ValueError as e:
                out["unreadable"].append(f"item {item['id']}: {e}")
    return out


HEIF = "error string, brand string, handler string, primary long, n_items int, kinds array<string>, xmp array<string>, unreadable array<string>, manifest boolean"


def heif(content: Column) -> Column:
    """struct (HEIF) of a file's bytes; error says why it can't be read."""

    def one(b: bytes | None) -> tuple:
        try:
            s = structure(b or b"")
        except ValueError as e:
            return (str(e), *[None] * 8)
        return None, s["brand"], s["handler"], s["primary"], len(s["items"]), [i["kind"] for i in s["items"]], s["xmp"], s["unreadable"], s["manifest"]

    @F.pandas_udf(HEIF)
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in contents], columns=[c.split()[0] for c in HEIF.split(", ")], dtype=object)

    return run(content)
