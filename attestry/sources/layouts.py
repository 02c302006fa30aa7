"""Files of several parts: where the first image ends, container directories, MPF indexes, and whether they match the bytes."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .embedded import packets, segments

# Namespaces of the directory, and limits on what is read.
CONTAINER, ITEM = "http://ns.google.com/photos/1.0/container/", "http://ns.google.com/photos/1.0/container/item/"
MOST_ITEMS, MOST_ENTRIES, MPF = 64, 64, b"MPF\0"


def primary_end(b: bytes) -> int | None:
    """The place behind the first complete JPEG's end marker, scans walked byte by byte; None if there is none."""
    if b[:2] != b"\xff\xd8":
        return None
    at = 2
    while at < len(b) and b[at] == 0xFF:
        while at < len(b) and b[at] == 0xFF:
            at += 1
        if at >= len(b):
            return None
        kind, at = b[at], at + 1
        if kind == 0xD9:
            return at
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            continue
        size = int.from_bytes(b[at : at + 2], "big")
        if size < 2 or at + size > len(b):
            return None
        at += size
        while kind == 0xDA:  # to the next marker that is neither stuffing nor a restart
            at = b.find(b"\xff", at)
            if at < 0 or at + 1 >= len(b):
                return None
            if b[at + 1] and not 0xD0 <= b[at + 1] <= 0xD7 and b[at + 1] != 0xFF:
                break
            at += 1 if b[at + 1] == 0xFF else 2
    return None


def _prefix(text: str, namespace: str) -> str | None:
    m = re.search(rf"xmlns:([^\s=]+)=[\"']{re.escape(namespace)}[\"']", text)
    return m[1] if m else None


def directory(text: str) -> list[dict] | None:
    """Items of a packet's container directory; None without one, ValueError for one that can't be read."""
    c, i = _prefix(text, CONTAINER), _prefix(text, ITEM)
    opened = re.search(rf"<{re.escape(c)}:Directory[\s>/]", text) if c and i else None
    if not opened:
        return None
    end = text.find(f"</{c}:Directory>", opened.start())
    if end < 0:
        raise ValueError("the directory is not closed")
    items = []
    for m in re.finditer(rf"<{re.escape(c)}:Item(?=[\s>/])([^>]*?)(?:/>|>(.*?)</{re.escape(c)}:Item>)", text[opened.start() : end], re.S):
        if len(items) == MOST_ITEMS:
            raise ValueError(f"more than {MOST_ITEMS} items")

        def value(name: str, m: re.Match = m) -> str | None:
            x = re.search(rf"(?<![^\s]){i}:{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[1]) or re.search(rf"<{i}:{name}>()([^<]*)<", m[2] or "")
            return None if not x else x[1] or x[2]

        numbers = {n: value(n) for n in ("Length", "Padding")}
        if any(v is not None and not re.fullmatch(r"\s*[0-9]+\s*", v) for v in numbers.values()):
            raise ValueError("an item's length is no number")
        if value("Semantic") is None or value("Mime") is None:
            raise ValueError("an item has no semantic or type")
        items.append({"semantic": value("Semantic"), "mime": value("Mime"), **{n.lower(): None if v is None else int(v) for n, v in numbers.items()}})
    if not items:
        raise ValueError("the directory has no items")
    return items


def _fits(b: bytes, at: int, mime: str) -> bool:
    head = b[at : at + 12]
    return {"image/jpeg": head[:3] == b"\xff\xd8\xff", "image/png": head[:8] == b"\x89PNG\r\n\x1a\n", "video/mp4": head[4:8] == b"ftyp", "image/heic": head[4:8] == b"ftyp"}.get(mime, True)


def placed(items: list[dict], end: int, b: bytes) -> tuple[list[dict], list[str]]:
    """Items behind the first one, with the bytes that are there; and what disagrees with the file."""
    wrong, out = [], []
    if items[0]["semantic"] != "Primary":
        wrong.append("the first item is not the primary image")
    if any(x["semantic"] == "Primary" for x in items[1:]):
        wrong.append("a second primary image")
    if any(x["padding"] for x in items[1:]):
        wrong.append("padding behind the first item")
    at = last = end + (items[0]["padding"] or 0)
    for n, x in enumerate(items[1:], 1):
        if x["length"] is None:
            return out, [*wrong, f"item {n} has no length"]
        begin = at if x["length"] else last
        there = max(0, min(x["length"], len(b) - begin))
        if there < x["length"]:
            wrong.append(f"item {n} is beyond the file" if not there else f"item {n} is cut short")
        if there and not _fits(b, begin, x["mime"]):
            wrong.append(f"item {n} is not {x['mime']}")
        out.append({"name": x["semantic"], "offset": begin, "length": x["length"], "present": there})
        if x["length"]:
            last, at = begin, begin + x["length"]
    if at < len(b):
        wrong.append("bytes behind the last item")
    return out, wrong


def mpf(b: bytes) -> dict | None:
    """The MPF index of a JPEG: images, the declared number, further segments; None without one, ValueError for a broken one."""
    found = [(at, d[len(MPF) :]) for k, at, d in segments(b) if k == 0xE2 and d.startswith(MPF)]
    if not found:
        return None
    place, t = found[0]
    order = {b"MM\0*": ">", b"II*\0": "<"}.get(t[:4])
    if order is None:
        raise ValueError("the index has no header")
    try:
        (ifd,) = struct.unpack_from(order + "I", t, 4)
        (n,) = struct.unpack_from(order + "H", t, ifd)
        if n > MOST_ENTRIES:
            raise ValueError("the index has too many entries")
        tags = {tag: (count, value, ifd + 10 + 12 * i) for i in range(n) for tag, _, count, value in [struct.unpack_from(order + "HHII", t, ifd + 2 + 12 * i)]}
        if 0xB002 not in tags:
            raise ValueError("the index has no table")
        size, begin, inline = tags[0xB002]
        begin = inline if size <= 4 else begin
        if size % 16 or begin + size > len(t):
            raise ValueError("the index's table is broken")
        images = []
        for i in range(size // 16):
            kind, length, offset, *_ = struct.unpack_from(order + "IIIHH", t, begin + 16 * i)
            images.append({"raw": offset, "offset": 0 if not i else place + len(MPF) + offset, "length": length, "format": kind >> 24 & 7})
    except struct.error as e:
        raise ValueError("the index ends early") from e
    return {"images": images, "declared": tags[0xB001][1] if 0xB001 in tags else None, "more": len(found) - 1}


def checked(index: dict, b: bytes) -> tuple[list[dict], list[str]]:
    """The index's images with the bytes that are there; and what disagrees. The first image's size is only recorded: later offsets hold without it."""
    wrong, out, reach = [], [], 0
    if index["declared"] is not None and index["declared"] != len(index["images"]):
        wrong.append("the number of images differs from the table")
    if index["more"]:
        wrong.append("more than one index")
    if not index["images"]:
        wrong.append("the table is empty")
    for n, x in enumerate(index["images"]):
        begin, end = x["offset"], x["offset"] + x["length"]
        there = max(0, min(end, len(b)) - min(begin, len(b)))
        own = b[begin:end]
        if n == 0:
            if x["raw"]:
                wrong.append("image 0 has an offset")
            stop = primary_end(b) if own[:3] == b"\xff\xd8\xff" else None
            if stop is None:
                wrong.append("image 0 is no complete JPEG")
            end = stop or end
        else:
            if begin < reach:
                wrong.append(f"image {n} begins inside an earlier one")
            if there < x["length"]:
                wrong.append(f"image {n} is beyond the file" if not there else f"image {n} is cut short")
            elif x["format"] == 0 and primary_end(own) != x["length"]:
                wrong.append(f"image {n} is no JPEG of its length")
        reach = max(reach, end)
        out.append({"name": f"image {n}", "offset": begin, "length": x["length"], "present": there})
    return out, wrong


LAYOUT = "status string, parts array<struct<name: string, offset: long, length: long, present: long>>, wrong array<string>, primary_end long"


def _row(b: bytes | None, which: str) -> tuple:
    b = b or b""
    end = primary_end(b)
    try:
        if which == "mpf":
            index = mpf(b)
            found = None if index is None else checked(index, b)
        else:
            items = next((d for d in map(directory, packets(b)[0]) if d), None)
            if items and end is None:
                raise ValueError("the primary image is not complete")
            found = placed(items, end, b) if items else None
    except ValueError as e:
        return "inconclusive", [], [str(e)], end
    return ("absent", [], [], end) if found is None else ("inconclusive" if found[1] else "present", *found, end)


def layout(content: Column, which: str = "directory") -> Column:
    """struct (LAYOUT) of a file's container directory or MPF index: absent without one, present if it agrees with the bytes."""

    @F.pandas_udf(LAYOUT)
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_row(b, which) for b in contents], columns=["status", "parts", "wrong", "primary_end"], dtype=object)

    return run(content)
