"""Metadata inside image files: XMP packets, EXIF, IPTC datasets, ICC profiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .images import PNG_SIGN
from .xmp import tidy

# What opens the segments and chunks that hold metadata.
XMP, EXTENDED, IRB, ICC, EXIF = b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0", b"Photoshop 3.0\0", b"ICC_PROFILE\0", b"Exif\0\0"
PNG_XMP = "XML:com.adobe.xmp"
MOST_XMP, MOST_ICC, MOST_TAGS = 4 << 20, 8 << 20, 256


def segments(b: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(marker, place of the data, data) of a JPEG's segments before its scan; ValueError for a broken one."""
    if b[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while at + 1 < len(b):
        if b[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        while at < len(b) and b[at] == 0xFF:
            at += 1
        if at == len(b):
            return
        kind, at = b[at], at + 1
        if kind in (0xD9, 0xDA):
            return
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            continue
        size = int.from_bytes(b[at : at + 2], "big")
        if at + 2 > len(b) or size < 2 or at + size > len(b):
            raise ValueError("a segment's length is wrong")
        yield kind, at + 2, b[at + 2 : at + size]
        at += size


def png_chunks(b: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG_SIGN)
    while b[:at][:8] == PNG_SIGN and at + 12 <= len(b):
        size = int.from_bytes(b[at : at + 4], "big")
        if at + 12 + size > len(b):
            return
        yield b[at + 4 : at + 8], b[at + 8 : at + 8 + size]
        at += 12 + size


def riff_chunks(b: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while b[:4] == b"RIFF" and b[8:12] == b"WEBP" and at + 8 <= len(b):
        size = int.from_bytes(b[at + 4 : at + 8], "little")
        if at + 8 + size > len(b):
            return
        yield b[at : at + 4], b[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def decoded(packet: bytes) -> str:
    """A packet's text: UTF-8, 16 or 32, told by a mark or by the zeros around its first <; what is invalid is replaced."""
    marks = ((b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"), (b"\xef\xbb\xbf", "utf-8"))
    for mark, kind in marks:
        if packet.startswith(mark):
            return packet[len(mark) :].decode(kind, "replace")
    for head, kind in ((b"\0\0\0<", "utf-32-be"), (b"<\0\0\0", "utf-32-le"), (b"\0<", "utf-16-be"), (b"<\0", "utf-16-le")):
        if packet.startswith(head):
            return packet.decode(kind, "replace")
    return packet.decode("utf-8", "replace")


def _jpeg_packets(b: bytes) -> tuple[list[bytes], bool]:
    """The XMP packets, with the extended one put together; and whether that is incomplete."""
    found, parts, first, broken = [], {}, None, False
    for kind, _, data in segments(b):
        if kind == 0xE1 and data.startswith(XMP):
            found.append(data[len(XMP) :])
        elif kind == 0xE1 and data.startswith(EXTENDED):
            rest = data[len(EXTENDED) :]
            if len(rest) < 40:
                broken = True
                continue
            whole, begin = struct.unpack(">II", rest[32:40])
            first = first or (rest[:32], whole)
            if (rest[:32], whole) == first and whole <= MOST_XMP and begin not in parts:
                parts[begin] = rest[40:]
            else:
                broken = True
    if first is not None:
        at = 0
        for begin in sorted(parts):
            if begin != at:
                break
            at += len(parts[begin])
        if at == first[1] and sum(map(len, parts.values())) == at:
            found.append(b"".join(parts[k] for k in sorted(parts)))
        else:
            broken = True
    return found, broken


def packets(b: bytes) -> tuple[list[str], bool]:
    """XMP texts of a JPEG, PNG or WebP, and whether a packet is incomplete."""
    if b[:2] == b"\xff\xd8":
        raw, broken = _jpeg_packets(b)
    elif b[:8] == PNG_SIGN:
        raw, broken = [d.split(b"\0", 5)[5] for k, d in png_chunks(b) if k == b"iTXt" and d.startswith(PNG_XMP.encode() + b"\0\0") and d.count(b"\0") >= 5], False
    else:
        raw, broken = [d for k, d in riff_chunks(b) if k == b"XMP "], False
    return [decoded(p) for p in raw], broken


def iim(b: bytes) -> dict[int, list[str]]:
    """IPTC datasets of record 2 in a JPEG: texts by number, in order."""
    out: dict[int, list[str]] = {}
    for kind, _, data in segments(b):
        if kind == 0xED and data.startswith(IRB) and (block := _resource(data[len(IRB) :], 0x0404)) is not None:
            out = {}
            at = 0
            while at + 5 <= len(block) and block[at] == 0x1C:
                record, number, size = struct.unpack(">BBH", block[at + 1 : at + 5])
                if size & 0x8000 or at + 5 + size > len(block):
                    break
                if record == 2:
                    out.setdefault(number, []).append(block[at + 5 : at + 5 + size].decode("utf-8", "replace").strip()[:256])
                at += 5 + size
    return out


def _resource(b: bytes, wanted: int) -> bytes | None:
    at = 0
    while at + 12 <= len(b) and b[at : at + 4] == b"8BIM":
        number, name = struct.unpack(">HB", b[at + 4 : at + 7])
        p = at + 7 + name + (1 + name) % 2
        if p + 4 > len(b):
            return None
        size = int.from_bytes(b[p : p + 4], "big")
        if p + 4 + size > len(b):
            return None
        if number == wanted:
            return b[p + 4 : p + 4 + size]
        at = p + 4 + size + size % 2
    return None


# --- EXIF -------------------------------------------------------------------------------------------

_TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software"}


def _directory(t: bytes, order: str, at: int) -> tuple[dict[int, bytes | int], int]:
    """Entries of a TIFF directory (texts as bytes, numbers as the first one), and the place of the next."""
    (n,) = struct.unpack_from(order + "H", t, at)
    out: dict[int, bytes | int] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", t, at + 2 + 12 * i)
        place = at + 2 + 12 * i + 8
        size = {1: 1, 2: 1, 3: 2, 4: 4, 7: 1, 9: 4, 5: 8, 10: 8}.get(kind, 1) * count
        if size > 4:
            (place,) = struct.unpack_from(order + "I", t, place)
        if place + size > len(t):
            continue
        out[tag] = t[place : place + size] if kind in (1, 2, 5, 7, 10) else struct.unpack_from(order + {3: "H", 4: "I", 9: "i"}.get(kind, "B"), t, place)[0] if count else 0
    (following,) = struct.unpack_from(order + "I", t, at + 2 + 12 * n)
    return out, following


def exif(b: bytes) -> dict:
    """make, model, software, width, height, maker_note, thumbnail of a JPEG's or PNG's EXIF; empty without one, {"partial": True} for a broken one."""
    if b[:2] == b"\xff\xd8":
        t = next((d[len(EXIF) :] for k, _, d in segments(b) if k == 0xE1 and d.startswith(EXIF)), None)
    else:
        t = next((d for k, d in [*png_chunks(b), *riff_chunks(b)] if k in (b"eXIf", b"EXIF")), None)
    if t is None:
        return {}
    order = {b"MM\0*": ">", b"II*\0": "<"}.get(t[:4])
    if order is None:
        return {"partial": True}
    try:
        own, following = _directory(t, order, struct.unpack_from(order + "I", t, 4)[0])
        sub = _directory(t, order, own[0x8769])[0] if isinstance(own.get(0x8769), int) else {}
        text = {name: tidy(own[tag].split(b"\0", 1)[0].decode("utf-8", "replace")) or None for tag, name in _TAGS.items() if isinstance(own.get(tag), bytes)}
        return {**text, "width": sub.get(0xA002), "height": sub.get(0xA003), "maker_note": 0x927C in sub, "thumbnail": bool(following) and 0x0201 in _directory(t, order, following)[0]}
    except struct.error:
        return {"partial": True}


# --- ICC --------------------------------------------------------------------------------------------


def icc_bytes(b: bytes) -> bytes | None:
    """The profile of a JPEG (whose chunks have to be whole and single), PNG or WebP; None without one, ValueError for a broken one."""
    if b[:2] == b"\xff\xd8":
        chunks = [d[len(ICC) :] for k, _, d in segments(b) if k == 0xE2 and d.startswith(ICC) and len(d) >= len(ICC) + 2]
        if not chunks:
            return None
        by = {c[0]: c[2:] for c in chunks}
        if len({c[1] for c in chunks}) > 1 or len(by) < len(chunks) or sorted(by) != list(range(1, chunks[0][1] + 1)):
            raise ValueError("the profile's chunks are not whole")
        out = b"".join(by[i] for i in sorted(by))
    elif b[:8] == PNG_SIGN:
        data = next((d for k, d in png_chunks(b) if k == b"iCCP"), None)
        if data is None:
            return None
        _, nul, rest = data.partition(b"\0")
        if not nul or not rest or rest[0]:
            raise ValueError("the iCCP chunk has no compressed profile")
        stream = zlib.decompressobj()
        try:
            out = stream.decompress(rest[1:], MOST_ICC + 1)
        except zlib.error as e:
            raise ValueError(f"the iCCP chunk can't be inflated: {e}") from e
        if not stream.eof and len(out) <= MOST_ICC:
            raise ValueError("the iCCP chunk ends early")
    else:
        out = next((d for k, d in riff_chunks(b) if k == b"ICCP"), None)
    if out is not None and len(out) > MOST_ICC:
        raise ValueError("the profile is too large")
    return out


def _sign(b: bytes) -> str:
    return b.decode().rstrip() if all(32 <= c < 127 for c in b) else "0x" + b.hex()


def _described(e: bytes) -> str | None:
    if e[:4] == b"desc" and len(e) >= 12:
        text = e[12 : 12 + int.from_bytes(e[8:12], "big")].split(b"\0", 1)[0].decode("utf-8", "replace")
    elif e[:4] == b"text":
        text = e[8:].split(b"\0", 1)[0].decode("utf-8", "replace")
    elif e[:4] == b"mluc" and len(e) >= 16:
        n, stride = struct.unpack(">II", e[8:16])
        found = []
        for i in range(min(n, MOST_TAGS)):
            r = e[16 + max(12, stride) * i :][:12]
            if len(r) < 12:
                break
            size, at = struct.unpack(">II", r[4:])
            if at + size <= len(e):
                found.append((r[:4], e[at : at + size - size % 2].decode("utf-16-be", "replace")))
        plain = [t for code, t in found if not code.isalpha() or code.lower() == b"enus"]
        text = plain[-1] if plain else found[0][1] if found else ""
    else:
        return None
    return tidy(text.rstrip("\0")) or None


def icc(p: bytes) -> dict:
    """version, class, space, description and tags of a profile; ValueError if it is none."""
    if len(p) < 132:
        raise ValueError("too short for a profile")
    if p[36:40] != b"acsp":
        raise ValueError("no profile signature")
    tags, said = [], None
    for i in range(min(int.from_bytes(p[128:132], "big"), MOST_TAGS)):
        entry = p[132 + 12 * i : 144 + 12 * i]
        if len(entry) < 12:
            break
        tags.append(_sign(entry[:4]))
        at, size = struct.unpack(">II", entry[4:])
        if entry[:4] == b"desc" and said is None and at + size <= len(p):
            said = _described(p[at : at + size])
    return {"version": f"{p[8]}.{p[9] >> 4}", "class": _sign(p[12:16]), "space": _sign(p[16:20]), "description": said, "tags": tags}


# --- one pass ---------------------------------------------------------------------------------------

EMBEDDED = (
    "error string, xmp array<string>, xmp_incomplete boolean, make string, model string, software string, width int, height int, maker_note boolean, thumbnail boolean, exif_partial boolean,"
    " iim map<int, array<string>>, icc_version string, icc_class string, icc_space string, icc_description string, icc_error string"
)


def read(b: bytes | None) -> tuple:
    """A row of EMBEDDED."""
    b = b or b""
    try:
        texts, broken = packets(b)
        e, sets = exif(b), iim(b) if b[:2] == b"\xff\xd8" else {}
    except ValueError as x:
        return (str(x), *[None] * 16)
    try:
        raw, why = icc_bytes(b), None
        p = icc(raw) if raw is not None else {}
    except ValueError as x:
        p, why = {}, str(x)
    number = lambda v: v if isinstance(v, int) else None
    return (None, texts, broken, e.get("make"), e.get("model"), e.get("software"), number(e.get("width")), number(e.get("height")), e.get("maker_note", False), e.get("thumbnail", False), e.get("partial", False), sets, p.get("version"), p.get("class"), p.get("space"), p.get("description"), why)


def embedded(content: Column) -> Column:
    """struct (EMBEDDED) of a file's bytes, in one pass; error says why it can't be read."""
    names = ["error", "xmp", "xmp_incomplete", "make", "model", "software", "width", "height", "maker_note", "thumbnail", "exif_partial", "iim", "icc_version", "icc_class", "icc_space", "icc_description", "icc_error"]

    @F.pandas_udf(EMBEDDED)
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(b) for b in contents], columns=names, dtype=object)

    return run(content)


def exif_status(generator: Column, conflict: Column, camera: Column, maker_note: Column, reencoded: Column, editor: Column) -> Column:
    """A named generator is present; contradicting sizes, a camera without its note in a re-encoded file, or a named editor are inconclusive; else absent."""
    stripped = camera & ~maker_note & reencoded
    return F.when(generator.isNotNull(), "present").when(conflict | stripped, "inconclusive").when(~camera & editor.isNotNull(), "inconclusive").otherwise("absent")
