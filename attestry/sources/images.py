"""Structure of JPEG and PNG files, by pandas UDFs over their bytes; nothing is decoded."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantisation tables of the JPEG standard, in natural order, and magic texts of segments.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [17, 18, 24, 47] + [99] * 4 + [18, 21, 26, 66] + [99] * 4 + [24, 26, 56] + [99] * 5 + [47, 66] + [99] * 38
PNG_SIGN = b"\x89PNG\r\n\x1a\n"
ICC_NAMES = ("icc", "icm", "icc profile", "photoshop icc profile", "skia", "srgb iec61966-2.1", "display p3", "adobe rgb (1998)")

#: Natural places in zigzag order: diagonals, walked up and down in turn.
ZIGZAG = [8 * y + x for d in range(15) for y, x in ((((d - i), i) if d % 2 == 0 else (i, d - i)) for i in range(d + 1)) if x < 8 and y < 8]


def scaled(natural: list[int], quality: int) -> list[int]:
    """The table that the common encoder writes at a quality, in zigzag order."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (natural[i] * scale + 50) // 100)) for i in ZIGZAG]


_QUALITY = [{}, {}]
for _q in range(100, 0, -1):  # the least quality of equal tables stays
    _QUALITY[0][tuple(scaled(LUMA, _q))] = _QUALITY[1][tuple(scaled(CHROMA, _q))] = _q


def jpeg_structure(b: bytes) -> dict:
    """Segments up to the scan, and what follows the last end of image; raises ValueError for broken files."""
    if b[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out: dict = {"tables": [], "huffman": [], "components": [], "markers": [], "width": 0, "height": 0, "precision": 0, "progressive": False, "arithmetic": False, "jfif": False, "adobe": False, "exif": False, "xmp": False, "icc": False, "jumbf": False, "comment": None, "restart": 0}
    at = 2
    while at + 1 < len(b):
        if b[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        while at < len(b) and b[at] == 0xFF:
            at += 1
        if at == len(b):
            break
        kind = b[at]
        at += 1
        out["markers"].append(kind)
        if kind in (0xD9, 0xDA):
            break
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            continue
        size = int.from_bytes(b[at : at + 2], "big")
        if at + 2 > len(b) or size < 2 or at + size > len(b):
            raise ValueError("a segment's length is wrong")
        _segment(out, kind, b[at + 2 : at + size])
        at += size
    if not out["tables"]:
        raise ValueError("no quantisation table")
    end = b.rfind(b"\xff\xd9")
    out["trailing"] = len(b) - end - 2 if end >= 0 else 0
    return out


def _segment(out: dict, kind: int, data: bytes) -> None:
    if kind == 0xDB:
        while data:
            wide = 1 + (data[0] >> 4 > 0)
            if len(data) < 1 + 64 * wide:
                raise ValueError("a quantisation table ends early")
            out["tables"].append(struct.unpack(">64" + "BH"[wide - 1], data[1 : 1 + 64 * wide]))
            data = data[1 + 64 * wide :]
    elif kind == 0xC4:
        while len(data) >= 17:
            n = sum(data[1:17])
            if n > 256 or len(data) < 17 + n:
                raise ValueError("a Huffman table ends early")
            out["huffman"].append((data[0] >> 4, data[0] & 15, data[1:17], data[17 : 17 + n]))
            data = data[17 + n :]
    elif kind == 0xDD and len(data) >= 2:
        out["restart"] = int.from_bytes(data[:2], "big")
    elif 0xC0 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
        if len(data) < 6 or len(data) < 6 + 3 * data[5]:
            raise ValueError("a frame header ends early")
        out["precision"], out["height"], out["width"] = struct.unpack(">BHH", data[:5])
        out["progressive"], out["arithmetic"] = kind % 4 == 2, kind >= 0xC9
        out["components"] = [(data[i], data[i + 1] >> 4, data[i + 1] & 15, data[i + 2]) for i in range(6, 6 + 3 * data[5], 3)]
    elif kind == 0xFE:
        out["comment"] = data.decode("utf-8", "replace")[:1024]
    else:
        for name, marker, head in (("jfif", 0xE0, b"JFIF\0"), ("exif", 0xE1, b"Exif\0\0"), ("xmp", 0xE1, b"http://ns.adobe.com/xap/1.0/\0"), ("icc", 0xE2, b"ICC_PROFILE\0"), ("jumbf", 0xEB, b"JP"), ("adobe", 0xEE, b"Adobe")):
            out[name] = out[name] or (kind == marker and data.startswith(head))


def jpeg_fingerprint(s: dict) -> str:
    """SHA-256 of what the writer chooses: tables, Huffman specs, components, flags and the order of markers."""
    parts = [struct.pack(">64H", *t) + b"\xff" for t in s["tables"]]
    parts += [bytes(h[:2]) + h[2] + h[3] + b"\xfe" for h in s["huffman"]]
    parts += [bytes(c) for c in s["components"]]
    return hashlib.sha256(b"".join(parts) + bytes([s["progressive"], s["jfif"], s["adobe"], *s["markers"]])).hexdigest()


def _table(s: dict, component: int) -> tuple | None:
    if component and len(s["components"]) <= component:
        return None
    i = s["components"][component][3] if s["components"] else 0
    return s["tables"][i] if i < len(s["tables"]) else s["tables"][0] if not component else None


JPEG = "error string, width int, height int, progressive boolean, subsampling string, id_style string, quality int, chroma_matches boolean, encoder string, huffman string, fingerprint string, trailing int, jumbf boolean, xmp boolean, comment string"


def _jpeg_row(b: bytes | None) -> tuple:
    try:
        s = jpeg_structure(b or b"")
    except ValueError as e:
        return (str(e), *[None] * 14)
    c = s["components"]
    ids = tuple(x[0] for x in c)
    sampling = "unknown" if not c else "grayscale" if len(c) == 1 else {(1, 1): "4:4:4", (2, 1): "4:2:2", (1, 2): "4:4:0", (2, 2): "4:2:0"}.get(c[0][1:3], "other")
    style = "jfif" if ids in ((1, 2, 3), (1,)) else "zero_based" if ids in ((0, 1, 2), (0,)) else "rgb" if ids == tuple(b"RGB") else "other"
    quality, chroma = _QUALITY[0].get(_table(s, 0)), _table(s, 1)
    matches = None if quality is None else chroma is None or _QUALITY[1].get(chroma) == quality
    encoder = "adobe" if s["adobe"] else "libjpeg" if quality is not None else "non_standard"
    return (None, s["width"], s["height"], s["progressive"], sampling, style, quality, matches, encoder, "arithmetic" if s["arithmetic"] else "present" if s["huffman"] else "missing", jpeg_fingerprint(s), s["trailing"], s["jumbf"], s["xmp"], s["comment"])


def png_structure(b: bytes) -> dict:
    """Chunks in order with what they say; raises ValueError for broken files."""
    if b[:8] != PNG_SIGN:
        raise ValueError("not a PNG")
    out: dict = {"chunks": [], "text": [], "idat": [], "width": 0, "height": 0, "depth": 0, "color": 0, "interlace": 0, "icc": None, "phys": None, "head": b""}
    at = 8
    while at + 8 <= len(b):
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        data = b[at + 8 : at + 8 + size]
        if at + 12 + size > len(b):
            raise ValueError("a chunk ends early")
        name = kind.decode("utf-8", "replace")
        out["chunks"].append(name)
        if name == "IHDR" and size >= 13:
            out["width"], out["height"], out["depth"], out["color"], _, _, out["interlace"] = struct.unpack(">IIBBBBB", data[:13])
        elif name == "IDAT":
            out["head"] = out["head"] or data[2:18]
            out["idat"].append(size)
        elif name == "tEXt" and b"\0" in data:
            key, value = data.split(b"\0", 1)
            out["text"].append((key.decode("utf-8", "replace"), value.decode("utf-8", "replace")[:4096]))
        elif name == "iTXt" and data.count(b"\0") >= 4 and data.split(b"\0", 1)[1][:1] == b"\0":
            key, rest = data.split(b"\0", 1)
            out["text"].append((key.decode("utf-8", "replace"), rest[2:].split(b"\0", 2)[2].decode("utf-8", "replace")[:4096]))
        elif name == "iCCP" and b"\0" in data:
            out["icc"] = data.split(b"\0", 1)[0].decode("utf-8", "replace")[:80]
        elif name == "pHYs" and size >= 9:
            out["phys"] = data[:9]
        at += 12 + size
        if name == "IEND":
            break
    if out["chunks"][:1] != ["IHDR"]:
        raise ValueError("no IHDR")
    return out


def even_block(sizes: list[int]) -> int | None:
    """The length of all IDAT chunks but the last, if it is one length and the last isn't longer."""
    return sizes[0] if len(sizes) > 1 and set(sizes[:-1]) == {sizes[0]} and sizes[-1] <= sizes[0] else None


def png_fingerprint(s: dict) -> str:
    """SHA-256 of what the writer chooses: chunk order (a run of IDAT once), depth, keywords, known profile name, density."""
    order = [c for i, c in enumerate(s["chunks"]) if c != "IDAT" or s["chunks"][i - 1] != "IDAT"]
    h = hashlib.sha256(b"".join(c.encode() + b"\0" for c in order) + bytes([s["depth"], s["color"], s["interlace"]]))
    h.update(b"".join(k.encode() + b"\1" for k in sorted(k for k, _ in s["text"])))
    if s["icc"] is not None:
        h.update(s["icc"].encode() if s["icc"].strip().lower() in ICC_NAMES else b"\x01other profile name")
    h.update(s["phys"] or b"")
    return h.hexdigest()


PNG = "error string, width int, height int, depth int, color int, chunks array<string>, text array<struct<keyword: string, value: string>>, idat_chunks int, idat_max int, idat_block int, deflate string, icc_name string, has_c2pa boolean, fingerprint string"


def _png_row(b: bytes | None) -> tuple:
    try:
        s = png_structure(b or b"")
    except ValueError as e:
        return (str(e), *[None] * 13)
    deflate = [None, "stored", "fixed", "dynamic", None][1 + (s["head"][0] >> 1 & 3)] if s["head"] else None
    icc = s["icc"] if s["icc"] is not None and s["icc"].strip().lower() in ICC_NAMES else None
    return (None, s["width"], s["height"], s["depth"], s["color"], s["chunks"], [{"keyword": k, "value": v} for k, v in s["text"]], len(s["idat"]), max(s["idat"], default=0), even_block(s["idat"]), deflate, icc, "caBX" in s["chunks"], png_fingerprint(s))


def _struct(schema: str, row, content: Column) -> Column:
    names = [c.split()[0] for c in schema.replace("<keyword: string, value: string>", "").split(", ")]

    @F.pandas_udf(schema)
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(b) for b in contents], columns=names, dtype=object)

    return run(content)


def jpeg(content: Column) -> Column:
    """struct (JPEG) of a file's bytes; error says why it can't be read."""
    return _struct(JPEG, _jpeg_row, content)


def png(content: Column) -> Column:
    """struct (PNG) of a file's bytes; error says why it can't be read."""
    return _struct(PNG, _png_row, content)


def idat_rule(x: Column, rule: str, block: Column) -> Column:
    """Conditions on how image data is split: blocks of a size, that or one small chunk, one chunk, one large or small one."""
    one, even = x["idat_chunks"] == 1, x["idat_block"].eqNullSafe(block)
    return {"blocks": even, "blocks_or_small": even | (one & (x["idat_max"] <= block)), "single": one, "single_large": one & (x["idat_max"] > block), "single_small": one & (x["idat_max"] <= block)}[rule]


def jpeg_status(x: Column, known_writer: Column) -> Column:
    """Evidence of quantisation tables: a known writer, Adobe or scaled standard tables are present, others absent, a broken file inconclusive."""
    return F.when(x["error"].isNotNull(), "inconclusive").when(known_writer.isNotNull() | x["encoder"].isin("adobe", "libjpeg"), "present").otherwise("absent")


def png_status(x: Column, generator: Column) -> Column:
    """Evidence of a PNG's writer: named generator text is present, anything else inconclusive; it is never absent."""
    keyword = F.exists(x["text"], lambda t: F.lower(t["keyword"]).isin("parameters", "prompt", "workflow") & (F.octet_length(t["value"]) > 8))
    return F.when(x["error"].isNotNull(), "inconclusive").when(generator.isNotNull() | F.coalesce(keyword, F.lit(False)), "present").otherwise("inconclusive")


def dims_conflict(exif_w: Column, exif_h: Column, w: Column, h: Column) -> Column:
    """Whether stated sizes differ from the frame's, a quarter turn allowed."""
    return ~(((exif_w == w) & (exif_h == h)) | ((exif_w == h) & (exif_h == w)))
