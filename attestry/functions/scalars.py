"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_of(raw: Column) -> Column:
    """The last path segment, after trimming blanks and closing slashes."""
    return F.element_at(F.split(F.regexp_replace(F.trim(raw), "/+$", ""), "/"), -1)


def host_of(url: Column) -> Column:
    """The host of an absolute URL; the text itself if it has no scheme."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1)


def tidy(text: Column, most: int = 256) -> Column:
    """White space collapsed and trimmed; cut at ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def is_placeholder(value: Column) -> Column:
    """Whether a value stands for none: blank, one of the usual words, or zeros alone."""
    v = F.lower(F.trim(value))
    return v.isin("", "n/a", "na", "none", "unknown", "null", "-", "--") | v.rlike("^0+$")


def says(value: Column) -> Column:
    """true for yes words, false for no words, else null."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("yes", "true", "1"), True).when(v.isin("no", "false", "0"), False)


def masked(value: Column, reveal: bool = False) -> Column:
    """A struct of the value's length and, only if revealed, the value."""
    return F.struct(F.length(value).alias("length"), F.lit(not reveal).alias("masked"), (value if reveal else F.lit(None).cast("string")).alias("value"))


def first_needle(haystack: Column, needles: list[str]) -> Column:
    """The first needle, in the list's order, that the lower-cased haystack holds."""
    low = F.lower(haystack)
    return F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), n) for n in needles])


def gps_degrees(d: Column, m: Column, s: Column) -> Column:
    return d.cast("double") + m.cast("double") / F.lit(60.0) + s.cast("double") / F.lit(3600.0)


def gps_text(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> Column:
    """Decimal degrees with their letters; null unless both are numbers, and for 0, 0 (a camera without a fix writes that)."""
    letter = lambda r: F.when(F.substring(r, 1, 1).rlike("^[A-Za-z]$"), F.concat(F.lit(" "), F.substring(r, 1, 1))).otherwise("")
    fits = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf")) & ~((lat == 0) & (lon == 0))
    return F.when(fits, F.concat(F.format_string("%.5f", lat), letter(lat_ref), F.lit(", "), F.format_string("%.5f", lon), letter(lon_ref)))


def serial_hex(raw: Column) -> Column:
    """Upper-case hexadecimal without leading zero bytes; one byte stays."""
    return F.regexp_replace(F.hex(raw), "^(?:00)+(?=[0-9A-F]{2})", "")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def version_lt(a: Column, b: Column) -> Column:
    """Versions compared part by part, parts being cut at dots, dashes and plus signs; what isn't a number counts as 0, missing parts too."""
    parts = lambda x: F.transform(F.split(x, r"[.+-]"), lambda p: F.when(p.rlike("^[0-9]+$"), F.coalesce(p.try_cast("long"), F.lit(0))).otherwise(F.lit(0).cast("long")))
    pa, pb = parts(a), parts(b)
    n = F.greatest(F.size(pa), F.size(pb))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), (n - F.size(x)).cast("int")))
    return pad(pa) < pad(pb)


def without_prefix(raw: Column, prefix: str) -> Column:
    """The trimmed text without the prefix, which is taken off once and only if it stands there exactly."""
    t = F.trim(raw)
    return F.when(F.startswith(t, F.lit(prefix)), F.substr(t, F.lit(len(prefix) + 1))).otherwise(t)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, of the message's UTF-8 bytes."""
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda x: F.lit(bytes(b ^ x for b in block.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signal_label(label: Column) -> Column:
    """A label without the number that tells synthetic nodes apart."""
    return F.regexp_replace(label, r"_[0-9]+$", "")


def decoded(text: Column) -> Column:
    """The bytes of a base64 text, null if it is none."""
    return F.when(text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.unbase64(text))


def utc_text(t: Column) -> Column:
    """UTC text of a timestamp to the second, in any session time zone. Years have four digits or more and no plus sign; before year 0 a minus sign and no padding."""
    s = F.unix_seconds(t)
    rest = F.pmod(s, F.lit(86400))
    day = F.date_from_unix_date(((s - rest) / 86400).cast("int"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year = F.year(day).cast("string")
    year = F.when(F.year(day).between(0, 999), F.lpad(year, 4, "0")).otherwise(year)
    parts = [year, "-", two(F.month(day)), "-", two(F.day(day)), "T", two(F.floor(rest / 3600)), ":", two(F.floor(rest / 60) % 60), ":", two(rest % 60), "Z"]
    return F.concat(*[F.lit(p) for p in parts])


def rfc3339(seconds: Column) -> Column:
    """UTC time text of Unix seconds, as :func:`utc_text` writes it."""
    return utc_text(F.timestamp_seconds(seconds))


def remote_url_problem(url: Column) -> Column:
    """Why a URL must not be fetched, or null: only https with a host name is allowed."""
    host = F.lower(F.regexp_replace(host_of(url), r":[0-9]+$", ""))
    return (
        F.when(~F.lower(url).startswith("https://"), "not https")
        .when(host == "", "no host")
        .when((host == "localhost") | host.endswith(".localhost"), "local host")
        .when(host.rlike(r"^[0-9.]+$") | host.startswith("["), "address literal")
    )


#: (bytes in hexadecimal, offset from 1, modality, media type) of formats told by one stretch, and by the brand or form at byte 9. Fixed values.
MAGIC = [("FFD8FF", "image", "image/jpeg"), ("89504E470D0A1A0A", "image", "image/png")]
RIFF = [("WEBP", "image", "image/webp"), ("WAVE", "audio", "audio/wav")]
BRANDS = ["heic", "heix", "mif1", "avif"]


def sniff(content: Column) -> Column:
    """struct(modality, mime) by leading bytes, null if none fits; a file name is never used. The order of the rules matters."""
    both = lambda m, t: F.struct(F.lit(m).alias("modality"), F.lit(t).alias("mime"))
    at = lambda begin, n: F.hex(F.substring(content, begin, n))
    text = lambda x: x.encode().hex().upper()
    long = F.octet_length(content) > 12
    form, brand = at(9, 4), at(5, 4) == text("ftyp")
    rules = [(at(1, len(x) // 2) == x, both(m, t)) for x, m, t in MAGIC]
    rules += [(long & (at(1, 4) == text("RIFF")) & (form == text(x)), both(m, t)) for x, m, t in RIFF]
    rules += [
        (at(1, 4) == text("fLaC"), both("audio", "audio/flac")),
        ((at(1, 3) == text("ID3")) | at(1, 2).rlike("^FF[EF]"), both("audio", "audio/mpeg")),
        (long & brand & form.isin(*map(text, BRANDS)), both("image", "image/heif")),
        (long & brand, both("video", "video/mp4")),
        (at(1, 4) == "1A45DFA3", both("video", "video/webm")),
    ]
    return reduce(lambda acc, r: acc.when(*r), rules[1:], F.when(*rules[0]))
