"""Properties of XMP packets, by a tolerant scan that needs no well-formed XML, and statuses that follow from them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMED = {"quot": '"', "amp": "&", "lt": "<", "gt": ">", "apos": "'"}
_REFERENCE = re.compile(r"&(#[xX]([0-9A-Fa-f]+)|#([0-9]+)|[a-z]+);")
MOST, RAW = 256, 512


def unescape(text: str) -> str:
    """Named and numeric character references of at most ten characters; what isn't one stays."""

    def one(m: re.Match) -> str:
        if len(m[0]) > 11:
            return m[0]
        if m[2] or m[3]:
            n = int(m[2], 16) if m[2] else int(m[3])
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]
        return _NAMED.get(m[1], m[0])

    return _REFERENCE.sub(one, text)


def tidy(text: str) -> str:
    flat = " ".join(text.split())
    return flat if len(flat) <= MOST else flat[:MOST] + "…"


def text_between_tags(fragment: str) -> str:
    return " ".join(re.sub(r"<[^>]*>?", " ", fragment).split()) if "<" in fragment else " ".join(fragment.split())


def namespace_of(text: str, prefix: str) -> str | None:
    m = re.search(rf"xmlns:{re.escape(prefix)}=(?:\"([^\"]*)\"|'([^']*)')", text)
    return None if not m else m[1] if m[1] is not None else m[2]


def prefix_bound(text: str, prefix: str, namespace: str) -> bool:
    return any(f"xmlns:{prefix}={q}{namespace}{q}" in text for q in "\"'")


def _quoted(text: str) -> str | None:
    m = re.match(r"\s*(?:\"([^\"]*)\"|'([^']*)')", text)
    return None if not m else m[1] if m[1] is not None else m[2]


def find_property(text: str, name: str, nested: bool = False) -> list[tuple[str, str, str]]:
    """(prefix, raw value, form) of every prefix:name that holds a value: as attribute, element or resource. nested: also inside child elements."""
    out = []
    for m in re.finditer(rf"(^|[<\s/])([^<\s/]*):{re.escape(name)}(?![A-Za-z0-9_-])", text):
        lead, prefix, after = m[1], m[2], text[m.end() :]
        if lead == "/" or prefix in ("", "xmlns"):
            continue
        value, form = None, "attribute"
        if after.lstrip().startswith("="):
            value = _quoted(after.lstrip()[1:])
        elif lead == "<" and ">" in after:
            head, body = after.split(">", 1)
            if "rdf:resource" in head:
                tail, form = head.split("rdf:resource", 1)[1].lstrip(), "resource"
                value = _quoted(tail[1:]) if tail.startswith("=") else None
            elif not head.rstrip().endswith("/") and "<" in body:
                own, form = body.split("<", 1)[0], "element"
                if nested and not own.strip():
                    end = body.find(f"</{prefix}:{name}")
                    value = text_between_tags(body[:end]) if end >= 0 else None
                else:
                    value = own
        if value is not None and (value := value.strip()[:RAW]):
            out.append((prefix, value, form))
    return out


def properties(text: Column, names: list[str], namespaces: dict[str, str] | None = None, nested: bool = False) -> Column:
    """array of (name, prefix, namespace, value, form): values unescaped and tidied. namespaces: conventional prefix -> URI; others are left out if given."""
    spaces = dict(namespaces or {})

    def one(t: str | None) -> list[dict]:
        found = []
        for name in names if t else ():
            for prefix, raw, form in find_property(t, name, nested):
                if not spaces or prefix in spaces or any(prefix_bound(t, prefix, uri) for uri in spaces.values()):
                    found.append({"name": name, "prefix": prefix, "namespace": namespace_of(t, prefix), "value": tidy(unescape(raw)), "form": form})
        return found

    @F.pandas_udf("array<struct<name: string, prefix: string, namespace: string, value: string, form: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return run(text)


def ladder(values: Column, known: dict[str, str], present: str, conflict: tuple[str, ...] = (), incomplete: Column | None = None) -> Column:
    """Status of coded values: an unknown one, or kinds that conflict, are inconclusive; the kind ``present`` is present; else absent, inconclusive if the packet isn't whole."""
    kind = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    kinds = F.array_distinct(F.transform(values, lambda v: F.coalesce(kind[v], F.lit("unknown"))))
    has = lambda k: F.array_contains(kinds, k)
    clash = F.lit(False) if len(conflict) < 2 else has(conflict[0]) & has(conflict[1])
    return F.when(has("unknown") | clash, "inconclusive").when(has(present), "present").when(F.lit(False) if incomplete is None else incomplete, "inconclusive").otherwise("absent")


def copies_agree(a: Column, b: Column, limit: int | None = None) -> Column:
    """Whether two copies of a field say the same: equal, or b is the beginning of a, cut near a byte limit."""
    same = a == b
    return same if limit is None else same | (F.startswith(a, b) & (F.octet_length(b) + 4 > limit))


def kind_counts(rows: DataFrame, kind: str) -> DataFrame:
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
