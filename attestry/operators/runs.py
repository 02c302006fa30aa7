"""Runs as data: records, exits, routes, transforms, sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, shared): the one value that all rows of a key have; null if they differ or one has none."""
    one = (F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1)))
    return rows.groupBy(key).agg(F.when(one, F.min(value)).alias("shared"))


def exit_status(statuses: DataFrame, key: str) -> DataFrame:
    """2 for a run with any present status, else 0."""
    return statuses.groupBy(key).agg(F.when(F.coalesce(F.bool_or(F.col("status") == "present"), F.lit(False)), 2).otherwise(0).alias("exit_status"))


def first_seen_columns(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, place): the distinct values in the order in which they first come up. They are as few as sources are."""
    firsts = rows.groupBy(value).agg(F.min(order).alias("at"))
    return firsts.select(value, F.row_number().over(Window.orderBy("at", value)).alias("place"))


def merged_columns(lists: list[list[str]]) -> list[str]:
    """One order of columns: each list's unknown names go behind the name they follow there."""
    out: list[str] = []
    for names in lists:
        at = 0
        for n in names:
            if n in out:
                at = out.index(n) + 1
            else:
                out.insert(at, n)
                at += 1
    return out


def writer_of(stem: Column) -> Column:
    """The first two parts of a stem that __ cuts."""
    return F.substring_index(stem, "__", 2)


def status_sets(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(key, codes): the sorted distinct codes of each key."""
    return rows.filter(F.col(code).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(code)).alias("codes"))


def route_classes(rows: DataFrame, group: str, order: str, digest: str) -> DataFrame:
    """Each row's class A, B, C, ... in its group: one per digest, in the order in which digests first come up. A group has as many rows as there are routes."""
    seen = rows.withColumn("first", F.min(order).over(Window.partitionBy(group, digest)))
    place = F.dense_rank().over(Window.partitionBy(group).orderBy("first"))
    return seen.select(group, order, digest, F.chr(F.lit(64) + place).alias("class"))


def checks_compared(expected: DataFrame, got: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """Keys with the sorted outcomes of both sides, and whether they are the same, missing, extra or differing."""
    side = lambda rows, name: rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(outcome)), ",").alias(name))
    kind = F.when(F.col("got").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected") == F.col("got"), "same").otherwise("differing")
    return side(expected, "expected").join(side(got, "got"), keys, "full_outer").select(*keys, "expected", "got", kind.alias("outcome"))


def named_parts(signed: DataFrame, declared: DataFrame, file: str) -> DataFrame:
    """signed parts (file, part, offset, length) with the name of the first declared part at the same place."""
    first = declared.groupBy(file, "offset", "length").agg(F.min_by("name", "at").alias("name"))
    return signed.join(first, [file, "offset", "length"], "left").select(file, "part", "offset", "length", "name")


def eligibility(required: DataFrame, found: DataFrame, file: str, part: str) -> DataFrame:
    """(file, missing, failed, outcome): whether all required parts were found, and all of them are ok."""
    have = found.select(file, part, F.coalesce("ok", F.lit(False)).alias("ok"))
    x = required.join(have, [file, part], "left").groupBy(file).agg(F.count_if(F.col("ok").isNull()).alias("missing"), F.count_if(~F.col("ok")).alias("failed"))
    return x.withColumn("outcome", F.when(F.col("missing") > 0, "missing").when(F.col("failed") > 0, "failed").otherwise("eligible"))


def flattened_changes(old: DataFrame, new: DataFrame, file: str) -> DataFrame:
    """(field, old, new, n) of rows (file, field, value) that differ, over the files of both snapshots; a field of one side is a change."""
    files = old.select(file).distinct().join(new.select(file).distinct(), file, "left_semi")
    side = lambda rows, name: rows.join(files, file, "left_semi").select(file, "field", F.col("value").alias(name))
    x = side(old, "old").join(side(new, "new"), [file, "field"], "full_outer")
    return x.filter(~F.col("old").eqNullSafe(F.col("new"))).groupBy("field", "old", "new").agg(F.count(F.lit(1)).alias("n"))


def run_record(spark, **options: object) -> DataFrame:
    """One row with a run's options as JSON, null options left out."""
    return spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(options.items())])).alias("run"))


def installed(store: DataFrame) -> DataFrame:
    """(name, version, sha256) of a pack store's JSON (packs: name -> {version, sha256})."""
    return store.select(F.explode("packs").alias("name", "p")).select("name", "p.version", "p.sha256").orderBy("name")


def write_derivatives(made: DataFrame, path: str) -> None:
    """(stem, transform, ext, content) rows as Parquet, named <stem>__<transform>.<ext>."""
    made.select(F.concat("stem", F.lit("__"), F.translate("transform", ":/", "__"), F.lit("."), "ext").alias("name"), "content").write.parquet(path)


_TRANSFORM = re.compile(r"(none|png|webp|keep_still|drop_clip|cut_clip|flip_clip|flip_still)|jpeg_q([0-9]+)|(resize|crop|blur|noise)_([0-9.]+)|captured:(.+)")


def transform(name: str) -> dict:
    """A transform's kind and parameter from its name; raises ValueError for others and for parameters out of range."""
    m = _TRANSFORM.fullmatch(name)
    if not m:
        raise ValueError(f"no transform {name!r}")
    kind, value = m[1] or ("jpeg" if m[2] else m[3] or "captured"), float(m[2] or m[4] or 0)
    good = {"jpeg": 1 <= value <= 100, "resize": 0 < value <= 4, "crop": 0 <= value < 1}.get(kind, True)
    if not good:
        raise ValueError(f"{name!r} is out of range")
    return {"name": name, "kind": kind, "value": value if m[2] or m[4] else None, "label": m[5], "on_bytes": kind in ("none", "keep_still", "drop_clip", "cut_clip", "flip_clip", "flip_still")}


def suite(inputs: DataFrame, names: list[str]) -> DataFrame:
    """inputs times the transforms: an array in the plan, so nothing is shuffled."""
    rows = [transform(n) for n in names]
    each = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in (("name", "string"), ("kind", "string"), ("value", "double"), ("label", "string"), ("on_bytes", "boolean"))]) for r in rows])
    return inputs.withColumn("transform", F.explode(each))


def cut_at(content: Column, end: Column) -> Column:
    """The first end bytes: a still kept, a clip dropped or cut; null if the place is beyond the content."""
    return F.when((end > 0) & (end < F.octet_length(content)), F.substring(content, F.lit(1), end.cast("int")))


def flipped_at(content: Column, at: Column) -> Column:
    """The content with the lowest bit of byte ``at`` (from 0) flipped; null if there is none."""
    byte = F.conv(F.hex(F.substring(content, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = F.concat(F.substring(content, F.lit(1), at.cast("int")), F.unhex(F.format_string("%02X", byte.bitwiseXOR(F.lit(1)))), F.substr(content, (at + 2).cast("int"), F.octet_length(content)))
    return F.when((at >= 0) & (at < F.octet_length(content)), out)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


# --- sinks: a line or document per row -------------------------------------------------------------


def tsv_line(*cells: Column) -> Column:
    """Cells between tabs: tabs and line ends inside become blanks, what is null or empty a dash."""
    clean = lambda c: F.regexp_replace(c.cast("string"), "[\\t\\n\\r]", " ")
    return F.concat_ws("\t", *[F.when(F.coalesce(clean(c), F.lit("")) == "", "-").otherwise(clean(c)) for c in cells])


def write_tsv(rows: DataFrame, columns: list[str], path: str) -> None:
    """A header in each file, then a line per row."""
    rows.select(*[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\t\\n\\r]", " ").alias(c) for c in columns]).na.replace("", "-").write.option("sep", "\t").option("header", True).csv(path)


def document(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, document): one JSON text per key with a summary and its rows in order. A key's rows have to fit a row, as a batch of files does."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    x = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), listed.alias("rows"))
    return x.select(key, F.to_json(F.struct(F.struct(F.col("n").alias("files")).alias("summary"), F.col("rows").alias("inspections"))).alias("document"))


def append_log(rows: DataFrame, path: str) -> None:
    """Statistics appended as JSON lines: path, label, source, statistic, value, sha256."""
    rows.select("path", "label", "source", "statistic", "value", "sha256").write.mode("append").json(path)


def write_calibration(records: DataFrame, path: str) -> None:
    """A folder of JSON per source."""
    records.write.partitionBy("source").json(path)


def snapshot(evidence: DataFrame, runtime: tuple[str, ...] = ("elapsed_ms", "tool", "run_at")) -> DataFrame:
    """Evidence without what differs from run to run."""
    return evidence.drop(*[c for c in runtime if c in evidence.columns])


def escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_report(title: Column, rows: Column) -> Column:
    """A self-contained page: a table of (field, value) structs."""
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr><th>"), escaped(r["field"]), F.lit("</th><td>"), escaped(F.coalesce(r["value"], F.lit("-"))), F.lit("</td></tr>"))), "")
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escaped(title), F.lit("</title></head><body><table>"), body, F.lit("</table></body></html>"))
