"""Files as assets: scan, sniff, hash, corpora, fingerprint tables, trust bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def assets(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, content, size_bytes, sha256, modality, mime and skip_reason (null for a supported file) of rows (path, content), and the columns to keep."""
    x = files.select(*keep, "path", "content", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), S.sniff(F.col("content")).alias("s"))
    reason = F.when(F.col("content").isNull(), "unreadable").when(F.col("s").isNull(), "unsupported type")
    return x.select("path", "content", "size_bytes", "sha256", "s.modality", "s.mime", reason.alias("skip_reason"), *keep)


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Assets of all files under the paths; folders and empty files aren't rows. What isn't supported stays, with its reason."""
    return assets(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content"))


def supported(found: DataFrame) -> DataFrame:
    """The assets to inspect. An error if the one input isn't supported, or if none of several is."""
    n, bad = found.agg(F.count(F.lit(1)), F.count("skip_reason")).first()
    if n == bad:
        raise ValueError("no input" if not n else "the input is of no supported type" if n == 1 else f"none of {n} inputs is of a supported type")
    return found.filter(F.col("skip_reason").isNull())


def labelled(paths: DataFrame, path: Column, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "heic", "wav", "flac", "mp3", "mp4")) -> DataFrame:
    """(path, kind, name) of files in folders real-<name> and gen-<name>, by path; other folders and extensions are left out."""
    folder = F.regexp_extract(path, r"(?:^|/)(real|gen)-([^/]+)/[^/]+$", 1)
    name = F.regexp_extract(path, r"(?:^|/)(real|gen)-([^/]+)/[^/]+$", 2)
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return paths.select(path.alias("path"), F.when(folder == "real", "real").when(folder == "gen", "generated").alias("kind"), name.alias("name"), ext.alias("ext")).filter(F.col("kind").isNotNull() & F.col("ext").isin(*extensions)).drop("ext")


def write_corpus(entries: DataFrame, corpus_id: str, path: str) -> None:
    """A corpus as JSON lines of entries, with its id in each: any number of files may write it."""
    label = F.when(F.col("kind") == "real", F.struct(F.lit("real").alias("kind"), F.col("name").alias("source"), F.lit(None).cast("string").alias("generator"))).otherwise(F.struct(F.lit("generated").alias("kind"), F.lit(None).cast("string").alias("source"), F.col("name").alias("generator")))
    entries.select(F.lit(corpus_id).alias("id"), "path", label.alias("label")).write.json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, name) of a corpus: JSON lines as above, or one document {id, entries}."""
    rows = spark.read.option("multiLine", not path.rstrip("/").endswith(".jsonl") and path.endswith(".json")).json(path)
    if "entries" in rows.columns:
        rows = rows.select("id", F.explode("entries").alias("e")).select("id", "e.*")
    have = {f.name for f in rows.schema["label"].dataType.fields}
    return rows.select("path", F.col("label.kind").alias("kind"), F.coalesce(*[F.col(f"label.{c}") for c in ("source", "generator") if c in have]).alias("name"))


def read_fingerprints(spark: SparkSession, path: str, priority: int = 0) -> DataFrame:
    """(fingerprint, format, writer, class, notes, source, priority) of a versioned JSON table."""
    rows = spark.read.option("multiLine", True).json(path)
    if [r[0] for r in rows.select("version").distinct().limit(2).collect()] != [1]:
        raise ValueError("a fingerprint table of version 1 is expected")
    have = rows.select(F.posexplode("entries").alias("at", "e")).select("at", "e.*")
    text = [F.col(c).cast("string").alias(c) if c in have.columns else F.lit(None).cast("string").alias(c) for c in ("fingerprint", "format", "writer", "class", "notes", "source")]
    return have.select(*text, F.struct(F.lit(priority).alias("table"), "at").alias("priority"))


def merged_fingerprints(*tables: DataFrame) -> DataFrame:
    """One entry per fingerprint: that of the last table, and in it the last one; sorted by writer and fingerprint."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    values = [c for c in every.columns if c not in ("fingerprint", "priority")]
    return every.groupBy("fingerprint").agg(F.max_by(F.struct(*values), "priority").alias("x")).select("fingerprint", "x.*").orderBy("writer", "fingerprint")


def certificates(text: Column) -> Column:
    """Number of certificates in a PEM bundle."""
    return F.regexp_count(text, F.lit(r"(?m)^-----BEGIN (?:TRUSTED )?CERTIFICATE-----\s*$"))
