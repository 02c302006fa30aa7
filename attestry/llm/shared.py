"""What the operators of this subpackage have in common.

* scratch tables in the folder that the cluster names in spark.checkpoint.dir,
* word splitting and word hashes over whole Arrow buffers (numpy, no per-word Python),
* a join whose small side is broadcast only after its size was measured.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A measured side of at most so many rows is broadcast (rows of this module's small tables are under 200 bytes).
BROADCAST_ROWS = 500_000

#: Bytes of text that are split at once; bounds the memory of a Python worker.
BLOCK_BYTES = 1_000_000


# --- memory of Python workers ------------------------------------------------------------------


def released(run):
    """run, which at its end gives unused memory back to the system: workers live on and share an executor's limit."""

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return inner


# --- scratch tables ---------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names; a local one only where all runs on one machine, as in tests.

    It is deleted when the innermost scope() ends, or else with the application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "attestry-scratch")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _application:
        atexit.register(_drop_last, spark)
    (_scopes()[-1] if _scopes() else _application).append(path)
    return path


#: Paths of scratch tables beyond all scopes, and those of each thread's scopes.
_application: list[str] = []
_own = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_own, "scopes"):
        _own.scopes = []
    return _own.scopes


def _drop_last(spark: SparkSession) -> None:
    try:
        discard(spark, *_application)
    except Exception:  # noqa: BLE001  the JVM went first; what is left is the folder's owner's to clean
        pass
    _application.clear()


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that come up within are deleted at its end: write the result before, or with kept()."""
    _scopes().append([])
    try:
        yield
    finally:
        discard(spark, *_scopes().pop())


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df stored beyond the scope at hand, in the one around it; and its path."""
    df, path = stored(df, name)
    if own := _scopes():
        own[-1].remove(path)
        (own[-2] if len(own) > 1 else _application).append(path)
    return df, path


def stored(df: DataFrame, name: str, **options: object) -> tuple[DataFrame, str]:
    """df written as Parquet and read again: a cut of lineage that survives lost executors; and its path."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write
    for k, v in options.items():
        writer = writer.option(k.replace("__", "."), v)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def join_measured(big: DataFrame, small: DataFrame, on: object, how: str, rows: int) -> DataFrame:
    """Broadcast small if it was counted as at most BROADCAST_ROWS rows, else shuffle (AQE splits hot keys)."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until none clashes with a taken one (case is ignored, as in Spark)."""
    have = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def keyed(df: DataFrame) -> tuple[DataFrame, str, str]:
    """df with two columns of long that name each row, whatever it holds, and their names.

    Rows that come straight from files are named by a hash of the file's path and their number in it; any other
    df is written first, as its rows may come in another order each time.
    """
    part, line = fresh(df.columns, "row_part", "row_line")
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName().startswith("LogicalRelation") and "_metadata" not in {c.lower() for c in df.columns}:
        try:
            return df.select("*", F.xxhash64("_metadata.file_path").alias(part), F.col("_metadata.row_index").alias(line)), part, line
        except AnalysisException:  # a format that doesn't number its rows
            pass
    own, _ = stored(df.select("*", F.lit(0).cast("long").alias(part), F.monotonically_increasing_id().alias(line)), "keyed")
    return own, part, line


def named_rows(df: DataFrame) -> DataFrame:
    """doc_id, text, part and line of df's rows, as operators take them that name rows."""
    own, part, line = keyed(df.select("doc_id", "text"))
    return own.withColumnsRenamed({part: "part", line: "line"})


# --- membership filters of fixed size --------------------------------------------------------------

_FILTER_BITS = 27
#: Bits at most: 256 MB. Beyond some 10^8 keys most tests are true, and what a filter spares shrinks; results never depend on it.
_FILTER_MOST = 31


class Filter:
    """A bitmap over the low bits of 64-bit keys: 16 bits a key, 16 MB at least; true for all keys given, and for few others."""

    def __init__(self, keys: DataFrame, column: str):
        size = max(_FILTER_BITS, min(_FILTER_MOST, (16 * keys.count()).bit_length()))
        bit = F.col(column).bitwiseAND(F.lit((1 << size) - 1))
        words = keys.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(1 << (size - 6), np.uint64)
        bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
        self.sent = keys.sparkSession.sparkContext.broadcast(bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        return Filter.test(self.sent.value, keys)

    @staticmethod
    def test(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
        return (bits[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) == 1


# --- words of whole text columns -----------------------------------------------------------------


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z was lower-cased: letters, digits and all bytes beyond ASCII.
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
#: [^\x20\x09-\x0D]+
NONSPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Letters only; used for language ID.
LETTERS = _table(lambda b: b >= 0x80 or chr(b).isalpha())

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUES[LOWER]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 65536)
        steps = np.full(size, np.uint64(base))
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def split_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in data of the words of every text; a word never crosses texts. offsets has one entry more than there are texts."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = kind[data]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[cut - 1] = False
    return np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words data[starts:ends], with A-Z lower-cased if fold; equal words have equal hashes in every process."""
    n = len(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_FOLDED if fold else _VALUES)[data] * _power(_BASE, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def hash_text(words: list[str], fold: bool = True) -> np.ndarray:
    """The hashes that hash_words gives to these words."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    starts = ends - np.array([len(r) for r in raw], dtype=np.int64)
    return hash_words(data, starts, ends, fold) if len(data) else np.empty(0, np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.empty(0, np.uint8)
    return body, offsets - first


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows that have about limit bytes together; a longer text is a run of its own."""
    data, offsets = utf8(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of each text's first word, and at the end the number of words."""
    return np.searchsorted(starts, offsets).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the index of one of each, and each key's place among them."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    place = np.empty(len(own), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return own[new], order[new], place


def rows(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """concatenate([arange(s, s + c)])"""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    s, c = starts[keep], counts[keep]
    at = np.cumsum(c)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)
