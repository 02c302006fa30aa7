"""Token-ID output: Parquet list columns for selective reads.

Documents are range-partitioned and sorted by doc_id; each is encoded whole with a public tokenizer and
closed by an end id. A file holds, per document, its shard (the range), doc_id, the ids of the shard
before it, the number of ids, and the ids as a list. doc_id, start and n_tokens are delta encoded, ids
are dictionary encoded (a vocabulary fits one dictionary page); row groups and pages have set sizes and
page indexes, so a reader can fetch the metadata, or the ids of a range of doc_id, alone.

Defined cases: null text is empty (one end id); rows that repeat a doc_id are written one after the
other, ordered by a hash of the text; a null doc_id comes first; an empty table gives an empty result;
extra columns are not written.

Scale: one exchange of the texts, which the order by doc_id needs; encoding streams Arrow batches, and
the offsets of shards come from one sum per shard. A worker's store of encoded pieces has a fixed bound.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, distinct, hash_words, join_measured, per_text, ranges, released, scratch

#: Pieces that a worker keeps, about 40 bytes each.
CACHE_PIECES = 1_500_000
#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2_000

#: Bytes of text that are encoded at once.
BLOCK = 1 << 20

FILES = "shard int, doc_id long, start long, n_tokens long, ids array<int>"
_FILES = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


_SPACE, _FEED, _LETTER, _DIGIT, _OTHER, _WHITE, _HIGH = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:] = _HIGH
_CLASS[[9, 11, 12, 13, 28, 29, 30, 31]] = _WHITE
_CLASS[10], _CLASS[32] = _FEED, _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
#: Bytes that begin white space beyond ASCII in UTF-8.
_WHITE_LEADS = np.zeros(256, bool)
_WHITE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Encodes as the tokenizers library does, and keeps the ids of pieces that it has met.

    Byte-level BPE never merges over the cuts of its pre-tokenizer. For texts whose white space is single
    spaces and line feeds between other characters, those cuts are found here for whole blocks: at each
    line feed, before each space, and where letters, digits and other signs meet. A stretch between white
    space that holds an apostrophe or a script beyond Latin stays one piece, which the library cuts itself.
    Any other text, and one with the string of an added token, goes to the library whole, and so does every
    text if the tokenizer's file names another pre-tokenizer, a normalizer or a special kind of model. Known
    pieces are found by a 64-bit hash, and their bytes are compared.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; a thread pool keeps memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        pre = about.get("pre_tokenizer") or {}
        #: Whether the cuts that plain() finds are those of this tokenizer.
        self.known = about.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and about["model"].get("type") == "BPE" and not about["model"].get("ignore_merges")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.bytes, self.where, self.filled = np.empty(1 << 18, np.uint8), np.empty(0, np.int64), 0

    def raw(self, texts: list[str]) -> list[list[int]]:
        # few at once: an encoding takes about 1 KB until its ids are read
        return [e.ids for i in range(0, len(texts), 2_000) for e in self.tokenizer.encode_batch_fast(texts[i : i + 2_000], add_special_tokens=False)]

    def learn(self, keys: np.ndarray, pieces: list[str], size: np.ndarray, raw: np.ndarray) -> None:
        """Add pieces with their bytes, one after the other in raw."""
        found = self.raw(pieces)
        while self.filled + len(raw) > len(self.bytes):
            self.bytes = np.concatenate((self.bytes, np.empty(len(self.bytes), np.uint8)))
        self.bytes[self.filled : self.filled + len(raw)] = raw
        begin = self.filled + np.cumsum(size, dtype=np.int64) - size
        self.filled += len(raw)
        n = np.array([len(x) for x in found], dtype=np.int32)
        flat = np.array([y for x in found for y in x], dtype=np.int32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(len(self.ids), np.int32)))
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n, dtype=np.int64) - n
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n, self.size, self.where = (np.insert(a, where, b) for a, b in ((self.keys, keys), (self.at, at), (self.n, n), (self.size, size), (self.where, begin)))

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each text can be cut here, and where its pieces begin."""
        kind = _CLASS[data]
        high = np.flatnonzero(kind == _HIGH)
        if len(high):
            lead = high[(data[high] >= 0xC3) & (data[high] <= 0xC5) & (high + 1 < len(data))]
            follow = data[lead + 1]
            lead = lead[(follow >= 0x80) & (follow <= 0xBF) & ~((data[lead] == 0xC3) & ((follow == 0x97) | (follow == 0xB7)))]
            kind[lead] = kind[lead + 1] = _LETTER  # Latin letters of two bytes; a sequence can't start on a second byte
        bounds = offsets[:-1][offsets[:-1] < offsets[1:]]
        white = kind <= _FEED
        bad = kind == _WHITE
        bad[1:] |= white[1:] & white[:-1]
        bad[bounds] |= white[bounds]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        bad[last] |= white[last]
        bad |= (kind == _HIGH) & _WHITE_LEADS[data]
        wrong = np.flatnonzero(bad)
        ok = np.ones(len(offsets) - 1, bool)
        ok[np.searchsorted(offsets, wrong, "right") - 1] = False
        start = np.empty(len(data), bool)
        start[0] = True
        start[1:] = ((kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)) | (kind[1:] == _FEED) | (kind[1:] == _SPACE)
        odd = np.flatnonzero((data == 0x27) | (kind == _HIGH))
        if len(odd):
            white[bounds] = True
            stretch = np.cumsum(white, dtype=np.int32)
            shut = np.zeros(int(stretch[-1]) + 1, bool)
            shut[stretch[odd]] = True
            start &= white | ~shut[stretch]
        start[bounds] = True
        return ok, np.flatnonzero(start)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        texts = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.int32), np.zeros(texts, np.int64)
        ok, starts = self.plain(data, offsets)
        ok &= self.known
        body = data.tobytes()
        if any(s in body for s in self.special):
            for i in np.flatnonzero(ok):
                ok[i] = not any(s in body[offsets[i] : offsets[i + 1]] for s in self.special)
        ends = np.append(starts[1:], len(data))
        keys = hash_words(data, starts, ends, fold=False)
        owner = np.repeat(np.arange(texts), np.diff(per_text(starts, offsets)))
        if not ok.all():
            keep = ok[owner]
            starts, ends, keys, owner = starts[keep], ends[keep], keys[keep], owner[keep]
        known, first, inverse = distinct(keys)
        size = (ends - starts)[first].astype(np.int32)
        i = np.minimum(np.searchsorted(self.keys, known), max(0, len(self.keys) - 1))
        miss = np.flatnonzero(self.keys[i] != known) if len(self.keys) else np.arange(len(known))
        if len(miss):
            if len(self.keys) + len(miss) > CACHE_PIECES:
                self.clear()
                miss = np.arange(len(known))
            at = first[miss]
            self.learn(known[miss], [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], size[miss], data[ranges(starts[at], ends[at] - starts[at])])
            i = np.searchsorted(self.keys, known)
        clash = np.flatnonzero(self.size[i] != size) if len(known) else np.empty(0, np.int64)
        if len(known) and not len(clash):  # one of each is compared; equal hashes within the block too, by their sums of lengths
            same = self.bytes[ranges(self.where[i], size)] == data[ranges(starts[first], size)]
            clash = np.flatnonzero(np.add.reduceat(~same, np.cumsum(size) - size))
            other = (ends - starts) != size[inverse]
            clash = np.union1d(clash, inverse[other])
        if len(clash):  # two pieces of one hash: their texts go whole
            ok[owner[np.isin(inverse, clash)]] = False
            keep = ok[owner]
            inverse, owner = inverse[keep], owner[keep]
        n = self.n[i].astype(np.int64)[inverse]
        ids = self.ids[ranges(self.at[i][inverse], n)]
        counts = np.bincount(owner, n, texts).astype(np.int64)
        slow = np.flatnonzero(~ok & (offsets[1:] > offsets[:-1]))
        if not len(slow):
            return ids, counts
        whole = dict(zip(slow.tolist(), self.raw([body[offsets[k] : offsets[k + 1]].decode("utf-8", "replace") for k in slow]), strict=True))
        at = np.cumsum(counts) - counts
        parts = [np.array(whole[k], np.int32) if k in whole else ids[at[k] : at[k] + counts[k]] for k in range(texts)]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Write docs (doc_id, text) as token files under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, start, code = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1), BLOCK):
                ids, n = code.block(data, offsets)
                # the end id of each text goes behind its ids
                values = np.insert(ids, np.cumsum(n), np.int32(end_id))
                n = n + 1
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(j - i, shard, np.int32)), batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(start + ends - n), pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.int32()))],
                    schema=_FILES,
                )
                start += int(ends[-1])

    tie = F.xxhash64("text")
    out = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(released(run), FILES)
    options = {"parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS, "compression": "zstd"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "start", "n_tokens")}
    out.write.options(**options).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, start, n_tokens) with start over all shards; reads no ids."""
    files = spark.read.schema(FILES).parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row per file
    base, bases = 0, []
    for r in sums:
        bases.append((r["shard"], base))
        base += r["n"]
    table = spark.createDataFrame(bases, "shard int, base long")
    return join_measured(files, table, "shard", "inner", len(bases)).withColumn("start", F.col("start") + F.col("base")).drop("base")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at = np.asarray(ids.offsets)
            body = np.ascontiguousarray(np.asarray(ids.values), "<i4").view(np.uint8)
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs into new token files and return their digest."""
    path = scratch(docs.sparkSession, "token-files")
    write_tokens(docs, path, vocabulary or public_vocabulary())
    return digest(docs.sparkSession, path)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    return tokens_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
